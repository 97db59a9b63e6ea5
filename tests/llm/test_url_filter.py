import fnmatch
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.llm import url_filter
from pulsegrid.llm.registry import ORACLE_SQL


def test_automaton_equals_a_backtracking_matcher():
    rng = np.random.default_rng(1)
    globs = ["".join(rng.choice(list("ab*?."), int(rng.integers(0, 12)))) for _ in range(90)] + ["*", "", "a" * 100 + "*b"]
    texts = ["".join(rng.choice(list("ab."), int(rng.integers(0, 15)))) for _ in range(200)] + ["a" * 100 + "bb", "", "a" * 99 + "b"]
    machine = url_filter.GlobAutomaton(globs)
    assert machine.words > 1
    got = machine.match([t.encode() for t in texts])
    for j, g in enumerate(globs):
        plain = re.compile(fnmatch.translate(g))
        assert [bool(plain.match(t)) for t in texts] == got[:, j].tolist(), g


URLS = [
    None, "", "nothing", "http://", "http://A.Example.NET/en/x", "http://example.net/en/", "http://example.net/en", "https://example.net", "http://x.net?/en/", "http://x.net#a/b", "ftp://a.b.ORG/fr/1?x",
    "http://fr.org/fr/", "http://example.com/de/1", "http://notexample.com/de/1", "http://org/fr/x", "http://net/", "http://a.com/net/", "http://x.casino.com/", "http://cheap-pills.org/fr/", "http://a.com/b/wp-login.php",
    "http://a.com/x.exe?y", "http://a.com/.net/#x", "a://b://c.net/", "http://user@h.net:80/p", "http://\u00c9.net/", "http://h.com/" + "a" * 20000,
]


def test_verdicts_and_sql(spark, tmp_path):
    df = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "page_id long, url string").withColumn("host", F.lit(3)).withColumn("html", F.lit("h"))
    df.write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: tuple(r) for r in url_filter.op3_url_filter(spark, str(tmp_path)).collect()}
    db = duckdb.connect()
    db.sql(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    assert got == {r[0]: r for r in db.sql(ORACLE_SQL["op3_url_filter"]).fetchall()}
    assert got[0] == (0, "", "", None, "allow")
    assert got[4][1:] == ("a.example.net", "/en/x", "example.net/en/", "allow") and got[6][3:] == ("net/", "block") and got[7][3:] == (None, "allow")
    assert got[17][4] == got[19][4] == got[20][4] == "block" and got[13][3] is None


@pytest.mark.parametrize(
    "url, rule, verdict",
    [
        ("http://net/", "net/", "block"), ("http://a.b.net/x", "net/", "block"), ("http://example.net/", "net/", "block"), ("http://example.net/en", "net/", "block"),
        ("http://example.net/en/", "example.net/en/", "allow"), ("http://a.example.net/en/x", "example.net/en/", "allow"), ("http://notexample.net/en/x", "net/", "block"),
        ("http://example.com/de/", "example.com/de/", "block"), ("http://a.example.com/de/x", "example.com/de/", "block"), ("http://example.com/en/", None, "allow"),
        ("http://fr.org/fr/", "org/fr/", "allow"), ("http://org/fr/x", "org/fr/", "allow"), ("http://a.b.ORG/fr/1?x", "org/fr/", "allow"), ("http://cheap-pills.org/fr/", "org/fr/", "allow"),
        ("http://cheap-pills.org/en/", None, "block"), ("http://fr.org/FR/", None, "allow"), ("http://borg/fr/", None, "allow"),
    ],
)
def test_each_rule_as_the_contract_has_it(spark, url, rule, verdict):
    """The expected values are written out by hand from the contract: block net/, allow example.net/en/, block
    example.com/de/, allow org/fr/; without a rule, the globs."""
    got = url_filter.filter_urls(spark.createDataFrame([(1, url)], "page_id long, url string")).first()
    assert (got["rule"], got["verdict"]) == (rule, verdict)


def test_ties_go_to_the_first_rule_and_no_rules_to_the_default(spark):
    df = spark.createDataFrame([(1, "http://a.b/"), (2, None)], "page_id long, url string")
    both = [("a.b", "/", "block"), ("a.b", "/", "allow")]
    assert {r["verdict"] for r in url_filter.filter_urls(df.filter("page_id = 1"), site_rules=both).collect()} == {"block"}
    assert {r["verdict"] for r in url_filter.filter_urls(df, site_rules=[], block_globs=[], default="allow").collect()} == {"allow"}


def test_empty_and_repeated(spark):
    df = spark.createDataFrame([(1, "http://a.net/"), (1, "http://a.net/")], "page_id long, url string")
    assert [r["verdict"] for r in url_filter.filter_urls(df).collect()] == ["block"] * 2
    assert url_filter.filter_urls(df.limit(0)).count() == 0
