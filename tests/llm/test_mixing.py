import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.llm import mixing


def test_one_number_of_many_rows_fills_no_sample(spark, monkeypatch):
    """All rows of one doc_id have one hash; there may be any number of them, or of rows without one."""
    seen = []
    real = mixing.seed_topics
    monkeypatch.setattr(mixing, "seed_topics", lambda x, topics: (seen.append(len(x)), real(x, topics))[1])
    rows = spark.range(4000).selectExpr("cast(if(id % 2 = 0, null, id % 3) as long) as doc_id", "concat('words of kind ', id % 7, ' and some more') as text")
    assert mixing.fit_topics(rows, rows=50).shape[1] == mixing.WIDTH
    one = rows.filter("doc_id = 1")
    assert mixing.fit_topics(one, rows=50).shape[1] == mixing.WIDTH
    assert max(seen) <= 100


def cells_of(spark, rows):
    return spark.createDataFrame(rows, "source string, lang string, topic int, tokens long")


def test_raking_meets_all_targets(spark):
    rng = np.random.default_rng(1)
    rows = [(f"s{a}", f"l{b}", t, int(rng.integers(1, 500))) for a in range(4) for b in range(3) for t in range(3)]
    targets = {"source": {"s0": 0.4, "s1": 0.3, "s2": 0.2, "s3": 0.1}, "lang": {"l0": 1, "l1": 1, "l2": 1}, "topic": {0: 0.2, 1: 0.3, 2: 0.5}}
    got = mixing.raked(cells_of(spark, rows), targets).toPandas()
    w = got.tokens * got.weight
    for d, goal in targets.items():
        share = w.groupby(got[d]).sum() / w.sum()
        assert all(share[k] == pytest.approx(v / sum(goal.values()), abs=1e-3) for k, v in goal.items())
    # what raking keeps: the odds ratios
    table = np.zeros((4, 3, 3, 2))
    for r in got.itertuples():
        table[int(r.source[1]), int(r.lang[1]), r.topic] = r.tokens, r.tokens * r.weight
    ratio = lambda x: x[0, 0, 0] * x[1, 1, 0] / (x[0, 1, 0] * x[1, 0, 0])
    assert ratio(table[..., 0]) == pytest.approx(ratio(table[..., 1]))


def test_nulls_missing_targets_and_empty_cells(spark):
    rows = [(None, "a", 0, 100), ("s", None, 0, 300), ("s", "a", 1, 0), ("t", "a", 1, 50)]
    got = mixing.raked(cells_of(spark, rows), {"source": {"s": 1.0}}).toPandas()
    assert len(got) == 4 and got[got.source.isna()].weight.iloc[0] == 0
    assert mixing.raked(cells_of(spark, [])).count() == 0


def test_probabilities_spend_the_budget(spark):
    got = mixing.keep_probabilities(mixing.raked(cells_of(spark, [(f"s{i}", "a", 0, 10 ** (i + 1)) for i in range(5)])), 0.3).toPandas()
    assert (got.tokens * got.keep).sum() / got.tokens.sum() == pytest.approx(0.3, abs=5e-3) and got.keep.max() <= 1


def test_documents_are_drawn_alike_each_time(spark):
    rng = np.random.default_rng(2)
    rows = [(i, " ".join("word%d" % k for k in rng.integers(0, 50, 30)), "big" if i % 5 else None, "x" if i % 3 else None) for i in range(800)]
    rows += [(900, None, "big", "x"), (901, "", "big", "x"), (902, "z " * 20000, "rare", "x"), (1, rows[1][1], "big", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").withColumns({"keep": F.lit("k"), "tokens": F.lit("t"), "extra": F.lit(1)})
    got = mixing.mixed(docs).toPandas()
    assert len(got) == len(rows) and got[got.doc_id == 900].tokens.iloc[0] == 0 and got[got.doc_id == 1].kept.nunique() == 1
    assert (got.tokens * got.keep).sum() / got.tokens.sum() == pytest.approx(0.5, abs=0.01)
    assert abs(got.kept.sum() - got.keep.sum()) < 60
    again = mixing.mixed(docs.repartition(3)).toPandas()
    assert set(again[again.kept].doc_id) == set(got[got.kept].doc_id)
    assert mixing.mixed(docs.limit(0)).count() == 0


def test_topics_are_fitted_on_all_documents(spark):
    rng = np.random.default_rng(5)
    words = lambda group: [f"group{group}word{chr(97 + k)}" for k in rng.integers(0, 12, 40)]
    texts = [" ".join(words(i % 3)) for i in range(600)]
    docs = spark.createDataFrame([*enumerate(texts), (1000, None), (1001, "a b")], "doc_id long, text string").repartition(4)
    centers = mixing.fit_topics(docs, rows=60, topics=3)
    data = [t.encode() for t in texts]
    x, _ = mixing.bags(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
    own = (x @ centers.T).argmax(1)
    for k in range(3):  # each centre is the mean direction of all of its documents, not of the sampled ones
        m = x[own == k].sum(0)
        assert np.allclose(centers[k], m / np.sqrt(m @ m), atol=1e-4)
    assert (mixing.fit_topics(docs.repartition(7), rows=60, topics=3) == centers).all()


def brute_rake(rows, targets, budget):
    """Bounded raking by its dual: the factors of one value at a time by bisection, with keep = min(1, product)."""
    tokens = np.array([r[3] for r in rows], float)
    codes = [[r[d] for r in rows] for d in range(3)]
    factor = [dict.fromkeys(c, 1.0) for c in codes]
    keep = lambda: np.minimum(1, np.prod([[f[c] for c in code] for f, code in zip(factor, codes)], axis=0))
    for _ in range(60):
        for d, goal in enumerate(targets):
            for v, share in goal.items():
                low, high = -60.0, 60.0
                for _ in range(45):
                    mid = (low + high) / 2
                    factor[d][v] = np.exp(mid)
                    got = (tokens * keep())[[c == v for c in codes[d]]].sum()
                    low, high = (mid, high) if got < share * budget * tokens.sum() else (low, mid)
    return keep()


def clamped_case():
    rng = np.random.default_rng(7)
    rows = [(f"s{a}", f"l{b}", t, int(rng.integers(1, 300)) * (1 + 20 * (a == 0))) for a in range(3) for b in range(2) for t in range(2)]
    targets = {"source": {"s0": 0.6, "s1": 0.2, "s2": 0.2}, "lang": {"l0": 0.5, "l1": 0.5}, "topic": {0: 0.5, 1: 0.5}}
    return rows, targets


def test_clamped_raking_equals_a_brute_force_version(spark):
    rows, targets = clamped_case()
    cells = cells_of(spark, rows)
    total = sum(r[3] for r in rows)
    have = {s: sum(r[3] for r in rows if r[0] == s) / total for s in ("s1", "s2")}
    budget = 0.9 * min(have.values()) / 0.2
    got = mixing.keep_probabilities(mixing.raked(cells, targets), budget, targets).toPandas().sort_values(["source", "lang", "topic"])
    assert (got.keep == 1).any()  # the clamp is at work
    want = brute_rake(rows, list(targets.values()), budget)
    assert got.keep.to_numpy() == pytest.approx(want, abs=1e-3)
    report = mixing.margin_report(cells.join(spark.createDataFrame(got)[["source", "lang", "topic", "keep"]], ["source", "lang", "topic"]), budget, targets).collect()
    assert all(r["feasible"] and r["expected"] == pytest.approx(r["target"], rel=1e-3) for r in report) and len(report) == 7


def test_a_target_beyond_its_tokens_is_named_and_the_others_share_the_rest(spark):
    rows = [("a", "x", 0, 900), ("b", "x", 0, 60), ("c", "x", 0, 40)]
    targets = {"source": {"a": 0.4, "b": 0.3, "c": 0.3}, "lang": {"x": 1.0}, "topic": {0: 1.0}}
    got = mixing.keep_probabilities(mixing.raked(cells_of(spark, rows), targets), 0.5, targets)
    keep = {r["source"]: r["keep"] for r in got.collect()}
    assert keep["b"] == keep["c"] == 1 and keep["a"] == pytest.approx(400 / 900, rel=1e-4)
    told = {r["value"]: r for r in mixing.margin_report(got, 0.5, targets).filter("margin = 'source'").collect()}
    assert [told[v]["feasible"] for v in "abc"] == [True, False, False] and told["b"]["reachable"] == pytest.approx(0.12) == told["b"]["expected"]


def test_many_cells_are_raked_alike_by_grouped_sums(spark, monkeypatch):
    rows, targets = clamped_case()
    rows = [(None if a == "s2" else a, b, t, n) for a, b, t, n in rows]
    monkeypatch.setattr(mixing, "TOLERANCE", 1e-3)
    here = mixing.keep_probabilities(mixing.raked(cells_of(spark, rows)), 0.6).collect()
    monkeypatch.setattr(mixing, "CELLS_HERE", 2)
    spread = mixing.keep_probabilities(mixing.raked(cells_of(spark, rows)), 0.6).collect()
    key = lambda r: (str(r["source"]), r["lang"], r["topic"])
    assert [r["keep"] for r in sorted(here, key=key)] == pytest.approx([r["keep"] for r in sorted(spread, key=key)], abs=1e-6)


def test_raked_cells_come_back_without_more_python_workers(spark, monkeypatch):
    """A table made of rows has its executors start Python workers of another kind, which stay beside the others."""
    cells = spark.sql("select 'a' source, 'x' lang, 0 topic, 60L tokens union all select 'b', null, 1, 40L")
    monkeypatch.setattr(type(spark.sparkContext), "parallelize", lambda *a, **k: 1 / 0)
    got = {r["source"]: r["weight"] for r in mixing.raked(cells, temper=1.0).collect()}
    assert set(got) == {"a", "b"} and all(w > 0 for w in got.values())
