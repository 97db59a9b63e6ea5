import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.llm import minhash

LOWER = {k: k + 32 for k in range(65, 91)}


def brute(rows):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets[i] = set() if not w else {tuple(w)} if len(w) < 5 else {tuple(w[j : j + 5]) for j in range(len(w) - 4)}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    seen = defaultdict(list)
    for i, s in sets.items():
        both = Counter(j for g in s for j in seen[g])
        for g in s:
            seen[g].append(i)
        for j, n in both.items():
            if 100 * n >= 85 * (len(s) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(sets[i]), find(i)) for i in sets}


def texts(seed=0, n=60):
    """Families of copies with a few words changed, chains of ever more changes, a shared passage, and odd texts."""
    rng = np.random.default_rng(seed)
    word = lambda: "w%d" % rng.integers(4000)
    passage = [word() for _ in range(40)]
    out = [None, "", "  \t\n", "One", "one", "a b c d", "A B C D", "a b c d e", "x y", "\x0b\x0c"]
    for _ in range(n // 6):
        base = [word() for _ in range(int(rng.integers(30, 200)))]
        out.append(" ".join(base))
        for _ in range(4):
            copy = list(base)
            for at in rng.integers(0, len(base), int(rng.integers(1, 4))):
                copy[at] = word()
            out.append(" ".join(copy).upper() if rng.random() < 0.3 else "  ".join(copy))
        out.append(" ".join(base[:10] + passage + base[10:20]))
    chain = [word() for _ in range(300)]
    for _ in range(12):
        chain = list(chain)
        chain[int(rng.integers(300))] = chain[int(rng.integers(300))] = word()
        out.append(" ".join(chain))
    out += [out[12]] * 5 + ["z " * 3000, "long " + " ".join(word() for _ in range(20000))]
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_brute_force(spark, seed):
    rows = list(enumerate(texts(seed)))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("text", "text").selectExpr("doc_id", "text", "1 as component_id", "'x' as kept", "0 as task")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(df).collect()}
    assert got == brute(rows)


def test_blocks_of_hot_lists_and_groups_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(minhash, "LIST_BLOCK", 3)
    monkeypatch.setattr(minhash, "GROUP_BLOCK", 3)
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in rng.integers(0, 9999, 300)]
    rows = []
    for i in range(25):
        copy = list(base)
        for at in rng.integers(0, 300, 2):
            copy[at] = f"v{i}"
        rows.append((i, " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(df).collect()} == brute(rows)


@pytest.mark.parametrize("leaders", [0, 1, 4])
def test_rows_outside_the_largest_component_lose_no_link(spark, monkeypatch, leaders):
    """Two families in the same hot lists, a chain, a shared passage: with few leaders or none, most rows are asked again."""
    monkeypatch.setattr(minhash, "LIST_BLOCK", 4)
    monkeypatch.setattr(minhash, "GROUP_BLOCK", 4)
    monkeypatch.setattr(minhash, "LEADERS", leaders)
    rng = np.random.default_rng(8)
    base = [f"w{i}" for i in rng.integers(0, 9999, 200)]
    rows = []
    for i in range(40):
        copy = list(base[:140]) + [f"f{i % 2}x{j}" for j in range(60)] if i < 30 else list(base)
        copy[int(rng.integers(140))] = f"v{i}"
        rows.append((i, " ".join(copy)))
    for i in range(10):
        base[i * 7] = f"c{i}"
        rows.append((40 + i, " ".join(base)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(df).collect()} == brute(rows)


def test_rows_of_a_hot_group_are_dealt_in_proportion(spark, monkeypatch):
    """10^6 alike rows: what goes to the tasks is the rows and some leaders for each block."""
    seen = []

    def find(rows):
        seen.append(rows.count())
        nodes = rows.filter("role = 0").select("node")
        return nodes.select(F.lit(0).cast("long").alias("a"), F.col("node").alias("b")).filter("b > 0")

    n = 1_000_000
    rows = spark.range(n).select(F.lit(5).alias("group"), F.col("id").alias("node"), F.lit(-(-n // minhash.LIST_BLOCK)).alias("blocks"), F.lit(minhash.LEADERS / n).alias("lead"))
    monkeypatch.setattr(minhash, "connected_components", lambda edges, **_: edges.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(spark.createDataFrame([(0, 0)], "node long, component long")))
    assert minhash.hot_links(rows, find).count() == n - 1
    assert len(seen) == 1 and seen[0] < (1 + 1.5 * minhash.LEADERS / minhash.LIST_BLOCK) * n  # about LEADERS for each block


def test_words_of_equal_power_sums_are_not_linked(spark):
    words = ["".join("ab"[(bin(i).count("1") + swap) % 2] for i in range(2048)) for swap in (0, 1)]
    got = minhash.near_duplicates(spark.createDataFrame(list(enumerate(words)), "doc_id long, text string")).collect()
    assert sorted(r["component_id"] for r in got) == [0, 1]


def test_unfinished_components_raise(spark):
    from pulsegrid.llm.common import connected_components

    chain = spark.range(64).selectExpr("id as a", "id + 1 as b")
    assert {r["component"] for r in connected_components(chain).collect()} == {0}
    with pytest.raises(RuntimeError):
        connected_components(chain, rounds=1)


def test_spanning_forest_joins_what_is_linked():
    rng = np.random.default_rng(6)
    for _ in range(30):
        n = int(rng.integers(1, 40))
        near = np.triu(rng.random((n, n)) < rng.choice([0.02, 0.1, 0.5]), 1)
        near |= near.T
        label = np.arange(n)
        for a, b in minhash.spanning(n, lambda i, near=near: np.flatnonzero(near[i]), leaders=int(rng.integers(0, 4))):
            label[label == label[b]] = label[a]
        want = np.arange(n)
        for _ in range(n):
            for i in range(n):
                want[i] = min([want[i], *want[near[i]]])
        assert len(np.unique(label)) == len(np.unique(want))
        assert all((label[i] == label[j]) == (want[i] == want[j]) for i in range(n) for j in range(n))


def test_empty_table_null_ids_and_shared_ids(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert minhash.near_duplicates(empty).count() == 0
    a, b = "p q r s t u", "k l m n o p"
    df = spark.createDataFrame([(None, a), (1, a), (1, b), (2, b), (3, a), (None, None)], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(df).collect()), key=repr)
    assert got == sorted([(None, None, True), (None, None, True), (1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False)], key=repr)
