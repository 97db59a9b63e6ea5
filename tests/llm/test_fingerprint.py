import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.llm import fingerprint
from pulsegrid.llm.fingerprint import Sketch


def parts(text):
    raw = np.frombuffer(text.encode(), np.uint8)
    return fingerprint.digests(raw, np.array([0, len(raw)]))


def test_peeling_recovers_the_exact_difference():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 500).astype(np.uint64)
    b = np.concatenate([a[60:], rng.integers(0, 2**63, 25).astype(np.uint64)])
    left, right = Sketch(1, 192), Sketch(1, 192)
    left.add(np.zeros(len(a), int), a)
    right.add(np.zeros(len(b), int), b)
    whole, only_a, only_b = left.minus(right).peel()
    assert whole[0] and only_a[0] == 60 and only_b[0] == 25
    small = [Sketch(1, 24), Sketch(1, 24)]
    for s, x in zip(small, (a, b), strict=True):
        s.add(np.zeros(len(x), int), x)
    assert not small[0].minus(small[1]).peel()[0][0]


def test_likeness_is_the_jaccard_index_of_the_paragraphs():
    rng = np.random.default_rng(2)
    word = lambda: "w%d" % rng.integers(500)
    for _ in range(20):
        a = "\n".join(" ".join(word() for _ in range(int(rng.integers(1, 30)))) for _ in range(int(rng.integers(1, 30))))
        b = a[: int(rng.integers(0, len(a)))] + " ".join(word() for _ in range(int(rng.integers(0, 200))))
        x, y = parts(a), parts(b)
        sx, sy = set(x[1].tolist()), set(y[1].tolist())
        assert len(sx) == len(x[1])  # repeats have digests of their own
        assert fingerprint.likeness(1, x, y)[0] == pytest.approx(len(sx & sy) / len(sx | sy))
    none = parts("")
    assert fingerprint.likeness(1, none, none)[0] == 1 and fingerprint.likeness(1, parts("a"), none)[0] == 0


def documents(spark):
    rng = np.random.default_rng(3)
    out = [(i, "\n".join(" ".join("w%d" % rng.integers(900) for _ in range(9)) for _ in range(int(rng.integers(1, 20))))) for i in range(60)]
    out += [(60, None), (61, ""), (62, "é"), (63, "\U0001f600\U0001f601\U0001f602"), (64, " ".join("w%d" % i for i in range(30000))), (65, out[3][1])]
    return out, spark.createDataFrame(out, "doc_id long, text string").withColumn("block", F.lit("x")).repartition(5)


def test_edited_texts_and_order(spark, tmp_path):
    rows, df = documents(spark)
    pairs = fingerprint.with_next(df).collect()
    order = sorted(rows, key=lambda r: -r[0])
    following = {r[0]: (order[(i + 1) % len(order)][1] or "") for i, r in enumerate(order)}
    assert {r["doc_id"]: r["next_text"] for r in pairs} == following
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in fingerprint.op1_fingerprint(spark, str(tmp_path)).collect()}
    for i, t in rows:
        t = t or ""
        k = len(t) // 3
        edited = t[: len(t) - k] + following[i][:k]
        assert got[i]["n_chars"] == len(t) and got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        x, y = (set(parts(v)[1].tolist()) for v in (t, edited))
        assert got[i]["near_edited"] == pytest.approx(len(x & y) / len(x | y) if x | y else 1)
    assert got[65]["fingerprint"] == got[3]["fingerprint"] and got[60]["fingerprint"] == got[61]["fingerprint"]


def test_small_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert fingerprint.with_next(empty).count() == 0
    one = fingerprint.with_next(spark.createDataFrame([(7, "a b")], "doc_id long, text string")).collect()
    assert [(r["doc_id"], r["next_text"]) for r in one] == [(7, "a b")]
    same = fingerprint.with_next(spark.createDataFrame([(7, "b"), (7, "a"), (None, "n")], "doc_id long, text string")).collect()
    assert sorted((r["text"], r["next_text"]) for r in same) == [("a", "b"), ("b", "n"), ("n", "a")]


def test_every_column_of_the_query(spark, tmp_path, monkeypatch):
    """Against sets of digests, with blocks of a few rows each."""
    monkeypatch.setattr(fingerprint, "BLOCK_BYTES", 4000)
    monkeypatch.setattr(fingerprint, "GROUP_BYTES", 3000)
    rows, df = documents(spark)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    order = sorted(rows, key=lambda r: -r[0])
    following = {r[0]: (order[(i + 1) % len(order)][1] or "") for i, r in enumerate(order)}
    got = {r["doc_id"]: r for r in fingerprint.op1_fingerprint(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    prints = {}
    for i, t in rows:
        t = t or ""
        k = len(t) // 3
        edited = t[: len(t) - k] + following[i][:k]
        x, y, z = (set(parts(v)[1].tolist()) for v in (t, edited, following[i]))
        assert got[i]["near_next"] == pytest.approx(len(x & z) / len(x | z) if x | z else 1)
        assert (got[i]["n_removed"], got[i]["n_added"]) == (len(x - y), len(y - x))
        for text, name in ((t, "fingerprint"), (edited, "edited_fingerprint")):
            assert prints.setdefault(text, got[i][name]) == got[i][name]
    assert len(set(prints.values())) == len({frozenset(parts(t)[1].tolist()) for t in prints})


def test_recovered_digests_are_the_differing_paragraphs(spark):
    rows = [(1, "a b c d\ne f g h\ni j", "a b c d\nnew one\ni j", None), (2, None, "", ""), (3, " ".join("w%d" % i for i in range(4000)), " ".join("v%d" % i for i in range(3000)), "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, edited string, next_text string").withColumns({"fingerprint": F.lit(1), "added": F.lit("x"), "kept": F.lit(2)})
    for r, (_, a, b, _) in zip(fingerprint.fingerprint_versions(df).orderBy("doc_id").collect(), rows, strict=True):
        x, y = (set(parts(v or "")[1].view(np.int64).tolist()) for v in (a, b))
        assert set(r["removed"]) == x - y and set(r["added"]) == y - x and r["kept"] == 2
        told = fingerprint.stored_difference(r["fingerprint"], r["edited_fingerprint"])
        assert (told is None) == (r["doc_id"] == 3)
        if told:
            assert set(told[0].view(np.int64).tolist()) == x - y and set(told[1].view(np.int64).tolist()) == y - x
    assert fingerprint.fingerprint_versions(df.limit(0)).count() == 0


def test_rows_that_never_peel_are_told_apart_by_their_digests(monkeypatch):
    none = np.zeros(0, np.int64)
    monkeypatch.setattr(Sketch, "recover", lambda self: (np.zeros(self.rows, bool), none, none.astype(np.uint64), none))
    a, b = parts("a\nb\nc\nd"), parts("a\nx\ny")
    got, row, keys, side = fingerprint.differences(1, a, b)
    x, y = set(a[1].tolist()), set(b[1].tolist())
    assert got[0] == pytest.approx(len(x & y) / len(x | y)) and set(keys[side == 1].tolist()) == x - y and set(keys[side == -1].tolist()) == y - x


@pytest.mark.parametrize("n", [1024, 2048])
def test_words_of_equal_power_sums_have_different_fingerprints(spark, n):
    word = lambda swap: "".join("ab"[(bin(i).count("1") + swap) % 2] for i in range(n))
    df = spark.createDataFrame([(1, word(0), word(1), word(0))], "doc_id long, text string, edited string, next_text string")
    r = fingerprint.fingerprint_versions(df).first()
    assert r["fingerprint"] != r["edited_fingerprint"] and (r["near_edited"], r["near_next"]) == (0, 1)
