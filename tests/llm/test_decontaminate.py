import numpy as np
from pyspark.sql import functions as F

from pulsegrid.llm import decontaminate
from pulsegrid.llm.decontaminate import common_length


def test_common_subsequence_equals_the_table():
    rng = np.random.default_rng(1)
    for _ in range(100):
        a, b = (rng.integers(0, 6, int(rng.integers(0, 25))) for _ in range(2))
        t = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1, j + 1] = t[i, j] + 1 if x == y else max(t[i, j + 1], t[i + 1, j])
        assert common_length(a, b) == t[-1, -1]


def planted(seed=2):
    rng = np.random.default_rng(seed)
    common = [f"c{chr(97 + i)}" for i in range(20)]
    letters = list("bdfghjklmnpqrstvwz")
    word = lambda: "".join(rng.choice(letters, 6)) if rng.random() < 0.6 else str(rng.choice(common))
    prose = lambda n: [word() for _ in range(n)]
    items = [prose(int(rng.integers(15, 60))) for _ in range(30)]
    for w in items:
        w[len(w) // 2] += "."
    docs, truth = {}, {}
    for i in range(120):
        body = prose(int(rng.integers(20, 400)))
        kind = i % 4
        if kind:
            j = int(rng.integers(30))
            leak = list(items[j])
            if kind == 2:  # some words changed and dropped
                for at in rng.choice(len(leak), max(1, len(leak) // 8), replace=False):
                    leak[at] = word()
                del leak[int(rng.integers(len(leak)))]
            if kind == 3:  # in other clothes
                leak = [w.upper() + "!" for w in leak]
            at = int(rng.integers(len(body)))
            body[at:at] = leak
            truth[i] = j
        docs[i] = " ".join(body)
    return [" ".join(w) for w in items], docs, truth


def test_planted_items_are_found_and_nothing_else(spark):
    items, docs, truth = planted()
    df = spark.createDataFrame([*docs.items(), (500, None), (501, ""), (502, "42 !"), (503, " ".join(docs.values())), (504, items[3]), (504, items[3])], "doc_id long, text string")
    df = df.withColumns({"leaked": F.lit("l"), "terms": F.lit(1)}).repartition(3)
    bench = spark.createDataFrame([*((100 + j, t) for j, t in enumerate(items)), (7, None), (8, "--"), (9, items[3])], "item_id long, text string")
    got = [(r["doc_id"], r["leaked_items"]) for r in decontaminate.leaks(df, bench).collect()]
    assert len(got) == 126
    want = lambda i: sorted([100 + truth[i], *([9] if truth[i] == 3 else [])]) if i in truth else []
    assert {i: x for i, x in got if i < 500} == {i: want(i) for i in docs}
    assert [x for i, x in got if i == 504] == [[9, 103]] * 2 and not any(x for i, x in got if i in (500, 501, 502))
    assert set(dict(got)[503]) == {x for i in truth for x in want(i)}
    assert decontaminate.clean(df, bench).columns == df.columns and decontaminate.clean(df, bench).count() == 30 + 3


def test_blocks_of_the_benchmark_and_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK", 8)
    items, docs, truth = planted(3)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    assert {r["doc_id"]: r["leaked_items"] for r in decontaminate.leaks(df, bench).collect()} == {i: [truth[i]] if i in truth else [] for i in docs}
    assert decontaminate.leaks(df, bench.limit(0)).filter("leaked").count() == 0
    assert decontaminate.leaks(df.limit(0), bench).count() == 0


def test_randomised_svd_spans_the_exact_one(spark):
    items, _, _ = planted(4)
    hashes = np.unique(np.concatenate([decontaminate.words_of(t) for t in items]))
    terms, weight = decontaminate.Terms(hashes), np.linspace(1, 2, len(hashes))
    rows = [r for t in items for r in decontaminate.passage_rows(terms, weight, decontaminate.words_of(t))]
    a = np.zeros((len(rows), len(hashes)))
    for i, (t, v) in enumerate(rows):
        a[i, t] = v
    block = spark.createDataFrame([(t,) for t in items], "text string").repartition(3)
    basis, values = decontaminate.randomised_svd(block, terms, weight, rank=24, power=4)
    exact = np.linalg.svd(a, full_matrices=False)[1]
    assert np.allclose(values[:8], exact[:8], rtol=0.01) and np.allclose(basis.T @ basis, np.eye(basis.shape[1]), atol=1e-8)


def test_quotes_of_long_items_are_leaks(spark):
    rng = np.random.default_rng(6)
    word = lambda: "".join(rng.choice(list("bdfghjklmnpqrstvwz"), 6))
    items = [[word() for _ in range(250)] for _ in range(4)]
    body = [[word() for _ in range(150)] for _ in range(6)]
    cuts = [items[0][64:96], items[1][70:170], items[2][101:133], items[3][218:250], items[0][64:76], []]
    docs = spark.createDataFrame([(i, " ".join(b[:75] + c + b[75:])) for i, (b, c) in enumerate(zip(body, cuts, strict=True))], "doc_id long, text string")
    bench = spark.createDataFrame([(j, " ".join(t)) for j, t in enumerate(items)], "item_id long, text string")
    got = {r["doc_id"]: r["leaked_items"] for r in decontaminate.leaks(docs, bench).collect()}
    assert got == {0: [0], 1: [1], 2: [2], 3: [3], 4: [], 5: []}


def test_no_passage_falls_out_of_the_latent_space(spark):
    rng = np.random.default_rng(7)
    word = lambda: "".join(rng.choice(list("bdfghjklmnpqrstvwz"), 6))
    texts = [" ".join(word() for _ in range(150)) for _ in range(40)]
    bench = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    docs = spark.createDataFrame([(1, texts[0])], "doc_id long, text string")
    index = decontaminate.build_index(docs, bench)
    for t in texts:
        for own, a in decontaminate.passage_rows(index.terms, index.weight, decontaminate.words_of(t)):
            assert np.linalg.norm(a @ index.basis[own]) > 0.99 * np.linalg.norm(a)


def test_blocks_follow_passages_and_faint_passages_are_still_found(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "PASSAGES", 20)
    monkeypatch.setattr(decontaminate, "RANK", 3)
    items, docs, truth = planted(5)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    assert decontaminate.build_index(df, bench).faint.any() and decontaminate.passage_count(bench) > 40
    assert {r["doc_id"]: r["leaked_items"] for r in decontaminate.leaks(df, bench).collect()} == {i: [truth[i]] if i in truth else [] for i in docs}


def brute_leaks(items, docs):
    """Every item against every place of every document: the longest common subsequence of the whole document's words, of
    all and of the weighty ones, at the thresholds, and in doubt the answer."""
    n, out = len(docs), {}
    df = {}
    for words in docs.values():
        for w in set(words):
            df[w] = df.get(w, 0) + 1
    for j, words in enumerate(items):
        own = sorted(set(words), key=lambda w: (df.get(w, 0), int(decontaminate.words_of(w)[0])))  # of equally rare words, by their hashes
        heavy = {w for w in own if df.get(w, 0) <= max(decontaminate.COMMON * n, 1)} | set(own[: -(-len(own) // 2)])
        code = {w: k for k, w in enumerate({*words, *(w for d in docs.values() for w in d)})}
        num = lambda x: np.array([code[w] for w in x], np.int64)
        for i, d in docs.items():
            rare = [w for w in words if w in heavy]
            share = min(common_length(num(words), num(d)) / len(words), common_length(num(rare), num(d)) / len(rare))
            told = np.mean([w in d for w in set(rare)]) >= decontaminate.ANSWER  # items without sentences are their own answer
            if share >= decontaminate.SURE or (share >= decontaminate.DOUBT and told):
                out.setdefault(i, []).append(j)
    return out


def test_leaks_equal_brute_force_over_all_pairs(spark):
    """Items of one passage each, of which documents hold three tenths of the words or eight tenths and more, in order."""
    rng = np.random.default_rng(9)
    word = lambda: "".join(rng.choice(list("bdfghjklmnpqrstvwz"), 5))
    items = [[word() for _ in range(int(rng.integers(12, 32)))] for _ in range(25)]
    docs = {}
    for i in range(90):
        part = items[int(rng.integers(25))]
        kept = np.sort(rng.choice(len(part), int(len(part) * rng.choice([0.3, 0.8, 0.9, 1.0])), replace=False))
        docs[i] = [word() for _ in range(int(rng.integers(0, 120)))] + [part[k] for k in kept] + [word() for _ in range(10)]
    df = spark.createDataFrame([(i, " ".join(d)) for i, d in docs.items()], "doc_id long, text string")
    bench = spark.createDataFrame([(j, " ".join(t)) for j, t in enumerate(items)], "item_id long, text string")
    want = brute_leaks(items, docs)
    assert {r["doc_id"]: r["leaked_items"] for r in decontaminate.leaks(df, bench).filter("leaked").collect()} == want and 40 < len(want) < 90


def test_one_pass_for_many_blocks_and_parts_of_very_long_items(spark, monkeypatch):
    rng = np.random.default_rng(10)
    word = lambda: "".join(rng.choice(list("bdfghjklmnpqrstvwz"), 6))
    long = [word() for _ in range(3000)]
    items = [(1, " ".join(long)), (2, " ".join(word() for _ in range(30))), (3, None), (None, "a b c"), (4, " ".join(word() for _ in range(30)))]
    monkeypatch.setattr(decontaminate, "ITEM_WORDS", 700)
    monkeypatch.setattr(decontaminate, "PASSAGES", 50)
    bench = spark.createDataFrame(items, "item_id long, text string")
    parts = decontaminate.item_parts(bench).collect()
    assert sum(r["item_id"] == 1 for r in parts) == 5 and sum(r["last"] for r in parts) == 3
    assert [w for r in parts if r["item_id"] == 1 for w in r["text"].split()] == long
    docs = spark.createDataFrame([(1, " ".join(long[1200:1300])), (2, "x " + items[1][1]), (3, " ".join(word() for _ in range(300))), (4, items[0][1] + " " + items[4][1]), *((100 + i, f"filler {word()}") for i in range(100))], "doc_id long, text string")
    passes = []
    real = decontaminate._searched
    monkeypatch.setattr(decontaminate, "_searched", lambda found, indexes: (passes.append(len(indexes)), real(found, indexes))[1])
    want = {1: [1], 2: [2], 3: [], 4: [1, 4]}
    assert {r["doc_id"]: r["leaked_items"] for r in decontaminate.leaks(docs, bench).filter("doc_id < 100").collect()} == want
    assert len(passes) == 1 and passes[0] > 1
    monkeypatch.setattr(decontaminate, "INDEX_BYTES", 1)
    assert {r["doc_id"]: r["leaked_items"] for r in decontaminate.leaks(docs, bench).filter("doc_id < 100").collect()} == want
    assert len(passes) == 1 + passes[0]


def test_repeated_benchmark_rows_count_once(spark, monkeypatch):
    rng = np.random.default_rng(11)
    word = lambda: "".join(rng.choice(list("bdfghjklmnpqrstvwz"), 6))
    item = " ".join(word() for _ in range(30))
    bench = spark.range(100_000).select(F.lit(7).cast("long").alias("item_id"), F.lit(item).alias("text"))
    docs = spark.createDataFrame([(1, f"x {item} y"), *((10 + i, " ".join(word() for _ in range(40))) for i in range(60))], "doc_id long, text string")
    rows = []
    real = decontaminate.build_index
    monkeypatch.setattr(decontaminate, "build_index", lambda docs, block, counted: (rows.append(block.count()), real(docs, block, counted))[1])
    assert [r["doc_id"] for r in decontaminate.leaks(docs, bench).filter("leaked").collect()] == [1]
    assert rows == [1]


def test_groups_of_indexes_are_searched_apart(spark, monkeypatch):
    """However many groups there are, a task has one of them, and rows of equal texts, nulls and other columns come back."""
    rng = np.random.default_rng(12)
    word = lambda: "".join(rng.choice(list("bdfghjklmnpqrstvwz"), 6))
    items = [(j, " ".join(word() for _ in range(20))) for j in range(40)]
    rows = [(i, f"{word()} {items[i % 40][1]} {word()}" + (f" {items[(i + 7) % 40][1]}" if i % 3 == 0 else "")) for i in range(60)]
    rows += [rows[0], rows[0], (500, None), (None, rows[1][1]), *((600 + i, " ".join(word() for _ in range(30))) for i in range(40))]
    docs = spark.createDataFrame([(*r, "own") for r in rows], "doc_id long, text string, _items string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    key = lambda df: sorted(map(tuple, df.collect()), key=repr)
    whole = key(decontaminate.leaks(docs, bench))
    monkeypatch.setattr(decontaminate, "BLOCK", 5)
    monkeypatch.setattr(decontaminate, "INDEX_BYTES", 1)
    found = decontaminate.leaks(docs, bench)
    assert [(r[0], r[1], r[3], r[5]) for r in key(found)] == [(r[0], r[1], r[3], r[5]) for r in whole] and len(whole) == len(rows)
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 0  # the passes are done


def test_windows_full_of_known_words_gather_the_basis_in_parts(monkeypatch):
    """512 windows of 48 known words and 1,024 dimensions: 96 MB if all rows of the basis were gathered at once."""
    import tracemalloc

    rng = np.random.default_rng(5)
    hashes = np.sort(rng.integers(0, 1 << 63, 4000).astype(np.uint64))
    terms = decontaminate.Terms(hashes)
    basis = rng.normal(size=(len(hashes), 1024)).astype(np.float32)
    items = [hashes[32 * k : 32 * k + 32] for k in range(100)]
    latent = np.array([basis[terms.find(w)[1]].sum(0) for w in items])
    latent /= np.sqrt((latent * latent).sum(1, keepdims=True))
    weight, answers = np.ones(len(hashes)), [w[-4:] for w in items]
    index = decontaminate.Index(list(range(100)), items, items, answers, terms, weight, basis, np.arange(100), [None] * 100, np.full(100, 32.0), latent, np.zeros(100, bool))
    h = rng.choice(hashes, 16 * 520)
    h[1000:1032], h[5000:5032] = items[7], items[70]
    doc = np.arange(len(h)) // 1000
    tracemalloc.start()
    got = index.hits(h, doc)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert {(1, 7), (5, 70)} <= {(d, j) for d, j, *_ in got} and peak < 40e6
    for size in (1, 1 << 40):
        monkeypatch.setattr(decontaminate, "GATHER_BYTES", size)
        assert index.hits(h, doc) == got


def test_tasks_send_the_products_of_their_own_terms(spark, monkeypatch):
    """Not a whole basis for each partition, of which a sum would gather as many as there are tasks."""
    from pyspark.sql.group import GroupedData

    texts = [" ".join(f"{chr(97 + k % 26)}{chr(97 + k // 26)}{chr(97 + i)}x" for i in range(20)) for k in range(60)]
    terms = decontaminate.Terms(np.concatenate([decontaminate.words_of(t) for t in texts]))
    weight = np.ones(len(terms.hashes))
    sent, real = [], GroupedData.applyInArrow
    monkeypatch.setattr(GroupedData, "applyInArrow", lambda self, *a: (sent.append(self._df.agg(F.sum(F.length("part"))).first()[0]), real(self, *a))[1])
    block = spark.createDataFrame([(t,) for t in texts], "text string").repartition(30)
    basis, values = decontaminate.randomised_svd(block, terms, weight, rank=60)
    assert basis.shape == (1200, 60) and np.allclose(values, np.sqrt(20))
    assert max(sent) <= 1200 * 60 * 8
