import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.llm import language, quality, toxicity
from pulsegrid.llm.subwords import Words, hash_sample

ODD = [None, "", " \n", "1234 !!", "word", "é", "x " * 30000, "a\x00b", "\U0001f600"]
SYLLABLES = {"aa": ["ka", "to", "mi", "ru", "sen"], "bb": ["sch", "ung", "ber", "keit", "ein"]}


def sentence(rng, lang="aa", n=40):
    return " ".join("".join(rng.choice(SYLLABLES[lang], int(rng.integers(1, 4)))) for _ in range(n))


def held(i, by, at):
    return zlib.crc32(str(i).encode()) % by == at


def test_grams_lie_in_words_with_their_ends():
    text = "Ab, abc\tx"
    raw = np.frombuffer((text + "bca").encode(), np.uint8)
    w = Words(raw, np.array([0, len(text), len(raw)]))
    assert [w.out[a:b].tobytes() for a, b in zip(w.starts, w.ends)] == [b"ab", b"abc", b"x", b"bca"] and w.doc.tolist() == [0, 0, 0, 1]
    counts = {n: np.bincount(word, minlength=4).tolist() for n, (word, _) in zip((2, 3, 4), w.grams(2, 4, 18))}
    # a word of k letters has k + 2 places, so k + 3 - n grams of n
    assert counts == {n: [max(0, k + 3 - n) for k in (2, 3, 1, 3)] for n in (2, 3, 4)}
    once = dict(zip((2, 3), ([set(b[word == i].tolist()) for i in range(4)] for word, b in w.grams(2, 3, 30))))
    assert once[3][0] & once[3][1] and not once[3][2] & once[3][1]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(1)
    rows, labels = [], []
    for i in range(600):
        lang = "aa" if rng.random() < 0.6 else "bb"
        text = sentence(rng, lang)
        toxic, good = int(rng.random() < 0.3), int(rng.random() < 0.8)
        if toxic:
            words = text.split()
            words[int(rng.integers(len(words)))] = "zxqwv" + str(rng.choice(["", "ing", "er", "s"]))
            text = " ".join(words)
        if not good:
            text = " ".join(x.upper() + "!!" for x in text.split())
        rows.append((i, text, lang if rng.random() < 0.95 else None, f"host{int(rng.integers(5))}/p{int(rng.integers(3))}" if i % 9 else None))
        labels.append((i, good, toxic))
    rows += [(1000 + i, t, None, None) for i, t in enumerate(ODD)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumns({"score": F.lit("x"), "evidence": F.lit(1), "site": F.lit(2), "p": F.lit(3)})
    labels = spark.createDataFrame([*labels, (5, None, None), labels[7], labels[7]], "doc_id long, quality int, toxic int")
    return docs.repartition(4).cache(), labels


@pytest.fixture(scope="module")
def folder(corpus, tmp_path_factory):
    at = tmp_path_factory.mktemp("corpus")
    corpus[0].write.parquet(f"{at}/documents.parquet")
    corpus[1].write.parquet(f"{at}/labels.parquet")
    return str(at)


def test_toxicity_generalises_to_unseen_forms(spark, corpus, folder):
    got = {r["doc_id"]: r for r in toxicity.op5_toxicity(spark, folder).collect()}
    assert len(got) == 600 + len(ODD) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got.values())
    assert all(r["held_out"] == held(i, 4, 2) for i, r in got.items())
    truth = {r["doc_id"]: r["toxic"] for r in corpus[1].filter("quality is not null").collect()}
    wrong = [i for i, y in truth.items() if got[i]["held_out"] and got[i]["predicted"] != y]
    assert len(wrong) <= 4
    model = toxicity.fit(*corpus)
    spelt = lambda t: float(model.scores(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))[0])
    assert spelt("kato zxqwvest miru") > 0.3 > spelt("kato miruest miru")
    assert got[1000]["score"] == got[1001]["score"] == got[1002]["score"]


def test_toxicity_without_labels(spark, corpus):
    docs, labels = corpus
    assert {r["predicted"] for r in toxicity.score(docs, toxicity.fit(docs, labels.limit(0))).selectExpr("int(score >= 0.3) predicted").collect()} == {0}
    assert toxicity.score(docs.limit(0), toxicity.train([], np.zeros(0))).count() == 0


def plain_toxicity(model, text):
    """The definition itself: embeddings of all n-grams of each run of WINDOW words averaged, a softmax, the worst run."""
    words = re.findall("[a-z\x80-\xff]+", text.encode().decode("latin-1").translate({k: k + 32 for k in range(65, 91)}))
    runs = [words[i : i + model.window] for i in range(max(1, len(words) - model.window + 1))]
    worst = 0.0
    for run in runs:
        rows = []
        for w in run:
            raw = w.encode("latin-1")
            for n, (_, bucket) in zip(range(3, 7), Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)])).grams(3, 6, toxicity.BITS)):
                rows += [model.emb[b] for b in bucket]
        mean = np.mean(rows, 0) if rows else np.zeros(toxicity.DIM)
        z = np.exp(model.soft @ mean + model.bias)
        worst = max(worst, z[1] / z.sum())
    return worst


def test_toxicity_equals_averages_through_a_softmax():
    rng = np.random.default_rng(4)
    texts = [sentence(rng, n=int(rng.integers(1, 30))) + (" zxqwv" if i % 3 == 0 else "") for i in range(60)]
    model = toxicity.train(texts, np.array([i % 3 == 0 for i in range(60)], int), window=3, warm=3, rounds=5)
    for text in [*texts[:12], "", "12 !!", "x", "é ü", "one TWO three four five zxQwving six"]:
        raw = text.encode()
        got = model.scores(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0]
        assert got == pytest.approx(plain_toxicity(model, text), abs=1e-4), text


def test_toxicity_gradients_are_those_of_the_loss(monkeypatch):
    """One step of training moves every number against the numeric derivative of the mean cross-entropy."""
    texts, y = ["ab cd", "cd ef gh", "ab ab", ""], np.array([1, 0, 1, 0])
    monkeypatch.setattr(toxicity, "BITS", 6)
    monkeypatch.setattr(toxicity, "DECAY", 0.0)
    before = toxicity.train(texts, y, window=9, warm=0, rounds=0)
    after = toxicity.train(texts, y, window=9, warm=1, rounds=0)

    def loss(model):
        return -sum(np.log(p if k else 1 - p) for p, k in ((plain_toxicity(model, t), k) for t, k in zip(texts, y)))

    for name in ("emb", "soft", "bias"):
        x = getattr(before, name)
        for at in np.ndindex(x.shape):
            x[at] += 1e-5
            up = loss(before)
            x[at] -= 2e-5
            slope = (up - loss(before)) / 2e-5
            x[at] += 1e-5
            if abs(slope) > 1e-3:
                assert np.sign(slope) == -np.sign(getattr(after, name)[at] - x[at])


def test_documents_with_contradicting_labels_teach_nothing(spark, corpus):
    docs, labels = corpus
    twice = labels.unionByName(labels.filter("doc_id < 100").withColumn("toxic", 1 - F.col("toxic")))
    assert toxicity.training_rows(docs, twice).count() == toxicity.training_rows(docs, labels.filter("doc_id >= 100")).count()


def test_language_of_documents(spark, corpus, folder):
    got = {r["doc_id"]: r for r in language.op8_language(spark, folder).collect()}
    assert len(got) == 600 + len(ODD) and all(r["held_out"] == held(i, 5, 0) for i, r in got.items())
    truth = {r["doc_id"]: r["lang"] for r in corpus[0].filter("lang is not null").collect()}
    assert all(got[i]["lang_pred"] == y for i, y in truth.items() if got[i]["held_out"])
    assert [got[1000 + i]["lang_pred"] == "und" for i in range(len(ODD))] == [t is None or not any(c.isalpha() for c in t) for t in ODD]


def test_code_switched_words_and_lanes(monkeypatch):
    rng = np.random.default_rng(2)
    texts = [(sentence(rng, k), k) for k in ("aa", "bb") for _ in range(60)]
    model = language.train([t for t, _ in texts], [k for _, k in texts], epochs=30)
    text = sentence(rng, "aa", 25) + " " + sentence(rng, "bb", 300) + " " + sentence(rng, "aa", 25)
    raw = np.frombuffer(text.encode(), np.uint8)
    words = Words(raw, np.array([0, len(raw)]))
    scores = model.emissions(words)
    post = language.posteriors(scores, words.doc, model.step, model.start)
    label = [model.langs[i] for i in post.argmax(1)]
    assert label == ["aa"] * 25 + ["bb"] * 300 + ["aa"] * 25
    assert model.documents(raw, np.array([0, len(raw)]))[1].tolist() == [2]
    # the exact chain in one lane
    emit = np.exp(scores - scores.max(1, keepdims=True))[:, None]
    ahead, back = language.chain(emit, np.exp(model.step), np.exp(model.start))
    exact = (ahead * back)[:, 0]
    assert np.allclose(post, exact / exact.sum(1, keepdims=True), atol=1e-3)


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(3)
    emit, step, start = rng.random((5, 1, 3)) + 0.1, rng.random((3, 3)) + 0.1, rng.random(3) + 0.1
    total = np.zeros((5, 3))
    for path in np.ndindex(*[3] * 5):
        p = start[path[0]] * np.prod([emit[t, 0, k] for t, k in enumerate(path)]) * np.prod([step[a, b] for a, b in zip(path, path[1:])])
        for t, k in enumerate(path):
            total[t, k] += p
    ahead, back = language.chain(emit, step, start)
    post = (ahead * back)[:, 0]
    assert np.allclose(post / post.sum(1, keepdims=True), total / total.sum(1, keepdims=True))


def test_language_with_nothing_to_learn(spark, corpus):
    docs = corpus[0].withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in language.identify(docs, language.fit(docs)).collect()} == {"und"}


def test_quality_and_its_sites(spark, corpus, folder):
    docs, labels = corpus
    got = {r["doc_id"]: r for r in quality.op6_quality(spark, folder).collect()}
    truth = {r["doc_id"]: r["quality"] for r in labels.filter("quality is not null").collect()}
    assert len(got) == 600 + len(ODD) and all(got[i]["accepted"] == bool(y) for i, y in truth.items() if got[i]["held_out"])
    kept = quality.accepted(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r["accepted"] for r in got.values())
    assert quality.judged(docs.limit(0), quality.fit(docs, labels)).count() == 0
    assert all(r["evidence"] == 0 for r in quality.judged(docs, quality.fit(docs, labels.limit(0))).select(F.col("evidence")).limit(20).collect())


def test_sparse_sites_shrink_toward_their_host_and_the_whole(spark):
    n = [("big", "a", 1.0)] * 300 + [("big", "b", -1.0)] * 2 + [("bad", "a", -1.0)] * 300 + [("new", "a", -1.0)]
    rows = spark.createDataFrame([(i, h, p, e) for i, (h, p, e) in enumerate(n)], "doc_id long, h string, p string, e double").withColumn("text", F.when(F.col("e") > 0, "Fine words stand here.").otherwise("BAD!!"))
    y = np.array([e for _, _, e in n]) > 0
    raw = [t.encode() for t in np.where(y, "Fine words stand here.", "BAD!!")]
    offs = np.concatenate(([0], np.cumsum([len(r) for r in raw])))
    model = quality.train(quality.surface(np.frombuffer(b"".join(raw), np.uint8), offs), y.astype(float), y.mean())
    found = {(r["h"], r["p"]): r["site"] for r in quality.judged(rows.withColumns({"source": F.lit("s"), "lang": F.lit("l")}), model, F.col("h"), F.col("p")).collect()}
    assert found["bad", "a"] < 0.2 < found["new", "a"] < found["big", "b"] < found["big", "a"]


def test_hash_sample(spark):
    df = spark.range(20000).selectExpr("id", "if(id % 10 = 0, 'few', 'many') as k")
    sizes = {r["k"]: r["count"] for r in hash_sample(df, "k", "id", 1000).groupBy("k").count().collect()}
    assert abs(sizes["few"] - 1000) < 150 and abs(sizes["many"] - 1000) < 150
    assert hash_sample(df.limit(0), "k", "id", 5).count() == 0


def test_too_many_keys_raise_and_repeated_ids_stay_bounded(spark):
    with pytest.raises(ValueError):
        hash_sample(spark.range(3000).selectExpr("id", "id as k"), "k", "id", 5)
    same = spark.range(50_000).selectExpr("1L as id", "'a' as k")
    assert hash_sample(same, "k", "id", 100).count() <= 1400


def test_empty_tables_of_the_models(spark, corpus):
    docs, labels = corpus
    none = docs.limit(0)
    assert language.identify(none, language.fit(docs.limit(40))).count() == 0
    assert {r["lang_pred"] for r in language.identify(docs, language.fit(none)).collect()} == {"und"}
    assert quality.judged(none, quality.fit(none, labels.limit(0))).count() == 0
    assert toxicity.score(none, toxicity.fit(none, labels.limit(0))).count() == 0


def test_quality_equals_a_plain_version(spark, corpus):
    """Sites, strengths and probabilities by the formulas of the docstring, over rows in memory."""
    docs, labels = corpus
    model = quality.fit(docs, labels)
    rows = quality.with_evidence(docs.select("doc_id", "text", "lang", "source"), model).toPandas()
    host = rows.source.fillna("").str.split("/").str[0]
    rest = rows.source.fillna("").str.split("/", n=1).str[1]
    path = rest.where(rest.notna() & (rest != ""), rows.lang).fillna("")
    e = np.floor(rows.evidence.abs().to_numpy() * 10 + 0.5) * np.sign(rows.evidence.to_numpy()) / 10  # halves away from zero
    share = min(max(model.share, 1e-3), 1 - 1e-3)
    for _ in range(100):
        share = float(np.clip((1 / (1 + np.exp(-(e + np.log(share / (1 - share)))))).mean(), 1e-3, 1 - 1e-3))
    p = 1 / (1 + np.exp(-(e + np.log(share / (1 - share)))))

    def strength(n, s, center):
        if len(n) < 2:
            return 1e3
        v = (n * center * (1 - center)).sum() / n.sum()
        room = n.sum() - (n * n).sum() / n.sum()
        tau = ((n * (s / n - center) ** 2).sum() - (len(n) - 1) * v) / room if room > 0 else 0.0
        return float(min(1e4, max(2.0, v / tau - 1))) if tau > 1e-9 else 1e4

    import pandas as pd

    t = pd.DataFrame({"h": host, "p": path, "s": p, "n": 1})
    hosts, paths = t.groupby("h")[["s", "n"]].sum(), t.groupby(["h", "p"])[["s", "n"]].sum().reset_index()
    k1 = strength(hosts.n, hosts.s, share)
    above = paths.join(hosts, on="h", rsuffix="h")
    k2 = strength(paths.n, paths.s, (above.sh + k1 * share) / (above.nh + k1))
    hs, hn = hosts.s[t.h].to_numpy(), hosts.n[t.h].to_numpy()
    own = t.merge(paths, on=["h", "p"], suffixes=("", "p"))
    up = (hs - p + k1 * share) / (hn - 1 + k1)
    site = (own.sp.to_numpy() - p + k2 * up) / (own.np.to_numpy() - 1 + k2)
    clipped = np.clip(site, 1e-4, 1 - 1e-4)
    want = 1 / (1 + np.exp(-(rows.evidence.to_numpy() + np.log(clipped / (1 - clipped)))))
    got = quality.judged(docs, model).toPandas().set_index("doc_id")
    assert got.probability[rows.doc_id].to_numpy() == pytest.approx(want, abs=1e-6) and got.site[rows.doc_id].to_numpy() == pytest.approx(site, abs=1e-6)


def test_many_sites_are_joined_by_salted_keys(spark, monkeypatch):
    monkeypatch.setattr(quality, "HOT_ROWS", 20)
    monkeypatch.setattr(quality, "SALTS", 5)
    rows = spark.range(200).selectExpr("id", "if(id % 3 = 0, 'hot', concat('h', id % 40)) as _host", "'p' as _path", "if(id % 7 = 0, null, concat('t', id)) as text")
    sites = rows.groupBy("_host", "_path").agg(F.count("*").alias("n"))
    few = quality.with_sites(rows, sites).collect()
    many = quality.with_sites(rows, sites, most=1).select(*rows.columns, "n").collect()
    key = lambda r: r["id"]
    assert [(r["id"], r["n"]) for r in sorted(few, key=key)] == [(r["id"], r["n"]) for r in sorted(many, key=key)] and len(many) == 200


def test_language_equals_the_chain_of_a_whole_text(spark):
    rng = np.random.default_rng(12)
    texts = [(sentence(rng, k), k) for k in ("aa", "bb") for _ in range(40)]
    model = language.train([t for t, _ in texts], [k for _, k in texts], epochs=20)
    mixed = [sentence(rng, "aa", 9) + " " + sentence(rng, "bb", 14), sentence(rng, "bb", 5), sentence(rng, "aa", 60)]
    got = {r["doc_id"]: r for r in language.identify(spark.createDataFrame(list(enumerate(mixed)), "doc_id long, text string"), model).collect()}
    for i, t in enumerate(mixed):
        raw = np.frombuffer(t.encode(), np.uint8)
        scores = model.emissions(Words(raw, np.array([0, len(raw)])))
        ahead, back = language.chain(np.exp(scores - scores.max(1, keepdims=True))[:, None], np.exp(model.step), np.exp(model.start))
        post = (ahead * back)[:, 0]
        share = (post / post.sum(1, keepdims=True)).mean(0)
        assert got[i]["lang_pred"] == model.langs[share.argmax()] and got[i]["score"] == pytest.approx(share.max(), abs=1e-3)
