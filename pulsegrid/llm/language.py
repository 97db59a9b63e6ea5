"""Language identification by a linear-chain conditional random field over words.

A word's features are its hashed affixes (n-grams that touch an end), inner n-grams and itself as a lexicon entry; the
transitions between the languages of successive words are learned with them. Forward-backward gives every word's
posterior in code-switched text; a document's language is the one with the largest sum of posteriors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix, small_batches, span_hashes, table, text_slices
from .subwords import Words, hash_sample, remainder

BITS, SIZES = 17, (2, 4)
#: The model is fitted on about so many documents of all languages together, each of at most so many characters.
SAMPLE_ROWS, SAMPLE_CHARS = 1600, 20_000
#: Sequences of so many words are made of pieces of the sampled documents, switching language now and then; the fit sees
#: EPOCHS times the sample's words, or SAMPLE_WORDS if it has more.
SEQUENCE, EPOCHS, SAMPLE_WORDS = 40, 3, 240_000
#: Chains are run side by side in lanes of CORE words with HALO words of context on either side.
CORE, HALO = 96, 16


@dataclass
class Model:
    langs: list[str]
    weight: np.ndarray  # (buckets, langs)
    step: np.ndarray  # (langs, langs): transition from row to column
    start: np.ndarray

    def emissions(self, words: Words) -> np.ndarray:
        out = np.zeros((words.n, len(self.langs)))
        for word, bucket in features(words):
            if len(word):
                heads = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
                out[word[heads]] += np.add.reduceat(self.weight[bucket], heads, axis=0)
        return out

    def documents(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(documents, langs): the posteriors' means; documents: how often successive words differ in language."""
        words = Words(buf, offs)
        sums, switches = np.zeros((words.docs, len(self.langs))), np.zeros(words.docs, np.int64)
        if words.n:
            post = posteriors(self.emissions(words), words.doc, self.step, self.start)
            heads = np.flatnonzero(np.concatenate(([True], words.doc[1:] != words.doc[:-1])))
            counts = np.diff(np.append(heads, words.n))
            sums[words.doc[heads]] = np.add.reduceat(post, heads, axis=0) / counts[:, None]
            best = post.argmax(1)
            change = (best[1:] != best[:-1]) & (words.doc[1:] == words.doc[:-1])
            switches = np.bincount(words.doc[1:][change], minlength=words.docs)
        return sums, switches


def features(words: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word number, bucket) of every feature, by word: the n-grams of each size, then the words themselves."""
    yield from words.grams(*SIZES, BITS)
    whole = mix(span_hashes(words.out, words.starts, words.ends)) >> np.uint64(64 - BITS)
    yield np.arange(words.n), whole.astype(np.int64)


def chain(emit: np.ndarray, step: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scaled forward and backward messages of chains that run side by side: ``emit`` is (time, chain, langs), of
    factors, not logarithms."""
    time, lanes, langs = emit.shape
    ahead, back = np.empty_like(emit), np.empty_like(emit)
    a = start * emit[0]
    ahead[0] = a / a.sum(1, keepdims=True)
    for t in range(1, time):
        a = (ahead[t - 1] @ step) * emit[t]
        ahead[t] = a / a.sum(1, keepdims=True)
    back[-1] = 1
    for t in range(time - 2, -1, -1):
        b = (emit[t + 1] * back[t + 1]) @ step.T
        back[t] = b / b.sum(1, keepdims=True)
    return ahead, back


def _factors(scores: np.ndarray) -> np.ndarray:
    return np.exp(np.clip(scores - scores.max(-1, keepdims=True), -30, 0))


def posteriors(scores: np.ndarray, doc: np.ndarray, step: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Each word's posterior over the languages. A long document takes several lanes, whose context words overlap: a
    factor of every word's own and HALO transitions stand between a word and what its lane doesn't see."""
    n = len(scores)
    first = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
    size = np.diff(np.append(first, n))
    lanes = -(-size // CORE)
    which = np.repeat(np.arange(len(first)), lanes)
    core = first[which] + (np.arange(len(which)) - np.repeat(np.cumsum(lanes) - lanes, lanes)) * CORE
    begin = np.maximum(core - HALO, first[which])
    end = np.minimum(core + CORE + HALO, (first + size)[which])
    width = int((end - begin).max())
    at = begin[:, None] + np.arange(width)
    inside = at < end[:, None]
    emit = _factors(scores)[np.where(inside, at, 0)]
    emit[~inside] = 1
    ahead, back = chain(np.ascontiguousarray(emit.transpose(1, 0, 2)), np.exp(step), np.exp(start))
    post = (ahead * back).transpose(1, 0, 2)
    post /= post.sum(2, keepdims=True)
    own = inside & (at >= core[:, None]) & (at < np.minimum(core + CORE, end)[:, None])
    out = np.empty_like(scores)
    out[at[own]] = post[own]
    return out


def train(texts: list[str], labels: list[str], epochs: int = EPOCHS, rate: float = 0.4, seed: int = 1) -> Model | None:
    """Maximum likelihood by Adagrad over code-switched sequences cut from the texts. None without any usable text."""
    langs = sorted(set(labels))
    pieces: list[tuple[int, list[np.ndarray]]] = []
    for text, lang in zip(texts, labels, strict=True):
        raw = np.frombuffer(text.encode(), np.uint8)
        words = Words(raw, np.array([0, len(raw)]))
        if not words.n:
            continue
        found = [f for f in features(words)]
        word, bucket = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
        order = np.argsort(word, kind="stable")
        rows = np.split(bucket[order], np.flatnonzero(np.diff(word[order])) + 1)
        pieces.append((langs.index(lang), rows))
    if not pieces:
        return None
    rng = np.random.default_rng(seed)
    weight, step, start = np.zeros((1 << BITS, len(langs))), np.zeros((len(langs),) * 2), np.zeros(len(langs))
    seen = [np.full_like(x, 1e-6) for x in (weight, step, start)]
    by_lang = [[p for p, (lang, _) in enumerate(pieces) if lang == k] for k in range(len(langs))]
    with_text = [k for k in range(len(langs)) if by_lang[k]]
    batch = 64
    rounds = max(1, epochs * min(sum(len(r) for _, r in pieces), SAMPLE_WORDS) // (SEQUENCE * batch))
    eye = np.eye(len(langs))
    for _ in range(rounds):
        gold = np.zeros((SEQUENCE, batch), np.int64)
        cells: list[np.ndarray] = [None] * (SEQUENCE * batch)
        for s in range(batch):
            t = 0
            while t < SEQUENCE:
                k = with_text[rng.integers(len(with_text))]
                rows = pieces[by_lang[k][rng.integers(len(by_lang[k]))]][1]
                length = min(int(rng.geometric(1 / 20)), len(rows), SEQUENCE - t)
                at = int(rng.integers(len(rows) - length + 1))
                for i in range(length):
                    gold[t + i, s] = k
                    cells[(t + i) * batch + s] = rows[at + i]
                t += length
        flat, sizes = np.concatenate(cells), np.array([len(c) for c in cells])
        owner = np.repeat(np.arange(len(cells)), sizes)
        scores = np.add.reduceat(weight[flat], np.cumsum(sizes) - sizes, axis=0).reshape(SEQUENCE, batch, -1)
        emit = _factors(scores)
        ahead, back = chain(emit, np.exp(step), np.exp(start))
        post = ahead * back
        post /= post.sum(2, keepdims=True)
        pair = ahead[:-1, :, :, None] * np.exp(step) * (emit[1:] * back[1:])[:, :, None, :]
        pair /= pair.sum((2, 3), keepdims=True)
        miss = (eye[gold] - post).reshape(-1, len(langs))
        up_weight = np.zeros_like(weight)
        np.add.at(up_weight, flat, miss[owner])
        up_step = (eye[gold[:-1]][..., :, None] * eye[gold[1:]][..., None, :] - pair).sum((0, 1))
        for value, up, total in ((weight, up_weight, seen[0]), (step, up_step, seen[1]), (start, (eye[gold[0]] - post[0]).sum(0), seen[2])):
            up = up / batch
            total += up * up
            value += rate * up / np.sqrt(total)
        weight *= 0.9995
        np.clip(step, -6, 6, out=step)
        np.clip(start, -6, 6, out=start)
    return Model(langs, weight.astype(np.float32), step, start)


def fit(docs: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> Model | None:
    """Learns from the bounded sample of documents with a lang whose crc32(doc_id) mod 5 is not 0."""
    own = docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("text").cast("string")).filter(remainder("doc_id", 5) != 0).filter("text is not null")
    own = own.filter(F.char_length("text") <= chars)
    few = own.filter("lang is not null").select("lang").distinct().count()  # hash_sample raises if they are too many
    sample = hash_sample(own, "lang", "doc_id", max(20, rows // max(few, 1))).select("text", "lang").orderBy(F.xxhash64("text", "lang")).toArrow()
    return train(sample.column("text").to_pylist(), sample.column("lang").to_pylist())


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, lang_pred, score, shares, switches) for every row of ``docs`` (doc_id, text; other columns are ignored):
    shares maps each language to its mean posterior, switches counts changes of language between successive words.

    Null and empty texts, and texts without a letter, are ``und`` with score 0; so is everything if there was nothing to
    learn from. Very long texts count with all their words. Of tied languages the first by name is taken. Repeated rows
    are judged alike, a null doc_id is judged like others. Empty tables give no rows.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2 MB for four languages, whatever the input
    langs = model.langs if model else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shares, switches = np.zeros((b.num_rows, len(langs))), np.zeros(b.num_rows, np.int64)
            if langs:
                for i, j, buf, offs in text_slices(b.column(1)):
                    shares[i:j], switches[i:j] = shared.value.documents(buf, offs)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * len(langs)), pa.array(shares.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), lists, pa.array(switches)], names=["doc_id", "lettered", "p", "switches"])

    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    frame = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), lettered.alias("lettered"))
    found = frame.mapInArrow(run, "doc_id long, lettered boolean, p array<double>, switches long")
    if not langs:
        return found.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("map<string,double>").alias("shares"), "switches")
    names, top = F.array(*map(F.lit, langs)), F.array_max("p")
    best = F.element_at(names, F.array_position("p", top).cast("int"))
    return found.select(
        "doc_id",
        F.when(F.col("lettered"), best).otherwise("und").alias("lang_pred"),
        F.when(F.col("lettered"), F.least(top, F.lit(1.0))).otherwise(0.0).alias("score"),
        F.map_from_arrays(names, "p").alias("shares"),
        "switches",
    )


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs.select("doc_id", "text"), fit(docs))
    return found.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")
