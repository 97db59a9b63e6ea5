"""Toxicity by a bag of subwords: embeddings of hashed character n-grams, averaged, into a linear softmax.

A misspelling nobody has seen shares most n-grams, and so most of its vector, with the word it comes from. Insults are
short and texts may be long, so the averages are taken over every window of WINDOW successive words (and over the whole
text, if it has fewer), and a document scores what the softmax says of its worst window. Embeddings and softmax are
trained jointly, in numpy, on a bounded sample of labelled rows: first on averages of whole documents, then on the
windows that score highest under the model so far.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import runs, small_batches, span_hashes, table, text_slices
from .subwords import Words, hash_sample, remainder

BITS, DIM, SIZES, WINDOW = 18, 8, (3, 6), 8
#: The model is fitted on at most about so many rows of each label, of texts of at most so many characters.
SAMPLE_ROWS, SAMPLE_CHARS = 2500, 20_000
#: Rounds over whole documents and over worst windows, the step of both, and the pull of embeddings to 0.
WARM, ROUNDS, STEP, DECAY = 10, 40, 0.3, 1e-5
THRESHOLD = 0.3


@dataclass
class Scorer:
    value: np.ndarray
    bias: float
    window: int

    def scores(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        words = Words(buf, offs)
        top = strongest(*word_sums(words, self.value), words.doc, words.docs, self.window)[0]
        return probability(top, self.bias)


@dataclass
class Model:
    """``emb``: (buckets, DIM); ``soft``: (2, DIM) and ``bias``: (2,) of the softmax, row 1 for toxic."""

    emb: np.ndarray
    soft: np.ndarray
    bias: np.ndarray
    window: int = WINDOW

    def scorer(self) -> Scorer:
        """What scoring needs: a softmax of two is a logistic of the difference of its logits, and that is linear in each
        bucket's embedding."""
        return Scorer((self.emb @ (self.soft[1] - self.soft[0])).astype(np.float32), float(self.bias[1] - self.bias[0]), self.window)

    def scores(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        return self.scorer().scores(buf, offs)


def probability(top: np.ndarray, bias: float) -> np.ndarray:
    """The softmax's second share; a text without words has the bias alone."""
    return 1 / (1 + np.exp(-np.clip(top + bias, -30, 30)))


def word_sums(words: Words, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    total, count = np.zeros(words.n), np.zeros(words.n)
    for word, bucket in words.grams(*SIZES, BITS):
        total += np.bincount(word, value[bucket], minlength=words.n)
        count += np.bincount(word, minlength=words.n)
    return total, count


def strongest(total: np.ndarray, count: np.ndarray, doc: np.ndarray, docs: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each document's highest average over ``window`` successive words (all of them, if there are fewer), and that window's
    first word and the word after its last; of equal ones the first. 0, -1 and -1 for documents without words."""
    best, at, to = np.zeros(docs), np.full(docs, -1), np.full(docs, -1)
    n = len(total)
    if n:
        first = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
        size = np.diff(np.append(first, n))
        stop = np.repeat(first + size, size)
        begin = np.maximum(np.minimum(np.arange(n), stop - window), np.repeat(first, size))
        end = np.minimum(begin + window, stop)
        s, c = np.concatenate(([0], np.cumsum(total))), np.concatenate(([0], np.cumsum(count)))
        mean = (s[end] - s[begin]) / np.maximum(c[end] - c[begin], 1)
        top = np.maximum.reduceat(mean, first)
        hit = np.flatnonzero(mean >= np.repeat(top, size))[::-1]
        best[doc[first]] = top
        at[doc[hit]], to[doc[hit]] = begin[hit], end[hit]
    return best, at, to


class Sample:
    """The different words of some texts with their n-grams, and the texts as rows of word numbers."""

    def __init__(self, texts: list[str]):
        hashes, docs, lengths, letters = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [b""]
        for i, _, buf, offs in text_slices(pa.array(texts, pa.string())):
            w = Words(buf, offs)
            hashes.append(span_hashes(w.out, w.starts, w.ends))
            docs.append(w.doc + i)
            lengths.append(w.ends - w.starts)
            letters.append(w.out[runs(w.starts, w.ends - w.starts)].tobytes())
        self.doc, length = np.concatenate(docs), np.concatenate(lengths)
        _, first, self.word = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
        own = length[first]
        spelt = np.full(own.sum() + len(own), 32, np.uint8)
        spelt[runs(np.cumsum(own + 1) - own - 1, own)] = np.frombuffer(b"".join(letters), np.uint8)[runs((np.cumsum(length) - length)[first], own)]
        words = Words(spelt, np.array([0, len(spelt)]))
        grams = list(words.grams(*SIZES, BITS)) if len(own) else []
        word, bucket = (np.concatenate([g[i] for g in grams]) if grams else np.zeros(0, np.int64) for i in range(2))
        order = np.argsort(word, kind="stable")
        self.owner, self.bucket = word[order], bucket[order]
        self.count = np.bincount(word, minlength=len(own))
        self.at = np.cumsum(self.count) - self.count


def train(texts: list[str], labels: np.ndarray, window: int = WINDOW, warm: int = WARM, rounds: int = ROUNDS, seed: int = 1) -> Model:
    """The joint fit, by whole-batch gradients with steps scaled by each number's own history. With one label only, every
    score is that label's."""
    y = np.asarray(labels, np.int64)
    rng = np.random.default_rng(seed)
    emb, soft, bias = rng.normal(0, 0.05, (1 << BITS, DIM)), rng.normal(0, 0.5, (2, DIM)), np.zeros(2)
    if not len(y) or y.min() == y.max():
        return Model(emb * 0, soft, np.array([0.0, 30.0 if len(y) and y[0] else -30.0]), window)
    data = Sample(texts)
    docs = len(texts)
    bias[1] = np.log(y.mean() / (1 - y.mean()))
    past = [np.full_like(emb, 1e-8), np.full_like(soft, 1e-8), np.full_like(bias, 1e-8)]
    some = np.bincount(data.doc, minlength=docs) > 0
    bounds = np.searchsorted(data.doc, np.arange(docs + 1))
    occurs = data.count[data.word]
    used = np.unique(data.bucket)
    for turn in range(warm + rounds):
        begin, end = bounds[:-1], bounds[1:]
        if turn >= warm:
            value = emb @ (soft[1] - soft[0])
            total = np.bincount(data.owner, value[data.bucket], minlength=len(data.count))[data.word]
            _, begin, end = strongest(total, occurs, data.doc, docs, window)
        size = np.where(some, end - begin, 0)
        word, row = data.word[runs(np.where(some, begin, 0), size)], np.repeat(np.arange(docs), size)
        grams = np.maximum(np.bincount(row, data.count[word], minlength=docs), 1)
        # each window's mean vector, by the sums of the words that are there
        there, word = np.unique(word, return_inverse=True)
        owner, bucket = np.repeat(np.arange(len(there)), data.count[there]), data.bucket[runs(data.at[there], data.count[there])]
        vectors = np.stack([np.bincount(owner, emb[bucket, d], minlength=len(there)) for d in range(DIM)], 1)
        mean = np.stack([np.bincount(row, vectors[word, d], minlength=docs) for d in range(DIM)], 1) / grams[:, None]
        z = mean @ soft.T + bias
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(docs), y] -= 1
        back = (p @ soft) / grams[:, None]
        push = np.stack([np.bincount(bucket, np.bincount(word, back[row, d], minlength=len(there))[owner], minlength=1 << BITS) for d in range(DIM)], 1)
        for x, g, h in ((emb, push + DECAY * docs * emb, past[0]), (soft, p.T @ mean, past[1]), (bias, p.sum(0), past[2])):
            h += g * g
            x -= STEP * g / np.sqrt(h)
    seen = np.zeros(1 << BITS, bool)
    seen[used] = True
    emb[~seen] = 0  # n-grams of no labelled text say nothing
    return Model(emb, soft, bias, window)


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> DataFrame:
    """(text, toxic): the bounded sample of labelled rows whose crc32(doc_id) mod 4 is not 2. Null labels and texts are
    left out, and so are longer texts than ``chars``."""
    own = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int")).filter("toxic in (0, 1)").filter(remainder("doc_id", 4) != 2)
    # a document of which labels differ teaches nothing
    own = own.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("other")).filter("toxic = other").drop("other")
    picked = hash_sample(own, "toxic", "doc_id", rows)
    texts = docs.select(F.col("doc_id").cast("long"), "text").filter(F.char_length("text") <= chars)
    found = texts.join(F.broadcast(picked), "doc_id").select("text", "toxic").filter("text is not null")  # at most 8 * rows + 1,000 rows
    return found.limit(8 * rows + 1000).orderBy(F.xxhash64("text", "toxic"))  # also if one doc_id has any number of texts


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    sample = training_rows(docs, labels, rows).toArrow()
    return train(sample.column("text").to_pylist(), np.array(sample.column("toxic").to_pylist(), np.int64))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) for every row of ``docs`` (doc_id, text; other columns are ignored).

    Null and empty texts, and texts without letters, get the score of the softmax's bias alone. Very long texts are
    scored whole. Repeated rows score alike; of equally bad windows it doesn't matter which counts. A null doc_id is
    scored like others. Empty tables give no rows.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model.scorer())  # 1 MB, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [shared.value.scores(buf, offs) for _, _, buf, offs in text_slices(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(parts) if parts else np.zeros(0))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
