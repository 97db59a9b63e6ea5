"""Benchmark decontamination by latent semantic retrieval.

1. Document frequencies of the benchmark's words are counted over the whole corpus; frequent words weigh nothing.
2. A distributed randomised SVD of the benchmark's TF-IDF passages gives a latent space.
3. Every window of every document that has enough weight is projected there, and compared by cosine with all passages.
4. Regions around the hits are held against the whole item: longest common subsequence of all words and of the weighty
   ones, and, where that leaves doubt, the item's answer (its last sentence).
5. Of an item with several passages, every window is also held against the passage it hit: a quote is a leak too.

The benchmark is taken in blocks of about BLOCK items and PASSAGES passages at most, and items of more than ITEM_WORDS
words in parts, so that what a task holds is bounded; the latent space of a block has a dimension for each passage, up
to RANK. Frequencies are counted for all blocks in one pass over the corpus, and one pass searches it for as many blocks
as INDEX_BYTES hold.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_broadcast, cut, filtered, give_back, small_batches, span_hashes, table, text_slices, word_spans
from .subwords import FOLD

BLOCK, PASSAGES, RANK, POWER = 256, 512, 1024, 2
#: Words of an item that is taken whole, bytes of the indexes that a pass carries, and words of a whole benchmark.
ITEM_WORDS, INDEX_BYTES, MOST_TERMS = 4096, 128 << 20, 8_000_000
#: Windows gather so many bytes of an index's basis at a time, or a single window's rows.
GATHER_BYTES = 4 << 20
#: A passage that keeps less than this share of its norm in the latent space is found by weight alone, not by cosine.
RETAINED = 0.9
#: Words of a passage and of a window of a document, and how far apart they begin.
PASSAGE, WINDOW, STRIDE = 32, 48, 16
#: Words that more than this share of the documents have weigh nothing.
COMMON = 0.03
#: A window needs this share of a passage's weight and this cosine to be looked at.
MASS, COSINE = 0.35, 0.4
#: A common subsequence of at least SURE of an item's words is a leak; from DOUBT on, it is one if the answer is there.
SURE, DOUBT, ANSWER = 0.6, 0.45, 0.5
#: So many words of a passage, in order in one window, with SURE of its weighty ones, are a leak of the item: 32 words
#: running of an item share at least 24 with one of its passages.
QUOTE = 24

NOT_LETTER = FOLD == 0


def hashed_words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of letters, A-Z as a-z, and their documents."""
    starts, ends, doc = word_spans(buf, offs, NOT_LETTER)
    return span_hashes(buf, starts, ends, folded=True), doc


def words_of(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode(), np.uint8)
    return hashed_words(raw, np.array([0, len(raw)]))[0]


class Terms:
    """Positions of known words: most others are turned away by one look at a table of bits."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.unique(hashes)
        self.gate = np.zeros(1 << 20, bool)
        self.gate[(self.hashes >> np.uint64(44)).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(self.gate[(h >> np.uint64(44)).astype(np.int64)])
        if not len(self.hashes) or not len(at):
            return at[:0], at[:0]
        k = np.minimum(np.searchsorted(self.hashes, h[at]), len(self.hashes) - 1)
        true = self.hashes[k] == h[at]
        return at[true], k[true]


def common_length(a: np.ndarray, b: np.ndarray) -> int:
    """The length of the longest common subsequence, a bit for each word of ``a``."""
    where: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        where[x] = where.get(x, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for x in b.tolist():
        m = where.get(x)
        if m:
            u = row & m
            row = ((row + u) | (row - u)) & full
    return len(a) - row.bit_count()


@dataclass
class Index:
    """A block of the benchmark. Passages by row; ``item`` is each passage's place in ``ids`` and ``words``, ``quotes`` its
    words and weighty words, if its item has others."""

    ids: list[int]
    words: list[np.ndarray]
    heavy: list[np.ndarray]
    answers: list[np.ndarray]
    terms: Terms
    weight: np.ndarray
    basis: np.ndarray
    item: np.ndarray
    quotes: list[tuple[np.ndarray, np.ndarray] | None]
    mass: np.ndarray
    latent: np.ndarray
    faint: np.ndarray

    @property
    def size(self) -> int:
        return self.basis.nbytes + self.latent.nbytes + 64 * len(self.weight)

    def hits(self, h: np.ndarray, doc: np.ndarray) -> list[tuple[int, int, float, float, bool]]:
        """(document, place of the item, LCS share, cosine, answer there) of every leak in these words."""
        at, term = self.terms.find(h)
        if not len(at) or not len(self.item):
            return []
        first = np.searchsorted(doc, np.arange(doc[-1] + 2))
        # windows that begin every STRIDE words of each document, only those with a known word
        own = at - first[doc[at]]
        k = own // STRIDE
        reach = -(-WINDOW // STRIDE)
        start = np.unique(np.concatenate([first[doc[at]] + np.maximum(k - d, 0) * STRIDE for d in range(reach)]))
        stop = np.minimum(start + WINDOW, first[doc[start] + 1])
        lo, hi = np.searchsorted(at, start), np.searchsorted(at, stop)
        sums = np.concatenate(([0], np.cumsum(self.weight[term] ** 2)))
        some = sums[hi] - sums[lo] >= MASS * self.mass.min()
        start, stop, lo, hi = start[some], stop[some], lo[some], hi[some]
        room = GATHER_BYTES // (self.basis.itemsize * max(self.basis.shape[1], 1))
        found: dict[tuple[int, int], list[tuple[int, int, float, int]]] = {}
        for i in range(0, len(start), 512):
            s, e = lo[i : i + 512], hi[i : i + 512]
            size = e - s
            rows = np.repeat(np.arange(len(s)), size)
            cells = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(s, size)
            t = term[cells]
            pair, count = np.unique(rows * len(self.weight) + t, return_counts=True)
            rows, t = pair // len(self.weight), pair % len(self.weight)
            w = self.weight[t] * (1 + np.log(count))
            z = np.zeros((len(s), self.basis.shape[1]), np.float32)
            heads = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
            own, tails, w = rows[heads], np.append(heads[1:], len(rows)), w.astype(np.float32)
            x = 0
            while x < len(heads):  # windows full of known words would gather the basis many times over
                y = max(x + 1, int(np.searchsorted(tails, heads[x] + room, "right")))
                a, b = heads[x], tails[y - 1]
                z[own[x:y]] = np.add.reduceat(w[a:b, None] * self.basis[t[a:b]], heads[x:y] - a, axis=0)
                x = y
            mass = np.bincount(rows, self.weight[t] ** 2, minlength=len(s))
            z /= np.maximum(np.sqrt((z * z).sum(1, keepdims=True)), np.float32(1e-12))
            cos = z @ self.latent.T
            for r, p in zip(*np.nonzero(((cos >= COSINE) | self.faint) & (mass[:, None] >= MASS * self.mass)), strict=True):
                found.setdefault((int(doc[start[i + r]]), int(self.item[p])), []).append((int(start[i + r]), int(stop[i + r]), float(cos[r, p]), int(p)))
        out = []
        for (d, j), spans in found.items():
            best = None
            for begin, end, cos in self._regions(spans, len(self.words[j]), int(first[d]), int(first[d + 1])):
                got = self._compare(h[begin:end], j)
                if got and (best is None or got[0] > best[0]):
                    best = (got[0], cos, got[1])
            if best is None:
                best = max(((got, cos, False) for begin, end, cos, p in spans if (got := self._quoted(h[begin:end], p))), default=None)
            if best:
                out.append((d, j, *best))
        return out

    @staticmethod
    def _regions(spans: list[tuple[int, int, float, int]], length: int, first: int, last: int) -> list[tuple[int, int, float]]:
        """Windows widened by the item's length; those that overlap are one region, with the best cosine."""
        out: list[tuple[int, int, float]] = []
        for begin, end, cos, _ in sorted(spans):
            begin, end = max(first, begin - length), min(last, end + length)
            if out and begin <= out[-1][1]:
                out[-1] = (out[-1][0], max(end, out[-1][1]), max(cos, out[-1][2]))
            else:
                out.append((begin, end, cos))
        return out

    def _compare(self, region: np.ndarray, j: int) -> tuple[float, bool] | None:
        words, heavy = self.words[j], self.heavy[j]
        there = np.isin(heavy, region)
        if there.sum() < DOUBT * len(heavy):
            return None
        share = common_length(words, region) / len(words)
        if len(heavy):
            share = min(share, common_length(heavy, region) / len(heavy))
        if share < DOUBT:
            return None
        answer = self.answers[j]
        told = bool(np.isin(answer, region).mean() >= ANSWER) if len(answer) else True
        return (share, told) if share >= SURE or told else None

    def _quoted(self, window: np.ndarray, p: int) -> float | None:
        if self.quotes[p] is None:
            return None
        words, heavy = self.quotes[p]
        if np.isin(words, window).sum() < QUOTE or common_length(heavy, window) < SURE * len(heavy):
            return None
        n = common_length(words, window)
        return n / len(words) if n >= QUOTE else None


def _answer(text: str) -> str:
    """The last sentence with at least three words; else the text."""
    for part in reversed(re.split(r"(?<=[.?!])\s+", text.strip())):
        if len(part.split()) >= 3:
            return part
    return text


def frequencies(docs: DataFrame, hashes: np.ndarray) -> tuple[np.ndarray, int]:
    """In how many documents each of these words (ascending hashes) stands, and the number of documents. Each task sends
    one row of counts."""
    small_batches(docs.sparkSession)
    known = docs.sparkSession.sparkContext.broadcast(Terms(hashes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = known.value
        count, rows = np.zeros(len(terms.hashes), np.int64), 0
        for b in batches:
            rows += b.num_rows
            for _, _, buf, offs in text_slices(b.column(0)):
                h, doc = hashed_words(buf, offs)
                at, k = terms.find(h)
                pair = np.unique(doc[at] * len(terms.hashes) + k)
                count += np.bincount(pair % max(len(terms.hashes), 1), minlength=len(count))[: len(count)]
        term = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(term, -1)), pa.array(np.append(count[term], rows))], names=["term", "n"])

    got = docs.select(F.col("text").cast("string")).mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(len(hashes), np.int64)
    own = got["term"] >= 0
    df[got["term"][own]] = got["n"][own]
    return df, int(got["n"][~own].sum())


def item_parts(items: DataFrame) -> DataFrame:
    """(item_id, text, last) of items (item_id, text): each text whole, or in parts of ITEM_WORDS words. Null ids and texts
    and texts without letters are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts, last = [], [], []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                raw = np.frombuffer(text.encode(), np.uint8)
                starts = word_spans(raw, np.array([0, len(raw)]), NOT_LETTER)[0]
                if not len(starts):
                    continue
                cuts = [0, *starts[ITEM_WORDS::ITEM_WORDS].tolist(), len(raw)]
                ids += [i] * (len(cuts) - 1)
                texts += [raw[x:y].tobytes().decode() for x, y in zip(cuts, cuts[1:])]
                last += [False] * (len(cuts) - 2) + [True]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.string()), pa.array(last, pa.bool_())], names=["item_id", "text", "last"])

    return items.filter("item_id is not null and text is not null").select("item_id", "text").mapInArrow(run, "item_id long, text string, last boolean")


def all_words(items: DataFrame) -> np.ndarray:
    """The hashes of the benchmark's different words, ascending."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = [np.zeros(0, np.uint64), *(hashed_words(buf, offs)[0] for _, _, buf, offs in text_slices(b.column(0)))]
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(h)).view(np.int64))], names=["h"])

    found = items.select("text").mapInArrow(run, "h long").distinct().limit(MOST_TERMS + 1).toArrow().column("h")
    if len(found) > MOST_TERMS:
        raise ValueError(f"a benchmark of more than {MOST_TERMS} different words must be taken in several")
    return np.sort(found.to_numpy().view(np.uint64))


def passages(words: np.ndarray) -> list[np.ndarray]:
    starts = range(0, max(1, len(words) - PASSAGE + STRIDE), STRIDE)
    return [words[s : s + PASSAGE] for s in starts]


def passage_rows(terms: Terms, weight: np.ndarray, words: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(terms, TF-IDF) of each passage of an item."""
    out = []
    for p in passages(words):
        t, n = np.unique(terms.find(p)[1], return_counts=True)
        out.append((t, weight[t] * (1 + np.log(n))))
    return out


def passage_count(items: DataFrame) -> int:
    """The number of passages of all items (item_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = sum(len(passages(words_of(text or ""))) for b in batches for text in b.column(0).to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    return items.select("text").mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


def randomised_svd(block: DataFrame, terms: Terms, weight: np.ndarray, rank: int = RANK, power: int = POWER, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The leading right singular vectors (terms, rank) and singular values of the TF-IDF matrix of the block's passages:
    each task multiplies its passages' rows with the current basis and sends the products of the terms that it has, which
    are summed by chunks of terms."""
    spark, n = block.sparkSession, len(weight)
    rng = np.random.default_rng(seed)
    basis = np.linalg.qr(rng.normal(size=(n, min(rank, n))))[0]
    chunk = 32
    know = spark.sparkContext.broadcast((terms, weight))

    def product(current: np.ndarray) -> np.ndarray:
        now = spark.sparkContext.broadcast(current)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            (t, w), q = know.value, now.value
            total, there = np.zeros_like(q), np.zeros(len(q), bool)
            for b in batches:
                for text in b.column(0).to_pylist():
                    for own, a in passage_rows(t, w, words_of(text or "")):
                        total[own] += np.outer(a, a @ q[own])
                        there[own] = True
            k = np.flatnonzero(there)
            parts = np.split(k, np.flatnonzero(np.diff(k // chunk)) + 1) if len(k) else []
            yield pa.RecordBatch.from_arrays([pa.array([int(p[0]) // chunk * chunk for p in parts], pa.int64()), pa.array([p.tobytes() for p in parts], pa.binary()), pa.array([total[p].tobytes() for p in parts], pa.binary())], names=["first", "terms", "part"])

        def add(t: pa.Table) -> pa.Table:
            total, first = np.zeros((chunk, width)), t.column(0)[0].as_py()
            for own, part in zip(t.column(1), t.column(2), strict=True):  # no copies: there is a part for each task
                total[np.frombuffer(own.as_buffer(), np.int64) - first] += np.frombuffer(part.as_buffer()).reshape(-1, width)
            return pa.table({"first": t.column(0)[:1], "part": pa.array([total.tobytes()], pa.binary())})

        width = current.shape[1]
        sums = block.select("text").mapInArrow(run, "first long, terms binary, part binary").groupBy("first").applyInArrow(add, "first long, part binary").toArrow()
        out = np.zeros((-(-n // chunk) * chunk, width))
        for first, part in zip(sums.column("first").to_pylist(), sums.column("part"), strict=True):
            out[first : first + chunk] = np.frombuffer(part.as_buffer()).reshape(chunk, width)
        return out[:n]

    for _ in range(power):
        basis = np.linalg.qr(product(basis))[0]
    small = basis.T @ product(basis)
    values, turn = np.linalg.eigh((small + small.T) / 2)
    keep = values > 1e-9 * max(values.max(), 1e-12)
    return (basis @ turn)[:, keep][:, ::-1], np.sqrt(values[keep][::-1])


def build_index(docs: DataFrame, block: DataFrame, counted: tuple[np.ndarray, np.ndarray, int] | None = None) -> Index | None:
    """The index of one block (item_id, text, and last if there are parts) of the benchmark. Items without letters are left
    out. ``counted``: words of the whole benchmark, their frequencies in ``docs``, and the documents; else counted here."""
    ends = "last" in block.columns
    rows = sorted({(r["item_id"], r["text"], r["last"] if ends else True) for r in block.collect() if r["text"] is not None and r["item_id"] is not None})
    rows = [(i, t, w, last) for i, t, last in rows if len(w := words_of(t))]
    if not rows:
        return None
    hashes = np.unique(np.concatenate([w for _, _, w, _ in rows]))
    known, df, total = (hashes, *frequencies(docs, hashes)) if counted is None else counted
    df = df[np.searchsorted(known, hashes)]
    weight = np.log((total + 1) / (df + 1.0))
    # the rarer half of every item's words stays, however often the item itself has leaked
    heavy = df <= max(COMMON * total, 1)
    for _, _, w, _ in rows:
        k = np.unique(np.searchsorted(hashes, w))
        heavy[k[np.argsort(df[k], kind="stable")[: -(-len(k) // 2)]]] = True
    hashes, weight = hashes[heavy], np.maximum(weight[heavy], 0.1)
    terms = Terms(hashes)
    rank = min(RANK, sum(len(passages(w)) for _, _, w, _ in rows))
    basis, _ = randomised_svd(block.filter("text is not null and item_id is not null"), terms, weight, rank)
    item, quotes, mass, norm, latent = [], [], [], [], []
    for j, (_, _, w, _) in enumerate(rows):
        parts = passages(w)
        for part, (t, a) in zip(parts, passage_rows(terms, weight, w), strict=True):
            if len(t):
                item.append(j)
                quotes.append((part, part[terms.find(part)[0]]) if len(parts) > 1 and len(part) >= QUOTE else None)
                mass.append(float((weight[t] ** 2).sum()))
                norm.append(float(np.sqrt(a @ a)))
                latent.append(a @ basis[t])
    latent = np.array(latent)
    kept = np.sqrt((latent * latent).sum(1))
    latent /= np.maximum(kept[:, None], 1e-12)
    heavy_words = [w[terms.find(w)[0]] for _, _, w, _ in rows]
    answers = []
    for _, t, _, last in rows:
        if not last:  # a part that isn't the end has no answer that could settle a doubt
            answers.append(np.zeros(1, np.uint64))
            continue
        a = words_of(_answer(t))
        own = a[terms.find(a)[0]]
        answers.append(np.unique(own if len(own) else a))
    return Index([i for i, _, _, _ in rows], [w for _, _, w, _ in rows], heavy_words, answers, terms, weight, basis.astype(np.float32), np.array(item), quotes, np.array(mass), latent.astype(np.float32), kept < RETAINED * np.array(norm))


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` with leaked_items (array<long>, ascending), leak_share (double: the best LCS share of an item, or of
    a passage where only that is quoted; 0 without a leak) and leaked (boolean) appended (columns of these names are
    replaced).

    Null and empty texts leak nothing, and null or letterless items are left out; items of equal texts are all named, and
    so are the ties of a document that leaks several. Very long documents are searched whole; an item of more than
    ITEM_WORDS words leaks if a part does. Repeated rows are searched each. Empty tables give no rows, or no leaks. No row
    is moved: the index goes to the documents.
    """
    plain = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c not in ("leaked_items", "leak_share", "leaked")))
    items = cut(item_parts(benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).dropDuplicates()))
    blocks = max(1, -(-items.count() // BLOCK), -(-passage_count(items) // PASSAGES))
    found = plain.withColumns({"leaked_items": F.array().cast("array<long>"), "leak_share": F.lit(0.0)})
    small_batches(docs.sparkSession)
    words = all_words(items)
    counted = (words, *frequencies(docs, words))
    groups = _groups(docs, items, blocks, counted)
    first = next(groups, None)
    second = next(groups, None) if first else None
    if first and second is None:
        found = _searched(found, first)
    elif first:
        found = _searched_apart(found, chain([first, second], groups))
    return found.withColumn("leaked_items", F.array_sort(F.array_distinct("leaked_items"))).withColumn("leaked", F.size("leaked_items") > 0)


def _groups(docs: DataFrame, items: DataFrame, blocks: int, counted: tuple[np.ndarray, np.ndarray, int]) -> Iterator[list[Index]]:
    """The indexes of all blocks, as many together as INDEX_BYTES hold."""
    carried: list[Index] = []
    for k in range(blocks):
        index = build_index(docs, items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k), counted)
        if index is None:
            continue
        if carried and sum(i.size for i in (*carried, index)) > INDEX_BYTES:
            yield carried
            carried = []
        carried.append(index)
    if carried:
        yield carried


def _searched_apart(found: DataFrame, groups: Iterator[list[Index]]) -> DataFrame:
    """One job for each group of indexes over the texts alone, whose hits are written down; so no task ever has more than
    one group. Equal texts have equal hits, which come back to the rows by the texts' digests."""
    digest = F.unhex(F.sha2(F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "UTF-8"), 256))
    texts = found.select(digest.alias("digest"), "text", "leaked_items", "leak_share")
    hits = None
    for group in groups:
        own = cut(_searched(texts, group).filter(F.size("leaked_items") > 0).select("digest", "leaked_items", "leak_share"))
        hits = own if hits is None else hits.unionByName(own)
    one = hits.groupBy("digest").agg(F.array_distinct(F.flatten(F.collect_set("leaked_items"))).alias("items"), F.max("leak_share").alias("share"))
    one = bounded_broadcast(cut(one), 1_000_000, F.size("items") * 8 + 48)
    put = {"leaked_items": F.coalesce("items", "own_items"), "leak_share": F.coalesce("share", "own_share")}
    own = {"leaked_items": "own_items", "leak_share": "own_share"}
    names = {c: own.get(c, f"own{i}") for i, c in enumerate(found.columns)}  # none of them clashes
    rows = found.select(digest.alias("digest"), *(F.col(f"`{c}`").alias(n) for c, n in names.items())).join(one, "digest", "left")
    return rows.select(*(put.get(c, F.col(n)).alias(c) for c, n in names.items()))


def _searched(found: DataFrame, indexes: list[Index]) -> DataFrame:
    """One pass over ``found`` that adds what these indexes hit."""
    shared = found.sparkSession.sparkContext.broadcast(indexes)  # about INDEX_BYTES
    at, items, share = (found.columns.index(c) for c in ("text", "leaked_items", "leak_share"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists, best = b.column(items).to_pylist(), b.column(share).to_pylist()
            for i, _, buf, offs in text_slices(b.column(at).cast(pa.string())):
                h, doc = hashed_words(buf, offs)
                for index in shared.value if len(h) else ():
                    for d, j, lcs, _, _ in index.hits(h, doc):
                        lists[i + d] = [*lists[i + d], index.ids[j]]
                        best[i + d] = max(best[i + d], lcs)
            own = list(b.columns)
            own[items], own[share] = pa.array(lists, pa.list_(pa.int64())), pa.array(best, pa.float64())
            yield pa.RecordBatch.from_arrays(own, names=b.schema.names)
        give_back()

    return found.mapInArrow(run, found.schema)


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows and columns of ``docs`` that leak no item."""
    return filtered(docs, lambda d: leaks(d, benchmark), "not leaked")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return leaks(docs, table(spark, sf_dir, "benchmark")).select("doc_id", "leaked", "leaked_items", "leak_share")
