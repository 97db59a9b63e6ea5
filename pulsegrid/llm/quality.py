"""Document quality by hierarchical empirical Bayes.

A logistic classifier turns each text's surface into a log likelihood ratio. Hosts, and paths within hosts, get
posterior shares of good documents from grouped sums: sparse paths shrink toward their host, sparse hosts toward the
global share, each by a strength estimated from how much sites differ. The document's odds are the product.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, bounded_broadcast, cut, filtered, give_back, small_batches, span_hashes, table, text_slices, word_spans
from .subwords import hash_sample, remainder

#: The classifier is fitted on at most about so many labelled rows of each class.
SAMPLE_ROWS = 3000
#: A document is rejected if its probability of being good is below this.
THRESHOLD = 0.5
FEATURES = 16
#: A site of more rows is dealt to SALTS tasks where sites are too many to broadcast.
HOT_ROWS, SALTS = 1_000_000, 256
#: One document never tells more than this about itself, as a logarithm of odds.
LIMIT = 12.0

_UPPER, _LOWER, _DIGIT, _MARK, _BANG = (np.zeros(256, np.int8) for _ in range(5))
_UPPER[65:91] = _LOWER[97:123] = _DIGIT[48:58] = 1
_LOWER[128:] = 1
for _c in b"#$%&*|=<>{}[]~^_@\\/+":
    _MARK[_c] = 1
for _c in b"!?":
    _BANG[_c] = 1


def _by_doc(flag: np.ndarray, offs: np.ndarray) -> np.ndarray:
    sums = np.concatenate(([0], np.cumsum(flag, dtype=np.int64)))
    return sums[offs[1:]] - sums[offs[:-1]]


def _repeated(keys: np.ndarray, owner: np.ndarray, docs: int) -> np.ndarray:
    """The share of each document's keys that it has had before."""
    order = np.lexsort((keys, owner))
    k, o = keys[order], owner[order]
    again = np.zeros(len(k), bool)
    again[1:] = (k[1:] == k[:-1]) & (o[1:] == o[:-1])
    return np.bincount(o[again], minlength=docs) / np.maximum(np.bincount(owner, minlength=docs), 1)


def surface(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """(documents, FEATURES): what the characters, words and lines of the texts look like; zeros for empty texts."""
    docs = len(offs) - 1
    size = np.maximum(np.diff(offs), 1)
    starts, ends, doc = word_spans(buf, offs)
    words = np.bincount(doc, minlength=docs)
    many = np.maximum(words, 1)
    h = span_hashes(buf, starts, ends)
    length = ends - starts
    newline = np.zeros(256, bool)
    newline[10] = True
    ls, le, ldoc = word_spans(buf, offs, newline)
    lines = np.maximum(np.bincount(ldoc, minlength=docs), 1)
    upper, lower, digit, mark, bang = (_by_doc(t[buf], offs) for t in (_UPPER, _LOWER, _DIGIT, _MARK, _BANG))
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    odd_end = (_MARK[buf[ends - 1]] | _BANG[buf[ends - 1]]).astype(bool) if len(ends) else np.zeros(0, bool)
    span = np.bincount(doc, length, minlength=docs) / many
    spread = np.sqrt(np.maximum(np.bincount(doc, length.astype(float) ** 2, minlength=docs) / many - span**2, 0))
    return np.column_stack(
        [
            upper / np.maximum(upper + lower, 1), digit / size, np.sqrt(mark / size), np.sqrt(bang / size),
            np.bincount(doc[odd_end], minlength=docs) / many, np.bincount(doc[same], minlength=docs) / many,
            _repeated(h, doc, docs), _repeated(span_hashes(buf, ls, le), ldoc, docs),
            span / 10, spread / 10, np.bincount(doc[length > 20], minlength=docs) / many,
            np.bincount(doc[length == 1], minlength=docs) / many, np.log1p(words), np.log1p(words / lines),
            (words == 0).astype(float), np.log1p(words) ** 2 / 10,
        ]
    )


@dataclass
class Model:
    mean: np.ndarray
    sd: np.ndarray
    weight: np.ndarray  # the last is the bias, less the logarithm of the sample's own odds
    share: float

    def evidence(self, x: np.ndarray) -> np.ndarray:
        return np.clip(((x - self.mean) / self.sd) @ self.weight[:-1] + self.weight[-1], -LIMIT, LIMIT)


def train(x: np.ndarray, y: np.ndarray, share: float, ridge: float = 1.0) -> Model:
    """Ridge logistic regression by Newton's method; no evidence at all if
    there is one label only."""
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(FEATURES), np.ones(FEATURES), np.zeros(FEATURES + 1), share)
    mean, sd = x.mean(0), x.std(0)
    sd[sd < 1e-9] = 1
    z = np.column_stack([(x - mean) / sd, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w)), z.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    w[-1] -= np.log(y.mean() / (1 - y.mean()))
    return Model(mean, sd, w, share)


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """Learns from labelled rows (quality 0 or 1) whose crc32(doc_id) mod 4 is not 2; only the sampled texts' features
    come to the driver."""
    own = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int")).filter("quality in (0, 1)").filter(remainder("doc_id", 4) != 2)
    # a document of which labels differ teaches nothing
    own = own.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other")).filter("quality = other").drop("other")
    share = own.agg(F.avg("quality")).first()[0]
    picked = hash_sample(own, "quality", "doc_id", rows)
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [surface(buf, offs) for _, _, buf, offs in text_slices(b.column(1))]
            x = np.concatenate(x) if x else np.zeros((0, FEATURES))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * FEATURES), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), lists], names=["y", "x"])

    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(picked), "doc_id").limit(8 * rows + 1000)  # at most so many labels, also if one doc_id has any number of texts
    sample = texts.select("quality", "text").mapInArrow(run, "y int, x array<double>").toPandas()
    x = np.array(sample["x"].tolist(), float).reshape(-1, FEATURES)
    order = np.lexsort(x.T)  # sums in an order of their own
    return train(x[order], sample["y"].to_numpy(float)[order], 0.5 if share is None else float(share))


def with_evidence(docs: DataFrame, model: Model, name: str = "evidence") -> DataFrame:
    """``docs`` with the classifier's log likelihood ratio of good to bad appended; 0 for null and empty texts counts
    through their features, which are zeros."""
    small_batches(docs.sparkSession)
    keep = [c for c in docs.columns if c != name]
    frame = docs.select(*(F.col(f"`{c}`") for c in keep))
    at = keep.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            e = [model.evidence(surface(buf, offs)) for _, _, buf, offs in text_slices(b.column(at).cast(pa.string()))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate(e) if e else np.zeros(0))], names=[*b.schema.names, name])
        give_back()

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema.fields)
    return frame.mapInArrow(run, f"{schema}, {name} double")


def _sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def _logit(p: Column) -> Column:
    p = F.greatest(F.lit(1e-4), F.least(F.lit(1 - 1e-4), p))
    return F.log(p / (1 - p))


def _global_share(cells: DataFrame, start: float) -> float:
    """The share of good documents in all rows, by expectation maximisation over the evidence's histogram."""
    bins = cells.groupBy("b").agg(F.sum("n").alias("n")).orderBy("b").toPandas()  # at most 241 rows
    e, n, share = bins["b"].to_numpy(float) / 10, bins["n"].to_numpy(float), min(max(start, 1e-3), 1 - 1e-3)
    for _ in range(100 if len(e) else 0):
        p = 1 / (1 + np.exp(-(e + np.log(share / (1 - share)))))
        share = float(np.clip((p * n).sum() / n.sum(), 1e-3, 1 - 1e-3))
    return share


def _strength(groups: DataFrame, center: Column) -> float:
    """How many documents the prior of a level is worth: from the variance between groups (n, s) that their sizes
    don't explain."""
    mean = F.col("s") / F.col("n")
    v = center * (1 - center)
    r = groups.agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.sum(F.col("n") * (mean - center) ** 2).alias("q"), F.sum(F.col("n") * v).alias("v")).first()
    if not r["n"] or r["k"] < 2:
        return 1e3
    v = r["v"] / r["n"]
    room = r["n"] - r["nn"] / r["n"]
    tau = (r["q"] - (r["k"] - 1) * v) / room if room > 0 else 0.0
    return float(min(1e4, max(2.0, v / tau - 1))) if tau > 1e-9 else 1e4


def source_host() -> Column:
    """What a document's source names up to the first slash."""
    return F.substring_index(F.coalesce(F.col("source"), F.lit("")), "/", 1)


def source_path() -> Column:
    """The rest of the source, or else the host's section in the document's language."""
    rest = F.regexp_extract(F.coalesce(F.col("source"), F.lit("")), "^[^/]*/(.+)$", 1)
    return F.coalesce(F.nullif(rest, F.lit("")), F.col("lang"), F.lit(""))


def with_sites(rows: DataFrame, sites: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``rows`` joined with ``sites`` on _host and _path: a small table goes to the rows; a larger one is shuffled with
    them, sites of more than HOT_ROWS rows SALTS times, so that their rows can be dealt to as many tasks."""
    if sites.limit(most + 1).count() <= most:
        return rows.join(F.broadcast(sites), ["_host", "_path"])
    salted = sites.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.when(F.col("n") > HOT_ROWS, SALTS - 1).otherwise(0))))
    hot = bounded_broadcast(cut(sites.filter(F.col("n") > HOT_ROWS).select("_host", "_path", F.lit(SALTS).alias("_salts"))))
    salt = F.coalesce(F.pmod(F.monotonically_increasing_id(), F.col("_salts").cast("long")), F.lit(0)).cast("int")  # copies are dealt too
    return rows.join(hot, ["_host", "_path"], "left").withColumn("_salt", salt).drop("_salts").join(salted, ["_host", "_path", "_salt"]).drop("_salt")


def judged(docs: DataFrame, model: Model, host: Column | None = None, path: Column | None = None) -> DataFrame:
    """``docs`` with evidence, site (the posterior share of good documents at the row's path, without the row itself),
    probability and accepted appended (columns of these names are replaced).

    Null sources and languages are sites of their own. Null and empty texts are judged by their features, zeros, like
    others; very long texts by those of the whole. Rows of equal texts and sites are judged alike, and repeated rows count
    as rows each. A probability of exactly THRESHOLD is accepted. Empty tables give no rows. Sites are aggregated before
    any shuffle; their table is broadcast if it is small, else the evidence is joined with the sites by salted keys, so
    that a hot site is many tasks.
    """
    plain = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c not in ("evidence", "site", "probability", "accepted", "_host", "_path")))
    keyed = plain.withColumns({"_host": source_host() if host is None else host, "_path": source_path() if path is None else path})
    light = with_evidence(keyed.select("_host", "_path", "text"), model).drop("text")
    cells = cut(light.groupBy("_host", "_path", F.round(F.col("evidence") * 10).alias("b")).agg(F.count("*").alias("n")))
    share = _global_share(cells, model.share)
    offset = float(np.log(share / (1 - share)))
    paths = cells.groupBy("_host", "_path").agg(F.sum("n").alias("n"), F.sum(F.col("n") * _sigmoid(F.col("b") / 10 + offset)).alias("s"))
    paths = cut(paths)
    hosts = paths.groupBy("_host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    k1 = _strength(hosts, F.lit(share))
    hosts = cut(hosts.select("_host", F.col("n").alias("hn"), F.col("s").alias("hs")))
    nested = paths.join(hosts, "_host")
    k2 = _strength(nested, (F.col("hs") + k1 * share) / (F.col("hn") + k1))
    rows = with_sites(with_evidence(keyed, model), cut(nested))
    own = _sigmoid(F.round(F.col("evidence") * 10) / 10 + offset)
    above = (F.col("hs") - own + k1 * share) / (F.col("hn") - 1 + k1)
    site = (F.col("s") - own + k2 * above) / (F.col("n") - 1 + k2)
    rows = rows.withColumn("site", site).withColumn("probability", _sigmoid(F.col("evidence") + _logit(F.col("site"))))
    return rows.withColumn("accepted", F.col("probability") >= THRESHOLD).select(*(F.col(f"`{c}`") for c in plain.columns), "evidence", "site", "probability", "accepted")


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows and columns of ``docs`` that the classifier accepts."""
    model = fit(docs, labels)
    return filtered(docs, lambda d: judged(d, model), "accepted")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = judged(docs.select("doc_id", "text", "source", "lang"), fit(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "evidence", "site", "probability", "accepted")
