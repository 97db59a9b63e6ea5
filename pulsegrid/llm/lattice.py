"""Lloyd clustering of integer vectors whose nearest centroids are found by equal-average equal-variance search.

Centroids stand sorted by their sums of components. A vector meets them outward from its own sum, nearer side first. With
n components, n times the squared distance is at least the squared difference of the sums, and at least that plus the
squared difference of the roots of n times the sum of squares less the squared sum; what either bound rejects isn't
looked at, and what remains is measured in whole numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

#: Components are below this in magnitude, so that sums of squares of 64 fit 64 bits with room to spare.
LARGEST = 1 << 26
#: Numbers that all centroids may have together: they go to every task.
MOST_NUMBERS = 4_000_000


def whole_vectors(table_: DataFrame, size: int, id_col: str, column: str, scale: int) -> DataFrame:
    """(id, v): floor(scale * x) of every component x of vectors with ``size`` components, none of them null or not
    finite; other rows are left out. A result of LARGEST or more in magnitude is an error."""
    x = F.col(f"`{column}`")
    wrong = F.exists(x, lambda a: a.isNull() | F.isnan(a) | (F.abs(a.cast("double")) == float("inf")))
    good = table_.filter((F.size(x) == size) & ~wrong)
    floor = F.transform(x, lambda a: F.floor(F.lit(float(scale)) * a.cast("double")))
    fits = F.forall(floor, lambda a: F.abs(a) < LARGEST)
    return good.select(F.col(f"`{id_col}`").alias("id"), F.when(fits, floor).otherwise(F.raise_error(F.lit("a component is too large"))).cast("array<int>").alias("v"))


class Searcher:
    """Nearest of ``centroids`` (k, n), whole numbers, by exact squared distance; of equals the one with the lowest row."""

    def __init__(self, centroids: np.ndarray):
        self.sums = centroids.sum(1)
        self.order = np.lexsort((np.arange(len(centroids)), self.sums))
        self.centroids, self.sums = centroids[self.order], self.sums[self.order]
        self.spread = self._spread(self.centroids, self.sums)
        self.measured = 0

    @staticmethod
    def _spread(x: np.ndarray, sums: np.ndarray) -> np.ndarray:
        """The root of n sum(x^2) - sum(x)^2, as a float."""
        return np.sqrt(np.maximum(x.shape[1] * (x.astype(float) ** 2).sum(1) - sums.astype(float) ** 2, 0))

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, squared distance) for each vector."""
        n, k = x.shape[1], len(self.order)
        sums = x.sum(1)
        spread = self._spread(x, sums)
        # what floats may be off by: a bound counts only if it exceeds by more
        slack = 1e-9 * (n * (x.astype(float) ** 2).sum(1) + n * max(1.0, float((self.centroids.astype(float) ** 2).sum(1).max(initial=0))))
        high = np.searchsorted(self.sums, sums)
        low = high - 1
        label, best = np.full(len(x), -1), np.full(len(x), np.iinfo(np.int64).max)
        live = np.arange(len(x))
        for _ in range(k):
            lo, hi = low[live], high[live]
            below = np.where(lo >= 0, sums[live] - self.sums[np.maximum(lo, 0)], np.iinfo(np.int64).max)
            above = np.where(hi < k, self.sums[np.minimum(hi, k - 1)] - sums[live], np.iinfo(np.int64).max)
            down = below <= above
            c, gap = np.where(down, lo, hi), np.where(down, below, above).astype(float)
            low[live[down]] -= 1
            high[live[~down]] += 1
            # farther ones have no smaller gap, so a vector that the first bound rejects is done
            limit = np.where(label[live] >= 0, n * best[live].astype(float) + slack[live], np.inf)
            near = gap * gap <= limit
            live, c, gap, limit = live[near], c[near], gap[near], limit[near]
            both = gap * gap + (spread[live] - self.spread[c]) ** 2
            some = both <= limit
            at, c = live[some], c[some]
            d = x[at] - self.centroids[c]
            d = (d * d).sum(1)
            self.measured += len(at)
            row = self.order[c]
            better = (d < best[at]) | ((d == best[at]) & (row < label[at]))
            label[at[better]], best[at[better]] = row[better], d[better]
            if not len(live):
                break
        return label, best


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), size)


def assigned(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(id, cluster, distance) of every vector (id, v)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Searcher(centroids)
        for b in batches:
            label, d = search.nearest(_matrix(b.column(1), centroids.shape[1]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(label.astype(np.int32)), pa.array(d)], names=["id", "cluster", "distance"])

    return vectors.select("id", "v").mapInArrow(run, f"id {dict(vectors.dtypes)['id']}, cluster int, distance long")


def cluster_sums(vectors: DataFrame, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(count, sums) of the vectors nearest to each centroid; a task sends a row for each cluster that it has met, and the
    driver gets as many numbers as the centroids have."""
    k, n = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, count, total = Searcher(centroids), np.zeros(k, np.int64), np.zeros((k, n), np.int64)
        for b in batches:
            x = _matrix(b.column(0), n)
            label = search.nearest(x)[0]
            order = np.argsort(label, kind="stable")
            met, first = np.unique(label[order], return_index=True)
            if len(met):
                total[met] += np.add.reduceat(x[order], first)
                count[met] += np.diff(np.append(first, len(order)))
        on = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(on.astype(np.int32)), pa.array(count[on]), pa.array(total[on].tolist(), pa.list_(pa.int64()))], names=["cluster", "n", "s"])

    parts = vectors.select("v").mapInArrow(run, "cluster int, n long, s array<long>")
    added = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("s")[i]) for i in range(n))).alias("s")) if n <= 256 else None
    if added is None:  # wide vectors: a row a component
        long = parts.select("cluster", "n", F.posexplode("s").alias("pos", "x")).groupBy("cluster", "pos").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
        added = long.groupBy("cluster").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"]).alias("s"))
    count, total = np.zeros(k, np.int64), np.zeros((k, n), np.int64)
    for r in added.collect():
        count[r["cluster"]], total[r["cluster"]] = r["n"], r["s"]
    return count, total


def first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors whose "seed:id" has the least SHA-256, in its order (of equal ids the lesser vector first; null
    ids come last); fewer if there are fewer vectors."""
    key = F.coalesce(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary"), 256), F.lit("~"))
    rows = vectors.select(key.alias("key"), "v").orderBy("key", "v").limit(k).collect()
    return np.array([r["v"] for r in rows], np.int64)


def lloyd(vectors: DataFrame, centroids: np.ndarray, rounds: int) -> np.ndarray:
    """``rounds`` times: every vector to its nearest centroid, every centroid that has some to the floor of their mean."""
    if centroids.size > MOST_NUMBERS:
        raise ValueError(f"centroids of more than {MOST_NUMBERS} numbers")
    for _ in range(rounds):
        count, total = cluster_sums(vectors, centroids)
        moved = np.where(count[:, None] > 0, total // np.maximum(count, 1)[:, None], centroids)
        if (moved == centroids).all():
            break  # the rounds that are left change nothing
        centroids = moved
    return centroids


def clustered(vectors: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector (id, v): its cluster after
    ``rounds`` of Lloyd's algorithm and a last assignment, its squared distance, these summed over its cluster and over
    all vectors, and the hash of its centroid.

    Repeated rows are rows like others, null ids stay, an empty table gives no rows, and other columns are ignored. Tasks
    hold one batch and the centroids; a hot cluster is summed where its vectors are.
    """
    spark = vectors.sparkSession
    rows = cut(vectors.select("id", "v"))  # all rounds read the whole numbers
    centroids = first_centroids(rows, k, seed)
    if not len(centroids):
        return rows.select("id", F.lit(0).alias("cluster"), *(F.lit(0).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")), F.lit("").alias("centroid_sha256"))
    centroids = lloyd(rows, centroids, rounds)
    found = cut(assigned(rows, centroids))
    inertia = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(19,0)")).alias("s")).collect()}
    every = sum(inertia.values())
    names = [(c, s, every, hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, s in inertia.items()]
    about = spark.createDataFrame(names, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(about), "cluster").select("id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows


def op12_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = whole_vectors(table(spark, sf_dir, "embeddings"), 64, "vec_id", "embedding", 1024)
    return clustered(vectors, k=8, rounds=10, seed=3).withColumnRenamed("id", "vec_id")


def _rounds(rounds: int) -> str:
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""d{i} AS (SELECT q.rid, c.cluster, CAST(sum((q.x - c.x) * (q.x - c.x)) AS BIGINT) AS distance FROM q JOIN c{i} c ON c.pos = q.pos GROUP BY q.rid, c.cluster),
a{i} AS MATERIALIZED (SELECT rid, cluster, distance FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY distance, cluster) AS r FROM d{i}) WHERE r = 1)""")
        if i < rounds:
            steps.append(f"""m{i} AS (SELECT a.cluster, q.pos, CAST(sum(q.x) AS BIGINT) AS s, count(*) AS n FROM a{i} a JOIN q ON q.rid = a.rid GROUP BY a.cluster, q.pos),
c{i + 1} AS MATERIALIZED (SELECT c.cluster, c.pos, CASE WHEN m.n IS NULL THEN c.x ELSE (m.s - ((m.s % m.n) + m.n) % m.n) // m.n END AS x FROM c{i} c LEFT JOIN m{i} m ON m.cluster = c.cluster AND m.pos = c.pos)""")
    return ",\n".join(steps)


OP12_SQL = f"""WITH kept AS (SELECT vec_id, embedding, row_number() OVER (ORDER BY vec_id) AS rid FROM embeddings
    WHERE len(embedding) = 64 AND list_bool_and(list_transform(embedding, lambda e: e IS NOT NULL AND isfinite(e)))),
q AS MATERIALIZED (SELECT rid, CAST(i AS INTEGER) AS pos, CAST(floor(1024 * CAST(embedding[i] AS DOUBLE)) AS BIGINT) AS x FROM kept, range(1, 65) r(i)),
seeds AS (SELECT rid, row_number() OVER (ORDER BY sha256('3:' || CAST(vec_id AS VARCHAR)), rid) - 1 AS cluster FROM kept),
c0 AS MATERIALIZED (SELECT CAST(s.cluster AS INTEGER) AS cluster, q.pos, q.x FROM seeds s JOIN q ON q.rid = s.rid WHERE s.cluster < 8),
{_rounds(10)},
names AS (SELECT cluster, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY pos)) AS centroid_sha256 FROM c10 GROUP BY cluster),
sums AS (SELECT cluster, CAST(sum(distance) AS BIGINT) AS cluster_inertia FROM a10 GROUP BY cluster)
SELECT k.vec_id, a.cluster, a.distance, s.cluster_inertia, (SELECT CAST(sum(distance) AS BIGINT) FROM a10) AS inertia, n.centroid_sha256
FROM a10 a JOIN kept k ON k.rid = a.rid JOIN names n ON n.cluster = a.cluster JOIN sums s ON s.cluster = a.cluster"""
