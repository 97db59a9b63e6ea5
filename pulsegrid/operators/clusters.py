"""Operators over labelled feature vectors: (id, label, f) with f an array of doubles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Centroids that may be compared with every row.
MOST_CENTROIDS = 10_000


def dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm_squared(a: str | Column) -> Column:
    return dot(a, a)


def normalised(a: str) -> Column:
    """The vector of length 1; a zero vector stays."""
    n = F.sqrt(norm_squared(a))
    return F.transform(a, lambda v: F.when(n > 0, v / n).otherwise(v))


def projected(f: str, direction: str) -> Column:
    """The coordinate along a direction."""
    return dot(f, normalised(direction))


def centroids(vectors: DataFrame) -> DataFrame:
    """(label, pos, mean)."""
    return vectors.select("label", F.posexplode("f").alias("pos", "v")).groupBy("label", F.col("pos").cast("long").alias("pos")).agg(F.avg(F.col("v").cast("double")).alias("mean"))


def label_rows(vectors: DataFrame) -> DataFrame:
    """(label, place, id): each label's rows in the order of their ids, from place 0."""
    w = Window.partitionBy("label").orderBy("id")
    return vectors.select("label", (F.row_number().over(w) - 1).cast("long").alias("place"), "id")


def moved_centroids(vectors: DataFrame, moves: DataFrame) -> DataFrame:
    """(label, pos, mean) after the rows of ``moves`` (id, label) have gone to other labels: only they are added up again,
    and taken from and given to the sums of the labels they leave and join. A label that loses all rows has no mean."""
    def sums(rows: DataFrame, sign: int) -> DataFrame:
        return rows.select("label", F.posexplode("f").alias("pos", "v")).select("label", F.col("pos").cast("long").alias("pos"), (F.col("v").cast("double") * sign).alias("s"), F.lit(sign).alias("n"))

    went = vectors.join(moves.withColumnRenamed("label", "_new"), "id").filter("label <> _new")
    every = sums(vectors, 1).groupBy("label", "pos").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    change = sums(went, -1).unionByName(sums(went.drop("label").withColumnRenamed("_new", "label"), 1)).groupBy("label", "pos").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    total = every.unionByName(change).groupBy("label", "pos").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    return total.filter("n > 0").select("label", "pos", (F.col("s") / F.col("n")).alias("mean"))


def centroid_distances(means: DataFrame) -> DataFrame:
    """(label1, label2, distance) of label1 < label2."""
    a = means.select(F.col("label").alias("label1"), "pos", F.col("mean").alias("a"))
    b = means.select(F.col("label").alias("label2"), "pos", F.col("mean").alias("b"))
    gap = F.col("a") - F.col("b")
    return a.join(b, "pos").filter("label1 < label2").groupBy("label1", "label2").agg(F.sqrt(F.sum(gap * gap)).alias("distance"))


def closest_pair(distances: DataFrame, tried: DataFrame | None = None) -> DataFrame:
    """The pair with the least distance that hasn't been tried; of equals the one with the lowest label2, then label1."""
    if tried is not None:
        distances = distances.join(tried.select("label1", "label2"), ["label1", "label2"], "left_anti")
    return distances.orderBy("distance", "label2", "label1").limit(1)


def nearest_centroid(vectors: DataFrame, means: DataFrame) -> DataFrame:
    """(id, nearest): the label of the closest centroid, the lowest of equals. All centroids go to every row's task, so
    more than MOST_CENTROIDS labels are an error."""
    if means.select("label").distinct().limit(MOST_CENTROIDS + 1).count() > MOST_CENTROIDS:
        raise ValueError(f"there are more than {MOST_CENTROIDS} centroids")
    c = means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("pos", "mean"))).alias("c")).select("label", F.transform("c", lambda x: x["mean"]).alias("c"))
    every = c.agg(F.array_sort(F.collect_list(F.struct("label", "c"))).alias("every"))

    def gap(k: Column) -> Column:
        return F.struct(F.aggregate(F.zip_with("f", k["c"], lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, v: s + v).alias("d"), k["label"].alias("label"))

    one = every.withColumn("_one", F.lit(1))  # K centroids, as many as a clustering asks for
    return vectors.withColumn("_one", F.lit(1)).join(F.broadcast(one), "_one").select("id", F.array_min(F.transform("every", gap))["label"].alias("nearest"))  # one row of K centroids


def dense_relabel(vectors: DataFrame) -> DataFrame:
    """(id, label): the labels that occur, renumbered from 1."""
    names = vectors.select("label").distinct()
    ranks = names.select("label", F.dense_rank().over(Window.orderBy("label")).cast("long").alias("dense"))  # one row a label
    return vectors.join(ranks, "label").select("id", F.col("dense").alias("label"))


def drop_two_closest(vectors: DataFrame) -> DataFrame:
    """(id, label): the two clusters that come closest to the origin get label 0, the others are renumbered from 1."""
    least = vectors.groupBy("label").agg(F.min(norm_squared("f")).alias("m"))
    ranks = least.withColumn("rank", F.row_number().over(Window.orderBy("m", "label")))  # one row a label
    kept = ranks.withColumn("new", F.when(F.col("rank") <= 2, 0).otherwise(F.sum(F.when(F.col("rank") > 2, 1).otherwise(0)).over(Window.orderBy("label"))))
    return vectors.join(kept.select("label", "new"), "label").select("id", F.col("new").cast("long").alias("label"))


def random_rows(rows: DataFrame, key: str, id_col: str, count: int, seed: int = 1) -> DataFrame:
    """``count`` rows of each key (all, if there are fewer), picked by a hash of the id."""
    w = Window.partitionBy(key).orderBy(F.md5(F.concat_ws(":", F.col(id_col).cast("string"), F.lit(seed))), id_col)
    return rows.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= count).drop("_n")


def component_energy(vectors: DataFrame) -> DataFrame:
    """(pos, energy): each component's sum of squares."""
    return vectors.select(F.posexplode("f").alias("pos", "v")).groupBy(F.col("pos").cast("long").alias("pos")).agg(F.sum(F.col("v").cast("double") * F.col("v").cast("double")).alias("energy"))
