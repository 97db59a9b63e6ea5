"""Dense arrays as long tables (i1, i2, ..., value), the first index fastest in the linear index."""

from __future__ import annotations

from math import prod

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def allocate(spark: SparkSession, *sizes: int) -> DataFrame:
    """An array of zeros."""
    return from_linear(spark.range(prod(sizes)).select(F.col("id").alias("idx"), F.lit(0.0).alias("value")), *sizes)


def from_linear(cells: DataFrame, *sizes: int) -> DataFrame:
    """(idx, value) as (i1, ..., value)."""
    step, cols = 1, []
    for d, n in enumerate(sizes, 1):
        cols.append((F.floor(F.col("idx") / step).cast("long") % n).alias(f"i{d}"))
        step *= n
    return cells.select(*cols, "value")


def to_linear(cells: DataFrame, *sizes: int) -> DataFrame:
    idx, step = F.lit(0).cast("long"), 1
    for d, n in enumerate(sizes, 1):
        idx = idx + F.col(f"i{d}").cast("long") * step
        step *= n
    return cells.select(idx.alias("idx"), "value")


def reshape(cells: DataFrame, old: tuple[int, ...], new: tuple[int, ...]) -> DataFrame:
    """The same values in the same linear order under other sizes of the same product."""
    if prod(old) != prod(new):
        raise ValueError(f"{old} and {new} differ in their number of cells")
    return from_linear(to_linear(cells, *old), *new)


def transpose(cells: DataFrame) -> DataFrame:
    """Each plane of the first two indices transposed."""
    rest = [c for c in cells.columns if c not in ("i1", "i2", "value")]
    return cells.select(F.col("i2").alias("i1"), F.col("i1").alias("i2"), *rest, "value")


def plane(cells: DataFrame, first: str, second: str, **fixed: int) -> DataFrame:
    """The plane of two indices at fixed values of others, as (i1, i2, value)."""
    for name, at in fixed.items():
        cells = cells.filter(F.col(name) == at)
    return cells.select(F.col(first).alias("i1"), F.col(second).alias("i2"), "value")


def values_at(cells: DataFrame, places: DataFrame) -> DataFrame:
    """``places`` (index columns) with the cells' values; 0 outside the array."""
    on = [c for c in places.columns if c in cells.columns]
    return places.join(cells, on, "left").select(*places.columns, F.coalesce("value", F.lit(0.0)).alias("value"))


def sizes(cells: DataFrame) -> DataFrame:
    """(dims, total, n1, n2, ...): the sizes of a dense array, the number of them without trailing sizes of 1 (at least
    2), and their product. An empty array has sizes of 0."""
    names = [c for c in cells.columns if c != "value"]
    found = cells.agg(*(F.coalesce(F.max(c) + 1, F.lit(0)).cast("long").alias(f"n{d}") for d, c in enumerate(names, 1)))
    total, dims = F.lit(1).cast("long"), F.lit(min(2, len(names)))
    for d in range(1, len(names) + 1):
        total = total * F.col(f"n{d}")
        if d > 2:
            dims = F.when(F.col(f"n{d}") != 1, d).otherwise(dims)
    return found.select(dims.cast("int").alias("dims"), total.alias("total"), *(f"n{d}" for d in range(1, len(names) + 1)))


def with_values(cells: DataFrame, updates: DataFrame) -> DataFrame:
    """``cells`` with the values of ``updates`` (the same index columns, value) in place of their own; places outside the
    array change nothing, and of several updates of a cell the largest value counts."""
    names = [c for c in cells.columns if c != "value"]
    new = updates.groupBy(*names).agg(F.max("value").alias("_new"), F.lit(True).alias("_set"))
    return cells.join(new, names, "left").select(*names, F.when(F.col("_set"), F.col("_new")).otherwise(F.col("value")).alias("value"))


def with_value(cells: DataFrame, value: float, **at: int) -> DataFrame:
    """One cell set; a place outside the array changes nothing."""
    here = F.lit(True)
    for name, i in at.items():
        here = here & (F.col(name) == i)
    return cells.withColumn("value", F.when(here, F.lit(value)).otherwise(F.col("value")))


#: Stored kinds of numbers and what holds them: Spark has no unsigned types.
STORED = {"complex64": "struct<re:float,im:float>", "uint8": "smallint", "float32": "float", "int16": "smallint", "int32": "int", "uint16": "int"}
RANGES = {"uint8": (0, 255), "int16": (-32768, 32767), "int32": (-(2**31), 2**31 - 1), "uint16": (0, 65535)}


def as_stored(cells: DataFrame, kind: str) -> DataFrame:
    """Values cut toward zero and wrapped into an integer kind, or rounded to float32."""
    v = F.col("value")
    if kind == "complex64":
        return cells.withColumn("value", F.struct(v.cast("float").alias("re"), F.lit(0.0).cast("float").alias("im")))
    if kind == "float32":
        return cells.withColumn("value", v.cast("float"))
    low, high = RANGES[kind]
    whole = F.when(v < 0, F.ceil(v)).otherwise(F.floor(v)).cast("long")
    return cells.withColumn("value", (F.pmod(whole - low, F.lit(high - low + 1)) + low).cast(STORED[kind]))
