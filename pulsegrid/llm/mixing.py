"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells of source, language and topic. The cells' tokens are raked until source, language and topic
have their target shares, and a document is kept with its cell's calibrated probability.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import binary_column, bounded_broadcast, cut, filtered, fixed_rows, mix, small_batches, span_hashes, table, text_slices, word_spans

#: Topics are clusters of hashed bags of longer words of all documents; the first centres come from about SAMPLE_ROWS.
TOPICS, WIDTH, SAMPLE_ROWS, LONG_WORD = 8, 256, 2000, 4
#: Rounds of k-means at most, and the integer that stands for 1 in a stored bag.
ROUNDS, UNIT = 15, 65535
MARGINS = ("source", "lang", "topic")
#: A margin's target is its own share to this power, so that large sources give way to small ones.
TEMPER = 0.7
#: The share of all tokens to keep.
BUDGET = 0.5
#: Raking ends when every margin is met so nearly, or after so many sweeps without progress. Weights stay below HUGE.
TOLERANCE, PATIENCE, HUGE = 1e-6, 25, 1e12
#: So many cells are raked in one place.
CELLS_HERE = 100_000


def bags(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(documents, WIDTH) unit vectors of damped counts of hashed longer words (zeros without any), and all words' number."""
    docs = len(offs) - 1
    starts, ends, doc = word_spans(buf, offs)
    words = np.bincount(doc, minlength=docs)
    long = ends - starts >= LONG_WORD
    h = mix(span_hashes(buf, starts[long], ends[long], folded=True)) >> np.uint64(56)
    x = np.log1p(np.bincount(doc[long] * WIDTH + h.astype(np.int64), minlength=docs * WIDTH).reshape(docs, WIDTH))
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12), words


def stored_bags(docs: DataFrame) -> DataFrame:
    """(spot, bag) of every document with a longer word: a hash of doc_id in [0, 1), and the bag in units of 1 / UNIT."""
    small_batches(docs.sparkSession)
    spot = F.pmod(F.xxhash64("doc_id", F.lit(6)), F.lit(1_000_000)) / 1_000_000

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [np.zeros((0, WIDTH)), *(bags(buf, offs)[0] for _, _, buf, offs in text_slices(b.column(1)))]
            x = np.concatenate(x)
            some = (x * x).sum(1) > 0.5
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(some)), binary_column(np.rint(x[some] * UNIT).astype(np.uint16))], names=["spot", "bag"])

    return docs.select(spot.alias("spot"), F.col("text").cast("string").alias("text")).mapInArrow(run, "spot double, bag binary")


def seed_topics(x: np.ndarray, topics: int) -> np.ndarray:
    """First centres: farthest-first and k-means over the rows of a small sample."""
    x = x[np.lexsort(x.T)]
    centers = [x[0]]
    for _ in range(min(topics, len(x)) - 1):  # farthest first
        centers.append(x[(x @ np.array(centers).T).max(1).argmin()])
    c = np.array(centers)
    for _ in range(ROUNDS):
        own = (x @ c.T).argmax(1)
        for k in range(len(c)):
            if (own == k).any():
                m = x[own == k].sum(0)
                c[k] = m / np.sqrt((m * m).sum())
    return c


def fit_topics(docs: DataFrame, rows: int = SAMPLE_ROWS, topics: int = TOPICS) -> np.ndarray:
    """(topics, WIDTH) centres: spherical k-means over the bags of all documents.

    The bags are made once and kept in the checkpoint folder. Only the first centres come from a sample (the lowest
    hashes of doc_id). In each round the tasks assign their bags and send a sum for each centre; the sums are of
    integers, so the centres don't depend on how the rows are spread.
    """
    spark = docs.sparkSession
    stored = cut(stored_bags(docs))
    total = stored.count()
    if not total:
        return np.zeros((1, WIDTH))
    # a repeated doc_id with a low hash may have any number of rows
    sample = stored.filter(F.col("spot") < min(1.0, rows / total)).orderBy("spot", "bag").limit(2 * rows).select("bag").toArrow().column("bag")
    if not len(sample):  # few documents and none of them with a low hash
        sample = stored.orderBy("spot", "bag").limit(rows).select("bag").toArrow().column("bag")
    c = seed_topics(fixed_rows(sample.combine_chunks(), np.uint16, WIDTH) / UNIT, topics)
    before = None
    for _ in range(ROUNDS):
        sums = topic_sums(stored, spark.sparkContext.broadcast(c), len(c))
        if before is not None and (sums == before).all():
            break
        before = sums
        for k in np.flatnonzero(sums.any(1)):
            m = sums[k].astype(np.float64)
            c[k] = m / np.sqrt((m * m).sum())
    return c


def topic_sums(stored: DataFrame, shared, topics: int) -> np.ndarray:
    """(topics, WIDTH) sums of the bags nearest to each centre; each task sends at most so many numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        sums = np.zeros((len(c), WIDTH), np.int64)
        for b in batches:
            q = fixed_rows(b.column(0), np.uint16, WIDTH).astype(np.int64)
            own = (q / UNIT @ c.T).round(9).argmax(1)
            for k in np.unique(own):
                sums[k] += q[own == k].sum(0)
        cell = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(sums.ravel()[cell])], names=["cell", "n"])

    got = stored.select("bag").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(topics * WIDTH, np.int64)
    out[got.column("cell").to_numpy()] = got.column("n").to_numpy()
    return out.reshape(topics, WIDTH)


def with_topics(docs: DataFrame, centers: np.ndarray, topic: str = "topic", tokens: str = "tokens") -> DataFrame:
    """``docs`` with topic (int; the nearest centre, the first of equals) and tokens (long; words) appended."""
    small_batches(docs.sparkSession)
    keep = [c for c in docs.columns if c not in (topic, tokens)]
    frame = docs.select(*(F.col(f"`{c}`") for c in keep))
    at = keep.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, words = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
            for _, _, buf, offs in text_slices(b.column(at).cast(pa.string())):
                x, n = bags(buf, offs)
                own.append((x @ centers.T).round(9).argmax(1).astype(np.int32))
                words.append(n.astype(np.int64))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate(own)), pa.array(np.concatenate(words))], names=[*b.schema.names, topic, tokens])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema.fields)
    return frame.mapInArrow(run, f"{schema}, {topic} int, {tokens} long")


def _key(d: str) -> Column:
    """A margin's value as a text that isn't null."""
    return F.coalesce(F.concat(F.lit("v"), F.col(d).cast("string")), F.lit("n"))


def goals(cells: DataFrame, margin: str, targets: dict[str, dict] | None, temper: float) -> DataFrame:
    """(key, value, tokens, goal) of every value of a margin: its tokens, and the share of the kept tokens it should have
    (given, 0 where it is left out; or its own share to the power ``temper``)."""
    sums = cut(cells.groupBy(F.col(margin)).agg(F.sum("tokens").alias("tokens")).select(_key(margin).alias("key"), F.col(margin).alias("value"), F.coalesce("tokens", F.lit(0)).alias("tokens")))
    if targets and margin in targets:
        whole = float(sum(targets[margin].values())) or 1.0
        wanted = F.create_map(*(x for k, v in targets[margin].items() for x in (F.lit(k), F.lit(v / whole))))
        return sums.withColumn("goal", F.coalesce(F.try_element_at(wanted, F.col("value")), F.lit(0.0)))
    power = F.pow(F.col("tokens").cast("double"), F.lit(temper))
    whole = sums.agg(F.sum(power)).first()[0] or 1.0
    return sums.withColumn("goal", power / whole)


def reachable(margin: DataFrame, tokens: float) -> DataFrame:
    """``margin`` with reach: the tokens that each value gets of ``tokens`` in all, in proportion to the goals, except
    that no value gets more than it has; what these lack goes to the others."""
    row = margin.agg(F.max(F.when(F.col("goal") > 0, F.col("tokens") / F.col("goal"))).alias("top"), F.sum(F.when(F.col("goal") > 0, F.col("tokens"))).alias("have")).first()
    if not row["top"] or tokens >= row["have"]:
        return margin.withColumn("reach", F.when(F.col("goal") > 0, F.col("tokens").cast("double")).otherwise(F.lit(0.0)))
    low, high = 0.0, float(row["top"])
    for _ in range(13):  # a grid over all values at once, then a finer one: 16 to the power 13 steps
        grid = np.linspace(low, high, 17)
        got = np.array(margin.agg(*(F.sum(F.least(F.col("tokens").cast("double"), F.col("goal") * float(g))).alias(f"g{i}") for i, g in enumerate(grid))).first(), float)
        i = min(16, max(1, int(np.searchsorted(got, tokens))))
        low, high = grid[i - 1], grid[i]
    return margin.withColumn("reach", F.least(F.col("tokens").cast("double"), F.col("goal") * high))


def _enough(history: list[float]) -> bool:
    """Whether raking is done: it has come within TOLERANCE, or PATIENCE sweeps have brought it no nearer."""
    return history[-1] < TOLERANCE or (len(history) > PATIENCE and min(history[-PATIENCE:]) > 0.99 * min(history[:-PATIENCE]))


def _rake_here(tokens: np.ndarray, codes: list[np.ndarray], reach: list[np.ndarray], weight: np.ndarray, most: float) -> np.ndarray:
    history: list[float] = []
    while not history or not _enough(history):
        off = 0.0
        for code, goal in zip(codes, reach, strict=True):
            share = np.bincount(code, tokens * np.minimum(weight, most), minlength=len(goal))
            factor = np.where(share > 0, goal / np.where(share > 0, share, 1), 1)
            weight = np.minimum(weight * factor[code], HUGE)
            off = max(off, float(np.abs(factor - 1).max(initial=0)))
        history.append(off)
    return weight


def _rake_spread(cells: DataFrame, margins: dict[str, DataFrame], most: float) -> DataFrame:
    """The same over a table of cells of any size: sums of each margin's values, joined back."""
    history: list[float] = []
    while not history or not _enough(history):
        off = 0.0
        for d, table_ in margins.items():
            sums = cells.groupBy(F.col(f"_{d}").alias("key")).agg(F.sum(F.col("tokens") * F.least(F.col("weight"), F.lit(most))).alias("share"))
            factor = F.when(F.col("share") > 0, F.col("reach") / F.nullif("share", F.lit(0.0))).otherwise(F.lit(1.0))
            sums = cut(sums.join(table_.select("key", "reach"), "key").select(F.col("key").alias(f"_{d}"), factor.alias("_f")))
            off = max(off, sums.agg(F.max(F.abs(F.col("_f") - 1))).first()[0] or 0.0)
            cells = cells.join(bounded_broadcast(sums), f"_{d}").withColumn("weight", F.least(F.col("weight") * F.col("_f"), F.lit(HUGE))).drop("_f")
        cells = cut(cells)
        history.append(off)
    return cells


def _reach_here(tokens: np.ndarray, goal: np.ndarray, total: float) -> np.ndarray:
    """``reachable`` for values in memory."""
    some = goal > 0
    if total >= tokens[some].sum():
        return np.where(some, tokens, 0.0)
    ratio = np.where(some, tokens / np.where(some, goal, 1), np.inf)
    order = np.argsort(ratio, kind="stable")
    # with the values up to a place in this order kept whole, the others' share of what is left
    left = total - np.concatenate(([0], np.cumsum(tokens[order])))[:-1]
    rest = np.cumsum(goal[order][::-1])[::-1]
    scale = left / np.maximum(rest, 1e-300)
    first = int(np.argmax(scale <= ratio[order]))
    return np.minimum(tokens, goal * scale[first])


def _rake_all(cells: pd.DataFrame, targets: dict[str, dict] | None, temper: float, budget: float | None) -> np.ndarray:
    """The weights of a table of cells in memory."""
    tokens = cells["tokens"].fillna(0).to_numpy(float)
    codes, reach = [], []
    order = np.lexsort([cells[f"_{d}"].to_numpy(str) for d in MARGINS])
    for d in MARGINS:
        keys, code = np.unique(cells[f"_{d}"].to_numpy(str), return_inverse=True)
        own = np.bincount(code, tokens, minlength=len(keys))
        if targets and d in targets:
            wanted = {f"v{k}": v for k, v in targets[d].items()}
            goal = np.array([wanted.get(k, 0.0) for k in keys]) / (float(sum(targets[d].values())) or 1.0)
        else:
            goal = own**temper / ((own**temper).sum() or 1.0)
        codes.append(code[order])
        reach.append(goal * tokens.sum() if budget is None else _reach_here(own, goal, budget * tokens.sum()))
    weight = np.ones(len(cells))
    weight[order] = _rake_here(tokens[order], codes, reach, cells["weight"].to_numpy(float)[order], HUGE if budget is None else 1.0)
    return weight


def _rake(cells: DataFrame, targets: dict[str, dict] | None, temper: float, budget: float | None) -> DataFrame:
    """``cells`` (source, lang, topic, tokens, weight) with the weight raked: freely, or, with a budget, to the tokens that
    are kept if no more than all of a cell can be."""
    keyed = cells.withColumns({f"_{d}": _key(d) for d in MARGINS})
    if cells.limit(CELLS_HERE + 1).count() <= CELLS_HERE:
        here = keyed.select("tokens", "weight", *(f"_{d}" for d in MARGINS)).toPandas()
        made = {f"_{d}": pa.array(here[f"_{d}"].astype(str), pa.string()) for d in MARGINS}
        made["_w"] = pa.array(_rake_all(here, targets, temper, budget) if len(here) else np.zeros(0), pa.float64())
        found = cells.sparkSession.createDataFrame(pa.table(made))  # of rows, executors would start workers of another kind
        return keyed.drop("weight").join(F.broadcast(found), [f"_{d}" for d in MARGINS]).select(*MARGINS, "tokens", F.col("_w").alias("weight"))  # a row a cell
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    margins = {}
    for d in MARGINS:
        margin = goals(cells, d, targets, temper)
        margins[d] = cut(margin.withColumn("reach", F.col("goal") * total) if budget is None else reachable(margin, budget * total))
    return _rake_spread(cut(keyed), margins, HUGE if budget is None else 1.0).select(*MARGINS, "tokens", "weight")


def raked(cells: DataFrame, targets: dict[str, dict] | None = None, temper: float = TEMPER) -> DataFrame:
    """``cells`` (source, lang, topic, tokens) with weight: the factor on each cell's tokens after which every margin has
    its target share (given, or its own share to the power ``temper``).

    Sweeps go on until all margins are met within TOLERANCE, or, where margins contradict each other, until PATIENCE
    sweeps bring no progress. Values that ``targets`` leaves out get 0. Cells without tokens take their margins' factors.
    Null values are values of their own. Up to CELLS_HERE cells are raked in one place, more by grouped sums.
    """
    return _rake(cells.select(*MARGINS, "tokens", F.lit(1.0).alias("weight")), targets, temper, None)


def keep_probabilities(cells: DataFrame, budget: float = BUDGET, targets: dict[str, dict] | None = None, temper: float = TEMPER) -> DataFrame:
    """``cells`` (with weight) with keep = min(1, weight), the weight raked on until the tokens that are kept, ``budget`` of
    all, meet the targets although nothing can be kept more than whole.

    A value with fewer tokens than its target asks for is kept whole, and the others of its margin share what it lacks
    (``margin_report`` names it). If the values with a target above 0 don't have so many tokens, all of theirs are kept.
    """
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    kept = float(cells.agg(F.sum(F.col("tokens") * F.col("weight"))).first()[0] or 0)
    start = cells.withColumn("weight", F.col("weight") * (budget * total / kept if kept else 1.0))
    return _rake(cut(start), targets, temper, budget).withColumn("keep", F.least(F.lit(1.0), "weight"))


def margin_report(cells: DataFrame, budget: float = BUDGET, targets: dict[str, dict] | None = None, temper: float = TEMPER) -> DataFrame:
    """(margin, value, target, reachable, expected, feasible) of ``cells`` with keep: each value's target share of the kept
    tokens, the share it can have at this budget, the share that the probabilities give it, and whether the target itself
    can be had by this margin alone."""
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    kept = float(cells.agg(F.sum(F.col("tokens") * F.col("keep"))).first()[0] or 0) or 1.0
    out = None
    for d in MARGINS:
        margin = cut(reachable(goals(cells, d, targets, temper), budget * total))
        got = cells.groupBy(_key(d).alias("key")).agg((F.sum(F.col("tokens") * F.col("keep")) / kept).alias("expected"))
        whole = float(margin.agg(F.sum("reach")).first()[0] or 0) or 1.0
        rows = margin.join(got, "key").select(F.lit(d).alias("margin"), F.col("value").cast("string").alias("value"), F.col("goal").alias("target"), (F.col("reach") / whole).alias("reachable"), "expected", (F.col("goal") * budget * total <= F.col("tokens") * (1 + 1e-9)).alias("feasible"))
        out = rows if out is None else out.unionByName(rows)
    return out


def mixed(docs: DataFrame, targets: dict[str, dict] | None = None, budget: float = BUDGET, seed: int = 1) -> DataFrame:
    """``docs`` with topic, tokens, weight, keep (the probability) and kept appended (columns of these names are replaced).

    Null sources and languages are values of their own. Null and empty texts have no tokens and the first topic. The
    draw is a hash of doc_id and ``seed``: rows of one doc_id fall together, and a second run draws the same; a null doc_id
    is an id like others. Very long texts count whole. Empty tables give no rows. The cells' table is broadcast only if
    it is small; else the join is shuffled, and a hot cell's rows are split by the adaptive skew join.
    """
    names = ("topic", "tokens", "weight", "keep", "kept")
    plain = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c not in names))
    centers = fit_topics(docs.select("doc_id", "text"))
    cells = calibrated_cells(plain, centers, targets, budget)
    keyed = bounded_broadcast(cut(cells.select(*(_key(d).alias(f"_{d}") for d in MARGINS), "weight", "keep")))
    rows = with_topics(plain, centers).withColumns({f"_{d}": _key(d) for d in MARGINS})
    draw = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    return rows.join(keyed, [f"_{d}" for d in MARGINS]).drop(*(f"_{d}" for d in MARGINS)).withColumn("kept", draw < F.col("keep"))


def sampled(docs: DataFrame, targets: dict[str, dict] | None = None, budget: float = BUDGET, seed: int = 1) -> DataFrame:
    """The rows and columns of ``docs`` that are drawn."""
    return filtered(docs, lambda d: mixed(d, targets, budget, seed), "kept")


def calibrated_cells(docs: DataFrame, centers: np.ndarray, targets: dict[str, dict] | None = None, budget: float = BUDGET) -> DataFrame:
    """(source, lang, topic, tokens, weight, keep) of all documents."""
    cells = cut(with_topics(docs.select("source", "lang", "text"), centers).groupBy(*MARGINS).agg(F.sum("tokens").alias("tokens")))
    return keep_probabilities(raked(cells, targets), budget, targets)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixed(docs.select("doc_id", "text", "source", "lang")).drop("text")
