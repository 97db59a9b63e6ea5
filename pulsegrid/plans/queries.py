"""The registered queries over the signal tables, each beside its SQL.

``events`` are the signal: user_id is the channel, the order by (ts, event_id) the time, value in cents less 5,000 the
sample, so that it has both signs and all sums are exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Settings
from ..operators import clips, clusters, detect, features, kmeans, scoring, series, spatial, splitting, tensor
from ..sources import arrays, channels, results
from ..sources.array_source import ArraySource
from ..sources.folders import cut, drop_folder, partitions, shared_folder
from . import calibration as cal
from . import sorting

RADIUS, SIZE = 5, 8


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    cents = F.round(F.col("value") * 100).cast("long") - 5000
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("channel"), (F.row_number().over(w) - 1).cast("long").alias("t"), cents.alias("x"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("label"), F.transform("embedding", lambda v: v.cast("double")).alias("f"))


def supplier_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("channel"), F.col("s_acctbal").alias("px"), F.col("s_nationkey").cast("double").alias("py"))


def customer_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("channel"), F.col("c_acctbal").alias("px"), F.col("c_nationkey").cast("double").alias("py"))


SIG = """sig AS (SELECT user_id AS channel, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS t,
    CAST(round(value * 100) AS BIGINT) - 5000 AS x FROM events)"""
EXT = f"""ext AS (SELECT channel, t, x FROM (SELECT *, abs(x) AS a, count(*) OVER (PARTITION BY channel) AS n,
    max(abs(x)) OVER (PARTITION BY channel ORDER BY t ROWS BETWEEN {RADIUS} PRECEDING AND 1 PRECEDING) AS before,
    max(abs(x)) OVER (PARTITION BY channel ORDER BY t ROWS BETWEEN 1 FOLLOWING AND {RADIUS} FOLLOWING) AS after FROM sig)
    WHERE a > before AND a >= after AND t >= {RADIUS} AND t + {RADIUS} < n)"""
CLIPS = f"""clips AS (SELECT e.channel, e.t, CAST(k.k AS BIGINT) AS k, s.x FROM ext e, range(0, {SIZE}) k(k), sig s,
    (SELECT channel, max(t) AS last FROM sig GROUP BY channel) m WHERE s.channel = e.channel AND m.channel = e.channel AND s.t = e.t - {SIZE // 2} + k.k
    AND e.t - {SIZE // 2} >= 0 AND e.t + {SIZE - 1 - SIZE // 2} <= m.last)"""
VEC = "vec AS (SELECT vec_id AS id, CAST(label AS BIGINT) AS label, i - 1 AS pos, CAST(embedding[i] AS DOUBLE) AS v FROM embeddings, range(1, 65) r(i))"
CEN = "cen AS (SELECT label, CAST(pos AS BIGINT) AS pos, avg(v) AS mean FROM vec GROUP BY label, pos)"
DIST = "dist AS (SELECT a.label AS label1, b.label AS label2, sqrt(sum((a.mean - b.mean) * (a.mean - b.mean))) AS distance FROM cen a JOIN cen b ON a.pos = b.pos AND a.label < b.label GROUP BY 1, 2)"
EDGES = """edges AS (SELECT a.s_suppkey AS i, b.s_suppkey AS j FROM supplier a, supplier b WHERE sqrt((a.s_acctbal - b.s_acctbal) * (a.s_acctbal - b.s_acctbal)
    + (CAST(a.s_nationkey AS DOUBLE) - b.s_nationkey) * (CAST(a.s_nationkey AS DOUBLE) - b.s_nationkey)) <= 100)"""

def _taken(found: DataFrame, at: str) -> DataFrame:
    """What was read from a folder that is deleted now."""
    found = cut(found)
    drop_folder(found.sparkSession, at)
    return found


QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# --- events, clips, templates


@query(f"WITH {SIG}, {EXT} SELECT * FROM ext")
def local_extrema(spark, sf_dir):
    return detect.local_extrema(signal(spark, sf_dir), RADIUS)


@query(f"WITH {SIG}, {EXT} SELECT * FROM ext")
def local_extrema_pairwise(spark, sf_dir):
    return detect.local_extrema_pairwise(signal(spark, sf_dir), RADIUS)


@query(f"WITH {SIG}, {EXT} SELECT channel, t, CAST(x AS DOUBLE) AS x FROM ext")
def local_extrema_blocks(spark, sf_dir):
    return detect.local_extrema_blocks(signal(spark, sf_dir), RADIUS)


@query(f"WITH {SIG}, {EXT}, {CLIPS} SELECT * FROM clips")
def extract_clips(spark, sf_dir):
    s = signal(spark, sf_dir)
    return clips.extract_clips(s, detect.local_extrema(s, RADIUS), SIZE).select("channel", "t", "k", "x")


@query(f"WITH {SIG}, {EXT}, {CLIPS} SELECT channel, k, CAST(sum(x) AS BIGINT) AS sum_x, count(*) AS n FROM clips GROUP BY channel, k")
def mean_template(spark, sf_dir):
    s = signal(spark, sf_dir)
    return clips.mean_template(clips.extract_clips(s, detect.local_extrema(s, RADIUS), SIZE), "channel")


@query(f"""WITH {SIG}, {EXT}, m AS (SELECT channel, max(t) AS last FROM sig GROUP BY channel)
SELECT e.channel AS neuron, s.channel AS member, CAST(k.k AS BIGINT) AS k, CAST(sum(s.x) AS BIGINT) AS sum_x, count(*) AS n
FROM ext e, range(0, {SIZE}) k(k), sig s, m WHERE s.t = e.t - {SIZE // 2} + k.k AND m.channel = s.channel
AND e.t - {SIZE // 2} >= 0 AND e.t + {SIZE - 1 - SIZE // 2} <= m.last GROUP BY 1, 2, 3""")
def cross_channel_template(spark, sf_dir):
    s = signal(spark, sf_dir)
    return clips.crossed_sums(s, detect.local_extrema(s, RADIUS).withColumnRenamed("channel", "neuron"), SIZE, "neuron")


@query(f"""WITH {SIG}, {EXT}, c AS (SELECT DISTINCT channel, CASE WHEN x < 0 THEN 1 ELSE 2 END AS label FROM ext)
SELECT CAST(row_number() OVER (ORDER BY CAST(channel AS VARCHAR), CAST(channel AS VARCHAR) || '-' || CAST(label AS VARCHAR)) - 1 AS BIGINT) AS neuron_id, channel, label FROM c""")
def neuron_order(spark, sf_dir):
    found = detect.local_extrema(signal(spark, sf_dir), RADIUS).select("channel", F.when(F.col("x") < 0, 1).otherwise(2).alias("label"))
    return clips.neuron_ids(found, as_text=True)


# --- neighbours


@query(f"WITH {EDGES} SELECT * FROM edges")
def adjacency_edges(spark, sf_dir):
    return spatial.adjacency(supplier_places(spark, sf_dir), 100.0)


@query("""SELECT a.c_custkey AS i, count(*) AS n, CAST(sum(b.c_custkey) AS BIGINT) AS members FROM customer a, customer b
WHERE abs(a.c_acctbal - b.c_acctbal) <= 2 AND sqrt((a.c_acctbal - b.c_acctbal) * (a.c_acctbal - b.c_acctbal)
+ (CAST(a.c_nationkey AS DOUBLE) - b.c_nationkey) * (CAST(a.c_nationkey AS DOUBLE) - b.c_nationkey)) <= 2 GROUP BY 1""")
def adjacency_degrees(spark, sf_dir):
    return spatial.adjacency(customer_places(spark, sf_dir), 2.0).groupBy("i").agg(F.count("*").alias("n"), F.sum("j").alias("members"))


@query(f"WITH {EDGES} SELECT i AS channel, CAST(row_number() OVER (PARTITION BY i ORDER BY j) - 1 AS BIGINT) AS rank, j AS member FROM edges")
def patch_members(spark, sf_dir):
    return spatial.patch_members(spatial.adjacency(supplier_places(spark, sf_dir), 100.0))


@query(f"WITH {EDGES} SELECT i AS channel, min(j) AS source FROM edges GROUP BY i")
def detection_channels(spark, sf_dir):
    return spatial.detection_channels(spatial.adjacency(supplier_places(spark, sf_dir), 100.0), "patch_first")


@query(f"""WITH {EDGES}, daily AS (SELECT l_suppkey AS channel, datediff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS t,
CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS x FROM lineitem GROUP BY 1, 2)
SELECT i AS channel, j AS member, CAST(t AS BIGINT) AS t, x FROM edges JOIN daily ON daily.channel = j""")
def patch_samples(spark, sf_dir):
    daily = read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("channel"), F.datediff(F.to_date("l_shipdate"), F.lit("1970-01-01").cast("date")).cast("long").alias("t")).agg(F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("x"))
    return spatial.patch_samples(daily, spatial.adjacency(supplier_places(spark, sf_dir), 100.0))


@query("SELECT event_type AS channel, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY 1")
def channel_split(spark, sf_dir):
    """Through a table partitioned by channel."""
    rows = read(spark, sf_dir, "events").select(F.col("event_type").alias("channel"), F.col("event_id").alias("t"), F.round(F.col("value") * 100).cast("long").alias("x"))
    at = shared_folder(spark, "split")
    channels.split_into_channels(rows, at)
    return _taken(channels.read_channels(spark, at).groupBy("channel").agg(F.count("*").alias("n"), F.sum("x").alias("total")), at)


# --- scores

KERNEL = {0: (-2, 5, -1), 1: (1, 0, 3), 2: (4, -3, 1)}
_KERNEL_SQL = "kernel AS (SELECT * FROM (VALUES " + ", ".join(f"({c}, {k}, {v})" for c, vs in KERNEL.items() for k, v in enumerate(vs)) + ") AS x(c, k, v))"


_SCORES = f"""WITH {SIG}, {_KERNEL_SQL}, ends AS (SELECT channel // 3 AS d, max(t) + 1 AS n FROM sig GROUP BY 1),
starts AS (SELECT d, CAST(u AS BIGINT) AS t FROM ends, range(0, 100000) r(u) WHERE u < n - 3),
parts AS (SELECT s.d, s.t, c, CAST(coalesce(sum(x * v), 0) AS BIGINT) AS dot FROM starts s JOIN kernel ON true LEFT JOIN sig ON sig.channel = 3 * s.d + c AND sig.t = s.t + k GROUP BY 1, 2, 3),
p AS (SELECT d, t, CAST(sum(CASE WHEN c < 2 THEN dot ELSE 0 END) AS BIGINT) AS near, CAST(sum(dot) AS BIGINT) AS dot FROM parts GROUP BY 1, 2),
e AS (SELECT CAST(sum(CASE WHEN c < 2 THEN v * v ELSE 0 END) AS BIGINT) AS near, CAST(sum(v * v) AS BIGINT) AS al FROM kernel),
g AS (SELECT d AS device, t, CAST(2 * p.near - e.near AS DOUBLE) AS patch_score, CAST(2 * dot - al AS DOUBLE) AS all_score FROM p, e)"""


@query(f"""{_SCORES}
SELECT device, t, patch_score, CASE WHEN patch_score > 0 THEN all_score ELSE patch_score END AS full_score FROM g""")
def gated_score(spark, sf_dir):
    """Three users are the channels of a device; a neuron of each device has the same kernel, and two of them as its patch.
    A device's starts end with its own longest channel."""
    s = signal(spark, sf_dir)
    users = s.groupBy("channel").agg(F.max("t").alias("last")).select("channel", F.floor(F.col("channel") / 3).alias("neuron_id"), (F.col("channel") % 3).alias("c"), "last")
    shape = F.array(*(F.struct(F.lit(c).alias("c"), F.array(*map(F.lit, vs)).alias("v")) for c, vs in KERNEL.items()))
    places = users.select("neuron_id").distinct().select("neuron_id", F.explode(shape).alias("s")).select("neuron_id", (3 * F.col("neuron_id") + F.col("s.c")).alias("channel"), F.posexplode("s.v").alias("k", "v"))
    patches = users.select("neuron_id", F.explode(F.array(3 * F.col("neuron_id"), 3 * F.col("neuron_id") + 1)).alias("channel")).distinct()
    ends = users.groupBy("neuron_id").agg((F.max("last") + 1).alias("n"))
    found = scoring.gated_scores(s, places, patches, 3).join(ends, "neuron_id").filter("t < n - 3")
    return found.select(F.col("neuron_id").alias("device"), "t", F.round("patch_score", 3).alias("patch_score"), F.round("full_score", 3).alias("full_score"))


TEMPLATE = (1, -2, 4, -2, 1)


@query(f"""WITH {SIG}, n AS (SELECT max(t) + 1 AS n FROM sig),
k AS (SELECT * FROM (VALUES {", ".join(f"({i}, {v})" for i, v in enumerate(TEMPLATE))}) AS x(k, v)),
starts AS (SELECT c.channel, CAST(u AS BIGINT) AS t FROM (SELECT DISTINCT channel FROM sig) c, n, range(0, 100000) r(u) WHERE u < n.n - {len(TEMPLATE)}),
d AS (SELECT s.channel AS neuron_id, s.t, coalesce(sum(x * v), 0) AS dot FROM starts s JOIN k ON true LEFT JOIN sig ON sig.channel = s.channel AND sig.t = s.t + k GROUP BY 1, 2)
SELECT neuron_id, t, CAST(2 * dot - {sum(v * v for v in TEMPLATE)} AS DOUBLE) AS score FROM d""")
def template_score(spark, sf_dir):
    """The patch of each neuron is one channel; the recording's length is that of its longest channel."""
    s = signal(spark, sf_dir)
    kernels = s.select(F.col("channel").alias("neuron_id"), "channel").distinct().select("neuron_id", "channel", F.posexplode(F.array(*map(F.lit, TEMPLATE))).alias("k", "v"))
    n = s.agg(F.max("t").alias("n"))
    # channels that end early are silent from then on
    ends = s.groupBy("channel").agg(F.max("t").alias("e")).join(F.broadcast(n)).filter("e < n").select("channel", F.explode(F.sequence(F.col("e") + 1, F.col("n"))).alias("t"), F.lit(0).cast("long").alias("x"))
    found = scoring.match_scores(s.unionByName(ends), kernels, len(TEMPLATE))
    return found.select("neuron_id", "t", F.round("score", 3).alias("score"))


@query(f"""{_SCORES}
SELECT device, count(*) FILTER (WHERE patch_score > 0) AS hits FROM g GROUP BY 1""")
def gate_hits(spark, sf_dir):
    """How many starts of each device pass the gate."""
    return scoring.gate_hits(gated_score(spark, sf_dir).withColumnRenamed("device", "neuron_id")).withColumnRenamed("neuron_id", "device")


# --- one channel's values in order


@query(f"""WITH {SIG}, d AS (SELECT DISTINCT channel, x FROM sig), o AS (SELECT channel, x, row_number() OVER w - 1 AS i, lead(x) OVER w AS up, lag(x) OVER w AS down FROM d WINDOW w AS (PARTITION BY channel ORDER BY x)),
s AS (SELECT channel, x, CAST(i AS BIGINT) AS i, CASE WHEN down IS NULL THEN 2 * (up - x) WHEN up IS NULL THEN 2 * (x - down) ELSE up - down END AS s2 FROM o WHERE up IS NOT NULL OR down IS NOT NULL)
SELECT channel, i, x, CAST(s2 AS BIGINT) AS twice_spacing, round(-ln(s2 / 2.0e0), 6) AS log_density, round(sqrt(s2 / 2.0e0), 6) AS root FROM s""")
def spacing_logdensity(spark, sf_dir):
    found = series.spacings(signal(spark, sf_dir))
    return found.select("channel", "i", "x", "twice_spacing", F.round("log_density", 6).alias("log_density"), F.round("root", 6).alias("root"))


@query(f"""WITH {SIG} SELECT channel, CAST(row_number() OVER w AS BIGINT) AS rank, x, CAST(sum(x) OVER (PARTITION BY channel ORDER BY x, t ROWS UNBOUNDED PRECEDING) AS BIGINT) AS sum_x
FROM sig WINDOW w AS (PARTITION BY channel ORDER BY x, t)""")
def cumulative_curve(spark, sf_dir):
    return series.cumulative(signal(spark, sf_dir))


@query(f"""WITH {SIG} SELECT a.channel, a.t, count(b.x) AS below, (SELECT count(*) FROM sig c WHERE c.channel = a.channel) AS n
FROM sig a LEFT JOIN sig b ON b.channel = a.channel AND b.x < a.x GROUP BY 1, 2""")
def empirical_share(spark, sf_dir):
    return series.shares_below(signal(spark, sf_dir))


_FIT = """p AS (SELECT channel, t, x, sum(x) OVER (PARTITION BY channel ORDER BY t) AS s FROM {0}),
seg AS (SELECT a.channel, a.t AS i, b.t AS k, (b.s - a.s + a.x) / CAST(b.t - a.t + 1 AS DOUBLE) AS m FROM p a JOIN p b ON a.channel = b.channel AND b.t >= a.t),
low AS (SELECT channel, i, k, min(m) OVER (PARTITION BY channel, i ORDER BY k DESC) AS m FROM seg),
fit AS (SELECT channel, k AS t, max(m) AS fit FROM low GROUP BY 1, 2)"""


# The best rising fit of every prefix (side 0) and, in reversed time, of every suffix (side 1): the greatest of the least means.
# The peak is the first place with the least sum of both errors, up to rounding.
_PEAK = """sides AS (SELECT channel, 0 AS side, t, x FROM src UNION ALL SELECT channel, 1, max(t) OVER (PARTITION BY channel) - t, x FROM src),
p AS (SELECT *, sum(x) OVER (PARTITION BY channel, side ORDER BY t) AS s FROM sides),
seg AS (SELECT a.channel, a.side, a.t AS i, b.t AS j, (b.s - a.s + a.x) / CAST(b.t - a.t + 1 AS DOUBLE) AS m FROM p a JOIN p b ON a.channel = b.channel AND a.side = b.side AND b.t >= a.t),
low AS (SELECT s.channel, s.side, e.t AS p, s.i, s.j, min(s.m) OVER (PARTITION BY s.channel, s.side, e.t, s.i ORDER BY s.j DESC) AS m FROM seg s JOIN p e ON e.channel = s.channel AND e.side = s.side AND e.t >= s.j),
rise AS (SELECT channel, side, p, j AS t, max(m) AS fit FROM low GROUP BY 1, 2, 3, 4),
err AS (SELECT r.channel, r.side, r.p, sum((p.x - r.fit) * (p.x - r.fit)) AS e FROM rise r JOIN p ON p.channel = r.channel AND p.side = r.side AND p.t = r.t GROUP BY 1, 2, 3),
ends AS (SELECT channel, max(t) AS last, 1e-12 * (1 + CAST(max(abs(x)) AS DOUBLE) * max(abs(x)) * count(*)) AS tiny FROM src GROUP BY 1),
both_ AS (SELECT a.channel, a.p, a.e + b.e AS e, n.last, n.tiny FROM err a JOIN ends n ON n.channel = a.channel JOIN err b ON b.channel = a.channel AND b.side = 1 AND b.p = n.last - a.p WHERE a.side = 0),
least AS (SELECT *, min(e) OVER (PARTITION BY channel) AS least FROM both_),
peak AS (SELECT channel, min(p) AS p, any_value(last) AS last FROM least WHERE e <= least + tiny GROUP BY 1),
fit AS (SELECT r.channel, r.t, r.fit FROM rise r JOIN peak k ON k.channel = r.channel AND r.side = 0 AND r.p = k.p
UNION ALL SELECT r.channel, k.last - r.t, r.fit FROM rise r JOIN peak k ON k.channel = r.channel AND r.side = 1 AND r.p = k.last - k.p WHERE r.t < k.last - k.p)"""


@query(f"WITH {SIG}, {_FIT.format('sig')} SELECT channel, t, round(fit, 4) AS fit FROM fit")
def isotonic_fit(spark, sf_dir):
    return series.monotone(signal(spark, sf_dir)).select("channel", "t", F.round("fit", 4).alias("fit"))


@query(f"WITH {SIG}, neg AS (SELECT channel, t, -x AS x FROM sig), {_FIT.format('neg')} SELECT channel, t, round(-fit, 4) AS fit FROM fit")
def isotonic_fit_decreasing(spark, sf_dir):
    return series.monotone(signal(spark, sf_dir), False).select("channel", "t", F.round("fit", 4).alias("fit"))


@query(f"WITH {SIG}, src AS (SELECT channel, t, x FROM sig), {_PEAK} SELECT channel, t, round(fit, 4) AS fit FROM fit")
def unimodal_fit(spark, sf_dir):
    return series.unimodal(signal(spark, sf_dir)).select("channel", "t", F.round("fit", 4).alias("fit"))


@query(f"WITH {SIG}, src AS (SELECT channel, t, -x AS x FROM sig), {_PEAK} SELECT channel, t, round(-fit, 4) AS fit FROM fit")
def valley_fit(spark, sf_dir):
    return series.unimodal(signal(spark, sf_dir), False).select("channel", "t", F.round("fit", 4).alias("fit"))


@query(f"""WITH {SIG}, src AS (SELECT channel, t, -x AS x FROM sig), {_PEAK}, o AS (SELECT channel, t, -fit AS fit, row_number() OVER (PARTITION BY channel ORDER BY -fit, t) AS r FROM fit)
SELECT channel, t, round(fit, 4) AS fit FROM o WHERE r = 1""")
def valley_bottom(spark, sf_dir):
    """Where each channel's valley fit is least."""
    fits = series.unimodal(signal(spark, sf_dir), False)
    return series.least(fits.withColumn("x", F.col("fit"))).select("channel", "t", F.round("x", 4).alias("fit"))


@query(f"WITH {SIG}, q AS (SELECT channel, x, t, row_number() OVER (PARTITION BY channel ORDER BY x, t) AS r FROM sig) SELECT channel, x, t FROM q WHERE r = 1")
def least_samples(spark, sf_dir):
    return series.least(signal(spark, sf_dir))


# --- feature vectors


def _stretched(spark, sf_dir):
    """The vectors with their components times the roots of 1, 2, 3, ..., since their own lengths are all alike."""
    return vectors(spark, sf_dir).withColumn("f", F.transform("f", lambda v, i: v * F.sqrt(i + F.lit(1.0))))


@query(f"WITH {VEC}, {CEN} SELECT label, pos, round(mean, 6) AS mean FROM cen")
def centroids(spark, sf_dir):
    return clusters.centroids(vectors(spark, sf_dir)).withColumn("mean", F.round("mean", 6))


@query(f"WITH {VEC}, {CEN}, {DIST} SELECT label1, label2, round(distance, 6) AS distance FROM dist")
def centroid_distances(spark, sf_dir):
    return clusters.centroid_distances(clusters.centroids(vectors(spark, sf_dir))).withColumn("distance", F.round("distance", 6))


@query(f"WITH {VEC}, {CEN}, {DIST}, r AS (SELECT *, row_number() OVER (ORDER BY distance, label2, label1) AS n FROM dist) SELECT label1, label2, round(distance, 6) AS distance FROM r WHERE n = 2")
def closest_pair(spark, sf_dir):
    """The closest pair once the very closest has been tried."""
    d = clusters.centroid_distances(clusters.centroids(vectors(spark, sf_dir)))
    return clusters.closest_pair(d, clusters.closest_pair(d)).withColumn("distance", F.round("distance", 6))


@query(f"WITH {VEC}, {CEN}, g AS (SELECT id, c.label, sum((v - mean) * (v - mean)) AS d FROM vec JOIN cen c ON c.pos = vec.pos GROUP BY 1, 2) SELECT id, arg_min(label, d) AS nearest FROM g GROUP BY id")
def nearest_centroid(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return clusters.nearest_centroid(v, clusters.centroids(v))


@query(f"WITH {VEC}, {CEN}, d AS (SELECT label, mean FROM cen WHERE pos = 0) SELECT id, round(sum(v * c.mean) / max(n.n), 6) AS along FROM vec JOIN cen c ON c.label = vec.label AND c.pos = vec.pos JOIN (SELECT label, sqrt(sum(mean * mean)) AS n FROM cen GROUP BY 1) n ON n.label = vec.label GROUP BY id")
def projection(spark, sf_dir):
    v = vectors(spark, sf_dir)
    c = clusters.centroids(v).groupBy("label").agg(F.array_sort(F.collect_list(F.struct("pos", "mean"))).alias("p")).select("label", F.transform("p", lambda x: x["mean"]).alias("direction"))
    return v.join(c, "label").select("id", F.round(clusters.projected("f", "direction"), 6).alias("along"))


@query("SELECT vec_id AS id, CAST(dense_rank() OVER (ORDER BY label) AS BIGINT) AS label FROM embeddings")
def dense_relabel(spark, sf_dir):
    return clusters.dense_relabel(vectors(spark, sf_dir).withColumn("label", 3 * F.col("label") + 2))


@query(f"""WITH {VEC}, q AS (SELECT id, label, sum(v * v * (pos + 1)) AS q FROM vec GROUP BY 1, 2), m AS (SELECT label, row_number() OVER (ORDER BY min(q), label) AS r FROM q GROUP BY 1),
k AS (SELECT label, CASE WHEN r <= 2 THEN 0 ELSE sum(CASE WHEN r > 2 THEN 1 ELSE 0 END) OVER (ORDER BY label) END AS n FROM m) SELECT vec_id AS id, CAST(n AS BIGINT) AS label FROM embeddings e JOIN k ON k.label = e.label""")
def drop_two_closest(spark, sf_dir):
    return clusters.drop_two_closest(_stretched(spark, sf_dir))


@query(f"WITH {VEC} SELECT CAST(pos AS BIGINT) AS pos, round(sum(v * v), 6) AS energy FROM vec GROUP BY 1")
def component_energy(spark, sf_dir):
    return clusters.component_energy(vectors(spark, sf_dir)).withColumn("energy", F.round("energy", 6))


@query(f"WITH {VEC} SELECT CAST(label AS BIGINT) AS label, round(min(q), 6) AS least FROM (SELECT id, label, sum(v * v * (pos + 1)) AS q FROM vec GROUP BY 1, 2) GROUP BY 1")
def least_norm(spark, sf_dir):
    v = _stretched(spark, sf_dir)
    return v.groupBy("label").agg(F.round(F.min(clusters.norm_squared("f")), 6).alias("least"))


@query("SELECT CAST(coalesce(max(label), 0) AS BIGINT) AS top FROM embeddings")
def largest_label(spark, sf_dir):
    return vectors(spark, sf_dir).agg(F.coalesce(F.max("label"), F.lit(0).cast("long")).alias("top"))


@query("SELECT vec_id AS id, label FROM (SELECT vec_id, CAST(label AS BIGINT) AS label, row_number() OVER (PARTITION BY label ORDER BY md5(CAST(vec_id AS VARCHAR) || ':1'), vec_id) AS n FROM embeddings) WHERE n <= 5")
def random_rows(spark, sf_dir):
    return clusters.random_rows(vectors(spark, sf_dir).select("id", "label"), "label", "id", 5)


@query(f"""WITH {SIG}, sized AS (SELECT channel, count(*) AS n FROM sig GROUP BY 1), grid AS (SELECT DISTINCT n // 7 * 7 AS n FROM sized),
w AS (SELECT DISTINCT n FROM sized), b AS (SELECT w.n, (SELECT max(g.n) FROM grid g WHERE g.n <= w.n) AS a, (SELECT min(g.n) FROM grid g WHERE g.n > w.n) AS c, (SELECT min(n) FROM grid) AS lo, (SELECT max(n) FROM grid) AS hi FROM w),
s AS (SELECT n, coalesce(a, lo) AS n1, CASE WHEN coalesce(a, lo) = n THEN n ELSE coalesce(c, hi) END AS n2 FROM b)
SELECT n, n1, n2, CASE WHEN n2 > n1 THEN greatest(0.0e0, least(1.0e0, (n - n1) / CAST(n2 - n1 AS DOUBLE))) ELSE 0.0e0 END AS share FROM s""")
def calibration_bracket(spark, sf_dir):
    sizes = signal(spark, sf_dir).groupBy("channel").agg(F.count("*").alias("n"))
    return cal.bracket(sizes, sizes.select((F.floor(F.col("n") / 7) * 7).alias("n")))


@query(f"""WITH {SIG}, sized AS (SELECT channel, count(*) AS n FROM sig GROUP BY 1), q AS (SELECT channel, x, row_number() OVER (PARTITION BY channel ORDER BY x, t) AS k FROM sig),
c AS (SELECT n // 7 * 7 AS n, k, avg(x) AS mean, coalesce(stddev_samp(x), 0.0e0) AS sd FROM q JOIN sized USING (channel) WHERE k <= n // 7 * 7 GROUP BY 1, 2),
w AS (SELECT DISTINCT n FROM sized), grid AS (SELECT DISTINCT n FROM c),
b AS (SELECT w.n, (SELECT max(g.n) FROM grid g WHERE g.n <= w.n) AS a, (SELECT min(g.n) FROM grid g WHERE g.n > w.n) AS z, (SELECT min(n) FROM grid) AS lo, (SELECT max(n) FROM grid) AS hi FROM w),
s AS (SELECT n, coalesce(a, lo) AS n1, CASE WHEN coalesce(a, lo) = n THEN n ELSE coalesce(z, hi) END AS n2 FROM b),
r AS (SELECT n, n1, n2, CASE WHEN n2 > n1 THEN greatest(0.0e0, least(1.0e0, (n - n1) / CAST(n2 - n1 AS DOUBLE))) ELSE 0.0e0 END AS share FROM s)
SELECT r.n, CAST(x.k AS BIGINT) AS k, round((1 - share) * x.mean + share * y.mean, 4) AS mean, round((1 - share) * x.sd + share * y.sd, 4) AS sd
FROM r JOIN c x ON x.n = r.n1 JOIN c y ON y.n = r.n2 AND y.k = x.k""")
def calibration_curves(spark, sf_dir):
    """Curves for every channel's size, between those of sizes that are multiples of seven; as a stand-in for trials, the
    sorted values of channels of such a size."""
    s = signal(spark, sf_dir)
    sizes = s.groupBy("channel").agg(F.count("*").alias("n"))
    ranks = series.cumulative(s).join(sizes, "channel").withColumn("n", F.floor(F.col("n") / 7) * 7).filter("rank <= n")
    curves = ranks.groupBy("n", F.col("rank").alias("k")).agg(F.avg("x").alias("mean"), F.coalesce(F.stddev_samp("x"), F.lit(0.0)).alias("sd"))
    found = cal.interpolated(sizes, curves)
    return found.select("n", "k", F.round("mean", 4).alias("mean"), F.round("sd", 4).alias("sd"))


# --- arrays


def _cells(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("i2"), F.posexplode("embedding").alias("i1", "v")).select(F.col("i1").cast("long").alias("i1"), "i2", F.col("v").cast("double").alias("value"))


_CELLS = "cells AS (SELECT CAST(i - 1 AS BIGINT) AS i1, vec_id AS i2, CAST(embedding[i] AS DOUBLE) AS value FROM embeddings, range(1, 65) r(i))"


@query(f"WITH {_CELLS} SELECT i2 AS i1, i1 AS i2, value FROM cells")
def transpose(spark, sf_dir):
    return tensor.transpose(_cells(spark, sf_dir))


@query(f"WITH {_CELLS} SELECT (i1 + 64 * i2) % 32 AS i1, ((i1 + 64 * i2) // 32) % 2 AS i2, (i1 + 64 * i2) // 64 AS i3, value FROM cells")
def reshape(spark, sf_dir):
    n = read(spark, sf_dir, "embeddings").count()
    return tensor.reshape(_cells(spark, sf_dir), (64, n), (32, 2, n))


@query(f"WITH {_CELLS} SELECT (i1 + 64 * i2) % 32 AS i1, (i1 + 64 * i2) // 64 AS i2, value FROM cells WHERE ((i1 + 64 * i2) // 32) % 2 = 1")
def plane(spark, sf_dir):
    n = read(spark, sf_dir, "embeddings").count()
    return tensor.plane(tensor.reshape(_cells(spark, sf_dir), (64, n), (32, 2, n)), "i1", "i3", i2=1)


@query(f"WITH {_CELLS}, p AS (SELECT CAST(vec_id % 70 AS BIGINT) AS i1, vec_id AS i2 FROM embeddings) SELECT p.i1, p.i2, coalesce(value, 0.0e0) AS value FROM p LEFT JOIN cells c ON c.i1 = p.i1 AND c.i2 = p.i2")
def values_at(spark, sf_dir):
    places = read(spark, sf_dir, "embeddings").select((F.col("vec_id") % 70).alias("i1"), F.col("vec_id").alias("i2"))
    return tensor.values_at(_cells(spark, sf_dir), places)


@query(f"WITH {_CELLS} SELECT i1, i2, CAST(((CAST(trunc(value * 100000) AS BIGINT) + 32768) % 65536 + 65536) % 65536 - 32768 AS INTEGER) AS value FROM cells")
def as_int16(spark, sf_dir):
    cells = _cells(spark, sf_dir).withColumn("value", F.col("value") * 100000)
    return tensor.as_stored(cells, "int16").withColumn("value", F.col("value").cast("int"))


@query(f"WITH {_CELLS} SELECT CAST(2 AS INTEGER) AS dims, n1 * n2 AS total, n1, n2 FROM (SELECT CAST(max(i1) + 1 AS BIGINT) AS n1, CAST(max(i2) + 1 AS BIGINT) AS n2 FROM cells)")
def array_sizes(spark, sf_dir):
    return tensor.sizes(_cells(spark, sf_dir))


@query("SELECT i AS i1, j AS i2, 0.0e0 AS value FROM range(0, 3) a(i), range(0, (SELECT count(*) FROM embeddings)) b(j)")
def allocate(spark, sf_dir):
    """Zeros for three numbers of every vector."""
    return tensor.allocate(spark, 3, read(spark, sf_dir, "embeddings").count())


@query(f"WITH {_CELLS} SELECT i1, i2, CASE WHEN i1 = i2 % 70 THEN CAST(i2 AS DOUBLE) ELSE value END AS value FROM cells")
def set_values(spark, sf_dir):
    """Some of the updates lie outside the array."""
    updates = read(spark, sf_dir, "embeddings").select((F.col("vec_id") % 70).alias("i1"), F.col("vec_id").alias("i2"), F.col("vec_id").cast("double").alias("value"))
    return tensor.with_values(_cells(spark, sf_dir), updates)


def _stored(spark, sf_dir, kind: str, scale: float, plain: str) -> DataFrame:
    return tensor.as_stored(_cells(spark, sf_dir).withColumn("value", F.col("value") * scale), kind).withColumn("value", F.col("value").cast(plain))


_WRAP = "SELECT i1, i2, CAST((((CAST(trunc(value * {scale}) AS BIGINT) - ({low})) % {span}) + {span}) % {span} + ({low}) AS {kind}) AS value FROM cells"


@query(f"WITH {_CELLS} " + _WRAP.format(scale="10000", low="0", span="256", kind="INTEGER"))
def as_uint8(spark, sf_dir):
    return _stored(spark, sf_dir, "uint8", 10000, "int")


@query(f"WITH {_CELLS} " + _WRAP.format(scale="1000000", low="0", span="65536", kind="INTEGER"))
def as_uint16(spark, sf_dir):
    return _stored(spark, sf_dir, "uint16", 1000000, "int")


@query(f"WITH {_CELLS} " + _WRAP.format(scale="20000000000", low="-2147483648", span="4294967296", kind="INTEGER"))
def as_int32(spark, sf_dir):
    return _stored(spark, sf_dir, "int32", 20000000000, "int")


@query(f"WITH {_CELLS} SELECT i1, i2, CAST(CAST(value * 0.7e0 AS FLOAT) AS DOUBLE) AS value FROM cells")
def as_float32(spark, sf_dir):
    return _stored(spark, sf_dir, "float32", 0.7, "double")


@query(f"WITH {_CELLS} SELECT i1, i2, CAST(CAST(value * 0.7e0 AS FLOAT) AS DOUBLE) AS re, CAST(0 AS DOUBLE) AS im FROM cells")
def as_complex64(spark, sf_dir):
    cells = tensor.as_stored(_cells(spark, sf_dir).withColumn("value", F.col("value") * 0.7), "complex64")
    return cells.select("i1", "i2", F.col("value.re").cast("double").alias("re"), F.col("value.im").cast("double").alias("im"))


@query(f"WITH {_CELLS} SELECT i2 % 8 AS name, (i2 // 8) * 64 + i1 AS idx, CAST(CAST(value AS FLOAT) AS DOUBLE) AS value FROM cells")
def array_files_round_trip(spark, sf_dir):
    """The vectors in eight array files of 32-bit floats, written by the tasks and read by ranges of bytes."""
    n = read(spark, sf_dir, "embeddings").agg(F.max("vec_id")).first()[0] or 0
    cells = _cells(spark, sf_dir).select((F.col("i2") % 8).cast("string").alias("name"), (F.floor(F.col("i2") / 8) * 64 + F.col("i1")).alias("idx"), "value")
    at = shared_folder(spark, "arrays")
    arrays.write_arrays(cells, "name", (64, n // 8 + 1), at)
    # vectors that aren't there were written as zeros
    found = arrays.read_arrays(spark, at, chunk=1000).select(F.regexp_extract("path", r"([0-9]+)\.mda$", 1).cast("long").alias("name"), "idx", "value")
    there = read(spark, sf_dir, "embeddings").select((F.col("vec_id") % 8).alias("name"), F.floor(F.col("vec_id") / 8).alias("slot"))
    return _taken(found.withColumn("slot", F.floor(F.col("idx") / 64)).join(there, ["name", "slot"], "left_semi").select("name", "idx", "value"), at)


@query(f"WITH {_CELLS} SELECT i2 % 3 AS name, (i2 // 3) * 64 + i1 AS idx, CAST(CAST(value AS FLOAT) AS DOUBLE) AS re, CAST(CAST(-value AS FLOAT) AS DOUBLE) AS im FROM cells")
def array_source_round_trip(spark, sf_dir):
    """The vectors as complex numbers in three files of the data source, each written by several tasks."""
    spark.dataSource.register(ArraySource)
    n = read(spark, sf_dir, "embeddings").agg(F.max("vec_id")).first()[0] or 0
    cells = _cells(spark, sf_dir).select((F.col("i2") % 3).cast("string").alias("name"), (F.floor(F.col("i2") / 3) * 64 + F.col("i1")).alias("idx"), "value", (-F.col("value")).alias("im"))
    at = shared_folder(spark, "complex")
    cells.repartition(partitions(spark), "idx").write.format("mda").option("sizes", f"64,{n // 3 + 1}").option("kind", "complex64").mode("append").save(at)
    found = spark.read.format("mda").option("complex", "true").option("chunk", 5000).load(at)
    found = found.select(F.regexp_extract("path", r"([0-9]+)\.mda$", 1).cast("long").alias("name"), "idx", F.col("value").alias("re"), "im")
    there = read(spark, sf_dir, "embeddings").select((F.col("vec_id") % 3).alias("name"), F.floor(F.col("vec_id") / 3).alias("slot"))
    return _taken(found.withColumn("slot", F.floor(F.col("idx") / 64)).join(there, ["name", "slot"], "left_semi").select("name", "idx", "re", "im"), at)


@query("SELECT label, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS BIGINT) AS place, vec_id AS id FROM (SELECT CAST(label AS BIGINT) AS label, vec_id FROM embeddings)")
def label_rows(spark, sf_dir):
    return clusters.label_rows(vectors(spark, sf_dir))


@query(f"WITH {VEC}, moved AS (SELECT id, pos, v, CASE WHEN id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label FROM vec) SELECT label, CAST(pos AS BIGINT) AS pos, round(avg(v), 6) AS mean FROM moved GROUP BY label, pos")
def moved_centroids(spark, sf_dir):
    """Every seventh vector goes to the next label."""
    v = vectors(spark, sf_dir)
    moves = v.filter("id % 7 = 0").select("id", ((F.col("label") + 1) % 10).alias("label"))
    return clusters.moved_centroids(v, moves).withColumn("mean", F.round("mean", 6))


@query(f"""WITH {SIG}, q AS (SELECT channel, x, row_number() OVER (PARTITION BY channel ORDER BY x, t) AS k FROM sig)
SELECT CAST(k AS BIGINT) AS k, count(*) AS n, round(avg(x), 6) AS avg, round(stddev_samp(x), 6) AS sd FROM q GROUP BY k""")
def trial_statistics(spark, sf_dir):
    """Each channel's sorted values are a trial's curve."""
    curves = series.cumulative(signal(spark, sf_dir)).select(F.col("rank").alias("k"), "x")
    return series.across(curves).select("k", "n", F.round("avg", 6).alias("avg"), F.round("sd", 6).alias("sd"))


@query(f"WITH {SIG} SELECT channel, t, x FROM sig WHERE channel % 10 = 3")
def channel_samples(spark, sf_dir):
    """Some channels of a table that is partitioned by channel."""
    s = signal(spark, sf_dir)
    at = shared_folder(spark, "channels")
    channels.split_into_channels(s, at)
    wanted = s.select("channel").distinct().filter("channel % 10 = 3")
    return _taken(channels.read_channels(spark, at, wanted).select(F.col("channel").cast("long").alias("channel"), "t", "x"), at)


@query(f"""WITH {SIG}, {EXT}, lab AS (SELECT DISTINCT channel, CASE WHEN x < 0 THEN 1 ELSE 2 END AS label FROM ext),
neu AS (SELECT CAST(row_number() OVER (ORDER BY channel, label) - 1 AS BIGINT) AS neuron_id, channel, label FROM lab)
SELECT neuron_id, m.channel AS member FROM neu JOIN (SELECT DISTINCT channel FROM sig) m ON abs(m.channel - neu.channel) <= 2""")
def neuron_patches(spark, sf_dir):
    """Users lie on a line, and those up to two apart are a patch."""
    s = signal(spark, sf_dir)
    labels = detect.local_extrema(s, RADIUS).select("channel", F.when(F.col("x") < 0, 1).otherwise(2).alias("label"))
    places = s.select("channel").distinct().select("channel", F.col("channel").cast("double").alias("px"), F.lit(0.0).alias("py"))
    return spatial.neuron_patches(clips.neuron_ids(labels), spatial.adjacency(places, 2.0))


@query(f"""WITH {SIG}, {EXT}, {CLIPS}, lab AS (SELECT c.*, CASE WHEN e.x < 0 THEN 1 ELSE 2 END AS label FROM clips c JOIN ext e ON e.channel = c.channel AND e.t = c.t)
SELECT channel, label, k, round(avg(x), 6) AS v FROM lab WHERE channel % 10 = 3 GROUP BY 1, 2, 3""")
def template_slice(spark, sf_dir):
    """The templates of some channels' neurons on their own channels."""
    s = signal(spark, sf_dir)
    events = detect.local_extrema(s, RADIUS)
    kinds = events.select("channel", "t", F.when(F.col("x") < 0, 1).otherwise(2).alias("label"))
    cut = clips.extract_clips(s, events, SIZE).join(kinds, ["channel", "t"])
    means = clips.mean_template(cut, "channel", "label")
    return means.filter("channel % 10 = 3").select("channel", "label", "k", F.round(F.col("sum_x") / F.col("n"), 6).alias("v"))


# --- sinks, read back


@query(f"WITH {SIG}, {EXT} SELECT channel, CAST(CASE WHEN x < 0 THEN 1 ELSE 2 END AS BIGINT) AS label, t FROM ext")
def spike_times_round_trip(spark, sf_dir):
    """Through a table partitioned by channel and label."""
    at = shared_folder(spark, "times")
    found = detect.local_extrema(signal(spark, sf_dir), RADIUS)
    channels.save_spike_times(found.select("channel", "t", F.when(F.col("x") < 0, 1).otherwise(2).alias("label")), at)
    return _taken(spark.read.parquet(at).select(F.col("channel").cast("long").alias("channel"), F.col("label").cast("long").alias("label"), "t"), at)


@query(f"WITH {VEC} SELECT label AS channel, id AS t, CAST(pos AS BIGINT) AS pos, v FROM vec")
def features_round_trip(spark, sf_dir):
    at = shared_folder(spark, "results")
    results.save_table(vectors(spark, sf_dir).select(F.col("label").alias("channel"), F.col("id").alias("t"), "f"), at, "features")
    rows = spark.read.parquet(f"{at}/features").select("channel", "t", F.posexplode("f").alias("pos", "v"))
    return _taken(rows.withColumn("pos", F.col("pos").cast("long")), at)


@query(f"WITH {EDGES} SELECT * FROM edges")
def edges_round_trip(spark, sf_dir):
    at = shared_folder(spark, "results")
    results.save_table(spatial.adjacency(supplier_places(spark, sf_dir), 100.0), at, "edges")
    return _taken(spark.read.parquet(f"{at}/edges"), at)


@query(f"""WITH {SIG}, {EXT}, m AS (SELECT channel, max(t) AS last FROM sig GROUP BY channel),
lab AS (SELECT channel, t, CASE WHEN x < 0 THEN 1 ELSE 2 END AS label FROM ext),
neu AS (SELECT CAST(row_number() OVER (ORDER BY channel, label) - 1 AS BIGINT) AS neuron_id, channel, label FROM (SELECT DISTINCT channel, label FROM lab))
SELECT n.neuron_id, s.channel AS member, CAST(k.k AS BIGINT) AS k, round(avg(s.x), 6) AS v FROM lab e JOIN neu n ON n.channel = e.channel AND n.label = e.label, range(0, {SIZE}) k(k), sig s, m
WHERE s.t = e.t - {SIZE // 2} + k.k AND m.channel = s.channel AND s.channel % 25 = 1 AND e.t - {SIZE // 2} >= 0 AND e.t + {SIZE - 1 - SIZE // 2} <= m.last GROUP BY 1, 2, 3""")
def shapes_round_trip(spark, sf_dir):
    """The neurons' templates on some channels, and what numbers the neurons."""
    at = shared_folder(spark, "results")
    s = signal(spark, sf_dir)
    labels = detect.local_extrema(s, RADIUS).select("channel", "t", F.when(F.col("x") < 0, 1).otherwise(2).alias("label"))
    labelled = labels.join(clips.neuron_ids(labels), ["channel", "label"]).select("neuron_id", "channel", "t")
    results.save_table(clips.templates(s.filter("channel % 25 = 1"), labelled, SIZE), at, "templates")
    return _taken(spark.read.parquet(f"{at}/templates").withColumn("v", F.round("v", 6)), at)


@query(f"""WITH {SIG}, sized AS (SELECT channel, count(*) AS n FROM sig GROUP BY 1), q AS (SELECT channel, x, row_number() OVER (PARTITION BY channel ORDER BY x, t) AS k FROM sig)
SELECT n // 7 * 7 AS n, CAST(k AS BIGINT) AS k, CAST(min(x) AS DOUBLE) AS mean, CAST(max(x) AS DOUBLE) AS sd FROM q JOIN sized USING (channel) WHERE k <= n // 7 * 7 GROUP BY 1, 2""")
def calibration_round_trip(spark, sf_dir):
    """Through text files, one a size; as a stand-in for means and deviations, the least and the greatest value."""
    s, at = signal(spark, sf_dir), shared_folder(spark, "curves")
    ranks = series.cumulative(s).join(s.groupBy("channel").agg(F.count("*").alias("n")), "channel").withColumn("n", F.floor(F.col("n") / 7) * 7).filter("rank <= n")
    rows = ranks.groupBy("n", "rank").agg(F.min("x").cast("double").alias("mean"), F.max("x").cast("double").alias("sd"))
    curve = F.array_sort(F.collect_list(F.struct("rank", "mean", "sd")))  # a size's places
    table = rows.groupBy("n").agg(curve.alias("c")).select("n", F.transform("c", lambda p: p["mean"]).alias("mean"), F.transform("c", lambda p: p["sd"]).alias("sd"), F.array(F.lit(0.5), F.lit(1.25)).alias("scores"))
    cal.save_text(table, at)
    return _taken(cal.places(cal.load_text(spark, at)), at)


@query(ORACLE_SQL["template_score"].replace("SELECT neuron_id, t, CAST(2 * dot", "SELECT neuron_id, count(*) AS n, CAST(sum(2 * dot").replace("AS DOUBLE) AS score FROM d", ") AS DOUBLE) AS total FROM d GROUP BY 1"))
def scores_round_trip(spark, sf_dir):
    """Through a table partitioned by neuron."""
    at = shared_folder(spark, "scores")
    channels.save_scores(template_score(spark, sf_dir), at)
    return _taken(spark.read.parquet(at).groupBy(F.col("neuron_id").cast("long").alias("neuron_id")).agg(F.count("*").alias("n"), F.round(F.sum("score"), 3).alias("total")), at)


# --- kernels


def _waves(spark, sf_dir):
    s = signal(spark, sf_dir)
    return clips.clip_vectors(clips.extract_clips(s, detect.local_extrema(s, RADIUS), SIZE))


@query()
def pca_features(spark, sf_dir):
    return features.pca_features(_waves(spark, sf_dir), 3)


@query(f"WITH {SIG}, {EXT}, {CLIPS} SELECT channel, t, CAST(sum(x * x) AS DOUBLE) AS energy FROM clips GROUP BY 1, 2")
def pca_energy(spark, sf_dir):
    """A clip's squared coordinates on as many axes as it has numbers, added up: what the clip itself has, if the axes are at
    right angles to each other and of length 1."""
    f = features.pca_features(_waves(spark, sf_dir), SIZE)
    return f.select("channel", "t", F.round(clusters.norm_squared("f"), 2).alias("energy"))


@query()
def calibrate(spark, sf_dir):
    """Curves of uniform samples of every size that a channel of the signal has."""
    return cal.calibrate(signal(spark, sf_dir).groupBy("channel").agg(F.count("*").alias("n")))


def _largest(rows: DataFrame) -> int:
    return int(rows.groupBy("channel").count().agg(F.max("count")).first()[0] or 8)


def _calibration(rows: DataFrame):
    """For all sizes that the largest channel's samples may have."""
    spark = rows.sparkSession
    return cal.collected(cal.calibrate(spark.createDataFrame([(n,) for n in cal.size_grid(_largest(rows))], "n long")))


@query()
def split_channels(spark, sf_dir):
    s = signal(spark, sf_dir)
    return splitting.split_channels(s, _calibration(s))


@query()
def cluster_labels(spark, sf_dir):
    v = vectors(spark, sf_dir).select((F.col("label") % 4).alias("channel"), F.col("id").alias("t"), "f")
    calibration, make = cal.on_demand(spark, _largest(v))
    return splitting.cluster_channels(v, calibration, clusters=8, make=make)


@query()
def kmeans_labels(spark, sf_dir):
    """Ten clusters of the vectors."""
    return kmeans.kmeans(vectors(spark, sf_dir), 10)[0]


@query()
def sort_signal(spark, sf_dir):
    """The whole analysis over the signal; its channels lie on a line, three apart are neighbours."""
    s = signal(spark, sf_dir)
    places = s.select("channel").distinct().select("channel", F.col("channel").cast("double").alias("px"), F.lit(0.0).alias("py"))
    settings = Settings(adjacency_radius=1.0, clip_size=SIZE, critical_time_radius=RADIUS, num_features=3, clusters=4)
    done = sorting.sort_events(s, places, _calibration(s), settings)
    return done.labels.join(done.neurons, ["channel", "label"]).select("neuron_id", "channel", "t", "label")
