import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.plans import calibration
from pulsegrid.sources import arrays, channels
from pulsegrid.sources.array_source import ArraySource
from pulsegrid.streaming.extrema import stream_extrema


@pytest.mark.parametrize("kind", ["complex64", "uint8", "float32", "int16", "int32", "uint16"])
def test_array_files_come_back(spark, tmp_path, kind):
    values = np.arange(24) * 3.0
    cells = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(values)], "name string, idx long, value double")
    assert arrays.save_files(arrays.array_files(cells, "name", (2, 3, 4), kind), str(tmp_path)) == 1
    got = sorted((r["idx"], r["value"], tuple(r["sizes"])) for r in arrays.read_arrays(spark, str(tmp_path), chunk=5).collect())
    assert got == [(i, v, (2, 3, 4)) for i, v in enumerate(values.tolist())]


def test_a_file_of_several_ranges_and_gaps_comes_back(spark, tmp_path):
    n = 5000
    cells = spark.range(n).filter("id % 7 <> 3").selectExpr("if(id % 2 = 0, 'a', 'b') as name", "id as idx", "cast(id as double) / 4 as value").repartition(5)
    assert arrays.write_arrays(cells, "name", (50, 100), str(tmp_path)) == 2
    read = arrays.read_arrays(spark, str(tmp_path), chunk=64)
    got = {(r["path"][-5], r["idx"]): r["value"] for r in read.collect()}
    there = {("ab"[i % 2], i): i / 4 for i in range(n) if i % 7 != 3}
    assert got == {(name, i): there.get((name, i), 0.0) for name in "ab" for i in range(n)}
    # the ranges are tasks of their own, and the driver holds none of them
    assert read.rdd.getNumPartitions() > 1
    with pytest.raises(Exception, match="outside"):
        arrays.write_arrays(cells.withColumn("idx", F.col("idx") + 1), "name", (50, 100), str(tmp_path / "x"))
    assert arrays.write_arrays(cells.limit(0), "name", (50, 100), str(tmp_path / "y")) == 0


def test_complex_values_are_kept(spark, tmp_path):
    cells = spark.createDataFrame([("z", 0, 1.5, -2.0), ("z", 2, 0.5, 4.0)], "name string, idx long, value double, im double")
    arrays.write_arrays(cells, "name", (3, 1), str(tmp_path), "complex64", im_col="im")
    got = sorted((r["idx"], r["value"], r["im"]) for r in arrays.read_arrays(spark, str(tmp_path), keep_complex=True).collect())
    assert got == [(0, 1.5, -2.0), (1, 0.0, 0.0), (2, 0.5, 4.0)]


def test_broken_files_raise(spark, tmp_path):
    (tmp_path / "short.mda").write_bytes(arrays.encode(np.zeros(9), (3, 3))[:-2])
    with pytest.raises(Exception, match="shorter"):
        arrays.read_arrays(spark, str(tmp_path)).count()
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        arrays.read_arrays(spark, str(tmp_path / "none")).count()


def test_calibrations_are_kept_and_read_again(spark, tmp_path):
    table = calibration.calibrate(spark.createDataFrame([(9,), (20,)], "n long"), trials=6, length=10)
    calibration.save(table, str(tmp_path / "p"))
    assert sorted(map(tuple, calibration.load(spark, str(tmp_path / "p")).collect())) == sorted(map(tuple, table.collect()))
    assert calibration.save_text(table, str(tmp_path / "t")) == 2
    text = (tmp_path / "t" / "calibration_20.txt").read_text().split("\n")
    assert text[:2] == ["10", "6"] and len(text) == 2 + 10 + 6 + 1
    (tmp_path / "t" / "other_3.txt").write_text("nothing")
    got, want = calibration.collected(calibration.load_text(spark, str(tmp_path / "t"))), calibration.collected(table)
    assert sorted(got.mean) == [9, 20]
    for n in (9, 20):
        assert all(np.allclose(x[n], y[n], atol=1e-4) for x, y in ((got.mean, want.mean), (got.sd, want.sd), (got.scores, want.scores)))


def test_results_are_kept_and_read_again(spark, tmp_path):
    from pulsegrid.plans.sorting import Sorted
    from pulsegrid.sources import results

    rows = spark.range(6).selectExpr("cast(id % 2 as int) as i", "id as j", "id % 2 as channel", "id as t", "id % 3 as label", "id as neuron_id", "id as member", "id as k", "array(1.0d) as f")
    done = Sorted(*(rows.select(*cols) for cols in (("i", "j"), ("channel", "t"), ("channel", "t", "f"), ("channel", "t", "label"), ("neuron_id", "channel", "label"), ("neuron_id", "member", "k"))))
    results.save_results(done, str(tmp_path / "r"))
    again = results.read_results(spark, str(tmp_path / "r"))
    for name in ("edges", "events", "features", "labels", "neurons", "templates"):
        a, b = getattr(done, name), getattr(again, name)
        assert a.columns == b.columns and sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.collect()), key=repr)


def test_recordings_and_headers(spark, tmp_path):
    (tmp_path / "r.mda").write_bytes(arrays.encode(np.arange(6.0), (2, 3)))
    got = sorted(tuple(r) for r in arrays.read_recording(spark, str(tmp_path)).collect())
    assert got == [(c, t, float(c + 2 * t)) for c in range(2) for t in range(3)]
    older = np.array([2, 2, 1], "<i4").tobytes() + np.array([1 + 2j, 3 - 1j], "<c8").tobytes()
    assert arrays.decode(older)[1].tolist() == [1.0, 3.0]
    for bad in (b"", b"\0" * 12, np.array([-9, 4, 1, 1], "<i4").tobytes(), arrays.encode(np.zeros(4), (4,))[:-1]):
        with pytest.raises(ValueError):
            arrays.decode(bad)


def test_channels_are_read_alone(spark, tmp_path):
    s = spark.range(40).selectExpr("id % 4 as channel", "id div 4 as t", "cast(id as double) as x")
    channels.split_into_channels(s, str(tmp_path / "c"))
    one = channels.read_channels(spark, str(tmp_path / "c"), [2])
    assert one.count() == 10 and "PartitionFilters: [isnotnull(channel" in one._jdf.queryExecution().toString().replace("PartitionFilters: [channel", "PartitionFilters: [isnotnull(channel")
    labels = spark.createDataFrame([(0, 1, 1), (0, 2, 2)], "channel long, t long, label long")
    channels.save_spike_times(labels, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2


def test_many_channels_share_folders(spark, tmp_path):
    n = 2 * channels.FOLDERS
    s = spark.range(3 * n).selectExpr(f"id % {n} as channel", f"id div {n} as t", "cast(id as double) as x")
    channels.split_into_channels(s, str(tmp_path / "c"))
    channels.save_spike_times(s.selectExpr("channel", "t", "t % 2 as label"), str(tmp_path / "t"))
    channels.save_scores(s.selectExpr("channel as neuron_id", "t", "x as score"), str(tmp_path / "s"))
    for at in "cts":
        assert 1 < len(list((tmp_path / at).glob("*=*"))) <= channels.PARTS
    want = {(i % n, i // n, float(i)) for i in range(3 * n)}
    rows = lambda df: sorted(map(tuple, df.select("channel", "t", "x").collect()))
    assert rows(channels.read_channels(spark, str(tmp_path / "c"))) == sorted(want)
    few = channels.read_channels(spark, str(tmp_path / "c"), [5, 17])
    assert rows(few) == sorted(w for w in want if w[0] in (5, 17)) and "part#" in few._jdf.queryExecution().toString().split("PartitionFilters: ")[1].split("PushedFilters")[0]
    for own in (list(range(n - 1)), spark.range(n - 1).withColumnRenamed("id", "channel")):
        assert rows(channels.read_channels(spark, str(tmp_path / "c"), own)) == sorted(w for w in want if w[0] < n - 1)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "t")).select("channel", "label", "t").collect())) == sorted((c, t % 2, t) for c, t, _ in want)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "s")).select("neuron_id", "t", "score").collect())) == sorted(want)


def test_stream_finds_what_a_batch_finds(spark, tmp_path):
    rng = np.random.default_rng(1)
    x = rng.integers(-5, 6, 120).astype(float)
    for i in range(4):
        part = [(0, t, float(x[t])) for t in range(30 * i, 30 * i + 30)]
        spark.createDataFrame(part, "channel long, t long, x double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("channel long, t long, x double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stream_extrema(stream, 3).writeStream.format("memory").queryName("found_extrema").outputMode("append").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    a = np.abs(x)
    want = [i for i in range(3, 117) if a[i] > a[i - 3 : i].max() and a[i] >= a[i + 1 : i + 4].max()]
    assert sorted(r["t"] for r in spark.table("found_extrema").collect()) == want


def test_a_late_sample_of_a_stream_is_an_error(spark, tmp_path):
    for k, times in enumerate((range(20), [5], range(20, 30))):
        spark.createDataFrame([(0, t, 1.0) for t in times], "channel long, t long, x double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("channel long, t long, x double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stream_extrema(stream, 3).writeStream.format("memory").queryName("late_extrema").outputMode("append").start()
    with pytest.raises(Exception, match="late or repeated"):
        q.processAllAvailable()
    q.stop()


def test_the_data_source_writes_one_file_from_several_tasks(spark, tmp_path):
    spark.dataSource.register(ArraySource)
    n = 5000
    cells = spark.range(n).filter("id % 7 <> 3").selectExpr("if(id % 3 = 0, 'a', 'b') as name", "id as idx", "cast(id as double) / 4 as value").repartition(5)
    cells.write.format("mda").option("sizes", "50,100").mode("append").save(str(tmp_path / "s"))
    arrays.write_arrays(cells, "name", (50, 100), str(tmp_path / "w"))
    for name in ("a", "b"):
        assert (tmp_path / "s" / f"{name}.mda").read_bytes() == (tmp_path / "w" / f"{name}.mda").read_bytes()
    assert sorted(f.name for f in (tmp_path / "s").iterdir()) == ["a.mda", "b.mda"]
    read = spark.read.format("mda").option("chunk", 64).load(str(tmp_path / "s"))
    assert read.rdd.getNumPartitions() == 2 * -(-n // 64)
    got = {(r["path"][-5], r["idx"]): (r["value"], tuple(r["sizes"])) for r in read.collect()}
    there = {("a" if i % 3 == 0 else "b", i): i / 4 for i in range(n) if i % 7 != 3}
    assert got == {(name, i): (there.get((name, i), 0.0), (50, 100)) for name in "ab" for i in range(n)}
    # again, in place of what stood there
    spark.range(6).selectExpr("'c' as name", "id as idx", "cast(id as double) as value").write.format("mda").option("sizes", "6").option("kind", "uint8").mode("overwrite").save(str(tmp_path / "s"))
    assert [f.name for f in (tmp_path / "s").iterdir()] == ["c.mda"]
    assert sorted((r["idx"], r["value"]) for r in spark.read.format("mda").load(str(tmp_path / "s")).collect()) == [(i, float(i)) for i in range(6)]
    with pytest.raises(Exception, match="outside"):
        cells.write.format("mda").option("sizes", "10").mode("append").save(str(tmp_path / "s"))
    assert [f.name for f in (tmp_path / "s").iterdir()] == ["c.mda"]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.format("mda").load(str(tmp_path / "none")).count()


def test_the_data_source_keeps_complex_values_and_plans_few_ranges(spark, tmp_path):
    spark.dataSource.register(ArraySource)
    rows = [("z", i, float(i), -float(i)) for i in range(1000)]
    df = spark.createDataFrame(rows, "name string, idx long, value double, im double").repartition(3)
    df.write.format("mda").option("sizes", "10,100").option("kind", "complex64").mode("append").save(str(tmp_path))
    read = spark.read.format("mda").option("complex", "true").option("chunk", 100).load(str(tmp_path))
    assert sorted((r["idx"], r["value"], r["im"]) for r in read.collect()) == [(i, v, w) for _, i, v, w in rows]
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    pushing = spark.read.format("mda").option("complex", "true").option("chunk", 100).option("pushdown", "true").load(str(tmp_path))
    few = pushing.filter("idx >= 250 and idx < 420")
    assert few.count() == 170 and few.rdd.getNumPartitions() == 3
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_what_a_neuron_is_scored_with_is_written(spark, tmp_path):
    from pulsegrid.plans.sorting import Sorted
    from pulsegrid.sources.debug import save_debug

    rng = np.random.default_rng(2)
    x, v = rng.integers(-9, 9, (3, 50)) * 1.0, rng.integers(-3, 4, (3, 4)) * 1.0
    samples = spark.createDataFrame([(c, t, float(x[c, t])) for c in range(3) for t in range(50)], "channel long, t long, x double")
    edges = spark.createDataFrame([(0, 0), (1, 0), (1, 1), (1, 2), (2, 2), (2, 1)], "i long, j long")
    neurons = spark.createDataFrame([(0, 0, 1), (1, 2, 1)], "neuron_id long, channel long, label long")
    templates = spark.createDataFrame([(1, c, k, float(v[c, k])) for c in range(3) for k in range(4)], "neuron_id long, member long, k long, v double")
    save_debug(samples, Sorted(edges, neurons, neurons, neurons, neurons, templates), 1, 4, str(tmp_path))
    got = {f.name: arrays.decode(f.read_bytes()) for f in tmp_path.iterdir()}
    want = {"shape": v, "patch_shape": v[1:], "patch_data": x[1:], "convolution": np.append(np.array([(x[1:, t : t + 4] * v[1:]).sum() for t in range(46)]), np.zeros(4))[None]}
    assert sorted(got) == sorted(f"1-{n}.mda" for n in want)
    for name, a in want.items():
        sizes, values = got[f"1-{name}.mda"]
        assert sizes == a.shape and np.allclose(values.reshape(sizes, order="F"), a), name


@pytest.mark.parametrize("late", ["drop", "divert"])
def test_repeated_samples_of_a_stream_are_left_out(spark, tmp_path, late):
    rng = np.random.default_rng(3)
    x = rng.integers(-5, 6, 90).astype(float)
    odd = []
    for i in range(3):
        part = [(0, t, float(x[t])) for t in range(30 * i, 30 * i + 30)]
        again = [(0, t, 99.0) for t in (30 * i - 3, 30 * i + 5) if t >= 0]  # one from before, one from this batch
        odd += [t for _, t, _ in again]
        spark.createDataFrame([*part, *again], "channel long, t long, x double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("channel long, t long, x double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stream_extrema(stream, 3, late).writeStream.format("memory").queryName(f"again_{late}").outputMode("append").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    rows = spark.table(f"again_{late}").collect()
    a = np.abs(x)
    want = [i for i in range(3, 87) if a[i] > a[i - 3 : i].max() and a[i] >= a[i + 1 : i + 4].max()]
    assert sorted(r["t"] for r in rows if late == "drop" or not r["late"]) == want
    if late == "divert":
        assert sorted(r["t"] for r in rows if r["late"]) == sorted(odd)
    with pytest.raises(ValueError):
        stream_extrema(stream, 3, "sometimes")
