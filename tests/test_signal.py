import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pulsegrid.config import Settings, parse
from pulsegrid.functions import isotonic, splitting
from pulsegrid.operators import kmeans, ranges
from pulsegrid.operators import splitting as splits
from pulsegrid.operators import clips, clusters, detect, features, scoring, series, spatial, tensor
from pulsegrid.plans import calibration, sorting

# fixed values: the two known series, with their known results in the tests below
TEXTBOOK = np.array([1.1, 3.2, 5.3, 2.4, 4.5, 6.6, 3.7, 5.8, 7.9, 10.0, 9.2, 11.2, 7.3, 3.4, 5.5, 2.6, 3.7, 1.8])


def samples_of(spark, channels):
    return spark.createDataFrame([(c, t, float(x)) for c, xs in channels.items() for t, x in enumerate(xs)], "channel long, t long, x double")


def extrema(x, r):
    a = np.abs(x)
    return [i for i in range(r, len(a) - r) if (r == 0 and a[i] != 0) or (r and a[i] > a[i - r : i].max() and a[i] >= a[i + 1 : i + r + 1].max())]


def test_extrema_of_a_known_series(spark):
    x = [1, 2, 3, 2, 1, 2, 3, 4, 5, 4, 3, 2, 1, 2, 3, 4, 5, 6, 7, 6, 5, 4, 3, 2, 1]
    for f in (detect.local_extrema, detect.local_extrema_pairwise, detect.local_extrema_blocks):
        assert sorted(r["t"] for r in f(samples_of(spark, {0: x}), 3).collect()) == [8, 18]


@pytest.mark.parametrize("radius", [0, 1, 4])
def test_extrema_agree_with_brute_force(spark, radius):
    rng = np.random.default_rng(radius)
    data = {c: rng.integers(-4, 5, int(rng.integers(1, 80))) for c in range(12)}
    want = sorted((c, i) for c, x in data.items() for i in extrema(x, radius))
    s = samples_of(spark, data)
    assert sorted((r["channel"], r["t"]) for r in detect.local_extrema(s, radius).collect()) == want
    assert sorted((r["channel"], r["t"]) for r in detect.local_extrema_blocks(s, radius, block=7).collect()) == want


def test_clips_are_whole_and_cut_toward_zero(spark):
    s = samples_of(spark, {0: range(10)})
    events = spark.createDataFrame([(0, 1), (0, 5), (0, 8)], "channel long, t long")
    found = {(r["t"], r["k"]): r["x"] for r in clips.extract_clips(s, events, 5).collect()}
    assert found == {(5, k): 3.0 + k for k in range(5)}


def test_adjacency_by_grid_equals_all_pairs(spark):
    rng = np.random.default_rng(3)
    p = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.integers(-30, 30, (60, 2)))]
    got = sorted((r["i"], r["j"]) for r in spatial.adjacency(spark.createDataFrame(p, "channel long, px double, py double"), 10.0).collect())
    assert got == sorted((a[0], b[0]) for a in p for b in p if np.hypot(a[1] - b[1], a[2] - b[2]) <= 10)


def test_scores_are_what_the_identity_says(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(2, 37))
    k = rng.normal(size=(2, 5))
    kernels = spark.createDataFrame([(0, c, i, float(k[c, i])) for c in range(2) for i in range(5)], "neuron_id long, channel long, k long, v double")
    s = samples_of(spark, dict(enumerate(x)))
    got = {r["t"]: r["score"] for r in scoring.match_scores(s, kernels, 5).collect()}
    assert sorted(got) == list(range(37 - 5))
    for t, v in got.items():
        a = x[:, t : t + 5]
        assert v == pytest.approx((a * a).sum() - ((a - k) ** 2).sum())
    small = {(r["neuron_id"], r["t"]): r["dot"] for r in scoring.sliding_dot(s, kernels, 5, block=6).collect()}
    assert all(2 * small[0, t] - (k * k).sum() == pytest.approx(v) for t, v in got.items())
    patch = spark.createDataFrame([(0, 0)], "neuron_id long, channel long")
    for r in scoring.gated_scores(s, kernels, patch, 5).collect():
        assert r["full_score"] == pytest.approx(got[r["t"]] if r["patch_score"] > 0 else r["patch_score"])


def test_isotonic_fits_of_a_textbook_series():
    fit, errors = isotonic.increasing(TEXTBOOK)
    assert np.round(fit, 4).tolist() == [1.1, 3.2, 3.85, 3.85, 4.5, 5.15, 5.15, 5.8, *[6.26] * 10]
    assert np.round(errors, 4)[[3, 6, 10, 12, 17]].tolist() == [4.205, 8.41, 8.73, 16.4575, 107.814]
    assert np.round(isotonic.decreasing(TEXTBOOK), 4).tolist() == [*[6.0154] * 13, 4.45, 4.45, 3.15, 3.15, 1.8]
    peak = isotonic.up_down(TEXTBOOK)
    assert np.round(peak, 4).tolist() == [1.1, 3.2, 3.85, 3.85, 4.5, 5.15, 5.15, 5.8, 7.9, 9.6, 9.6, 11.2, 7.3, 4.45, 4.45, 3.15, 3.15, 1.8]
    assert ((TEXTBOOK - peak) ** 2).sum() == pytest.approx(11.54)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(-9, 9), min_size=1, max_size=25))
def test_isotonic_fit_is_the_max_of_min_means(y):
    y = np.array(y, float)
    fit, errors = isotonic.increasing(y)
    s = np.concatenate(([0], np.cumsum(y)))
    want = [max(min((s[k + 1] - s[i]) / (k + 1 - i) for k in range(j, len(y))) for i in range(j + 1)) for j in range(len(y))]
    assert np.allclose(fit, want)
    assert errors[-1] == pytest.approx(((fit - y) ** 2).sum())
    assert np.allclose(isotonic.increasing(fit)[0], fit)


@pytest.fixture(scope="module")
def small_calibration(spark):
    sizes = spark.createDataFrame([(n,) for n in calibration.size_grid(500, 1.6)], "n long")
    return calibration.collected(calibration.calibrate(sizes, trials=100, length=200))


def test_split_finds_a_gap_and_doubts_uniform_samples(small_calibration):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=150), rng.normal(size=150) + 8])
    label, confidence, cut = splitting.split_line(x, small_calibration)
    assert 3 < cut < 5
    assert confidence > 0.95 and abs((label == 1).sum() - 150) <= 2
    doubts = [splitting.split_line(rng.random(200), small_calibration)[1] for _ in range(40)]
    assert 0.2 < np.mean(doubts) < 0.8
    assert splitting.split_line(np.ones(20), small_calibration)[1] == 0


def test_clusters_of_separated_groups(small_calibration):
    rng = np.random.default_rng(6)
    x = rng.random((500, 4))
    x[:100, 0] += 3
    label = splitting.split_clusters(x, small_calibration, clusters=12)
    assert len(np.unique(label)) == 2 and sorted(np.bincount(label)[1:]) == [100, 400]
    assert len(splitting.split_clusters(np.zeros((0, 2)), small_calibration)) == 0


def test_whole_analysis_finds_planted_templates(spark, small_calibration):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(3, 3000)) * 0.05
    shapes = [np.array([0, 2, 8, 3, 0.0]), np.array([0, -3, -12, -1, 0.0])]
    truth = {}
    for i, t in enumerate(range(20, 2980, 24)):
        x[1, t - 2 : t + 3] += shapes[i % 2]
        truth[t] = i % 2
    places = spark.createDataFrame([(c, float(200 * c), 0.0) for c in range(3)], "channel long, px double, py double")
    s = Settings(adjacency_radius=100.0, clip_size=5, critical_time_radius=8, num_features=2, clusters=6)
    done = sorting.sort_events(samples_of(spark, dict(enumerate(x))), places, small_calibration, s)
    labels = {r["t"]: r["label"] for r in done.labels.filter("channel = 1").collect()}
    assert all(len({labels[t] for t, k in truth.items() if k == kind and t in labels}) == 1 for kind in (0, 1))
    assert len({labels[t] for t in truth if t in labels}) == 2


def test_pca_is_not_centred_and_has_fixed_signs(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(50, 6)) + 5
    rows = spark.createDataFrame([(0, i, v.tolist()) for i, v in enumerate(x)], "channel long, t long, wave array<double>")
    f = np.array([r["f"] for r in features.pca_features(rows, 3).orderBy("t").collect()])
    u, d, _ = np.linalg.svd(x, full_matrices=False)
    assert np.allclose(np.abs(f), np.abs(u[:, :3] * d[:3]))


def test_axes_of_wide_waves_equal_the_decomposition(spark, monkeypatch):
    rng = np.random.default_rng(16)
    monkeypatch.setattr(features, "GRAM_ROWS", 40)
    monkeypatch.setattr(features, "FAN", 2)
    data = {c: rng.normal(size=(n, d)) * (0.8 ** np.arange(d)) @ np.linalg.qr(rng.normal(size=(d, d)))[0] for c, n, d in ((0, 300, 60), (1, 90, 30), (2, 5, 40), (3, 50, 6))}
    rows = spark.createDataFrame([(c, i, v.tolist()) for c, x in data.items() for i, v in enumerate(x)], "channel long, t long, wave array<double>").repartition(4)
    for wide in (10_000, 20):
        got = {r["channel"]: np.array(r["axes"]) for r in features.principal_axes(rows, 3, wide).collect()}
        for c, x in data.items():
            want = np.linalg.svd(x, full_matrices=False)[2][:3]
            assert np.allclose(np.abs((got[c] * want).sum(1)), 1, atol=1e-9) and np.allclose(np.abs(got[c]), np.abs(want), atol=1e-6)
            assert all(a[np.abs(a).argmax()] > 0 for a in got[c])


def blobs(rng, sizes, spread=0.3):
    return np.concatenate([rng.normal(size=(n, 2)) * spread + [6 * i, (i % 2) * 5] for i, n in enumerate(sizes)])


def test_long_channels_are_clustered_whole_and_as_in_memory(spark, small_calibration):
    """Every event takes part, so a group of 0.2 % is found."""
    rng = np.random.default_rng(9)
    x = {0: blobs(rng, (1500, 1400, 6)), 1: blobs(rng, (900, 600)), 2: blobs(rng, (40, 40))}
    x = {c: v[rng.permutation(len(v))] for c, v in x.items()}
    rows = spark.createDataFrame([(c, i, v.tolist()) for c, vs in x.items() for i, v in enumerate(vs)], "channel long, t long, f array<double>").repartition(6)
    got = {(r["channel"], r["t"]): r["label"] for r in splits.cluster_channels(rows, small_calibration, clusters=6, rows=500).collect()}
    assert len(got) == sum(map(len, x.values()))
    for c, v in x.items():
        want = splitting.split_clusters(v, small_calibration, clusters=6)
        assert [got[c, i] for i in range(len(v))] == want.tolist()
    assert 6 in np.bincount([got[0, i] for i in range(len(x[0]))])
    assert splits.cluster_channels(rows.limit(0), small_calibration).count() == 0


@pytest.mark.parametrize("most", [25, 1000])
def test_splits_of_channels_dealt_to_many_tasks_equal_the_kernels(spark, small_calibration, most):
    rng = np.random.default_rng(10)
    data = {0: np.concatenate([rng.normal(size=150), rng.normal(size=120) + 7]), 1: rng.random(200), 2: np.ones(100), 3: rng.integers(0, 9, 150) * 1.0, 4: np.concatenate([rng.random(60), [50.0, 51, 52, 53, 54]]), 5: np.arange(5.0), 6: np.exp(np.arange(40.0) / 9)}
    got = {r["channel"]: r for r in splits.split_channels(samples_of(spark, data).repartition(5), small_calibration, most).collect()}
    assert sorted(got) == sorted(data)
    for c, x in data.items():
        label, sure, cut = splitting.split_line(x, small_calibration)
        low = int((label == 1).sum())
        assert (got[c]["n"], got[c]["low"], got[c]["high"]) == (len(x), low, len(x) - low), c
        assert got[c]["cut"] == pytest.approx(cut) and got[c]["confidence"] == pytest.approx(sure)


def test_rows_in_order_of_ranges(spark):
    rng = np.random.default_rng(11)
    rows = [(c, int(i), int(v)) for c in range(5) for i, v in enumerate(rng.integers(-9, 9, [300, 1, 40, 2, 3][c]))]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    df = spark.createDataFrame([*rows, (None, 1, 1)], "channel long, t long, x long").repartition(3)
    got = {(r["channel"], r["t"]): r for r in ranges.in_order(df, ["x", "t"], "x").collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    assert len(got) == len(rows)
    for c in range(5):
        own = sorted((v, i) for d, i, v in rows if d == c)
        values = [None, *(v for v, _ in own), None]
        for k, (_, i) in enumerate(own):
            r = got[c, i]
            assert (r["rank"], r["n"], r["running"], r["total"], r["down"], r["up"]) == (k, len(own), sum(values[1 : k + 2]), sum(values[1:-1]), values[k], values[k + 2])


@pytest.mark.parametrize(("block", "up_first"), [(1, True), (7, True), (7, False), (1000, False)])
def test_unimodal_fits_by_blocks_equal_the_whole(spark, block, up_first):
    rng = np.random.default_rng(12)
    data = {c: np.cumsum(rng.normal(size=60)) + rng.normal(size=60) for c in range(4)} | {5: np.arange(40.0), 6: -np.arange(30.0), 7: np.zeros(1), 8: np.concatenate([np.arange(25.0), np.arange(25.0)[::-1]]), 9: rng.integers(-2, 3, 50) * 1.0}
    weight = {c: rng.random(len(y)) + 0.1 for c, y in data.items()}
    rows = spark.createDataFrame([(c, t, float(v), float(weight[c][t]), "kept") for c, y in data.items() for t, v in enumerate(y)], "channel long, t long, x double, w double, other string").repartition(4)
    for weighted in (False, True) if block != 1 else (True,):
        got = {(r["channel"], r["t"]): r for r in series.unimodal(rows if weighted else rows.drop("w"), up_first, block).collect()}
        assert len(got) == sum(map(len, data.values())) and all(r["other"] == "kept" for r in got.values())
        for c, y in data.items():
            fit = (isotonic.up_down if up_first else isotonic.down_up)(y, weight[c] if weighted else None)
            assert [got[c, t]["fit"] for t in range(len(y))] == pytest.approx(fit.tolist(), abs=1e-9), c
            assert [got[c, t]["x"] for t in range(len(y))] == pytest.approx(y.tolist())


def plain_increasing(y, w):
    """One value after another, as pools (weight, weighted sum, weighted sum of squares, length)."""
    stack, errors = [], []
    for v, u in zip(y, w):
        new = (u, u * v, u * v * v, 1)
        while stack and stack[-1][1] * new[0] >= new[1] * stack[-1][0]:
            new = tuple(a + b for a, b in zip(stack.pop(), new))
        stack.append(new)
        errors.append(sum(max(0.0, p - t * t / m) for m, t, p, _ in stack))
    return np.repeat([t / m for m, t, _, _ in stack], [n for *_, n in stack]), np.array(errors)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(-9, 9), st.integers(1, 4)), min_size=1, max_size=40), st.sampled_from([1, 2, 7, 1000]))
def test_pooling_together_equals_one_value_after_another(rows, block):
    y, w = (np.array(c, float) for c in zip(*rows))
    fit, errors = plain_increasing(y, w)
    assert np.allclose(isotonic.rising(y, w), fit)
    assert np.allclose(isotonic.prefix_errors(y, w, block=block), errors, atol=1e-9)
    three = np.concatenate([y, y[::-1], y])
    starts = np.array([0, len(y), 2 * len(y)])
    many = isotonic.up_down(three, np.concatenate([w, w[::-1], w]), starts, block)
    assert np.allclose(many[: len(y)], isotonic.up_down(y, w)) and np.allclose(many[len(y) : 2 * len(y)], isotonic.up_down(y[::-1], w[::-1]))


def test_a_ramp_that_falls_at_its_end_takes_few_passes():
    y = np.concatenate([np.arange(50_000.0), np.zeros(100)])
    fit, _ = plain_increasing(y, np.ones(len(y)))[0], None
    assert np.allclose(isotonic.rising(y), fit)


def test_curves_of_many_trials_equal_those_of_one():
    rng = np.random.default_rng(13)
    x = rng.random((30, 45))
    x[3], x[4, :20] = 0.5, 0.25
    curves, cuts = splitting.valley_curves(x, 60)
    for row, curve, cut in zip(x, curves, cuts):
        one, at = splitting.valley_curve(row, 60)
        assert np.allclose(curve, one) and cut == pytest.approx(at)
    assert not splitting.valley_curves(x[:, :7], 60)[0].any()


def test_trials_are_dealt_and_their_moments_meet(spark, monkeypatch):
    sizes = spark.createDataFrame([(30,), (9,), (30,), (5,)], "n long")
    one = {r["n"]: r for r in calibration.calibrate(sizes, trials=50, length=40).collect()}
    monkeypatch.setattr(calibration, "VALUES", 100)
    many = {r["n"]: r for r in calibration.calibrate(sizes, trials=50, length=40).collect()}
    assert sorted(one) == sorted(many) == [5, 9, 30]
    for n, r in one.items():
        curves = np.zeros((50, 40))
        curves[:, : min(n, 40)] = splitting.uniform_curves(n, range(50), min(n, 40), 1)
        assert np.allclose(r["mean"], curves.mean(0)) and np.allclose(r["sd"], curves.std(0, ddof=1))
        assert np.allclose(r["scores"], many[n]["scores"]) and len(r["scores"]) == 50


def test_k_means_from_spread_points(spark):
    rng = np.random.default_rng(14)
    x = np.concatenate([rng.normal(m, 0.1, (n, 2)) for m, n in ((0, 900), (5, 40), (10, 40), (15, 3))])
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, f array<double>").repartition(5)
    labels, centers = kmeans.kmeans(rows, 4)
    got = np.array([r["label"] for r in labels.orderBy("id").collect()])
    assert sorted(np.bincount(got)) == [3, 40, 40, 900]
    gaps = ((x[:, None] - centers[None]) ** 2).sum(2)
    assert (got == gaps.argmin(1)).all() and all(np.allclose(centers[c], x[got == c].mean(0)) for c in range(4))
    few, centers = kmeans.kmeans(spark.createDataFrame([(i, [float(i % 2)]) for i in range(9)], "id long, f array<double>"), 5)
    assert len(centers) == 2 and {(r["id"] % 2, r["label"]) for r in few.collect()} in ({(0, 0), (1, 1)}, {(0, 1), (1, 0)})
    assert kmeans.kmeans(rows.limit(0), 3)[0].count() == 0


def test_lloyd_of_groups_side_by_side_equals_the_kernels(spark):
    rng = np.random.default_rng(15)
    data = {g: rng.normal(size=(120 + 9 * i, 3)) for i, g in enumerate("ab")}
    rows = spark.createDataFrame([(g, v.tolist()) for g, x in data.items() for v in x], "group string, f array<double>").repartition(3)
    start = {g: x[splitting.starting_points(len(x), 5, 1)] for g, x in data.items()}
    centers, sizes = kmeans.lloyd(rows, start)
    for g, x in data.items():
        want = splitting.lloyd(x, 5)
        assert (kmeans.nearest(x, centers[g]) == want).all()
        assert sizes[g] == {c: int(n) for c, n in enumerate(np.bincount(want)) if n}


@pytest.mark.parametrize("rising", [True, False])
def test_monotone_fits_by_blocks_equal_the_whole(spark, rising):
    rng = np.random.default_rng(4)
    data = {c: np.cumsum(rng.normal(0.1 * (c - 2), 1, 90)) + rng.normal(0, 2, 90) for c in range(5)} | {9: np.arange(40.0), 10: -np.arange(40.0), 11: np.zeros(1)}
    got = {(r["channel"], r["t"]): r["fit"] for r in series.monotone(samples_of(spark, data), rising, block=11).collect()}
    for c, y in data.items():
        fit = isotonic.increasing(y)[0] if rising else isotonic.decreasing(y)
        assert [got.pop((c, t)) for t in range(len(y))] == pytest.approx(fit.tolist(), abs=1e-9)
    assert not got and series.monotone(samples_of(spark, {0: [1.0]}).limit(0), rising).count() == 0


def test_spacings_equal_those_of_the_kernel(spark):
    rng = np.random.default_rng(5)
    data = {c: rng.integers(0, 400, 30) for c in range(4)}
    rows = series.spacings(samples_of(spark, data)).collect()
    for c, x in data.items():
        own = sorted((r["i"], r["twice_spacing"] / 2, r["log_density"]) for r in rows if r["channel"] == c)
        want = splitting.spacings(np.unique(x).astype(float))
        assert [s for _, s, _ in own] == want.tolist() and [d for _, _, d in own] == pytest.approx(np.log(1 / want).tolist())


def test_spread_k_means_fills_all_clusters():
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(m, 0.1, (40, 2)) for m in (0, 5, 10, 15)])
    for kernel in (splitting.lloyd_plus, splitting.lloyd):
        label = kernel(x, 4)
        assert label.shape == (160,) and label.min() >= 0 and label.max() <= 3
    label = splitting.lloyd_plus(x, 4)
    assert len(np.unique(label)) == 4 and all(len(np.unique(label[i : i + 40])) == 1 for i in range(0, 160, 40))
    # fewer different points than clusters
    assert len(np.unique(splitting.lloyd_plus(np.ones((6, 2)), 4))) == 1


def test_too_many_centroids_raise(spark, monkeypatch):
    monkeypatch.setattr(clusters, "MOST_CENTROIDS", 1)
    v = spark.createDataFrame([(1, 1, [0.0]), (2, 2, [1.0])], "id long, label long, f array<double>")
    with pytest.raises(ValueError):
        clusters.nearest_centroid(v, clusters.centroids(v))


def test_arrays(spark):
    cells = tensor.from_linear(spark.range(24).selectExpr("id as idx", "cast(id as double) as value"), 2, 3, 4)
    got = {(r["i1"], r["i2"], r["i3"]): r["value"] for r in tensor.reshape(cells, (2, 3, 4), (4, 3, 2)).collect()}
    assert got == {(i, j, k): float(i + 4 * j + 12 * k) for i in range(4) for j in range(3) for k in range(2)}
    assert tensor.transpose(tensor.transpose(cells)).exceptAll(cells).count() == 0
    assert tensor.plane(cells, "i1", "i3", i2=1).count() == 8
    assert tensor.with_value(cells, 9.0, i1=0, i2=0, i3=0).filter("value = 9").count() == 2
    assert tensor.allocate(spark, 2, 2).agg({"value": "sum"}).first()[0] == 0
    with pytest.raises(ValueError):
        tensor.reshape(cells, (2, 3, 4), (5, 5))
    wrapped = spark.createDataFrame([(300.7,), (-1.5,), (70000.0,)], "value double")
    assert [r["value"] for r in tensor.as_stored(wrapped, "uint8").collect()] == [44, 255, 112]
    assert [r["value"] for r in tensor.as_stored(wrapped, "uint16").collect()] == [300, 65535, 4464]


def test_cluster_operators(spark):
    v = spark.createDataFrame([(0, 5, [3.0, 4.0]), (1, 5, [3.0, 2.0]), (2, 9, [0.0, 0.0]), (3, 7, [10.0, 0.0])], "id long, label long, f array<double>")
    assert {(r["id"], r["label"]) for r in clusters.dense_relabel(v).collect()} == {(0, 1), (1, 1), (2, 3), (3, 2)}
    assert {(r["id"], r["label"]) for r in clusters.drop_two_closest(v).collect()} == {(0, 0), (1, 0), (2, 0), (3, 1)}
    assert {(r["id"], r["nearest"]) for r in clusters.nearest_centroid(v, clusters.centroids(v)).collect()} == {(0, 5), (1, 5), (2, 9), (3, 7)}
    assert [r["n"] for r in v.select(clusters.normalised("f").alias("n")).collect()][2] == [0.0, 0.0]
    assert clusters.random_rows(v, "label", "id", 1).count() == 3


def test_settings():
    positional, s = parse(["sort", "in", "--clip-size=7", "--clip-size=9"])
    assert positional == ["sort", "in"] and s.clip_size == 9 and s.adjacency_radius == 100.0
    with pytest.raises(SystemExit):
        parse(["--nothing=1"])
    with pytest.raises(ValueError):
        Settings(detect_on="x")


def test_neurons_of_few_samples_share_a_group(spark, monkeypatch):
    from pulsegrid.operators import scoring

    n, length, shape = 60, 50, (2.0, -1.0, 3.0)
    x = np.random.default_rng(3).integers(-9, 10, (n, length)).astype(float)
    samples = spark.createDataFrame([(c, t, float(x[c, t])) for c in range(n) for t in range(length - c % 7)], "channel long, t long, x double")
    kernels = spark.createDataFrame([(c // 2, c, k, v * (c + 1)) for c in range(n) for k, v in enumerate(shape)], "neuron_id long, channel long, k int, v double")
    for c in range(n):
        x[c, length - c % 7 :] = 0
    want = {}
    for g in range(n // 2):
        last = max(length - c % 7 for c in (2 * g, 2 * g + 1)) - 1
        for t in range(min(last + 1, length - 3)):
            want[g, t] = sum(v * (c + 1) * (x[c, t + k] if t + k < length else 0.0) for c in (2 * g, 2 * g + 1) for k, v in enumerate(shape))
    for own, shared in ((scoring.OWN, True), (0, False)):
        monkeypatch.setattr(scoring, "OWN", own)
        found = scoring.sliding_dot(samples, kernels, 3, block=16)
        assert ("pmod(xxhash64" in found._jdf.queryExecution().toString()) is shared
        got = {(r["neuron_id"], r["t"]): r["dot"] for r in found.collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_a_calibration_made_on_demand_gives_the_same_clusters(spark, monkeypatch):
    from pulsegrid.operators import splitting as splits
    from pulsegrid.plans import calibration as cal

    monkeypatch.setattr(cal, "SMALL", 0)
    rng, small = np.random.default_rng(4), {"trials": 20, "length": 50}
    rows = spark.createDataFrame([(c, t, (rng.normal(size=2) + 8 * (t % (c + 1))).tolist()) for c in range(3) for t in range(60 + 30 * c)], "channel long, t long, f array<double>")
    full = cal.collected(cal.calibrate(spark.createDataFrame([(n,) for n in cal.size_grid(120)], "n long"), **small))
    want = sorted(map(tuple, splits.cluster_channels(rows, full, clusters=5).collect()))
    for most in (None, 80):  # with a channel that no task holds too
        some, make = cal.on_demand(spark, 120, **small)
        assert sorted(map(tuple, splits.cluster_channels(rows, some, clusters=5, rows=most, make=make).collect())) == want
        assert 0 < len(some.mean) < len(some.grid) // 2
        assert all((some.mean[n] == full.mean[n]).all() and (some.scores[n] == full.scores[n]).all() for n in some.mean)


@pytest.mark.parametrize("small", [False, True])
def test_sums_of_clips_of_all_channels_hold_no_row_a_sample(spark, monkeypatch, small):
    from pulsegrid.operators import clips

    if small:  # many blocks, of time too
        for name, n in (("NEURONS", 3), ("MEMBERS", 2), ("TIMES", 16), ("AT_ONCE", 4)):
            monkeypatch.setattr(clips, name, n)
    rng = np.random.default_rng(6)
    # channels that end early, one with a gap, one with a null, one with nulls alone
    x = [(c, t, None if c == 6 or (c, t) == (5, 20) else int(rng.integers(-9, 10))) for c in range(7) for t in range(70 - 5 * c) if (c, t) != (4, 30)]
    samples = spark.createDataFrame(x, "channel long, t long, x long")
    events = spark.createDataFrame([(n, int(t)) for n in range(8) for t in rng.integers(0, 70, 9)] + [(None, 12)], "neuron long, t long")
    cut = clips.extract_clips(samples, events.withColumnRenamed("neuron", "channel"), 8, on_channel=False).withColumnRenamed("channel", "neuron")
    key = lambda df: sorted(map(tuple, df.select("neuron", "member", "k", "sum_x", "n").collect()), key=repr)
    found = clips.crossed_sums(samples, events, 8, "neuron")
    assert key(found) == key(clips.mean_template(cut, "neuron", "member"))
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString().split("FlatMapCoGroups")[0]
