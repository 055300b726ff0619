"""Images, windows over pixels, detection targets, record sources, spectra and stream state against plain loops."""

import gzip
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.operators import detection, images, pixels, spectra
from millrace.sources import records
from millrace.streaming import stopping

SCHEMA = "id long, c int, h int, w int, pixels array<double>"


def frame(spark, stacks):
    return spark.createDataFrame([(k, *x.shape, x.reshape(-1).tolist()) for k, x in enumerate(stacks)], SCHEMA)


def arrays(df):
    return {r["id"]: np.array(r["pixels"]).reshape(r["c"], r["h"], r["w"]) for r in df.collect()}


@pytest.fixture(scope="module")
def stacks():
    rng = np.random.default_rng(1)
    return [rng.random((3, 6, 6)), rng.random((1, 5, 9)), rng.random((3, 6, 6)), rng.random((2, 7, 4))]


def plain_sample(img, y, x, mode, padding):
    c, h, w = img.shape
    if mode == "nearest":
        yi, xi = round(y), round(x)  # half to even, as rint
        ok = 0 <= yi < h and 0 <= xi < w
        return img[:, min(max(yi, 0), h - 1), min(max(xi, 0), w - 1)] * (1.0 if ok or padding == "border" else 0.0)
    y0, x0 = math.floor(y), math.floor(x)
    total, seen = np.zeros(c), 0.0
    for yy, wy in ((y0, 1 - (y - y0)), (y0 + 1, y - y0)):
        for xx, wx in ((x0, 1 - (x - x0)), (x0 + 1, x - x0)):
            total += wy * wx * img[:, min(max(yy, 0), h - 1), min(max(xx, 0), w - 1)]
            seen += wy * wx * (0 <= yy < h and 0 <= xx < w)
    return total * (1.0 if seen > 0 or padding == "border" else 0.0)


@pytest.mark.parametrize("mode", ["bilinear", "nearest"])
@pytest.mark.parametrize("padding", ["zeros", "border"])
def test_warps_against_a_loop(spark, stacks, mode, padding):
    df = frame(spark, stacks)
    ms = {r["id"]: np.array(r["m"]) for r in df.select("id", images.affinity("id", 40, 0.4).alias("m")).collect()}
    found = arrays(images.warped(df, images.affinity("id", 40, 0.4), 5, 7, mode, padding))
    for k, img in enumerate(stacks):
        m = ms[k].reshape(2, 3)
        for y in range(5):
            for x in range(7):
                u, v = m @ [x, y, 1]
                assert np.allclose(found[k][:, y, x], plain_sample(img, v, u, mode, padding), atol=1e-12)


def test_identity_quarter_turns_and_sizes(spark, stacks):
    df = frame(spark, stacks)
    same = arrays(images.warped(df, F.array(*[F.lit(float(v)) for v in (1, 0, 0, 0, 1, 0)])))
    assert all((same[k] == x).all() for k, x in enumerate(stacks))
    square = frame(spark, [stacks[0], stacks[2]])
    for n in range(4):
        found = arrays(images.warped(square, images.quarter_turns(n)))
        assert (found[0] == np.rot90(stacks[0], n, (1, 2))).all() or (found[0] == np.rot90(stacks[0], -n, (1, 2))).all()
    back = images.warped(images.warped(square, images.quarter_turns(1)), images.quarter_turns(3))
    assert (arrays(back)[0] == stacks[0]).all()
    small = arrays(images.resized(df, 4, 5))
    for k, img in enumerate(stacks):
        c, h, w = img.shape
        want = np.array([[plain_sample(img, y * (h - 1) / 3, x * (w - 1) / 4, "bilinear", "border") for x in range(5)] for y in range(4)])
        assert np.allclose(small[k], np.moveaxis(want, 2, 0), atol=1e-12)


def test_perspective_maps_corners(spark, stacks):
    to = np.array([[[0, 0], [5, 0], [5, 5], [0, 5]]], float)
    of = np.array([[[0.5, 1], [4, 0.2], [5, 4.4], [-0.3, 5]]], float)
    m = images.homographies(to, of).reshape(3, 3)
    for (x, y), (u, v) in zip(to[0], of[0]):
        p = m @ [x, y, 1]
        assert np.allclose(p[:2] / p[2], [u, v])
    df = frame(spark, stacks[:1])
    found = arrays(images.perspective(df, F.array(*[F.lit(float(v)) for v in of.reshape(-1)])))[0]
    for y in range(6):
        for x in range(6):
            p = m @ [x, y, 1]
            assert np.allclose(found[:, y, x], plain_sample(stacks[0], p[1] / p[2], p[0] / p[2], "bilinear", "zeros"), atol=1e-9)


def test_crops_flips_and_odd_rows(spark, stacks):
    df = frame(spark, stacks)
    five = {(r["id"], r["crop"]): np.array(r["pixels"]).reshape(r["c"], r["h"], r["w"]) for r in images.corner_crops(df, 3, 4, mirrored=True).collect()}
    x = stacks[1]
    for crop, part in enumerate([x[:, :3, :4], x[:, :3, 5:], x[:, 2:, :4], x[:, 2:, 5:], x[:, 1:4, 2:6]]):
        assert (five[1, crop] == part).all() and (five[1, crop + 5] == part[..., ::-1]).all()
    both = arrays(images.flipped(df, F.col("id") > 0, F.col("id") == 1))
    assert (both[0] == stacks[0]).all() and (both[1] == stacks[1][:, ::-1, ::-1]).all() and (both[2] == stacks[2][..., ::-1]).all()
    padded = arrays(images.crop_padded(df, "id", 6, 6, 2))
    assert padded[0].shape == (3, 6, 6) and arrays(images.centre_cropped(df, 2, 2))[3].shape == (2, 2, 2)
    odd = spark.createDataFrame([(0, 1, 2, 2, None), (1, None, 2, 2, [1.0] * 4), (2, 1, 2, 2, [1.0] * 3), (3, 1, 2, 2, [1.0, 2.0, 3.0, 4.0])], SCHEMA)
    assert {r["id"]: r["pixels"] for r in images.inverted(odd).collect()} == {0: None, 1: None, 2: None, 3: [0.0, -1.0, -2.0, -3.0]}
    assert images.inverted(odd.limit(0)).count() == 0


def test_changes_of_values(spark, stacks):
    df = frame(spark, stacks)
    x = stacks[0]
    assert np.allclose(arrays(images.normalized(frame(spark, stacks[:1]), [0.1, 0.2, 0.3], [1, 2, 4], 0))[0], (x - np.array([0.1, 0.2, 0.3])[:, None, None]) / np.array([1, 2, 4])[:, None, None])
    assert np.allclose(arrays(images.solarized(df))[0], np.where(x >= 0.5, 1 - x, x))
    assert np.allclose(arrays(images.posterized(df, 2))[0], np.round(x * 3) / 3)
    luminance = 0.2989 * x[0] + 0.587 * x[1] + 0.114 * x[2]
    assert np.allclose(arrays(images.greyed(df))[0], luminance[None].repeat(3, 0)) and (arrays(images.greyed(df))[1] == stacks[1]).all()
    equal = arrays(images.equalized(df, 8))[1][0]
    counts = np.cumsum(np.histogram(stacks[1][0], 8, (0, 1))[0]) / 45
    assert np.allclose(equal, counts[np.minimum((stacks[1][0] * 7).astype(int), 7)])
    assert np.allclose(arrays(images.colour_jittered(df, "id"))[0], x)  # nothing is asked for
    for f in (lambda d: images.noisy(d, "id"), lambda d: images.erased(d, "id"), lambda d: images.elastic(d, "id"), lambda d: pixels.blurred(d, "id"), lambda d: images.colour_jittered(d, "id", 0.2, 0.2, 0.2, 0.2)):
        once, again = arrays(f(df)), arrays(f(df.repartition(3)))
        assert all((once[k] == again[k]).all() and not np.allclose(once[k], stacks[k]) and once[k].min() >= -1e-12 and once[k].max() <= 1 + 1e-12 for k in once)
    erased = arrays(images.erased(df, "id", value=0.0))
    assert all((erased[k] == 0).any() and ((erased[k] == stacks[k]) | (erased[k] == 0)).all() for k in erased)
    dropped = arrays(images.channel_dropped(df, "id"))
    assert sum((dropped[0][c] == 0).all() for c in range(3)) == 1 and (dropped[1] == stacks[1]).all()
    grid = arrays(images.grid_masked(df, "id", 3, 3))
    assert all(((grid[k] == 0) | (grid[k] == stacks[k])).all() and (grid[k] == 0).any() for k in grid)
    part = images.chance_of(df, images.inverted, "id", 0.5)
    assert part.count() == 4


def test_cut_and_mix(spark, stacks):
    df = frame(spark, [stacks[0], stacks[2]])
    pairs = df.withColumn("other", F.transform("pixels", lambda x: x + 10))
    for r in images.cut_mixed(pairs, "id", seed=3).collect():
        x, y = stacks[2 * r["id"]], np.array(r["pixels"]).reshape(3, 6, 6)
        foreign = y >= 10
        assert ((y == x) | np.isclose(y, x + 10)).all() and (foreign == foreign[:1]).all()
        assert r["kept"] == pytest.approx(1 - foreign.mean())


# windows


def plain_filter(x, line):
    r = len(line) // 2
    out = np.zeros_like(x)
    for y in range(x.shape[1]):
        for c in range(x.shape[2]):
            for i, a in enumerate(line):
                for j, b in enumerate(line):
                    if 0 <= y + i - r < x.shape[1] and 0 <= c + j - r < x.shape[2]:
                        out[:, y, c] += a * b * x[:, y + i - r, c + j - r]
    return out


def test_filters_whole_and_by_tiles(spark, stacks):
    line = pixels.gaussian(2, 1.3)
    want = [plain_filter(x, line) for x in stacks]
    whole = arrays(pixels.filtered(frame(spark, stacks), line, line))
    assert all(np.allclose(whole[k], w, atol=1e-12) for k, w in enumerate(want))
    tiles = pixels.tile_filtered(pixels.tiled(frame(spark, stacks), "id", 3), "id", line, line)
    got = [np.full(x.shape, np.nan) for x in stacks]
    for r in tiles.collect():
        got[r["id"]][:, 3 * r["ty"] : 3 * r["ty"] + r["h"], 3 * r["tx"] : 3 * r["tx"] + r["w"]] = np.array(r["pixels"]).reshape(r["c"], r["h"], r["w"])
    assert all(np.allclose(g, w, atol=1e-12) for g, w in zip(got, want))


@pytest.mark.parametrize("size", [3, 11])
def test_similarity_against_convolutions(spark, stacks, size):
    x, y = stacks[0], stacks[2]
    line = np.exp(-((np.arange(size) - size // 2) ** 2) / 4.5)
    line /= line.sum()
    blur = lambda z: np.apply_along_axis(np.convolve, 1, np.apply_along_axis(np.convolve, 2, z, line, "same"), line, "same")
    mx, my = blur(x), blur(y)
    sx, sy, sxy = blur(x * x) - mx**2, blur(y * y) - my**2, blur(x * y) - mx * my
    want = ((2 * mx * my + 1e-4) * (2 * sxy + 9e-4) / ((mx**2 + my**2 + 1e-4) * (sx + sy + 9e-4) + 1e-12)).mean()
    pairs = frame(spark, [x]).withColumn("other", F.array(*[F.lit(float(v)) for v in y.reshape(-1)]))
    assert pixels.ssim(pairs, size=size).first()["ssim"] == pytest.approx(want)
    same = frame(spark, stacks).withColumn("other", F.col("pixels"))
    assert all(r["ssim"] == pytest.approx(1) for r in pixels.ssim(same, size=size).collect())


def test_pools_and_patches_against_a_loop(spark, stacks):
    df = frame(spark, stacks)
    for size, stride, pad in ((2, 2, 0), (3, 1, 1), (3, 2, 1)):
        average, largest = arrays(pixels.pooled(df, size, stride, pad)), arrays(pixels.pooled(df, size, stride, pad, "largest"))
        for k, x in enumerate(stacks):
            zeros, low = np.pad(x, ((0, 0), (pad, pad), (pad, pad))), np.pad(x, ((0, 0), (pad, pad), (pad, pad)), constant_values=-np.inf)
            for y in range(average[k].shape[1]):
                for c in range(average[k].shape[2]):
                    at = (slice(None), slice(y * stride, y * stride + size), slice(c * stride, c * stride + size))
                    assert np.allclose(average[k][:, y, c], zeros[at].mean((1, 2))) and (largest[k][:, y, c] == low[at].max((1, 2))).all()
            assert average[k].shape[1] == (x.shape[1] + 2 * pad - size) // stride + 1
    rows = pixels.patches(df, 2, 2, dilation=2).collect()
    for r in rows:
        x = stacks[r["id"]]
        wide = (x.shape[2] - 3) // 2 + 1
        y, c = 2 * (r["patch"] // wide), 2 * (r["patch"] % wide)
        assert (np.array(r["pixels"]).reshape(r["c"], 2, 2) == x[:, y : y + 3 : 2, c : c + 3 : 2]).all()
    assert len(rows) == sum(((x.shape[1] - 3) // 2 + 1) * ((x.shape[2] - 3) // 2 + 1) for x in stacks)


# detection


def test_proposals_against_all_pairs(spark):
    rng = np.random.default_rng(5)
    boxes = lambda n: [tuple(map(float, (x, y, x + w, y + h))) for x, y, w, h in zip(rng.integers(-20, 300, n), rng.integers(-20, 300, n), rng.integers(0, 200, n), rng.integers(1, 200, n))]
    a, b = boxes(60), boxes(30)
    a[0] = b[0]
    schema = "img long, k long, box struct<x1:double,y1:double,x2:double,y2:double>, label int"
    props = spark.createDataFrame([(k % 3, k, x, 0) for k, x in enumerate(a)], schema).drop("label")
    truths = spark.createDataFrame([(k % 2, k, x, k % 4 + 1) for k, x in enumerate(b)], schema)

    def iou(p, q):
        w, h = min(p[2], q[2]) - max(p[0], q[0]), min(p[3], q[3]) - max(p[1], q[1])
        size = lambda r: (r[2] - r[0]) * (r[3] - r[1])
        return w * h / (size(p) + size(q) - w * h) if w > 0 and h > 0 else 0.0

    for cell in (16.0, 500.0):
        found = {r["k"]: r for r in detection.matched(props, truths, "img", "k", 0.4, 0.2, cell).collect()}
        assert len(found) == 60
        for k, p in enumerate(a):
            o, t = max(((iou(p, q), -j) for j, q in enumerate(b) if j % 2 == k % 3), default=(0.0, 0))
            r = found[k]
            assert r["iou"] == pytest.approx(o) and r["truth"] == (-t if o > 0 else None)
            assert r["state"] == ("positive" if o >= 0.4 else "negative" if o < 0.2 else "ignored")
            assert r["label"] == ((-t) % 4 + 1 if o >= 0.4 else 0)
    hits = detection.matched(props, truths, "img", "k", 0.4, 0.2).where("state = 'positive'").withColumn("back", detection.decoded(F.col("box"), F.col("delta"))).collect()
    assert hits and all(np.allclose(list(r["back"]), b[r["truth"]], atol=1e-9) for r in hits)


def test_targets_own_their_cells(spark):
    rows = [(0, 1, 20.0, 20.0, 10.0, 13.0, 0), (0, 2, 21.0, 22.0, 11.0, 13.0, 1), (0, 3, 20.0, 20.0, 150.0, 190.0, 7), (0, 4, -1.0, 5.0, 9.0, 9.0, 0), (0, 5, 9.0, 9.0, 0.0, 9.0, 0), (1, 1, 20.0, 20.0, 10.0, 13.0, 2)]
    df = spark.createDataFrame(rows, "img long, k long, cx double, cy double, w double, h double, label int")
    found = {(r["img"], r["k"]): r for r in detection.targets_per_scale(df, "img", "k", [[(10, 13), (33, 23)], [(116, 90), (156, 198)]], [8, 32], 64, 64, 3).collect()}
    assert set(found) == {(0, 2), (0, 3), (1, 1)}
    assert (found[0, 2]["scale"], found[0, 2]["anchor"], found[0, 2]["row"], found[0, 2]["column"], found[0, 2]["label"]) == (0, 0, 2, 2, 1)
    assert (found[0, 3]["scale"], found[0, 3]["anchor"], found[0, 3]["row"], found[0, 3]["label"]) == (1, 1, 0, None)
    assert list(found[0, 3]["box"]) == [0.0, 0.0, 64.0, 64.0]


# record files


def idx_bytes(values, code=8):
    return b"\0\0" + bytes([code, values.ndim]) + b"".join(int(n).to_bytes(4, "big") for n in values.shape) + values.astype(records.IDX_KINDS[code]).tobytes()


@pytest.mark.parametrize("packed", [False, True])
def test_idx_files(spark, tmp_path, packed):
    images_ = np.random.default_rng(2).integers(0, 256, (25, 4, 3))
    labels = np.arange(25) % 10
    paths = {}
    for name, values, code in (("images", images_, 8), ("labels", labels, 0x0C)):
        paths[name] = tmp_path / f"{name}.idx{'.gz' if packed else ''}"
        data = idx_bytes(values, code)
        paths[name].write_bytes(gzip.compress(data) if packed else data)
    spark.dataSource.register(records.idx_source())
    one = spark.read.format("idx").option("path", str(paths["images"])).option("rows", 7).load()
    assert one.rdd.getNumPartitions() == 4
    two = records.read_idx(spark, str(paths["images"]))
    for df in (one, two):
        found = {r["pos"]: (r["sizes"], r["values"]) for r in df.collect()}
        assert len(found) == 25 and all(found[k] == ([4, 3], images_[k].reshape(-1).astype(float).tolist()) for k in range(25))
    assert [r["values"] for r in records.read_idx(spark, str(paths["labels"])).orderBy("pos").collect()] == [[float(v)] for v in labels]
    bad = spark.createDataFrame([(1, bytearray(b"oops")), (2, None)], "k long, content binary")
    assert records.unpacked_idx(bad.where("k = 2")).count() == 0
    with pytest.raises(Exception, match="IDX"):
        records.unpacked_idx(bad).collect()


def run_stream(query, path, checkpoint, **options):
    writer = query.writeStream.format("parquet").option("path", str(path)).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True)
    writer.start().awaitTermination(120)


def test_a_record_stream_goes_on_where_it_stopped(spark, tmp_path):
    file = tmp_path / "grows.idx"
    values = np.arange(40).reshape(20, 2)
    spark.dataSource.register(records.idx_source())
    stream = lambda: spark.readStream.format("idx").option("path", str(file)).option("rows", 3).load()
    for n in (8, 8, 20):  # the second run finds nothing new
        file.write_bytes(idx_bytes(values[:n]))
        run_stream(stream(), tmp_path / "out", tmp_path / "check")
        got = sorted((r["pos"], r["values"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
        assert got == [(k, values[k].astype(float).tolist()) for k in range(n)]


def test_a_lazy_loader(spark):
    spark.dataSource.register(records.indexed_source("squares", "n long, square long", lambda o: int(o["length"]), lambda o, low, high: ((k, k * k) for k in range(low, high))))
    df = spark.read.format("squares").option("length", 1000).option("rows", 64).load()
    assert df.agg(F.sum("square"), F.count("n")).first() == (sum(k * k for k in range(1000)), 1000)


# spectra


def test_frequency_dropout(spark):
    rng = np.random.default_rng(3)
    rows = [(k, rng.normal(size=[3, 16, 31][k % 3]).tolist()) for k in range(30)] + [(90, None), (91, [1.0, None, 2.0, 3.0])]
    df = spark.createDataFrame(rows, "id long, x array<double>").repartition(4)
    found = {r["id"]: r["x"] for r in spectra.frequency_dropout(df, "id", "x", 0.2, 0.7).collect()}
    changed = 0
    for k, x in rows[:30]:
        a, b = np.fft.rfft(x), np.fft.rfft(found[k])
        gone = np.flatnonzero(np.abs(a - b) > 1e-12)
        changed += len(gone) > 0
        if len(gone):
            n = len(x) // 2 + 1
            assert len(x) >= 4 and len(gone) <= max(1, round(0.2 * n)) and gone.max() - gone.min() < max(1, round(0.2 * n))
            assert np.abs(b[gone]).max() < 1e-12
        keep = np.setdiff1d(np.arange(len(a)), gone)
        assert np.abs(a[keep] - b[keep]).max() < 1e-12
    assert 10 <= changed <= 20 and found[90] is None and found[91] is None
    power = {r["id"]: r["power"] for r in spectra.power(df, "x").collect()}
    assert np.allclose(power[1], np.abs(np.fft.rfft(rows[1][1])) ** 2)


# stream state


def metrics():
    rng = np.random.default_rng(7)
    rows = [(f"run {k}", s, float(np.round(5 / (s + 1) + rng.normal() * 0.3, 3))) for k in range(6) for s in range(30)]
    return rows + [("run 1", 31, None), ("run 2", 32, float("nan")), (None, 1, 2.0), ("late", 5, 1.0)]


@pytest.mark.parametrize("mode,delta", [("min", 0.0), ("min", 0.1), ("max", 0.05)])
def test_early_stopping_of_a_table(spark, mode, delta):
    df = spark.createDataFrame(metrics(), "r string, s long, v double").repartition(3)
    got = sorted(tuple(r) for r in stopping.early_stopping(df, "r", "s", "v", mode, 4, delta).collect())
    want = []
    for run in {m[0] for m in metrics()} - {None}:
        steps = sorted((s, v) for r, s, v in metrics() if r == run and v is not None and v == v)
        want += [(run, *o) for o in stopping.folded(steps, None, mode, 4, delta)[0]]
    assert got == sorted(want) and any(r[-1] for r in got)
    assert len({r[0] for r in got if r[-1]}) == sum(r[-1] for r in got)


def test_early_stopping_survives_a_restart(spark, tmp_path):
    rows = metrics()
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    stopping.stateful(spark)
    try:
        for part in range(3):  # one file a batch, and a new query for each: the state comes from the checkpoint
            own = [r for r in rows if part * 11 <= r[1] < (part + 1) * 11]
            pd.DataFrame(own, columns=["r", "s", "v"]).astype({"r": object}).to_parquet(tmp_path / f"in-{part}.parquet")
            spark.read.parquet(str(tmp_path / f"in-{part}.parquet")).selectExpr("r", "cast(s as long) s", "v").write.mode("append").parquet(str(tmp_path / "in"))
            stream = spark.readStream.schema("r string, s long, v double").parquet(str(tmp_path / "in"))
            run_stream(stopping.early_stopping_stream(stream, "r", "s", "v", patience=4), tmp_path / "out", tmp_path / "check")
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    df = spark.createDataFrame(rows, "r string, s long, v double")
    want = stopping.early_stopping(df, "r", "s", "v", patience=4)
    got = spark.read.parquet(str(tmp_path / "out")).select(*want.columns)
    assert sorted(tuple(r) for r in got.collect()) == sorted(tuple(r) for r in want.collect())


def test_gradient_log(spark, tmp_path):
    rng = np.random.default_rng(1)
    batches = [[("w", float(x)) for x in rng.normal(3, 2, 40)] + [("b", 1.0)], [("w", float(x)) for x in rng.normal(3, 2, 30)] + [("w", float("inf")), (None, 1.0), ("b", None)]]
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    stopping.stateful(spark)
    try:
        for rows in batches:
            spark.createDataFrame(rows, "n string, g double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            stream = spark.readStream.schema("n string, g double").parquet(str(tmp_path / "in"))
            run_stream(stopping.gradient_log(stream, "n", "g"), tmp_path / "out", tmp_path / "check")
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    got = {(r["name"], r["batches"]): r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    x = np.array([g for rows in batches for n, g in rows if n == "w" and np.isfinite(g)])
    assert set(got) == {("w", 1), ("w", 2), ("b", 1)}
    last = got["w", 2]
    assert (last["values"], last["bad"]) == (70, 1)
    assert np.allclose([last["mean"], last["std"], last["low"], last["high"]], [x.mean(), x.std(), x.min(), x.max()])
    assert last["norm"] == pytest.approx(np.sqrt((x[40:] ** 2).sum())) and last["largest_norm"] == pytest.approx(max(np.sqrt((x[:40] ** 2).sum()), last["norm"]))
