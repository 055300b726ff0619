"""Scenes, small matrices, cleaning, decoding and further losses against plain versions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import losses
from millrace.operators import detection, matrices, moments, ordered, scenes, synthetic
from millrace.sources import cleaning


def inside(kind, dx, dy, r, a):
    """Whether a place lies in an object, corner by corner."""
    if kind == 0:
        return dx * dx + dy * dy <= r * r
    if kind == 1:
        return all(abs(dx * math.cos(a + t) + dy * math.sin(a + t)) <= r + 1e-9 for t in (0, math.pi / 2))
    corners = [(r * math.cos(a + k * 2 * math.pi / 3), r * math.sin(a + k * 2 * math.pi / 3)) for k in range(3)]
    sides = [(x2 - x1) * (dy - y1) - (y2 - y1) * (dx - x1) for (x1, y1), (x2, y2) in zip(corners, corners[1:] + corners[:1])]
    return min(sides) >= -1e-9


@pytest.fixture(scope="module")
def drawn_scenes(spark):
    return scenes.scenes(spark.range(25).toDF("key"), "key", 4, seed=3).persist()


def test_pictures_masks_and_shares(drawn_scenes):
    pictures = {r["key"]: np.array(r["pixels"]).reshape(3, 32, 32) for r in scenes.painted(drawn_scenes).collect()}
    kinds = {r["key"]: np.array(r["pixels"]).reshape(32, 32) for r in scenes.masks(drawn_scenes).collect()}
    numbers = {r["key"]: np.array(r["pixels"]).reshape(32, 32) for r in scenes.masks(drawn_scenes, instances=True).collect()}
    shares = {r["key"]: r["visible"] for r in scenes.visible_shares(drawn_scenes).collect()}
    colours = np.array(list(scenes.COLOURS.values()))
    for row in drawn_scenes.withColumn("boxes", scenes.boxes(F.col("objects"))).collect():
        front, area = np.zeros((32, 32), int), []
        for k, o in enumerate(row["objects"]):
            here = np.array([[inside(o["kind"], x - o["cx"], y - o["cy"], o["r"], o["angle"]) for x in range(32)] for y in range(32)])
            front[here] = k + 1
            area.append(here.sum())
            ys, xs = np.nonzero(here)
            b = row["boxes"][k]
            assert xs.min() >= b["x1"] - 1e-6 and xs.max() <= b["x2"] + 1e-6 and ys.min() >= b["y1"] - 1e-6 and ys.max() <= b["y2"] + 1e-6
            assert xs.min() - b["x1"] < 2.5 and b["x2"] - xs.max() < 2.5 and 0 <= b["x1"] and b["x2"] <= 31
        assert (numbers[row["key"]] == front).all()
        assert np.allclose(shares[row["key"]], [(front == k + 1).sum() / area[k] for k in range(len(area))])
        lookup = [0] + [o["kind"] + 1 for o in row["objects"]]
        assert (kinds[row["key"]] == np.array(lookup)[front]).all()
        paint = np.concatenate([np.zeros((1, 3)), colours[[o["colour"] for o in row["objects"]]]])
        assert (pictures[row["key"]] == np.moveaxis(paint[front], 2, 0)).all()


def test_captions(drawn_scenes):
    pos, neg = scenes.bound_attributes(F.col("objects"))
    for r in drawn_scenes.select("objects", scenes.caption(F.col("objects")).alias("said"), pos.alias("pos"), neg.alias("neg")).collect():
        words = [f"a {list(scenes.COLOURS)[o['colour']]} {scenes.KINDS[o['kind']]}" for o in r["objects"]]
        assert r["said"] == " and ".join(words)
        a, b = r["objects"][0], r["objects"][-1]
        if len(words) > 1 and a["colour"] != b["colour"] and a["kind"] != b["kind"]:
            assert r["pos"] == f"{words[0]} and {words[-1]}" and r["neg"] != r["pos"] and sorted(r["neg"].split()) == sorted(r["pos"].split())
        else:
            assert r["pos"] is None and r["neg"] is None


def test_tracks_bounce(spark, drawn_scenes):
    moving = scenes.tracks(drawn_scenes, "key", 60, 3.0)
    steps = {}
    for r in moving.collect():
        steps.setdefault((r["key"], r["track"]), {})[r["t"]] = (r["o"]["cx"], r["o"]["cy"], r["o"]["r"] * 2**0.5)
    for path in steps.values():
        for axis in (0, 1):
            at = [path[t][axis] for t in range(60)]
            reach = path[0][2]
            assert min(at) >= reach - 1e-9 and max(at) <= 31 - reach + 1e-9
            pace = max(abs(b - a) for a, b in zip(at, at[1:]))
            assert pace <= 3 + 1e-9 and all(abs(b - a) <= pace + 1e-9 for a, b in zip(at, at[1:]))
    shown = scenes.frames(moving.where("t < 2"), "key")
    assert shown.count() == 50 and shown.first()["h"] == 32
    sprites = spark.createDataFrame([(1, 1, 2, 3, [1.0] * 6)], "id long, c int, h int, w int, pixels array<double>")
    rows = scenes.moving_sprites(sprites, "id", 9, 9, 20).collect()
    assert len(rows) == 20 and all(sum(r["pixels"]) == 6 and r["h"] == 9 for r in rows) and len({tuple(r["pixels"]) for r in rows}) > 3


def test_textures_regions_and_blobs(spark):
    keys = spark.range(40).toDF("key")
    for r in scenes.textures(keys, "key").collect():
        x = np.array(r["pixels"])
        assert x.min() >= 0 and x.max() <= 1 and x.std() > 0.05 and (r["texture"] != 1 or set(x) == {0.0, 1.0})
    for r in scenes.regions(keys, "key", 4, 12, 10).collect():
        at, x = np.array(r["points"]).reshape(4, 2), np.array(r["pixels"]).reshape(12, 10)
        assert all(x[y, c] == min(range(4), key=lambda k: ((c - at[k, 0]) ** 2 + (y - at[k, 1]) ** 2, k)) for y in range(12) for c in range(10))
    for r in scenes.soft_blobs(keys, "key", 2, 12, 12).collect():
        x = np.array(r["pixels"]).reshape(2, 12, 12)
        assert ((x[0] >= 0.5) == x[1]).all() and x[0].max() <= 1
    marked = scenes.shortcut(scenes.painted(scenes.scenes(keys, "key")), "key", F.col("key") < 20, 0.9).collect()
    assert all((np.array(r["pixels"]).reshape(3, 32, 32)[:, :4, :4] == 1).all() or not r["marked"] for r in marked)
    assert sum(r["marked"] for r in marked if r["key"] < 20) > 13 and sum(r["marked"] for r in marked if r["key"] >= 20) < 7


def test_sparse_rows_and_bars(spark):
    long, target = scenes.sparse_rows(spark.range(300).toDF("key"), "key", 100, 6, 20, noise=0.0)
    sizes = [r["n"] for r in long.groupBy("key").agg(F.count("feature").alias("n")).collect()]
    assert max(sizes) <= 6 and len(sizes) == 300
    blank = long.where("feature < 20").select("key").distinct()
    assert target.join(blank, "key", "left_anti").where("y <> 0").count() == 0
    assert target.where("(y > 0) <> (label = 1)").count() == 0
    assert synthetic.bars_stripes(spark, 4).count() == 32


def test_matrices(spark):
    rng = np.random.default_rng(1)
    m = [rng.normal(size=(n, n)) for n in (1, 2, 3, 3)] + [np.ones((2, 2))]
    df = spark.createDataFrame([(k, x.reshape(-1).tolist()) for k, x in enumerate(m)] + [(8, None), (9, [1.0, 2.0]), (10, [1.0, None, 2.0, 3.0])], "id long, m array<double>").repartition(3)
    inverse = {r["id"]: r["inverse"] for r in matrices.inverse(df, "m").collect()}
    det = {r["id"]: r["determinant"] for r in matrices.determinant(df, "m").collect()}
    values = {r["id"]: r["singular"] for r in matrices.singular_values(df, "m").collect()}
    for k in range(4):
        assert np.allclose(np.array(inverse[k]).reshape(m[k].shape) @ m[k], np.eye(len(m[k]))) and det[k] == pytest.approx(np.linalg.det(m[k]))
        assert np.allclose(values[k], np.linalg.svd(m[k], compute_uv=False))
    assert inverse[4] is None and det[4] == pytest.approx(0) and all(d[k] is None for d in (inverse, det, values) for k in (8, 9, 10))


def test_penalties(spark):
    w = np.random.default_rng(2).normal(size=(40, 5)) * 2
    df = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(w)], "id long, v array<double>").repartition(3)
    s = np.linalg.svd(w, compute_uv=False)
    assert matrices.spectral_norm(df, "v") == pytest.approx(s[0]) and matrices.nuclear_norm(df, "v") == pytest.approx(s.sum())
    assert matrices.orthogonal_penalty(df, "v", 0.5) == pytest.approx(0.5 * ((w.T @ w - np.eye(5)) ** 2).sum())
    assert matrices.group_lasso(df, "v", 0.1).first()[0] == pytest.approx(0.1 * 5**0.5 * np.linalg.norm(w, axis=1).sum())
    short = np.array([r["v"] for r in matrices.max_norm(df, "v", 3.0).orderBy("id").collect()])
    assert np.allclose(short, w * np.minimum(1, 3 / np.linalg.norm(w, axis=1))[:, None])
    assert matrices.spectral_norm(df.limit(0), "v") == 0 and matrices.group_lasso(df.limit(0), "v").first()[0] == 0


def test_cleaned_files(spark, tmp_path):
    lines = ["39, State-gov, 77516, Bachelors, 13, Never-married, Adm-clerical, Not-in-family, White, Male, 2174, 0, 40, United-States, <=50K", "50, ?, 83311, Bachelors, 13, Married, Exec, Husband, White, Male, 0, 0, 13, United-States, >50K.", "|comment", "", "1, 2, 3"]
    (tmp_path / "a.data").write_text("\n".join(lines))
    raw = cleaning.read_headerless(spark, str(tmp_path / "a.data"), cleaning.ADULT)
    rows = cleaning.cleaned(raw, cleaning.ADULT).orderBy("age").collect()
    assert [(r["age"], r["workclass"], r["capital-gain"], r["target"]) for r in rows] == [(39.0, "State-gov", 2174.0, 0), (50.0, None, 0.0, 1)]
    assert cleaning.cleaned(raw, cleaning.ADULT, drop_missing=True).count() == 1
    (tmp_path / "t.csv").write_text("pclass,survived,name,sex,age,sibsp,parch,fare,embarked\n1,1,a,female,29,0,0,211.3,S\n3,0,b,male,?,1,0,?,C\n2,?,c,male,3,0,0,1,Q\n1,0,d,male,40,0,0,5,?\n")
    passengers = cleaning.cleaned(spark.read.option("header", True).csv(str(tmp_path / "t.csv")), cleaning.TITANIC)
    hot = {r["name"]: r["x"] for r in cleaning.encoded(passengers, cleaning.TITANIC).collect()}
    assert hot["a"] == [1.0, 29.0, 0.0, 0.0, 211.3, 1.0, 0.0, 0.0, 1.0] and hot["d"][5:] == [0.0, 1.0, 0.0, 0.0]
    assert math.isnan(hot["b"][1]) and hot["b"][5:] == [0.0, 1.0, 1.0, 0.0] and len(hot) == 3
    plain = {r["name"]: r["x"] for r in cleaning.encoded(passengers, cleaning.TITANIC, "ordinal").collect()}
    assert plain["a"][5:] == [0.0, 1.0] and plain["d"][5] == 1.0 and math.isnan(plain["d"][6])


def test_heads_and_anchors(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(20, 8))
    df = spark.createDataFrame([(k, k % 2, k % 4, k % 3, r.tolist()) for k, r in enumerate(v)], "id long, anchor int, row int, column int, values array<double>")
    one = lambda x: 1 / (1 + np.exp(-x))
    for r in detection.decoded_cells(df, [(10.0, 20.0), (30.0, 15.0)], 16, 64, 48).collect():
        x, (aw, ah) = v[r["id"]], [(10, 20), (30, 15)][r["anchor"]]
        cx, cy, w, h = (one(x[0]) + r["column"]) * 16, (one(x[1]) + r["row"]) * 16, np.exp(x[2]) * aw, np.exp(x[3]) * ah
        assert np.allclose(list(r["box"]), np.clip([cx - w / 2, cy - h / 2, cx + w / 2, cy + h / 2], 0, [48, 64, 48, 64]))
        assert r["score"] == pytest.approx(one(x[4])) and np.allclose(r["classes"], one(x[5:]))
    found = detection.anchor_boxes(spark.createDataFrame([(1,)], "img long"), [8.0, 16.0], [0.5, 1.0, 2.0], 4, 2, 3).collect()
    assert len(found) == 36
    for r in found:
        s, q = [8, 16][r["anchor"] // 3], [0.5, 1, 2][r["anchor"] % 3]
        w, h, x, y = (s * s / q) ** 0.5, (s * s * q) ** 0.5, (r["column"] + 0.5) * 4, (r["row"] + 0.5) * 4
        assert np.allclose(list(r["box"]), [x - w / 2, y - h / 2, x + w / 2, y + h / 2])


def test_losses_and_scores(spark):
    p, y = [0.9, 0.2, 1.0, 0.0], [1.0, 0.0, 0.0, 0.0]
    found = spark.range(1).select(losses.cross_entropy_and_dice(F.lit(p), F.lit(y), 0.3)).first()[0]
    x = np.clip(p, 1e-7, 1 - 1e-7)
    bce = -(np.array(y) * np.log(x) + (1 - np.array(y)) * np.log(1 - x)).mean()
    assert found == pytest.approx(0.3 * bce + 0.7 * (1 - (2 * 0.9 + 1e-7) / (2.1 + 1 + 1e-7)))
    z = np.random.default_rng(3).normal(size=(23, 3))
    df = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(z)], "id long, v array<double>").repartition(4)
    row = moments.inception_score_splits(df, "v", "id", 5).first()
    want = []
    for k in range(5):
        q = np.exp(z[4 * k : 4 * k + 4])
        q /= q.sum(1, keepdims=True)
        want.append(np.exp((q * (np.log(q) - np.log(q.mean(0) + 1e-12))).sum(1).mean()))
    assert np.allclose(row["scores"], want) and row["mean"] == pytest.approx(np.mean(want)) and row["std"] == pytest.approx(np.std(want))


@pytest.mark.parametrize("kind", ["adabound", "adan"])
def test_more_optimisers(spark, kind):
    grads = np.random.default_rng(5).normal(size=9).tolist()
    w, m, v, d, last, want = 0.5, 0.0, 0.0, 0.0, 0.0, []
    for t, g in enumerate(grads, 1):
        if kind == "adabound":
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            rate = 0.01 / (math.sqrt(v / (1 - 0.999**t)) + 1e-8)
            w -= min(max(rate, 0.1 * (1 - 1 / (1e-3 * t + 1))), 0.1 * (1 + 1 / (1e-3 * t))) * m / (1 - 0.9**t)
        else:
            m, d, v = 0.98 * m + 0.02 * g, 0.92 * d + 0.08 * (g - last), 0.99 * v + 0.01 * g * g
            w -= 0.01 * ((m / (1 - 0.98**t) + 0.92 * d / (1 - 0.92**t)) / (math.sqrt(v / (1 - 0.99**t)) + 1e-8) + 0.01 * w)
            last = g
        want.append(w)
    assert np.allclose(spark.range(1).select(ordered.optimised(F.lit(0.5), F.lit(grads), kind)).first()[0], want)
