"""Clusters, weighted draws, oversampling, factorisation, tall tables and moments against plain versions."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import clusters, factorise, moments, neighbours, resample, sampling, tall


@pytest.fixture(scope="module")
def embeddings(spark):
    return spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v")).persist()


def matrix(df, column="v"):
    return np.array([r[column] for r in df.orderBy(df.columns[0]).select(column).collect()], float)


# clusters


def plain_kmeans(x, k, seed, tries=5):
    best = math.inf
    for t in range(tries):
        rng = np.random.default_rng(seed + t)
        centres = x[[rng.integers(len(x))]]
        while len(centres) < k:
            d = ((x[:, None] - centres[None]) ** 2).sum(2).min(1)
            centres = np.concatenate([centres, x[[rng.choice(len(x), p=d / d.sum())]]])
        for _ in range(50):
            own = ((x[:, None] - centres[None]) ** 2).sum(2).argmin(1)
            centres = np.array([x[own == c].mean(0) if (own == c).any() else centres[c] for c in range(k)])
        best = min(best, ((x[:, None] - centres[None]) ** 2).sum(2).min(1).sum())
    return best


def test_seeded_kmeans_is_as_good_as_plain(spark, embeddings):
    found = clusters.kmeans(embeddings, "vec_id", "v", 10, restarts=2)
    x = matrix(embeddings)
    assert found.centres.shape == (10, 64)
    assert found.inertia <= 1.1 * plain_kmeans(x, 10, 0)
    assert found.inertia == pytest.approx(((x[:, None] - found.centres[None]) ** 2).sum(2).min(1).sum())
    assert all(a >= b - 1e-9 for a, b in zip(found.history, found.history[1:]))
    rows = clusters.nearest(clusters.vectors(embeddings, "vec_id", "v"), found.centres).collect()
    assert sum(r["d"] for r in rows) == pytest.approx(found.inertia) and len(rows) == len(x)


def test_kmeans_of_odd_rows(spark):
    rows = [(k, [float(k % 3), 0.0]) for k in range(60)] + [(90, None), (None, [1.0, 1.0]), (91, [None, 1.0]), (92, [float("nan"), 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, v array<double>")
    found = clusters.kmeans(df, "vec_id", "v", 5, restarts=1)
    assert len(found.centres) == 3 and found.inertia == pytest.approx(0)
    assert len(clusters.seeded(clusters.vectors(df.limit(0), "vec_id", "v"), 3)) == 0
    far = clusters.lloyd(clusters.vectors(df, "vec_id", "v"), np.array([[0.0, 0.0], [1.0, 0.0], [500.0, 0.0]]))
    assert far.inertia == pytest.approx(0)  # the centre without rows took the farthest row
    assert clusters.kmeans(df, "vec_id", "v", 3, restarts=2, init="random").inertia >= 0
    with pytest.raises(ValueError):
        clusters.kmeans(df.limit(0), "vec_id", "v", 3)


# draws


def test_weighted_draws_against_a_summed_list(spark):
    rng = random.Random(1)
    rows = [(k, rng.choice([0, 1, 2, 3])) for k in range(300)] + [(301, None), (302, -4), (None, 9), (303, 400), (7, 2)]
    df = spark.createDataFrame(rows, "k long, w int").repartition(5)
    asked = sampling.draws(spark, 4000, 3)
    u = {r["draw"]: r["u"] for r in asked.collect()}
    weight = Counter()
    for k, w in rows:
        if k is not None and w and w > 0:
            weight[k] += w
    keys = sorted(weight)
    ends = np.cumsum([weight[k] for k in keys])
    want = {d: keys[int(np.searchsorted(ends, x * ends[-1], "right"))] for d, x in u.items()}
    for block in (100_000, 50):  # a heavy row's draws are dealt over blocks
        found = sampling.pick(df, "k", F.col("w"), asked, block)
        assert {r["draw"]: r["k"] for r in found.collect()} == want and found.count() == 4000
    assert 0.35 < sum(k == 303 for k in want.values()) / 4000 < 0.6


def test_draws_without_weights_or_rows(spark):
    df = spark.range(5).toDF("k").withColumn("w", F.lit(0.0))
    found = Counter(r["k"] for r in sampling.weighted_sample(df, "k", F.col("w"), 2000).collect())
    assert set(found) == set(range(5)) and min(found.values()) > 300
    assert sampling.weighted_sample(df.limit(0), "k", F.col("w"), 10).count() == 0
    mixed = sampling.mixed([df, df.where("k < 2")], "k", [1.0, 3.0], 2000).collect()
    assert len(mixed) == 2000 and 0.7 < sum(r["source"] for r in mixed) / 2000 < 0.8
    assert {r["k"] for r in mixed if r["source"] == 1} == {0, 1}
    with pytest.raises(ValueError):
        sampling.mixed([df], "k", [0.0], 5)


def test_categorical(spark):
    df = spark.range(3000).select("id", F.array(F.lit(0.2), F.lit(0.0), F.lit(0.5), F.lit(0.3)).alias("p"), F.array(F.lit(9.0), F.lit(0.0)).alias("logits"))
    found = df.select(F.explode(sampling.categorical(F.col("p"), "id", 2)).alias("k")).groupBy("k").count().collect()
    share = {r["k"]: r["count"] / 6000 for r in found}
    assert 1 not in share and abs(share[0] - 0.2) < 0.03 and abs(share[2] - 0.5) < 0.03
    assert {r[0] for r in df.limit(50).select(F.explode(sampling.categorical(F.col("logits"), "id", 1))).collect()} == {0}


# neighbours


def nearest_lists(keys, x, k):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    return {q: [keys[j] for j in sorted((j for j in range(len(keys)) if keys[j] != q), key=lambda j: (d[i, j], keys[j]))[:k]] for i, q in enumerate(keys)}


def by_query(df, key):
    out = {}
    for r in df.orderBy("query", "rank").collect():
        out.setdefault(r["query"], []).append(r[key])
    return out


def test_neighbour_join_recall(spark, embeddings):
    x, keys = matrix(embeddings), [r[0] for r in embeddings.select("vec_id").orderBy("vec_id").collect()]
    want = nearest_lists(keys, x, 10)
    found = by_query(neighbours.near(embeddings, "vec_id", "v", 10, cell_rows=400), "vec_id")
    assert set(found) == set(want) and all(len(f) == 10 for f in found.values())
    assert sum(len(set(found[q]) & set(want[q])) for q in want) / (10 * len(want)) >= 0.9
    assert by_query(neighbours.near(embeddings, "vec_id", "v", 10), "vec_id") == want  # one cell: exact


def test_neighbours_of_copies_and_odd_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(k, [0.0, 0.0]) for k in range(40)] + [(100 + k, rng.normal(size=2).tolist()) for k in range(60)] + [(500, None), (None, [1.0, 1.0]), (501, [float("nan"), 1.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    real = [r for r in rows if r[0] is not None and r[0] < 500]
    want = nearest_lists([r[0] for r in real], np.array([r[1] for r in real]), 4)
    assert by_query(neighbours.near(df, "id", "v", 4), "id") == want
    asked = by_query(neighbours.near(df, "id", "v", 4, F.col("id") % 7 == 0, cell_rows=30, cuts=16), "id")
    assert set(asked) == {q for q in want if q % 7 == 0} and all(asked[q] == want[q] for q in asked if q < 40)
    assert neighbours.near(df.limit(0), "id", "v", 4).count() == 0


def test_exact_neighbours_in_blocks(spark, embeddings):
    x, keys = matrix(embeddings), [r[0] for r in embeddings.select("vec_id").orderBy("vec_id").collect()]
    want = nearest_lists(keys, x, 5)
    found = neighbours.knn(embeddings.where("vec_id % 9 = 0"), embeddings, "vec_id", "v", 5, block_rows=90)
    assert by_query(found, "vec_id") == {q: w for q, w in want.items() if q % 9 == 0}
    repeated = spark.createDataFrame([(1, [0.0]), (1, [0.0]), (2, [0.0]), (3, [4.0]), (None, [0.0]), (4, None)], "vec_id long, v array<double>")
    assert by_query(neighbours.knn(repeated.where("vec_id = 1").limit(1), repeated, "vec_id", "v", 2), "vec_id") == {1: [2, 3]}


# oversampling


def test_allocation_by_largest_shares(spark):
    shares = spark.createDataFrame([(k, s) for k, s in enumerate([3, 0, 3, 1, 2])], "id long, share long")
    deal = lambda n: {r["id"]: r["copies"] for r in resample.shared_out(shares, "id", "share", n).collect()}
    assert deal(10) == {0: 4, 1: 0, 2: 3, 3: 1, 4: 2}
    assert sum(deal(7).values()) == 7 and deal(0) == dict.fromkeys(range(5), 0)
    even = {r["id"]: r["copies"] for r in resample.shared_out(shares.withColumn("share", F.lit(0)), "id", "share", 7).collect()}
    assert sorted(even.values()) == [1, 1, 1, 2, 2]


@pytest.mark.parametrize("kind", ["adaptive", "borderline"])
def test_new_rows_lie_between_neighbours(spark, kind):
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(0, 1, (80, 3)), rng.normal(1, 0.6, (20, 3))])
    df = spark.createDataFrame([(k, p.tolist(), int(k >= 80)) for k, p in enumerate(x)], "id long, v array<double>, y int")
    made = getattr(resample, kind)(df, "id", "v", "y", 1, seed=2).collect()
    assert len(made) == 60 and all(80 <= r["query"] < 100 for r in made)
    near = nearest_lists(list(range(80, 100)), x[80:], 5)
    for r in made:
        a, p = x[r["query"]], np.array(r["v"])
        assert any(np.allclose(np.cross(x[b] - a, p - a), 0, atol=1e-9) and -1e-9 <= (p - a) @ (x[b] - a) <= ((x[b] - a) ** 2).sum() + 1e-9 for b in near[r["query"]])
    foreign = {r["id"]: r["foreign"] for r in resample.foreign_share(df, "id", "v", "y", 1).collect()}
    if kind == "borderline":
        assert {r["query"] for r in made} <= {k for k, f in foreign.items() if f >= 5}
    else:
        assert {r["query"] for r in made} <= {k for k, f in foreign.items() if f > 0}
    assert getattr(resample, kind)(df.where("id < 81"), "id", "v", "y", 1).count() == 0  # a lone row has no neighbour
    assert getattr(resample, kind)(df, "id", "v", "y", 7).count() == 0  # a label that is not there


# factorisation


@pytest.mark.parametrize("biased", [True, False])
def test_an_epoch_is_the_plain_loop(spark, biased):
    rng = random.Random(8)
    rows = [(rng.randrange(12) * 10**10, rng.randrange(9), float(rng.randrange(1, 6))) for _ in range(200)] + [(None, 1, 2.0), (1, None, 2.0), (1, 1, float("nan"))]
    ratings = spark.createDataFrame(rows, "u long, i long, r double").repartition(3)
    options = dict(rank=3, lr=0.05, reg_factors=0.1, reg_bias=0.02, blocks=3, biased=biased, seed=4)
    start = factorise.factorise(ratings, "u", "i", "r", epochs=0, **options)
    sides = {k: {r["id"]: [r["bias"], np.array(r["v"])] for r in start.of(k).collect()} for k in ("user", "item")}
    known = [r for r in rows if None not in r and r[2] == r[2]]
    mean = sum(r[2] for r in known) / len(known) if biased else 0.0
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(3)).cast("int")
    placed = spark.createDataFrame(known, "user long, item long, r double").select("*", block("user").alias("ub"), block("item").alias("ib"), F.xxhash64(F.lit(4), F.lit(0), "user", "item").alias("turn")).collect()
    for s in range(3):
        for b in range(3):
            for r in sorted((r for r in placed if r["ub"] == b and (r["ib"] - r["ub"]) % 3 == s), key=lambda r: (r["turn"], r["user"], r["item"], r["r"])):
                p, q = sides["user"][r["user"]], sides["item"][r["item"]]
                e = r["r"] - (mean + p[0] + q[0] + p[1] @ q[1])
                if biased:
                    p[0], q[0] = p[0] + 0.05 * (e - 0.02 * p[0]), q[0] + 0.05 * (e - 0.02 * q[0])
                p[1], q[1] = p[1] + 0.05 * (e * q[1] - 0.1 * p[1]), q[1] + 0.05 * (e * p[1] - 0.1 * q[1])
    after = factorise.factorise(ratings, "u", "i", "r", epochs=1, **options)
    for k in ("user", "item"):
        found = {r["id"]: (r["bias"], r["v"]) for r in after.of(k).collect()}
        assert set(found) == set(sides[k])
        for i, (bias, v) in found.items():
            assert bias == pytest.approx(sides[k][i][0], abs=1e-12) and np.allclose(v, sides[k][i][1], atol=1e-12)


def test_held_out_error_falls(spark):
    rng = np.random.default_rng(3)
    p, q, a, b = rng.normal(size=(30, 2)), rng.normal(size=(25, 2)), rng.normal(size=30), rng.normal(size=25)
    rows = [(u, i, float(3 + a[u] + b[i] + p[u] @ q[i])) for u in range(30) for i in range(25)]
    df = spark.createDataFrame(rows, "u long, i long, r double").withColumn("test", F.pmod(F.xxhash64("u", "i"), F.lit(5)) == 0).persist()

    def error(epochs):
        model = factorise.factorise(df.where("not test"), "u", "i", "r", rank=4, epochs=epochs, lr=0.04, std=0.1, blocks=2)
        return factorise.predict(df.where("test"), model, "u", "i").agg(F.avg((F.col("r") - F.col("predicted")) ** 2)).first()[0]

    first, later = error(1), error(25)
    assert later < first / 2
    model = factorise.factorise(df, "u", "i", "r", rank=2, epochs=1, blocks=2, low=1, high=4)
    new = factorise.predict(spark.createDataFrame([(0, 0), (999, 3), (None, 1)], "u long, i long"), model, "u", "i").collect()
    assert all(1 <= r["predicted"] <= 4 for r in new) and len(new) == 3


# tall tables


def test_singular_values_of_embeddings(spark, embeddings):
    x = matrix(embeddings)
    s, axes = tall.svd(embeddings.repartition(40), "v")
    assert np.allclose(s, np.linalg.svd(x, compute_uv=False), rtol=1e-9)
    at = np.array([r["at"] for r in tall.projected(embeddings, "v", axes[:3]).orderBy("vec_id").collect()])
    assert np.allclose(np.abs(at), np.abs(x @ np.linalg.svd(x)[2][:3].T), atol=1e-9)


def test_an_ill_conditioned_table(spark):
    t = np.linspace(0, 1, 500)
    x = np.stack([t**k for k in range(12)], 1)
    df = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)], "id long, v array<double>").repartition(7)
    want = np.linalg.svd(x, compute_uv=False)
    assert want[0] / want[-1] > 1e7
    s, _ = tall.svd(df, "v")
    assert np.allclose(s, want, rtol=1e-7, atol=want[0] * 1e-14)
    assert not np.allclose(np.sqrt(np.abs(np.linalg.eigvalsh(x.T @ x)[::-1])), want, rtol=1e-3, atol=0)  # squaring fails
    cols = df.select(*[F.element_at("v", k + 1).alias(f"x{k}") for k in range(12)]).withColumn("y", sum((k + 1) * F.col(f"x{k}") for k in range(12)))
    b = tall.solve(cols, [f"x{k}" for k in range(12)], ["y"])[:, 0]
    assert np.allclose(x @ b, x @ np.arange(1, 13), atol=1e-9)


def test_least_squares_of_dependent_columns_and_empty_tables(spark):
    df = spark.createDataFrame([(float(k), 2.0 * k, 5.0 * k) for k in range(10)] + [(None, 1.0, 1.0)], "a double, b double, y double")
    assert np.allclose(tall.solve(df, ["a", "b"], ["y"])[:, 0], [1.0, 2.0])
    assert tall.solve(df.limit(0), ["a", "b"], ["y"]).tolist() == [[0.0], [0.0]]
    assert tall.svd(spark.createDataFrame([], "v array<double>"), "v")[0].size == 0


def test_wide_tables_by_a_range_finder(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(80, 6)) @ np.diag([50, 20, 9, 4, 2, 1]) @ rng.normal(size=(6, 300))
    df = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)], "id long, v array<double>").repartition(5)
    s, axes = tall.wide_svd(df, "v", 4)
    _, want, vt = np.linalg.svd(x, full_matrices=False)
    assert np.allclose(s, want[:4], rtol=1e-9)
    assert np.allclose(np.abs((axes * vt[:4]).sum(1)), 1, atol=1e-9)


# moments


def test_moments_merge_and_do_not_cancel(spark, embeddings):
    far = embeddings.withColumn("v", F.transform("v", lambda x: x + 1e7)).repartition(45)
    found = moments.moments(far, "v", "label")
    x, labels = matrix(embeddings), [r[0] for r in embeddings.orderBy("vec_id").select("label").collect()]
    for label in set(labels):
        own = x[[k for k, y in enumerate(labels) if y == label]]
        m = found[str(label)]
        assert m.n == len(own) and np.allclose(m.mean - 1e7, own.mean(0), atol=1e-7)
        assert np.allclose(m.covariance(), np.cov(own.T), atol=1e-8)
    assert moments.moments(embeddings.limit(0), "v") == {}


def test_frechet_distance(spark):
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=(400, 5)), rng.normal(1, 2, size=(300, 5)) @ rng.normal(size=(5, 5))
    frames = [spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)], "id long, v array<double>") for x in (a, b)]
    ca, cb = np.cov(a.T), np.cov(b.T)
    values = np.linalg.eigvals(ca @ cb)
    want = ((a.mean(0) - b.mean(0)) ** 2).sum() + np.trace(ca) + np.trace(cb) - 2 * np.sqrt(np.maximum(values.real, 0)).sum()
    assert moments.frechet_distance(*frames, "v") == pytest.approx(want, rel=1e-9)
    assert moments.frechet_distance(frames[0], frames[0], "v") == pytest.approx(0, abs=1e-9)
    half = moments.root(ca)
    assert np.allclose(half @ half, ca)


def test_inception_score(spark):
    x = np.random.default_rng(1).normal(size=(60, 4)) * 3
    df = spark.createDataFrame([(r.tolist(),) for r in x] + [(None,)], "v array<double>")
    p = np.exp(x) / np.exp(x).sum(1, keepdims=True)
    want = math.exp((p * (np.log(p) - np.log(p.mean(0) + 1e-12))).sum(1).mean())
    assert moments.inception_score(df, "v").first()["score"] == pytest.approx(want)
