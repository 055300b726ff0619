"""Edge cases, invariants and plans of operators without SQL."""

import numpy as np
from pyspark.sql import functions as F

from millrace.operators import metrics, models, neighbours, ordered, preprocessing, resample, splits, text
from millrace.sources import readers
from millrace.streaming import windows


def test_constant_column_has_divisor_one(spark):
    d = spark.createDataFrame([(5.0,)] * 3, "x double")
    assert [r[0] for r in preprocessing.minmax_scale(d, ["x"]).collect()] == [0.0] * 3
    assert [r[0] for r in preprocessing.robust_scale(d, ["x"]).collect()] == [0.0] * 3


def test_imputed_column_without_values_is_zero(spark):
    d = spark.createDataFrame([(None,), (float("nan"),)], "x double")
    for strategy in ("mean", "median"):
        assert [r[0] for r in preprocessing.impute(d, ["x"], strategy).collect()] == [0.0, 0.0]


def test_one_class_metrics(spark):
    d = spark.createDataFrame([(0.1, 0), (0.7, 0)], "s double, y int")
    assert metrics.auroc(d, "s", "y").first()[0] == 0.5
    assert metrics.auprc(d, "s", "y").first()[0] == 0.0


def test_fold_sizes(spark):
    sizes = splits.kfold(spark.range(10), "id", 3).groupBy("fold").count().orderBy("fold").collect()
    assert [r["count"] for r in sizes] == [4, 3, 3]


def test_packed_blocks_are_the_stream(spark):
    d = spark.createDataFrame([("a", k, list(range(10 * k, 10 * k + k))) for k in range(1, 8)], "g string, k int, ids array<int>")
    stream = [x for k in range(1, 8) for x in range(10 * k, 10 * k + k)]
    found = ordered.packed_blocks(d, "ids", "k", "g", 5).orderBy("block_no").collect()
    assert [r["tokens"] for r in found] == [stream[i : i + 5] for i in range(0, len(stream) - 4, 5)]


def test_kmeans_inertia_falls(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    _, history = neighbours.kmeans(e, e.where("vec_id < 4").select(F.col("vec_id").alias("centre"), F.col("v").alias("at")), "v", 3)
    assert all(a >= b - 1e-6 for a, b in zip(history, history[1:]))


def test_linear_models_agree_with_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 2))
    y = 3 + x @ [2.0, -1.0]
    d = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y)], "a double, b double, y double")
    assert np.allclose(models.linear(d, ["a", "b"], "y"), [3, 2, -1], atol=1e-6)
    assert np.allclose(models.elastic_net(d, ["a", "b"], "y", 1e-6)[1], [2, -1], atol=1e-3)
    value, parts = models.pca(d, ["a", "b", "y"], 2)
    assert value[0] >= value[1] and np.allclose(parts @ parts.T, np.eye(2), atol=1e-8)


def test_bpe_merges_most_frequent_pair(spark):
    d = spark.createDataFrame([("low low lower newest newest",)], "text string")
    # l-o, o-w and w-e occur three times each: the smallest pair first, then lo-w before w-e
    assert text.bpe_merges(d, "text", 2) == [("l", "o"), ("lo", "w")]
    one = spark.range(1).select(text.merge_pair(F.array(*[F.lit(c) for c in "aaab"]), "a", "a").alias("m")).first()[0]
    assert one == ["aa", "a", "b"]


def test_bleu_of_equal_texts_is_one(spark):
    d = spark.createDataFrame([(1, "a b c d e f")], "k int, text string")
    assert abs(text.corpus_bleu(d, d, "k").first()[0] - 1) < 1e-9


def test_ema(spark):
    assert abs(spark.range(1).select(ordered.ema(F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0)), 0.5)).first()[0] - 2.25) < 1e-12


def test_resampling_is_repeatable(spark):
    d = spark.createDataFrame([(k, [float(k), float(k % 3)]) for k in range(20)], "id long, v array<double>")
    assert resample.smote(d, "id", "v", 2).count() == 40
    assert resample.smote(d.limit(1), "id", "v", 2).count() == 0
    counts = [resample.bootstrap(spark.range(2000).repartition(n), "id", 3).count() for n in (1, 5)]
    assert counts[0] == counts[1] and 1700 < counts[0] < 2300


def test_filter_reaches_the_scan(spark, sf_dir):
    plan = spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_totalprice > 1000").select("o_orderkey")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(o_totalprice" in plan and "o_orderpriority" not in plan


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,?\n2,3.5\n")
    rows = readers.read_csv(spark, str(tmp_path / "a.csv")).select(readers.to_number(F.col("y")).alias("y")).collect()
    assert [r["y"] for r in rows] == [None, 3.5]
    (tmp_path / "pos").mkdir()
    (tmp_path / "pos" / "t.txt").write_text("one\ntwo")
    r = readers.read_text_folder(spark, str(tmp_path), "t.txt").first()
    assert (r["text"], r["label"]) == ("one\ntwo", "pos")
    (tmp_path / "a.xml").write_text("<r><annotation><filename>f</filename><object><name>cat</name><bndbox><xmin>1</xmin><ymin>2</ymin><xmax>3</xmax><ymax>4</ymax></bndbox></object></annotation></r>")
    assert tuple(readers.read_annotations(spark, str(tmp_path / "a.xml")).first()) == ("f", "cat", 1.0, 2.0, 3.0, 4.0)
    (tmp_path / "labels").write_bytes(bytes([0, 0, 8, 1, 0, 0, 0, 3, 7, 0, 9]))
    assert [r["label"] for r in readers.read_idx_labels(spark, str(tmp_path / "labels")).orderBy("pos").collect()] == [7, 0, 9]
    (tmp_path / "r.dat").write_text("1::5::4.0::99\n2::6::3.0::98\n")
    assert tuple(readers.read_ratings(spark, str(tmp_path / "r.dat")).orderBy("user").first()) == (0, 4, 4.0, 99)


def test_stream_moments_equal_the_table(spark, sf_dir, tmp_path):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "value")
    e.repartition(3).write.parquet(str(tmp_path / "in"))
    state = windows.RunningMoments(["value"])
    windows.for_each(windows.read_stream(spark, str(tmp_path / "in"), e), state.merge, str(tmp_path / "cp")).awaitTermination(60)
    mean, var = e.agg(F.avg("value"), F.var_samp("value")).first()
    assert abs(state.mean[0] - mean) < 1e-9 and abs(state.scatter[0, 0] / (state.n - 1) - var) < 1e-6


def test_stream_windows_with_watermark(spark, sf_dir, tmp_path):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("ts", "value")
    e.write.parquet(str(tmp_path / "in"))
    out = windows.windowed(windows.read_stream(spark, str(tmp_path / "in"), e), "ts", "value", [], "1 day", late="1 hour")
    q = out.writeStream.format("memory").queryName("windows_out").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("windows_out").count() > 0


def test_ranks_without_one_window(spark):
    from millrace.operators import ranks

    rows = spark.createDataFrame([((k * 37) % 101 if k % 9 else None, k) for k in range(500)], "x long, k long")
    found = ranks.ranked(rows, F.col("x"), F.col("k")).orderBy("rank").collect()
    want = sorted(((r["x"] is not None, r["x"] or 0, r["k"]) for r in found))
    assert [(r["x"] is not None, r["x"] or 0, r["k"]) for r in found] == want
    assert [r["rank"] for r in found] == list(range(1, 501)) and {r["rank_all"] for r in found} == {500}
    assert ranks.ranked(rows.limit(0), F.col("x"), F.col("k")).count() == 0


def test_softmax_is_linear_in_length(spark):
    import time

    from millrace.functions import vectors

    took = {}
    for n in (64, 1024):
        rows = spark.range(400).select(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda k: k.cast("double") / n).alias("v")).persist()
        rows.count()
        for _ in range(2):
            began = time.perf_counter()
            total = rows.select(F.aggregate(vectors.softmax(F.col("v")), F.lit(0.0), lambda a, x: a + x).alias("s")).agg(F.min("s"), F.max("s")).first()
            took[n] = time.perf_counter() - began
        assert abs(total[0] - 1) < 1e-9 and abs(total[1] - 1) < 1e-9
    assert took[1024] < 100 * took[64] + 2


def test_greedy_suppression_against_a_loop(spark):
    import random

    from millrace.operators import boxes

    rng = random.Random(8)
    rows = []
    for k in range(120):
        x, y = rng.uniform(0, 50), rng.uniform(0, 50)
        rows.append((k, k % 6, (x, y, x + rng.uniform(5, 30), y + rng.uniform(5, 30)), float(rng.randrange(20))))
    frame = spark.createDataFrame(rows, "k long, img long, box struct<x1:double,y1:double,x2:double,y2:double>, score double")
    area = lambda b: (b[2] - b[0]) * (b[3] - b[1])
    kept = []
    for k, img, b, _ in sorted(rows, key=lambda r: (-r[3], r[0])):
        common = lambda c: max(0, min(b[2], c[2]) - max(b[0], c[0])) * max(0, min(b[3], c[3]) - max(b[1], c[1]))  # noqa: B023, E731
        if all(i != img or common(c) <= 0.4 * (area(b) + area(c) - common(c)) for _, i, c in kept):
            kept.append((k, img, b))
    assert {r["k"] for r in boxes.suppressed(frame, "img", "k", "box", "score", 0.4).collect()} == {k for k, _, _ in kept}
    assert boxes.suppressed(frame.limit(0), "img", "k", "box", "score", 0.4).count() == 0


def test_neighbours_in_blocks(spark):
    from millrace.operators import neighbours

    rows = spark.range(60).select(F.col("id"), F.array((F.col("id") * 7 % 31).cast("double"), (F.col("id") * 5 % 17).cast("double")).alias("v"))
    one, many = (sorted(map(tuple, neighbours.knn(rows, rows, "id", "v", 3, block_rows=b).collect())) for b in (1000, 7))
    assert one == many and len(one) == 180
