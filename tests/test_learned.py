"""Trees, tokenizers, metrics, fitted states and augmentations against plain versions on small tables."""

import math
import random
from itertools import product

import pytest
from pyspark.sql import functions as F

from millrace.operators import augment, fitted, mixtures, quality_metrics, synthetic, tokenizers, trees


def best_cut(rows, features, y):
    """The plain best cut: (gain, feature, threshold), by all midpoints."""
    square = lambda part: sum(part) ** 2 / len(part)
    found = []
    for i, f in enumerate(features):
        values = sorted({r[f] for r in rows})
        for a, b in zip(values, values[1:]):
            left, right = [r[y] for r in rows if r[f] <= a], [r[y] for r in rows if r[f] > a]
            found.append((round(square(left) + square(right) - square(left + right), 9), -i, -(a + b) / 2))
    gain, i, cut = max(found)
    return gain, features[-i], -cut


def test_tree_is_the_plain_one(spark):
    draw = random.Random(3)
    rows = [{"a": float(draw.randrange(12)), "b": float(draw.randrange(9)), "y": draw.gauss(0, 1)} for _ in range(300)]
    tree = trees.regressor(spark.createDataFrame(rows), ["a", "b"], "y", 2, bins=64)

    def check(part, node):
        gain, f, cut = best_cut(part, ["a", "b"], "y")
        assert tree.splits[node][0] == f and tree.splits[node][1] == cut and tree.splits[node][2] == pytest.approx(gain, abs=1e-6)
        return [r for r in part if r[f] <= cut], [r for r in part if r[f] > cut]

    left, right = check(rows, 1)
    for part, node in ((left, 2), (right, 3)):
        for side, leaf in zip(check(part, node), (2 * node, 2 * node + 1)):
            assert tree.values[leaf][0] == pytest.approx(sum(r["y"] for r in side) / len(side))


def test_cuts_of_many_values_keep_sides_as_counted(spark):
    draw = random.Random(4)
    d = spark.createDataFrame([(draw.random(), draw.random()) for _ in range(2000)], "a double, y double")
    tree = trees.regressor(d, ["a"], "y", 3, bins=16)
    for node, n, mean in d.groupBy(tree.node()).agg(F.count("*"), F.avg("y")).collect():
        assert tree.values[node][0] == pytest.approx(mean)


def test_tree_of_odd_tables(spark):
    empty = spark.createDataFrame([], "a double, y double")
    assert trees.regressor(empty, ["a"], "y").values == {1: [0.0]}
    nulls = spark.createDataFrame([(None, 1.0), (None, 1.0), (2.0, 5.0), (3.0, 5.0), (4.0, None)], "a double, y double")
    tree = trees.regressor(nulls, ["a"], "y", 1)
    assert not tree.splits or tree.splits[1][0] == "a"
    same = spark.createDataFrame([(1.0, 2.0)] * 5, "a double, y double")
    assert trees.regressor(same, ["a"], "y").splits == {}


def test_ensembles_tell_unseen_rows(spark):
    d = synthetic.classification(spark, 1200, 3, 2, seed=5).select("id", "label", *[F.col("v")[k].alias(f"f{k}") for k in range(3)]).cache()
    old, new = d.where("id < 800"), d.where("id >= 800")
    f, marks = ["f0", "f1", "f2"], [(F.col("label") == c).cast("double") for c in (0, 1)]
    share = lambda p: new.agg(F.avg((p == F.col("label")).cast("double"))).first()[0]
    assert share(trees.vote(trees.forest(old, f, marks, "id", 5, 3), [0, 1])) > 0.9
    assert share((trees.boosted(old, f, "label", 5, 2, 0.5, logistic=True) > 0.5).cast("int")) > 0.9
    assert share(trees.adaboost(old, f, "label", 3)[0]) > 0.9


def segmentations(word, logs):
    if not word:
        return [[]]
    return [[word[:k], *rest] for k in range(1, len(word) + 1) if word[:k] in logs for rest in segmentations(word[k:], logs)]


def test_unigram_counts_and_best_path():
    logs = {p: math.log(x) for p, x in {"a": 0.3, "b": 0.2, "ab": 0.25, "aba": 0.15, "ba": 0.1}.items()}
    for n in range(1, 7):
        for word in map("".join, product("ab", repeat=n)):
            every = segmentations(word, logs)
            weights = [math.exp(sum(logs[p] for p in s)) for s in every]
            like, counts = tokenizers.expected(word, logs, 3, -30.0)
            assert like == pytest.approx(math.log(sum(weights)))
            for p in logs:
                plain = sum(w * s.count(p) for w, s in zip(weights, every)) / sum(weights)
                assert counts.get(p, 0.0) == pytest.approx(plain, abs=1e-9)
            found = tokenizers.best_pieces(word, logs, 3, -30.0)
            assert sum(logs[p] for p in found) == pytest.approx(math.log(max(weights)))


def test_unigram_steps_raise_the_likelihood(spark):
    words = spark.createDataFrame([("banana", 5), ("bandana", 3), ("cabana", 2), ("nan", 4)], "word string, n long")
    logs, seen = tokenizers.unigram_start(words, 20, 4), []
    for _ in range(4):
        logs, like = tokenizers.unigram_step(words, logs)
        seen.append(like)
    assert seen == sorted(seen) and sum(map(math.exp, logs.values())) == pytest.approx(1)


def test_bpe_applies_merges_in_order(spark):
    ranks = {("a", "b"): 0, ("ab", "c"): 1, ("b", "c"): 2}
    assert tokenizers.merged("abcbc", ranks) == ["abc", "bc"] and tokenizers.merged("aaab", {("a", "a"): 0}) == ["aa", "a", "b"]
    d = spark.createDataFrame([(" abc  bc\n",), ("",), (None,)], "t string")
    out = d.select(tokenizers.bpe_encode(F.col("t"), list(ranks)).alias("s")).select("s", tokenizers.bpe_decode(F.col("s")).alias("t")).collect()
    assert [(r.s, r.t) for r in out] == [(["abc", "</w>", "bc", "</w>"], "abc bc"), ([], ""), (None, None)]


def plain_common(a, b):
    return 0 if not a or not b else plain_common(a[:-1], b[:-1]) + 1 if a[-1] == b[-1] else max(plain_common(a[:-1], b), plain_common(a, b[:-1]))


def test_common_subsequences(spark):
    draw = random.Random(1)
    rows = [([draw.choice("abc") for _ in range(draw.randrange(7))], [draw.choice("abc") for _ in range(draw.randrange(7))]) for _ in range(60)]
    assert all(quality_metrics.common_length(a, b) == plain_common(a, b) for a, b in rows)
    d = spark.createDataFrame([*rows, (None, ["a"])], "a array<string>, b array<string>")
    assert [r[0] for r in d.select(quality_metrics.lcs(F.col("a"), F.col("b"))).collect()] == [*(plain_common(a, b) for a, b in rows), None]


def test_states_of_one_table_scale_another(spark):
    old, new = spark.createDataFrame([(0.0,), (10.0,)], "x double"), spark.createDataFrame([(5.0,), (20.0,), (None,)], "x double")
    assert [r.x for r in fitted.transform(new, fitted.fit(old, ["x"], "minmax", -1, 1), ["x"]).collect()] == [0.0, 3.0, None]
    assert [r.x for r in fitted.transform(new, fitted.fit(old, ["x"], "fill_mean"), ["x"]).collect()] == [5.0, 20.0, 5.0]


def test_mixture_finds_two_groups(spark):
    draw = random.Random(2)
    d = spark.createDataFrame([(draw.gauss(0 if k % 2 else 8, 1),) for k in range(600)], "x double")
    (w, m, v), _ = mixtures.mixture(d, ["x"], [[1.0], [5.0]], 30)
    assert [float(x[0]) for x in m] == pytest.approx([0, 8], abs=0.2) and list(w) == pytest.approx([0.5, 0.5], abs=0.05) and float(v[0][0]) == pytest.approx(1, abs=0.25)


def test_augmentations_are_repeatable_and_take_odd_rows(spark):
    d = spark.createDataFrame([(1, "one two three", [1.0, 2.0, 3.0]), (2, "", []), (3, None, None)], "id long, t string, s array<double>")
    t, s = F.col("t"), F.col("s")
    steps = [augment.swap_words(t, "id"), augment.delete_words(t, "id", 0.9), augment.typos(t, "id", 0.5), augment.insert_words(t, "id", ["x"], 0.5), augment.random_case(t, "id", 0.9), augment.window(s, "id", 2), augment.permuted(s, "id", 2), augment.time_masked(s, "id", 1)]
    both = [d.repartition(n).select("id", *steps).orderBy("id").collect() for n in (1, 3)]
    assert both[0] == both[1] and all(x is None for x in both[0][2][1:6])
    whole = augment.composed(augment.sometimes(F.upper, "id", 1.0), augment.one_of([F.reverse], "id"))
    assert d.select(whole(t).alias("t")).first().t == "EERHT OWT ENO"
