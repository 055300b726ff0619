"""Text statistics, ranks, states of encoders, classifiers, mixtures, metrics, optimisers and codes against plain versions."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import classifiers, collate, fitted, metrics, mixtures, models, ordered, quality_metrics, quantize, ranks, resample, splits, text, tokenizers, trees

# text


def test_grams_of_long_texts(spark):
    words = [f"w{k % 97}" for k in range(6_000)]
    df = spark.createDataFrame([(1, " ".join(words)), (2, "a b"), (3, ""), (4, None), (5, "x")], "id long, t string")
    for n in (1, 2, 3):
        found = {(r["id"], r["gram"]): r["n"] for r in text.ngram_counts(df, "t", n, ["id"]).collect()}
        want = Counter((1, " ".join(words[k : k + n])) for k in range(len(words) - n + 1))
        want.update((2, g) for g in (["a", "b"], ["a b"], [])[n - 1])
        want.update((5, "x") for _ in range(n == 1))
        assert found == want


def plain_merges(counts, merges):
    words = {tuple(w): n for w, n in counts.items()}
    out = []
    for _ in range(merges):
        pairs = Counter()
        for w, n in words.items():
            for p in zip(w, w[1:]):
                pairs[p] += n
        if not pairs:
            break
        a, b = min(pairs, key=lambda p: (-pairs[p], p))
        out.append((a, b))
        after = Counter()
        for w, n in words.items():
            row = []
            for s in w:
                if row and row[-1] == a and s == b:
                    row[-1] = a + b
                else:
                    row.append(s)
            after[tuple(row)] += n
        words = after
    return out


@pytest.mark.parametrize("seed,letters", [(1, "ab"), (2, "abcdefgh"), (3, "abcdefghijklmnopqrstuvwxyz")])
def test_merges_are_those_of_one_after_another(spark, seed, letters):
    rng = random.Random(seed)
    words = Counter("".join(rng.choice(letters) for _ in range(rng.randrange(1, 8))) for _ in range(400))
    df = spark.createDataFrame([(" ".join(w for w, n in words.items() for _ in range(n)),), (None,)], "t string")
    assert text.bpe_merges(df, "t", 40, 12) == plain_merges(words, 40)
    assert text.bpe_merges(df.where("t is null"), "t", 5) == []


def test_several_merges_at_once():
    top = [("a", "b", 9), ("c", "d", 8), ("b", "e", 7), ("f", "g", 6)]
    assert text.surely_next([*top, ("", "", 0)], 4) == [("a", "b"), ("c", "d")]
    assert text.surely_next([("a", "a", 9), ("c", "d", 8)], 4) == [("a", "a")]
    assert text.surely_next([("a", "b", 9), ("c", "d", 8)], 4) == [("a", "b")]  # the list may go on with the same count


def test_vocabularies(spark, tmp_path):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(["low lower lowest", "new newer", "", "strange ☃ sign", None])], "id long, t string")
    words = text.word_table(df, "t")
    letters = tokenizers.alphabet(words)
    bpe = tokenizers.Vocabulary.bpe(text.bpe_merges(df, "t", 8), letters)
    uni = tokenizers.Vocabulary.unigram(tokenizers.unigram_train(df, "t", 30, rounds=1, steps=1))
    for v in (bpe, uni):
        v.save(spark, str(tmp_path / "v"))
        again = tokenizers.Vocabulary.load(spark, str(tmp_path / "v"))
        assert (again.tokens, again.special, again.merges) == (v.tokens, v.special, v.merges) and again.logs == pytest.approx(v.logs)
        rows = {r["id"]: r for r in df.select("id", "t", again.encode(F.col("t"), bos=True, eos=True).alias("ids")).withColumn("back", v.decode(F.col("ids"))).collect()}
        assert rows[4]["ids"] is None and rows[2]["ids"] == [2, 3]
        assert all(r["ids"][0] == 2 and r["ids"][-1] == 3 for r in rows.values() if r["ids"])
        assert rows[0]["back"] == "low lower lowest" and rows[1]["back"] == "new newer"
        assert 1 in rows[3]["ids"]  # the snow man is no word character, so no piece was learnt for it


@pytest.mark.parametrize("n", [0, 1, 7, 200])
def test_common_length(n):
    rng = random.Random(n)
    for _ in range(20):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(n + 1))] for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            before = row[:]
            for j, y in enumerate(b, 1):
                row[j] = before[j - 1] + 1 if x == y else max(before[j], row[j - 1])
        assert quality_metrics.common_length(a, b) == row[-1]


# ranks


def test_quantiles(spark):
    rng = np.random.default_rng(1)
    x, y = np.round(rng.normal(size=500), 1), np.array([3.0] * 480 + [1.0] * 20)
    df = spark.createDataFrame([(float(a), float(b), None) for a, b in zip(x, y)] + [(None, float("nan"), None)], "x double, y double, z double").repartition(5)
    row = ranks.quantiles(df, ["x", "y", "z"], [0.0, 0.1, 0.333, 0.5, 1.0]).first()
    assert np.allclose(row["q_x"], np.quantile(x, [0, 0.1, 0.333, 0.5, 1])) and np.allclose(row["q_y"], np.quantile(y, [0, 0.1, 0.333, 0.5, 1]))
    assert row["q_z"] == [None] * 5
    assert ranks.quantiles(df.limit(0), ["x"], [0.5]).first()["q_x"] == [None]


def test_ranks_within_groups_and_of_words(spark):
    rows = [(k, "big" if k % 4 else f"g{k % 8}", (k * 37) % 101) for k in range(300)] + [(900, None, 3), (901, None, 1)]
    df = spark.createDataFrame(rows, "id long, g string, x long").repartition(6)
    for r in ranks.ranked(df, F.col("x"), F.col("id"), by="g").collect():
        own = sorted((x, k) for k, g, x in rows if g == r["g"])
        assert own[r["rank"] - 1] == (r["x"], r["id"]) and r["rank_all"] == len(own)
    words = [f"{chr(97 + k % 26)}{k}" for k in range(200)] + [None]
    found = {r["w"]: r["n"] for r in ranks.numbered(spark.createDataFrame([(w,) for w in words], "w string"), "w", "n").collect()}
    assert [w for w, _ in sorted(found.items(), key=lambda p: p[1])] == [None, *sorted(words[:-1])]


def test_batches_and_splits(spark):
    df = spark.createDataFrame([(k * k * 7, k % 3) for k in range(100)], "id long, y int").repartition(4)
    found = {r["id"]: r["batch"] for r in text.batches(df, "id", 8).collect()}
    assert found == {k * k * 7: k // 8 for k in range(100)}
    mixed = Counter(r["batch"] for r in text.batches(df, "id", 8, seed=3, drop_last=True).collect())
    assert mixed == {k: 8 for k in range(12)}
    parts = splits.shuffle_splits(df, "id", 3, 0.2, 0.5, seed=1, by="y").collect()
    for k in range(3):
        for y, n in ((0, 34), (1, 33), (2, 33)):
            own = [r for r in parts if r["split"] == k and r["y"] == y]
            assert Counter(r["part"] for r in own) == {"test": round(n * 0.2), "train": math.floor(n * 0.5 + 0.5)} and len({r["id"] for r in own}) == len(own)
    assert len({frozenset(r["id"] for r in parts if r["split"] == k and r["part"] == "test") for k in range(3)}) == 3


def test_collation(spark):
    rows = [(1, 0, [1, 2], [[1.0, 2.0]], [(0.0, 1.0)], [7]), (2, 0, [], [[3.0, 4.0], [5.0, 6.0]], [], []), (3, 0, None, [], None, None), (4, 1, [9], [[7.0, 8.0]], [(2.0, 3.0)], [1])]
    df = spark.createDataFrame(rows, "id long, b int, ids array<long>, video array<array<double>>, boxes array<struct<x:double,y:double>>, labels array<int>").repartition(3)
    found = {r["b"]: r for r in collate.collated(df, "b", "id", [], {"ids": 0, "video": 0.0, "boxes": 0.0, "labels": -1}).collect()}
    assert found[0]["ids"] == [[1, 2], [0, 0], [0, 0]] and found[0]["ids_length"] == [2, 0, 0] and found[0]["ids_mask"] == [[1, 1], [0, 0], [0, 0]]
    assert found[0]["video"] == [[[1.0, 2.0], [0.0, 0.0]], [[3.0, 4.0], [5.0, 6.0]], [[0.0, 0.0], [0.0, 0.0]]]
    assert [[tuple(b) for b in row] for row in found[0]["boxes"]] == [[(0.0, 1.0)], [(0.0, 0.0)], [(0.0, 0.0)]] and found[0]["labels"] == [[7], [-1], [-1]]
    assert found[1]["n"] == 1 and found[1]["ids"] == [[9]]
    pairs = df.select("id", *[c.alias(n) for n, c in zip("xy", collate.next_token_pairs(F.col("ids")))]).orderBy("id").collect()
    assert [r["y"] for r in pairs] == [[2, -100], [], None, [-100]]


# encoders


def test_states_of_encoders(spark):
    df = spark.createDataFrame([(k, ["b", "a", "c", None][k % 4], [10, 9, 9][k % 3]) for k in range(24)], "id long, s string, n int")
    state = fitted.fit_categories(df, ["s", "n"])
    assert {(r["column"], r["value"]): (r["code"], r["often"]) for r in state.collect()} == {("s", "a"): (0, 6), ("s", "b"): (1, 6), ("s", "c"): (2, 6), ("n", "9"): (0, 16), ("n", "10"): (1, 8)}
    new = spark.createDataFrame([(1, "c", 10), (2, "zz", 9), (3, None, None)], "id long, s string, n int")
    codes = fitted.encode_labels(new, state, "s", unknown="minus")
    assert {r["id"]: r["code"] for r in codes.collect()} == {1: 2, 2: -1, 3: None}
    assert {r["id"]: r["s"] for r in fitted.decode_labels(codes.drop("s"), state, "s").collect()} == {1: "c", 2: None, 3: None}
    with pytest.raises(Exception, match="not seen"):
        fitted.encode_labels(new, state, "s").collect()
    hot = {r["id"]: (r["hot"]["size"], r["hot"]["indices"]) for r in fitted.one_hot_vectors(new, state, ["s", "n"]).collect()}
    assert hot == {1: (5, [2, 4]), 2: (5, [3]), 3: (5, [])}
    less = {r["id"]: r["hot"]["indices"] for r in fitted.one_hot_vectors(new, state, ["s", "n"], drop_first=True).collect()}
    assert less == {1: [1, 2], 2: [], 3: []}
    filled = {r["id"]: (r["s"], r["n"]) for r in fitted.fill_most_frequent(new, state, ["s", "n"]).collect()}
    assert filled == {1: ("c", 10), 2: ("zz", 9), 3: ("a", 9)}
    assert [r["value"] for r in fitted.rare_values(state, "n", 0.4).collect()] == ["10"]


def test_rare_and_swapped_categories(spark):
    df = spark.createDataFrame([(k, "rare" if k < 10 else "common", k % 7, k % 2) for k in range(400)], "id long, c string, d int, y int")
    weights = {r["id"]: r["weight"] for r in resample.rare_weights(df, ["c"], eps=0.0).collect()}
    assert weights[0] == pytest.approx(1 / 10) and weights[50] == pytest.approx(1 / 390)
    taken = resample.rare_resampled(df, ["c"], "id", 1000).collect()
    assert len(taken) == 1000 and 0.4 < sum(r["c"] == "rare" for r in taken) / 1000 < 0.6
    swapped = {r["id"]: r for r in resample.category_swapped(df, ["c", "d"], "y", "id", 0.5, 0.9).collect()}
    changed = [k for k, r in swapped.items() if r["d"] != k % 7]
    assert len(swapped) == 400 and 60 < len(changed) < 240 and all(r["y"] == k % 2 for k, r in swapped.items())


# classifiers


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(3)
    y = rng.integers(0, 3, 300)
    x = rng.normal(size=(300, 4)) + np.eye(4)[y] * 2
    df = spark.createDataFrame([(k, p.tolist(), int(c) * 10, *p.tolist()) for k, (p, c) in enumerate(zip(x, y))], "id long, v array<double>, y int, a double, b double, c double, d double").repartition(4).persist()
    return df, x, y


def found_in(df):
    rows = df.orderBy("id").collect()
    return np.array([r["predicted"] for r in rows]), np.array([r["proba"] for r in rows])


def test_bernoulli(points):
    df, x, y = points
    on, prior = np.array([((x[y == c] > 0.2).sum(0) + 1) / ((y == c).sum() + 2) for c in range(3)]), np.array([(y == c).mean() for c in range(3)])
    z = np.log(prior) + (x > 0.2) @ np.log(on).T + (x <= 0.2) @ np.log(1 - on).T
    p = np.exp(z) / np.exp(z).sum(1, keepdims=True)
    got, chances = found_in(classifiers.BernoulliNB.fit(df, list("abcd"), "y", threshold=0.2).predict(df))
    assert (got == p.argmax(1) * 10).all() and np.allclose(chances, p)


def test_discriminant_analysis(points):
    df, x, y = points
    means = np.array([x[y == c].mean(0) for c in range(3)])
    pooled = sum((x[y == c] - means[c]).T @ (x[y == c] - means[c]) for c in range(3)) / (300 - 3)
    inverse = np.linalg.inv(pooled)
    z = x @ inverse @ means.T - 0.5 * np.einsum("ci,ij,cj->c", means, inverse, means) + np.log([(y == c).mean() for c in range(3)])
    p = np.exp(z - z.max(1, keepdims=True))
    got, chances = found_in(classifiers.discriminant_analysis(df, "v", "y").predict(df, "v"))
    assert (got == z.argmax(1) * 10).all() and np.allclose(chances, p / p.sum(1, keepdims=True), atol=1e-6)


def test_softmax_regression(spark, points):
    df, x, y = points
    w, ones = np.zeros((3, 5)), np.concatenate([np.ones((300, 1)), x], 1)
    for _ in range(15):
        z = ones @ w.T
        p = np.exp(z) / np.exp(z).sum(1, keepdims=True)
        w = w - 0.5 * ((p - np.eye(3)[y]).T @ ones / 300 + 0.1 * np.concatenate([np.zeros((3, 1)), w[:, 1:]], 1))
    model = classifiers.softmax_regression(df.unionByName(df.limit(1).withColumn("v", F.lit(None).cast("array<double>"))), "v", "y", 15, 0.5, 0.1)
    assert np.allclose(np.concatenate([model.bias[:, None], model.weights], 1), w)
    got, _ = found_in(model.predict(df, "v"))
    assert (got == y * 10).mean() > 0.8
    with pytest.raises(ValueError):
        classifiers.softmax_regression(df.limit(0), "v", "y")


def test_multinomial(spark):
    rng = random.Random(2)
    docs = [(k, k % 3, Counter(rng.choice("abcdefgh"[(k % 3) * 2 :]) for _ in range(12))) for k in range(30)] + [(90, 0, Counter({"new": 4})), (91, 1, Counter({"a": 1, "new": 2}))]
    train = spark.createDataFrame([(k, y, w, n) for k, y, c in docs[:30] for w, n in c.items()], "id long, y int, w string, n long")
    model = models.multinomial_nb(train, "y", "w", "n")
    priors = spark.createDataFrame([(0, 5), (1, 10), (2, 15)], "y int, n long")
    asked = spark.createDataFrame([(k, w, n) for k, _, c in docs for w, n in c.items()], "id long, w string, n long")
    sums = {y: sum((c for _, z, c in docs[:30] if z == y), Counter()) for y in range(3)}
    v = len(set().union(*sums.values()))
    got = {r["id"]: r for r in classifiers.multinomial_predict(asked, model, priors, "id", "y", "w", "n").collect()}
    for k, _, c in docs:
        z = [math.log((5, 10, 15)[y] / 30) + sum(n * math.log((sums[y][w] + 1) / (sum(sums[y].values()) + v)) for w, n in c.items() if any(w in s for s in sums.values())) for y in range(3)]
        assert got[k]["predicted"] == max(range(3), key=lambda y: (z[y], -y)) and got[k]["score"] == pytest.approx(max(z))


def test_full_mixture(spark):
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(size=(150, 2)) @ [[1, 0.9], [0, 0.3]], rng.normal(size=(100, 2)) @ [[0.5, 0], [-0.4, 0.5]] + 4]) + 1000
    df = spark.createDataFrame([(p.tolist(),) for p in x] + [(None,)], "v array<double>").repartition(3)
    start = np.array([[999.0, 1000.0], [1005.0, 1003.0]])
    w, m, c = np.full(2, 0.5), start, np.tile(np.cov(x.T, ddof=0) + 1e-6 * np.eye(2), (2, 1, 1))
    for _ in range(6):
        z = np.stack([np.log(w[j]) - 0.5 * np.einsum("ni,ij,nj->n", x - m[j], np.linalg.inv(c[j]), x - m[j]) - 0.5 * np.log(np.linalg.det(2 * np.pi * c[j])) for j in range(2)], 1)
        like = np.log(np.exp(z).sum(1)).mean()
        r = np.exp(z) / np.exp(z).sum(1, keepdims=True)
        w, m = r.mean(0), (r.T @ x) / r.sum(0)[:, None]
        c = np.array([((x - m[j]) * r[:, j : j + 1]).T @ (x - m[j]) / r[:, j].sum() + 1e-6 * np.eye(2) for j in range(2)])
    (gw, gm, gc), now = mixtures.full_mixture(df, "v", start, 6, tol=-1e9)
    assert np.allclose(gw, w) and np.allclose(gm, m) and np.allclose(gc, c, atol=1e-8) and now == pytest.approx(like)


def test_a_forest_sums_what_a_tree_sums(spark, points):
    df, x, y = points
    alone = trees.grow(df, list("abcd"), [F.col("y")], 3)[0]
    several = trees.grow(df, list("abcd"), [F.col("y")], 3, weights=[F.lit(1.0), F.lit(2.0), F.lit(0.0)])
    assert several[0].splits == alone.splits and {n: s[:2] for n, s in several[1].splits.items()} == {n: s[:2] for n, s in alone.splits.items()}
    assert several[2].splits == {} and several[2].values == {1: [0.0]}
    odd = df.withColumn("a", F.when(F.col("id") % 5 == 0, None).when(F.col("id") % 7 == 0, float("nan")).otherwise(F.col("a")))
    tree = trees.grow(odd, list("abcd"), [F.col("y")], 3)[0]
    for node, n, mean in odd.groupBy(tree.node()).agg(F.count("*"), F.avg("y")).collect():
        assert tree.values[node][0] == pytest.approx(mean)


# metrics


def plain_auroc(s, y):
    pairs = [(a > b) + 0.5 * (a == b) for a, p in zip(s, y) if p for b, q in zip(s, y) if not q]
    return sum(pairs) / len(pairs) if pairs else 0.5


def test_metrics_of_many_labels(spark):
    rng = np.random.default_rng(5)
    s, y = np.round(rng.random((60, 4)), 1), rng.integers(0, 2, (60, 4))
    y[:, 3] = 0
    df = spark.createDataFrame([(a.tolist(), b.tolist()) for a, b in zip(s, y)], "s array<double>, y array<int>").repartition(3)
    found = metrics.multilabel_auroc(df, "s", "y").first()
    each = [plain_auroc(s[:, c], y[:, c]) for c in range(4)]
    assert np.allclose(found["per_class"], each) and found["macro"] == pytest.approx(np.mean(each))
    assert found["micro"] == pytest.approx(plain_auroc(s.ravel(), y.ravel())) and found["weighted"] == pytest.approx((each * y.sum(0)).sum() / y.sum())
    precise = metrics.multilabel_auprc(df, "s", "y").first()
    for c in range(4):
        one = spark.createDataFrame([(float(a), int(b)) for a, b in zip(s[:, c], y[:, c])], "s double, y int")
        assert precise["per_class"][c] == pytest.approx(metrics.auprc(one, "s", "y").first()[0])
    assert precise["per_class"][3] == 0


# optimisers


def plain_run(kind, w, grads, lr=0.01, b1=0.9, b2=0.999, eps=1e-8, decay=0.01):
    m = v = u = 0.0
    out = []
    for t, g in enumerate(grads, 1):
        before = m
        if kind not in ("adagrad", "rmsprop", "adadelta"):
            m, v = b1 * m + (1 - b1) * g, b2 * v + (1 - b2) * g * g
        mh, vh = m / (1 - b1**t), v / (1 - b2**t)
        if kind == "sgd":
            w -= lr * g
        elif kind == "momentum":
            w -= lr * m
        elif kind == "nesterov":
            w -= lr * (b1 * m + (1 - b1) * g)
        elif kind == "adagrad":
            v += g * g
            w -= lr * g / (v**0.5 + eps)
        elif kind == "rmsprop":
            v = 0.9 * v + 0.1 * g * g
            w -= lr * g / (v**0.5 + eps)
        elif kind == "adadelta":
            v = 0.95 * v + 0.05 * g * g
            d = (u + eps) ** 0.5 / (v + eps) ** 0.5 * g
            u = 0.95 * u + 0.05 * d * d
            w -= d
        elif kind in ("adam", "adamw"):
            w -= lr * mh / (vh**0.5 + eps) + (lr * decay * w if kind == "adamw" else 0)
        elif kind == "nadam":
            w -= lr * (b1 * mh + (1 - b1) * g / (1 - b1**t)) / (vh**0.5 + eps)
        elif kind == "radam":
            most = 2 / (1 - b2) - 1
            rho = most - 2 * t * b2**t / (1 - b2**t)
            r = ((rho - 4) * (rho - 2) * most / ((most - 4) * (most - 2) * rho)) ** 0.5 if rho > 4 else None
            w -= lr * mh if r is None else lr * mh * r / (vh**0.5 + eps)
        elif kind == "lion":
            sign = np.sign(b1 * before + (1 - b1) * g)
            w -= lr * sign + lr * decay * w
            m = b2 * before + (1 - b2) * g
        elif kind == "qhadam":
            w -= lr * (0.3 * g + 0.7 * mh) / (vh**0.5 + eps)
        out.append(w)
    return out


@pytest.mark.parametrize("kind", ["sgd", "momentum", "nesterov", "adagrad", "rmsprop", "adadelta", "adam", "adamw", "nadam", "radam", "lion", "qhadam"])
def test_optimisers_carry_their_moments(spark, kind):
    grads = np.random.default_rng(4).normal(size=12).tolist()
    found = spark.range(1).select(ordered.optimised(F.lit(0.5), F.lit(grads), kind).alias("w")).first()["w"]
    assert np.allclose(found, plain_run(kind, 0.5, grads), atol=1e-12)


def test_rates_that_follow_the_run(spark):
    losses = [5.0, 4.0, 4.0, 4.5, 4.1, 3.9, 4.0, 4.0, 4.0, 4.0]
    rates = spark.range(1).select(ordered.plateau_rates(F.lit(losses), 0.1, 0.5, 2).alias("r")).first()["r"]
    assert np.allclose(rates, [0.1, 0.1, 0.1, 0.1, 0.05, 0.05, 0.05, 0.05, 0.025, 0.025])
    cycle = [r[0] for r in spark.range(100).orderBy("id").select(ordered.one_cycle(F.col("id"), 100)).collect()]
    assert cycle[0] == pytest.approx(0.004) and max(cycle) == pytest.approx(0.1) and cycle.index(max(cycle)) == 29 and cycle[-1] == pytest.approx(0.004 / 1e4)
    bars = ordered.alpha_bars()
    assert len(bars) == 1000 and bars[0] == pytest.approx(0.9999) and bars[-1] == pytest.approx(np.prod(1 - np.linspace(0.0001, 0.02, 1000)))


# codes


def test_bytes_of_eight_bits(spark):
    df = spark.range(256).select(F.col("id").cast("int").alias("byte"), quantize.fp8_value(F.col("id").cast("int")).alias("v"))
    rows = df.withColumn("back", quantize.fp8_byte(F.col("v"))).collect()
    for r in rows:
        assert r["back"] == (127 if r["byte"] in (127, 255) else 0 if r["byte"] == 128 else r["byte"]), r
    assert rows[126]["v"] == 448.0 and rows[1]["v"] == 2.0**-9 and rows[56]["v"] == 1.0 and rows[184]["v"] == -1.0
    ends = spark.createDataFrame([(1e9,), (-1e9,), (float("nan"),), (None,), (1.0625,)], "x double").select(quantize.fp8_byte(F.col("x"))).collect()
    assert [r[0] for r in ends] == [126, 254, 127, 127, 56]


def test_packed_codes(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(3, 37))
    df = spark.createDataFrame([(r, k, float(x[r, k])) for r in range(3) for k in range(37)], "r int, k long, x double").repartition(4)
    packed = quantize.packed_blocks_4bit(df, "r", "k", "x", 16)
    assert sorted((r["r"], r["block_no"], r["n"], len(r["packed"])) for r in packed.collect()) == [(r, b, n, (n + 1) // 2) for r in range(3) for b, n in enumerate((16, 16, 5))]
    back = {(r["r"], r["k"]): r["restored"] for r in quantize.unpacked_blocks_4bit(packed, "r", "k", 16).collect()}
    exact = {(r["r"], r["k"]): (r["restored"], r["scale"]) for r in quantize.quantize_4bit(df, "r", "k", "x", 16).collect()}
    assert all(abs(back[p] - v) <= s / 16 + 1e-9 for p, (v, s) in exact.items()) and len(back) == 111  # a scale is off by a sixteenth at most
