"""Vector codes, prefix tries and the digest index against plain versions."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import exact, frequent, scratch, tries, yinyang

# 11


def plain_codes(rows, parts=4, entries=256, rounds=4, scale=1024):
    """(vec_id, code, error) by Lloyd rounds over all entries, in Python integers."""
    kept = [(i, [int(np.floor(scale * float(x))) for x in v]) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, np.array(r[1], np.int64).tobytes()))
    width = len(kept[0][1]) // parts
    books = [[v[k * width : (k + 1) * width] for _, v in kept[:entries]] for k in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), n) for n, e in enumerate(book))

    for turn in range(rounds + 1):
        found = [[nearest(v[k * width : (k + 1) * width], books[k]) for k in range(parts)] for _, v in kept]
        if turn == rounds:
            return [(i, "".join(f"{n:02x}" for _, n in f), sum(d for d, _ in f)) for (i, _), f in zip(kept, found)], books
        for k in range(parts):
            own = defaultdict(list)
            for (_, v), f in zip(kept, found):
                own[f[k][1]].append(v[k * width : (k + 1) * width])
            books[k] = [[sum(c) // len(c) for c in zip(*own[n])] if n in own else e for n, e in enumerate(books[k])]


def test_codes_against_plain_lloyd_rounds(spark):
    rng = random.Random(5)
    rows = [(i, [rng.choice([-1.0, -0.5, 0.0, 0.25, 0.3]) + rng.random() / 50 * (i % 3) for _ in range(8)], i % 4 if i % 7 else None) for i in range(150)]
    rows += [(i, rows[3][1], 9) for i in range(200, 260)]  # copies of one vector
    rows += [(7, rows[9][1], 1), (7, rows[9][1], 1), (None, rows[11][1], 2)]  # repeated rows and ids, a null id
    odd = [(900, None, 1), (901, [0.0] * 7 + [None], 1), (902, [float("nan")] * 8, 1), (903, [float("inf")] + [0.0] * 7, 1)]
    table = spark.createDataFrame([(*r, "x") for r in rows + odd], "vec_id long, embedding array<double>, label int, code string").repartition(5)
    want, books = plain_codes([(i, v) for i, v, _ in rows], entries=20)
    found = yinyang.compress(table, entries=20, groups=5).collect()
    assert sorted((str(r["vec_id"]), r["code"], r["error"]) for r in found) == sorted((str(i), c, e) for i, c, e in want)
    text = ",".join(str(x) for b in books for e in b for x in e)
    assert {r["codebooks_sha256"] for r in found} == {hashlib.sha256(text.encode()).hexdigest()}
    assert {r["label_error"] for r in found if r["vec_id"] in (210, 230)} == {sum(e for i, _, e in want if i is not None and i >= 200)}


def test_codes_of_empty_tables_and_of_lengths(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert yinyang.compress(empty).count() == 0
    rows = [(1, [1.0, 2.0, 3.0], None), (2, [1.0, 2.0, 3.0], 1), (3, [5.0] * 4, 1), (4, [], 2)]
    found = {r["vec_id"]: r for r in yinyang.compress(spark.createDataFrame(rows, empty.schema)).collect()}
    assert {k: (r["code"], r["error"]) for k, r in found.items()} == {1: ("00000000", 0), 2: ("00000000", 0), 3: ("00000000", 0), 4: ("00000000", 0)}
    assert found[1]["codebooks_sha256"] != found[3]["codebooks_sha256"]
    with pytest.raises(Exception, match="too large"):
        yinyang.compress(spark.createDataFrame([(1, [1e30] * 4, 1)], empty.schema)).collect()
    with pytest.raises(ValueError, match="far apart"):
        yinyang.compress(spark.createDataFrame([(1, [1e7] * 4, 1), (2, [-1e7] * 4, 1)], empty.schema))


def test_codes_far_from_the_origin(spark):
    rng = random.Random(6)
    rows = [(i, [1e9 + rng.randrange(5) + rng.random() / 8 for _ in range(8)], 1) for i in range(80)]
    want, _ = plain_codes([(i, v) for i, v, _ in rows], entries=9)
    found = yinyang.compress(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), entries=9, groups=3).collect()
    assert sorted((r["vec_id"], r["code"], r["error"]) for r in found) == sorted(want)


@pytest.mark.parametrize("spread", [3, 1000, 1 << 23])
def test_bounds_scan_less_and_change_nothing(spread):
    rng = np.random.default_rng(2)
    centres = rng.integers(-spread, spread + 1, (40, 6))
    x = centres[rng.integers(0, 40, 4000)] + rng.integers(-max(spread // 50, 1), max(spread // 50, 1) + 1, (4000, 6))
    book = x[:64].copy()
    book[5] = book[9]  # equal entries: the lower number takes the rows
    groups = yinyang.grouped_entries(book, 8)
    assert sorted(np.concatenate(groups).tolist()) == list(range(64))
    code = bounds = None
    moves, work = np.zeros(64), []
    for _ in range(6):
        code, bounds, best, scanned = yinyang.assign(x, book, groups, code, bounds, moves)
        d = ((x[:, None] - book[None]) ** 2).sum(2)
        assert (code == d.argmin(1)).all() and (best == d.min(1)).all()
        for g, members in enumerate(groups):  # every bound holds
            others = np.where(members[None] == code[:, None], np.iinfo(np.int64).max, d[:, members])
            assert (bounds[:, g] <= np.sqrt(others.min(1))).all()
        work.append(scanned)
        after = np.array([np.floor_divide(x[code == e].sum(0), (code == e).sum()) if (code == e).any() else book[e] for e in range(64)])
        moves = np.sqrt(((after - book) ** 2).sum(1))
        book = after
    assert work[-1] < work[0] / (2 if spread > 3 else 1)


# 12


def plain_nodes(rows):
    """The nodes by prefixes of the rebuilt conversations, from (conv_id, turn, role, text)."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            step = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]
            own[c].append((turn is not None, turn or 0, step, (role, text)))
    turns = {c: [t[3] for t in sorted(ts)] for c, ts in own.items()}
    built = {}
    for c, ts in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = turns.get(c - int(np.fmod(c, 5)), [])[:h] + ts[h:]
    members = defaultdict(list)
    for c, ts in built.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    out = []
    for p, cs in members.items():
        below = [q for q in members if q[: len(p)] == p]
        saved = sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in below if q)
        ends = ",".join(str(c) for c in sorted(c for c in cs if len(built[c]) == len(p)))
        out.append((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), len(kids[p]), sum(not kids[q] for q in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def nodes_of(table, **limits):
    found = tries.trie(tries.sequences(tries.spliced(tries.ordered_turns(table))), **limits)
    return sorted([tuple(r) for r in found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()], key=str)


def conversations(rng):
    rows = []
    for c in [*range(-6, 90), 5_000, 9_001, 9_002]:
        hot = rng.random() < 0.5
        for turn in range(rng.randrange(1, 14)):
            text = f"tale {turn}" if hot and turn < 6 else f"word {rng.randrange(3)} é"
            rows.append((c, turn, rng.choice(["user", None, ""]) if turn > 8 else "user", text if rng.random() < 0.95 else None))
    rows += [(12, None, "user", "null turn"), (12, 3, "user", "again"), (12, 3, "user", "again"), (None, 1, "user", "nobody")]
    same = [("user", "q"), ("bot", "a"), ("user", "é" * 40)]
    return rows + [(c, t, *same[t]) for c in range(20_000, 20_060) for t in range(3)]


@pytest.mark.parametrize("most", [100_000, 60, 1])
def test_trie_against_prefixes(spark, most):
    rows = conversations(random.Random(3))
    table = spark.createDataFrame([(*r, "k") for r in rows], "conv_id long, turn long, role string, text string, place string")
    assert nodes_of(table, most_turns=most, least_turns=1) == plain_nodes(rows)


def test_trie_of_odd_tables(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert nodes_of(spark.createDataFrame([], schema)) == []
    alone = [(11, 0, "user", "x")]  # its donor is absent and it has no turn after its first ones
    assert zlib.crc32(b"11") % 9 >= 1
    assert nodes_of(spark.createDataFrame(alone, schema)) == plain_nodes(alone) == [(11, 0, None, 1, 0, 1, 0, hashlib.sha256(b"11").hexdigest())]
    long = [(5, t, "user", "x" * 50_000 if t == 7 else str(t)) for t in range(2_000)]
    found = nodes_of(spark.createDataFrame(long, schema), most_turns=10, least_turns=1)
    assert len(found) == 2_001 and max(r[1] for r in found) == 2_000 and {r[5] for r in found} == {1}


def test_ids_are_digested_in_runs(spark):
    rows = [(c, "s" if c % 3 else "t") for c in range(-9_000, 9_000, 2)]
    found = {r["conv_id"]: (r["n"], r["ends"]) for r in tries._ends(spark.createDataFrame(rows, "conv_id long, seq string").repartition(7)).collect()}
    for s in "st":
        ids = sorted(c for c, k in rows if k == s)
        assert found[ids[0]] == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())


# 13


def plain_decisions(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    low = float("-inf")
    top = {t: max(ids, key=lambda i: low if i is None else i) for t, ids in groups.items()}
    return sorted((str(i), str(top[t or ""]), len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows), len(groups)


@pytest.mark.parametrize("batches", [1, 3])
def test_exact_decisions(spark, odd_docs, batches):
    rng = random.Random(4)
    more = [(rng.randrange(1, 400), rng.choice(["same", "Same", "same ", None, "", "é", f"own {rng.randrange(80)}"]), "en", None, 1, "c") for _ in range(300)]
    docs = odd_docs.unionByName(spark.createDataFrame(more, odd_docs.schema)).repartition(6)
    found = exact.decisions(docs, batches=batches).collect()
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want, groups = plain_decisions(rows)
    assert sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["text_sha256"]) for r in found) == want
    kept = [r for r in found if r["kept"]]
    assert len(kept) == groups == len({r["text_sha256"] for r in kept}) and all(r["doc_id"] == r["keep_id"] for r in kept)
    left = exact.without_copies(docs, batches=batches)
    assert left.columns == docs.columns
    assert sorted((str(r["doc_id"]), r["text"] or "") for r in left.collect()) == sorted((str(r["doc_id"]), next(t or "" for i, t in rows if hashlib.sha256((t or "").encode()).hexdigest() == r["text_sha256"])) for r in kept)
    assert exact.decisions(docs.limit(0)).count() == 0


def test_index_outlives_its_table_and_takes_new_rows(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    schema = "doc_id long, text string"
    index = exact.DigestIndex.open(spark, path, 3)
    first = exact.decisions(spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], schema), index, "monday")
    assert {(r["doc_id"], r["keep_id"], r["kept"]) for r in first.collect()} == {(1, 2, False), (2, 2, True), (3, 3, True)}
    index.forget()
    index = exact.DigestIndex.open(spark, path, 99)
    assert index.buckets == 3 and index.rows().count() == 2
    rows = spark.createDataFrame([(9, "a"), (8, "c"), (7, "c")], schema)
    for _ in range(2):  # a run that is repeated under its name decides the same
        again = exact.decisions(rows, index, "tuesday")
        assert {(r["doc_id"], r["keep_id"], r["kept"], r["group_size"]) for r in again.collect()} == {(9, 2, False, 1), (8, 8, True, 2), (7, 8, False, 2)}
        assert index.rows().count() == 3
    plan = spark.createDataFrame([("x",)], "k string").select(F.col("k").cast("binary").alias("digest")).join(index.rows().hint("merge"), "digest", "left_anti")._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan
    index.forget()


def test_frequent_groups(spark):
    rows = spark.createDataFrame([("hot", k) for k in range(50)] + [(f"k{k}", k) for k in range(40)], "key string, x int")
    groups = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    found = frequent.with_group(rows, groups, "key", "n", 4)
    assert sorted((r["key"], r["x"], r["n"]) for r in found.collect()) == sorted((r["key"], r["x"], 50 if r["key"] == "hot" else 1) for r in rows.collect())


def test_written_tables_go(spark):
    kept = scratch.cut(spark.range(3).toDF("x"), "gone")
    path = kept.inputFiles()[0].rsplit("/", 1)[0]
    assert scratch.exists(spark, path)
    scratch.discard(kept)
    assert not scratch.exists(spark, path)
