"""Operators of the corpus subpackage against brute force, exact round trips and held-out labels."""

import heapq
import random
from itertools import combinations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import ann, components, labelled, linedup, mixing, pieces, pii, quality, simhash, spm, suffix, tokencount, toxicity
from millrace.llm.queries import ORACLES, QUERIES


def classes(nodes, pairs):
    root = {n: n for n in nodes}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((top(a), top(b)))
        root[b] = a
    return {n: top(n) for n in nodes}


# components


def test_components_against_union_find(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + k, 1001 + k) for k in range(60)]
    found = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    nodes = {x for p in pairs if p[0] != p[1] for x in p}
    assert found == classes(nodes, pairs)
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# 1


def test_small_world_recall_and_ties(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").limit(400)
    copies = table.limit(3).withColumn("vec_id", F.col("vec_id") + 100_000)
    bad = spark.createDataFrame([(7_000_000, None, 1), (7_000_001, [0.0] * 64, 1), (7_000_002, [float("nan")] * 64, 1), (7_000_003, [float("inf")] + [1.0] * 63, 1)], table.schema)
    rows = table.unionByName(copies).unionByName(bad).persist()
    found = ann.search_all(rows, rows.where("vec_id % 40 = 0"), shard_points=128).collect()
    plain = {r["vec_id"]: np.array(r["embedding"], float) for r in table.unionByName(copies).collect()}
    hits = total = 0
    for q in {r["query_id"] for r in found}:
        want = sorted((float(np.sqrt(((v - plain[q]) ** 2).sum())), k) for k, v in plain.items() if k != q)[:10]
        got = [(r["score"], r["vec_id"]) for r in sorted(found, key=lambda r: r["rank"]) if r["query_id"] == q]
        assert got == sorted(got) and [r["rank"] for r in found if r["query_id"] == q] and len(got) == 10
        hits += len({k for _, k in want} & {k for _, k in got})
        total += 10
    assert hits / total >= 0.9
    assert {r["query_id"] for r in found} == {k for k in plain if k % 40 == 0}
    assert ann.search_all(rows.limit(0), rows.limit(0)).count() == 0


# 2


def test_surrogates(spark):
    text = "Mrs Anna Smith wrote to anna.smith@example.com or +44 20 7946 0958; card 4111 1111 1111 1111 at 10.0.0.1."
    again = "ANNA.SMITH@EXAMPLE.COM and 4111-1111-1111-1111, +44-20-7946-0958, Mr Bob Smith."
    docs = spark.createDataFrame([(1, text, "k"), (2, again, None), (3, None, "x"), (4, "", "y"), (None, "nothing here", "z")], "doc_id long, text string, kind string")
    found = {r["doc_id"]: r for r in pii.pseudonymised(docs).collect()}
    a, b = found[1]["text"], found[2]["text"]
    for secret in ("anna.smith@example.com", "Smith", "7946", "4111", "10.0.0.1"):
        assert secret not in a and secret not in b and secret.upper() not in b
    card_a, card_b = a.split("card ")[1].split(" at ")[0], b.split(" and ")[1].split(",")[0]
    assert card_a.replace(" ", "") == card_b.replace("-", "")
    digits = [int(c) for c in card_a.replace(" ", "")][::-1]
    assert sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(digits)) % 10 == 0
    mail = a.split("wrote to ")[1].split(" or ")[0]
    assert b.startswith(mail.upper())
    assert a.split(" wrote")[0].split()[-1] == b.rstrip(".").split()[-1]  # one surname, one surrogate
    assert found[3]["text"] is None and found[4]["text"] == "" and found[None]["text"] == "nothing here"
    assert pii.pseudonymised(docs).columns == ["doc_id", "text", "kind"]


def test_surrogates_of_odd_rows_and_names(spark, odd_docs):
    rows = ["Mrs Anna Smith met Dr Anna Smith.", "card 4111 1111 1111 1111 27.65.93.188 and order 1234567890123456", "Mr Anton Anna saw Mrs Smith Weber"]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").withColumns({"new": F.lit(1), "doc": F.lit(2), "key": F.lit(3), "real": F.lit(4)})
    out = {r["doc_id"]: r for r in pii.pseudonymised(docs, entities="n").where("new = 1 AND doc = 2 AND key = 3 AND real = 4").collect()}
    names = out[0]["text"].rstrip(".").split()
    assert names[1:3] == names[5:7] and names[0] == "Mrs" and names[4] == "Dr"  # one person, one surrogate
    assert out[1]["n"] == 2 and "1234567890123456" in out[1]["text"] and "4111" not in out[1]["text"] and "27.65" not in out[1]["text"]
    real = {"Anna", "Smith", "Anton", "Weber"}
    assert not real & set(" ".join(r["text"] for r in out.values()).replace(".", " ").split())
    assert pii.pseudonymised(odd_docs).columns == odd_docs.columns and pii.pseudonymised(odd_docs).count() == 7
    assert pii.pseudonymised(odd_docs.limit(0)).count() == 0


def test_surrogates_stay_distinct(spark):
    names = [(k, f"Mr X{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10 % 10]}{'uvwxyzabcd'[k // 100]}") for k in range(300)]
    docs = spark.createDataFrame(names, "doc_id long, text string")
    out = [r["text"] for r in pii.pseudonymised(docs).collect()]
    assert len(set(out)) == 300 and not set(out) & {n for _, n in names}


def test_surrogates_where_a_format_has_no_room(spark):
    secrets = ["***", "???", "密码密码"] + [str(k) for k in range(10)]
    rows = [(k, f"password={t}") for k, t in enumerate(secrets)] + [(20, "to _@a.com"), (21, "to -@a.com")]
    out = {r["doc_id"]: r["text"] for r in pii.pseudonymised(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(set(out.values())) == len(rows) and not set(out.values()) & {t for _, t in rows}


def test_more_names_than_one_attempt_has(spark, monkeypatch):
    monkeypatch.setitem(pii._STEMS, "latin", ("Mar",))
    monkeypatch.setitem(pii._ENDINGS["surname"], "latin", ("son",))
    names = spark.range(600).select(F.lit("surname_latin").alias("kind"), F.concat(F.lit("x"), F.col("id").cast("string")).alias("canon"))
    found = pii.surrogates(names).agg(F.count_distinct("surrogate").alias("n"), F.count_distinct("canon").alias("all")).first()
    assert found["n"] == found["all"] == 600  # a stem, two of 16 middles and an ending give 256 at most


# 3


def brute_longest(words):
    n = len(words)
    out = [0] * n
    for i in range(n):
        for j in range(n):
            if i != j:
                k = 0
                while i + k < n and j + k < n and words[i + k] == words[j + k]:
                    k += 1
                out[i] = max(out[i], k)
    return out


def test_suffix_repeats_against_brute_force():
    rng = random.Random(5)
    texts = [[rng.choice("abc") for _ in range(rng.randrange(0, 60))] for _ in range(40)]
    words = np.array([ord(w) for t in texts for w in t])
    text_of = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    assert suffix.longest_repeats(text_of, words).tolist() == [x for t in texts for x in brute_longest(t)]


def test_rules(spark, odd_docs):
    clean = " ".join(f"w{k}" for k in range(200))
    passage = " ".join(f"p{k}" for k in range(60))
    got = suffix.rules([clean, f"{clean} {passage} {passage}", "a b c " * 40, None, "x#$\nx#$\n\ny"])
    assert list(got["kept"]) == [True, False, False, False, False]
    assert list(got["n_words"]) == [200, 320, 120, 0, 3] and list(got["n_dup_lines"])[4] == 1 and list(got["n_symbols"])[4] == 4
    assert list(got["n_repeat_words"]) == [0, 120, 120, 0, 0]
    assert suffix.with_rules(odd_docs).count() == 7 and suffix.clean_documents(odd_docs).columns == odd_docs.columns
    assert suffix.clean_documents(odd_docs.limit(0)).count() == 0


# 4


@pytest.mark.parametrize("crowd", [2, 48])
def test_golay_links_against_brute_force(spark, crowd):
    rng = random.Random(3)
    fps = {rng.getrandbits(64) for _ in range(60)}
    for f in list(fps):
        for _ in range(rng.randrange(4)):
            f ^= sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 4)))
            fps.add(f)
    pairs = [(a, b) for a, b in combinations(sorted(fps), 2) if (a ^ b).bit_count() <= 2]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    links = simhash.links(spark.createDataFrame([(signed(f),) for f in fps], "fp long"), crowd).collect()
    assert all(((r["a"] ^ r["b"]) & (2**64 - 1)).bit_count() <= 2 for r in links)
    assert classes(fps, [(r["a"] % 2**64, r["b"] % 2**64) for r in links]) == classes(fps, pairs)


def test_fingerprints_and_odd_rows(spark, odd_docs):
    import xxhash

    text = "The quick brown FOX jumps over the lazy dog"
    words = text.lower().split()
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]), 42) for i in range(len(words) - 2)]
    assert simhash.fingerprint(text) == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert simhash.fingerprint(None) == simhash.fingerprint(" ") == 0
    found = simhash.near_duplicates(odd_docs).collect()
    assert len(found) == 7 and {r["component_id"] for r in found if r["fp"] == 0} == {3}
    assert simhash.keep_one(odd_docs).count() == 4 and simhash.keep_one(odd_docs.limit(0)).count() == 0


# 5


def test_fuzzy_lines(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(3, 8)))
    rows, groups = [], []
    for g in range(30):
        words = [word() for _ in range(30)]
        for v in range(4):
            own = list(words)
            if v:
                own[rng.randrange(30)] = word()
            groups.append(g)
            rows.append((len(rows), " ".join(own)))
    left = {r["doc_id"]: r["text"] for r in linedup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    own = {d: {t[i : i + 4] for i in range(len(t) - 3)} for d, t in rows}
    assert len(left) == 120
    firsts = [next(d for d, g in enumerate(groups) if g == k) for k in range(30)]
    assert all(left[d] == rows[d][1] for d in firsts)
    assert sum(left[d] == "" for d in range(120) if d not in firsts) >= 85
    assert own  # texts were not empty


def shingles_of(line, width=linedup.SHINGLE):
    return {line[i : i + width] for i in range(len(line) - width + 1)} or {line}


def near_lines(lines, threshold=0.8):
    """All pairs of positions whose whole shingle sets reach the threshold, by an index of shingles."""
    own, holders, near = [shingles_of(t) for t in lines], {}, set()
    for k, s in enumerate(own):
        common = {}
        for g in s:
            for j in holders.setdefault(g, []):
                common[j] = common.get(j, 0) + 1
            holders[g].append(k)
        near |= {(j, k) for j, n in common.items() if n >= threshold * (len(s) + len(own[j]) - n)}
    return near


def check_components(spark, lines, **options):
    frame = spark.createDataFrame([(t,) for t in lines], "line string")
    distinct = linedup.distinct_lines(frame, linedup.ORDER, linedup.SHINGLE, linedup.SEED)
    graph, named = linedup.grouped(distinct, frame, linedup.planes(), linedup.SHINGLE, linedup.THRESHOLD, **options)
    keys = {r["key"]: k for k, r in enumerate(frame.select(F.xxhash64("line").alias("key")).collect())}
    place = {r["id"]: keys[r["key"]] for r in named.collect()}
    near = near_lines(lines)
    top = {place[r["node"]]: place[r["component"]] for r in graph.collect()}
    parts, whole = {k: top.get(k, k) for k in range(len(lines))}, classes(range(len(lines)), near)
    recall = sum(parts[a] == parts[b] for a, b in near) / len(near)
    print("recall of links between components", recall)
    assert len(near) > 100 and recall >= 0.98 and all(whole[k] == whole[p] for k, p in parts.items())


def test_short_lines_against_brute_force_on_all_shingles(spark):
    rng = random.Random(19)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(6, 14)))
    lines = ["short", "shorter", "eightchr", "ninechars", "\U0001f600 beyond the first plane"]
    for g in range(150):
        words = [word() for _ in range(rng.randrange(8, 15))]
        lines.append(" ".join(words))
        at = rng.randrange(len(lines[-1]))
        lines.append(lines[-1][:at] + "#" + lines[-1][at + 1 :])
        lines.append(" ".join(words[1:]))
    lines = list(dict.fromkeys(lines))
    frame = spark.createDataFrame([(t,) for t in lines], "line string")
    sizes = {r["line"]: r["n"] for r in frame.select("line", F.size(linedup.shingle_set(F.col("line"))).alias("n")).collect()}
    assert all(sizes[t] == len(shingles_of(t)) for t in lines)
    check_components(spark, lines)


def test_crowded_buckets_against_brute_force(spark):
    rng = random.Random(23)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    template, lines = " ".join(word(7) for _ in range(12)), []
    for g in range(60):  # alike, but for the most part below the threshold
        tail = " ".join(word(6) for _ in range(4))
        lines += [f"{template} {tail}", f"{template} {tail[:-3]}xyz", f"{template[8:]} {tail}"]
    check_components(spark, list(dict.fromkeys(lines)), crowd=5)


def test_shingle_sets_are_made_once_and_rows_kept_out_of_shuffles(spark, monkeypatch):
    plans, cut = [], linedup.cut
    monkeypatch.setattr(linedup, "cut", lambda df, name: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or cut(df, name))
    rng = random.Random(31)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    lines = []
    for g in range(60):
        line = " ".join(word(6) for _ in range(15))
        lines += [line, line[:40] + "#" + line[41:], line + " \U0001f600"]
    check_components(spark, lines)
    nodes = [node.lstrip(" :+-") for plan in plans for node in plan.split("\n")]
    assert any("lambdafunction" in node for node in nodes)
    assert not [node for node in nodes if "lambdafunction" in node and not node.startswith("Project")]  # neither conditions nor generators make sets
    assert not [node for node in nodes if node.startswith("Join LeftSemi")]  # it would be put before the broadcast bits


def test_signatures_start_from_the_first_shingles_and_lines_are_dealt_once(spark, monkeypatch):
    rng = random.Random(37)
    text = lambda n: "".join(rng.choice("abcdefgh \u00e9\u4e16") for _ in range(n))
    lines = list(dict.fromkeys(text(n) for n in [*range(1, 50), 63, 64, 65, 71, 72, 200])) + ["-" * 300, "\U0001f600" * 9]
    lines = [t for t in lines if t == t.strip()]
    frame = spark.createDataFrame([(t,) for t in lines + lines[:5]], "line string")
    plans, cut = {}, linedup.cut
    monkeypatch.setattr(linedup, "cut", lambda df, name: plans.__setitem__(name, df._jdf.queryExecution().toString()) or cut(df, name))
    found = {r["key"]: r for r in linedup.distinct_lines(frame, linedup.ORDER, linedup.SHINGLE, linedup.SEED).collect()}
    masks = random.Random(linedup.SEED)
    masks = [masks.getrandbits(32) - (1 << 31) for _ in range(linedup.ORDER**2)]
    units = [(t, t.encode("utf-16-be")) for t in lines]
    pieces = [(t, u[i : i + 16]) for t, u in units for i in range(0, max(len(u) - 15, 1), 2)]
    each = spark.createDataFrame(pieces, "line string, piece binary").select("line", F.hash("piece").alias("h"))
    plain = each.groupBy(F.xxhash64("line").alias("key"), "line").agg(*[F.min(F.col("h").bitwiseXOR(F.lit(m))).alias(f"v{k}") for k, m in enumerate(masks)]).collect()
    assert len(plain) == len(found) == len(lines)
    assert all(found[r["key"]][f"v{k}"] == r[f"v{k}"] for r in plain for k in range(len(masks)))
    assert all(found[r["key"]]["n"] == 1 + (r["line"] in lines[:5]) for r in plain)
    assert all(f"least(t{k}#" in plans["line-distinct"] for k in range(len(masks)))  # not the least of each row anew
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(20)]
    check = [" ".join(words[:k] + ["other"] + words[k:]) for k in range(20)]
    frame = spark.createDataFrame([(t,) for t in check], "line string")
    linedup.grouped(linedup.distinct_lines(frame, linedup.ORDER, linedup.SHINGLE, linedup.SEED), frame, linedup.planes(), linedup.SHINGLE, linedup.THRESHOLD)
    assert "array_intersect" in plans["line-common"] and "array_distinct" not in plans["line-common"]
    first = plans["line-texts"].split("== Physical Plan ==")[1]
    assert not [x for x in first.split("\n") if "Exchange hashpartitioning" in x and "line#" in x.split("hashpartitioning")[1].split(")")[0]]  # no shuffle by whole lines


def test_line_dedup_of_documents_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = sorted((r["doc_id"], k, line.lower().strip(linedup.BLANK)) for r in docs.collect() for k, line in enumerate((r["text"] or "").split("\n")))
    rows = [r for r in rows if r[2]]
    lines = list(dict.fromkeys(r[2] for r in rows))
    part = classes(range(len(lines)), near_lines(lines))
    number, seen, want = {t: k for k, t in enumerate(lines)}, set(), set()
    for doc, k, line in rows:
        if part[number[line]] in seen:
            want.add((doc, k))
        seen.add(part[number[line]])
    gone = {(r["doc_id"], r["line_no"]) for r in linedup.repeated_lines(docs).collect()}
    assert len(want) > 50 and len(gone & want) >= 0.99 * len(want) and len(gone - want) <= 0.01 * len(want)
    left = {r["doc_id"]: r["n_lost"] for r in QUERIES["op5_fuzzy_lines"](spark, sf_dir).collect()}
    assert left == {r["doc_id"]: sum(d == r["doc_id"] for d, _ in gone) for r in docs.collect()}


def test_lines_of_odd_rows(spark, odd_docs):
    docs = spark.createDataFrame([(2, "Same line here\nother words stand in this one", 1), (1, "same line here \n\nsomething else entirely is said", 2), (None, "\tsame line here\r", 3)], "doc_id long, text string, component long")
    out = {r["doc_id"]: r["text"] for r in linedup.without_repeats(docs).collect()}
    assert out == {None: "\tsame line here\r", 1: "\nsomething else entirely is said", 2: "other words stand in this one"}
    clash = docs.withColumns({"gone": F.lit("a"), "doc": F.lit("b"), "key": F.lit("c"), "_key": F.lit("d")})
    assert {r["text"] for r in linedup.without_repeats(clash).where("gone = 'a' AND doc = 'b' AND key = 'c' AND _key = 'd'").collect()} == set(out.values())
    assert linedup.without_repeats(odd_docs).columns == odd_docs.columns and linedup.without_repeats(odd_docs).count() == 7
    assert linedup.without_repeats(odd_docs.limit(0)).count() == 0


# 6 and 8


@pytest.mark.parametrize("name,label,threshold", [("op6_toxic_noisy_or", "toxic", 0.5), ("op8_quality_network", "quality", 0.3)])
def test_held_out_labels(spark, name, label, threshold):
    sf = "/root/testdata/sf0.01"
    found = QUERIES[name](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert found["score"].between(0, 1).all() and (found["predicted"] == (found["score"] >= threshold)).all()
    ones, zeros = found[found[label] == 1]["score"], found[found[label] == 0]["score"]
    wins = sum((a > b) + 0.5 * (a == b) for a in ones for b in zeros) / (len(ones) * len(zeros))
    assert wins > 0.85


def test_classifiers_on_odd_rows(spark, odd_docs):
    labels = spark.createDataFrame([(1, 1, 1), (4, 0, 0), (5, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    assert toxicity.score(odd_docs, toxicity.fit(odd_docs, labels)).where("score BETWEEN 0 AND 1").count() == 7
    vectors = quality.word_vectors(odd_docs)
    assert quality.score(odd_docs, vectors, quality.fit(odd_docs, labels, vectors)).where("score BETWEEN 0 AND 1").count() == 7
    assert labelled.sample(odd_docs.limit(0), labels, "toxic").count() == 0
    model = toxicity.fit_noisy_or(["fine words here. you vile thing", "fine words here. nice thing"] * 20, np.array([1, 0] * 20))
    spans = [s for s in model.sentences("fine words here. you vile thing") if s[2] >= 0.5]
    assert [(a, b) for a, b, _ in spans] == [(16, 31)]


# 7 and 9


def test_viterbi_against_the_public_tokenizer():
    from tokenizers import Tokenizer, models, pre_tokenizers

    vocabulary = pieces.Vocabulary.read()
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    low = min(s for _, _, s in vocabulary.pieces)
    listed = {n: (t, s) for t, n, s in vocabulary.pieces}
    vocab = [listed.get(i, (model.id_to_piece(i) if model.is_byte(i) or model.is_unknown(i) else f"\0{i}", low)) for i in range(vocabulary.size)]
    plain = Tokenizer(models.Unigram(vocab, model.unk_id(), True))
    plain.pre_tokenizer = pre_tokenizers.Sequence([])
    encoder, rng = spm.Encoder(vocabulary), random.Random(2)
    for _ in range(300):
        text = "".join(rng.choice("aaab bccde  stion thé\nß漢🙂1 2") for _ in range(rng.randrange(1, 60)))
        ids = encoder.encode(text).tolist()
        assert ids == plain.encode(pieces.SPACE + text.replace(" ", pieces.SPACE)).ids
        assert encoder.decode(np.array(ids)) == text
        assert sum(tokencount.count_pieces(c, vocabulary) for c in vocabulary.chunks(text)) == len(ids)


def test_round_trip_of_odd_rows(spark, odd_docs):
    found = spm.encode(odd_docs, verify=True).collect()
    assert len(found) == 7 and all(r["same"] for r in found)
    assert {r["doc_id"]: r["pieces"] for r in found}[3] is None and {r["doc_id"]: r["pieces"] for r in found}[4] == []
    assert spm.decode(spm.encode(odd_docs)).join(odd_docs, "doc_id").count() == 8
    counts = {r["doc_id"]: r["n_tokens"] for r in tokencount.token_counts(odd_docs).collect()}
    assert counts == {r["doc_id"]: len(r["pieces"] or []) for r in found}


# 10


def test_apportionment_against_a_heap(spark):
    rng = random.Random(4)
    for seats in (0, 1, 7, 100, 1013):
        claims = [(k, float(rng.choice([0, 1, 3, 10, 77.5]))) for k in range(9)]
        heap, won = [(-c, k, 0) for k, c in claims if c], dict.fromkeys(range(9), 0)
        heapq.heapify(heap)
        for _ in range(seats if heap else 0):
            _, k, n = heapq.heappop(heap)
            won[k] += 1
            heapq.heappush(heap, (-claims[k][1] / (2 * n + 3), k, n + 1))
        found = mixing.apportion(spark.createDataFrame(claims, "k long, c double"), [], "c", "k", F.lit(seats), "seats")
        assert {r["k"]: r["seats"] for r in found.collect()} == won


def test_mix_of_odd_rows(spark, odd_docs):
    a, b = (sorted(mixing.mix(d).select("doc_id", "size", "source_size", "target", "taken").collect(), key=str) for d in (odd_docs, odd_docs.repartition(5)))
    assert a == b and len(a) == 7 and all(0 <= r["taken"] <= 3 * r["size"] for r in a)
    assert mixing.mixed_documents(odd_docs).columns == odd_docs.columns
    words = mixing.mixed_documents(odd_docs).agg(F.sum(mixing.word_count(F.col("text")))).first()[0]
    assert words == sum(r["taken"] for r in a)
    assert mixing.mix(odd_docs.limit(0)).count() == 0


@pytest.mark.parametrize("name", ORACLES)
def test_sql(spark, sf_dir, name):
    with duckdb.connect() as con:
        for table in ("documents", "embeddings", "conversations"):
            con.execute(f"create view {table} as select * from '{sf_dir}/{table}.parquet'")
        found = con.execute(ORACLES[name])
        columns, want = [d[0] for d in found.description], found.fetchall()
    assert sorted(map(repr, map(tuple, QUERIES[name](spark, sf_dir).select(*columns).collect()))) == sorted(map(repr, want))


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 120")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, stage(spark, kept, sf_dir).persist()
        assert kept.columns == docs.columns, name
        assert kept.select("doc_id").distinct().join(before, "doc_id", "left_anti").count() == 0
    final = corpus_pipeline.STAGES[-1][1](spark, kept, sf_dir)
    assert final.count() == kept.count()
    rules = {r["doc_id"]: r["kept"] for r in QUERIES["op3_repetition_rules"](spark, sf_dir).collect()}
    assert all(rules[r["doc_id"]] for r in kept.select("doc_id").collect())


def test_mixed_texts_do_not_depend_on_partitions(spark):
    """Rows of one id, null or not, and one size but with different texts keep their order."""
    rows = [(k % 3 or None, " ".join(f"w{k}x{j}" for j in range(40)), "a" if k % 2 else "b") for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = [sorted(mixing.mixed_documents(docs.repartition(n), block_words=50, shard_words=1000).collect(), key=str) for n in (1, 3, 7)]
    assert found[0] == found[1] == found[2] and found[0]
