"""Whole tables of the earlier corpus operators against plain Python: neighbours, rules, fingerprints, surrogates."""

from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from millrace.llm import ann, pii, simhash
from millrace.llm.queries import QUERIES

from test_llm import classes

SPACE = " \t\n\r\x0b\x0c"


def words_of(text):
    return (text or "").translate(str.maketrans(dict.fromkeys(SPACE, " "))).split(" ")


# 1


def nearest(rows, queries, k=10):
    """By all pairs, in doubles scaled by powers of two."""
    out = {}
    keys, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    for q, v in queries.items():
        d, best = ann.distances(x, np.array(v, float)), {}
        for i, e in zip(keys.tolist(), d.tolist()):
            if i != q:
                best[i] = min(best.get(i, e), e)
        out[q] = sorted((e, i) for i, e in best.items())[:k]
    return out


@pytest.mark.parametrize("change", [lambda v: v, lambda v: v + 1e8, lambda v: v * 1e160, lambda v: v * 1e-170, lambda v: np.ones(64)], ids=["plain", "offset", "huge", "tiny", "equal"])
def test_neighbours_of_any_finite_vector(spark, change):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()
    rows = [(r["vec_id"], change(np.array(r["embedding"], float)).tolist()) for r in table]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = {}
    for r in ann.search_all(df, df.where("vec_id % 20 = 0"), shard_points=128).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
    want = nearest(rows, {k: v for k, v in rows if k % 20 == 0})
    assert set(found) == set(want) and all(len(f) == 10 for f in found.values())
    assert sum(len(set(found[q]) & set(want[q])) for q in want) >= 0.95 * 10 * len(want)


def test_repeated_ids_and_lengths(spark):
    rows = [(100, [1.0, 2.0])] * 12 + [(200, [1.0, 2.0]), (300, [1.0, 2.0]), (7, [1.0, 2.0]), (5, [3.0, 4.0]), (400, [1.0]), (6, [2.0]), (500, [9.0, 9.0]), (500, [0.0, 1.0]), (None, [1.0, 2.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, v string").repartition(4)
    found = {}
    for r in ann.search_all(df, df.where("vec_id % 100 = 0")).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
    two = [r for r in rows if r[0] is not None and len(r[1]) == 2]
    want = nearest(two, {100: [1.0, 2.0], 200: [1.0, 2.0], 300: [1.0, 2.0], 500: [0.0, 1.0]})
    assert found == want | {400: [(1.0, 6)]}


def test_recall_over_a_whole_table(spark):
    table = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    found = {}
    for r in QUERIES["op1_small_world"](spark, "/root/testdata/sf0.1").collect():
        found.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
    want = nearest(table, {k: v for k, v in table if k % 100 == 0})
    assert sum(len(set(found[q]) & set(want[q])) for q in want) >= 0.99 * 10 * len(want)


# 2


def test_names_that_stand_alone_and_formats(spark):
    texts = ["Mrs Anna Smith came. Smith left; Anna too. ANNA SMITH! Smithson stays, Smith's hat.", "Mr Jean-Luc Picard-Roux met Jean-Luc. Picard-Roux slept, Picard not.", "Write Anna.Smith@Example.com or anna.smith@example.com; call +44 20 7946 0958, +380 44 123 4567 or (415) 555-0123."]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r["doc_id"]: r["text"] for r in pii.pseudonymised(df).collect()}
    given, surname = out[0].split()[1:3]
    surname = surname.rstrip(".")
    assert out[0] == texts[0].replace("ANNA SMITH", f"{given.upper()} {surname.upper()}").replace("Anna", given).replace("Smith ", f"{surname} ").replace("Smith left", f"{surname} left").replace("Smith's", f"{surname}'s")
    assert "Smithson" in out[0] and {given, surname}.isdisjoint({"Anna", "Smith"})
    double, last = out[1].split()[1:3]
    assert double.count("-") == last.count("-") == 1 and out[1] == f"Mr {double} {last} met {double}. {last} slept, Picard not."
    mails = [w.strip(";,") for w in out[2].split() if "@" in w]
    assert mails[0].lower() == mails[1] and [c.isupper() for c in mails[0]] == [c.isupper() for c in "Anna.Smith@Example.com"]
    assert "+44 " in out[2] and "+380 " in out[2] and "7946" not in out[2] and "(4" in out[2]


def test_surrogates_of_a_whole_table_differ(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    entities = pii.mentions(docs, "doc_id", "text").where("real and kind <> 'title'").select("kind", "canon").distinct()
    rows = [(r["kind"], r["canon"], r["surrogate"]) for r in pii.surrogates(entities).collect()]
    space = lambda kind: "name" if kind.startswith(("given", "surname")) else kind
    made, real = [(space(k), s) for k, _, s in rows], {(space(k), c) for k, c, _ in rows}
    assert len(rows) > 40 and len(set(made)) == len(made) and not set(made) & real


# 3


def test_counts_of_the_rules_over_a_whole_table(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in QUERIES["op3_repetition_rules"](spark, sf_dir).collect():
        text = texts[r["doc_id"]]
        words = [w for w in words_of(text) if w]
        grams = Counter(zip(words, words[1:], words[2:]))
        repeated = {k + j for k in range(len(words) - 2) if grams[tuple(words[k : k + 3])] > 1 for j in range(3)}
        lines = [line for line in text.split("\n") if line.strip(SPACE)]
        want = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated))
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want, r["doc_id"]
        assert r["base_failed"] == (len(words) < 50 or 100 * len(repeated) > 50 * len(words)) and not (r["base_failed"] and r["kept"])


# 4


def plain_fingerprint(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in words_of(lower) if w]
    grams = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_components_over_a_whole_table(spark, sf_dir):
    prints = {r["doc_id"]: plain_fingerprint(r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    distinct = sorted(set(prints.values()))
    part = classes(distinct, [(a, b) for i, a in enumerate(distinct) for b in distinct[i + 1 :] if (a ^ b).bit_count() <= 2])
    first = {}
    for d in sorted(prints):
        first.setdefault(part[prints[d]], d)
    found = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in QUERIES["op4_simhash_golay"](spark, sf_dir).collect()}
    assert found == {d: (f"{p:016x}", first[part[p]]) for d, p in prints.items()}
    assert len(set(first.values())) < len(prints)


def test_one_row_of_each_group_stays(spark):
    a, b = "one two three four five six seven eight", "completely other words stand here for sure now"
    rows = [(3, a, 1), (5, a, 2), (5, b, 3), (None, a, 4), (3, a, 1), (9, b, 5), (8, "", 6), (9, None, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, place long").repartition(3)
    kept = sorted(map(str, ((r["doc_id"], r["text"], r["place"]) for r in simhash.keep_one(df).collect())))
    assert kept == sorted(map(str, [(3, a, 1), (5, b, 3), (None, a, 4), (8, "", 6)]))
    names = df.withColumns({"kept_id": F.lit(1), "own_tie": F.lit(2), "component": F.lit(3), "fp": F.lit(4)})
    assert simhash.keep_one(names).columns == names.columns and simhash.keep_one(names.limit(0)).count() == 0
