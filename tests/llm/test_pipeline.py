"""run() of the pipeline on a small whole table against a plain chain of its five stages."""

import random
from collections import Counter, defaultdict

import duckdb
import xxhash
from pyspark.sql import functions as F

from millrace.llm import linedup, suffix
from millrace.llm.oracles import MIX

from test_llm import classes, near_lines

WORDS = [f"{a}{b}{c}" for a in ("ba", "de", "fi", "go", "lu", "mar", "nes", "tol") for b in ("ran", "lep", "mit", "son", "vur") for c in ("a", "el", "ik", "or", "us", "yn")]


def text_of(rng, lines=9, words=9):
    return "\n".join(" ".join(rng.choice(WORDS) for _ in range(words)) for _ in range(lines))


def planted(rng):
    rows = [(k, text_of(rng), "en" if k % 3 else None, ["wide", "narrow", None, "third"][k % 4]) for k in range(40)]
    clean = {k for k, *_ in rows}
    add = lambda k, text: rows.append((k, text, "en", "wide"))
    words = rows[3][1].split()
    add(100, rows[5][1])  # an exact copy: all its lines are repeats
    add(101, rows[6][1].replace("\n", "\n\n").replace("a", "a", 1))
    add(102, "\n".join(" ".join(words[i : i + 13]) for i in range(0, len(words), 13)))  # the words of 3 in other lines
    add(103, "\n".join(" ".join(words[i : i + 17]) for i in range(0, len(words), 17)))
    add(7, text_of(rng))  # an id that names two texts
    near = rows[8][1].split("\n")[0]
    add(104, text_of(rng) + "\n" + near[:-1] + "#")  # a line near one of 8
    passage = " ".join(rng.choice(WORDS) for _ in range(60))
    add(105, passage + "\n" + text_of(rng, 4) + "\n" + passage)  # repeats itself
    add(106, "too short to stay")
    add(107, "")
    add(108, None)
    rows.append((None, text_of(rng), "en", "narrow"))  # no id
    return rows, clean


def fingerprint(text):
    words = text.encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def keeps(text):
    """The rules by all pairs of places."""
    words = (text or "").split()
    n = len(words)
    longest = [0] * n
    for i in range(n):
        for j in range(i + 1, n):
            k = 0
            while j + k < n and words[i + k] == words[j + k]:
                k += 1
            longest[i], longest[j] = max(longest[i], k), max(longest[j], k)
    windows, covered = set(), set()
    for i, k in enumerate(longest):
        windows |= set(range(i, i + 3)) if k >= 3 else set()
        covered |= set(range(i, i + k)) if k >= suffix.SPAN_WORDS else set()
    failed = n < suffix.MIN_WORDS or 100 * len(windows) > suffix.MAX_WINDOW_PERCENT * n
    return not failed and len(covered) <= suffix.MAX_COVERED * n and max(longest) <= suffix.MAX_LONGEST


def without_repeated_lines(rows):
    """The first line of each group of similar ones stays, by id (null first) and place."""
    each = sorted(((k is not None, k or 0), i, j, line.lower().strip(linedup.BLANK)) for i, (k, text, *_) in enumerate(rows) for j, line in enumerate(text.split("\n")))
    each = [e for e in each if e[3]]
    lines = list(dict.fromkeys(e[3] for e in each))
    number, part, seen, gone = {t: k for k, t in enumerate(lines)}, classes(range(len(lines)), near_lines(lines)), set(), defaultdict(set)
    for _, i, j, line in each:
        group = part[number[line]]
        if group in seen:
            gone[i].add(j)
        seen.add(group)
    out = [(k, "\n".join(x for j, x in enumerate(text.split("\n")) if j not in gone[i]), lang, source) for i, (k, text, lang, source) in enumerate(rows)]
    return [r for r in out if r[1].split()]


def one_of_each(rows, ties):
    named = [r for r in rows if r[0] is not None]
    prints = sorted({fingerprint(r[1]) for r in named})
    part = classes(prints, [(a, b) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= 2])
    best = {}
    for r in named:
        group = part[fingerprint(r[1])]
        best[group] = min(best.get(group, r), r, key=lambda x: (x[0], ties[x[1]]))
    return list(best.values()) + [r for r in rows if r[0] is None]


def test_run_against_a_plain_chain(spark, tmp_path):
    import corpus_pipeline

    rows, clean = planted(random.Random(12))
    docs = spark.createDataFrame([(k, t, lang, s, None if t is None else len(t)) for k, t, lang, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    left = without_repeated_lines([r for r in rows if keeps(r[1])])
    ties = {r["text"]: r["h"] for r in spark.createDataFrame([(r[1],) for r in left], "text string").select("text", F.xxhash64("text").alias("h")).collect()}
    left = one_of_each(left, ties)
    ids = {r[0] for r in left}
    assert clean <= ids and not ids & {100, 101, 103, 105, 106, 107, 108} and len(ids & {3, 102}) == 1 and None in ids and 104 in ids
    assert sum(r[0] == 7 for r in left) == 1 or len({fingerprint(r[1]) for r in left if r[0] == 7}) == 2

    with duckdb.connect() as con:
        con.execute("create table documents (doc_id bigint, text varchar, source varchar)")
        con.executemany("insert into documents values (?, ?, ?)", [(r[0], r[1], r[3]) for r in left])
        taken = Counter()
        for k, _, _, _, n in con.execute(MIX).fetchall():
            taken[k] += n

    stages = dict(corpus_pipeline.STAGES)
    kept = docs
    for name in list(stages)[:3]:
        kept = stages[name](spark, kept, str(tmp_path)).persist()
    assert sorted(map(str, ((r["doc_id"], r["text"], r["lang"], r["source"]) for r in kept.collect()))) == sorted(map(str, left))
    assert all(r["n_chars"] == len(r["text"]) for r in kept.collect())

    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert found and all(r["round_trip"] and r["n_pieces"] == len(r["pieces"]) for r in found)
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file="/opt/tokenizers/piece_bpe_32k.model")
    words, texts = Counter(), defaultdict(list)
    for r in found:
        text = model.decode(list(r["pieces"]))
        words[r["doc_id"]] += len(text.split())
        texts[r["doc_id"]].append(text)
    assert {k: n for k, n in words.items() if n} == {k: n for k, n in taken.items() if n}
    whole = defaultdict(list)
    for r in left:
        whole[r[0]].append(r[1].split())
    for k, parts in texts.items():  # every text is a run of its document's words, which may begin again
        for part in parts:
            assert any(" ".join(part.split()) in " ".join(w + w) for w in whole[k])


def test_stages_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
