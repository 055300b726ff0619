"""Queries of text operators and batching."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import text as T
from .registry import query, table

_W = r"[\p{L}\p{N}_]+"


@query(rf"SELECT doc_id, len(regexp_extract_all(text, '{_W}')) AS words, len(regexp_extract_all(text, '{_W}|[^\p{{L}}\p{{N}}_\s]')) AS tokens FROM documents")
def word_tokens(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.size(T.tokens(F.col("text"))).cast("long").alias("words"), F.size(T.tokens(F.col("text"), T.PUNCT)).cast("long").alias("tokens"))


def _grams(n: int):
    sql = rf"WITH t AS (SELECT lang, regexp_extract_all(text, '{_W}') AS w FROM documents), g AS (SELECT lang, unnest([array_to_string(w[k:k+{n - 1}], ' ') FOR k IN range(1, len(w) - {n - 2})]) AS gram FROM t) SELECT lang, gram, count(*) AS n FROM g GROUP BY ALL"

    @query(sql, f"ngram_counts_{n}")
    def run(spark, sf):
        return T.ngram_counts(table(spark, sf, "documents"), "text", n, ["lang"])


for _n in (1, 2, 3):
    _grams(_n)


@query(r"SELECT doc_id, len(list_filter([trim(s, ' ') FOR s IN regexp_split_to_array(text, '[.!?\n]+')], lambda s: s <> '')) AS n_sentences FROM documents")
def sentence_split(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.size(T.sentences(F.col("text"))).cast("long").alias("n_sentences"))


@query(r"SELECT doc_id, md5(trim(regexp_replace(regexp_replace(text, '[ \t]+', ' ', 'g'), ' *\n *', chr(10), 'g'), ' ')) AS clean_md5 FROM documents")
def whitespace_normalized(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(T.normalized_space(F.col("text"))).alias("clean_md5"))


_PAIRS = "SELECT item_id, text FROM benchmark"


@query(rf"""WITH c AS (SELECT item_id, unnest(regexp_extract_all(text, '{_W}')) AS g FROM benchmark), r AS (SELECT item_id - 1 AS item_id, unnest(regexp_extract_all(text, '{_W}')) AS g FROM benchmark),
cn AS (SELECT item_id, g, count(*) AS n FROM c GROUP BY ALL), rn AS (SELECT item_id, g, count(*) AS m FROM r GROUP BY ALL)
SELECT item_id, sum(least(n, coalesce(m, 0)))::BIGINT AS matched, sum(n)::BIGINT AS total FROM cn LEFT JOIN rn USING (item_id, g) GROUP BY item_id""")
def clipped_precision(spark, sf):
    b = table(spark, sf, "benchmark").select("item_id", "text")
    return T.clipped_precision(b, b.withColumn("item_id", F.col("item_id") - 1), "item_id", 1)


@query()
def corpus_bleu(spark, sf):
    b = table(spark, sf, "benchmark").select("item_id", "text")
    return T.corpus_bleu(b.withColumn("text", F.concat("text", F.lit(" end"))), b, "item_id")


@query(rf"""WITH w AS (SELECT lower(unnest(regexp_extract_all(text, '{_W}'))) AS word FROM documents), c AS (SELECT word, count(*) AS n FROM w GROUP BY 1), p AS (SELECT n, word[k] AS a, word[k + 1] AS b FROM (SELECT word, n, unnest(range(1, length(word))) AS k FROM c))
SELECT a, b, sum(n)::BIGINT AS n FROM p GROUP BY a, b""")
def bpe_pair_counts(spark, sf):
    words = T.word_table(table(spark, sf, "documents"), "text").withColumn("symbols", F.split("word", ""))
    return T.pair_counts(words)


@query()
def bpe_training(spark, sf):
    """Sixty merges; a round takes all that are sure to follow one another and changes the words that hold them."""
    found = T.bpe_merges(table(spark, sf, "documents"), "text", 60)
    return spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(found)], "rank long, a string, b string")


@query(rf"""WITH w AS (SELECT lower(unnest(regexp_extract_all(text, '{_W}'))) AS word FROM documents), c AS (SELECT word, count(*) AS n FROM w GROUP BY 1), s AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS k FROM c), e AS (SELECT word, n, k, unnest(range(1, least(4, length(word) - k + 1) + 1)) AS z FROM s)
SELECT word[k:k + z - 1] AS piece, sum(n)::BIGINT AS n FROM e GROUP BY 1""")
def unigram_substrings(spark, sf):
    return T.substrings(T.word_table(table(spark, sf, "documents"), "text"), 4)


@query(rf"""WITH w AS (SELECT lower(unnest(regexp_extract_all(text, '{_W}'))) AS word FROM documents), c AS (SELECT word, count(*) AS n FROM w GROUP BY 1), v AS (SELECT word FROM c ORDER BY n DESC, word LIMIT 500)
SELECT count(*) AS words, round(1 - sum((word IN (SELECT word FROM v))::INT) / count(*), 6) AS unknown_share FROM w""")
def unknown_words(spark, sf):
    words = T.word_table(table(spark, sf, "documents"), "text")
    known = words.orderBy(F.desc("n"), "word").limit(500).select("word", F.lit(1).alias("known"))
    joined = words.join(known, "word", "left")
    return joined.agg(F.sum("n").alias("words"), F.round(1 - F.sum(F.when(F.col("known") == 1, F.col("n")).otherwise(0)) / F.sum("n"), 6).alias("unknown_share"))


@query("SELECT event_id, (row_number() OVER (ORDER BY event_id) - 1) // 32 AS batch FROM events")
def batch_assign(spark, sf):
    return T.batches(table(spark, sf, "events"), "event_id", 32).select("event_id", "batch")


@query(rf"""WITH d AS (SELECT doc_id, doc_id // 16 AS batch, [len(w) FOR w IN regexp_extract_all(text, '{_W}')] AS ids FROM documents), m AS (SELECT *, max(len(ids)) OVER (PARTITION BY batch) AS most FROM d)
SELECT doc_id, most AS padded, len(ids) AS length, coalesce(list_sum(ids), 0)::BIGINT AS total, most - len(ids) AS masked FROM m""")
def pad_in_batch(spark, sf):
    """The lengths of the words of every text, padded to the longest text of sixteen."""
    d = table(spark, sf, "documents").select("doc_id", F.floor(F.col("doc_id") / 16).alias("batch"), F.transform(T.tokens(F.col("text")), lambda w: F.length(w).cast("long")).alias("ids"))
    p = T.pad_in_batch(d, "ids")
    add = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    return p.select("doc_id", F.size("ids").cast("long").alias("padded"), F.col("length").cast("long").alias("length"), add("ids").alias("total"), (F.size("mask") - add(F.transform("mask", lambda m: m.cast("long")))).alias("masked"))


@query("SELECT event_id // 64 AS batch, count(*) AS n, list(event_id ORDER BY event_id)[1] AS first, round(sum(value), 4) AS total FROM events GROUP BY 1")
def collate(spark, sf):
    rows = table(spark, sf, "events").groupBy(F.floor(F.col("event_id") / 64).alias("batch")).agg(F.array_sort(F.collect_list(F.struct("event_id", "value"))).alias("rows"))
    return rows.select("batch", F.size("rows").cast("long").alias("n"), F.col("rows")[0]["event_id"].alias("first"), F.round(F.aggregate("rows", F.lit(0.0), lambda a, r: a + r["value"]), 4).alias("total"))
