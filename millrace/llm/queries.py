"""The registered queries of this subpackage: each applies its operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, exact, labelled, linedup, mixing, oracles, pii, quality, simhash, spm, suffix, tokencount, toxicity, tries, yinyang


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_small_world(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of ``embeddings`` to each row whose vec_id is divisible by 100."""
    table = _table(spark, sf_dir, "embeddings")
    return ann.search_all(table, table.where("vec_id % 100 = 0"))


def op2_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` with surrogates for personal data."""
    found = pii.pseudonymised(_table(spark, sf_dir, "documents").select("doc_id", "text"), entities="n_entities")
    return found.select("doc_id", "n_entities", "text")


def op3_repetition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The repetition rules over every whole text of ``documents``."""
    return suffix.with_rules(_table(spark, sf_dir, "documents"), keep=F.col("doc_id")).select(F.col("row").alias("doc_id"), "rules.*")


def op4_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every row of ``documents``."""
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_digits("fp").alias("fingerprint"), "component_id")


def op5_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` without repeated lines: lines that went, lines left and a digest of the text left."""
    left = linedup.without_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"), lost="n_lost")
    lines = F.coalesce(F.size(F.split("text", "\n", -1)), F.lit(0)).cast("long")
    return left.select("doc_id", "n_lost", F.when(F.col("text").isNull(), 0).otherwise(lines).alias("n_left"), F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"))


def op6_toxic_noisy_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole text of ``documents``, and how many of its sentences offend."""
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    found = toxicity.score(docs, model)
    return found.select("doc_id", labelled.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("offending").cast("long").alias("n_offending"))


def op7_viterbi_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole text of ``documents``."""
    return tokencount.token_counts(_table(spark, sf_dir, "documents"))


def op8_quality_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every whole text of ``documents``."""
    docs = _table(spark, sf_dir, "documents")
    vectors = quality.word_vectors(docs)
    net = quality.fit(docs, _table(spark, sf_dir, "labels"), vectors)
    found = quality.score(docs, vectors, net)
    return found.select("doc_id", labelled.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents`` encoded and decoded again: how many pieces, a digest of their ids, and whether the text came back."""
    found = spm.encode(_table(spark, sf_dir, "documents"), verify=True)
    digest = F.xxhash64("pieces").alias("pieces_xxh64")
    return found.select("doc_id", F.coalesce(F.size("pieces"), F.lit(0)).cast("long").alias("n_pieces"), F.size(F.array_distinct("pieces")).cast("long").alias("n_distinct_pieces"), digest, F.col("same").alias("round_trip"))


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents`` mixed; a digest of :func:`mixing.mix`."""
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op11_yinyang_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all vectors of ``embeddings``, with their errors and a digest of the codebooks."""
    return yinyang.compress(_table(spark, sf_dir, "embeddings"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of the prefix trie of ``conversations``, each rebuilt with the beginning of another one."""
    turns = tries.ordered_turns(_table(spark, sf_dir, "conversations"))
    return tries.trie(tries.sequences(tries.spliced(turns)))


def op13_exact_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which rows of ``documents`` stay when copies go, by a digest index that the table is admitted to in two batches."""
    return exact.decisions(_table(spark, sf_dir, "documents")).drop("mark")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_small_world": op1_small_world,
    "op2_surrogates": op2_surrogates,
    "op3_repetition_rules": op3_repetition_rules,
    "op4_simhash_golay": op4_simhash_golay,
    "op5_fuzzy_lines": op5_fuzzy_lines,
    "op6_toxic_noisy_or": op6_toxic_noisy_or,
    "op7_viterbi_counts": op7_viterbi_counts,
    "op8_quality_network": op8_quality_network,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_mix_sources": op10_mix_sources,
    "op11_yinyang_codes": op11_yinyang_codes,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_exact_index": op13_exact_index,
}

ORACLES: dict[str, str] = {
    "op10_mix_sources": oracles.MIX,
    "op11_yinyang_codes": oracles.codes(),
    "op12_prefix_trie": oracles.TRIE,
    "op13_exact_index": oracles.EXACT,
}
