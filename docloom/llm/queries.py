"""Queries of the numbered operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, crf, elkan, mixing, ngram_join, passages, rules, secret_scan, sharding, sitestyle, spotsigs, tokenfiles, turns
from .scratch import materialize, read_table, scratch_path
from .sql import OP11_SQL, OP12_SQL, OP13_SQL

#: A public tokenizer's file, by its name in the folder of vocabularies.
VOCABULARY = "word_bpe_49k.json"


def tokenizer_file(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


Query = Callable[[SparkSession, str], DataFrame]


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = rules.apply_rules(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), lambda df: materialize(df, "statistics"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


#: A document is kept if its quality score is at least this.
KEEP_SCORE = 0.3


def fold(modulus: int) -> Column:
    """crc32 of the doc_id as text, modulo ``modulus``."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents with ``score``, learned from labels outside fold 0 of 5."""
    return passages.score(docs, passages.learn(docs, labels, fold(5) != 0))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality_scores(read_table(spark, sf_dir, "documents").select("doc_id", "text"), read_table(spark, sf_dir, "labels"))
    return scored.select("doc_id", F.coalesce(fold(5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= KEEP_SCORE).cast("int").alias("predicted"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "token-files")
    manifest = tokenfiles.write_token_files(read_table(spark, sf_dir, "documents"), folder, tokenizer_file())
    return tokenfiles.read_token_files(manifest, folder)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return digests(bpe.encode_documents(docs, tokenizer_file()))


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded text."""
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op4_site_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sitestyle.extract_main_text(read_table(spark, sf_dir, "pages"))


def languages(docs: DataFrame) -> DataFrame:
    """The documents with ``lang_pred`` and ``lang_score``, learned outside fold 2 of 4."""
    return crf.predict(docs, crf.learn(docs, fold(4) != 2))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = crf.learn(docs, fold(4) != 2)
    found = crf.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", F.coalesce(fold(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op6_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.fingerprints(read_table(spark, sf_dir, "documents"))


def spotsigs_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents with like fingerprints, by pruned Jaccard over partitions of set length."""
    return spotsigs.near_components(read_table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(read_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "text", F.col("copy").cast("long").alias("copy"), "order_key")


OP7_SQL = """
WITH RECURSIVE sizes AS (
  SELECT source, CAST(sum(coalesce(strlen(text), 0) + 16) AS DOUBLE) AS size FROM documents GROUP BY source),
totals AS (SELECT sum(pow(size, 0.5)) AS w, sum(size) AS n FROM sizes),
rates AS (SELECT source, pow(size, 0.5) / w * n / size AS rate FROM sizes, totals),
parts AS (SELECT source, rate, greatest(1, CAST(ceil(rate / 16) AS INT)) AS parts FROM rates),
cdf AS (
  SELECT source, parts, rate / parts AS r, 0 AS k, exp(-(rate / parts)) AS p, exp(-(rate / parts)) AS total FROM parts
  UNION ALL
  SELECT source, parts, r, k + 1, p * r / (k + 1), total + p * r / (k + 1) FROM cdf WHERE k < r + 12 * sqrt(r) + 24),
draws AS (
  SELECT d.doc_id, d.source, d.text, t.part,
         CAST(CAST('0x' || substr(md5('7:' || coalesce(CAST(d.doc_id AS VARCHAR), 'null') || ':' || t.part), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS u
  FROM documents d JOIN (SELECT source, unnest(range(1, parts + 1)) AS part FROM parts) t ON d.source IS NOT DISTINCT FROM t.source),
tables AS (SELECT source, list(total ORDER BY k) AS totals FROM cdf GROUP BY source),
counts AS (
  SELECT d.doc_id, d.source, d.text, sum(len(list_filter(c.totals, lambda x: x <= d.u))) AS n
  FROM draws d JOIN tables c ON d.source IS NOT DISTINCT FROM c.source GROUP BY ALL),
copies AS (SELECT doc_id, source, text, unnest(range(0, CAST(n AS BIGINT))) AS copy FROM counts)
SELECT doc_id, source, text, CAST(copy AS BIGINT) AS copy, md5('order7:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || copy) AS order_key
FROM copies
"""


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(read_table(spark, sf_dir, "documents"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(read_table(spark, sf_dir, "documents"))


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.reports(turns.repair(turns.damage(read_table(spark, sf_dir, "conversations"))))


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans, base = F.col("spans"), secret_scan.of_kinds(F.col("spans"), [r.kind for r in secret_scan.BASE])
    counts = [F.size(secret_scan.of_kinds(spans, [r.kind])).cast("long").alias(f"n_{r.kind}") for r in secret_scan.BASE]
    return found.select("doc_id", *counts, F.sha2(secret_scan.spelled(base).cast("binary"), 256).alias("base_sha256"), secret_scan.spelled(spans).alias("spans"))


def op13_elkan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return elkan.report(*elkan.cluster(read_table(spark, sf_dir, "embeddings")))


QUERIES: dict[str, Query] = {"op1_quality_rules": op1_quality_rules, "op2_quality_classifier": op2_quality_classifier, "op3_token_files": op3_token_files, "op4_site_style_tree": op4_site_style_tree, "op5_language_id": op5_language_id, "op6_spotsigs": op6_spotsigs, "op7_mixing": op7_mixing, "op8_sharding": op8_sharding, "op9_ngram_join": op9_ngram_join, "op10_bpe": op10_bpe, "op11_turn_repair": op11_turn_repair, "op12_secret_scan": op12_secret_scan, "op13_elkan": op13_elkan, "spotsigs_near": spotsigs_near}
ORACLES: dict[str, str] = {"op7_mixing": OP7_SQL, "op11_turn_repair": OP11_SQL, "op12_secret_scan": OP12_SQL, "op13_elkan": OP13_SQL}
