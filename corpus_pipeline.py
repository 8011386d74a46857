"""A corpus pipeline of five of the numbered operators.

Each stage takes (spark, docs, sf_dir), where docs has the columns of the table
``documents`` (further ones are left out), and returns a DataFrame; it is written as Parquet and read again
as the next stage's docs.  The last stage returns the encoded documents.

Cases with a defined result, in all stages
  null text       scored like an empty text by the first stage; without a letter, so
                  the second drops it
  empty text      the same
  very long text  read whole by every stage
  null doc_id     kept or dropped by its text; linked with no other, so near duplicates
                  among such rows all stay; drawn with the key "null"
  repeated rows   judged alike by the first two stages; one of each group of near
                  duplicates stays, of equal doc_ids the least hash of a text
  ties            a score equal to a limit keeps the document
  empty table     an empty result with the stage's columns
  extra columns   left out
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import bpe, mixing, ngram_join, queries
from docloom.llm.crf import UNKNOWN
from docloom.llm.scratch import materialize, read_table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Least share of a document's words that its language has to win.
KEEP_LANGUAGE = 0.34


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality score of KEEP_SCORE or more."""
    docs = docs.select(*COLUMNS)
    scored = queries.quality_scores(docs, read_table(spark, sf_dir, "labels"))
    return scored.filter(F.col("score") >= queries.KEEP_SCORE).select(*COLUMNS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; those without letters or without a leading language go."""
    docs = docs.select(*COLUMNS)
    found = queries.languages(docs)
    return found.filter((F.col("lang_pred") != UNKNOWN) & (F.col("lang_score") >= KEEP_LANGUAGE)).select(*COLUMNS)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest doc_id."""
    return ngram_join.one_of_each(docs.select(*COLUMNS))


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that sources have their target shares, in shuffled order."""
    docs = docs.select(*COLUMNS)
    return mixing.mix_sources(docs).select(*COLUMNS)


def bpe_encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and the decoded text of every document."""
    return queries.digests(bpe.encode_documents(docs.select("doc_id", "text"), queries.tokenizer_file()))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("language_id", language_id),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("mixing", mix_to_weights),
    ("bpe", bpe_encode),
]

#: Models are learned and ids come from a tokenizer's file, which SQL cannot express.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
