"""A corpus in five stages: language ID, near-dedup, benchmark decontamination, personal data, tokens.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read back as the next stage's
docs. All but the last return the columns of documents, over whole texts of all that the stage before kept.

Defined results: verdicts follow rows, whatever their doc_id, so null and repeated ids are rows like any other; null and
empty texts have no known language and go in the first stage; other columns than those of documents are left out, also
where they are named as a column that a stage makes; empty tables pass all stages.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import bpe, decontaminate, language, pii, simhash
from tidelog.llm.common import removed, settled, stored, table
from tidelog.llm.queries import vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def numbered(docs: DataFrame) -> DataFrame:
    """The columns of docs, and row_id, which names each row and is the same in every scan: a Parquet file and the row's place in it."""
    try:
        return docs.select(*COLUMNS, F.concat_ws(":", "_metadata.file_path", F.col("_metadata.row_index").cast("string")).alias("row_id"))
    except AnalysisException:  # not a scan of Parquet
        return numbered(stored(docs.select(*COLUMNS)))


def without(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """numbered docs whose row_id is not in rows. The stored ids have a known size, so Spark broadcasts them only where they are few."""
    return docs.join(stored(rows.select("row_id").distinct()), "row_id", "left_anti").select(*COLUMNS)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows with a text of no known language."""
    rows = numbered(docs)
    return without(rows, language.identify(rows, language.learn(rows), key="row_id").where(~F.col("kept")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked rows one stays: that of the smallest doc_id, null last, then by a hash of the row."""
    rows = numbered(docs)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", F.xxhash64(*COLUMNS), "row_id")
    classes = simhash.cluster(rows.select(order.alias("row"), "text"), key="row")
    return without(rows, classes.where(F.col("row.row_id") != F.col("component_id.row_id")).select("row.row_id"))


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows with a window that nearly equals a benchmark item."""
    rows = numbered(docs)
    return without(rows, decontaminate.matches(rows, table(spark, sf_dir, "benchmark"), key="row_id"))


def remove_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts a mark in the place of each span of personal data; n_chars follows the text."""
    found = pii.find(docs.select(*COLUMNS), keep=["doc_id", "lang", "source", "n_chars"])
    changed = F.size("pii_spans") > 0
    return found.select("doc_id", F.col("redacted").alias("text"), "lang", "source", F.when(changed, F.char_length("redacted").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, token_ids, and whether the decoded tokens encode to the same ids' text."""
    path = vocabulary("word_bpe_49k.json")
    return bpe.encode(docs, path, keep=["doc_id"], decoded=True).select("doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"), "token_ids")


STAGES = [("language ID", identify_language), ("near duplicates", drop_near_duplicates), ("benchmark decontamination", drop_benchmark_leaks), ("personal data", remove_personal_data), ("tokens", encode_tokens)]
#: SimHash components, regressions and merges are not expressible in SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage over what the others leave. What a stage stores on its way goes when it has ended, its result when the next one has."""
    first = docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        kept = settled(spark, lambda: stage(spark, docs, sf_dir))  # noqa: B023
        if docs is not first:
            removed(spark, docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
