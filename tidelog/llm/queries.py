"""The queries opN_<name>: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, language, pii, quality_rules, rule_ensemble, simhash, substrings, warc
from .common import table


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocabulary("word_bpe_49k.json")
    coded = bpe.encode(table(spark, sf_dir, "documents"), path, keep=["doc_id"], decoded=True)
    return coded.select("doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.count_tokens(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), limit=512, keep=["doc_id"])


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = simhash.cluster(table(spark, sf_dir, "documents"))
    return classes.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_rules.fit(docs, table(spark, sf_dir, "labels"))
    return quality_rules.apply(docs, model, keep=["doc_id"])


def substring_digests(docs: DataFrame) -> DataFrame:
    every, changed = substrings.removals(docs)
    left = changed.select(F.col("doc_id").alias("d"), F.col("sha").alias("s"), F.sha2("kept", 256).alias("rest"))
    joined = every.join(left, (F.col("doc_id") == F.col("d")) & (F.col("sha") == F.col("s")), "left")
    none = F.sha2(F.lit(""), 256)
    kept = F.when(F.col("n_removed") == 0, F.col("sha")).when(F.col("rest").isNotNull(), F.col("rest")).otherwise(none)
    return joined.select("doc_id", "n_words", "n_removed", kept.alias("kept_sha256"))


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_digests(table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.index(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return language.identify(docs, language.learn(docs))


def language_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of pages by their text, the language that their markup declares, and their address."""
    model = language.learn(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return language.identify(table(spark, sf_dir, "pages"), model, column="html", declared=None, address="url", key="page_id")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"), keep=["doc_id"]).drop("redacted")

    def written(base: bool):
        return F.array_join(F.transform(F.filter("pii_spans", lambda x: x["base"] | F.lit(not base)), lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    def count(kind: str):
        return F.size(F.filter("pii_spans", lambda x: (x["base"] | F.lit(kind in pii.ADDED)) & (x["kind"] == kind))).cast("long").alias(f"n_{kind}")

    n_spans = F.size("pii_spans").cast("long").alias("n_spans")
    return found.select("doc_id", n_spans, *map(count, pii.KINDS), F.sha2(written(True), 256).alias("base_sha256"), written(False).alias("spans"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = rule_ensemble.fit(docs, table(spark, sf_dir, "labels"))
    return rule_ensemble.apply(docs, model, threshold=0.3, keep=["doc_id"]).select("doc_id", rule_ensemble.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


QUERIES = {"op1_bpe": op1_bpe, "op2_simhash": op2_simhash, "op3_quality_rules": op3_quality_rules, "op4_token_counts": op4_token_counts, "op5_substrings": op5_substrings, "op6_warc": op6_warc, "op7_language_id": op7_language_id, "op8_pii": op8_pii, "op9_decontamination": op9_decontamination, "op10_quality_classifier": op10_quality_classifier, "language_pages": language_pages}
ORACLE_SQL: dict[str, str] = {
    "op6_warc": """
        WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages),
        f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d)
        SELECT page_id, n AS payload_bytes, p.d AS payload_digest,
               CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN first <> page_id THEN first END AS refers_to
        FROM p LEFT JOIN f ON p.d = f.d AND n >= 100""",
}
