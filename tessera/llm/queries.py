"""The registered queries of this subpackage, their DuckDB twins, and nothing else."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, html_text, language_id, line_dedup, mixing, quality_classifier, quality_rules, secrets, simhash, url_filter
from .common import table


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, distance, start, end (bytes of the normalised text): every item in every document; odd rows as in
    decontaminate.leaks."""
    docs = table(spark, sf_dir, "documents")
    return decontaminate.leaks(docs, table(spark, sf_dir, "benchmark"), [F.col("doc_id")])


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every document; odd rows as in secrets.scan."""
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.col("secrets")

    def count(kind: str) -> Column:
        return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    base = F.filter(spans, lambda x: x["kind"] != secrets.METHOD)
    return found.select("doc_id", *map(count, secrets.BASE), F.sha2(secrets.joined(base).cast("binary"), 256).alias("base_sha256"), secrets.joined(spans).alias("spans"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint, component_id of every document; odd rows as in simhash.classes."""
    found = simhash.classes(table(spark, sf_dir, "documents").select("doc_id", "text"), words=3, bits=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of every document; odd rows as in line_dedup.dedup_lines."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = line_dedup.dedup_lines(docs, n_lines="n_lines", n_dropped="n_dropped")
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document; odd rows as in language_id.identify."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return language_id.identify(docs).select("doc_id", "language.*")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the counts, base_failed, failed and kept of every document; odd rows as in quality_rules.judge."""
    q = quality_rules.judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return q.select("doc_id", "quality.*")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, expected_grade (0 to 2), tail (probability of grade 2), kept; odd rows as in quality_classifier.rate."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    fitted = quality_classifier.learn(docs, quality_classifier.graded(table(spark, sf_dir, "labels")))
    return quality_classifier.rate(docs, fitted).select("doc_id", "rating.*")


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars of every page; odd rows as in html_text.extract."""
    found = html_text.extract(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("bigint").alias("n_chars"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of documents, copy and mix_key: the mixture with equal shares of every source; odd rows as in mixing.mix."""
    return mixing.mix(table(spark, sf_dir, "documents"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, verdict of every page; odd rows as in url_filter.judge."""
    return url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "url_verdict.*")


QUERIES = {f.__name__: f for f in (op1_decontaminate, op2_secrets, op3_simhash, op4_line_dedup, op5_language, op6_quality_rules, op7_quality_classifier, op8_html_text, op9_mixing, op10_url_filter)}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_secrets": secrets.sql(),
        "op4_line_dedup": line_dedup.sql(),
        "op6_quality_rules": f"select doc_id, {', '.join(quality_rules.COUNTS)}, base_failed, failed, kept from ({quality_rules.sql()})",
        "op9_mixing": mixing.sql(),
        "op10_url_filter": url_filter.sql(),
    }
