"""The dealt queries: each maps the given tables to an operator's records and its result back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetvitals.llm import (
    decontaminate, exact_dedup, hard_negatives, language, log_lines, mixing, ngram_join, passages, personal_data, quality,
    report_text, token_alignment, url_rules,
)
from fleetvitals.llm.storage import show_package

SITE_RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)


# Lines of dumps are near copies from this similarity on.
NEAR_LINE_PERCENT = 80


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    show_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_dumps(documents: DataFrame) -> DataFrame:
    """Documents as dumps: a source is a cluster, a language one of its nodes."""
    return documents.select(
        F.col("doc_id").alias("dump_id"), F.col("source").alias("cluster_id"), F.col("lang").alias("node_ip"), F.col("text").alias("content")
    )


def _dumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_dumps(table(spark, sf_dir, "documents"))


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_join.near_duplicates(_dumps(spark, sf_dir), n=4, percent=85)
    return found.withColumnRenamed("dump_id", "doc_id")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = log_lines.remove_duplicate_lines(_dumps(spark, sf_dir), percent=NEAR_LINE_PERCENT)
    return found.select(
        F.col("dump_id").alias("doc_id"), "n_lines", "n_removed", F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256")
    )


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    # The host in the address is the site.
    reports = pages.select(
        F.col("page_id").alias("report_id"), url_rules.host_of(F.col("url")).alias("node_ip"),
        F.col("html").alias("content"), "url",
    )
    found = report_text.extract_text(reports, keep=["url"])
    return found.select(F.col("report_id").alias("page_id"), "url", "text", "n_chars")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = passages.remove_passages(_dumps(spark, sf_dir), window=50)
    return found.select(F.col("dump_id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def good_labels(labels: DataFrame) -> DataFrame:
    """A document is good if it is of quality and not toxic; a missing mark counts as no fault."""
    good = (F.coalesce("quality", F.lit(1)) == 1) & (F.coalesce("toxic", F.lit(0)) == 0)
    return labels.select(F.col("doc_id").alias("dump_id"), good.cast("int").alias("good"))


def quality_model(documents: DataFrame, labels: DataFrame) -> quality.Model:
    return quality.train(as_dumps(documents), good_labels(labels))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = quality_model(documents, table(spark, sf_dir, "labels"))
    found = quality.classify(as_dumps(documents), model)
    return found.select(
        F.col("dump_id").alias("doc_id"), "evidence", "site_posterior", "path_posterior", "posterior", "accepted"
    )


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_rules.filter_urls(pages, SITE_RULES).select("page_id", "host", "path", "rule", "verdict")


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(_dumps(spark, sf_dir), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("dump_id").alias("doc_id"), "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(_dumps(spark, sf_dir)).withColumnRenamed("dump_id", "doc_id")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mix_sources(_dumps(spark, sf_dir), weights=(3, 1, 2), share=1.5, most=2.0)
    return found.select(F.col("dump_id").alias("doc_id"), "size", "source_size", "target", "taken")


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    dumps = _dumps(spark, sf_dir)
    tagger = personal_data.fit(personal_data.labelled_by_patterns(dumps))
    found = personal_data.find_personal_data(dumps, tagger)
    return found.withColumnRenamed("dump_id", "doc_id")


def op11_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_alignment.align_tokens(_dumps(spark, sf_dir))
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    return found.withColumn("groups_sha256", digest).drop("groups").withColumnRenamed("dump_id", "doc_id")


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    dumps = documents.select(F.col("doc_id").alias("dump_id"), F.col("text").alias("content"), F.col("lang").alias("language"))
    held_out = F.crc32(F.coalesce(F.col("dump_id").cast("string"), F.lit(""))) % 3 == 1
    model = language.train(dumps.where(~held_out))
    found = language.identify(dumps.select("dump_id", "content", held_out.alias("held_out")), model)
    return found.select(F.col("dump_id").alias("doc_id"), "held_out", "lang_pred", "score")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "embeddings")
    changed = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = given.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector"), changed.alias("label"))
    return hard_negatives.mine_hard_negatives(vectors, is_anchor=F.col("item_id") % 100 == 0)


QUERIES = {
    f.__name__: f
    for f in (
        op1_ngram_jaccard_join, op2_line_dedup, op3_html_extraction, op4_substring_dedup, op5_quality_classifier,
        op6_url_filters, op7_benchmark_decontamination, op8_exact_dedup, op9_mixing, op10_personal_data,
        op11_cross_tokenizer_alignment, op12_language_id, op13_hard_negatives,
    )
}
