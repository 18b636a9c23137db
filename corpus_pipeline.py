"""From documents to a training mix, in five stages.

Each stage takes (spark, docs, sf_dir) and returns the documents that it keeps,
with the columns of documents; the last returns what the mix takes of each.
run() writes every stage's result to the shared folder and reads it again, so a
lost executor costs one stage at most.

In every stage: null texts count as empty, an empty table passes through, other
columns of any name go along unchanged. Documents without an id are judged by
their text alone: they are never near copies, and stay as exact copies only
where no copy has an id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetvitals.llm import decontaminate, exact_dedup, mixing, ngram_join, quality
from fleetvitals.llm.queries import good_labels, table
from fleetvitals.llm.storage import discard, show_package, stored


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose posterior of being good (of quality and not toxic) is one half or more."""
    labels = good_labels(table(spark, sf_dir, "labels"))
    model = quality.train(docs, labels.withColumnRenamed("dump_id", "doc_id"), dump_id="doc_id", content="text")
    judged = quality.classify(docs, model, site="source", path="lang", content="text")
    return judged.where("accepted").select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts: that of the largest id; of repeated rows one."""
    show_package(spark)
    kept = (
        exact_dedup.deduplicate(docs, dump_id="doc_id", content="text")
        .where("kept").select(F.col("doc_id").alias("kept_id"), F.col("text_sha256").alias("kept_sha256")).distinct()
    )
    digest = "digest"
    while digest in docs.columns:
        digest += "_"
    marked = docs.withColumn(digest, exact_dedup.sha256(F.col("text")))
    same = marked["doc_id"].eqNullSafe(kept["kept_id"]) & (marked[digest] == kept["kept_sha256"])
    once = marked.join(kept, same, "left_semi").dropDuplicates(["doc_id", digest])
    return once.select(*[F.col(f"`{c}`") for c in docs.columns])


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each group linked by 80 % of common five-word shingles."""
    show_package(spark)
    found = ngram_join.near_duplicates(docs, n=5, percent=80, dump_id="doc_id", content="text")
    gone = found.where("doc_id <> component_id").select(F.col("doc_id")).distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth is known from the benchmark; rows that share an id go together."""
    found = decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark"), dump_id="doc_id", content="text")
    gone = found.where(F.col("contaminated") & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document: doc_id, size, source_size, target, and the words that the mix takes, repeats counted."""
    show_package(spark)
    found = mixing.mix_sources(docs, weights=(3, 1, 2), share=1.5, most=2.0, dump_id="doc_id", source="source", content="text")
    return found.drop("row_hash")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", keep_quality),
    ("exact dedup", drop_exact_copies),
    ("n-gram Jaccard join", keep_one_of_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources to target weights", mix),
]

# The classifier, the components and the draws are not expressible in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before, docs = docs, stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        discard(before)
    return docs
