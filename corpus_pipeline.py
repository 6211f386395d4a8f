"""Documents to packed training sequences: toxicity, quality rules, near copies, benchmark
passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; all but
the last return the columns of documents, other columns included. Verdicts travel under names
that no column of the input has. Stages handle null ids and texts, empty tables and repeated rows
as their operators do: a null or empty text is not toxic and fails the quality rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import decontaminate, jaccard, packing, repetition, toxicity
from skein.llm.common import col, drop_shared, free_name, id_bucket, shared_table, short_lived

#: Near copies share 80 % of their 5-word shingles; the defaults of op8_jaccard_join hold for that query alone.
NEAR_COPIES = jaccard.JoinSettings(n=5, percent=80)

#: SQL cannot express compression lengths; run() is tested against a brute-force version.
ORACLE_SQL = None


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _keep(marked: DataFrame, docs: DataFrame, verdict) -> DataFrame:
    return marked.where(verdict).select(*[col(c) for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression distance rejects go."""
    labels = _read(spark, sf_dir, "labels").where(id_bucket("doc_id", 5) != 0)
    model = toxicity.train(docs, labels)
    prefix = free_name(docs, "toxicity_verdict_")
    marked = toxicity.score_toxicity(docs, model, prefix=prefix)
    return _keep(marked, docs, F.col(f"{prefix}predicted") == 0)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules reject go."""
    prefix = free_name(docs, "quality_verdict_")
    return _keep(repetition.judge_repetition(docs, prefix=prefix), docs, F.col(f"{prefix}kept"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of alike sets of 5-word shingles stays."""
    return jaccard.keep_one(docs, settings=NEAR_COPIES)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark passage go."""
    prefix = free_name(docs, "benchmark_verdict_")
    marked = decontaminate.find_contamination(docs, _read(spark, sf_dir, "benchmark"), prefix=prefix)
    return _keep(marked, docs, ~F.col(f"{prefix}contaminated"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of documents and their places in training sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality rules", drop_low_quality),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("best-fit packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written and read again. What a stage wrote for
    itself goes when its result is there, and so does the result before it."""
    docs, before = _read(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with short_lived():
            docs = shared_table(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"), stays=True)
        if before is not None:
            drop_shared(before)
        before = docs
    return docs
