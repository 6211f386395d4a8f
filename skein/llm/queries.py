"""Registered queries of the operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    REGISTRY[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op4_token_ids(spark, sf_dir):
    from skein.llm.token_ids import read_token_ids, write_token_ids

    docs = table(spark, sf_dir, "documents")
    return read_token_ids(write_token_ids(docs, vocabulary("byte_bpe_50k.json")))


@query
def op6_repetition(spark, sf_dir):
    from skein.llm.repetition import judge_repetition

    return judge_repetition(table(spark, sf_dir, "documents"), keep=["doc_id"])


@query
def op7_token_counts(spark, sf_dir):
    from skein.llm.token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), keep=["doc_id"])


@query
def op9_decontamination(spark, sf_dir):
    from skein.llm.decontaminate import find_contamination

    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.drop("spans", "items")


@query
def op2_url_filter(spark, sf_dir):
    from skein.llm.url_filter import filter_urls

    return filter_urls(table(spark, sf_dir, "pages"), keep=["page_id"])


@query
def op3_packing(spark, sf_dir):
    from skein.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"))


@query
def op5_language(spark, sf_dir):
    from skein.llm.common import id_bucket
    from skein.llm.language import identify, train

    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(id_bucket("doc_id", 3) != 1), "text", "lang", "doc_id")
    held_out = docs.select("doc_id", "text", (id_bucket("doc_id", 3) == 1).alias("held_out"))
    return identify(held_out, model, keep=["doc_id", "held_out"])


@query
def op1_lattice_score(spark, sf_dir):
    from skein.llm.common import id_bucket
    from skein.llm.lattice import score_texts

    docs = table(spark, sf_dir, "documents")
    held_out = id_bucket("doc_id", 10) == 0
    rows = docs.select("doc_id", "text", held_out.alias("held_out"))
    return score_texts(rows, vocabulary("byte_bpe_50k.json"), ~held_out, keep=["doc_id", "held_out"])


@query
def op10_toxicity(spark, sf_dir):
    from skein.llm.common import id_bucket
    from skein.llm.toxicity import score_toxicity, train

    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels")
    model = train(docs, labels.where(id_bucket("doc_id", 5) != 0))
    rows = docs.select("doc_id", "text", (id_bucket("doc_id", 5) == 0).alias("held_out"))
    return score_toxicity(rows, model, keep=["doc_id", "held_out"])


@query
def op8_jaccard_join(spark, sf_dir):
    from skein.llm.jaccard import similar_components

    return similar_components(table(spark, sf_dir, "documents"), keep=["doc_id"]).drop("node")


@query
def op11_phrases(spark, sf_dir):
    from skein.llm.phrases import mine_phrases

    return mine_phrases(table(spark, sf_dir, "documents"))


@query
def op12_secret_scan(spark, sf_dir):
    from skein.llm.secret_scan import scan_secrets

    return scan_secrets(table(spark, sf_dir, "documents"), keep=["doc_id"]).drop("secrets")


@query
def op13_alignment(spark, sf_dir):
    from skein.llm.alignment import align_tokens

    docs = table(spark, sf_dir, "documents")
    return align_tokens(docs, vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"), keep=["doc_id"])
