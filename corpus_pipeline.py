"""Corpus pipeline: toxicity, exact dedup, near dedup, mixing, byte-level BPE.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written as Parquet and read back as the next
stage's ``docs``. All but the last return the columns of ``documents``; the last returns ids and digests of the tokens.
Columns other than those of ``documents`` pass through, whatever their names. Rows with null or empty texts are texts like any
other to the filters, equal to each other in exact dedup; the mix takes nothing from texts without a word. Null identifiers
are kept and order last; rows that repeat an identifier are near-dedup's one node and share the mix's mean count. Empty
tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import common as C
from factloom.llm.bpe import encode
from factloom.llm.exactdedup import drop_duplicates
from factloom.llm.minhash import near_duplicates
from factloom.llm.mixing import apply_mix
from factloom.llm.toxicity import keep_clean, train


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents scored 0.5 or more by their nearest labelled examples (all labelled rows may be learnt from). Without usable
    labels every score is 0 and all rows stay."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return keep_clean(docs, train(docs, labels, F.lit(True)))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased) the smallest doc_id stays, a null one only if there is no other; of repeated rows one."""
    return drop_duplicates(docs, keep="min")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, similarity 0.8 or more: the smallest doc_id of each component stays. Texts without words and rows
    with a null id are linked with nothing and stay."""
    groups = C.table(near_duplicates(docs, size=5, percent=80).where("not kept").select("doc_id").distinct(), "pipeline-near")
    return docs.join(groups, "doc_id", "left_anti").select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at weights 5, 2, 1 in turn, at most three passes: rows as often as the mix takes them, in whole documents; texts
    without a word go."""
    return apply_mix(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of every row that is left: ``doc_id, n_tokens, ids_sha256, decoded_sha256``."""
    import public_tokenizers

    return encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, digests=True)


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("byte_bpe", byte_bpe)]

#: Nearest neighbours, components and tokens are not SQL; tests/llm compare the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; each stage's scratch tables go when its result is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept: str | None = None
    for name, stage in STAGES[:-1]:
        before = C.made()
        out = stage(spark, docs, sf_dir)
        path = C.scratch_path(spark, f"stage-{name}")
        out.write.option("compression", "zstd").parquet(path)
        C._MADE.pop()
        C.release(before)
        docs = spark.read.schema(out.schema).parquet(path)
        if kept:
            C.drop_path(spark, kept)
        kept = path
    return STAGES[-1][1](spark, docs, sf_dir)
