"""Queries ``opN_<name>`` of the training-data operators, over whole tables, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import encode

    return encode(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, digests=True)


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(_read(spark, sf_dir, "documents"), size=5, percent=85)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score, train

    docs = _read(spark, sf_dir, "documents")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5))
    model = train(docs, _read(spark, sf_dir, "labels"), fold != 0)
    return score(docs, model).select("doc_id", (fold == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .linededup import drop_repeated_lines

    out = drop_repeated_lines(_read(spark, sf_dir, "documents"), min_chars=40, min_docs=5)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op8_content_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exactdedup import groups

    return groups(_read(spark, sf_dir, "documents"), keep="max")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(_read(spark, sf_dir, "documents"))


def op4_anisotropic(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import nearest

    return nearest(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op9_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import page_records

    return page_records(_read(spark, sf_dir, "pages"))


def op5_chat_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a conversation: written as a raw transcript, roles recovered, digest of its canonical form; cases as in ``chat``."""
    from .chat import format_chats, whole_chats

    return whole_chats(format_chats(_read(spark, sf_dir, "conversations"), F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(5)) != 0))


def op7_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm import score

    return score(_read(spark, sf_dir, "documents"), F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) == 2)


def op11_secret_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base spans and learnt ones of every whole text; cases as in ``grammar``."""
    from .grammar import digests, learn, scan

    docs = _read(spark, sf_dir, "documents")
    return digests(scan(docs, F.col("text"), F.col("doc_id"), learn(docs, F.col("text"))))


def op12_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every whole text, some tails repeated by the contract's rule; cases as in ``repetitions``."""
    from .repetitions import digests, find_runs, repeat_tail

    return digests(find_runs(_read(spark, sf_dir, "documents"), F.col("text"), F.col("doc_id"), edit=repeat_tail))


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, damaged by the contract's rule and repaired by the cheapest edits; cases as in ``repair``."""
    from .repair import damage, repair

    out = repair(damage(_read(spark, sf_dir, "conversations")), F.col("present"))
    return out.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.sha2("repaired", 256).alias("repaired_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


from . import exactdedup, linededup, mixing, repair, repetitions, warc  # noqa: E402

QUERIES = {"op1_byte_bpe": op1_byte_bpe, "op2_toxicity": op2_toxicity, "op3_minhash": op3_minhash, "op4_anisotropic": op4_anisotropic, "op5_chat_hmm": op5_chat_hmm, "op6_line_dedup": op6_line_dedup, "op7_pitman_yor": op7_pitman_yor, "op8_content_sort": op8_content_sort, "op9_warc_zip": op9_warc_zip, "op10_mixing": op10_mixing, "op11_secret_grammar": op11_secret_grammar, "op12_word_runs": op12_word_runs, "op13_turn_repair": op13_turn_repair, "pipeline": pipeline}
ORACLES: dict[str, str] = {"op6_line_dedup": linededup.ORACLE, "op8_content_sort": exactdedup.ORACLE, "op9_warc_zip": warc.ORACLE, "op10_mixing": mixing.ORACLE, "op12_word_runs": repetitions.ORACLE, "op13_turn_repair": repair.ORACLE}
