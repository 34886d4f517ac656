"""The queries of this subpackage and, where SQL can say the same, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowsmith.llm import align, chat, decontam, licenses, lines, lm, minhash, negatives, pieces, quality, secret_scan, tokens, vectors


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probabilities of all documents under a Kneser-Ney model of those that are not held out, beside a base score."""
    return lm.score_held_out(table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of each line of all documents, near lines included, and which occurrence stays."""
    return lines.line_groups(table(spark, sf_dir, "documents")).drop("row_key")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each line of all documents, from one encoding of each document."""
    import public_tokenizers

    return tokens.attribute(table(spark, sf_dir, "documents"), ["text"], tokenizer("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of near copies of each document, and which one stays."""
    return minhash.groups(table(spark, sf_dir, "documents"))


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and groups of all vectors of equal label with a cosine of 0.98 or more."""
    return vectors.groups(table(spark, sf_dir, "embeddings"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade and chance of the top grade of all documents, by a model fitted on a bounded sample of labelled ones."""
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(quality.labelled_sample(docs, table(spark, sf_dir, "labels"))))


def op7_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences named in all documents, and places of three base phrases."""
    return licenses.summaries(table(spark, sf_dir, "documents"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded text of all documents."""
    return pieces.encode_digests(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all conversations, and one of control strings, read back from formatted chats."""
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(1).select(F.lit(-1).alias("conv_id"), F.to_json(F.struct(F.lit(said).alias("prompt"), F.lit(said).alias("response"))).alias("payload"))
    turns = chat.canonical_turns(table(spark, sf_dir, "conversations")).union(chat.canonical_json(extra))
    return chat.digests(chat.format_chats(turns))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents that lie in windows of benchmark items."""
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of the vectors with an id divisible by 100, labels shifted where the id is divisible by 7."""
    vectors = table(spark, sf_dir, "embeddings")
    vectors = vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return negatives.mine(vectors, F.col("vec_id") % 100 == 0)


def op12_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of tokens between common ends of a byte-level and a SentencePiece tokenizer, over all documents."""
    return align.align(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model"))


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in all documents, by the rules and by a network trained on what these find."""
    return secret_scan.digests(secret_scan.scan(table(spark, sf_dir, "documents")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_lm_scoring": op1_lm_scoring,
        "op2_line_dedup": op2_line_dedup,
        "op3_token_counts": op3_token_counts,
        "op4_minhash_near_dedup": op4_minhash_near_dedup,
        "op5_embedding_near_dedup": op5_embedding_near_dedup,
        "op6_quality_classifier": op6_quality_classifier,
        "op7_license_scans": op7_license_scans,
        "op8_sentencepiece": op8_sentencepiece,
        "op9_chat_formatting": op9_chat_formatting,
        "op10_decontamination": op10_decontamination,
        "op11_hard_negatives": op11_hard_negatives,
        "op12_cross_tokenizer_alignment": op12_cross_tokenizer_alignment,
        "op13_secret_scan": op13_secret_scan,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_embedding_near_dedup": vectors.SQL, "op9_chat_formatting": chat.SQL, "op10_decontamination": decontam.SQL, "op11_hard_negatives": negatives.SQL}
