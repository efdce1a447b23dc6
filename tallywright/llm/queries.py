"""The registered queries of the operators, and their SQL where there is one."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from tallywright.llm.alignment import align_tokenizers
from tallywright.llm import chat_trees
from tallywright.llm.jaccard import similar_sets
from tallywright.llm.link_trust import judge_urls
from tallywright.llm.mixing import mix_sources
from tallywright.llm.multi_index import similar_vectors
from tallywright.llm.packing import pack
from tallywright.llm import quality, secrets
from tallywright.llm.perplexity import judge
from tallywright.llm.resampling import resample
from tallywright.llm.scoring import score_texts
from tallywright.llm.sharding import shard_by_bytes


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_vectors(table(spark, sf_dir, "embeddings"))


def op2_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model learns from the documents labelled good, in a language without any from all."""
    good = table(spark, sf_dir, "labels").filter("quality = 1")
    return judge(table(spark, sf_dir, "documents"), good.withColumnRenamed("doc_id", "id"))


def op3_link_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


def op4_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.digest(quality.with_quality(docs, table(spark, sf_dir, "labels")))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_sets(table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


def op10_word_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))


def op11_chat_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One conversation more is formatted, whose texts hold control strings."""
    chats = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    steering = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", steering), (-7, 1, "assistant", steering)], chats.schema)
    return chat_trees.digest(chat_trees.build_trees(chats.unionByName(more)))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokenizers(table(spark, sf_dir, "documents")).documents


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_near_vectors": op1_near_vectors,
    "op2_perplexity": op2_perplexity,
    "op3_link_trust": op3_link_trust,
    "op4_byte_shards": op4_byte_shards,
    "op5_packing": op5_packing,
    "op6_quality": op6_quality,
    "op7_secrets": op7_secrets,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_mixing": op9_mixing,
    "op10_word_model": op10_word_model,
    "op11_chat_trees": op11_chat_trees,
    "op12_alignment": op12_alignment,
    "op13_resampling": op13_resampling,
}

#: Control strings with as many backslashes after their first character as there are, as a pattern.
_STEERING = "|".join(
    re.escape(c[0]) + r"\\*" + re.escape(c[1:]) for c in sorted(chat_trees.CONTROLS, key=len, reverse=True)
)

SQL: dict[str, str] = {
    "op11_chat_trees": rf"""
        WITH turns AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
            UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
        ), sized AS (
            SELECT *, replace(replace(role, '\', '\\'), chr(10), '\n') AS written,
                   length(text) + len(regexp_extract_all(text, '{_STEERING}')) AS chars FROM turns
        )
        SELECT conv_id, count(*)::BIGINT AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role) FILTER (role = 'assistant'), '')) AS loss_sha256,
               sum(length('<|im_start|>') + length(written) + len(regexp_extract_all(written, '{_STEERING}'))
                   + 1 + chars + length('<|im_end|>') + 1)::BIGINT AS formatted_chars
        FROM sized GROUP BY conv_id
    """,
}
