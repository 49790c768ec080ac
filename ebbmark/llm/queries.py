"""The queries of this subpackage, by name, each over its whole table; ORACLES has SQL where SQL can express one."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, exactdup, html_extract, media, mixing, neardup, tokenfiles, toxicity, warc
from .shared import shared_dir, text_of

RANKS, VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = html_extract.extract(table(spark, sf_dir, "pages"), column="text")
    return texts.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), RANKS)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The digest is taken of the texts as they come out of the shuffle.
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", F.round("rate", 9).alias("rate"), F.col("copies").cast("long").alias("copies"), F.col("copy").cast("long").alias("copy"), "place", F.sha2(text_of("text").cast("binary"), 256).alias("text_sha256"))


def held_out(key: str = "doc_id"):
    return F.pmod(F.crc32(F.col(key).cast("string")), F.lit(5)) == 0


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    lexicon = toxicity.learn(docs, labels.filter(~held_out()))
    scored = toxicity.score(docs.select("doc_id", "text"), lexicon, column="score")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    formatted = chat.format_chats(rows.unionByName(extra).withColumn("parts", chat.text_part(text_of("text"))))
    said = F.array_join("spoken", "")
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["content"], F.lit("\n")))
    return chat.read_chats(formatted).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length(said).cast("long").alias("loss_chars"), F.sha2(said, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark)
    warc.write_archive(table(spark, sf_dir, "pages"), folder)
    return warc.read_archive(spark, folder)


def op8_exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdup.exact_groups(table(spark, sf_dir, "documents"))


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.store_and_read(table(spark, sf_dir, "documents"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark)
    tokenfiles.write_token_files(table(spark, sf_dir, "documents"), folder, VOCABULARY)
    return tokenfiles.read_token_files(spark, folder)


QUERIES = {f.__name__: f for f in (op1_html_extraction, op2_byte_bpe, op3_mixing, op4_toxicity, op5_chat, op6_near_duplicates, op7_warc, op8_exact_duplicates, op9_media, op10_token_files)}

ORACLES = {
    "op3_mixing": f"""
        WITH sizes AS (SELECT source, sum(length(coalesce(text, ''))) AS size FROM documents GROUP BY source),
        weighed AS (SELECT source, size, CASE WHEN size > 0 THEN pow(size, {mixing.POWER}) ELSE 0 END AS weight FROM sizes),
        rates AS (SELECT source, CASE WHEN size > 0 THEN (SELECT sum(size) FROM sizes) * weight / (SELECT sum(weight) FROM weighed) / size ELSE 0 END AS rate FROM weighed),
        parts AS (SELECT source, rate, greatest(1, ceil(rate / {mixing.MOST_RATE}))::INT AS draws FROM rates),
        steps AS (
            SELECT source, k, floor(sum(exp(k * ln(rate / draws) - rate / draws - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) * {2**mixing.BITS}.0)::BIGINT AS step
            FROM parts, range(0, 1000) r(k) WHERE rate > 0 AND k <= (rate / draws + 12 * sqrt(rate / draws) + 30)::INT
        ),
        numbered AS (
            SELECT doc_id, d.source, sha256(coalesce(text, '')) AS text_sha256, ('0x' || substr(md5('{mixing.SEED}|count' || CASE WHEN j = 0 THEN '' ELSE j::VARCHAR END || '|' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT AS u
            FROM documents d JOIN parts p ON d.source IS NOT DISTINCT FROM p.source, range(0, draws) x(j)
        ),
        drawn AS (SELECT doc_id, n.source, text_sha256, count(*) AS copies FROM numbered n JOIN steps s ON n.source IS NOT DISTINCT FROM s.source AND s.step <= n.u GROUP BY doc_id, n.source, text_sha256)
        SELECT doc_id, d.source, round(rate, 9) AS rate, copies, c::BIGINT AS copy, text_sha256,
            ('0x' || substr(md5('{mixing.SEED}|place|' || doc_id::VARCHAR || '|' || c::VARCHAR), 1, 13))::BIGINT AS place
        FROM drawn d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source, range(0, copies) x(c)
    """,
    "op5_chat": r"""
        WITH rows AS (
            SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
            UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
        ), whole AS (
            SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn) AS turns,
                coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '') AS said,
                sum(length('<|turn|><|says|><|end|>') + length(replace(role, '<', '<\')) + length(replace(text, '<', '<\'))) AS formatted
            FROM rows GROUP BY conv_id
        )
        SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(said) AS loss_chars, sha256(said) AS loss_sha256, formatted::BIGINT AS formatted_chars FROM whole
    """,
    "op7_warc": f"""
        WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, coalesce(html, '') AS html FROM pages),
        m AS (SELECT page_id, n, sha1(html) AS d, max(page_id) OVER (PARTITION BY html) AS last FROM p)
        SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN n >= {warc.LEAST_SHARED} AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN n >= {warc.LEAST_SHARED} AND page_id < last THEN last END AS refers_to
        FROM m
    """,
    "op8_exact_duplicates": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
}
