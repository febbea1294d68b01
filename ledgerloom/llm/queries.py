"""The queries of the operators, with their SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm import audit as filters
from ledgerloom.llm.common import table
from ledgerloom.llm.exact import exact_dedup
from ledgerloom.llm.langid import identify
from ledgerloom.llm.maintext import extract
from ledgerloom.llm.mixing import mix
from ledgerloom.llm.near import near_dedup
from ledgerloom.llm.packing import pack
from ledgerloom.llm.pii import find_personal_data
from ledgerloom.llm.quality import judge
from ledgerloom.llm.shards import shard
from ledgerloom.llm.suffix import remove_repeats
from ledgerloom.llm.variants import SQL as VARIANTS_SQL
from ledgerloom.llm.variants import group
from ledgerloom.llm.warc import warc_round_trip
from ledgerloom.plans.registry import Register

register = Register()


@register.add("op1_best_fit_packing")
def op1_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents packed into sequences of at most 1024 tokens."""
    return pack(table(spark, folder, "documents"))


@register.add("op2_suffix_dedup")
def op2_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes of all documents in strings of 200 that start elsewhere, too."""
    return remove_repeats(table(spark, folder, "documents")).drop("kept")


@register.add("op3_mixing")
def op3_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents mixed by source."""
    return mix(table(spark, folder, "documents"))


@register.add("op4_language_id")
def op4_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """The language of all documents."""
    return identify(table(spark, folder, "documents"))


@register.add(
    "op5_warc",
    """
    WITH hashed AS (
        SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS sha,
               min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first
        FROM pages)
    SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes,
           array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
               (CAST('0x' || substr(sha, CAST(1 + 5 * (i // 4) AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31
               AS BIGINT), 1)), '') AS payload_digest,
           CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN page_id <> first THEN first END AS refers_to
    FROM hashed
    """,
)
def op5_warc(spark: SparkSession, folder: str) -> DataFrame:
    """All pages written to archives and read back."""
    return warc_round_trip(table(spark, folder, "pages"))


@register.add("op6_minhash_dedup")
def op6_minhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Classes of near copies among all documents."""
    return near_dedup(table(spark, folder, "documents")).drop("tkey")


@register.add(
    "op7_exact_dedup",
    """
    SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
           doc_id IS NOT DISTINCT FROM max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
)
def op7_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of equal texts over all documents; the largest id of a group stays."""
    return exact_dedup(table(spark, folder, "documents"), keep="largest")


@register.add("op8_quality_rules")
def op8_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Base counts and verdicts of all documents."""
    return judge(table(spark, folder, "documents"))


@register.add("op9_sharding")
def op9_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in 24 shards of near equal bytes."""
    return shard(table(spark, folder, "documents"), 24)


@register.add("op10_pii")
def op10_pii(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data of all documents."""
    return find_personal_data(table(spark, folder, "documents"))


@register.add("op11_main_text")
def op11_main_text(spark: SparkSession, folder: str) -> DataFrame:
    """The main text of all pages."""
    return extract(table(spark, folder, "pages"))


@register.add("op12_spelling_variants", VARIANTS_SQL)
def op12_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    """All words of all documents under their commonest spelling."""
    return group(table(spark, folder, "documents"))


@register.add("op13_filter_audit", filters.SQL)
def op13_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    """What five filters remove from all documents, in all orders."""
    return filters.audit(spark, folder)
