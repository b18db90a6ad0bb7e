"""The queries of this subpackage: each applies one operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, language, minhash_dedup, packing, quality_ranking, quality_rules, spotsigs, suffix_dedup, toxicity, wacz
from tessera.llm.common import fold, table


def tokenizer_path() -> str:
    """The vocabulary file of the byte-level BPE queries."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded; digests of its ids and of the decoded text."""
    out = bpe.round_trip(table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_path())
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        bpe.ids_digest("ids").alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents on 4-word shingles at 0.8."""
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"), words=4)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and the verdict of weakly supervised rules on every document."""
    return quality_rules.score(table(spark, sf_dir, "documents", "doc_id", "text"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents, learned outside fold 0 of 5."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    labels = quality_ranking.training_labels(table(spark, sf_dir, "labels", "doc_id", "quality"), 5, 0)
    out = quality_ranking.score(docs, quality_ranking.fit(docs, labels))
    return out.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents, learned outside fold 2 of 4."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    out = language.predict(docs, language.fit(docs.where(fold("doc_id", 4) != 2)))
    return out.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op6_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, and how alike they are."""
    out = spotsigs.compare_with_edits(table(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select(
        "doc_id",
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited"), 256).alias("edited_sha256"),
        spotsigs.fingerprint("signatures").alias("fingerprint"),
        spotsigs.fingerprint("edited_signatures").alias("edited_fingerprint"),
        "near_edited",
        "near_next",
        spotsigs.length_partition("signatures").alias("length_partition"),
    )


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents, learned outside fold 2 of 4."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    labels = quality_ranking.training_labels(table(spark, sf_dir, "labels", "doc_id", "toxic"), 4, 2)
    out = toxicity.score(docs, toxicity.fit(docs, labels))
    return out.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", "predicted")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC records into ZIP packages and read back by range."""
    pages = table(spark, sf_dir, "pages", "page_id", "url", "html")
    records = wacz.read(wacz.write(pages))
    return records.select("page_id", F.coalesce(F.octet_length("payload"), F.lit(0)).cast("long").alias("block_bytes"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    return packing.pack_texts(table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_path())


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the 200-byte strings that occur more than once."""
    out = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents", "doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["start"]))
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_minhash_dedup": op2_minhash_dedup,
    "op3_quality_rules": op3_quality_rules,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_language_id": op5_language_id,
    "op6_spotsigs": op6_spotsigs,
    "op7_toxicity": op7_toxicity,
    "op8_warc": op8_warc,
    "op9_packing": op9_packing,
    "op10_suffix_dedup": op10_suffix_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op8_warc": """
        WITH p AS (
            SELECT page_id, coalesce(html, '') AS html, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes FROM pages
        ), first AS (
            SELECT html, max(page_id) AS page_id FROM p WHERE payload_bytes >= 1000 GROUP BY html
        )
        SELECT p.page_id,
               CAST(CASE WHEN p.page_id < first.page_id THEN 0 ELSE payload_bytes END AS BIGINT) AS block_bytes,
               payload_bytes,
               sha1(p.html) AS payload_digest,
               CASE WHEN p.page_id < first.page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN p.page_id < first.page_id THEN first.page_id END AS refers_to
        FROM p LEFT JOIN first ON p.html = first.html AND p.payload_bytes >= 1000
    """,
}
