"""The registered queries of the training-data operators, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import bpe, edit_fingerprint, html_text, language_id, lexical_search, line_dedup, packing, periodic_runs, quote_links, simhash, token_counts, transport_stream, warc
from tidewatch.llm.shared import new_folder


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_removed")


def op2_quote_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quote_links.link_quotes(table(spark, sf_dir, "conversations"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_digests(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = language_id.identify(docs.select("doc_id", "text"), language_id.fit(docs))
    return out.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score", "known")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "warc")
    warc.write_archive(table(spark, sf_dir, "pages"), path)
    out = warc.parse_records(warc.read_archive(spark, path))
    return out.select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, sf_dir, "documents"), shingle=3, most=2)


def op7_transport_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transport_stream.media_features(table(spark, sf_dir, "documents"))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op9_edit_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_fingerprint.near_edits(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "lexical-index")
    lexical_search.build_index(table(spark, sf_dir, "documents"), path)
    return lexical_search.search(spark, path, table(spark, sf_dir, "benchmark"), k=10)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.periodic_runs(table(spark, sf_dir, "documents"), plant=True)


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), limit=1024)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_line_dedup, op2_quote_links, op3_bpe, op4_language_id, op5_warc, op6_simhash, op7_transport_stream, op8_html_text, op9_edit_fingerprint, op10_packing, op11_lexical_search, op12_periodic_runs, op13_token_counts)
}

ORACLES: dict[str, str] = {
    "op1_line_dedup": line_dedup.ORACLE,
    "op2_quote_links": quote_links.ORACLE,
    "op11_lexical_search": lexical_search.ORACLE,
    "op5_warc": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, octet_length(body) AS n, sha256(body) AS digest FROM p),
f AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY digest) ELSE page_id END AS first FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM f
""",
}
