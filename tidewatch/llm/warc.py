"""A content-addressed WARC archive: payloads once by digest, record headers apart.

An archive is two tables in one folder. ``headers`` has a row per record with its exact header
bytes and the digest its block is kept under; ``payloads`` has every different block once. The
records come back, byte for byte, by a join of the two.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.shared import cut

#: Fixed values of the format: version line, line end, revisit profile.
VERSION, CRLF, PROFILE = "WARC/1.1", "\r\n", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


#: Characters that a header line can't hold as they are: controls and what Unicode takes for line ends.
UNSAFE = [*map(chr, range(32)), "\x7f", *map(chr, range(0x80, 0xA0)), "\u2028", "\u2029"]


def clean_uri(url: Column) -> Column:
    """The URI with characters that a header line can't hold percent-encoded, as UTF-8."""
    out = url
    for c in UNSAFE:
        out = F.replace(out, F.lit(c), F.lit("".join(f"%{b:02X}" for b in c.encode())))
    return F.when(url.rlike("[\\x00-\\x1f\\x7f-\\x9f\\u2028\\u2029]"), out).otherwise(url)


def _uuid(kind: str, key: Column) -> Column:
    h = F.md5(F.concat(F.lit(kind), key))
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def _rows(pages: DataFrame, key: str, url: str, payload: str) -> DataFrame:
    body = F.coalesce(F.encode(F.col(payload).cast("string"), "UTF-8"), F.lit(b""))
    rows = pages.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(url).cast("string"), F.lit("")).alias("url"), body.alias("block"))
    return rows.select("*", F.sha2("block", 256).alias("digest"), F.length("block").cast("long").alias("n"))


def to_headers(pages: DataFrame, least: int = 100, key: str = "page_id", url: str = "url", payload: str = "html", date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """``header, http, digest, has_block``: the exact header bytes of one record per row, and those of the HTTP message it holds.

    Of rows with equal payloads of at least ``least`` bytes the smallest key is the response and
    the others revisit it; smaller payloads are all responses. A null payload is empty; a row
    with a null key is a revisit where its payload has a row with a key, else a response; rows that
    repeat the smallest key are all responses. Payloads aren't shuffled: only keys and digests are
    grouped (combined on the map side) and joined, and the group table holds repeated digests alone.
    """
    rows = _rows(pages, key, url, payload).drop("block")
    answer = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("n").cast("string"), F.lit(CRLF + CRLF))
    rows = rows.withColumn("http", answer)
    # materialised, so that both sides of the join come from plain shuffles and a very common payload can be split over tasks
    groups = cut(rows.where(F.col("n") >= least).groupBy("digest").agg(F.min("key").alias("first"), F.count("*").alias("copies")).where("copies > 1").drop("copies"))
    rows = rows.join(groups, "digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("key").eqNullSafe(F.col("first"))
    name, clean = F.coalesce(F.col("key").cast("string"), F.lit("none")), clean_uri(F.col("url"))
    line = lambda field, value: F.concat(F.lit(f"{field}: "), value, F.lit(CRLF))
    header = F.concat(
        F.lit(VERSION + CRLF),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", F.concat(F.lit("<urn:uuid:"), _uuid("record", name), F.lit(">"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", clean),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", F.concat(F.lit("<urn:uuid:"), _uuid("record", F.col("first").cast("string")), F.lit(">"))), line("WARC-Refers-To-Key", F.col("first").cast("string")))).otherwise(F.lit("")),
        line("X-Key", name),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", (F.length("http") + F.when(revisit, F.lit(0)).otherwise(F.col("n"))).cast("string")),
        F.lit(CRLF),
    )
    return rows.select(F.encode(header, "UTF-8").alias("header"), F.encode("http", "UTF-8").alias("http"), "digest", (~revisit).alias("has_block"))


def write_archive(pages: DataFrame, path: str, least: int = 100, key: str = "page_id", url: str = "url", payload: str = "html") -> None:
    """Write ``headers`` (all records) and ``payloads`` (each different payload once, under its digest).

    Payloads of equal digest are reduced before they are shuffled, so that one in very many records
    moves once a task.
    """
    to_headers(pages, least, key, url, payload).write.option("compression", "zstd").parquet(f"{path}/headers")
    blocks = _rows(pages, key, url, payload).select("digest", "block")
    blocks.dropDuplicates(["digest"]).write.option("compression", "zstd").parquet(f"{path}/payloads")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """The records: ``header, digest, block, payload``. ``block`` is what the record itself holds (an HTTP message, for a
    revisit its header alone); ``payload`` the full payload, the referred response's for a revisit. A stored
    payload whose bytes don't give its digest raises an error."""
    headers, payloads = spark.read.parquet(f"{path}/headers"), spark.read.parquet(f"{path}/payloads")
    verified = payloads.select("digest", F.when(F.sha2("block", 256) == F.col("digest"), F.col("block")).otherwise(F.raise_error(F.concat(F.lit("corrupt payload "), F.col("digest"))).cast("binary")).alias("payload"))
    out = headers.join(verified, "digest", "left")
    return out.select("header", "digest", F.concat("http", F.when(F.col("has_block"), F.col("payload")).otherwise(F.lit(b""))).alias("block"), "payload")


def record_bytes(records: DataFrame) -> DataFrame:
    """Adds ``record``: the exact bytes of the WARC record."""
    return records.withColumn("record", F.concat("header", "block", F.lit(b"\r\n\r\n")))


def field(header: Column, name: str) -> Column:
    """A named field of a record header, null if absent. Lines end at CRLF alone."""
    return F.nullif(F.regexp_extract(F.decode(header, "UTF-8"), f"\r\n{name}: ([^\r\n]*)\r\n", 1), F.lit(""))


def parse_records(records: DataFrame) -> DataFrame:
    """``key, payload_bytes, payload_digest, record_type, refers_to`` from the header and payload bytes.

    The block's length is held against Content-Length and the payload's digest against
    WARC-Payload-Digest; a record that fails either raises an error.
    """
    out = records.select(
        field(F.col("header"), "X-Key").try_cast("long").alias("key"),
        field(F.col("header"), "WARC-Type").alias("record_type"),
        field(F.col("header"), "WARC-Refers-To-Key").cast("long").alias("refers_to"),
        F.substring_index(field(F.col("header"), "WARC-Payload-Digest"), ":", -1).alias("declared"),
        field(F.col("header"), "Content-Length").cast("long").alias("declared_bytes"),
        F.length("block").cast("long").alias("block_bytes"),
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_digest"),
    )
    fine = F.coalesce((F.col("declared") == F.col("payload_digest")) & (F.col("declared_bytes") == F.col("block_bytes")), F.lit(False))
    return out.select("key", "payload_bytes", F.when(fine, F.col("payload_digest")).otherwise(F.raise_error(F.concat(F.lit("record doesn't match its header: "), F.col("declared")))).alias("payload_digest"), "record_type", "refers_to")
