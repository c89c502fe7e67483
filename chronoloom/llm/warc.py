"""Derivative records of web archives: each response becomes a metadata record and a plain-text conversion record.

Both name the response in WARC-Refers-To and carry its URI, date, HTTP header and payload digest on. Everything is a
column expression, so a page is one row in and two rows out, without a shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = "WARC/1.1"
CRLF = "\r\n"
# Patterns that turn a page into text, in this order, with their replacements.
TO_TEXT = [
    (r"(?is)<head.*?</head\s*>", ""),
    (r"(?is)<script.*?</script\s*>", ""),
    (r"(?is)<style.*?</style\s*>", ""),
    (r"(?s)<!--.*?-->", ""),
    (r"(?i)</?(p|div|li|ul|ol|dl|dt|dd|table|tr|h[1-6]|br|hr|section|article|nav|header|footer|main|body|html|pre|blockquote)(\s[^>]*)?/?>", "\n"),
    (r"(?s)<[^>]*>", ""),
    (r"&nbsp;", " "),
    (r"&lt;", "<"),
    (r"&gt;", ">"),
    (r"&quot;", '"'),
    (r"&#39;", "'"),
    (r"&amp;", "&"),
    (r"[ \t\r\f]+", " "),
    (r" ?\n[ \n]*", "\n"),
    (r"^[ \n]+|[ \n]+$", ""),
]
TITLE = r"(?is)<title[^>]*>(.*?)</title"
LINK = r'(?i)\shref="([^"]*)"'  # the form that the SQL twin reads: all that the given pages hold
LINKS = r"""(?i)\shref\s*=\s*("[^"]*"|'[^']*'|[^\s"'>][^\s>]*)"""  # values in double, single or no quotes


def digest(block: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(block.cast("binary"), 256))


def record_id(*parts: Column) -> Column:
    """A name-based urn:uuid, the same in every run."""
    h = F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]).cast("binary"))
    cuts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cuts), F.lit(">"))


def plain_text(html: Column) -> Column:
    """Visible text: head, scripts, styles and comments go, blocks become lines, the common entities are read."""
    return reduce(lambda text, step: F.regexp_replace(text, F.lit(step[0]), F.lit(step[1])), TO_TEXT, html)


def responses(pages: DataFrame, date: str = "2026-01-01T00:00:00Z") -> DataFrame:
    """(page_id, record_id, target_uri, date, http_header, payload, payload_digest) of (page_id, url, html) rows.

    A null html is a response without payload. Repeated rows give the same record again.
    """
    payload = F.coalesce("html", F.lit(""))
    header = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
                      F.octet_length(payload).cast("string"), F.lit(CRLF))
    return pages.select(
        "page_id", record_id(F.lit("response"), F.col("page_id"), F.col("url"), digest(payload)).alias("record_id"),
        F.col("url").alias("target_uri"), F.lit(date).alias("date"), header.alias("http_header"), payload.alias("payload"),
        digest(payload).alias("payload_digest"))


def _headers(kind: str, own: Column, media: str, block: Column) -> Column:
    """The record's header lines; a line without a value is left out."""
    lines = [
        ("WARC-Type", F.lit(kind)), ("WARC-Record-ID", own), ("WARC-Refers-To", F.col("record_id")), ("WARC-Target-URI", F.col("target_uri")),
        ("WARC-Date", F.col("date")), ("WARC-Payload-Digest", F.col("payload_digest")), ("WARC-Block-Digest", digest(block)),
        ("Content-Type", F.lit(media)), ("Content-Length", F.octet_length(block).cast("string"))]
    return F.concat_ws(CRLF, F.lit(VERSION), *[F.concat(F.lit(f"{name}: "), value) for name, value in lines])


def derive(source: DataFrame) -> DataFrame:
    """Two records for each row of `responses`: record_type metadata and conversion.

    Returns page_id, record_type, record_id, refers_to, target_uri, payload_digest (of the source), block_digest,
    content_length (bytes of the block), headers and block. The metadata block holds the source's HTTP header lines,
    title and links in order, whatever their quotes; a page without title or links has no such lines. A null target_uri has no header line.
    """
    bare = lambda u: F.when(F.substring(u, 1, 1).isin('"', "'"), F.substring(u, F.lit(2), F.length(u) - 2)).otherwise(u)
    links = F.transform(F.regexp_extract_all("payload", F.lit(LINKS), F.lit(1)), lambda u: F.concat(F.lit("outlink: "), bare(u), F.lit(CRLF)))
    title = F.regexp_replace(F.trim(F.regexp_extract("payload", TITLE, 1)), F.lit(r"[\r\n]+"), F.lit(" "))
    meta = F.concat(F.col("http_header"), F.when(title != "", F.concat(F.lit("title: "), title, F.lit(CRLF))).otherwise(""), F.array_join(links, ""))
    kinds = F.array(
        F.struct(F.lit("metadata").alias("kind"), F.lit("application/warc-fields").alias("media"), meta.alias("block")),
        F.struct(F.lit("conversion").alias("kind"), F.lit("text/plain").alias("media"), plain_text(F.col("payload")).alias("block")))
    rows = source.withColumn("_k", F.explode(kinds))
    block, own = F.col("_k.block"), record_id(F.col("_k.kind"), F.col("record_id"))
    headers = F.when(F.col("_k.kind") == "metadata", _headers("metadata", own, "application/warc-fields", block)).otherwise(
        _headers("conversion", own, "text/plain", block))
    return rows.select(
        "page_id", F.col("_k.kind").alias("record_type"), own.alias("record_id"), F.col("record_id").alias("refers_to"), "target_uri",
        "payload_digest", digest(block).alias("block_digest"), F.octet_length(block).cast("long").alias("content_length"),
        headers.alias("headers"), block.alias("block"))


def write_records(records: DataFrame, path: str) -> None:
    """Gzip files of whole records; a record ends with two empty lines' breaks, as the format asks."""
    text = F.concat(F.col("headers"), F.lit(CRLF * 2), F.col("block"))
    records.select(text.alias("value")).write.option("lineSep", CRLF * 2).option("compression", "gzip").text(path)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(record_type, record_id, refers_to, target_uri, headers, block, whole) of files that `write_records` made.

    whole says that the block has the length that its header states; it hasn't where a block holds a version line.
    """
    rows = spark.read.option("lineSep", VERSION + CRLF).text(path).where(F.length("value") > 0)
    cut = F.instr("value", CRLF * 2)
    rows = rows.select(F.substring("value", F.lit(1), cut - 1).alias("lines"), F.expr("substring(value, instr(value, '\\r\\n\\r\\n') + 4)").alias("rest"))
    block = F.expr("substring(rest, 1, length(rest) - 4)")

    def field(name: str) -> Column:
        found = F.regexp_extract("lines", rf"(?m)^{name}: ([^\r\n]*)", 1)
        return F.when(found != "", found)

    return rows.select(
        field("WARC-Type").alias("record_type"), field("WARC-Record-ID").alias("record_id"), field("WARC-Refers-To").alias("refers_to"),
        field("WARC-Target-URI").alias("target_uri"), F.concat(F.lit(VERSION + CRLF), "lines").alias("headers"), block.alias("block"),
        (F.octet_length(block) == field("Content-Length").cast("long")).alias("whole"))
