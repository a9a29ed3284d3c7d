"""A content-addressed WARC archive of pages.

Method: the bytes of every distinct payload are stored once, under their SHA-256
digest; the header of every record is stored apart, byte for byte; records are
rebuilt by joining the two.  Payloads count as equal when SHA-256 and length agree,
and a reader recomputes both SHA-256 and SHA-1 from the stored bytes before it
trusts them.

Of the records with one payload, that with the largest page id is a ``response``;
the others are ``revisit`` records that refer to it.  Payloads below
``revisit_from`` bytes are all responses.  Only digests and ids are grouped, so a
payload that very many pages share is a row each of a few bytes; the payloads
themselves are shuffled once to be stored, and once to be joined with their records.
For that join a payload goes to a slice of at most ``SLICE`` of its records at a time,
so that one which a third of all pages share is no single task.

A record id is made of page id and payload digest; it repeats only where both do.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir

DATE = "2024-01-01T00:00:00Z"
CRLF = "\r\n"
SLICE = 1024  # records of one payload in a task
#: An archive is written once and kept, so it is compressed harder than Spark does by itself.
PACKED = {"compression": "zstd", "parquet.compression.codec.zstd.level": "9", "parquet.page.size": str(4 << 20)}


def base32(hexadecimal: Column, digits: int = 40) -> Column:
    """Upper-case RFC 4648 base32 of hex digits, ten at a time (40 bits are eight characters)."""
    eight = [F.lpad(F.conv(F.substring(hexadecimal, k + 1, 10), 16, 32), 8, "0") for k in range(0, digits, 10)]
    return F.translate(F.concat(*eight), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _uri(url: Column) -> Column:
    """The url as one header line: control characters and spaces percent-encoded."""
    out = F.coalesce(url, F.lit(""))
    for c in ["%", *map(chr, range(33)), chr(127)]:
        if c != "%":
            out = F.replace(out, F.lit(c), F.lit(f"%{ord(c):02X}"))
    return out


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", revisit_from: int = 0, date: str = DATE) -> None:
    """Write ``path/records`` (page_id, header, digest, slice) and ``path/payloads`` (digest, payload, slices).

    Null bodies are empty payloads, null urls empty ones.  Ties: rows that repeat
    both id and payload are written as often as they occur, all of the same type.
    A null id is smaller than any other; ids are integers (others raise).  Very long
    bodies are whole; other columns are ignored; an empty table gives an empty archive.
    """
    body = F.coalesce(F.col(body_col).cast("string"), F.lit("")).cast("binary")
    p = pages.select(F.col(id_col).cast("long").alias("page_id"), _uri(F.col(url_col).cast("string")).alias("url"), body.alias("payload"))
    light = p.select("page_id", "url", F.unhex(F.sha2("payload", 256)).alias("digest"), F.unhex(F.sha1("payload")).alias("sha1"), F.octet_length("payload").cast("long").alias("n"))
    first = light.groupBy("digest", "n").agg(F.max("page_id").alias("holder"), F.ceil(F.count(F.lit(1)) / SLICE).cast("int").alias("slices"))
    typed = light.join(first, ["digest", "n"]).withColumn("revisit", (F.col("n") >= revisit_from) & ~F.col("page_id").eqNullSafe(F.col("holder")))
    line = lambda name, value: F.concat(F.lit(name + ": "), value, F.lit(CRLF))
    record = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(":"), F.lower(F.substring(F.hex("digest"), 1, 24)), F.lit(">"))
    http = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(F.col("revisit"), "revisit").otherwise("response")),
        line("WARC-Record-ID", record(F.col("page_id"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", F.col("url")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.hex("sha1")))),
        F.when(F.col("revisit"), F.concat(line("WARC-Refers-To", record(F.col("holder"))), line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))).otherwise(""),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", (F.when(F.col("revisit"), 0).otherwise(F.col("n")) + len(http)).cast("string")),
        F.lit(CRLF + http),
    )
    slice_ = F.pmod(F.xxhash64("page_id", "url"), F.col("slices")).cast("int").alias("slice")
    typed.select("page_id", header.cast("binary").alias("header"), "digest", slice_).write.options(**PACKED).parquet(f"{path}/records")
    at = lambda c: F.coalesce(F.col(c), F.lit(-(1 << 63))).alias("at")
    full = p.select(F.unhex(F.sha2("payload", 256)).alias("digest"), at("page_id"), "payload")
    held = full.join(first.select("digest", at("holder"), "slices"), ["digest", "at"])
    # partitioned by both keys already, so dropping repeated rows needs no further shuffle
    held.dropDuplicates(["digest", "at"]).select("digest", "payload", "slices").write.options(**PACKED).parquet(f"{path}/payloads")


def read_records(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(records, payloads) as written."""
    return spark.read.schema("page_id long, header binary, digest binary, slice int").parquet(f"{path}/records"), spark.read.schema("digest binary, payload binary, slices int").parquet(f"{path}/payloads")


def rebuilt(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, record binary, payload binary): the original records.  A revisit has
    an empty block in the record and the payload it refers to beside it.

    Raises on a payload that is missing or whose bytes do not match its digest.
    """
    records, payloads = read_records(spark, path)
    sound = F.unhex(F.sha2("payload", 256)) == F.col("digest")
    payloads = payloads.select("digest", F.when(sound, F.col("payload")).alias("payload"), F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"))
    d = records.join(payloads, ["digest", "slice"], "left")
    payload = F.when(F.col("payload").isNotNull(), F.col("payload")).otherwise(F.raise_error(F.lit("a payload is missing or does not match its digest")).cast("binary"))
    kind = F.col("header").cast("string").contains("WARC-Type: revisit")
    block = F.when(kind, F.lit("").cast("binary")).otherwise(F.col("payload"))
    return d.withColumn("payload", payload).select("page_id", F.concat("header", block, F.lit(CRLF * 2).cast("binary")).alias("record"), "payload")


def read_back(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to), parsed from the
    bytes of the rebuilt records.

    A response's payload is cut out of its record by Content-Length and has to match the
    digest in the header; a revisit's is that which the archive joined to it, and has to
    match likewise.
    """
    d = rebuilt(spark, path)
    # headers are ASCII but for the url, so bytes are looked up as Latin characters
    text = F.decode("record", "ISO-8859-1")
    head = F.substring_index(text, CRLF * 2, 2)
    d = d.select(head.alias("head"), "record", "payload")
    field = lambda name: F.regexp_extract("head", rf"\n{name}: ([^\r\n]*)", 1)
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+):[0-9a-f]+>$", 1).try_cast("long")
    kind = field("WARC-Type")
    warc = F.length(F.substring_index("head", CRLF * 2, 1)) + 4
    start = F.length("head") + 4
    cut = F.expr("substring(record, int(start) + 1, int(warc + size - start))")
    d = d.select("record", "payload", kind.alias("record_type"), number(field("WARC-Record-ID")).alias("page_id"), F.regexp_replace(field("WARC-Payload-Digest"), "^sha1:", "").alias("said"), number(field("WARC-Refers-To")).alias("refers_to"), warc.alias("warc"), start.alias("start"), field("Content-Length").cast("long").alias("size"))
    d = d.select("page_id", "record_type", "refers_to", "said", F.when(F.col("record_type") == "response", cut).otherwise(F.col("payload")).alias("body"))
    d = d.select("page_id", "record_type", "refers_to", "said", F.octet_length("body").cast("long").alias("payload_bytes"), base32(F.sha1("body")).alias("sha1"))
    digest = F.when(F.col("sha1") == F.col("said"), F.col("sha1")).otherwise(F.raise_error(F.lit("a record's payload does not match its digest")))
    return d.select("page_id", "payload_bytes", digest.alias("payload_digest"), "record_type", "refers_to")


def op3_warc(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archive(pages, path)
    return read_back(spark, path)


ORACLE = r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha1(b) AS h, max(page_id) OVER (PARTITION BY b) AS top FROM p),
bits AS (SELECT *, [('0x' || substr(h, 1 + 10 * k, 10))::BIGINT FOR k IN [0, 1, 2, 3]] AS v FROM d)
SELECT page_id, payload_bytes,
 array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((v[1 + j // 8] >> (35 - 5 * (j % 8))) & 31)::INT, 1) FOR j IN generate_series(0, 31)], '') AS payload_digest,
 CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
 CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to FROM bits
"""
