"""A content-addressed web archive: payloads once by digest, record headers as they are, and a join.

``payloads`` holds each distinct payload once under its SHA-256. ``headers`` holds a row per record:
the exact bytes that stand before the payload, and the digest. A record is its header, its payload
if it is a response, and two line ends. Of records with equal payloads of some size one is the
response and the others revisit it; smaller ones are all responses, though their bytes are also
stored once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from medialog.llm.common import written

REVISIT_BYTES = 1_000
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def _record_id(page_id: Column, otherwise: Column) -> Column:
    """A name that is the same on every run: an MD5 in the shape of a UUID."""
    digest = F.md5(F.coalesce(F.concat(F.lit("page "), page_id.cast("string")), otherwise).cast("binary"))
    parts = [F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _line(name: str, value: Column) -> Column:
    """A header line, or nothing for a null value. Line ends inside values are escaped."""
    plain = F.regexp_replace(F.regexp_replace(value.cast("string"), "\r", "%0D"), "\n", "%0A")
    return F.coalesce(F.concat(F.lit(f"{name}: "), plain, F.lit("\r\n")), F.lit(""))


def write_archive(
    pages: DataFrame, path: str, date: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", revisit_bytes: int = REVISIT_BYTES
) -> None:
    """Write ``pages`` as an archive to a new folder. ``date`` (ISO 8601, UTC) is that of all records.

    A null payload is empty, a null url is left out. The response among equal payloads is the record
    with the largest id; records without an id are never referred to, and are responses if no
    equal payload has one. Repeated rows are records of their own. Ids are whole numbers.
    """
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    records = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    addressed = records.withColumn("address", F.sha2("payload", 256))
    # Equal payloads meet in each task first, so that copies do not move.
    addressed.groupBy("address").agg(F.first("payload").alias("payload")).write.option("compression", "zstd").parquet(f"{path}/payloads")

    facts = written(
        addressed.select("page_id", "url", "address", F.sha1("payload").alias("digest"), F.octet_length("payload").cast("long").alias("bytes")),
        "warc-facts",
    )
    owners = facts.where(F.col("bytes") >= revisit_bytes).groupBy("address").agg(F.max("page_id").alias("owner"), F.count("*").alias("n")).where("n > 1")
    found = facts.join(owners.drop("n"), "address", "left")
    revisit = F.col("owner").isNotNull() & ~F.col("owner").eqNullSafe(F.col("page_id"))
    own_id = _record_id(F.col("page_id"), F.concat_ws(" ", F.lit("none"), "address", "url"))
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        F.when(revisit, F.lit("WARC-Type: revisit\r\n")).otherwise(F.lit("WARC-Type: response\r\n")),
        _line("WARC-Record-ID", own_id),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        _line("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        _line("WARC-Refers-To", F.when(revisit, _record_id(F.col("owner"), F.lit("")))),
        _line("X-Page-Id", F.col("page_id")),
        _line("X-Refers-To-Page-Id", F.when(revisit, F.col("owner"))),
        _line("Content-Type", F.lit("application/http; msgtype=response")),
        _line("Content-Length", F.when(revisit, F.lit(len(_HTTP)).cast("long")).otherwise(F.col("bytes") + len(_HTTP))),
        F.lit("\r\n" + _HTTP),
    )
    found.select(header.cast("binary").alias("header"), "address").write.option("compression", "zstd").parquet(f"{path}/headers")


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """A row per record: ``header`` bytes, ``address`` of its payload, and what the header says:
    ``page_id``, ``url``, ``record_type``, ``refers_to``, ``digest``, ``date``."""
    stored = spark.read.schema("header binary, address string").parquet(f"{path}/headers")
    text = F.substring_index(F.col("header").cast("string"), "\r\n\r\n", 1)

    def field(name: str) -> Column:
        found = F.regexp_extract(text, f"\r\n{name}: ([^\r\n]*)", 1)
        return F.when(found != "", found)

    return stored.select(
        "header",
        "address",
        field("X-Page-Id").cast("long").alias("page_id"),
        field("WARC-Target-URI").alias("url"),
        field("WARC-Type").alias("record_type"),
        field("X-Refers-To-Page-Id").cast("long").alias("refers_to"),
        F.regexp_replace(field("WARC-Payload-Digest"), "^sha1:", "").alias("digest"),
        field("WARC-Date").alias("date"),
    )


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """``address``, ``payload``: bytes that do not have their digest end the job."""
    stored = spark.read.schema("address string, payload binary").parquet(f"{path}/payloads")
    wrong = F.raise_error(F.concat(F.lit("payload differs from its digest "), F.col("address")))
    return stored.select("address", F.when(F.sha2("payload", 256) == F.col("address"), F.col("payload")).otherwise(wrong).alias("payload"))


def read_archive(spark: SparkSession, path: str, **measures: Column) -> DataFrame:
    """The records, by a join of headers and payloads: what :func:`read_headers` has and ``payload``.

    A record whose payload is not there ends the job. With ``measures``, expressions over ``payload``, these are taken once
    from each stored payload and joined instead of its bytes.
    """
    payloads = read_payloads(spark, path)
    if measures:
        payloads = payloads.select("address", *[m.alias(name) for name, m in measures.items()])
    found = payloads.withColumn("there", F.lit(True))
    records = read_headers(spark, path).join(found, "address", "left")
    lost = F.raise_error(F.concat(F.lit("no payload has the digest "), F.col("address")))
    first = next(iter(measures), "payload")
    return records.withColumn(first, F.when(F.col("there"), F.col(first)).otherwise(lost)).drop("there")


def record_bytes(records: DataFrame) -> DataFrame:
    """``page_id`` and the whole bytes of each record of :func:`read_archive`."""
    return records.select("page_id", _bytes().alias("record"))


def _bytes() -> Column:
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    return F.concat("header", body, F.lit(b"\r\n\r\n"))


def reconstructed(records: DataFrame) -> DataFrame:
    """Records of :func:`read_archive` as their bytes have them: ``record``, ``page_id``, ``record_type``, ``refers_to``, ``payload``.

    Each record is put together, and read again: its fields from the lines before the first empty one, its payload
    from behind the second to the record's end. A revisit has none; its payload is the one joined
    to it. A length or digest other than the header's ends the job.
    """
    gap = "\r\n\r\n"
    text = F.col("record").cast("string")
    head = F.substring_index(text, gap, 1)

    def behind(x: Column) -> Column:
        return F.substr(x, F.instr(x, gap) + len(gap))

    def field(name: str) -> Column:
        found = F.regexp_extract(F.col("head"), f"\r\n{name}: ([^\r\n]*)", 1)
        return F.when(found != "", found)

    whole = records.select(_bytes().alias("record"), F.col("payload").alias("joined")).withColumns({"head": head, "content": behind(text)})
    content = F.left("content", F.length("content") - len(gap))
    read = whole.withColumn("content", content).select(
        "record",
        field("X-Page-Id").cast("long").alias("page_id"),
        field("WARC-Type").alias("record_type"),
        field("X-Refers-To-Page-Id").cast("long").alias("refers_to"),
        field("WARC-Payload-Digest").alias("stated"),
        (field("Content-Length").cast("long") == F.octet_length("content")).alias("as_long"),
        F.when(field("WARC-Type") == "response", behind(F.col("content")).cast("binary")).otherwise(F.col("joined")).alias("payload"),
    )
    right = F.col("as_long") & (F.concat(F.lit("sha1:"), F.sha1("payload")) == F.col("stated"))
    wrong = F.raise_error(F.concat(F.lit("a record differs from its header: page "), F.coalesce(F.col("page_id").cast("string"), F.lit("-"))))
    return read.select("record", "page_id", "record_type", "refers_to", F.when(right, F.col("payload")).otherwise(wrong).alias("payload"))
