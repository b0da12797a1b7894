"""From raw responses to access-log rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medialog.functions.text import client_family, redact_url

ABORTED = "The client hung up before the transfer was complete, so this download is incomplete."


def failure_reason(status: Column, file_name: Column) -> Column:
    """A sentence for a failed response nobody explained."""
    subject = F.coalesce(F.concat(F.lit("`"), file_name, F.lit("`")), F.lit("this file"))
    broken = F.concat(F.lit("Sending "), subject, F.lit(" failed part-way: it could no longer be read."))
    outside = F.concat(
        F.lit("A part of "), subject, F.lit(" was requested that does not exist; the client may hold an older copy.")
    )
    refused = F.concat(subject, F.lit(" could not be served (HTTP "), status.cast("string"), F.lit(")."))
    return F.when(status >= 500, broken).when(status == 416, outside).when(status >= 400, refused)


def derive_outcome(raw: DataFrame) -> DataFrame:
    """Add bytes_sent and error as they really ended.

    An aborted transfer sent an unknown number of bytes; a 304 sent zero, which is a fact.
    """
    status = F.col("status_code")
    sent = F.coalesce(
        F.when(status == 304, F.lit(0)), F.col("stated_bytes"), F.nullif(F.col("content_length"), F.lit(0))
    )
    reason = F.coalesce(F.col("error"), failure_reason(status, F.col("file_name")))
    return raw.withColumns(
        {
            "bytes_sent": F.when(~F.col("aborted"), sent).cast("bigint"),
            "error": F.when(F.col("aborted"), ABORTED).otherwise(reason),
        }
    )


def shortened(column: str, most: int | None) -> Column:
    return F.col(column) if most is None else F.substring(column, 1, most)


def enrich_requests(raw: DataFrame, range_chars: int | None = None, error_chars: int | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Access-log rows of raw responses.

    The owner's own requests are dropped, a media request with a Range header is a stream, and
    the user agent is reduced to a client family. Range headers and errors are kept whole unless a
    number of characters is given. Columns to ``keep`` follow.
    """
    ranged = F.col("range_header").isNotNull() & (F.col("range_header") != "")
    kind = F.when(F.col("route") == "media", F.when(ranged, "stream").otherwise("download")).otherwise(F.col("route"))
    visible = raw.where(~F.coalesce(F.col("is_owner"), F.lit(False)))
    return derive_outcome(visible).select(
        F.col("request_id").alias("id"),
        "episode_id",
        "show_id",
        "requested_at",
        kind.alias("kind"),
        "status_code",
        "bytes_sent",
        F.col("total_bytes").cast("bigint").alias("total_bytes"),
        F.nullif(shortened("range_header", range_chars), F.lit("")).alias("range_header"),
        client_family(F.col("user_agent")).alias("client"),
        F.nullif(shortened("error", error_chars), F.lit("")).alias("error"),
        *keep,
    )


def redacted(raw: DataFrame, column: str = "url") -> DataFrame:
    """Hide feed credentials in logged addresses."""
    return raw.withColumn(column, redact_url(F.col(column)))
