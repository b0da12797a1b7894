"""Access totals by episode, show, client and period.

All are conditional sums in one grouped pass, so map-side partial aggregation carries hot
shows and episodes.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from medialog.functions.moments import instant
from medialog.functions.numbers import change_between
from medialog.operators.access_log import is_media, succeeded, within
from medialog.operators.joins import lookup_join

COUNTERS = ("downloads", "streams", "failures", "bytes")
SHOW_COUNTERS = (*COUNTERS, "episodes_touched", "feed_fetches")


def media_measures(when: Column | None = None) -> dict[str, Column]:
    """The four counters over download and stream rows, optionally under a condition.

    Bytes count failed transfers too; failures leave feed and cover requests out.
    """
    scope = is_media() if when is None else is_media() & when
    return {
        "downloads": F.count_if(scope & (F.col("kind") == "download") & succeeded()),
        "streams": F.count_if(scope & (F.col("kind") == "stream") & succeeded()),
        "failures": F.count_if(scope & ~succeeded()),
        "bytes": F.coalesce(F.sum(F.when(scope, F.col("bytes_sent"))), F.lit(0)),
    }


def named(measures: dict[str, Column], prefix: str = "") -> list[Column]:
    return [column.alias(prefix + name) for name, column in measures.items()]


def episode_totals(log: DataFrame, frm=None, to=None, show_id: str | None = None) -> DataFrame:
    """Totals per episode, optionally within a period or a show."""
    rows = within(log, frm, to).where(is_media())
    if show_id:
        rows = rows.where(F.col("show_id") == show_id)
    return rows.groupBy("episode_id").agg(*named(media_measures()), F.max("requested_at").alias("last_at"))


def show_rollup(log: DataFrame, frm=None, to=None) -> DataFrame:
    """Media and feed figures of every show that has either, in one pass."""
    is_feed = (F.col("kind") == "feed") & succeeded()
    rows = within(log, frm, to).where(is_media() | is_feed)
    return rows.groupBy("show_id").agg(
        *named(media_measures()),
        F.count_distinct(F.when(is_media(), F.col("episode_id"))).alias("episodes_touched"),
        F.max(F.when(is_media(), F.col("requested_at"))).alias("last_at"),
        F.count_if(is_feed).alias("feed_fetches"),
        F.max(F.when(is_feed, F.col("requested_at"))).alias("feed_last_at"),
    )


def zero_fill(dim: DataFrame, facts: DataFrame, on: str, counters=COUNTERS) -> DataFrame:
    """Every row of the dimension; absent counters are zero, absent instants stay NULL."""
    return dim.join(facts, on, "left").na.fill(0, [c for c in counters if c in facts.columns])


def show_stats(shows: DataFrame, log: DataFrame, frm=None, to=None) -> DataFrame:
    dim = shows.select(F.col("id").alias("show_id"), "slug", "title")
    return zero_fill(dim, show_rollup(log, frm, to), "show_id", SHOW_COUNTERS)


def _moment() -> Column:
    """Time and id packed into one decimal, which a hash aggregate keeps in place."""
    micros, scale = F.unix_micros("requested_at").cast("decimal(19,0)"), F.lit("10000000000000000000").cast("decimal(20,0)")
    return (micros * scale + F.col("id").cast("decimal(19,0)")).cast("decimal(38,0)")


def show_figures(log: DataFrame, frm=None, to=None) -> DataFrame:
    """:func:`show_rollup` and the client of :func:`last_feed_fetch`, from one scan of the log.

    The log is reduced to shows, clients and episodes once, and that to shows.
    """
    is_feed = (F.col("kind") == "feed") & succeeded()
    rows = within(log, frm, to).where(is_media() | is_feed)
    parts = rows.groupBy("show_id", "client", F.when(is_media(), F.col("episode_id")).alias("episode")).agg(
        *named(media_measures()),
        F.max(F.when(is_media(), F.col("requested_at"))).alias("last_at"),
        F.count_if(is_feed).alias("feed_fetches"),
        F.max(F.when(is_feed, F.col("requested_at"))).alias("feed_last_at"),
        F.max(F.when(is_feed, _moment())).alias("moment"),
    )
    # The episodes are counted in a step of their own, so that the rest is not copied for it.
    episodes = parts.groupBy("show_id", "episode").agg(
        *[F.sum(c).alias(c) for c in (*COUNTERS, "feed_fetches")],
        *[F.max(c).alias(c) for c in ("last_at", "feed_last_at")],
        F.max(F.struct("moment", "client")).alias("hit"),
    )
    return episodes.groupBy("show_id").agg(
        *[F.sum(c).alias(c) for c in COUNTERS],
        F.count("episode").alias("episodes_touched"),
        F.max("last_at").alias("last_at"),
        F.sum("feed_fetches").alias("feed_fetches"),
        F.max("feed_last_at").alias("feed_last_at"),
        F.max(F.when(F.col("hit.moment").isNotNull(), F.col("hit"))).alias("hit"),
    ).withColumn("feed_last_client", F.col("hit.client")).drop("hit")


def last_feed_fetch(log: DataFrame, frm=None, to=None) -> DataFrame:
    """Which client last fetched each show's feed, and when; among equal times the highest id.

    The facts are first reduced to shows and clients.
    """
    moment = _moment()
    rows = within(log, frm, to).where((F.col("kind") == "feed") & succeeded())
    per_client = rows.groupBy("show_id", "client").agg(
        F.max(moment).alias("moment"), F.max("requested_at").alias("requested_at")
    )
    latest = F.max_by(F.struct("client", "requested_at"), "moment")
    return per_client.groupBy("show_id").agg(latest.alias("hit")).select(
        "show_id", F.col("hit.client").alias("feed_last_client"), F.col("hit.requested_at").alias("feed_last_at")
    )


def top_clients(log: DataFrame, frm=None, to=None, k: int = 5) -> DataFrame:
    """The busiest clients of each show; unclassified requests are a client of their own.

    The log is counted first: what is ranked per show is one row per client family.
    """
    counts = (
        within(log, frm, to).where(is_media() & succeeded()).groupBy("show_id", "client").agg(F.count("*").alias("n"))
    )
    order = Window.partitionBy("show_id").orderBy(F.desc("n"), F.col("client").asc_nulls_first())
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def show_cards(log: DataFrame, frm=None, to=None) -> DataFrame:
    """Everything one show's card states: figures, last feed client, five busiest clients."""
    clients = (
        top_clients(log, frm, to)
        .groupBy("show_id")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "client", "n"))).alias("clients"))
    )
    return show_figures(log, frm, to).join(clients, "show_id", "left")


def overview(log: DataFrame, frm: datetime | None = None, to=None, prev_from=None) -> DataFrame:
    """Instance totals. With a previous period, one scan split at ``frm``, and the change.

    Without one the figures cover all time, whatever the other bounds.
    """
    if frm is None or prev_from is None:
        return log.agg(
            *named(media_measures()),
            F.max(F.when(is_media(), F.col("requested_at"))).alias("last_at"),
            F.max("requested_at").alias("last_ever_at"),
        )
    at = F.col("requested_at")
    now, before = at >= instant(frm), at < instant(frm)
    sums = within(log, prev_from, to).where(is_media()).agg(
        *named(media_measures(now)),
        *named(media_measures(before), "prev_"),
        F.max(F.when(now, at)).alias("last_at"),
    )
    changes = {f"{c}_change": change_between(F.col(c), F.col(f"prev_{c}")) for c in COUNTERS}
    last_ever = log.agg(F.max("requested_at")).scalar()
    return sums.withColumns({**changes, "last_ever_at": last_ever})


def busiest(
    log: DataFrame, episodes: DataFrame, shows: DataFrame, k: int = 10, frm=None, to=None, show_id=None
) -> DataFrame:
    """Most fetched episodes: downloads, then streams, then bytes, then id."""
    rows = within(log, frm, to).where(is_media() & succeeded() & F.col("show_id").isNotNull())
    if show_id:
        rows = rows.where(F.col("show_id") == show_id)
    measures = media_measures()
    del measures["failures"]
    per_episode = rows.groupBy("episode_id").agg(
        F.max("show_id").alias("show_id"), *named(measures), F.max("requested_at").alias("last_at")
    )
    titles = episodes.select(F.col("id").alias("episode_id"), "title")
    names = shows.select(
        F.col("id").alias("show_id"), F.col("title").alias("show_title"), F.col("slug").alias("show_slug")
    )
    joined = per_episode.join(titles, "episode_id")
    joined = lookup_join(joined, names, ["show_id"], ["episode_id"], "inner").drop("show_id")
    order = [F.desc("downloads"), F.desc("streams"), F.desc("bytes"), F.asc("episode_id")]
    return joined.orderBy(*order).limit(max(1, k))


def by_client(log: DataFrame, frm=None, to=None, show_id=None) -> DataFrame:
    """Successful media requests by client family."""
    rows = within(log, frm, to).where(is_media() & succeeded())
    if show_id:
        rows = rows.where(F.col("show_id") == show_id)
    return rows.groupBy(F.coalesce("client", F.lit("Unknown")).alias("client")).agg(
        F.count_if(F.col("kind") == "download").alias("downloads"),
        F.count_if(F.col("kind") == "stream").alias("streams"),
        F.count("*").alias("n"),
        F.coalesce(F.sum("bytes_sent"), F.lit(0)).alias("bytes"),
    )
