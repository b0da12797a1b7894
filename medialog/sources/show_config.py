"""Show settings as JSON: import from a hand-edited file, export for version control."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from medialog.functions.text import blank_to_null
from medialog.operators.categories import match_category
from medialog.operators.settings import EXPORTED_KEYS, INSTANCE
from medialog.schemas import SHOW_TYPES

CONFIG_NAME = "show.json"
# Accepted keys of each field, first present wins.
ALIASES = {
    "title": ("title",),
    "description": ("description",),
    "author_name": ("author_name", "authorName", "author"),
    "author_email": ("author_email", "authorEmail", "email"),
    "language": ("language",),
    "category": ("category",),
    "subcategory": ("subcategory",),
    "explicit": ("explicit",),
    "itunes_type": ("itunes_type", "itunesType"),
}


def read_show_config(spark: SparkSession, root: str) -> DataFrame:
    """slug and raw text of every show's config file."""
    files = spark.read.text(f"{root.rstrip('/')}/*/{CONFIG_NAME}", wholetext=True)
    folder = F.element_at(F.split(F.input_file_name(), "/"), -2)
    return files.select(F.url_decode(F.replace(folder, F.lit("+"), F.lit("%2B"))).alias("slug"), F.col("value").alias("text"))


def parse_show_config(texts: DataFrame) -> DataFrame:
    """Cleaned fields of (slug, text); unreadable JSON gives found = false and no fields."""
    keys = [k for names in ALIASES.values() for k in names]
    parsed = F.from_json("text", ", ".join(f"`{k}` STRING" for k in keys), {"caseSensitive": "true"})
    whole = F.trim("text").startswith("{") & F.get_json_object("text", "$").isNotNull()
    rows = texts.withColumn("p", F.when(whole, parsed))

    def field(name: str) -> Column:
        return F.coalesce(*[F.col("p")[k] for k in ALIASES[name]])

    kind = F.lower(blank_to_null(field("itunes_type")))
    rows = rows.select(
        "slug",
        F.coalesce(whole, F.lit(False)).alias("found"),
        *[blank_to_null(field(n)).alias(n) for n in ("title", "description", "author_name", "author_email")],
        F.lower(blank_to_null(field("language"))).alias("language"),
        field("category").alias("raw_category"),
        blank_to_null(field("subcategory")).alias("raw_subcategory"),
        F.when(field("explicit").isNotNull(), field("explicit") == "true").alias("explicit"),
        F.when(kind.isin(*SHOW_TYPES), kind).alias("itunes_type"),
    )
    matched = match_category(rows, "raw_category")
    return matched.withColumn("subcategory", F.coalesce("subcategory", "raw_subcategory")).drop(
        "raw_category", "raw_subcategory"
    )


def show_config_json(shows: DataFrame) -> DataFrame:
    """One JSON document per show. The token and the listing choice are never exported."""
    document = F.struct(
        "title",
        "description",
        "author_name",
        "author_email",
        "language",
        F.col("itunes_category").alias("category"),
        F.col("itunes_subcategory").alias("subcategory"),
        (F.col("explicit") == 1).alias("explicit"),
        "itunes_type",
    )
    return shows.select("slug", F.to_json(document, {"ignoreNullFields": "false"}).alias("document"))


def settings_json(settings: DataFrame, by: str = INSTANCE) -> DataFrame:
    """One JSON document per instance, of the exported keys that are set."""
    values = [F.max(F.when(F.col("key") == k, F.col("value"))).alias(k) for k in EXPORTED_KEYS]
    wide = settings.where(F.col("key").isin(*EXPORTED_KEYS)).groupBy(by).agg(*values)
    return wide.select(by, F.to_json(F.struct(*EXPORTED_KEYS)).alias("document"))


def write_documents(documents: DataFrame, path: str, by: str) -> None:
    """One folder per key, a text file each."""
    documents.select(by, "document").write.mode("errorifexists").partitionBy(by).text(path)
