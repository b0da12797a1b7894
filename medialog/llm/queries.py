"""The queries of this subpackage with their DuckDB counterparts where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from medialog.llm import (
    bpe, chat_format, decontaminate, exact_dedup, language_id, license_scan, near_dedup, packing, prefix_trie, quality, resampling, token_counts,
    warc,
)
from medialog.llm.common import shared_path, table, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def wrap(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return wrap


# fixed: white space and words as the contracts define them
_BARE = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
# A one-row table with the remainders of CRC-32 by byte, and the checksum of a text's UTF-8 bytes with it.
_CRC_TABLE = """crc AS (SELECT list(list_reduce([i, 1, 1, 1, 1, 1, 1, 1, 1],
                             lambda c, one: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS tab
        FROM (SELECT unnest(range(0, 256)) AS i))"""
_CRC = """xor(list_reduce(list_concat([4294967295], list_transform(range(0, octet_length(encode({0}))),
              lambda i: CAST('0x' || substr(hex(encode({0})), 2 * i + 1, 2) AS BIGINT))),
              lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295)"""


@_query(
    "op1_exact_dedup",
    f"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS points, sha256({_BARE}) AS text_sha256 FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id) AS kept,
       text_sha256
FROM t""",
)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact duplicates among all documents."""
    found = exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"), all_digests=True)
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


@_query(
    "op10_decontaminate",
    f"""
WITH words AS (
  SELECT item_id, regexp_extract_all({_LOWER.format("text")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM (SELECT item_id, coalesce(text, '') AS text FROM benchmark)),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS width,
         array_to_string(list_slice(w, k, k + least(len(w), 10) - 1), ' ') AS gram
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM words WHERE len(w) > 0)),
docs AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format("text")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)),
places AS (
  SELECT doc_id, width, k, array_to_string(list_slice(w, k, k + width - 1), ' ') AS gram
  FROM (SELECT doc_id, w, width, unnest(range(1, len(w) - width + 2)) AS k
        FROM docs, (SELECT DISTINCT width FROM windows) WHERE len(w) >= width)),
found AS (SELECT doc_id, width, k, item_id FROM places JOIN windows USING (width, gram)),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit
         FROM (SELECT doc_id, unnest(range(k, k + width)) AS p FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)""",
)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages in all documents."""
    found = decontaminate.find_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


@_query("op7_token_counts")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of all documents in a byte-level vocabulary."""
    found = token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


@_query("op8_bpe")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded with a word-end vocabulary, and decoded again."""
    path = public_tokenizers.path("word_bpe_49k.json")
    decoded = bpe.encode(table(spark, sf_dir, "documents"), path, and_decode=True)
    return decoded.select(
        F.col("id").alias("doc_id"),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )


@_query(
    "op4_warc",
    """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha1(html) AS payload_digest,
             max(page_id) OVER (PARTITION BY html) AS owner FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND owner <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND owner <> page_id THEN owner END AS refers_to
FROM d""",
)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as an archive and read back."""
    path = shared_path(spark, "archive")
    warc.write_archive(table(spark, sf_dir, "pages"), path, "2024-01-01T00:00:00Z")
    back = warc.reconstructed(warc.read_archive(spark, path))
    size = F.octet_length("payload").cast("long").alias("payload_bytes")
    return back.select("page_id", size, F.sha1("payload").alias("payload_digest"), "record_type", "refers_to")


@_query("op6_language_id")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents, learned from four fifths of the labelled ones."""
    docs = table(spark, sf_dir, "documents")
    out = language_id.held_out("doc_id", 5, 0)
    found = language_id.predict(docs, language_id.fit(docs.where(~out)))
    return found.select(F.col("id").alias("doc_id"), "lang_pred", "score").withColumn("held_out", out)


@_query("op9_quality")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of all documents, learned from two thirds of the labels."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = language_id.held_out("doc_id", 3, 1)
    found = quality.score(docs, quality.fit(docs, labels.where(~out)))
    return found.select(F.col("id").alias("doc_id"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")).withColumn("held_out", out)


@_query("op3_near_dedup")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near duplicates among all documents."""
    found = near_dedup.near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", (F.col("id").eqNullSafe(F.col("component_id"))).alias("kept"))


@_query("op2_chat_format")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one whose texts hold control strings, formatted and read back."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = r"\### Assistant: </turn> ok"
    extra = [(-7, 0, "user", text), (-7, 1, "assistant", text)]
    formatted = chat_format.format_conversations(turns.union(spark.createDataFrame(extra, turns.schema)))
    return chat_format.sum_up(formatted)


@_query("op5_license_scan", license_scan.oracle())
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of all documents, laid out as files. Runs of lines, sentences and SPDX tags, which the SQL does not read, are read too."""
    files = license_scan.document_paths(table(spark, sf_dir, "documents"))
    return license_scan.scan_licences(files).join(files.select("doc_id", "path"), "path")


@_query(
    "op11_prefix_trie",
    f"""
WITH {_CRC_TABLE},
turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT conv_id, count(*) AS n FROM turns GROUP BY conv_id),
ids AS (SELECT conv_id, conv_id - conv_id % 100 AS donor, {_CRC.format("CAST(conv_id AS VARCHAR)")} % 6 AS h FROM convs, crc),
rebuilt AS (
  SELECT ids.conv_id, k AS depth, role, text FROM ids JOIN turns ON turns.conv_id = donor AND k <= h
  UNION ALL
  SELECT conv_id, k - h + least(h, coalesce(convs.n, 0)), role, text
  FROM ids JOIN turns USING (conv_id) LEFT JOIN convs ON convs.conv_id = donor WHERE k > h),
paths AS (
  SELECT conv_id, depth, length(text) AS chars,
         sha256(string_agg(sha256(length(role) || ':' || role || text), ',') OVER (PARTITION BY conv_id ORDER BY depth)) AS node FROM rebuilt
  UNION ALL SELECT conv_id, 0, 0, '' FROM convs),
steps AS (SELECT *, lag(node) OVER (PARTITION BY conv_id ORDER BY depth) AS up, max(depth) OVER (PARTITION BY conv_id) AS deepest FROM paths),
nodes AS (SELECT node, any_value(depth) AS depth, any_value(chars) AS chars, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n FROM steps GROUP BY node),
children AS (SELECT up AS node, count(*) AS n_children FROM nodes GROUP BY up),
counted AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN children USING (node)),
sums AS (
  SELECT steps.node, sum(CAST(n_children = 0 AS INTEGER)) AS n_leaves, sum((n - 1) * v.chars) AS saved
  FROM counted AS v JOIN steps ON steps.conv_id = v.conv_id AND steps.depth <= v.depth GROUP BY steps.node),
ends AS (SELECT node, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids FROM steps WHERE depth = deepest GROUP BY node)
SELECT c.conv_id, c.depth, parents.conv_id AS parent_conv_id, c.n AS n_convs, c.n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
       CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM counted AS c JOIN sums USING (node) LEFT JOIN nodes AS parents ON parents.node = c.up LEFT JOIN ends ON ends.node = c.node""",
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, begun as the contract has it, as a trie."""
    numbered = written(prefix_trie.numbered_turns(table(spark, sf_dir, "conversations")), "numbered")
    nodes = prefix_trie.trie(*prefix_trie.rebuilt(numbered))
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), "ends_sha256")


@_query("op12_packing")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1024 tokens."""
    packed = packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return packed.select(F.col("id").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@_query(
    "op13_resampling",
    f"""
WITH {_CRC_TABLE},
doc_words AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
item_words AS (
  SELECT unnest(regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS word FROM benchmark),
places AS (SELECT doc_id, unnest(w) AS word FROM doc_words),
vocabulary AS (
  SELECT word, {_CRC.format("word")} % 10000 AS bucket
  FROM (SELECT word FROM places UNION SELECT word FROM item_words), crc),
s AS (SELECT bucket, count(*) AS s FROM places JOIN vocabulary USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM item_words JOIN vocabulary USING (word) GROUP BY bucket),
gains AS (
  SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM places) + 10000)::DOUBLE
                 / ((s + 1)::DOUBLE * ((SELECT count(*) FROM item_words) + 10000)::DOUBLE))) AS BIGINT) AS gain
  FROM s LEFT JOIN t USING (bucket)),
weights AS (SELECT doc_id, CAST(sum(gain) AS BIGINT) AS weight FROM places JOIN vocabulary USING (word) JOIN gains USING (bucket) GROUP BY doc_id),
scored AS (
  SELECT doc_id, len(w) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) + 0.5::DOUBLE)
                                                 / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM doc_words LEFT JOIN weights USING (doc_id)),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * n // 100 THEN place END AS rank FROM scored LEFT JOIN ranked USING (doc_id)""",
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of all documents drawn towards the benchmark."""
    found = resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")
