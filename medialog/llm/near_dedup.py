"""Near duplicates by b-bit MinHash.

A text is the set of its runs of words. Texts with equal sets form a class, and only classes are
compared. A class has the least values of a number of hash functions over its set; bands of them
give candidates, and their low bits, packed, an estimate of similarity, corrected for equality by chance.
Pairs whose estimate is not far below the threshold are confirmed on the whole sets.

A bucket of a band may hold very many classes, so not all its pairs are looked at:

1. Each member is compared with one of the bucket, that of the most rows, in a crowded bucket that which the most
   others meet. Confirmed links make
   components.
2. What is left are pairs of different components. Members that meet the same such centre are a group:
   those outside its largest component are compared with all others, in pairs of blocks of bounded size,
   first by estimate. Of those that pass the sets are fetched, once a pair, and all overlaps counted.

So every pair that shares a bucket is confirmed, ruled out by its estimate, or already linked through
others; no pair is left out for the size of its bucket. At the threshold a pair shares no bucket, or
is ruled out wrongly, about once in 10^9. A class is named by 64 bits of its set's digest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medialog.llm.common import as_bytes, bit_filter, forget_tables, passes, pick_rows, prepared, row_hash, written
from medialog.llm.components import components
from medialog.llm.shingles import Bands, band_hashes, estimates, minima, packed, set_digest, shingle_set, word_hashes

# Members from which on a bucket is crowded.
CROWDED = 64
# Members of a group in a block whose sets are compared, and bytes of their sets, about.
BLOCK = 512
BLOCK_BYTES = 32 << 20
# Members of a group in a block that is compared by estimates.
SIGNED_BLOCK = 4096


def _class(shingles: np.ndarray) -> int:
    return int.from_bytes(set_digest(shingles)[:8], "big", signed=True)


def _sign(size: int, bands: Bands):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_tables()
        for batch in batches:
            sets = [shingle_set(w, size) for w in word_hashes(as_bytes(batch.column("text")))]
            full = [s for s in sets if len(s)]
            low = minima(full, bands.hashes)
            names = iter(zip([_class(s) for s in full], band_hashes(low, bands).tolist(), packed(low, bands), strict=True))
            rows = [next(names) if len(s) else (None, None, None) for s in sets]
            yield pa.record_batch(
                [
                    *[batch.column(c) for c in ("id", "row", "key")],
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([r[0] for r in rows], pa.int64()),
                    pa.array([r[1] for r in rows], pa.list_(pa.int64())),
                    pa.array([None if r[2] is None else r[2].tobytes() for r in rows], pa.binary()),
                ],
                ["id", "row", "key", "n_shingles", "class", "bands", "signature"],
            )

    return run


def _sets(size: int, bits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_tables()
        known = bits.value
        for batch in batches:
            batch = batch.filter(pa.array(passes(known, batch.column("key").to_numpy())))
            if batch.num_rows:
                sets = [shingle_set(w, size) for w in word_hashes(as_bytes(batch.column("text")))]
                sets = [s for s in sets if len(s)]
                yield pa.record_batch([pa.array([_class(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["class", "set"])

    return run


def _estimate(bands: Bands):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_tables()
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("centre_signature", "signature"))
            yield pa.record_batch([batch.column("centre"), batch.column("class"), pa.array(estimates(a, b, bands))], ["centre", "class", "estimate"])

    return run


def _overlap(a: np.ndarray, b: np.ndarray) -> int:
    place = np.searchsorted(a, b)
    return int((a[np.minimum(place, len(a) - 1)] == b).sum())


def _linked(overlap, a, b, percent: int):
    return 100 * overlap >= percent * (a + b - overlap)


def _confirm(percent: int):
    """Rows come by centre and block, the centre's set first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_tables()
        centre, whole = None, np.empty(0, np.uint64)
        for batch in batches:
            a, b = [], []
            for c, member, data in zip(*(batch.column(x).to_pylist() for x in ("centre", "class", "set")), strict=True):
                one = np.frombuffer(data, np.uint64)
                if c == member:
                    centre, whole = c, one
                elif c == centre and _linked(_overlap(whole, one), len(whole), len(one), percent):
                    a.append(c)
                    b.append(member)
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], dict[str, list]]]:
    """Groups of rows of one centre and block, which come in order."""
    key, rows = None, {}
    for batch in batches:
        columns = {c: batch.column(c).to_pylist() for c in batch.schema.names}
        keys = list(zip(columns["centre"], columns["block"], strict=True))
        start = 0
        for k in range(1, len(keys) + 1):
            if k == len(keys) or keys[k] != keys[start]:
                part = {c: v[start:k] for c, v in columns.items()}
                if keys[start] == key:
                    for c, v in part.items():
                        rows[c] += v
                else:
                    if key is not None:
                        yield key, rows
                    key, rows = keys[start], part
                start = k
    if key is not None:
        yield key, rows


def _others(own: np.ndarray) -> np.ndarray:
    """Places of the rows that those of a pair's first block meet: all, if it is paired with itself."""
    return np.arange(len(own)) if own.all() else np.flatnonzero(~own)


def _flag(bands: Bands):
    """Members that are near one of another component, by their estimates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_tables()
        for (centre, _), rows in _grouped(batches):
            sign = np.frombuffer(b"".join(rows["signature"]), np.uint8).reshape(len(rows["class"]), -1)
            names, parts = np.array(rows["class"]), np.array(rows["component"])
            flagged = np.zeros(len(names), bool)
            own = np.array(rows["own"])
            others = _others(own)
            for s in np.flatnonzero(own):
                near = (parts[others] != parts[s]) & (names[others] != centre) & (names[s] != centre)
                near &= estimates(sign[s][None], sign[others], bands) >= bands.least_estimate
                if near.any():
                    flagged[others[near]] = flagged[s] = True
            found = names[flagged]
            yield pa.record_batch([pa.array(np.full(len(found), centre), pa.int64()), pa.array(found, pa.int64())], ["centre", "class"])

    return run


def _confirm_block(percent: int):
    """Links between components, found on whole sets; one is enough for two components to meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_tables()
        for _, rows in _grouped(batches):
            sets = [np.frombuffer(s, np.uint64) for s in rows["set"]]
            own = np.array(rows["own"])
            others = _others(own)
            _, every = np.unique(np.concatenate(sets), return_inverse=True)
            places = np.split(every, np.cumsum([len(s) for s in sets])[:-1])
            sizes = np.array([len(sets[m]) for m in others])
            starts = np.cumsum([0, *sizes[:-1]])
            place = np.concatenate([places[m] for m in others])
            part = np.array(rows["component"])
            mark = np.zeros(int(every.max()) + 1, bool)
            a, b = [], []
            for s in np.flatnonzero(own):
                if not (part[others] != part[s]).any():
                    continue
                mark[places[s]] = True
                overlap = np.add.reduceat(mark[place], starts, dtype=np.int64)
                mark[places[s]] = False
                for m in others[_linked(overlap, sizes, len(sets[s]), percent)]:
                    if part[m] != part[s]:
                        a.append(rows["class"][s])
                        b.append(rows["class"][m])
                        part[part == part[m]] = part[s]
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def dealt(rows: DataFrame, sizes: DataFrame, most: int, most_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``rows`` (``centre``, ``class``, ``component``, ``largest``) with ``block`` and ``own``, once for each
    pair of blocks they belong to; ``sizes`` has the same rows with their ``bytes``.

    Members outside the largest component, the strays of a group, are dealt into blocks of about ``most`` rows or
    ``most_bytes``, and so are the others. Each block of strays is paired with itself, the later ones and those of
    the largest component; ``own`` are the rows of the first block of a pair. So two members meet
    once, if one is a stray, and no pair holds more than two blocks.
    """
    stray = F.col("component") != F.col("largest")

    def blocks(of: Column) -> Column:
        n, size = F.count_if(of), F.coalesce(F.sum(F.when(of, F.col("bytes"))), F.lit(0))
        return F.ceil(F.greatest(n / most, size / most_bytes, F.lit(1.0))).cast("long")

    groups = sizes.groupBy("centre").agg(blocks(stray).alias("strays"), blocks(~stray).alias("rest"))
    hashed = F.xxhash64("class")
    at = F.when(stray, F.pmod(hashed, F.col("strays"))).otherwise(F.col("strays") + F.pmod(hashed, F.col("rest")))
    spread = rows.join(groups, "centre").withColumn("at", at).withColumn("all", F.col("strays") + F.col("rest"))
    # Blocks of strays come first, so a row is second to those of strays before its own.
    last = F.least("at", "strays") - 1
    second = F.when(last >= 0, F.sequence(F.lit(0).cast("long"), last)).otherwise(F.array().cast("array<bigint>"))
    first = F.when(stray, F.sequence(F.col("at"), F.col("all") - 1)).otherwise(F.array().cast("array<bigint>"))
    pairs = F.concat(
        F.transform(first, lambda t: F.struct((F.col("at") * F.col("all") + t).alias("block"), F.lit(True).alias("own"))),
        F.transform(second, lambda b: F.struct((b * F.col("all") + F.col("at")).alias("block"), F.lit(False).alias("own"))),
    )
    return spread.withColumn("pair", F.explode(pairs)).select(*rows.columns, "pair.block", "pair.own")


def _centres(in_band: DataFrame) -> DataFrame:
    """``band``, ``centre`` for each bucket of several classes of ``in_band`` (``class``, ``rows``, ``band``).

    Each bucket could have any of its members. Where many classes are alike they share many buckets; if
    each of these had a centre of its own, all would be compared with all of them. So a crowded bucket takes that of its
    members which the most others meet over all crowded buckets: mostly the same one.
    """
    tops = in_band.groupBy("band").agg(F.max(F.struct("rows", "class")).alias("top"), F.count("*").alias("n")).where("n > 1")
    tops = written(tops.select("band", F.col("top.class").alias("centre"), "n"), "near-tops")
    # Mostly few: written, they are known to be small, and the other buckets' members need not move.
    crowded = written(tops.where(F.col("n") >= CROWDED).select("band", "n"), "near-crowded")
    inside = in_band.join(crowded, "band")
    weights = written(inside.groupBy("class").agg(F.sum("n").alias("weight")), "near-weights")
    chosen = inside.join(weights, "class").groupBy("band").agg(F.max(F.struct("weight", "rows", "class")).alias("best"))
    chosen = written(chosen.select("band", F.col("best.class").alias("chosen")), "near-chosen")
    return tops.join(chosen, "band", "left").select("band", F.coalesce("chosen", "centre").alias("centre"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """A row per row of ``docs``: ``id``, ``row`` (hash of the text), ``n_shingles``, ``component_id``, ``kept``.

    Texts are linked whose sets of runs of ``words`` words (white space apart, A-Z as a-z; a shorter
    text is one run) have an intersection of ``percent`` per cent of their union or more.
    ``component_id`` is the least id that links reach, a null id last; the row that has it is kept.

    Null, empty and blank texts have no runs, are linked with nothing, and are kept. Rows
    repeated with id and text share their decision. An empty table gives no rows.
    """
    spark = prepared(docs.sparkSession)
    bands = Bands(percent / 100)
    key = F.xxhash64(F.col(id_col).cast("string"), F.col(text_col).cast("string"))
    texts = docs.select(F.col(id_col).alias("id"), row_hash(text_col).alias("row"), key.alias("key"), F.col(text_col).cast("string").alias("text"))
    id_type = texts.schema["id"].dataType.simpleString()
    signed = written(
        texts.mapInArrow(_sign(words, bands), f"id {id_type}, row long, key long, n_shingles long, class long, bands array<long>, signature binary"),
        "near-signed",
    )
    rank = F.struct(F.col("id").isNull().alias("none"), "id", "row", "key")
    classes = written(
        signed.where("class IS NOT NULL")
        .groupBy("class")
        .agg(F.count("*").alias("rows"), F.min(rank).alias("best"), F.first("bands").alias("bands"), F.first("signature").alias("signature")),
        "near-classes",
    )

    in_band = classes.select("class", "rows", F.explode("bands").alias("band"))
    centres = _centres(in_band)
    meets = in_band.join(centres, "band").where("class <> centre").select("centre", "class").distinct()
    signatures = classes.select("class", "signature")
    stars = written(
        meets.join(signatures, "class")
        .join(signatures.toDF("centre", "centre_signature"), "centre")
        .mapInArrow(_estimate(bands), "centre long, class long, estimate double"),
        "near-stars",
    )

    def sets_of(names: DataFrame) -> DataFrame:
        """``class``, ``set`` of named classes, from the texts of one row of each."""
        keys = classes.join(names, "class", "left_semi").select(F.col("best.key").alias("key"))
        bits = spark.sparkContext.broadcast(bit_filter(keys, "key"))
        found = texts.select("key", "text").mapInArrow(_sets(words, bits), "class long, set binary")
        return written(found.groupBy("class").agg(F.first("set").alias("set")), "near-sets")

    close = stars.where(F.col("estimate") >= bands.least_estimate).select("centre", "class")
    sets = sets_of(close.select("class").union(close.select("centre")).distinct())
    blocks = close.groupBy("centre").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    members = close.join(sets, "class").join(blocks, "centre").select("centre", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int").alias("block"), "class", "set")
    heads = blocks.join(sets.withColumnRenamed("class", "centre"), "centre").select("centre", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("centre").alias("class"), "set")
    parallel = spark.sparkContext.defaultParallelism * 4
    first_links = written(
        members.union(heads)
        .repartition(parallel, "centre", "block")
        .sortWithinPartitions("centre", "block", F.col("class") != F.col("centre"))
        .select("centre", "class", "set")
        .mapInArrow(_confirm(percent), "a long, b long"),
        "near-links",
    )
    first = components(first_links)

    # Groups: a centre and those that meet it, where these are of more than one component.
    met = stars.select("centre", "class").union(stars.select("centre", F.col("centre").alias("class")).distinct())
    placed = met.join(first.toDF("class", "root"), "class", "left").select("centre", "class", F.coalesce("root", "class").alias("component"))
    shares = placed.groupBy("centre", "component").agg(F.count("*").alias("n"))
    mixed = shares.groupBy("centre").agg(F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("all"), F.count("*").alias("parts")).where("parts > 1 AND all > 2")
    members = placed.join(mixed.select("centre", F.col("top.component").alias("largest")), "centre")

    def in_order(rows: DataFrame) -> DataFrame:
        return rows.repartition(parallel, "centre", "block").sortWithinPartitions("centre", "block")

    flags = written(
        in_order(dealt(members.join(signatures, "class"), members.withColumn("bytes", F.lit(0)), SIGNED_BLOCK))
        .select("centre", "block", "class", "component", "own", "signature")
        .mapInArrow(_flag(bands), "centre long, class long")
        .distinct(),
        "near-flags",
    )
    named = flags.select("class").distinct()
    more = sets.join(named, "class", "left_semi").unionByName(sets_of(named.join(sets, "class", "left_anti")))
    flagged = members.join(flags, ["centre", "class"], "left_semi")
    second_links = (
        in_order(dealt(flagged.join(more, "class"), flagged.join(more.select("class", F.octet_length("set").alias("bytes")), "class"), BLOCK))
        .select("centre", "block", "class", "component", "own", "set")
        .mapInArrow(_confirm_block(percent), "a long, b long")
    )
    roots = components(first_links.union(second_links)).toDF("class", "root")

    joined = classes.select("class", "rows", "best").join(roots, "class", "left").withColumn("root", F.coalesce("root", "class"))
    linked = joined.join(roots.select("root").distinct(), "root", "left_semi")
    best = linked.groupBy("root").agg(F.min("best").alias("best"))
    decided = linked.select("class", "root").join(best, "root").select("class", "best")
    alike = joined.join(roots.select("root").distinct(), "root", "left_anti").where("rows > 1").select("class", "best")
    out = signed.select("id", "row", "n_shingles", "class").join(decided.union(alike), "class", "left")
    lone = F.col("best").isNull()
    return out.select(
        "id",
        "row",
        "n_shingles",
        F.when(lone, F.col("id")).otherwise(F.col("best.id")).alias("component_id"),
        (lone | F.col("id").eqNullSafe(F.col("best.id")) & (F.col("row") == F.col("best.row"))).alias("kept"),
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns; rows repeated with id and text once."""
    kept = near_duplicates(docs, id_col, text_col, words, percent).where("kept").select("id", "row")
    return pick_rows(docs, kept, id_col, text_col)
