"""Connected components of a graph given by its edges, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medialog.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``root`` for all nodes of ``edges`` (``a``, ``b``) but the roots, the least of their component.

    A large star links the larger neighbours of each node to its least one, a small star the
    smaller ones and itself; the number of rounds grows with the logarithm of the longest path.
    Only edges move, minima are combined in each task first, and each round ends in a written
    table. Loops and repeated edges do no harm.
    """
    now = written(edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).where("u < v").distinct(), "edges")
    state = None
    while True:
        both = now.select("v", "u").union(now.select("u", "v")).toDF("node", "other")
        least = both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("m"))
        large = both.where("other > node").join(least, "node").select(F.col("other").alias("v"), F.col("m").alias("u")).where("u < v").distinct()
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v").select(F.explode(F.array(F.struct(F.col("u").alias("v"), F.col("m").alias("u")), F.struct("v", F.col("m").alias("u")))).alias("e"))
        now = written(small.select("e.v", "e.u").where("u < v").distinct(), "edges")
        then = now.agg(F.count("*"), F.expr("bit_xor(xxhash64(v, u))"), F.expr("bit_xor(xxhash64(u, v))")).first()
        if then == state:
            return now.select(F.col("v").alias("node"), F.col("u").alias("root"))
        state = then
