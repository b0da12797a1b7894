"""Free category text to the directory's own names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medialog.functions import taxonomy


# Parts two texts; for matching it is a space.
_UNIT = "\x1f"


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def match_category(df: DataFrame, column: str) -> DataFrame:
    """Add category and subcategory; both NULL when nothing is recognised.

    Order: the whole text as a category, then as a subcategory; then as a path: head and tail
    as a pair, any part as a subcategory, any part as a category. The whole job is one narrow
    pass over the rows.
    """
    text = F.translate(F.trim(F.col(column)), _UNIT, " ")
    # Separators are recognised before decomposition, so parts are split first.
    parts_text = F.array_join(
        F.filter(F.transform(F.split(text, taxonomy.PATH_SEPARATOR), lambda p: F.trim(p)), lambda p: p != ""), "\n"
    )
    # Whole text and parts are decomposed together, as that leaves Spark.
    pieces = F.split(taxonomy.decomposed(F.concat(text, F.lit(_UNIT), parts_text)), _UNIT)
    keyed = df.withColumn("__pieces", pieces).withColumns(
        {
            "__whole": taxonomy.fold(F.get("__pieces", F.lit(0))),
            "__parts": F.transform(F.split(F.get("__pieces", F.lit(1)), "\n"), lambda p: taxonomy.fold(p)),
        }
    )
    names = _map(taxonomy.category_names())
    parents = taxonomy.subcategory_parents()
    parent_of = _map({k: v[0] for k, v in parents.items()})
    child_of = _map({k: v[1] for k, v in parents.items()})

    def pair(category: Column, subcategory: Column | None = None) -> Column:
        child = F.lit(None) if subcategory is None else subcategory
        return F.struct(category.alias("category"), child.cast("string").alias("subcategory"))

    def first_known(known: Column) -> Column:
        return F.try_element_at(F.filter(parts, lambda p: F.try_element_at(known, p).isNotNull()), F.lit(1))

    whole, parts = F.col("__whole"), F.col("__parts")
    is_path = F.size(parts) >= 2
    head, tail = F.try_element_at(names, F.get(parts, F.lit(0))), F.element_at(parts, -1)
    child, name = first_known(child_of), first_known(names)
    match = (
        F.when(F.try_element_at(names, whole).isNotNull(), pair(F.try_element_at(names, whole)))
        .when(
            F.try_element_at(child_of, whole).isNotNull(),
            pair(F.try_element_at(parent_of, whole), F.try_element_at(child_of, whole)),
        )
        .when(is_path & (F.try_element_at(parent_of, tail) == head), pair(head, F.try_element_at(child_of, tail)))
        .when(is_path & child.isNotNull(), pair(F.try_element_at(parent_of, child), F.try_element_at(child_of, child)))
        .when(is_path & name.isNotNull(), pair(F.try_element_at(names, name)))
    )
    out = keyed.withColumn("__match", match)
    return out.select(
        *df.columns, F.col("__match.category").alias("category"), F.col("__match.subcategory").alias("subcategory")
    )
