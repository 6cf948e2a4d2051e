"""Revisions laid over a table: keyed updates with precedence, refusal of what they cannot mean, and their history.

A revision is a name and a table of the keys and some of the base's other columns; null says nothing about a field. Later
revisions take precedence, field by field. A key that the base does not have, a key that a revision names twice, or a column
that the base does not have is an error, the first two when the result is computed. Rows are joined and grouped on the keys once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _stacked(base: DataFrame, revisions: list[tuple[str, DataFrame]], keys: list[str]) -> DataFrame:
    """(keys, _at, _name, fields): all revisions, null where one says nothing."""
    fields, out = [c for c in base.columns if c not in keys], None
    types = {f.name: f.dataType for f in base.schema.fields}
    for at, (name, r) in enumerate(revisions):
        if more := set(r.columns) - set(base.columns):
            raise ValueError(f"revision {name}: the table has no column {', '.join(sorted(more))}")
        if missing := set(keys) - set(r.columns):
            raise ValueError(f"revision {name} lacks the key {', '.join(sorted(missing))}")
        x = r.select(*keys, F.lit(at).alias("_at"), F.lit(name).alias("_name"), *[(F.col(c) if c in r.columns else F.lit(None)).cast(types[c]).alias(c) for c in fields])
        out = x if out is None else out.unionByName(x)
    if out is None:
        raise ValueError("no revisions")
    return out


def _key_text(keys: list[str]) -> Column:
    return F.to_json(F.struct(*keys))


def overlay(base: DataFrame, revisions: list[tuple[str, DataFrame]], keys: list[str]) -> DataFrame:
    """``base`` with the revisions applied and ``revised_by``, the names of those that said something, in order."""
    fields = [c for c in base.columns if c not in keys]
    g = _stacked(base, revisions, keys).groupBy(*keys).agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_at"))).alias(f"_{c}") for c in fields],
        F.array_sort(F.collect_list(F.when(F.coalesce(*[F.col(c).cast("string") for c in fields]).isNotNull(), F.struct("_at", "_name")))).alias("_said"),
        (F.count("*") > F.count_distinct("_at")).alias("_twice"),
    )
    b, known = base.withColumn("_known", F.lit(True)), F.col("_known").isNotNull()
    x = b.join(g, keys, "full_outer")
    bad = F.when(~known, F.concat(F.lit("unknown key "), _key_text(keys))).when(F.col("_twice"), F.concat(F.lit("key revised twice at once "), _key_text(keys)))
    kept = [F.coalesce(f"_{c}", c).alias(c) for c in fields]
    x = x.withColumn("_bad", F.when(bad.isNotNull(), F.raise_error(bad).cast("boolean")).otherwise(F.lit(False)))
    names = F.transform(F.coalesce("_said", F.array()), lambda s: s["_name"])
    return x.filter(~F.col("_bad")).select(*keys, *kept, names.alias("revised_by"))


def history(base: DataFrame, revisions: list[tuple[str, DataFrame]], keys: list[str]) -> DataFrame:
    """(keys, field, step, revision, was, now): every change of a field in order, as text; a revision that repeats what stands is
    no change."""
    fields = [c for c in base.columns if c not in keys]
    text = lambda x: x.select(*keys, "_at", "_name", *[F.col(c).cast("string").alias(c) for c in fields])
    rows = text(base.select("*", F.lit(-1).alias("_at"), F.lit("").alias("_name"))).unionByName(text(_stacked(base, revisions, keys)))
    long = rows.unpivot([*keys, "_at", "_name"], fields, "field", "now").filter((F.col("_at") < 0) | F.col("now").isNotNull())
    o = Window.partitionBy(*keys, "field").orderBy("_at")
    moved = long.withColumn("was", F.lag("now").over(o)).filter((F.col("_at") >= 0) & ~F.col("was").eqNullSafe(F.col("now")))
    return moved.select(*keys, "field", F.row_number().over(o).cast("bigint").alias("step"), F.col("_name").alias("revision"), "was", "now")
