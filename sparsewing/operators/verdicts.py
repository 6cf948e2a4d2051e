"""Whether measured tables meet rules that were stated beforehand. Each rule is a row with what it saw, what of it held, and
``passed``; what cannot be judged (no rows, an undefined correlation) has not passed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def holds(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def within(pairs: DataFrame, by: list[str], tolerance: float) -> DataFrame:
    """(*by, rel, passed): whether ``value`` is within a relative ``tolerance`` of ``base``."""
    rel = F.when(F.col("base") != 0, F.col("value") / F.col("base") - 1)
    return pairs.select(*by, F.round(rel, 9).alias("rel"), holds(F.abs(rel) <= tolerance).alias("passed"))


def law(cells: DataFrame, by: list[str], constant: float, tolerance: float) -> DataFrame:
    """(*by, predicted, error, passed): whether the angle ``theta`` at which codes of a curve with parameter ``t`` have collided by half is
    within ``tolerance`` degrees of constant / t. A curve without such an angle (null) has not passed."""
    predicted = F.when(F.col("t") > 0, constant / F.col("t"))
    error = F.col("theta") - predicted
    return cells.select(*by, F.round(predicted, 6).alias("predicted"), F.round(error, 6).alias("error"), holds(F.abs(error) < tolerance).alias("passed"))


def fan_in(rows: DataFrame, by: list[str], spearman_most: float = -0.9, low_most: int = 5, low_deficit: float = 0.10, high_factor: float = 1.0, high_deficit: float = 0.05) -> DataFrame:
    """Whether a deficit against dense projections falls with the number of inputs ``s``: (*by, s, deficit, d_eff) to (*by, spearman,
    falls, low, high, contradictory, passed). The rank correlation must be at most ``spearman_most``, every deficit up to ``low_most`` inputs
    above ``low_deficit``, and every one from ``high_factor`` * d_eff inputs below ``high_deficit``, with at least one of each.
    ``contradictory`` counts numbers of inputs that fall under both, with which the rule cannot be met."""
    group = Window.partitionBy(*by)

    def rank(c: str) -> Column:  # the mean place of equal values; a group holds one row for each number of inputs
        return F.rank().over(group.orderBy(c)) + (F.count("*").over(Window.partitionBy(*by, c)) - 1) / 2

    low, high = F.col("s") <= low_most, F.col("s") >= high_factor * F.col("d_eff")
    r = rows.withColumns({"rs": rank("s"), "rd": rank("deficit")})
    g = r.groupBy(*by).agg(
        F.when((F.stddev_pop("rs") > 0) & (F.stddev_pop("rd") > 0), F.covar_pop("rs", "rd") / (F.stddev_pop("rs") * F.stddev_pop("rd"))).alias("rho"),
        F.every(F.when(low, F.col("deficit") > low_deficit)).alias("low"), F.every(F.when(high, F.col("deficit") < high_deficit)).alias("high"),
        F.count_if(low & high).alias("contradictory"),
    )
    falls = holds(F.round("rho", 9) <= spearman_most)
    return g.select(*by, F.round("rho", 9).alias("spearman"), falls.alias("falls"), holds(F.col("low")).alias("low"), holds(F.col("high")).alias("high"), "contradictory", (falls & holds(F.col("low")) & holds(F.col("high"))).alias("passed"))


def enough(judged: DataFrame, by: list[str], share: float) -> DataFrame:
    """(*by, cells, held, passed): whether at least a ``share`` of the judged rows passed."""
    g = judged.groupBy(*by).agg(F.count("*").alias("cells"), F.count_if("passed").alias("held"))
    return g.withColumn("passed", F.col("held") >= share * F.col("cells"))
