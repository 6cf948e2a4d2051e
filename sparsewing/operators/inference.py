"""Randomization tests, corrections, intervals and comparisons over tidy score tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparsewing.functions import rng
from sparsewing.operators import order


def randomization(real: DataFrame, null: DataFrame, keys: list[str]) -> DataFrame:
    """One real value and many null values per key: corrected one-sided and two-sided shares, mean, deviation, z, relative gap."""
    j = null.join(real.select(*keys, F.col("value").alias("real")), keys)
    g = j.groupBy(*keys).agg(F.first("real").alias("real"), F.count("*").alias("n"), F.count_if(F.col("value") >= F.col("real")).alias("ge"), F.count_if(F.col("value") <= F.col("real")).alias("le"), F.avg("value").alias("m"), F.stddev_samp("value").alias("sd"))
    up, lo = (1 + F.col("ge")) / (1 + F.col("n")), (1 + F.col("le")) / (1 + F.col("n"))
    return g.select(*keys, F.round(up, 9).alias("p_upper"), F.round(lo, 9).alias("p_lower"), F.round(F.least(F.lit(1.0), 2 * F.least(up, lo)), 9).alias("p_two"), F.round("m", 9).alias("null_mean"), F.round("sd", 9).alias("null_sd"), F.round(F.when(F.col("sd") > 0, (F.col("real") - F.col("m")) / F.col("sd")), 6).alias("z"), F.round(F.when(F.col("m") != 0, F.col("real") / F.col("m") - 1), 9).alias("rel"))


def holm(p: DataFrame, family: list[str], key: str) -> DataFrame:
    """Step-down correction: running maximum of (m - rank + 1) * p in order of p."""
    w = Window.partitionBy(*family)
    o = w.orderBy("p", key)
    x = p.withColumns({"m": F.count("*").over(w), "r": F.row_number().over(o)}).withColumn("a", (F.col("m") - F.col("r") + 1) * F.col("p"))
    return x.select(*family, key, "p", F.round(F.least(F.lit(1.0), F.max("a").over(o.rowsBetween(Window.unboundedPreceding, 0))), 9).alias("adjusted"))


def shift_power(null: DataFrame, keys: list[str], shifts: list[float], alpha: float = 0.05) -> DataFrame:
    """Share of null draws that, shifted, would be significant against the other draws of their key. A draw's ranks come
    from one sort per key and shift, never from pairs."""
    n = null.select(*keys, "draw", "value")
    s = n.withColumn("shift", F.explode(F.array(*[F.lit(float(x)) for x in shifts])))
    moved = s.select(*keys, "shift", "draw", F.round(F.col("value") * (1 + F.col("shift")), 12).alias("x"), F.col("value").alias("own"), F.lit(1).alias("probe"))
    still = s.select(*keys, "shift", F.lit(None).cast("bigint").alias("draw"), F.round("value", 12).alias("x"), F.lit(0.0).alias("own"), F.lit(0).alias("probe"))
    both = moved.unionByName(still)
    w = Window.partitionBy(*keys, "shift")
    ref = F.when(F.col("probe") == 0, 1).otherwise(0)
    le = F.sum(ref).over(w.orderBy("x").rangeBetween(Window.unboundedPreceding, 0))
    ge = F.sum(ref).over(w.orderBy(F.col("x").desc()).rangeBetween(Window.unboundedPreceding, 0))
    c = both.withColumns({"le": le, "ge": ge, "n": F.sum(ref).over(w)}).filter("probe = 1")
    own = F.round("own", 12)  # the draw itself stands among the others and is taken out
    up, lo = F.col("ge") - F.when(own >= F.col("x"), 1).otherwise(0), F.col("le") - F.when(own <= F.col("x"), 1).otherwise(0)
    p = F.least(F.lit(1.0), 2 * F.least((1 + up) / F.col("n"), (1 + lo) / F.col("n")))
    return c.groupBy(*keys, "shift").agg(F.round(F.avg(F.when(p <= alpha, 1.0).otherwise(0.0)), 9).alias("power"))


def smallest_shift(power: DataFrame, keys: list[str], level: float = 0.8) -> DataFrame:
    x = power.filter(F.col("power") >= level)
    return x.groupBy(*keys).agg(F.min(F.when(F.col("shift") > 0, F.col("shift"))).alias("up"), F.max(F.when(F.col("shift") < 0, F.col("shift"))).alias("down"), F.min_by("shift", F.struct(F.abs("shift"), "shift")).alias("smallest"))


def resamples(spark, draws: int, n: int, seed: int) -> DataFrame:
    """(draw, slot, pos): n positions with replacement for each draw."""
    return spark.range(draws).select(F.col("id").alias("draw"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))).alias("slot")).withColumn("pos", rng.integer(n, "boot", seed, "draw", "slot"))


def contrast_bootstrap(a: DataFrame, b: DataFrame, draws: int, n: int, seed: int) -> DataFrame:
    """Percent gap of the means of two paired score tables (trial 0..n-1, value), with the middle 95% over resampled trials."""
    p = a.select(F.col("trial"), F.col("value").alias("a")).join(b.select("trial", F.col("value").alias("b")), "trial")
    r = resamples(a.sparkSession, draws, n, seed).join(p, F.col("pos") == F.col("trial")).groupBy("draw").agg((100 * (F.avg("a") / F.avg("b") - 1)).alias("gap"))
    q = r.agg(F.expr("percentile(gap, array(0.025, 0.975))").alias("q"))
    return p.agg((100 * (F.avg("a") / F.avg("b") - 1)).alias("gap")).crossJoin(q).select(F.round("gap", 6).alias("gap"), F.round(F.col("q")[0], 6).alias("low"), F.round(F.col("q")[1], 6).alias("high"))


def ratio_to_best(own: DataFrame, rivals: DataFrame, draws: int, n: int, seed: int) -> DataFrame:
    """Ratio of a method's mean to the best rival's, the best rival taken anew in every resample. rivals: (arm, trial, value)."""
    both = own.select(F.lit("").alias("arm"), "trial", "value").unionByName(rivals.select("arm", "trial", "value"))
    m = resamples(own.sparkSession, draws, n, seed).join(both, F.col("pos") == F.col("trial")).groupBy("draw", "arm").agg(F.avg("value").alias("m"))
    r = m.groupBy("draw").agg((F.max(F.when(F.col("arm") == "", F.col("m"))) / F.max(F.when(F.col("arm") != "", F.col("m")))).alias("ratio"))
    point = both.groupBy("arm").agg(F.avg("value").alias("m")).agg((F.max(F.when(F.col("arm") == "", F.col("m"))) / F.max(F.when(F.col("arm") != "", F.col("m")))).alias("ratio0"))
    return point.crossJoin(r.agg(F.expr("percentile(ratio, array(0.025, 0.975))").alias("q"))).select(F.round("ratio0", 9).alias("ratio"), F.round(F.col("q")[0], 9).alias("low"), F.round(F.col("q")[1], 9).alias("high"))


def equivalence(intervals: DataFrame, margin: float) -> DataFrame:
    return intervals.withColumn("equivalent", (F.col("low") > -margin) & (F.col("high") < margin))


def wilson(counts: DataFrame, z: float) -> DataFrame:
    """(k, n) to the interval of the share."""
    p, n = F.col("k") / F.col("n"), F.col("n")
    d = 1 + z * z / n
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / d
    mid = (p + z * z / (2 * n)) / d
    return counts.withColumns({"low": F.round(mid - half, 9), "high": F.round(mid + half, 9)})


#: Different combinations of costs and quality that every task may hold.
MOST_METHODS = 100_000


def pareto(methods: DataFrame, costs: list[str], quality: str) -> DataFrame:
    """Rows that no other row dominates: nowhere dearer, not worse, and better in something. Rows alike in all of these stand or
    fall together, so each combination is compared once, and only the best quality at given costs can dominate; there may be
    MOST_METHODS of those."""
    best = methods.groupBy(*costs).agg(F.max(quality).alias(quality))
    if best.limit(MOST_METHODS + 1).count() > MOST_METHODS:
        raise ValueError(f"more than {MOST_METHODS} combinations of costs")
    o = best.select(*[F.col(c).alias(f"o_{c}") for c in [*costs, quality]])
    cond = F.col(f"o_{quality}") >= F.col(quality)
    better = F.col(f"o_{quality}") > F.col(quality)
    for c in costs:
        cond &= F.col(f"o_{c}") <= F.col(c)
        better |= F.col(f"o_{c}") < F.col(c)
    return methods.join(F.broadcast(o), cond & better, "left_anti")


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Of the mean places of equal values."""
    r = order.average_places(order.average_places(df, x, "rx"), y, "ry")
    return r.agg(F.round(F.corr("rx", "ry"), 9).alias("rho"))


def paired_t(diffs: DataFrame, keys: list[str], t: float) -> DataFrame:
    """Mean difference with half-width t * sd / sqrt(n); ``t`` is the quantile for the number of pairs."""
    g = diffs.groupBy(*keys).agg(F.avg("d").alias("m"), F.stddev_samp("d").alias("sd"), F.count("*").alias("n"))
    half = t * F.col("sd") / F.sqrt("n")
    return g.select(*keys, "n", F.round("m", 9).alias("mean"), F.round(F.col("m") - half, 9).alias("low"), F.round(F.col("m") + half, 9).alias("high"))


def cluster_bootstrap(rows: DataFrame, draws: int, clusters: int, seed: int, level: float = 0.9) -> DataFrame:
    """Interval of mean(real) / mean(base) - 1 over resampled clusters: (cluster 0..clusters-1, real, base). Each cluster is
    summed once; a resample adds cluster sums, not rows."""
    c = rows.groupBy("cluster").agg(F.sum("real").alias("r"), F.sum("base").alias("b"))
    d = resamples(rows.sparkSession, draws, clusters, seed).join(c, F.col("pos") == F.col("cluster")).groupBy("draw").agg((F.sum("r") / F.sum("b") - 1).alias("rel"))
    a = (1 - level) / 2
    q = d.agg(F.expr(f"percentile(rel, array({a!r}, {1 - a!r}))").alias("q"))
    return q.select(F.round(F.col("q")[0], 9).alias("low"), F.round(F.col("q")[1], 9).alias("high"))


def two_stage(real: DataFrame, null: DataFrame, draws: int, n: int, n_null: int, subset: int, seed: int, level: float = 0.9) -> DataFrame:
    """Interval of real against the null mean where each replicate draws the trials anew and a fresh subset of null draws:
    real (trial, value), null (draw, value)."""
    a = resamples(real.sparkSession, draws, n, seed).join(real.withColumnRenamed("value", "v"), F.col("pos") == F.col("trial")).groupBy("draw").agg(F.avg("v").alias("real"))
    slots = resamples(real.sparkSession, draws, n_null, seed + 1).filter(F.col("slot") < subset).select(F.col("draw").alias("rep"), "pos")
    b = slots.join(null, F.col("pos") == F.col("draw")).groupBy("rep").agg(F.avg("value").alias("base"))
    r = a.join(b, F.col("draw") == F.col("rep")).select((F.col("real") / F.col("base") - 1).alias("rel"), (F.col("real") - F.col("base")).alias("gap"))
    x = (1 - level) / 2
    q = r.agg(F.expr(f"percentile(rel, array({x!r}, {1 - x!r}))").alias("r"), F.expr(f"percentile(gap, array({x!r}, {1 - x!r}))").alias("g"))
    return q.select(F.round(F.col("r")[0], 9).alias("rel_low"), F.round(F.col("r")[1], 9).alias("rel_high"), F.round(F.col("g")[0], 4).alias("low"), F.round(F.col("g")[1], 4).alias("high"))


def resampled_sums(scores: DataFrame, weights: DataFrame, keys: list[str]) -> DataFrame:
    """(rep, *keys, total): weighted sums of the trials' values in every replicate. ``scores``: (*keys, trial, value), ``weights``:
    (rep, trial, times). A key's values and a replicate's weights are one array each, in order of the trials, so there is a row
    for a key and a replicate, and none for a trial in them; trials are the stated set that is resampled."""
    own = scores.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("trial", F.col("value").cast("double").alias("value")))).alias("values"))
    times = weights.groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("trial", "times"))).alias("times"))
    total = F.aggregate("times", F.lit(0.0), lambda a, t: a + t["times"] * F.coalesce(F.element_at("values", t["trial"]), F.lit(0.0)))
    return own.crossJoin(F.broadcast(times)).select("rep", *keys, total.alias("total"))  # a row per replicate


def two_stage_by(scores: DataFrame, trials: DataFrame, reps: int, subset: int, by: list[str], seed: int, level: float = 0.9) -> DataFrame:
    """(*by, rel_low, rel_high): the interval of the real wiring's mean against that of the null draws, relative to it, where each
    replicate draws the trials with replacement and a fresh ``subset`` of the null draws without. ``scores``: (*by, draw,
    trial, value), draw -1 being the real one; ``trials``: (trial, pos), pos from 0 on."""
    spark, n = scores.sparkSession, trials.count()
    drawn = spark.range(reps).select(F.col("id").alias("rep"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(n, 1) - 1).cast("long"))).alias("slot"))
    drawn = drawn.withColumn("pos", rng.integer(max(n, 1), "boot", seed, "rep", "slot")).groupBy("rep", "pos").agg(F.count("*").alias("times"))
    weights = drawn.join(F.broadcast(trials), "pos").select("rep", "trial", "times")
    nulls = scores.filter("draw >= 0").select("draw").distinct()
    picked = rng.pick(spark.range(reps).withColumnRenamed("id", "rep").crossJoin(F.broadcast(nulls)), subset, "sub", seed, "draw", within=["rep"])  # replicates by draws
    total = resampled_sums(scores, weights, [*by, "draw"])
    real = total.filter("draw = -1").select("rep", *by, F.col("total").alias("real"))
    base = total.join(F.broadcast(picked), ["rep", "draw"]).groupBy("rep", *by).agg(F.avg("total").alias("base"))
    rel = real.join(base, ["rep", *by]).select(*by, F.when(F.col("base") != 0, F.col("real") / F.col("base") - 1).alias("rel"))
    x = (1 - level) / 2
    return rel.groupBy(*by).agg(F.expr(f"percentile(rel, array({x!r}, {1 - x!r}))").alias("q")).select(*by, F.round(F.col("q")[0], 9).alias("rel_low"), F.round(F.col("q")[1], 9).alias("rel_high"))


def coverage(intervals: DataFrame, truth: float, z: float) -> DataFrame:
    """Share of intervals (low, high) that hold the truth, with its Wilson interval."""
    return wilson(intervals.agg(F.count_if((F.col("low") <= truth) & (F.col("high") >= truth)).alias("k"), F.count("*").alias("n")), z)


def coverage_study(scores: DataFrame, trials: DataFrame, datasets: int, reps: int, subset: int, seed: int, level: float = 0.9, z: float = 1.959964) -> DataFrame:
    """Whether the two-stage interval holds the true relative difference as often as it says, on data sets drawn from the scores
    (draw, trial, value; draw -1 is the real one), which are the population. Each data set draws the trials with replacement;
    each of its replicates draws from those again, and a ``subset`` of the null draws. A draw's values are one array in the order of
    ``trials`` (trial, pos), and a replicate is one array of positions into it, so there is a row for a replicate and
    draw, and none for a trial in it. One row: share of covering intervals, its Wilson interval, the truth, the median width."""
    spark, n = scores.sparkSession, trials.count()
    own = scores.join(F.broadcast(trials), "trial").groupBy("draw").agg(F.map_from_entries(F.collect_list(F.struct("pos", F.col("value").cast("double").alias("value")))).alias("values"))
    at = F.sequence(F.lit(0).cast("long"), F.lit(max(n, 1) - 1).cast("long"))
    value = lambda i: F.coalesce(F.element_at("values", i), F.lit(0.0))
    total = lambda picks: F.aggregate(picks, F.lit(0.0), lambda a, i: a + value(i))
    data = spark.range(datasets).withColumnRenamed("id", "dataset").withColumn("have", F.transform(at, lambda s: rng.integer(max(n, 1), "data", seed, "dataset", s)))
    rows = data.withColumn("rep", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(reps - 1).cast("long"))))
    rows = rows.withColumn("picks", F.transform(at, lambda s: F.get("have", rng.integer(max(n, 1), "boot", seed, "dataset", "rep", s).cast("int")))).select("dataset", "rep", "picks")
    nulls = scores.filter("draw >= 0").select("draw").distinct()
    sub = rng.pick(rows.select("dataset", "rep").crossJoin(F.broadcast(nulls)), subset, "sub", seed, "draw", within=["dataset", "rep"])  # replicates by draws
    drawn = sub.unionByName(rows.select("dataset", "rep", F.lit(-1).cast("long").alias("draw"))).join(F.broadcast(own), "draw").join(rows, ["dataset", "rep"])
    t = drawn.select("dataset", "rep", "draw", total("picks").alias("t"))
    rel = t.groupBy("dataset", "rep").agg((F.max(F.when(F.col("draw") == -1, F.col("t"))) / F.avg(F.when(F.col("draw") >= 0, F.col("t"))) - 1).alias("rel"))
    x = (1 - level) / 2
    spans = rel.groupBy("dataset").agg(F.expr(f"percentile(rel, array({x!r}, {1 - x!r}))").alias("q")).select(F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"))
    truth = own.select("draw", total(at).alias("t")).agg((F.max(F.when(F.col("draw") == -1, F.col("t"))) / F.avg(F.when(F.col("draw") >= 0, F.col("t"))) - 1).alias("truth"))
    c = spans.crossJoin(F.broadcast(truth)).agg(F.count_if((F.col("lo") <= F.col("truth")) & (F.col("truth") <= F.col("hi"))).alias("k"), F.count("*").alias("n"), F.first("truth").alias("truth"), F.expr("percentile(hi - lo, 0.5)").alias("width"))  # one row
    return wilson(c, z).select("n", "k", F.round(F.col("k") / F.col("n"), 9).alias("share"), "low", "high", F.round("truth", 9).alias("truth"), F.round("width", 9).alias("median_width"))
