"""Rules stated beforehand, on rows made by hand."""

from sparsewing.operators import verdicts as v


def test_within_and_law(spark):
    p = spark.createDataFrame([("a", 1.04, 1.0), ("b", 0.9, 1.0), ("c", 1.0, 0.0), ("d", None, 1.0)], "n string, value double, base double")
    assert {r.n: (r.rel, r.passed) for r in v.within(p, ["n"], 0.05).collect()} == {"a": (0.04, True), "b": (-0.1, False), "c": (None, False), "d": (None, False)}
    c = spark.createDataFrame([("a", 2.0, 21.0), ("b", 2.0, 24.0), ("c", 0.0, 24.0), ("d", 2.0, None)], "n string, t double, theta double")
    got = {r.n: (r.predicted, r.error, r.passed) for r in v.law(c, ["n"], 40.0, 3.0).collect()}
    assert got == {"a": (20.0, 1.0, True), "b": (20.0, 4.0, False), "c": (None, None, False), "d": (20.0, None, False)}
    e = v.enough(v.law(c, ["n"], 40.0, 5.0), [], 0.5).first()
    assert (e.cells, e.held, e.passed) == (4, 2, True) and not v.enough(v.law(c, ["n"], 40.0, 5.0), [], 0.6).first().passed


def rows(spark, **groups):
    out = [(g, s, x, d) for g, (d, pairs) in groups.items() for s, x in pairs]
    return spark.createDataFrame(out, "g string, s long, deficit double, d_eff double")


def test_fan_in(spark):
    falling = [(1, 0.5), (4, 0.2), (16, 0.04), (32, 0.01)]
    df = rows(
        spark,
        good=(10.0, falling),
        weak=(10.0, [(1, 0.5), (4, 0.05), (16, 0.04), (32, 0.01)]),
        rises=(10.0, [(1, 0.2), (4, 0.5), (16, 0.01), (32, 0.04)]),
        flat=(10.0, [(1, 0.2), (4, 0.2), (16, 0.2)]),
        none_high=(99.0, falling),
        both=(4.0, falling),
        alone=(10.0, [(1, 0.5)]),
    )
    got = {r.g: (r.spearman, r.falls, r.low, r.high, r.contradictory, r.passed) for r in v.fan_in(df, ["g"]).collect()}
    assert got["good"] == (-1.0, True, True, True, 0, True)
    assert got["weak"] == (-1.0, True, False, True, 0, False)
    assert got["rises"][:2] == (-0.6, False) and not got["rises"][5]
    assert got["flat"] == (None, False, True, False, 0, False)
    assert got["none_high"] == (-1.0, True, True, False, 0, False)
    assert got["both"] == (-1.0, True, True, False, 1, False)
    assert got["alone"][0] is None and not got["alone"][5]
