"""Queries over neighbours, rankings and retrieval scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparsewing.catalog import query
from sparsewing.functions import numbers
from sparsewing.operators import blocks, encode as e, knn, metrics, wiring as w
from sparsewing.plans.codes import _VT, coded, driven, train
from sparsewing.plans.sql import K, M, QUERIES, S, TOP, sql
from sparsewing.sources import tables


def queries(spark, d):
    return tables.queries_of(tables.items(spark, d), QUERIES)


def plain_wiring(spark):
    return blocks.stack(w.uniform(spark, 64, M, S, 7), 64)


def truth(spark, d):
    return blocks.rankings(tables.items(spark, d), queries(spark, d), [blocks.Exact("truth")], TOP).drop("arm")


def predicted(spark, d):
    return blocks.rankings(tables.items(spark, d), queries(spark, d), [blocks.Coded("code", plain_wiring(spark), (K,))], TOP).drop("arm")


def of_queries(scores, queries_):
    """A row for every query; one without another item scores 0."""
    return queries_.select(F.col("item_id").alias("query_id")).join(scores, "query_id", "left").na.fill(0.0)


def scored(spark, d):
    arms = [blocks.Exact("truth"), blocks.Coded("code", plain_wiring(spark), (K,))]
    ranked = blocks.rankings(tables.items(spark, d), queries(spark, d), arms, TOP)
    return of_queries(blocks.scores(ranked, "truth", TOP).drop("arm"), queries(spark, d))


@query(sql("ap queries", "SELECT query_id, ap, ap_retrieved, recall FROM ap"))
def flagship(spark, d):
    """Quantise, centre, project, winner-take-all, Hamming retrieval, exact neighbours, average precision."""
    return scored(spark, d)


@query(sql("true", 'SELECT query_id, rnk, item_id, d FROM true'))
def truth_euclidean(spark, d):
    return truth(spark, d)


_RANK = "SELECT query_id, rnk, item_id, {0} FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {1}) AS rnk FROM ({2})) WHERE rnk <= " + str(TOP)


@query(
    sql(
        "pos queries",
        _RANK.format("d", "d, item_id", "SELECT query_id, b.item_id, CAST(list_sum(list_transform(list_zip(a.u, b.u), lambda t: (t[1] - t[2]) * (t[1] - t[2]))) AS BIGINT) AS d FROM queries JOIN un a ON a.item_id = query_id JOIN un b ON b.item_id <> query_id"),
    ).replace(" SELECT query_id, rnk", ", un AS (SELECT item_id, list(CAST(round(CASE WHEN s > 0 THEN v / (s / n) ELSE 0 END * 1000) AS BIGINT) ORDER BY dim) AS u FROM (SELECT *, CAST(sum(v) OVER (PARTITION BY item_id) AS DOUBLE) AS s, count(*) OVER (PARTITION BY item_id) AS n FROM pos) GROUP BY item_id) SELECT query_id, rnk", 1)
)
def truth_normalised(spark, d):
    from sparsewing.functions import vectors

    it = tables.items(spark, d).withColumn("q", vectors.positive(F.col("q")))
    return knn.truth(it, queries(spark, d), TOP, "normalised")


@query(
    sql(
        "items queries",
        _RANK.format("d", "d, item_id", "SELECT query_id, b.item_id, round(-CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda t: t[1] * t[2])) AS DOUBLE) / (sqrt(CAST(list_sum(list_transform(a.q, lambda x: x * x)) AS DOUBLE)) * sqrt(CAST(list_sum(list_transform(b.q, lambda x: x * x)) AS DOUBLE))), 12) AS d FROM queries JOIN items a ON a.item_id = query_id JOIN items b ON b.item_id <> query_id"),
    )
)
def truth_angular(spark, d):
    return knn.truth(tables.items(spark, d), queries(spark, d), TOP, "angular")


@query(sql("pred", "SELECT query_id, rnk, item_id, d FROM pred"))
def knn_hamming(spark, d):
    return predicted(spark, d)


@query(sql("ham", _RANK.format("d", "d, md5('tie:5:' || item_id), item_id", "SELECT * FROM ham")))
def knn_shared_order(spark, d):
    """Ties in one order for all queries."""
    return knn.hamming(coded(spark, d), queries(spark, d), tables.items(spark, d), TOP, shared_order=True, size=K)


def packed(y):
    """Dense sign codes as arrays of 32-bit words."""
    bits = e.signs(y).groupBy("item_id", F.floor(F.col("cell") / 32).alias("word")).agg(F.sum(F.col("bit") * F.pow(F.lit(2.0), F.col("cell") % 32)).cast("bigint").alias("x"))
    return bits.groupBy("item_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "x"))), lambda t: t["x"]).alias("q"))


def xor_distance():
    return F.aggregate(F.zip_with("x", "y", lambda a, b: F.bit_count(a.bitwiseXOR(b)).cast("bigint")), F.lit(0).cast("bigint"), lambda a, v: a + v)


@query(sql("drive queries", _RANK.format("d", "d, item_id", "SELECT query_id, b.item_id, sum(CASE WHEN (a.y >= 0) <> (b.y >= 0) THEN 1 ELSE 0 END)::BIGINT AS d FROM queries JOIN drive a ON a.item_id = query_id JOIN drive b ON b.cell = a.cell AND b.item_id <> query_id GROUP BY ALL")))
def knn_dense(spark, d):
    """Dense sign codes packed into words: Hamming distance by xor and bit count."""
    p = knn.pairs(packed(driven(spark, d)), queries(spark, d))
    return knn.first(p.select("query_id", "item_id", xor_distance().alias("d")), TOP, F.col("d"), F.col("item_id")).select("query_id", "rnk", "item_id", "d")


_S = _RANK.format("s", "s DESC, md5('tie:5:' || query_id || ':' || item_id), item_id", "{}")


@query(sql("code drive queries", _S.format("SELECT query_id, c.item_id, CAST(sum(u.y) AS BIGINT) AS s FROM queries JOIN drive u ON u.item_id = query_id JOIN code c ON c.cell = u.cell AND c.item_id <> query_id GROUP BY ALL")))
def asym_set(spark, d):
    """The query keeps its drives, the item is its winners."""
    return knn.by_score(knn.asymmetric(coded(spark, d), driven(spark, d), queries(spark, d)), TOP)


@query(sql("drive queries", _S.format("SELECT query_id, c.item_id, CAST(sum(u.y * CASE WHEN c.y >= 0 THEN 1 ELSE -1 END) AS BIGINT) AS s FROM queries JOIN drive u ON u.item_id = query_id JOIN drive c ON c.cell = u.cell AND c.item_id <> query_id GROUP BY ALL")))
def asym_sign(spark, d):
    y = driven(spark, d)
    return knn.by_score(knn.asymmetric(e.signs(y), y, queries(spark, d), 2 * F.col("bit") - 1), TOP)


_UV = f"SELECT query_id, c.item_id, sum((u.y / 1e6) * (rec / 1e6)) AS uv, sum((rec / 1e6) * (rec / 1e6)) AS vv FROM queries JOIN drive u ON u.item_id = query_id JOIN ({_VT}) c ON c.cell = u.cell AND c.item_id <> query_id GROUP BY ALL"


@query(sql("drive code queries", _S.format(f"SELECT query_id, item_id, round(uv, 4) AS s FROM ({_UV})")))
def asym_value(spark, d):
    """Winners weighted by their reconstructed value."""
    q = queries(spark, d)
    y = driven(spark, d, only=q)
    s = knn.asymmetric(e.value_tags(coded(spark, d), 4), y.withColumn("y", F.col("y") / 1e6), q, F.col("rec") / 1e6)
    return knn.by_score(s.withColumn("s", F.round("s", 4)), TOP)


@query(sql("drive code queries", _RANK.format("d", "d, item_id", f"SELECT query_id, g.item_id, round(uu - 2 * uv + vv, 3) AS d FROM ({_UV}) g JOIN (SELECT item_id, sum((y / 1e6) * (y / 1e6)) AS uu FROM drive GROUP BY item_id) n ON n.item_id = query_id")))
def value_adc(spark, d):
    """Squared distance of the query's drives to the item's reconstruction, which is zero outside its winners."""
    y = driven(spark, d).withColumn("u", F.col("y") / 1e6)
    q = y.join(queries(spark, d), "item_id", "left_semi").select(F.col("item_id").alias("query_id"), "cell", "u")
    uu = q.groupBy("query_id").agg(F.sum(F.col("u") * F.col("u")).alias("uu"))
    v = F.col("rec") / 1e6
    s = e.value_tags(coded(spark, d), 4).join(q, "cell").filter("item_id <> query_id").groupBy("query_id", "item_id").agg(F.sum(F.col("u") * v).alias("uv"), F.sum(v * v).alias("vv"))
    s = s.join(F.broadcast(uu), "query_id").withColumn("d", F.round(F.col("uu") - 2 * F.col("uv") + F.col("vv"), 3))  # a row per query
    return knn.first(s, TOP, F.col("d"), F.col("item_id")).select("query_id", "rnk", "item_id", "d")


@query(
    sql(
        "code items queries",
        _RANK.format("d", "d, item_id", f"SELECT query_id, i.item_id, round(a.vv + b.vv - 2 * coalesce(vw, 0), 3) AS d FROM queries JOIN items i ON i.item_id <> query_id JOIN nv a ON a.item_id = query_id JOIN nv b ON b.item_id = i.item_id LEFT JOIN (SELECT query_id AS qq, y.item_id AS j, sum((x.rec / 1e6) * (y.rec / 1e6)) AS vw FROM queries JOIN vt x ON x.item_id = query_id JOIN vt y ON y.cell = x.cell GROUP BY ALL) ON qq = query_id AND j = i.item_id"),
    ).replace(" SELECT query_id, rnk", f", vt AS ({_VT}), nv AS (SELECT item_id, sum((rec / 1e6) * (rec / 1e6)) AS vv FROM vt GROUP BY item_id) SELECT query_id, rnk", 1)
)
def value_distance(spark, d):
    """Squared distance between the two reconstructions; pairs that share no winner take part."""
    t = e.value_tags(coded(spark, d), 4).select("item_id", "cell", (F.col("rec") / 1e6).alias("v"))
    nv = t.groupBy("item_id").agg(F.sum(F.col("v") * F.col("v")).alias("vv"))
    q = queries(spark, d).select(F.col("item_id").alias("query_id"))
    tq = t.join(q, t.item_id == q.query_id).select("query_id", "cell", F.col("v").alias("u"))
    both = t.join(tq, "cell").groupBy("query_id", "item_id").agg(F.sum(F.col("u") * F.col("v")).alias("vw"))
    every = nv.join(F.broadcast(q), F.col("item_id") != F.col("query_id")).join(nv.select(F.col("item_id").alias("query_id"), F.col("vv").alias("qq")), "query_id")  # the stated queries
    s = every.join(both, ["query_id", "item_id"], "left").withColumn("d", F.round(F.col("vv") + F.col("qq") - 2 * F.coalesce("vw", F.lit(0.0)), 3))
    return knn.first(s, TOP, F.col("d"), F.col("item_id")).select("query_id", "rnk", "item_id", "d")


BUDGET = 60
_HC = "SELECT item_id, cell FROM (SELECT item_id, cell, row_number() OVER (PARTITION BY item_id ORDER BY y DESC, md5('prio:1:' || cell), cell) AS r FROM drive WHERE cell % 2 = {0}) WHERE r <= 8"
_HD = f"SELECT query_id, i.item_id, 16 - 2 * coalesce(n, 0) AS d FROM queries JOIN items i ON i.item_id <> query_id LEFT JOIN (SELECT query_id AS qq, c.item_id AS j, count(*) AS n FROM queries JOIN ({_HC}) x ON x.item_id = query_id JOIN ({_HC}) c ON c.cell = x.cell GROUP BY ALL) ON qq = query_id AND j = i.item_id"
_CUT = f"SELECT query_id, item_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, md5('tie:5:' || item_id), item_id) AS r FROM ({{}})) WHERE r <= {BUDGET // 2}"


@query(
    sql(
        "drive items queries",
        _RANK.format("d", "d, md5('tie:5:' || item_id), item_id", "SELECT c.query_id, c.item_id, CAST(a.d + b.d AS BIGINT) AS d FROM cand c JOIN l a ON a.query_id = c.query_id AND a.item_id = c.item_id JOIN r b ON b.query_id = c.query_id AND b.item_id = c.item_id"),
    ).replace(" SELECT query_id, rnk", f", l AS ({_HD.format(0)}), r AS ({_HD.format(1)}), cand AS ({_CUT.format('SELECT * FROM l')} UNION {_CUT.format('SELECT * FROM r')}) SELECT query_id, rnk", 1)
)
def two_or(spark, d):
    """Two half tables: the best of each by its own distance are candidates, ranked by the distance over both."""
    y, q, it = driven(spark, d), queries(spark, d), tables.items(spark, d)
    half = [e.winners(y.filter(F.col("cell") % 2 == t), K // 2) for t in (0, 1)]
    cand = knn.candidates(*[knn.hamming(c, q, it, BUDGET // 2, shared_order=True, size=K // 2) for c in half])
    s = cand
    for t, c in enumerate(half):
        s = s.join(knn.overlap(c, q).withColumnRenamed("both", f"b{t}"), ["query_id", "item_id"], "left")
    dist = (F.lit(2 * K) - 2 * F.coalesce("b0", F.lit(0)) - 2 * F.coalesce("b1", F.lit(0))).cast("bigint")
    return knn.first(s.withColumn("d", dist), TOP, F.col("d"), F.md5(F.concat(F.lit("tie:5:"), F.col("item_id").cast("string"))), F.col("item_id")).select("query_id", "rnk", "item_id", "d")


_BIN = f"SELECT item_id, CAST(sum(CASE WHEN s >= 0 THEN pow(2, block) ELSE 0 END) AS BIGINT) AS bin FROM (SELECT item_id, cell * 8 // {M} AS block, sum(y) AS s FROM drive GROUP BY ALL) GROUP BY item_id"
_DD = "SELECT query_id, b.item_id, sum(CASE WHEN (a.y >= 0) <> (b.y >= 0) THEN 1 ELSE 0 END)::BIGINT AS d FROM queries JOIN drive a ON a.item_id = query_id JOIN drive b ON b.cell = a.cell AND b.item_id <> query_id GROUP BY ALL"


@query(
    sql(
        "drive queries",
        _RANK.format("d", "d, md5('tie:5:' || item_id), item_id", "SELECT query_id, item_id, d FROM dd JOIN cand USING (query_id, item_id)"),
    ).replace(
        " SELECT query_id, rnk",
        f", bins AS ({_BIN}), occ AS (SELECT bin, count(*) AS n FROM bins GROUP BY bin), ord AS (SELECT query_id, o.bin, sum(n) OVER (PARTITION BY query_id ORDER BY bit_count(xor(o.bin, x.bin)), o.bin ROWS UNBOUNDED PRECEDING) - n AS before FROM queries JOIN bins x ON x.item_id = query_id, occ o), cand AS (SELECT query_id, item_id FROM ord JOIN (SELECT item_id, bin, row_number() OVER (PARTITION BY bin ORDER BY item_id) AS r FROM bins) USING (bin) WHERE before + r <= {BUDGET}), dd AS ({_DD}) SELECT query_id, rnk",
        1,
    )
)
def densefly_probe(spark, d):
    """Occupied bins in order of Hamming distance to the query's bin until the budget of items is spent, then dense distances.
    A query probes bins, not items; an item that is the query itself takes a place of the budget but is no answer."""
    from pyspark.sql import Window

    y, q = driven(spark, d), queries(spark, d)
    bins = e.probe_bins(y, M, 8)
    occ = bins.groupBy("bin").agg(F.count("*").alias("n"))
    qb = q.join(bins, "item_id").select(F.col("item_id").alias("query_id"), F.col("bin").alias("qbin"))
    w = Window.partitionBy("query_id").orderBy(F.bit_count(F.col("bin").bitwiseXOR(F.col("qbin"))), "bin")
    order = occ.crossJoin(F.broadcast(qb)).withColumn("before", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))  # 256 bins by the stated queries
    member = bins.withColumn("r", F.row_number().over(Window.partitionBy("bin").orderBy("item_id"))).filter(F.col("r") <= BUDGET)
    cand = order.filter(F.col("before") < BUDGET).join(member, "bin").filter(F.col("before") + F.col("r") <= BUDGET).select("query_id", "item_id").filter("query_id <> item_id")
    s = cand.join(packed(y).select("item_id", F.col("q").alias("y")), "item_id").join(packed(y).select(F.col("item_id").alias("query_id"), F.col("q").alias("x")), "query_id")
    return knn.first(s.withColumn("d", xor_distance()), TOP, F.col("d"), F.md5(F.concat(F.lit("tie:5:"), F.col("item_id").cast("string"))), F.col("item_id")).select("query_id", "rnk", "item_id", "d")


@query(sql("pred gap", "SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY d, item_id) AS rnk, item_id, d FROM (SELECT p.query_id, p.item_id, g.d FROM pred p JOIN gap g ON g.query_id = p.query_id AND g.item_id = p.item_id)"))
def rerank(spark, d):
    return knn.rerank(knn.candidates(predicted(spark, d)), tables.items(spark, d), TOP)


@query(sql("ap", "SELECT query_id, ap FROM ap"))
def ap(spark, d):
    return scored(spark, d).select("query_id", "ap")


@query(sql("ap", "SELECT query_id, recall FROM ap"))
def recall(spark, d):
    return scored(spark, d).select("query_id", "recall")


@query(sql("ap", "SELECT query_id, ap_retrieved FROM ap"))
def ap_retrieved(spark, d):
    return scored(spark, d).select("query_id", "ap_retrieved")


@query(sql("pred true queries", f'SELECT q.query_id, round(coalesce(sum(CASE WHEN depth <= i THEN 1.0 / i END), 0) / {TOP}, 9) AS overlap FROM queries q LEFT JOIN (SELECT p.query_id, greatest(p.rnk, t.rnk) AS depth FROM pred p JOIN true t ON t.query_id = p.query_id AND t.item_id = p.item_id) b ON b.query_id = q.query_id LEFT JOIN range(1, {TOP + 1}) r(i) ON true GROUP BY q.query_id'))
def list_overlap(spark, d):
    return metrics.list_overlap(predicted(spark, d), truth(spark, d), queries(spark, d), TOP)


_MEAN = sql("ap", "SELECT round(avg(ap), 9) AS mean_ap FROM ap")


@query(_MEAN)
def map_queries(spark, d):
    return metrics.mean_score(scored(spark, d), "ap")


@query(_MEAN.replace(f" LIMIT {QUERIES}", ""))
def map_all(spark, d):
    """Every item is a query: blocks of queries meet blocks of items."""
    it, code = tables.items(spark, d), plain_wiring(spark)
    ranked = blocks.all_rankings(it, [blocks.Exact("truth"), blocks.Coded("code", code, (K,))], TOP)
    return metrics.mean_score(of_queries(blocks.scores(ranked, "truth", TOP).drop("arm"), it.select("item_id")), "ap")


@query(sql("code train", "SELECT c.item_id, round(avg(1 - coalesce(n, 0) / 200), 9) AS novelty FROM code c LEFT JOIN (SELECT cell, count(*) AS n FROM code JOIN train USING (item_id) GROUP BY cell) s ON s.cell = c.cell WHERE c.item_id NOT IN (SELECT item_id FROM train) GROUP BY c.item_id"))
def bloom_novelty(spark, d):
    t = train(spark, d)
    probes = tables.items(spark, d).join(t, "item_id", "left_anti").select("item_id")
    return metrics.bloom(coded(spark, d), t, probes)


_FLY = "SELECT item_id, label AS pred FROM (SELECT p.item_id, z.label, row_number() OVER (PARTITION BY p.item_id ORDER BY -(coalesce(c, 0) / n), z.label) AS r FROM (SELECT item_id FROM items WHERE item_id NOT IN (SELECT item_id FROM train)) p CROSS JOIN (SELECT label, count(*) AS n FROM items JOIN train USING (item_id) GROUP BY label) z LEFT JOIN (SELECT a.item_id, i.label, count(*) AS c FROM code a JOIN code b ON b.cell = a.cell JOIN train t ON t.item_id = b.item_id JOIN items i ON i.item_id = b.item_id GROUP BY ALL) g ON g.item_id = p.item_id AND g.label = z.label) WHERE r = 1"


@query(sql("items code train", _FLY))
def flynn(spark, d):
    """Class of the least novel memory."""
    it, t = tables.items(spark, d), train(spark, d)
    stored = it.join(t, "item_id", "left_semi").select("item_id", "label")
    return metrics.class_novelty(coded(spark, d), stored, it.join(t, "item_id", "left_anti").select("item_id"))


@query(sql("items code train", f"SELECT count(*) AS n, round(avg(CASE WHEN f.pred = i.label THEN 1.0 ELSE 0.0 END), 9) AS accuracy FROM ({_FLY}) f JOIN items i USING (item_id)"))
def accuracy(spark, d):
    p = flynn(spark, d).join(tables.items(spark, d).select("item_id", "label"), "item_id")
    return p.agg(F.count("*").alias("n"), F.round(F.avg(F.when(F.col("pred") == F.col("label"), 1.0).otherwise(0.0)), 9).alias("accuracy"))


@query(sql("code items", "SELECT round((sum(r) FILTER (novel = 1) - a * (a + 1) / 2) / (a * b), 9) AS auc FROM (SELECT novel, row_number() OVER (ORDER BY s, novel DESC, item_id) AS r, count(*) FILTER (novel = 1) OVER () AS a, count(*) FILTER (novel = 0) OVER () AS b FROM (SELECT i.item_id, CASE WHEN label >= 8 THEN 1 ELSE 0 END AS novel, round(avg(1 - coalesce(n, 0) / tot), 9) AS s FROM items i JOIN code c USING (item_id) LEFT JOIN (SELECT cell, count(*) AS n FROM code JOIN items USING (item_id) WHERE label < 5 GROUP BY cell) g ON g.cell = c.cell, (SELECT count(*) AS tot FROM items WHERE label < 5) WHERE label >= 5 GROUP BY ALL)) GROUP BY a, b"))
def auc(spark, d):
    """Novelty of labels 8 and 9 against 5 to 7, with labels 0 to 4 stored."""
    it = tables.items(spark, d)
    s = metrics.bloom(coded(spark, d), it.filter("label < 5"), it.filter("label >= 5"))
    return metrics.auc(s.join(it, "item_id").select("item_id", F.col("novelty").alias("s"), F.when(F.col("label") >= 8, 1).otherwise(0).alias("novel")))


@query()
def pq_adc(spark, d):
    from sparsewing.operators import learn

    it = tables.items(spark, d)
    tr = it.join(train(spark, d), "item_id", "left_semi")
    books = learn.pq_fit(tr, numbers.pq_layout(32, 64, 4), 64, 1)
    s = learn.pq_adc(learn.pq_encode(it, books), it, queries(spark, d), books)
    return knn.first(s.withColumn("d", F.round(F.col("d") / 1e12, 9)), TOP, F.col("d"), F.col("item_id")).select("query_id", "rnk", "item_id", "d")

