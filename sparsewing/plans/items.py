"""Queries over item vectors and response matrices."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparsewing.catalog import query
from sparsewing.functions import rng, vectors
from sparsewing.operators import overlay, synthetic
from sparsewing.plans.sql import sql
from sparsewing.sources import tables


@query(sql("long", "SELECT item_id, dim, v FROM long"))
def quantise(spark, d):
    return tables.long(tables.items(spark, d))


@query(sql("cent", "SELECT item_id, dim, v FROM cent"))
def row_centre(spark, d):
    return tables.long(tables.items(spark, d).withColumn("q", vectors.centre(F.col("q"))))


@query(sql("pos", "SELECT item_id, dim, round(CASE WHEN avg(v) OVER w > 0 THEN v / (sum(v) OVER w / count(*) OVER w) ELSE 0 END, 9) AS v FROM pos WINDOW w AS (PARTITION BY item_id)"))
def unit_mean(spark, d):
    x = tables.items(spark, d).withColumn("q", vectors.unit_mean(vectors.positive(F.col("q"))))
    return tables.long(x).withColumn("v", F.round("v", 9))


@query(sql("long", "SELECT item_id, dim, round(v / sqrt(CAST(sum(v * v) OVER (PARTITION BY item_id) AS DOUBLE)), 9) AS v FROM long"))
def unit_norm(spark, d):
    return tables.long(tables.items(spark, d).withColumn("q", vectors.unit_norm(F.col("q")))).withColumn("v", F.round("v", 9))


@query(sql("long", "SELECT item_id, dim, round(v * pow(var, 0.25) / 1000, 6) AS v FROM long JOIN (SELECT dim, var_pop(CAST(v AS DOUBLE)) / 1e12 AS var FROM long GROUP BY dim) USING (dim)"))
def prescale(spark, d):
    """Every dimension times its variance to the power alpha / 2, alpha = 1/2."""
    x = tables.long(tables.items(spark, d))
    var = x.groupBy("dim").agg((F.var_pop(F.col("v").cast("double")) / 1e12).alias("var"))
    return x.join(F.broadcast(var), "dim").select("item_id", "dim", F.round(F.col("v") * F.pow("var", F.lit(0.25)) / 1000, 6).alias("v"))  # a row per dimension


@query("SELECT s_suppkey AS id, CASE WHEN s_name LIKE 'M\\_%' ESCAPE '\\' OR s_name LIKE 'CB%' THEN NULL ELSE split_part(s_name, '#', 1) END AS kind, split_part(p, '_', 1) AS dim FROM supplier JOIN (SELECT s_suppkey AS k, replace(s_name, '#', '_') AS p FROM supplier) ON k = s_suppkey")
def type_parser(spark, d):
    s = tables.table(spark, d, "supplier")
    kind = F.when(F.col("s_name").startswith("M_") | F.col("s_name").startswith("CB"), F.lit(None)).otherwise(F.split_part("s_name", F.lit("#"), F.lit(1)))
    return s.select(F.col("s_suppkey").alias("id"), kind.alias("kind"), vectors.type_to_dim(F.replace("s_name", F.lit("#"), F.lit("_"))).alias("dim"))


@query(sql("resp", "SELECT item, dim, round(v, 9) AS v FROM resp"))
def response_matrix(spark, d):
    return tables.responses(spark, d).withColumn("v", F.round("v", 9))


@query(sql("resp", "SELECT dim, count(*) AS measured, round(avg(CASE WHEN v > 50 THEN 1.0 ELSE 0.0 END), 9) AS breadth FROM resp GROUP BY dim"))
def response_breadth(spark, d):
    """Share of the measured values of a dimension above a threshold; what is missing does not count."""
    return tables.responses(spark, d).groupBy("dim").agg(F.count("*").alias("measured"), F.round(F.avg(F.when(F.col("v") > 50, 1.0).otherwise(0.0)), 9).alias("breadth"))


def _covered(spark, d, items_at_least: int, dims_at_least: int):
    r = tables.responses(spark, d).filter("v is not null")
    dims = r.groupBy("dim").count().filter(F.col("count") >= items_at_least).select("dim")
    r = r.join(dims, "dim", "left_semi")
    rows = r.groupBy("item").count().filter(F.col("count") >= dims_at_least).select("item")
    return r.join(rows, "item", "left_semi")


_COVERED = "a AS (SELECT * FROM resp WHERE v IS NOT NULL), b AS (SELECT * FROM a WHERE dim IN (SELECT dim FROM a GROUP BY dim HAVING count(*) >= 60)), cov AS (SELECT * FROM b WHERE item IN (SELECT item FROM b GROUP BY item HAVING count(*) >= 20))"


@query(sql("resp", "SELECT item, dim, round(v, 9) AS v FROM cov").replace(" SELECT item, dim, round", f", {_COVERED} SELECT item, dim, round"))
def coverage_filter(spark, d):
    """First dimensions with enough items, then items with enough of the dimensions that are left."""
    return _covered(spark, d, 60, 20).withColumn("v", F.round("v", 9))


def _grid(r):
    """All items by all dimensions of a response matrix, missing values as null: a row per cell of the matrix."""
    n = r.select("dim").distinct()
    return r.select("item").distinct().crossJoin(n).join(r, ["item", "dim"], "left")


def _impute_sql(value: str) -> str:
    body = f"SELECT item, dim, round({value}, 9) AS v FROM (SELECT item, dim, v, avg(v) OVER (PARTITION BY dim) AS cm, avg(v) OVER (PARTITION BY item) AS rm FROM (SELECT DISTINCT item FROM cov) CROSS JOIN (SELECT DISTINCT dim FROM cov) LEFT JOIN cov USING (item, dim))"
    return sql("resp", body).replace(f" {body}", f", {_COVERED} {body}")


@query(_impute_sql("coalesce(v, 0)"))
def impute_zero(spark, d):
    return _grid(_covered(spark, d, 60, 20)).withColumn("v", F.round(F.coalesce("v", F.lit(0.0)), 9))


@query(_impute_sql("coalesce(v, cm, 0)"))
def impute_col_mean(spark, d):
    g = _grid(_covered(spark, d, 60, 20))
    m = g.groupBy("dim").agg(F.avg("v").alias("m"))
    return g.join(m, "dim").select("item", "dim", F.round(F.coalesce("v", "m", F.lit(0.0)), 9).alias("v"))


@query(_impute_sql("coalesce(v, rm, 0)"))
def impute_row_mean(spark, d):
    g = _grid(_covered(spark, d, 60, 20))
    m = g.groupBy("item").agg(F.avg("v").alias("m"))
    return g.join(m, "item").select("item", "dim", F.round(F.coalesce("v", "m", F.lit(0.0)), 9).alias("v"))


@query()
def lowrank_impute(spark, d):
    """Completion by a truncated decomposition, a row per item."""
    from sparsewing.operators.learn import completed

    r = _covered(spark, d, 60, 20)
    dims = sorted(x.dim for x in r.select("dim").distinct().collect())  # event types and hours
    values = r.groupBy("item").agg(F.map_from_entries(F.collect_list(F.struct("dim", "v"))).alias("m"))
    x = F.array(*[F.element_at("m", F.lit(c)) for c in dims]) if dims else F.array().cast("array<double>")
    rows = completed(values.select("item", x.alias("x")), len(dims)).select("item", F.posexplode("y").alias("i", "y"))
    name = F.get(F.array(*[F.lit(c) for c in dims]).cast("array<string>"), F.col("i"))
    return rows.select("item", name.alias("dim"), (F.rint(F.col("y") * 1e6) / 1e6).alias("v"))


@query(sql("items", "SELECT item_id, CASE WHEN r <= 100 THEN 'query' WHEN r <= 200 THEN 'validation' WHEN r <= 400 THEN 'train' ELSE 'rest' END AS part FROM (SELECT item_id, row_number() OVER (ORDER BY md5('split:9:' || item_id), item_id) AS r FROM items)"))
def split_disjoint(spark, d):
    """Disjoint parts by rank of a digest: bounds of the parts come from the sorted front, nothing else is ranked."""
    x = tables.items(spark, d).select("item_id", rng.digest("split", 9, "item_id").alias("h"))
    front = x.orderBy("h", "item_id").limit(400)
    from pyspark.sql import Window

    r = front.withColumn("r", F.row_number().over(Window.orderBy("h", "item_id"))).select("item_id", "r")
    part = F.when(F.col("r") <= 100, "query").when(F.col("r") <= 200, "validation").when(F.col("r") <= 400, "train").otherwise("rest")
    return x.join(F.broadcast(r), "item_id", "left").select("item_id", part.alias("part"))  # 400 rows


@query(
    sql(
        "items",
        "SELECT m.mix, u.dim, CAST(sum(w * q[u.dim + 1]) AS BIGINT) AS v FROM (SELECT mix, item_id, 1 + CAST('0x' || substr(md5('mixw:2:' || mix || ':' || item_id), 1, 8) AS BIGINT) % 9 AS w FROM (SELECT mix, item_id, row_number() OVER (PARTITION BY mix ORDER BY md5('mix:2:' || item_id || ':' || mix), item_id) AS r FROM range(30) t(mix), (SELECT item_id FROM items ORDER BY md5('mixpool:2:' || item_id), item_id LIMIT 100)) WHERE r <= 2 + CAST('0x' || substr(md5('mixn:2:' || mix), 1, 8) AS BIGINT) % 4) m JOIN items USING (item_id), range(64) u(dim) GROUP BY ALL",
    )
)
def mixtures_integer(spark, d):
    """Mixtures of two to five different items with whole weights 1..9."""
    it = tables.items(spark, d)
    pool = rng.pick(it, 100, "mixpool", 2, "item_id").select("item_id")
    grid = spark.range(30).withColumnRenamed("id", "mix").crossJoin(F.broadcast(pool))  # 100 rows
    from pyspark.sql import Window

    r = F.row_number().over(Window.partitionBy("mix").orderBy(rng.digest("mix", 2, "item_id", "mix"), "item_id"))
    m = grid.withColumn("r", r).filter(F.col("r") <= 2 + rng.integer(4, "mixn", 2, "mix")).withColumn("w", 1 + rng.integer(9, "mixw", 2, "mix", "item_id"))
    return tables.long(it).join(F.broadcast(m), "item_id").groupBy("mix", "dim").agg(F.sum(F.col("w") * F.col("v")).alias("v"))


@query(sql("long", "SELECT label, dim, CAST(sum(v) AS BIGINT) AS v, count(*) AS n FROM long GROUP BY label, dim"))
def group_mean_sums(spark, d):
    it = tables.items(spark, d)
    x = it.select("label", F.posexplode("q").alias("dim", "v"))
    return x.groupBy("label", F.col("dim").cast("bigint").alias("dim")).agg(F.sum("v").alias("v"), F.count("*").alias("n"))


# ---------------------------------------------------------------- Dirichlet mixtures
def _draw(tag: str, *parts: str) -> str:
    return f"CAST('0x' || substr(md5('{tag}:3:' || {" || ':' || ".join(parts)}), 1, 8) AS BIGINT)"


def _mixed_sql(body: str) -> str:
    """Floyd's sampling step by step, then exponential draws over their sum."""
    n = "(SELECT count(DISTINCT item_id) FROM items)"
    out = [f"m0 AS (SELECT mix, {n} AS n, least(2 + {_draw('mixk', 'mix')} % 4, {n}) AS k, CAST([] AS BIGINT[]) AS got FROM range(200) t(mix))"]
    for i in range(5):
        t = f"{_draw('mixp', 'mix', repr(str(i)))} % greatest(n - k + {i} + 1, 1)"
        out.append(f"m{i + 1} AS (SELECT mix, n, k, CASE WHEN k > {i} THEN list_append(got, CASE WHEN list_contains(got, {t}) THEN n - k + {i} ELSE {t} END) ELSE got END AS got FROM m{i})")
    out.append("pt AS (SELECT mix, unnest(range(len(got))) AS pos, unnest(got) AS part FROM m5)")
    out.append(f"ex AS (SELECT mix, part, CAST(floor(-ln(({_draw('mixg', 'mix', 'pos', repr('0'))} + 1) / 4294967296.0) * 1000000000) AS HUGEINT) AS g FROM pt)")
    out.append("id AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS part FROM (SELECT DISTINCT item_id FROM items))")
    out.append("mx AS (SELECT mix, item_id, CAST(g * 1000000 // sum(g) OVER (PARTITION BY mix) AS BIGINT) AS weight FROM ex JOIN id USING (part))")
    return sql("items", f"SELECT 1 FROM items").replace(" SELECT 1 FROM items", ", " + ", ".join(out) + " " + body)


@query(_mixed_sql("SELECT mix, item_id, weight FROM mx"))
def mixture_weights(spark, d):
    """Two to five different items in each of 200 mixtures, with Dirichlet weights."""
    return synthetic.mixtures(tables.items(spark, d), 200, seed=3)[0]


@query(_mixed_sql("SELECT mix, u.dim, CAST(sum(weight * q[u.dim + 1]) AS BIGINT) AS v FROM mx JOIN items USING (item_id), range(64) u(dim) GROUP BY ALL"))
def mixtures_dirichlet(spark, d):
    return synthetic.mixtures(tables.items(spark, d), 200, seed=3)[1]


# ---------------------------------------------------------------- revisions
_LINES = "SELECT l_partkey AS p_partkey, l_returnflag AS f, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) // sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) / 100 AS price, CAST(max(l_quantity) AS INTEGER) AS size FROM lineitem GROUP BY ALL"


def _revisions(spark, d):
    """A table of parts, and revisions of it: the price of returned lines, then price and size of accepted ones."""
    lines = tables.table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey"), F.col("l_returnflag").alias("f")).agg((F.expr("sum(cast(round(l_extendedprice * 100) as bigint)) div sum(cast(l_quantity as bigint))").cast("double") / 100).alias("p_retailprice"), F.max("l_quantity").cast("int").alias("p_size"))
    base = tables.table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice")
    known = base.select("p_partkey")
    of = lambda f, *c: lines.filter(F.col("f") == f).join(known, "p_partkey", "left_semi").select("p_partkey", *c)
    return base, [("returned", of("R", "p_retailprice")), ("accepted", of("A", "p_retailprice", "p_size").withColumn("p_size", F.when(F.col("p_size") > 40, F.col("p_size"))))]


@query(
    f"WITH l AS ({_LINES}) SELECT p.p_partkey, coalesce(CASE WHEN a.size > 40 THEN a.size END, p.p_size) AS p_size, coalesce(a.price, r.price, p.p_retailprice) AS p_retailprice,"
    " CASE WHEN r.price IS NOT NULL AND a.price IS NOT NULL THEN 'returned,accepted' WHEN r.price IS NOT NULL THEN 'returned' WHEN a.price IS NOT NULL THEN 'accepted' ELSE '' END AS revised_by"
    " FROM part p LEFT JOIN l r ON r.p_partkey = p.p_partkey AND r.f = 'R' LEFT JOIN l a ON a.p_partkey = p.p_partkey AND a.f = 'A'"
)
def revision_overlay(spark, d):
    base, revisions = _revisions(spark, d)
    return overlay.overlay(base, revisions, ["p_partkey"]).withColumn("revised_by", F.array_join("revised_by", ","))


@query(
    f"WITH l AS ({_LINES}), w AS (SELECT p.p_partkey, p.p_size, p.p_retailprice AS p0, r.price AS p1, a.price AS p2, CASE WHEN a.size > 40 THEN a.size END AS s2 FROM part p LEFT JOIN l r ON r.p_partkey = p.p_partkey AND r.f = 'R' LEFT JOIN l a ON a.p_partkey = p.p_partkey AND a.f = 'A'),"
    " c AS (SELECT p_partkey, 'p_retailprice' AS field, 'returned' AS revision, p0 AS was, p1 AS now FROM w WHERE p1 <> p0 UNION ALL SELECT p_partkey, 'p_retailprice', 'accepted', coalesce(p1, p0), p2 FROM w WHERE p2 <> coalesce(p1, p0) UNION ALL SELECT p_partkey, 'p_size', 'accepted', p_size, s2 FROM w WHERE s2 <> p_size)"
    " SELECT p_partkey, field, row_number() OVER (PARTITION BY p_partkey, field ORDER BY revision DESC) AS step, revision, was, now FROM c"
)
def revision_history(spark, d):
    base, revisions = _revisions(spark, d)
    h = overlay.history(base, revisions, ["p_partkey"])
    return h.withColumns({"was": F.col("was").cast("double"), "now": F.col("now").cast("double")})
