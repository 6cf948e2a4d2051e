"""The jobs as registered queries: each runs twice over the whole tables into a new folder and returns what stands there."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from jobs import audit_wiring, encode_documents
from sparsewing.operators.graph import shared_folder
from sparsewing.plans.sql import CTE, K


def new_folder(spark: SparkSession, name: str) -> str:
    """A name in the shared folder that no other call takes."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def job1_encode_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    at, config = new_folder(spark, "encode_documents"), json.loads(encode_documents.CONFIG.read_text())
    for _ in range(2):
        encode_documents.run(spark, f"{sf_dir}/documents.parquet", f"{at}/codes", f"{at}/checkpoint", config)
    return encode_documents.read_back(spark, f"{at}/codes").select("doc_id", "source", "n_words", "cells")


def job2_audit_wiring(spark: SparkSession, sf_dir: str) -> DataFrame:
    at, config = new_folder(spark, "audit_wiring"), json.loads(audit_wiring.CONFIG.read_text())
    for _ in range(2):
        out = audit_wiring.run(spark, *(f"{sf_dir}/{t}.parquet" for t in ("lineitem", "supplier", "nation", "region")), at, config)
    return out


JOB1 = f"""
WITH words AS (SELECT row_number() OVER () AS r, doc_id, nullif(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), '{encode_documents.UPPER}', '{encode_documents.LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
bins AS (SELECT r, CAST(('0x' || substr(md5('word:' || x), 1, 8)) AS BIGINT) % 64 AS dim, count(*) AS n FROM (SELECT r, unnest(w) AS x FROM words) GROUP BY ALL),
total AS (SELECT r, sum(n) AS n FROM bins GROUP BY r),
v AS (SELECT t.r, d.dim, 64 * coalesce(b.n, 0) - t.n AS v FROM total t CROSS JOIN range(64) d(dim) LEFT JOIN bins b ON b.r = t.r AND b.dim = d.dim),
wir AS ({CTE["wir"]}),
y AS (SELECT r, cell, sum(v) AS y FROM v JOIN wir USING (dim) GROUP BY r, cell),
code AS (SELECT r, cell FROM (SELECT r, cell, row_number() OVER (PARTITION BY r ORDER BY y DESC, md5('prio:1:' || cell), cell) AS rnk FROM y) WHERE rnk <= {K}),
sets AS (SELECT r, list(cell ORDER BY cell) AS cells FROM code GROUP BY r)
SELECT doc_id, source, CAST(len(w) AS BIGINT) AS n_words, coalesce(cells, []) AS cells FROM words LEFT JOIN sets USING (r)
"""

_CONFIG = json.loads(audit_wiring.CONFIG.read_text())
_T = _CONFIG["thresholds"]
JOB2 = f"""
WITH wir AS (SELECT r_name AS region, s_nationkey AS dim, l_partkey AS cell, sum(CAST(l_quantity AS BIGINT)) AS w FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL),
kept AS (SELECT region, CAST(t AS INTEGER) AS threshold, dim, cell, w FROM wir JOIN (SELECT unnest({_T}) AS t) ON w >= t),
cells AS (SELECT region, threshold, cell, count(*) AS inputs, sum(w) AS weight FROM kept GROUP BY ALL),
c AS (SELECT region, threshold, sum(inputs) AS kept, sum(weight) AS weight, count(*) AS cells, avg(inputs) AS mean_inputs, median(inputs) AS median_inputs, max(inputs) AS max_inputs, count(*) FILTER (inputs = 1) AS single_input FROM cells GROUP BY ALL),
fan AS (SELECT region, threshold, dim, count(*) AS f FROM kept GROUP BY ALL),
d AS (SELECT region, threshold, count(*) AS dims, stddev_pop(f) / avg(f) AS cv, max(f) AS max_fan_out, arg_max(dim, f * 1000 - dim) AS top_dim FROM fan GROUP BY ALL),
pairs AS (SELECT a.region, a.threshold, a.dim AS x, b.dim AS y, count(*) AS s FROM kept a JOIN kept b ON a.region = b.region AND a.threshold = b.threshold AND a.cell = b.cell AND a.dim < b.dim GROUP BY ALL),
p AS (SELECT region, threshold, sum(s * s) AS q, sum(s * (s - 1) // 2) AS four_cycles FROM pairs GROUP BY ALL),
w AS (SELECT region, count(*) AS entries, sum(w) AS all_weight FROM wir GROUP BY ALL),
nd AS (SELECT c.region, threshold, draw, cell, inputs, u.dim, row_number() OVER (PARTITION BY c.region, threshold, draw, cell ORDER BY md5('null:{_CONFIG["seed"]}:' || draw || ':' || u.dim || ':' || cell), u.dim) AS r FROM cells c JOIN (SELECT DISTINCT region, dim FROM wir) u USING (region), range({_CONFIG["nulls"]}) t(draw)),
nk AS (SELECT * FROM nd WHERE r <= inputs),
np AS (SELECT a.region, a.threshold, a.draw, a.dim AS x, b.dim AS y, count(*) AS s FROM nk a JOIN nk b ON a.region = b.region AND a.threshold = b.threshold AND a.draw = b.draw AND a.cell = b.cell AND a.dim < b.dim GROUP BY ALL),
nq AS (SELECT region, threshold, draw, sum(s * s) AS q FROM np GROUP BY ALL),
nt AS (SELECT c.region, c.threshold, CAST(coalesce(p.q, 0) AS DOUBLE) AS real, CAST(coalesce(nq.q, 0) AS DOUBLE) AS v FROM c CROSS JOIN range({_CONFIG["nulls"]}) t(draw) LEFT JOIN p USING (region, threshold) LEFT JOIN nq ON nq.region = c.region AND nq.threshold = c.threshold AND nq.draw = t.draw),
ns AS (SELECT region, threshold, avg(v) AS m, stddev_samp(v) AS sd, any_value(real) AS real, (1 + count(*) FILTER (v >= real)) / (1 + count(*)) AS up, (1 + count(*) FILTER (v <= real)) / (1 + count(*)) AS lo FROM nt GROUP BY ALL)
SELECT round(m, 9) AS q_null_mean, round(sd, 9) AS q_null_sd, round(CASE WHEN sd > 0 THEN (real - m) / sd END, 6) AS q_z, round(up, 9) AS q_p_upper, round(lo, 9) AS q_p_lower, entries, CAST(kept AS BIGINT) AS kept, round(kept / entries, 9) AS kept_share, CAST(weight AS BIGINT) AS weight, round(weight / all_weight, 9) AS weight_share, cells, dims, round(mean_inputs, 9) AS mean_inputs, CAST(median_inputs AS DOUBLE) AS median_inputs,
  max_inputs, single_input, round(cv, 9) AS fan_out_cv, max_fan_out, CAST(top_dim AS BIGINT) AS top_dim, CAST(coalesce(q, 0) AS BIGINT) AS q, CAST(coalesce(four_cycles, 0) AS BIGINT) AS four_cycles, region, threshold
FROM c JOIN d USING (region, threshold) LEFT JOIN p USING (region, threshold) JOIN w USING (region) JOIN ns USING (region, threshold)
"""

QUERIES = {"job1_encode_documents": job1_encode_documents, "job2_audit_wiring": job2_audit_wiring}
ORACLE = {"job1_encode_documents": JOB1, "job2_audit_wiring": JOB2}
