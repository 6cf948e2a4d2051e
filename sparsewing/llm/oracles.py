"""SQL statements of the queries that SQL can express, for DuckDB."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LOW = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
#: (node, root) pairs of everything that links reach; the smallest root is the component.
REACH = "both_ AS (SELECT a AS u, b AS v FROM links UNION SELECT b, a FROM links), reach(node, root) AS (SELECT u, u FROM both_ UNION SELECT v, root FROM reach JOIN both_ ON node = u)"

OP1 = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOW}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' ')) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
{REACH}
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(c, d.doc_id) AS component_id, coalesce(c, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT node, min(root) AS c FROM reach GROUP BY node) ON node = d.doc_id
"""

_SAID = "\\### Assistant: </turn> ok"
OP4 = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{_SAID}' UNION ALL SELECT -7, 1, 'assistant', '{_SAID}'),
e AS (SELECT *, replace(replace(replace(text, '\\', '\\\\'), '</turn>', '<\\/turn>'), '##', '#\\#') AS hard, replace(replace(replace(replace(role, '\\', '\\\\'), '</turn>', '<\\/turn>'), '##', '#\\#'), chr(10), '\\n') AS r FROM c),
a AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS told, coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (lower(role) = 'assistant'), '') AS loss,
  CAST(sum(14 + length(r) + length(CASE WHEN contains(text, '</turn>') OR contains(text, '###') THEN hard ELSE text END)) AS BIGINT) AS formatted_chars FROM e GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(told) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM a
"""


def _rule(host: str, path: str, what: str) -> str:
    """The longest of the four rules that fits."""
    rules = [("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"), ("block", "net", "/")]
    arms = " ".join(f"WHEN ({host} = '{h}' OR {host} LIKE '%.{h}') AND starts_with({path}, '{p}') THEN '{h + p if what == 'rule' else a}'" for a, h, p in rules)
    return f"CASE {arms} END"


_HOST = f"CASE WHEN contains({{0}}, '://') THEN translate(regexp_extract(substr({{0}}, strpos({{0}}, '://') + 3), '^[^/?#]*'), '{UPPER}', '{LOWER}') ELSE '' END"
_PATH = "CASE WHEN contains({0}, '://') THEN regexp_extract(substr({0}, strpos({0}, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END"
_NODE = "h || CASE WHEN p = '' THEN '/' ELSE p END || regexp_extract({0}, '^[^?#]*(\\?[^#]*)?', 1)"
OP6 = f"""
WITH RECURSIVE pg AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html, {_HOST.format("coalesce(url, '')")} AS h, {_PATH.format("coalesce(url, '')")} AS p FROM pages),
nd AS (SELECT *, CASE WHEN h <> '' THEN {_NODE.format("url")} END AS node FROM pg),
t AS (SELECT node, h, p, unnest([regexp_extract(regexp_extract(html, '(?is)<link\\b[^>]*\\brel\\s*=\\s*["'']?canonical\\b[^>]*>'), '(?is)\\bhref\\s*=\\s*["'']?([^"''\\s>]*)', 1), regexp_extract(regexp_extract(html, '(?is)<meta\\b[^>]*http-equiv\\s*=\\s*["'']?refresh\\b[^>]*>'), '(?is)\\burl\\s*=\\s*["'']?([^"''\\s>;]+)', 1)]) AS x FROM nd WHERE node IS NOT NULL),
tt AS (SELECT node, CASE WHEN contains(x, '://') THEN x WHEN starts_with(x, '//') THEN 'http:' || x WHEN starts_with(x, '/') THEN 'http://' || h || x ELSE 'http://' || h || regexp_extract(p, '^(.*/)?') || x END AS x FROM t WHERE x <> ''),
tn AS (SELECT node, x, {_HOST.format("x")} AS h, {_PATH.format("x")} AS p FROM tt),
links AS (SELECT node AS a, {_NODE.format("x")} AS b FROM tn),
{REACH},
comp AS (SELECT node, min(root) AS c, regexp_extract(node, '^[^/?#]*') AS h, regexp_extract(node, '^[^/?#]*([^?#]*)', 1) AS p FROM reach GROUP BY node),
said AS (SELECT c, bool_or({_rule("h", "p", "action")} = 'allow') AS a, bool_or({_rule("h", "p", "action")} = 'block') AS b FROM comp GROUP BY c)
SELECT page_id, nd.h AS host, nd.p AS path, {_rule("nd.h", "nd.p", "rule")} AS rule, coalesce({_rule("nd.h", "nd.p", "action")}, CASE WHEN a THEN 'allow' WHEN b THEN 'block' END, 'allow') AS verdict
FROM nd LEFT JOIN comp ON comp.node = nd.node LEFT JOIN said ON said.c = comp.c
"""

OP7 = f"""
WITH RECURSIVE e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0 AND len(list_filter(embedding, lambda v: v <> 0)) > 0),
links AS (SELECT s.vec_id AS a, t.vec_id AS b FROM e s JOIN e t ON s.label = t.label AND s.vec_id < t.vec_id AND len(s.x) = len(t.x) WHERE list_cosine_similarity(s.x, t.x) >= 0.98),
{REACH}
SELECT v.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, coalesce(c, v.vec_id) AS component_id, coalesce(c, v.vec_id) = v.vec_id AS kept
FROM embeddings v LEFT JOIN (SELECT u, count(*) AS n FROM both_ GROUP BY u) ON u = v.vec_id LEFT JOIN (SELECT node, min(root) AS c FROM reach GROUP BY node) ON node = v.vec_id
"""

_BW = "regexp_extract_all({}, '[a-z0-9[:^ascii:]]+')"
OP8 = f"""
WITH d AS (SELECT doc_id, {_BW.format(LOW)} AS w FROM documents),
b AS (SELECT item_id, {_BW.format(LOW)} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(13, len(w)) AS l, unnest(list_transform(range(1, greatest(len(w) - 12, 1) + 1), lambda i: array_to_string(w[i : i + least(13, len(w)) - 1], ' '))) AS s FROM b WHERE len(w) > 0),
pos AS (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM d, (SELECT DISTINCT l FROM win) WHERE len(w) >= l),
hit AS (SELECT doc_id, item_id, i, p.l FROM (SELECT doc_id, i, l, array_to_string(w[i : i + l - 1], ' ') AS s FROM pos) p JOIN win ON win.l = p.l AND win.s = p.s),
cov AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(i, i + l)) FROM hit) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n, string_agg(k, ',' ORDER BY k) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(it.n, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(cov.n, 0) > 0 AND 20 * coalesce(cov.n, 0) >= len(w) AS contaminated
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN it USING (doc_id)
"""

_NIBBLES = ", ".join(f"'{i:04b}'" for i in range(16))
_B32 = "array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + " + " + ".join(f"{16 >> k} * CAST(substr(bits, 5 * i + {k + 1}, 1) AS INTEGER)" for k in range(5)) + ", 1)), '')"
OP10 = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, coalesce(url, '') AS url, sha1(coalesce(html, '')) AS h, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages),
b AS (SELECT *, array_to_string(list_transform(range(1, 41), lambda i: ([{_NIBBLES}])[strpos('0123456789abcdef', substr(h, i, 1))]), '') AS bits, regexp_replace(regexp_replace(lower(url), '^[^:/?#]*://', ''), '#.*$', '') AS rest FROM p)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, {_B32} AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to,
  array_to_string(list_reverse(string_split(regexp_replace(regexp_extract(rest, '^[^/?]*'), '^www\\.', ''), '.')), ',') || ')' || regexp_extract(rest, '^[^/?]*(.*)$', 1) AS url_key,
  strftime(TIMESTAMP '2024-01-01' + to_seconds(page_id), '%Y-%m-%dT%H:%M:%SZ') AS ts
FROM b
"""


def _centroids(rounds: int) -> str:
    """Lloyd's rounds, each as two tables: the assignment (d * 64 + c is least for the nearest, then the smaller number), then the
    floors of the means."""
    dist = "list_sum(list_transform(list_zip(k.q, c.q), lambda t: (t[1] - t[2]) * (t[1] - t[2])))"
    out = [
        "k AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda v: CAST(floor(256 * v) AS BIGINT)) AS q FROM embeddings"
        " WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v) OR abs(v) >= 524288)) = 0)",
        "c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, q) - 1 AS c, q FROM (SELECT q, sha256('2:' || vec_id) AS h FROM k WHERE vec_id IS NOT NULL ORDER BY h, q LIMIT 40))",
    ]
    for i in range(rounds + 1):
        out.append(f"a{i} AS MATERIALIZED (SELECT r, x % 64 AS c, x // 64 AS d FROM (SELECT k.r, min(CAST({dist} AS BIGINT) * 64 + c.c) AS x FROM k CROSS JOIN c{i} c GROUP BY k.r))")
        if i < rounds:
            out.append(
                f"m{i} AS (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY j) AS q FROM (SELECT c, j, sum(v) AS s, count(*) AS n FROM"
                f" (SELECT a.c, unnest(k.q) AS v, unnest(range(64)) AS j FROM a{i} a JOIN k USING (r)) GROUP BY c, j) GROUP BY c),"
                f" c{i + 1} AS MATERIALIZED (SELECT c.c, coalesce(m.q, c.q) AS q FROM c{i} c LEFT JOIN m{i} m USING (c))"
            )
    return "WITH " + ",\n".join(out)


OP11 = f"""
{_centroids(5)}
SELECT vec_id, CAST(a.c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.q, ',')) AS centroid_sha256
FROM a5 a JOIN k USING (r) JOIN c5 c ON c.c = a.c
"""


ORACLE = {
    "op1_minhash_near_dedup": OP1,
    "op4_chat_formatting": OP4,
    "op6_url_filters": OP6,
    "op7_embedding_near_dedup": OP7,
    "op8_benchmark_decontamination": OP8,
    "op10_warc_index_merge": OP10,
    "op11_centroid_clustering": OP11,
}
