"""Named common table expressions of the SQL statements, in order of dependence."""

from __future__ import annotations

M, S, K, TOP, QUERIES = 640, 6, 16, 20, 50

CTE = {
    "items": "SELECT vec_id AS item_id, list_transform(embedding, lambda x: CAST(round(CAST(x AS DOUBLE) * 1000000) AS BIGINT)) AS q, CAST(label AS BIGINT) AS label FROM embeddings",
    "long": "SELECT item_id, label, unnest(range(len(q))) AS dim, unnest(q) AS v FROM items",
    "cent": "SELECT item_id, dim, CAST(count(*) OVER (PARTITION BY item_id) * v - sum(v) OVER (PARTITION BY item_id) AS BIGINT) AS v FROM long",
    "pos": "SELECT item_id, dim, greatest(v, 0) AS v FROM long",
    "wir": f"SELECT dim, cell, 1 AS w FROM (SELECT cell, dim, row_number() OVER (PARTITION BY cell ORDER BY md5('w:7:' || dim || ':' || cell), dim) AS r FROM range({M}) a(cell), range(64) b(dim)) WHERE r <= {S}",
    "drive": "SELECT item_id, cell, CAST(sum(v * w) AS BIGINT) AS y FROM cent JOIN wir USING (dim) GROUP BY item_id, cell",
    "code": f"SELECT * FROM (SELECT item_id, cell, y, row_number() OVER (PARTITION BY item_id ORDER BY y DESC, md5('prio:1:' || cell), cell) AS rnk FROM drive) WHERE rnk <= {K}",
    "queries": f"SELECT item_id AS query_id FROM items ORDER BY md5('q:3:' || item_id), item_id LIMIT {QUERIES}",
    "train": "SELECT item_id FROM items ORDER BY md5('train:4:' || item_id), item_id LIMIT 200",
    "gap": "SELECT query_id, b.item_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda t: (t[1] - t[2]) * (t[1] - t[2]))) AS BIGINT) AS d FROM queries JOIN items a ON a.item_id = query_id JOIN items b ON b.item_id <> query_id",
    "true": f"SELECT * FROM (SELECT query_id, item_id, d, row_number() OVER (PARTITION BY query_id ORDER BY d, item_id) AS rnk FROM gap) WHERE rnk <= {TOP}",
    "shared": "SELECT query_id, c.item_id, count(*) AS both_ FROM queries JOIN code q ON q.item_id = query_id JOIN code c ON c.cell = q.cell AND c.item_id <> query_id GROUP BY query_id, c.item_id",
    "ham": f"SELECT query_id, i.item_id, CAST({2 * K} - 2 * coalesce(both_, 0) AS BIGINT) AS d FROM queries JOIN items i ON i.item_id <> query_id LEFT JOIN shared s USING (query_id, item_id)",
    "pred": f"SELECT * FROM (SELECT query_id, item_id, d, row_number() OVER (PARTITION BY query_id ORDER BY d, md5('tie:5:' || query_id || ':' || item_id), item_id) AS rnk FROM ham) WHERE rnk <= {TOP}",
    "hits": "SELECT p.query_id, p.rnk, CASE WHEN t.item_id IS NULL THEN 0 ELSE 1 END AS hit FROM pred p LEFT JOIN true t ON t.query_id = p.query_id AND t.item_id = p.item_id",
    "prec": "SELECT query_id, hit, CASE WHEN hit = 1 THEN sum(hit) OVER (PARTITION BY query_id ORDER BY rnk ROWS UNBOUNDED PRECEDING) / rnk ELSE 0.0 END AS p FROM hits",
    "ap": f"SELECT query_id, round(sum(p) / {TOP}, 9) AS ap, round(sum(p) / greatest(sum(hit), 1), 9) AS ap_retrieved, round(sum(hit) / {TOP}, 9) AS recall FROM prec GROUP BY query_id",
    "by_pre": "SELECT CAST(s_nationkey AS BIGINT) AS dim, l_partkey AS cell, l_suppkey AS pre, sum(CAST(l_quantity AS BIGINT)) AS w FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL",
    "wall": "SELECT dim, cell, CAST(sum(w) AS BIGINT) AS w, count(*) AS partners FROM by_pre GROUP BY dim, cell",
    "w50": "SELECT * FROM wall WHERE w >= 50",
    "resp": "SELECT user_id AS item, event_type || ':' || hour(ts) AS dim, avg(value) AS v FROM events GROUP BY ALL",
}


def sql(names: str, body: str) -> str:
    """``WITH`` the named expressions (and what they depend on), then ``body``."""
    need = set(names.split())
    while True:
        more = {n for n in CTE if any(_uses(CTE[k], n) for k in need)} | need
        if more == need:
            break
        need = more
    parts = [f'"{n}" AS ({_quoted(CTE[n])})' for n in CTE if n in need]
    return f"WITH {', '.join(parts)} {_quoted(body)}" if parts else body


def _uses(text: str, name: str) -> bool:
    import re

    return re.search(rf"\b(FROM|JOIN) {name}\b", text) is not None


def _quoted(text: str) -> str:
    import re

    return re.sub(r"\b(FROM|JOIN) true\b", r'\1 "true"', text)
