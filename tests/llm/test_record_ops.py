import base64
import hashlib
import random

import numpy as np

from sparsewing.llm import chat, pivots, urlfilter, warc
from sparsewing.llm.trie import EliasFano, Trie, quantise
from tests.llm.brute import reach


def test_chat_round_trip(spark):
    g = random.Random(1)
    bits = ["</turn>", "\n", "\\", "###", "##", "#", "### user:\n", "<\\/turn>", "a", "é", " ", "###\\assistant:\n", "\\\\", "<", "/turn>"]
    conv = {}
    for c in range(60):
        conv[c] = [(t, g.choice(["user", "assistant", "system", "a\\", "x\ny", ""]), "".join(g.choice(bits) for _ in range(g.randint(0, 8)))) for t in range(g.randint(1, 5))]
    rows = [(c, *t, 1) for c, ts in conv.items() for t in ts] + [(70, 0, None, None, 1), (None, 0, "user", "x", 1), (71, 0, "assistant", "b", 1), (71, 0, "assistant", "a", 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, loss int").repartition(3)
    back = chat.read_back(chat.format_chats(df))
    got = {r.conv_id: r for r in chat.digests(back).collect()}
    turns = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in back.collect()}
    conv = {c: [(r, x) for _, r, x in ts] for c, ts in conv.items()} | {70: [("", "")], None: [("user", "x")], 71: [("assistant", "a"), ("assistant", "b")]}
    for c, ts in conv.items():
        assert turns[c] == ts
        loss = "".join(x for r, x in ts if r == "assistant")
        told = "".join(f"{r}\n{x}\n" for r, x in ts)
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (len(ts), hashlib.sha256(told.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert len(got) == len(conv)
    assert chat.format_chats(df.limit(0)).count() == 0


def test_url_rules_and_aliases(spark):
    pages = [
        (1, "http://a.example.com/de/x", None),
        (2, "http://A.Example.org/p", '<link rel="canonical" href="http://a.example.com/de/x">'),
        (3, "https://www.example.net/en/1?q#f", ""),
        (4, "http://other.net", ""),
        (5, "http://other.net/x", ""),
        (6, "http://b.org/fr/1", "<link href='http://bad.net/z' rel=canonical>"),
        (7, "http://c.org/q", '<meta http-equiv="refresh" content="0; url=http://b.org/fr/1">'),
        (8, None, None),
        (9, "no scheme", "x"),
        (10, "http://d.org/a/b", '<link rel="canonical" href="/c">'),
        (11, "http://d.org/c", "<meta http-equiv=refresh content='0;url=//x.net/'>"),
        (11, "http://d.org/c", None),
    ]
    df = spark.createDataFrame([(*p, "v") for p in pages], "page_id long, url string, html string, verdict string")
    got = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge(df).collect()}
    assert got == {
        (1, "a.example.com", "/de/x", "example.com/de/", "block"),
        (2, "a.example.org", "/p", None, "block"),  # canonical link to a blocked page
        (3, "www.example.net", "/en/1", "example.net/en/", "allow"),
        (4, "other.net", "", None, "allow"),  # an empty path does not start with /
        (5, "other.net", "/x", "net/", "block"),
        (6, "b.org", "/fr/1", "org/fr/", "allow"),
        (7, "c.org", "/q", None, "allow"),  # an explicit allow in its component goes before the block
        (8, "", "", None, "allow"),
        (9, "", "", None, "allow"),
        (10, "d.org", "/a/b", None, "block"),
        (11, "d.org", "/c", None, "block"),
    }
    assert urlfilter.judge(df.limit(0)).count() == 0


def test_joined_rules_equal_compiled_ones(spark):
    df = spark.createDataFrame([("a.b.net", "/"), ("net", "/x"), ("xnet", "/x"), ("example.net", "/en/1"), ("q.example.com", "/de/"), ("", "")], "host string, path string")
    small = {(r.host, r.path): (r.action, r.rule) for r in urlfilter.with_rule(df, urlfilter.RULES).collect()}
    many = urlfilter.RULES + [("block", f"h{i}.test", "/") for i in range(urlfilter.COMPILED)]
    assert {(r.host, r.path): (r.action, r.rule) for r in urlfilter.with_rule(df, many).collect()} == small


def vectors(seed=3):
    g = np.random.default_rng(seed)
    rows, i = [], 0
    for label in (0, 1, None):
        for _ in range(12):
            c = g.standard_normal(16)
            for _ in range(g.integers(1, 8)):
                x = c + g.standard_normal(16) * 0.05 * np.linalg.norm(c) / 4
                rows.append((i, [float(np.float32(v)) for v in x], label))
                i += 1
    rows += [(i, rows[0][1], 0), (i + 1, rows[0][1], 0), (i + 2, None, 0), (i + 3, [0.0] * 16, 0), (i + 4, [float("nan")] * 16, 0), (i + 5, [None, 1.0], 0), (i + 6, [1.0, 2.0], 0), (i + 7, [2.0, 4.0], 0), (i + 8, [], 0)]
    return rows


def test_pivots_against_brute_force(spark):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    ok = {i: np.array(x) for i, x, lab in rows if lab is not None and x and None not in x and np.isfinite(x).all() and any(x)}
    lab = {i: z for i, _, z in rows}
    links = [(a, b) for a in ok for b in ok if a < b and lab[a] == lab[b] and len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] / np.sqrt((ok[a] @ ok[a]) * (ok[b] @ ok[b])) >= 0.98]
    comp = reach([r[0] for r in rows], links)
    deg = {r[0]: 0 for r in rows}
    for a, b in links:
        deg[a] += 1
        deg[b] += 1
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in pivots.near_vectors(df).collect()}
    assert sum(deg.values()) > 100
    found = sum(v[0] for v in got.values())
    assert found >= 0.9 * sum(deg.values()) and all(got[i][0] <= deg[i] for i in deg)
    assert got == {i: (deg[i], comp[i], comp[i] == i) for i in deg}
    assert pivots.near_vectors(df.limit(0)).count() == 0


def test_pivots_in_a_dense_group(spark):
    """A third of the rows, none equal, within the threshold of each other: no link is missed."""
    g = np.random.default_rng(7)
    c = g.standard_normal(64)
    c /= np.linalg.norm(c)
    near = c + g.standard_normal((200, 64)) * 0.0135
    rest = g.standard_normal((400, 64))
    x = np.concatenate([near, rest, rest[:50] + g.standard_normal((50, 64)) * 0.1]).astype(np.float32)
    df = spark.createDataFrame([(i, r.tolist(), 0) for i, r in enumerate(x)], "vec_id long, embedding array<float>, label int").repartition(3)
    y = x.astype(np.float64)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    link = y @ y.T >= 0.98
    np.fill_diagonal(link, False)
    assert link[:200, :200].sum() > 30_000 and link[200:].sum() >= 90
    comp = reach(range(len(x)), [(int(a), int(b)) for a, b in zip(*np.nonzero(link), strict=True) if a < b])
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in pivots.near_vectors(df).collect()}
    assert got == {i: (int(link[i].sum()), comp[i], comp[i] == i) for i in range(len(x))}


def test_warc_round_trip(spark, tmp_path):
    g = random.Random(5)
    body = ["", "<p>x</p>", "é\r\n\r\nWARC/1.1", "x" * 5000]
    pages = [(i, g.choice(["http://www.a.org/é?q=1 2", "https://b.com/x#y", None, "http://c.net/\n"]), g.choice([*body, f"page {i}", None])) for i in range(80)] + [(3, "http://b.com/x", "page 3"), (None, "http://b.com/x", "x" * 5000)]
    df = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, kind int").repartition(4)
    for least in (0, 3):
        folder = f"file://{tmp_path}/w{least}"
        got = warc.read_warc(warc.write_warc(df, folder, least), folder)
        rows = got.collect()
        first = {}
        for p, _, h in pages:
            if p is not None and len((h or "").encode()) >= least:
                first[h or ""] = min(p, first.get(h or "", p))
        times = {}
        for _, _, h in pages:
            times[h or ""] = times.get(h or "", 0) + 1
        want = []
        for p, u, h in pages:
            raw = (h or "").encode()
            to = first.get(h or "") if times[h or ""] > 1 else None
            again = to is not None and to != p
            want.append((p, u, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", to if again else None))
        assert sorted(map(repr, want)) == sorted(repr((r.page_id, r.url, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in rows)
        index = warc.capture_index(got).collect()
        keys = [(r.url_key, r.ts, -1 if r.page_id is None else r.page_id) for r in index]
        assert keys == sorted(keys) and len(keys) == len(pages)
    assert warc.capture_index(warc.read_warc(warc.write_warc(df.limit(0), f"file://{tmp_path}/none"), f"file://{tmp_path}/none")).count() == 0


def test_loser_tree():
    g = random.Random(2)
    for k in (0, 1, 2, 3, 7, 16):
        runs = [sorted((g.randrange(50), i) for i in range(g.randint(0, 20))) for _ in range(k)]
        assert list(warc.LoserTree(runs)) == sorted(x for r in runs for x in r)


def test_elias_fano_and_trie(tmp_path):
    g = np.random.default_rng(1)
    for n, top in ((1, 5), (1000, 1 << 62), (5000, 6000), (20, 20)):
        v = np.unique(g.integers(0, top, n).astype(np.uint64))
        e = EliasFano.build(v)
        assert (e.get(np.arange(len(v))) == v).all()
        q = np.concatenate([v, g.integers(0, top, 500).astype(np.uint64)])
        at = {int(x): i for i, x in enumerate(v)}
        assert e.find(q).tolist() == [at.get(int(x), -1) for x in q]
    ctx = np.array([5, 9, 1 << 60], dtype=np.uint64)
    first, word = np.array([0, 2, 2, 3]), np.array([3, 8, 3], dtype=np.uint64)
    path = str(tmp_path / "t")
    Trie.write(path, ctx, first, word, quantise(np.array([0.5, 1.0, 0.1])), quantise(np.array([0.1, 0.01, 1.0])))
    code, back = Trie(path).search(np.array([5, 5, 5, 9, 1 << 60, 7], dtype=np.uint64), np.array([3, 8, 9, 3, 3, 3], dtype=np.uint64))
    assert code.tolist() == [32, 64, -1, -1, 0, -1] and back.tolist() == [10, 10, 10, 0, 32, 0]


def test_pivots_keep_double_components(spark):
    """A cosine within 1e-12 of the threshold is told apart where the table holds doubles."""
    at = lambda c: [c, float(np.sqrt(1 - c * c))]
    rows = [(1, [1.0, 0.0], 1), (2, at(0.98 + 1e-12), 1), (3, [1.0, 0.0], 2), (4, at(0.98 - 1e-12), 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in pivots.near_vectors(df).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (0, 3), 4: (0, 4)}
