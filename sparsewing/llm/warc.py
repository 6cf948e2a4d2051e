"""WARC archives with payload deduplication, and an external merge of their capture index.

Writing. Payloads are grouped by SHA-1; of equal payloads of at least ``min_payload`` bytes the record with the smallest
page id becomes a ``response``, the others ``revisit`` records that refer to it. Every task writes gzip-compressed records
(one member each) into files of about ``FILE_BYTES`` in the given folder under names of its own attempt, and returns their
names; only named files are read, so a lost executor or a repeated task leaves nothing double. Files are reached through
``pyarrow.fs``, whatever the store.

Reading. Each file is streamed record by record; a response's payload is digested again and must match its header.

Index. The captures of one file, sorted, form a run. Runs are cut by key ranges, and each range is merged from its runs by a
k-way loser tree on (url key, timestamp, page id), which gives the globally ordered capture history; range borders hold
all three columns, so a url with any share of the captures is cut too.

Edge cases: null html is an empty payload, null urls have an empty target and key, null page ids are written and read back
as null (they are never the referred record when another page shares the payload); repeated rows are records of their own;
texts may hold any characters; an empty table gives no archive and an empty index; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib
from datetime import datetime, timedelta, timezone
from functools import partial
from urllib.parse import quote, unquote

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparsewing.llm.common import bound_batches, checkpoint, partitions

FILE_BYTES = 64 << 20
EPOCH = datetime(2024, 1, 1, tzinfo=timezone.utc)
OUT = "page_id long, url string, ts string, payload_bytes long, payload_digest string, record_type string, refers_to long, file string, offset long, length long"


def _fs(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def _member(head: list[tuple[str, str]], body: bytes) -> bytes:
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in [*head, ("Content-Length", str(len(body)))]) + "\r\n"
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(text.encode()) + z.compress(body) + z.compress(b"\r\n\r\n") + z.flush()


def _write(frames, folder: str):
    fs, root = _fs(folder)
    fs.create_dir(root, recursive=True)
    out, name, size = None, "", 0
    done = []
    for f in frames:
        for page, url, html, digest, kind, refers in zip(f.page_id, f.url, f.html, f.digest, f.kind, f.refers_to, strict=True):
            page = None if pd.isna(page) else int(page)
            payload = (html or "").encode()
            when = (EPOCH + timedelta(seconds=(page or 0) % (10 * 366 * 86400))).strftime("%Y-%m-%dT%H:%M:%SZ")
            head = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", when), ("WARC-Target-URI", quote(url or "", safe=":/?#[]@!$&'()*+,;=%~-._")), ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Page-Id", "-" if page is None else str(page)), ("X-Url-Escaped", quote(url, safe="") if url is not None else "-"), ("X-Payload-Bytes", str(len(payload)))]
            http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
            if kind == "revisit":
                head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("X-Refers-To-Page", str(int(refers)))]
            body = http if kind == "revisit" else http + payload
            m = _member([*head, ("Content-Type", "application/http; msgtype=response")], body)
            if out is not None and size + len(m) > FILE_BYTES:
                out.close()
                done.append((name, size))
                out = None
            if out is None:
                name, size = f"{root}/{uuid.uuid4().hex}.warc.gz", 0
                out = fs.open_output_stream(name, compression=None)
            out.write(m)
            size += len(m)
    if out is not None:
        out.close()
        done.append((name, size))
    if done:
        yield pd.DataFrame(done, columns=["file", "bytes"])


def base32(raw: bytes) -> str:
    return base64.b32encode(raw).decode()


def _digest(frames):
    for f in frames:
        f["digest"] = [base32(hashlib.sha1((x or "").encode()).digest()) for x in f.html]
        yield f


def write_warc(pages: DataFrame, folder: str, min_payload: int = 0) -> DataFrame:
    """Writes one record per row of ``pages`` (page_id, url, html) and returns the written files (file, bytes)."""
    bound_batches(pages.sparkSession)
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    # the digest of each payload, by its row; texts are not shuffled for it
    sha = F.sha1(F.coalesce("html", F.lit("")).cast("binary"))
    p = p.withColumns({"sha": sha, "n": F.octet_length(F.coalesce("html", F.lit("")))})
    first = p.filter(F.col("n") >= min_payload).groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("rows")).filter("rows > 1 and first is not null")
    many = checkpoint(first.select("sha", "first"))
    if many.count() <= 1_000_000:
        many = F.broadcast(many)
    p = p.join(many, "sha", "left")
    kind = F.when(F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id")), "revisit").otherwise("response")
    p = p.select("page_id", "url", "html", F.lit("").alias("digest"), kind.alias("kind"), F.col("first").cast("long").alias("refers_to"))
    done = p.mapInPandas(lambda it: _write(_digest(it), folder), "file string, bytes long")
    return checkpoint(done)


def _records(data: io.BufferedIOBase):
    """(offset, length, header, body) of each gzip member of a stream."""
    z, start, at, raw, buf = zlib.decompressobj(31), 0, 0, b"", b""
    while True:
        if not buf:
            buf = data.read(1 << 20)
            if not buf:
                return
        raw += z.decompress(buf)
        if not z.eof:
            at += len(buf)
            buf = b""
            continue
        at += len(buf) - len(z.unused_data)
        head, _, body = raw.partition(b"\r\n\r\n")
        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        yield start, at - start, fields, body[: int(fields["Content-Length"])]
        buf, z, start, raw = z.unused_data, zlib.decompressobj(31), at, b""


def _read(frames, folder: str):
    fs, _ = _fs(folder)
    for f in frames:
        for name in f.file:
            rows = []
            with fs.open_input_stream(name, compression=None) as data:
                for offset, length, h, body in _records(data):
                    payload = body.partition(b"\r\n\r\n")[2]
                    revisit = h["WARC-Type"] == "revisit"
                    digest = h["WARC-Payload-Digest"][5:] if revisit else base32(hashlib.sha1(payload).digest())
                    if digest != h["WARC-Payload-Digest"][5:]:
                        raise ValueError(f"payload digest of {h['WARC-Record-ID']} in {name} does not match")
                    url = None if h["X-Url-Escaped"] == "-" else unquote(h["X-Url-Escaped"])
                    rows.append((None if h["X-Page-Id"] == "-" else int(h["X-Page-Id"]), url, h["WARC-Date"], int(h["X-Payload-Bytes"]) if revisit else len(payload), digest, h["WARC-Type"], int(h["X-Refers-To-Page"]) if revisit else None, name, offset, length))
            r = pd.DataFrame(rows, columns=[x.split()[0] for x in OUT.split(", ")])
            yield r.astype({"page_id": "Int64", "refers_to": "Int64"})


def read_warc(files: DataFrame, folder: str) -> DataFrame:
    """The captures of the named archives, one row per record."""
    spark = files.sparkSession
    return files.select("file").repartition(partitions(spark)).mapInPandas(partial(_read, folder=folder), OUT)


class LoserTree:
    """Merges sorted iterators: inner nodes keep the loser of their match, the winner climbs; one path is replayed an item."""

    def __init__(self, runs):
        self.runs = [iter(r) for r in runs]
        self.k = max(1, len(self.runs))
        self.head = [next(r, None) for r in self.runs] or [None]
        self.tree = [-1] * self.k
        for i in range(self.k):
            self._play(i)

    def _less(self, a: int, b: int) -> bool:
        x, y = self.head[a], self.head[b]
        return y is None or (x is not None and (x, a) < (y, b))

    def _play(self, i: int) -> None:
        node = (i + self.k) // 2
        while node > 0:
            other = self.tree[node]
            if other < 0:  # the first to come waits for its match
                self.tree[node] = i
                return
            if self._less(other, i):
                self.tree[node], i = i, other
            node //= 2
        self.tree[0] = i

    def __iter__(self):
        while True:
            i = self.tree[0]
            if i < 0 or self.head[i] is None:
                return
            yield self.head[i]
            self.head[i] = next(self.runs[i], None)
            self._play_again(i)

    def _play_again(self, i: int) -> None:
        node = (i + self.k) // 2
        while node > 0:
            other = self.tree[node]
            if self._less(other, i):
                self.tree[node], i = i, other
            node //= 2
        self.tree[0] = i


def _merge(frames):
    got = list(frames)
    if not got:
        return
    f = pd.concat(got, ignore_index=True)
    f = f.assign(url_key=f.url_key.fillna(""), order=f.page_id.fillna(-1).astype("int64"))
    runs = []
    for _, r in f.groupby("run", sort=True):
        r = r.sort_values(["url_key", "ts", "order"])
        runs.append(zip(r.url_key, r.ts, r.order, r.index, strict=True))
    at = [x[3] for x in LoserTree(runs)]
    yield f.loc[at].drop(columns=["run", "order"])


def url_key(url):
    """Host labels from the top down, then path and query, lower-cased; the scheme, ``www.`` and the fragment go."""
    rest = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(url, F.lit(""))), r"^[^:/?#]*://", ""), r"#.*$", "")
    host = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*", 0), r"^www\.", "")
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.regexp_extract(rest, r"^[^/?]*(.*)$", 1))


def capture_index(captures: DataFrame) -> DataFrame:
    """Captures in global order of (url key, timestamp, page id): the partitions of the result are consecutive ranges."""
    spark = captures.sparkSession
    c = captures.withColumns({"url_key": url_key(F.col("url")), "run": F.col("file")})
    c = c.repartitionByRange(partitions(spark), "url_key", "ts", "page_id")
    return c.mapInPandas(_merge, OUT + ", url_key string")
