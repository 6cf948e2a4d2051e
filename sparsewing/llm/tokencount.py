"""Token counts by finite-state transducers, for byte-pair vocabularies with word ends (a tokenizers .json file).

Two deterministic transducers are compiled from the file. ``SPLIT`` reads classes of characters and marks where a piece of
the pre-tokenizer's pattern begins. A block of texts is cut into chunks of ``CHUNK`` characters wherever they fall; all chunks
run side by side from every state, which gives a map of states for each, and a parallel prefix scan composes the maps into
the state that each chunk really enters in.

``Merges`` reads the symbols of a piece, the last of which is the byte with the word's end, and every transition carries the
number of tokens that it adds to (or takes from) the encoding of what has been read. It rests on this: the encoding of a
prefix ends in exactly one token t such that t may follow the last token of the encoding before t, that is, no merge across the
two would have come before those that made them. A state therefore holds, for every start whose symbols so far begin some
token, the node of that token's trie, the last token before the start, and the tokens since. Transitions are made
when first taken and kept as arrays, so all pieces of a block step together; when they pass ``CELLS`` entries they are dropped
and made anew, which changes no result.

The file is read and compiled on the driver (its size does not depend on the data) and broadcast. Texts are counted
where they are read, without a shuffle, in blocks of bounded size; a text beyond a block makes a block of its own.

Edge cases: null and empty texts have no tokens; a special token's string within a text is one token and parts the
text there; ids may be null or repeat; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparsewing.llm.common import blocks, bound_batches, bytes_of

CHUNK, CELLS, LONG = 256, 1 << 24, 1 << 12
# ---------------------------------------------------------------- splitting
# The pattern that SPLIT stands for.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPACE, NUMBER, LETTER, OTHER, QUOTE, ENDS, R, V, E, DOUBLE = range(10)
START, WORD, SIGNS, QUOTED, AFTER_R, AFTER_V, AFTER_L = range(7)
HERE, BEFORE = 1, 2  # a piece begins at this character; at the one before


def split_transducer() -> tuple[np.ndarray, np.ndarray]:
    """(next state, marks) by state and class. After a quote that begins a piece, one or two letters may close a contraction; if
    the second does not, the first was the beginning of a word, which is marked one character late."""
    begin = {SPACE: (START, 0), NUMBER: (START, HERE), OTHER: (SIGNS, HERE), QUOTE: (QUOTED, HERE)}
    fresh = [begin.get(c, (WORD, HERE)) for c in range(10)]
    signs = list(fresh)
    signs[OTHER] = signs[QUOTE] = (SIGNS, 0)
    quoted = list(signs)
    for c, to in ((ENDS, START), (R, AFTER_R), (V, AFTER_V), (DOUBLE, AFTER_L)):
        quoted[c] = (to, 0)
    word = [begin.get(c, (WORD, 0)) for c in range(10)]
    rows = [fresh, word, signs, quoted]
    for closing in (E, E, DOUBLE):
        late = [(to, m | BEFORE) for to, m in word]
        late[closing] = (START, 0)
        rows.append(late)
    table = np.array(rows, dtype=np.uint8)
    return table[:, :, 0].copy(), table[:, :, 1].copy()


NEXT, MARK = split_transducer()


def starts(kind: np.ndarray) -> np.ndarray:
    """Positions at which pieces begin, given the classes of all characters. The last class must be a space."""
    n = len(kind)
    k = max(1, -(-n // CHUNK))
    grid = np.zeros((k, CHUNK), dtype=np.uint8)  # padded with spaces
    grid.reshape(-1)[:n] = kind
    maps = np.tile(np.arange(len(NEXT), dtype=np.uint8), (k, 1))
    for t in range(CHUNK):
        maps = NEXT[maps, grid[:, t, None]]
    step = 1
    while step < k:  # after each pass a map covers twice as many chunks
        maps[step:] = np.take_along_axis(maps[step:], maps[:-step].copy(), axis=1)
        step *= 2
    state = np.concatenate(([START], maps[:-1, START])).astype(np.uint8)
    marks = np.empty_like(grid)
    for t in range(CHUNK):
        marks[:, t] = MARK[state, grid[:, t]]
        state = NEXT[state, grid[:, t]]
    marks = marks.reshape(-1)[:n]
    out = marks & HERE
    out[:-1] |= (marks[1:] & BEFORE) >> 1
    return np.flatnonzero(out)


# ---------------------------------------------------------------- merging
class Merges:
    """The transducer over symbols 0..255 (bytes) and 256..511 (last bytes): ``left``/``right`` are the symbols or tokens that
    token 512 + i is made of, in order of their merges."""

    def __init__(self, left: np.ndarray, right: np.ndarray):
        self.left, self.right = left.tolist(), right.tolist()
        self.pairs = {(a << 20) | b: 512 + i for i, (a, b) in enumerate(zip(self.left, self.right, strict=True))}
        self.follows: dict[int, bool] = {}
        self.child: dict[int, int] = {}
        self.token, self.inner = [-1], [False]
        for t in range(512 + len(self.left)):
            s = self.symbols(t)
            if self.whole(t, s):
                node = 0
                for x in s:
                    self.inner[node] = True
                    key = node << 9 | x
                    if key not in self.child:
                        self.child[key] = len(self.token)
                        self.token.append(-1)
                        self.inner.append(False)
                    node = self.child[key]
                self.token[node] = t
        self.forget()

    def symbols(self, t: int) -> list[int]:
        out, todo = [], [t]
        while todo:
            x = todo.pop()
            if x < 512:
                out.append(x)
            else:
                todo += [self.right[x - 512], self.left[x - 512]]
        return out

    def whole(self, t: int, s: list[int]) -> bool:
        """Whether the merges turn the symbols of a token into that token: the least merge first, the leftmost of equal ones."""
        s = list(s)
        while len(s) > 1:
            found = [self.pairs.get(a << 20 | b, sys.maxsize) for a, b in zip(s, s[1:], strict=False)]
            best = min(found)
            if best == sys.maxsize:
                return False
            i = found.index(best)
            s[i : i + 2] = [best]
        return s == [t]

    def may_follow(self, a: int, b: int) -> bool:
        """Whether token b can stand after token a: undoing their merges, the latest first, no merge across the two comes before
        the one undone. Of equal merges the left one was done first."""
        key = a << 20 | b
        got = self.follows.get(key)
        if got is None:
            limit, got = sys.maxsize, True
            while True:
                if self.pairs.get(a << 20 | b, sys.maxsize) < limit:
                    got = False
                    break
                if a < 512 and b < 512:
                    break
                if a > b:
                    limit, a = a, self.right[a - 512]
                else:  # of one merge on both sides the right one is undone first: it was done last
                    limit, b = b + 1, self.left[b - 512]
            self.follows[key] = got
        return got

    def forget(self) -> None:
        """Only the first state is left, in which nothing has been read."""
        self.states: list[tuple] = [((0, -1, 0),)]
        self.ids = {self.states[0]: 0}
        self.columns: dict[int, int] = {}
        self.column = np.full(512, -1, dtype=np.int64)
        self.next = np.full((256, 64), -1, dtype=np.int32)
        self.added = np.zeros((256, 64), dtype=np.int16)

    def step(self, state: tuple, x: int) -> tuple[tuple, int]:
        """The state after symbol x and the tokens it adds. In a state, (node, last token before, tokens before less tokens now)."""
        grown = [(self.child[k], last, rel) for node, last, rel in state if (k := node << 9 | x) in self.child]
        ends = [(self.token[n], rel + 1) for n, last, rel in grown if self.token[n] >= 0 and (last < 0 or self.may_follow(last, self.token[n]))]
        if len(ends) != 1:
            raise ValueError("the merges do not define one encoding")
        token, more = ends[0]
        return (*((n, last, rel - more) for n, last, rel in grown if self.inner[n]), (0, token, 0)), more

    def _make(self, state: np.ndarray, symbol: np.ndarray) -> None:
        """Makes the transitions that are missing."""
        for s, x in {(int(s), int(x)) for s, x in zip(state, symbol, strict=True)}:
            c = self.columns.setdefault(x, len(self.columns))
            if c >= self.next.shape[1]:
                self.next = np.concatenate([self.next, np.full_like(self.next, -1)], axis=1)
                self.added = np.concatenate([self.added, np.zeros_like(self.added)], axis=1)
            self.column[x] = c
            if self.next[s, c] >= 0:
                continue
            to, more = self.step(self.states[s], x)
            i = 0  # after a last byte nothing follows
            if x < 256:
                i = self.ids.setdefault(to, len(self.states))
                if i == len(self.states):
                    self.states.append(to)
                    if i >= len(self.next):
                        self.next = np.concatenate([self.next, np.full_like(self.next, -1)])
                        self.added = np.concatenate([self.added, np.zeros_like(self.added)])
            self.next[s, c], self.added[s, c] = i, more

    def _one(self, symbols: np.ndarray) -> int:
        """A long piece, step by step; states are dropped on the way where they grow too many."""
        state, total, known = self.states[0], 0, {}
        for x in symbols.tolist():
            got = known.get((state, x))
            if got is None:
                if len(known) > 1 << 16:
                    known.clear()
                got = known[state, x] = self.step(state, x)
            state, more = got
            total += more
        return total

    def count(self, data: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Tokens of the pieces data[first : first + size]."""
        if self.next.size > CELLS or len(self.follows) > CELLS >> 3:
            self.follows.clear()
            self.forget()
        out = np.zeros(len(first), dtype=np.int64)
        for i in np.flatnonzero(size > LONG).tolist():
            x = data[first[i] : first[i] + size[i]].astype(np.int64)
            x[-1] += 256
            out[i] = self._one(x)
        at = np.flatnonzero(size <= LONG)
        at = at[np.argsort(-size[at], kind="stable")]
        state, left, t = np.zeros(len(at), dtype=np.int64), size[at], 0
        while len(at):
            x = data[first[at] + t].astype(np.int64) + np.where(left == t + 1, 256, 0)
            c = self.column[x]
            bad = (c < 0) | (self.next[state, np.maximum(c, 0)] < 0)
            if bad.any():
                self._make(state[bad], x[bad])
                c = self.column[x]
            out[at] += self.added[state, c]
            state, t = self.next[state, c].astype(np.int64), t + 1
            k = int(np.searchsorted(-left, -t))  # pieces of more than t bytes come first
            at, state, left = at[:k], state[:k], left[:k]
        return out


# ---------------------------------------------------------------- compiling
class Compiled:
    """What the file says: the merges, the special strings, and the class of every character, as ranges."""

    def __init__(self, path: str):
        from tokenizers import Regex, pre_tokenizers

        with open(path, "rb") as f:
            raw = f.read()
        self.key, spec = hashlib.sha256(raw).hexdigest(), json.loads(raw)
        model = spec["model"]
        split = spec["pre_tokenizer"]["pretokenizers"]
        steps = [x["type"] for x in spec["normalizer"]["normalizers"]]
        if model["type"] != "BPE" or model["end_of_word_suffix"] != "</w>" or split[0]["pattern"].get("Regex") != PATTERN or steps != ["NFC", "Replace", "Lowercase"]:
            raise ValueError(f"not a vocabulary that these transducers read: {path}")
        ids = model["vocab"]
        of = {}  # the printable stand-in of a byte, and of a last byte
        for name in ids:
            if len(name) == 1:
                of[name] = _byte(name)
            elif len(name) == 5 and name.endswith("</w>"):
                of[name] = 256 + _byte(name[0])
        if len(of) != 512:
            raise ValueError("the vocabulary lacks a byte")
        left, right = [], []
        for i, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            left.append(of[a])
            right.append(of[b])
            if a + b in of:
                raise ValueError("two merges make one token")
            of[a + b] = 512 + i
        self.left, self.right = np.array(left, dtype=np.int32), np.array(right, dtype=np.int32)
        self.special = sorted((t["content"] for t in spec["added_tokens"] if not t["normalized"]), key=lambda s: (-len(s), s))
        if len(self.special) != len(spec["added_tokens"]):
            raise ValueError("an added token is sought in normalised text")
        every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
        kind = np.full(len(every), OTHER, dtype=np.uint8)
        for pattern, k in ((r"\s+", SPACE), (r"\p{N}+", NUMBER), (r"\p{L}+", LETTER)):
            for _, (a, b) in pre_tokenizers.Split(Regex(pattern), "removed", invert=True).pre_tokenize_str(every):
                kind[a:b] = k
        for chars, k in (("'", QUOTE), ("stmd", ENDS), ("r", R), ("v", V), ("e", E), ("l", DOUBLE)):
            for c in chars:
                kind[ord(c)] = k
        edge = np.flatnonzero(np.diff(kind)) + 1
        self.range_from = np.concatenate(([0], edge))
        self.range_kind = kind[self.range_from]
        self.range_from[self.range_from >= 0xD800] += 0x800


def _byte(c: str) -> int:
    """The byte behind its printable stand-in: printable bytes stand for themselves, the others, in order, for 256 onwards."""
    code = ord(c)
    if code < 256:
        return code
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    return [b for b in range(256) if b not in plain][code - 256]


class Counter:
    """Counts the tokens of texts with what ``Compiled`` holds; one per Python worker, which keeps the transitions."""

    def __init__(self, c: Compiled):
        from tokenizers import normalizers

        self.merges = Merges(c.left, c.right)
        self.special = re.compile("|".join(map(re.escape, c.special))) if c.special else None
        kind = np.zeros(0x110000, dtype=np.uint8)
        for a, b, k in zip(c.range_from, [*c.range_from[1:], 0x110000], c.range_kind, strict=True):
            kind[a:b] = k
        self.kind = kind
        self.plain = kind[:128][np.concatenate([np.arange(65), np.arange(97, 123), np.arange(91, 128)])]
        self.nfc, lower = normalizers.NFC(), normalizers.Lowercase()

        class Lower(dict):
            def __missing__(self, code):
                self[code] = lower.normalize_str(chr(code))
                return self[code]

        self.lower = Lower()

    def normal(self, text: str) -> str:
        """Composed and in lower case, character by character; blanks keep their kinds, as all of them only part pieces."""
        if max(text, default="") >= "̀":
            text = self.nfc.normalize_str(text)
        return text.translate(self.lower)

    def texts(self, col: pa.Array) -> np.ndarray:
        """Tokens of each text of a column."""
        v, o = bytes_of(col)
        n = np.zeros(len(col), dtype=np.int64)
        if not len(col):
            return n
        hard = np.zeros(len(col), dtype=bool)  # not ASCII, or with a special string
        high = np.flatnonzero(v > 127)
        if len(high):
            hard[np.unique(np.searchsorted(o, high, side="right") - 1)] = True
        if self.special is not None:
            found = pc.match_substring_regex(col, self.special.pattern).fill_null(False).to_numpy(zero_copy_only=False)
            hard |= found
        parts, of, at = [], [], 0
        for i in [*np.flatnonzero(hard).tolist(), len(col)]:
            if at < i:  # texts of ASCII stand together, a blank after each
                parts.append(self._joined(v[o[at] : o[i]], o[at : i + 1] - o[at]))
                of.append(np.arange(at, i))
            if i < len(col):
                text = col[i].as_py()
                pieces = self.special.split(text) if self.special is not None else [text]
                n[i] += len(pieces) - 1
                for p in pieces:
                    b = np.frombuffer((self.normal(p) + " ").encode(), dtype=np.uint8)
                    parts.append((b, np.array([0, len(b)])))
                    of.append(np.array([i]))
            at = i + 1
        data = np.concatenate([p[0] for p in parts])
        ends = np.cumsum([len(p[0]) for p in parts])
        begin = np.concatenate([p[1][:-1] + e - len(p[0]) for p, e in zip(parts, ends, strict=True)])
        doc = np.concatenate(of)
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        first, size = self._pieces(data, lead)
        owner = doc[np.searchsorted(begin, first, side="right") - 1]
        np.add.at(n, owner, self.merges.count(data, first, size))
        return n

    @staticmethod
    def _joined(v: np.ndarray, o: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        docs = len(o) - 1
        out = np.full(len(v) + docs, 0x20, dtype=np.uint8)
        out[np.arange(len(v)) + np.repeat(np.arange(docs), np.diff(o))] = v + 32 * ((v >= 65) & (v <= 90)).astype(np.uint8)
        return out, o + np.arange(docs + 1)

    def _pieces(self, data: np.ndarray, lead: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte starts and lengths of the pieces."""
        code = data[lead].astype(np.int64)
        for least, mask, more in ((0xC0, 0x1F, 1), (0xE0, 0x0F, 2), (0xF0, 0x07, 3)):
            k = np.flatnonzero(data[lead] >= least)
            x = data[lead[k]].astype(np.int64) & mask
            for j in range(1, more + 1):
                x = x << 6 | (data[np.minimum(lead[k] + j, len(data) - 1)].astype(np.int64) & 0x3F)
            code[k] = x
        kind = self.kind[code]
        at = starts(kind)
        # a piece ends where the next begins, or at the blank before: blanks are in no piece
        blank = kind == SPACE
        run = np.cumsum(blank)
        nxt = np.append(at[1:], len(kind))
        stop = np.minimum(nxt, np.searchsorted(run, run[at] + 1)) if len(at) else nxt[:0]
        byte = np.append(lead, len(data))
        return byte[at], byte[stop] - byte[at]


_held: dict[str, Counter] = {}


def counter_of(compiled: Compiled) -> Counter:
    if compiled.key not in _held:
        _held.clear()
        _held[compiled.key] = Counter(compiled)
    return _held[compiled.key]


def _counted(batches, compiled):
    counter = counter_of(compiled.value)
    for b in blocks(batches):
        n = counter.texts(b.column(b.schema.get_field_index("text")))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n)], names=["doc_id", "n_bytes", "n_tokens"])


def token_counts(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """``docs`` (doc_id, text, ...) to (doc_id, n_bytes, n_tokens, over_limit) with the vocabulary in the file ``path``, which the
    driver reads."""
    spark = docs.sparkSession
    bound_batches(spark)
    held = spark.sparkContext.broadcast(Compiled(path))
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    got = rows.mapInArrow(partial(_counted, compiled=held), "doc_id long, n_bytes long, n_tokens long")
    return got.withColumn("over_limit", F.col("n_tokens") > limit)
