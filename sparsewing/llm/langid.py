"""Language identification by mixture inference.

Training counts, for each language, the byte trigrams inside words of letters (padded at word borders) in ``CELLS`` hashed
cells, over all training rows; each language's cells become smoothed log-likelihoods. A model has 128 KB a language.

Prediction sees a document as a mixture: each word comes from one language, drawn by the document's proportions, and its
likelihood is the product of its trigrams'. Expectation-maximisation estimates the proportions from all words of the
text, round after round until none moves by ``TOLERANCE`` (at most ``ROUNDS``). Languages are then ranked by their
proportion after the one that explains the text best alone; the first one, two and so on are fitted alone for as long as a
further language raises the likelihood less a penalty of ``PENALTY`` / 2 * log(words + 1) for it. The prediction is the language
with the largest proportion in that set, and the score is that proportion. The set is returned too. Texts that have
stopped, and proportions that have settled, are left out of what follows, and a set of n languages is fitted on n columns, so
the work grows with the words times the languages.

Edge cases: null text or text without a letter is ``und`` with score 0; text whose letters make no trigram that training
saw gets the smoothed likelihoods; ties go to the first language in code-point order; without a training row all
documents are ``und``; repeated rows are judged row by row; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparsewing.llm.common import LOWER, blocks, bound_batches, bytes_of

CELLS, PARTS, ROUNDS, TOLERANCE = 1 << 15, 8, 60, 1e-3
#: Weight of the penalty for a further language.
PENALTY = 4.0
LETTER = np.zeros(256, dtype=bool)
LETTER[97:123] = True
LETTER[128:] = True
_A, _B, _C = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D)


def grams(v: np.ndarray, o: np.ndarray):
    """Cells of the trigrams of a block, the first trigram of each word, and the document of each word."""
    x = LOWER[v]
    edge = np.zeros(len(x) + 2, dtype=np.uint32)
    edge[1:-1] = np.where(LETTER[x], x, 0)
    cut = o[1:-1]
    cut = cut[(cut > 0) & (cut < len(x))]
    here = edge[1:-1]
    before, after = edge[:-2].copy(), edge[2:].copy()
    before[cut] = 0
    after[cut - 1] = 0
    on = np.flatnonzero(here)
    cell = (before[on] * _A ^ here[on] * _B) * _C ^ after[on] * _A
    cell = (cell ^ (cell >> np.uint32(15))) * _B >> np.uint32(17)
    first = np.flatnonzero(before[on] == 0)
    return cell.astype(np.int64), first, np.searchsorted(o, on[first], side="right") - 1


def _count(batches):
    table: dict[str, np.ndarray] = {}
    for b in blocks(batches):
        langs = b.column(b.schema.get_field_index("lang")).to_pylist()
        v, o = bytes_of(b.column(b.schema.get_field_index("text")))
        cell, first, doc = grams(v, o)
        size = np.diff(np.concatenate((first, [len(cell)])))
        owner = np.repeat(doc, size)
        for lang in set(langs):
            mine = np.array([x == lang for x in langs])
            got = np.bincount(cell[mine[owner]], minlength=CELLS)
            table[lang] = table[lang] + got if lang in table else got
    step = CELLS // PARTS
    rows = [(k, p, t[p * step : (p + 1) * step].astype(np.int64).tobytes()) for k, t in table.items() for p in range(PARTS)]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], names=["lang", "part", "counts"])


def _add(f: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(c, dtype=np.int64) for c in f.counts)
    return pd.DataFrame({"lang": [f.lang.iloc[0]], "part": [f.part.iloc[0]], "counts": [total.tobytes()]})


def train(rows: DataFrame) -> tuple[list[str], np.ndarray]:
    """``rows`` (text, lang; lang not null) to language names in order and log-likelihoods (CELLS x languages)."""
    bound_batches(rows.sparkSession)
    t = rows.select("text", "lang").mapInArrow(_count, "lang string, part int, counts binary")
    got = t.groupBy("lang", "part").applyInPandas(_add, "lang string, part int, counts binary").collect()
    langs = sorted({r.lang for r in got})
    counts = np.zeros((CELLS, len(langs)))
    step = CELLS // PARTS
    for r in got:
        counts[r.part * step : (r.part + 1) * step, langs.index(r.lang)] = np.frombuffer(r.counts, dtype=np.int64)
    p = (counts + 0.5) / (counts.sum(axis=0) + 0.5 * CELLS)
    return langs, np.log(p).astype(np.float32)


def _fit(like: np.ndarray, at: np.ndarray, doc: np.ndarray, prop: np.ndarray) -> np.ndarray:
    """Proportions of all documents of a block by EM from ``prop``. like: words x languages, each word scaled by its largest; at:
    the first word of each document; doc: the document of each word."""
    prop, live = prop.copy(), np.arange(len(at))
    done = 0
    while len(live) and done < ROUNDS:
        n = np.diff(np.concatenate((at, [len(doc)])))[:, None]
        now = prop[live]
        for _ in range(3):
            before = now
            r = like * now[doc]
            r /= np.maximum(r.sum(axis=1, keepdims=True), 1e-30)
            now = np.add.reduceat(r, at, axis=0) / n
        prop[live] = now
        done += 3
        moving = np.abs(now - before).max(axis=1) >= TOLERANCE
        if not moving.all():
            like, at, doc = _of(moving, like, at, doc)
            live = live[moving]
    return prop


def _of(keep: np.ndarray, like: np.ndarray, at: np.ndarray, doc: np.ndarray):
    """The words of some documents, which are numbered anew."""
    words = keep[doc]
    number = np.cumsum(keep) - 1
    left = number[doc[words]]
    return like[words], np.searchsorted(left, np.arange(int(keep.sum()))), left


def infer(v: np.ndarray, o: np.ndarray, ll: np.ndarray):
    """Proportions (documents x languages, zero outside the selected set) of a block; rows without words are zero."""
    docs, k = len(o) - 1, ll.shape[1]
    out = np.zeros((docs, k))
    cell, first, doc = grams(v, o)
    if not len(first) or not k:
        return out
    word = np.add.reduceat(ll[cell], first, axis=0).astype(np.float64)
    at = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
    who, doc = doc[at], np.cumsum(np.concatenate(([False], doc[1:] != doc[:-1])))
    top = word.max(axis=1)
    like = np.exp(np.maximum(word - top[:, None], -60.0))
    m = len(at)
    full = _fit(like, at, doc, np.full((m, k), 1.0 / k))
    # the likelihood of one language alone decides which comes first, then the proportions
    alone = np.add.reduceat(word, at, axis=0)
    lead = alone.argmax(axis=1)
    order = full.copy()
    order[np.arange(m), lead] = 2.0
    order = np.argsort(-order, axis=1, kind="stable")
    fine = np.log(np.diff(np.concatenate((at, [len(doc)]))) + 1.0) * PENALTY / 2
    best, score = np.zeros((m, k)), alone[np.arange(m), lead]
    best[np.arange(m), lead] = 1.0
    open_, topped = np.arange(m), np.add.reduceat(top, at)
    for size in range(2, k + 1):
        chosen = order[open_, :size]
        part = np.take_along_axis(like, chosen[doc], axis=1)
        prop = _fit(part, at, doc, np.full((len(open_), size), 1.0 / size))
        logs = np.add.reduceat(np.log(np.maximum((part * prop[doc]).sum(axis=1), 1e-30)), at) + topped[open_]
        value = logs - (size - 1) * fine[open_]
        better = value > score[open_]
        if not better.any():
            break
        won = open_[better]
        row = np.zeros((len(won), k))
        np.put_along_axis(row, chosen[better], prop[better], axis=1)
        best[won], score[won] = row, value[better]
        if not better.all():
            like, at, doc = _of(better, like, at, doc)
            open_ = won
    out[who] = best
    return out


def _predict(batches, flag: str, langs: list[str], ll: np.ndarray):
    for b in blocks(batches):
        v, o = bytes_of(b.column(b.schema.get_field_index("text")))
        p = infer(v, o, ll)
        letter = b.column(b.schema.get_field_index(flag)).to_numpy(zero_copy_only=False).astype(bool)
        got = letter & (p.sum(axis=1) > 0)
        top = p.argmax(axis=1) if len(langs) else np.zeros(len(p), int)
        pred = [langs[k] if g else "und" for k, g in zip(top.tolist(), got.tolist(), strict=True)]
        score = np.where(got, np.clip(p[np.arange(len(p)), top], 0, 1), 0.0) if len(langs) else np.zeros(len(p))
        sets = [[langs[k] for k in np.flatnonzero(r >= 0.005)] if g else [] for r, g in zip(p, got.tolist(), strict=True)]
        keep = [n for n in b.schema.names if n != flag]
        yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(n)) for n in keep), pa.array(pred), pa.array(score), pa.array(sets, pa.list_(pa.string()))], names=[*keep, "lang_pred", "score", "lang_set"])


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """All columns of ``docs`` (text, ...) with lang_pred, score and lang_set. Of these only ``text`` is looked at."""
    spark = docs.sparkSession
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    flag = "letter"
    while flag in docs.columns:
        flag += "_"
    rows = docs.drop("lang_pred", "score", "lang_set").withColumn(flag, letter)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != flag), "lang_pred string, score double, lang_set array<string>"])
    return rows.mapInArrow(lambda it: _predict(it, flag, *shared.value), schema)
