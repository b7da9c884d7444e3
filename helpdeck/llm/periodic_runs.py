"""Maximal periodic runs of words: seeds on diagonals, extended once each.

Words that equal the words ``q`` places later form stretches on the diagonal
of lag ``q``; a run of period ``q`` is such a stretch of at least
``max(least - q, q)`` words.  Lags are taken in bands; all stretches of a band
have a guaranteed overlap, and a gram of half of it fits between two multiples
of its length inside any of them.  So the index holds the k-grams of a
document, seeds are the pairs (gram at a multiple of k, the same gram within
the band's lags), and a table of the furthest word covered on each lag keeps
seeds of one stretch from being extended again.

Documents are handled in groups of a few megabytes: words are numbered per
document, so no gram of one document equals one of another.  Every document is
read whole and by itself; there is no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helpdeck.llm.common import WS, WS_CHARS, arrow_map, doc_ranges, extended, with_columns

#: A run has this many words at least, and two periods.
LEAST = 12
#: Length of the first grams: with ``LEAST`` words, lags below it share six words or more, so three fit at a multiple of three.
SEED = 3
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _number(keys: np.ndarray, where: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers per position, equal where the keys are; a key that comes once gets a negative number of its own.
    And the positions whose key comes again, ascending."""
    out = -1 - np.arange(n + 1, dtype=np.int64)
    if not len(where):
        return out, where
    code = pd.factorize(keys)[0]
    again = np.bincount(code)[code] > 1
    where = where[again]
    out[where] = code[again]
    return out, where


class _Index:
    """Numbers of the grams of 1, 3, 6, 12 ... words, as long as any comes again in its document."""

    def __init__(self, words: np.ndarray):
        n = self.n = len(words)
        self.one, at = _number(words, np.arange(n), n)
        two, at = self._longer(self.one, at, self.one, 1)
        three, at = self._longer(two, at, self.one, 2)
        self.grams, self.at = [], []
        k = SEED
        while len(at):
            self.grams.append((k, three))
            self.at.append(at)
            three, at = self._longer(three, at, three, k)
            k *= 2

    def _longer(self, head, at, tail, step):
        at = at[at + step < self.n]
        at = at[tail[at + step] >= 0]
        return _number(head[at] * (self.n + 1) + tail[at + step], at, self.n)

    def right(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words from ``a`` and from ``b`` (later) on are equal."""
        start, a, b = a, a.copy(), b.copy()
        for level in range(len(self.grams) - 1, -1, -1):
            k, ids = self.grams[level]
            a, b = self._jump(a, b, lambda i, j: ids[i] == ids[j], k, level == len(self.grams) - 1)  # noqa: B023
        for _ in range(SEED - 1):
            a, b = self._jump(a, b, lambda i, j: self.one[i] == self.one[j], 1, False)
        return a - start

    def left(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words before ``a`` and before ``b`` are equal."""
        start, a, b = a, a.copy(), b.copy()
        for level in range(len(self.grams) - 1, -1, -1):
            k, ids = self.grams[level]
            a, b = self._jump(a, b, lambda i, j: (i >= k) & (ids[np.maximum(i - k, 0)] == ids[np.maximum(j - k, 0)]),  # noqa: B023
                              -k, level == len(self.grams) - 1)
        for _ in range(SEED - 1):
            a, b = self._jump(a, b, lambda i, j: (i >= 1) & (self.one[np.maximum(i - 1, 0)] == self.one[np.maximum(j - 1, 0)]), -1, False)
        return start - a

    @staticmethod
    def _jump(a, b, equal, step, again):
        while True:
            hit = equal(a, b)
            a, b = np.where(hit, a + step, a), np.where(hit, b + step, b)
            if not again or not hit.any():
                return a, b


def _seeds(index: _Index, level: int, run_end: np.ndarray, run_period: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of equal grams: the left one at a multiple of its length, the lag in the level's band.  Sorted by lag, then place.

    Inside a run of period d every such lag is a multiple of d and gives the run itself again; those are left out.
    """
    (k, ids), at, n = index.grams[level], index.at[level], index.n
    low, high = (1, 4 * k) if level == 0 else (2 * k, 4 * k)
    order = at[np.argsort(ids[at], kind="stable")]
    keys = ids[order] * (n + 1) + order
    a = at[at % k == 0]
    a = a[(run_period[a] == 0) | (run_period[a] > k) | (a + high + k > run_end[a])]
    first = np.searchsorted(keys, ids[a] * (n + 1) + np.minimum(a + low, n))
    count = np.searchsorted(keys, ids[a] * (n + 1) + np.minimum(a + high, n)) - first
    a, first, count = a[count > 0], first[count > 0], count[count > 0]
    left = np.repeat(a, count)
    right = order[np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())]
    lag, d = right - left, run_period[left]
    new = (d == 0) | (right + k > run_end[left]) | (lag % np.maximum(d, 1) != 0)
    left, lag = left[new], lag[new]
    by = np.lexsort((left, lag))
    return left[by], lag[by]


def _stretches(index: _Index, k: int, at: np.ndarray, lag: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``start, end, lag`` of the stretches of equal words through the seeds.

    On each lag the first seeds beyond the furthest word covered are extended, one at first, then four times as many each turn.
    """
    _, line, size = np.unique(lag, return_inverse=True, return_counts=True)
    furthest = np.full(len(size), -1, np.int64)
    left, turn = np.arange(len(at)), 1
    while len(left):
        size = np.bincount(line[left], minlength=len(furthest))
        rank = np.arange(len(left)) - (np.cumsum(size) - size)[line[left]]
        now = left[rank < turn]
        a, q = at[now], lag[now]
        end = a + k + index.right(a + k, a + k + q)
        yield a - index.left(a, a + q), end, q
        np.maximum.at(furthest, line[now], end)
        left = left[rank >= turn]
        left = left[at[left] >= furthest[line[left]]]
        turn *= 4


def runs(words: np.ndarray, least: int = LEAST) -> np.ndarray:
    """All runs of a sequence of word numbers, as rows ``start, length, period`` by start, then period.

    A run is a stretch of words with smallest period ``q`` and at least ``max(least, 2 * q)`` words that no
    neighbouring word extends.  ``least`` is ``LEAST`` or more (the grams are made for it).
    """
    if least < LEAST:
        raise ValueError(f"runs below {LEAST} words are not found")
    index = _Index(np.ascontiguousarray(words, np.int64))
    run_end, run_period = np.zeros(index.n + 1, np.int64), np.zeros(index.n + 1, np.int64)
    found = [np.zeros((0, 3), np.int64)]
    for level, (k, _) in enumerate(index.grams):
        here = [found[0]]
        for start, end, q in _stretches(index, k, *_seeds(index, level, run_end, run_period)):
            ok = end - start >= np.maximum(least - q, q)
            here.append(np.stack((start[ok], end[ok] + q[ok], q[ok]), 1))
        here = _smallest(np.concatenate(here))
        found.append(here)
        for start, end, q in here[here[:, 1] - here[:, 0] >= 4 * here[:, 2]].tolist():
            longer = run_end[start:end] < end
            run_end[start:end][longer], run_period[start:end][longer] = end, q
    out = _smallest(np.concatenate(found))
    out[:, 1] -= out[:, 0]
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def _smallest(rows: np.ndarray) -> np.ndarray:
    """Of the rows ``start, end, period`` with the same ends the smallest period (the others are its multiples)."""
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    return rows[np.concatenate(([True], (rows[1:, :2] != rows[:-1, :2]).any(1)))] if len(rows) else rows


def split_words(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of a string column (maximal runs without separators; null: none) and where each text's begin."""
    lists = pc.ascii_split_whitespace(pc.fill_null(text.cast(pa.large_string()), ""))
    words, n = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    real = pc.greater(pc.binary_length(words), 0)
    kept = np.concatenate(([0], np.cumsum(real.to_numpy(zero_copy_only=False))))
    return words.filter(real), kept[np.concatenate(([0], np.cumsum(n)))].astype(np.int64)


def _group(text: pa.Array, least: int) -> tuple[pa.Array, pa.Array]:
    """Runs and collapsed texts of a few documents."""
    words, off = split_words(text)
    doc = np.repeat(np.arange(len(text)), np.diff(off))
    code = words.dictionary_encode()
    out = runs(code.indices.to_numpy(zero_copy_only=False) + doc * max(1, len(code.dictionary)), least)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, out[:, 0] + out[:, 2], 1)
    np.add.at(edge, out[:, 0] + out[:, 1], -1)
    keep = np.cumsum(edge[:-1]) == 0
    kept = np.concatenate(([0], np.cumsum(keep)))[off]
    collapsed = pc.binary_join(pa.ListArray.from_arrays(kept.astype(np.int32), words.filter(pa.array(keep))), pa.scalar(" ", pa.large_string()))
    of = doc[out[:, 0]] if len(out) else np.zeros(0, np.int64)
    values = [pa.array(out[:, 0] - off[of]), pa.array(out[:, 1]), pa.array(out[:, 2])]
    listed = pa.ListArray.from_arrays(np.searchsorted(of, np.arange(len(text) + 1)).astype(np.int32),
                                      pa.StructArray.from_arrays(values, fields=list(RUN)))
    return listed, collapsed


def collapse(docs: DataFrame, text_col: str = "text", least: int = LEAST, limit: int = 4 << 20) -> DataFrame:
    """``docs`` with ``runs`` (array of ``start, length, period`` in words, by start, then period) and ``collapsed``.

    ``collapsed`` holds the words, joined by one blank, without those that any run contains after its first
    period.  Null, empty and blank texts have no runs and collapse to ``''``.  Each row is judged by itself,
    repeated or not; an empty table gives no rows; columns named ``runs`` or ``collapsed`` are replaced.
    """

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        text = batch.column(batch.schema.get_field_index(text_col))
        size = pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        parts = [_group(text.slice(i, j - i), least) for i, j in doc_ranges(np.concatenate(([0], np.cumsum(size))), limit)]
        return with_columns(batch, {"runs": pa.concat_arrays([p[0] for p in parts]),
                                    "collapsed": pa.concat_arrays([p[1] for p in parts]).cast(pa.string())})

    return arrow_map(docs, one, extended(docs, {"runs": "array<struct<start:bigint,length:bigint,period:bigint>>", "collapsed": "string"}))


def plant(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with a known repetition in every tenth text (a null id or text, or one without words, stays as it is).

    With ``h`` the CRC-32 of the decimal ``doc_id``, ``g = floor(h / 10)`` and ``n`` words: where ``h % 10 = 0``, the
    words from ``a = g % n`` on repeat the ``p = 1 + floor((n - a) / (3 + g % 8))`` words there.  The words of such a text
    are joined by one blank.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    inner = F.btrim(F.coalesce(F.col(text_col), F.lit("")), F.lit(WS_CHARS))
    keep = [F.col(f"`{c}`") for c in docs.columns]
    d = docs.select(*keep, F.floor(h / 10).alias("_g"),
                    F.when((h % 10 == 0) & (inner != ""), F.split(inner, f"[{WS}]+", -1)).alias("_w"))
    d = d.withColumn("_a", F.when(F.col("_w").isNotNull(), F.col("_g") % F.size("_w")).cast("int"))
    d = d.withColumn("_p", (1 + F.floor((F.size("_w") - F.col("_a")) / (3 + F.col("_g") % 8))).cast("int"))
    planted = F.array_join(F.transform("_w", lambda w, i: F.when(i < F.col("_a"), w).otherwise(
        F.get("_w", F.col("_a") + (i - F.col("_a")) % F.col("_p")))), " ")
    return d.withColumn(text_col, F.when(F.col("_w").isNull(), F.col(text_col)).otherwise(planted)).select(*keep)


def run_digests(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``n_runs``, the longest run (ties: least start, then period; nulls without a run),
    its exponent in thousandths, and SHA-256 of the list of all runs and of the collapsed text."""
    d = collapse(docs.select("doc_id", F.col(f"`{text_col}`").alias("text")), least=LEAST)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    d = d.select("doc_id", "runs", "collapsed", best.alias("best"))
    listed = F.concat_ws("", F.transform("runs", lambda r: F.concat(
        r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))))
    return d.select("doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.s")).alias("start"), F.col("best.length").alias("length"),
                    (-F.col("best.p")).alias("period"), F.floor(1000 * F.col("best.length") / -F.col("best.p")).alias("exponent_milli"),
                    F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
