"""Suffix-array dedup: repeated byte strings by merging Burrows-Wheeler transforms.

A byte goes if a string of ``length`` bytes over it also starts earlier.
Three jobs:

1. *Windows to runs.*  Every window of ``length`` bytes is dealt to its anchor,
   the place of the least hash among its ``GRAM``-byte strings, so equal windows
   have equal anchors wherever they stand.  A run is the windows of one anchor;
   only its hashes travel (48 bits of the anchor's: they bring runs together, contents decide).  Runs whose anchor string is found once cannot hold a repeat.  Of runs
   with equal contents the first stays and the others go as a whole; this happens in
   each map batch first, so a passage with very many copies reaches the shuffle as one row per batch.
2. *Transforms.*  The bytes of the runs that remain (different contents around
   the same anchor string) meet by anchor hash; the runs of an anchor with very many are parted
   by where their windows hold it and by what these windows have in common (``_parted``).  A task lays them out in shards, sorts each shard's suffixes into its
   Burrows-Wheeler transform and merges the transforms by refining the
   interleave (``merge``): each round takes the entries in the present order, reads each
   shard's next transform symbol and deals the entries out by it, stably.  The round in which two
   neighbours part is their common prefix; entries that stay together for
   ``length`` bytes are a repeated interval.
3. *Cuts.*  Per document the removed windows are united and cut out of the text.

The transforms are over a wide alphabet: a symbol stands for ``STEP`` bytes and a suffix continues ``STEP``
bytes further, so ``length / STEP`` rounds reach ``length`` bytes at every byte offset.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helpdeck.llm.common import doc_ranges, extended, lean, mix64, ship, shuffle_width, text_bytes, written
from helpdeck.llm.order import apart, in_order, inner_name

GRAM = 32
_U = np.uint64


def powers_hash(data: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit polynomial hash of each ``n``-byte string of ``data`` (``n`` a power of two)."""
    base, width = 0xD6E8FEB86659FD93, 1
    h = data.astype(_U) * _U(0x9E3779B97F4A7C15) + _U(0x632BE59BD9B4E019)
    h ^= h >> _U(29)
    while width < n:
        h = h[:-width] * _U(pow(base, width, 1 << 64)) + h[width:]
        width *= 2
    return h


def least_in(values: np.ndarray, n: int) -> np.ndarray:
    """Minimum of each ``n`` neighbours."""
    m, width = values, 1
    while 2 * width <= n:
        m = np.minimum(m[:-width], m[width:])
        width *= 2
    rest = n - width
    return np.minimum(m[:len(m) - rest], m[rest:]) if rest else m


def runs_of(data: np.ndarray, offsets: np.ndarray, length: int):
    """The runs of the documents in ``data``: ``(doc, start, windows, anchor hash, content hash)``.

    ``start`` is the first window's place in its document.  The windows of a
    run hold the anchor at different offsets, so they differ from each other, and the sum of
    their hashes identifies them together.
    """
    empty = [np.zeros(0, np.int64)] * 3 + [np.zeros(0, _U)] * 2
    if len(data) < length or np.diff(offsets).max() < length:
        return empty
    grams = mix64(powers_hash(data, GRAM))
    place = np.arange(len(grams), dtype=_U)
    anchor = least_in((grams & _U(0xFFFFFFFF00000000)) | place, length - GRAM + 1) & _U(0xFFFFFFFF)
    n = len(anchor)  # windows, those across documents too
    window = np.zeros(n, _U)
    for k, at in enumerate([*range(0, length - GRAM, GRAM), length - GRAM]):
        window = window * _U(0x9E3779B97F4A7C15) + grams[at:at + n]
    window = mix64(window)
    inside = np.zeros(n, bool)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        if b - a >= length:
            inside[a:b - length + 1] = True
    change = np.empty(n, bool)
    change[0] = True
    np.not_equal(anchor[1:], anchor[:-1], out=change[1:])
    change[1:] |= inside[1:] != inside[:-1]
    first = np.flatnonzero(change)
    last = np.append(first[1:], n)
    good = inside[first]
    total = np.add.reduceat(window, first)[good]
    first, last = first[good], last[good]
    doc = np.searchsorted(offsets, first, side="right") - 1
    return [doc, first - offsets[doc], last - first, grams[anchor[first].astype(np.int64)], total + (last - first).astype(_U)]


def _emit(columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v) for v in columns.values()], names=list(columns))


def _first_rows(keys: list[np.ndarray], order: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers sorted by ``keys`` then ``order``, and whether each is the first of its keys."""
    rows = np.lexsort(order[::-1] + keys[::-1])
    new = np.ones(len(rows), bool)
    if len(rows) > 1:
        new[1:] = False
        for k in keys:
            s = k[rows]
            new[1:] |= s[1:] != s[:-1]
    return rows, new


def _map_runs(length: int, chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            data, off = text_bytes(batch.column(1))
            found = []
            for i, j in doc_ranges(off, chunk):
                doc, *rest = runs_of(data[off[i]:off[j]], off[i:j + 1] - off[i], length)
                found.append([ids[i:j][doc], *rest])
            if not sum(len(x[0]) for x in found):
                continue
            doc, start, n, anchor, content = (np.concatenate(x) for x in zip(*found))
            rows, new = _first_rows([anchor, content], [doc, start])
            doc, start, n, anchor, content = (x[rows] for x in (doc, start, n, anchor, content))
            # later copies inside the batch are gone already; they travel by a key of their own
            key = np.where(new, anchor, _own_key(doc, start))
            place = (start << 16) | (n << 1) | ~new  # a run has at most `length` windows
            yield _emit({"anchor": (key >> _U(16)).view(np.int64), "content": content.view(np.int64), "seq": doc, "place": place})
    return run


def _own_key(seq: np.ndarray, start: np.ndarray) -> np.ndarray:
    return mix64(seq.astype(_U) * _U(0x9E3779B1) + start.astype(_U))


def _settle_runs(crowd: int):
    """All runs of some anchors: which go (``gone``), and which must be compared byte by byte; ``many``: their anchor has
    more than ``crowd`` of these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        anchor, content, seq, place = (np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in held]) for i in range(4))
        held.clear()
        start, n, away = (place >> 16).astype(np.int32), ((place >> 1) & 0x7FFF).astype(np.int32), (place & 1).astype(bool)
        yield _emit({"anchor": anchor[away], "seq": seq[away], "start": start[away], "n": n[away], "gone": away[away], "many": ~away[away]})
        anchor, content, seq, start, n = (x[~away] for x in (anchor, content, seq, start, n))
        if not len(anchor):
            return
        rows, new = _first_rows([anchor, content], [seq, start])
        anchor, seq, start, n = (x[rows] for x in (anchor, seq, start, n))
        yield _emit({"anchor": anchor[~new], "seq": seq[~new], "start": start[~new], "n": n[~new], "gone": np.ones((~new).sum(), bool),
                     "many": np.zeros((~new).sum(), bool)})
        anchor, seq, start, n = (x[new] for x in (anchor, seq, start, n))
        first = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
        size = np.diff(np.append(first, len(anchor)))
        size = np.repeat(size, size)
        several = size > 1
        yield _emit({"anchor": anchor[several], "seq": seq[several], "start": start[several], "n": n[several],
                     "gone": np.zeros(several.sum(), bool), "many": size[several] > crowd})
    return run


# ---- transforms -----------------------------------------------------------------------------------------------


class Shard:
    """The Burrows-Wheeler transform of some strings over the wide alphabet.

    ``suffixes``: entries of the shard in the order of their suffixes (numbers into the layout);
    ``symbols``: for each, the symbol before it (0: the chain begins here).
    """

    def __init__(self, entries: np.ndarray, symbol: np.ndarray, following: np.ndarray, before: np.ndarray):
        rank = symbol[entries].astype(np.int64)
        position = np.zeros(len(symbol) + 1, np.int64)  # rank of an entry; 0 beyond a chain's end
        jump = following.copy()
        while True:
            position[entries] = rank
            after = position[jump[entries]]
            if not after.any():
                break
            rank = np.unique(rank * (int(after.max()) + 1) + after, return_inverse=True)[1] + 1
            jump = jump[jump]
        self.suffixes = entries[np.argsort(rank, kind="stable")]
        self.symbols = before[self.suffixes]


def merge(shards: list[Shard], symbols: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """The entries of all shards in the order of the first ``rounds`` symbols of their suffixes, and the common prefix
    of each with the one before it (in symbols, at most ``rounds``).

    Interleave refinement: only the order in which the shards take turns changes, never the order within a shard.
    """
    bwt = np.concatenate([s.symbols for s in shards])
    entries = np.concatenate([s.suffixes for s in shards])
    begin = np.concatenate(([0], np.cumsum([len(s.suffixes) for s in shards])))
    total = len(bwt)
    turn = np.repeat(np.arange(len(shards), dtype=np.uint8), np.diff(begin))
    block = np.zeros(total, np.int64)
    prefix = np.full(total, rounds, np.int64)
    prefix[:1] = 0
    for depth in range(rounds):
        taken = np.empty(total, np.int64)
        taken[np.argsort(turn, kind="stable")] = np.arange(total)  # each shard's entries come in its own order
        symbol = bwt[taken]
        order = _stable(symbol, symbols)
        turn, symbol, block = turn[order], symbol[order], block[order]
        parted = np.ones(total, bool)
        # the chains' beginnings deal out the empty suffixes, which are all alike
        parted[1:] = (symbol[1:] != symbol[:-1]) | ((block[1:] != block[:-1]) & (symbol[1:] != 0))
        np.minimum(prefix, depth, out=prefix, where=parted)
        block = np.cumsum(parted)
    taken = np.empty(total, np.int64)
    taken[np.argsort(turn, kind="stable")] = np.arange(total)
    return entries[taken], prefix


def _stable(symbol: np.ndarray, symbols: int) -> np.ndarray:
    """Stable order by symbol, sixteen bits at a time (a counting sort)."""
    order = np.argsort((symbol & 0xFFFF).astype(np.uint16), kind="stable")
    shift = 16
    while symbols >> shift:
        order = order[np.argsort(((symbol >> shift) & 0xFFFF).astype(np.uint16)[order], kind="stable")]
        shift += 16
    return order


def repeated_windows(data: np.ndarray, offsets: np.ndarray, length: int, step: int, shard_bytes: int) -> np.ndarray:
    """For strings laid out in ``data``: whether the window that starts at each byte also starts earlier in the layout."""
    out = np.zeros(len(data), bool)
    size = np.diff(offsets)
    if not len(data) or size.max() < length:
        return out
    stop = np.repeat(offsets[1:], size)  # each byte's string ends here
    # entries: places with a whole symbol in their string, then one end (the empty suffix) per chain
    place = np.flatnonzero(np.arange(len(data)) + step <= stop)
    codes, symbol_at = np.unique(mix64(_strings_hash(data, step))[place], return_inverse=True)
    number = np.full(len(data) + step, -1, np.int64)
    number[place] = np.arange(len(place))
    following = number[place + step]
    following[place + 2 * step > stop[place]] = -1
    ends = np.flatnonzero(following < 0)
    following[ends] = len(place) + np.arange(len(ends))
    m = len(place) + len(ends)
    symbol = np.ones(m + 1, np.int64)  # 1: the empty suffix; entry m stands for what is beyond an end
    symbol[:len(place)] = symbol_at + 2
    before = np.zeros(m, np.int64)  # 0: a chain's beginning
    before[following] = symbol[:len(place)]
    following = np.concatenate((following, np.full(len(ends) + 1, m)))
    # shards of whole strings, at most 255
    of_string = np.minimum(offsets[:-1] // max(1, shard_bytes, -(-len(data) // 255)), 254).astype(np.uint8)
    of_entry = np.repeat(of_string, size)[np.concatenate((place, place[ends]))]
    shards = [Shard(np.flatnonzero(of_entry == z), symbol, following, before) for z in np.unique(of_entry)]
    entries, prefix = merge(shards, len(codes) + 2, length // step)
    # repeated intervals: neighbours that share `length` bytes; the least place of each comes first
    spot = np.concatenate((place, np.full(len(ends), len(data))))[entries]
    head = np.flatnonzero(prefix < length // step)
    first = np.repeat(np.minimum.reduceat(spot, head), np.diff(np.append(head, len(spot))))
    later = spot[(spot != first) & (spot < len(data))]
    out[later] = later + length <= stop[later]
    return out


def _strings_hash(data: np.ndarray, n: int) -> np.ndarray:
    """A hash of each ``n``-byte string, from its first and last power-of-two parts."""
    width = 1 << (n.bit_length() - 1)
    h = powers_hash(data, width)
    return h if width == n else mix64(h[:len(data) - n + 1]) * _U(0xD1342543DE82EF95) + h[n - width:]


def _merge_runs(length: int, step: int, task_bytes: int, shard_bytes: int):
    """Strings of runs in the order of their anchors: transforms of about ``task_bytes`` at a time, never parting an anchor.
    What has no string goes as a whole."""

    def settle(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(rows)
        away = rows.filter(pc.is_null(rows["bytes"])).select(["seq", "start", "n"])
        yield from away.to_batches()
        rows = rows.filter(pc.is_valid(rows["bytes"]))
        if not rows.num_rows:
            return
        seq, start = rows["seq"].to_numpy(), rows["start"].to_numpy().astype(np.int64)
        texts = rows["bytes"].cast(pa.large_binary()).combine_chunks()
        order = np.lexsort((start, seq))
        data, off = text_bytes(texts.take(pa.array(order)))
        seq, start = seq[order], start[order]
        again = repeated_windows(data, off, length, step, shard_bytes)
        edge = np.flatnonzero(np.diff(np.concatenate(([0], again.view(np.int8), [0]))))
        a, b = edge[::2], edge[1::2]
        own = np.searchsorted(off, a, side="right") - 1  # no window runs over its string's end, so no span does
        yield _emit({"seq": seq[own], "start": (start[own] + a - off[own]).astype(np.int32), "n": (b - a).astype(np.int32)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            while batch.num_rows:
                if size >= task_bytes:
                    # the held rows end with an anchor that may go on
                    anchors = batch.column(0).to_numpy()
                    go_on = int(np.searchsorted(anchors != held[-1].column(0)[-1].as_py(), True))
                    if go_on:
                        held.append(batch.slice(0, go_on))
                        batch = batch.slice(go_on)
                        if not batch.num_rows:
                            break
                    yield from settle(held)
                    held, size = [], 0
                part = batch.slice(0, 1000)
                held.append(part)
                size += part.column(4).nbytes
                batch = batch.slice(part.num_rows)
        if held:
            yield from settle(held)
    return run


# ---- jobs -----------------------------------------------------------------------------------------------------


#: The windows of a run are dealt to so many classes, by where they hold the anchor, when its anchor is parted.
CLASSES = 4


def _parted(data: np.ndarray, at: np.ndarray, n: np.ndarray, anchor: np.ndarray, length: int):
    """Runs of crowded anchors, laid out in ``data`` from ``at``, in parts: ``(run, first window, windows, key, contents)``.

    Equal windows hold the anchor at the same offset.  The windows of one class of offsets all hold the
    same stretch around it, so windows that are equal lie in parts with equal keys.
    ``contents``: two hashes that, with the number of windows, tell what a part's string is.
    """
    hits = np.flatnonzero(mix64(powers_hash(data, GRAM)) >> _U(16) == np.repeat(anchor, np.diff(at))[:len(data) - GRAM + 1].view(_U))
    # the anchor is the first place of its string in the run
    run, first = np.unique(np.searchsorted(at, hits, side="right") - 1, return_index=True)
    offset = hits[first] - at[run]
    wide = -(-(length - GRAM + 1) // CLASSES)
    stretch, window = _strings_hash(data, length - wide + 1), _strings_hash(data, length)
    parts = []
    for c in range(CLASSES):
        a, b = np.maximum(0, offset - c * wide - wide + 1), np.minimum(n - 1, offset - c * wide)
        own = np.flatnonzero(a <= b)
        a, b, begin = a[own], b[own], at[own]
        key = mix64(stretch[begin + offset[own] - c * wide] + _U(c + 1))
        parts.append((own, a, b - a + 1, (key >> _U(16)).view(np.int64), window[begin + a], window[begin + b]))
    return [np.concatenate(x) for x in zip(*parts)]


def _cut_strings(length: int):
    """The bytes of the runs that are asked for, per anchor (or part of one); none for what is a later copy in its batch."""

    def strings(data, anchor, seq, start, n, a):
        size = n + length - 1
        at = np.concatenate(([0], np.cumsum(size)))
        return data[np.repeat(a - at[:-1], size) + np.arange(at[-1])], at

    def emit(data, anchor, seq, start, n, a):
        for i in range(0, len(a), 4000):
            cut = [x[i:i + 4000] for x in (anchor, seq, start, n, a)]
            own, at = strings(data, *cut)
            blob = pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32).tobytes()),
                                                                      pa.py_buffer(own.tobytes())])
            yield rows(*cut[:4], blob)

    def rows(anchor, seq, start, n, blob):
        return pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(seq), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)),
                                           blob], names=["anchor", "seq", "start", "n", "bytes"])

    def parts(data, anchor, seq, start, n, a):
        found = []
        for i in range(0, len(a), 4000):
            cut = [x[i:i + 4000] for x in (anchor, seq, start, n, a)]
            own, at = strings(data, *cut)
            run, skip, windows, key, *contents = _parted(own, at, cut[3], cut[0], length)
            run += i
            found.append((key, *contents, seq[run], start[run] + skip, windows, a[run] + skip))
        key, head, tail, seq, start, n, a = (np.concatenate(x) for x in zip(*found))
        order, new = _first_rows([key, head, tail, n], [seq, start])
        key, seq, start, n, a = (x[order] for x in (key, seq, start, n, a))
        yield from emit(data, *(x[new] for x in (key, seq, start, n, a)))
        key, seq, start, n = (x[~new] for x in (key, seq, start, n))
        if len(key):
            yield rows((_own_key(seq, start) >> _U(16)).view(np.int64), seq, start, n, pa.nulls(len(key), pa.binary()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column(batch.schema.get_field_index("asked"))
            data, off = text_bytes(batch.column(batch.schema.get_field_index("text")))
            flat = lists.flatten()
            k = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            start, n, anchor = (flat.field(i).to_numpy() for i in range(3))
            many = flat.field(3).to_numpy(zero_copy_only=False)
            start, n = start.astype(np.int64), n.astype(np.int64)
            seq = batch.column(batch.schema.get_field_index("seq")).to_numpy()[k]
            asked = (anchor, seq, start, n, off[k] + start)
            yield from emit(data, *(x[~many] for x in asked))
            if many.any():
                yield from parts(data, *(x[many] for x in asked))
    return run


def _spans(starts: np.ndarray, n: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes covered by windows ``[start, start + n)`` of ``length`` bytes."""
    order = np.argsort(starts, kind="stable")
    a, b = starts[order].astype(np.int64), (starts[order] + n[order]).astype(np.int64) + length - 1
    reach = np.maximum.accumulate(b)
    new = np.concatenate(([True], a[1:] > reach[:-1]))
    last = np.append(np.flatnonzero(new)[1:] - 1, len(a) - 1)
    return list(zip(a[new].tolist(), reach[last].tolist()))


def without_repeats(rows: DataFrame, fn, ddl: str, length: int = 100, step: int = 25, chunk: int = 1 << 19,
                    task_bytes: int = 1 << 18, shard_bytes: int = 1 << 16, crowd: int = 1000) -> DataFrame:
    """``fn(batch, texts)`` over batches of ``rows`` (``seq``, unique; ``text``; others), ``texts`` being per row the
    text's bytes and its removed spans.

    The texts are shuffled by ``seq`` once: the strings of the second job and the cuts meet them there.
    A worker holds about 50 bytes for each byte of ``chunk`` and 160 for each of ``task_bytes``, two transforms' worth at most where
    an anchor with up to ``crowd`` runs comes last.
    """
    if length % step or not GRAM <= length < 1 << 15:
        raise ValueError("length must be a multiple of step and hold an anchor string")
    ship(rows.sparkSession)
    width = shuffle_width(rows.sparkSession)
    runs = rows.select("seq", "text").mapInArrow(
        lean(_map_runs(length, chunk)), "anchor bigint, content bigint, seq bigint, place bigint")
    settled = written(runs.repartition(width, "anchor").mapInArrow(
        lean(_settle_runs(crowd)), "anchor bigint, seq bigint, start int, n int, gone boolean, many boolean"), "runs")
    texts = rows.repartition(width, "seq")
    asked = (settled.where("not gone").groupBy(F.col("seq").alias("_seq"))
             .agg(F.collect_list(F.struct("start", "n", "anchor", "many")).alias("asked")))
    strings = texts.join(asked, F.col("seq") == F.col("_seq")).mapInArrow(
        lean(_cut_strings(length)), "anchor bigint, seq bigint, start int, n int, bytes binary")
    again = (strings.repartition(width, "anchor").sortWithinPartitions("anchor")
             .mapInArrow(lean(_merge_runs(length, step, task_bytes, shard_bytes)), "seq bigint, start int, n int"))
    gone = (settled.where("gone").select("seq", "start", "n").unionByName(again).groupBy(F.col("seq").alias("_seq"))
            .agg(F.collect_list(F.struct("start", "n")).alias("_gone")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column(batch.schema.get_field_index("_gone"))
            data, off = text_bytes(batch.column(batch.schema.get_field_index("text")))
            view = memoryview(np.ascontiguousarray(data))
            texts = []
            for i, own in enumerate(lists):
                spans = []
                if own.is_valid and len(own.values):
                    spans = _spans(own.values.field(0).to_numpy(), own.values.field(1).to_numpy(), length)
                texts.append((view[off[i]:off[i + 1]], spans))
            yield fn(batch, texts)

    return texts.join(gone, F.col("seq") == F.col("_seq"), "left").mapInArrow(lean(cut), ddl)


def _kept(text: memoryview, spans: list[tuple[int, int]]) -> bytes:
    at, parts = 0, []
    for a, b in spans:
        parts.append(text[at:a])
        at = b
    parts.append(text[at:])
    return b"".join(parts)


def dedup_digests(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` per row of ``docs``.

    A null text has no bytes.  Rows with the same (or a null) id are documents
    of their own, ordered by text, null ids first: the later of two repeated rows of
    ``length`` bytes or more loses its text.  An empty table gives no rows; other columns are ignored.
    """
    rows = in_order(docs.select("doc_id", F.col(text_col).alias("text")), "text")

    def digest(batch: pa.RecordBatch, texts: list) -> pa.RecordBatch:
        kept = [_kept(t, s) for t, s in texts]
        n = np.array([len(t) for t, _ in texts], np.int64)
        return pa.RecordBatch.from_arrays(
            [batch.column(batch.schema.get_field_index("doc_id")), pa.array(n), pa.array(n - np.array([len(k) for k in kept], np.int64)),
             pa.array([len(s) for _, s in texts], pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept])],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return without_repeats(rows, digest, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string", **options)


def remove_repeats(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """``docs`` with the repeats cut out of the text (a character goes if all its bytes do).

    All rows stay, with their columns; ``n_chars``, where there is one, is
    counted anew for the rows that change.
    """
    rows = in_order(apart(docs, text_col), "text")
    names = docs.columns

    def edit(batch: pa.RecordBatch, texts: list) -> pa.RecordBatch:
        out = {n: batch.column(batch.schema.get_field_index(inner_name(n, text_col))) for n in names}
        new = [t if not s else _kept(v, _whole_characters(v, s)).decode("utf-8", "replace")
               for t, (v, s) in zip(out[text_col].to_pylist(), texts)]
        out[text_col] = pa.array(new, pa.string())
        if "n_chars" in names:
            n = out["n_chars"]
            out["n_chars"] = pa.array([len(t) if s else c for t, (_, s), c in zip(new, texts, n.to_pylist())], n.type)
        return pa.RecordBatch.from_arrays(list(out.values()), names=names)

    return without_repeats(rows, edit, extended(docs, {}), **options)


def _whole_characters(text: memoryview, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans drawn in to the borders of characters."""
    out = []
    for a, b in spans:
        while a < b and text[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(text) and text[b] & 0xC0 == 0x80:
            b -= 1
        if a < b:
            out.append((a, b))
    return out
