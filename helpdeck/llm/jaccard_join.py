"""N-gram Jaccard join with PartEnum signatures.

Two sets that link (Jaccard at least 75 %) differ in at most a third of either
set's elements.  Sets are banded by size; a band deals the hash domain into
``n1`` partitions of ``n2`` parts.  A signature is a partition with
``n2 - k2`` of its parts and what the set has there; all such subsets of parts are
enumerated.  Of a linked pair's partitions at most ``k / (k2 + 1)`` have more than ``k2`` differences,
and any other gives both sets a common signature.

*Only the signatures needed.*  Signatures have a fixed order (those made of
frequent shingles alone come last).  Up to the least common signature of a linked pair, at most
``k / (k2 + 1)`` partitions of either set with ``k2 + 1`` filled parts can be over, so a set emits its
signatures until one partition more is over.  A set that has too few such
partitions emits all, and one signature for each element too (two such sets share an element).

*From signatures to links.*  The sets of a signature become members of one
neighbourhood (that of the smallest), so a group of ``g`` sets is ``g`` rows.  A neighbourhood's task has its
members' parities, which bound from below how far two sets differ, and returns only pairs that may link and are not in one
component yet: all of them if they are few, else those with some leaders. (A large one is compared with its
least member, then dealt into pairs of blocks by component.) Such pairs are compared
exactly by their texts, components are found, and neighbourhoods that held
back pairs come again; each time more pairs may go out, so all are settled in the end.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helpdeck.llm.common import doc_ranges, lean, mix64, ship, shuffle_width, text_bytes, written
from helpdeck.llm.components import components
from helpdeck.llm.order import apart, in_order, inner_name
from helpdeck.llm.shingles import shingle_sets

_U = np.uint64
FREQUENT_BITS = 22
SLICE_BITS = 6
CHUNK = 1 << 22
MOST_PARITIES = 1 << 20


def linked(inter, union):
    return 100 * inter >= 75 * union


def size_match(a, b):
    """Whether sets of ``a <= b`` elements can link."""
    return 100 * a >= 75 * b


def partitions(band: int, n2: int) -> int:
    """First-level partitions for sets of ``2**band`` to ``2**(band + 1) - 1`` elements (more for small
    sets, whose elements would often meet in one)."""
    n = 1 << band
    return max(1, 4 * n if n < 64 else n if n2 == 1 else n * 27 // 64)


def signatures(s: np.ndarray, frequent: np.ndarray, n2: int, k2: int) -> np.ndarray:
    """The signatures that a sorted set of shingle hashes emits."""
    a = len(s)
    if not a:
        return np.zeros(0, _U)
    content = mix64(s ^ _U(0xA0761D6478BD642F))
    rare = np.concatenate(([0], np.cumsum(~frequent[(s >> _U(64 - FREQUENT_BITS)).astype(np.int64)])))
    total = np.concatenate((np.zeros(1, _U), np.cumsum(content)))
    band = a.bit_length() - 1
    out = []
    for scheme in (band, band + 1):
        if scheme > band and not size_match(a, 1 << scheme):
            continue
        n1 = partitions(scheme, n2)
        cut = np.searchsorted((s >> _U(32)) * _U(n1 * n2) >> _U(32), np.arange(n1 * n2 + 1, dtype=_U))
        part = (total[cut[1:]] - total[cut[:-1]]).reshape(n1, n2)
        filled = np.diff(cut).reshape(n1, n2)
        rares = np.diff(rare[cut]).reshape(n1, n2)
        where = np.arange(n1)
        sig, key, full = [], [], []
        for c, subset in enumerate(combinations(range(n2), n2 - k2)):
            here = part[:, subset].sum(axis=1)
            sig.append(mix64(here + (where * 64 + c).astype(_U) * _U(0x8EBC6AF09C88C6E3) + _U(scheme)))
            full.append(filled[:, subset].any(axis=1))
            key.append(where + n1 * (rares[:, subset].sum(axis=1) == 0))
        key, full, sig = np.stack(key, 1), np.stack(full, 1), np.stack(sig, 1)
        usable = (filled > 0).sum(axis=1) > k2
        over = np.where(full, key, -1).max(axis=1)[usable]
        need = (a // 3) // (k2 + 1)
        if len(over) > need:
            out.append(sig[full & (key <= np.partition(over, need)[need])])
        else:
            out.append(sig[full])
            if scheme == band:
                out.append(mix64(s + _U(0x589965CC75374CC3)))
    return np.unique(np.concatenate(out))


def parities(s: np.ndarray) -> bytes:
    """Bits that tell whether the elements with each ending are odd in number.

    Two sets differ in at least as many elements as their parities differ in
    bits.  A set has 2 to 4 bits for each of its elements (they travel with every
    neighbourhood of the set; unrelated sets of one size still differ in over 0.8 bits an element, linked ones in at most 0.58); a longer
    sketch folds to a shorter one.
    """
    width = min(2 << max(2, len(s).bit_length()), MOST_PARITIES)
    odd = np.bincount((s & _U(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(bool)).tobytes()


def odd_bits(a: bytes, b: bytes) -> int:
    """A lower bound of the number of elements in which two sets differ, from their parities."""
    if len(a) > len(b):
        a, b = b, a
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(y) > len(x):
        y = y[:len(y) // 2] ^ y[len(y) // 2:]
    return int(np.bitwise_count(x ^ y).sum())


def set_sizes(rows: DataFrame) -> DataFrame:
    """``seq, n, content, bits``: the number of shingles of each row's text, a hash of all of them, and their parities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = text_bytes(batch.column(1))
            for i, j in doc_ranges(off, CHUNK):
                sets = shingle_sets(data[off[i]:off[j]], off[i:j + 1] - off[i])
                n = np.array([len(s) for s in sets], np.int64)
                h = mix64(np.array([s.sum(dtype=_U) for s in sets], _U) + n.astype(_U))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(n), pa.array(h.view(np.int64)),
                                                  pa.array([parities(s) for s in sets], pa.binary())], names=["seq", "n", "content", "bits"])

    return rows.select("seq", "text").mapInArrow(lean(run), "seq bigint, n bigint, content bigint, bits binary")


def frequent_shingles(rows: DataFrame, count: int, per_docs: int, least: int) -> np.ndarray:
    """Marks, by the first bits of the hash, shingles that at least ``least`` of every ``per_docs`` rows have (and ``least`` rows at least).

    Every one of the ``count`` rows is counted: a task sums up its rows by the bits, and the sums of equal slices of the
    bits meet.  The marks only order the signatures; whatever they are, no link is lost.
    """
    low = FREQUENT_BITS - SLICE_BITS
    needed = max(least, -(-count * least // per_docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << FREQUENT_BITS, np.uint32)
        for batch in batches:
            data, off = text_bytes(batch.column(0))
            for i, j in doc_ranges(off, CHUNK):
                for s in shingle_sets(data[off[i]:off[j]], off[i:j + 1] - off[i]):
                    spot = (s >> _U(64 - FREQUENT_BITS)).astype(np.int64)  # ascending, as the shingles are
                    total[spot[np.diff(spot, prepend=-1) > 0]] += 1
        for k, part in enumerate(total.reshape(-1, 1 << low)):
            at = np.flatnonzero(part)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([_planes(at.astype(np.uint32))], pa.binary()),
                                                  pa.array([_planes(part[at])], pa.binary())], names=["slice", "at", "n"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None

        def close() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array((np.flatnonzero(total >= needed) + (now << low)).astype(np.int32))], names=["spot"])

        for batch in batches:
            for k, at, n in zip(*(c.to_pylist() for c in batch.columns)):
                if k != now:
                    if now is not None:
                        yield close()
                    now, total = k, np.zeros(1 << low, np.int64)
                total[_numbers(at, np.uint32)] += _numbers(n, np.uint32)
        if now is not None:
            yield close()

    width = shuffle_width(rows.sparkSession)
    sums = rows.select("text").mapInArrow(lean(run), "slice int, at binary, n binary")
    got = sums.repartition(min(width, 1 << SLICE_BITS), "slice").sortWithinPartitions("slice").mapInArrow(lean(gather), "spot int").toArrow()
    marks = np.zeros(1 << FREQUENT_BITS, bool)
    marks[got.column(0).to_numpy()] = True
    return marks


def _planes(x: np.ndarray) -> bytes:
    """Numbers byte by byte (all first bytes, then all second ones ...), which compresses well."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def _numbers(b: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(size, -1).T).view(kind).ravel()


def _emit_signatures(marks, buckets: int, n2: int, k2: int, flush: int = 1 << 20):
    """Signatures in bundles: one row per bucket with the signatures' low halves, ids and set sizes.

    Sets with equal contents inside a bundle emit once (for the least id).
    """

    def bundle(sigs: list, ids: list, sizes: list) -> pa.RecordBatch:
        n = np.array([len(s) for s in sigs])
        sig = np.concatenate(sigs)
        bucket = (sig >> _U(32)) % _U(buckets)
        order = np.argsort(bucket.astype(np.uint16) if buckets <= 1 << 16 else bucket, kind="stable")
        sig, own = sig[order].astype(np.uint32), np.repeat(np.arange(len(n)), n)[order]
        idv, sz = np.array(ids, np.int64)[own], np.array(sizes, np.uint32)[own]
        cut = np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=_U))
        some = np.flatnonzero(np.diff(cut))
        parts = [(_planes(sig[a:b]), _planes(idv[a:b]), _planes(sz[a:b])) for a, b in zip(cut[some].tolist(), cut[some + 1].tolist())]
        return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), *(pa.array(x, pa.binary()) for x in zip(*parts))],
                                          names=["bucket", "sig", "id", "size"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = marks.value
        sigs, ids, sizes, held, seen = [], [], [], 0, {}
        for batch in batches:
            data, off = text_bytes(batch.column(1))
            seq = batch.column(0).to_pylist()
            for i, j in doc_ranges(off, CHUNK):
                for k, s in zip(range(i, j), shingle_sets(data[off[i]:off[j]], off[i:j + 1] - off[i])):
                    if not len(s):
                        continue
                    what = (len(s), int(s.sum(dtype=_U)))
                    at = seen.get(what)
                    if at is not None:
                        ids[at] = min(ids[at], seq[k])
                        continue
                    seen[what] = len(ids)
                    own = signatures(s, frequent, n2, k2)
                    sigs.append(own)
                    ids.append(seq[k])
                    sizes.append(len(s))
                    held += len(own)
                if held >= flush:
                    yield bundle(sigs, ids, sizes)
                    sigs, ids, sizes, held, seen = [], [], [], 0, {}
        if sigs:
            yield bundle(sigs, ids, sizes)
    return run


def _neighbourhoods(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per bucket the distinct ``leader, id``: the sets that have a signature in common, under the smallest of them."""

    def settle(sig: np.ndarray, ids: np.ndarray, size: np.ndarray) -> pa.RecordBatch | None:
        order = np.lexsort((ids, size, sig))
        sig, ids = sig[order], ids[order]
        head = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1])))
        n = np.diff(np.append(head, len(sig)))
        several = np.repeat(n > 1, n)
        pairs = np.unique(np.stack((np.repeat(ids[head], n)[several], ids[several]), 1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["leader", "id"])

    now, held = None, []

    def close() -> pa.RecordBatch:
        parts = [[_numbers(r[k], kind) for r in held] for k, kind in ((0, np.uint32), (1, np.int64), (2, np.uint32))]
        return settle(*(np.concatenate(p) for p in parts))

    for batch in batches:
        for bucket, *row in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if bucket != now and held:
                yield close()
                held = []
            now = bucket
            held.append(row)
    if held:
        yield close()


class _Members:
    """Sets of a neighbourhood by size, with their parities by width."""

    def __init__(self, rows: list[tuple]):
        rows.sort(key=lambda r: (r[1], r[0]))
        self.ids, self.size = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)
        self.component = np.array([r[3] for r in rows], np.int64)
        self.side = np.array([r[4] if len(r) > 4 else 0 for r in rows], np.int8)
        self.two_sides = bool(self.side.any())
        self.until = np.searchsorted(self.size, self.size * 4 // 3, side="right")  # sets that could link by size
        width = np.array([len(r[2]) for r in rows])
        self.width, self.bits = width, {}
        for w in np.unique(width).tolist():  # widths grow with the sizes
            own = [np.frombuffer(r[2], np.uint8) for r in rows if len(r[2]) in (w, 2 * w)]
            self.bits[w] = (int(np.searchsorted(width, w)), np.stack([x if len(x) == w else x[:w] ^ x[w:] for x in own]).view(np.uint64)
                            if w >= 8 else np.stack([x if len(x) == w else x[:w] ^ x[w:] for x in own]))

    def open(self, i: int) -> np.ndarray:
        """The larger members that could link with ``i`` by size, in another component (and on the other side, where there are two)."""
        js = np.arange(i + 1, self.until[i])
        js = js[self.component[js] != self.component[i]]
        return js[self.side[js] != self.side[i]] if self.two_sides else js

    def near(self, i: int, js: np.ndarray) -> np.ndarray:
        """Those of ``js`` (all larger, at most twice as wide) that may link with ``i``."""
        first, bits = self.bits[int(self.width[i])]
        odd = np.bitwise_count(bits[js - first] ^ bits[i - first]).sum(axis=1, dtype=np.int64)
        both = (self.size[i] + self.size[js] - np.maximum(odd, self.size[js] - self.size[i])) // 2
        return js[linked(both, self.size[i] + self.size[js] - both)]


def _open_pairs(turn: int, listed: int = 64, share: int = 4):
    """Members ``leader, id, size, bits, component`` (and, of two blocks, ``side, left, right``) in the order of ``leader`` (and the blocks): ``leader, a, b`` of pairs that may link, in
    different components; ``b`` null marks a neighbourhood that held pairs back."""

    def settle(leader: int, rows: list[tuple]) -> list[tuple]:
        m = _Members(rows)
        g, most = len(rows), share * len(rows) << (2 * turn)
        if g <= listed or turn:
            pairs, total = [], 0
            for i in range(g - 1):
                js = m.open(i)
                if len(js):
                    js = m.near(i, js)
                    total += len(js)
                    pairs.append((i, js))
                    if total > most:
                        break
            if total <= most:
                return [(leader, int(m.ids[i]), int(m.ids[j])) for i, js in pairs for j in js]
        covered, out, held_back = np.zeros(g, bool), [], False
        start = int(np.random.default_rng(turn).integers(g)) if turn else 0  # other leaders each time
        for i in [*range(start, g), *range(start)]:
            if covered[i]:
                held_back = True
                continue
            js = m.open(i)
            if len(js):
                js = m.near(i, js if not held_back else js[~covered[js]])
                held_back |= bool(covered[js].any())  # members before `start` may cover their partners now
                js = js[~covered[js]]
                covered[js] = True
                out += [(leader, int(m.ids[i]), int(m.ids[j])) for j in js]
        return out + ([(leader, leader, None)] if held_back else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, out = None, [], []

        def flush() -> pa.RecordBatch:
            done = pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], pa.int64()) for c in range(3)], names=["leader", "a", "b"])
            out.clear()
            return done

        for batch in batches:
            for leader, *row in zip(*(c.to_pylist() for c in batch.columns)):
                key = (leader, *row[5:])
                if key != now and held:
                    out += settle(now[0], held)
                    held = []
                    if len(out) > 50_000:
                        yield flush()
                now = key
                held.append(tuple(row[:5]))
        if held:
            out += settle(now[0], held)
        yield flush()
    return run


def in_blocks(members: DataFrame, block: int) -> DataFrame:
    """Members ``leader, id, n, bits, component`` dealt to pairs of blocks: also ``side, left, right``.

    A component of more than ``block`` members of a neighbourhood has blocks of its own, about ``block`` members each; the
    others share blocks.  Blocks of the same large component never meet (their pairs are not open); any other two do, and a
    shared block meets itself (``left = right``), so each pair in different components has exactly one place.
    """
    own = members.groupBy("leader", "component").agg(F.count("*").alias("_n"))
    large = F.col("_n") > block
    rest = own.groupBy("leader").agg(F.ceil(F.sum(F.when(large, 0).otherwise(F.col("_n"))) / block).cast("int").alias("_shared"))
    own = own.join(rest, "leader").select(F.col("leader").alias("_l"), F.col("component").alias("_c"), large.alias("_large"),
                                          F.when(large, F.ceil(F.col("_n") / block)).otherwise(F.col("_shared")).cast("int").alias("_parts"))
    name = F.when(F.col("_large"), F.struct(F.col("component").alias("of"), F.pmod(F.xxhash64("id"), F.col("_parts")).cast("int").alias("k"))).otherwise(
        F.struct(F.lit(-1).cast("bigint").alias("of"), F.pmod(F.xxhash64("component"), F.col("_parts")).cast("int").alias("k")))
    dealt = members.join(own, (F.col("leader") == F.col("_l")) & (F.col("component") == F.col("_c"))).select(
        "leader", "id", "n", "bits", "component", name.alias("block"))
    every = own.select(F.col("_l").alias("leader"), F.when(F.col("_large"), F.col("_c")).otherwise(F.lit(-1).cast("bigint")).alias("of"), "_parts").distinct()
    every = every.select("leader", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("k"), "of").select("leader", F.struct("of", "k").alias("left"))
    pairs = every.join(every.select(F.col("leader").alias("_l"), F.col("left").alias("right")),
                       (F.col("leader") == F.col("_l")) & (F.col("left") <= F.col("right"))
                       & ((F.col("left.of") != F.col("right.of")) | (F.col("left.of") == -1))).select("leader", "left", "right")
    to = pairs.select(F.col("leader").alias("_l"), "left", "right", F.explode(F.when(
        F.col("left") == F.col("right"), F.array(F.struct(F.col("left").alias("block"), F.lit(0).alias("side")))).otherwise(
        F.array(F.struct(F.col("left").alias("block"), F.lit(0).alias("side")), F.struct(F.col("right").alias("block"), F.lit(1).alias("side"))))).alias("x"))
    return dealt.join(to, (F.col("leader") == F.col("_l")) & (F.col("block") == F.col("x.block"))).select(
        "leader", "id", "n", "bits", "component", F.col("x.side").alias("side"), "left", "right")


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts in the order of ``a, part, b`` (``b`` null: the text of ``a``): ``a, b, inter, total`` per pair."""
    now, own = None, None
    for batch in batches:
        out: list[tuple] = []
        data, off = text_bytes(batch.column(3))
        a, part, b = (batch.column(i).to_pylist() for i in range(3))
        for i, j in doc_ranges(off, CHUNK):
            for k, s in zip(range(i, j), shingle_sets(data[off[i]:off[j]], off[i:j + 1] - off[i])):
                if b[k] is None:
                    now, own = (a[k], part[k]), s
                elif now == (a[k], part[k]):
                    both = len(np.intersect1d(own, s, assume_unique=True))
                    out.append((a[k], b[k], both, len(own) + len(s) - both))
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], pa.int64()) for c in range(4)], names=["a", "b", "inter", "total"])


def compared(pairs: DataFrame, values: DataFrame, how, per_task: int = 256) -> DataFrame:
    """Set sizes of distinct pairs ``a, b`` by ``how``: ``a, b, inter, total``.  ``values``: ``seq, value``.

    The value of ``b`` goes to where that of ``a`` is; an ``a`` with many partners goes to several places.
    """
    width = shuffle_width(pairs.sparkSession)
    spread = pairs.groupBy("a").count().select(F.col("a").alias("_a"), F.ceil(F.col("count") / per_task).cast("int").alias("_parts"))
    dealt = pairs.join(spread, F.col("a") == F.col("_a")).withColumn("part", F.pmod(F.xxhash64("b"), F.col("_parts")).cast("int"))
    to = dealt.select(F.col("b").alias("_seq"), "a", "part", "b").unionByName(
        spread.select(F.col("_a").alias("_seq"), F.col("_a").alias("a"), F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("part"),
                      F.lit(None).cast("bigint").alias("b")))
    rows = to.join(values, F.col("_seq") == F.col("seq")).select("a", "part", "b", "value")
    return (rows.repartition(width, "a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
            .mapInArrow(lean(how), "a bigint, b bigint, inter bigint, total bigint"))


def similar_groups(rows: DataFrame, n2: int = 1, k2: int = 0, per_docs: int = 4000, least: int = 4, block: int = 4096) -> DataFrame:
    """``seq, n, least_seq``: each row's number of shingles and the least ``seq`` that links lead to.

    ``rows``: ``seq`` (unique) and ``text``.  Neighbourhoods of more than ``block`` sets are compared in tasks of two blocks.
    """
    spark = rows.sparkSession
    ship(spark)
    width = shuffle_width(spark)
    sizes = written(set_sizes(rows), "sets")
    marks = spark.sparkContext.broadcast(frequent_shingles(rows, sizes.count(), per_docs, least))  # 2**FREQUENT_BITS marks
    near = (rows.select("seq", "text").mapInArrow(lean(_emit_signatures(marks, 4 * width, n2, k2)), "bucket int, sig binary, id binary, size binary")
            .repartition(width, "bucket").sortWithinPartitions("bucket")
            .mapInArrow(lean(_neighbourhoods), "leader bigint, id bigint"))
    near = written(near.distinct(), "neighbourhoods")
    marks.destroy()  # what follows reads the written neighbourhoods
    large = written(near.groupBy(F.col("leader").alias("_large")).agg(F.count("*").alias("_n"), F.min("id").alias("_hub"))
                    .where(F.col("_n") > block).select("_large", "_hub"), "large")
    any_large = not large.isEmpty()
    # rows with equal contents are one set: that of the least row
    rep = sizes.where("n > 0").select("seq", F.struct("content", "n").alias("_c"))
    rep = rep.join(rep.groupBy("_c").agg(F.min("seq").alias("rep")), "_c").select("seq", "rep")

    def groups_of(links: DataFrame) -> DataFrame:
        """Components of the links, and of the rows in them with the other rows of the same contents."""
        nodes = links.select("a").union(links.select("b")).distinct()
        return components(links.unionByName(nodes.join(rep, F.col("a") == F.col("seq")).where("seq <> rep").select("a", F.col("rep").alias("b"))), "a", "b")

    comp = texts = exact = None
    turn = 0
    while True:
        members = near.join(sizes.select("seq", "n", "bits"), F.col("id") == F.col("seq"))
        known = F.col("id") if comp is None else F.coalesce("component", "id")
        if comp is not None:
            members = members.join(comp, F.col("id") == F.col("node"), "left")
        members = members.select("leader", "id", "n", "bits", known.alias("component"))
        ddl, is_large = "leader bigint, a bigint, b bigint", F.col("leader") == F.col("_large")
        found = ((members.join(large, is_large, "left_anti") if any_large else members).repartition(width, "leader")
                 .sortWithinPartitions("leader").mapInArrow(lean(_open_pairs(turn)), ddl))
        if any_large and not turn:  # large ones: all with the least member first, which leaves few blocks that must meet
            found = found.unionByName(near.join(large, is_large).select(
                "leader", F.col("_hub").alias("a"), F.when(F.col("id") != F.col("_hub"), F.col("id")).alias("b")))
        elif any_large:
            found = found.unionByName(in_blocks(members.join(large, is_large, "left_semi"), block).repartition(width, "leader", "left", "right")
                                      .sortWithinPartitions("leader", "left", "right").mapInArrow(lean(_open_pairs(turn)), ddl))
        found = written(found, "pairs")
        pairs = found.where("b is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        near = near.join(found.where("b is null").select(F.col("leader").alias("_l")), F.col("leader") == F.col("_l"), "left_semi")
        if texts is None:  # later pairs are members of the neighbourhoods that come again
            used = pairs.select("a").union(pairs.select("b")).union(near.select("id")).distinct().select(F.col("a").alias("_s"))
            texts = written(rows.select("seq", F.col("text").alias("value")).join(used, F.col("seq") == F.col("_s"), "left_semi"), "texts")
        else:
            pairs = pairs.join(exact.select("a", "b"), ["a", "b"], "left_anti")
        now = written(compared(pairs, texts, _compare), "compared")
        exact = now if exact is None else exact.unionByName(now)
        comp = groups_of(exact.where(linked(F.col("inter"), F.col("total"))).select("a", "b"))
        turn += 1
        if near.isEmpty():
            break
        near = written(near, "neighbourhoods")
    root = comp.select(F.col("node").alias("_node"), "component")
    return (sizes.select("seq", "n").join(rep.withColumnRenamed("seq", "_s"), F.col("seq") == F.col("_s"), "left")
            .join(root, F.col("rep") == F.col("_node"), "left")
            .select("seq", "n", F.coalesce("component", "rep", "seq").alias("least_seq")))


def join_groups(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """``doc_id, n_shingles, component_id`` per row of ``docs``.

    Texts without words (null, empty, blanks) have no shingles and stay alone.
    Repeated rows are rows of their own, linked if they have words; null ids come
    first in the order, so a group that holds one has a null ``component_id``.
    An empty table gives no rows; other columns are ignored.
    """
    rows = in_order(docs.select("doc_id", F.col(text_col).alias("text")), "text")
    got = similar_groups(rows.select("seq", "text"), **options)
    ids = rows.select("seq", "doc_id")
    return (got.join(ids, "seq").join(ids.select(F.col("seq").alias("_l"), F.col("doc_id").alias("component_id")), F.col("least_seq") == F.col("_l"))
            .select("doc_id", F.col("n").alias("n_shingles"), "component_id"))


def keep_one_per_group(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The first row (least ``doc_id``, then text) of each group, with the columns of ``docs``."""
    rows = in_order(apart(docs, text_col), "text")
    got = similar_groups(rows.select("seq", "text"), **options)
    drop = got.where("seq <> least_seq").select(F.col("seq").alias("_s"))
    return rows.join(drop, F.col("seq") == F.col("_s"), "left_anti").select(
        *[F.col(f"`{inner_name(c, text_col)}`").alias(c) for c in docs.columns])
