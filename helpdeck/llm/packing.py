"""Sequence packing by minimum bin slack.

A document's ids (with a closing id) fill whole sequences first; what is left
(fewer ids than a sequence) is packed by minimum bin slack: a subset-sum
dynamic program over a bitset finds the multiset of remaining lengths whose
total comes closest to the capacity, its counts are backtracked, and the
choice is repeated as often as the counts allow.  The lengths that are left
at the end of a group are cut: their ids, one after the other, are laid into
sequences whose lengths are powers of two, which need no padding.

Groups are runs of documents of one task, so packing needs no shuffle; a
group's table of remaining lengths has at most ``capacity`` entries.
"""

from __future__ import annotations

import functools
import itertools
import os
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helpdeck.llm.common import lean, ship

#: Words the direct path handles: visible ASCII and Latin letters, no blanks or controls.
_PLAIN = re.compile(r"[\x21-\x7e\xa1-\xac\xae-ſ]+")
#: The pieces of a lower-cased word; must equal the split pattern in the tokenizer file.
_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"


@functools.lru_cache(maxsize=1)
def _byte_chars() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary: a visible
    Latin-1 character for itself, the others in turn from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class WordEncoder:
    """Ids of texts by a ``tokenizers`` file whose pre-tokenizer drops white space.

    No piece reaches over white space, so each distinct word of a batch is
    encoded once, and known pieces are kept from batch to batch (``limit``
    entries; the table starts anew when it is full).  Plain words go straight
    to the file's BPE model, any other word through the whole tokenizer.
    """

    def __init__(self, path: str, limit: int = 400_000):
        import regex
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.markers = sorted({t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()})
        self.model, self.limit = self.tokenizer.model, limit
        self.split = regex.compile(_PIECES).findall
        self.known: dict[str, bytes] = {}

    def piece(self, piece: str) -> bytes:
        ids = self.known.get(piece)
        if ids is None:
            if len(self.known) >= self.limit:
                self.known.clear()
            table = _byte_chars()
            shown = piece if piece.isascii() else "".join([table[b] for b in piece.encode()])
            ids = self.known[piece] = np.array([t.id for t in self.model.tokenize(shown)], np.uint32).tobytes()
        return ids

    def word(self, word: str) -> bytes:
        if not _PLAIN.fullmatch(word) or not (word.isascii() or unicodedata.is_normalized("NFC", word)):
            return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, np.uint32).tobytes()
        word = word.lower()
        if word.isalpha():
            return self.piece(word)
        return b"".join([self.piece(p) for p in self.split(word)])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a string array and the offsets of its values (null: none).

        Texts that hold one of the tokenizer's own markers are encoded whole: there a marker is one id, and what
        stands next to it is cut at its ends.
        """
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        marked = np.zeros(len(texts), bool)
        for m in self.markers:
            sign = "".join(itertools.takewhile(lambda c: not c.isalpha(), m))  # the same in either case
            some = np.flatnonzero(pc.match_substring(texts, sign).to_numpy(zero_copy_only=False))
            marked[some] |= pc.match_substring(pc.utf8_lower(texts.take(pa.array(some))), m).to_numpy(zero_copy_only=False)
        if not marked.any():
            return self._plain(texts)
        ids, starts = self._plain(pc.if_else(pa.array(marked), "", texts))
        parts = [ids[starts[i]:starts[i + 1]] for i in range(len(texts))]
        for i in np.flatnonzero(marked).tolist():
            parts[i] = np.array(self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids, np.uint32)
        return np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts])))

    def _plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        words = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
        starts = words.offsets.to_numpy().astype(np.int64)
        coded = words.values.slice(starts[0], starts[-1] - starts[0]).dictionary_encode()
        starts = starts - starts[0]
        own = [self.word(w) if w else b"" for w in coded.dictionary.to_pylist()]
        size = np.fromiter(map(len, own), np.int64, len(own)) // 4
        flat = np.frombuffer(b"".join(own), np.uint32)
        first = np.concatenate(([0], np.cumsum(size)))
        which = coded.indices.to_numpy()
        n = size[which]
        at = np.concatenate(([0], np.cumsum(n)))
        ids = flat[np.repeat(first[which] - at[:-1], n) + np.arange(at[-1])] if len(which) else flat[:0]
        return ids, at[starts]


@functools.lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def fill(counts: np.ndarray, capacity: int) -> dict[int, int]:
    """The multiset of lengths (``counts[l]`` of each at hand) with the largest total within
    ``capacity``: a bitset subset-sum with one bitset per used length, then backtracked counts.

    Lengths go in from the longest; the search ends when the capacity is hit exactly.
    """
    mask, reach = (1 << (capacity + 1)) - 1, 1
    before: list[tuple[int, int, int]] = []
    for length in np.flatnonzero(counts)[::-1].tolist():
        have = min(int(counts[length]), capacity // length)
        if not have:
            continue
        before.append((length, have, reach))
        left, step = have, 1
        while left:  # counts in powers of two
            take = min(step, left)
            reach |= (reach << (take * length)) & mask
            left, step = left - take, step * 2
        if reach >> capacity & 1:
            break
    total, chosen = reach.bit_length() - 1, {}
    for length, have, bits in reversed(before):
        used = 0
        while not bits >> total & 1:  # fewest of this length that leaves a reachable rest
            total, used = total - length, used + 1
        if used:
            chosen[length] = used
    return chosen


def pack(lengths: np.ndarray, capacity: int, sequence0: int = 0) -> list[tuple[int, int, int, int, int]]:
    """Pieces ``(document, start, length, sequence, offset)`` of documents with these lengths.

    Every id is in exactly one piece; offsets in a sequence are gapless from 0.
    Whole sequences first, then minimum bin slack over the rests; sequences that
    stay short, and all that remains, are cut into sequences of powers of two.
    """
    out, seq = [], sequence0
    rest: list[list[int]] = [[] for _ in range(capacity)]
    counts = np.zeros(capacity, np.int64)
    for d, n in enumerate(lengths.tolist()):
        at = 0
        while n - at >= capacity:
            out.append((d, at, capacity, seq, 0))
            seq, at = seq + 1, at + capacity
        if n > at:
            rest[n - at].append(d)
            counts[n - at] += 1
    while counts.any():
        chosen = fill(counts, capacity)
        if sum(k * v for k, v in chosen.items()) < capacity:
            break
        for _ in range(min(int(counts[k]) // v for k, v in chosen.items())):
            offset = 0
            for length, used in chosen.items():
                for _ in range(used):
                    d = rest[length].pop()
                    out.append((d, int(lengths[d]) - length, length, seq, offset))
                    offset += length
                counts[length] -= used
            seq += 1
    queue = [(d, length) for length in range(capacity - 1, 0, -1) for d in rest[length]]
    total, room, offset = sum(n for _, n in queue), 0, 0
    for d, n in queue:
        while n:
            if not room:
                room, offset = min(capacity, 1 << (total.bit_length() - 1)) if total < capacity else capacity, 0
            take = min(n, room)
            out.append((d, int(lengths[d]) - n, take, seq, offset))
            n, room, offset, total = n - take, room - take, offset + take, total - take
            if not room:
                seq += 1
    return out


def pack_frame(docs: DataFrame, tokenizer_file: str, capacity: int = 2048, end_id: int = 1,
               group_ids: int = 1 << 21, text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Pack every whole text of ``docs`` (``doc_id`` and ``text_col``; null text: only the end id).

    One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset`` (and ``ids`` when ``keep_ids``).  Groups are closed
    at ``group_ids`` ids, so memory is bounded by a group and the longest
    document.  Repeated rows are packed as documents of their own, a null
    ``doc_id`` stays null, an empty table gives no rows, other columns are not
    read.  ``sequence_id`` is the partition's number times 2**36 plus a running
    number, the same when a task runs again.  Capacities are powers of two.
    """
    if capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    ddl = ("doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, "
           "`offset` bigint" + (", ids array<int>" if keep_ids else ""))

    def close(doc_ids: list, parts: list[np.ndarray], sizes: list[np.ndarray], seq: int) -> tuple[pa.RecordBatch, int]:
        lengths = np.concatenate(sizes)
        ids = np.concatenate(parts)
        first = np.concatenate(([0], np.cumsum(lengths)))
        pieces = pack(lengths, capacity, seq)
        d, start, length, sequence, offset = map(np.array, zip(*pieces))
        view = memoryview(ids.astype("<u4")).cast("B")
        at = (first[d] + start) * 4
        crc = [zlib.crc32(view[a:b]) for a, b in zip(at.tolist(), (at + length * 4).tolist())]
        cols = [pa.array([doc_ids[i] for i in d.tolist()], pa.int64()), start, length, pa.array(crc, pa.int64()), lengths[d],
                sequence, offset]
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        if keep_ids:
            cols.append(pa.array([ids[a // 4:a // 4 + n].tolist() for a, n in zip(at.tolist(), length.tolist())],
                                 pa.list_(pa.int32())))
            names.append("ids")
        cols = [c if isinstance(c, pa.Array) else pa.array(c, pa.int64()) for c in cols]
        return pa.RecordBatch.from_arrays(cols, names=names), int(sequence.max()) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        seq = TaskContext.get().partitionId() << 36
        enc = word_encoder(tokenizer_file)
        doc_ids: list = []
        parts: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        held = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                ids, off = enc.encode(part.column(1))
                n = np.diff(off)
                own = np.full(len(ids) + len(n), end_id, np.uint32)
                own[np.arange(len(ids)) + np.repeat(np.arange(len(n)), n)] = ids
                doc_ids += part.column(0).to_pylist()
                parts.append(own)
                sizes.append(n + 1)
                held += len(own)
                if held >= group_ids:
                    out, seq = close(doc_ids, parts, sizes, seq)
                    yield out
                    doc_ids, parts, sizes, held = [], [], [], 0
        if doc_ids:
            yield close(doc_ids, parts, sizes, seq)[0]

    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(lean(run), ddl)
