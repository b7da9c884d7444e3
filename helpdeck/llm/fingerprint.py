"""Document fingerprints: a Merkle tree over paragraphs and sections.

A document is its sections (parted by empty lines, by headings that start with
``#``, and after every ``section_lines`` paragraphs whose digest says so), a
section is its paragraphs (lines), and a paragraph is its chunks: runs of
about ``1 << CHUNK_BITS`` words that end where the bytes before a blank say so,
so an edit moves the cuts only around itself.  A node's digest is the digest of
its children's digests; equal roots mean equal texts, and unequal branches
lead to the edits.

A fingerprint is written ``root;section;section...``, a section as
``digest:paragraph,paragraph...`` and a paragraph as the digests of its chunks,
so two fingerprints can be compared without the texts.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helpdeck.llm.common import ship
from helpdeck.operators.pieces import piece_of

CHUNK_BITS, LEAF, NODE, ROOT = 3, 4, 8, 16  # bits of the cut rule; bytes of the digests
SECTION_BITS = 3


def _digest(data: bytes, size: int) -> bytes:
    return hashlib.blake2b(data, digest_size=size).digest()


def chunk_cuts(data: bytes) -> np.ndarray:
    """Places (after a blank) where chunks end, by the four bytes before the blank."""
    if len(data) < 6:
        return np.zeros(0, np.int64)
    b = np.frombuffer(data, np.uint8)
    at = np.flatnonzero(b[4:-1] == 32) + 4
    h = np.zeros(len(at), np.uint32)
    for k in range(1, 5):
        h = (h << np.uint32(8)) | b[at - k]
    return at[(h * np.uint32(0x9E3779B1)) >> np.uint32(32 - CHUNK_BITS) == 0] + 1


def sections(text: str) -> list[tuple[bytes, list[bytes]]]:
    """``(section digest, paragraph strings)`` of a text; a paragraph string is its leaf digests."""
    out, lines, digests = [], [], []

    def close() -> None:
        if digests:
            out.append((_digest(b"S" + b"".join(digests), NODE), lines.copy()))
            lines.clear()
            digests.clear()

    data = text.encode("utf-8", "surrogatepass")
    cuts = chunk_cuts(data).tolist()
    start = 0
    for para in data.split(b"\n"):
        end = start + len(para)
        if not para.strip() or para[:1] == b"#":
            close()
        at, leaves = start, []
        for cut in cuts[bisect_right(cuts, start):bisect_right(cuts, end - 1)]:
            leaves.append(_digest(data[at:cut], LEAF))
            at = cut
        leaves.append(_digest(data[at:end], LEAF))
        whole = _digest(b"P" + para, NODE)
        lines.append(b"".join(leaves))
        digests.append(whole)
        if whole[0] & ((1 << SECTION_BITS) - 1) == 0:
            close()
        start = end + 1
    close()
    return out


def fingerprint(text: str) -> str:
    tree = sections(text)
    root = _digest(b"D" + b"".join(d for d, _ in tree), ROOT).hex()
    return ";".join([root] + [d.hex() + ":" + ",".join(p.hex() for p in paras) for d, paras in tree])


def _tree(fp: str) -> list[tuple[str, list[str]]]:
    return [(s[:2 * NODE], s[2 * NODE + 1:].split(",")) for s in fp.split(";")[1:]]


def _leaves(paragraphs: list[str]) -> list[str]:
    w = 2 * LEAF
    return [p[i:i + w] for p in paragraphs for i in range(0, len(p), w)]


def likeness(a: str, b: str) -> float:
    """Dice coefficient of the leaves of two fingerprints: 1 with equal roots; sections with equal
    digests are matched whole, only the differing branches are opened."""
    if a[:2 * ROOT] == b[:2 * ROOT]:
        return 1.0
    ta, tb = _tree(a), _tree(b)
    same = Counter(d for d, _ in ta) & Counter(d for d, _ in tb)
    matched = total = 0
    rest: list[Counter] = []
    for tree in (ta, tb):
        left, open_ = Counter(same), Counter()
        for d, paras in tree:
            size = sum(map(len, paras)) // (2 * LEAF)
            total += size
            if left[d] > 0:
                left[d] -= 1
                matched += size
            else:
                open_.update(_leaves(paras))
        rest.append(open_)
    matched += 2 * sum((rest[0] & rest[1]).values())
    return matched / total if total else 1.0


def edits(a: str, b: str) -> list[tuple[int, int]]:
    """The paragraphs of ``b`` (from 0) that ``a`` lacks, as ranges ``[from, to)``: sections whose
    digest ``a`` has are skipped whole, in the others the paragraphs are compared."""
    if a[:2 * ROOT] == b[:2 * ROOT]:
        return []
    ta = _tree(a)
    known, lines = Counter(d for d, _ in ta), Counter(p for _, paras in ta for p in paras)
    out: list[tuple[int, int]] = []
    at = 0
    for d, paras in _tree(b):
        if known[d] > 0:
            known[d] -= 1
            lines.subtract(paras)
        else:
            for i, p in enumerate(paras, at):
                if lines[p] > 0:
                    lines[p] -= 1
                elif out and out[-1][1] == i:
                    out[-1] = (out[-1][0], i + 1)
                else:
                    out.append((i, i + 1))
        at += len(paras)
    return out


def edited(text: str, following: str) -> str:
    """``text`` with its last quarter of code points replaced by the first as many of ``following``."""
    n = len(text) // 4
    return text[:len(text) - n] + following[:n]


def successors(docs: DataFrame, fn, ddl: str, text_col: str = "text", rows_per_range: int = 2000) -> DataFrame:
    """``fn(doc_id, text, next_text)`` per row, ``next_text`` being the text of the next row in the
    order of ``doc_id`` (then of the text); after the last row comes the first.

    Ids sampled by hash part the rows into ranges; the rows whose id starts a
    range go to the range before it too, as what follows its last row.  So one
    shuffle of the texts serves, each task reads its ranges in order and holds
    two rows at a time.  Null ids come first, as one id.
    """
    key = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63)))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), key.alias("_key"))
    n, first = rows.agg(F.count("*"), F.min("_key")).first()
    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, min(4 * width, n // rows_per_range))
    # ids with the smallest hashes, so the cuts are values of the column themselves, however large
    found = rows.select("_key").orderBy(F.xxhash64("_key"), "_key").limit(16 * parts).collect() if parts > 1 else []
    keys = sorted({r[0] for r in found} - {first})
    step = max(1, len(keys) // parts)
    cuts = keys[step::step]
    rows = rows.withColumn("_range", piece_of(rows, ["_key"], [(c,) for c in cuts]))
    starts = [first, *cuts] if first is not None else []
    before = F.when(F.col("_key") == (starts[0] if starts else 0), F.lit(len(starts) - 1)).otherwise(F.col("_range") - 1)
    seam = F.col("_key").isin(starts) if starts else F.lit(False)  # becomes a set: one look-up a row
    rows = rows.withColumn("_to", F.explode(F.when(seam, F.array(F.struct(F.col("_range").alias("r"), F.lit(0).alias("s")),
                                                                 F.struct(before.alias("r"), F.lit(1).alias("s"))))
                                            .otherwise(F.array(F.struct(F.col("_range").alias("r"), F.lit(0).alias("s"))))))
    dealt = (rows.select(F.col("_to.r").alias("_range"), F.col("_to.s").alias("_seam"), "_key", "doc_id", "text")
             .repartition(width, "_range").sortWithinPartitions("_range", "_seam", "_key", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # (range, doc_id, text) whose successor is still to come
        for batch in batches:
            out = []
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500).to_pydict()
                for r, s, d, t in zip(part["_range"], part["_seam"], part["doc_id"], part["text"]):
                    if held is not None and held[0] == r:
                        out.append(fn(held[1], held[2], t))
                        held = None
                    if not s:
                        held = (r, d, t)
            if out:
                yield pa.RecordBatch.from_pydict({k: [x[k] for x in out] for k in out[0]})

    ship(docs.sparkSession)
    return dealt.select("_range", "_seam", "doc_id", "text").mapInArrow(run, ddl)


def fingerprint_frame(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``,
    and ``first_edit`` (the first paragraph of the edited text that differs; -1: none), per row.

    A null text counts as empty.  Repeated rows are rows of their own (each
    follows the other); a single row is followed by itself; an empty table
    gives no rows; other columns are ignored.
    """
    last: dict[str, object] = {"text": None, "fp": None}

    def one(doc_id, text: str, following: str) -> dict:
        fp = last["fp"] if last["text"] == text else fingerprint(text)
        new = edited(text, following)
        fp_new, fp_next = fingerprint(new), fingerprint(following)
        last["text"], last["fp"] = following, fp_next
        where = edits(fp, fp_new)
        return {"doc_id": doc_id, "n_chars": len(text), "edited_sha256": hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(),
                "fingerprint": fp, "edited_fingerprint": fp_new, "near_edited": likeness(fp, fp_new),
                "near_next": likeness(fp, fp_next), "first_edit": where[0][0] if where else -1}

    ddl = ("doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
           "near_edited double, near_next double, first_edit bigint")
    return successors(docs, one, ddl, text_col)
