"""Byte-level BPE encoding and decoding with tiktoken and a local rank file.

Texts longer than ``piece_chars`` are split first at safe boundaries: before
a blank that follows a non-blank.  Every alternative of the pattern is an
optional leading blank, one run of non-blanks, or a run of blanks, so a match
never reaches from a non-blank over a following blank; and the look-ahead of
the trailing-blanks alternative looks only at what follows.  The ids of the
pieces, one after the other, are therefore those of the whole text.

A very long run of blanks has no such boundary, and the library's matcher cannot follow it.  By the pattern the run
is one match up to its last blank, which goes with what follows (at the end of the text: all of it), so that
match is encoded by itself.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from helpdeck.llm.common import arrow_map, extended, strings, with_columns

_SAFE = re.compile(r"(?<=\S) ")
#: Longer runs of blanks are matches by themselves.
LONG_RUN = 4096
_BLANKS = regex.compile(r"\p{White_Space}{%d,}+" % LONG_RUN)


@functools.lru_cache(maxsize=4)
def encoding(rank_file: str, pattern: str):
    """The tiktoken encoding of a rank file, one per Python worker."""
    import tiktoken

    with open(rank_file, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("local_ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def safe_pieces(text: str, piece_chars: int) -> list[str]:
    """Consecutive pieces of ``text`` of at least ``piece_chars`` code points, cut at safe
    boundaries only (so a text without one stays whole)."""
    out, start = [], 0
    while len(text) - start > piece_chars:
        m = _SAFE.search(text, start + piece_chars)
        if m is None:
            break
        out.append(text[start:m.start()])
        start = m.start()
    out.append(text[start:])
    return out


def encode(text: str, enc, piece_chars: int = 1 << 16) -> list[int]:
    if len(text) <= LONG_RUN:
        return enc.encode_ordinary(text)
    ids: list[int] = []
    start = 0
    for run in _BLANKS.finditer(text):
        end = run.end() if run.end() == len(text) else run.end() - 1
        ids += _ordinary(text[start:run.start()], enc, piece_chars)
        ids += enc._encode_single_piece(text[run.start():end])  # without the pattern
        start = end
    return ids + _ordinary(text[start:], enc, piece_chars)


def _ordinary(text: str, enc, piece_chars: int) -> list[int]:
    ids: list[int] = []
    for piece in safe_pieces(text, piece_chars) if len(text) > piece_chars else [text]:
        ids += enc.encode_ordinary(piece)
    return ids


def decode(ids: list[int], enc) -> bytes:
    """The raw bytes of the ids (a cut inside a character stays as it is)."""
    return enc.decode_bytes(ids)


def encode_frame(docs: DataFrame, rank_file: str, pattern: str, text_col: str = "text",
                 keep_ids: bool = True, piece_chars: int = 1 << 16) -> DataFrame:
    """``docs`` with ``ids`` (array, when ``keep_ids``), ``n_tokens``, ``ids_sha256`` and
    ``decoded_sha256`` of every whole text.

    A null or empty text has no ids (its hashes are those of no bytes).  Rows
    are encoded one by one, so repeated rows stay, and columns of the result's
    names are replaced.  One pass, no shuffle.
    """
    ddl = {"n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"}
    if keep_ids:
        ddl = {"ids": "array<int>", **ddl}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        enc = encoding(rank_file, pattern)
        names = _decimal(enc.n_vocab)
        all_ids, n, hid, hdec = [], [], [], []
        for text in strings(batch.column(batch.schema.get_field_index(text_col))):
            ids = encode(text, enc, piece_chars)
            n.append(len(ids))
            hid.append(hashlib.sha256(",".join([names[i] for i in ids]).encode()).hexdigest())
            hdec.append(hashlib.sha256(decode(ids, enc)).hexdigest())
            if keep_ids:
                all_ids.append(ids)
        extra = {"ids": pa.array(all_ids, pa.list_(pa.int32()))} if keep_ids else {}
        return with_columns(batch, extra | {"n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(hid, pa.string()),
                                            "decoded_sha256": pa.array(hdec, pa.string())})

    return arrow_map(docs, run, extended(docs, ddl))


@functools.lru_cache(maxsize=4)
def _decimal(n: int) -> list[str]:
    return [str(i) for i in range(n)]
