"""Contains filters without a full scan: a table of trigrams (B5, B8).

``x LIKE '%needle%'`` can use no ordinary statistics. A postings table has, per trigram and field of the searched columns, lists of
the ids whose text holds it (a list per some ten thousands of rows, so the shuffle and the sort move lists, not single ids),
kept in folders by a checksum of the trigram. A needle's literal stretches (between its ``%`` and ``_``) give
trigrams that every match must hold; only their folders are read, the ids that have all of them are candidates, and the
filter itself is applied to the candidates' rows. A needle without three literal characters in a row has no
trigram: it is left to the filter alone, over all rows.
"""

from __future__ import annotations

import re
import string
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helpdeck.operators.filters import contains_like

GRAM = 3
BUCKETS = 64
ROWS = 1 << 16  # rows of a table to one round of lists
_FOLD = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def trigrams(needle: str) -> list[str]:
    """Trigrams that every text with the needle holds (ASCII letters folded); none for short stretches."""
    parts = re.split("[%_]", needle.translate(_FOLD))
    return sorted({p[i:i + GRAM] for p in parts for i in range(len(p) - GRAM + 1)})


def bucket(gram: str) -> int:
    return zlib.crc32(gram.encode()) % BUCKETS


def _lists(fields: list[str], gram: int = GRAM, most: int = ROWS):
    """Rows ``id, *fields`` to ``gram, field, ids``. It is sent to the tasks by value: they need not have this package."""

    def settle(ids: pa.Array, field: str, values: list) -> pa.RecordBatch:
        texts = ["" if x is None else x.decode("utf-8", "replace") for x in values]
        code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        code[(code >= 65) & (code <= 90)] += np.uint64(32)  # SQLite folds ASCII letters only
        row = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        n = max(len(code) - gram + 1, 0)
        key = np.zeros(n, np.uint64)
        for k in range(gram):
            key = key << np.uint64(21) | code[k:k + n]
        inside = row[:n] == row[len(row) - n:]
        key, row = key[inside], row[:n][inside]
        order = np.argsort(key, kind="stable")
        key, row = key[order], row[order]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        first = new.copy()  # a text that holds a trigram twice is listed once
        first[1:] |= row[1:] != row[:-1]
        head = np.flatnonzero(new[first])
        key, row = key[first], row[first]
        mask = (1 << 21) - 1
        grams = ["".join(chr(x >> 21 * k & mask) for k in reversed(range(gram))) for x in key[head].tolist()]
        lists = pa.ListArray.from_arrays(pa.array(np.append(head, len(key)).astype(np.int32)), ids.take(pa.array(row)))
        return pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), pa.array([field] * len(grams), pa.string()), lists], names=["gram", "field", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def close() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held)
            ids = t.column(0).combine_chunks()
            for i, field in enumerate(fields):
                yield settle(ids, field, t.column(i + 1).to_pylist())

        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= most:
                yield from close()
                held, rows = [], 0
        if rows:
            yield from close()
    return run


def postings(df: DataFrame, fields: list[str], id_col: str = "id") -> DataFrame:
    """``bucket, gram, field, ids`` of the given text columns (NULL has none): lists that together hold every row's id once
    for each trigram of its text."""
    rows = df.select(F.col(id_col).alias("id"), *[F.col(c).cast("binary").alias(f"f{i}") for i, c in enumerate(fields)])
    lists = rows.mapInArrow(_lists(fields), f"gram string, field string, ids array<{df.schema[id_col].dataType.simpleString()}>")
    return lists.select((F.crc32(F.col("gram").cast("binary")) % BUCKETS).cast("int").alias("bucket"), "gram", "field", "ids")


def write_postings(df: DataFrame, path: str) -> None:
    """Folders by bucket, sorted by trigram, so a read skips the other folders and most row groups of its own."""
    df.repartition("bucket", F.pmod(F.xxhash64("ids"), F.lit(8))).sortWithinPartitions("bucket", "gram", "field").write.partitionBy("bucket").parquet(path)


def candidates(index: DataFrame, field: str, needle: str) -> DataFrame | None:
    """Ids whose ``field`` may hold the needle (all that do are among them); None where the needle has no trigram."""
    grams = trigrams(needle)
    if not grams:
        return None
    hits = index.filter(F.col("bucket").isin(sorted({bucket(g) for g in grams})) & (F.col("field") == field) & F.col("gram").isin(grams))
    return hits.select(F.explode("ids").alias("id")).groupBy("id").agg(F.count("*").alias("n")).filter(F.col("n") == len(grams)).select("id")


def contains_filter(df: DataFrame, index: DataFrame, needles: dict[str, str | None], id_col: str = "id") -> DataFrame:
    """The rows of ``df`` whose columns contain the given needles (empty ones filter nothing): ``contains_like``
    on the candidates of ``index``, which holds the postings of ``df`` by ``id_col``."""
    for field, needle in needles.items():
        if needle:
            ids = candidates(index, field, needle)
            if ids is not None:
                df = df.join(ids.withColumnRenamed("id", "_found"), F.col(id_col) == F.col("_found"), "left_semi")
            df = df.filter(contains_like(field, needle))
    return df
