"""Shared helpers: Arrow batches in and out, byte views of text columns."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separators between words, as a Java / RE2 / Python character class body.
WS = r"\x20\x09-\x0D"
WS_CHARS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application (they may not have it on their path)."""
    sc = spark.sparkContext
    if getattr(sc, "_helpdeck_shipped", False):
        return
    import helpdeck

    root = os.path.dirname(os.path.abspath(helpdeck.__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="helpdeck-"), "helpdeck.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(root)))
    sc.addPyFile(archive)  # the driver serves the file to the executors
    sc._helpdeck_shipped = True


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of at most ``rows`` rows where the session has not said how many: a task and its Python worker each
    hold a batch going in and one coming out, and whole texts are in them."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, rows)


def text_bytes(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All values of a string column as one byte array and its offsets (null: empty)."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    arr = pc.fill_null(arr.cast(pa.large_binary()), b"")
    bufs = arr.buffers()
    off = np.frombuffer(bufs[1], dtype=np.int64)[arr.offset:arr.offset + len(arr) + 1]
    data = np.frombuffer(bufs[2], dtype=np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    return data[off[0]:off[-1]], off - off[0]


def doc_ranges(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Runs of whole documents of about ``limit`` bytes (one document at least)."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def strings(arr: pa.Array) -> list[str]:
    return ["" if x is None else x for x in arr.to_pylist()]


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run``, whose worker gives its free memory back when a task ends: it waits for tasks of other steps then, beside the
    other workers of its executor, and what its allocators keep counts as the executor's."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            for pool in (pa.default_memory_pool(), pa.system_memory_pool()):
                pool.release_unused()
    return task


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema) -> DataFrame:
    """``mapInArrow`` with a function of one batch; empty batches are skipped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield fn(batch)

    ship(df.sparkSession)
    return df.mapInArrow(lean(run), schema)


def with_columns(batch: pa.RecordBatch, extra: dict[str, pa.Array]) -> pa.RecordBatch:
    """The batch's columns, then ``extra`` (which replace columns of the same name)."""
    names = [n for n in batch.schema.names if n not in extra]
    return pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(n)) for n in names]
                                      + list(extra.values()), names=names + list(extra))


def extended(df: DataFrame, ddl: dict[str, str]) -> str:
    """DDL of ``df`` without the columns of ``ddl``, followed by them."""
    keep = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name not in ddl]
    return ", ".join(keep + [f"`{k}` {v}" for k, v in ddl.items()])


def mix64(h: np.ndarray) -> np.ndarray:
    """Finalising mix of 64-bit hashes (multiply and fold)."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xD1342543DE82EF95)
    return h ^ (h >> np.uint64(32))


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared checkpoint folder and read it back (cuts the lineage)."""
    from helpdeck.session import scratch_path

    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def row_key(*cols: str):
    """Two hash columns that identify a row by its values (nulls included)."""
    return [F.xxhash64(*cols).alias("k1"), F.hash(*reversed(cols)).alias("k2")]


#: Keys are dealt to so many slots before their slots are broadcast: the bound of that broadcast, whatever the corpus.
SLOTS = 1 << 20


def thinned(rows: DataFrame, key, keys: DataFrame, others: bool = False) -> DataFrame:
    """The rows whose ``key`` (a column expression; null: none) shares a slot with a key of the one-column frame ``keys``.

    No shuffle of ``rows``; rows with other keys of these slots remain, so an exact join follows.  With ``others`` the remaining
    rows instead: those whose key is certainly not among ``keys``.
    """
    slots = keys.select(F.pmod(F.xxhash64(keys.columns[0]), F.lit(SLOTS)).alias("_slot")).distinct()
    return (rows.withColumn("_slot", F.when(key.isNotNull(), F.pmod(F.xxhash64(key), F.lit(SLOTS))))
            .join(F.broadcast(slots), "_slot", "left_anti" if others else "left_semi").drop("_slot"))
