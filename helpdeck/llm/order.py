"""A unique order of rows: by ``doc_id``, then by text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEQ = "seq"


def apart(docs: DataFrame, text_col: str) -> DataFrame:
    """``doc_id, text`` and every other column as ``in_<name>``, so no name meets one that a job adds."""
    return docs.select("doc_id", F.col(f"`{text_col}`").alias("text"),
                       *[F.col(f"`{c}`").alias(f"in_{c}") for c in docs.columns if c not in ("doc_id", text_col)])


def inner_name(name: str, text_col: str) -> str:
    return "text" if name == text_col else name if name == "doc_id" else f"in_{name}"


def in_order(docs: DataFrame, text_col: str = "text", seq: str = SEQ) -> DataFrame:
    """``docs`` with ``seq``: unique, and ascending by ``doc_id`` (nulls first), then by text.

    Unique ids are their own order.  Otherwise rows are numbered: sorted by range, numbered within
    each range and shifted by the ranges before it.
    """
    repeated = docs.groupBy("doc_id").count().where("doc_id is null or count > 1")
    if repeated.isEmpty():
        return docs.withColumn(seq, F.col("doc_id").cast("bigint"))
    from helpdeck.operators.changes import sequence_numbers

    numbered = docs.withColumn("_tie", F.monotonically_increasing_id())
    return sequence_numbers(numbered, [F.col("doc_id").asc_nulls_first(), F.col(text_col).asc_nulls_first(), F.col("_tie")], name=seq).drop("_tie")
