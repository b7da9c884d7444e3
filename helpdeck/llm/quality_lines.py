"""Quality rules: counts per document, and cross-document line frequency.

DataFrame functions only.  Everything about one document is array arithmetic
inside its row; what meets across documents is one row per (document, line),
pre-aggregated by (host, line, text) before each shuffle.  The hot
keys (a line, a host) are only ever grouped with partial aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helpdeck.llm.common import WS, WS_CHARS, row_key

#: Fixed by the contract: a document needs this many words, and at most this share of repeated ones.
MIN_WORDS, MAX_REPEAT_PCT = 50, 50
NO_SYMBOLS = "[^#*$%&|<>]+"


def words_of(text: Column) -> Column:
    """The words of a text (maximal runs without separators); none for null."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(WS_CHARS))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, f"[{WS}]+", -1))


def line_key(line: Column) -> Column:
    """A line as it is counted: A-Z lower-cased, digits as 0, separators as one blank, trimmed."""
    # `lower` is much faster than `translate`, and the same where all characters are of one byte
    low = F.when(F.octet_length(line) == F.char_length(line), F.lower(line)).otherwise(
        F.translate(line, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return F.btrim(F.regexp_replace(F.regexp_replace(low, "[1-9]", "0"), f"[{WS}]+", " "), F.lit(" "))


def _pairs(arr: str, n: str) -> Column:
    """Neighbours ``(a, b)`` of an array column of size ``n``."""
    m = F.greatest(F.col(n) - 1, F.lit(0))
    return F.arrays_zip(F.slice(arr, 1, m).alias("a"), F.slice(arr, 2, m).alias("b"))


def base_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed``.

    A null text has no words (it fails).  ``n_repeat_words`` counts the words
    inside 3-word windows that the text holds twice or more: the windows'
    hashes are sorted with their places, equal neighbours give the places, and
    the union of the windows there is summed up.  No shuffle.  Columns of these
    names are replaced; every row is judged by itself, repeated or not.
    """
    text = F.col(text_col)
    keep = [F.col(f"`{c}`") for c in docs.columns if c not in OUT_BASE]
    d = docs.select(*keep, words_of(text).alias("_w"),
                    F.octet_length(F.regexp_replace(F.coalesce(text, F.lit("")), NO_SYMBOLS, "")).cast("long").alias("n_symbols"),
                    F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1),
                             lambda x: F.btrim(x, F.lit(WS_CHARS)) != "").alias("_l"))
    d = d.withColumn("n_words", F.size("_w").cast("long")).withColumn("word_chars", F.char_length(F.array_join("_w", "")).cast("long"))
    d = d.withColumn("n_dup_lines", (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"))
    d = d.withColumn("_h", F.transform("_w", lambda w: F.xxhash64(w))).drop("_w", "_l")
    d = d.withColumn("_m", F.greatest(F.col("n_words") - 2, F.lit(0)).cast("int"))
    d = d.withColumn("_t", F.transform(
        F.arrays_zip(F.slice("_h", 1, F.col("_m")).alias("a"), F.slice("_h", 2, F.col("_m")).alias("b"),
                     F.slice("_h", 3, F.col("_m")).alias("c")), lambda t: F.xxhash64(t["a"], t["b"], t["c"]))).drop("_h")
    d = d.withColumn("_s", F.when(F.size(F.array_distinct("_t")) == F.col("_m"), F.array().cast("array<struct<h:bigint,i:int>>"))
                     .otherwise(F.sort_array(F.transform("_t", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))).drop("_t")
    d = d.withColumn("_n", F.size("_s"))
    d = d.withColumn("_p", F.sort_array(F.array_distinct(F.flatten(F.transform(
        F.filter(_pairs("_s", "_n"), lambda p: p["a"]["h"] == p["b"]["h"]),
        lambda p: F.array(p["a"]["i"], p["b"]["i"]))))))
    d = d.withColumn("_n", F.size("_p"))
    d = d.withColumn("n_repeat_words", F.aggregate(
        _pairs("_p", "_n"), F.when(F.col("_n") > 0, F.lit(3)).otherwise(F.lit(0)).cast("long"),
        lambda acc, p: acc + F.least(F.lit(3), p["b"] - p["a"]).cast("long")))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PCT * F.col("n_words"))
    return d.select(*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"))


OUT_BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def document_lines(docs: DataFrame, host_col: str = "source", text_col: str = "text") -> DataFrame:
    """One row per line with a word: ``k1, k2`` (the row's key), ``host, line`` (hash of the
    normalised line), ``content`` (hash of the whole text), ``words``."""
    keys = F.filter(F.transform(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1), line_key), lambda k: k != "")
    # a key has one blank between words
    one = F.transform(keys, lambda k: F.struct(F.xxhash64(k).alias("line"),
                                               (F.octet_length(k) - F.octet_length(F.replace(k, F.lit(" "), F.lit(""))) + 1).alias("words")))
    d = docs.select(*row_key("doc_id", host_col, text_col), F.col(host_col).alias("host"),
                    F.xxhash64(F.col(text_col)).alias("content"), F.explode(one).alias("x"))
    return d.select("k1", "k2", "host", F.col("x.line").alias("line"), "content", F.col("x.words").cast("long").alias("words"))


def frequent_lines(lines: DataFrame, max_docs: int) -> DataFrame:
    """``host, line`` of the lines above the limit: in more than ``max_docs`` different texts of the
    host (copies of a document count once, so they do not make its own lines frequent)."""
    texts = lines.select("host", "line", "content").distinct()
    return texts.groupBy("host", "line").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") > max_docs).select("host", "line")


def line_verdicts(docs: DataFrame, host_col: str = "source", text_col: str = "text", max_docs: int = 50,
                  min_left: float = 0.3) -> DataFrame:
    """Per document with frequent lines: ``k1, k2, removed_words, removed_lines`` (distinct line
    hashes) and ``depleted`` (less than ``min_left`` of its words remain)."""
    lines = document_lines(docs, host_col, text_col)
    hit = frequent_lines(lines, max_docs).select(
        F.col("host").alias("_host"), F.col("line").alias("_line"), F.lit(True).alias("_hit"))
    per = (lines.join(hit, (F.col("line") == F.col("_line")) & F.col("host").eqNullSafe(F.col("_host")), "left")
           .groupBy("k1", "k2").agg(
               F.sum(F.when(F.col("_hit"), F.col("words"))).alias("removed_words"), F.sum("words").alias("_all"),
               F.collect_set(F.when(F.col("_hit"), F.col("line"))).alias("removed_lines")))
    return per.where(F.col("removed_words").isNotNull()).select(
        "k1", "k2", "removed_words", "removed_lines",
        (F.col("_all") - F.col("removed_words") < min_left * F.col("_all")).alias("depleted"))


def quality(docs: DataFrame, host_col: str = "source", text_col: str = "text", **limits) -> DataFrame:
    """Verdict per row of ``docs``: ``doc_id``, the base counts, ``kept`` and ``removed_words``.

    ``kept`` is false for a base failure and for a document that frequent lines
    deplete (``line_verdicts``).  Repeated rows share their key, so their
    words and frequent words double alike and they get the same verdict.  A
    null host is a host of its own; null texts have no lines; an empty table
    gives no rows; other columns are ignored.
    """
    d = base_counts(docs.select("doc_id", F.col(host_col).alias("host"), F.col(text_col).alias("text")))
    keyed = d.select("doc_id", *row_key("doc_id", "host", "text"), *OUT_BASE)
    verdict = line_verdicts(docs, host_col, text_col, **limits).drop("removed_lines")
    return keyed.join(verdict, ["k1", "k2"], "left").select(
        "doc_id", *OUT_BASE, (~F.col("base_failed") & ~F.coalesce(F.col("depleted"), F.lit(False))).alias("kept"),
        F.coalesce(F.col("removed_words"), F.lit(0)).alias("removed_words"))


def apply_quality(docs: DataFrame, host_col: str = "source", text_col: str = "text", **limits) -> DataFrame:
    """The rows that pass, with their frequent lines taken out of the text.

    Columns stay those of ``docs``; ``n_chars``, where there is one, is counted
    anew for the rows whose text changed.
    """
    # the flags are aggregated by key, so the filter stays above the counts instead of repeating their expressions
    slim = base_counts(docs.select("doc_id", F.col(host_col).alias("host"), F.col(text_col).alias("text")))
    flags = (slim.select(*row_key("doc_id", "host", "text"), "base_failed").groupBy("k1", "k2")
             .agg(F.max("base_failed").alias("_failed")))
    verdict = line_verdicts(docs, host_col, text_col, **limits).select("k1", "k2", "removed_lines", "depleted")
    verdict = flags.join(verdict, ["k1", "k2"], "left").where(~F.col("_failed") & ~F.coalesce(F.col("depleted"), F.lit(False)))
    rows = docs.select(*[F.col(f"`{c}`") for c in docs.columns], *row_key("doc_id", host_col, text_col))
    joined = rows.join(verdict.select("k1", "k2", "removed_lines"), ["k1", "k2"])
    left = F.concat_ws("\n", F.filter(F.split(F.col(text_col), "\n", -1),
                                      lambda x: ~F.array_contains("removed_lines", F.xxhash64(line_key(x)))))
    changed = F.col("removed_lines").isNotNull()
    out = joined.withColumn(text_col, F.when(changed, left).otherwise(F.col(text_col)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(changed, F.char_length(text_col)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
