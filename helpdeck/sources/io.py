"""Sources and sinks.

* Snapshots (A6/A7) are per-table Parquet directories under one snapshot
  folder plus a ``_published`` marker written last; readers accept only a
  marked snapshot, so a half-written export is never restored. Task retries
  are handled by Spark's output commit protocol; nothing is overwritten in
  place.
* File inventories (A8/A9) use the ``binaryFile`` source selecting only
  ``path``/``length``: the file contents are never read.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helpdeck.functions.text import file_extension
from helpdeck.session import checkpoint_dir

# ---- fixed values (must equal the reference) -------------------------------
ALLOWED_MIMES = ["image/jpeg", "image/png", "image/gif", "image/webp", "image/heic", "image/heif",
                 "application/pdf", "video/mp4", "video/webm", "video/quicktime",
                 "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "application/vnd.ms-excel"]
MAX_UPLOAD_BYTES = 10 * 1024 * 1024
MAX_RESTORE_BYTES = 100 * 1024 * 1024
# -----------------------------------------------------------------------------

# extension -> MIME type as browsers report it (public IANA registrations)
EXTENSION_MIME = {
    ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".png": "image/png", ".gif": "image/gif",
    ".webp": "image/webp", ".heic": "image/heic", ".heif": "image/heif", ".pdf": "application/pdf",
    ".mp4": "video/mp4", ".webm": "video/webm", ".mov": "video/quicktime",
    ".xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    ".xls": "application/vnd.ms-excel", ".csv": "text/csv", ".json": "application/json",
    ".parquet": "application/vnd.apache.parquet", ".txt": "text/plain", ".html": "text/html",
}

MARKER = "_published"


# ------------------------------------------------------------------ A4, A5
def read_sheet_csv(spark: SparkSession, path: str) -> DataFrame:
    """A4 product sheet exported as CSV (header row): every column as text,
    plus ``row_no``, an increasing row-order key for last-row-wins."""
    df = spark.read.option("header", True).option("inferSchema", False).csv(path)
    return df.withColumn("row_no", F.monotonically_increasing_id())


def export_json(df: DataFrame, path: str) -> None:
    """A5 JSON-lines export (one object per row)."""
    df.write.mode("errorifexists").json(path)


# ------------------------------------------------------------------ publish
def publish(df: DataFrame, base: str) -> str:
    """Write a new version of a table under ``<base>/v=<version>`` and only
    then its marker ``<base>/_published/<version>``. Readers use the newest
    marked version, so a failed or half-written job never replaces the table
    and nothing is overwritten in place. Returns the version folder."""
    spark = df.sparkSession
    base = base.rstrip("/")
    version = f"{int(time.time() * 1000):013d}-{uuid.uuid4().hex[:8]}"
    path = f"{base}/v={version}"
    df.write.mode("errorifexists").parquet(path)
    spark.createDataFrame([(version,)], "version string").coalesce(1) \
        .write.mode("errorifexists").json(f"{base}/_published/{version}")
    return path


def read_published(spark: SparkSession, base: str) -> DataFrame:
    """The newest published version of a table written with ``publish``."""
    base = base.rstrip("/")
    latest = spark.read.schema("version string").json(f"{base}/_published/*").agg(F.max("version")).first()[0]
    if latest is None:
        raise FileNotFoundError(f"no published version under {base}")
    return spark.read.parquet(f"{base}/v={latest}")


def _filesystem(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def list_names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder of whatever store the path belongs to (none where it does not exist)."""
    fs, p = _filesystem(spark, path)
    return sorted(f.getPath().getName() for f in fs.listStatus(p)) if fs.exists(p) else []


def remove_folder(spark: SparkSession, path: str) -> None:
    fs, p = _filesystem(spark, path)
    fs.delete(p, True)


def publish_set(tables: dict[str, DataFrame], base: str) -> str:
    """Write several tables as one version: ``<base>/v=<version>/<table>`` each, then a single marker that names them. Readers
    see all tables of a version or none of them. Returns the version's folder."""
    spark = next(iter(tables.values())).sparkSession
    base = base.rstrip("/")
    version = f"{int(time.time() * 1000):013d}-{uuid.uuid4().hex[:8]}"
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{base}/v={version}/{name}")
    spark.createDataFrame([(version, sorted(tables))], "version string, tables array<string>").coalesce(1) \
        .write.mode("errorifexists").json(f"{base}/_published/{version}")
    return f"{base}/v={version}"


def read_published_set(spark: SparkSession, base: str) -> dict[str, DataFrame]:
    """The tables of the newest version written with ``publish_set``; all from that version."""
    base = base.rstrip("/")
    marks = spark.read.schema("version string, tables array<string>").json(f"{base}/_published/*")
    last = marks.agg(F.max(F.struct("version", "tables")).alias("m")).first()["m"]
    if last is None:
        raise FileNotFoundError(f"no published version under {base}")
    return {t: spark.read.parquet(f"{base}/v={last['version']}/{t}") for t in last["tables"]}


# ------------------------------------------------------------------ A6, A7
def snapshot_export(tables: dict[str, DataFrame], base: str | None = None, label: str | None = None) -> str:
    """A6 write every table under ``<base>/snapshot=<label>/<table>`` and the
    marker last. ``base`` defaults to the shared checkpoint folder."""
    spark = next(iter(tables.values())).sparkSession
    base = (base or f"{checkpoint_dir(spark).rstrip('/')}/snapshots").rstrip("/")
    label = label or uuid.uuid4().hex[:12]
    root = f"{base}/snapshot={label}"
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{root}/{name}")
    spark.createDataFrame([(label, len(tables))], "label string, tables int") \
        .coalesce(1).write.mode("errorifexists").json(f"{root}/{MARKER}")
    return root


def snapshot_manifest(spark: SparkSession, root: str, names: list[str]) -> DataFrame:
    """Row count per table of a written snapshot, read back from storage."""
    parts = [spark.read.parquet(f"{root}/{n}").agg(F.count(F.lit(1)).alias("rows"))
             .select(F.lit(n).alias("table_name"), "rows") for n in names]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def snapshot_restore_check(spark: SparkSession, root: str, expected: dict[str, T.StructType],
                           count_table: str = "users") -> DataFrame:
    """A7 validate a snapshot before publishing it: the marker exists, every
    expected table is readable Parquet whose columns include the expected
    ones with the same types, and ``count_table`` can be counted.

    One row per table: (table_name, readable, schema_ok, rows, restorable);
    ``restorable`` is the same for all rows: every check passed.
    """
    rows = []
    try:
        marker_ok = spark.read.json(f"{root}/{MARKER}").limit(1).count() == 1
    except Exception:  # noqa: BLE001 - an unreadable marker means "not published"
        marker_ok = False
    for name, schema in expected.items():
        readable, schema_ok, n = False, False, None
        try:
            df = spark.read.parquet(f"{root}/{name}")
            readable = True
            got = {f.name: f.dataType for f in df.schema.fields}
            schema_ok = all(got.get(f.name) == f.dataType for f in schema.fields)
            n = df.count() if name == count_table else None
        except Exception:  # noqa: BLE001 - any read failure marks the table unreadable
            pass
        rows.append((name, readable, schema_ok, n))
    all_ok = marker_ok and all(r[1] and r[2] for r in rows) and any(
        r[0] == count_table and r[3] is not None for r in rows)
    return spark.createDataFrame(
        [(name, readable, schema_ok, n, all_ok) for name, readable, schema_ok, n in rows],
        "table_name string, readable boolean, schema_ok boolean, rows long, restorable boolean")


class RestoreRefused(ValueError):
    """A snapshot that may not replace the tables; the published ones stay as they are."""


def snapshot_restore(spark: SparkSession, root: str, expected: dict[str, T.StructType], base: str, count_table: str = "users",
                     max_bytes: int | None = None) -> str:
    """A7 replace the published set of tables under ``base`` by a snapshot's: all of them, or none.

    Refused (``RestoreRefused``), with nothing changed, if a check of ``snapshot_restore_check`` fails, or if the snapshot
    has more than ``max_bytes`` (the desk's own limit for an upload is ``MAX_RESTORE_BYTES``; None: no limit). Columns
    beyond the expected ones are kept. A job that dies while it copies leaves no marker, so the old set stays current.
    Returns the folder of the new version.
    """
    checks = snapshot_restore_check(spark, root, expected, count_table).collect()  # one row a table
    bad = [r["table_name"] for r in checks if not (r["readable"] and r["schema_ok"])]
    if not all(r["restorable"] for r in checks):
        raise RestoreRefused(f"not restorable: {bad or 'no marker, or no count'}")
    if max_bytes is not None:
        size = sum(file_inventory(spark, f"{root}/{t}").agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0] for t in expected)
        if size > max_bytes:
            raise RestoreRefused(f"{size} bytes, more than {max_bytes}")
    return publish_set({t: spark.read.parquet(f"{root}/{t}") for t in expected}, base)


# ------------------------------------------------------------------ A8, A9
def file_inventory(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Files under ``path`` (recursive) with name, extension, MIME and size;
    the content column is never selected, so no file body is read."""
    df = (spark.read.format("binaryFile").option("pathGlobFilter", glob)
          .option("recursiveFileLookup", True).load(path).select("path", "length"))
    mime_map = F.create_map(*[x for k, v in EXTENSION_MIME.items() for x in (F.lit(k), F.lit(v))])
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    ext = F.lower(file_extension(F.col("path")))
    return df.select("path", name.alias("name"), ext.alias("extension"),
                     F.coalesce(mime_map[ext], F.lit("application/octet-stream")).alias("mime"),
                     F.col("length").alias("bytes"))


def file_inventory_size(inventory: DataFrame) -> DataFrame:
    """A8 total bytes of an inventory, shown as KB and as MB with one
    decimal (``toFixed(1)``: no digit grouping, halves up)."""
    b = F.col("bytes")
    return (inventory.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))
            .withColumn("kb_display", F.concat(F.format_string("%.1f", b / F.lit(1024.0)), F.lit(" KB")))
            .withColumn("mb_display", F.concat(F.format_string("%.1f", b / F.lit(1048576.0)), F.lit(" MB"))))


def file_accept(inventory: DataFrame, max_bytes: int = MAX_UPLOAD_BYTES) -> DataFrame:
    """A9 upload filter on an inventory: MIME in the allow-list and at most
    ``max_bytes``; the reason is given for refused files."""
    mime_ok = F.col("mime").isin(*ALLOWED_MIMES)
    size_ok = F.col("bytes") <= max_bytes
    return inventory.withColumn("accepted", mime_ok & size_ok).withColumn(
        "reason", F.when(~mime_ok, F.lit("mime")).when(~size_ok, F.lit("size")).otherwise(F.lit("ok")))
