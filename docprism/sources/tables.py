"""Readers and writers: Parquet tables, CSV corpora, texts, JSON rows, inventories, manifests."""

from __future__ import annotations

import atexit
import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TEXT_NAMES = ("clean_text", "text", "content", "body", "html")
CATEGORY_NAMES = ("category", "label", "lang", "source")


#: Where the session does not say it itself: bytes of rows that are handed to Python at a time, and rows of texts that a scan decodes at a time.
BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": "4m", "spark.sql.parquet.columnarReaderBatchSize": "512"}


def bound_batches(spark: SparkSession) -> None:
    """Bound what a task holds of whole texts, unless the session has bounds of its own."""
    for key, value in BATCHES.items():
        if not spark.conf._jconf.contains(key):
            spark.conf.set(key, value)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where it is unset, a folder of our own, on a single machine only."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="docprism-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


_folders: set[str] = set()


def _delete(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is None:  # the session has ended
        return
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: later plans see one and the same result, and lineage ends.

    Tables go when :func:`forget` says so, the rest when the driver ends.
    """
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/docprism/{spark.sparkContext.applicationId}/cuts"
    if folder not in _folders:
        _folders.add(folder)
        atexit.register(_delete, spark, folder)
    path = f"{folder}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def forget(*frames: DataFrame) -> None:
    """Delete tables of :func:`cut` that no later plan reads."""
    for frame in frames:
        _delete(frame.sparkSession, frame._cut_path)


def read_csv(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """CSV with a header; with a schema, a row that breaks it is an error."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    return reader.schema(schema).option("mode", "FAILFAST").csv(path) if schema else reader.csv(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A split manifest: string ids trimmed and lower-cased, labels 0 or 1; refuses held-out names, bad labels and repeated files."""
    if any(word in path.rsplit("/", 1)[-1].lower() for word in ("test", "holdout")):
        raise ValueError(f"{path} is named like held-out data")
    rows = read_csv(spark, path, "source_id string, file string, label string")
    rows = rows.select(F.lower(F.trim("source_id")).alias("source_id"), F.trim("file").alias("file"), F.expr("try_cast(label as int)").alias("label"))
    bad = rows.where("source_id is null or source_id = '' or file is null or label is null or label not in (0, 1)")
    if not bad.isEmpty() or not rows.groupBy("file").count().where("count > 1").isEmpty():
        raise ValueError("the manifest has incomplete, mislabelled or repeated rows")
    return rows


def resolve_manifest(manifest: DataFrame, files: DataFrame, limit: int = 16 << 20) -> DataFrame:
    """Manifest rows with the size and digest of their files (of an :func:`inventory`); a missing, empty or too large file is an error."""
    found = manifest.join(files, manifest["file"] == files["path"], "left").drop("path")
    bad = found.where(F.col("size").isNull() | (F.col("size") == 0) | (F.col("size") > limit))
    if not bad.isEmpty():
        raise ValueError(f"files of the manifest are missing, empty or over {limit} bytes: {[r[0] for r in bad.select('file').limit(5).collect()]}")
    return found


def same_set(expected: DataFrame, found: DataFrame) -> DataFrame:
    """Rows on one side only, as often as they are more there: ``side`` (missing or unexpected) and the columns; empty if the two are equal."""
    return expected.exceptAll(found).withColumn("side", F.lit("missing")).unionByName(found.exceptAll(expected).withColumn("side", F.lit("unexpected")))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """One row a plain text file: ``path, text``."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_rows(spark: SparkSession, path: str, schema) -> DataFrame:
    """JSON rows in a fixed schema; anything else is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def inventory(files: DataFrame) -> DataFrame:
    """Of a binary-file table: path, size, digest, and whether the content begins like a PDF."""
    return files.select("path", F.length("content").cast("long").alias("size"), F.sha2("content", 256).alias("sha256"), (F.substring("content", 1, 5) == F.lit(b"%PDF-")).alias("is_pdf"))


def digest_mismatches(rows: DataFrame, content: str, expected: str) -> DataFrame:
    """Rows whose content has another SHA-256 than recorded; empty if all is well."""
    return rows.where(F.coalesce(F.sha2(F.col(content), 256) != F.col(expected), F.lit(True)))


def find_column(df: DataFrame, names: tuple[str, ...], default: str | None = None):
    """First column among the candidate names, or the default as a constant."""
    for name in names:
        if name in df.columns:
            return F.col(name)
    if default is None:
        raise ValueError(f"none of the columns {names}")
    return F.lit(default)


def bounded_pages(pages: DataFrame, limit: int = 100_000) -> DataFrame:
    """Fold pages (``doc_id, page, text``) into documents, cut where their running length passes ``limit``; counts pages without text."""
    from pyspark.sql import Window

    before = F.coalesce(F.sum(F.length("text")).over(Window.partitionBy("doc_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = pages.withColumn("_kept", F.substring(F.col("text"), F.lit(1), F.greatest(F.lit(limit) - before, F.lit(0)).cast("int")))
    parts = F.array_sort(F.collect_list(F.struct("page", F.coalesce("_kept", F.lit("")).alias("text"))))
    return kept.groupBy("doc_id").agg(
        F.array_join(F.transform(parts, lambda p: p["text"]), "\n").alias("text"),
        F.count_if(F.coalesce(F.trim("text"), F.lit("")) == "").alias("pages_without_text"),
        (F.sum(F.length("text")) > limit).alias("truncated"),
    )


def write_new(df: DataFrame, path: str, by: str | None = None) -> None:
    """Parquet, partitioned by a column if named; an existing path is an error, never overwritten."""
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(by) if by else writer).parquet(path)


def write_receipts(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)


def report(title: str, rows: list[dict]) -> str:
    """Markdown table of a few collected aggregate rows."""
    if not rows:
        return f"# {title}\n\nNo rows.\n"
    names = list(rows[0])
    lines = [f"# {title}", "", "| " + " | ".join(names) + " |", "|" + " --- |" * len(names)]
    return "\n".join(lines + ["| " + " | ".join("" if r[n] is None else str(r[n]) for n in names) + " |" for r in rows]) + "\n"


def bundle(parameters: dict) -> str:
    """Canonical JSON of a parameter set with its own SHA-256."""
    import hashlib

    body = json.dumps(parameters, sort_keys=True, separators=(",", ":"), allow_nan=False)
    return json.dumps({"parameters": parameters, "sha256": hashlib.sha256(body.encode()).hexdigest()}, sort_keys=True)


def open_bundle(text: str) -> dict:
    import hashlib

    def once(pairs):
        out = dict(pairs)
        if len(out) != len(pairs):
            raise ValueError("repeated key")
        return out

    held = json.loads(text, object_pairs_hook=once)
    if set(held) != {"parameters", "sha256"}:
        raise ValueError("unexpected keys")
    body = json.dumps(held["parameters"], sort_keys=True, separators=(",", ":"), allow_nan=False)
    if hashlib.sha256(body.encode()).hexdigest() != held["sha256"]:
        raise ValueError("the parameters do not match their digest")
    return held["parameters"]


def metrics_text(rows: list[tuple[str, dict, float]]) -> str:
    """Metric rows (name, labels, value) in the text exposition format; backslashes, quotes and line feeds in labels are escaped."""
    escaped = lambda v: str(v).replace("\\", r"\\").replace('"', r"\"").replace("\n", r"\n")
    label = lambda d: "{" + ",".join(f'{k}="{escaped(v)}"' for k, v in sorted(d.items())) + "}" if d else ""
    return "".join(f"{name}{label(d)} {value:g}\n" for name, d, value in rows)
