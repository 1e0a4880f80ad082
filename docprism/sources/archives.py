"""Entries of archives as rows: size, digest, signature, content address, and what their names say."""

from __future__ import annotations

import hashlib
import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: First bytes of the kinds of files that a corpus may hold.
SIGNATURES = {"pdf": b"%PDF-", "zip": b"PK\x03\x04", "png": b"\x89PNG", "jpeg": b"\xff\xd8\xff"}
MAX_ENTRY = 16 << 20
_PIECE = 1 << 20
_ROW = "archive string, entry string, size long, sha256 string, signature string, address string, error string"


def _read(archive: str, held: zipfile.ZipFile, info: zipfile.ZipInfo, limit: int) -> tuple:
    """Row of one entry, read in pieces; what can't be read has an error in place of a digest."""
    none = (None, None, None)
    if info.flag_bits & 1:
        return archive, info.filename, info.file_size, *none, "encrypted"
    if info.file_size > limit:
        return archive, info.filename, info.file_size, *none, "too_large"
    digest, size, head = hashlib.sha256(), 0, b""
    try:
        with held.open(info) as file:
            while piece := file.read(_PIECE):
                head = head or piece[:8]
                size += len(piece)
                if size > limit:  # whatever the directory says
                    return archive, info.filename, size, *none, "too_large"
                digest.update(piece)
    except Exception as error:  # each decompressor has errors of its own; the row says which
        return archive, info.filename, info.file_size, *none, f"damaged: {type(error).__name__}"
    sha = digest.hexdigest()
    kind = next((k for k, sign in SIGNATURES.items() if head.startswith(sign)), "other")
    return archive, info.filename, size, sha, kind, f"{sha[:2]}/{sha}", None


def entries(spark: SparkSession, path: str, limit: int = MAX_ENTRY) -> DataFrame:
    """A row for each file in each archive below ``path``, directories aside.

    Contents stay in the task that reads the archive.  An entry that is encrypted,
    longer than ``limit`` or damaged has an ``error``; an archive that can't be
    opened is one row without an entry.  Nothing is raised.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.zip").load(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                try:
                    with zipfile.ZipFile(io.BytesIO(content.as_buffer())) as held:
                        rows = [_read(name, held, info, limit) for info in held.infolist() if not info.is_dir()]
                except (zipfile.BadZipFile, OSError, ValueError) as error:
                    rows = [(name, None, len(content.as_buffer()), None, None, None, f"not an archive: {type(error).__name__}")]
                if rows:
                    kinds = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[c.split()[0] for c in _ROW.split(", ")])

    return files.select(F.element_at(F.split("path", "/"), -1).alias("path"), "content").mapInArrow(run, _ROW)


def named(rows: DataFrame, name: str | Column = "entry") -> DataFrame:
    """``rows`` with ``group, variant, attack`` from names like ``folder/group__variant__attack.pdf`` (no attack: null); other names have none of them."""
    name = F.col(name) if isinstance(name, str) else name
    stem = F.regexp_replace(F.element_at(F.split(name, "/"), -1), r"\.[A-Za-z0-9]+$", "")
    parts = F.split(stem, "__")
    fits = F.size(parts).between(2, 3) & F.forall(parts, lambda p: p.rlike("^[A-Za-z0-9-]+$"))
    return rows.withColumns({"group": F.when(fits, F.get(parts, F.lit(0))), "variant": F.when(fits, F.get(parts, F.lit(1))), "attack": F.when(fits, F.get(parts, F.lit(2)))})


def reconciled(found: DataFrame, expected: DataFrame, keys: tuple[str, ...] = ("group", "variant", "attack")) -> DataFrame:
    """``keys, n_found, n_expected, state``: ``missing``, ``unexpected``, ``repeated`` or ``ok``; null keys are keys."""
    count = lambda df, c: df.groupBy(*keys).agg(F.count("*").alias(c))
    f, e = count(found, "n_found").alias("f"), count(expected, "n_expected").alias("e")
    on = [F.col(f"f.{k}").eqNullSafe(F.col(f"e.{k}")) for k in keys]
    both = f.join(e, on, "full").select(*[F.coalesce(f"f.{k}", f"e.{k}").alias(k) for k in keys], F.coalesce("n_found", F.lit(0)).alias("n_found"), F.coalesce("n_expected", F.lit(0)).alias("n_expected"))
    state = F.when(F.col("n_found") == 0, "missing").when(F.col("n_expected") == 0, "unexpected").when((F.col("n_found") > 1) | (F.col("n_expected") > 1), "repeated").otherwise("ok")
    return both.withColumn("state", state)
