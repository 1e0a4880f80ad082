"""Frozen files: manifests of code and of model folders with a digest to pin elsewhere, and receipts that open once."""

from __future__ import annotations

import hashlib
import json
import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docprism.sources.tables import bundle, open_bundle, same_set

#: A manifest names at most this many files; more is an error, never a cut.
MAX_FILES = 10_000


def digest(text: str | bytes) -> str:
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def tree(spark: SparkSession, folder: str) -> DataFrame:
    """``name, sha256`` of every file below the folder, names relative to it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    plain = lambda address: re.sub("^[a-z0-9]+:(?://[^/]*)?", "", address)
    root = plain(folder).rstrip("/") + "/"
    # the listing gives whole addresses: the name is what stands behind the folder, whose path may come again below it
    path = F.regexp_replace("path", "^[a-z0-9]+:(?://[^/]*)?", "")
    return files.select(F.substring(path, F.lit(len(root) + 1), F.length(path)).alias("name"), F.sha2("content", 256).alias("sha256"))


def freeze_tree(spark: SparkSession, folder: str, manifest: str, identity: dict[str, str]) -> str:
    """Write the manifest of a folder beside it, never over another one; returns its digest, to be kept elsewhere."""
    rows = tree(spark, folder).limit(MAX_FILES + 1).collect()
    if not 0 < len(rows) <= MAX_FILES:
        raise ValueError(f"a folder of 1 to {MAX_FILES} files is needed")
    text = bundle({"identity": identity, "files": {r["name"]: r["sha256"] for r in rows}})
    with open(manifest, "x", encoding="utf-8") as file:
        file.write(text)
    return digest(text)


def verify_tree(spark: SparkSession, folder: str, manifest: str, pin: str, identity: dict[str, str] | None = None) -> dict:
    """The manifest's parameters, if it has the pinned digest and the identity and the folder holds its files and no others."""
    text = Path(manifest).read_text(encoding="utf-8")
    if digest(text) != pin.lower():
        raise ValueError("the manifest does not have the pinned digest")
    held = open_bundle(text)
    if identity is not None and held["identity"] != identity:
        raise ValueError("the manifest is of another model")
    expected = spark.createDataFrame(list(held["files"].items()), "name string, sha256 string")
    wrong = same_set(expected, tree(spark, folder)).limit(5).collect()
    if wrong:
        raise ValueError(f"the folder differs from its manifest: {[(r['side'], r['name']) for r in wrong]}")
    return held


def freeze_code(root: str, names: tuple[str, ...], version: str) -> dict:
    """Version and digests of the files that make the policy."""
    return {"version": version, "code": {name: digest((Path(root) / name).read_bytes()) for name in names}}


def verify_code(held: dict, root: str, names: tuple[str, ...], version: str) -> None:
    """Raise if version, set of files or the content of one has changed since the freeze."""
    if held.get("version") != version or set(held.get("code", {})) != set(names):
        raise ValueError("the freeze is of another policy")
    now = freeze_code(root, names, version)["code"]
    changed = sorted(name for name in names if now[name] != held["code"][name])
    if changed:
        raise ValueError(f"changed since the freeze: {changed}")


def open_once(path: str, facts: dict) -> None:
    """Reserve the only evaluation: written before any held-out label is read; a second call raises, however the first one ended."""
    try:
        with open(path, "x", encoding="utf-8") as file:
            json.dump({"status": "started", **facts}, file, sort_keys=True)
    except FileExistsError:
        raise ValueError("this candidate's evaluation has been opened before") from None
