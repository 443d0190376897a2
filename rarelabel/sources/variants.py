"""Data-set variants, published whole.

A variant is a folder of versions and a manifest that names the current one.  A new
version is written beside the old, counted, and only then named; the manifest is
replaced by one rename, so a run that fails leaves the old variant as it was, and a
reader sees one or the other.  The old version is removed last.
"""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession

from .libsvm import read_libsvm, to_dense, write_libsvm
from .tables import dataset_path

MANIFEST = "_current"


def _files(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop
    where = hadoop.fs.Path(path)
    return hadoop, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _manifest(spark: SparkSession, folder: str) -> dict | None:
    _, files, where = _files(spark, f"{folder}/{MANIFEST}")
    if not files.exists(where):
        return None
    stream = files.open(where)
    try:
        return json.loads(bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
    finally:
        stream.close()


def _name(spark: SparkSession, folder: str, entry: dict) -> None:
    """Make ``entry`` the manifest, by one rename over the old one."""
    hadoop, files, draft = _files(spark, f"{folder}/{MANIFEST}.{entry['version']}")
    stream = files.create(draft, True)
    try:
        stream.write(bytearray(json.dumps(entry, sort_keys=True).encode()))
    finally:
        stream.close()
    context = hadoop.fs.FileContext.getFileContext(draft.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    over = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    over[0] = spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(draft, hadoop.fs.Path(f"{folder}/{MANIFEST}"), over)


def publish(df: DataFrame, width: int, root: str, name: str, variant: str = "original", k: int | None = None) -> dict:
    """Write ``(label, features)`` as the variant's new version and name it current; returns the manifest's entry.

    Vectors are written dense, so that trailing zeros survive.
    """
    spark, folder = df.sparkSession, dataset_path(root, name, variant, k)
    old = _manifest(spark, folder)
    version = f"v-{os.urandom(6).hex()}"
    write_libsvm(to_dense(df), f"{folder}/{version}")
    rows = read_libsvm(spark, f"{folder}/{version}", width).count()
    entry = {"version": version, "rows": rows, "width": width, "variant": variant}
    _name(spark, folder, entry)
    if old:
        _, files, where = _files(spark, f"{folder}/{old['version']}")
        files.delete(where, True)
    return entry


def current(spark: SparkSession, root: str, name: str, variant: str = "original", k: int | None = None) -> dict:
    """The manifest's entry of a variant; an error if none was published."""
    folder = dataset_path(root, name, variant, k)
    entry = _manifest(spark, folder)
    if entry is None:
        raise FileNotFoundError(f"no variant was published at {folder}")
    return entry


def read_variant(spark: SparkSession, root: str, name: str, variant: str = "original", k: int | None = None) -> DataFrame:
    """``(label, features)`` of the current version, with the width it was published with."""
    entry = current(spark, root, name, variant, k)
    return read_libsvm(spark, f"{dataset_path(root, name, variant, k)}/{entry['version']}", entry["width"])


def versions(spark: SparkSession, root: str, name: str, variant: str = "original", k: int | None = None) -> list[str]:
    """Versions that are stored, the current one among them; others are of runs that are under way or have failed."""
    _, files, where = _files(spark, dataset_path(root, name, variant, k))
    return sorted(s.getPath().getName() for s in files.listStatus(where) if s.getPath().getName().startswith("v-"))
