"""All-or-nothing publishing: a write goes to a folder of its own, and one pointer makes it current.

Readers resolve the pointer and see the last write that was finished, whole. A write that fails
leaves its folder without a pointer; a repeated write gets another folder. The pointer is put in
place by one rename.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

POINTER = "_current"


def _context(spark: SparkSession, path: str):
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, at.getFileSystem(conf), jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.getFileSystem(conf).getUri(), conf)


def publish(spark: SparkSession, path: str, write: Callable[[str], None]) -> str:
    """Calls ``write`` with a fresh folder below ``path`` and makes it the current one.

    Anything ``write`` raises is passed on, and the pointer stays as it was. Of writers that run at
    once, the one whose rename comes last is current. Returns the folder.
    """
    path = path.rstrip("/")
    name = f"version-{uuid.uuid4().hex}"
    write(f"{path}/{name}")
    jvm, files, context = _context(spark, path)
    hadoop = jvm.org.apache.hadoop.fs
    staged = hadoop.Path(f"{path}/.{name}")
    out = files.create(staged, True)
    out.write(name.encode())
    out.close()
    options = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    options[0] = hadoop.Options.Rename.OVERWRITE
    context.rename(files.makeQualified(staged), files.makeQualified(hadoop.Path(f"{path}/{POINTER}")), options)
    return f"{path}/{name}"


def current(spark: SparkSession, path: str) -> str:
    """The folder that was published last; FileNotFoundError before the first."""
    path = path.rstrip("/")
    jvm, files, _ = _context(spark, path)
    pointer = jvm.org.apache.hadoop.fs.Path(f"{path}/{POINTER}")
    if not files.exists(pointer):
        raise FileNotFoundError(f"nothing is published in {path}")
    reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(files.open(pointer), "UTF-8"))
    try:
        return f"{path}/{reader.readLine()}"
    finally:
        reader.close()


def sweep(spark: SparkSession, path: str) -> int:
    """Deletes all versions but the current one (call it when nobody reads or writes those); returns how many."""
    keep = current(spark, path).rsplit("/", 1)[1]
    jvm, files, _ = _context(spark, path)
    old = [s.getPath() for s in files.listStatus(jvm.org.apache.hadoop.fs.Path(path)) if s.getPath().getName().lstrip(".").startswith("version-") and s.getPath().getName() != keep]
    for folder in old:
        files.delete(folder, True)
    return len(old)
