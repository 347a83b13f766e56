"""A log of versions in a folder that all machines share: one small file for each number, put there only where none is."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _files(spark: SparkSession, path: str):
    """The context of a path's file system, and the class of paths."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def head(spark: SparkSession, folder: str) -> tuple[int, str | None]:
    """Number and text of the last entry; (0, None) for a log without any."""
    files, path = _files(spark, folder)
    if not files.util().exists(path(folder)):
        return 0, None
    names = [s.getPath().getName() for s in files.util().listStatus(path(folder))]
    last = max((n for n in names if n.isdigit()), default=None)
    if last is None:
        return 0, None
    return int(last), spark.read.text(f"{folder}/{last}").first()[0]


def append(spark: SparkSession, folder: str, number: int, text: str) -> bool:
    """Put ``text`` as entry ``number``; False, and nothing changed, where that entry is there already.

    The entry is written aside and gets its name by a rename that never replaces a file, so readers see whole entries alone.
    """
    files, path = _files(spark, folder)
    jvm = spark._jvm
    aside, target = path(f"{folder}/.{uuid.uuid4().hex}"), path(f"{folder}/{number:020d}")
    flags = jvm.java.util.EnumSet.of(jvm.org.apache.hadoop.fs.CreateFlag.CREATE)
    nothing = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.CreateOpts, 1)
    nothing[0] = jvm.org.apache.hadoop.fs.Options.CreateOpts.createParent()
    stream = files.create(aside, flags, nothing)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    if files.util().exists(target):
        files.delete(aside, False)
        return False
    renames = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    from py4j.protocol import Py4JJavaError

    try:
        files.rename(aside, target, renames)
    except Py4JJavaError as e:
        files.delete(aside, False)
        if e.java_exception.getClass().getSimpleName() == "FileAlreadyExistsException":
            return False
        raise
    return True
