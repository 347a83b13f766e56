"""Incremental indexing of source repositories: which files to read again, what to delete and insert, which state to keep.

Tables: syncs (repo, head, new_clone, full_rescan) has one row for each repository that was brought up to date; changed
(repo, file_path) the files that this touched, removed ones too; listed (repo, file_path) all files that are there;
states (repo, commit) the last commit that was indexed. Everything is joins and groups over all repositories at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from geoquarry.sources.scratch import stored

EXTENSIONS = ("js", "mjs", "cjs", "ts", "tsx")
#: Rows of one Arrow batch of files, whose contents are whole sources; bytes of contents or code after which found functions are given out.
FILE_ROWS, GIVEN_BYTES = 64, 4 << 20
EXTRACTED = "repo string, file_path string, position int, name string, code string, error string"


def _source(path: str) -> Column:
    return F.regexp_extract(path, r"\.([^./]+)$", 1).isin(*EXTENSIONS) & ~F.col(path).contains("/.git/")


def rules(syncs: DataFrame, changed: DataFrame, states: DataFrame) -> DataFrame:
    """repo, rule: why files of a repository are indexed again, null where none are.

    New clones and full rescans take all source files; else the changed source files; where none changed, all of them if the
    state is missing or of another commit, and none if it is of this one.
    """
    touched = changed.where(_source("file_path")).select("repo").distinct().withColumn("__touched", F.lit(True))
    rule = (
        F.when(F.coalesce("new_clone", F.lit(False)), "clone")
        .when(F.coalesce("full_rescan", F.lit(False)), "rescan")
        .when(F.col("__touched"), "changed")
        .when(~F.col("commit").eqNullSafe(F.col("head")), "commit")
    )
    return syncs.join(touched, "repo", "left").join(states.select("repo", "commit"), "repo", "left").select("repo", rule.alias("rule"))


def plan(ruled: DataFrame, changed: DataFrame, listed: DataFrame) -> DataFrame:
    """repo, file_path, rule of every file to index again."""
    touched = changed.where(_source("file_path")).select("repo", "file_path").distinct()
    whole = listed.where(_source("file_path")).select("repo", "file_path").distinct().join(ruled.where("rule <> 'changed'"), "repo")
    return whole.unionByName(touched.join(ruled.where("rule = 'changed'"), "repo")).select("repo", "file_path", "rule")


def extract(files: DataFrame, functions_of: Callable[[str, str], list[tuple[str, str]]]) -> DataFrame:
    """EXTRACTED rows of files (repo, file_path, content): the functions that a plugged-in parser finds, in order.

    An error of the parser, or a file that is gone (null content), is the file's one row, and other files go on. Files come
    in batches of FILE_ROWS, and the rows are written at once, so that every file is parsed once.
    """

    def of(repo: str, path: str, content: str | None) -> list[tuple]:
        if content is None:
            return [(repo, path, 0, None, None, "the file is gone")]
        try:
            return [(repo, path, k, name, code, None) for k, (name, code) in enumerate(functions_of(path, content))]
        except Exception as e:  # whatever a plugged-in parser raises concerns its file alone
            return [(repo, path, 0, None, None, str(e) or type(e).__name__)]

    types = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string())

    def given(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * 6
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["repo", "file_path", "position", "name", "code", "error"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            # one file at a time: neither the contents of a batch nor its functions are Python objects at once
            for at in range(batch.num_rows):
                repo, path, content = (c[at].as_py() for c in batch.columns)
                for row in of(repo, path, content):
                    rows.append(row)
                    held += len(row[4] or "")
                    if held > GIVEN_BYTES:
                        yield given(rows)
                        rows, held = [], 0
            if rows:
                yield given(rows)

    spark, key = files.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, str(FILE_ROWS))
        return stored(files.select("repo", "file_path", "content").mapInArrow(run, EXTRACTED), "extracted")
    finally:
        spark.conf.set(key, before)


def inserts(extracted: DataFrame) -> DataFrame:
    """The functions to save: in each file those before its first error; blank code has no chunks and is left out."""
    failed = extracted.where("error is not null").groupBy("repo", "file_path").agg(F.min("position").alias("__stop"))
    kept = extracted.join(failed, ["repo", "file_path"], "left").where("error is null and (__stop is null or position < __stop)")
    return kept.where(F.trim(F.coalesce("code", F.lit(""))) != "").select("repo", "file_path", "position", "name", "code")


def apply(index: DataFrame, targets: DataFrame, saved: DataFrame) -> DataFrame:
    """The next index (repo, file_path, position, name, code): files that were read again lose their rows, also where reading failed; saved rows come in."""
    columns = ["repo", "file_path", "position", "name", "code"]
    kept = index.join(targets.select("repo", "file_path"), ["repo", "file_path"], "left_anti")
    return kept.select(*columns).unionByName(saved.select(*columns))


def outcome(syncs: DataFrame, ruled: DataFrame, targets: DataFrame, index: DataFrame, extracted: DataFrame, saved: DataFrame, states: DataFrame) -> DataFrame:
    """One row for each repository: rule, files, deleted and saved rows, failed files, and its next commit: the head only if something was saved."""
    by = lambda rows, name: rows.groupBy("repo").agg(F.count("*").alias(name))
    out = syncs.select("repo", "head").join(ruled, "repo", "left").join(by(targets, "files"), "repo", "left")
    out = out.join(by(index.join(targets, ["repo", "file_path"], "left_semi"), "deleted"), "repo", "left")
    out = out.join(by(saved, "saved"), "repo", "left")
    out = out.join(by(extracted.where("error is not null").select("repo", "file_path").distinct(), "failed"), "repo", "left")
    out = out.join(states.select("repo", "commit"), "repo", "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("files", "deleted", "saved", "failed")]
    return out.select("repo", F.coalesce("rule", F.lit("none")).alias("rule"), *counts, F.when(F.coalesce("saved", F.lit(0)) > 0, F.col("head")).otherwise(F.col("commit")).alias("commit"))
