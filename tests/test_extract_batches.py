"""Files reach the parser in small batches, and what it finds leaves in bounded ones."""

from pyspark.sql import functions as F

from geoquarry.operators import indexing as I


def test_extract_holds_few_files_at_once(spark):
    assert I.FILE_ROWS < 500

    def functions_of(path, content):
        import sys

        # the frame of the caller's loop holds the batch
        frame = sys._getframe()
        while "batch" not in frame.f_locals:
            frame = frame.f_back
        return [("rows", str(frame.f_locals["batch"].num_rows)), ("f", content)]

    files = spark.range(0, 500, 1, 1).select(F.lit("r").alias("repo"), F.format_string("f%03d", "id").alias("file_path"), F.repeat(F.lit("x"), 100_000).alias("content"))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = I.extract(files, functions_of)
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
    assert got.where("name = 'f'").agg(F.count("*"), F.sum(F.length("code")), F.count_distinct("file_path")).first()[:] == (500, 50_000_000, 500)
    assert max(int(r.code) for r in got.where("name = 'rows'").collect()) <= I.FILE_ROWS
