"""What parquet files say of themselves: columns, rows and bytes per file.

Files are listed by the driver and their footers read by tasks, some files
each, so no data page is read.  A file that cannot be read is a row, not an
error.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nightspark.operators.workers import visible

FILES_PER_TASK = 64
FOOTERS = "file string, n_rows long, bytes long, columns map<string,string>, records array<string>, error string"


def files_under(spark: SparkSession, path: str, suffix: str = ".parquet") -> list[tuple[str, int]]:
    """(path, bytes) of all data files below a folder, in order; hidden ones are left out."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found, it = [], fs.listFiles(root, True)
    base = fs.makeQualified(root).toUri().getPath().rstrip("/")
    while it.hasNext():
        s = it.next()
        inside = s.getPath().toUri().getPath()[len(base):].strip("/").split("/")
        if s.getPath().getName().endswith(suffix) and not any(p[:1] in "._" for p in inside if p):
            found.append((s.getPath().toString(), s.getLen()))
    return sorted(found)


def kind_of(t: pa.DataType) -> str:
    """Type names as Spark writes them."""
    if pa.types.is_timestamp(t):
        return "timestamp" if t.tz else "timestamp_ntz"
    names = {"bool": "boolean", "int8": "tinyint", "int16": "smallint", "int32": "int", "int64": "bigint", "float": "float", "double": "double",
             "string": "string", "large_string": "string", "binary": "binary", "date32[day]": "date"}
    if pa.types.is_list(t):
        return f"array<{kind_of(t.value_type)}>"
    return names.get(str(t), str(t))


def footers(spark: SparkSession, path: str, record: str | None = None) -> DataFrame:
    """One row per file; with ``record``, also the distinct values of that column (its pages alone are read)."""
    visible(spark)
    files = files_under(spark, path)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.fs as fs
        import pyarrow.parquet as pq

        for batch in batches:
            rows = []
            for name, size in zip(batch.column("file").to_pylist(), batch.column("bytes").to_pylist(), strict=True):
                row = {"file": name, "n_rows": None, "bytes": size, "columns": None, "records": None, "error": None}
                try:
                    if name.startswith("file:"):
                        where, inside = fs.LocalFileSystem(), name.removeprefix("file://").removeprefix("file:")
                    else:
                        where, inside = fs.FileSystem.from_uri(name)
                    with where.open_input_file(inside) as source:
                        f = pq.ParquetFile(source)
                        row["n_rows"] = f.metadata.num_rows
                        row["columns"] = [(c.name, kind_of(c.type)) for c in f.schema_arrow]
                        if record and record in f.schema_arrow.names:
                            row["records"] = sorted({str(v) for b in f.iter_batches(columns=[record]) for v in b.column(0).unique().to_pylist() if v is not None})
                except Exception as problem:
                    row["error"] = f"{type(problem).__name__}: {problem}"[:300]
                rows.append(row)
            kind = pa.schema([("file", pa.string()), ("n_rows", pa.int64()), ("bytes", pa.int64()), ("columns", pa.map_(pa.string(), pa.string())),
                              ("records", pa.list_(pa.string())), ("error", pa.string())])
            yield pa.RecordBatch.from_pylist(rows, kind)

    table = spark.createDataFrame(files, "file string, bytes long")
    return table.repartition(max(1, -(-len(files) // FILES_PER_TASK))).mapInArrow(read, FOOTERS)


def file_schema_lock(spark: SparkSession, path: str, expected: Mapping[str, str], record: str, kinds: Mapping[str, str] = {}) -> DataFrame:
    """Per record: columns that its file misses, has beyond ``expected``, or holds in another type, and the status.

    ``kinds`` names types that count as one.  A record that several files hold
    gets the union of their faults.  A file
    without the record column, or that cannot be read, gives a row with a null
    record.
    """
    own, want = F.col("columns"), F.create_map(*[F.lit(x) for pair in expected.items() for x in pair])
    if kinds:
        same = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])
        own = F.transform_values(own, lambda _, v: F.coalesce(F.try_element_at(same, v), v))
    f = footers(spark, path, record).withColumns({"_own": F.coalesce(F.map_keys(own), F.array().cast("array<string>")), "_want": F.map_keys(want)})
    at = lambda m, k: F.try_element_at(m, k)
    f = f.withColumns({
        "missing": F.array_except("_want", "_own"), "extra": F.array_except("_own", "_want"),
        "wrong": F.filter(F.array_intersect("_own", "_want"), lambda c: at(own, c) != at(want, c))})
    per = f.select(F.explode_outer("records").alias(record), "missing", "extra", "wrong", F.col("error").isNotNull().alias("_bad"))
    per = per.groupBy(record).agg(*[F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in ("missing", "extra", "wrong")], F.max("_bad").alias("_bad"))
    fault = F.col("_bad") | (F.size("missing") + F.size("extra") + F.size("wrong") > 0) | F.col(record).isNull()
    return per.select(
        record, *[F.size(c).cast("long").alias(f"n_{c}") for c in ("missing", "extra", "wrong")],
        F.concat_ws(",", "missing", "extra", "wrong").alias("columns"), F.when(fault, "FAIL").otherwise("PASS").alias("b1_status"))
