"""Opening and saving files by extension, through Spark's readers and writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Extension -> format.
FORMATS = {"csv": "csv", "tsv": "tsv", "json": "json", "ndjson": "ndjson", "jsonl": "ndjson", "parquet": "parquet", "pq": "parquet", "orc": "orc", "txt": "text", "md": "text", "log": "text", "xml": "xml", "db": "sqlite", "sqlite": "sqlite", "sqlite3": "sqlite", "xlsx": "sheet", "ods": "sheet"}


def kind_of(path: str) -> str:
    name = path.rstrip("/").rsplit("/", 1)[-1].lower()
    for ext in reversed(name.split(".")[1:]):
        if ext in ("gz", "bz2", "zst"):
            continue
        return FORMATS.get(ext, "binary")
    return "binary"


def open_(spark: SparkSession, *paths: str, kind: str | None = None, schema: T.StructType | str | None = None, header: bool = True, separator: str | None = None, infer: bool = True, columns: list[str] | None = None, row_tag: str = "row", raw: bool = False, recursive: bool = False, table: str | None = None) -> DataFrame:
    """A lazy table of files; several paths are read as one table.

    With a schema nothing is inferred, which at scale spares a pass over the files.
    """
    kind = "binary" if raw else kind or kind_of(paths[0])
    if kind == "sqlite":
        from millrace.sources.sqlite import read_sqlite

        return read_sqlite(spark, paths[0], table)
    if kind == "sheet":
        from millrace.sources.sheets import read_sheet

        return read_sheet(spark, paths[0], table, header)
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    if kind in ("csv", "tsv"):
        sep = separator or ("\t" if kind == "tsv" else ",")
        reader = reader.options(header=header, sep=sep, inferSchema=infer and schema is None, quote='"', escape='"')
        df = reader.csv(list(paths))
        if not header and schema is None:
            df = df.toDF(*(f"column{k}" for k in range(len(df.columns))))
    elif kind == "json":
        df = reader.option("multiLine", "true").json(list(paths))
    elif kind == "ndjson":
        df = reader.json(list(paths))
    elif kind == "xml":
        df = reader.format("xml").option("rowTag", row_tag).load(list(paths))
    elif kind in ("parquet", "orc", "text"):
        df = reader.format(kind).load(list(paths))
    elif kind == "binary":
        df = reader.format("binaryFile").load(list(paths))
    else:
        raise ValueError(f"format {kind} is not known")
    return df.select(*columns) if columns else df


def save(df: DataFrame, path: str, kind: str | None = None, *, force: bool = False, append: bool = False, partition_by: list[str] | None = None, header: bool = True, separator: str | None = None, **options) -> None:
    """Write a table; an existing target is an error unless `force` or `append`."""
    kind = kind or kind_of(path)
    if kind == "sqlite":
        from millrace.sources.sqlite import write_sqlite

        return write_sqlite(df, path, options.get("table", "main"), append=append, force=force)
    writer = df.write.mode("append" if append else "overwrite" if force else "error").options(**options)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if kind in ("csv", "tsv"):
        writer.options(header=header, sep=separator or ("\t" if kind == "tsv" else ","), escape='"').csv(path)
    elif kind in ("json", "ndjson"):
        writer.json(path)
    elif kind == "xml":
        writer.format("xml").options(rowTag="row", rootTag="rows").save(path)
    elif kind in ("parquet", "orc"):
        writer.format(kind).save(path)
    elif kind == "text":
        line = df if len(df.columns) == 1 else df.select(F.to_json(F.struct("*")).alias("value"))
        line.write.mode("append" if append else "overwrite" if force else "error").text(path)
    else:
        raise ValueError(f"format {kind} cannot be written")
    return None


def listing(spark: SparkSession, path: str, pattern: str = "*", recursive: bool = False) -> DataFrame:
    """Files with size and time of change; contents are not read."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower())
    return reader.load(path).select(F.col("path").alias("name"), F.lit("file").alias("type"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def disk_usage(spark: SparkSession, path: str) -> DataFrame:
    """Bytes by folder."""
    files = listing(spark, path, recursive=True)
    return files.groupBy(F.regexp_replace("name", "/[^/]*$", "").alias("path")).agg(F.sum("size").alias("apparent"), F.count("*").alias("files"))
