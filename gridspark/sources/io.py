"""Sources and sinks (S1-S8): CSV, Parquet, catalog tables, SQL, JDBC."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridspark.operators.aggregate import row_count  # noqa: F401  S4
from gridspark.plans.sql import check_identifier, run_sql

# Delimiters tried, in order, when sniffing a CSV header line.
DELIMITERS = (",", ";", "\t", "|")
# Declared column types for new tables.
TYPE_NAMES = {"str": T.StringType(), "int": T.LongType(), "float": T.DoubleType(),
              "bool": T.BooleanType(), "date": T.TimestampNTZType()}
WRITE_MODES = {"replace": "overwrite", "overwrite": "overwrite", "append": "append",
               "fail": "errorifexists", "error": "errorifexists", "ignore": "ignore"}
EXPORT_DEFAULT_ROWS = 10_000


def sniff_delimiter(spark: SparkSession, path: str) -> str:
    """First of ``, ; TAB |`` present in the file's first line (one line is
    read)."""
    first = spark.read.text(path).limit(1).collect()
    line = first[0][0] if first else ""
    for d in DELIMITERS:
        if d in line:
            return d
    return ","


def read_csv(spark: SparkSession, path: str, sep: str | None = None, header: bool = True,
             infer_schema: bool = True, schema: T.StructType | str | None = None) -> DataFrame:
    """CSV with delimiter detection; header names are stripped."""
    delim = sep or sniff_delimiter(spark, path)
    reader = spark.read.option("header", header).option("sep", delim)
    if schema is not None:
        reader = reader.schema(schema)
    else:
        reader = reader.option("inferSchema", infer_schema)
    df = reader.csv(path)
    return df.toDF(*[c.strip() for c in df.columns])


def load_table(spark: SparkSession, name_or_path: str, fmt: str | None = None) -> DataFrame:
    """A catalog table by name, or a file/folder by path (format from
    ``fmt`` or the extension; Parquet by default). A dotted name without a
    slash is a table (``database.table``) if the catalog has it, else a path."""
    if "/" not in name_or_path and fmt is None:
        parts = name_or_path.split(".")
        if len(parts) == 1 or (all(p.isidentifier() for p in parts) and spark.catalog.tableExists(name_or_path)):
            return spark.table(".".join(check_identifier(p) for p in parts))
    f = fmt or ("csv" if name_or_path.endswith(".csv") else
                "json" if name_or_path.endswith(".json") else
                "orc" if name_or_path.endswith(".orc") else "parquet")
    if f == "csv":
        return read_csv(spark, name_or_path)
    return spark.read.format(f).load(name_or_path)


def read_sql(spark: SparkSession, query: str) -> DataFrame:
    """S3: a read-only SQL query over registered tables."""
    return run_sql(spark, query)


def read_jdbc(spark: SparkSession, url: str, query: str, properties: dict | None = None,
              partition_column: str | None = None, lower: int | None = None, upper: int | None = None,
              num_partitions: int | None = None) -> DataFrame:
    """S3 for a remote database (needs the JDBC driver on the classpath);
    give a numeric partition column to read in parallel."""
    r = spark.read.format("jdbc").option("url", url)
    for k, v in (properties or {}).items():
        r = r.option(k, v)
    if partition_column:
        r = (r.option("dbtable", f"({query}) q").option("partitionColumn", partition_column)
             .option("lowerBound", lower).option("upperBound", upper)
             .option("numPartitions", num_partitions or 8))
    else:
        r = r.option("query", query)
    return r.load()


def list_tables(spark: SparkSession) -> DataFrame:
    """Tables and views of the current catalog/database."""
    rows = [(t.name, t.database, t.tableType, t.isTemporary) for t in spark.catalog.listTables()]
    return spark.createDataFrame(rows, "name string, database string, table_type string, is_temporary boolean")


def table_exists(spark: SparkSession, name: str) -> bool:
    """S4."""
    return spark.catalog.tableExists(check_identifier(name))


def table_schema(df: DataFrame) -> DataFrame:
    """``(position, column, type, nullable)`` of a table."""
    rows = [(i + 1, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "position int, column string, type string, nullable boolean")


def write_csv(df: DataFrame, path: str, mode: str = "replace", sep: str = ",") -> None:
    """A folder of CSV part files, each with a header line (the reader
    skips them); ``append`` adds part files."""
    m = WRITE_MODES.get(mode)
    if m is None:
        raise ValueError(f"unknown mode {mode!r}; choose from {sorted(WRITE_MODES)}")
    df.write.mode(m).option("header", True).option("sep", sep).csv(path)


def write_table(df: DataFrame, target: str, mode: str = "replace", fmt: str = "parquet",
                partition_by: Sequence[str] | None = None, bucket_by: tuple[int, Sequence[str]] | None = None
                ) -> None:
    """Write to a catalog table (name) or a folder (path) with
    replace / append / fail. ``partition_by`` enables partition pruning,
    ``bucket_by=(n, cols)`` (catalog tables) co-locates later joins."""
    m = WRITE_MODES.get(mode)
    if m is None:
        raise ValueError(f"unknown mode {mode!r}; choose from {sorted(WRITE_MODES)}")
    w = df.write.mode(m).format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if "/" in target:
        if bucket_by:
            raise ValueError("bucketing needs a catalog table name")
        w.save(target)
    else:
        if bucket_by:
            w = w.bucketBy(bucket_by[0], *bucket_by[1])
        w.saveAsTable(check_identifier(target))


def create_table(spark: SparkSession, columns: Sequence[tuple[str, str]], n_rows: int = 0) -> DataFrame:
    """Empty table, or ``n_rows`` all-null rows, of declared types
    (str, int, float, bool, date or any Spark type name)."""
    fields = []
    for name, t in columns:
        dt = TYPE_NAMES.get(t)
        if dt is None:
            dt = T._parse_datatype_string(t)
        fields.append(T.StructField(check_identifier(name), dt, True))
    schema = T.StructType(fields)
    if n_rows <= 0:
        return spark.createDataFrame([], schema)
    return spark.range(n_rows).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in fields])


def export_rows(df: DataFrame, path: str, n: int | None = EXPORT_DEFAULT_ROWS,
                order_by: Sequence[str] | None = None, mode: str = "replace", sep: str = ",") -> DataFrame:
    """Write the first ``n`` rows (None: all) as CSV; returns what was
    written, read back as text columns."""
    out = df.orderBy(*order_by) if order_by else df
    if n is not None:
        out = out.limit(int(n))
    write_csv(out, path, mode, sep)
    return read_csv(df.sparkSession, path, sep=sep, infer_schema=False)
