"""Tables of results, laps and qualifying: schemas, reading with quarantine, writing, audit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import no_nan, seconds

_TYPES = {"int": T.IntegerType(), "string": T.StringType(), "double": T.DoubleType()}


def _schema(fields: str) -> T.StructType:
    """A schema from "name type, ..." without a session, which the DDL parser would need."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in map(str.split, fields.split(", "))])


LAPS = _schema("Year int, Race int, Driver string, Team string, LapNumber double, LapTime_seconds double, Position double, TireCompound string, TireAge double")
RESULTS = _schema("Year int, Race int, Driver string, Team string, Position double, GridPosition double, Points double, Status string")
QUALIFYING = _schema("Year int, Race int, Driver string, Team string, QualifyingPosition double, Q1 double, Q2 double, Q3 double, Status string")
BAD = "_corrupt"


class SourceMissing(LookupError):
    """A required table is not there."""


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """Good rows, and the lines that do not fit the schema (column ``_corrupt``).  NaN becomes null."""
    wide = T.StructType([*schema.fields, T.StructField(BAD, T.StringType())])
    rows = spark.read.schema(wide).option("header", True).option("enforceSchema", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BAD).csv(path)
    doubles = {f.name: no_nan(F.col(f.name)) for f in schema if isinstance(f.dataType, T.DoubleType)}
    # every column is referred to, so that pruning neither hides a bad line nor leaves the corrupt column alone
    whole = F.length(F.concat_ws(",", *schema.names)) >= 0
    good = rows.filter(F.col(BAD).isNull() & whole).drop(BAD)
    return (good.withColumns(doubles) if doubles else good), rows.filter(F.col(BAD).isNotNull() & whole).select(BAD)


def read_headed_csv(spark: SparkSession, path: str, schema: T.StructType, most_layouts: int = 64) -> tuple[DataFrame, DataFrame]:
    """``read_csv`` of files whose header changes from file to file or within one: good rows by column name, and the other lines.

    A line of two or more names of the schema, and nothing else, is a header (of one, if the schema has one).  It holds from there
    to the next header of its file; columns that it does not name are null.  Lines before any header and lines that do not fit
    theirs are quarantined, empty ones left out.  A record is a line.  More than ``most_layouts`` different headers are an error.
    """
    names, least = F.array(*map(F.lit, schema.names)), min(2, len(schema))
    at = F.struct(F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("n"))  # rises within a file
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), at.alias("_at"))
    plain = lambda c: F.trim(F.regexp_replace(c, '^\ufeff?"?|"?\\s*$', ""))
    fields = F.transform(F.split("value", ","), plain)
    header = (F.size(fields) >= least) & F.forall(fields, lambda c: F.array_contains(names, c))
    lines = lines.withColumn("_header", F.when(header, F.array_join(fields, ",")))
    found = lines.filter("_header is not null")
    layouts = sorted(r[0] for r in found.select("_header").distinct().limit(most_layouts + 1).collect())
    if len(layouts) > most_layouts:
        raise ValueError(f"more than {most_layouts} different headers under {path}")
    heads = found.groupBy("_file").agg(F.array_sort(F.collect_list(F.struct("_at", "_header"))).alias("_heads"))  # the headers of a file
    rows = lines.filter("_header is null and trim(value) <> ''").drop("_header").join(heads, "_file", "left")
    before = F.filter("_heads", lambda h: h["_at"] < F.col("_at"))
    rows = rows.select("value", F.try_element_at(before, F.lit(-1))["_header"].alias("_header"))
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD}
    columns, bad = {f.name: F.lit(None).cast(f.dataType) for f in schema}, F.col("_header").isNull()
    for i, layout in enumerate(layouts):
        given = layout.split(",")
        kinds = ", ".join(f"`{c}` {schema[c].dataType.simpleString()}" for c in given)
        rows = rows.withColumn(f"_p{i}", F.when(F.col("_header") == layout, F.from_csv("value", f"{kinds}, {BAD} string", options)))
        for c in given:
            columns[c] = F.coalesce(F.col(f"_p{i}")[c], columns[c])
        bad = bad | F.col(f"_p{i}")[BAD].isNotNull()
    columns = {c: no_nan(v) if isinstance(schema[c].dataType, T.DoubleType) else v for c, v in columns.items()}
    rows = rows.withColumn(BAD, F.when(bad, F.col("value")))
    good = rows.filter(F.col(BAD).isNull()).select(*[v.alias(c) for c, v in columns.items()])
    return good, rows.filter(F.col(BAD).isNotNull()).select(BAD)


def _missing(e: AnalysisException) -> bool:
    return "PATH_NOT_FOUND" in (e.getCondition() or "")


def optional(spark: SparkSession, path: str, schema: T.StructType, format: str = "parquet") -> tuple[DataFrame, bool]:
    """The table and True, or an empty one and False where there is none."""
    try:
        return spark.read.schema(schema).format(format).load(path), True
    except AnalysisException as e:
        if not _missing(e):
            raise
        return spark.createDataFrame([], schema), False


def required(spark: SparkSession, path: str, schema: T.StructType, format: str = "parquet") -> DataFrame:
    df, there = optional(spark, path, schema, format)
    if not there:
        raise SourceMissing(path)
    return df


def write(df: DataFrame, path: str, format: str = "parquet", by: Sequence[str] = (), mode: str = "overwrite") -> None:
    writer = df.write.mode(mode).format(format)
    writer = writer.option("header", True) if format == "csv" else writer
    (writer.partitionBy(*by) if by else writer).save(path)


def rows_of(spark: SparkSession, rows: Sequence, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def normalised(raw: DataFrame, names: dict[str, str], schema: T.StructType, durations: Sequence[str] = ()) -> DataFrame:
    """Raw records under the schema's names and types; ``durations`` are intervals that become seconds; absent ones null."""
    columns = []
    for f in schema:
        source = names.get(f.name, f.name)
        c = F.col(source) if source in raw.columns else F.lit(None)
        columns.append((seconds(c) if f.name in durations and source in raw.columns else c).cast(f.dataType).alias(f.name))
    return raw.select(*columns)


def accumulated(*batches: DataFrame) -> DataFrame:
    out = batches[0]
    for b in batches[1:]:
        out = out.unionByName(b, allowMissingColumns=True)
    return out


def audit(**tables: DataFrame) -> DataFrame:
    """``name``, ``n_rows`` of each table."""
    counts = [df.agg(F.lit(name).alias("name"), F.count("*").alias("n_rows")) for name, df in tables.items()]
    return accumulated(*counts)


def committed(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the ``batch=`` folders under ``path`` that are written to the end, in order."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(conf)
    if not fs.exists(root):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(root)]
    done = [int(n.removeprefix("batch=")) for n in names if n.startswith("batch=") and fs.exists(jvm.org.apache.hadoop.fs.Path(root, f"{n}/_SUCCESS"))]
    return sorted(done)


def write_batch(df: DataFrame, path: str, number: int) -> None:
    """Write a batch's rows into a folder of its own; run again, it replaces them."""
    df.write.mode("overwrite").parquet(f"{path}/batch={number}")


def read_batches(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows of all batches that are written to the end."""
    paths = [f"{path}/batch={b}" for b in committed(spark, path)]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def replace_batches(df: DataFrame, path: str, by: Sequence[str]) -> None:
    """Write the partitions that ``df`` has rows of in place of the stored ones; others stay.  A partition whose corrected
    version has no rows stays too."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def latest_delivery(df: DataFrame, by: Sequence[str], when: str, source: str) -> DataFrame:
    """Of each ``by`` all rows of the delivery (column ``source``) that was completed last, however many files it has; a delivery is
    complete at the greatest ``when`` of all its rows.  Ties to the greater name."""
    ends = df.groupBy(F.col(source).alias("_of")).agg(F.max(when).alias("_end"))
    held = df.groupBy(*by, F.col(source).alias("_of")).agg(F.lit(1))
    last = held.join(ends, "_of").groupBy(*by).agg(F.max(F.struct("_end", "_of")).alias("_last"))
    named = last.toDF(*[f"_k_{c}" for c in by], "_last")
    same = F.col(source) == F.col("_last._of")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    return df.join(named, same, "left_semi")
