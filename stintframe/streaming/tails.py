"""Rolling form kept up batch by batch from a stored tail of each entity's last rows, without its history.

``state/tails/batch=i/tail_bucket=b`` holds the last rows of every entity of a bucket as of batch i, for the buckets that batch touched;
``state/buckets/batch=i`` lists each bucket's current batch and is written last, which commits the batch.  A batch that is run
again reads what was committed before it and replaces its own folders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators import form
from ..operators.form import Form, Roles
from ..sources.tables import committed


def refresh(batch: DataFrame, number: int, state: str, roles: Roles, spec: Form, n: int, include_current: bool = True, buckets: int = 64, divisor: str = "n") -> None:
    """Form of the batch's rows, as over the whole history, into ``state/form/batch=number``.

    A row that stands, in its entity's order, before one that an earlier batch brought is late: later forms are already given, so it
    goes into ``state/late/batch=number`` and counts nowhere.  Within a batch rows may come in any order.  Rows without an
    entity or an order are late too.  The work of a batch is its rows and the tails of the buckets they touch; ``buckets`` must stay
    the same over a state's life.
    """
    spark = batch.sparkSession
    columns, entity = batch.columns, [*roles.entity]
    bucket = F.pmod(F.xxhash64(*entity), F.lit(buckets)).cast("int")
    rows = batch.withColumn("_bucket", bucket)
    complete = F.lit(True)
    for c in [*entity, *roles.order]:
        complete = complete & F.col(c).isNotNull()
    touched = {r._bucket for r in rows.filter(complete).select("_bucket").distinct().collect()}  # the number of buckets at most
    current = {r.bucket: r.batch for r in _buckets(spark, state, number).collect()}  # likewise
    paths = [f"{state}/tails/batch={current[b]}/tail_bucket={b}" for b in sorted(touched & current.keys())]
    tails = spark.read.schema(batch.schema).parquet(*paths) if paths else spark.createDataFrame([], batch.schema)

    place = F.struct(*roles.order)
    ends = tails.groupBy(*entity).agg(F.max(place).alias("_end"))
    checked = rows.join(ends, entity, "left").withColumn("_late", ~complete | F.coalesce(place < F.col("_end"), F.lit(False)))
    fresh = checked.filter("not _late")
    both = tails.withColumn("_bucket", bucket).withColumn("_new", F.lit(False)).unionByName(fresh.select(*columns, "_bucket", F.lit(True).alias("_new")))
    rolled = form.with_form(both, roles, spec, n, include_current, divisor)
    last = F.row_number().over(Window.partitionBy(*entity).orderBy(*[F.desc(c) for c in roles.order]))
    rolled = rolled.withColumn("_r", last).persist()  # one shuffle for the forms and the tails
    made = [c for c in rolled.columns if c not in ("_new", "_r", "_bucket")]
    rolled.filter("_new").select(*made).write.mode("overwrite").parquet(f"{state}/form/batch={number}")
    checked.filter("_late").select(*columns).write.mode("overwrite").parquet(f"{state}/late/batch={number}")
    rolled.filter(F.col("_r") <= n).select(*columns, F.col("_bucket").alias("tail_bucket")).write.mode("overwrite").partitionBy("tail_bucket").parquet(f"{state}/tails/batch={number}")
    rolled.unpersist()
    now = [(b, number if b in touched else current[b]) for b in sorted(touched | current.keys())]
    spark.createDataFrame(now, "bucket int, batch long").coalesce(1).write.mode("overwrite").parquet(f"{state}/buckets/batch={number}")


def _buckets(spark: SparkSession, state: str, before: int) -> DataFrame:
    """The buckets as of the last batch before ``before``."""
    done = [b for b in committed(spark, f"{state}/buckets") if b < before]
    schema = "bucket int, batch long"
    return spark.read.schema(schema).parquet(f"{state}/buckets/batch={max(done)}") if done else spark.createDataFrame([], schema)


def refreshed(spark: SparkSession, state: str, kind: str, schema: StructType) -> DataFrame:
    """All of ``form`` or ``late`` so far."""
    paths = [f"{state}/{kind}/batch={b}" for b in committed(spark, f"{state}/buckets")]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def form_stream(stream: DataFrame, state: str, checkpoint: str, roles: Roles, spec: Form, n: int, trigger: dict | None = None, **options) -> StreamingQuery:
    """``refresh`` on every micro-batch of a stream."""

    def run(batch: DataFrame, number: int) -> None:
        held = batch.persist()
        refresh(held, number, state, roles, spec, n, **options)
        held.unpersist()

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
