"""Shared helpers: reading tables, cutting lineage, Arrow slices, connected components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python step holds at once (a single longer text is one slice of its own).
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or in local mode one set here where it is unset."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
        found = sc.getCheckpointDir()
    return found.rstrip("/")


def fresh_dir(spark: SparkSession, purpose: str) -> str:
    return f"{shared_dir(spark)}/{purpose}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again: cuts lineage, keeps column pruning."""
    path = fresh_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release() -> None:
    """Give freed memory back to the system: workers and the driver live on after their largest piece of work."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into slices whose ``column`` (string or binary) holds about ``most`` bytes, never splitting a row.
    After the last one, freed memory goes back to the system."""
    for batch in batches:
        values = batch.column(batch.schema.get_field_index(column))
        sizes = pa.compute.fill_null(pa.compute.binary_length(values), 0).to_numpy(zero_copy_only=False)
        start = held = 0
        for i, size in enumerate(sizes.tolist()):
            if held and held + size > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        if start < batch.num_rows:
            yield batch.slice(start)
    release()


def groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    """Regroup sorted batches so that no run of equal keys is cut."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(key).to_numpy()
        last = int(np.searchsorted(values, values[-1]))
        if last or (held and held[-1].column(key)[0].as_py() != values[0]):
            table = pa.Table.from_batches([*held, batch.slice(0, last)]).combine_chunks()
            yield from table.to_batches()
            held = []
        held.append(batch.slice(last))
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def runs(key: np.ndarray) -> list[tuple[int, int]]:
    """Bounds of the runs of equal values."""
    cuts = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
    return list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of an undirected graph by alternating large-star and small-star steps.

    ``edges`` has long columns ``src`` and ``dst``; loops, repeated edges and edges with a null end are ignored.
    Returns ``node``, ``component`` (smallest node reachable) for every node with an edge to another node.
    Every step is an aggregation and a join on the same key.  A hub is a node with many greater neighbours; the aggregate of
    the large-star step is written before it is joined, so that edges are shuffled for the join alone and the adaptive skew
    join may split a hub.  No node's neighbour list is ever gathered.  The same aggregate tells when all components are stars
    around their smallest node: each node has no smaller neighbour, or one and no greater; edges that are so from the start
    need no step.
    """
    a, b = F.greatest("src", "dst"), F.least("src", "dst")
    edges = cut(edges.filter("src <> dst").select(a.alias("a"), b.alias("b")).distinct())
    smaller, greater = F.count_if(F.col("v") < F.col("u")), F.count_if(F.col("v") > F.col("u"))
    unsettled = (smaller > 0) & ((smaller > 1) | (greater > 0))
    while True:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b"), F.col("a")))
        low = cut(both.groupBy("u").agg(F.min("v").alias("v"), unsettled.alias("unsettled")).select("u", F.least("u", "v").alias("m"), "unsettled"))
        if not low.agg(F.bool_or("unsettled")).first()[0]:
            return low.select(F.col("u").alias("node"), F.col("m").alias("component"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))  # a row an edge
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = cut(small.union(low.select("a", F.col("m").alias("b"))).distinct())
