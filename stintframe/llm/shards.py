"""Deterministic shards over an ordered long key, and files that tasks write to shared storage."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Shards of a table at most (shards of a larger table are larger), and tasks that write or read them, each several.
MOST_SHARDS, MOST_TASKS = 1 << 20, 100_000
LEAST = -(2**63)
NULLS = -(2**62)


def place(key: Column, content: Column) -> tuple[Column, Column]:
    """The order of rows over shards as two longs: the key, nulls first, and within a key a hash of the row's content."""
    spread = F.shiftrightunsigned(F.xxhash64(content), 2)
    return F.coalesce(key, F.lit(LEAST)), F.when(key.isNull(), F.lit(NULLS) + spread).otherwise(spread)


def bounds(weighed: DataFrame, target: int) -> np.ndarray:
    """The first place (``a``, ``b``) of each shard, a row a shard, from rows with ``a``, ``b`` and ``weight``.

    Rows are sorted over all tasks, and a shard ends where the weight of all rows before reaches the next multiple of
    ``target``, so that shards are even whatever the keys are; only rows equal in both parts stay together.  The bounds
    depend on the data alone.  Where ``target`` would make more than ``MOST_SHARDS`` shards, it grows; 16 bytes a shard and a
    row a partition reach the driver.
    """
    ordered = cut(weighed.select("a", "b", F.col("weight").cast("long")).orderBy("a", "b").withColumn("part", F.spark_partition_id()))
    before, total = {}, 0
    for r in sorted(ordered.groupBy("part").agg(F.sum("weight").alias("w")).collect()):
        before[r.part] = total
        total += r.w
    target = max(target, -(-total // MOST_SHARDS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reached, last = None, None
        for batch in batches:
            if batch.num_rows:
                if reached is None:
                    reached = before[batch.column("part")[0].as_py()]
                weight = batch.column("weight").to_numpy()
                ends = reached + np.cumsum(weight)
                shard = (ends - weight) // target
                new = np.flatnonzero(np.diff(shard, prepend=-1 if last is None else last))
                reached, last = int(ends[-1]), int(shard[-1])
                yield pa.RecordBatch.from_arrays([pa.array(shard[new]), *(batch.column(c).take(pa.array(new)) for c in ("a", "b"))], ["shard", "a", "b"])

    firsts = ordered.mapInArrow(run, "shard long, a long, b long").groupBy("shard").agg(F.min(F.struct("a", "b")).alias("first"))
    found = firsts.select("first.a", "first.b").distinct().toArrow()
    places = np.stack([found[c].to_numpy() for c in ("a", "b")], axis=1).astype(np.int64)
    return places[np.lexsort((places[:, 1], places[:, 0]))]


def shard_of(firsts: np.ndarray, spark) -> Column:
    """The number of the shard that holds the place in columns ``a`` and ``b``; only these two longs pass through Python."""
    held = spark.sparkContext.broadcast(firsts)  # MOST_SHARDS rows of 16 bytes

    @F.arrow_udf("int")
    def number(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array(numbers(held.value, a.to_numpy(), b.to_numpy()))

    return number("a", "b")


def numbers(firsts: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each place the last of ``firsts`` that is not beyond it, 0 at least."""
    low, high = (np.searchsorted(firsts[:, 0], a, side) for side in ("left", "right"))
    out = high - 1
    # a key that begins several shards: the content decides
    for i in np.flatnonzero(high > low).tolist():
        out[i] = low[i] - 1 + np.searchsorted(firsts[low[i] : high[i], 1], b[i], "right")
    return np.maximum(out, 0).astype(np.int32)


def with_shard(df: DataFrame, weighed: DataFrame, target: int) -> tuple[DataFrame, int]:
    """``df`` (with its place in ``a`` and ``b``, which are dropped) with an int column ``shard`` that ascends with the place,
    and the number of shards.  ``weighed`` has ``a``, ``b`` and ``weight`` of the same rows."""
    firsts = bounds(weighed, target)
    return df.withColumn("shard", shard_of(firsts, df.sparkSession)).drop("a", "b"), max(1, len(firsts))


def by_shard(df: DataFrame, n: int) -> DataFrame:
    """``df`` dealt by its column ``shard``, one of ``n``, to ``MOST_TASKS`` tasks at most: neighbouring shards go to one task."""
    tasks = min(n, MOST_TASKS)
    return df.repartitionById(tasks, F.floor(F.col("shard").cast("long") * tasks / n).cast("int"))


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


class Output:
    """A file that appears under its name only when it is whole: written under a temporary name, then renamed.

    The name and the content depend on the data alone, so a retried or a second attempt replaces it by the same bytes.
    """

    def __init__(self, folder: str, name: str):
        self.fs, root = file_system(folder)
        self.fs.create_dir(root, recursive=True)
        attempt = TaskContext.get().taskAttemptId() if TaskContext.get() else "driver"
        self.final, self.temporary = f"{root}/{name}", f"{root}/.{name}.{attempt}.{uuid.uuid4().hex[:8]}"
        self.stream = self.fs.open_output_stream(self.temporary, compression=None)
        self.size = 0

    def write(self, data: bytes) -> None:
        self.stream.write(data)
        self.size += len(data)

    def commit(self) -> None:
        self.stream.close()
        self.fs.move(self.temporary, self.final)

    def discard(self) -> None:
        with suppress(OSError):
            self.stream.close()
            self.fs.delete_file(self.temporary)


def write_manifest(folder: str, content: dict) -> None:
    """The commit: readers take only files that the manifest names."""
    out = Output(folder, "manifest.json")
    out.write(json.dumps(content).encode())
    out.commit()


def read_manifest(folder: str) -> dict:
    system, root = file_system(folder)
    with system.open_input_stream(f"{root}/manifest.json", compression=None) as f:
        return json.loads(f.read())
