"""Token ids in binary shards with a minimal perfect hash index from document key to offset.

A store is a folder of ``shard-NNNNNNN.ids`` (the ids of its documents one after another, little-endian, two bytes each where
the vocabulary allows it, else four), ``shard-NNNNNNN.idx``, a Parquet list of the shards and ``manifest.json``.  Documents ascend by key over the shards.
An index maps a key to a slot in constant time; the slot's stored fingerprint tells absent keys, and its record number
leads to the offset of the payload.  Files appear by renaming and count only once the manifest, written last, names their list.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices
from .mphf import PerfectHash, fingerprints
from .shards import Output, by_shard, file_system, place, read_manifest, with_shard, write_manifest
from .token_ids import token_ids
from .wordunits import spread

MAGIC = b"IDX1"
#: Arrays of an index file, in this order, and their types.
ARRAYS = {"bits": "<u1", "print": "<u4", "first": "<u4", "count": "<u4", "offsets": "<i8"}
SUMMARY = "shard int, documents long, tokens long, nulls long, first_key long"


def encode_documents(docs: DataFrame, tokenizer: str, end_id: int, width: int, id_col: str, text_col: str) -> DataFrame:
    """``id``, its place ``a`` and ``b`` over shards, and ``ids`` (binary, ``width`` bytes an id, the end id last)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = token_ids(tokenizer)
        for batch in slices(batches, "text", 8 << 20):
            flat, offsets = encoder.encode(batch.column("text"))
            whole = np.insert(flat, offsets[1:], end_id).astype(f"<u{width}").tobytes()
            ends = width * (offsets + np.arange(len(offsets)))
            ids = [whole[a:b] for a, b in zip(ends.tolist(), ends[1:].tolist(), strict=False)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "a", "b")), pa.array(ids, pa.binary())], ["id", "a", "b", "ids"])

    return placed(docs, id_col, text_col).select("id", "a", "b", "text").mapInArrow(run, "id long, a long, b long, ids binary")


def placed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id``, ``text``, and the place ``a``, ``b`` over shards."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    a, b = place(F.col("id"), F.coalesce("text", F.lit("")))
    return rows.select("*", a.alias("a"), b.alias("b"))


def _index(keys: list, ends: np.ndarray) -> bytes:
    """Index of sorted keys (nulls first) whose records end at ``ends``; records of equal keys share a slot."""
    n_null = sum(k is None for k in keys)
    distinct, first, count = np.unique(np.array(keys[n_null:], np.int64), return_index=True, return_counts=True)
    table = PerfectHash.build(distinct)
    slot = table.slots(distinct)
    arrays = {"bits": table.bits, "offsets": np.r_[0, ends]}
    for name, values in (("print", fingerprints(distinct)), ("first", first + n_null), ("count", count)):
        arrays[name] = np.zeros(len(distinct), ARRAYS[name])
        arrays[name][slot] = values
    head = json.dumps({"sizes": table.sizes, "null_records": n_null, "lengths": {k: len(arrays[k]) for k in ARRAYS}}).encode()
    return b"".join([MAGIC, len(head).to_bytes(4, "little"), head, *(arrays[k].astype(t).tobytes() for k, t in ARRAYS.items())])


def write_store(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    end_id: int,
    vocabulary: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    shard_bytes: int = 256 << 20,
) -> None:
    """Encode ``docs`` and write the store.  Null text: the end id alone.  Null ids come first and have no key; they are
    looked up by a null key.  Repeated ids are records of one key, in the order of a hash of their texts; a key of any number of
    records may span shards.  Only rows equal in id and text stay in one shard.  Other columns are not read, whatever their
    names.  Texts of any length are encoded whole.  An empty table gives a store without shards."""
    width = 2 if max(vocabulary, end_id + 1) <= 1 << 16 else 4
    encoded = encode_documents(docs, tokenizer, end_id, width, id_col, text_col)
    weighed = placed(docs, id_col, text_col).select("a", "b", (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).alias("weight"))
    dealt, n = with_shard(encoded.withColumn("hash", F.col("b")), weighed, shard_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, out, keys, sizes = None, None, [], []

        def close() -> pa.RecordBatch:
            ends = np.cumsum(np.array(sizes, np.int64))
            index = Output(path, f"shard-{shard:07d}.idx")
            index.write(_index(keys, ends))
            out.commit()
            index.commit()
            known = [k for k in keys if k is not None]
            row = {"shard": shard, "documents": len(keys), "tokens": int(ends[-1]) // width, "nulls": len(keys) - len(known), "first_key": known[0] if known else None}
            return pa.RecordBatch.from_pylist([row], summary)

        summary = pa.schema([("shard", pa.int32()), ("documents", pa.int64()), ("tokens", pa.int64()), ("nulls", pa.int64()), ("first_key", pa.int64())])
        try:
            for batch in batches:
                columns = (batch.column(c).to_pylist() for c in ("shard", "id", "ids"))
                for s, key, ids in zip(*columns, strict=True):
                    if s != shard:
                        if out:
                            yield close()
                        shard, out, keys, sizes = s, Output(path, f"shard-{s:07d}.ids"), [], []
                    out.write(ids)
                    keys.append(key)
                    sizes.append(len(ids))
            if out:
                yield close()
        except BaseException:
            if out:
                out.discard()
            raise

    sorted_rows = by_shard(dealt, n).sortWithinPartitions("shard", F.asc_nulls_first("id"), "hash", "ids")
    listed = f"shards-{uuid.uuid4().hex}.parquet"
    sorted_rows.select("shard", "id", "ids").mapInArrow(run, SUMMARY).write.parquet(f"{path}/{listed}")
    write_manifest(path, {"width": width, "end_id": end_id, "shards": listed})


class ShardList(NamedTuple):
    """Shards in their order: ids before each, the numbers of those with a key and the first key of each of them, and the numbers
    of those with records without key."""

    starts: np.ndarray
    keyed: np.ndarray
    firsts: np.ndarray
    null: np.ndarray


def shard_list(spark: SparkSession, path: str, name: str) -> ShardList:
    """The list of a store on the driver, ``MOST_SHARDS`` rows at most."""
    rows = spark.read.schema(SUMMARY).parquet(f"{path}/{name}").toArrow().sort_by("shard")
    tokens, nulls, has_key = rows["tokens"].to_numpy(), rows["nulls"].to_numpy(), rows["first_key"].is_valid().to_numpy()
    firsts = rows["first_key"].drop_null().to_numpy()
    return ShardList(np.cumsum(tokens) - tokens, np.flatnonzero(has_key).astype(np.int32), firsts, np.flatnonzero(nulls).astype(np.int32))


class Shard:
    """One shard opened for look-ups."""

    def __init__(self, path: str, shard: int, width: int):
        system, root = file_system(path)
        with system.open_input_stream(f"{root}/shard-{shard:07d}.idx", compression=None) as f:
            raw = f.read()
        if raw[:4] != MAGIC:
            raise ValueError(f"shard {shard} of {path} has no index")
        at = 8 + int.from_bytes(raw[4:8], "little")
        head = json.loads(raw[8:at])
        for name, kind in ARRAYS.items():
            values = np.frombuffer(raw, kind, head["lengths"][name], at)
            at += values.nbytes
            setattr(self, name, values)
        self.null_records, self.width = head["null_records"], width
        self.table = PerfectHash(self.bits, head["sizes"])
        self.payload = system.open_input_file(f"{root}/shard-{shard:07d}.ids")

    def records(self, keys: list) -> list[range]:
        """The record numbers of each key; none for an absent key."""
        known = np.array([k or 0 for k in keys], np.int64)
        slot = self.table.slots(known)
        out = []
        prints = fingerprints(known)
        for k, s, p in zip(keys, slot.tolist(), prints.tolist(), strict=True):
            if k is None:
                out.append(range(self.null_records))
            elif s < 0 or self.print[s] != p:
                out.append(range(0))
            else:
                out.append(range(int(self.first[s]), int(self.first[s]) + int(self.count[s])))
        return out

    def ids(self, record: int) -> np.ndarray:
        a, b = self.offsets[record : record + 2].tolist()
        self.payload.seek(a)
        return np.frombuffer(self.payload.read(b - a), f"<u{self.width}").astype("<u4")


@lru_cache(maxsize=2)
def open_shard(path: str, shard: int, width: int) -> Shard:
    return Shard(path, shard, width)


def look_up(spark: SparkSession, path: str, keys: DataFrame, with_ids: bool = False) -> DataFrame:
    """One row per record of each key in ``keys`` (its first column): ``doc_id``, ``start`` (ids of all records before it),
    ``n_tokens``, ``ids_crc32``, and ``ids`` if asked for.  Absent keys give no row; a repeated key is looked up each time.
    """
    manifest = read_manifest(path)
    width, shards = manifest["width"], shard_list(spark, path, manifest["shards"])
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    if not len(shards.starts):
        return spark.createDataFrame([], schema)
    held = spark.sparkContext.broadcast(shards)  # some 20 bytes a shard
    names = [x.split()[0] for x in schema.split(", ")]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, number, firsts, null = held.value
        for batch in batches:
            key = batch.column("key")
            known = key.drop_null().to_numpy()
            # the last shard that begins below the key, and all that begin with it
            low, high = np.maximum(np.searchsorted(firsts, known, "left") - 1, 0), np.searchsorted(firsts, known, "right")
            at, n = spread(np.arange(len(known)), low, np.maximum(high - low, 0))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(known, n)), pa.array(number[at])], ["key", "shard"])
            rows = key.null_count
            yield pa.RecordBatch.from_arrays([pa.nulls(rows * len(null), pa.int64()), pa.array(np.tile(null, rows))], ["key", "shard"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = held.value.starts
        for batch in batches:
            key, shard = batch.column("key").to_pylist(), batch.column("shard").to_numpy()
            cuts = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1], True])
            for a, b in zip(cuts.tolist(), cuts[1:].tolist(), strict=False):
                store = open_shard(path, int(shard[a]), width)
                out: list[list] = [[] for _ in names]
                for k, records in zip(key[a:b], store.records(key[a:b]), strict=True):
                    for r in records:
                        ids = store.ids(r)
                        row = [k, int(starts[shard[a]]) + int(store.offsets[r]) // width, len(ids), zlib.crc32(ids.tobytes()), ids]
                        for column, x in zip(out, row, strict=False):
                            column.append(x)
                columns = [pa.array(x, pa.int64()) for x in out[:4]]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(x, pa.list_(pa.int64())) for x in out[4:]], names)

    wanted = keys.select(F.col(keys.columns[0]).cast("long").alias("key")).mapInArrow(deal, "key long, shard int")
    return by_shard(wanted, len(shards.starts)).sortWithinPartitions("shard", "key").mapInArrow(read, schema)
