"""Cost-balanced packing of documents into training sequences.

The cost of a piece of n tokens is estimated as ``linear * n + quadratic * n**2`` (attention stays within a document).
Documents are taken in descending cost, each to the sequence of lowest cost among all that have capacity for it.  A document
longer than a sequence fills whole sequences first; one that fits in none is cut at the end of the cheapest open one.

Packing needs no shuffle: every task packs the documents that it reads, in groups of about ``group_tokens`` tokens.  The
sequences of a group hold exactly its tokens: full ones, and for the rest one sequence per power of two in its binary
form, so nothing is padded.  A group is a million tokens whatever the table's size, and a retried task gives the same rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices
from .token_ids import token_ids

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long, sequence_cost double"


def pack(lengths: list[int], capacity: int, linear: float = 1.0, quadratic: float = 1 / 2048) -> tuple[list[tuple[int, int, int, int, int]], np.ndarray, np.ndarray]:
    """Pieces ``(document, start, length, sequence, offset)``, and the token count and the cost of each sequence.

    Every open sequence is asked for room, so a document is cut only if none has it.
    """
    total = sum(lengths)
    rest = total % capacity
    size = np.array([capacity] * (total // capacity) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1], np.int64)
    room, cost = size.copy(), np.zeros(len(size))
    pieces: list[tuple[int, int, int, int, int]] = []

    def put(s: int, doc: int, start: int, n: int) -> None:
        pieces.append((doc, start, n, s, int(size[s] - room[s])))
        room[s] -= n
        cost[s] += linear * n + quadratic * n * n

    whole = 0
    tails = []
    for doc, n in enumerate(lengths):
        for k in range(n // capacity):
            put(whole, doc, k * capacity, capacity)
            whole += 1
        if n % capacity:
            tails.append((-(n % capacity), doc))
    for minus, doc in sorted(tails):
        left, start = -minus, lengths[doc] + minus
        while left:
            fits = room >= left
            s = int(np.where(fits if fits.any() else room > 0, cost, np.inf).argmin())
            n = min(left, int(room[s]))
            put(s, doc, start, n)
            left, start = left - n, start + n
    return pieces, size, cost


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    end_id: int = 1,
    capacity: int = 2048,
    id_col: str = "doc_id",
    text_col: str = "text",
    linear: float = 1.0,
    quadratic: float = 1 / 2048,
    group_tokens: int = 1 << 20,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece; with ``with_ids`` also the piece's ids (little-endian unsigned 32-bit) as ``ids``.

    ``sequence_cost`` is the estimated cost of the piece's sequence.  Null or empty text: the end id alone.  Repeated rows are
    packed each by itself; a null id stays null; other columns are not read, whatever their names.  A text of any length is
    encoded whole and may span sequences.  An empty table gives an empty result.  Which documents share a sequence, and its
    id, depend on how the table is dealt to tasks; the ids of a document do not.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = token_ids(tokenizer)
        base = TaskContext.get().partitionId() << 40
        ids: list[np.ndarray] = []
        names: list = []
        held = 0

        def out() -> pa.RecordBatch:
            nonlocal base, held
            pieces, size, cost = pack([len(x) for x in ids], capacity, linear, quadratic)
            raw = [ids[d][s : s + n].tobytes() for d, s, n, _, _ in pieces]
            grid = np.array(pieces, np.int64).reshape(-1, 5)
            doc, start, length, sequence, offset = grid.T
            lengths = np.fromiter(map(len, ids), np.int64, len(ids))
            columns = [
                pa.array([names[d] for d in doc.tolist()], pa.int64()),
                pa.array(start),
                pa.array(length),
                pa.array([zlib.crc32(x) for x in raw], pa.int64()),
                pa.array(lengths[doc]),
                pa.array(sequence + base),
                pa.array(offset),
                pa.array(size[sequence]),
                pa.array(cost[sequence]),
            ]
            if with_ids:
                columns.append(pa.array(raw, pa.binary()))
            base += len(size)
            ids.clear()
            names.clear()
            held = 0
            return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in schema.split(", ")])

        for batch in slices(batches, "text", 8 << 20):
            flat, offsets = encoder.encode(batch.column("text"))
            for name, a, b in zip(batch.column("id").to_pylist(), offsets.tolist(), offsets[1:].tolist(), strict=False):
                names.append(name)
                ids.append(np.append(flat[a:b], np.uint32(end_id)).astype("<u4"))
                held += b - a + 1
                if held >= group_tokens:
                    yield out()
        if ids:
            yield out()

    schema = SCHEMA + ", ids binary" * with_ids
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)
