"""Token counts by greedy longest match, in linear time.

The vocabulary is a trie with failure links.  Each node holds how many pieces are popped when its link is followed, worked
out beforehand, so a word's piece count takes one step per character and no piece is ever built.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices
from .pieces import MARK, pieces
from .wordunits import Memory, split


class Automaton:
    """Greedy longest-match counter over ``vocabulary``.

    A character that is no piece by itself counts as its UTF-8 bytes (byte pieces).  Every character of the vocabulary is
    made matchable that way, so that a failure link always exists.
    """

    def __init__(self, vocabulary: list[str]):
        weight = {c: len(c.encode()) for piece in vocabulary for c in piece}
        weight |= {piece: 1 for piece in vocabulary if piece}
        self.step: list[dict[str, int]] = [{}]
        ends = [0]
        for piece, n in weight.items():
            node = 0
            for c in piece:
                if c not in self.step[node]:
                    self.step[node][c] = len(self.step)
                    self.step.append({})
                    ends.append(0)
                node = self.step[node][c]
            ends[node] = n
        self.link, self.popped = [0] * len(ends), [0] * len(ends)
        queue = deque([0])
        while queue:
            u = queue.popleft()
            for c, v in self.step[u].items():
                queue.append(v)
                if ends[v]:
                    self.link[v], self.popped[v] = 0, ends[v]
                    continue
                z, n = self.link[u], self.popped[u]
                while c not in self.step[z]:  # c is matchable at the root, so this ends
                    n += self.popped[z]
                    z = self.link[z]
                self.link[v], self.popped[v] = self.step[z][c], n

    def count(self, word: str) -> int:
        step, link, popped = self.step, self.link, self.popped
        node = n = 0
        for c in word:
            while (to := step[node].get(c)) is None:
                if not node:
                    n += len(c.encode())
                    to = 0
                    break
                n += popped[node]
                node = link[node]
            node = to
        while node:
            n += popped[node]
            node = link[node]
        return n


@cache
def counts(path: str) -> Memory:
    """The piece counts of units, one memory per worker process and file."""
    counter = Automaton([*pieces(path).ids])
    return Memory(lambda units: (np.fromiter((counter.count(MARK + x.replace(" ", MARK)) for x in units), np.int64, len(units)),))


def count_tokens(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_words`` (what single spaces separate), ``n_pieces``: longest matches over the whole text, spaces being marks
    and one leading it.

    No piece goes on from another character to a mark, so texts are counted in units cut before the first space of a run.
    Null or empty text: no word, no piece.  Repeated rows are counted each; other columns are not read, whatever their names.  A text
    of any length is counted whole, with some 100 bytes of memory a word.  An empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = counts(model)
        for batch in slices(batches, "text"):
            units = split(batch.column("text"), every_space=False)
            (found,) = memory.look_up(units.dictionary)
            found = found[units.codes]
            total = np.add.reduceat(np.r_[found, 0], units.offsets[:-1]) if batch.num_rows else np.zeros(0, np.int64)
            empty = (pa.compute.fill_null(pa.compute.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)) == 0
            words = np.where(empty, 0, pa.compute.count_substring(batch.column("text").fill_null(""), " ").to_numpy(zero_copy_only=False) + 1).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(words), pa.array(np.where(empty, 0, total))], ["doc_id", "n_words", "n_pieces"])

    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, n_words long, n_pieces long")
