"""Periodic runs of words, and texts without the repetitions.

A run of period q covers, at every multiple of 3q it holds, a pair of equal words q apart from which it extends to both sides.
So pairs on these harmonic grids are extended by longest common extensions, forwards in the words and in their reverse.  An
extension compares word by word until both places fall into a difference cover at once; beyond, it is the minimum of a range
over the common prefixes of neighbours among the sorted suffixes, of which only those that start in the cover are sorted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices

#: A perfect difference set.  Each difference modulo PERIOD, other than 0, is that of exactly one pair.
PERIOD, COVER = 13, (0, 1, 3, 9)
#: Pairs that are looked at together.
CHUNK = 1 << 20


def _sync() -> np.ndarray:
    """Words to go from places i and j, given modulo the period, until both are in the cover."""
    inside = np.isin(np.arange(PERIOD), COVER)
    d = np.arange(PERIOD)
    both = inside[(d[:, None, None] + d) % PERIOD] & inside[(d[None, :, None] + d) % PERIOD]
    return both.argmax(2)


SYNC = _sync()


class Extensions:
    """Longest common extensions of one sequence of non-negative ints.  The sorted part is built when a pair first needs it."""

    def __init__(self, words: np.ndarray):
        self.n = len(words)
        # past the end nothing equals a word; two places past the end are never compared, since one starts earlier
        self.words = np.concatenate([words.astype(np.int64), np.full(PERIOD, -1, np.int64)])
        self.rank: np.ndarray | None = None

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """For places ``i`` < ``j`` the number of equal words from there on."""
        length = np.zeros(len(i), np.int64)
        sync, on = SYNC[i % PERIOD, j % PERIOD], np.arange(len(i))
        for d in range(PERIOD):
            on = on[sync[on] > d]
            on = on[self.words[i[on] + d] == self.words[j[on] + d]]
            if not len(on):
                break
            length[on] = d + 1
        on = np.flatnonzero((length == sync) & (j + sync < self.n))
        on = on[self.words[i[on] + sync[on]] == self.words[j[on] + sync[on]]]
        if len(on):
            if self.rank is None:
                self._build()
            a, b = self.rank[i[on] + sync[on]], self.rank[j[on] + sync[on]]
            length[on] += self._least(np.minimum(a, b), np.maximum(a, b))
        return length

    def _build(self) -> None:
        n, v = self.n, PERIOD
        at = np.concatenate([np.arange(c, n, v) for c in COVER])
        start = np.concatenate([[0], np.cumsum([len(range(c, n, v)) for c in COVER])])
        # names of blocks of v words, several words to a sort key
        bits = max(1, int(self.words.max() + 1).bit_length())
        each, keys = max(1, 62 // bits), []
        for first in range(0, v, each):
            key = np.zeros(len(at), np.int64)
            for d in range(first, min(first + each, v)):
                key = (key << bits) + self.words[at + d] + 1
            keys.append(key)
        order = np.lexsort(keys[::-1])
        new = np.zeros(len(at), bool)
        for key in keys:
            new[1:] |= key[order][1:] != key[order][:-1]
        names = [_named(order, new)]
        # doubling: a cover's place and the one 2^k blocks on are in the same residue's stretch of ``at``
        stretch = np.repeat(start[1:], np.diff(start))
        step = 1
        while names[-1].max(initial=0) + 1 < len(at):
            ahead = np.arange(len(at)) + step
            second = np.where(ahead < stretch, names[-1][np.minimum(ahead, len(at) - 1)] + 1, 0)
            order = np.lexsort([second, names[-1]])
            a, b = names[-1][order], second[order]
            names.append(_named(order, np.concatenate([[False], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])))
            step *= 2
        # common prefixes of neighbours: whole blocks from the widest names down, then word by word
        x, y = order[:-1].copy(), order[1:].copy()
        p, q, common = at[x], at[y], np.zeros(max(len(at) - 1, 0), np.int64)
        for k in range(len(names) - 2, -1, -1):
            live = np.flatnonzero((x < stretch[order[:-1]]) & (y < stretch[order[1:]]))
            live = live[names[k][x[live]] == names[k][y[live]]]
            common[live] += v << k
            x[live] += 1 << k
            y[live] += 1 << k
        on = np.arange(len(common))
        for _ in range(v):
            on = on[np.maximum(p[on], q[on]) + common[on] < n]
            on = on[self.words[p[on] + common[on]] == self.words[q[on] + common[on]]]
            common[on] += 1
        self.rank = np.full(n, -1, np.int64)
        self.rank[at[order]] = np.arange(len(at))
        kind = np.int32 if n < 2**31 else np.int64
        self.table = [common.astype(kind)]  # row k: least of 2^k from there on
        while 2 << len(self.table) - 1 <= len(common):
            last, half = self.table[-1], 1 << len(self.table) - 1
            self.table.append(np.minimum(last[:-half], last[half:]))

    def _least(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Least common prefix between the suffixes of ranks ``low`` < ``high``."""
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.zeros(len(low), np.int64)
        for k in np.unique(level).tolist():
            m = level == k
            out[m] = np.minimum(self.table[k][low[m]], self.table[k][high[m] - (1 << k)])
        return out


def _named(order: np.ndarray, new: np.ndarray) -> np.ndarray:
    names = np.empty(len(order), np.int64)
    names[order] = np.cumsum(new)
    return names


def grid(n: int, power: int, chunk: int = CHUNK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and periods: for each period q up to n / power the multiples of (power - 1) q below n - q, in chunks."""
    first, most = 1, n // power
    while first <= most:
        q = np.arange(first, most + 1)
        counts = -(-(n - q) // ((power - 1) * q))
        upto = max(1, int(np.searchsorted(np.cumsum(counts), chunk, "right")))
        q, counts = q[:upto], counts[:upto]
        each = np.repeat(q, counts)
        number = np.arange(len(each)) - np.repeat(np.cumsum(counts) - counts, counts)
        yield number * (power - 1) * each, each
        first += upto


def find_runs(words: np.ndarray, least: int = 6, power: int = 4) -> np.ndarray:
    """``(start, length, period)`` of every run, by start, then period: the longest stretches whose smallest period q leaves
    a length of at least ``power`` times q and ``least`` (``power`` 2 or more)."""
    n, places, periods = len(words), [], []
    for i, q in grid(n, power):
        equal = words[i] == words[i + q]
        places.append(i[equal])
        periods.append(q[equal])
    i = np.concatenate(places) if places else np.zeros(0, np.int64)
    if not len(i):
        return np.zeros((0, 3), np.int64)
    q = np.concatenate(periods)
    end = i + q + Extensions(words)(i, i + q)
    # backwards from the words before: in the reverse, the later place comes first
    start = i - Extensions(words[::-1])(n - i - q, n - i)
    length = end - start
    fine = length >= np.maximum(least, power * q)
    found = np.stack([start[fine], length[fine], q[fine]], 1)
    found = found[np.lexsort([found[:, 2], found[:, 1], found[:, 0]])]
    # a stretch is found at the multiples of its period too: the smallest comes first
    smallest = np.r_[True, (found[1:, :2] != found[:-1, :2]).any(1)] if len(found) else np.zeros(0, bool)
    found = found[smallest]
    return found[np.lexsort([found[:, 2], found[:, 0]])]


def repeated(n: int, runs: np.ndarray) -> np.ndarray:
    """For each of ``n`` words whether a run holds it after its first period."""
    depth = np.zeros(n + 1, np.int64)
    np.add.at(depth, runs[:, 0] + runs[:, 2], 1)
    np.add.at(depth, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(depth[:n]) > 0


def collapse_runs(docs: DataFrame, text_col: str = "text", least: int = 6, power: int = 4) -> DataFrame:
    """``docs`` with ``n_words``, ``runs`` (array of ``start``, ``length``, ``period`` in words, by start, then period) and
    ``collapsed``: the words that no run holds after its first period, joined by single spaces.

    Words are what stands between the ASCII blanks.  Null and empty texts have no words, no run and an empty ``collapsed``.  Texts
    are taken whole, of any length; memory is that of one text and its index.  Repeated rows are treated alike.  Columns of
    ``docs`` named as one of the new ones are replaced.  Nothing is shuffled.
    """
    new = "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    names = ("n_words", "runs", "collapsed")
    kept = docs.select(*[c for c in docs.columns if c not in names or c == text_col])
    fields = [f for f in kept.schema.fields if f.name not in names]
    text_at = kept.columns.index(text_col)
    schema = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        struct = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])
        for part in slices(batches, text_col):
            counts, all_runs, texts = [], [], []
            for text in part.column(text_at):
                words = (text.as_py() or "").encode().split()
                known: dict[bytes, int] = {}
                ids = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
                runs = find_runs(ids, least, power) if len(known) < len(words) else np.zeros((0, 3), np.int64)
                if len(runs):
                    words = [w for w, gone in zip(words, repeated(len(words), runs).tolist(), strict=True) if not gone]
                counts.append(len(ids))
                all_runs.append(runs)
                texts.append(b" ".join(words).decode())
            flat = np.concatenate(all_runs) if all_runs else np.zeros((0, 3), np.int64)
            ends = np.cumsum([0, *map(len, all_runs)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], fields=list(struct)))
            held = [part.column(i) for i, c in enumerate(part.schema.names) if c not in names]
            yield pa.RecordBatch.from_arrays([*held, pa.array(counts, pa.int64()), lists, pa.array(texts, pa.string())], [*(f.name for f in fields), *names])

    return kept.mapInArrow(run, f"{schema}, {new}" if schema else new)


def strongest(runs: Column) -> Column:
    """The run of the greatest length / period, compared as whole numbers; ties to the smaller start, then period; null without runs."""
    better = lambda a, b: a["length"] * b["period"] > b["length"] * a["period"]
    rest = F.slice(runs, 2, F.greatest(F.size(runs) - 1, F.lit(0)))
    return F.when(F.size(runs) > 0, F.reduce(rest, F.try_element_at(runs, F.lit(1)), lambda a, b: F.when(better(b, a), b).otherwise(a)))
