"""Sampled segmentations without replacement: Gumbel top-k by a perturbed best-first search over the piece lattice.

A text's lattice is the chain of its words' lattices.  Log-sums from each lattice state to its word's end turn piece scores
into choices per state, so that a choice's share of the probability is known before the path is complete.  The search
works on perturbed log-probabilities (Gumbel noise): a set of segmentations has the largest perturbed value of its members;
a path drawn from it in proportion to probability keeps that value, while all that leave this path, at whatever choice, are a
set whose value is one draw truncated by it.  Popping the best set, drawing the choice at which its path leaves the known
one, completing it and pushing what is left gives distinct segmentations in the order of their perturbed values, which is
sampling without replacement.

All noise is a hash of (seed, row key, sample, word, place), so a row's samples depend on nothing but its key and text.
Lattices of words are remembered by the worker, so frequent words are laid out once.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices
from .mphf import mix
from .pieces import MARK, pieces
from .wordunits import split, spread

#: Log-probability of a byte piece beside scores by rank.
BYTE_SCORE = -14.0
#: Bytes of lattices and words that a worker remembers.
REMEMBERED = 96 << 20
#: Stands for a space mark that the text itself holds; no code point.
OWN_MARK = 0x110000


class Lattice(NamedTuple):
    """Lattices of words: states are character places, edges are sorted by their state and length.

    ``first[s]:first[s + 1]`` are the edges of state s; ``share`` their conditional probabilities; ``to`` the next state;
    ``piece`` the id, or -1 - code point for a character spelled by bytes.
    """

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    to: np.ndarray
    piece: np.ndarray
    share: np.ndarray

    @property
    def nbytes(self) -> int:
        return sum(x.nbytes for x in self)

    def followed_by(self, other: Lattice) -> Lattice:
        states, edges = len(self.first) - 1, len(self.to)
        own = (self.start, self.end, self.first[:-1], self.to, self.piece, self.share)
        return Lattice(*(np.concatenate([x, y + x.dtype.type(n)]) for x, y, n in zip(own, other, (states, states, edges, states, 0, 0), strict=True)))


class Vocabulary:
    """A trie over the pieces as sorted (node, character) keys; ``piece[node]`` is the piece that ends there or -1.

    It remembers the lattices of the words it has met, up to ``REMEMBERED`` bytes.
    """

    def __init__(self, path: str, scores: str):
        found = pieces(path)
        score = found.scores(scores)
        step: dict[tuple[int, int], int] = {}
        piece = [-1]
        for text, i in found.ids.items():
            node = 0
            for c in map(ord, text):
                key = (node, c)
                if key not in step:
                    step[key] = len(piece)
                    piece.append(-1)
                node = step[key]
            piece[node] = i
        keys = np.array([(n << 21) | c for n, c in step], np.int64)
        order = np.argsort(keys)
        self.keys, self.to = np.r_[keys[order], np.int64(2**62)], np.r_[np.array([*step.values()], np.int64)[order], 0]
        self.low = np.zeros((len(piece), 128), np.int32)  # the same for ASCII, by place: 0 where there is no step
        for (node, c), to in step.items():
            if c < 128:
                self.low[node, c] = to
        self.piece = np.array(piece, np.int64)
        self.score = np.zeros(max(score) + 1)
        self.score[[*score]] = [*score.values()]
        self.byte_score = BYTE_SCORE if scores == "rank" else min(score.values())
        self.byte_ids = np.array(found.byte_ids, np.int64)
        spelled = {i: t.replace(MARK, " ").encode() for t, i in found.ids.items()} | {i: bytes([b]) for b, i in enumerate(found.byte_ids)}
        self.spelled = pa.array([spelled.get(i, b"") for i in range(max(spelled) + 1)], pa.large_binary())
        self.memory: dict[str, int] = {}
        self.net = lattice([], self)

    def lattices(self, words: list[str]) -> tuple[Lattice, np.ndarray]:
        """A lattice that holds all ``words``, and the number of each in it.  The first words met are remembered, among them
        all frequent ones; what no longer fits is laid out for this call alone."""
        memory, net = self.memory, self.net
        if new := [x for x in words if x not in memory]:
            memory.update(zip(new, range(len(memory), len(memory) + len(new)), strict=True))
            net = net.followed_by(lattice(new, self))
        numbers = np.fromiter(map(memory.__getitem__, words), np.int64, len(words))
        if net.nbytes + 150 * len(memory) < REMEMBERED:
            self.net = net
        else:
            for x in new:
                del memory[x]
        return net, numbers

    def next(self, node: np.ndarray, point: np.ndarray) -> np.ndarray:
        """The node that each character leads to, 0 for none."""
        out = self.low[node, np.minimum(point, 127)].astype(np.int64)
        other = np.flatnonzero(point >= 127)
        key = (node[other] << 21) | point[other]
        k = np.searchsorted(self.keys, key)
        out[other] = np.where(self.keys[k] == key, self.to[k], 0)
        return out

    def decode(self, ids: list[np.ndarray]) -> pa.Array:
        """The bytes that each array of ids encodes, the first word's leading space with them."""
        cuts = np.cumsum([0, *map(len, ids)])
        spelled = self.spelled.take(pa.array(np.concatenate([np.zeros(0, np.int64), *ids])))
        return pc.binary_join(pa.LargeListArray.from_arrays(cuts, spelled), pa.scalar(b"", pa.large_binary()))


@cache
def vocabulary(path: str, scores: str = "rank") -> Vocabulary:
    return Vocabulary(path, scores)


def lattice(words: list[str], v: Vocabulary) -> Lattice:
    points = np.frombuffer(("\n".join(words) + "\n").encode("utf-32-le"), "<u4").astype(np.int64) if words else np.zeros(0, np.int64)
    points[points == ord(MARK)] = OWN_MARK  # a mark in the text is spelled by its bytes
    points[points == ord(" ")] = ord(MARK)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2  # a mark before the word, and a state at its end
    end = np.cumsum(size) - 1
    start = end - size + 1
    points = np.insert(points, start - np.arange(len(words)), ord(MARK))
    stop = np.repeat(end, size)
    at = np.flatnonzero(np.arange(len(points)) < stop)
    node, place = np.zeros(len(at), np.int64), at.copy()
    froms, tos, ids = [], [], []
    depth = 0
    spelled = np.zeros(len(points), bool)
    while len(at):
        node = v.next(node, points[place])
        hit = np.flatnonzero(node)
        at, place, node = at[hit], place[hit] + 1, node[hit]
        whole = v.piece[node] >= 0
        froms.append(at[whole])
        tos.append(place[whole])
        ids.append(v.piece[node[whole]])
        if not depth:
            spelled[at[whole]] = True
        depth += 1
        on = place < stop[at]
        at, place, node = at[on], place[on], node[on]
    bare = np.flatnonzero(~spelled & (np.arange(len(points)) < stop))
    source, to = np.concatenate([*froms, bare]), np.concatenate([*tos, bare + 1])
    plain = np.where(points[bare] == OWN_MARK, ord(MARK), points[bare])
    piece = np.concatenate([*ids, -1 - plain])
    n_bytes = 1 + (plain >= 0x80) + (plain >= 0x800) + (plain >= 0x10000)
    score = np.concatenate([v.score[np.concatenate(ids)] if ids else np.zeros(0), v.byte_score * n_bytes])
    # edges in the order of their state: what each depth found is in order already, so this merges runs
    order = np.argsort(source, kind="stable")
    source, to, piece, score = source[order], to[order], piece[order], score[order]
    count = np.bincount(source, minlength=len(points))
    first = np.r_[0, np.cumsum(count)]
    # log-sums backwards, all words at once, by the distance from the word's end
    ahead = np.zeros(len(points))
    far = stop - np.arange(len(points))
    states = np.argsort(far.astype(np.uint16) if len(far) and far.max() < 1 << 16 else far, kind="stable")
    cuts = np.searchsorted(far[states], np.arange(1, (int(far.max()) if len(far) else 0) + 2))
    for a, b in zip(cuts.tolist(), cuts[1:].tolist(), strict=False):
        at, n = spread(states[a:b], first, count)
        ahead[states[a:b]] = np.logaddexp.reduceat(score[at] + ahead[to[at]], np.cumsum(n) - n)
    share = np.exp(score + ahead[to] - ahead[source])
    return Lattice(start, end, first.astype(np.int32), to.astype(np.int32), piece.astype(np.int32), share)


def draw(key: np.ndarray, word: np.ndarray, place: np.ndarray, kind: int) -> np.ndarray:
    """Uniform numbers in (0, 1) by hashing."""
    with np.errstate(over="ignore"):
        x = mix(key ^ mix((word.astype(np.uint64) << np.uint64(32)) + place.astype(np.uint64), kind), kind)
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53


def truncated(location, most, u):
    """Gumbel values at ``location`` given that they lie below ``most``; scalars or arrays."""
    return -np.logaddexp(-most, -(location - np.log(-np.log(u))))


class Paths(NamedTuple):
    """Choices in the order of texts and words: text, word, state and edge."""

    text: np.ndarray
    word: np.ndarray
    state: np.ndarray
    edge: np.ndarray


def walk(net: Lattice, text: np.ndarray, word: np.ndarray, code: np.ndarray, state: np.ndarray, key: np.ndarray) -> Paths:
    """Complete each word from ``state`` to its end by drawn choices."""
    of = np.arange(len(text))
    start, end = net.start[code], net.end[code]
    whose, states, edges = [], [], []
    on = state < end
    of, state = of[on], state[on]
    while len(of):
        u = draw(key[of], word[of], state - start[of], 1)
        low, e = net.first[state], net.first[state + 1] - 1  # from the longest edge on, mostly the likeliest
        more = np.flatnonzero((u >= net.share[e]) & (e > low))
        while len(more):
            u[more] -= net.share[e[more]]
            e[more] -= 1
            more = more[(u[more] >= net.share[e[more]]) & (e[more] > low[more])]
        whose.append(of)
        states.append(state)
        edges.append(e)
        state = net.to[e]
        on = state < end[of]
        of, state = of[on], state[on]
    # a word has a choice in every step up to its last: the k-th one's place is known
    steps = sum((np.bincount(x, minlength=len(text)) for x in whose), np.zeros(len(text), np.int64))
    base = np.cumsum(steps) - steps
    out_state, out_edge = np.empty(int(steps.sum()), np.int64), np.empty(int(steps.sum()), np.int64)
    for k, (of, x, e) in enumerate(zip(whose, states, edges, strict=True)):
        out_state[base[of] + k], out_edge[base[of] + k] = x, e
    return Paths(np.repeat(text, steps), np.repeat(word, steps), out_state, out_edge)


class Path(NamedTuple):
    """A finished segmentation.  Its choices up to a point are those of the set it came from; ``ahead`` is their
    log-probability.  ``place`` has the later choices that had an alternative, ``before`` the log-probability from that point
    to each of them."""

    word: np.ndarray
    state: np.ndarray
    edge: np.ndarray
    ahead: float
    place: np.ndarray
    before: np.ndarray


class Beside(NamedTuple):
    """The segmentations that leave a path after its fixed choices, without those that take a choice in ``taken``."""

    value: float
    path: int
    mass: np.ndarray
    taken: tuple[tuple[int, int], ...]


def open_shares(net: Lattice, path: Path, i: int, taken: tuple[tuple[int, int], ...]) -> tuple[int, np.ndarray]:
    """The first edge of the state at the path's i-th place, and the shares of its edges that lead into the set, else 0."""
    at = path.place[i]
    low = int(net.first[path.state[at]])
    shares = net.share[low : int(net.first[path.state[at] + 1])].copy()
    shares[[int(path.edge[at]) - low, *(e - low for j, e in taken if j == i)]] = 0.0
    return low, shares


def chosen(weights: np.ndarray, u: float) -> int:
    """A place in proportion to its weight."""
    reach = weights.cumsum()
    return min(int(reach.searchsorted(u * reach[-1], "right")), int(weights.nonzero()[0][-1]))


def sample(texts: pa.Array, keys: np.ndarray, v: Vocabulary, n_samples: int, seed: int) -> Iterator[tuple[int, int, np.ndarray, float, float]]:
    """Per text and sample: text, sample number from 0, ids, log-probability, log of the inclusion probability given the
    largest perturbed value left out (0 if the text has no further segmentation)."""
    units = split(texts, every_space=False)
    net, numbers = v.lattices(units.unique)
    codes = numbers[units.codes]
    n_texts, sizes = len(units.offsets) - 1, np.diff(units.offsets)
    text = np.repeat(np.arange(n_texts), sizes)
    word = np.arange(len(codes)) - np.repeat(units.offsets[:-1], sizes)
    row_key = mix(keys.view(np.uint64), seed)
    best = -np.log(-np.log(draw(row_key, np.zeros(n_texts), np.zeros(n_texts), 0)))  # the perturbed value of all together
    agenda: list[list[Beside]] = [[] for _ in range(n_texts)]
    done: list[list[tuple[np.ndarray, float]]] = [[] for _ in range(n_texts)]
    paths: list[list[Path]] = [[] for _ in range(n_texts)]
    head: list[tuple | None] = [None] * n_texts  # word, state, edge of the fixed choices, and their log-probability
    alive, fresh, state = np.ones(n_texts, bool), np.ones(len(text), bool), net.start[codes]
    for s in range(n_samples):
        key = mix(row_key, 7919 + s)
        new = walk(net, text[fresh], word[fresh], codes[fresh], state[fresh], key[text[fresh]])
        share = np.minimum(net.share[new.edge], 1.0)
        log = np.log(share)
        open_ = np.flatnonzero(share < 1.0)
        cuts, open_cuts = (np.searchsorted(x, np.arange(n_texts + 1)).tolist() for x in (new.text, new.text[open_]))
        noise = [draw(key, np.zeros(n_texts), np.zeros(n_texts), kind).tolist() for kind in (2, 3, 4, 5)]
        fresh, state = np.zeros(len(text), bool), net.start[codes]
        for t in np.flatnonzero(alive).tolist():
            a, b = cuts[t], cuts[t + 1]
            choices, ahead, fixed = (new.word[a:b], new.state[a:b], new.edge[a:b]), 0.0, 0
            if head[t]:
                choices = tuple(np.concatenate([x, y]) for x, y in zip(head[t], choices, strict=False))
                ahead, fixed = head[t][3], len(head[t][0])
            done[t].append((choices[2], ahead + float(log[a:b].sum())))  # text by text: sums do not depend on the slice
            if len(agenda[t]) > n_samples - s:  # no more than the samples still wanted, and one for the inclusion scores
                agenda[t].sort(key=lambda x: -x.value)
                del agenda[t][n_samples - s :]
            place = open_[open_cuts[t] : open_cuts[t + 1]]
            for most in (1024, len(place)):
                after = log[place[:most]].cumsum()
                if len(after) == len(place) or after[-1] < -700:
                    break  # beyond, no mass is left that a double could hold
            place = place[: len(after)]
            before = after - log[place]
            mass = np.exp(before) * (1.0 - share[place])
            paths[t].append(Path(*choices, ahead, place - a + fixed, before))
            if (beside := float(mass.sum())) > 0:
                agenda[t].append(Beside(float(truncated(ahead + math.log(beside), best[t], noise[0][t])), s, mass, ()))
            if s + 1 == n_samples or not agenda[t]:
                alive[t] = False
                continue
            # pop the best set, choose within it what keeps its value, push what is left of it
            popped = agenda[t].pop(max(range(len(agenda[t])), key=lambda k: agenda[t][k].value))
            path = paths[t][popped.path]
            i = chosen(popped.mass, noise[1][t])
            low, shares = open_shares(net, path, i, popped.taken)
            e = chosen(shares, noise[2][t])
            mass, log_before, taken = popped.mass.copy(), float(path.before[i]), float(shares[e])
            shares[e] = 0.0
            mass[i] = math.exp(log_before) * shares.sum()
            if (left := float(mass.sum())) > 0:
                value = float(truncated(path.ahead + math.log(left), popped.value, noise[3][t]))
                agenda[t].append(Beside(value, popped.path, mass, (*popped.taken, (i, low + e))))
            at = int(path.place[i])
            w = int(path.word[at])
            best[t] = popped.value
            fixed_choices = (np.append(x[:at], y) for x, y in zip(path[:3], (w, path.state[at], low + e), strict=True))
            head[t] = (*fixed_choices, path.ahead + log_before + math.log(taken))
            fresh[int(units.offsets[t]) + w : int(units.offsets[t + 1])] = True
            state[int(units.offsets[t]) + w] = net.to[low + e]
    flat, stops = spelled_out(net.piece[np.concatenate([np.zeros(0, np.int64), *(edges for x in done for edges, _ in x)])], v)
    ends = stops[np.cumsum([0, *(len(edges) for x in done for edges, _ in x)])]
    spans = zip(ends.tolist(), ends[1:].tolist(), strict=False)
    for t in range(n_texts):
        out = max((x.value for x in agenda[t]), default=-np.inf)
        for s, (_, log_p) in enumerate(done[t]):
            inclusion = 0.0
            if out > -np.inf:
                x = math.exp(min(log_p - out, 700.0))
                inclusion = log_p - out if x < 1e-9 else math.log(-math.expm1(-x))
            a, b = next(spans)
            yield t, s, flat[a:b], log_p, inclusion


def spelled_out(ids: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """``ids`` with the byte pieces of each character that stands as -1 - code point, and the length before each id."""
    odd = ids < 0
    points, number = np.unique(ids[odd], return_inverse=True)
    spelled = [v.byte_ids[[*chr(-1 - x).encode()]] for x in points.tolist()]
    lengths = np.fromiter(map(len, spelled), np.int64, len(spelled))
    n = np.ones(len(ids), np.int64)
    n[odd] = lengths[number]
    stops = np.r_[0, np.cumsum(n)]
    out = np.repeat(ids, n).astype(np.int64)
    at, _ = spread(number, np.cumsum(lengths) - lengths, lengths)
    out[np.repeat(odd, n)] = np.concatenate([np.zeros(0, np.int64), *spelled])[at]
    return out, stops


def sample_segmentations(
    docs: DataFrame, model: str, n_samples: int = 2, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, scores: str = "rank"
) -> DataFrame:
    """Up to ``n_samples`` distinct segmentations of each whole text, without replacement.

    ``doc_id``, ``sample``, ``n_pieces``, ``ids_crc32``, ``log_prob``, ``log_inclusion``, ``decoded_ok`` (decoding gives the text
    back), and ``ids`` if asked for.  ``scores``: log-probabilities by ``rank`` or as they stand in the ``file`` (see
    ``Pieces.scores``).  Words are cut at spaces that follow something other than white space, so a run of spaces begins a
    word and pieces of several marks can be drawn.  Null or empty text is one empty word, the space mark.  A text with fewer
    segmentations gives fewer rows.  Rows with equal ids and texts get equal samples; a null id counts as key 0.  Other
    columns are not read.  A text of any length is one slice: some 100 bytes of memory a byte.  An empty table gives an
    empty result.
    """
    schema = "doc_id long, sample int, n_pieces long, ids_crc32 long, log_prob double, log_inclusion double, decoded_ok boolean" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model, scores)
        space, none = pa.scalar(b" ", pa.large_binary()), pa.scalar(b"", pa.large_binary())
        for batch in slices(batches, "text", 1 << 20):
            texts = batch.column("text")
            keys = pc.fill_null(batch.column("id"), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            rows, samples, found, log_p, inclusion = ([*x] for x in zip(*sample(texts, keys, v, n_samples, seed), strict=True))
            spelled = pc.binary_join_element_wise(space, pc.fill_null(texts.cast(pa.large_binary()), b""), none)
            out = [
                batch.column("id").take(pa.array(rows)),
                pa.array(samples, pa.int32()),
                pa.array([len(x) for x in found], pa.int64()),
                pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in found], pa.int64()),
                pa.array(log_p, pa.float64()),
                pa.array(inclusion, pa.float64()),
                pc.equal(v.decode(found), spelled.take(pa.array(rows))),
            ]
            if with_ids:
                out.append(pa.array([x.astype(np.int32) for x in found], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(out, [x.split()[0] for x in schema.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)
