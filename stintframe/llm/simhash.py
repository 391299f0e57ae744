"""SimHash near-duplicates by pigeonhole blocks.

A text's fingerprint holds, per bit, the majority over the XXH64 hashes of its word shingles; each further 64 bits take the
next seed.  The bits are split into blocks and each combination of ``agree`` blocks is a key, so that two fingerprints
meet under a key whenever at most ``n_blocks - agree`` blocks differ: surely with ``n_blocks - agree`` differing bits or
fewer, likely with more.  With 64 bits, six blocks and two agreeing, every pair within 4 bits meets and a key fixes 21 bits
(15 keys a fingerprint); more fingerprints take more blocks, up to eight and four (32 bits, 70 keys) at billions (``blocks_for``).

Equal fingerprints are one node before any pairing.  Keys are dealt as pairs of two numbers; fingerprints follow only under keys
that several share.  A key that very many different fingerprints share is cut into chunks,
and each pair of chunks is compared by one task; a comparison returns one star of edges per component it finds instead of
all pairs.  So no task holds more than two chunks of a key, nothing is sampled, and the rows made stay linear in each pair
of chunks.

A similarity far below 1 differs in more bits than blocks can promise.  For it, ``similar_documents`` takes many keys of
bits drawn from a wide fingerprint, allows over three deviations more than the similarity's own bits, and lets only documents
link whose shingle sets reach the similarity exactly.  The keys' width grows with the number of different texts, so that a key
holds a chunk of them at most by chance at any size, and their number with the width, so that the recall worked out at the least similarity
stays.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, cut, groups, runs, slices, written
from .mphf import mix

SEED = 42
#: Different fingerprints of one block combination that a task takes at once.
CHUNK = 1024
#: Runs up to this length are compared by shifted arrays, longer ones by a bit-distance matrix.
SHORT_RUN = 32
#: Different shingle sets of one group of candidates, and bytes of their texts, that a task holds twice at once.
SETS, BYTES = 1024, 4 << 20
#: Shingles whose places in the sets of a task are laid out at once.
COLUMNS = 4096
#: Different texts that a key of ``similar_documents`` holds by chance, and the least width of keys.
PER_KEY, LEAST_WIDTH = 1024, 12


def shingles_of(text: bytes, shingle_words: int) -> list[bytes]:
    """Word shingles; A-Z are lower-cased, ASCII white space separates words, a text of fewer words than a shingle is one
    shingle, a text without words has none."""
    words = text.lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    width = min(shingle_words, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    n = len(words) - width + 1
    return [joined[i:j] for i, j in zip(starts[:n].tolist(), ends[width - 1 :].tolist(), strict=True)]


def fingerprint(text: bytes, shingle_words: int, words64: int = 1) -> np.ndarray:
    """The bits of one text in UTF-8 as ``words64`` unsigned 64-bit numbers; without words no bit is set."""
    return bits_of(shingles_of(text, shingle_words), words64)


def bits_of(shingles: list[bytes], words64: int) -> np.ndarray:
    if not shingles:
        return np.zeros(words64, np.uint64)
    n = len(shingles)
    digest = xxhash.xxh64_intdigest
    bits = []
    for seed in range(SEED, SEED + words64):
        hashes = np.fromiter((digest(x, seed) for x in shingles), "<u8", n)
        ones = np.zeros(64, np.int64)
        for k in range(0, n, 65536):
            part = hashes[k : k + 65536].view(np.uint8).reshape(-1, 8)
            ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        bits.append(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])
    return np.array(bits, np.uint64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 4, words64: int = 1) -> DataFrame:
    """One row per document: ``id``, ``fp`` (binary, 64-bit words little-endian).  A null text counts as empty: no bit set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = [fingerprint(x or b"", shingle_words, words64).astype("<u8").tobytes() for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, pa.binary())], ["id", "fp"])

    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    return narrow.mapInArrow(run, "id long, fp binary")


def block_keys(fps: np.ndarray, n_blocks: int, agree: int) -> Iterator[np.ndarray]:
    """For each combination of blocks, a hash of the combination and its bits per fingerprint (rows of 64-bit words).
    Bits of different combinations, or of other values, may share a hash: pairs are verified anyway."""
    bits = np.unpackbits(fps.astype("<u8").view(np.uint8), axis=1, bitorder="little")
    edges = [round(bits.shape[1] * i / n_blocks) for i in range(n_blocks + 1)]
    blocks = []
    for lo, hi in zip(edges, edges[1:], strict=False):
        packed = np.packbits(bits[:, lo:hi], axis=1, bitorder="little")
        value = np.zeros(len(fps), np.uint64)
        for c in range(packed.shape[1]):
            value = mix(value ^ packed[:, c].astype(np.uint64), lo + c)
        blocks.append(value)
    for n, chosen in enumerate(combinations(range(n_blocks), agree)):
        value = np.full(len(fps), n, np.uint64)
        for i in chosen:
            value = mix(value ^ blocks[i], n)
        yield value.view(np.int64)


def drawn_keys(fps: np.ndarray, width: int, count: int) -> Iterator[np.ndarray]:
    """``count`` keys, each a hash of its number and of ``width`` bits drawn anew from the fingerprint."""
    bits = np.unpackbits(fps.astype("<u8").view(np.uint8), axis=1, bitorder="little")
    draw = np.random.default_rng(SEED)
    for n in range(count):
        chosen = draw.choice(bits.shape[1], width, replace=False)
        packed = bits[:, chosen].astype(np.uint64) @ (np.uint64(1) << np.arange(width, dtype=np.uint64))
        yield mix(mix(np.full(len(fps), n, np.uint64), 0) ^ packed, n).view(np.int64)


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1)


def stars(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places that connect what the square matrix ``near`` links: a star around the first member of each component."""
    free, left, right = np.ones(len(near), bool), [], []
    for i in range(len(near)):
        if free[i]:
            free[i] = False
            frontier = np.flatnonzero(near[i] & free)
            while len(frontier):
                free[frontier] = False
                left.append(np.full(len(frontier), i))
                right.append(frontier)
                frontier = np.flatnonzero(near[frontier].any(axis=0) & free)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def close_in_run(fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Places that connect what is close among ``fps``."""
    return stars(sum(np.bitwise_count(fps[:, None, w] ^ fps[None, :, w]).astype(np.int16) for w in range(fps.shape[1])) <= max_bits)


def _edges_in_sorted(key: np.ndarray, fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of close fingerprints with equal keys, in order of the keys."""
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    lengths = np.diff(np.r_[starts, len(key)])
    left, right = [], []
    for s, n in zip(starts[lengths > SHORT_RUN].tolist(), lengths[lengths > SHORT_RUN].tolist(), strict=True):
        a, b = close_in_run(fps[s : s + n], max_bits)
        left.append(a + s)
        right.append(b + s)
    place = np.flatnonzero(np.repeat((lengths > 1) & (lengths <= SHORT_RUN), lengths))
    key, fps = key[place], fps[place]
    for shift in range(1, min(SHORT_RUN, len(place))):
        same = np.flatnonzero(key[:-shift] == key[shift:])
        if not len(same):
            break
        hit = same[differing(fps[same], fps[same + shift]) <= max_bits]
        left.append(place[hit])
        right.append(place[hit + shift])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def spanning_stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The edges ``a``, ``b`` as one star around the smallest node of each component: as many edges as nodes at most."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = place[: len(a)], place[len(a) :]
    low = np.arange(len(nodes))
    while True:
        u, v = low[i], low[j]
        open_ = u != v
        if not open_.any():
            break
        i, j, u, v = i[open_], j[open_], u[open_], v[open_]
        np.minimum.at(low, np.maximum(u, v), np.minimum(u, v))
        while not np.array_equal(low, above := low[low]):
            low = above
    leaf = np.flatnonzero(low != np.arange(len(nodes)))
    return nodes[low[leaf]], nodes[leaf]


def blocks_for(count: int, max_bits: int, bits: int = 64) -> tuple[int, int]:
    """The fewest blocks, and how many of them agree, whose keys hold some hundred of ``count`` fingerprints by chance."""
    n = max_bits + 2
    while n < min(max_bits + 4, bits) and count / 2.0 ** (bits * (n - max_bits) / n) > 128:
        n += 1
    return n, n - max_bits


def close_edges(nodes: DataFrame, max_bits: int = 4, n_blocks: int = 6, agree: int = 2, chunk: int = CHUNK, keys: Callable[[np.ndarray], Iterator[np.ndarray]] | None = None) -> DataFrame:
    """Edges ``src``, ``dst`` that join any two of ``nodes`` (node, fp; each fp once) that meet under a key and differ in
    ``max_bits`` or fewer bits, directly or through others as close.  ``keys`` replaces the keys of the blocks.  A partition gives
    one star for what its keys join together, so fewer edges than it has nodes, however large a group is."""
    keys = keys or partial(block_keys, n_blocks=n_blocks, agree=agree)

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                for found in keys(_matrix(batch.column("fp"))):
                    yield pa.RecordBatch.from_arrays([pa.array(found), batch.column("h")], ["key", "h"])

    # a hash stands for a fingerprint until it is compared; two of one hash only meet more often
    hashed = nodes.select(F.xxhash64("fp").alias("h"), "node", "fp")
    keyed = written(hashed.select("h", "fp").mapInArrow(key, "key long, h long"), "keys")
    # written before the join, so that it deals the keys on their own and may split a hot one
    shared = cut(keyed.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1"))
    parts = F.ceil(F.col("size") / F.lit(chunk)).cast("int")
    dealt = (
        keyed.join(shared, "key")
        .select("key", "h", parts.alias("parts"))
        .withColumn("mine", F.pmod(F.xxhash64("h"), F.col("parts")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("h", F.when(F.col("parts") == 1, F.col("key")).otherwise(F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other"))).alias("task"))
        .join(hashed, "h")
        .select("node", "fp", "task")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        none = np.zeros(0, np.int64)
        joined, new_edges, waiting = (none, none), [], 0

        def take(tasks: np.ndarray, nodes: np.ndarray, fps: np.ndarray) -> None:
            nonlocal joined, new_edges, waiting
            a, b = spanning_stars(*(nodes[x] for x in _edges_in_sorted(tasks, fps, max_bits)))
            new_edges.append((a, b))
            waiting += len(a)
            if waiting > len(joined[0]) + 65536:  # the stars so far are looked at again only when their number may have doubled
                settle()

        def settle() -> None:
            nonlocal joined, new_edges, waiting
            joined = spanning_stars(*(np.concatenate(x) for x in zip(joined, *new_edges, strict=True)))
            new_edges, waiting = [], 0

        for batch in batches:
            if not batch.num_rows:
                continue
            new = batch.column("task").to_numpy(), batch.column("node").to_numpy(), _matrix(batch.column("fp"))
            tasks, nodes, fps = new if kept is None else (np.concatenate(x) for x in zip(kept, new, strict=True))
            last = int(np.searchsorted(tasks, tasks[-1]))  # the last run may go on in the next batch
            kept = tasks[last:], nodes[last:], fps[last:]
            if last:
                take(tasks[:last], nodes[:last], fps[:last])
        if kept is not None:
            take(*kept)
        settle()
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in joined], ["src", "dst"])

    return dealt.repartition("task").sortWithinPartitions("task").mapInArrow(run, "src long, dst long")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u8").reshape(len(column), -1)


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle_words: int = 4,
    max_bits: int = 4,
    words64: int = 1,
    n_blocks: int | None = None,
    agree: int = 2,
) -> DataFrame:
    """``id``, ``fp`` and ``component_id`` (smallest id reachable through close fingerprints, its own included) per row; other
    columns, whatever their names, are not looked at.  Without ``n_blocks`` the blocks follow from the number of fingerprints.
    Texts of any length are taken whole.

    Null or empty text: no bit set, linked like any other.  Repeated ids stay repeated rows; texts under one id count as
    linked.  A null id never becomes a component id unless every id of the component is null.  An empty table gives an
    empty result.
    """
    marked = cut(fingerprints(docs, id_col, text_col, shingle_words, words64))
    # a fingerprint's node is its smallest id; without any id a hash of its bits
    nodes = cut(marked.groupBy("fp").agg(F.min("id").alias("low")).withColumn("node", F.coalesce("low", F.xxhash64("fp"))))
    if n_blocks is None:
        n_blocks, agree = blocks_for(nodes.count(), max_bits, 64 * words64)
    linked = connected_components(close_edges(nodes, max_bits, n_blocks, agree))
    nodes = nodes.join(linked, "node", "left").withColumn("component", F.coalesce("component", "node"))
    lowest = nodes.groupBy("component").agg(F.min("low").alias("component_id"))
    return marked.join(nodes.join(lowest, "component").select("fp", "component_id"), "fp").select("id", "fp", "component_id")


def digests(shingles: list[bytes], seed: int) -> np.ndarray:
    """128 hashed bits of each shingle, as two 64-bit numbers."""
    digest = xxhash.xxh3_128_digest
    return np.frombuffer(b"".join([digest(x, seed) for x in shingles]), "<u8").reshape(-1, 2)


def shingle_set(shingles: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The different shingles by 64 hashed bits, ascending, and the place of each."""
    return np.unique(digests(shingles, SEED)[:, 0], return_index=True)


def set_bits(shingles: list[bytes], places: np.ndarray, words64: int) -> np.ndarray:
    """The fingerprint of a set of shingles, each counted once."""
    once = [shingles[i] for i in places.tolist()]
    n, words = len(once), []
    for seed in range(SEED, SEED + -(-words64 // 2)):
        ones = np.zeros(128, np.int64)
        for k in range(0, n, 32768):
            ones += np.unpackbits(digests(once[k : k + 32768], seed).view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        words.append(np.packbits(2 * ones > n, bitorder="little").view("<u8"))
    return np.concatenate(words)[:words64]


def similar_in(sets: list[np.ndarray], least: float) -> np.ndarray:
    """Square matrix of the pairs of sets whose Jaccard similarity is ``least`` or more; two empty sets are similar."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    owner = np.repeat(np.arange(len(sets)), sizes)
    values, code = np.unique(np.concatenate(sets), return_inverse=True)
    shared = np.bincount(code, minlength=len(values)) > 1
    rank = np.cumsum(shared) - 1
    keep = shared[code]
    owner, code = owner[keep], rank[code[keep]]
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    common = np.zeros((len(sets), len(sets)), np.float32)  # counts of far less than 2**24
    for a in range(0, int(shared.sum()), COLUMNS):
        i, j = np.searchsorted(code, [a, a + COLUMNS])
        has = np.zeros((len(sets), COLUMNS), np.float32)
        has[owner[i:j], code[i:j] - a] = 1
        common += has @ has.T
    np.fill_diagonal(common, sizes)
    union = sizes[:, None] + sizes[None, :] - common
    return (common / np.maximum(union, 1) >= least) | (union == 0)


def keys_for(count: int, least: float, bits: int, recall: float) -> tuple[int, int, int]:
    """Width and number of keys, and differing bits allowed, for ``count`` texts.

    Sets of similarity ``least`` differ in each bit with probability arccos(cosine) / pi, where the cosine is
    2 * least / (1 + least) for sets of one size and higher for others; their differing bits are taken as binomial.
    """
    p = math.acos(2 * least / (1 + least)) / math.pi
    most = min(bits, math.ceil(bits * p + 3.7 * math.sqrt(bits * p * (1 - p))))
    width = min(bits, max(LEAST_WIDTH, math.ceil(math.log2(max(count, 1) / PER_KEY))))
    chance = [math.exp(math.lgamma(bits + 1) - math.lgamma(d + 1) - math.lgamma(bits - d + 1) + d * math.log(p or 1e-300) + (bits - d) * math.log1p(-p)) for d in range(most + 1)]
    agree = [math.prod((bits - d - i) / (bits - i) for i in range(width)) for d in range(most + 1)]
    n = 1
    while n < 5000 and sum(c * (1 - (1 - a) ** n) for c, a in zip(chance, agree, strict=True)) < recall:
        n += 1 + n // 50
    return width, n, most


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, least: float = 0.8, words64: int = 4, recall: float = 0.98) -> DataFrame:
    """Per row: ``id``, ``h1`` and ``h2`` (a hash of the id and the text), ``component_id`` (smallest id reachable through
    documents whose shingle sets have a Jaccard similarity of ``least`` or more, its own included; null if none of them has an
    id), and ``kept``: whether the row is the first of its component by id (nulls last) and hash.

    Fingerprints close in bits only name candidates; a pair at ``least`` becomes one with probability ``recall`` (see
    ``keys_for``).  Within each group of candidates, pairs are compared by their shingle sets, except those that are linked
    through others already.  Null and empty texts count as equal; repeated rows are kept or not alike.  Texts of any length are
    compared whole.  An empty table gives an empty result.
    """
    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"), *row_hashes(id_col, text_col))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets, bits = [], []
            for text in batch.column("text").to_pylist():
                shingles = shingles_of(text or b"", shingle_words)
                values, places = shingle_set(shingles)
                sets.append(xxhash.xxh3_128_digest(values.tobytes()))
                bits.append(set_bits(shingles, places, words64).astype("<u8").tobytes())
            same, fps = pa.array(sets, pa.binary()), pa.array(bits, pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "h1", "h2", "size")), same, fps], ["id", "h1", "h2", "n", "same", "fp"])

    sized = narrow.withColumn("size", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    marked = cut(sized.mapInArrow(mark, "id long, h1 long, h2 long, n long, same binary, fp binary"))
    # as in near_duplicates, but a node has a set of shingles; a fingerprint is that of the set, whatever repeats
    nodes = marked.groupBy("same").agg(F.min("id").alias("low"), F.min("h1").alias("h1"), F.min("fp").alias("fp"), F.min("n").alias("n"))
    nodes = cut(nodes.withColumn("node", F.monotonically_increasing_id()))
    firsts = cut(nodes.groupBy("fp").agg(F.min("node").alias("first")))
    width, n_keys, most = keys_for(firsts.count(), least, 64 * words64, recall)
    close = close_edges(firsts.withColumnRenamed("first", "node"), most, keys=partial(drawn_keys, width=width, count=n_keys))
    candidates = connected_components(close.union(nodes.join(firsts, "fp").select("first", "node")))
    member = cut(nodes.join(candidates, "node").select("same", "node", "h1", "n", F.col("component").alias("group")))
    sizes = member.groupBy("group").agg(F.greatest(F.ceil(F.count("*") / F.lit(SETS)), F.ceil(F.sum("n") / F.lit(BYTES)), F.lit(1)).cast("int").alias("parts"), F.min("node").alias("pivot"))
    member = cut(member.join(cut(sizes), "group").withColumn("mine", F.pmod(F.xxhash64("same"), F.col("parts")).cast("int")))

    def with_texts(members: DataFrame) -> DataFrame:
        """The members with the text of each; a repeated row counts once."""
        return narrow.select("h1", "text").join(members, "h1").dropDuplicates(["h1"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in groups(batches, "task"):
            left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for a, b in runs(batch.column("task").to_numpy()):
                node, once = np.unique(batch.column("node").to_numpy()[a:b], return_index=True)
                if len(node) > 1:
                    texts = batch.column("text").take(pa.array(a + once)).to_pylist()
                    i, j = stars(similar_in([shingle_set(shingles_of(x or b"", shingle_words))[0] for x in texts], least))
                    left.append(node[i])
                    right.append(node[j])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (left, right)], ["src", "dst"])

    def compared(dealt: DataFrame) -> DataFrame:
        dealt = dealt.select("task", "node", "text")
        return cut(dealt.repartition("task").sortWithinPartitions("task").mapInArrow(compare, "src long, dst long"))

    # each part of a group with itself and with the group's first set
    own = F.array(F.col("mine"))
    to = F.when(F.col("node") == F.col("pivot"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(own)
    edges = compared(with_texts(member).withColumn("part", F.explode(to)).withColumn("task", F.xxhash64("group", "part")))
    # in groups of several parts: what is not linked with that set, with all others
    wide = member.filter("parts > 1")
    if wide.limit(1).count():
        reached = connected_components(edges)
        wide = wide.join(reached, "node", "left").withColumn("component", F.coalesce("component", "node"))
        core = cut(wide.filter("node = pivot").select("group", F.col("component").alias("core")))
        wide = cut(wide.join(core, "group").withColumn("apart", F.col("component") != F.col("core")))
        rest = wide.filter("apart").groupBy("group").agg(F.ceil(F.count("*") / F.lit(SETS)).cast("int").alias("a"), F.ceil(F.sum("n") / F.lit(BYTES)).cast("int").alias("b"))
        rest = cut(rest.select("group", F.greatest("a", "b").alias("rests")))
        wide = cut(wide.join(rest, "group").select("same", "node", "h1", "n", "group", "parts", "mine", "apart", "rests"))
        rest_part = F.pmod(F.xxhash64("same", F.lit(1)), F.col("rests")).cast("int")
        others = with_texts(wide).withColumn("pair", F.explode(F.sequence(F.lit(0), F.col("rests") - 1))).withColumn("part", F.col("mine"))
        own = with_texts(wide.filter("apart")).withColumn("pair", rest_part).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        names = ["task", "node", "text"]
        both = [x.withColumn("task", F.xxhash64("group", "pair", "part")).select(*names) for x in (others, own)]
        edges = edges.union(compared(both[0].union(both[1])))
    linked = connected_components(edges)
    nodes = nodes.join(linked, "node", "left").withColumn("component", F.coalesce("component", "node"))
    lowest = nodes.groupBy("component").agg(F.min("low").alias("component_id"))
    rows = marked.join(nodes.join(lowest, "component").select("same", "component", "component_id"), "same")
    order = F.struct(F.col("id").isNull().alias("nameless"), "id", "h1", "h2")
    first = cut(rows.groupBy("component").agg(F.min(order).alias("first")))
    return rows.join(first, "component").select("id", "h1", "h2", "component_id", (order == F.col("first")).alias("kept"))


def row_hashes(id_col: str, text_col: str) -> list:
    """``h1`` and ``h2``, which tell rows apart by id and text."""
    parts = [F.coalesce(F.col(id_col).cast("string"), F.lit("\x00")), F.lit("\x1f"), F.coalesce(F.col(text_col).cast("string"), F.lit(""))]
    return [F.xxhash64(F.lit(n), *parts).alias(f"h{n}") for n in (1, 2)]


def hex_of(fp: str = "fp"):
    """A 64-bit fingerprint as 16 hexadecimal digits, the highest bits first."""
    return F.lower(F.hex(F.concat(*[F.substring(F.col(fp), i, 1) for i in range(8, 0, -1)])))
