"""Embedding near-duplicates by NN-descent.

Equal vectors are one vertex.  A start graph comes from random-hyperplane blocks; then neighbours of a common vertex are
compared with each other (a join of the graph with its reverse) until few lists change.  The start graph takes as many trees as
pairs at the threshold need to meet in one, which grows with the bits of a block and so with the vectors.  An audit compares a
bounded sample of vertices with all vectors and takes the mean of their recalls, and starts further rounds where links are missing;
if that does not help, all vectors are compared in blocks.  Links at the threshold are
checked in double precision.  A vertex whose whole list lies above the threshold is saturated: its list is enlarged to all
of its component, read in blocks of vectors, so that links within clouds of near copies are counted in full without a row per
pair.  Every comparison also returns bridges, pairs that connect what it saw above the threshold, since a saturated list has
no room for a link to another cloud.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import connected_components, cut, groups, runs, written

#: Vectors of a start block, and of a block of a saturated component.
START_BLOCK, BLOCK = 512, 1024
#: Error of a cosine of half-precision vectors that the exact check allows for.
MARGIN = 0.004
#: Vertices with a link that an audit looks for, and the samples in which it does: each is one scan of all vectors.
AUDITED, SAMPLES = 400, (1024, 3072, 4096)
#: Bytes of sampled vectors that a scan holds at most.
SAMPLE_BYTES = 16 << 20
#: Candidates that a local join returns per member; near the threshold it returns as many as a list holds.
BEST = 4


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id``, ``v`` (array of doubles) of the rows that can link: an id, no null or non-finite component, not zero."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return rows.filter(F.col("id").isNotNull() & F.col("v").isNotNull() & F.coalesce(fine, F.lit(False)))


def _matrix(column: pa.Array, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


EDGES = "u long, v long, s float, bridge boolean"


def _edge_batch(u: list, v: list, s: list, bridge: list) -> pa.RecordBatch:
    u, v, s, bridge = (np.concatenate(x) if x else np.zeros(0) for x in (u, v, s, bridge))
    return pa.RecordBatch.from_arrays([pa.array(u.astype(np.int64)), pa.array(v.astype(np.int64)), pa.array(s.astype(np.float32)), pa.array(bridge.astype(bool))], ["u", "v", "s", "bridge"])


def tree(near: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries of the boolean matrix ``near`` that connect its components, and the component of each row."""
    part, left, right = np.full(len(near), -1), [], []
    for i in range(len(near)):
        if part[i] < 0:
            part[i], stack = i, [i]
            while stack:
                at = stack.pop()
                new = np.flatnonzero(near[at] & (part < 0))
                part[new] = i
                left += [at] * len(new)
                right += new.tolist()
                stack += new.tolist()
    return np.array(left, np.int64), np.array(right, np.int64), part


def bridges(near: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that connect all that is above the threshold: a tree of the sure ones, and those that half precision leaves
    open between different trees."""
    a, b, part = tree(near >= threshold + MARGIN)
    i, j = np.nonzero(np.triu(near >= threshold - MARGIN, 1))
    open_ = part[i] != part[j]
    return np.concatenate([a, i[open_]]), np.concatenate([b, j[open_]])


def _compare(key: str, best: int, k: int, threshold: float) -> Callable:
    """Compare the members of each group with each other; columns: key, id, half (vector), low (worst of its list).

    A member gets its ``best`` others, up to ``k`` near the threshold, and its part in the bridges, so the rows made stay in
    proportion to the members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in groups(batches, key):
            ids, low = batch.column("id").to_numpy(), batch.column("low").to_numpy()
            x = _matrix(batch.column("half"), "<f2").astype(np.float32)
            u, v, s, bridge = [], [], [], []
            for a, b in runs(batch.column(key).to_numpy()):
                if b - a < 2:
                    continue
                near = x[a:b] @ x[a:b].T
                np.fill_diagonal(near, -2)
                near[ids[a:b][:, None] == ids[a:b][None, :]] = -2
                most = min(k, b - a - 1)
                top = np.argpartition(-near, most - 1, axis=1)[:, :most]
                value = np.take_along_axis(near, top, axis=1)
                rank = np.argsort(np.argsort(-value, axis=1, kind="stable"), axis=1)
                wanted = ((rank < best) | (value >= threshold - MARGIN)) & (value > low[a:b][:, None]) & (value > -1.5)
                i, place = np.nonzero(wanted)
                j = top[i, place]
                u.append(ids[a:b][i])
                v.append(ids[a:b][j])
                s.append(near[i, j])
                bridge.append(np.zeros(len(i), bool))
                i, j = bridges(near, threshold)
                u.append(ids[a:b][i])
                v.append(ids[a:b][j])
                s.append(near[i, j])
                bridge.append(np.ones(len(i), bool))
            yield _edge_batch(u, v, s, bridge)

    return run


def best_lists(edges: DataFrame, k: int) -> DataFrame:
    """The ``k`` best different neighbours of each vertex."""
    once = edges.groupBy("u", "v").agg(F.max("s").alias("s"), F.max("old").alias("old"))
    rank = F.row_number().over(Window.partitionBy("u").orderBy(F.desc("s"), "v"))
    return once.withColumn("r", rank).filter(F.col("r") <= k).drop("r")


def trees_needed(count: int, threshold: float, recall: float) -> int:
    """Trees after which two vectors at the threshold share a start block in one with probability ``recall``."""
    share = (1 - math.acos(threshold) / math.pi) ** _bits(count)
    return 1 if share >= recall else math.ceil(math.log(1 - recall) / math.log(1 - share))


def _bits(count: int) -> int:
    return max(0, math.ceil(math.log2(max(count, 1) / START_BLOCK)))


def start_graph(points: DataFrame, count: int, dim: int, k: int, trees: int, seed: int, threshold: float) -> DataFrame:
    bits = _bits(count)
    planes = np.random.default_rng(seed).normal(size=(trees, bits, dim)).astype(np.float32)  # bounded: trees * bits * dim

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("half"), "<f2").astype(np.float32)
            for t in range(trees):
                side = (x @ planes[t].T > 0) @ (1 << np.arange(bits, dtype=np.int64)) if bits else np.zeros(len(x), np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("half"), pa.array((side * trees + t).astype(np.int64))], ["id", "half", "code"])

    coded = points.select("id", "half").mapInArrow(code, "id long, half binary, code long")
    sizes = coded.groupBy("code").agg(F.count("*").alias("size"))
    parts = F.ceil(F.col("size") / F.lit(4 * START_BLOCK))
    blocks = coded.join(sizes, "code").select(F.xxhash64("code", F.pmod(F.xxhash64("id", "code"), parts)).alias("block"), "id", "half", F.lit(-2.0).cast("float").alias("low"))
    return blocks.repartition("block").sortWithinPartitions("block").mapInArrow(_compare("block", k, k, threshold), EDGES)


def improve(graph: DataFrame, points: DataFrame, k: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """One round: neighbours of each vertex with a new neighbour are compared with each other.  The new graph, and bridges."""
    back = graph.select(F.col("v").alias("u"), F.col("u").alias("v"), "s", "old")
    rank = F.row_number().over(Window.partitionBy("u").orderBy(F.xxhash64("u", "v")))
    back = back.withColumn("r", rank).filter(F.col("r") <= k).drop("r")
    around = graph.select("u", "v", "old").union(back.select("u", "v", "old"))
    active = around.filter("not old").select("u").distinct()
    worst = graph.groupBy("u").agg(F.min("s").alias("low"), F.count("*").alias("n"))
    worst = worst.select(F.col("u").alias("id"), F.when(F.col("n") >= k, F.col("low")).otherwise(F.lit(-2.0)).cast("float").alias("low"))
    members = around.join(active, "u", "left_semi").select("u", F.col("v").alias("id")).distinct()
    members = members.join(points.select("id", "half").join(worst, "id"), "id")
    found = cut(members.repartition("u").sortWithinPartitions("u").mapInArrow(_compare("u", BEST, k, threshold), EDGES))
    return best_lists(graph.withColumn("old", F.lit(True)).unionByName(_listed(found)), k), _bridged(found)


def _listed(found: DataFrame) -> DataFrame:
    return found.filter("not bridge").select("u", "v", "s", F.lit(False).alias("old"))


def _bridged(found: DataFrame) -> DataFrame:
    return found.filter("bridge").select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct()


def exact_links(pairs: DataFrame, points: DataFrame, threshold: float) -> DataFrame:
    """The pairs ``a`` < ``b`` whose cosine in double precision reaches the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cosine = np.einsum("ij,ij->i", _matrix(batch.column("x"), "<f8"), _matrix(batch.column("y"), "<f8"))
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(cosine >= threshold))

    x = points.select(F.col("id").alias("a"), F.col("unit").alias("x"))
    y = points.select(F.col("id").alias("b"), F.col("unit").alias("y"))
    return pairs.join(x, "a").join(y, "b").mapInArrow(run, "a long, b long")


def audit(points: DataFrame, links: DataFrame, member: DataFrame, threshold: float, dim: int) -> tuple[float, int]:
    """Mean over sampled vertices of the share of their links that were found, and the number of vertices it rests on.

    A link inside one saturated component is counted whatever was found and tells nothing, so it is left out; vertices without
    another link say nothing either.  So a cloud's many links weigh no more than a pair's.  Vertices are drawn in the order of a
    hash of their ids, in a first sample and up to two larger ones, until ``AUDITED`` of them have a link or all are asked.  With m of
    them the mean is right within 1 / sqrt(m) at 95 %; where none of 8,192 has a link, at most one vertex in 2,700 has one.
    ``member`` has ``node``, ``component`` of the saturated components.
    """
    inside = points.select("id", "unit").join(member.select(F.col("node").alias("id"), "component"), "id", "left")
    order, last, n, total = inside.withColumn("h", F.xxhash64("id")), None, 0, 0.0
    for size in SAMPLES:
        rest = order if last is None else order.filter((F.col("h") > last.h) | ((F.col("h") == last.h) & (F.col("id") > last.id)))
        asked = rest.orderBy("h", "id").limit(min(size, SAMPLE_BYTES // (8 * max(dim, 1)))).collect()  # bounded by SAMPLE_BYTES
        if not asked:
            break
        seen = _audited(inside, links, threshold, asked)
        n, total, last = n + len(seen), total + sum(seen), asked[-1]
        if n >= AUDITED:
            break
    return (total / n if n else 1.0), n


def _audited(inside: DataFrame, links: DataFrame, threshold: float, asked: list) -> list[float]:
    """The recall of each vertex asked that has a link outside its saturated component."""
    ids = np.array([r.id for r in asked], np.int64)
    own_part = np.array([-1 - i if r.component is None else r.component for i, r in enumerate(asked)])
    alone = np.array([r.component is None for r in asked])
    q = np.frombuffer(b"".join(r.unit for r in asked), "<f8").reshape(len(asked), -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(at, 512) for at in range(0, batch.num_rows, 512)):
                own = part.column("id").to_numpy()
                component = part.column("component")
                there = component.is_valid().to_numpy(zero_copy_only=False)
                component = component.fill_null(0).to_numpy()
                i, j = np.nonzero(_matrix(part.column("unit"), "<f8") @ q.T >= threshold)
                keep = (own[i] != ids[j]) & (~there[i] | alone[j] | (component[i] != own_part[j]))
                i, j = i[keep], j[keep]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[j], np.minimum(own[i], ids[j]), np.maximum(own[i], ids[j]))], ["u", "a", "b"])

    true = inside.mapInArrow(run, "u long, a long, b long").join(links.withColumn("hit", F.lit(1.0)), ["a", "b"], "left")
    return [r.r for r in true.groupBy("u").agg(F.avg(F.coalesce("hit", F.lit(0.0))).alias("r")).collect()]  # a row an asked vertex


def complete(members: DataFrame, threshold: float) -> DataFrame:
    """``id``, ``n``: copies linked to each member within its component; ``members`` has component, size, id, unit, copies."""
    return _complete(members, threshold).groupBy("id").agg(F.sum("n").alias("n"))


def exact_tree(members: DataFrame, threshold: float) -> DataFrame:
    """``src``, ``dst``: links that connect the members of each component as all of their links do."""
    return _complete(members, threshold, trees=True)


def _complete(members: DataFrame, threshold: float, trees: bool = False) -> DataFrame:
    parts = F.ceil(F.col("size") / F.lit(BLOCK)).cast("int")
    dealt = (
        members.withColumn("parts", parts)
        .withColumn("mine", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("id", "unit", "copies", "mine", F.xxhash64("component", F.least("mine", "other"), F.greatest("mine", "other")).alias("task"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in groups(batches, "task"):
            ids, mine, copies = (batch.column(c).to_numpy() for c in ("id", "mine", "copies"))
            x = _matrix(batch.column("unit"), "<f8")
            total, left, right = np.zeros(len(ids), np.int64), [], []
            for a, b in runs(batch.column("task").to_numpy()):
                near = x[a:b] @ x[a:b].T >= threshold
                np.fill_diagonal(near, False)
                if trees:
                    i, j, _ = tree(near)
                    left.append(ids[a:b][i])
                    right.append(ids[a:b][j])
                    continue
                if mine[a:b].min() != mine[a:b].max():  # two blocks: each is compared with itself in a task of its own
                    near &= mine[a:b][:, None] != mine[a:b][None, :]
                total[a:b] = near @ copies[a:b]
            if trees:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (left, right)], ["src", "dst"])
            else:
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total)], ["id", "n"])

    return dealt.repartition("task").sortWithinPartitions("task").mapInArrow(run, "src long, dst long" if trees else "id long, n long")


def near_duplicates(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    threshold: float = 0.9,
    k: int = 10,
    trees: int | None = None,
    rounds: int = 6,
    least_recall: float = 0.95,
    seed: int = 7,
    attempts: int = 3,
) -> DataFrame:
    """``id``, ``n_links`` (other rows linked directly), ``component_id`` (smallest id reachable), ``kept``, and the ``audit_recall`` of
    the search with the ``audit_vertices`` it rests on (null where all was compared) per row.

    ``trees`` of a start graph: by default as many as give a pair at the threshold the chance ``least_recall`` to meet before any
    neighbour's neighbours are asked.  Where the audited recall stays below ``least_recall`` after ``attempts`` searches, all vectors are compared in blocks.
    Rows that cannot link (null id or vector, zero, null or non-finite components, another length than most) stand alone.
    Equal vectors link with each other.  Repeated ids are rows of their own.  An empty table gives an empty result.
    """
    fine = usable(vectors, id_col, vector_col)
    top = fine.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    dim = top.dim if top else 0
    digest = [F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2")]  # the seed of the second goes in first

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype("<f8")
            x = flat.reshape(batch.num_rows, dim)
            x = x / np.abs(x).max(axis=1, keepdims=True, initial=1e-300)
            x = x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
            rows = [pa.array([r.tobytes() for r in y], pa.binary()) for y in (x, x.astype("<f2"))]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("id", "copies", "h1", "h2")] + rows, ["id", "copies", "h1", "h2", "unit", "half"])

    same = fine.filter(F.size("v") == dim).select("id", "v", *digest)
    distinct = same.groupBy("h1", "h2").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.first("v").alias("v"))
    points = written(distinct.select("id", "copies", "h1", "h2", "v").mapInArrow(units, "id long, copies long, h1 long, h2 long, unit binary, half binary"), "points")
    count = points.count()

    trees = max(4, trees_needed(count, threshold, least_recall)) if trees is None else trees
    graph, across = None, points.select(F.col("id").alias("a"), F.col("id").alias("b")).limit(0)
    for attempt in range(attempts):
        found = cut(start_graph(points, count, dim, k, trees, seed + attempt, threshold))
        start, across = _listed(found), across.union(_bridged(found))
        graph = cut(best_lists(start if graph is None else start.unionByName(graph.withColumn("old", F.lit(True))), k))
        for _ in range(rounds):
            graph, met = improve(graph, points, k, threshold)
            graph, across = cut(graph), across.union(met)
            if graph.filter("not old").count() <= 0.02 * k * count:
                break
        close = graph.filter(F.col("s") >= threshold - MARGIN)
        pairs = close.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).union(across).distinct()
        links = cut(exact_links(pairs, points, threshold))
        components = cut(connected_components(links.select(F.col("a").alias("src"), F.col("b").alias("dst"))))
        full = close.groupBy("u").agg(F.count("*").alias("n")).filter(F.col("n") >= k).select(F.col("u").alias("node"))
        saturated = components.join(full, "node", "left_semi").select("component").distinct()
        # within a saturated component every link is counted below, so the audit leaves such links out
        member = components.join(saturated, "component")
        recall, asked = audit(points, links, member, threshold, dim)
        if recall >= least_recall:
            break

    if recall < least_recall:
        everything = points.select(F.lit(0).cast("long").alias("component"), F.lit(count).alias("size"), "id", "unit", "copies")
        components = cut(connected_components(exact_tree(everything, threshold)))
        linked, recall, asked = complete(everything, threshold), 1.0, None
    else:
        weight = points.select(F.col("id"), "copies")
        ends = links.select(F.col("a").alias("id"), F.col("b").alias("other")).union(links.select("b", "a"))
        plain = ends.join(components.join(saturated, "component", "left_anti").select(F.col("node").alias("id")), "id", "left_semi")
        plain = plain.join(weight.withColumnRenamed("id", "other"), "other").groupBy("id").agg(F.sum("copies").alias("n"))
        sizes = member.groupBy("component").agg(F.count("*").alias("size"))
        members = member.join(sizes, "component").withColumnRenamed("node", "id").join(points.select("id", "unit", "copies"), "id")
        linked = plain.union(complete(members, threshold))
    state = points.select("id", "copies", "h1", "h2").join(linked, "id", "left").join(components.withColumnRenamed("node", "id"), "id", "left")
    state = state.select("h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    able = F.coalesce((F.size("v") == dim) & F.col("id").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = rows.select("id", *[F.when(able, x).alias(n) for x, n in zip(digest, ("h1", "h2"), strict=True)])
    out = rows.join(state, ["h1", "h2"], "left")
    component = F.coalesce("component_id", "id")
    return out.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"), F.lit(recall).alias("audit_recall"), F.lit(asked).cast("long").alias("audit_vertices"))
