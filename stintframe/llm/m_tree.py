"""Exact search for the greatest inner products, by an M-tree of paged metric nodes.

Integer vectors get one more component that brings all to the same norm, queries a zero there; then the greatest inner product is
the least distance.  Vectors are dealt to regions around pivots, and each part of a region is bulk-loaded into a tree whose nodes
hold a routing object, the covering radius and the distance to the parent's routing object; a leaf page holds its vectors with
their distances to it.  The tree's nodes are rows of a Parquet table.  A query visits the region that can hold its best first,
which sets the score to beat, then every region that may still beat it.  Within a tree it goes best-first: nodes wait by the
least distance they may hold, and what the stored distances exclude by the triangle inequality is never compared.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, written
from .shards import read_manifest, write_manifest

#: Vectors of a tree, vectors of a leaf page, children of a node, queries of a task.
TREE, PAGE, FANOUT, QUERIES = 4096, 64, 16, 2048
#: Pivots at most; they are held by the driver and every task.
PIVOTS = 1024
#: Number kinds that a vector's components are stored in, and the greatest size that each holds exactly.
KINDS = (("<i2", 2**15 - 1), ("<f4", 2**24), ("<f8", float("inf")))
#: Share of the norm that rounding may put into a distance.
ROUNDING = 1e-6


def usable(vectors: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """``id``, ``v`` of the rows that take part: an id, and one or more components, all finite when scaled."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * scale) < float("inf"))) & (F.size("v") > 0)
    return rows.filter(F.col("id").isNotNull() & F.coalesce(fine, F.lit(False)))


def whole(v: Column, scale: float) -> Column:
    """floor(scale * x) of each component, as doubles."""
    return F.transform(v, lambda x: F.rint(x * scale) - F.when(F.rint(x * scale) > x * scale, 1.0).otherwise(0.0))


def matrix(column: pa.Array | pa.ChunkedArray, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1).astype(np.float64)


def digests() -> list[Column]:
    return [F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2")]


@dataclass
class Meta:
    """What every task knows: dimensions, how components are stored, greatest squared norm, ids kept of equal vectors, whether
    inner products are exact in doubles, and the scale of components."""

    dim: int
    kind: str
    bound: float
    copies: int
    exact: bool
    scale: float

    def packed(self, x: np.ndarray) -> pa.Array:
        return pa.array([r.tobytes() for r in x.astype(self.kind)], pa.binary())

    def lifted(self, x: np.ndarray) -> np.ndarray:
        """The vectors with the component that brings them to the common norm."""
        rest = np.maximum(self.bound - np.einsum("ij,ij->i", x, x), 0)
        return np.column_stack([x, np.sqrt(rest)])

    def between(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Distances of lifted vectors."""
        return np.sqrt(np.maximum(2 * self.bound - 2 * (x @ y.T), 0))

    def scores(self, x: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Inner products as longs; beyond doubles in whole numbers, held within 2^63 - 1 to both sides."""
        if self.exact:
            return (x @ q).astype(np.int64)
        whole_q = [int(c) for c in q]
        return np.array([min(max(sum(int(a) * b for a, b in zip(r, whole_q, strict=True)), 1 - 2**63), 2**63 - 1) for r in x], np.int64)


def load(x: np.ndarray, meta: Meta, seed: int) -> list[tuple]:
    """Nodes of a tree over lifted vectors, the root first: parent, route (a row of ``x``), radius, distance to the parent's
    route, and in a leaf its members and their distances to the route."""
    rng = np.random.default_rng(seed)
    nodes: list[tuple] = []
    middle = int(np.argmin(meta.between(x, x.mean(0)[None, :])[:, 0])) if len(x) > 1 else 0
    waiting = [(np.arange(len(x)), -1, middle)]
    while waiting:
        members, parent, route = waiting.pop()
        away = meta.between(x[members], x[[route]])[:, 0]
        up = 0.0 if parent < 0 else float(meta.between(x[[route]], x[[nodes[parent][1]]])[0, 0])
        leaf = len(members) <= PAGE
        nodes.append((parent, route, float(away.max()), up, members if leaf else None, away if leaf else None))
        if leaf:
            continue
        routes = rng.choice(members, min(FANOUT, -(-len(members) // PAGE)), replace=False)
        nearest = meta.between(x[members], x[routes]).argmin(1)
        if (nearest == nearest[0]).all():  # nothing tells them apart: cut evenly
            nearest = np.arange(len(members)) * len(routes) // len(members)
        for i, r in enumerate(routes.tolist()):
            own = members[nearest == i]
            if len(own):
                waiting.append((own, len(nodes) - 1, r))
    return nodes


NODE = "node int, parent int, radius double, up double, route binary, ids binary, entries binary, away binary"


class Tree:
    """A tree read from its node rows."""

    def __init__(self, rows: pa.Table, meta: Meta):
        rows = rows.sort_by("node")
        self.meta, self.compared = meta, 0
        self.radius, self.up = rows["radius"].to_numpy(), rows["up"].to_numpy()
        self.routes = matrix(rows["route"], "<f8")
        parent = rows["parent"].to_numpy()
        order = np.argsort(parent, kind="stable")
        ends = np.searchsorted(parent[order], np.arange(len(parent) + 1))
        self.children = [order[ends[i] : ends[i + 1]] for i in range(len(parent))]
        self.leaves = {
            i: (np.frombuffer(ids, "<i8"), np.frombuffer(x, meta.kind).reshape(-1, meta.dim).astype(np.float64), np.frombuffer(away, "<f8"))
            for i, (ids, x, away) in enumerate(zip(*(rows[c].to_pylist() for c in ("ids", "entries", "away")), strict=True))
            if ids is not None
        }

    def search(self, q: np.ndarray, own: int, k: int, least: float | None, far: float) -> list[tuple[int, int]]:
        """The ``k`` best ``(-score, id)`` other than id ``own`` that score ``least`` or more; ``far`` is the query's distance to what
        the root's parent distance refers to."""
        meta, found = self.meta, []
        total = q @ q + meta.bound
        slack, rounding = 0.25 + 1e-9 * total, ROUNDING * np.sqrt(total)
        least = -np.inf if least is None else least

        def reach() -> float:
            """Beyond this distance nothing scores ``least``."""
            return np.inf if least == -np.inf else np.sqrt(max(total - 2 * (least - slack), 0)) + rounding

        most = reach()
        if abs(far - self.up[0]) - self.radius[0] > most:
            return found
        d = np.sqrt(max(total - 2 * (self.routes[0] @ q), 0))
        self.compared += 1
        heap = [(d - self.radius[0], 0, d)]
        while heap:
            low, node, d = heapq.heappop(heap)
            if low > most:
                break
            if node in self.leaves:
                ids, x, away = self.leaves[node]
                at = np.flatnonzero((np.abs(d - away) <= most) & (ids != own))
                self.compared += len(at)
                score = meta.scores(x[at], q)
                fine = np.flatnonzero(score >= least)
                if len(fine):
                    found = heapq.nsmallest(k, found + [*zip((-score[fine]).tolist(), ids[at[fine]].tolist(), strict=True)])
                    if len(found) == k and -found[-1][0] > least:
                        least = -found[-1][0]
                        most = reach()
                continue
            inner = self.children[node]
            inner = inner[np.abs(d - self.up[inner]) - self.radius[inner] <= most]
            self.compared += len(inner)
            away = np.sqrt(np.maximum(total - 2 * (self.routes[inner] @ q), 0))
            for i, e in zip(inner.tolist(), away.tolist(), strict=True):
                if e - self.radius[i] <= most:
                    heapq.heappush(heap, (e - self.radius[i], i, e))
        return found


def build_index(vectors: DataFrame, path: str, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, scale: float = 256.0, tree: int = TREE, pivots: int = PIVOTS) -> None:
    """Write the index of ``floor(scale * x)`` of all vectors to ``path``: ``nodes``, ``regions`` and a manifest.

    Rows without an id, null and empty vectors and such with null or non-finite components (also once scaled) take no part, nor do
    those of another length than most.  Zero vectors do.  Repeated rows of an id and vector count once.  Of equal vectors the
    ``k + 1`` smallest ids are kept, since a query never returns more of them; so a vector that very many rows share is as small as
    any.  An empty table gives an index without regions.
    """
    spark = vectors.sparkSession
    fine = usable(vectors, id_col, vector_col, scale).select("id", whole(F.col("v"), scale).alias("v"))
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    sizes = fine.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"), F.max(F.array_max(F.transform("v", F.abs))).alias("most"), F.max(square).alias("bound"))
    top = sizes.orderBy(F.desc("n"), "dim").first()
    if top is None:
        write_manifest(path, {"dim": 0, "regions": 0, "trees": 0})
        return
    kind = next(name for name, most in KINDS if top.most <= most)
    meta = Meta(top.dim, kind, top.bound, k + 1, top.dim * top.most**2 < 2**53, scale)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, meta.dim)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("h1"), batch.column("h2"), meta.packed(x)], ["id", "h1", "h2", "x"])

    packed = fine.filter(F.size("v") == meta.dim).select("id", "v", *digests()).mapInArrow(pack, "id long, h1 long, h2 long, x binary")
    once = packed.groupBy("h1", "h2", "id").agg(F.first("x").alias("x"))
    number = F.row_number().over(Window.partitionBy("h1", "h2").orderBy("id"))  # limited before the shuffle too
    points = written(once.withColumn("r", number).filter(F.col("r") <= meta.copies).select("id", "x"), "points")
    count = points.count()
    asked = min(pivots, max(1, count // tree))
    chosen = points.orderBy(F.xxhash64("id", "x"), "id").limit(asked).select("x").collect()
    centres = meta.lifted(matrix(pa.array([r.x for r in chosen], pa.binary()), kind))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                away = meta.between(meta.lifted(matrix(batch.column("x"), kind)), centres)
                near = away.argmin(1)
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("x"), pa.array(near.astype(np.int32)), pa.array(away[np.arange(len(near)), near])], ["id", "x", "region", "far"])

    assigned = written(points.mapInArrow(assign, "id long, x binary, region int, far double"), "regions")
    regions = cut(assigned.groupBy("region").agg(F.ceil(F.count("*") / tree).cast("int").alias("parts"), F.max("far").alias("radius")))

    def grow(key: tuple, rows: pa.Table) -> pa.Table:
        region, part = (x.as_py() for x in key)
        rows = rows.sort_by("id")
        ids, x = rows["id"].to_numpy(), matrix(rows["x"], kind)
        lifted = meta.lifted(x)
        nodes = load(lifted, meta, 1000 * region + part)
        up = [n[3] for n in nodes]
        up[0] = float(meta.between(lifted[[nodes[0][1]]], centres[[region]])[0, 0])
        binary = lambda a: a if a is None else a.tobytes()
        columns = [
            pa.array([region] * len(nodes), pa.int32()),
            pa.array([part] * len(nodes), pa.int32()),
            pa.array(range(len(nodes)), pa.int32()),
            pa.array([n[0] for n in nodes], pa.int32()),
            pa.array([n[2] for n in nodes], pa.float64()),
            pa.array(up, pa.float64()),
            pa.array([x[n[1]].tobytes() for n in nodes], pa.binary()),
            pa.array([n[4] if n[4] is None else ids[n[4]].astype("<i8").tobytes() for n in nodes], pa.binary()),
            pa.array([n[4] if n[4] is None else x[n[4]].astype(kind).tobytes() for n in nodes], pa.binary()),
            pa.array([binary(n[5]) for n in nodes], pa.binary()),
        ]
        return pa.Table.from_arrays(columns, ["region", "part", *[f.split()[0] for f in NODE.split(", ")]])

    dealt = assigned.join(F.broadcast(regions.select("region", "parts")), "region")  # a row a pivot
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("id", "x"), F.col("parts")).cast("int"))
    dealt.groupBy("region", "part").applyInArrow(grow, f"region int, part int, {NODE}").write.parquet(f"{path}/nodes")
    held = {r.region: (r.parts, r.radius) for r in regions.collect()}  # a row a pivot
    rows = [(i, held[i][0], held[i][1], centres[i, :-1].astype("<f8").tobytes()) for i in sorted(held)]
    spark.createDataFrame(rows, "region int, parts int, radius double, pivot binary").coalesce(1).write.parquet(f"{path}/regions")
    write_manifest(path, vars(meta) | {"regions": len(rows)})


def search(queries: DataFrame, path: str, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``id``, ``score``: each query's ``k`` greatest inner products, ties to the smaller id.

    Vectors under the query's own id are no candidates.  Queries take part as vectors do in ``build_index``; repeated rows of an id
    and vector are one query.  With fewer candidates than ``k`` all are returned.
    """
    spark = queries.sparkSession
    found = read_manifest(path)
    result = "query_id long, rank int, id long, score long"
    if not found["regions"]:
        return spark.createDataFrame([], result)
    meta = Meta(**{f: found[f] for f in Meta.__dataclass_fields__})
    if k >= meta.copies:
        raise ValueError(f"the index keeps {meta.copies} ids of equal vectors, enough for k up to {meta.copies - 1}")
    nodes = spark.read.parquet(f"{path}/nodes")
    regions = spark.read.parquet(f"{path}/regions").orderBy("region").collect()  # PIVOTS at most
    numbers, radius = np.array([r.region for r in regions], np.int32), np.array([r.radius for r in regions])
    parts = {r.region: r.parts for r in regions}
    pivots = np.frombuffer(b"".join(r.pivot for r in regions), "<f8").reshape(len(regions), meta.dim)

    mine = usable(queries, id_col, vector_col, meta.scale).select("id", whole(F.col("v"), meta.scale).alias("v")).filter(F.size("v") == meta.dim)
    mine = mine.select("id", "v", *digests()).groupBy("h1", "h2", "id").agg(F.first("v").alias("v"))

    def far(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances' constant part, and distances to the pivots."""
        total = np.einsum("ij,ij->i", x, x) + meta.bound
        return total, np.sqrt(np.maximum(total[:, None] - 2 * (x @ pivots.T), 0))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(at, 1024) for at in range(0, batch.num_rows, 1024)):
                x = part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, meta.dim)
                away = far(x)[1]
                best = np.lexsort((away, np.maximum(away - radius, 0)), axis=1)[:, 0]
                columns = [part.column("id"), pa.array([r.tobytes() for r in x.astype("<f8")], pa.binary()), pa.array(best.astype(np.int32)), pa.array(away[np.arange(len(x)), best])]
                yield pa.RecordBatch.from_arrays(columns, ["own", "x", "best", "far"])

    # written once, so that the first region of a query is the same wherever it is asked for
    asked = mine.mapInArrow(nearest, "own long, x binary, best int, far double").select(F.monotonically_increasing_id().alias("q"), "*")
    asked = written(asked, "queries")

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Queries with each region, but for their first, that may hold what scores ``least``."""
        for batch in batches:
            for part in (batch.slice(at, 1024) for at in range(0, batch.num_rows, 1024)):
                total, away = far(matrix(part.column("x"), "<f8"))
                least = part.column("least").to_numpy(zero_copy_only=False).astype(np.float64)  # null: nan
                reach = np.sqrt(np.maximum(total - 2 * (least - 0.25 - 1e-9 * total), 0)) + ROUNDING * np.sqrt(total)
                able = ~(away - radius > reach[:, None])
                able[np.arange(len(away)), part.column("best").to_numpy()] = False
                i, j = np.nonzero(able)
                columns = [*(part.column(c).take(pa.array(i)) for c in ("q", "own", "x", "least")), pa.array(numbers[j]), pa.array(away[i, j])]
                yield pa.RecordBatch.from_arrays(columns, ["q", "own", "x", "least", "region", "far"])

    def visit(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            tree = Tree(left, meta)
            x = matrix(right["x"], "<f8")
            for i, (q, own, least, far) in enumerate(zip(*(right[c].to_pylist() for c in ("q", "own", "least", "far")), strict=True)):
                out += [(q, -negative, found) for negative, found in tree.search(x[i], own, k, least, far)]
        return pa.table({n: pa.array([r[c] for r in out], pa.int64()) for c, n in enumerate(("q", "score", "id"))}).select(["q", "id", "score"])

    def visited(pairs: DataFrame) -> DataFrame:
        """Best of each query in each tree; a tree that many queries visit is read by several tasks."""
        pairs = written(pairs, "visits")
        load = {r.region: r.n for r in pairs.groupBy("region").agg(F.count("*").alias("n")).collect()}  # a row a pivot
        plan = spark.createDataFrame([(r, parts[r], -(-n // QUERIES)) for r, n in load.items()], "region int, parts int, chunks int")
        keys = ["region", "part", "chunk"]
        plan = F.broadcast(plan)  # a row a pivot
        going = pairs.join(plan, "region").withColumn("chunk", F.pmod(F.xxhash64("q"), F.col("chunks")).cast("int"))
        going = going.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        trees = nodes.join(plan, "region").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        trees = trees.select(*keys, *[f.split()[0] for f in NODE.split(", ")])
        going = going.select(*keys, "q", "own", "least", "far", "x")
        hits = trees.groupBy(*keys).cogroup(going.groupBy(*keys)).applyInArrow(visit, "q long, id long, score long")
        return cut(hits)

    shape = "q long, own long, x binary, least double, region int, far double"
    region = F.element_at(F.array(*map(F.lit, numbers.tolist())), F.col("best") + 1)
    near = visited(asked.select("q", "own", "x", F.lit(None).cast("double").alias("least"), region.alias("region"), "far"))
    order = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    least = near.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k).groupBy("q").agg(F.when(F.count("*") == k, F.min("score")).cast("double").alias("least"))
    rest = visited(asked.join(least, "q", "left").mapInArrow(others, shape)) if len(regions) > 1 else near.limit(0)
    best = near.union(rest).withColumn("rank", F.row_number().over(order).cast("int")).filter(F.col("rank") <= k)
    return best.join(asked.select("q", F.col("own").alias("query_id")), "q").select("query_id", "rank", "id", "score")

