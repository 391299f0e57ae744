"""Run detection, the filter audit and exact search against plain versions."""

import hashlib
import re
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from stintframe.llm import filter_audit, m_tree, periodic_runs
from stintframe.llm import queries as llm_queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# 12
def plain_runs(w, least=6, power=4):
    found = {}
    for q in range(1, len(w) // power + 1):
        i = 0
        while i + q < len(w):
            start = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i + q - start >= max(least, power * q):
                found.setdefault((start, i + q - start), q)
            i += i == start
    return sorted((s, length, q) for (s, length), q in found.items())


def test_runs_of_many_small_sequences():
    rng = np.random.default_rng(3)
    for _ in range(400):
        n = int(rng.integers(0, 130))
        w = rng.integers(0, rng.integers(1, 5), n)
        if n and rng.random() < 0.6:
            a, p = int(rng.integers(0, n)), 1 + int(rng.integers(0, max(1, n // 3)))
            w[a:] = w[a + np.arange(n - a) % p]
        for power in (2, 4):
            assert [*map(tuple, periodic_runs.find_runs(w, 6, power).tolist())] == plain_runs(w.tolist(), 6, power)


def test_extensions_beyond_the_cover():
    rng = np.random.default_rng(4)
    w = rng.integers(0, 2, 700)
    w[350:] = w[:350]
    w[100:180] = 1
    i = rng.integers(0, 690, 400)
    j = np.minimum(700, i + rng.choice([1, 2, 13, 26, 350], 400))

    def plain(a, b):
        k = 0
        while b + k < 700 and w[a + k] == w[b + k]:
            k += 1
        return k

    assert periodic_runs.Extensions(w)(i, j).tolist() == [plain(*x) for x in zip(i, j, strict=True)]


def plain_digest(doc_id, text):
    w = WORD.findall(text or "")
    if doc_id is not None:
        h = zlib.crc32(str(doc_id).encode())
        g, n = h // 10, len(w)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    runs = plain_runs(w)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else (None, None, None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    exponent = 1000 * best[1] // best[2] if runs else None
    return (doc_id, len(runs), *best, exponent, sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_periodic_runs_query_matches_the_plain_version(spark, sample, tmp_path):
    docs = sample.select("doc_id", "text")
    more = [(5000 + i, t) for i, t in enumerate([None, "", " \t\n", "a", "a " * 6, "a " * 5, "x y " * 9, "日本 語 " * 30, "a b " * 4 + "b " * 7, "w " * 20000])] + [(None, "to be " * 40), (5004, "a " * 6)]
    docs.unionByName(spark.createDataFrame(more, "doc_id long, text string")).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    got = llm_queries.op12_periodic_runs(spark, str(tmp_path)).collect()
    assert Counter(map(tuple, got)) == Counter(plain_digest(r.doc_id, r.text) for r in docs.collect())
    assert sum(r.n_runs > 0 for r in got) > 15


def test_collapse_keeps_other_columns_and_handles_odd_rows(spark, odd):
    given = odd.withColumn("runs", F.lit("mine")).withColumn("collapsed", F.lit(1))
    got = periodic_runs.collapse_runs(given)
    assert got.columns == [*odd.columns, "n_words", "runs", "collapsed"]
    rows = got.collect()
    assert len(rows) == odd.count()
    for r in rows:
        assert r.n_words == len(WORD.findall(r.text or "")) and r.collapsed is not None
        assert r.text is not None or (r.runs == [] and r.collapsed == "")
    assert [r.collapsed for r in rows if (r.text or "").startswith("one two three")] == ["one two three four five six seven"]
    assert periodic_runs.collapse_runs(odd.limit(0)).collect() == []


# 13
def plain_audit(docs, labels):
    firsts, good, toxic = {}, set(), set()
    for i, t, _ in docs:
        if i is not None:
            firsts[t or ""] = min(i, firsts.get(t or "", i))
    for i, q, x in labels:
        good |= {i} if q == 1 and i is not None else set()
        toxic |= {i} if x == 1 and i is not None else set()
    rows = []
    for i, t, lang in docs:
        t = t or ""
        w = WORD.findall(t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > firsts[t]}
        rows.append((lang or "", {k for k, v in fails.items() if v}, i in good, i in toxic))
    out = []
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        shapley = Counter()
        steps = []
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                removed = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                shapley[f] += len(removed)
                steps.append(("".join(order), step, f, len(left), len(removed), sum(f in r[1] for r in mine) - len(removed) - sum(f in r[1] for r in left), sum(r[1] == {f} for r in mine), sum(r[2] for r in removed), sum(r[3] for r in removed)))
        out += [(part, o, s, *rest, shapley[f]) for o, s, f, *rest in steps]
    return out


def test_filter_audit_matches_every_order_applied_in_turn(spark, sample):
    docs = [tuple(r) for r in sample.select("doc_id", "text", "lang").collect()]
    docs += [(None, docs[0][1], "en"), (None, None, None), (9001, None, None), (9002, "", ""), (9003, "A $", "xx"), (9003, "A $", "xx"), (docs[3][0], "other text", "en"), (9004, docs[5][1], docs[5][2])]
    labels = [(r.doc_id, r.quality, r.toxic) for r in spark.read.parquet("/root/testdata/sf0.001/labels.parquet").collect()] + [(9001, 1, 1), (9001, 0, 0), (9003, None, 1), (None, 1, 1)]
    table = spark.createDataFrame([(*d, "part", 1) for d in docs], "doc_id long, text string, lang string, part string, digest int")
    got = filter_audit.audit_documents(table, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    columns = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(plain_audit(docs, labels))
    empty = filter_audit.audit_documents(table.limit(0), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert empty.collect() == []


def test_lattice_counts_orders_under_precedence(spark):
    names = "abcd"
    edges = filter_audit.lattice(names, [("a", "c"), ("b", "d")])
    want = ["".join(o) for o in permutations(names) if o.index("a") < o.index("c") and o.index("b") < o.index("d")]
    walks = filter_audit.orders(names, edges)
    assert sorted({o for o, *_ in walks}) == sorted(want)
    through = Counter((s, f) for _, _, s, f in walks)
    assert {(s, f): reach * leave for s, f, reach, leave in edges} == dict(through)
    rows = spark.createDataFrame([(True, None, False, True, "x"), (False, True, True, False, "x")], "a boolean, b boolean, c boolean, d boolean, p string")
    got = filter_audit.audit_orders(rows, names, "p", {}, [("a", "c"), ("b", "d")]).collect()
    assert len(got) == 4 * len(want) and {r.n_orders for r in got} == {len(want)}
    with pytest.raises(ValueError):
        filter_audit.lattice("aa")


# 11
def plain_search(rows, dim, k, every, scale=256):
    able = {(i, tuple(int(np.floor(scale * c)) for c in v)) for i, v in rows if i is not None and v is not None and len(v) == dim and all(c is not None and np.isfinite(c) and np.isfinite(scale * c) for c in v)}
    out = []
    for i, q in able:
        if i % every == 0:
            scored = sorted((-max(min(sum(a * b for a, b in zip(q, v, strict=True)), 2**63 - 1), 1 - 2**63), j) for j, v in able if j != i)
            out += [(i, rank, j, -s) for rank, (s, j) in enumerate(scored[:k], 1)]
    return sorted(out)


def searched(spark, tmp_path, rows, k=5, every=5, **sizes):
    vectors = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, region string, rank int")
    m_tree.build_index(vectors, f"{tmp_path}/index", k=k, **sizes)
    return vectors, sorted(map(tuple, m_tree.search(vectors.filter(f"vec_id % {every} = 0"), f"{tmp_path}/index", k=k).collect()))


def test_search_matches_every_query_against_every_vector(spark, tmp_path):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(700, 8)) + 3 * rng.integers(0, 3, (700, 1))
    x[100:400] = x[100]  # a vector that a large part of the rows share
    x[400:430] = np.round(x[400:430])
    x[450] = 0
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(None, [1.0] * 8), (800, None), (805, [float("nan")] + [1.0] * 7), (810, [None] + [1.0] * 7), (815, [1.0]), (820, []), (825, [1e308] * 8), rows[3], rows[5], (5, [9.0] * 8)]
    _, got = searched(spark, tmp_path, rows, tree=48, pivots=6)
    assert got == plain_search(rows, 8, 5, 5)
    nodes = spark.read.parquet(f"{tmp_path}/index/nodes")
    assert nodes.select("region").distinct().count() > 2 and nodes.select(F.sum(F.length("ids") / 8)).first()[0] < 450


@pytest.mark.parametrize("size", [1e6, 1e12])
def test_search_of_large_components_is_exact(spark, tmp_path, size):
    rng = np.random.default_rng(6)
    rows = [(i, (size * rng.normal(size=4)).tolist()) for i in range(120)]
    _, got = searched(spark, tmp_path, rows, k=3, tree=40, pivots=3)
    assert got == plain_search(rows, 4, 3, 5)


def test_search_of_few_or_no_vectors(spark, tmp_path):
    rows = [(0, [0.5, 0.5]), (5, [1.0, -1.0]), (7, [1.0, 1.0])]
    vectors, got = searched(spark, tmp_path / "few", rows)
    assert got == plain_search(rows, 2, 5, 5) and len(got) == 4
    with pytest.raises(ValueError):
        m_tree.search(vectors, f"{tmp_path}/few/index", k=6)
    assert searched(spark, tmp_path / "none", [(1, None)])[1] == []


def test_stored_distances_spare_comparisons():
    rng = np.random.default_rng(7)
    x = np.floor(256 * (rng.normal(size=(40, 1, 6)) * 4 + 0.1 * rng.normal(size=(40, 100, 6)))).reshape(-1, 6)
    meta = m_tree.Meta(6, "<f8", float((x * x).sum(1).max()), 6, True, 256.0)
    lifted = meta.lifted(x)
    nodes = m_tree.load(lifted, meta, 1)
    held = np.concatenate([n[4] for n in nodes if n[4] is not None])
    assert sorted(held.tolist()) == list(range(4000)) and max(len(n[4]) for n in nodes if n[4] is not None) <= m_tree.PAGE
    for parent, route, radius, up, members, away in nodes:
        assert parent < 0 or up == pytest.approx(meta.between(lifted[[route]], lifted[[nodes[parent][1]]])[0, 0])
        assert members is None or away.max() <= radius + 1e-9
    import pyarrow as pa

    columns = {"node": range(len(nodes)), "parent": [n[0] for n in nodes], "radius": [n[2] for n in nodes], "up": [n[3] for n in nodes], "route": [x[n[1]].tobytes() for n in nodes]}
    columns |= {"ids": [n[4] if n[4] is None else n[4].astype("<i8").tobytes() for n in nodes], "entries": [n[4] if n[4] is None else x[n[4]].tobytes() for n in nodes], "away": [n[5] if n[5] is None else n[5].tobytes() for n in nodes]}
    tree = m_tree.Tree(pa.table({c: pa.array(list(v)) for c, v in columns.items()}), meta)
    for i in range(0, 4000, 100):
        far = np.sqrt(max(x[i] @ x[i] + meta.bound - 2 * x[nodes[0][1]] @ x[i], 0))
        got = tree.search(x[i], i, 5, None, far)
        score = x @ x[i]
        assert got == sorted((-int(s), j) for j, s in enumerate(score) if j != i)[:5]
    assert tree.compared < 0.5 * 40 * 4000


# 2
@pytest.mark.parametrize("fill, dim, cosine", [(18_000, 64, 0.905), (40_000, 256, 0.902)])
def test_sparse_links_beside_a_cloud_are_found_and_audited(spark, tmp_path, fill, dim, cosine):
    import pyarrow as pa
    import pyarrow.parquet as pq

    from stintframe.llm import nn_descent

    rng = np.random.default_rng(0)
    cloud = rng.normal(size=dim) + 0.02 * rng.normal(size=(600, dim))
    a, o = rng.normal(size=(6000, dim)), rng.normal(size=(6000, dim))
    a /= np.linalg.norm(a, axis=1)[:, None]
    o -= (o * a).sum(1)[:, None] * a
    o /= np.linalg.norm(o, axis=1)[:, None]
    x = np.vstack([cloud, a, cosine * a + np.sqrt(1 - cosine**2) * o, rng.normal(size=(fill, dim))])
    pq.write_table(pa.table({"vec_id": np.arange(len(x)), "embedding": list(x)}), f"{tmp_path}/e.parquet", row_group_size=8000)
    got = nn_descent.near_duplicates(spark.read.parquet(f"{tmp_path}/e.parquet"))
    links = dict(got.select("id", "n_links").collect())
    recall = sum(links[i] for i in range(600, len(x))) / 12_000
    audited = got.first()
    assert recall >= 0.95 and abs(audited.audit_recall - recall) <= 0.02 and audited.audit_vertices >= 400
    assert all(links[i] == 599 for i in range(600))
