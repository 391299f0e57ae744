"""Operators against plain versions on small tables."""

import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stintframe.llm import id_store, nn_descent, packing, quality, quotes, segment_sampling, simhash, token_counts, toxicity, warc
from stintframe.llm.common import connected_components
from stintframe.llm.mphf import PerfectHash
from stintframe.llm.pieces import MARK, pieces


def components(n, linked):
    root = list(range(n))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(n)]


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {i: 0 for i in range(41)} | {k: 100 for k in range(100, 160)}


# 1
def test_token_counts_match_greedy_longest_match(odd, sample, tokenizer):
    path = tokenizer("piece_bpe_32k.model")
    known = set(pieces(path).ids)

    def greedy(word):
        n = i = 0
        while i < len(word):
            j = next((j for j in range(min(len(word), i + 24), i, -1) if word[i:j] in known), None)
            n, i = (n + 1, j) if j else (n + len(word[i].encode()), i + 1)
        return n

    for docs in (odd, sample):
        want = Counter((r.doc_id, len(r.text.split(" ")), greedy(MARK + r.text.replace(" ", MARK))) if r.text else (r.doc_id, 0, 0) for r in docs.collect())
        assert Counter(map(tuple, token_counts.count_tokens(docs, path).collect())) == want


# 2
def test_nn_descent_finds_links_of_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 16))
    x[100:180] = x[0] + 0.05 * rng.normal(size=(80, 16))
    x[200:240:2] = x[201:240:2] + 0.1 * rng.normal(size=(20, 16))
    x[300:310] = x[299]
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x.astype(np.float32))]
    bad = [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] + [1.0] * 15), (1003, [None] + [1.0] * 15), (1004, [1.0])]
    got = {r.id: r for r in nn_descent.near_duplicates(spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>")).collect()}
    unit = np.array([v for _, v in rows])
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    near = unit @ unit.T >= 0.9
    found = sum(got[i].n_links for i in range(600))
    assert 0.95 <= found / (near.sum() - 600) <= 1
    assert all(got[i].n_links <= near[i].sum() - 1 for i in range(600))
    want = components(600, lambda i, j: near[i, j])
    assert np.mean([got[i].component_id == want[i] for i in range(600)]) > 0.98
    assert all((got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True) for i, _ in bad)


# 3
def test_packing_fills_sequences_and_keeps_every_id(odd, sample, tokenizer):
    path = tokenizer("byte_bpe_50k.json")
    full = Tokenizer.from_file(path)
    for docs in (odd, sample):
        rows = packing.pack_documents(docs, path, with_ids=True, group_tokens=20_000).collect()
        by_doc, by_sequence = {}, {}
        for r in rows:
            assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length and r.length > 0
            by_doc.setdefault(r.doc_id, []).append((r.start, np.frombuffer(r.ids, "<u4").tolist()))
            by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for spans in by_sequence.values():
            at = 0
            for offset, n in sorted(spans):
                assert offset == at
                at += n
            assert at == 2048 or at & (at - 1) == 0
        texts = docs.dropDuplicates().collect()
        for d in texts:
            want = [*full.encode(d.text or "", add_special_tokens=False).ids, 1]
            got = [i for _, ids in sorted({(s, tuple(x)) for s, x in by_doc[d.doc_id]}) for i in ids]
            assert got == want


# 4
def test_segmentations_are_distinct_decode_and_have_exact_odds(odd, tokenizer):
    path = tokenizer("piece_bpe_32k.model")
    rows = segment_sampling.sample_segmentations(odd, path, n_samples=3, with_ids=True).collect()
    assert all(r.decoded_ok for r in rows)
    assert {r.doc_id for r in rows} == {r.doc_id for r in odd.collect()}
    again = segment_sampling.sample_segmentations(odd.repartition(3), path, n_samples=3, with_ids=True).collect()
    told = lambda found: sorted((str(r.doc_id), r.sample, r.ids, round(r.log_prob, 9), round(r.log_inclusion, 9)) for r in found)
    assert told(rows) == told(again)
    import pyarrow as pa

    n = 6000
    v = segment_sampling.vocabulary(path)
    found = list(segment_sampling.sample(pa.array(["hello"] * n), np.arange(n), v, 2, 5))
    firsts = Counter(tuple(ids) for _, s, ids, _, _ in found if s == 0)
    odds = {tuple(ids): np.exp(p) for _, _, ids, p, _ in found}
    assert all(abs(firsts[k] / n - odds[k]) < 0.025 for k in odds)
    mass = sum(np.exp(p - q) for _, _, _, p, q in found) / n  # every segmentation's share over its inclusion: 1 on average
    assert abs(mass - 1) < 0.02


# 5
def test_toxicity_learns_held_out_documents_and_finds_sentences(spark, odd):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    scored = toxicity.score_documents(docs, model).join(labels.select("doc_id", "toxic"), "doc_id").filter(toxicity.held_out("doc_id"))
    by = {r.toxic: r.hit for r in scored.groupBy("toxic").agg(F.avg((F.col("toxicity") >= 0.7).cast("int")).alias("hit")).collect()}
    assert by[1] >= 0.85 and by[0] <= 0.01  # 303 toxic documents to learn from; with 1,146 it finds 0.99
    got = {r.doc_id: r for r in toxicity.score_documents(odd, model).collect()}
    assert got[0].toxicity == got[1].toxicity == 0 and got[0].worst_text is None
    assert "idiot" in got[3].worst_text and got[3].toxicity == max(r.toxicity for r in got.values())
    assert toxicity.score_documents(odd.limit(0), model).count() == 0


# 6
def test_quotes_link_to_their_originals(spark):
    first = "The quick brown fox jumps over the lazy dog near the river."
    rows = [
        (1, 0, "user", first),
        (1, 1, "assistant", "Something quite different is said here, at some length."),
        (1, 2, "user", f"> {first.upper()}\n\nI answer that."),
        (1, 3, "assistant", f"> I answer that.\n>> {first}\nNested."),
        (1, 4, "user", "> nobody ever said this passage anywhere\nHm."),
        (2, 0, "user", f">  {first}\nFrom another conversation."),
        (2, 0, "user", f">  {first}\nFrom another conversation."),
        (None, None, None, None),
    ]
    got = {(r.conv_id, r.turn): r for r in quotes.reply_order(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    key = {r.message_id: k for k, r in got.items()}
    parents = {k: key.get(r.parent_id) for k, r in got.items()}
    assert parents == {(1, 0): None, (1, 1): (1, 0), (1, 2): (1, 0), (1, 3): (1, 2), (1, 4): (1, 3), (2, 0): (1, 0), (None, None): None}
    assert (got[1, 2].text, got[1, 3].text, got[1, 3].quote_levels, got[1, 3].n_linked) == ("I answer that.", "Nested.", 2, 2)
    assert [got[1, t].depth for t in range(5)] == [0, 1, 1, 2, 3] and got[2, 0].n_copies == 2 and key[got[1, 4].thread_id] == (1, 0)
    assert got[1, 4].n_linked == 0


def test_long_conversations_chain_over_ranges(spark):
    rows = spark.range(700).select(F.lit(9).alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.concat(F.lit("message number "), "id").alias("text"))
    assert {(r.turn, r.depth) for r in quotes.reply_order(rows).collect()} == {(i, i) for i in range(700)}


# 7
def test_perfect_hash_is_minimal():
    keys = np.random.default_rng(3).integers(-(2**62), 2**62, 5000)
    assert sorted(PerfectHash.build(keys).slots(keys).tolist()) == list(range(5000))


def test_id_store_round_trip(spark, odd, sample, tokenizer, tmp_path):
    path = tokenizer("word_bpe_49k.json")
    full = Tokenizer.from_file(path)
    for n, docs in enumerate((odd, sample, odd.limit(0))):
        folder = str(tmp_path / f"store{n}")
        id_store.write_store(docs, folder, path, end_id=2, vocabulary=49_408, shard_bytes=100_000)
        got = id_store.look_up(spark, folder, docs.select("doc_id").distinct(), with_ids=True).orderBy("start").collect()
        records = [(-1 if r.doc_id is None else r.doc_id, [*full.encode(r.text or "", add_special_tokens=False).ids, 2]) for r in docs.collect()]
        assert sorted((-1 if r.doc_id is None else r.doc_id, r.ids) for r in got) == sorted(records)
        at = 0
        for r in got:
            assert r.start == at and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
            at += r.n_tokens
        assert [r.doc_id for r in got if r.doc_id is not None] == sorted(r.doc_id for r in got if r.doc_id is not None)
        assert id_store.look_up(spark, folder, spark.createDataFrame([(10**12,)], "k long")).count() == 0


# 8
def test_quality_counts_match_plain_ones(odd, sample):
    for docs in (odd, sample):
        for r in quality.judge(docs).collect():
            text = r.text or ""
            words = [w for w in text.replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
            windows = Counter(zip(words, words[1:], words[2:], strict=False))
            covered = {i + k for i, w in enumerate(zip(words, words[1:], words[2:], strict=False)) if windows[w] > 1 for k in range(3)}
            lines = [x for x in text.split("\n") if x.strip(" \t\r\x0b\x0c")]
            want = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
            assert r.base_failed == (len(words) < 50 or 100 * len(covered) > 50 * len(words)) and (not r.kept or not r.base_failed)


def test_quality_sketch_quantiles_and_clean_documents(spark):
    rows = spark.range(1, 2001).select(F.lit("en").alias("lang"), (F.col("id") / 7).alias("x"))
    r = quality.quantiles(quality.sketches(rows, ["lang"], ["x"]), ["lang"], {"q25": F.lit(0.25), "q75": F.lit(0.75)}).first()
    assert r.total == 2000 and abs(r.q25 / (500 / 7) - 1) < 0.011 and abs(r.q75 / (1500 / 7) - 1) < 0.011
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = quality.judge(docs, with_text=False).filter("not base_failed").join(labels.select("doc_id", "quality"), "doc_id")
    kept = {r.quality: r.k for r in got.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()}
    assert kept[1] > 0.99 and kept[0] < 0.05


# 9
def plain_fingerprint(text):
    words = text.encode().lower().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_matches_brute_force(spark, odd, sample):
    for docs in (odd.filter("doc_id is not null"), sample):
        rows = docs.select("doc_id", "text").dropDuplicates().orderBy("doc_id").collect()
        fps = [plain_fingerprint(r.text or "") for r in rows]
        want = components(len(rows), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 4)
        got = {r.doc_id: (r.f, r.component_id) for r in simhash.near_duplicates(docs).select(F.col("id").alias("doc_id"), simhash.hex_of().alias("f"), "component_id").collect()}
        assert got == {r.doc_id: (f"{f:016x}", rows[w].doc_id) for r, f, w in zip(rows, fps, want, strict=True)}
    first = spark.sql("select xxhash64('a b c d') h").first().h
    assert plain_fingerprint("A b C d") == first % 2**64


def test_simhash_cuts_large_buckets_without_loss(spark):
    rng = np.random.default_rng(5)
    values = {int(sum(1 << int(b) for b in rng.choice(64, 3, replace=False))) for _ in range(300)}
    nodes = spark.createDataFrame([(i, v.to_bytes(8, "little")) for i, v in enumerate(sorted(values))], "node long, fp binary")
    whole, cut = (connected_components(simhash.close_edges(nodes, chunk=c)).collect() for c in (1024, 16))
    assert {tuple(r) for r in whole} == {tuple(r) for r in cut}
    listed = sorted(values)
    want = components(len(listed), lambda i, j: (listed[i] ^ listed[j]).bit_count() <= 4)
    assert {(r.node, r.component) for r in whole} >= {(i, w) for i, w in enumerate(want) if want.count(w) > 1}


# 10
def test_warc_round_trip_and_determinism(spark, tmp_path):
    big, small = "z" * 1500, "y" * 10
    rows = [(1, "u1", big), (5, "u5", big), (3, "u3", big), (2, "u2", small), (4, "u4", small), (6, None, None), (7, "u7", ""), (8, "u\r\n8", "ü" * 600), (None, "n", big), (5, "u5", big)]
    rows += [(100 + i, "u", f"page {i} " * 300) for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    import hashlib

    for n in (1, 2):
        warc.write_archive(pages.repartition(n * 3), str(tmp_path / f"w{n}"), shard_bytes=40_000, roll_bytes=2_000)
    files = [{p.name: p.read_bytes() for p in (tmp_path / f"w{n}").glob("*.gz")} for n in (1, 2)]
    assert files[0] == files[1] and len(files[0]) > 2 and not list((tmp_path / "w1").glob(".*.warc.gz.*"))
    got = warc.read_archive(spark, str(tmp_path / "w1"), with_payload=True).collect()
    assert sorted((r.page_id or -1, r.payload_bytes, r.payload_digest) for r in got) == sorted((p or -1, len((h or "").encode()), hashlib.sha1((h or "").encode()).hexdigest()) for p, _, h in rows)
    kinds = Counter((r.page_id, r.record_type, r.refers_to) for r in got if r.page_id is None or r.page_id < 100)
    responses = [2, 4, 5, 6, 7, 8]
    assert kinds == Counter([*((p, "response", None) for p in responses), *((p, "revisit", 5) for p in (None, 1, 3, 5))])


@pytest.mark.parametrize("empty", ["documents", "pages"])
def test_empty_tables(spark, tokenizer, tmp_path, empty):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    if empty == "pages":
        warc.write_archive(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "w"))
        assert warc.read_archive(spark, str(tmp_path / "w")).count() == 0
        assert nn_descent.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
        return
    assert quality.judge(docs).count() == 0
    assert simhash.near_duplicates(docs).count() == 0
    assert packing.pack_documents(docs, tokenizer("byte_bpe_50k.json")).count() == 0
    assert token_counts.count_tokens(docs, tokenizer("piece_bpe_32k.model")).count() == 0
    assert segment_sampling.sample_segmentations(docs, tokenizer("piece_bpe_32k.model")).count() == 0


def test_pipeline_runs_and_keeps_columns(spark, sample):
    import corpus_pipeline

    docs = sample
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.columns == sample.columns, name
        docs = spark.createDataFrame(out.collect(), sample.schema)
    assert 0 < docs.count() < sample.count()
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").select("doc_id").distinct().count() == docs.count()
