"""The registered queries of this subpackage; each applies its operator to the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import filter_audit, id_store, m_tree, nn_descent, packing, periodic_runs, quality, quotes, segment_sampling, simhash, token_counts, toxicity, warc
from .common import fresh_dir, table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op2_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nn_descent.near_duplicates(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=1, capacity=2048)


def op4_segment_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment_sampling.sample_segmentations(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), n_samples=2)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score_documents(docs.select("doc_id", "text"), model)
    predicted = (F.col("toxicity") >= 0.7).cast("int")
    return scored.select("doc_id", toxicity.held_out("doc_id").alias("held_out"), F.col("toxicity").alias("score"), predicted.alias("predicted"), "worst_sentence", "worst_score")


def op6_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.reply_order(table(spark, sf_dir, "conversations"))


def op7_id_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = table(spark, sf_dir, "documents"), fresh_dir(spark, "ids")
    id_store.write_store(docs, path, public_tokenizers.path("word_bpe_49k.json"), end_id=2, vocabulary=49_408, shard_bytes=32 << 20)
    return id_store.look_up(spark, path, docs.select("doc_id").distinct())


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    judged = quality.judge(docs, with_text=False)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.array_join("failed", ",").alias("failed"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle_words=4, max_bits=4)
    return found.select(F.col("id").alias("doc_id"), simhash.hex_of("fp").alias("fingerprint"), "component_id")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_dir(spark, "warc")
    warc.write_archive(table(spark, sf_dir, "pages"), path, shard_bytes=32 << 20, roll_bytes=4 << 20)
    return warc.read_archive(spark, path).drop("url", "file")


def op11_m_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors, path = table(spark, sf_dir, "embeddings"), fresh_dir(spark, "m-tree")
    m_tree.build_index(vectors, path, k=5, scale=256.0)
    return m_tree.search(vectors.filter("vec_id % 50 = 0"), path, k=5).withColumnRenamed("id", "vec_id")


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text``; in a tenth of the documents, drawn by a checksum of the id, the words from one on are repeats of as many
    words as the checksum says.  Without an id nothing changes."""
    h, w = F.crc32(F.col("doc_id").cast("string")), filter_audit.words(F.col("text"))
    rows = docs.select("doc_id", "text", w.alias("w"), F.floor(h / 10).alias("g"), (h % 10 == 0).alias("drawn"))
    n, g = F.size("w"), F.col("g")
    a = (g % n).cast("int")
    p = F.lit(1) + F.floor((n - a) / (g % 8 + 3)).cast("int")
    again = F.transform(F.sequence(F.lit(0), n - a - 1), lambda i: F.element_at("w", a + i % p + 1))
    return rows.select("doc_id", F.when(F.col("drawn") & (n > 0), F.array_join(F.concat(F.slice("w", 1, a), again), " ")).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.collapse_runs(with_planted_runs(table(spark, sf_dir, "documents").select("doc_id", "text")))
    lines = F.transform("runs", lambda r: F.format_string("%d,%d,%d\n", r["start"], r["length"], r["period"]))
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), periodic_runs.strongest(F.col("runs")).alias("best"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return out.select("doc_id", "n_runs", "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_token_counts, op2_nn_descent, op3_packing, op4_segment_sampling, op5_toxicity, op6_quotes, op7_id_store, op8_quality, op9_simhash, op10_warc, op11_m_tree, op12_periodic_runs, op13_filter_audit)
    return {f.__name__: f for f in found}


#: The SQL of the queries that SQL can express.
ORACLES: dict[str, str] = {
    # what the records read back must say
    "op10_warc": """
with p as (select page_id, coalesce(html, '') html from pages),
l as (select html, max(page_id) last from p group by html)
select page_id, strlen(html)::bigint payload_bytes, sha1(html) payload_digest,
  case when strlen(html) >= 1000 and page_id <> last then 'revisit' else 'response' end record_type,
  case when strlen(html) >= 1000 and page_id <> last then last end refers_to
from p join l using (html)""",
    # every query against every vector
    "op11_m_tree": """
with v as (
  select vec_id, list_transform(embedding::double[], lambda x: floor(256 * x)) v from embeddings
  where vec_id is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.vec_id query_id, v.vec_id, list_inner_product(q.v, v.v)::bigint score
  from v q join v on v.vec_id <> q.vec_id where q.vec_id % 50 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int rank from s)
select query_id, rank, vec_id, score from r where rank <= 5""",
    # the lattice written out: every order, every step, every set of failed filters
    "op13_filter_audit": r"""
with d as (select doc_id, coalesce(lang, '') part, coalesce(text, '') t from documents),
w as (select *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') w from d),
firsts as (select t, min(doc_id) f from d group by t),
marks as (select doc_id, max(coalesce(quality = 1, false)::int) good, max(coalesce(toxic = 1, false)::int) toxic from labels group by doc_id),
m as (
  select part, (len(w) < 200)::int + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::int
    + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t))::int
    + 8 * regexp_matches(t, '[#$%&*|]')::int + 16 * coalesce(w.doc_id > f, false)::int mask, coalesce(good, 0) good, coalesce(toxic, 0) toxic
  from w join firsts using (t) left join marks on marks.doc_id = w.doc_id),
cells as (select part, mask, count(*) n, sum(good) good, sum(toxic) toxic from m group by 1, 2),
l as (select * from (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) x(c, b)),
o as (
  select v.c || w.c || x.c || y.c || z.c filter_order, [v.b, w.b, x.b, y.b, z.b] bits
  from l v, l w, l x, l y, l z where v.b + w.b + x.b + y.b + z.b = 31 and (v.b | w.b | x.b | y.b | z.b) = 31),
s as (select filter_order, step, bits[step] bit, list_sum(bits[1:step]) - bits[step] state from o, (select unnest(range(1, 6)) step)),
r as (
  select part, filter_order, step, bit,
    sum(case when mask & (state | bit) = 0 then n else 0 end) kept,
    sum(case when mask & state = 0 and mask & bit <> 0 then n else 0 end) removed,
    sum(case when mask & state <> 0 and mask & bit <> 0 then n else 0 end) redundant,
    sum(case when mask = bit then n else 0 end) unique_fails,
    sum(case when mask & state = 0 and mask & bit <> 0 then good else 0 end) good_lost,
    sum(case when mask & state = 0 and mask & bit <> 0 then toxic else 0 end) toxic_lost
  from cells, s group by all)
select part, filter_order, step::int step, kept::bigint kept, removed::bigint removed, redundant::bigint redundant, unique_fails::bigint unique_fails,
  good_lost::bigint good_lost, toxic_lost::bigint toxic_lost, (sum(removed) over (partition by part, bit))::bigint shapley, 120 n_orders
from r""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
