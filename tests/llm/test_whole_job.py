"""Cases in which an operator once did less than its whole job."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from test_operators import components

from stintframe.llm import nn_descent, quality, quotes, simhash, toxicity
from stintframe.llm.common import connected_components



# 2
def test_links_between_two_tight_clusters(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 32))
    x[:40] = np.eye(32)[0] + 0.01 * rng.normal(size=(40, 32))
    x[40:80] = 0.92 * np.eye(32)[0] + np.sqrt(1 - 0.92**2) * np.eye(32)[1] + 0.01 * rng.normal(size=(40, 32))
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    near = unit @ unit.T >= 0.9
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = {r.id: r for r in nn_descent.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert [got[i].n_links for i in range(400)] == (near.sum(axis=1) - 1).tolist() and near[0, 40:80].any()
    assert [got[i].component_id for i in range(400)] == components(400, lambda i, j: near[i, j])




def test_search_goes_on_until_the_links_are_found(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 24))
    x[1500:1520] = x[:20] + 0.2 * rng.normal(size=(20, 24))  # so few that a sample of 256 may see none
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    near = unit @ unit.T >= 0.9
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    # hardly a search at all: one tree, lists of one and no rounds
    got = {r.id: r for r in nn_descent.near_duplicates(vectors, k=1, trees=1, rounds=0, attempts=1).collect()}
    assert [got[i].n_links for i in range(3000)] == (near.sum(axis=1) - 1).tolist() and near.sum() > 3000
    parents = [int(np.flatnonzero(near[i])[0]) for i in range(3000)]
    assert [got[i].component_id for i in range(3000)] == parents


# 5
def test_length_alone_is_not_toxic(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    long = toxicity.training_rows(docs, labels, 2400, 6 << 20)
    assert max(map(len, long[0])) > 20_968 and sum(len(x.encode()) for x in long[0]) <= 6 << 20
    model = toxicity.fit(*long)
    clean = "The table stands near the window. " * 6000
    rows = [(1, clean), (2, clean + "You idiot moron.")]
    got = {r.doc_id: r for r in toxicity.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert got[1].toxicity < 0.1 and got[2].toxicity >= 0.5 and got[2].worst_sentence == 6000
    assert got[2].worst_text == "You idiot moron."


def plain_scores(text, model):
    """Noisy-or of the sentences with a weighted feature, and the number of the likeliest sentence with a word."""
    sentences, at = [[]], 0
    for line in text.split("\n"):
        for unit in re.sub("([。！？])", r"\1 ", line).split(" "):
            sentences[-1].append(unit)
            if unit.rstrip(toxicity.CLOSING).endswith((".", "!", "?", "…", "。", "！", "？")):
                sentences.append([])
        sentences.append([])
    clean, best = 1.0, (-1.0, -1)
    for words in sentences:
        found = [f for x in words for f in toxicity.unit_features(x)]
        p = 1 / (1 + math.exp(-model.bias - sum(model.weights.get(f, 0.0) for f in found)))
        if found:
            best = max(best, (p, -at))
        if any(f in model.weights for f in found):
            clean *= 1 - p
        at += 1
    return 1 - clean, best[0]


def test_scores_are_those_of_a_plain_noisy_or(spark, odd):
    model = toxicity.Model({"idiot$": 4.0, "idio": 1.0, "moron$": 2.5, "table$": -1.5, "stan": 0.5}, -2.0)
    texts = ["You idiot moron.", "“You idiot!” The table stands. Fine", "バカ。idiot！table", "no evidence here", "", "!!! ... ?", "table stands idiot\nmoron moron", "idiots idiots. idiots"]
    docs = spark.createDataFrame([*enumerate(texts), (50, None), (3, "no evidence here")], "doc_id long, text string")
    for r in toxicity.score_documents(docs, model).collect():
        want, worst = plain_scores(r.text or "", model)
        assert abs(r.toxicity - want) < 1e-9, r.text
        assert abs(r.worst_score - max(worst, 0)) < 1e-9, r.text
    assert toxicity.score_documents(odd, toxicity.fit([], [])).filter("toxicity >= 0.7").count() == 0


def test_joined_clean_texts_stay_clean(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    rows = docs.join(labels.filter("toxic = 0"), "doc_id").filter(toxicity.held_out("doc_id")).orderBy("doc_id").collect()
    flagged = {}
    for k in (1, 16, 64):
        joined = ["\n".join(r.text for r in rows[i : i + k]) for i in range(0, len(rows) - k + 1, k)]
        flagged[k] = float((model.score(pa.array(joined, pa.large_string()))[0] >= 0.7).mean())
    # a joined text holds every wrongly flagged sentence of its parts; evidence below that does not add up
    assert all(share <= 1.2 * (1 - (1 - flagged[1]) ** k) + 0.05 for k, share in flagged.items()), flagged


def test_joins_of_many_clean_texts_are_not_flagged(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    rows = docs.join(labels, "doc_id").filter(toxicity.held_out("doc_id")).select("doc_id", "text", "toxic").orderBy("doc_id").collect()
    clean, draw = [r.text for r in rows if r.toxic == 0], np.random.default_rng(5)

    def flagged(texts):
        return float((model.score(pa.array(texts, pa.large_string()))[0] >= 0.7).mean())

    # what a joined text gathers is the sum of its parts', so many joins are told from one look at each part
    total, worded, counted = (np.asarray(x) for x in model.evidence(pa.array(clean, pa.large_string()))[2:])
    for k in (64, 256):
        i = draw.integers(0, len(clean), (2000, k))
        gathered, bound = total[i].sum(axis=1), model.leak.bound(worded[i].sum(axis=1), counted[i].sum(axis=1))
        hit = np.expm1(gathered) * np.exp(-bound) >= 0.7 / 0.3
        assert hit.mean() <= 0.05
        joined = ["\n".join(clean[j] for j in row) for row in i[:10]]
        assert ((model.score(pa.array(joined, pa.large_string()))[0] >= 0.7) == hit[:10]).all()
    leakless = toxicity.Model(model.weights, model.bias)
    toxic = [r.text for r in rows if r.toxic == 1]
    held = float((leakless.score(pa.array(toxic, pa.large_string()))[0] >= 0.7).mean())
    assert flagged(toxic) >= held - 0.02 and flagged(clean) <= 0.005


def test_leak_lowers_the_odds_by_the_lower_bound():
    leak = toxicity.Leak(0.01, 0.02, 0.3, 0.1)
    texts = ["idiot. table. moron x.", "table", "idiot " * 3]
    model, plain = toxicity.Model({"idiot$": 4.0, "moron$": 2.5}, -2.0, leak), toxicity.Model({"idiot$": 4.0, "moron$": 2.5}, -2.0)
    got, base = (m.score(pa.array(texts, pa.large_string()))[0] for m in (model, plain))
    for p, q, (worded, counted) in zip(got, base, ((3, 2), (1, 0), (1, 1)), strict=True):
        low = min(worded * 0.01 + toxicity.BOUND * 0.02 * worded**0.5, counted * 0.3 + toxicity.BOUND * 0.1 * counted**0.5)
        assert abs(p - (q * math.exp(-low) / (1 - q + q * math.exp(-low)))) < 1e-9
    assert toxicity.learn([], []).leak == toxicity.Leak() and toxicity.learn(["a b"], [0]).leak == toxicity.Leak()


# pipeline
def linked(texts, least):
    sets = []
    for text in texts:
        words = text.lower().split()
        sets.append({tuple(words[i : i + 5]) for i in range(len(words) - 4)})
    return components(len(texts), lambda i, j: len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]))


def edited(rng, words, changes):
    words = list(words)
    for k in rng.choice(len(words) // 10, changes, replace=False):
        words[10 * k + 5] = f"new{rng.integers(10**9)}"
    return words


def test_near_duplicates_are_the_pairs_of_brute_force(spark):
    import corpus_pipeline

    rng = np.random.default_rng(11)
    texts = []
    for n in range(150):  # each change of 300 words touches five of 296 shingles: similarities 0.71 to 0.90
        words = [f"w{x}" for x in rng.integers(0, 10**6, 300)]
        texts += [" ".join(words), " ".join(edited(rng, words, (3, 5, 6, 7, 10)[n % 5]))]
    texts += [" ".join(texts[0].split()[:150] * 3), " ".join(texts[0].split()[:150] * 3 + ["end"])]
    words = [f"v{x}" for x in range(200)]
    texts += [" ".join(words[10 * k :] + [f"u{x}" for x in range(10 * k)]) for k in range(6)]  # a chain
    want = linked(texts, 0.8)
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)]
    # a repeated row, a copy without id, texts without id of their own, two texts under one id, null and empty texts
    odd = [rows[3], (None, texts[1], "en", "s"), (None, "only one without an id", "en", "s"), (None, "only one without an id", None, None), (0, "another text under the first id", "en", "s"), (900, None, "en", "s"), (901, "", None, "s")]
    docs = spark.createDataFrame([*rows, *odd], "doc_id long, text string, lang string, source string")
    kept = corpus_pipeline.near_duplicate_filter(spark, docs, "").collect()
    found = Counter((r.doc_id, r.text) for r in kept)
    assert found == Counter([*((i, texts[i]) for i in set(want)), (None, "only one without an id"), (0, "another text under the first id"), (900, None)])


def test_sets_of_large_groups_are_compared_over_chunks(spark, monkeypatch):
    rng = np.random.default_rng(12)
    texts = [" ".join(edited(rng, [f"{n % 2}w{x}" for x in range(400)], 3)) for n in range(60)]
    texts += [" ".join(edited(rng, texts[0].split(), 1)[k:]) for k in range(0, 60, 5)]  # chains away from the first sets
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = linked(texts, 0.87)
    monkeypatch.setattr(simhash, "SETS", 8)
    got = {r.id: r.component_id for r in simhash.similar_documents(docs, least=0.87).collect()}
    assert [got[i] for i in range(len(texts))] == want and 1 < len(set(want))


# 7, 10
def test_shards_are_even_whatever_the_ids_are(spark, tmp_path):
    from pyspark.sql import functions as F

    from stintframe.llm import id_store, shards

    n = 4000
    ids = [*range(n), -(2**62) - 5, 2**62 + 9, *([None] * n), *([77] * n)]
    rows = spark.createDataFrame([(i, f"text {k}") for k, i in enumerate(ids)], "doc_id long, text string").repartition(5)
    a, b = shards.place(F.col("doc_id"), F.col("text"))
    placed = rows.select("doc_id", "text", a.alias("a"), b.alias("b"))
    dealt, count = shards.with_shard(placed, placed.select("a", "b", F.lit(1).alias("weight")), 500)
    sizes = {r.shard: r["count"] for r in dealt.groupBy("shard").count().collect()}
    assert sorted(sizes) == list(range(count)) and max(sizes.values()) <= 500 and count == -(-len(ids) // 500)
    again = shards.with_shard(placed.repartition(2), placed.repartition(3).select("a", "b", F.lit(1).alias("weight")), 500)[0]
    assert sorted(map(tuple, dealt.select("text", "shard").collect())) == sorted(map(tuple, again.select("text", "shard").collect()))
    import public_tokenizers

    folder = str(tmp_path / "store")
    id_store.write_store(rows, folder, public_tokenizers.path("word_bpe_49k.json"), 2, 49_408, shard_bytes=20_000)
    got = id_store.look_up(spark, folder, rows.select("doc_id").distinct()).collect()
    key = lambda x: -(2**63) if x is None else x
    assert sorted(key(r.doc_id) for r in got) == sorted(map(key, ids))
    got.sort(key=lambda r: r.start)
    assert all(r.start + r.n_tokens == s.start for r, s in zip(got, got[1:], strict=False)) and got[0].start == 0
    assert [key(r.doc_id) for r in got] == sorted(key(r.doc_id) for r in got)


def test_shards_and_tasks_are_bounded(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    from stintframe.llm import id_store, shards, warc

    monkeypatch.setattr(shards, "MOST_TASKS", 20)
    numbered = spark.range(100_000).select(F.col("id").cast("int").alias("shard"))
    tasks = shards.by_shard(numbered, 100_000).select("shard", F.spark_partition_id().alias("task"))
    assert tasks.filter("task <> shard div 5000").count() == 0
    rows = spark.range(3000).select("id", F.concat(F.lit("text "), "id").alias("text")).repartition(3)
    import public_tokenizers

    tokenizer, got = public_tokenizers.path("word_bpe_49k.json"), {}
    for name, most_shards, most_tasks in (("plain", 1 << 20, 100_000), ("tasks", 1 << 20, 3), ("shards", 7, 100_000)):
        monkeypatch.setattr(shards, "MOST_SHARDS", most_shards)
        monkeypatch.setattr(shards, "MOST_TASKS", most_tasks)
        folder = str(tmp_path / name)
        id_store.write_store(rows, folder, tokenizer, 2, 49_408, id_col="id", shard_bytes=2000)
        files = list((tmp_path / name).glob("*.ids"))
        assert len(files) == 7 if name == "shards" else len(files) > 30
        if name == "tasks":
            assert len(list((tmp_path / name).glob("shards-*.parquet/part-*"))) <= most_tasks
        got[name] = sorted(map(tuple, id_store.look_up(spark, folder, rows.select("id")).collect()))
        warc.write_archive(rows, folder + "-warc", id_col="id", url_col="text", html_col="text", shard_bytes=20_000)
        assert warc.read_archive(spark, folder + "-warc").count() == 3000
    assert got["plain"] == got["tasks"] == got["shards"] and len(got["plain"]) == 3000


# 3
def test_packing_asks_every_sequence_and_balances_cost():
    from stintframe.llm.packing import pack

    rng = np.random.default_rng(6)
    lengths = rng.lognormal(5.5, 1.0, 3000).astype(int).clip(1, 1200).tolist()  # none fills a sequence, whose cost is then given
    pieces, size, cost = pack(lengths, 2048)
    room, paid = size.copy(), np.zeros(len(size))
    for doc, start, n, s, offset in pieces:  # the rule by hand: the cheapest with room, a cut only where none has room
        left = lengths[doc] - start
        if n < 2048:
            fits = [k for k in range(len(size)) if room[k] >= left] or [k for k in range(len(size)) if room[k]]
            assert s == min(fits, key=lambda k: (paid[k], k)) and n == min(left, room[s])
        assert offset == size[s] - room[s]
        room[s] -= n
        paid[s] += n + n * n / 2048
    assert not room.any() and np.allclose(paid, cost)
    plain, at = np.zeros(len(size)), 0
    for left in lengths:  # filling in the order of reading
        while left:
            n = min(left, 2048 - at % 2048)
            if at // 2048 < len(plain):
                plain[at // 2048] += n + n * n / 2048
            at, left = at + n, left - n
    full = size == 2048
    assert np.std(cost[full]) < 0.8 * np.std(plain[full])


# 8
def plain_limits(rows, rules):
    """Limits per (lang, source) from (lang, source, statistics) of the documents in the sketches, by hand."""

    def bucket(x):
        return quality.ZERO if x <= quality.LEAST_VALUE else math.ceil(math.log(x) / math.log(quality.GAMMA))

    def value(b):
        return 0.0 if b == quality.ZERO else quality.GAMMA**b * 2 / (quality.GAMMA + 1)

    def listed(sketch):
        return sorted(sketch.elements())

    def begun(sketch, above):
        held = listed(above)  # the percentiles (i + 0.5) / PRIOR of the broader sketch
        n = len(held)
        return sketch + Counter(held[math.ceil(n * (i + 0.5) / quality.PRIOR) - 1] for i in range(quality.PRIOR))

    out = {}
    for name, rule in rules.items():
        own = {}
        for lang, source, stats in rows:
            own.setdefault((lang, source), Counter())[bucket(stats[name])] += 1
        whole = sum(own.values(), Counter())
        by_lang = {x: begun(sum((c for (lang, _), c in own.items() if lang == x), Counter()), whole) for x in {k[0] for k in own}}
        for (lang, source), sketch in own.items():
            held = listed(begun(sketch, by_lang[lang]))
            at = lambda q: value(held[max(0, math.ceil(round(q * len(held), 9)) - 1)])  # noqa: B023, E731
            middle = at(0.5)
            low = middle - rule.reach * (middle - at(1 - rule.quantile)) if rule.low else -1.0
            out[lang, source, name] = (low, middle + rule.reach * (at(rule.quantile) - middle))
    return out


def test_quality_limits_and_verdicts_are_those_of_plain_sketches(spark, sample):
    rng = np.random.default_rng(8)
    line = lambda: " ".join(f"w{x}" for x in rng.integers(0, 10**9, 12))
    verse = [("en", "verse", "\n".join(["a refrain that all of them sing here"] * int(k) + [line() for _ in range(12)])) for k in rng.integers(2, 8, 600)]
    prose = [("en", "prose", " ".join(f"word{x}" for x in rng.integers(0, 10**6, 60))) for _ in range(3000)]
    odd = "\n".join(["the same line is said again and again"] * 8 + [line() for _ in range(12)])
    texts = [*verse, *prose, ("en", "verse", odd), ("en", "prose", odd), (None, None, odd), ("de", None, None)]
    made = spark.createDataFrame([(i, t, lang, source) for i, (lang, source, t) in enumerate(texts)], "doc_id long, text string, lang string, source string")
    for docs in (made, sample.select("doc_id", "text", "lang", "source")):
        judged = quality.judge(docs).collect()
        stat = lambda r, rule: getattr(r, rule.count) / max(1, getattr(r, rule.per))
        limits = plain_limits([(r.lang, r.source, {n: stat(r, x) for n, x in quality.RULES.items()}) for r in judged if not r.base_failed], quality.RULES)
        for r in judged:
            failed = []
            for name, rule in quality.RULES.items():
                low, high = limits.get((r.lang, r.source, name), (-math.inf, math.inf))
                per = max(1, getattr(r, rule.per))
                count = getattr(r, rule.count)
                failed += [name] * (count - high * per > quality.FEW or low * per - count > quality.FEW)
            assert r.failed == failed and r.kept == (not r.base_failed and not failed)
        if docs is made:  # what is usual in one source is not in the other
            by = {(r.lang, r.source): r for r in judged if r.text == odd}
            assert by["en", "verse"].kept and "dup_line_share" in by["en", "prose"].failed
            assert limits["en", "verse", "dup_line_share"][1] > 2 * limits["en", "prose", "dup_line_share"][1]


# 6
def plain_links(rows):
    """(conv, turn, text) of the original of each quoted run, by hand, for messages with different (conv, turn)."""
    norm = lambda x: " ".join(re.findall(r"[^\W_]+", x)).lower()
    said = {}
    for conv, turn, text in sorted((r for r in rows if None not in r), key=lambda r: r[:2]):
        kept = [None if re.match(r"(\s*>)+", x) else x for x in text.split("\n")]
        blocks, block = [], []
        for x in [*kept, ""]:
            if x and norm(x):
                block.append(x)
            else:
                blocks, block = [*blocks, block], []
        for passage in {norm(" ".join(x for x in kept if x)), *(norm(" ".join(x)) for x in blocks), *(norm(x) for x in kept if x)} - {""}:
            said.setdefault(passage, []).append((conv, turn))

    def original(passage, conv, turn):
        near = [x for x in said.get(passage, []) if x[0] == conv][:1]
        far = said.get(passage, [])[:1]
        return near[0] if near and near[0] < (conv, turn) else far[0] if far and far[0][0] < conv else None

    out = {}
    for conv, turn, text in rows:
        runs, last = [], -1
        for x in (text or "").split("\n"):
            level = re.match(r"(\s*>)*", x)[0].count(">")
            if level != last:
                runs.append((level, []))
            runs[-1][1].append(re.sub(r"^(\s*>)+", "", x))
            last = level
        found = []
        for level, lines in runs:
            if level and norm(" ".join(lines)):
                parts, part = [], []
                for x in [*lines, ""]:
                    if norm(x):
                        part.append(x)
                    else:
                        parts, part = [*parts, part], []
                options = [[norm(" ".join(lines))], [norm(" ".join(x)) for x in parts if x], [norm(x) for x in lines if len(norm(x)) >= 20]]
                hits = [[o for x in some if (o := original(x, conv, turn))] for some in options] if None not in (conv, turn) else []
                found.append((level, next((max(h) for h in hits if h), None)))
        out[conv, turn] = (len(found), sum(o is not None for _, o in found), max((o for level, o in found if level == 1 and o), default=None))
    return out


def test_quotes_link_as_by_hand(spark):
    rng = np.random.default_rng(9)
    word = lambda: f"w{rng.integers(60)}"
    rows, said = [], []
    for conv in range(12):
        for turn in range(8):
            lines = [" ".join(word() for _ in range(rng.integers(1, 9))) for _ in range(rng.integers(1, 5))]
            if rng.random() < 0.5:
                lines.insert(1, "")
            if said and rng.random() < 0.7:
                quoted = said[rng.integers(len(said))].split("\n")
                if rng.random() < 0.4:
                    words = " ".join(quoted).split()
                    quoted = [" ".join(words[i : i + 4]) for i in range(0, len(words), 4)]  # wrapped anew
                quoted = quoted[rng.integers(2) :] or quoted
                lines = ["> " * int(rng.integers(1, 3)) + x for x in quoted] + lines
            said.append("\n".join(x for x in lines if not x.startswith(">")))
            rows.append((conv, turn, "\n".join(lines)))
    first = "The quick brown fox jumps over the lazy dog near the river."
    rows += [(20, 0, first), (None, 5, first), (20, None, first), (30, 1, f"> {first}\nyes"), (20, 3, f"> {first}\nno"), (None, 6, f"> {first}"), (40, None, f"> {first}")]
    rows += [(50, 0, "Hello.\nSee you at 9.\nBye."), (50, 1, "> See you at 9.\nAt ten."), (50, 2, "> Hello. See\n> you at\n> 9. Bye.\nWhat?")]
    table = spark.createDataFrame([(c, t, "user", x, 1, 2) for c, t, x in rows], "conv_id long, turn long, role string, text string, level int, message_id int")
    got = quotes.reply_order(table).collect()
    key = {r.message_id: (r.conv_id, r.turn) for r in got}
    want = plain_links(rows)
    for r in got:
        passages, hits, parent = want[r.conv_id, r.turn]
        assert (r.n_passages, r.n_linked) == (passages, hits), (r, want[r.conv_id, r.turn])
        assert (key[r.parent_id] if r.parent_kind == "quote" else None) == parent, r
    assert want[30, 1][2] == (20, 0) == want[20, 3][2] and want[50, 1][2] == want[50, 2][2] == (50, 0)
    assert quotes.reply_order(table.limit(0)).count() == 0


def test_recall_at_the_least_similarity(spark):
    rng = np.random.default_rng(13)
    texts, pairs = [], 200
    for _ in range(pairs):  # 400 words, 396 shingles; nine changes leave 351 of 441 or a little less than 0.8, eight 0.817
        words = [f"w{x}" for x in rng.integers(0, 10**6, 400)]
        texts += [" ".join(words), " ".join(edited(rng, words, 8))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.id: r.component_id for r in simhash.similar_documents(docs).collect()}
    assert sum(got[2 * k] == got[2 * k + 1] for k in range(pairs)) >= 0.95 * pairs
    # the same with the keys of a table of a billion texts
    width, n, most = simhash.keys_for(10**9, 0.8, 256, 0.98)
    shingles = [simhash.shingles_of(x.encode(), 5) for x in texts]
    fps = np.array([simhash.set_bits(x, simhash.shingle_set(x)[1], 4) for x in shingles])
    met = np.zeros(pairs, bool)
    for key in simhash.drawn_keys(fps, width, n):
        met |= key[::2] == key[1::2]
    assert (met & (simhash.differing(fps[::2], fps[1::2]) <= most)).mean() >= 0.9


def test_edges_of_a_large_group_stay_below_its_nodes(spark):
    """A base and all fingerprints one or two bits away from it, in a group a key, and groups of 30 beside it."""
    base = 0x0123456789ABCDEF
    fps = [base] + [base ^ (1 << i) ^ (1 << j) for i in range(64) for j in range(i, 64)] + [base ^ (1 << i) for i in range(64)]
    fps = [x for x in dict.fromkeys(fps)]
    fps += [(g + 1) * 0x9E3779B97F4A7C15 % 2**64 ^ (1 << i) for g in range(20) for i in range(30)]
    rows = [(n, bytearray(x.to_bytes(8, "little"))) for n, x in enumerate(fps)]
    nodes = spark.createDataFrame(rows, "node long, fp binary").repartition(3)
    edges = simhash.close_edges(nodes).cache()
    groups = {r.node: r.component for r in connected_components(edges).collect()}
    assert len(set(groups.values())) == 21 and len(groups) == len(fps)
    parts = edges.rdd.getNumPartitions()
    assert edges.count() < parts * len(fps) and edges.distinct().count() < 2 * len(fps)
    edges.unpersist()


def test_stars_join_what_the_edges_join():
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 4000, (2, 2500)) * 1000003 - 10**9
    left, right = simhash.spanning_stars(a, b)
    of = {int(x): int(x) for x in np.r_[a, b]}

    def top(x):
        while of[x] != x:
            x = of[x]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        x, y = sorted((top(x), top(y)))
        of[y] = x
    assert dict(zip(right.tolist(), left.tolist(), strict=True)) == {x: top(x) for x in of if top(x) != x}
    assert [len(x) for x in simhash.spanning_stars(a[:0], b[:0])] == [0, 0]
