"""Kernel machine, stored tails and sketches, hash samples, band joins, wide correlations, headed and corrected files, whole jobs."""

import math
import threading
import time
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from stintframe.functions import exprs as E
from stintframe.operators import form, laps, samples, sketches, stats, validate
from stintframe.operators.form import Form, Roles
from stintframe.plans import jobs, ml, reports
from stintframe.plans.kernel import KernelSVM
from stintframe.sources import tables
from stintframe.streaming import jobs as streams
from stintframe.streaming import tails


def near(a, b):
    return (a is None and b is None) or a == pytest.approx(b, abs=1e-9)


# models
@pytest.fixture(scope="module")
def rings(spark):
    """A class inside a ring of the other; near the border the label is a matter of chance."""
    rng = np.random.default_rng(1)
    x = rng.uniform(-2, 2, (3000, 2))
    p = 1 / (1 + np.exp(-4 * (1.2 - np.hypot(*x.T))))
    y = (rng.random(3000) < p).astype(float)
    return spark.createDataFrame(pd.DataFrame({"i": range(3000), "a": x[:, 0], "b": x[:, 1], "p": p, "label": y})).cache()


def test_kernel_machine_separates_curves_and_knows_its_odds(spark, rings, tmp_path):
    train, test = rings.filter("i % 3 <> 0"), rings.filter("i % 3 = 0")
    stages = ml.encoder(["a", "b"], [], scale=True)
    model = ml.train(train, stages, KernelSVM(n_features=100))
    scored = model.transform(test).select("i", "label", "p", "prediction", vector_to_array("probability")[1].alias("q")).toPandas()
    linear = ml.train(train, stages, ml.classifiers("label", weight=None)["logistic"])
    straight = linear.transform(test).select("label", "prediction").toPandas()
    best = ((scored.p > 0.5) == scored.label).mean()
    assert (scored.prediction == scored.label).mean() > best - 0.03 > (straight.prediction == straight.label).mean()
    bins = scored.groupby((scored.q * 5).astype(int).clip(0, 4)).agg(q=("q", "mean"), y=("label", "mean"), n=("q", "size"))
    assert (abs(bins.q - bins.y)[bins.n >= 40] < 0.12).all() and len(bins) >= 4
    ml.save(model, f"{tmp_path}/model")
    again = ml.load(f"{tmp_path}/model").transform(test).select("i", vector_to_array("probability")[1].alias("q")).toPandas()
    assert np.allclose(again.sort_values("i").q, scored.sort_values("i").q)


def test_training_of_the_winner_selects_among_four(spark, rings, tmp_path):
    rows = rings.filter("i % 5 = 0").withColumn("race_winner", F.col("label")).withColumn("kind", F.when(F.col("i") % 2 == 0, "x").otherwise("y"))
    few = ml.classifiers("race_winner", trees=5, rounds=3) | {"svm": KernelSVM("race_winner", "weight", n_features=40, folds=2, maxIter=10)}
    model, scores = ml.train_winner(rows, ["a", "b"], ["kind"], ["i"], models=few, folds=2)
    assert scores.select("model").distinct().count() == 4 and scores.count() == 4 * 2 * 2
    assert ml.select_model(scores).first().model in ("boosted", "forest", "svm")
    scored, bad = jobs.score_win(rows.unionByName(rows.limit(1).withColumn("a", F.lit(None).cast("double"))), model, ["a", "b"])
    assert bad.count() == 1 and scored.count() == rows.count() and {r.confidence for r in scored.collect()} <= {"high", "medium"}
    assert ml.importances(model, rows).first().feature in ("_scaled_0", "_scaled_1", "_scaled") or ml.importances(model, rows).count() >= 3
    ml.save_metadata(spark, f"{tmp_path}/meta", ["a", "b"], 6, "1")
    meta = spark.read.json(f"{tmp_path}/meta").first()
    assert (meta.n_features, meta.lookback, meta.names) == (2, 6, '["a", "b"]') and meta.created


def test_validation_fits_one_machine_a_fold_and_scores_as_the_calibrated_one(spark, rings, monkeypatch):
    rows = rings.filter("i % 5 = 0").withColumn("fold", (F.col("i") / 5 % 2).cast("int")).cache()
    model, stages = KernelSVM(n_features=40, folds=3, maxIter=10), ml.encoder(["a", "b"], [], scale=True)
    calibrated = {}
    for fold in range(2):
        fitted = ml.train(rows.filter(F.col("fold") != fold), stages, model)
        calibrated[fold] = fitted.transform(rows.filter(F.col("fold") == fold)).agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]
    fits, plain = [], LinearSVC.fit
    monkeypatch.setattr(LinearSVC, "fit", lambda self, df: fits.append(1) or plain(self, df))
    scores = ml.cross_validate(rows, stages, {"svm": model}, "label", folds=2)
    assert len(fits) == 2
    assert {r.fold: r.value for r in scores.filter("metric = 'accuracy'").collect()} == pytest.approx(calibrated, abs=0.01)


def test_validation_overlaps_folds_and_lets_their_rows_go(spark, rings):
    rows = rings.withColumn("fold", (F.col("i") % 5).cast("int"))
    running, most, lock, folds = set(), [], threading.Lock(), []

    class Watched(LogisticRegression):
        def fit(self, df):
            at = df.groupBy().agg(F.sum("fold")).first()[0]
            with lock:
                running.add(at)
                most.append(len(running))
                folds.append(at)
            time.sleep(1)
            fitted = super().fit(df)
            with lock:
                running.discard(at)
            return fitted

    before = spark.sparkContext._jsc.sc().getPersistentRDDs().size()
    scores = ml.cross_validate(rows, ml.encoder(["a", "b"], [], scale=True), {"one": Watched(labelCol="label"), "two": Watched(labelCol="label")}, "label")
    assert scores.count() == 2 * 2 * 5 and max(most) > 1 and sorted(Counter(folds).values()) == [2] * 5
    assert spark.sparkContext._jsc.sc().getPersistentRDDs().size() == before


def test_validation_deals_rows_evenly_and_fits_one_at_a_time_where_they_crowd(spark, rings):
    rows = rings.withColumn("fold", (F.col("i") % 5).cast("int")).coalesce(1)  # all rows in one partition
    running, most, lock, sizes = set(), [], threading.Lock(), []

    class Watched(LogisticRegression):
        def fit(self, df):
            with lock:
                running.add(id(df))
                most.append(len(running))
                sizes.append([r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()])
            time.sleep(0.5)
            fitted = super().fit(df)
            with lock:
                running.discard(id(df))
            return fitted

    two = {"one": Watched(labelCol="label"), "two": Watched(labelCol="label")}
    cores, stages = spark.sparkContext.defaultParallelism, ml.encoder(["a", "b"], [], scale=True)
    scores = ml.cross_validate(rows, stages, two, "label", most=300, crowd=700)  # 3,000 rows: 750 a core on 4
    assert scores.count() == 2 * 2 * 5 and max(most) == 1
    assert all(len(s) == cores * math.ceil(3000 / (cores * 300)) and sum(s) == 2400 and max(s) <= 300 for s in sizes)


def test_accuracy_and_f1_are_those_of_mllib(spark):
    def both(rows):
        scored = spark.createDataFrame(rows, "label double, prediction double")
        theirs = {"accuracy": MulticlassClassificationEvaluator(metricName="accuracy"), "f1": MulticlassClassificationEvaluator(metricName="fMeasureByLabel", metricLabel=1.0)}
        return ml.accuracy_and_f1(scored, "label"), {k: pytest.approx(e.evaluate(scored), abs=1e-12) for k, e in theirs.items()}

    for rows in ([(1.0, 1.0)] * 3 + [(1.0, 0.0)] * 2 + [(0.0, 1.0)] * 5 + [(0.0, 0.0)] * 7, [(1.0, 0.0), (0.0, 0.0)], [(1.0, 1.0)], [(1.0, 0.0), (0.0, 1.0), (2.0, 2.0)]):
        found, expected = both(rows)
        assert found == expected
    empty = ml.accuracy_and_f1(spark.createDataFrame([], "label double, prediction double"), "label")
    assert math.isnan(empty["accuracy"]) and empty["f1"] == 0


def test_boosting_stops_where_held_out_rows_gain_nothing(spark, rings):
    noise = rings.select("i", "a", "b", F.lit("k").alias("kind"), (F.col("a") * 0 + F.randn(3)).alias("LapTime_seconds"))
    _, found = ml.train_lap_time(noise.cache(), ["a", "b"], ["kind"], ["i"], rounds=60)
    assert found.first().rounds < 20
    curve = rings.select("i", "a", "b", F.lit("k").alias("kind"), (F.col("a") * F.col("b") * 3).alias("LapTime_seconds"), (F.col("a") * 5).alias("Position"))
    _, found = ml.train_lap_time(curve, ["a", "b"], ["kind"], ["i"], rounds=15)
    assert found.first().rounds > 5 and found.first().r2 > 0.7
    model = ml.train_position(curve, ["a", "b"], ["kind"], ["i"], rounds=5)
    weights = {r.feature: r.importance for r in ml.importances(model, curve).collect()}
    assert sum(weights.values()) == pytest.approx(1) and len(weights) >= 2 and max(weights.values()) > 0.9


def test_unseen_categories_fail_where_the_first_is_dropped(spark):
    rows = spark.createDataFrame([(1.0, "a", 0.0), (2.0, "b", 1.0), (3.0, "c", 0.0)], "x double, k string, label double")
    from pyspark.ml import Pipeline

    fitted = Pipeline(stages=ml.encoder(["x"], ["k"], unseen="error")).fit(rows)
    assert [r.features.toArray().tolist()[1:] for r in fitted.transform(rows).orderBy("k").collect()] == [[0, 0], [0, 1], [1, 0]]
    with pytest.raises(Exception, match="Unseen label"):
        fitted.transform(spark.createDataFrame([(1.0, "new", 0.0)], rows.schema)).collect()


def test_rates_hold_nothing_of_their_own_fold_or_batch(spark):
    rows = spark.createDataFrame([("a", 0, 1, 1), ("a", 1, 2, 0), ("a", 1, 3, 1), ("b", 0, 1, 1), (None, 0, 1, 1), (None, 1, 2, 0)], "k string, fold int, y int, hit int")
    got = sorted(map(tuple, ml.with_fold_rates(rows, ["k"], F.col("hit") == 1, "rate").select("k", "fold", "y", "rate").collect()), key=str)
    assert got == sorted([("a", 0, 1, 50.0), ("a", 1, 2, 100.0), ("a", 1, 3, 100.0), ("b", 0, 1, None), (None, 0, 1, 0.0), (None, 1, 2, 100.0)], key=str)
    got = sorted(map(tuple, ml.with_past_rates(rows, ["k"], ["y"], F.col("hit") == 1, "rate").select("k", "y", "rate").collect()), key=str)
    assert got == sorted([("a", 1, None), ("a", 2, 100.0), ("a", 3, 50.0), ("b", 1, None), (None, 1, None), (None, 2, 100.0)], key=str)


# stored tails
ROLES = Roles(entity=["who"], order=["day", "n"])


def spec():
    bad = E.flag(F.col("v") < 0)
    return Form(mean={"m": F.col("v")}, least={"least": F.col("v")}, count={"bad": bad}, reliability={"rel": bad}, trend={"trend": F.col("v")})


def history(spark, n=600):
    rng = np.random.default_rng(2)
    rows = [(f"e{rng.integers(0, 25)}" if i % 97 else "rare", int(i // 60), i, None if i % 13 == 0 else float(np.round(rng.normal(), 3))) for i in range(n)]
    return spark.createDataFrame(rows, "who string, day int, n int, v double").cache()


@pytest.mark.parametrize("include_current", [True, False])
def test_form_from_tails_is_that_of_the_whole_history(spark, tmp_path, include_current):
    rows = history(spark)
    state = f"{tmp_path}/state"
    for day in (0, 1, 2, 3, 2, 3, 4, 5, 6, 7, 8, 9):  # days 2 and 3 are run again
        tails.refresh(rows.filter(F.col("day") == day), day, state, ROLES, spec(), 6, include_current, buckets=4)
    want = form.with_form(rows, ROLES, spec(), 6, include_current)
    got = tails.refreshed(spark, state, "form", want.schema)
    a, b = ({r.n: r for r in x.collect()} for x in (got, want))
    assert a.keys() == b.keys() and got.count() == want.count()
    for n, r in a.items():
        assert all(near(x, y) for x, y in zip(r[3:], b[n][3:], strict=True)), n
    sizes = spark.read.parquet(f"{state}/tails/batch=9").groupBy("who").count().agg(F.max("count")).first()[0]
    assert sizes <= 6


def test_late_rows_are_set_aside(spark, tmp_path):
    rows, state = history(spark, 120), f"{tmp_path}/state"
    tails.refresh(rows, 0, state, ROLES, spec(), 6, buckets=4)
    who = rows.filter("day = 1").first().who
    more = spark.createDataFrame([(who, 0, -1, 9.0), (who, 9, 500, 1.0), (None, 9, 1, 1.0), (who, None, 1, 1.0), ("new", 0, 0, 2.0)], rows.schema)
    tails.refresh(more, 1, state, ROLES, spec(), 6, buckets=4)
    late = tails.refreshed(spark, state, "late", rows.schema).collect()
    assert sorted(map(str, late)) == sorted(str(r) for r in more.collect() if (r.who, r.day) in ((who, 0), (None, 9), (who, None)))
    got = spark.read.parquet(f"{state}/form/batch=1").collect()
    assert {r.who for r in got} == {who, "new"} and len(got) == 2
    tails.refresh(rows.limit(0), 2, state, ROLES, spec(), 6, buckets=4)
    assert spark.read.parquet(f"{state}/buckets/batch=2").count() == 4


def test_form_of_a_stream(spark, tmp_path):
    rows = history(spark, 240)
    for day in range(4):
        rows.filter(F.col("day") == day).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
        tails.form_stream(stream, f"{tmp_path}/state", f"{tmp_path}/checkpoint", ROLES, spec(), 6, buckets=4).awaitTermination()
    want = form.with_form(rows, ROLES, spec(), 6)
    got = {r.n: r.m for r in tails.refreshed(spark, f"{tmp_path}/state", "form", want.schema).collect()}
    assert got.keys() == {r.n for r in rows.collect()} and all(near(got[r.n], r.m) for r in want.collect())


# sketches
def test_sketches_of_fifty_batches_keep_their_rank_error(spark, tmp_path):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.lognormal(size=60_000), np.full(20_000, 1.5)])
    rng.shuffle(x)
    rows = spark.createDataFrame(pd.DataFrame({"k": np.where(np.arange(80_000) % 4, "a", "b"), "b": np.arange(80_000) % 50, "v": x})).cache()
    for b in range(50):
        part = rows.filter(F.col("b") == b)
        tables.write_batch(sketches.sketch(part, ["k"], "v"), f"{tmp_path}/s", b)
    tables.write_batch(sketches.sketch(rows.filter(F.col("b") == 7), ["k"], "v"), f"{tmp_path}/s", 7)  # run again: no row twice
    stored = tables.read_batches(spark, f"{tmp_path}/s", sketches.schema(rows, ["k"]))
    whole = sketches.merged(stored, ["k"])
    qs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]
    for r in sketches.quantiles(whole, ["k"], qs).collect():
        own = np.sort(rows.filter(F.col("k") == r.k).toPandas().v.to_numpy())
        assert r.n == len(own) and (r.q[0], r.q[-1]) == (own[0], own[-1])
        for q, at in zip(qs, r.q, strict=True):
            low, high = np.searchsorted(own, at) / len(own), np.searchsorted(own, at, "right") / len(own)
            assert low - sketches.RANK_ERROR <= q <= high + sketches.RANK_ERROR
    flags = sketches.flagged(spark.createDataFrame([("a", 1e6), ("a", 1.0), ("z", 1.0), ("a", None)], "k string, v double"), sketches.fences(whole, ["k"]), ["k"], "v")
    assert sorted((str(r.k), r.v, r.outlier) for r in flags.filter("v is not null").collect()) == [("a", 1.0, False), ("a", 1e6, True), ("z", 1.0, None)]
    assert flags.filter("v is null").first().outlier is None
    assert sketches.sketch(rows.limit(0), ["k"], "v").collect() == []


# samples
def test_samples_do_not_depend_on_layout_and_merge(spark):
    rows = spark.range(5000).select("id", (F.col("id") % 7).alias("s"))
    one = samples.exactly(rows, 50, ["id"]).collect()
    assert one == samples.exactly(rows.repartition(13, F.rand(1)), 50, ["id"]).collect() and len(one) == 50
    parts = [samples.bottom(rows.filter(F.col("id") % 3 == k), 50, ["id"]) for k in range(3)]
    both = samples.merged(samples.merged(parts[0], parts[1], 50, ["id"]), parts[2], 50, ["id"])
    assert [r.id for r in both.collect()] == [r.id for r in one]
    assert samples.exactly(rows, 4, ["id"], strata=["s"]).groupBy("s").count().filter("count = 4").count() == 7
    for n, strata in ((5001, ()), (800, ["s"])):
        with pytest.raises(ValueError):
            samples.exactly(rows, n, ["id"], strata=strata)
    pairs = reports.sample_pairs(rows.withColumn("y", F.col("id") * 2), "id", "y", ["id"], 10)
    assert all(r.y == 2 * r.id for r in pairs.collect()) and pairs.count() == 10


def test_bootstrap_interval_is_repeatable_and_near_the_normal_one(spark):
    rng = np.random.default_rng(4)
    rows = spark.createDataFrame(pd.DataFrame({"id": range(4000), "k": np.where(np.arange(4000) % 5, "a", "b"), "v": rng.normal(10, 3, 4000)}))
    rows = rows.unionByName(spark.createDataFrame([(9000, None, 1.0), (9001, "a", None), (9002, "one", 4.0)], rows.schema))
    boot = {r.k: r for r in reports.mean_with_interval(rows, "k", "v", ["id"]).collect()}
    again = {r.k: r for r in reports.mean_with_interval(rows.repartition(9), "k", "v", ["id"]).collect()}
    normal = {r.k: r for r in reports.mean_with_interval(rows, "k", "v").collect()}
    assert boot.keys() == normal.keys() == {"a", "b", "one"}
    for k in "ab":
        width = normal[k].high - normal[k].low
        assert boot[k].mean == pytest.approx(normal[k].mean)
        assert abs(boot[k].low - normal[k].low) < 0.15 * width and abs(boot[k].high - normal[k].high) < 0.15 * width
        assert again[k].low == pytest.approx(boot[k].low) and again[k].high == pytest.approx(boot[k].high)
    assert (boot["one"].low, boot["one"].high) == (4.0, 4.0)
    steps = samples.poisson_steps()
    assert sum(65536 - s for s in steps) / 65536 == pytest.approx(1, abs=1e-3)


# band join
def test_neighbours_over_buckets_and_gaps(spark):
    rng = np.random.default_rng(5)
    rows = []
    for batch in ("x", "y", None):
        clock = np.concatenate([rng.uniform(0, 3, 60), rng.uniform(1000, 1001, 20), [5e5, -7.0], np.full(10, 2.5)])
        rows += [(batch, i + 1000 * len(rows), float(np.round(c, 2))) for i, c in enumerate(clock)] + [(batch, -1 - len(rows), None), (batch, -2 - len(rows), None)]
    df = spark.createDataFrame(rows, "batch string, id long, clock double")
    got = {(r.batch, r.id): r for r in laps.neighbours(df.repartition(5), ["batch"], "clock", "id", 0.5).collect()}
    assert len(got) == len(rows)
    for batch in ("x", "y", None):
        own = sorted(((c, i) for b, i, c in rows if b == batch and c is not None))
        for k, (c, i) in enumerate(own):
            r = got[batch, i]
            ahead = c - own[k - 1][0] if k else None
            assert near(r.gap_ahead, ahead) and near(r.gap_behind, own[k + 1][0] - c if k + 1 < len(own) else None)
            assert r.traffic == sum(c - 0.5 <= o <= c + 0.5 for o, _ in own) - 1 and r.in_reach == int(ahead is not None and ahead < 1)
        assert all(r.gap_ahead is None and r.gap_behind is None for (b, _), r in got.items() if b == batch and r.clock is None)


def test_a_batch_of_neighbours_is_dealt_to_many_tasks(spark):
    df = spark.range(4000).select(F.lit(1).alias("batch"), "id", (F.col("id") * 1.0).alias("clock"))
    out = laps.neighbours(df, ["batch"], "clock", "id", 0.5)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        parts = laps.neighbours(df, ["batch"], "clock", "id", 0.5).withColumn("p", F.spark_partition_id()).groupBy("p").count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(parts) == 4 and max(r["count"] for r in parts) < 1600
    assert out.filter("gap_ahead <> 1 or gap_behind <> 1 or traffic <> 0").count() == 0


# correlations
def test_five_hundred_columns(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 500)) @ rng.normal(size=(500, 500)) * 0.1 + 1e6
    x[rng.random(x.shape) < 0.1] = np.nan
    x[:, 17] = 3.0
    x[:, 18] = np.nan
    x[2:, 19] = np.nan
    frame = pd.DataFrame(x, columns=[f"c{i}" for i in range(500)])
    df = spark.createDataFrame(frame).select(*[E.no_nan(F.col(c)).alias(c) for c in frame.columns])
    got = {(r.a, r.b): r.r for r in stats.correlations(df.repartition(6), df.columns).collect()}
    want = frame.corr(min_periods=2).to_numpy()
    assert len(got) == 500 * 499 // 2
    for i in range(500):
        for j in range(i + 1, 500):
            r = got[f"c{i}", f"c{j}"]
            assert (r is None) if 17 in (i, j) or 18 in (i, j) else (r is None and math.isnan(want[i, j])) or r == pytest.approx(want[i, j], abs=1e-6)
    few = [f"c{i}" for i in range(20, 30)]
    narrow = {(r.a, r.b): r.r for r in stats.correlations(df, few, listwise=True).collect()}
    wide = {(r.a, r.b): r.r for r in stats.wide_correlations(df.dropna("any", subset=few), few, block=3).collect()}
    assert narrow.keys() == wide.keys() and all(near(narrow[k], wide[k]) for k in narrow)


# files
def test_headers_that_change_within_a_file(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.csv").write_text(
        "stray line\n<<<<<<< one\nYear,Race,Driver,Team,Position,GridPosition,Points,Status\n2024,1,VER,Red,1.0,2.0,25,Finished\n2024,1,HAM,\"Mer,c\",,3,0.0,Lapped\n=======\n"
        "Driver,Year,Race,Points,Position\nVER,2023,9,18.0,2.0\nbroken,2023\nNOR,2023,9,NaN,x\n\n>>>>>>> two\n"
    )
    (tmp_path / "in/b.csv").write_text('Status,Year,Race,Driver\r\nRetired,2022,3,ALO\r\n"Did not start",2022,3,"BOT"\r\n')
    good, bad = tables.read_headed_csv(spark, f"{tmp_path}/in", tables.RESULTS)
    rows = sorted(map(tuple, good.collect()), key=str)
    assert rows == sorted([(2024, 1, "VER", "Red", 1.0, 2.0, 25.0, "Finished"), (2024, 1, "HAM", "Mer,c", None, 3.0, 0.0, "Lapped"), (2023, 9, "VER", None, 2.0, None, 18.0, None), (2022, 3, "ALO", None, None, None, None, "Retired"), (2022, 3, "BOT", None, None, None, None, "Did not start")], key=str)
    assert sorted(r[0].strip() for r in bad.collect()) == ["<<<<<<< one", "=======", ">>>>>>> two", "NOR,2023,9,NaN,x", "broken,2023", "stray line"]
    assert good.select("Driver").count() == 5 and good.filter("Points = 18").select("Year").first()[0] == 2023
    with pytest.raises(ValueError):
        tables.read_headed_csv(spark, f"{tmp_path}/in", tables.RESULTS, most_layouts=2)


def test_a_batch_that_comes_again_replaces_itself(spark, tmp_path):
    schema = "Year int, Race int, Driver string, Points double"
    deliver = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def take():
        streams.ingest_corrected(spark, f"{tmp_path}/in", spark.createDataFrame([], schema).schema, f"{tmp_path}/out", f"{tmp_path}/c", ["Year", "Race"]).awaitTermination()
        return sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").select("Year", "Race", "Driver", "Points").collect()))

    deliver([(2024, 1, "a", 1.0), (2024, 1, "b", 2.0), (2024, 2, "a", 3.0)])
    assert take() == [(2024, 1, "a", 1.0), (2024, 1, "b", 2.0), (2024, 2, "a", 3.0)]
    deliver([(2024, 1, "a", 10.0)])
    deliver([(2024, 3, "c", 5.0)])
    assert take() == [(2024, 1, "a", 10.0), (2024, 2, "a", 3.0), (2024, 3, "c", 5.0)]
    assert take() == [(2024, 1, "a", 10.0), (2024, 2, "a", 3.0), (2024, 3, "c", 5.0)]


def test_the_last_of_two_deliveries_in_one_batch_counts(spark):
    rows = spark.createDataFrame([(1, "old", 1, "f1"), (1, "new", 2, "f2"), (1, "new2", 2, "f2"), (None, "x", 1, "f1"), (2, "only", 1, "f1")], "k int, v string, t int, f string")
    assert sorted(r.v for r in tables.latest_delivery(rows, ["k"], "t", "f").collect()) == ["new", "new2", "only", "x"]


def test_a_delivery_of_several_files_counts_whole(spark, tmp_path):
    rows = spark.createDataFrame([(1, "old", 1, "d1"), (1, "old2", 4, "d1"), (1, "a", 2, "d2"), (1, "b", 5, "d2"), (2, "c", 3, "d2"), (2, "d", 1, "d1"), (None, "x", 1, "d1")], "k int, v string, t int, f string")
    assert sorted(r.v for r in tables.latest_delivery(rows, ["k"], "t", "f").collect()) == ["a", "b", "c", "x"]
    schema = "k int, v int"
    deliver = lambda name, ids, v, mode="error": spark.createDataFrame([(i % 2, v + i) for i in ids], schema).repartition(3).write.mode(mode).parquet(f"{tmp_path}/in/{name}")

    def take():
        streams.ingest_corrected(spark, f"{tmp_path}/in", spark.createDataFrame([], schema).schema, f"{tmp_path}/out", f"{tmp_path}/c", ["k"], folders=True).awaitTermination()
        return sorted(r.v for r in spark.read.parquet(f"{tmp_path}/out").collect())

    deliver("day=1 new", range(12), 0)
    assert take() == [*range(12)]
    deliver("b", range(12), 100)
    deliver("a", range(0, 12, 2), 200)
    once = sorted([*range(200, 212, 2), *range(101, 112, 2)])
    assert take() == take() == once
    deliver("c", range(0, 6, 2), 300)
    assert take() == sorted([*range(300, 306, 2), *range(101, 112, 2)])
    deliver("c", range(6, 12, 2), 300, "append")  # the rest of the same delivery
    assert take() == sorted([*range(300, 312, 2), *range(101, 112, 2)])


def test_raw_records_and_their_columns(spark, tmp_path):
    raw = spark.sql("select 2024 y, 1 rnd, 'VER' drv, interval '0 00:01:19.455' day to second q1, 1 pos")
    got = tables.normalised(raw, {"Year": "y", "Race": "rnd", "Driver": "drv", "Q1": "q1", "QualifyingPosition": "pos"}, tables.QUALIFYING, ["Q1", "Q2", "Q3"]).first()
    assert (got.Year, got.Race, got.Driver, got.Team, got.QualifyingPosition, got.Q1, got.Q2) == (2024, 1, "VER", None, 1.0, 79.455, None)
    laps_row = tables.normalised(spark.sql("select interval '0 00:01:30.5' day to second t, 3 n"), {"LapTime_seconds": "t", "LapNumber": "n"}, tables.LAPS, ["LapTime_seconds"]).first()
    assert (laps_row.LapTime_seconds, laps_row.LapNumber, laps_row.Team) == (90.5, 3.0, None)
    df, missing = validate.tolerant(spark.createDataFrame([(1, 2)], "a int, b int"), ["b", "c", "a"])
    assert df.columns == ["b", "a"] and missing == ["c"]
    assert [tuple(r) for r in stats.column_types(df).collect()] == [("b", "int"), ("a", "int")]
    assert stats.head(tables.rows_of(spark, [(2, 1), (1, 2)], df.schema), 1, "b").first().b == 1
    tables.write(df, f"{tmp_path}/csv", "csv", ["a"])
    assert spark.read.option("header", True).csv(f"{tmp_path}/csv").columns == ["b", "a"]


# whole jobs
def season(spark):
    rng = np.random.default_rng(7)
    results, quali, lap = [], [], []
    for race in range(1, 9):
        order = rng.permutation(6)
        for place, d in enumerate(order.tolist(), 1):
            results.append((2024, race, f"D{d}", f"T{d // 2}", float(place), float((place + race) % 6 + 1), float(max(0, 10 - place)), "Finished" if place < 6 else "Retired"))
            quali.append((2024, race, f"D{d}", f"T{d // 2}", float(place), 80.0 + place, None if place > 4 else 79.0 + place, None if place > 2 else 78.0 + place, None))
            lap += [(2024, race, f"D{d}", f"T{d // 2}", float(n), None if n == 3 else 90.0 + place + n / 10, float(place) if n > 1 else None, None if n == 2 else "SOFT", None if n == 4 else float(n)) for n in range(1, 6)]
    make = spark.createDataFrame
    return make(results, tables.RESULTS), make(quali, tables.QUALIFYING), make(lap, tables.LAPS)


def test_cleaning_features_and_scoring_from_end_to_end(spark, tmp_path):
    results, quali, lap = season(spark)
    cleaned = jobs.clean(lap, results, quali)
    q = cleaned["qualifying"].collect()
    assert all(None not in (r.Q1, r.Q2, r.Q3, r.BestQualifyingTime, r.GapToPole, r.QualifyingPerformance) for r in q) and min(r.GapToPole for r in q) == 0
    assert all(r.BestQualifyingTime == min(r.Q1, r.Q2, r.Q3) for r in q)
    assert cleaned["results"].count() == 48 and cleaned["results"].filter("GapToPole is null").count() == 0
    l = cleaned["laps"].collect()
    assert len(l) == 240 and all(None not in (r.LapTime_seconds, r.Position, r.TireCompound, r.TireAge) for r in l)
    assert cleaned["outliers"].first().outliers >= 0
    with pytest.raises(ValueError):
        jobs.clean(lap, results, quali.union(quali.limit(1)))

    features = jobs.result_features(cleaned["results"]).cache()
    made = jobs.lap_features(cleaned["laps"], cleaned["results"])
    assert {"start_position", "positions_gained", "tire_degradation", "race_phase", "driver_win_rate", "team_reliability"} <= set(made.columns)
    assert made.filter("tire_degradation is null or race_phase is null or team_reliability is null").count() == 0
    assert made.filter("positions_gained <> start_position - Position").count() == 0

    rolled = jobs.result_form(features, 3)
    numeric = ["avg_position_last", "avg_grid_last", "points_last"]
    position = ml.train_position(rolled, numeric, ["Team"], ["Year", "Race", "Driver"], rounds=3)
    ml.save(position, f"{tmp_path}/position")
    model = PipelineModel.load(f"{tmp_path}/position")
    both = features.unionByName(features.withColumn("Year", F.lit(2023)).withColumn("Driver", F.lit("OLD")))
    scored = jobs.score_next_event(both, model, 3, season=2024).collect()
    assert len(scored) == 6 and [r.predicted_position for r in scored] == sorted(r.predicted_position for r in scored) and "OLD" not in {r.driver for r in scored}
    form_row = rolled.filter("Driver = 'D1' and Race = 8").first()
    record = next(r.recent_form for r in scored if r.driver == "D1")
    rates = features.filter("Driver = 'D1'").first()
    assert len(record) == 10 and record.wins == form_row.wins_last and record.podiums == form_row.podiums_last and record.dnfs == form_row.dnf_last
    assert record.avg_position == round(form_row.avg_position_last, 2) and record.best_position == form_row.best_position_last
    assert record.team_reliability == round(rates.team_reliability, 1) and record.driver_win_rate == round(rates.driver_win_rate * 100, 1)

    laps_model, metrics = ml.train_lap_time(made, ["LapNumber", "TireAge", "Position"], ["TireCompound", "race_phase"], ["Year", "Race", "Driver", "LapNumber"], rounds=8)
    assert metrics.first().mae < 2 and metrics.first().error_percent < 3
    request = spark.createDataFrame([("SOFT", 2.0, 3.0, 3.0, "Early"), ("hard", 60.0, 5.0, 3.0, "Late"), ("odd", 1.0, 1.0, 1.0, "Early")], "TireCompound string, TireAge double, LapNumber double, Position double, race_phase string")
    got = {r.TireCompound: r for r in jobs.score_lap_time(request, laps_model).collect()}
    assert (got["SOFT"].wear, got["SOFT"].fresh, got["SOFT"].life_left) == (5.0, True, 38)
    assert (got["hard"].wear, got["hard"].fresh, got["hard"].life_left) == (100.0, False, 0) and got["odd"].life_left == 49
    assert all(r.formatted == f"{int(r.lap_time // 60)}:{r.lap_time % 60:06.3f}" for r in got.values())

    rolled.write.parquet(f"{tmp_path}/stream")
    stream = spark.readStream.schema(rolled.schema).parquet(f"{tmp_path}/stream")
    scored = streams.scored(stream, lambda df: model.transform(df).select("Year", "Race", "Driver", "prediction"), ["avg_position_last"])
    scored.writeStream.format("parquet").option("path", f"{tmp_path}/scored").option("checkpointLocation", f"{tmp_path}/sc").trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/scored").count() == 48
