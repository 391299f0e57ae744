import pytest
from pyspark.sql import functions as F

from stintframe.functions import exprs as E
from stintframe.operators import form, impute, laps, stats, validate
from stintframe.operators.form import Roles
from stintframe.plans import jobs, ml
from stintframe.sources import tables

RESULTS = [(2025, 16 + i, "A", "T", float(p), float(g), float(n), "Finished") for i, (p, g, n) in enumerate(zip([1, 1, 2, 1, 3, 3, 1, 1, 1], [1, 1, 2, 1, 5, 19, 2, 3, 1], [25, 25, 18, 25, 15, 15, 25, 25, 25], strict=True))]


def test_form_of_a_known_sequence(spark):
    rows = jobs.result_form(spark.createDataFrame(RESULTS, tables.RESULTS), 6).orderBy("Race").collect()
    assert [round(r.avg_position_last, 6) for r in rows] == [1, 1, 1.333333, 1.25, 1.6, 1.833333, 1.833333, 1.833333, 1.666667]
    assert [None if r.form_trend is None else round(r.form_trend, 6) for r in rows] == [None, None, None, -0.333333, -1, -1, -1, 0.333333, 1.333333]
    last = rows[-1]
    assert (last.best_position_last, last.dnf_last, last.reliability, last.podiums_last, last.points_last) == (1, 0, 1.0, 6, 130)


def test_lookback_of_three_has_no_trend_and_bounds_are_checked(spark):
    df = spark.createDataFrame(RESULTS, tables.RESULTS)
    assert {r.form_trend for r in jobs.result_form(df, 3).collect()} == {0.0}
    with pytest.raises(ValueError):
        jobs.result_form(df, 13)


def test_form_needs_one_exchange(spark):
    plan = jobs.result_form(spark.createDataFrame(RESULTS, tables.RESULTS), 6)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    assert "Python" not in plan


def test_labels_and_bins_at_their_edges(spark):
    rows = spark.createDataFrame([(None,), (0.0,), (5.0,), (20.0,), (21.0,)], "p double")
    got = rows.select(E.at_most(F.col("p"), 3), E.binned(F.col("p"), [0, 5, 10, 20], ["a", "b", "c"])).collect()
    assert [tuple(r) for r in got] == [(0, None), (1, None), (0, "a"), (0, "c"), (0, None)]


def test_mode_takes_the_smallest_on_ties_and_the_default(spark):
    rows = spark.createDataFrame([(1, "b"), (1, "a"), (1, None), (2, None), (None, "c"), (None, None)], "k int, v string")
    got = {(r.k, r.v) for r in impute.group_mode(rows, ["k"], "v", "MEDIUM").collect()}
    assert got == {(1, "a"), (1, "b"), (2, "MEDIUM"), (None, "c")}


def test_median_falls_back_to_all_rows(spark):
    rows = spark.createDataFrame([(1, 2.0), (1, 4.0), (1, None), (2, None)], "k int, v double")
    assert sorted((r.k, r.v) for r in impute.group_median(rows, ["k"], ["v"]).collect()) == [(1, 2.0), (1, 3.0), (1, 4.0), (2, 3.0)]


def test_qualifying_by_hand(spark):
    q = spark.createDataFrame([(1, 1, "A", "T", 1.0, 80.0, 79.0, 78.0, None), (1, 1, "B", "T", 11.0, 79.5, 79.4, None, None)], tables.QUALIFYING)
    a, b = jobs.clean_qualifying(q).orderBy("Driver").collect()
    assert (a.BestQualifyingTime, a.GapToPole, a.QualifyingPerformance) == (78.0, 0.0, 5.0)
    assert (b.Q3, b.BestQualifyingTime, b.GapToPole) == (78.0, 78.0, 0.0)


def test_result_features(spark):
    rows = spark.createDataFrame([(1, 1, "A", "T", 1.0, 2.0, 25.0, "Finished"), (1, 2, "A", "T", 4.0, 1.0, 12.0, None), (1, 1, "B", "T", None, 3.0, 0.0, "Retired")], tables.RESULTS)
    got = {(r.Driver, r.Race): r for r in jobs.result_features(rows).collect()}
    assert got["A", 1].driver_win_rate == 50.0 and got["A", 1].PositionChange == 1.0 and got["A", 1].race_winner == 1
    assert round(got["B", 1].team_reliability, 4) == 33.3333 and got["B", 1].podium_finish == 0


def test_csv_with_broken_lines(spark, tmp_path):
    (tmp_path / "r.csv").write_text("Year,Race,Driver,Team,Position,GridPosition,Points,Status\n<<<<<<< HEAD\n2025,1,A,T,NaN,1,25,Finished\n2025,1,B,T,2,1,18,Finished\n=======\n")
    good, bad = tables.read_csv(spark, str(tmp_path / "r.csv"), tables.RESULTS)
    assert sorted((r.Driver, r.Position) for r in good.collect()) == [("A", None), ("B", 2.0)]
    assert bad.count() == 2


def test_missing_tables(spark, tmp_path):
    df, there = tables.optional(spark, str(tmp_path / "none"), tables.LAPS)
    assert not there and df.count() == 0
    with pytest.raises(tables.SourceMissing):
        tables.required(spark, str(tmp_path / "none"), tables.LAPS)


def test_unique_keys_and_validation(spark):
    rows = spark.createDataFrame([(1, None), (1, "x")], "k int, v string")
    with pytest.raises(ValueError):
        validate.assert_unique(rows, ["k"])
    good, bad = validate.split_valid(rows, ["k", "v", "absent"])
    assert good.count() == 0 and {tuple(r._errors) for r in bad.collect()} == {("v", "absent"), ("absent",)}


def test_folds_are_stratified(spark):
    rows = spark.range(179).withColumn("y", (F.col("id") < 9).cast("int"))
    sizes = {}
    for r in ml.with_fold(rows, "y", ["id"]).groupBy("y", "fold").count().collect():
        sizes.setdefault(r.y, []).append(r["count"])
    assert sorted(sizes[0]) == [34] * 5 and sorted(sizes[1]) == [1, 2, 2, 2, 2]


def test_form_does_not_depend_on_partitioning(spark):
    rows = spark.range(200).select((F.col("id") % 7).alias("e"), F.col("id").alias("t"), F.hash("id").cast("double").alias("v"))
    roles = Roles(entity=["e"], order=["t"])
    spec = form.Form(mean={"m": F.col("v")}, trend={"d": F.col("v")})
    one, many = (form.with_form(rows.repartition(k), roles, spec, 6).orderBy("t").collect() for k in (1, 7))
    assert one == many


def test_empty_tables(spark):
    empty = spark.createDataFrame([], tables.RESULTS)
    assert jobs.result_form(empty).count() == 0
    assert jobs.result_features(empty).count() == 0
    assert stats.histogram(empty, "Position").count() == 0


def test_laps_are_filled_from_the_driver_itself(spark):
    rows = [(1, 1, "A", "T", float(n), t, None, None, None) for n, t in ((1, 80.0), (2, 80.0), (3, None))]
    rows += [(1, 1, d, "U", float(n), 100.0, 4.0, "SOFT", 2.0) for d in "BCD" for n in (1, 2, 3)]
    rows += [(1, 2, "E", "T", 1.0, None, None, None, None), (1, 1, "A", "T", 4.0, 82.0, 3.0, "HARD", 1.0), (1, 1, "A", "T", 5.0, 80.0, None, "HARD", 1.0)]
    got = {(r.Race, r.Driver, r.LapNumber): r for r in jobs.clean_laps(spark.createDataFrame(rows, tables.LAPS)).collect()}
    assert got[1, "A", 3.0].LapTime_seconds == 80.0 and got[2, "E", 1.0].LapTime_seconds == 100.0
    assert (got[1, "A", 1.0].Position, got[1, "A", 5.0].Position, got[1, "A", 1.0].TireAge) == (15.0, 3.0, 0.0)
    assert (got[1, "A", 3.0].TireCompound, got[2, "E", 1.0].TireCompound) == ("SOFT", "MEDIUM")


def test_supplied_lap_columns_stay(spark):
    rows = [("SOFT", 10, None, None, 90.0, 91.0, 92.0), ("soft", 2, 30, 7.5, None, 91.0, 92.0), (None, 100, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "TireCompound string, TireAge int, MaxTireLife int, TireWearPct double, RollingAvgLapTime_3 double, RollingAvgLapTime_5 double, TeamAvgPace double")
    a, b, c = jobs.lap_defaults(df).collect()
    assert (a.TireCompound_encoded, a.MaxTireLife, a.TireLifeRemaining, a.TireWearPct, a.OldTiresIndicator, a.IsFreshTire) == (1, 40, 30, 25.0, 0, 0)
    assert (a.RollingAvgLapTime_3, a.TeamAvgPace, a.StintLapNumber, a.TireDegradationRate) == (90.0, 92.0, 10, 0.0)
    assert (b.MaxTireLife, b.TireLifeRemaining, b.TireWearPct, b.IsFreshTire, b.RollingAvgLapTime_5, b.TeamAvgPace) == (30, 28, 7.5, 1, 95.0, 95.0)
    assert (c.TireCompound_encoded, c.MaxTireLife, c.TireLifeRemaining, c.TireWearPct, c.OldTiresIndicator) == (2, 50, 0, 100.0, 1)


def test_next_event_record(spark):
    rows = [*RESULTS, (2025, 24, "N", "U", None, 3.0, 0.0, "Retired"), (2025, 24, "B", "U", 4.0, 3.0, 12.0, "Finished"), (2024, 1, "Old", "U", 1.0, 1.0, 25.0, "Finished")]
    out = jobs.score_next_event(spark.createDataFrame(rows, tables.RESULTS), season=2025).collect()
    assert [(r.driver, r.team, r.predicted_position, r.confidence) for r in out] == [("A", "T", 1.67, 0.85), ("B", "U", 4.0, 0.85)]
    assert out[0].recent_form.asDict() == {"avg_position": 1.67, "best_position": 1, "podiums": 6, "wins": 4, "dnfs": 0, "reliability": 100.0, "form_trend": 1.33, "driver_win_rate": None, "team_reliability": None, "quali_performance": None}
    assert out[1].recent_form.form_trend is None and out[0].next_event == "Next event (based on last 6 events)"


def test_exact_quantiles_in_brackets(spark):
    rows = spark.range(60_000).select((F.col("id") % 3).alias("k"), F.when(F.col("id") % 11 != 0, F.pmod(F.hash("id"), F.lit(5000)) / 7.0).alias("v"))
    rows = rows.union(spark.createDataFrame([(None, 1.0), (None, 4.0), (9, None)], "k long, v double"))
    for keys in ([], ["k"]):
        got = {tuple(r[k] for k in keys): r.q for r in stats.exact_quantiles(rows, keys, "v", [0.1, 0.5, 0.99], accuracy=500).collect()}
        want = {tuple(r[k] for k in keys): r.q for r in rows.filter("v is not null").groupBy(*keys).agg(F.percentile("v", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.99))).alias("q")).collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    assert stats.exact_quantiles(rows.limit(0), ["k"], "v", [0.5]).count() == 0
    assert stats.exact_quantiles(rows.limit(0), [], "v", [0.5]).first().q is None


def test_phases_have_names_and_numbers(spark):
    rows = spark.createDataFrame([(0.0,), (1.0,), (15.0,), (16.0,), (41.0,)], "lap double")
    got = rows.select(laps.phase(F.col("lap")), laps.phase_code(F.col("lap"))).collect()
    assert [tuple(r) for r in got] == [(None, None), ("Early", 0), ("Early", 0), ("Middle", 1), ("Late", 2)]


def test_columns_with_odd_names(spark):
    rows = spark.createDataFrame([(1, 1.0, 1), (1, 1.2, 2), (1, 9.0, 3)], "`the batch` int, `a clock` double, tie int")
    assert sorted(r.traffic for r in laps.neighbours(rows, ["the batch"], "a clock", "tie", 0.5).collect()) == [0, 1, 1]
