"""Batch jobs: cleaning, feature building and scoring of result, lap and qualifying tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as E
from ..operators import form, impute, laps, stats, validate
from ..operators.form import Form, Roles

BATCH = ["Year", "Race"]
KEYS = [*BATCH, "Driver"]
RESULT_ROLES = Roles(entity=["Driver"], order=BATCH, batch=BATCH, group=["Team"])
SESSIONS = ["Q1", "Q2", "Q3"]


def clean_qualifying(qualifying: DataFrame, batch: Sequence[str] = BATCH, impute_sessions: bool = True, field: int = 20) -> DataFrame:
    """Session times to the batch's median, best time, gap to the batch's best, scaled position."""
    q = impute.group_median(qualifying, batch, SESSIONS) if impute_sessions else qualifying
    q = q.withColumn("BestQualifyingTime", E.row_least(*map(F.col, SESSIONS)))
    q = form.gap_to_best(q, batch, "BestQualifyingTime", "GapToPole")
    return q.withColumn("QualifyingPerformance", E.scaled(F.col("QualifyingPosition"), field))


def clean_laps(table: DataFrame) -> DataFrame:
    """Lap times to the driver's median in the batch, compounds to the batch's mode, ages to 0, positions forward within the
    driver, else 15."""
    out = impute.group_median(table, KEYS, ["LapTime_seconds"])
    out = impute.group_mode(out, BATCH, "TireCompound", "MEDIUM")
    out = impute.constants(out, {"TireAge": 0.0})
    return form.forward_fill(out, Roles(entity=KEYS, order=["LapNumber"]), "Position", 15.0)


def clean(table: DataFrame, results: DataFrame, qualifying: DataFrame) -> dict[str, DataFrame]:
    """Cleaned laps, results with their qualifying columns, qualifying, and the lap times' outliers (reported, not removed)."""
    q = clean_qualifying(qualifying)
    extra = ["BestQualifyingTime", "GapToPole", "QualifyingPerformance"]
    lap_rows = clean_laps(table)
    validate.assert_unique(q, KEYS)  # a repeated row would double a result
    return {"laps": lap_rows, "results": results.join(q.select(*KEYS, *extra), KEYS, "left"), "qualifying": q, "outliers": stats.outliers(lap_rows, "LapTime_seconds")}


def result_features(results: DataFrame) -> DataFrame:
    """Places gained, the driver's win rate, the team's finish rate (0 to 100), and outcome labels."""
    position = F.col("Position")
    wins = stats.by_key(results, ["Driver"], driver_win_rate=stats.rate(position == 1))
    finished = stats.by_key(results, ["Team"], team_reliability=stats.rate(F.col("Status") == "Finished"))
    out = results.withColumn("PositionChange", E.difference(F.col("GridPosition"), position))
    out = validate.look_up(out, wins, "Driver", {"driver_win_rate": 0.0})
    out = out.join(finished, "Team", "left")
    labels = {"race_winner": 1, "podium_finish": 3, "points_finish": 10}
    return out.withColumns({n: E.at_most(position, k) for n, k in labels.items()})


def lap_features(table: DataFrame, results: DataFrame) -> DataFrame:
    """Laps with start position, places gained, tire degradation, phase and the rates of driver and team."""
    rates = result_features(results)
    out = form.from_start(table, Roles(entity=KEYS, order=["LapNumber"]), "Position")
    out = out.withColumnsRenamed({"start": "start_position", "gained": "positions_gained"})
    out = form.step(out, Roles(entity=[*KEYS, "TireCompound"], order=["LapNumber"]), "LapTime_seconds", "tire_degradation")
    out = impute.global_median(out, "tire_degradation")
    out = out.withColumn("race_phase", laps.phase(F.col("LapNumber")))
    out = validate.look_up(out, rates.groupBy("Driver").agg(F.max("driver_win_rate").alias("driver_win_rate")), "Driver", {"driver_win_rate": 0.0})
    return out.join(rates.groupBy("Team").agg(F.max("team_reliability").alias("team_reliability")), "Team", "left")


def result_form(results: DataFrame, n: int = 6, include_current: bool = True) -> DataFrame:
    """All form columns of results."""
    position = F.col("Position")
    form.check_lookback(n)
    has = set(results.columns)
    optional = {"avg_quali_time": "BestQualifyingTime", "avg_gap_to_pole": "GapToPole"}
    spec = Form(
        mean={"avg_position_last": position, "avg_grid_last": F.col("GridPosition"), "avg_positions_gained": F.col("GridPosition") - position} | {k: F.col(c) for k, c in optional.items() if c in has},
        least={"best_position_last": position},
        total={"points_last": F.col("Points")},
        count={"dnf_last": E.unfinished(F.col("Status")), "podiums_last": E.at_most(position, 3), "wins_last": E.at_most(position, 1)},
        reliability={"reliability": E.unfinished(F.col("Status"))},
        trend={"form_trend": position},
    )
    return form.with_form(results, RESULT_ROLES, spec, n, include_current)


def score_next_event(results: DataFrame, model: PipelineModel | None = None, n: int = 6, season: int | None = None, k: int = 20) -> DataFrame:
    """Each driver's predicted position from the latest form, best first; without a model the mean position is the forecast.

    Drivers without a mean position are left out.  Rates that the table lacks are null in ``recent_form``.  ``driver_win_rate``
    is shown times 100, as callers know it, whatever its unit.  ``confidence`` is a constant.
    """
    rows = results if season is None else results.filter(F.col("Year") == season)
    rolled = result_form(rows, n)
    columns = [c for c in rolled.columns if c not in ("Driver", *BATCH)]
    last = form.latest(rolled, RESULT_ROLES, columns).filter(F.col("avg_position_last").isNotNull())
    scored = model.transform(last).withColumnRenamed("prediction", "predicted") if model else last.withColumn("predicted", F.col("avg_position_last"))

    def shown(c: str, digits: int, times: float = 1.0):
        return F.round(F.col(c) * times, digits) if c in rolled.columns else F.lit(None).cast("double")

    record = E.packed(
        avg_position=shown("avg_position_last", 2),
        best_position=F.col("best_position_last").cast("int"),
        podiums=F.col("podiums_last").cast("int"),
        wins=F.col("wins_last").cast("int"),
        dnfs=F.col("dnf_last").cast("int"),
        reliability=shown("reliability", 1, 100.0),
        form_trend=shown("form_trend", 2),
        driver_win_rate=shown("driver_win_rate", 1, 100.0),
        team_reliability=shown("team_reliability", 1),
        quali_performance=shown("QualifyingPerformance", 2),
    )
    out = scored.select(F.round("predicted", 2).alias("predicted_position"), F.col("Driver").alias("driver"), F.col("Team").alias("team"), F.lit(0.85).alias("confidence"), record.alias("recent_form"))
    out = stats.top_k(out, k, "predicted_position", "driver", ascending=True)
    made = F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm").alias("prediction_date")
    return out.select("*", made, F.lit(f"Next event (based on last {n} events)").alias("next_event"))


def score_win(df: DataFrame, model: PipelineModel, required: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Scored rows and the rejected ones with their errors."""
    good, bad = validate.split_valid(df, required)
    p = vector_to_array("probability")[1]
    kept = [*df.columns]
    scored = model.transform(good).select(*kept, (F.col("prediction") == 1).alias("will_win"), F.round(p, 4).alias("win_probability"), E.confidence(p).alias("confidence"))
    return scored, bad


def lap_defaults(df: DataFrame, pace: float = 95.0) -> DataFrame:
    """The optional lap columns, derived or by default where they are absent or null; supplied values stay."""

    def filled(table: DataFrame, **defaults) -> DataFrame:
        kinds = dict(table.dtypes)
        return table.withColumns({c: F.coalesce(F.col(c), d.cast(kinds[c])) if c in kinds else d for c, d in defaults.items()})

    compound, age = F.upper("TireCompound"), F.col("TireAge")
    out = filled(df, TireCompound_encoded=E.mapped(compound, laps.COMPOUND_CODE, 2), MaxTireLife=E.mapped(compound, laps.COMPOUND_LIFE, 50))
    life = F.col("MaxTireLife")
    out = filled(out, TireLifeRemaining=E.life_left(age, life), TireDegradationRate=F.lit(0.0), IsFreshTire=E.fresh(age), TireWearPct=E.wear(age, life), StintLapNumber=age)
    out = filled(out, OldTiresIndicator=E.flag(F.col("TireWearPct") > 80))
    # without both recent means, all three paces are the default
    means = ["RollingAvgLapTime_3", "RollingAvgLapTime_5"]
    have = F.lit(True)
    for c in means:
        have = have & (F.col(c).isNotNull() if c in out.columns else F.lit(False))
    paces = {c: F.when(have, F.col(c) if c in out.columns else F.lit(None)).otherwise(F.lit(pace)).cast("double") for c in [*means, "TeamAvgPace"]}
    return out.withColumns(paces)


def score_lap_time(df: DataFrame, model: PipelineModel) -> DataFrame:
    """``df`` with the predicted time, its text, and the tire's state."""
    scored = model.transform(lap_defaults(df))
    return scored.select(*df.columns, F.round("prediction", 3).alias("lap_time"), E.duration(F.col("prediction")).alias("formatted"), F.round("TireWearPct", 1).alias("wear"), (F.col("IsFreshTire") == 1).alias("fresh"), F.col("TireLifeRemaining").cast("int").alias("life_left"))
