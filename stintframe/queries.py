"""Registered queries over the star-schema tables, with the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import exprs as E
from .operators import form, impute, laps, samples, sketches, stats, validate
from .operators.form import Form, Roles
from .plans import jobs, ml, reports
from .sources import tables
from .streaming import jobs as streams
from .streaming import tails

ORDERS = Roles(entity=["o_custkey"], order=["o_orderdate", "o_orderkey"])
EVENTS = Roles(entity=["user_id"], order=["ts", "event_id"])
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
Query = Callable[[SparkSession, str], DataFrame]


def registered(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with nulls: the table has none."""
    e = read(spark, sf_dir, "events")
    v = F.when(F.col("event_id") % 7 != 0, F.col("value"))
    kind = F.when(F.col("event_id") % 5 != 0, F.col("event_type"))
    return e.select("event_id", "ts", "user_id", v.alias("v"), kind.alias("kind"), "event_type", "value")


E_SQL = "(select event_id, ts, user_id, case when event_id % 7 <> 0 then value end v, case when event_id % 5 <> 0 then event_type end kind, event_type, value from events)"


def r(c: str | Column, n: int = 6) -> Column:
    return F.round(c, n)


def rounded(df: DataFrame, *columns: str, n: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, n) for c in columns})


def order_form(orders: DataFrame, n: int = 6) -> DataFrame:
    price, failed = F.col("o_totalprice"), E.flag(F.col("o_orderstatus") != "F", 1)
    spec = Form(mean={"avg_last": price}, least={"best_last": price}, total={"sum_last": price}, count={"failed_last": failed}, reliability={"reliability": failed}, trend={"trend": price})
    return form.with_form(orders, ORDERS, spec, n)


_W = "over (partition by o_custkey order by o_orderdate, o_orderkey rows between {} and {})"
W6 = _W.format("5 preceding", "current row")
OLDER, RECENT = _W.format("5 preceding", "3 preceding"), _W.format("2 preceding", "current row")
FAILED = "case when o_orderstatus <> 'F' then 1 else 0 end"


@registered(f"""
with f as (
  select o_custkey, o_orderdate, o_orderkey, avg(o_totalprice) {W6} avg_last, min(o_totalprice) {W6} best_last,
    cast(sum({FAILED}) {W6} as bigint) failed_last, 1 - sum({FAILED}) {W6} / 6.0::double reliability,
    avg(o_totalprice) {OLDER} - avg(o_totalprice) {RECENT} trend
  from orders where o_orderdate >= timestamp '1995-01-01'),
l as (
  select o_custkey, arg_max(avg_last, (o_orderdate, o_orderkey)) avg_last, arg_max(best_last, (o_orderdate, o_orderkey)) best_last,
    arg_max(failed_last, (o_orderdate, o_orderkey)) failed_last, arg_max(reliability, (o_orderdate, o_orderkey)) reliability,
    arg_max(trend, (o_orderdate, o_orderkey)) filter (trend is not null) trend
  from f group by 1)
select o_custkey, c_name, n_name, round(avg_last, 4) avg_last, round(best_last, 4) best_last, failed_last,
  round(reliability, 6) reliability, round(trend, 4) trend
from l join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey
order by avg_last, o_custkey limit 20""")
def form_flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").filter(F.col("o_orderdate") >= F.lit("1995-01-01").cast("timestamp_ntz"))
    rolled = order_form(orders.select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice", "o_orderstatus"))
    last = form.latest(rolled, ORDERS, ["avg_last", "best_last", "failed_last", "reliability", "trend"])
    named = last.join(read(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey")).join(read(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    best = stats.top_k(named, 20, "avg_last", "o_custkey", ascending=True)
    return best.select("o_custkey", "c_name", "n_name", r("avg_last", 4).alias("avg_last"), r("best_last", 4).alias("best_last"), "failed_last", r("reliability").alias("reliability"), r("trend", 4).alias("trend"))


def _rolled(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return order_form(read(spark, sf_dir, "orders")).select("o_orderkey", *[r(c, 4).alias(c) for c in columns])


@registered(f"select o_orderkey, round(avg(o_totalprice) {W6}, 4) avg_last from orders")
def rolling_mean(spark, sf_dir):
    return _rolled(spark, sf_dir, "avg_last")


@registered(f"select o_orderkey, round(min(o_totalprice) {W6}, 4) best_last from orders")
def rolling_min(spark, sf_dir):
    return _rolled(spark, sf_dir, "best_last")


@registered(f"select o_orderkey, round(sum(o_totalprice) {W6}, 4) sum_last from orders")
def rolling_sum(spark, sf_dir):
    return _rolled(spark, sf_dir, "sum_last")


@registered(f"select o_orderkey, cast(sum({FAILED}) {W6} as bigint) failed_last, round(1 - sum({FAILED}) {W6} / 6.0::double, 4) reliability from orders")
def rolling_flags(spark, sf_dir):
    return order_form(read(spark, sf_dir, "orders")).select("o_orderkey", "failed_last", r("reliability", 4).alias("reliability"))


@registered(f"select o_orderkey, round(avg(o_totalprice) {OLDER} - avg(o_totalprice) {RECENT}, 4) trend from orders")
def form_trend(spark, sf_dir):
    return _rolled(spark, sf_dir, "trend")


PAST = _W.format("6 preceding", "1 preceding")


@registered(f"select o_orderkey, round(avg(o_totalprice) {PAST}, 4) past_mean, round(1 - sum({FAILED}) {PAST} / nullif(count(*) {PAST}, 0)::double, 6) past_reliability from orders")
def form_without_current(spark, sf_dir):
    failed = E.flag(F.col("o_orderstatus") != "F", 1)
    spec = Form(mean={"past_mean": F.col("o_totalprice")}, reliability={"past_reliability": failed})
    out = form.with_form(read(spark, sf_dir, "orders"), ORDERS, spec, 6, include_current=False, divisor="rows")
    return out.select("o_orderkey", r("past_mean", 4).alias("past_mean"), r("past_reliability").alias("past_reliability"))


_SWEEP = " union all ".join(
    f"select cast({n} as int) lookback, count(t) valid_rows, round(avg(abs(t)), 3) mean_abs_trend from (select "
    + ("0.0::double" if n <= 3 else f"avg(o_totalprice) {_W.format(f'{n - 1} preceding', '3 preceding')} - avg(o_totalprice) {RECENT}")
    + " t from orders)"
    for n in (3, 5, 6, 8, 10)
)


@registered(_SWEEP)
def lookback_sweep(spark, sf_dir):
    return rounded(form.sweep(read(spark, sf_dir, "orders"), ORDERS, F.col("o_totalprice"), [3, 5, 6, 8, 10]), "mean_abs_trend", n=3)


@registered(f"select event_id, round(coalesce(last_value(v ignore nulls) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row), 15.0), 6) v from {E_SQL}")
def forward_fill(spark, sf_dir):
    return form.forward_fill(masked(spark, sf_dir), EVENTS, "v", 15.0).select("event_id", r("v").alias("v"))


@registered(f"select event_id, round(s, 6) start, round(s - v, 6) gained from (select *, first_value(v ignore nulls) over (partition by user_id order by ts, event_id rows between unbounded preceding and unbounded following) s from {E_SQL})")
def start_change(spark, sf_dir):
    return rounded(form.from_start(masked(spark, sf_dir), EVENTS, "v").select("event_id", "start", "gained"), "start", "gained")


@registered(f"select event_id, round(v - lag(v) over (partition by user_id, event_type order by ts, event_id), 6) change from {E_SQL}")
def in_group_diff(spark, sf_dir):
    roles = Roles(entity=["user_id", "event_type"], order=["ts", "event_id"])
    return rounded(form.step(masked(spark, sf_dir), roles, "v", "change").select("event_id", "change"), "change")


@registered(f"select event_id, round(coalesce(v, m, (select quantile_cont(v, 0.5) from {E_SQL})), 6) v from {E_SQL} left join (select user_id, quantile_cont(v, 0.5) m from {E_SQL} group by 1) using (user_id)")
def impute_median(spark, sf_dir):
    return rounded(impute.group_median(masked(spark, sf_dir), ["user_id"], ["v"]).select("event_id", "v"), "v")


@registered(f"select event_id, round(coalesce(v, (select quantile_cont(v, 0.5) from {E_SQL})), 6) v from {E_SQL}")
def impute_global_median(spark, sf_dir):
    return rounded(impute.global_median(masked(spark, sf_dir), "v").select("event_id", "v"), "v")


@registered(f"""with m as (select user_id, kind m from (select user_id, kind, row_number() over (partition by user_id order by count(*) desc, kind) n from {E_SQL} where kind is not null group by 1, 2) where n = 1)
select event_id, coalesce(kind, m, 'none') kind from {E_SQL} left join m using (user_id)""")
def impute_mode(spark, sf_dir):
    return impute.group_mode(masked(spark, sf_dir), ["user_id"], "kind", "none").select("event_id", "kind")


@registered(f"select event_id, coalesce(v, 0.0) v, coalesce(kind, 'none') kind from {E_SQL}")
def impute_constant(spark, sf_dir):
    return impute.constants(masked(spark, sf_dir), {"v": 0.0, "kind": "none"}).select("event_id", "v", "kind")


@registered("select p_partkey, round(p_retailprice - min(p_retailprice) over (partition by p_brand), 6) gap from part")
def gap_to_best(spark, sf_dir):
    return rounded(form.gap_to_best(read(spark, sf_dir, "part"), ["p_brand"], "p_retailprice").select("p_partkey", "gap"), "gap")


@registered(f"""select event_id, least(v, value * 2, 40.0::double) best, round(value / 20 * 100, 6) scaled, case when v <= 10 then 1 else 0 end top,
  case when kind is null or kind not like '%click%' then 1 else 0 end unfinished,
  case when value < 3 then 'low' when value < 50 then 'mid' else 'high' end tier, greatest(least(value, 60.0), 5.0) clamped,
  case when value > 70 or value < 30 then 'high' else 'medium' end confidence, upper(event_type) kind from {E_SQL}""")
def scalar_expressions(spark, sf_dir):
    v, value = F.col("v"), F.col("value")
    return masked(spark, sf_dir).select(
        "event_id",
        E.row_least(v, value * 2, F.lit(40.0)).alias("best"),
        r(E.scaled(value, 20)).alias("scaled"),
        E.at_most(v, 10).alias("top"),
        E.unfinished(F.col("kind"), "click").alias("unfinished"),
        E.tier(value, [3, 50], ["low", "mid", "high"]).alias("tier"),
        E.clamped(value, 5.0, 60.0).alias("clamped"),
        E.confidence(value, 30, 70).alias("confidence"),
        F.upper("event_type").alias("kind"),
    )


@registered("""select event_id, printf('%d:%02d.%03d', ms // 60000, (ms % 60000) // 1000, ms % 1000) duration, try_cast(event_type as double) number
  from (select event_id, event_type, cast(round(value * 1000) as bigint) ms from events)""")
def duration_format(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", E.duration(F.col("value")).alias("duration"), E.number(F.col("event_type")).alias("number"))


@registered("select l_orderkey, l_linenumber, l_quantity, case when l_quantity > 0 and l_quantity <= 5 then '1-5' when l_quantity > 5 and l_quantity <= 10 then '6-10' when l_quantity > 10 and l_quantity <= 20 then '11-20' end bin from lineitem")
def bins(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", E.binned(F.col("l_quantity"), [0, 5, 10, 20], ["1-5", "6-10", "11-20"]).alias("bin"))


@registered("""select event_id, code, life, greatest(life - age, 0) life_left, case when age <= 3 then 1 else 0 end fresh, round(least(100.0, age * 1.0 / life * 100), 6) wear,
  case when least(100.0, age * 1.0 / life * 100) > 80 then 1 else 0 end old from (select event_id, event_id % 60 age, case event_type when 'click' then 1 when 'view' then 3 else 2 end code, case event_type when 'click' then 40 when 'view' then 60 else 50 end life from events)""")
def mapped_wear(spark, sf_dir):
    age = F.col("event_id") % 60
    life = E.mapped(F.col("event_type"), {"click": 40, "view": 60}, 50)
    return read(spark, sf_dir, "events").select("event_id", E.mapped(F.col("event_type"), {"click": 1, "view": 3}, 2).alias("code"), life.alias("life"), E.life_left(age, life).alias("life_left"), E.fresh(age).alias("fresh"), r(E.wear(age, life)).alias("wear"), E.worn(age, life).alias("old"))


@registered("select p_partkey, 'retail' kind, p_retailprice price from part union all select p_partkey, 'size', cast(p_size as double) from part")
def melt(spark, sf_dir):
    wide = read(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").alias("retail"), F.col("p_size").cast("double").alias("size"))
    return stats.melt(wide, ["p_partkey"], ["retail", "size"], "kind", "price")


@registered("select c_custkey, c_name, coalesce(spent, 0.0) spent from customer left join (select o_custkey, round(max(o_totalprice), 4) spent from orders where o_orderstatus = 'P' group by 1) on o_custkey = c_custkey")
def left_lookup(spark, sf_dir):
    most = read(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(r(F.max("o_totalprice"), 4).alias("spent"))
    return validate.look_up(read(spark, sf_dir, "customer").select("c_custkey", "c_name"), most, "c_custkey", {"spent": 0.0})


@registered("""with a as (select l_orderkey, l_partkey, l_suppkey, max(l_quantity) q from lineitem group by all), b as (select l_orderkey, l_partkey, l_suppkey, min(l_discount) d from lineitem where l_discount < 0.05 group by all)
select * from a join b using (l_orderkey, l_partkey, l_suppkey)""")
def inner_three_key(spark, sf_dir):
    keys = ["l_orderkey", "l_partkey", "l_suppkey"]
    lines = read(spark, sf_dir, "lineitem")
    a = lines.groupBy(*keys).agg(F.max("l_quantity").alias("q"))
    return a.join(lines.filter("l_discount < 0.05").groupBy(*keys).agg(F.min("l_discount").alias("d")), keys)


TOP5 = "(select o_custkey from orders group by 1 order by count(*) desc, o_custkey limit 5)"


@registered(f"select o_custkey, o_orderkey, round(o_totalprice, 4) o_totalprice from orders where o_custkey in {TOP5}")
def trend_topk(spark, sf_dir):
    out = reports.trend_of_top(read(spark, sf_dir, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], "o_totalprice", 5)
    return out.select("o_custkey", "o_orderkey", r("o_totalprice", 4).alias("o_totalprice"))


def customers_orders(spark, sf_dir) -> DataFrame:
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    joined = orders.join(read(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    return joined.join(read(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))


_CO = "orders join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey"


@registered(f"select n_name, round(avg(case when o_orderstatus = 'F' then 1.0::double else 0 end) * 100, 6) percent from {_CO} group by 1")
def finish_rate(spark, sf_dir):
    return rounded(stats.by_key(customers_orders(spark, sf_dir), ["n_name"], percent=stats.rate(F.col("o_orderstatus") == "F")), "percent")


@registered("select o_custkey, round(avg(case when o_totalprice > 300000 then 1.0::double else 0 end) * 100, 6) percent from orders group by 1")
def entity_win_rate(spark, sf_dir):
    return rounded(stats.by_key(read(spark, sf_dir, "orders"), ["o_custkey"], percent=stats.rate(F.col("o_totalprice") > 300000)), "percent")


@registered("select p_size, round(avg(case when p_retailprice <= 1200 then 1.0::double else 0 end) * 100, 6) percent from part group by 1")
def bucket_rate(spark, sf_dir):
    return rounded(reports.outcome_by_bucket(read(spark, sf_dir, "part"), "p_size", "p_retailprice", 1200), "percent")


@registered("""select o_custkey, percent from (select o_custkey, case when avg(case when o_totalprice <= 10 then 1.0::double else 0 end) > 0 then round(avg(case when o_totalprice <= 10 then 1.0::double else 0 end) * 100, 6) end percent
  from (select o_custkey, o_orderkey % 40 o_totalprice from orders) group by 1) order by percent desc nulls last, o_custkey limit 12""")
def topn_rate(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select("o_custkey", (F.col("o_orderkey") % 40).alias("place"))
    return rounded(reports.top_ten_rate(rows, "o_custkey", "place"), "percent")


@registered("""with w as (select p_size, avg(case when p_retailprice <= 1200 then 1.0::double else 0 end) * 100 p from part group by 1)
select round((select corr(p_size, p_retailprice) from part), 6) r, round((select avg(p) from (select p from w order by p_size limit 2)), 6) front""")
def front_buckets(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    rates = reports.outcome_by_bucket(part, "p_size", "p_retailprice", 1200)
    front = stats.first_buckets_mean(rates, "p_size", "percent", 2).select(r("percent").alias("front"))
    return part.agg(r(F.corr("p_size", "p_retailprice")).alias("r")).crossJoin(F.broadcast(front))  # one row


@registered("""with d as (select l_linenumber b, cast(l_orderkey % 20 + 1 as bigint) p from lineitem), w as (select b, avg(case when p <= 1 then 1.0::double else 0 end) * 100 x, avg(case when p <= 3 then 1.0::double else 0 end) * 100 y from d group by 1)
select round((select corr(b, p) from d), 6) r, round((select coalesce(max(x), 0.0) from w where b = 1), 6) pole_win, round((select avg(x) from (select x from w order by b limit 2)), 6) front_row_win,
  round((select avg(y) from (select y from w order by b limit 3)), 6) top3_podium, round((select avg(case when p = 1 then 1.0::double else 0 end) * 100 from d where b <= 2), 6) front_row_pooled""")
def report_insights(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("b"), (F.col("l_orderkey") % 20 + 1).alias("p"))
    return rounded(reports.insights(rows, "b", "p"), "r", "pole_win", "front_row_win", "top3_podium", "front_row_pooled")


@registered(f"select kind, count(*) n from {E_SQL} where kind is not null group by 1")
def value_counts(spark, sf_dir):
    return stats.value_counts(masked(spark, sf_dir), "kind")


@registered("select event_type, count(*) n, round(count(*) * 100.0::double / (select count(*) from events), 6) percent from events group by 1")
def share(spark, sf_dir):
    return rounded(stats.share(read(spark, sf_dir, "events"), "event_type"), "percent")


@registered(" union all ".join(f"select '{c}' name, count(*) filter ({c} is null) nulls, count({c}) present from {E_SQL}" for c in ("event_id", "v", "kind")))
def null_profile(spark, sf_dir):
    return stats.null_profile(masked(spark, sf_dir).select("event_id", "v", "kind"))


@registered(f"select 'v' name, count(v) n, round(avg(v), 6) mean, round(stddev_samp(v), 6) std, round(min(v), 6) min, round(quantile_cont(v, 0.25), 6) q1, round(quantile_cont(v, 0.5), 6) median, round(quantile_cont(v, 0.75), 6) q3, round(max(v), 6) max from {E_SQL}")
def describe(spark, sf_dir):
    return rounded(stats.describe(masked(spark, sf_dir), ["v"]), "mean", "std", "min", "q1", "median", "q3", "max")


_FENCES = "(select q1, q3, q3 - q1 iqr, q1 - 1.5 * (q3 - q1) lo, q3 + 1.5 * (q3 - q1) hi, m from (select quantile_cont(value, 0.25) q1, quantile_cont(value, 0.75) q3, quantile_cont(value, 0.5) m from events))"


@registered(f"select round(q1, 6) q1, round(m, 6) median, round(q3, 6) q3, round(iqr, 6) iqr, round(lo, 6) lower, round(hi, 6) upper from {_FENCES}")
def iqr_fences(spark, sf_dir):
    return rounded(stats.fences(read(spark, sf_dir, "events"), "value"), "q1", "median", "q3", "iqr", "lower", "upper")


@registered(f"select count(*) filter (value < lo or value > hi) outliers, round(avg(case when value < lo or value > hi then 1.0::double else 0 end) * 100, 6) percent from events, {_FENCES}")
def outlier_share(spark, sf_dir):
    return rounded(stats.outliers(read(spark, sf_dir, "events"), "value"), "percent")


@registered("select event_type, round(avg(value), 6) mean, round(stddev_samp(value), 6) std, round(sum(value), 3) total from events group by 1")
def group_statistics(spark, sf_dir):
    v = F.col("value")
    return stats.by_key(read(spark, sf_dir, "events"), ["event_type"], mean=r(F.avg(v)), std=r(F.stddev_samp(v)), total=r(F.sum(v), 3))


@registered("select event_type, round(avg(value), 6) mean, round(avg(value) - 1.96 * stddev_samp(value) / sqrt(count(value)), 6) low, round(avg(value) + 1.96 * stddev_samp(value) / sqrt(count(value)), 6) high from events group by 1")
def ci_by(spark, sf_dir):
    return rounded(reports.mean_with_interval(read(spark, sf_dir, "events"), "event_type", "value"), "mean", "low", "high")


_NUM = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
_PAIRS = [(a, b) for i, a in enumerate(_NUM) for b in _NUM[i + 1 :]]


@registered(" union all ".join(f"select '{a}' a, '{b}' b, round(corr({a}, {b}), 6) r from lineitem" for a, b in _PAIRS))
def corr_matrix(spark, sf_dir):
    return rounded(reports.correlation_matrix(read(spark, sf_dir, "lineitem").select(*_NUM)), "r")


@registered(f"with c as (select v, value, event_id % 11 k from {E_SQL} where v is not null) select 'v' a, 'value' b, round(corr(v, value), 6) r from c union all select 'v', 'k', round(corr(v, k), 6) from c union all select 'value', 'k', round(corr(value, k), 6) from c")
def corr_listwise(spark, sf_dir):
    return rounded(stats.correlations(masked(spark, sf_dir).withColumn("k", F.col("event_id") % 11), ["v", "value", "k"], listwise=True), "r")


@registered("""with b as (select min(value) lo, (max(value) - min(value)) / 30 w from events)
select cast(least(floor((value - lo) / w) + 1, 30) as int) bin, count(*) n from events, b group by 1""")
def histogram(spark, sf_dir):
    return stats.histogram(read(spark, sf_dir, "events"), "value").select("bin", "n")


_DENSITY = """with s as (select {k} min(value) lo, max(value) hi, stddev_samp(value) * pow(count(*)::double, -0.2) h, count(*) t from events {g}),
b as (select {k} lo, hi, h, t, cast(least(floor((value - lo) / ((hi - lo) / 200)), 199) as int) i, count(*) n from events {j} group by all)
select {k} cast(p as int) point, round(max(lo + p * (hi - lo) / 49), 6) x,
  round(sum(n * exp(-0.5 * pow((lo + p * (hi - lo) / 49 - (lo + (i + 0.5) * ((hi - lo) / 200))) / h, 2))) / (max(t) * max(h) * sqrt(2 * pi())), 8) density
from b, range(50) r(p) group by {k} p"""


@registered(_DENSITY.format(k="", g="", j=", s"))
def density(spark, sf_dir):
    out = stats.density(read(spark, sf_dir, "events"), "value")
    return out.select("point", r("x").alias("x"), r("density", 8).alias("density"))


@registered(_DENSITY.format(k="event_type, ", g="group by 1", j="join s using (event_type)"))
def violin(spark, sf_dir):
    out = stats.density(read(spark, sf_dir, "events"), "value", ["event_type"])
    return out.select("event_type", "point", r("x").alias("x"), r("density", 8).alias("density"))


@registered("select event_type, count(value) n, min(value) least, round(quantile_cont(value, 0.25), 6) q1, round(quantile_cont(value, 0.5), 6) median, round(quantile_cont(value, 0.75), 6) q3, max(value) most from events group by 1")
def quartiles_by(spark, sf_dir):
    return rounded(reports.quartiles_by(read(spark, sf_dir, "events"), "event_type", "value"), "q1", "median", "q3")


_STINT = """(select event_id, user_id, ts, event_type, value, sum(c) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row) + 1 stint
  from (select *, case when event_type <> lag(event_type) over (partition by user_id order by ts, event_id) then 1 else 0 end c from events))"""


@registered(f"""select event_id, cast(stint as bigint) stint, cast(row_number() over w as int) stint_lap, case when lag(1) over w is null then 1 else 0 end first_of, case when lead(1) over w is null then 1 else 0 end last_of
  from {_STINT} window w as (partition by user_id, stint order by ts, event_id)""")
def stint_features(spark, sf_dir):
    return laps.stints(read(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type").select("event_id", "stint", "stint_lap", "first_of", "last_of")


@registered("select user_id, event_type, round(regr_slope(value, event_id), 8) slope from events group by 1, 2")
def degradation_slope(spark, sf_dir):
    return rounded(laps.slopes(read(spark, sf_dir, "events"), ["user_id", "event_type"], "value", "event_id"), "slope", n=8)


_UW = "over (partition by user_id order by ts, event_id rows between {} preceding and 1 preceding)"


@registered(f"select event_id, round(avg(value) {_UW.format(3)}, 6) mean_3, round(avg(value) {_UW.format(5)}, 6) mean_5, round(stddev_samp(value) {_UW.format(5)}, 6) std_5 from events")
def recent_pace(spark, sf_dir):
    out = laps.recent_pace(read(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "value")
    return rounded(out.select("event_id", "mean_3", "mean_5", "std_5"), "mean_3", "mean_5", "std_5")


@registered("""select p_partkey, round(avg(p_retailprice) over (partition by p_size, p_brand), 4) group_mean, round(avg(p_retailprice) over (partition by p_size, p_type) - avg(p_retailprice) over (partition by p_size, p_brand), 4) versus_group,
  round((p_retailprice / min(p_retailprice) over (partition by p_size) - 1) * 100, 4) off_best from part""")
def against_group(spark, sf_dir):
    out = laps.against_group(read(spark, sf_dir, "part"), ["p_size"], ["p_brand"], ["p_type"], "p_retailprice")
    return rounded(out.select("p_partkey", "group_mean", "versus_group", "off_best"), "group_mean", "versus_group", "off_best", n=4)


@registered("""select event_id, round(value - lag(value) over w, 6) gap_ahead, round(lead(value) over w - value, 6) gap_behind, count(*) over (partition by user_id order by value range between 0.5 preceding and 0.5 following) - 1 traffic,
  case when value - lag(value) over w < 1.0 then 1 else 0 end in_reach from events window w as (partition by user_id order by value, event_id)""")
def gaps_by_order(spark, sf_dir):
    out = laps.neighbours(read(spark, sf_dir, "events"), ["user_id"], "value", "event_id", 0.5)
    return rounded(out.select("event_id", "gap_ahead", "gap_behind", "traffic", "in_reach"), "gap_ahead", "gap_behind")


@registered("""select event_id, m max_lap, m - event_id laps_left, round(event_id / m::double, 6) progress, round(1 - event_id / m::double, 6) fuel from (select *, max(event_id) over (partition by user_id) m from events)""")
def lap_progress(spark, sf_dir):
    out = laps.progress(read(spark, sf_dir, "events"), ["user_id"], "event_id")
    return rounded(out.select("event_id", "max_lap", "laps_left", "progress", "fuel"), "progress", "fuel")


@registered("""with m as (select l_linenumber, l_returnflag, quantile_cont(l_extendedprice, 0.5) median from lineitem group by 1, 2)
select l_returnflag, l_linenumber, round(median, 4) median, round(median / first_value(median) over (partition by l_returnflag order by l_linenumber rows between unbounded preceding and unbounded following), 6) evolution from m""")
def evolution(spark, sf_dir):
    out = laps.evolution(read(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_linenumber", "l_extendedprice")
    return out.select("l_returnflag", "l_linenumber", r("median", 4).alias("median"), r("evolution").alias("evolution"))


@registered(f"select case when v is null and kind is null then 'v,kind' when v is null then 'v' when kind is null then 'kind' else '' end errors, count(*) n from {E_SQL} group by 1")
def validate_rows(spark, sf_dir):
    return validate.with_errors(masked(spark, sf_dir), ["v", "kind"]).groupBy(F.array_join("_errors", ",").alias("errors")).agg(F.count("*").alias("n"))


@registered(f"select count(*) n_before, count(*) filter (v is not null and kind is not null) n_after from {E_SQL}")
def listwise_drop(spark, sf_dir):
    rows = masked(spark, sf_dir)
    after = validate.listwise(rows, ["v", "kind"]).agg(F.count("*").alias("n_after"))
    return rows.agg(F.count("*").alias("n_before")).crossJoin(F.broadcast(after))  # one row


@registered("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 15")
def top_k(spark, sf_dir):
    return stats.top_k(read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), 15, "o_totalprice", "o_orderkey")


_AUDIT = ("customer", "orders", "lineitem", "events", "part", "supplier", "nation", "region")


@registered(" union all ".join(f"select '{t}' name, count(*) n_rows from {t}" for t in _AUDIT))
def audit_counts(spark, sf_dir):
    return tables.audit(**{t: read(spark, sf_dir, t) for t in _AUDIT})


@registered("select l_orderkey, l_linenumber, count(*) n from lineitem group by 1, 2 having count(*) > 1")
def repeated_keys(spark, sf_dir):
    return validate.repeated_keys(read(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@registered("""with l as (select user_id, arg_max(v, (ts, event_id)) filter (v is not null) v, arg_max(kind, (ts, event_id)) filter (kind is not null) kind from E group by 1) select user_id, round(v, 6) v, kind from l""".replace("E group", f"{E_SQL} group"))
def latest_per_column(spark, sf_dir):
    return form.latest(masked(spark, sf_dir), EVENTS, ["v", "kind"]).select("user_id", r("v").alias("v"), "kind")


@registered("select p_brand, round(stddev_samp(p_retailprice), 4) std, case when stddev_samp(p_retailprice) < 3 then 'steady' when stddev_samp(p_retailprice) < 5 then 'fair' else 'erratic' end tier from part group by 1 order by stddev_samp(p_retailprice), p_brand limit 15")
def report_consistency(spark, sf_dir):
    return rounded(reports.consistency(read(spark, sf_dir, "part"), "p_brand", "p_retailprice", 15), "std", n=4)


@registered("select * from events order by md5('42|' || event_id), event_id limit 1000")
def sample_n(spark, sf_dir):
    """A thousand events by the order of a hash of their key."""
    return samples.exactly(read(spark, sf_dir, "events"), 1000, ["event_id"])


@registered("""select event_type, event_id from (select *, row_number() over (partition by event_type order by md5('7|' || event_id), event_id) r from events) where r <= 20""")
def sample_strata(spark, sf_dir):
    """Twenty events of each type, merged from the samples of two halves."""
    e = read(spark, sf_dir, "events").select("event_type", "event_id")
    halves = [samples.bottom(e.filter(F.col("event_id") % 2 == k), 20, ["event_id"], 7, ["event_type"]) for k in (0, 1)]
    return samples.merged(*halves, 20, ["event_id"], ["event_type"]).select("event_type", "event_id")


_BITS = "('0x' || substr(d, 4 * i + 1, 4))::int"
_WEIGHT = " + ".join(f"({_BITS} >= {step})::int" for step in samples.poisson_steps())


@registered(f"""
with d as (select event_type, value, g, md5('42|' || g || '|' || event_id) d from events, range(25) t(g)),
w as (select event_type, value, 8 * g + i b, {_WEIGHT} w from d, range(8) u(i)),
m as (select event_type, b, sum(w * value) / nullif(sum(w), 0) m from w group by 1, 2)
select event_type, round((select avg(value) from events e where e.event_type = m.event_type), 6) mean,
  round(quantile_cont(m, 0.025), 6) low, round(quantile_cont(m, 0.975), 6) high from m group by 1""")
def ci_bootstrap(spark, sf_dir):
    """Two hundred bootstrap replicates in one pass."""
    return rounded(reports.mean_with_interval(read(spark, sf_dir, "events"), "event_type", "value", ["event_id"]), "mean", "low", "high")


@registered("""
with v as (select vec_id, unnest(embedding)::double x, generate_subscripts(embedding, 1) - 1 i from embeddings)
select 'e' || a.i a, 'e' || b.i b, round(corr(a.x, b.x), 6) r from v a join v b on a.vec_id = b.vec_id and a.i < b.i group by a.i, b.i""")
def corr_wide(spark, sf_dir):
    """All pairs of the components of the vectors."""
    e = read(spark, sf_dir, "embeddings")
    wide = e.select(*[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(64)])
    return rounded(stats.correlations(wide, wide.columns), "r")


@registered("""select event_type, count(*) n, true as within from events group by 1""")
def sketched_fences(spark, sf_dir):
    """Quartiles per type from the stored sketches of twelve batches; within: each is as near its rank as the sketch states."""
    events, path = read(spark, sf_dir, "events"), _folder(spark)
    for b in range(12):
        rows = events.filter(F.coalesce(F.dayofmonth("ts") % 12, F.lit(0)) == b)
        tables.write_batch(sketches.sketch(rows, ["event_type"], "value"), path, b)
    stored = tables.read_batches(spark, path, sketches.schema(events, ["event_type"]))
    limits = sketches.fences(sketches.merged(stored, ["event_type"]), ["event_type"])
    marks = F.array(*[F.struct(F.lit(q).alias("q"), F.col(c).alias("at")) for q, c in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))])
    ranks = events.join(limits.select("event_type", F.col("n").alias("_n"), F.explode(marks).alias("m")), "event_type")
    below = ranks.groupBy("event_type", "_n", "m.q").agg(F.avg((F.col("value") < F.col("m.at")).cast("double")).alias("lo"), F.avg((F.col("value") <= F.col("m.at")).cast("double")).alias("hi"))
    error = F.greatest(F.col("lo") - F.col("q"), F.col("q") - F.col("hi"))
    return below.groupBy("event_type", F.col("_n").alias("n")).agg((F.max(error) <= sketches.RANK_ERROR).alias("within"))


@registered(f"""select o_orderkey, round(avg(o_totalprice) {W6}, 4) avg_last, round(min(o_totalprice) {W6}, 4) best_last, cast(sum({FAILED}) {W6} as bigint) failed_last,
  round(avg(o_totalprice) {OLDER} - avg(o_totalprice) {RECENT}, 4) trend from orders""")
def form_refreshed(spark, sf_dir):
    """Form of every order, worked out year by year from stored tails."""
    orders, state = read(spark, sf_dir, "orders"), _folder(spark)
    price, failed = F.col("o_totalprice"), E.flag(F.col("o_orderstatus") != "F", 1)
    spec = Form(mean={"avg_last": price}, least={"best_last": price}, count={"failed_last": failed}, trend={"trend": price})
    first, last = orders.agg(F.min(F.year("o_orderdate")), F.max(F.year("o_orderdate"))).first()
    if first is None:
        return form.with_form(orders, ORDERS, spec, 6).select("o_orderkey", "avg_last", "best_last", "failed_last", "trend")
    for number, year in enumerate(range(first, last + 1)):
        tails.refresh(orders.filter(F.year("o_orderdate") == year), number, state, ORDERS, spec, 6, buckets=8)
    out = tails.refreshed(spark, state, "form", form.with_form(orders, ORDERS, spec, 6).schema)
    return rounded(out.select("o_orderkey", "avg_last", "best_last", "failed_last", "trend"), "avg_last", "best_last", "trend", n=4)


@registered("""select o_orderstatus, cast(f as int) fold, n // 5 + case when f < n % 5 then 1 else 0 end n
  from (select o_orderstatus, count(*) n from orders group by 1), range(5) t(f) where n > f""")
def ml_folds(spark, sf_dir):
    rows = ml.with_fold(read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", ["o_orderkey"])
    return rows.groupBy("o_orderstatus", "fold").agg(F.count("*").alias("n"))


def order_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rolled = order_form(read(spark, sf_dir, "orders"))
    return rolled.withColumn("label", (F.col("o_orderstatus") == "F").cast("double")).na.fill({"trend": 0.0})


NUMERIC = ["avg_last", "best_last", "trend"]


@registered()
def ml_cv(spark, sf_dir):
    """All four classifiers over five folds; a customer's rate comes from the other folds."""
    rolled = _stored(order_features(spark, sf_dir).select("o_orderkey", "o_custkey", "label", *NUMERIC, "o_orderpriority"))
    rows = ml.with_fold(ml.with_class_weight(rolled, "label"), "label", ["o_orderkey"])
    rows = ml.with_fold_rates(rows, ["o_custkey"], F.col("label") == 1, "rate").fillna(0.0, ["rate"])
    rows = _stored(rows.select("label", "weight", "fold", *NUMERIC, "rate", "o_orderpriority"))  # thousands of short tasks then carry a scan, not the features' plan
    return stats.score_summary(ml.cross_validate(rows, ml.encoder([*NUMERIC, "rate"], ["o_orderpriority"], scale=True), ml.classifiers("label"), "label"))


@registered("""with f as (select *, o_orderkey % 5 fold, (o_orderstatus = 'F')::int y from orders),
  c as (select o_custkey, fold, sum(y) s, count(*) n from f group by 1, 2),
  t as (select o_custkey, sum(s) s, sum(n) n from c group by 1)
  select o_orderkey, case when t.n > c.n then round((t.s - c.s) / (t.n - c.n)::double * 100, 6) end rate from f join c using (o_custkey, fold) join t using (o_custkey)""")
def fold_rates(spark, sf_dir):
    """Rates without a row's own fold."""
    rows = read(spark, sf_dir, "orders").withColumn("fold", F.col("o_orderkey") % 5)
    return rounded(ml.with_fold_rates(rows, ["o_custkey"], F.col("o_orderstatus") == "F", "rate").select("o_orderkey", "rate"), "rate")


@registered("""select o_orderkey, round(avg((o_orderstatus = 'F')::int) over (partition by o_custkey order by year(o_orderdate) range between unbounded preceding and 1 preceding) * 100, 6) rate from orders""")
def past_rates(spark, sf_dir):
    """Rates as of the start of a row's year."""
    rows = read(spark, sf_dir, "orders").withColumn("y", F.year("o_orderdate"))
    return rounded(ml.with_past_rates(rows, ["o_custkey"], ["y"], F.col("o_orderstatus") == "F", "rate").select("o_orderkey", "rate"), "rate")


@registered()
def ml_gbt_regressor(spark, sf_dir):
    """Boosted trees, the number of rounds chosen on held-out rows."""
    return ml.train_lap_time(order_features(spark, sf_dir), NUMERIC, ["o_orderpriority"], ["o_orderkey"], "o_totalprice")[1]


@registered()
def ml_importances(spark, sf_dir):
    """What the forecast of the next order's price rests on."""
    rows = order_features(spark, sf_dir)
    model = ml.train_position(rows, NUMERIC, ["o_orderpriority"], ["o_orderkey"], "o_totalprice", rounds=20)
    return ml.importances(model, rows)


@registered()
def score_win(spark, sf_dir):
    rows = order_features(spark, sf_dir)
    model = ml.train(ml.with_class_weight(rows, "label"), ml.encoder(NUMERIC, ["o_orderpriority"], scale=True), ml.classifiers("label")["logistic"])
    scored, _ = jobs.score_win(rows, model, [*NUMERIC, "o_orderpriority"])
    return scored.select("o_orderkey", "will_win", "win_probability", "confidence")


@registered("select * from events")
def stream_ingest(spark, sf_dir):
    folder = _folder(spark)
    schema = read(spark, sf_dir, "events").schema
    streams.ingest(spark, f"{sf_dir}/events.parquet*", schema, f"{folder}/out", f"{folder}/checkpoint", required=["user_id"]).awaitTermination()
    return spark.read.parquet(f"{folder}/out").select(*schema.names)


@registered("""select event_type, count(*) n, round(sum(case when event_type in ('click', 'view') then 2 * value else value end), 3) total from events group by 1""")
def stream_corrected(spark, sf_dir):
    """Two types of event are delivered again with doubled values; each partition is as it was delivered last."""
    folder, events = _folder(spark), read(spark, sf_dir, "events").select("event_id", "event_type", "value")
    deliveries = [events, events.filter(F.col("event_type").isin("click", "view")).withColumn("value", 2 * F.col("value"))]
    for n, rows in enumerate(deliveries):
        rows.write.parquet(f"{folder}/in/{n}")  # as many files as it takes
        streams.ingest_corrected(spark, f"{folder}/in", events.schema, f"{folder}/out", f"{folder}/checkpoint", ["event_type"], folders=True).awaitTermination()
    out = spark.read.schema(events.schema).parquet(f"{folder}/out")
    return out.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total"))


@registered("select event_id, event_type, value > 50 large from events")
def stream_score(spark, sf_dir):
    """Rows scored as they arrive, appended to a table."""
    folder = _folder(spark)
    schema = read(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")
    scored = streams.scored(stream, lambda df: df.select("event_id", "event_type", (F.col("value") > 50).alias("large")), ["event_id", "value"])
    query = scored.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(scored.schema).parquet(f"{folder}/out")


@registered("""select date_trunc('hour', ts) start, event_type, count(*) n, round(avg(value), 6) mean from events group by 1, 2""")
def windowed_counts(spark, sf_dir):
    rows = read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = streams.windowed_counts(rows, "ts", "event_type", "value")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", r("mean").alias("mean"))


# result-like rows: customers are drivers, nations teams, order priorities statuses
_PLACE = "cast(o_orderkey * 7 % 20 + 1 as double)"
_RESULTS = f"(select cast(year(o_orderdate) as int) \"Year\", cast(o_orderkey as int) \"Race\", c_name \"Driver\", n_name \"Team\", {_PLACE} \"Position\", cast(o_orderkey * 3 % 20 + 1 as double) \"GridPosition\", o_totalprice / 10000 \"Points\", case when o_orderstatus = 'F' then 'Finished' else 'Retired' end \"Status\" from {_CO})"


def results_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    orders = orders.join(read(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    place = lambda k: (F.col("o_orderkey") * k % 20 + 1).cast("double")
    return orders.select(
        F.year("o_orderdate").alias("Year"),
        F.col("o_orderkey").cast("int").alias("Race"),
        F.col("c_name").alias("Driver"),
        F.col("n_name").alias("Team"),
        place(7).alias("Position"),
        place(3).alias("GridPosition"),
        (F.col("o_totalprice") / 10000).alias("Points"),
        F.when(F.col("o_orderstatus") == "F", "Finished").otherwise("Retired").alias("Status"),
    )


@registered(f'select "Driver", count(*) n from {_RESULTS} where "Position" = 1 group by 1')
def report_wins(spark, sf_dir):
    return reports.wins(results_of(spark, sf_dir))


@registered(f'select "Driver", round(avg("Position"), 6) mean from {_RESULTS} group by 1')
def report_mean_position(spark, sf_dir):
    return rounded(reports.mean_by(results_of(spark, sf_dir), "Driver", "Position"), "mean")


@registered(f'select "Team", round(sum("Points"), 3) total from {_RESULTS} group by 1')
def report_team_points(spark, sf_dir):
    return rounded(reports.totals(results_of(spark, sf_dir), "Team", "Points"), "total", n=3)


@registered(f'select "Team", round(avg("Position"), 6) mean from {_RESULTS} group by 1')
def report_team_position(spark, sf_dir):
    return rounded(reports.mean_by(results_of(spark, sf_dir), "Team", "Position"), "mean")


@registered(f'select "Team", round(avg("GridPosition" - "Position"), 6) mean from {_RESULTS} group by 1')
def report_team_gained(spark, sf_dir):
    rows = results_of(spark, sf_dir).withColumn("gained", E.difference(F.col("GridPosition"), F.col("Position")))
    return rounded(reports.mean_by(rows, "Team", "gained", ascending=False), "mean")


@registered(f'select "GridPosition", "Position" from {_RESULTS}')
def report_pairs(spark, sf_dir):
    return reports.pairs(results_of(spark, sf_dir), "GridPosition", "Position")


_TOP6 = f'(select "Team" from {_RESULTS} group by 1 order by count(*) desc, "Team" limit 6)'
_FIVE = "count({0}) n, min({0}) least, round(quantile_cont({0}, 0.25), 6) q1, round(quantile_cont({0}, 0.5), 6) median, round(quantile_cont({0}, 0.75), 6) q3, max({0}) most"


@registered(f"""select "Team", {_FIVE.format('"Position"')} from {_RESULTS} where "Team" in {_TOP6} group by 1""")
def report_top_distribution(spark, sf_dir):
    return rounded(reports.distribution_of_top(results_of(spark, sf_dir), "Team", "Position"), "q1", "median", "q3")


@registered(f"""select position_group, {_FIVE.format('"Points"')} from (select *, case when "Position" <= 5 then '1-5' when "Position" <= 10 then '6-10' when "Position" <= 15 then '11-15' else '16-20' end position_group from {_RESULTS}) group by 1""")
def report_position_groups(spark, sf_dir):
    return rounded(reports.by_position_group(results_of(spark, sf_dir), "Position", "Points"), "q1", "median", "q3")


@registered(f'select "Points", "Position" from {_RESULTS} where "Points" < 3.0')
def report_close_gaps(spark, sf_dir):
    return reports.close_gaps(results_of(spark, sf_dir), "Points", "Position")


@registered(f'select "GridPosition", round(avg("Position"), 6) mean from {_RESULTS} group by 1')
def report_mean_by_grid(spark, sf_dir):
    return rounded(reports.mean_by(results_of(spark, sf_dir), "GridPosition", "Position"), "mean")


@registered(f'select round(avg("GridPosition" - "Position"), 6) mean, round(quantile_cont("GridPosition" - "Position", 0.5), 6) median from {_RESULTS}')
def report_positions_gained(spark, sf_dir):
    return rounded(reports.positions_gained(results_of(spark, sf_dir), "GridPosition", "Position")[2], "mean", "median")


@registered(f"""select session, {_FIVE.format("time")} from (select 'Q1' session, "Points" time from {_RESULTS} where "Position" <= 10 union all select 'Q2', "GridPosition" from {_RESULTS} where "Position" <= 10) group by 1""")
def report_sessions(spark, sf_dir):
    rows = results_of(spark, sf_dir).select("Driver", F.col("Points").alias("Q1"), F.col("GridPosition").alias("Q2"), F.when(F.col("Position") <= 10, F.col("Position")).alias("Q3"))
    return rounded(reports.session_times(rows, ["Driver"], ["Q1", "Q2"], "Q3"), "q1", "median", "q3")


@registered(f'select "Team", round(avg("Points"), 6) mean from {_RESULTS} group by 1 order by avg("Points"), "Team" limit 10')
def report_team_gap(spark, sf_dir):
    return rounded(reports.mean_by(results_of(spark, sf_dir), "Team", "Points", 10), "mean")


@registered(f'select "Driver", round(avg("GridPosition"), 6) mean from {_RESULTS} group by 1 order by avg("GridPosition"), "Driver" limit 15')
def report_grid_top(spark, sf_dir):
    return rounded(reports.mean_by(results_of(spark, sf_dir), "Driver", "GridPosition", 15), "mean")


@registered(f"""with r as {_RESULTS}, w as (select "Driver", avg(case when "Position" = 1 then 1.0::double else 0 end) * 100 x from r group by 1), t as (select "Team", avg(case when "Status" = 'Finished' then 1.0::double else 0 end) * 100 y from r group by 1)
select "Race", "GridPosition" - "Position" "PositionChange", round(x, 6) driver_win_rate, round(y, 6) team_reliability, case when "Position" <= 1 then 1 else 0 end race_winner, case when "Position" <= 3 then 1 else 0 end podium_finish, case when "Position" <= 10 then 1 else 0 end points_finish
from r join w using ("Driver") join t using ("Team")""")
def result_features(spark, sf_dir):
    out = jobs.result_features(results_of(spark, sf_dir))
    return rounded(out.select("Race", "PositionChange", "driver_win_rate", "team_reliability", "race_winner", "podium_finish", "points_finish"), "driver_win_rate", "team_reliability")


_DW = 'over (partition by "Driver" order by "Year", "Race" rows between {} and current row)'


@registered(f"""with f as (select *, avg("Position") {_DW.format("5 preceding")} a, min("Position") {_DW.format("5 preceding")} b, sum(case when "Position" <= 3 then 1 else 0 end) {_DW.format("5 preceding")} p from {_RESULTS}),
l as (select "Driver", arg_max(a, ("Year", "Race")) a, arg_max(b, ("Year", "Race")) b, arg_max(p, ("Year", "Race")) p, arg_max("Team", ("Year", "Race")) t from f group by 1)
select round(a, 2) predicted_position, "Driver" driver, t team, 0.85::double confidence, cast(b as int) best_position, cast(p as int) podiums from l order by round(a, 2), "Driver" limit 20""")
def score_next_event(spark, sf_dir):
    out = jobs.score_next_event(results_of(spark, sf_dir))
    return out.select("predicted_position", "driver", "team", "confidence", "recent_form.best_position", "recent_form.podiums")


@registered("select event_id, sum(value) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row) clock from events")
def cumulative_time(spark, sf_dir):
    return laps.cumulative_time(read(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "value").select("event_id", "clock")


def _folder(spark: SparkSession) -> str:
    """A new folder in the shared checkpoint folder; in local mode without one, in the warehouse."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = spark.conf.get("spark.sql.warehouse.dir")
    return f"{shared.rstrip('/')}/stream-{uuid.uuid4().hex}"


def _stored(df: DataFrame) -> DataFrame:
    """``df`` read again from Parquet in a new shared folder."""
    path = _folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
