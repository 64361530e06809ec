"""Queries for sources and sinks, joins, aggregates, top-k and set operations."""

from __future__ import annotations


from pyspark.sql import functions as F

from tessera.functions import cross as X
from tessera.functions import windows as W
from tessera.operators import aggregates as A
from tessera.operators import align as G
from tessera.operators import bars as B
from tessera.plans.q_windows import panel_m, rank_sql
from tessera.plans.registry import UPTO, P, query, r, with_views
from tessera.session import scratch_path
from tessera.sources import panel as src
from tessera.sources import storage as st

c = F.col
BAR_COLUMNS = ("open", "high", "low", "close", "volume", "amount")


def bars_d(spark, path):
    return src.bars_daily(spark, path)


def bars_m(spark, path):
    return src.bars_monthly(spark, path)


def lit_date(text):
    return F.lit(text).cast("date")


# -- sources and sinks ---------------------------------------------------------------------------
@query(
    "S01_scan_table",
    "select l_orderkey, l_linenumber, l_partkey, l_quantity from lineitem where l_quantity > 45 and l_shipdate >= timestamp '1998-01-01'",
)
def s01(spark, path):
    df = src.table(spark, path, "lineitem").where("l_quantity > 45 and l_shipdate >= timestamp_ntz '1998-01-01'")
    return df.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


@query("S02_scan_by_code", "select l_orderkey, l_partkey, l_extendedprice from lineitem where l_suppkey = 7 and l_quantity < 40")
def s02(spark, path):
    df = src.table(spark, path, "lineitem").where("l_suppkey = 7 and l_quantity < 40")
    return df.select("l_orderkey", "l_partkey", "l_extendedprice")


@query("S03_code_list", "select s_suppkey as code, s_suppkey in (select l_suppkey from lineitem) as has_price from supplier")
def s03(spark, path):
    priced = src.table(spark, path, "lineitem").select(c("l_suppkey").alias("code")).distinct().withColumn("has_price", F.lit(True))
    listed = src.table(spark, path, "supplier").select(c("s_suppkey").alias("code"))
    return listed.join(priced, "code", "left").fillna({"has_price": False})


@query("S04_industry_map", with_views("select code, industry from dim", "dim"))
def s04(spark, path):
    return src.listing(spark, path).select("code", "industry")


@query(
    "S05_index_members",
    with_views(
        "select index_code, code, bool_or(dt = date '1998-03-01') as on_day from weights where index_code in ('ASIA', 'EUROPE') group by 1, 2",
        "weights",
    ),
)
def s05(spark, path):
    df = src.index_weights(spark, path).where(c("index_code").isin("ASIA", "EUROPE"))
    return df.groupBy("index_code", "code").agg(F.bool_or(c("dt") == lit_date("1998-03-01")).alias("on_day"))


@query(
    "S06_index_price",
    with_views(
        """select market, dt, round(avg(close), 6) as close, round(sum(volume), 6) as volume from bars_m join dim using (code)
        where dt between date '1997-01-01' and date '1999-12-31' group by 1, 2 order by 1, 2""",
        "bars_m",
        "dim",
    ),
)
def s06(spark, path):
    df = bars_m(spark, path).join(src.listing(spark, path), "code")
    df = df.where(c("dt").between(lit_date("1997-01-01"), lit_date("1999-12-31")))
    return df.groupBy("market", "dt").agg(r(F.avg("close")).alias("close"), r(F.sum("volume")).alias("volume")).orderBy("market", "dt")


@query(
    "S07_calendar",
    with_views("select strftime(dt, '%Y-%m-%d') as day from cal where dt between date '1996-01-01' and date '1997-12-31'", "cal"),
)
def s07(spark, path):
    days = src.calendar(spark, path).where(c("dt").between(lit_date("1996-01-01"), lit_date("1997-12-31")))
    return days.select(F.date_format("dt", "yyyy-MM-dd").alias("day"))


def factor_table(spark, path):
    bars = bars_m(spark, path)
    return bars.select(
        "code", "dt", (c("close") / c("open")).alias("gain"), (c("high") - c("low")).alias("spread"), c("volume").alias("lots")
    )


_factor_sql = "select code, dt, close / open as gain, high - low as spread, volume as lots from bars_m"


@query(
    "S08_read_factors",
    with_views(
        f"""select code, dt, round(gain, 6) as gain, round(lots, 6) as lots from ({_factor_sql}) where dt between date '1996-01-01'
        and date '1998-12-31' and code in (select code from dim where market = 'ASIA')""",
        "bars_m",
        "dim",
    ),
)
def s08(spark, path):
    store = scratch_path(spark, "factors")
    st.write_factors(st.to_long(factor_table(spark, path), ["gain", "spread", "lots"]), store)
    codes = src.listing(spark, path).where("market = 'ASIA'")
    out = st.read_factors(spark, store, ["gain", "lots"], "1996-01-01", "1998-12-31", codes)
    return out.select("code", "dt", r("gain").alias("gain"), r("lots").alias("lots"))


@query(
    "S09_write_factor",
    with_views(
        f"select factor, code, dt, round(value, 6) as value from (unpivot ({_factor_sql}) on gain, spread, lots into name factor value value)",
        "bars_m",
    ),
)
def s09(spark, path):
    store = scratch_path(spark, "factors")
    long = st.to_long(factor_table(spark, path), ["gain", "spread", "lots"])
    early = c("dt") < lit_date("1999-01-01")
    st.write_factors(long.where(early), store)
    st.write_factors(long.where(~early), store)
    return spark.read.parquet(store).select("factor", "code", "dt", r("value").alias("value"))


@query("S10_latest_snapshot", with_views("select code, dt, round(close, 6) as close from bars_m where dt = (select max(dt) from bars_m)", "bars_m"))
def s10(spark, path):
    return st.latest_snapshot(bars_m(spark, path)).select("code", "dt", r("close").alias("close"))


@query(
    "S11_aligned_store",
    with_views(
        f"select code, dt, round(last_value(adj_factor ignore nulls) {UPTO}, 6) as adj_factor from bars_d left join adj using (code, dt)",
        "bars_d",
        "adj",
    ),
)
def s11(spark, path):
    out = st.aligned(bars_d(spark, path), src.adjustments(spark, path), ["adj_factor"])
    return out.select("code", "dt", r("adj_factor").alias("adj_factor"))


_bars_round = ", ".join(f"round({k}, 4) as {k}" for k in BAR_COLUMNS)


@query("S12_export_by_code", with_views(f"select code, dt, year(dt)::integer as year, {_bars_round} from bars_d", "bars_d"))
def s12(spark, path):
    store = scratch_path(spark, "by-code")
    bars = bars_d(spark, path)
    st.export_by_code(bars, store, buckets=4)
    st.export_by_code(bars.where(F.year("dt") == 1998), store, buckets=4)  # a rerun replaces its own year only
    return spark.read.parquet(store).select("code", "dt", "year", *[r(k, 4).alias(k) for k in BAR_COLUMNS])


@query(
    "S13_export_by_date",
    """select user_id as code, cast(ts as date) as dt, year(ts)::integer as year, month(ts)::integer as month, day(ts)::integer as day,
       round(max(value), 4) as high, round(min(value), 4) as low from events group by all""",
)
def s13(spark, path):
    store = scratch_path(spark, "by-date")
    st.export_by_date(event_bars(spark, path), store)
    return spark.read.parquet(store).select("code", "dt", "year", "month", "day", r("high", 4).alias("high"), r("low", 4).alias("low"))


def event_bars(spark, path):
    order = F.struct("ts", "event_id")
    events = src.table(spark, path, "events")
    return events.groupBy(c("user_id").alias("code"), src.day("ts").alias("dt")).agg(
        F.min_by("value", order).alias("open"),
        F.max("value").alias("high"),
        F.min("value").alias("low"),
        F.max_by("value", order).alias("close"),
    )


@query("S14_latest_partition", "select year(m)::integer as year, month(m)::integer as month, day(m)::integer as day from (select max(ts) as m from events)")
def s14(spark, path):
    store = scratch_path(spark, "by-date")
    st.export_by_date(event_bars(spark, path), store)
    return st.latest_partition(spark.read.parquet(store))


@query(
    "S15_normalise_bars",
    """select strftime(ts, '%Y-%m-%d 09:30:00') || '+08:00' as time, cast(user_id as varchar) as code,
       coalesce(try_cast(event_type as double), 0.0::double) as open, value as high, value as low, value as close,
       coalesce(try_cast(json_extract_string(props, '$.k') as double), 0.0::double) as volume, 0.0::double as amount from events""",
)
def s15(spark, path):
    events = src.table(spark, path, "events").withColumn("k", F.get_json_object("props", "$.k"))
    names = {"code": "user_id", "open": "event_type", "high": "value", "low": "value", "close": "value", "volume": "k"}
    return st.normalise_bars(events, names, "ts")


@query(
    "S16_append_evolve",
    """select coalesce(cast(event_id as varchar), '') as code, coalesce(event_type, '') as kind, value, 0.0::double as score from events where event_id % 2 = 0
       union all select cast(event_id as varchar), '', 0.0::double, coalesce(try_cast(json_extract_string(props, '$.k') as double), 0.0::double) from events
       where event_id % 2 = 1""",
)
def s16(spark, path):
    events = src.table(spark, path, "events")
    old = events.where("event_id % 2 = 0").select(c("event_id").alias("code"), c("event_type").alias("kind"), "value")
    new = events.where("event_id % 2 = 1").select(c("event_id").alias("code"), F.get_json_object("props", "$.k").alias("score"))
    return st.append_evolve(old, new, text=["code", "kind"], numbers=["value", "score"])


@query("S17_replace_table", "select n_nationkey, n_name from nation where n_nationkey >= 5")
def s17(spark, path):
    store = scratch_path(spark, "nation")
    nation = src.table(spark, path, "nation").select("n_nationkey", "n_name")
    st.replace_table(nation, store)
    st.replace_table(nation.where("n_nationkey >= 5"), store)
    return st.read_table(spark, store)


@query(
    "S18_incremental_append",
    with_views(
        """select code, dt, round(close, 6) as close, dt < date '1999-06-01' as old_table,
        dt < (select max(dt) from bars_m o where o.code = b.code and o.dt < date '1999-06-01') as old_code from bars_m b""",
        "bars_m",
    ),
)
def s18(spark, path):
    bars = bars_m(spark, path).select("code", "dt", r("close").alias("close"))
    seen = bars.where(c("dt") < lit_date("1999-07-01"))
    table = st.incremental_append(seen.withColumn("old_table", F.lit(True)), bars.withColumn("old_table", F.lit(False)))
    stored = bars.where(c("dt") < lit_date("1999-06-01"))
    by_code = st.incremental_append(stored.withColumn("old_code", F.lit(True)), bars.withColumn("old_code", F.lit(False)), per_code=True)
    return table.join(by_code.drop("close"), ["code", "dt"])


@query(
    "S19_missing_periods",
    with_views(
        """select code, period from (select code, unnest(range(lo, hi + interval 1 day, interval 3 month))::date as period
        from (select code, min(period)::timestamp as lo, max(period)::timestamp as hi from fund group by code))
        except select code, period from fund where cast(shares as bigint) % 5 <> 0""",
        "fund",
    ),
)
def s19(spark, path):
    fund = src.statements(spark, path)
    span = fund.groupBy("code").agg(F.min("period").alias("lo"), F.max("period").alias("hi"))
    quarters = F.explode(F.sequence("lo", "hi", F.expr("interval 3 month"))).alias("period")
    return st.missing_periods(span.select("code", quarters), fund.where("cast(shares as bigint) % 5 <> 0"))


@query(
    "S20_restated_periods",
    """with d as (select l_suppkey as code, cast(date_trunc('quarter', l_shipdate) as date) as period, l_quantity from lineitem)
       select code, period, count(*) as disclosed, count(*) filter (l_quantity > 10) as stored from d group by 1, 2
       having count(*) filter (l_quantity > 10) between 1 and count(*) - 1""",
)
def s20(spark, path):
    lines = src.table(spark, path, "lineitem").select(
        c("l_suppkey").alias("code"), F.trunc(src.day(), "quarter").alias("period"), "l_quantity"
    )
    return st.restated_periods(lines, lines.where("l_quantity > 10"))


@query("S21_delete_date", with_views("select code, dt, round(close, 6) as close from bars_m where dt <> date '1998-05-01'", "bars_m"))
def s21(spark, path):
    return st.delete_date(bars_m(spark, path), "1998-05-01").select("code", "dt", r("close").alias("close"))


@query(
    "S22_backfill_dates",
    with_views(
        "select code, dt, round(close, 6) as close from bars_m where dt >= date '1997-01-01' or code % 2 = 0 or "
        "dt in (select dt from bars_m where code % 2 = 0 and dt < date '1997-01-01' group by dt having count(*) <= 50)",
        "bars_m",
    ),
)
def s22(spark, path):
    store = scratch_path(spark, "snapshots")
    bars = bars_m(spark, path).select("code", "dt", r("close").alias("close"))
    thin = bars.where((c("dt") >= lit_date("1997-01-01")) | (c("code") % 2 == 0))
    thin.repartition("dt").write.partitionBy("dt").parquet(store)
    st.backfill_dates(spark, spark.read.parquet(store), bars, store, 50)
    return spark.read.parquet(store).select("code", "dt", "close")


_div_cte = {
    "dv": """select code, dt as record_date, dt + 3 as ann_date, case when code % 9 = 0 then null else cast(dt + 10 as date) end as pay_date,
        cast(dt + 5 as date) as ex_date, adj_factor - 1 as cash, case when code % 4 = 3 then 'plan' else 'implemented' end as div_proc from adj"""
}


def dividend_table(spark, path):
    """One dividend per code and month: the step of the adjustment factor, most of them implemented."""
    adj = src.adjustments(spark, path)
    return adj.select(
        "code",
        c("dt").alias("record_date"),
        F.date_add("dt", 3).alias("ann_date"),
        F.when(c("code") % 9 != 0, F.date_add("dt", 10)).alias("pay_date"),
        F.date_add("dt", 5).alias("ex_date"),
        (c("adj_factor") - 1).alias("cash"),
        F.when(c("code") % 4 == 3, "plan").otherwise("implemented").alias("div_proc"),
    )


@query(
    "S23_dividend_events",
    with_views(
        "select code, record_date, pay_date, round(cash, 6) as cash from dv where div_proc = 'implemented' "
        "qualify row_number() over (partition by record_date, code order by ann_date desc) = 1",
        "adj",
        extra=_div_cte,
    ),
)
def s23(spark, path):
    return st.dividend_events(dividend_table(spark, path)).select("code", "record_date", "pay_date", r("cash").alias("cash"))


@query(
    "S24_date_slices",
    """select user_id, greatest(lo, m) as start, least(hi, last_day(m)) as "end" from
       (select user_id, lo, hi, unnest(range(date_trunc('month', lo)::timestamp, hi::timestamp + interval 1 day, interval 1 month))::date as m from
        (select l_suppkey as user_id, min(l_shipdate)::date as lo, max(l_shipdate)::date as hi from lineitem group by 1))""",
)
def s24(spark, path):
    lines = src.table(spark, path, "lineitem")
    span = lines.groupBy(c("l_suppkey").alias("user_id")).agg(F.min(src.day()).alias("start"), F.max(src.day()).alias("end"))
    return st.month_slices(span)


@query(
    "S25_upsert_result",
    """with o as (select o_custkey, cast(o_orderdate as date) as day, max(o_totalprice) as score from orders where o_orderstatus = 'F' group by 1, 2),
       n as (select o_custkey, cast(o_orderdate as date) as day, max(o_totalprice) as score from orders where o_orderstatus <> 'F' group by 1, 2)
       select md5(concat_ws(',', coalesce(n.o_custkey, o.o_custkey)::varchar, coalesce(n.day, o.day)::varchar)) as hash,
       coalesce(n.o_custkey, o.o_custkey) as o_custkey, coalesce(n.day, o.day) as day, coalesce(n.score, o.score) as score
       from o full join n on o.o_custkey = n.o_custkey and o.day = n.day""",
)
def s25(spark, path):
    orders = src.table(spark, path, "orders").withColumn("day", src.day("o_orderdate"))

    def best(df):
        return df.groupBy("o_custkey", "day").agg(F.max("o_totalprice").alias("score"))

    return st.upsert(best(orders.where("o_orderstatus = 'F'")), best(orders.where("o_orderstatus <> 'F'")), ["o_custkey", "day"])


@query(
    "S26_union_listings",
    """select 'listed' as state, s_suppkey as code, s_name as name from supplier union all
       select 'delisted', c_custkey, c_name from customer where c_acctbal < 0 union all select 'paused', c_custkey, c_name from customer where c_acctbal > 9000""",
)
def s26(spark, path):
    supplier, customer = src.table(spark, path, "supplier"), src.table(spark, path, "customer")

    def part(df, state, code, name):
        return df.select(F.lit(state).alias("state"), c(code).alias("code"), c(name).alias("name"))

    return (
        part(supplier, "listed", "s_suppkey", "s_name")
        .unionByName(part(customer.where("c_acctbal < 0"), "delisted", "c_custkey", "c_name"))
        .unionByName(part(customer.where("c_acctbal > 9000"), "paused", "c_custkey", "c_name"))
    )


@query("S27_min_last_date", "select min(m)::date as dt from (select event_type, max(ts)::date as m from events group by 1)")
def s27(spark, path):
    return st.min_last_date(src.table(spark, path, "events").select(c("event_type").alias("factor"), src.day("ts").alias("dt")))


@query(
    "S28_top_results",
    """select o_orderkey, o_totalprice, c_name from (select * from orders order by o_totalprice desc, o_orderkey limit 100) o
       left join customer on o_custkey = c_custkey""",
)
def s28(spark, path):
    best = src.table(spark, path, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100)
    customer = src.table(spark, path, "customer")
    return best.join(customer, c("o_custkey") == c("c_custkey"), "left").select("o_orderkey", "o_totalprice", "c_name")


# -- joins ------------------------------------------------------------------------------------------
@query(
    "J01_left_equi",
    with_views("select code, dt, round(close, 6) as close, round(adj_factor, 6) as adj_factor from bars_d left join adj using (code, dt)", "bars_d", "adj"),
)
def j01(spark, path):
    out = bars_d(spark, path).join(src.adjustments(spark, path), ["code", "dt"], "left")
    return out.select("code", "dt", r("close").alias("close"), r("adj_factor").alias("adj_factor"))


_aligned_cte = {
    "al": """select s.code, cal.dt, b.open, b.high, b.low, b.close, b.volume, b.amount
        from (select code, min(dt) as lo, max(dt) as hi from bars_d group by code) s join cal on cal.dt between s.lo and s.hi
        left join bars_d b on b.code = s.code and b.dt = cal.dt"""
}


@query(
    "J02_calendar_align",
    with_views(f"select code, dt, round(last_value(close ignore nulls) {UPTO}, 6) as close from al", "bars_d", "cal", extra=_aligned_cte),
)
def j02(spark, path):
    out = B.align_to_calendar(bars_d(spark, path), src.calendar(spark, path))
    return out.select("code", "dt", r(W.ffill(c("close"))).alias("close"))


@query("J03_right_then_drop", with_views("select code, dt, round(close * adj_factor, 6) as v from bars_d join adj using (code, dt)", "bars_d", "adj"))
def j03(spark, path):
    out = bars_d(spark, path).join(src.adjustments(spark, path), ["code", "dt"], "inner")
    return out.select("code", "dt", r(c("close") * c("adj_factor")).alias("v"))


_names_cte = {
    "nm": "select code, period as dt, case when cast(shares as bigint) % 3 = 0 then 'ST ' else '' end || 'Supplier ' || cast(code as varchar) as name from fund"
}


def name_history(spark, path):
    prefix = F.when(c("shares").cast("long") % 3 == 0, "ST ").otherwise("")
    name = F.concat(prefix, F.lit("Supplier "), c("code").cast("string"))
    return src.statements(spark, path).select("code", c("period").alias("dt"), name.alias("name"))


@query(
    "J04_asof_name",
    with_views(
        """select b.code, b.dt, coalesce(n.name, f.name) as name from bars_d b asof left join nm n on n.code = b.code and n.dt <= b.dt
        left join (select code, arg_min(name, dt) as name from nm group by code) f on f.code = b.code""",
        "bars_d",
        "fund",
        extra=_names_cte,
    ),
)
def j04(spark, path):
    out = B.carry_events(bars_d(spark, path).select("code", "dt"), name_history(spark, path), ["name"], back=True)
    return out.select("code", "dt", "name")


@query(
    "J05_align_events",
    with_views(
        f"""select b.code, b.dt, round(a.eps, 6) as eps3, round(e.eps, 6) as eps2, round(last_value(e.eps ignore nulls)
        over (partition by b.code order by b.dt rows between unbounded preceding and current row), 6) as eps0
        from bars_d b asof left join fund a on a.code = b.code and a.ann_date < b.dt
        left join fund e on e.code = b.code and e.ann_date = b.dt""",
        "bars_d",
        "fund",
    ),
)
def j05(spark, path):
    keys = bars_d(spark, path).select("code", "dt")
    fund = src.statements(spark, path)
    text = fund.withColumn("ann_text", F.date_format("ann_date", "yyyy-MM-dd"))
    out = G.align_events(keys, text.select("code", "ann_text", c("eps").alias("eps0")), "ann_text", ["eps0"], 1)
    out = G.align_events(out, fund.select("code", "ann_date", c("eps").alias("eps2")), "ann_date", ["eps2"], 2)
    out = G.align_events(out, fund.select("code", "ann_date", c("eps").alias("eps3")), "ann_date", ["eps3"], 3)
    return out.select("code", "dt", *[r(k).alias(k) for k in ("eps0", "eps2", "eps3")])


@query(
    "J06_asof_strict",
    with_views(
        """, d as (select index_code, max(dt) as as_of from weights where dt < date '1998-07-15' group by 1),
        q as (select distinct market as index_code, dt from bars_d join dim using (code)),
        m as (select q.index_code, q.dt, max(w.dt) as as_of from q join (select distinct index_code, dt from weights) w
          on w.index_code = q.index_code and w.dt < q.dt group by 1, 2)
        select m.index_code, m.dt, m.as_of, count(*) as members, round(max(w.weight), 8) as top from m join weights w
        on w.index_code = m.index_code and w.dt = m.as_of group by 1, 2, 3""".lstrip(", "),
        "weights",
        "bars_d",
    ).replace(" d as (select", ", d as (select", 1),
)
def j06(spark, path):
    bars = bars_d(spark, path).join(src.listing(spark, path), "code")
    dates = bars.select(c("market").alias("index_code"), "dt").distinct()
    out = G.before_strictly(dates, src.index_weights(spark, path), ["index_code"])
    return out.groupBy("index_code", "dt", "as_of").agg(F.count(F.lit(1)).alias("members"), r(F.max("weight"), 8).alias("top"))


@query("J07_inner_dim", with_views("select code, dt, industry, round(close, 6) as close from bars_d join dim using (code)", "bars_d", "dim"))
def j07(spark, path):
    # No hint: Spark broadcasts the listing only while its measured size allows it.
    out = bars_d(spark, path).join(src.listing(spark, path), "code")
    return out.select("code", "dt", "industry", r("close").alias("close"))


@query(
    "J08_sql_left",
    with_views("select code, dt, round(amount, 4) as amount, market from bars_m left join (select * from dim where market <> 'ASIA') using (code)", "bars_m", "dim"),
)
def j08(spark, path):
    out = bars_m(spark, path).join(src.listing(spark, path).where("market <> 'ASIA'"), "code", "left")
    return out.select("code", "dt", r("amount", 4).alias("amount"), "market")


@query(
    "J09_sql_right",
    """select c_custkey, o_orderkey, o_totalprice from (select * from orders where o_orderstatus = 'F') right join customer on o_custkey = c_custkey
       order by o_totalprice desc nulls last, c_custkey, o_orderkey limit 100""",
)
def j09(spark, path):
    orders = src.table(spark, path, "orders").where("o_orderstatus = 'F'")
    out = orders.join(src.table(spark, path, "customer"), c("o_custkey") == c("c_custkey"), "right")
    return out.select("c_custkey", "o_orderkey", "o_totalprice").orderBy(F.desc_nulls_last("o_totalprice"), "c_custkey", "o_orderkey").limit(100)


def predictions(spark, path):
    """Stand-in model output: last month's gain."""
    bars = bars_m(spark, path)
    pred = bars.select("code", "dt", (c("close") / W.delay(c("close"))).alias("pred"))
    return pred.where("pred is not null")


_pred_cte = {"pr": f"select * from (select code, dt, close / lag(close) {P} as pred from bars_m) where pred is not null"}


@query(
    "J10_pred_join",
    with_views("select code, dt, round(pred, 6) as pred, round(close, 6) as close from pr left join bars_d using (code, dt)", "bars_m", "bars_d", extra=_pred_cte),
)
def j10(spark, path):
    out = predictions(spark, path).join(bars_d(spark, path), ["code", "dt"], "left")
    return out.select("code", "dt", r("pred").alias("pred"), r("close").alias("close"))


@query(
    "J11_candidate_join",
    with_views(
        "select code, dt, round(pred, 6) as pred from pr join bars_m using (code, dt) where pred > 1 and close > open and volume > 100",
        "bars_m",
        extra=_pred_cte,
    ),
)
def j11(spark, path):
    out = predictions(spark, path).where("pred > 1").join(bars_m(spark, path), ["code", "dt"])
    return out.where("close > open and volume > 100").select("code", "dt", r("pred").alias("pred"))


@query(
    "J12_factor_wide_join",
    with_views(f"select code, dt, round(gain, 6) as gain, round(spread, 6) as spread from ({_factor_sql})", "bars_m"),
)
def j12(spark, path):
    long = st.to_long(factor_table(spark, path), ["gain", "spread"])
    wide = long.groupBy("code", "dt").pivot("factor", ["gain", "spread"]).agg(F.first("value"))
    return wide.select("code", "dt", r("gain").alias("gain"), r("spread").alias("spread"))


@query("J13_anti_codes", "select s_suppkey as code from supplier where s_suppkey not in (select l_suppkey from lineitem where l_quantity = 50 and l_discount = 0)")
def j13(spark, path):
    chosen = src.table(spark, path, "lineitem").where("l_quantity = 50 and l_discount = 0").select(c("l_suppkey").alias("code"))
    return src.table(spark, path, "supplier").select(c("s_suppkey").alias("code")).join(chosen, "code", "left_anti")


@query("J14_semi_valid", "select distinct event_type as factor from events where event_type in (select event_type from events where value > 50)")
def j14(spark, path):
    events = src.table(spark, path, "events").select(c("event_type").alias("factor"), "value")
    return events.select("factor").distinct().join(events.where("value > 50"), "factor", "left_semi")


# -- aggregates ----------------------------------------------------------------------------------------
@query("A01_max_date", with_views("select code, max(dt) as dt from bars_d group by code", "bars_d"))
def a01(spark, path):
    lines = src.table(spark, path, "lineitem")
    return lines.groupBy(c("l_suppkey").alias("code")).agg(F.max(src.day()).alias("dt"))


@query(
    "A02_describe",
    with_views(
        """select market, count(z) as count, round(avg(z), 4) as mean, round(stddev_samp(z), 4) as std, round(min(z), 4) as min,
        round(quantile_cont(z, 0.25), 4) as q25, round(quantile_cont(z, 0.5), 4) as q50, round(quantile_cont(z, 0.75), 4) as q75, round(max(z), 4) as max
        from pm group by market""",
        "pm",
    ),
)
def a02(spark, path):
    out = A.describe(panel_m(spark, path), "z", ["market"])
    return out.select("market", "count", *[r(k, 4).alias(k) for k in ("mean", "std", "min", "q25", "q50", "q75", "max")])


def factor_returns(spark, path):
    """Two-row panel statistics: factor gain, next return, its quantile by date."""
    bars = bars_m(spark, path).join(src.listing(spark, path), "code")
    ret = F.try_divide(W.future(c("close"), 1), W.future(c("open"), 1))
    return bars.select("code", "dt", "market", "industry", (c("close") / c("open")).alias("f"), c("volume").alias("g"), ret.alias("ret")).where("ret is not null")


_fr_cte = {
    "fr0": f"select code, dt, market, industry, close / open as f, volume as g, lead(close) {P} / lead(open) {P} as ret from bars_m join dim using (code)",
    "fr": "select * from fr0 where ret is not null",
}


@query(
    "A03_quantile_mean",
    with_views(
        """select dt, cast(q as integer) as q, round(avg(ret), 6) as ret from (select fr.*, greatest(len(list_filter(edges, lambda e: e < f)), 1) as q
        from fr join (select dt, list_distinct(quantile_cont(f, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0])) as edges from fr group by dt) using (dt) where len(edges) > 1)
        group by 1, 2""",
        "bars_m",
        "dim",
        extra=_fr_cte,
    ),
)
def a03(spark, path):
    out = X.add_buckets(factor_returns(spark, path), "f", 5, "q").where("q is not null")
    return out.groupBy("dt", c("q").cast("int").alias("q")).agg(r(F.avg("ret")).alias("ret"))


@query("A04_bucket_120d", with_views("select code, dt, cast(floor((dt - (select min(dt) from bars_m)) / 120) as integer) as bin from bars_m", "bars_m"))
def a04(spark, path):
    bars = bars_m(spark, path).select("code", "dt")
    return bars.withColumn("bin", A.day_bucket(bars, 120))


def corr_agg_sql(x, y):
    return f"case when stddev_pop({x}) > 1e-12 and stddev_pop({y}) > 1e-12 then covar_pop({x}, {y}) / (stddev_pop({x}) * stddev_pop({y})) end"


@query("A05_corr_agg", with_views(f"select dt, round({corr_agg_sql('f', 'ret')}, 6) as ic from fr group by dt", "bars_m", "dim", extra=_fr_cte))
def a05(spark, path):
    return factor_returns(spark, path).groupBy("dt").agg(r(A.pearson(c("f"), c("ret"))).alias("ic"))


@query(
    "A06_rank_corr_agg",
    with_views(
        f"select dt, round({corr_agg_sql('rf', 'rr')}, 6) as ic from (select dt, {rank_sql('g')} as rf, {rank_sql('ret')} as rr from fr) group by dt",
        "bars_m",
        "dim",
        extra=_fr_cte,
    ),
)
def a06(spark, path):
    out = A.rank_correlation(factor_returns(spark, path), "g", "ret", ["dt"], "ic")
    return out.select("dt", r("ic").alias("ic"))


_matrix = ("open", "close", "volume", "amount")


@query(
    "A07_corr_matrix",
    with_views(
        " union all ".join(
            f"select '{a}' as a, '{b}' as b, round({corr_agg_sql(a, b)}, 6) as corr from bars_m" for i, a in enumerate(_matrix) for b in _matrix[i:]
        ),
        "bars_m",
    ),
)
def a07(spark, path):
    return A.corr_matrix(bars_m(spark, path), _matrix).select("a", "b", r("corr").alias("corr"))


@query(
    "A08_net_value",
    with_views(
        "select market, round(ln(product(ret)), 6) as log_net from (select market, dt, avg(ret) as ret from fr group by 1, 2) group by 1", "bars_m", "dim", extra=_fr_cte
    ),
)
def a08(spark, path):
    daily = factor_returns(spark, path).groupBy("market", "dt").agg(F.avg("ret").alias("ret"))
    return daily.groupBy("market").agg(r(F.ln(F.product("ret"))).alias("log_net"))


@query(
    "A09_tertiles",
    with_views("select market, round(quantile_cont(z, 1.0/3), 4) as low, round(quantile_cont(z, 2.0/3), 4) as high from pm group by 1", "pm"),
)
def a09(spark, path):
    cuts = X.group_percentiles(panel_m(spark, path), c("z"), [1 / 3, 2 / 3], ["market"], "q")
    return cuts.select("market", r(F.get("q", F.lit(0)), 4).alias("low"), r(F.get("q", F.lit(1)), 4).alias("high"))


@query("A10_distinct_values", with_views("select market, count(distinct industry) as industries, count(distinct code) as codes from dim group by 1", "dim"))
def a10(spark, path):
    return src.listing(spark, path).groupBy("market").agg(F.count_distinct("industry").alias("industries"), F.count_distinct("code").alias("codes"))


@query(
    "A11_score_agg",
    with_views("select round(avg(ret - f) / stddev_samp(ret - f), 6) as score, count(*) filter (f > ret) as over from fr", "bars_m", "dim", extra=_fr_cte),
)
def a11(spark, path):
    miss = c("ret") - c("f")
    return factor_returns(spark, path).agg(r(F.try_divide(F.avg(miss), F.stddev_samp(miss))).alias("score"), F.count_if(c("f") > c("ret")).alias("over"))


@query(
    "A12_weighted_avg",
    with_views("select market, round(sum(g * ret) / nullif(sum(g), 0), 6) as ret from fr group by 1", "bars_m", "dim", extra=_fr_cte),
)
def a12(spark, path):
    weighted = F.try_divide(F.sum(c("g") * c("ret")), F.sum("g"))
    return factor_returns(spark, path).groupBy("market").agg(r(weighted).alias("ret"))


@query("A13_monthly_mean", with_views("select cast(date_trunc('month', dt) as date) as month, round(avg(close), 6) as close from bars_d group by 1", "bars_d"))
def a13(spark, path):
    return bars_d(spark, path).groupBy(F.trunc("dt", "month").alias("month")).agg(r(F.avg("close")).alias("close"))


@query(
    "A14_yearly_return",
    with_views("select year(dt)::integer as year, round(product(1 + ret) - 1, 6) as ret from bench group by 1", "bench"),
)
def a14(spark, path):
    bench = src.benchmark_returns(bars_m(spark, path))
    return bench.groupBy(F.year("dt").alias("year")).agg(r(F.product(1 + c("ret")) - 1).alias("ret"))


@query(
    "A15_quality_class",
    with_views(
        """select factor, case when count(v) = 0 then 2 when min(v) = 0 and max(v) = 0 then 4 when min(v) = max(v) then 5 else 1 end::integer as kind
        from (select 'gain' as factor, close as v from bars_m union all select 'zero', 0 * close from bars_m
        union all select 'flat', 0 * close + 3 from bars_m union all select 'none', null from bars_m) group by 1""",
        "bars_m",
    ),
)
def a15(spark, path):
    close = c("close")
    wide = bars_m(spark, path).select(
        "code", "dt", close.alias("gain"), (0 * close).alias("zero"), (0 * close + 3).alias("flat"), F.when(close < 0, 1.0).alias("none")
    )
    return A.quality_class(st.to_long(wide, ["gain", "zero", "flat", "none"]))


@query(
    "A16_row_hash",
    "select p_partkey, md5(concat_ws('|', p_name, p_brand, p_size::varchar)) as hash, md5(concat_ws('|', p_name, p_brand, p_size::varchar)) <> md5(concat_ws('|', p_name, p_brand, abs(p_size - 25)::varchar)) as changed from part",
)
def a16(spark, path):
    part = src.table(spark, path, "part")
    old = part.select("p_partkey", F.md5(F.concat_ws("|", "p_name", "p_brand", F.abs(c("p_size") - 25).cast("string"))).alias("old"))
    new = part.select("p_partkey", A.row_hash("p_name", "p_brand", "p_size").alias("hash"))
    return new.join(old, "p_partkey").select("p_partkey", "hash", (c("hash") != c("old")).alias("changed"))


# -- sorts, limits, sets ----------------------------------------------------------------------------
@query("K01_sort", with_views("select code, dt, round(close, 6) as close from bars_m order by code, dt", "bars_m"))
def k01(spark, path):
    return bars_m(spark, path).select("code", "dt", r("close").alias("close")).orderBy("code", "dt")


@query(
    "K02_tail_per_group",
    with_views("select code, dt, round(close, 6) as close from bars_d qualify row_number() over (partition by code order by dt desc) <= 250", "bars_d"),
)
def k02(spark, path):
    out = X.top_n(bars_d(spark, path), 250, [F.desc("dt")], ["code"])
    return out.select("code", "dt", r("close").alias("close"))


@query("K03_top_k", with_views("select code, dt, round(amount, 4) as amount from bars_d order by amount desc, code, dt limit 50", "bars_d"))
def k03(spark, path):
    return bars_d(spark, path).orderBy(F.desc("amount"), "code", "dt").limit(50).select("code", "dt", r("amount", 4).alias("amount"))


@query("K04_random_sample", "select s_suppkey as code from supplier order by md5(s_suppkey || '-7'), s_suppkey limit 10")
def k04(spark, path):
    """Ten codes in the order of a seeded hash: random, but the same however the table is partitioned."""
    codes = src.table(spark, path, "supplier").select(c("s_suppkey").alias("code"))
    return codes.orderBy(F.md5(F.concat(c("code").cast("string"), F.lit("-7")).cast("binary")), "code").limit(10)


@query(
    "U01_union_all",
    with_views("select code, dt, round(close, 6) as close from bars_m union all select code, dt, round(open, 6) from bars_m", "bars_m"),
)
def u01(spark, path):
    bars = bars_m(spark, path)
    return bars.select("code", "dt", r("close").alias("close")).unionByName(bars.select("code", "dt", r("open").alias("close")))


@query("U02_difference", "select s_nationkey as key from supplier except select c_nationkey from customer where c_acctbal > 9900")
def u02(spark, path):
    left = src.table(spark, path, "supplier").select(c("s_nationkey").alias("key"))
    return left.subtract(src.table(spark, path, "customer").where("c_acctbal > 9900").select(c("c_nationkey").alias("key")))


@query(
    "U03_subset_test",
    """select count(*) = 0 as subset, (select count(distinct l_suppkey) from lineitem) as codes from
       (select distinct l_suppkey from lineitem where l_suppkey not in (select s_suppkey from supplier))""",
)
def u03(spark, path):
    used = src.table(spark, path, "lineitem").select(c("l_suppkey").alias("code")).distinct()
    known = src.table(spark, path, "supplier").select(c("s_suppkey").alias("code"), F.lit(True).alias("known"))
    both = used.join(known, "code", "left")
    return both.agg((F.count_if(c("known").isNull()) == 0).alias("subset"), F.count(F.lit(1)).alias("codes"))



