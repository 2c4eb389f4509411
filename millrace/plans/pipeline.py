"""Queries of the general data-preparation operators over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.anomalies import implausible
from millrace.operators.regrid import regrid
from millrace.operators.rolling import calendar_day, day_number, rolling_totals
from millrace.operators.skew import key_counts, skew_join
from millrace.session import cut


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# --- problem 2


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Department ids that hold at least 5 % of all rows of employees."""
    counts = cut(key_counts(table(spark, folder, "employees"), "dept_id", "emp_id"))
    total = counts.agg(F.sum("n_rows").alias("n")).scalar()
    return counts.where(F.col("key").isNotNull() & (F.col("n_rows") * 20 >= total)).select(F.col("key").alias("dept_id"))


def p2_headcounts(spark: SparkSession, folder: str) -> DataFrame:
    """Head count (distinct employees) and rows of every dept_id, null included, with the department's name where there is one."""
    counts = key_counts(table(spark, folder, "employees"), "dept_id", "emp_id")
    names = table(spark, folder, "departments").select("id", "name")
    return counts.join(names, F.col("key") == F.col("id"), "left").select(F.col("key").alias("dept_id"), "name", F.col("n_items").alias("heads"), "n_rows")


def p2_join(spark: SparkSession, folder: str) -> DataFrame:
    """Every delivered employee row with its department's name, joined without letting heavy departments fill single tasks."""
    left, right = table(spark, folder, "employees").select("emp_id", "dept_id"), table(spark, folder, "departments").select("id", "name")
    return skew_join(left, right, "dept_id", "id", "left").select("emp_id", "dept_id", F.col("name").alias("dept_name"))


def p2_join_full(spark: SparkSession, folder: str) -> DataFrame:
    """The same with departments that no employee is in."""
    left, right = table(spark, folder, "employees").select("emp_id", "dept_id"), table(spark, folder, "departments").select("id", "name")
    return skew_join(left, right, "dept_id", "id", "full").select("emp_id", "dept_id", F.col("id").alias("dept"), F.col("name").alias("dept_name"))


# --- problem 3

#: Tenths of a degree Celsius that air on earth can have.
AIR = (-900, 600)


def p3_reasons(spark: SparkSession, folder: str) -> DataFrame:
    """Implausible readings with the reason; a reading may have two."""
    return implausible(table(spark, folder, "weather"), "station", "time", "temp", *AIR)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Implausible readings by station and time."""
    return p3_reasons(spark, folder).select("station", "time").distinct()


def p3_range(spark: SparkSession, folder: str) -> DataFrame:
    """Readings that cannot be an air temperature."""
    return p3_reasons(spark, folder).where("reason = 'range'").drop("reason")


def p3_frozen(spark: SparkSession, folder: str) -> DataFrame:
    """Readings of frozen runs."""
    return p3_reasons(spark, folder).where("reason = 'frozen'").drop("reason")


# --- problem 5


def p5_rolling(spark: SparkSession, folder: str) -> DataFrame:
    """Totals, averages and tick counts over the last 7 and 30 days, for each symbol and calendar day.

    A tick has no id, so a redelivered tick can't be told from a second tick at the same price; every row counts.
    """
    ticks = table(spark, folder, "ticks").select("symbol", calendar_day(F.col("date")).alias("day"), "price")
    out = rolling_totals(ticks, "symbol", "day", "price", (7, 30))
    sums = {w: F.round(F.col(f"sum_{w}"), 4) for w in (1, 7, 30)}
    return out.select("symbol", day_number(F.col("day")).alias("date"), "n_1", "n_7", sums[7].alias("sum_7"), F.when(F.col("n_7") > 0, sums[7] / F.col("n_7")).alias("avg_7"), "n_30", sums[30].alias("sum_30"), F.when(F.col("n_30") > 0, sums[30] / F.col("n_30")).alias("avg_30"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Days without a priced tick between a symbol's first and last one."""
    ticks = table(spark, folder, "ticks").select("symbol", calendar_day(F.col("date")).alias("day"), "price")
    return rolling_totals(ticks, "symbol", "day", "price", (7, 30)).where("n_1 = 0").select("symbol", day_number(F.col("day")).alias("date"))


# --- problem 6


def hourly(spark: SparkSession, folder: str) -> DataFrame:
    return regrid(table(spark, folder, "weather"), "station", "time", "temp", step=3600, hold=3 * 3600, low=AIR[0], high=AIR[1])


def p6_grid(spark: SparkSession, folder: str) -> DataFrame:
    """One temperature per station and full hour: time-weighted mean, covered fraction, readings and state."""
    return hourly(spark, folder).select("station", "slot", F.col("value").alias("temp"), "coverage", "n_readings", "state")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Hours without a usable reading."""
    return hourly(spark, folder).where("n_readings = 0").select("station", "slot")


QUERIES = {f.__name__: f for f in (p2_found, p2_headcounts, p2_join, p2_join_full, p3_found, p3_reasons, p3_range, p3_frozen, p5_found, p5_rolling, p6_found, p6_grid)}

_PRICED = """priced as (
    select symbol, d as day, count(*) as n, sum(price) as total from (
        select symbol, price, try_cast(substr(lpad(cast(date as varchar), 8, '0'), 1, 4) || '-' || substr(lpad(cast(date as varchar), 8, '0'), 5, 2) || '-' || substr(lpad(cast(date as varchar), 8, '0'), 7, 2) as date) as d
        from ticks where symbol is not null and price is not null and date between 10101 and 99991231)
    where d is not null group by 1, 2),
days as (
    select symbol, unnest(generate_series(lo, hi, interval 1 day))::date as day
    from (select symbol, min(day) as lo, max(day) as hi from priced group by 1)),
full_days as (
    select d.symbol, d.day, coalesce(p.n, 0) as n, coalesce(p.total, 0) as total
    from days d left join priced p on d.symbol = p.symbol and d.day = p.day)"""

_NUMBER = "cast(year(day) * 10000 + month(day) * 100 + day(day) as integer)"

SQL = {
    "p2_found": "select dept_id from employees where dept_id is not null group by dept_id having count(*) * 20 >= (select count(*) from employees)",
    "p2_headcounts": """select e.dept_id, d.name, e.heads, e.n_rows from
        (select dept_id, count(distinct emp_id) as heads, count(*) as n_rows from employees group by dept_id) e left join departments d on e.dept_id = d.id""",
    "p2_join": "select e.emp_id, e.dept_id, d.name as dept_name from employees e left join departments d on e.dept_id = d.id",
    "p2_join_full": "select e.emp_id, e.dept_id, d.id as dept, d.name as dept_name from employees e full join departments d on e.dept_id = d.id",
    "p3_range": f"select distinct station, time, temp from weather where station is not null and time is not null and temp not between {AIR[0]} and {AIR[1]}",
    "p3_frozen": f"""with r as (select distinct station, time, temp from weather where station is not null and time is not null and temp between {AIR[0]} and {AIR[1]}),
        o as (select *, row_number() over (partition by station order by time, temp) - row_number() over (partition by station, temp order by time) as island from r),
        runs as (select station, temp, island, count(*) as n from o group by 1, 2, 3), counts as (select station, sum(n) as readings, count(*) as begun from runs group by 1), long as (select * from runs where n >= 8),
        off1 as (select station, sum(n) as off_n, count(*) as off_runs from long group by 1),
        rest1 as (select c.station, readings, begun, readings - off_n as r, greatest(begun - off_runs, 1) as b from counts c join off1 using (station)),
        first as (select *, greatest(8, ceil(ln(greatest(r, 2) / 0.001) / -ln(least(greatest(1 - b / greatest(r, 1), 0.001), 0.999)))) as bound from rest1),
        off2 as (select station, sum(n) as off_n, count(*) as off_runs from long join first using (station) where n >= bound group by 1),
        rest2 as (select f.station, readings - coalesce(off_n, 0) as r, greatest(begun - coalesce(off_runs, 0), 1) as b from first f left join off2 using (station)),
        bounds as (select station, greatest(8, ceil(ln(greatest(r, 2) / 0.001) / -ln(least(greatest(1 - b / greatest(r, 1), 0.001), 0.999)))) as bound from rest2),
        frozen as (select station, temp, island from long join bounds using (station) where n >= bound)
        select station, time, temp from o join frozen using (station, temp, island)""",
    "p5_found": f"with {_PRICED} select symbol, {_NUMBER} as date from full_days where n = 0",
    "p5_rolling": f"""with {_PRICED}, w as (
        select symbol, day, n, sum(n) over a as n_7, round(sum(total) over a, 4) as s_7, sum(n) over b as n_30, round(sum(total) over b, 4) as s_30 from full_days
        window a as (partition by symbol order by day rows 6 preceding), b as (partition by symbol order by day rows 29 preceding))
        select symbol, {_NUMBER} as date, cast(n as bigint) as n_1, cast(n_7 as bigint) as n_7, s_7 as sum_7, case when n_7 > 0 then s_7 / n_7 end as avg_7,
        cast(n_30 as bigint) as n_30, s_30 as sum_30, case when n_30 > 0 then s_30 / n_30 end as avg_30 from w""",
    "p6_found": """with u as (select distinct station, time // 3600 * 3600 as slot from weather where station is not null and time is not null and temp is not null),
        g as (select station, unnest(generate_series(min(slot), max(slot), 3600)) as slot from u group by station)
        select g.station, g.slot from g left join u on g.station = u.station and g.slot = u.slot where u.slot is null""",
    "p6_grid": f"""with u as (select station, time, temp, lead(time) over (partition by station order by time, temp) as nxt from weather where station is not null and time is not null and temp is not null),
        i as (select station, time as a, temp, case when temp between {AIR[0]} and {AIR[1]} then least(coalesce(nxt, (time // 3600 + 1) * 3600), time + 10800) else time end as b from u),
        c as (select station, a, b, temp, unnest(generate_series(a // 3600, (b - 1) // 3600)) as h from i where b > a),
        w as (select station, h, sum(least(b, (h + 1) * 3600) - greatest(a, h * 3600)) as s, sum((least(b, (h + 1) * 3600) - greatest(a, h * 3600)) * temp) as t from c group by 1, 2),
        n as (select station, time // 3600 as h, count(*) as n from u group by 1, 2),
        g as (select station, unnest(generate_series(min(h), max(h))) as h from n group by station)
        select g.station, g.h * 3600 as slot, cast(w.t as double) / w.s as temp, cast(coalesce(w.s, 0) as double) / 3600 as coverage, coalesce(n.n, 0) as n_readings,
        case when n.n > 0 then 'read' when w.s > 0 then 'held' else 'missing' end as state
        from g left join w on g.station = w.station and g.h = w.h left join n on g.station = n.station and g.h = n.h""",
}
