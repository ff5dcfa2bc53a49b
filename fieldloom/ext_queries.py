"""Queries beyond the field rules, over the driver's tables. All are named ext_*; none stands for the survey's §2.2."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from .operators.frames import frame_figures, islands
from .operators.json_fields import json_fields
from .operators.multisets import repeated, row_changes
from .operators.ranking import top_rows
from .operators.sketches import distinct_error, estimates, merged, sketched, store
from .operators.timelines import asof_join, interval_join
from .operators.validate import rule_totals, with_violations
from .plans import column_of, compile_form
from .queries import BROKEN, CUSTOMER_FORM
from .sources import read_table
from .sources.scratch import scratch
from .streaming.runs import broken_runs
from .streaming.windows import append_all, event_windows


def _order_times(orders: DataFrame) -> DataFrame:
    """Orders with a time in the month of `events` and the user they belong to, made of their keys."""
    return orders.select("o_orderkey", F.expr("o_custkey div 10").alias("buyer"), F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, (o_orderkey * 7919) % 2592000)").alias("placed"), "o_orderpriority")


def ext_events_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order with the last event of its user at or before it."""
    orders = _order_times(read_table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_orderpriority"]))
    events = read_table(spark, sf_dir, "events", ["event_id", "ts", "user_id", "event_type"])
    return asof_join(orders, events, ("placed", "ts"), {"last_event": "event_id", "last_type": "event_type"}, by=[("buyer", "user_id")], ties=["event_id"])


def ext_events_asof_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each error with the last purchase of anyone strictly before it, at most an hour back: one line without a key."""
    events = read_table(spark, sf_dir, "events", ["event_id", "ts", "event_type"])
    errors, bought = events.where("event_type = 'error'").drop("event_type"), events.where("event_type = 'purchase'")
    return asof_join(errors, bought, ("ts", "ts"), {"purchase": "event_id", "purchased": "ts"}, ties=["event_id"], strict=True, within=3600e6, limit=1000)


def ext_events_in_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of an order's user in the time after the order: an hour, or a hundred times as long for urgent ones."""
    orders = _order_times(read_table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_orderpriority"]))
    hours = F.when(F.col("o_orderpriority").startswith("1"), 100).otherwise(1)
    spans = orders.select("o_orderkey", "buyer", "placed", (F.col("placed") + F.make_dt_interval(hours=hours)).alias("until"))
    events = read_table(spark, sf_dir, "events", ["event_id", "ts", "user_id", "value"])
    pairs = interval_join(events, spans, "ts", ("placed", "until"), by=[("user_id", "buyer")])
    return pairs.groupBy("o_orderkey").agg(F.count("*").alias("events"), F.min("event_id").alias("first_event"), F.max("value").alias("top_value"))


def _event_stream(spark: SparkSession, sf_dir: str, columns: list[str]) -> DataFrame:
    schema = read_table(spark, sf_dir, "events").schema  # below, a pattern: a stream takes no path of a single file
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet").select(*columns).withColumn("at", F.col("ts").cast("timestamp"))


def _closed(spark: SparkSession, result: DataFrame, name: str) -> DataFrame:
    """What a stream hands on when all there is has been taken; times without zone again."""
    folder = scratch(spark, name)
    append_all(result, f"{folder}/rows", f"{folder}/state")
    out = spark.read.schema(result.schema).parquet(f"{folder}/rows")
    return out.select(*(F.col(c).cast("timestamp_ntz").alias(c) if t == "timestamp" else F.col(c) for c, t in out.dtypes))


def ext_event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures of each event type by tumbling and sliding windows, of each user by sessions; closed windows, as a
    stream with an hour for late rows hands them on."""
    figures = [F.count("*").alias("events"), F.max("value").alias("top"), F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("cents")]
    kinds = {"tumbling": ("event_type", {"size": "6 hours"}), "sliding": ("event_type", {"size": "12 hours", "slide": "3 hours"}), "session": ("user_id", {"gap": "5 hours"})}
    found = []
    for kind, (key, window) in kinds.items():
        stream = _event_stream(spark, sf_dir, ["ts", key, "value"]).withColumn("key", F.col(key).cast("string"))
        found.append(_closed(spark, event_windows(stream, "at", figures, "1 hour", keys=["key"], **window), f"windows-{kind}").withColumn("kind", F.lit(kind)))
    return reduce(DataFrame.unionByName, found)


#: The rule whose runs are looked for: a value within bounds.
RUN_RULE = ("value", "range", ("1", "40"))


def ext_rule_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of consecutive events of a user whose value breaks the rule, at most a day apart."""
    stream = _event_stream(spark, sf_dir, ["ts", "event_id", "user_id", "value"])
    broken = ~column_of(*RUN_RULE, True)
    return _closed(spark, broken_runs(stream, "user_id", "at", "event_id", broken, 86400, "1 hour"), "runs")


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored table of each day's and type's users, values and property strings, as sketches."""
    events = read_table(spark, sf_dir, "events", ["ts", "event_type", "user_id", "value", "props"]).withColumn("day", F.to_date("ts"))
    daily = sketched(events, ["event_type", "day"], {"users": "user_id", "properties": "props"}, {"amount": "value"})
    return store(daily, scratch(spark, "sketches"), "day")


def ext_weekly_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimates for each type and week, each week and all time, out of the days' sketches alone."""
    daily = _daily(spark, sf_dir).withColumn("week", F.to_date(F.date_trunc("week", "day")))
    sketches = ["users", "properties"], ["amount"]
    weekly = merged(daily, ["event_type", "week"], *sketches)
    every = merged(weekly, ["week"], *sketches).withColumn("event_type", F.lit(None).cast("string"))
    whole = merged(weekly, [], *sketches).withColumn("event_type", F.lit(None).cast("string")).withColumn("week", F.lit(None).cast("date"))
    found = weekly.unionByName(every).unionByName(whole)
    return estimates(found, sketches[0], {"amount": {"median": 0.5, "high": 0.95}})


def ext_sketch_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each type's exact figures, and whether the merged sketches are within three standard errors of them."""
    events = read_table(spark, sf_dir, "events", ["event_type", "user_id", "value", "props"])
    exact = events.groupBy("event_type").agg(F.count("*").alias("rows"), F.countDistinct("user_id").alias("exact_users"), F.countDistinct("props").alias("exact_properties"))
    found = estimates(merged(_daily(spark, sf_dir), ["event_type"], ["users", "properties"], ["amount"]), ["users", "properties"], {"amount": {"median": 0.5}})
    ranks = events.join(found.select("event_type", "median"), "event_type").groupBy("event_type").agg((F.count_if(F.col("value") <= F.col("median")) / F.count("value")).alias("rank"))
    near = lambda name: F.abs(F.col(name) - F.col(f"exact_{name}")) <= distinct_error() * F.col(f"exact_{name}")
    both = exact.join(found, "event_type").join(ranks, "event_type")
    return both.select("event_type", "rows", "exact_users", "exact_properties", (F.col("n") == F.col("rows")).alias("all_rows"), near("users").alias("users_near"), near("properties").alias("properties_near"), F.col("rank").between(0.48, 0.52).alias("median_near"))


def ext_rule_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What customers break, by segment and nation, by either and over all; those in debt are in no segment."""
    customers = read_table(spark, sf_dir, "customer", ["c_name", "c_mktsegment", "c_nationkey", "c_acctbal"])
    df = customers.withColumn("segment", F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment"))).withColumnRenamed("c_nationkey", "nation")
    return rule_totals(df, compile_form(CUSTOMER_FORM), ["segment", "nation"], [["segment", "nation"], ["segment"], ["nation"], []])


_HOUR = 3_600_000_000


def _cents():
    return F.round(F.col("value") * 100).cast("bigint")


def ext_user_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event with the number, sum and top value of its user's events in the day up to it."""
    events = read_table(spark, sf_dir, "events", ["event_id", "user_id", "ts", "value"])
    figures = {"events": F.count("*"), "cents": F.sum(_cents()), "top": F.max("value")}
    return frame_figures(events, "ts", 24 * _HOUR, figures, ["user_id"]).drop("value")


def ext_type_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event with the users of its type in the six hours up to it: few large keys, frames of many rows."""
    events = read_table(spark, sf_dir, "events", ["event_id", "event_type", "user_id", "ts"])
    figures = {"events": ("count", None), "first_event": ("min", "event_id"), "users": ("distinct", "user_id")}
    return frame_figures(events, "ts", 6 * _HOUR, figures, ["event_type"]).drop("user_id")


def ext_error_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of a user that follow each other within twelve hours."""
    events = read_table(spark, sf_dir, "events", ["user_id", "ts", "value", "event_type"]).where("event_type = 'error'")
    return islands(events.withColumn("cents", _cents()), "ts", 12 * _HOUR, {"cents": ("sum", "cents"), "top": ("max", "value")}, ["user_id"])


def ext_busy_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches in which some event comes every two minutes: one line without a key, cut by time."""
    return islands(read_table(spark, sf_dir, "events", ["ts", "event_id"]), "ts", _HOUR // 30, {"first_event": ("min", "event_id")}, limit=100)


def ext_latest_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders of the five latest places of each priority and status, with all that tie by day."""
    orders = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_orderpriority", "o_orderstatus", "o_orderdate"])
    return top_rows(orders, ["o_orderpriority", "o_orderstatus"], [F.desc("o_orderdate")], 5)


#: CUSTOMER_FORM with another range and without the rule of the segment's pattern.
LATER_FORM = [CUSTOMER_FORM[0], {k: v for k, v in CUSTOMER_FORM[1].items() if "regex" not in k}, CUSTOMER_FORM[2] | {"data-val-range-max": "8000"}]


def _rule_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = read_table(spark, sf_dir, "customer", ["c_name", "c_mktsegment", "c_acctbal"])
    runs = [with_violations(customers, compile_form(form)).select(F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment")).alias("segment"), F.explode("violations").alias("v")).select("segment", "v.field", "v.rule") for form in (CUSTOMER_FORM, LATER_FORM)]
    return row_changes(*runs)


def ext_rule_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many broken rules of each segment a later form keeps, loses and gains."""
    return _rule_runs(spark, sf_dir)


def ext_rules_lost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The broken rules that the later form loses, a row each."""
    return repeated(_rule_runs(spark, sf_dir), "lost")


def ext_event_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number in each event's properties, of which some are cut off, lack it or hold a word in its place."""
    events = read_table(spark, sf_dir, "events", ["event_id", "props"])
    kind = F.col("event_id") % 5
    text = F.when(kind == 0, F.expr("substring(props, 1, length(props) - 1)")).when(kind == 1, F.replace("props", F.lit('"k"'), F.lit('"j"')))
    text = text.when(kind == 2, F.regexp_replace("props", r"(\d+)", '"n$1"')).when(kind == 3, F.regexp_replace("props", r"(\d+)", '{"z": [$1]}')).otherwise(F.col("props"))
    return json_fields(events.select("event_id", text.alias("text")), "text", {"k": ("$.k", "bigint"), "z": ("$.k.z[0]", "bigint")})


QUERIES = {f.__name__: f for f in (ext_events_asof, ext_events_asof_global, ext_events_in_windows, ext_event_windows, ext_rule_runs, ext_weekly_sketches, ext_sketch_bounds, ext_rule_totals, ext_user_frames, ext_type_frames, ext_error_islands, ext_busy_islands, ext_latest_orders, ext_rule_changes, ext_rules_lost, ext_event_properties)}

_RUNS = f"""b AS (SELECT CASE WHEN c_acctbal >= 0 THEN c_mktsegment END AS segment, field, rule, c_custkey, c_acctbal FROM ({BROKEN}) JOIN customer USING (c_custkey)),
        before AS (SELECT segment, field, rule FROM b),
        later AS (SELECT segment, field, rule FROM b WHERE NOT (field = 'c_mktsegment' AND rule = 'regex') AND (rule <> 'range' OR c_acctbal NOT BETWEEN 0 AND 8000))"""

_ORDERS = "SELECT o_orderkey, o_custkey // 10 AS buyer, TIMESTAMP '2024-01-01' + to_seconds((o_orderkey * 7919) % 2592000) AS placed, o_orderpriority FROM orders"

ORACLE_SQL = {
    "ext_rule_totals": f"""WITH b AS ({BROKEN}), r(field, rule) AS (VALUES ('c_name', 'nonalphamin'), ('c_name', 'regex'), ('c_name', 'required'), ('c_mktsegment', 'regex'), ('c_mktsegment', 'rangelength'), ('c_acctbal', 'range')),
        c AS (SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN c_mktsegment END AS segment, c_nationkey AS nation FROM customer)
        SELECT segment, nation, GROUPING(segment, nation) AS grouping_id, r.field, r.rule, count(*) AS checked, count(b.c_custkey) AS broken
        FROM c CROSS JOIN r LEFT JOIN b ON b.c_custkey = c.c_custkey AND b.field = r.field AND b.rule = r.rule
        GROUP BY GROUPING SETS ((r.field, r.rule, segment, nation), (r.field, r.rule, segment), (r.field, r.rule, nation), (r.field, r.rule))""",
    "ext_sketch_bounds": """SELECT event_type, count(*) AS rows, count(DISTINCT user_id) AS exact_users, count(DISTINCT props) AS exact_properties,
        true AS all_rows, true AS users_near, true AS properties_near, true AS median_near FROM events WHERE event_type IS NOT NULL GROUP BY event_type""",
    "ext_events_asof": f"""WITH o AS ({_ORDERS}), e AS (SELECT user_id, ts, max(event_id) AS event_id, max_by(event_type, event_id) AS event_type FROM events GROUP BY ALL)
        SELECT o.*, e.event_id AS last_event, e.event_type AS last_type FROM o ASOF LEFT JOIN e ON o.buyer = e.user_id AND o.placed >= e.ts""",
    "ext_events_asof_global": """WITH b AS (SELECT ts, max(event_id) AS event_id FROM events WHERE event_type = 'purchase' GROUP BY ts),
        j AS (SELECT a.event_id, a.ts, b.event_id AS purchase, b.ts AS purchased FROM (SELECT * FROM events WHERE event_type = 'error') a ASOF LEFT JOIN b ON a.ts > b.ts)
        SELECT event_id, ts, CASE WHEN ts - purchased <= INTERVAL 1 HOUR THEN purchase END AS purchase, CASE WHEN ts - purchased <= INTERVAL 1 HOUR THEN purchased END AS purchased FROM j""",
    "ext_events_in_windows": f"""WITH o AS ({_ORDERS}) SELECT o_orderkey, count(*) AS events, min(event_id) AS first_event, max(value) AS top_value
        FROM o JOIN events e ON e.user_id = o.buyer AND e.ts >= o.placed AND e.ts < o.placed + CASE WHEN starts_with(o_orderpriority, '1') THEN INTERVAL 100 HOUR ELSE INTERVAL 1 HOUR END GROUP BY o_orderkey""",
    "ext_event_windows": """WITH e AS (SELECT *, cast(round(value * 100) AS BIGINT) AS c FROM events), passed AS (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 1 HOUR AS p FROM events),
        tumbling AS (SELECT 'tumbling' AS kind, event_type AS key, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS s, value, c FROM e),
        sliding AS (SELECT 'sliding' AS kind, event_type AS key, time_bucket(INTERVAL 3 HOUR, ts, TIMESTAMP '1970-01-01') - to_hours(cast(3 * i AS INTEGER)) AS s, value, c FROM e, range(4) r(i)),
        starts AS (SELECT user_id, ts, value, c, CASE WHEN ts - lag(ts) OVER w < INTERVAL 5 HOUR THEN 0 ELSE 1 END AS fresh FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
        sessions AS (SELECT user_id, ts, value, c, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS no FROM starts),
        found AS (SELECT kind, key, s AS window_start, s + CASE kind WHEN 'tumbling' THEN INTERVAL 6 HOUR ELSE INTERVAL 12 HOUR END AS window_end, count(*) AS events, max(value) AS top, cast(sum(c) AS BIGINT) AS cents FROM (FROM tumbling UNION ALL FROM sliding) GROUP BY kind, key, s
          UNION ALL SELECT 'session', cast(user_id AS VARCHAR), min(ts), max(ts) + INTERVAL 5 HOUR, count(*), max(value), cast(sum(c) AS BIGINT) FROM sessions GROUP BY user_id, no)
        SELECT found.* FROM found, passed WHERE window_end <= p""",
    "ext_rule_runs": """WITH passed AS (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 1 HOUR AS p FROM events),
        e AS (SELECT user_id, ts, event_id, value NOT BETWEEN 1 AND 40 AS bad, p FROM events, passed WHERE date_trunc('milliseconds', ts) < p),
        b AS (SELECT *, row_number() OVER w AS place, max(ts) OVER (PARTITION BY user_id) AS newest, lag(bad) OVER w AND ts - lag(ts) OVER w <= INTERVAL 1 DAY AS goes_on FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
        r AS (SELECT *, sum(CASE WHEN goes_on THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY place) AS no FROM b WHERE bad)
        SELECT user_id, min(ts) AS run_start, max(ts) AS run_end, count(*) AS n FROM r GROUP BY user_id, no
        HAVING max(ts) < any_value(newest) OR date_trunc('milliseconds', max(ts) + INTERVAL 1 DAY) < any_value(p)""",
    "ext_user_frames": """SELECT event_id, user_id, ts, count(*) OVER w AS events, cast(sum(cast(round(value * 100) AS BIGINT)) OVER w AS BIGINT) AS cents, max(value) OVER w AS top
        FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW)""",
    "ext_type_frames": """SELECT event_id, event_type, ts, count(*) OVER w AS events, min(event_id) OVER w AS first_event, count(DISTINCT user_id) OVER w AS users
        FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 6 HOUR PRECEDING AND CURRENT ROW)""",
    "ext_error_islands": """WITH e AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 12 HOUR THEN 0 ELSE 1 END AS fresh FROM events WHERE event_type = 'error' WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
        r AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS no FROM e)
        SELECT user_id, min(ts) AS start, max(ts) AS "end", count(*) AS n, cast(sum(cast(round(value * 100) AS BIGINT)) AS BIGINT) AS cents, max(value) AS top FROM r GROUP BY user_id, no""",
    "ext_busy_islands": """WITH e AS (SELECT ts, event_id, CASE WHEN ts - lag(ts) OVER (ORDER BY ts) <= INTERVAL 2 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
        r AS (SELECT *, sum(fresh) OVER (ORDER BY ts) AS no FROM e)
        SELECT min(ts) AS start, max(ts) AS "end", count(*) AS n, min(event_id) AS first_event FROM r GROUP BY no""",
    "ext_latest_orders": """SELECT o_orderkey, o_orderpriority, o_orderstatus, o_orderdate, rank() OVER (PARTITION BY o_orderpriority, o_orderstatus ORDER BY o_orderdate DESC NULLS LAST) AS rank
        FROM orders QUALIFY rank <= 5""",
    "ext_rule_changes": f"""WITH {_RUNS}, s AS (SELECT *, 1 AS kept, 0 AS lost, 0 AS gained FROM (FROM before INTERSECT ALL FROM later)
        UNION ALL SELECT *, 0, 1, 0 FROM (FROM before EXCEPT ALL FROM later) UNION ALL SELECT *, 0, 0, 1 FROM (FROM later EXCEPT ALL FROM before))
        SELECT segment, field, rule, cast(sum(kept) AS BIGINT) AS kept, cast(sum(lost) AS BIGINT) AS lost, cast(sum(gained) AS BIGINT) AS gained FROM s GROUP BY ALL""",
    "ext_rules_lost": f"WITH {_RUNS} FROM before EXCEPT ALL FROM later",
    "ext_event_properties": r"""WITH t AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN left(props, length(props) - 1) WHEN 1 THEN replace(props, '"k"', '"j"')
          WHEN 2 THEN regexp_replace(props, '(\d+)', '"n\1"', 'g') WHEN 3 THEN regexp_replace(props, '(\d+)', '{"z": [\1]}', 'g') ELSE props END AS text FROM events),
        j AS (SELECT event_id, text, CASE WHEN json_valid(text) THEN text END AS doc FROM t)
        SELECT event_id, text, try_cast(json_extract_string(doc, '$.k') AS BIGINT) AS k, try_cast(json_extract_string(doc, '$.k.z[0]') AS BIGINT) AS z,
          CASE WHEN doc IS NULL AND text IS NOT NULL THEN 'malformed' WHEN json_extract(doc, '$.k') IS NOT NULL AND try_cast(json_extract_string(doc, '$.k') AS BIGINT) IS NULL THEN 'mistyped' END AS fault FROM j""",
}
