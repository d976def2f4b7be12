"""The registered queries of the engine, and their SQL."""

from __future__ import annotations

import datetime as dt
import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .builder import collection
from .functions import geo
from .operators import ann, fanout
from .operators.read import Answer, Policy, Reader
from .plans.parser import parse_one
from .sources.catalog import Catalog

IDS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "events": "event_id", "documents": "doc_id", "embeddings": "vec_id", "lineitem": "l_row"}
NOW = dt.datetime(2024, 1, 20)


def catalog(spark: SparkSession, sf_dir: str, *names: str) -> Catalog:
    """The tables of a folder as collections; lineitem, which has no key of its own, is given a hash of its row."""
    out = Catalog(spark)
    declared = {"events": {"json": {"props"}, "ttl": None}, "embeddings": {"metric": {"embedding": "cosine"}}}
    for name in names:
        df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        if name == "lineitem":
            df = df.withColumn("l_row", F.xxhash64(*df.columns))
        out.register(name, df, IDS[name], **{k: v for k, v in declared.get(name, {}).items() if v is not None})
    return out


def ask(spark: SparkSession, sf_dir: str, text: str, *params, names: tuple[str, ...] = (), now: dt.datetime = NOW, policy: Policy | None = None, **changed: Callable[[DataFrame], DataFrame]) -> Answer:
    """changed: name -> what becomes of a table before it is asked."""
    c = catalog(spark, sf_dir, *names)
    for name, f in changed.items():
        old = c.get(name)
        c.register(name, f(old.df), old.id, json=old.json, geo=old.geo, metric=old.metric)
    return Reader(c, params, now, policy).select(parse_one(text))


def rounded(df: DataFrame, places: int = 4) -> DataFrame:
    return df.select(*(F.round(c, places).alias(c) if t in ("double", "float") else F.col(f"`{c}`") for c, t in df.dtypes))


def _text(text: str, *names: str, params: tuple = (), flat: bool = False, round_to: int | None = 4, **changed) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        a = ask(spark, sf_dir, text, *params, names=names, **changed)
        df = a.flatten() if flat else a.df
        return df if round_to is None else rounded(df, round_to)

    return run


Q: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def add(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    Q[name] = run, sql


# reading
HOURLY = 'get events select bucket(ts, 1h) as hour, event_type, count(*) as n, count(distinct user_id) as users where ts >= "2024-01-05" group hour, event_type order n desc limit 20'
add("hourly_by_type", _text(HOURLY, "events"), "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events WHERE ts >= TIMESTAMP '2024-01-05' GROUP BY 1, 2 ORDER BY n DESC, hour, event_type LIMIT 20")
add("scan_all", _text("get region", "region"), "SELECT r_regionkey AS id, r_regionkey, r_name FROM region")
add("id_probe", _text("get orders select o_orderkey, o_totalprice where id in [1, 7, 32, 100, 1000]", "orders"), "SELECT o_orderkey, round(o_totalprice, 4) AS o_totalprice FROM orders WHERE o_orderkey IN (1, 7, 32, 100, 1000)")
add("range_scan", _text("get orders select o_orderkey, o_orderdate where o_totalprice between 1000 and 20000.5", "orders"), "SELECT o_orderkey, o_orderdate FROM orders WHERE o_totalprice BETWEEN 1000 AND 20000.5")
NULLIF = {"orders": lambda df: df.withColumn("o_orderpriority", F.expr("nullif(o_orderpriority, '1-URGENT')")).withColumn("o_totalprice", F.expr("CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice END"))}
WITH_NULLS = "(SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice, o_orderdate, nullif(o_orderpriority, '1-URGENT') AS o_orderpriority FROM orders)"
add("filter_nullsafe", _text('get orders select id where o_orderpriority != "2-HIGH" and not (o_totalprice < 5000) or o_orderpriority = null', "orders", **NULLIF), f"SELECT o_orderkey AS id FROM {WITH_NULLS} WHERE (o_orderpriority IS DISTINCT FROM '2-HIGH' AND NOT coalesce(o_totalprice < 5000, false)) OR o_orderpriority IS NULL")
add("filter_in", _text('get orders select id where o_orderpriority in ["2-HIGH", null] and o_totalprice > 100', "orders", **NULLIF), f"SELECT o_orderkey AS id FROM {WITH_NULLS} WHERE (o_orderpriority = '2-HIGH' OR o_orderpriority IS NULL) AND o_totalprice > 100")
add("filter_between", _text("get orders select id where o_totalprice not between 1000 and 250000", "orders", **NULLIF), f"SELECT o_orderkey AS id FROM {WITH_NULLS} WHERE NOT coalesce(o_totalprice >= 1000 AND o_totalprice <= 250000, false)")
add("filter_like", _text("get part select id, p_name where p_name like '%e_%' and not p_type like 'S%'", "part"), "SELECT p_partkey AS id, p_name FROM part WHERE p_name LIKE '%e_%' AND NOT p_type LIKE 'S%'")
add("filter_like_escape", _text("get part select id where p_brand like '%!#_%' escape '!' or p_brand like 'Brand#1%'", "part"), "SELECT p_partkey AS id FROM part WHERE p_brand LIKE '%!#_%' ESCAPE '!' OR p_brand LIKE 'Brand#1%'")
add("filter_ilike", _text("get part select id where p_type ilike '%STEEL%'", "part"), "SELECT p_partkey AS id FROM part WHERE p_type ILIKE '%STEEL%'")
add("filter_contains", _text('get documents select id where text ~ "THE" and lang != "fr"', "documents"), "SELECT doc_id AS id FROM documents WHERE contains(lower(text), 'the') AND lang <> 'fr'")
add("filter_or_not", _text('get orders select id where not (o_orderstatus = "F" or o_totalprice >= 100000) and o_orderpriority is not null', "orders", **NULLIF), f"SELECT o_orderkey AS id FROM {WITH_NULLS} WHERE NOT (o_orderstatus = 'F' OR coalesce(o_totalprice >= 100000, false)) AND o_orderpriority IS NOT NULL")
add("filter_distinct_from", _text('get orders select id where o_orderpriority is distinct from "2-HIGH" and (o_totalprice > 5) is not true', "orders", **NULLIF), f"SELECT o_orderkey AS id FROM {WITH_NULLS} WHERE o_orderpriority IS DISTINCT FROM '2-HIGH' AND (o_totalprice > 5) IS NOT TRUE")
add("filter_has", _text('get documents select id where tags has "en"', "documents", documents=lambda df: df.withColumn("tags", F.array("lang", "source"))), "SELECT doc_id AS id FROM documents WHERE lang = 'en' OR source = 'en'")
add("filter_params", _text("get orders select id where o_totalprice > $1 and o_orderstatus = $2 order o_totalprice desc limit $3", "orders", params=(50000.0, "O", 25)), "SELECT o_orderkey AS id FROM orders WHERE o_totalprice > 50000 AND o_orderstatus = 'O' ORDER BY o_totalprice DESC, 1 LIMIT 25")
add("computed_column", _text("get orders select id, o_custkey * 2 + 1 as twice, o_orderkey / 7 as seventh, -o_custkey / 3 as neg, o_orderpriority + '!' as loud", "orders"), "SELECT o_orderkey AS id, o_custkey * 2 + 1 AS twice, o_orderkey // 7 AS seventh, CAST(trunc(-o_custkey / 3) AS BIGINT) AS neg, o_orderpriority || '!' AS loud FROM orders")
add("case_when", _text("get orders select id, case when o_totalprice > 200000 then 'big' when o_totalprice > 50000 then 'mid' else 'small' end as size", "orders"), "SELECT o_orderkey AS id, CASE WHEN o_totalprice > 200000 THEN 'big' WHEN o_totalprice > 50000 THEN 'mid' ELSE 'small' END AS size FROM orders")
add("greatest_least", _text("get orders select id, greatest(o_custkey, 700) as g, least(o_totalprice, 1000.5) as l, coalesce(o_orderpriority, 'none') as p", "orders", **NULLIF), f"SELECT o_orderkey AS id, greatest(o_custkey, 700) AS g, round(least(o_totalprice, 1000.5), 4) AS l, coalesce(o_orderpriority, 'none') AS p FROM {WITH_NULLS}")
add("string_functions", _text("get documents select id, lower(lang) as a, upper(source) as b, len(text) as c", "documents"), "SELECT doc_id AS id, lower(lang) AS a, upper(source) AS b, length(text) AS c FROM documents")
add("json_path_sum", _text("get events select event_type, sum(props.k) as total, count(props.none) as missing group event_type", "events"), "SELECT event_type, round(sum(CAST(json_extract(props, '$.k') AS DOUBLE)), 4) AS total, 0 AS missing FROM events GROUP BY 1")
add("json_path_filter", _text("get events select id where props.k >= 50 and props.none is null", "events"), "SELECT event_id AS id FROM events WHERE CAST(json_extract(props, '$.k') AS DOUBLE) >= 50")
add("time_arithmetic", _text('get events select id, ts + 60000 as later, ts - timestamp("2024-01-01T00:00:00") as ms where ts < "2024-01-03"', "events"), "SELECT event_id AS id, date_trunc('millisecond', ts) + INTERVAL 1 MINUTE AS later, epoch_us(ts) // 1000 - epoch_ms(TIMESTAMP '2024-01-01') AS ms FROM events WHERE ts < TIMESTAMP '2024-01-03'")
add("order_limit_offset", _text("get orders select id, o_totalprice order o_orderpriority desc, o_totalprice limit 30 offset 12", "orders"), "SELECT o_orderkey AS id, round(o_totalprice, 4) AS o_totalprice FROM orders ORDER BY o_orderpriority DESC, orders.o_totalprice, o_orderkey LIMIT 30 OFFSET 12")
add("order_nulls", _text("get orders select id order o_orderpriority, o_totalprice desc limit 50", "orders", **NULLIF), f"SELECT o_orderkey AS id FROM {WITH_NULLS} ORDER BY o_orderpriority NULLS FIRST, o_totalprice DESC NULLS LAST, o_orderkey LIMIT 50")
add("order_expr", _text("get orders select id order case when o_orderstatus = 'O' then 0 else 1 end, o_custkey * -1 limit 40", "orders"), "SELECT o_orderkey AS id FROM orders ORDER BY CASE WHEN o_orderstatus = 'O' THEN 0 ELSE 1 END, o_custkey * -1, o_orderkey LIMIT 40")
add("order_ordinal", _text("select o_custkey, o_orderkey from orders order by 1 desc, 2 limit 20", "orders"), "SELECT o_custkey, o_orderkey FROM orders ORDER BY 1 DESC, 2 LIMIT 20")
add("distinct_rows", _text("select distinct o_orderstatus, o_orderpriority from orders", "orders"), "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
add("count_rows", _text('get orders where o_orderstatus = "F" count', "orders"), "SELECT count(*) AS count FROM orders WHERE o_orderstatus = 'F'")

# aggregates
LINES = "lineitem"
add("agg_global", _text("get lineitem select count(*) as n, sum(l_partkey) as parts, avg(l_quantity) as q, min(l_shipdate) as first, max(l_extendedprice) as top", LINES), "SELECT count(*) AS n, CAST(sum(l_partkey) AS BIGINT) AS parts, round(avg(l_quantity), 4) AS q, min(l_shipdate) AS first, round(max(l_extendedprice), 4) AS top FROM lineitem")
add("agg_group", _text("get lineitem select l_returnflag, l_linestatus, count(*) as n, sum(l_quantity) as qty, sum(l_extendedprice * (1 - l_discount)) as revenue group l_returnflag, l_linestatus", LINES, round_to=2), "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem GROUP BY 1, 2")
add("agg_having", _text("get orders select o_custkey, count(*) as n, sum(o_totalprice) as total group o_custkey having n >= 12 and sum(o_totalprice) > 1000 order total desc limit 25", "orders", round_to=2), "SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1 HAVING n >= 12 AND sum(o_totalprice) > 1000 ORDER BY sum(o_totalprice) DESC, o_custkey LIMIT 25")
add("agg_group_count", _text("get orders select o_custkey, count(*) as n group o_custkey having count(*) > 10 count", "orders"), "SELECT count(*) AS count FROM (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 10)")
add("agg_over_picked_page", _text("get orders select avg(o_totalprice) as a, count(*) as n order o_orderdate desc limit 50", "orders"), "SELECT round(avg(o_totalprice), 4) AS a, count(*) AS n FROM (SELECT * FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50)")
add("agg_filter_where", _text("get orders select o_orderstatus, count(*) filter (where o_totalprice > 100000) as big, sum(o_totalprice) filter (where o_orderpriority = '2-HIGH') as high group o_orderstatus", "orders", round_to=2), "SELECT o_orderstatus, count(*) FILTER (WHERE o_totalprice > 100000) AS big, round(sum(o_totalprice) FILTER (WHERE o_orderpriority = '2-HIGH'), 2) AS high FROM orders GROUP BY 1")
add("agg_expr_over_aggs", _text("get lineitem select l_suppkey, sum(l_extendedprice) / sum(l_quantity) as unit, max(l_quantity) - min(l_quantity) as spread group l_suppkey", LINES), "SELECT l_suppkey, round(sum(l_extendedprice) / sum(l_quantity), 4) AS unit, round(max(l_quantity) - min(l_quantity), 4) AS spread FROM lineitem GROUP BY 1")
add("agg_count_nonnull", _text("get orders select count(o_orderpriority) as p, count(o_totalprice) as t, count(distinct o_orderpriority) as d, count(*) as n", "orders", **NULLIF), f"SELECT count(o_orderpriority) AS p, count(o_totalprice) AS t, count(DISTINCT o_orderpriority) AS d, count(*) AS n FROM {WITH_NULLS}")
add("agg_group_expr", _text("get orders select o_custkey / 100 as block, count(*) as n group block", "orders"), "SELECT o_custkey // 100 AS block, count(*) AS n FROM orders GROUP BY 1")
add("first_last", _text("get events select event_type, first(user_id) as a, last(value) as b group event_type", "events"), "SELECT event_type, arg_min(user_id, event_id) AS a, round(arg_max(value, event_id), 4) AS b FROM events GROUP BY 1")
add("first_last_by", _text("get events select user_id, last(value by ts) as latest, first(event_type by ts) as start group user_id", "events"), "SELECT user_id, round(arg_max(value, ts), 4) AS latest, arg_min(event_type, ts) AS start FROM events GROUP BY 1")
add("ohlcv_bars", _text("get events select bucket(ts, 1d) as day, first(value by ts) as open, max(value) as high, min(value) as low, last(value by ts) as close, count(*) as volume group day", "events"), "SELECT date_trunc('day', ts) AS day, round(arg_min(value, ts), 4) AS open, round(max(value), 4) AS high, round(min(value), 4) AS low, round(arg_max(value, ts), 4) AS close, count(*) AS volume FROM events GROUP BY 1")
add("vwap", _text("get lineitem select l_partkey, sum(l_extendedprice * l_quantity) / sum(l_quantity) as vwap group l_partkey", LINES, round_to=2), "SELECT l_partkey, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 2) AS vwap FROM lineitem GROUP BY 1")
add("nocase_groups", lambda spark, d: _nocase(spark, d), "SELECT arg_min(k, o_orderkey) AS k, count(*) AS n FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN upper(o_orderpriority) ELSE lower(o_orderpriority) END AS k FROM orders) GROUP BY lower(k)")
add("approx_distinct", _text("get events select approx_count_distinct(user_id) as n", "events", round_to=None), None)
add("approx_distinct_close", lambda spark, d: ask(spark, d, "get events select event_type, approx_count_distinct(user_id) as a, count(distinct user_id) as b group event_type", names=("events",)).df.select("event_type", (F.abs(F.col("a") - F.col("b")) <= F.col("b") * 0.025).alias("close")), "SELECT DISTINCT event_type, true AS close FROM events")
add("sketch_rollup", lambda spark, d: _sketches(spark, d), "SELECT event_type, count(DISTINCT user_id) AS users, true AS close FROM events GROUP BY 1")

# time
for unit, sql in (("1m", "date_trunc('minute', ts)"), ("15m", "time_bucket(INTERVAL 15 MINUTE, ts, TIMESTAMP '1970-01-01')"), ("1h", "date_trunc('hour', ts)"), ("1d", "date_trunc('day', ts)"), ("1w", "date_trunc('week', ts)"), ("1mo", "date_trunc('month', ts)"), ("1y", "date_trunc('year', ts)")):
    add(f"bucket_{unit}", _text(f"get events select bucket(ts, {unit}) as b, count(*) as n group b", "events"), f"SELECT CAST({sql} AS TIMESTAMP) AS b, count(*) AS n FROM events GROUP BY 1")
add("bucket_int_ms", _text("get orders select bucket(o_orderkey, 500ms) as b, count(*) as n group b", "orders"), "SELECT o_orderkey // 500 * 500 AS b, count(*) AS n FROM orders GROUP BY 1")
add("bucket_zone_day", _text("get events select bucket(ts, 1d, 'Europe/Berlin') as b, count(*) as n group b", "events"), "SELECT date_trunc('day', ts + INTERVAL 1 HOUR) - INTERVAL 1 HOUR AS b, count(*) AS n FROM events GROUP BY 1")
add("bucket_zone_hour", _text("get events select bucket(ts, 6h, 'Asia/Kolkata') as b, count(*) as n group b", "events"), "SELECT time_bucket(INTERVAL 6 HOUR, ts + INTERVAL 330 MINUTE, TIMESTAMP '1970-01-01') - INTERVAL 330 MINUTE AS b, count(*) AS n FROM events GROUP BY 1")
SUMMER = {"events": lambda df: df.withColumn("ts", F.expr("ts + interval 80 days"))}
BERLIN = "timezone('Europe/Berlin', timezone('UTC', ts + INTERVAL 80 DAY))"
add("bucket_zone_dst", _text("get events select bucket(ts, 1d, 'Europe/Berlin') as b, count(*) as n group b", "events", **SUMMER), f"SELECT timezone('UTC', timezone('Europe/Berlin', date_trunc('day', {BERLIN}))) AS b, count(*) AS n FROM events GROUP BY 1")
add("count_distinct_hourly", _text("get events select bucket(ts, 1h) as h, count(distinct user_id) as users group h", "events"), "SELECT date_trunc('hour', ts) AS h, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
add("funnel_ordered", _text("get events select user_id, min(case when event_type = 'view' then ts end) as a, min(case when event_type = 'purchase' then ts end) as b group user_id having a is not null and b > a", "events"), "SELECT user_id, min(CASE WHEN event_type = 'view' THEN ts END) AS a, min(CASE WHEN event_type = 'purchase' THEN ts END) AS b FROM events GROUP BY 1 HAVING a IS NOT NULL AND b > a")
add("retention_cohort", lambda spark, d: _cohorts(spark, d), "WITH f AS (SELECT user_id, date_trunc('week', min(ts)) AS cohort FROM events GROUP BY 1) SELECT cohort, date_trunc('week', ts) AS week, count(DISTINCT e.user_id) AS users FROM events e JOIN f USING (user_id) GROUP BY 1, 2")

# lookups and joins
add("lookup_count_required", _text("get customer count lookup orders on o_custkey required where o_totalprice > 300000", "customer", "orders"), "SELECT count(*) AS count FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
add("lookup_folded", _text("get customer select id lookup orders on o_custkey select count() as n, sum(o_totalprice) as total where o_totalprice > 200000", "customer", "orders", flat=True, round_to=2), "SELECT c_custkey AS id, count(o_orderkey) AS n, round(sum(o_totalprice), 2) AS total FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 200000 GROUP BY 1")
add("lookup_off_groups", _text("select o_custkey, count(*) as n from orders group o_custkey order n desc limit 15 lookup customer on c_custkey = o_custkey select c_name", "orders", "customer", flat=True), "SELECT o_custkey, n, c_name FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, o_custkey LIMIT 15) JOIN customer ON c_custkey = o_custkey")
add("join_inner", _text("select o.o_orderkey, c.c_name from orders o join customer c on c.c_custkey = o.o_custkey where o.o_totalprice > 250000 and c.c_mktsegment = 'BUILDING'", "orders", "customer"), "SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey WHERE o.o_totalprice > 250000 AND c.c_mktsegment = 'BUILDING'")
add("join_left", _text("select c.c_custkey, o.o_orderkey from customer c left join orders o on o.o_custkey = c.c_custkey and o.o_totalprice > 280000", "customer", "orders"), "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_totalprice > 280000")
add("join_three", _text("select n.n_name, count(*) as orders, sum(o.o_totalprice) as total from orders o join customer c on c.c_custkey = o.o_custkey join nation n on n.n_nationkey = c.c_nationkey group by n.n_name", "orders", "customer", "nation", round_to=2), "SELECT n.n_name, count(*) AS orders, round(sum(o.o_totalprice), 2) AS total FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey GROUP BY 1")
add("anti_left_join", _text("select c.c_custkey from customer c left join orders o on o.o_custkey = c.c_custkey and o.o_totalprice > 200000 where o.o_orderkey is null", "customer", "orders"), "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
add("semi_in_get", _text("get customer select id where c_custkey in (get orders select o_custkey where o_totalprice > 300000)", "customer", "orders"), "SELECT c_custkey AS id FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
add("anti_not_in_get", lambda spark, d: _not_in(spark, d), f"SELECT o_orderkey AS id FROM {WITH_NULLS} x WHERE NOT EXISTS (SELECT 1 FROM {WITH_NULLS} y WHERE y.o_orderpriority = x.o_orderpriority AND y.o_orderpriority > '3')")
add("exists_correlated", _text("select c.c_custkey from customer c where exists (select 1 from orders o where o.o_custkey = c.c_custkey and o.o_orderstatus = 'P') and not exists (select 1 from orders o where o.o_custkey = c.c_custkey and o.o_totalprice > 290000)", "customer", "orders"), "SELECT c.c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P') AND NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 290000)")
add("scalar_subquery", _text("get orders select id where o_totalprice = (select max(o_totalprice) as m from orders)", "orders"), "SELECT o_orderkey AS id FROM orders WHERE o_totalprice = (SELECT max(o_totalprice) FROM orders)")

# facets
add("facet_values", lambda spark, d: ask(spark, d, "get part select id where p_size > 10 limit 5 facet p_brand", names=("part",)).facets["p_brand"], "SELECT p_brand AS value, count(*) AS count FROM part WHERE p_size > 10 GROUP BY 1")
add("facet_top", lambda spark, d: ask(spark, d, "get part select id limit 5 facet p_type top 7", names=("part",)).facets["p_type"], "SELECT p_type AS value, count(*) AS count FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 7")
add("facet_ranges", lambda spark, d: rounded(ask(spark, d, "get part select id limit 5 facet p_size ranges [0, 10, 20, 30, 1000, 2000]", names=("part",)).facets["p_size"]), "SELECT low, high, count(p_partkey) AS count FROM (VALUES (0.0::DOUBLE, 10.0::DOUBLE), (10, 20), (20, 30), (30, 1000), (1000, 2000)) r(low, high) LEFT JOIN part ON p_size >= low AND p_size < high GROUP BY 1, 2")
add("facet_disjunctive", lambda spark, d: ask(spark, d, "get part select id where p_brand = 'Brand#11' and p_size < 25 limit 5 facet p_brand disjunctive", names=("part",)).facets["p_brand"], "SELECT p_brand AS value, count(*) AS count FROM part WHERE p_size < 25 GROUP BY 1")
add("facet_list", lambda spark, d: ask(spark, d, "get documents select id limit 5 facet tags", names=("documents",), documents=lambda df: df.withColumn("tags", F.array("lang", F.lit("x"), F.lit("x")))).facets["tags"], "SELECT value, count(*) AS count FROM (SELECT lang AS value FROM documents UNION ALL SELECT 'x' FROM documents) GROUP BY 1")

# search
BM25_SQL = """
WITH t AS (SELECT doc_id, lang, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM documents),
s AS (SELECT count(*) AS n, greatest(1, avg(len(w))) AS a FROM t),
f AS (SELECT q.term, t.doc_id, t.lang, len(t.w) AS dl, len(list_filter(t.w, lambda x: x = q.term)) AS tf FROM t, (VALUES {terms}) q(term)),
g AS (SELECT * FROM f WHERE tf > 0), d AS (SELECT term, count(*) AS df FROM g GROUP BY 1)
SELECT doc_id AS id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 1.9 / (tf + 0.9 * (0.6 + 0.4 * dl / a))), 6) AS _score
FROM g JOIN d USING (term), s {where} GROUP BY 1 ORDER BY sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 1.9 / (tf + 0.9 * (0.6 + 0.4 * dl / a))) DESC, doc_id LIMIT {limit}"""
add("bm25_match", _text('get documents select id match text "license apache idiot" limit 25', "documents", round_to=6), BM25_SQL.format(terms="('license'), ('apache'), ('idiot')", where="", limit=25))
add("bm25_match_filtered", _text('get documents select id where lang = "en" match text "general public and" limit 20', "documents", round_to=6), BM25_SQL.format(terms="('general'), ('public'), ('and')", where="WHERE lang = 'en'", limit=20))
add("bm25_indexed", lambda spark, d: rounded(_indexed(spark, d, 'get documents select id match text "license apache idiot" limit 25'), 6), BM25_SQL.format(terms="('license'), ('apache'), ('idiot')", where="", limit=25))
add("bm25_indexed_filtered", lambda spark, d: rounded(_indexed(spark, d, 'get documents select id where lang = "en" match text "general public and" limit 20'), 6), BM25_SQL.format(terms="('general'), ('public'), ('and')", where="WHERE lang = 'en'", limit=20))
add("bm25_indexed_written", lambda spark, d: rounded(_index_kept(spark, d), 6), BM25_SQL.format(terms="('license'), ('version')", where="", limit=25).replace("FROM documents)", "FROM (SELECT doc_id, lang, CASE WHEN lang = 'de' THEN 'version two of a license' ELSE text END AS text FROM documents WHERE lang <> 'fr'))"))
add("match_count", _text('get documents match text "license" count', "documents"), "SELECT count(*) AS count FROM documents WHERE list_contains(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), 'license')")
VARIANTS_SQL = """
WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM documents),
s AS (SELECT count(*) AS n, greatest(1, avg(len(w))) AS a FROM t),
v AS (SELECT word, term, CASE WHEN term = word THEN 0 ELSE 1 END AS d FROM (SELECT DISTINCT unnest(w) AS term FROM t), (VALUES {words}) q(word) WHERE term = word OR {near}),
f AS (SELECT word, d, doc_id, dl, count(*) AS tf FROM (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM t) JOIN v USING (term) GROUP BY ALL),
i AS (SELECT word, d, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf FROM (SELECT word, d, count(*) AS df FROM f GROUP BY 1, 2), s),
x AS (SELECT i.word, i.d, CASE WHEN i.d = 0 OR o.idf IS NULL THEN i.idf ELSE least(i.idf, o.idf * 0.99) END AS weight FROM i LEFT JOIN (SELECT word, idf FROM i WHERE d = 0) o ON o.word = i.word)
SELECT doc_id AS id, round(sum(weight * tf * 1.9 / (tf + 0.9 * (0.6 + 0.4 * dl / a))), 6) AS _score
FROM f JOIN x USING (word, d), s GROUP BY 1 ORDER BY sum(weight * tf * 1.9 / (tf + 0.9 * (0.6 + 0.4 * dl / a))) DESC, doc_id LIMIT 10"""
ONE_EDIT = "left(term, 1) = left(word, 1) AND abs(length(term) - length(word)) <= 1 AND damerau_levenshtein(substr(term, 2), substr(word, 2)) <= 1"
add("fuzzy_match", _text('get documents select id match text "licensed publik" fuzzy 1 limit 10', "documents", round_to=6), VARIANTS_SQL.format(words="('licensed'), ('publik')", near=f"({ONE_EDIT})"))
add("prefix_match", _text('get documents select id match text "licen" prefix limit 10', "documents", round_to=6), VARIANTS_SQL.format(words="('licen')", near="starts_with(term, word)"))
add("fuzzy_match_indexed", lambda spark, d: rounded(_indexed(spark, d, 'get documents select id match text "licensed publik" fuzzy 1 limit 10'), 6), VARIANTS_SQL.format(words="('licensed'), ('publik')", near=f"({ONE_EDIT})"))
SPANS_SQL = """
WITH best AS ({best}),
p AS (SELECT id, text, _score, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+') AS parts FROM best JOIN documents ON doc_id = id),
e AS (SELECT *, list_transform(range(1, len(parts) + 1), lambda i: list_sum(list_transform(parts[:i], lambda x: length(x)))) AS ends FROM p),
m AS (SELECT id, text, _score, list_transform(list_filter(range(1, len(parts) + 1), lambda i: list_contains([{words}], parts[i])), lambda i: {{'s': CAST(ends[i] - length(parts[i]) AS BIGINT), 'e': CAST(ends[i] AS BIGINT)}}) AS spans FROM e)"""
add("highlight_spans", lambda spark, d: _highlights(spark, d), SPANS_SQL.format(best=BM25_SQL.format(terms="('license')", where="", limit=10), words="'license'") + " SELECT id, _score, array_to_string(list_transform(spans, lambda x: x.s || '-' || x.e), ',') AS highlight FROM m")
SNIPPET_SQL = SPANS_SQL.format(best=BM25_SQL.format(terms="('license'), ('version')", where="", limit=10), words="'license', 'version'") + """,
c AS (SELECT *, list_transform(range(1, len(spans) + 1), lambda k: len(list_filter(spans[k:], lambda x: x.e <= spans[k].s + 80))) AS inside FROM m),
b AS (SELECT *, list_position(inside, list_max(inside)) AS k FROM c),
w AS (SELECT *, CASE WHEN length(text) <= 80 THEN 0 ELSE greatest(0, least(length(text) - 80, spans[k].s - greatest(0, (80 - (spans[k + inside[k] - 1].e - spans[k].s)) // 2))) END AS a FROM b),
z AS (SELECT *, CASE WHEN length(text) <= 80 THEN length(text) ELSE a + 80 END AS z FROM w),
y AS (SELECT *, list_filter(spans, lambda x: x.s >= a AND x.e <= z) AS held FROM z)
SELECT id, _score, CASE WHEN a > 0 THEN '…' ELSE '' END
  || array_to_string(list_transform(range(1, len(held) + 1), lambda i: substr(text, CASE WHEN i = 1 THEN a ELSE held[i - 1].e END + 1, held[i].s - CASE WHEN i = 1 THEN a ELSE held[i - 1].e END) || '<' || substr(text, held[i].s + 1, held[i].e - held[i].s) || '>'), '')
  || substr(text, coalesce(held[len(held)].e, a) + 1, z - coalesce(held[len(held)].e, a)) || CASE WHEN z < length(text) THEN '…' ELSE '' END AS part
FROM y"""
add("snippet", _text('get documents select id, snippet(text, 80, "…", "<", ">") as part match text "license version" limit 10', "documents", round_to=6), SNIPPET_SQL)
QUERY = [round(((k * 37) % 11 - 5) / 10, 1) for k in range(64)]
VECTOR = "[" + ", ".join(f"{x}::DOUBLE" for x in QUERY) + "]"
NEAR = "SELECT vec_id AS id, round({score}, 6) AS _score FROM embeddings {where} ORDER BY {score} {way}, vec_id LIMIT 10"
for metric, fn, way in (("cosine", "list_cosine_similarity", "DESC"), ("l2", "list_distance", "ASC"), ("dot", "list_dot_product", "DESC")):
    add(f"near_exact_{metric}", (lambda m: lambda spark, d: _near(spark, d, m, ""))(metric), NEAR.format(score=f"{fn}(embedding::DOUBLE[], {VECTOR})", where="", way=way))
add("near_filtered", lambda spark, d: _near(spark, d, "cosine", "where label in [1, 2, 3]"), NEAR.format(score=f"list_cosine_similarity(embedding::DOUBLE[], {VECTOR})", where="WHERE label IN (1, 2, 3)", way="DESC"))
for quant in ("int8", "bit"):
    add(f"near_indexed_{quant}", (lambda q: lambda spark, d: _near_indexed(spark, d, q))(quant), NEAR.format(score=f"list_cosine_similarity(embedding::DOUBLE[], {VECTOR})", where="", way="DESC"))
add("vector_functions", lambda spark, d: rounded(ask(spark, d, "get embeddings select id, cosine(embedding, $1) as c, l2(embedding, $1) as l, dot(embedding, $1) as p, norm(embedding) as n", QUERY, names=("embeddings",)).df, 5), f"SELECT vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], {VECTOR}), 5) AS c, round(list_distance(embedding::DOUBLE[], {VECTOR}), 5) AS l, round(list_dot_product(embedding::DOUBLE[], {VECTOR}), 5) AS p, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 5) AS n FROM embeddings")
add("order_by_distance", lambda spark, d: ask(spark, d, "select vec_id from embeddings order by embedding <-> $1 limit 10", QUERY, names=("embeddings",)).df, f"SELECT vec_id FROM embeddings ORDER BY list_distance(embedding::DOUBLE[], {VECTOR}), vec_id LIMIT 10")
add("ann_recall", lambda spark, d: _ann(spark, d), "SELECT true AS enough")
add("ann_recall_each", lambda spark, d: _recalls(spark, d), "SELECT vec_id AS query, 1.0 AS recall FROM embeddings WHERE vec_id % 100 = 0")
RANKED_SQL = "WITH m AS (" + BM25_SQL.format(terms="('license')", where="", limit=50) + f"), v AS (SELECT vec_id AS id, list_cosine_similarity(embedding::DOUBLE[], {VECTOR}) AS c FROM embeddings JOIN documents ON doc_id = vec_id WHERE embedding IS NOT NULL)"
add("rerank", lambda spark, d: rounded(_both(spark, d, 'get both select id match text "license" rerank embedding $1 candidates 50 limit 8'), 6), RANKED_SQL + " SELECT id, round(c, 6) AS _score FROM v JOIN m USING (id) ORDER BY c DESC, id LIMIT 8")
add("fuse_rrf", lambda spark, d: rounded(_both(spark, d, 'get both select id match text "license" near embedding $1 fuse limit 10'), 6), RANKED_SQL + ", a AS (SELECT id, row_number() OVER (ORDER BY _score DESC, id) AS r FROM m), b AS (SELECT id, row_number() OVER (ORDER BY c DESC, id) AS r FROM v) SELECT id, round(coalesce(1.0 / (60 + a.r), 0) + coalesce(1.0 / (60 + b.r), 0), 6) AS _score FROM (SELECT * FROM a WHERE r <= 20) a FULL JOIN (SELECT * FROM b WHERE r <= 20) b USING (id) ORDER BY coalesce(1.0 / (60 + a.r), 0) + coalesce(1.0 / (60 + b.r), 0) DESC, id LIMIT 10")
add("sparse_dot", lambda spark, d: _sparse(spark, d), "SELECT o_orderkey AS id, CAST(2.0 * (o_orderkey % 7) + 0.5 * (o_orderkey % 11) AS DOUBLE) AS _score FROM orders ORDER BY 2 DESC, 1 LIMIT 15")
GEO = {"events": lambda df: df.withColumn("loc", F.array(((F.col("event_id") * 37) % 360 - 180).cast("double"), ((F.col("event_id") * 17) % 170 - 85).cast("double")))}
GEO_SQL = "(SELECT event_id, (event_id * 37) % 360 - 180 AS x, (event_id * 17) % 170 - 85 AS y FROM events)"
HAVERSINE = f"2 * {geo.RADIUS} * asin(sqrt(least(1, pow(sin(radians(52.5 - y) / 2), 2) + cos(radians(y)) * cos(radians(52.5)) * pow(sin(radians(13.4 - x) / 2), 2))))"
add("geo_radius", _text("get events select id where distance(loc, [13.4, 52.5]) <= 900000", "events", **GEO), f"SELECT event_id AS id FROM {GEO_SQL} WHERE {HAVERSINE} <= 900000")
add("geo_within", _text("get events select id where within(loc, [170, -20, -170, 20])", "events", **GEO), f"SELECT event_id AS id FROM {GEO_SQL} WHERE (x >= 170 OR x <= -170) AND y BETWEEN -20 AND 20")
add("geo_nearest", lambda spark, d: rounded(_geo_near(spark, d), 2), f"SELECT event_id AS id, round({HAVERSINE}, 2) AS _score FROM {GEO_SQL} ORDER BY {HAVERSINE}, 1 LIMIT 12")

# tenants, access, writes, expiry
add("tenant_concat", lambda spark, d: fanout.concatenated(_tenants(spark, d)), "SELECT o_orderstatus AS tenant, o_orderkey AS id, round(o_totalprice, 4) AS o_totalprice FROM orders")
add("tenant_topk", lambda spark, d: fanout.ordered(fanout.concatenated(_tenants(spark, d)), [("o_totalprice", True)], 20), "SELECT o_orderstatus AS tenant, o_orderkey AS id, round(o_totalprice, 4) AS o_totalprice FROM orders ORDER BY 3 DESC, 1, 2 LIMIT 20")
add("tenant_fold", lambda spark, d: _tenant_fold(spark, d), "SELECT o_orderpriority, count(*) AS n, round(max(o_totalprice), 4) AS top FROM orders GROUP BY 1")
add("row_policy", lambda spark, d: ask(spark, d, "get orders select id, o_totalprice where o_totalprice > 100000", names=("orders",), policy=Policy({"orders": parse_one("get orders where o_orderstatus = 'O'").where})).df.select("id"), "SELECT o_orderkey AS id FROM orders WHERE o_totalprice > 100000 AND o_orderstatus = 'O'")
add("builder_query", lambda spark, d: rounded(collection(catalog(spark, d, "orders"), "orders").select("o_orderstatus", "sum(o_totalprice) as total").where("o_custkey > $1", 100).group("o_orderstatus").order("total desc").df(), 2), "SELECT o_orderstatus, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_custkey > 100 GROUP BY 1")
add("ttl_alive", lambda spark, d: _alive(spark, d), "SELECT event_id AS id FROM events WHERE ts > TIMESTAMP '2024-01-15'")
add("set_update", lambda spark, d: _written(spark, d, "set orders {o_custkey: o_custkey + 1000} where o_orderstatus = 'P'"), "SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'P' THEN o_custkey + 1000 ELSE o_custkey END AS o_custkey FROM orders")
add("delete_where", lambda spark, d: _written(spark, d, "del orders where o_totalprice > 100000"), "SELECT o_orderkey AS id, o_custkey FROM orders WHERE NOT o_totalprice > 100000")
add("claim_jobs", lambda spark, d: _written(spark, d, "set orders {o_custkey: 0 - 1} where o_orderstatus = 'O' order o_orderdate limit 5 returning id, o_custkey", answer=True), "SELECT o_orderkey AS id, -1 AS o_custkey FROM (SELECT * FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate, o_orderkey LIMIT 5)")
add("upsert_rollup", lambda spark, d: _upsert(spark, d), "SELECT n_nationkey AS id, n_regionkey + CASE WHEN n_nationkey < 2 THEN 10 ELSE 0 END AS n FROM nation UNION ALL SELECT 100, 7")

add("put_returning", lambda spark, d: _written(spark, d, "put orders {o_custkey: 5, o_orderstatus: 'N'} returning id, o_custkey", answer=True), "SELECT max(o_orderkey) + 1 AS id, 5 AS o_custkey FROM orders")
add("require_met", _text("get orders select id where o_orderkey = 7 require 1 else 'order 7 is there'", "orders"), "SELECT o_orderkey AS id FROM orders WHERE o_orderkey = 7")
COLLATED_SQL = "(SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN upper(p_name) WHEN 1 THEN translate(p_name, 'eaou', 'éäôü') WHEN 2 THEN array_to_string(list_transform(string_split(p_name, ' '), lambda x: upper(x[1]) || x[2:]), ' ') ELSE p_name END AS p_name, p_name AS base, CASE p_partkey % 4 WHEN 0 THEN 2 WHEN 1 THEN 3 WHEN 2 THEN 1 ELSE 0 END AS way FROM part)"
add("collate_order", lambda spark, d: _collated(spark, d), f"(SELECT id, p_name, 'first' AS part FROM {COLLATED_SQL} ORDER BY base, way, id LIMIT 200) UNION ALL (SELECT id, p_name, 'last' FROM {COLLATED_SQL} ORDER BY base DESC, way DESC, id LIMIT 200)")
add("nocase_filter", lambda spark, d: _folded(spark, d), "SELECT doc_id AS id FROM documents WHERE doc_id % 3 = 0")
add("match_prefix_index", lambda spark, d: _prefixed(spark, d), "SELECT doc_id AS id FROM documents WHERE len(list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), lambda x: x LIKE 'lic%')) > 0 AND lang = 'en'")
add("request_parameters", lambda spark, d: _request(spark, d), "SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice >= 100000 AND o_orderstatus IN ('F', 'O') ORDER BY o_custkey DESC, o_orderkey LIMIT 30")
add("stream_rollup", lambda spark, d: _stream(spark, d, "rollup"), "SELECT date_trunc('day', ts) AS bucket, event_type, count(*) AS n FROM events GROUP BY 1, 2")
add("stream_once", lambda spark, d: _stream(spark, d, "once"), "SELECT event_type, count(DISTINCT event_id) AS n FROM events GROUP BY 1")
add("stream_cdc_snapshot", lambda spark, d: _cdc(spark, d), "SELECT n_nationkey AS id, CASE WHEN n_regionkey = 1 THEN n_nationkey + 100 ELSE n_nationkey END AS n FROM nation WHERE n_regionkey <> 2")
add("live_difference_nulls", lambda spark, d: _live_nulls(spark, d), "SELECT o_orderkey AS id, 'put' AS op FROM orders WHERE o_totalprice > 100000 AND o_orderkey % 10 IN (0, 2)")
add("live_difference", lambda spark, d: _live(spark, d), "SELECT o_orderkey AS id, 'put' AS op FROM orders WHERE o_totalprice > 100000 AND o_orderkey % 10 = 0 UNION ALL SELECT o_orderkey, 'del' FROM orders WHERE o_totalprice > 100000 AND o_orderkey % 10 = 1")

# lookups, joins and orders over whole tables
add("lookup_topn_per_parent", _text("get customer select id, c_name lookup orders on o_custkey select o_orderkey, o_totalprice order o_totalprice desc limit 3", "customer", "orders", flat=True), "SELECT c_custkey AS id, c_name, o_orderkey, round(o_totalprice, 4) AS o_totalprice FROM (SELECT c.c_custkey, c.c_name, o.o_orderkey, o.o_totalprice, row_number() OVER (PARTITION BY c.c_custkey ORDER BY o.o_totalprice DESC, o.o_orderkey) AS rn FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey) WHERE rn <= 3")
add("lookup_required", _text("get customer select id order c_acctbal desc limit 20 lookup orders on o_custkey required select o_orderkey where o_totalprice > 250000", "customer", "orders", flat=True), "WITH p AS (SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000) ORDER BY c_acctbal DESC, c_custkey LIMIT 20) SELECT c_custkey AS id, o_orderkey FROM p JOIN orders ON o_custkey = c_custkey AND o_totalprice > 250000")
add("lookup_folded_groups", _text("get customer select id lookup orders on o_custkey select o_orderstatus, count() as n group o_orderstatus order n desc limit 2", "customer", "orders", flat=True), "SELECT c_custkey AS id, o_orderstatus, n FROM (SELECT c_custkey, o_orderstatus, n, row_number() OVER (PARTITION BY c_custkey ORDER BY n DESC, o_orderstatus) AS rn FROM (SELECT c_custkey, o_orderstatus, count(o_orderkey) AS n FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2)) WHERE rn <= 2 UNION ALL SELECT c_custkey, NULL, NULL FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
add("lookup_chain", _text("get customer select id lookup orders on o_custkey select o_orderkey order o_orderdate limit 2 lookup lineitem on l_orderkey = o_orderkey select l_quantity, l_partkey order l_quantity desc, l_partkey limit 2", "customer", "orders", LINES, flat=True), "WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders), l AS (SELECT l_orderkey, l_quantity, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_partkey) AS rn FROM lineitem) SELECT c_custkey AS id, o.o_orderkey, l.l_quantity, l.l_partkey FROM customer LEFT JOIN o ON o.o_custkey = c_custkey AND o.rn <= 2 LEFT JOIN l ON l.l_orderkey = o.o_orderkey AND l.rn <= 2")
add("lookup_composite", lambda spark, d: _composite(spark, d), "SELECT o.o_orderkey AS id, round(x.price, 2) AS price FROM orders o LEFT JOIN (SELECT o_custkey, o_orderstatus, min(o_totalprice) AS price FROM orders GROUP BY 1, 2) x USING (o_custkey, o_orderstatus)")
add("join_comma", _text("select c.c_name, o.o_orderkey from customer c, orders o where c.c_custkey = o.o_custkey", "customer", "orders"), "SELECT c.c_name, o.o_orderkey FROM customer c, orders o WHERE c.c_custkey = o.o_custkey")
add("geo_distance", _text("get events select id, distance(loc, [13.4, 52.5]) as metres", "events", round_to=2, **GEO), f"SELECT event_id AS id, round({HAVERSINE}, 2) AS metres FROM {GEO_SQL}")
add("json_order_mixed", lambda spark, d: _mixed(spark, d), "(SELECT event_id AS id, 'first' AS part FROM events ORDER BY event_id % 3 = 0 DESC, event_id % 3, event_id LIMIT 12) UNION ALL (SELECT event_id, 'last' FROM events ORDER BY event_id % 3 = 0, event_id % 3 DESC, event_id LIMIT 12)")


ACCENTED = "CASE WHEN p_partkey % 4 = 0 THEN upper(p_name) WHEN p_partkey % 4 = 1 THEN translate(p_name, 'eaou', 'éäôü') WHEN p_partkey % 4 = 2 THEN initcap(p_name) ELSE p_name END"


# what only statements of more than one step show
KEYED = "(SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderkey // 3 END AS k FROM orders)"
add("join_null_keys", lambda spark, d: _null_keys(spark, d, "select l.id, r.v from lefts l join rights r on r.k = l.k"), f"SELECT l.id, r.id AS v FROM {KEYED} l JOIN {KEYED} r ON r.k = l.k")
add("lookup_null_keys", lambda spark, d: _null_keys(spark, d, "get lefts select id lookup rights on k = k select v", flat=True), f"SELECT l.id, r.id AS v FROM {KEYED} l LEFT JOIN {KEYED} r ON r.k = l.k")
add("join_semi_by_id", _text("select o.o_orderkey, o.o_totalprice from orders o join customer c on c.c_custkey = o.o_custkey where c.c_acctbal > 5000 and o.o_totalprice > 50000", "orders", "customer"), "SELECT o_orderkey, round(o_totalprice, 4) AS o_totalprice FROM orders WHERE o_totalprice > 50000 AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")
add("join_semi_distinct", _text("select distinct c.c_custkey, c.c_name from customer c join orders o on o.o_custkey = c.c_custkey where o.o_totalprice > 200000", "customer", "orders"), "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
add("facet_null_value", lambda spark, d: ask(spark, d, "get orders select id limit 5 facet o_orderpriority", names=("orders",), **NULLIF).facets["o_orderpriority"], f"SELECT o_orderpriority AS value, count(*) AS count FROM {WITH_NULLS} GROUP BY 1")
add("facet_json_path", lambda spark, d: ask(spark, d, "get events select id where event_type = 'view' limit 5 facet props.k top 12", names=("events",)).facets["props.k"], "SELECT json_extract_string(props, '$.k') AS value, count(*) AS count FROM events WHERE event_type = 'view' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 12")
add("facet_of_match", lambda spark, d: ask(spark, d, 'get documents select id match text "license" limit 3 facet lang', names=("documents",)).facets["lang"], "SELECT lang AS value, count(*) AS count FROM documents WHERE list_contains(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), 'license') GROUP BY 1")
add("facet_required_count", lambda spark, d: ask(spark, d, "get customer select id limit 3 facet c_mktsegment lookup orders on o_custkey required where o_totalprice > 200000", names=("customer", "orders")).facets["c_mktsegment"], "SELECT c_mktsegment AS value, count(*) AS count FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000) GROUP BY 1")
add("timestamp_of", _text('get orders select id, timestamp(o_orderkey) - timestamp("1970-01-01T00:00:00Z") as ms, timestamp("2024-02-30") as none, o_orderdate - timestamp("2020-01-01") as since', "orders"), "SELECT o_orderkey AS id, o_orderkey AS ms, CAST(NULL AS BIGINT) AS none, epoch_ms(o_orderdate) - epoch_ms(TIMESTAMP '2020-01-01') AS since FROM orders")
add("field_mask", lambda spark, d: ask(spark, d, "get customer", names=("customer",), policy=Policy(hidden={"customer": frozenset({"c_acctbal"})})).df, "SELECT c_custkey AS id, c_custkey, c_name, c_nationkey, CAST(NULL AS DOUBLE) AS c_acctbal, c_mktsegment FROM customer")
add("own_function", lambda spark, d: _own_function(spark, d), "SELECT o_orderkey AS id, o_totalprice > 100000 AS large FROM orders")
add("tenant_partial", lambda spark, d: _partial(spark, d), "SELECT o_orderstatus AS tenant, count(*) AS n FROM orders GROUP BY 1 UNION ALL SELECT 'X failed', 0")
add("path_write", lambda spark, d: _events_written(spark, d, "set events {props.k: 7, props.tag: 'x'} where user_id < 20"), "SELECT event_id AS id, CASE WHEN user_id < 20 THEN 7.0 ELSE CAST(json_extract(props, '$.k') AS DOUBLE) END AS k, CASE WHEN user_id < 20 THEN 'x' END AS tag FROM events")
add("expired_rows", lambda spark, d: _swept(spark, d), "SELECT event_id AS id, ts > TIMESTAMP '2024-01-15' AS alive FROM events")
add("next_changes", lambda spark, d: _next(spark, d), "SELECT min(ts) FILTER (WHERE ts > TIMESTAMP '2024-01-15') + INTERVAL 5 DAY AS expiry, min(ts) FILTER (WHERE ts > TIMESTAMP '2024-01-20') AS change FROM events")
add("batch_of_writes", lambda spark, d: _batch(spark, d), "SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN c_acctbal + 3 ELSE c_acctbal END AS c_acctbal FROM customer WHERE c_nationkey <> 3")
add("writes_reopened", lambda spark, d: _reopened(spark, d), "SELECT n_nationkey AS id, CASE WHEN n_regionkey = 1 THEN n_nationkey + 100 ELSE n_nationkey END AS n FROM nation WHERE n_regionkey <> 2 UNION ALL SELECT 100, 5")
add("restored_moment", lambda spark, d: _restored(spark, d), "SELECT n_nationkey AS id, CASE WHEN n_regionkey = 1 THEN n_nationkey + 100 ELSE n_nationkey END AS n FROM nation")
add("cursor_of_consumer", lambda spark, d: _cursor(spark, d), "SELECT step, n, seq FROM (SELECT 1 AS step, count(*) AS n, count(*) AS seq FROM nation WHERE n_regionkey IN (1, 2) UNION ALL SELECT 2, count(*) FILTER (WHERE n_regionkey = 2), count(*) FROM nation WHERE n_regionkey IN (1, 2) UNION ALL SELECT 3, -1, count(*) FROM nation WHERE n_regionkey = 1)")
add("replica_follows", lambda spark, d: _followed(spark, d), "SELECT n_nationkey AS id, CASE WHEN n_regionkey = 1 THEN n_nationkey + 100 ELSE n_nationkey END AS n FROM nation WHERE n_regionkey <> 2")
add("sqlite_import", lambda spark, d: _sqlite(spark, d), "SELECT p_partkey AS id, p_name, p_size, round(p_retailprice, 4) AS price FROM part")
add("json_in_and_out", lambda spark, d: _json(spark, d), "SELECT o_orderkey AS id, o_orderpriority, round(o_totalprice, 4) AS o_totalprice FROM orders")
add("clustered_range", lambda spark, d: _clustered(spark, d), "SELECT event_id AS id, user_id FROM events WHERE user_id BETWEEN 20 AND 40 AND ts < TIMESTAMP '2024-01-10'")
add("request_lookup", lambda spark, d: _requested(spark, d, "customer", {"select": "c_name", "order": "c_acctbal.desc", "limit": "40", "lookup": "orders", "orders.on": "o_custkey", "orders.select": "o_orderkey", "orders.o_totalprice": "gte.100000", "orders.order": "-o_totalprice", "orders.limit": "2"}), "SELECT c_name, o_orderkey FROM (SELECT * FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 40) c LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders WHERE o_totalprice >= 100000) o ON o_custkey = c_custkey AND rn <= 2")
add("request_count", lambda spark, d: _requested(spark, d, "orders", {"o_orderstatus": "eq.F", "o_totalprice": "lt.90000", "count": ""}), "SELECT count(*) AS count FROM orders WHERE o_orderstatus = 'F' AND o_totalprice < 90000")
add("request_near", lambda spark, d: rounded(_request_near(spark, d), 6), NEAR.format(score=f"list_cosine_similarity(embedding::DOUBLE[], {VECTOR})", where="", way="DESC").replace("vec_id AS id", "vec_id, label"))
add("named_statement", lambda spark, d: _named(spark, d), "SELECT o_orderkey AS id, round(o_totalprice, 4) AS o_totalprice FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 150000")
add("tool_calls", lambda spark, d: _tools(spark, d), "SELECT 'get' AS tool, doc_id AS id, lang FROM documents WHERE doc_id = 7 UNION ALL SELECT 'query', count(*), lang FROM documents GROUP BY lang UNION ALL SELECT 'write', doc_id, 'xx' FROM documents WHERE doc_id = 9")
add("held_claims", lambda spark, d: _claims(spark, d), "SELECT 1 AS worker, o_orderkey AS id FROM (SELECT * FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderdate, o_orderkey LIMIT 4) UNION ALL SELECT 2, o_orderkey FROM (SELECT * FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderdate, o_orderkey LIMIT 4 OFFSET 4)")
REFUSED = (
    ("vectors of two dimensions", "get embeddings select id, dot(embedding, [1.0, 2.0]) as x", "run"),
    ("a box off the globe", "get events select id where within(loc, [200, 0, 210, 5])", "TypeMismatch"),
    ("a point off the globe", "get events select id, distance(loc, [13.4, 152.5]) as x", "TypeMismatch"),
    ("a field beside a fold", "get orders select o_custkey, sum(o_totalprice) as t group o_orderstatus", "QueryError"),
    ("a ranked read without limit", "get embeddings near embedding [1.0]", "QueryError"),
    ("a sum that overflows", "get orders select sum(o_orderkey * 9000000000000000) as t", "run"),
    ("a need unmet", "set orders {o_custkey: 1} where o_orderkey = 7 require 2 else 'two'", "Unmet"),
    ("an id held already", "insert into orders (id, o_custkey) values (7, 1)", "Duplicate"),
    ("a field that is not there", "put orders {nothing: 1}", "QueryError"),
    ("a text for a number", "put orders {o_custkey: 'x'}", "TypeMismatch"),
)
add("refusals", lambda spark, d: _refusals(spark, d), "SELECT statement, outcome FROM (VALUES " + ", ".join(f"('{n}', '{o}')" for n, _, o in REFUSED) + ") t(statement, outcome)")


def _named(spark, d):
    from .operators.writes import Database
    from .statements import Statements

    s = Statements(Database(catalog(spark, d, "orders"), _folder(spark)))
    s.define("large", "get orders select id, o_totalprice where o_orderstatus = $1 and o_totalprice > $2")
    return rounded(s.run("large", "P", 150000.0).df)


def _tools(spark, d):
    """Rows that tools answer: one by id, groups, and what a write leaves."""
    from .operators.writes import Database
    from .tools import Tools

    t = Tools(Database(catalog(spark, d, "documents"), _folder(spark)), writable=True)
    rows = [("get", r["id"], r["lang"]) for r in t.call("get", {"collection": "documents", "id": 7})]
    rows += [("query", r["n"], r["lang"]) for r in t.call("query", {"query": "get documents select lang, count(*) as n group lang"})]
    t.call("write", {"query": "set documents {lang: 'xx'} where id = $1", "params": [9]})
    rows += [("write", r["id"], r["lang"]) for r in t.call("query", {"query": "get documents select id, lang where lang = 'xx'"})]
    return spark.createDataFrame(rows, "tool string, id bigint, lang string")


def _claims(spark, d):
    """Two workers that take jobs in turn never take the same."""
    from .operators.writes import Database
    from .streaming.replica import claimed

    db = Database(catalog(spark, d, "orders"), _folder(spark))
    take = "set orders {o_orderstatus: 'T'} where o_orderstatus = 'P' order o_orderdate limit 4 returning id"
    rows = [(w, r["id"]) for w in (1, 2) for r in claimed(db, take, wait=1.0, now=NOW)]
    return spark.createDataFrame(rows, "worker int, id bigint")


def _null_keys(spark, d, text, flat=False):
    c = catalog(spark, d, "orders")
    df = c.get("orders").df
    k = F.when(F.col("o_orderkey") % 5 != 0, F.floor(F.col("o_orderkey") / 3))
    c.register("lefts", df.select(F.col("o_orderkey").alias("id"), k.alias("k")))
    c.register("rights", df.select(F.col("o_orderkey").alias("id"), k.alias("k"), F.col("o_orderkey").alias("v")))
    a = Reader(c).select(parse_one(text))
    return a.flatten() if flat else a.df


def _own_function(spark, d):
    c = catalog(spark, d, "orders")
    c.register_function("large", lambda x: x > 100000, 1, "more than a hundred thousand")
    return Reader(c).select(parse_one("get orders select id, large(o_totalprice) as large")).df


def _partial(spark, d):
    """Tenants of which one cannot answer: the others do, and it is told."""
    tables = _tenants(spark, d)
    rows, failures = fanout.gathered(lambda t: tables[t], [*tables, "X"], partial=True)
    told = spark.createDataFrame([(f"{t} failed", 0) for t in failures], "tenant string, n bigint")
    return rows.groupBy("tenant").agg(F.count(F.lit(1)).alias("n")).unionByName(told)


def _events_written(spark, d, text):
    from .operators.writes import Database

    db = Database(catalog(spark, d, "events"), _folder(spark))
    db.run(text, now=NOW)
    return db.run("get events select id, props.k + 0.0 as k, props.tag as tag").df


def _aging(spark, d):
    c = catalog(spark, d, "events")
    return c.register("events", c.get("events").df, "event_id", ttl=("ts", 5 * 86_400_000))


def _swept(spark, d):
    from .streaming import changes

    live, gone = changes.swept(_aging(spark, d), NOW)
    return live.select(F.col("event_id").alias("id"), F.lit(True).alias("alive")).unionByName(gone.select(F.col("event_id").alias("id"), F.lit(False).alias("alive")))


def _next(spark, d):
    from .streaming import changes

    c = _aging(spark, d)
    row = changes.next_expiry(c, NOW), changes.next_change(c, parse_one("get events where ts > now()").where, NOW)
    return spark.createDataFrame([row], "expiry timestamp_ntz, change timestamp_ntz")


def _batch(spark, d):
    """Two writes that land together, one that does not, and one that is asked twice under one key."""
    from .errors import Unmet
    from .operators.writes import Database

    db = Database(catalog(spark, d, "customer"), _folder(spark))
    try:
        db.run("del customer; set customer {c_acctbal: 0.0} where c_custkey = 1 require 7", now=NOW)
    except Unmet:
        pass
    for _ in range(2):
        db.run("set customer {c_acctbal: c_acctbal + 3} where c_custkey in $1; del customer where c_nationkey = 3", [r[0] for r in db.catalog.get("customer").df.filter("c_custkey % 2 = 0").select("c_custkey").collect()], now=NOW, key="once")
    return db.run("get customer select id, c_acctbal").df


def _counts(spark, d):
    """A small collection under a database of its own: id, r, n."""
    from .operators.writes import Database

    c = catalog(spark, d, "nation")
    rows = c.get("nation").df.selectExpr("cast(n_nationkey as bigint) as id", "cast(n_regionkey as bigint) as r", "cast(n_nationkey as bigint) as n")
    c.register("counts", rows)
    return Database(c, _folder(spark)), rows


def _reopened(spark, d):
    """Writes of one session, read by another that opens the same folder."""
    from .operators.writes import Database

    db, rows = _counts(spark, d)
    db.run("set counts {n: n + 100} where r = 1", now=NOW)
    db.run("del counts where r = 2", now=NOW)
    c = Catalog(spark)
    c.register("counts", rows)
    again = Database(c, db.folder)
    again.run("put counts {id: 100, r: 9, n: 5}", now=NOW)
    again.run("compact counts", now=NOW)
    again.collect_garbage()
    return again.run("get counts select id, n").df


def _restored(spark, d):
    db, rows = _counts(spark, d)
    db.run("set counts {n: n + 100} where r = 1", now=NOW)
    db.run("del counts where r = 2", now=NOW + dt.timedelta(days=1))
    return db.restore(rows, "counts", NOW + dt.timedelta(hours=1)).select("id", "n")


def _cursor(spark, d):
    """A named consumer: what it is given, before and after it says what is done; and what is told once the log is cut."""
    from .errors import Gone

    db, _ = _counts(spark, d)
    db.run("set counts {n: n + 100} where r = 1", now=NOW)
    db.run("del counts where r = 2", now=NOW)
    rows = [(1, db.changes(db.store.cursor("a")).count(), db.store.now.seq)]
    first = db.changes().filter("op = 'put'").agg(F.max("seq")).head()[0]
    db.store.advanced("a", first)
    db.store.advanced("a", first - 1)  # a cursor does not go back
    rows.append((2, db.changes(db.store.cursor("a")).count(), db.store.now.seq))
    db.store.trimmed(db.store.now.seq)  # as far as the consumer is
    try:
        db.changes(0)
    except Gone:
        rows.append((3, -1, db.store.now.floor))
    return spark.createDataFrame(rows, "step int, n bigint, seq bigint")


def _followed(spark, d):
    from .operators.writes import Database
    from .streaming.replica import Replica

    db, rows = _counts(spark, d)
    db.run("set counts {n: n + 100} where r = 1", now=NOW)
    c = Catalog(spark)
    c.register("counts", rows)
    copy = Replica(Database(c, _folder(spark)))
    copy.follow(db.folder, f"{copy.db.folder}/check").awaitTermination()
    db.run("del counts where r = 2", now=NOW)
    copy.follow(db.folder, f"{copy.db.folder}/check").awaitTermination()
    copy.apply(db.changes())  # all of it again changes nothing
    return copy.db.run("get counts select id, n").df


def _sqlite(spark, d):
    import sqlite3
    import tempfile

    from .sources.importers import SqliteSource

    rows = catalog(spark, d, "part").get("part").df.select("p_partkey", "p_name", "p_size", "p_retailprice")
    with tempfile.TemporaryDirectory() as folder:
        with sqlite3.connect(f"{folder}/parts.db") as db:
            db.execute("create table part (p_partkey integer primary key, p_name text, p_size int, p_retailprice real)")
            db.executemany("insert into part values (?, ?, ?, ?)", map(tuple, rows.toLocalIterator()))
        found = SqliteSource(f"{folder}/parts.db").read(spark, "part", _folder(spark), batch=5000)
    c = Catalog(spark)
    c.register("part", found, "p_partkey")
    return rounded(Reader(c).select(parse_one("get part select id, p_name, p_size, p_retailprice as price")).df)


def _json(spark, d):
    """Rows out as JSON lines, and back in by declared types."""
    from .sources.importers import json_documents, json_rows

    path = _folder(spark)
    json_rows(ask(spark, d, "get orders", names=("orders",)).df).write.text(path)
    c = Catalog(spark)
    c.register("orders", json_documents(spark, path, {"id": "int", "o_orderpriority": "text", "o_totalprice": "float"}))
    return rounded(Reader(c).select(parse_one("get orders select id, o_orderpriority, o_totalprice")).df)


def _clustered(spark, d):
    """A composite order on disk: rows in ranges of (user_id, ts), so that the filter skips row groups."""
    from .sources.importers import clustered

    def build():
        path = _folder(spark)
        clustered(catalog(spark, d, "events").get("events").df, path, "user_id", "ts")
        return path

    c = Catalog(spark)
    c.register("events", spark.read.parquet(_once(spark, d, "clustered events", build)), "event_id")
    return Reader(c).select(parse_one('get events select id, user_id where user_id between 20 and 40 and ts < "2024-01-10"')).df


def _requested(spark, d, name, params):
    from .builder import Request

    tables = [name, *filter(None, params.get("lookup", "").split(","))]
    return Request(params).query(catalog(spark, d, *tables), name).answer().flatten()


def _request_near(spark, d):
    from .builder import Request

    return Request({"select": "vec_id,label"}).near(catalog(spark, d, "embeddings"), "embeddings", {"field": "embedding", "vector": QUERY, "limit": 10}).df()


def _refusals(spark, d):
    """What each statement is refused with; "run" where the refusal comes with the rows."""
    from .errors import QueryError
    from .operators.writes import Database

    c = catalog(spark, d, "orders", "events", "embeddings")
    c.register("events", GEO["events"](c.get("events").df), "event_id", geo={"loc"})
    db = Database(c, _folder(spark))
    rows = []
    for name, text, _ in REFUSED:
        try:
            out = db.run(text, now=NOW)
            try:
                out.df.write.format("noop").mode("overwrite").save()
                rows.append((name, "answered"))
            except Exception:  # raised by a row, in a task
                rows.append((name, "run"))
        except QueryError as e:
            rows.append((name, type(e).__name__))
    return spark.createDataFrame(rows, "statement string, outcome string")


def _collated(spark, d):
    """Every part name, some accented and some in other cases, in its place among the root collation's order."""
    c = catalog(spark, d, "part")
    c.register("part", c.get("part").df.withColumn("p_name", F.expr(ACCENTED)), "p_partkey", collate={"p_name": "und"})
    first, last = (Reader(c).select(parse_one(f"get part select id, p_name order p_name {way}, id limit 200")).df for way in ("", "desc"))
    return first.withColumn("part", F.lit("first")).unionByName(last.withColumn("part", F.lit("last")))


def _folded(spark, d):
    c = catalog(spark, d, "documents")
    df = c.get("documents").df.withColumn("s", F.when(F.col("doc_id") % 3 == 0, F.lit("STRASSE")).otherwise("strase"))
    c.register("documents", df, "doc_id", nocase={"s"})
    return Reader(c).select(parse_one("get documents select id where s = 'straße'")).df


def _mixed_events(spark, d):
    c = catalog(spark, d, "events")
    value = F.when(F.col("event_id") % 3 == 0, F.lit('{"v": 5}')).when(F.col("event_id") % 3 == 1, F.lit('{"v": 40}')).otherwise(F.lit('{"v": "a"}'))
    c.register("events", c.get("events").df.withColumn("props", value), "event_id", json={"props"})
    return c


def _mixed(spark, d):
    """Both ends of the order of the whole table."""
    c = _mixed_events(spark, d)
    first, last = (Reader(c).select(parse_one(f"get events select id order props.v {way} limit 12")).df for way in ("", "desc"))
    return first.withColumn("part", F.lit("first")).unionByName(last.withColumn("part", F.lit("last")))


def _prefixed(spark, d):
    c = catalog(spark, d, "documents")
    c.register("documents", c.get("documents").df, "doc_id", text={"text": {"prefix": 4, "prefix_min": 3}})
    return Reader(c).matches(parse_one('get documents select id where lang = "en" match text "lic" prefix')).select("id")


_kept: dict[tuple, object] = {}


def _once(spark, d, kind: str, make: Callable):
    """What an index is for: made at the first question over a folder, and read by all later ones of the session."""
    key = spark.sparkContext.applicationId, d, kind
    if key not in _kept:
        _kept[key] = make()
    return _kept[key]


def _indexed(spark, d, text):
    def build():
        c = catalog(spark, d, "documents")
        c.index_text("documents", "text", _folder(spark))
        return c

    return Reader(_once(spark, d, "text", build)).select(parse_one(text)).df


def _index_kept(spark, d):
    """The index of a collection that is written to."""
    from .operators.writes import Database

    c = catalog(spark, d, "documents")
    folder = _folder(spark)
    c.index_text("documents", "text", f"{folder}/index")
    db = Database(c, folder)
    db.run("set documents {text: 'version two of a license'} where lang = 'de'", now=NOW)
    db.run("del documents where lang = 'fr'", now=NOW)
    return db.run('get documents select id match text "license version" limit 25').df


def _highlights(spark, d):
    df = ask(spark, d, 'get documents select id, highlight(text) match text "license" limit 10', names=("documents",)).df
    return rounded(df.withColumn("highlight", F.array_join(F.transform("highlight", lambda x: F.concat_ws("-", x[0].cast("string"), x[1].cast("string"))), ",")), 6)


def _request(spark, d):
    from .builder import Request

    return Request({"select": "o_orderkey,o_custkey", "o_totalprice": "gte.100000", "o_orderstatus": "in.(F,O)", "order": "-o_custkey", "limit": "30"}).query(catalog(spark, d, "orders"), "orders").df()


def _stream(spark, d, kind):
    import uuid

    from .streaming import changes

    schema = spark.read.parquet(f"{d}/events.parquet").schema
    # a file's folder with its name, or a folder of part files
    stream = spark.readStream.schema(schema).parquet(f"{d}/events.parqu*").withColumn("ts", F.col("ts").cast("timestamp"))
    if kind == "rollup":
        out = changes.rollup(stream, "ts", "1 day", "1 day", {"n": "count(*)"}, ["event_type"]).withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))
    else:
        out = changes.once(stream, "event_id", "ts", "40 days")
    name, where = f"q{uuid.uuid4().hex}", _folder(spark)
    if kind == "rollup":
        q = out.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", f"{where}/check").trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.table(name)
    q = out.writeStream.format("parquet").option("path", f"{where}/out").option("checkpointLocation", f"{where}/check").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{where}/out").groupBy("event_type").agg(F.count("*").alias("n"))


def _cdc(spark, d):
    from .operators.writes import Database
    from .streaming import changes

    c = catalog(spark, d, "nation")
    ids = c.get("nation").df.selectExpr("cast(n_nationkey as bigint) as id", "cast(n_regionkey as bigint) as r", "cast(n_nationkey as bigint) as n")
    c.register("counts", ids)
    db = Database(c, _folder(spark))
    db.run("set counts {n: n + 100} where r = 1", now=NOW)
    db.run("del counts where r = 2", now=NOW)
    got = {"puts": None}

    def apply(puts, dels):
        new = puts.select(F.from_json("doc", ids.schema).alias("x")).select("x.*")
        gone = puts.select("id").unionByName(dels.select("id"))
        got["puts"] = ids.join(gone, "id", "left_anti").select(*ids.columns).unionByName(new).collect()  # a nation's rows

    changes.follow(changes.change_stream(spark, db.folder, collection="counts"), apply, f"{db.folder}/check").awaitTermination()
    return spark.createDataFrame(got["puts"], ids.schema).select("id", "n")


def _live_nulls(spark, d):
    """Values that change their column, and one that becomes null."""
    from .streaming import changes

    rows = catalog(spark, d, "orders").get("orders").df.filter("o_totalprice > 100000")
    before = rows.selectExpr("o_orderkey as id", "if(o_orderkey % 10 < 2, 'a', null) as x", "if(o_orderkey % 10 = 2, 'b', null) as y")
    after = rows.selectExpr("o_orderkey as id", "if(o_orderkey % 10 = 1, 'a', null) as x", "if(o_orderkey % 10 = 0, 'a', null) as y")
    puts, dels = changes.difference(before, after)
    return puts.select("id", F.lit("put").alias("op")).unionByName(dels.select("id", F.lit("del").alias("op")))


def _live(spark, d):
    from .streaming import changes

    rows = catalog(spark, d, "orders").get("orders").df.filter("o_totalprice > 100000").selectExpr("o_orderkey as id", "o_custkey as c")
    after = rows.filter("id % 10 != 1").withColumn("c", F.when(F.col("id") % 10 == 0, F.col("c") + 1).otherwise(F.col("c")))
    puts, dels = changes.difference(rows, after)
    return puts.select("id", F.lit("put").alias("op")).unionByName(dels.select("id", F.lit("del").alias("op")))


def _nocase(spark, d):
    c = catalog(spark, d, "orders")
    df = c.get("orders").df.withColumn("k", F.expr("CASE WHEN o_orderkey % 2 = 0 THEN upper(o_orderpriority) ELSE lower(o_orderpriority) END"))
    c.register("orders", df, "o_orderkey", nocase={"k"})
    return Reader(c).select(parse_one("get orders select k, count(*) as n group k")).df


def _sketches(spark, d):
    """Hourly sketches of each type, combined: within three standard errors of the count of each type."""
    c = catalog(spark, d, "events")
    hourly = Reader(c).select(parse_one("get events select event_type, bucket(ts, 1h) as h, hll_accumulate(user_id) as s group event_type, h")).df
    c.register("hours", hourly.withColumn("id", F.xxhash64("h", "event_type")))
    whole = Reader(c).select(parse_one("get hours select event_type, hll_estimate(hll_combine(s)) as n group event_type")).df
    exact = Reader(c).select(parse_one("get events select event_type as t, count(distinct user_id) as users group event_type")).df
    return whole.join(exact, F.col("event_type").eqNullSafe(F.col("t"))).select("event_type", "users", (F.abs(F.col("n") - F.col("users")) <= F.col("users") * 0.025).alias("close"))


def _cohorts(spark, d):
    c = catalog(spark, d, "events")
    first = Reader(c).select(parse_one("get events select user_id, bucket(min(ts), 1w) as cohort group user_id")).df
    c.register("firsts", first, "user_id")
    return Reader(c).select(parse_one("select f.cohort, bucket(e.ts, 1w) as week, count(distinct e.user_id) as users from events e join firsts f on f.user_id = e.user_id group f.cohort, week")).df


def _composite(spark, d):
    c = catalog(spark, d, "orders")
    c.register("shadow", c.get("orders").df.selectExpr("o_orderkey as id", "o_custkey as k", "o_orderstatus as s", "o_totalprice as price"))
    text = "get orders select id lookup shadow on (k, s) = (o_custkey, o_orderstatus) select price order price limit 1"
    return rounded(Reader(c).select(parse_one(text)).flatten(), 2)


def _not_in(spark, d):
    c = catalog(spark, d, "orders")
    df = NULLIF["orders"](c.get("orders").df)
    c.register("orders", df, "o_orderkey")
    c.register("others", df, "o_orderkey")
    return Reader(c).select(parse_one("get orders select id where o_orderpriority not in (get others select o_orderpriority where o_orderpriority > '3')")).df


def _near(spark, d, metric, where):
    c = catalog(spark, d, "embeddings")
    c.register("embeddings", c.get("embeddings").df, "vec_id", metric={"embedding": metric})
    return rounded(Reader(c, (QUERY,)).select(parse_one(f"get embeddings select id {where} near embedding $1 limit 10")).df, 6)


def _near_indexed(spark, d, quant):
    def build():
        c = catalog(spark, d, "embeddings")
        c.index_vectors("embeddings", "embedding", _folder(spark), quant=quant)
        return c

    c = _once(spark, d, f"codes of {quant}", build)
    return rounded(Reader(c, (QUERY,)).select(parse_one("get embeddings select id near embedding $1 limit 10")).df, 6)


def _recalls(spark, d, complete=True):
    """query, recall: each vec_id divisible by 100 against all rows, with the defaults of the index; the share of its ten exact neighbours that are found."""
    import itertools

    import numpy as np

    path = _folder(spark)
    rows = catalog(spark, d, "embeddings").get("embeddings").df.withColumn("id", F.col("vec_id"))
    found = ann.centres(rows, "embedding")
    # a pass over the rows is work for each core, whatever files they came in
    ann.indexed(rows.filter("embedding is not null"), "embedding", found).repartition(spark.sparkContext.defaultParallelism).write.parquet(path)
    index = spark.read.parquet(path)
    asked = rows.filter("vec_id % 100 = 0 and embedding is not null").select("id", "embedding").toLocalIterator()
    parts = 0
    while some := list(itertools.islice(asked, max(1, min(ann.ASKED, ann.NUMBERS // max(1, found.shape[1]))))):
        q = np.array([r.embedding for r in some], dtype=np.float64)
        got = ann.search_many(index, "embedding", found, q, 10, complete=complete).select("query", "id", F.lit(1).alias("hit"))
        true = ann.exact_many(index, "embedding", q, 10).select("query", "id")
        each = true.join(got, ["query", "id"], "left").groupBy("query").agg((F.count("hit") / F.count(F.lit(1))).alias("recall"))
        ids = spark.createDataFrame([(k, r.id) for k, r in enumerate(some)], "query int, of long")
        each.join(F.broadcast(ids), "query").select(F.col("of").alias("query"), "recall").write.parquet(f"{path}-recall/{parts}")  # a portion of the queries
        parts += 1
    if not parts:
        return spark.createDataFrame([], "query long, recall double")
    return spark.read.parquet(*(f"{path}-recall/{k}" for k in range(parts)))


def _ann(spark, d):
    return _recalls(spark, d).agg((F.avg("recall") >= 0.9).alias("enough"))


def _both(spark, d, text):
    c = catalog(spark, d, "documents", "embeddings")
    both = c.get("documents").df.join(c.get("embeddings").df, F.col("doc_id") == F.col("vec_id"), "left").select(F.col("doc_id").alias("id"), "text", "embedding")
    c.register("both", both)
    return Reader(c, (QUERY,)).select(parse_one(text)).df


def _sparse(spark, d):
    c = catalog(spark, d, "orders")
    k = F.col("o_orderkey")
    s = F.struct(F.array(F.lit(0), F.lit(3), F.lit(9)).alias("idx"), F.array((k % 7).cast("float"), (k % 11).cast("float"), F.lit(1).cast("float")).alias("w"))
    c.register("orders", c.get("orders").df.withColumn("s", s), "o_orderkey")
    return Reader(c).select(parse_one("get orders select id near s '{1:2.0,4:0.5}/16' limit 15")).df


def _geo_near(spark, d):
    c = catalog(spark, d, "events")
    c.register("events", GEO["events"](c.get("events").df), "event_id", geo={"loc"})
    return Reader(c, ([13.4, 52.5],)).select(parse_one("get events select id near loc $1 limit 12")).df


def _tenants(spark, d):
    c = catalog(spark, d, "orders")
    out = {}
    for t in ("F", "O", "P"):
        part = Catalog(spark)
        part.register("orders", c.get("orders").df.filter(F.col("o_orderstatus") == t), "o_orderkey")
        out[t] = rounded(Reader(part).select(parse_one("get orders select id, o_totalprice")).df)
    return out


def _tenant_fold(spark, d):
    c = catalog(spark, d, "orders")
    parts = {}
    for t in ("F", "O", "P"):
        part = Catalog(spark)
        part.register("orders", c.get("orders").df.filter(F.col("o_orderstatus") == t), "o_orderkey")
        parts[t] = Reader(part).select(parse_one("get orders select o_orderpriority, count(*) as n, max(o_totalprice) as top group o_orderpriority")).df
    return rounded(fanout.folded(fanout.concatenated(parts), ["o_orderpriority"], {"n": "sum", "top": "max"}))


def _alive(spark, d):
    c = catalog(spark, d, "events")
    c.register("events", c.get("events").df, "event_id", ttl=("ts", 5 * 86_400_000))
    return Reader(c, now=NOW).select(parse_one("get events select id")).df


def _folder(spark) -> str:
    """Where versions and indexes go: the shared folder of the cluster; a temporary one where the session runs on one machine (tests)."""
    import tempfile
    import uuid

    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        base = tempfile.gettempdir()
    return f"{base}/tarnlight-{uuid.uuid4().hex}"


def _written(spark, d, text, answer=False):
    from .operators.writes import Database

    c = catalog(spark, d, "orders")
    db = Database(c, _folder(spark))
    out = db.run(text, now=NOW)
    return out.df if answer else db.run("get orders select id, o_custkey").df


def _upsert(spark, d):
    from .operators.writes import Database

    c = catalog(spark, d, "nation")
    c.register("counts", c.get("nation").df.selectExpr("cast(n_nationkey as bigint) as id", "n_name as key", "cast(n_regionkey as bigint) as n"), unique=(("key",),))
    db = Database(c, _folder(spark))
    names = [r[0] for r in c.get("counts").df.filter("id < 2").orderBy("id").select("key").collect()]
    page = [{"key": names[0], "n": 4}, {"key": names[1], "n": 10}, {"key": names[0], "n": 6}, {"id": 100, "key": "new", "n": 3}, {"key": "new", "n": 4}]
    db.run("put counts $1 if absent else set {n: n + new.n}", page, now=NOW)
    return db.run("get counts select id, n").df


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for name, (run, _) in Q.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in Q.items() if sql}
