"""The registered queries of the library on the star-schema tables, and the same in SQL.

Brands stand for models, part types for generations, ship years for sale years, quantities for units, and European
suppliers for the local region.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import markup, numbers, text
from ..operators import cohorts, lookups, scoring

YEARS = range(1996, 2016)
PICKED = 2010
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def sales(spark: SparkSession, d: str, local: bool = False) -> DataFrame:
    """model, generation, year, units: one row per sale year."""
    items = table(spark, d, "lineitem")
    if local:
        nations = table(spark, d, "nation").join(table(spark, d, "region").where("r_name = 'EUROPE'"), F.col("n_regionkey") == F.col("r_regionkey"))
        suppliers = table(spark, d, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey")
        items = items.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"), "left_semi")
    # quantities are summed by part before the join, which so carries a row per part and year
    per = items.groupBy("l_partkey", F.year("l_shipdate").alias("year")).agg(F.sum("l_quantity").alias("q"))
    rows = per.join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.groupBy(F.col("p_brand").alias("model"), F.col("p_type").alias("generation"), F.col("year").cast("long").alias("year")).agg(F.sum("q").cast("long").alias("units"))


_FROM = "lineitem join part on l_partkey = p_partkey"
_LOCAL = f"{_FROM} join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey and r_name = 'EUROPE'"
_SALES = lambda name, source: f"{name} as (select p_brand as model, p_type as generation, year(l_shipdate) as year, cast(sum(l_quantity) as bigint) as units from {source} group by 1, 2, 3)"
WITH = f"with {_SALES('sales', _FROM)}, {_SALES('local_sales', _LOCAL)}"


@query(f"{WITH} select 'World' as region, * from sales union all select 'EU', * from local_sales")
def union_all_regions(spark, d):
    return sales(spark, d).select(F.lit("World").alias("region"), "*").unionByName(sales(spark, d, True).select(F.lit("EU").alias("region"), "*"))


@query(f"{WITH} select model, generation, y as year, round(sum(case when y < year then 0 else units * pow(1 - 0.0556, y - year) end), 4) as stock from sales, range(1996, 2016) t(y) group by 1, 2, 3")
def cohort_fleet_projection(spark, d):
    out = cohorts.project_stock(sales(spark, d), YEARS)
    return out.select("model", "generation", F.col("year").cast("long").alias("year"), F.round("stock", 4).alias("stock"))


_STOCK = "stock as (select model, generation, y as year, sum(case when y < year then 0 else units * pow(1 - 0.0556, y - year) end) as stock from sales, range(1996, 2016) t(y) group by 1, 2, 3)"
_WIDE = lambda value, prefix: ", ".join(f"max(case when year = {y} then {value} end) as {prefix}{y}" for y in YEARS)


@query(f"{WITH}, {_STOCK} select model, generation, {_WIDE('cast(ceil(round(stock, 6)) as bigint)', 'y')} from stock group by 1, 2")
def pivot_fleet_ceil(spark, d):
    return cohorts.wide(cohorts.project_stock(sales(spark, d), YEARS), YEARS, F.ceil(F.round("stock", 6)), "y")


@query(f"{WITH}, {_STOCK} select model, generation, {_WIDE('round_even(round(stock * 0.021, 6), 0)', 'y')} from stock group by 1, 2")
def pivot_repl(spark, d):
    return cohorts.wide(cohorts.project_stock(sales(spark, d), YEARS), YEARS, F.rint(F.round(F.col("stock") * numbers.REPLACED, 6)), "y")


def _figures(units: Column, suffix: str = "") -> list[Column]:
    """Aggregates of sale years: stock and replacements in the picked year, and the years with sales; null without any."""
    stock = F.sum(numbers.decay_from_sale(units, PICKED - F.col("year")))
    named = {"future_stock": F.ceil(F.round(stock, 6)), "future_repl": F.rint(F.round(stock * numbers.REPLACED, 6)), "years_in_list": F.nullif(F.count(units), F.lit(0).cast("long"))}
    return [v.alias(k + suffix) for k, v in named.items()]


def _future(spark, d, local=False) -> DataFrame:
    """model, generation, future_stock, future_repl, years_in_list."""
    return sales(spark, d, local).groupBy("model", "generation").agg(*_figures(F.col("units")))


def _future_of_both(spark, d) -> DataFrame:
    """model, generation and the figures of the world (_w) and of the local region (_e), from one scan of the sales."""
    nations = table(spark, d, "nation").join(table(spark, d, "region").where("r_name = 'EUROPE'"), F.col("n_regionkey") == F.col("r_regionkey"))
    local = table(spark, d, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey")
    items = table(spark, d, "lineitem").join(local, F.col("l_suppkey") == F.col("s_suppkey"), "left")
    here = F.when(F.col("s_suppkey").isNotNull(), F.col("l_quantity"))
    per = items.groupBy("l_partkey", F.year("l_shipdate").alias("year")).agg(F.sum("l_quantity").alias("q"), F.sum(here).alias("here"))
    rows = per.join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    years = rows.groupBy(F.col("p_brand").alias("model"), F.col("p_type").alias("generation"), "year").agg(F.sum("q").cast("long").alias("q"), F.sum("here").cast("long").alias("here"))
    return years.groupBy("model", "generation").agg(*_figures(F.col("q"), "_w"), *_figures(F.col("here"), "_e"))


_FUTURE = lambda name, of: f"{name} as (select model, generation, cast(ceil(round(sum(units * pow(1 - 0.0556, 2010 - year)), 6)) as bigint) as future_stock, round_even(round(sum(units * pow(1 - 0.0556, 2010 - year)) * 0.021, 6), 0) as future_repl, count(*) as years_in_list from {of} group by 1, 2)"
WITH2 = f"{WITH}, {_FUTURE('world', 'sales')}, {_FUTURE('loc', 'local_sales')}"


@query(f"{WITH2} select * from world")
def region_opportunities(spark, d):
    return _future(spark, d)


@query(f"{WITH2} select a.model, a.generation, a.future_stock as stock_w, b.future_stock as stock_e from world a join loc b using (model, generation)")
def join_inner_suffix(spark, d):
    a, b = _future(spark, d), _future(spark, d, True)
    return a.select("model", "generation", F.col("future_stock").alias("stock_w")).join(b.select("model", "generation", F.col("future_stock").alias("stock_e")), ["model", "generation"])


_COMBINED = """both_ as (select coalesce(w.model, e.model) as model, coalesce(w.generation, e.generation) as generation,
  coalesce(w.future_stock, e.future_stock, 0) as future_stock, coalesce(w.future_repl, e.future_repl, 0) as future_repl,
  case when w.years_in_list is not null then greatest(w.years_in_list, coalesce(e.years_in_list, 0)) end as years_in_list
  from world w full outer join loc e on w.model = e.model and w.generation = e.generation)"""


@query(f"{WITH2}, {_COMBINED} select * from both_")
def join_full_outer_combine(spark, d):
    return scoring.combine_regions(_future(spark, d), _future(spark, d, True))


def _flags(rows: DataFrame) -> DataFrame:
    n = F.regexp_extract("model", "([0-9]+)$", 1).cast("int")
    return rows.withColumn("supported", n % 3 == 0).withColumn("ev", n % 2 == 0)


def _score_sql(source: str) -> str:
    pct = lambda c, name: f"case when {c} is not null then round_even(least(greatest((rank() over (partition by {c} is not null order by {c}) + (count(*) over (partition by {c}) - 1) / 2.0) / count({c}) over () * 20, 0), 20), 0) end as {name}"
    return f"""n as (select *, cast(regexp_extract(model, '([0-9]+)$', 1) as int) as k from {source}),
    g as (select n.*, (select count(distinct generation) from n m where m.model = n.model) as gen_count from n),
    s as (select *, {pct('future_stock', 'stock_score')}, {pct('future_repl', 'repl_score')}, {pct('years_in_list', 'years_score')}, {pct('gen_count', 'gen_score')}, case when k % 3 = 0 then 20.0 else 10.0 end as supported_score, case when k % 2 = 0 then 10.0 else 20.0 end as ev_score from g),
    t as (select *, coalesce(stock_score, 0) + coalesce(repl_score, 0) + coalesce(years_score, 0) + coalesce(gen_score, 0) + supported_score + ev_score as score from s)
    select model, generation, cast(future_stock as bigint) as future_stock, cast(score as double) as score, case when score >= 80 then 'Top priority' when score >= 60 then 'High' when score >= 40 then 'Medium' else 'Low' end as recommendation from t"""


_SHOWN = ("model", "generation", "future_stock", "score", "recommendation")


@query(f"{WITH2}, {_score_sql('world')}")
def opportunity_scores(spark, d):
    return scoring.opportunity_scores(_flags(_future(spark, d))).select(*_SHOWN)


@query(f"{WITH2}, {_COMBINED}, {_score_sql('both_')}")
def combined_opportunities(spark, d):
    both = scoring.preferred(_future_of_both(spark, d))
    return scoring.opportunity_scores(_flags(both)).select(*_SHOWN)


FLAGSHIP = "combined_opportunities"


@query(f"{WITH} select model, generation, count(*) as years from sales group by 1, 2")
def appearance_count(spark, d):
    return sales(spark, d).groupBy("model", "generation").agg(F.count("*").alias("years"))


@query("select p_brand as model, count(distinct p_type) as generations from part group by 1")
def count_distinct_gen(spark, d):
    return table(spark, d, "part").groupBy(F.col("p_brand").alias("model")).agg(F.countDistinct("p_type").alias("generations"))


@query("select p_brand as model from part union select p_type from part")
def union_distinct_models(spark, d):
    part = table(spark, d, "part")
    return part.select(F.col("p_brand").alias("model")).union(part.select("p_type")).distinct()


@query(f"{WITH} select a.model, a.generation, a.year, cast(trunc(avg(b.units)) as bigint) as prior from sales a join sales b on a.model = b.model and a.generation <> b.generation and b.year between a.year - 3 and a.year - 1 group by 1, 2, 3")
def prior_avg_lookback(spark, d):
    rows = sales(spark, d)
    # each row goes to the three years that look back on it
    ahead = rows.select("model", F.col("generation").alias("g"), F.explode(F.transform(F.sequence(F.lit(1), F.lit(3)), lambda k: F.col("year") + k)).alias("year"), "units")
    return rows.select("model", "generation", "year").join(ahead, ["model", "year"]).where("generation <> g").groupBy("model", "generation", "year").agg(F.avg("units").cast("long").alias("prior"))


@query(f"{WITH} select model, generation, year, row_number() over (partition by year order by units desc, model, generation) as position from sales")
def rank_in_year(spark, d):
    from pyspark.sql import Window

    return sales(spark, d).select("model", "generation", "year", F.row_number().over(Window.partitionBy("year").orderBy(F.desc("units"), "model", "generation")).cast("long").alias("position"))


@query(f"{WITH}, p as (select model, year, sum(units) as units from sales group by 1, 2), f as (select t.model, t.year, sum(s.units * case when t.year - s.year <= 1 then 1 else pow(1 - 0.0556, t.year - s.year - 1) end) as x from p t join p s on s.model = t.model and s.year <= t.year group by 1, 2) select model, year, cast(round_even(x, 0) as bigint) as stock, cast(round_even(x * 0.021, 0) as bigint) as repairs from f")
def triangular_fleet(spark, d):
    return cohorts.triangular_stock(sales(spark, d))


@query(f"""with recursive {_SALES('sales', _FROM)}, r as (select model, year, sum(units) as raw, row_number() over (partition by model order by year) as n from sales group by 1, 2),
  c as (select model, year, cast(raw as bigint) as raw, n, cast(raw as bigint) as smoothed from r where n = 1
  union all select r.model, r.year, cast(r.raw as bigint), r.n, cast(trunc(greatest(0.6::double * round_even(c.smoothed * (1 + case when c.n = 1 then 0.35::double when c.n <= 3 then 0.12::double when c.n <= 5 then 0.05::double else -0.08::double end), 0) + 0.4::double * r.raw, 0)) as bigint) from c join r on r.model = c.model and r.n = c.n + 1)
  select model, year, raw, smoothed from c""")
def lifecycle_smooth(spark, d):
    rows = sales(spark, d).groupBy("model", "year").agg(F.sum("units").alias("raw"))
    return cohorts.smooth_lifecycle(rows)


@query("select c.c_custkey, c.at, o.o_orderkey as last_order from (select c_custkey, timestamp '1998-01-01' as at from customer) c left join (select o_custkey, o_orderdate, max(o_orderkey) as o_orderkey from orders group by 1, 2) o on o.o_custkey = c.c_custkey and o.o_orderdate = (select max(o_orderdate) from orders x where x.o_custkey = c.c_custkey and x.o_orderdate <= c.at)")
def asof_support(spark, d):
    left = table(spark, d, "customer").select("c_custkey", F.lit("1998-01-01 00:00:00").cast("timestamp_ntz").alias("at"))
    right = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderdate").alias("since"), F.col("o_orderkey").alias("last_order"))
    return lookups.as_of(left, right, "c_custkey", "at", "since", "last_order")


_WINDOWS = "w as (select p_brand as model, p_type as label, min(p_size) + 1990 as s, min(p_size) + 1990 + count(*) % 9 as e from part group by 1, 2)"


def _windows(spark, d) -> DataFrame:
    g = table(spark, d, "part").groupBy(F.col("p_brand").alias("model"), F.col("p_type").alias("label")).agg((F.min("p_size") + 1990).cast("long").alias("start"), F.count("*").alias("n"))
    return g.select("model", "label", "start", (F.col("start") + F.col("n") % 9).alias("end"))


@query(f"{WITH}, {_WINDOWS}, x as (select m.model, m.year, w.label, row_number() over (partition by m.model, m.year order by greatest(w.s - m.year, m.year - w.e, 0), case when m.year between w.s and w.e then w.e - w.s else 0 end, w.s desc, w.label) as n from (select distinct model, year from sales) m join w on w.model = m.model) select model, year, label from x where n = 1")
def interval_pick_window(spark, d):
    years = sales(spark, d).select("model", "year").distinct()
    return lookups.pick_window(years, _windows(spark, d), "model", "year").select("model", "year", "label")


@query(f"with {_WINDOWS} select model, label, s as start, coalesce(lead(s) over (partition by model order by s, label) - 1, null) as \"end\" from w")
def lead_infer_end(spark, d):
    rows = _windows(spark, d).withColumn("end", F.lit(None).cast("long"))
    return lookups.next_start_as_end(rows, "model").select("model", "label", "start", "end")


@query("select user_id, event_type, max_by(value, event_id) as value from events group by 1, 2")
def dedup_last_wins(spark, d):
    return lookups.last_wins(table(spark, d, "events").select("user_id", "event_type", "value", "event_id"), ["user_id", "event_type"], "event_id").select("user_id", "event_type", "value")


@query("select user_id, event_type, min_by(value, event_id) as value from events group by 1, 2")
def dedup_first_wins(spark, d):
    return lookups.first_wins(table(spark, d, "events").select("user_id", "event_type", "value", "event_id"), ["user_id", "event_type"], "event_id").select("user_id", "event_type", "value")


@query("select event_type, min(event_id) as first_id from events group by 1 order by 2 limit 10")
def first_seen_distinct(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.min("event_id").alias("first_id")).orderBy("first_id").limit(10)


@query("select event_type, max_by(user_id, struct_pack(ts := ts, event_id := event_id)) as user_id from events group by 1")
def latest_by(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.max_by("user_id", F.struct("ts", "event_id")).alias("user_id"))


@query("with p as (select user_id, event_type, count(*) as n from events group by 1, 2), q as (select *, sum(n) over (partition by user_id) as total from p) select user_id, event_type, total as \"of\" from q where n >= 0.3 * total qualify row_number() over (partition by user_id order by n desc, event_type desc) = 1")
def dominant_label(spark, d):
    out = lookups.dominant(table(spark, d, "events"), "user_id", "event_type", 0.3)
    return out.select("user_id", "event_type", F.col("of").cast("long").alias("of"))


@query("select user_id, bool_or(value > 99) as high, bool_or(event_type = 'error') as error from events group by 1")
def signal_any(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.bool_or(F.col("value") > 99).alias("high"), F.bool_or(F.col("event_type") == "error").alias("error"))


@query("with o as (select c_custkey as k, c_name as name, c_acctbal as bal from customer where c_custkey % 3 > 0), n as (select c_custkey as k, c_name as name, -c_acctbal as bal from customer where c_custkey % 3 < 2) select coalesce(n.k, o.k) as k, coalesce(n.bal, o.bal) as bal, o.name from o full outer join n on o.k = n.k")
def upsert_merge(spark, d):
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("bal"), F.col("c_name").alias("name"))
    return lookups.merge_upsert(rows.where("k % 3 > 0"), rows.where("k % 3 < 2").withColumn("bal", -F.col("bal")), "k", ["bal"])


@query("select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'P' and o_orderpriority < '3')")
def cache_miss_antijoin(spark, d):
    held = table(spark, d, "orders").where("o_orderstatus = 'P' and o_orderpriority < '3'")
    return table(spark, d, "customer").join(held, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("select o_orderkey from orders where o_custkey in (select c_custkey from customer where c_mktsegment = 'AUTOMOBILE')")
def semi_join_supported(spark, d):
    some = table(spark, d, "customer").where("c_mktsegment = 'AUTOMOBILE'")
    return table(spark, d, "orders").join(some, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey")


@query("select c_custkey, coalesce(n, 0) as orders from customer left join (select o_custkey, count(*) as n from orders group by 1) on o_custkey = c_custkey")
def join_left_default(spark, d):
    per = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return table(spark, d, "customer").join(per, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("orders"))


@query(f"{WITH} select m.model, y as year from (select distinct model from local_sales) m, range(1990, 2006) t(y) where not exists (select 1 from local_sales s where s.model = m.model and s.year = y)")
def except_missing_years(spark, d):
    return lookups.missing_years(sales(spark, d, True), "model", F.transform(F.sequence(F.lit(1990), F.lit(2005)), lambda y: y.cast("long")))


@query(f"{WITH}, m as (select m.model, y as year from (select distinct model from local_sales) m, range(1990, 2006) t(y)) select m.model, m.year, cast(coalesce(sum(s.units), 0) as bigint) as units from m left join local_sales s on s.model = m.model and s.year = m.year group by 1, 2")
def gap_fill_antijoin(spark, d):
    rows = sales(spark, d, True).groupBy("model", "year").agg(F.sum("units").alias("units")).where("year between 1990 and 2005")
    filler = lookups.missing_years(rows, "model", F.transform(F.sequence(F.lit(1990), F.lit(2005)), lambda y: y.cast("long"))).withColumn("units", F.lit(0).cast("long"))
    return rows.unionByName(filler)


@query("select c_custkey, trim(regexp_replace(regexp_replace(lower(c_name), '[/-]', ' ', 'g'), '[^a-z0-9\\s]', ' ', 'g')) as key from customer")
def normalize_name(spark, d):
    return table(spark, d, "customer").select("c_custkey", text.normalize_name(F.col("c_name")).alias("key"))


@query("with x as (select p_partkey, p_size from part) select p_partkey, case when p_size between 1 and 20 then ['I','II','III','IV','V','VI','VII','VIII','IX','X','XI','XII','XIII','XIV','XV','XVI','XVII','XVIII','XIX','XX'][p_size] else cast(p_size as varchar) end as roman, case when p_size between 1 and 20 then cast(p_size as bigint) end as back from x")
def roman_numeral(spark, d):
    roman = text.roman_numeral(F.col("p_size"))
    return table(spark, d, "part").select("p_partkey", roman.alias("roman"), text.roman_value(roman).cast("long").alias("back"))


@query("select p_partkey, case when p_size % 4 = 0 then 'I' when p_size % 4 = 1 then ['I','II','III','IV','V','VI','VII','VIII','IX','X','XI','XII','XIII'][p_size // 4 + 1] when p_size % 4 = 2 then ['I','II','III','IV','V','VI','VII','VIII','IX','X','XI','XII','XIII'][p_size // 4 + 1] else p_type || ' F' end as label from part")
def normalize_generation_label(spark, d):
    n = F.floor(F.col("p_size") / 4) + 1
    label = F.when(F.col("p_size") % 4 == 0, "Unknown").when(F.col("p_size") % 4 == 1, F.concat(F.lit("Mk"), n.cast("string"), F.lit(" (2007)"))).when(F.col("p_size") % 4 == 2, n.cast("string")).otherwise(F.concat("p_type", F.lit(" F")))
    return table(spark, d, "part").select("p_partkey", text.normalize_generation_label(label).alias("label"))


@query("select p_partkey, split_part(p_name, ' ', 1) as brand, case when strpos(p_name, ' ') > 0 then substr(p_name, strpos(p_name, ' ') + 1) else p_name end as base from part")
def brand_split(spark, d):
    brand, base = text.brand_and_base(F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", brand.alias("brand"), base.alias("base"))


@query("select page_id, case when x = '' then 'untitled' else x end as slug from (select page_id, substr(trim(regexp_replace(regexp_replace(regexp_replace(url || '/_', '[/\\\\]', '-', 'g'), '[^A-Za-z0-9 ._-]', '', 'g') || ' ', '\\s+', '_', 'g'), '_'), 1, 80) as x from pages)")
def safe_slug(spark, d):
    return table(spark, d, "pages").select("page_id", text.safe_slug(F.concat("url", F.lit("/_ "))).alias("slug"))


@query("select doc_id, regexp_matches(lower(text), 'license|copyright|token') as hit, contains(text, '@') as has_at from documents")
def keyword_filter(spark, d):
    return table(spark, d, "documents").select("doc_id", F.rlike(F.lower("text"), F.lit("license|copyright|token")).alias("hit"), F.contains("text", F.lit("@")).alias("has_at"))


@query("select doc_id, len(text) - len(replace(text, ' ', '')) as spaces, sha256(trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))) as collapsed from documents")
def collapse_ws(spark, d):
    return table(spark, d, "documents").select("doc_id", (F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit("")))).cast("long").alias("spaces"), F.sha2(text.collapse_ws(F.col("text")), 256).alias("collapsed"))


@query()
def regex_extract_numbers(spark, d):
    """Look-behind has no equal in the oracle's dialect; a test holds it against a plain loop."""
    found = text.candidate_numbers(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(found).cast("long").alias("n"), F.array_max(found).alias("most"))


@query("select page_id, len(regexp_extract_all(html, '(?is)<h[1-4][^>]*>(.*?)</h[1-4]>', 1)) as n from pages")
def html_headings(spark, d):
    return table(spark, d, "pages").select("page_id", F.size(markup.headings(F.col("html"))).cast("long").alias("n"))


@query("select page_id, trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&'), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), ' ') as visible from pages")
def html_text(spark, d):
    return table(spark, d, "pages").select("page_id", markup.stripped(F.col("html")).alias("visible"))


@query("select event_id, try_cast(json_extract_string(props, '$.k') as bigint) as k, json_extract_string(props, '$.missing') as missing from events")
def json_extract(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"), F.get_json_object("props", "$.missing").alias("missing"))


@query("select user_id, count(*) as n, list_aggregate(list_sort(list(event_id)), 'string_agg', ',') as ids from events group by 1")
def nest_unnest(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("event_id")).alias("x")).select("user_id", "n", F.array_join(F.transform("x", lambda e: e.cast("string")), ",").alias("ids"))


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 10")
def topn_preview(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10)


@query("select s_suppkey, coalesce(try_cast(s_name as double), 0) as n, least(greatest(s_acctbal, 0), 5000) as held, case when s_acctbal >= 8000 then 'Top priority' when s_acctbal >= 6000 then 'High' when s_acctbal >= 4000 then 'Medium' else 'Low' end as tier from supplier")
def clamp_cap(spark, d):
    balance = F.col("s_acctbal")
    return table(spark, d, "supplier").select("s_suppkey", F.coalesce(F.col("s_name").try_cast("double"), F.lit(0.0)).alias("n"), numbers.clamp(balance, F.lit(0.0), F.lit(5000.0)).alias("held"), numbers.tier(balance / 100).alias("tier"))


@query(f"{WITH}, x as (select model, year, sum(units) as u from local_sales group by 1, 2) select model, year, cast(least(greatest(ceil(u / 0.4::double), u), 3000000) as bigint) as low, cast(least(greatest(floor(u / 0.1::double), u), 3000000) as bigint) as high from x")
def share_bounds(spark, d):
    rows = sales(spark, d, True).groupBy("model", "year").agg(F.sum("units").alias("u"))
    low, high = numbers.world_bounds(F.col("u"), F.lit(0.1), F.lit(0.4))
    return rows.select("model", "year", low.alias("low"), high.alias("high"))


@query()
def fuzzy_best_match(spark, d):
    """Block-matching similarity is beyond SQL; a test holds it against a plain loop."""
    keys = table(spark, d, "part").select(text.normalize_name(F.col("p_name")).alias("key")).distinct()
    queries = keys.select(F.concat(F.col("key"), F.lit("x")).alias("query"))
    return lookups.best_match(queries, keys)
