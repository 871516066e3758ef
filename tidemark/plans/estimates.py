"""Queries of an estimate: history, constraints, smoothing, support, regions, and its documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import documents, enforcement, estimates, estimation, evidence, lookups, regions, support
from ..sources import sales_lists
from .queries import _STOCK, WITH, YEARS, _SALES, _FROM, _LOCAL, query, sales, table

_K = "cast(substr(model, 7) as int)"


def _number(model: str = "model"):
    return F.substring(model, 7, 9).cast("int")


@query("""with europe as (select s_suppkey from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey where r_name = 'EUROPE'),
  r as (select case when s_suppkey is not null then 'EU' else 'World' end as region, p_name || case when l_linenumber % 2 = 0 then '/X' else '-x' end as model, p_type as generation, year(l_shipdate) as year,
    case when l_discount >= 0.02 then cast(l_quantity as bigint) end as units, l_linestatus = 'O' as estimated, l_orderkey as f, l_linenumber as n
  from lineitem join part on l_partkey = p_partkey left join europe on l_suppkey = s_suppkey)
  select region, lower(replace(replace(model, '/', ' '), '-', ' ')) as key, year, model, generation, units, estimated from r where units is not null
  qualify row_number() over (partition by region, lower(replace(replace(model, '/', ' '), '-', ' ')), year order by f desc, n desc, model desc, generation desc, units desc, estimated desc) = 1""")
def keyed_history(spark, d):
    """The last record of each key and year; an order stands for a file, a line for a record's number in it."""
    nations = table(spark, d, "nation").join(table(spark, d, "region").where("r_name = 'EUROPE'"), F.col("n_regionkey") == F.col("r_regionkey"))
    here = table(spark, d, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey")
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).join(here, F.col("l_suppkey") == F.col("s_suppkey"), "left")
    model = F.concat("p_name", F.when(F.col("l_linenumber") % 2 == 0, "/X").otherwise("-x"))
    records = rows.select(
        F.lpad(F.col("l_orderkey").cast("string"), 20, "0").alias("file"), F.col("l_linenumber").alias("record"), F.when(F.col("s_suppkey").isNotNull(), "EU").otherwise("World").alias("region"),
        F.year("l_shipdate").cast("long").alias("year"), model.alias("model"), F.col("p_type").alias("generation"), F.when(F.col("l_discount") >= 0.02, F.col("l_quantity").cast("long")).alias("units"), (F.col("l_linestatus") == "O").alias("estimated"),
    )
    return sales_lists.keyed_history(records, ("file", "record", "model", "generation", "units", "estimated"))


def _yearly(spark, d) -> DataFrame:
    """model, year, world, europe, without every fifth year."""
    world = sales(spark, d).groupBy("model", "year").agg(F.sum("units").alias("world"))
    europe = sales(spark, d, True).groupBy("model", "year").agg(F.sum("units").alias("europe"))
    return world.join(europe, ["model", "year"], "left").where("year % 5 <> 4").withColumn("rationale", F.lit("seen"))


def _enforced(spark, d) -> DataFrame:
    rows = _yearly(spark, d)
    k = _number()
    models = rows.select("model").distinct()
    windows = models.select("model", (k % 2 + 1996).alias("start"), (k % 4 + 1994).alias("first"), (k % 3 + 1999).alias("final"))
    limit = lambda region, kind, low, high, precedence, when: F.when(when, F.struct(F.lit(region).alias("region"), F.lit(kind).alias("kind"), (k % 2 + 1996).alias("year"), low.alias("low"), high.alias("high"), F.lit(precedence).alias("precedence")))
    held = F.array(
        limit("europe", "exact", k + 1000, k + 1000, 1, k % 3 == 0), limit("europe", "exact", F.lit(7), F.lit(7), 2, k % 2 == 0),
        limit("world", "exact", F.lit(300), F.lit(300), 1, k % 4 == 0), limit("world", "range", F.lit(800), F.lit(1500), 1, k % 5 < 3),
    )
    limits = models.select("model", F.explode(F.array_compact(held)).alias("l")).select("model", "l.*")
    return enforcement.enforce(rows, windows, limits)


_ENFORCED = f"""{_SALES('sales', _FROM)}, {_SALES('local_sales', _LOCAL)},
  yw as (select model, year, cast(sum(units) as bigint) as w from sales where year % 5 <> 4 group by 1, 2), ye as (select model, year, cast(sum(units) as bigint) as e from local_sales group by 1, 2),
  m as (select distinct model, {_K} as k, 1996 + {_K} % 2 as s from yw),
  g as (select model, k, s, unnest(range(s, 2036)) as year from m union all select m.model, k, s, yw.year from m join yw using (model) where yw.year < s),
  j as (select g.*, w, e, yw.model is not null as seen, case when g.year = s then case when k % 3 = 0 then 1000 + k when k % 2 = 0 then 7 end end as ex, case when g.year = s and k % 4 = 0 then 300 end as wx, g.year = s and k % 5 < 3 as band
    from g left join yw on g.model = yw.model and g.year = yw.year left join ye on g.model = ye.model and g.year = ye.year and yw.model is not null),
  j2 as (select *, coalesce(ex, e, 0) as eu, coalesce(w, 0) as w0 from j),
  j3 as (select *, case when year = s then greatest(coalesce(wx, case when band then least(greatest(w0, greatest(800, eu)), greatest(1500, greatest(800, eu))) else w0 end), eu) else w0 end as wo, year >= s and year not between 1994 + k % 4 and 1999 + k % 3 as outside from j2),
  held as (select model, year, s, cast(case when outside and ex is null and wx is null then 0 else wo end as bigint) as world, cast(case when outside and ex is null and wx is null then 0 else eu end as bigint) as europe, outside,
    trim(concat_ws(' ', case when seen then 'seen' when year <> s then 'Filled by client.' end, case when ex is not null then 'Europe start fixed.' end, case when wx is not null then 'World start fixed.' end, case when outside and ex is null and wx is null then 'Outside generation window -> zero.' end)) as rationale from j3)"""


@query(f"with {_ENFORCED} select model, cast(year as bigint) as year, world, europe, rationale, outside as zero from held")
def enforce_constraints(spark, d):
    """Start row, exact values over ranges, Europe within the world, filled years, and zero years but for protected ones."""
    return _enforced(spark, d).withColumn("year", F.col("year").cast("long"))


_GROWN = "case when c.n = 1 then 0.35::double when c.n <= 3 then 0.12::double when c.n <= 5 then 0.05::double else -0.08::double end"
_MIXED = lambda c: f"cast(case when r.outside then 0 else trunc(greatest(0.6::double * round_even(c.{c} * (1 + {_GROWN}), 0) + 0.4::double * r.{c}, 0)) end as bigint)"


@query(f"""with recursive {_ENFORCED}, r as (select * from held where year >= s),
  c as (select model, year, world, europe, 1 as n from r where year = s
    union all select r.model, r.year, {_MIXED('world')}, {_MIXED('europe')}, c.n + 1 from c join r on r.model = c.model and r.year = c.year + 1)
  select model, cast(year as bigint) as year, least(world, 3000) as world, least(europe, least(world, 3000)) as europe from c""")
def smooth_coupled(spark, d):
    """The enforced rows smoothed, both series in one fold; the world capped and Europe kept to it."""
    rows = _enforced(spark, d)
    start = _number() % 2 + 1996
    out = enforcement.smooth_pair(rows.where(F.col("year") >= start), cap=3000)
    return out.withColumn("year", F.col("year").cast("long"))


_BOTH = ", ".join([f"max(case when year = {y} then cast(ceil(round(stock, 6)) as bigint) end) as \"{y}_fleet\"" for y in YEARS] + [f"max(case when year = {y} then round_even(round(stock * 0.021, 6), 0) end) as \"{y}_repl\"" for y in YEARS])


@query(f"{WITH}, {_STOCK}, a as (select model, generation, count(*) as years_in_list from sales group by 1, 2), p as (select model, generation, {_BOTH} from stock group by 1, 2) select p.*, years_in_list from p join a using (model, generation)")
def region_outputs(spark, d):
    """Twenty years of two measures and the years in the list, from one aggregate."""
    return regions.wide_measures(sales(spark, d), YEARS)


@query("""with asked as (select p_partkey, lower(replace(p_brand, '#', ' ')) as key, 1990 + p_size as year, p_type as generation from part),
  known as (select lower(replace(p_brand, '#', ' ')) as key, 2000 + p_size % 7 * 4 as from_year, max(case when p_size % 2 = 0 then p_type else lower(p_type) end) as code
    from part where cast(substr(p_brand, 7) as int) % 5 <> 0 and p_size < 30 and p_type <> 'ECONOMY' group by 1, 2),
  found as (select a.*, k.code, k.from_year from asked a asof left join known k on a.key = k.key and a.year >= k.from_year)
  select p_partkey, key, cast(year as bigint) as year, generation, code is not null as supported, code, cast(from_year as bigint) as from_year,
    case when code is not null then case when lower(code) = lower(generation) then 'by_year_exact_gen' else 'by_year_diff_gen_label' end when key in (select key from known) then 'model_present_no_year_coverage' else 'no_model_match' end as match_type from found""")
def support_outcomes(spark, d):
    part = table(spark, d, "part")
    key = text.normalize_name(F.col("p_brand")).alias("key")
    asked = part.select("p_partkey", key, (F.col("p_size") + 1990).cast("long").alias("year"), F.col("p_type").alias("generation"))
    code = F.when(F.col("p_size") % 2 == 0, F.col("p_type")).otherwise(F.lower("p_type"))
    known = part.where((_number("p_brand") % 5 != 0) & (F.col("p_size") < 30) & (F.col("p_type") != "ECONOMY")).select(key, (F.col("p_size") % 7 * 4 + 2000).cast("long").alias("from_year"), code.alias("code"))
    return support.support(asked, known)


@query("select p_partkey, case when model is null then 'unknown' else 'x' end as nothing, 'false' as supported, 'no_model_match' as match_type from (select p_partkey, p_brand as model from part where p_type = 'SMALL') union all select p_partkey, 'x', 'true', 'model_present_diff_gen_no_year_map' from part where p_type <> 'SMALL' and p_brand in (select p_brand from part where p_type = 'LARGE') union all select p_partkey, 'x', 'false', 'no_model_match' from part where p_type <> 'SMALL' and p_brand not in (select p_brand from part where p_type = 'LARGE')")
def support_by_table(spark, d):
    """A table of models without years; the models of one type are asked for under another name."""
    part = table(spark, d, "part")
    asked = part.select("p_partkey", F.lit("x").alias("nothing"), F.when(F.col("p_type") == "SMALL", text.normalize_name(F.concat("p_brand", F.lit(" s")))).otherwise(text.normalize_name(F.col("p_brand"))).alias("key"))
    return support.support_by_table(asked, part.where("p_type = 'LARGE'").select(F.col("p_brand").alias("Model"))).drop("key")


@query("""select o_orderkey, o_orderpriority as "Model", o_orderstatus as "Generation_Input_or_Detected", cast(1990 + o_custkey % 20 as bigint) as "Generation_Window_Start", cast(case when o_custkey % 3 > 0 then 2010 end as bigint) as "Generation_Window_End",
  'page_fixed' as "Generation_Window_Basis", case when o_custkey % 5 = 0 then 'vii' end as "Generation_Alias_Used", o_orderpriority || ' ' || o_orderstatus as "Generation_Context_From_Model", cast(year(o_orderdate) as bigint) as "Start_Year", cast(2035 as bigint) as "End_Year",
  case when o_totalprice > 200000 then 'high' else 'low' end as "Confidence", o_custkey % 4 = 0 as "Plausibility_Flag", case when o_custkey % 4 = 0 then 'small' else '' end as "Plausibility_Reason", case when o_custkey % 4 = 0 then 'web' else '' end as "Seed_Source_Note",
  cast(o_custkey % 2 = 0 as varchar) as "Catalogue_Supported", 'by_year_exact_gen' as "Catalogue_Match_Type", '{"k":' || coalesce(json_extract_string(props, '$.k'), '0') || '}' as "Catalogue_Matched_Row", case when o_custkey % 6 = 0 then 'golf' end as "Parent_Model_Key", case when o_custkey % 6 = 0 then 'prior-mid' end as "Variant_Derivation_Mode",
  case when o_custkey % 6 = 0 then '[0.15,0.25,0.35]' end as "Variant_EU_Prior_LMH", case when o_custkey % 6 = 0 then '[0.12,0.22,0.32]' end as "Variant_World_Prior_LMH", case when o_custkey % 6 = 0 then 'EU seed missing, World seed missing' else '' end as "Variant_Reasons"
  from orders left join events on event_id = o_orderkey""")
def estimate_summary(spark, d):
    """The summary row of each estimate's document; orders and events stand for its parts."""
    rows = table(spark, d, "orders").join(table(spark, d, "events").select(F.col("event_id").alias("o_orderkey"), "props"), "o_orderkey", "left")
    c, when = F.col("o_custkey"), lambda hit, v: F.when(hit, F.lit(v))
    derived = F.when(c % 6 == 0, F.struct(
        F.lit("golf").alias("parent_model_key"), F.lit("prior-mid").alias("mode"), F.array(*map(F.lit, (0.15, 0.25, 0.35))).alias("eu_prior_low_mid_high"),
        F.array(*map(F.lit, (0.12, 0.22, 0.32))).alias("world_prior_low_mid_high"), F.array(F.lit("EU seed missing"), F.lit("World seed missing")).alias("reasons"),
    ))
    seed = F.struct(
        F.col("o_orderstatus").alias("generation"), F.struct((c % 20 + 1990).alias("start"), when(c % 3 > 0, 2010).alias("end")).alias("generation_window"), F.lit("page_fixed").alias("generation_window_basis"),
        when(c % 5 == 0, "vii").alias("generation_alias_used"), derived.alias("variant_derivation_note"),
    )
    data = F.struct(F.col("o_orderpriority").alias("model"), F.concat_ws(" ", "o_orderpriority", "o_orderstatus").alias("generation_or_trim_context"), F.year("o_orderdate").alias("start_year"), F.lit(2035).alias("end_year"), F.when(F.col("o_totalprice") > 200000, "high").otherwise("low").alias("confidence"))
    plausible = F.when(c % 4 == 0, F.struct(F.lit(True).alias("flag"), F.lit("small").alias("reason"), F.lit("web").alias("source_note")))
    row = F.struct(F.coalesce(F.get_json_object("props", "$.k").cast("int"), F.lit(0)).alias("k"))
    diag = F.struct(plausible.alias("plausibility"), (c % 2 == 0).alias("supported_flag"), F.lit("by_year_exact_gen").alias("match_type"), row.alias("matched_row"))
    written = rows.select("o_orderkey", F.to_json(F.struct(data.alias("data"), seed.alias("seed"), diag.alias("diag"))).alias("body"))
    return written.select("o_orderkey", *documents.summary(F.col("body")))


@query("""with e as (select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events)
  select event_id, case when event_id % 9 > 0 then 2005::bigint end as year, case when event_id % 9 > 0 then k + 1 end as value, case when event_id % 9 > 0 then '2003: ' || (k - 1) || '-' || (k + 4) end as band, case when event_id % 9 > 0 then 2::bigint end as zeros, case when event_id % 9 > 0 then true end as same from e""")
def constraint_documents(spark, d):
    """Typed maps from JSON text, their first entries by key, and the same document written and read again."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    n = lambda x: x.cast("string")
    body = F.concat(
        F.lit('{"europe": {"exact": {"2010": '), n(k), F.lit(', "2005": '), n(k + 1), F.lit('}, "range": {}}, "world": {"range": {"2012": {"lo": 1, "hi": 2}, "2003": {"hi": '), n(k + 4), F.lit(', "lo": '), n(k - 1),
        F.lit('}}}, "zero_years": [1990, 2031], "more": {"x": [1]}}'),
    )
    broken = F.when(F.col("event_id") % 9 == 0, F.substring(body, 1, 20)).otherwise(body)
    rows = table(spark, d, "events").select("event_id", broken.alias("body")).select("event_id", documents.constraints_of(F.col("body")).alias("c"))
    shown = lambda c: F.to_json(c)
    again = documents.constraints_of(shown(F.col("c")))
    first = documents.first_entry(F.col("c.europe.exact"))
    known = F.col("c.zero_years").isNotNull()
    return rows.select(
        "event_id", first["key"].cast("long").alias("year"), first["value"].alias("value"), documents.range_text(F.col("c.world.range")).alias("band"),
        F.when(known, F.size("c.zero_years").cast("long")).alias("zeros"), F.when(known, shown(again) == shown(F.col("c"))).alias("same"),
    )


# Endings that make a variant, what it is called, and its shares (fixed values).
_VARIANTS = (
    (" S60", "performance/s", (0.05, 0.10, 0.18), (0.04, 0.09, 0.16)), (" m 3", "performance/m", (0.06, 0.12, 0.20), (0.05, 0.11, 0.18)), (" Type R", "performance/perf", (0.05, 0.10, 0.18), (0.04, 0.09, 0.16)),
    (" Estate", "body_style/wagon", (0.20, 0.30, 0.40), (0.18, 0.28, 0.36)), (" Shooting Brake", "body_style/shooting_brake", (0.18, 0.28, 0.38), (0.16, 0.26, 0.36)), ("-AMG Coupe", "performance/amg", (0.06, 0.12, 0.20), (0.05, 0.11, 0.18)),
    (" Sedan", "base", (0.15, 0.25, 0.35), (0.12, 0.22, 0.32)), (" RS 6 Avant", "performance/rs", (0.06, 0.12, 0.20), (0.05, 0.11, 0.18)), (" Spyder", "body_style/cabrio", (0.06, 0.12, 0.18), (0.05, 0.10, 0.15)),
    (" hatchback", "body_style/hatchback", (0.25, 0.35, 0.45), (0.22, 0.32, 0.42)),
)


def _variants(spark, d) -> DataFrame:
    ending = F.get(F.array(*[F.lit(v[0]) for v in _VARIANTS]), F.col("p_size") % len(_VARIANTS))
    return table(spark, d, "part").select("p_partkey", "p_name", F.concat("p_name", ending).alias("name"))


_PICK = lambda values: f"[{', '.join(values)}][p_size % {len(_VARIANTS)} + 1]"


@query(f"select p_partkey, {_PICK([chr(39) + v[1] + chr(39) for v in _VARIANTS])} as variant from part")
def variant_rules(spark, d):
    return _variants(spark, d).select("p_partkey", text.classify_variant(text.normalize_name(F.col("name"))).alias("variant"))


@query(f"select p_partkey, {', '.join(f'{_PICK([f'{v[i][j]}::double' for v in _VARIANTS])} as {r}_{s}' for i, r in ((2, 'eu'), (3, 'world')) for j, s in enumerate(('low', 'mid', 'high')))} from part")
def variant_share_priors(spark, d):
    p = estimates.share_priors(text.classify_variant(text.normalize_name(F.col("name"))))
    return _variants(spark, d).select("p_partkey", *[p[r][s].alias(f"{r}_{s}") for r in ("eu", "world") for s in ("low", "mid", "high")])


@query("select distinct p_name || e as name, p_name as parent from part, (values (' Sedan'), (' Estate'), (' pickup'), ('-AMG Coupe'), (' suv crossover'), (' Shooting Brake'), ('')) t(e) union all select distinct 'Qzj ' || p_size || ' Coupe', null from part")
def parent_key_resolve(spark, d):
    """A name without its marks of style and performance; names that are no part's have no parent."""
    part = table(spark, d, "part")
    endings = F.explode(F.array(*map(F.lit, (" Sedan", " Estate", " pickup", "-AMG Coupe", " suv crossover", " Shooting Brake", ""))))
    names = part.select("p_name").distinct().select("p_name", endings.alias("e")).select(F.concat("p_name", "e").alias("name"))
    other = part.select("p_size").distinct().select(F.concat(F.lit("Qzj "), F.col("p_size").cast("string"), F.lit(" Coupe")).alias("name"))
    return estimates.resolve_parents(names.union(other), part.select(F.col("p_name").alias("key")).distinct())


@query("""with k as (select distinct p_name || ' ' || p_size as key from part), q as (select distinct substr(key, 2) as query from k)
  select query, case when query in (select key from k) then query else (select min(key) from k where substr(key, 2) = query) end as match from q""")
def fuzzy_name_rules(spark, d):
    """Names that lack their first letter find it again; a query's digits bind where some key has the same."""
    keys = table(spark, d, "part").select(F.concat_ws(" ", "p_name", F.col("p_size").cast("string")).alias("key")).distinct()
    return lookups.best_match(keys.select(F.expr("substr(key, 2)").alias("query")).distinct(), keys).select("query", "match")


@query(f"""{WITH}, g as (select model, generation, y as year from (select distinct model, generation from local_sales) m, range(1994, 2003) t(y)),
  r as (select *, row_number() over (partition by year order by units desc, model, generation) as rank, count(*) over (partition by model, generation) as n from local_sales)
  select g.model, g.generation, g.year, r.rank, case when rank <= 10 then 0.25::double when rank <= 30 then 0.15::double when rank <= 60 then 0.08::double when rank is not null then 0.03::double when p.n >= 5 then 0.08::double else 0.04::double end as low,
    case when rank <= 10 then 0.85::double when rank <= 30 then 0.65::double when rank <= 60 then 0.50::double when rank is not null then 0.35::double when p.n >= 5 then 0.60::double else 0.40::double end as high
  from g left join r on g.model = r.model and g.generation = r.generation and g.year = r.year left join (select model, generation, count(*) as n from local_sales group by 1, 2) p on g.model = p.model and g.generation = p.generation""")
def share_bands(spark, d):
    """Europe's share by the rank in a year, or by the years with sales where there is none."""
    from pyspark.sql import Window

    rows = sales(spark, d, True)
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("year").orderBy(F.desc("units"), "model", "generation"))).select("model", "generation", "year", "rank")
    presence = rows.groupBy("model", "generation").agg(F.count("*").cast("int").alias("presence"))
    out = presence.withColumn("year", F.explode(F.expr("sequence(1994L, 2002L)"))).join(ranked, ["model", "generation", "year"], "left")
    band = estimates.share_band(F.col("rank"), F.col("presence"))
    return out.select("model", "generation", "year", F.col("rank").cast("long").alias("rank"), band["low"].alias("low"), band["high"].alias("high"))


_CASES = f"""s as (select model, generation, cast(sum(case when year = 1997 then units end) as bigint) as w from sales group by 1, 2), l as (select model, generation, cast(sum(case when year = 1997 then units end) as bigint) as e from local_sales group by 1, 2),
  t as (select model, sum(w) as pw, sum(e) as pe from s left join l using (model, generation) group by 1),
  c as (select s.model, s.generation, {_K.replace('model', 's.model')} as k, length(s.generation) as n, w, e, cast(pw as bigint) as pw, cast(pe as bigint) as pe from s left join l using (model, generation) join t on t.model = s.model),
  x as (select *, case when (k + n) % 3 > 0 then e end as eu, case when k % 4 > 0 then w end as world, case when k % 2 = 0 then 'p' end as parent, case when k % 2 = 0 then pe end as teu, case when k % 2 = 0 then pw end as tw, k % 7 = 1 as history,
    case when n % 2 = 0 then 0.20::double else 0.15::double end as el, case when n % 2 = 0 then 0.30::double else 0.25::double end as em, case when n % 2 = 0 then 0.40::double else 0.35::double end as eh,
    case when n % 2 = 0 then 0.18::double else 0.12::double end as wl, case when n % 2 = 0 then 0.28::double else 0.22::double end as wm, case when n % 2 = 0 then 0.36::double else 0.32::double end as wh from c),
  y as (select *, parent is not null and ((teu is not null and (eu is null or eu < el * teu)) or (tw is not null and (world is null or world < wl * tw))) as derive from x),
  z as (select *, case when derive and teu is not null then least(greatest(round_even(em * teu, 0), eu), round_even(eh * teu, 0)) when eu is null and world is null and parent is null and not history then 700 else eu end as ev,
    case when derive and tw is not null then least(greatest(round_even(wm * tw, 0), world), round_even(wh * tw, 0)) when eu is null and world is null and parent is null and not history then null else world end as wv from y),
  b as (select *, case when k <= 10 then 0.25::double when k <= 30 then 0.15::double end as lo, case when k <= 10 then 0.85::double when k <= 30 then 0.65::double end as hi from z)"""


@query(f"""{WITH}, {_CASES} select model, generation, cast(ev as bigint) as eu_exact, cast(least(wv, 3000000) as bigint) as world_exact,
  cast(case when parent is not null and teu is not null then round_even(el * teu, 0) end as bigint) as eu_low, cast(case when parent is not null and teu is not null then greatest(round_even(eh * teu, 0), round_even(el * teu, 0), coalesce(ev, 0)) end as bigint) as eu_high,
  cast(case when wv is null and ev is not null then greatest(ev, ceil(ev / hi)) when parent is not null and tw is not null then round_even(wl * tw, 0) end as bigint) as world_low,
  cast(case when wv is null and ev is not null then least(3000000, floor(ev / lo)) when parent is not null and tw is not null then greatest(round_even(wh * tw, 0), round_even(wl * tw, 0), coalesce(wv, 0)) end as bigint) as world_high from b""")
def build_constraints(spark, d):
    """Exact values and ranges at a start year, from local seeds, a parent's totals (all types of a brand) or the web's."""
    at = lambda local, name: sales(spark, d, local).groupBy("model", "generation").agg(F.sum(F.when(F.col("year") == 1997, F.col("units"))).alias(name))
    rows = at(False, "w").join(at(True, "e"), ["model", "generation"], "left")
    totals = rows.groupBy("model").agg(F.sum("w").alias("pw"), F.sum("e").alias("pe"))
    k, n = _number(), F.length("generation")
    even = k % 2 == 0
    cases = rows.join(totals, "model").select(
        "model", "generation", F.when((k + n) % 3 > 0, F.col("e")).alias("eu"), F.when(k % 4 > 0, F.col("w")).alias("world"), F.when(even, F.lit("p")).alias("parent"), F.when(even, F.col("pe")).alias("parent_eu"),
        F.when(even, F.col("pw")).alias("parent_world"), F.when(n % 2 == 0, "body_style/wagon").otherwise("base").alias("variant"), (k % 7 == 1).alias("has_history"),
        F.lit(700).cast("long").alias("web_eu"), F.lit(None).cast("long").alias("web_world"), k.alias("rank"), F.lit(3).alias("presence"),
    )
    return estimates.constraints(cases).select("model", "generation", *[F.col(c).cast("long").alias(c) for c in ("eu_exact", "world_exact", "eu_low", "eu_high", "world_low", "world_high")])


@query(f"{WITH}, a as (select model, cast(sum(case when year = 1996 and {_K} % 3 > 0 then units end) as bigint) as prior, cast(sum(case when year = 1997 and {_K} % 4 > 0 then units end) as bigint) as total from local_sales group by 1) select model, case when coalesce(prior, 0) > 0 and coalesce(total, 0) > 0 then 'EU seed may be small vs 10% prior-gen avg ' || format('{{:,}}', prior) || ' & 5% model EU ' || format('{{:,}}', total) when coalesce(prior, 0) > 0 then 'EU seed may be small vs 10% prior-gen avg ' || format('{{:,}}', prior) when coalesce(total, 0) > 0 then 'EU seed may be small vs 5% model EU ' || format('{{:,}}', total) end as note from a")
def plausibility_note(spark, d):
    of = lambda year, when: F.sum(F.when((F.col("year") == year) & when, F.col("units")))
    rows = sales(spark, d, True).groupBy("model").agg(of(1996, _number() % 3 > 0).alias("prior"), of(1997, _number() % 4 > 0).alias("total"))
    return rows.select("model", evidence.plausibility(F.col("prior"), F.col("total")).alias("note"))


@query("""with x as (select p_partkey, '"' || p_name || '"' as name, 2000 + p_size % 20 as y, p_size % 12 + 1 as n, p_size % 2 = 0 as g from part),
  f as (select p_partkey, name || case when g then ' ("' || n || 'th generation" OR "Mk' || n || '" OR "mark ' || n || '" OR "mk ' || n || '" OR "mk' || n || '")' else '' end || ' ' || y || ' ' as q from x)
  select p_partkey as ask, region, cast(1000 * length(q || words) as bigint) as value, 'l' || length(q || words) as url, true as is_model_level from f, (values ('europe', 'registrations europe -price -msrp -€ -$'), ('world', 'worldwide sales -price -msrp -€ -$')) t(region, words)""")
def web_seed(spark, d):
    """The best figures of the answers to an ask's searches; a provider has one answer for each search."""
    n = F.col("p_size")
    asked = table(spark, d, "part").select(F.col("p_partkey").alias("ask"), F.col("p_name").alias("model"), F.when(n % 2 == 0, F.concat(F.lit("Mk"), (n % 12 + 1).cast("string"))).alias("generation"), (n % 20 + 2000).alias("year"))
    searches = asked.select("model", "generation", "year", F.posexplode(evidence.search_queries(F.col("model"), F.col("generation"), F.col("year"))).alias("i", "query")).distinct()
    figure = F.format_number(F.length("query") * 1000, 0)
    said = lambda words: F.concat_ws(" ", "model", "generation", F.lit(words), F.concat(F.col("year").cast("string"), F.lit(":")), figure, F.lit("units"))
    snippet = F.when(F.col("i") < 2, said("sales in europe")).when(F.col("i") < 4, said("worldwide deliveries")).otherwise("no figures of sales")
    result = F.struct(F.col("model").alias("title"), snippet.alias("snippet"), F.concat(F.lit("l"), F.length("query").cast("string")).alias("link"))
    answers = searches.select("query", F.to_json(F.struct(F.array(result).alias("organic_results"))).alias("response"))
    return estimation.web_seed(asked, answers).select("ask", "region", "value", "url", "is_model_level")
