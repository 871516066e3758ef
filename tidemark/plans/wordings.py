"""Queries of the text rules and of search results, on texts that are made from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import evidence
from .queries import query, table


def _pick(column, *choices):
    """The choice that the number leaves by how many there are."""
    out = F.when(column % len(choices) == 0, choices[0])
    for i, c in enumerate(choices[1:], 1):
        out = out.when(column % len(choices) == i, c)
    return out


def _s(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


@query("""select p_partkey, case p_size % 9 when 0 then p_type when 1 then 'I' when 2 then p_type || ' - B' when 3 then 'I' when 4 then p_type when 5 then 'Mk' || p_size || ' (6J' when 6 then 'A - ' || p_type when 7 then 'I' else p_type || ' / India' end as label from part""")
def clean_rules(spark, d):
    kind, n = F.col("p_type"), F.col("p_size")
    raw = _pick(n, _s(kind, " (2007)"), F.lit(" n/a "), _s(kind, " – B;"), F.lit("Dominant"), _s(kind, " / South India)"), _s("Mk", n, " (6J)"), _s("A â€“ ", kind), F.lit(None).cast("string"), _s(kind, " / India"))
    return table(spark, d, "part").select("p_partkey", text.clean_generation(raw).alias("label"))


@query("""select p_partkey, case p_size % 5 when 0 then 'Mk' || (p_size % 12 + 1) when 1 then ['I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX', 'X'][p_size % 10 + 1] when 2 then 'A' || p_size when 3 then p_name else substr(p_name || ' that goes on for more than thirty-two characters', 1, 32) || '…' end as short from part""")
def short_gen_name(spark, d):
    n, name = F.col("p_size"), F.col("p_name")
    ordinal = F.get(F.array(*map(F.lit, text.ORDINALS)), n % 10)
    raw = _pick(n, _s(name, " mark ", n % 12 + 1, " (2012-2019)"), _s("The ", ordinal, " Generation of ", name), _s(name, " A", n, " kind"), _s(" ", name, " (with a note) "), _s(name, " that goes on for more than thirty-two characters"))
    return table(spark, d, "part").select("p_partkey", text.short_generation(raw).alias("short"))


@query("""with x as (select p_partkey, p_size % 7 as c, 1990 + p_size % 25 as y from part) select p_partkey, cast(case when c < 6 then y end as bigint) as "start", cast(case when c in (1, 3, 5) then y + 5 end as bigint) as "end" from x""")
def year_range_rules(spark, d):
    y, name = F.col("p_size") % 25 + 1990, F.col("p_name")
    raw = _pick(F.col("p_size"), _s(name, " made 1960-1970 Mk (", y, " - heute)"), _s(name, " (", y, "–", y + 5, ")"), _s("(facelift; ", y, " — present) ", name), _s(y, "-", y + 5, " then (", name, ")"), _s(name, " from ", y, " - aktuell"), _s("(", name, "; ", y, " - ", y + 5, ") 1950-1960"), name)
    start, end = text.year_range(raw)
    return table(spark, d, "part").select("p_partkey", start.cast("long").alias("start"), end.cast("long").alias("end"))


@query("""select event_id, case event_id % 4 when 0 then props when 1 then props when 2 then null else '[' || props || ']' end as doc from events""")
def fenced_json(spark, d):
    """The document of an answer: the whole, or its last block between fences, or none."""
    raw = _pick(F.col("event_id"), F.col("props"), _s("First:\n```json\n[1]\n``` then ```json\n", F.col("props"), "\n``` done"), _s("no ", F.col("props"), " here ```json {\"a\": ```"), _s("[", F.col("props"), "]"))
    return table(spark, d, "events").select("event_id", text.fenced_json(raw).alias("doc"))


@query("""select event_id, case event_id % 3 when 0 then json_extract_string(props, '$.k') when 1 then null else 'x' end as found, event_id % 3 = 0 as held from events""")
def dotted_path(spark, d):
    """A path into nested documents; where a step is missing, null or no document, nothing is found."""
    raw = _pick(F.col("event_id"), _s('{"a": {"b": ', F.col("props"), "}}"), F.lit('{"a": {"b": null}}'), F.lit('{"a": {"b": {"k": "x", "j": []}}}'))
    rows = table(spark, d, "events").select("event_id", raw.alias("raw"))
    return rows.select("event_id", F.get_json_object("raw", "$.a.b.k").alias("found"), F.get_json_object("raw", "$.a.b.k").try_cast("bigint").isNotNull().alias("held"))


@query("""with o as (select o_custkey as ask, o_orderkey as place, o_orderkey % 5 as c, cast(floor(o_totalprice / 4) as bigint) as v from orders),
  x as (select ask, place, c, case when c = 1 then case when v >= 1000 then v end when v >= 1000 then greatest(v, 2013) else 2013 end as value from o where c <> 3),
  m as (select ask, place, c, value, region, case c when 0 then 11 when 1 then case when region = 'world' then 7 else 4 end when 2 then 6 else -3 end + case when region = 'europe' and value < 20000 and c <> 4 then -6 else 0 end as marks
    from x, (values ('europe'), ('world')) t(region) where value is not null and (region = 'europe' or c = 1))
  select ask, region, value, 'u' || place % 1000 as url, c in (0, 1) as is_model_level from m qualify row_number() over (partition by ask, region order by marks * 10 + log10(value + 1) desc, place) = 1""")
def best_numbers(spark, d):
    """The best figure of each customer's orders, each order a text from a search."""
    o = F.col("o_orderkey")
    v = F.format_number(F.floor(F.col("o_totalprice") / 4), 0)
    said = _pick(o, _s("Golf mk7 sales in Europe 2013: ", v, " units"), _s("Worldwide Golf mark 7 deliveries reached ", v), _s("Golf mk7 monthly sales Europe 2013: ", v), _s("Golf mk7 in Europe 2013: ", v), _s("Fiat mk7 registrations uk 2013: ", v, " units"))
    blobs = table(spark, d, "orders").select(F.col("o_custkey").alias("ask"), F.lit("Golf").alias("model"), F.lit("mk7").alias("generation"), F.lit(2013).alias("year"), o.alias("place"), said.alias("text"), _s("u", o % 1000).alias("url"))
    return evidence.best_numbers(blobs).select("ask", "region", "value", "url", "is_model_level")


@query("""select p_partkey, source, text, url from part, lateral (
    select 'answer_box' as source, p_name || ' units' as text, 'g' || p_size as url where p_size % 3 > 0 union all select 'knowledge_graph', 'made by ' || p_brand, 'g' || p_size
    union all select 'organic', p_name || chr(10) || 'snippet ' || i, case when i % 2 = 0 then 'l' || i else '' end from range(0, 10) t(i) where i <> 4) x""")
def search_blobs(spark, d):
    """Texts of a search answer's boxes and of its first ten results, without those that look like prices."""
    n, name = F.col("p_size"), F.col("p_name")
    result = lambda i: F.struct(
        name.alias("title"), F.when(i == 4, "for $3").otherwise(_s("snippet ", i)).alias("snippet"), F.when(i % 2 == 0, _s("l", i)).alias("link"))
    box = F.when(n % 3 > 0, F.struct(_s(name, " units").alias("a"), F.lit(5).alias("n"), F.lit("the Price is 3").alias("p")))
    answer = F.struct(box.alias("answer_box"), F.struct(_s("made by ", F.col("p_brand")).alias("b")).alias("knowledge_graph"), F.struct(_s("g", n).alias("google_url")).alias("search_metadata"), F.transform(F.sequence(F.lit(0), F.lit(12)), result).alias("organic_results"))
    rows = table(spark, d, "part").select("p_partkey", F.to_json(answer).alias("raw"))
    return rows.select("p_partkey", F.explode(evidence.text_blobs(F.col("raw"))).alias("b")).select("p_partkey", "b.*")


@query("""with x as (select p_partkey, '"' || p_name || '"' as name, 2000 + p_size % 20 as y, p_size % 12 + 1 as n, p_size % 2 = 0 as g from part),
  f as (select *, name || case when g then ' ("' || n || 'th generation" OR "Mk' || n || '" OR "mark ' || n || '" OR "mk ' || n || '" OR "mk' || n || '")' else '' end as full_ from x)
  select p_partkey, cast(i as bigint) as place, case when i < 4 then full_ || ' ' || y || ' ' || ['sales europe', 'registrations europe', 'global sales', 'worldwide sales'][i + 1] || ' -price -msrp -€ -$'
    else 'site:' || ['carsalesbase.com', 'acea.auto', 'marklines.com'][i - 3] || ' ' || name || ' ' || y || ' ' || ['sales', 'registrations', 'sales'][i - 3] end as search from f, range(0, 7) t(i)""")
def search_queries(spark, d):
    n = F.col("p_size")
    rows = table(spark, d, "part").select("p_partkey", F.posexplode(evidence.search_queries(F.col("p_name"), F.when(n % 2 == 0, _s(" Mk", n % 12 + 1)), n % 20 + 2000)).alias("place", "search"))
    return rows.withColumn("place", F.col("place").cast("long"))
