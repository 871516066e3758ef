"""Queries of names, labels and outputs: what is looked up, nested, named and laid out as text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import markup, pages, text
from ..operators import enforcement, lookups, publish
from .estimates import _ENFORCED, _MIXED, _enforced, _number
from .queries import WITH, query, sales, table
from .wordings import _pick, _s

_SMOOTHED = f"""{_ENFORCED}, r as (select * from held where year >= s),
  c as (select model, year, world, europe, rationale, 1 as n from r where year = s
    union all select r.model, r.year, {_MIXED('world')}, {_MIXED('europe')}, r.rationale, c.n + 1 from c join r on r.model = c.model and r.year = c.year + 1),
  est as (select model, year, least(world, 3000) as world, least(europe, least(world, 3000)) as europe, rationale from c)"""


@query(f"""with recursive {_SMOOTHED},
  f as (select t.model, t.year, sum(p.world * case when t.year - p.year <= 1 then 1 else pow(1 - 0.0556, t.year - p.year - 1) end) as w, sum(p.europe * case when t.year - p.year <= 1 then 1 else pow(1 - 0.0556, t.year - p.year - 1) end) as e
    from est t join est p on t.model = p.model and p.year <= t.year group by 1, 2),
  k as (select distinct model, cast(substr(model, 7) as int) as k from est)
  select model, cast(year as bigint) as year, world as world_sales, europe as europe_sales, rationale, cast(round_even(w, 0) as bigint) as world_fleet, cast(round_even(e, 0) as bigint) as europe_fleet, cast(round_even(w * 0.021, 0) as bigint) as world_repairs, cast(round_even(e * 0.021, 0) as bigint) as europe_repairs,
    coalesce(k % 5 > 0 and year between 1994 + k % 4 and 1999 + k % 3, false) as gen_active, k % 3 = 0 as supported, case when k % 3 = 0 then 'by_year_exact_gen' else 'no_model_match' end as match_type from est join f using (model, year) join k using (model)""")
def estimate_sheet(spark, d):
    """The sheet of yearly estimates: smoothed sales, fleets and repairs of both regions, the generation's years, and support."""
    held, k = _enforced(spark, d), _number()
    rows = held.where(F.col("year") >= k % 2 + 1996)
    smooth = enforcement.smooth_pair(rows, cap=3000).join(rows.select("model", "year", "rationale"), ["model", "year"])
    models = rows.select("model").distinct()
    windows = models.where(k % 5 > 0).select("model", (k % 4 + 1994).alias("first"), (k % 3 + 1999).alias("final"))
    found = models.select("model", (k % 3 == 0).alias("supported"), F.when(k % 3 == 0, "by_year_exact_gen").otherwise("no_model_match").alias("match_type"))
    return publish.estimate_sheets(smooth, windows, found)["Estimates"].withColumn("year", F.col("year").cast("long"))


@query(f"""{WITH}, y as (select cast(year as varchar) as a, cast(cast(sum(units) as bigint) as varchar) as b, cast(coalesce(cast(sum(e) as bigint), 0) as varchar) as c from (select year, units, null as e from sales union all select year, 0, units from local_sales) group by year order by year limit 10),
  w as (select greatest(max(length(a)), 6)::int as a, greatest(max(length(b)), 7)::int as b, greatest(max(length(c)), 8)::int as c from y)
  select cast(case when n = 0 then 0 else n + 1 end as bigint) as place, line from (
    select 0 as n, '| ' || lpad('Year', w.a, ' ') || ' | ' || lpad('World', w.b, ' ') || ' | ' || lpad('Europe', w.c, ' ') || ' |' as line from w
    union all select row_number() over (order by y.a), '| ' || lpad(y.a, w.a, ' ') || ' | ' || lpad(y.b, w.b, ' ') || ' | ' || lpad(y.c, w.c, ' ') || ' |' from y, w)
  union all select 1, '|' || repeat('-', cast(w.a + 2 as int)) || '|' || repeat('-', cast(w.b + 2 as int)) || '|' || repeat('-', cast(w.c + 2 as int)) || '|' from w""")
def preview_text(spark, d):
    """The first ten years as a table of text."""
    world = sales(spark, d).groupBy("year").agg(F.sum("units").alias("world"))
    europe = sales(spark, d, True).groupBy("year").agg(F.sum("units").alias("europe"))
    rows = world.join(europe, "year", "left").withColumn("europe", F.coalesce("europe", F.lit(0)))
    out = publish.preview(rows, {"Year": "year", "World": "world", "Europe": "europe"}, [F.col("year")])
    return out.withColumn("place", F.col("place").cast("long"))


_GENERATIONS = "g as (select p_brand as model, p_type as label, min(p_size) + 1990 as s, case when count(*) % 3 > 0 then min(p_size) + 1990 + count(*) % 9 end as e from part group by 1, 2)"


def _generations(spark, d) -> DataFrame:
    g = table(spark, d, "part").groupBy(F.col("p_brand").alias("model"), F.col("p_type").alias("label")).agg((F.min("p_size") + 1990).cast("long").alias("start"), F.count("*").alias("n"))
    return g.select("model", "label", "start", F.when(F.col("n") % 3 > 0, F.col("start") + F.col("n") % 9).alias("end"))


@query(f"with {_GENERATIONS}, i as (select *, row_number() over (partition by model order by s, coalesce(e, 9999), label) as i from g) select model || ': ' || string_agg('generation ' || i || ': ' || s || '-' || coalesce(cast(e as varchar), 'present'), ', ' order by i) as line from i group by model")
def generation_lines(spark, d):
    """A model's generations in one line, in the order of start and end, open ends last."""
    x = F.struct(F.col("start").alias("start_year"), F.coalesce("end", F.lit(9999)).alias("order"), "label", F.col("end").alias("end_year"))
    docs = _generations(spark, d).groupBy("model").agg(F.array_sort(F.collect_list(x)).alias("g"))
    return docs.select(publish.generation_line(F.col("model"), F.col("g")).alias("line"))


@query(f"with {_GENERATIONS} select model, label, cast(row_number() over (partition by model order by s, coalesce(e, 9999), label) - 1 as bigint) as place, cast(s as bigint) as start_year, cast(e as bigint) as end_year from g where not (s = 1995 and e is null)")
def documents_and_back(spark, d):
    """Windows put into a document of each model, written as JSON, and taken apart again."""
    g = _generations(spark, d).where(~((F.col("start") == 1995) & F.col("end").isNull()))
    x = F.struct("start", F.coalesce("end", F.lit(9999)).alias("end"), "label")
    docs = g.groupBy("model").agg(F.to_json(F.array_sort(F.collect_list(x))).alias("body"))
    back = docs.select("model", F.posexplode(F.from_json("body", "array<struct<start:bigint,end:bigint,label:string>>")).alias("place", "w"))
    return back.select("model", "w.label", F.col("place").cast("long").alias("place"), F.col("w.start").alias("start_year"), F.nullif("w.end", F.lit(9999)).alias("end_year"))


@query(f"with {_GENERATIONS} select model, label, cast(s as bigint) as start, cast(coalesce(e, lead(s) over (partition by model order by s, label) - 1) as bigint) as \"end\", e is not null as given from g")
def lead_keeps_end(spark, d):
    """Open ends closed a year before the next start; ends that are given stay."""
    rows = _generations(spark, d).withColumn("given", F.col("end").isNotNull())
    return lookups.next_start_as_end(rows, "model").select("model", "label", "start", "end", "given")


@query("select o_orderkey, 'sales_estimates_' || replace(c_name, ' ', '_') || '_' || case o_orderkey % 3 when 0 then 'gen' when 1 then 'mk' || o_custkey % 9 else 'body_' || lower(o_orderstatus) end || '_' || year(o_orderdate) || '_rules_' || strftime(o_orderdate, '%Y%m%d-%H%M%S') as name from orders join customer on o_custkey = c_custkey")
def output_names(spark, d):
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    generation = _pick(F.col("o_orderkey"), F.lit(None).cast("string"), _s("Mk ", F.col("o_custkey") % 9), _s("(Body ", F.col("o_orderstatus"), ")"))
    name = publish.base_name(F.col("c_name"), generation, F.year("o_orderdate"), "rules", F.col("o_orderdate").cast("timestamp_ntz"))
    return rows.select("o_orderkey", name.alias("name"))


@query("""with e as (select distinct p_name || ' ' || p_size as key from part where p_size % 2 = 0), w as (select distinct p_name || ' ' || p_size as key from part where p_size % 3 = 0),
  n as (select distinct p_name || '-' || p_size as name, p_name || ' ' || p_size as key from part)
  select name, case when e.key is not null or w.key is not null then n.key end as key, case when e.key is not null then 'EU' when w.key is not null then 'World' end as found_in from n left join e on n.key = e.key left join w on n.key = w.key
  where e.key is not null or w.key is not null""")
def key_lookup(spark, d):
    """A name's key in Europe's keys, else in the world's; names that are in neither are left to `fuzzy_name_rules`."""
    part = table(spark, d, "part")
    key = F.concat_ws(" ", "p_name", F.col("p_size").cast("string"))
    names = part.select(F.concat_ws("-", "p_name", F.col("p_size").cast("string")).alias("name")).distinct().withColumn("key", text.normalize_name(F.col("name")))
    found = lookups.find_keys(names, {"EU": part.where("p_size % 2 = 0").select(key.alias("key")), "World": part.where("p_size % 3 = 0").select(key.alias("key"))})
    return found.where("found_in <> 'similar'")


@query(f"""{WITH}, k as (select lower(replace(model, '#', ' ')) as key, year, cast(sum(units) as bigint) as w from sales group by 1, 2), l as (select lower(replace(model, '#', ' ')) as key, year, cast(sum(units) as bigint) as e from local_sales where year <> 1998 group by 1, 2),
  n as (select distinct p_brand || t.x as name, lower(replace(p_brand, '#', ' ')) as key, t.x = '' as own, y.year from part, (values (''), (' Estate'), ('-AMG')) t(x), range(1997, 1999) y(year))
  select n.name, cast(n.year as bigint) as year, case when not own then n.key end as parent, case when not own then e end as eu, case when not own then w end as world from n left join k on k.key = n.key and k.year = n.year left join l on l.key = n.key and l.year = n.year""")
def parent_year_totals(spark, d):
    """A variant's parent and its totals in a year in both regions; a name that is its own parent has none."""
    from ..operators import estimates

    of = lambda local, name: sales(spark, d, local).groupBy(text.normalize_name(F.col("model")).alias("key"), "year").agg(F.sum("units").alias(name))
    world, europe = of(False, "world"), of(True, "eu").where("year <> 1998")
    brands = table(spark, d, "part").select("p_brand").distinct()
    names = brands.select(F.explode(F.array(*[F.concat("p_brand", F.lit(x)) for x in ("", " Estate", "-AMG")])).alias("name"))
    asked = names.withColumn("year", F.explode(F.array(F.lit(1997).cast("long"), F.lit(1998).cast("long"))))
    return estimates.parent_totals(asked, world, europe)


@query(f"""{WITH}, k as (select model, year, max(case when generation = 'LARGE' then units end) as same, cast(sum(units) as bigint) as units, max(generation) as label from local_sales group by 1, 2)
  select model, cast(1997 as bigint) as start, max(case when year = 1997 then units end) as seed, max(case when year = 1997 then case when label = 'STANDARD' then 'local-db' else 'local-db(year-match)' end end) as source, count(*) filter (where year between 1996 and 1999) as history, cast(coalesce(sum(units) filter (where year between 1996 and 1999), 0) as bigint) as history_units from k group by 1""")
def local_seeds(spark, d):
    """The seed of a start year, how its label fits, and the history inside the window."""
    from ..operators import estimates

    rows = sales(spark, d, True).groupBy("model", "year").agg(F.sum("units").alias("units"), F.max("generation").alias("generation"))
    asked = rows.select("model").distinct().select("model", F.lit(1997).cast("long").alias("start"), F.lit(1996).alias("first"), F.lit(1999).alias("final"), F.array(F.lit("standard")).alias("accepted"))
    return estimates.local_seeds(asked, rows)


@query("""with x as (select 'm' || page_id % 20 as model, regexp_extract(html, '<html lang="([a-z]+)"', 1) as lang, page_id % 4 as n from pages), s as (select model, lang, sum(n) as windows from x group by 1, 2)
  select model, lang, cast(windows as bigint) as windows from s where windows > 0 qualify row_number() over (partition by model order by case when windows >= 8 then 0 else 1 end, case lang when 'fr' then 0 when 'en' then 1 when 'de' then 2 when 'es' then 3 when 'it' then 4 else 5 end) = 1""")
def language_windows(spark, d):
    """The first language in order, the preferred one first, with enough windows, else the first with any."""
    i = F.col("page_id")
    rows = table(spark, d, "pages").select(_s("m", i % 20).alias("model"), F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("lang"), (i % 4).alias("n"))
    found = rows.groupBy("model", "lang").agg(F.sum("n").alias("windows")).where("windows > 0")
    return lookups.preferred_language(found, "fr", least=8)


@query("""with k as (select c_custkey, 'a' || c_custkey % 4 || ' x ' || c_custkey % 3 as a, c_custkey % 3 || ' a' || c_custkey % 5 as b from customer)
  select c_custkey, c_custkey % 4 = c_custkey % 5 as same, c_custkey % 4 = c_custkey % 5 as inside, c_custkey % 7 > 0 as words from k""")
def set_tests(spark, d):
    """Whether two names have the same words with digits, one's are among the other's, and a column holds truth words alone."""
    c = F.col("c_custkey")
    a, b = text.digit_tokens(text.normalize_name(_s("A", c % 4, " x ", c % 3))), text.digit_tokens(text.normalize_name(_s(c % 3, " a", c % 5)))
    words = F.array(F.when(c % 2 == 0, "vrai").otherwise("FALSE"), F.when(c % 7 == 0, "oui").otherwise("1"))
    inside = F.size(F.array_except(F.transform(words, F.lower), F.array(*map(F.lit, ("true", "false", "vrai", "faux", "1", "0"))))) == 0
    return table(spark, d, "customer").select("c_custkey", (a == b).alias("same"), (F.size(F.array_except(a, b)) == 0).alias("inside"), inside.alias("words"))


@query("select distinct unnest([upper(a[1]) || substr(a, 2) || ' ' || upper(b[1]) || substr(b, 2), upper(p_type[1]) || lower(substr(p_type, 2)) || ' Kit', 'X', 'Brand ' || substr(p_brand, 7)]) as token from (select *, split_part(p_name, ' ', 1) as a, split_part(p_name, ' ', 2) as b from part where p_size % 5 > 0)")
def catalogue_tokens(spark, d):
    """The distinct names of a catalogue's lines, cut at tabs, pluses, slashes and ampersands."""
    line = _s(F.col("p_name"), "\t", F.lower("p_type"), " KIT + x & /", F.replace(F.col("p_brand"), F.lit("#"), F.lit(" ")))
    return table(spark, d, "part").where("p_size % 5 > 0").select(F.explode(text.catalogue_tokens(line)).alias("token")).distinct()


@query("select o_orderkey, case when o_orderkey % 3 > 0 then 'out/' || o_custkey || '.csv' end as csv, case when o_orderkey % 2 = 0 then '/tmp/' || o_orderkey || ': b.xlsx' end as excel from orders")
def saved_paths(spark, d):
    """Paths in a log: what follows a prefix in the last line that begins with it."""
    o = F.col("o_orderkey")
    log = _s("start\n", F.when(o % 3 > 0, _s("Saved CSV: old.csv\r\n  Saved CSV: out/", F.col("o_custkey"), ".csv ")).otherwise("not Saved CSV: x"), "\n", F.when(o % 2 == 0, _s("Saved Excel: /tmp/", o, ": b.xlsx")).otherwise(""))
    return table(spark, d, "orders").select("o_orderkey", text.after_prefix(log, "Saved CSV:").alias("csv"), text.after_prefix(log, "Saved Excel:").alias("excel"))


@query("select doc_id, case when length(text) > 110 then substr(text, 1, 110) || '…' else text end as reason from documents")
def shortened_reasons(spark, d):
    return table(spark, d, "documents").select("doc_id", text.shortened(F.col("text")).alias("reason"))


@query("select p_partkey, case p_size % 6 when 0 then p_name when 1 then p_name || ' x' when 2 then p_name when 3 then p_name || ' ()' when 4 then 'x ' || p_name else p_name || ' 1850' end as search, p_size % 6 in (0, 3, 4) as page from part")
def sanitized_searches(spark, d):
    """Search texts without words of generations and years, and which of them are titles of a generation's page."""
    n, name = F.col("p_size"), F.col("p_name")
    raw = _pick(n, _s(" ", name, " Mk ", n, " - "), _s(name, " gen II x"), _s(name, " – second 2004"), _s(name, " (2012)"), _s("x generation one ", name), _s(name, " 1850"))
    return table(spark, d, "part").select("p_partkey", text.sanitize_search(raw).alias("search"), text.is_generation_page(raw).alias("page"))


@query("""select page_id, case page_id % 7 when 0 then 'Mk ' || page_id when 1 then 'The Génération' when 2 then 'Body (1999–2004)' when 3 then 'Reception (12)' when 4 then 'mark iv sedan' when 5 then '1999-2004' else 'Legacy' end as heading, page_id % 7 in (0, 1, 2, 4) as hit from pages""")
def heading_marks(spark, d):
    """Headings of the second to fourth level, and which of them name a generation."""
    said = _pick(F.col("page_id"), _s("Mk ", F.col("page_id")), F.lit("The <i>Génération</i>"), F.lit("Body (1999–2004)"), F.lit("Reception (12)"), F.lit(" mark&nbsp;iv sedan"), F.lit("1999-2004"), F.lit("Legacy"))
    level = (F.col("page_id") % 3 + 2).cast("string")
    html = _s(F.col("html"), "<h", level, " id='x'>", said, "</h", level, "><h5>Mk 9</h5>")
    rows = table(spark, d, "pages").select("page_id", F.explode(markup.headings(html, "2-4")).alias("heading"))
    return rows.withColumn("hit", pages.names_generation(F.col("heading")))


@query("select page_id, case when page_id % 3 > 0 then 'from ' || page_id end as years, split_part(regexp_extract(html, '<title>([^<]*)</title>', 1), '&', 1) as title from pages")
def table_rows(spark, d):
    """The cell beside a header in a table behind each page's own text, and the page's title up to its first mark."""
    row = F.when(F.col("page_id") % 3 > 0, _s("<tr><th scope='row'>Model <b></b>years</th>\n<td><b>from</b> ", F.col("page_id"), "</td></tr>")).otherwise("<tr><th>Model</th></tr>")
    html = _s(F.col("html"), "<table><tr><th>Maker</th><td>x</td></tr>", F.replace(row, F.lit("<b></b>"), F.lit("")), "</table>")
    return table(spark, d, "pages").select("page_id", markup.table_value(html, "Model years").alias("years"), F.substring_index(F.regexp_extract("html", "<title>([^<]*)</title>", 1), "&", 1).alias("title"))


@query("select source, arg_min(doc_id, {'a': case when doc_id % 3 > 0 then 1 else 0 end, 'b': doc_id}) as doc_id from documents group by 1")
def first_plain_title(spark, d):
    """The first title of a source that is not a generation's page, else its first."""
    i = F.col("doc_id")
    title = _pick(i, _s("Golf ", F.col("lang")), F.lit("Golf Mk 4"), F.lit("Golf (car, 2004)"))
    rows = table(spark, d, "documents").select("source", "doc_id", text.is_generation_page(title).cast("int").alias("of"))
    return rows.groupBy("source").agg(F.min_by("doc_id", F.struct("of", "doc_id")).alias("doc_id"))


@query("select user_id, cast(count(*) as bigint) as n, cast(ceil(count(*) / 100.0) as bigint) as parts, cast(sum(event_id) as bigint) as total from events group by 1")
def nest_in_parts(spark, d):
    """A user's events nested in parts of at most some hundred, so that no row grows with its user, and taken apart again."""
    rows = table(spark, d, "events").select("user_id", "event_id")
    sizes = rows.groupBy("user_id").agg(F.ceil(F.count("*") / 100).alias("parts"))
    parts = rows.join(sizes, "user_id").groupBy("user_id", "parts", F.pmod(F.xxhash64("event_id"), F.col("parts")).alias("part")).agg(F.array_sort(F.collect_list("event_id")).alias("ids"))
    back = parts.select("user_id", "parts", F.explode("ids").alias("event_id"))
    return back.groupBy("user_id").agg(F.count("*").alias("n"), F.max("parts").cast("long").alias("parts"), F.sum("event_id").alias("total"))
