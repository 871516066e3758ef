"""Queries of the estimator, the text rules and the nested outputs, each with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import markup, numbers, text
from ..operators import evidence, scoring
from ..storage import stored
from .queries import WITH, query, sales, table


def _parts(spark, d) -> DataFrame:
    return table(spark, d, "part").withColumn("mk", F.concat(F.lit("Mk "), (F.col("p_size") % 12 + 1).cast("string")))


@query(f"{WITH} select model, generation, units from local_sales where year = 1998")
def src_region_scan(spark, d):
    return sales(spark, d, True).where("year = 1998").select("model", "generation", "units")


@query("select doc_id, cast(coalesce(quality, toxic, -1) as bigint) as mark from documents left join labels using (doc_id)")
def coalesce_default(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").select("doc_id", F.coalesce("quality", "toxic", F.lit(-1)).cast("long").alias("mark"))


@query("select event_id, coalesce(try_cast(json_extract_string(props, '$.k') as bigint), 0) as k, coalesce(try_cast(event_type as bigint), 0) as bad from events")
def numeric_coerce(spark, d):
    number = lambda c: F.coalesce(c.try_cast("bigint"), F.lit(0))
    return table(spark, d, "events").select("event_id", number(F.get_json_object("props", "$.k")).alias("k"), number(F.col("event_type")).alias("bad"))


@query("select distinct trim(w) as word from (select unnest(string_split(p_name, ' ')) as w from part) where trim(w) <> ''")
def str_split_explode(spark, d):
    return table(spark, d, "part").select(F.explode(F.transform(F.split("p_name", " "), lambda x: F.trim(x))).alias("word")).where("word <> ''").distinct()


@query("select p_partkey, regexp_extract(n, '^(20[0-9][0-9]) (EU|World)$', 1) as year, regexp_extract(n, '^(20[0-9][0-9]) (EU|World)$', 2) as region from (select p_partkey, '20' || p_size || case when p_size % 2 = 0 then ' EU' when p_size % 3 = 0 then ' World' else ' Other' end as n from part) where regexp_matches(n, '^20[0-9][0-9] (EU|World)$')")
def sheet_name_parse(spark, d):
    tail = F.when(F.col("p_size") % 2 == 0, " EU").when(F.col("p_size") % 3 == 0, " World").otherwise(" Other")
    names = table(spark, d, "part").select("p_partkey", F.concat(F.lit("20"), F.col("p_size").cast("string"), tail).alias("n"))
    pattern = "^(20[0-9][0-9]) (EU|World)$"
    return names.where(F.rlike("n", F.lit(pattern))).select("p_partkey", F.regexp_extract("n", pattern, 1).alias("year"), F.regexp_extract("n", pattern, 2).alias("region"))


@query("select cast(unnest(range(min(year(o_orderdate)), max(year(o_orderdate)) + 1)) as bigint) as year from orders")
def year_sequence(spark, d):
    span = table(spark, d, "orders").agg(F.min(F.year("o_orderdate")).alias("a"), F.max(F.year("o_orderdate")).alias("b"))
    return span.select(F.explode(F.sequence(F.col("a").cast("long"), F.col("b").cast("long"))).alias("year"))


@query("with g as (select p_brand as model, count(distinct p_type) as generations from part group by 1) select *, round_even((rank() over (order by generations) + (count(*) over (partition by generations) - 1) / 2.0) / count(*) over () * 20, 0) as score from g")
def gen_count_score(spark, d):
    per = table(spark, d, "part").groupBy(F.col("p_brand").alias("model")).agg(F.countDistinct("p_type").alias("generations"))
    return per.withColumn("score", numbers.percentile_score(F.col("generations")))


@query("select c_custkey, round_even((rank() over (order by c_acctbal) + (count(*) over (partition by c_acctbal) - 1) / 2.0) / count(*) over () * 20, 0) as score from customer")
def pct_rank_score(spark, d):
    rows = scoring.percentile_by_buckets(table(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", F.floor("c_acctbal"))
    return rows.select("c_custkey", F.rint(F.col("pct") * 20).alias("score"))


@query("select c_custkey, cast(case when c_acctbal > 0 then 20 else 10 end as bigint) as credit, cast(case when c_mktsegment = 'BUILDING' then 10 else 20 end as bigint) as kind from customer")
def score_case_map(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.when(F.col("c_acctbal") > 0, 20).otherwise(10).cast("long").alias("credit"), F.when(F.col("c_mktsegment") == "BUILDING", 10).otherwise(20).cast("long").alias("kind"))


@query("select p_partkey, cast(case when coalesce(f.ev, false) then 10 else 20 end as bigint) as score from part left join (select p_type, min(p_size) < 2 as ev from part group by 1 having count(*) > 1) f using (p_type)")
def bev_score_lookup(spark, d):
    part = table(spark, d, "part")
    flags = part.groupBy("p_type").agg((F.min("p_size") < 2).alias("ev"), F.count("*").alias("n")).where("n > 1")
    return part.join(flags, "p_type", "left").select("p_partkey", F.when(F.coalesce("ev", F.lit(False)), 10).otherwise(20).cast("long").alias("score"))


@query("select doc_id, cast(coalesce(quality, 0) + coalesce(toxic, 0) as double) as total from documents left join labels using (doc_id)")
def row_sum_skipna(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return rows.select("doc_id", numbers.sum_skipping_nulls(F.col("quality").cast("double"), F.col("toxic").cast("double")).alias("total"))


@query("select c_custkey, case when c_acctbal / 100 >= 80 then 'Top priority' when c_acctbal / 100 >= 60 then 'High' when c_acctbal / 100 >= 40 then 'Medium' else 'Low' end as tier from customer")
def tier_label(spark, d):
    return table(spark, d, "customer").select("c_custkey", numbers.tier(F.col("c_acctbal") / 100).alias("tier"))


@query("select c_custkey, s_suppkey from customer join supplier on regexp_replace(c_name, '[^0-9]', '', 'g') = regexp_replace(s_name, '[^0-9]', '', 'g')")
def exact_key_match(spark, d):
    key = lambda c: F.regexp_replace(c, "[^0-9]", "")
    a = table(spark, d, "customer").select("c_custkey", key("c_name").alias("key"))
    return a.join(table(spark, d, "supplier").select("s_suppkey", key("s_name").alias("key")), "key").select("c_custkey", "s_suppkey")


@query("select c_custkey, array_to_string(list_sort(list_distinct(list_filter(string_split(k, ' '), lambda x: regexp_matches(x, '^[a-z]*[0-9]+$')))), ' ') as block from (select c_custkey, trim(regexp_replace(regexp_replace(lower(c_name), '[/-]', ' ', 'g'), '[^a-z0-9\\s]', ' ', 'g')) as k from customer)")
def digit_token_block(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.array_join(text.digit_tokens(text.normalize_name(F.col("c_name"))), " ").alias("block"))


@query("select o_custkey, count(distinct year(o_orderdate)) as years from orders group by 1")
def presence_count(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.countDistinct(F.year("o_orderdate")).alias("years"))


@query("with t as (select c_nationkey, count(*) as n from customer group by 1), p as (select n_regionkey, sum(n) as n from t join nation on c_nationkey = n_nationkey group by 1) select n_name, coalesce(t.n, 0) as own, cast(coalesce(p.n, 0) as bigint) as parent from nation left join t on c_nationkey = n_nationkey left join p using (n_regionkey)")
def parent_totals(spark, d):
    own = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("own"))
    nation = table(spark, d, "nation").join(own, "n_nationkey", "left").withColumn("own", F.coalesce("own", F.lit(0)))
    parent = nation.groupBy("n_regionkey").agg(F.sum("own").alias("parent"))
    return nation.join(parent, "n_regionkey", "left").select("n_name", "own", "parent")


@query(f"{WITH} select model, generation, year, units, case when year = 1996 then 'exact' else 'history' end as source from local_sales where year between 1996 and 1999")
def local_seed_history(spark, d):
    return sales(spark, d, True).where("year between 1996 and 1999").withColumn("source", F.when(F.col("year") == 1996, "exact").otherwise("history"))


@query("select o_orderkey, coalesce(year(o_orderdate) between c_nationkey + 1990 and c_nationkey + 1996, false) as active from orders left join customer on o_custkey = c_custkey and c_acctbal > 0")
def between_flag(spark, d):
    some = table(spark, d, "customer").where("c_acctbal > 0")
    start = F.col("c_nationkey") + 1990
    rows = table(spark, d, "orders").join(some, F.col("o_custkey") == F.col("c_custkey"), "left")
    return rows.select("o_orderkey", F.coalesce(F.year("o_orderdate").between(start, start + 6), F.lit(False)).alias("active"))


@query(f"{WITH}, a as (select year, cast(sum(units) as bigint) as world from sales group by 1), b as (select year, cast(sum(units) as bigint) as europe from local_sales where year > 1996 group by 1) select a.year, world, europe from a left join b using (year)")
def join_left_estimates(spark, d):
    world = sales(spark, d).groupBy("year").agg(F.sum("units").alias("world"))
    europe = sales(spark, d, True).where("year > 1996").groupBy("year").agg(F.sum("units").alias("europe"))
    return world.join(europe, "year", "left")


_STOPS = "select o_custkey, min(year(o_orderdate)) as s, max(case when o_orderstatus = 'F' then year(o_orderdate) end) as stop from orders group by 1"


@query(f"select o_custkey, cast(case when stop is not null then greatest(least(stop, 1999), s) else least(greatest(2001, s + 4), 2035) end as bigint) as until from ({_STOPS})")
def continuation_resolve(spark, d):
    """End of an open window: a stop that was seen, else two years ahead or four from the start, at most 2035."""
    year = F.year("o_orderdate")
    rows = table(spark, d, "orders").groupBy("o_custkey").agg(F.min(year).alias("s"), F.max(F.when(F.col("o_orderstatus") == "F", year)).alias("stop"))
    seen = F.greatest(F.least("stop", F.lit(1999)), "s")
    return rows.select("o_custkey", F.when(F.col("stop").isNotNull(), seen).otherwise(F.least(F.greatest(F.lit(2001), F.col("s") + 4), F.lit(2035))).cast("long").alias("until"))


@query("select doc_id, case when quality is not null then 'label' when lang = 'en' then 'language' else 'default' end as origin from documents left join labels using (doc_id)")
def priority_cascade(spark, d):
    """The first source that knows a document; the sources are a union ranked by priority."""
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    known = docs.join(labels.where("quality is not null"), "doc_id", "left_semi")
    found = [docs.select("doc_id", F.struct(F.lit(3).alias("rank"), F.lit("default").alias("origin")).alias("x")), docs.where("lang = 'en'").select("doc_id", F.struct(F.lit(2).alias("rank"), F.lit("language").alias("origin"))), known.select("doc_id", F.struct(F.lit(1).alias("rank"), F.lit("label").alias("origin")))]
    return found[0].union(found[1]).union(found[2]).groupBy("doc_id").agg(F.min("x.rank").alias("rank"), F.min_by("x.origin", "x.rank").alias("origin")).select("doc_id", "origin")


@query("select p_partkey, case p_size % 3 when 0 then 'Mazda Cx ' || p_size when 1 then 'Fiat Abarth 500 (+500E)' else 'Id.4 ' || upper(p_type[1]) || lower(p_type[2:]) end as name from part")
def title_case_tidy(spark, d):
    n = F.col("p_size").cast("string")
    raw = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("mazda CX-"), n)).when(F.col("p_size") % 3 == 1, "Fiat/Abarth 500 (+500e)").otherwise(F.concat(F.lit("id.4  "), "p_type"))
    return table(spark, d, "part").select("p_partkey", text.title_case_tidy(raw).alias("name"))


@query("select p_partkey, lower(p_type) || ' mk' || p_size as key from part")
def normalize_generation_key(spark, d):
    raw = F.concat("p_type", F.lit(" (MK  "), F.col("p_size").cast("string"), F.lit(")"))
    return table(spark, d, "part").select("p_partkey", text.normalize_generation_key(raw).alias("key"))


@query("select p_partkey, case p_size % 3 when 0 then 'I' when 1 then p_type else p_type || ' - B' end as label from part")
def clean_generation(spark, d):
    raw = F.when(F.col("p_size") % 3 == 0, "n/a").when(F.col("p_size") % 3 == 1, F.concat("p_type", F.lit(" (2007)"))).otherwise(F.concat("p_type", F.lit(" – B;")))
    return table(spark, d, "part").select("p_partkey", text.clean_generation(raw).alias("label"))


@query("select p_partkey, unnest(list_sort(['Mk ' || n, 'mk' || n, 'mk ' || n, 'mark ' || n, n || 'th generation'])) as alias from (select p_partkey, p_size % 12 + 1 as n from part)")
def alias_expand(spark, d):
    return _parts(spark, d).select("p_partkey", F.explode(evidence.generation_aliases(F.col("mk"))).alias("alias"))


@query("select p_partkey, unnest([p_name || ' sales by year', p_name || ' ' || p_type || ' units sold', 'site:example.org ' || p_name]) as search from part")
def query_template(spark, d):
    name, kind = F.col("p_name"), F.col("p_type")
    return table(spark, d, "part").select("p_partkey", F.explode(F.array(F.concat(name, F.lit(" sales by year")), F.concat_ws(" ", name, kind, F.lit("units sold")), F.concat(F.lit("site:example.org "), name))).alias("search"))


@query("select p_partkey, p_name as search from part")
def sanitize_query(spark, d):
    """Generation and year words go from a search text."""
    raw = F.concat("p_name", F.lit(" mk"), F.col("p_size").cast("string"), F.lit(" (2004-2012) 2015"))
    bare = F.regexp_replace(raw, r"(?i)\bmk\s?[0-9]+\b|\([^)]*\)|\b(19|20)[0-9]{2}\b", " ")
    return table(spark, d, "part").select("p_partkey", text.collapse_ws(bare).alias("search"))


@query("select p_partkey, case when p_size % 2 = 0 then 'Mk' || p_size else 'GEN' end as label from part")
def mk_label(spark, d):
    raw = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("the mk "), F.col("p_size").cast("string"), F.lit(" car"))).otherwise(F.col("p_type"))
    token = F.regexp_extract(raw, r"(?i)\bmk\s?([0-9a-z]+)\b", 1)
    return table(spark, d, "part").select("p_partkey", F.when(token != "", F.concat(F.lit("Mk"), F.upper(token))).otherwise("GEN").alias("label"))


@query("select doc_id, lang, count(*) as n, cast(sum(length(substr(line, strpos(line, ': ') + 2))) as bigint) as said from (select doc_id, lang, unnest(string_split(replace(text, '. ', ': '), chr(10))) as line from documents) where contains(line, ': ') group by 1, 2")
def prefix_parse(spark, d):
    """Lines that have a prefix, and what follows it; a sentence's end stands for the colon."""
    said = F.replace("text", F.lit(". "), F.lit(": "))
    lines = table(spark, d, "documents").select("doc_id", "lang", F.explode(F.split(said, "\n")).alias("line"))
    rest = F.expr("substr(line, instr(line, ': ') + 2)")
    return lines.where(F.contains("line", F.lit(": "))).groupBy("doc_id", "lang").agg(F.count("*").alias("n"), F.sum(F.length(rest)).cast("long").alias("said"))


@query("select c_custkey, 'units ' || format('{:,}', cast(floor(c_acctbal) as bigint)) || ': ' || substr(c_name, 1, 12) as badge from customer")
def badge_format(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.concat(F.lit("units "), F.format_number(F.floor("c_acctbal"), 0), F.lit(": "), F.substring("c_name", 1, 12)).alias("badge"))


@query("select doc_id, case when (select bool_and(toxic in (0, 1)) from labels) then case toxic when 1 then 'VRAI' when 0 then 'FAUX' end else cast(toxic as varchar) end as shown from labels")
def bool_localize(spark, d):
    """Truth words only where every value of the column is one; the check is a single row."""
    labels = table(spark, d, "labels")
    check = labels.agg(F.bool_and(F.lower(F.col("toxic").cast("string")).isin("true", "false", "vrai", "faux", "1", "0")).alias("plain"))
    shown = F.when(F.col("plain"), F.when(F.col("toxic") == 1, "VRAI").when(F.col("toxic") == 0, "FAUX")).otherwise(F.col("toxic").cast("string"))
    return labels.join(F.broadcast(check)).select("doc_id", shown.alias("shown"))


@query("select p_partkey, cast(1990 + p_size % 20 as bigint) as start, cast(case when p_size % 2 = 0 then 2015 end as bigint) as \"end\" from part")
def extract_year_range(spark, d):
    first = (F.col("p_size") % 20 + 1990).cast("string")
    raw = F.concat(F.lit("made 1960-1970, Mk ("), first, F.when(F.col("p_size") % 2 == 0, " – 2015)").otherwise("–present)"))
    start, end = text.year_range(raw)
    return table(spark, d, "part").select("p_partkey", start.cast("long").alias("start"), end.cast("long").alias("end"))


@query("select page_id, len(regexp_extract_all(html, '(?is)<h1[^>]*>[^<]*(?:the|mk|gen)', 0)) > 0 as hit from pages")
def heading_classify(spark, d):
    return table(spark, d, "pages").select("page_id", F.rlike("html", F.lit("(?is)<h1[^>]*>[^<]*(?:the|mk|gen)")).alias("hit"))


@query("select page_id, 'from ' || page_id as years from pages")
def html_table_kv(spark, d):
    html = F.concat(F.lit("<table><tr><th>Maker</th><td>x</td></tr><tr><th scope='row'>Production</th>\n<td><b>from</b> "), F.col("page_id").cast("string"), F.lit("</td></tr></table>"))
    return table(spark, d, "pages").select("page_id", markup.table_value(html, "Production").alias("years"))


@query("with t as (select o_orderkey, case when o_totalprice < 50000 then null else o_orderdate end as dated from orders) select o_orderkey, row_number() over (order by dated nulls last, o_orderkey) as place from t")
def sort_nulls_last(spark, d):
    """All orders numbered, those without a date last: range partitions in order, and one offset for each."""
    from pyspark.sql import Window

    at = F.when(F.col("o_totalprice") >= 50000, F.col("o_orderdate"))
    order = [F.asc_nulls_last("at"), F.col("o_orderkey")]
    rows = table(spark, d, "orders").select("o_orderkey", at.alias("at")).repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    rows = stored(rows, "ranges")  # both branches below must see the same parts
    sizes = rows.groupBy("part").agg(F.count("*").alias("n"))  # a row for each partition
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    numbered = rows.withColumn("i", F.row_number().over(Window.partitionBy("part").orderBy(*order))).join(F.broadcast(before), "part")
    return numbered.select("o_orderkey", (F.col("before") + F.col("i")).alias("place"))


@query("select source, arg_min(doc_id, {'a': case when contains(text, '@') then 1 else 0 end, 'b': doc_id}) as doc_id from documents group by 1")
def prefer_first_fallback(spark, d):
    """The first document of a source without a mail address, else its first."""
    return table(spark, d, "documents").groupBy("source").agg(F.min_by("doc_id", F.struct(F.contains("text", F.lit("@")).cast("int"), "doc_id")).alias("doc_id"))


@query("select o_custkey, cast(min(year(o_orderdate)) as bigint) as start, cast(nullif(case when max(year(o_orderdate)) >= 2000 then 9999 else max(year(o_orderdate)) end, 9999) as bigint) as \"end\" from orders group by 1")
def open_end_sentinel(spark, d):
    last = F.max(F.year("o_orderdate"))
    kept = table(spark, d, "orders").groupBy("o_custkey").agg(F.min(F.year("o_orderdate")).cast("long").alias("start"), F.when(last >= 2000, 9999).otherwise(last).cast("long").alias("end"))
    return kept.withColumn("end", F.nullif("end", F.lit(9999)))


@query("with n as (select source, lang, count(*) as n from documents group by 1, 2) select source, arg_min(lang, {'a': case when n >= 20 then 0 else 1 end, 'b': lang}) as lang from n group by 1")
def language_preference(spark, d):
    """The first language with enough documents, else the first with any."""
    per = table(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    return per.groupBy("source").agg(F.min_by("lang", F.struct((F.col("n") < 20).cast("int"), "lang")).alias("lang"))


@query("with s as (select source, doc_id, 10 * (2 * contains(text, 'license')::int + contains(text, '@')::int - contains(text, 'token')::int) + length(text) % 10 as score from documents) select source, arg_min(doc_id, {'a': -score, 'b': doc_id}) as doc_id, cast(max(score) as bigint) as score from s group by 1")
def blob_score_argmax(spark, d):
    """The best document of a source by weighted marks; the first wins a tie."""
    has = lambda w: F.contains("text", F.lit(w)).cast("int")
    score = (F.lit(10) * (2 * has("license") + has("@") - has("token")) + F.length("text") % 10).cast("long")
    best = table(spark, d, "documents").select("source", "doc_id", score.alias("score")).groupBy("source").agg(F.min_by("doc_id", F.struct(-F.col("score"), "doc_id")).alias("doc_id"), F.max("score").alias("score"))
    return best
