"""The text and estimate rules on written-out cases."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions import pages, text
from tidemark.operators import estimates, evidence, lookups

CASES = {}


def given(schema, rows, names, expected):
    """Adds a case: the function on the rows gives the expected rows, whose columns `names` lists."""

    def add(f):
        CASES[f.__name__] = (f, schema, rows, [n.strip(' "') for n in names.split(",")], expected)
        return f

    return add


def one(f, cases):
    """A case on one text column, keyed by the text itself."""
    given("raw string", [(k,) for k in cases], "raw, out", list(cases.items()))(f)


def variant_rules(df):
    return df.select("raw", text.classify_variant(text.normalize_name(F.col("raw"))).alias("out"))


one(variant_rules, {
    "Volvo S60": "performance/s", "Volvo S 60": "performance/s", "BMW M 3": "performance/m", "Honda Civic Type R": "performance/perf", "Subaru WRX STI": "performance/perf",
    "Hyundai i30 N": "performance/perf", "Mercedes-AMG GT Coupe": "performance/amg", "Audi RS 6 Avant": "performance/rs", "Ford Mondeo Estate": "body_style/wagon", "BMW 3 Touring": "body_style/wagon",
    "VW Eos Convertible": "body_style/cabrio", "Fiat 124 Spider": "body_style/cabrio", "Mazda MX-5 Roadster": "body_style/cabrio", "Tesla Fastback": "body_style/fastback", "CLA Shooting Brake": "body_style/shooting_brake",
    "Toyota Corolla Sedan": "base", "Golf": "base",
})


def clean_rules(df):
    return df.select("raw", text.clean_generation(F.col("raw")).alias("out"))


one(clean_rules, {
    "null": "I", "—": "I", "--": "I", "Dominant": "I", " n/a ": "I", "Mk4 (6J)": "Mk4 (6J", "Mk1 (2007)": "Mk1", "XP150 / South India)": "XP150", "XP150 / India": "XP150 / India", "A â€“ B": "A - B", "A – B;": "A - B", "II": "II",
})


def short_gen_name(df):
    return df.select("raw", text.short_generation(F.col("raw")).alias("out"))


one(short_gen_name, {
    "Golf mark vii (2012-2019)": "MkVII", "Mk 4": "Mk4", "Second generation (2004)": "II", "A3 Sportback 8Y": "A3", "W177 since 2018": "W177", "some heading (with a note)": "some heading",
    "a heading that goes on for more than thirty-two characters": "a heading that goes on for more …",
})


@given("raw string", [(x,) for x in ("made 1960-1970 Mk (1990 - heute)", "(2004–2012)", "(facelift; 2004 — present)", "2004-2012 then (x)", "from 1999 - aktuell", "(2019-)", "no years")], "raw, \"start\", \"end\"", [
    ("made 1960-1970 Mk (1990 - heute)", 1990, None), ("(2004–2012)", 2004, 2012), ("(facelift; 2004 — present)", 2004, None), ("2004-2012 then (x)", 2004, 2012), ("from 1999 - aktuell", 1999, None), ("(2019-)", 2019, None), ("no years", None, None),
])
def year_range_rules(df):
    start, end = text.year_range(F.col("raw"))
    return df.select("raw", start.cast("long").alias("start"), end.cast("long").alias("end"))


@given("name string", [("Golf",), ("A5 Sportback",), ("Eos Cabrio",), ("Audi RS 6",), ("Volvo S60",), ("Mondeo Estate",)], "name, eu_low, eu_mid, eu_high, world_low, world_mid, world_high", [
    ("Golf", 0.15, 0.25, 0.35, 0.12, 0.22, 0.32), ("A5 Sportback", 0.25, 0.35, 0.45, 0.22, 0.32, 0.42), ("Eos Cabrio", 0.06, 0.12, 0.18, 0.05, 0.1, 0.15),
    ("Audi RS 6", 0.06, 0.12, 0.2, 0.05, 0.11, 0.18), ("Volvo S60", 0.05, 0.1, 0.18, 0.04, 0.09, 0.16), ("Mondeo Estate", 0.2, 0.3, 0.4, 0.18, 0.28, 0.36),
])
def variant_share_priors(df):
    p = estimates.share_priors(text.classify_variant(text.normalize_name(F.col("name"))))
    return df.select("name", *[p[r][s].alias(f"{r}_{s}") for r in ("eu", "world") for s in ("low", "mid", "high")])


@given("rank int, presence int", [(1, 5), (10, 0), (30, 1), (60, 1), (61, 9), (None, 5), (None, 1), (None, 0)], "rank, presence, low, high", [
    (1, 5, 0.25, 0.85), (10, 0, 0.25, 0.85), (30, 1, 0.15, 0.65), (60, 1, 0.08, 0.5), (61, 9, 0.03, 0.35), (None, 5, 0.08, 0.6), (None, 1, 0.04, 0.4), (None, 0, 0.01, 0.25),
])
def share_bands(df):
    band = estimates.share_band(F.col("rank"), F.col("presence"))
    return df.select(F.col("rank").cast("long").alias("rank"), F.col("presence").cast("long").alias("presence"), band["low"].alias("low"), band["high"].alias("high"))


@given("name string, is_key boolean", [("audi a6", True), ("bmw 3 series", True), ("volkswagen passat", True), ("mercedes c class", True), ("Audi S6", False), ("Audi RS 6 Avant", False), ("BMW M3", False), ("Volkswagen Pasat Estate", False), ("Mercedes-AMG C Class", False), ("Kia Ceed", False), ("BMW 3 Sedan", False), ("Audi 6 Saloon", False), ("Audi S 6 suv", False), ("BMW M 3 ute", False)], "name, parent", [
    ("BMW 3 Sedan", "bmw 3 series"), ("Audi 6 Saloon", "audi a6"), ("Audi S 6 suv", "audi a6"), ("BMW M 3 ute", "bmw 3 series"),
    ("Audi S6", "audi a6"), ("Audi RS 6 Avant", "audi a6"), ("BMW M3", "bmw 3 series"), ("Volkswagen Pasat Estate", "volkswagen passat"), ("Mercedes-AMG C Class", "mercedes c class"), ("Kia Ceed", None),
])
def parent_key_resolve(df):
    return estimates.resolve_parents(df.where("not is_key").select("name"), df.where("is_key").select(F.col("name").alias("key")))


@given("name string, is_key boolean", [("opel corsa 5", True), ("opel corsa 6", True), ("opel corsa", True), ("fiat panda", True), ("opel corsa 5x", False), ("opel corsa 7", False), ("piat panda", False), ("kia rio", False)], "query, match", [
    ("opel corsa 5x", "opel corsa 5"), ("opel corsa 7", "opel corsa 5"), ("piat panda", "fiat panda"),
])
def fuzzy_name_rules(df):
    """A query's digits bind only where some key has the same; the first letter does not."""
    return lookups.best_match(df.where("not is_key").select(F.col("name").alias("query")), df.where("is_key").select(F.col("name").alias("key"))).select("query", "match")


@given("model string, end int, text string", [("a", 2025, "Production ended in 2025."), ("b", 2025, "Facelift 2026 shown"), ("c", 2025, "nothing"), ("d", 2024, "facelift 2026"), ("e", 2025, "MY2026"), ("f", 2025, None)], "model, \"end\"", [
    ("a", 2025), ("b", 2027), ("c", 2026), ("d", 2024), ("e", 2026), ("f", 2026),
])
def continuation_2025(df):
    return estimates.continued_end(df.select("model", "end"), df.select("model", "text"))


_CASE = "id string, eu long, world long, parent string, parent_eu long, parent_world long, variant string, has_history boolean, web_eu long, web_world long, rank int, presence int"


@given(_CASE, [
    ("local", 900, 5_000_000, None, None, None, "base", False, 1, 1, 5, 3),
    ("derived", None, None, "golf", 1000, 3000, "base", False, None, None, None, 0),
    ("too small", 100, 900, "golf", 1000, 3000, "base", True, None, None, 5, 3),
    ("large", 300, 900, "golf", 1000, 3000, "base", True, None, None, 5, 3),
    ("web", None, None, None, None, None, "base", False, 700, None, 40, 2),
    ("history", None, None, None, None, None, "base", True, 700, 800, None, 0),
    ("eu only", 850, None, None, None, None, "base", False, None, None, 5, 3),
], "id, eu_exact, world_exact, eu_low, eu_high, world_low, world_high", [
    ("local", 900, 3_000_000, None, None, None, None),
    ("derived", 250, 660, 150, 350, 360, 960),
    ("too small", 250, 900, 150, 350, 360, 960),
    ("large", 300, 900, 150, 350, 360, 960),
    ("web", 700, None, None, None, 1400, 8750),
    ("history", None, None, None, None, None, None),
    ("eu only", 850, None, None, None, 1000, 3400),
])
def build_constraints(df):
    return estimates.constraints(df).select("id", *[F.col(c).cast("long").alias(c) for c in ("eu_exact", "world_exact", "eu_low", "eu_high", "world_low", "world_high")])


_PAGES = [
    ("headings", "<h2>First generation (2004-2012)</h2><h3>Mk 2 (2012-present)</h3><h2>Reception (1)</h2><h1>Third generation (1990-1991)</h1>"),
    ("fulltext", "<h2>History</h2><p>The Second generation mk2 facelift (2004-2012) was long. Mk 3 sedan (code; 2012–present) followed.</p>"),
    ("infobox", '<table class="infobox x"><tr><th>Maker</th><td>y</td></tr><tr><th>Production</th><td><b>1999</b> - 2003</td></tr></table>'),
    ("nothing", "<h2>See also</h2>"),
]


@given("page string, html string", _PAGES, "page, place, label, \"start\", \"end\", source", [
    ("headings", 0, "First generation (2004-2012)", 2004, 2012, "heading"), ("headings", 1, "Mk 2 (2012-present)", 2012, None, "heading"),
    ("fulltext", 0, "History The Second generation mk2 facelift", 2004, 2012, "fulltext"), ("fulltext", 1, "was long. Mk 3 sedan", 2012, None, "fulltext"),
    ("infobox", 0, "Infobox production/model years", 1999, 2003, "infobox"),
])
def html_cascade(df):
    rows = df.select("page", F.posexplode(pages.generation_windows(F.col("html"))).alias("place", "w"))
    return rows.select("page", F.col("place").cast("long").alias("place"), F.regexp_replace("w.label", r"^[ .]+", "").alias("label"), F.col("w.start").cast("long").alias("start"), F.col("w.end").cast("long").alias("end"), "w.source")


@given("raw string", [('{"a": 1}',), ('Here: ```json\n{"b": {"c": 2}}\n``` done',), ("no json",)], "raw, doc", [
    ('{"a": 1}', '{"a": 1}'), ('Here: ```json\n{"b": {"c": 2}}\n``` done', '{"b": {"c": 2}}'), ("no json", None),
])
def fenced_json(df):
    return df.select("raw", text.fenced_json(F.col("raw")).alias("doc"))


@given("raw string, path string", [('{"a": {"b": {"c": "x"}}}', "$.a.b.c"), ('{"a": {"b": null}}', "$.a.b.c"), ('{"a": 3}', "$.a.b"), (None, "$.a")], "raw, path, found", [
    ('{"a": {"b": {"c": "x"}}}', "$.a.b.c", "x"), ('{"a": {"b": null}}', "$.a.b.c", None), ('{"a": 3}', "$.a.b", None), (None, "$.a", None),
])
def dotted_path(df):
    return df.select("raw", "path", F.expr("get_json_object(raw, path)").alias("found"))


_BLOBS = "ask long, model string, generation string, year int, place int, text string, url string"


@given(_BLOBS, [
    (1, "Golf", "mk7", 2013, 0, "Golf mk7 sales in Europe 2013: 450,000 units", "u0"),
    (1, "Golf", "mk7", 2013, 1, "Worldwide Golf mark 7 deliveries 2013 reached 900,000", "u1"),
    (1, "Golf", "mk7", 2013, 2, "Golf mk7 monthly sales Europe 2013 460,000", "u2"),
    (1, "Golf", "mk7", 2013, 3, "Golf sales in Europe 2013: 999,000 units", "u3"),
    (1, "Golf", "mk7", 2013, 4, "Golf mk7 in Europe 2013: 999,000", "u4"),
    (2, "Fiat Panda", None, 2012, 0, "Panda registrations uk 2012: 15,000 units", "u0"),
    (2, "Fiat Panda", None, 2012, 1, "Fiat Panda sold 12,000 in 2012", "u1"),
    (2, "Fiat Panda", None, 2012, 2, "Fiat Panda sold 12,000 in 2012", "u2"),
    (3, "Kia Rio", "", 2012, 0, "no figures of sales", None),
    (4, "Kia Rio", "", 2012, 0, "global shipments of 31 250 000 and 1\t200\t000, uk", None),
], "ask, region, value, url, is_model_level", [
    (1, "europe", 450_000, "u0", True), (1, "world", 900_000, "u1", True), (2, "europe", 12_000, "u1", True), (4, "europe", 1_200_000, None, False), (4, "world", 1_200_000, None, False),
])
def best_numbers(df):
    return evidence.best_numbers(df).select("ask", "region", "value", "url", "is_model_level")


@given("raw string", [
    ('{"answer_box": {"a": "10 units", "n": 5, "p": "price 3"}, "knowledge_graph": {"b": "made"}, "search_metadata": {"google_url": "g"}, "organic_results": [{"title": "T", "snippet": "s", "link": "l"}, {"title": "costs $3"}, {"link": "x"}, {"snippet": "only"}]}',),
    ('{"organic_results": [' + ", ".join('{"title": "t"}' for _ in range(12)) + "]}",), ("no json",),
], "source, text, url, n", [("answer_box", "10 units", "g", 1), ("knowledge_graph", "made", "g", 1), ("organic", "T\ns", "l", 1), ("organic", "only", "", 1), ("organic", "t", "", 10)])
def search_blobs(df):
    rows = df.select(F.explode(evidence.text_blobs(F.col("raw"))).alias("b")).select("b.*")
    return rows.groupBy("source", "text", "url").agg(F.count("*").alias("n"))


_MK7 = '"Golf" ("7th generation" OR "Mk7" OR "mark 7" OR "mk 7" OR "mk7") 2013 '


@given("model string, generation string, year int", [("Golf", " Mk7", 2013), ("Rio", None, 2012)], "model, place, search", [
    ("Golf", 0, _MK7 + "sales europe -price -msrp -€ -$"), ("Golf", 1, _MK7 + "registrations europe -price -msrp -€ -$"), ("Golf", 2, _MK7 + "global sales -price -msrp -€ -$"),
    ("Golf", 3, _MK7 + "worldwide sales -price -msrp -€ -$"), ("Golf", 4, 'site:carsalesbase.com "Golf" 2013 sales'), ("Golf", 5, 'site:acea.auto "Golf" 2013 registrations'), ("Golf", 6, 'site:marklines.com "Golf" 2013 sales'),
    ("Rio", 0, '"Rio" 2012 sales europe -price -msrp -€ -$'), ("Rio", 1, '"Rio" 2012 registrations europe -price -msrp -€ -$'), ("Rio", 2, '"Rio" 2012 global sales -price -msrp -€ -$'), ("Rio", 3, '"Rio" 2012 worldwide sales -price -msrp -€ -$'),
    ("Rio", 4, 'site:carsalesbase.com "Rio" 2012 sales'), ("Rio", 5, 'site:acea.auto "Rio" 2012 registrations'), ("Rio", 6, 'site:marklines.com "Rio" 2012 sales'),
])
def search_queries(df):
    rows = df.select("model", F.posexplode(evidence.search_queries(F.col("model"), F.col("generation"), F.col("year"))).alias("place", "search"))
    return rows.withColumn("place", F.col("place").cast("long"))


@given("prior long, total long", [(12000, 340000), (None, 1500), (0, None), (7, 0)], "prior, total, note", [
    (12000, 340000, "EU seed may be small vs 10% prior-gen avg 12,000 & 5% model EU 340,000"), (None, 1500, "EU seed may be small vs 5% model EU 1,500"), (0, None, None), (7, 0, "EU seed may be small vs 10% prior-gen avg 7"),
])
def plausibility_note(df):
    return df.withColumn("note", evidence.plausibility(F.col("prior"), F.col("total")))


@given("ask long, detected string, year int, start int, `end` int, generation string", [
    (1, "Mk 7", 2013, 2012, 2019, "VII"), (1, "Mk 7", 2014, 2012, 2019, "VII"), (1, "Mk 7", 2011, 2012, 2019, "VI"),
    (2, "Mk 7", 2013, 2012, 2019, "mk7"), (2, "Mk 7", 2014, 2012, 2019, "VII"),
    (3, "x", 2013, 2012, 2019, "A"), (3, "x", 2014, 2012, 2019, "B"), (4, "x", 2013, 2012, 2019, None),
    *[(5, "x", 2012 + i, 2012, 2022, "B" if i < 7 else "A") for i in range(10)],
], "ask, alias", [(1, "vii"), (2, None), (3, None), (4, None), (5, "b")])
def local_alias_rules(df):
    return evidence.local_alias(df)


def shown(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(CASES))
def test_rule(spark, name):
    f, schema, rows, names, expected = CASES[name]
    out = f(spark.createDataFrame(rows, schema))
    assert sorted(out.columns) == sorted(names)
    assert shown(out.select(*[f"`{n}`" for n in names]).collect()) == shown(expected)
