"""Sources and sinks on small files in the shapes of the inputs, and rules beyond SQL against plain loops."""

import json
import re
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from tidemark import sinks
from tidemark.functions import text
from tidemark.operators import detection, documents, enforcement, estimation, lookups, publish, regions, support
from tidemark.sources import sales_lists
from tidemark.storage import VersionedTable


LISTS = {
    "Top100_2015.txt": [{"model": "Golf", "generation": "Mk7", "units_sold": 10}, {"name": "Polo", "units_sold": None, "projected_units_2025": 4}, {"model": "", "name": "UP!", "units_sold": 5}, 7, {"model": "GOLF", "units_sold": 12}, {"model": "golf", "units_sold": 12.5}],
    "Top100_2025.txt": [{"rank": 1, "model": "Golf", "generation": "VIII", "projected_units_2025": 7, "estimated": True}],
    "Top100_World_2019.txt": [{"model": "Golf", "generation": "Mk7", "units_sold": 30, "estimated": False, "notes": "x"}],
    "Top100_World_2020.txt": None, "Top100_notes.txt": [], "Top100_2016.txt": {"model": "no list"},
}


def write_lists(folder, names=None):
    for name in names or LISTS:
        (folder / name).write_text("[{ not json" if LISTS[name] is None else json.dumps(LISTS[name]))


def test_lists_of_several_shapes(spark, tmp_path):
    write_lists(tmp_path)
    rows = sales_lists.read_lists(spark, str(tmp_path)).drop("file").collect()
    assert sorted(map(tuple, rows), key=str) == sorted([
        (0, "EU", 2015, "Golf", "Mk7", 10, False), (1, "EU", 2015, "Polo", None, None, False), (2, "EU", 2015, "UP!", None, 5, False), (4, "EU", 2015, "GOLF", None, 12, False), (5, "EU", 2015, "golf", None, None, False),
        (0, "EU", 2025, "Golf", "VIII", 7, True), (0, "World", 2019, "Golf", "Mk7", 30, False),
    ], key=str)


def test_only_the_files_asked_for_are_read(spark, tmp_path):
    write_lists(tmp_path)
    names = lambda rows: sorted(f.rsplit("/", 1)[1] for f in rows.inputFiles())
    assert names(sales_lists.read_lists(spark, str(tmp_path), ("EU",), range(2015, 2016))) == ["Top100_2015.txt"]
    assert names(sales_lists.read_lists(spark, str(tmp_path), ("World",))) == ["Top100_World_2019.txt", "Top100_World_2020.txt"]
    assert [(f.region, f.year) for f in sales_lists.list_files(spark, str(tmp_path))] == [("EU", 2015), ("EU", 2016), ("EU", 2025), ("World", 2019), ("World", 2020)]
    assert sales_lists.read_lists(spark, str(tmp_path), years=range(1990, 1995)).count() == 0
    with pytest.raises(ValueError):
        sales_lists.require_sales(sales_lists.read_lists(spark, f"{tmp_path}/none"))
    assert sales_lists.require_sales(sales_lists.read_lists(spark, str(tmp_path), ("World",))).count() == 1


def test_the_last_record_of_a_key(spark, tmp_path):
    write_lists(tmp_path)
    (tmp_path / "Top100_2015_b.txt").write_text(json.dumps([{"model": "Golf/", "generation": "last", "units_sold": 99}, {"model": "Polo", "units_sold": "9"}]))
    want = {("EU", "golf", 2015, "Golf/", 99), ("EU", "up", 2015, "UP!", 5), ("EU", "golf", 2025, "Golf", 7), ("World", "golf", 2019, "Golf", 30)}
    rows = sales_lists.read_lists(spark, str(tmp_path))
    for mixed in (rows, rows.repartition(7), rows.orderBy(F.desc("record")), rows.union(rows).orderBy(F.rand(3)), rows.coalesce(1)):
        got = sales_lists.keyed_history(mixed).select("region", "key", "year", "model", "units").collect()
        assert len(got) == 4 and {tuple(r) for r in got} == want
    tidy = sales_lists.sales_rows(rows).where("year = 2015").groupBy("model", "generation").agg(F.sum("units").alias("units"), F.count("*").alias("n")).collect()
    assert {tuple(r) for r in tidy} == {("Golf", "VII", 10, 1), ("Golf", "I", 12, 2), ("Polo", "I", 0, 2), ("Up!", "I", 5, 1), ("Golf", "last", 99, 1)}


def test_catalogues(spark, tmp_path):
    (tmp_path / "models.txt").write_text('{\n "Audi A3": {2004: "G1", 2018: "C8",},\n "Audi A3": {2020: "C9"},\n "Kia Rio" : { 2011 : "J", 2011 : "K" },\n}')
    (tmp_path / "models.csv").write_text("key,from_year,code\nAudi A3,2004,G1\n")
    rows = lambda p: sorted(map(tuple, sales_lists.read_catalogue(spark, str(tmp_path / p)).collect()))
    assert rows("models.txt") == [("audi a3", 2004, "G1"), ("audi a3", 2018, "C8"), ("audi a3", 2020, "C9"), ("kia rio", 2011, "K")]
    assert rows("models.csv") == [("audi a3", 2004, "G1")]
    with pytest.raises(ValueError):
        sales_lists.read_catalogue(spark, "models.xls")


def test_sinks_read_back(spark, tmp_path):
    sinks.write_scores(spark.createDataFrame([("b", 20), ("a", 10)], "model string, score int"), f"{tmp_path}/scores")
    assert [(r.model, r.score) for r in spark.read.json(f"{tmp_path}/scores").orderBy("model").collect()] == [("a", 10), ("b", 20)]
    sinks.write_estimates(spark.createDataFrame([(2021, 5, 3, "x"), (2020, 4, 2, "y")], "year int, world_sales_units long, europe_sales_units long, rationale string"), f"{tmp_path}/estimates")
    read = spark.read.option("header", True).csv(f"{tmp_path}/estimates")
    assert read.columns == ["year", "world_sales_units", "europe_sales_units"] and read.count() == 2
    sinks.write_tables({"2020 EU": read, "Summary": read}, f"{tmp_path}/tables")
    assert spark.read.parquet(f"{tmp_path}/tables/2020_EU").count() == 2
    windows = [("Fiat/500", "I", 2004, 2012), ("Fiat/500", "II", 2012, None), ("Golf", "VII", 2012, 2019)]
    sinks.write_windows(spark.createDataFrame(windows, "model string, label string, start int, end int"), f"{tmp_path}/windows")
    assert sorted(map(tuple, sinks.read_windows(spark, f"{tmp_path}/windows").collect()), key=str) == sorted(windows, key=str)
    one = sinks.read_windows(spark, f"{tmp_path}/windows", "Golf")
    assert [tuple(r) for r in one.collect()] == [windows[2]] and "slug=Golf" in "".join(one.inputFiles()) and len(one.inputFiles()) >= 1


def test_generations_are_merged(spark, tmp_path):
    schema = "model string, parent_model string, generations array<struct<name:string,start_year:int,end_year:int>>"
    old = sinks.read_generations(spark, f"{tmp_path}/none")
    assert old.count() == 0
    sinks.upsert_generations(old, spark.createDataFrame([("a", "p", [("I", 1990, 1999)]), ("b", None, [])], schema), f"{tmp_path}/one", today="2025-03-04")
    assert [(r.version, r.updated_at) for r in spark.read.json(f"{tmp_path}/one/meta").collect()] == [(1, "2025-03-04")]
    old = sinks.read_generations(spark, f"{tmp_path}/one")
    sinks.upsert_generations(old, spark.createDataFrame([("a", None, [("II", 2000, None)]), ("c", None, None)], schema), f"{tmp_path}/two")
    rows = {r.model: [tuple(g) for g in r.generations or []] for r in sinks.read_generations(spark, f"{tmp_path}/two").collect()}
    assert rows == {"a": [("II", 2000, None)], "b": [], "c": []}


def test_similar_names_against_all_pairs(spark):
    base = ["golf", "polo", "opel corsa 5", "opel corsa 6", "fiat panda", "kia ceed sw", "audi a6", "abcd", "tesla model 3", "tesla model y"]
    asked = sorted({b[:i] + x + b[j:] for b in base for i in range(len(b)) for j in (i, i + 1) for x in ("", "z")} - {""})
    digits = lambda s: {t for t in s.split() if re.fullmatch("[a-z]*[0-9]+", t)}
    want = {}
    for q in asked:
        same = [k for k in base if digits(q) and digits(k) == digits(q)]
        best = min(same or base, key=lambda k: (-SequenceMatcher(None, q, k).ratio(), k))
        if SequenceMatcher(None, q, best).ratio() >= 0.88:
            want[q] = best
    got = lookups.best_match(spark.createDataFrame([(q,) for q in asked], "query string"), spark.createDataFrame([(k,) for k in base], "key string"))
    assert {r["query"]: r["match"] for r in got.collect()} == want and len(want) > 100


def test_candidate_numbers_against_a_loop(spark):
    cases = ["sold 12,345 and 1.234.567 units", "A1234 and 1234B", "99 999 9999 10000000", "x12 345", "", None, "2,000,000,000"]
    rows = spark.createDataFrame([(c,) for c in cases], "t string").select("t", text.candidate_numbers(F.col("t")).alias("n")).collect()
    for r in rows:
        found = [int(re.sub("[,. ]", "", x)) for x in re.findall(r"(?<![A-Z0-9])([0-9]{1,3}(?:[., ][0-9]{3})+|[0-9]{4,})(?![A-Z0-9])", r.t or "")]
        assert (r.n or []) == [n for n in found if 10 <= n <= 5_000_000]


def test_versions_of_a_cache(spark, tmp_path):
    path = f"{tmp_path}/cache"
    cache = VersionedTable(spark, path, "key long, value long")
    asked, calls = spark.range(10).withColumnRenamed("id", "key"), []

    def compute(missing):
        calls.append(sorted(r.key for r in missing.collect()))
        return missing.select("key", (F.col("key") * len(calls)).alias("value"))

    assert cache.read().count() == 0
    assert cache.refresh(asked.where("key < 4").union(asked.where("key < 4")), "key", compute) == 4
    assert cache.refresh(asked.where("key < 4"), "key", compute) == 0 and calls == [[0, 1, 2, 3]]
    # a run that stops after its rows are written and before the pointer moves
    lost = cache.write_rows(spark.createDataFrame([(100, 100)], "key long, value long"))
    again = VersionedTable(spark, path, "key long, value long")
    assert lost not in again.parts() and sorted(r.key for r in again.read().collect()) == [0, 1, 2, 3]
    before = again.read()
    assert again.refresh(asked, "key", compute) == 6 and calls[1] == [4, 5, 6, 7, 8, 9]
    assert before.count() == 4 and len(again.parts()) == 2  # who read the old version still has it
    assert {r.key: r.value for r in cache.read().collect()} == {k: k * (1 if k < 4 else 2) for k in range(10)}
    assert cache.refresh(asked, "key", compute) == 0 and len(calls) == 2


def test_build_loses_no_document(spark, tmp_path):
    window = '{"label": "Mk 2", "start": "2004", "end": "9999"}'
    bodies = [f'{{"model": "a", "windows": [{window}, {window}]}}', '{"model": "a", "windows": [{"label": null, "start": 1990, "end": 1999}]}', "{", None, '{"windows": [' + window + "]}", '{"model": "b"}', '{"model": "c", "windows": [{"start": "x"}]}', "3"]
    docs = spark.createDataFrame(list(enumerate(bodies)), "key int, body string")
    good, bad = documents.write_build(docs, f"{tmp_path}/build")
    assert {r.key: [tuple(g) for g in r.generations] for r in good.collect()} == {0: [("Mk2", 2004, None)], 1: [("GEN", 1990, 1999)]}
    assert {r.key: r.problem for r in bad.collect()} == {2: "no json", 3: "no document", 4: "no model", 5: "no windows", 6: "empty generations", 7: "no model"}
    assert [(r.model, r.generations[0].name) for r in documents.last_built(good).collect()] == [("a", "GEN")]


def test_workbook(spark, tmp_path):
    sales = [("EU", "Golf", "VII", 2015, 100), ("EU", "Golf", "VII", 2016, 50), ("World", "Golf", "VII", 2015, 300), ("World", "Rio", "I", 2016, 10), ("EU", "Up", "I", 2015, 5)]
    rows = spark.createDataFrame(sales, "region string, model string, generation string, year int, units long")
    tables = regions.workbook(rows, range(2016, 2018), 2017, F.col("model") == "Golf", F.lit(False))
    assert list(tables) == ["Lists", "EU Fleet", "EU Replacements", "World Fleet", "World Replacements", "EU Opportunities", "World Opportunities", "Combined Opportunities"]
    sinks.write_tables(tables, str(tmp_path))
    read = lambda name: spark.read.parquet(f"{tmp_path}/{name}")
    assert {(r.model, r["2016"], r["2017"]) for r in read("EU_Fleet").collect()} == {("Golf", 145, 137), ("Up", 5, 5)}
    both = read("Combined_Opportunities")
    assert both.columns == list(regions.OPPORTUNITY)
    assert {(r.model, r.future_stock, r.years_in_list, r.years_score) for r in both.collect()} == {("Golf", 268, 2, 20.0), ("Rio", 10, 1, 10.0), ("Up", 5, None, None)}


def smoothed(rows, cap):
    """The rule as a plain loop: year, world, europe, zero."""
    out = []
    for c in (1, 2):
        last = [max(0, rows[0][c])]
        for i in range(1, len(rows)):
            since = rows[i][0] - rows[0][0]
            growth = 0.35 if since == 1 else 0.12 if since <= 3 else 0.05 if since <= 5 else -0.08
            last.append(0 if rows[i][3] else int(max(0, 0.6 * round(last[-1] * (1 + growth)) + 0.4 * rows[i][c])))
        out.append(last)
    world = [min(max(0, w), cap) for w in out[0]]
    return [(r[0], w, min(max(0, e), w)) for r, w, e in zip(rows, world, out[1])]


def test_smoothing_against_a_loop(spark):
    import random

    rng = random.Random(4)
    models = {f"m{k}": [(2010 + i, rng.randrange(-5, 5000), rng.randrange(-5, 5000), rng.random() < 0.2 and i > 0) for i in sorted(rng.sample(range(12), rng.randrange(1, 12)))] for k in range(40)}
    rows = [(m, *r) for m, rs in models.items() for r in rs]
    got = enforcement.smooth_pair(spark.createDataFrame(rows, "model string, year int, world long, europe long, zero boolean").repartition(5), 3000)
    assert {(r.model, r.year, r.world, r.europe) for r in got.collect()} == {(m, *r) for m, rs in models.items() for r in smoothed(rs, 3000)}


def test_enforcement_of_each_kind(spark):
    estimates = [("a", 2020, 500, 400, "guess"), ("a", 2022, 90, 9, None), ("b", 2021, 10, 20, None), ("c", 2019, 7, 3, "early"), ("d", 2020, 1, 1, "no window")]
    windows = [("a", 2020, 2020, 2022), ("b", 2020, 2025, 2030), ("c", 2021, 2015, 2021)]
    limits = [("a", "world", "range", 2020, 600, 700, 1), ("b", "europe", "exact", 2020, 50, 50, 2), ("b", "europe", "exact", 2020, 60, 60, 1), ("b", "world", "exact", 2020, 40, 40, 1), ("b", "world", "range", 2020, 900, 900, 1)]
    made = enforcement.enforce(
        spark.createDataFrame(estimates, "model string, year int, world long, europe long, rationale string"), spark.createDataFrame(windows, "model string, start int, first int, final int"),
        spark.createDataFrame(limits, "model string, region string, kind string, year int, low long, high long, precedence int"), last=2023,
    )
    zero = "Outside generation window -> zero."
    assert sorted(tuple(r) for r in made.drop("zero").collect()) == [
        ("a", 2020, 600, 400, "guess"), ("a", 2021, 0, 0, "Filled by client."), ("a", 2022, 90, 9, ""), ("a", 2023, 0, 0, "Filled by client. " + zero),
        ("b", 2020, 60, 60, "Europe start fixed. World start fixed."), ("b", 2021, 0, 0, zero), ("b", 2022, 0, 0, "Filled by client. " + zero), ("b", 2023, 0, 0, "Filled by client. " + zero),
        ("c", 2019, 7, 3, "early"), ("c", 2021, 0, 0, ""), ("c", 2022, 0, 0, "Filled by client. " + zero), ("c", 2023, 0, 0, "Filled by client. " + zero), ("d", 2020, 1, 1, "no window"),
    ]


def test_support_by_both_joins(spark):
    known = spark.createDataFrame([("golf", 2004, "MK 5"), ("golf", 2012, "VII"), ("golf", 2012, "A")], "key string, from_year int, code string")
    asked = spark.createDataFrame([("golf", "mk5", 2004), ("golf", "x", 2011), ("golf", "vii", 2020), ("golf", "mk5", 2003), ("rio", "I", 2020), ("golf", None, 2020)], "key string, generation string, year int")
    for sent in (100, 0):
        got = [(r.year, r.supported, r.match_type, r.code, r.from_year) for r in support.support(asked, known, sent).collect()]
        assert sorted(got, key=str) == sorted([
            (2004, True, "by_year_exact_gen", "MK 5", 2004), (2011, True, "by_year_diff_gen_label", "MK 5", 2004), (2020, True, "by_year_exact_gen", "VII", 2012), (2003, False, "model_present_no_year_coverage", None, None),
            (2020, False, "no_model_match", None, None), (2020, True, "by_year_diff_gen_label", "VII", 2012),
        ], key=str)
    one = spark.createDataFrame([("golf",)], "key string")
    assert support.support_by_table(one, None).first()["match_type"] == "no_catalog"
    assert support.support_by_table(one, known.drop("key")).first()["match_type"] == "no_model_column"


def test_sources_after_one_another(spark):
    asked, seen = spark.range(6).withColumnRenamed("id", "k"), {}

    def source(name, keys):
        def ask(left):
            seen[name] = sorted(r.k for r in left.collect())
            return left.where(F.col("k").isin(keys)).select("k", F.lit(name).alias("answer"))

        return name, ask

    got = detection.cascade(asked, "k", [source("a", [0, 1]), source("b", [1, 2]), source("c", [0])]).collect()
    assert {r.k: (r.source, r.answer) for r in got} == {0: ("a", "a"), 1: ("a", "a"), 2: ("b", "b"), 3: (None, None), 4: (None, None), 5: (None, None)}
    assert len(got) == 6 and seen == {"a": [0, 1, 2, 3, 4, 5], "b": [2, 3, 4, 5], "c": [3, 4, 5]}


def test_tables_by_name(spark, tmp_path):
    rows = spark.range(3)
    sinks.write_tables({"2016 EU": rows, "2015 EU": rows, "2015 World": rows, "EU Fleet": rows, "1999 EU": rows}, str(tmp_path))
    assert publish.table_names(spark, str(tmp_path)) == ["1999_EU", "2015_EU", "2015_World", "2016_EU", "EU_Fleet"] and publish.table_names(spark, f"{tmp_path}/none") == []
    assert publish.year_tables(spark, str(tmp_path), "EU") == ["2015_EU", "2016_EU"]
    assert publish.read_table(spark, str(tmp_path), "2015 World").count() == 3 and publish.read_table(spark, str(tmp_path), "2014 EU") is None


def test_the_newest_output(spark, tmp_path):
    import os

    for k, name in enumerate(["sales_estimates_b.xlsx", "sales_estimates_a.xlsx", "other.xlsx"]):
        (tmp_path / name).write_text("x")
        os.utime(tmp_path / name, (1_700_000_000 + (k == 0) * 60, 1_700_000_000 + (k == 0) * 60))
    assert publish.newest(spark, f"{tmp_path}/sales_estimates_*.xlsx").endswith("/sales_estimates_b.xlsx")
    assert publish.newest(spark, f"{tmp_path}/none_*") is None


def test_names_of_a_line_by_line_catalogue(spark, tmp_path):
    (tmp_path / "names.txt").write_text("audi a3\tbmw x5+ kia/RIO & x\n\n  vw id.4 \nAUDI A3\n")
    assert {r.token for r in sales_lists.read_tokens(spark, f"{tmp_path}/names.txt").collect()} == {"Audi A3", "Bmw X5", "Kia", "Rio", "X", "Vw Id.4"}


def test_estimate_from_end_to_end(spark):
    frame = spark.createDataFrame
    asked = frame([(1, "Golf", 2015, None), (2, "Golf Estate", 2015, None), (3, "Zed", 2015, "Mk2")], "ask long, model string, year int, generation string")
    history = frame([("EU", "golf", y, "Golf", "VII", 1000 * (y - 2000), False) for y in range(2012, 2016)] + [("World", "golf", 2012, "Golf", "VII", 90_000, False)], "region string, key string, year int, model string, generation string, units long, estimated boolean")
    cached = frame([("Golf", "Golf Mk7", 2012, 2019), ("Golf Estate", "Mk7 estate", 2012, 9999)], "model string, label string, start int, end int")
    pages = frame([], "model string, html string")
    texts = frame([("Golf Estate", 0, "discontinued in 2017", None)], "model string, place int, text string, url string")
    catalogue = frame([("golf", 2004, "Mk 7")], "key string, from_year int, code string")
    proposals = frame([(1, 2013, 50_000, 20_000, "guess"), (3, 2014, 10, 90, "guess"), (3, 2016, 500, 100, "guess")], "ask long, year int, world long, europe long, rationale string")
    answers = frame([], "query string, response string")
    got = estimation.estimate(asked, history, cached, pages, texts, catalogue, answers, proposals)
    assert {tuple(r) for r in got["Windows"].collect()} == {(1, "Mk7", 2012, 2019, "cache_fixed"), (2, "Mk7", 2012, 2017, "cache_open_resolved"), (3, "Mk2", 2014, 2022, "default_named")}
    limits = {r.ask: r for r in got["Constraints"].collect()}
    assert (limits[1].eu_exact, limits[1].world_exact, limits[1].parent, limits[1].eu_source) == (12_000, 90_000, None, "local-db(year-match)")
    # the estate has no figures of its own: the middle shares of its parent's 12,000 and 90,000
    assert (limits[2].parent, limits[2].variant, limits[2].eu_exact, limits[2].world_exact) == ("golf", "body_style/wagon", 3_600, 25_200)
    assert (limits[3].eu_exact, limits[3].world_exact, limits[3].world_low) == (None, None, None)
    rows = {(r.model, r.year): r for r in got["Estimates"].collect()}
    assert len(rows) == (2036 - 2012) * 2 + (2036 - 2014)
    assert (rows[1, 2012].world_sales, rows[1, 2012].europe_sales, rows[1, 2012].rationale) == (90_000, 12_000, "Europe start fixed. World start fixed.")
    assert rows[1, 2013].world_sales == int(0.6 * round(90_000 * 1.35) + 0.4 * 50_000) and rows[1, 2020].world_sales == 0 and not rows[1, 2020].gen_active
    assert rows[3, 2014].world_sales == 90 and rows[3, 2014].europe_sales == 90  # the world is never below Europe at the start
    assert (rows[1, 2012].supported, rows[1, 2012].match_type, rows[2, 2012].match_type) == (True, "by_year_exact_gen", "no_model_match")
    assert rows[1, 2013].world_fleet == 90_000 + rows[1, 2013].world_sales and got["Fleet_Repairs"].count() == len(rows)


def test_what_can_be_asked_for():
    assert publish.year_span("2015-2017") == range(2015, 2018) and publish.year_span(" 2020 ") == range(2020, 2021)
    assert publish.request(" Golf ", "", "2019") == ("Golf", "", 2019)
    for year in (1989, "2036"):
        with pytest.raises(ValueError):
            publish.request("Golf", "", year)


def test_preview_of_few_rows(spark):
    rows = spark.createDataFrame([(2021, 5, 123456789), (2020, 10, 3)], "year int, world long, europe long")
    lines = [r.line for r in publish.preview(rows, {"Year": "year", "World": "world", "Europe": "europe"}, [F.col("year")]).orderBy("place").collect()]
    assert lines == ["|   Year |   World |    Europe |", "|--------|---------|-----------|", "|   2020 |      10 |         3 |", "|   2021 |       5 | 123456789 |"]
    none = publish.preview(rows.where("false"), {"Year": "year"}, [F.col("year")]).collect()
    assert [r.line for r in none] == ["|   Year |", "|--------|"]


def test_languages_in_order(spark):
    rows = [("a", "fr", 1), ("a", "de", 2), ("a", "en", 1), ("b", "pt", 1), ("b", "it", 1), ("c", "xx", 5), ("d", "en", 0)]
    got = lookups.preferred_language(spark.createDataFrame(rows, "model string, lang string, windows int")).collect()
    assert {tuple(r) for r in got} == {("a", "de", 2), ("b", "it", 1), ("c", "xx", 5)}


def test_keys_through_the_sources(spark):
    names = spark.createDataFrame([("Golf", "golf"), ("Rio", "rio"), ("Panda", "pandaa"), ("Qq", "qqqqqqq")], "name string, key string")
    keys = lambda *ks: spark.createDataFrame([(k,) for k in ks], "key string")
    got = lookups.find_keys(names, {"EU": keys("golf", "panda"), "World": keys("golf", "rio")}).collect()
    assert {tuple(r) for r in got} == {("Golf", "golf", "EU"), ("Rio", "rio", "World"), ("Panda", "panda", "similar"), ("Qq", None, None)}
