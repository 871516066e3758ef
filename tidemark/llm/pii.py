"""Personal data by candidate generation and boosted trees, in Spark's own functions only on the main path.

Exact rules find e-mail addresses, IP addresses, cards and phone numbers; their spans always stay.  Beside them,
generators of high recall propose further spans, which may overlap: addresses that are spelled out, groups of digits,
and bank account numbers.  Each candidate gets features of its format and of the text around it; boosted regression
trees, as CASE expressions, score it, and it is selected from its kind's threshold on.  Of overlapping candidates the
best score stays, and none that touches an exact rule's span.

The trees are fitted at the call, on the driver, to SAMPLE_ROWS labelled lines that Spark writes from templates; their
features come from the same expressions as on the main path.  Every third template is held out whole, with all its lines, and
each kind's threshold is the least score from which PRECISION holds there: so it is set on wordings that no tree has seen.
The sample is bounded and independent of the corpus.

Defined edge cases: a null text counts as empty and has no spans; ties of candidates go to the earlier, then the longer
span; repeated rows each give a row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, runs, sums_before, table, text_or_empty

BASE = {
    # possessive where nothing that follows could take back a character, so long runs cost no stack; a match begins where its
    # first run of characters does, or where the match before ended, so that long runs are tried once
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: An at sign or a dot that is spelled out.
_AT, _DOT = r"(?: ?\(at\) ?| ?\[at\] ?| at )", r"(?: ?\(dot\) ?| ?\[dot\] ?| dot )"
CANDIDATES = {
    # begins at no later part of a spelled name, and ends before no further at sign; runs are possessive, so long ones are tried once
    "address": rf"(?<![A-Za-z0-9._%+-])(?<! dot )(?<!dot[)\]])(?<!dot[)\]] )[A-Za-z0-9._%+-]++(?:{_DOT}[A-Za-z0-9_%+-]++)*+{_AT}[A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++)++(?!{_AT}[A-Za-z0-9])",
    "number": r"\(?[0-9](?:[ ().-]{0,2}[0-9]){6,}+",
    "bank": r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
}
KINDS = (*BASE, *CANDIDATES)
SAMPLE_ROWS, TREES, DEPTH, RATE, PRECISION = 6000, 24, 3, 0.3, 0.95
BEFORE, AFTER = 40, 24
#: Words around a candidate, each looked for before and after it.
CONTEXTS = {
    "call": r"\b(phone|tel|telephone|call|calls|mobile|cell|fax|whatsapp|dial|text me|ring|number is|hotline|extension)\b",
    "account": r"\b(iban|account|bank|card|visa|credit|debit|transfer|wire|payment|deposit)\b",
    "identity": r"\b(ssn|social security|passport|tax id|national id|licence no|driver|insurance no|patient|born|identity)\b",
    "mail": r"\b(mail|e-mail|email|contact|write|reach|send|address|ask|reply)\b",
    "mine": r"\b(my|me|her|his|their|your|customer|name|mr|mrs|ms|dr)\b",
    "other": r"\b(order|version|isbn|issn|build|page|pages|total|price|serial|ref|release|chapter|population|ratio|year|years|meet|look|invoice|part|item|model|sku|tracking|ticket|volume|figures|result|hash|code|id)\b",
}


def mod97(raw: Column) -> Column:
    """What is left by 97 of a bank account number whose first four characters are put last, letters counting from 10."""
    turned = F.concat(F.substring(raw, 5, 64), F.substring(raw, 1, 4))
    digit = lambda c: F.when(F.rlike(c, F.lit("^[0-9]$")), c.try_cast("int")).otherwise(F.ascii(c) - 55)
    step = lambda acc, c: let(digit(c), lambda v: (acc * F.when(v > 9, 100).otherwise(10) + v) % 97)
    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), step)


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start, stop, m>> of a pattern's matches, in code points."""
    empty = F.array().cast("array<struct<start:int,stop:int,m:string>>")

    def placed(found: Column, pieces: Column) -> Column:
        before = sums_before(F.transform(found, lambda m, i: F.length(F.get(pieces, i)) + F.length(m)))
        span = lambda start, m: F.struct(start.alias("start"), (start + F.length(m)).alias("stop"), m.alias("m"))
        return let(before, lambda at: F.transform(found, lambda m, i: let(F.get(at, i) + F.length(F.get(pieces, i)), lambda start: span(start, m))))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) == 0, empty).otherwise(let(F.split(text, pattern), lambda pieces: placed(found, pieces))))


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the check; one of more than 32, which is no number of a card, does not."""
    def add(acc: Column, i: Column) -> Column:
        d = F.coalesce(F.substring(digits, -i, F.lit(1)).try_cast("int"), F.lit(0))
        return acc + F.when(i % 2 == 1, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))

    passes = F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1))), F.lit(0), add) % 10 == 0
    return F.when(F.length(digits) <= 32, passes).otherwise(F.lit(False))


def only_digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        part = "0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
        return F.rlike(m, F.lit(rf"^{part}(\.{part}){{3}}$"))
    if kind == "card":
        return let(only_digits(m), lambda d: F.length(d).between(12, 19) & luhn(d))
    if kind == "phone":
        return F.length(only_digits(m)).between(9, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """array<struct<start, k, stop>> of the exact rules' spans, in order."""
    def of(k: int, kind: str, pattern: str) -> Column:
        found = matches(text, pattern)
        return F.transform(F.filter(found, lambda x: valid(kind, x["m"])), lambda x: F.struct(x["start"].alias("start"), F.lit(k).alias("k"), x["stop"].alias("stop")))

    return F.array_sort(F.concat(*[of(k, kind, p) for k, (kind, p) in enumerate(BASE.items())]))


def features(text: Column, k: int, x: Column) -> Column:
    """array<double>: what the trees look at in candidate x of CANDIDATES' k-th kind."""
    m = x["m"]
    count = lambda cls: (F.length(m) - F.length(F.regexp_replace(m, cls, ""))).cast("double")
    flag = lambda c: c.cast("int").cast("double")

    def around(pair: Column) -> Column:
        before, after = pair["before"], pair["after"]
        return F.array(
            F.lit(float(k)), F.length(m).cast("double"), count("[0-9]"), count("[A-Za-z]"), count("[ ]"), count("[-]"), count("[.]"), count("[()\\[\\]]"),
            flag(let(only_digits(m), luhn)), flag(F.rlike(m, F.lit("^[0-9]{3}-[0-9]{2}-[0-9]{4}$"))), flag(F.rlike(m, F.lit(r"^\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}$"))),
            flag(F.rlike(before, F.lit(r"[A-Za-z0-9_/.#$-]$"))), flag(F.rlike(after, F.lit(r"^[-]?[A-Za-z0-9_%/]"))),
            flag(F.lit(k == 2) & (mod97(F.replace(m, F.lit(" "), F.lit(""))) == 1)), flag(F.rlike(m, F.lit("^(19|20)[0-9]{2}[ .-]"))), flag(F.rlike(m, F.lit(r"[ .(-]"))),
            *[flag(F.rlike(before, F.lit(p))) for p in CONTEXTS.values()], *[flag(F.rlike(after, F.lit(p))) for p in CONTEXTS.values()],
        )

    start = F.greatest(x["start"] - BEFORE, F.lit(0))
    pair = F.struct(F.lower(F.substring(text, start + 1, x["start"] - start)).alias("before"), F.lower(F.substring(text, x["stop"] + 1, F.lit(AFTER))).alias("after"))
    return let(pair, around)


def candidates(text: Column) -> Column:
    """array<struct<start, k, stop, f>> that the generators propose; k counts in KINDS."""
    def of(k: int, pattern: str) -> Column:
        return F.transform(matches(text, pattern), lambda x: F.struct(x["start"].alias("start"), F.lit(len(BASE) + k).alias("k"), x["stop"].alias("stop"), features(text, k, x).alias("f")))

    return F.concat(*[of(k, p) for k, p in enumerate(CANDIDATES.values())])


#: Wordings of the sample: # is a digit, @ a capital, & a name, % % the check digits of the account number that they stand in.
PERSONAL = (
    "call me on my mobile ### ###-####", "phone (###) ###-#### after noon", "tel ###.###.####", "&'s number is ###-###-####, ring any time", "you can reach & at (###) ###-#### most days", "fax ## ## ## ## ##",
    "text me: ### ### ####", "Dr & (###-###-####) is on duty", "his cell is ##########", "dial ###-###-#### and ask for &", "& left a message, ###-###-####, please return it", "our nurse & answers on ### #### ####", "###-###-#### is my new phone",
    "(###) ###-#### (home), & said", "mobile: #####-######", "her telephone, ### ## ## ##, rang",
    "my ssn is ###-##-####", "social security no ###-##-#### of the patient", "the patient's record lists ###-##-#### for &", "her passport number ########", "& gave ###-##-#### as the social security number", "driver licence no ######## of &", "tax id ##-####### belongs to &", "###-##-#### (ssn of &)",
    "born 1980, national id ###########, named &",
    "customer &, credit card #### #### #### ####", "card ####-####-####-#### of &", "my visa is ################", "charge #### ###### ##### to my card", "debit card #### #### #### ####, name &",
    "write to & at & dot com", "contact &(at)&(dot)org today", "reach her: &[at]&[dot]net", "e-mail & (at) & (dot) com", "& dot & at & dot org is my mail", "send it to & dot & at & dot co dot uk", "mail: & [at] & [dot] com", "ask & at & dot edu for a copy", "reply to &_##(at)&(dot)de", "her address is &## at & dot net",
    "iban @@%% #### #### #### ##", "bank account @@%%@@@@##############", "please transfer to @@%% #### #### #### #### ##", "@@%% @@@@ #### #### #### is my account", "wire it to @@%%################## for &", "IBAN: @@%% #### #### #### #### #### #", "the deposit went to @@%%##############", "pay & (@@%% #### #### #### ##) by friday",
)
IMPERSONAL = (
    "order ###-##-#### was sent", "version ####.##.##.#", "isbn 978-#-##-######-#", "population # ### ###", "in the years ####-#### they", "pages ####-#### of volume", "serial ############", "ratio #.#########", "total $####.###.###", "build ####-##-##-####",
    "token=##########ab", "& ##################### &", "& ################ &", "&, ### ### #### & &", "price ### ### ###", "invoice ##########", "part ###-####-## fits", "tracking ## ### ### ### ###", "ticket ######## is closed", "from 20##-##-## to 20##-##-##", "at 20##-##-## ##:##",
    "item ###-##-##### in blue", "the code ########## failed", "model ###-###-####-# is new", "issn ####-#### of the journal", "figures: ### ### ### ### ###", "the sum of ##########", "id=############", "##########.##", "sku ###.###.####.#", "hash ##########ff##", "result ###,###,###", "chapter ##-##-##-## ends",
    "won by ### ### votes", "1,###,### people", "section ###.###.##.#", "coordinates ##.###### ##.######", "the years 19##-20## and 20##-20##", "lot ###/####/###",
    "we meet at & dot & rule", "look at the dot com page", "stand at the dot and wait", "he looks at & dot by dot", "a point at which dot meets dot", "we stayed at home dot it rained", "look at each dot there",
    "ref @@## #### #### ####", "release @@##@@@@@@@@@@@@ of &", "serial @@## @@@@ #### ####", "part @@################", "model @@##@@####@@####", "key @@##@@@@####@@@@####", "code @@## #### #### #### ##", "batch @@##############",
)


def labelled_lines(spark: SparkSession, rows: int = SAMPLE_ROWS) -> DataFrame:
    """line, wording (its number), text, label: lines from the wordings in turn, with names and figures of their own."""
    names = ("lorem", "thanor", "elin", "marco", "river", "stone", "orinth", "dales", "jane", "petra", "okoye", "novak")
    wordings = F.array(*map(F.lit, PERSONAL + IMPERSONAL))
    pick = lambda n, of: F.element_at(F.array(*map(F.lit, of)), (F.pmod(F.xxhash64("line", F.lit(n)), F.lit(len(of))) + 1).cast("int"))
    fill = lambda c, i: (
        F.when(c == "#", F.pmod(F.xxhash64("line", i), F.lit(10)).cast("string"))
        .when(c == "@", F.char(F.pmod(F.xxhash64("line", i), F.lit(26)) + 65))
        .when(c == "&", F.element_at(F.array(*map(F.lit, names)), (F.pmod(F.xxhash64("line", i), F.lit(len(names))) + 1).cast("int")))
        .otherwise(c)
    )
    wording = (F.col("id") % len(PERSONAL + IMPERSONAL)).cast("int")
    lines = spark.range(rows).select(F.col("id").alias("line"), wording.alias("wording"), (wording < len(PERSONAL)).cast("int").alias("label"))
    lines = lines.withColumn("template", F.concat_ws(" ", pick(1, ("", "so", "then", "well,", "note:")), pick(2, names), F.get(wordings, F.col("wording")), pick(3, ("", "now", "as before", "they said")), pick(4, names)))
    lines = lines.withColumn("text", F.concat(F.array_join(F.transform(F.split("template", ""), fill), ""), F.lit(".")))
    number = F.regexp_extract("text", r"[A-Z]{2}%%[ A-Z0-9]*[A-Z0-9]", 0)
    check = F.lpad((98 - mod97(F.replace(F.replace(number, F.lit(" "), F.lit("")), F.lit("%%"), F.lit("00")))).cast("string"), 2, "0")
    return lines.select("line", "wording", F.when(number == "", F.col("text")).otherwise(F.replace("text", F.lit("%%"), check)).alias("text"), "label")


def _tree(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int):
    """A regression tree on gradients: a leaf's value, or (feature, threshold, left, right)."""
    best, split = g.sum() ** 2 / (h.sum() + 1), None
    if depth:
        for j in range(x.shape[1]):
            order = np.argsort(x[:, j], kind="stable")
            v, gs, hs = x[order, j], np.cumsum(g[order]), np.cumsum(h[order])
            cut = np.flatnonzero(v[1:] > v[:-1])
            if len(cut):
                gain = gs[cut] ** 2 / (hs[cut] + 1) + (gs[-1] - gs[cut]) ** 2 / (hs[-1] - hs[cut] + 1)
                i = int(gain.argmax())
                if gain[i] > best + 1e-6:
                    best, split = gain[i], (j, float((v[cut[i]] + v[cut[i] + 1]) / 2))
    if split is None:
        return float(RATE * g.sum() / (h.sum() + 1))
    left = x[:, split[0]] <= split[1]
    return (*split, _tree(x[left], g[left], h[left], depth - 1), _tree(x[~left], g[~left], h[~left], depth - 1))


def _value(tree, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, float):
        return np.full(len(x), tree)
    return np.where(x[:, tree[0]] <= tree[1], _value(tree[2], x), _value(tree[3], x))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> list:
    """Gradient boosting of the logistic loss."""
    score, out = np.zeros(len(y)), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        out.append(_tree(x, y - p, p * (1 - p), depth))
        score += _value(out[-1], x)
    return out


def train(spark: SparkSession) -> tuple[list, dict[int, float], float]:
    """The trees, each kind's threshold on the score, and the accuracy on the lines of the wordings held out."""
    model, thresholds, score, y, _ = _trained(spark)
    return model, thresholds, float(((score > 0) == (y == 1)).mean())


def held_out(spark: SparkSession) -> dict[str, tuple[float, float]]:
    """Precision and recall by kind, of the candidates in lines of the wordings held out."""
    _, thresholds, score, y, k = _trained(spark)
    out = {}
    for kind, least in thresholds.items():
        taken, real = score[k == kind] >= least, y[k == kind] == 1
        out[KINDS[kind]] = (float((taken & real).sum() / max(taken.sum(), 1)), float((taken & real).sum() / max(real.sum(), 1)))
    return out


def _trained(spark: SparkSession) -> tuple[list, dict[int, float], np.ndarray, np.ndarray, np.ndarray]:
    """The trees, the thresholds, and of the candidates held out their scores, labels and kinds."""
    lines = labelled_lines(spark).withColumn("c", F.explode(candidates(F.col("text")))).select("line", "wording", "label", "c.k", "c.f")
    rows = lines.orderBy("line", "k").collect()  # at most a few for each of SAMPLE_ROWS lines
    x, y, k = np.array([r["f"] for r in rows]), np.array([r["label"] for r in rows], float), np.array([r["k"] for r in rows])
    held = np.array([r["wording"] % 3 == 0 for r in rows])
    model = fit(x[~held], y[~held])
    score = sum(_value(t, x[held]) for t in model)
    thresholds = {}
    for kind in range(len(BASE), len(KINDS)):
        s, t = score[k[held] == kind], y[held][k[held] == kind]
        order = np.argsort(-s)
        precise = np.flatnonzero(np.cumsum(t[order]) >= PRECISION * np.arange(1, len(t) + 1))
        thresholds[kind] = float(max(s[order[precise[-1]]], 0.0)) if len(precise) else float("inf")
    return model, thresholds, score, y[held], k[held]


def _case(tree, f: Column) -> Column:
    if isinstance(tree, float):
        return F.lit(tree)
    return F.when(F.get(f, F.lit(tree[0])) <= tree[1], _case(tree[2], f)).otherwise(_case(tree[3], f))


def selected(text: Column, base: Column, model: list, thresholds: dict[int, float]) -> Column:
    """array<struct<start, k, stop>> of the candidates that stay."""
    score = lambda f: reduce(lambda a, b: a + b, (_case(t, f) for t in model))
    least = F.create_map(*[F.lit(x) for p in thresholds.items() for x in p])
    clear = let(hulls(base), lambda h: F.filter(candidates(text), lambda c: ~meets(h, c, lambda b: F.lit(True))))
    scored = F.transform(clear, lambda c: F.struct(c["start"].alias("start"), c["stop"].alias("stop"), score(c["f"]).alias("score"), c["k"].alias("k")))
    passed = F.array_sort(F.filter(scored, lambda c: c["score"] >= F.try_element_at(least, c["k"])))
    # the best score stays; ties: the earlier, then the longer, then the kind listed first
    order = lambda c: F.struct(-c["score"], c["start"], -c["stop"], c["k"])
    best = let(passed, lambda p: let(hulls(p), lambda h: F.filter(p, lambda c: ~meets(h, c, lambda d: order(d) < order(c)))))
    return F.transform(best, lambda c: F.struct(c["start"].alias("start"), c["k"].alias("k"), c["stop"].alias("stop")))


def hulls(spans: Column) -> Column:
    """Runs of spans that are sorted by start, each with the least start and the greatest stop of its spans."""
    return F.transform(runs(spans), lambda r: F.struct(F.array_min(F.transform(r, lambda x: x["start"])).alias("start"), F.array_max(F.transform(r, lambda x: x["stop"])).alias("stop"), r.alias("spans")))


def meets(held: Column, c: Column, also) -> Column:
    """Whether c overlaps a span of the hulls for which also() holds; only the runs around c are looked into."""
    over = lambda a: (a["start"] < c["stop"]) & (c["start"] < a["stop"])
    return F.exists(held, lambda h: over(h) & F.exists(h["spans"], lambda d: over(d) & also(d)))


def find_personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, base, added: the exact rules' spans and those that the trees select, as (start, k, stop), k in KINDS."""
    model, thresholds, _ = train(docs.sparkSession)
    text = F.col("text")
    rows = docs.select("doc_id", text_or_empty().alias("text"))
    rows = rows.withColumn("base", base_spans(text))
    return rows.select("doc_id", "base", selected(text, F.col("base"), model, thresholds).alias("added"))


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = find_personal_data(table(spark, sf_dir, "documents"))
    kinds = F.array(*map(F.lit, KINDS))
    joined = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", F.get(kinds, s["k"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")
    ks = F.transform("base", lambda s: s["k"])
    counts = [F.size(F.array_remove(ks, k)) for k in range(len(BASE))]
    counts = [(F.size("base") - n).cast("long").alias(f"n_{kind}") for kind, n in zip(BASE, counts)]
    return rows.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.array_sort(F.concat("base", "added"))).alias("spans"))
