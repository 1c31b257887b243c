"""Personal data: base patterns, and further spans proposed by wide generators and selected by boosted trees.

Everything that touches documents is a DataFrame expression; the trees become nested CASE expressions.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import gbdt

#: Base kinds in their fixed order, then the kinds of the added spans.
BASE = ["email", "ip", "card", "phone"]
ADDED = ["secret", "number", "contact"]

# The base patterns match exactly what the plain ones would: possessive runs keep long texts free of backtracking, and
# the conditions in front name the only places where a leftmost match can start (a run's start, or the last match's end).
LOCAL = r"A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9]){11,}+",  # shorter chains hold fewer than 12 digits
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/=-]{16,}+",
    "number": r"(?<![0-9])\(?[0-9](?:[\x20()./-]{0,2}+[0-9]){6,}+",
    "contact": rf"(?<![{LOCAL}])[{LOCAL}]{{1,64}}+\x20?(?:@|\(at\)|\[at\]|\{{at\}})\x20?[A-Za-z0-9-]{{1,64}}+(?:\x20?(?:\.|\(dot\)|\[dot\]|\{{dot\}})\x20?[A-Za-z0-9-]{{2,64}}+)+",
}
#: A text without these cannot hold the kind.
GATES = {
    "email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]",
    "secret": r"[A-Za-z0-9_+/=-]{16}", "number": r"[0-9]", "contact": r"@|[\(\[\{]at[\)\]\}]",
}
HIT = "struct<s:int,e:int,m:string,before:string,after:string>"
SPAN = "struct<s:int,k:int,e:int>"

FEATURES = [
    "kind", "length", "digits", "letters", "marks", "switches", "capitals", "hex", "key_cue", "number_cue", "assigned", "quoted",
    "us_phone", "us_id", "date", "grouped", "plain", "glued", "written_at",
]


def hits(text: Column, kind: str) -> tuple[Column, Column]:
    """All matches of a kind, and the text pieces between them."""
    gate = text.rlike(GATES[kind])
    none = F.array().cast("array<string>")
    return (
        F.when(gate, F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))).otherwise(none),
        F.when(gate, F.split(text, PATTERNS[kind], -1)).otherwise(none),
    )


def before_each(values: Column, add: Callable[[Column, Column], Column], start: Column, block: int = 128) -> Column:
    """For each place of an array what ``add`` makes of all values in front of it. Blocks are summed first, so a place costs
    at most its block and the blocks before, not the whole array."""
    over = lambda part: F.aggregate(part, start, add)
    once = lambda x, use: F.flatten(F.transform(F.array(x), use))  # noqa: E731  x is evaluated once, then named inside
    own = lambda i: F.floor(i / block).cast("int")

    def of(vs: Column) -> Column:
        sums = F.transform(F.sequence(F.lit(0), own(F.size(vs))), lambda j: over(F.slice(vs, j * block + 1, block)))
        place = lambda heads: F.transform(vs, lambda v, i: add(F.get(heads, own(i)), over(F.slice(vs, own(i) * block + 1, i % block))))
        return once(sums, lambda bs: once(F.transform(bs, lambda b, j: over(F.slice(bs, 1, j))), place))

    return once(values, of)


def placed(found: Column, pieces: Column) -> Column:
    """The matches with their places: each starts after all pieces and matches in front of it."""
    n = F.size(found)
    spans = F.zip_with(F.slice(pieces, 1, n), found, lambda p, m: F.length(p) + F.length(m))
    fronts = before_each(spans, lambda a, x: a + x, F.lit(0))
    rows = F.arrays_zip(fronts.alias("at"), F.slice(pieces, 1, n).alias("p"), found.alias("m"), F.slice(pieces, 2, n).alias("q"))

    def hit(x: Column) -> Column:
        s = x["0"] + F.length(x["1"])
        return F.struct(s.alias("s"), (s + F.length(x["2"])).alias("e"), x["2"].alias("m"), F.right(x["1"], F.lit(24)).alias("before"), F.left(x["3"], F.lit(8)).alias("after")).cast(HIT)

    named = F.transform(rows, lambda x: F.struct(x["at"].alias("0"), x["p"].alias("1"), x["m"].alias("2"), x["q"].alias("3")))
    return F.when(n > 0, F.transform(named, hit)).otherwise(F.array().cast(f"array<{HIT}>"))


def apart_from(spans: Column, taken: Column) -> Column:
    """The spans that touch none of ``taken``: in the order of places, the furthest end of all that begin before a span
    ends must not pass its start. Sorted once, never pair by pair."""
    asks = F.transform(spans, lambda c: F.struct(c["e"].alias("at"), F.lit(0).alias("known"), F.lit(0).alias("end"), c.alias("span")))
    stands = F.transform(taken, lambda b: F.struct(b["s"].alias("at"), F.lit(1).alias("known"), b["e"].alias("end"), b.alias("span")))
    line = F.array_sort(F.concat(asks, stands))

    def judged(x: Column) -> Column:
        ends = before_each(F.transform(x, lambda y: y["end"]), lambda a, y: F.greatest(a, y), F.lit(0))
        both = F.zip_with(x, ends, lambda y, end: F.struct(y.alias("y"), end.alias("end")))
        return F.transform(F.filter(both, lambda z: (z["y"]["known"] == 0) & (z["end"] <= z["y"]["span"]["s"])), lambda z: z["y"]["span"])

    return F.when((F.size(spans) > 0) & (F.size(taken) > 0), F.flatten(F.transform(F.array(line), judged))).otherwise(spans)


def digits_of(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the check digit fits: from the right, every second digit doubled, nines cast out."""
    row = F.filter(F.split(F.reverse(digits), ""), lambda c: c != "")
    worth = F.transform(row, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") / 5).cast("int")))
    return F.aggregate(worth, F.lit(0), lambda a, x: a + x) % 10 == 0


def is_valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        part = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
        return m.rlike(rf"^{part}\.{part}\.{part}\.{part}$")
    if kind == "card":
        d = digits_of(m)
        return F.length(d).between(12, 19) & luhn(d)
    if kind == "phone":
        return F.length(digits_of(m)).between(9, 15)
    return F.lit(True)


def features(kind: str, c: Column) -> list[Column]:
    """Format and context of one candidate, in the order of FEATURES."""
    m, before, after = c["m"], c["before"], c["after"]
    count = lambda p: F.length(m) - F.length(F.regexp_replace(m, p, ""))
    yes = lambda x: F.when(x, 1.0).otherwise(0.0)
    low = F.lower(before)
    return [
        F.lit(float(ADDED.index(kind))), F.length(m), count("[0-9]"), count("[A-Za-z]"), count("[^A-Za-z0-9]"),
        F.size(F.split(m, r"(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])", -1)) - 1,
        count("[A-Z]"), yes(m.rlike("^[0-9a-fA-F]+$")),
        yes(low.rlike(r"(?:token|key|secret|passw\w*|pwd|auth\w*|bearer|credential\w*|sig\w*)[^a-z]{0,6}$")),
        yes(low.rlike(r"(?:tel|phone|mobile|cell|fax|call|ssn|social security|passport|account|iban|card|contact)[^0-9a-z]{0,4}(?:(?:no|nr|number|is|at|me)[^0-9a-z]{0,4}){0,2}$")),
        yes(before.rlike(r"[=:]\s*[\"']?$")), yes(before.rlike(r"[\"']$") & after.rlike(r"^[\"']")),
        yes(m.rlike(r"^\(?[0-9]{3}\)?[\x20.-]{1,2}[0-9]{3}[\x20.-][0-9]{4}$")), yes(m.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$")),
        yes(m.rlike(r"^(?:19|20)[0-9]{2}[-/.][0-9]{1,2}[-/.][0-9]{1,2}$|^[0-9]{1,2}[-/.][0-9]{1,2}[-/.](?:19|20)[0-9]{2}$")),
        yes(m.rlike(r"^[0-9]{4}(?:[\x20-][0-9]{4}){2,3}")), yes(m.rlike("^[A-Za-z]+$|^[0-9]{1,8}$")), yes(before.rlike(r"[\w/@#$%&*.+-]$")),
        yes(m.rlike(r"[(\[{]at[)\]}]")),
    ]


def each(use: Callable[[str, Column], Column], kind: str) -> Callable[[Column], Column]:
    return lambda c: use(kind, c)


def feature_array(kind: str, c: Column) -> Column:
    return F.array(*[x.cast("double") for x in features(kind, c)])


def training_rows(spark: SparkSession, rows: int) -> DataFrame:
    """Seeded snippets (text, label): personal data in the forms people write it, and strings that only look like it."""
    code = F.sha2(F.concat(F.lit("meterline"), F.col("id").cast("string")), 256)
    d = F.translate(code, "abcdef", "314159")
    part = lambda a, n: F.substring(d, a, n)
    join = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y for y in x])
    word = F.translate(F.substring(code, 1, 7), "0123456789", "onetheriua")
    longer = F.translate(F.substring(code, 1, 24), "0123456789", "onetheriua")
    us, spaced = join("(", part(1, 3), ") ", part(4, 3), "-", part(7, 4)), join(part(1, 3), ".", part(4, 3), ".", part(7, 4))
    good = [
        join(word, " token = \"", F.substring(code, 1, 40), "\" ", word), join(word, " api_key: ", F.substring(code, 3, 32), " ", word),
        join("secret='", F.base64(F.unhex(F.substring(code, 1, 48)).cast("binary")), "'"), join(word, " password=", F.substring(code, 5, 20), "\n", word),
        join(word, " token = \"sk_", F.substring(code, 1, 36), "\""), join("Bearer ", F.base64(F.unhex(F.substring(code, 1, 60)).cast("binary")), " ", word),
        join(word, " call ", us, ", ", word), join(word, " tel: ", spaced, " ", word), join(word, " phone number is ", part(1, 3), "-", part(4, 3), "-", part(7, 4)),
        join(word, " ", us, " ", word), join(word, " SSN ", part(1, 3), "-", part(4, 2), "-", part(6, 4), " ", word), join("ssn: ", part(1, 3), "-", part(4, 2), "-", part(6, 4)),
        join(word, " card ", part(1, 4), " ", part(5, 4), " ", part(9, 4), " ", part(13, 4), " ", word), join(word, " account no ", part(1, 10), " ", word),
        join(word, " ", word, "(at)", word, "(dot)com ", word), join(word, " ", word, " [at] mail.", word, " [dot] org ", word), join(word, "@", word, " . com"),
    ]
    bad = [
        join(word, " ", longer, " ", word), join(word, " ", F.upper(longer), "!! ", word), join(word, " well-", word, "-", longer, " ", word),
        join(word, " ", part(1, 8), " ", word), join(word, " ", part(1, 10), " items ", word), join(word, " 20", part(1, 2), "-0", part(4, 1), "-1", part(6, 1), " ", word),
        join(word, " 1", part(1, 1), "/0", part(4, 1), "/19", part(6, 2), " ", word), join(word, " ", part(1, 16), " ", word), join(word, " 19", part(1, 2), "-20", part(3, 2), " ", word),
        join(word, " version ", part(1, 2), ".", part(3, 2), ".", part(5, 3), " ", word), join(word, " pages ", part(1, 4), "-", part(5, 4), " ", word),
        join(word, " http://", word, ".org/", longer, "/", part(1, 7), " ", word), join(word, " ", part(1, 3), " ", part(4, 3), " ", part(7, 3), " people ", word),
        join(word, " total = ", part(1, 9), " ", word), join(word, " ===================== ", word), join(word, " ----------------------- ", word), join("isbn ", part(1, 3), "-", part(4, 1), "-", part(5, 5), "-", part(10, 3), "-", part(13, 1)),
        join(word, " @ ", word, " . ", word, " "), join(word, " meet @ ", word, ". Then ", word), join(word, " word_", longer, " ", word), join(word, " ", part(1, 4), " ", part(5, 4), " ", word),
    ]
    shape = F.col("id").cast("int")
    base = spark.range(rows)
    label = shape % 2
    pick = lambda xs: F.element_at(F.array(*xs), F.floor(F.col("id") / 2).cast("int") % len(xs) + 1)
    return base.select(F.when(label == 1, pick(good)).otherwise(pick(bad)).alias("text"), label.cast("double").alias("label"), "id")


def trained(spark: SparkSession, rows: int = 4000, precision: float = 0.995, trees: int = 30) -> tuple[gbdt.FlatTrees, float]:
    """Trees over the candidates of seeded snippets, and the least score whose precision on snippets that were held out
    is ``precision``. The snippets are made and measured by the same expressions as documents; a few thousand rows of
    numbers come to the driver."""
    measured = F.concat(*[F.transform(F.col(f"hit_{k}"), each(feature_array, k)) for k in ADDED])
    snippets = with_candidates(training_rows(spark, rows)).select("id", "label", F.explode(measured).alias("x"))
    got = sorted((r["id"], tuple(r["x"]), r["label"]) for r in snippets.collect())
    x, y = np.array([r[1] for r in got]), np.array([r[2] for r in got])
    held = np.array([r[0] // 2 // 40 % 2 == 1 for r in got])
    model = gbdt.fit(x[~held], y[~held], trees=trees, rate=0.25, least=2.0, bins=32)
    z, t = model.logit(x[held]), y[held]
    order = np.argsort(-z)
    right = np.cumsum(t[order]) / np.arange(1, len(order) + 1)
    last = np.append(z[order][1:] < z[order][:-1], True)  # a cut lies between different scores
    enough = np.flatnonzero((right >= precision) & last)
    return model, float(z[order][enough[-1]]) if len(enough) else float("inf")


def as_expression(model: gbdt.FlatTrees, x: list[Column]) -> Column:
    """The trees as CASE expressions over feature columns."""

    def node(i: int) -> Column:
        if model.left[i] == i:
            return F.lit(float(model.value[i]))
        return F.when(x[model.feature[i]] <= float(model.threshold[i]), node(model.left[i])).otherwise(node(model.right[i]))

    total = F.lit(model.base)
    for r in model.roots:
        total = total + node(int(r))
    return total


def with_candidates(docs: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """Adds hit_<kind>: the placed matches of every kind (of ``ADDED`` unless named)."""
    kinds = kinds or ADDED
    found = {k: hits(F.col("text"), k) for k in kinds}
    one = docs.withColumns({f"{a}_{k}": pair[i] for k, pair in found.items() for i, a in enumerate(("found", "piece"))})
    two = one.withColumns({f"hit_{k}": placed(F.col(f"found_{k}"), F.col(f"piece_{k}")) for k in kinds})
    return two.drop(*[f"{a}_{k}" for k in kinds for a in ("found", "piece")])


def find_personal_data(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: tuple[gbdt.FlatTrees, float] | None = None
) -> DataFrame:
    """Per document: doc_id, text, base and spans, arrays of (s, k, e): start, number of the kind, end (exclusive), in
    code points, by start and kind. Kinds are numbered as in BASE, then ADDED.

    base holds the valid matches of the four base patterns; spans holds them and the selected candidates. Generators
    propose long keys, long digit groups and written-out addresses; boosted trees score each by its format and what
    stands around it; those above the calibrated threshold are taken, kind by kind in the order of ADDED, where they touch
    no span that is taken already. One pass, no shuffle, whole texts; the work grows with the hits of a text, not with
    their pairs.

    A null text counts as empty. Null ids pass unchanged, repeated rows give repeated results, an empty table none;
    other columns are neither read nor returned.
    """
    spark = docs.sparkSession
    trees, threshold = model or trained(spark)
    own = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    met = with_candidates(own, BASE + ADDED)

    def span(k: str, c: Column) -> Column:
        return F.struct(c["s"].alias("s"), F.lit((BASE + ADDED).index(k)).alias("k"), c["e"].alias("e")).cast(SPAN)

    def likely(k: str, c: Column) -> Column:
        return as_expression(trees, [x.cast("double") for x in features(k, c)]) >= threshold

    base = F.array_sort(F.concat(*[F.transform(F.filter(f"hit_{k}", each(lambda k, c: is_valid(k, c["m"]), k)), each(span, k)) for k in BASE]))
    steps = met.select("doc_id", "text", base.alias("base"), *[F.transform(F.filter(f"hit_{k}", each(likely, k)), each(span, k)).alias(f"likely_{k}") for k in ADDED])
    steps = steps.withColumn("spans", F.col("base"))
    for k in ADDED:
        steps = steps.withColumn("more", apart_from(F.col(f"likely_{k}"), F.col("spans"))).withColumn("spans", F.concat("spans", "more"))
    return steps.select("doc_id", "text", "base", F.array_sort("spans").alias("spans"))


def joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in BASE + ADDED])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def personal_data_digest(docs: DataFrame, **how) -> DataFrame:
    """Per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans (kind:start:end, comma-joined)."""
    found = find_personal_data(docs, **how)
    count = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")
    return found.select(
        "doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(BASE)],
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
    )


def redacted(docs: DataFrame, text_col: str = "text", **how) -> DataFrame:
    """doc_id and the text with every span replaced by its kind in angle brackets; overlapping spans as the first of them."""
    found = find_personal_data(docs, text_col=text_col, **how)
    names = F.array(*[F.lit(k) for k in BASE + ADDED])
    state = "struct<at:int,out:string>"

    def step(acc: Column, x: Column) -> Column:
        put = F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, x["s"] - acc["at"]), F.lit("<"), F.get(names, x["k"]), F.lit(">"))
        return F.when(x["s"] < acc["at"], F.struct(F.greatest(acc["at"], x["e"]).alias("at"), acc["out"].alias("out")).cast(state)).otherwise(
            F.struct(x["e"].alias("at"), put.alias("out")).cast(state)
        )

    text = F.aggregate("spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")).cast(state), step, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))))
    return found.select("doc_id", text.alias("text"))
