"""Rate tables, model resolution and pricing.

A rate table is flat: each row names prices of one key in one tier from one day on. A row of the base tier may name only
what changes; a row of the tier above ``over`` prompt tokens stands for that tier as a whole. Every later step works on
the validity intervals that effective_rates() makes of these rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import clean_model, is_placeholder

PRICE_NAMES = ["input", "output", "cache_read", "write_5m", "write_1h", "write_30m"]
RATE_SCHEMA = "key string, starts string, over bigint, " + ", ".join(f"{p} decimal(12,6)" for p in PRICE_NAMES)
FIRST_DAY, LAST_DAY = "0000-01-01", "9999-12-31"
#: Short names of the prices; a missing write price is the first of these that is named.
SHORT = {"in": ["input"], "out": ["output"], "read": ["cache_read"], **{x: [f"write_{x}", "write_5m", "write_30m", "write_1h"] for x in ("5m", "1h", "30m")}}
#: Rated models that are broadcast at most; beyond it the join is left to the optimizer.
BROADCAST_ROWS = 100_000

#: A compact rate table (USD per million tokens), in the order of RATE_SCHEMA.
DEFAULT_RATES = [
    ("default", None, None, "1.7", "6.3", "0.21", "2.1", None, None),
    ("atlas-3", None, None, "2.9", "13.5", "0.33", "3.6", "5.4", None),
    ("atlas-3", None, 180_000, "5.6", "21.5", "0.66", "7.1", "10.9", None),
    ("atlas-3.5", None, None, "3.7", "14.9", "0.42", "4.6", "7.3", None),
    ("borea-2", None, None, "1.15", "9.3", "0.117", None, None, "1.45"),
    ("borea-2", "2024-01-15", None, "0.95", "7.7", None, None, None, None),
    ("borea-2-mini", None, None, "0.22", "1.9", "0.004321", None, None, None),
    ("cirrus-4.1", None, None, "1.9", "9.1", "0.47", None, None, None),
    ("cirrus-4.1", None, 120_000, "3.7", "17.5", None, None, None, None),
    ("cirrus-4.1-rapid", None, None, "3.8", "18.6", "0.93", None, None, None),
    ("cirrus-4.1-rapid", None, 90_000, "7.4", "36.8", None, None, None, None),
    ("cirrus-4.1-rapid", "2024-01-20", None, "4.7", None, None, None, None, None),
    ("cirrus-4.1-rapid", "2024-01-20", 260_000, "9.2", None, None, None, None, None),
    ("dorado-5", None, None, "4.6", "22.4", "0.46", "5.8", "9.1", None),
    ("local-llm", None, None, "0", "0", "0", None, None, None),
]


@dataclass(frozen=True)
class Family:
    """How names that start with ``starts`` may borrow a price.

    ``closed``: only from the name without a date or one of ``suffixes`` behind it. ``variant``: names that hold it are
    another product and borrow only from the name without one of ``fillers`` in front of it. ``heirs``: keys to ask in
    turn when no key is a prefix of the name.
    """

    starts: str
    closed: bool = False
    suffixes: tuple[str, ...] = ()
    variant: str = ""
    fillers: tuple[str, ...] = ()
    heirs: tuple[str, ...] = ()

    def claims(self, name: Column) -> Column:
        """Whether this family alone decides about the name."""
        mine = name.startswith(self.starts)
        return mine if self.closed else mine & name.contains(self.variant) if self.variant else F.lit(False)

    def lenders(self, name: Column) -> Column:
        """The keys that a claimed name may use, best first."""
        if self.closed:
            dated = F.when(F.right(name, F.lit(9)).rlike("^-[0-9]{8}$"), F.left(name, F.length(name) - 9))
            return F.array(name, dated, *[F.when(name.endswith(f"-{s}"), F.left(name, F.length(name) - len(s) - 1)) for s in self.suffixes])
        return F.array(name, *[F.when(name.endswith(f + self.variant), F.replace(name, F.lit(f + self.variant), F.lit(self.variant))) for f in self.fillers])


DEFAULT_RULES = [
    Family("cirrus-4", variant="-rapid", fillers=("-eu", "-batch")),
    Family("dorado-", closed=True, suffixes=("eco", "steady", "steady-wide")),
    Family("atlas", heirs=("atlas-3.5", "atlas-3")),
    Family("borea", heirs=("borea-3", "borea-2")),
    Family("cirrus", heirs=("cirrus-4.1",)),
]


def load_rates(spark: SparkSession, path: str) -> DataFrame:
    """Rate rows, one JSON object a line with the names of RATE_SCHEMA. The table must hold the key ``default``."""
    rates = spark.read.schema(RATE_SCHEMA).json(path)
    if rates.filter("key = 'default'").isEmpty():
        raise ValueError("the rate table has no default entry")
    return rates


def default_rates(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(DEFAULT_RATES, "key string, starts string, over bigint, " + ", ".join(f"{p} string" for p in PRICE_NAMES))
    return rows.select("key", "starts", "over", *[F.col(p).cast("decimal(12,6)").alias(p) for p in PRICE_NAMES])


def effective_rates(rates: DataFrame) -> DataFrame:
    """One row a key and validity interval [valid_from, valid_to): both tiers' prices and the threshold between them.

    At each day on which a key's rows change something, a base price is the last one named, the upper tier the last row
    of that tier; what that row leaves open is the base price. A missing write price is the first of 5m, 30m, 1h that
    the same tier has, or 0.
    """
    base = F.col("over").isNull()
    days = rates.groupBy("key", F.coalesce("starts", F.lit(FIRST_DAY)).alias("valid_from")).agg(
        *[F.max(F.when(base, F.col(p))).alias(p) for p in PRICE_NAMES], F.max(F.when(~base, F.struct("over", *PRICE_NAMES))).alias("tier")
    )
    of_key = Window.partitionBy("key").orderBy("valid_from")
    so_far = of_key.rowsBetween(Window.unboundedPreceding, 0)
    named = days.select(
        "key", "valid_from", F.coalesce(F.lead("valid_from").over(of_key), F.lit(LAST_DAY)).alias("valid_to"),
        *[F.last(c, ignorenulls=True).over(so_far).alias(c) for c in [*PRICE_NAMES, "tier"]],
    )
    upper = lambda p: F.coalesce(F.col(f"tier.{p}"), F.col(p))
    price = lambda of, names: F.coalesce(*[of(p) for p in names], F.lit(0)).cast("decimal(12,6)")
    prices = [price(of, names).alias(f"{tier}_{short}") for tier, of in (("r", F.col), ("l", upper)) for short, names in SHORT.items()]
    return named.select("key", "valid_from", "valid_to", F.col("tier.over").alias("threshold"), *prices)


def prefixes(name: Column) -> Column:
    """The name's own beginnings, longest first, that may lend it a price: not across a version. What follows may not
    start with a dot unless the beginning has one, nor be a dash with one or two digits."""

    def usable(n: Column) -> Column:
        head, rest = F.left(name, n), F.substring(name, n + 1, F.length(name))
        other_version = (rest.startswith(".") & ~head.contains(".")) | rest.rlike(r"^-[0-9]{1,2}(?![0-9])")
        return F.when(~other_version, head)

    return F.transform(F.when(F.length(name) > 0, F.sequence(F.length(name), F.lit(1), F.lit(-1))), usable)


def resolve_price_key(models: DataFrame, rates: DataFrame, rules: list[Family] | None = None) -> DataFrame:
    """model, clean, key, status for every distinct model.

    A family that claims a name decides alone; else the longest allowed beginning of the name that is a key, else the
    heirs of its families. A name offers keys, which are joined to the table: no name is compared with every key.
    status is exact, borrowed, unknown or placeholder.
    """
    rules = DEFAULT_RULES if rules is None else rules
    distinct = models.select("model").distinct().withColumn("clean", clean_model(F.col("model")))
    name, none = F.col("clean"), F.array().cast("array<string>")
    heirs = [F.when(name.startswith(f.starts), F.array(*[F.lit(h) for h in f.heirs])).otherwise(none) for f in rules if f.heirs]
    offers = F.concat(F.coalesce(prefixes(name), none), *heirs)
    for family in reversed(rules):
        offers = F.when(family.claims(name), family.lenders(name)).otherwise(offers)
    offered = distinct.select("model", F.posexplode(offers).alias("place", "key")).filter("key IS NOT NULL")
    keys = rates.select("key").filter("key <> 'default'").distinct()
    found = offered.join(keys, "key").groupBy("model").agg(F.min_by("key", "place").alias("key"))
    status = F.when(is_placeholder(F.col("model")), "placeholder").when(F.col("key").isNull(), "unknown").when(F.col("key") == name, "exact").otherwise("borrowed")
    return distinct.join(found, "model", "left").withColumn("status", status)


def rated_models(models: DataFrame, rates: DataFrame, rules: list[Family] | None = None) -> DataFrame:
    """model, key, status and the model's price intervals; unknown models and placeholders get the default's."""
    resolved = resolve_price_key(models, rates, rules).withColumn("price_key", F.coalesce("key", F.lit("default")))
    prices = effective_rates(rates).withColumnRenamed("key", "price_key")
    return resolved.join(prices, "price_key").drop("clean", "price_key")


def with_rates(events: DataFrame, rates: DataFrame, rules: list[Family] | None = None) -> DataFrame:
    """Events (derived, see functions.measures) with the prices of their own local day and context tier: p_in, p_out,
    p_read, p_5m, p_1h, status and price_key. The tier is decided for each record: above the threshold, not at it; an
    unknown prompt is the base tier.

    The models are resolved once, in one job over their column alone, which brings BROADCAST_ROWS + 1 rows to the driver
    at most. Where that is all of them they are broadcast, so that the ledger is read once more and not shuffled before
    its sums; else the join is left to the optimizer.
    """
    rated = rated_models(events, rates, rules).withColumnsRenamed({"model": "rated_model", "key": "price_key"})
    rows = rated.limit(BROADCAST_ROWS + 1).collect()
    rated = F.broadcast(events.sparkSession.createDataFrame(rows, rated.schema)) if len(rows) <= BROADCAST_ROWS else rated
    day = F.date_format("date_local", "yyyy-MM-dd")
    same = F.col("model").eqNullSafe(F.col("rated_model")) & (day >= F.col("valid_from")) & (day < F.col("valid_to"))
    is_long = F.coalesce(F.col("request_prompt_tokens") > F.col("threshold"), F.lit(False))
    priced = events.join(rated, same).withColumns({f"p_{c}": F.when(is_long, F.col(f"l_{c}")).otherwise(F.col(f"r_{c}")) for c in SHORT})
    return priced.drop(*[f"{a}_{c}" for a in "rl" for c in SHORT], "p_30m", "rated_model", "valid_from", "valid_to", "threshold")


def amount(tokens: str, price: str) -> Column:
    return F.col(tokens).cast("decimal(20,0)") * F.col(price)


def micro_cost() -> Column:
    """Cost in millionths of a USD, exact; reasoning is not charged again."""
    return amount("input_tokens", "p_in") + amount("output_billed", "p_out") + amount("cache_read_tokens", "p_read") + amount("cache_creation_tokens", "p_5m") + amount("cache_creation_1h_tokens", "p_1h")


def micro_savings() -> Column:
    """What cache reads saved against full-price input, never negative, in millionths of a USD."""
    return F.col("cache_read_tokens").cast("decimal(20,0)") * F.greatest(F.lit(0).cast("decimal(13,6)"), F.col("p_in") - F.col("p_read"))


def usd(micro: Column, places: int = 4) -> Column:
    """Micro-dollars as USD, rounded half up once, at the end."""
    return F.round(micro.cast("double") / 1e6, places)


def price_events(events: DataFrame, rates: DataFrame, rules: list[Family] | None = None) -> DataFrame:
    """Events with cost_micro and saved_micro, exact decimals, for each record."""
    return with_rates(events, rates, rules).withColumns({"cost_micro": micro_cost(), "saved_micro": micro_savings()})


SUMS = ["input_tokens", "output_billed", "cache_read_tokens", "cache_creation_tokens", "cache_creation_1h_tokens", "reasoning_tokens", "total_norm"]


def priced_groups(events: DataFrame, rates: DataFrame, keys: list[str], rules: list[Family] | None = None) -> DataFrame:
    """Token sums, records and exact costs by ``keys`` and price: the one pass over the ledger that reports build on.

    Tokens are summed as integers map-side first; decimals are multiplied only on the few groups.
    """
    prices = ["p_in", "p_out", "p_read", "p_5m", "p_1h"]
    grouped = with_rates(events, rates, rules).groupBy(*keys, *prices).agg(*[F.sum(c).alias(c) for c in SUMS], F.count(F.lit(1)).alias("records"))
    return grouped.withColumns({"cost_micro": micro_cost(), "saved_micro": micro_savings()}).drop(*prices)


def classify_models(models: DataFrame, rates: DataFrame, rules: list[Family] | None = None) -> DataFrame:
    """model, status (exact, borrowed, unknown, placeholder) and the entry a borrowed price comes from."""
    got = resolve_price_key(models, rates, rules)
    return got.select("model", "status", F.when(F.col("status") == "borrowed", F.col("key")).alias("priced_as"))
