"""Mixing sources to target weights: min-cost flow over membership patterns, then seeded selection of documents."""

from __future__ import annotations

import json
from collections import deque

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, word_count

#: A level of the selection's histogram has so many bins.
BINS = 1024


def source_targets(sizes: dict[str | None, int], weights: tuple[float, ...], budget: float, most: float) -> dict[str | None, float]:
    """Target of each source: a share of ``budget`` times all sizes by weight. Sources stand in code point order, null
    last, and take the weights in turn. A target stops at ``most`` times its source; the excess is shared anew by
    weight among the others until no target is above its stop."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    stop = {s: most * sizes[s] for s in order}
    target: dict[str | None, float] = {}
    open_ones, left = list(order), budget * sum(sizes.values())
    while open_ones:
        whole = sum(weight[s] for s in open_ones)
        share = {s: left * weight[s] / whole for s in open_ones}
        above = [s for s in open_ones if share[s] > stop[s]]
        if not above:
            return target | share
        for s in above:
            target[s] = float(stop[s])
            left -= stop[s]
        open_ones = [s for s in open_ones if s not in above]
    return target


class Flow:
    """Min-cost flow with the costs of repetitions: one blocking flow after another, cheapest level first.

    Every path costs what its first arc costs, for all other arcs are free. So the flow that sends all it can over the arcs
    of the cheapest level, then adds the next level, is one of least cost; each level is a maximum flow, found by
    blocking flows over layers (few phases, each linear in the arcs), not by single paths.
    """

    def __init__(self, n: int):
        self.head: list[list[int]] = [[] for _ in range(n)]
        self.to: list[int] = []
        self.room: list[int] = []

    def arc(self, a: int, b: int, room: int) -> int:
        for x, y, r in ((a, b, room), (b, a, 0)):
            self.head[x].append(len(self.to))
            self.to.append(y)
            self.room.append(r)
        return len(self.to) - 2

    def layers(self, s: int) -> list[int]:
        far = [-1] * len(self.head)
        far[s], queue = 0, deque([s])
        while queue:
            a = queue.popleft()
            for e in self.head[a]:
                if self.room[e] and far[self.to[e]] < 0:
                    far[self.to[e]] = far[a] + 1
                    queue.append(self.to[e])
        return far

    def run(self, s: int, t: int) -> None:
        """All that still fits from s to t."""
        while (far := self.layers(s))[t] >= 0:
            at, path, a = [0] * len(self.head), [], s
            while True:
                if a == t:
                    put = min(self.room[e] for e in path)
                    for e in path:
                        self.room[e] -= put
                        self.room[e ^ 1] += put
                    k = next(i for i, e in enumerate(path) if not self.room[e])
                    a, path = self.to[path[k] ^ 1], path[:k]
                elif at[a] < len(self.head[a]):
                    e = self.head[a][at[a]]
                    if self.room[e] and far[self.to[e]] == far[a] + 1:
                        path.append(e)
                        a = self.to[e]
                    else:
                        at[a] += 1
                elif path:
                    a = self.to[path.pop() ^ 1]
                    at[a] += 1
                else:
                    break


def pattern_tokens(patterns: dict[str, int], members: dict[str, list], targets: dict[str | None, float], most: int) -> dict[str, int]:
    """Tokens to take of each membership pattern, at least cost: the r-th repetition of a pattern has its whole size as room
    and costs 2r - 1 a token, so nothing is repeated while first copies can fill the quotas.

    A source that only patterns of itself alone name needs no flow: its one pattern gives its quota, or all it has.
    """
    shared = {s for p in patterns for s in members[p] if len(members[p]) > 1}
    quota = {s: round(t) for s, t in targets.items()}
    alone = {p: min(quota[members[p][0]], most * size) for p, size in patterns.items() if len(members[p]) == 1 and members[p][0] not in shared}
    open_ones = {p: size for p, size in patterns.items() if p not in alone}
    places = {p: k + 1 for k, p in enumerate(open_ones)}
    quotas = {s: len(places) + 1 + k for k, s in enumerate(sorted(shared, key=lambda s: (s is None, s)))}
    sink = len(places) + len(quotas) + 1
    flow, given = Flow(sink + 1), dict.fromkeys(open_ones, 0)
    for p, size in open_ones.items():
        for s in members[p]:
            flow.arc(places[p], quotas[s], most * size)
    for s, node in quotas.items():
        flow.arc(node, sink, quota[s])
    for _ in range(most):
        arcs = {p: flow.arc(0, places[p], size) for p, size in open_ones.items()}
        flow.run(0, sink)
        for p, e in arcs.items():
            given[p] += flow.room[e + 1]
            flow.room[e] = flow.room[e + 1] = 0  # a level that is filled is not taken back: later ones only add
    return alone | given


def _cut(base: DataFrame, need: DataFrame, bin_col: Column) -> DataFrame:
    """For each pattern of ``need`` (pattern, left): the first bin whose running size passes ``left``, and what is left
    before that bin. Bins are summed map-side; a pattern has BINS of them at most."""
    bins = base.groupBy("pattern", bin_col.alias("bin")).agg(F.sum("size").alias("held"))
    running = F.sum("held").over(Window.partitionBy("pattern").orderBy("bin"))
    marked = bins.join(F.broadcast(need), "pattern").withColumn("before", running - F.col("held"))
    over = marked.filter((F.col("before") + F.col("held") > F.col("left")) & (F.col("before") <= F.col("left")))
    return over.groupBy("pattern").agg(F.min("bin").alias("bin"), F.min_by(F.col("left") - F.col("before"), "bin").alias("left"))


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    size: Column | None = None,
    members: Column | None = None,
    weights: tuple[float, ...] = (5, 2, 1),
    budget: float = 1.5,
    most: int = 2,
    seed: int = 42,
    rounds: int = 4,
) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken (tokens the mix takes, repeats counted).

    ``size`` is a document's tokens (words of ``text`` unless given), ``members`` the array of the sources it belongs
    to (its one ``source`` unless given; null is a source of its own). Documents are summed by membership pattern; a
    min-cost flow routes the patterns' tokens to the sources' quotas; then each pattern takes whole documents in the
    order of a seeded hash until its tokens are reached, and ``rounds`` times the largest further document that still
    fits. The running sum needs no global sort: two levels of a 1024-bin histogram of the hash leave a millionth of a
    pattern to be ordered. source_size and target are those of a document's first source in code point order.

    Only sums by pattern come to the driver: as many rows as there are distinct sets of sources, however many documents.
    Sources that no set shares are solved in closed form there, the rest by the flow; there is no cap. Reruns agree,
    whatever the partitioning.
    A null text has size 0 and is never taken; ids may be null or repeated (rows with equal ids are told apart by
    size); an empty table gives no rows; other columns are neither read nor returned.
    """
    spark = docs.sparkSession
    size = word_count(F.col("text")) if size is None else size
    members = F.array(F.col("source")) if members is None else members
    base = materialize(
        docs.select(
            F.col(id_col).alias("doc_id"), size.cast("long").alias("size"),
            F.to_json(F.array_sort(F.array_distinct(members)), {"ignoreNullFields": "false"}).alias("pattern"),
            F.xxhash64(F.lit(seed), F.col(id_col)).alias("u"), F.monotonically_increasing_id().alias("row"),
        )
    )
    sums = [(r["pattern"], int(r["held"])) for r in base.groupBy("pattern").agg(F.sum("size").alias("held")).collect()]
    patterns = dict(sorted(sums))
    member = {p: json.loads(p) for p in patterns}
    sizes: dict[str | None, int] = {}
    for p, held in patterns.items():
        for s in member[p]:
            sizes[s] = sizes.get(s, 0) + held
    targets = source_targets(sizes, weights, budget, most)
    tokens = pattern_tokens(patterns, member, targets, most)

    def small(rows: list[tuple], schema: str) -> DataFrame:
        return spark.createDataFrame(rows, schema)  # a row a pattern

    copies = {p: tokens[p] // held if held else 0 for p, held in patterns.items()}
    left = {p: tokens[p] - copies[p] * held for p, held in patterns.items()}
    need = small([(p, n) for p, n in left.items() if n], "pattern string, left long")
    high = F.shiftrightunsigned("u", 54)
    low = F.shiftrightunsigned("u", 44).bitwiseAND(BINS - 1)
    one = _cut(base, need, high).withColumnRenamed("bin", "bin1")
    one = small([tuple(r) for r in one.select("pattern", "bin1", "left").collect()], "pattern string, bin1 long, left1 long")
    inside = base.join(F.broadcast(one), "pattern").filter(high == F.col("bin1")).drop("left1")
    two = _cut(inside, one.select("pattern", F.col("left1").alias("left")), low).withColumnRenamed("bin", "bin2")
    two = small([tuple(r) for r in two.select("pattern", "bin2", "left").collect()], "pattern string, bin2 long, left2 long")
    edge = inside.join(F.broadcast(two), "pattern").filter(low == F.col("bin2"))
    run = F.sum("size").over(Window.partitionBy("pattern").orderBy("u", F.col("doc_id").asc_nulls_last(), "size", "row"))
    chosen = edge.withColumn("run", run).filter("run <= left2").select("row", F.lit(True).alias("edge_in"))
    marked = base.join(F.broadcast(one), "pattern", "left").join(F.broadcast(two), "pattern", "left").join(chosen, "row", "left")
    before = F.when(high != F.col("bin1"), high < F.col("bin1")).when(low != F.col("bin2"), low < F.col("bin2")).otherwise(F.coalesce("edge_in", F.lit(False)))
    state = materialize(marked.select("row", "doc_id", "size", "pattern", "u", F.coalesce(before, F.lit(False)).alias("extra")))

    got = {r["pattern"]: int(r["held"] or 0) for r in state.filter("extra").groupBy("pattern").agg(F.sum("size").alias("held")).collect()}
    short = {p: n - got.get(p, 0) for p, n in left.items() if n - got.get(p, 0) > 0}
    picked: list[tuple] = []
    for _ in range(rounds):
        if not short:
            break
        gaps = small(list(short.items()), "pattern string, gap long")
        taken = small([(x,) for x in picked], "row long")
        fits = (
            state.filter("NOT extra AND size > 0").join(F.broadcast(gaps), "pattern").filter("size <= gap")
            .join(F.broadcast(taken), "row", "left_anti").groupBy("pattern")
            .agg(F.max(F.struct("size", "u", F.col("doc_id").isNotNull().alias("known"), "doc_id", "row")).alias("best"))
        )
        found = fits.select("pattern", "best.size", "best.row").collect()
        picked += [r["row"] for r in found]
        fitted = {r["pattern"]: r["size"] for r in found}
        short = {p: n - fitted[p] for p, n in short.items() if p in fitted and n > fitted[p]}
    more = small([(x, True) for x in picked], "row long, top_up boolean")
    head = small([(p, copies[p], sizes[member[p][0]], targets[member[p][0]]) for p in patterns if member[p]], "pattern string, copies long, source_size long, target double")
    final = state.join(F.broadcast(more), "row", "left").join(F.broadcast(head), "pattern", "left")
    times = F.col("copies") + F.when(F.col("extra") | F.coalesce("top_up", F.lit(False)), 1).otherwise(0)
    return final.select("doc_id", "size", "source_size", "target", F.coalesce(F.col("size") * times, F.lit(0)).alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them (0 to ``most`` times), columns unchanged.

    Rows that share an id share its decision (the largest taken). A document of size 0 is not taken.
    """
    plan = mix_sources(docs, id_col, **how).filter("taken > 0")
    plan = plan.groupBy(F.col("doc_id").alias("_id")).agg(F.max((F.col("taken") / F.col("size")).cast("int")).alias("_copies"))
    joined = docs.join(plan, F.col(id_col).eqNullSafe(F.col("_id")))
    return joined.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*docs.columns)
