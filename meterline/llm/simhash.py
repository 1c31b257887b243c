"""SimHash near-duplicates: fingerprints, bit-sliced comparison inside banded buckets, connected components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType

from .common import materialize
from .components import smallest_reachable

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Fingerprints that one task compares with one another at most; a larger bucket becomes pairs of such blocks.
BLOCK = 8192
#: Lanes that are compared at a time.
LANES = 1 << 18


def fingerprint(text: str | None, width: int = 3) -> int:
    """64-bit SimHash: a bit is set if it is set in over half of the shingles' XXH64 hashes (seed 42)."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").translate(LOWER).split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    starts, n = [0, *ends[:-1]], max(1, len(words) - width + 1)
    one = xxhash.xxh64_intdigest
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, n, LANES):  # a very long text goes through in pieces
        hashes = np.array([one(joined[s : e - 1], 42) for s, e in zip(starts[at : min(at + LANES, n)], ends[at + min(width, len(words)) - 1 :])], dtype="<u8")  # noqa: B905
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


@pandas_udf(LongType())
def fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series([fingerprint(t) for t in texts], dtype="uint64").astype("int64")


def planes_of(values: np.ndarray) -> np.ndarray:
    """64 bit planes, each packed along the values: plane b holds bit b of all of them."""
    bits = np.unpackbits(values.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    packed = np.packbits(bits.T, axis=1, bitorder="little")
    pad = -packed.shape[1] % 8
    return np.ascontiguousarray(np.pad(packed, ((0, 0), (0, pad)))).view("<u8")


def within_three(differs: Iterator[np.ndarray]) -> np.ndarray:
    """Lanes (bits) in which at most three of the difference planes are set.

    Two counter planes and one sticky plane take each difference by carry-save addition: ones, twos, and whatever
    would carry into fours. The block is given up as soon as all its lanes have reached four.
    """
    ones = twos = over = None
    for k, plane in enumerate(differs):
        if ones is None:
            ones, twos, over = plane.copy(), np.zeros_like(plane), np.zeros_like(plane)
            continue
        carry = ones & plane
        ones ^= plane
        over |= twos & carry
        twos ^= carry
        if k % 8 == 7 and (over == ~np.uint64(0)).all():
            break
    return ~over


def lanes(packed: np.ndarray, n: int) -> np.ndarray:
    return np.unpackbits(packed.view(np.uint8), bitorder="little", axis=-1)[..., :n].astype(bool)


def linked_block(left: np.ndarray, right: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i of left, j of right) at most three bits apart; right lies in bit planes, left walks along them."""
    planes, full = planes_of(right), ~np.uint64(0)
    step = max(1, LANES // max(1, planes.shape[1]) // 16)
    for at in range(0, len(left), step):
        part = left[at : at + step].astype(np.uint64)

        def differ(part=part):
            for b in range(64):
                on = np.where((part >> np.uint64(b)) & np.uint64(1), full, np.uint64(0))
                yield planes[b][None, :] ^ on[:, None]

        close = within_three(differ())
        if close.any():
            i, j = np.nonzero(lanes(close, len(right)))
            yield i + at, j


def linked_pairs(values: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Which of the listed pairs are at most three bits apart; one lane a pair."""
    out = np.zeros(len(left), dtype=bool)
    for at in range(0, len(left), LANES):
        a, b = planes_of(values[left[at : at + LANES]]), planes_of(values[right[at : at + LANES]])
        close = within_three(a[k] ^ b[k] for k in range(64))
        out[at : at + LANES] = lanes(close, min(LANES, len(left) - at))
    return out


class Forest:
    """Union-find over the rows of one task's batch; the smaller node is the root."""

    def __init__(self, nodes: np.ndarray):
        self.nodes, self.up = nodes, np.arange(len(nodes))

    def union(self, i: np.ndarray, j: np.ndarray) -> None:
        """Joins pairs by hooking roots and halving paths, all pairs at once, until nothing changes."""
        while True:
            self.up = self._flat()
            a, b = self.up[i], self.up[j]
            differ = a != b
            if not differ.any():
                return
            i, j, a, b = i[differ], j[differ], a[differ], b[differ]
            swap = self.nodes[a] > self.nodes[b]
            low, high = np.where(swap, b, a), np.where(swap, a, b)
            order = np.argsort(-self.nodes[low], kind="stable")  # the last write, that of the smallest node, stays
            self.up[high[order]] = low[order]

    def _flat(self) -> np.ndarray:
        up = self.up
        while True:
            nxt = up[up]
            if (nxt == up).all():
                return up
            up = nxt

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        """One edge from each row that isn't a root to its root: as many links as rows at most, none lost."""
        self.up = self._flat()
        rows = np.flatnonzero(self.up != np.arange(len(self.up)))
        return self.nodes[rows], self.nodes[self.up[rows]]


def bucket_edges(batch: pd.DataFrame) -> pd.DataFrame:
    """Edges inside the buckets of one frame that is sorted by bucket and holds each of its buckets whole."""
    values, nodes = batch["fp"].to_numpy().view(np.uint64), batch["node"].to_numpy()
    bucket, side = batch["bucket"].to_numpy(), batch["side"].to_numpy()
    part = batch["part"].to_numpy()
    forest = Forest(nodes)
    new = np.append(True, (bucket[1:] != bucket[:-1]) | (part[1:] != part[:-1]))
    starts = np.flatnonzero(new)
    size = np.diff(np.append(starts, len(batch)))
    small, big = starts[size <= 64], starts[size > 64]
    group_end = np.repeat(starts + size, size)
    is_small = np.repeat(size <= 64, size) & (side == 0)
    for off in range(1, int(size[size <= 64].max()) if len(small) else 0):
        i = np.flatnonzero(is_small[: len(batch) - off])
        i = i[i + off < group_end[i]]
        if not len(i):
            break
        close = linked_pairs(values, i, i + off)
        if close.any():
            forest.union(i[close], i[close] + off)
    for s, n in zip(starts, size, strict=True):
        if n <= 64 and side[s : s + n].any():
            big = np.append(big, s)
    lengths = dict(zip(starts.tolist(), size.tolist(), strict=True))
    for s in big.tolist():
        n = lengths[s]
        one = np.flatnonzero(side[s : s + n] <= 1) + s
        two = np.flatnonzero(side[s : s + n] == 2) + s
        two = two if len(two) else one
        for i, j in linked_block(values[one], values[two]):
            forest.union(one[i], two[j])
    a, b = forest.edges()
    return pd.DataFrame({"a": a, "b": b})


def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by (bucket, part): whole buckets are gathered from the batches and compared."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        last = (batch["bucket"].iloc[-1], batch["part"].iloc[-1])
        open_at = int(((batch["bucket"] == last[0]) & (batch["part"] == last[1])).to_numpy().argmax())
        if open_at:
            yield bucket_edges(pd.concat([*held, batch.iloc[:open_at]], ignore_index=True))
            held = []
        elif held and (held[-1]["bucket"].iloc[-1], held[-1]["part"].iloc[-1]) != last:
            yield bucket_edges(pd.concat(held, ignore_index=True))
            held = []
        held.append(batch.iloc[open_at:])
    if held:
        yield bucket_edges(pd.concat(held, ignore_index=True))


def bucket_keys() -> list:
    """Sixteen keys of 28 bits. Three differing bits leave one of four 16-bit bands whole, and of the other 48 bits one
    of four 12-bit bands; so linked fingerprints share a key, while a key is shared by 2^-28 of unrelated ones."""
    keys = []
    fp = F.col("fp")
    for i in range(4):
        band = F.shiftrightunsigned(fp, 16 * i).bitwiseAND(0xFFFF)
        low = fp.bitwiseAND((1 << (16 * i)) - 1) if i else F.lit(0).cast("long")
        high = F.shiftrightunsigned(fp, 16 * (i + 1)) if i < 3 else F.lit(0).cast("long")
        rest = F.shiftleft(high, 16 * i).bitwiseOR(low)
        for j in range(4):
            sub = F.shiftrightunsigned(rest, 12 * j).bitwiseAND(0xFFF)
            keys.append(F.lit(((i * 4 + j) << 28)).bitwiseOR(F.shiftleft(band, 12)).bitwiseOR(sub))
    return keys


def near_links(nodes: DataFrame, block: int = BLOCK) -> DataFrame:
    """Links (a, b), a > b, between distinct fingerprints at most three bits apart, thinned to a forest per bucket.

    ``nodes``: node (long) and fp (long, distinct). Buckets of one fingerprint go before any comparison; buckets of
    more than ``block`` are cut by hash into blocks, and every pair of blocks is compared in a task of its own.
    """
    keyed = nodes.select("node", "fp", F.explode(F.array(*bucket_keys())).alias("bucket"))
    shared = keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    rows = keyed.join(shared, "bucket")
    blocks = F.ceil(F.col("n") / F.lit(float(block))).cast("int")
    mine = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    pair = F.when(
        F.col("blocks") == 1, F.array(F.struct(F.lit(0).alias("part"), F.lit(0).alias("side")))
    ).otherwise(
        F.transform(
            F.sequence(F.lit(0), F.col("blocks") - 1),
            lambda o: F.struct(
                (F.least(F.col("mine"), o) * F.col("blocks") + F.greatest(F.col("mine"), o)).alias("part"),
                F.when(F.col("mine") <= o, 1).otherwise(2).alias("side"),
            ),
        )
    )
    dealt = (
        rows.withColumn("blocks", blocks).withColumn("mine", mine)
        .select("bucket", "node", "fp", F.explode(pair).alias("p"))
        .select("bucket", "node", "fp", F.col("p.part").alias("part"), F.col("p.side").alias("side"))
    )
    return dealt.repartition("bucket", "part").sortWithinPartitions("bucket", "part").mapInPandas(compare, "a long, b long")


def simhash_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable over links).

    Links join fingerprints at most three bits apart. The fingerprint itself is the node, so groups of copies cost one
    row and rows without an id link like any other; links are found by bit-sliced comparison in shared buckets and closed
    by connected components, and only then a component gets the smallest id of its rows. Null and empty texts have
    fingerprint zero. Ids may repeat (each row is returned, and each of its fingerprints is a node of its own); a
    component whose ids are all null has a null component_id. An empty table gives no rows. Other columns are neither
    read nor returned.
    """
    marked = materialize(docs.select(F.col(id_col).alias("doc_id"), fingerprints(F.col(text_col)).alias("fp")))
    nodes = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    links = materialize(near_links(nodes.select("fp", F.col("fp").alias("node"))).distinct())
    label = materialize(smallest_reachable(links).withColumnRenamed("node", "fp"))
    linked = nodes.join(label, "fp")
    roots = nodes.join(label.select(F.col("component").alias("fp")).distinct(), "fp", "left_semi").select(F.col("fp").alias("component"), "least")
    named = linked.select("component", "least").unionByName(roots).groupBy("component").agg(F.min("least").alias("component_id"))
    class_of = label.unionByName(label.select(F.col("component").alias("fp"), "component").distinct())
    ids = class_of.join(named, "component").select("fp", "component_id")  # linked nodes only: others would meet at one null key
    reached = nodes.join(ids, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    return marked.join(reached, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def brute_force_links(values: list[int]) -> set[tuple[int, int]]:
    """All pairs of positions at most three bits apart; for tests."""
    return {(i, j) for i, j in combinations(range(len(values)), 2) if (values[i] ^ values[j]).bit_count() <= 3}
