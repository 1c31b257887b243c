"""A Merkle manifest of a data set: ternary hash trees per source under one root, proofs by octopus multiproofs."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize

#: Children of a node.
FAN = 3
#: The tree of the subroots. Keys of source trees are never empty.
TOP = ""
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_INDEX_BITS = 33  # of monotonically_increasing_id: the row's place in its partition


class Shape(NamedTuple):
    """How trees are cut. A unit is a subtree of ``unit_levels`` levels (2187 leaves), which one task folds in memory;
    units are dealt to leaf partitions that begin ``leaves`` apart, so a partition holds less than that and a unit."""

    unit_levels: int = 7
    leaves: int = 8192

    @property
    def unit(self) -> int:
        return FAN**self.unit_levels


def digest(parts: Iterable[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def height(leaves: int) -> int:
    """Levels above the leaves of a tree."""
    levels = 0
    while leaves > 1:
        leaves, levels = -(-leaves // FAN), levels + 1
    return levels


def level_size(leaves: int, level: int) -> int:
    return -(-leaves // FAN**level)


def leaf_hash(*values: Column) -> Column:
    """SHA-256 of the values' texts, each behind its length in bytes, ``-`` for null."""
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(v), F.lit(":"), v), F.lit("-")) for v in (v.cast("string") for v in values)]), 256)


def ranked(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``rows`` (written) with rank (place within its key, from 0), size (rows of the key) and start (rows of all keys
    before it), by ``order``.

    No key is gathered in one task: rows are range-partitioned by key and order, a key with a third of all rows spreads
    over many partitions, and places are sums over the counts of (partition, key), which are few.
    """
    tied = rows.withColumn("_tie", F.monotonically_increasing_id())
    dealt = tied.repartitionByRange(key, *order, "_tie").sortWithinPartitions(key, *order, "_tie").drop("_tie")
    placed = materialize(dealt.withColumn("_mid", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright("_mid", _INDEX_BITS)).withColumn("_at", F.col("_mid").bitwiseAND((1 << _INDEX_BITS) - 1))
    cells = materialize(placed.groupBy("_part", key).agg(F.count(F.lit(1)).alias("n"), F.min("_at").alias("first")))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    parts = cells.groupBy("_part").agg(F.sum("n").alias("rows")).select("_part", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("before"))
    cells = cells.join(parts, "_part")
    spans = cells.groupBy(key).agg(F.min(F.col("before") + F.col("first")).alias("start"), F.sum("n").alias("size"))
    cells = materialize(cells.join(spans, key).select("_part", key, "before", "start", "size"))
    return placed.join(cells, ["_part", key]).withColumn("rank", F.col("before") + F.col("_at") - F.col("start")).drop("_part", "_at", "_mid", "before")


def bucket_of(level: int, shape: Shape) -> Column:
    """The leaf partition of a node's unit: units that stand beside each other share one."""
    unit_start = F.floor(F.col("rank") / shape.unit) * shape.unit
    return F.floor((F.floor(F.col("start") / FAN**level) + unit_start) / shape.leaves).cast("long")


def fold_unit(hashes: list[str], leaves: int, level: int, shape: Shape) -> list[list[str]]:
    """The levels of a unit from the nodes at ``level`` upwards, till the unit's or the tree's top."""
    levels = [hashes]
    for _ in range(min(shape.unit_levels, height(leaves) - level)):
        below = levels[-1]
        levels.append([digest(below[i : i + FAN]) for i in range(0, len(below), FAN)])
    return levels


def units_of(frame: pd.DataFrame, shape: Shape) -> Iterable[tuple[str, int, int, pd.DataFrame]]:
    """(key, unit, size, rows by rank) of every unit in a leaf partition."""
    frame = frame.sort_values(["key", "rank"], ignore_index=True)
    for (key, unit), rows in frame.groupby(["key", frame["rank"] // shape.unit], sort=True):
        yield key, int(unit), int(rows["size"].iloc[0]), rows


NODES = "key string, level int, at long, size long, start long, hash string"


def fold_tier(level: int, inner: bool, shape: Shape) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Of a partition's nodes at ``level``: the tops of its units, with ``inner`` the levels between too."""

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for key, unit, size, rows in units_of(frame, shape):
            levels = fold_unit(rows["hash"].tolist(), size, level, shape)
            for up in range(1 if inner else len(levels) - 1, len(levels)):
                out += [(key, level + up, unit * FAN ** (shape.unit_levels - up) + i, size, int(rows["start"].iloc[0]), h) for i, h in enumerate(levels[up])]
        return pd.DataFrame(out, columns=["key", "level", "at", "size", "start", "hash"])

    return fold


def build_trees(leaves: DataFrame, shape: Shape, whole: bool = False) -> DataFrame:
    """All nodes from the units' tops upwards of the trees whose leaves are (key, rank, size, start, hash); with
    ``whole`` those below the tops too, but for the leaves.

    One pass folds a unit at a time, so 2187 times fewer nodes go into each next pass; the passes' number is the
    logarithm of the largest tree to that base.
    """
    tallest = height(leaves.agg(F.max("size")).first()[0] or 0)
    tier, level, nodes = leaves, 0, None
    while True:
        work = tier.select("key", "rank", "size", "start", "hash", bucket_of(level, shape).alias("bucket"))
        found = materialize(work.groupBy("bucket").applyInPandas(fold_tier(level, inner=whole or level > 0, shape=shape), NODES))
        nodes = found if nodes is None else nodes.unionByName(found)
        level += shape.unit_levels
        if level >= tallest:
            return nodes
        tier = found.filter(F.col("level") == level).withColumnRenamed("at", "rank")


def climb(known: dict[str, set[int]], level_of: dict[str, int], sizes: dict[str, int], ranks: dict[str, int], sources: int) -> list[tuple[str, int, int]]:
    """The least set of nodes (tree, level, place) that, with the nodes known of each source tree, gives all its
    partition's paths to the root: siblings that no known node yields. Parents of whole runs are derived, never asked
    for, and a source's root is known as a leaf of the top tree."""
    missing = []

    def up(tree: str, level: int, have: set[int], size: int) -> None:
        for at in range(level, height(size)):
            width = level_size(size, at)
            runs = {i // FAN for i in have}
            missing.extend((tree, at, i) for run in sorted(runs) for i in range(run * FAN, min(run * FAN + FAN, width)) if i not in have)
            have = runs

    for key, have in known.items():
        up(key, level_of[key], have, sizes[key])
    up(TOP, 0, {ranks[key] for key in known}, sources)
    return missing


def ask(frame: pd.DataFrame) -> pd.DataFrame:
    """The nodes that a leaf partition fetches, from its units (key, at, level, size, source_rank, sources)."""
    known = {k: set(v.astype(int)) for k, v in frame.groupby("key")["at"]}
    firsts = frame.drop_duplicates("key").set_index("key")
    nodes = climb(known, firsts["level"].astype(int).to_dict(), firsts["size"].astype(int).to_dict(), firsts["source_rank"].astype(int).to_dict(), int(frame["sources"].iloc[0]))
    return pd.DataFrame([(int(frame["bucket"].iloc[0]), *x) for x in nodes], columns=["bucket", "key", "level", "at"])


def expand(leaves: pd.DataFrame, fetched: pd.DataFrame, shape: Shape) -> pd.DataFrame:
    """Every leaf's proof and what folds from it, out of one partition's leaves and its fetched nodes."""
    nodes = {(k, int(lv), int(i)): h for k, lv, i, h in zip(fetched["key"], fetched["level"], fetched["at"], fetched["hash"], strict=True)}
    folded: list[tuple[str, int, int, list[list[str]], pd.DataFrame]] = []
    for key, unit, size, rows in units_of(leaves, shape):
        levels = fold_unit(rows["hash"].tolist(), size, 0, shape)
        nodes[key, len(levels) - 1, unit] = levels[-1][0]
        folded.append((key, unit, size, levels, rows))

    def node(tree: str, level: int, at: int, size: int) -> str:
        """A node that was fetched, or is derived from its children and remembered."""
        if (tree, level, at) not in nodes:
            below = level_size(size, level - 1)
            nodes[tree, level, at] = digest(node(tree, level - 1, i, size) for i in range(at * FAN, min(at * FAN + FAN, below)))
        return nodes[tree, level, at]

    def beside(tree: str, level: int, at: int, size: int) -> list[tuple[str, str]]:
        """What stands left and right of the path from a node to its tree's root, level by level."""
        path = []
        for lv in range(level, height(size)):
            run, width = at // FAN * FAN, level_size(size, lv)
            path.append(("".join(node(tree, lv, i, size) for i in range(run, at)), "".join(node(tree, lv, i, size) for i in range(at + 1, min(run + FAN, width)))))
            at //= FAN
        return path

    sources = int(leaves["sources"].iloc[0])
    first = {k: (int(r), len(lv) - 1) for k, _, _, lv, rows in folded for r in [rows["source_rank"].iloc[0]]}
    for key, unit, size, levels, _ in folded:  # subroots first: they are leaves of the top tree
        nodes[TOP, 0, first[key][0]] = node(key, height(size), 0, size)
    out = []
    for key, unit, size, levels, rows in folded:
        source_rank, low = first[key]
        above = beside(key, low, unit, size) + beside(TOP, 0, source_rank, sources)
        subroot, root = nodes[TOP, 0, source_rank], node(TOP, height(sources), 0, sources)
        rest = "".join(left + right for left, right in above)
        ends = {}  # what the shared upper path folds to, by the value that enters it
        for i, (leaf, tampered) in enumerate(zip(levels[0], rows["tampered"], strict=True)):
            value, at, proof = tampered or leaf, i, []
            for level in levels[:-1]:
                run = at // FAN * FAN
                left, right = "".join(level[run:at]), "".join(level[at + 1 : run + FAN])
                proof.append(left + right)
                value, at = digest((left, value, right)), at // FAN
            if value not in ends:
                end = value
                for left, right in above:
                    end = digest((left, end, right))
                ends[value] = end
            out.append((leaf, subroot, root, "".join(proof) + rest, ends[value]))
    done = pd.DataFrame(out, columns=["leaf", "subroot", "root", "proof", "folded_root"])
    done["ident"] = [ident for *_, rows in folded for ident in rows["ident"]]
    return done


PROVED = "ident string, leaf string, subroot string, root string, proof string, folded_root string"


def merkle_proofs(leaves: DataFrame, shape: Shape = Shape()) -> DataFrame:
    """ident, leaf, subroot, root, proof, folded_root for leaves (key, order, ident, hash, tampered).

    ``key`` (not null, not empty) is the source tree, whose leaves stand by ``order``; trees stand by their keys. ``ident`` is a text that comes back with the leaf.
    ``proof`` is the hex text of all siblings from the leaf to the root. ``tampered`` is a leaf hash to fold instead of
    the original, null for none. Leaves are written once, range-partitioned; a leaf partition asks for the least union
    of the nodes that its paths miss, joins them once, and derives all else from its own leaves.
    """
    placed = ranked(leaves, "key", ["order", "hash"])
    nodes = build_trees(placed, shape)
    # a tree is its own unit's top at least, so every key has its root among the nodes
    top_level = F.udf(height, "int")
    roots = nodes.filter(F.col("level") == top_level("size")).select("key", "hash")
    subroots = ranked(roots.select(F.lit(TOP).alias("tree"), F.col("key").alias("order"), "hash"), "tree", ["order"])
    subroots = materialize(subroots.select(F.col("tree").alias("key"), "order", "rank", "size", "start", "hash"))
    top_nodes = subroots.select("key", F.lit(0).alias("level"), F.col("rank").alias("at"), "hash").unionByName(build_trees(subroots, shape, whole=True).select("key", "level", "at", "hash"))
    places = subroots.select(F.col("order").alias("key"), F.col("rank").alias("source_rank"), F.col("size").alias("sources"))

    dealt = materialize(placed.join(places, "key").withColumn("bucket", bucket_of(0, shape)))
    units = dealt.filter(F.col("rank") % shape.unit == 0).select(
        "bucket", "key", F.floor(F.col("rank") / shape.unit).alias("at"), F.least(F.lit(shape.unit_levels), top_level("size")).alias("level"), "size", "source_rank", "sources"
    )
    asked = units.groupBy("bucket").applyInPandas(ask, "bucket long, key string, level int, at long")
    known = nodes.select("key", "level", "at", "hash").unionByName(top_nodes)
    fetched = asked.join(known, ["key", "level", "at"])

    def prove(own: pd.DataFrame, nodes: pd.DataFrame) -> pd.DataFrame:
        return expand(own, nodes, shape)

    return dealt.groupBy("bucket").cogroup(fetched.groupBy("bucket")).applyInPandas(prove, PROVED)


def merkle_manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, with_proofs: bool = True, shape: Shape = Shape()) -> DataFrame:
    """One row per document: its id, leaf, subroot, root, proof_sha256, folded_root, verified, and the proof itself.

    ``fields``: the leaf's columns in order; the first is the id, the second the source, the last the text. Per source,
    leaves ascend by id (null first, then by leaf hash), sources by name (null first, bytewise). Where 2 divides the
    CRC-32 of the decimal id the audit folds a leaf whose text has lost its line breaks, against the original siblings;
    a null id is never tampered with. Repeated ids and rows are leaves of their own; an empty table gives no rows;
    other columns are ignored. ``with_proofs`` adds ``proof``: the siblings' hex digests, 64 characters each.
    """
    ident, source, text = fields[0], fields[1], fields[-1]
    values = [F.col(c) for c in fields]
    changed = leaf_hash(*values[:-1], F.replace(F.col(text), F.lit("\n"), F.lit("")))
    tampering = F.col(ident).isNotNull() & (F.crc32(F.col(ident).cast("string")) % 2 == 0)
    leaves = docs.select(
        F.col(ident).alias("order"), F.col(ident).cast("string").alias("ident"), F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("-")).alias("key"),
        leaf_hash(*values).alias("hash"), F.when(tampering, changed).alias("tampered"),
    )
    proved = merkle_proofs(materialize(leaves), shape)
    return proved.select(
        F.col("ident").cast(docs.schema[ident].dataType).alias("doc_id"), "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"), *(["proof"] if with_proofs else []),
    )


#: DuckDB SQL for merkle_manifest over documents, without the proofs' texts.
MERKLE_SQL = """
WITH RECURSIVE
  crc AS (SELECT list_transform(range(256), lambda n: list_reduce([n] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
  coded AS (SELECT doc_id, coalesce('=' || source, '-') AS key, text,
      coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
      xor(list_reduce([4294967295] || list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ord(substr(doc_id::VARCHAR, i, 1))::BIGINT), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 2 = 0 AS tampers
    FROM documents, crc),
  hashed AS (SELECT doc_id, key, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS h,
      CASE WHEN tampers THEN sha256(head || coalesce(strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-')) END AS bad FROM coded),
  leaves AS (SELECT *, row_number() OVER (ORDER BY key, doc_id NULLS FIRST, h) AS id, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, h) - 1 AS r, count(*) OVER (PARTITION BY key) AS n FROM hashed),
  nodes(key, lvl, i, n, h) AS (
    SELECT key, 0, r, n, h FROM leaves
    UNION ALL SELECT key, lvl + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM nodes WHERE n > 1 GROUP BY key, lvl, i // 3, n),
  subroots AS (SELECT key, h, row_number() OVER (ORDER BY key) - 1 AS r, count(*) OVER () AS n FROM nodes WHERE n = 1),
  tops(lvl, i, n, h) AS (
    SELECT 0, r, n, h FROM subroots
    UNION ALL SELECT lvl + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM tops WHERE n > 1 GROUP BY lvl, i // 3, n),
  beside AS (
    SELECT id, 0 AS tree, lvl, coalesce(string_agg(b.h, '' ORDER BY i) FILTER (i < l.r // pow(3, lvl)::BIGINT), '') AS lft, coalesce(string_agg(b.h, '' ORDER BY i) FILTER (i > l.r // pow(3, lvl)::BIGINT), '') AS rgt
    FROM leaves l JOIN nodes b ON l.key = b.key AND b.n > 1 AND b.i // 3 = l.r // pow(3, lvl + 1)::BIGINT GROUP BY id, lvl
    UNION ALL
    SELECT id, 1, lvl, coalesce(string_agg(b.h, '' ORDER BY i) FILTER (i < s.r // pow(3, lvl)::BIGINT), ''), coalesce(string_agg(b.h, '' ORDER BY i) FILTER (i > s.r // pow(3, lvl)::BIGINT), '')
    FROM leaves l JOIN subroots s ON l.key = s.key JOIN tops b ON b.n > 1 AND b.i // 3 = s.r // pow(3, lvl + 1)::BIGINT GROUP BY id, lvl),
  steps AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY tree, lvl) AS step, count(*) OVER (PARTITION BY id) AS last FROM beside),
  folds(id, step, h) AS (
    SELECT id, 0, coalesce(bad, h) FROM leaves
    UNION ALL SELECT f.id, f.step + 1, sha256(lft || f.h || rgt) FROM folds f JOIN steps s ON s.id = f.id AND s.step = f.step + 1),
  ends AS (SELECT id, arg_max(h, step) AS folded FROM folds GROUP BY id),
  proofs AS (SELECT id, string_agg(lft || rgt, '' ORDER BY step) AS proof FROM steps GROUP BY id)
SELECT l.doc_id, l.h AS leaf, s.h AS subroot, t.h AS root, sha256(coalesce(proof, '')) AS proof_sha256, folded AS folded_root, folded = t.h AS verified
FROM leaves l JOIN subroots s ON l.key = s.key JOIN (SELECT h FROM tops WHERE n = 1) t ON TRUE JOIN ends e ON e.id = l.id LEFT JOIN proofs p ON p.id = l.id
"""
