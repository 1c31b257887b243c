"""Removal of long repeated substrings: run-compressed indexes over pieces dealt by content, matching statistics, marks."""

from __future__ import annotations

import gc
import hashlib
import time
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialize
from .run_index import NOBODY, RunIndex

#: Bytes of an anchor: the string of this length with the least hash stands for all strings of ``length`` around it.
ANCHOR = 16
#: Strings that begin in one piece at most: their marks fit a long.
MOST = 62
#: Bits of the filter of repeated anchors, at least (16 MB); for each of them; and how often the least it may become
#: (64 MB). A fuller filter lets more through, never less.
FILTER_BITS, BITS_EACH, FILTER_GROWS = 1 << 27, 8, 4
#: Rounds, each for a share of the anchors: only that share's pieces lie on disk at a time; a round hashes all texts.
ROUNDS = 2
#: Bytes of pieces that share an index, and what a bucket may hold before it is settled string by string.
BUCKET_BYTES, BUCKET_MOST = 256 * 1024, 1024 * 1024
#: Bytes that are hashed at a time, so that intermediate arrays stay in a CPU's cache.
BLOCK = 1 << 18


def release(spark: SparkSession) -> None:
    """Shuffle files of finished jobs go once the driver has dropped their plans; left to itself that may take half an
    hour. The first round frees what refers to a plan, the second the plan."""
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.3)


def anchor_runs(flat: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, begin, count, anchor) of every run of neighbouring strings of ``length`` bytes with one anchor, MOST at most.

    ``flat`` holds texts that end at ``ends``; no string crosses two texts. ``begin`` is a place in ``flat``. A string's
    anchor is the least hash of its parts of ANCHOR bytes, so it depends on the string alone.
    """
    texts, begins, counts, anchors = [], [], [], []
    starts = np.append(0, ends[:-1])
    padded = np.append(flat, np.zeros(8, dtype=np.uint8))
    first = 0
    while first < len(ends):
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + BLOCK, side="right")))
        # a long text goes in overlapping blocks
        for low in range(int(starts[first]), max(int(ends[last - 1]) - length + 1, int(starts[first]) + 1), 4 * BLOCK):
            high = min(low + 4 * BLOCK + length - 1, int(ends[last - 1]))
            n = high - low - length + 1
            if n <= 0:
                continue
            least = _least_hashes(padded[low : high + 8], high - low, length)
            inside = np.minimum(np.maximum(ends[first:last], low), low + n) - low
            owner = np.repeat(np.arange(first, last), np.diff(inside, prepend=0))  # the text of each place
            valid = np.arange(low + length, low + length + n) <= ends[owner]
            change = np.ones(n, dtype=bool)
            change[1:] = (least[1:] != least[:-1]) | (owner[1:] != owner[:-1]) | (valid[1:] != valid[:-1])
            at = np.flatnonzero(change)
            size = np.diff(np.append(at, n))
            at, size = at[valid[at]], size[valid[at]]
            pieces = -(-size // MOST)
            at, size = np.repeat(at, pieces), np.repeat(size, pieces)
            nth = np.arange(len(at)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            at, size = at + nth * MOST, np.minimum(size - nth * MOST, MOST)
            texts.append(owner[at])
            begins.append(at + low)
            counts.append(size)
            anchors.append(least[at].view(np.int64))
        first = last
    none = np.zeros(0, dtype=np.int64)
    return tuple(np.concatenate(x) if x else none for x in (texts, begins, counts, anchors))


def _least_hashes(block: np.ndarray, size: int, length: int) -> np.ndarray:
    """For every string of ``length`` bytes the least hash of its anchors."""
    n = size - ANCHOR + 1
    word = lambda at: np.ndarray((n,), np.dtype("<u8"), buffer=block, offset=at, strides=(1,))
    h = word(0) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    h += word(8)
    h *= np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    width, span = length - ANCHOR + 1, 1
    while 2 * span <= width:
        h, span = np.minimum(h[:-span], h[span:]), 2 * span
    return np.minimum(h[: len(h) - (width - span)], h[width - span :]) if span < width else h


def text_slices(column: pa.Array, limit: int = 4 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, ends) of runs of a binary column's texts with about ``limit`` bytes, at least one text each."""
    flat, ends = flat_texts(column)
    starts, first = np.append(0, ends[:-1]), 0
    while first < len(ends):
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + limit, side="right")))
        yield first, flat[starts[first] : ends[last - 1]], ends[first:last] - starts[first]
        first = last


def flat_texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, ends) of a binary column without nulls."""
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    flat = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, dtype=np.uint8)
    return flat, offsets[1:] - offsets[0]


def binary_column(flat: np.ndarray, begin: np.ndarray, size: np.ndarray) -> pa.Array:
    """A binary column of the slices of ``flat``."""
    ends = np.cumsum(size)
    places = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(begin - (ends - size), size)
    offsets = np.append(0, ends).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(flat[places].tobytes())])


def repeated_anchors(texts: DataFrame, length: int) -> DataFrame:
    """Anchors (written) that stand in more than one text."""

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, flat, ends in text_slices(batch.column(0)):
                text, _, _, anchor = anchor_runs(flat, ends, length)
                order = np.lexsort((text, anchor))
                text, anchor = text[order], anchor[order]
                fresh = np.ones(len(text), dtype=bool)
                fresh[1:] = (text[1:] != text[:-1]) | (anchor[1:] != anchor[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(anchor[fresh])], names=["anchor"])
        pa.default_memory_pool().release_unused()

    seen = texts.select("bytes").mapInArrow(anchors, "anchor long")
    return materialize(seen.groupBy("anchor").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1").select("anchor"))


def filter_size(anchors: int, least: int) -> int:
    """Bits of the filter for so many anchors, a power of two: an eighth of them are set at most, as long as it may grow."""
    return min(max(least, 1 << (BITS_EACH * anchors).bit_length()), FILTER_GROWS * least)


def anchor_filter(anchors: DataFrame, bits: int) -> np.ndarray:
    """A bitmap of ``bits`` bits (a power of two) in which those of the anchors are set."""
    slot = F.col("anchor").bitwiseAND(bits - 1)
    words = anchors.groupBy(F.shiftright(slot, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(anchor & 63 as int))")).alias("mask")).toArrow()
    bitmap = np.zeros(bits // 64, dtype=np.int64)
    bitmap[words["word"].to_numpy()] = words["mask"].to_numpy()
    return bitmap


def repeated_pieces(texts: DataFrame, length: int, bitmap: object, nth: int = 0, rounds: int = 1) -> DataFrame:
    """doc_id, text_hash, begin, count, anchor, piece for the runs whose anchors the filter knows, those of one round."""
    id_type = texts.schema["doc_id"].dataType.simpleString()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = bitmap.value
        for batch in batches:
            for row, flat, ends in text_slices(batch.column(2)):
                text, begin, count, anchor = anchor_runs(flat, ends, length)
                slot = anchor & (64 * len(known) - 1)
                hit = ((known[slot >> 6] >> (slot & 63)) & 1 == 1) & ((anchor >> 40) % rounds == nth)
                text, begin, count, anchor = text[hit], begin[hit], count[hit], anchor[hit]
                start, rows = np.append(0, ends[:-1])[text], pa.array(text + row)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(begin - start), pa.array(count), pa.array(anchor), binary_column(flat, begin, count + length - 1)],
                    names=["doc_id", "text_hash", "begin", "count", "anchor", "piece"],
                )
        pa.default_memory_pool().release_unused()

    return texts.select("doc_id", "text_hash", "bytes").mapInArrow(pieces, f"doc_id {id_type}, text_hash long, begin long, count long, anchor long, piece binary")


def later_copies(owned: DataFrame) -> DataFrame:
    """doc_id, text_hash (written) of the rows whose whole text also stands in a row of a smaller id. Only hashes (128
    bits) and ids travel; texts that stand once are not joined."""
    hashed = owned.select("doc_id", "text_hash", F.xxhash64(F.lit(1), "bytes").alias("other_hash"), F.octet_length("bytes").alias("size"))
    same = ["text_hash", "other_hash", "size"]
    firsts = materialize(hashed.groupBy(*same).agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last").drop("last"))
    return materialize(hashed.join(firsts, same).filter("doc_id > first").select("doc_id", "text_hash").distinct())


def first_owners(pieces: DataFrame, length: int) -> DataFrame:
    """anchor, piece_hash, first, last, again of each distinct piece: its least and largest owner, and as bits the
    strings of it that begin in a piece of a still smaller owner. Pieces of one owner without such strings are left out.

    Buckets of anchors are indexed one by one. A bucket that holds too much, as an anchor with ever new surroundings
    makes it, is settled by one shuffled minimum over its strings instead.
    """
    pieces = pieces.withColumn("piece_hash", F.xxhash64("piece"))
    weighed = pieces.groupBy().agg(F.sum(F.octet_length("piece") + 1)).first()[0] or 0
    buckets = max(1, -(-weighed // BUCKET_BYTES))
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("anchor"), F.lit(buckets)))
    full = dealt.groupBy("bucket").agg(F.sum(F.octet_length("piece") + 1).alias("held")).filter(F.col("held") > BUCKET_MOST).select("bucket")
    full = materialize(full)

    def index(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        anchor, owner, last = (rows[c].to_numpy() for c in ("anchor", "first", "last"))
        # a piece that is alone with its anchor holds the strings' only surroundings: there is nothing to look up
        _, inverse, times = np.unique(anchor, return_inverse=True, return_counts=True)
        met = np.flatnonzero(times[inverse] > 1)
        again = np.zeros(len(anchor), dtype=np.int64)
        if len(met):
            flat, ends = flat_texts(rows["piece"].take(pa.array(met)).combine_chunks())
            built = RunIndex(flat, ends, owner[met], length)
            sizes = np.diff(ends, prepend=0)
            _, _, first = built.stream(built.text, built.starts, sizes, built.ends_at)
            counts = sizes - length + 1
            string = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
            earlier = first[np.repeat(built.starts, counts) + string] < np.repeat(owner[met], counts)
            np.bitwise_or.at(again, np.repeat(met, counts)[earlier], np.int64(1) << string[earlier])
        done = {"anchor": anchor, "piece_hash": rows["piece_hash"], "first": owner, "last": last, "again": again}
        return pa.table(done).filter(pa.array((again != 0) | (owner != last)))

    made = "anchor long, piece_hash long, first long, last long, again long"
    indexed = dealt.join(full, "bucket", "left_anti").select("bucket", "anchor", "piece_hash", "first", "last", "piece").groupBy("bucket").applyInArrow(index, made)

    strings = dealt.join(full, "bucket").select("anchor", "piece_hash", "first", "last", F.posexplode(F.transform(F.sequence(F.lit(1), F.octet_length("piece") - length + 1), lambda i: F.substring("piece", i, F.lit(length)))).alias("nth", "string"))
    least = strings.groupBy("string").agg(F.min("first").alias("least"))
    earlier = F.when(F.col("least") < F.col("first"), F.expr("shiftleft(1L, nth)")).otherwise(F.lit(0).cast("long"))
    settled = strings.join(least, "string").groupBy("anchor", "piece_hash").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.bit_or(earlier).alias("again"))
    return indexed.unionByName(settled.filter("again <> 0 OR first <> last"))


def cut_texts(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """n_bytes, n_removed, n_spans, kept for texts with the places (begin, bits) of their repeated strings; copies, which
    are repeated as a whole, have none."""
    for batch in batches:
        flat, ends = flat_texts(batch.column(1))
        starts = ends - np.diff(ends, prepend=0)
        marks = batch.column(2)
        per = np.diff(marks.offsets.to_numpy())
        begin, bits = (marks.flatten().field(c).to_numpy() for c in ("begin", "bits"))
        begin = begin + np.repeat(starts, per)
        edge = np.zeros(len(flat) + 1, dtype=np.int64)
        for nth in range(MOST if len(bits) else 0):
            here = begin[(bits >> nth) & 1 == 1] + nth
            np.add.at(edge, here, 1)
            np.subtract.at(edge, here + length, 1)
        copied = batch.column(3).to_numpy(zero_copy_only=False).astype(bool)
        np.add.at(edge, starts[copied], 1)
        np.subtract.at(edge, ends[copied], 1)
        gone = np.cumsum(edge[:-1]) > 0
        opens = gone.copy()
        opens[1:] &= ~gone[:-1]
        opens[starts[starts < len(flat)]] = gone[starts[starts < len(flat)]]
        removed, spans = np.append(0, np.cumsum(gone)), np.append(0, np.cumsum(opens))
        left = flat[~gone]
        kept_at = np.append(0, ends) - removed[np.append(0, ends)]
        kept = [left[a:b].tobytes() for a, b in zip(kept_at[:-1], kept_at[1:], strict=True)]
        count = lambda sums: pa.array(sums[ends] - sums[starts], pa.int64())  # noqa: E731, B023
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(ends - starts, pa.int64()), count(removed), count(spans), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()), pa.array(kept, pa.binary())],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
        )


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50, filter_bits: int = FILTER_BITS, with_kept: bool = True) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and ``kept``, the remaining bytes.

    Removed is each byte of the UTF-8 text that a string of ``length`` (over ANCHOR) bytes covers which also begins in
    a document with a smaller id; strings are judged on the input and never cross documents. A null text is empty. A row
    with a null id is compared with nothing and kept whole; rows with one id don't count as smaller than each other.
    An empty table gives no rows; other columns are ignored. Ids are whole numbers.

    Method: a text that stands whole under a smaller id is removed as it is and owns no string, so only its least id is
    looked at further. Every string is named by its anchor (its part with the least hash). Anchors of one text only are filtered
    out; the others' strings travel as pieces, equal ones merged map-side into one with its least owner. All places of
    a string meet in the bucket of its anchor, where a run-compressed Burrows-Wheeler index of the pieces is built and
    the pieces' matching statistics are streamed against it: a match of ``length`` bytes leads to the string's least
    owner. Marks go back to the places of every piece, and the texts are cut.
    """
    if length <= ANCHOR:
        raise ValueError(f"length must be over {ANCHOR}")
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("bytes")).withColumn("text_hash", F.xxhash64("bytes"))
    owned = texts.filter(F.col("doc_id").isNotNull() & (F.octet_length("bytes") >= length))

    copies = later_copies(owned)
    owned = owned.join(copies, ["doc_id", "text_hash"], "left_anti")
    anchors = repeated_anchors(owned, length)
    release(spark)
    bitmap = spark.sparkContext.broadcast(anchor_filter(anchors, filter_size(anchors.count(), filter_bits)))
    discard(anchors)
    owner = F.col("doc_id").cast("long")
    bits = F.when(F.col("doc_id") > F.col("first"), F.expr("shiftleft(1L, cast(count as int)) - 1")).otherwise(F.col("again"))
    found = []
    for nth in range(ROUNDS):
        places = repeated_pieces(owned, length, bitmap, nth, ROUNDS)
        pieces = materialize(places.groupBy("anchor", "piece").agg(F.min(owner).alias("first"), F.max(owner).alias("last")), compression="zstd")
        release(spark)
        owners = materialize(first_owners(pieces, length), compression="zstd")
        discard(pieces)
        release(spark)
        met = places.withColumn("piece_hash", F.xxhash64("piece")).drop("piece").join(owners, ["anchor", "piece_hash"])
        found.append(materialize(met.withColumn("bits", bits).filter("bits <> 0").select("doc_id", "text_hash", "begin", "bits"), compression="zstd"))
        discard(owners)
        release(spark)

    marks = reduce(DataFrame.unionByName, found).groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("begin", "bits")).alias("marks"))
    none = F.array().cast("array<struct<begin:bigint,bits:bigint>>")
    told = marks.withColumn("copy", F.lit(False)).unionByName(copies.withColumns({"marks": none, "copy": F.lit(True)}))
    marked = texts.join(told, ["doc_id", "text_hash"], "left").select("doc_id", "bytes", F.coalesce("marks", none).alias("marks"), F.coalesce("copy", F.lit(False)).alias("copy"))
    id_type = texts.schema["doc_id"].dataType.simpleString()
    done = marked.mapInArrow(lambda b: cut_texts(b, length), f"doc_id {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return done if with_kept else done.drop("kept")
