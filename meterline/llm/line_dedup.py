"""Line de-duplication by winnowed line hashes (DataFrame functions only)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize

#: Units: lines end at newlines, or also at the ends of sentences inside long lines.
NEWLINES, SENTENCES = ("\n",), ("\n", ". ", "! ", "? ")
MARK = "\x01"
EDGES = " \t\r\n"
#: Lines of a window at most, words and lines of a gram, and lines that a fingerprint carries of either side.
WINDOW, GRAM_WORDS, GRAM_LINES, SIDE = 5, 12, 3, 4
#: Share of all fingerprints above which the places of one value are dealt out, and the buckets they are dealt to.
SUPPORT, SALTS = 0.002, 512


def lines_of(text: Column, unit: tuple[str, ...]) -> Column:
    """The lines of a text, each with the characters that end it, so that joining them gives the text again.

    Marks are put behind the line ends by plain replacement and split at, which costs far less than a regular
    expression; a text that holds the mark itself goes through the expression.
    """
    text = F.coalesce(text, F.lit(""))
    marked = text
    for end in unit:
        marked = F.replace(marked, F.lit(end), F.lit(end + MARK))
    ends = "|".join(f"(?<={re.escape(e)})" for e in unit)
    return F.when(F.contains(text, F.lit(MARK)), F.split(text, ends, -1)).otherwise(F.split(marked, MARK, -1))


def trimmed(lines: Column) -> Column:
    return F.transform(lines, lambda x: F.trim(x, F.lit(EDGES)))


def words_in(x: Column) -> Column:
    """Words of a trimmed line, about: one more than its inner spaces."""
    return F.when(x == "", 0).otherwise(F.octet_length(x) - F.octet_length(F.replace(x, F.lit(" "), F.lit(""))) + 1)


def hashed_lines(docs: DataFrame, unit: tuple[str, ...], min_words: int) -> DataFrame:
    """doc_id, text_hash, and for every line its hash (h), the lines of its gram (n) and of its window (size; null where
    the text ends before), written once for the passes that read them."""
    split = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), trimmed(lines_of(F.col("text"), unit)).alias("line"))
    hashed = split.select("doc_id", "text_hash", F.transform("line", lambda x: F.xxhash64(x)).alias("h"), F.transform("line", words_in).alias("w"))
    at = lambda c, i: F.get(F.col(c), i)
    two = hashed.withColumn("w2", F.transform("w", lambda x, i: x + at("w", i + 1)))
    few = min(GRAM_WORDS, min_words)
    gram = lambda x, i: F.when(x >= few, 1).when(at("w2", i) >= few, 2).when(at("w", i + 2).isNotNull(), 3)
    window = lambda x, i: (
        F.when(x >= min_words, 1).when(at("w2", i) >= min_words, 2).when(at("w2", i) + at("w", i + 2) >= min_words, 3)
        .when(at("w2", i) + at("w2", i + 2) >= min_words, 4).when(at("w", i + 4).isNotNull(), 5)
    )
    return materialize(two.select("doc_id", "text_hash", "h", F.transform("w", gram).alias("n"), F.transform("w", window).alias("size")))


def fingerprints(lines: DataFrame) -> DataFrame:
    """doc_id, text_hash, print, pos, shape, and back and ahead (two columns each): the winnowed grams of every document.

    A gram is the shortest run of lines from ``pos`` on with GRAM_WORDS words or GRAM_LINES lines. A window is the shortest run
    with ``min_words`` words or WINDOW lines; of the grams inside a window the least hash is selected, of equal ones the
    first. Windows and grams are cut by their own words alone, so every run of lines of ``min_words`` words has a gram
    selected wherever it stands. ``back`` and ``ahead`` hold 32 bits of the hashes of the SIDE lines before and after
    the gram: from a selected gram it is never further to the next one, or to the end of a shared run. ``shape`` packs
    the gram's lines and those of the windows that begin at most SIDE lines before it (see gram_lines, window_lines).
    """
    h, i, reach = F.col("h"), F.col("i"), WINDOW + 1  # this window and the next: a gram is given out by the last window that selects it
    # what lies beyond the text differs between documents, and from all lines
    named = lines.filter(F.size(h) > 0).withColumn("beyond", F.xxhash64("doc_id", "text_hash", F.lit("beyond")))
    starts = named.select("doc_id", "text_hash", "beyond", "h", "n", "size", F.explode(F.sequence(F.lit(0), F.size(h) - 1)).alias("i"))
    one = starts.select(
        "doc_id", "text_hash", "beyond", "h", "size", "i", *[F.get(h, i + k).alias(f"h{k}") for k in range(reach + GRAM_LINES - 1)],
        *[F.get(F.col("n"), i + k).alias(f"n{k}") for k in range(reach)], *[F.get(F.col("size"), i + k).alias(f"size{k}") for k in range(2)],
    )

    def gram(k: int) -> Column:
        made = F
        for m in range(1, GRAM_LINES + 1):
            made = made.when(F.col(f"n{k}") == m, F.xxhash64(*[f"h{k + j}" for j in range(m)]))
        return made

    both = [(first, k) for first in (0, 1) for k in range(first, first + WINDOW)]
    three = one.select("doc_id", "text_hash", "beyond", "h", "size", "i", "size0", "size1", *[f"n{k}" for k in range(reach)], *[gram(k).alias(f"g{k}") for k in range(reach)])
    inside = lambda first, k: F.when(F.col(f"n{k}") + (k - first) <= F.col(f"size{first}"), F.col(f"g{k}"))
    four = three.select("doc_id", "text_hash", "beyond", "h", "size", "i", *[f"n{k}" for k in range(WINDOW)], *[inside(*x).alias("v{}{}".format(*x)) for x in both])
    least = lambda first: F.least(*[F.col(f"v{f}{k}") for f, k in both if f == first])
    five = four.select("*", least(0).alias("m0"), least(1).alias("m1"))

    def place(first: int) -> Column:
        out = F
        for k in range(first, first + WINDOW):
            out = out.when(F.col(f"v{first}{k}") == F.col(f"m{first}"), k)
        return out

    six = five.select("doc_id", "text_hash", "beyond", "h", "size", "i", "m0", *[f"n{k}" for k in range(WINDOW)], place(0).alias("p0"), place(1).alias("p1"))
    # given out by an explode, and the value with it: filters would be pushed below these steps and evaluate all of them again
    again = F.coalesce(F.col("p0") == F.col("p1"), F.lit(False))
    chosen = F.when(F.col("p0").isNotNull() & ~again, F.array(F.struct(F.col("m0").alias("print"), F.col("p0").alias("p"))))
    seven = six.select("doc_id", "text_hash", "beyond", "h", "size", "i", *[f"n{k}" for k in range(WINDOW)], F.explode(chosen).alias("c"))
    n_lines = F.get(F.array(*[F.col(f"n{k}") for k in range(WINDOW)]), F.col("c.p"))
    at = seven.select("doc_id", "text_hash", "beyond", "h", "size", "c.print", (F.col("i") + F.col("c.p")).alias("pos"), n_lines.alias("len"))

    def pair(near: Column, far: Column) -> Column:
        low = lambda x: F.coalesce(F.when(x >= 0, F.get(F.col("h"), x)), F.col("beyond")).bitwiseAND(0xFFFFFFFF)
        return F.shiftleft(low(far), 32).bitwiseOR(low(near))

    p, end, shape = F.col("pos"), F.col("pos") + F.col("len"), F.col("len")
    for k in range(SIDE + 1):
        shape = shape.bitwiseOR(F.shiftleft(F.coalesce(F.when(p >= k, F.get("size", p - k)), F.lit(0)), 2 + 3 * k))
    return at.select(
        "doc_id", "text_hash", "print", "pos", shape.alias("shape"), pair(p - 1, p - 2).alias("back1"), pair(p - 3, p - 4).alias("back2"),
        pair(end, end + 1).alias("ahead1"), pair(end + 2, end + 3).alias("ahead2"),
    )


AROUND = ["back1", "back2", "ahead1", "ahead2"]
CONTEXT = ["doc_id", "text_hash", "pos", *AROUND]


def gram_lines() -> Column:
    return F.col("shape").bitwiseAND(3)


def window_lines(k: int) -> Column:
    """Lines of the window that begins ``k`` lines before the gram, 0 if there is none."""
    return F.shiftright("shape", 2 + 3 * k).bitwiseAND(7)


def agreeing(one: str, other: str) -> Column:
    """How many of SIDE lines agree, the nearest first."""
    near, far = (F.col(f"{one}{k}").bitwiseXOR(F.col(f"{other}{k}")) for k in (1, 2))
    half = lambda x: x.bitwiseAND(0xFFFFFFFF) != 0
    return F.when(half(near), 0).when(near != 0, 1).when(half(far), 2).when(far != 0, 3).otherwise(4)


def matches(prints: DataFrame) -> DataFrame:
    """Fingerprints, each with an earlier place of its value (from_<column>): the first one, and the one before it if
    that is in the same document; and whether the latter stands in equal surroundings (alike).

    Places meet in a window by value. The values that may hold more than SUPPORT of all fingerprints (Misra-Gries names
    them, 1/SUPPORT at most) are dealt to SALTS buckets by document, and their first places, a row a value, are
    broadcast. So every place but the first is joined to it, and no task has more than its share of a value that stands
    everywhere.
    """
    found = prints.freqItems(["print"], SUPPORT).first()["print_freqItems"]
    hot = F.col("print").isin(*found) if found else F.lit(False)
    salted = prints.withColumn("salt", F.when(hot, F.pmod(F.hash("doc_id", "text_hash"), F.lit(SALTS))).otherwise(0))
    order = ["doc_id", "text_hash", "pos"]
    whole = F.struct(*CONTEXT)
    bucket = Window.partitionBy("print", "salt").orderBy(*order)
    placed = salted.withColumns({"first": F.first(whole).over(bucket), "last": F.lag(whole).over(bucket)})
    if found:
        tops = prints.filter(hot).groupBy("print").agg(F.min_by(whole, F.struct(*order)).alias("top"))
        placed = placed.join(F.broadcast(tops), "print", "left").withColumn("first", F.coalesce("top", "first"))
    same = lambda c: (F.col(f"{c}.doc_id") == F.col("doc_id")) & (F.col(f"{c}.text_hash") == F.col("text_hash"))
    later = F.coalesce(same("last") & (F.col("last.pos") < F.col("pos")), F.lit(False))
    offers = F.array(F.when(~same("first"), F.col("first")), F.when(later, F.col("last")))
    alike = F.coalesce(later & F.forall(F.array(*[F.col(f"last.{c}") == F.col(c) for c in AROUND]), lambda x: x), F.lit(False))
    met = placed.filter(~same("first") | later).select("*", F.explode(offers).alias("from"), alike.alias("alike")).filter("from IS NOT NULL")
    return met.select("print", *CONTEXT, "shape", "alike", *[F.col(f"from.{c}").alias(f"from_{c}") for c in CONTEXT])


def open_windows(back: Column, ahead: Column) -> Column:
    """The values of a place's windows around its gram that do not lie within ``back`` lines before and ``ahead`` after
    the gram: gram and lines beside it, as far as the window goes."""

    def beside(side: str, lines: Column) -> list[Column]:
        low = lambda c: F.col(c).bitwiseAND(0xFFFFFFFF)
        return [F.when(lines >= n + 1, F.col(f"{side}{k}")).when(lines == n, low(f"{side}{k}")).otherwise(0) for k, n in ((1, 1), (2, 3))]

    def window(k: int) -> Column:
        after = window_lines(k) - k - gram_lines()
        value = F.xxhash64("print", F.lit(k), after, *beside("back", F.lit(k)), *beside("ahead", after))
        return F.when((window_lines(k) > 0) & (after >= 0) & ((F.lit(k) > back) | (after > ahead)), value)

    return F.array_compact(F.array(*[window(k) for k in range(SIDE + 1)]))


def unsettled(met: DataFrame) -> DataFrame:
    """The fingerprints by which places meet once more whose gram's match leaves windows open.

    Places of one gram in equal surroundings (SIDE lines either side) have all their windows in common. So they meet
    by the surroundings, and only the first of them is looked up by its windows, a row each: their number follows that
    of different surroundings, not that of places. A place that stands as the one before it in its document does has
    met an equal one already.
    """
    around = F.xxhash64("print", "shape", *AROUND)
    windows = open_windows(agreeing("back", "from_back"), agreeing("ahead", "from_ahead"))
    left = met.filter(~F.col("alike")).select(*CONTEXT, "shape", around.alias("print"), windows.alias("windows"), (F.col("doc_id") == F.col("from_doc_id")).alias("own"))
    left = materialize(left.filter(F.size("windows") > 0), compression="zstd")
    # of a place's two matches the one in another document counts: it is the gram's first place
    row, order = F.struct(*CONTEXT, "shape", "windows"), F.struct("doc_id", "text_hash", "pos", "own")
    firsts = left.groupBy("print").agg(F.min_by(row, order).alias("first")).select("first.*")
    return left.select(*CONTEXT, "shape", "print").unionByName(firsts.select(*CONTEXT, "shape", F.explode("windows").alias("print")))


def all_matches(prints: DataFrame) -> DataFrame:
    """The matches of grams, and those of windows that the grams' matches leave open.

    A gram's first place may stand in other surroundings than a later pair of equal places, as a sentence does that is
    used alone and in passages. Every run of ``min_words`` words holds a whole window, which selects a gram in all
    places of the run; so what the first place does not share is looked up once more by the whole window. A place
    whose window its first place shares needs no look: whoever has that window shares it with the first place too. Nor
    does one that meets an earlier place in equal surroundings, which shares all its windows (see unsettled).
    """
    met = materialize(matches(prints), compression="zstd")
    again = unsettled(met).dropDuplicates(["print", *CONTEXT])
    return met.unionByName(matches(materialize(again, compression="zstd")))


def repeated_runs(lines: DataFrame) -> DataFrame:
    """doc_id, text_hash, runs: for each document the sorted array of (run_from, run_to), runs of lines that stand
    earlier, each as a whole in one place.

    A match is extended both ways while the lines agree; matches along the same place (document and distance) that
    touch are one run. Runs along different places are never joined.
    """
    met = all_matches(fingerprints(lines))
    back = F.least(agreeing("back", "from_back"), F.col("pos"), F.col("from_pos"))
    spans = met.select(
        "doc_id", "text_hash", "from_doc_id", "from_text_hash", (F.col("pos") - F.col("from_pos")).alias("apart"),
        (F.col("pos") - back).alias("run_from"), (F.col("pos") + gram_lines() - 1 + agreeing("ahead", "from_ahead")).alias("run_to"),
    ).repartition("doc_id", "text_hash")
    along = ["doc_id", "text_hash", "from_doc_id", "from_text_hash", "apart"]
    order = Window.partitionBy(*along).orderBy("run_from", "run_to")
    reach = F.max("run_to").over(order.rowsBetween(Window.unboundedPreceding, -1))
    numbered = spans.withColumn("starts", F.coalesce(F.col("run_from") > reach + 1, F.lit(True)).cast("int"))
    numbered = numbered.withColumn("run", F.sum("starts").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = numbered.groupBy(*along, "run").agg(F.min("run_from").alias("run_from"), F.max("run_to").alias("run_to"))
    return runs.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set(F.struct("run_from", "run_to"))).alias("runs"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: tuple[str, ...] = SENTENCES, min_words: int = 40) -> DataFrame:
    """The rows of ``docs`` with ``text_col`` cleaned, and the column _deleted (number of lines).

    Deleted are the later places of repeated runs of lines: runs of at least ``min_words`` words that stand, as a whole
    and in the same order, in an earlier document (by id) or earlier in the same one. A line ends at a newline or a
    sentence's end; lines are compared without the white space around them. Every such run holds a whole
    window of at least ``min_words`` words or WINDOW lines, by which all its places meet (see all_matches). Nothing else
    is deleted, but for chance: a line at a run's end counts as equal by 32 bits of its hash. More than SIDE lines
    without a word end a run.

    Rows with a null id or a null or empty text pass unchanged and delete nothing. Rows that repeat an id and its text
    are one document: neither is deleted for the other. An empty table gives no rows. Extra columns pass unchanged.
    """
    own = docs.filter(F.col(id_col).isNotNull() & (F.length(text_col) > 0)).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    runs = repeated_runs(hashed_lines(own, unit, min_words)).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), F.col("runs").alias("_runs"))
    held = docs.join(runs, (F.col(id_col) == F.col("_id")) & (F.xxhash64(text_col) == F.col("_hash")), "left")
    split = held.withColumn("_line", F.when(F.col("_runs").isNotNull(), lines_of(F.col(text_col), unit)))
    line = F.col("_line")
    words = lambda x: F.aggregate(F.slice(line, x["run_from"] + 1, x["run_to"] - x["run_from"] + 1), F.lit(0), lambda a, y: a + words_in(F.trim(y, F.lit(EDGES))))
    judged = split.withColumn("_gone", F.filter("_runs", lambda x: words(x) >= min_words))
    touched = F.coalesce(F.size("_gone") > 0, F.lit(False))
    # What stays begins where all runs before it have ended: of the sorted runs, the furthest end so far.
    state = "struct<at:int,cut:int,kept:array<string>>"
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("cut"), F.array().cast("array<string>").alias("kept")).cast(state)

    def step(acc: Column, x: Column) -> Column:
        gap = F.greatest(x["run_from"] - acc["at"], F.lit(0))
        return F.struct(
            F.greatest(acc["at"], x["run_to"] + 1).alias("at"), (acc["cut"] + F.greatest(x["run_to"] + 1 - F.greatest(acc["at"], x["run_from"]), F.lit(0))).alias("cut"),
            F.when(gap > 0, F.concat(acc["kept"], F.array(F.array_join(F.slice(line, acc["at"] + 1, gap), "")))).otherwise(acc["kept"]).alias("kept"),
        ).cast(state)

    done = judged.withColumn("_left", F.when(touched, F.aggregate("_gone", start, step)))
    rest = F.concat(F.array_join(F.col("_left.kept"), ""), F.array_join(F.slice(line, F.col("_left.at") + 1, F.size(line)), ""))
    return done.select(
        *[F.when(touched, rest).otherwise(F.col(text_col)).alias(c) if c == text_col else F.col(c) for c in docs.columns],
        F.when(touched, F.col("_left.cut")).otherwise(0).cast("long").alias("_deleted"),
    )


def line_dedup_digest(docs: DataFrame, **how) -> DataFrame:
    """Per document: doc_id, n_deleted (lines), n_chars (of what is left), text_sha256 (of what is left; null: empty)."""
    done = dedup_lines(docs, **how)
    text = F.coalesce("text", F.lit(""))
    return done.select(
        "doc_id", F.col("_deleted").alias("n_deleted"),
        F.length(text).cast("long").alias("n_chars"), F.sha2(text, 256).alias("text_sha256"),
    )
