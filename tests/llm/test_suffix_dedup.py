import hashlib
import random

import numpy as np
import pytest

from meterline.llm import suffix_dedup as sd
from meterline.llm.run_index import NOBODY, RunIndex

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def brute(rows, length=50):
    """By the definition: the least owner of every string, then the covered bytes."""
    texts = [(i, (t or "").encode()) for i, t in rows]
    least = {}
    for i, t in texts:
        if i is not None:
            for p in range(len(t) - length + 1):
                s = t[p : p + length]
                least[s] = min(i, least.get(s, i))
    out = []
    for i, t in texts:
        gone = bytearray(len(t))
        if i is not None:
            for p in range(len(t) - length + 1):
                if least[t[p : p + length]] < i:
                    gone[p : p + length] = b"\x01" * length
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((i, len(t), sum(gone), sum(g and not (p and gone[p - 1]) for p, g in enumerate(gone)), hashlib.sha256(kept).hexdigest(), kept))
    return sorted(out, key=str)


def got(df):
    return sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"], bytes(r["kept"])) for r in df.collect()), key=str)


def check(spark, rows, **options):
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS).repartition(4)
    assert got(sd.suffix_dedup(docs, **options)) == brute(rows, options.get("length", 50))


def passages(seed, docs=60):
    """Texts of few words, so that strings repeat in ever new surroundings; copies, loops and non-ASCII among them."""
    rng = random.Random(seed)
    words = [rng.choice(["alpha", "béta", "gamma", "delta", "日本語", "x", "of the", "\n"]) for _ in range(40)]
    shared = [" ".join(rng.choice(words) for _ in range(rng.randrange(10, 40))) for _ in range(8)]
    texts = [" ".join(rng.choice([*shared, *words]) for _ in range(rng.randrange(1, 25))) for _ in range(docs)]
    texts += ["ab" * 200, "x" + "ab" * 150, "-" * 300, "-" * 49, "-" * 50, "-" * 51, *texts[:6], *[t[7:] for t in texts[:6]]]
    order = list(range(len(texts)))
    rng.shuffle(order)
    return [(order[k], t) for k, t in enumerate(texts)]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    check(spark, passages(seed))


def test_awkward_rows(awkward, clashing, no_rows):
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    assert got(sd.suffix_dedup(awkward)) == brute(rows)
    assert got(sd.suffix_dedup(clashing, length=20)) == brute(rows, 20)
    empty = sd.suffix_dedup(no_rows, with_kept=False)
    assert empty.collect() == [] and empty.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


def test_repeated_ids(spark):
    text = "a passage of more than fifty bytes that stands in some documents of one id"
    check(spark, [(5, text), (5, text), (5, "x" + text), (6, text + "y"), (None, text), (2**62, text)])


def test_whole_copies_are_not_looked_up(spark):
    """Texts that stand whole under a smaller id go as they are; their anchors repeat nothing. The filter grows with the
    anchors, so that it does not let more through on larger inputs."""
    rng = random.Random(8)
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(200)) for _ in range(5)]
    rows = [(10 * k + i, t) for k in range(6) for i, t in enumerate(texts)] + [(3, "short"), (4, "short"), (4, texts[4]), (None, texts[0])]
    check(spark, rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "cast(text AS binary) AS bytes", "xxhash64(cast(text AS binary)) AS text_hash").filter("doc_id IS NOT NULL AND octet_length(bytes) >= 50")
    copies = sd.later_copies(docs)
    assert sorted(r.doc_id for r in copies.collect()) == [10 * k + i for k in range(1, 6) for i in range(5)]
    assert sd.repeated_anchors(docs.join(copies, ["doc_id", "text_hash"], "left_anti").dropDuplicates(["text_hash"]), 50).count() == 0
    assert [sd.filter_size(n, 1 << 27) for n in (0, 10**6, 2 * 10**7, 10**12)] == [1 << 27, 1 << 27, 1 << 28, 1 << 29]


def test_full_filter_and_full_buckets(spark, monkeypatch):
    """A filter that lets all through, and buckets that are settled string by string, give the same."""
    monkeypatch.setattr(sd, "BUCKET_MOST", 3000)
    monkeypatch.setattr(sd, "BUCKET_BYTES", 2000)
    check(spark, passages(3, 30), filter_bits=64)


def test_long_text(spark):
    rng = random.Random(4)
    long = "".join(rng.choice("abcdefgh ") for _ in range(1_500_000))
    docs = spark.createDataFrame([(1, long[700_000:701_000], None, None, None), (2, long, None, None, None)], DOCS)
    rows = {r["doc_id"]: r for r in sd.suffix_dedup(docs).collect()}
    assert rows[1]["n_removed"] == 0
    assert (rows[2]["n_removed"], rows[2]["n_spans"], bytes(rows[2]["kept"]).decode()) == (1000, 1, long[:700_000] + long[701_000:])


def longest(texts, rest):
    best = 0
    for t in texts:
        while best < len(rest) and rest[: best + 1] in t:
            best += 1
    return best


@pytest.mark.parametrize("seed", range(6))
def test_matching_statistics(seed):
    """Patterns that are not in the index too: every length, place and least owner by brute force."""
    rng = random.Random(seed)
    letters = b"ab" if seed % 2 else b"abcdefgh"
    texts = [bytes(rng.choice(letters) for _ in range(rng.randrange(1, 70))) for _ in range(30)]
    texts += [texts[0], texts[1][3:] + texts[2]] if len(texts[1]) > 3 else []
    owners = np.array([rng.randrange(100) for _ in texts])
    index = RunIndex(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts]), owners, 9)
    patterns = [*texts[:5], b"zz" + texts[3] + b"z", bytes(rng.choice(letters) for _ in range(50))]
    flat = np.frombuffer(b"".join(patterns), np.uint8)
    ends = np.cumsum([len(p) for p in patterns])
    matched, place, first = index.stream(flat, ends - [len(p) for p in patterns], np.array([len(p) for p in patterns]))
    for p, end in zip(patterns, ends):
        for i in range(len(p)):
            at = end - len(p) + i
            want = longest(texts, p[i:])
            assert matched[at] == want
            assert bytes(index.text[place[at] : place[at] + want]) == p[i : i + want]
            holders = [o for t, o in zip(texts, owners) if want >= 9 and p[i : i + 9] in t]
            assert first[at] == (min(holders) if holders else NOBODY)


def test_runs_are_fewer_than_bytes_in_copies():
    rng = random.Random(1)
    text = bytes(rng.choice(b"abcdefgh") for _ in range(90))
    index = RunIndex(np.frombuffer(text * 200, np.uint8), np.arange(1, 201) * 90, np.arange(200), 50)
    assert len(index.rows) < len(text) * 200 / 50
