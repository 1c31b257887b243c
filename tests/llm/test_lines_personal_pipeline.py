import hashlib
import random
import re
from collections import defaultdict

import pytest
import xxhash

import corpus_pipeline
from meterline.llm import line_dedup
from meterline.llm.line_dedup import NEWLINES, SENTENCES, dedup_lines, hashed_lines, line_dedup_digest, repeated_runs
from meterline.llm.personal_data import ADDED, BASE, FEATURES, PATTERNS, as_expression, find_personal_data, personal_data_digest, redacted, trained

KIND = "doc_id long, text string, lang string, source string, n_chars long"


def key(r):
    return tuple((x is None, x) for x in r)


def rows(df):
    return sorted(map(tuple, df.collect()), key=key)


def signed(v):
    return v - (1 << 64) if v >> 63 else v


def brute_lines(docs, unit, min_words):
    """The promise, place by place: {(id, hash): (lines, words, lines that may go)}. Every pair of equal lines is followed
    to the ends of its run; the later place of a run of ``min_words`` words may go."""
    named = sorted({(i, signed(xxhash.xxh64_intdigest(t.encode(), 42)), t) for i, t in docs if i is not None and t})
    split, places, out = {}, defaultdict(list), {}
    for i, code, text in named:
        lines = re.split("|".join(f"(?<={re.escape(e)})" for e in unit), text)
        trim = split[i, code] = [x.strip(" \t\r\n") for x in lines]
        words = [0 if not x else x.count(" ") + 1 for x in trim]
        gone = set()
        for k, x in enumerate(trim):
            for other, at in places[x]:
                b = split[other]
                if k and at and trim[k - 1] == b[at - 1]:
                    continue  # a run that began before
                n = 1
                while k + n < len(trim) and at + n < len(b) and trim[k + n] == b[at + n]:
                    n += 1
                if sum(words[k : k + n]) >= min_words:
                    gone |= set(range(k, k + n))
            places[x].append(((i, code), k))
        out[i, code] = (lines, words, gone)
    return out


def deleted_lines(docs, unit, min_words, brute):
    """{(id, hash): lines that the operator's runs of ``min_words`` words cover}."""
    own = docs.filter("doc_id IS NOT NULL AND length(text) > 0").select("doc_id", "text")
    out = {}
    for r in repeated_runs(hashed_lines(own, unit, min_words)).collect():
        words = brute[r.doc_id, r.text_hash][1]
        out[r.doc_id, r.text_hash] = {k for a, b in r.runs if sum(words[a : b + 1]) >= min_words for k in range(a, b + 1)}
    return out


def repeating_docs():
    rng = random.Random(8)
    pool = [" ".join(rng.choice("abcdefgh") * rng.randrange(1, 4) for _ in range(rng.randrange(1, 14))) + rng.choice([".", "", "!"]) for _ in range(60)]
    passage = [" ".join(f"p{k}{j}" for j in range(9)) + "." for k in range(7)]
    out = []
    for i in range(80):
        lines = [rng.choice(pool) for _ in range(rng.randrange(0, 14))]
        if i % 4 == 0:
            at = rng.randrange(len(lines) + 1)
            lines[at:at] = passage
        if i % 9 == 0:
            lines.append(" ".join(f"q{j}" for j in range(55)))
        text = "".join(x + rng.choice(["\n", "\n", " ", "\n\n", "\x01"] if i == 7 else ["\n", "\n", " ", "\n\n"]) for x in lines)
        out.append((i, text, "en", "s", len(text)))
    out += [(100 + k, out[k][1], "en", "s", 0) for k in range(5)]
    return [*out, out[3], (None, out[0][1], None, None, 0), (200, None, None, None, None), (201, "", None, None, 0)]


def measured(docs, unit, min_words):
    """Words that may go, words that went, and words that went though they may not, by brute force; and the texts agree."""
    rows_in = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute_lines(rows_in, unit, min_words)
    gone = deleted_lines(docs, unit, min_words, want)
    texts = {(i, signed(xxhash.xxh64_intdigest(t.encode(), 42))): t for i, t in rows_in if i is not None and t}
    left = {d: ("".join(x for k, x in enumerate(want[d][0]) if k not in gone.get(d, ())), len(gone.get(d, ()))) for d in texts}
    by_id = defaultdict(set)
    for (i, _), v in left.items():
        by_id[i].add(v)
    for r in dedup_lines(docs, unit=unit, min_words=min_words).collect():
        assert (r.text, r._deleted) in by_id[r.doc_id] if r.doc_id is not None and r.text and r.doc_id in by_id else r._deleted in (0, *(n for _, n in by_id[r.doc_id]))
    size = lambda d, ks: sum(want[d][1][k] for k in ks)
    may, excess = sum(size(d, w[2]) for d, w in want.items()), sum(size(d, g - want[d][2]) for d, g in gone.items())
    return may, sum(size(d, g & want[d][2]) for d, g in gone.items()), excess


@pytest.mark.parametrize(("unit", "min_words", "least"), [(SENTENCES, 40, 0.99), (NEWLINES, 12, 0.99)])
def test_line_dedup_against_true_repeated_runs(spark, unit, min_words, least):
    """Lines from a pool of sixty: many fingerprints first stand in other, shorter runs."""
    docs = spark.createDataFrame(repeating_docs(), KIND).repartition(3)
    may, went, excess = measured(docs, unit, min_words)
    assert may > 1000 and excess == 0 and went >= least * may


def template_docs(sentences, docs=300, passages=20):
    """Sentences of 14 words, used alone everywhere; passages of four of them in three documents each."""
    rng = random.Random(sentences)
    pool = [" ".join(f"s{k}w{j}" for j in range(14)) + "." for k in range(sentences)]
    shared = [rng.sample(pool, 4) for _ in range(passages)]
    out = []
    for i in range(docs):
        lines = []
        for n in range(rng.randrange(3, 8)):
            lines += [rng.choice(pool), " ".join(f"o{i}n{n}w{j}" for j in range(9)) + "."]
        if i >= docs - 3 * passages:
            lines[4:4] = shared[i % passages]
        out.append((i, " ".join(lines), "en", "s", 0))
    return out


@pytest.mark.parametrize("sentences", [30, 300])
@pytest.mark.parametrize("support", [0.002, 0.5])
def test_passages_of_template_sentences_go(spark, monkeypatch, sentences, support):
    """Every gram of a passage first stands alone elsewhere; with the small support the sentences are dealt to buckets."""
    monkeypatch.setattr(line_dedup, "SUPPORT", support)
    may, went, excess = measured(spark.createDataFrame(template_docs(sentences), KIND).repartition(3), SENTENCES, 40)
    assert may > 1500 and excess == 0 and went >= 0.99 * may


def test_line_dedup_of_the_table_against_true_repeated_runs(spark, sf_dir):
    may, went, excess = measured(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), SENTENCES, 40)
    assert may > 1000 and excess == 0 and went >= 0.99 * may


def test_a_line_that_stands_everywhere_is_dealt_out(spark):
    """Values above SUPPORT of the fingerprints go through buckets; the result is that of any other value."""
    common = " ".join(f"c{j}" for j in range(45)) + ". "
    docs = spark.createDataFrame([(i, common + f"own{i} a{i} b{i}. " * (i % 3) + (common if i % 5 == 0 else "")) for i in range(700)], "doc_id long, text string")
    may, went, excess = measured(docs, SENTENCES, 40)
    assert excess == 0 and went == may and may >= 45 * 699


def test_places_in_equal_surroundings_are_looked_up_once(spark, monkeypatch):
    """Runs of one line and copies of a passage, both unlike the first places of their grams: what is looked up by
    windows follows the number of different surroundings, not that of places."""
    line = " ".join(f"r{j}" for j in range(14)) + ". "
    passage = [" ".join(f"w{k}p{j}" for j in range(14)) + ". " for k in range(12)]
    own = lambda i: " ".join(f"o{i}w{j}" for j in range(14)) + ". "
    texts = [own(0) + line + own(1), "".join(x + own(f"2n{k}") for k, x in enumerate(passage))]
    texts += [own(f"{i}a") + line * 40 + own(f"{i}b") + "".join(passage) + own(f"{i}c") for i in range(2, 22)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    seen, matches = [], line_dedup.matches
    monkeypatch.setattr(line_dedup, "matches", lambda prints: seen.append(prints) or matches(prints))
    repeated_runs(hashed_lines(docs, SENTENCES, 40)).count()
    assert len(seen) == 2 and seen[1].count() < 20 * 40 < seen[0].count()
    may, went, excess = measured(docs, SENTENCES, 40)
    assert excess == 0 and went == may and may > 20 * 40 * 14


def test_one_line_repeated_in_one_document(spark):
    text = "spam and eggs again. " * 3000
    docs = spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string")
    got = {r.doc_id: r._deleted for r in dedup_lines(docs).collect()}
    assert got[1] >= 2990 and got[2] >= 2990


def test_a_passage_stays_once(spark):
    passage = " ".join(" ".join(f"w{k}{j}" for j in range(11)) + "." for k in range(6))
    docs = spark.createDataFrame([(i, f"own{i} words{i} stay{i}. {passage} end{i} of{i} it{i}.") for i in range(50)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in dedup_lines(docs).collect()}
    assert passage in got[0] and all(t == f"own{i} words{i} stay{i}. end{i} of{i} it{i}." for i, t in got.items() if i)


def test_line_dedup_awkward_rows(awkward, clashing, no_rows):
    got = rows(line_dedup_digest(awkward))
    assert len(got) == awkward.count() and rows(line_dedup_digest(clashing)) == got
    assert line_dedup_digest(no_rows).count() == 0
    assert dedup_lines(clashing).drop("_deleted").columns == clashing.columns


PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    row = [int(c) for c in reversed(digits)]
    return sum(x if k % 2 == 0 else sum(divmod(2 * x, 10)) for k, x in enumerate(row)) % 10 == 0


def brute_base(text):
    out = []
    for k, kind in enumerate(BASE):
        for m in re.finditer(PLAIN[kind], text):
            d = re.sub("[^0-9]", "", m[0])
            fine = {
                "email": lambda: True, "ip": lambda m=m: all(int(x) <= 255 for x in m[0].split(".")),
                "card": lambda d=d: 12 <= len(d) <= 19 and luhn(d), "phone": lambda d=d: 9 <= len(d) <= 15,
            }[kind]()
            if fine:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def awkward_texts():
    rng = random.Random(11)
    bits = ["a@b.c_d@e.f", "x@y", "x@y@z.w", "1.2.3.4.5.6.7.8", "001.2.3.0255", "256.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 555-0100",
            "+44.20.7946.0958", "+1", "é@é.fr", "tel: 555.123.4567", "SSN 123-45-6789", "token = \"0123456789abcdef0123456789abcdef\"", "2024-01-05", "1" * 25, "4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1",
            "😀", "bob (at) mail (dot) org", "call (415) 555-2671", ".....", "@@", "12345678901234567890 1"]
    texts = [None, "", "no data here", *bits, "5" * 40000, "a" * 60000, "a." * 20000 + "@", "1 " * 9000, "+1 " + "(" * 5000, "1." * 9000]
    return texts + ["".join(rng.choice([*bits, " ", ",", "\n", ".", "-", "7", "é", "+", "@"]) for _ in range(rng.randrange(1, 12))) for _ in range(400)]


def test_personal_data_base_spans_equal_plain_patterns(spark):
    texts = awkward_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    for r in personal_data_digest(docs).collect():
        base = brute_base(texts[r.doc_id] or "")
        want = ",".join(f"{BASE[k]}:{s}:{e}" for s, k, e in base)
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest(), texts[r.doc_id]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(b[1] == k for b in base) for k in range(4)]
        spans = [x.split(":") for x in r.spans.split(",") if x]
        assert {f"{BASE[k]}:{s}:{e}" for s, k, e in base} <= set(r.spans.split(","))
        added = [(int(s), int(e)) for k, s, e in spans if k in ADDED]
        every = [(s, e) for s, _, e in base] + added
        assert all(b <= c or d <= a for a, b in added for c, d in every if (a, b) != (c, d))
        assert [int(s) for _, s, _ in spans] == sorted(int(s) for _, s, _ in spans)


def test_personal_data_added_spans(spark):
    texts = ["the token = \"11acdfb36bb72224148e6160f674b4be45601bff\" and on", "SSN 123-45-6789, call (415) 555-2671 today", "write bob (at) mail (dot) org now",
             "In 2024-01-05 we sold 12345678 items on pages 1200-1400", "antidisestablishmentarianism and INTERNATIONALIZATION"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in redacted(docs).collect()}
    assert got[0] == "the token = \"<secret>\" and on"
    assert "123-45-6789" not in got[1] and "555-2671" not in got[1]
    assert "mail (dot) org" not in got[2]
    assert got[3] == texts[3] and got[4] == texts[4]


def test_trees_as_expression_equal_numpy(spark):
    import numpy as np
    import pyspark.sql.functions as F

    model, threshold = trained(spark)
    assert np.isfinite(threshold) and set(PATTERNS) == {*BASE, *ADDED}
    x = np.random.default_rng(0).integers(0, 40, (60, len(FEATURES))).astype(float)
    df = spark.createDataFrame(x.tolist(), [f"c{i}" for i in range(len(FEATURES))])
    got = [r.z for r in df.select(as_expression(model, [F.col(f"c{i}") for i in range(len(FEATURES))]).alias("z")).collect()]
    assert np.allclose(got, model.logit(x))


def test_personal_data_awkward_rows(awkward, clashing, no_rows):
    assert rows(personal_data_digest(clashing)) == rows(personal_data_digest(awkward))
    assert find_personal_data(no_rows).count() == 0


def test_pipeline_stages_on_the_smallest_tables(spark, sf_dir):
    docs = corpus_pipeline.table(spark, sf_dir, "documents")
    columns, before = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, sf_dir))
        assert docs.columns == columns, name
        after = [r.doc_id for r in docs.select("doc_id").collect()]
        assert set(after) <= before and (name == "mixing" or len(after) == len(set(after)))
        before = set(after)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert last.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and last.count() == docs.count()
    texts = {r.doc_id: hashlib.sha256((r.text or "").encode()).hexdigest() for r in docs.collect()}
    assert all(r.decoded_sha256 == texts[r.doc_id] for r in last.collect())
    assert rows(corpus_pipeline.run(spark, sf_dir)) == rows(last)


def test_pipeline_stages_take_awkward_rows(spark, clashing, no_rows, sf_dir):
    for name, stage in corpus_pipeline.STAGES:
        for docs in (clashing, no_rows):
            got = stage(spark, docs, sf_dir)
            assert got.count() >= 0 and (name == "piece_codec" or got.columns == docs.columns)
