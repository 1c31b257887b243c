import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash

from meterline.llm.components import smallest_reachable
from meterline.llm.exact import exact_dedup
from meterline.llm.piece_codec import encode_digests, encode_documents
from meterline.llm.pieces import chunks, vocabulary
from meterline.llm.simhash import brute_force_links, linked_block, linked_pairs, near_links, simhash_classes
from meterline.llm.token_counts import count_tokens, frequent_chunks

MODEL = public_tokenizers.path("piece_bpe_32k.model")
SP = sentencepiece.SentencePieceProcessor(model_file=MODEL)


def key(r):
    return tuple((x is None, x) for x in r)


def rows(df):
    return sorted(map(tuple, df.collect()), key=key)


@pytest.mark.parametrize("support", [0.002, 0.02, 0.2])
def test_exact_dedup_equals_brute_force(awkward, support):
    want, groups = [], defaultdict(list)
    for r in awkward.collect():
        groups[r.text or ""].append(r.doc_id)
    for text, ids in groups.items():
        best = max((i for i in ids if i is not None), default=None)
        digest, first = hashlib.sha256(text.encode()).hexdigest(), True
        for i in sorted(ids, key=lambda x: (x is None, -(x or 0))):
            want.append((i, best, len(ids), first, digest))
            first = False
    assert rows(exact_dedup(awkward, support=support)) == sorted(want, key=key)


def test_exact_dedup_hot_group(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('t', id div 2) END AS text")
    got = exact_dedup(docs, support=0.01).toPandas()
    hot = got[got.group_size == 1000]
    assert len(got) == 3000 and len(hot) == 1000 and hot.kept.sum() == 1 and set(hot.keep_id) == {2997}


@pytest.mark.parametrize("op", [exact_dedup, simhash_classes, lambda d: count_tokens(d, MODEL), lambda d: encode_digests(d, MODEL)])
def test_empty_table_and_clashing_names(op, awkward, clashing, no_rows):
    assert op(no_rows).count() == 0
    assert rows(op(clashing)) == rows(op(awkward))


def test_token_counts_equal_library(awkward):
    got = rows(count_tokens(awkward, MODEL, limit=50, entries=20, per_task=10, cache=5))
    want = [(r.doc_id, len((r.text or "").encode()), n := len(SP.encode(r.text or "")), n > 50) for r in awkward.collect()]
    assert got == sorted(want, key=key)


def test_frequent_chunks_are_those_of_all_texts(spark):
    """60,000 texts in 40 parts, so that summaries are added up in two levels: the order of exact counts."""
    said = [(i, f"all of{i % 2} them{i % 3} and{i % 5}") for i in range(60_000)]
    want = Counter(c for _, t in said for c in chunks(t))
    got = frequent_chunks(spark.createDataFrame(said, "id long, text string").repartition(40), 12, 1000, 48)
    assert got == sorted(want, key=lambda c: (-want[c], c))[:12]


def test_codec_equals_library(awkward):
    def sha(s):
        return hashlib.sha256(s.encode()).hexdigest()

    want = []
    for r in awkward.collect():
        ids = SP.encode(r.text or "")
        want.append((r.doc_id, len(ids), sha(",".join(map(str, ids))), sha(SP.decode(ids))))
    assert rows(encode_digests(awkward, MODEL)) == sorted(want, key=key)
    texts = {r.doc_id: r.text or "" for r in awkward.collect() if r.doc_id is not None}
    for full in encode_documents(awkward, MODEL).filter("doc_id IS NOT NULL").collect():
        assert full.ids == SP.encode(texts[full.doc_id]) and full.decoded == SP.decode(full.ids)


def test_merge_rounds_equal_the_library():
    """Short and long chunks, with symbols whose ranks may merge together and others that may not."""
    rng = np.random.default_rng(3)
    v = vocabulary(MODEL)
    assert 0 < (~v.together).sum() < len(v.together)
    for alphabet in ("aethino. \n▁é日😀019ßX", "aaab", "theinrsa", "=-_ #"):
        for _ in range(300):
            text = "".join(rng.choice(list(alphabet), rng.integers(0, 200)))
            assert [i for c in v.encode_chunks(chunks(text)) for i in c] == SP.encode(text)
    letters = "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz0123456789"), 3000))
    for text in ("ab" * 20000, "a" * 30001, "日本" * 9999, "=" * 5000, letters):
        assert [i for c in v.encode_chunks(chunks(text)) for i in c] == SP.encode(text)


def simple_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()]
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def reach(ids, links):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def brute_components(docs):
    """(doc_id, fingerprint, smallest doc_id reachable) of every row, from all pairs of rows; null if no id is reached."""
    values = [simple_fingerprint(t) for _, t in docs]
    of = reach(range(len(docs)), brute_force_links(values))
    ids = {}
    for k, (i, _) in enumerate(docs):
        ids.setdefault(of[k], []).append(i)
    least = {c: min((i for i in found if i is not None), default=None) for c, found in ids.items()}
    return sorted(((i, f"{v:016x}", least[of[k]]) for k, ((i, _), v) in enumerate(zip(docs, values, strict=True))), key=key)


def test_simhash_equals_brute_force(awkward):
    assert rows(simhash_classes(awkward)) == brute_components([(r.doc_id, r.text) for r in awkward.collect()])


def test_simhash_null_and_repeated_ids_join_nothing(spark):
    one, two, three = ("alpha beta gamma delta epsilon " * 9).strip(), ("red green blue white black grey " * 9).strip(), ("up down left right in out over " * 9).strip()
    docs = [(1, one), (2, two), (None, one), (None, two), (None, three), (7, two), (7, three), (9, three)]
    got = rows(simhash_classes(spark.createDataFrame(docs, "doc_id long, text string")))
    assert got == brute_components(docs) and {r[2] for r in got} == {1, 2, 7}


def clustered(rng, n, radius=4):
    centres = rng.integers(0, 1 << 63, max(1, n // 40), dtype=np.uint64)
    out = []
    for _ in range(n):
        v = int(rng.choice(centres))
        for b in rng.integers(0, 64, rng.integers(0, radius)):
            v ^= 1 << int(b)
        out.append(v)
    return np.array(sorted(set(out)), dtype=np.uint64)


def test_bit_sliced_comparison_equals_popcount():
    rng = np.random.default_rng(1)
    values = clustered(rng, 500)
    want = brute_force_links([int(v) for v in values])
    i, j = np.triu_indices(len(values), 1)
    close = linked_pairs(values, i, j)
    assert set(zip(i[close].tolist(), j[close].tolist(), strict=True)) == want
    found = {(a, b) for x, y in linked_block(values, values) for a, b in zip(x.tolist(), y.tolist(), strict=True) if a < b}
    assert found == want


@pytest.mark.parametrize("block", [8192, 90, 7])
def test_links_in_buckets_and_blocks_lose_nothing(spark, block):
    rng = np.random.default_rng(2)
    values = clustered(rng, 700)
    nodes = spark.createDataFrame([(k, int(v.astype(np.int64))) for k, v in enumerate(values)], "node long, fp long")
    links = near_links(nodes, block).collect()
    ids = range(len(values))
    assert reach(ids, [(r.a, r.b) for r in links]) == reach(ids, brute_force_links([int(v) for v in values]))


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(5, k) for k in range(6, 90)] + [(200, 300), (300, 200), (300, 250)]
    got = {r.node: r.component for r in smallest_reachable(spark.createDataFrame(links, "a long, b long")).collect()}
    want = reach({x for e in links for x in e}, links)
    assert got == {k: v for k, v in want.items() if k != v}
