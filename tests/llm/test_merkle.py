import hashlib
import zlib

import pytest

from meterline.llm import merkle

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][i : i + 3]) for i in range(0, len(out[-1]), 3)])
    return out


def path(tree, at):
    for level in tree[:-1]:
        run = at // 3 * 3
        yield level[run:at], level[at + 1 : run + 3]
        at //= 3


def brute(rows):
    """By the definition, one document after the other."""
    groups = {}
    for doc_id, text, lang, source, n_chars in rows:
        groups.setdefault(source, []).append((doc_id, leaf(doc_id, source, lang, n_chars, text), (source, lang, n_chars, text)))
    sources = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        groups[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[s] = levels([x[1] for x in groups[s]])
    top = levels([trees[s][-1][0] for s in sources])
    out = []
    for k, s in enumerate(sources):
        for i, (doc_id, h, (source, lang, n_chars, text)) in enumerate(groups[s]):
            steps = [*path(trees[s], i), *path(top, k)]
            value = h
            if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0:
                value = leaf(doc_id, source, lang, n_chars, text if text is None else text.replace("\n", ""))
            for left, right in steps:
                value = H(*left, value, *right)
            proof = "".join("".join([*left, *right]) for left, right in steps)
            out.append((doc_id, h, trees[s][-1][0], top[-1][0], H(proof), value, value == top[-1][0], proof))
    return sorted(out, key=str)


def got(df):
    return sorted(map(tuple, df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", "proof").collect()), key=str)


def test_against_brute_force(awkward):
    assert got(merkle.merkle_manifest(awkward)) == brute([tuple(r) for r in awkward.collect()])


def test_clashing_columns_and_no_rows(clashing, awkward, no_rows):
    assert got(merkle.merkle_manifest(clashing)) == brute([tuple(r) for r in awkward.collect()])
    empty = merkle.merkle_manifest(no_rows, with_proofs=False)
    assert empty.collect() == [] and empty.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


@pytest.mark.parametrize("rows", [1, 3, 4])
def test_small_trees(spark, rows):
    docs = [(i, f"line\n{i}", "en", "s", 6) for i in range(rows)]
    assert got(merkle.merkle_manifest(spark.createDataFrame(docs, DOCS))) == brute(docs)


def test_many_units_and_partitions(spark):
    """Small units and partitions: several tiers, a hot source, many small ones, partitions of several sources."""
    docs = [(2**60 + i, f"a\nb {i}", None, "hot" if i % 3 else f"s{i % 57}", i) for i in range(400)] + [(None, None, None, None, None)] * 3
    assert got(merkle.merkle_manifest(spark.createDataFrame(docs, DOCS).repartition(5), shape=merkle.Shape(2, 20))) == brute(docs)


def test_multiproof_is_least():
    """A partition that holds a run whole asks for none of it, and for nothing that its nodes give."""
    asked = merkle.climb({"=a": {3, 4, 5}}, {"=a": 0}, {"=a": 10}, {"=a": 1}, 3)
    assert sorted(asked) == [("", 0, 0), ("", 0, 2), ("=a", 1, 0), ("=a", 1, 2), ("=a", 2, 1)]
