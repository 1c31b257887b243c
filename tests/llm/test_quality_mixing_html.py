import random
import re
from collections import Counter, defaultdict
from itertools import combinations, product

import numpy as np
import pytest

from meterline.llm import gbdt
from meterline.llm.common import SPACES, table
from meterline.llm.html_text import extract_pages, main_text
from meterline.llm.mixing import Flow, mix_sources, mixed_documents, pattern_tokens, source_targets
from meterline.llm.quality_classifier import beta_strength, classify_quality, kept_documents
from meterline.llm.quality_rules import quality_rules
from meterline.llm.statistics import repeated_words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LABELS = "doc_id long, quality int, toxic int"


def key(r):
    return tuple((x is None, x) for x in r)


def rows(df):
    return sorted(map(tuple, df.collect()), key=key)


def brute_base(text):
    text = text or ""
    words = WORD.findall(text)
    count = Counter(zip(words, words[1:], words[2:]))  # noqa: B905
    covered = {i + k for i in range(len(words) - 2) if count[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n")]
    dup = sum(1 for i, x in enumerate(lines) if x.strip(SPACES) and x in lines[:i])
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_repeated_words_of_very_many_kinds():
    rng = np.random.default_rng(0)
    words = [str(x).encode() for x in rng.permutation(3_000_000)]
    assert repeated_words(words + words[:5]) == (10, 3_000_000)


def test_trees_keep_their_order_and_learn():
    rng = np.random.default_rng(4)
    x = rng.random((3000, 3))
    y = (rng.random(3000) < gbdt.sigmoid(6 * x[:, 0] - 3 + np.sin(9 * x[:, 1]))).astype(float)
    model = gbdt.fit(x, y, [1, 0, -1])
    low, high = x.copy(), x.copy()
    high[:, 0] += rng.random(3000)
    assert (model.logit(high) >= model.logit(low) - 1e-12).all()
    high = x.copy()
    high[:, 2] += rng.random(3000)
    assert (model.logit(high) <= model.logit(x) + 1e-12).all()
    assert ((model.logit(x) > 0) == (6 * x[:, 0] - 3 + np.sin(9 * x[:, 1]) > 0)).mean() > 0.9

    def by_hand(row):
        z = model.base
        for n in model.roots:
            while model.left[n] != n:
                n = model.left[n] if row[model.feature[n]] <= model.threshold[n] else model.right[n]
            z += model.value[n]
        return z

    assert np.allclose(model.logit(x[:50]), [by_hand(r) for r in x[:50]])
    assert len(set(gbdt.fit(x, np.ones(3000)).logit(x))) == 1


def test_quality_rules_base_and_awkward_rows(spark, awkward, clashing, no_rows):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(0, 60, 3)] + [(7, None, None), (None, 1, 1)], LABELS)
    got = rows(quality_rules(awkward, labels))
    want = sorted(((r.doc_id, *brute_base(r.text)) for r in awkward.collect()), key=key)
    assert [r[:6] for r in got] == want
    for r in got:
        assert r[6] == (r[1] < 50 or 100 * r[5] > 50 * r[1]) and not (r[6] and r[8])
    assert rows(quality_rules(clashing, labels)) == got
    assert quality_rules(no_rows, labels).count() == 0
    assert quality_rules(awkward, spark.createDataFrame([], LABELS)).count() == len(want)


@pytest.fixture(scope="module")
def judged(spark):
    """Held-out labels: the models see one half."""
    docs = table(spark, "/root/testdata/sf0.1", "documents")
    labels = table(spark, "/root/testdata/sf0.1", "labels").toPandas()
    seen = spark.createDataFrame(labels[labels.doc_id % 2 == 0].astype("int64"), "doc_id long, quality long, toxic long")
    return docs, seen, labels[labels.doc_id % 2 == 1]


def test_quality_rules_on_held_out_labels(judged):
    docs, seen, held = judged
    got = quality_rules(docs, seen).toPandas().merge(held, on="doc_id")
    judged_rows = got[~got.base_failed]
    assert ((judged_rows.score >= 0.5) == (judged_rows.quality == 1)).mean() > 0.97


def test_classifier_on_held_out_labels(judged):
    docs, seen, held = judged
    got = classify_quality(docs, seen).toPandas().merge(held, on="doc_id")
    clean = got[(got.quality == 1) & (got.toxic == 0)]
    assert clean.kept.mean() > 0.97 and got[got.quality == 0].kept.mean() < 0.05
    text = docs.filter("lang = 'en'").select("doc_id", "text").toPandas()
    english_toxic = got[got.toxic == 1].merge(text, on="doc_id")
    assert english_toxic.kept.mean() < 0.15
    kept = {r.doc_id for r in kept_documents(docs, seen).select("doc_id").collect()}
    assert kept == set(classify_quality(docs, seen).filter("kept").toPandas().doc_id)


def test_classifier_awkward_rows(spark, awkward, clashing, no_rows):
    labels = spark.createDataFrame([(i, i % 2, i % 3 % 2) for i in range(60)] + [(None, 1, 1), (3, None, None)], LABELS)
    got = rows(classify_quality(awkward, labels))
    assert [r[0] for r in got] == sorted((r.doc_id for r in awkward.collect()), key=lambda x: (x is None, x))
    assert rows(classify_quality(clashing, labels)) == got
    assert classify_quality(no_rows, labels).count() == 0
    assert classify_quality(awkward, spark.createDataFrame([], LABELS)).count() == len(got)
    assert kept_documents(clashing, labels).columns == clashing.columns


def test_sparse_sites_shrink_to_the_global_share(spark):
    alike = spark.createDataFrame([(100, 20.0)] * 30, "n long, bad double")
    apart = spark.createDataFrame([(100, 2.0)] * 15 + [(100, 90.0)] * 15, "n long, bad double")
    assert beta_strength(alike)[1] > 1e4 and beta_strength(apart)[1] <= 10.0 and abs(beta_strength(apart)[0] - 0.46) < 1e-9


def test_source_targets_share_the_excess():
    sizes = {"b": 100, "a": 10, None: 1000, "c": 500}
    got = source_targets(sizes, (5, 2, 1), 1.5, 2)
    assert got["a"] == 20 and got["b"] == 200 and abs(sum(got.values()) - 1.5 * 1610) < 1e-9
    rest = 1.5 * 1610 - 220
    assert got["c"] == pytest.approx(min(1000, rest / 6)) and got[None] == pytest.approx(rest - got["c"])
    assert source_targets({}, (5,), 1.5, 2) == {}


def test_flow_prefers_first_copies_across_overlaps():
    tokens = pattern_tokens({"ab": 100, "a": 50, "b": 50}, {"ab": ["a", "b"], "a": ["a"], "b": ["b"]}, {"a": 120.0, "b": 80.0}, 2)
    assert tokens == {"ab": 100, "a": 50, "b": 50}
    flow = Flow(4)
    arcs = [flow.arc(0, 1, 5), flow.arc(0, 2, 5), flow.arc(1, 3, 4), flow.arc(2, 3, 5), flow.arc(1, 2, 5)]
    flow.run(0, 3)
    assert sum(flow.room[a + 1] for a in arcs[:2]) == 9


def test_flow_takes_what_a_brute_force_takes_at_least_cost():
    """Small overlapping sets: no plan fills the quotas further, and none of the same size repeats less."""
    rng = random.Random(4)
    for _ in range(30):
        subsets = [list(c) for n in (1, 2, 3) for c in combinations(("a", "b", None), n)]
        members = {f"p{k}": c for k, c in enumerate(rng.sample(subsets, 3))}
        sizes = {p: rng.randrange(1, 4) for p in members}
        quota = {s: float(rng.randrange(0, 6)) for s in ("a", "b", None)}
        got = pattern_tokens(sizes, members, quota, 2)

        def fills(take):
            return max(
                sum(x for x in split if x)
                for split in product(*[range(int(quota[s]) + 1) for s in ("a", "b", None)])
                if all(sum(x for x, s in zip(split, ("a", "b", None), strict=True) if s in part) <= sum(t for p, t in take.items() if part & set(members[p])) for n in (1, 2, 3) for part in map(set, combinations(("a", "b", None), n)))
            )

        plans = [dict(zip(sizes, t, strict=True)) for t in product(*[range(2 * n + 1) for n in sizes.values()])]
        best = max(fills(t) for t in plans)
        extra = lambda t: sum(max(0, t[p] - sizes[p]) for p in sizes)
        assert sum(got.values()) == best == fills(got)
        assert extra(got) == min(extra(t) for t in plans if sum(t.values()) == best == fills(t))


def test_many_sources_are_solved_in_closed_form():
    sizes = {f"p{i}": 100 + i for i in range(50_000)}
    got = pattern_tokens(sizes, {p: [p] for p in sizes}, {p: 250.0 for p in sizes}, 2)
    assert all(got[p] == min(250, 2 * n) for p, n in sizes.items())


def test_mixing_meets_targets_and_reruns_agree(spark, awkward, clashing, no_rows):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    got = mix_sources(docs).toPandas()
    again = mix_sources(docs.repartition(5)).toPandas()
    assert got.sort_values("doc_id").reset_index(drop=True).equals(again.sort_values("doc_id").reset_index(drop=True))
    text = docs.select("doc_id", "text", "source").toPandas()
    merged = got.merge(text, on="doc_id")
    assert (merged["size"] == [len(WORD.findall(t or "")) for t in merged.text]).all()
    sizes = merged.groupby("source")["size"].sum().to_dict()
    want = source_targets({s: int(n) for s, n in sizes.items()}, (5, 2, 1), 1.5, 2)
    for s, g in merged.groupby("source"):
        assert g.target.iloc[0] == pytest.approx(want[s]) and g.source_size.iloc[0] == sizes[s]
        assert abs(g.taken.sum() - want[s]) <= 0.02 * want[s]
    assert (got.taken <= 2 * got["size"]).all() and set((got.taken % got["size"].clip(lower=1)).tolist()) == {0}
    assert rows(mix_sources(clashing)) == rows(mix_sources(awkward))
    assert mix_sources(no_rows).count() == 0
    assert mixed_documents(clashing).columns == clashing.columns


def test_mixed_documents_repeat_rows(spark):
    docs = spark.createDataFrame([(i, "w " * (i % 7 + 1), "s" + str(i % 2)) for i in range(200)], "doc_id long, text string, source string")
    plan = {r.doc_id: r.taken // r["size"] for r in mix_sources(docs).collect()}
    times = Counter(r.doc_id for r in mixed_documents(docs).collect())
    assert {i: n for i, n in plan.items() if n} == dict(times)


def test_mixing_overlapping_sources(spark):
    docs = spark.range(500).selectExpr("id AS doc_id", "concat(repeat('w ', int(id % 5)), 'x') AS text", "CASE id % 3 WHEN 0 THEN array('a') WHEN 1 THEN array('a', 'b') ELSE array('b', 'a') END AS of")
    import pyspark.sql.functions as F

    got = mix_sources(docs, members=F.col("of"), weights=(1, 1), budget=0.6).toPandas()
    total = int(got["size"].sum())
    assert abs(got.taken.sum() - 0.6 * total) < 0.02 * total or got.taken.sum() >= 0.6 * total * 0.98


PAGES = [
    (None, ""), ("", ""), ("   ", ""), ("<html><body></body></html>", ""),
    ("<p>Short.</p>", "Short."),
    ("<body><nav><a href=x>Menu</a></nav><article><h1>A &amp; B</h1><p>One,\n two&nbsp;three<br>four<p>Five <b>six</b>seven</article><footer>f</footer>", "A & B\nOne, two three four\nFive sixseven"),
    ("<div class='sidebar'>" + "side, " * 40 + "</div><div id=content><p>" + "Main text, with commas, goes on. " * 9 + "</p><p>End.</p></div>", ("Main text, with commas, goes on. " * 9).strip() + "\nEnd."),
    ("<article><p>Body text that is long enough to be scored, surely.</p><div class='comments'><p>I agree, with all of this, and more.</p></div><form>x</form><aside>y</aside></article>", "Body text that is long enough to be scored, surely."),
    ("<article><p>Cut off in a tag, after some more text here <a hre", "Cut off in a tag, after some more text here"),
    ("<article><p>a < b and c &lt; d &#39;q&#39; &notit; &am</p><script>var p='<p>no</p>'</script><style>p{}</style></article>", "a < b and c < d 'q' ¬it; &am"),
    ("<main><header><h1>T</h1></header><ul><li>one<li>two</ul><table><tr><td>c1<td>c2</table></main>", "T\none\ntwo\nc1\nc2"),
    ("<div><span>" * 3000 + "deep text, that goes far down, still counts" + "</span></div>" * 3000, "deep text, that goes far down, still counts"),
]


def test_main_text_of_small_pages():
    for page, want in PAGES:
        assert main_text(page) == want, page and page[:90]


def test_pages_equal_the_articles_of_the_table(spark):
    import html

    pages = table(spark, "/root/testdata/sf0.001", "pages")
    source = {r.page_id: r.html for r in pages.collect()}
    for r in extract_pages(pages).collect():
        inner = re.search(r"<article>(.*?)(?:</article>|\Z)", source[r.page_id], re.S)[1].replace("<br>", " ")
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*(?:>|\Z)", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        assert r.text == "\n".join(p for p in parts if p) and r.n_chars == len(r.text)


def test_pages_awkward_rows(spark):
    kind = "page_id long, url string, html string, text string, n_chars string, doc string, _found string"
    data = [(i, None if i % 3 else "u", p, "clash", "clash", "clash", "clash") for i, (p, _) in enumerate(PAGES)]
    data += [data[5], (None, None, None, None, None, None, None)]
    got = extract_pages(spark.createDataFrame(data, kind))
    assert got.columns == ["page_id", "url", "text", "n_chars"] and got.count() == len(data)
    texts = defaultdict(set)
    for r in got.collect():
        texts[r.page_id].add(r.text)
    assert all(texts[i] == {want} for i, (_, want) in enumerate(PAGES))
    assert extract_pages(spark.createDataFrame([], kind)).count() == 0


ARTICLE = "<article><h1>Title here</h1><p>First paragraph of the article, with commas, and more than enough words to count.</p><p>Second paragraph, also long enough, to be kept whole.</p></article>"
PLAIN = ARTICLE.replace("article>", "div>")
WANTED = "Title here\nFirst paragraph of the article, with commas, and more than enough words to count.\nSecond paragraph, also long enough, to be kept whole."
AROUND = '<nav><a href="/">Home</a></nav><div class="cookie-banner"><p>We use cookies, as all do, to make this site better for you.</p></div>%s<footer><p>All rights reserved, of this site, and of all others too.</p></footer>'


@pytest.mark.parametrize("page", [
    '<div class="wrapper overflow-hidden">%s</div>', '<div class="layout no-sidebar">%s</div>', '<div id="page" class="header-fixed">%s</div>', "<form method=post>%s</form>",
    '<div class="has-sidebar"><div class="with-comments">%s</div></div>', '<main><section class="post-with-tags">%s</section></main>', '<div class="sidebar-left">%s</div>', '<div role="dialog">%s</div>', "<aside>%s</aside>", '<div class="has-sidebar menu">%s</div>',
])
def test_wrappers_that_hold_the_article_are_kept(page):
    assert main_text(AROUND % (page % ARTICLE)) == WANTED


@pytest.mark.parametrize("page", ['<div class="wrapper overflow-hidden">%s</div>', '<div class="no-sidebar">%s</div>', "<form>%s</form>", '<div class="side">%s</div>'])
def test_wrappers_on_pages_without_an_article_are_kept(page):
    assert main_text(AROUND % (page % PLAIN)) == WANTED


@pytest.mark.parametrize("aside", [
    '<div class="sidebar"><p>%s</p></div>', '<div class="comments"><article class="comment"><p>%s</p></article></div>', '<aside class="related"><article class="card"><p>%s</p></article></aside>',
    "<form><p>%s</p></form>", '<div class="ad-slot"><p>%s</p></div>', '<div style="display:none"><p>%s</p></div>', '<section id="comments"><p>%s</p><p>%s</p><p>%s</p></section>', '<div class="visually-hidden"><p>%s</p></div>',
])
def test_asides_go_beside_the_article(aside):
    text = "This is a sentence of an aside, with commas, that stands beside the article."
    assert main_text(AROUND % (ARTICLE + aside.replace("%s", text))) == WANTED
