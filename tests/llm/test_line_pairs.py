import corpus_pipeline
from meterline.llm.line_dedup import line_dedup_digest


def two_line_repeats(n=24):
    """Pairs of documents that share just two sentences of 25 and 30 words, with their own sentences around."""
    out = []
    for k in range(n):
        shared = " ".join([*(f"a{k}x{j}" for j in range(24)), "one.", *(f"b{k}x{j}" for j in range(29)), "two."])
        for side in range(2):
            own = [" ".join(f"o{k}y{side}z{m}w{j}" for j in range(6)) + "." for m in range(4)]
            out.append((2 * k + side, " ".join([*own[:2], shared, *own[2:]]), shared))
    return out


def test_every_repeat_of_two_lines_of_min_words_goes(spark):
    data = two_line_repeats()
    docs = spark.createDataFrame([(i, t) for i, t, _ in data], "doc_id long, text string")
    assert {r.doc_id: r.n_deleted for r in line_dedup_digest(docs).collect()} == {i: 2 * (i % 2) for i, _, _ in data}


def test_stage_deletes_every_repeat_of_two_lines(spark, sf_dir):
    data = two_line_repeats()
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t, _ in data], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, docs, sf_dir).collect()}
    assert all((shared in got[i]) == (i % 2 == 0) for i, _, shared in data)
