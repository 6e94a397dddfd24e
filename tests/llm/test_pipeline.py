"""The pipeline against plain versions of its stages on a small table."""

import corpus_pipeline as pipeline
import numpy as np
from ferrule.llm import langid, quality, queries, substrings
from ferrule.llm.shared import settle
from test_bpe_packing import check_packed
from test_text_operators import brute_components, brute_dedup


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_run_against_plain_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    every = [tuple(r) for r in docs.collect()]
    names = docs.columns
    text, ident, chars = names.index("text"), names.index("doc_id"), names.index("n_chars")

    kept = {r.doc_id for r in quality.score(docs, quality.train(docs)).filter("keep").select("doc_id").collect()}
    one = [r for r in every if r[ident] in kept]
    stage = settle(pipeline.quality_stage(spark, docs, data))
    assert stage.columns == names and rows(stage) == sorted(one, key=repr)

    model = langid.train(stage.filter(~langid.held_out()))
    labels = model.label([r[text] for r in one])
    two = [r for r, (lang, score, _) in zip(one, labels, strict=True) if lang != "und" and score >= 0.5]
    stage = settle(pipeline.language_stage(spark, stage, data))
    assert stage.columns == names and rows(stage) == sorted(two, key=repr)

    heads = {i for i, _, c in brute_components([(r[ident], r[text]) for r in two], 5, 80) if i == c}
    three = [r for r in two if r[ident] in heads]
    stage = settle(pipeline.jaccard_stage(spark, stage, data))
    assert stage.columns == names and rows(stage) == sorted(three, key=repr)

    new = {i: (t, n) for i, t, n in brute_dedup(spark, [(r[ident], r[text]) for r in three], substrings.LEAST_WORDS, substrings.PASSAGE)}
    four = []
    for r in three:
        t, n = new[r[ident]]
        if n == 0 or t.strip(" "):
            four.append(tuple(t if k == text else len(t) if k == chars else v for k, v in enumerate(r)))
    stage = settle(pipeline.substring_stage(spark, stage, data))
    assert stage.columns == names and rows(stage) == sorted(four, key=repr)

    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.vocabulary())
    expected = {r[ident]: np.array([*library.encode(r[text], add_special_tokens=False).ids, 1], dtype="<u4").tobytes() for r in four}
    final = pipeline.run(spark, data).collect()
    pieces = [(r.doc_id, r.start, expected[r.doc_id][4 * r.start : 4 * (r.start + r.length)], r.sequence_id, r.offset) for r in final]
    assert check_packed(pieces, expected) == 0


def test_awkward_rows(spark):
    long = "This is a fine sentence about nothing much at all. "
    docs = [(1, None, "en", "s", 0, 0.1), (2, "", None, "s", 0, 0.1), (3, long * 3, "en", None, 5, None), (3, long * 3, "en", None, 5, None), (4, long * 3, None, "s", 5, 0.1), (None, long * 2, "en", "s", 5, 0.1)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint, score double")
    for _, stage in pipeline.STAGES[:-1]:
        df = settle(stage(spark, df, ""))
        assert df.columns == ["doc_id", "text", "lang", "source", "n_chars", "score"]
    assert [r.doc_id for r in df.collect()] == [3]
    empty = df.limit(0)
    for _, stage in pipeline.STAGES:
        assert stage(spark, empty, "").count() == 0


def test_jaccard_stage_keeps_what_links_with_nothing(spark):
    """Null and repeated ids, texts without words, and columns of any type."""
    one, two, three = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    docs = [(None, one, {"x": 1}), (None, two, {"x": 2}), (7, two, {"x": 3}), (7, three, {"x": 4}), (7, three, {"x": 5}), (7, three + " end", {"x": 6}), (8, None, None), (8, None, None), (None, " ", {})]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, `th` map<string,int>").repartition(3)
    got = pipeline.jaccard_stage(spark, df, "").collect()
    kept = sorted(((r.doc_id, r.text) for r in got), key=repr)
    hashes = {r.t: r.h for r in spark.createDataFrame([(three,), (three + " end",)], "t string").selectExpr("t", "xxhash64(t) AS h").collect()}
    assert kept == sorted([(None, one), (7, two), (7, min(hashes, key=hashes.get)), (8, None), (8, None), (None, " ")], key=repr)
