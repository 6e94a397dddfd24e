import collections
import copy
import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from conftest import same_rows
from ferrule.llm import html, jaccard, langid, quality, queries, sketch, substrings
from ferrule.llm.shared import Words
from pyspark.sql import functions as F

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def documents(spark, data):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]


def words(text):
    return [w.translate(LOWER) for w in WORD.findall((text or "").encode())]


def test_words_and_hashes():
    some = ["", None, "a b", " Ä b\n\nc ", "x" * 70_000 + " y", "A B", "b a", "ab", "a\x1fb"]
    w = Words(pa.array(some).slice(1))
    got = [[bytes(w.bytes[w.start[i] : w.end[i]]) for i in range(w.first[k], w.first[k + 1])] for k in range(w.n)]
    assert got == [words(t) for t in some[1:]]
    h = w.hashes()
    assert len(set(h.tolist())) == len({x for g in got for x in g})
    text, s = w.shingles(2)
    assert len({x for x, t in zip(s.tolist(), text.tolist(), strict=True) if t in (1, 4)}) == 1, "a b and A B have one shingle in common"


# ---------------------------------------------------------------------------


def brute_components(docs, k, percent):
    sets = []
    for _, t in docs:
        w = words(t)
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    label = list(range(len(docs)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, j in itertools.combinations(range(len(docs)), 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * len(a & b) >= percent * len(a | b):
            x, y = find(i), find(j)
            label[max(x, y)] = min(x, y)
    low = collections.defaultdict(list)
    for i, (name, _) in enumerate(docs):
        low[find(i)].append(name)
    out = []
    for i, (name, _) in enumerate(docs):
        names = [n for n in low[find(i)] if n is not None]
        out.append((name, len(sets[i]), min(names) if names else None))
    return sorted(out, key=repr)


def near_copies(seed, n=60):
    """Families of near copies around the threshold, a hot family, shared passages, short and empty texts."""
    rng = random.Random(seed)
    word = lambda: rng.choice("bcdfgh") + rng.choice("aeiou") + str(rng.randrange(400))
    passage = [word() for _ in range(30)]
    docs = []
    for _ in range(n // 6):
        base = [word() for _ in range(rng.choice([3, 4, 10, 60]))] + (passage if rng.random() < 0.5 else [])
        for _ in range(rng.choice([1, 2, 6])):
            copy = list(base)
            for _ in range(rng.randrange(0, 3)):
                copy[rng.randrange(len(copy))] = word()
            docs.append(" ".join(copy))
    hot = [word() for _ in range(80)]
    for _ in range(40):
        copy = list(hot)
        copy[rng.randrange(80)] = word()
        docs.append(" ".join(copy))
    docs += ["", " \n", None, "one", "ONE", "two words", passage[0], " ".join(passage), " ".join(passage).upper()]
    rng.shuffle(docs)
    return list(enumerate(docs)) + [(None, docs[0]), (3, docs[3]), (5000, docs[4])]


@pytest.mark.parametrize("seed, k, percent", [(1, 4, 85), (2, 5, 80), (3, 1, 50)])
def test_jaccard_against_brute_force(spark, seed, k, percent):
    docs = near_copies(seed)
    df = spark.createDataFrame([(i, t, 0, "c") for i, t in docs], "doc_id bigint, text string, node int, id string").repartition(5)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.link_components(df, k=k, percent=percent).collect()), key=repr)
    assert got == brute_components(docs, k, percent)


def test_jaccard_with_a_full_summary_and_no_rounds(spark, monkeypatch):
    """A bitmap in which every hash may repeat, as in a corpus too large for it, changes no result; nor do the rounds."""
    monkeypatch.setattr(sketch, "LEAST_BITS", 7)
    monkeypatch.setattr(sketch, "MOST_BITS", 7)
    monkeypatch.setattr(jaccard, "ROUNDS", 0)
    docs = near_copies(4)
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.link_components(df).collect()), key=repr)
    assert got == brute_components(docs, 4, 85)


def test_jaccard_rounds_until_nothing_is_open(spark, monkeypatch):
    """Rounds that never stop early, and marks of the least size, which hardly filter."""
    monkeypatch.setattr(jaccard, "ENOUGH", -1)
    monkeypatch.setattr(jaccard, "WORTH", -1)
    monkeypatch.setattr(jaccard, "MARKS", 64)
    docs = near_copies(5)
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.link_components(df, k=2, percent=60).collect()), key=repr)
    assert got == brute_components(docs, 2, 60)


def test_jaccard_groups_of_equal_prefix_and_size(spark):
    """Sets of one size that share their rare shingles and differ in frequent ones form one group; its members are verified."""
    rng = random.Random(9)
    common = [f"c{i}" for i in range(60)]
    rare = [f"r{i}" for i in range(40)]
    docs = [" ".join(common)] * 40
    for _ in range(12):
        own = rare + rng.sample(common, 30)
        docs.append(" ".join(own))
        docs.append(" ".join(own))
    docs = [(i, f"{t} {i % 2}") for i, t in enumerate(docs)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.link_components(df, k=1, percent=60).collect()), key=repr)
    assert got == brute_components(docs, 1, 60)


def test_marks_differ_no_more_than_sets():
    rng = np.random.default_rng(3)
    for _ in range(50):
        a = np.unique(rng.integers(0, 2**64, rng.integers(1, 900), dtype=np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.8], rng.integers(0, 2**64, rng.integers(1, 300), dtype=np.uint64)]))
        differ = sum(int(x).bit_count() for x in (jaccard.parities(a) ^ jaccard.parities(b)).view(np.uint64))
        assert differ <= len(np.setxor1d(a, b))


def test_jaccard_of_nothing(spark):
    assert jaccard.link_components(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_op4_against_sql(spark, data, duck):
    same_rows(queries.op4_jaccard(spark, data), duck.sql(queries.ORACLE_SQL["op4_jaccard"]))


# ---------------------------------------------------------------------------


def brute_dedup(spark, docs, least, passage=None):
    hashes = {r.t: r.h for r in spark.createDataFrame([(t,) for t in {t for _, t in docs if t is not None}], "t string").select("t", F.xxhash64("t").alias("h")).collect()}
    spans, texts = collections.defaultdict(list), []
    for k, (i, t) in enumerate(docs):
        raw = (t or "").encode()
        at = [m.span() for m in WORD.finditer(raw)]
        own = [raw[a:b].translate(LOWER) for a, b in at]
        texts.append((raw, at))
        cuts = [0]
        for j, (a, b) in enumerate(at):
            w = raw[a:b]
            if j + 1 == len(at) or w[-1:] in (b".", b"!", b"?") or (w[-1:] in (b'"', b"'", b")", b"]") and w[-2:-1] in (b".", b"!", b"?")) or b"\n" in raw[b : at[j + 1][0]]:
                cuts.append(j + 1)
        found = set()
        for x in range(len(cuts) - 1):
            for y in range(x + 1, len(cuts)):
                if cuts[y] - cuts[x] >= least:
                    found.add((cuts[x], cuts[y]))
                    break
            for y in range(x, -1, -1):
                if cuts[x + 1] - cuts[y] >= least:
                    found.add((cuts[y], cuts[x + 1]))
                    break
        for a, b in found:
            spans[tuple(own[a:b])].append(((i is not None, i or 0, hashes.get(t, 0), a), k, b))
    gone = collections.defaultdict(set)
    for places in spans.values():
        first = min(p for p, _, _ in places)
        for p, k, b in places:
            if p != first:
                gone[k].update(range(p[3], b))
    if passage:
        places = collections.defaultdict(list)
        for k, (i, t) in enumerate(docs):
            for a in range(len(words(t)) - passage + 1):
                if not gone[k].issuperset(range(a, a + passage)):
                    places[tuple(words(t)[a : a + passage])].append(((i is not None, i or 0, hashes.get(t, 0), a), k))
        for same in places.values():
            for p, k in same:
                if p != min(same)[0]:
                    gone[k].update(range(p[3], p[3] + passage))
    out = []
    for k, (i, t) in enumerate(docs):
        raw, at = texts[k]
        if t is None or not gone[k]:
            out.append((i, t, 0))
            continue
        kept = raw[: at[0][0]] + b"".join(raw[at[j][0] : at[j + 1][0] if j + 1 < len(at) else len(raw)] for j in range(len(at)) if j not in gone[k])
        out.append((i, (kept.rstrip(b" \t\r\n\v\f") if len(at) - 1 in gone[k] else kept).decode(), len(gone[k])))
    return sorted(out, key=repr)


@pytest.mark.parametrize("least, passage", [(50, None), (8, None), (1, None), (50, 50), (30, 20)])
def test_substring_dedup_against_brute_force(spark, data, least, passage):
    docs = documents(spark, data)[:80]
    docs += [(5000, None), (5001, ""), (5002, " "), (5003, docs[3][1]), (5003, docs[3][1]), (5004, "X. " + docs[7][1]), (None, docs[9][1]), (5005, "one two three. " * 60)]
    df = spark.createDataFrame([(i, t, "g", 1) for i, t in docs], "doc_id bigint, text string, _gone string, _rid int").repartition(4)
    out = substrings.dedup(df, least_words=least, passage=passage)
    assert out.columns == ["doc_id", "text", "_gone", "_rid", "n_removed"]
    assert sorted(((r.doc_id, r.text, r.n_removed) for r in out.collect()), key=repr) == brute_dedup(spark, docs, least, passage)


def test_substring_dedup_of_nothing(spark):
    assert substrings.dedup(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_planted_passage_goes_everywhere_but_first(spark):
    passage = " ".join(f"w{i}" for i in range(51)) + "."
    docs = [(i, f"Own text number {i} stands here.\n{passage}\nAnd own end {i}.") for i in (4, 2, 9)] + [(1, "A clean text. With nothing of the kind.")]
    got = {r.doc_id: r for r in substrings.dedup(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert passage in got[2].text and got[1].n_removed == 0 and got[2].n_removed == 0
    assert got[4].text == "Own text number 4 stands here.\nAnd own end 4." and got[9].n_removed == 51


def plain_passages(docs, length):
    """Ids and the numbers of the words of every document that stand in a window of length words that an earlier place has too."""
    place = {}
    for i, t in sorted(docs):
        for a in range(len(words(t)) - length + 1):
            place.setdefault(tuple(words(t)[a : a + length]), (i, a))
    return {i: {x for a in range(len(words(t)) - length + 1) if place[tuple(words(t)[a : a + length])] != (i, a) for x in range(a, a + length)} for i, t in docs}


def test_passages_glued_mid_sentence(spark):
    rng = random.Random(9)
    docs = []
    for i in range(40):
        own = [f"o{i}x{k}" + "." * (rng.random() < 0.07) for k in range(rng.randrange(90))]
        docs.append([i, own])
    for p, size in enumerate([50, 51, 54, 70, 130, 49]):
        ends = {rng.randrange(size) for _ in range(rng.randrange(4))}
        passage = [f"p{p}x{k}" + "." * (k in ends) for k in range(size)]
        for _, own in rng.sample(docs, 5):
            # inside no earlier passage, so that each stays in one piece
            at = rng.choice([k for k in range(len(own) + 1) if k in (0, len(own)) or own[k - 1][0] == "o" or own[k][0] == "o"])
            own[at:at] = passage
    docs = [(i, " ".join(own)) for i, own in docs]
    expected = plain_passages(docs, 50)
    assert sum(map(bool, expected.values())) > 10
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5)
    got = {r.doc_id: r for r in substrings.dedup(frame, least_words=1000, passage=50).collect()}
    for i, t in docs:
        assert words(got[i].text) == [x for k, x in enumerate(words(t)) if k not in expected[i]] and got[i].n_removed == len(expected[i])
    # with the runs of sentences too, nothing of a repeated passage is left but at its first place
    got = {r.doc_id: r for r in substrings.dedup(frame, passage=50).collect()}
    assert all(got[i].n_removed >= len(expected[i]) for i, _ in docs)
    left = collections.Counter(x.rstrip(b".") for r in got.values() for x in words(r.text))
    assert all(left[f"p{p}x{k}".encode()] == 1 for p, size in enumerate([50, 51, 54, 70, 130]) for k in range(size))


# ---------------------------------------------------------------------------


def test_language_of_held_out_documents(spark, data):
    got = queries.op3_langid(spark, data)
    truth = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "lang")
    held = got.join(truth, "doc_id").filter("held_out").collect()
    assert len(held) > 20 and np.mean([r.lang == r.lang_pred for r in held]) > 0.95
    assert got.filter("score < 0 OR score > 1").count() == 0 and got.count() == truth.count()


@pytest.fixture(scope="module")
def languages(spark, data):
    return langid.train(spark.read.parquet(f"{data}/documents.parquet"))


def test_two_short_stretches_pay_for_one_switch(languages):
    model = copy.copy(languages)
    one, two, _ = model.languages[:3]
    rows = [[10, -20, 0], [-20, 10, 0]]
    model.known, model.letters = {"a": 0, "b": 1}, np.ones(2, dtype=languages.letters.dtype)
    model.scores = np.array([r + [-30] * (len(model.languages) - 3) for r in rows], dtype=languages.scores.dtype)
    assert model.label(["a b"]) == [(one, 0.5, [(0, 1, one), (1, 2, two)])]
    assert model.label(["a"]) == [(one, 1.0, [(0, 1, one)])] and 10 < langid.SWITCH < 20


def test_spans_are_the_best_path(spark, data, languages):
    rng = random.Random(5)
    pool = [t.split() for _, t in documents(spark, data)]
    for _ in range(80):
        mixed = []
        for _ in range(rng.randrange(1, 5)):
            some = rng.choice(pool)
            i = rng.randrange(len(some))
            mixed += some[i : i + rng.randrange(1, 30)]
        lang, score, spans = languages.label(["", " ".join(mixed), None])[1]
        s = languages.scores[[languages.known[w] for w in mixed]].astype(float)
        best = s[0].copy()
        for row in s[1:]:
            best = np.maximum(best, best.max() - langid.SWITCH) + row
        names = {n: k for k, n in enumerate(languages.languages)}
        value = sum(s[a:b, names[n]].sum() for a, b, n in spans) - langid.SWITCH * (len(spans) - 1)
        assert abs(value - best.max()) < 1e-3 and [a for a, _, _ in spans][0] == 0 and spans[-1][1] == len(mixed)


def test_language_edge_cases(spark, languages):
    rows = [(1, None, 0.5), (2, "", 0.5), (3, "12 ... 3!", 0.5), (4, "Привет мир", 0.5), (5, "the " * 60_000, 0.5), (5, "the " * 60_000, 0.5)]
    got = langid.predict(spark.createDataFrame(rows, "doc_id bigint, text string, score double"), languages)
    assert got.columns == ["doc_id", "text", "lang_pred", "score", "spans"]
    by = {r.doc_id: r for r in got.collect()}
    assert [by[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and [by[i].score for i in (1, 2, 3)] == [0.0] * 3
    assert by[5].lang_pred == "en" and by[4].lang_pred in languages.languages and got.count() == 6
    assert langid.predict(spark.createDataFrame([], "text string"), languages).count() == 0
    held = spark.createDataFrame([(i,) for i in range(50)] + [(None,)], "doc_id bigint").select("doc_id", langid.held_out().alias("h")).collect()
    import zlib

    assert all(r.h == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in held)


def test_scripts_narrow_the_candidates(spark):
    docs = [(i, "γεια σου κόσμε καλημέρα", "el") for i in range(9)] + [(i, "hello world good morning", "en") for i in range(9, 18)]
    m = langid.train(spark.createDataFrame(docs, "doc_id bigint, text string, lang string"))
    assert [x[0] for x in m.label(["κόσμε", "world", "κόσμε σου γεια hello world good morning hello world"])] == ["el", "en", "en"]


# ---------------------------------------------------------------------------


def test_quality_keeps_clean_documents_and_rejects_junk(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", F.col("quality").alias("good"))
    rows = queries.op5_quality(spark, "/root/testdata/sf0.01").join(labels, "doc_id").select("good", "keep").collect()
    assert rows and quality.score(docs, quality.train(docs)).filter("keep").count() == queries.op5_quality(spark, "/root/testdata/sf0.01").filter("keep").count()
    assert np.mean([r.keep for r in rows if r.good == 1]) > 0.99 and np.mean([r.keep for r in rows if r.good == 0]) < 0.05


def test_quality_edge_cases(spark):
    rows = [(1, None, 1.0), (2, "", 1.0), (3, " \n", 1.0), (4, "A fine short sentence.", 1.0), (4, "A fine short sentence.", 1.0), (5, "BUY!! NOW!! " * 20_000, 1.0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, quality double")
    got = quality.score(df, quality.train(df))
    assert got.columns == ["doc_id", "text", "quality", "posterior", "keep"] and got.count() == 6
    assert all(not r.keep and r.quality == 0 for r in got.filter("doc_id < 4").collect())
    empty = df.limit(0)
    assert quality.score(empty, quality.train(empty)).count() == 0


def test_quality_sample_does_not_depend_on_copies(spark, monkeypatch):
    """The scorer learns from the same texts whether most rows are copies of one (all hashes are looked at) or not (few are)."""
    monkeypatch.setattr(quality, "SAMPLE", 20)
    texts = [f"Sentence {i} tells of {i * 7} things." if i % 5 else f"BUY {i}!!! NOW!!! ||| $$$ ###" for i in range(400)]
    frame = lambda t: spark.createDataFrame([(x,) for x in t], "text string")
    seen = []
    monkeypatch.setattr(quality, "fit", lambda x, y, weight: seen.append(sorted(map(tuple, np.round(x, 5).tolist()))) or np.zeros(quality.SLOTS + 1))
    quality.train(frame(texts))
    quality.train(frame(texts + [texts[1]] * 40_000))
    quality.train(frame(texts[:7]))
    assert seen[0] == seen[1] and len(seen[0]) == 20 and len(seen[2]) == 7


def test_quality_and_language_with_odd_column_names(spark):
    df = spark.createDataFrame([(1, "Some words of plain English here.", "en", 2)], "doc_id bigint, text string, lang string, `a``b.c` int")
    assert quality.score(df, quality.train(df)).columns[:4] == df.columns == langid.predict(df, langid.train(df)).columns[:4]


def test_em_finds_rates_far_from_where_it_begins():
    rng = np.random.default_rng(1)
    bad = rng.random(40_000) < 0.2
    rates = np.array([[0.05, 0.001, 0.02, 0.1, 0.001, 0.001, 0.03, 0.001, 0.001], [0.95, 0.8, 0.02, 0.3, 0.05, 0.9, 0.5, 0.7, 0.4]])
    votes = (rng.random((40_000, len(quality.LABELLERS))) < rates[bad.astype(int)]).astype(int)
    post, found = quality.estimate(collections.Counter(quality.pattern(votes).tolist()))
    assert np.abs(found - rates).max() < 0.03
    assert np.mean((post[quality.pattern(votes)] < 0.5) == bad) > 0.99


def test_em_finds_accuracies():
    rng = np.random.default_rng(0)
    bad = rng.random(20_000) < 0.15
    rates = np.array([[0.001] * len(quality.LABELLERS), [0.5, 0.3, 0.4, 0.2, 0.3, 0.4, 0.5, 0.3, 0.4]])
    votes = (rng.random((20_000, len(quality.LABELLERS))) < rates[bad.astype(int)]).astype(int)
    post, found = quality.estimate(collections.Counter(quality.pattern(votes).tolist()))
    assert np.abs(found - rates).max() < 0.06
    assert np.mean((post[quality.pattern(votes)] < 0.5) == bad) > 0.97


# ---------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body><nav><ul><li>Menu</ul></nav>
<header>Site</header><div class="ad">Buy</div><article><h1>Head &amp; line</h1><p>One <b>bold</b>word<br>two&nbsp;three<p>Four <script>x<y</script>five
<aside>side</aside><div class="share-buttons">share</div><ul><li>a<li>b</ul><!-- no <p>comment --><section id="comments"><p>nice</p></section><form>f<p>g</p></form></article>
<footer>&copy; x</footer></body></html>"""


def test_marks_that_are_none():
    """Attribute values, looks of paragraphs and formulas don't take text out of an article; what is hidden or an advert goes."""
    page = """<article><p title="a hidden gem">One</p><p class="ad-hoc">two</p><p class="lead notice">three</p><math><mi>x</mi></math><p hidden>no</p><p data-x='1' HIDDEN>no</p>
    <p class="ad">no</p><div class="ad-slot">no</div><div class="notice">no</div><h2 class="header">four</h2><p aria-hidden="true">no</p></article>"""
    assert " ".join(t for k, t in html.blocks(page) if k == html.ARTICLE) == "One two three x four"


def test_a_teaser_does_not_decide_a_page(spark):
    body = " ".join(f"word{i}" for i in range(400))
    rows = [(1, "http://a/1", f"<body><article><p>Read this too</p></article><div><p>{body}</p></div></body>"), (2, "http://a/2", f"<body><article><p>Short news</p></article><p>Imprint of this site</p></body>")]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert body in got[1] and got[2] == "Short news"


def test_more_languages_than_a_worker_holds(spark):
    """Each of 300 languages has words of its own and is learned."""
    rng = random.Random(1)
    tongues = {f"l{k:03d}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(6)] for k in range(300)}
    rows = [(i, lang, " ".join(rng.choices(own, k=30))) for i, (lang, own) in enumerate([*tongues.items()] * 2)]
    model = langid.train(spark.createDataFrame(rows, "doc_id bigint, lang string, text string").repartition(2))
    assert len(model.languages) == 300
    labels = model.label([" ".join(own * 3) for own in list(tongues.values())[:40]])
    assert np.mean([label[0] == lang for label, lang in zip(labels, tongues, strict=False)]) > 0.9


def test_article_blocks():
    assert " ".join(t for k, t in html.blocks(PAGE) if k == html.ARTICLE) == "Head & line One boldword two three Four five a b"
    for odd in ("", "<", "<p", "text", "<article>x", "</p></article>", "<!-- <p>", "<script>", "<p a='", "<article><p>a</p></article><article>b"):
        html.blocks(odd)
    assert [t for _, t in html.blocks("<main>a <i>b</i>&lt;c&gt; &#233;&am</main>")] == ["a b<c> é&am"]


@pytest.mark.parametrize("seed", range(60))
def test_suffix_array_coverage_against_brute_force(seed):
    rng = random.Random(seed)
    tokens, page = [], []
    for p in range(rng.randrange(1, 5)):
        n = rng.randrange(0, 20)
        tokens += [rng.randrange(3) for _ in range(n)] + [-1 - p]
        page += [p] * (n + 1)
    run = rng.randrange(1, 6)
    expected = [False] * len(tokens)
    for i in range(len(tokens) - run + 1):
        if min(tokens[i : i + run]) >= 0 and any(tokens[j : j + run] == tokens[i : i + run] and page[j] != page[i] for j in range(len(tokens) - run + 1)):
            expected[i : i + run] = [True] * run
    assert html.covered(np.array(tokens), np.array(page), run).tolist() == expected


@pytest.mark.parametrize("shard", [512, 2])
def test_pages_without_marks_lose_what_their_host_repeats(spark, monkeypatch, shard):
    monkeypatch.setattr(html, "SHARD", shard)
    chrome = "welcome to our site please read all our pages"
    rows = [(i, f"http://h.example/{i}", f"<div>{chrome}</div><div>{i}a only here {i}b and {i}c</div>", 0) for i in range(7)]
    rows += [(7, "http://other.example/", f"<div>{chrome}</div>", 0), (8, None, None, 0), (9, "u", "", 0), (10, "http://h.example/0", rows[0][2], 0), (11, "http://h.example/a", "<div>menu words</div><article>kept " + chrome + "</article>", 0)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, host int")
    got = {r.page_id: r for r in html.extract(df).collect()}
    assert len(got) == 12 and got[3].text == "3a only here 3b and 3c" and got[0].text == got[10].text == "0a only here 0b and 0c"
    assert got[7].text == chrome and got[8].text == got[9].text == "" and got[11].text == f"kept {chrome}" and got[3].n_chars == len(got[3].text)
    assert html.extract(df.limit(0)).count() == 0


def test_op6_against_plain_reading(spark, data):
    import html as entities

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{data}/pages.parquet").collect()}
    got = {r.page_id: r.text for r in queries.op6_html(spark, data).collect()}
    assert set(got) == set(pages)
    for i, page in pages.items():
        inner = re.search(r"<article>(.*?)(?:</article>|$)", page, re.S)[1]
        parts = [re.sub(r"\s+", " ", entities.unescape(re.sub(r"<[^>]*>", "", b))).strip() for b in re.split(r"</?(?:p|h1|br|div|ul|li)\b[^>]*>", inner)]
        assert got[i] == " ".join(p for p in parts if p)
