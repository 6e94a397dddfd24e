"""A quality classifier from weak labels.

Overlapping heuristics vote good, bad or not at all on every document.  Only the counts of the vote patterns are needed to
estimate, by expectation-maximisation, how often each heuristic is right about good and bad documents; every pattern thereby gets
a posterior.  Posteriors are the soft labels that train a linear scorer over hashed features of the text, which then decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import SPACE, Words, mix, plainly_named, require, slices

#: Documents that the scorer is trained on, chosen by a hash of the text; and its hashed features.
SAMPLE, SLOTS = 8000, 2048
#: Documents score from 0 (bad) to 1 (good); those below this go.
LEAST = 0.5
GOOD, BAD, SILENT = 0, 1, 2

#: (statistic, good up to, bad from, words it takes to vote); a statistic between the two keeps silent.
LABELLERS = [
    ("capitals", 0.12, 0.30, 1),  # share of words in capitals
    ("symbols", 0.03, 0.08, 1),  # share of bytes that are neither letters, digits nor plain punctuation
    ("stutter", 0.08, 0.25, 8),  # share of words that repeat the word before
    ("sameness", 0.60, 0.80, 60),  # share of words that occurred before, less what is usual for the length
    ("columns", 0.02, 0.10, 4),  # vertical bars a word
    ("shouting", 0.10, 0.50, 1),  # exclamation marks a word
    ("run_on", 0.985, 0.998, 30),  # share of words without . ? ! or line end behind
    ("punctuation", 0.12, 0.20, 4),  # share of bytes that are plain punctuation
    ("odd_words", 0.10, 0.30, 4),  # share of words with a symbol in them
]
PATTERNS = 3 ** len(LABELLERS)

_UPPER, _LOWER = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
_UPPER[65:91] = _LOWER[97:123] = True
_HIGH = np.arange(256) >= 128
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True
_PLAIN = np.zeros(256, dtype=bool)
_PLAIN[list(b".,;:'\"-!?()")] = True
#: What a byte looks like in the shape of a word: lower case and beyond ASCII, capitals, digits, or itself.
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[_LOWER | _HIGH], _SHAPE[_UPPER], _SHAPE[_DIGIT] = ord("a"), ord("A"), ord("0")


def statistics(w: Words) -> np.ndarray:
    """The labellers' statistics of each text, in their order; the words keep their case."""
    n = np.maximum(w.count, 1)
    b = w.bytes

    def per_text(of_words: np.ndarray) -> np.ndarray:
        return np.bincount(w.text, weights=of_words, minlength=w.n)

    def in_words(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(mask[b])])
        return sums[w.end] - sums[w.start]

    size = np.maximum(per_text(w.end - w.start), 1)
    upper, lower, high, digit, plain = (in_words(m) for m in (_UPPER, _LOWER, _HIGH, _DIGIT, _PLAIN))
    capitals = (upper >= 2) & (lower == 0)
    symbols = (w.end - w.start) - upper - lower - high - digit - plain
    h = w.hashes()
    again = np.zeros(len(h), dtype=bool)
    again[1:] = (h[1:] == h[:-1]) & (w.text[1:] == w.text[:-1])
    own = np.unique(h ^ mix(w.text.astype(np.uint64) + np.uint64(1)), return_index=True)[1]
    distinct = np.bincount(w.text[own], minlength=w.n) if len(h) else np.zeros(w.n)
    # long texts repeat words anyway: about as the root of the length beyond 400 words
    usual = np.minimum(1, np.sqrt(400 / n))
    bar, mark = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
    bar[ord("|")] = mark[ord("!")] = True
    stop = np.zeros(256, dtype=bool)
    stop[list(b".?!")] = True
    lines = np.concatenate([[0], np.cumsum(b == 10)])
    ends = in_words(stop) > 0
    ends[:-1] |= lines[w.start[1:]] > lines[w.end[:-1]]
    columns = [per_text(capitals) / n, per_text(symbols) / size, per_text(again) / n, 1 - np.minimum(1, distinct / n / usual), per_text(in_words(bar)) / n, per_text(in_words(mark)) / n, 1 - per_text(ends) / n, per_text(plain) / size, per_text(symbols > 0) / n]
    return np.stack(columns, axis=1)


def votes(stats: np.ndarray, count: np.ndarray) -> np.ndarray:
    """GOOD, BAD or SILENT of each labeller on each text; a text without words has no votes."""
    good = np.array([x[1] for x in LABELLERS])
    bad = np.array([x[2] for x in LABELLERS])
    least = np.array([x[3] for x in LABELLERS])
    out = np.where(stats >= bad, BAD, np.where(stats <= good, GOOD, SILENT))
    return np.where(count[:, None] >= least, out, SILENT)


def pattern(v: np.ndarray) -> np.ndarray:
    return v @ (3 ** np.arange(len(LABELLERS)))


def estimate(counts: dict[int, int], rounds: int = 500) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation over the patterns' counts: the probability that each pattern is good, and bad[class, labeller]: how often a labeller that votes on a document of the class (0 good, 1 bad) votes bad.

    Silence says nothing.  It starts from labellers that hardly ever accuse good documents and find a third of the bad ones, and
    from nine good documents in ten.  The rates follow the counts freely, but that a labeller accuses bad documents at least as
    often as good ones, so that the classes keep their meaning; one imagined vote each keeps rates without votes where they began.
    """
    every = np.arange(PATTERNS)
    v = (every[:, None] // 3 ** np.arange(len(LABELLERS))) % 3
    number = np.zeros(PATTERNS)
    for k, n in counts.items():
        number[k] = n
    says_good, says_bad = (v == GOOD).astype(float), (v == BAD).astype(float)
    bad = np.empty((2, len(LABELLERS)))
    bad[0], bad[1] = 0.001, 0.33
    prior = np.array([0.9, 0.1])
    post = np.ones((2, PATTERNS)) * prior[:, None]
    for _ in range(rounds):
        log = np.log(prior)[:, None] + np.log(bad) @ says_bad.T + np.log1p(-bad) @ says_good.T
        post = np.exp(log - log.max(axis=0))
        post /= post.sum(axis=0)
        weight = post * number
        yes, no = weight @ says_bad, weight @ says_good
        new = (yes + [[0.001], [0.33]]) / (yes + no + 1)
        new[1] = np.maximum(new[1], new[0])
        prior = np.clip((weight.sum(axis=1) + [9, 1]) / (number.sum() + 10), 0.01, 0.99)
        if np.abs(new - bad).max() < 1e-9:
            break
        bad = new
    return post[0], bad


def features(w: Words, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, slot, value): shapes of words and of pairs of words as shares, and the level of each statistic."""
    shape = _SHAPE[w.bytes]
    inside = np.zeros(len(shape), dtype=bool)
    inside[1:] = ~SPACE[w.bytes[1:]] & (shape[1:] == shape[:-1])
    inside[w.start] = False
    keep = ~SPACE[w.bytes] & ~inside
    word = np.repeat(np.arange(len(w.start)), np.add.reduceat(keep, w.start)) if len(w.start) else np.zeros(0, np.int64)
    at = np.arange(len(word)) - (np.searchsorted(word, np.arange(len(w.start)))[word] if len(word) else 0)
    code = mix(shape[keep].astype(np.uint64) + (np.minimum(at, 15).astype(np.uint64) << np.uint64(8)))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(code)])
    edge = np.searchsorted(word, np.arange(len(w.start) + 1))
    one = mix(sums[edge[1:]] - sums[edge[:-1]])
    pair = mix(one[:-1] + mix(one[1:] ^ np.uint64(0x51ED270B)))[w.text[1:] == w.text[:-1]] if len(one) else one
    pair_text = w.text[:-1][w.text[1:] == w.text[:-1]] if len(one) else w.text
    share = 1 / np.maximum(w.count, 1)
    level = np.floor(np.clip(stats, 0, 1) * 20).astype(np.uint64)
    which = np.arange(stats.shape[1], dtype=np.uint64)
    fixed = mix((which << np.uint64(32)) + level + np.uint64(1 << 50))
    text = np.concatenate([w.text, pair_text, np.repeat(np.arange(w.n), stats.shape[1])])
    slot = (np.concatenate([one, pair, fixed.ravel()]) % np.uint64(SLOTS)).astype(np.int64)
    value = np.concatenate([share[w.text], share[pair_text], np.ones(fixed.size)])
    return text, slot, value


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 300, rate: float = 0.1, decay: float = 1e-5) -> np.ndarray:
    """Logistic regression with soft labels by Adam; the last weight is the offset."""
    x = np.hstack([x, np.ones((len(x), 1), dtype=x.dtype)]).astype(np.float32)
    w = np.zeros(x.shape[1])
    m, s = np.zeros_like(w), np.zeros_like(w)
    weight = weight / weight.sum()
    for t in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w.astype(np.float32), -30, 30)))
        g = ((weight * (p - y)).astype(np.float32) @ x).astype(np.float64) + decay * w
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
    return w


class Model:
    def __init__(self, weights: np.ndarray, posterior: np.ndarray):
        self.weights, self.posterior = weights, posterior


def train(docs: DataFrame, text_col: str = "text") -> Model:
    """Counts vote patterns over all documents, and fits the scorer on at most SAMPLE of them."""
    require(docs, text_col)
    plain = docs.select(F.col(text_col).cast("string").alias("_text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = np.zeros(PATTERNS, dtype=np.int64)
        for batch in slices(batches, "_text"):
            w = Words(batch.column("_text"), lower=False)
            number += np.bincount(pattern(votes(statistics(w), w.count)), minlength=PATTERNS)
        used = np.flatnonzero(number)
        yield pa.RecordBatch.from_pydict({"p": used, "n": number[used]})

    # at most PATTERNS rows
    counts = plain.mapInArrow(count, "p bigint, n bigint").groupBy("p").agg(F.sum("n").alias("n")).collect()
    posterior, _ = estimate({r["p"]: r["n"] for r in counts})
    total = sum(r["n"] for r in counts)
    if not total:
        return Model(np.zeros(SLOTS + 1), posterior)
    # a hash of the text chooses; equal texts share it, so it is counted per hash

    def smallest(most: int) -> tuple[int, int | None]:
        """How many of the SAMPLE smallest hashes are at most `most`, and the last of them."""
        found = plain.select(F.xxhash64("_text").alias("h")).filter(F.col("h") <= F.lit(most)).distinct().orderBy("h").limit(SAMPLE)
        return found.agg(F.count("*"), F.max("h")).first()

    # hashes spread evenly: few lie below the first limit, unless most texts are copies
    near, top = -(2**63) + (2**64 * 16 * SAMPLE) // total, 2**63 - 1
    found, bound = smallest(min(near, top))
    if found < SAMPLE and near < top:
        found, bound = smallest(top)
    sample = plain.filter(F.xxhash64("_text") <= F.lit(bound)).dropDuplicates(["_text"])

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            w = Words(batch.column("_text"), lower=False)
            stats = statistics(w)
            text, slot, value = features(w, stats)
            cell, back = np.unique(text * SLOTS + slot, return_inverse=True)
            sums = np.bincount(back, weights=value)
            edge = np.searchsorted(cell // SLOTS, np.arange(w.n + 1)).astype(np.int32)
            yield pa.RecordBatch.from_pydict({"p": pattern(votes(stats, w.count)), "slot": pa.ListArray.from_arrays(edge, pa.array((cell % SLOTS).astype(np.int32))), "value": pa.ListArray.from_arrays(edge, pa.array(sums.astype(np.float32)))})

    rows = list(sample.mapInArrow(describe, "p bigint, slot array<int>, value array<float>").toLocalIterator())
    x = np.zeros((len(rows), SLOTS), dtype=np.float32)
    for i, r in enumerate(rows):
        x[i, r["slot"]] = r["value"]
    y = posterior[np.array([r["p"] for r in rows])]
    # both classes weigh alike; a class that the votes hardly show keeps a small weight
    weight = y / max(y.sum(), 1.0) + (1 - y) / max((1 - y).sum(), 1.0)
    return Model(fit(x, y, weight), posterior)


def score(docs: DataFrame, model: Model, text_col: str = "text", least: float = LEAST) -> DataFrame:
    """docs with quality (double: 0 bad to 1 good), posterior (double: what the votes alone say) and keep (boolean: quality >= least).

    A text that is null or has no word scores 0.  Other columns stay, but for earlier ones of the three names; so do repeated rows.
    """
    require(docs, text_col)
    docs = docs.drop("quality", "posterior", "keep")
    names, docs, text = list(docs.columns), plainly_named(docs), f"c{docs.columns.index(text_col)}"
    known = docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(model)  # SLOTS weights and PATTERNS posteriors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, posterior = shared.value.weights, shared.value.posterior
        for batch in slices(batches, text):
            w = Words(batch.column(text).cast(pa.string()), lower=False)
            stats = statistics(w)
            owner, slot, value = features(w, stats)
            sums = np.bincount(owner, weights=value * weights[slot], minlength=w.n) + weights[-1]
            quality = np.where(w.count > 0, 1 / (1 + np.exp(-np.clip(sums, -30, 30))), 0.0)
            post = np.where(w.count > 0, posterior[pattern(votes(stats, w.count))], 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(quality), pa.array(post), pa.array(quality >= least)], names=[*known, "quality", "posterior", "keep"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{schema}, quality double, posterior double, keep boolean").toDF(*names, "quality", "posterior", "keep")
