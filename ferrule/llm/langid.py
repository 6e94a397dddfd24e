"""Language identification of whole texts, down to spans.

Every word has a script, by the ranges its letters lie in, and only languages seen in that script compete for it.  They score the
word by its byte n-grams; Viterbi's algorithm over the words of a text, with a penalty for each switch, labels spans.  The text's
language is the one that labels most letters.
"""

from __future__ import annotations

import bisect
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import mix, plainly_named, require, slices

#: Labelled documents of each language that the model is fitted on, chosen by a hash of the id.
SAMPLE = 1500
#: Languages whose counts a worker holds at a time.
HELD = 64
#: n-gram lengths in bytes, slots of the n-gram table, and the price of a switch between two words in nats.
GRAMS, SLOTS, SWITCH = (1, 2, 3, 4), 1 << 16, 12.0
#: Words whose scores a worker remembers.
REMEMBERED = 400_000
UNKNOWN = "und"

#: Starts of script ranges (fixed values of the Unicode blocks, coarsely): from each on, letters have the script beside it.
SCRIPTS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0900, "devanagari"),
    (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B00, "oriya"), (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"),
    (0x0D00, "malayalam"), (0x0D80, "sinhala"), (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"), (0x1000, "myanmar"), (0x10A0, "georgian"),
    (0x1100, "hangul"), (0x1200, "ethiopic"), (0x1780, "khmer"), (0x1800, "mongolian"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"),
    (0x3040, "kana"), (0x3100, "han"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB1D, "hebrew"), (0xFB50, "arabic"),
    (0xFF00, "other"), (0x20000, "han"), (0x323B0, "other"),
]
_STARTS = [s for s, _ in SCRIPTS]
SCRIPT_NAMES = sorted({n for _, n in SCRIPTS})
_SCRIPT_OF = [SCRIPT_NAMES.index(n) for _, n in SCRIPTS]
_LATIN = SCRIPT_NAMES.index("latin")
_NOT_LETTERS = re.compile(r"[^\w\n]|[\d_]")


def prepare(words: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Lower-case letters of each word, how many there are, and the script of the first (-1 without letters)."""
    bare = _NOT_LETTERS.sub("", "\n".join(words).lower()).split("\n")
    letters = np.fromiter(map(len, bare), dtype=np.int64, count=len(bare))
    script = np.fromiter((_LATIN if w.isascii() else _SCRIPT_OF[bisect.bisect_right(_STARTS, ord(w[0])) - 1] for w in bare), dtype=np.int64, count=len(bare))
    return bare, letters, np.where(letters > 0, script, -1)


def grams(bare: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word, slot) of all n-grams of the words with a border byte on each side."""
    data = np.frombuffer("".join(f" {w} " for w in bare).encode(), dtype=np.uint8).astype(np.uint64)
    size = np.fromiter((len(w.encode()) + 2 for w in bare), dtype=np.int64, count=len(bare))
    word = np.repeat(np.arange(len(bare)), size)
    parts_w, parts_s = [], []
    value = np.zeros(len(data), dtype=np.uint64)
    for n in GRAMS:
        if len(data) < n:
            break
        value = (value[: len(data) - n + 1] << np.uint64(8)) | data[n - 1 :] if n > 1 else data
        whole = word[: len(data) - n + 1] == word[n - 1 :]
        parts_w.append(word[: len(data) - n + 1][whole])
        parts_s.append((mix(value[whole] + np.uint64(n << 40)) % np.uint64(SLOTS)).astype(np.int64))
    return np.concatenate(parts_w), np.concatenate(parts_s)


class Model:
    """languages; table: log odds per language and slot; scripts: which language occurs in which script."""

    def __init__(self, languages: list[str], table: np.ndarray, scripts: np.ndarray):
        self.languages, self.table, self.scripts = languages, table, scripts
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.scores = np.zeros((0, len(self.languages)), dtype=np.float32)
        self.letters = np.zeros(0, dtype=np.int64)

    def __getstate__(self) -> dict:
        return {"languages": self.languages, "table": self.table, "scripts": self.scripts}

    def __setstate__(self, state: dict) -> None:
        self.__init__(**state)

    def score_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Scores per word and language, centred, and letters per word; no letters, no scores."""
        bare, letters, script = prepare(words)
        word, slot = grams(bare)
        out = np.empty((len(words), len(self.languages)), dtype=np.float32)
        for k in range(len(self.languages)):
            out[:, k] = np.bincount(word, weights=self.table[k, slot], minlength=len(words))
        allowed = self.scripts[:, script].T
        allowed[~allowed.any(axis=1)] = True
        out = np.where(allowed, out, out.min(axis=1, keepdims=True) - 4 * SWITCH)
        out[letters == 0] = 0
        return out - out.mean(axis=1, keepdims=True), letters

    def _learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.known]
        if not new:
            return
        if len(self.known) + len(new) > REMEMBERED:
            self._forget()
            new = list(words)
        scores, letters = self.score_words(new)
        self.known.update(zip(new, range(len(self.letters), len(self.letters) + len(new)), strict=True))
        self.scores, self.letters = np.concatenate([self.scores, scores]), np.concatenate([self.letters, letters])

    def label(self, texts: list[str | None]) -> list[tuple[str, float, list[tuple[int, int, str]]]]:
        """(language, share of the letters it labels, spans (first word, end word, language)) of each text."""
        words = [(t or "").split() for t in texts]
        self._learn(set().union(*words))
        count = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        index = np.fromiter(map(self.known.__getitem__, itertools.chain.from_iterable(words)), dtype=np.int64, count=int(count.sum()))
        first = np.concatenate([[0], np.cumsum(count)])
        out: list = [(UNKNOWN, 0.0, [])] * len(texts)
        if not len(index):
            return out
        scores, letters = self.scores[index], self.letters[index]
        full = np.flatnonzero(count)
        total = np.add.reduceat(scores.astype(np.float64), first[full], axis=0)
        amount = np.add.reduceat(letters, first[full])
        best = total.argmax(axis=1)
        # a path with m switches has at most m + 1 stretches in other languages, which together must gain more than m switches cost:
        # none can win unless some stretch gains more than m / (m + 1) of a switch, which is half of one at least
        gain = scores.astype(np.float64) - np.take_along_axis(scores, np.repeat(best, count[full])[:, None], axis=1)
        running = np.cumsum(gain, axis=0)
        low = np.empty_like(running)
        for k in range(len(self.languages)):
            low[:, k] = self._lowest_before(running[:, k], gain[:, k], first[full], count[full])
        switching = np.flatnonzero((np.maximum.reduceat(running - low, first[full], axis=0) > SWITCH / 2).any(axis=1))
        for i, k, n in zip(full.tolist(), best.tolist(), amount.tolist(), strict=True):
            if n:
                out[i] = (self.languages[k], 1.0, [(0, int(count[i]), self.languages[k])])
        if len(switching):
            for i, path in self._viterbi(full[switching], first, count, scores):
                own = letters[first[i] : first[i + 1]]
                if own.sum() == 0:
                    continue
                share = np.bincount(path, weights=own, minlength=len(self.languages)) / own.sum()
                k = int(share.argmax())
                edge = np.concatenate([[0], np.flatnonzero(np.diff(path)) + 1, [len(path)]])
                spans = [(int(a), int(b), self.languages[path[a]]) for a, b in itertools.pairwise(edge.tolist())]
                out[i] = (self.languages[k], float(share[k]), spans)
        return out

    @staticmethod
    def _lowest_before(running: np.ndarray, gain: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
        """At each place the lowest running sum before a stretch that ends here and begins in the same text."""
        before = running - gain
        step = np.abs(before).max(initial=0) * 2 + 1
        # texts are kept apart by ever lower levels, which come off again
        level = np.repeat(np.arange(len(first)), count) * step
        return np.minimum.accumulate(before - level) + level

    def _viterbi(self, texts: np.ndarray, first: np.ndarray, count: np.ndarray, scores: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """The best path of each text; texts of similar length advance together."""
        order = texts[np.argsort(-count[texts], kind="stable")]
        for start in range(0, len(order), 256):
            group = order[start : start + 256]
            size = count[group]
            longest, n, kinds = int(size[0]), len(group), len(self.languages)
            stay = np.zeros((longest, n, kinds), dtype=bool)
            source = np.zeros((longest, n), dtype=np.uint16)
            value = scores[first[group]].astype(np.float64)
            for t in range(1, longest):
                live = int(np.searchsorted(-size, -t, side="left"))
                now = value[:live]
                top = now.argmax(axis=1)
                switched = now[np.arange(live), top] - SWITCH
                keep = now >= switched[:, None]
                stay[t, :live], source[t, :live] = keep, top
                value[:live] = np.where(keep, now, switched[:, None]) + scores[first[group[:live]] + t]
            for j, i in enumerate(group.tolist()):
                path = np.empty(size[j], dtype=np.int64)
                at = int(value[j].argmax())
                for t in range(int(size[j]) - 1, -1, -1):
                    path[t] = at
                    if t and not stay[t, j, at]:
                        at = int(source[t, j])
                yield i, path


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fits the n-gram table on at most SAMPLE rows of every language, chosen by a hash of the id; whole texts.

    Rows with a null language or text are left out; the counting runs on the executors, a bounded table per language comes back.
    The model has SLOTS numbers for each language, so a column with a label per document is none.
    """
    require(docs, id_col, text_col, lang_col)
    plain = docs.select(F.col(id_col).cast("string").alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).filter("lang IS NOT NULL AND text IS NOT NULL")
    spark = docs.sparkSession
    keyed = plain.withColumn("h", F.xxhash64("id"))
    number = {r["lang"]: r["count"] for r in plain.groupBy("lang").count().collect()}  # one row per language
    names = sorted(number)
    if not names:
        raise ValueError("no labelled text to learn from")

    def below(bounds: dict[str, int]) -> DataFrame:
        """The rows whose hash is at most their language's bound."""
        limits = spark.createDataFrame(list(bounds.items()), "lang string, bound bigint")
        # a row per language, as the model has a table per language: texts aren't shuffled for it
        return keyed.join(F.broadcast(limits), "lang").filter("h <= bound").drop("bound")

    # hashes spread evenly, so that about twice the sample lies below this; then few rows a language are ranked, however many it has
    near = {n: min(2**63 - 1, -(2**63) + (2**64 * 2 * SAMPLE) // c) if c > 2 * SAMPLE else 2**63 - 1 for n, c in number.items()}
    found = {r["lang"]: r["count"] for r in below(near).groupBy("lang").count().collect()}
    near = {n: b if found.get(n, 0) >= SAMPLE else 2**63 - 1 for n, b in near.items()}
    ranked = below(near).select("lang", "h").withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).filter(F.col("r") <= SAMPLE)
    sample = below({r["lang"]: r["last"] for r in ranked.groupBy("lang").agg(F.max("h").alias("last")).collect()}).select("lang", "text")
    place = {n: k for k, n in enumerate(names)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def told() -> Iterator[pa.RecordBatch]:
            for k, (table, scripts) in held.items():
                used = np.flatnonzero(table)
                yield pa.RecordBatch.from_pydict({"k": pa.array([k], pa.int32()), "slot": pa.array([used.tolist()], pa.list_(pa.int32())), "n": pa.array([table[used].tolist()], pa.list_(pa.float64())), "scripts": pa.array([scripts.tolist()], pa.list_(pa.float64()))})
            held.clear()

        for batch in slices(batches, "text"):
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if place[lang] not in held:
                    if len(held) >= HELD:
                        yield from told()
                    held[place[lang]] = np.zeros(SLOTS), np.zeros(len(SCRIPT_NAMES))
                table, scripts = held[place[lang]]
                bare, letters, script = prepare(text.split() or [""])
                word, slot = grams([w for w in bare if w] or [""])
                table += np.bincount(slot, minlength=SLOTS)
                scripts += np.bincount(script[script >= 0], weights=letters[script >= 0], minlength=len(SCRIPT_NAMES))
        yield from told()

    counts = sample.mapInArrow(count, "k int, slot array<int>, n array<double>, scripts array<double>")
    table, scripts = np.zeros((len(names), SLOTS)), np.zeros((len(names), len(SCRIPT_NAMES)))
    for row in counts.toLocalIterator():
        table[row["k"], np.array(row["slot"], dtype=np.int64)] += row["n"]
        scripts[row["k"]] += row["scripts"]
    share = (table + 0.5) / (table.sum(axis=1, keepdims=True) + 0.5 * SLOTS)
    odds = np.log(share) - np.log(share.mean(axis=0, keepdims=True))
    seen = scripts >= 0.01 * np.maximum(scripts.sum(axis=1, keepdims=True), 1)
    return Model(names, odds.astype(np.float32), seen)


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with lang_pred (string), score (double: the share of the letters that it labels) and spans (array of first word, end word, lang).

    Texts without a letter, and null, get `und`, score 0 and no spans; words are cut at white space.  Other columns of docs stay,
    but for earlier ones of the three names.  Nothing but the text decides.
    """
    require(docs, text_col)
    docs = docs.drop("lang_pred", "score", "spans")
    names, docs, text = list(docs.columns), plainly_named(docs), f"c{docs.columns.index(text_col)}"
    known = docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(model)  # SLOTS numbers a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))
        for batch in slices(batches, text):
            found = shared.value.label(batch.column(text).to_pylist())
            spans = [[{"first": a, "end": b, "lang": n} for a, b, n in s] for _, _, s in found]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array(spans, kind)], names=[*known, "lang_pred", "score", "spans"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{schema}, lang_pred string, score double, spans array<struct<first:int,end:int,lang:string>>").toDF(*names, "lang_pred", "score", "spans")


def held_out(id_col: str = "doc_id") -> Column:
    """The rows that are never learned from: crc32 of the id as text leaves no remainder by 5 (a null id: false)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))
