"""Substring dedup by sliding spans of sentences.

From every sentence on, and up to every sentence, the shortest run of consecutive sentences with at least `least_words` words is
hashed.  Runs are joined over the whole corpus; of equal runs the one of the smallest (id, place) stays, and every sentence that
another one covers goes.  A passage of at least that many words in whole sentences is thus covered from its first sentence to its
last wherever else it stands.

Passages that begin or end inside a sentence need words: with `passage`, every window of that many words of which a word is left is
compared as well, so that a repeat of at least `passage` words goes from its first word to its last.  Which windows can repeat is
told by the least hash of the shorter runs in them (winnowing): equal windows have the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from . import sketch
from .shared import Words, discard, mix, require, run_hash, run_sums, settle, slices, sweep

#: Words of a run of sentences, and of a passage that is found wherever it begins and ends.
LEAST_WORDS = PASSAGE = 50
#: Two hashes of a run's words make 128 bits.
SALTS = (0x2545F4914F6CDD1D, 0x9E6C63D0876A9A47)
#: Bytes that end a sentence at a word's end, also before a closing quote or bracket.
_ENDS, _CLOSES = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
_ENDS[list(b".!?")] = True
_CLOSES[list(b"\"')]")] = True


def sentences(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """First words of the sentences, and behind them the end of the last; and the text each belongs to.

    A sentence ends with a word that ends in . ! or ? (closing quotes and brackets aside), before a line break, and with its text.
    """
    if not len(w.start):
        return np.zeros(1, np.int64), np.zeros(0, np.int64)
    last = w.bytes[w.end - 1]
    second = w.bytes[np.maximum(w.end - 2, w.start)]
    stop = _ENDS[last] | (_CLOSES[last] & _ENDS[second])
    lines = np.concatenate([[0], np.cumsum(w.bytes == 10)])
    stop[:-1] |= lines[w.start[1:]] > lines[w.end[:-1]]
    stop[:-1] |= w.text[1:] != w.text[:-1]
    stop[-1] = True
    ends = np.flatnonzero(stop) + 1
    return np.concatenate([[0], ends]), w.text[ends - 1]


def runs(w: Words, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, end word, hash, second hash) of every run; words count from the batch's first."""
    edge, text = sentences(w)
    n = len(text)
    none = np.zeros(0, np.int64)
    if not n:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    # the first and the end sentence of each sentence's text
    low = np.searchsorted(text, text, side="left")
    high = np.searchsorted(text, text, side="right")
    k = np.arange(n)
    until = np.searchsorted(edge, edge[k] + least, side="left")
    ahead = until <= high
    since = np.searchsorted(edge, edge[k + 1] - least, side="right") - 1
    back = (since >= low) & (edge[k + 1] - least >= edge[low])
    first = np.concatenate([k[ahead], since[back]])
    end = np.concatenate([until[ahead], k[back] + 1])
    pairs = np.unique(first * np.int64(n + 1) + end)
    first, end = pairs // (n + 1), pairs % (n + 1)
    a, b = edge[first], edge[end]
    h = w.hashes()
    one, two = (run_hash(run_sums(mix(h ^ np.uint64(salt))), a, b) for salt in SALTS)
    return text[first], a, b, one, two


def slide(values: np.ndarray, width: int, better: np.ufunc) -> np.ndarray:
    """The least (np.minimum) or greatest (np.maximum) of every width neighbours."""
    done = 1
    while done < width:
        step = min(done, width - done)
        values, done = better(values[:-step], values[step:]), done + step
    return values


def covered(w: Words, gone: pa.Array) -> np.ndarray:
    """Which words of the batch the runs of gone cover: a list of (a, b) a text, or null."""
    lengths = np.nan_to_num(pc.list_value_length(gone).to_numpy(zero_copy_only=False)).astype(np.int64)
    base, flat = w.first[np.repeat(np.arange(w.n), lengths)], gone.flatten()
    mark = np.zeros(len(w.start) + 1, dtype=np.int64)
    np.add.at(mark, base + pc.struct_field(flat, "a").to_numpy(zero_copy_only=False), 1)
    np.add.at(mark, base + pc.struct_field(flat, "b").to_numpy(zero_copy_only=False), -1)
    return np.cumsum(mark)[:-1] > 0


def windows(w: Words, gone: pa.Array, passage: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First words of the windows of passage words that are not covered whole, the least run hash in each, the hashes of the runs
    that are least in some of them, and the words' hashes."""
    h = w.hashes()
    if len(h) < passage:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64), h
    short = passage // 2 + 1
    at = np.arange(len(h) - short + 1)
    part = run_hash(run_sums(mix(h ^ np.uint64(0x6A09E667F3BCC909))), at, at + short)
    least = slide(part, passage - short + 1, np.minimum)
    closed = np.concatenate([[0], np.cumsum(covered(w, gone))])
    use = (w.text[: len(least)] == w.text[passage - 1 :]) & (closed[passage:] - closed[:-passage] < passage)
    # a run counts once, however many windows it is least in
    reach = np.zeros(len(part) + passage - short, dtype=np.uint64)
    reach[passage - short : passage - short + len(least)][use] = least[use]
    chosen = slide(reach, passage - short + 1, np.maximum) == part
    start = np.flatnonzero(use)
    return start, least[start], part[chosen], h


def later(found: DataFrame, spark: SparkSession) -> DataFrame:
    """(_gid, _gth, _gone): the runs of each document that stand at a smaller place too; deletes found."""
    first = found.groupBy("h1", "h2").agg(F.min(F.struct("_id", "_th", "a")).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    # written first: a join of two tables shuffles both sides, and adaptive execution can split a hot run's rows
    first = settle(first, spark)
    others = found.join(first, ["h1", "h2"]).filter(~F.struct("_id", "_th", "a").eqNullSafe(F.col("first")))
    gone = others.groupBy("_id", "_th").agg(F.collect_set(F.struct("a", "b")).alias("_gone")).select(F.col("_id").alias("_gid"), F.col("_th").alias("_gth"), "_gone")
    gone = settle(gone, spark)
    discard(found, first)
    return gone


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS, passage: int | None = None) -> DataFrame:
    """docs with the repeated sentences taken out of text_col, and n_removed (long): the words taken out.

    Words compare without regard to the case of A-Z and the white space between them.  What stays is byte for byte as it was; a
    removed sentence goes with the white space behind it.  Equal runs within one document count as well.  Rows of equal id and
    equal text are one document: all of them keep or lose the same.  A null text stays null; a null id comes before all others.
    All other columns stay.  Every run of every whole text takes part.  passage: windows of so many words are compared too, where
    the runs of sentences have left a word of them; the one of the smallest (id, place) among these stays.
    """
    require(docs, id_col, text_col)
    if "n_removed" in docs.columns:
        docs = docs.drop("n_removed")
    spark = docs.sparkSession
    keyed = docs.select(*sketch.row_key(id_col, text_col))

    known = spark.sparkContext.broadcast(sketch.repeated(keyed.select("_text"), "_text", lambda batch: runs(Words(batch.column("_text")), least_words)[3], hottest=64))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            w = Words(batch.column("_text"))
            text, a, b, h1, h2 = runs(w, least_words)
            keep = known.value.may_repeat(h1)
            text, a, b, h1, h2 = text[keep], a[keep], b[keep], h1[keep], h2[keep]
            at = pa.array(text)
            yield pa.RecordBatch.from_pydict({"h1": h1.view(np.int64), "h2": h2.view(np.int64), "_id": batch.column("_id").take(at), "_th": batch.column("_th").take(at), "a": (a - w.first[text]).astype(np.int32), "b": (b - w.first[text]).astype(np.int32)})

    found = settle(keyed.mapInArrow(emit, "h1 bigint, h2 bigint, _id bigint, _th bigint, a int, b int"), spark)
    gone = later(found, spark)
    # positional names, so that no column of docs can clash with those of the join
    names, place = list(docs.columns), f"c{docs.columns.index(text_col)}"
    every = docs.toDF(*[f"c{i}" for i in range(len(names))])
    every = every.withColumn("_rid", F.col(f"c{names.index(id_col)}").cast("bigint")).withColumn("_rth", F.xxhash64(place)).withColumn(place, F.col(place).cast("string"))
    own = F.col("_rid").eqNullSafe(F.col("_gid")) & (F.col("_rth") == F.col("_gth"))
    # the runs grow with the corpus: never broadcast, whatever their number here
    joined = every.join(gone.hint("merge"), own, "left").drop("_gid", "_gth")
    if passage:
        joined = settle(joined, spark)
        known.destroy()
        discard(gone)
        sweep(spark)
        left = joined.select(F.col("_rid").alias("_id"), F.col("_rth").alias("_th"), F.col(place).alias("_text"), "_gone")
        parts = spark.sparkContext.broadcast(sketch.repeated(left, "_text", lambda batch: windows(Words(batch.column("_text")), batch.column("_gone"), passage)[2], hottest=64))

        def emit_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "_text"):
                w = Words(batch.column("_text"))
                a, least, _, h = windows(w, batch.column("_gone"), passage)
                a = a[parts.value.may_repeat(least)]
                h1, h2 = (run_hash(run_sums(mix(h ^ np.uint64(salt))), a, a + passage) for salt in SALTS)
                text = w.text[a]
                own, at = (a - w.first[text]).astype(np.int32), pa.array(text)
                yield pa.RecordBatch.from_pydict({"h1": h1.view(np.int64), "h2": h2.view(np.int64), "_id": batch.column("_id").take(at), "_th": batch.column("_th").take(at), "a": own, "b": own + np.int32(passage)})

        more = later(settle(left.mapInArrow(emit_windows, "h1 bigint, h2 bigint, _id bigint, _th bigint, a int, b int"), spark), spark).withColumnRenamed("_gone", "_more")
        sweep(spark)
        joined = joined.join(more.hint("merge"), own, "left").drop("_gid", "_gth")
        joined = joined.withColumn("_gone", F.when(F.col("_more").isNull(), F.col("_gone")).when(F.col("_gone").isNull(), F.col("_more")).otherwise(F.concat("_gone", "_more"))).drop("_more")
    joined = joined.drop("_rid", "_rth")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, place):
            texts, gone_runs = batch.column(place), batch.column("_gone")
            removed = np.zeros(batch.num_rows, dtype=np.int64)
            hit = np.flatnonzero(gone_runs.is_valid().to_numpy(zero_copy_only=False))
            if len(hit):
                some = texts.take(pa.array(hit))
                w, raw = Words(some), [(t or "").encode() for t in some.to_pylist()]
                new = texts.to_pylist()
                for i, row in enumerate(hit.tolist()):
                    own = slice(w.first[i], w.first[i + 1])
                    start = np.append(w.start[own] - w.bounds[i], len(raw[i]))
                    cover = np.zeros(len(start), dtype=np.int64)
                    for run in gone_runs[row].as_py():
                        cover[run["a"]] += 1
                        cover[run["b"]] -= 1
                    out = np.cumsum(cover)[:-1] > 0
                    removed[row] = out.sum()
                    edges = np.flatnonzero(np.diff(np.concatenate([[False], ~out, [False]]).astype(np.int8)))
                    lead = raw[i][: start[0]]
                    kept = b"".join(raw[i][start[x] : start[y]] for x, y in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))
                    new[row] = (lead + kept if not out[-1] else (lead + kept).rstrip(b" \t\r\n\v\f")).decode()
                texts = pa.array(new, pa.string())
            columns = [batch.column(f"c{i}") if c != text_col else texts for i, c in enumerate(names)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(removed)], names=[*names, "n_removed"])

    kind = StructType([StructField(f.name, StringType() if f.name == text_col else f.dataType, True) for f in docs.schema.fields] + [StructField("n_removed", LongType())])
    return joined.mapInArrow(cut, kind)
