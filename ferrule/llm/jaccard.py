"""N-gram Jaccard join by grouped prefixes.

Texts with equal shingle sets are one node.  Shingles are ordered, the rarest first, by a bounded summary of the whole corpus and
then by hash; two sets that reach the threshold share a shingle among the first n - ceil(t * n) + 1 of each.  Nodes with the same
prefix and size form a group.  Only groups are posted under the shingles of their prefixes, only pairs of groups are filtered, and
only the pairs that are left are expanded to members and verified.

Pairs of groups are chosen so that few are needed.  First every group meets the one group that it shares most with, out of the heads
of its lists, and every member its group's first: a linear number of pairs, of which the verified ones are united to components.  A
few rounds follow for lists that still hold several components, in which each group outside a list's largest component meets a head
of that component.  At last all pairs of groups are taken that such lists still hold, but those within the largest component.

Filters are exact: a pair within one component can't change any; a pair counts in a list only if so much of both sets is left from
its shingle on that the threshold can be reached, which holds for the first shingle that the two have in common; and a single set's
MARKS bits tell how many of its shingles' hashes fall into each slot, odd or even: as many bits differ as shingles do, at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sketch
from .components import connected_components
from .shared import Words, discard, mix, require, run_hash, run_sums, settle, slices, sweep

#: Sets that a task remembers to have given out.
_SEEN = 200_000
#: Most rounds in which groups meet heads of lists, before all pairs that are left are verified; how many pairs in different
#: components a row of the lists may be in for no more rounds to be needed; and how many of a round's pairs, as a share of the rows.
ROUNDS, ENOUGH, WORTH = 4, 2, 0.01
#: Parity bits of a set: a power of two, 64 at least.
MARKS = 512


def distinct_shingles(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingle hashes in ascending order, one text after another, and where each text's begin."""
    w = Words(texts)
    text, h = w.shingles(k)
    edge = np.searchsorted(text, np.arange(w.n + 1))
    parts = [np.unique(h[a:b]) for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
    first = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    return np.concatenate(parts or [h]), first


def least_overlap(n: np.ndarray, percent: int) -> np.ndarray:
    """The smallest intersection that a set of n needs for a link with any other."""
    return -(-percent * n // 100)


def parities(h: np.ndarray) -> np.ndarray:
    """MARKS / 64 words, in which a bit is set if an odd number of hashes falls into its slot."""
    slot = (h >> np.uint64(65 - MARKS.bit_length())).astype(np.int64)
    return np.packbits((np.bincount(slot, minlength=MARKS) & 1).astype(np.uint8)).view(np.int64)


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose sets reach the threshold."""
    one = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    two = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "y"):
            good = np.zeros(batch.num_rows, dtype=bool)
            last, held = None, np.zeros(0, np.uint64)
            nodes = batch.column("a").to_pylist()
            for i, (node, x, y) in enumerate(zip(nodes, batch.column("x"), batch.column("y"), strict=True)):
                if node != last:
                    last, held = node, np.frombuffer(x.as_buffer(), dtype=np.uint64)
                other = np.frombuffer(y.as_buffer(), dtype=np.uint64)
                both = int((held[np.minimum(np.searchsorted(held, other), len(held) - 1)] == other).sum())
                good[i] = 100 * both >= percent * (len(held) + len(other) - both)
            yield pa.RecordBatch.from_pydict({"a": batch.column("a").filter(pa.array(good)), "b": batch.column("b").filter(pa.array(good))})

    return pairs.join(two, "b").join(one, "a").select("a", "x", "b", "y").mapInArrow(verify, "a bigint, b bigint")


def link_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, percent: int = 85) -> DataFrame:
    """(id_col, n_shingles, component_id) for every row: texts are linked where 100 * |intersection| >= percent * |union|.

    Words are the longest runs without space and 0x09-0x0D, with A-Z in lower case; a text of fewer than k words has its whole
    sequence as its one shingle; null, and texts without words, have none and link with nothing.  component_id is the smallest
    id reachable by links, the row's own included.  Rows are told apart by text alone: repeated rows and equal sets are linked.
    A null id counts in no component's smallest and has its component's, or null.  Other columns are ignored.
    """
    placed = components(docs, id_col, text_col, k, percent)
    lowest = placed.filter("n > 0").groupBy("c1", "c2").agg(F.min("id").alias("least"))
    out = placed.join(lowest, ["c1", "c2"], "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("least")).alias("component_id"))


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, percent: int = 85) -> DataFrame:
    """(id, th, n, c1, c2) for every row: its id, a hash of its text, the size of its set, and its component's name, null without a set."""
    require(docs, id_col, text_col)
    if not 1 <= percent <= 100:
        raise ValueError("percent must be from 1 to 100")
    spark = docs.sparkSession
    plain = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("th", F.xxhash64("text"))
    known = spark.sparkContext.broadcast(sketch.repeated(plain.select("text"), "text", lambda batch: distinct_shingles(batch.column("text"), k)[0]))

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in slices(batches, "text"):
            h, first = distinct_shingles(batch.column("text"), k)
            n = np.diff(first)
            h1, h2 = (run_hash(run_sums(x), first[:-1], first[1:]).view(np.int64) for x in (h, mix(h ^ np.uint64(0x5851F42D4C957F2D))))
            again = known.value.may_repeat(h)
            count = np.concatenate([[0], np.cumsum(again)])
            # a text without so many shingles that occur elsewhere has no link
            may = (n > 0) & (count[first[1:]] - count[first[:-1]] >= least_overlap(n, percent))
            prefix, place, marks, shingles, group = ([None] * len(n) for _ in range(5))
            for i in np.flatnonzero(may).tolist():
                if (both := (int(h1[i]), int(h2[i]))) in seen:
                    continue
                if len(seen) >= _SEEN:
                    seen.clear()
                seen.add(both)
                own = h[first[i] : first[i + 1]]
                flag = again[first[i] : first[i + 1]]
                rank = np.where(flag, known.value.level(own) + 1, 0).astype(np.uint8)
                order = np.argsort(rank, kind="stable")[: int(n[i] - least_overlap(n[i], percent) + 1)]
                start, ends = own[order], (np.array([0]), np.array([len(order)]))
                group[i] = b"".join(run_hash(run_sums(x), *ends).tobytes() for x in (start, mix(start ^ np.uint64(n[i]))))
                place[i] = np.flatnonzero(flag[order]).astype(np.int32)
                prefix[i] = start[place[i]].view(np.int64)
                marks[i] = parities(own)
                shingles[i] = own.tobytes()
            none = n == 0
            yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "th": batch.column("th"), "n": n, "h1": pa.array(h1, mask=none), "h2": pa.array(h2, mask=none), "grp": pa.array(group, pa.binary()), "prefix": pa.array(prefix, pa.list_(pa.int64())), "place": pa.array(place, pa.list_(pa.int32())), "marks": pa.array(marks, pa.list_(pa.int64())), "shingles": pa.array(shingles, pa.binary())})

    schema = "id bigint, th bigint, n bigint, h1 bigint, h2 bigint, grp binary, prefix array<bigint>, place array<int>, marks array<bigint>, shingles binary"
    rows = settle(plain.mapInArrow(profile, schema).withColumn("node", F.monotonically_increasing_id()), spark)
    found = rows.filter("grp IS NOT NULL")
    sets = found.select("node", "shingles")
    # a node is the row of its set that was kept; grp is from here on the least node of a group
    nodes = settle(found.drop("id", "th", "shingles").dropDuplicates(["h1", "h2"]), spark)
    groups = nodes.groupBy(F.col("grp").alias("key"), "n").agg(F.min("node").alias("grp"), F.count("*").alias("members"), F.first("prefix").alias("prefix"), F.first("place").alias("place"), F.first("marks").alias("marks"))
    groups = settle(groups.withColumn("marks", F.when(F.col("members") == 1, F.col("marks"))), spark)
    several = groups.filter("members > 1").select("key", "n", F.col("grp").alias("of"))
    member = nodes.withColumnRenamed("grp", "key").join(several, ["key", "n"], "left").select("node", "n", "marks", F.coalesce("of", "node").alias("grp"))
    within = member.filter("node <> grp").select(F.col("grp").alias("a"), F.col("node").alias("b"))

    size_class = F.floor(F.log("n") / np.log(100 / percent)).cast("int") if percent < 100 else F.col("n").cast("int")
    # a row per shingle of the prefixes; sizes within one class are apart by less than the threshold allows
    posted = groups.select("grp", "n", size_class.alias("size"), F.explode(F.arrays_zip("prefix", "place")).alias("p")).select("grp", "n", "size", F.col("p.prefix").alias("token"), F.col("p.place").alias("at"))

    def fit(x: str, y: str) -> str:
        """Whether sets x and y can reach the threshold by their sizes n_."""
        return f"100 * least(n_{x}, n_{y}) >= {percent} * greatest(n_{x}, n_{y})"

    def can_link(x: str, y: str) -> str:
        """Whether they can from this shingle on: by their sizes, and by what their orders leave from its places at_ on."""
        return f"{fit(x, y)} AND {100 + percent} * least(n_{x} - at_{x}, n_{y} - at_{y}) >= {percent} * (n_{x} + n_{y})"

    def apart(x: str, y: str) -> str:
        """In how many bits the marks differ; null where a group has several members."""
        return "(" + " + ".join(f"bit_count(marks_{x}[{i}] ^ marks_{y}[{i}])" for i in range(MARKS // 64)) + ")"

    def alike(x: str, y: str) -> str:
        """Whether no more bits differ than shingles may."""
        return f"coalesce({100 + percent} * {apart(x, y)} <= {100 - percent} * (n_{x} + n_{y}), true)"

    def side(t: DataFrame, x: str, *keep: str) -> DataFrame:
        return t.select(*keep, *[F.col(c).alias(f"{c}_{x}") for c in t.columns if c not in keep])

    # the first round: every group meets the head of its lists that it shares most with
    best = F.min(F.struct("at", F.xxhash64("grp").alias("h"), "grp", "n")).alias("head")
    heads = posted.groupBy("token", "size").agg(best, F.count("*").alias("m")).filter("m > 1").select("token", "size", F.col("head.grp").alias("a"), F.col("head.n").alias("n_a"), F.col("head.at").alias("at_a"))
    met = posted.select("token", "size", F.col("grp").alias("b"), F.col("n").alias("n_b"), F.col("at").alias("at_b")).join(heads, ["token", "size"]).filter(f"a <> b AND {can_link('a', 'b')}")
    across = met.groupBy("a", "b").agg(F.count("*").alias("shared")).groupBy("b").agg(F.max(F.struct("shared", "a")).alias("m")).select(F.col("m.a").alias("a"), "b")
    pairs = settle(across.unionAll(within), spark)
    parts = connected_components(_links(pairs, sets, percent))
    discard(pairs)
    sweep(spark)

    def opened(t: DataFrame, parts: DataFrame) -> DataFrame:
        """The rows of t with the least and greatest component of their groups' members, in lists that several components share."""
        now = member.select("node", "grp").join(parts.select(F.col("id").alias("node"), "component"), "node", "left")
        now = now.groupBy("grp").agg(F.min(F.coalesce("component", "node")).alias("low"), F.max(F.coalesce("component", "node")).alias("high"))
        now = t.drop("low", "high").join(now, "grp")
        lists = now.groupBy("token").agg(F.min("low").alias("least"), F.max("high").alias("most")).filter("least <> most").select("token")
        return now.join(lists, "token")

    table = settle(opened(posted, parts).join(groups.select("grp", "marks"), "grp"), spark)
    # what can still be asked for
    open_sets = settle(sets.join(member.join(table.select("grp").distinct(), "grp").select("node"), "node", "left_semi"), spark)
    sweep(spark)

    def counted(t: DataFrame, *by: str) -> DataFrame:
        return t.groupBy(*by, F.col("low").alias("component")).agg(F.count("*").alias("m"))

    def united(links: DataFrame) -> DataFrame:
        """The components once links are added to parts; deletes parts."""
        more = connected_components(parts.select(F.col("id").alias("a"), F.col("component").alias("b")).unionAll(links))
        discard(parts)
        return more

    for round_ in range(1, ROUNDS + 1):
        tops = settle(counted(table, "token", "size").groupBy("token", "size").agg(F.max(F.struct("m", "component")).alias("top"), F.sum("m").alias("m"), F.sum(F.col("m") * F.col("m")).alias("mm")), spark)
        load = tops.agg(F.sum(F.col("m") * F.col("m") - F.col("mm")).alias("pairs"), F.sum("m").alias("rows")).first()
        if (load["pairs"] or 0) <= ENOUGH * (load["rows"] or 0):
            discard(tops)
            break
        now = table.join(tops.select("token", "size", F.col("top.component").alias("top")), ["token", "size"])
        # the fewer rare shingles a set has before this one, the more it is like the others of its list; each round another head
        good = F.min(F.struct(F.floor(F.col("at") / (4 * round_)).alias("rare"), F.xxhash64("grp", F.lit(round_)).alias("h"), "grp", "n", "at", "marks")).alias("head")
        heads = now.filter("low = top").groupBy("token", "size").agg(good, F.first("top").alias("top"))
        heads = heads.select("token", "size", "top", *[F.col(f"head.{c}").alias(f"{c}_a") for c in ("grp", "n", "at", "marks")])
        met = side(table, "b", "token", "size").join(heads, ["token", "size"]).filter(f"(low_b <> top OR high_b <> top) AND grp_a <> grp_b AND {can_link('a', 'b')} AND {alike('a', 'b')}")
        near = met.groupBy("grp_b").agg(F.min(F.struct(F.expr(apart("a", "b")).alias("apart"), "grp_a")).alias("m"))
        pairs = settle(near.select(F.col("m.grp_a").alias("a"), F.col("grp_b").alias("b")), spark)
        if pairs.count() < WORTH * load["rows"]:
            # the last step takes these pairs too
            discard(tops, pairs)
            break
        parts = united(_links(pairs, open_sets, percent))
        before, table = table, settle(opened(table, parts), spark)
        discard(before, tops, pairs)
        sweep(spark)

    # all pairs of groups that are left: those outside a list's largest component with all others
    top = counted(table, "token").groupBy("token").agg(F.max(F.struct("m", "component")).alias("top")).select("token", F.col("top.component").alias("top"))
    now = table.join(top, "token").withColumn("outside", F.expr("low <> top OR high <> top")).drop("size", "top")
    others = side(now.filter("outside"), "a", "token").drop("outside_a")
    one_part = "(low_a = high_a AND low_b = high_b AND low_a = low_b)"
    asked = others.join(side(now, "b", "token"), "token").filter(f"(NOT outside_b OR grp_a <= grp_b) AND NOT {one_part} AND {can_link('a', 'b')} AND {alike('a', 'b')}")
    pairs = settle(asked.select("grp_a", "grp_b").distinct(), spark)
    # expanded to members
    own = member.join(parts.select(F.col("id").alias("node"), "component"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    full = pairs.join(side(own, "a"), "grp_a").join(side(own, "b"), "grp_b").filter(f"component_a <> component_b AND (grp_a <> grp_b OR node_a < node_b) AND {alike('a', 'b')}")
    last = settle(full.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")), spark)
    parts = united(_links(last, open_sets, percent))
    discard(table, pairs, last, open_sets)

    # a component is named by a node and a name that no set has, a set without links by its hashes
    named = nodes.select("node", "h1", "h2").join(parts.select(F.col("id").alias("node"), "component"), "node").select("h1", "h2", "component")
    out = rows.select("id", "th", "n", "h1", "h2").join(named, ["h1", "h2"], "left")
    out = settle(out.select("id", "th", "n", F.coalesce("component", "h1").alias("c1"), F.when(F.col("component").isNull(), F.col("h2").cast("string")).otherwise("").alias("c2")), spark)
    discard(rows, nodes, groups, parts)
    known.destroy()
    sweep(spark)
    return out


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs without near duplicates: of every component one row stays, and every row whose text has no words.

    That of the smallest id stays, a null id comes last, and of equal ids that of the smallest text hash.  Of rows with equal id
    and equal text, whatever else they hold, one stays.  All columns stay as they are.
    """
    placed = components(docs, id_col, text_col, k, percent)
    first = placed.filter("n > 0").groupBy("c1", "c2").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "th")).alias("m")).select("m.id", "m.th")
    none = placed.filter("n = 0").select("id", "th").distinct()
    names = docs.columns
    every = docs.toDF(*[f"c{i}" for i in range(len(names))])
    ident, text = f"c{names.index(id_col)}", f"c{names.index(text_col)}"
    key = [F.col(ident).cast("bigint").alias("_id"), F.xxhash64(F.col(text).cast("string")).alias("_th")]
    kept = every.select("*", *key).join(first.unionAll(none), F.col("_id").eqNullSafe(F.col("id")) & (F.col("_th") == F.col("th")), "left_semi")
    again = placed.filter("n > 0").groupBy("id", "th").count().filter("count > 1")
    if not again.alias("x").join(first.alias("y"), F.expr("x.id <=> y.id AND x.th = y.th"), "left_semi").isEmpty():
        wordless = F.col(text).isNull() | F.col(text).cast("string").rlike(r"\A[\x20\x09-\x0D]*\z")
        kept = kept.filter(~wordless).dropDuplicates(["_id", "_th"]).unionAll(kept.filter(wordless))
    return kept.drop("_id", "_th").toDF(*names)
