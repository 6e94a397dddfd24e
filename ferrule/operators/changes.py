"""Change streams as tables: apply, filter, compact, delay, prune.

A change is (seq, op, table, before, after, present, commit_ts): op is I, U, D, T (truncate), C (commit) or S (schema); before
and after are structs of the table's columns; present lists the columns that after carries, so that an absent column (unchanged)
differs from a null one (set to null).  seq orders all changes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import Refused
from ..functions import dialect


def schema(row: T.StructType) -> T.StructType:
    return T.StructType([T.StructField("seq", T.LongType(), False), T.StructField("op", T.StringType(), False), T.StructField("table", T.StringType()), T.StructField("before", row), T.StructField("after", row), T.StructField("present", T.ArrayType(T.StringType())), T.StructField("commit_ts", T.TimestampNTZType())])


def columns(changes: DataFrame) -> list[str]:
    return changes.schema["after"].dataType.fieldNames()


def same_key(key: list[str]) -> Column:
    """Whether before and after have the same key; one missing image counts as the same."""
    out = F.lit(True)
    for k in key:
        out = out & F.col(f"before.{k}").eqNullSafe(F.col(f"after.{k}"))
    return out | F.col("before").isNull() | F.col("after").isNull()


def split_rekeyed(changes: DataFrame, key: list[str]) -> DataFrame:
    """Updates that change the key become the deletion of the old key and the insertion of the new one, in that order; sub orders the two.

    The insertion takes columns that the update left out from the old row.
    """
    names = columns(changes)
    moved = (F.col("op") == "U") & ~same_key(key)
    filled = F.struct(*[F.when(F.array_contains("present", c) | F.col("present").isNull(), F.col(f"after.{c}")).otherwise(F.col(f"before.{c}")).alias(c) for c in names])
    kind = changes.schema["after"].dataType
    every = F.array(*[F.lit(c) for c in names])
    delete = F.struct(F.lit(0).alias("sub"), F.lit("D").alias("op"), F.col("before"), F.lit(None).cast(kind).alias("after"), F.lit(None).cast("array<string>").alias("present"))
    insert = F.struct(F.lit(1).alias("sub"), F.lit("I").alias("op"), F.lit(None).cast(kind).alias("before"), filled.alias("after"), every.alias("present"))
    same = F.struct(F.lit(0).alias("sub"), F.col("op"), F.col("before"), F.col("after"), F.col("present"))
    parts = F.when(moved, F.array(delete, insert)).otherwise(F.array(same))
    rest = [c for c in changes.columns if c not in ("op", "before", "after", "present", "sub")]
    return changes.select(*rest, F.explode(parts).alias("_c")).select(*rest, "_c.sub", "_c.op", "_c.before", "_c.after", "_c.present")


def row_moves(changes: DataFrame, before_matches: Column, after_matches: Column) -> DataFrame:
    """Only the rows of a filter: an update into it is an insertion, one out of it a deletion, others are dropped or kept.

    The conditions speak of before.* and after.*; unknown counts as no match.  Updates and deletions need their old rows.
    """
    old, new = F.coalesce(before_matches, F.lit(False)), F.coalesce(after_matches, F.lit(False))
    op = F.when(~F.col("op").isin("I", "U", "D"), F.col("op")).when(F.col("op") == "I", F.when(new, "I")).when(F.col("op") == "D", F.when(old, "D")).when(old & new, "U").when(new, "I").when(old, "D")
    return changes.withColumn("op", op).filter(F.col("op").isNotNull())


def require_before(changes: DataFrame) -> DataFrame:
    """Fails on an update or deletion without its old row."""
    missing = F.col("op").isin("U", "D") & F.col("before").isNull()
    return changes.withColumn("op", F.when(missing, F.raise_error(F.concat(F.lit("change "), F.col("seq").cast("string"), F.lit(" has no old row")))).otherwise(F.col("op")))


def barriers(changes: DataFrame) -> DataFrame:
    """changes with segment: how many truncations and schema changes of its table came up to it.

    These are few, so each table's are listed and counted per row; a window over a table would put all its rows into one task.
    """
    sub = F.col("sub") if "sub" in changes.columns else F.lit(0)
    at = F.struct(F.col("seq").alias("seq"), sub.alias("sub"))
    marks = changes.filter(F.col("op").isin("T", "S")).groupBy("table").agg(F.collect_list(at).alias("_marks"))
    passed = F.filter("_marks", lambda m: m <= at)
    return changes.join(marks, "table", "left").withColumn("segment", F.coalesce(F.size(passed), F.lit(0)).cast("bigint")).drop("_marks")


def _folded(changes: DataFrame, key: list[str], by: list) -> DataFrame:
    """One row per key with what its changes come to.

    Per column the last value that was present counts, but none from before the last deletion; all are partial aggregates, so a
    hot key shrinks before the shuffle.
    """
    names = columns(changes)
    order = F.struct("seq", "sub")
    image = F.coalesce("after", "before")
    keyed = changes.select("*", *[image[k].alias(f"_k_{k}") for k in key], order.alias("_at"))
    has = lambda c: (F.col("op") != "D") & (F.col("present").isNull() | F.array_contains("present", c))
    # a deletion writes every column as gone, so that the newest entry of each column tells value or absence
    values = [F.max_by(F.struct(F.when(F.col("op") != "D", F.col(f"after.{c}")).alias("v"), (F.col("op") != "D").alias("there")), F.when(has(c) | (F.col("op") == "D"), F.col("_at"))).alias(f"_v_{c}") for c in names]
    return keyed.groupBy(*by, *[f"_k_{k}" for k in key]).agg(
        F.max("_at").alias("last"), F.min_by("op", "_at").alias("first_op"), F.max_by("op", "_at").alias("last_op"),
        F.max(F.when(F.col("op") == "D", F.col("_at"))).alias("deleted"), F.max(F.when(F.col("op") == "I", F.col("_at"))).alias("inserted"),
        F.min_by("before", "_at").alias("first_before"), F.max_by("commit_ts", "_at").alias("commit_ts"), *values,
    )


def compact(changes: DataFrame, key: list[str]) -> DataFrame:
    """The fewest changes with the same effect: per key and segment between barriers one change, or none.

    Insert then update is an insert of the merged row, updates merge, anything then delete is a delete, but insert then delete is
    nothing; a row that is deleted and inserted again is an insert, which replaces what is there.  Tables without a key pass.
    Barriers and commits keep their places.
    """
    if not key:
        return changes
    names = columns(changes)
    parts = split_rekeyed(changes, key)
    marked = barriers(parts)
    data, rest = marked.filter(F.col("op").isin("I", "U", "D")), marked.filter(~F.col("op").isin("I", "U", "D"))
    f = _folded(data, key, ["table", "segment"])
    was_there = F.col("first_op") != "I"
    # an update behind a deletion changes nothing
    born = F.col("inserted").isNotNull() & (F.col("deleted").isNull() | (F.col("inserted") > F.col("deleted")))
    ends_alive = born | F.col("deleted").isNull()
    op = F.when(born, "I").when(ends_alive, "U").when(was_there, "D")
    after = F.when(ends_alive, F.struct(*[F.when(F.col(f"_v_{c}.there"), F.col(f"_v_{c}.v")).alias(c) for c in names]))
    carried = F.filter(F.array(*[F.when(born | F.coalesce(F.col(f"_v_{c}.there"), F.lit(False)), F.lit(c)) for c in names]), lambda x: x.isNotNull())
    kind = changes.schema["after"].dataType
    out = f.select(F.col("last.seq").alias("seq"), F.col("last.sub").alias("sub"), op.alias("op"), "table", F.when(was_there, F.col("first_before")).otherwise(F.lit(None).cast(kind)).alias("before"), after.cast(kind).alias("after"), F.when(ends_alive, carried).alias("present"), "commit_ts").filter(F.col("op").isNotNull())
    keep = rest.select("seq", "sub", "op", "table", "before", "after", "present", "commit_ts")
    return out.unionByName(keep)


def last_wins(rows: DataFrame, key: list[str], *order: str) -> DataFrame:
    """The newest row per key: a maximum, which combines before the shuffle, instead of a window."""
    rest = [c for c in rows.columns if c not in key]
    newest = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return newest.select(*key, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*rows.columns)


def apply(base: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """The table after its changes, in the order of seq: inserts upsert, updates and deletions of rows that are not there do nothing.

    The state of a key is the fold of its own changes behind the last truncation, laid over its old row.
    """
    if not key:
        raise Refused("a table without a key cannot take changes twice without harm")
    names = base.columns
    if missing := [k for k in key if k not in names]:
        raise Refused(f"no key columns {missing}")
    parts = split_rekeyed(changes, key)
    marks = parts.filter("op = 'T'").agg(F.max("seq").alias("cut"))  # one row
    cut = F.broadcast(marks)
    data = parts.filter(F.col("op").isin("I", "U", "D")).join(cut, F.lit(True)).filter(F.col("cut").isNull() | (F.col("seq") > F.col("cut"))).drop("cut")
    f = _folded(data.withColumn("segment", F.lit(0)), key, ["segment"])
    old = base.join(cut, F.lit(True)).filter(F.col("cut").isNull()).select(F.struct(*names).alias("_old"), *[F.col(k).alias(f"_k_{k}") for k in key])
    on = [old[f"_k_{k}"].eqNullSafe(f[f"_k_{k}"]) for k in key]
    joined = old.join(f.drop("segment"), on, "full_outer")
    # a row is there if it was inserted last of all, or was there and is not deleted
    gone = F.coalesce(F.col("last_op") == "D", F.lit(False))
    fresh = F.col("deleted").isNotNull() | F.col("_old").isNull()
    # an update behind a deletion, or of a row that never was, does nothing
    behind = F.col("inserted").isNotNull() & (F.col("deleted").isNull() | (F.col("inserted") > F.col("deleted")))
    there = F.when(fresh, F.coalesce(behind, F.lit(False))).otherwise(F.lit(True))
    values = [F.when(F.coalesce(F.col(f"_v_{c}.there"), F.lit(False)), F.col(f"_v_{c}.v")).when(~F.coalesce(fresh, F.lit(False)), F.col(f"_old.{c}")).alias(c) for c in names]
    return joined.filter(~gone & there).select(*values)


def delayed(changes: DataFrame, now, delay: str) -> DataFrame:
    """The changes that are at least the delay old; those of unknown age are due."""
    return changes.filter(F.col("commit_ts").isNull() | (F.col("commit_ts") <= F.lit(now).cast("timestamp_ntz") - F.expr(f"INTERVAL {delay}")))


def lag(changes: DataFrame, now, delay: str = "0 seconds", idle: str = "30 seconds") -> DataFrame:
    """(lag_seconds): how far behind the newest change is, less the wanted delay and never negative; null if nothing came for `idle`."""
    newest = F.max("commit_ts")
    behind = F.greatest(F.lit(0.0), F.unix_micros((F.lit(now).cast("timestamp_ntz") - F.expr(f"INTERVAL {delay}")).cast("timestamp")) / 1e6 - F.unix_micros(newest.cast("timestamp")) / 1e6)
    fresh = newest >= F.lit(now).cast("timestamp_ntz") - F.expr(f"INTERVAL {idle}") - F.expr(f"INTERVAL {delay}")
    return changes.agg(F.when(fresh, behind).alias("lag_seconds"))


def contiguous(seqs: DataFrame, last: int, column: str = "seq") -> DataFrame:
    """(frontier): the end of the run of numbers without a hole that begins behind `last`; `last` itself if the next is missing.

    The number before the first hole is the smallest n whose successor is missing; a join with the successors finds it without
    ordering everything in one task.
    """
    n = seqs.select(F.col(column).alias("n")).filter(F.col("n") > last).distinct()
    ahead = n.select((F.col("n") - 1).alias("n"))
    ends = n.join(ahead, "n", "left_anti").agg(F.min("n").alias("end"))
    first = n.agg(F.min("n").alias("first"))
    return ends.crossJoin(first).select(F.when(F.col("first") == last + 1, F.col("end")).otherwise(F.lit(last)).cast("bigint").alias("frontier"))


def checkpoint(changes: DataFrame, frontier: int) -> DataFrame:
    """(seq): the last commit at or before the frontier."""
    return changes.filter((F.col("op") == "C") & (F.col("seq") <= frontier)).agg(F.max("seq").alias("seq"))


def prune_bound(frontier: int, consumers: DataFrame, margin: int) -> int:
    """Up to where a change log may be deleted: the least of the durable frontier and all consumers, less a margin."""
    low = consumers.agg(F.min("frontier")).first()[0]
    return min(frontier, low if low is not None else frontier) - margin


def prune(log: DataFrame, bound: int, column: str = "id") -> DataFrame:
    return log.filter(F.col(column) > bound)


def version_at(changes: DataFrame, history: DataFrame) -> DataFrame:
    """changes with version: that of the last schema entry of its table at or before it.  The entries of a table are few."""
    entries = history.groupBy("table").agg(F.sort_array(F.collect_list(F.struct("anchor", "version")), asc=False).alias("_h"))
    hit = F.filter("_h", lambda h: h["anchor"] <= F.col("seq"))
    return changes.join(entries, "table", "left").withColumn("version", F.get(hit, F.lit(0))["version"]).drop("_h")


def capture(old: Column, new: Column, names: list[str], key: list[str], mode: str) -> tuple[Column, Column, Column]:
    """(before, after, present) of an update as a change log keeps it: full rows, the key and changed columns, or with the key alone as the old row."""
    changed = F.filter(F.array(*[F.when(F.lit(c in key) | ~old[c].eqNullSafe(new[c]), F.lit(c)) for c in names]), lambda x: x.isNotNull())
    if mode == "full":
        return old, new, F.array(*[F.lit(c) for c in names])
    after = F.struct(*[F.when(F.array_contains(changed, c), new[c]).alias(c) for c in names])
    if mode == "changed":
        return old, after, changed
    if mode == "minimal":
        return F.struct(*[(old[c] if c in key else F.when(F.lit(False), old[c])).alias(c) for c in names]), after, changed
    raise Refused(f"unknown capture mode {mode}")


def in_scope(changes: DataFrame, tables: set[str], added: set[str] = frozenset()) -> DataFrame:
    """The changes of the tables in scope; added ones extend it without touching the base set."""
    return changes.filter(F.col("table").isin(*sorted({*tables, *added})))


#: Positions of a log that are numbered by one task at least, and the most such pieces.
PIECE, MOST_PIECES = 1 << 16, 100_000


def transaction_batches(changes: DataFrame, rows: int) -> DataFrame:
    """changes with batch: whole transactions, each ended by its commit (op C), in batches of `rows` rows besides the last transaction's.

    A transaction belongs to the batch in which its first row lies.  Rows behind the last commit have no batch yet (null): their
    transaction is not over.  The log is numbered piece by piece, by ranges of seq, and what lies before a piece is a sum over
    at most MOST_PIECES rows, so that no task sees the whole log.
    """
    if rows < 1:
        raise Refused("a batch holds at least one row")
    sub = F.col("sub") if "sub" in changes.columns else F.lit(0)
    ends = changes.agg(F.min("seq").alias("low"), F.max("seq").alias("high"), F.max(F.when(F.col("op") == "C", F.col("seq"))).alias("end")).first()
    if ends["end"] is None:
        return changes.withColumn("batch", F.lit(None).cast("bigint"))
    width = max(PIECE, (ends["high"] - ends["low"]) // MOST_PIECES + 1)
    done = changes.withColumn("_piece", F.expr(f"(seq - {ends['low']}) div {width}"))
    inside = Window.partitionBy("_piece").orderBy(F.col("seq"), sub)
    numbered = done.withColumn("_n", F.row_number().over(inside))
    last_commit = F.max(F.when(F.col("op") == "C", F.col("_n")))
    sizes = numbered.groupBy("_piece").agg(F.max("_n").alias("_size"), last_commit.alias("_commit"))
    earlier = Window.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(earlier), F.lit(0)))
    # the place of the last commit before a piece
    sizes = sizes.withColumn("_carry", F.coalesce(F.max(F.col("_before") + F.col("_commit")).over(earlier), F.lit(0))).select("_piece", "_before", "_carry")
    previous = last_commit.over(inside.rowsBetween(Window.unboundedPreceding, -1))
    start = F.coalesce(F.col("_before") + F.col("_previous"), F.col("_carry"))
    placed = numbered.withColumn("_previous", previous).join(F.broadcast(sizes), "_piece")
    return placed.withColumn("batch", F.when(F.col("seq") <= ends["end"], F.floor(start / rows).cast("bigint"))).drop("_piece", "_n", "_previous", "_before", "_carry")


def add_column(base: DataFrame, name: str, kind: str, default: str | None = None, source: str = "postgres", mode: str = "forward") -> DataFrame:
    """The table after ADD COLUMN on its source; every row gets the default.

    Refused are: mode "refuse", a default that may give another value for each row or at another time, and a column that is there
    with another type.  One that is there with this type has been forwarded before and stays.
    """
    if mode not in ("forward", "refuse"):
        raise Refused(f"unknown mode {mode}")
    if mode == "refuse":
        raise Refused(f"changes of the schema are refused: column {name}")
    there = {c.lower(): f for c, f in zip(base.columns, base.schema.fields, strict=True)}
    if found := there.get(name.lower()):
        if found.dataType != base.select(F.lit(None).cast(kind).alias("c")).schema["c"].dataType:
            raise Refused(f"column {name} is there with type {found.dataType.simpleString()}")
        return base
    if default is not None and dialect.is_volatile(default):
        raise Refused(f"the default of {name} may give another value each time: {default}")
    value = F.lit(None) if default is None else F.expr(dialect.translate(default, source))
    return base.withColumn(name, value.cast(kind))
