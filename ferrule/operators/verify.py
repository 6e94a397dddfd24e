"""Do two tables agree?  Counts, checksums, sampled and whole row hashes, orphans and range checks."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import Refused, Unverified

CLEAN, MISMATCH, UNVERIFIED = 0, 1, 2
SAMPLE, SEED = 100, 42


def canonical(name: str, kind: T.DataType) -> Column:
    """A column's text, the same on every side: floats so that they can be read back unchanged, UTC for instants, hex for bytes.

    Whoever compares floats to fewer digits casts them to a decimal first.
    """
    c = F.col("`" + name.replace("`", "``") + "`")
    if isinstance(kind, T.BinaryType):
        return F.lower(F.hex(c))
    if isinstance(kind, (T.ArrayType, T.StructType, T.MapType)):
        return F.to_json(c)
    return c.cast("string")


def row_hash(df: DataFrame, columns: list[str] | None = None, algorithm: str = "md5", tagged: bool = False) -> Column:
    """Hash of a row's columns joined by |, null as nothing; tagged: null has its own mark and every value its length, so no two rows collide by their text."""
    fields = {f.name: f.dataType for f in df.schema.fields}
    parts = []
    for name in columns or df.columns:
        text = canonical(name, fields[name])
        parts.append(F.coalesce(F.concat(F.char_length(text).cast("string"), F.lit(":"), text), F.lit("~")) if tagged else F.coalesce(text, F.lit("")))
    joined = F.concat_ws("|", *parts)
    if algorithm == "md5":
        return F.md5(joined)
    if algorithm == "sha256":
        return F.sha2(joined, 256)
    raise Refused(f"unknown hash {algorithm}")


def key_text(key: list[str]) -> Column:
    """A key's text: of one column the value's own, of several the parts with their lengths, so that no two keys have the same."""
    parts = [F.col("`" + k.replace("`", "``") + "`").cast("string") for k in key]
    if len(parts) == 1:
        return parts[0]
    return F.concat_ws("|", *[F.coalesce(F.concat(F.char_length(c).cast("string"), F.lit(":"), c), F.lit("~")) for c in parts])


def sample_hashes(df: DataFrame, key: list[str], n: int = SAMPLE, seed: int = SEED, algorithm: str = "md5", tagged: bool = False) -> DataFrame:
    """(pk, row_hash) of the n rows whose key and seed hash lowest: the same rows on both sides.  A top-n, not a sort."""
    if not key:
        raise Unverified("a table without a primary key cannot be sampled")
    picked = df.withColumn("_pk", key_text(key)).withColumn("_order", F.md5(F.concat(F.col("_pk"), F.lit(str(seed))))).orderBy("_order", "_pk").limit(n)
    return picked.select(F.col("_pk").alias("pk"), row_hash(df, algorithm=algorithm, tagged=tagged).alias("row_hash"))


def compare_hashes(source: DataFrame, target: DataFrame) -> DataFrame:
    """(pk, status) of keys that differ: only_source, only_target or differs."""
    s = source.select(F.col("pk").alias("x"), F.col("row_hash").alias("s"))
    t = target.select(F.col("pk").alias("y"), F.col("row_hash").alias("t"))
    status = F.when(F.col("t").isNull(), "only_source").when(F.col("s").isNull(), "only_target").otherwise("differs")
    return s.join(t, F.col("x").eqNullSafe(F.col("y")), "full_outer").filter(~F.col("s").eqNullSafe(F.col("t"))).select(F.coalesce("x", "y").alias("pk"), status.alias("status"))


def hashes(df: DataFrame, key: list[str], **options) -> DataFrame:
    """(pk, row_hash) of all rows."""
    if not key:
        raise Unverified("a table without a primary key has no rows to match")
    return df.select(key_text(key).alias("pk"), row_hash(df, **options).alias("row_hash"))


def diff(source: DataFrame, target: DataFrame, key: list[str], **options) -> DataFrame:
    """Every key whose row is missing, extra or different: one shuffle of keys and hashes."""
    return compare_hashes(hashes(source, key, **options), hashes(target, key, **options))


def bisect(source: DataFrame, target: DataFrame, key: list[str], buckets: int = 1024, **options) -> DataFrame:
    """As diff, but rows are matched only in the hash buckets whose sums differ; where little differs, little is shuffled."""
    def side(df: DataFrame) -> DataFrame:
        return hashes(df, key, **options).withColumn("bucket", F.pmod(F.xxhash64("pk"), F.lit(buckets)))

    def sums(df: DataFrame) -> DataFrame:
        return df.groupBy("bucket").agg(F.count("*").alias("n"), F.sum(F.xxhash64("pk", "row_hash").cast("decimal(20,0)")).alias("h"))

    s, t = side(source), side(target)
    a, b = sums(s), sums(t).toDF("bucket", "n2", "h2")
    # at most `buckets` rows
    uneven = a.join(b, "bucket", "full_outer").filter(~(F.col("n").eqNullSafe(F.col("n2")) & F.col("h").eqNullSafe(F.col("h2")))).select("bucket")
    uneven = F.broadcast(uneven)
    return compare_hashes(s.join(uneven, "bucket", "left_semi"), t.join(uneven, "bucket", "left_semi"))


def count(df: DataFrame, predicate: Column | None = None) -> int:
    return (df if predicate is None else df.filter(predicate)).count()


def chunked_count(df: DataFrame, key: str, chunk: int) -> DataFrame:
    """(chunk, n): rows per range of an integer key."""
    return df.groupBy(F.floor(F.col(key) / chunk).alias("chunk")).agg(F.count("*").alias("n"))


def checksum(df: DataFrame, name: str, ident: str, amount: str, label: str, flag: Column) -> DataFrame:
    """(name, checksum): count, sum of ids, exact sum of amounts, summed label lengths and rows with the flag, joined by colons."""
    parts = [F.count("*"), F.sum(F.col(ident)), F.sum(F.col(amount).cast("decimal(20,2)")).cast("decimal(38,2)"), F.sum(F.char_length(F.col(label)).cast("bigint")), F.count_if(flag)]
    return df.agg(*[p.cast("string").alias(f"p{i}") for i, p in enumerate(parts)]).select(F.lit(name).alias("name"), F.concat_ws(":", *[F.coalesce(f"p{i}", F.lit("0")) for i in range(5)]).alias("checksum"))


def combined_checksum(parts: list[DataFrame]) -> DataFrame:
    """MD5 of the tables' checksums in the order of their names."""
    every = parts[0]
    for p in parts[1:]:
        every = every.unionAll(p)
    rows = F.sort_array(F.collect_list(F.struct("name", "checksum")))  # one row per table
    return every.agg(F.md5(F.array_join(F.transform(rows, lambda r: F.concat(r["name"], F.lit("="), r["checksum"])), "|")).alias("checksum"))


def orphans(child: DataFrame, parent: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Child rows whose foreign key is complete and has no parent; a key with a null part refers to nothing."""
    present = child
    for c, _ in pairs:
        present = present.filter(F.col(c).isNotNull())
    keys = parent.select(*[F.col(p).alias(f"_p{i}") for i, (_, p) in enumerate(pairs)])
    on = [present[c] == keys[f"_p{i}"] for i, (c, _) in enumerate(pairs)]
    return present.join(keys, on, "left_anti")


def first_orphan(child: DataFrame, parent: DataFrame, pairs: list[tuple[str, str]]):
    """One violating row, or None; the scan stops at the first."""
    return orphans(child, parent, pairs).limit(1).first()


def not_boolean(df: DataFrame, column: str) -> DataFrame:
    """Rows whose value is neither 0, 1 nor null."""
    return df.filter(F.col(column).isNotNull() & ~F.col(column).isin(0, 1))


def colliding_keys(shards: list[DataFrame], key: list[str]) -> DataFrame:
    """Keys that stand in several shards: these tables cannot be merged without a discriminator."""
    every = None
    for i, s in enumerate(shards):
        part = s.select(*key, F.lit(i).alias("_shard"))
        every = part if every is None else every.unionByName(part)
    return every.groupBy(*key).agg(F.count_distinct("_shard").alias("shards")).filter("shards > 1")


def duplicate_keys(df: DataFrame, key: list[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")


@dataclass(frozen=True)
class Result:
    table: str
    status: str  # ok, mismatch, unverified
    detail: str = ""


def exit_code(results: list[Result]) -> int:
    """What could not be verified weighs more than a mismatch, and neither passes."""
    if any(r.status == "unverified" for r in results):
        return UNVERIFIED
    return MISMATCH if any(r.status == "mismatch" for r in results) else CLEAN


def run_summary(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, rows) of everything a run moved: one count per table, added up in one job."""
    every = None
    for name in sorted(tables):
        part = tables[name].agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows")
        every = part if every is None else every.unionAll(part)
    if every is None:
        raise Refused("a run without tables has no summary")
    return every


def verify(source: dict[str, DataFrame], target: dict[str, DataFrame], keys: dict[str, list[str]], mode: str = "count", n: int = SAMPLE, seed: int = SEED, filters: dict[str, Column] | None = None) -> list[Result]:
    """Every table of either side: counts, a sample of row hashes, or a full diff."""
    if mode not in ("count", "sample", "full"):
        raise Refused(f"unknown mode {mode}")
    out = []
    for name in sorted({*source, *target}):
        if name not in target or name not in source:
            out.append(Result(name, "mismatch", "missing on target" if name in source else "extra on target"))
            continue
        a, b = source[name], target[name]
        if filters and name in filters:
            a, b = a.filter(filters[name]), b.filter(filters[name])
        if mode == "count":
            x, y = a.count(), b.count()
            out.append(Result(name, "ok" if x == y else "mismatch", f"{x} and {y} rows"))
        elif not keys.get(name):
            out.append(Result(name, "unverified", "no primary key"))
        elif sorted(a.columns) != sorted(b.columns):
            out.append(Result(name, "mismatch", "different columns"))
        else:
            b = b.select(*a.columns)
            key = keys[name]
            found = compare_hashes(sample_hashes(a, key, n, seed, tagged=True), sample_hashes(b, key, n, seed, tagged=True)) if mode == "sample" else diff(a, b, key, tagged=True)
            rows = found.groupBy("status").count().orderBy("status").collect()
            out.append(Result(name, "mismatch" if rows else "ok", ", ".join(f"{r['count']} {r['status']}" for r in rows)))
    return out


def report(results: list[Result]) -> str:
    width = max((len(r.table) for r in results), default=0)
    return "\n".join(f"{r.table.ljust(width)}  {r.status:<10}  {r.detail}".rstrip() for r in results)


def clamp_chunks(rows: int, threshold: int, parallelism: int, budget: int) -> int:
    """How many chunks a table is read in."""
    if threshold < 1:
        raise Refused("the threshold must be positive")
    return max(1, min(max(math.ceil(rows / threshold), max(parallelism, 2)), max(64, budget)))
