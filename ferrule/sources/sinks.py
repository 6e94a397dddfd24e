"""Writers: faithful Parquet export, upserts, chunked change logs, and the guard of a backup chain."""

from __future__ import annotations

import json
import re
from collections import deque

from pyspark import InheritableThread
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..catalog import Table
from ..errors import Refused
from ..operators import changes as changes_ops
from ..operators.chunks import next_bound
from ..types import exact
from .paths import open_path


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = open_path(spark, path)
    return fs.exists(p)


def write_text(spark: SparkSession, path: str, text: str, overwrite: bool = False) -> None:
    """Creates a small file in whatever store the path names; without overwrite, an existing one is an error, which makes it a lock."""
    p, fs = open_path(spark, path)
    try:
        out = fs.create(p, overwrite)
    except Exception as e:
        if overwrite or not fs.exists(p):
            raise
        raise Refused(f"{path} exists already") from e
    out.write(bytearray(text.encode()))
    out.close()


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()["value"]


def typed(df: DataFrame, table: Table) -> DataFrame:
    """The table's columns in its exact types; a value that does not fit stops the job."""
    return df.select(*[exact(F.col(f"`{c.name}`"), c.type).alias(c.name, metadata={"kind": c.type.kind, "key": c.name in table.key}) for c in table.columns if not c.generated])


def export(spark: SparkSession, tables: dict[str, tuple[DataFrame, Table]], path: str) -> dict:
    """Every table as zstd Parquet under path, and parquet_index.json last: with it the export is complete, and a second one is refused.

    The footers hold each column's kind; rows are counted while they are written.
    """
    if exists(spark, f"{path}/parquet_index.json"):
        raise Refused(f"{path} holds a complete export")
    index = {"tables": {}}
    for name, (df, table) in sorted(tables.items()):
        seen = Observation()
        typed(df, table).observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(f"{path}/{name}", compression="zstd")
        rows = seen.get["rows"]
        index["tables"][name] = {"rows": rows, "columns": [{"name": c.name, "kind": c.type.kind, "nullable": c.nullable} for c in table.columns if not c.generated], "key": list(table.key)}
    write_text(spark, f"{path}/parquet_index.json", json.dumps(index, sort_keys=True))
    return index


def upsert(base: DataFrame, rows: DataFrame, key: tuple[str, ...], order: str | None = None) -> DataFrame:
    """The table after writing rows by key: the newest of equal keys wins.  Without a key it is refused."""
    if not key:
        raise Refused("rows without a key cannot be upserted")
    new = rows
    if order:
        new = changes_ops.last_wins(rows, list(key), order).drop(*([order] if order not in base.columns else []))
    on = [base[k].eqNullSafe(new[k]) for k in key]
    return base.join(new.select(*key), on, "left_anti").unionByName(new.select(*base.columns))


def append(df: DataFrame, path: str, rows_per_file: int | None = None) -> None:
    w = df.write.mode("append")
    (w.option("maxRecordsPerFile", rows_per_file) if rows_per_file else w).parquet(path, compression="zstd")


def replace(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path, compression="zstd")


def rows_per_statement(row_bytes: float, columns: int, target: int = 1 << 20, most_parameters: int = 60_000) -> int:
    """How many rows one INSERT takes: about 1 MiB of values and at most 60,000 bound parameters."""
    return max(1, min(int(target / max(row_bytes, 1.0)), most_parameters // max(columns, 1)))


def write_jdbc(df: DataFrame, url: str, table: str, row_bytes: float = 256.0, parallel: int = 8, truncate: bool = False, **options: str) -> None:
    """Appends to a table of a database, or replaces its rows, with at most `parallel` connections and batched INSERTs."""
    if parallel < 1:
        raise Refused("at least one connection")
    w = df.coalesce(parallel).write.mode("overwrite" if truncate else "append")
    for k, v in {"batchsize": str(rows_per_statement(row_bytes, len(df.columns))), "truncate": str(truncate).lower(), **options}.items():
        w = w.option(k, v)
    w.jdbc(url, table)


def copy_pages(df: DataFrame, key: str, rows: int, path: str, most_pages: int | None = None) -> int:
    """Copies a table in pages by an integer or text key, unique and without nulls; returns how many pages were written now.

    Behind each page its last key is stored, and a copy that was broken off goes on behind the last stored one: a page without
    its mark is written again.  Stored keys are only trusted for the same key and columns.
    """
    if df.schema[key].dataType.typeName() not in ("byte", "short", "integer", "long", "string"):
        raise Refused(f"a {df.schema[key].dataType.simpleString()} is no key to go on from")
    spark, shape = df.sparkSession, {"key": key, "columns": df.schema.simpleString()}
    mark = lambda k: f"{path}/page-{k:08d}.json"
    n, cursor, written = 0, None, 0
    while exists(spark, mark(n + 1)):
        n += 1
    if n:
        stored = json.loads(read_text(spark, mark(n)))
        if {k: stored[k] for k in shape} != shape:
            raise Refused(f"{path} was begun with another key or other columns")
        cursor = stored["cursor"]
    while most_pages is None or written < most_pages:
        bound = next_bound(df, key, cursor, rows)
        if bound is None:
            break
        part = df.filter(F.col(key) <= F.lit(bound)) if cursor is None else df.filter((F.col(key) > F.lit(cursor)) & (F.col(key) <= F.lit(bound)))
        replace(part, f"{path}/rows/page={n + 1}")
        write_text(spark, mark(n + 1), json.dumps({**shape, "cursor": bound}))
        n, cursor, written = n + 1, bound, written + 1
    return written


def copy_tables(tables: dict[str, DataFrame], path: str, at_once: int = 4) -> dict[str, int]:
    """Copies tables under path, `at_once` of them side by side, and returns the rows of each.

    The tables share the cluster's tasks by its scheduler.  If one fails, no further one is begun, and its error is raised when
    those under way have ended; those written stay.
    """
    if at_once < 1:
        raise Refused("at least one table at a time")
    left, rows, errors = deque(sorted(tables)), {}, []

    def work() -> None:
        while not errors:
            try:
                name = left.popleft()
            except IndexError:
                return
            try:
                seen = Observation()
                replace(tables[name].observe(seen, F.count(F.lit(1)).alias("rows")), f"{path}/{name}")
                rows[name] = seen.get["rows"]
            except Exception as e:
                errors.append(e)

    pool = [InheritableThread(target=work) for _ in range(min(at_once, len(tables)))]
    for t in pool:
        t.start()
    for t in pool:
        t.join()
    if errors:
        raise errors[0]
    return rows


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/rows").drop("page")


#: How many changes share a folder of a rolled log, if its generations are smaller.
FOLDER_ROWS = 1 << 18


def rollover(changes: DataFrame, path: str, rows: int) -> DataFrame:
    """Writes the finished transactions of a log as generations of about `rows` changes: (generation, first_seq, last_seq, rows), a row each.

    Small generations share a folder, `_span` being generation div (FOLDER_ROWS // rows), and lie there in the log's order, so that
    folders and files, which are listed and committed one by one, grow with the log and not with how finely it is cut.
    """
    done = changes_ops.transaction_batches(changes, rows).filter("batch IS NOT NULL").withColumnRenamed("batch", "generation")
    spans = done.withColumn("_span", F.expr(f"generation div {max(1, FOLDER_ROWS // rows)}"))
    order = ["_span", "seq", *(["sub"] if "sub" in changes.columns else [])]
    spans.repartition("_span").sortWithinPartitions(*order).write.mode("errorifexists").partitionBy("_span").option("ignoreNullFields", "false").json(path, compression="gzip")
    written = changes.sparkSession.read.schema(done.select("seq", "generation").schema).json(path)
    return written.groupBy("generation").agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count("*").alias("rows"))


class MaterialisedView:
    """The stored rows of a query.  A refresh writes a new version and switches to it by one small file; the one before stays for its readers."""

    def __init__(self, spark: SparkSession, path: str, key: tuple[str, ...] = ()):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key

    def _version(self) -> int:
        n = 0
        while exists(self.spark, f"{self.path}/current-{n + 1:08d}.json"):
            n += 1
        return n

    def read(self) -> DataFrame:
        n = self._version()
        if not n:
            raise Refused(f"{self.path} was never refreshed")
        return self.spark.read.parquet(f"{self.path}/v-{n:08d}")

    def refresh(self, rows: DataFrame, concurrently: bool = False) -> int:
        """Returns the new version.  Concurrent refreshes need a key that is there, unique and never null in what was written."""
        if concurrently and not self.key:
            raise Refused("a concurrent refresh needs a unique key")
        n = self._version() + 1
        replace(rows, f"{self.path}/v-{n:08d}")
        if self.key:
            new = self.spark.read.parquet(f"{self.path}/v-{n:08d}")
            bad = new.groupBy(*self.key).count().filter(" OR ".join(["count > 1", *[f"`{k}` IS NULL" for k in self.key]]))
            if not bad.isEmpty():
                raise Refused(f"{', '.join(self.key)} does not tell the rows of {self.path} apart")
        write_text(self.spark, f"{self.path}/current-{n:08d}.json", json.dumps({"version": n}))
        if n > 2:
            old, fs = open_path(self.spark, f"{self.path}/v-{n - 2:08d}")
            fs.delete(old, True)
        return n


def rows_per_file(df_row_bytes: float, target: int = 128 << 20) -> int:
    """How many rows of a size make a file of the target size."""
    return max(1, int(target / max(df_row_bytes, 1.0)))


def write_chunks(df: DataFrame, path: str, codec: str = "gzip") -> None:
    """Row chunks of a backup as JSON lines; nulls are written."""
    if codec not in ("none", "gzip", "zstd"):
        raise Refused(f"unknown codec {codec}")
    df.write.mode("errorifexists").option("ignoreNullFields", "false").json(path, compression=codec)


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path below the given one, length, sha256) of the files of a backup, for comparison with its manifest."""
    p, fs = open_path(spark, path)
    root = fs.makeQualified(p).toString().rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.regexp_replace("path", F.lit("^.*?" + re.escape(root.partition(":")[2].lstrip("/"))), F.lit("")).alias("path"), "length", F.sha2("content", 256).alias("sha256"))


def verify_backup(spark: SparkSession, path: str, expected: dict[str, str], schema: T.StructType | None = None, depth: str = "hash") -> list[str]:
    """What is wrong with a backup's files: missing, extra, changed, or (depth rows) unreadable."""
    if depth not in ("manifest", "hash", "rows"):
        raise Refused(f"unknown depth {depth}")
    have = {r["path"]: r["sha256"] for r in file_digests(spark, path).collect()} if depth != "manifest" else dict.fromkeys(expected)
    out = [f"missing {n}" for n in sorted(set(expected) - set(have))] + [f"extra {n}" for n in sorted(set(have) - set(expected))]
    if depth != "manifest":
        out += [f"changed {n}" for n in sorted(set(have) & set(expected)) if have[n] != expected[n]]
    if depth == "rows" and not out and schema is not None:
        try:
            spark.read.schema(schema).option("mode", "FAILFAST").json(path).foreach(lambda r: None)
        except Exception as e:
            out.append(f"unreadable: {str(e).splitlines()[0][:200]}")
    return out


class Chain:
    """A chain of backups whose writers exclude one another: the next generation's marker is created once, and only on the tip."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def tip(self) -> tuple[int, str | None]:
        n, last = 0, None
        while exists(self.spark, f"{self.path}/gen-{n + 1:08d}.json"):
            n += 1
            last = json.loads(read_text(self.spark, f"{self.path}/gen-{n:08d}.json"))["id"]
        return n, last

    def extend(self, backup: str, parent: str | None) -> int:
        n, last = self.tip()
        if parent != last:
            raise Refused(f"{backup} extends {parent}, but the tip is {last}")
        write_text(self.spark, f"{self.path}/gen-{n + 1:08d}.json", json.dumps({"id": backup, "parent": parent}))
        return n + 1


def write_samples(samples: DataFrame, path: str) -> None:
    """Telemetry samples as JSON lines, appended."""
    samples.write.mode("append").json(path)


def identity_copy(spark: SparkSession, source: str, target: str) -> int:
    """Copies files byte for byte, for a table that nothing transforms; returns how many."""
    p, fs = open_path(spark, source)
    q, gs = open_path(spark, target)
    gs.mkdirs(q)
    names = [s.getPath() for s in fs.listStatus(p) if s.isFile()]
    for one in names:
        spark.sparkContext._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, one, gs, q, False, spark.sparkContext._jsc.hadoopConfiguration())
    return len(names)
