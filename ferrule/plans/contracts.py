"""Queries of what the engine must refuse, choose or keep in order, each beside what the accepted cases do to whole tables.

A refused case keeps no row: where a query counts, its count is null.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import catalog as cat
from .. import types as typ
from ..errors import Refused
from ..functions import dialect, predicate, redact
from ..operators import verify
from ..sources import files, sinks, tables
from .catalogue import KEY, _entry_sql, _hmac_sql, load, query, scratch


def accepted(work: Callable[[], DataFrame]) -> DataFrame | None:
    try:
        return work()
    except Refused:
        return None


def counted(spark, cases: list[Callable[[], DataFrame]]) -> DataFrame:
    """(n, kept): how many rows each case keeps, null if it is refused."""
    out = None
    for n, work in enumerate(cases):
        found = accepted(work)
        kept = spark.createDataFrame([(None,)], "kept bigint") if found is None else found.agg(F.count("*").alias("kept"))
        part = kept.select(F.lit(n).alias("n"), "kept")
        out = part if out is None else out.unionAll(part)
    return out


def counted_sql(cases: list[str | None]) -> str:
    """The same of SELECTs; None is a refusal."""
    return " UNION ALL ".join(f"SELECT {n} AS n, " + ("NULL::BIGINT AS kept" if sql is None else f"count(*) AS kept FROM ({sql})") for n, sql in enumerate(cases))


def _filters(name: str, table: str, cases: list[tuple[str, predicate.Rules, dict, str | None]], columns: str = "*", sql_columns: str | None = None) -> None:
    """Filters of a table with what is known of its columns; the last of each case is the same filter in SQL, None if it is refused."""
    @query(name, counted_sql([None if sql is None else f"SELECT * FROM (SELECT {sql_columns or columns} FROM {table}) WHERE {sql}" for *_, sql in cases]))
    def run(spark, d):
        rows = load(spark, d, table).selectExpr(*columns.split(" ; "))
        return counted(spark, [lambda c=c: predicate.where(rows, c[0], c[1], **{k: predicate.Col(rows.schema[k].dataType, **v) for k, v in c[2].items()}) for c in cases])


_ANY, _STRICT = predicate.Rules(), predicate.Rules(strict_collation=True)

# ---------------------------------------------------------------------------
# Predicates

_filters("p10_collation_refusals", "customer", [
    ("c_mktsegment = 'BUILDING'", _ANY, {"c_mktsegment": {"collation": "utf8mb4_bin", "charset": "utf8mb4"}}, "c_mktsegment = 'BUILDING'"),
    ("c_mktsegment = 'BUILDING'", _ANY, {"c_mktsegment": {"charset": "latin1"}}, None),
    ("c_mktsegment = 'BUILDING'", _ANY, {"c_mktsegment": {"collation": "de_DE.utf8"}}, None),
    ("c_mktsegment = 'building'", _ANY, {"c_mktsegment": {"collation": "utf8mb4_0900_ai_ci"}}, "lower(c_mktsegment) = 'building'"),
    ("c_mktsegment > 'C'", _ANY, {"c_mktsegment": {"collation": "utf8mb4_0900_ai_ci"}}, None),
    ("c_mktsegment > 'C'", _ANY, {"c_mktsegment": {"collation": "C"}}, "c_mktsegment > 'C'"),
    ("c_mktsegment IS NOT NULL", _ANY, {"c_mktsegment": {"collation": "de_DE.utf8"}}, "true"),
])
_filters("p11_strict_collation", "orders", [
    ("o_orderpriority IN ('1-URGENT', '2-HIGH')", _STRICT, {}, "o_orderpriority IN ('1-URGENT', '2-HIGH')"),
    ("o_orderpriority = '1-urgent'", _STRICT, {"o_orderpriority": {"collation": "utf8mb4_general_ci"}}, None),
    ("o_orderpriority = '1-urgent'", _ANY, {"o_orderpriority": {"collation": "utf8mb4_general_ci"}}, "lower(o_orderpriority) = '1-urgent'"),
    ("o_orderpriority = '2-HIGH'", _STRICT, {"o_orderpriority": {"collation": "utf8mb4_0900_bin"}}, "o_orderpriority = '2-HIGH'"),
    ("o_orderstatus <> 'F' AND o_custkey > 100", _STRICT, {"o_orderstatus": {"collation": "POSIX"}}, "o_orderstatus <> 'F' AND o_custkey > 100"),
])
_filters("p15_finer_literals", "orders", [
    ("day <= '1996-06-30'", _ANY, {}, "day <= DATE '1996-06-30'"),
    ("day <= '1996-06-30 12:00:00'", _ANY, {}, None),
    ("day < '1996-06-30 12:00:00'", predicate.Rules(lens="cast"), {}, "day < DATE '1996-06-30'"),
    ("day < '1996-06-30 12:00:00'", predicate.Rules(lens="truncate"), {}, "day <= DATE '1996-06-30'"),
    ("stamp > '1996-06-30 00:00:00.0000001'", _ANY, {}, None),
    ("stamp > '1996-06-30 00:00:00.000001'", _ANY, {}, "stamp > TIMESTAMP '1996-06-30 00:00:00.000001'"),
    ("stamp > '1996-06-30 00:00:00.4'", _ANY, {"stamp": {"digits": 0}}, None),
    ("stamp > '1996-06-30 00:00:00.5'", predicate.Rules(lens="half_up"), {"stamp": {"digits": 0}}, "stamp > TIMESTAMP '1996-06-30 00:00:01'"),
], "o_orderkey ; cast(o_orderdate as date) AS day ; cast(o_orderdate as timestamp_ntz) AS stamp", "o_orderkey, o_orderdate::DATE AS day, o_orderdate::TIMESTAMP AS stamp")
_filters("p22_generated_columns", "supplier", [
    ("s_nationkey = 3", _ANY, {"s_nationkey": {"generated": True}}, None),
    ("s_nationkey IS NULL", _ANY, {"s_nationkey": {"generated": True}}, None),
    ("s_suppkey > 20 OR s_nationkey = 3", _ANY, {"s_acctbal": {"generated": True}}, "s_suppkey > 20 OR s_nationkey = 3"),
    ("s_suppkey > 20 AND NOT (s_acctbal > 0)", _ANY, {"s_acctbal": {"generated": True}}, None),
])

#: Filters of orders, whether a source may evaluate each itself, and the hazards of its literals; day is a date and odd a boolean.
_PUSH = [
    ("o_orderkey > 100 AND odd = TRUE", True, "", "o_orderkey > 100 AND odd"),
    ("odd = 1", False, "number for a boolean", "odd"),
    ("day < '1996-06-30 12:00'", False, "rounded to its column, time of day", "day < DATE '1996-06-30'"),
    ("o_custkey IN (1, 2, 3) OR NOT (o_orderstatus = 'F')", True, "", "o_custkey IN (1, 2, 3) OR NOT (o_orderstatus = 'F')"),
    ("o_totalprice > 1000", False, "", "o_totalprice > 1000"),
    ("o_orderpriority >= '3'", False, "", "o_orderpriority >= '3'"),
]


@query("p19_push_down_eligibility", " UNION ALL ".join(f"SELECT {n} AS n, {str(push).lower()} AS pushed, '{hazard}' AS hazards, count(*) AS kept FROM (SELECT *, o_orderkey % 2 = 1 AS odd, o_orderdate::DATE AS day FROM orders) WHERE {sql}" for n, (_, push, hazard, sql) in enumerate(_PUSH)))
def p19(spark, d):
    o = load(spark, d, "orders").selectExpr("*", "o_orderkey % 2 = 1 AS odd", "cast(o_orderdate as date) AS day")
    known, out = predicate.columns_of(o), None
    for n, (text, *_) in enumerate(_PUSH):
        found = sorted({h for t in predicate.terms(text, known) for h in t.hazards})
        part = predicate.where(o, text, predicate.Rules(lens="cast")).agg(F.count("*").alias("kept"))
        part = part.select(F.lit(n).alias("n"), F.lit(predicate.push_down(text, known)[0]).alias("pushed"), F.lit(", ".join(found)).alias("hazards"), "kept")
        out = part if out is None else out.unionAll(part)
    return out


#: Filter sets: what a copy was begun with and what it goes on with, and whether it may.
_STATUS, _PRICE = {"orders": "o_orderstatus = 'F'"}, {"lineitem": "l_quantity > 10"}
_DRIFT = [(_STATUS, _STATUS, True), (_STATUS | _PRICE, _PRICE | _STATUS, True), (_STATUS, {"orders": "o_orderstatus = 'O'"}, False), (_STATUS, _STATUS | _PRICE, False), ({}, {}, True)]


@query("p20_filter_drift", counted_sql([f"SELECT * FROM orders WHERE {now.get('orders', 'true')}" if same else None for _, now, same in _DRIFT]))
def p20(spark, d):
    o = load(spark, d, "orders")

    def go_on(before: dict, now: dict) -> DataFrame:
        predicate.check_drift(predicate.fingerprint(before), now)
        return predicate.where(o, now.get("orders"))

    return counted(spark, [lambda b=b, n=n: go_on(b, n) for b, n, _ in _DRIFT])


#: Filters given by table name, and the tables' filters that they come to; None if they are refused.
_NAMED = [([("ORDERS", "o_custkey > 50"), ("Part", "p_size < 20")], ("o_custkey > 50", "p_size < 20")), ([("order", "o_custkey > 50")], None), ([("orders", "o_custkey > 50"), ("Orders", "o_custkey > 60")], None), ([("part", "p_size < 5")], ("true", "p_size < 5"))]


@query("p6_filter_keys", counted_sql([None if both is None else f"SELECT 1 FROM orders WHERE {both[0]} UNION ALL SELECT 1 FROM part WHERE {both[1]}" for _, both in _NAMED]))
def p6(spark, d):
    rows = {t: load(spark, d, t) for t in ("orders", "part")}

    def both(given: list[tuple[str, str]]) -> DataFrame:
        by_table = predicate.check_filters(given, list(rows))
        a, b = (predicate.where(df, by_table.get(t)).select(F.lit(1)) for t, df in rows.items())
        return a.unionAll(b)

    return counted(spark, [lambda g=g: both(g) for g, _ in _NAMED])


# ---------------------------------------------------------------------------
# Files


@query("s10_csv_header", counted_sql(["SELECT 1 FROM customer", None, None]) + " UNION ALL SELECT 3 + c_custkey, length(c_name) FROM customer")
def s10(spark, d):
    """A declared header gives the columns their names; one that is empty or repeats a name in another case is refused."""
    paths = [scratch(spark) for _ in range(3)]
    c = load(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("the, name"))
    c.write.option("header", True).option("quoteAll", True).csv(paths[0])
    for path, second in zip(paths[1:], (" ", "KEY"), strict=True):
        sinks.write_text(spark, f"{path}/a.csv", f'"key","{second}"\n"1","x"\n')
    read = [lambda p=p: files.read_csv(spark, f"{p}/*.csv", header=True) for p in paths]
    rows = read[0]()
    return counted(spark, read).unionAll(rows.select((F.col("key").cast("bigint") + 3).alias("n"), F.length("`the, name`").cast("bigint").alias("kept")))


@query("s12_encoding_guard", counted_sql(["SELECT 1 FROM supplier", "SELECT 1 FROM supplier", None, None]))
def s12(spark, d):
    """The same rows in several encodings: UTF-8 with and without its mark is read, all else is refused."""
    s, cases = load(spark, d, "supplier"), []
    for mark, encoding in (("", "UTF-8"), ("﻿", "UTF-8"), ("", "UTF-16"), ("", "UTF-16LE")):
        path = scratch(spark)
        s.select(F.col("s_suppkey").alias(f"{mark}key"), F.col("s_name").alias("name")).write.option("header", True).option("encoding", encoding).csv(path)
        cases.append(lambda p=path: files.read_csv(spark, f"{p}/*.csv", header=True).select("key", "name"))
    return counted(spark, cases)


#: Beginnings of files, and what they give away.
_BEGIN = [("-- rows of suppliers", None), ("-- MySQL dump 10.13  Distrib 8.0", "a plain dump of MySQL"), ("--\n-- PostgreSQL database dump\n--", "a plain dump of PostgreSQL"), ("PGDMP", "a PostgreSQL custom-format dump")]


@query("s13_dump_signatures", " UNION ALL ".join(f"SELECT {i} AS n, {'NULL::VARCHAR' if what is None else repr(what)} AS what, " + ("NULL::BIGINT AS kept" if what else f"count(*) AS kept FROM supplier WHERE s_suppkey % {len(_BEGIN)} = {i}") for i, (_, what) in enumerate(_BEGIN)))
def s13(spark, d):
    """A quarter of the suppliers as INSERTs in each of four dumps; the first bytes of their files show which may be read."""
    s, out = load(spark, d, "supplier"), None
    for i, (begin, _) in enumerate(_BEGIN):
        path = scratch(spark)
        mine = s.filter(F.col("s_suppkey") % len(_BEGIN) == i).select(F.concat(F.lit("INSERT INTO supplier VALUES ("), F.col("s_suppkey").cast("string"), F.lit(");")).alias("value"))
        mine.write.text(path)
        sinks.write_text(spark, f"{path}/0.txt", begin + "\n")
        what = files.signatures(spark, f"{path}/*.txt").agg(F.max("what")).first()[0]
        part = spark.createDataFrame([(i, what, None)], "n int, what string, kept bigint") if what else files.read_dump(spark, f"{path}/*.txt", "supplier", ["s_suppkey"]).agg(F.count("*").alias("kept")).select(F.lit(i).alias("n"), F.lit(None).cast("string").alias("what"), "kept")
        out = part if out is None else out.unionAll(part)
    return out


@query("s15_dump_schema", "SELECT p_partkey, p_name, p_retailprice::DECIMAL(12,2) AS p_retailprice, p_size::INTEGER AS p_size FROM part")
def s15(spark, d):
    """A table's CREATE statement gives the types that the text of its rows is read in."""
    path = scratch(spark)
    ddl = "CREATE TABLE `part` (\n `p_partkey` bigint NOT NULL,\n `p_name` varchar(80) DEFAULT 'a, (b)',\n `p_retailprice` decimal(12,2),\n `p_size` int,\n PRIMARY KEY (`p_partkey`),\n KEY `x` (`p_size`)\n) ENGINE=InnoDB"
    name, columns, key = files.create_table(ddl)
    p = load(spark, d, "part")
    row = F.concat(F.lit("INSERT INTO `part` VALUES ("), F.col("p_partkey").cast("string"), F.lit(",'"), F.col("p_name"), F.lit("',"), F.round("p_retailprice", 2).cast("decimal(12,2)").cast("string"), F.lit(","), F.col("p_size").cast("string"), F.lit(");"))
    p.select(row.alias("value")).write.text(path)
    t = cat.Table(name, tuple(cat.Column(n, cat.parse_type(kind), nullable) for n, kind, nullable in columns), key=tuple(key))
    return cat.cast_to(files.read_dump(spark, f"{path}/*.txt", name, [n for n, *_ in columns]), t)


@query("s18_manifests", "SELECT row_number() OVER (ORDER BY n_nationkey)::INTEGER AS place, n_name AS id FROM nation")
def s18(spark, d):
    """A manifest per nation, written in no order, each naming the one before as its parent."""
    path, names = scratch(spark), [r["n_name"] for r in load(spark, d, "nation").orderBy("n_nationkey").collect()]  # 25 rows
    for name, parent in sorted(zip(names, [None, *names], strict=False)):
        sinks.write_text(spark, f"{path}/{name.replace(' ', '_')}.json", json.dumps({"id": name, "parent": parent}))
    found = tables.read_manifests(spark, path)
    return spark.createDataFrame([(i, m["id"]) for i, m in enumerate(found, 1)], "place int, id string")


# ---------------------------------------------------------------------------
# Sinks


def _exported(name: str, key: str, text: str) -> cat.Table:
    return cat.Table(name, (cat.Column(key, typ.SqlType("integer"), False), cat.Column(text, typ.SqlType("text"))), key=(key,))


@query("k2_export_index", "SELECT 'customer' AS name, count(*) AS rows, 'c_custkey' AS key, 'integer,text' AS kinds, true AS kept_whole FROM customer UNION ALL SELECT 'part', count(*), 'p_partkey', 'integer,text', true FROM part")
def k2(spark, d):
    """The index of an export, the kinds in the footers, and a second export to the same place, which is refused."""
    path, shapes = scratch(spark), [_exported("customer", "c_custkey", "c_name"), _exported("part", "p_partkey", "p_name")]
    moved = {t.name: (load(spark, d, t.name), t) for t in shapes}
    sinks.export(spark, moved, path)
    again = True
    try:
        sinks.export(spark, moved, path)
        again = False
    except Refused:
        pass
    index = json.loads(sinks.read_text(spark, f"{path}/parquet_index.json"))["tables"]
    kinds = {n: ",".join(f.metadata["kind"] for f in spark.read.parquet(f"{path}/{n}").schema.fields) for n in index}
    return spark.createDataFrame([(n, t["rows"], ",".join(t["key"]), kinds[n], again) for n, t in index.items()], "name string, rows bigint, key string, kinds string, kept_whole boolean")


#: Suppliers as tables without a primary key, with other unique indexes; each is updated by the key that can be chosen.
_UNIQUE = [(cat.Index("a", ("s_name",), unique=True), True), (cat.Index("b", ("s_acctbal",), unique=True), False), (cat.Index("c", ("s_name",), unique=True, partial="s_nationkey > 0"), False), (cat.Index("d", ("s_name",)), False)]


@query("k5_upsert_key", " UNION ALL ".join(f"SELECT {i} AS n, s_name, s_nationkey + {100 if fine else 0} AS s_nationkey FROM supplier" for i, (_, fine) in enumerate(_UNIQUE)))
def k5(spark, d):
    """A plain unique index without nullable columns stands in for a key; with any other the upsert is refused and the rows stay."""
    s, out = load(spark, d, "supplier").select("s_name", "s_nationkey", "s_acctbal"), None
    columns = (cat.Column("s_name", typ.SqlType("text"), False), cat.Column("s_nationkey", typ.SqlType("integer")), cat.Column("s_acctbal", typ.SqlType("float")))
    for i, (index, _) in enumerate(_UNIQUE):
        t = cat.Table("supplier", columns, indexes=(index,))
        found = accepted(lambda t=t: sinks.upsert(s, s.withColumn("s_nationkey", F.col("s_nationkey") + 100), cat.upsert_key(t)))
        part = (s if found is None else found).select(F.lit(i).alias("n"), "s_name", "s_nationkey")
        out = part if out is None else out.unionAll(part)
    return out


@query("k13_chain_guard", "SELECT row_number() OVER (ORDER BY r_regionkey)::INTEGER AS generation, r_name AS id FROM region")
def k13(spark, d):
    """Two writers want each generation; the one that read the older tip is refused."""
    chain, parent, before = sinks.Chain(spark, scratch(spark)), None, None
    for row in load(spark, d, "region").orderBy("r_regionkey").collect():  # five rows
        chain.extend(row["r_name"], parent)
        before, parent = parent, row["r_name"]
        try:
            chain.extend("late", before)
        except Refused:
            continue
        raise AssertionError("two backups follow the same one")
    n, _ = chain.tip()
    marks = [json.loads(sinks.read_text(spark, f"{chain.path}/gen-{i:08d}.json")) for i in range(1, n + 1)]
    return spark.createDataFrame([(i, m["id"]) for i, m in enumerate(marks, 1)], "generation int, id string")


@query("v15_backup_verify", "SELECT DISTINCT c_mktsegment AS segment, CASE WHEN c_mktsegment < 'C' THEN 'changed' WHEN c_mktsegment > 'M' THEN 'missing' END AS problem FROM customer")
def v15(spark, d):
    """A backup with a folder a segment, of whose files some were changed and some are gone."""
    path, c = scratch(spark), load(spark, d, "customer").select("c_custkey", "c_mktsegment")
    c.write.partitionBy("c_mktsegment").json(f"{path}/rows")
    segments = [r[0] for r in c.select("c_mktsegment").distinct().collect()]  # a row per folder
    folder = {f"c_mktsegment={s}/": s for s in segments}
    expected = {r["path"]: r["sha256"] for r in sinks.file_digests(spark, f"{path}/rows").collect() if r["path"].endswith(".json")}
    owner = {name: folder[name.rpartition("/")[0] + "/"] for name in expected}
    for name, s in owner.items():
        if s < "C":
            sinks.write_text(spark, f"{path}/rows/{name}", "{}", overwrite=True)
        if s > "M":
            p, fs = sinks.open_path(spark, f"{path}/rows/{name}")
            fs.delete(p, False)
    problems = [x.split(" ", 1) for x in sinks.verify_backup(spark, f"{path}/rows", expected) if not x.endswith("_SUCCESS")]
    found = {owner[name]: what for what, name in problems}
    return spark.createDataFrame([(s, found.get(s)) for s in segments], "segment string, problem string")


_POOL = ("customer", "lineitem", "nation", "orders", "part", "supplier")


@query("c5_table_pool", " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS rows, count(*) AS read FROM {t}" for t in _POOL))
def c5(spark, d):
    path, out = scratch(spark), None
    rows = sinks.copy_tables({t: load(spark, d, t) for t in _POOL}, path, at_once=3)
    for t, n in rows.items():
        part = spark.read.parquet(f"{path}/{t}").agg(F.count("*").alias("read")).select(F.lit(t).alias("name"), F.lit(n).cast("bigint").alias("rows"), "read")
        out = part if out is None else out.unionAll(part)
    return out


@query("c3_chunk_count", " UNION ALL ".join(f"SELECT '{t}' AS name, greatest(1, least(greatest(ceil(count(*) / 500), 4), 64))::BIGINT AS chunks FROM {t}" for t in _POOL))
def c3(spark, d):
    return spark.createDataFrame([(t, verify.clamp_chunks(load(spark, d, t).count(), 500, 4, 16)) for t in _POOL], "name string, chunks bigint")


# ---------------------------------------------------------------------------
# Catalogues


@query("u4_namespaces", "SELECT CASE WHEN n_regionkey < 2 THEN 'west' WHEN n_regionkey < 4 THEN 'r' || n_regionkey ELSE 'rest' END AS space, n_name AS name FROM nation")
def u4(spark, d):
    """A table per nation, in a namespace per region, of which two are put together and one is named by default."""
    found = load(spark, d, "nation").select(F.concat(F.lit("r"), F.col("n_regionkey").cast("string"), F.lit("."), F.col("n_name"))).collect()  # 25 rows
    moved = cat.namespaces([r[0] for r in found], {"r0": "west", "r1": "west", "r2": "r2", "r3": "r3"}, default="rest")
    return spark.createDataFrame([tuple(new.split(".", 1)) for new in moved.values()], "space string, name string")


#: When a column was added to the events' table, as shares of the log, and how many columns it had from then on.
_GREW = [(0, 1), (30, 2), (75, 3)]


@query("t18_schema_history", "WITH b AS (SELECT min(event_id) AS lo, max(event_id) - min(event_id) + 1 AS w FROM events), p AS (SELECT event_type, max(event_id) AS last FROM events GROUP BY 1) SELECT event_type, (" + " + ".join(f"CASE WHEN last >= lo + w * {share} // 100 THEN 1 ELSE 0 END" for share, _ in _GREW) + ")::INTEGER AS n_columns FROM p, b")
def t18(spark, d):
    """The shape in effect at the last event of each type."""
    e = load(spark, d, "events")
    low, high = e.agg(F.min("event_id"), F.max("event_id")).first()
    column = lambda i: cat.Column(f"c{i}", typ.SqlType("integer"))
    history = [(low + (high - low + 1) * share // 100, cat.Table("events", tuple(column(i) for i in range(n)))) for share, n in _GREW]
    ends = e.groupBy("event_type").agg(F.max("event_id").alias("last")).collect()  # a row per type
    return spark.createDataFrame([(r["event_type"], len(cat.schema_at(history, r["last"], lambda a, b: a >= b).columns)) for r in ends], "event_type string, n_columns int")


_BEFORE, _AFTER = {"customer": ("c_custkey", "c_name"), "part": ("p_partkey",), "supplier": ("s_suppkey", "s_name")}, {"customer": ("c_custkey", "c_nationkey"), "nation": ("n_nationkey",), "supplier": ("s_suppkey", "s_name")}


@query("v7_schema_delta", "SELECT 'drop' AS step, 'part' AS name, count(*) AS rows FROM part UNION ALL SELECT 'add', 'nation', count(*) FROM nation UNION ALL SELECT 'alter', 'customer', count(*) FROM customer")
def v7(spark, d):
    """What turns one catalogue into the other, with the rows of each table that is touched; one that is alike in both is not."""
    kinds = {"bigint": typ.SqlType("integer"), "string": typ.SqlType("text"), "int": typ.SqlType("integer", bits=32)}

    def catalogue(shape: dict[str, tuple[str, ...]]) -> cat.Catalog:
        return cat.Catalog(tuple(cat.Table(t, tuple(cat.Column(f.name, kinds[f.dataType.simpleString()]) for f in load(spark, d, t).select(*names).schema.fields)) for t, names in shape.items()))

    found = cat.delta(catalogue(_BEFORE), catalogue(_AFTER))
    steps = [("drop", n) for n in found.dropped] + [("add", t.name) for t in found.added] + [("alter", n) for n, _ in found.altered]
    return spark.createDataFrame([(step, n, load(spark, d, n).count()) for step, n in steps], "step string, name string, rows bigint")


# ---------------------------------------------------------------------------
# Redaction and dialects

_ENTRIES = "(SELECT list(n_name ORDER BY n_nationkey) FROM nation)"


@query("r28_dictionary_file", "SELECT c_custkey AS id, " + _entry_sql("sha256('|t|v|id=' || c_custkey)").partition("]")[2].replace("% 7)", "% 25)").join((_ENTRIES, "")) + " AS v FROM customer")
def r28(spark, d):
    """Names of customers become nations, which a file lists with blank lines and spaces around."""
    path = f"{scratch(spark)}/nations.txt"
    sinks.write_text(spark, path, "\n\n".join(f"  {r['n_name']} " for r in load(spark, d, "nation").orderBy("n_nationkey").collect()))  # 25 rows
    rules = redact.Registry({"t.v": "randomize:dict:nations"}, dictionaries={"nations": redact.dictionary_file(spark, path)})
    return rules.apply(load(spark, d, "customer").selectExpr("c_custkey AS id", "c_name AS v"), "t", ["id"])


@query("r29_keyset_sources", " UNION ALL ".join(f"SELECT '{s}' AS source, c_custkey AS id, {_hmac_sql('c_name')} AS v FROM customer" for s in ("env", "file", "table")))
def r29(spark, d):
    """The same key from a file, a variable and a table, in each beside an older generation that is not used."""
    path, text = f"{scratch(spark)}/keys.txt", f"# two generations\nk:1:00ff\nk:2:{KEY.hex()}\n"
    sinks.write_text(spark, path, text)
    os.environ["FERRULE_KEYS_OF_A_QUERY"] = text
    spark.createDataFrame([("k", 1, "00ff"), ("k", 2, KEY.hex())], "name string, generation int, key string").createOrReplaceTempView("ferrule_keys_of_a_query")
    out = None
    for scheme, where in (("env", "FERRULE_KEYS_OF_A_QUERY"), ("file", path), ("table", "ferrule_keys_of_a_query")):
        rules = redact.Registry({"t.v": "hash:hmac-sha256:k"}, redact.Keyset.load(spark, f"{scheme}:{where}"))
        part = rules.apply(load(spark, d, "customer").selectExpr("c_custkey AS id", "c_name AS v"), "t").select(F.lit(scheme).alias("source"), "id", "v")
        out = part if out is None else out.unionAll(part)
    return out


#: Rules for customers, the key of the table, and how many rows come out without their own name; None if they are refused.
_RULES = [({"Customer.C_NAME": "static:x"}, [], "c_name <> 'x'"), ({"customer.c_name": "randomize:uuid"}, [], None), ({"customer.c_name": "randomize:uuid"}, ["c_custkey"], "true"), ({"customer.nothing": "null"}, [], None), ({"orders.c_name": "null"}, [], "false"), ({"customer.c_name": "shuffle"}, [], None)]


@query("r30_registry", counted_sql([None if sql is None else f"SELECT * FROM customer WHERE {sql}" for *_, sql in _RULES]))
def r30(spark, d):
    c = load(spark, d, "customer").select("c_custkey", "c_name")

    def changed(rules: dict[str, str], key: list[str]) -> DataFrame:
        rows = c.withColumn("own", F.col("c_name"))
        return redact.Registry(rules).apply(rows, "customer", key or None).filter("c_name IS DISTINCT FROM own")

    return counted(spark, [lambda r=r, k=k: changed(r, k) for r, k, _ in _RULES])


@query("f5_hashes", "SELECT p_partkey, md5(p_name) AS a, sha1(p_name) AS b, sha256(p_name) AS c, 36 AS u FROM part")
def f5(spark, d):
    t = lambda x: dialect.translate(x, "mysql")
    return load(spark, d, "part").selectExpr("p_partkey", t("MD5(p_name)") + " AS a", t("SHA1(p_name)") + " AS b", t("SHA2(p_name, 256)") + " AS c", f"length({t('UUID()')}) AS u")


@query("f11_requoting", "SELECT s_suppkey, upper(s_name) || '/' || '\"s name\"' AS a, s_name || s_nationkey AS b FROM supplier")
def f11(spark, d):
    """Quoted names of either server with spaces and quotes in them, beside literals that look like them."""
    s = load(spark, d, "supplier").select("s_suppkey", F.col("s_name").alias("s name"), F.col("s_nationkey").alias('a"b'))
    return s.selectExpr("s_suppkey", dialect.translate("CONCAT(UPPER(`s name`), '/', '\"s name\"')", "mysql") + " AS a", dialect.translate('"s name" || "a""b"::text', "postgres") + " AS b")
