"""The registered queries of the engine's own operators, each with the same in DuckDB's SQL beside it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import catalog as cat
from .. import types as typ
from ..errors import Refused
from ..functions import dialect, predicate, redact
from ..operators import changes, chunks, infer, metrics, verify
from ..sources import files, sinks, tables
from ..streaming import apply as streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

KEY = b"a key for the test tables"
WORDS = ["amber", "birch", "cedar", "delta", "ember", "flint", "grove"]


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLE_SQL[name] = sql
        return function

    return add


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new path that all executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return f"{base.rstrip('/')}/q-{uuid.uuid4().hex}"


# ---------------------------------------------------------------------------
# One copy, from rows to a checksum

FLAGSHIP_SQL = """
    SELECT o.o_orderpriority, count(*) AS n, sum(o.o_orderkey)::BIGINT AS sum_key,
           sum(length(substr(c.c_name, 1, 2) || repeat('X', length(c.c_name) - 4) || right(c.c_name, 2)))::BIGINT AS sum_masked,
           count(*) FILTER (sha256(c.c_name) < '8') AS n_low, min(sha256(c.c_name)) AS least_hash
    FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
    WHERE o.o_orderstatus IN ('O', 'F') AND NOT (o.o_totalprice < 1000) GROUP BY 1
"""


@query("flagship", FLAGSHIP_SQL)
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = predicate.where(load(spark, sf_dir, "orders"), "o_orderstatus IN ('O','F') AND NOT (o_totalprice < 1000)")
    people = load(spark, sf_dir, "customer").select("c_custkey", "c_name", F.col("c_name").alias("c_hash"))
    rules = redact.Registry({"customer.c_name": "mask:inner:2,2", "customer.c_hash": "hash:sha256"})
    people = rules.apply(people, "customer", ["c_custkey"])
    joined = orders.join(people, F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("sum_key"), F.sum(F.char_length("c_name").cast("bigint")).alias("sum_masked"), F.count_if(F.col("c_hash") < "8").alias("n_low"), F.min("c_hash").alias("least_hash"))


# ---------------------------------------------------------------------------
# Projection and predicates


@query("p1_projection", "SELECT c_custkey, c_name FROM customer")
def p1(spark, d):
    t = cat.Table("customer", (cat.Column("c_custkey", typ.SqlType("integer")), cat.Column("c_name", typ.SqlType("text")), cat.Column("c_upper", typ.SqlType("text"), generated="upper(c_name)")))
    return cat.readable(load(spark, d, "customer"), t)


def _where(name: str, table: str, text: str, sql_where: str, columns: str, rules=predicate.Rules(), **known):
    @query(name, f"SELECT {columns} FROM {table} WHERE {sql_where}")
    def run(spark, d):
        return predicate.where(load(spark, d, table), text, rules, **known).selectExpr(*columns.split(", "))


_where("p5_row_filter", "orders", "o_totalprice >= 150000 AND o_orderpriority <> '1-URGENT'", "o_totalprice >= 150000 AND o_orderpriority <> '1-URGENT'", "o_orderkey, o_custkey")
_where("p7_predicate_grammar", "part", "NOT (p_size IN (1, 2, 3) OR p_size > 40) AND (p_brand != 'Brand#11' OR p_type IS NULL) AND p_partkey NOT IN (5,6)", "NOT (p_size IN (1, 2, 3) OR p_size > 40) AND (p_brand <> 'Brand#11' OR p_type IS NULL) AND p_partkey NOT IN (5, 6)", "p_partkey, p_size")
_where("p21_float_order", "supplier", "s_acctbal > 0 and s_acctbal <= 5000.5", "s_acctbal > 0 AND s_acctbal <= 5000.5", "s_suppkey")


@query("p8_three_valued", "WITH o AS (SELECT o_orderkey, nullif(o_orderstatus, 'O') AS s FROM orders) SELECT o_orderkey FROM o WHERE NOT (s = 'F') OR (s IS NULL AND o_orderkey < 100)")
def p8(spark, d):
    o = load(spark, d, "orders").select("o_orderkey", F.nullif("o_orderstatus", F.lit("O")).alias("s"))
    return predicate.where(o, "NOT (s = 'F') OR (s IS NULL AND o_orderkey < 100)").select("o_orderkey")


_PADDED = "c_custkey, CASE c_custkey % 3 WHEN 0 THEN lower(c_mktsegment) WHEN 1 THEN concat(c_mktsegment, '  ') ELSE concat(' ', c_mktsegment) END AS seg"


def _collation(name: str, collation: str, sql: str):
    @query(name, f"WITH c AS (SELECT {_PADDED} FROM customer) SELECT c_custkey FROM c WHERE {sql}")
    def run(spark, d):
        c = load(spark, d, "customer").selectExpr(*[x.strip() for x in ("c_custkey", _PADDED.split(", ", 1)[1])])
        return predicate.where(c, "seg = 'Building' OR seg IN ('MACHINERY')", seg=predicate.Col(c.schema["seg"].dataType, collation=collation)).select("c_custkey")


_collation("p9_collation_ci_pad", "utf8mb4_general_ci", "lower(rtrim(seg, ' ')) IN ('building', 'machinery')")
_collation("p9_collation_bin_pad", "utf8mb4_bin", "rtrim(seg, ' ') IN ('Building', 'MACHINERY')")
_collation("p9_collation_ci_nopad", "utf8mb4_0900_ai_ci", "lower(seg) IN ('building', 'machinery')")
_collation("p9_collation_binary", "C", "seg IN ('Building', 'MACHINERY')")

def _lens(name: str, lens: str, micros: int):
    @query(name, f"SELECT event_id FROM (SELECT event_id, TIMESTAMP '2024-01-01 00:00:00' + to_microseconds(123456 + event_id % 3) AS t FROM events) WHERE t <= TIMESTAMP '2024-01-01 00:00:00' + to_microseconds({micros})")
    def run(spark, d):
        e = load(spark, d, "events").select("event_id", (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=((F.col("event_id") % 3 + 123456) / 1000000).cast("decimal(18,6)"))).alias("t"))
        return predicate.where(e, "t <= '2024-01-01 00:00:00.1234565'", predicate.Rules(lens=lens)).select("event_id")


_lens("p12_literal_cast", "cast", round(float("0.1234565") * 1e6))
_lens("p13_literal_half_up", "half_up", 123457)
_lens("p14_literal_truncate", "truncate", 123456)


@query("p17_nan_order", "SELECT s_suppkey FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'NaN'::DOUBLE WHEN s_suppkey % 3 = 1 THEN 'Infinity'::DOUBLE ELSE s_acctbal END AS v FROM supplier) WHERE v > 100 AND v <= 'NaN'::DOUBLE")
def p17(spark, d):
    s = load(spark, d, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 3 == 0, float("nan")).when(F.col("s_suppkey") % 3 == 1, float("inf")).otherwise(F.col("s_acctbal")).alias("v"))
    return predicate.where(s, "v > 100 AND v <= 'NaN'").select("s_suppkey")


#: Filters of orders: whether a source may evaluate them itself, and what each keeps.
_PUSHED = [("o_orderstatus IN ('O', 'F') AND o_custkey < 500", True), ("NOT (o_totalprice < 1000)", False), ("o_orderpriority > '3'", False), ("o_orderkey IN (1, 2, 3) OR o_custkey IS NULL", True)]


@query("p18_push_down_terms", " UNION ALL ".join(f"SELECT {i} AS n, {str(push).lower()} AS pushed, count(*) AS kept FROM orders WHERE {text}" for i, (text, push) in enumerate(_PUSHED)))
def p18(spark, d):
    o = load(spark, d, "orders")
    out = None
    for i, (text, _) in enumerate(_PUSHED):
        pushed, why = predicate.push_down(text, predicate.columns_of(o))
        assert pushed or why
        part = predicate.where(o, text).agg(F.count("*").alias("kept")).select(F.lit(i).alias("n"), F.lit(pushed).alias("pushed"), "kept")
        out = part if out is None else out.unionAll(part)
    return out


@query("p2_table_filter", "SELECT event_type AS name, count(*) AS n FROM events WHERE event_type NOT LIKE 'c%' AND event_type NOT LIKE '_i%' GROUP BY 1")
def p2(spark, d):
    """Every type of event as a table of its own, in or out of scope."""
    e = load(spark, d, "events")
    names = [r[0] for r in e.select("event_type").distinct().collect()]  # one row per table
    kept = [n for n in names if n not in cat.scope(names, include=[p for p in ("c*", "?i*") if any(cat.fnmatch.fnmatchcase(n, p) for n in names)])]
    return e.filter(F.col("event_type").isin(kept)).groupBy(F.col("event_type").alias("name")).agg(F.count("*").alias("n"))


#: What a table of bookkeeping and an application's look like; the query counts, for each table of the catalogue, its rows if it is moved.
_BOOKS = {
    "schema_migrations": ({"version": "varchar"}, True), "app.schema_migrations": ({"id": "integer", "payload": "text"}, False), "migrations": ({"id": "integer", "migration": "varchar", "batch": "integer"}, True),
    "app.migrations": ({"id": "integer", "migration": "varchar", "batch": "integer", "patient": "text"}, False), "schema_version": ({"version": "integer", "customer": "text"}, False), "__drizzle_migrations": ({}, True),
    "migration": ({"version": "varchar", "apply_time": "integer"}, True), "atlas_schema_revisions": ({}, True), "orders": ({"o_orderkey": "integer"}, False),
}


@query("p4_framework_tables", " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS n FROM orders WHERE o_orderkey % {len(_BOOKS)} = {i}" for i, (n, (_, book)) in enumerate(_BOOKS.items()) if not book))
def p4(spark, d):
    names = list(_BOOKS)
    moved = cat.application_tables({n: shape for n, (shape, _) in _BOOKS.items()})
    owner = F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("o_orderkey") % len(names) + 1).cast("int"))
    return load(spark, d, "orders").groupBy(owner.alias("name")).agg(F.count("*").alias("n")).filter(F.col("name").isin(moved))


@query("p16_network_literals", "SELECT s_suppkey FROM (SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN '::1.2.3.4' WHEN 1 THEN '::ffff:10.0.0.1' WHEN 2 THEN '2001:db8::1:2:3:4:5' ELSE '2001:db8:0:1:2:3:4:5' END AS a FROM supplier) WHERE a IN ('::1.2.3.4', '2001:db8::1:2:3:4:5')")
def p16(spark, d):
    """Literals are written as the server gives the addresses back, or they would match nothing."""
    s = load(spark, d, "supplier").selectExpr("s_suppkey", "CASE s_suppkey % 4 WHEN 0 THEN '::1.2.3.4' WHEN 1 THEN '::ffff:10.0.0.1' WHEN 2 THEN '2001:db8::1:2:3:4:5' ELSE '2001:db8:0:1:2:3:4:5' END AS a")
    return predicate.where(s, "a IN ('::102:304', '2001:0db8:0:1:2:3:4:5')", a=predicate.Col(s.schema["a"].dataType, network="address")).select("s_suppkey")


# ---------------------------------------------------------------------------
# Joins, verification, aggregates


@query("j1_fk_orphans", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IS NOT NULL AND l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 7 <> 0)")
def j1(spark, d):
    return verify.orphans(load(spark, d, "lineitem"), load(spark, d, "orders").filter("o_orderkey % 7 <> 0"), [("l_orderkey", "o_orderkey")]).select("l_orderkey", "l_linenumber")


_OTHER = "SELECT c_custkey, CASE WHEN c_custkey % 30 = 0 THEN c_name || '!' ELSE c_name END AS c_name, c_nationkey FROM customer WHERE c_custkey % 50 <> 0 UNION ALL SELECT -1, 'new', 1"
_PAIR = f"a AS (SELECT c_custkey, c_name, c_nationkey FROM customer), b AS ({_OTHER})"


def _sides(spark, d):
    a = load(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey")
    b = a.filter("c_custkey % 50 <> 0").withColumn("c_name", F.when(F.col("c_custkey") % 30 == 0, F.concat("c_name", F.lit("!"))).otherwise(F.col("c_name")))
    return a, b.unionAll(spark.createDataFrame([(-1, "new", 1)], a.schema))


_DIFF_SQL = f"WITH {_PAIR} SELECT coalesce(a.c_custkey, b.c_custkey)::VARCHAR AS pk, CASE WHEN b.c_custkey IS NULL THEN 'only_source' WHEN a.c_custkey IS NULL THEN 'only_target' ELSE 'differs' END AS status FROM a FULL JOIN b ON a.c_custkey = b.c_custkey WHERE a.c_custkey IS NULL OR b.c_custkey IS NULL OR a.c_name <> b.c_name"


@query("j2_merge_walk", _DIFF_SQL)
def j2(spark, d):
    return verify.diff(*_sides(spark, d), ["c_custkey"])


@query("v5_bisection", _DIFF_SQL)
def v5(spark, d):
    return verify.bisect(*_sides(spark, d), ["c_custkey"], tagged=True)


@query("j3_batch_update", "SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 1 THEN s_nationkey + 100 ELSE s_nationkey END AS s_nationkey FROM supplier")
def j3(spark, d):
    s = load(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    patch = s.filter("s_suppkey % 4 = 1").select("s_suppkey", (F.col("s_nationkey") + 100).alias("s_nationkey"))
    return sinks.upsert(s, patch, ("s_suppkey",))


@query("a1_row_count", "SELECT count(*) AS n FROM lineitem WHERE l_quantity > 10")
def a1(spark, d):
    return load(spark, d, "lineitem").filter("l_quantity > 10").agg(F.count("*").alias("n"))


@query("a2_chunked_count", "SELECT floor(o_orderkey / 1000)::BIGINT AS chunk, count(*) AS n FROM orders GROUP BY 1")
def a2(spark, d):
    return verify.chunked_count(load(spark, d, "orders"), "o_orderkey", 1000)


_SUM = "SELECT '{t}' AS name, concat_ws(':', count(*), sum({i}), sum({a}::DECIMAL(20,2))::DECIMAL(38,2), sum(length({l})), count(*) FILTER ({f})) AS checksum FROM {t}"
_SUMS = [dict(t="customer", i="c_custkey", a="c_acctbal", l="c_mktsegment", f="c_nationkey % 3 = 0"), dict(t="orders", i="o_orderkey", a="o_totalprice", l="o_orderpriority", f="o_orderstatus = 'O'"), dict(t="supplier", i="s_suppkey", a="s_acctbal", l="s_name", f="s_nationkey % 3 = 0")]


def _checksums(spark, d):
    return [verify.checksum(load(spark, d, s["t"]), s["t"], s["i"], s["a"], s["l"], F.expr(s["f"])) for s in _SUMS]


@query("a4_table_checksum", " UNION ALL ".join(_SUM.format(**s) for s in _SUMS))
def a4(spark, d):
    a, b, c = _checksums(spark, d)
    return a.unionAll(b).unionAll(c)


@query("a5_combined_checksum", f"SELECT md5(string_agg(name || '=' || checksum, '|' ORDER BY name)) AS checksum FROM ({' UNION ALL '.join(_SUM.format(**s) for s in _SUMS)})")
def a5(spark, d):
    return verify.combined_checksum(_checksums(spark, d))


@query("a7_key_bounds", "SELECT min(o_orderkey) AS low, max(o_orderkey) AS high FROM orders")
def a7(spark, d):
    return spark.createDataFrame([chunks.bounds(load(spark, d, "orders"), "o_orderkey")], "low bigint, high bigint")


@query("a8_violations", "SELECT count(*) FILTER (NOT regexp_matches(event_type, '^[a-m]')) AS late, count(*) FILTER (event_id % 10 > 1) AS not_bool FROM events")
def a8(spark, d):
    return infer.violations(load(spark, d, "events"), {"late": F.col("event_type").rlike("^[a-m]"), "not_bool": F.col("event_id") % 10 <= 1})


@query("a9_duplicate_keys", "SELECT event_id FROM events WHERE event_id % 5 IN (0, 1)")
def a9(spark, d):
    e = load(spark, d, "events").select("event_id", F.when(F.col("event_id") % 5 == 0, F.lit('{"a":1,"a":2}')).when(F.col("event_id") % 5 == 1, F.lit('{"x":{"b":1,"c":[{"d":1,"d":2}]}}')).otherwise(F.col("props")).alias("j"))
    return e.filter(infer.duplicate_keys(F.col("j"))).select("event_id")


@query("a10_distinct_tables", "SELECT DISTINCT event_type FROM events")
def a10(spark, d):
    return load(spark, d, "events").select("event_type").distinct()


@query("a11_consumer_minimum", "SELECT least(min(f), 900000) - 10 AS bound FROM (SELECT user_id % 5 AS c, max(event_id) AS f FROM events GROUP BY 1)")
def a11(spark, d):
    c = load(spark, d, "events").groupBy((F.col("user_id") % 5).alias("c")).agg(F.max("event_id").alias("frontier"))
    return spark.createDataFrame([(changes.prune_bound(900000, c, 10),)], "bound bigint")


@query("a14_run_summary", " UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) AS rows FROM {t}" for t in ("customer", "lineitem", "orders", "part")))
def a14(spark, d):
    return verify.run_summary({t: load(spark, d, t) for t in ("customer", "lineitem", "orders", "part")})


_SAMPLE = "SELECT c_custkey::VARCHAR AS pk, md5(concat_ws('|', c_custkey, c_name, c_nationkey)) AS row_hash FROM {t} ORDER BY md5(c_custkey::VARCHAR || '42'), 1 LIMIT 100"


@query("v2_sample_verify", f"WITH {_PAIR}, x AS ({_SAMPLE.format(t='a')}), y AS ({_SAMPLE.format(t='b')}) SELECT coalesce(x.pk, y.pk) AS pk, CASE WHEN y.pk IS NULL THEN 'only_source' WHEN x.pk IS NULL THEN 'only_target' ELSE 'differs' END AS status FROM x FULL JOIN y ON x.pk = y.pk WHERE x.row_hash IS DISTINCT FROM y.row_hash")
def v2(spark, d):
    a, b = _sides(spark, d)
    return verify.compare_hashes(verify.sample_hashes(a, ["c_custkey"]), verify.sample_hashes(b, ["c_custkey"]))


@query("v1_count_verify", f"WITH {_PAIR} SELECT 'customer' AS table_name, 'mismatch' AS status, (SELECT count(*) FROM a) || ' and ' || (SELECT count(*) FROM b) || ' rows' AS detail UNION ALL SELECT 'nation', 'ok', (SELECT count(*) || ' and ' || count(*) || ' rows' FROM nation) UNION ALL SELECT 'region', 'mismatch', 'missing on target'")
def v1(spark, d):
    a, b = _sides(spark, d)
    n = load(spark, d, "nation")
    found = verify.verify({"customer": a, "nation": n, "region": load(spark, d, "region")}, {"customer": b, "nation": n}, {})
    return spark.createDataFrame([(r.table, r.status, r.detail) for r in found], "table_name string, status string, detail string")


@query("v3_row_hash", "SELECT o_orderkey, md5(concat_ws('|', o_orderkey, coalesce(nullif(o_orderstatus, 'O'), ''), o_totalprice::DECIMAL(38,6), o_orderpriority)) AS md5, sha256(concat_ws('|', o_orderkey, o_orderpriority)) AS sha FROM orders")
def v3(spark, d):
    o = load(spark, d, "orders").select("o_orderkey", F.nullif("o_orderstatus", F.lit("O")).alias("o_orderstatus"), F.col("o_totalprice").cast("decimal(38,6)").alias("o_totalprice"), "o_orderpriority")
    return o.select("o_orderkey", verify.row_hash(o).alias("md5"), verify.row_hash(o, ["o_orderkey", "o_orderpriority"], "sha256").alias("sha"))


_NEAR = "SELECT s_name || repeat('|', (s_suppkey % 2)::INTEGER) AS a, repeat('|', 1 - (s_suppkey % 2)::INTEGER) || s_suppkey AS b, s_acctbal AS v FROM supplier"


@query("v4_exact_rows", f"""WITH x AS ({_NEAR}), y AS (SELECT CASE WHEN b LIKE '%3' THEN a || '|' ELSE a END AS a, b, CASE WHEN b LIKE '%7' THEN v + 1e-7 ELSE v END AS v FROM x)
    SELECT coalesce(x.a, y.a) AS a, coalesce(x.b, y.b) AS b, CASE WHEN y.a IS NULL THEN 'only_source' WHEN x.a IS NULL THEN 'only_target' ELSE 'differs' END AS status
    FROM x FULL JOIN y ON x.a = y.a AND x.b = y.b WHERE x.a IS NULL OR y.a IS NULL OR x.v <> y.v""")
def v4(spark, d):
    """Doubles that differ by 1e-7, and keys that only differ in where a separator stands: none of them passes as equal."""
    s = load(spark, d, "supplier")
    x = s.selectExpr("concat(s_name, repeat('|', cast(s_suppkey % 2 as int))) AS a", "concat(repeat('|', 1 - cast(s_suppkey % 2 as int)), s_suppkey) AS b", "s_acctbal AS v")
    y = x.selectExpr("CASE WHEN b LIKE '%3' THEN concat(a, '|') ELSE a END AS a", "b", "CASE WHEN b LIKE '%7' THEN v + 1e-7D ELSE v END AS v")
    found = verify.diff(x, y, ["a", "b"], tagged=True)
    key = lambda df: df.select("a", "b", verify.key_text(["a", "b"]).alias("pk"))
    return found.join(key(x).union(key(y)).distinct(), "pk").select("a", "b", "status")


_SHAPES = {
    "customer": "SELECT c_custkey AS key, c_name AS name, c_nationkey AS nationkey, c_acctbal AS acctbal, c_mktsegment AS mktsegment FROM customer",
    "supplier": "SELECT s_suppkey AS key, s_name AS name, s_nationkey AS nationkey, s_acctbal AS acctbal FROM supplier",
    "part": "SELECT p_partkey AS key, p_name AS name, p_brand AS nationkey, p_retailprice AS acctbal, p_size AS size FROM part",
    "nation": "SELECT n_nationkey AS key, n_name AS name, n_regionkey AS nationkey FROM nation",
}


_SHAPE_TYPES = {"int": typ.SqlType("integer", bits=32), "bigint": typ.SqlType("integer"), "double": typ.SqlType("float"), "string": typ.SqlType("text")}


@query("v6_shape_diff", "WITH " + ", ".join(f"{t} AS (SELECT column_name AS c, column_type AS t FROM (DESCRIBE {sql}))" for t, sql in ((f"s_{k}", v) for k, v in _SHAPES.items()))
    + ", s AS (" + " UNION ALL ".join(f"SELECT '{t}' AS name, * FROM s_{t}" for t in _SHAPES) + "), n AS (SELECT DISTINCT name FROM s)"
    + " SELECT a.name AS source, b.name AS target, x.c AS column_name, CASE WHEN y.c IS NULL THEN 'missing' ELSE 'type' END AS difference FROM n a CROSS JOIN n b JOIN s x ON x.name = a.name LEFT JOIN s y ON y.name = b.name AND y.c = x.c WHERE y.c IS NULL OR y.t <> x.t"
    + " UNION ALL SELECT a.name, b.name, y.c, 'extra' FROM n a CROSS JOIN n b JOIN s y ON y.name = b.name LEFT JOIN s x ON x.name = a.name AND x.c = y.c WHERE x.c IS NULL")
def v6(spark, d):
    """Every pair of tables whose columns have names in common, compared by the shapes that the files have."""
    shapes = {}
    for name, sql in _SHAPES.items():
        select = [part.strip() for part in sql.removeprefix("SELECT ").split(" FROM ")[0].split(",")]
        fields = load(spark, d, name).selectExpr(*select).schema.fields
        shapes[name] = cat.Table(name, tuple(cat.Column(f.name, _SHAPE_TYPES[f.dataType.simpleString()]) for f in fields))
    rows = []
    for a, left in shapes.items():
        for b, right in shapes.items():
            for text in cat.shape_diff(left, right):
                words = text.replace(":", "").split()
                rows.append((a, b, words[1] if words[0] == "column" else words[2], words[2] if words[0] == "column" else words[0]))
    return spark.createDataFrame(rows, "source string, target string, column_name string, difference string")


@query("v11_boolean_range", "SELECT event_id FROM events WHERE (user_id % 4) NOT IN (0, 1)")
def v11(spark, d):
    return verify.not_boolean(load(spark, d, "events").withColumn("flag", F.col("user_id") % 4), "flag").select("event_id")


@query("v12_colliding_keys", "SELECT s_nationkey, 2::BIGINT AS shards FROM (SELECT DISTINCT s_nationkey FROM supplier) WHERE s_nationkey IN (SELECT c_nationkey FROM customer WHERE c_custkey % 2 = 0)")
def v12(spark, d):
    a = load(spark, d, "supplier").select("s_nationkey")
    b = load(spark, d, "customer").filter("c_custkey % 2 = 0").select(F.col("c_nationkey").alias("s_nationkey"))
    return verify.colliding_keys([a, b], ["s_nationkey"])


# ---------------------------------------------------------------------------
# Windows, pages, chunks, sets


@query("w1_keyset_boundaries", "WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (ORDER BY o_custkey, o_orderkey) AS rn, count(*) OVER () AS n FROM orders) SELECT k::INTEGER AS k, o_custkey, o_orderkey FROM r, range(1, 8) t(k) WHERE rn = ceil(n * k / 8)")
def w1(spark, d):
    return chunks.keyset_boundaries(load(spark, d, "orders"), ["o_custkey", "o_orderkey"], 8)


@query("w2_last_wins", "SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY 1")
def w2(spark, d):
    return changes.last_wins(load(spark, d, "events").select("user_id", "event_type", "event_id"), ["user_id"], "event_id")


@query("w3_schema_at", "WITH b AS (SELECT min(event_id) AS lo, max(event_id) - min(event_id) + 1 AS w FROM events) SELECT event_id, event_type AS \"table\", nullif(len(list_filter(range(0, 10), lambda k: lo + w * (2 * k + 1) // 20 <= event_id)) - 1, -1)::INTEGER AS version FROM events, b")
def w3(spark, d):
    e = load(spark, d, "events").select("event_id", F.col("event_type").alias("table"), F.col("event_id").alias("seq"))
    span = e.agg(F.min("seq").alias("lo"), (F.max("seq") - F.min("seq") + 1).alias("w"))
    history = e.select("table").distinct().crossJoin(span).select("table", "lo", "w", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("version"))
    return changes.version_at(e, history.select("table", "version", F.expr("lo + w * (2 * version + 1) div 20").alias("anchor"))).select("event_id", "table", "version")


@query("l1_sample", "SELECT p_partkey::VARCHAR AS pk, md5(concat_ws('|', p_partkey, p_name)) AS row_hash FROM part ORDER BY md5(p_partkey::VARCHAR || '7'), 1 LIMIT 20")
def l1(spark, d):
    return verify.sample_hashes(load(spark, d, "part").select("p_partkey", "p_name"), ["p_partkey"], 20, 7)


@query("l2_keyset_page", "SELECT o_custkey, o_orderkey FROM orders WHERE (o_custkey > 10 OR (o_custkey = 10 AND o_orderkey > 50)) AND NOT (o_custkey > 40 OR (o_custkey = 40 AND o_orderkey > 3)) ORDER BY 1, 2 LIMIT 25")
def l2(spark, d):
    return chunks.page(load(spark, d, "orders").select("o_custkey", "o_orderkey"), ["o_custkey", "o_orderkey"], (10, 50), 25, (40, 3))


@query("l4_next_bound", "SELECT max(p_partkey) AS bound FROM (SELECT p_partkey FROM part WHERE p_partkey > 17 ORDER BY 1 LIMIT 30)")
def l4(spark, d):
    return spark.createDataFrame([(chunks.next_bound(load(spark, d, "part"), "p_partkey", 17, 30),)], "bound bigint")


@query("l5_first_violation", "SELECT count(*) > 0 AS violated FROM lineitem WHERE l_orderkey % 7 = 0")
def l5(spark, d):
    found = verify.first_orphan(load(spark, d, "lineitem"), load(spark, d, "orders").filter("o_orderkey % 7 <> 0"), [("l_orderkey", "o_orderkey")])
    return spark.createDataFrame([(found is not None,)], "violated boolean")


@query("u2_union_distinct", "SELECT c_nationkey AS n FROM customer UNION SELECT s_nationkey FROM supplier")
def u2(spark, d):
    return load(spark, d, "customer").select(F.col("c_nationkey").alias("n")).union(load(spark, d, "supplier").select("s_nationkey")).distinct()


@query("u3_shard_consolidation", "SELECT 'east' AS shard, s_suppkey, s_name FROM supplier WHERE s_nationkey < 12 UNION ALL SELECT 'west', s_suppkey, s_name FROM supplier WHERE s_nationkey >= 8")
def u3(spark, d):
    s = load(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    return cat.consolidate({"east": s.filter("s_nationkey < 12").drop("s_nationkey"), "west": s.filter("s_nationkey >= 8").select("s_name", "s_suppkey")}, "shard").select("shard", "s_suppkey", "s_name")


@query("u5_key_difference", "SELECT o_custkey AS k FROM (SELECT DISTINCT o_custkey FROM orders) EXCEPT SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0")
def u5(spark, d):
    return load(spark, d, "orders").select(F.col("o_custkey").alias("k")).distinct().exceptAll(load(spark, d, "customer").filter("c_custkey % 3 <> 0").select("c_custkey"))


@query("c1_range_chunks", "WITH b AS (SELECT min(o_orderkey) AS lo, max(o_orderkey) - min(o_orderkey) + 1 AS w FROM orders) SELECT k::INTEGER AS chunk, count(*) AS n FROM orders, b, range(0, 7) t(k) WHERE o_orderkey >= lo + w * k // 7 AND o_orderkey < lo + w * (k + 1) // 7 GROUP BY 1")
def c1(spark, d):
    o = load(spark, d, "orders")
    edges = [b - 1 for _, b in chunks.ranges(*chunks.bounds(o, "o_orderkey"), 7)[:-1]]
    return chunks.keyset_chunks(o, "o_orderkey", edges).groupBy("chunk").agg(F.count("*").alias("n"))


@query("c2_keyset_chunks", "SELECT (CASE WHEN p_partkey > 20 THEN 1 ELSE 0 END + CASE WHEN p_partkey > 90 THEN 1 ELSE 0 END)::INTEGER AS chunk, count(*) AS n FROM part GROUP BY 1")
def c2(spark, d):
    return chunks.keyset_chunks(load(spark, d, "part"), "p_partkey", [20, 90]).groupBy("chunk").agg(F.count("*").alias("n"))


@query("c4_key_fan_out", "SELECT count(DISTINCT user_id) AS pairs FROM events")
def c4(spark, d):
    e = chunks.fan_out(load(spark, d, "events"), ["user_id"], 8).withColumn("p", F.spark_partition_id())
    return e.select("user_id", "p").distinct().agg(F.count("*").alias("pairs"))


@query("c8_backfill", "SELECT p_partkey, CASE WHEN p_size > 20 THEN upper(p_brand) || '*' ELSE p_brand END AS p_brand FROM part")
def c8(spark, d):
    return chunks.backfill(load(spark, d, "part").select("p_partkey", "p_brand", "p_size"), {"p_brand": F.concat(F.upper("p_brand"), F.lit("*"))}, F.col("p_size") > 20).drop("p_size")


# ---------------------------------------------------------------------------
# Redaction


def _redact(name: str, spec: str, sql: str | None, table: str = "customer", key: str = "c_custkey", value: str = "c_name", text: str | None = None, sql_text: str | None = None, dictionaries=None):
    body = None if sql is None else f"WITH t AS (SELECT {key} AS id, {sql_text or text or value} AS v FROM {table}), s AS (SELECT *, sha256('|t|v|id=' || id) AS seed FROM t) SELECT id, {sql} AS v FROM s"

    @query(name, body)
    def run(spark, d):
        rows = load(spark, d, table).selectExpr(f"{key} AS id", f"{text or value} AS v")
        rules = redact.Registry({"t.v": spec}, redact.Keyset.read("k:1:" + KEY.hex()), dictionaries)
        return rules.apply(rows, "t", ["id"])


def _draw(counter: int, n: int) -> str:
    return f"(('0x' || substr(sha256(seed || ':{counter}'), 1, 15))::BIGINT % {n})"


def _hmac_sql(message: str) -> str:
    block = KEY.ljust(64, b"\0")
    inner = "".join(f"\\x{b ^ 0x36:02X}" for b in block)
    outer = "".join(f"\\x{b ^ 0x5C:02X}" for b in block)
    return f"sha256('{outer}'::BLOB || unhex(sha256('{inner}'::BLOB || encode({message}))))"


def _entry_sql(hex_hash: str) -> str:
    swapped = " || ".join(f"substr({hex_hash}, {15 - 2 * i}, 2)" for i in range(8))
    return f"[{', '.join(repr(w) for w in WORDS)}][(('0x' || {swapped})::UBIGINT % {len(WORDS)})::INTEGER + 1]"


_redact("r1_null", "null", "NULL::VARCHAR")
_redact("r2_static", "static:gone", "'gone'", text="nullif(c_name, c_name)")
_redact("r3_sha256", "hash:sha256", "sha256(v)")
_redact("r4_hmac_sha256", "hash:hmac-sha256:k", _hmac_sql("v"))
_redact("r5_truncate", "truncate:7", "left(v, 7)")
_redact("r6_mask_inner", "mask:inner:3,2,*", "CASE WHEN length(v) > 5 THEN left(v, 3) || repeat('*', length(v) - 5) || right(v, 2) ELSE v END", "documents", "doc_id", "text")
_redact("r7_mask_outer", "mask:outer:3,2", "CASE WHEN length(v) > 5 THEN 'XXX' || substr(v, 4, length(v) - 5) || 'XX' ELSE repeat('X', length(v)) END", "documents", "doc_id", "text")
_redact("r8_mask_ssn", "mask:ssn", "'XXX-XX-' || right(v, 4)", text="concat('123-45-', lpad(cast(c_custkey % 10000 as varchar(9)), 4, '0'))")
_redact("r10_mask_pan", "mask:pan-relaxed", "substr(v, 1, 4) || '-' || substr(v, 6, 2) || 'XX-XXXX-' || right(v, 4)", text="concat('4111-2222-3333-', lpad(cast(c_custkey % 10000 as varchar(9)), 4, '0'))")
_redact("r9_mask_pan_luhn", "mask:pan", "left(v, 6) || repeat('X', length(v) - 10) || right(v, 4)", text="CASE c_custkey % 4 WHEN 0 THEN '4111111111111111' WHEN 1 THEN '5555555555554444' WHEN 2 THEN '6011111111111117' ELSE '378282246310005' END")
_redact("r11_mask_email", "mask:email", None, text="concat(c_name, '@b@example.com')")
ORACLE_SQL["r11_mask_email"] = "SELECT c_custkey AS id, left(c_name, 1) || repeat('X', length(c_name) + 1) || '@example.com' AS v FROM customer"
_redact("r12_mask_ca_sin", "mask:ca-sin", "'XXX-XXX-' || right(v, 3)", text="CASE c_custkey % 3 WHEN 0 THEN '046-454-286' WHEN 1 THEN '130-692-544' ELSE '999-999-998' END")
_redact("r13_mask_uk_nin", "mask:uk-nin", "'ABXXXXXXC'", text="concat('AB', lpad(cast(c_custkey % 1000000 as varchar(9)), 6, '0'), 'C')")
_redact("r14_mask_iban", "mask:iban", "'DE89 37XX XXXX XXXX XX' || substr(v, 23, 2) || ' ' || right(v, 2)", text="concat('DE89 3704 0044 0532 01', lpad(cast(c_custkey % 100 as varchar(9)), 2, '0'), ' 00')")
_redact("r15_mask_uuid", "mask:uuid", "left(v, 4) || 'XXXX-XXXX-XXXX-XXXX-XXXXXXXX' || right(v, 4)", text="concat('550e8400-e29b-41d4-a716-44665544', lpad(cast(c_custkey % 10000 as varchar(9)), 4, '0'))")
_redact("r17_randomize_int", "randomize:int:5,14", f"({_draw(0, 10)} + 5)::INTEGER", value="c_nationkey")
_redact("r18_randomize_email", "randomize:email", "left(" + " || ".join(f"substr('abcdefghijklmnopqrstuvwxyz', ({_draw(i, 26)} + 1)::INTEGER, 1)" for i in range(12)) + f", {_draw(40, 7)} + 6) || '@' || left(" + " || ".join(f"substr('abcdefghijklmnopqrstuvwxyz', ({_draw(20 + i, 26)} + 1)::INTEGER, 1)" for i in range(10)) + f", {_draw(41, 6)} + 5) || '.test'", "supplier", "s_suppkey", "s_name")
_redact("r19_randomize_us_phone", "randomize:us-phone", f"({_draw(0, 799)} + 200 + CASE WHEN {_draw(0, 799)} + 200 >= 555 THEN 1 ELSE 0 END)::VARCHAR || '-' || ({_draw(1, 800)} + 200)::VARCHAR || '-' || lpad({_draw(2, 10000)}::VARCHAR, 4, '0')")
_redact("r20_randomize_uuid", "randomize:uuid", f"substr(sha256(seed || ':uuid'), 1, 8) || '-' || substr(sha256(seed || ':uuid'), 9, 4) || '-4' || substr(sha256(seed || ':uuid'), 14, 3) || '-' || substr('89ab', ({_draw(0, 4)} + 1)::INTEGER, 1) || substr(sha256(seed || ':uuid'), 18, 3) || '-' || substr(sha256(seed || ':uuid'), 21, 12)")
_redact("r21_randomize_ssn", "randomize:ssn", f"lpad(({_draw(0, 898)} + 1 + CASE WHEN {_draw(0, 898)} + 1 >= 666 THEN 1 ELSE 0 END)::VARCHAR, 3, '0') || '-' || lpad(({_draw(1, 99)} + 1)::VARCHAR, 2, '0') || '-' || lpad(({_draw(2, 9999)} + 1)::VARCHAR, 4, '0')")
_redact("r22_randomize_pan", "randomize:pan:mastercard", None)
ORACLE_SQL["r22_randomize_pan"] = f"WITH s AS (SELECT c_custkey AS id, sha256('|t|v|id=' || c_custkey) AS seed FROM customer), q AS (SELECT id, '5' || left(lpad({_draw(0, 10**12)}::VARCHAR, 12, '0') || lpad({_draw(1, 10**12)}::VARCHAR, 12, '0'), 14) AS p FROM s), w AS (SELECT id, p, list_sum(list_transform(range(1, 16), lambda i: CASE WHEN i % 2 = 1 THEN CASE WHEN substr(p, (16 - i)::INTEGER, 1)::INTEGER * 2 > 9 THEN substr(p, (16 - i)::INTEGER, 1)::INTEGER * 2 - 9 ELSE substr(p, (16 - i)::INTEGER, 1)::INTEGER * 2 END ELSE substr(p, (16 - i)::INTEGER, 1)::INTEGER END)) AS t FROM q) SELECT id, p || ((10 - t % 10) % 10)::VARCHAR AS v FROM w"
_redact("r23_randomize_ca_sin", "randomize:ca-sin", None)
ORACLE_SQL["r23_randomize_ca_sin"] = f"WITH s AS (SELECT c_custkey AS id, sha256('|t|v|id=' || c_custkey) AS seed FROM customer), q AS (SELECT id, substr('12345679', ({_draw(9, 8)} + 1)::INTEGER, 1) || left(lpad({_draw(0, 10**12)}::VARCHAR, 12, '0'), 7) AS p FROM s), w AS (SELECT id, p, list_sum(list_transform(range(1, 9), lambda i: CASE WHEN i % 2 = 0 THEN substr(p, i::INTEGER, 1)::INTEGER * 2 // 10 + substr(p, i::INTEGER, 1)::INTEGER * 2 % 10 ELSE substr(p, i::INTEGER, 1)::INTEGER END)) AS t FROM q) SELECT id, p || ((10 - t % 10) % 10)::VARCHAR AS v FROM w"
_redact("r24_randomize_uk_nin", "randomize:uk-nin", f"substr('ABCEGHJKLMNOPRSTWXYZ', ({_draw(7, 20)} + 1)::INTEGER, 1) || substr('ABCEGHJKLMNPRSTWXYZ', ({_draw(8, 19)} + 1)::INTEGER, 1) || left(lpad({_draw(0, 10**12)}::VARCHAR, 12, '0'), 6) || substr('ABCD', ({_draw(9, 4)} + 1)::INTEGER, 1)")
ORACLE_SQL["r25_randomize_iban"] = f"WITH s AS (SELECT c_custkey AS id, sha256('|t|v|id=' || c_custkey) AS seed FROM customer), q AS (SELECT id, left(lpad({_draw(0, 10**12)}::VARCHAR, 12, '0') || lpad({_draw(1, 10**12)}::VARCHAR, 12, '0'), 18) AS b FROM s) SELECT id, 'DE' || lpad((98 - (b || '131400')::HUGEINT % 97)::VARCHAR, 2, '0') || b AS v FROM q"
_redact("r25_randomize_iban", "randomize:iban:DE", None)
_redact("r26_randomize_dict", "randomize:dict:w", _entry_sql("seed"), dictionaries={"w": WORDS})
_redact("r27_tokenize_dict", "tokenize:dict:w:k", _entry_sql(f"({_hmac_sql(chr(39) + ':w:' + chr(39) + ' || v')})"), value="c_mktsegment", dictionaries={"w": WORDS})


@query("r16_row_seed", "SELECT o_orderkey, sha256('s|orders|o_custkey|o_orderkey=' || o_orderkey || '|o_custkey=' || o_custkey) AS seed FROM orders")
def r16(spark, d):
    return load(spark, d, "orders").select("o_orderkey", redact.row_seed("s", "orders", "o_custkey", ["o_orderkey", "o_custkey"]).alias("seed"))


@query("r31_iban_luhn_valid", "SELECT c_custkey, c_custkey % 2 = 0 AS iban, c_custkey % 3 = 0 AS luhn FROM customer")
def r31(spark, d):
    c = load(spark, d, "customer")
    iban = F.when(F.col("c_custkey") % 2 == 0, "DE89 3704 0044 0532 0130 00").otherwise("DE88370400440532013000")
    pan = F.when(F.col("c_custkey") % 3 == 0, "378282246310005").otherwise("378282246310004")
    return c.select("c_custkey", redact.iban_valid(iban).alias("iban"), F.call_function("luhn_check", pan).alias("luhn"))


# ---------------------------------------------------------------------------
# Expressions of other dialects


@query("f1_mysql_strings", "SELECT c_custkey, upper(substr(c_name, 2, 4)) || '-' || strpos(c_name, 'o') AS s, coalesce(list_position(['BUILDING', 'MACHINERY'], c_mktsegment), 0)::BIGINT AS f, CASE WHEN c_acctbal IS NULL THEN 0 ELSE 1 END AS n FROM customer")
def f1(spark, d):
    t = dialect.translate
    return load(spark, d, "customer").selectExpr("c_custkey", t("CONCAT(UCASE(MID(`c_name`, 2, 4)), '-', INSTR(c_name, 'o'))", "mysql") + " AS s", t("IFNULL(FIELD(c_mktsegment, 'BUILDING', 'MACHINERY'), 0)", "mysql") + " AS f", t("IF(ISNULL(c_acctbal), 0, 1)", "mysql") + " AS n")


@query("f3_mysql_dates", "SELECT o_orderkey, dayname(o_orderdate) AS dn, monthname(o_orderdate) AS mn, quarter(o_orderdate)::INTEGER AS q, last_day(o_orderdate) AS ld, date_diff('day', DATE '1990-01-01', o_orderdate::DATE)::INTEGER AS dd FROM orders")
def f3(spark, d):
    t = dialect.translate
    return load(spark, d, "orders").selectExpr("o_orderkey", t("DAYNAME(o_orderdate)", "mysql") + " AS dn", t("MONTHNAME(o_orderdate)", "mysql") + " AS mn", t("QUARTER(o_orderdate)", "mysql") + " AS q", t("LAST_DAY(o_orderdate)", "mysql") + " AS ld", t("DATEDIFF(o_orderdate, '1990-01-01')", "mysql") + " AS dd")


@query("f4_mysql_json", "SELECT event_id, (props::JSON->>'k') AS k, true AS ok FROM events")
def f4(spark, d):
    t = dialect.translate
    return load(spark, d, "events").selectExpr("event_id", t("JSON_UNQUOTE(JSON_EXTRACT(props, '$.k'))", "mysql") + " AS k", t("JSON_VALID(props)", "mysql") + " AS ok")


@query("f6_postgres_operators", "SELECT c_custkey, c_custkey::VARCHAR || '/' || c_mktsegment AS s, c_mktsegment IN ('BUILDING', 'MACHINERY') AS m, c_name ILIKE '%1%' AS l FROM customer WHERE c_name LIKE 'C%'")
def f6(spark, d):
    t = lambda x: dialect.translate(x, "postgres")
    return load(spark, d, "customer").filter(t("\"c_name\" ~~ 'C%'")).selectExpr("c_custkey", t("c_custkey::text || '/' || c_mktsegment") + " AS s", t("c_mktsegment = ANY(ARRAY['BUILDING'::text, 'MACHINERY'])") + " AS m", t("c_name ~~* '%1%'") + " AS l")


@query("f9_null_greatest", "SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN NULL ELSE greatest(p_size, 20) END AS my, greatest(nullif(p_size, p_size // 5 * 5), 20) AS pg FROM part")
def f9(spark, d):
    p = load(spark, d, "part").select("p_partkey", F.expr("nullif(p_size, p_size div 5 * 5)").alias("v"))
    return p.selectExpr("p_partkey", dialect.translate("GREATEST(v, 20)", "mysql") + " AS my", dialect.translate("GREATEST(v, 20)", "postgres") + " AS pg").select("p_partkey", F.col("my").cast("int"), F.col("pg").cast("int"))


@query("f10_domain_check", "SELECT p_partkey, regexp_matches(p_brand, '^Brand#[12]') AS a, p_size BETWEEN 5 AND 30 AS b FROM part")
def f10(spark, d):
    return load(spark, d, "part").selectExpr("p_partkey", dialect.domain_check("(VALUE ~ '^Brand#[12]'::text)", "p_brand") + " AS a", dialect.domain_check("((VALUE >= 5) AND (VALUE <= 30))", "p_size") + " AS b")


#: Defaults that a column may be added with, and what a row gets where the default is the same for all.
_DEFAULTS = [("(1 + 2)", "3"), ("'x'", "'x'"), ("now()", None), ("nextval('s')", None), ("upper('a')", "'A'"), ("strange(1)", None)]


@query("f12_volatile_defaults", "SELECT s_suppkey, " + ", ".join(f"{value or 'NULL'}::VARCHAR AS d{i}" for i, (_, value) in enumerate(_DEFAULTS)) + " FROM supplier")
def f12(spark, d):
    """Columns added to every supplier: a default that may give another value each time is not forwarded."""
    out = load(spark, d, "supplier").select("s_suppkey")
    for i, (text, _) in enumerate(_DEFAULTS):
        try:
            out = changes.add_column(out, f"d{i}", "string", text)
        except Refused:
            out = changes.add_column(out, f"d{i}", "string")
    return out


_PG = {
    "a": "btrim(c_name, 'Cr0')", "b": "substr(c_name, -1, 4)", "c": "substr(c_name, c_nationkey - 5)", "e": "left(c_name, -c_nationkey)", "f": "log(c_custkey + 1)", "g": "encode_hex(digest(c_name, 'md5'))",
    "h": "regexp_replace(c_name, '[0-4]+', '-', 'g')", "i": "ltrim(c_name, 'Cus')", "j": "length(c_name)",
}


@query("f7_postgres_functions", """SELECT c_custkey, trim(c_name, 'Cr0') AS a, left(c_name, 2) AS b, substr(c_name, greatest(c_nationkey - 5, 1)) AS c,
    left(c_name, CASE WHEN c_nationkey = 0 THEN 0 ELSE greatest(length(c_name) - c_nationkey, 0) END::INTEGER) AS e, log10(c_custkey + 1) AS f, md5(c_name) AS g,
    regexp_replace(c_name, '[0-4]+', '-', 'g') AS h, ltrim(c_name, 'Cus') AS i, length(c_name)::INTEGER AS j FROM customer""")
def f7(spark, d):
    t = {k: dialect.translate(x.replace("encode_hex(", "hex("), "postgres") for k, x in _PG.items()}
    t["g"] = f"lower({t['g']})"
    return load(spark, d, "customer").selectExpr("c_custkey", *[f"{x} AS {k}" for k, x in t.items()])


@query("f8_digests", "SELECT c_custkey, md5(c_name) AS m, sha1(c_name) AS s, sha256(c_name) AS l FROM customer")
def f8(spark, d):
    t = lambda kind: "lower(hex(" + dialect.translate(f"digest(c_name, '{kind}')", "postgres") + "))"
    return load(spark, d, "customer").selectExpr("c_custkey", t("md5") + " AS m", t("sha1") + " AS s", t("sha256") + " AS l")


@query("f3_mysql_patterns", """SELECT o_orderkey, strftime(o_orderdate::TIMESTAMP, '%Y/%m/%d at %H:%M') AS a, CASE WHEN o_orderkey % 5 < 1 THEN '' ELSE substr(o_orderpriority, (o_orderkey % 5)::INTEGER) END AS b,
    CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE o_orderkey % (o_custkey % 3) END AS c, octet_length(encode(o_orderpriority))::INTEGER AS e FROM orders""")
def f3_patterns(spark, d):
    t = lambda x: dialect.translate(x, "mysql")
    return load(spark, d, "orders").selectExpr("o_orderkey", t("DATE_FORMAT(o_orderdate, '%Y/%m/%d at %H:%i')") + " AS a", t("SUBSTR(o_orderpriority, cast(o_orderkey % 5 as signed))").replace("as bigint", "as int") + " AS b", t("MOD(o_orderkey, o_custkey % 3)") + " AS c", t("LENGTH(o_orderpriority)") + " AS e")


# ---------------------------------------------------------------------------
# Change streams

ROW = "user_id bigint, kind string, amount decimal(12,2)"
#: The events as changes of a table keyed by user: errors delete, clicks update the amount alone, all others insert or replace.
_OPS = "c AS (SELECT event_id AS seq, user_id, event_type, value::DECIMAL(12,2) AS amount, CASE event_type WHEN 'error' THEN 'D' WHEN 'click' THEN 'U' ELSE 'I' END AS op, ts FROM events)"


def change_log(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "events")
    op = F.when(F.col("event_type") == "error", "D").when(F.col("event_type") == "click", "U").otherwise("I")
    amount = F.col("value").cast("decimal(12,2)")
    image = lambda full: F.struct(F.col("user_id"), (F.col("event_type") if full else F.lit(None).cast("string")).alias("kind"), amount.alias("amount"))
    key_only = F.struct(F.col("user_id"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("decimal(12,2)").alias("amount"))
    kind = "struct<user_id:bigint,kind:string,amount:decimal(12,2)>"
    after = F.when(op == "I", image(True).cast(kind)).when(op == "U", image(False).cast(kind))
    present = F.when(op == "I", F.array(F.lit("user_id"), F.lit("kind"), F.lit("amount"))).when(op == "U", F.array(F.lit("user_id"), F.lit("amount")))
    return e.select(F.col("event_id").alias("seq"), op.alias("op"), F.lit("accounts").alias("table"), F.when(op != "I", key_only.cast(kind)).alias("before"), after.alias("after"), present.alias("present"), F.col("ts").alias("commit_ts"))


_STATE = f"""WITH {_OPS}, dead AS (SELECT user_id, max(seq) FILTER (op = 'D') AS gone FROM c GROUP BY 1),
    live AS (SELECT c.* FROM c JOIN dead USING (user_id) WHERE op <> 'D' AND (gone IS NULL OR seq > gone))
    SELECT user_id, arg_max(event_type, seq) FILTER (op = 'I') AS kind, arg_max(amount, seq) AS amount FROM live GROUP BY 1 HAVING count(*) FILTER (op = 'I') > 0"""


def _empty(spark):
    return spark.createDataFrame([], ROW)


@query("t1_idempotent_apply", _STATE)
def t1(spark, d):
    log = change_log(spark, d)
    return changes.apply(changes.apply(_empty(spark), log, ["user_id"]), log, ["user_id"])


@query("t12_compaction_replay", _STATE)
def t12(spark, d):
    return changes.apply(_empty(spark), changes.compact(change_log(spark, d), ["user_id"]), ["user_id"])


@query("t12_compaction", f"WITH {_OPS}, f AS (SELECT user_id, arg_min(op, seq) AS a, max(seq) AS seq, max(seq) FILTER (op = 'D') AS gone, max(seq) FILTER (op = 'I') AS ins FROM c GROUP BY 1), g AS (SELECT user_id, seq, CASE WHEN gone IS NULL THEN CASE WHEN ins IS NULL THEN 'U' ELSE 'I' END WHEN ins > gone THEN 'I' WHEN a <> 'I' THEN 'D' END AS op FROM f) SELECT * FROM g WHERE op IS NOT NULL")
def t12b(spark, d):
    return changes.compact(change_log(spark, d), ["user_id"]).select(F.coalesce("after.user_id", "before.user_id").alias("user_id"), "seq", "op")


@query("t13_image_merge", f"WITH {_OPS} SELECT user_id, arg_max(amount, seq) AS amount, arg_max(event_type, seq) FILTER (op = 'I') AS kind FROM c WHERE op <> 'D' GROUP BY 1 HAVING count(*) FILTER (op = 'I') > 0")
def t13(spark, d):
    return changes.apply(_empty(spark), change_log(spark, d).filter("op <> 'D'"), ["user_id"]).select("user_id", "amount", "kind")


@query("t5_key_lanes", "SELECT count(DISTINCT user_id) AS pairs FROM events")
def t5(spark, d):
    lanes = streams.lanes(change_log(spark, d), ["user_id"], 8)
    return lanes.select(F.coalesce("after.user_id", "before.user_id").alias("u"), "lane").distinct().agg(F.count("*").alias("pairs"))


@query("t7_contiguous_frontier", "WITH g AS (SELECT DISTINCT event_id AS n FROM events WHERE event_id > 5 AND event_id % 97 <> 50) SELECT coalesce((SELECT min(n) FROM g WHERE n + 1 NOT IN (SELECT n FROM g)), 5)::BIGINT AS frontier")
def t7(spark, d):
    return changes.contiguous(load(spark, d, "events").filter("event_id % 97 <> 50"), 5, "event_id")


@query("t8_barriers", "SELECT event_id AS seq, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id)::BIGINT AS segment FROM events")
def t8(spark, d):
    log = load(spark, d, "events").select(F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "T").otherwise("I").alias("op"), F.col("user_id").cast("string").alias("table"))
    return changes.barriers(log).select("seq", "segment")


def moved_log(spark, d) -> DataFrame:
    """Updates of orders: the status of some changes, the key of others."""
    o = load(spark, d, "orders")
    old = F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    new = F.struct(F.when(F.col("o_orderkey") % 11 == 0, -F.col("o_orderkey")).otherwise(F.col("o_orderkey")).alias("id"), F.when(F.col("o_orderkey") % 2 == 0, "F").otherwise(F.col("o_orderstatus")).alias("status"))
    kind = F.when(F.col("o_orderkey") % 5 == 0, "I").when(F.col("o_orderkey") % 5 == 1, "D").otherwise("U")
    kind_of = "struct<id:bigint,status:string>"
    return o.select(F.col("o_orderkey").alias("seq"), kind.alias("op"), F.lit("orders").alias("table"), F.when(kind != "I", old.cast(kind_of)).alias("before"), F.when(kind != "D", new.cast(kind_of)).alias("after"), F.array(F.lit("id"), F.lit("status")).alias("present"), F.col("o_orderdate").alias("commit_ts"))


_MOVED = "m AS (SELECT o_orderkey AS seq, CASE o_orderkey % 5 WHEN 0 THEN 'I' WHEN 1 THEN 'D' ELSE 'U' END AS op, o_orderkey AS id_before, CASE WHEN o_orderkey % 11 = 0 THEN -o_orderkey ELSE o_orderkey END AS id_after, o_orderstatus AS before, CASE WHEN o_orderkey % 2 = 0 THEN 'F' ELSE o_orderstatus END AS after, o_orderdate AS ts FROM orders)"


@query("t9_key_changes", f"WITH {_MOVED} SELECT seq, 0 AS sub, 'D' AS op, id_before AS id FROM m WHERE op = 'U' AND id_before <> id_after UNION ALL SELECT seq, 1, 'I', id_after FROM m WHERE op = 'U' AND id_before <> id_after UNION ALL SELECT seq, 0, op, CASE WHEN op = 'D' THEN id_before ELSE id_after END FROM m WHERE NOT (op = 'U' AND id_before <> id_after)")
def t9(spark, d):
    return changes.split_rekeyed(moved_log(spark, d), ["id"]).select("seq", "sub", "op", F.coalesce("after.id", "before.id").alias("id"))


@query("t10_row_moves", f"WITH {_MOVED}, x AS (SELECT seq, op, op <> 'I' AND before = 'F' AS o, op <> 'D' AND after = 'F' AS n FROM m) SELECT seq, CASE WHEN op = 'I' THEN 'I' WHEN op = 'D' THEN 'D' WHEN o AND n THEN 'U' WHEN n THEN 'I' ELSE 'D' END AS op FROM x WHERE o OR n")
def t10(spark, d):
    return changes.row_moves(moved_log(spark, d), F.col("before.status") == "F", F.col("after.status") == "F").select("seq", "op")


@query("t11_before_images", "SELECT o_orderkey AS seq FROM orders WHERE o_orderkey % 5 <> 0")
def t11(spark, d):
    return changes.require_before(moved_log(spark, d)).filter("op <> 'I'").select("seq")


@query("t15_delayed_apply", "SELECT event_id AS seq FROM events WHERE ts <= (SELECT max(ts) FROM events) - INTERVAL 6 HOURS")
def t15(spark, d):
    log = change_log(spark, d)
    now = log.agg(F.max("commit_ts")).first()[0]
    return changes.delayed(log, now.isoformat(sep=" "), "6 hours").select("seq")


@query("t16_sync_lag", "SELECT greatest(0, epoch_us(TIMESTAMP '2031-05-06 07:08:09.5') / 1e6 - 3 - epoch_us(max(ts)::TIMESTAMP) / 1e6)::DOUBLE AS lag_seconds FROM events")
def t16(spark, d):
    return changes.lag(change_log(spark, d), "2031-05-06 07:08:09.5", "3 seconds", "20000 days")


@query("t17_scope", "SELECT event_type, count(*) AS n FROM events WHERE event_type IN ('view', 'click') GROUP BY 1")
def t17(spark, d):
    log = load(spark, d, "events").withColumn("table", F.col("event_type"))
    return changes.in_scope(log, {"view"}, {"click"}).groupBy("event_type").agg(F.count("*").alias("n"))


@query("t20_prune", "SELECT event_id FROM events WHERE event_id > (SELECT least(min(f), 700) - 20 FROM (SELECT max(event_id) AS f FROM events GROUP BY user_id % 3))")
def t20(spark, d):
    e = load(spark, d, "events")
    consumers = e.groupBy((F.col("user_id") % 3).alias("c")).agg(F.max("event_id").alias("frontier"))
    return changes.prune(e, changes.prune_bound(700, consumers, 20), "event_id").select("event_id")


@query("t22_handoff", _STATE)
def t22(spark, d):
    log = change_log(spark, d)
    return streams.handoff(changes.apply(_empty(spark), log.filter("seq <= 400"), ["user_id"]), log, 400, ["user_id"])


@query("t23_capture_modes", "SELECT o_orderkey AS seq, NULL::VARCHAR AS before_status, CASE WHEN o_orderkey % 2 = 0 AND o_orderstatus <> 'F' THEN 'F' END AS after_status, 1 + (o_orderkey % 2 = 0 AND o_orderstatus <> 'F')::INTEGER AS n_present FROM orders WHERE o_orderkey % 5 > 1 AND o_orderkey % 11 <> 0")
def t23(spark, d):
    log = moved_log(spark, d).filter("op = 'U' AND seq % 11 <> 0")
    b, a, p = changes.capture(F.col("before"), F.col("after"), ["id", "status"], ["id"], "minimal")
    return log.select("seq", b["status"].alias("before_status"), a["status"].alias("after_status"), F.size(p).alias("n_present"))


@query("t3_stream_apply", _STATE)
def t3(spark, d):
    path = scratch(spark)
    log = change_log(spark, d)
    log.repartitionByRange(4, "seq").sortWithinPartitions("seq").write.parquet(f"{path}/log")
    stream = spark.readStream.schema(log.schema).parquet(f"{path}/log")
    target = streams.Target(spark, f"{path}/table", _empty(spark).schema, ["user_id"])
    streams.start(stream, target, f"{path}/checkpoint").awaitTermination()
    target.apply(log, 0)  # a batch that is there already changes nothing
    return target.read()


@query("t6_gap_free", """WITH h AS (SELECT min(event_id) AS lo, max(event_id) AS hi, lo + (hi - lo) // 3 AS a, hi - (hi - lo) // 10 AS b FROM events)
    SELECT event_id, CASE WHEN event_id < a THEN 0 WHEN event_id < b THEN 1 ELSE 2 END::INTEGER AS take FROM events, h WHERE event_id NOT IN (a, b)""")
def t6(spark, d):
    """All events but two, taken up to each hole and, once it is settled, on behind it."""
    e = load(spark, d, "events").select("event_id")
    low, high = chunks.bounds(e, "event_id")
    holes = [low + (high - low) // 3, high - (high - low) // 10]
    log, f, out = e.filter(~F.col("event_id").isin(holes)), streams.Frontier(low - 1), None
    for i, settled in enumerate((None, *holes)):
        part = f.take(log, "event_id", settled=settled).withColumn("take", F.lit(i))
        out = part if out is None else out.unionAll(part)
    return out


# ---------------------------------------------------------------------------
# Files, sinks, types


@query("s8_strict_csv", "SELECT event_id::VARCHAR AS event_id, event_type, CASE WHEN event_id % 4 = 0 THEN NULL ELSE props END AS props, CASE WHEN event_id % 2 = 0 THEN '\\N' ELSE 'a, \"b\"' || chr(10) || 'c' END AS note FROM events")
def s8(spark, d):
    """Quoted text that looks like the null marker is data; the bare marker is null."""
    path = scratch(spark)
    q = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    e = load(spark, d, "events")
    line = F.concat_ws(",", F.col("event_id").cast("string"), F.col("event_type"), F.when(F.col("event_id") % 4 == 0, "\\N").otherwise(q(F.col("props"))), q(F.when(F.col("event_id") % 2 == 0, "\\N").otherwise('a, "b"\nc')))
    e.select(line.alias("value")).write.text(path)
    return files.read_csv(spark, f"{path}/*.txt", header=False, null="\\N").toDF("event_id", "event_type", "props", "note")


@query("s11_ndjson", "SELECT event_id::VARCHAR AS id, '1.50E+3' AS n, '[1,{\"k\":0.10}]' AS nested, CASE WHEN event_id % 3 = 0 THEN event_type END AS extra FROM events")
def s11(spark, d):
    path = scratch(spark)
    e = load(spark, d, "events")
    line = F.concat(F.lit('{"id": '), F.col("event_id").cast("string"), F.lit(', "n": 1.50E+3, "nested": [1, {"k": 0.10}]'), F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(', "extra": "'), F.col("event_type"), F.lit('"'))).otherwise(F.lit("")), F.lit("}"))
    e.select(line.alias("value")).write.text(path)
    return files.read_ndjson(spark, f"{path}/*.txt").select("id", "n", "nested", "extra")


@query("s14_sql_dump", "SELECT s_suppkey::VARCHAR AS s_suppkey, s_name, CASE WHEN s_suppkey % 2 = 0 THEN NULL ELSE 'it''s; (a)' END AS note FROM supplier")
def s14(spark, d):
    path = scratch(spark)
    s = load(spark, d, "supplier")
    row = F.concat(F.lit("INSERT INTO `supplier` VALUES\n("), F.col("s_suppkey").cast("string"), F.lit(",'"), F.col("s_name"), F.lit("',"), F.when(F.col("s_suppkey") % 2 == 0, "NULL").otherwise("'it\\'s; (a)'"), F.lit(");"))
    s.select(row.alias("value")).write.text(path)
    return files.read_dump(spark, f"{path}/*.txt", "supplier", ["s_suppkey", "s_name", "note"])


@query("s17_backup_chunks", "SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS c_mktsegment FROM customer")
def s17(spark, d):
    path = scratch(spark)
    c = load(spark, d, "customer").select("c_custkey", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("c_mktsegment"))
    sinks.write_chunks(c, path)
    return tables.read_chunks(spark, path, c.schema)


_EDGES = [100, 5000, 40000]


@query("s1_chunk_predicates", "SELECT " + " + ".join(f"CASE WHEN l_orderkey > {x} THEN 1 ELSE 0 END" for x in _EDGES) + " AS chunk, count(*) AS n, sum(l_partkey)::BIGINT AS parts FROM lineitem WHERE l_quantity > 10 GROUP BY 1")
def s1(spark, d):
    """The predicates that a database would get, each read as a filter of its own: every row lies in one chunk."""
    rows = load(spark, d, "lineitem")
    parts = tables.chunk_predicates(["l_orderkey"], [(x,) for x in _EDGES], "mysql", "l_quantity > 10")
    out = None
    for i, text in enumerate(parts):
        part = rows.filter(text).select(F.lit(i).alias("chunk"), "l_partkey")
        out = part if out is None else out.unionAll(part)
    return out.groupBy("chunk").agg(F.count("*").alias("n"), F.sum("l_partkey").alias("parts"))


@query("k1_parquet_export", "SELECT o_orderkey, o_totalprice::DECIMAL(12,2) AS o_totalprice, o_orderdate::DATE AS o_orderdate FROM orders")
def k1(spark, d):
    path = scratch(spark)
    t = cat.Table("orders", (cat.Column("o_orderkey", typ.SqlType("integer"), False), cat.Column("o_totalprice", typ.SqlType("decimal", precision=12, scale=2)), cat.Column("o_orderdate", typ.SqlType("date"))), key=("o_orderkey",))
    o = load(spark, d, "orders").select("o_orderkey", F.round("o_totalprice", 2).cast("decimal(20,2)").cast("string").alias("o_totalprice"), "o_orderdate")
    sinks.export(spark, {"orders": (o, t)}, path)
    return spark.read.parquet(f"{path}/orders")


@query("k4_upsert", f"WITH {_PAIR} SELECT c_custkey, c_name, c_nationkey FROM b UNION ALL SELECT * FROM a WHERE c_custkey NOT IN (SELECT c_custkey FROM b)")
def k4(spark, d):
    a, b = _sides(spark, d)
    return sinks.upsert(a, b, ("c_custkey",))


@query("k7_exact_values", "SELECT c_custkey, c_acctbal::DECIMAL(10,2) AS dec, 18446744073709551615::DECIMAL(20,0) AS big, '10:00:00.500000' AS tod, '0101' AS bits FROM customer")
def k7(spark, d):
    x = typ.exact
    return load(spark, d, "customer").select("c_custkey", x(F.concat(F.round("c_acctbal", 2).cast("decimal(12,2)").cast("string"), F.lit("000")), typ.SqlType("decimal", precision=10, scale=2)).alias("dec"), x(F.lit("18446744073709551615"), typ.SqlType("integer", unsigned=True)).alias("big"), x(F.lit("10:00:00.5"), typ.SqlType("time")).alias("tod"), x(F.lit("0101"), typ.SqlType("bit", length=4)).alias("bits"))


@query("x2_type_override", "SELECT c_custkey::INTEGER AS c_custkey, c_acctbal::DECIMAL(14,2) AS c_acctbal FROM customer")
def x2(spark, d):
    c = cat.Catalog((cat.Table("customer", (cat.Column("c_custkey", typ.SqlType("integer")), cat.Column("c_acctbal", typ.SqlType("float")))),))
    t = cat.override_types(c, ["customer.c_custkey=int", "customer.c_acctbal=decimal(14,2)"]).table("customer")
    return cat.cast_to(load(spark, d, "customer"), t)


@query("x3_generated_columns", "SELECT c_custkey, lower(c_name) AS c_low FROM customer")
def x3(spark, d):
    t = cat.Table("customer", (cat.Column("c_custkey", typ.SqlType("integer")), cat.Column("c_low", typ.SqlType("text"), generated="upper(c_name)")))
    return cat.generated_columns(load(spark, d, "customer"), t, {"c_low": "lower(c_name)"}).select("c_custkey", "c_low")


@query("x8_sequence_start", "SELECT max(o_orderkey) + 1 AS next FROM orders")
def x8(spark, d):
    return spark.createDataFrame([(cat.sequence_start(load(spark, d, "orders"), "o_orderkey"),)], "next bigint")


@query("x10_metrics_text", "SELECT 'rows_total' AS name, event_type AS label, (count(*) * 1.5)::DOUBLE AS value FROM events GROUP BY event_type")
def x10(spark, d):
    n = load(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    lines = n.select(F.concat(F.lit('rows_total{kind="'), F.col("event_type"), F.lit('"} '), (F.col("n") * 1.5).cast("decimal(20,1)").cast("string")).alias("value")).unionAll(spark.createDataFrame([("# HELP rows_total rows",), ("",)], "value string"))
    return metrics.parse(lines).select("name", F.col("labels")["kind"].alias("label"), "value")


_INFER = {
    "event_type": "event_type", "is_even": "(event_id % 2)::VARCHAR", "is_third": "(event_id % 3)::VARCHAR", "created_at": "strftime(ts::TIMESTAMP, '%Y-%m-%d %H:%M:%S')", "props": "props", "user_uuid": "'550e8400-e29b-41d4-a716-44665544' || lpad((event_id % 10000)::VARCHAR, 4, '0')",
    "bad_id": "'cus_' || user_id", "seen_at": "strftime(ts::TIMESTAMP, '%Y-%m-%d %H:%M:%S') || '+02:00'",
}
_FITS = {
    "is_": ("boolean", "{v} IN ('0', '1')"), "_at": ("timestamp", "TRY_CAST({v} AS TIMESTAMP) IS NOT NULL AND length({v}) = 19"), "seen": ("timestamptz", "regexp_matches({v}, '[+-]\\d\\d:\\d\\d$')"), "props": ("json", "json_valid({v}) AND left({v}, 1) IN ('{{', '[')"), "uuid": ("uuid", "TRY_CAST({v} AS UUID) IS NOT NULL"), "_id": ("uuid", "TRY_CAST({v} AS UUID) IS NOT NULL"),
}


def _infer_sql(name: str, value: str) -> str:
    # one row from all events, whether or not the name suggests anything
    tests = "WHEN count(v) = 0 THEN 'text' " + " ".join(f"WHEN bool_and({ok.format(v='v')}) THEN '{kind}'" for part, (kind, ok) in _FITS.items() if part in name)
    return f"SELECT '{name}' AS name, CASE {tests} ELSE 'text' END AS type FROM (SELECT {value} AS v FROM events)"


@query("infer_types", " UNION ALL ".join(_infer_sql(*x) for x in _INFER.items()))
def inferred(spark, d):
    e = load(spark, d, "events").select("event_type", (F.col("event_id") % 2).cast("string").alias("is_even"), (F.col("event_id") % 3).cast("string").alias("is_third"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("created_at"), "props", F.concat(F.lit("550e8400-e29b-41d4-a716-44665544"), F.lpad((F.col("event_id") % 10000).cast("string"), 4, "0")).alias("user_uuid"), F.concat(F.lit("cus_"), F.col("user_id").cast("string")).alias("bad_id"), F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("+02:00")).alias("seen_at"))
    return spark.createDataFrame(sorted(infer.infer(e).items()), "name string, type string")



_TX = """p AS (SELECT event_id, event_type = 'purchase' AS c, row_number() OVER (ORDER BY event_id) AS pos FROM events),
    q AS (SELECT event_id, coalesce(max(CASE WHEN c THEN pos END) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p),
    b AS (SELECT event_id AS seq, CASE WHEN event_id <= (SELECT max(event_id) FROM p WHERE c) THEN before // 50 END::BIGINT AS batch FROM q)"""


def transactions(spark, d) -> DataFrame:
    """The events as a log in which a purchase is the commit of what came before it."""
    e = load(spark, d, "events")
    return e.select(F.col("event_id").alias("seq"), F.when(F.col("event_type") == "purchase", "C").otherwise("I").alias("op"))


@query("t2_transaction_batches", f"WITH {_TX} SELECT * FROM b")
def t2(spark, d):
    return changes.transaction_batches(transactions(spark, d), 50).select("seq", "batch")


@query("t24_rollover", f"WITH {_TX} SELECT batch AS generation, min(seq) AS first_seq, max(seq) AS last_seq, count(*) AS rows FROM b WHERE batch IS NOT NULL GROUP BY 1")
def t24(spark, d):
    return sinks.rollover(transactions(spark, d), scratch(spark), 50)


@query("t19_schema_forward", "SELECT c_custkey, 'N/A' AS note, 7::BIGINT AS score, c_mktsegment FROM customer")
def t19(spark, d):
    """Two columns added; one of them twice, as a stream that starts again does."""
    out = load(spark, d, "customer").select("c_custkey", "c_mktsegment")
    for name, kind, default in (("note", "string", "upper('n/a')"), ("score", "bigint", "(3 + 4)"), ("note", "string", "upper('n/a')")):
        out = changes.add_column(out, name, kind, default)
    return out


@query("c6_resume", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders")
def c6(spark, d):
    """A copy that is broken off after one page and goes on behind it."""
    rows, path = load(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), scratch(spark)
    size = max(1, rows.count() // 3)
    sinks.copy_pages(rows, "o_orderkey", size, path, most_pages=1)
    sinks.copy_pages(rows, "o_orderkey", size, path)
    return sinks.read_pages(spark, path)


@query("x6_materialised_view", "SELECT c_nationkey, count(*) AS n, min(c_custkey) AS first FROM customer GROUP BY 1")
def x6(spark, d):
    view = sinks.MaterialisedView(spark, scratch(spark), ("c_nationkey",))
    people = load(spark, d, "customer").groupBy("c_nationkey")
    view.refresh(people.agg(F.count("*").alias("n"), F.max("c_custkey").alias("first")))
    view.refresh(people.agg(F.count("*").alias("n"), F.min("c_custkey").alias("first")), concurrently=True)
    return view.read()
