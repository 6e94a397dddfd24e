import gzip
import json

import pytest
from ferrule import catalog as cat
from ferrule import types as typ
from ferrule.errors import Refused, Unverified
from ferrule.functions import dialect
from ferrule.operators import chunks, infer, metrics, verify
from ferrule.sources import files, sinks, tables
from pyspark.sql import functions as F
from pyspark.sql import types as T

S = typ.SqlType


def test_every_kind_of_type_is_stored():
    extra = {"array": {"element": S("integer")}, "domain": {"base": S("text")}}
    assert len(typ.KINDS) == 28 and set(typ._SPARK) == set(typ.KINDS)
    for kind in typ.KINDS:
        assert isinstance(typ.spark_type(S(kind, **extra.get(kind, {}))), T.DataType)
    for bad in (lambda: S("money"), lambda: typ.spark_type(S("array")), lambda: typ.spark_type(S("array", element=S("array", element=S("text")))), lambda: typ.spark_type(S("integer", bits=7))):
        with pytest.raises(Refused):
            bad()


@pytest.mark.parametrize(
    "t, expected",
    [
        (S("integer", unsigned=True), "decimal(20,0)"), (S("integer", bits=32, unsigned=True), "bigint"), (S("decimal"), "string"), (S("decimal", precision=50, scale=2), "string"), (S("decimal", precision=10, scale=2), "decimal(10,2)"),
        (S("decimal", precision=5, scale=-2), "decimal(7,0)"), (S("timestamp", tz=True), "timestamp"), (S("datetime"), "timestamp_ntz"), (S("set"), "array<string>"), (S("array", element=S("float", bits=32)), "array<float>"), (S("domain", base=S("domain", base=S("date"))), "date"),
    ],
)
def test_storage(t, expected):
    assert typ.spark_type(t).simpleString() == expected


VALUES = [
    (S("decimal", precision=5, scale=2), ["1.50", "-999.99", "1.5000", "0", ".5", None], ["1000", "1.001", "NaN", "Infinity", "x", ""]),
    (S("integer", unsigned=True), ["0", "18446744073709551615"], ["18446744073709551616", "-1", "1.0"]), (S("integer", bits=8, unsigned=True), ["0", "255"], ["256", "-1"]), (S("integer", bits=24), ["8388607"], ["8388608"]),
    (S("time"), ["00:00:00", "23:59:59.999999", "10:00:00.5000000"], ["24:00:00", "-01:00:00", "10:00:00.0000001"]), (S("bit", length=3), ["010"], ["01", "012", "0101"]), (S("bit", length=3, varying=True), ["", "01"], ["0101"]),
    (S("enum", values=("a", "b")), ["a", None], ["c"]), (S("uuid"), ["550E8400-e29b-41d4-a716-446655440000"], ["550e8400"]), (S("varchar", length=2), ["añ"], ["abc"]), (S("boolean"), ["true", None], ["maybe"]), (S("date"), ["2024-02-29"], ["2023-02-29"]),
]


def test_values_are_exact_or_refused(spark):
    for t, good, bad in VALUES:
        df = spark.createDataFrame([(v,) for v in good], "v string")
        out = [r.x for r in df.select(typ.exact(F.col("v"), t).alias("x")).collect()]
        assert [x is None for x in out] == [v is None for v in good], t
        for v in bad:
            with pytest.raises(Exception):
                spark.createDataFrame([(v,)], "v string").select(typ.exact(F.col("v"), t)).collect()


# ---------------------------------------------------------------------------

ORDERS = cat.Table("orders", (cat.Column("id", S("integer"), False), cat.Column("note", S("text"), False), cat.Column("total", S("decimal", precision=10, scale=2))), key=("id",), indexes=(cat.Index("u", ("note",), unique=True),))


def test_scope():
    names = ["orders", "order_items", "users", "flyway_schema_history", "migrations"]
    assert cat.scope(names, include=["order*"]) == names[:2] and cat.scope(names, include=["user?"]) == ["users"] and cat.scope(names, exclude=["*s"]) == ["flyway_schema_history"]
    for kw in ({"include": ["a"], "exclude": ["b"]}, {"include": ["nothing*"]}):
        with pytest.raises(Refused):
            cat.scope(names, **kw)
    assert cat.is_framework_table("public.flyway_schema_history", []) and not cat.is_framework_table("migrations", ["id"]) and cat.is_framework_table("migrations", ["id", "migration", "batch"])
    app = {"schema_migrations": ["id", "payload"], "migrations": ["id", "migration", "batch", "patient"], "schema_version": ["version", "customer"], "migration": ["version"]}
    assert not any(cat.is_framework_table(n, c) for n, c in app.items())
    assert cat.is_framework_table("schema_migrations", {"Version": "varchar"}) and not cat.is_framework_table("schema_migrations", {"version": "integer"})
    assert cat.is_framework_table("__drizzle_migrations", []) and cat.is_framework_table("migration", ["apply_time", "version"]) and cat.is_framework_table("migrations", ["migration", "batch"])
    books = {"aerich": [], "orders": ["id"]}
    assert cat.application_tables(books) == ["orders"] and cat.application_tables(books, include=["a*"]) == ["aerich"]


def test_near_doubles_and_separators_differ(spark):
    x = spark.createDataFrame([("a|b", "c", 1e-7), ("k", "l", 0.1), ("m", None, 0.5)], "a string, b string, v double")
    y = spark.createDataFrame([("a", "b|c", 1e-7), ("k", "l", 0.1 + 1e-9), ("m", "~", 0.5)], "a string, b string, v double")
    found = verify.verify({"t": x}, {"t": y}, {"t": ["a", "b"]}, mode="full")
    assert found[0].status == "mismatch" and found[0].detail == "1 differs, 2 only_source, 2 only_target"
    assert verify.verify({"t": x}, {"t": x}, {"t": ["a", "b"]}, mode="full")[0].status == "ok"


def test_rewrites(spark):
    c = cat.override_types(cat.Catalog((ORDERS,)), ["ORDERS.total=double", "orders.note=varchar(20)"])
    assert c.table("orders").column("total").type.kind == "float" and c.table("orders").column("note").type.length == 20
    for bad in ("orders.x=int", "nope.id=int", "orders.id", "orders.id=(3)"):
        with pytest.raises(Refused):
            cat.override_types(c, [bad])
    sharded = cat.inject_shard(ORDERS, "shard", S("varchar", length=10))
    assert sharded.key == ("shard", "id") and sharded.columns[0].name == "shard" and ORDERS.key == ("id",) and sharded.indexes[0].columns == ("shard", "note")
    for bad in (lambda: cat.inject_shard(sharded, "SHARD", S("text")), lambda: cat.inject_shard(cat.Table("t", ORDERS.columns), "s", S("text")), lambda: cat.consolidate({}, "s"), lambda: cat.consolidate({"a": spark.range(1)}, "id")):
        with pytest.raises(Refused):
            bad()
    assert cat.namespaces(["a.t", "b.u"], {"a": "x"}) == {"a.t": "x.t", "b.u": "b.u"}
    with pytest.raises(Refused):
        cat.namespaces(["a.t", "b.t"], {"a": "b"})


def test_upsert_key():
    assert cat.upsert_key(ORDERS) == ("id",)
    keyless = cat.Table("t", ORDERS.columns, indexes=ORDERS.indexes)
    assert cat.upsert_key(keyless) == ("note",)
    for index in (cat.Index("u", ("total",), unique=True), cat.Index("u", ("note",), unique=True, partial="x"), cat.Index("u", ("note",))):
        with pytest.raises(Refused):
            cat.upsert_key(cat.Table("t", ORDERS.columns, indexes=(index,)))


def test_comparison():
    other = cat.Table("orders", (cat.Column("id", S("integer")), cat.Column("note", S("json"), False)), key=("id",))
    assert cat.shape_diff(ORDERS, other) == ["missing column total", "column note: type text and json"]
    assert cat.diff(cat.Catalog((ORDERS,)), cat.Catalog(())) == {"orders": ["missing table"]} and cat.render({}) == "no difference"
    d = cat.delta(cat.Catalog((ORDERS,)), cat.Catalog((other, cat.Table("new", ()))))
    assert d.added[0].name == "new" and d.altered[0][0] == "orders" and d.dropped == ()
    assert cat.schema_hash(cat.Catalog((ORDERS,))) != cat.schema_hash(cat.Catalog((other,)))
    history = [(10, ORDERS), (20, other)]
    later = lambda p, q: p >= q
    assert cat.schema_at(history, 15, later) is ORDERS and cat.schema_at(history, 20, later) is other
    contains = lambda p, q: set(q) <= set(p)
    sets = [("a", ORDERS), ("b", other)]
    assert cat.schema_at(sets, "a", contains) is ORDERS
    with pytest.raises(Refused):
        cat.schema_at(sets, "ab", contains)
    with pytest.raises(Refused):
        cat.schema_at(history, 5, later)
    assert any("unconstrained" in x for x in cat.lint(cat.Table("t", (cat.Column("n", S("decimal")),)))) and cat.lint(ORDERS) == ["index u: note needs a prefix length"]


# ---------------------------------------------------------------------------


def write(tmp_path, name, text):
    p = tmp_path / name
    p.write_bytes(text if isinstance(text, bytes) else text.encode())
    return str(p)


def test_csv(spark, tmp_path):
    path = write(tmp_path, "a.csv", '﻿id,name,note\n1,"a, ""b""\nc",\\N\r\n2,"\\N",x\n')
    got = files.read_csv(spark, path, header=True, null="\\N")
    assert got.columns == ["id", "name", "note"] and [tuple(r) for r in got.collect()] == [("1", 'a, "b"\nc', None), ("2", "\\N", "x")]
    assert files.read_csv(spark, write(tmp_path, "b.tsv", "1\t2"), header=False, delimiter="\t").columns == ["col1", "col2"]


@pytest.mark.parametrize("text", ['1,"a', 'a"b,1', '"a"b', "1,2\n3", "1,\n", "a\rb", "x\0y", b"\xff\xfea\0", b"PAR1abc", b"a,\xe9\n", ""])
def test_csv_refusals(spark, tmp_path, text):
    with pytest.raises(Exception):
        files.read_csv(spark, write(tmp_path, "bad.csv", text), header=False).collect()


@pytest.mark.parametrize("header", ["a,,b", "a,A"])
def test_csv_header(spark, tmp_path, header):
    with pytest.raises(Refused):
        files.read_csv(spark, write(tmp_path, "h.csv", header + "\n"), header=True)


def test_ndjson(spark, tmp_path):
    lines = ['{"a": 9007199254740993, "b": {"x": [1.0, -1.5E+300]}}', "", '{"a": null, "c": 0.10000000000000000001, "d": "x\\u00e9"}', "{}", '{"b": -0, "e": []}']
    got = files.read_ndjson(spark, write(tmp_path, "a.json", "\n".join(lines)))
    assert got.columns == ["a", "b", "c", "d", "e"]
    assert [tuple(r) for r in got.collect()] == [("9007199254740993", '{"x":[1.0,-1.5E+300]}', None, None, None), (None, None, "0.10000000000000000001", "xé", None), (None,) * 5, (None, "-0", None, None, "[]")]


@pytest.mark.parametrize("line", ["[1]", "1", '{"a":1,"a":2}', '{"a":1,"A":2}', '{"a":1} x', '{"":1}', '{"a":NaN}', '{"a":{"b":1,"b":2}}', '{"a":'])
def test_ndjson_refusals(line):
    with pytest.raises(Refused):
        files.json_line(line)


def test_dump(spark, tmp_path):
    dump = "-- c;\nCREATE TABLE `t` (`id` bigint unsigned NOT NULL, `v` varchar(10) DEFAULT 'a,b', `w` enum('x','y'), PRIMARY KEY (`id`), KEY k (`v`)) ENGINE=x;\n/* ; */ INSERT INTO `t` VALUES (1,'it''s; \\n\\'x\\'',0xFF),(2,NULL,b'01');\nINSERT INTO u VALUES (1);\nINSERT INTO t (w, id, v) VALUES (_binary 'q', -3.5, CONVERT('z' USING utf8mb4));"
    got = files.read_dump(spark, write(tmp_path, "t.sql", dump), "t", ["id", "v", "w"])
    assert [tuple(r) for r in got.collect()] == [("1", "it's; \n'x'", "ff"), ("2", None, "01"), ("-3.5", "z", "q")]
    assert files.create_table(next(files.statements(dump))) == ("t", [("id", "bigint unsigned", False), ("v", "varchar(10)", True), ("w", "enum('x','y')", True)], ["id"])
    for bad in ("INSERT INTO t VALUES (1", "INSERT INTO t VALUES (1) x", "INSERT INTO t VALUES ('a)", "INSERT INTO t VALUES (foo())"):
        with pytest.raises(Refused):
            [files.insert_rows(s) for s in files.statements(bad)]


@pytest.mark.parametrize("block", [40, 200, 1 << 20])
def test_dump_in_blocks(spark, tmp_path, block):
    """One file is read by several tasks, wherever strings, comments and statements are cut by its blocks."""
    texts = [None, "a", "x;\ny", "it's\n", "-- no\n/* no", "\\", "é`", ");\nINSERT INTO t VALUES (7,'no');\n"]
    rows = [(str(i), texts[i % len(texts)]) for i in range(200)]
    put = lambda v: "NULL" if v is None else "'" + v.replace("\\", "\\\\").replace("'", "''") + "'"
    dump = ""
    for i in range(0, 200, 5):
        dump += ["", "-- it's;\n", "/* ';\n\n` */\n", "INSERT INTO `o;'`\nVALUES (1,'\n');\n"][i % 4] + "INSERT INTO t VALUES\n" + ",\n".join(f"({k},{put(v)})" for k, v in rows[i : i + 5]) + ("; " if i % 2 else ";\n")
    paths = {write(tmp_path, "a.sql", dump), write(tmp_path, "b.sql", dump.rstrip().removesuffix(";") + "\n-- end"), write(tmp_path, "c.sql.gz", dump)}
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    try:
        for path in paths:
            got = files.read_dump(spark, path, "t", ["id", "v"])
            assert sorted(map(tuple, got.collect()), key=str) == sorted(rows, key=str)
            if block == 200 and not path.endswith(".gz"):
                assert got.select(F.spark_partition_id()).distinct().count() > 1
        for bad in ("INSERT INTO t VALUES (1,'x');\n" * 30 + "INSERT INTO t VALUES (1,'x);\n", "/* \n" * 30):
            with pytest.raises(Refused):
                files.read_dump(spark, write(tmp_path, "bad.sql", bad), "t", ["id", "v"])
        for name, blob in (("zero.sql", b"\n" * 600 + b"\0"), ("latin.sql", b"\n" * 300 + b"\xe9"), ("packed.sql.gz", gzip.compress(dump.encode())), ("wide.sql", dump.encode("utf-16"))):
            (tmp_path / name).write_bytes(blob)
            with pytest.raises(Exception):
                files.read_dump(spark, f"file://{tmp_path}/{name}", "t", ["id", "v"]).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_export_is_complete_and_not_repeated(spark, tmp_path, duck):
    path = f"file://{tmp_path}/x"
    df = spark.createDataFrame([("1", "n", "2.50"), ("2", "m", None)], "id string, note string, total string")
    index = sinks.export(spark, {"orders": (df, ORDERS)}, path)
    assert index["tables"]["orders"]["rows"] == 2 and json.loads(sinks.read_text(spark, f"{path}/parquet_index.json")) == index
    assert sorted(duck.sql(f"SELECT id, note, total::VARCHAR FROM read_parquet('{tmp_path}/x/orders/*.parquet')").fetchall()) == [(1, "n", "2.50"), (2, "m", None)]
    with pytest.raises(Refused):
        sinks.export(spark, {"orders": (df, ORDERS)}, path)
    with pytest.raises(Exception):
        sinks.export(spark, {"orders": (df.withColumn("total", F.lit("2.505")), ORDERS)}, path + "2")
    assert not sinks.exists(spark, f"{path}2/parquet_index.json")


def test_backup(spark, tmp_path):
    path, df = f"file://{tmp_path}/b", spark.createDataFrame([(1, None), (2, "x")], "id long, v string")
    sinks.write_chunks(df.coalesce(1), path)
    assert sorted(tuple(r) for r in tables.read_chunks(spark, path, df.schema).collect()) == [(1, None), (2, "x")]
    have = {r.path.rpartition("/")[2]: r.sha256 for r in sinks.file_digests(spark, path).collect()}
    assert sinks.verify_backup(spark, path, have, df.schema, "rows") == []
    name = next(n for n in have if n.endswith(".gz"))
    assert sinks.verify_backup(spark, path, have | {name: "0"}) == [f"changed {name}"] and "missing z" in sinks.verify_backup(spark, path, have | {"z": "0"})
    chain = sinks.Chain(spark, f"file://{tmp_path}/chain")
    assert chain.extend("a", None) == 1 and chain.extend("b", "a") == 2 and chain.tip() == (2, "b")
    with pytest.raises(Refused):
        chain.extend("c", "a")
    m = [{"id": "c", "parent": "b"}, {"id": "a"}, {"id": "b", "parent": "a"}]
    assert [x["id"] for x in tables.chain(m)] == ["a", "b", "c"]
    for bad in (m[:1] + m[1:2], [*m, {"id": "d", "parent": "b"}], m[::2]):
        with pytest.raises(Refused):
            tables.chain(bad)
    assert sinks.identity_copy(spark, path, f"file://{tmp_path}/copy") >= 1
    with pytest.raises(Refused):
        tables.connector("oracle")


# ---------------------------------------------------------------------------


def test_verify(spark):
    a, b = spark.range(10), spark.range(8)
    code = lambda *x, **k: verify.exit_code(verify.verify(*x, **k))
    assert code({"t": a}, {"t": a}, {}) == 0 and code({"t": a}, {"t": b}, {}) == 1 and code({"t": a}, {"t": a, "u": a}, {}) == 1
    assert code({"t": a}, {"t": a}, {}, mode="sample") == 2 and code({"t": a}, {"t": a}, {"t": ["id"]}, mode="sample") == 0 and code({"t": a}, {"t": b}, {"t": ["id"]}, mode="full") == 1
    assert code({"t": a}, {"t": b}, {}, filters={"t": F.col("id") < 5}) == 0
    with pytest.raises(Unverified):
        verify.sample_hashes(a, [])
    x = spark.createDataFrame([("a|b", "c"), ("a", "b|c"), (None, "")], "x string, y string")
    assert x.select(verify.row_hash(x)).distinct().count() == 2 and x.select(verify.row_hash(x, tagged=True)).distinct().count() == 3
    assert "mismatch" in verify.report(verify.verify({"t": a}, {"t": b}, {}))
    assert verify.clamp_chunks(1_000_000, 1000, 4, 8) == 64 and verify.clamp_chunks(10, 1000, 4, 8) == 4


def test_chunks_cover_every_row_once(spark):
    df = spark.range(3, 500, 7)
    low, high = chunks.bounds(df, "id")
    parts = chunks.ranges(low, high, 9)
    assert sum(df.filter(f"id >= {a} AND id < {b}").count() for a, b in parts) == df.count() and chunks.bounds(df.limit(0), "id") is None
    seen = [r.id for p in chunks.pages(df, "id", 20) for r in p.collect()]
    assert sorted(seen) == [r.id for r in df.collect()]
    edges = [r.id for r in chunks.keyset_boundaries(df, ["id"], 5).orderBy("k").collect()]
    sizes = [r["count"] for r in chunks.keyset_chunks(df, "id", edges).groupBy("chunk").count().collect()]
    assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1


def test_infer(spark):
    rows = [("1", "2", "2024-01-01T10:00:00+02:00", "2024-01-01 10:00:00", "2024-01-01 10:00:00", '{"a":1}', "1", '{"a":1,"a":2}', "550e8400-e29b-41d4-a716-446655440000", "x", None), ("0", "x", "2024-01-01 10:00:00Z", "2024-01-01", "2024-01-01 10:00:00Z", "[]", "2", "{}", "550E8400-E29B-41D4-A716-446655440001", "y", None), (None,) * 11]
    names = "is_ok is_bad at_off at_naive at_mixed js_ok js_num js_dup uuid_ok uuid_bad all_null_at".split()
    df = spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))
    found = infer.infer(df)
    assert found == {"is_ok": "boolean", "is_bad": "text", "at_off": "timestamptz", "at_naive": "timestamp", "at_mixed": "text", "js_ok": "json", "js_num": "text", "js_dup": "text", "uuid_ok": "uuid", "uuid_bad": "text", "all_null_at": "text"}
    typed = infer.promote(df, found)
    assert typed.schema["is_ok"].dataType.simpleString() == "boolean" and typed.schema["at_off"].dataType.simpleString() == "timestamp" and typed.collect()[0].is_ok is True
    assert [infer.affinity(x) for x in ("BIGINT", "varchar(3)", "BLOB", "double", "decimal(3)", "charint", "")] == ["integer", "text", "blob", "real", "numeric", "integer", "blob"]


def test_dialect(spark):
    one = lambda text, d: spark.sql("SELECT " + dialect.translate(text, d) + " AS x").first().x
    assert one("CONCAT('a', IFNULL(NULL, 'b'))", "mysql") == "ab" and one("CONCAT('a', NULL, 'b')", "postgres") == "ab" and one("GREATEST(1, NULL)", "mysql") is None and one("GREATEST(1, NULL)", "postgres") == 1
    assert one("('5'::text || 'x')", "postgres") == "5x" and one("'b' = ANY(ARRAY['a'::text, 'b'])", "postgres") is True and one("'AbC' ~~* 'a%'", "postgres") is True and one("5 DIV 2", "mysql") == 2 and one("INET_ATON('1.2.3.4')", "mysql") == 16909060
    assert one("JSON_OBJECT('a', 1)", "mysql") == '{"a":1}' and one("cast('3' as signed)", "mysql") == 3 and one("MID('abcdef', 2, 3)", "mysql") == "bcd"
    for text in ("STRANGE(1)", "x ?? y", "LOAD_FILE('x')", "f(1"):
        with pytest.raises(Refused):
            dialect.translate(text, "mysql")
    assert dialect.requote("\"a\" = 'x\"y'") == "`a` = 'x\"y'" and dialect.split_args("a, f(b, c), 'd,e'") == ["a", "f ( b , c )", "'d,e'"]
    assert dialect.is_volatile("now()") and dialect.is_volatile("CURRENT_TIMESTAMP") and not dialect.is_volatile("'now()'") and not dialect.is_volatile("(1 + 2)::bigint") and dialect.is_volatile("other(1)")
    with pytest.raises(Refused):
        dialect.domain_check("VALUE IN (1, 2)", "x")


def test_metrics(spark):
    lines = ['# c', "", "up 1", 'n{a="x",b="y\\"z"} 2.5 123', "inf +Inf"]
    got = {r.name: (r.labels, r.value) for r in metrics.parse(spark.createDataFrame([(x,) for x in lines], "value string")).collect()}
    assert got["up"] == ({}, 1.0) and got["n"][0]["a"] == "x" and got["inf"][1] == float("inf")
    with pytest.raises(Exception):
        metrics.parse(spark.createDataFrame([("bad line here now",)], "value string")).collect()


def test_only_the_first_record_is_read_ahead(spark, tmp_path):
    # a character over the edge of a block, a byte-order mark, and a header longer than one block
    name = "n" * 65_529 + "é" * 9
    path = write(tmp_path, "wide.csv", "﻿" + f"id,{name}\n1,ü\n")
    df = files.read_csv(spark, path, header=True)
    assert df.columns == ["id", name] and [tuple(r) for r in df.collect()] == [("1", "ü")]
    for bad in ("", "a\0b\n", "id\0,x\n"):
        with pytest.raises(Refused):
            files.read_csv(spark, write(tmp_path, "bad0.csv", bad), header=True)


def test_banners_and_signatures(spark, tmp_path):
    for name, head in (("a", b"-- MySQL dump 10.13\n"), ("b", b"--\n-- PostgreSQL database dump\n--\n"), ("c", b"-- rows\nINSERT"), ("d", b""), ("e", b"\0\0\xfe\xff"), ("f", b"x" * 600 + b"\n-- PostgreSQL database dump"), ("g", b"a" * 257 + b"ustar")):
        (tmp_path / name).write_bytes(head)
    told = {r.path.rpartition("/")[2]: r.what for r in files.signatures(spark, f"file://{tmp_path}").collect()}
    assert told == {"a": "a plain dump of MySQL", "b": "a plain dump of PostgreSQL", "c": None, "e": "UTF-32 text", "f": None, "g": "a tar archive"}
    assert all(files.sniff((tmp_path / n).read_bytes()) == what for n, what in (told | {"d": None}).items())


def test_digests_of_nested_files(spark, tmp_path):
    for folder in ("x", "y z"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "part").write_text(folder)
    have = {r.path: r.sha256 for r in sinks.file_digests(spark, f"file://{tmp_path}").collect()}
    assert set(have) == {"x/part", "y z/part"} and len(set(have.values())) == 2
    (tmp_path / "x" / "part").write_text("other")
    (tmp_path / "y z" / "part").unlink()
    assert sinks.verify_backup(spark, f"file://{tmp_path}", have) == ["missing y z/part", "changed x/part"]


def test_copy_tables(spark, tmp_path):
    good, bad = spark.range(5), spark.range(3).selectExpr("raise_error('broken') AS id")
    assert sinks.copy_tables({"a": good, "b": spark.range(0), "c": good}, f"file://{tmp_path}/x", at_once=2) == {"a": 5, "b": 0, "c": 5}
    assert sinks.copy_tables({}, f"file://{tmp_path}/y") == {}
    with pytest.raises(Exception, match="broken"):
        sinks.copy_tables({"a": good, "b": bad, "c": good}, f"file://{tmp_path}/z", at_once=1)
    assert sinks.exists(spark, f"file://{tmp_path}/z/a") and not sinks.exists(spark, f"file://{tmp_path}/z/c")
    with pytest.raises(Refused):
        sinks.copy_tables({"a": good}, f"file://{tmp_path}/w", at_once=0)
