import pytest
from ferrule.errors import Refused
from ferrule.functions import predicate as p
from ferrule.functions.dialect import translate
from pyspark.sql import functions as F
from pyspark.sql import types as T


@pytest.fixture(scope="module")
def row(spark):
    df = spark.createDataFrame([(1, "EU ", 1.5, True, None)], "id int, region string, ratio double, live boolean, gone string")
    return df.withColumn("d", F.lit("2024-03-01").cast("date")).withColumn("ts", F.lit("2024-03-01 10:00:00.123456").cast("timestamp_ntz"))


@pytest.mark.parametrize(
    "text, rows",
    [
        ("id = 1 AND (region = 'EU ' OR id > 5)", 1), ("NOT id = 2", 1), ("gone = 'x'", 0), ("NOT gone = 'x'", 0), ("gone IS NULL", 1), ("gone IN ('a')", 0),
        ("id NOT IN (2, NULL)", 0), ("live = TRUE", 1), ('"REGION" <> \'US\'', 1), ("`id`=1.0", 1), ("ratio >= 1.5", 1), ("d = '2024-03-01'", 1), ("ts <= '2024-03-01 10:00:00.123456'", 1), ("id = 99999999999999999999", 0),
    ],
)
def test_rows(row, text, rows):
    assert p.where(row, text).count() == rows


@pytest.mark.parametrize("text", ["", "id", "id =", "id = 1 AND", "(id = 1", "id LIKE 'x'", "id = 'x'", "nope = 1", "ratio = 1.5", "ratio IN (1)", "d = '2024-03-01 10:00:00'", "d = '2024-02-30'", "ts = '2024-03-01 10:00:00.1234567'", "live = 3", "region = 5", "id = 1; drop", "region BETWEEN 'a' AND 'b'"])
def test_refused(row, text):
    with pytest.raises(Refused):
        p.where(row, text)


@pytest.mark.parametrize(
    "collation, value, matches",
    [("utf8mb4_general_ci", "eu", True), ("utf8mb4_general_ci", "EU", True), ("utf8mb4_bin", "EU", True), ("utf8mb4_bin", "eu", False), ("utf8mb4_0900_ai_ci", "EU", False), ("utf8mb4_0900_ai_ci", "eu ", True), ("C", "EU", False), ("C", "EU ", True)],
)
def test_collations(row, collation, value, matches):
    col = p.Col(T.StringType(), collation=collation)
    assert p.where(row, f"region = '{value}'", region=col).count() == matches
    with pytest.raises(Refused):
        p.where(row, "region = 'x'", region=p.Col(T.StringType(), collation="klingon_ci"))


def test_collation_refusals(row):
    ci = p.Col(T.StringType(), collation="utf8mb4_general_ci")
    for bad, rules in ((p.Col(T.StringType(), charset="latin1"), p.Rules()), (ci, p.Rules(strict_collation=True)), (p.Col(T.StringType(), generated=True), p.Rules())):
        with pytest.raises(Refused):
            p.where(row, "region = 'x'", rules, region=bad)
    with pytest.raises(Refused):
        p.where(row, "region < 'x'", region=ci)


@pytest.mark.parametrize(
    "lens, text, digits, expected",
    [("cast", "2024-01-01 00:00:00.0000005", 6, 0), ("cast", "2024-01-01 00:00:00.0000015", 6, 2), ("half_up", "2024-01-01 00:00:00.0000005", 6, 1), ("truncate", "2024-01-01 00:00:00.0000009", 6, 0), ("half_up", "2024-01-01 00:00:00.5", 0, 1_000_000), ("truncate", "2024-01-01 00:00:00.5", 0, 0)],
)
def test_lenses(lens, text, digits, expected):
    from datetime import datetime, timedelta

    assert p.temporal(text, p.Col(T.TimestampNTZType(), digits=digits), lens) == datetime(2024, 1, 1) + timedelta(microseconds=expected)


def test_date_lenses(row):
    assert p.where(row, "d >= '2024-03-01 10:00:00'", p.Rules("cast")).count() == 1
    assert p.where(row, "d >= '2024-03-01 10:00:00'", p.Rules("half_up")).count() == 0


def test_network():
    assert p.network("10.0.0.1/32", "inet") == "10.0.0.1"
    assert p.network("10.0.0.1/8", "inet") == "10.0.0.1/8"
    assert p.network("10.0.0.0/8", "cidr") == "10.0.0.0/8"
    assert p.network("10.0.0.1", "cidr") == "10.0.0.1/32"
    assert p.network("2001:DB8:0:0::1", "address") == "2001:db8::1"
    for text, kind in (("10.0.0.1/8", "cidr"), ("10.0.0.1/8", "address"), ("x", "inet")):
        with pytest.raises(Refused):
            p.network(text, kind)


def test_filters_and_drift():
    assert p.check_filters([("Orders", "a = 1")], ["orders"]) == {"orders": "a = 1"}
    for bad in ([("x", "a = 1")], [("orders", "a = 1"), ("ORDERS", "a = 2")], [("orders", "a =")]):
        with pytest.raises(Refused):
            p.check_filters(bad, ["orders"])
    mark = p.fingerprint({"a": "x = 1", "b": "y = 2"})
    p.check_drift(mark, {"b": "y = 2", "a": "x = 1"})
    with pytest.raises(Refused):
        p.check_drift(mark, {"a": "x = 1"})


def test_push_down(row):
    columns = p.columns_of(row)
    assert p.push_down("id = 1 AND region = 'x' AND live = TRUE", columns) == (True, [])
    fine, why = p.push_down("ratio > 1 AND d = '2024-03-01'", columns)
    assert not fine and len(why) == 2


def test_filter_reaches_the_scan(spark, data):
    df = p.where(spark.read.parquet(f"{data}/orders.parquet"), "o_orderkey > 10 AND o_orderstatus = 'F'").select("o_orderkey")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(o_orderkey,10)" in plan and "EqualTo(o_orderstat" in plan


@pytest.mark.parametrize(
    "kind, text, expected",
    [
        ("address", "::102:304", "::1.2.3.4"), ("inet", "::1.2.3.4/96", "::1.2.3.4/96"), ("inet", "::ffff:a00:1", "::ffff:10.0.0.1"), ("inet", "::2", "::2"), ("inet", "::", "::"),
        ("address", "2001:db8:0:1:2:3:4:5", "2001:db8::1:2:3:4:5"), ("inet", "2001:db8:0:1:2:3:4:5", "2001:db8:0:1:2:3:4:5"), ("address", "1:0:2:0:0:3:4:5", "1:0:2::3:4:5"), ("cidr", "::/96", "::/96"),
    ],
)
def test_addresses_as_servers_print_them(kind, text, expected):
    assert p.network(text, kind) == expected


def test_addresses_with_zones_are_refused():
    with pytest.raises(Refused):
        p.network("fe80::1%eth0", "inet")


def test_general_ci_folds_accents(spark):
    df = spark.createDataFrame([("É ",), ("e",), ("f",)], "s string")
    assert p.where(df, "s = 'e'", s=p.Col(T.StringType(), collation="utf8mb4_general_ci")).count() == 2


@pytest.mark.parametrize(
    "dialect, text",
    [
        ("postgres", "digest(x, 'whirlpool')"), ("postgres", "digest(x, y)"), ("postgres", "regexp_replace(a, 'b', 'c')"), ("postgres", "regexp_replace(a, 'b', '\\1', 'g')"), ("mysql", "date_format(t, p)"),
        ("mysql", "date_format(t, '%U')"), ("postgres", "to_date(x, 'Q')"), ("postgres", "date_format(t, '%Y')"), ("mysql", "mod(a)"),
    ],
)
def test_what_differs_is_refused(dialect, text):
    with pytest.raises(Refused):
        translate(text, dialect)


def test_places_before_the_first(spark):
    """Values as the two servers give them."""
    for dialect, text, expected in [
        ("mysql", "substr('abc', 0)", ""), ("mysql", "substr('abc', -5, 3)", ""), ("mysql", "substr('abc', -2)", "bc"), ("mysql", "mid('abc', 2, 1)", "b"), ("postgres", "substr('abc', 0, 2)", "a"), ("postgres", "substr('abc', -1, 3)", "a"),
        ("postgres", "substr('abc', -5, 3)", ""), ("postgres", "left('abc', -1)", "ab"), ("postgres", "right('abc', -1)", "bc"), ("mysql", "left('abc', -1)", ""), ("postgres", "btrim('xxabyx', 'xy')", "ab"), ("postgres", "rtrim('abxx', 'x')", "ab"),
        ("mysql", "length('é')", "2"), ("postgres", "length('é')", "1"), ("mysql", "mod(3, 0)", None), ("mysql", "date_format(timestamp '2024-03-05 07:08:09', '%Y-%m-%dT%H:%i, %W')", "2024-03-05T07:08, Tuesday"),
    ]:
        assert spark.sql(f"SELECT cast({translate(text, dialect)} AS string) AS v").first().v == expected, text


def test_hazards():
    columns = {"live": p.Col(T.BooleanType()), "d": p.Col(T.DateType()), "t": p.Col(T.TimestampNTZType()), "id": p.Col(T.LongType())}
    told = {t.column: t.hazards for t in p.terms("live = 1 AND d > '2024-01-01 12:00' OR t = '2024-01-01 00:00:00.1234567' AND NOT (id = 3)", columns)}
    assert told == {"live": ("number for a boolean",), "d": ("rounded to its column", "time of day"), "t": ("finer than microseconds", "rounded to its column", "time of day"), "id": ()}
    assert p.terms("gone = 1", columns)[0].hazards == ("unknown column",) and p.terms("d = '2024-01-01' OR live = TRUE", columns)[0].hazards == ()
    assert p.push_down("live = 1", columns)[0] is False and p.push_down("live = TRUE AND gone IS NULL", columns) == (False, ["gone IS NULL: unknown column"])
