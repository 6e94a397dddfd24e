import random

import pytest
from ferrule.errors import Refused
from ferrule.operators import changes as c
from ferrule.sources import sinks, tables
from ferrule.streaming import apply as s
from ferrule.types import Capabilities
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROW = T.StructType([T.StructField("id", T.LongType()), T.StructField("v", T.StringType())])


def put(seq, k, v):
    return (seq, "I", "t", None, (k, v), ["id", "v"], None)


def commit(seq):
    return (seq, "C", "t", None, None, None, None)


@pytest.mark.parametrize("seed", range(3))
def test_transactions_stay_whole(spark, seed, monkeypatch):
    monkeypatch.setattr(c, "PIECE", 7)
    rng = random.Random(seed)
    seqs = sorted(rng.sample(range(-50, 400), 90))
    log = [(x, rng.choice("IIIC")) for x in seqs]
    last = max((x for x, op in log if op == "C"), default=None)
    expected, start = {}, 0
    for i, (x, op) in enumerate(log):
        expected[x] = start // 10 if last is not None and x <= last else None
        if op == "C":
            start = i + 1
    got = c.transaction_batches(spark.createDataFrame(log, "seq bigint, op string"), 10)
    assert {r.seq: r.batch for r in got.collect()} == expected


def test_transactions_without_rows_or_commits(spark):
    kind = "seq bigint, op string"
    assert c.transaction_batches(spark.createDataFrame([], kind), 5).count() == 0
    assert [r.batch for r in c.transaction_batches(spark.createDataFrame([(1, "I")], kind), 5).collect()] == [None]
    with pytest.raises(Refused):
        c.transaction_batches(spark.createDataFrame([], kind), 0)


@pytest.mark.parametrize("folder", [1, 20, 1 << 18])
def test_small_generations_share_folders(spark, tmp_path, monkeypatch, folder):
    """However finely a log is cut, a folder takes about as many of its rows as it is said to."""
    monkeypatch.setattr(sinks, "FOLDER_ROWS", folder, raising=False)
    log = spark.range(1, 601).select(F.col("id").alias("seq"), F.when(F.col("id") % 3 == 0, "C").otherwise("I").alias("op"), F.lit(None).cast("string").alias("v"))
    got = sinks.rollover(log, f"file://{tmp_path}/log", 5)
    first = {}
    for seq in range(1, 601):
        first.setdefault((seq - 1) // 3 * 3 // 5, []).append(seq)
    assert {r.generation: (r.first_seq, r.last_seq, r.rows) for r in got.collect()} == {g: (s[0], s[-1], len(s)) for g, s in first.items()}
    per = max(1, folder // 5)
    assert len(list(tmp_path.glob("log/*/*.json.gz"))) == len({g // per for g in first})
    kept = spark.read.schema("_span bigint, generation bigint, seq bigint, op string, v string").json(f"file://{tmp_path}/log").collect()
    assert sorted((r["_span"], r.generation, r.seq, r.op, r.v) for r in kept) == [(g // per, g, x, "C" if x % 3 == 0 else "I", None) for g, s in sorted(first.items()) for x in s]


def test_target_shows_whole_transactions(spark, tmp_path):
    target = s.Target(spark, f"file://{tmp_path}/t", ROW, ["id"])
    frame = lambda rows: spark.createDataFrame(rows, c.schema(ROW))
    rows = lambda: sorted((r.id, r.v) for r in target.read().collect())
    assert target.apply(frame([put(1, 1, "a"), commit(2), put(3, 2, "b")]), 0, transactions=True)
    assert rows() == [(1, "a")]
    assert target.apply(frame([put(4, 1, "c")]), 1, transactions=True)
    assert rows() == [(1, "a")], "the commit has not come"
    assert not target.apply(frame([put(4, 1, "c")]), 1, transactions=True)
    assert target.apply(frame([commit(5), put(6, 9, "z")]), 2, transactions=True)
    assert rows() == [(1, "c"), (2, "b")]


def test_added_columns(spark):
    base = spark.createDataFrame([(1,), (2,)], "id int")
    assert [tuple(r) for r in c.add_column(base, "n", "bigint", "(1 + 2)").orderBy("id").collect()] == [(1, 3), (2, 3)]
    assert c.add_column(base, "ID", "int").columns == ["id"]
    for refused in (dict(name="x", kind="string", default="now()"), dict(name="id", kind="string"), dict(name="x", kind="int", mode="refuse"), dict(name="x", kind="int", mode="other")):
        with pytest.raises(Refused):
            c.add_column(base, **refused)


def test_pace():
    pace = s.Pace(target=1.0, least=10, most=50, step=20, window=4)
    assert pace.percentile() is None
    assert [pace.observe(x) for x in (0.1, -3.0, 0.2)] == [30, 50, 50]
    assert pace.observe(5.0) == 25
    assert pace.observe(0.5) == 45, "times of larger batches are forgotten"
    assert [pace.observe(9.0) for _ in range(4)] == [22, 11, 10, 10]
    with pytest.raises(Refused):
        s.Pace(1.0, least=0)


def test_copy_goes_on_behind_its_cursor(spark, tmp_path):
    path = f"file://{tmp_path}/copy"
    df = spark.createDataFrame([(i, str(i)) for i in range(25)], "k bigint, v string")
    assert sinks.copy_pages(df, "k", 10, path, most_pages=1) == 1
    sinks.replace(df.filter("k < 20"), f"{path}/rows/page=2")  # written, but broken off before its mark
    assert sinks.copy_pages(df, "k", 10, path) == 2
    assert sinks.copy_pages(df, "k", 10, path) == 0
    assert sorted(r.k for r in sinks.read_pages(spark, path).collect()) == list(range(25))
    with pytest.raises(Refused):
        sinks.copy_pages(df.withColumn("w", F.lit(1)), "k", 10, path)
    with pytest.raises(Refused):
        sinks.copy_pages(df.withColumn("k", F.col("k") / 2), "k", 10, f"{path}-other")


def test_views(spark, tmp_path):
    view = sinks.MaterialisedView(spark, f"file://{tmp_path}/view", ("k",))
    with pytest.raises(Refused):
        view.read()
    for n in (1, 2, 3):
        assert view.refresh(spark.createDataFrame([(n, "x")], "k int, v string"), concurrently=True) == n
    for bad in ([(1, "x"), (1, "y")], [(None, "x")]):
        with pytest.raises(Refused):
            view.refresh(spark.createDataFrame(bad, "k int, v string"))
    assert [r.k for r in view.read().collect()] == [3], "a refused version is not shown"
    with pytest.raises(Refused):
        sinks.MaterialisedView(spark, f"file://{tmp_path}/other").refresh(view.read(), concurrently=True)


def test_tables_of_a_database(spark):
    """Spark brings a small database along; its tables are written, read in chunks and replaced."""
    if "derby" not in tables.REGISTRY:
        tables.register(Capabilities("derby", writes=True, pushdown=True))
    url = "jdbc:derby:memory:ferrule;create=true"
    driver = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    rows = [(i, f"it's {i}" if i % 3 else None) for i in range(100)]
    df = spark.createDataFrame(rows, "id bigint, name string")
    sinks.write_jdbc(df.filter("id < 60"), url, "people", **driver)
    sinks.write_jdbc(df.filter("id >= 60"), url, "people", **driver)
    back = tables.read_jdbc(spark, url, "people", ["id"], [(10,), (70,)], where='"id" <> 5', **driver)
    assert back.rdd.getNumPartitions() == 3
    assert sorted(tuple(r) for r in back.collect()) == [r for r in rows if r[0] != 5]
    sinks.write_jdbc(df.limit(1), url, "people", truncate=True, **driver)
    assert tables.read_jdbc(spark, url, "people", **driver).count() == 1
    with pytest.raises(Refused):
        sinks.write_jdbc(df, url, "people", parallel=0)


def test_statement_size():
    assert sinks.rows_per_statement(1024, 3) == 1024
    assert sinks.rows_per_statement(1, 60) == 1000
    assert sinks.rows_per_statement(1 << 30, 100_000) == 1
