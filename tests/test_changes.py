import random

import pytest
from ferrule.errors import Refused
from ferrule.operators import changes as c
from ferrule.streaming import apply as s
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROW = T.StructType([T.StructField("id", T.LongType()), T.StructField("a", T.StringType()), T.StructField("b", T.StringType())])


def frame(spark, rows):
    return spark.createDataFrame(rows, c.schema(ROW))


def change(seq, op, before=None, after=None, present=("id", "a", "b")):
    return (seq, op, "t", before, after, list(present) if after else None, None)


def random_log(seed, n=60):
    """Valid changes and the table they lead to: inserts, partial updates, key changes, deletions, truncations, reused keys."""
    rng, table, log = random.Random(seed), {}, []
    for seq in range(1, n + 1):
        kind = rng.choices(["insert", "update", "rekey", "delete", "truncate"], [5, 5, 2, 3, 0.2])[0]
        if kind == "insert" or not table:
            k = rng.choice([x for x in range(1, 12) if x not in table] or [seq + 100])
            table[k] = (k, rng.choice("xyz"), rng.choice(["p", None]))
            log.append(change(seq, "I", None, table[k]))
        elif kind == "update":
            k = rng.choice(list(table))
            old, value = table[k], rng.choice(["u", "v", None])
            table[k] = (k, value, old[2])
            log.append(change(seq, "U", old, (k, value, None), ("id", "a")))
        elif kind == "rekey":
            k = rng.choice(list(table))
            new = rng.choice([x for x in range(1, 14) if x not in table] or [seq + 100])
            old = table.pop(k)
            table[new] = (new, old[1], "r")
            log.append(change(seq, "U", old, (new, None, "r"), ("id", "b")))
        elif kind == "delete":
            k = rng.choice(list(table))
            log.append(change(seq, "D", table.pop(k)))
        else:
            table.clear()
            log.append(change(seq, "T"))
    return log, table


@pytest.mark.parametrize("seed", range(6))
def test_apply_and_compact_agree_with_a_model(spark, seed):
    log, table = random_log(seed)
    changes, empty = frame(spark, log), spark.createDataFrame([], ROW)
    rows = lambda df: {r.id: (r.id, r.a, r.b) for r in df.collect()}
    final = c.apply(empty, changes, ["id"])
    assert rows(final) == table
    assert rows(c.apply(final, changes, ["id"])) == table, "a replay changes nothing"
    small = c.compact(changes, ["id"])
    assert small.count() <= changes.count() + sum(x[1] == "U" for x in log)
    assert rows(c.apply(empty, small, ["id"])) == table
    # split anywhere: the table in between and the rest
    half = c.apply(empty, changes.filter("seq <= 30"), ["id"])
    assert rows(c.apply(half, c.compact(changes.filter("seq > 30"), ["id"]), ["id"])) == table


def test_insert_rekey_delete_is_nothing(spark):
    log = [change(1, "I", None, (1, "x", "y")), change(2, "U", (1, "x", "y"), (2, "x", "y")), change(3, "D", (2, "x", "y"))]
    assert c.compact(frame(spark, log), ["id"]).count() == 0


def test_absent_is_not_null(spark):
    log = [change(1, "I", None, (1, "x", "y")), change(2, "U", (1, "x", "y"), (1, None, None), ("id", "a"))]
    row = c.compact(frame(spark, log), ["id"]).first()
    assert row.op == "I" and tuple(row.after) == (1, None, "y")


def test_row_moves(spark):
    users = T.StructType([T.StructField("id", T.LongType()), T.StructField("country", T.StringType()), T.StructField("name", T.StringType())])
    base = spark.createDataFrame([(1, "US", "one"), (3, "US", "three")], users)
    p = ["id", "country", "name"]
    log = [
        (1, "I", "u", None, (5, "US", "five"), p, None), (2, "I", "u", None, (6, "CA", "six"), p, None), (3, "D", "u", (1, "US", "one"), None, None, None),
        (4, "U", "u", (5, "US", "five"), (5, "US", "FIVE"), p, None), (5, "U", "u", (3, "US", "three"), (3, "MX", "three"), p, None), (6, "U", "u", (4, "MX", "four"), (4, "US", "four"), p, None),
    ]
    changes = c.require_before(spark.createDataFrame(log, c.schema(users)))
    kept = c.row_moves(changes, F.col("before.country") == "US", F.col("after.country") == "US")
    final = {r.id: r.name for r in c.apply(base, kept, ["id"]).collect()}
    assert final == {4: "four", 5: "FIVE"}
    with pytest.raises(Exception, match="no old row"):
        c.require_before(spark.createDataFrame([(1, "U", "u", None, (1, "US", "x"), p, None)], c.schema(users))).collect()


def test_keyless_is_refused(spark):
    with pytest.raises(Refused):
        c.apply(spark.createDataFrame([], ROW), frame(spark, []), [])
    assert c.compact(frame(spark, [change(1, "D", (1, "x", "y"))]), []).count() == 1


def test_frontier(spark):
    log = spark.createDataFrame([(i,) for i in (1, 2, 3, 5, 6, 9)], "id long")
    f = s.Frontier(0)
    assert sorted(r.id for r in f.take(log).collect()) == [1, 2, 3]
    assert f.take(log).count() == 0
    assert sorted(r.id for r in f.take(log, settled=4).collect()) == [5, 6] and f.last == 6
    assert s.Frontier(20).take(log).count() == 0


def test_lanes_and_checkpoint():
    lanes = s.Lanes()
    for seq, commit in ((2, True), (4, True), (1, False), (3, False)):
        lanes.finish(seq, commit)
        if seq == 1:
            assert (lanes.frontier, lanes.checkpoint()) == (2, 2)
    assert (lanes.frontier, lanes.checkpoint()) == (4, 4)


def test_lag_is_unknown_when_idle(spark):
    log = spark.sql("SELECT 1L AS seq, TIMESTAMP_NTZ '2024-01-01 00:00:00' AS commit_ts")
    assert c.lag(log, "2024-01-01 00:00:10").first().lag_seconds == 10.0
    assert c.lag(log, "2024-01-01 00:10:00").first().lag_seconds is None
    assert c.lag(log, "2024-01-01 00:00:01", "5 seconds").first().lag_seconds == 0.0


def test_schema_versions_of_all_events(spark, tmp_path):
    from ferrule.plans import catalogue

    ids = [-40, *range(900, 1100, 7), 5000, 99_999]
    spark.createDataFrame([(i, "ab"[i % 2]) for i in ids], "event_id bigint, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    anchors = [-40 + 100_040 * (2 * k + 1) // 20 for k in range(10)]
    expected = {i: ("ab"[i % 2], sum(x <= i for x in anchors) - 1 if i >= anchors[0] else None) for i in ids}
    rows = catalogue.QUERIES["w3_schema_at"](spark, f"{tmp_path}").collect()
    assert len(rows) == len(ids) and {x.event_id: (x.table, x.version) for x in rows} == expected


def test_stream_applies_each_batch_once(spark, tmp_path):
    log, table = random_log(3)
    changes = frame(spark, log)
    target = s.Target(spark, f"file://{tmp_path}/table", ROW, ["id"])
    for part, (a, b) in enumerate(((1, 20), (21, 40), (41, 60))):
        changes.filter(f"seq BETWEEN {a} AND {b}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
        stream = spark.readStream.schema(changes.schema).parquet(f"{tmp_path}/log")
        s.start(stream, target, f"{tmp_path}/checkpoint").awaitTermination()
        assert not target.apply(changes, part)
    assert {r.id: (r.id, r.a, r.b) for r in target.read().collect()} == table
