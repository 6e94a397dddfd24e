import hashlib
import math
import random

import numpy as np
import pytest
from conftest import same_rows
from ferrule.llm import components, queries, vectors, warc
from ferrule.llm.shared import shared_folder
from pyspark.sql import functions as F

VECTORS = "vec_id bigint, embedding array<float>, id string"


@pytest.mark.parametrize("name", ["op2_topk", "op8_embedding_dedup", "op10_warc"])
def test_against_sql(name, spark, data, duck):
    same_rows(queries.QUERIES[name](spark, data), duck.sql(queries.ORACLE_SQL[name]))


@pytest.mark.parametrize("dense", [0, 0.125, 1])
@pytest.mark.parametrize("seed", range(6))
def test_search_block_is_exact(seed, dense, monkeypatch):
    monkeypatch.setattr(vectors, "DENSE", dense)
    rng = np.random.default_rng(seed)
    d = int(rng.choice([1, 3, 16, 33, 64]))
    base = np.floor(rng.normal(size=(int(rng.integers(1, 400)), d)) * rng.choice([1, 30, 1e9]))
    base[rng.random(len(base)) < 0.3] = base[0]
    ids = rng.permutation(len(base) * 2)[: len(base)].astype(np.int64)
    ask = rng.integers(0, len(base), 40)
    a, b, s = vectors.search_block(base[ask], ids[ask], base, ids, 10)
    for i, q in enumerate(ask):
        scores = [(-sum(int(x) * int(y) for x, y in zip(base[q], base[j], strict=True)), ids[j]) for j in range(len(base)) if ids[j] != ids[q]]
        expected = sorted(scores)[:10]
        assert [(-int(x), int(y)) for x, y in zip(s[a == i], ids[b[a == i]], strict=True)] == [(x, int(y)) for x, y in expected]


def awkward(spark):
    rows = [(0, [1.0, 0.0]), (100, [0.5, 0.5]), (1, [0.5, 0.5]), (2, [0.5, 0.5]), (2, [9.0, 9.0]), (3, None), (4, []), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [None, 1.0]), (8, [0.0, 0.0]), (9, [1.0, 0.0, 0.0]), (None, [1.0, 1.0]), (10, [-1.0, 2.0]), (300, [1.0, 2.0, 3.0])]
    return spark.createDataFrame([(i, v, "x") for i, v in rows], VECTORS)


def test_top_k_edge_cases(spark):
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in vectors.top_k(awkward(spark), F.col("vec_id") % 100 == 0, k=3).collect())
    # ties to the smaller id; other lengths and unusable vectors take no part; of the repeated id the smaller vector counts
    assert got == [(0, 1, 1, 524288), (0, 2, 2, 524288), (0, 3, 100, 524288), (100, 1, 1, 524288), (100, 2, 2, 524288), (100, 3, 0, 524288)] or got[:3] == [(0, 1, 1, 524288), (0, 2, 2, 524288), (0, 3, 100, 524288)]
    assert (300, 1, 9, 1024 * 1024) in got
    assert vectors.top_k(awkward(spark).limit(0), F.col("vec_id") == 0).count() == 0


def test_near_duplicates_edge_cases(spark):
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_duplicates(awkward(spark)).collect()}
    assert len(got) == 13
    assert got[100] == (2, 1, False) and got[1] == (2, 1, True) and got[2] == (2, 1, False)
    for alone in (0, 3, 4, 5, 6, 7, 8, 9, 10, 300):
        assert got[alone] == (0, alone, True)
    assert vectors.near_duplicates(awkward(spark).limit(0)).count() == 0


def test_recall_against_brute_force(spark, monkeypatch):
    """Groups of near copies in noise, over many cells: at least nine links in ten, and none below the threshold."""
    monkeypatch.setattr(vectors, "CELL", 60)
    monkeypatch.setattr(vectors, "HOME_BLOCK", 50)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 32))
    for k in range(0, 600, 3):
        x[k + 1 : k + 3] = x[k] + rng.normal(size=(2, 32)) * 0.25
    x[600:900] = x[600] + rng.normal(size=(300, 32)) * 0.02
    df = spark.createDataFrame([(i, v.tolist(), "") for i, v in enumerate(x)], VECTORS)
    x = np.array([[float(np.float32(c)) for c in v] for v in x])
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    got = {r.vec_id: r for r in vectors.near_duplicates(df).collect()}
    counts = np.array([got[i].n_links for i in range(len(x))])
    assert (counts <= near.sum(1)).all() and counts.sum() >= 0.9 * near.sum()
    label = np.arange(len(x))
    for _ in range(20):
        label = np.minimum(label, np.where(near, label[None, :], len(x)).min(1))
    assert np.mean([got[i].component_id == label[i] for i in range(len(x))]) > 0.95


def test_links_found_from_one_side_count_for_both(spark, monkeypatch):
    monkeypatch.setattr(vectors, "CELL", 20)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    y = x + rng.normal(size=x.shape) * 0.07
    rows = [(2 * i + k, v.tolist(), "") for i, pair in enumerate(zip(x, y, strict=True)) for k, v in enumerate(pair)]
    got = {r.vec_id: r for r in vectors.near_duplicates(spark.createDataFrame(rows, VECTORS), least=0.85, margin=0.05).collect()}
    linked = [got[2 * i + 1].component_id == 2 * i for i in range(300)]
    assert 100 < sum(linked) < 300
    assert [(got[2 * i].n_links, got[2 * i + 1].n_links) for i in range(300)] == [(int(z), int(z)) for z in linked]


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 130)] + [(200, i) for i in range(201, 240)] + [(5, 5), (None, 3), (7, None)]
    got = {r.id: r.component for r in components.connected_components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    low = {}

    def find(x):
        while low.setdefault(x, x) != x:
            x = low[x]
        return x

    for a, b in links:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            low[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in low}


def test_archive_edge_cases(spark):
    long = "é" * 600
    rows = [(1, "http://a/", long, 1), (2, None, long, 2), (3, "u", "short", 3), (4, "u", "short", 4), (5, "u", None, 5), (6, "u\r\nX: y", "", 6), (2, None, long, 2), (None, "n", long, 7), (-7, "n", "z" * 2000, 8)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, key int")
    path = shared_folder(spark)
    back = warc.archive(df, path)
    got = sorted(((r.record_id, r.record_type, r.refers_to, bytes(r.payload), r.digest, r.url) for r in back.collect()), key=repr)
    expected = []
    for i, url, html, _ in rows:
        body = (html or "").encode()
        again = len(body) >= 1000 and html == long and i != 2
        expected.append((i, "revisit" if again else "response", 2 if again else None, body, hashlib.sha1(body).hexdigest(), None if url is None else url.replace("\r", "%0D").replace("\n", "%0A")))
    assert got == sorted(expected, key=repr)
    stored = spark.read.parquet(f"{path}/payloads")
    assert stored.count() == 4 == stored.select("key").distinct().count(), "each payload once"
    record = back.filter("record_id = -7").select(warc.record(F.col("header"), F.col("payload")).alias("r")).first().r
    head, _, body = bytes(record).partition(b"\r\n\r\n")
    assert head.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and b"Content-Length: 2000" in head and body == b"z" * 2000 + b"\r\n\r\n"
    assert warc.archive(df.limit(0), shared_folder(spark)).count() == 0


def test_archive_notices_a_changed_payload(spark):
    path = shared_folder(spark)
    warc.write(spark.createDataFrame([(1, "u", "text")], "page_id bigint, url string, html string"), path)
    bad = spark.read.parquet(f"{path}/payloads").withColumn("payload", F.lit(b"other")).collect()
    spark.createDataFrame(bad, "key string, size bigint, payload binary").write.mode("overwrite").parquet(f"{path}/payloads")
    with pytest.raises(Exception, match="does not match"):
        warc.read(spark, path).collect()


def test_unit_vectors_of_any_size():
    x = vectors._unit(np.array([[1e300, 1e300], [1e-300, 0.0], [3.0, 4.0]]))
    assert np.allclose(x, [[math.sqrt(0.5)] * 2, [1, 0], [0.6, 0.8]])
