import hashlib
import hmac
import re

import pytest
from ferrule.errors import Refused
from ferrule.functions import redact as r
from pyspark.sql import functions as F

GOOD = [
    ("mask:pan", "4111111111111111", "411111XXXXXX1111"), ("mask:pan", "378282246310005", "378282XXXXX0005"), ("mask:pan", "4111-1111-1111-1111", "4111-11XX-XXXX-1111"),
    ("mask:pan-relaxed", "4111111111111112", "411111XXXXXX1112"), ("mask:email", "alice@example.com", "aXXXX@example.com"), ("mask:email", '"a@b"@example.com', '"XXXX@example.com'),
    ("mask:ca-sin", "046-454-286", "XXX-XXX-286"), ("mask:ca-sin", "046454286", "XXXXXX286"), ("mask:uk-nin", "AB123456C", "ABXXXXXXC"),
    ("mask:iban", "DE89370400440532013000", "DE8937XXXXXXXXXXXX3000"), ("mask:iban", "DE89 3704 0044 0532 0130 00", "DE89 37XX XXXX XXXX XX30 00"),
    ("mask:uuid", "550e8400-e29b-41d4-a716-446655440000", "550eXXXX-XXXX-XXXX-XXXX-XXXXXXXX0000"), ("mask:ssn", "123-45-6789", "XXX-XX-6789"),
    ("mask:inner:2,2", "abcdef", "abXXef"), ("mask:inner:2,2", "abcd", "abcd"), ("mask:outer:2,2", "abcdef", "XXcdXX"), ("mask:outer:2,2", "abc", "XXX"),
    ("truncate:2", "añb", "añ"), ("truncate:0", "x", ""), ("hash:sha256", "x", hashlib.sha256(b"x").hexdigest()), ("static:z", "x", "z"), ("null", "x", None),
]
BAD = [("mask:pan", "4111111111111112"), ("mask:pan", "12345678901234567890"), ("mask:ssn", "12-34-5678"), ("mask:email", "alice-example.com"), ("mask:email", "@x"), ("mask:ca-sin", "046-454-287"), ("mask:iban", "de89370400440532013000"), ("mask:uuid", "550e8400"), ("mask:uk-nin", "AB123456E")]


def test_masks(spark):
    for spec in dict.fromkeys(s for s, _, _ in GOOD):
        cases = [(i, v, e) for i, (s, v, e) in enumerate(GOOD) if s == spec]
        df = spark.createDataFrame([(i, v) for i, v, _ in cases], "id int, c string")
        got = {x.id: x.c for x in r.Registry({"T.C": spec}).apply(df, "t", ["id"]).collect()}
        assert got == {i: e for i, _, e in cases}, spec


@pytest.mark.parametrize("name", ["r6_mask_inner", "r7_mask_outer"])
def test_whole_texts_are_masked(spark, data, tmp_path, name):
    from ferrule.plans import catalogue

    texts = ["ä😀" * n + "z" * m for n in range(5) for m in range(2)] + ["x" * 20_000, None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {x.id: x.v for x in catalogue.QUERIES[name](spark, f"{tmp_path}").collect()}
    inner = [t if t is None or len(t) <= 5 else t[:3] + "*" * (len(t) - 5) + t[-2:] for t in texts]
    outer = [t if t is None else "X" * len(t) if len(t) <= 5 else "XXX" + t[3:-2] + "XX" for t in texts]
    assert got == dict(enumerate(inner if "inner" in name else outer))
    chars = spark.read.parquet(f"{data}/documents.parquet").agg(F.sum(F.length("text"))).first()[0]
    assert catalogue.QUERIES[name](spark, data).agg(F.sum(F.length("v"))).first()[0] == chars


@pytest.mark.parametrize("spec, value", BAD)
def test_malformed_values_stop_the_job_without_showing_them(spark, spec, value):
    df = spark.createDataFrame([(1, value)], "id int, c string")
    with pytest.raises(Exception) as e:
        r.Registry({"t.c": spec}).apply(df, "t", ["id"]).collect()
    assert "not of the form" in str(e.value)


def test_nulls(spark):
    specs = ["mask:ssn", "mask:pan", "mask:email", "mask:inner:1,1", "hash:sha256", "truncate:3", "randomize:uuid", "mask:iban"]
    df = spark.createDataFrame([(1, None)], "id int, c string")
    for spec in specs:
        assert r.Registry({"t.c": spec}).apply(df, "t", ["id"]).first().c is None
    assert r.Registry({"t.c": "static:x"}).apply(df, "t", ["id"]).first().c == "x"


@pytest.mark.parametrize("key", [b"k", b"x" * 64, b"y" * 200])
def test_hmac(spark, key):
    df = spark.createDataFrame([("",), ("añ",), ("x" * 300,)], "c string")
    for row in df.select("c", r.hmac_sha256(F.col("c"), key).alias("h")).collect():
        assert row.h == hmac.new(key, row.c.encode(), "sha256").hexdigest()


def luhn(s):
    digits = [int(c) for c in reversed(s)]
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)) % 10 == 0


FORMS = {
    "randomize:email": r"[a-z]{6,12}@[a-z]{5,10}\.test", "randomize:us-phone": r"[2-9]\d\d-[2-9]\d\d-\d{4}", "randomize:uuid": r"[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}",
    "randomize:ssn": r"(?!666)[0-8]\d\d-\d\d-\d{4}", "randomize:pan:visa": r"4\d{15}", "randomize:pan:mastercard": r"5\d{15}", "randomize:pan:amex": r"3[47]\d{13}", "randomize:ca-sin": r"[1-79]\d{8}",
    "randomize:uk-nin": r"[A-Z]{2}\d{6}[A-D]", "randomize:iban:DE": r"DE\d{20}", "randomize:iban:GB": r"GB\d\d[A-Z]{4}\d{14}", "randomize:iban:FR": r"FR\d{25}",
}


@pytest.mark.parametrize("spec", FORMS)
def test_random_values(spark, spec):
    df = spark.range(300).select("id", F.lit("x").alias("c"))
    rules = r.Registry({"t.c": spec}, stream="s")
    got = [x.c for x in rules.apply(df, "t", ["id"]).orderBy("id").collect()]
    assert got == [x.c for x in rules.apply(df.repartition(3), "T", ["id"]).orderBy("id").collect()]
    assert len(set(got)) > 290 and all(re.fullmatch(FORMS[spec], v) for v in got)
    if "pan" in spec or "sin" in spec:
        assert all(luhn(v) for v in got)
    if "iban" in spec:
        assert all(int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1 for v in got)
    if spec == "randomize:us-phone":
        assert not any(v.startswith("555") for v in got)


def test_tokens_are_the_same_everywhere(spark):
    keys = r.Keyset.read("k:1:00ff\nk:2:0a0b  # newer\n")
    rules = r.Registry({"a.x": "tokenize:dict:d:k", "b.y": "tokenize:dict:d:k"}, keys, {"d": [" one ", "two", "", "three"]})
    a = rules.apply(spark.createDataFrame([("v",), (None,)], "x string"), "a").collect()
    b = rules.apply(spark.createDataFrame([("v",)], "y string"), "b").collect()
    assert a[0].x == b[0].y and a[0].x in ("one", "two", "three") and a[1].x is None
    digest = hmac.new(b"\x0a\x0b", b":d:v", "sha256").digest()
    assert a[0].x == ["one", "two", "three"][int.from_bytes(digest[:8], "little") % 3]


def test_refusals(spark):
    df = spark.createDataFrame([(1, "x", 2)], "id int, c string, n int")
    for rules, key in (({"t.zzz": "null"}, ["id"]), ({"t.c": "randomize:uuid"}, None), ({"t.n": "hash:sha256"}, ["id"]), ({"t.c": "randomize:int:1,2"}, ["id"])):
        with pytest.raises(Refused):
            r.Registry(rules).apply(df, "t", key)
    for spec in ("mask:nope", "hash:md5", "truncate:x", "randomize:int:5,1", "randomize:pan:diners", "randomize:dict:nope", "hash:hmac-sha256:nokey", ""):
        with pytest.raises(Refused):
            r.strategy(spec)
    for text in ("a:1:zz", "a:1", "a:1:00\na:1:01"):
        with pytest.raises(Refused):
            r.Keyset.read(text)
    assert "00ff" not in repr(r.Keyset.read("k:1:00ff"))


def test_keys_and_dictionaries_from_outside(spark, tmp_path, monkeypatch):
    (tmp_path / "k").write_text("a:1:00\na:3:03\n")
    monkeypatch.setenv("SOME_KEYS", "a:2:02")
    assert r.Keyset.load(spark, f"file:file://{tmp_path}/k").get("a") == b"\3" and r.Keyset.load(spark, "env:SOME_KEYS").get("a") == b"\2"
    (tmp_path / "empty").write_text("# none\n")
    for source in ("env:NOT_SET_ANYWHERE", f"file:file://{tmp_path}/empty", "vault:x", "file:", "a:1:00"):
        with pytest.raises(Refused):
            r.Keyset.load(spark, source)
    assert "00" not in repr(r.Keyset.load(spark, f"file:file://{tmp_path}/k"))
    (tmp_path / "d").write_text(" x \n\ny\n")
    assert r.dictionary_file(spark, f"file://{tmp_path}/d") == ["x", "y"]
    (tmp_path / "blank").write_text("\n \n")
    with pytest.raises(Refused):
        r.dictionary_file(spark, f"file://{tmp_path}/blank")
