import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from ferrule.llm import bpe, packing, queries
from tokenizers import Tokenizer

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(VOCABULARY)


@pytest.fixture(scope="module")
def model():
    return bpe.ByteBpe(bpe.read_spec(VOCABULARY))


def texts(n=4000):
    rng = random.Random(7)
    pools = [lambda: chr(rng.randrange(32, 127)), lambda: rng.choice(" \n\t\r  ' 　"), lambda: chr(rng.choice([rng.randrange(0xA0, 0x3000), rng.randrange(0x1F300, 0x1F6FF), rng.randrange(0x4E00, 0x9FFF), rng.randrange(0, 32)])), lambda: rng.choice(["the", "ing", "<|endoftext|>", "'s", "'ll", "aaaa", "    ", "123", "...", "!!!!", "՘", "\U00010940"]), lambda: rng.choice("aaab")]
    out = ["", " ", "<|endoftext|>", "<|endoftext", "a" * 300, "ab" * 3000, " \n", "\x1c\x1d x"]
    for _ in range(n):
        some = rng.sample(pools, rng.randrange(1, 4))
        out.append("".join(rng.choice(some)() for _ in range(rng.randrange(0, 50))))
    return out


def ids(encoding):
    return np.array(encoding.ids, dtype="<u4").tobytes()


@pytest.mark.parametrize("kind", [bpe.ByteBpe, bpe.LibraryBpe])
def test_encoding_is_the_librarys(library, kind):
    some = texts()
    m = kind(bpe.read_spec(VOCABULARY))
    assert m.encode(some) == [ids(e) for e in library.encode_batch(some, add_special_tokens=False)]


def test_most_words_pass_without_merging_and_failing_ones_are_merged(model):
    model.remembered.clear()
    model.checked = model.merged = 0
    model.encode([" the quick brown fox jumps over the lazy dog and some other common words of English prose"])
    assert model.checked > 10 and model.merged < model.checked / 2
    word = "ererattionwhth"
    proposed = model.greedy(word.encode())
    assert b"".join(model.token_bytes[t] for t in proposed) == word.encode()


def test_small_memory_and_long_texts(library, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 50)
    monkeypatch.setattr(bpe, "LONG_TEXT", 40)
    some = texts(500)
    m = bpe.ByteBpe(bpe.read_spec(VOCABULARY))
    for i in range(0, len(some), 20):
        assert m.encode(some[i : i + 20]) == [ids(e) for e in library.encode_batch(some[i : i + 20], add_special_tokens=False)]


def test_decoding_is_the_librarys(model, library):
    rng = random.Random(3)
    for _ in range(500):
        some = [rng.randrange(50257) for _ in range(15)]
        assert model.decode(np.array(some, dtype="<u4").tobytes()) == library.decode(some, skip_special_tokens=False)


def test_encode_rows(spark, library):
    rows = [(1, None, "x"), (2, "", "x"), (3, "añb c", "y"), (3, "añb c", "y"), (None, "q", "z"), (4, "word " * 50_000, "z")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = bpe.encode(df, VOCABULARY, decoded=True)
    assert got.columns == ["doc_id", "n_tokens", "ids", "text"]
    found = sorted(((r.doc_id, r.n_tokens, bytes(r.ids), r.text) for r in got.collect()), key=repr)
    expected = sorted(((i, len(e.ids), ids(e), t or "") for (i, t, _), e in zip(rows, library.encode_batch([t or "" for _, t, _ in rows], add_special_tokens=False), strict=True)), key=repr)
    assert found == expected
    assert sorted((r.text for r in bpe.decode(got.drop("text"), VOCABULARY).collect()), key=str) == sorted(r[3] for r in found)
    assert bpe.encode(df.limit(0), VOCABULARY).count() == 0


def test_op1(spark, data, library):
    got = {r.doc_id: r for r in queries.op1_bpe(spark, data).collect()}
    docs = spark.read.parquet(f"{data}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        e = library.encode(d.text, add_special_tokens=False)
        assert (got[d.doc_id].n_tokens, got[d.doc_id].ids_sha256) == (len(e.ids), hashlib.sha256(ids(e)).hexdigest())
        assert got[d.doc_id].decoded_sha256 == hashlib.sha256(library.decode(e.ids, skip_special_tokens=False).encode()).hexdigest()


# ---------------------------------------------------------------------------


def check_packed(rows, expected, limit=2048):
    """rows: (doc, start, ids, sequence, offset); expected: doc -> ids."""
    by_doc, by_sequence = {}, {}
    for doc, start, piece, sequence, offset in rows:
        by_doc.setdefault(doc, []).append((start, piece))
        by_sequence.setdefault(sequence, []).append((offset, len(piece) // 4))
    for doc, pieces in by_doc.items():
        whole = b""
        for start, piece in sorted(pieces):
            assert start == len(whole) // 4 and piece
            whole += piece
        assert whole == expected[doc]
    assert set(by_doc) == {d for d, x in expected.items() if x}
    padding = 0
    for pieces in by_sequence.values():
        end = 0
        for offset, n in sorted(pieces):
            assert offset == end
            end += n
        assert 0 < end <= limit
        padding += 0 if end & (end - 1) == 0 else limit - end
    return padding


@pytest.mark.parametrize("seed", range(8))
def test_packer_keeps_all_limits(seed):
    rng = random.Random(seed)
    limits = (rng.choice([8, 64, 256]), rng.choice([2, 5, 1000]), rng.choice([8, 50, 256]))
    p = packing.Packer(*limits, keep_open=rng.choice([1, 3, 20]))
    docs, rows = {}, []
    for _ in range(6):
        batch = []
        for _ in range(rng.randrange(0, 40)):
            n = rng.choice([1, 2, 7, 30, 300, 1000])
            name, loss_from = len(docs), rng.choice([0, 0, n // 2, n])
            docs[name] = (rng.randbytes(4 * n), loss_from)
            batch.append((name, docs[name][0], loss_from))
        rows += p.add(batch)
    rows += p.finish()
    check_packed(rows, {d: x for d, (x, _) in docs.items()}, limits[0])
    segments, loss = {}, {}
    for doc, start, piece, sequence, _ in rows:
        segments[sequence] = segments.get(sequence, 0) + 1
        loss[sequence] = loss.get(sequence, 0) + packing.Packer._loss(start, len(piece) // 4, docs[doc][1])
    assert max(segments.values(), default=0) <= limits[1] and max(loss.values(), default=0) <= limits[2]


def test_op7(spark, data, library):
    got = queries.op7_packing(spark, data).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    expected = {i: np.array([*library.encode(t, add_special_tokens=False).ids, 1], dtype="<u4").tobytes() for i, t in texts.items()}
    rows = []
    for r in got:
        piece = expected[r.doc_id][4 * r.start : 4 * (r.start + r.length)]
        assert len(piece) == 4 * r.length and zlib.crc32(piece) == r.ids_crc32 and r.doc_tokens == len(expected[r.doc_id]) // 4
        rows.append((r.doc_id, r.start, piece, r.sequence_id, r.offset))
    assert check_packed(rows, expected) == 0


def test_pack_edge_cases(spark):
    df = spark.createDataFrame([(1, None, 0), (1, None, 0), (2, "", None), (None, "a b c", 1), (3, "word " * 9000, 5)], "doc_id bigint, text string, start bigint")
    got = packing.pack(df, VOCABULARY, loss_from_col="start").collect()
    assert sum(r.length for r in got) == 1 + 1 + 1 + 4 + 9002 - (9002 - sum(r.length for r in got if r.doc_id == 3))
    assert sum(r.doc_id is None for r in got) >= 1 and all(r.doc_tokens == 1 for r in got if r.doc_id in (1, 2))
    assert packing.pack(df.limit(0), VOCABULARY).count() == 0
    assert {r.doc_id for r in packing.pack(df, VOCABULARY, end_id=None).collect()} == {None, 3}
