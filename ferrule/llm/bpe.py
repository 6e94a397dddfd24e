"""Byte-level BPE: speculate, verify, merge.

A word (as the vocabulary's splitting pattern cuts it) is first cut greedily into longest vocabulary entries.  That proposal is
the encoding exactly if every adjacent pair of tokens is compatible, i.e. if merging by rank would never join pieces across the
border between the two.  All pairs of a batch of new words are tested at once with arrays; only words with an incompatible pair
are merged by rank.  Every worker keeps the encodings of recent words, so a word is worked on once per few hundred thousand.
"""

from __future__ import annotations

import array
import hashlib
import heapq
import itertools
import json
import re
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .shared import require, slices

#: How byte-level vocabularies split text before merging (fixed value of the file format).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for texts within Latin-1, with its letters, numbers and white space spelled out, which the standard library matches faster.
_L, _N, _S = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", r"0-9\xb2\xb3\xb9\xbc-\xbe", r"\t-\r \x85\xa0"
LATIN_PATTERN = rf" ?[{_L}]+|'(?:s|t|re|ve|m|ll|d)| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"
#: Words whose encodings a worker remembers.
REMEMBERED = 1_000_000
#: Characters from which on a text's words are taken in portions.
LONG_TEXT = 1 << 20
_NEVER_INT = 1 << 40
_NEVER = np.int64(_NEVER_INT)


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary file: printable Latin-1 stands for itself, the other bytes in order for the characters from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    def __init__(self, spec: bytes):
        file = json.loads(spec)
        model = file["model"]
        if model.get("type", "BPE") != "BPE" or (file.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or file["pre_tokenizer"].get("add_prefix_space") or file.get("normalizer") or model.get("ignore_merges") or model.get("dropout"):
            raise ValueError("only plain byte-level BPE files without prefix space, normaliser or dropout are supported")
        alphabet = byte_alphabet()
        to_bytes = lambda s: bytes(alphabet[c] for c in s)
        vocab: dict[str, int] = model["vocab"]
        self.size = max([*vocab.values(), *(t["id"] for t in file["added_tokens"])]) + 1
        self.token_bytes: list[bytes] = [b""] * self.size
        for token, i in vocab.items():
            self.token_bytes[i] = to_bytes(token)
        self.special = {}
        for t in file["added_tokens"]:
            if t["lstrip"] or t["rstrip"] or t["single_word"]:
                raise ValueError(f"added token {t['content']!r} has options that are not supported")
            self.special[t["content"]] = t["id"]
            self.token_bytes[t["id"]] = t["content"].encode()
        self.split_special = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.byte_id = np.zeros(256, dtype=np.int64)
        for c, b in alphabet.items():
            self.byte_id[b] = vocab[c]

        # rank 0: single bytes; merges have the ranks from 1 in the order of the file
        self.rank = np.full(self.size, _NEVER, dtype=np.int64)
        self.rank[self.byte_id] = 0
        self.left = np.full(self.size, -1, dtype=np.int64)
        self.right = np.full(self.size, -1, dtype=np.int64)
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        twice = set()
        for rank, pair in enumerate(model["merges"], 1):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            i, j, k = vocab[a], vocab[b], vocab[a + b]
            if (i, j) in self.merges:
                continue
            self.merges[i, j] = (rank, k)
            if self.left[k] >= 0 or self.rank[k] == 0:
                twice.add(k)
            else:
                self.left[k], self.right[k], self.rank[k] = i, j, rank
        keys = np.array([i * self.size + j for i, j in self.merges], dtype=np.int64)
        ranks = np.array([r for r, _ in self.merges.values()], dtype=np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], ranks[order]

        # entries that merging by rank really makes of their own bytes
        sound = self.rank == 0
        made = np.flatnonzero(self.left >= 0)
        made = made[np.argsort(self.rank[made])]
        fits = self._compatible(self.left[made], self.right[made], self.rank[made])
        for k, good in zip(made.tolist(), fits.tolist(), strict=True):
            i, j = self.left[k], self.right[k]
            sound[k] = good and k not in twice and sound[i] and sound[j] and self.rank[i] < self.rank[k] > self.rank[j]
        self.sound = sound
        self.lookup = {self.token_bytes[i]: i for i in np.flatnonzero(sound).tolist()}
        self.longest = max(map(len, self.lookup))
        #: the longest entry that begins with each four bytes; without one, entries have three bytes at most
        self.reach: dict[bytes, int] = {}
        for token in self.lookup:
            self.reach[token[:4]] = max(self.reach.get(token[:4], 3), len(token))
        self.rank_of = {pair: r for pair, (r, _) in self.merges.items()}
        self.made_by = {r: k for r, k in self.merges.values()}
        self.byte_list = self.byte_id.tolist()
        self.remembered: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.pattern = regex.compile(PATTERN)
        self.latin_pattern = re.compile(LATIN_PATTERN)
        self.late = self._late_characters()
        self.checked = self.merged = 0

    @staticmethod
    def _late_characters() -> set[str]:
        """Letters and numbers that this regex library knows from newer tables than the splitting of the vocabulary's library does."""
        every = "".join(map(chr, itertools.chain(range(0xD800), range(0xE000, sys.maxunicode + 1))))
        return {c for c in regex.findall(r"[\p{L}\p{N}]", every) if unicodedata.category(c) == "Cn"}

    def _pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], _NEVER)

    def _compatible(self, a: np.ndarray, b: np.ndarray, until: np.ndarray | None = None) -> np.ndarray:
        """Whether merging by rank leaves the border between tokens a and b alone (before rank `until`).

        The time during which two pieces face each other at the border ends with the earlier of the merges that take the left
        piece (from its left) or the right piece (from its right).  A merge across the border wins if its rank is lower; of equal
        ranks the leftmost goes first, so it loses to the left piece's merge and wins over the right piece's.
        """
        a, b = a.astype(np.int64), b.astype(np.int64)
        ok = np.ones(len(a), dtype=bool)
        # the last rank at which a merge across the border would still come in time
        limit = np.full(len(a), _NEVER - 1) if until is None else until - 1
        live = np.arange(len(a))
        x, y, end = a.copy(), b.copy(), limit
        while len(live):
            crossing = self._pair_rank(x, y) <= end
            ok[live[crossing]] = False
            undo_left = self.rank[x] > self.rank[y]
            # pieces of equal rank are single bytes, or the same token: then the right one was made later
            undo_right = ~undo_left & (self.left[y] >= 0)
            undo_left &= self.left[x] >= 0
            go = ~crossing & (undo_left | undo_right)
            new_end = np.where(undo_left, self.rank[x] - 1, self.rank[y])
            x, y = np.where(undo_left, self.right[x], x), np.where(undo_right, self.left[y], y)
            live, x, y, end = live[go], x[go], y[go], new_end[go]
        return ok

    def merge(self, word: bytes) -> list[int]:
        """The encoding by definition: join the adjacent pair of the lowest rank, the leftmost of equals, until none is left."""
        ids = [*map(self.byte_list.__getitem__, word)]
        n = len(ids)
        if n <= 48:
            get, made_by = self.rank_of.get, self.made_by
            ranks = [*map(get, zip(ids, ids[1:]), itertools.repeat(_NEVER_INT))]
            while ranks and (rank := min(ranks)) != _NEVER_INT:
                i = ranks.index(rank)
                ids[i : i + 2] = (new := made_by[rank],)
                del ranks[i]
                if i:
                    ranks[i - 1] = get((ids[i - 1], new), _NEVER_INT)
                if i < len(ranks):
                    ranks[i] = get((new, ids[i + 1]), _NEVER_INT)
            return ids
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(m[0], i, ids[i], ids[i + 1], m[1]) for i in range(n - 1) if (m := self.merges.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, left, right, new = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or ids[i] != left or ids[j] != right:
                continue
            ids[i], alive[j], after[i] = new, False, after[j]
            if after[j] < n:
                before[after[j]] = i
                if m := self.merges.get((new, ids[after[j]])):
                    heapq.heappush(heap, (m[0], i, new, ids[after[j]], m[1]))
            if (h := before[i]) >= 0 and (m := self.merges.get((ids[h], new))):
                heapq.heappush(heap, (m[0], h, ids[h], new, m[1]))
        return [t for t, a in zip(ids, alive, strict=True) if a]

    def greedy(self, word: bytes) -> list[int]:
        lookup, reach, out, i, n = self.lookup, self.reach, [], 0, len(word)
        while i < n:
            for end in range(min(n, i + reach.get(word[i : i + 4], 3)), i, -1):
                if (t := lookup.get(word[i:end])) is not None:
                    out.append(t)
                    i = end
                    break
        return out

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of each word as little-endian unsigned 32-bit integers."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        proposed = [self.greedy(w) for w in raw]
        counts = np.fromiter(map(len, proposed), dtype=np.int64, count=len(proposed))
        flat = np.fromiter(itertools.chain.from_iterable(proposed), dtype=np.int64, count=int(counts.sum()))
        owner = np.repeat(np.arange(len(words)), counts)
        inner = np.flatnonzero(owner[1:] == owner[:-1]) if len(flat) else np.zeros(0, np.int64)
        pairs, back = np.unique(flat[inner] * self.size + flat[inner + 1], return_inverse=True)
        fits = self._compatible(pairs // self.size, pairs % self.size)[back] if len(pairs) else np.zeros(0, bool)
        wrong = np.unique(owner[inner[~fits]])
        self.checked += len(words)
        self.merged += len(wrong)
        for i in wrong.tolist():
            proposed[i] = self.merge(raw[i])
        return [array.array("I", p).tobytes() for p in proposed]

    def _words(self, text: str) -> list[str]:
        if not text.isascii() and not self.late.isdisjoint(text):
            # such characters are neither letters nor numbers for the library; a stand-in of that kind keeps their places
            stand_in = "".join("\u2400" if c in self.late else c for c in text)
            ends = np.cumsum([len(w) for w in self.pattern.findall(stand_in)]).tolist()
            return [text[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.pattern.findall(text)
        return self.latin_pattern.findall(text)

    def _parts(self, text: str) -> Iterator[list[str] | int]:
        """Lists of words, and ids of special tokens, in order."""
        pieces = self.split_special.split(text) if self.special and any(t in text for t in self.special) else [text]
        for i, piece in enumerate(pieces):
            if i % 2:
                yield self.special[piece]
            elif len(piece) <= LONG_TEXT:
                yield self._words(piece)
            else:
                found = (m[0] for m in self.pattern.finditer(piece)) if self.late.isdisjoint(piece) else iter(self._words(piece))
                while some := list(itertools.islice(found, 100_000)):
                    yield some

    def _learn(self, words: set[str]) -> None:
        if not (new := words.difference(self.remembered)):
            return
        if len(self.remembered) + len(new) > REMEMBERED // 2:
            self.before, self.remembered, new = self.remembered, {}, words
        known = new.intersection(self.before)
        self.remembered.update(zip(known, map(self.before.__getitem__, known), strict=True))
        new = list(new.difference(known))
        self.remembered.update(zip(new, self.encode_words(new), strict=True))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; null is the empty text."""
        out: list[bytes] = []
        plain = [t or "" for t in texts]
        if all(len(t) <= LONG_TEXT for t in plain):
            cut = [list(self._parts(t)) for t in plain]
            self._learn(set().union(*(p for parts in cut for p in parts if isinstance(p, list))))
            get = self.remembered.__getitem__
            for parts in cut:
                out.append(b"".join(p.to_bytes(4, "little") if isinstance(p, int) else b"".join(map(get, p)) for p in parts))
            return out
        for t in plain:
            done = []
            for p in self._parts(t):
                if isinstance(p, int):
                    done.append(p.to_bytes(4, "little"))
                else:
                    self._learn(set(p))
                    done.append(b"".join(map(self.remembered.__getitem__, p)))
            out.append(b"".join(done))
        return out

    def decode(self, ids: bytes | None) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD as usual."""
        get = self.token_bytes.__getitem__
        return b"".join(map(get, np.frombuffer(ids or b"", dtype="<u4").tolist())).decode("utf-8", "replace")


class LibraryBpe(ByteBpe):
    """The same ids; new words are encoded by the tiktoken library, for operators that only need the ids."""

    def __init__(self, spec: bytes):
        import tiktoken

        super().__init__(spec)
        special = set(self.special.values())
        by_rank = [self.byte_list, [self.made_by[r] for r in sorted(self.made_by)]]
        ids = [i for part in by_rank for i in dict.fromkeys(part) if i not in special]
        ranks = {self.token_bytes[i]: n for n, i in enumerate(ids)}
        self.id_of_rank = None if ids == list(range(len(ids))) else ids
        self.core = tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe

    def encode_words(self, words: list[str]) -> list[bytes]:
        one, pack, ids = self.core.encode_single_piece, array.array, self.id_of_rank
        if ids is None:
            return [pack("I", one(w.encode())).tobytes() for w in words]
        return [pack("I", [ids[r] for r in one(w.encode())]).tobytes() for w in words]


_loaded: dict[tuple[bytes, type], ByteBpe] = {}


def load(spec: bytes, kind: type[ByteBpe] = ByteBpe) -> ByteBpe:
    """One model a process: a worker that runs many tasks builds it once."""
    key = hashlib.sha256(spec).digest(), kind
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = kind(spec)
    return _loaded[key]


def read_spec(vocabulary: str) -> bytes:
    """The vocabulary file, read once on the driver; 1-3 MB, which the operators broadcast."""
    with open(vocabulary, "rb") as f:
        return f.read()


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """Encodes every whole text.

    Returns id_col, n_tokens (long), ids (binary: little-endian unsigned 32-bit) and, if decoded, text: the ids decoded again.
    A null text counts as empty: no ids, the empty text.  Repeated rows stay repeated, other columns are left out whatever
    their names, an empty table gives an empty one.  A null id stays null.  Texts of any length are encoded whole.
    """
    require(docs, id_col, text_col)
    spark = docs.sparkSession
    spec = spark.sparkContext.broadcast(read_spec(vocabulary))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(spec.value)
        for batch in slices(batches, "_text"):
            ids = model.encode(batch.column("_text").to_pylist())
            columns = {"_id": batch.column("_id"), "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()), "ids": pa.array(ids, pa.binary())}
            if decoded:
                columns["text"] = pa.array([model.decode(x) for x in ids], pa.string())
            yield pa.RecordBatch.from_pydict(columns)

    plain = docs.selectExpr(f"`{id_col}` AS _id", f"CAST(`{text_col}` AS STRING) AS _text")
    out = plain.mapInArrow(run, f"_id {kind}, n_tokens bigint, ids binary" + ", text string" * decoded)
    return out.withColumnRenamed("_id", id_col)


def decode(encoded: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """The texts of ids (binary, little-endian unsigned 32-bit): id_col, text.  Null ids give the empty text."""
    require(encoded, id_col, ids_col)
    spec = encoded.sparkSession.sparkContext.broadcast(read_spec(vocabulary))
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(spec.value)
        for batch in slices(batches, "_ids"):
            texts = [model.decode(x) for x in batch.column("_ids").to_pylist()]
            yield pa.RecordBatch.from_pydict({"_id": batch.column("_id"), "text": pa.array(texts, pa.string())})

    plain = encoded.selectExpr(f"`{id_col}` AS _id", f"`{ids_col}` AS _ids")
    return plain.mapInArrow(run, f"_id {kind}, text string").withColumnRenamed("_id", id_col)
