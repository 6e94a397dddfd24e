"""Strict readers of text files: delimited values, NDJSON, SQL dumps, row chunks of a backup.

Files are split over tasks one by one (line by line for NDJSON, dumps and chunks), and lexed by generators, so memory stays at one
record.  Whatever is malformed is an error that names the file and the record.
"""

from __future__ import annotations

import codecs
import itertools
import json
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import Refused
from .paths import open_path

FIELD_LIMIT = 64 << 20
#: First bytes of files that are something else (fixed signatures).
SIGNATURES = [
    (b"PGDMP", "a PostgreSQL custom-format dump"), (b"SQLite format 3\0", "an SQLite database"), (b"PAR1", "a Parquet file"), (b"\x1f\x8b", "gzip data"),
    (b"\x28\xb5\x2f\xfd", "zstd data"), (b"PK\x03\x04", "a zip archive"), (b"BZh", "bzip2 data"), (b"\xfd7zXZ\0", "xz data"), (b"Obj\x01", "an Avro file"),
    (b"ORC", "an ORC file"), (b"\xff\xfe", "UTF-16 text"), (b"\xfe\xff", "UTF-16 text"), (b"\0\0\xfe\xff", "UTF-32 text"), (b"\xfebin", "a MySQL binary log"), (b"%PDF", "a PDF"),
    (b"-- MySQL dump", "a plain dump of MySQL"), (b"-- PostgreSQL database dump", "a plain dump of PostgreSQL"),
]
#: How much of a file is looked at, and a banner that may stand at the start of any line in it.
HEAD, BANNER = 512, (b"\n-- PostgreSQL database dump", "a plain dump of PostgreSQL")


def sniff(head: bytes) -> str | None:
    """What a file is by its first bytes, if that is no plain text."""
    for magic, what in SIGNATURES:
        if head.startswith(magic):
            return what
    if BANNER[0] in head[:HEAD]:
        return BANNER[1]
    return "a tar archive" if head[257:262] == b"ustar" else None


def signatures(spark: SparkSession, path: str) -> DataFrame:
    """(path, what): what each file at a path is by its first bytes, as `sniff` tells it; null for plain text.  Empty files have no row."""
    head = F.substring("content", 1, HEAD)
    what = F.coalesce(
        *[F.when(F.startswith(head, F.lit(magic)), what) for magic, what in SIGNATURES],
        F.when(F.contains(head, F.lit(BANNER[0])), BANNER[1]),
        F.when(F.substring("content", 258, 5) == F.lit(b"ustar"), "a tar archive"),
    )
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", what.alias("what"))


def check_text(head: bytes) -> bytes:
    """The text without a byte-order mark; foreign formats and NUL bytes are refused."""
    if what := sniff(head):
        raise Refused(f"this is {what}, not text")
    if b"\0" in head:
        raise Refused("the text has NUL bytes")
    return head.removeprefix(codecs.BOM_UTF8)


# ---------------------------------------------------------------------------
# Delimited values


def lex_csv(text: Iterable[str], delimiter: str = ",") -> Iterator[list[tuple[str, bool]]]:
    """Records of (field, was quoted) by RFC 4180; a quote inside an unquoted field, text behind a closing quote and an open quote at the end are errors."""
    record: list[tuple[str, bool]] = []
    field: list[str] = []
    size, state, number = 0, "start", 1

    def fail(what: str):
        raise Refused(f"record {number}: {what}")

    for block in text:
        i, n = 0, len(block)
        while i < n:
            if state == "quoted":
                j = block.find('"', i)
                part = block[i : n if j < 0 else j]
                field.append(part)
                size += len(part)
                if size > FIELD_LIMIT:
                    fail("a field is over the limit")
                if j >= 0:
                    state, i = "closing", j + 1
                else:
                    i = n
                continue
            c = block[i]
            if state == "closing" and c == '"':
                field.append('"')
                state, i = "quoted", i + 1
                continue
            if c == delimiter or c == "\n" or c == "\r":
                if c == "\r":
                    if state == "cr":
                        fail("a bare carriage return")
                    done = (("".join(field)), state == "closing")
                    record.append(done)
                    field, size, state, i = [], 0, "cr", i + 1
                    continue
                if state == "cr":
                    if c != "\n":
                        fail("a bare carriage return")
                    yield record
                    record, state, i, number = [], "start", i + 1, number + 1
                    continue
                record.append(("".join(field), state == "closing"))
                field, size, i = [], 0, i + 1
                if c == "\n":
                    yield record
                    record, state, number = [], "start", number + 1
                else:
                    state = "next"
                continue
            if state == "cr":
                fail("a bare carriage return")
            if state == "closing":
                fail("text behind a closing quote")
            if c == '"':
                if field:
                    fail("a quote inside an unquoted field")
                state, i = "quoted", i + 1
                continue
            j = i
            while j < n and block[j] not in (delimiter, "\n", "\r", '"'):
                j += 1
            field.append(block[i:j])
            size += j - i
            if size > FIELD_LIMIT:
                fail("a field is over the limit")
            state, i = "plain", j
    if state == "quoted":
        fail("a quote is not closed")
    if state == "cr":
        yield record
    elif state in ("closing", "plain", "next"):
        record.append(("".join(field), state == "closing"))
        yield record


def csv_header(first: list[tuple[str, bool]], header: bool) -> list[str]:
    if not header:
        return [f"col{i}" for i in range(1, len(first) + 1)]
    names = [f for f, _ in first]
    if any(not n.strip() for n in names):
        raise Refused("a column has no name")
    if len({n.lower() for n in names}) < len(names):
        raise Refused("two columns have the same name")
    return names


def csv_value(field: str, quoted: bool, null: str | None, where: str) -> str | None:
    """Quoted is always data; unquoted is null if it is the declared text for it; unquoted and empty with nothing declared is refused."""
    if quoted:
        return field
    if null is not None:
        return None if field == null else field
    if field == "":
        raise Refused(f"{where}: an empty unquoted field is null or empty text, and which has not been declared")
    return field


def _texts(blob: bytes) -> Iterator[str]:
    blob = check_text(blob)
    return _decoded(blob[i : i + (1 << 20)] for i in range(0, len(blob), 1 << 20))


def _decoded(blocks: Iterable[bytes]) -> Iterator[str]:
    decoder = codecs.getincrementaldecoder("utf-8")("strict")
    try:
        for block in blocks:
            yield decoder.decode(block)
        yield decoder.decode(b"", True)
    except UnicodeDecodeError as e:
        raise Refused(f"not UTF-8: {e.reason}") from None


def _beginning(spark: SparkSession, path: str, block: int = 1 << 16) -> Iterator[str]:
    """The text of a file from its start, block by block as it is asked for: the driver holds no more than its first record."""
    p, fs = open_path(spark, path)
    stream = fs.open(p)
    try:
        first = bytes(stream.readNBytes(block))
        rest = iter(lambda: bytes(stream.readNBytes(block)), b"")
        yield from _decoded(itertools.chain([check_text(first)], map(_sound, rest)))
    finally:
        stream.close()


def _sound(block: bytes) -> bytes:
    if b"\0" in block:
        raise Refused("the text has NUL bytes")
    return block


def read_csv(spark: SparkSession, path: str, header: bool, delimiter: str = ",", null: str | None = None) -> DataFrame:
    """All columns as text.  Every file must have the same columns; each is lexed by one task."""
    files = spark.read.format("binaryFile").load(path)
    if files.isEmpty():
        raise Refused(f"no files at {path}")
    head = files.agg(F.min("path")).first()[0]
    first = next(lex_csv(_beginning(spark, head), delimiter), None)
    if first is None:
        raise Refused("the file is empty")
    names = csv_header(first, header)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for where, blob in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                rows: list[list[str | None]] = []
                for k, record in enumerate(lex_csv(_texts(blob.as_py()), delimiter)):
                    if header and k == 0:
                        if csv_header(record, True) != names:
                            raise Refused(f"{where}: other columns than the first file")
                        continue
                    if len(record) != len(names):
                        raise Refused(f"{where}: record {k + 1} has {len(record)} fields, not {len(names)}")
                    rows.append([csv_value(f, q, null, f"{where}: record {k + 1}") for f, q in record])
                    if len(rows) == 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], names=names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], names=names)

    return files.select("path", "content").mapInArrow(run, ", ".join(f"`{n.replace('`', '``')}` string" for n in names))


# ---------------------------------------------------------------------------
# NDJSON


class _Raw(str):
    """A number as it is written."""


def _pairs(items: list) -> dict:
    seen = set()
    for k, _ in items:
        if k.lower() in seen or not k:
            raise Refused(f"the key {k!r} is empty or repeated")
        seen.add(k.lower())
    return dict(items)


def _refuse_constant(name: str):
    raise Refused(f"{name} is no JSON")


_DECODER = json.JSONDecoder(parse_float=_Raw, parse_int=_Raw, parse_constant=_refuse_constant, object_pairs_hook=_pairs)


def _dump(v) -> str:
    if isinstance(v, _Raw):
        return str(v)
    if isinstance(v, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{_dump(x)}" for k, x in v.items()) + "}"
    if isinstance(v, list):
        return "[" + ",".join(map(_dump, v)) + "]"
    return json.dumps(v, ensure_ascii=False)


def json_line(line: str, where: str = "") -> dict[str, str | None] | None:
    """The top-level members of an object as text; numbers as written, nested values as JSON; None of a blank line."""
    if not line.strip():
        return None
    if "\0" in line:
        raise Refused(f"{where}: a NUL byte")
    try:
        value = _DECODER.decode(line)
    except json.JSONDecodeError as e:
        raise Refused(f"{where}: {e.msg}") from None
    except Refused as e:
        raise Refused(f"{where}: {e}") from None
    if not isinstance(value, dict):
        raise Refused(f"{where}: not an object")
    return {k: None if v is None else str(v) if isinstance(v, str) else _dump(v) for k, v in value.items()}


def read_ndjson(spark: SparkSession, path: str) -> DataFrame:
    """One object a line; the columns are all keys, in the order of first use, found in a first pass; values are text or null."""
    lines = spark.read.text(path).select("value")

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, tuple[int, int]] = {}
        for n, batch in enumerate(batches):
            for i, line in enumerate(batch.column(0).to_pylist()):
                for k in json_line(line.removeprefix("﻿"), f"line {i + 1}") or ():
                    seen.setdefault(k, (n, i))
        yield pa.RecordBatch.from_pydict({"key": pa.array(list(seen), pa.string()), "at": pa.array(range(len(seen)), pa.int64())})

    # a row per key and task
    found = lines.mapInArrow(keys, "key string, at bigint").withColumn("part", F.spark_partition_id()).groupBy("key").agg(F.min(F.struct("part", "at")).alias("first")).orderBy("first")
    names = [r["key"] for r in found.collect()]
    if not names:
        raise Refused("no object has a key")
    if len({n.lower() for n in names}) < len(names):
        raise Refused("keys differ only in case")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [r for line in batch.column(0).to_pylist() if (r := json_line(line.removeprefix("﻿"))) is not None]
            yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in got], pa.string()) for n in names], names=names)

    return lines.mapInArrow(rows, ", ".join(f"`{n.replace('`', '``')}` string" for n in names))


# ---------------------------------------------------------------------------
# SQL dumps

_SPACE = re.compile(r"(?:\s+|--[^\n]*(?:\n|$)|#[^\n]*(?:\n|$)|/\*.*?\*/)*", re.S)
_STRING = re.compile(r"'((?:[^'\\]+|\\.|'')*+)'|\"((?:[^\"\\]+|\\.|\"\")*+)\"", re.S)
_ESCAPES = {"0": "\0", "n": "\n", "r": "\r", "t": "\t", "b": "\b", "Z": "\x1a"}
_INSERT = re.compile(r"(?:INSERT|REPLACE)\s+(?:IGNORE\s+)?INTO\s+((?:[`\"]?[\w$]+[`\"]?\.)?[`\"]?[\w$]+[`\"]?)\s*(\([^)]*\))?\s*VALUES\s*", re.I)
_SPECIAL = re.compile(r"['\"`;#]|/\*|--")
#: What may be open at the end of a line, by how it begins: nothing, strings, a quoted name, a comment; with what closes it.
_OPEN = {
    "": (";", None), "'": ("'", re.compile(r"(?:[^'\\]+|\\.|'')*+'", re.S)), '"': ('"', re.compile(r"(?:[^\"\\]+|\\.|\"\")*+\"", re.S)),
    "`": ("`", re.compile(r"[^`]*+`")), "/*": ("*/", re.compile(r".*?\*/", re.S)),
}
_UNCLOSED = {"`": "a quoted name is not closed", "/*": "a comment is not closed"}
#: Names of files that Spark's text reader unpacks.
_PACKED = r"\.(gz|bz2|deflate|snappy|lz4|zst)$"


def _ends(text: str, opened: str) -> tuple[list[int], str]:
    """Where statements end in whole lines of a dump, and what is open behind these, given what is open before them."""
    ends, i = [], 0
    while True:
        if opened:
            m = _OPEN[opened][1].match(text, i)
            if not m:
                return ends, opened
            i, opened = m.end(), ""
        m = _SPECIAL.search(text, i)
        if not m:
            return ends, ""
        i = m.end()
        if m[0] == ";":
            ends.append(i)
        elif m[0] in ("#", "--"):
            if (i := text.find("\n", i)) < 0:
                return ends, ""
        else:
            opened = m[0]


def _pieces(lines: Iterable[str], opened: str) -> Iterator[tuple[str, bool]]:
    """(text, ended): lines cut at the ends of statements; the last piece, perhaps empty, has not ended."""
    parts = []
    for text in lines:
        begin = 0
        if not opened or _OPEN[opened][0] in text:
            ends, opened = _ends(text, opened)
            for end in ends:
                yield "".join([*parts, text[begin : end - 1]]), True
                parts, begin = [], end
        parts.append(text[begin:])
    yield "".join(parts), False


def statements(text: str) -> Iterator[str]:
    """The statements of a dump; semicolons inside strings, quoted names and comments do not end one."""
    if opened := _ends(text, "")[1]:
        raise Refused(_UNCLOSED.get(opened, "a string is not closed"))
    yield from (s for piece, _ in _pieces([text], "") if (s := piece.strip()))


def unescape(s: str, backslashes: bool = True) -> str:
    s = s.replace("''", "'")
    return re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), s, flags=re.S) if backslashes else s


_NULL = re.compile(r"NULL\b", re.I)
_HEX = re.compile(r"(?:0x([0-9A-Fa-f]*)|x'([0-9A-Fa-f]*)')", re.I)
_BITS = re.compile(r"(?:b'([01]*)'|0b([01]+))")
_CHARSET = re.compile(r"_(?:binary|utf8mb4|utf8mb3|utf8|latin1)\s*", re.I)
_CONVERT, _USING = re.compile(r"CONVERT\s*\(\s*", re.I), re.compile(r"\s*(?:USING\s+\w+|,\s*\w+)\s*\)", re.I)
_NUMBER = re.compile(r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?|TRUE\b|FALSE\b", re.I)


def _value(text: str, i: int, backslashes: bool) -> tuple[str | bytes | None, int]:
    i = _SPACE.match(text, i).end()
    if m := _NULL.match(text, i):
        return None, m.end()
    if m := _HEX.match(text, i):
        return bytes.fromhex((m[1] or m[2] or "").rjust(len(m[1] or m[2] or "") + len(m[1] or m[2] or "") % 2, "0")), m.end()
    if m := _BITS.match(text, i):
        return m[1] if m[1] is not None else m[2], m.end()
    if m := _CHARSET.match(text, i):
        return _value(text, m.end(), backslashes)
    if m := _CONVERT.match(text, i):
        value, i = _value(text, m.end(), backslashes)
        m = _USING.match(text, i)
        if not m:
            raise Refused("CONVERT is not closed")
        return value, m.end()
    if text[i : i + 1] in ("'", '"'):
        m = _STRING.match(text, i)
        if not m:
            raise Refused("a string is not closed")
        return unescape(m[1] if m[1] is not None else m[2].replace('""', '"'), backslashes), m.end()
    if m := _NUMBER.match(text, i):
        low = m[0].lower()
        return {"true": "1", "false": "0"}.get(low, m[0]), m.end()
    raise Refused(f"cannot read a value from {text[i : i + 20]!r} on")


def insert_rows(statement: str, backslashes: bool = True) -> tuple[str, list[str] | None, list[list]] | None:
    """(table, columns or None, rows) of an INSERT ... VALUES; None of another statement."""
    at = _SPACE.match(statement, 0).end()
    m = _INSERT.match(statement, at)
    if not m:
        return None
    columns = [c.strip().strip('`"') for c in m[2][1:-1].split(",")] if m[2] else None
    i, rows = m.end(), []
    while True:
        i = _SPACE.match(statement, i).end()
        if statement[i : i + 1] != "(":
            raise Refused("a row must begin with a parenthesis")
        row = []
        i += 1
        while True:
            v, i = _value(statement, i, backslashes)
            row.append(v)
            i = _SPACE.match(statement, i).end()
            c = statement[i : i + 1]
            i += 1
            if c == ")":
                break
            if c != ",":
                raise Refused("values must be separated by commas")
        rows.append(row)
        i = _SPACE.match(statement, i).end()
        if statement[i : i + 1] == ",":
            i += 1
        elif i >= len(statement):
            return m[1].replace("`", "").replace('"', ""), columns, rows
        else:
            raise Refused(f"unexpected {statement[i : i + 20]!r} behind the rows")


_CREATE = re.compile(r"CREATE\s+TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?([`\"\w$.]+)\s*\((.*)\)[^)]*$", re.I | re.S)


def create_table(statement: str) -> tuple[str, list[tuple[str, str, bool]], list[str]] | None:
    """(table, [(column, declared type, nullable)], key columns) of a CREATE TABLE; None of another statement."""
    m = _CREATE.match(statement[_SPACE.match(statement, 0).end() :])
    if not m:
        return None
    parts, depth, now, quote = [], 0, [], ""
    for c in m[2]:
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"`":
            quote = c
        elif c in "()":
            depth += 1 if c == "(" else -1
        if c == "," and not depth and not quote:
            parts.append("".join(now))
            now = []
        else:
            now.append(c)
    parts.append("".join(now))
    columns, key = [], []
    for p in (x.strip() for x in parts):
        if k := re.match(r"(?:CONSTRAINT\s+\S+\s+)?PRIMARY\s+KEY\s*\(([^)]*)\)", p, re.I):
            key = [x.strip().strip('`"') for x in k[1].split(",")]
        elif re.match(r"(?:UNIQUE|KEY|INDEX|CONSTRAINT|FULLTEXT|SPATIAL|FOREIGN|CHECK)\b", p, re.I):
            continue
        elif c := re.match(r"[`\"]?([\w$]+)[`\"]?\s+(\w+(?:\s*\((?:[^()']|'[^']*')*\))?(?:\s+unsigned)?)(.*)$", p, re.I | re.S):
            inline = re.search(r"\bPRIMARY\s+KEY\b", c[3], re.I) is not None
            if inline:
                key = [c[1]]
            columns.append((c[1], re.sub(r"\s+", " ", c[2]).lower(), not inline and not re.search(r"\bNOT\s+NULL\b", c[3], re.I)))
        else:
            raise Refused(f"cannot read the column {p[:40]!r}")
    return m[1].replace("`", "").replace('"', ""), [(n, t, nullable and n not in key) for n, t, nullable in columns], key


def _dump_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, start, lines): the lines of files as bytes, by the blocks they are split into; a file that the text reader would unpack is one."""
    where = F.col("_metadata.file_path")
    text = spark.read.text(path, lineSep="\n").filter(~where.rlike(_PACKED))
    whole = spark.read.format("binaryFile").load(path).filter(where.rlike(_PACKED))
    text = text.select(where.alias("path"), F.col("_metadata.file_block_start").alias("start"), F.concat(F.col("value").cast("binary"), F.lit(b"\n")).alias("lines"))
    return text.unionAll(whole.select(where.alias("path"), F.lit(0).cast("bigint").alias("start"), F.col("content").alias("lines")))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, Iterator[bytes]]]:
    """(path, start, lines) of the blocks of a task, one behind the other."""
    rows = (row for batch in batches for row in zip(*[c.to_pylist() for c in batch.columns], strict=True))
    for (where, start), block in itertools.groupby(rows, key=lambda row: row[:2]):
        yield where, start, (row[2] for row in block)


def _sound_lines(where: str, start: int, lines: Iterator[bytes]) -> Iterator[str]:
    """The lines of a block as text; foreign formats, NUL bytes and other encodings are refused."""
    try:
        if start == 0:
            head = b""
            while len(head) < HEAD and (line := next(lines, None)) is not None:
                head += line
            check_text(head)
            lines = itertools.chain([head], lines)
        for line in lines:
            yield _sound(line).decode()
    except UnicodeDecodeError:
        raise Refused(f"{where}: not UTF-8") from None
    except Refused as e:
        raise Refused(f"{where}: {e}") from None


def _followed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, start, opened, ended, left): for each of what may be open before a block, what is behind it, and whether a statement ends in it or is left unended."""
    for where, start, lines in _blocks(batches):
        runs = [[opened, False, False] for opened in (_OPEN if start else [""])]
        for text in _sound_lines(where, start, lines):
            filled = not text.isspace()
            for run in runs:
                ends: list[int] = []
                if not run[0] or _OPEN[run[0]][0] in text:
                    ends, run[0] = _ends(text, run[0])
                if ends:
                    run[1], run[2] = True, bool(text[ends[-1] :].strip())
                else:
                    run[2] |= filled
        opened, ended, left = zip(*runs, strict=True)
        yield pa.RecordBatch.from_pydict({"path": [where], "start": [start], "opened": [list(opened)], "ended": [list(ended)], "left": [list(left)]})


def _chained(found: list) -> dict[tuple[str, int], tuple[str, int | None, int | None, bool]]:
    """{(path, start): (what is open before a block, the block where the statement going into it began, the same of that going out of it, whether it ends the file)}."""
    plan = {}
    for where, group in itertools.groupby(sorted(found, key=lambda r: (r["path"], r["start"])), key=lambda r: r["path"]):
        opened, owner, blocks = "", None, list(group)
        for r in blocks:
            k, last, before = list(_OPEN).index(opened), r is blocks[-1], (opened, owner)
            opened = r["opened"][k]
            if owner is None or r["ended"][k]:
                owner = r["start"] if r["left"][k] else None
            plan[where, r["start"]] = (*before, None if last else owner, last)
        if opened:
            raise Refused(f"{where}: {_UNCLOSED.get(opened, 'a string is not closed')}")
    return plan


def read_dump(spark: SparkSession, path: str, table: str, columns: list[str], backslashes: bool = True) -> DataFrame:
    """The rows of a table in the INSERT statements of dump files, as text (bytes as hexadecimal).

    A file is lexed in the blocks that Spark splits it into, by lines.  Whether a block begins inside a string depends on all
    before it: a first pass follows each thing that may be open there to the block's end, and the driver chains the blocks, a row
    each.  Statements that go over several blocks are joined from their parts, others are read where they stand; a task
    holds one statement at a time.
    """
    lines, low = _dump_lines(spark, path), table.lower()
    plan = _chained(lines.mapInArrow(_followed, "path string, start bigint, opened array<string>, ended array<boolean>, left array<boolean>").collect())

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, str, int | None]]:
        """(path, start, text, owner): the pieces of blocks; those of a statement over several blocks have the block where it began as owner."""
        for where, start, found in _blocks(batches):
            opened, into, out, last = plan[where, start]
            text = (line.decode().removeprefix("\ufeff") if start == 0 and k == 0 else line.decode() for k, line in enumerate(found))
            for k, (piece, ended) in enumerate(_pieces(text, opened)):
                yield where, start, piece, into if k == 0 and into is not None else None if ended or last else out

    def rows(found: Iterable[tuple[str, str]]) -> Iterator[pa.RecordBatch]:
        kept: list[list] = []
        size = 0
        for where, s in found:
            insert = insert_rows(s, backslashes)
            if not insert or insert[0].lower().rpartition(".")[2] != low:
                continue
            order = [c.lower() for c in (insert[1] or columns)]
            if sorted(order) != sorted(c.lower() for c in columns) or any(len(r) != len(order) for r in insert[2]):
                raise Refused(f"{where}: rows of {table} have other columns")
            place = [order.index(c.lower()) for c in columns]
            kept += [[r[p].hex() if isinstance(r[p], bytes) else r[p] for p in place] for r in insert[2]]
            size += len(s)
            if len(kept) >= 4096 or size >= 1 << 22:
                yield batch_of(kept)
                kept, size = [], 0
        if kept:
            yield batch_of(kept)

    def batch_of(kept: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*kept, strict=True)], names=columns)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from rows((where, piece) for where, _, piece, owner in pieces(batches) if owner is None)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for where, start, piece, owner in pieces(batches):
            if owner is not None:
                yield pa.RecordBatch.from_pydict({"path": [where], "owner": [owner], "start": [start], "text": [piece]})

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from rows((r["path"], r["text"]) for batch in batches for r in batch.to_pylist())

    schema = ", ".join(f"`{c}` string" for c in columns)
    got = lines.mapInArrow(whole, schema)
    if broken := sorted({where for (where, _), (_, into, _, _) in plan.items() if into is not None}):
        found = lines.filter(F.col("path").isin(*broken)).mapInArrow(parts, "path string, owner bigint, start bigint, text string")
        text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "text"))), lambda x: x["text"]), "")
        got = got.unionAll(found.groupBy("path", "owner").agg(text.alias("text")).select("path", "text").mapInArrow(joined, schema))
    return got
