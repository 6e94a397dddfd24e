"""Redaction as Column expressions: constants, hashes, masks, seeded random values and dictionary tokens.

A strategy turns a column into a column; null stays null unless the strategy says otherwise.  Text that a format mask does not
recognise is an error, never passed through.  Random values are drawn from SHA-256 of a row's seed - stream, table, column and
key - in counter mode: the same row gets the same value in every run, and no state is kept.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import Refused

Strategy = Callable[[Column, "Row"], Column]


@dataclass(frozen=True)
class Row:
    """Where a value stands; seed is a hex SHA-256 column, needed by random strategies only."""

    name: str
    type: T.DataType
    nullable: bool = True
    seed: Column | None = None


def _text(c: Column, row: Row, what: str) -> Column:
    if not isinstance(row.type, (T.StringType, T.BinaryType)):
        raise Refused(f"{what} takes text or bytes, and {row.name} is {row.type.simpleString()}")
    return c


def _seeded(row: Row, what: str) -> Column:
    if row.seed is None:
        raise Refused(f"{what} on {row.name} needs a table with a primary key")
    return row.seed


def _refuse(c: Column, what: str) -> Column:
    # the value itself is what must not be shown
    return F.raise_error(F.lit(f"a value is not of the form that {what} needs"))


def _masked(c: Column, good: Column, out: Column, what: str) -> Column:
    return F.when(c.isNull(), None).when(good, out).otherwise(_refuse(c, what))


# ---------------------------------------------------------------------------
# Constants, hashes, masks


def null() -> Strategy:
    def apply(c: Column, row: Row) -> Column:
        if not row.nullable:
            raise Refused(f"{row.name} must not be null")
        return F.lit(None).cast(row.type)

    return apply


def static(value: str) -> Strategy:
    """The constant, for null too."""
    return lambda c, row: F.lit(value).cast(row.type)


def sha256() -> Strategy:
    return lambda c, row: F.sha2(_text(c, row, "hash:sha256").cast("binary"), 256)


def hmac_sha256(message: Column, key: bytes) -> Column:
    """HMAC by its definition, as Spark has none: two hashes around the padded key."""
    if not key:
        raise Refused("the key is empty")
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in block), bytes(b ^ 0x5C for b in block)
    first = F.sha2(F.concat(F.lit(inner), message.cast("binary")), 256)
    return F.sha2(F.concat(F.lit(outer), F.unhex(first)), 256)


def hash_hmac(key: bytes) -> Strategy:
    if not key:
        raise Refused("the key is empty")
    return lambda c, row: hmac_sha256(_text(c, row, "hash:hmac-sha256"), key)


def truncate(n: int) -> Strategy:
    return lambda c, row: F.when(c.isNotNull(), F.lit("")) if n <= 0 else F.left(_text(c, row, "truncate"), F.lit(n))


def mask_inner(head: int, tail: int, char: str = "X") -> Strategy:
    """Keeps the first and last characters; a value that has no more than these stays as it is."""

    def apply(c: Column, row: Row) -> Column:
        size = F.char_length(_text(c, row, "mask:inner"))
        hidden = F.concat(F.left(c, F.lit(head)), F.repeat(F.lit(char), (size - head - tail).cast("int")), F.right(c, F.lit(tail)))
        return F.when(size > head + tail, hidden).otherwise(c)

    return apply


def mask_outer(head: int, tail: int, char: str = "X") -> Strategy:
    """Masks the first and last characters; a value that has no more than these is masked whole."""

    def apply(c: Column, row: Row) -> Column:
        size = F.char_length(_text(c, row, "mask:outer"))
        shown = F.concat(F.repeat(F.lit(char), head), F.substring(c, F.lit(head + 1), (size - head - tail).cast("int")), F.repeat(F.lit(char), tail))
        return F.when(size > head + tail, shown).otherwise(F.repeat(F.lit(char), size))

    return apply


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _keep_ends(c: Column, counted: str, head: int, tail: int) -> Column:
    """Masks the characters of the class `counted` but for the first and last ones; all others stay where they are."""
    chars = F.filter(F.split(c, ""), lambda x: x != "")
    total = F.char_length(F.regexp_replace(c, f"[^{counted}]", ""))
    start = F.struct(F.lit(0).alias("k"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        is_one = x.rlike(f"^[{counted}]$")
        k = acc["k"] + F.when(is_one, 1).otherwise(0)
        shown = ~is_one | (k <= head) | (k > total - tail)
        return F.struct(k.alias("k"), F.concat(acc["out"], F.when(shown, x).otherwise("X")).alias("out"))

    return F.aggregate(chars, start, step, lambda acc: acc["out"])


def mask_ssn() -> Strategy:
    return lambda c, row: _masked(c, c.rlike(r"^\d{3}-\d{2}-\d{4}$"), F.concat(F.lit("XXX-XX-"), F.right(c, F.lit(4))), "mask:ssn")


def mask_pan(relaxed: bool = False) -> Strategy:
    """12 to 19 digits, which must satisfy Luhn's check unless relaxed; the first six and last four stay."""

    def apply(c: Column, row: Row) -> Column:
        good = c.rlike(r"^[0-9][0-9 -]*[0-9]$") & F.char_length(_digits(c)).between(12, 19)
        if not relaxed:
            good = good & F.call_function("luhn_check", _digits(c))
        return _masked(c, good, _keep_ends(c, "0-9", 6, 4), "mask:pan")

    return apply


def mask_email() -> Strategy:
    """The first character of the local part stays; the domain begins behind the last @."""

    def apply(c: Column, row: Row) -> Column:
        local, domain = F.regexp_extract(c, r"(?s)^(.+)@([^@]*)$", 1), F.regexp_extract(c, r"(?s)^(.+)@([^@]*)$", 2)
        hidden = F.concat(F.left(local, F.lit(1)), F.repeat(F.lit("X"), F.char_length(local) - 1), F.lit("@"), domain)
        return _masked(c, local != "", hidden, "mask:email")

    return apply


def mask_ca_sin() -> Strategy:
    def apply(c: Column, row: Row) -> Column:
        good = c.rlike(r"^(\d{9}|\d{3}-\d{3}-\d{3})$") & F.call_function("luhn_check", _digits(c))
        return _masked(c, good, F.concat(F.regexp_replace(F.left(c, F.char_length(c) - 3), "[0-9]", "X"), F.right(c, F.lit(3))), "mask:ca-sin")

    return apply


def mask_uk_nin() -> Strategy:
    return lambda c, row: _masked(c, c.rlike(r"^[A-Z]{2}\d{6}[A-D]$"), F.concat(F.left(c, F.lit(2)), F.lit("XXXXXX"), F.right(c, F.lit(1))), "mask:uk-nin")


def mask_iban() -> Strategy:
    """15 to 34 characters besides spaces; the first six and last four stay, and so do the spaces."""

    def apply(c: Column, row: Row) -> Column:
        bare = F.regexp_replace(c, " ", "")
        good = bare.rlike(r"^[A-Z]{2}\d{2}[A-Za-z0-9]{11,30}$") & c.rlike(r"^\S(.*\S)?$")
        return _masked(c, good, _keep_ends(c, "A-Za-z0-9", 6, 4), "mask:iban")

    return apply


def mask_uuid() -> Strategy:
    good = r"^[0-9A-Fa-f]{8}-([0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}$"
    return lambda c, row: _masked(c, c.rlike(good), F.concat(F.left(c, F.lit(4)), F.lit("XXXX-XXXX-XXXX-XXXX-XXXXXXXX"), F.right(c, F.lit(4))), "mask:uuid")


# ---------------------------------------------------------------------------
# Check digits


def luhn_digit(payload: Column) -> Column:
    """The digit that makes payload + digit satisfy Luhn's check."""
    chars = F.filter(F.split(F.reverse(payload), ""), lambda x: x != "")

    def weigh(x: Column, i: Column) -> Column:
        twice = x.cast("int") * 2
        return F.when(i % 2 == 0, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(x.cast("int"))

    total = F.aggregate(F.transform(chars, weigh), F.lit(0), lambda a, b: a + b)
    return F.pmod(F.lit(10) - total % 10, F.lit(10)).cast("string")


def mod97(text: Column) -> Column:
    """The remainder by 97 of letters and digits read as a number, with A = 10 to Z = 35."""
    chars = F.filter(F.split(F.upper(text), ""), lambda x: x != "")

    def step(acc: Column, x: Column) -> Column:
        code = F.ascii(x)
        return F.when(x.rlike("[0-9]"), (acc * 10 + (code - 48)) % 97).otherwise((acc * 100 + (code - 55)) % 97)

    return F.aggregate(chars, F.lit(0), step)


def iban_valid(c: Column) -> Column:
    bare = F.regexp_replace(c, " ", "")
    moved = F.concat(F.substring(bare, F.lit(5), F.char_length(bare)), F.left(bare, F.lit(4)))
    return bare.rlike(r"^[A-Z]{2}\d{2}[A-Za-z0-9]{11,30}$") & (mod97(moved) == 1)


def iban_check(country: str, bban: Column) -> Column:
    return F.lpad((F.lit(98) - mod97(F.concat(bban, F.lit(country + "00")))).cast("string"), 2, "0")


# ---------------------------------------------------------------------------
# Random values from a seed


def row_seed(stream: str, table: str, column: str, key: list[str]) -> Column:
    """SHA-256 of where a value stands; the key's values go in as text, in the key's order."""
    if not key:
        raise Refused(f"a random value for {table}.{column} needs a primary key")
    parts = [F.lit(f"{stream}|{table}|{column}")]
    for k in key:
        parts.append(F.concat(F.lit(f"{k}="), F.coalesce(F.col(f"`{k}`").cast("string"), F.lit(""))))
    return F.sha2(F.concat_ws("|", *parts), 256)


def draw(seed: Column, counter: int, n: int) -> Column:
    """A number from 0 to n - 1: 60 bits of the counter's hash, so the excess of any number is below n / 2**60."""
    bits = F.conv(F.left(F.sha2(F.concat(seed, F.lit(f":{counter}")), 256), F.lit(15)), 16, 10).cast("bigint")
    return F.pmod(bits, F.lit(n))


def _pick(seed: Column, counter: int, alphabet: str) -> Column:
    return F.substring(F.lit(alphabet), draw(seed, counter, len(alphabet)).cast("int") + 1, F.lit(1))


def _number(seed: Column, counter: int, low: int, high: int, width: int) -> Column:
    return F.lpad((draw(seed, counter, high - low + 1) + low).cast("string"), width, "0")


def _random(build: Callable[[Column, Row], Column], what: str) -> Strategy:
    return lambda c, row: F.when(c.isNotNull(), build(_seeded(row, what), row))


_LETTERS = "abcdefghijklmnopqrstuvwxyz"


def randomize_int(low: int, high: int) -> Strategy:
    if low > high:
        raise Refused("the range is empty")

    def build(seed: Column, row: Row) -> Column:
        if not isinstance(row.type, T.IntegralType):
            raise Refused(f"randomize:int takes integers, and {row.name} is {row.type.simpleString()}")
        return (draw(seed, 0, high - low + 1) + low).cast(row.type)

    return _random(build, "randomize:int")


def randomize_email() -> Strategy:
    def build(seed: Column, row: Row) -> Column:
        local = F.left(F.concat(*[_pick(seed, i, _LETTERS) for i in range(12)]), (draw(seed, 40, 7) + 6).cast("int"))
        host = F.left(F.concat(*[_pick(seed, 20 + i, _LETTERS) for i in range(10)]), (draw(seed, 41, 6) + 5).cast("int"))
        return F.concat(local, F.lit("@"), host, F.lit(".test"))

    return _random(build, "randomize:email")


def randomize_us_phone() -> Strategy:
    """Area and exchange from 200 to 999; the area is not 555."""

    def build(seed: Column, row: Row) -> Column:
        area = draw(seed, 0, 799) + 200
        area = F.when(area >= 555, area + 1).otherwise(area)
        return F.concat(area.cast("string"), F.lit("-"), _number(seed, 1, 200, 999, 3), F.lit("-"), _number(seed, 2, 0, 9999, 4))

    return _random(build, "randomize:us-phone")


def randomize_uuid() -> Strategy:
    def build(seed: Column, row: Row) -> Column:
        h = F.sha2(F.concat(seed, F.lit(":uuid")), 256)
        part = lambda a, n: F.substring(h, a, n)
        return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-4"), part(14, 3), F.lit("-"), _pick(seed, 0, "89ab"), part(18, 3), F.lit("-"), part(21, 12))

    return _random(build, "randomize:uuid")


def randomize_ssn() -> Strategy:
    """Area 001 to 899 but 666, group 01 to 99, serial 0001 to 9999."""

    def build(seed: Column, row: Row) -> Column:
        area = draw(seed, 0, 898) + 1
        area = F.when(area >= 666, area + 1).otherwise(area)
        return F.concat(F.lpad(area.cast("string"), 3, "0"), F.lit("-"), _number(seed, 1, 1, 99, 2), F.lit("-"), _number(seed, 2, 1, 9999, 4))

    return _random(build, "randomize:ssn")


#: Leading digits and total length by brand (fixed values of the card schemes).
BRANDS = {"visa": (("4",), 16), "mastercard": (("5",), 16), "amex": (("34", "37"), 15)}


def _digit_run(seed: Column, first: int, n: int) -> Column:
    """n digits; each hash gives twelve."""
    parts = [F.lpad(draw(seed, first + i, 10**12).cast("string"), 12, "0") for i in range(-(-n // 12))]
    return F.left(F.concat(*parts), F.lit(n))


def randomize_pan(brand: str = "visa") -> Strategy:
    if brand not in BRANDS:
        raise Refused(f"unknown brand {brand}")
    heads, size = BRANDS[brand]

    def build(seed: Column, row: Row) -> Column:
        head = F.element_at(F.array(*[F.lit(h) for h in heads]), (draw(seed, 9, len(heads)) + 1).cast("int"))
        payload = F.concat(head, _digit_run(seed, 0, size - 1 - len(heads[0])))
        return F.concat(payload, luhn_digit(payload))

    return _random(build, "randomize:pan")


def randomize_ca_sin() -> Strategy:
    def build(seed: Column, row: Row) -> Column:
        payload = F.concat(_pick(seed, 9, "12345679"), _digit_run(seed, 0, 7))
        return F.concat(payload, luhn_digit(payload))

    return _random(build, "randomize:ca-sin")


def randomize_uk_nin() -> Strategy:
    """Two prefix letters of those in use, six digits, and a suffix from A to D."""
    first, second = "ABCEGHJKLMNOPRSTWXYZ", "ABCEGHJKLMNPRSTWXYZ"
    return _random(lambda seed, row: F.concat(_pick(seed, 7, first), _pick(seed, 8, second), _digit_run(seed, 0, 6), _pick(seed, 9, "ABCD")), "randomize:uk-nin")


#: Total length of an IBAN by country (fixed values), and the letters that the British one begins with.
IBAN_LENGTH = {"DE": 22, "GB": 22, "FR": 27}


def randomize_iban(country: str = "DE") -> Strategy:
    if country not in IBAN_LENGTH:
        raise Refused(f"no IBAN of the country {country}")

    def build(seed: Column, row: Row) -> Column:
        n = IBAN_LENGTH[country] - 4
        bank = F.concat(*[_pick(seed, 20 + i, _LETTERS.upper()) for i in range(4)]) if country == "GB" else F.lit("")
        bban = F.concat(bank, _digit_run(seed, 0, n - (4 if country == "GB" else 0)))
        return F.concat(F.lit(country), iban_check(country, bban), bban)

    return _random(build, "randomize:iban")


# ---------------------------------------------------------------------------
# Dictionaries and keys


def dictionary(entries: list[str]) -> list[str]:
    found = [e.strip() for e in entries]
    found = [e for e in found if e]
    if not found:
        raise Refused("the dictionary is empty")
    return found


def dictionary_file(spark: SparkSession, path: str) -> list[str]:
    """The entries of a dictionary from a file, one a line, in the order of the lines; the whole list becomes a constant of the plan."""
    return dictionary(spark.read.text(path, wholetext=True).first()["value"].splitlines())


def _entry(hex_hash: Column, entries: list[str]) -> Column:
    """The entry at the hash's first eight bytes, little endian, modulo the number of entries."""
    swapped = F.concat(*[F.substring(hex_hash, 15 - 2 * i, 2) for i in range(8)])
    at = F.pmod(F.conv(swapped, 16, 10).cast("decimal(20,0)"), F.lit(len(entries)).cast("decimal(20,0)")).cast("int")
    return F.element_at(F.array(*[F.lit(e) for e in entries]), at + 1)


def randomize_dict(entries: list[str]) -> Strategy:
    entries = dictionary(entries)
    return _random(lambda seed, row: _entry(seed, entries), "randomize:dict")


def tokenize_dict(name: str, entries: list[str], key: bytes, stream: str = "") -> Strategy:
    """The same value becomes the same entry in every table and column."""
    entries = dictionary(entries)
    return lambda c, row: F.when(c.isNotNull(), _entry(hmac_sha256(F.concat(F.lit(f"{stream}:{name}:"), c.cast("string")), key), entries))


@dataclass
class Keyset:
    """Named keys with generations; the highest generation is used unless one is named.  Keys never appear in messages."""

    keys: dict[str, dict[int, bytes]] = field(default_factory=dict, repr=False)

    @classmethod
    def read(cls, text: str) -> Keyset:
        """Lines `name:generation:hex`; # starts a comment."""
        out = cls()
        for number, line in enumerate(text.splitlines(), 1):
            line = line.split("#", 1)[0].strip()
            if not line:
                continue
            try:
                name, generation, value = line.split(":")
                key = bytes.fromhex(value)
                if not key or int(generation) in out.keys.setdefault(name, {}):
                    raise ValueError
                out.keys[name][int(generation)] = key
            except ValueError:
                raise Refused(f"line {number} of the keyset is not name:generation:hex, or repeats one") from None
        return out

    @classmethod
    def load(cls, spark: SparkSession, source: str) -> Keyset:
        """A keyset from `file:` and a path, `env:` and a variable, or `table:` and a table of (name, generation, key in hexadecimal)."""
        scheme, _, where = source.partition(":")
        if scheme not in ("file", "env", "table") or not where:
            raise Refused("a keyset comes from file:, env: or table: and a name")
        if scheme == "env":
            text = os.environ.get(where, "")
        elif scheme == "file":
            text = spark.read.text(where, wholetext=True).first()["value"]
        else:
            rows = spark.table(where).select("name", "generation", "key").collect()  # one row per key
            text = "\n".join(f"{r['name']}:{r['generation']}:{r['key']}" for r in rows)
        found = cls.read(text)
        if not found.keys:
            raise Refused(f"the keyset of {source} is empty")
        return found

    def get(self, name: str, generation: int | None = None) -> bytes:
        found = self.keys.get(name)
        if not found or (generation is not None and generation not in found):
            raise Refused(f"no key {name}" + (f" of generation {generation}" if generation is not None else ""))
        return found[max(found) if generation is None else generation]


# ---------------------------------------------------------------------------
# Rules by name


def strategy(spec: str, keys: Keyset | None = None, dictionaries: dict[str, list[str]] | None = None, stream: str = "") -> Strategy:
    """A strategy from text such as `mask:inner:2,2`, `hash:sha256` or `randomize:int:1,9`."""
    head, _, rest = spec.partition(":")
    kind, _, args = rest.partition(":")
    numbers = lambda: [int(x) for x in args.split(",")[:2]]
    try:
        if head == "null" and not rest:
            return null()
        if head == "static":
            return static(rest)
        if head == "truncate":
            return truncate(int(rest))
        if head == "hash":
            if kind == "sha256":
                return sha256()
            if kind == "hmac-sha256":
                return hash_hmac((keys or Keyset()).get(args))
        if head == "mask":
            if kind in ("inner", "outer"):
                parts = args.split(",")
                return (mask_inner if kind == "inner" else mask_outer)(*numbers(), *(parts[2:3]))
            presets = {"ssn": mask_ssn, "pan": mask_pan, "pan-relaxed": lambda: mask_pan(relaxed=True), "email": mask_email, "ca-sin": mask_ca_sin, "uk-nin": mask_uk_nin, "iban": mask_iban, "uuid": mask_uuid}
            if kind in presets:
                return presets[kind]()
        if head == "randomize":
            if kind == "int":
                return randomize_int(*numbers())
            if kind == "dict":
                return randomize_dict((dictionaries or {})[args])
            plain = {"email": randomize_email, "us-phone": randomize_us_phone, "uuid": randomize_uuid, "ssn": randomize_ssn, "ca-sin": randomize_ca_sin, "uk-nin": randomize_uk_nin}
            if kind in plain and not args:
                return plain[kind]()
            if kind == "pan":
                return randomize_pan(args or "visa")
            if kind == "iban":
                return randomize_iban(args or "DE")
        if head == "tokenize" and kind == "dict":
            name, _, key = args.partition(":")
            return tokenize_dict(name, (dictionaries or {})[name], (keys or Keyset()).get(key or name), stream)
    except (TypeError, KeyError, IndexError):
        raise Refused(f"cannot read the redaction rule {spec!r}") from None
    except ValueError as e:
        if isinstance(e, Refused):
            raise
        raise Refused(f"cannot read the redaction rule {spec!r}") from None
    raise Refused(f"unknown redaction rule {spec!r}")


class Registry:
    """Rules by table and column, matched in lower case."""

    def __init__(self, rules: dict[str, str], keys: Keyset | None = None, dictionaries: dict[str, list[str]] | None = None, stream: str = ""):
        self.specs = {k.lower(): v for k, v in rules.items()}
        self.stream = stream
        self.strategies = {k: strategy(v, keys, dictionaries, stream) for k, v in self.specs.items()}

    def apply(self, df: DataFrame, table: str, key: list[str] | None = None) -> DataFrame:
        """df with its columns redacted; a rule for a column that is not there is refused, and so is a random one without a key."""
        prefix = table.lower() + "."
        mine = {k[len(prefix) :]: s for k, s in self.strategies.items() if k.startswith(prefix)}
        names = {f.name.lower(): f for f in df.schema.fields}
        if missing := sorted(set(mine) - set(names)):
            raise Refused(f"redaction rules for columns that {table} does not have: {missing}")
        out = []
        for f in df.schema.fields:
            rule = mine.get(f.name.lower())
            c = F.col(f"`{f.name}`")
            if rule is not None:
                seed = row_seed(self.stream, table.lower(), f.name.lower(), key) if key else None
                c = rule(c, Row(f.name, f.dataType, f.nullable, seed))
            out.append(c.alias(f.name))
        return df.select(*out)
