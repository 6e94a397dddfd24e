"""The row-filter language: comparisons, IN, IS NULL, AND, OR, NOT and parentheses over columns and literals.

A predicate is parsed into a small tree and compiled to a Column, never passed on as SQL text.  Logic is three-valued and a row
stays only where the predicate is true, both of which Spark does by itself.  Whatever is not certain to mean the same as on the
source - an unknown collation, a literal finer than its column, equality of floats - is refused at compile time.
"""

from __future__ import annotations

import hashlib
import ipaddress
import json
import re
from dataclasses import dataclass
from datetime import date, datetime, timedelta
from decimal import ROUND_DOWN, ROUND_HALF_UP, Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import Refused

# ---------------------------------------------------------------------------
# Parsing


@dataclass(frozen=True)
class Literal:
    kind: str  # number, string, boolean, null
    value: object


@dataclass(frozen=True)
class Compare:
    column: str
    op: str
    literals: tuple[Literal, ...] = ()


@dataclass(frozen=True)
class Not:
    part: object


@dataclass(frozen=True)
class And:
    parts: tuple


@dataclass(frozen=True)
class Or:
    parts: tuple


_TOKEN = re.compile(r"\s*(?:(?P<number>[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)|'(?P<string>(?:[^']|'')*)'|\"(?P<dq>(?:[^\"]|\"\")+)\"|`(?P<bq>(?:[^`]|``)+)`|(?P<word>[A-Za-z_][A-Za-z0-9_$]*)|(?P<op><=|>=|<>|!=|=|<|>|\(|\)|,))")
_OPS = {"=": "=", "!=": "!=", "<>": "!=", "<": "<", "<=": "<=", ">": ">", ">=": ">="}


def _lex(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while text[at:].strip():
        m = _TOKEN.match(text, at)
        if not m:
            raise Refused(f"cannot read the predicate from {text[at:].strip()[:30]!r} on")
        kind = m.lastgroup
        value = m[kind]
        if kind == "string":
            value = value.replace("''", "'")
        elif kind in ("dq", "bq"):
            kind, value = "name", value.replace('""', '"').replace("``", "`")
        elif kind == "word" and value.upper() in ("AND", "OR", "NOT", "IN", "IS", "NULL", "TRUE", "FALSE", "BETWEEN", "LIKE"):
            kind, value = "key", value.upper()
        elif kind == "word":
            kind = "name"
        out.append((kind, value))
        at = m.end()
    return out


class _Parser:
    def __init__(self, text: str):
        self.tokens, self.at = _lex(text), 0

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self, kind: str | None = None, value: str | None = None) -> str | None:
        k, v = self.peek()
        if (kind is None or k == kind) and (value is None or v == value) and k != "end":
            self.at += 1
            return v
        return None

    def must(self, kind: str, value: str | None = None) -> str:
        found = self.take(kind, value)
        if found is None:
            raise Refused(f"expected {value or kind}, found {self.peek()[1] or 'the end'}")
        return found

    def either(self):
        parts = [self.both()]
        while self.take("key", "OR"):
            parts.append(self.both())
        return parts[0] if len(parts) == 1 else Or(tuple(parts))

    def both(self):
        parts = [self.negation()]
        while self.take("key", "AND"):
            parts.append(self.negation())
        return parts[0] if len(parts) == 1 else And(tuple(parts))

    def negation(self):
        if self.take("key", "NOT"):
            return Not(self.negation())
        if self.take("op", "("):
            inner = self.either()
            self.must("op", ")")
            return inner
        return self.leaf()

    def literal(self) -> Literal:
        kind, value = self.peek()
        self.at += 1
        if kind == "number":
            return Literal("number", value)
        if kind == "string":
            return Literal("string", value)
        if kind == "key" and value in ("TRUE", "FALSE"):
            return Literal("boolean", value == "TRUE")
        if kind == "key" and value == "NULL":
            return Literal("null", None)
        raise Refused(f"expected a literal, found {value or 'the end'}")

    def leaf(self) -> Compare:
        column = self.must("name").lower()
        if self.take("key", "IS"):
            negative = self.take("key", "NOT")
            self.must("key", "NULL")
            return Compare(column, "IS NOT NULL" if negative else "IS NULL")
        negative = self.take("key", "NOT")
        if self.take("key", "IN"):
            self.must("op", "(")
            found = [self.literal()]
            while self.take("op", ","):
                found.append(self.literal())
            self.must("op", ")")
            return Compare(column, "NOT IN" if negative else "IN", tuple(found))
        if negative:
            raise Refused("NOT stands before IN or a whole condition")
        op = self.take("op")
        if op not in _OPS:
            raise Refused(f"unknown operator {op or self.peek()[1]!r}")
        return Compare(column, _OPS[op], (self.literal(),))


def parse(text: str):
    """The tree of a predicate; column names are folded to lower case, quoted or not."""
    p = _Parser(text)
    if p.peek()[0] == "end":
        raise Refused("the predicate is empty")
    tree = p.either()
    if p.peek()[0] != "end":
        raise Refused(f"unexpected {p.peek()[1]!r} after the predicate")
    return tree


# ---------------------------------------------------------------------------
# Collations: name -> (folds case, pads with spaces, folds accents, Spark's collation); fixed meanings

COLLATIONS: dict[str, tuple[bool, bool, bool, str]] = {
    "binary": (False, False, False, "UTF8_BINARY"),
    "c": (False, False, False, "UTF8_BINARY"),
    "posix": (False, False, False, "UTF8_BINARY"),
    "ucs_basic": (False, False, False, "UTF8_BINARY"),
    "utf8mb4_bin": (False, True, False, "UTF8_BINARY_RTRIM"),
    "utf8mb3_bin": (False, True, False, "UTF8_BINARY_RTRIM"),
    "utf8mb4_0900_bin": (False, False, False, "UTF8_BINARY"),
    "utf8mb4_general_ci": (True, True, True, "UNICODE_CI_AI_RTRIM"),
    "utf8mb3_general_ci": (True, True, True, "UNICODE_CI_AI_RTRIM"),
    "utf8mb4_0900_ai_ci": (True, False, True, "UNICODE_CI_AI"),
    "utf8mb4_0900_as_cs": (False, False, False, "UNICODE"),
}
UTF8 = {None, "utf8", "utf8mb3", "utf8mb4", "utf-8"}


@dataclass(frozen=True)
class Col:
    """What compiling needs to know of a column."""

    type: T.DataType
    collation: str | None = None
    charset: str | None = None
    generated: bool = False
    network: str | None = None  # inet, cidr or address
    digits: int = 6  # fractional digits of its seconds


@dataclass(frozen=True)
class Rules:
    """lens: how a temporal literal finer than its column is taken: cast (to the column), half_up, truncate, or None: refused."""

    lens: str | None = None
    strict_collation: bool = False


def columns_of(df: DataFrame, **known: Col) -> dict[str, Col]:
    found = {f.name.lower(): Col(f.dataType) for f in df.schema.fields}
    return found | {k.lower(): v for k, v in known.items()}


# ---------------------------------------------------------------------------
# Literals

_STAMP = re.compile(r"^(\d{4})-(\d\d)-(\d\d)(?:[ T](\d\d):(\d\d)(?::(\d\d)(?:\.(\d+))?)?)?$")


def _seconds(fraction: str, digits: int, lens: str) -> int:
    """Microseconds of a fraction, at the given number of digits: cast goes through a double and rounds half to even, half_up and truncate are decimal."""
    step = 10 ** (6 - digits)
    if lens == "cast":
        return round(float("0." + fraction) * 1e6 / step) * step
    mode = ROUND_HALF_UP if lens == "half_up" else ROUND_DOWN
    return int((Decimal("0." + fraction) * 10**digits).quantize(Decimal(1), mode)) * step


def temporal(text: str, col: Col, lens: str | None) -> date | datetime:
    """A literal for comparison with a date or timestamp column.

    Against a date, the cast lens cuts the time of day off and the others compare as timestamps; without a lens a literal that is
    finer than its column is refused.
    """
    m = _STAMP.match(text.strip())
    if not m:
        raise Refused(f"not a date or timestamp: {text!r}")
    try:
        day = datetime(int(m[1]), int(m[2]), int(m[3]))
        at = day + timedelta(hours=int(m[4] or 0), minutes=int(m[5] or 0), seconds=int(m[6] or 0))
        if int(m[4] or 0) > 23 or int(m[5] or 0) > 59 or int(m[6] or 0) > 59:
            raise ValueError
    except ValueError:
        raise Refused(f"not a date or timestamp: {text!r}") from None
    fraction = m[7] or ""
    is_date = isinstance(col.type, T.DateType)
    finer = (is_date and (at != day or fraction.strip("0"))) or len(fraction.rstrip("0")) > col.digits
    if finer and lens is None:
        raise Refused(f"the literal {text!r} is finer than its column, and no rule says how it rounds")
    if is_date and (lens == "cast" or not finer):
        return day.date()
    return at + timedelta(microseconds=_seconds(fraction, 6 if is_date else col.digits, lens or "truncate") if fraction else 0)


def network(text: str, kind: str) -> str:
    """The text in which a server gives back an address: inet keeps a mask unless it covers the address alone, cidr always has one, address never."""
    if "%" in text:
        raise Refused(f"no server stores an address with a zone: {text!r}")
    try:
        if kind == "cidr":
            net = ipaddress.ip_network(text, strict=True)
            return f"{_address(net.network_address)}/{net.prefixlen}"
        if kind == "address":
            return _address(ipaddress.ip_address(text), one_group=True)
        found = ipaddress.ip_interface(text)
        own = _address(found.ip)
        return own if found.network.prefixlen == found.max_prefixlen else f"{own}/{found.network.prefixlen}"
    except ValueError:
        raise Refused(f"not a {kind} literal: {text!r}") from None


def _address(ip, one_group: bool = False) -> str:
    """Addresses that hold one of the older kind end in its dots; one_group: a single group of zeros is left out too, the first of them."""
    if ip.version == 4:
        return str(ip)
    upper, lower = int(ip) >> 32, int(ip) & 0xFFFFFFFF
    dotted = ipaddress.IPv4Address(lower)
    if upper == 0xFFFF:
        return f"::ffff:{dotted}"
    if upper == 0 and lower > 0xFFFF:
        return f"::{dotted}"
    text = ip.compressed
    if one_group and "::" not in text and "0" in (groups := text.split(":")):
        k = groups.index("0")
        return ":".join(groups[:k]) + "::" + ":".join(groups[k + 1 :])
    return text


def _value(lit: Literal, name: str, col: Col, rules: Rules, op: str) -> Column:
    t = col.type
    if lit.kind == "null":
        return F.lit(None).cast(t)
    if isinstance(t, T.BooleanType):
        if lit.kind == "boolean":
            return F.lit(lit.value)
        if lit.kind == "number" and lit.value in ("0", "1"):
            return F.lit(lit.value == "1")
        raise Refused(f"{name} is boolean")
    if isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        if lit.kind != "string":
            raise Refused(f"{name} needs a quoted date or timestamp")
        found = temporal(str(lit.value), col, rules.lens)
        if isinstance(found, datetime):
            return F.lit(found.isoformat(sep=" ")).cast("timestamp_ntz" if not isinstance(t, T.TimestampType) else "timestamp")
        return F.lit(found)
    if isinstance(t, (T.FloatType, T.DoubleType)):
        if op in ("=", "!=", "IN", "NOT IN"):
            raise Refused(f"{name} is a floating-point column: equality with it is refused, order is not")
        text = str(lit.value).strip().lower()
        if lit.kind == "string" and text in ("nan", "infinity", "-infinity"):
            return F.lit(float(text.replace("infinity", "inf")))
        if lit.kind != "number":
            raise Refused(f"{name} needs a number")
        return F.lit(float(str(lit.value)))
    if isinstance(t, T.NumericType):
        if lit.kind != "number":
            raise Refused(f"{name} needs a number")
        number = Decimal(str(lit.value))
        if isinstance(t, T.IntegralType) and number == number.to_integral_value() and abs(number) < 2**63:
            return F.lit(int(number))
        sign, digits, exponent = number.as_tuple()
        scale = max(0, -exponent)
        width = max(len(digits) + max(0, exponent), scale)
        if width > 38:
            raise Refused(f"the number {lit.value} has more than 38 digits")
        return F.lit(format(number, "f")).cast(T.DecimalType(max(width, 1), scale))
    if isinstance(t, T.StringType):
        if lit.kind != "string":
            raise Refused(f"{name} needs a quoted string")
        return F.lit(network(str(lit.value), col.network) if col.network else lit.value)
    raise Refused(f"{name} of type {t.simpleString()} cannot be compared")


def _collated(name: str, col: Col, rules: Rules, op: str) -> str:
    if (col.charset or "").lower() not in {x or "" for x in UTF8}:
        raise Refused(f"{name} has the character set {col.charset}, which is not UTF-8")
    if col.collation is None:
        return "UTF8_BINARY"
    rule = COLLATIONS.get(col.collation.lower())
    if rule is None:
        raise Refused(f"{name} has the collation {col.collation}, whose comparisons are not known")
    exact = rule[3] == "UTF8_BINARY"
    if rules.strict_collation and not exact:
        raise Refused(f"{name} does not compare byte by byte, and strict collation is asked for")
    if not exact and op in ("<", "<=", ">", ">="):
        raise Refused(f"the order of {name} under {col.collation} is not known")
    return rule[3]


def to_column(tree, columns: dict[str, Col], rules: Rules = Rules()) -> Column:
    """The predicate as a Column."""
    if isinstance(tree, str):
        tree = parse(tree)
    if isinstance(tree, Not):
        return ~to_column(tree.part, columns, rules)
    if isinstance(tree, (And, Or)):
        parts = [to_column(p, columns, rules) for p in tree.parts]
        out = parts[0]
        for p in parts[1:]:
            out = (out & p) if isinstance(tree, And) else (out | p)
        return out
    name, op = tree.column, tree.op
    col = columns.get(name)
    if col is None:
        raise Refused(f"no column {name}")
    if col.generated:
        raise Refused(f"{name} is generated and cannot be filtered on")
    this = F.col(f"`{name}`")
    if op in ("IS NULL", "IS NOT NULL"):
        return this.isNull() if op == "IS NULL" else this.isNotNull()
    if isinstance(col.type, T.StringType) and not col.network:
        collation = _collated(name, col, rules, op)
        if collation != "UTF8_BINARY":
            this = F.collate(this, collation)
    values = [_value(lit, name, col, rules, op) for lit in tree.literals]
    if isinstance(col.type, T.DateType) and any(lit.kind == "string" and isinstance(temporal(str(lit.value), col, rules.lens), datetime) for lit in tree.literals):
        this = this.cast("timestamp_ntz")
    if op in ("IN", "NOT IN"):
        found = this.isin(*values)
        return ~found if op == "NOT IN" else found
    return {"=": this == values[0], "!=": this != values[0], "<": this < values[0], "<=": this <= values[0], ">": this > values[0], ">=": this >= values[0]}[op]


def where(df: DataFrame, predicate: str | None, rules: Rules = Rules(), **known: Col) -> DataFrame:
    """The rows for which the predicate is true; without one, all."""
    return df if predicate is None else df.filter(to_column(predicate, columns_of(df, **known), rules))


def check_filters(filters: list[tuple[str, str]], tables: list[str]) -> dict[str, str]:
    """Row filters by table: names match without regard to case; an unknown or doubled table is refused, as its filter would silently vanish."""
    known: dict[str, str] = {}
    for t in tables:
        known[t.lower()] = t
    out: dict[str, str] = {}
    for table, predicate in filters:
        name = known.get(table.lower())
        if name is None:
            raise Refused(f"a filter names the unknown table {table}")
        if name in out:
            raise Refused(f"two filters name the table {table}")
        parse(predicate)
        out[name] = predicate
    return out


# ---------------------------------------------------------------------------
# Push-down report and drift


@dataclass(frozen=True)
class Term:
    column: str
    op: str
    literals: tuple[Literal, ...]
    negated: bool
    disjunctive: bool
    hazards: tuple[str, ...] = ()


def hazards(tree: Compare, col: Col | None) -> tuple[str, ...]:
    """Why a source may take the literals of a comparison otherwise than to_column does."""
    found = set()
    if col is None:
        return ("unknown column",)
    for lit in tree.literals:
        if isinstance(col.type, T.BooleanType) and lit.kind == "number":
            found.add("number for a boolean")
        if isinstance(col.type, (T.DateType, T.TimestampType, T.TimestampNTZType)) and lit.kind == "string" and (m := _STAMP.match(str(lit.value).strip())):
            if m[4] is not None:
                found.add("time of day")
            if len(m[7] or "") > 6:
                found.add("finer than microseconds")
            if (isinstance(col.type, T.DateType) and m[4] is not None) or len((m[7] or "").rstrip("0")) > col.digits:
                found.add("rounded to its column")
    return tuple(sorted(found))


def terms(tree, columns: dict[str, Col] | None = None, negated: bool = False, disjunctive: bool = False) -> list[Term]:
    """The comparisons of a predicate in order, each with whether a NOT or an OR stands above it and, with columns, its hazards."""
    if isinstance(tree, str):
        tree = parse(tree)
    if isinstance(tree, Not):
        return terms(tree.part, columns, not negated, disjunctive)
    if isinstance(tree, (And, Or)):
        either = isinstance(tree, Or) != negated
        return [t for p in tree.parts for t in terms(p, columns, negated, disjunctive or either)]
    return [Term(tree.column, tree.op, tree.literals, negated, disjunctive, hazards(tree, columns.get(tree.column)) if columns is not None else ())]


def push_down(tree, columns: dict[str, Col]) -> tuple[bool, list[str]]:
    """Whether a source may evaluate the predicate itself, and why not: only types and comparisons known to mean the same everywhere."""
    why = []
    for t in terms(tree, columns):
        col = columns.get(t.column)
        if t.hazards:
            why.append(f"{t.column} {t.op}: {', '.join(t.hazards)}")
        elif t.op in ("IS NULL", "IS NOT NULL"):
            continue
        elif isinstance(col.type, (T.IntegralType, T.BooleanType, T.DecimalType)):
            continue
        elif isinstance(col.type, T.StringType) and not col.network and COLLATIONS.get((col.collation or "binary").lower(), (0, 0, 0, ""))[3] == "UTF8_BINARY" and t.op in ("=", "!=", "IN", "NOT IN"):
            continue
        else:
            why.append(f"{t.column} {t.op}: {col.type.simpleString()} may compare otherwise at the source")
    return not why, why


def fingerprint(filters: dict[str, str]) -> str:
    """A hash of a filter set that ignores order, for the check on resuming."""
    return hashlib.sha256(json.dumps(sorted(filters.items())).encode()).hexdigest()


def check_drift(stored: str | None, filters: dict[str, str]) -> None:
    if stored is not None and stored != fingerprint(filters):
        raise Refused("the row filters differ from those this stream was started with")


__all__ = ["COLLATIONS", "Col", "Rules", "check_drift", "check_filters", "columns_of", "fingerprint", "hazards", "network", "parse", "push_down", "temporal", "terms", "to_column", "where"]
