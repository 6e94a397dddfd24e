"""The dialect-neutral column types: how each is stored by Spark and what a value must satisfy to be stored exactly."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import Refused


@dataclass(frozen=True)
class SqlType:
    """kind is one of KINDS.  Of the parameters each kind uses those it needs and leaves the others as they are."""

    kind: str
    bits: int = 64
    unsigned: bool = False
    precision: int | None = None
    scale: int | None = None
    length: int | None = None
    varying: bool = False
    tz: bool = False
    values: tuple[str, ...] = ()
    element: SqlType | None = None
    base: SqlType | None = None
    srid: int | None = None
    collation: str | None = None
    charset: str | None = None
    binary: bool = False
    name: str | None = None

    def __post_init__(self):
        if self.kind not in KINDS:
            raise Refused(f"unknown type {self.kind!r}")

    def storage(self) -> SqlType:
        """A domain's base, down to a type that is none."""
        return self.base.storage() if self.kind == "domain" and self.base else self


#: Every kind there is; the registry below must cover exactly these.
KINDS = (
    "boolean", "integer", "decimal", "float", "char", "varchar", "text", "binary", "varbinary", "blob", "bit", "date", "time", "interval",
    "datetime", "timestamp", "json", "enum", "set", "uuid", "array", "geometry", "inet", "cidr", "macaddr", "domain", "extension", "verbatim",
)


def _integer(t: SqlType) -> T.DataType:
    signed = {8: T.ByteType(), 16: T.ShortType(), 24: T.IntegerType(), 32: T.IntegerType(), 64: T.LongType()}
    if t.bits not in signed:
        raise Refused(f"no integer of {t.bits} bits")
    if not t.unsigned:
        return signed[t.bits]
    return {8: T.ShortType(), 16: T.IntegerType(), 24: T.IntegerType(), 32: T.LongType(), 64: T.DecimalType(20, 0)}[t.bits]


def _decimal(t: SqlType) -> T.DataType:
    if t.precision is None or t.precision > 38:
        return T.StringType()  # exact text: Spark has no wider decimal
    scale = t.scale or 0
    if scale < 0:
        return T.DecimalType(t.precision - scale, 0) if t.precision - scale <= 38 else T.StringType()
    if scale > t.precision:
        return T.DecimalType(scale, scale) if scale <= 38 else T.StringType()
    return T.DecimalType(t.precision, scale)


def _array(t: SqlType) -> T.DataType:
    if t.element is None:
        raise Refused("an array needs an element type")
    if t.element.storage().kind == "array":
        raise Refused("arrays of arrays have no declared shape and are refused")
    return T.ArrayType(spark_type(t.element), True)


_SPARK: dict[str, Callable[[SqlType], T.DataType]] = {
    "boolean": lambda t: T.BooleanType(),
    "integer": _integer,
    "decimal": _decimal,
    "float": lambda t: T.FloatType() if t.bits == 32 else T.DoubleType(),
    "char": lambda t: T.StringType(),
    "varchar": lambda t: T.StringType(),
    "text": lambda t: T.StringType(),
    "binary": lambda t: T.BinaryType(),
    "varbinary": lambda t: T.BinaryType(),
    "blob": lambda t: T.BinaryType(),
    "bit": lambda t: T.StringType(),
    "date": lambda t: T.DateType(),
    # a time of day as text: writing Spark's own time type needs a session setting
    "time": lambda t: T.StringType(),
    "interval": lambda t: T.StringType(),
    "datetime": lambda t: T.TimestampNTZType(),
    "timestamp": lambda t: T.TimestampType() if t.tz else T.TimestampNTZType(),
    "json": lambda t: T.StringType(),
    "enum": lambda t: T.StringType(),
    "set": lambda t: T.ArrayType(T.StringType(), True),
    "uuid": lambda t: T.StringType(),
    "array": _array,
    "geometry": lambda t: T.BinaryType(),
    "inet": lambda t: T.StringType(),
    "cidr": lambda t: T.StringType(),
    "macaddr": lambda t: T.StringType(),
    "domain": lambda t: spark_type(t.storage()) if t.base else T.StringType(),
    "extension": lambda t: T.StringType(),
    "verbatim": lambda t: T.StringType(),
}


def spark_type(t: SqlType) -> T.DataType:
    return _SPARK[t.kind](t)


def field_of(name: str, t: SqlType, nullable: bool = True) -> T.StructField:
    """A column whose metadata keep what the Spark type cannot say."""
    keep = {k: v for k, v in {"kind": t.kind, "length": t.length, "precision": t.precision, "scale": t.scale, "collation": t.collation, "charset": t.charset, "values": list(t.values) or None, "srid": t.srid, "unsigned": t.unsigned or None, "type_name": t.name}.items() if v is not None}
    return T.StructField(name, spark_type(t), nullable, metadata=keep)


# ---------------------------------------------------------------------------
# Exact values or none


def _refuse(message: str, value: Column) -> Column:
    return F.raise_error(F.concat(F.lit(message + ": "), value.cast("string")))


def exact_decimal(text: Column, precision: int, scale: int) -> Column:
    """Decimal text as decimal(precision, scale); refuses NaN, infinities, digits it cannot hold; zero excess digits go."""
    plain = F.trim(text.cast("string"))
    kept = F.regexp_replace(F.regexp_replace(plain, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    whole = F.regexp_replace(F.regexp_extract(kept, r"^[+-]?(\d*)", 1), r"^0+", "")
    fraction = F.regexp_extract(kept, r"\.(\d*)$", 1)
    fits = plain.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)$") & (F.length(whole) <= precision - scale) & (F.length(fraction) <= scale)
    return F.when(text.isNull(), None).when(fits, kept.cast(T.DecimalType(precision, scale))).otherwise(_refuse(f"not exactly a decimal({precision},{scale})", plain))


def exact_unsigned(text: Column) -> Column:
    """An unsigned 64-bit integer as decimal(20,0)."""
    number = F.when(text.cast("string").rlike(r"^\d{1,20}$"), text.cast("decimal(20,0)"))
    return F.when(text.isNull(), None).when(number <= F.lit("18446744073709551615").cast("decimal(20,0)"), number).otherwise(_refuse("not an unsigned 64-bit integer", text))


def exact_time(text: Column) -> Column:
    """A time of day HH:MM:SS[.ffffff] as text with six digits; refuses negative ones, 24 h and more, and parts of microseconds."""
    good = text.rlike(r"^([01]\d|2[0-3]):[0-5]\d:[0-5]\d(\.\d{1,6}0*)?$")
    micros = F.rpad(F.substring(F.regexp_extract(text, r"\.(\d+)$", 1), 1, 6), 6, "0")
    return F.when(text.isNull(), None).when(good, F.concat(F.substring(text, 1, 8), F.lit("."), micros)).otherwise(_refuse("not a time of day in whole microseconds", text))


def exact_date(value: Column) -> Column:
    """A timestamp as a date; refuses what is not midnight."""
    day = F.to_date(value)
    return F.when(value.isNull(), None).when(day.cast("timestamp_ntz") == value.cast("timestamp_ntz"), day).otherwise(_refuse("not midnight", value))


def exact_bits(text: Column, length: int | None, varying: bool = False) -> Column:
    """A bit string of '0' and '1'; of exactly the length, or at most it if varying."""
    size = r"*" if length is None else rf"{{0,{length}}}" if varying else rf"{{{length}}}"
    return F.when(text.isNull() | text.rlike(rf"^[01]{size}$"), text).otherwise(_refuse("not such a bit string", text))


def exact_member(text: Column, values: tuple[str, ...]) -> Column:
    return F.when(text.isNull() | text.isin(*values), text).otherwise(_refuse("not a declared value", text))


def exact_members(items: Column, values: tuple[str, ...]) -> Column:
    odd = F.array_except(items, F.array(*[F.lit(v) for v in values]))
    return F.when(items.isNull() | (F.size(odd) == 0), items).otherwise(_refuse("not declared members", F.array_join(odd, ",")))


def exact_uuid(text: Column) -> Column:
    low = F.lower(text)
    return F.when(text.isNull(), None).when(low.rlike(r"^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"), low).otherwise(_refuse("not a uuid", text))


def same_srid(srid: Column, declared: int) -> Column:
    """The row's SRID, which must be the column's."""
    return F.when(srid.isNull() | (srid == declared), srid).otherwise(_refuse(f"SRID differs from {declared}", srid))


def exact(value: Column, t: SqlType) -> Column:
    """A raw value as the column's Spark type, or an error: nothing is rounded, cut or guessed."""
    t = t.storage()
    if t.kind == "decimal" and isinstance(spark_type(t), T.DecimalType):
        kind = spark_type(t)
        return exact_decimal(value, kind.precision, kind.scale)
    if t.kind == "integer" and t.unsigned and t.bits == 64:
        return exact_unsigned(value)
    if t.kind == "integer" and t.unsigned:
        number = value.cast(spark_type(t))
        return F.when(number.isNull() | number.between(0, 2**t.bits - 1), number).otherwise(_refuse(f"not an unsigned {t.bits}-bit integer", value))
    if t.kind == "integer" and t.bits == 24:
        number = value.cast("int")
        return F.when(number.isNull() | number.between(-(2**23), 2**23 - 1), number).otherwise(_refuse("not a 24-bit integer", value))
    if t.kind == "time" and not t.tz:
        return exact_time(value)
    if t.kind == "bit":
        return exact_bits(value, t.length, t.varying)
    if t.kind == "enum" and t.values:
        return exact_member(value, t.values)
    if t.kind == "set" and t.values:
        return exact_members(value, t.values)
    if t.kind == "uuid":
        return exact_uuid(value)
    if t.kind in ("char", "varchar") and t.length is not None:
        return F.when(value.isNull() | (F.char_length(value) <= t.length), value).otherwise(_refuse(f"longer than {t.length}", value))
    return value.cast(spark_type(t))  # ANSI casts raise


@dataclass(frozen=True)
class Capabilities:
    """What a connector can do."""

    name: str
    reads: bool = True
    writes: bool = False
    changes: bool = False
    bulk: bool = False
    pushdown: bool = False
    namespaces: bool = False
    options: tuple[str, ...] = field(default=())


def with_length(t: SqlType, length: int | None) -> SqlType:
    return replace(t, length=length)
