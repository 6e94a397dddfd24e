"""Tables and their keys, and the pure rewrites and comparisons of them that happen before any row is read."""

from __future__ import annotations

import fnmatch
import hashlib
import json
import re
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import Refused
from .types import SqlType, field_of, spark_type


@dataclass(frozen=True)
class Column:
    name: str
    type: SqlType
    nullable: bool = True
    default: str | None = None
    generated: str | None = None
    auto_increment: bool = False


@dataclass(frozen=True)
class Index:
    name: str
    columns: tuple[str, ...]
    unique: bool = False
    partial: str | None = None
    expressions: bool = False


@dataclass(frozen=True)
class ForeignKey:
    name: str
    columns: tuple[str, ...]
    parent: str
    parent_columns: tuple[str, ...]


@dataclass(frozen=True)
class Table:
    name: str
    columns: tuple[Column, ...]
    key: tuple[str, ...] = ()
    indexes: tuple[Index, ...] = ()
    foreign_keys: tuple[ForeignKey, ...] = ()
    checks: tuple[str, ...] = ()

    def column(self, name: str) -> Column:
        for c in self.columns:
            if c.name.lower() == name.lower():
                return c
        raise Refused(f"{self.name} has no column {name}")

    def spark_schema(self) -> T.StructType:
        """The columns that are read and written: generated ones are not."""
        return T.StructType([field_of(c.name, c.type, c.nullable) for c in self.columns if not c.generated])


@dataclass(frozen=True)
class Catalog:
    tables: tuple[Table, ...] = field(default_factory=tuple)

    def table(self, name: str) -> Table:
        for t in self.tables:
            if t.name.lower() == name.lower():
                return t
        raise Refused(f"no table {name}")


def readable(df: DataFrame, table: Table) -> DataFrame:
    """The columns of a table that hold data of their own."""
    return df.select(*[c.name for c in table.columns if not c.generated])


# ---------------------------------------------------------------------------
# Scope


def scope(names: list[str], include: list[str] = (), exclude: list[str] = ()) -> list[str]:
    """Names by patterns with *, ? and [abc]; either what is included or all but what is excluded.  A pattern that matches nothing is refused."""
    if include and exclude:
        raise Refused("include and exclude do not go together")
    for p in [*include, *exclude]:
        if not any(fnmatch.fnmatchcase(n, p) for n in names):
            raise Refused(f"the pattern {p} matches nothing")
    if include:
        return [n for n in names if any(fnmatch.fnmatchcase(n, p) for p in include)]
    return [n for n in names if not any(fnmatch.fnmatchcase(n, p) for p in exclude)]


#: Bookkeeping tables of common frameworks (fixed names), beginnings of such names, and generic names that count only with exactly
#: these columns: name, (family, whether it must be there).
FRAMEWORK_TABLES = frozenset({
    "_prisma_migrations", "knex_migrations", "knex_migrations_lock", "sequelizemeta", "ar_internal_metadata", "flyway_schema_history",
    "databasechangelog", "databasechangeloglock", "django_migrations", "alembic_version", "typeorm_metadata", "goose_db_version",
    "__efmigrationshistory", "doctrine_migration_versions", "phinxlog", "_sqlx_migrations", "__diesel_schema_migrations",
    "seaql_migrations", "mikro_orm_migrations", "pgmigrations", "atlas_schema_revisions", "aerich", "_fluent_migrations",
})
FRAMEWORK_PREFIXES = ("__drizzle",)
GENERIC_TABLES = {
    "schema_migrations": {"version": ("text", True)},
    "migrations": {"migration": ("text", True), "batch": ("integer", True), "id": ("integer", False)},
    "migration": {"version": ("text", True), "apply_time": ("integer", True)},
}
#: Kinds of a column by family.
FAMILIES = {"text": {"text", "varchar", "char", "string"}, "integer": {"integer", "int", "bigint", "smallint", "tinyint", "mediumint"}}


def is_framework_table(name: str, columns: list[str] | dict[str, str | None]) -> bool:
    """Whether a table is a framework's bookkeeping.  columns: names, or names with their kinds; a kind that is not known fits.

    A generic name counts only if the table has the columns that such a table has and no others; anything else is application data.
    """
    low = name.rpartition(".")[2].lower()
    if low in FRAMEWORK_TABLES or low.startswith(FRAMEWORK_PREFIXES):
        return True
    shape = GENERIC_TABLES.get(low)
    if shape is None:
        return False
    kinds = {c.lower(): k for c, k in (columns.items() if isinstance(columns, dict) else ((c, None) for c in columns))}
    if not {c for c, (_, must) in shape.items() if must} <= set(kinds) <= set(shape):
        return False
    return all(k is None or k.lower() in FAMILIES[shape[c][0]] for c, k in kinds.items())


def application_tables(tables: dict[str, list[str] | dict[str, str | None]], include: list[str] = (), exclude: list[str] = ()) -> list[str]:
    """The tables in scope without bookkeeping; a bookkeeping table that a pattern includes stays."""
    return [n for n in scope(list(tables), include, exclude) if include or not is_framework_table(n, tables[n])]


def namespaces(tables: list[str], mapping: dict[str, str], default: str | None = None) -> dict[str, str]:
    """New names of `namespace.table` names; two tables may not end up as one."""
    out: dict[str, str] = {}
    for t in tables:
        space, _, name = t.rpartition(".")
        target = mapping.get(space, default if default is not None else space)
        new = f"{target}.{name}" if target else name
        if new in out.values():
            raise Refused(f"{t} and another table both become {new}")
        out[t] = new
    if unknown := set(mapping) - {t.rpartition(".")[0] for t in tables}:
        raise Refused(f"mapped namespaces that no table has: {sorted(unknown)}")
    return out


# ---------------------------------------------------------------------------
# Rewrites

_TYPE = re.compile(r"^(\w+)\s*(?:\(([^)]*)\))?$")


def parse_type(text: str) -> SqlType:
    """kind, kind(length) or kind(precision,scale); `unsigned` and `tz` may follow."""
    words = text.strip().lower().split()
    m = _TYPE.match(words[0]) if words else None
    if not m:
        raise Refused(f"cannot read the type {text!r}")
    aliases = {"int": ("integer", 32), "bigint": ("integer", 64), "smallint": ("integer", 16), "tinyint": ("integer", 8), "mediumint": ("integer", 24), "numeric": ("decimal", None), "double": ("float", 64), "real": ("float", 32), "bool": ("boolean", None), "jsonb": ("json", None), "timestamptz": ("timestamp", None), "bytea": ("blob", None), "string": ("text", None), "longtext": ("text", None)}
    kind, bits = aliases.get(m[1], (m[1], None))
    numbers = [int(x) for x in m[2].split(",")] if m[2] and kind in ("decimal", "char", "varchar", "binary", "varbinary", "bit", "time", "datetime", "timestamp") else []
    extra = {"bits": bits} if bits else {}
    if kind == "decimal" and numbers:
        extra |= {"precision": numbers[0], "scale": numbers[1] if len(numbers) > 1 else 0}
    elif numbers:
        extra |= {"length" if kind not in ("time", "datetime", "timestamp") else "precision": numbers[0]}
    if kind in ("enum", "set") and m[2]:
        extra |= {"values": tuple(re.findall(r"'((?:[^']|'')*)'", text[text.index("(") :]))}
    return SqlType(kind, unsigned="unsigned" in words, tz="tz" in words or m[1] == "timestamptz", binary=m[1] == "jsonb", **extra)


def override_types(catalog: Catalog, overrides: list[str]) -> Catalog:
    """TABLE.COLUMN=type for each; a column that is not there is refused."""
    for o in overrides:
        left, eq, right = o.partition("=")
        table, dot, column = left.strip().rpartition(".")
        if not eq or not dot:
            raise Refused(f"{o!r} is not TABLE.COLUMN=type")
        t = catalog.table(table)
        old = t.column(column)
        new = replace(t, columns=tuple(replace(c, type=parse_type(right)) if c is old else c for c in t.columns))
        catalog = Catalog(tuple(new if x is t else x for x in catalog.tables))
    return catalog


def cast_to(df: DataFrame, table: Table) -> DataFrame:
    """df with the columns as the catalog says; ANSI casts raise on what does not fit."""
    return df.select(*[F.col(c.name).cast(spark_type(c.type)).alias(c.name) for c in table.columns if not c.generated])


def generated_columns(df: DataFrame, table: Table, overrides: dict[str, str] | None = None) -> DataFrame:
    """df with the generated columns computed, by their own expressions or those given instead."""
    overrides = {k.lower(): v for k, v in (overrides or {}).items()}
    for c in table.columns:
        if c.generated:
            df = df.withColumn(c.name, F.expr(overrides.get(c.name.lower(), c.generated)).cast(spark_type(c.type)))
    return df


def inject_shard(table: Table, column: str, type_: SqlType) -> Table:
    """The table with a discriminator as its first column and first part of its key."""
    if not table.key:
        raise Refused(f"{table.name} has no primary key to put the discriminator into")
    if any(c.name.lower() == column.lower() for c in table.columns):
        raise Refused(f"{table.name} already has a column {column}")
    return replace(table, columns=(Column(column, type_, nullable=False), *table.columns), key=(column, *table.key), indexes=tuple(replace(i, columns=(column, *i.columns)) if i.unique else i for i in table.indexes))


def consolidate(shards: dict[str, DataFrame], column: str) -> DataFrame:
    """The rows of all shards with the shard's name in front; columns match by name."""
    out = None
    for name, df in shards.items():
        if column in df.columns:
            raise Refused(f"the shards already have a column {column}")
        part = df.select(F.lit(name).alias(column), "*")
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise Refused("no shards")
    return out


def upsert_key(table: Table) -> tuple[str, ...]:
    """What identifies a row: the primary key, else a plain unique index without nullable columns; else upserts are refused."""
    if table.key:
        return table.key
    for i in table.indexes:
        if i.unique and not i.partial and not i.expressions and all(not table.column(c).nullable for c in i.columns):
            return i.columns
    raise Refused(f"{table.name} has neither a primary key nor a unique index without nulls")


# ---------------------------------------------------------------------------
# Comparison


def shape_diff(source: Table, target: Table) -> list[str]:
    """What differs column by column; nullability of key columns and auto-increment do not count, and the target may have a key more."""
    a, b = {c.name.lower(): c for c in source.columns}, {c.name.lower(): c for c in target.columns}
    key = {k.lower() for k in source.key}
    out = [f"missing column {c.name}" for n, c in a.items() if n not in b] + [f"extra column {c.name}" for n, c in b.items() if n not in a]
    for n in a:
        if n in b:
            if a[n].type != b[n].type:
                out.append(f"column {n}: type {a[n].type.kind} and {b[n].type.kind}")
            if a[n].nullable != b[n].nullable and n not in key:
                out.append(f"column {n}: nullable on one side")
    if source.key and not target.key:
        out.append("missing primary key")
    elif source.key and [k.lower() for k in source.key] != [k.lower() for k in target.key]:
        out.append("different primary key")
    return out


def diff(source: Catalog, target: Catalog) -> dict[str, list[str]]:
    a, b = {t.name.lower(): t for t in source.tables}, {t.name.lower(): t for t in target.tables}
    out = {}
    for n in sorted({*a, *b}):
        found = ["missing table"] if n not in b else ["extra table"] if n not in a else shape_diff(a[n], b[n])
        if found:
            out[n] = found
    return out


def render(differences: dict[str, list[str]], as_json: bool = False) -> str:
    if as_json:
        return json.dumps(differences, sort_keys=True)
    return "\n".join(line for n, d in sorted(differences.items()) for line in (n, *(f"  {x}" for x in d))) or "no difference"


@dataclass(frozen=True)
class Delta:
    dropped: tuple[str, ...]
    added: tuple[Table, ...]
    altered: tuple[tuple[str, tuple[str, ...]], ...]


def delta(old: Catalog, new: Catalog) -> Delta:
    """What turns one catalog into another, in the order it must happen: drop, add, alter."""
    a, b = {t.name: t for t in old.tables}, {t.name: t for t in new.tables}
    altered = tuple((n, tuple(shape_diff(b[n], a[n]))) for n in b if n in a and shape_diff(b[n], a[n]))
    return Delta(tuple(n for n in a if n not in b), tuple(b[n] for n in b if n not in a), altered)


def schema_hash(catalog: Catalog) -> str:
    """SHA-256 of the catalog; the order of tables and columns counts, that of indexes and keys does not."""
    tables = []
    for t in catalog.tables:
        d = asdict(t)
        for k in ("indexes", "foreign_keys"):
            d[k] = sorted(d[k], key=lambda x: x["name"])
        d["checks"] = sorted(d["checks"])
        tables.append(d)
    return hashlib.sha256(json.dumps(tables, sort_keys=True, default=str).encode()).hexdigest()


def structural_change(old: Table, new: Table) -> bool:
    """Only names and types of columns in their order make a new version."""
    return [(c.name, c.type) for c in old.columns] != [(c.name, c.type) for c in new.columns]


def schema_at(history: list[tuple[object, Table]], position: object, at_or_after: Callable[[object, object], bool]) -> Table:
    """The version in effect at a position, by a partial order; entries that cannot be compared are refused unless they are the same."""
    seen = [(p, t) for p, t in history if at_or_after(position, p)]
    if not seen:
        raise Refused("no schema is known at that position")
    top = [(p, t) for p, t in seen if not any(at_or_after(q, p) and not at_or_after(p, q) for q, _ in seen)]
    if any(structural_change(top[0][1], t) for _, t in top[1:]):
        raise Refused("several schemas could be in effect at that position")
    return top[-1][1]


# ---------------------------------------------------------------------------
# Lint


def lint(table: Table, target: str = "mysql") -> list[str]:
    """What may go wrong with a table on another kind of store."""
    out = []
    names: dict[str, str] = {}
    for c in table.columns:
        t = c.type.storage()
        if c.name.lower() in names:
            out.append(f"{c.name}: collides with {names[c.name.lower()]} where case does not count")
        names[c.name.lower()] = c.name
        if len(c.name.encode()) > (64 if target == "mysql" else 63):
            out.append(f"{c.name}: the name is too long")
        if t.kind == "timestamp" and target == "mysql":
            out.append(f"{c.name}: times outside 1970 to 2038 do not fit")
        if t.kind == "decimal" and t.precision is None:
            out.append(f"{c.name}: unconstrained numeric has no exact fixed type")
        if t.kind == "integer" and t.unsigned and t.bits == 64 and target == "postgres":
            out.append(f"{c.name}: unsigned 64-bit integers need numeric(20)")
        if t.kind == "varchar" and (t.length or 0) > 16383 and target == "mysql":
            out.append(f"{c.name}: varchar({t.length}) is too wide")
        if t.kind in ("enum", "set") and any(len(v) > 255 for v in t.values):
            out.append(f"{c.name}: a declared value is too long")
        if t.collation and target == "postgres" and t.collation.lower().endswith("_ci"):
            out.append(f"{c.name}: the collation {t.collation} is dropped, so comparisons will mind the case")
        if c.generated and re.search(r"\b(now|rand|random|uuid|current_\w+)\b", c.generated, re.I):
            out.append(f"{c.name}: its generation expression is not deterministic")
        if c.generated and any(re.search(rf"\b{re.escape(o.name)}\b", c.generated, re.I) for o in table.columns if o.generated and o is not c):
            out.append(f"{c.name}: is generated from another generated column")
    for i in table.indexes:
        for n in i.columns:
            if table.column(n).type.storage().kind in ("text", "blob", "json") and target == "mysql":
                out.append(f"index {i.name}: {n} needs a prefix length")
    if not table.key:
        out.append("no primary key")
    return out


def sequence_start(df: DataFrame, column: str) -> int:
    """The next value of a sequence behind the largest in use."""
    return (df.agg(F.max(column)).first()[0] or 0) + 1
