"""Tables of databases through JDBC, row chunks of backups, and a registry of what can be read."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..errors import Refused
from ..types import Capabilities

REGISTRY: dict[str, Capabilities] = {}


def register(c: Capabilities) -> None:
    if c.name in REGISTRY:
        raise Refused(f"the connector {c.name} is registered already")
    REGISTRY[c.name] = c


def connector(name: str) -> Capabilities:
    if name not in REGISTRY:
        raise Refused(f"unknown connector {name}; known: {', '.join(sorted(REGISTRY))}")
    return REGISTRY[name]


for _c in (
    Capabilities("postgres", writes=True, bulk=True, pushdown=True, namespaces=True),
    Capabilities("mysql", writes=True, bulk=True, pushdown=True, namespaces=True),
    Capabilities("sqlite", writes=True, pushdown=True),
    Capabilities("parquet", writes=True, bulk=True, pushdown=True),
    Capabilities("csv"),
    Capabilities("ndjson"),
    Capabilities("sqldump"),
    Capabilities("chunks", writes=True, changes=True),
):
    register(_c)


def quote(name: str, dialect: str) -> str:
    q = "`" if dialect == "mysql" else '"'
    return q + name.replace(q, q * 2) + q


def literal(v) -> str:
    if isinstance(v, bool) or v is None:
        raise Refused("such a key has no order")
    return str(v) if isinstance(v, int) else "'" + str(v).replace("'", "''") + "'"


def key_predicate(key: list[str], after: tuple | None, up_to: tuple | None, dialect: str, where: str | None = None) -> str:
    """(k1, k2) > (..) AND (k1, k2) <= (..) AND (predicate), the predicate always in parentheses."""
    names = ", ".join(quote(k, dialect) for k in key)
    parts = []
    if after is not None:
        parts.append(f"({names}) > ({', '.join(map(literal, after))})")
    if up_to is not None:
        parts.append(f"({names}) <= ({', '.join(map(literal, up_to))})")
    if where:
        parts.append(f"({where})")
    return " AND ".join(parts) or "1=1"


def chunk_predicates(key: list[str], edges: list[tuple], dialect: str, where: str | None = None) -> list[str]:
    """One predicate per chunk between the edges, open at both ends; together they cover every row once."""
    ends = [None, *edges, None]
    return [key_predicate(key, a, b, dialect, where) for a, b in zip(ends[:-1], ends[1:], strict=True)]


def read_jdbc(spark: SparkSession, url: str, table: str, key: list[str] | None = None, edges: list[tuple] = (), where: str | None = None, **options: str) -> DataFrame:
    """A table in parallel, one task per chunk of its key; without edges, one task."""
    dialect = url.split(":")[1] if url.startswith("jdbc:") else ""
    connector({"postgresql": "postgres", "mariadb": "mysql"}.get(dialect, dialect))
    predicates = chunk_predicates(key or [], list(edges), dialect, where) if key else [f"({where})" if where else "1=1"]
    return spark.read.jdbc(url, table, predicates=predicates, properties={"fetchsize": "10000", **options})


def read_chunks(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Row chunks of a backup: JSON lines, plain, gzip or zstd by their names; a line that does not fit is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def chain(manifests: list[dict]) -> list[dict]:
    """A backup's manifests from the full one on, each naming its parent; forks, gaps and strangers are refused."""
    full = [m for m in manifests if not m.get("parent")]
    if len(full) != 1:
        raise Refused(f"{len(full)} full backups in one chain")
    children: dict[str, list[dict]] = {}
    for m in manifests:
        if m.get("parent"):
            children.setdefault(m["parent"], []).append(m)
    out = [full[0]]
    while below := children.pop(out[-1]["id"], None):
        if len(below) > 1:
            raise Refused(f"two backups follow {out[-1]['id']}")
        out.append(below[0])
    if children:
        raise Refused(f"backups without their parents: {sorted(children)}")
    return out


def read_manifests(spark: SparkSession, path: str) -> list[dict]:
    """The manifests at a path, in the order of their chain; there is one per backup."""
    rows = spark.read.text(path, wholetext=True).collect()
    return chain([json.loads(r["value"]) for r in rows])
