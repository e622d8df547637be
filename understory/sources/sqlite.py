"""SQLite tables as a data source: split by rowid, equality and list filters pushed into the query.

``read_sqlite`` registers the source and switches filter pushdown for Python sources on; after that
``spark.read.format("sqlite")`` and ``df.write.format("sqlite")`` with the options path and table work too.
The file must be readable by every executor.
"""

from __future__ import annotations

import itertools
import json
import sqlite3
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

_TYPES = {"INT": "long", "BIGINT": "long", "INTEGER": "long", "REAL": "double", "DOUBLE": "double", "FLOAT": "double", "TEXT": "string"}
_COMPARE = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


class SQLiteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> str:
        with sqlite3.connect(self.options["path"]) as db:
            cols = db.execute(f"PRAGMA table_info({_quoted(self.options['table'])})").fetchall()
        if wanted := self.options.get("columns"):
            named = {c[1]: c for c in cols}
            cols = [named[x] for x in json.loads(wanted)]
        return ", ".join(f"`{c[1]}` {_TYPES.get((c[2] or 'TEXT').split('(')[0].upper(), 'string')}" for c in cols)

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options, schema, overwrite)


def read_sqlite(spark: SparkSession, path: str, table: str, partitions: int = 8, columns: Sequence[str] = ()) -> DataFrame:
    """A table, or the named ``columns`` of it: Python sources aren't told which columns a query needs."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SQLiteSource)
    reader = spark.read.format("sqlite").option("path", path).option("table", table).option("partitions", partitions)
    return (reader.option("columns", json.dumps(list(columns))) if columns else reader).load()


def _types(schema: StructType) -> list[tuple[str, str]]:
    return [(f.name, {"bigint": "INTEGER", "int": "INTEGER", "double": "REAL"}.get(f.dataType.simpleString(), "TEXT")) for f in schema.fields]


def _create(db: sqlite3.Connection, table: str, columns: list[tuple[str, str]], overwrite: bool) -> str:
    """Make the table where it isn't there; the statement that inserts a row."""
    if overwrite:
        db.execute(f"DROP TABLE IF EXISTS {_quoted(table)}")
    db.execute(f"CREATE TABLE IF NOT EXISTS {_quoted(table)} ({', '.join(f'{_quoted(c)} {t}' for c, t in columns)})")
    return f"INSERT INTO {_quoted(table)} VALUES ({', '.join('?' * len(columns))})"


def _plain(row: Sequence) -> tuple:
    return tuple(x if isinstance(x, int | float | str | type(None)) else str(x) for x in row)


def write_sqlite(df: DataFrame, path: str, table: str, overwrite: bool = True, batch: int = 10_000) -> None:
    """A table into one SQLite file, which has one writer: partitions come one after the other and are never held together."""
    with sqlite3.connect(path) as db:
        insert = _create(db, table, _types(df.schema), overwrite)
        rows = map(_plain, df.toLocalIterator(prefetchPartitions=True))
        while part := list(itertools.islice(rows, batch)):
            db.executemany(insert, part)


class _Range(InputPartition):
    def __init__(self, lo: int, hi: int) -> None:
        self.lo, self.hi = lo, hi


class _Reader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType) -> None:
        self.path, self.table, self.n = options["path"], options["table"], int(options.get("partitions", "8"))
        self.columns = [f.name for f in schema.fields]
        self.where: list[str] = []
        self.values: list = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = _quoted(f.attribute[0]) if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if column and type(f) in _COMPARE:
                self.where.append(f"{column} {_COMPARE[type(f)]} ?")
                self.values.append(f.value)
            elif column and isinstance(f, In):
                self.where.append(f"{column} IN ({', '.join('?' * len(f.value))})")
                self.values += list(f.value)
            elif column and isinstance(f, IsNotNull):
                self.where.append(f"{column} IS NOT NULL")
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        with sqlite3.connect(self.path) as db:
            lo, hi = db.execute(f"SELECT min(rowid), max(rowid) FROM {_quoted(self.table)}").fetchone()
        if lo is None:
            return []
        step = max(1, -(-(hi - lo + 1) // self.n))
        return [_Range(a, min(a + step, hi + 1)) for a in range(lo, hi + 1, step)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        where = " AND ".join(["rowid >= ? AND rowid < ?", *self.where])
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as db:
            yield from db.execute(f"SELECT {', '.join(map(_quoted, self.columns))} FROM {_quoted(self.table)} WHERE {where}", [partition.lo, partition.hi, *self.values])


class _Writer(DataSourceWriter):
    """Writes a small result table: rows travel as commit messages, ``maxRows`` of them at most. ``write_sqlite`` has no limit."""

    def __init__(self, options: dict, schema: StructType, overwrite: bool) -> None:
        self.path, self.table, self.overwrite = options["path"], options["table"], overwrite
        self.limit = int(options.get("maxRows", "1000000"))
        self.columns = _types(schema)

    def _check(self, n: int) -> None:
        if n > self.limit:
            raise ValueError(f"more than {self.limit} rows for a SQLite table; use write_sqlite")

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        message = WriterCommitMessage()
        message.rows = []
        for r in iterator:
            message.rows.append(_plain(r))
            self._check(len(message.rows))
        return message

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        self._check(sum(len(m.rows) for m in messages if m))
        with sqlite3.connect(self.path) as db:
            insert = _create(db, self.table, self.columns, self.overwrite)
            for m in messages:
                db.executemany(insert, m.rows if m else [])

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        pass
