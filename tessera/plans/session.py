"""SQL sessions with table versions: SELECT by Spark, INSERT, UPDATE and DELETE as rewrites of immutable DataFrames.

Each table name holds its current DataFrame. BEGIN keeps the map of versions, ROLLBACK brings it back, COMMIT drops
the saved one. There are no concurrent writers and no locks.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.session import written
from tessera.sources.tables import declared

#: Rewrites of one table before it is written out to cut its lineage.
REWRITES = 20


@dataclass
class Result:
    """rows stay lazy in df; affected counts changed rows; success is no message or one that starts with OK."""

    df: DataFrame | None = None
    affected: int = 0
    message: str = ""

    @property
    def success(self) -> bool:
        return not self.message or self.message.startswith("OK")

    @property
    def columns(self) -> list[str]:
        return self.df.columns if self.df is not None else []

    def rows(self) -> list:
        return self.df.collect() if self.df is not None else []


@dataclass
class Session:
    spark: SparkSession
    autocommit: bool = True
    tables: dict[str, DataFrame] = field(default_factory=dict)
    saved: list[dict[str, DataFrame]] = field(default_factory=list)
    rewrites: dict[str, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.spark = self.spark.newSession()

    def register(self, name: str, df: DataFrame) -> None:
        """df as the table's version; it must belong to this session (session.spark)."""
        self.tables[name.lower()] = df
        df.createOrReplaceTempView(name)

    def _put(self, name: str, df: DataFrame) -> None:
        n = self.rewrites[name] = self.rewrites.get(name, 0) + 1
        if n % REWRITES == 0:
            df = written(df, name)
        self.register(name, df)

    def _table(self, name: str) -> DataFrame:
        if name.lower() not in self.tables:
            raise LookupError(f"no table {name}")
        return self.tables[name.lower()]

    def execute_many(self, statements: list[str]) -> list[Result]:
        return [self.execute(s) for s in statements]

    def execute(self, text: str) -> Result:
        """Run one statement; errors come back as a message."""
        try:
            return self._run(text.strip().rstrip(";"))
        except Exception as e:
            return Result(message=f"Error: {str(e).splitlines()[0]}")

    def _run(self, s: str) -> Result:
        word = s.split(None, 1)[0].upper() if s else ""
        if word in ("BEGIN", "START"):
            self.saved.append((dict(self.tables)))
            return Result(message="OK: BEGIN")
        if word == "COMMIT":
            self.saved and self.saved.pop()
            return Result(message="OK: COMMIT")
        if word == "ROLLBACK":
            if self.saved:
                old = self.saved.pop()
                for gone in self.tables.keys() - old.keys():
                    self.spark.catalog.dropTempView(gone)
                self.tables = {}
                for k, v in old.items():
                    self.register(k, v)
            return Result(message="OK: ROLLBACK")
        if not self.autocommit and not self.saved and word in ("INSERT", "UPDATE", "DELETE", "CREATE", "DROP"):
            self.saved.append((dict(self.tables)))
        return {"CREATE": self._create, "DROP": self._drop, "INSERT": self._insert, "UPDATE": self._update, "DELETE": self._delete}.get(word, self._select)(s)

    def _select(self, s: str) -> Result:
        return Result(df=self.spark.sql(s))

    def _create(self, s: str) -> Result:
        m = re.match(r"(?is)create\s+table\s+(if\s+not\s+exists\s+)?(\w+)\s*\((.*)\)$", s)
        if not m:
            raise ValueError("CREATE TABLE name (column type, ...)")
        if m[2].lower() in self.tables:
            if m[1]:
                return Result(message="OK: exists")
            raise ValueError(f"table {m[2]} exists")
        fields = []
        for part in re.split(r",(?![^(]*\))", m[3]):
            if re.match(r"(?i)\s*(primary|unique|foreign|constraint|check)\b", part):
                continue
            name, kind, size = re.match(r"\s*(\w+)\s+(\w+)(?:\s*\(\s*(\d+)[^)]*\))?", part).groups()
            strict = bool(re.search(r"(?i)not\s+null|primary\s+key", part))
            fields.append(T.StructField(name, declared(kind), True, {"not_null": strict} | ({"max_length": int(size)} if size else {})))
        self.register(m[2], self.spark.createDataFrame([], T.StructType(fields)))
        return Result(message="OK: CREATE TABLE")

    def _drop(self, s: str) -> Result:
        m = re.match(r"(?is)drop\s+table\s+(if\s+exists\s+)?(\w+)$", s)
        if m[2].lower() not in self.tables:
            if m[1]:
                return Result(message="OK: absent")
            raise LookupError(f"no table {m[2]}")
        del self.tables[m[2].lower()]
        self.spark.catalog.dropTempView(m[2])
        return Result(message="OK: DROP TABLE")

    def _insert(self, s: str) -> Result:
        m = re.match(r"(?is)insert\s+into\s+(\w+)\s*(?:\(([\w\s,]+)\)\s*)?((?:values|select)\b.*)$", s)
        old = self._table(m[1])
        names = [c.strip() for c in m[2].split(",")] if m[2] else old.columns
        new = self.spark.sql(m[3] if m[3][:6].lower() == "select" else f"SELECT * FROM {m[3]}")
        if len(new.columns) != len(names):
            raise ValueError(f"{len(names)} columns, {len(new.columns)} values")
        new = new.toDF(*names)
        cast = new.select(*[(F.col(f.name).cast(f.dataType) if f.name in names else F.lit(None).cast(f.dataType)).alias(f.name) for f in old.schema])
        for f in old.schema:
            if f.metadata.get("not_null") and cast.where(F.col(f.name).isNull()).limit(1).count():
                raise ValueError(f"{f.name} may not be null")
        n = cast.count()
        self._put(m[1], old.unionByName(cast))
        return Result(affected=n, message=f"OK: {n}")

    def _where(self, text: str | None):
        return F.coalesce(F.expr(text), F.lit(False)) if text else F.lit(True)

    def _update(self, s: str) -> Result:
        m = re.match(r"(?is)update\s+(\w+)\s+set\s+(.*?)(?:\s+where\s+(.*))?$", s)
        old, p = self._table(m[1]), self._where(m[3])
        sets = {k.strip(): v for k, v in (x.split("=", 1) for x in re.split(r",(?![^(]*\))(?=(?:[^']*'[^']*')*[^']*$)", m[2]))}
        unknown = set(sets) - set(old.columns)
        if unknown:
            raise LookupError(f"no column {unknown.pop()}")
        n = old.where(p).count()
        self._put(m[1], old.select(*[(F.when(p, F.expr(sets[f.name]).cast(f.dataType)).otherwise(F.col(f.name)) if f.name in sets else F.col(f.name)).alias(f.name) for f in old.schema]))
        return Result(affected=n, message=f"OK: {n}")

    def _delete(self, s: str) -> Result:
        m = re.match(r"(?is)delete\s+from\s+(\w+)(?:\s+where\s+(.*))?$", s)
        old, p = self._table(m[1]), self._where(m[2])
        n = old.where(p).count()
        self._put(m[1], old.where(~p))
        return Result(affected=n, message=f"OK: {n}")
