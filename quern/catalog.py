"""Tables of a database: definitions, loading, snapshots and copies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .sources import read_csv
from .types import spark_type


class CatalogError(Exception):
    """What a user asked of the catalog cannot be done."""


class Database:
    """A Spark database whose tables are Parquet; table names are lower-case.

    Key flags are kept as metadata of the columns and are not enforced.
    """

    def __init__(self, spark: SparkSession, name: str = "default"):
        self.spark, self.name = spark, name.lower()
        spark.conf.set("spark.sql.timeType.enabled", "true")
        spark.sql(f"CREATE DATABASE IF NOT EXISTS `{self.name}`")

    def _full(self, table: str) -> str:
        return f"`{self.name}`.`{table.lower()}`"

    def exists(self, table: str) -> bool:
        return self.spark.catalog.tableExists(self._full(table))

    def _need(self, table: str, there: bool) -> str:
        if self.exists(table) != there:
            raise CatalogError(f"table {table.lower()} {'does not exist' if there else 'exists already'}")
        return self._full(table)

    def tables(self) -> list[str]:
        return sorted(t.name for t in self.spark.catalog.listTables(self.name) if not t.isTemporary)

    def schema(self, table: str) -> T.StructType:
        return self.spark.table(self._need(table, True)).schema

    def table(self, name: str) -> DataFrame:
        return self.spark.table(self._need(name, True))

    def create_table(self, name: str, specs: list[tuple[str, str, set[str]]]) -> None:
        """An empty table of (column, type spelling, key flags)."""
        full = self._need(name, False)
        names = [n.lower() for n, _, _ in specs]
        if len(set(names)) < len(names):
            raise CatalogError("column names must differ")
        try:
            fields = [T.StructField(n.lower(), spark_type(kind), True, {"keys": sorted(flags)} if flags else {}) for n, kind, flags in specs]
        except ValueError as e:
            raise CatalogError(str(e)) from None
        self.spark.createDataFrame([], T.StructType(fields)).write.format("parquet").saveAsTable(full)

    def copy_table(self, source: str, target: str) -> None:
        """An empty table with another's columns."""
        self.spark.createDataFrame([], self.schema(source)).write.format("parquet").saveAsTable(self._need(target, False))

    def drop_table(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE {self._need(name, True)}")

    def load_csv(self, name: str, path: str, separator: str = ",", null: str = "NULL") -> None:
        """Replace a table's rows with those of a file."""
        full = self._need(name, True)
        rows = read_csv(self.spark, path, self.schema(name), separator=separator, null=null)
        rows.write.mode("overwrite").insertInto(full)

    def store(self, name: str, df: DataFrame, replace: bool = False) -> None:
        """A table of a result."""
        if not replace:
            self._need(name, False)
        df.write.mode("overwrite" if replace else "errorifexists").format("parquet").saveAsTable(self._full(name))

    def export(self, name: str, path: str, rows: int | None = None) -> None:
        """Copy a table, or its first rows, to Parquet elsewhere."""
        df = self.table(name)
        (df if rows is None else df.limit(rows)).write.mode("overwrite").parquet(path)

    def analyze(self, keys_only: bool = False) -> list[str]:
        """Statistics for the optimizer on all columns, or on key columns; gives the tables."""
        done = self.tables()
        for name in done:
            columns = [f.name for f in self.schema(name) if not keys_only or f.metadata.get("keys")]
            which = f" FOR COLUMNS {', '.join(f'`{c}`' for c in columns)}" if columns else ""
            self.spark.sql(f"ANALYZE TABLE {self._full(name)} COMPUTE STATISTICS{which}")
        return done

    def sort(self, name: str, columns: list[str]) -> None:
        """Lay a table out in order of ``columns``, so that ranges of them skip files and row groups.

        Its rows are written anew before the old ones go; were it stopped between the two, they
        would be in ``<name>__sorted``.
        """
        full = self._need(name, True)
        there = {c.lower(): c for c in self.schema(name).names}
        if not columns or (unknown := [c for c in columns if c.lower() not in there]):
            raise CatalogError(f"no columns {unknown} to sort by" if columns else "sorting takes columns")
        keys = [there[c.lower()] for c in columns]
        written = f"{name.lower()}__sorted"
        self.store(written, self.spark.table(full).repartitionByRange(*keys).sortWithinPartitions(*keys))
        self.drop_table(name)
        self.spark.sql(f"ALTER TABLE {self._full(written)} RENAME TO {full}")
