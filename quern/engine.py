"""One statement of the dialect at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import dialect, heavy
from .catalog import CatalogError, Database


class Engine:
    """Runs statements of the dialect in a database."""

    def __init__(self, spark: SparkSession, database: str = "default"):
        self.spark = spark
        self.database = Database(spark, database)

    def query(self, sql: str) -> DataFrame:
        """The rows of a query, not yet computed."""
        self.spark.catalog.setCurrentDatabase(self.database.name)
        dialect.check_tables(sql)
        rows = heavy.run(self.spark, dialect.to_spark(self.spark, sql))
        names = dialect.column_names(sql, rows.columns)
        return rows if names == rows.columns else rows.toDF(*names)

    def execute(self, sql: str) -> DataFrame | None:
        """Run a statement; a query without INTO gives its rows.

        Views hold the rows of the moment they are made; SELECT INTO makes a table.
        """
        s = dialect.parse(sql)
        if s.kind == "create_table":
            self.database.create_table(s.name, s.specs)
        elif s.kind == "create_view":
            rows = self.query(s.sql)
            if s.columns:
                if len(s.columns) != len(rows.columns):
                    raise CatalogError(f"the view names {len(s.columns)} columns, its query gives {len(rows.columns)}")
                rows = rows.toDF(*(c.lower() for c in s.columns))
            self.database.store(s.name, rows)
        elif s.kind == "drop":
            self.database.drop_table(s.name)
        elif s.kind == "select":
            rows = self.query(s.sql)
            if s.name is None:
                return rows
            self.database.store(s.name, rows)
        else:
            raise CatalogError(f"statement type not supported: {s.sql.split()[0].upper()}")
        return None

    def script(self, sql: str) -> list[tuple[str, DataFrame | None | Exception]]:
        """Run all statements of a text, those after a failed one too."""
        done: list = []
        for one in dialect.split_script(sql):
            try:
                done.append((one, self.execute(one)))
            except Exception as e:  # the error is the statement's result
                done.append((one, e))
        return done
