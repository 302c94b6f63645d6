"""Tables of a database that executors can reach by JDBC: scans in slices of a key, first rows by an order, appends and deletes.

Filters and columns of a scan are pushed to the database by Spark, order and row limit by a query of ours in ANSI SQL.
Appends and deletes are safe to run again: only rows whose key isn't there yet are added, and what is deleted is named
by a table of keys that the database joins itself, so no key passes the driver. Null keys are neither added nor deleted.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Slices of a scan, and connections of a write: a database has fewer of them than a cluster has cores.
SLICES = 16


class Database:
    """A database by its JDBC URL; options are Spark's JDBC options (driver, user, fetchsize and so on)."""

    def __init__(self, spark: SparkSession, url: str, **options: str) -> None:
        self.spark, self.url, self.options = spark, url, {"fetchsize": "10000", "batchsize": "10000", **options}
        self._dialect = spark._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url)

    def _quoted(self, column: str) -> str:
        return self._dialect.quoteIdentifier(column)

    def _read(self, source: str, **more: str) -> DataFrame:
        return self.spark.read.format("jdbc").options(url=self.url, dbtable=source, **self.options, **more).load()

    def _run(self, statements: Iterable[str]) -> None:
        """Runs statements in one transaction."""
        jvm = self.spark._jvm
        settings = jvm.java.util.Properties()
        for k, v in self.options.items():
            settings.setProperty(k, v)
        if "driver" in self.options:
            jvm.org.apache.spark.sql.execution.datasources.jdbc.DriverRegistry.register(self.options["driver"])
        connection = jvm.java.sql.DriverManager.getConnection(self.url, settings)
        try:
            connection.setAutoCommit(False)
            statement = connection.createStatement()
            for s in statements:
                statement.executeUpdate(s)
            connection.commit()
        except Exception:
            connection.rollback()
            raise
        finally:
            connection.close()

    def scan(self, table: str, key: str | None = None, slices: int = SLICES) -> DataFrame:
        """All rows, lazily; in `slices` equal ranges of a numeric or date `key`, rows without one in the first."""
        if key is None:
            return self._read(table)
        k = self._quoted(key)
        low, high = self._read(f"(SELECT MIN({k}) AS low, MAX({k}) AS high FROM {table}) bounds").first()
        if low is None or low == high:
            return self._read(table)
        return self._read(table, partitionColumn=key, lowerBound=str(low), upperBound=str(high), numPartitions=str(slices))

    def first(self, table: str, n: int, order: Mapping[str, str], where: str = "") -> DataFrame:
        """The first n rows by `order`, a direction (asc or desc) for each column; `where` is a condition in the database's SQL."""
        if not all(d in ("asc", "desc") for d in order.values()):
            raise ValueError("a direction is asc or desc")
        by = ", ".join(f"{self._quoted(c)} {d}" for c, d in order.items())
        return self._read(f"(SELECT * FROM {table}{' WHERE ' + where if where else ''} ORDER BY {by} FETCH FIRST {int(n)} ROWS ONLY) first_rows")

    def create(self, rows: DataFrame, table: str, key: str, types: str = "") -> None:
        """A new table of rows with a primary key; `types` gives the database's types of some columns, as in a table's definition."""
        self._write(rows.limit(0), table, "errorifexists", types)
        k = self._quoted(key)
        self._run([f"ALTER TABLE {table} ALTER COLUMN {k} NOT NULL", f"ALTER TABLE {table} ADD PRIMARY KEY ({k})"])
        self.append(rows, table, key)

    def _write(self, rows: DataFrame, table: str, mode: str, types: str = "") -> None:
        more = {"createTableColumnTypes": types} if types else {}
        rows.write.format("jdbc").options(url=self.url, dbtable=table, numPartitions=str(SLICES), **self.options, **more).mode(mode).save()

    def append(self, rows: DataFrame, table: str, key: str) -> None:
        """Adds rows whose key the table doesn't have; of rows with one key, any one.

        A task that is run again after its rows were committed meets the primary key and fails; the next call adds what is left.
        """
        known = self.scan(table, key).select(F.col(key).alias("_known"))
        fresh = rows.where(F.col(key).isNotNull()).dropDuplicates([key])
        self._write(fresh.join(known, fresh[key] == known["_known"], "left_anti"), table, "append")

    def delete(self, keys: DataFrame, table: str, key: str, children: Mapping[str, str] | None = None) -> None:
        """Deletes the rows named by the one column of keys, and before them those of `children` (table: its column of this key), in one transaction."""
        staged = f"gone_{uuid.uuid4().hex[:24]}"
        named = keys.select(F.col(keys.columns[0]).alias(key)).where(F.col(key).isNotNull()).distinct()
        self._write(named, staged, "errorifexists")
        k = self._quoted(key)
        try:
            self._run(f"DELETE FROM {t} WHERE {self._quoted(c)} IN (SELECT {k} FROM {staged})" for t, c in [*(children or {}).items(), (table, key)])
        finally:
            self._run([f"DROP TABLE {staged}"])
