"""Which folders of a table are live: a log of small commits, each written whole or not at all."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

_SCHEMA = "version long, name string, n long, live boolean"


class Versions:
    """Names that are live, each with a number. A commit is one file of a few rows, so readers see it whole or not at all. One writer at a time.

    The log is metadata: a row for each name that was ever put in or taken out, read on the driver.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder
        self._known: dict[str, tuple[int, int, bool]] | None = None

    def _rows(self) -> dict[str, tuple[int, int, bool]]:
        if self._known is None:
            try:
                rows = self.spark.read.schema(_SCHEMA).parquet(self.folder).orderBy("version").collect()
            except Exception as e:  # nothing was committed yet
                if "PATH_NOT_FOUND" not in str(e):
                    raise
                rows = []
            self._known = {}
            for r in rows:
                self._known[r.name] = (r.version, r.n, r.live)
        return self._known

    def live(self) -> dict[str, int]:
        """The live names and their numbers, in the order in which they came."""
        return {k: n for k, (_, n, live) in self._rows().items() if live}

    def commit(self, added: dict[str, int], removed: list[str] | tuple[str, ...] = ()) -> None:
        """Put names in and take names out, in one step."""
        known = self._rows()
        version = max((v for v, _, _ in known.values()), default=0) + 1
        rows = [(version, k, int(known[k][1]), False) for k in removed] + [(version, k, int(n), True) for k, n in added.items()]
        if rows:
            self.spark.createDataFrame(rows, _SCHEMA).coalesce(1).write.mode("append").parquet(self.folder)
            for v, k, n, live in rows:
                known.pop(k, None)
                known[k] = (v, n, live)

    def refresh(self) -> None:
        """Read the log again: another session may have written."""
        self._known = None


class Table:
    """A table whose content is replaced in one step: every write goes to a folder of its own, then the log switches to it."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.log = Versions(spark, f"{self.path}/log")

    def read(self) -> DataFrame | None:
        """The rows, None if nothing was written yet."""
        live = list(self.log.live())
        return self.spark.read.parquet(*(f"{self.path}/{k}" for k in live)) if live else None

    def replace(self, df: DataFrame, *partition: str) -> DataFrame:
        """New rows in place of all that were; they may be made from the old ones."""
        name = self._name()
        df.write.partitionBy(*partition).parquet(f"{self.path}/{name}")
        self.log.commit({name: 0}, list(self.log.live()))
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def append(self, df: DataFrame) -> None:
        name = self._name()
        df.write.parquet(f"{self.path}/{name}")
        self.log.commit({name: 0})

    @staticmethod
    def _name() -> str:
        return f"v-{uuid.uuid4().hex[:12]}"

