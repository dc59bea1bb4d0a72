"""Files that grow, as a stream: what is appended comes once, a file that shrank is read again from its beginning."""

from __future__ import annotations

import json
from collections.abc import Iterator
from fnmatch import fnmatch

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.window import Window

from ..operators.versions import Table

#: Bytes that one task reads.
RANGE = 32 << 20
_LOOK = 1 << 16


class _Range(InputPartition):
    def __init__(self, path: str, life: int, begin: int, low: int, high: int, end: int) -> None:
        """Lines that begin in [low, high) of a file whose new part is [begin, end)."""
        self.path, self.life, self.begin, self.low, self.high, self.end = path, life, begin, low, high, end


class _Reader(DataSourceStreamReader):
    """Offsets are {file: [life, bytes]}: whole lines only, so a line that is still being written waits; a life ends when the file shrinks."""

    def __init__(self, options: dict[str, str]) -> None:
        self.root, self.glob, self.range = options["path"], options.get("glob", "*.jsonl"), int(options.get("range", RANGE))

    def _system(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.root)

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def latestOffset(self) -> dict:
        from pyarrow import fs

        system, root = self._system()
        known = json.loads(getattr(self, "_last", "{}"))
        out = {}
        for info in system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
            if info.type != fs.FileType.File or not fnmatch(info.base_name, self.glob):
                continue
            life, done = known.get(info.path, (0, 0))
            if info.size < done:
                life, done = life + 1, 0
            out[info.path] = [life, self._whole(system, info.path, done, info.size)]
        self._last = json.dumps(out, sort_keys=True)
        return {"files": self._last}

    @staticmethod
    def _whole(system, path: str, done: int, size: int) -> int:
        """Where the last line end between two places stands, else the first of them."""
        with system.open_input_file(path) as f:
            high = size
            while high > done:
                low = max(done, high - _LOOK)
                at = f.read_at(high - low, low).rfind(b"\n")
                if at >= 0:
                    return low + at + 1
                high = low
        return done

    def partitions(self, start: dict, end: dict) -> list[_Range]:
        was, now = json.loads(start["files"]), json.loads(end["files"])
        self._last = end["files"]
        out = []
        for path, (life, size) in sorted(now.items()):
            old_life, old_size = was.get(path, (0, 0))
            begin = old_size if life == old_life and size >= old_size else 0
            out += [_Range(path, life, begin, low, min(low + self.range, size), size) for low in range(begin, size, self.range)]
        return out

    def read(self, partition: _Range) -> Iterator[tuple]:
        system, _ = self._system()
        with system.open_input_file(partition.path) as f:
            at = partition.low
            if at > partition.begin:  # the line that goes across belongs to the range before
                at = self._after(f, at - 1, partition.end)
            held, begin = b"", at
            while begin < partition.high:
                more = f.read_at(min(_LOOK, partition.end - at), at) if at < partition.end else b""
                at += len(more)
                *whole, held = (held + more).split(b"\n")
                for line in whole:
                    if begin >= partition.high:
                        return
                    yield partition.path, partition.life, begin, line.removesuffix(b"\r").decode("utf-8", "replace")
                    begin += len(line) + 1
                if not more:
                    return

    @staticmethod
    def _after(f, at: int, end: int) -> int:
        """The place behind the first line end from a place on."""
        while at < end:
            some = f.read_at(min(_LOOK, end - at), at)
            found = some.find(b"\n")
            if found >= 0:
                return at + found + 1
            at += len(some)
        return end

    def commit(self, end: dict) -> None:
        pass


class GrowingFiles(DataSource):
    """Lines of growing files: (source_path, life, byte, value). Options: path, glob, range (bytes of a task)."""

    @classmethod
    def name(cls) -> str:
        return "growing_files"

    def schema(self) -> str:
        return "source_path string, life int, byte long, value string"

    def streamReader(self, schema) -> _Reader:
        return _Reader(dict(self.options))


def read_growing(spark: SparkSession, path: str, glob: str = "*.jsonl", **options: str) -> DataFrame:
    """A stream of (source_path, life, byte, value): lines as they are appended to the files under a folder that all tasks can read."""
    spark.dataSource.register(GrowingFiles)
    return spark.readStream.format("growing_files").options(glob=glob, **options).load(path)


def land_lines(stream: DataFrame, folder: str, checkpoint: str) -> None:
    """Land what the stream of growing files has in tables under a folder, and stop when all is read: `lines` (source_path,
    life, line_no, byte, raw_json) and `cursors` (source_path, life, size, lines), a row for each file.

    Lines are numbered on from their file's cursor: counted by task range and added up, without a file in one task. Each
    batch's lines are one folder of `lines`, named by the batch, so a batch that runs again replaces its own.
    """

    def land(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        table = Table(spark, f"{folder}/cursors")
        known = table.read()
        if known is None:
            known = spark.createDataFrame([], "source_path string, life int, size long, lines long, batch long")
        elif not known.filter(F.col("batch") >= number).isEmpty():
            return  # this batch has landed already
        rows = batch.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id())
        path = f"{folder}/raw/batch={number}"
        rows.write.mode("overwrite").parquet(path)
        rows = spark.read.parquet(path)
        parts = rows.groupBy("source_path", "life", "_part").agg(F.count("*").alias("_count"), F.min("_at").alias("_first"), F.min("byte").alias("_byte"), F.max(F.col("byte") + F.octet_length("value") + 1).alias("_size"))
        before = F.coalesce(F.sum("_count").over(Window.partitionBy("source_path", "life").orderBy("_byte").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        cursor = known.select("source_path", "life", F.col("lines").alias("_lines"))
        parts = parts.withColumn("_before", before).join(cursor, ["source_path", "life"], "left").withColumn("_before", F.col("_before") + F.coalesce("_lines", F.lit(0)) - F.col("_first"))
        numbered = rows.join(parts.select("source_path", "life", "_part", "_before"), ["source_path", "life", "_part"])
        numbered = numbered.select("source_path", "life", (F.col("_at") + F.col("_before")).alias("line_no"), "byte", F.col("value").alias("raw_json"))
        numbered.write.mode("overwrite").parquet(f"{folder}/lines/batch={number}")
        fresh = parts.groupBy("source_path", "life").agg(F.max("_size").alias("size"), F.sum("_count").alias("lines"))
        both = known.select("source_path", "life", "size", "lines").unionByName(fresh).groupBy("source_path", "life").agg(F.max("size").alias("size"), F.sum("lines").alias("lines"))
        last = both.groupBy("source_path").agg(F.max_by(F.struct("life", "size", "lines"), "life").alias("_c"))
        table.replace(last.select("source_path", "_c.*", F.lit(number).cast("long").alias("batch")))

    stream.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
