"""Tables that are never overwritten: versions of a catalogue, and an append-only cache of answers by key.

Both write their Parquet first and a small marker last; what has no marker does not exist for readers, so a run that stops half-way changes nothing. Markers are renamed
into place, which is atomic on HDFS and local disks; on object stores without an atomic rename a single writer is assumed. All paths go
through Hadoop's file systems.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.operators.ranking import numbered
from tallymark.session import delete_path, staged


class ConcurrentCommit(RuntimeError):
    """Another writer has taken this number."""


class _Markers:
    """Numbered JSON markers in one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        self._fs = self._at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self._at, name)

    def numbers(self) -> list[int]:
        if not self._fs.exists(self._at):
            return []
        names = (x.getPath().getName() for x in self._fs.listStatus(self._at))
        return sorted(int(x.removesuffix(".json")) for x in names if x.endswith(".json") and x.removesuffix(".json").isdigit())

    def read(self, number: int) -> dict:
        (row,) = self.spark.read.text(f"{self.folder}/{number:08d}.json").collect()
        return json.loads(row.value)

    def write(self, number: int, said: dict) -> None:
        self._fs.mkdirs(self._at)
        draft, final = self._path(f"draft-{uuid.uuid4().hex}"), self._path(f"{number:08d}.json")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps(said).encode()))
        out.close()
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            self._fs.delete(draft, False)
            raise ConcurrentCommit(f"{self.folder}: {number} is taken")


class Versions:
    """Immutable versions, from 1 on, of a set of named tables."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._markers = _Markers(spark, f"{self.root}/versions")

    def numbers(self) -> list[int]:
        return self._markers.numbers()

    def write(self, tables: dict[str, DataFrame]) -> dict:
        """Write the tables to a folder of their own; no reader sees them before `publish`."""
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        for name, rows in tables.items():
            rows.write.parquet(f"{folder}/{name}")
        return {"folder": folder.removeprefix(f"{self.root}/"), "tables": {n: json.loads(t.schema.json()) for n, t in tables.items()}}

    def publish(self, written: dict) -> int:
        """Make what was written the newest version."""
        number = max(self.numbers(), default=0) + 1
        self._markers.write(number, written)
        return number

    def commit(self, tables: dict[str, DataFrame]) -> int:
        return self.publish(self.write(tables))

    def read(self, table: str, number: int | None = None, back: int = 0) -> DataFrame:
        """A table of version `number`, or of the one `back` steps before the newest; LookupError if there is none."""
        known = self.numbers()
        if number is None:
            if len(known) <= back:
                raise LookupError(f"{self.root} has no version {back} before the newest")
            number = known[-1 - back]
        if number not in known:
            raise LookupError(f"{self.root} has no version {number}")
        from pyspark.sql.types import StructType

        said = self._markers.read(number)
        return self.spark.read.schema(StructType.fromJson(said["tables"][table])).parquet(f"{self.root}/{said['folder']}/{table}")

    def vacuum(self) -> list[str]:
        """Delete the folders that no version names: those of runs that stopped half-way. Not while a writer is at work."""
        data = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/data")
        fs = data.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        named = {self._markers.read(n)["folder"].removeprefix("data/") for n in self.numbers()}
        loose = [x.getPath().getName() for x in fs.listStatus(data) if x.getPath().getName() not in named] if fs.exists(data) else []
        for name in loose:
            delete_path(self.spark, f"{self.root}/data/{name}")
        return loose


class KeyedCache:
    """Answers by key, appended commit by commit; a null answer is one too, so what has none is not asked again.

    Of several answers to one key the latest commit's counts. Null keys are never asked and have no answer.
    """

    def __init__(self, spark: SparkSession, root: str, answer: str = "string"):
        self.spark, self.root, self.kind = spark, root.rstrip("/"), answer
        self._markers = _Markers(spark, f"{self.root}/commits")

    def _parts(self) -> list[tuple[int, str]]:
        said = {n: self._markers.read(n) for n in self._markers.numbers()}
        gone = {m for x in said.values() for m in x.get("replaces", [])}
        return [(n, x["folder"]) for n, x in said.items() if n not in gone]

    def known(self) -> DataFrame:
        """key, answer, run: the number of the commit that holds the answer."""
        schema = f"key string, answer {self.kind}, run long"
        parts = [f"{self.root}/{folder}" for _, folder in self._parts()]
        rows = self.spark.read.schema(schema).parquet(*parts) if parts else self.spark.createDataFrame([], schema)
        return rows.groupBy("key").agg(F.max_by(F.struct("answer", "run"), "run").alias("x")).select("key", "x.answer", "x.run")

    def missing(self, requests: DataFrame, key: str = "key") -> DataFrame:
        """The distinct keys of `requests` that no commit holds."""
        return requests.select(F.col(key).alias("key")).where("key is not null").distinct().join(self.known().select("key"), "key", "left_anti")

    def append(self, answers: DataFrame, publish: bool = True) -> int:
        """Commit (key, answer) rows under the next number; `publish=False` stops before the marker, as a run that is cut off does."""
        run = max(self._markers.numbers(), default=0) + 1
        folder = f"parts/{uuid.uuid4().hex}"
        answers.select("key", F.col("answer").cast(self.kind).alias("answer"), F.lit(run).cast("long").alias("run")).write.parquet(f"{self.root}/{folder}")
        if publish:
            self._markers.write(run, {"folder": folder})
        return run

    def fill(self, requests: DataFrame, ask: Callable[[DataFrame], DataFrame], key: str = "key", batch: int = 20, per_commit: int = 500) -> int:
        """Ask what is missing and commit the answers; the number of keys asked.

        `ask` gets (batch, key) rows, `batch` keys to a number, and returns (key, answer). Batches follow the order of keys, so the same missing keys
        make the same batches. Every `per_commit` batches are a commit: a run that is cut off loses the open one at most, and the next run asks
        just its keys again.
        """
        open_keys = staged(numbered(self.missing(requests, key), [F.col("key")], "number").select(F.floor(F.col("number") / batch).alias("batch"), "key"), "cache-open")
        last = open_keys.agg(F.max("batch").alias("last")).first().last
        if last is None:
            return 0
        for first in range(0, last + 1, per_commit):
            asked = open_keys.where(F.col("batch").between(first, first + per_commit - 1))
            self.append(asked.select("key").join(ask(asked).select("key", "answer"), "key", "left"))
        return open_keys.count()

    def compact(self) -> None:
        """Make one part of all, so that reading does not grow with the number of commits; a reader sees the old parts or the new one."""
        parts = self._parts()
        if len(parts) < 2:
            return
        run = max(n for n, _ in parts) + 1
        folder = f"parts/{uuid.uuid4().hex}"
        self.known().write.parquet(f"{self.root}/{folder}")
        self._markers.write(run, {"folder": folder, "replaces": [n for n, _ in parts]})

    def answers(self, requests: DataFrame, key: str = "key") -> DataFrame:
        """`requests` with answer and run; rows without a known key have nulls there."""
        found = self.known().withColumnRenamed("key", "__tm_key")
        return requests.join(found, F.col(key) == F.col("__tm_key"), "left").drop("__tm_key")
