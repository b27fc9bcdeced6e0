"""Tables that change from run to run, as versions of which one is committed at a time.

    folder/data/<version>-<attempt>/<table>   what an attempt has written
    folder/log/version=<version>              the log's rows of a version
    folder/versions/<version>.json            the manifest: it names the tables of the version

An attempt writes all its tables, and the log's rows last but one; then one rename puts the manifest in place,
and with it the version is there. Whatever fails before leaves the last version as it was: its tables
are never written again, and readers go by the latest manifest. Rows of the log count up to the
committed version only, and a repeated attempt replaces them, so none is added twice. Batches carry ids
that must grow: one that is committed already is not run again.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

DIGITS = 12


class Conflict(RuntimeError):
    """Another attempt has committed this version first."""


@dataclass(frozen=True)
class Version:
    """A committed version: its number, the batch that made it, and where its tables are."""

    store: Store
    number: int
    batch: str
    tables: dict[str, dict]

    def table(self, name: str) -> DataFrame | None:
        """A table of this version; None if it has none of that name."""
        at = self.tables.get(name)
        return at and self.store.spark.read.schema(StructType.fromJson(at["schema"])).parquet(f"{self.store.folder}/{at['path']}")


@dataclass
class Draft:
    """An attempt at the next version. What it keeps can be read at once by the attempt itself, and by others once it is committed."""

    store: Store
    number: int
    batch: str
    attempt: str
    tables: dict[str, dict] = field(default_factory=dict)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write a table once and return a scan of it."""
        path = f"data/{self.attempt}/{name}"
        df.write.mode("error").parquet(f"{self.store.folder}/{path}")
        schema = self.store.spark.read.parquet(f"{self.store.folder}/{path}").schema
        self.tables[name] = {"path": path, "schema": schema.jsonValue()}
        return self.store.spark.read.schema(schema).parquet(f"{self.store.folder}/{path}")

    def log(self, rows: DataFrame) -> None:
        """The rows that this version adds to the log, once whatever is repeated."""
        rows.write.mode("overwrite").json(f"{self.store.folder}/log/version={self.number}")

    def commit(self, *names: str) -> Version:
        """Put the version in place; names are the tables that it keeps, by default all."""
        tables = {n: t for n, t in self.tables.items() if not names or n in names}
        self.store._publish(self.number, {"batch": self.batch, "attempt": self.attempt, "tables": tables})
        return Version(self.store, self.number, self.batch, tables)


class Store:
    """A folder of versions. keep_versions older ones stay readable; vacuum() removes the others and what failed attempts have left."""

    def __init__(self, spark: SparkSession, folder: str, keep_versions: int = 5):
        self.spark, self.folder, self.keep_versions = spark, folder.rstrip("/"), keep_versions
        self._jvm, self._conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, rest: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{rest}")

    def _names(self, rest: str) -> list[str]:
        path = self._path(rest)
        fs = path.getFileSystem(self._conf)
        return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []

    def _numbers(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self._names("versions") if n.endswith(".json") and n[:-5].isdigit())

    def _read(self, number: int) -> dict:
        path = self._path(f"versions/{number:0{DIGITS}d}.json")
        stream = path.getFileSystem(self._conf).open(path)
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, number: int, manifest: dict) -> None:
        """Write the manifest beside its place and rename it there, unless there is one already."""
        place, draft = self._path(f"versions/{number:0{DIGITS}d}.json"), self._path(f"versions/.{number}-{uuid.uuid4().hex}")
        out = draft.getFileSystem(self._conf).create(draft, False)
        try:
            out.write(json.dumps(manifest).encode())
        finally:
            out.close()
        rename = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(place.toUri(), self._conf).rename(draft, place, rename)
        except Exception as e:
            if "FileAlreadyExistsException" in str(e):
                raise Conflict(f"version {number} is there already") from e
            raise

    def latest(self) -> Version | None:
        """The last committed version."""
        numbers = self._numbers()
        return self.at(numbers[-1]) if numbers else None

    def at(self, number: int) -> Version:
        m = self._read(number)
        return Version(self, number, m["batch"], m["tables"])

    def begin(self, batch: str) -> Draft:
        """An attempt for a batch whose id is greater than all before."""
        last = self.latest()
        if last and batch <= last.batch:
            raise ValueError(f"batch {batch} does not come after {last.batch}, which is committed")
        number = last.number + 1 if last else 1
        return Draft(self, number, batch, f"{number:0{DIGITS}d}-{uuid.uuid4().hex}")

    def log(self, schema: str, since: int = 0) -> DataFrame:
        """The log's rows of all committed versions after `since`, with their version."""
        last = self.latest()
        empty = self.spark.createDataFrame([], f"{schema}, version int")
        if last is None or not self._names("log"):
            return empty
        rows = self.spark.read.schema(f"{schema}, version int").json(f"{self.folder}/log")
        return rows.filter((F.col("version") > since) & (F.col("version") <= last.number))

    def vacuum(self) -> None:
        """Remove versions older than keep_versions, and the data of attempts before the last version that no manifest left names. The log stays."""
        numbers = self._numbers()
        fs = self._path("").getFileSystem(self._conf)
        for n in numbers[: -self.keep_versions]:
            fs.delete(self._path(f"versions/{n:0{DIGITS}d}.json"), False)
        left = numbers[-self.keep_versions :]
        named = {t["path"].split("/")[1] for n in left for t in self._read(n)["tables"].values()}
        for attempt in self._names("data"):
            if attempt not in named and numbers and int(attempt[:DIGITS]) <= numbers[-1]:
                fs.delete(self._path(f"data/{attempt}"), True)
