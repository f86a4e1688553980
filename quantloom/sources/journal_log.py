"""The journal as numbered commits, so that writers may run at the same time.

A commit is a folder of rows and a manifest that names all folders up to it. Manifests are numbered, and one comes into being
only if no other has its number: a writer that loses the number reads what came before it, leaves out keys that are taken
now, and tries the next number. Readers see whole commits only. A writer that dies leaves a folder that no manifest names.

Creating a manifest is atomic where the store's exclusive creation is (HDFS and stores with conditional writes); on local
files it is a hard link, which fails where the name exists.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from quantloom.sources.sinks import JOURNAL, journal_new


class Conflict(Exception):
    """Another writer has that number."""


class Log:
    """A journal in a folder. commit() takes the rows of a batch that are new, as sinks.journal_new does."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.home = spark, path.rstrip("/")
        self.jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.fs = self._path("").getFileSystem(conf)
        self.fs.mkdirs(self._path("commits"))

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.home}/{name}")

    def version(self) -> int:
        """The number of the last commit, 0 before the first."""
        return max((int(s.getPath().getName().split(".")[0]) for s in self.fs.listStatus(self._path("commits")) if s.getPath().getName().endswith(".json")), default=0)

    def folders(self, version: int) -> list[str]:
        if not version:
            return []
        lines = self.spark.read.text(f"{self.home}/commits/{version:012d}.json").collect()  # one line
        return json.loads("".join(r[0] for r in lines))["folders"]

    def read(self, version: int | None = None) -> DataFrame:
        """The rows as of a commit, by default the last."""
        names = self.folders(self.version() if version is None else version)
        if not names:
            return self.spark.createDataFrame([], JOURNAL)
        return self.spark.read.schema(JOURNAL).parquet(*(f"{self.home}/{n}" for n in names))

    def put(self, version: int, folders: list[str]) -> None:
        """Creates a manifest; Conflict if its number is taken."""
        from py4j.protocol import Py4JJavaError

        name, text = self._path(f"commits/{version:012d}.json"), bytearray(json.dumps({"folders": folders}).encode())
        try:
            if self.fs.getScheme() == "file":
                made = self._path(f"commits/.{uuid.uuid4().hex}")
                out = self.fs.create(made, True)
                out.write(text)
                out.close()
                local = lambda p: self.jvm.java.nio.file.Paths.get(p.toUri().getPath(), self.spark.sparkContext._gateway.new_array(self.jvm.java.lang.String, 0))
                try:
                    self.jvm.java.nio.file.Files.createLink(local(name), local(made))
                finally:
                    self.fs.delete(made, False)
            else:
                out = self.fs.create(name, False)
                out.write(text)
                out.close()
        except Py4JJavaError as e:
            if "AlreadyExists" in e.java_exception.getClass().getName():
                raise Conflict(version) from e
            raise

    def commit(self, batch: DataFrame, order: str | None = None, tries: int = 50, before_put=None) -> int:
        """Appends what is new of the batch; the version that has it. Nothing new: the last version. before_put(version) is
        called before each attempt, for tests."""
        for _ in range(tries):
            version = self.version()
            folders, name = self.folders(version), f"rows/{uuid.uuid4().hex}"
            fresh = journal_new(self.read(version), batch, order)
            fresh.write.parquet(f"{self.home}/{name}")
            if not self.spark.read.schema(JOURNAL).parquet(f"{self.home}/{name}").limit(1).count():
                self.fs.delete(self._path(name), True)
                return version
            if before_put:
                before_put(version + 1)
            try:
                self.put(version + 1, [*folders, name])
                return version + 1
            except Conflict:
                self.fs.delete(self._path(name), True)  # written again against what is there now
        raise Conflict(f"no free number in {tries} tries")

    def compact(self) -> int:
        """A commit whose one folder has the rows of all; older commits stay readable."""
        version = self.version()
        name = f"rows/{uuid.uuid4().hex}"
        self.read(version).write.parquet(f"{self.home}/{name}")
        self.put(version + 1, [name])
        return version + 1
