"""A folder of tables: derived ones are rebuilt and swapped in together, durable ones live on.

A rebuild writes its tables into a fresh folder, tests them, and then claims the next
version by creating the file of that number, which only one writer can do.  Readers take
the newest claimed version.  Until the claim, and if the job dies, everyone reads the
tables of before.  Whoever finds the number taken starts over from the version that took
it.  (Claiming needs a file system whose create fails where the file is there; HDFS and
local disks have one.)  Durable tables are only appended to; what holds is the last row
of a key.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillmerge.sources.constraints import Refused, Rule, tested_keys, write_tested

Tables = dict[str, DataFrame]


class Conflict(Exception):
    """Other writers claimed the next version again and again."""


class Files:
    """What the store needs of Hadoop's file systems."""

    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        at = self.jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.conf)

    def exists(self, path: str) -> bool:
        at, fs = self._at(path)
        return fs.exists(at)

    def listed(self, path: str) -> list[tuple[str, int]]:
        """(name, seconds of its last change) of what is in a folder."""
        at, fs = self._at(path)
        return [(s.getPath().getName(), s.getModificationTime() / 1000) for s in fs.listStatus(at)] if fs.exists(at) else []

    def claim(self, path: str, text: str) -> bool:
        """Create a file with this text, unless it is there."""
        at, fs = self._at(path)
        try:
            out = fs.create(at, False)
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" in str(e.java_exception) or "already exists" in str(e.java_exception):
                return False
            raise
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        return True

    def text(self, path: str) -> str:
        at, fs = self._at(path)
        into = fs.open(at)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(into, "UTF-8")
        finally:
            into.close()

    def remove(self, path: str) -> None:
        at, fs = self._at(path)
        fs.delete(at, True)


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark)

    # ------------------------------------------------------------ derived tables

    def versions(self) -> list[tuple[int, str]]:
        """(number, folder) of all versions in order; a claim that was never filled in is none."""
        out = []
        for name, _ in sorted(self.files.listed(f"{self.root}/versions")):
            if name.isdigit():
                told = self.files.text(f"{self.root}/versions/{name}")
                if told:
                    out.append((int(name), json.loads(told)["folder"]))
        return out

    def _next(self) -> int:
        return max((int(n) for n, _ in self.files.listed(f"{self.root}/versions") if n.isdigit()), default=0) + 1

    def rebuild(self, tables: Tables | Callable[[], Tables], rules: list[Rule] = (), tries: int = 10) -> int:
        """Write all tables anew, test them and swap them in; the version's number.

        Given a function, it is asked again after a lost claim, as its tables may come from
        the version before.  ``Refused`` leaves the version of before in place.
        """
        for _ in range(tries):
            number, folder = self._next(), f"v-{uuid.uuid4().hex}"
            broken, written = [], {}
            for name, df in (tables() if callable(tables) else tables).items():
                path = f"{self.root}/{folder}/{name}"
                broken += write_tested(df, path, name, list(rules))
                written[name] = self.spark.read.schema(df.schema).parquet(path)
            broken += tested_keys(written, list(rules))
            if broken:
                self.files.remove(f"{self.root}/{folder}")
                raise Refused(broken)
            if self.files.claim(f"{self.root}/versions/{number:012d}", json.dumps({"folder": folder, "tables": sorted(written)})):
                return number
            self.files.remove(f"{self.root}/{folder}")
        raise Conflict(f"no version could be claimed in {tries} tries")

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """A derived table of the newest version, or of one that has not been swept."""
        there = dict(self.versions())
        if not there:
            raise LookupError("nothing has been built yet")
        return self.spark.read.parquet(f"{self.root}/{there[version or max(there)]}/{name}")

    def sweep(self, grace_seconds: float = 86_400) -> list[str]:
        """Remove the folders of old versions and of writers that never claimed one, both unchanged for the grace time."""
        there = self.versions()
        current = max(there)[1] if there else None
        told = time.time() - grace_seconds
        old = [n for n, changed in self.files.listed(self.root) if n.startswith("v-") and n != current and changed < told]
        for name in old:
            self.files.remove(f"{self.root}/{name}")
        for number, folder in there:
            if folder in old:
                self.files.remove(f"{self.root}/versions/{number:012d}")
        return old

    # ------------------------------------------------------------ durable tables

    def durable(self, name: str, schema: StructType | str) -> DataFrame:
        """A durable table, empty before its first row."""
        path = f"{self.root}/durable/{name}"
        return self.spark.read.parquet(path) if self.files.exists(path) else self.spark.createDataFrame([], schema)

    def append(self, name: str, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(f"{self.root}/durable/{name}")

    def append_new(self, name: str, rows: DataFrame, key: str) -> None:
        """Append the rows whose key isn't there yet, one for each key: the least row."""
        others = [c for c in rows.columns if c != key]
        least = rows.groupBy(key).agg(F.min(F.struct(*others)).alias("r")).select(key, *[F.col(f"r.{c}").alias(c) for c in others])
        there = self.durable(name, rows.schema).select(key)
        self.append(name, least.join(there, key, "left_anti").select(*rows.columns))
