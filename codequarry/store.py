"""Tables in numbered versions: a manifest names the folders of all tables, so a commit of several tables is there as a whole or not at all."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: The end of a whole manifest, and how many are kept.
END, KEPT = "end", 10


class ConcurrentWrite(RuntimeError):
    """Another writer has committed since this one began to read."""


class Store:
    """Parquet tables under ``home``. A table is one folder, or one a bucket; a commit writes new folders and then the next manifest.

    Readers take the last whole manifest, so they see the version before until the
    commit is done, and the same version of all tables. A manifest's number can be
    taken once: of two writers that began from the same version the later one fails.
    Folders of versions before stay for those who read them.
    """

    def __init__(self, spark: SparkSession, home: str):
        self.spark, self.home = spark, home.rstrip("/")

    def _fs(self, where: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def manifest(self) -> tuple[int, dict[str, dict[str, str]]]:
        """The number of the last version (0 before the first) and its folders: table, bucket, folder."""
        fs, pattern = self._fs(f"{self.home}/MANIFEST-*")
        for path in sorted((str(f.getPath()) for f in fs.globStatus(pattern) or ()), reverse=True):
            stream = fs.open(self._fs(path)[1])
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            stream.close()
            if text.endswith(END):
                return int(path.rsplit("-", 1)[1]), json.loads(text[: -len(END)])
        return 0, {}

    def read_or_none(self, name: str, buckets: list[int] | None = None, version: dict | None = None) -> DataFrame | None:
        """A table, or the rows of some of its buckets; none if there is no such table."""
        folders = (self.manifest()[1] if version is None else version).get(name)
        if folders is None:
            return None
        wanted = [f for b, f in folders.items() if b != "schema" and (buckets is None or b == "all" or int(b) in buckets)]
        schema = StructType.fromJson(json.loads(folders["schema"]))
        return self.spark.read.schema(schema).parquet(*wanted) if wanted else self.spark.createDataFrame([], schema)

    def read(self, name: str) -> DataFrame:
        found = self.read_or_none(name)
        if found is None:
            raise FileNotFoundError(f"{self.home} has no table {name} yet")
        return found

    def commit(self, writes: dict[str, DataFrame], touched: list[int] | None = None, base: int | None = None) -> int:
        """Writes tables and returns the number of the new version, which has all other tables as they were.

        A table with a column ``bucket`` is written by it, and only the ``touched``
        buckets are replaced (all, if none are given); other tables are replaced whole.
        ``base`` is the version the rows were derived from.
        """
        written: dict[str, dict[str, str]] = {}
        for name, df in writes.items():
            folder = f"{self.home}/{name}/v-{uuid.uuid4().hex}"
            if "bucket" in df.columns:
                df.write.partitionBy("bucket").parquet(folder)
                fs, pattern = self._fs(f"{folder}/bucket=*")
                written[name] = {str(f.getPath()).rsplit("=", 1)[1]: str(f.getPath()) for f in fs.globStatus(pattern) or ()}
            else:
                df.write.parquet(folder)
                written[name] = {"all": folder}
            written[name]["schema"] = df.drop("bucket").schema.json()
        number, folders = self.manifest()
        if base is not None and number != base:
            raise ConcurrentWrite(f"{self.home} is at version {number}, not at {base}")
        for name, new in written.items():
            kept = {b: f for b, f in folders.get(name, {}).items() if b.isdigit() and touched is not None and int(b) not in touched} if "all" not in new else {}
            folders[name] = kept | new
        fs, path = self._fs(f"{self.home}/MANIFEST-{number + 1:012d}")
        try:
            out = fs.create(path, False)
        except Exception as e:
            raise ConcurrentWrite(f"version {number + 1} of {self.home} is taken") from e
        out.write(bytearray((json.dumps(folders) + END).encode()))
        out.close()
        old = self._fs(f"{self.home}/MANIFEST-{number + 1 - KEPT:012d}")[1]
        if number + 1 > KEPT and fs.exists(old):
            fs.delete(old, False)
        return number + 1


class VersionedTable:
    """One table of a store, replaced as a whole."""

    def __init__(self, spark: SparkSession, path: str, name: str = "data"):
        self.store, self.name = Store(spark, path), name

    def read_or_none(self) -> DataFrame | None:
        return self.store.read_or_none(self.name)

    def read(self) -> DataFrame:
        return self.store.read(self.name)

    def write(self, df: DataFrame) -> int:
        return self.store.commit({self.name: df})
