"""Tables of parts: folders of Parquet by the value of one column, and a manifest that says which folders count.

A change writes new folders for the parts that it touches and leaves all others; it
is done when the next manifest is there, under a name that nobody else can take.
So a reader sees a table before a change or after it, a change that was broken off
is never seen, and of two changes made at once the second is refused.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Changed(Exception):
    """Another change was made since the table was read."""


class Parts:
    """A table of parts by `column`, in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str, column: str, schema):
        self.spark, self.folder, self.column, self.schema = spark, folder.rstrip("/"), column, schema

    def _fs(self, path: str):
        held = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return held, held.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """The numbers of all manifests, in order."""
        path, fs = self._fs(f"{self.folder}/manifests")
        return sorted(int(s.getPath().getName()[:-5]) for s in fs.listStatus(path) if s.getPath().getName().endswith(".json")) if fs.exists(path) else []

    def manifest(self, version: int | None = None) -> tuple[int, dict[str, list[str]]]:
        """A version (the last, if none is asked for) and its parts' folders; 0 and none for a new table."""
        version = max(self.versions(), default=0) if version is None else version
        if not version:
            return 0, {}
        text = self.spark.read.option("wholetext", True).text(f"{self.folder}/manifests/{version:09d}.json").first()[0]
        return version, json.loads(text)

    def _commit(self, version: int, parts: dict[str, list[str]]) -> int:
        jvm = self.spark._jvm
        path, fs = self._fs(f"{self.folder}/manifests/.{uuid.uuid4().hex}")
        out = fs.create(path, False)
        out.write(bytearray(json.dumps(parts, sort_keys=True).encode()))
        out.close()
        target, _ = self._fs(f"{self.folder}/manifests/{version + 1:09d}.json")
        none = self.spark._sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), self.spark._jsc.hadoopConfiguration()).rename(path, target, none)
        except Exception as e:  # what the JVM throws for a name that is taken
            fs.delete(path, False)
            if fs.exists(target):
                raise Changed(f"{self.folder} has a version {version + 1} already") from e
            raise
        return version + 1

    def _written(self, rows: DataFrame) -> dict[str, list[str]]:
        """New folders of rows' parts: rows of a part come together first, a large part's to several tasks, so that files don't grow as tasks times parts."""
        top = f"{self.folder}/data/{uuid.uuid4().hex}"
        rows.withColumn("_part", F.col(self.column).cast("string")).hint("rebalance", "_part").write.partitionBy("_part").parquet(top)
        path, fs = self._fs(top)
        found = {}
        for s in fs.listStatus(path):
            name = s.getPath().getName()
            if name.startswith("_part="):
                value = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName(name[6:])
                found["" if value == "__HIVE_DEFAULT_PARTITION__" else value] = [f"{top}/{name}"]
        return found

    def read(self, parts: Iterable[str] | None = None, version: int | None = None) -> DataFrame:
        """Rows of some parts (None: of all)."""
        _, held = self.manifest(version)
        wanted = held if parts is None else {p: held[p] for p in parts if p in held}
        paths = [path for p in sorted(wanted) for path in wanted[p]]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def append(self, rows: DataFrame) -> int:
        """Adds rows to the parts that they belong to."""
        version, held = self.manifest()
        new = self._written(rows)
        return self._commit(version, {p: held.get(p, []) + new.get(p, []) for p in {*held, *new}})

    def rewrite(self, parts: Iterable[str], rows: DataFrame, version: int | None = None) -> int:
        """Puts rows in the place of the given parts' rows; of `version`, if it is given: later changes are not overwritten."""
        now, held = self.manifest()
        if version is not None and version != now:
            raise Changed(f"{self.folder} is at version {now}, not {version}")
        new = self._written(rows)
        if odd := set(new) - set(parts):
            raise ValueError(f"rows of other parts: {', '.join(sorted(odd))}")
        return self._commit(now, {p: new[p] if p in new else held[p] for p in {*held, *new} if p in new or p not in set(parts)})

    def swept(self, keep: int = 1) -> int:
        """Deletes manifests but the last `keep`, and folders that these don't name; how many folders went.  Not while a change is being made."""
        versions = self.versions()
        stays = {f for v in versions[-keep:] for fs in self.manifest(v)[1].values() for f in fs}
        path, fs = self._fs(f"{self.folder}/data")
        gone = 0
        for top in fs.listStatus(path) if fs.exists(path) else []:
            for s in fs.listStatus(top.getPath()):
                name = f"{self.folder}/data/{top.getPath().getName()}/{s.getPath().getName()}"
                if name not in stays and s.isDirectory():
                    gone += bool(fs.delete(s.getPath(), True))
        for v in versions[:-keep]:
            fs.delete(self._fs(f"{self.folder}/manifests/{v:09d}.json")[0], False)
        return gone
