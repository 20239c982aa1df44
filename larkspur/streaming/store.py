"""A table kept as folders behind a manifest, for streams and daily runs that add to it.

Each batch adds one folder of its own rows. When FAN folders of one level have come together they are merged into one folder of
the next level, so n batches leave at most FAN - 1 folders per level and about log(n) levels, and each row is rewritten once per
level. A merge puts rows of one key together again.

The manifest is one small file per version. It is written beside and renamed, so a reader finds the version before or
the one after, with all their folders, and never a mixture. Folders that the last KEEP versions don't name are deleted.

One writer at a time, as of one streaming query. A batch that is run again after a failure, and is already in the manifest,
changes nothing; one that failed before is written anew in its place. A store belongs to one checkpoint, whose batch numbers it
counts by.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

FAN = 8
KEEP = 3

Merge = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Folder:
    """``since``: rows of a first part column before it no longer count; rows without a value do."""

    level: int
    name: str
    since: str | None = None


@dataclass
class Manifest:
    """Folders of each table and the last batch held."""

    version: int = 0
    batch: int = -1
    folders: dict[str, list[Folder]] = field(default_factory=dict)

    def names(self) -> set[str]:
        return {f.name for held in self.folders.values() for f in held}


def due(held: list[Folder], fan: int = FAN) -> list[Folder] | None:
    """The folders of the lowest level that has ``fan`` of them or more."""
    for level in sorted({f.level for f in held}):
        same = [f for f in held if f.level == level]
        if len(same) >= fan:
            return same
    return None


class Store:
    """Tables under one path. ``schemas`` gives each table's columns, ``parts`` the columns its folders are split by."""

    def __init__(self, spark: SparkSession, path: str, schemas: dict[str, str | StructType], parts: dict[str, list[str]] | None = None, fan: int = FAN):
        self.spark, self.path, self.schemas, self.parts, self.fan = spark, path.rstrip("/"), schemas, parts or {}, fan
        self._jvm = spark.sparkContext._jvm
        self._fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _versions(self) -> list[int]:
        if not self._fs.exists(self._at("manifest")):
            return []
        return sorted(int(s.getPath().getName()) for s in self._fs.listStatus(self._at("manifest")) if s.getPath().getName().isdigit())

    def _read(self, version: int) -> Manifest:
        stream = self._fs.open(self._at(f"manifest/{version:012d}"))
        text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        held = json.loads(text)
        return Manifest(version, held["batch"], {t: [Folder(*f) for f in fs] for t, fs in held["folders"].items()})

    def manifest(self) -> Manifest:
        """The newest version; an empty one before the first."""
        versions = self._versions()
        return self._read(versions[-1]) if versions else Manifest()

    def publish(self, made: Manifest) -> Manifest:
        """Make a version the newest one, and drop what the last KEEP versions don't name."""
        made.version += 1
        folders = {t: [(f.level, f.name, f.since) for f in fs] for t, fs in made.folders.items()}
        text = json.dumps({"batch": made.batch, "folders": folders})
        beside = self._at(f"manifest/_{uuid.uuid4().hex}")
        out = self._fs.create(beside, True)
        out.write(bytearray(text.encode()))
        out.close()
        if not self._fs.rename(beside, self._at(f"manifest/{made.version:012d}")):
            raise OSError(f"version {made.version} of {self.path} exists: there is another writer")
        self._drop_old(made)
        return made

    def _drop_old(self, newest: Manifest) -> None:
        versions = [v for v in self._versions() if v <= newest.version]
        kept = versions[-KEEP:]
        live = newest.names().union(*[self._read(v).names() for v in kept])
        for version in versions[:-KEEP]:
            for name in self._read(version).names() - live:
                self._fs.delete(self._at(name), True)
            self._fs.delete(self._at(f"manifest/{version:012d}"), False)

    def _write(self, rows: DataFrame, table: str, name: str) -> str:
        rows.write.mode("overwrite").partitionBy(*self.parts.get(table, [])).parquet(f"{self.path}/{name}")
        return name

    def append(self, number: int, rows: dict[str, DataFrame], merges: dict[str, Merge] | None = None) -> Manifest:
        """Add a batch's rows to their tables, then merge what is due. ``merges`` names tables whose rows are put together."""
        held = self.manifest()
        if number <= held.batch:
            return held
        for table, df in rows.items():
            held.folders.setdefault(table, []).append(Folder(0, self._write(df, table, f"{table}/folder=batch-{number}")))
        held.batch = number
        held = self.publish(held)
        for table, merge in (merges or {}).items():
            held = self.merge_due(held, table, merge)
        return held

    def merge_due(self, held: Manifest, table: str, merge: Merge) -> Manifest:
        """Merge level by level until no level has too many folders."""
        while found := due(held.folders.get(table, []), self.fan):
            level = found[0].level + 1
            name = self._write(merge(self.load(table, found)), table, f"{table}/folder=level-{level}-{uuid.uuid4().hex}")
            held.folders[table] = [f for f in held.folders[table] if f not in found] + [Folder(level, name)]
            held = self.publish(held)
        return held

    def add(self, rows: dict[str, DataFrame], since: dict[str, str]) -> Manifest:
        """Add rows that are no batch, and set from where on the present folders of other tables count, in one version."""
        held = self.manifest()
        for table, df in rows.items():
            held.folders.setdefault(table, []).append(Folder(0, self._write(df, table, f"{table}/folder=added-{uuid.uuid4().hex}")))
        for table, first in since.items():
            held.folders[table] = [Folder(f.level, f.name, first) for f in held.folders.get(table, [])]
        return self.publish(held)

    def drop_parts(self, table: str) -> int:
        """Delete the parts of a table's folders that no longer count; how many there were."""
        (column, *_), dropped = self.parts[table], 0
        for folder in self.manifest().folders.get(table, []):
            for part in self._fs.listStatus(self._at(folder.name)) if folder.since else ():
                name = part.getPath().getName()
                if name.startswith(f"{column}=") and not name.endswith("__") and name.partition("=")[2] < folder.since:
                    dropped += self._fs.delete(part.getPath(), True)
        return dropped

    def load(self, table: str, folders: list[Folder]) -> DataFrame:
        """The rows of the given folders that count; an empty table without folders."""
        made = self.spark.createDataFrame([], self.schemas[table])
        for n, since in enumerate(sorted({f.since for f in folders}, key=lambda s: s or "")):
            names = [f"{self.path}/{f.name}" for f in folders if f.since == since]
            read = self.spark.read.schema(self.schemas[table]).option("basePath", f"{self.path}/{table}")
            rows = read.parquet(*names).select(*made.columns)
            if since is not None:
                first = F.col(self.parts[table][0])
                rows = rows.where(first.isNull() | (first >= F.lit(since).cast(rows.schema[self.parts[table][0]].dataType)))
            made = made.unionByName(rows) if n else rows
        return made

    def read(self, table: str, held: Manifest | None = None) -> DataFrame:
        """All rows of a table as of the newest version."""
        held = self.manifest() if held is None else held
        return self.load(table, held.folders.get(table, []))
