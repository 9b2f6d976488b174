"""Tables of a folder that become visible together.

Every table is written to a folder of its own version. A draft is committed by one small
manifest, written last, that names the folder of every table; readers resolve the newest
manifest. Until then, and when a write or a check of the draft fails, they read the
complete former version. Tables a draft does not write are carried over.

Manifests are numbered, and a number can be taken once: of two drafts begun from one
version the later commit fails instead of hiding the earlier one.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

from lapsewise.session import remove_folder
from lapsewise.sources.tables import read_table, write_table

MANIFESTS = "_manifests"


class PublishConflict(RuntimeError):
    """Another draft was committed since this one was begun."""


class _Files:
    """The few calls on small files, on any file system Spark can reach."""

    def __init__(self, spark: SparkSession, folder: str):
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._io = spark._jvm.org.apache.commons.io.IOUtils
        self._fs = self._hadoop.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def names(self, path: str) -> list[str]:
        at = self._hadoop.Path(path)
        return [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def read(self, path: str) -> str:
        stream = self._fs.open(self._hadoop.Path(path))
        try:
            return self._io.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, path: str, text: str) -> bool:
        """Whole content or nothing; False if there is such a file."""
        final, part = self._hadoop.Path(path), self._hadoop.Path(f"{path}.{uuid.uuid4().hex}")
        stream = self._fs.create(part, False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        done = not self._fs.exists(final) and self._fs.rename(part, final)
        if not done:
            self._fs.delete(part, False)
        return done


class Published:
    """The published tables of a folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._files = _Files(spark, self.folder)

    def versions(self) -> list[int]:
        names = self._files.names(f"{self.folder}/{MANIFESTS}")
        return sorted(int(n[:-5]) for n in names if n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict[str, str]:
        """Table name to folder, of a version or the newest one; empty before the first."""
        known = self.versions()
        if not known:
            return {}
        at = known[-1] if version is None else version
        return json.loads(self._files.read(f"{self.folder}/{MANIFESTS}/{at:09d}.json"))

    def table(self, name: str, version: int | None = None) -> DataFrame:
        found = self.manifest(version)
        if name not in found:
            raise KeyError(f"{name} is not published in {self.folder}")
        return read_table(self.spark, f"{self.folder}/{found[name]}")

    def draft(self) -> Draft:
        return Draft(self)

    def expire(self, keep: int = 2) -> None:
        """Delete tables that none of the newest `keep` manifests names, and the older
        manifests. Drafts not yet committed are not touched."""
        known = self.versions()
        old = {p for v in known[:-keep] for p in self.manifest(v).values()}
        for v in known[:-keep]:
            remove_folder(self.spark, f"{self.folder}/{MANIFESTS}/{v:09d}.json")
        for path in old - {p for v in known[-keep:] for p in self.manifest(v).values()}:
            remove_folder(self.spark, f"{self.folder}/{path}")


class Draft:
    """Tables to be published by commit()."""

    def __init__(self, published: Published):
        self._published = published
        known = published.versions()
        self._base = known[-1] if known else 0
        self._own = f"v{self._base + 1:09d}-{uuid.uuid4().hex[:12]}"
        self._written: dict[str, str] = {}

    def write(self, name: str, df: DataFrame) -> DataFrame:
        path = f"{self._own}/{name}"
        write_table(df, f"{self._published.folder}/{path}")
        self._written[name] = path
        return self.table(name)

    def write_together(self, tables: dict[str, Callable[[], DataFrame]]) -> None:
        """Independent tables as concurrent jobs, so that the tail of one does not leave
        the executors idle. The first failure is raised."""

        def job(name: str) -> Callable[[], None]:
            @inheritable_thread_target(self._published.spark)
            def go() -> None:
                self.write(name, tables[name]())

            return go

        with ThreadPoolExecutor(max_workers=len(tables)) as pool:
            for done in [pool.submit(job(name)) for name in tables]:
                done.result()

    def table(self, name: str) -> DataFrame:
        """A table of this draft, or the published one."""
        if name not in self._written:
            return self._published.table(name, self._base or None)
        return read_table(self._published.spark, f"{self._published.folder}/{self._written[name]}")

    def commit(self) -> int:
        """Publish all written tables at once; the number of the new version."""
        tables = {**(self._published.manifest(self._base) if self._base else {}), **self._written}
        version = self._base + 1
        path = f"{self._published.folder}/{MANIFESTS}/{version:09d}.json"
        if not self._published._files.create(path, json.dumps(tables, indent=1)):
            raise PublishConflict(f"version {version} of {self._published.folder} exists")
        return version

    def discard(self) -> None:
        """Remove what an uncommitted draft has written."""
        remove_folder(self._published.spark, f"{self._published.folder}/{self._own}")
