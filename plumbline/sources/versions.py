"""Tables in versions. A change reads the newest version, writes the next one to a folder of its own and takes effect by one small file that only one writer can put in place.

Readers see whole versions only. Writers don't wait for each other: who comes second reads what the first has made and tries again.
A change writes the whole table, as fits catalogues and job lists; for many changes make one of them.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable
from urllib.parse import unquote, urlparse

from pyspark.sql import Column, DataFrame, SparkSession

from plumbline.operators import catalog


class Conflict(RuntimeError):
    """Other writers came first too often."""


class Versions:
    """A table below path: its data in folders, and a file in `versions` for each version, which names the folder.

    The file system must refuse to rename onto a file, as HDFS does in one step; on a local disk a hard link does it. Object stores
    whose rename copies can lose a change to a writer of the same moment.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._where = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._where(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._where(f"{self.path}/versions"))
        self._local = self._fs.getUri().getScheme() == "file"

    def newest(self) -> int:
        """The number of the newest version, 0 without any."""
        names = [f.getPath().getName() for f in self._fs.listStatus(self._where(f"{self.path}/versions"))]
        return max((int(n) for n in names if n.isdigit()), default=0)

    def read(self, version: int | None = None) -> DataFrame:
        version = self.newest() if version is None else version
        return self.spark.read.parquet(f"{self.path}/{self._named(version)}")

    def change(self, make: Callable[[DataFrame | None], DataFrame | None], tries: int = 16) -> int | None:
        """Publishes what make gives for the newest version (None where there is none yet), and returns its number.

        After a conflict make is asked again, with the version that won. Where it gives None nothing changes, and None returns.
        """
        for _ in range(tries):
            now = self.newest()
            new = make(self.read(now) if now else None)
            if new is None:
                return None
            folder = f"data-{uuid.uuid4().hex}"
            new.write.parquet(f"{self.path}/{folder}")
            if self._publish(now + 1, folder):
                return now + 1
            self._fs.delete(self._where(f"{self.path}/{folder}"), True)
        raise Conflict(f"{self.path}: {tries} tries")

    def forget(self, keep: int = 2) -> None:
        """Deletes the data of all but the newest versions; their numbers stay taken. No reader may still use them."""
        for version in range(1, self.newest() - keep + 1):
            self._fs.delete(self._where(f"{self.path}/{self._named(version)}"), True)

    def _file(self, version: int):
        return self._where(f"{self.path}/versions/{version:020d}")

    def _named(self, version: int) -> str:
        return self.spark.read.text(self._file(version).toString()).first()[0]

    def _publish(self, version: int, folder: str) -> bool:
        """Whether the version's file is this writer's. The file is complete before it has its name."""
        draft, target = self._where(f"{self.path}/versions/_{folder}"), self._file(version)
        out = self._fs.create(draft, False)
        out.write(bytearray(f"{folder}\n".encode()))
        out.close()
        try:
            if self._local:
                plain = lambda p: unquote(urlparse(p.toUri().toString()).path)
                os.link(plain(draft), plain(target))
                return True
            # An answer may be lost on its way: then the file says whose it is.
            return self._fs.rename(draft, target) or self._named(version) == folder
        except FileExistsError:
            return False
        finally:
            self._fs.delete(draft, False)


def create(table: Versions, rows: DataFrame) -> bool:
    """Makes rows the first version; False where another writer has made one."""
    return table.change(lambda old: rows if old is None else None) is not None


def upsert(table: Versions, new: DataFrame, *keys: str) -> int:
    """Puts new's rows in place of rows with equal keys and adds the others; keys are unique in new."""
    return table.change(lambda old: new if old is None else catalog.upserted(old, new, *keys))


def update_columns(table: Versions, new: DataFrame, *keys: str) -> int | None:
    """Sets the columns that new has in the rows whose keys match."""
    return table.change(lambda old: None if old is None else catalog.partly_updated(old, new, *keys))


def claim(table: Versions, job_id, expected: str, to: str, token: Column | None = None) -> bool:
    """Compare and set: whether the job (or any of several, by a column) was as expected and now is this writer's. Of several writers one gets True."""

    def make(jobs: DataFrame | None) -> DataFrame | None:
        if jobs is None or jobs.filter(catalog.claimable(job_id, expected, token)).isEmpty():
            return None
        return catalog.claimed(jobs, job_id, expected, to, token)

    return table.change(make) is not None
