"""Folders and small files on any storage that Spark reaches, through Hadoop's file systems: shared storage on a cluster, a local path in tests."""

from __future__ import annotations

import hashlib
import json
import uuid
from pathlib import Path
from typing import Any

from pyspark.sql import SparkSession


class Place:
    """A path that the driver and all executors name alike. `/` goes down; texts are written whole or not at all."""

    def __init__(self, path: str | Path | Place, spark: SparkSession | None = None):
        self.spark = spark or (path.spark if isinstance(path, Place) else SparkSession.active())
        self.jvm = self.spark._jvm.org.apache.hadoop.fs
        given = self.jvm.Path(str(path))
        self.fs = given.getFileSystem(self.spark._jsc.hadoopConfiguration())
        self.path = self.fs.makeQualified(given)

    def __truediv__(self, name: str) -> Place:
        return Place(f"{self}/{name}", self.spark)

    def __str__(self) -> str:
        return self.path.toString()

    @property
    def name(self) -> str:
        return self.path.getName()

    def exists(self) -> bool:
        return self.fs.exists(self.path)

    def children(self) -> list[str]:
        """Names in a folder, in order, without those that are being written; none if there is no such folder."""
        names = (x.getPath().getName() for x in self.fs.listStatus(self.path)) if self.exists() else ()
        return sorted(n for n in names if n[0] not in "_.")

    def delete(self) -> None:
        self.fs.delete(self.path, True)

    def move(self, to: Place) -> None:
        """Takes the place of what is there: a file or folder of that name goes only after this one has its name."""
        self.fs.mkdirs(to.path.getParent())
        old = Place(f"{to.path.getParent().toString()}/_old-{uuid.uuid4().hex}", self.spark)
        before = to.exists()
        if before and not self.fs.rename(to.path, old.path):
            raise OSError(f"cannot move {to} aside")
        if not self.fs.rename(self.path, to.path):
            raise OSError(f"cannot move {self} to {to}")
        if before:
            old.delete()

    def read_text(self) -> str:
        if not self.exists():
            raise FileNotFoundError(f"no such artifact: {self}")
        stream = self.fs.open(self.path)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write_text(self, text: str) -> None:
        aside = Place(f"{self.path.getParent().toString()}/_new-{uuid.uuid4().hex}", self.spark)
        stream = self.fs.create(aside.path, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        aside.move(self)

    def sha256(self) -> str:
        """Of a file's bytes, read as a stream where they are; of a folder, of the names and digests in it."""
        if self.fs.getFileStatus(self.path).isDirectory():
            return hashlib.sha256("\n".join(f"{n} {(self / n).sha256()}" for n in self.children()).encode()).hexdigest()
        stream = self.fs.open(self.path)
        try:
            return self.spark._jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(stream)
        finally:
            stream.close()

    def read_json(self) -> Any:
        return json.loads(self.read_text())

    def write_json(self, payload: Any) -> None:
        self.write_text(json.dumps(payload, indent=2, sort_keys=True, ensure_ascii=False))
