"""Small files in any store that Spark reaches: through the local file system where a path is local, else through Hadoop's."""

from __future__ import annotations

import os
import shutil

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        bare = self.root.removeprefix("file://")
        self.local = bare if bare.startswith("/") and "://" not in bare else None

    def path(self, *parts: str) -> str:
        return "/".join((self.root, *parts))

    def _here(self, path: str) -> str:
        return f"{self.local}/{path}"

    def _fs(self, path: str):
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path(path))
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def read(self, path: str) -> str | None:
        if self.local:
            try:
                with open(self._here(path), encoding="utf-8") as f:
                    return f.read()
            except FileNotFoundError:
                return None
        fs, at = self._fs(path)
        if not fs.exists(at):
            return None
        stream = fs.open(at)
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def create(self, path: str, text: str) -> bool:
        """Writes a new file whole; False, and nothing changes, if it is there already."""
        if self.local:
            to = self._here(path)
            os.makedirs(os.path.dirname(to), exist_ok=True)
            draft = f"{to}.{os.getpid()}.{id(text)}.draft"
            with open(draft, "w", encoding="utf-8") as f:
                f.write(text)
            try:
                os.link(draft, to)  # fails if the name is taken
                return True
            except FileExistsError:
                return False
            finally:
                os.unlink(draft)
        fs, at = self._fs(path)
        try:
            stream = fs.create(at, False)
        except Exception as e:
            if "AlreadyExists" in str(e):
                return False
            raise
        stream.write(bytearray(text.encode()))
        stream.close()
        return True

    def names(self, path: str) -> list[str]:
        if self.local:
            try:
                return sorted(x for x in os.listdir(self._here(path)) if not x.endswith(".draft"))
            except FileNotFoundError:
                return []
        fs, at = self._fs(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []

    def delete(self, path: str) -> None:
        if self.local:
            here = self._here(path)
            shutil.rmtree(here) if os.path.isdir(here) else os.path.exists(here) and os.unlink(here)
            return
        fs, at = self._fs(path)
        fs.delete(at, True)

    def size(self, path: str) -> int:
        """Bytes of all files below an absolute path."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return fs.getContentSummary(at).getLength() if fs.exists(at) else 0
