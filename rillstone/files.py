"""Small metadata files on whatever file system the session knows, created exclusively."""

from __future__ import annotations

import os
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Files:
    """Small files on whatever file system the session knows."""

    def __init__(self, spark: SparkSession, root: str, make: bool = True):
        self.jvm, self.root, self.gateway, self.conf = spark._jvm, root.rstrip("/"), spark.sparkContext._gateway, spark._jsc.hadoopConfiguration()
        self.fs = self._path("").getFileSystem(self.conf)
        #: The folder on a local file system, which needs no call to the JVM for each file.
        self.local = self._path("").toUri().getPath() if self.fs.getUri().getScheme() == "file" else None
        if make:
            self.fs.mkdirs(self._path(""))

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self) -> list[str]:
        """Names in the folder, none if it isn't there."""
        if self.local is not None:
            return sorted(n for n in os.listdir(self.local) if not (n.startswith(".") and n.endswith(".crc"))) if os.path.isdir(self.local) else []
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self._path(""))) if self.fs.exists(self._path("")) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Whether the file is ours; false if it exists already. It is written under another name and takes its own when it is whole, so that a writer that dies leaves no torn file: local file systems link it, others rename it where nothing is."""
        if self.local is not None:
            with tempfile.NamedTemporaryFile("w", dir=self.local, prefix=".new-", delete=False) as f:
                f.write(text)
            try:
                os.link(f.name, f"{self.local}/{name}")
                return True
            except FileExistsError:
                return False
            finally:
                os.unlink(f.name)
        whole, own = self._path(f".new-{uuid.uuid4().hex}"), self._path(name)
        stream = self.fs.create(whole, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        hadoop = self.jvm.org.apache.hadoop.fs
        how = getattr(hadoop, "Options$Rename")
        options = self.gateway.new_array(how, 1)
        options[0] = how.NONE
        try:
            hadoop.FileContext.getFileContext(self.fs.getUri(), self.conf).rename(whole, own, options)
            return True
        except Py4JJavaError as e:
            self.fs.delete(whole, False)
            if "FileAlreadyExists" in str(e.java_exception) or "already exists" in str(e.java_exception) or "rename destination" in str(e.java_exception):
                return False
            raise

    def latest(self, prefix: str) -> tuple[int, str | None]:
        """Of the files named ``prefix``, a number and .json: the highest number there is, and the text of the highest that is whole (it ends with a line end); (0, None) if there is none."""
        while True:
            names = [n for n in self.names() if n.startswith(prefix) and n.endswith(".json")]
            try:
                text = next((t for n in reversed(names) if (t := self.read(n)).endswith("\n")), None)
            except Py4JJavaError as e:
                if "FileNotFound" in str(e.java_exception):
                    continue  # old ones were deleted in between
                raise
            return (int(names[-1][len(prefix) : -5]), text) if names else (0, None)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._path(name))

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), True)
