"""Access to the file system that Spark uses, by its own client, for the driver's small files."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from py4j.java_gateway import JavaObject
from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Files:
    """Hadoop file system calls for one session."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def path(self, name: str) -> JavaObject:
        return self._jvm.org.apache.hadoop.fs.Path(name)

    def _fs(self, name: str) -> JavaObject:
        return self.path(name).getFileSystem(self._conf)

    def exists(self, name: str) -> bool:
        return self._fs(name).exists(self.path(name))

    def make_dirs(self, name: str) -> None:
        self._fs(name).mkdirs(self.path(name))

    def delete(self, name: str) -> None:
        self._fs(name).delete(self.path(name), True)

    def size(self, name: str) -> int:
        """Bytes of a file; FileNotFoundError if there is none."""
        try:
            return self._fs(name).getFileStatus(self.path(name)).getLen()
        except Py4JJavaError as e:
            raise FileNotFoundError(name) from e

    def qualified(self, name: str) -> str:
        return self._fs(name).makeQualified(self.path(name)).toString()

    def names(self, folder: str) -> Iterator[tuple[str, bool]]:
        """(name, whether it is a file) of what lies directly in a folder."""
        for status in self._fs(folder).listStatus(self.path(folder)):
            yield status.getPath().getName(), status.isFile()

    def read(self, name: str, most: int | None = None) -> bytes:
        """Content of a small file, or its first ``most`` bytes."""
        if most is None:
            most = self.size(name)
        stream = self._fs(name).open(self.path(name))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(
                self._jvm.org.apache.commons.io.input.BoundedInputStream(stream, most)
            ))
        finally:
            stream.close()

    def write(self, name: str, data: bytes) -> None:
        """Write a new file; it must not exist."""
        stream = self._fs(name).create(self.path(name), False)
        try:
            stream.write(bytearray(data))
            stream.hsync()
        finally:
            stream.close()

    def publish(self, temporary: str, name: str) -> None:
        """Rename once: FileExistsError if the name is taken, also by another writer just now.

        ``FileSystem.rename`` would move a folder into an existing one; this call doesn't.
        File systems without an atomic rename (object stores) give no such guarantee.
        """
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.path(name).toUri(), self._conf)
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = self._jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            context.rename(context.makeQualified(self.path(temporary)), context.makeQualified(self.path(name)), options)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                raise FileExistsError(name) from e
            raise

    @contextmanager
    def written_once(self, name: str, what: str) -> Iterator[str]:
        """A temporary name beside ``name`` that is published if the block ends well and removed if not."""
        if self.exists(name):
            raise FileExistsError(f"{what} path already exists")
        folder, _, last = name.rpartition("/")
        temporary = f"{folder}/.{last}.tmp-{uuid.uuid4().hex}"
        try:
            yield temporary
            self.publish(temporary, name)
        finally:
            self.delete(temporary)
