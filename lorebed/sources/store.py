"""Files in any store that Spark knows (local, HDFS, S3 and the like): list, read, write, copy, move, delete by Hadoop's file systems."""

from __future__ import annotations

import struct
from collections.abc import Iterator

from pyspark.sql import SparkSession

#: The header of a ZIM archive: fields and their layout (fixed values).
ZIM_HEADER = struct.Struct("<IHH16sIIQQQQIIQ")
ZIM_FIELDS = ("magic", "major", "minor", "uuid", "entries", "clusters", "url_list", "title_list", "cluster_list", "mime_list", "main_page", "layout_page", "checksum_at")
ZIM_MAGIC = 0x044D495A


class Store:
    """The files below one path."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _files(self):
        return self._path("").getFileSystem(self._conf)

    def exists(self, name: str = "") -> bool:
        return self._files().exists(self._path(name))

    def list(self, prefix: str = "") -> Iterator[tuple[str, int]]:
        """(name, bytes) of all files whose name starts so."""
        if not self.exists():
            return
        base = self._files().makeQualified(self._path("")).toUri().getPath().rstrip("/") + "/"
        found = self._files().listFiles(self._path(""), True)
        while found.hasNext():
            status = found.next()
            name = status.getPath().toUri().getPath()[len(base) :]
            if name.startswith(prefix):
                yield name, status.getLen()

    def size(self, name: str) -> int | None:
        return self._files().getFileStatus(self._path(name)).getLen() if self.exists(name) else None

    def read(self, name: str, most: int = 1 << 20, start: int = 0) -> bytes:
        """At most ``most`` bytes from ``start``; what is larger is Spark's to read."""
        opened = self._files().open(self._path(name))
        try:
            opened.seek(start)
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(self._jvm.org.apache.commons.io.input.BoundedInputStream(opened, most)))
        finally:
            opened.close()

    def write(self, name: str, data: bytes) -> None:
        opened = self._files().create(self._path(name), True)
        try:
            opened.write(bytearray(data))
        finally:
            opened.close()

    def copy(self, name: str, to: str) -> bool:
        """A file or folder; the copy replaces what is there."""
        files = self._files()
        return self._jvm.org.apache.hadoop.fs.FileUtil.copy(files, self._path(name), files, self._path(to), False, True, self._conf)

    def move(self, name: str, to: str) -> bool:
        self._files().mkdirs(self._path(to).getParent())
        return self._files().rename(self._path(name), self._path(to))

    def delete(self, name: str) -> bool:
        return self._files().delete(self._path(name), True)


def zim_header(data: bytes) -> dict[str, int | str] | None:
    """The fields of an archive's first 80 bytes; None if it is none."""
    if len(data) < ZIM_HEADER.size:
        return None
    found = dict(zip(ZIM_FIELDS, ZIM_HEADER.unpack_from(data), strict=True))
    return found | {"uuid": found["uuid"].hex()} if found["magic"] == ZIM_MAGIC else None
