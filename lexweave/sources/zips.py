"""Zip archives as a data source: a large archive is read by many tasks, each a range of its members."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: File systems that tasks can seek in.
SCHEMES = ("", "file", "hdfs", "s3", "s3a", "gs")


class _File(io.RawIOBase):
    """A file of pyarrow's that fails as zipfile expects when it is asked for a place before its start."""

    def __init__(self, raw):
        self.raw, self.length = raw, raw.size()

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.raw.tell()

    def seek(self, offset: int, whence: int = io.SEEK_SET) -> int:
        to = offset + {io.SEEK_SET: 0, io.SEEK_CUR: self.raw.tell(), io.SEEK_END: self.length}[whence]
        if to < 0:
            raise OSError("before the start of the file")
        return self.raw.seek(to)

    def readinto(self, buffer) -> int:
        piece = self.raw.read(len(buffer))
        buffer[: len(piece)] = piece
        return len(piece)

    def close(self) -> None:
        self.raw.close()
        super().close()


def _open(path: str) -> io.BufferedReader:
    """A file of one of SCHEMES, which can be sought in."""
    from pyarrow.fs import FileSystem, LocalFileSystem

    if not urlparse(path).scheme:
        return io.BufferedReader(_File(LocalFileSystem().open_input_file(path)), 1 << 18)
    fs, name = FileSystem.from_uri("s3" + path[3:] if path.startswith("s3a:") else path)
    return io.BufferedReader(_File(fs.open_input_file(name)), 1 << 18)


@dataclass
class Members(InputPartition):
    """Members first to last - 1 of an archive's directory."""

    path: str
    first: int
    last: int


class ZipReader(DataSourceReader):
    def __init__(self, paths: list[str], most: int):
        self.paths, self.most = paths, most

    def partitions(self) -> list[Members]:
        """Ranges of members of about most bytes as stored, one at least in each; archives' directories alone are read."""
        out = []
        for path in self.paths:
            with _open(path) as raw, zipfile.ZipFile(raw) as archive:
                first, size, infos = 0, 0, archive.infolist()
            for k, info in enumerate(infos):
                if size and size + info.compress_size > self.most:
                    out.append(Members(path, first, k))
                    first, size = k, 0
                size += info.compress_size
            if infos:
                out.append(Members(path, first, len(infos)))
        return out

    def read(self, partition: Members) -> Iterator[tuple]:
        with _open(partition.path) as raw, zipfile.ZipFile(raw) as archive:
            for info in archive.infolist()[partition.first : partition.last]:
                if not info.is_dir():
                    yield partition.path, info.filename, archive.read(info)


class ZipMembers(DataSource):
    """Format zip_members: archive, member, content; options paths (of archives, one a line) and maxBytes (64 MB)."""

    @classmethod
    def name(cls) -> str:
        return "zip_members"

    def schema(self) -> str:
        return "archive string, member string, content binary"

    def reader(self, schema) -> ZipReader:
        return ZipReader([p for p in self.options["paths"].split("\n") if p], int(self.options.get("maxbytes", 64 << 20)))


def read_members(spark: SparkSession, path: str, most: int = 64 << 20) -> DataFrame:
    """Archive, member, content of the zip archives at path (a file, folder or pattern), in as many tasks as their sizes ask
    for; a task holds one member. Spark lists the archives; their paths have to be of SCHEMES, as tasks seek in them."""
    found = [r["path"] for r in spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("path").collect()]
    if odd := [p for p in found if urlparse(p).scheme not in SCHEMES]:
        raise ValueError(f"{odd[0]} is in no file system of {', '.join(filter(None, SCHEMES))}; read_zips() reads archives whole")
    spark.dataSource.register(ZipMembers)
    return spark.read.format("zip_members").option("paths", "\n".join(sorted(found))).option("maxBytes", most).load()
