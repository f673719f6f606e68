"""Files on whatever file system a path is on: by Spark's own file systems on the driver, by Arrow's in tasks."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from fnmatch import fnmatch
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import SparkSession


class Storage:
    """Names, moves and deletions on the file system that Spark has for ``path``; the driver handles names only, never contents."""

    def __init__(self, spark: SparkSession, path: str):
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def files(self, path: str) -> Iterator[str]:
        """All files below a folder. Names only: Hadoop's own walk asks for permissions too, which on a local disk starts a process per file."""
        for status in self.fs.listStatus(self._path(path)):
            if status.isDirectory():
                yield from self.files(status.getPath().toString())
            else:
                yield status.getPath().toString()

    def move(self, source: str, target: str) -> None:
        """Give a file a name, in place of a file that has it."""
        to = self._path(target)
        if self.fs.exists(to):
            self.fs.delete(to, False)
        if not self.fs.rename(self._path(source), to):
            raise OSError(f"{source} could not be moved to {target}")

    def name_parts(self, staging: str, path: str, pattern: str, name: Callable[[re.Match], str]) -> None:
        """Move the part files below ``staging`` whose path has ``pattern`` to the names below ``path`` that it gives them."""
        found: dict[str, str] = {}
        for file in self.files(staging):
            if m := re.search(pattern + r"/part-[^/]*$", file):
                if name(m) in found:
                    raise ValueError(f"{name(m)} has several parts")
                found[name(m)] = file
        made: set[str] = set()
        for to, file in found.items():
            target = f"{path.rstrip('/')}/{to}"
            folder = target.rsplit("/", 1)[0]
            if folder not in made:
                self.fs.mkdirs(self._path(folder))
                made.add(folder)
            self.move(file, target)

    def settle(self, source: str, target: str) -> None:
        """Give the files below a folder their names below another: at once if that is not there yet, else beside what it has."""
        to = self._path(target)
        if not self.fs.exists(to):
            self.fs.mkdirs(to.getParent())
            if not self.fs.rename(self._path(source), to):
                raise OSError(f"{source} could not be moved to {target}")
        elif self.fs.isDirectory(to) and self.fs.isDirectory(self._path(source)):
            for status in self.fs.listStatus(self._path(source)):
                self.settle(status.getPath().toString(), f"{target.rstrip('/')}/{status.getPath().getName()}")
        else:
            self.move(source, target)

    def staging(self, path: str) -> str:
        """A new folder for what will be at ``path``: beside it, or inside if it is there, as the root of a bucket or mount always is."""
        return f"{path.rstrip('/')}{'/' if self.has(path) else '.'}_staging-{uuid.uuid4().hex}"

    def has(self, path: str) -> bool:
        return self.fs.exists(self._path(path))

    def size(self, path: str) -> int:
        """Bytes of all files below a folder."""
        return self.fs.getContentSummary(self._path(path)).getLength()

    def remove(self, path: str) -> None:
        """Delete a file or a folder, if there is one."""
        self.fs.delete(self._path(path), True)


def opens(path: str) -> bool:
    """Whether Arrow has a file system for ``path``: local, s3, gs, abfs, and hdfs where its native library is installed."""
    try:
        arrow_fs.FileSystem.from_uri(path)
    except (OSError, ValueError):
        return False
    return True


def matching(path: str, pattern: str) -> list[tuple[str, int]]:
    """(path, bytes) of the files at or below ``path`` whose name matches; names that begin with . or _ are hidden, as for Spark."""
    system, inner = arrow_fs.FileSystem.from_uri(path)
    scheme = path.split("://", 1)[0] + "://" if "://" in path else ""
    info = system.get_file_info(inner)
    found = [info] if info.is_file else system.get_file_info(arrow_fs.FileSelector(inner, recursive=True, allow_not_found=True))
    return sorted((scheme + f.path, f.size) for f in found if f.is_file and f.base_name[0] not in "._" and fnmatch(f.base_name, pattern))


@contextmanager
def opened(path: str) -> Iterator[BinaryIO]:
    """A file that can be read from any place."""
    path = re.sub("^file:/(?!/)", "file:///", path)  # as Spark writes local paths
    system, inner = arrow_fs.FileSystem.from_uri(path)
    with system.open_input_file(inner) as f:
        yield f


def placed(path: str, content: bytes) -> None:
    """Write a small file from a task. It gets its name when it is whole, so attempts that fail or run twice do no harm."""
    system, inner = arrow_fs.FileSystem.from_uri(path)
    system.create_dir(inner.rsplit("/", 1)[0], recursive=True)
    part = f"{inner.rsplit('/', 1)[0]}/.{uuid.uuid4().hex}"
    with system.open_output_stream(part) as f:
        f.write(content)
    system.move(part, inner)


def place_files(batches: Iterator[pa.RecordBatch], path: str, compression: str | None = None) -> Iterator[pa.RecordBatch]:
    """In a task, write (file, piece) rows, the pieces of a file following each other, to files below ``path``; their number.

    A file is streamed under a hidden name beside ``path`` and gets its own when it is whole.
    """
    system, root = arrow_fs.FileSystem.from_uri(path)
    part, made, n = f"{root}-parts/{uuid.uuid4().hex}", set(), 0
    system.create_dir(f"{root}-parts", recursive=True)
    name, out = None, None

    def close() -> None:
        out.close()
        folder = f"{root}/{name}".rsplit("/", 1)[0]
        if folder not in made:
            system.create_dir(folder, recursive=True)
            made.add(folder)
        system.move(part, f"{root}/{name}")

    for batch in batches:
        for file, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if file is None:
                raise ValueError("a file has no name")
            if file != name:
                if out:
                    close()
                name, out, n = file, system.open_output_stream(part, compression=compression, buffer_size=1 << 20), n + 1
            out.write(piece)
    if out:
        close()
    yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])
