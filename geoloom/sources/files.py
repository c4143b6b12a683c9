"""Files by ranges: parts of files and of zip entries, listings, and files that appear whole or not at all.

Paths are plain paths or URIs of a store that pyarrow reaches. `a.zip!name` is an entry of an archive.
"""

from __future__ import annotations

import struct
import tempfile
import uuid
import zlib

from pyarrow import fs
from pyspark.sql import SparkSession

#: Bytes that a deflated entry is unpacked by, and of a local header in an archive.
CHUNK, LOCAL_HEADER = 1 << 20, 30
ENTRY = "!"


def located(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:/"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class Ranges:
    """A file that is read in parts."""

    def __init__(self, path: str):
        system, place = located(path)
        self.file = system.open_input_file(place)
        self.size = self.file.size()

    def read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def close(self) -> None:
        self.file.close()


class Held:
    """Bytes that are there already, read like a file."""

    def __init__(self, data: bytes):
        self.data, self.size = data, len(data)

    def read(self, at: int, n: int) -> bytes:
        return self.data[at : at + n]

    def close(self) -> None:
        pass


class Stored:
    """An entry that lies in an archive as it is: a part of the archive."""

    def __init__(self, archive, header: int, size: int):
        n, extra = struct.unpack("<HH", archive.read(header, LOCAL_HEADER)[26:30])
        self.archive, self.begin, self.size = archive, header + LOCAL_HEADER + n + extra, size

    def read(self, at: int, n: int) -> bytes:
        return self.archive.read(self.begin + at, max(0, min(n, self.size - at)))

    def close(self) -> None:
        self.archive.close()


class Deflated:
    """An entry that is unpacked as it is read. Reading goes forward; a part further back begins anew."""

    def __init__(self, archive, header: int, packed: int, size: int):
        self.packed, self.size = Stored(archive, header, packed), size
        self._begin()

    def _begin(self) -> None:
        self.unpacker, self.taken, self.at, self.held = zlib.decompressobj(-15), 0, 0, b""

    def read(self, at: int, n: int) -> bytes:
        n = max(0, min(n, self.size - at))
        if at < self.at:
            self._begin()
        while self.at + len(self.held) < at + n:
            more = self.unpacker.unconsumed_tail
            if not more:
                more = self.packed.read(self.taken, CHUNK)
                self.taken += len(more)
            if not more:
                raise ValueError("a zip entry is cut off")
            keep = max(0, at - self.at)
            self.held, self.at = self.held[keep:], self.at + min(keep, len(self.held))
            self.held += self.unpacker.decompress(more, CHUNK)
        return self.held[at - self.at : at - self.at + n]

    def close(self) -> None:
        self.packed.close()


def opened(path: str, entry: tuple[int, int, int, int] | None = None):
    """A file, or an entry (packed size, size, method, header offset) of an archive."""
    archive = Ranges(path.partition(ENTRY)[0] if entry else path)
    if entry is None:
        return archive
    packed, size, method, header = entry
    if method not in (0, 8):
        raise ValueError(f"zip method {method} is not supported")
    return Stored(archive, header, size) if method == 0 else Deflated(archive, header, packed, size)


def listed(path: str, suffixes: tuple[str, ...]) -> list[tuple[str, int]]:
    """(path, size) of a file, or of all files below a folder whose names end so, in order; hidden ones are left out."""
    system, place = located(path)
    prefix = path[: len(path) - len(place)] if path.endswith(place) else ""
    info = system.get_file_info(place)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == fs.FileType.File else [x for x in system.get_file_info(fs.FileSelector(place, recursive=True)) if x.type == fs.FileType.File and x.base_name.lower().endswith(suffixes)]
    return sorted((prefix + x.path, x.size) for x in found if not x.base_name.startswith(("_", ".")))


def read_text(path: str) -> str:
    source = opened(path)
    try:
        return source.read(0, source.size).decode("utf-8-sig")
    finally:
        source.close()


def hidden(folder: str, job: str) -> str:
    """A new name for a file that is being written; it becomes visible when it is published."""
    return f"{folder.rstrip('/')}/.{job}-{uuid.uuid4().hex}"


def write(path: str, parts) -> int:
    """Writes a file from parts; returns its bytes."""
    system, place = located(path)
    system.create_dir(place.rpartition("/")[0], recursive=True)
    total = 0
    with system.open_output_stream(place) as out:
        for part in parts:
            out.write(part)
            total += len(part)
    return total


def publish(moves: list[tuple[str, str]]) -> None:
    """Moves finished files to their names, in the given order."""
    for old, new in moves:
        system, place = located(old)
        system.move(place, located(new)[1])


def discard(folder: str, job: str) -> None:
    """Deletes what tasks of a job have left under hidden names."""
    system, place = located(folder)
    if system.get_file_info(place).type != fs.FileType.Directory:
        return
    for x in system.get_file_info(fs.FileSelector(place)):
        if x.type == fs.FileType.File and x.base_name.startswith(f".{job}-"):
            system.delete_file(x.path)


def clear(folder: str, suffixes: tuple[str, ...]) -> None:
    """Deletes the files of a folder whose names end so."""
    system, place = located(folder)
    if system.get_file_info(place).type == fs.FileType.Directory:
        for x in system.get_file_info(fs.FileSelector(place)):
            if x.type == fs.FileType.File and x.base_name.lower().endswith(suffixes):
                system.delete_file(x.path)


_own: dict[str, str] = {}


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder that driver and executors share, below spark.checkpoint.dir. Only a local master may do without that setting."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = _own.setdefault(spark.sparkContext.applicationId, "") or tempfile.mkdtemp(prefix="geoloom-files-")
        _own[spark.sparkContext.applicationId] = found
    return f"{found.rstrip('/')}/geoloom-{label}-{uuid.uuid4().hex}"
