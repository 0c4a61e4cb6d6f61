"""Opening files of any file system that Arrow reaches (local, hdfs://, s3:// ...), on the driver or an executor."""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator

from pyarrow import fs


def resolve(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def listed(path: str) -> list[str]:
    """The file, or the files of a folder, as paths that resolve() takes."""
    system, inner = resolve(path)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.Directory:
        found = sorted(x.path for x in system.get_file_info(fs.FileSelector(inner)) if x.type == fs.FileType.File and not x.base_name.startswith(("_", ".")))
    elif info.type == fs.FileType.File:
        found = [inner]
    else:
        raise FileNotFoundError(path)
    scheme = path.split("://")[0] + "://" if "://" in path and not path.startswith("file://") else ""
    return [scheme + x if scheme and "://" not in x else x for x in found]


class _Native(io.RawIOBase):
    """An Arrow file as a raw stream of Python's."""

    def __init__(self, native):
        self.native = native

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        data = self.native.read(len(buffer))
        buffer[: len(data)] = data
        return len(data)

    def seek(self, at: int, whence: int = 0) -> int:
        self.native.seek(at, whence)
        return self.native.tell()

    def tell(self) -> int:
        return self.native.tell()


def open_binary(path: str) -> io.BufferedReader:
    system, inner = resolve(path)
    return io.BufferedReader(_Native(system.open_input_file(inner)), 1 << 20)


def is_packed(path: str) -> bool:
    with open_binary(path) as f:
        return f.peek(2)[:2] == b"\x1f\x8b"


def size_of(path: str) -> int:
    system, inner = resolve(path)
    return system.get_file_info(inner).size


def lines(path: str, begin: int = 0) -> Iterator[tuple[int, str]]:
    """Lines without their ends, and where each begins, from the first that begins at or after a place of the file. gzip
    is seen by its first bytes; its places are those of the unpacked text, from 0."""
    packed = is_packed(path)
    with open_binary(path) as f:
        stream = gzip.open(f, "rb") if packed else f
        at = 0
        if begin:
            stream.seek(begin - 1)
            at = begin - 1 + len(stream.readline())
        for line in stream:
            yield at, line.rstrip(b"\r\n").decode("utf-8", "replace")
            at += len(line)
