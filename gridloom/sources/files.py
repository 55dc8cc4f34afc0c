"""Files by path or URI, and files that many tasks write together.

A task writes its records to a part file beside the destination, which executors share, and reports
where they lie.  The driver then streams the parts of the attempts that were committed into one file, a
block at a time, so neither side holds more than a block.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow.fs as pafs

BLOCK = 8 << 20


def at(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if "://" in path:
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path.removeprefix("file:")


def open_read(path: str):
    fs, p = at(path)
    return fs.open_input_file(p)


def open_write(path: str):
    fs, p = at(path)
    return fs.open_output_stream(p)


def exists(path: str) -> bool:
    fs, p = at(path)
    return fs.get_file_info(p).type != pafs.FileType.NotFound


def size(path: str) -> int:
    fs, p = at(path)
    return fs.get_file_info(p).size


def read_all(path: str) -> bytes:
    with open_read(path) as f:
        return f.read()


def delete(*paths: str) -> None:
    """Delete files and folders; those that are missing are passed over."""
    for path in paths:
        fs, p = at(path)
        kind = fs.get_file_info(p).type
        if kind == pafs.FileType.File:
            fs.delete_file(p)
        elif kind == pafs.FileType.Directory:
            fs.delete_dir(p)


def parts_folder(path: str) -> str:
    return f"{path}.parts-{uuid.uuid4().hex}"


def new_part(folder: str) -> str:
    fs, p = at(folder)
    fs.create_dir(p, recursive=True)
    return f"{folder}/{uuid.uuid4().hex}"


def blocks(path: str, start: int = 0, length: int | None = None) -> Iterator[bytes]:
    with open_read(path) as f:
        f.seek(start)
        left = size(path) - start if length is None else length
        while left > 0:
            got = f.read(min(BLOCK, left))
            if not got:
                raise EOFError(path)
            left -= len(got)
            yield got
