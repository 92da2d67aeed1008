"""Files that executors write to, and read from, the shared folder.

Paths are URIs (``file:``, ``hdfs:``, ``s3a:`` ...); nothing assumes a local disk.
A file appears under its name only when it is complete: tasks write to a name of
their own and move it, so a task that is run twice leaves one whole file.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from typing import BinaryIO

import pyarrow.fs as pafs


def open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    if ":/" not in path:
        return pafs.LocalFileSystem(), path
    scheme, _, rest = path.partition(":")
    if scheme == "file":
        return pafs.LocalFileSystem(), "/" + rest.lstrip("/")
    return pafs.FileSystem.from_uri(path.replace("s3a:", "s3:", 1))


@contextmanager
def new_file(path: str) -> Iterator[BinaryIO]:
    """A file that gets its name when the block ends without an error."""
    fs, name = open_fs(path)
    folder, _, last = name.rpartition("/")
    part = f"{folder}/.{last}.{uuid.uuid4().hex}"
    try:
        with fs.open_output_stream(part) as out:
            yield out
        fs.move(part, name)
    except BaseException:
        if fs.get_file_info(part).type != pafs.FileType.NotFound:
            fs.delete_file(part)
        raise


def open_file(path: str):
    """A seekable file for reading."""
    fs, name = open_fs(path)
    return fs.open_input_file(name)


def partition_id() -> int:
    from pyspark import TaskContext
    return TaskContext.get().partitionId()


