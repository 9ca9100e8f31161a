"""Binary files that tasks write to, and read from, the shared folder."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import BinaryIO
from uuid import uuid4

from pyarrow import fs
from pyspark.sql import SparkSession

from shopfloor.sources.staging import workspace


def folder(spark: SparkSession, label: str) -> str:
    """A new folder name under the session's shared folder."""
    return f"{workspace(spark)}/{label}-{uuid4().hex}"


@contextmanager
def created(directory: str, suffix: str) -> Iterator[tuple[str, BinaryIO]]:
    """A new file of a name of its own, so that a repeated task never meets the file of its first try."""
    system, path = fs.FileSystem.from_uri(directory)
    system.create_dir(path, recursive=True)
    name = f"{uuid4().hex}{suffix}"
    # The callers compress; the default would add a second layer for names like .gz.
    with system.open_output_stream(f"{path}/{name}", compression=None) as out:
        yield f"{directory}/{name}", out


def opened(uri: str) -> BinaryIO:
    """Random access to a file."""
    system, path = fs.FileSystem.from_uri(uri)
    return system.open_input_file(path)
