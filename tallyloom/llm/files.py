"""Files that tasks write to and read from the shared folder, by its URI."""

from __future__ import annotations

from pyarrow import fs as pafs
from pyspark import TaskContext


def place(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI or of an absolute path, and the path in it."""
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def temporary(name: str) -> str:
    """A name that no other attempt of this or another task uses."""
    task = TaskContext.get()
    return f"_tmp/{name}.{task.taskAttemptId() if task else 0}"


def commit(system: pafs.FileSystem, base: str, temp: str, name: str) -> None:
    """Give a finished file its final name; a later attempt of the same task replaces it by equal bytes."""
    system.move(f"{base}/{temp}", f"{base}/{name}")
