"""Files of our own formats in the folder that all executors share."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

from pyarrow import fs


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or address, and the path in it."""
    if uri.startswith("file:"):
        uri = "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


def attempt_name(path: str) -> str:
    """A name that no other attempt at this task uses."""
    from pyspark import TaskContext

    return f"{path}.attempt-{TaskContext.get().taskAttemptId()}"


@contextlib.contextmanager
def whole_file(uri: str) -> Iterator:
    """A stream to a file that appears under its name only when it is complete.

    A task that is run again writes the same bytes under the same name.
    """
    system, path = opened(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    part = attempt_name(path)
    with system.open_output_stream(part) as out:
        yield out
    system.move(part, path)
