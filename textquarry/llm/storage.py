"""Files of our own formats in the shared folder, written by tasks that may be run again."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

from pyarrow import fs as arrow_fs


def opened(path: str) -> tuple[arrow_fs.FileSystem, str]:
    """The file system of a URI or plain path, and the path within it."""
    return arrow_fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (arrow_fs.LocalFileSystem(), path)


@contextlib.contextmanager
def written(path: str) -> Iterator:
    """A stream to a new file that appears under its name only when all is written; a second attempt replaces the first."""
    store, name = opened(path)
    store.create_dir(name.rpartition("/")[0], recursive=True)
    part = f"{name}.{uuid.uuid4().hex}.tmp"
    try:
        with store.open_output_stream(part, buffer_size=1 << 20) as out:
            yield out
        store.move(part, name)
    except BaseException:
        with contextlib.suppress(OSError):
            store.delete_file(part)
        raise


def random_access(path: str):
    store, name = opened(path)
    return store.open_input_file(name)


def stream(path: str):
    store, name = opened(path)
    return store.open_input_stream(name, compression=None, buffer_size=1 << 20)
