"""Binary files wherever the cluster keeps them: plain paths or URIs, through
pyarrow's file systems. Plain paths must be on a mount that all machines share."""

from __future__ import annotations

import re


def located(path: str):
    """(file system, path) of a plain path or a URI."""
    from pyarrow import fs

    if not re.match(r"[a-z][a-z0-9+.-]*:", path):
        return fs.LocalFileSystem(), path
    # Hadoop's names for the same stores
    return fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", re.sub(r"^file:/+", "file:///", path)))


def size(path: str) -> int | None:
    """Bytes of a file; None if there is none."""
    from pyarrow import fs

    store, at = located(path)
    info = store.get_file_info(at)
    return info.size if info.type == fs.FileType.File else None


def read(path: str, offset: int, n: int) -> bytes:
    """Up to n bytes from ``offset`` on; FileNotFoundError for a missing file."""
    store, at = located(path)
    with store.open_input_file(at) as f:
        return f.read_at(n, offset) if f.size() > offset else b""


def write(path: str, chunks) -> None:
    """One new file of chunks of bytes, whose folder is made if need be."""
    store, at = located(path)
    if "/" in at.strip("/"):
        store.create_dir(at.rpartition("/")[0], recursive=True)
    with store.open_output_stream(at) as f:
        for x in chunks:
            f.write(x)


def delete(path: str) -> None:
    store, at = located(path)
    if size(path) is not None:
        store.delete_file(at)
