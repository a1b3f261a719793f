"""Binary files in the shared folder, through pyarrow's file systems."""

from __future__ import annotations

import re


def file_system(uri: str):
    """(file system, path) for a URI or a plain path; works in any executor."""
    from pyarrow import fs

    if not re.match(r"[a-z][a-z0-9+.-]*:", uri):
        return fs.LocalFileSystem(), uri
    # Hadoop's names for the same stores
    uri = re.sub(r"^s3[an]:", "s3:", re.sub(r"^file:/+", "file:///", uri))
    return fs.FileSystem.from_uri(uri)


def opened(uri: str):
    """A random-access reader."""
    f, path = file_system(uri)
    return f.open_input_file(path)


def created(uri: str):
    """A sequential writer; makes the parent folder."""
    f, path = file_system(uri)
    f.create_dir(path.rpartition("/")[0], recursive=True)
    return f.open_output_stream(path)
