"""Opening and writing landed objects from inside a task."""

from __future__ import annotations

import re
from urllib.parse import urlparse


def open_object(path: str):
    """Readable, seekable binary handle, local or on any store Arrow knows."""
    parsed = urlparse(path)
    if parsed.scheme in ("", "file"):
        return open(path.removeprefix("file://").removeprefix("file:"), "rb")
    from pyarrow import fs
    filesystem, _ = fs.FileSystem.from_uri(f"{parsed.scheme}://{parsed.netloc}")
    key = parsed.path if parsed.scheme in ("hdfs", "viewfs") else parsed.netloc + parsed.path
    return filesystem.open_input_file(key)


def filesystem_of(folder: str):
    """(Arrow filesystem, path on it) of a folder to write to."""
    from pyarrow import fs
    uri = folder if urlparse(folder).scheme else f"file://{folder}"
    filesystem, base = fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", uri))
    return filesystem, base.rstrip("/")
