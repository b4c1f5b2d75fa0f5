"""Files that tasks open themselves, on any file system that pyarrow knows (local and mounted paths, hdfs://, s3://, gs://)."""

from __future__ import annotations

import os

from pyarrow import fs


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, and the path on it."""
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), os.path.abspath(path.removeprefix("file:"))
