"""Where dataset files lie: local paths, and URIs of any file system that Arrow knows (hdfs, s3, gs, file)."""

from __future__ import annotations

import os

from pyarrow import fs


def system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path within it."""
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), os.path.abspath(path))


def full(path: str) -> str:
    """The path as Spark's scans take it; a local one without its scheme."""
    return path if "://" in path and not path.startswith("file:") else system(path)[1]


def size(path: str) -> int | None:
    """Bytes of a file; None if it isn't there."""
    held, at = system(path)
    info = held.get_file_info(at)
    return info.size if info.type == fs.FileType.File else None


def files_below(path: str) -> list[str] | None:
    """All files of a folder, however deep; None if path isn't a folder. A URI's files are URIs."""
    held, at = system(path)
    if held.get_file_info(at).type != fs.FileType.Directory:
        return None
    found = [i.path for i in held.get_file_info(fs.FileSelector(at, recursive=True)) if i.type == fs.FileType.File]
    if "://" not in path:
        # as they were asked for, relative or not
        return [os.path.join(path, os.path.relpath(p, at)) for p in found]
    return [f"{path.rstrip('/')}/{p[len(at.rstrip('/')) + 1 :]}" for p in found]


def open_file(path: str):
    """The file's bytes, to be read from any place."""
    held, at = system(path)
    return held.open_input_file(at)


def read_range(path: str, start: int, length: int) -> bytes:
    with open_file(path) as f:
        f.seek(start)
        return f.read(length)
