"""Random access to files on any file system that pyarrow knows, for readers that Spark's own formats don't cover."""

from __future__ import annotations

from pyarrow import fs


def opened(path: str):
    where, name = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    return where.open_input_file(name)


def found(path: str, *suffixes: str) -> list[tuple[str, int]]:
    """(path, size) of one file, or of the files with a suffix below a folder."""
    where, name = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    info = where.get_file_info(name)
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    prefix = path[: len(path) - len(name)] if path.endswith(name) else ""
    return sorted((prefix + f.path, f.size) for f in where.get_file_info(fs.FileSelector(name, recursive=True)) if f.type == fs.FileType.File and f.path.lower().endswith(suffixes))
