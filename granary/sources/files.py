"""Byte access to files in any store that pyarrow opens, for tasks and data sources."""

from __future__ import annotations

from pyarrow.fs import FileInfo, FileSelector, FileSystem, FileType


def store(path: str) -> tuple[FileSystem, str]:
    """The file system of a path or URI, and the path there."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = path.replace("file:", "file://", 1)
    return FileSystem.from_uri(path if "://" in path else f"file://{path}")


def listed(path: str, suffixes: tuple[str, ...]) -> list[FileInfo]:
    """The files of a folder, at any depth, or the file itself, by name; hidden ones and those of writers left out."""
    fs, at = store(path)
    found = fs.get_file_info(at)
    if found.type == FileType.NotFound:
        raise FileNotFoundError(path)
    infos = [found] if found.is_file else fs.get_file_info(FileSelector(at, recursive=True))
    own = lambda i: i.path[len(at) :] if not found.is_file else ""
    return sorted((i for i in infos if i.is_file and i.path.endswith(suffixes) and not any(p[:1] in "._" for p in own(i).split("/") if p)), key=lambda i: i.path)
