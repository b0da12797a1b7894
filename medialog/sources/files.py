"""The file system behind an address, for work outside Spark's own readers."""

from __future__ import annotations

from urllib.parse import quote

# Spark's names of object stores and those of the file system library.
SCHEMES = {"s3a": "s3", "s3n": "s3", "wasbs": "abfss"}


def file_system(path: str):
    """File system and name in it of an address or a plain local path.

    Spark names files by unescaped path; an address wants it escaped.
    """
    from pyarrow import fs

    scheme, found, rest = path.partition(":")
    if not found or "/" in scheme:
        return fs.LocalFileSystem(), path
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}:{quote(rest)}")


def remove_folder(path: str) -> None:
    """Delete a folder if it is there."""
    from pyarrow.fs import FileType

    system, name = file_system(path)
    if system.get_file_info(name).type == FileType.Directory:
        system.delete_dir(name)


def subfolders(path: str) -> list[str]:
    """Names of the folders in a folder."""
    from pyarrow.fs import FileSelector, FileType

    system, name = file_system(path)
    return sorted(f.base_name for f in system.get_file_info(FileSelector(name, allow_not_found=True)) if f.type == FileType.Directory)


def is_file(path: str) -> bool:
    from pyarrow.fs import FileType

    system, name = file_system(path)
    return system.get_file_info(name).type == FileType.File
