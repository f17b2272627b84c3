"""Files in the shared folder, from the driver and from executors alike."""

from __future__ import annotations

from pyarrow import fs


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path in it; file:, hdfs:, s3: and gs: addresses and plain paths."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" in uri:
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), uri


def write_whole(uri: str, data: bytes) -> None:
    """Write a file under another name, then move it: readers see all of it or nothing."""
    import uuid

    store, path = opened(uri)
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    half = f"{path}.{uuid.uuid4().hex}.tmp"
    with store.open_output_stream(half) as out:
        out.write(data)
    store.move(half, path)


def listed(uri: str, hidden: bool = False) -> list[tuple[str, int]]:
    """Paths and sizes of the files below a folder, or of the file itself; names that begin with a dot or a line only if asked."""
    store, path = opened(uri)
    info = store.get_file_info(path)
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    found = store.get_file_info(fs.FileSelector(path, recursive=True))
    return sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and (hidden or not f.base_name.startswith((".", "_"))))
