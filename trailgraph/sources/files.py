"""Random access to files by a plain path or by the address of a store."""

from __future__ import annotations

import os
import re


def _local(path: str) -> str | None:
    """The path of a file on this machine or on a mount; None for other addresses."""
    if path.startswith("file:"):
        return re.sub("^file:/+", "/", path)
    return None if re.match("[a-z][a-z0-9+.-]+:", path) else path


def _store(path: str):
    """The store of an address, and the name in it."""
    from pyarrow import fs  # not needed, and not loaded, for files on a mount

    return fs.FileSystem.from_uri(path)


def opened(path: str):
    """A binary file that can seek."""
    local = _local(path)
    if local is not None:
        return open(local, "rb")
    store, name = _store(path)
    return store.open_input_file(name)


def size(path: str) -> int | None:
    """Bytes of a file; None where there is none."""
    local = _local(path)
    if local is not None:
        return os.path.getsize(local) if os.path.exists(local) else None
    store, name = _store(path)
    return store.get_file_info(name).size


def listed(path: str, ending: str) -> list[str]:
    """The files of a folder that end so, by name; a path that is a file stands for itself."""
    local = _local(path)
    if local is not None:
        return sorted(os.path.join(local, n) for n in os.listdir(local) if n.endswith(ending)) if os.path.isdir(local) else [path]
    from pyarrow import fs

    store, name = _store(path)
    if store.get_file_info(name).type != fs.FileType.Directory:
        return [path]
    found = store.get_file_info(fs.FileSelector(name))
    return sorted(f"{path.rstrip('/')}/{x.base_name}" for x in found if x.base_name.endswith(ending))


def write(path: str, data: bytes) -> None:
    """A new file, with the folders above it."""
    local = _local(path)
    if local is not None:
        os.makedirs(os.path.dirname(local), exist_ok=True)
        with open(local, "wb") as file:
            file.write(data)
        return
    store, name = _store(path)
    store.create_dir(name.rpartition("/")[0])
    with store.open_output_stream(name) as file:
        file.write(data)
