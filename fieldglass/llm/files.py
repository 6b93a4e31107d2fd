"""Binary files in the shared folder, written and read by executors.

A task writes under a name of its own attempt and returns the name; only names in the returned manifest are ever
read, so a lost executor or a repeated attempt leaves nothing but an unread file.
"""

from __future__ import annotations

import uuid


def write_file(folder: str, name: str, parts) -> str:
    """Write the byte strings as one file of the folder (a URI) and return its path."""
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    path = f"{root}/{name}-{uuid.uuid4().hex}"
    with store.open_output_stream(path) as out:
        for p in parts:
            out.write(p)
    return path


def read_file(folder: str, path: str) -> bytes:
    from pyarrow import fs

    store, _ = fs.FileSystem.from_uri(folder)
    with store.open_input_stream(path) as f:
        return f.read()
