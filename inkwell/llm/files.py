"""Files in a folder that driver and executors share, written by tasks. Only files that a finished task has named count."""

from __future__ import annotations

import uuid


def place(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def new_file(folder: str, suffix: str) -> str:
    """A name that no other attempt of a task uses."""
    return f"{folder}/{uuid.uuid4().hex}{suffix}"


def open_output(uri: str):
    system, path = place(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    return system.open_output_stream(path, compression=None)  # else a name's ending would compress it again


def read_all(uri: str) -> bytes:
    system, path = place(uri)
    with system.open_input_stream(path, compression=None) as f:
        return f.read()
