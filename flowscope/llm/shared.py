"""Arrays in the shared folder: written by tasks, memory-mapped by workers."""

from __future__ import annotations

import os
import tempfile
import uuid

import numpy as np
import pyarrow.fs as pafs


def put(folder: str, *arrays: np.ndarray) -> str:
    """Write the arrays one after the other; the name is new, so another attempt of a task harms nothing."""
    store, base = pafs.FileSystem.from_uri(folder)
    store.create_dir(base, recursive=True)
    name = uuid.uuid4().hex
    with store.open_output_stream(f"{base}/{name}") as out:
        for array in arrays:
            out.write(np.ascontiguousarray(array).tobytes())
    return name


def mapped(folder: str, name: str) -> np.ndarray:
    """The file's bytes, memory-mapped. A folder that is no mounted one is copied to the worker's own first."""
    store, base = pafs.FileSystem.from_uri(folder)
    path = f"{base}/{name}"
    if not isinstance(store, pafs.LocalFileSystem):
        own = os.path.join(tempfile.gettempdir(), name)
        if not os.path.exists(own):
            pafs.copy_files(path, f"{own}.{os.getpid()}", source_filesystem=store)
            os.replace(f"{own}.{os.getpid()}", own)
        path = own
    if not os.path.getsize(path):
        return np.zeros(0, np.uint8)
    return np.memmap(path, np.uint8, "r")
