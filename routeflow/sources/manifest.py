"""A small JSON document with versions, in a folder that all writers share: whoever makes the next version's file first has won.

Every change reads the newest version, and makes the file of the next one in a single step that fails where it is there
already; then it is tried again on top of what the other writer did. Readers see whole versions only. It is usable without
a Spark session, so that the driver and a data source's own process can both write.
"""

from __future__ import annotations

import json
import os
import random
import time
import uuid
from collections.abc import Callable
from typing import Any

from pyarrow import fs

#: Versions that stay readable; a writer that needs longer than others need for so many changes would be lost.
KEPT = 1000

State = dict[str, Any]


def open_store(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + os.path.abspath(uri))


def put_once(store: fs.FileSystem, path: str, data: bytes) -> bool:
    """Makes a file with its whole content, unless there is one."""
    made = f"{path}.{uuid.uuid4().hex}.tmp"
    with store.open_output_stream(made) as out:
        out.write(data)
    try:
        if isinstance(store, fs.LocalFileSystem):
            os.link(made, path)  # fails where the name is taken; a rename would replace it
            return True
        if not isinstance(store, (fs.HadoopFileSystem, fs.SubTreeFileSystem)):
            raise ValueError(f"{store.type_name} can't rename without replacing; topics and routes need a store that can")
        if store.get_file_info(path).type != fs.FileType.NotFound:
            return False
        store.move(made, path)
        return True
    except FileExistsError:
        return False
    except OSError:
        if store.get_file_info(path).type != fs.FileType.NotFound:
            return False
        raise
    finally:
        if store.get_file_info(made).type != fs.FileType.NotFound:
            store.delete_file(made)


def delete(uri: str) -> None:
    """Deletes a folder, if it is there."""
    store, path = open_store(uri)
    if store.get_file_info(path).type == fs.FileType.Directory:
        store.delete_dir(path)


class Manifest:
    def __init__(self, uri: str):
        self.store, self.path = open_store(uri)

    def versions(self) -> list[int]:
        found = self.store.get_file_info(fs.FileSelector(self.path, allow_not_found=True))
        return sorted(int(f.base_name.removesuffix(".json")) for f in found if f.base_name.endswith(".json"))

    def read(self) -> tuple[int, State]:
        """The newest version and its number; an empty one, number 0, where nothing is there."""
        known = self.versions()
        if not known:
            return 0, {}
        with self.store.open_input_stream(self._file(known[-1])) as f:
            return known[-1], json.loads(f.read())

    def state(self) -> State:
        return self.read()[1]

    def update(self, change: Callable[[State], State | None]) -> State:
        """The state after ``change`` of the newest one, which may be called again if another writer was first. What it
        raises ends the update; None leaves all as it is."""
        for n in range(1000):
            version, old = self.read()
            new = change(json.loads(json.dumps(old)))
            if new is None:
                return old
            if not version:
                self.store.create_dir(self.path, recursive=True)
            if put_once(self.store, self._file(version + 1), json.dumps(new).encode()):
                for gone in [v for v in self.versions() if v <= version - KEPT][:10]:
                    self.store.delete_file(self._file(gone))
                return new
            time.sleep(random.random() * min(0.5, 0.01 * 2 ** min(n, 6)))
        raise TimeoutError(f"other writers kept changing {self.path}")

    def _file(self, version: int) -> str:
        return f"{self.path}/{version:020d}.json"
