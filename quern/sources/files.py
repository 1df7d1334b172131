"""Random access to files by path or address: local ones are mapped, those behind http(s) or a store that pyarrow knows are read in blocks. And downloads."""

from __future__ import annotations

import glob
import mmap
import os
import re
import urllib.request
from collections import OrderedDict
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

BLOCK, BLOCKS, TIMEOUT = 4 << 20, 8, 60


class Blocks:
    """Bytes of a remote file, by index, slice and find(), from blocks that are read as they are needed; the latest ones are kept."""

    def __init__(self, size: int, read: Callable[[int, int], bytes]) -> None:
        self.size, self.read, self.kept = size, read, OrderedDict()

    def __len__(self) -> int:
        return self.size

    def _block(self, k: int) -> bytes:
        if k not in self.kept:
            self.kept[k] = self.read(k * BLOCK, min(self.size, (k + 1) * BLOCK))
            if len(self.kept) > BLOCKS:
                self.kept.popitem(last=False)
        return self.kept[k]

    def __getitem__(self, at: int | slice) -> int | bytes:
        if isinstance(at, int):
            return self._block(at // BLOCK)[at % BLOCK]
        a, b, _ = at.indices(self.size)
        if a >= b:
            return b""
        out = b"".join(self._block(k) for k in range(a // BLOCK, (b - 1) // BLOCK + 1))
        return out[a % BLOCK : a % BLOCK + b - a]

    def find(self, what: bytes, a: int, b: int) -> int:
        while a < b:
            upto = min(b, (a // BLOCK + 1) * BLOCK + len(what) - 1)
            if (at := self[a:upto].find(what)) >= 0:
                return a + at
            a = max(a + 1, upto - len(what) + 1)
        return -1


def _http(address: str, a: int, b: int) -> bytes:
    with urllib.request.urlopen(urllib.request.Request(address, headers={"Range": f"bytes={a}-{b - 1}"}), timeout=TIMEOUT) as r:
        data = r.read()
    # a server that knows no ranges sends all of it
    return data[a:b] if r.status == 200 and len(data) != b - a else data


def _http_size(address: str) -> int:
    with urllib.request.urlopen(urllib.request.Request(address, method="HEAD"), timeout=TIMEOUT) as r:
        return int(r.headers["Content-Length"])


def _kind(path: str) -> str:
    scheme = path.partition("://")[0] if "://" in path else ""
    return "http" if scheme in ("http", "https") else "local" if scheme in ("", "file") or path.startswith("file:/") else "store"


def _local(path: str) -> str:
    return re.sub(r"^file:/+", "/", path)


@contextmanager
def opened(path: str) -> Iterator:
    """len(), index, slices and find() of a file's bytes."""
    kind = _kind(path)
    if kind == "local":
        with open(_local(path), "rb") as f, mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) as data:
            yield data
    elif kind == "http":
        yield Blocks(_http_size(path), lambda a, b: _http(path, a, b))
    else:
        import pyarrow.fs

        store, name = pyarrow.fs.FileSystem.from_uri(path)
        with store.open_input_file(name) as f:
            yield Blocks(f.size(), lambda a, b: f.read_at(b - a, a))


def listed(paths: str, suffix: str) -> list[tuple[str, int]]:
    """(path, size) of files named by a comma-separated list of paths, patterns, folders and addresses, in order of path."""
    out: dict[str, int] = {}
    for path in filter(None, paths.split(",")):
        kind = _kind(path)
        if kind == "http":
            out[path] = _http_size(path)
        elif kind == "local":
            path = _local(path)
            for p in glob.glob(f"{path}/*{suffix}") if os.path.isdir(path) else glob.glob(path):
                out[p] = os.path.getsize(p)
        else:
            import pyarrow.fs

            store, name = pyarrow.fs.FileSystem.from_uri(path)
            info = store.get_file_info(name)
            found = store.get_file_info(pyarrow.fs.FileSelector(name)) if info.type == pyarrow.fs.FileType.Directory else [info]
            root = path[: len(path) - len(name)]
            out |= {root + f.path: f.size for f in found if f.type == pyarrow.fs.FileType.File and (f.path.endswith(suffix) or f is info)}
    return sorted(out.items())


def download(address: str, folder: str, connections: int = 16) -> str:
    """Fetches a file into a folder in ranges, several at a time; it has the name .part until it is whole. One that is there already isn't fetched again. The path."""
    path = os.path.join(folder, address.rsplit("/", 1)[-1])
    if os.path.exists(path):
        return path
    os.makedirs(folder, exist_ok=True)
    size = _http_size(address)
    with open(f"{path}.part", "wb") as f:
        f.truncate(size)
    file = os.open(f"{path}.part", os.O_WRONLY)
    try:
        with ThreadPoolExecutor(connections) as pool:
            for _ in pool.map(lambda a: os.pwrite(file, _http(address, a, min(size, a + BLOCK)), a), range(0, size, BLOCK)):
                pass
    finally:
        os.close(file)
    os.replace(f"{path}.part", path)
    return path


def epoch_address(root: str, epoch: int) -> str:
    return f"{root.rstrip('/')}/{epoch}/epoch-{epoch}.car"
