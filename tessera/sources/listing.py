"""A data source that lists files with hidden names, links and nanosecond times, which Spark's own file sources leave out.

    spark.dataSource.register(ListingSource)
    spark.read.format("listing").option("path", root).option("stamp", "hash").load()

Columns: path, relative, size, mtime_ns, stamp. stamp 'hash' is the SHA-256 of the bytes, read in chunks; 'time' is
`<mtime_ns>:<size>`; 'none' is NULL. Each folder directly below the literal start of the pattern is a partition. Links are
followed; a folder that is its own ancestor through links is listed once. A missing root has no files. Option 'shape', a JSON list with
an entry per part of a pattern (its text, null for any name, [] for any folders), prunes the walk: literal parts are joined without listing. It reads the
executors' own file system, so the root must be a path that all of them mount; for object stores use sources.objects.
"""

from __future__ import annotations

import hashlib
import json
import os
import threading
import time
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, relative string, size long, mtime_ns long, stamp string"
CHUNK = 1 << 20


def hash_file(path: str) -> str:
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while chunk := f.read(CHUNK):
            h.update(chunk)
    return h.hexdigest()


def stamp_of(path: str, mode: str) -> str | None:
    """None for a missing file; an error for what isn't a regular file."""
    if mode not in ("hash", "time", "none"):
        raise ValueError(f"stamp mode '{mode}' isn't hash, time or none")
    try:
        st = os.stat(path)
    except (FileNotFoundError, NotADirectoryError):
        return None
    if not os.path.isfile(path):
        raise ValueError(f"{path} isn't a regular file")
    return hash_file(path) if mode == "hash" else f"{st.st_mtime_ns}:{st.st_size}" if mode == "time" else None


class StampCache:
    """Hash stamps of this process, kept while a file's identity, size and times stay. A file that was changed less than `racy_ns` ago isn't
    kept: it may change again without another time. Threads that ask for one path at once read it once."""

    def __init__(self, racy_ns: int = 2_000_000_000) -> None:
        self.racy_ns = racy_ns
        self._kept: dict[str, tuple[tuple, str]] = {}
        self._locks: dict[str, threading.Lock] = {}
        self._lock = threading.Lock()

    def stamp(self, path: str) -> str | None:
        with self._lock:
            own = self._locks.setdefault(path, threading.Lock())
        with own:
            try:
                st = os.stat(path)
            except (FileNotFoundError, NotADirectoryError):
                return None
            mark = (st.st_dev, st.st_ino, st.st_size, st.st_mtime_ns, st.st_ctime_ns)
            kept = self._kept.get(path)
            if kept and kept[0] == mark:
                return kept[1]
            now = time.time_ns()
            got = stamp_of(path, "hash")
            if got is not None and now - max(st.st_mtime_ns, st.st_ctime_ns) >= self.racy_ns:
                self._kept[path] = (mark, got)
            return got


def read_file(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def walk_shape(folder: str, shape: list, seen: frozenset[tuple[int, int]] = frozenset()) -> Iterator[str]:
    """Files whose path below the folder has the shape: a text is one name, None any name, [] any folders (and all that is below them)."""
    if not shape:
        return
    if shape[0] == []:
        yield from walk(folder, seen)
        return
    try:
        st = os.stat(folder)
        if (st.st_dev, st.st_ino) in seen:
            return
        names = [shape[0]] if shape[0] is not None else sorted(os.listdir(folder))
    except (FileNotFoundError, NotADirectoryError):
        return
    seen = seen | {(st.st_dev, st.st_ino)}
    for name in names:
        path = os.path.join(folder, name)
        if len(shape) > 1:
            if os.path.isdir(path):
                yield from walk_shape(path, shape[1:], seen)
        elif os.path.isfile(path):
            yield path


def walk(folder: str, seen: frozenset[tuple[int, int]] = frozenset()) -> Iterator[str]:
    """Files at any depth, by name; broken links and what isn't a regular file are left out."""
    try:
        st = os.stat(folder)
        names = sorted(os.listdir(folder))
    except (FileNotFoundError, NotADirectoryError):
        return
    if (st.st_dev, st.st_ino) in seen:
        return
    seen = seen | {(st.st_dev, st.st_ino)}
    for name in names:
        path = os.path.join(folder, name)
        if os.path.isdir(path):
            yield from walk(path, seen)
        elif os.path.isfile(path):
            yield path


@dataclass
class Folder(InputPartition):
    path: str
    deep: bool


class ListingReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.root = options["path"].removeprefix("file://").rstrip("/") or "/"
        self.mode = options.get("stamp", "none")
        if self.mode not in ("hash", "time", "none"):
            raise ValueError(f"stamp mode '{self.mode}' isn't hash, time or none")
        # a literal start of a pattern prunes the walk
        self.start = os.path.join(self.root, options.get("start", "").strip("/")).rstrip("/") or "/"
        #: Of the parts below the start; any folders, if not given.
        self.shape = json.loads(options.get("shape", "[[]]"))

    def partitions(self) -> list[Folder]:
        if os.path.isfile(self.start):
            raise ValueError(f"{self.start} is a file, not a folder")
        try:
            names = sorted(os.listdir(self.start))
        except FileNotFoundError:
            return [Folder("", False)]
        if self.shape and self.shape[0] not in (None, []):
            names = [n for n in names if n == self.shape[0]]
        if len(self.shape) == 1 and self.shape[0] != []:
            names = []
        below = [os.path.join(self.start, n) for n in names]
        return [Folder(self.start, False), *(Folder(p, True) for p in below if os.path.isdir(p))]

    def read(self, partition: Folder) -> Iterator[tuple]:
        if not partition.path:
            return
        top = os.stat(self.start)
        if partition.deep:
            paths = walk_shape(partition.path, self.shape if self.shape[0] == [] else self.shape[1:], frozenset({(top.st_dev, top.st_ino)}))
        elif self.shape[0] != []:
            paths = walk_shape(partition.path, self.shape) if len(self.shape) == 1 else iter(())
        else:
            paths = (p for n in sorted(os.listdir(partition.path)) if os.path.isfile(p := os.path.join(partition.path, n)))
        for path in paths:
            st = os.stat(path)
            yield path, os.path.relpath(path, self.root), st.st_size, st.st_mtime_ns, stamp_of(path, self.mode)


class ListingSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "listing"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ListingReader:
        return ListingReader(dict(self.options))
