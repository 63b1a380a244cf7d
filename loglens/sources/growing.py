"""A streaming source of lines from files that grow and rotate.

A file is known by what it holds, not by its name: by its first bytes and by the bytes in front of the place read up to. So a
renamed file is read on where it was left, under whatever name; a file that was copied and then cut is followed in its copy;
and a file that begins anew, shorter or with other bytes, is read from its start. Offsets (first bytes, place, last bytes)
are the query's own, kept by Spark in its checkpoint. What was added is split into byte ranges, one task each.
"""

from __future__ import annotations

import fnmatch
import io
import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

NAME = "growing_lines"
SCHEMA = "value binary, log_source string"
HEAD, MARK = 256, 64
RANGE = 32 << 20
_PACKED = (".gz", ".bz2", ".xz", ".zst")
_ROWS = 50_000


def _open(directory: str) -> tuple[fs.FileSystem, str, str]:
    """(file system, path, what stands in front of a path in its URI)."""
    if directory.startswith("/") or directory.startswith("file:"):
        path = "/" + re.sub(r"^file:", "", directory).lstrip("/")
        return fs.LocalFileSystem(), path, "file://"
    store, path = fs.FileSystem.from_uri(directory)
    return store, path, directory[: directory.index(path)] if path in directory else directory.split("://")[0] + "://"


def _bytes(store: fs.FileSystem, path: str, start: int, stop: int) -> bytes:
    with store.open_input_file(path) as file:
        file.seek(start)
        return file.read(max(0, stop - start))


def _last_line_end(store: fs.FileSystem, path: str, size: int) -> int:
    """Behind the last line end; 0 without one."""
    stop, step = size, 1 << 16
    while stop > 0:
        start = max(0, stop - step)
        at = _bytes(store, path, start, stop).rfind(b"\n")
        if at >= 0:
            return start + at + 1
        stop, step = start, step * 4
    return 0


def listed(store: fs.FileSystem, directory: str, pattern: str) -> list[fs.FileInfo]:
    """The files below a directory, by name; those behind a name that begins with "_" or ".", and packed ones, are left out."""
    found = store.get_file_info(fs.FileSelector(directory, recursive=True, allow_not_found=True))

    def is_log(info: fs.FileInfo) -> bool:
        hidden = any(part[:1] in "_." for part in info.path[len(directory) :].split("/") if part)
        return info.is_file and not hidden and fnmatch.fnmatch(info.base_name, pattern) and not info.base_name.endswith(_PACKED)

    return sorted((i for i in found if is_log(i)), key=lambda i: i.path)


def _continues(store: fs.FileSystem, path: str, size: int, head: bytes, known: dict) -> bool:
    """Whether a file begins like a known one and has its bytes in front of the place that was read up to."""
    known_head, mark = bytes.fromhex(known["head"]), bytes.fromhex(known["mark"])
    if size < known["end"] or not head.startswith(known_head):
        return False
    return _bytes(store, path, known["end"] - len(mark), known["end"]) == mark


class Snapshot:
    """The files as they are now: for each different content the place behind its last whole line, and where it is found."""

    def __init__(self, directory: str, pattern: str):
        self.directory, self.pattern = directory, pattern
        self.kept: dict[tuple, dict] = {}

    def take(self) -> dict:
        store, root, _ = _open(self.directory)
        entries, kept = [], {}
        for info in listed(store, root, self.pattern):
            key = (info.path, info.size, info.mtime_ns)
            try:
                entry = self.kept.get(key) or self._entry(store, info)
            except FileNotFoundError:  # renamed just now; the next snapshot has it
                continue
            kept[key] = entry
            if entry["end"]:
                entries.append(dict(entry))
        self.kept = kept
        # Of files where one is the beginning of the other the longer one counts: a copy being made, or just made.
        whole: list[dict] = []
        for entry in sorted(entries, key=lambda e: (-e["end"], e["path"])):
            if not any(self._begins(store, entry, other) for other in whole):
                whole.append(entry)
        return {e["path"]: {k: e[k] for k in ("head", "end", "mark")} for e in sorted(whole, key=lambda e: e["path"])}

    def _entry(self, store: fs.FileSystem, info: fs.FileInfo) -> dict:
        end = _last_line_end(store, info.path, info.size)
        return {
            "path": info.path, "end": end, "head": _bytes(store, info.path, 0, min(HEAD, end)).hex(),
            "mark": _bytes(store, info.path, max(0, end - MARK), end).hex(),
        }

    @staticmethod
    def _begins(store: fs.FileSystem, entry: dict, longer: dict) -> bool:
        try:
            return _continues(store, longer["path"], longer["end"], bytes.fromhex(longer["head"]), entry)
        except FileNotFoundError:
            return False


class Range(InputPartition):
    def __init__(self, path: str, head: str, first: int, start: int, stop: int):
        self.path, self.head, self.first, self.start, self.stop = path, head, first, start, stop


class GrowingLinesReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.directory, self.pattern = options["path"], options.get("pattern", "*")
        self.range = int(options.get("rangeBytes", RANGE))
        self.snapshot = Snapshot(self.directory, self.pattern)

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return self.snapshot.take()

    def partitions(self, start: dict, end: dict) -> list[Range]:
        """What ``end`` holds beyond ``start``, whatever the files are called by now."""
        store, _, _ = _open(self.directory)
        out = []
        free = dict(start)
        # A file under its old name is looked at first, so that it is not taken for another that begins alike.
        for path in sorted(end, key=lambda p: (p not in start, p)):
            entry, first = end[path], 0
            names = [path] * (path in free) + [p for p in free if p != path]
            for name in names:
                known = free[name]
                if not bytes.fromhex(entry["head"]).startswith(bytes.fromhex(known["head"])) or entry["end"] < known["end"]:
                    continue
                if entry["end"] == known["end"] and entry["mark"] != known["mark"]:
                    continue
                if entry["end"] > known["end"] and not self._holds(store, path, entry, known):
                    continue
                first = known["end"]
                del free[name]
                break
            for at in range(first, entry["end"], self.range):
                out.append(Range(path, entry["head"], first, at, min(at + self.range, entry["end"])))
        return out

    def _holds(self, store: fs.FileSystem, path: str, entry: dict, known: dict) -> bool:
        found = find(store, self.directory, self.pattern, path, entry["head"], entry["end"])
        return _continues(store, found, entry["end"], bytes.fromhex(entry["head"]), known)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        store, _, prefix = _open(self.directory)
        path = find(store, self.directory, self.pattern, partition.path, partition.head, partition.stop)
        with store.open_input_file(path) as raw:
            raw.seek(max(partition.start - 1, partition.first))
            lines = io.BufferedReader(raw, 1 << 20)
            at = max(partition.start - 1, partition.first)
            if partition.start > partition.first:  # the line that reaches into this range belongs to the one before
                at += len(lines.readline())
            held: list[bytes] = []
            while at < partition.stop:
                line = lines.readline()
                if not line:
                    raise EOFError(f"{path} ended at {at}, before {partition.stop}")
                at += len(line)
                held.append(line.rstrip(b"\r\n"))
                if len(held) >= _ROWS:
                    yield self._batch(held, prefix + partition.path)
                    held = []
            if held:
                yield self._batch(held, prefix + partition.path)

    @staticmethod
    def _batch(held: list[bytes], source: str) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(held, pa.binary()), pa.array([source] * len(held), pa.string())], names=["value", "log_source"]
        )

    def commit(self, end: dict) -> None:
        pass

    def stop(self) -> None:
        pass


def find(store: fs.FileSystem, directory: str, pattern: str, path: str, head: str, size: int) -> str:
    """Where the content that began with ``head`` is now: under its path, or under another after a rotation."""
    wanted = bytes.fromhex(head)

    def has(name: str, length: int) -> bool:
        return length >= size and _bytes(store, name, 0, len(wanted)) == wanted

    info = store.get_file_info(path)
    if info.is_file and has(path, info.size):
        return path
    _, root, _ = _open(directory)
    for other in listed(store, root, pattern):
        if has(other.path, other.size):
            return other.path
    raise FileNotFoundError(f"{path} was removed before it was read")


class GrowingLines(DataSource):
    """Options: path (a directory or its URI), pattern (of file names), rangeBytes (of one task)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> GrowingLinesReader:
        return GrowingLinesReader(dict(self.options))
