"""A streaming source that follows growing log files.

Spark's file stream reads each file once, by path, so lines appended later are lost. This
source keeps, per file, the byte position behind the last complete line. The positions are
the stream's offsets and live in the checkpoint, so a restart goes on where it stopped.

Only new bytes are read, on the executors, in ranges of ``maxPartitionBytes``: one large
file becomes many tasks. Paths must be reachable from driver and executors.

Which file is which: local files are known by inode, others by path, and either by a
fingerprint of their first bytes, which also goes into the offset. So a renamed file keeps its
position, while a new file on an old inode, or one truncated and written again, starts at 0. A
reader looks at both again after it has opened a file. Where the name now belongs to another file,
as after a rotation between planning and reading, it finds the file by its inode in the same
folder; where the file is gone it fails, unless ``failOnDataLoss`` is false.

A file that one listing misses keeps its position in the offsets, so it is not read again when it
comes back. A restarted query only knows such files from the folder ``positions``, where every
planned batch notes them; without the option that memory ends with the process. A file not seen for
``forgetAfterSeconds`` is forgotten.
"""

from __future__ import annotations

import hashlib
import json
import os
import time
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

_BLOCK = 1 << 20
# Lengths of the first bytes that make up a fingerprint; those a file does not have yet are left out.
_HEADS = (1, 2, 4, 8, 16, 64, 256)


@dataclass
class ByteRange(InputPartition):
    path: str
    start: int
    end: int
    key: str = ""
    heads: tuple = ()


def _open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path:
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), os.path.abspath(path)


def _key(filesystem: pafs.FileSystem, path: str) -> str:
    """What a file is known by: its inode, or its path on other file systems. The device is
    left out, since one mount may have several numbers on several machines."""
    if isinstance(filesystem, pafs.LocalFileSystem):
        return f"inode:{os.stat(path).st_ino}"
    return path


def _heads(raw, known: int) -> tuple[str, ...]:
    """Digests of the first bytes, of as many lengths as ``known`` bytes allow."""
    lengths = [n for n in _HEADS if n <= known]
    if not lengths:
        return ()
    raw.seek(0)
    data = raw.read(lengths[-1])
    return tuple(hashlib.sha256(data[:n]).hexdigest()[:12] for n in lengths)


def _same(before: dict, now: dict) -> bool:
    """Whether an entry continues another of the same key: no shorter, and with the same first bytes."""
    return now["end"] >= before["end"] and all(a == b for a, b in zip(before["heads"], now["heads"]))


def _last_line_end(raw, size: int, floor: int) -> int:
    """Position behind the last newline in [floor, size), or ``floor``; reads backwards."""
    end = size
    while end > floor:
        begin = max(floor, end - _BLOCK)
        raw.seek(begin)
        at = raw.read(end - begin).rfind(b"\n")
        if at >= 0:
            return begin + at + 1
        end = begin
    return floor


class _TailReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        # Option names come in lower case from Spark.
        get = lambda name, default: options.get(name, options.get(name.lower(), default))
        self.roots = [p for p in get("paths", "").split(",") if p]
        self.from_end = get("startingPosition", "start").lower() == "end"
        self.piece = int(get("maxPartitionBytes", 64 << 20))
        self.strict = get("failOnDataLoss", "true").lower() != "false"
        self.positions = get("positions", None)
        self.forget_after = float(get("forgetAfterSeconds", 7 * 86_400))
        # Last entry and size of every file, and when it was seen last.
        self._known: dict[str, dict] = {}
        self._seen: dict[str, float] = {}
        self._load()

    # --- files that a listing may miss ------------------------------------------------

    def _load(self) -> None:
        if not self.positions:
            return
        filesystem, path = _open_fs(self.positions)
        try:
            with filesystem.open_input_file(f"{path}/positions.json") as f:
                told = json.loads(f.read())
        except FileNotFoundError:
            return
        self._known = {k: {**e, "size": e["end"]} for k, e in told["files"].items()}
        self._seen = told["seen"]

    def _note(self) -> None:
        if not self.positions:
            return
        filesystem, path = _open_fs(self.positions)
        filesystem.create_dir(path, recursive=True)
        files = {k: {n: e[n] for n in ("path", "end", "heads", "from")} for k, e in self._known.items()}
        with filesystem.open_output_stream(f"{path}/.positions.json") as f:
            f.write(json.dumps({"files": files, "seen": self._seen}).encode())
        filesystem.move(f"{path}/.positions.json", f"{path}/positions.json")

    # --- offsets ----------------------------------------------------------------------

    def _files(self, named_only: bool = False) -> list[tuple[pafs.FileSystem, str, str, int]]:
        """(filesystem, path, key, size); folders are listed one level deep."""
        found = []
        for root in self.roots:
            filesystem, path = _open_fs(root)
            info = filesystem.get_file_info(path)
            if info.type == pafs.FileType.Directory:
                infos = [] if named_only else filesystem.get_file_info(pafs.FileSelector(path))
                # As in batch scans, names that start with a dot or underscore are hidden.
                infos = [i for i in infos if not i.base_name.startswith((".", "_"))]
            else:
                infos = [info]
            for i in infos:
                if i.type == pafs.FileType.File:
                    try:
                        found.append((filesystem, i.path, _key(filesystem, i.path), i.size))
                    except FileNotFoundError:
                        continue  # gone since it was listed; the next listing tells
        return found

    def _entry(self, filesystem, path: str, key: str, size: int) -> dict:
        """Path, end and fingerprint of a file, from what was known of it."""
        before = self._known.get(key)
        with filesystem.open_input_file(path) as raw:
            if before and size >= before["end"] and _heads(raw, before["end"]) == tuple(before["heads"]):
                start, first = before["end"], before["from"]
            else:
                start = first = 0
            end = _last_line_end(raw, size, start) if size > start else start
            heads = before["heads"] if before and first and end == start else list(_heads(raw, end))
        return {"path": path, "end": end, "heads": heads, "from": first, "size": size}

    def _ends(self, files) -> dict[str, dict]:
        now = time.time()
        for filesystem, path, key, size in files:
            self._seen[key] = now
            before = self._known.get(key)
            if before and before["size"] == size and before["path"] == path and size == before["end"]:
                continue  # neither grown nor renamed
            try:
                self._known[key] = self._entry(filesystem, path, key, size)
            except FileNotFoundError:
                continue
        for key in [k for k in self._known if now - self._seen.get(k, now) > self.forget_after]:
            del self._known[key]
        # Also files that this listing missed: their entries stay as they were.
        return {k: {n: e[n] for n in ("path", "end", "heads", "from")} for k, e in sorted(self._known.items())}

    def initialOffset(self) -> dict:
        # Files named one by one may start at their end; files found in folders start at 0.
        if not self.from_end:
            return {}
        return self._ends(self._files(named_only=True))

    def latestOffset(self) -> dict:
        return self._ends(self._files())

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        ranges = []
        for key, entry in end.items():
            before = start.get(key)
            # An entry that the last batch did not have begins where the file was left then.
            begin = entry["from"] if before is None else before["end"] if _same(before, entry) else 0
            for at in range(begin, entry["end"], self.piece):
                stop = min(at + self.piece, entry["end"])
                ranges.append(ByteRange(entry["path"], at if at == begin else -at, stop, key, tuple(entry["heads"])))
        # What is planned here is in the checkpoint, so it may be noted as the position reached.
        for key, entry in {**start, **end}.items():
            known = self._known.setdefault(key, {**entry, "size": entry["end"]})
            if known["end"] == entry["end"]:
                known["from"] = entry["end"]
            self._seen.setdefault(key, time.time())
        self._note()
        return ranges or [ByteRange("", 0, 0)]

    # --- reading ----------------------------------------------------------------------

    def _is(self, filesystem, raw, path: str, part: ByteRange) -> bool:
        if isinstance(filesystem, pafs.LocalFileSystem) and part.key and f"inode:{os.fstat(raw.fileno()).st_ino}" != part.key:
            return False
        return not part.heads or _heads(raw, _HEADS[len(part.heads) - 1]) == part.heads

    def _open(self, part: ByteRange):
        """The file of the range, under whatever name it has now; None if it is gone."""
        filesystem, path = _open_fs(part.path)
        local = isinstance(filesystem, pafs.LocalFileSystem)
        names = [path]
        if local:
            folder = os.path.dirname(path)
            try:
                others = [e for e in os.scandir(folder) if e.is_file() and f"inode:{e.inode()}" == part.key]
            except FileNotFoundError:
                others = []
            names += [e.path for e in others if e.path != path]
        for name in names:
            try:
                raw = open(name, "rb") if local else filesystem.open_input_file(name)
            except FileNotFoundError:
                continue
            if self._is(filesystem, raw, name, part):
                return raw
            raw.close()
        if self.strict:
            raise FileNotFoundError(f"{part.path} is gone or another file; set failOnDataLoss to false to go on without it")
        return None

    def read(self, part: ByteRange) -> Iterator[pa.RecordBatch]:
        """Lines that begin in the range; the last one may reach past its end.

        A negative start marks a range cut inside a file: it begins behind the first
        newline, since the line over the cut belongs to the range before.
        """
        raw = self._open(part) if part.path else None
        if raw is None:
            return
        with raw:
            at = abs(part.start)
            if part.start < 0:
                at = _next_line(raw, at - 1)
            for lines in _line_blocks(raw, at, part.end):
                texts = (b.decode("utf-8", errors="replace").rstrip("\r") for b in lines)
                texts = [t for t in texts if t.strip()]
                if texts:
                    yield pa.record_batch(
                        [pa.array([part.path] * len(texts)), pa.array(texts)], ["path", "value"]
                    )

    def commit(self, end: dict) -> None:
        pass


def _next_line(raw, at: int) -> int:
    """Position behind the first newline at or after ``at``."""
    raw.seek(at)
    while True:
        block = raw.read(_BLOCK)
        if not block:
            return at
        hit = block.find(b"\n")
        if hit >= 0:
            return at + hit + 1
        at += len(block)


def _line_blocks(raw, at: int, end: int) -> Iterator[list[bytes]]:
    raw.seek(at)
    rest = b""
    while at < end:
        block = raw.read(_BLOCK)
        if not block:
            break
        lines = (rest + block).split(b"\n")
        rest = lines.pop()
        taken = 0
        for line in lines:
            if at >= end:
                break
            at += len(line) + 1
            taken += 1
        yield lines[:taken]


class TailSource(DataSource):
    """``format("log_tail")`` with options ``paths`` (comma separated), ``startingPosition``
    (start, end), ``maxPartitionBytes``, ``positions`` (a folder), ``forgetAfterSeconds`` and
    ``failOnDataLoss``."""

    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return "path string, value string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _TailReader(self.options)
