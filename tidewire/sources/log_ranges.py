"""Log files read by ranges of bytes, and followed while they grow and are rotated."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow.fs import FileSelector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from tidewire.plans.storage import stage
from tidewire.sinks.raw import open_root, place_of, qualified
from tidewire.sources.logs import record_fields

RANGE_BYTES = 32 << 20
QUIET = 60.0
#: What tells one file from another that later has its name.
HEAD_BYTES = 128
#: What is read ahead for the end of a record: little at first, twice as much each time.
_AHEAD, _BLOCK = 1 << 10, 1 << 20
_BATCH_BYTES = 16 << 20
#: Ranges are many where they are short; a task reads so many bytes of them.
TASK_BYTES = 8 << 20

#: A record starts at a date in brackets at the start of a line (after any break Java knows).
_START = re.compile(rb"(?:\n|\r|\xc2\x85|\xe2\x80[\xa8\xa9])(?=\[\d{4}-\d{2}-\d{2})")
_DATE = re.compile(rb"\[\d{4}-\d{2}-\d{2}")
_LINE = re.compile(rb"\n")
_BRACKET = re.compile(rb"\]")
#: Bytes around a cut that a start may need: a break before it, a date after it.
_BEFORE, _AFTER = 3, 11
PIECES = "path string, record_no bigint, is_text boolean, piece binary"
_ARROW = pa.schema([("path", pa.string()), ("record_no", pa.int64()), ("is_text", pa.bool_()), ("piece", pa.binary())])


class LogRange(InputPartition):
    """The records that start in ``[start, stop)`` of a file that ends at ``end``."""

    def __init__(self, path: str, start: int, stop: int, end: int):
        self.path, self.start, self.stop, self.end = path, start, stop, end


class LogTask(InputPartition):
    """What one task reads: stretches of files, each in ranges of ``length`` bytes."""

    def __init__(self, stretches: list[LogRange], length: int):
        self.stretches, self.length = stretches, length


class _Window:
    """Bytes of an open file from a position on, as far as they were asked for."""

    def __init__(self, file, start: int, end: int):
        self.file, self.start, self.end = file, start, end
        self.data = bytearray()

    def reach(self, stop: int) -> None:
        have = self.start + len(self.data)
        stop = min(stop, self.end)
        if stop > have:
            self.file.seek(have)
            self.data += self.file.read(stop - have)

    def at_end(self) -> bool:
        return self.start + len(self.data) >= self.end

    def find(self, pattern: re.Pattern, position: int, overlap: int) -> re.Match | None:
        """The first match from a position on, reading on block by block."""
        at, ahead = position - self.start, _AHEAD
        while True:
            # near the edge of what was read a match may still be undecided
            match = pattern.search(self.data, at)
            if match or self.at_end():
                return match
            at = max(at, len(self.data) - overlap)
            self.reach(self.start + len(self.data) + min(ahead, _BLOCK))
            ahead *= 2


def _heads_a_record(window: _Window) -> bool:
    """Whether the start of a file could be a record though it has no date."""
    if not window.data.startswith(b"["):
        return False
    bracket = window.find(_BRACKET, 0, 0)
    return bool(bracket) and len(bytes(window.data[1 : bracket.start()]).split()) in (2, 3)


def pieces_of(file, part: LogRange) -> Iterator[tuple[int, bool, bytes]]:
    """``(place, is_text, bytes)`` of the text records and the possible JSON lines that start
    in a range. A record that goes on beyond the range is read on to its end; a range inside
    such a record has no start and gives nothing."""
    window = _Window(file, max(0, part.start - _BEFORE), part.end)
    window.reach(part.stop + _AFTER)
    base = window.start
    inner = part.stop - base
    starts = [m.end() for m in _START.finditer(window.data) if part.start - base <= m.end() < inner]
    if part.start == 0 and (_DATE.match(window.data) or _heads_a_record(window)):
        starts.insert(0, 0)
    for i, start in enumerate(starts):
        if i + 1 < len(starts):
            stop, last = starts[i + 1], False
        else:
            following = window.find(_START, base + start + 1, _BEFORE + _AFTER)
            stop, last = (following.end(), False) if following else (len(window.data), True)
        piece = bytes(window.data[start:stop])
        yield base + start, True, piece.rstrip(b"\n") if last else piece.removesuffix(b"\n")
    at = 0
    if part.start:
        # the line that the range cuts belongs to the range before
        broken = window.data.find(b"\n", part.start - base - 1)
        at = broken + 1 if broken >= 0 else inner
    while at < min(inner, len(window.data)):
        match = window.find(_LINE, base + at, 0)
        stop = match.start() if match else len(window.data)
        line = bytes(window.data[at:stop])
        if line.lstrip()[:1] in (b"{", b"[") and not _DATE.match(line):
            yield base + at, False, line
        at = stop + 1


class LogFolder:
    """The log files below a root, hidden ones left out."""

    def __init__(self, root: str):
        self.root = root

    def files(self) -> Iterator[tuple[str, int, float]]:
        """``(path, size, time of change)``"""
        fs, base = open_root(self.root)
        base = base.rstrip("/")
        for info in fs.get_file_info(FileSelector(base, recursive=True)):
            relative = info.path[len(base) + 1 :]
            if info.is_file and not any(name.startswith(("_", ".")) for name in relative.split("/")):
                yield relative, info.size, info.mtime_ns / 1e9

    def open(self, path: str):
        fs, base = open_root(self.root)
        return fs.open_input_file(f"{base.rstrip('/')}/{path}")

    def pieces(self, task: LogTask) -> Iterator[tuple[str, int, bool, bytes]]:
        for stretch in task.stretches:
            try:
                file = self.open(stretch.path)
            except FileNotFoundError:
                continue
            with file:
                for part in cut(stretch.path, stretch.start, stretch.stop, stretch.end, task.length):
                    for place, is_text, piece in pieces_of(file, part):
                        yield part.path, place, is_text, piece

    def read(self, task: LogTask) -> Iterator[pa.RecordBatch]:
        return batched(self.pieces(task))


def batched(rows: Iterator[tuple[str, int, bool, bytes]]) -> Iterator[pa.RecordBatch]:
    """Arrow batches of bounded size."""
    columns, size = ([], [], [], []), 0
    for row in rows:
        for column, value in zip(columns, row):
            column.append(value)
        size += len(row[3]) + 100
        if size >= _BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW)
            columns, size = ([], [], [], []), 0
    if size:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW)


def cut(path: str, start: int, stop: int, end: int, length: int) -> list[LogRange]:
    return [LogRange(path, at, min(at + length, stop), end) for at in range(start, stop, length)]


def dealt(stretches: Iterator[LogRange], length: int) -> list[LogTask]:
    """Tasks of about ``TASK_BYTES`` in ranges of ``length``: long stretches are cut between two
    ranges, short ones read together."""
    most = max(1, TASK_BYTES // length) * length
    tasks, now, size = [], [], 0
    for stretch in stretches:
        for part in cut(stretch.path, stretch.start, stretch.stop, stretch.end, most):
            if now and size + part.stop - part.start > most:
                tasks.append(LogTask(now, length))
                now, size = [], 0
            now.append(part)
            size += part.stop - part.start
    return [*tasks, LogTask(now, length)] if now else tasks


class LogReader(DataSourceReader):
    def __init__(self, folder: LogFolder, length: int):
        self.folder, self.length = folder, length

    def partitions(self) -> list[LogTask]:
        return dealt((LogRange(path, 0, size, size) for path, size, _ in sorted(self.folder.files())), self.length)

    def read(self, partition: LogTask | None) -> Iterator[pa.RecordBatch]:
        return self.folder.read(partition) if partition else iter(())


def _behind_last(file, size: int, pattern: re.Pattern, overlap: int) -> int:
    """The end of the last match in a file, looked for from its end, block by block; 0 if none."""
    stop, edge = size, b""
    while stop > 0:
        start = max(0, stop - _BLOCK)
        file.seek(start)
        block = file.read(stop - start) + edge
        last = None
        for last in pattern.finditer(block):
            pass
        if last:
            return start + last.end()
        edge, stop = block[:overlap], start
    return 0


def settled(file, size: int, head: bytes) -> int:
    """Up to where a growing file is sure: behind its last whole line if it begins as JSON, else
    before its last record, which may go on; whole lines again if it has no record yet."""
    if head.lstrip()[:1] == b"{":
        return _behind_last(file, size, _LINE, 0)
    start = _behind_last(file, size, _START, _BEFORE + _AFTER)
    return start if start or _DATE.match(head) else _behind_last(file, size, _LINE, 0)


class LogStreamReader(DataSourceStreamReader):
    """Offsets are ``{path: {to, size, head}}``: records that start before ``to`` are read."""

    def __init__(self, folder: LogFolder, length: int, quiet: float, now: Callable[[], float] = time.time):
        self.folder, self.length, self.quiet, self.now = folder, length, quiet, now
        self.known: dict[tuple, dict] = {}

    def initialOffset(self) -> dict:
        return {}

    def _place(self, path: str, size: int, changed: float) -> dict:
        closed = self.now() - changed >= self.quiet
        key = (path, size, changed, closed)
        if key not in self.known:
            with self.folder.open(path) as file:
                head = file.read(min(HEAD_BYTES, size))
                to = size if closed else settled(file, size, head)
            self.known[key] = {"to": to, "size": size, "head": head.decode("latin-1")}
        return self.known[key]

    def latestOffset(self) -> dict:
        self.known, before = {}, self.known
        out = {}
        for path, size, changed in self.folder.files():
            keys = [k for k in ((path, size, changed, True), (path, size, changed, False)) if k in before]
            self.known |= {k: before[k] for k in keys}
            try:
                place = self._place(path, size, changed)
            except FileNotFoundError:  # moved since it was listed
                continue
            if place["to"]:
                out[path] = place
        return out

    def partitions(self, start: dict, end: dict) -> list[LogTask]:
        """What was added to each file, under whatever name it has now: a file goes on where the
        one with its beginning was left, first that of its own name, then one that was moved."""

        def same(old: dict, new: dict) -> bool:
            return new["head"].startswith(old["head"]) and new["size"] >= old["to"]

        moved = {p: old for p, old in start.items() if p not in end or not same(old, end[p])}
        out = []
        for path, new in sorted(end.items()):
            old = start.get(path)
            if old is None or not same(old, new):
                source = next((p for p, o in sorted(moved.items()) if same(o, new)), None)
                old = moved.pop(source) if source else None
            begun = old["to"] if old else 0
            if begun < new["to"]:
                out.append(LogRange(path, begun, new["to"], new["size"]))
        return dealt(out, self.length)

    def read(self, partition: LogTask) -> Iterator[pa.RecordBatch]:
        return self.folder.read(partition)


def _is_record(piece: bytes) -> bool:
    """Whether a piece has the form of a text record: what ``record_fields`` asks of it."""
    text = piece.decode(errors="replace")
    bracket = text.find("]")
    stamp = re.split(r"[ \t\n\x0b\f\r]+", text[1 : max(bracket, 1)].strip(" "))
    if not text.startswith("[") or bracket < 1 or len(stamp) != 3 or text[bracket + 1 :].lstrip(" ").find(":") < 1:
        return False
    return "." in stamp[1] and stamp[2] == stamp[2].upper() != stamp[2].lower()


def _lines(file, size: int) -> Iterator[bytes]:
    file.seek(0)
    rest = b""
    for at in range(0, size, _BLOCK):
        *lines, rest = (rest + file.read(min(_BLOCK, size - at))).split(b"\n")
        yield from lines
    yield rest


def whole_file(file, path: str, size: int, length: int = RANGE_BYTES) -> Iterator[tuple[str, int, bool, bytes]]:
    """``(path, record_no, is_text, piece)`` of a file, in order and a range at a time: its text
    records or, where it has none, the lines that can be JSON, numbered among all lines."""
    number = 0
    for part in cut(path, 0, size, size, length):
        for _, is_text, piece in pieces_of(file, part):
            if is_text and _is_record(piece):
                yield path, number, True, piece
                number += 1
    if not number:
        for k, line in enumerate(_lines(file, size)):
            if line.lstrip()[:1] in (b"{", b"["):
                yield path, k, False, line


def read_whole_files(files: DataFrame) -> DataFrame:
    """Pieces (``path, record_no, is_text, piece``) of log files (``place, path, size``), opened at
    their place in the tasks; a task holds one range of one file."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, bool, bytes]]:
        for batch in batches:
            for place, path, size in zip(*(c.to_pylist() for c in batch.columns)):
                fs, name = place_of(place)
                with fs.open_input_file(name) as file:
                    yield from whole_file(file, path, size, TASK_BYTES)

    pieces = files.select("place", "path", "size").mapInArrow(lambda batches: batched(rows(batches)), PIECES)
    return pieces.withColumn("piece", F.col("piece").cast("string"))


class LogSource(DataSource):
    """Format ``tidewire_logs``: pieces of the log files below ``path``, in ranges of ``rangeBytes``."""

    @classmethod
    def name(cls) -> str:
        return "tidewire_logs"

    def schema(self) -> str:
        return PIECES

    def _length(self) -> int:
        return int(self.options.get("rangeBytes", RANGE_BYTES))

    def reader(self, schema) -> LogReader:
        return LogReader(LogFolder(self.options["path"]), self._length())

    def streamReader(self, schema) -> LogStreamReader:
        return LogStreamReader(LogFolder(self.options["path"]), self._length(), float(self.options.get("quiet", QUIET)))


def _parsed(pieces: DataFrame) -> DataFrame:
    piece = F.col("piece").cast("string")
    return record_fields(pieces.select("path", "record_no", "is_text", piece.alias("piece")), "is_text")


def _source(reader, root: str, range_bytes: int, **options) -> DataFrame:
    spark = reader._spark
    spark.dataSource.register(LogSource)
    return reader.format(LogSource.name()).options(rangeBytes=str(range_bytes), **options).load(qualified(spark, root))


def json_only_without_text(records: DataFrame, texts: DataFrame) -> DataFrame:
    """Text records, and the JSON lines of files (``path``) that have no text record."""
    lines = records.filter(~F.col("is_text")).join(texts, "path", "left_anti")
    return records.filter("is_text").unionByName(lines).drop("is_text")


def read_log_ranges(spark: SparkSession, root: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The records of read_logs, but no file is one cell or one task: a file is cut into ranges of
    bytes, and ``record_no`` is a record's place in bytes, ``path`` its place below the root.
    Parses once, into the shared folder, because whether JSON lines count is decided by the
    whole file. Starts a job when called."""
    records = stage(_parsed(_source(spark.read, root, range_bytes)), "log-records")
    return json_only_without_text(records, records.filter("is_text").select("path").distinct())


def follow_logs(spark: SparkSession, root: str, range_bytes: int = RANGE_BYTES, quiet: float = QUIET) -> DataFrame:
    """Stream of the records that are added to log files, each once, also when a file is renamed,
    replaced or cut back between two polls. What is new is read by ranges.

    The last record of a file waits until another one starts or the file was quiet for ``quiet``
    seconds; a record that goes on after that is given again, whole. JSON lines count as
    they come, also in a file where a text record is written later. Files are told apart by
    their first 128 bytes: one that begins the same and is no shorter counts as the same."""
    return _parsed(_source(spark.readStream, root, range_bytes, quiet=str(quiet))).drop("is_text")
