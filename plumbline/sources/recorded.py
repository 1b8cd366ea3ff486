"""Server-sent events as a streaming source: recorded streams, also those that are still written to.

    spark.dataSource.register(RecordedEvents)
    spark.readStream.format("recorded_events").option("path", folder).load()

Each file of the folder is one recorded stream. An offset says, for each file, how many of its bytes
hold whole lines; it depends on the files alone, so a query that starts again from its checkpoint
reads each event once, and a batch that is read again is the same. A line counts once its end is
written. Tasks read stretches of about ``bytesPerPartition``, line by line.

Folders may be in any store that Arrow's file systems reach, by address, or local to one machine.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import Any

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from plumbline.sources.completions import parsed_event

EVENTS = "file string, at long, generated_text string, token_strings array<string>, logprobs map<int,array<struct<token:string,logp:double>>>, finish_reason string"
#: Bytes that are read at once when the end of a line is sought.
STEP = 1 << 16


def store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of an address, and the path in it."""
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def sizes(path: str) -> dict[str, int]:
    """The files of a folder, by name, and their bytes; hidden ones are left out. A folder that is not there yet has none."""
    where, folder = store(path)
    found = where.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    return {x.base_name: x.size for x in found if x.type == fs.FileType.File and not x.base_name.startswith(("_", "."))}


@dataclass
class Stretch(InputPartition):
    """The bytes of a file that a task reads."""

    file: str
    begin: int
    end: int


def line_end(path: str, name: str, begin: int, size: int) -> int:
    """Where the last line ends that ends within ``size``, after ``begin``; ``begin`` if none does."""
    where, folder = store(path)
    with where.open_input_file(f"{folder}/{name}") as f:
        at = size
        while at > begin:
            low = max(begin, at - STEP)
            f.seek(low)
            k = f.read(at - low).rfind(b"\n")
            if k >= 0:
                return low + k + 1
            at = low
    return begin


def whole_lines(path: str) -> dict[str, int]:
    """The bytes of each file that hold whole lines; files without any are left out."""
    found = {k: line_end(path, k, 0, n) for k, n in sorted(sizes(path).items())}
    return {k: n for k, n in found.items() if n}


def stretches(path: str, start: dict[str, int], end: dict[str, int], most: int) -> list[Stretch]:
    """What lies between two offsets, in stretches that end at line ends."""
    out = []
    for name, last in sorted(end.items()):
        at = start.get(name, 0)
        while at < last:
            cut = last if last - at <= most else line_end(path, name, at, at + most)
            if cut == at:  # a longer line goes with all that follows it
                cut = last
            out.append(Stretch(name, at, cut))
            at = cut
    return out


class _Reader:
    def __init__(self, path: str, most: int):
        self.path, self.most = path, most

    def read(self, stretch: Stretch) -> Iterator[tuple]:
        """The events of a stretch; comments, malformed lines and other lines are left out."""
        where, folder = store(self.path)
        at = stretch.begin
        with where.open_input_file(f"{folder}/{stretch.file}") as f:
            f.seek(at)
            rest = b""
            while at + len(rest) < stretch.end:
                lines = (rest + f.read(min(STEP, stretch.end - at - len(rest)))).split(b"\n")
                rest = lines.pop()
                for line in lines:
                    chunk = parsed_event(line.decode("utf-8", "replace").rstrip("\r"))
                    if chunk is not None:
                        tops = {k: [(x["token"], x["logp"]) for x in v] for k, v in chunk["logprobs"].items()}
                        yield stretch.file, at, chunk["generated_text"], list(chunk["token_strings"]), tops, chunk["finish_reason"]
                    at += len(line) + 1


class _StreamReader(_Reader, DataSourceStreamReader):
    def initialOffset(self) -> dict[str, int]:
        return {}

    def latestOffset(self) -> dict[str, int]:
        return whole_lines(self.path)

    def partitions(self, start: dict[str, int], end: dict[str, int]) -> Sequence[Stretch]:
        return stretches(self.path, start, end, self.most)

    def commit(self, end: dict[str, int]) -> None:
        """Nothing is kept for what was read."""


class _BatchReader(_Reader, DataSourceReader):
    def partitions(self) -> Sequence[Stretch]:
        return stretches(self.path, {}, whole_lines(self.path), self.most) or [Stretch("", 0, 0)]

    def read(self, stretch: Stretch) -> Iterator[tuple]:
        return super().read(stretch) if stretch.file else iter(())


class RecordedEvents(DataSource):
    """``file, at, generated_text, token_strings, logprobs, finish_reason`` of each event; ``at`` is the byte at which its line begins."""

    @classmethod
    def name(cls) -> str:
        return "recorded_events"

    def schema(self) -> str:
        return EVENTS

    def _path(self) -> str:
        if not self.options.get("path"):
            raise ValueError("recorded_events needs a path")
        return self.options["path"].rstrip("/")

    def _most(self) -> int:
        return max(1, int(self.options.get("bytesPerPartition", 64 << 20)))

    def streamReader(self, schema: Any) -> DataSourceStreamReader:
        return _StreamReader(self._path(), self._most())

    def reader(self, schema: Any) -> DataSourceReader:
        return _BatchReader(self._path(), self._most())
