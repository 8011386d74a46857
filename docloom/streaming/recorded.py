"""A stream of recorded response chunks: ``spark.readStream.format("chunks").load(folder)``.

A recording is a file of JSON lines, one for each piece of bytes that a response arrived
in: ``{"response": "id", "chunk": "base64"}``.  Files are written whole, under names that
grow; a folder is read in order of names.  An offset is the last file and the number of
its chunks that were read, so a batch is the same whenever it is read again, and a query
that is started again goes on behind the last batch.

Each chunk becomes (file, seq, response, data binary).  A chunk is what arrived at once, and
nothing is put together across chunks: one with half an object is an error for ``objects``,
and one with half an event or with two says nothing for ``events``.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..functions.text import utf8_strict
from ..sources.documents import file_system
from .chunks import event_chunk, object_chunk

SCHEMA = "file string, seq long, response string, data binary"


#: Bytes of recordings in a partition: at least, and at most but for one file more; between, a batch has about ``PARTS``.
LEAST_BYTES, MOST_BYTES, PARTS = 1 << 20, 16 << 20, 200


@dataclass
class Range:
    name: str
    start: int
    end: int | None


@dataclass
class Ranges(InputPartition):
    """Files that one task reads one after the other."""

    files: list[Range]


class RecordedChunks(DataSource):
    @classmethod
    def name(cls) -> str:
        return "chunks"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return ChunkReader(self.options["path"])


class ChunkReader(DataSourceStreamReader):
    def __init__(self, uri: str):
        self.uri = uri

    def _names(self) -> dict[str, int]:
        """The files in order of names, with their bytes."""
        store, root = file_system(self.uri)
        return dict(sorted((i.base_name, i.size or 0) for i in store.get_file_info(fs.FileSelector(root)) if i.type == fs.FileType.File and not i.base_name.startswith((".", "_"))))

    def _lines(self, name: str) -> Iterator[bytes]:
        store, root = file_system(self.uri)
        with store.open_input_stream(f"{root}/{name}") as f:
            rest = b""
            while block := f.read(1 << 20):
                *whole, rest = (rest + block).split(b"\n")
                yield from whole
            if rest:
                yield rest

    def initialOffset(self) -> dict:
        return {"file": "", "chunks": 0}

    def latestOffset(self) -> dict:
        names = list(self._names())
        return {"file": names[-1], "chunks": sum(1 for _ in self._lines(names[-1]))} if names else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        sizes = {
            name: size
            for name, size in self._names().items()
            if start["file"] <= name <= end["file"] and (name != start["file"] or start != end)
        }
        wanted = max(LEAST_BYTES, min(MOST_BYTES, sum(sizes.values()) // PARTS))
        parts: list[InputPartition] = []
        held = wanted
        for name, size in sizes.items():  # a task for each file would cost more than its reading
            if held >= wanted:
                parts.append(Ranges([]))
                held = 0
            parts[-1].files.append(Range(name, start["chunks"] if name == start["file"] else 0, end["chunks"] if name == end["file"] else None))
            held += size
        return parts

    def read(self, partition: Ranges) -> Iterator[tuple]:
        for part in partition.files:
            for seq, line in enumerate(self._lines(part.name)):
                if part.end is not None and seq >= part.end:
                    break
                if seq >= part.start:
                    chunk = json.loads(line)
                    yield part.name, seq, chunk["response"], base64.b64decode(chunk["chunk"])

    def commit(self, end: dict) -> None:
        """Nothing is deleted: recordings can be read again."""


def objects(chunks: DataFrame) -> DataFrame:
    """(file, seq, response, content, error) of chunks that are each one JSON object."""
    return chunks.select("file", "seq", "response", object_chunk(utf8_strict(F.col("data"))).alias("c")).select("file", "seq", "response", "c.*")


def events(chunks: DataFrame) -> DataFrame:
    """(file, seq, response, content) of chunks that are each one event; '' for any other."""
    return chunks.select("file", "seq", "response", event_chunk(F.coalesce(utf8_strict(F.col("data")), F.lit(""))).alias("content"))
