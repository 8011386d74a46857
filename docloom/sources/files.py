"""A source tree as a table: ``spark.read.format("tree").load(root)``.

Spark's own file sources leave out names that begin with a dot or an underscore and know
no ignore rules, hence a Python data source.  The root is a path or the URI of any file
system that pyarrow knows.  Options: ``ignore`` (rules, one a line; what they match is
left out whatever else says), ``gitignore`` (default true: honour .gitignore files at
every level), ``content`` (default true), ``partitions`` (default 64).

The tree is opened level by level, each folder with the rules that it inherits, until
there are enough folders for all partitions; those and the files above them are packed
into partitions by how many entries they have, so that a tree below one top folder, or a
folder with very many files, is read by many tasks.  Each of those goes through the names
of that folder once, one at a time in a local file system, and looks at its own share.
Links are not followed.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import ignore
from .documents import file_system

SCHEMA = "path string, length long, modified timestamp, content binary"
#: Files of an opened folder that make one piece of work, at least; it has no more pieces than partitions are wanted.
PIECE = 1000
#: Folders with more entries than this are opened even where there are enough of them.
MOST_ENTRIES = 16 * PIECE


class TreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return TreeReader(dict(self.options))


@dataclass
class Piece:
    """A folder with all below it, or one of ``of`` shares of the files in it."""

    folder: str
    rules: list
    entries: int
    share: int = 0
    of: int = 0


@dataclass
class Packed(InputPartition):
    pieces: list[Piece]


class TreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.uri = options["path"]
        self.fixed = ignore.rules(options.get("ignore", ""))
        self.honour = options.get("gitignore", "true").lower() == "true"
        self.content = options.get("content", "true").lower() == "true"
        self.wanted = int(options.get("partitions", "64"))

    def partitions(self) -> list[InputPartition]:
        store, root = file_system(self.uri)
        if store.get_file_info(root).type != fs.FileType.Directory:
            raise FileNotFoundError(f"no folder: {self.uri}")
        level = [("", self._rules_of(store, root, "", []))]
        pieces: list[Piece] = []
        while level and len(level) < 4 * self.wanted:
            below = []
            for folder, sets in level:
                below += self._opened(store, root, folder, sets, pieces)
            level = below
        for folder, sets in level:
            n = sum(1 for _ in self._names(store, root, folder))
            if n > MOST_ENTRIES:
                pieces += [Piece(path, rules, 1) for path, rules in self._opened(store, root, folder, sets, pieces)]
            else:
                pieces.append(Piece(folder, sets, n))
        packed = [Packed([]) for _ in range(min(self.wanted, max(1, len(pieces))))]
        loads = [0] * len(packed)
        for piece in sorted(pieces, key=lambda p: -p.entries):
            least = loads.index(min(loads))
            packed[least].pieces.append(piece)
            loads[least] += piece.entries + 1
        return packed

    def _opened(self, store: fs.FileSystem, root: str, folder: str, sets: list, pieces: list[Piece]) -> list[tuple[str, list]]:
        """The folders in a folder with their rules; its files are added to the pieces."""
        files, below = 0, []
        for name, directory in self._names(store, root, folder):
            if not directory:
                files += 1
            elif self._wanted(path := f"{folder}/{name}" if folder else name, True, sets):
                below.append((path, self._rules_of(store, root, path, sets)))
        of = min(-(-files // PIECE), self.wanted)
        pieces += [Piece(folder, sets, files // of, share, of) for share in range(of)]
        return below

    def read(self, partition: Packed) -> Iterator[tuple]:
        store, root = file_system(self.uri)
        for piece in partition.pieces:
            if piece.of:
                for name, directory in self._names(store, root, piece.folder):
                    if not directory and zlib.crc32(name.encode("utf-8", "surrogateescape")) % piece.of == piece.share:
                        path = f"{piece.folder}/{name}" if piece.folder else name
                        if self._wanted(path, False, piece.rules):
                            yield self._row(store, root, path)
            else:
                yield from self._walk(store, root, piece.folder, piece.rules)

    def _walk(self, store: fs.FileSystem, root: str, folder: str, sets: list) -> Iterator[tuple]:
        for name, directory in self._names(store, root, folder):
            path = f"{folder}/{name}" if folder else name
            if not self._wanted(path, directory, sets):
                continue
            if directory:
                yield from self._walk(store, root, path, self._rules_of(store, root, path, sets))
            else:
                yield self._row(store, root, path)

    def _rules_of(self, store: fs.FileSystem, root: str, folder: str, sets: list) -> list:
        """The rules inside a folder: those of the folders above, and its own."""
        path = f"{root}/{folder}/.gitignore" if folder else f"{root}/.gitignore"
        if self.honour and store.get_file_info(path).type == fs.FileType.File:
            with store.open_input_stream(path) as f:
                return [*sets, (folder, ignore.rules(f.read().decode("utf-8", "replace")))]
        return sets

    @staticmethod
    def _names(store: fs.FileSystem, root: str, folder: str) -> Iterator[tuple[str, bool]]:
        """(name, whether it is a folder) of the files and folders in a folder, links left out."""
        where = f"{root}/{folder}" if folder else root
        if isinstance(store, fs.LocalFileSystem):
            with os.scandir(where) as entries:
                for e in entries:
                    if e.is_dir(follow_symlinks=False) or e.is_file(follow_symlinks=False):
                        yield e.name, e.is_dir(follow_symlinks=False)
        else:
            for info in store.get_file_info(fs.FileSelector(where)):
                if info.type in (fs.FileType.File, fs.FileType.Directory):
                    yield info.base_name, info.type == fs.FileType.Directory

    def _wanted(self, path: str, directory: bool, sets: list) -> bool:
        """Whether no rule leaves it out."""
        return not ignore.ignored(path, directory, [("", self.fixed)]) and not ignore.ignored(path, directory, sets)

    def _row(self, store: fs.FileSystem, root: str, path: str) -> tuple:
        info, data = store.get_file_info(f"{root}/{path}"), None
        if self.content:
            with store.open_input_stream(info.path) as f:
                data = f.read()
        return (path, info.size, info.mtime, data)


def register(spark: SparkSession) -> None:
    from ..streaming.recorded import RecordedChunks
    from .documents import DocumentSink

    spark.dataSource.register(TreeSource)
    spark.dataSource.register(DocumentSink)
    spark.dataSource.register(RecordedChunks)
