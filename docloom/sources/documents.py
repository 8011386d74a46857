"""A sink of documents, one file a row: ``df.write.format("documents").mode("append").save(root)``.

Rows are (path, content), paths relative to the root, which is a path or the URI of any
file system that pyarrow knows.  A write is whole or absent.  Tasks write into a staging
folder below the root; when all are done, the driver compares their sorted lists of paths,
which it reads one line at a time, and moves the files to their places, a thousand to a
call.  A task writes its rows alone: what lies in few partitions is dealt out first (``dealt``).  Two rows of one
path, or in mode ``append`` a file that exists already, fail the write before anything is
moved, and a move that fails is undone.  A failed job leaves nothing but what was there.
In mode ``overwrite`` files are replaced; files without a row stay.

A null path is an error, a null content an empty file.
"""

from __future__ import annotations

import heapq
import json
import logging
import os
import posixpath
import time
import uuid
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass
from itertools import islice

from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

log = logging.getLogger("docloom")
#: Groups of files that the driver moves at once, and the files of a group.
MOVERS = 4
MOVED = 1000
#: Paths that a task sorts at once; a task with more writes several lists.
LISTED = 100_000


def file_system(root: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if "://" in root or root.startswith("file:"):
        store, path = fs.FileSystem.from_uri(root if "://" in root else "file://" + root.removeprefix("file:"))
        return store, path.rstrip("/")
    return fs.LocalFileSystem(), os.path.abspath(root)


def dealt(rows: DataFrame) -> DataFrame:
    """The rows in as many partitions as the session shuffles into: a file takes far more time than its bytes,
    by which Spark cuts its input."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path")


def move(store: fs.FileSystem, source: str, target: str) -> None:
    if isinstance(store, fs.LocalFileSystem):
        os.rename(source, target)
    else:
        store.move(source, target)


@dataclass
class Written(WriterCommitMessage):
    manifests: list[str]


class DocumentSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "documents"

    def schema(self) -> str:
        return "path string, content string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return DocumentWriter(self.options["path"], overwrite)


class DocumentWriter(DataSourceWriter):
    def __init__(self, root: str, overwrite: bool):
        self.uri, self.overwrite = root, overwrite
        self.job = uuid.uuid4().hex
        store, _, staging = self._open()  # an unknown file system is refused at once
        # tasks do not make this folder, so one that outlives an abort has nowhere to write
        store.create_dir(staging, recursive=True)

    def _open(self) -> tuple[fs.FileSystem, str, str]:
        store, root = file_system(self.uri)
        return store, root, f"{root}/.staging-{self.job}"

    def write(self, rows: Iterator) -> Written:
        store, root, staging = self._open()
        attempt = uuid.uuid4().hex
        folder = f"{staging}/{attempt}"
        store.create_dir(folder, recursive=False)
        listed: list[tuple[str, int]] = []
        manifests: list[str] = []

        def flush() -> None:
            manifests.append(f"{folder}/manifest-{len(manifests)}")
            with store.open_output_stream(manifests[-1]) as f:
                for path, n in sorted(listed):
                    f.write((json.dumps([path, f"{attempt}/{n}"]) + "\n").encode())
            listed.clear()

        for n, row in enumerate(rows):
            if row["path"] is None:
                raise ValueError("a document without a path")
            path = posixpath.normpath(row["path"].lstrip("/"))
            if path in (".", "..") or path.startswith("../"):
                raise ValueError(f"path leaves the folder: {row['path']}")
            with store.open_output_stream(f"{folder}/{n}") as f:
                f.write((row["content"] or "").encode())
            listed.append((path, n))
            if len(listed) >= LISTED:
                flush()
        if listed:
            flush()
        return Written(manifests)

    def _listed(self, store: fs.FileSystem, messages: list) -> Iterator[tuple[str, str]]:
        """(path, staged file) of all tasks in order of paths, a line of each task's list in memory."""

        def lines(manifest: str) -> Iterator[tuple[str, str]]:
            with store.open_input_stream(manifest) as f:
                rest = b""
                while block := f.read(1 << 16):
                    *whole, rest = (rest + block).split(b"\n")
                    yield from (tuple(json.loads(x)) for x in whole)

        return heapq.merge(*(lines(manifest) for m in messages if m is not None for manifest in m.manifests))

    def _check(self, store: fs.FileSystem, root: str, messages: list) -> None:
        before, listed = None, self._listed(store, messages)
        while some := [path for path, _ in islice(listed, MOVED)]:
            for path in some:
                if path == before:
                    raise FileExistsError(f"several documents for {path}")
                before = path
            # nothing lies in a folder that is not there
            folders = list({posixpath.dirname(path) for path in some})
            there = {folder for folder, info in zip(folders, store.get_file_info([f"{root}/{folder}" for folder in folders])) if info.type != fs.FileType.NotFound}
            some = [path for path in some if posixpath.dirname(path) in there]
            for info, path in zip(store.get_file_info([f"{root}/{path}" for path in some]), some):
                if info.type == fs.FileType.Directory or info.type == fs.FileType.File and not self.overwrite:
                    raise FileExistsError(f"File already exists: {path}")

    def commit(self, messages: list) -> None:
        store, root, staging = self._open()
        try:
            self._check(store, root, messages)
            try:
                self._all(lambda some: self._place(store, root, staging, some), store, messages)
            except BaseException:
                self._all(lambda some: self._take_back(store, root, staging, some), store, messages)
                raise
        finally:
            self._clear(store, staging)

    def _all(self, do: Callable[[list[tuple[str, str]]], None], store: fs.FileSystem, messages: list) -> None:
        listed = self._listed(store, messages)
        running: deque[Future] = deque()
        with ThreadPoolExecutor(MOVERS) as pool:
            while some := list(islice(listed, MOVED)):
                running.append(pool.submit(do, some))
                if len(running) >= 2 * MOVERS:
                    running.popleft().result()
            while running:
                running.popleft().result()

    @staticmethod
    def _exists(store: fs.FileSystem, path: str) -> bool:
        return store.get_file_info(path).type == fs.FileType.File

    def _place(self, store: fs.FileSystem, root: str, staging: str, some: list[tuple[str, str]]) -> None:
        made = None
        for path, part in some:
            target = f"{root}/{path}"
            if (folder := posixpath.dirname(target)) != made:  # paths are sorted
                store.create_dir(folder, recursive=True)
                made = folder
            if self.overwrite and self._exists(store, target):
                move(store, target, f"{staging}/{part}.before")
            move(store, f"{staging}/{part}", target)

    def _take_back(self, store: fs.FileSystem, root: str, staging: str, some: list[tuple[str, str]]) -> None:
        for path, part in some:
            if not self._exists(store, f"{staging}/{part}") and self._exists(store, f"{root}/{path}"):
                store.delete_file(f"{root}/{path}")
            if self._exists(store, f"{staging}/{part}.before"):
                move(store, f"{staging}/{part}.before", f"{root}/{path}")

    def abort(self, messages: list) -> None:
        store, _, staging = self._open()
        self._clear(store, staging)

    @staticmethod
    def _clear(store: fs.FileSystem, staging: str) -> None:
        for wait in (0, 0.1, 0.5, 2):  # a task that is being killed may still write
            time.sleep(wait)
            if store.get_file_info(staging).type != fs.FileType.Directory:
                return
            try:
                store.delete_dir(staging)
            except OSError as e:
                log.warning("%s: %s", staging, e)
