"""Token ids in flat binary files.  [operator 3]

Documents are range-partitioned by doc_id.  Each partition k writes

  part-k.bin   the ids of its documents, little-endian unsigned integers of 16
               bits where the vocabulary fits and of 32 bits otherwise
  part-k.idx   64-bit little-endian offsets into it, one more than documents
  part-k.doc   64-bit doc_ids in the same order

under a temporary name that is renamed when whole, so a task that is run again
replaces its own files.  A partition's base, the number of ids before it, is the
prefix sum of the partitions' totals and stands in the manifest table.  Readers
map the files into memory.

Cases with a defined result
  null text       an empty text: only the end id
  null doc_id     sorts before all others; returned as null
  equal doc_ids   ordered by a hash of the text; equal rows are alike
  empty table     no file; an empty result
  extra columns   ignored; only doc_id and text are read
"""

from __future__ import annotations

import os
import shutil
import tempfile
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import coder
from .scratch import begin_task, materialize, n_partitions
from .wordarrays import slices

_NULL = -(2**63)


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, *, end_id: int | None = 1) -> DataFrame:
    """Write the files below ``folder`` (a URI that all executors reach) and return
    the manifest: part, n_docs, n_tokens, base, item_bytes."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        store, root = fs.FileSystem.from_uri(folder)
        begin_task("bpe")
        c = coder(tokenizer_path)
        kind = np.dtype("<u2" if c.vocabulary_size <= 1 << 16 else "<u4")
        ids_tmp = f"{root}/_tmp-{part}-{attempt}"
        counts, doc_ids, out = [], [], None
        for batch in batches:
            for rows in slices(batch):
                if out is None:
                    store.create_dir(root, recursive=True)
                    out = store.open_output_stream(ids_tmp)
                ids = c.encode_column(rows.column("text"))
                values, at = ids.values.to_numpy(), ids.offsets.to_numpy().astype(np.int64)
                if end_id is not None:
                    values, n = np.insert(values, at[1:], end_id), np.diff(at) + 1
                else:
                    n = np.diff(at)
                out.write(values.astype(kind).tobytes())
                counts.append(n)
                doc_ids.append(rows.column("doc_id").fill_null(_NULL).to_numpy().astype("<i8"))
        if out is None:
            return
        out.close()
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(counts))]).astype("<i8")
        for name, data in (("idx", offsets.tobytes()), ("doc", np.concatenate(doc_ids).tobytes())):
            with store.open_output_stream(f"{ids_tmp}.{name}") as f:
                f.write(data)
            store.move(f"{ids_tmp}.{name}", f"{root}/part-{part}.{name}")
        store.move(ids_tmp, f"{root}/part-{part}.bin")
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "n_docs": [len(offsets) - 1], "n_tokens": [int(offsets[-1])], "item_bytes": pa.array([kind.itemsize], pa.int32())})

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"))
    ranged = keyed.repartitionByRange(n_partitions(docs), "doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    parts = materialize(ranged.mapInArrow(write, "part int, n_docs long, n_tokens long, item_bytes int"), "manifest")
    # one row for each partition
    base = F.sum("n_tokens").over(Window.orderBy("part")) - F.col("n_tokens")
    return parts.select("part", "n_docs", "n_tokens", base.alias("base"), "item_bytes")


def _mapped(store: fs.FileSystem, path: str, kind: str, keep: list) -> np.ndarray:
    """A file as a mapped array; a remote file is copied to the task's temporary folder first."""
    if not isinstance(store, fs.LocalFileSystem):
        local = tempfile.NamedTemporaryFile(delete=True)
        keep.append(local)
        with store.open_input_stream(path) as f:
            shutil.copyfileobj(f, local)
        local.flush()
        path = local.name
    return np.memmap(path, kind, "r") if os.path.getsize(path) else np.zeros(0, kind)


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = fs.FileSystem.from_uri(folder)
        for frame in frames:
            for row in frame.itertuples():
                keep: list = []
                ids = _mapped(store, f"{root}/part-{row.part}.bin", f"<u{row.item_bytes}", keep)
                offsets = _mapped(store, f"{root}/part-{row.part}.idx", "<i8", keep)
                doc_ids = pd.Series(_mapped(store, f"{root}/part-{row.part}.doc", "<i8", keep), dtype="Int64")
                crc = [zlib.crc32(ids[a:b].astype("<u4")) for a, b in zip(offsets[:-1], offsets[1:])]
                yield pd.DataFrame({"doc_id": doc_ids.mask(doc_ids == _NULL), "start": row.base + offsets[:-1], "n_tokens": np.diff(offsets), "ids_crc32": np.array(crc, np.int64)})
                for local in keep:
                    local.close()

    spread = manifest.repartition(max(1, manifest.count()), "part")  # a file to a task, about
    return spread.mapInPandas(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
