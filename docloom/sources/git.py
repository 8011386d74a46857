"""The state of git working trees, one task for each repository of a table."""

from __future__ import annotations

import subprocess
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _git(path: str, *arguments: str) -> tuple[str, str | None]:
    """(output, error) of a git command; undecodable bytes are replaced."""
    done = subprocess.run(["git", "-C", path, *arguments], capture_output=True)
    if done.returncode:
        return "", done.stderr.decode("utf-8", "replace").strip()
    return done.stdout.decode("utf-8", "replace"), None


def status(repositories: DataFrame) -> DataFrame:
    """(repository, status, path, error): changed and untracked files; a row with an error where git fails."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows: list[tuple] = []
            for repository in frame["repository"]:
                out, problem = _git(repository, "status", "--porcelain", "--untracked-files=all", "--no-renames", "-z")
                rows += [(repository, e[:2].strip(), e[3:], None) for e in out.split("\0") if e]
                if problem is not None:
                    rows.append((repository, None, None, problem))
            yield pd.DataFrame(rows, columns=["repository", "status", "path", "error"], dtype=object)

    return repositories.select("repository").mapInPandas(work, "repository string, status string, path string, error string")


def status_text(repositories: DataFrame) -> DataFrame:
    """(repository, text, error): a line for each entry in order of paths, or ``Clean``; a null text and the error where git fails."""
    different = repositories.select("repository").distinct()
    entries = F.array_sort(F.collect_list(F.when(F.col("error").isNull(), F.struct("path", "status"))))
    lines = F.array_join(F.transform(entries, lambda e: F.concat(e["status"], F.lit(" "), e["path"], F.lit("\n"))), "")
    found = status(different).groupBy("repository").agg(lines.alias("text"), F.max("error").alias("error"))
    text = F.when(F.col("error").isNull(), F.coalesce("text", F.lit("Clean")))
    return different.join(found, "repository", "left").select("repository", text.alias("text"), "error")


def diff_stats(repositories: DataFrame) -> DataFrame:
    """(repository, path, insertions, deletions, error) between index and working tree; nulls for
    binary files; a row with an error where git fails."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for repository in frame["repository"]:
                out, problem = _git(repository, "diff", "--numstat", "--no-renames", "-z")
                for line in filter(None, out.split("\0")):
                    plus, minus, path = line.split("\t", 2)
                    rows.append((repository, path, int(plus) if plus != "-" else None, int(minus) if minus != "-" else None, None))
                if problem is not None:
                    rows.append((repository, None, None, None, problem))
            out = pd.DataFrame(rows, columns=["repository", "path", "insertions", "deletions", "error"])
            yield out.astype({"insertions": "Int64", "deletions": "Int64"})

    return repositories.select("repository").mapInPandas(work, "repository string, path string, insertions long, deletions long, error string")
