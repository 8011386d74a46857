"""Streams with state for each key: a conversation's log, and an interactive session.

Both run under ``transformWithStateInPandas`` with the RocksDB state store, so what they
know survives a restart from the query's checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions.text import trim_space
from ..model import CONTEXT_TOKENS, MOST_ROUNDS

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EXIT = ("exit", "quit")


class ConversationLog(StatefulProcessor):
    """The last messages of a conversation that fit a token budget, and how many answers it has had.

    State: the kept messages (a budget's worth, whatever has passed), the newest turn that
    was dropped, and two counters.  Messages may come in any order of turns: what is older
    than a dropped one is dropped, too, so that in the end the log is what
    ``conversation.compact`` makes of all messages at once.
    """

    def __init__(self, most: int = CONTEXT_TOKENS, most_calls: int = MOST_ROUNDS):
        self.most, self.most_calls = most, most_calls

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getListState("kept", "turn long, role string, content string, n_bytes long")
        self.counts = handle.getValueState("counts", "n_seen long, calls long, dropped long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n_seen, calls, dropped = self.counts.get() if self.counts.exists() else (0, 0, None)
        kept = [tuple(m) for m in self.kept.get()]
        for frame in rows:
            n_seen += len(frame)
            calls += int((frame["role"] == "assistant").sum())
            for turn, role, content in zip(frame["turn"].tolist(), frame["role"], frame["content"]):
                if dropped is None or turn > dropped:
                    content = None if content is None or pd.isna(content) else content
                    kept.append((turn, role, content, 0 if content is None else len(content.encode())))
            kept.sort(key=lambda m: m[0])
            total = sum(m[3] for m in kept)
            gone = 0
            while total // 4 > self.most:
                total -= kept[gone][3]
                dropped, gone = kept[gone][0], gone + 1
            kept = kept[gone:]
        self.kept.put(kept) if kept else self.kept.clear()
        self.counts.update((n_seen, calls, dropped))
        yield pd.DataFrame(
            {
                "conv_id": [key[0]], "n_seen": [n_seen], "tokens": [sum(m[3] for m in kept) // 4], "calls": [min(calls, self.most_calls)], "over": [calls > self.most_calls],
                "log": [[{"turn": m[0], "role": m[1], "content": m[2]} for m in kept]],
            }
        )

    def close(self) -> None:
        pass


def conversation_logs(messages: DataFrame, *, most: int = CONTEXT_TOKENS, most_calls: int = MOST_ROUNDS) -> DataFrame:
    """The log of each conversation of a stream ``messages(conv_id, turn, role, content)`` after each batch that adds to it:
    (conv_id, n_seen, tokens, calls, over, log array).  The row with the highest ``n_seen`` is the newest."""
    kind = messages.schema["conv_id"].dataType.simpleString()
    keyed = messages.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "content")
    return keyed.groupBy("conv_id").transformWithStateInPandas(
        statefulProcessor=ConversationLog(most, most_calls), outputStructType=f"conv_id {kind}, n_seen long, tokens long, calls long, over boolean, log array<struct<turn:long,role:string,content:string>>",
        outputMode="Append", timeMode="None",
    )


def latest(logs: DataFrame) -> DataFrame:
    """The newest row of each conversation of what ``conversation_logs`` has written."""
    others = [c for c in logs.columns if c != "conv_id"]
    return logs.groupBy("conv_id").agg(F.max_by(F.struct(*others), "n_seen").alias("_l")).select("conv_id", "_l.*")


class Session(StatefulProcessor):
    """The prompts of a session until its exit word.  State: the turn of the exit word."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.left = handle.getValueState("left", "turn long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        left = self.left.get()[0] if self.left.exists() else None
        lines = pd.concat(list(rows)).sort_values("turn")
        words = lines["turn"][lines["prompt"].str.lower().isin(EXIT)]
        if len(words) and (left is None or int(words.min()) < left):
            left = int(words.min())
            self.left.update((left,))
        out = lines if left is None else lines[lines["turn"] < left]
        yield out[out["prompt"].notna() & (out["prompt"] != "")][["conv_id", "turn", "prompt"]]

    def close(self) -> None:
        pass


def session_prompts(lines: DataFrame, text: str = "text") -> DataFrame:
    """The prompts of a stream of sessions ``lines(conv_id, turn, text)``: trimmed, not empty, up to each session's exit word.

    A line behind the exit word never comes through, in whichever batch it arrives; one that
    was sent on before an earlier exit word arrived is not called back.
    """
    kind = lines.schema["conv_id"].dataType.simpleString()
    keyed = lines.select("conv_id", F.col("turn").cast("long").alias("turn"), trim_space(F.col(text)).alias("prompt"))
    return keyed.groupBy("conv_id").transformWithStateInPandas(statefulProcessor=Session(), outputStructType=f"conv_id {kind}, turn long, prompt string", outputMode="Append", timeMode="None")


def start(df: DataFrame, out: str, progress: str) -> StreamingQuery:
    """Write what has arrived as Parquet, one batch after the other, and stop; started again it goes on behind that."""
    spark: SparkSession = df.sparkSession
    before = spark.conf.get(_STORE)
    spark.conf.set(_STORE, _ROCKSDB)
    try:
        return df.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", progress).trigger(availableNow=True).start()
    finally:
        spark.conf.set(_STORE, before)
