"""Statistics of sessions as keyed state: running counts and averages of tools, the last entries of a log, and resets in mid-stream.

State of a session is a row for each tool and the last entries, no more; a session that is silent for some time is forgotten. Calls of a batch are
taken in the order of ord; a batch adds to what batches before it have told, so a stream in any number of batches ends as one batch does. A reset
takes effect at its place in that order: statistics and log begin anew behind it."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.telemetry import LOG_ENTRIES

RESET = "RESET"
FORGET_MS = 24 * 3600 * 1000
#: The state store that keeps lists, maps and their times to live.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

_ENTRY = "ord long, tool_name string, duration_ms double"
STATISTICS = "session string, tool_name string, n_calls long, avg_ms double, entries array<long>"


class Sessions(StatefulProcessor):
    """Of each session and batch: a row for each tool with calls since the last reset, and the entries of the log, oldest first."""

    def __init__(self, entries: int = LOG_ENTRIES, forget_ms: int | None = FORGET_MS) -> None:
        self.most, self.forget_ms = entries, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.log = handle.getListState("log", _ENTRY, self.forget_ms)
        self.tools = handle.getMapState("tools", "tool_name string", "n long, total double", self.forget_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values("ord", kind="stable")  # of one session within one batch of the stream
        tools = {k[0]: list(v) for k, v in self.tools.iterator()} if self.tools.exists() else {}
        log = [tuple(e) for e in self.log.get()] if self.log.exists() else []
        held = set(tools)
        resets = (batch["type"] == RESET).to_numpy()
        if resets.any():
            batch, tools, log = batch.iloc[int(resets.nonzero()[0][-1]) + 1 :], {}, []
        for name, ms in zip(batch["tool_name"], batch["duration_ms"], strict=True):
            one = tools.setdefault(name, [0, 0.0])
            one[0] += 1
            one[1] += ms
        log = (log + list(zip(batch["ord"].tolist(), batch["tool_name"].tolist(), batch["duration_ms"].tolist(), strict=True)))[-self.most :]
        for name in held - set(tools):
            self.tools.removeKey((name,))
        for name, (n, total) in tools.items():
            self.tools.updateValue((name,), (n, total))
        if log:
            self.log.put(log)
        else:
            self.log.clear()
        entries = [e[0] for e in log]
        shown = [(key[0], name, n, total / n, entries) for name, (n, total) in sorted(tools.items())] or [(key[0], None, 0, None, entries)]
        yield pd.DataFrame(shown, columns=["session", "tool_name", "n_calls", "avg_ms", "entries"])

    def close(self) -> None:
        pass


def session_statistics(calls: DataFrame, entries: int = LOG_ENTRIES, forget_ms: int | None = FORGET_MS) -> DataFrame:
    """session, tool_name, n_calls, avg_ms, entries of calls(session, ord, type, tool_name, duration_ms), in update mode: after each batch what is so by then, one row
    without a tool for a session that a reset has emptied. Rows of type RESET reset their session, others are calls; a null duration counts as 0.
    forget_ms: how long a silent session is remembered; state that can expire makes batches without rows, so such a stream wants a trigger by time, and availableNow would not
    end. None: for ever."""
    calls.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    known = calls.select("session", "ord", "type", "tool_name", "duration_ms").fillna({"duration_ms": 0.0})
    return known.groupBy("session").transformWithStateInPandas(Sessions(entries, forget_ms), STATISTICS, "Update", "ProcessingTime" if forget_ms else "None")
