"""Folding agent events into turns as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from leafloom.streaming.state import drain, use_state_store

OUTPUT = (
    "turn_id string, text string, tool_calls array<struct<id:string,query:string,hit_count:int,scope_label:string>>, "
    "citations array<struct<index:int,node:string>>, status string"
)
EVENT = "seq int, type string, id string, payload string, number int"
LATE, IDLE_MS = "10 minutes", 600_000
#: Times that Python can hold in any time zone.
FIRST, LAST = "0001-01-02 00:00:00Z", "9999-12-30 00:00:00Z"


def folded(turn_id: str, events: list[tuple], status: str) -> Row:
    events = sorted(tuple(e) for e in events)
    results = {ident: (label, hits) for _, kind, ident, label, hits in events if kind == "tool-result"}
    calls = []
    for _, kind, ident, payload, _ in events:
        if kind == "tool-call":
            label, hits = results.get(ident, (None, None))
            calls.append(Row(id=ident, query=payload, hit_count=hits, scope_label=label))
    text = "".join(e[3] for e in events if e[1] == "text-delta")
    citations = [Row(index=e[4], node=e[3]) for e in events if e[1] == "data-citation"]
    return Row(turn_id=turn_id, text=text, tool_calls=calls, citations=citations, status=status)


class TurnProcessor(StatefulProcessor):
    """State of a turn: the list of its events, to which a batch appends its own and rewrites nothing. Of a finished turn only a mark stays, so that late events do
    not open it again. Both leave the store when the turn has been idle for ten minutes."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.events = handle.getListState("events", EVENT)
        self.turn = handle.getValueState("turn", "done boolean, timer long")

    def handleInputRows(self, key, rows, timerValues):
        known = self.turn.get()  # every call goes to the JVM and back, so a turn's first batch asks for nothing else
        done, timer = known or (False, None)
        fresh, last, passed = [], 0, timerValues.getCurrentWatermarkInMs()
        for r in rows:
            if r.ts is None and r.ms is not None and r.ms <= passed:  # Spark has dropped the other late ones
                continue
            fresh.append((r.seq, r.type, r.id, r.payload, r.number))
            last = max(last, r.ms)
        if not fresh:
            return
        wake = max(timer or 0, last + IDLE_MS)
        if wake != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(wake)
        ends = done or any(e[1] == "finish" for e in fresh)
        if not done:
            before = list(self.events.get()) if known else []
            yield folded(key[0], before + fresh, "complete" if ends else "streaming")
            if not ends:
                self.events.appendList(fresh)
            elif known:
                self.events.clear()
        self.turn.update((ends, wake))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.events.clear()
        self.turn.clear()
        return iter(())

    def close(self) -> None:
        pass


def fold_stream(events: DataFrame, late: str = LATE) -> DataFrame:
    """A turn as it stands after each batch that has events of it; the row with its ``finish`` is its last."""
    use_state_store(events.sparkSession)
    rows = events.select("turn_id", F.col("ts").cast("timestamp").alias("ts"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), "seq", "type", "id", "payload", "number")
    rows = rows.withWatermark("ts", late)
    # The watermark comes from all times. One that Python can't hold stays behind with its mark, and `ms` tells whether its row is late.
    held = F.when(F.col("ts").between(F.lit(FIRST).cast("timestamp"), F.lit(LAST).cast("timestamp")), F.col("ts"))
    rows = rows.withColumn("ts", held.alias("ts", metadata=rows.schema["ts"].metadata))
    return rows.groupBy("turn_id").transformWithState(TurnProcessor(), OUTPUT, "Update", "EventTime")


def run_fold(events: DataFrame, out: str | None = None, late: str = LATE) -> DataFrame:
    """Drains a stream of events and returns the last row of every turn, finished or not."""
    return drain(fold_stream(events, late), OUTPUT, "turn_id", "turns", out, (F.col("status") == "complete").cast("int"))
