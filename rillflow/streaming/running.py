"""Running live streams: source, program and sink of a node, and what it counts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery, StreamingQueryListener

from ..events import EventStream

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def configure(spark: SparkSession) -> None:
    """What stateful operators need of the session."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def start(stream: EventStream | DataFrame, sink: str | Callable[[DataFrame, int], None], checkpoint: str | None = None, path: str | None = None, name: str | None = None, once: bool = False, mode: str = "append") -> StreamingQuery:
    """Starts a query; ``sink``: a format (console, memory, parquet, kafka ...) or a function of (batch, number).

    With a checkpoint, a restarted query goes on where it stopped. ``once`` takes what is there now and ends.
    """
    df = stream.df if isinstance(stream, EventStream) else stream
    writer: DataStreamWriter = df.writeStream.outputMode(mode)
    writer = writer.foreachBatch(sink) if callable(sink) else writer.format(sink)
    for given, put in ((checkpoint, lambda w, x: w.option("checkpointLocation", x)), (path, lambda w, x: w.option("path", x)), (name, lambda w, x: w.queryName(x))):
        if given:
            writer = put(writer, given)
    return (writer.trigger(availableNow=True) if once else writer).start()


def node(sources: list[EventStream], program: Callable[..., EventStream], sink, **options) -> StreamingQuery:
    """A node of a deployment: one or two sources, a program over them, and a sink; see ``start`` for options."""
    for s in sources:
        configure(s.df.sparkSession)
    return start(program(*sources), sink, **options)


@dataclass
class ProgressMetrics(StreamingQueryListener):
    """Counts of all queries of a session: events in, events out, batches; register with ``spark.streams.addListener``."""

    events_in: int = 0
    events_out: int = 0
    batches: int = 0
    running: set = field(default_factory=set)

    def onQueryStarted(self, event) -> None:
        self.running.add(str(event.id))

    def onQueryProgress(self, event) -> None:
        self.batches += 1
        self.events_in += event.progress.numInputRows
        self.events_out += max(0, event.progress.sink.numOutputRows)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.running.discard(str(event.id))
