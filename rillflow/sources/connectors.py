"""Settings of links between nodes: what a program reads from and writes to.

Kafka needs Spark's Kafka package on the class path, and MQTT a data source of that name. TCP links carry events as lines of JSON.
"""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..events import EventStream
from . import tcp as lines

PREFIX = "RILLFLOW"
#: Events that a link holds back for a slow reader; the limit of a micro-batch for Kafka.
BUFFERED = 10


@dataclass(frozen=True)
class Connector:
    """A format and its options."""

    kind: str
    options: dict[str, str] = field(default_factory=dict)

    def read(self, spark: SparkSession) -> DataFrame:
        if self.kind == lines.FORMAT:
            spark.dataSource.register(lines.TcpLines)
        return spark.readStream.format(self.kind).options(**self.options).load()

    def write(self, df: DataFrame) -> DataStreamWriter:
        if self.kind == lines.FORMAT:
            df.sparkSession.dataSource.register(lines.TcpLines)
        return df.writeStream.format(self.kind).options(**self.options)


def kafka(host: str, port: int = 9092, topic: str = "rillflow-queue", per_trigger: int | None = None) -> Connector:
    """A Kafka topic, read from its beginning."""
    options = {"kafka.bootstrap.servers": f"{host}:{port}", "subscribe": topic, "topic": topic, "startingOffsets": "earliest"}
    return Connector("kafka", options | ({"maxOffsetsPerTrigger": str(per_trigger)} if per_trigger else {}))


def mqtt(host: str, port: int = 1883, topic: str = "RillflowQueue") -> Connector:
    """An MQTT topic, at most once and not retained."""
    return Connector("mqtt", {"brokerUrl": f"tcp://{host}:{port}", "topic": topic, "QoS": "0", "retain": "false"})


def socket(host: str, port: int) -> Connector:
    """Lines of a server that the reading node connects to; for reading only."""
    return Connector("socket", {"host": host, "port": str(port)})


def tcp(host: str, port: int, size: int | None = None) -> Connector:
    """Lines over TCP: the reading node listens at this address, and the writing node connects to it."""
    return Connector(lines.FORMAT, {"host": host, "port": str(port)} | ({"size": str(size)} if size else {}))


def encoded(stream: EventStream) -> DataFrame:
    """A stream as a link carries it: a column ``value`` with the JSON of each event."""
    return stream.df.select(F.to_json(F.struct(*stream.columns), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}).alias("value"))


def decoded(df: DataFrame, schema: str, key: tuple[str, ...] = (), bucket: int = 1 << 20) -> EventStream:
    """The events of a link's JSON (``value``, as text or bytes); ``schema`` names key, seq, ts and value. Lines that are no JSON are dropped."""
    event = F.from_json(F.col("value").cast("string"), schema, {"mode": "PERMISSIVE"})
    return EventStream(df.select(event.alias("e")).where("e.seq is not null").select("e.*"), key, bucket)


def from_environment(side: str, environment: Mapping[str, str] | None = None) -> Connector:
    """The link of a node's ``side`` (ingress or egress) by RILLFLOW_<SIDE>_TYPE, _HOST, _PORT, _TOPIC and _SIZE."""
    env = os.environ if environment is None else environment
    get = lambda name, default: env.get(f"{PREFIX}_{side.upper()}_{name}", default)
    kind, host = get("TYPE", "tcp").lower(), get("HOST", "localhost")
    if kind == "kafka":
        return kafka(host, int(get("PORT", "9092")), get("TOPIC", "rillflow-queue"), int(get("SIZE", str(BUFFERED))))
    if kind == "mqtt":
        return mqtt(host, int(get("PORT", "1883")), get("TOPIC", "RillflowQueue"))
    if kind == "tcp":
        size = get("SIZE", "")
        return tcp(host, int(get("PORT", "9001")), int(size) if size else None)
    raise ValueError(f"unknown link type {kind}")


def to_environment(side: str, kind: str, host: str, port: int, topic: str = "", size: int = BUFFERED) -> dict[str, str]:
    """The variables that ``from_environment`` reads."""
    values = {"TYPE": kind, "HOST": host, "PORT": str(port), "SIZE": str(size)} | ({"TOPIC": topic} if topic else {})
    return {f"{PREFIX}_{side.upper()}_{k}": v for k, v in values.items()}
