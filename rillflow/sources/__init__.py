"""Readers and writers of event streams."""

from .connectors import Connector, decoded, encoded, from_environment, kafka, mqtt, socket, tcp, to_environment
from .readers import list_source, live_files, read_taxi_csv, read_wearable_csv, read_wearable_raw, table_events

__all__ = [
    "Connector", "decoded", "encoded", "from_environment", "kafka", "list_source", "live_files", "mqtt", "read_taxi_csv", "read_wearable_csv", "read_wearable_raw", "socket", "table_events", "tcp", "to_environment",
]
