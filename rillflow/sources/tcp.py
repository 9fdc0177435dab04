"""Lines of text over TCP as a data source: a reading node listens, a writing node connects.

The reader keeps lines until their micro-batch is committed, and takes no more from its connections while ``size`` of them wait for a
micro-batch, so a slow reader slows its writers. What is held is lost if the reading query ends; nothing is sent again (at most once).
"""

from __future__ import annotations

import socket
import threading
import time
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, SimpleDataSourceStreamReader, WriterCommitMessage
from pyspark.sql.types import StructType

FORMAT = "rillflow_tcp"
#: Seconds that a writer waits for its reader, and that it waits between attempts.
PATIENCE, PAUSE = 30.0, 0.2


class _Reader(SimpleDataSourceStreamReader):
    """Runs beside the driver; offsets count lines."""

    def __init__(self, options):
        self._start(options.get("host", "localhost"), int(options["port"]), int(options.get("size", 10_000)))

    def _start(self, host: str, port: int, size: int) -> None:
        self.address, self.size = (host, port), size
        self.lines: list[str] = []
        self.first, self.given, self.server = 0, 0, None  # lines committed, and taken into micro-batches
        self.room = threading.Condition()

    def __reduce__(self):
        """Executors get the settings only: the lines of a micro-batch are sent to them with it."""
        return _unlistening, (*self.address, self.size)

    def _listen(self) -> None:
        if self.server is None:
            self.server = socket.create_server(self.address)
            threading.Thread(target=self._accept, daemon=True).start()

    def _accept(self) -> None:
        while True:
            connection, _ = self.server.accept()
            threading.Thread(target=self._receive, args=(connection,), daemon=True).start()

    def _receive(self, connection: socket.socket) -> None:
        with connection, connection.makefile(encoding="utf-8", newline="\n") as lines:
            for line in lines:
                with self.room:
                    self.room.wait_for(lambda: self.first + len(self.lines) - self.given < self.size)
                    self.lines.append(line.rstrip("\n"))

    def initialOffset(self) -> dict:
        return {"lines": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        self._listen()
        with self.room:
            if start["lines"] > self.first + len(self.lines):  # a restarted query goes on counting where it stopped
                self.first = start["lines"]
            self.given = self.first + len(self.lines)
            self.room.notify_all()
            end = {"lines": self.given}
        return self.readBetweenOffsets(start, end), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        with self.room:
            rows = self.lines[max(0, start["lines"] - self.first) : max(0, end["lines"] - self.first)]
        return iter([(line,) for line in rows])

    def commit(self, end: dict) -> None:
        with self.room:
            done = max(0, end["lines"] - self.first)
            del self.lines[:done]
            self.first += done


def _unlistening(host: str, port: int, size: int) -> _Reader:
    reader = _Reader.__new__(_Reader)
    reader._start(host, port, size)
    return reader


class _Writer(DataSourceStreamWriter):
    """Each task has a connection of its own and sends a line for each row; line ends within a value are not allowed."""

    def __init__(self, options):
        self.address = options.get("host", "localhost"), int(options["port"])

    def write(self, iterator) -> WriterCommitMessage:
        out = None
        for row in iterator:
            line = row[0]
            if line is None:
                continue
            if "\n" in line:
                raise ValueError("a line to send holds a line end")
            out = out or self._connected()
            out.sendall(line.encode() + b"\n")
        if out:
            out.close()
        return WriterCommitMessage()

    def _connected(self) -> socket.socket:
        until = time.monotonic() + PATIENCE
        while True:
            try:
                return socket.create_connection(self.address, timeout=PATIENCE)
            except ConnectionRefusedError:
                if time.monotonic() > until:
                    raise
                time.sleep(PAUSE)

    def commit(self, messages, batchId) -> None:
        pass

    def abort(self, messages, batchId) -> None:
        pass


class TcpLines(DataSource):
    """Options: ``host``, ``port`` and, for reading, ``size``. One column ``value``; null values are not sent."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "value string"

    def simpleStreamReader(self, schema: StructType) -> _Reader:
        return _Reader(self.options)

    def streamWriter(self, schema: StructType, overwrite: bool) -> _Writer:
        return _Writer(self.options)
