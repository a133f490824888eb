"""The attendance device as a stream source with offsets, on the Python Data Source API.

A device keeps its punches in a buffer that only grows until it is cleared, so
the number of a punch in it is its offset. The stream asks for the newest
number, plans slices of what is between it and the last one done, and tasks
read their slices over connections of their own. What a micro-batch covers is
in its offset log before it is read: a restart reads the same slices again,
no more and no fewer. A connection that breaks is made again, and its slice
goes on at the punch after the last one received.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Protocol

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

#: Seconds between two attempts to connect, attempts without any progress before a task gives up, punches a slice.
PAUSE, ATTEMPTS, SLICE = 5.0, 60, 10_000
PUNCH = "punch_id long, student_id long, punch_time timestamp, status string"


class Device(Protocol):
    """A connection to a device. Any of its methods may raise OSError when the connection breaks."""

    def first(self) -> int:
        """Number of the oldest punch that is still held."""

    def newest(self) -> int:
        """Number of the next punch that will be taken."""

    def punches(self, start: int, end: int) -> Iterator[tuple | None]:
        """The punches (student_id, punch_time, status) from start to end - 1, in order, with None for a tick without one."""

    def close(self) -> None: ...


class Slice(InputPartition):
    def __init__(self, start: int, end: int):
        super().__init__((start, end))
        self.start, self.end = start, end


class Lost(ValueError):
    """Punches that the stream hasn't read have left the device's buffer."""


class DeviceStream(DataSourceStreamReader):
    def __init__(self, connect: Callable[[], Device], pause: float, attempts: int, size: int):
        self.connect, self.pause, self.attempts, self.size = connect, pause, attempts, size

    def initialOffset(self) -> dict:
        return {"at": self._asked(lambda d: d.first())}

    def latestOffset(self) -> dict:
        return {"at": self._asked(lambda d: d.newest())}

    def partitions(self, start: dict, end: dict) -> list[Slice]:
        return [Slice(at, min(at + self.size, end["at"])) for at in range(start["at"], end["at"], self.size)]

    def read(self, partition: Slice) -> Iterator[tuple]:
        at, failed = partition.start, 0
        while at < partition.end:
            device = None
            try:
                device = self.connect()
                if device.first() > at:
                    raise Lost(f"punches {at} to {device.first() - 1} have left the device")
                for punch in device.punches(at, partition.end):
                    if punch is not None:
                        yield (at, *punch)
                        at, failed = at + 1, 0
            except OSError:
                failed += 1
                if failed >= self.attempts:
                    raise
                time.sleep(self.pause)
            finally:
                if device is not None:
                    device.close()

    def commit(self, end: dict) -> None:
        """Nothing is cleared here: that is for archive_then_clear, once what was read is archived and verified."""

    def _asked(self, question: Callable[[Device], int]) -> int:
        for attempt in range(1, self.attempts + 1):
            try:
                device = self.connect()
                try:
                    return question(device)
                finally:
                    device.close()
            except OSError:
                if attempt == self.attempts:
                    raise
                time.sleep(self.pause)
        raise AssertionError("unreachable")


def device_source(connect: Callable[[], Device], name: str = "attendance_device", pause: float = PAUSE, attempts: int = ATTEMPTS, size: int = SLICE) -> type[DataSource]:
    """A data source to be registered with ``spark.dataSource.register``; ``connect`` runs in the driver and in tasks and must be picklable."""

    class DeviceSource(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return PUNCH

        def streamReader(self, schema: StructType) -> DataSourceStreamReader:
            return DeviceStream(connect, pause, attempts, size)

    return DeviceSource
