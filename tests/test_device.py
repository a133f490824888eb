"""The device source: slices, restarts and connections that break."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from learnlake.sources import device


def buffer(folder, every=0):
    """A device whose buffer is a file of lines; every so many punches a connection breaks."""
    path, cleared = f"{folder}/buffer", f"{folder}/cleared"

    def connect():
        class Buffer:
            def _lines(self):
                with open(path) as f:
                    return f.readlines()

            def first(self):
                try:
                    with open(cleared) as f:
                        return int(f.read())
                except FileNotFoundError:
                    return 0

            def newest(self):
                return len(self._lines())

            def punches(self, start, end):
                for k, line in enumerate(self._lines()[start:end]):
                    if every and k == every:
                        raise ConnectionResetError("the device went away")
                    student, when, status = json.loads(line)
                    yield None
                    yield student, dt.datetime.fromisoformat(when), status

            def close(self):
                pass

        return Buffer()

    return connect


def punch(folder, *numbers):
    with open(f"{folder}/buffer", "a") as f:
        for n in numbers:
            f.write(json.dumps([n % 5, (dt.datetime(2024, 1, 5) + dt.timedelta(minutes=n)).isoformat(), str(n)]) + "\n")


def drain(spark, name, folder):
    stream = spark.readStream.format(name).load()
    run = stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/out")
    run.awaitTermination()
    return sorted((r["punch_id"], r["student_id"], r["status"]) for r in spark.read.parquet(f"{folder}/out").collect())


@pytest.mark.parametrize("every", [0, 3])
def test_a_restart_loses_and_repeats_nothing(spark, tmp_path, every):
    name = f"device_{every}"
    spark.dataSource.register(device.device_source(buffer(str(tmp_path), every), name, pause=0.01, size=8))
    punch(tmp_path, *range(30))
    want = [(n, n % 5, str(n)) for n in range(30)]
    assert drain(spark, name, str(tmp_path)) == want
    assert drain(spark, name, str(tmp_path)) == want
    punch(tmp_path, *range(30, 47))
    assert drain(spark, name, str(tmp_path)) == want + [(n, n % 5, str(n)) for n in range(30, 47)]


def test_slices_cover_a_range_once():
    reader = device.DeviceStream(None, 0, 1, 10)
    slices = reader.partitions({"at": 5}, {"at": 37})
    assert [(s.start, s.end) for s in slices] == [(5, 15), (15, 25), (25, 35), (35, 37)] and reader.partitions({"at": 5}, {"at": 5}) == []


def test_a_slice_goes_on_after_the_last_punch_received(tmp_path):
    punch(tmp_path, *range(20))
    reader = device.DeviceStream(buffer(str(tmp_path), 4), 0, 2, 100)
    assert [r[0] for r in reader.read(device.Slice(2, 20))] == list(range(2, 20))


def test_a_dead_device_ends_the_task_and_lost_punches_are_an_error(tmp_path):
    def dead():
        raise ConnectionRefusedError("nobody there")

    reader = device.DeviceStream(dead, 0, 3, 100)
    with pytest.raises(OSError):
        reader.latestOffset()
    with pytest.raises(OSError):
        list(reader.read(device.Slice(0, 1)))
    punch(tmp_path, *range(9))
    (tmp_path / "cleared").write_text("5")
    reader = device.DeviceStream(buffer(str(tmp_path)), 0, 3, 100)
    assert reader.initialOffset() == {"at": 5}
    with pytest.raises(device.Lost):
        list(reader.read(device.Slice(3, 9)))


def test_the_device_feeds_the_machine(spark, tmp_path):
    from learnlake.streaming import machine

    spark.dataSource.register(device.device_source(buffer(str(tmp_path)), "device_live", pause=0.01))
    punch(tmp_path, 540, 660, 661, 900)
    stream = spark.readStream.format("device_live").load()
    changed = machine.drained(spark, machine.changes(machine.captured(stream, F.lit("2024-02-01 00:00:00").cast("timestamp"))), str(tmp_path / "machine"))
    assert sorted((r["student_id"], r["m_in"], r["m_out"]) for r in machine.rows_of(changed).collect()) == [(0, 540, 660)]
    assert sorted(r["outcome"] for r in machine.outcomes_of(changed).collect()) == ["applied", "applied", "pending", "pending"]
