"""State with an end: processors that keep a value per key and drop it by an event-time timer."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable, Iterator
from itertools import chain
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Fixed value: statuses after which a job does nothing more.
FINISHED = ("completed", "failed")
#: Uploads of a packed piece of state, and of a pack that is handed on.
PACKED, PACK = 1 << 14, 1 << 9
#: Buckets that checksums are dealt into, and parts of a bucket in which its uploads wait. A stream with a checkpoint keeps them.
BUCKETS, PARTS = 1 << 8, 1 << 4


def use_timers(df: DataFrame) -> None:
    """Timers need the state store that keeps its state on disk."""
    df.sparkSession.conf.set(
        "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    )


def _reset(handle: StatefulProcessorHandle, at_ms: int | None) -> None:
    """The key's only timer."""
    for timer in list(handle.listTimers()):
        handle.deleteTimer(timer)
    if at_ms is not None:
        handle.registerTimer(at_ms)


class LatestStatus(StatefulProcessor):
    """The latest status of each job. A finished job leaves the state ``keep_ms`` after it finished; a later update brings it back."""

    def __init__(self, job: str, keep_ms: int):
        self.job, self.keep_ms = job, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.latest = handle.getValueState("latest", "at long, event_id long, status string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        best = tuple(self.latest.get()) if self.latest.exists() else None
        for frame in rows:
            for found in zip(frame["at"].tolist(), frame["event_id"].tolist(), frame["status"].tolist(), strict=True):
                if best is None or found[:2] > best[:2]:
                    best = found
        self.latest.update(best)
        at, _, status = best
        _reset(self.handle, at // 1000 + self.keep_ms if status in FINISHED else None)
        yield pd.DataFrame({self.job: [key[0]], "status": [status], "at": [at]})

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.latest.clear()
        yield from ()

    def close(self) -> None:
        pass


def packed(names: pa.Array, at: np.ndarray, ids: np.ndarray) -> bytes:
    """Uploads as bytes: 20 each (which name, time and id), and every name once."""
    table = pa.table({"checksum": names.dictionary_encode(), "at": at, "id": ids})
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema) as stream:
        stream.write_table(table)
    return out.getvalue().to_pybytes()


def unpacked(pieces: Iterable[bytes]) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The different names, and of each upload which of them it has, its time and its id."""
    table = pa.concat_tables([pa.ipc.open_stream(piece).read_all() for piece in pieces]).unify_dictionaries().combine_chunks()
    names = table["checksum"].chunk(0)
    return names.dictionary, names.indices.to_numpy(), table["at"].to_numpy(), table["id"].to_numpy()


class Waiting(StatefulProcessor):
    """Holds uploads back until the watermark has passed them, packed, as a checksum may have a large share of all uploads.

    The rows' ``checksum`` names the file; a group whose rows have none is one checksum, its key.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "packed binary")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        first = None
        for frame in rows:
            if len(frame):
                names = pa.array(frame["checksum"].to_numpy()) if "checksum" in frame else pa.repeat(key[0], len(frame))
                at = frame["at"].to_numpy(np.int64)
                self._wait(names, at, frame["id"].to_numpy(np.int64))
                least = int(at.min()) // 1000 + 1
                first = least if first is None else min(first, least)
        timers = list(self.handle.listTimers())
        if first is not None and (not timers or first < min(timers)):
            _reset(self.handle, first)
        yield from ()

    def _wait(self, names: pa.Array, at: np.ndarray, ids: np.ndarray) -> None:
        for start in range(0, len(at), PACKED):
            end = start + PACKED
            self.waiting.appendValue((packed(names[start:end], at[start:end], ids[start:end]),))

    def _ready(self, passed: int) -> tuple[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray] | None, list[int]]:
        """Uploads that wait no more, as ``unpacked`` gives them, and when the first of the others will be ready."""
        pieces = [piece for (piece,) in self.waiting.get()]
        if not pieces:
            return None, []
        names, which, at, ids = unpacked(pieces)
        del pieces
        self.waiting.clear()
        over = at < passed * 1000  # a time is ready when its millisecond is before the watermark's
        if over.all():
            return (names, which, at, ids), []
        rest = ~over
        self._wait(names.take(pa.array(which[rest])), at[rest], ids[rest])
        ready = (names, which[over], at[over], ids[over]) if over.any() else None
        return ready, [int(at[rest].min()) // 1000 + 1]

    def close(self) -> None:
        pass


class Packing(Waiting):
    """``bucket, packed, ts``: uploads of a part of a bucket that the watermark has passed, in packs.

    Spark hands a processor one row after the other, which takes longer than to judge it, and each append to a list of the
    state reads the list. So uploads come and wait in parts that a checksum with a large share of them is spread over.
    """

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        ready, timers = self._ready(passed)
        _reset(self.handle, min(timers) if timers else None)
        if ready is not None:
            names, which, at, ids = ready
            order = np.argsort(which, kind="stable")  # a name comes into few packs
            cut = [order[start : start + PACK] for start in range(0, len(order), PACK)]
            packs = [packed(names.take(pa.array(which[some])), at[some], ids[some]) for some in cut]
            yield pd.DataFrame({"bucket": [key[0]] * len(cut), "packed": packs, "ts": pd.to_datetime([passed] * len(cut), unit="ms", utc=True)})


class FirstWithin(Waiting):
    """Uploads that stay, judged in the order of time when the watermark has passed them.

    A call to the state costs as much as hundreds of uploads, and most checksums have few. So a group is a bucket of
    checksums, and its uploads come in the packs of ``Packing``, which have waited and are judged at once.
    """

    def __init__(self, within_us: int):
        self.within_us = within_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.last = handle.getValueState("last", "packed binary")  # of each checksum whose period is not over

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        rows = iter(rows)
        frame = next(rows)
        if "packed" in frame:
            pieces = [piece for part in chain([frame], rows) for piece in part["packed"]]
            yield from self._judged(unpacked(pieces), list(self.handle.listTimers()), timerValues)
        else:
            yield from super().handleInputRows(key, chain([frame], rows), timerValues)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        ready, timers = self._ready(timerValues.getCurrentWatermarkInMs())
        yield from self._judged(ready, timers, timerValues)

    def _judged(self, ready: tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray] | None, timers: list[int], timerValues: Any) -> Iterator[pd.DataFrame]:
        """Those of the uploads that stay. ``timers`` says when the group is due besides."""
        passed = timerValues.getCurrentWatermarkInMs()
        last = {}
        if self.last.exists():
            names, which, at, _ = unpacked(self.last.get())
            last = dict(zip(names.take(pa.array(which)).to_pylist(), at.tolist(), strict=True))
        kept = None if ready is None else self._kept(*ready, last)
        last = {name: at for name, at in last.items() if (at + self.within_us) // 1000 >= passed}
        if last:
            times = np.fromiter(last.values(), np.int64, len(last))
            self.last.update((packed(pa.array(list(last)), times, times),))
            timers = [*timers, (int(times.min()) + self.within_us) // 1000 + 1]
        else:
            self.last.clear()
        _reset(self.handle, min(timers) if timers else None)
        if kept is not None:
            for start in range(0, len(kept), PACKED):
                yield kept[start : start + PACKED]

    def _kept(self, names: pa.Array, which: np.ndarray, at: np.ndarray, ids: np.ndarray, last: dict[Any, int]) -> pd.DataFrame:
        """The uploads that stay after those in ``last``, which goes on to them."""
        order = np.lexsort((ids, at, which))
        which, at, ids = which[order], at[order], ids[order]
        names = names.to_pylist()
        times = memoryview(at)
        kept = []
        start = 0
        for end in [*(np.flatnonzero(np.diff(which)) + 1).tolist(), len(which)]:
            name = names[which[start]]
            before = last.get(name)
            i = start if before is None else bisect_right(times, before + self.within_us, start, end)
            while i < end:
                kept.append(i)
                before = times[i]
                i = bisect_right(times, before + self.within_us, i + 1, end)
            last[name] = before
            start = end
        checksums = np.empty(len(names), object)
        checksums[:] = names
        return pd.DataFrame({"checksum": checksums[which[kept]], "at": at[kept], "id": ids[kept]})
