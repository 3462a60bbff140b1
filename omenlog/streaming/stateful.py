"""Order-dependent operators per key with managed state.

The rows of a micro-batch are sorted by time before they meet the state of their key, so a
stream that is ordered across batches gives the results of the batch operators.  With ``wait``
rows are kept in a list state until the watermark has passed them and are then released in order
of time, so files may arrive out of order as far as the watermark allows; timers release what no
later row of the key pushes out.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from omenlog.operators.context import _nearest, _starts, cosine_of, mahalanobis_of, statistics_of
from omenlog.schema import SECOND


def _sorted(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(rows)).sort_values(["us", "line_id"], kind="stable").reset_index(drop=True)


class _Keyed(StatefulProcessor):
    """One value of state per key, optionally forgotten after an idle time.

    ``fields`` names the columns that ``advance`` reads after ``us`` and ``line_id``.  Waiting rows
    number at most those that arrive for a key while the watermark lags behind.
    """

    state_schema = ""
    fields: Mapping[str, str] = {}

    def __init__(self, idle_ms: int | None = None, wait: bool = False):
        self.idle_ms, self.wait = idle_ms, wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", self.state_schema, self.idle_ms)
        if self.wait:
            kinds = {"us": "long", "line_id": "long", **self.fields}
            self.columns = list(kinds)
            self.waiting = handle.getListState("waiting", ", ".join(f"{c} {k}" for c, k in kinds.items()))

    def read(self, default: tuple) -> tuple:
        return tuple(self.state.get()) if self.state.exists() else default

    def handleInputRows(self, key, rows, timerValues):
        if not self.wait:
            yield from self.advance(key, _sorted(rows))
            return
        for pdf in rows:
            columns = [[v.tolist() if isinstance(v, np.ndarray) else v for v in pdf[c].tolist()] for c in self.columns]
            self.waiting.appendList(list(zip(*columns)))
        yield from self._release(key, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if self.wait:
            yield from self._release(key, timerValues)

    def _release(self, key, timerValues):
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted((tuple(r) for r in self.waiting.get()), key=lambda r: r[:2])
        due = bisect_left(rows, passed, key=lambda r: r[0])
        if due:
            yield from self.advance(key, pd.DataFrame(rows[:due], columns=self.columns))
            if due < len(rows):
                self.waiting.put(rows[due:])
            else:
                self.waiting.clear()
        yield from self.settle(key, passed)
        if due < len(rows):
            self.handle.registerTimer(rows[due][0] // 1000 + 1)

    def advance(self, key, pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        """Results of the next rows of the key, in order of time."""
        raise NotImplementedError

    def settle(self, key, passed: int) -> Iterator[pd.DataFrame]:
        """What the state gives once all rows before ``passed`` are behind."""
        return iter(())

    def close(self) -> None:
        pass


class DeltaMs(_Keyed):
    """Milliseconds since the previous row of the key; late rows give 0."""

    state_schema = "us long"

    def advance(self, key, pdf):
        (last,) = self.read((None,))
        us = pdf["us"].to_numpy()
        before = np.concatenate([[us[0] if last is None else last], us[:-1]])
        self.state.update((int(us[-1]),))
        yield pd.DataFrame({
            "key": key[0], "line_id": pdf["line_id"], "delta_ms": np.maximum(0.0, (us - before) / 1000.0)
        })


class Hybrid(_Keyed):
    """Blend of score and distance, each scaled by its running range."""

    state_schema = "a_lo double, a_hi double, b_lo double, b_hi double"
    fields = {"score": "double", "dist": "double"}

    def __init__(self, alpha: float = 0.5, idle_ms: int | None = None, wait: bool = False):
        super().__init__(idle_ms, wait)
        self.alpha = alpha

    def advance(self, key, pdf):
        inf = float("inf")
        a_lo, a_hi, b_lo, b_hi = self.read((inf, -inf, inf, -inf))
        a, b = pdf["score"].to_numpy(), pdf["dist"].to_numpy()
        ready = b >= 0

        def scaled(x, lo, hi):
            low = np.minimum.accumulate(np.concatenate([[lo], np.where(ready, x, inf)]))[1:]
            high = np.maximum.accumulate(np.concatenate([[hi], np.where(ready, x, -inf)]))[1:]
            span = high - low
            flat = ~(span >= 1e-8)
            return np.where(flat, 0.0, (x - low) / np.where(flat, 1.0, span)), low[-1], high[-1]

        with np.errstate(invalid="ignore"):
            sa, a_lo, a_hi = scaled(a, a_lo, a_hi)
            sb, b_lo, b_hi = scaled(b, b_lo, b_hi)
        self.state.update((float(a_lo), float(a_hi), float(b_lo), float(b_hi)))
        yield pd.DataFrame({
            "key": key[0], "line_id": pdf["line_id"],
            "hybrid": np.where(ready, self.alpha * sa + (1 - self.alpha) * sb, a),
        })


class LeadTime(_Keyed):
    """Lead time of each failure: earliest alert of the key in ``[t - seconds, t)``.

    The state holds the distinct alert instants of the last ``seconds`` only.
    """

    state_schema = "alerts array<long>"
    fields = {"score": "double", "label": "int"}

    def __init__(self, threshold: float, seconds: int = 3600, idle_ms: int | None = None, wait: bool = False):
        super().__init__(idle_ms, wait)
        self.threshold, self.width = threshold, seconds * SECOND

    def advance(self, key, pdf):
        (kept,) = self.read(([],))
        us = pdf["us"].to_numpy()
        fresh = us[pdf["score"].to_numpy() > self.threshold]
        alerts = np.unique(np.concatenate([np.asarray(kept, dtype=np.int64), fresh]))
        failed = pdf["label"].to_numpy() == 1
        t = us[failed]
        at = np.searchsorted(alerts, t - self.width, side="left")
        padded = np.append(alerts, np.iinfo(np.int64).max)
        hit = padded[at] < t
        self.state.update((alerts[alerts >= us[-1] - self.width].tolist(),))
        yield pd.DataFrame({
            "key": key[0], "line_id": pdf["line_id"][failed].to_numpy(),
            "dlt": np.where(hit, (t - np.where(hit, padded[at], t)) / SECOND, 0.0),
        })


class Memory(_Keyed):
    """kNN distance to the last ``capacity`` vectors of the key; null until there are k."""

    state_schema = "n long, dim int, vectors binary"
    fields = {"vec": "array<double>"}

    def __init__(
        self, capacity: int = 128, k: int = 10, aggregate: str = "mean", idle_ms: int | None = None, wait: bool = False,
    ):
        super().__init__(idle_ms, wait)
        self.capacity, self.k, self.aggregate = capacity, k, aggregate

    def advance(self, key, pdf):
        fresh = np.stack(pdf["vec"].to_numpy()).astype(np.float64)
        n, dim, raw = self.read((0, fresh.shape[1], b""))
        old = np.frombuffer(raw, dtype=np.float64).reshape(-1, dim) if raw else np.empty((0, dim))
        x = np.vstack([old, fresh])
        pos = np.arange(n - len(old), n + len(fresh))
        lo, size = _starts(pos, self.capacity)
        own = np.arange(len(old), len(x))
        found = _nearest(x, lo, size, own, self.k, self.aggregate)
        keep = x[-self.capacity:]
        self.state.update((int(n + len(fresh)), int(dim), keep.tobytes()))
        yield pd.DataFrame({"key": key[0], "line_id": pdf["line_id"], "distance": found})


class SessionMemory(_Keyed):
    """Cosine or Mahalanobis distance to the last ``capacity`` vectors of the key, or their statistics.

    The state holds those vectors and, for ``mahalanobis``, the last inverse covariance, which is
    renewed every ``refresh`` rows as in the batch operator.  Rows are worked on in stretches of
    bounded length, and the moments of a row's memory come from sums over the ends of two stretches,
    so no sum is ever updated by taking rows out of it.  ``statistics`` gives ``n, mean,
    total_variance``, the other two ``distance`` (NaN until there are ``min_samples`` vectors).
    Rows without a vector are left out.
    """

    state_schema = "n long, dim int, vectors binary, made_at long, inverse binary"
    fields = {"vec": "array<double>"}
    stretch = 4096

    def __init__(
        self, metric: str = "mahalanobis", capacity: int = 128, min_samples: int = 10, refresh: int = 128, *,
        manual_shrinkage: float | None = None, idle_ms: int | None = None, wait: bool = False,
    ):
        super().__init__(idle_ms, wait)
        if metric not in SESSION_MEMORY:
            raise ValueError(f"unknown metric: {metric} (one of {sorted(SESSION_MEMORY)})")
        self.metric, self.capacity, self.min_samples = metric, capacity, min_samples
        self.refresh, self.manual_shrinkage = refresh, manual_shrinkage

    def advance(self, key, pdf):
        pdf = pdf[pdf["vec"].notna()]
        if not len(pdf):
            return
        n, dim, raw, made_at, inverse = self.read((0, len(pdf["vec"].iloc[0]), b"", -1, b""))
        x = np.frombuffer(raw, dtype=np.float64).reshape(-1, dim)
        known = (made_at, np.frombuffer(inverse, dtype=np.float64).reshape(dim, dim)) if inverse else None
        for at in range(0, len(pdf), self.stretch):
            rows = pdf.iloc[at:at + self.stretch]
            old = len(x)
            x = np.vstack([x, np.stack(rows["vec"].to_numpy()).astype(np.float64)])
            pos, own = np.arange(n - old, n - old + len(x)), np.arange(old, len(x))
            out, known = self._found(x, pos, own, known)
            yield pd.concat([
                pd.DataFrame({"key": key[0], "line_id": rows["line_id"].to_numpy()}), out.reset_index(drop=True),
            ], axis=1)
            n += len(rows)
            x = x[-self.capacity:]
        made_at, inverse = (known[0], known[1].tobytes()) if known else (-1, b"")
        self.state.update((int(n), int(dim), x.tobytes(), int(made_at), inverse))

    def _found(self, x, pos, own, known):
        if self.metric == "statistics":
            return statistics_of(x, pos, own, self.capacity), None
        if self.metric == "cosine":
            return pd.DataFrame({"distance": cosine_of(x, pos, own, self.capacity, self.min_samples)}), None
        far, known = mahalanobis_of(
            x, pos, own, self.capacity, self.min_samples, self.refresh, self.manual_shrinkage, known=known)
        return pd.DataFrame({"distance": far}), known


#: What ``SessionMemory`` gives for each row, by metric.
SESSION_MEMORY = {
    "cosine": "distance double", "mahalanobis": "distance double",
    "statistics": "n long, mean array<double>, total_variance double",
}


class AnchoredGroups(_Keyed):
    """Anchored alert groups; an open group is closed by the next alert or once the watermark has left it."""

    state_schema = "start long, stop long, n long, top double, total double"
    fields = {"score": "double"}

    def __init__(self, threshold: float, width_seconds: int, wait: bool = False):
        super().__init__(None, wait)
        self.threshold, self.width = threshold, width_seconds * SECOND

    def _row(self, key, group) -> pd.DataFrame:
        start, stop, n, top, total = group
        return pd.DataFrame({
            "key": [key[0]], "window_start": [start], "window_end": [stop], "alert_count": [n],
            "max_score": [top], "mean_score": [total / n],
        })

    def advance(self, key, pdf):
        pdf = pdf[pdf["score"] > self.threshold]
        group = self.read(()) or None
        for us, score in zip(pdf["us"].tolist(), pdf["score"].tolist()):
            if group is not None and us - group[0] <= self.width:
                start, stop, n, top, total = group
                group = (start, max(stop, us), n + 1, max(top, score), total + score)
            else:
                if group is not None:
                    self.handle.deleteTimer(self._due(group[0]))
                    yield self._row(key, group)
                group = (us, us, 1, score, score)
                self.handle.registerTimer(self._due(us))
        if group is not None:
            self.state.update(group)

    def settle(self, key, passed):
        group = self.read(()) or None
        if group is not None and self._due(group[0]) * 1000 <= passed:
            self.state.clear()
            yield self._row(key, group)

    def _due(self, start: int) -> int:
        return (start + self.width) // 1000 + 1

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if self.wait:
            yield from self._release(key, timerValues)
        else:
            yield from self.settle(key, expiredTimerInfo.getExpiryTimeInMs() * 1000)


class _Value:
    """A value state that is held in memory while the keys of a bucket are worked on."""

    def __init__(self, value: tuple | None = None):
        self.value = value

    def exists(self) -> bool:
        return self.value is not None

    def get(self) -> tuple | None:
        return self.value

    def update(self, value: tuple) -> None:
        self.value = tuple(value)

    def clear(self) -> None:
        self.value = None


class _Timers:
    """The timers that the keys of a bucket ask for; one is set for all of them."""

    def __init__(self):
        self.due: set[int] = set()

    def registerTimer(self, at: int) -> None:
        self.due.add(at)

    def deleteTimer(self, at: int) -> None:
        self.due.discard(at)


class _Buckets(StatefulProcessor):
    """Runs a waiting processor for many keys at a time.

    A key of its own costs several calls to the state and a frame per micro-batch.  A bucket reads the
    rows and values of its keys once, works on those that have rows to release and writes them back.
    """

    def __init__(self, processor: _Keyed):
        self.processor = processor

    def init(self, handle: StatefulProcessorHandle) -> None:
        inner = self.processor
        self.handle = handle
        kinds = {"key": "long", "us": "long", "line_id": "long", **inner.fields}
        self.columns = list(kinds)
        self.waiting = handle.getListState("waiting", ", ".join(f"{c} {k}" for c, k in kinds.items()))
        self.kept = handle.getListState("kept", f"key long, due long, {inner.state_schema}")

    def handleInputRows(self, key, rows, timerValues):
        fresh = []
        for pdf in rows:
            columns = [[None if v is None or v != v else v for v in pdf[c].tolist()] if c == "key" else pdf[c].tolist() for c in self.columns]
            columns[0] = [None if k is None else int(k) for k in columns[0]]
            fresh += zip(*columns)
        yield from self._release(fresh, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        yield from self._release([], timerValues)

    def _release(self, fresh: list[tuple], timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        rows = [*(tuple(r) for r in self.waiting.get()), *fresh]
        kept = {r[0]: (r[1], tuple(r[2:])) for r in (tuple(r) for r in self.kept.get())}
        due: dict = {}
        rest = []
        for r in rows:
            if r[1] < passed:
                due.setdefault(r[0], []).append(r[1:])
            else:
                rest.append(r)
        late = {k for k, (at, _) in kept.items() if at is not None and at * 1000 <= passed}
        out = []
        for k in [*due, *(late - due.keys())]:
            out += self._one(k, sorted(due.get(k, ()), key=lambda r: r[:2]), kept, passed)
        if due or late:
            self._put(self.kept, [(k, at, *value) for k, (at, value) in kept.items()])
        if fresh or due:
            self._put(self.waiting, rest)
        times = [at for at, _ in kept.values() if at is not None]
        if rest:
            times.append(min(r[1] for r in rest) // 1000 + 1)
        if times:
            self.handle.registerTimer(min(times))
        if out:
            yield pd.concat(out, ignore_index=True)

    def _one(self, key, rows: list[tuple], kept: dict, passed: int) -> list[pd.DataFrame]:
        inner = self.processor
        at, value = kept.get(key, (None, None))
        inner.state, inner.handle = _Value(value), _Timers()
        if at is not None:
            inner.handle.registerTimer(at)
        out = []
        if rows:
            out += inner.advance((key,), pd.DataFrame(rows, columns=self.columns[1:]))
        out += inner.settle((key,), passed)
        if inner.state.exists():
            kept[key] = (max(inner.handle.due, default=None), inner.state.get())
        else:
            kept.pop(key, None)
        return [f for f in out if len(f)]

    @staticmethod
    def _put(state, rows: list[tuple]) -> None:
        if rows:
            state.put(rows)
        else:
            state.clear()

    def close(self) -> None:
        self.processor.close()


def bucketed(
    stream: DataFrame, processor: _Keyed, schema: str | StructType, *, buckets: int = 512, mode: str = "append",
) -> DataFrame:
    """``stateful`` for a processor that waits, on a long ``key`` with many values: a state per bucket of keys."""
    dealt = stream.withColumn("_bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)))
    return dealt.groupBy("_bucket").transformWithStateInPandas(
        statefulProcessor=_Buckets(processor), outputStructType=schema, outputMode=mode, timeMode="EventTime"
    )


def stateful(
    stream: DataFrame, processor: StatefulProcessor, schema: str | StructType, *,
    keys: Sequence[str] = ("key",), time_mode: str = "None", mode: str = "append",
) -> DataFrame:
    """Run a processor per key (``ProcessingTime`` when its state has an idle time, ``EventTime`` when rows wait)."""
    return stream.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=schema, outputMode=mode, timeMode=time_mode
    )
