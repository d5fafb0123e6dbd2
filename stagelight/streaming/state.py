"""Keyed state of the incremental operators: one small processor per question, run by ``transformWithStateInPandas``.

A batch loads and writes the state of its own keys only; every look at it is a call out of Python, so a value is asked for once
and not written where it can't change anything. Rows reach a processor in Arrow batches, never as a whole group.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import ArrayType, IntegralType, StructField, StructType

#: Keyed processors need RocksDB; a batch then writes its changes, not a snapshot of the state.
_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


@contextmanager
def keyed_state(spark: SparkSession):
    """Queries started inside use the settings that keyed processors need; the session's own are put back."""
    was = {k: spark.conf.get(k, None) for k in _SETTINGS}
    for k, v in _SETTINGS.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def plainly_named(df: DataFrame) -> tuple[DataFrame, list[Column]]:
    """Columns c0, c1, ... as a processor takes them, and the columns that turn them back.

    Whole numbers pass as strings, since pandas turns those beside a NULL into floats; row names must not start with an underscore.
    """
    whole = [isinstance(f.dataType, IntegralType) for f in df.schema]
    plain = df.select(*[(F.col(c).cast("string") if w else F.col(c)).alias(f"c{i}") for i, (c, w) in enumerate(zip(df.columns, whole))])
    return plain, [F.col(f"c{i}").cast(f.dataType).alias(f.name) for i, f in enumerate(df.schema)]


class UnfinishedRows(StatefulProcessor):
    """Rows of keys that no earlier batch finished; a true value in the column ``done`` finishes its key after this batch."""

    def __init__(self, done: str):
        self.done = done

    def init(self, handle) -> None:
        self.finished = handle.getValueState("finished", "yes BOOLEAN")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if self.finished.exists():
            return
        done = False
        for part in rows:
            done = done or bool(part[self.done].any())
            yield part
        if done:
            self.finished.update((True,))

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.finished.update((True,))


def unfinished_rows(stream: DataFrame, keys: list[str], done: Column, finished: DataFrame | None = None) -> DataFrame:
    """Rows of the stream whose key was not finished by an earlier batch, with ``_done`` (NULL is false); ``finished`` has keys to start with."""
    marked = stream.withColumn("_done", F.coalesce(done, F.lit(False)))
    plain, back = plainly_named(marked)
    own = [f"c{marked.columns.index(k)}" for k in keys]
    first = None
    if finished is not None:
        known = finished.select(*[F.col(k).cast(stream.schema[k].dataType) for k in keys]).distinct()
        first = plainly_named(known)[0].toDF(*own).groupBy(*own)
    return plain.groupBy(*own).transformWithStateInPandas(UnfinishedRows(f"c{len(marked.columns) - 1}"), plain.schema, "append", "none", first).select(*back)


def rows_of_new_keys(stream: DataFrame, keys: list[str], known: DataFrame | None = None) -> DataFrame:
    """Rows of keys that no earlier batch had and that are not in ``known``.

    The rows of a key in one batch become one row, and Spark drops repeats of the key by its own state: no call out of Python for a key.
    A task holds its part of a batch at once.
    """
    if known is not None:
        k = known.select(*[F.col(c).cast(stream.schema[c].dataType).alias(f"_{c}") for c in keys]).distinct()
        on = [stream[c].eqNullSafe(k[f"_{c}"]) for c in keys]
        stream = stream.join(k, on, "left_anti")
    rest = [c for c in stream.columns if c not in keys] or keys
    kinds = StructType([stream.schema[c] for c in rest])

    def together(batches):
        t = pa.Table.from_batches(list(batches)).combine_chunks()
        code = np.zeros(len(t), np.int64)
        for c in keys:
            d = t[c].combine_chunks().dictionary_encode()
            code = code * (len(d.dictionary) + 1) + d.indices.fill_null(len(d.dictionary)).to_numpy(zero_copy_only=False)
            code = np.unique(code, return_inverse=True)[1]
        order = np.argsort(code, kind="stable")
        start = np.flatnonzero(np.concatenate(([True], np.diff(code[order]) > 0)))
        own, others = t.select(keys).take(order[start]), t.select(rest).take(order)
        held = pa.StructArray.from_arrays([c.combine_chunks() for c in others.columns], fields=list(others.schema))
        lists = pa.ListArray.from_arrays(pa.array(np.append(start, len(order)), pa.int32()), held)
        yield pa.RecordBatch.from_arrays([*[c.combine_chunks() for c in own.columns], lists], names=[*keys, "_rows"])

    def run(batches):
        batches = [b for b in batches if b.num_rows]
        if batches:
            yield from together(batches)

    one = stream.repartition(*keys).mapInArrow(run, StructType([*[stream.schema[c] for c in keys], StructField("_rows", ArrayType(kinds))]))
    new = one.dropDuplicates(keys).select(*keys, F.explode("_rows").alias("_row"))
    return new.select(*[F.col(f"_row.{c}").alias(c) if c in rest else F.col(c) for c in stream.columns])


class StableSize(StatefulProcessor):
    """(path, size, tick) when a path's size equals that of the observation before and is not zero; once a path."""

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle) -> None:
        self.state = handle.getValueState("last", "size LONG, done BOOLEAN", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last, done = self.state.get() or (-1, False)
        if done and self.ttl_ms is None:
            return
        tick, size = (np.concatenate(c) for c in zip(*[(r["tick"].to_numpy(), r["size"].to_numpy()) for r in rows]))
        order = np.argsort(tick, kind="stable")
        tick, size = tick[order], size[order]
        same = np.flatnonzero((size == np.concatenate(([last], size[:-1]))) & (size > 0))
        self.state.update((int(size[-1]), bool(done or len(same))))
        if len(same) and not done:
            yield pd.DataFrame({"path": [key[0]], "size": [size[same[0]]], "tick": [tick[same[0]]]})


class CountUp(StatefulProcessor):
    """The key, once, when its rows of all batches have reached the number in a column; state is the number of rows, -1 when told."""

    def __init__(self, key: str, wanted: str):
        self.key, self.wanted = key, wanted

    def init(self, handle) -> None:
        self.seen = handle.getValueState("seen", "n LONG")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        n = (self.seen.get() or (0,))[0]
        if n < 0:
            return
        for part in rows:
            n, wanted = n + len(part), part[self.wanted].iloc[0]
        self.seen.update((-1 if n >= wanted else n,))
        if n >= wanted:
            yield pd.DataFrame({self.key: [key[0]]})


class EnoughRows(StatefulProcessor):
    """All rows of a key, once, in the batch after which there are enough; until then they wait in the key's state."""

    def __init__(self, key: str, columns: list[str], schema: StructType, least: int):
        self.key, self.columns, self.schema, self.least = key, columns, schema, least

    def init(self, handle) -> None:
        self.waiting = handle.getListState("waiting", self.schema)
        self.count = handle.getValueState("count", "n LONG")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        n = (self.count.get() or (0,))[0]
        if n < 0:
            return
        held: list[pd.DataFrame] = []
        for part in rows:
            n += len(part)
            if n < self.least:
                held.append(part)
                continue
            if self.waiting.exists():
                yield pd.DataFrame(list(self.waiting.get()), columns=self.columns).assign(**{self.key: key[0]})
                self.waiting.clear()
            yield from held
            held = []
            yield part
        for part in held:
            self.waiting.appendList([tuple(None if pd.isna(v) else v for v in r) for r in part[self.columns].itertuples(index=False)])
        self.count.update((-1 if n >= self.least else n,))


class FixedRange(StatefulProcessor):
    """(group, lo, hi) once a group has enough different tiles; until then state holds the tiles' ids and the range so far."""

    def __init__(self, group: str, least: int):
        self.group, self.least = group, least

    def init(self, handle) -> None:
        self.state = handle.getValueState("range", "tiles ARRAY<STRING>, lo DOUBLE, hi DOUBLE, fixed BOOLEAN")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        tiles, lo, hi, fixed = self.state.get() or ([], None, None, False)
        if fixed:
            return
        tiles = set(tiles)
        for part in rows:
            tiles.update(part["tile_id"].dropna())
            low, high = part["v"].min(), part["v"].max()
            if not pd.isna(low):
                lo, hi = (low, high) if lo is None else (min(lo, low), max(hi, high))
        fixed = len(tiles) >= self.least
        self.state.update(([] if fixed else sorted(tiles), None if lo is None else float(lo), None if hi is None else float(hi), fixed))
        if fixed:
            yield pd.DataFrame({self.group: [key[0]], "lo": [lo], "hi": [hi]})
