"""Rows that travel packed: a task sends one binary value a partition, holding all its rows meant for it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from prosemill.llm._text import mix

SCHEMA = "p int, kind int, data binary"


def partitions(df: DataFrame) -> int:
    """Partitions of a packed shuffle: as many as the session's setting says."""
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def pack(table: pa.Table, p, kind: int, compression: str | None = "zstd") -> pa.RecordBatch:
    """(p, kind, data) of a table's rows: one for each partition that occurs in ``p``."""
    p = np.asarray(p).astype(np.int32)
    order = np.argsort(p.astype(np.uint16) if len(p) and p.max() < 1 << 16 else p, kind="stable")
    table, p = table.take(pa.array(order)).combine_chunks(), p[order]
    at = np.flatnonzero(np.append(True, p[1:] != p[:-1])) if len(p) else np.zeros(0, np.int64)
    options = pa.ipc.IpcWriteOptions(compression=compression)
    data = []
    for a, b in zip(at.tolist(), [*at[1:].tolist(), len(p)]):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema, options=options) as w:
            w.write_table(table.slice(a, b - a))
        data.append(sink.getvalue().to_pybytes())
    return pa.record_batch([pa.array(p[at]), pa.array(np.full(len(at), kind, np.int32)), pa.array(data, pa.binary())], ["p", "kind", "data"])


def tables(batches):
    """(kind, table) of each packed value, one by one."""
    for b in batches:
        for kind, data in zip(b.column(1).to_pylist(), b.column(2)):
            yield kind, pa.ipc.open_stream(data.as_buffer()).read_all()


def unpack(batches) -> dict[int, pa.Table]:
    """All rows by kind."""
    out: dict[int, list] = {}
    for kind, t in tables(batches):
        out.setdefault(kind, []).append(t)
    return {k: pa.concat_tables(v).combine_chunks() for k, v in out.items()}


class Held:
    """Tables with their partitions that are packed together once they make up ``limit`` bytes."""

    def __init__(self, kind: int, compression: str | None = "zstd", limit=1 << 24):
        self.kind, self.compression, self.limit, self.size, self.parts = kind, compression, limit, 0, []

    def add(self, table: pa.Table, p):
        """The packed rows, if it is time."""
        self.parts.append((table, np.asarray(p)))
        self.size += table.nbytes
        if self.size >= self.limit:
            yield from self.rest()

    def rest(self):
        if self.parts:
            yield pack(pa.concat_tables([t for t, _ in self.parts]), np.concatenate([p for _, p in self.parts]), self.kind, self.compression)
            self.parts, self.size = [], 0


def spread(a, parts):
    """A partition for each number."""
    with np.errstate(over="ignore"):
        return ((mix(a.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)


def sent(parts, kind):
    """A function of rows: the same, packed by their first column."""

    def run(batches):
        held = Held(kind)
        for b in batches:
            if b.num_rows:
                yield from held.add(pa.Table.from_batches([b]), spread(b.column(0).to_numpy(), parts))
        yield from held.rest()

    return run


def wished(batches):
    """(table of all wishes, rows by their first column, packed others one by one), wishes being kind 0 and coming first."""
    wishes, by = [], {}
    for kind, t in tables(batches):
        if not kind:
            wishes.append(t)
            continue
        if wishes is not None:
            if not wishes:
                return
            wish, wishes = pa.concat_tables(wishes).combine_chunks(), None
            key = wish.column(0).to_numpy()
            order = np.argsort(key, kind="stable")
            at = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1]))
            by = dict(zip(key[order][at].tolist(), np.split(order, at[1:])))
        yield wish, by, t
