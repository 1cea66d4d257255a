"""SHA-256 of groups of sorted numbers, one stream a partition."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def id_digests(rows: DataFrame, by: list[str], key: str) -> DataFrame:
    """(by, n, sha256): of each group's distinct or repeated ``key``s (bigint), ascending, as little-endian int64.

    Rows come sorted by group and key; the state of the running hash goes from batch to batch, so
    that no group is held. A hash is a chain: one task reads a group's keys, eight bytes each. Null
    keys are left out; groups without any other key are absent.
    """
    kinds = dict(rows.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in by), "n bigint", "sha256 string"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, n, state, types = None, 0, None, None
        for batch in batches:
            if not len(batch):
                continue
            types = [batch.schema.field(c).type for c in by]
            values = batch[key].to_numpy().astype("<i8")
            new = np.zeros(len(batch), bool)
            new[0] = True
            for c in by:
                code = batch[c].dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
                new[1:] |= code[1:] != code[:-1]
            starts = np.flatnonzero(new)
            for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(batch)], strict=True):
                group = tuple(batch[c][lo].as_py() for c in by)
                if state is None or group != now:
                    if state is not None:
                        yield row(now, n, state, types)
                    now, n, state = group, 0, hashlib.sha256()
                state.update(np.ascontiguousarray(values[lo:hi]))
                n += hi - lo
        if state is not None:
            yield row(now, n, state, types)

    def row(group: tuple, n: int, state, types) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(pa.array([x], t) for x, t in zip(group, types, strict=True)), pa.array([n], pa.int64()), pa.array([state.hexdigest()])], names=[*by, "n", "sha256"])

    asked = rows.filter(f"`{key}` is not null").select(*by, key)
    dealt = asked.repartition(*by) if by else asked.coalesce(1)
    return dealt.sortWithinPartitions(*by, key).mapInArrow(digest, schema)
