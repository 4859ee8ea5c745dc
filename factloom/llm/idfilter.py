"""A fixed-size, one-sided filter of ids, to read large rows only where a later join needs them.

It says "maybe" for every id of the set, so a join after it is exact.  Its size is a
parameter, not a function of the data: with more ids than it has room for it lets more rows
through, which costs shuffle, never results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .textcore import mix

#: log2 of the number of bits, unless another is given: 2 MB, whatever the input.
BITS = 24
_PAGE = 4096


def _slot(ids: np.ndarray, width: int) -> np.ndarray:
    return (mix(ids.astype(np.int64).view(np.uint64)) >> np.uint64(64 - width)).astype(np.int64)


class IdFilter:
    """Built from ids (one column of longs; nulls are left out), which must be cheap to compute.  Usable in tasks."""

    def __init__(self, ids: DataFrame, width: int = BITS):
        self.width = width

        def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = np.zeros(1 << width, dtype=bool)
            for b in batches:
                col = b.column(0).drop_null()
                found[_slot(col.to_numpy(zero_copy_only=False), width)] = True
            packed = np.packbits(found).reshape(-1, _PAGE)
            some = np.flatnonzero(packed.any(axis=1))
            if len(some):
                yield pa.RecordBatch.from_arrays([pa.array(some), pa.array([packed[i].tobytes() for i in some], pa.binary())], names=["page", "bits"])

        # each page is ORed by its own task, so to the driver comes one copy of each
        def merged(group: pa.Table) -> pa.Table:
            acc = np.zeros(_PAGE, dtype=np.uint8)
            for x in group.column("bits"):
                acc |= np.frombuffer(x.as_buffer(), dtype=np.uint8)
            return pa.table({"page": group.column("page").slice(0, 1), "bits": pa.array([acc.tobytes()], pa.binary())})

        pages = ids.mapInArrow(bits, "page long, bits binary").groupBy("page").applyInArrow(merged, "page long, bits binary").toArrow()
        table = np.zeros((1 << width) // 8, dtype=np.uint8).reshape(-1, _PAGE)
        for page, raw in zip(pages.column("page").to_pylist(), pages.column("bits"), strict=True):
            table[page] = np.frombuffer(raw.as_buffer(), dtype=np.uint8)
        self.shared = ids.sparkSession.sparkContext.broadcast(table.tobytes())

    def has(self, ids: np.ndarray) -> np.ndarray:
        """Whether each id may be in the set."""
        flat = np.frombuffer(self.shared.value, dtype=np.uint8)
        slot = _slot(ids, self.width)
        return (flat[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1 == 1

    def keep(self, rows: DataFrame, column: str = "doc_id") -> DataFrame:
        """Rows whose id may be in the set."""
        return self._part(rows, column, True)

    def drop(self, rows: DataFrame, column: str = "doc_id") -> DataFrame:
        """Rows whose id is surely not in the set; those without an id among them."""
        return self._part(rows, column, False)

    def _part(self, rows: DataFrame, column: str, inside: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                col = b.column(b.schema.get_field_index(column))
                hit = self.has(pc.fill_null(col, 0).to_numpy(zero_copy_only=False))
                hit &= col.is_valid().to_numpy(zero_copy_only=False)
                yield b.filter(pa.array(hit == inside))

        return rows.mapInArrow(run, rows.schema)


def maybe_in(rows: DataFrame, ids: DataFrame, column: str = "doc_id") -> DataFrame:
    """Rows whose id may be among ids (which has one column of that name)."""
    return IdFilter(ids.select(column)).keep(rows, column)
