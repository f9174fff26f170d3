"""NumPy arithmetic on one Arrow batch of sparse examples.

Spark decides which batch is where; these helpers only do the arithmetic inside
a task. A batch is ``(labels, offsets, indices, values)`` in compressed-row form.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

# Fixed value: stored entries per packed block, 2**22 of 12 or 16 bytes each.
BLOCK_ENTRIES = 1 << 22
# Sums in a slice, 2 MiB.
SLICE = 1 << 18


@dataclass
class Batch:
    labels: np.ndarray
    offsets: np.ndarray
    indices: np.ndarray
    values: np.ndarray

    @property
    def owner(self) -> np.ndarray:
        """The row each stored entry belongs to."""
        return np.repeat(np.arange(len(self.labels)), np.diff(self.offsets))

    def dot(self, w: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """X w; a feature beyond ``w`` counts 0, as one without weight does."""
        if self.indices.max(initial=-1) < len(w):
            products = self.values * w[self.indices]
        else:
            known = self.indices < len(w)
            products = np.zeros(len(self.values))
            products[known] = self.values[known] * w[self.indices[known]]
        return np.bincount(owner, weights=products, minlength=len(self.labels))

    def add_transposed(self, r: np.ndarray, owner: np.ndarray, out: np.ndarray) -> None:
        """out += Xᵀ r, touching only stored entries when the matrix is wide."""
        contributions = self.values * r[owner]
        if len(out) <= 4 * len(contributions):
            out += np.bincount(self.indices, weights=contributions, minlength=len(out))
        else:
            np.add.at(out, self.indices, contributions)


def _list_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets from 0 and the flat values of a list column."""
    offsets = column.offsets.to_numpy()
    flat = column.values.slice(offsets[0], offsets[-1] - offsets[0])
    return offsets - offsets[0], flat.to_numpy(zero_copy_only=False)


def from_rows(batch: pa.RecordBatch) -> Batch:
    offsets, indices = _list_parts(batch.column("indices"))
    _, values = _list_parts(batch.column("values"))
    labels = batch.column("label").to_numpy(zero_copy_only=False)
    return Batch(labels, offsets.astype(np.int64), indices, values)


BLOCK_SCHEMA = "labels binary, offsets binary, indices binary, vals binary, top bigint"


_PACKED = pa.schema([*((n, pa.binary()) for n in ("labels", "offsets", "indices", "vals")), ("top", pa.int64())])


def narrow(indices: np.ndarray) -> np.ndarray:
    """In 32 bits where they fit."""
    return indices.astype(np.int32) if indices.max(initial=-1) < 1 << 31 else indices


def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows to raw-bytes blocks, which reach later passes without per-element conversion."""
    for record_batch in batches:
        b = from_rows(record_batch)
        start = 0
        while start < len(b.labels):
            # As many whole rows as fit, at least one.
            stop = max(start + 1, int(np.searchsorted(b.offsets, b.offsets[start] + BLOCK_ENTRIES, "right")) - 1)
            lo, hi = b.offsets[start], b.offsets[stop]
            yield pa.RecordBatch.from_pydict({
                "labels": [b.labels[start:stop].tobytes()],
                "offsets": [(b.offsets[start:stop + 1] - lo).tobytes()],
                "indices": [narrow(b.indices[lo:hi]).tobytes()],
                "vals": [b.values[lo:hi].tobytes()],
                "top": [int(b.indices[lo:hi].max(initial=-1))],
            }, schema=_PACKED)
            start = stop


def from_blocks(record_batch: pa.RecordBatch) -> Iterator[Batch]:
    columns = [record_batch.column(n) for n in ("labels", "offsets", "indices", "vals")]
    for i in range(record_batch.num_rows):
        labels, offsets, indices, values = (c[i].as_buffer() for c in columns)
        kind = np.int32 if indices.size * 2 == values.size else np.int64
        yield Batch(*(np.frombuffer(x, dtype=k) for x, k in zip((labels, offsets, indices, values), (np.float64, np.int64, kind, np.float64))))


SLICES = "part int, z binary"


def slices_of(total: np.ndarray, size: int) -> Iterator[pa.RecordBatch]:
    """A task's sums, a record for each range of ``size`` that has any."""
    for at in range(0, len(total), size):
        z = total[at:at + size]
        if z.any():
            yield pa.RecordBatch.from_pydict({"part": pa.array([at // size], pa.int32()), "z": [z.tobytes()]})


def add_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The slices of equal ranges added up, whatever their order: a task holds the sums of its own ranges only."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, z in zip(batch.column("part").to_pylist(), batch.column("z")):
            z = np.frombuffer(z.as_buffer())
            if part in sums:
                sums[part] += z
            else:
                sums[part] = z.copy()
    for part, z in sums.items():
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "z": [z.tobytes()]})
