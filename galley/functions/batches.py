"""Arrow batches in shares: as Python objects, values take several times their bytes."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that a task holds as objects; a longer text stands alone.
HELD = 4 << 20


def few[B: (pa.Array, pa.RecordBatch)](batches: Iterator[B], text: str | None = None) -> Iterator[B]:
    """Arrays of texts, or batches by their column of texts, as shares of so many bytes, in order and without copying."""
    for batch in batches:
        begin = held = 0
        for i, n in enumerate(pc.binary_length(batch if text is None else batch.column(text)).fill_null(0).to_numpy().tolist()):
            if i > begin and held + n > HELD:
                yield batch.slice(begin, i - begin)
                begin, held = i, 0
            held += n
        if len(batch) > begin:
            yield batch.slice(begin)
