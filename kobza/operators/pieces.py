"""Arrow functions over batches of texts, in pieces.

A batch holds up to 10,000 texts, whatever their lengths, and what is found in a text takes many times its memory as Python
objects. So texts become Python strings, and results Arrow arrays, a piece of a batch at a time: a task needs its batches as
Arrow data, and the objects of one piece.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are Python objects at once; a longer text is a piece of its own.
PIECE = 1 << 18


def pieces(texts: pa.Array, most: int | None = None) -> Iterator[pa.Array]:
    """The array in slices of at most so many bytes, in order; one text at least, and nothing for an array without rows."""
    most = PIECE if most is None else most
    first = held = 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
        if i > first and held + n > most:
            yield texts.slice(first, i - first)
            first, held = i, 0
        held += n
    if first < len(texts):
        yield texts.slice(first)
