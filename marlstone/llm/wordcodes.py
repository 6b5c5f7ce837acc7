"""Words of a batch of texts as numbers, without a Python object a word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of texts one after another, and where each ends; null is empty."""
    flat = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset : flat.offset + len(flat) + 1]
    data = np.frombuffer(flat.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets[1:] - offsets[0]


def coded_words(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """``(codes, word_ends, dictionary)``: a number for each word, where each text's words end, and the distinct words."""
    inside = ~_IS_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begins = np.concatenate([[0], ends[:-1]])
    begins = begins[begins < len(data)]
    first[begins] = inside[begins]
    starts = np.flatnonzero(first)
    kept = data[inside]
    offsets = np.append((np.cumsum(inside) - 1)[starts], len(kept)).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(kept)])
    coded = words.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.searchsorted(starts, ends), coded.dictionary


def portions(batches: Iterator[pa.RecordBatch], text_at: int, pack_bytes: int) -> Iterator[pa.RecordBatch]:
    """Rows whose texts make ``pack_bytes`` or, where one text is longer, that text; texts as 64-bit strings."""
    held, size = [], 0
    for batch in batches:
        length = np.diff(np.append(0, text_bytes(batch.column(text_at))[1]))
        total, begin = np.cumsum(length), 0
        while begin < batch.num_rows:
            before = int(total[begin - 1]) if begin else 0
            end = min(batch.num_rows, max(begin + 1, int(np.searchsorted(total, before + pack_bytes - size, "right"))))
            held.append(batch.slice(begin, end - begin))
            size += int(total[end - 1]) - before
            begin = end
            if size >= pack_bytes:
                yield _joined(held, text_at)
                held, size = [], 0
    if held:
        yield _joined(held, text_at)


def _joined(held: list[pa.RecordBatch], text_at: int) -> pa.RecordBatch:
    schema = held[0].schema
    schema = schema.set(text_at, schema.field(text_at).with_type(pa.large_string()))
    table = pa.Table.from_batches([b.cast(schema) for b in held]).combine_chunks()
    return table.to_batches()[0] if table.num_rows else pa.RecordBatch.from_pylist([], schema)
