"""The tokens of whole Arrow columns in NumPy, for tasks that count them where texts are read."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .text import STOPWORDS

_LATIN = np.zeros(256, bool)
_LATIN[list(b"abcdefghijklmnopqrstuvwxyz0123456789-+.")] = True
_SPAN = re.compile("[一-鿿]+")
#: First bytes of the characters in spans (and of a few others).
_SPAN_BYTES = (0xE4, 0xE9)


def pooled(batches: Iterable[pa.RecordBatch], least: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `least` bytes or more."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= least:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, of which none is null, and where each begins and the last one ends."""
    n, (_, ends, data) = len(texts), texts.buffers()
    ends = np.frombuffer(ends, np.int32)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int32)
    data = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data else np.zeros(0, np.uint8)
    return data, (ends - ends[0]).astype(np.int64)


def _bounds(inside: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of true begin and end; none goes over a cut."""
    before = np.concatenate([[False], inside[:-1]])
    before[cuts[cuts < len(inside)]] = False
    after = np.concatenate([inside[1:], [False]])
    after[cuts[cuts > 0] - 1] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def _grams(text: str) -> list[str]:
    return [span[i : i + n] for span in _SPAN.findall(text) for n in (2, 3, 4) for i in range(len(span) - n + 1)]


def coded(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Of lower-cased texts, functions.text.tokenize of each: the distinct tokens of all (and stop words, which nothing refers
    to), and for each token its place among these and its row, rows in order."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    n, (data, ends) = len(texts), buffers(texts)
    inside = _LATIN[data]
    start, stop = _bounds(inside, ends)
    places = np.concatenate([[0], np.cumsum(stop - start)]).astype(np.int32)
    latin = pa.StringArray.from_buffers(len(start), pa.py_buffer(places), pa.py_buffer(data[inside]))
    row = np.repeat(np.arange(n), np.diff(np.searchsorted(start, ends)))
    cut = np.flatnonzero((data >= _SPAN_BYTES[0]) & (data <= _SPAN_BYTES[1]))
    if len(cut):
        rows = np.unique(np.searchsorted(ends, cut, side="right") - 1)
        grams = [_grams(t) for t in texts.take(pa.array(rows)).to_pylist()]
        latin = pa.concat_arrays([latin, pa.array([g for found in grams for g in found], pa.string())])
        row = np.concatenate([row, np.repeat(rows, [len(found) for found in grams])])
        order = np.argsort(row, kind="stable")
        latin, row = latin.take(pa.array(order)), row[order]
    token = latin.dictionary_encode()
    code = token.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    kept = ~pc.is_in(token.dictionary, value_set=pa.array(STOPWORDS)).to_numpy(zero_copy_only=False)[code]
    return token.dictionary, code[kept], row[kept]
