"""Words as 64-bit hashes, inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash


def word_hashes(text: str | None) -> np.ndarray:
    """The 64-bit hashes of a text's words, in order: runs of anything but U+0020 and U+0009 to U+000D, A-Z lower-cased."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []  # of bytes: ASCII only
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, n: int) -> np.ndarray:
    """The distinct n-word shingles of a text as sorted hashes: the whole sequence as one for fewer words, none for none."""
    h = word_hashes(text)
    if not len(h):
        return h
    k = min(n, len(h))
    x = np.full(len(h) - k + 1, k, dtype=np.uint64)
    for i in range(k):
        x = mix(x * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - k + 1 + i])
    return np.unique(x)


def slices(texts: pa.Array, size: int = 4_000_000) -> Iterator[tuple[int, pa.Array]]:
    """A batch's texts in slices of about so many bytes, or one longer text, each with the number of its first row."""
    ends, at = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)), 0
    while at < len(texts):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, side="right")))
        yield at, texts.slice(at, stop - at)
        at = stop


def with_ids(b: pa.RecordBatch) -> Iterator[tuple[pa.Array, list]]:
    """A batch of (id, text) in slices, so that a task's arrays stay small."""
    for at, part in slices(b.column(1)):
        yield b.column(0).slice(at, len(part)), part.to_pylist()


def runs(batches: Iterator[pa.RecordBatch], n_keys: int = 1) -> Iterator[pa.RecordBatch]:
    """Batches of sorted rows, cut so that rows with equal first ``n_keys`` columns are in one batch."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        change = np.zeros(b.num_rows - 1, dtype=bool)
        for c in b.columns[:n_keys]:
            v = c.to_numpy(zero_copy_only=False)
            change |= v[1:] != v[:-1]
        at = np.flatnonzero(change)
        goes_on = bool(held) and all(held[-1].column(i)[-1] == b.column(i)[0] for i in range(n_keys))
        if held and not goes_on:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held = []
        if len(at):
            cut = int(at[-1]) + 1
            yield from pa.Table.from_batches([*held, b.slice(0, cut)]).combine_chunks().to_batches()
            held = [b.slice(cut)]
        else:
            held.append(b)
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def bounds(keys: list[np.ndarray]) -> np.ndarray:
    """Where runs of equal keys begin, and the end."""
    change = np.zeros(len(keys[0]) - 1, dtype=bool)
    for v in keys:
        change |= v[1:] != v[:-1]
    return np.concatenate([[0], np.flatnonzero(change) + 1, [len(keys[0])]])
