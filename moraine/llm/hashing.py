"""Word hashes of whole batches, for operators that work in Arrow batches.

Words are split as bytes, so a word is a maximal run of other characters than
ASCII white space, whatever the encoding of its characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

MAX = np.uint64(0xFFFFFFFFFFFFFFFF)


class WordHashes(dict):
    """word -> 64-bit hash, remembered; forgets all when it has grown beyond `most` words."""

    def __init__(self, most: int = 500_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.most:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the finalizer of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def rolled(words: np.ndarray, width: int) -> np.ndarray:
    """The hash of each run of `width` consecutive words."""
    if len(words) < width:
        return np.empty(0, np.uint64)
    n = len(words) - width + 1
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(width):
            out *= np.uint64(0x9E3779B97F4A7C15)
            out += words[i : i + n]
        return mix(out)


def shingles(words: np.ndarray, width: int = 5) -> np.ndarray:
    """The shingles of one text, repeats included; a text of fewer words, but not none, has one."""
    if len(words) >= width:
        return rolled(words, width)
    return rolled(words, len(words)) if len(words) else np.empty(0, np.uint64)


def units(shingle: np.ndarray) -> np.ndarray:
    """Distinct values for a multiset: its n-th copy of a value gets n mixed in, so sets of units overlap as the multisets do."""
    s = np.sort(shingle)
    if len(s) < 2:
        return s
    new = np.empty(len(s), bool)
    new[0] = True
    np.not_equal(s[1:], s[:-1], out=new[1:])
    at = np.arange(len(s))
    nth = at - np.maximum.accumulate(np.where(new, at, 0))
    with np.errstate(over="ignore"):
        return np.sort(np.where(nth == 0, s, mix(s + nth.astype(np.uint64) * np.uint64(0xD1342543DE82EF95))))


def parts(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 2 << 20, most_rows: int = 400) -> Iterator[pa.RecordBatch]:
    """The batches in slices of bounded text, so a batch of long texts takes no more memory than one of short ones."""
    for batch in batches:
        texts = batch.column(column)
        lengths = np.asarray(pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_numpy(zero_copy_only=False))
        start = held = 0
        for i, n in enumerate(lengths.tolist()):
            if i > start and (held + n > most_bytes or i - start >= most_rows):
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < batch.num_rows:
            yield batch.slice(start)


def payloads(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """The UTF-8 bytes of a text column; a null is empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


#: A scrambled value of each byte at each of the first 1024 places of a word.
_SCRAMBLED = mix(np.arange(1 << 18, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))


def hashes_of(words: pa.Array) -> np.ndarray:
    """64-bit hashes of an array of strings: sums of scrambled (place, byte) pairs, all words at once."""
    ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    raw = words.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[ends[0] : ends[-1]] if raw is not None else np.empty(0, np.uint8)
    ends -= ends[0]
    lengths = np.diff(ends)
    pair = ((np.arange(len(data)) - np.repeat(ends[:-1], lengths)) << 8) | data
    with np.errstate(over="ignore"):
        if lengths.max(initial=0) <= 1024:
            value = _SCRAMBLED[pair]
        else:
            value = mix(pair.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
        upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value, dtype=np.uint64)])
        return mix(upto[ends[1:]] - upto[ends[:-1]] + lengths.astype(np.uint64))
