"""Hashes of strings that are the same in every process, and bit arrays over them, for whole Arrow batches at a time."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits that a bit array sets for one member.
MEMBER_BITS = 4
_FACTORS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def hash_strings(values: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string: a polynomial of its UTF-8 bytes, then mixed."""
    values = values.cast(pa.large_binary())
    offsets = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
    data = np.frombuffer(values.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]].astype(np.uint64) + np.uint64(1)
    starts, sizes = offsets[:-1] - offsets[0], np.diff(offsets)
    out = sizes.astype(np.uint64)
    with np.errstate(over="ignore"):
        for k in range(int(sizes.max(initial=0))):
            on = sizes > k
            out[on] = out[on] * np.uint64(0x9E3779B97F4A7C15) + data[starts[on] + k]
        out ^= out >> np.uint64(32)
        out *= np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
    return out


def hash_string(value: str) -> int:
    return int(hash_strings(pa.array([value]))[0])


def _positions(h: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    shift = np.uint64(64 - (bits.bit_length() - 1))
    with np.errstate(over="ignore"):
        for f in _FACTORS:
            x = h * f
            yield (x ^ (x >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) >> shift


def in_bits(h: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Whether each hash may be a member of the bit array: never false for a member."""
    on = np.ones(len(h), bool)
    for at in _positions(h, len(words) * 64):
        on &= (words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
    return on


def bit_size(members: int, per_member: int, at_most: int) -> int:
    """Bits for so many members: a power of 2 between 2**10 and at_most."""
    return min(at_most, max(1 << 10, 1 << max(0, members * per_member - 1).bit_length()))


def bit_arrays(hashes: DataFrame, sizes: dict[int, int]) -> dict[int, np.ndarray]:
    """The bit arrays of several sets at once. hashes: (part int, h long); sizes: bits of each part. Tasks set bits, the words are united by
    Spark, and what comes to the driver is the arrays themselves, so many bytes as `sizes` says."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, h = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            for p in np.unique(part).tolist():
                at = np.concatenate(list(_positions(h[part == p], sizes[p])))
                words, of = np.unique(at >> np.uint64(6), return_inverse=True)
                masks = np.zeros(len(words), np.uint64)
                np.bitwise_or.at(masks, of, np.uint64(1) << (at & np.uint64(63)))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(words), p, np.int32)), pa.array(words.astype(np.int64)), pa.array(masks.view(np.int64))], names=["part", "word", "mask"])

    got = hashes.mapInArrow(run, "part int, word long, mask long").groupBy("part", "word").agg(F.bit_or("mask").alias("mask")).toArrow()
    out = {p: np.zeros(n // 64, np.uint64) for p, n in sizes.items()}
    part, word, mask = (got.column(c).to_numpy() for c in ("part", "word", "mask"))
    for p, own in out.items():
        own[word[part == p]] = mask[part == p].view(np.uint64)
    return out
