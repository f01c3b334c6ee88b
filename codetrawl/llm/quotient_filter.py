"""Counting quotient filters over packed n-grams of word numbers: sorted, compact, without loss, mergeable.

An n-gram is a number of n * `bits` bits, held as two halves. A keyed permutation that can be undone spreads these numbers
evenly, so their leading bits (the quotient) number slots of which few are empty and none is crowded. A filter keeps one
bit for each slot that is in use, one for each entry that is the last of its slot, the whole remainder of each entry in as few
bytes as it needs, and a counter of one byte with an escape. As the remainder is kept whole, entries come back exactly.
Filters of one shard (the first bits of the quotient) are sorted alike and merge by adding equal entries.
"""

from __future__ import annotations

import struct

import numpy as np

from .shared import mixed

_HEADER = struct.Struct("<QBBBBQ")  # entries, bits of the quotient, of the shard, of the left and the right half, escaped counters
_ROUNDS = 4
_KEYS = np.random.default_rng(12).integers(0, 1 << 63, size=2 * _ROUNDS, dtype=np.uint64)
_ESCAPE = 255


def _mask(bits: int) -> np.uint64:
    return np.uint64((1 << bits) - 1)


def widths(size: int, bits: int) -> tuple[int, int]:
    """Bits of the two halves of n-grams of `size` words."""
    return (size + 1) // 2 * bits, size // 2 * bits


def packed(words: list[np.ndarray], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The halves of n-grams given as one array of numbers below 2**bits for each place."""
    middle = (len(words) + 1) // 2
    halves = []
    for part in (words[:middle], words[middle:]):
        value = np.zeros(len(words[0]), dtype=np.uint64)
        for w in part:
            value = (value << np.uint64(bits)) | w.astype(np.uint64)
        halves.append(value)
    return halves[0], halves[1]


def unpacked(left: np.ndarray, right: np.ndarray, size: int, bits: int) -> list[np.ndarray]:
    out = []
    for value, count in ((left, (size + 1) // 2), (right, size // 2)):
        out += [((value >> np.uint64(bits * (count - 1 - k))) & _mask(bits)).astype(np.int64) for k in range(count)]
    return out


def permuted(left: np.ndarray, right: np.ndarray, wide: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Each half in turn is changed by a value that the other decides, which can be undone whatever that value is."""
    for k in range(_ROUNDS):
        left = left ^ (mixed(right + _KEYS[2 * k]) & _mask(wide[0]))
        right = right ^ (mixed(left + _KEYS[2 * k + 1]) & _mask(wide[1]))
    # the last word on the leading half, so that its first bits depend on all others
    return left ^ (mixed(right ^ _KEYS[0]) & _mask(wide[0])), right


def restored(left: np.ndarray, right: np.ndarray, wide: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    left = left ^ (mixed(right ^ _KEYS[0]) & _mask(wide[0]))
    for k in reversed(range(_ROUNDS)):
        right = right ^ (mixed(left + _KEYS[2 * k + 1]) & _mask(wide[1]))
        left = left ^ (mixed(right + _KEYS[2 * k]) & _mask(wide[0]))
    return left, right


def _planes(values: np.ndarray, bits: int) -> bytes:
    """The lowest ceil(bits / 8) bytes of each value, all first bytes first."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :-(-bits // 8)].T).tobytes()


def _from_planes(data: bytes, at: int, count: int, bits: int) -> tuple[np.ndarray, int]:
    size = -(-bits // 8)
    out = np.zeros((count, 8), dtype=np.uint8)
    if size:
        out[:, :size] = np.frombuffer(data, dtype=np.uint8, count=size * count, offset=at).reshape(size, count).T
    return out.reshape(-1).view("<u8").astype(np.uint64, copy=False), at + size * count


def encoded(left: np.ndarray, right: np.ndarray, counts: np.ndarray, shard: int, shard_bits: int, wide: tuple[int, int]) -> bytes:
    """A filter of sorted, distinct, permuted entries of one shard."""
    n = len(left)
    q = min(wide[0], shard_bits + max(0, n.bit_length() - 1))
    low = wide[0] - q
    slot = ((left >> np.uint64(low)) - np.uint64(shard << (q - shard_bits))).astype(np.int64)
    used = np.zeros(1 << (q - shard_bits), dtype=bool)
    used[slot] = True
    ends = np.append(slot[1:] != slot[:-1], True)[:n]
    many = np.flatnonzero(counts >= _ESCAPE)
    return b"".join([
        _HEADER.pack(n, q, shard_bits, wide[0], wide[1], len(many)), struct.pack("<Q", shard),
        np.packbits(used).tobytes(), np.packbits(ends).tobytes(), _planes(left & _mask(low), low), _planes(right, wide[1]),
        np.minimum(counts, _ESCAPE).astype(np.uint8).tobytes(), counts[many].astype("<u8").tobytes()])


def decoded(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left, right, counts) of a filter, sorted."""
    n, q, shard_bits, wide_left, wide_right, escaped = _HEADER.unpack_from(data)
    (shard,) = struct.unpack_from("<Q", data, _HEADER.size)
    at, low = _HEADER.size + 8, wide_left - q
    slots = 1 << (q - shard_bits)
    used = np.unpackbits(np.frombuffer(data, dtype=np.uint8, count=-(-slots // 8), offset=at), count=slots)
    at += -(-slots // 8)
    ends = np.unpackbits(np.frombuffer(data, dtype=np.uint8, count=-(-n // 8), offset=at), count=n)
    at += -(-n // 8)
    run = np.cumsum(ends) - ends  # which used slot an entry is in
    slot = np.flatnonzero(used)[run].astype(np.uint64) + np.uint64(shard << (q - shard_bits))
    rest, at = _from_planes(data, at, n, low)
    right, at = _from_planes(data, at, n, wide_right)
    counts = np.frombuffer(data, dtype=np.uint8, count=n, offset=at).astype(np.int64)
    at += n
    counts[counts == _ESCAPE] = np.frombuffer(data, dtype="<u8", count=escaped, offset=at).astype(np.int64)
    return (slot << np.uint64(low)) | rest, right, counts


def _sorted(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Places of the pairs in their order, equal ones in any. One sort of the first 64 bits of the pairs does it nearly always; where
    pairs differ behind these only, all are sorted by both halves."""
    wide_left, wide_right = (int(x.max(initial=0)).bit_length() for x in (left, right))
    room = min(64 - wide_left, wide_right)
    key = left if room == 0 else (left << np.uint64(room) if room < 64 else np.uint64(0)) | (right >> np.uint64(wide_right - room))
    order = np.argsort(key)
    if room < wide_right:
        a, b = left[order], right[order]
        if ((a[1:] == a[:-1]) & (b[1:] < b[:-1])).any():
            return np.lexsort((right, left))
    return order


def distinct(left: np.ndarray, right: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(left, right, counts, entry of each input) of the distinct pairs in order; equal ones are added up."""
    order = _sorted(left, right)
    a, b = left[order], right[order]
    new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))[:len(a)]
    first = np.flatnonzero(new)
    entry = np.empty(len(order), dtype=np.int64)
    entry[order] = np.cumsum(new) - 1
    if counts is None:
        sums = np.diff(np.append(first, len(a)))
    else:
        sums = np.add.reduceat(counts[order], first) if len(first) else np.zeros(0, dtype=np.int64)
    return a[first], b[first], sums.astype(np.int64), entry
