"""Hamming distances of many fingerprints at once, on bit planes stored vertically."""

from __future__ import annotations

import numpy as np

_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def planes(fingerprints: np.ndarray, room: int = 0) -> np.ndarray:
    """Row b: bit b of every fingerprint (a word, or a row of words), 64 of them to a word; `room` empty words follow."""
    n = len(fingerprints)
    raw = np.ascontiguousarray(fingerprints.astype("<u8")).view(np.uint8).reshape(n, -1)
    out = np.zeros((8 * raw.shape[1], (-(-n // 64) + room) * 8), np.uint8)
    for k in range(raw.shape[1]):  # a byte at a time, to hold few unpacked bits
        bits = np.unpackbits(np.ascontiguousarray(raw[:, k : k + 1]), axis=1, bitorder="little")
        packed = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")
        out[8 * k : 8 * k + 8, : packed.shape[1]] = packed
    return out.view("<u8")


def counters(radius: int, words: int) -> list[np.ndarray]:
    """Counter bits across the planes, set so that counting past the radius carries out of the top one."""
    width = (radius + 1).bit_length()
    preset = (1 << width) - 1 - radius
    return [np.full(words, _FULL if preset >> k & 1 else 0, np.uint64) for k in range(width)]


def close_pairs(fingerprints: np.ndarray, run: np.ndarray, radius: int, block_words: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j), i < j, of fingerprints of the same run that differ in at most radius bits.

    Equal values of run stand together. For every offset d, lane i compares i with i + d: a plane's
    differences are added to counters that lie across the planes (carry-save: one word of each counter
    bit serves 64 lanes). Counters start so that passing the radius carries out of their top bit. A
    block of lanes is abandoned once all its lanes have passed the radius.
    """
    n = len(fingerprints)
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    longest = int(np.max(np.diff(np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1], [True]])))))
    store = planes(fingerprints, longest // 64 + 2)
    words = -(-n // 64)
    left, right = [], []
    for d in range(1, longest):
        same = np.zeros(words * 64, np.uint8)
        same[: n - d] = run[d:] == run[:-d]
        lanes = np.packbits(same, bitorder="little").view("<u8")
        used = np.flatnonzero(lanes)
        if not len(used):
            break
        skip, turn = divmod(d, 64)
        for first in range(int(used[0]), int(used[-1]) + 1, block_words):
            end = min(first + block_words, words)
            over = ~lanes[first:end]
            if (over == _FULL).all():
                continue
            counter = counters(radius, end - first)
            for b in range(len(store)):
                other = store[b, first + skip : end + skip]
                if turn:
                    other = (other >> np.uint64(turn)) | (store[b, first + skip + 1 : end + skip + 1] << np.uint64(64 - turn))
                carry = store[b, first:end] ^ other
                for k in range(len(counter)):
                    counter[k], carry = counter[k] ^ carry, counter[k] & carry
                over |= carry
                if b % 4 == 3 and (over == _FULL).all():
                    break
            hit = np.flatnonzero(np.unpackbits((~over).view(np.uint8), bitorder="little")) + first * 64
            left.append(hit)
            right.append(hit + d)
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(left), np.concatenate(right)


def join_runs(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The least position that the pairs connect each of n positions with."""
    least = np.arange(n)
    while True:
        low = np.minimum(least[left], least[right])
        new = least.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        np.minimum.at(new, least[left], low)
        np.minimum.at(new, least[right], low)
        new = new[new]
        if (new == least).all():
            return least
        least = new
