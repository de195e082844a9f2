"""CRC-32C of many byte strings at once, with NumPy.

A CRC without start value is linear, so a string is cut into lanes of ``LANE`` bytes, all lanes are run in step, and each
is then moved on by the number of lanes after it.
"""

from __future__ import annotations

from functools import cache

import numpy as np

POLYNOMIAL = 0x82F63B78  # fixed value: Castagnoli, reflected
MASK_DELTA = 0xA282EAD8  # fixed value of the record format
LANE = 64


@cache
def _table() -> np.ndarray:
    """By byte."""
    crc = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        crc = np.where(crc & 1, crc >> 1 ^ np.uint32(POLYNOMIAL), crc >> 1)
    return crc


@cache
def _zeros(power: int) -> np.ndarray:
    """What LANE * 2**power zero bytes make of a CRC, by byte of it: shape (4, 256)."""
    byte, shifts = np.arange(256, dtype=np.uint32), np.arange(4, dtype=np.uint32)[:, None] * 8
    crc = byte[None, :] << shifts
    if power:
        return _move(_move(crc, power - 1), power - 1)
    for _ in range(LANE):
        crc = _table()[crc & 255] ^ crc >> 8
    return crc


def _move(crc: np.ndarray, power: int) -> np.ndarray:
    by = _zeros(power)
    return by[0][crc & 255] ^ by[1][crc >> 8 & 255] ^ by[2][crc >> 16 & 255] ^ by[3][crc >> 24]


def crc32c(strings: list[bytes]) -> np.ndarray:
    """CRC-32C of each string, which must have 4 bytes at least (the start value is folded into those)."""
    lengths = np.fromiter(map(len, strings), np.int64, len(strings))
    lanes = -(-lengths // LANE)
    pads = lanes * LANE - lengths  # zero bytes in front leave a CRC of 0 as it is
    data = np.frombuffer(b"".join([bytes(p) + s for p, s in zip(pads.tolist(), strings, strict=True)]), np.uint8).copy()
    ends = np.cumsum(lanes)
    first = (ends - lanes) * LANE + pads
    for k in range(4):
        data[first + k] ^= 255
    steps = np.ascontiguousarray(data.reshape(-1, LANE).T)
    table, crc = _table(), np.zeros(int(ends[-1]) if len(ends) else 0, np.uint32)
    for step in steps:
        crc = table[(crc ^ step) & 255] ^ crc >> 8
    after = np.repeat(ends, lanes) - 1 - np.arange(len(crc))
    power = 0
    while len(after) and after.max() >> power:
        odd = np.flatnonzero(after >> power & 1)
        crc[odd] = _move(crc[odd], power)
        power += 1
    return np.bitwise_xor.reduceat(crc, ends - lanes) ^ np.uint32(0xFFFFFFFF) if len(ends) else crc


def masked(crc: np.ndarray) -> np.ndarray:
    return (crc >> np.uint32(15) | crc << np.uint32(17)) + np.uint32(MASK_DELTA)
