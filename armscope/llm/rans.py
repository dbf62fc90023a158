"""Static range asymmetric numeral system for token ids, with interleaved lanes, checkpoints and checksums.

A frame codes one block on its own, given the shared frequency table. Token i belongs to lane i mod lanes;
all lanes move one token a step, as one array operation. The frame keeps each lane's first state, and at every
``CHECKPOINT``-th step all states and the place in the payload, so that a reader may begin there.

Frame, little-endian: magic ``RNSB``, version u16, bits u16, tokens u32, lanes u32, checkpoints u32,
payload words u32, crc32 of the ids as u32; then for each checkpoint (the first is step 0) its payload place
u32 and its lane states u64; then the payload, u32; then crc32 of everything before it.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

HEAD = struct.Struct("<4sHHIIIII")
LANES = 1024
CHECKPOINT = 128
BITS = 18
_LOW = np.uint64(1 << 31)
_WORD = np.uint64(32)


def frequency_table(ids: np.ndarray, counts: np.ndarray, size: int, bits: int = BITS) -> np.ndarray:
    """Frequencies of 0..size-1 that sum to 2^bits: in proportion to the counts, at least 1 where counted."""
    total = 1 << bits
    if not len(ids):
        return np.zeros(size, np.int64)
    if len(ids) > total:
        raise ValueError("more symbols than the table has places")
    out = np.zeros(size, np.int64)
    share = counts * (total / counts.sum())
    out[ids] = np.maximum(1, np.floor(share)).astype(np.int64)
    gap = total - int(out.sum())
    order = ids[np.argsort(-counts, kind="stable")]
    while gap:  # what rounding left goes to, or comes from, the most frequent
        for s in order:
            step = int(np.clip(gap, 1 - out[s], max(1, out[s] // 8)))
            out[s] += step
            gap -= step
            if not gap:
                break
    return out


class Table:
    """A frequency table with what coding and decoding look up."""

    def __init__(self, frequencies: np.ndarray, bits: int = BITS):
        self.bits = bits
        self.frequency = frequencies.astype(np.uint64)
        self.first = (np.cumsum(frequencies) - frequencies).astype(np.uint64)
        self._symbol: np.ndarray | None = None

    @property
    def symbol(self) -> np.ndarray:
        if self._symbol is None:
            kind = np.uint16 if len(self.frequency) <= 1 << 16 else np.uint32  # small, so that it stays in a cache
            self._symbol = np.repeat(np.arange(len(self.frequency), dtype=kind), self.frequency.astype(np.int64))
        return self._symbol


def encode(ids: np.ndarray, table: Table, lanes: int = LANES, every: int = CHECKPOINT) -> bytes:
    n = len(ids)
    lanes = max(1, min(lanes, n))
    steps = -(-n // lanes)
    state = np.full(lanes, _LOW)
    bits, shift = np.uint64(table.bits), np.uint64(63 - table.bits)
    out: list[np.ndarray] = []
    written, marks = 0, []
    for t in range(steps - 1, -1, -1):
        own = ids[t * lanes : (t + 1) * lanes]
        x, f, c = state[: len(own)], table.frequency[own], table.first[own]
        full = x >= (f << shift)
        spill = x[full]
        if len(spill):
            out.append((spill & np.uint64(0xFFFFFFFF)).astype(np.uint32))
            written += len(spill)
            x[full] = spill >> _WORD
        turns = x // f
        state[: len(own)] = (turns << bits) + (x - turns * f) + c
        if t % every == 0:
            marks.append((written, state.copy()))
    marks = marks[::-1] or [(0, state)]
    body = b"".join(
        struct.pack("<I", written - place) + states.astype("<u8").tobytes() for place, states in marks
    ) + b"".join(w.astype("<u4").tobytes() for w in reversed(out))
    head = HEAD.pack(
        b"RNSB", 1, table.bits, n, lanes, len(marks), written, zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())
    )
    return head + body + struct.pack("<I", zlib.crc32(head + body))


def decode(frame: bytes, table: Table, start: int = 0, every: int = CHECKPOINT) -> np.ndarray:
    """The ids of a frame as u32, from checkpoint ``start`` on; raises ValueError where a checksum fails."""
    magic, version, bits, n, lanes, marks, size, crc = HEAD.unpack_from(frame)
    if magic != b"RNSB" or version != 1 or bits != table.bits:
        raise ValueError("not a frame of this table")
    if zlib.crc32(memoryview(frame)[:-4]) != struct.unpack_from("<I", frame, len(frame) - 4)[0]:
        raise ValueError("frame checksum differs")
    width = 4 + 8 * lanes
    at = HEAD.size + start * width
    place = struct.unpack_from("<I", frame, at)[0]
    state = np.frombuffer(frame, "<u8", lanes, at + 4).astype(np.uint64)
    payload = np.frombuffer(frame, "<u4", size, HEAD.size + marks * width).astype(np.uint64)
    out = np.zeros(max(0, n - start * every * lanes), np.uint32)
    low_bits, mask = np.uint64(bits), np.uint64((1 << bits) - 1)
    for t in range(0, len(out), lanes):
        x = state[: min(lanes, len(out) - t)]
        slot = x & mask
        s = table.symbol[slot]
        out[t : t + len(x)] = s
        x = table.frequency[s] * (x >> low_bits) + slot - table.first[s]
        low = x < _LOW
        m = int(np.count_nonzero(low))
        if m:
            x[low] = (x[low] << _WORD) | payload[place : place + m]
            place += m
        state[: len(x)] = x
    if start == 0 and zlib.crc32(out.astype("<u4").tobytes()) != crc:
        raise ValueError("ids checksum differs")
    return out
