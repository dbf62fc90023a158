"""A table of words met before, looked up many at a time as arrays."""

from __future__ import annotations

import numpy as np

#: Spare bytes that must follow the words' bytes.
SPARE = 16
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)  # masks of the first n bytes
#: Marks words of over 16 bytes: such bytes are in no UTF-8.
_LONG = np.uint64((1 << 64) - 1)


class WordTable:
    """Places 1, 2, ... of words (UTF-8, not empty, without zero bytes) in the order they were added; 0: not there.

    Words are compared in full: those of up to 16 bytes as two numbers, longer ones by a number that a dict gives them.
    """

    def __init__(self) -> None:
        self.n, self.n_long = 0, 0
        self.low, self.high = np.zeros(1 << 12, np.uint64), np.zeros(1 << 12, np.uint64)
        self.slots = np.zeros(1 << 14, np.int32)
        self.long: dict[bytes, int] = {}

    def keys(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What stands for the words at these bytes of ``data``, which has ``SPARE`` more bytes."""
        sizes, at_each = ends - starts, np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
        low, high = at_each[starts] & _FIRST[np.minimum(sizes, 8)], np.zeros(len(starts), np.uint64)
        more = np.flatnonzero(sizes > 8)
        high[more] = at_each[starts[more] + 8] & _FIRST[np.minimum(sizes[more] - 8, 8)]
        long = more[sizes[more] > 16]
        for i in long.tolist():
            word = data[starts[i] : ends[i]].tobytes()
            number = self.long.get(word)
            if number is None:
                number = self.long[word] = self.n_long
                self.n_long += 1
            low[i] = number
        high[long] = _LONG
        return low, high

    def _slots_of(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        h = low * np.uint64(0x9E3779B97F4A7C15) + high * np.uint64(0xC2B2AE3D27D4EB4F)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return (h >> np.uint64(65 - len(self.slots).bit_length())).astype(np.int64)

    def find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        slot = self._slots_of(low, high)
        place = self.slots[slot]
        same = (self.low[place] == low) & (self.high[place] == high)  # place 0 has the key of no word
        out = np.where(same, place, 0).astype(np.int64)
        rest = np.flatnonzero(~same & (place > 0))
        slot = slot[rest]
        while len(rest):
            slot = (slot + 1) & (len(self.slots) - 1)
            place = self.slots[slot]
            same = (self.low[place] == low[rest]) & (self.high[place] == high[rest])
            out[rest[same]] = place[same]
            on = ~same & (place > 0)
            rest, slot = rest[on], slot[on]
        return out

    def add(self, low: np.ndarray, high: np.ndarray) -> None:
        """Words that are not there and differ from each other."""
        first, self.n = self.n + 1, self.n + len(low)
        self.low, self.high = roomy(self.low, self.n + 1), roomy(self.high, self.n + 1)
        self.low[first : self.n + 1], self.high[first : self.n + 1] = low, high
        if 2 * self.n > len(self.slots):
            self.slots = np.zeros(1 << (3 * self.n).bit_length(), np.int32)
            first = 1
        places = np.arange(first, self.n + 1, dtype=np.int32)
        slot = self._slots_of(self.low[first : self.n + 1], self.high[first : self.n + 1])
        while len(places):
            free = self.slots[slot] == 0
            self.slots[slot[free]] = places[free]
            on = self.slots[slot] != places  # taken before, or by another one just now
            places, slot = places[on], (slot[on] + 1) & (len(self.slots) - 1)

    def only(self, places: np.ndarray) -> WordTable:
        """A table of the words at ``places``, in that order."""
        out = WordTable()
        out.n_long = self.n_long
        low, high = self.low[places], self.high[places]
        stay = set(low[high == _LONG].tolist())
        out.long = {word: number for word, number in self.long.items() if number in stay}
        out.add(low, high)
        return out


def roomy(values: np.ndarray, size: int) -> np.ndarray:
    """``values`` with room for ``size`` of them, and for more if it has to be made."""
    if len(values) >= size:
        return values
    return np.concatenate([values, np.zeros(max(size, len(values) * 3 // 2) - len(values), values.dtype)])
