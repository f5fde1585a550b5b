"""Splitting a text into units that a byte-level BPE encodes independently of each other.

The split pattern never joins a character with white space after it, and joins at
most one space with what follows. So a text whose white space is single spaces and
line ends, none of them next to another or at either end, is cut exactly at those:
each unit is a run without white space, with its leading space if it has one.
Units repeat a lot more than texts do, so their ids can be looked up.
"""

from __future__ import annotations

import gc
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: What a unit may not hold; a text with such a unit, or with an empty one, takes the whole pattern.
WHITE = re.compile(r"[\s\x1c-\x1f]")
#: One of these behind letters is a piece of its own.
STOPS = ".,;:!?"


class UnitCache:
    """Ids of units, kept for about ``most`` units, those met last; what is dropped is encoded again when needed.

    encode: takes distinct units and gives the packed ids of each.
    whole: gives the packed ids of whole texts, for those that aren't cut simply.
    """

    def __init__(self, encode: Callable[[list[str]], list[bytes]], whole: Callable[[list[str]], list[bytes]], most: int = 500_000):
        self.encode, self.whole, self.most = encode, whole, most
        self.line_end = encode(["\n"])[0]
        self.stops = dict(zip(STOPS, encode(list(STOPS)), strict=True))
        self.spaced: dict[str, bytes | None] = {}
        self.bare: dict[str, bytes | None] = {}
        self._age()

    def _age(self) -> None:
        # keys of both are without the leading space; None marks units of texts that aren't cut simply
        self.older = {" ": self.spaced, "": self.bare}
        self.spaced, self.bare = {"": None}, {"": None}

    def _learn(self, seen: set[str], cache: dict[str, bytes | None], lead: str) -> None:
        new, older = seen.difference(cache), self.older[lead]
        again = older.keys() & new
        cache.update([(x, older[x]) for x in again])
        new -= again
        stopped = {x for x in new if x[-1] in self.stops and x[:-1].isalpha()}
        new = (new - stopped) | {x[:-1] for x in stopped}.difference(cache)
        if WHITE.search("".join(new)):
            uneven = {x for x in new if WHITE.search(x)}
            cache.update(dict.fromkeys(uneven))
            new -= uneven
        plain = list(new)
        for i in range(0, len(plain), 50_000):
            part = plain[i : i + 50_000]
            cache.update(zip(part, self.encode([lead + x for x in part]), strict=True))
        cache.update([(x, cache[x[:-1]] + self.stops[x[-1]]) for x in stopped])

    def packed(self, texts: list[str]) -> list[bytes]:
        """The packed ids of each text."""
        collects = gc.isenabled()
        gc.disable()  # nothing here refers to itself: the collector would only walk the kept units, again and again
        try:
            return self._packed(texts)
        finally:
            if collects:
                gc.enable()

    def _packed(self, texts: list[str]) -> list[bytes]:
        if 2 * (len(self.spaced) + len(self.bare)) > self.most:
            self._age()
        spaced: set[str] = set()
        bare: set[str] = set()
        lines = [[line.split(" ") for line in text.split("\n")] if text else [] for text in texts]
        starts = []
        for cut in lines:
            starts.append([parts.pop(0) for parts in cut])
            bare.update(starts[-1])
            for parts in cut:
                spaced.update(parts)
        self._learn(bare, self.bare, "")
        self._learn(spaced, self.spaced, " ")
        first, rest = self.bare.__getitem__, self.spaced.__getitem__
        out: list[bytes] = []
        odd: list[int] = []
        for i, (heads, cut) in enumerate(zip(starts, lines, strict=True)):
            try:
                out.append(self.line_end.join([first(head) + b"".join(map(rest, parts)) for head, parts in zip(heads, cut, strict=True)]))
            except TypeError:  # it has a unit that is None
                out.append(b"")
                odd.append(i)
        for i, ids in zip(odd, self.whole([texts[i] for i in odd]) if odd else [], strict=True):
            out[i] = ids
        return out


def _table(*values: int) -> np.ndarray:
    held = np.zeros(256, bool)
    held[list(values)] = True
    return held


#: Bytes: what units are cut before, STOPS, and the letters of ASCII.
_SPACES, _STOPS = _table(0x20, 0x0A), _table(*STOPS.encode())
_LETTERS = _table(*range(0x41, 0x5B), *range(0x61, 0x7B))
#: Pairs of bytes that white space may start with, ASCII's whatever follows it.
_WHITE = np.zeros((256, 256), bool)
_WHITE[[*range(0x09, 0x0E), *range(0x1C, 0x21)]] = True
_WHITE[[0xC2, 0xC2, 0xE1, 0xE2, 0xE2, 0xE3], [0x85, 0xA0, 0x9A, 0x80, 0x81, 0x80]] = True


class UnitTable:
    """Ids of units in Arrow and numpy arrays: texts are cut, looked up and put together a block at once, not a unit at a time.

    A text is cut before each space and line end that no white space follows, whatever
    stands before it: the pattern ends its match of earlier white space there. One of STOPS
    between a letter and such a place, or the text's end, is a unit too. A line end is put
    before each text, so that its first unit starts like any other, and taken off its ids.

    encode: takes distinct units (binary) that start as above and gives all their ids, and how many are each one's.
    whole: gives the ids of whole texts: those that start with white space, are empty, or hold one of ``added``.
    added: strings that are tokens wherever they stand.
    most: units that are kept, about; beyond, those of the last block are.
    """

    #: Longer units are encoded each time.
    LONGEST = 200

    def __init__(self, encode: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]], whole: Callable[[list[str]], list[np.ndarray]], most: int, added: tuple[str, ...]):
        self.encode, self.whole, self.most, self.added = encode, whole, most, added
        self.line_end, *stops = whole(["\n", *STOPS])
        if len(self.line_end) != 1:
            raise ValueError("this vocabulary has no single token for a line end")
        self.units = pa.array([s.encode() for s in STOPS], pa.binary())
        self.ids = np.concatenate(stops).astype(np.uint32)
        self.counts = np.array([len(x) for x in stops], np.int32)

    def _cut(self, row: np.ndarray, starts: np.ndarray, odd: np.ndarray) -> np.ndarray:
        """Where units start in ``row``, which has two line ends more than the texts, and its end."""
        at = np.flatnonzero(_SPACES[row[:-2]])
        at = at[~_WHITE[row[at + 1], row[at + 2]]]
        if odd.any():
            at = at[~odd[np.searchsorted(starts, at, "right") - 1]]
        first = np.zeros(len(row) - 1, bool)
        first[at] = first[starts] = first[-1] = True
        ends = np.flatnonzero(first)[1:]
        if odd.any():
            ends = ends[~odd[np.searchsorted(starts, ends - 1, "right") - 1]]
        ends = ends[_STOPS[row[ends - 1]]]
        before = row[ends - 2]
        letter = _LETTERS[before] | ((row[ends - 3] == 0xC3) & (before != 0x97) & (before != 0xB7))
        first[ends[letter] - 1] = True
        return np.flatnonzero(first).astype(np.int32)

    def packed(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, ``end_id`` behind each one's, and how many are each one's, with that."""
        texts = pc.fill_null(texts, "").cast(pa.string())  # its offsets are read as 32-bit numbers
        lined = pc.binary_join_element_wise("", texts, "\n")
        places = np.frombuffer(lined.buffers()[1], np.int32)[lined.offset :][: len(lined) + 1]
        row = np.concatenate([np.frombuffer(lined.buffers()[2], np.uint8)[places[0] : places[-1]], np.full(2, 0x0A, np.uint8)])
        starts = places[:-1] - places[0]
        odd = _WHITE[row[starts + 1], row[starts + 2]]
        for added in self.added:
            odd |= pc.match_substring(texts, added).to_numpy(zero_copy_only=False)
        cuts = self._cut(row, starts, odd)
        units = pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(row)])
        heads = np.searchsorted(cuts, starts)
        found = pc.fill_null(pc.index_in(units, value_set=self.units), -1).to_numpy().copy()
        found[heads[odd]] = 0  # set below
        missing = np.flatnonzero(found < 0)
        new = units.take(pa.array(missing)).dictionary_encode()
        ids, counts = self.encode(new.dictionary)
        found[missing] = new.indices.to_numpy() + len(self.units)
        wholes = [np.append(self.line_end, x) for x in self.whole(texts.filter(pa.array(odd)).to_pylist())] if odd.any() else []
        found[heads[odd]] = len(self.units) + len(counts) + np.arange(len(wholes))
        ids = np.concatenate([self.ids, ids, *wholes], dtype=np.uint32, casting="unsafe")
        counts = np.concatenate([self.counts, counts, np.array([len(x) for x in wholes], np.int32)])
        self._keep(new.dictionary, ids, counts, found)
        n = counts[found]
        begins = np.cumsum(n) - n
        at = np.repeat((np.cumsum(counts) - counts)[found] - begins, n)
        at += np.arange(len(at))
        out = ids[at]
        first = begins[heads]
        out[first] = end_id  # each text's line end gives way to the end of the one before
        return np.append(out[1:], out[:1]), np.diff(first, append=len(out))

    def _keep(self, new: pa.Array, ids: np.ndarray, counts: np.ndarray, found: np.ndarray) -> None:
        """Keep the block's new units, but for long ones; only what the block has, when they are too many."""
        units = pa.concat_arrays([self.units, new])
        kept = pc.binary_length(units).to_numpy() <= self.LONGEST
        if len(units) > self.most:
            used = np.zeros(len(counts), bool)
            used[found] = True
            kept &= used[: len(units)]
            kept[: len(STOPS)] = True
        counts = counts[: len(units)]
        self.units, self.counts, self.ids = units.filter(pa.array(kept)), counts[kept], ids[: counts.sum()][np.repeat(kept, counts)]
