"""Cutting texts where byte-level BPE does, and remembering what was worked out for each part.

The pattern that splits a text before the merges has matches that hold a space only in front or in a run of
white space. So each space with another character than white space on both sides begins a part, and a run
of up to two newlines between such characters is cut off, each newline alone, as the pattern does. What
ends in a letter and a mark is cut before the mark. Texts with other white space, or spaces beside spaces or
newlines, or three newlines in a row, are cut by the pattern itself, or left whole.

All of it is done for many texts at once, in Arrow and numpy: Python handles a distinct part when it is met
for the first time, and no part is an object of its own. What is remembered is bounded in bytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: White space by Unicode, as the pattern's \\s means it; spelt out because regex libraries differ.
OTHER_SPACE = "".join(map(chr, [0x9, 0xB, 0xC, 0xD, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
MARKS = ".,;:!?"
#: Bytes of parts and of their values that a worker remembers, and of the longest part among them.
MOST, LONGEST = 64 << 20, 256

Runs = tuple[np.ndarray, np.ndarray]  # how many numbers each string has, and all the numbers


def spelt(pattern: str) -> regex.Pattern:
    space = OTHER_SPACE + r" \n"
    return regex.compile(pattern.replace(r"\s\p", f"{space}\\p").replace(r"\S", f"[^{space}]").replace(r"\s", f"[{space}]"))


def plain(text: str) -> bool:
    """Whether the text may be cut at its spaces and newlines."""
    odd = "  " in text or "\n " in text or " \n" in text or "\n\n\n" in text or text.endswith("\n\n")
    return not (odd or any(c in text for c in (OTHER_SPACE[:4] if text.isascii() else OTHER_SPACE)))


def cut(texts: list[str], lead: str = "\n") -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct parts of texts, the numbers of all parts in order, and where each text's parts end.

    A part without a space in front has a newline there instead; one that is a newline alone is empty. The
    first part of a text has ``lead`` in front.
    """
    marked = pc.replace_substring(pa.array(texts, pa.large_string()), "\n", " \n\n \n")
    if lead:
        marked = pc.binary_join_element_wise(pa.scalar(lead, pa.large_string()), marked, pa.scalar("", pa.large_string()))
    split = pc.split_pattern(marked, " ")
    flat = split.flatten().dictionary_encode()
    ends = np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))
    part, order = flat.dictionary, flat.indices.to_numpy(zero_copy_only=False)
    del marked, split, flat
    # what ends in a letter and a mark becomes two parts
    two = pc.match_substring_regex(part, rf"\p{{L}}[{MARKS}]$")
    base = pc.if_else(two, pc.utf8_slice_codeunits(part, 0, -1), part)
    mark = pc.if_else(two, pc.binary_join_element_wise(pa.scalar("\n", pa.large_string()), pc.utf8_slice_codeunits(part, -1), pa.scalar("", pa.large_string())), pa.scalar("\n", pa.large_string()))
    both = pa.concat_arrays([base, mark]).dictionary_encode()
    first, second = np.split(both.indices.to_numpy(zero_copy_only=False), 2)
    doubled = two.to_numpy(zero_copy_only=False)[order]
    before = np.cumsum(doubled)
    out = np.empty(len(order) + int(doubled.sum()), dtype=np.int32)
    at = np.arange(len(order)) + before - doubled
    out[at] = first[order]
    out[at[doubled] + 1] = second[order[doubled]]
    pa.default_memory_pool().release_unused()
    return both.dictionary, out, ends + np.concatenate([[0], before])[ends]


def spelling(part: str) -> str:
    return part[1:] if part[:1] == "\n" else f" {part}"


def gather(start: np.ndarray, size: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """The runs of ``flat`` that begin at ``start``, one after the other."""
    end = np.cumsum(size)
    return flat[np.arange(end[-1] if len(end) else 0) + np.repeat(start - end + size, size)]


def starts(size: np.ndarray) -> np.ndarray:
    return np.cumsum(size) - size


def joined(size: np.ndarray, flat: np.ndarray, order: pa.Array | np.ndarray, ends: np.ndarray) -> Runs:
    """Runs put together of others, chosen by ``order``; each takes the chosen ones up to its end."""
    order = np.asarray(order)
    total = np.concatenate([[0], np.cumsum(size[order])])
    return np.diff(total[np.concatenate([[0], ends])]), gather(starts(size)[order], size[order], flat)


_MIX = np.uint64(0x9E3779B97F4A7C15)
_POWER = np.cumprod(np.full(LONGEST + 1, 0x100000001B3, dtype=np.uint64))
_BYTES = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) ^ (np.arange(1, 257, dtype=np.uint64) << np.uint64(40))


class Table:
    """Numbers by 64-bit keys, many at once: linear probing in numpy. The key of all ones is never held."""

    EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)

    def __init__(self, bits: int = 12):
        self._clear(bits)

    def _clear(self, bits: int) -> None:
        self.bits, self.held = bits, 0
        self.keys = np.full(1 << bits, self.EMPTY, dtype=np.uint64)
        self.numbers = np.zeros(1 << bits, dtype=np.int32)

    def _at(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _MIX) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The keys' numbers; -1 where a key is not held."""
        at = self._at(keys)
        found = self.keys[at]
        hit = found == keys
        out = np.where(hit, self.numbers[at], -1)
        todo = np.flatnonzero(~hit & (found != self.EMPTY))
        while len(todo):
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
            found = self.keys[at[todo]]
            hit = found == keys[todo]
            out[todo[hit]] = self.numbers[at[todo[hit]]]
            todo = todo[~hit & (found != self.EMPTY)]
        return out

    def put(self, keys: np.ndarray, numbers: np.ndarray) -> None:
        """Hold the keys, which are not held yet."""
        self.held += len(keys)
        if 2 * self.held > 1 << self.bits:
            here = self.keys != self.EMPTY
            keys, numbers = np.concatenate([self.keys[here], keys]), np.concatenate([self.numbers[here], numbers])
            self._clear(max(self.bits, (2 * len(keys)).bit_length()))
            self.held = len(keys)
        at, todo = self._at(keys), np.arange(len(keys))
        while len(todo):
            free = self.keys[at[todo]] == self.EMPTY
            self.keys[at[todo[free]]] = keys[todo[free]]
            mine = self.keys[at[todo]] == keys[todo]
            self.numbers[at[todo[mine]]] = numbers[todo[mine]]
            todo = todo[~mine]
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)


def layout(strings: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(start, size, bytes)`` of large strings."""
    _, offsets, data = strings.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[strings.offset : strings.offset + len(strings) + 1] if len(strings) else np.zeros(1, dtype=np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data else np.empty(0, dtype=np.uint8)
    return at[:-1] - at[0], np.diff(at), raw


def hashes(strings: pa.Array) -> np.ndarray:
    """A 64-bit number of each large string's length and first ``LONGEST`` bytes."""
    start, size, raw = layout(strings)
    short = np.minimum(size, LONGEST)
    raw = raw if len(raw) == short.sum() else gather(start, short, raw)
    begin = starts(short)
    total = np.concatenate([[np.uint64(0)], np.cumsum(_BYTES[raw] * _POWER[np.arange(len(raw)) - np.repeat(begin, short)])])
    h = (total[begin + short] - total[begin] + size.astype(np.uint64)) * _MIX
    h ^= h >> np.uint64(29)
    return np.where(h == Table.EMPTY, np.uint64(0), h)


class Memory:
    """Runs of numbers of strings, looked up for many strings at once.

    ``resolve`` gives those of a list of strings (of type ``strings``, large ones). Strings lie in one Arrow array and numbers in one numpy array;
    what these take is ``most`` bytes at most. When they take more, the strings that were not asked for the
    longest go, until half is left. Longer strings than ``LONGEST`` bytes are resolved each time.
    """

    def __init__(self, resolve: Callable[[list], Runs], kind: np.dtype | type, most: int = MOST, strings: pa.DataType | None = None):
        self.resolve, self.kind, self.most, self.turn = resolve, kind, most, 0
        self._hold(pa.array([], strings or pa.large_string()), np.empty(0, dtype=np.int64), np.empty(0, dtype=kind), np.empty(0, dtype=np.int32))

    def _hold(self, strings: pa.Array, size: np.ndarray, flat: np.ndarray, met: np.ndarray) -> None:
        self.strings, self.size, self.flat, self.met = strings, size, flat, met
        self.table = Table()
        self.table.put(hashes(strings), np.arange(len(strings)))

    def bytes(self) -> int:
        return self.strings.nbytes + self.size.nbytes + self.flat.nbytes + self.met.nbytes + self.table.keys.nbytes + self.table.numbers.nbytes

    def look(self, asked: pa.Array) -> Runs:
        """The numbers of distinct large strings."""
        self.turn += 1
        key = hashes(asked)
        slot = self.table.get(key)
        taken = slot >= 0
        here = np.flatnonzero(taken)  # a number is not a string: others of the same number are resolved each time
        same = pc.equal(self.strings.take(pa.array(slot[here])), asked.take(pa.array(here))).to_numpy(zero_copy_only=False)
        slot[here[~same]] = -1
        here, new = np.flatnonzero(slot >= 0), np.flatnonzero(slot < 0)
        self.met[slot[here]] = self.turn
        unknown = asked.take(pa.array(new))
        new_size, new_flat = self.resolve(unknown.to_pylist()) if len(new) else (np.empty(0, dtype=np.int64), np.empty(0, dtype=self.kind))
        held = len(self.flat)
        size, start = np.empty(len(asked), dtype=np.int64), np.empty(len(asked), dtype=np.int64)
        size[here], size[new] = self.size[slot[here]], new_size
        start[here], start[new] = starts(self.size)[slot[here]], held + starts(new_size)
        every = np.concatenate([self.flat, new_flat])
        keep = ~taken[new] & (layout(unknown)[1] <= LONGEST)
        if len(new):
            self.table.put(key[new][keep], len(self.strings) + np.arange(keep.sum()))
            kept = new_flat if keep.all() else gather(starts(new_size)[keep], new_size[keep], new_flat)
            self.flat = np.concatenate([self.flat, kept.astype(self.kind)])
            self.strings = pa.concat_arrays([self.strings, unknown.filter(pa.array(keep))])
            self.size, self.met = np.concatenate([self.size, new_size[keep]]), np.concatenate([self.met, np.full(keep.sum(), self.turn, dtype=np.int32)])
        if self.bytes() > self.most:
            self._forget()
        return size, gather(start, size, every)

    def _forget(self) -> None:
        latest = np.argsort(-self.met, kind="stable")
        each = layout(self.strings)[1] + 8 + self.size * self.flat.itemsize + 12 + 48  # 24 to 48 in the table
        keep = np.sort(latest[np.cumsum(each[latest]) <= self.most // 2])
        self._hold(self.strings.take(pa.array(keep)), self.size[keep], gather(starts(self.size)[keep], self.size[keep], self.flat), self.met[keep])


class Words:
    """Numbers of whole texts, put together from those of their parts, which are remembered.

    ``resolve`` gives the numbers of strings. ``find`` cuts a text that is not plain into matches; without it such a
    text is left whole, as is one with a ``special`` string.
    """

    def __init__(self, resolve: Callable[[list[str]], Runs], kind: np.dtype | type, most: int = MOST, special: tuple[str, ...] = (), find: Callable[[str], list[str]] | None = None):
        self.resolve, self.special, self.find = resolve, special, find
        self.memory = Memory(lambda new: resolve([spelling(p) for p in new]), kind, most)

    def texts(self, texts: list[str]) -> Runs:
        """How many numbers each text has, and all numbers."""
        odd = [not plain(t) or any(s in t for s in self.special) for t in texts]
        strings, order, ends = cut([t for t, o in zip(texts, odd, strict=True) if not o])
        size, flat = self.memory.look(strings)
        sizes, numbers = joined(size, flat, order, ends)
        if not any(odd):
            return sizes, numbers
        out_size = np.empty(len(texts), dtype=np.int64)
        out_size[~np.array(odd)] = sizes
        strange = [t for t, o in zip(texts, odd, strict=True) if o]
        odd_size, odd_flat = self._strange(strange)
        out_size[odd] = odd_size
        both, at = np.concatenate([numbers, odd_flat]), np.empty(len(texts), dtype=np.int64)
        at[~np.array(odd)], at[odd] = starts(sizes), len(numbers) + starts(odd_size)
        return out_size, gather(at, out_size, both)

    def _strange(self, texts: list[str]) -> Runs:
        if self.find is None:
            return self.resolve(texts)
        matches = [[m[1:] if m[0] == " " and m[1:2] != "\n" else f"\n{m}" for m in self.find(t)] for t in texts]
        coded = pa.array([m for ms in matches for m in ms], pa.large_string()).dictionary_encode()
        size, flat = self.memory.look(coded.dictionary)
        return joined(size, flat, coded.indices, np.cumsum([len(ms) for ms in matches]))


def blocks(lists: list, weight: Callable[[object], int], most: int) -> Iterator[list]:
    """The list in runs of about ``most`` in weight, one item at least."""
    held, total = [], 0
    for x in lists:
        held.append(x)
        total += weight(x)
        if total >= most:
            yield held
            held, total = [], 0
    if held:
        yield held
