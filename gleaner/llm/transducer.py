"""Minimal acyclic transducers over sorted terms: a term's output is its ordinal."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_SPREAD = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Transducer:
    """Arcs ``state * 256 + byte`` -> ``target`` with ``output``: terms that come before those behind the arc.

    States are numbered from the leaves to the root, which is the last one. The sum of the outputs
    along a term's path is the number of terms before it.
    """

    keys: np.ndarray
    target: np.ndarray
    output: np.ndarray
    final: np.ndarray


def transducer(terms: list[bytes]) -> Transducer:
    """The minimal transducer of different, sorted terms, built term by term.

    Only the path of the last term is open. What the next term leaves of it is
    closed from its end: a state with the same arcs and the same finality as a closed
    one is that one.
    """
    known: dict[tuple, int] = {}
    states: list[tuple] = []
    counts: list[int] = []
    path: list[list] = [[False, []]]
    last = b""

    def close() -> None:
        final, arcs = path.pop()
        key = (final, tuple(arcs))
        if key not in known:
            known[key] = len(states)
            states.append(key)
            counts.append(final + sum(counts[t] for _, t in arcs))
        if path:
            path[-1][1].append((last[len(path) - 1], known[key]))

    for term in terms:
        common = next((k for k, (a, b) in enumerate(zip(term, last, strict=False)) if a != b), min(len(term), len(last)))
        while len(path) - 1 > common:
            close()
        path += [[False, []] for _ in range(len(term) - common)]
        path[-1][0] = True
        last = term
    while path:
        close()
    keys, target, output = [], [], []
    for state, (final, arcs) in enumerate(states):
        before = int(final)
        for byte, to in arcs:
            keys.append(state << 8 | byte)
            target.append(to)
            output.append(before)
            before += counts[to]
    return Transducer(np.array(keys, np.int64), np.array(target, np.int64), np.array(output, np.int64), np.array([f for f, _ in states], bool))


class Vocabulary:
    """Several transducers side by side, asked for many words at once.

    ``volumes`` holds (group, ordinal of its first term, first eight bytes of its first term, transducer)
    for consecutive ranges of each group's sorted terms. Arcs lie in one
    open-addressed table, so a step of all words is a few gathers.
    """

    def __init__(self, volumes: list[tuple[object, int, int, Transducer]]):
        self.volumes: dict[object, list[tuple[int, int, int]]] = {}
        keys, target, output, final, states = [], [], [], [], 0
        for group, first, low, part in sorted(volumes, key=lambda v: (str(v[0]), v[1])):
            keys.append(part.keys + (states << 8))
            target.append(part.target + states)
            output.append(part.output)
            final.append(part.final)
            states += len(part.final)
            self.volumes.setdefault(group, []).append((low, first, states - 1))
        self.final = np.concatenate(final) if final else np.zeros(0, bool)
        arcs = [np.concatenate(part) if part else np.zeros(0, np.int64) for part in (keys, target, output)]
        self.bits = max(4, int(2 * len(arcs[0])).bit_length())
        size = 1 << self.bits
        self.key = np.full(size, -1)
        self.target, self.output = np.zeros(size, np.int64), np.zeros(size, np.int64)
        slot, left = self._slot(arcs[0]), np.arange(len(arcs[0]))
        while len(left):
            free = self.key[slot] < 0
            _, one = np.unique(np.where(free, slot, -1), return_index=True)
            one = one[free[one]]
            for own, given in zip((self.key, self.target, self.output), arcs, strict=True):
                own[slot[one]] = given[left[one]]
            stay = np.ones(len(left), bool)
            stay[one] = False
            left, slot = left[stay], slot[stay] + ~free[stay] & size - 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _SPREAD) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _arc(self, keys: np.ndarray) -> np.ndarray:
        """Place of each arc in the table, -1 where there is none."""
        slot, mask = self._slot(keys), (1 << self.bits) - 1
        found = np.where(self.key[slot] == keys, slot, -1)
        open_ = np.flatnonzero((found < 0) & (self.key[slot] >= 0))
        while len(open_):
            slot[open_] = slot[open_] + 1 & mask
            held = self.key[slot[open_]]
            hit = held == keys[open_]
            found[open_[hit]] = slot[open_[hit]]
            open_ = open_[~hit & (held >= 0)]
        return found

    def _walk(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, roots: np.ndarray, firsts: np.ndarray) -> np.ndarray:
        """Ordinals of the words from their roots, -1 for those that are no term."""
        out = np.full(len(starts), -1)
        live, at, state, total = np.arange(len(starts)), starts.copy(), roots.copy(), firsts.copy()
        while len(live):
            arc = self._arc(state << 8 | data[at])
            ok = arc >= 0
            live, at, arc, total = live[ok], at[ok] + 1, arc[ok], total[ok]
            total += self.output[arc]
            state = self.target[arc]
            more = at < ends[live]
            over = ~more
            out[live[over]] = np.where(self.final[state[over]], total[over], -1)
            live, at, state, total = live[more], at[more], state[more], total[more]
        return out

    def ordinals(self, group: object, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Ordinal of each word of a group's texts, -1 for words that are no term here."""
        out = np.full(len(starts), -1)
        volumes = self.volumes.get(group)
        if not volumes or not len(starts):
            return out
        lows, firsts, roots = (np.array(part) for part in zip(*((np.uint64(low), first, root) for low, first, root in volumes), strict=True))
        head = leading(data, starts, ends)
        # The volume whose range holds the word; several where volumes begin with the same eight bytes.
        at, last = np.searchsorted(lows, head, "left") - 1, np.searchsorted(lows, head, "right") - 1
        at = np.where((at < last) & (at < 0), 0, at)
        open_ = np.flatnonzero(at >= 0)
        while len(open_):
            own = at[open_]
            out[open_] = self._walk(data, starts[open_], ends[open_], roots[own], firsts[own])
            at[open_] += 1
            open_ = open_[(out[open_] < 0) & (at[open_] <= last[open_])]
        return out


def leading(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The first eight bytes of each word as one number, with zeros after its end: in the order of the words."""
    out = np.zeros(len(starts), np.uint64)
    for k in range(8):
        inside = starts + k < ends
        byte = np.zeros(len(starts), np.uint64)
        byte[inside] = data[starts[inside] + k]
        out = out << np.uint64(8) | byte
    return out
