"""Weighted acyclic automata over sequences of 64-bit labels, as flat arrays.

An automaton of depth ``n`` accepts sequences of ``n`` labels, each with a weight. It is built from
sorted sequences: the states of the last level first, then level by level towards the root, and a
state whose arcs (label, weight or target) equal those of a state already registered becomes that
state. Arcs of a state are in order of their labels, so that paths come out sorted and a sequence is
looked up by one binary search per level.
"""

from __future__ import annotations

import numpy as np

from gaugework.llm.words import mix


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places start, start + 1, .. of every run, one run after the other."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts, sizes)


def _registered(labels: np.ndarray, values: np.ndarray, starts: np.ndarray) -> tuple:
    """The state of every run of arcs, equal runs one state; labels, values and bounds of the states."""
    sizes = np.diff(np.append(starts, len(labels)))
    place = np.arange(len(labels)) - np.repeat(starts, sizes)
    arcs = mix(labels ^ mix(values.astype(np.uint64) * np.uint64(2) + np.uint64(1)) + mix(place.astype(np.uint64)))
    _, first, state = np.unique(np.add.reduceat(arcs, starts), return_index=True, return_inverse=True)
    # a signature only proposes: runs that differ from the registered one stay states of their own
    model = first[state]
    alike = sizes == sizes[model]
    at, to = ragged(starts[alike], sizes[alike]), ragged(starts[model[alike]], sizes[alike])
    same = (labels[at] == labels[to]) & (values[at] == values[to])
    if len(at):
        alike[alike] = np.logical_and.reduceat(same, np.cumsum(sizes[alike]) - sizes[alike])
    odd = np.flatnonzero(~alike)
    state[odd] = len(first) + np.arange(len(odd))
    kept = np.append(first, odd)
    taken = ragged(starts[kept], sizes[kept])
    return state, labels[taken], values[taken], np.append(0, np.cumsum(sizes[kept]))


class Automaton:
    """``levels[d]`` holds labels, targets (weights at the last level) and bounds of the states of depth d; the root is state 0."""

    def __init__(self, levels: list[tuple]):
        self.levels = levels

    @classmethod
    def build(cls, paths: list[np.ndarray], weights: np.ndarray) -> "Automaton":
        """From sorted, distinct sequences given as one array of labels per position; not empty."""
        levels, values = [], np.asarray(weights, np.int64)
        ends = np.arange(len(values))  # of each sequence, its first one with the same first labels
        for d in range(len(paths) - 1, -1, -1):
            heads = paths[:d]
            labels = paths[d][ends]
            turn = np.zeros(len(ends), bool)
            turn[0] = True
            for h in heads:
                own = h[ends]
                turn[1:] |= own[1:] != own[:-1]
            starts = np.flatnonzero(turn)
            state, labels, values, bounds = _registered(labels, values, starts)
            levels.append((labels, values, bounds))
            values, ends = state, ends[starts]
        return cls(levels[::-1])

    def paths(self) -> tuple[list[np.ndarray], np.ndarray]:
        """All sequences, sorted, and their weights."""
        heads: list[np.ndarray] = []
        states = np.zeros(1, np.int64)
        for labels, values, bounds in self.levels:
            sizes = bounds[states + 1] - bounds[states]
            at = ragged(bounds[states], sizes)
            heads = [np.repeat(h, sizes) for h in heads] + [labels[at]]
            states = values[at]
        return heads, states

    def weights_of(self, wanted: list[np.ndarray]) -> np.ndarray:
        """Composition with given sequences: the weight of each, 0 where there is none."""
        states, alive = np.zeros(len(wanted[0]), np.int64), np.ones(len(wanted[0]), bool)
        for name, (labels, values, bounds) in zip(wanted, self.levels):
            low, stop = bounds[states].copy(), bounds[states + 1]
            high = stop.copy()
            while (open_ := low < high).any():  # all binary searches at once
                middle = (low + high) // 2
                less = open_ & (labels[np.minimum(middle, len(labels) - 1)] < name)
                low = np.where(less, middle + 1, low)
                high = np.where(open_ & ~less, middle, high)
            met = np.minimum(low, len(labels) - 1)
            alive &= (low < stop) & (labels[met] == name)
            states = np.where(alive, values[met], 0)
        return np.where(alive, states, 0)

    def pack(self) -> bytes:
        head, body = [len(self.levels)], []
        for labels, values, bounds in self.levels:
            wide = int(values.max(initial=0)) >= 1 << 31
            head += [len(labels), len(bounds), int(wide)]
            body += [labels.astype("<u8").tobytes(), values.astype("<i8" if wide else "<i4").tobytes(), bounds.astype("<i4").tobytes()]
        return np.array(head, "<i8").tobytes() + b"".join(body)

    @classmethod
    def unpack(cls, data: bytes) -> "Automaton":
        depth = int(np.frombuffer(data, "<i8", 1)[0])
        head = np.frombuffer(data, "<i8", 3 * depth, 8).reshape(-1, 3).tolist()
        at, levels = 8 + 24 * depth, []
        for arcs, states, wide in head:
            labels = np.frombuffer(data, "<u8", arcs, at)
            at += 8 * arcs
            values = np.frombuffer(data, "<i8" if wide else "<i4", arcs, at).astype(np.int64)
            at += (8 if wide else 4) * arcs
            bounds = np.frombuffer(data, "<i4", states, at).astype(np.int64)
            at += 4 * states
            levels.append((labels, values, bounds))
        return cls(levels)


def summed(paths: list[np.ndarray], weights: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Sequences in order, each once, with the sum of its weights."""
    order = np.lexsort(paths[::-1])
    paths, weights = [p[order] for p in paths], weights[order]
    turn = np.ones(len(weights), bool)
    turn[1:] = np.logical_or.reduce([p[1:] != p[:-1] for p in paths])
    starts = np.flatnonzero(turn)
    return [p[starts] for p in paths], np.add.reduceat(weights, starts)


def union(blobs, at_once: int = 1 << 21) -> tuple[list[np.ndarray], np.ndarray]:
    """The sequences of all automata with their summed weights, some ``at_once`` more at a time."""
    held, weights, size = [], [], 0

    def folded():
        paths, total = summed([np.concatenate(c) for c in zip(*held)], np.concatenate(weights))
        return [paths], [total]

    for blob in blobs:
        paths, own = Automaton.unpack(blob).paths()
        held.append(paths)
        weights.append(own)
        size += len(own)
        if size >= at_once:
            (held, weights), size = folded(), 0
    (paths,), (total,) = folded()
    return paths, total
