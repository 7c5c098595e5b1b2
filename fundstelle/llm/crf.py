"""A linear-chain conditional random field in numpy: features of token types at offsets, trained by Adam, decoded in batches."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

import numpy as np

OFFSETS = (-2, -1, 0, 1, 2)
#: Score of a forbidden transition or label.
NEVER = -1e4
#: A feature has a weight if this many tokens of the training table have it.
LEAST = 3


def _sum_rows(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """The sums of the rows of ``values`` by their number in ``at``."""
    out = np.zeros((n, values.shape[1]))
    if len(at):
        order = np.argsort(at, kind="stable")
        sorted_at = at[order]
        starts = np.flatnonzero(np.concatenate(([True], sorted_at[1:] != sorted_at[:-1])))
        out[sorted_at[starts]] = np.add.reduceat(values[order], starts, axis=0)
    return out


class Crf:
    """``features(token, offset)`` gives a token's feature names as seen from a neighbour at that offset; flags are further
    features of a token in its place, as small integers per track. Only features of the training table have weights."""

    def __init__(self, labels: list[str], features: Callable[[str, int], list[str]], n_flags: tuple[int, ...]):
        self.labels, self.features, self.n_flags = labels, features, n_flags
        n = len(labels)
        self.index: list[dict[str, int]] = [{} for _ in OFFSETS]
        self.weights: list[np.ndarray] = []
        self.flag_weights = [np.zeros((k, n)) for k in n_flags]
        self.step, self.start = np.zeros((n, n)), np.zeros(n)
        self.allowed = np.array([[b[0] != "I" or a[1:] == b[1:] and a != "O" for b in labels] for a in labels])
        self.may_start = np.array([b[0] != "I" for b in labels])

    def fit(self, table: list[tuple[list[str], np.ndarray, list[str]]], rounds: int = 10, rate: float = 0.05, decay: float = 2e-5, batch: int = 384, seed: int = 7) -> Crf:
        """``table``: (tokens, flags as tokens x tracks, labels) per sequence."""
        types: dict[str, int] = {"": 0}
        seen: Counter = Counter()
        for tokens, _, _ in table:
            seen.update(tokens)
            for t in tokens:
                types.setdefault(t, len(types))
        padded = []
        for o, offset in enumerate(OFFSETS):
            lists, n_of = [self.features(t, offset) for t in types], Counter()
            for t, own in zip(types, lists, strict=True):
                for f in own:
                    n_of[f] += seen[t] or LEAST
            index = self.index[o] = {f: k for k, f in enumerate(f for f, n in n_of.items() if n >= LEAST)}
            kept = [[index[f] for f in own if f in index] for own in lists]
            wide = max(map(len, kept))
            padded.append(np.array([x + [len(index)] * (wide - len(x)) for x in kept]))
        n = len(self.labels)
        self.weights = [np.zeros((len(i) + 1, n)) for i in self.index]
        number = {label: k for k, label in enumerate(self.labels)}
        data = [(np.array([types[t] for t in tokens]), flags, np.array([number[x] for x in tags])) for tokens, flags, tags in table]
        params = [*self.weights, *self.flag_weights, self.step, self.start]
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        rng, time = np.random.default_rng(seed), 0
        mean, taken = [np.zeros_like(p) for p in params], 0
        lengths = np.array([len(d[0]) for d in data])
        for turn in range(rounds):
            order = np.argsort(lengths + rng.random(len(data)) * 6, kind="stable")
            parts = [order[k : k + batch] for k in range(0, len(order), batch)]
            rng.shuffle(parts)
            slow = rate * (1 - 0.8 * turn / max(1, rounds - 1))
            for part in parts:
                time += 1
                grads = self._gradient([data[k] for k in part], padded)
                for p, g, a, b in zip(params, grads, first, second, strict=True):
                    g = g / len(part) - decay * p
                    a += 0.1 * (g - a)
                    b += 0.001 * (g * g - b)
                    p += slow * (a / (1 - 0.9**time)) / (np.sqrt(b / (1 - 0.999**time)) + 1e-8)
                if 2 * turn >= rounds:  # the weights are the mean over the second half of the steps
                    taken += 1
                    for p, m in zip(params, mean, strict=True):
                        m += p
        if taken:
            for p, m in zip(params, mean, strict=True):
                p[...] = m / taken
        for w in self.weights:
            w[-1] = 0
        return self

    def _gradient(self, part: list, padded: list[np.ndarray]) -> list[np.ndarray]:
        """The gradient of the log likelihood, by forward and backward sums that are scaled at each place."""
        size, longest, n = len(part), max(len(d[0]) for d in part), len(self.labels)
        kinds, gold = np.zeros((size, longest + 4), np.int64), np.zeros((size, longest), np.int64)
        flags, real = np.zeros((size, longest, len(self.n_flags)), np.int64), np.zeros((size, longest), bool)
        for k, (t, f, y) in enumerate(part):
            kinds[k, 2 : 2 + len(t)], flags[k, : len(t)], gold[k, : len(t)], real[k, : len(t)] = t, f, y, True
        used, kinds = np.unique(kinds, return_inverse=True)
        kinds = kinds.reshape(size, longest + 4)
        scores = sum(w[p[used]].sum(axis=1)[kinds[:, o : o + longest]] for o, (w, p) in enumerate(zip(self.weights, padded, strict=True)))
        scores = scores + sum(w[flags[:, :, k]] for k, w in enumerate(self.flag_weights))
        e = np.exp(scores - scores.max(axis=2, keepdims=True))
        move, begin = np.exp(self.step) * self.allowed, np.exp(self.start) * self.may_start
        forward, scale, backward = np.zeros((longest, size, n)), np.ones((longest, size, 1)), np.ones((longest, size, n))
        for t in range(longest):
            new = e[:, t] * (begin if t == 0 else forward[t - 1] @ move)
            total = new.sum(axis=1, keepdims=True)
            on = real[:, t, None]
            scale[t] = np.where(on, total, 1)
            forward[t] = np.where(on, new / np.maximum(total, 1e-300), forward[t - 1] if t else 0)
        for t in range(longest - 2, -1, -1):
            backward[t] = np.where(real[:, t + 1, None], (e[:, t + 1] * backward[t + 1] / scale[t + 1]) @ move.T, 1)
        delta = -(forward * backward).transpose(1, 0, 2) * real[:, :, None]
        at = np.nonzero(real)
        delta[at[0], at[1], gold[at]] += 1
        inner = real[:, 1:]
        after = (e[:, 1:] * backward[1:].transpose(1, 0, 2) / scale[1:].transpose(1, 0, 2)) * inner[:, :, None]
        steps = -move * (forward[:-1].transpose(1, 0, 2).reshape(-1, n).T @ after.reshape(-1, n)) if longest > 1 else np.zeros((n, n))
        pairs = np.nonzero(inner)
        np.add.at(steps, (gold[pairs[0], pairs[1]], gold[pairs[0], pairs[1] + 1]), 1)
        grads, flat = [], delta[at]
        for o, (w, p) in enumerate(zip(self.weights, padded, strict=True)):
            by_type = _sum_rows(kinds[:, o : o + longest][at], flat, len(used))
            g = _sum_rows(p[used].ravel(), np.repeat(by_type, p.shape[1], axis=0), len(w))
            g[-1] = 0
            grads.append(g)
        for k, w in enumerate(self.flag_weights):
            grads.append(_sum_rows(flags[:, :, k][at], flat, len(w)))
        return [*grads, steps, delta[:, 0].sum(axis=0)]

    def type_scores(self, token: str) -> np.ndarray:
        """offsets x labels: what the type adds to the scores of its neighbours and its own."""
        out = np.zeros((len(OFFSETS), len(self.labels)), np.float32)
        for o, offset in enumerate(OFFSETS):
            known = [k for f in self.features(token, offset) if (k := self.index[o].get(f)) is not None]
            if known:
                out[o] = self.weights[o][known].sum(axis=0)
        return out

    def viterbi(self, scores: np.ndarray, starts: np.ndarray, ends: np.ndarray, after: np.ndarray | None = None, before: np.ndarray | None = None, cells: int = 400_000) -> np.ndarray:
        """Labels of the best path through each sequence ``scores[start:end]``; ``after`` and ``before``: whether an O stands before and after it.

        Sequences of like length are worked on together, padded to at most ``cells`` places; one longer than that is worked on alone.
        """
        out, n = np.zeros(len(scores), np.int8), len(self.labels)
        lengths = ends - starts
        after, before = (np.zeros(len(starts), bool) if x is None else x for x in (after, before))
        order = np.argsort(lengths, kind="stable")
        order = order[lengths[order] > 0]
        step = np.where(self.allowed, self.step, NEVER).astype(np.float32)
        start = np.where(self.may_start, self.start, NEVER).astype(np.float32)
        at = 0
        while at < len(order):
            size = 1
            while size < 8192 and at + size < len(order) and (size + 1) * lengths[order[at + size]] <= cells:
                size += 1
            part = order[at : at + size]
            at += size
            count, begins = lengths[part], starts[part]
            longest = int(count[-1])
            back, state = np.zeros((longest, n, size), np.int8), np.zeros(size, np.int64)
            kept = scores[begins].T + np.where(after[part], step[0][:, None], start[:, None])
            low = 0  # sequences from here on have a place t
            for t in range(longest):
                if t:
                    kept, choice = kept[:, new - low :], back[t, :, new:]
                    low = new
                    best = kept[0] + step[0][:, None]
                    for p in range(1, n):
                        offer = kept[p] + step[p][:, None]
                        better = offer > best
                        np.copyto(best, offer, where=better)
                        choice[better] = p
                    kept = best + scores[begins[low:] + t].T
                new = int(np.searchsorted(count, t + 1, "right"))
                if new > low:
                    final = kept[:, : new - low] + np.where(before[part[low:new]], step[:, :1], np.float32(0))
                    state[low:new] = final.argmax(axis=0)
            for t in range(longest - 1, -1, -1):
                low = int(np.searchsorted(count, t, "right"))
                out[begins[low:] + t] = state[low:]
                if t:
                    state[low:] = back[t, state[low:], np.arange(low, size)]
        return out
