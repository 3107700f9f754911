"""A linear-chain conditional random field over string features: maximum likelihood, Viterbi decoding."""

from __future__ import annotations

from collections import Counter

import numpy as np


class LinearChainCRF:
    """``classes`` labels; unknown features weigh nothing."""

    def __init__(self, classes: int):
        self.classes = classes
        self.index: dict[str, int] = {}
        self.weights = np.zeros((1, classes))
        self.moves = np.zeros((classes, classes))
        self.first = np.zeros(classes)

    def emissions(self, sequence: list[list[str]]) -> np.ndarray:
        get = self.index.get
        at = [(t, i) for t, names in enumerate(sequence) for i in map(get, names) if i is not None]
        if not at:
            return np.zeros((len(sequence), self.classes))
        token, feature = np.array(at).T
        return np.stack([np.bincount(token, self.weights[feature, c], len(sequence)) for c in range(self.classes)], 1)

    def decode(self, emissions: np.ndarray, first: np.ndarray | None = None) -> list[int]:
        """The likeliest labels; of equal ones the first."""
        if not len(emissions):
            return []
        labels, into = range(self.classes), self.moves.T.tolist()
        best, *rest = emissions.tolist()
        best = [a + b for a, b in zip((self.first if first is None else first).tolist(), best, strict=True)]
        back = []
        for gain in rest:
            came, after = [], []
            for y in labels:
                score = [a + b for a, b in zip(best, into[y], strict=True)]
                top = max(score)
                came.append(score.index(top))
                after.append(top + gain[y])
            back.append(came)
            best = after
        path = [best.index(max(best))]
        for came in reversed(back):
            path.append(came[path[-1]])
        return path[::-1]

    def other_than_first(self, emissions: np.ndarray) -> dict[int, int]:
        """The places of ``decode``'s path whose label isn't 0, for sequences that are 0 nearly everywhere.

        A label's profit over 0 in any company is at most its emission's plus a bound from the moves. Where no label
        can profit the path is 0, so that the stretches between are decoded one by one, with a 0 on either side.
        """
        n, m = len(emissions), self.moves
        into, out = m - m[:, :1], m - m[:1]  # over 0: from each label, and to each label
        start, end = np.append(into, [self.first - self.first[0]], 0).max(0), np.append(out, np.zeros((self.classes, 1)), 1).max(1)
        unsure = ((emissions - emissions[:, :1] + start + end)[:, 1:] >= -1e-9).any(1)
        at = np.flatnonzero(unsure)
        found: dict[int, int] = {}
        if not len(at):
            return found
        cuts = np.flatnonzero(np.diff(at) > 1) + 1
        for run in np.split(at, cuts):
            lo, hi = int(run[0]), int(run[-1]) + 1
            part = emissions[lo:hi].copy()
            if hi < n:
                part[-1] += m[:, 0]
            labels = self.decode(part, m[0] if lo else None)
            found.update((lo + i, y) for i, y in enumerate(labels) if y)
        return found

    def fit(self, sequences: list[list[list[str]]], labels: list[list[int]], epochs: int = 120, rate: float = 0.3, ridge: float = 1e-3, least: int = 1) -> LinearChainCRF:
        """Full-batch Adagrad on the mean log likelihood, with forward-backward over all sequences at once.

        Features of fewer than ``least`` tokens are left out.
        """
        keep = [i for i, s in enumerate(sequences) if s]
        sequences, labels = [sequences[i] for i in keep], [labels[i] for i in keep]
        if not sequences:
            return self
        seen = Counter(name for s in sequences for names in s for name in names)
        self.index = {name: i for i, name in enumerate(name for name, n in seen.items() if n >= least)}
        by = sorted(range(len(sequences)), key=lambda i: -len(sequences[i]))
        sequences, labels = [sequences[i] for i in by], [labels[i] for i in by]
        k, n, length = self.classes, len(sequences), np.array([len(s) for s in sequences])
        live = [int((length > t).sum()) for t in range(length[0])]  # sequences that have a token at t: the first so many
        # tokens by place, then sequence; many have the same features, and these are weighed once
        sets: dict[tuple, int] = {}
        kind = np.array([sets.setdefault(tuple(self.index[x] for x in sequences[i][t] if x in self.index), len(sets)) for t, m in enumerate(live) for i in range(m)], int)
        owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        feature = np.array([i for x in sets for i in x], int)
        truth = np.eye(k)[[labels[i][t] for t, m in enumerate(live) for i in range(m)]]
        at = np.cumsum([0, *live])
        part = [slice(at[t], at[t + 1]) for t in range(len(live))]
        pair_truth = sum((truth[part[t - 1]][: live[t]].T @ truth[part[t]] for t in range(1, len(live))), np.zeros((k, k)))
        self.weights = np.zeros((len(self.index), k))
        speed = [np.full_like(p, 1e-8) for p in (self.weights, self.moves, self.first)]
        for _ in range(epochs):
            of_set = np.stack([np.bincount(owner, self.weights[feature, c], len(sets)) for c in range(k)], 1)
            emission = np.exp(of_set - of_set.max(1, keepdims=True))[kind]
            move, first = np.exp(self.moves - self.moves.max()), np.exp(self.first - self.first.max())
            # forward and backward probabilities, scaled at every step
            alpha, beta, pairs = np.zeros_like(emission), np.ones_like(emission), np.zeros((k, k))
            for t, m in enumerate(live):
                x = emission[part[t]] * (alpha[part[t - 1]][:m] @ move if t else first)
                alpha[part[t]] = x / x.sum(1, keepdims=True)
            for t in range(len(live) - 2, -1, -1):
                m = live[t + 1]
                after = emission[part[t + 1]] * beta[part[t + 1]]
                before, x = alpha[part[t]][:m], after @ move.T
                pairs += move * ((before / (before * x).sum(1, keepdims=True)).T @ after)
                beta[at[t] : at[t] + m] = x / x.sum(1, keepdims=True)
            share = alpha * beta
            gap = truth - share / share.sum(1, keepdims=True)
            of_set = np.stack([np.bincount(kind, gap[:, c], len(sets)) for c in range(k)], 1)
            slope = np.stack([np.bincount(feature, of_set[owner, c], len(self.weights)) for c in range(k)], 1)
            for p, g, v in zip((self.weights, self.moves, self.first), (slope, pair_truth - pairs, gap[part[0]].sum(0)), speed, strict=True):
                g = g / n - ridge * p
                v += g * g
                p += rate * g / np.sqrt(v)
        return self
