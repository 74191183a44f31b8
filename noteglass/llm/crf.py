"""A linear-chain conditional random field over sparse string features, in numpy."""

from __future__ import annotations

import numpy as np

LABELS = "OBI"


class Model:
    """Weights of features (feature to one value for each label) and of label changes."""

    def __init__(self, weights: dict[str, tuple[float, ...]], moves: list[list[float]], start: float = 0.0):
        self.weights, self.moves, self.start = weights, moves, start

    def leaning(self, odds: float) -> Model:
        """The same model with more (or less) belief in the start of a span, wherever it is."""
        return Model(self.weights, [[row[0], row[1] + odds, row[2]] for row in self.moves], self.start + odds)

    def emission(self, features) -> list[float]:
        o = b = i = 0.0
        get = self.weights.get
        for f in features:
            w = get(f)
            if w is not None:
                o, b, i = o + w[0], b + w[1], i + w[2]
        return [o, b, i]

    def viterbi(self, emissions: list[list[float]]) -> list[int]:
        """The best label sequence; I never follows O and never comes first."""
        if not emissions:
            return []
        (oo, ob, oi), (bo, bb, bi), (io, ib, ii) = self.moves
        o, b, i = emissions[0][0], emissions[0][1] + self.start, -1e9
        back = []
        for eo, eb, ei in emissions[1:]:
            x, y, z = o + oo, b + bo, i + io
            to, fo = (x, 0) if x >= y and x >= z else (y, 1) if y >= z else (z, 2)
            x, y, z = o + ob, b + bb, i + ib
            tb, fb = (x, 0) if x >= y and x >= z else (y, 1) if y >= z else (z, 2)
            y, z = b + bi, i + ii
            ti, fi = (y, 1) if y >= z else (z, 2)
            o, b, i = to + eo, tb + eb, ti + ei
            back.append((fo, fb, fi))
        score = [o, b, i]
        path = [max(range(3), key=score.__getitem__)]
        for came in reversed(back):
            path.append(came[path[-1]])
        return path[::-1]


def fit(sequences: list[tuple[list[list[str]], list[int]]], epochs: int = 12, size: int = 128, rate: float = 0.3, decay: float = 1e-5, seed: int = 11) -> Model:
    """Maximum likelihood by Adagrad over mini-batches of sequences (features of each token, labels)."""
    names: dict[str, int] = {}
    data = []
    for feats, labels in sequences:
        if labels:
            data.append(([np.array(sorted({names.setdefault(f, len(names)) for f in fs}), dtype=np.int64) for fs in feats], np.array(labels)))
    rng, n = np.random.default_rng(seed), len(LABELS)
    w, moves = np.zeros((len(names), n)), np.zeros((n, n))
    sum_w, sum_m = np.full_like(w, 1e-6), np.full_like(moves, 1e-6)
    barred = np.zeros((n, n))
    barred[0, 2] = -1e9
    data.sort(key=lambda x: len(x[1]))
    batches = [data[k : k + size] for k in range(0, len(data), size)]
    for _ in range(epochs):
        for k in rng.permutation(len(batches)):
            part = batches[k]
            count, longest = len(part), max(len(y) for _, y in part)
            flat = np.concatenate([f for fs, _ in part for f in fs])
            cuts = np.cumsum([0] + [len(f) for fs, _ in part for f in fs])[:-1]
            token = np.repeat(np.arange(len(cuts)), np.diff(np.append(cuts, len(flat))))
            lengths = np.array([len(y) for _, y in part])
            mask = np.arange(longest)[None] < lengths[:, None]
            e = np.zeros((count, longest, n))
            gold = np.zeros((count, longest), dtype=int)
            e[mask] = np.add.reduceat(w[flat], cuts)
            gold[mask] = np.concatenate([y for _, y in part])
            e[:, 0, 2] = -1e9
            m = moves + barred
            alpha, beta = np.zeros_like(e), np.zeros_like(e)
            alpha[:, 0] = e[:, 0]
            for t in range(1, longest):
                step = np.logaddexp.reduce(alpha[:, t - 1, :, None] + m[None], axis=1) + e[:, t]
                alpha[:, t] = np.where(mask[:, t, None], step, alpha[:, t - 1])
            total = np.logaddexp.reduce(alpha[:, -1], axis=1)
            for t in range(longest - 2, -1, -1):
                step = np.logaddexp.reduce(m[None] + (e[:, t + 1] + beta[:, t + 1])[:, None, :], axis=2)
                beta[:, t] = np.where(mask[:, t + 1, None], step, 0.0)
            state = np.exp(np.minimum(alpha + beta - total[:, None, None], 0))
            grad = -state
            np.put_along_axis(grad, gold[..., None], np.take_along_axis(grad, gold[..., None], 2) + 1, 2)
            pull = np.zeros_like(w)
            np.add.at(pull, flat, grad[mask][token])
            change = np.zeros((n, n))
            for t in range(1, longest):
                live = mask[:, t]
                if live.any():
                    both = alpha[live, t - 1, :, None] + m[None] + (e[live, t] + beta[live, t])[:, None, :] - total[live, None, None]
                    change -= np.exp(np.minimum(both, 0)).sum(0)
                    np.add.at(change, (gold[live, t - 1], gold[live, t]), 1)
            touched = np.unique(flat)
            step = pull[touched] / count - decay * w[touched]
            sum_w[touched] += step**2
            w[touched] += rate * step / np.sqrt(sum_w[touched])
            step = change / count
            sum_m += step**2
            moves += rate * step / np.sqrt(sum_m)
    kept = np.abs(w - w.mean(1, keepdims=True)).max(1) > 1e-3
    return Model({f: tuple(map(float, w[k])) for f, k in names.items() if kept[k]}, (moves + barred).tolist())
