"""A bidirectional LSTM over characters with CRF transitions, in numpy.

States are outside, and begin and inside of each kind; an inside follows its own begin or inside only.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_NEVER = -1e4


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _sum_exp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def allowed(kinds: int) -> np.ndarray:
    """Zero where a state may follow another, else a score that never wins."""
    states = 1 + 2 * kinds
    out = np.zeros((states, states))
    for k in range(kinds):
        out[:, 2 + 2 * k] = _NEVER
        out[[1 + 2 * k, 2 + 2 * k], 2 + 2 * k] = 0
    return out


@dataclass
class Tagger:
    """Weights: of each direction for the character, the state before and the bias; output; transitions."""

    weights: list[np.ndarray]
    kinds: int

    @classmethod
    def fresh(cls, characters: int, kinds: int, hidden: int, seed: int) -> Tagger:
        rng = np.random.default_rng(seed)
        weights = []
        for _ in range(2):
            bias = np.zeros(4 * hidden)
            bias[hidden : 2 * hidden] = 1  # remember at first
            weights += [rng.normal(0, 0.3, (characters, 4 * hidden)), rng.normal(0, hidden**-0.5, (hidden, 4 * hidden)), bias]
        states = 1 + 2 * kinds
        weights += [rng.normal(0, hidden**-0.5, (2 * hidden, states)), np.zeros(states), np.zeros((states, states))]
        return cls(weights, kinds)

    def _direction(self, x: np.ndarray, of_char, of_state, bias, keep: bool):
        n, steps = x.shape
        hidden = of_state.shape[0]
        h, c = (np.zeros((n, hidden), of_state.dtype) for _ in range(2))
        out, kept = np.empty((steps, n, hidden), of_state.dtype), []
        given = of_char + bias
        for t in range(steps):
            z = given[x[:, t]] + h @ of_state
            gates = _sigmoid(z[:, : 3 * hidden])
            i, f, o = gates[:, :hidden], gates[:, hidden : 2 * hidden], gates[:, 2 * hidden :]
            g = np.tanh(z[:, 3 * hidden :])
            before, c = c, f * c + i * g
            bent = np.tanh(c)
            last, h = h, o * bent
            out[t] = h
            if keep:
                kept.append((i, f, o, g, before, bent, last))
        return out, kept

    def emissions(self, x: np.ndarray, keep: bool = False):
        """Scores (windows, characters, states) of windows of character numbers."""
        w = self.weights
        there, kept = self._direction(x, *w[:3], keep)
        back, kept_back = self._direction(x[:, ::-1], *w[3:6], keep)
        both = np.concatenate((there, back[::-1]), axis=2).transpose(1, 0, 2)
        out = both @ w[6] + w[7]
        return (out, both, kept, kept_back) if keep else out

    def _back(self, x, of_state, kept, d_out):
        """Gradients of one direction from those of its outputs (steps, windows, hidden)."""
        hidden = of_state.shape[0]
        d_char = np.zeros((self.weights[0].shape[0], 4 * hidden))
        d_state, d_bias = np.zeros_like(of_state), np.zeros(4 * hidden)
        each = np.eye(len(d_char))
        d_h = d_c = 0
        for t in range(len(kept) - 1, -1, -1):
            i, f, o, g, before, bent, last = kept[t]
            d_h = d_h + d_out[t]
            d_c = d_c + d_h * o * (1 - bent**2)
            d_z = np.concatenate((d_c * g * i * (1 - i), d_c * before * f * (1 - f), d_h * bent * o * (1 - o), d_c * i * (1 - g**2)), axis=1)
            d_char += each[x[:, t]].T @ d_z
            d_state += last.T @ d_z
            d_bias += d_z.sum(0)
            d_h, d_c = d_z @ of_state.T, d_c * f
        return [d_char, d_state, d_bias]

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean negative log likelihood of the states ``y`` and its gradients."""
        w, n = self.weights, len(x)
        e, both, kept, kept_back = self.emissions(x, keep=True)
        moves, steps = w[8] + allowed(self.kinds), x.shape[1]
        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[:, 0] = e[:, 0]
        for t in range(1, steps):
            alpha[:, t] = e[:, t] + _sum_exp(alpha[:, t - 1, :, None] + moves, 1)
        for t in range(steps - 2, -1, -1):
            beta[:, t] = _sum_exp(moves + (e[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
        total = _sum_exp(alpha[:, -1], 1)
        d_e = np.exp(alpha + beta - total[:, None, None])
        pairs = np.exp(alpha[:, :-1, :, None] + moves + (e[:, 1:] + beta[:, 1:])[:, :, None, :] - total[:, None, None, None])
        d_moves = pairs.sum((0, 1))
        np.add.at(d_moves, (y[:, :-1], y[:, 1:]), -1)
        rows, cols = np.arange(n)[:, None], np.arange(steps)[None, :]
        score = e[rows, cols, y].sum() + moves[y[:, :-1], y[:, 1:]].sum()
        d_e[rows, cols, y] -= 1
        d_e /= n
        d_both = (d_e @ w[6].T).transpose(1, 0, 2)
        hidden = w[1].shape[0]
        grads = self._back(x, w[1], kept, d_both[:, :, :hidden])
        grads += self._back(x[:, ::-1], w[4], kept_back, d_both[::-1, :, hidden:])
        flat = d_e.reshape(-1, d_e.shape[2])
        grads += [both.reshape(-1, 2 * hidden).T @ flat, flat.sum(0), d_moves / n]
        return float((total.sum() - score) / n), grads

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int, batch: int, rate: float, seed: int) -> Tagger:
        """Adam with clipped gradients and a rate that falls to a tenth."""
        rng, w, step = np.random.default_rng(seed), self.weights, 0
        m, v = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w]
        steps = epochs * -(-len(x) // batch)
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for at in (order[i : i + batch] for i in range(0, len(x), batch)):
                _, grads = self.gradients(x[at], y[at])
                size = np.sqrt(sum(float((g * g).sum()) for g in grads))
                step += 1
                for k, g in enumerate(grads):
                    g = g * min(1.0, 5.0 / (size + 1e-9))
                    m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                    w[k] -= rate * (1 - 0.9 * step / steps) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return self

    def compact(self) -> Tagger:
        """In single precision, for tagging."""
        return Tagger([p.astype(np.float32) for p in self.weights], self.kinds)

    def decode(self, e: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The best states (rows, characters) for emissions padded to one length."""
        moves = (self.weights[8] + allowed(self.kinds)).astype(e.dtype)
        n, steps, states = e.shape
        via = np.zeros((steps, n, states), np.int8)
        start = np.zeros(states, e.dtype)
        start[2::2] = _NEVER  # nothing begins with an inside
        score = e[:, 0] + start
        for t in range(1, steps):
            ways = score[:, :, None] + moves
            via[t] = ways.argmax(axis=1)
            live = (t < lengths)[:, None]
            score = np.where(live, ways.max(axis=1) + e[:, t], score)
        out = np.zeros((n, steps), np.int8)
        state = score.argmax(axis=1)
        rows = np.arange(n)
        for t in range(steps - 1, -1, -1):
            live = t < lengths
            out[live, t] = state[live]
            state = np.where(live, via[t, rows, state], state)
        return out
