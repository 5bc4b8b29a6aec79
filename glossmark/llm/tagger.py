"""A character-level bidirectional LSTM with CRF transitions, trained and decoded in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Code points 32..126 have an index of their own; the rest share one for white space and one for other characters; 0 pads.
VOCAB = 98


def char_ids(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    ids = np.where((points >= 32) & (points < 127), points - 31, 97)
    return np.where((points >= 9) & (points <= 13), 96, ids).astype(np.int16)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1.0)


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(x - m).sum(axis=axis))


@dataclass
class Tagger:
    """Weights by name; ``tags[0]`` is outside, then a begin and an inside tag for every kind."""

    kinds: tuple[str, ...]
    w: dict[str, np.ndarray]

    @property
    def n_tags(self) -> int:
        return 1 + 2 * len(self.kinds)

    @classmethod
    def fresh(cls, kinds: tuple[str, ...], hidden: int = 16, seed: int = 7) -> Tagger:
        rng, t = np.random.default_rng(seed), 1 + 2 * len(kinds)
        g = lambda *s: (rng.standard_normal(s) * (1.0 / np.sqrt(s[0]))).astype(np.float32)
        w = {"emit": g(2 * hidden, t), "emit_b": np.zeros(t, np.float32), "trans": np.zeros((t, t), np.float32)}
        for d in "fb":
            # A one-hot character times the input weights is a row of the table.
            w |= {f"{d}_in": g(VOCAB, 4 * hidden) * 3, f"{d}_rec": g(hidden, 4 * hidden), f"{d}_bias": np.zeros(4 * hidden, np.float32)}
            w[f"{d}_bias"][hidden : 2 * hidden] = 1.0
        return cls(kinds, w)

    def _lstm(self, d: str, chars: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
        """chars: (steps, windows) in the direction's order. Returns the outputs and what the gradient needs."""
        h_n = self.w[f"{d}_rec"].shape[0]
        table, rec = self.w[f"{d}_in"] + self.w[f"{d}_bias"], self.w[f"{d}_rec"]
        h = np.zeros((chars.shape[1], h_n), np.float32)
        c, out, kept = h.copy(), np.empty((*chars.shape, h_n), np.float32), []
        for t, x in enumerate(chars):
            z = table[x] + h @ rec
            s = _sigmoid(z[:, : 3 * h_n])
            i, f, o, g = s[:, :h_n], s[:, h_n : 2 * h_n], s[:, 2 * h_n :], np.tanh(z[:, 3 * h_n :])
            before, c = (h, c), f * c + i * g
            tc = np.tanh(c)
            h = o * tc
            out[t] = h
            if keep:
                kept.append((i, f, o, g, tc, *before))
        return out, kept

    def _lstm_grad(self, d: str, chars: np.ndarray, kept: list, d_out: np.ndarray, grad: dict) -> None:
        rec = self.w[f"{d}_rec"]
        dh = np.zeros_like(d_out[0])
        dc = dh.copy()
        g_rec, d_z = np.zeros_like(rec), np.empty((*chars.shape, rec.shape[1]), np.float32)
        for t in range(len(chars) - 1, -1, -1):
            i, f, o, g, tc, h0, c0 = kept[t]
            dh = dh + d_out[t]
            dc = dc + dh * o * (1 - tc * tc)
            dz = np.concatenate([dc * g * i * (1 - i), dc * c0 * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], axis=1)
            d_z[t] = dz
            g_rec += h0.T @ dz
            dh, dc = dz @ rec.T, dc * f
        one_hot = (np.arange(VOCAB)[:, None] == chars.reshape(1, -1)).astype(np.float32)
        g_in = one_hot @ d_z.reshape(-1, rec.shape[1])
        grad[f"{d}_in"], grad[f"{d}_rec"], grad[f"{d}_bias"] = g_in, g_rec, g_in.sum(axis=0)

    def emissions(self, chars: np.ndarray, keep: bool = False) -> tuple[np.ndarray, tuple]:
        """chars: (windows, steps). Returns (steps, windows, tags)."""
        fwd = np.ascontiguousarray(chars.T)
        a, ka = self._lstm("f", fwd, keep)
        b, kb = self._lstm("b", fwd[::-1], keep)
        both = np.concatenate([a, b[::-1]], axis=2)
        return both @ self.w["emit"] + self.w["emit_b"], (fwd, both, ka, kb)

    def loss(self, chars: np.ndarray, tags: np.ndarray) -> tuple[float, dict]:
        """Mean negative log likelihood of whole windows, and its gradient."""
        e, (fwd, both, ka, kb) = self.emissions(chars, True)
        n_t, n, k = e.shape
        trans, gold, each = self.w["trans"], tags.T, np.arange(n)
        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[0] = e[0]
        for t in range(1, n_t):
            alpha[t] = e[t] + _logsumexp(alpha[t - 1][:, :, None] + trans, 1)
        for t in range(n_t - 2, -1, -1):
            beta[t] = _logsumexp(trans + (e[t + 1] + beta[t + 1])[:, None, :], 2)
        z = _logsumexp(alpha[-1], 1)
        score = sum(e[t, each, gold[t]] for t in range(n_t)) + sum(trans[gold[t - 1], gold[t]] for t in range(1, n_t))
        d_e = np.exp(alpha + beta - z[:, None])
        d_trans = np.zeros_like(trans)
        for t in range(1, n_t):
            # exp(alpha) and exp(e + beta) are shifted by parts of z, so that neither overflows.
            left, right = alpha[t - 1] - z[:, None], e[t] + beta[t]
            shift = right.max(axis=1, keepdims=True)
            d_trans += (np.exp(left + shift).T @ np.exp(right - shift)) * np.exp(trans)
            np.add.at(d_trans, (gold[t - 1], gold[t]), -1.0)
        for t in range(n_t):
            d_e[t, each, gold[t]] -= 1.0
        d_e /= n
        grad = {"trans": d_trans / n, "emit": np.einsum("tnh,tnk->hk", both, d_e), "emit_b": d_e.sum(axis=(0, 1))}
        d_both, h = d_e @ self.w["emit"].T, both.shape[2] // 2
        self._lstm_grad("f", fwd, ka, d_both[:, :, :h], grad)
        self._lstm_grad("b", fwd[::-1], kb, d_both[::-1, :, h:], grad)
        return float((z - score).mean()), grad

    def fit(self, chars: np.ndarray, tags: np.ndarray, epochs: int, batch: int = 32, rate: float = 0.05, seed: int = 11) -> Tagger:
        """Adam over shuffled batches, with a falling rate; the same rows and seed give the same weights."""
        rng, m, v, step = np.random.default_rng(seed), {}, {}, 0
        steps = epochs * -(-len(chars) // batch)
        for _ in range(epochs):
            order = rng.permutation(len(chars))
            for a in range(0, len(order), batch):
                _, grad = self.loss(chars[order[a : a + batch]], tags[order[a : a + batch]])
                size = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
                step += 1
                now = rate * (1 - 0.9 * step / steps) * min(1.0, 5.0 / (size + 1e-9))
                for k, g in grad.items():
                    m[k] = 0.9 * m.get(k, 0.0) + 0.1 * g
                    v[k] = 0.99 * v.get(k, 0.0) + 0.01 * g * g
                    self.w[k] = (self.w[k] - now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
        return self

    def decode(self, chars: np.ndarray) -> np.ndarray:
        """The best tag sequence of every window: (windows, steps)."""
        e, _ = self.emissions(chars)
        n_t, n, k = e.shape
        best, back = e[0], np.empty((n_t, n, k), np.int8)
        for t in range(1, n_t):
            s = best[:, :, None] + self.w["trans"]
            back[t] = s.argmax(axis=1)
            best = s.max(axis=1) + e[t]
        out = np.empty((n, n_t), np.int8)
        out[:, -1] = best.argmax(axis=1)
        for t in range(n_t - 1, 0, -1):
            out[:, t - 1] = back[t, np.arange(n), out[:, t]]
        return out
