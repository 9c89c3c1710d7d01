"""A bidirectional LSTM that labels every element of a sequence, in numpy, with its training."""

from __future__ import annotations

import numpy as np


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class BiLstm:
    """Weights of two directions (input, recurrent, bias each) and of the output."""

    def __init__(self, width: int, hidden: int, seed: int = 7):
        r = np.random.default_rng(seed)
        self.hidden = hidden
        self.w = {}
        for d in "fb":
            self.w[f"x{d}"] = r.normal(0, width**-0.5, (width, 4 * hidden)).astype(np.float32)
            self.w[f"h{d}"] = r.normal(0, hidden**-0.5, (hidden, 4 * hidden)).astype(np.float32)
            self.w[f"c{d}"] = np.repeat([0.0, 1.0, 0.0, 0.0], hidden).astype(np.float32)
        self.w["o"] = r.normal(0, hidden**-0.5, 2 * hidden).astype(np.float32)
        self.w["k"] = np.zeros(1, np.float32)

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: bool):
        n, steps, _ = x.shape
        h = self.hidden
        out = np.zeros((n, steps, h), np.float32)
        a, c = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
        before = x @ self.w[f"x{d}"] + self.w[f"c{d}"]
        trace = []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = before[:, t] + a @ self.w[f"h{d}"]
            i, f, o, g = _sigmoid(z[:, :h]), _sigmoid(z[:, h : 2 * h]), _sigmoid(z[:, 2 * h : 3 * h]), np.tanh(z[:, 3 * h :])
            new = f * c + i * g
            m = mask[:, t, None]
            tc = np.tanh(new)
            if keep:
                trace.append((t, i, f, o, g, c, a, tc, m))
            c = np.where(m, new, c)
            a = np.where(m, o * tc, a)
            out[:, t] = a
        return out, trace

    def logits(self, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        """x: batch, steps, width; mask: batch, steps."""
        f, tf = self._run(x, mask, "f", keep)
        b, tb = self._run(x, mask, "b", keep)
        both = np.concatenate([f, b], axis=2)
        return both @ self.w["o"] + self.w["k"], (both, tf, tb)

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy and its gradients, by backpropagation through time."""
        z, (both, tf, tb) = self.logits(x, mask, keep=True)
        p = _sigmoid(z)
        n = mask.sum()
        loss = -float((np.log(np.where(y, p, 1 - p) + 1e-9) * mask).sum() / n)
        dz = ((p - y) * mask / n).astype(np.float32)
        g = {"o": np.einsum("nt,nth->h", dz, both), "k": np.array([dz.sum()], np.float32)}
        dboth = dz[:, :, None] * self.w["o"]
        h = self.hidden
        for d, trace, dout in (("f", tf, dboth[:, :, :h]), ("b", tb, dboth[:, :, h:])):
            w = self.w[f"h{d}"]
            gx, gh, gc = np.zeros_like(self.w[f"x{d}"]), np.zeros_like(w), np.zeros_like(self.w[f"c{d}"])
            da, dc = np.zeros_like(dout[:, 0]), np.zeros_like(dout[:, 0])
            for t, i, f, o, c_in, c, a, tc, m in reversed(trace):
                da = da + dout[:, t]
                step = np.where(m, dc + da * o * (1 - tc**2), 0)
                dzt = np.concatenate([step * c_in * i * (1 - i), step * c * f * (1 - f), np.where(m, da * tc, 0) * o * (1 - o), step * i * (1 - c_in**2)], axis=1)
                gx += x[:, t].T @ dzt
                gh += a.T @ dzt
                gc += dzt.sum(0)
                da = np.where(m, 0, da) + dzt @ w.T
                dc = np.where(m, step * f, dc)
            g[f"x{d}"], g[f"h{d}"], g[f"c{d}"] = gx, gh, gc
        return loss, g

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]], rounds: int, rate: float = 0.01, batch: int = 32, seed: int = 3) -> float:
        """Adam over batches of (vectors, labels) of like length; returns the last round's mean loss."""
        first, second = ({k: np.zeros_like(v) for k, v in self.w.items()} for _ in range(2))
        order, t, loss = np.random.default_rng(seed), 0, 0.0
        pages = sorted(pages, key=lambda p: len(p[1]))
        for turn in range(rounds):
            losses = []
            for b in order.permutation(range(0, len(pages), batch)):
                x, mask = padded([p[0] for p in pages[b : b + batch]])
                y = np.zeros(mask.shape, bool)
                for i, p in enumerate(pages[b : b + batch]):
                    y[i, : len(p[1])] = p[1]
                loss, g = self.gradients(x, mask, y)
                losses.append(loss)
                t += 1
                size = np.sqrt(sum(float((v**2).sum()) for v in g.values()))
                for k, v in g.items():
                    v = v * min(1.0, 5.0 / (size + 1e-9))
                    first[k] += 0.1 * (v - first[k])
                    second[k] += 0.01 * (v**2 - second[k])
                    self.w[k] -= rate * (1 - turn / rounds * 0.9) * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.99**t)) + 1e-7)
            loss = float(np.mean(losses))
        return loss

    def label(self, sequences: list[np.ndarray], cells: int = 20_000) -> list[np.ndarray]:
        """Whether each element is positive; sequences of like length share a batch of at most `cells` elements."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(sequences)
        order = sorted((i for i, s in enumerate(sequences) if len(s)), key=lambda i: len(sequences[i]))
        at = 0
        while at < len(order):
            to = at + 1
            while to < len(order) and (to + 1 - at) * len(sequences[order[to]]) <= cells:
                to += 1
            x, mask = padded([sequences[i] for i in order[at:to]])
            z, _ = self.logits(x, mask)
            for row, i in enumerate(order[at:to]):
                out[i] = z[row, : len(sequences[i])] > 0
            at = to
        return out


def padded(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    longest = max(map(len, sequences))
    x = np.zeros((len(sequences), longest, sequences[0].shape[1]), np.float32)
    mask = np.zeros((len(sequences), longest), bool)
    for i, s in enumerate(sequences):
        x[i, : len(s)], mask[i, : len(s)] = s, True
    return x, mask
