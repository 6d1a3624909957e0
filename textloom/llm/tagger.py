"""A character-level bidirectional LSTM with CRF transitions, in numpy: training, emissions and decoding.

Tags are O and, for each kind k, B = 2k + 1 and I = 2k + 2. The cells couple their input to the forget gate,
c = f c + (1 - f) g and h = o tanh(c). Every character has its own row of gate inputs, so the embedding and the input
product are one gather. All gates are computed by one tanh: sigmoid(x) = (1 + tanh(x/2)) / 2.
"""

from __future__ import annotations

import numpy as np

f32 = np.float32


class Tagger:
    def __init__(self, n_chars: int, n_tags: int, hidden: int = 16, seed: int = 3):
        r = np.random.Generator(np.random.PCG64(seed))
        self.hidden = hidden
        p = {}
        for d in "fb":
            p["x" + d] = r.normal(0, 0.3, (n_chars, 3 * hidden)).astype(f32)
            p["x" + d][:, :hidden] += 0.5  # forget gates begin open
            p["h" + d] = (r.normal(0, 1, (hidden, 3 * hidden)) / np.sqrt(hidden)).astype(f32)
            p["o" + d] = r.normal(0, 0.3, (hidden, n_tags)).astype(f32)
        p["bias"] = np.zeros(n_tags, f32)
        p["trans"] = np.zeros((n_tags, n_tags), f32)
        self.p = p
        i_tags = np.arange(2, n_tags, 2)
        self.forbidden = np.zeros((n_tags, n_tags), bool)  # I only after B or I of its kind
        for i in i_tags:
            self.forbidden[:, i] = True
            self.forbidden[[i - 1, i], i] = False
        self.forbidden[1:, i_tags - 1] = True  # mentions never touch

    def transitions(self) -> np.ndarray:
        return np.where(self.forbidden, f32(-1e4), self.p["trans"])

    def _run(self, ids: np.ndarray, d: str):
        """States (steps, batch, hidden) of one direction, and what the gradient needs."""
        n, b = ids.shape
        k = self.hidden
        wx, wh = self.p["x" + d].copy(), self.p["h" + d].copy()
        wx[:, : 2 * k] *= f32(0.5)
        wh[:, : 2 * k] *= f32(0.5)
        h, c = np.zeros((b, k), f32), np.zeros((b, k), f32)
        out = np.empty((n, b, k), f32)
        kept = (np.empty((n, b, 3 * k), f32), np.empty((n, b, k), f32), np.empty((n, b, k), f32))
        for t in range(n) if d == "f" else range(n - 1, -1, -1):
            z = np.tanh(wx[ids[t]] + h @ wh)
            z[:, : 2 * k] += f32(1)
            z[:, : 2 * k] *= f32(0.5)
            kept[0][t], kept[1][t] = z, c
            g = z[:, 2 * k :]
            c = g + z[:, :k] * (c - g)
            tc = np.tanh(c)
            h = z[:, k : 2 * k] * tc
            kept[2][t] = tc
            out[t] = h
        return out, kept

    def _states(self, ids: np.ndarray, lengths: np.ndarray, d: str) -> np.ndarray:
        """Twice the states of ``_run``, for columns of ascending lengths: a column takes part in its own steps only.

        With sigmoid(x) = (1 + tanh(x/2)) / 2 the halves of the gates are taken out of the products.
        """
        n, b = ids.shape
        k = self.hidden
        wx, wh = self.p["x" + d].copy(), self.p["h" + d].copy()
        wx[:, : 2 * k] *= f32(0.5)
        wh[:, : 2 * k] *= f32(0.5)
        wh *= f32(0.5)  # the states come doubled
        h, c = np.zeros((b, k), f32), np.zeros((b, k), f32)
        out = np.zeros((n, b, k), f32)
        zs, ys, ss = np.empty((b, 3 * k), f32), np.empty((b, 3 * k), f32), np.empty((b, k), f32)
        first = np.searchsorted(lengths, np.arange(n), "right").tolist()
        for t in range(n) if d == "f" else range(n - 1, -1, -1):
            on = first[t]
            z, y, s, cc, hh = zs[on:], ys[on:], ss[on:], c[on:], h[on:]
            np.take(wx, ids[t, on:], axis=0, out=z, mode="clip")
            np.matmul(hh, wh, out=y)
            z += y
            np.tanh(z, out=z)
            g = z[:, 2 * k :]
            cc -= g
            np.multiply(cc, z[:, :k], out=s)
            cc += s
            cc *= f32(0.5)
            cc += g
            np.tanh(cc, out=s)
            np.multiply(s, z[:, k : 2 * k], out=hh)
            hh += s
            out[t, on:] = hh
        return out

    def emissions(self, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Scores (steps, batch, tags) of characters (steps, batch), columns in ascending order of length."""
        n, b = ids.shape
        e = self._states(ids, lengths, "f").reshape(n * b, -1) @ (f32(0.5) * self.p["of"])
        e += self._states(ids, lengths, "b").reshape(n * b, -1) @ (f32(0.5) * self.p["ob"])
        e += self.p["bias"]
        return e.reshape(n, b, -1)

    def _crf(self, e: np.ndarray, tags: np.ndarray):
        """Mean negative log-likelihood a character, with the gradients of emissions and transitions."""
        n, b, k = e.shape
        a = self.transitions()
        ea = np.exp(a)
        alpha, scale = np.empty((n, b, k), np.float64), np.empty((n, b, 1), np.float64)
        top = e.max(2, keepdims=True)
        x = np.exp((e - top).astype(np.float64))
        for t in range(n):
            v = x[t] if t == 0 else (alpha[t - 1] @ ea) * x[t]
            scale[t] = v.sum(1, keepdims=True)
            alpha[t] = v / scale[t]
        beta = np.ones((b, k))
        de, da = np.empty((n, b, k)), np.zeros((k, k))
        for t in range(n - 1, -1, -1):
            m = alpha[t] * beta
            de[t] = m / m.sum(1, keepdims=True)
            if t:
                w = beta * x[t] / scale[t]
                da += ea * (alpha[t - 1].T @ w)
                beta = w @ ea.T
        log_z = (np.log(scale) + top).sum()
        i, j = np.arange(n)[:, None], np.arange(b)[None]
        gold = e[i, j, tags].sum() + a[tags[:-1], tags[1:]].sum()
        de[i, j, tags] -= 1
        np.add.at(da, (tags[:-1].ravel(), tags[1:].ravel()), -1)
        da[self.forbidden] = 0
        return (log_z - gold) / (n * b), (de / (n * b)).astype(f32), (da / (n * b)).astype(f32)

    def gradients(self, ids: np.ndarray, tags: np.ndarray):
        n, b = ids.shape
        k = self.hidden
        runs = {d: self._run(ids, d) for d in "fb"}
        e = sum(runs[d][0].reshape(n * b, k) @ self.p["o" + d] for d in "fb").reshape(n, b, -1) + self.p["bias"]
        loss, de, da = self._crf(e, tags)
        g = {"trans": da, "bias": de.sum((0, 1))}
        flat = de.reshape(n * b, -1)
        for d in "fb":
            out, (gates, before, tanh_c) = runs[d]
            g["o" + d] = out.reshape(n * b, k).T @ flat
            into = (flat @ self.p["o" + d].T).reshape(n, b, k)
            wh = self.p["h" + d]
            dz = np.empty((n, b, 3 * k), f32)
            dh, dc = np.zeros((b, k), f32), np.zeros((b, k), f32)
            order = range(n - 1, -1, -1) if d == "f" else range(n)
            for t in order:
                f, o, c = (gates[t][:, q * k : (q + 1) * k] for q in range(3))
                dh = dh + into[t]
                tc = tanh_c[t]
                dc = dc + dh * o * (1 - tc * tc)
                z = dz[t]
                z[:, :k] = dc * (before[t] - c) * f * (1 - f)
                z[:, k : 2 * k] = dh * tc * o * (1 - o)
                z[:, 2 * k :] = dc * (1 - f) * (1 - c * c)
                dh = z @ wh.T
                dc = dc * f
            prev = np.zeros_like(out)
            if d == "f":
                prev[1:] = out[:-1]
            else:
                prev[:-1] = out[1:]
            g["h" + d] = prev.reshape(n * b, k).T @ dz.reshape(n * b, -1)
            gx = np.zeros_like(self.p["x" + d])
            order = np.argsort(ids.ravel(), kind="stable")
            sorted_ids = ids.ravel()[order]
            first = np.flatnonzero(np.diff(sorted_ids, prepend=-1))
            gx[sorted_ids[first]] = np.add.reduceat(dz.reshape(n * b, -1)[order], first, axis=0)
            g["x" + d] = gx
        return loss, g

    def fit(self, batches, rate: float = 0.02, steps: int = 400) -> list[float]:
        """Adam over ``batches``, pairs of characters and tags (steps, batch); the rate falls to a tenth."""
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        losses = []
        for s, (ids, tags) in enumerate(batches, 1):
            loss, g = self.gradients(ids, tags)
            losses.append(float(loss))
            norm = np.sqrt(sum(float((x.astype(np.float64) ** 2).sum()) for x in g.values()))
            now = rate * (1 - 0.9 * min(1, s / steps))
            for k, x in g.items():
                x = x * f32(min(1, 1 / (norm + 1e-9)))
                m[k] += f32(0.1) * (x - m[k])
                v[k] += f32(0.005) * (x * x - v[k])
                self.p[k] -= f32(now) * (m[k] / f32(1 - 0.9**s)) / (np.sqrt(v[k] / f32(1 - 0.995**s)) + f32(1e-8))
        return losses

    def decode(self, stretches: list[np.ndarray], block: int = 256) -> list[np.ndarray]:
        """The best tags of stretches of emissions (steps, tags), each with one character outside before and after it."""
        a = self.transitions()
        k = len(a)
        out: list[np.ndarray] = [np.empty(0, np.int64)] * len(stretches)
        order = sorted(range(len(stretches)), key=lambda i: len(stretches[i]))
        for lo in range(0, len(order), block):
            mine = order[lo : lo + block]
            n = len(stretches[mine[-1]]) + 2
            e = np.full((n, len(mine), k), -1e4, f32)  # before its begin and beyond its end a stretch is outside
            e[:, :, 0] = 0
            for j, i in enumerate(mine):
                e[1 : len(stretches[i]) + 1, j] = stretches[i]
            score = e[0]
            back = np.empty((n, len(mine), k), np.int8)
            for t in range(1, n):
                m = score[:, :, None] + a[None]
                back[t] = m.argmax(1)
                score = m.max(1) + e[t]
            tag = score.argmax(1)
            tags, rows = np.empty((n, len(mine)), np.int64), np.arange(len(mine))
            for t in range(n - 1, -1, -1):
                tags[t] = tag
                tag = back[t, rows, tag] if t else tag
            for j, i in enumerate(mine):
                out[i] = tags[1 : len(stretches[i]) + 1, j]
        return out
