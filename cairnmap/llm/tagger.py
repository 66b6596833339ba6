"""A character-level bidirectional LSTM with CRF transitions, in numpy: training, marginals and best paths over windows."""

from __future__ import annotations

import numpy as np

#: Character classes: 0 is padding, ASCII by itself but for digits (one class), others by remainder.
CLASSES = 160
_DIGIT = 1


def classes(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.where(codes < 128, codes, 128 + codes % 31).astype(np.int64)
    out[(codes >= 48) & (codes <= 57)] = _DIGIT
    out[codes == 0] = 2
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)


class Tagger:
    """Tags of windows (windows x characters of classes). ``banned``: pairs of tags that never follow each other."""

    def __init__(self, tags: int, banned: list[tuple[int, int]], width: int = 12, hidden: int = 16, seed: int = 1, kind: type = np.float32):
        r = np.random.default_rng(seed)
        make = lambda *shape: (r.normal(0, 1, shape) / np.sqrt(shape[0])).astype(kind)
        self.hidden, self.tags = hidden, tags
        self.p = {"embedding": make(CLASSES, width), "out": make(2 * hidden, tags), "out_bias": np.zeros(tags, kind), "start": np.zeros(tags, kind), "moves": np.zeros((tags, tags), kind)}
        for d in "fb":
            self.p |= {f"{d}_in": make(width, 4 * hidden), f"{d}_own": make(hidden, 4 * hidden), f"{d}_bias": np.repeat(np.array([0, 1, 0, 0], kind), hidden)}
        self.banned = np.zeros((tags, tags), kind)
        for a, b in banned:
            self.banned[a, b] = -1e4

    def _pass(self, x: np.ndarray, d: str, keep: list | None) -> np.ndarray:
        """Hidden states (characters x windows x hidden) in the order of x."""
        steps, rows, _ = x.shape
        n, own = self.hidden, self.p[f"{d}_own"]
        into = x @ self.p[f"{d}_in"] + self.p[f"{d}_bias"]
        h, c = np.zeros((rows, n), x.dtype), np.zeros((rows, n), x.dtype)
        out = np.empty((steps, rows, n), x.dtype)
        for t in range(steps):
            z = into[t] + h @ own
            gates = _sigmoid(z[:, : 3 * n])
            i, f, o, g = gates[:, :n], gates[:, n : 2 * n], gates[:, 2 * n :], np.tanh(z[:, 3 * n :])
            before = c
            c = f * before + i * g
            top = np.tanh(c)
            if keep is not None:
                keep.append((h, before, i, f, o, g, top))
            h = o * top
            out[t] = h
        return out

    def _pass_back(self, x: np.ndarray, d: str, kept: list, g_out: np.ndarray, grads: dict) -> np.ndarray:
        steps, rows, _ = x.shape
        n, own = self.hidden, self.p[f"{d}_own"]
        g_h, g_c = np.zeros((rows, n), x.dtype), np.zeros((rows, n), x.dtype)
        g_z = np.empty((steps, rows, 4 * n), x.dtype)
        g_own = np.zeros_like(own)
        for t in range(steps - 1, -1, -1):
            h, before, i, f, o, g, top = kept[t]
            g_h = g_h + g_out[t]
            g_c = g_c + g_h * o * (1 - top**2)
            z = g_z[t]
            z[:, :n] = g_c * g * i * (1 - i)
            z[:, n : 2 * n] = g_c * before * f * (1 - f)
            z[:, 2 * n : 3 * n] = g_h * top * o * (1 - o)
            z[:, 3 * n :] = g_c * i * (1 - g**2)
            g_own += h.T @ z
            g_h, g_c = z @ own.T, g_c * f
        flat = g_z.reshape(-1, 4 * n)
        grads[f"{d}_own"], grads[f"{d}_in"], grads[f"{d}_bias"] = g_own, x.reshape(-1, x.shape[2]).T @ flat, flat.sum(0)
        return g_z @ self.p[f"{d}_in"].T

    def emissions(self, ids: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Scores (characters x windows x tags) of windows of classes."""
        x = self.p["embedding"][ids.T]
        kept = ([], []) if keep is not None else (None, None)
        both = np.concatenate((self._pass(x, "f", kept[0]), self._pass(x[::-1], "b", kept[1])[::-1]), 2)
        if keep is not None:
            keep |= {"x": x, "kept": kept, "both": both}
        return both @ self.p["out"] + self.p["out_bias"]

    def _sums(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        moves = self.p["moves"] + self.banned
        ahead, behind = np.empty_like(e), np.zeros_like(e)
        ahead[0] = self.p["start"] + e[0]
        for t in range(1, len(e)):
            ahead[t] = _lse(ahead[t - 1][:, :, None] + moves, 1) + e[t]
        for t in range(len(e) - 2, -1, -1):
            behind[t] = _lse((behind[t + 1] + e[t + 1])[:, None] + moves, 2)
        return ahead, behind, _lse(ahead[-1], 1)

    def loss(self, ids: np.ndarray, tags: np.ndarray) -> tuple[float, dict]:
        """Mean negative log likelihood of the windows' tags, and its gradients."""
        keep: dict = {}
        e, truth = self.emissions(ids, keep), tags.T
        steps, rows, n = e.shape
        moves = self.p["moves"] + self.banned
        ahead, behind, whole = self._sums(e)
        row = np.arange(rows)
        score = self.p["start"][truth[0]] + e[np.arange(steps)[:, None], row, truth].sum(0) + moves[truth[:-1], truth[1:]].sum(0)
        g_e = np.exp(ahead + behind - whole[:, None])
        grads = {}
        pairs = np.zeros((n, n), e.dtype)
        for t in range(1, steps):
            pairs += np.exp(ahead[t - 1][:, :, None] + moves + (e[t] + behind[t])[:, None] - whole[:, None, None]).sum(0)
        np.add.at(pairs, (truth[:-1], truth[1:]), -1)
        np.add.at(g_e, (np.arange(steps)[:, None], row, truth), -1)
        grads["moves"], grads["start"] = pairs / rows, g_e[0].sum(0) / rows
        g_e = g_e / rows
        flat = g_e.reshape(-1, n)
        grads["out"], grads["out_bias"] = keep["both"].reshape(-1, keep["both"].shape[2]).T @ flat, flat.sum(0)
        g_both = g_e @ self.p["out"].T
        x, (kept_f, kept_b), h = keep["x"], keep["kept"], self.hidden
        g_x = self._pass_back(x, "f", kept_f, g_both[:, :, :h], grads)
        g_x = g_x + self._pass_back(x[::-1], "b", kept_b, g_both[::-1, :, h:], grads)[::-1]
        grads["embedding"] = np.zeros_like(self.p["embedding"])
        np.add.at(grads["embedding"], ids.T, g_x)
        return float((whole - score).mean()), grads

    def train(self, batches, rate: float = 0.01) -> list[float]:
        """Adam steps over (ids, tags) batches; the losses."""
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second, losses = {k: np.zeros_like(v) for k, v in self.p.items()}, []
        for n, (ids, tags) in enumerate(batches, 1):
            loss, grads = self.loss(ids, tags)
            losses.append(loss)
            size = np.sqrt(sum(float((g.astype(float) ** 2).sum()) for g in grads.values()))
            for k, g in grads.items():
                g = g * min(1.0, 5.0 / (size + 1e-12))
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                self.p[k] -= (rate * (first[k] / (1 - 0.9**n)) / (np.sqrt(second[k] / (1 - 0.999**n)) + 1e-8)).astype(self.p[k].dtype)
        return losses

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best tags (windows x characters) and the marginal probability of each."""
        e = self.emissions(ids)
        steps, rows, _ = e.shape
        moves = self.p["moves"] + self.banned
        ahead, behind, whole = self._sums(e)
        best, back = self.p["start"] + e[0], []
        for t in range(1, steps):
            through = best[:, :, None] + moves
            back.append(through.argmax(1))
            best = through.max(1) + e[t]
        tags = np.empty((steps, rows), np.int64)
        tags[-1] = best.argmax(1)
        for t in range(steps - 2, -1, -1):
            tags[t] = back[t][np.arange(rows), tags[t + 1]]
        sure = np.exp(np.take_along_axis(ahead + behind - whole[:, None], tags[:, :, None], 2))[:, :, 0]
        return tags.T, sure.T
