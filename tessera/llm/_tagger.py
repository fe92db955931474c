"""A bidirectional LSTM over characters with a linear-chain CRF, in numpy.

Both directions run side by side as one batched product a step.  Sums over
paths are scaled products of matrices, so a step of the CRF is one product, too.
All products are small, a step's each: a numerical library that would start
threads for large ones then stays with the one core that a task has.
"""

from __future__ import annotations

import numpy as np

ASCII = 128  # each ASCII character is a symbol of its own; then other letters, digits, blanks, the rest
SYMBOLS = ASCII + 4


def symbols(text: str) -> np.ndarray:
    """A symbol for each code point."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    if len(points) and points.max() >= ASCII:
        seen, of = np.unique(points, return_inverse=True)
        kinds = np.array([p if p < ASCII else ASCII + (0 if (c := chr(p)).isalpha() else 1 if c.isdigit() else 2 if c.isspace() else 3) for p in seen.tolist()])
        return kinds[of]
    return points


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(r) for r in rows])
    out = np.zeros((len(rows), int(lengths.max())), np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out, lengths


class Tagger:
    """Tags 0 (outside), 1 + 2k (begins kind k), 2 + 2k (inside kind k)."""

    def __init__(self, kinds: int, embedding: int = 8, hidden: int = 16, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.tags = tags = 1 + 2 * kinds
        normal = lambda *shape: (rng.normal(size=shape) / np.sqrt(shape[-2])).astype(np.float32)
        bias = np.zeros((2, 1, 4 * hidden), np.float32)
        bias[:, :, hidden : 2 * hidden] = 1.0  # forget little at first
        self.w = {"emb": rng.normal(size=(SYMBOLS, embedding)).astype(np.float32) * np.float32(0.5), "x": normal(2, embedding, 4 * hidden), "h": normal(2, hidden, 4 * hidden), "b": bias, "out": normal(2 * hidden, tags), "c": np.zeros(tags, np.float32), "trans": np.zeros((tags, tags), np.float32), "start": np.zeros(tags, np.float32)}
        inside = np.arange(2, tags, 2)
        self.allowed = np.ones((tags, tags), np.float32)
        self.allowed[:, inside] = 0
        self.allowed[inside - 1, inside] = self.allowed[inside, inside] = 1
        self.begins = np.ones(tags, np.float32)
        self.begins[inside] = 0

    @staticmethod
    def _turned(lengths: np.ndarray, steps: int) -> np.ndarray:
        at = np.arange(steps)[None, :]
        return np.where(at < lengths[:, None], lengths[:, None] - 1 - at, at)

    def emissions(self, x: np.ndarray, lengths: np.ndarray, keep: bool = False):
        w = self.w
        n, steps = x.shape
        hidden = w["h"].shape[1]
        turned = self._turned(lengths, steps)
        both = np.stack([x, np.take_along_axis(x, turned, 1)])
        h = c = np.zeros((2, n, hidden), np.float32)
        out = np.empty((2, n, steps, hidden), np.float32)
        memory = []
        for t in range(steps):
            g = np.matmul(w["emb"][both[:, :, t]], w["x"]) + np.matmul(h, w["h"]) + w["b"]
            gates, new = _sigmoid(g[:, :, : 3 * hidden]), np.tanh(g[:, :, 3 * hidden :])
            i, f, o = gates[:, :, :hidden], gates[:, :, hidden : 2 * hidden], gates[:, :, 2 * hidden :]
            last_h, last_c = h, c
            c = f * c + i * new
            squashed = np.tanh(c)
            h = o * squashed
            out[:, :, t] = h
            if keep:
                memory.append((gates, new, squashed, last_h, last_c))
        state = np.concatenate([out[0], np.take_along_axis(out[1], turned[:, :, None], 1)], 2)
        scores = np.empty((n, steps, self.tags), np.float32)
        for t in range(steps):
            scores[:, t] = state[:, t] @ w["out"] + w["c"]
        return (scores, (both, turned, memory, state)) if keep else scores

    def _backward(self, slope: np.ndarray, kept) -> dict[str, np.ndarray]:
        """Slopes of all weights from those of the emission scores."""
        both, turned, memory, state = kept
        w = self.w
        n, steps, _ = slope.shape
        hidden = w["h"].shape[1]
        d = {k: np.zeros_like(w[k]) for k in ("emb", "x", "h", "b", "out")}
        d["c"] = slope.sum((0, 1))
        up = np.empty((n, steps, 2 * hidden), np.float32)
        for t in range(steps):
            d["out"] += state[:, t].T @ slope[:, t]
            up[:, t] = slope[:, t] @ w["out"].T
        up = np.stack([up[:, :, :hidden], np.take_along_axis(up[:, :, hidden:], turned[:, :, None], 1)])
        demb = np.empty((2, n, steps, w["emb"].shape[1]), np.float32)
        dh = dc = np.zeros((2, n, hidden), np.float32)
        for t in range(steps - 1, -1, -1):
            gates, new, squashed, last_h, last_c = memory[t]
            i, f, o = gates[:, :, :hidden], gates[:, :, hidden : 2 * hidden], gates[:, :, 2 * hidden :]
            dh = dh + up[:, :, t]
            dc = dc + dh * o * (1 - squashed**2)
            dgates = np.concatenate([dc * new, dc * last_c, dh * squashed], 2) * gates * (1 - gates)
            g = np.concatenate([dgates, dc * i * (1 - new**2)], 2)
            d["h"] += np.matmul(last_h.transpose(0, 2, 1), g)
            d["x"] += np.matmul(w["emb"][both[:, :, t]].transpose(0, 2, 1), g)
            d["b"] += g.sum(1, keepdims=True)
            demb[:, :, t] = np.matmul(g, w["x"].transpose(0, 2, 1))
            dh = np.matmul(g, w["h"].transpose(0, 2, 1))
            dc = dc * f
        np.add.at(d["emb"], both.reshape(-1), demb.reshape(-1, demb.shape[-1]))
        return d

    def marginals(self, scores: np.ndarray, lengths: np.ndarray, pairs: bool = False):
        """P(tag) for each place, and if asked for the expected numbers of transitions and of starts."""
        n, steps, tags = scores.shape
        move = np.exp(self.w["trans"]) * self.allowed
        here = np.exp(scores - scores.max(2, keepdims=True))
        fore = np.empty((n, steps, tags), np.float32)
        a = here[:, 0] * np.exp(self.w["start"]) * self.begins
        fore[:, 0] = a / a.sum(1, keepdims=True)
        for t in range(1, steps):
            a = (fore[:, t - 1] @ move) * here[:, t]
            fore[:, t] = a / a.sum(1, keepdims=True)
        back = np.ones((n, steps, tags), np.float32)
        for t in range(steps - 2, -1, -1):
            b = (here[:, t + 1] * back[:, t + 1]) @ move.T
            b /= b.max(1, keepdims=True)
            back[:, t] = np.where((t + 1 < lengths)[:, None], b, 1)
        p = fore * back
        p /= p.sum(2, keepdims=True)
        if not pairs:
            return p
        on = (np.arange(1, steps)[None, :] < lengths[:, None]).reshape(-1)
        x, y = fore[:, :-1].reshape(-1, tags)[on], (here * back)[:, 1:].reshape(-1, tags)[on]
        scale = np.einsum("ni,ij,nj->n", x, move, y, optimize=True)
        return p, (x / scale[:, None]).T @ y * move, p[:, 0].sum(0)

    def slopes(self, x: np.ndarray, lengths: np.ndarray, tags: np.ndarray) -> dict[str, np.ndarray]:
        """Of the negative log likelihood, a sequence's mean."""
        scores, kept = self.emissions(x, lengths, keep=True)
        p, moved, started = self.marginals(scores, lengths, pairs=True)
        n, steps, _ = scores.shape
        on = np.arange(steps)[None, :] < lengths[:, None]
        slope = p.copy()
        np.put_along_axis(slope, tags[:, :, None], np.take_along_axis(slope, tags[:, :, None], 2) - 1, 2)
        slope = (slope * on[:, :, None] / n).astype(np.float32)
        d = self._backward(slope, kept)
        seen = np.zeros_like(moved)
        pair = on[:, 1:]
        np.add.at(seen, (tags[:, :-1][pair], tags[:, 1:][pair]), 1)
        d["trans"] = ((moved - seen) / n).astype(np.float32) * self.allowed
        d["start"] = ((started - np.bincount(tags[:, 0], minlength=self.tags)) / n).astype(np.float32) * self.begins
        return d

    def log_likelihood(self, x: np.ndarray, lengths: np.ndarray, tags: np.ndarray) -> np.ndarray:
        """Of each sequence's tags; for tests."""
        scores = self.emissions(x, lengths).astype(np.float64)
        with np.errstate(divide="ignore"):
            move, start = self.w["trans"] + np.log(self.allowed), self.w["start"] + np.log(self.begins)
        out = []
        for s, n, y in zip(scores, lengths, tags, strict=True):
            a, own = start + s[0], start[y[0]] + s[0, y[0]]
            for t in range(1, n):
                a = np.logaddexp.reduce(a[:, None] + move, 0) + s[t]
                own += move[y[t - 1], y[t]] + s[t, y[t]]
            out.append(own - np.logaddexp.reduce(a))
        return np.array(out)

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], epochs: int = 8, batch: int = 48, rate: float = 0.03, seed: int = 3) -> Tagger:
        """Adam over batches of sequences of about one length, the rate falling to nothing."""
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.w.items()}
        second = {k: np.zeros_like(v) for k, v in self.w.items()}
        order = sorted(range(len(rows)), key=lambda i: len(rows[i][0]))
        groups = [order[i : i + batch] for i in range(0, len(order), batch)]
        total, step = epochs * len(groups), 0
        for _ in range(epochs):
            for g in rng.permutation(len(groups)):
                x, lengths = padded([rows[i][0] for i in groups[g]])
                tags, _ = padded([rows[i][1] for i in groups[g]])
                d = self.slopes(x, lengths, tags)
                size = np.sqrt(sum(float((v**2).sum()) for v in d.values()))
                step += 1
                now = rate * (1 - step / (total + 1)) * np.sqrt(1 - 0.99**step) / (1 - 0.9**step)
                for k, v in d.items():
                    v = v * min(1.0, 5.0 / (size + 1e-9))
                    first[k] = 0.9 * first[k] + 0.1 * v
                    second[k] = 0.99 * second[k] + 0.01 * v * v
                    self.w[k] = (self.w[k] - now * first[k] / (np.sqrt(second[k]) + 1e-6)).astype(np.float32)
        return self

    def decode(self, rows: list[np.ndarray]) -> list[list[tuple[int, int, int, float]]]:
        """(kind, start, end, confidence) of the spans on each row's best path; confidence is the least P(tag) inside."""
        x, lengths = padded(rows)
        scores = self.emissions(x, lengths)
        p = self.marginals(scores, lengths)
        n, steps, tags = scores.shape
        with np.errstate(divide="ignore"):
            move, best = self.w["trans"] + np.log(self.allowed), self.w["start"] + np.log(self.begins) + scores[:, 0]
        came = np.zeros((n, steps, tags), np.int8)
        ended = best
        for t in range(1, steps):
            reach = best[:, :, None] + move[None]
            came[:, t] = reach.argmax(1)
            best = reach.max(1) + scores[:, t]
            ended = np.where((t == lengths - 1)[:, None], best, ended)
        path = np.zeros((n, steps), np.int64)
        last = ended.argmax(1)
        every = np.arange(n)
        for t in range(steps - 1, -1, -1):
            path[:, t] = np.where(t < lengths, last, 0)
            last = np.where(t < lengths, came[every, t, last], last)
        out = []
        for r in range(n):
            found, tag = [], path[r]
            for a in np.flatnonzero(tag % 2 == 1).tolist():
                b = a + 1
                while b < lengths[r] and tag[b] == tag[a] + 1:
                    b += 1
                found.append((int(tag[a]) // 2, a, b, float(p[r, np.arange(a, b), tag[a:b]].min())))
            out.append(found)
        return out
