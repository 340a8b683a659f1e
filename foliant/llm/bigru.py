"""A bidirectional gated recurrent network with attention pooling, trained and run in numpy.

A word's input is its embedding (by hash) plus the mean embedding of its characters in context (hashed trigrams of bytes),
so that stems with unseen endings still say something. Two GRUs read a window of words in both directions, attention pools
their states, and a logistic unit scores the window. A document is a bag of windows and as toxic as its worst one."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa

from foliant.llm.bytewords import ALNUM, LOWER, U, Words, mix, words

#: Words of a window, and between the starts of windows: in scoring half a window, so that whatever half a window holds lies whole in one; in learning more.
WINDOW, STRIDE, LEARNED_STRIDE = 48, 24, 36
WORD_BUCKETS, CHAR_BUCKETS, DIM, HIDDEN, ATTEND = 1 << 14, 1 << 13, 12, 10, 8
BLOCK = 2048


@dataclass
class Inputs:
    """Distinct words of some texts: their buckets, and buckets of their characters; and each text's words as numbers of these."""

    bucket: np.ndarray
    char: np.ndarray
    char_at: np.ndarray
    word: np.ndarray
    first: np.ndarray

    def windows(self, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, first word and size of all windows: each `stride` words after the one before, the last ending with the text."""
        n = np.diff(self.first)
        count = np.where(n == 0, 0, np.maximum(-(-(n - WINDOW) // stride), 0) + 1)
        text = np.repeat(np.arange(len(n)), count)
        k = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
        begin = np.minimum(k * stride, np.maximum(n[text] - WINDOW, 0))
        return text, self.first[text] + begin, np.minimum(n[text], WINDOW)

    def grid(self, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words of the windows, a row each, and which places have one."""
        at = begin[:, None] + np.arange(WINDOW)
        mask = np.arange(WINDOW) < size[:, None]
        return self.word[np.minimum(at, len(self.word) - 1)] * mask, mask


def inputs(texts: pa.Array) -> Inputs:
    w = words(texts, ALNUM, lower=True)
    distinct, first, inverse = np.unique(w.hashes(), return_index=True, return_inverse=True)
    char, at = characters(w, first)
    return Inputs((distinct % U(WORD_BUCKETS)).astype(np.int64), char, at, inverse, w.first)


def characters(w: Words, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the byte trigrams of some words, with their edges, in a row; and where each word's begin."""
    size = w.end[which] - w.start[which]
    at = np.cumsum(size) - size
    inner = np.arange(int(size.sum())) - np.repeat(at, size)
    place = inner + np.repeat(w.start[which], size)
    byte = LOWER[w.buf[place]].astype(np.uint32)
    before, after = np.zeros_like(byte), np.zeros_like(byte)
    before[1:], after[:-1] = byte[:-1], byte[1:]
    before[at], after[at + size - 1] = 1, 2
    return (mix((before << 16 | byte << 8 | after).astype(U)) % U(CHAR_BUCKETS)).astype(np.int64), at


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Network:
    p: dict[str, np.ndarray]
    scale: float = 1.0
    shift: float = 0.0
    empty: float = 0.0
    cache: dict = field(default_factory=dict, repr=False)

    @staticmethod
    def new(seed: int) -> Network:
        rng = np.random.default_rng(seed)
        normal = lambda *s, by=1.0: (rng.standard_normal(s) * by).astype(np.float32)
        p = {"words": normal(WORD_BUCKETS, DIM, by=0.05), "chars": normal(CHAR_BUCKETS, DIM, by=0.05), "look": normal(2 * HIDDEN, ATTEND, by=0.3), "ask": normal(ATTEND, by=0.3), "out": normal(2 * HIDDEN, by=0.3), "bias": np.zeros(1, np.float32)}
        for d in "fb":
            p |= {f"in_{d}": normal(DIM, 3 * HIDDEN, by=DIM**-0.5), f"b_{d}": np.zeros(3 * HIDDEN, np.float32), f"u_{d}": normal(HIDDEN, 3 * HIDDEN, by=HIDDEN**-0.5)}
        return Network(p)

    def word_vectors(self, x: Inputs, which: np.ndarray | None = None) -> np.ndarray:
        chars, at = x.char, x.char_at
        size = np.diff(np.r_[at, len(chars)])
        if which is None:
            mean = np.add.reduceat(self.p["chars"][chars], at) / size[:, None] if len(at) else np.zeros((0, DIM), np.float32)
            return self.p["words"][x.bucket] + mean
        n = size[which]
        place = np.arange(int(n.sum())) + np.repeat(at[which] - (np.cumsum(n) - n), n)
        self.cache |= {"chars": chars[place], "n": n}
        return self.p["words"][x.bucket[which]] + np.add.reduceat(self.p["chars"][chars[place]], np.cumsum(n) - n) / n[:, None]

    def states(self, d: str, gates: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
        """gates: [time, window, 3 H], what the inputs add to the gates. Returns [time, window, H]."""
        u, h = self.p[f"u_{d}"], np.zeros((gates.shape[1], HIDDEN), np.float32)
        out = np.empty((*gates.shape[:2], HIDDEN), np.float32)
        for t in range(len(gates)) if d == "f" else range(len(gates) - 1, -1, -1):
            a = h @ u
            zr = sigmoid(gates[t, :, : 2 * HIDDEN] + a[:, : 2 * HIDDEN])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            n = np.tanh(gates[t, :, 2 * HIDDEN :] + r * a[:, 2 * HIDDEN :])
            new = n + z * (h - n)
            if keep is not None:
                keep.append((t, h, a, z, r, n))
            h = np.where(mask[t], new, h)
            out[t] = h
        return out

    def logits(self, vectors: np.ndarray, grid: np.ndarray, mask: np.ndarray, train: bool = False) -> np.ndarray:
        """Scores of windows of words, given the words' vectors."""
        steps = mask.T[:, :, None]
        turned = np.ascontiguousarray(grid.T)
        keep: dict[str, list | None] = {d: [] if train else None for d in "fb"}
        h = np.concatenate([self.states(d, (vectors @ self.p[f"in_{d}"] + self.p[f"b_{d}"])[turned], steps, keep[d]) for d in "fb"], axis=2)
        u = np.tanh(h @ self.p["look"])
        s = np.where(mask.T, u @ self.p["ask"], -np.inf)
        e = np.exp(s - s.max(axis=0))
        weight = e / e.sum(axis=0)
        pooled = (h * weight[:, :, None]).sum(axis=0)
        if train:
            self.cache |= {"keep": keep, "h": h, "u": u, "weight": weight, "pooled": pooled, "steps": steps, "turned": turned, "vectors": vectors}
        return pooled @ self.p["out"] + self.p["bias"]

    def gradients(self, d_logit: np.ndarray, buckets: np.ndarray) -> dict[str, np.ndarray]:
        """Of the loss, after logits(train=True); d_logit is its derivative by each window's logit."""
        c, p = self.cache, self.p
        g = {"out": c["pooled"].T @ d_logit, "bias": d_logit.sum(keepdims=True)}
        d_pooled = d_logit[:, None] * p["out"]
        d_weight = (c["h"] * d_pooled).sum(axis=2)
        d_h = c["weight"][:, :, None] * d_pooled
        d_s = c["weight"] * (d_weight - (c["weight"] * d_weight).sum(axis=0))
        d_u = d_s[:, :, None] * p["ask"] * (1 - c["u"] ** 2)
        g["ask"] = np.einsum("tw,twa->a", d_s, c["u"])
        g["look"] = np.einsum("twh,twa->ha", c["h"], d_u, optimize=True)
        d_h = d_h + d_u @ p["look"].T
        d_vectors = np.zeros_like(c["vectors"])
        for k, d in enumerate("fb"):
            own = d_h[:, :, k * HIDDEN : (k + 1) * HIDDEN]
            back = np.zeros_like(own[0])
            g_u = np.zeros_like(p[f"u_{d}"])
            d_gates = np.zeros((*own.shape[:2], 3 * HIDDEN), np.float32)
            for t, h, a, z, r, n in reversed(c["keep"][d]):
                back = back + own[t]
                new = back * c["steps"][t]
                d_n = new * (1 - z) * (1 - n**2)
                d_r = d_n * a[:, 2 * HIDDEN :] * r * (1 - r)
                d_z = new * (h - n) * z * (1 - z)
                d_gates[t] = np.concatenate([d_z, d_r, d_n], axis=1)
                d_a = np.concatenate([d_z, d_r, d_n * r], axis=1)
                g_u += h.T @ d_a
                back = back * ~c["steps"][t] + new * z + d_a @ p[f"u_{d}"].T
            g[f"u_{d}"], g[f"b_{d}"] = g_u, d_gates.sum(axis=(0, 1))
            flat, by_word = c["turned"].ravel(), d_gates.reshape(-1, 3 * HIDDEN)
            d_in = np.stack([np.bincount(flat, by_word[:, j], len(d_vectors)) for j in range(3 * HIDDEN)], axis=1).astype(np.float32)
            g[f"in_{d}"] = c["vectors"].T @ d_in
            d_vectors += d_in @ p[f"in_{d}"].T
        spread = np.repeat(d_vectors / c["n"][:, None], c["n"], axis=0)
        g["words"] = np.stack([np.bincount(buckets, d_vectors[:, j], WORD_BUCKETS) for j in range(DIM)], axis=1).astype(np.float32)
        g["chars"] = np.stack([np.bincount(c["chars"], spread[:, j], CHAR_BUCKETS) for j in range(DIM)], axis=1).astype(np.float32)
        return g

    def window_logits(self, x: Inputs, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray]:
        """Text and logit of all windows."""
        text, begin, size = x.windows(stride)
        vectors = self.word_vectors(x)
        out = np.empty(len(text), np.float32)
        for a in range(0, len(text), BLOCK):
            grid, mask = x.grid(begin[a : a + BLOCK], size[a : a + BLOCK])
            out[a : a + BLOCK] = self.logits(vectors, grid, mask)
        return text, out

    def scores(self, texts: pa.Array) -> np.ndarray:
        """Of whole texts: the calibrated probability of their worst window; texts without words get the share of toxic texts, at most 0.49."""
        text, logit = self.window_logits(inputs(texts))
        worst = np.full(len(texts), -np.inf)
        np.maximum.at(worst, text, logit)
        return np.where(np.isinf(worst), self.empty, sigmoid(self.scale * np.where(np.isinf(worst), 0, worst) + self.shift))

    def bare(self) -> Network:
        """Without what training kept."""
        return Network(self.p, self.scale, self.shift, self.empty)


#: A bucket seen in fewer texts says nothing by itself: it would only let the network learn its sample by heart.
LEAST_TEXTS = 5


#: Texts that known_odds counts at a time, so that what it holds doesn't grow with the sample.
AT_ONCE = 256


def known_odds(x: Inputs, n_char: np.ndarray, label: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """For the buckets of words and of characters: how much oftener toxic texts have a bucket than others, by texts, as a smoothed logarithm;
    and which buckets are common enough to tell."""
    seen = [np.zeros((2, n)) for n in (WORD_BUCKETS, CHAR_BUCKETS)]
    for a in range(0, len(label), AT_ONCE):
        own = label[a : a + AT_ONCE]
        owner = np.repeat(np.arange(len(own)), np.diff(x.first[a : a + len(own) + 1]))
        pair = np.unique(owner * len(n_char) + x.word[x.first[a] : x.first[a + len(own)]])  # each text's distinct words
        at_text, at_word = pair // len(n_char), pair % len(n_char)
        reps = n_char[at_word]
        place = np.arange(int(reps.sum())) + np.repeat(x.char_at[at_word] - (np.cumsum(reps) - reps), reps)
        for total, n, of, bucket in ((seen[0], WORD_BUCKETS, at_text, x.bucket[at_word]), (seen[1], CHAR_BUCKETS, np.repeat(at_text, reps), x.char[place])):
            once = np.unique(of * n + bucket)
            for k in (0, 1):
                total[k] += np.bincount(once % n, own[once // n] == k, n)
    return tuple(log_odds(up, down, label) for down, up in seen)


def log_odds(up: np.ndarray, down: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    common = up + down >= LEAST_TEXTS
    return np.log((up + 0.5) / (label.sum() + 1) / ((down + 0.5) / ((1 - label).sum() + 1))) * common, common


def fit(texts: pa.Array | pa.ChunkedArray, label: np.ndarray, prior: float, rounds: int = 7, batch: int = 192, rate: float = 0.01, seed: int = 7) -> Network:
    """Learns from whole texts of which only the label of the text is known: each round scores all windows, and trains on the
    worst window of every text and a random one of every text that isn't toxic. prior: share of toxic texts among all."""
    net, rng = Network.new(seed), np.random.default_rng(seed)
    net.empty = min(max(prior, 0.0), 0.49)
    label = np.asarray(label, np.float64)
    x = inputs(texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts)
    text, begin, size = x.windows(LEARNED_STRIDE)
    if not len(text) or label.min() == label.max():
        net.p["out"][:] = 0
        net.shift = float(np.log((net.empty + 1e-3) / (1 - net.empty)))
        return net
    n_char = np.diff(np.r_[x.char_at, len(x.char)])
    (odds, common), (char_odds, char_common) = known_odds(x, n_char, label)
    known = {"words": common[:, None], "chars": char_common[:, None]}
    for name, which in known.items():
        net.p[name] *= which
    net.p["words"][:, 0], net.p["chars"][:, 1] = odds / 2, char_odds / 2
    value = odds[x.bucket] + np.add.reduceat(char_odds[x.char], x.char_at) / n_char
    per_word = value[x.word]
    logit = np.array([per_word[a : a + n].max() for a, n in zip(begin, size, strict=True)])
    weight = np.where(label == 1, prior / label.mean(), (1 - prior) / (1 - label.mean())) ** 0.5
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    step = 0
    at = np.searchsorted(text, np.arange(len(label)))
    count = np.bincount(text, minlength=len(label))
    for r in range(rounds):
        if r:
            _, logit = net.window_logits(x, LEARNED_STRIDE)
        order = np.lexsort((-logit, text))
        has = np.flatnonzero(count)
        worst = order[at[has]]
        calm = has[label[has] == 0]
        chosen = np.r_[worst, at[calm] + (rng.random(len(calm)) * count[calm]).astype(np.int64)]
        for _ in range(2):
            rng.shuffle(chosen)
            for a in range(0, len(chosen), batch):
                w = chosen[a : a + batch]
                grid, mask = x.grid(begin[w], size[w])
                distinct, inverse = np.unique(grid, return_inverse=True)
                out = net.logits(net.word_vectors(x, distinct), inverse.reshape(grid.shape), mask, train=True)
                y = label[text[w]]
                g = net.gradients(((sigmoid(out) - y) * weight[text[w]] / len(w)).astype(np.float32), x.bucket[distinct])
                step += 1
                lr = rate * (0.3 if r >= rounds - 2 else 1) * (1 - 0.999**step) ** 0.5 / (1 - 0.9**step)
                for k, v in net.p.items():
                    m, s = moments[k]
                    if k in known:
                        g[k] *= known[k]
                    m += 0.1 * (g[k] - m)
                    s += 0.001 * (g[k] ** 2 - s)
                    v -= (lr * m / (np.sqrt(s) + 1e-8)).astype(np.float32)
    _, logit = net.window_logits(x, LEARNED_STRIDE)
    worst = np.full(len(label), -np.inf)
    np.maximum.at(worst, text, logit)
    calibrate(net, worst[count > 0], label[count > 0], prior)
    return net.bare()


def calibrate(net: Network, logit: np.ndarray, label: np.ndarray, prior: float) -> None:
    """Platt's logistic fit of texts' worst logits, with the classes weighted as among all texts; Newton's method with a small ridge."""
    w = np.where(label == 1, prior / max(label.mean(), 1e-9), (1 - prior) / max(1 - label.mean(), 1e-9))
    up, down = label.sum(), len(label) - label.sum()
    y = np.where(label == 1, (up + 1) / (up + 2), 1 / (down + 2))
    z = np.clip(logit, -20, 20)
    design, theta = np.c_[z, np.ones(len(z))], np.array([1.0, 0.0])
    for _ in range(25):
        q = sigmoid(design @ theta)
        step = np.linalg.solve((design * (w * q * (1 - q))[:, None]).T @ design + np.diag([1e-2, 1e-3]), design.T @ (w * (y - q)) - np.array([1e-2, 1e-3]) * (theta - np.array([1.0, 0.0])))
        theta = theta + np.clip(step, -1, 1)
    net.scale, net.shift = float(max(theta[0], 1e-3)), float(theta[1])
