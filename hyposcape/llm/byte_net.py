"""A small byte-level convolutional network in numpy: forward over whole texts, training by backpropagation.

A text's UTF-8 bytes are cut into chunks of ``CHUNK`` bytes that overlap by a filter's width, so each run of ``WIDTH`` bytes
lies whole in some chunk. Learned byte vectors, ``FILTERS`` learned filters at every place, the maximum over a
chunk's places, then over a document's chunks the mean and the maximum, and one logistic unit.
"""

from __future__ import annotations

import numpy as np

CHUNK, WIDTH, STRIDE, EMBED, FILTERS = 256, 8, 1, 4, 24
HOP = CHUNK - WIDTH
PLACES = (CHUNK - WIDTH) // STRIDE + 1
ROWS = 256  # chunks convolved at once


def chunks(text: str | None) -> np.ndarray:
    """(n, CHUNK) bytes, zero-padded. Empty: one zero chunk."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    n = max(1, -(-(len(raw) - WIDTH) // HOP))
    flat = np.zeros(n * HOP + WIDTH, np.uint8)
    flat[: len(raw)] = raw
    return np.lib.stride_tricks.as_strided(flat, (n, CHUNK), (HOP, 1))


def init(seed: int = 7) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    f32 = lambda *shape, scale: (rng.normal(size=shape) * scale).astype(np.float32)
    return {
        "emb": f32(256, EMBED, scale=0.5), "w": f32(WIDTH * EMBED, FILTERS, scale=0.25), "b": np.zeros(FILTERS, np.float32),
        "v": f32(2 * FILTERS, scale=0.1), "c": np.zeros(1, np.float32), "mu": np.zeros(2 * FILTERS, np.float32), "sd": np.ones(2 * FILTERS, np.float32),
    }


def pooled(net: dict[str, np.ndarray], rows: np.ndarray, where: bool = False):
    """Chunk bytes -> (n, FILTERS) maxima after the rectifier, and the places of the maxima if asked."""
    out = np.empty((len(rows), FILTERS), np.float32)
    at = np.empty((len(rows), FILTERS), np.int32) if where else None
    for s in range(0, len(rows), ROWS):
        x = net["emb"][rows[s : s + ROWS]]  # (m, CHUNK, EMBED)
        m = len(x)
        view = np.lib.stride_tricks.as_strided(x, (m, PLACES, WIDTH * EMBED), (x.strides[0], STRIDE * x.strides[1], x.strides[2]))
        z = (view.reshape(m * PLACES, WIDTH * EMBED) @ net["w"]).reshape(m, PLACES, FILTERS)
        if where:
            at[s : s + m] = z.argmax(1)
        out[s : s + m] = z.max(1)
    out += net["b"]
    np.maximum(out, 0, out=out)
    return (out, at) if where else out


def document_features(h: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    mean = np.add.reduceat(h, starts, axis=0) / counts[:, None]
    return np.concatenate([mean, np.maximum.reduceat(h, starts, axis=0)], axis=1)


def logits(net: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    return ((x - net["mu"]) / net["sd"]) @ net["v"] + net["c"][0]


def scores(net: dict[str, np.ndarray], texts: list[str | None], limit: int = 4 << 20) -> np.ndarray:
    """Probabilities of whole texts; texts are taken in groups of about ``limit`` bytes, a longer one alone."""
    out = np.empty(len(texts))
    held, first, total = [], 0, 0

    def done(upto):
        if held:
            counts = np.array([len(c) for c in held])
            h = pooled(net, held[0] if len(held) == 1 else np.concatenate(held))
            out[first:upto] = logits(net, document_features(h, np.r_[0, np.cumsum(counts)[:-1]], counts))

    for i, text in enumerate(texts):
        c = chunks(text)
        if held and total + c.size > limit:
            done(i)
            held, first, total = [], i, 0
        held.append(c)
        total += c.size
    done(len(texts))
    return 1 / (1 + np.exp(-np.clip(out, -40, 40)))


def train(docs: list[np.ndarray], labels: np.ndarray, share: float = 0.5, epochs: int = 12, batch: int = 32, rate: float = 4e-3, seed: int = 7) -> dict[str, np.ndarray]:
    """Fit on documents given as chunk arrays; label 1 gets ``share`` of the weight. Without two classes the score is a constant."""
    net = init(seed)
    y = np.asarray(labels, np.float32)
    if len(y) == 0 or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        net["v"][:] = 0
        net["c"][0] = np.log(share / (1 - share))
        return net
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean())).astype(np.float32)
    rng = np.random.default_rng(seed)
    names = ("emb", "w", "b", "v", "c")
    m1 = {k: np.zeros_like(net[k]) for k in names}
    m2 = {k: np.zeros_like(net[k]) for k in names}
    step, steps = 0, epochs * -(-len(docs) // batch)
    places = np.arange(WIDTH)
    for _ in range(epochs):
        order = rng.permutation(len(docs))
        for s in range(0, len(docs), batch):
            pick = order[s : s + batch]
            counts = np.array([len(docs[i]) for i in pick])
            rows = np.concatenate([docs[i] for i in pick])
            starts = np.r_[0, np.cumsum(counts)[:-1]]
            owner = np.repeat(np.arange(len(pick)), counts)
            h, at = pooled(net, rows, where=True)
            x = document_features(h, starts, counts)
            p = 1 / (1 + np.exp(-np.clip(logits(net, x), -40, 40)))
            d = (weight[pick] * (p - y[pick]) / len(pick)).astype(np.float32)
            g = {"v": (x.T @ d) + 1e-4 * net["v"], "c": np.array([d.sum()], np.float32)}
            top = h == x[owner, FILTERS:]
            dh = d[owner, None] * (net["v"][:FILTERS] / counts[owner, None] + net["v"][FILTERS:] * top / np.maximum(1, np.add.reduceat(top, starts, axis=0, dtype=np.int64))[owner])
            dh = np.where(h > 0, dh, 0).astype(np.float32)
            g["b"] = dh.sum(0)
            spans = rows[np.arange(len(rows))[:, None, None], at[:, :, None] * STRIDE + places]  # (n, FILTERS, WIDTH) bytes at the maxima
            seen = net["emb"][spans]  # (n, FILTERS, WIDTH, EMBED)
            g["w"] = np.einsum("nf,nfk->kf", dh, seen.reshape(len(rows), FILTERS, -1))
            back = dh[:, :, None, None] * net["w"].T.reshape(FILTERS, WIDTH, EMBED)
            flat = spans.ravel()
            g["emb"] = np.stack([np.bincount(flat, back[..., e].ravel(), 256) for e in range(EMBED)], 1).astype(np.float32)
            step += 1
            lr = rate * min(1.0, 2 * (1 - step / (steps + 1)))
            for k in names:
                m1[k] = 0.9 * m1[k] + 0.1 * g[k]
                m2[k] = 0.99 * m2[k] + 0.01 * g[k] ** 2
                net[k] = net[k] - lr * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-8)
    return {k: v.astype(np.float32) for k, v in net.items()}
