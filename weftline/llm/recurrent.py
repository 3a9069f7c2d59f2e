"""A bidirectional gated recurrent network with attention pooling over windows of words, in numpy, with its gradients.

Inputs are sequences of small word vectors with a mask; the output is one logit for each sequence.
"""

from __future__ import annotations

import numpy as np

Params = dict[str, np.ndarray]


def initial(inputs: int, hidden: int, seed: int = 0) -> Params:
    rng = np.random.default_rng(seed)
    p = {}
    for side in ("f", "b"):
        p[f"W{side}"] = rng.normal(0, inputs**-0.5, (inputs, 3 * hidden))
        p[f"U{side}"] = rng.normal(0, hidden**-0.5, (hidden, 3 * hidden))
        p[f"c{side}"] = np.zeros(3 * hidden)
    p["A"] = rng.normal(0, (2 * hidden) ** -0.5, (2 * hidden, hidden))
    p["v"] = rng.normal(0, hidden**-0.5, hidden)
    p["o"] = rng.normal(0, (2 * hidden) ** -0.5, 2 * hidden)
    p["k"] = np.zeros(1)
    return p


def _sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _scan(gates: np.ndarray, u: np.ndarray, mask: np.ndarray, back: bool, keep: list | None) -> np.ndarray:
    """Hidden states (steps, rows, hidden) from the input parts of the gates (steps, rows, 3 hidden)."""
    steps, rows, width = gates.shape
    size = width // 3
    h, out = np.zeros((rows, size), gates.dtype), np.empty((steps, rows, size), gates.dtype)
    for t in range(steps - 1, -1, -1) if back else range(steps):
        hu = h @ u
        zr = _sigmoid(gates[t, :, : 2 * size] + hu[:, : 2 * size])
        z, r = zr[:, :size], zr[:, size:]
        n = np.tanh(gates[t, :, 2 * size :] + r * hu[:, 2 * size :])
        m = mask[t][:, None]
        new = h + m * (1 - z) * (n - h)
        if keep is not None:
            keep.append((t, h, z, r, n, hu[:, 2 * size :]))
        out[t] = h = new
    return out


def forward(p: Params, gf: np.ndarray, gb: np.ndarray, mask: np.ndarray, cache: dict | None = None) -> np.ndarray:
    """Logits of sequences, given x @ W + c of both directions, time first. Sequences without a word get the bias alone."""
    kf, kb = ([], []) if cache is not None else (None, None)
    h = np.concatenate([_scan(gf, p["Uf"], mask, False, kf), _scan(gb, p["Ub"], mask, True, kb)], 2)
    a = np.tanh(h @ p["A"])
    e = a @ p["v"]
    e = np.where(mask > 0, np.exp(np.clip(e - e.max(0), -30, 0)), 0)
    alpha = e / np.maximum(e.sum(0), 1e-12)
    pooled = np.einsum("tb,tbh->bh", alpha, h)
    if cache is not None:
        cache.update(kf=kf, kb=kb, h=h, a=a, alpha=alpha, pooled=pooled)
    return pooled @ p["o"] + p["k"]


def _unscan(dh: np.ndarray, kept: list, u: np.ndarray, mask: np.ndarray, size: int):
    """Gradients of a scan: of the input parts of the gates and of the recurrent weights."""
    dg, du = np.zeros((*dh.shape[:2], 3 * size)), np.zeros_like(u)
    carry = np.zeros(dh.shape[1:])
    for t, h, z, r, n, hun in reversed(kept):
        d = carry + dh[t]
        m = mask[t][:, None]
        dn = d * m * (1 - z) * (1 - n * n)
        dz = -d * m * (n - h) * z * (1 - z)
        dr = dn * hun * r * (1 - r)
        dhu = np.concatenate([dz, dr, dn * r], 1)
        dg[t] = np.concatenate([dz, dr, dn], 1)
        du += h.T @ dhu
        carry = d * (1 - m * (1 - z)) + dhu @ u.T
    return dg, du


def gradients(p: Params, x: np.ndarray, mask: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, Params]:
    """Mean weighted log loss over sequences ``x`` (time, rows, inputs), and its gradients, of the inputs too (``x``)."""
    cache: dict = {}
    size = len(p["v"])
    logit = forward(p, x @ p["Wf"] + p["cf"], x @ p["Wb"] + p["cb"], mask, cache)
    q = 1 / (1 + np.exp(-np.clip(logit, -40, 40)))
    total = weight.sum()
    loss = -(weight * (y * np.log(q + 1e-12) + (1 - y) * np.log(1 - q + 1e-12))).sum() / total
    d = weight * (q - y) / total
    g: Params = {"o": cache["pooled"].T @ d, "k": np.array([d.sum()])}
    dp = d[:, None] * p["o"]
    h, alpha, a = cache["h"], cache["alpha"], cache["a"]
    dh = alpha[:, :, None] * dp
    da = np.einsum("tbh,bh->tb", h, dp)
    de = alpha * (da - (alpha * da).sum(0))
    g["v"] = np.einsum("tb,tbk->k", de, a)
    dpre = de[:, :, None] * p["v"] * (1 - a * a)
    g["A"] = np.einsum("tbh,tbk->hk", h, dpre)
    dh = dh + dpre @ p["A"].T
    g["x"] = np.zeros_like(x)
    for side, kept, part in (("f", cache["kf"], dh[:, :, :size]), ("b", cache["kb"], dh[:, :, size:])):
        dg, g[f"U{side}"] = _unscan(part, kept, p[f"U{side}"], mask, size)
        g[f"W{side}"] = np.einsum("tbi,tbg->ig", x, dg)
        g[f"c{side}"] = dg.sum((0, 1))
        g["x"] += dg @ p[f"W{side}"].T
    return loss, g


class Adam:
    def __init__(self, p: Params, rate: float = 0.01):
        self.rate, self.t = rate, 0
        self.m, self.s = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))

    def step(self, p: Params, g: Params) -> None:
        self.t += 1
        for k in p:
            self.m[k] += 0.1 * (g[k] - self.m[k])
            self.s[k] += 0.01 * (g[k] ** 2 - self.s[k])
            p[k] -= self.rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.s[k] / (1 - 0.99**self.t)) + 1e-8)
