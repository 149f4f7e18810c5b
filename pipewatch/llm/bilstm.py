"""A character BiLSTM with CRF transitions, trained and run with numpy.

All windows of a batch have one length; the work is matrix products over the
batch, one per character position. Gates are logistic in straight pieces and cells are
squashed by softsign, in training as in use: neither needs an exponential.
"""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

Params = dict[str, np.ndarray]

#: Sequences whose states are brought together at once, few enough to stay in the processor's cache.
TOGETHER = 32


def initial(symbols: int, tags: int, embed: int = 12, hidden: int = 8, seed: int = 11) -> Params:
    rng = np.random.default_rng(seed)
    draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
    p = {"E": rng.normal(0, 0.3, (symbols, embed)), "Wo": draw(2 * hidden, tags), "bo": np.zeros(tags)}
    p |= {"A": np.zeros((tags, tags)), "a0": np.zeros(tags)}
    for side in "fb":
        bias = np.zeros(4 * hidden)
        bias[hidden : 2 * hidden] = 1.0
        p |= {f"Wx{side}": draw(embed, 4 * hidden), f"Wh{side}": draw(hidden, 4 * hidden), f"b{side}": bias}
    return p


def _gate(x: np.ndarray) -> np.ndarray:
    """A logistic gate in straight pieces."""
    return np.clip(0.25 * x + 0.5, 0, 1)


def _squash(x: np.ndarray) -> np.ndarray:
    """Softsign, in place of the hyperbolic tangent."""
    return x / (1 + np.abs(x))


def _run(p: Params, ids: np.ndarray, side: str, keep: bool) -> tuple[np.ndarray, list]:
    """Hidden states [batch, length, hidden] of one direction, in text order."""
    batch, length = ids.shape
    hidden = p[f"Wh{side}"].shape[0]
    table = p["E"] @ p[f"Wx{side}"] + p[f"b{side}"]
    out = np.empty((batch, length, hidden), dtype=table.dtype)
    h, c = np.zeros((batch, hidden), table.dtype), np.zeros((batch, hidden), table.dtype)
    trace = []
    for t in range(length) if side == "f" else range(length - 1, -1, -1):
        z = table[ids[:, t]] + h @ p[f"Wh{side}"]
        gate = _gate(z[:, : 3 * hidden])
        i, f, o = gate[:, :hidden], gate[:, hidden : 2 * hidden], gate[:, 2 * hidden :]
        g = _squash(z[:, 3 * hidden :])
        new = f * c + i * g
        th = _squash(new)
        if keep:
            trace.append((t, h, c, i, f, o, g, th, 0.25 * ((gate > 0) & (gate < 1))))
        c, h = new, o * th
        out[:, t] = h
    return out, trace


def _states(p: Params, columns: np.ndarray, active: np.ndarray, side: str) -> np.ndarray:
    """Hidden states [length, batch, hidden] of one direction, in text order, as ``_run`` computes them.

    ``columns`` has the symbols by place, ``active`` how many of the rows, the longest
    first, have each place. The gates lie one behind the other, so a step is a few passes
    over small arrays. States beyond a row's end are left as they are.
    """
    length, batch = columns.shape
    hidden = p[f"Wh{side}"].shape[0]
    kind = np.result_type(p["E"], p[f"Wx{side}"])
    scale = np.array([0.25, 0.25, 0.25, 1], kind)[:, None, None]
    by_gate = lambda x: np.ascontiguousarray(x.reshape(len(x), 4, hidden).transpose(1, 0, 2) * scale)
    table, step = by_gate(p["E"] @ p[f"Wx{side}"] + p[f"b{side}"]), by_gate(p[f"Wh{side}"])
    table[:3] += np.array(0.5, kind)
    out = np.empty((length, batch, hidden), kind)
    cells, work = np.zeros((batch, hidden), kind), np.empty((2, 4 * batch * hidden), kind)
    none, one, zero = np.zeros((batch, hidden), kind), kind.type(1), kind.type(0)
    k, h = -1, none[:0]
    for t in range(length) if side == "f" else range(length - 1, -1, -1):
        if active[t] != k:
            before, k = max(k, 0), int(active[t])
            z, more = (x[: 4 * k * hidden].reshape(4, k, hidden) for x in work)
            i, f, o, g = z
            gates, size, c = z[:3], more[0], cells[:k]
            # Rows that begin here, at their last place if read backwards, have no state yet.
            h = h[:k] if k <= len(h) else np.concatenate([h, none[before:k]])
        table.take(columns[t, :k], axis=1, out=z, mode="clip")
        z += np.matmul(h, step, out=more)
        np.clip(gates, zero, one, out=gates)
        np.abs(g, out=size)
        size += one
        g /= size
        c *= f
        i *= g
        c += i
        np.abs(c, out=size)
        size += one
        o *= c
        h = np.divide(o, size, out=out[t, :k])
    return out


def emissions_of(p: Params, texts: list[np.ndarray]) -> list[np.ndarray]:
    """Emissions [length, tags] of each sequence of symbols; those of a tag lie together."""
    lengths = np.array([len(x) for x in texts], dtype=np.int64)
    order = np.argsort(-lengths, kind="stable")
    hidden = p["Whf"].shape[0]
    active = len(texts) - np.searchsorted(np.sort(lengths), np.arange(lengths.max(initial=0)), side="right")
    rows = np.zeros((len(texts), len(active)), dtype=np.intp)
    for row, i in enumerate(order):
        rows[row, : lengths[i]] = texts[i]
    columns = np.ascontiguousarray(rows.T)
    ahead, back = (_states(p, columns, active, side) for side in "fb")
    out: list[np.ndarray] = [np.empty(0)] * len(texts)
    left, right, bias = p["Wo"][:hidden].T, p["Wo"][hidden:].T, p["bo"][:, None]
    for first in range(0, len(texts), TOGETHER):
        group = order[first : first + TOGETHER]
        near, far = (np.ascontiguousarray(x[: lengths[group[0]], first : first + TOGETHER]) for x in (ahead, back))
        for row, i in enumerate(group):
            e = left @ near[: lengths[i], row].T
            e += bias
            e += right @ far[: lengths[i], row].T
            out[i] = e.T
    return out


def emissions(p: Params, ids: np.ndarray) -> np.ndarray:
    return np.stack(emissions_of(p, list(ids)))


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def forward_backward(p: Params, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log alphas, log betas [batch, length, tags] and log Z."""
    batch, length, tags = e.shape
    alpha, beta = np.empty_like(e), np.zeros_like(e)
    alpha[:, 0] = p["a0"] + e[:, 0]
    for t in range(1, length):
        alpha[:, t] = _lse(alpha[:, t - 1][:, :, None] + p["A"], 1) + e[:, t]
    for t in range(length - 2, -1, -1):
        beta[:, t] = _lse(p["A"] + (e[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
    return alpha, beta, _lse(alpha[:, -1], 1)


def viterbi(p: Params, e: np.ndarray) -> np.ndarray:
    batch, length, _ = e.shape
    best, back = p["a0"] + e[:, 0], []
    for t in range(1, length):
        all_ways = best[:, :, None] + p["A"]
        back.append(all_ways.argmax(1))
        best = all_ways.max(1) + e[:, t]
    out = np.empty((batch, length), dtype=np.int64)
    out[:, -1] = best.argmax(1)
    for t in range(length - 2, -1, -1):
        out[:, t] = back[t][np.arange(batch), out[:, t + 1]]
    return out


def decode(p: Params, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best tags and the marginal probability of each of them."""
    return decode_emissions(p, emissions(p, ids))


def decode_emissions(p: Params, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best tags, and the marginal probability of each in sequences that are not all O; 1 in those that are."""
    tags = viterbi(p, e)
    sure = np.ones(tags.shape)
    some = np.flatnonzero(tags.any(axis=1))
    if len(some):
        alpha, beta, z = forward_backward(p, e[some])
        chosen = np.take_along_axis(alpha + beta, tags[some][:, :, None], 2)[:, :, 0]
        sure[some] = np.exp(chosen - z[:, None])
    return tags, sure


def loss_and_gradient(p: Params, ids: np.ndarray, gold: np.ndarray) -> tuple[float, Params]:
    """Mean negative log likelihood per window."""
    batch, length = ids.shape
    hidden = p["Whf"].shape[0]
    (hf, tf), (hb, tb) = _run(p, ids, "f", True), _run(p, ids, "b", True)
    both = np.concatenate([hf, hb], axis=2)
    e = both @ p["Wo"] + p["bo"]
    alpha, beta, z = forward_backward(p, e)
    rows = np.arange(batch)
    score = p["a0"][gold[:, 0]] + e[rows, 0, gold[:, 0]]
    de = np.exp(alpha + beta - z[:, None, None])
    grad = {k: np.zeros_like(v) for k, v in p.items()}
    grad["a0"] = de[:, 0].sum(0)
    np.subtract.at(grad["a0"], gold[:, 0], 1.0)
    before, after = gold[:, :-1], gold[:, 1:]
    score = score + p["A"][before, after].sum(1) + np.take_along_axis(e[:, 1:], after[:, :, None], 2).sum((1, 2))
    pair = alpha[:, :-1, :, None] + p["A"] + (e[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None]
    grad["A"] = np.exp(pair).sum((0, 1))
    np.subtract.at(grad["A"], (before, after), 1.0)
    de[rows[:, None], np.arange(length)[None, :], gold] -= 1.0
    grad["Wo"] = both.reshape(-1, 2 * hidden).T @ de.reshape(-1, de.shape[2])
    grad["bo"] = de.sum((0, 1))
    dboth = de @ p["Wo"].T
    for side, trace, dh_out in (("f", tf, dboth[:, :, :hidden]), ("b", tb, dboth[:, :, hidden:])):
        wx, wh = p[f"Wx{side}"], p[f"Wh{side}"]
        steps = np.empty((length, batch, 4 * hidden))
        dh, dc = np.zeros((batch, hidden)), np.zeros((batch, hidden))
        for t, h0, c0, i, f, o, g, th, slope in reversed(trace):
            dh = dh + dh_out[:, t]
            dc = dc + dh * o * (1 - np.abs(th)) ** 2
            dz = np.concatenate([dc * g, dc * c0, dh * th, dc * i * (1 - np.abs(g)) ** 2], axis=1)
            dz[:, : 3 * hidden] *= slope
            steps[t] = dz
            grad[f"Wh{side}"] += h0.T @ dz
            dh, dc = dz @ wh.T, dc * f
        dtable = np.zeros((len(p["E"]), 4 * hidden))
        order = np.argsort(ids.T.ravel(), kind="stable")
        used, first = np.unique(ids.T.ravel()[order], return_index=True)
        dtable[used] = np.add.reduceat(steps.reshape(-1, 4 * hidden)[order], first, axis=0)
        grad[f"Wx{side}"] = p["E"].T @ dtable
        grad[f"b{side}"] = dtable.sum(0)
        grad["E"] += dtable @ wx.T
    return float((z - score).mean()), {k: v / batch for k, v in grad.items()}


def train(ids: np.ndarray, gold: np.ndarray, symbols: int, tags: int, steps: int = 400, batch: int = 32, rate: float = 0.015, seed: int = 5) -> Params:
    """Adam over random batches, the rate falling to a tenth."""
    p = initial(symbols, tags)
    rng = np.random.default_rng(seed)
    m, v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
    for step in range(1, steps + 1):
        pick = rng.integers(0, len(ids), min(batch, len(ids)))
        _, grad = loss_and_gradient(p, ids[pick], gold[pick])
        norm = np.sqrt(sum((g * g).sum() for g in grad.values()))
        now = rate * (1 - 0.9 * step / steps)
        for k, g in grad.items():
            g = g * min(1.0, 5.0 / (norm + 1e-9))
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.99 * v[k] + 0.01 * g * g
            p[k] = p[k] - now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    return {k: x.astype(np.float32) for k, x in p.items()}
