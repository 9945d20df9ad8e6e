"""A gated recurrent language model in numpy: truncated backpropagation, class-factored output, carried state."""

from __future__ import annotations

import io
import math
from dataclasses import dataclass

import numpy as np

#: Units of state, steps of a window of backpropagation, members of a class of frequent words.
HIDDEN, WINDOW, MEMBERS = 24, 32, 64


@dataclass
class Gru:
    """Reads inputs (a frequent word, or the class of a rare one) and gives chances of classes and of a frequent
    class's members. Rare words' chances within their class are counts, which the caller adds."""

    inputs: np.ndarray  # [input, 3 * hidden]: update, reset and candidate gates' share of each input
    state: np.ndarray  # [hidden, 3 * hidden]
    to_class: np.ndarray  # [hidden, class]
    class_bias: np.ndarray
    to_member: np.ndarray  # [frequent class, hidden, member]
    member_bias: np.ndarray  # [frequent class, member]; -inf where there's no word

    @classmethod
    def fresh(cls, n_inputs: int, class_bias: np.ndarray, member_bias: np.ndarray, seed: int = 1) -> Gru:
        """Starts at the words' frequencies: the biases alone give the unigram chances."""
        rng = np.random.default_rng(seed)
        f = lambda *shape: (rng.normal(0, 0.08, shape)).astype(np.float32)
        return cls(f(n_inputs, 3 * HIDDEN), f(HIDDEN, 3 * HIDDEN), 0.1 * f(HIDDEN, len(class_bias)), class_bias.astype(np.float32), 0.1 * f(len(member_bias), HIDDEN, member_bias.shape[1]), member_bias.astype(np.float32))

    def arrays(self) -> list[np.ndarray]:
        return [self.inputs, self.state, self.to_class, self.class_bias, self.to_member, self.member_bias]

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, *self.arrays())
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> Gru:
        with np.load(io.BytesIO(data)) as z:
            return cls(*[z[f"arr_{i}"] for i in range(6)])

    def step(self, tokens: np.ndarray, h: np.ndarray) -> tuple:
        x, u = self.inputs[tokens], h @ self.state
        k = HIDDEN
        gates = 1 / (1 + np.exp(-(x[:, : 2 * k] + u[:, : 2 * k])))
        z, r = gates[:, :k], gates[:, k:]
        n = np.tanh(x[:, 2 * k :] + r * u[:, 2 * k :])
        return n + z * (h - n), z, r, n, u[:, 2 * k :]

    def split(self) -> list[np.ndarray]:
        """Weights of update, reset and candidate gates apart, those of the first two halved: a sigmoid is tanh of half its
        argument, halved, plus a half."""
        k = HIDDEN
        return [np.ascontiguousarray(w[:, i * k : (i + 1) * k]) * np.float32(1 if i == 2 else 0.5) for w in (self.inputs, self.state) for i in range(3)]

    def log_chances(self, h: np.ndarray, classes: np.ndarray, members: np.ndarray) -> np.ndarray:
        """Natural log chance of each row's class, and of its member where the class is of frequent words."""
        out = np.empty(len(h), np.result_type(h, self.to_class))
        for k in range(0, len(h), ROWS):
            s = slice(k, k + ROWS)
            out[s] = _log_softmax_at(h[s], self.to_class, self.class_bias, classes[s])
        order = np.argsort(classes.astype(np.int16), kind="stable")
        cuts = np.searchsorted(classes[order], np.arange(len(self.member_bias) + 1))
        h, members = h[order[: cuts[-1]]], members[order[: cuts[-1]]]
        for c in range(len(self.member_bias)):
            for k in range(cuts[c], cuts[c + 1], ROWS):
                s = slice(k, min(k + ROWS, cuts[c + 1]))
                out[order[s]] += _log_softmax_at(h[s], self.to_member[c], self.member_bias[c], members[s])
        return out

    def score(self, inputs: np.ndarray, classes: np.ndarray, members: np.ndarray, lengths: np.ndarray, start: int, window: int = WINDOW) -> np.ndarray:
        """Natural log chance of every token of texts laid end to end. A text's first input is ``start``, later ones the
        tokens before; its state goes on from window to window, to its end. All texts advance together."""
        out = np.zeros(len(inputs), np.float32)
        order = np.argsort(-lengths, kind="stable")
        sizes, starts = lengths[order], (np.cumsum(lengths) - lengths)[order]
        most = int(sizes[0]) if len(sizes) else 0
        active = np.searchsorted(-sizes, -np.arange(most), side="left").tolist()
        before = np.empty_like(inputs)  # what a token is read after
        before[1:] = inputs[:-1]
        before[starts] = start
        in_z, in_r, in_n, to_z, to_r, to_n = self.split()
        h = np.zeros((len(sizes), HIDDEN), np.float32)
        half = np.float32(0.5)
        for t0 in range(0, most, window):
            span = range(t0, min(most, t0 + window))
            where = np.concatenate([starts[: active[t]] + t for t in span])
            x, states, end = before[where], np.empty((len(where), HIDDEN), np.float32), 0
            for t in span:
                m = active[t]
                at, end = slice(end, end + m), end + m
                h = h[:m]
                z, r, n = in_z[x[at]], in_r[x[at]], in_n[x[at]]
                z += h @ to_z
                np.tanh(z, out=z)
                z *= half
                z += half
                r += h @ to_r
                np.tanh(r, out=r)
                r *= half
                r += half
                r *= h @ to_n
                n += r
                np.tanh(n, out=n)
                h = np.subtract(h, n, out=r)
                h *= z
                h += n
                states[at] = h
            out[where] = self.log_chances(states, classes[where], members[where])
        return out


#: Rows whose softmax is taken at once, so that they stay in a core's cache.
ROWS = 2048


def _log_softmax_at(h: np.ndarray, weights: np.ndarray, bias: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of each row's log softmax the place ``at``. Rows of ``h`` are states, whose units are between -1 and 1."""
    s = h @ weights
    s += bias
    reach = np.abs(weights).sum(axis=0)
    if (bias + reach).max() > 80 or (bias - reach).max() < -80:  # else no sum of exponentials leaves a float's range
        s -= s.max(axis=1, keepdims=True)
    found = s[np.arange(len(s)), at]
    np.exp(s, out=s)
    return found - np.log(s @ np.ones(s.shape[1], s.dtype))


def _gradients(model: Gru, tokens: np.ndarray, classes: np.ndarray, members: np.ndarray, weight: np.ndarray, h: np.ndarray, keep: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """Gradients of a window's loss (steps x texts), and the state after it. Backpropagation ends at the window, and where
    ``keep`` is 0, since the state before such a step is zero: another text starts there."""
    steps, k = len(tokens), HIDDEN
    shape = (steps, len(h), k)
    x = model.inputs[tokens.ravel()].reshape(steps, len(h), 3 * k)
    past, hs, gates, n, un = np.empty(shape, h.dtype), np.empty(shape, x.dtype), np.empty((steps, len(h), 2 * k), x.dtype), np.empty(shape, x.dtype), np.empty(shape, x.dtype)
    for t in range(steps):
        if keep is not None:
            h = h * keep[t][:, None]
        past[t] = h
        u = h @ model.state
        g = x[t, :, : 2 * k]
        g += u[:, : 2 * k]
        g *= 0.5
        np.tanh(g, out=g)
        g *= 0.5
        g += 0.5
        gates[t], un[t] = g, u[:, 2 * k :]
        c = g[:, k:] * un[t]
        c += x[t, :, 2 * k :]
        np.tanh(c, out=n[t])
        h = h - n[t]
        h *= g[:, :k]
        h += n[t]
        hs[t] = h
    dh, (d_to_class, d_class_bias, d_to_member, d_member_bias) = _output_gradients(model, hs.reshape(-1, k), classes.ravel(), members.ravel(), weight.ravel())
    dh, z, r = dh.reshape(shape), gates[..., :k], gates[..., k:]
    from_n = (1 - z) * (1 - n * n)
    from_z = (past - n) * z * (1 - z)
    from_r = un * r * (1 - r)
    d_x, d_u = np.empty_like(x), np.empty_like(x)
    back, back_by = np.zeros_like(h), np.ascontiguousarray(model.state.T)
    for t in range(steps - 1, -1, -1):
        g = dh[t] + back
        d_n = g * from_n[t]
        np.multiply(g, from_z[t], out=d_u[t, :, :k])
        np.multiply(d_n, from_r[t], out=d_u[t, :, k : 2 * k])
        np.multiply(d_n, r[t], out=d_u[t, :, 2 * k :])
        d_x[t, :, 2 * k :] = d_n
        g *= z[t]
        back = d_u[t] @ back_by
        back += g
        if keep is not None:
            back *= keep[t][:, None]
    d_x[..., : 2 * k] = d_u[..., : 2 * k]
    d_state = past.reshape(-1, k).T @ d_u.reshape(-1, 3 * k)
    d_inputs, read = np.zeros_like(model.inputs), tokens.ravel()
    order = np.argsort(read.astype(np.int16) if len(d_inputs) < 1 << 15 else read, kind="stable")
    read = read[order]
    starts = np.flatnonzero(np.r_[True, read[1:] != read[:-1]])
    d_inputs[read[starts]] = np.add.reduceat(d_x.reshape(-1, 3 * k)[order], starts, axis=0)
    return [d_inputs, d_state, d_to_class, d_class_bias, d_to_member, d_member_bias], h


def _output_gradients(model: Gru, h: np.ndarray, classes: np.ndarray, members: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Gradients of the loss by the states, and by the output's weights. Rows are put in order of class and member, so that
    a class's rows lie side by side; biases are the weights of a unit that is always 1."""
    k, (n_frequent, _, n_members) = HIDDEN, model.to_member.shape
    name = classes * n_members + np.where(classes < n_frequent, members, 0)
    order = np.argsort(name.astype(np.int16) if len(model.class_bias) * n_members < 1 << 15 else name, kind="stable")
    if not live.all():
        order = order[live[order]]
    name, c, m = name[order], classes[order], members[order]
    unit = np.ones((len(order), k + 1), h.dtype)
    unit[:, :k] = h[order]
    d_state = np.empty((len(order), k), h.dtype)
    d_class, d_member = np.zeros((k + 1, len(model.class_bias)), h.dtype), np.zeros((n_frequent, k + 1, n_members), h.dtype)
    to, by = _with_unit(model.to_class, model.class_bias)
    for i in range(0, len(order), ROWS):
        s = slice(i, i + ROWS)
        d_state[s], d = _pull(unit[s], to, by)
        d_class += d
    by_member = np.empty((n_frequent, n_members, k), h.dtype)
    cuts = np.searchsorted(c, np.arange(n_frequent + 1))
    for j in range(n_frequent):
        by_member[j] = model.to_member[j].T
        for i in range(cuts[j], cuts[j + 1], ROWS):
            s = slice(i, min(i + ROWS, cuts[j + 1]))
            x, d = _pull(unit[s], *_with_unit(model.to_member[j], model.member_bias[j]))
            d_state[s] += x
            d_member[j] += d
    d_state -= model.to_class.T[c]
    d_state[: cuts[-1]] -= by_member[c[: cuts[-1]], m[: cuts[-1]]]
    if len(order):
        starts = np.flatnonzero(np.r_[True, name[1:] != name[:-1]])
        seen, some = np.add.reduceat(unit, starts, axis=0), c[starts]
        heads = np.flatnonzero(np.r_[True, some[1:] != some[:-1]])
        d_class[:, some[heads]] -= np.add.reduceat(seen, heads, axis=0).T
        f = some < n_frequent
        d_member[some[f], :, m[starts][f]] -= seen[f]
    dh = np.zeros_like(h)
    dh[order] = d_state
    return dh, [d_class[:k], d_class[k], d_member[:, :k], d_member[:, k]]


def _with_unit(weights: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights with the bias as a last row; and turned, with ones as a last column."""
    return np.concatenate((weights, bias[None])), np.concatenate((weights.T, np.ones((len(bias), 1), weights.dtype)), axis=1)


def _pull(unit: np.ndarray, to: np.ndarray, by: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows' softmax: the mean weights of each row, and the gradient by ``to`` of the log of its sum."""
    p = unit @ to
    reach = np.abs(to[:-1]).sum(axis=0)  # units of a state are between -1 and 1
    if (to[-1] + reach).max() > 80 or (to[-1] - reach).max() < -80:
        p -= p.max(axis=1, keepdims=True)
    np.exp(p, out=p)
    mean = p @ by
    one = 1 / mean[:, -1:]
    return mean[:, :-1] * one, (unit * one).T @ p


class Adam:
    """The moments of a model's weights, and steps by them."""

    def __init__(self, model: Gru):
        self.model, self.first, self.second, self.turn = model, [np.zeros_like(a) for a in model.arrays()], [np.zeros_like(a) for a in model.arrays()], 0

    def step(self, grads: list[np.ndarray], scale: float, rate: float) -> None:
        self.turn += 1
        by, root = rate / (1 - 0.9**self.turn), 1 / math.sqrt(1 - 0.99**self.turn)
        for a, g, m, v in zip(self.model.arrays(), grads, self.first, self.second, strict=True):
            g *= scale
            np.clip(g, -1, 1, out=g)
            m *= 0.9
            m += 0.1 * g
            g *= g
            g *= 0.01
            v *= 0.99
            v += g
            np.sqrt(v, out=g)
            g *= root
            g += 1e-6
            np.divide(m, g, out=g)
            g *= by
            a -= g


def learn(adam: Adam, inputs: np.ndarray, classes: np.ndarray, members: np.ndarray, lengths: np.ndarray, start: int, rate: float, lanes: int = 256, window: int = WINDOW) -> None:
    """One pass over every token of texts laid end to end, which are cut into so many lanes that are read side by side. The
    state goes on from window to window and is zero where a text, or a lane, starts."""
    n = len(inputs)
    if not n:
        return
    lanes = max(1, min(lanes, n // window))
    most = -(-n // lanes)
    before, first = np.empty_like(inputs), np.zeros(n, bool)
    starts = (np.cumsum(lengths) - lengths)[lengths > 0]
    before[1:], before[starts], first[starts] = inputs[:-1], start, True
    side = lambda x: np.ascontiguousarray(np.pad(x, (0, lanes * most - n)).reshape(lanes, most).T)
    before, classes, members, live = side(before), side(classes), side(members), side(np.ones(n, bool))
    keep = side(~first).astype(np.float32)
    h = np.zeros((lanes, HIDDEN), np.float32)
    for t in range(0, most, window):
        s = slice(t, t + window)
        grads, h = _gradients(adam.model, before[s], classes[s], members[s], live[s], h, keep[s])
        adam.step(grads, 1 / max(1, live[s].sum()), rate)


def train(model: Gru, texts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], start: int, rate: float = 0.01, batch: int = 24, window: int = WINDOW, seed: int = 0) -> Gru:
    """One pass over texts (inputs, classes, members) with Adam; the state goes on from window to window."""
    rng = np.random.default_rng(seed)
    texts = sorted(texts, key=lambda x: len(x[0]))
    groups = [texts[i : i + batch] for i in range(0, len(texts), batch)]
    rng.shuffle(groups)
    adam = Adam(model)
    for group in groups:
        most = max(len(x[0]) for x in group)
        pad = lambda i, fill: np.array([np.pad(x[i], (0, most - len(x[i])), constant_values=fill) for x in group]).T  # noqa: B023, E731
        inputs, classes, members = pad(0, start), pad(1, 0), pad(2, 0)
        live = np.array([np.arange(most) < len(x[0]) for x in group]).T
        before = np.concatenate((np.full((1, len(group)), start), inputs[:-1]))
        h = np.zeros((len(group), HIDDEN), np.float32)
        for t in range(0, most, window):
            s = slice(t, t + window)
            grads, h = _gradients(model, before[s], classes[s], members[s], live[s], h)
            adam.step(grads, 1 / max(1, live[s].sum()), rate)
    return model


def average(models: list[tuple[float, Gru]]) -> Gru:
    total = sum(w for w, _ in models)
    return Gru(*[(sum(w * a for (w, _), a in zip(models, some, strict=True)) / total).astype(np.float32) for some in zip(*[m.arrays() for _, m in models], strict=True)])
