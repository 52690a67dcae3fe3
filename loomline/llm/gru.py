"""A gated recurrent unit in numpy, forward and back, over a batch of sequences in step. Inputs are already projected: x has 3 * H columns (update, reset, new)."""

from __future__ import annotations

import numpy as np


def step(x: np.ndarray, h: np.ndarray, wh: np.ndarray, keep: list | None = None) -> np.ndarray:
    """The next state; keep gets what the way back needs."""
    size = h.shape[1]
    a = h @ wh
    gates = np.tanh((x[:, : 2 * size] + a[:, : 2 * size]) * np.float32(0.5)) * np.float32(0.5) + np.float32(0.5)
    z, r = gates[:, :size], gates[:, size:]
    n = np.tanh(x[:, 2 * size :] + r * a[:, 2 * size :])
    if keep is not None:
        keep.append((h, z, r, n, a[:, 2 * size :]))
    return n + z * (h - n)


def back(dh: np.ndarray, kept: tuple, wh: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gradients of the inputs, of the state before a step and of its product with wh, from that of the state after it."""
    h, z, r, n, an = kept
    dn = dh * (1 - z) * (1 - n * n)
    dz = dh * (h - n) * z * (1 - z)
    dr = dn * an * r * (1 - r)
    da = np.concatenate([dz, dr, dn * r], 1)
    return np.concatenate([dz, dr, dn], 1), dh * z + da @ wh.T, da


def _sigmoid(x: np.ndarray) -> None:
    """1 / (1 + exp(-x)) in place. numpy's exp() takes half the time of its tanh(); where it overflows (callers leave the warning out), the result is 0, as it should be."""
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += np.float32(1)
    np.divide(np.float32(1), x, out=x)


def step_in_parts(x: np.ndarray, h: np.ndarray, wh: np.ndarray, keep: list | None = None) -> np.ndarray:
    """step() with the three parts of x, 3 * rows * H, and of wh, 3 * H * H, each in one piece, so that no operation walks along short rows of a wider array."""
    a = h @ wh
    gates, n = a[:2], np.empty_like(h)
    gates += x[:2]
    _sigmoid(gates)
    z, r = gates
    np.multiply(r, a[2], out=n)
    n += x[2]
    n += n
    _sigmoid(n)  # tanh(x) is 2 * sigmoid(2 * x) - 1
    n += n
    n -= np.float32(1)
    new = h - n
    new *= z
    new += n
    if keep is not None:
        keep.append((h, z, r, n, a[2]))
    return new


def back_in_parts(dh: np.ndarray, kept: tuple, wht: np.ndarray, dx: np.ndarray, da: np.ndarray) -> np.ndarray:
    """back() for step_in_parts(): fills dx and da, 3 * rows * H, and gives the gradient of the state before the step; wht has the parts of wh transposed."""
    h, z, r, n, an = kept
    dz, dr, dn = dx
    keep, work = 1 - z, np.multiply(n, n)
    np.subtract(1, work, out=work)
    np.multiply(dh, keep, out=dn)
    dn *= work
    np.subtract(h, n, out=dz)
    dz *= dh
    dz *= z
    dz *= keep
    np.subtract(1, r, out=work)
    work *= r
    np.multiply(dn, an, out=dr)
    dr *= work
    da[:2] = dx[:2]
    np.multiply(dn, r, out=da[2])
    before = dh * z
    for part in da @ wht:
        before += part
    return before


class Adam:
    def __init__(self, params: list[np.ndarray], rate: float) -> None:
        self.params, self.rate, self.t = params, rate, 0
        self.m, self.v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]

    def update(self, grads: list[np.ndarray]) -> None:
        self.t += 1
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        cut = min(1.0, 5.0 / (norm + 1e-9))
        rate = self.rate * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        for p, g, m, v in zip(self.params, grads, self.m, self.v):
            g = g * np.float32(cut)
            m += np.float32(0.1) * (g - m)
            v += np.float32(0.001) * (g * g - v)
            p -= np.float32(rate) * m / (np.sqrt(v) + np.float32(1e-8))


class FlatAdam:
    """Adam in place, over one array that holds all parameters; gradients come as a sum and are scaled here. It goes through the arrays in blocks that stay in a core's cache.

    v is kept as a multiple, 1 / 0.999**t of what it is, and m in the unit of sqrt(v), so that neither needs a pass for what fades of v or for a factor of its own. When
    the multiple has grown large, both are brought back.
    """

    BLOCK, LARGE = 65536, 1e6

    def __init__(self, flat: np.ndarray, rate: float) -> None:
        self.flat, self.rate, self.t, self.times = flat, rate, 0, 1.0
        self.m, self.v, self.work = np.zeros_like(flat), np.zeros_like(flat), np.empty(min(len(flat), self.BLOCK), flat.dtype)

    def update(self, grad: np.ndarray, scale: float, used: np.ndarray | None = None, sums: np.ndarray | None = None) -> None:
        """used, sums: gradients of some rows of a table that the parameters begin with; those of its other rows are 0, and grad has what follows the table."""
        self.t += 1
        norm = float(np.dot(grad, grad)) + (0.0 if used is None else float(np.vdot(sums, sums)))
        scale *= min(1.0, 5.0 / (np.sqrt(norm) * scale + 1e-9))
        rate = self.rate * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t) * (0.1 / np.sqrt(0.001))
        self.times /= 0.999
        if self.times > self.LARGE:
            self.m *= np.float32(self.times**-0.5)
            self.v *= np.float32(1 / self.times)
            self.times = 1.0
        root = np.sqrt(self.times)
        unit, fade, least, rate = (np.float32(x) for x in (scale * np.sqrt(0.001) * root, 0.9 / np.sqrt(0.999), 1e-8 * root, rate))
        table = len(self.flat) - len(grad)
        if used is not None:
            w = sums * unit
            m, v = (x[:table].reshape(-1, sums.shape[1]) for x in (self.m, self.v))
            m[used] += w / fade  # what comes in fades with the rest below
            v[used] += w * w
        for begin, end in ((0, table), (table, len(self.flat))):
            for at in range(begin, end, self.BLOCK):
                p, m, v = (x[at : min(at + self.BLOCK, end)] for x in (self.flat, self.m, self.v))
                w = self.work[: len(p)]
                m *= fade
                if at >= table:
                    np.multiply(grad[at - table : at - table + len(p)], unit, out=w)
                    m += w
                    w *= w
                    v += w
                np.sqrt(v, out=w)
                w += least
                np.divide(m, w, out=w)
                w *= rate
                p -= w


def uniform(rng: np.random.Generator, *shape: int) -> np.ndarray:
    return (rng.uniform(-1, 1, shape) / np.sqrt(shape[0])).astype(np.float32)
