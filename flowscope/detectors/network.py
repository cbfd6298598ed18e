"""Dense networks in numpy: the arithmetic of one mini-batch, used inside tasks."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

# --- fixed values: optimiser defaults --------------------------------------------------------------
RATE, BETA1, BETA2, EPSILON = 1e-3, 0.9, 0.999, 1e-7
# --- end of fixed values ---------------------------------------------------------------------------
PIECE = 32768


def elu(x):
    return np.maximum(x, 0) + np.expm1(np.minimum(x, 0))


def elu_slope(y):
    return np.minimum(y, 0) + 1.0


def relu(x):
    return np.maximum(x, 0)


def relu_slope(y):
    return (y > 0).astype(y.dtype)


def linear(x):
    return x


def linear_slope(y):
    return np.ones_like(y)


ACTIVATIONS = {"elu": (elu, elu_slope), "relu": (relu, relu_slope), "linear": (linear, linear_slope)}


def elu_into(z, slope, out):
    np.minimum(z, 0, out=slope)
    np.expm1(slope, out=slope)
    np.maximum(z, slope, out=out)  # expm1(z) >= z
    np.add(slope, 1.0, out=slope)


def relu_into(z, slope, out):
    np.maximum(z, 0, out=out)
    np.greater(z, 0, out=slope)


def linear_into(z, slope, out):
    np.copyto(out, z)
    slope.fill(1.0)


#: The same functions without new arrays: both the values and the slopes are written.
INTO = {"elu": elu_into, "relu": relu_into, "linear": linear_into}


@dataclass(frozen=True)
class Layout:
    """Layer widths from input to output, one activation per layer, optional L1 on the first activations."""

    sizes: tuple[int, ...]
    activations: tuple[str, ...]
    l1: float = 0.0

    def shapes(self) -> list[tuple[int, int]]:
        return list(zip(self.sizes[:-1], self.sizes[1:]))

    def length(self) -> int:
        return sum(a * b + b for a, b in self.shapes())

    def initial(self, seed: int) -> np.ndarray:
        """Glorot-uniform weights, zero biases, as one flat vector."""
        rng = np.random.default_rng(seed)
        parts = []
        for a, b in self.shapes():
            limit = np.sqrt(6.0 / (a + b))
            parts += [rng.uniform(-limit, limit, a * b), np.zeros(b)]
        return np.concatenate(parts)

    def layers(self, flat: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        out, at = [], 0
        for a, b in self.shapes():
            out.append((flat[at : at + a * b].reshape(a, b), flat[at + a * b : at + a * b + b]))
            at += a * b + b
        return out

    def forward(self, flat: np.ndarray, x: np.ndarray) -> list[np.ndarray]:
        outputs = [x]
        for (w, b), name in zip(self.layers(flat), self.activations):
            outputs.append(ACTIVATIONS[name][0](outputs[-1] @ w + b))
        return outputs

    def predict(self, flat: np.ndarray, x: np.ndarray) -> np.ndarray:
        return self.forward(flat, x)[-1]

    def loss_and_gradient(self, flat: np.ndarray, x: np.ndarray) -> tuple[float, np.ndarray]:
        """Mean squared reconstruction error of a batch and its gradient."""
        outputs = self.forward(flat, x)
        error = outputs[-1] - x
        delta = 2.0 * error / error.size
        gradient = np.empty(self.length())
        layers, slots = self.layers(flat), self.layers(gradient)
        for i in range(len(layers) - 1, -1, -1):
            if i == 0 and self.l1:
                delta = delta + self.l1 * np.sign(outputs[1]) / len(x)
            if self.activations[i] != "linear":
                delta = delta * ACTIVATIONS[self.activations[i]][1](outputs[i + 1])
            np.matmul(outputs[i].T, delta, out=slots[i][0])
            np.sum(delta, axis=0, out=slots[i][1])
            if i:
                delta = delta @ layers[i][0].T
        return float(np.mean(error**2)), gradient


@dataclass
class Adam:
    """Optimiser state over a flat parameter vector; a step changes its own copies in place."""

    flat: np.ndarray
    first: np.ndarray = field(default=None)
    second: np.ndarray = field(default=None)
    steps: int = 0

    def __post_init__(self):
        self.flat = np.array(self.flat)
        self.first = np.zeros_like(self.flat) if self.first is None else np.array(self.first)
        self.second = np.zeros_like(self.flat) if self.second is None else np.array(self.second)

    def step(self, gradient: np.ndarray) -> None:
        self.steps += 1
        update(self.flat, self.first, self.second, gradient, self.steps)


def update(flat: np.ndarray, first: np.ndarray, second: np.ndarray, gradient: np.ndarray, steps: int) -> None:
    """Adam's step number ``steps``, in place."""
    rate = RATE * np.sqrt(1 - BETA2**steps) / (1 - BETA1**steps)
    room = np.empty(min(PIECE, len(flat)))
    for at in range(0, len(flat), PIECE):  # a piece stays in the processor's cache
        w, g, m, v = (a[at : at + PIECE] for a in (flat, gradient, first, second))
        now = room[: len(g)]
        m *= BETA1
        m += np.multiply(g, 1 - BETA1, out=now)
        np.multiply(g, g, out=now)
        now *= 1 - BETA2
        v *= BETA2
        v += now
        np.sqrt(v, out=now)
        now += EPSILON
        np.divide(m, now, out=now)
        now *= rate
        w -= now


class Member:
    """One of ``count`` processes that train a network together, over arrays that all of them see.

    In a step a member takes its rows forward and their errors back, all meet, it makes the gradient of its own range of
    the parameters from all rows and updates that range, and all meet again. A gradient is the same single product as in
    one process, so nothing is added up over members. ``room`` is a zeroed vector of ``Member.space`` numbers.
    """

    def __init__(self, layout: Layout, size: int, count: int, rank: int, room: np.ndarray, meet: Callable[[], None]):
        self.layout, self.count, self.rank, self.meet, at = layout, count, rank, meet, 0

        def taken(*shape: int) -> np.ndarray:
            nonlocal at
            at += int(np.prod(shape))
            return room[at - int(np.prod(shape)) : at].reshape(shape)

        self.flat, self.first, self.second = (taken(layout.length()) for _ in range(3))
        self.sums = taken(count, 2)
        shapes = layout.shapes()
        # a column of ones beside the inputs of a layer: the biases follow its weights as one more row of them
        self.inputs = [taken(size, a + 1) for a, _ in shapes[1:]]
        self.deltas = [taken(size, b) for _, b in shapes]
        self.first_input = np.ones((size, shapes[0][0] + 1))
        rows = -(-size // count)
        self.sized = [(np.empty((rows, b)), np.empty((rows, b))) for _, b in shapes]
        self.affine, own, start = [], [], 0
        for a, b in shapes:
            self.affine.append(self.flat[start : start + (a + 1) * b].reshape(a + 1, b))
            own += [(start + r * b, len(self.affine) - 1, r) for r in range(a + 1)]
            start += (a + 1) * b
        # whole rows of weights, those whose start lies in this member's part
        own = [o for o in own if o[0] * count // start == rank]
        self.low, self.high = (own[0][0], own[-1][0] + shapes[own[-1][1]][1]) if own else (0, 0)
        self.gradient, self.pieces = np.empty(self.high - self.low), []
        for i, (_, b) in enumerate(shapes):
            mine = [o for o in own if o[1] == i]
            if mine:
                slot = self.gradient[mine[0][0] - self.low : mine[-1][0] + b - self.low].reshape(-1, b)
                self.pieces.append((i, mine[0][2], mine[-1][2] + 1, slot))

    @staticmethod
    def space(layout: Layout, size: int, count: int) -> int:
        shapes = layout.shapes()
        return 3 * layout.length() + 2 * count + size * (sum(a + 1 for a, _ in shapes[1:]) + sum(b for _, b in shapes))

    def begin(self, flat: np.ndarray, first: np.ndarray, second: np.ndarray) -> None:
        """Put the state in place; for one member, before the others start."""
        self.flat[:], self.first[:], self.second[:] = flat, first, second
        for x in self.inputs:
            x[:, -1] = 1.0

    def step(self, x: np.ndarray, steps: int) -> float:
        """Update the state by the mini-batch ``x``; the sum of this member's squared errors before."""
        n, layout = len(x), self.layout
        low, high = n * self.rank // self.count, n * (self.rank + 1) // self.count
        self.first_input[:n, :-1] = x
        inputs, last, total = [self.first_input, *self.inputs], len(self.affine) - 1, 0.0
        if high > low:
            slopes = []
            for i, (affine, (z, slope)) in enumerate(zip(self.affine, self.sized)):
                z, slope = z[: high - low], slope[: high - low]
                np.matmul(inputs[i][low:high], affine, out=z)
                out = self.inputs[i][low:high, :-1] if i < last else z
                if layout.activations[i] != "linear":
                    INTO[layout.activations[i]](z, slope, out)
                elif i < last:
                    np.copyto(out, z)
                slopes.append(slope)
            delta = self.deltas[last][low:high]
            np.subtract(z, x[low:high], out=delta)
            total = float(np.vdot(delta, delta))
            np.multiply(delta, 2.0 / x.size, out=delta)
            for i in range(last, -1, -1):
                delta = self.deltas[i][low:high]
                if i < last:
                    np.matmul(self.deltas[i + 1][low:high], self.affine[i + 1][:-1].T, out=delta)
                if i == 0 and layout.l1:
                    delta += layout.l1 / n * np.sign(out if last == 0 else self.inputs[0][low:high, :-1])
                if layout.activations[i] != "linear":
                    delta *= slopes[i]
        self.meet()
        for i, top, end, slot in self.pieces:
            np.matmul(inputs[i][:n, top:end].T, self.deltas[i][:n], out=slot)
        own = slice(self.low, self.high)
        update(self.flat[own], self.first[own], self.second[own], self.gradient, steps)
        self.meet()
        return total

    def added(self, *own: float) -> np.ndarray:
        """The sums of two numbers over the members."""
        self.sums[self.rank] = own
        self.meet()
        total = self.sums.sum(axis=0)
        self.meet()
        return total
