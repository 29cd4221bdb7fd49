"""The in-order update of models that learn side by side, for the few places where rows must follow each other."""

from __future__ import annotations

import math
from array import array
from collections.abc import Callable

import numpy as np

from ..functions.logistic import PROB_CEILING, PROB_FLOOR, FtrlConfig


def counted(p: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.divide(p * n, p + n, out=np.zeros_like(p), where=p + n > 0)


def probability(margin: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        prob = 1.0 / (1.0 + np.exp(-margin))
    return np.where(prob == 0.0, PROB_FLOOR, np.where(prob == 1.0, PROB_CEILING, prob))


class Ftrl:
    """FTRL-proximal: cells z and n; n grows by the squared gradient, or follows from the label counts."""

    def __init__(self, from_counts: bool) -> None:
        self.from_counts = from_counts

    def weights(self, rates: dict, z: np.ndarray, n: np.ndarray) -> np.ndarray:
        rate = 1.0 / ((rates["beta"] + np.sqrt(n)) / rates["alpha"] + rates["l2"])
        return np.where(np.abs(z) <= rates["l1"], 0.0, -rate * (z - np.copysign(rates["l1"], z)))

    def move(self, rates: dict, cells: np.ndarray, w: np.ndarray, g: np.ndarray, step: int) -> None:
        z, n = cells[Models.Z], cells[Models.N]
        grown = counted(cells[Models.P], cells[Models.M]) if self.from_counts else n + g * g
        cells[Models.Z] = z + g + rates["sigma_sign"] * (np.sqrt(grown) - np.sqrt(n)) / rates["alpha"] * w
        cells[Models.N] = grown


class Descent:
    """Online gradient descent: the cell z holds the weight itself, the t-th example moves it by 1 / sqrt(t)."""

    from_counts = False

    def weights(self, rates: dict, z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return z

    def move(self, rates: dict, cells: np.ndarray, w: np.ndarray, g: np.ndarray, step: int) -> None:
        cells[Models.Z] -= g / np.sqrt(step)


def _few_ftrl(cells: array, places: list[int], values: list[float], rates: tuple, label: int, step: int, from_counts: bool) -> tuple[float, int]:
    """``Models.learn`` of one model for a few different features, number by number: the margin, and how many more weights are other than zero.

    Every operation is that of the arrays, in the same order.
    """
    alpha, beta, l1, l2, sign = rates
    sqrt = math.sqrt
    weights = []
    margin = 0.0
    for at, value in zip(places, values):
        z = cells[at]
        if abs(z) <= l1:
            w = 0.0
        else:
            below = (beta + sqrt(cells[at + 1])) / alpha + l2
            w = -(1.0 / below if below else math.inf) * (z - math.copysign(l1, z))
        weights.append(w)
        margin += w * value
    d = _probability(margin) - label
    more = 0
    for at, value, w in zip(places, values, weights):
        g = d * value
        kind = at + (Models.P if label else Models.M)
        cells[kind] += 1.0
        cells[kind + 2] += 1.0
        z, n = cells[at], cells[at + 1]
        if from_counts:
            p, m = cells[at + 2], cells[at + 3]
            grown = p * m / (p + m) if p + m > 0 else 0.0
        else:
            grown = n + g * g
        z = z + g + sign * (sqrt(grown) - sqrt(n)) / alpha * w
        cells[at], cells[at + 1] = z, grown
        cells[at + 6] += g
        # A weight is other than zero where z is out of the threshold.
        more += (not abs(z) <= l1) - (w != 0.0)
    return margin, more


def _few_descent(cells: array, places: list[int], values: list[float], rates: tuple, label: int, step: int, from_counts: bool) -> tuple[float, int]:
    margin = 0.0
    for at, value in zip(places, values):
        margin += cells[at] * value
    d = _probability(margin) - label
    root = math.sqrt(step)
    more = 0
    for at, value in zip(places, values):
        g = d * value
        kind = at + (Models.P if label else Models.M)
        cells[kind] += 1.0
        cells[kind + 2] += 1.0
        w = cells[at]
        cells[at] = w - g / root
        cells[at + 6] += g
        more += (cells[at] != 0.0) - (w != 0.0)
    return margin, more


def _probability(margin: float) -> float:
    try:
        prob = 1.0 / (1.0 + math.exp(-margin))
    except OverflowError:
        return PROB_FLOOR
    return PROB_FLOOR if prob == 0.0 else PROB_CEILING if prob == 1.0 else prob


# Up to so many cells (features times models) of an example go number by number, which is faster than arrays of them.
FEW = 64

EXACT, COUNTED, DESCENT = Ftrl(False), Ftrl(True), Descent()
Rule = Ftrl | Descent


class Models:
    """The features that a run of examples meets, as one flat array of cells: by feature, then model, then kind.

    Kinds of cells: z, n, p_count, n_count, p_new, n_new, g_new.
    """

    Z, N, P, M, P_NEW, M_NEW, G_NEW = range(7)

    def __init__(self, configs: list[FtrlConfig], rule: Rule, steps: int = 0):
        self.rule = rule
        self.rates = {k: np.array([[float(getattr(c, k))] for c in configs]) for k in ("alpha", "beta", "l1", "l2", "sigma_sign")}
        self.each = list(zip(*[v[:, 0].tolist() for v in self.rates.values()]))
        self.models = len(configs)
        self.few = FEW // self.models if (self.rates["alpha"] != 0).all() else 0
        self.slot: dict[int, int] = {}
        self.flat = array("d")
        self.steps = steps
        self.nonzero = np.zeros(self.models, np.int64)  # more weights other than zero than at the start

    @property
    def cells(self) -> np.ndarray:
        """Kind x model x feature, as a view; no feature can be added while it is in use."""
        if not self.flat:
            return np.zeros((7, self.models, 0))
        return np.frombuffer(self.flat).reshape(-1, self.models, 7).transpose(2, 1, 0)

    def slots(self, ids: np.ndarray, start: np.ndarray | Callable[[], np.ndarray]) -> list[int]:
        """Places of the features; new ones start from (z, n, p_count, n_count) x model x feature, as given or as asked for."""
        ids = ids.tolist()
        try:
            return [self.slot[f] for f in ids]
        except KeyError:
            pass
        if callable(start):
            start = start()
        out = []
        for k, f in enumerate(ids):
            s = self.slot.get(f)
            if s is None:
                s = self.slot[f] = len(self.slot)
                new = np.zeros((self.models, 7))
                new[:, :4] = start[:, :, k].T
                self.flat.frombytes(new.tobytes())
            out.append(s)
        return out

    def learn(self, slots: list[int], values: np.ndarray, label: int, report: bool = False) -> np.ndarray:
        """Move the cells of one example's features by that example; each model's margin from before."""
        self.steps += 1
        # A feature that is there twice moves once, from where both stood.
        if len(slots) <= self.few and len(set(slots)) == len(slots):
            width = 7 * self.models
            given, few = values.tolist(), _few_descent if isinstance(self.rule, Descent) else _few_ftrl
            margins = []
            for j, rates in enumerate(self.each):
                margin, more = few(
                    self.flat, [s * width + 7 * j for s in slots], given, rates, label, self.steps, self.rule.from_counts)
                margins.append(margin)
                if report and more:
                    self.nonzero[j] += more
            return np.array(margins)
        every = self.cells
        cells = every[:, :, slots]
        w = self.rule.weights(self.rates, cells[self.Z], cells[self.N])
        margin = w @ values
        g = (probability(margin) - label)[:, None] * values
        cells[self.P if label else self.M] += 1.0
        cells[self.P_NEW if label else self.M_NEW] += 1.0
        self.rule.move(self.rates, cells, w, g, self.steps)
        cells[self.G_NEW] += g
        every[:, :, slots] = cells
        if report:
            after = self.rule.weights(self.rates, cells[self.Z], cells[self.N])
            self.nonzero += np.count_nonzero(after, axis=1) - np.count_nonzero(w, axis=1)
        return margin

    def rows(self) -> dict[str, np.ndarray]:
        """config_id, feature, w, z, n, p_new, n_new, g_new of all features met."""
        n, models = len(self.slot), self.models
        cells = self.cells
        w = self.rule.weights(self.rates, cells[self.Z], cells[self.N])
        flat = {"w": w, "z": cells[self.Z], "n": cells[self.N], "p_new": cells[self.P_NEW], "n_new": cells[self.M_NEW],
                "g_new": cells[self.G_NEW]}
        return {
            "config_id": np.repeat(np.arange(models), n),
            "feature": np.tile(np.fromiter(self.slot, np.int64, n), models),
            **{k: np.ascontiguousarray(v).reshape(-1) for k, v in flat.items()},
        }
