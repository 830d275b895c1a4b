"""Losses: gradient, hessian, link and its inverse over numpy arrays."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np

LEAST_HESSIAN = 1e-16


class Objective:
    """A loss over ``size`` outputs."""

    name, size = "custom", 1

    def compute(self, label: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(gradient, hessian), rows by outputs; ``score`` is ``transform`` of the raw score."""
        raise NotImplementedError

    def transform(self, raw: np.ndarray) -> np.ndarray:
        return raw

    def inverse(self, score: Sequence[float]) -> list[float]:
        return list(score)

    def encode(self, label: np.ndarray) -> np.ndarray:
        """Labels as rows by outputs."""
        return label.reshape(-1, 1)

    def to_dict(self) -> dict:
        return {"name": self.name, "size": self.size}


class Square(Objective):
    name = "square"

    def compute(self, label, score):
        return score - label, np.ones_like(score)


class Logistic(Objective):
    name = "logistic"

    def compute(self, label, score):
        return score - label, np.maximum(score * (1 - score), LEAST_HESSIAN)

    def transform(self, raw):
        return 1.0 / (1.0 + np.exp(-raw))

    def inverse(self, score):
        if not all(0 < s < 1 for s in score):
            raise ValueError("logistic loss needs labels of both classes, or a base score inside (0, 1)")
        return [-float(np.log(1 / s - 1)) for s in score]


class Softmax(Objective):
    name = "softmax"

    def __init__(self, size: int):
        if size < 2:
            raise ValueError("softmax needs at least two classes")
        self.size = size

    def compute(self, label, score):
        return score - label, np.maximum(2 * score * (1 - score), LEAST_HESSIAN)

    def transform(self, raw):
        e = np.exp(raw - raw.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def inverse(self, score):
        if not all(s > 0 for s in score):
            raise ValueError("softmax needs labels of every class")
        lift = float(np.log(len(score) / sum(score)))
        return [lift + float(np.log(s)) for s in score]

    def encode(self, label):
        out = np.zeros((len(label), self.size))
        out[np.arange(len(label)), label.astype(np.int64)] = 1
        return out


class Huber(Objective):
    """Pseudo-Huber loss: quadratic near zero, linear beyond ``delta``."""

    name = "huber"

    def __init__(self, delta: float = 1.0):
        self.delta = delta

    def compute(self, label, score):
        r = score - label
        s = np.sqrt(1 + (r / self.delta) ** 2)
        return r / s, 1 / s**3

    def to_dict(self):
        return super().to_dict() | {"delta": self.delta}


class Scalar(Objective):
    """A user's loss of one output: ``compute(label, score) -> (gradient, hessian)`` over numpy arrays."""

    def __init__(self, compute: Callable, transform: Callable | None = None, inverse: Callable | None = None, name: str = "custom"):
        self._compute, self._transform, self._inverse, self.name = compute, transform, inverse, name

    def compute(self, label, score):
        g, h = self._compute(label, score)
        return np.broadcast_to(g, score.shape).astype(float), np.broadcast_to(h, score.shape).astype(float)

    def transform(self, raw):
        return self._transform(raw) if self._transform else raw

    def inverse(self, score):
        return [float(self._inverse(s)) for s in score] if self._inverse else list(score)


def objective(name: str, size: int = 1, **more) -> Objective:
    kinds = {"square": Square, "logistic": Logistic}
    if name in kinds:
        return kinds[name]()
    if name == "softmax":
        return Softmax(size)
    if name == "huber":
        return Huber(more.get("delta", 1.0))
    raise ValueError(f"unknown objective {name!r}")
