"""Callbacks: called after each round with the parameters, a snapshot of the model and the metrics so far; true stops."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from arborlane.functions.metrics import Metric
from arborlane.params import Params


class Callback:
    def compute(self, params: Params, model, iteration: int, train: list[dict], valid: list[dict]) -> bool:
        raise NotImplementedError

    def close(self) -> None:
        """Called once after the last round, also where a fit fails."""


class EarlyStop(Callback):
    """Stops when over the last ``iters`` rounds any validation metric has not improved. The model is left as it is."""

    def __init__(self, metrics: list[Metric], iters: int = 10):
        if iters < 1:
            raise ValueError("iters must be at least 1")
        self.metrics, self.iters = metrics, iters

    def compute(self, params, model, iteration, train, valid):
        if len(valid) <= self.iters:
            return False
        first, last = valid[-1 - self.iters], valid[-1]
        better = [(last[m.name] > first[m.name]) if m.larger_is_better else (last[m.name] < first[m.name]) for m in self.metrics]
        return not all(better)


class Recorder(Callback):
    """Keeps the metric histories."""

    def __init__(self):
        self.train: list[dict] = []
        self.valid: list[dict] = []

    def compute(self, params, model, iteration, train, valid):
        self.train, self.valid = list(train), list(valid)
        return False


class Checkpoint(Callback):
    """Saves the model every ``interval`` rounds to path/model-<round>-<trees>, beside the rounds that follow. An error of a
    save is raised at the next one, or at the end."""

    def __init__(self, save: Callable[[object, str], None], path: str, interval: int):
        if interval < 1:
            raise ValueError("interval must be at least 1")
        self.save, self.path, self.interval = save, path, interval
        self.worker, self.running = None, None

    def _finish(self) -> None:
        running, self.running = self.running, None
        if running is not None:
            running.result()

    def compute(self, params, model, iteration, train, valid):
        if iteration % self.interval == 0:
            self._finish()
            self.worker = self.worker or ThreadPoolExecutor(1, "checkpoint")
            self.running = self.worker.submit(self.save, model, f"{self.path}/model-{iteration}-{model.num_trees}")
        return False

    def close(self) -> None:
        try:
            self._finish()
        finally:
            if self.worker is not None:
                self.worker.shutdown()
                self.worker = None


class Custom(Callback):
    """A user's function of (params, model, iteration, train, valid); it may change knobs by ``params.update``."""

    def __init__(self, of: Callable):
        self.of = of

    def compute(self, params, model, iteration, train, valid):
        return bool(self.of(params, model, iteration, train, valid))
