"""Search of a model's parameters: a space, an objective as the median of runs, asking and telling, trials that are saved and replayed."""

from __future__ import annotations

import json
import math
import random
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path
from statistics import median

#: Runs a dimension of the space.
RUNS_A_DIMENSION = 15


@dataclass(frozen=True)
class Dimension:
    kind: str
    low: float = 0.0
    high: float = 0.0
    values: tuple = ()

    def __post_init__(self):
        if self.kind not in ("integer", "real", "categorical"):
            raise ValueError(f"unknown kind {self.kind!r}")
        if self.kind == "categorical" and not self.values or self.kind != "categorical" and not self.low <= self.high:
            raise ValueError("a dimension is empty")

    def at(self, share: float):
        if self.kind == "categorical":
            return self.values[min(len(self.values) - 1, int(share * len(self.values)))]
        x = self.low + share * (self.high - self.low)
        return min(int(self.high), int(self.low + share * (self.high - self.low + 1))) if self.kind == "integer" else x

    def place(self, value) -> float:
        if self.kind == "categorical":
            return (self.values.index(value) + 0.5) / len(self.values)
        return (value - self.low) / (self.high - self.low) if self.high > self.low else 0.5


#: The space without a configuration.
DEFAULT = {"reduce__n_components": Dimension("integer", 2, 10), "cluster__n_topics": Dimension("integer", 2, 50), "cluster__min_cluster_size": Dimension("integer", 50, 500), "cluster__outlier_share": Dimension("real", 0.0, 0.3), "words__min_df": Dimension("real", 0.001, 0.01), "words__top_n_words": Dimension("integer", 10, 40)}


def space_of(config: dict) -> dict[str, Dimension]:
    """A space from {name: {type, min, max} or {type, values}}; words__min_df is added where it isn't there. Lists among values become tuples, 'true' and 'false' booleans."""
    plain = lambda v: tuple(v) if isinstance(v, list) else {"true": True, "false": False}.get(v.lower(), v) if isinstance(v, str) else v
    out = {k: Dimension(p["type"], p.get("min", 0), p.get("max", 0), tuple(map(plain, p.get("values", ())))) for k, p in config.items()}
    return {"words__min_df": DEFAULT["words__min_df"]} | out


def number_of_runs(space: dict) -> int:
    return RUNS_A_DIMENSION * len(space)


ACQUISITIONS = ("LCB", "EI", "PI")


@dataclass
class Search:
    """Asks for parameters and is told their scores; smaller is better unless `maximize`.

    The first `initial` points are spread at random; later ones are the best of many candidates by an acquisition over a Gaussian-kernel regression of the scores so far.
    Trials are kept in a JSON file; a search with the same file and space goes on after them.
    """

    space: dict[str, Dimension]
    maximize: bool = True
    initial: int = 5
    acquisition: str = "EI"
    path: str | None = None
    seed: int = 42
    trials: list[dict] = field(default_factory=list)

    def __post_init__(self):
        if not self.space:
            raise ValueError("the space is empty")
        if self.acquisition not in ACQUISITIONS:
            raise ValueError(f"acquisition must be one of {', '.join(ACQUISITIONS)}")
        if self.initial < 1:
            raise ValueError("initial must be at least 1")
        if self.path and Path(self.path).exists():
            saved = json.loads(Path(self.path).read_text())
            if sorted(saved["space"]) != sorted(self.space):
                raise ValueError("the saved trials are of another space")
            fixed = {k: {str(v): v for v in d.values} for k, d in self.space.items() if d.kind == "categorical"}
            self.trials = [t | {"parameters": {k: fixed[k].get(str(v if not isinstance(v, list) else tuple(v)), v) if k in fixed else v for k, v in t["parameters"].items()}} for t in saved["trials"]]

    def _guess(self, x: list[float]) -> tuple[float, float]:
        """Mean and deviation of the score at a point, by a kernel over the trials."""
        score = [t["objective"] for t in self.trials]
        weights = [math.exp(-sum((a - b) ** 2 for a, b in zip(x, t["at"])) / 0.08) + 1e-12 for t in self.trials]
        total = sum(weights)
        mean = sum(w * s for w, s in zip(weights, score)) / total
        spread = math.sqrt(sum(w * (s - mean) ** 2 for w, s in zip(weights, score)) / total)
        return mean, spread + (max(score) - min(score) + 1e-9) / (1 + total)

    def _worth(self, x: list[float]) -> float:
        mean, dev = self._guess(x)
        if self.acquisition == "LCB":
            return 1.96 * dev - mean
        gain = min(t["objective"] for t in self.trials) - mean
        z = gain / dev
        below = 0.5 * math.erfc(-z / math.sqrt(2))
        return below if self.acquisition == "PI" else gain * below + dev * math.exp(-z * z / 2) / math.sqrt(2 * math.pi)

    def ask(self) -> dict:
        draw = random.Random(f"{self.seed}-{len(self.trials)}")
        point = lambda: [draw.random() for _ in self.space]
        x = point() if len(self.trials) < self.initial else max((point() for _ in range(500)), key=self._worth)
        return {k: d.at(s) for (k, d), s in zip(self.space.items(), x)}

    def tell(self, parameters: dict, scores: list[float]) -> float:
        """The score of parameters is the median of their runs."""
        value = median(scores)
        at = [d.place(parameters[k]) for k, d in self.space.items()]
        self.trials.append({"parameters": parameters, "scores": scores, "score": value, "objective": -value if self.maximize else value, "at": at})
        if self.path:
            Path(self.path).parent.mkdir(parents=True, exist_ok=True)
            Path(self.path).write_text(json.dumps({"space": sorted(self.space), "trials": self.trials}))
        return value

    def best(self) -> dict:
        return min(self.trials, key=lambda t: t["objective"])

    def run(self, score: Callable[[dict], float], calls: int | None = None, runs: int = 1, patience: int | None = None) -> dict:
        """Asks and tells until there are `calls` trials (15 a dimension), or `patience` of them in a row brought nothing better."""
        calls = calls or number_of_runs(self.space)
        while len(self.trials) < calls:
            parameters = self.ask()
            self.tell(parameters, [score(parameters) for _ in range(runs)])
            objectives = [t["objective"] for t in self.trials]
            if patience and len(objectives) - 1 - objectives.index(min(objectives)) >= patience:
                break
        return self.best()
