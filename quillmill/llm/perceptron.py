"""An averaged perceptron over string features, trained on the driver from a bounded sample."""

from __future__ import annotations

import random
from collections import defaultdict
from collections.abc import Iterable


class Perceptron:
    """Scores labels; `allowed` restricts the labels of an example."""

    def __init__(self) -> None:
        self.weights: dict[tuple[str, str], float] = {}

    def score(self, features: Iterable[str], label: str) -> float:
        w = self.weights
        return sum(w.get((f, label), 0.0) for f in features)

    def best(self, features: list[str], allowed: Iterable[str]) -> str:
        return max(allowed, key=lambda a: (self.score(features, a), a))

    def train(self, examples: list[tuple[list[str], str, list[str]]], epochs: int = 5, seed: int = 7) -> Perceptron:
        """Examples are (features, true label, allowed labels). Weights are averaged over all steps."""
        w: dict[tuple[str, str], float] = defaultdict(float)
        total: dict[tuple[str, str], float] = defaultdict(float)
        at: dict[tuple[str, str], int] = defaultdict(int)
        rng, step, order = random.Random(seed), 0, list(range(len(examples)))
        for _ in range(epochs):
            rng.shuffle(order)
            for k in order:
                features, true, allowed = examples[k]
                step += 1
                guess = max(allowed, key=lambda a: (sum(w.get((f, a), 0.0) for f in features), a))
                if guess != true:
                    for label, by in ((true, 1.0), (guess, -1.0)):
                        for f in features:
                            key = (f, label)
                            total[key] += (step - at[key]) * w[key]
                            at[key] = step
                            w[key] += by
        self.weights = {k: (total[k] + (step - at[k]) * v) / max(1, step) for k, v in w.items()}
        return self
