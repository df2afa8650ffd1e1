"""Parameters of training and chunking: lookup by model, and checks at plan time."""

from __future__ import annotations

from dataclasses import dataclass

#: Context and most tokens of source and target by model.
MODELS = {
    "t5-base": (512, 400, 256), "t5-large": (512, 400, 256), "bart-base": (1024, 900, 256), "llama-2-1b": (2048, 1900, 256), "qwen-2.5-0.5b": (32000, 31900, 256),
}
FALLBACK = "t5-base"


@dataclass(frozen=True)
class Limits:
    context: int
    source: int
    target: int


def limits_of(model: str | None = None) -> Limits:
    """The limits of a model, those of the fallback for an unknown one."""
    return Limits(*MODELS.get(model or FALLBACK, MODELS[FALLBACK]))


def problems(most_source: int = 512, most_target: int = 256, chunk: int = 400, overlap: int = 50, epochs: int = 5, batch: int = 16, rate: float = 3e-4, train: float = 0.8, dev: float = 0.1) -> list[str]:
    """What is wrong with a set of parameters; empty if nothing is."""
    checks = {
        "source length must lie in 1 to 1024": 1 <= most_source <= 1024, "target length must lie in 1 to 512": 1 <= most_target <= 512, "a chunk can't exceed the source length": chunk <= most_source,
        "the overlap must be less than a chunk": overlap < chunk, "at least one epoch is needed": epochs >= 1, "at least one row a batch is needed": batch >= 1, "the rate must be positive": rate > 0,
        "the share of training must lie between 0 and 1": 0 < train < 1, "the share of development must lie between 0 and 1": 0 < dev < 1, "shares must leave something to test": train + dev < 1,
    }
    return [k for k, fine in checks.items() if not fine]


def checked(**parameters) -> dict:
    """The parameters, or ValueError with all that is wrong."""
    found = problems(**parameters)
    if found:
        raise ValueError("; ".join(found))
    return parameters
