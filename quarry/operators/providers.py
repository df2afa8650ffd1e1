"""Seams for models: each has an offline default that is deterministic."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_PROFILES = {"en": "the of and to in is that for it with", "fr": "le la les de et des un une est que", "de": "der die das und ist nicht ein eine zu mit", "es": "el la los las de y que en un una"}


def detect_language(text: Column | str) -> Column:
    """The language whose most frequent words are most of the first thousand characters; "unknown" without any."""
    from quarry.functions.text import words

    w = F.transform(words(F.substring(text, 1, 1000)), F.lower)
    known = {k: F.array(*map(F.lit, p.split())) for k, p in _PROFILES.items()}
    share = lambda a: F.size(F.filter(w, lambda x: F.array_contains(a, x)))
    hits = [F.struct(share(a).alias("n"), F.lit(k).alias("lang")) for k, a in known.items()]
    best = F.array_max(F.array(*hits))
    return F.when(best["n"] > 0, best["lang"]).otherwise("unknown")


def per_batch(df: DataFrame, text: str, out: str, kind: str, load: Callable[[], Callable[[list], list]]) -> DataFrame:
    """``df`` with a model's output; the model is loaded once in each worker, null texts aren't sent."""

    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for s in batches:
            given = s.dropna()
            made = pd.Series(model(given.tolist()), index=given.index, dtype=object)
            yield made.reindex(s.index).where(s.notna(), None)

    return df.withColumn(out, run.asNondeterministic()(F.col(text)))


def extract_summary() -> Callable[[list], list]:
    """Default generator: the first three sentences."""
    import re

    return lambda texts: [" ".join(re.split(r"(?<=[.!?])\s+", t)[:3]) for t in texts]


def generate(df: DataFrame, text: str, out: str = "generated", load=extract_summary, prompt: str = "") -> DataFrame:
    return per_batch(df.withColumn("_prompted", F.concat(F.lit(prompt), F.col(text))), "_prompted", out, "string", load).drop("_prompted")


def hashed_vectors(tokens: list[str], size: int = 64) -> np.ndarray:
    """Default embedder: a fixed random direction for each token."""
    import zlib

    return np.stack([np.random.default_rng(zlib.crc32(t.encode())).standard_normal(size) for t in tokens]) if tokens else np.zeros((0, size))


def greedy_match(pred: Column, ref: Column, embed: Callable[[list[str]], np.ndarray] = hashed_vectors) -> Column:
    """F of greedy cosine matching of token arrays."""

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b, strict=True):
            if x is None or y is None or not len(x) or not len(y):
                out.append(0.0)
                continue
            u, v = (m / np.linalg.norm(m, axis=1, keepdims=True) for m in (embed(list(x)), embed(list(y))))
            s = u @ v.T
            p, r = s.max(axis=1).mean(), s.max(axis=0).mean()
            out.append(float(2 * p * r / (p + r)) if p + r > 0 else 0.0)
        return pd.Series(out)

    return run(pred, ref)


def with_retries(call: Callable, attempts: int = 3, wait: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> Callable:
    """``call`` again after 1, 2, 4 ... times ``wait`` seconds on an error; the last error is raised."""

    def run(*args):
        for k in range(attempts):
            try:
                return call(*args)
            except Exception:
                if k == attempts - 1:
                    raise
                sleep(wait * 2**k)

    return run


class RateLimit:
    """At most so many units in any window of seconds."""

    def __init__(self, units: int, seconds: float = 60.0, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.units, self.seconds, self.clock, self.sleep, self.used = units, seconds, clock, sleep, []

    def take(self, n: int = 1) -> None:
        while True:
            now = self.clock()
            self.used = [(t, k) for t, k in self.used if now - t < self.seconds]
            if not self.used or sum(k for _, k in self.used) + n <= self.units:
                self.used.append((now, n))
                return
            self.sleep(max(0.0, self.seconds - (now - self.used[0][0])))
