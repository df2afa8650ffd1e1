"""Quality rules: gradient-boosted trees over document statistics.

Statistics come from arrays over the bytes and words of many documents at once. The trees
are grown here on a bounded sample of labelled rows, with monotonic constraints on chosen
statistics, flattened into node arrays, and applied to whole batches level by level.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import added, column, spare, table, texts_of
from quarry.llm.text import chunks, joined, words

#: Statistics and the direction in which each may move the score: 1 up, -1 down, 0 free.
STATISTICS = {
    "log_chars": 0, "log_words": 0, "symbol_share": -1, "marker_share": -1, "upper_share": -1, "digit_share": -1,
    "word_length": 0, "long_words": 0, "distinct_words": 0, "stop_words": 1, "stops_per_word": 0, "words_per_line": 0,
    "repeated_lines": -1, "repeated_runs": -1,
}
#: Production parameters: labelled rows used at most, the cut, and the shape of the model.
SAMPLE_ROWS, THRESHOLD = 20_000, 0.25
TREES, DEPTH, RATE, BINS, LEAST, PENALTY = 60, 4, 0.2, 64, 10, 1.0
_STOP = """a about all an and are as at be been but by can for from had has have he her his i if in into is it its more no not of on one or our out she so some than that the their them then there they this to up was we were what when which who will with would you your
au aux avec ce ces dans de des du elle en est et il ils je la le les leur mais ne nous on ou par pas plus pour que qui sa se ses son sur un une vous
aber als am auch auf aus bei das dass dem den der des die durch ein eine einen einer es für hat ich im ist mit nach nicht noch nur oder sich sie sind so über um und von vor war wie wir zu zum zur
al como con del el ella en era es esta este ha la las lo los más mi muy no nos o para pero por que se ser si sin sobre su sus también un una y ya"""


def _class(signs: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[np.frombuffer(signs, np.uint8)] = True
    return out


_LOWER, _UPPER, _DIGIT = _class(bytes(range(97, 123))), _class(bytes(range(65, 91))), _class(b"0123456789")
_SYMBOL = _class(bytes(c for c in range(33, 127) if not chr(c).isalnum()))
_MARKER, _STOPS = _class(b"#$%&*|!<>{}[]\\^~_=+@"), _class(b".!?")
_STOP_WORDS = np.unique(words([_STOP])[0])


def statistics(texts: list[str]) -> np.ndarray:
    """A row of STATISTICS for each text; an empty text has zeros."""
    out = np.zeros((len(texts), len(STATISTICS)), np.float32)
    for a, b in chunks(np.fromiter((len(t) for t in texts), np.int64, len(texts)), 1 << 18):
        out[a:b] = _statistics(texts[a:b])
    return out


def _statistics(texts: list[str]) -> np.ndarray:
    data, starts = joined(texts)

    def share(table_: np.ndarray) -> np.ndarray:
        return np.add.reduceat(table_[data], starts[:-1], dtype=np.int64) if len(texts) else np.zeros(0, np.int64)

    n = np.maximum(np.diff(starts) - 1, 1).astype(float)
    hashes, offsets, first, end = words(texts)
    count = np.diff(offsets)
    many = np.maximum(count, 1)
    owner = np.repeat(np.arange(len(texts)), count)

    def per(x: np.ndarray) -> np.ndarray:
        return np.bincount(owner, x, len(texts)) / many

    order = np.lexsort((hashes, owner))
    h, o = hashes[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    again = np.zeros(len(h))
    again[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    size = end - first
    lines = [t.split("\n") for t in texts]
    rows = np.array([len(x) for x in lines], float)
    alike = np.array([1 - len(set(x)) / len(x) for x in lines])
    upper = share(_UPPER)
    return np.stack([
        np.log1p(n), np.log1p(count), share(_SYMBOL) / n, share(_MARKER) / n, upper / np.maximum(upper + share(_LOWER), 1), share(_DIGIT) / n,
        per(np.minimum(size, 100)), per(size > 15), np.bincount(o, new, len(texts)) / many, per(np.isin(hashes, _STOP_WORDS)), share(_STOPS) / many, count / rows,
        alike, per(again),
    ], axis=1)


@dataclass
class Forest:
    """Node arrays of all trees: leaves point to themselves."""

    roots: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    base: float = 0.0
    depth: int = field(default=DEPTH)

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Sum of leaves for all rows and trees at once."""
        at = np.broadcast_to(self.roots, (len(x), len(self.roots)))
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.cut[at], self.left[at], self.right[at])
        return self.base + self.value[at].sum(axis=1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -40, 40)))


def grow(x: np.ndarray, y: np.ndarray, directions: list[int], trees: int = TREES, depth: int = DEPTH, rate: float = RATE) -> Forest:
    """Boosted trees for labels 0 and 1; with a single class, or no rows, a constant.

    Splits are chosen from histograms over quantile bins. A split on a constrained
    statistic must order its children that way, and their midpoint bounds everything below.
    """
    x = np.asarray(x, np.float32)
    mean = np.clip(y.mean(), 1e-3, 1 - 1e-3) if len(y) else 0.5
    base = float(np.log(mean / (1 - mean)))
    nodes: list[list] = []  # feature, cut, left, right, value
    roots: list[int] = []
    if len(y) and 0 < y.sum() < len(y):
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, f]) for f, e in enumerate(edges)])
        score = np.full(len(y), base)

        def build(rows: np.ndarray, level: int, low: float, high: float, g: np.ndarray, h: np.ndarray) -> int:
            value = lambda a, b: float(np.clip(-a / (b + PENALTY), low, high))
            at, total_g, total_h = len(nodes), g[rows].sum(), h[rows].sum()
            nodes.append([0, 0.0, at, at, rate * value(total_g, total_h)])
            best = (1e-6, None)
            if level < depth and len(rows) >= 2 * LEAST:
                for f, e in enumerate(edges):
                    if not len(e):
                        continue
                    b = binned[f, rows]
                    gl, hl = (np.cumsum(np.bincount(b, w[rows], len(e) + 1))[:-1] for w in (g, h))
                    nl = np.cumsum(np.bincount(b, minlength=len(e) + 1))[:-1]
                    gr, hr = total_g - gl, total_h - hl
                    vl, vr = (np.clip(-p / (q + PENALTY), low, high) for p, q in ((gl, hl), (gr, hr)))
                    gain = sum(-(p * v + 0.5 * (q + PENALTY) * v * v) for p, q, v in ((gl, hl, vl), (gr, hr, vr)))
                    v = value(total_g, total_h)
                    gain += total_g * v + 0.5 * (total_h + PENALTY) * v * v
                    gain[(nl < LEAST) | (len(rows) - nl < LEAST) | (directions[f] * (vr - vl) < 0)] = -np.inf
                    k = int(np.argmax(gain))
                    if gain[k] > best[0]:
                        best = (gain[k], (f, k, vl[k], vr[k]))
            if best[1]:
                f, k, vl, vr = best[1]
                middle, goes = (vl + vr) / 2, binned[f, rows] <= k
                bounds = {0: ((low, high), (low, high)), 1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}[directions[f]]
                nodes[at][0], nodes[at][1] = f, float(edges[f][k])
                nodes[at][2] = build(rows[goes], level + 1, *bounds[0], g, h)
                nodes[at][3] = build(rows[~goes], level + 1, *bounds[1], g, h)
            return at

        for _ in range(trees):
            p = 1 / (1 + np.exp(-score))
            roots.append(build(np.arange(len(y)), 0, -np.inf, np.inf, p - y, p * (1 - p)))
            part = _forest(nodes, roots[-1:], 0.0, depth)
            score = score + part.raw(x)
    return _forest(nodes, roots, base, depth)


def _forest(nodes: list[list], roots: list[int], base: float, depth: int) -> Forest:
    f, c, a, b, v = zip(*nodes, strict=True) if nodes else ((0,), (0.0,), (0,), (0,), (0.0,))
    return Forest(np.array(roots, np.int64), np.array(f), np.array(c, np.float32), np.array(a), np.array(b), np.array(v), base, depth)


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Forest:
    """A forest grown on at most ``sample_rows`` labelled documents, chosen by a hash of the id.

    Rows with a null id, text or label are left out; labels that contradict each other count
    as 0. Without labels of both classes the forest is a constant.
    """
    chosen = (
        labels.select(column(labels, id_col).alias("id"), column(labels, label_col).alias("y")).dropna().groupBy("id").agg(F.min("y").alias("y"))
        .orderBy(F.md5(F.col("id").cast("string")), "id").limit(sample_rows)
    )
    slim = docs.select(column(docs, id_col).alias("id"), column(docs, text_col).alias("text")).filter(F.col("text") > "")
    names = [(s, "float") for s in STATISTICS]
    # Broadcast: never more rows than the sample's bound.
    found = added(slim.join(F.broadcast(chosen), "id"), lambda batch: [*map(_arrow, statistics(texts_of(batch, "text")).T)], names, drop=["text"])
    rows = found.toPandas().sort_values(["id", *STATISTICS]).head(sample_rows)
    return grow(rows[list(STATISTICS)].to_numpy(np.float32), (rows["y"] > 0).to_numpy(float), list(STATISTICS.values()))


def _arrow(x: np.ndarray):
    import pyarrow as pa

    return pa.array(np.ascontiguousarray(x, np.float32))


def quality_scores(docs: DataFrame, forest: Forest, text_col: str = "text", score_col: str = "quality_score") -> DataFrame:
    """``docs`` with the forest's probability that each text is good; null and empty texts score 0."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        texts = texts.fillna("").tolist()
        return pd.Series(np.where([t != "" for t in texts], forest.scores(statistics(texts)), 0.0))

    return docs.withColumn(score_col, score.asNondeterministic()(column(docs, text_col)))


def quality_filter(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text", score_col: str | None = None) -> DataFrame:
    """The documents that the rules accept: those that score ``threshold`` or more.

    Null and empty texts score 0 and are rejected by any threshold above 0. Null ids are
    scored like others. Repeated rows get one and the same decision. Empty tables give empty
    tables; without labels of both classes all other texts get the same score, that of the
    labels' mean (0.5 with none). Other columns are kept; score_col adds the score, in place
    of a column of that name.
    """
    forest = train(docs, labels, sample_rows, id_col, text_col)
    (name,) = [score_col] if score_col else spare(docs, "score")
    out = quality_scores(docs, forest, text_col, name).filter(F.col(name) >= threshold)
    return out if score_col else out.drop(name)


def op9_quality(spark, sf_dir):
    """Ids and scores of all documents that the quality rules accept."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_filter(docs, table(spark, sf_dir, "labels"), score_col="quality_score").drop("text")


QUERIES = {"op9_quality": op9_quality}
ORACLE: dict[str, str] = {}
