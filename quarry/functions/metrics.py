"""Metrics of a source, a prediction and a reference, over lower-case whitespace words."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from quarry.functions.lexical import _share
from quarry.functions.text import let, ngrams, words


def tokens(text: Column | str) -> Column:
    return F.transform(words(text), F.lower)


def grams_shared(a: Column, b: Column) -> Column:
    """Size of the intersection of two multisets."""
    least = lambda t, k: F.least(F.size(F.filter(t["a"], lambda x: x == k)), F.size(F.filter(t["b"], lambda x: x == k)))
    each = let(F.struct(a.alias("a"), b.alias("b")), lambda t: F.transform(F.array_intersect(t["a"], t["b"]), lambda k: least(t, k)))
    return F.aggregate(each, F.lit(0), lambda s, x: s + x)


def f_score(p: Column, r: Column) -> Column:
    return F.when(p + r == 0, F.lit(0.0)).otherwise(F.lit(2.0) * p * r / (p + r))


def rouge_n(pred: Column, ref: Column, n: int) -> tuple[Column, Column, Column]:
    """Precision, recall and F without a stemmer, of token arrays."""
    a, b = ngrams(pred, n), ngrams(ref, n)
    shared = grams_shared(a, b)
    p, r = _share(shared, F.size(a)), _share(shared, F.size(b))
    return p, r, f_score(p, r)


def _common(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Last row of the table of longest common subsequences, computed row by row in numpy."""
    row = np.zeros(len(y) + 1, np.int32)
    for v in x:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + (y == v)))
    return row


def _codes(a, b) -> tuple[np.ndarray, np.ndarray]:
    _, codes = np.unique(np.concatenate([np.asarray(a, object), np.asarray(b, object)]).astype(str), return_inverse=True)
    return codes[: len(a)], codes[len(a) :]


@F.pandas_udf(DoubleType())
def rouge_l(pred: pd.Series, ref: pd.Series) -> pd.Series:
    """F of the longest common subsequence of two token arrays."""
    out = []
    for a, b in zip(pred, ref, strict=True):
        if a is None or b is None or not len(a) or not len(b):
            out.append(0.0)
            continue
        out.append(2.0 * int(_common(*_codes(a, b))[-1]) / (len(a) + len(b)))
    return pd.Series(out)


def union_hits(ref: np.ndarray, preds: list[np.ndarray]) -> set[int]:
    """Places of a reference sentence that lie on a longest common subsequence with any predicted one."""
    found: set[int] = set()
    for y in preds:
        table = np.zeros((len(ref) + 1, len(y) + 1), np.int32)
        for i, v in enumerate(ref):
            table[i + 1, 1:] = np.maximum.accumulate(np.maximum(table[i, 1:], table[i, :-1] + (y == v)))
        i, j = len(ref), len(y)
        while i and j:
            if ref[i - 1] == y[j - 1]:
                found.add(i - 1)
                i, j = i - 1, j - 1
            elif table[i, j - 1] > table[i - 1, j]:
                j -= 1
            else:
                i -= 1
    return found


@F.pandas_udf(DoubleType())
def rouge_lsum(pred: pd.Series, ref: pd.Series) -> pd.Series:
    """F over sentences (arrays of token arrays): words of the reference that are in common with any predicted sentence, each used as often as it occurs."""
    from collections import Counter

    out = []
    for a, b in zip(pred, ref, strict=True):
        a, b = [list(s) for s in (a if a is not None else [])], [list(s) for s in (b if b is not None else [])]
        n, m = sum(map(len, a)), sum(map(len, b))
        if not n or not m:
            out.append(0.0)
            continue
        codes = {w: k for k, w in enumerate({w for s in a + b for w in s})}
        x, y = ([np.array([codes[w] for w in s], np.int64) for s in side] for side in (a, b))
        left, own, hits = Counter(w for s in x for w in s.tolist()), Counter(w for s in y for w in s.tolist()), 0
        for s in y:
            for k in sorted(union_hits(s, x)):
                w = int(s[k])
                if left[w] > 0 and own[w] > 0:
                    hits, left[w], own[w] = hits + 1, left[w] - 1, own[w] - 1
        p, r = hits / n, hits / m
        out.append(2 * p * r / (p + r) if p + r else 0.0)
    return pd.Series(out)


#: Endings that ``stemmed`` takes off, in steps; each needs a vowel before it.
_STEPS = (("sses$", "ss"), ("ies$", "i"), ("([^s])s$", "$1"), ("([aeiouy].*?)(?:ed|ing)$", "$1"), ("([bdfgmnprt])\\1$", "$1"), ("([aeiouy].*[^aeiouy])y$", "$1i"), ("([aeiouy].*)(?:ational|ation|ator)$", "$1ate"), ("([aeiouy].*)(?:ness|ment|ful|ly)$", "$1"), ("([aeiouy].*)e$", "$1"))


def stemmed(token_array: Column, longer_than: int = 3) -> Column:
    """Light suffix stripping of words longer than so many letters; a stemmer of one's own is any Column function of the same kind."""

    def one(w: Column) -> Column:
        x = w
        for pattern, by in _STEPS:
            x = F.regexp_replace(x, pattern, by)
        return F.when(F.length(w) > longer_than, x).otherwise(w)

    return F.transform(token_array, one)


def alnum_tokens(text: Column | str) -> Column:
    """Runs of lower-case letters and digits, as ROUGE counts them."""
    return F.filter(F.split(F.lower(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))), "[^a-z0-9]+"), lambda w: w != "")


def retention(source: Column | str, made: Column | str) -> dict[str, Column]:
    """ROUGE F of a summary against its source, null where either is, and bands: high from 0.5, medium from 0.3, low."""
    s, p = (F.col(x) if isinstance(x, str) else x for x in (source, made))
    a, b = stemmed(alnum_tokens(s)), stemmed(alnum_tokens(p))
    there = s.isNotNull() & p.isNotNull()
    out = {"rouge1": F.when(there, rouge_n(b, a, 1)[2]), "rouge2": F.when(there, rouge_n(b, a, 2)[2]), "rouge_l": F.when(there, rouge_l(b, a))}
    return out


def retention_band(rouge1: Column) -> Column:
    return F.when(rouge1 >= 0.5, "high").when(rouge1 >= 0.3, "medium").when(rouge1.isNotNull(), "low")


def brevity(pred: Column, ref: Column) -> Column:
    n, m = F.size(pred).cast("double"), F.size(ref).cast("double")
    return F.when(n == 0, F.lit(0.0)).when(n > m, F.lit(1.0)).otherwise(F.exp(F.lit(1.0) - m / n))


def _sum(parts: list[Column]) -> Column:
    total = parts[0]
    for x in parts[1:]:
        total = total + x
    return total


def bleu(pred: Column, ref: Column, most: int = 4, weight: float | None = None) -> Column:
    """Sentence BLEU with equal weights (or the one given for each order); an order without a hit counts as 0.1 of one, no hit of any word as 0."""
    logs, any_hit = [], None
    for n in range(1, most + 1):
        a = ngrams(pred, n)
        hits = grams_shared(a, ngrams(ref, n))
        any_hit = hits > 0 if n == 1 else any_hit
        logs.append(F.lit(weight or 1.0 / most) * F.ln(F.when(hits == 0, F.lit(0.1)).otherwise(hits.cast("double")) / F.greatest(F.size(a), F.lit(1))))
    return F.when(any_hit, brevity(pred, ref) * F.exp(_sum(logs))).otherwise(F.lit(0.0))


def bleu_family(pred: Column, ref: Column) -> dict[str, Column]:
    """BLEU-1 to BLEU-4; the weights of BLEU-3 are 0.33 each."""
    return {"bleu1": bleu(pred, ref, 1), "bleu2": bleu(pred, ref, 2), "bleu3": bleu(pred, ref, 3, 0.33), "bleu4": bleu(pred, ref, 4)}


def gram_counts(pred: Column, ref: Column, most: int = 4) -> Column:
    """Arrays of hits and of n-grams of the prediction by order, and both lengths: what BLEU over rows or a corpus needs."""
    hits = [grams_shared(ngrams(pred, n), ngrams(ref, n)).cast("bigint") for n in range(1, most + 1)]
    totals = [F.greatest(F.size(pred) - (n - 1), F.lit(0)).cast("bigint") for n in range(1, most + 1)]
    return F.struct(F.array(*hits).alias("hits"), F.array(*totals).alias("totals"), F.size(pred).cast("bigint").alias("pred_size"), F.size(ref).cast("bigint").alias("ref_size"))


def smoothed_bleu(counts: Column, most: int = 4, effective: bool = True) -> Column:
    """BLEU from 0 to 1 of ``gram_counts``: the k-th order without a hit counts as 1 / 2**k of one; effective: orders that the text is too short for don't count."""
    logs, orders, halves = [], [], F.lit(0)
    for n in range(most):
        hit, total = counts["hits"][n], counts["totals"][n]
        none = (hit == 0) & (total > 0)
        halves = halves + none.cast("int")
        value = F.when(total == 0, F.lit(0.0) if effective else F.lit(float("-inf"))).when(none, -F.ln(F.pow(F.lit(2.0), halves) * total)).otherwise(F.ln(hit.cast("double") / F.nullif(total, F.lit(0).cast("bigint"))))
        logs.append(value)
        orders.append((total > 0).cast("int") if effective else F.lit(1))
    n, m = counts["pred_size"].cast("double"), counts["ref_size"].cast("double")
    short = F.when(n == 0, F.lit(0.0)).when(n >= m, F.lit(1.0)).otherwise(F.exp(F.lit(1.0) - m / F.nullif(n, F.lit(0.0))))
    found = _sum([counts["hits"][k] for k in range(most)]) > 0
    return F.when(found, short * F.exp(_sum(logs) / F.greatest(F.lit(1), _sum(orders)))).otherwise(F.lit(0.0))


def corpus_bleu(df: DataFrame, pred: str, ref: str, most: int = 4) -> DataFrame:
    """One row: BLEU of a corpus from the sums of its rows' counts."""
    rows = df.select(gram_counts(F.col(pred), F.col(ref), most).alias("c"))
    sums = rows.agg(
        *[F.sum(F.col("c.hits")[k]).alias(f"h{k}") for k in range(most)], *[F.sum(F.col("c.totals")[k]).alias(f"t{k}") for k in range(most)], F.sum("c.pred_size").alias("n"), F.sum("c.ref_size").alias("m"),
    )
    whole = F.struct(F.array(*[f"h{k}" for k in range(most)]).alias("hits"), F.array(*[f"t{k}" for k in range(most)]).alias("totals"), F.col("n").alias("pred_size"), F.col("m").alias("ref_size"))
    return sums.select(whole.alias("c")).select(smoothed_bleu(F.col("c"), most, effective=False).alias("bleu"), F.col("c.pred_size").alias("pred_size"), F.col("c.ref_size").alias("ref_size"))


def sari_set(src: Column, pred: Column, ref: Column) -> dict[str, Column]:
    s, p, r = (F.array_distinct(x) for x in (src, pred, ref))
    both = F.array_intersect(s, r)
    keep = _share(F.size(F.array_intersect(both, p)), F.size(both))
    new = F.array_except(r, s)
    add = _share(F.size(F.array_intersect(new, p)), F.size(new))
    old = F.array_except(s, r)
    delete = _share(F.size(F.array_except(old, p)), F.size(old))
    return {"sari_keep": keep, "sari_add": add, "sari_delete": delete, "sari": (keep + add + delete) / F.lit(3.0)}


def sari_simple(src: Column, pred: Column, ref: Column) -> Column:
    s, p, r = (F.array_distinct(x) for x in (src, pred, ref))
    keep = _share(F.size(F.array_intersect(F.array_intersect(s, p), r)), F.size(p))
    add = _share(F.size(F.array_except(F.array_intersect(p, r), s)), F.size(p))
    delete = _share(F.size(F.array_intersect(F.array_except(s, p), r)), F.size(s))
    return (keep + add + delete) / F.lit(3.0)


def sari_ngram(src: Column, pred: Column, ref: Column, most: int = 4) -> Column:
    """Multiset variant: keep over the prediction's, add over the prediction's, delete over the source's n-grams; means over n and operations."""
    total = F.lit(0.0)
    for n in range(1, most + 1):
        s, p, r = ngrams(src, n), ngrams(pred, n), ngrams(ref, n)
        fresh = let(F.struct(p.alias("p"), s.alias("s")), lambda t: F.filter(t["p"], lambda g: ~F.array_contains(t["s"], g)))
        gone = let(F.struct(p.alias("p"), s.alias("s"), r.alias("r")), lambda t: F.filter(t["s"], lambda g: ~F.array_contains(t["p"], g) & ~F.array_contains(t["r"], g)))
        total = total + (_share(grams_shared(p, s), F.size(p)) + _share(grams_shared(fresh, r), F.size(p)) + _share(F.size(gone), F.size(s))) / F.lit(3.0)
    return total / F.lit(float(most))


def set_f1(pred: Column, ref: Column) -> Column:
    p, r = F.array_distinct(pred), F.array_distinct(ref)
    shared = F.size(F.array_intersect(p, r))
    return f_score(_share(shared, F.size(p)), _share(shared, F.size(r)))


def label_overlap(pred: Column, ref: Column) -> Column:
    p, r = F.array_distinct(pred), F.array_distinct(ref)
    return _share(F.size(F.array_intersect(p, r)), F.size(r))


def factual(src: Column, pred: Column) -> Column:
    p = F.array_distinct(pred)
    return F.least(F.lit(1.0), F.lit(1.5) * _share(F.size(F.array_intersect(p, F.array_distinct(src))), F.size(p)))


def supported(source: Column, sentence: Column) -> Column:
    """Default judge: (entailed, neutral), the share of a sentence's distinct words that the source has, and the rest."""
    p = F.array_distinct(tokens(sentence))
    share = _share(F.size(F.array_intersect(p, F.array_distinct(tokens(source)))), F.size(p))
    return F.struct(share.alias("entailed"), (F.lit(1.0) - share).alias("neutral"))


def factuality(df: DataFrame, keys: list[str], source: str, pred: str, judge=supported, neutral: float = 0.3) -> DataFrame:
    """(keys, factuality): mean over a prediction's sentences of what the judge says, neutral counting in part.

    judge: a Column function of source and sentence, such as an Arrow UDF around a model.
    Sentences of up to ten characters don't count; without any the whole text does; of under
    five characters nothing does, which gives 0.
    """
    whole = F.trim(F.coalesce(F.col(pred), F.lit("")))
    parts = F.filter(F.transform(F.split(whole, "[.!?]+\\s+"), lambda s: F.trim(s)), lambda s: F.length(s) > 10)
    rows = df.select(*keys, F.col(source).alias("_s"), F.explode_outer(F.filter(F.when(F.size(parts) > 0, parts).otherwise(F.array(whole)), lambda s: F.length(s) >= 5)).alias("_h"))
    told = rows.withColumn("_j", F.when(F.col("_h").isNotNull(), judge(F.col("_s"), F.col("_h"))))
    return told.groupBy(*keys).agg(F.coalesce(F.avg(F.col("_j.entailed") + F.lit(neutral) * F.col("_j.neutral")), F.lit(0.0)).alias("factuality"))


#: Least values (or greatest, where negative) that a run should reach.
TARGETS = {"rouge_l": 0.35, "bleu": 0.30, "sari": 0.40, "bertscore_f1": 0.85, "flesch": 60.0}


def target_checks(means: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """``means`` with a boolean NAME_ok for each target whose measure it has."""
    wanted = TARGETS if targets is None else targets
    return means.withColumns({f"{k}_ok": F.col(k) >= v for k, v in wanted.items() if k in means.columns})


def corpus_means(evaluated: DataFrame, metrics: list[str]) -> DataFrame:
    """One row: how many rows there are, and the mean of each metric."""
    return evaluated.agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(m), 6).alias(m) for m in metrics])


def evaluate(df: DataFrame, source: str, pred: str, ref: str | None = None) -> DataFrame:
    """``df`` with all metrics; those that need a reference only if one is named."""
    from quarry.functions.readability import counts, flesch, kincaid
    from quarry.functions.text import compression

    out = counts(df.withColumns({"_s": tokens(source), "_p": tokens(pred)}), pred).withColumns({"flesch": flesch(), "kincaid": kincaid(), "compression": compression(source, pred), "factual": factual(F.col("_s"), F.col("_p"))})
    made = ["flesch", "kincaid", "compression", "factual"]
    if ref:
        s, p, r = F.col("_s"), F.col("_p"), F.col("_r")
        more = {"rouge1": rouge_n(p, r, 1)[2], "rouge2": rouge_n(p, r, 2)[2], "rouge_l": rouge_l(p, r), "bleu": bleu(p, r), "meteor": set_f1(p, r), "sari": sari_set(s, p, r)["sari"]}
        out = out.withColumn("_r", tokens(ref)).withColumns(more)
        made += more
    return out.select(*df.columns, *made)
