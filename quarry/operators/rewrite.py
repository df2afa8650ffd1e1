"""Deterministic rewriting rules for synthetic pairs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RULES = {"the": "said", "and": "as well as", "with": "accompanied by", "for": "on behalf of"}


def coin(id_col: str, rule: str, probability: float) -> Column:
    """Whether a rule applies to a row: the same on every run."""
    part = F.conv(F.substring(F.md5(F.concat_ws("|", F.col(id_col).cast("string"), F.lit(rule))), 1, 6), 16, 10).cast("double") / F.lit(16777216.0)
    return part < probability


def replace_terms(text: Column, id_col: str, rules: dict[str, str] = RULES, probability: float = 0.5) -> Column:
    for old, new in rules.items():
        text = F.when(coin(id_col, old, probability), F.regexp_replace(text, f"(?i)(^|[ \n]){old}($|[ \n])", f"$1{new}$2")).otherwise(text)
    return text


def with_intervals(text: Column, spread: int = 5) -> Column:
    """Whole percentages get an interval of plus and minus ``spread``, cut to 0 and 100."""
    parts = F.split(text, "(?<=%)")
    number = lambda p: F.regexp_extract(p, "(\\d{1,3})%$", 1).try_cast("int")
    return F.array_join(F.transform(parts, lambda p: F.when(number(p).isNull(), p).otherwise(F.format_string("%s (95%% CI %d-%d)", p, F.greatest(F.lit(0), number(p) - spread), F.least(F.lit(100), number(p) + spread)))), "")


def with_method_sentences(text: Column, sentence: str = "Methods were standard.", least: int = 100, each: int = 40) -> Column:
    n = lambda t: F.regexp_count(t, F.lit("\\S+"))
    longer = F.array_join(F.transform(F.split(text, "\n\n"), lambda p: F.when(n(p) >= each, F.concat(p, F.lit(" " + sentence))).otherwise(p)), "\n\n")
    return F.when(n(text) >= least, longer).otherwise(text)


def with_intros(text: Column, intro: str = "In addition, ", every: int = 4) -> Column:
    s = F.split(text, "(?<=[.!?])\\s+")
    return F.array_join(F.transform(s, lambda x, i: F.when((i + 1) % every == 0, F.concat(F.lit(intro), x)).otherwise(x)), " ")


def complexified(text: Column, id_col: str, level: float = 0.5) -> Column:
    return with_method_sentences(with_intervals(with_intros(replace_terms(text, id_col, probability=level))))
