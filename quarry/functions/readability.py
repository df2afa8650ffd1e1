"""Readability formulas over whitespace words, sentence parts and a vowel-group syllable rule."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.text import sentences, words

#: Everyday words for the share of unfamiliar ones; a caller may pass a full list.
FAMILIAR = "the of and to a in is it you that he was for on are with as i his they be at one have this from or had by but some what there we can out other were all your when up use word how said an each she".split()


def syllables(word: Column) -> Column:
    """Vowel groups less a silent final e, at least 1."""
    w = F.lower(word)
    return F.greatest(F.lit(1), F.regexp_count(w, F.lit("[aeiouy]+")) - F.when(w.rlike("[^aeiouy]e[^a-z]*$"), 1).otherwise(0))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("bigint"), lambda a, x: a + x)


#: Words by syllables, as patterns over lower-case text that go over it once, without backtracking: vowel groups but
#: for silent ones, words with such a group (the rest has one syllable all the same), words of three and more.
_HEARD = "[aiouy]|e(?![^a-z\\s]*+(?!\\S))"
_GROUPS, _VOICED = f"(?:{_HEARD}|(?<!\\S)e)[aeiouy]*+", f"(?:{_HEARD}|(?<!\\S)e)\\S*+"
_THREE = f"[aeiouy](?<![aeiouy]{{2}})[aeiouy]*+[^aeiouy\\s]++[aeiouy]++[^aeiouy\\s]++(?:{_HEARD})\\S*+"


def letters(text: Column) -> Column:
    """Characters that aren't white space."""
    for space in " \n\t\r\f\v":
        text = F.replace(text, F.lit(space), F.lit(""))
    return F.length(text)


def counts(df, text: str = "text", first_words: int | None = None, keep_words: bool = False):
    """``df`` with counts that the formulas share: n_words, n_sentences, n_syllables, n_letters, n_complex, n_long, and _w if words are kept.

    Counted by patterns over the whole text, so that no array of words is made; first_words bounds the words whose syllables count.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    of = lambda x, pattern: F.regexp_count(x, F.lit(pattern)).cast("bigint")
    base = df.withColumns({"_low": F.lower(F.array_join(F.slice(words(text), 1, first_words), " ") if first_words else t), **({"_w": words(text)} if keep_words else {})})
    low = F.col("_low")
    made = base.withColumns({
        "n_words": of(t, "\\S++"), "n_sentences": F.greatest(F.lit(1).cast("bigint"), of(t, "[^\\s.!?][^.!?]*+")),
        "n_syllables": of(low, _GROUPS) - of(low, _VOICED), "n_letters": letters(t).cast("bigint"),
        "n_complex": of(low, _THREE), "n_long": of(t, "\\S{11,}+"),
    })
    return made.withColumn("n_syllables", F.col("n_syllables") + (of(low, "\\S++") if first_words else F.col("n_words"))).drop("_low")


def _per(a: Column | str, b: Column | str) -> Column:
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b)


def flesch() -> Column:
    return F.when(F.col("n_words") == 0, F.lit(0.0)).otherwise(F.lit(206.835) - F.lit(1.015) * _per("n_words", "n_sentences") - F.lit(84.6) * _per("n_syllables", "n_words"))


def kincaid() -> Column:
    return F.when(F.col("n_words") == 0, F.lit(0.0)).otherwise(F.lit(0.39) * _per("n_words", "n_sentences") + F.lit(11.8) * _per("n_syllables", "n_words") - F.lit(15.59))


def fog() -> Column:
    return F.lit(0.4) * (_per("n_words", "n_sentences") + F.lit(100.0) * _per("n_complex", "n_words"))


def ari() -> Column:
    return F.lit(4.71) * _per("n_letters", "n_words") + F.lit(0.5) * _per("n_words", "n_sentences") - F.lit(21.43)


def coleman_liau() -> Column:
    return F.lit(0.0588) * (F.lit(100.0) * _per("n_letters", "n_words")) - F.lit(0.296) * (F.lit(100.0) * _per("n_sentences", "n_words")) - F.lit(15.8)


def smog() -> Column:
    return F.lit(1.043) * F.sqrt(F.lit(30.0) * _per("n_complex", "n_sentences")) + F.lit(3.1291)


def linsear() -> Column:
    x = _per(F.col("n_words") + F.lit(2) * F.col("n_complex"), "n_sentences")
    return F.when(x > 20, x / 2).otherwise(x / 2 - 1)


def dale_chall(familiar: list[str] = FAMILIAR) -> Column:
    known = F.array(*map(F.lit, familiar))
    hard = F.size(F.filter("_w", lambda w: ~F.array_contains(known, F.regexp_replace(F.lower(w), "[^a-z]", ""))))
    share = F.lit(100.0) * _per(hard.cast("bigint"), "n_words")
    score = F.lit(0.1579) * share + F.lit(0.0496) * _per("n_words", "n_sentences")
    return F.when(share > 5, score + F.lit(3.6365)).otherwise(score)


def word_length() -> Column:
    return _per("n_letters", "n_words")


def battery(df, text: str = "text"):
    """``df`` with all formulas."""
    made = {"flesch": flesch(), "kincaid": kincaid(), "fog": fog(), "ari": ari(), "coleman_liau": coleman_liau(), "smog": smog(), "linsear": linsear(), "dale_chall": dale_chall()}
    return counts(df, text, keep_words=True).select(*df.columns, *[v.alias(k) for k, v in made.items()])
