"""Column functions over text: normal forms, pieces, counts, prices, keys."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Prompts by name; the first is the default.
PROMPTS = {
    "standard": "simplify medical text into plain language: ",
    "concise": "simplify: ",
    "detailed": "translate this biomedical text into plain language for patients: ",
    "instruction": "Rewrite this medical text in plain language, avoiding jargon: ",
}
PROMPT = PROMPTS["standard"]


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, f) -> Column:
    """``f`` of a value that is computed once, also where lambda functions use it again and again."""
    return F.transform(F.array(value), f)[0]


def nfkc(text: Column | str) -> Column:
    """Unicode NFKC, for which Spark has no function; ASCII rows skip Python."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))

    t = _c(text)
    return F.coalesce(run(F.when(t.rlike("[^\\x00-\\x7F]"), t)), t)


def normalise(text: Column | str, compose: bool = True) -> Column:
    """None becomes "", line ends LF, three or more LF two; white space within lines one blank."""
    t = F.coalesce(_c(text), F.lit(""))
    t = nfkc(t) if compose else t
    t = F.regexp_replace(t, "\r\n?", "\n")
    t = F.regexp_replace(t, "\n{3,}", "\n\n")
    t = F.regexp_replace(t, "[^\\S\n]+", " ")
    t = F.regexp_replace(t, " ?\n ?", "\n")
    return F.regexp_replace(t, "^\\s+|\\s+$", "")


def words(text: Column | str) -> Column:
    """Parts between white space; none for null and empty text."""
    return F.filter(F.split(F.coalesce(_c(text), F.lit("")), "\\s+"), lambda w: w != "")


def word_count(text: Column | str) -> Column:
    return F.coalesce(F.regexp_count(_c(text), F.lit("\\S+")), F.lit(0)).cast("bigint")


def paragraphs(text: Column | str, least: int = 20, whole_if_none: bool = False) -> Column:
    """Parts between blank lines with at least so many words."""
    t = F.coalesce(_c(text), F.lit(""))
    parts = F.transform(F.split(t, "\n\\s*\n"), lambda p: F.regexp_replace(p, "^\\s+|\\s+$", ""))
    kept = F.filter(parts, lambda p: F.regexp_count(p, F.lit("\\S+")) >= least)
    return F.when((F.size(kept) == 0) & (t != ""), F.array(t)).otherwise(kept) if whole_if_none else kept


def sentences(text: Column | str) -> Column:
    """Parts between full stops, exclamation and question marks that aren't blank."""
    return F.filter(F.split(F.coalesce(_c(text), F.lit("")), "[.!?]+"), lambda s: s.rlike("\\S"))


def closed_sentences(text: Column | str, least: int = 3, keep_tail: bool = True) -> Column:
    """Sentences with their marks and at least so many words; keep_tail: also what follows the last mark; the text if none."""
    t = F.coalesce(_c(text), F.lit(""))
    closed = F.regexp_extract_all(t, F.lit("(?s)(.*?[.!?]+\\s+)"), 1)
    tail = F.regexp_extract(t, "(?s)^(?:.*[.!?]+\\s+)?(.*)$", 1)
    parts = F.concat(closed, F.array(tail)) if keep_tail else closed
    parts = F.transform(parts, lambda s: F.regexp_replace(s, "^\\s+|\\s+$", ""))
    kept = F.filter(parts, lambda s: F.regexp_count(s, F.lit("\\S+")) >= least)
    return F.when((F.size(kept) == 0) & (t != ""), F.array(t)).otherwise(kept)


def lookbehind_sentences(text: Column | str) -> Column:
    return F.filter(F.split(F.coalesce(_c(text), F.lit("")), "(?<=[.!?])\\s+"), lambda s: s != "")


def fact_sentences(text: Column | str, longer_than: int = 10) -> Column:
    return F.filter(F.split(F.coalesce(_c(text), F.lit("")), "[.!?]+\\s+"), lambda s: F.length(s) > longer_than)


def has_valid_sentence(text: Column | str, least: int = 3) -> Column:
    return F.exists(sentences(text), lambda s: F.regexp_count(s, F.lit("\\S+")) >= least)


def tokens_from_words(text: Column | str) -> Column:
    return (word_count(text) / F.lit(0.75)).cast("bigint")


def tokens_per_word(text: Column | str, factor: float = 1.33) -> Column:
    return (word_count(text) * F.lit(factor)).cast("bigint")


def tokens_from_chars(text: Column | str) -> Column:
    return F.floor(F.length(_c(text)) / 4).cast("bigint")


def cost_usd(tokens_in: Column | str, tokens_out: Column | str, price_in: float = 0.15, price_out: float = 0.60) -> Column:
    return _c(tokens_in) / F.lit(1e6) * F.lit(price_in) + _c(tokens_out) / F.lit(1e6) * F.lit(price_out)


def with_prompt(text: Column | str, prompt: str | None = None) -> Column:
    """The text after a prompt: one of PROMPTS by name, any other string, or the default."""
    return F.concat(F.lit(PROMPTS.get(prompt, prompt) if prompt is not None else PROMPT), _c(text))


def plain_paragraphs(text: Column | str) -> Column:
    """Parts between two line feeds that aren't blank; the text if there are none."""
    t = F.coalesce(_c(text), F.lit(""))
    parts = F.filter(F.transform(F.split(t, "\n\n"), lambda p: F.regexp_replace(p, "^\\s+|\\s+$", "")), lambda p: p != "")
    return F.when(F.size(parts) == 0, F.array(t)).otherwise(parts)


def word_shape(text: Column | str) -> Column:
    """(words, sentences, mean word length) of a text, zeros for none."""
    n = word_count(text)
    letters = F.regexp_count(_c(text), F.lit("\\S"))
    return F.struct(n.alias("words"), F.size(sentences(text)).cast("bigint").alias("sentences"), F.when(n == 0, F.lit(0.0)).otherwise(letters.cast("double") / n).alias("word_length"))


def compression(source: Column | str, made: Column | str) -> Column:
    """Words of the made text over those of the source, 0 for an empty source."""
    n = word_count(source)
    return F.when(n == 0, F.lit(0.0)).otherwise(word_count(made).cast("double") / n)


def without_echo(text: Column | str) -> Column:
    """Words that equal the word before them go."""
    kept = let(words(text), lambda w: F.filter(w, lambda x, i: (i == 0) | (x != F.get(w, i - 1))))
    return F.array_join(kept, " ")


def preview(text: Column | str, size: int = 200) -> Column:
    return F.when(F.length(_c(text)) > size, F.concat(F.substring(_c(text), 1, size), F.lit("..."))).otherwise(_c(text))


def content_key(original: Column | str, summary: Column | str) -> Column:
    return F.sha2(F.concat_ws("||", F.coalesce(_c(original), F.lit("")), F.coalesce(_c(summary), F.lit(""))), 256)


def gram_hashes(tokens: Column, n: int) -> Column:
    """64-bit hashes of runs of n tokens, for counts where strings would only be compared."""
    runs = lambda t: F.transform(F.sequence(F.lit(1), F.size(t) - n + 1), lambda i: F.xxhash64(*[F.get(t, i - 1 + k) for k in range(n)]))
    return let(tokens, lambda t: F.when(F.size(t) >= n, runs(t)).otherwise(F.array().cast("array<bigint>")))


def ngrams(tokens: Column, n: int) -> Column:
    """Runs of n tokens, joined by blanks."""
    none = F.array().cast("array<string>")
    runs = lambda t: F.transform(F.sequence(F.lit(1), F.size(t) - n + 1), lambda i: F.array_join(F.slice(t, i, n), " "))
    return let(tokens, lambda t: F.when(F.size(t) >= n, runs(t)).otherwise(none))
