"""Parts of DuckDB SQL that say what the column functions say."""

from __future__ import annotations

from quarry.functions import lexical as L

WORDS = r"list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')"
LOWER = f"list_transform({WORDS}, lambda x: lower(x))"
SENTENCES = r"list_filter(regexp_split_to_array(text, '[.!?]+'), lambda x: regexp_matches(x, '\S'))"
SYLLABLES = r"greatest(1, len(regexp_extract_all(lower(x), '[aeiouy]+')) - CASE WHEN regexp_matches(lower(x), '[^aeiouy]e[^a-z]*$') THEN 1 ELSE 0 END)"


def names(items: list[str]) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in items) + "]"


def of(expression: str, text: str) -> str:
    """The expression over another column than ``text``."""
    return expression.replace("(text,", f"({text},")


def grams(tokens: str, n: int) -> str:
    return f"(CASE WHEN len({tokens}) >= {n} THEN list_transform(range(1, len({tokens}) - {n} + 2), lambda i: array_to_string({tokens}[i:i + {n - 1}], ' ')) ELSE CAST([] AS VARCHAR[]) END)"


def share(a: str, b: str) -> str:
    return f"(CASE WHEN ({b}) = 0 THEN 0.0::DOUBLE ELSE ({a})::DOUBLE / ({b}) END)"


def both(a: str, b: str) -> str:
    """Size of the intersection of two lists as sets."""
    return f"len(list_intersect({a}, {b}))"


def union(a: str, b: str) -> str:
    return f"len(list_distinct(list_concat({a}, {b})))"


def multi(a: str, b: str) -> str:
    """Size of the intersection of two lists as multisets."""
    return f"coalesce(list_sum(list_transform(list_distinct({a}), lambda k: least(len(list_filter({a}, lambda y: y = k)), len(list_filter({b}, lambda y: y = k))))), 0)::BIGINT"


def missing(a: str, b: str) -> str:
    return f"list_filter({a}, lambda x: NOT list_contains({b}, x))"


COUNTS = f"""counts AS (SELECT *, len(w)::BIGINT AS n_words, greatest(1, len({SENTENCES}))::BIGINT AS n_sentences, coalesce(list_sum(y), 0)::BIGINT AS n_syllables,
    coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS n_letters, len(list_filter(y, lambda v: v >= 3))::BIGINT AS n_complex, len(list_filter(w, lambda x: length(x) > 10))::BIGINT AS n_long
    FROM (SELECT *, list_transform(w, lambda x: {SYLLABLES}) AS y FROM (SELECT *, {WORDS} AS w FROM documents)))"""
STRIPPED = r"regexp_replace(text, '^\s+|\s+$', '', 'g')"
FRE = "(CASE WHEN n_words = 0 THEN 0.0 ELSE 206.835::DOUBLE - 1.015::DOUBLE * (n_words::DOUBLE / n_sentences) - 84.6::DOUBLE * (n_syllables::DOUBLE / n_words) END)"
FKG = "(CASE WHEN n_words = 0 THEN 0.0 ELSE 0.39::DOUBLE * (n_words::DOUBLE / n_sentences) + 11.8::DOUBLE * (n_syllables::DOUBLE / n_words) - 15.59::DOUBLE END)"
LENGTH = share("n_letters", "n_words")
TECHNICAL = f"list_sum(list_transform({names([t for t in L.TECHNICAL if len(t) > 2])}, lambda x: ((length(lower(text)) - length(replace(lower(text), x, ''))) // length(x))::BIGINT))"
PRESENT = f"len(list_filter({names(L.INDICATORS)}, lambda x: contains(lower(text), x)))"
SCORED = f"""{COUNTS}, scored AS (SELECT *, {FRE} AS fre, {FKG} AS fkg, {LENGTH} AS avg_word_length, ({PRESENT})::BIGINT AS technical FROM counts),
rated AS (SELECT *, 100.0::DOUBLE * technical / greatest(1, n_words) AS density FROM scored),
judged AS (SELECT *, CASE WHEN length({STRIPPED}) < 50 THEN 0.0::DOUBLE ELSE least(1.0::DOUBLE,
    (CASE WHEN fre >= 60 THEN 0.3 WHEN fre >= 50 THEN 0.15 ELSE 0 END)::DOUBLE + (CASE WHEN fkg <= 8 THEN 0.3 WHEN fkg <= 12 THEN 0.15 ELSE 0 END)::DOUBLE
    + (CASE WHEN avg_word_length <= 4.5 THEN 0.2 WHEN avg_word_length <= 5.5 THEN 0.1 ELSE 0 END)::DOUBLE + (CASE WHEN density < 2 THEN 0.2 WHEN density < 5 THEN 0.1 ELSE 0 END)::DOUBLE) END AS confidence FROM rated)"""
TRIPLES = f"""triples AS (SELECT u.conv_id, u.turn, {of(LOWER, 'u.text')} AS s, {of(LOWER, 'a.text')} AS p, {of(LOWER, 'b.text')} AS r, u.text AS source, a.text AS pred
    FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
    JOIN benchmark b ON b.item_id = u.conv_id % (SELECT count(*) FROM benchmark) WHERE u.role = 'user')"""
SETS = "sets AS (SELECT *, list_distinct(s) AS ss, list_distinct(p) AS ps, list_distinct(r) AS rs FROM triples)"
BARE = rf"list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^\p{{L}}\p{{M}}\p{{N}}_\s]', '', 'g'), '\s+'), lambda x: x <> ''))"
SPECIAL = r"len(regexp_extract_all(text, '[^\p{L}\p{M}\p{N}_\s.,;:!?()''\"/-]'))"
