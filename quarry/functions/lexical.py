"""Terms, diversity, overlap, and the rules that judge a text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions import readability as R
from quarry.functions.text import _c, gram_hashes, has_valid_sentence, let, ngrams, word_count, words

#: Whole words of a domain; parameters of the functions that use them.
DOMAIN = "adverse clinical condition diagnosis disease dose drug efficacy medication patient placebo randomized safety study symptom therapy treatment trial".split()
#: Terms whose presence marks a technical text.
INDICATORS = "cohort,confidence interval,controlled,efficacy,hypothesis,intervention,methodology,multivariate,p-value,placebo,prospective,protocol,randomized,regression,retrospective,significant,statistically,trial".split(",")
#: Terms that count wherever they occur, as substrings; one that is listed twice counts twice, patterns among them count as they are written.
_TERMS = """95% ci;adverse event;biomarker;biomarkers;case-control;cohort study;confidence interval;contraindication;cox regression;cross-sectional;diagnosis;double-blind;ecg;eeg;effectiveness;
efficacy;endpoint;epidemiology;etiology;hazard ratio;histology;incidence;indication;intervention;kaplan-meier;logistic regression;longitudinal;meta-analysis;methodology;morbidity;mortality;mri;
multivariate;observational study;odds ratio;outcome measure;p <;p-value;pathogenesis;pathology;pathophysiology;pcr;placebo;placebo-controlled;prevalence;primary endpoint;prognosis;prospective;
protocol;randomized controlled trial;rct;rct;regression;relative risk;retrospective;secondary endpoint;side effect;single-blind;statistically significant;survival analysis;systematic review;univariate"""
STATISTICS = [r"\bp\s*[<>=]\s*0\.\d+", r"\d+%\s*ci", r"\d+\.\d+\s*\([^)]+\)"]
TECHNICAL = [t.strip() for t in _TERMS.split(";")] + STATISTICS
#: Letters, marks, digits and underscores, in the classes that Java and RE2 share.
WORD = r"[\p{L}\p{M}\p{N}_]"
EDGE = r"[^\p{L}\p{M}\p{N}_]"


def stripped(text: Column | str) -> Column:
    """The text without white space around it."""
    return F.btrim(_c(text), F.lit(" \t\n\x0b\f\r"))


def acronyms(text: Column | str, most: int | None = None) -> Column:
    return F.regexp_count(_c(text), F.lit(f"(?U)\\b[A-Z]{{2,{most or ''}}}\\b")).cast("bigint")


def numbers(text: Column | str) -> Column:
    return F.regexp_count(_c(text), F.lit("(?U)\\b[0-9]+\\.?[0-9]*\\b")).cast("bigint")


def domain_share(text: Column | str, terms: list[str] = DOMAIN) -> Column:
    known, w = F.array(*map(F.lit, terms)), words(text)
    hits = F.size(F.filter(w, lambda x: F.array_contains(known, F.lower(x))))
    return F.when(F.size(w) == 0, F.lit(0.0)).otherwise(hits.cast("double") / F.size(w))


def term_count(text: Column | str, terms: list[str] = TECHNICAL) -> Column:
    """Occurrences of terms longer than two letters, as substrings of the lower-case text; a term listed twice counts twice."""
    known = F.array(*[F.lit(t) for t in terms if len(t) > 2])
    found = lambda t: F.filter(known, lambda x: F.contains(t, x))  # most don't occur, which a search tells sooner than a replacement
    hits = lambda t: F.aggregate(found(t), F.lit(0).cast("bigint"), lambda n, x: n + F.floor((F.length(t) - F.length(F.replace(t, x, F.lit("")))) / F.length(x)).cast("bigint"))
    return let(F.coalesce(F.lower(_c(text)), F.lit("")), hits)


def pattern_count(text: Column | str, patterns: list[str] = STATISTICS) -> Column:
    """Matches of patterns in the lower-case text."""
    out = F.lit(0).cast("bigint")
    for p in patterns:
        out = out + F.regexp_count(F.lower(_c(text)), F.lit(p))
    return out


def densities(text: Column | str) -> dict[str, Column]:
    """Acronyms, and shares of acronyms, numbers and domain words among the words; zeros without words."""
    n = word_count(text)
    return {"acronyms": F.coalesce(acronyms(text), F.lit(0).cast("bigint")), "acronym_share": _share(acronyms(text), n), "number_share": _share(numbers(text), n), "domain_share": domain_share(text)}


def present_terms(text: Column | str, terms: list[str] = INDICATORS) -> Column:
    found = lambda t: sum((F.contains(t, F.lit(x)).cast("bigint") for x in terms), F.lit(0).cast("bigint"))
    return let(F.lower(_c(text)), found)  # in lower case once, not for each term


def _share(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b)


def repetition(tokens: Column, n: int) -> Column:
    """Distinct n-grams that occur again, over all n-grams; grams are compared by 64-bit hashes."""
    again = lambda g: F.filter(g, lambda x, i: (i > 0) & (x == F.get(g, i - 1)))
    return let(F.sort_array(gram_hashes(tokens, n)), lambda g: _share(F.size(F.array_distinct(again(g))), F.size(g)))


def _diverse(w: Column) -> Column:
    measures = {"ttr": _share(F.size(F.array_distinct(w)), F.size(w)), "repeated_bigrams": repetition(w, 2), "repeated_trigrams": repetition(w, 3), "unique_words": F.size(F.array_distinct(w)).cast("bigint")}
    return F.struct(*[v.alias(k) for k, v in measures.items()])


def diversity(text: Column | str) -> dict[str, Column]:
    d = let(F.transform(words(text), F.lower), _diverse)  # the words are made once for all measures
    return {k: d[k] for k in ("ttr", "repeated_bigrams", "repeated_trigrams", "unique_words")}


def repeated_sentences(text: Column | str, longer_than: int = 10) -> Column:
    s = F.filter(F.transform(F.split(_c(text), "\\."), lambda x: F.lower(F.regexp_replace(x, "^\\s+|\\s+$", ""))), lambda x: F.length(x) > longer_than)
    return (F.size(s) - F.size(F.array_distinct(s))).cast("bigint")


def _dot_sentences(text: Column | str) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(_c(text), F.lit("")), "\\."), lambda x: F.lower(F.regexp_replace(x, "^\\s+|\\s+$", ""))), lambda x: x != "")


def judged(text: Column | str, low: int = 140, high: int = 210, longer_than: int = 10) -> Column:
    """Problems, warnings, whether a generated summary is valid, its tier, and its diversity, as a struct.

    Problems, which make it invalid and poor, are a wrong length and each repetition of a
    sentence longer than so many characters. Low variety and many repeated trigrams are but
    warnings: none is excellent, one good, two acceptable.
    """
    repeats = lambda a: F.filter(a, lambda x, i: (F.length(x) > longer_than) & (F.array_position(a, x) <= i))
    again = let(_dot_sentences(text), lambda a: F.when(F.size(F.array_distinct(a)) < F.size(a), repeats(a)).otherwise(F.slice(a, 1, 0)))

    def based(x: Column) -> Column:
        n, d = F.size(x["w"]), let(x["w"], _diverse)
        length = F.when(n < low, F.concat(F.lit("Too short: "), n.cast("string"), F.lit(f" words (least {low})"))).when(n > high, F.concat(F.lit("Too long: "), n.cast("string"), F.lit(f" words (most {high})")))
        said = F.transform(x["again"], lambda y: F.concat(F.lit("Repeated sentence: "), F.substring(y, 1, 50)))
        measured = lambda d: F.struct(F.concat(F.array_compact(F.array(length)), said).alias("problems"), *[F.round(d[k], 3).alias(k) for k in ("ttr", "repeated_bigrams", "repeated_trigrams")], d["unique_words"].alias("unique_words"))
        return let(d, measured)

    def whole(x: Column) -> Column:
        warnings = F.array_compact(F.array(F.when(x["ttr"] < 0.4, "Low variety"), F.when(x["repeated_trigrams"] > 0.3, "Similar phrases")))
        valid = F.size(x["problems"]) == 0
        rank = F.when(~valid, "poor").when(F.size(warnings) == 0, "excellent").when(F.size(warnings) == 1, "good").otherwise("acceptable")
        return F.struct(valid.alias("valid"), rank.alias("tier"), x["problems"].alias("problems"), warnings.alias("warnings"), *[x[k].alias(k) for k in ("ttr", "repeated_bigrams", "repeated_trigrams", "unique_words")])

    return let(let(F.struct(F.transform(words(text), F.lower).alias("w"), again.alias("again")), based), whole)


def generation_metrics(df, source: str, made: str):
    """``df`` with the fifteen measures of a generated summary: lengths, tokens, cost, readability, compression, validity, tier, diversity, problems and warnings."""
    from quarry.functions.text import cost_usd, tokens_per_word

    out = R.counts(df.withColumn("_judged", judged(made)), made).withColumns({
        "source_words": word_count(source), "summary_words": F.col("n_words"), "tokens_in": tokens_per_word(source), "tokens_out": tokens_per_word(made), "fre": R.flesch(), "fkg": R.kincaid(),
    }).withColumns({"cost": cost_usd("tokens_in", "tokens_out"), "compression": _share(F.col("summary_words"), F.col("source_words"))})
    j = F.col("_judged")
    return out.select(
        *df.columns, "source_words", "summary_words", "tokens_in", "tokens_out", "cost", "fre", "fkg", "compression", j["valid"].alias("valid"), j["tier"].alias("tier"), j["ttr"].alias("ttr"),
        j["repeated_bigrams"].alias("repeated_bigrams"), j["repeated_trigrams"].alias("repeated_trigrams"), F.array_join(j["problems"], "; ").alias("problems"), F.array_join(j["warnings"], "; ").alias("warnings"),
    )


#: Signs of bad scans by name: pairs and triples of fragments, runs of foreign signs, long numbers.
SCANS = {
    "OCR_fragments": rf"(^|{EDGE}){WORD}{{1,2}}\s+{WORD}{{1,2}}($|{EDGE})",
    "OCR_non_ascii": r"[^\x00-\x7F]{5,}",
    "OCR_long_number": rf"(^|{EDGE})[0-9]{{10,}}($|{EDGE})",
    "OCR_fragmented": rf"(^|{EDGE}){WORD}{{1,2}}\s+{WORD}{{1,2}}\s+{WORD}{{1,2}}($|{EDGE})",
}


def ocr_issues(text: Column | str) -> Column:
    """Names of the signs of a bad scan, and of more than two per cent of special signs."""
    t = _c(text)
    special = F.regexp_count(t, F.lit("[^\\p{L}\\p{M}\\p{N}_\\s.,;:!?()'\"/-]"))
    return F.array_compact(F.array(*[F.when(t.rlike(p), F.lit(n)) for n, p in SCANS.items()], F.when(special > F.length(t) * 0.02, F.lit("OCR_special"))))


def quality_issues(text: Column | str, lang: Column | str, wanted: str = "en", chars=(100, 5000), counts=(15, 800), confidence: Column | None = None, least_confidence: float = 0.9) -> Column:
    """Names of all faults of the text without white space around it; see ``is_valid`` for those that reject.

    confidence: of the language; None: 0.95 for the wanted one and 0.5 for others.
    """
    t = F.regexp_replace(_c(text), "^\\s+|\\s+$", "")
    n, told = word_count(t), _c(lang)
    sure = confidence if confidence is not None else F.when(told == wanted, F.lit(0.95)).otherwise(F.lit(0.5))
    own = F.array_compact(F.array(
        F.when(F.length(t) < chars[0], F.lit("Too_short")), F.when(F.length(t) > chars[1], F.lit("Too_long")), F.when(n < counts[0], F.lit("Too_few_words")),
        F.when(n > counts[1], F.lit("Too_many_words")), F.when(told != wanted, F.lit("Wrong_language")), F.when(sure < least_confidence, F.lit("Low_confidence")),
    ))
    last = F.array_compact(F.array(F.when(~has_valid_sentence(t), F.lit("No_valid_sentence"))))
    return F.when(t.isNull() | (t == ""), F.array(F.lit("Empty"))).otherwise(F.concat(own, ocr_issues(t), last))


def is_valid(issues: Column) -> Column:
    return ~F.arrays_overlap(issues, F.array(*map(F.lit, ("Empty", "Too_short", "Too_few_words", "Wrong_language"))))


def confidence(fre: Column, fkg: Column, length: Column, density: Column, chars: Column) -> Column:
    """How much a text reads like plain language, from 0 to 1."""
    f = lambda *steps: sum_case(steps)
    score = f((fre >= 60, 0.3), (fre >= 50, 0.15)) + f((fkg <= 8, 0.3), (fkg <= 12, 0.15)) + f((length <= 4.5, 0.2), (length <= 5.5, 0.1)) + f((density < 2, 0.2), (density < 5, 0.1))
    return F.when(chars < 50, F.lit(0.0)).otherwise(F.least(F.lit(1.0), score))


def sum_case(steps) -> Column:
    out = F.when(steps[0][0], F.lit(steps[0][1]))
    for test, value in steps[1:]:
        out = out.when(test, F.lit(value))
    return out.otherwise(F.lit(0.0))


def classified(df, text: str = "text"):
    """``df`` with readability, the heuristic's confidence, is_plain and its reasons; technical counts the indicators present."""
    out = R.counts(df, text).withColumns({"fre": R.flesch(), "fkg": R.kincaid(), "avg_word_length": R.word_length(), "technical": present_terms(text)})
    density = F.lit(100.0) * F.col("technical") / F.greatest(F.lit(1), F.col("n_words"))
    long_enough = F.length(stripped(text))
    out = out.withColumn("density", density).withColumn("confidence", confidence(F.col("fre"), F.col("fkg"), F.col("avg_word_length"), F.col("density"), long_enough))
    out = out.withColumn("is_plain", F.col("confidence") >= 0.5).withColumn("reasons", F.when(long_enough >= 50, reasons()).otherwise("too short to classify"))
    return out.select(*df.columns, "fre", "fkg", "avg_word_length", "technical", "density", "confidence", "is_plain", "reasons", "n_words", "n_sentences", "n_long")


def reasons() -> Column:
    """A sentence for each measure, banded, with its figure."""
    figure = lambda x: F.format_string("%.1f", x)
    return F.concat_ws(
        "; ",
        F.concat(F.when(F.col("fre") >= 60, "easy to read").when(F.col("fre") >= 50, "moderately readable").when(F.col("fre") >= 30, "difficult to read").when(F.col("fre") >= 0, "very difficult to read").otherwise("extremely difficult to read"), F.lit(" ("), figure(F.col("fre")), F.lit(")")),
        F.concat(F.when(F.col("fkg") <= 8, "easy grade").when(F.col("fkg") <= 12, "moderate grade").otherwise("difficult grade"), F.lit(" ("), figure(F.col("fkg")), F.lit(")")),
        F.when(F.col("avg_word_length") <= 4.5, "short words").when(F.col("avg_word_length") <= 5.5, "medium words").otherwise("long words"),
        F.concat(F.when(F.col("density") < 2, "few technical terms").when(F.col("density") < 5, "some technical terms").otherwise("many technical terms"), F.lit(" ("), F.col("technical").cast("string"), F.lit(")")),
    )


def model_or_heuristic(df, text: str = "text", probability: str | None = None):
    """``df`` classified by a model's probability where there is one, else by the heuristic: is_plain, confidence, method, reasons."""
    out = classified(df, text)
    if not probability:
        return out.withColumn("method", F.lit("heuristic"))
    p = F.col(probability)
    sure = F.when(p >= 0.7, "high").when(p >= 0.5, "moderate").otherwise("low")
    enough = p.isNotNull() & (F.length(F.trim(text)) >= 50)
    said = F.concat(F.format_string("%.0f", p * 100), F.lit("% plain ("), sure, F.lit(" confidence); "), F.col("reasons"))
    return out.withColumns({
        "method": F.when(enough, "model").otherwise("heuristic"), "reasons": F.when(enough, said).otherwise(F.col("reasons")),
        "is_plain": F.when(enough, p >= 0.5).otherwise(F.col("is_plain")), "confidence": F.when(enough, p).otherwise(F.col("confidence")),
    })


def bare_words(text: Column | str) -> Column:
    return F.array_distinct(words(F.regexp_replace(F.lower(_c(text)), f"[^\\p{{L}}\\p{{M}}\\p{{N}}_\\s]", "")))


def jaccard(a: Column, b: Column) -> Column:
    return _share(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))


def overlap(a: Column | str, b: Column | str) -> Column:
    """Mean of Jaccard similarity and share of the second text's words."""
    x, y = bare_words(a), bare_words(b)
    return (jaccard(x, y) + _share(F.size(F.array_intersect(x, y)), F.size(y))) / F.lit(2.0)


def ngram_overlap(a: Column | str, b: Column | str, n: int = 2) -> Column:
    x, y = (F.array_distinct(ngrams(F.transform(words(t), F.lower), n)) for t in (a, b))
    return jaccard(x, y)


def _banded(value: Column, steps) -> Column:
    out = F.when(steps[0][0](value), F.lit(steps[0][1]))
    for test, name in steps[1:]:
        out = out.when(test(value), F.lit(name))
    return out


def fre_band(fre: Column) -> Column:
    """Below 50, below 60, the target of 60 to 70, above."""
    return _banded(fre, [(lambda x: x < 50, "very hard"), (lambda x: x < 60, "hard"), (lambda x: x <= 70, "target"), (lambda x: x > 70, "easy")])


def fkg_band(fkg: Column) -> Column:
    return _banded(fkg, [(lambda x: x < 7, "simple"), (lambda x: x <= 9, "target"), (lambda x: x > 9, "complex")])


def ttr_band(ttr: Column) -> Column:
    return _banded(ttr, [(lambda x: x > 0.6, "excellent"), (lambda x: x >= 0.5, "good"), (lambda x: x < 0.5, "low")])


def reading_tier(fre: Column, fkg: Column) -> Column:
    """Excellent at both targets, good near them, else in need of work."""
    return F.when(fre.between(60, 70) & fkg.between(7, 9), "excellent").when(fre.between(55, 75) & (fkg <= 10), "good").otherwise("needs work")
