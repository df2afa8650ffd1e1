"""All queries by name, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import lexical as L
from quarry.functions import metrics as M
from quarry.functions import readability as R
from quarry.functions import text as X
from quarry.operators import chunking, classify, dedup, filters, providers, reports, rewrite, splits, stats
from quarry.plans import sql as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


def labelled(spark: SparkSession, sf: str, how: str = "inner") -> DataFrame:
    return docs(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id", how)


def triples(spark: SparkSession, sf: str) -> DataFrame:
    """User turns with the assistant's next turn, and a reference by the number of the conversation."""
    c = spark.read.parquet(f"{sf}/conversations.parquet")
    b = spark.read.parquet(f"{sf}/benchmark.parquet")
    n = b.agg(F.count(F.lit(1)).alias("items"))
    user = c.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("source"))
    reply = c.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("pred"))
    pairs = user.join(reply, ["conv_id", "turn"]).crossJoin(F.broadcast(n)).withColumn("item_id", F.col("conv_id") % F.col("items"))  # one row
    return pairs.join(b.withColumnRenamed("text", "ref"), "item_id").withColumns({"s": M.tokens("source"), "p": M.tokens("pred"), "r": M.tokens("ref")})


STEPS = {"fre_ok": "fre >= 55", "fkg_ok": "fkg <= 10", "length_ok": "n_words BETWEEN 150 AND 250", "plain_ok": "confidence >= 0.5"}
K = ("conv_id", "turn")
r6 = lambda c: F.round(c, 6)


@query(f"""WITH {S.SCORED} SELECT source, count(*) AS total, count(*) FILTER (fre >= 55) AS fre_ok, count(*) FILTER (fre >= 55 AND fkg <= 10) AS fkg_ok,
    count(*) FILTER (fre >= 55 AND fkg <= 10 AND n_words BETWEEN 150 AND 250) AS length_ok,
    count(*) FILTER (fre >= 55 AND fkg <= 10 AND n_words BETWEEN 150 AND 250 AND confidence >= 0.5) AS plain_ok FROM judged GROUP BY source""")
def flagship_funnel(spark, sf):
    return filters.funnel(L.classified(docs(spark, sf)), {k: F.expr(v) for k, v in STEPS.items()}, ["source"])


@query(f"SELECT doc_id, len({S.WORDS})::BIGINT AS n_words FROM documents")
def word_counts(spark, sf):
    return docs(spark, sf).select("doc_id", X.word_count("text").alias("n_words"))


@query(rf"""SELECT doc_id, length(text)::BIGINT AS chars, len({S.WORDS})::BIGINT AS words, len(list_filter(string_split(text, '.'), lambda x: regexp_matches(x, '\S')))::BIGINT AS sentences,
    len(list_filter(regexp_split_to_array(text, '\n\s*\n'), lambda x: regexp_matches(x, '\S')))::BIGINT AS paragraphs FROM documents""")
def length_metrics(spark, sf):
    part = lambda p: F.size(F.filter(F.split("text", p), lambda x: x.rlike("\\S"))).cast("bigint")
    return docs(spark, sf).select("doc_id", F.length("text").cast("bigint").alias("chars"), X.word_count("text").alias("words"), part("\\.").alias("sentences"), part("\n\\s*\n").alias("paragraphs"))


@query(r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'),
    '[ \t\f\v\r]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '^\s+|\s+$', '', 'g') AS norm FROM documents""")
def norm_text(spark, sf):
    return docs(spark, sf).select("doc_id", X.normalise("text").alias("norm"))


@query(f"SELECT doc_id, len({S.SENTENCES})::BIGINT AS n, len(list_filter({S.SENTENCES}, lambda x: len(regexp_extract_all(x, '\\S+')) >= 3))::BIGINT AS valid FROM documents")
def sentence_stats(spark, sf):
    s = X.sentences("text")
    return docs(spark, sf).select("doc_id", F.size(s).cast("bigint").alias("n"), F.size(F.filter(s, lambda x: F.regexp_count(x, F.lit("\\S+")) >= 3)).cast("bigint").alias("valid"))


@query(f"SELECT source, count(*) AS n FROM documents WHERE len(list_filter({S.SENTENCES}, lambda x: len(regexp_extract_all(x, '\\S+')) >= 3)) > 0 GROUP BY source")
def valid_sentences(spark, sf):
    return docs(spark, sf).filter(X.has_valid_sentence("text")).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query(f"""SELECT doc_id, trunc(n / 0.75::DOUBLE)::BIGINT AS t1, trunc(n * 1.33::DOUBLE)::BIGINT AS t2, (length(text) // 4)::BIGINT AS t3,
    n / 1e6::DOUBLE * 0.15::DOUBLE + n / 1e6::DOUBLE * 0.6::DOUBLE AS cost FROM (SELECT *, len({S.WORDS})::BIGINT AS n FROM documents)""")
def token_cost(spark, sf):
    n = X.word_count("text")
    return docs(spark, sf).select("doc_id", X.tokens_from_words("text").alias("t1"), X.tokens_per_word("text").alias("t2"), X.tokens_from_chars("text").alias("t3"), X.cost_usd(n, n).alias("cost"))


_SIGNS = ", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{n}' END" for n, p in L.SCANS.items())
_ISSUES = rf"""issues AS (SELECT doc_id, source, array_to_string(list_filter(CASE WHEN text = '' THEN ['Empty'] ELSE [
    CASE WHEN length(text) < 100 THEN 'Too_short' END, CASE WHEN length(text) > 5000 THEN 'Too_long' END, CASE WHEN n < 15 THEN 'Too_few_words' END, CASE WHEN n > 800 THEN 'Too_many_words' END,
    CASE WHEN lang <> 'en' THEN 'Wrong_language' END, CASE WHEN lang <> 'en' THEN 'Low_confidence' END, {_SIGNS}, CASE WHEN {S.SPECIAL} > length(text) * 0.02 THEN 'OCR_special' END,
    CASE WHEN len(list_filter({S.SENTENCES}, lambda x: len(regexp_extract_all(x, '\S+')) >= 3)) = 0 THEN 'No_valid_sentence' END] END, lambda x: x IS NOT NULL), '|') AS issues
    FROM (SELECT *, len({S.WORDS}) AS n FROM (SELECT doc_id, source, lang, {S.STRIPPED} AS text FROM documents)))"""


@query(f"WITH {_ISSUES} SELECT doc_id, issues, NOT regexp_matches(issues, 'Empty|Too_short|Too_few_words|Wrong_language') AS valid FROM issues")
def quality_flags(spark, sf):
    d = docs(spark, sf).withColumn("i", L.quality_issues("text", "lang"))
    return d.select("doc_id", F.array_join("i", "|").alias("issues"), L.is_valid(F.col("i")).alias("valid"))


@query(f"WITH {_ISSUES} SELECT issue, count(*) AS n FROM (SELECT unnest(string_split(issues, '|')) AS issue FROM issues WHERE issues <> '') GROUP BY issue")
def quality_issue_counts(spark, sf):
    return docs(spark, sf).select(F.explode(L.quality_issues("text", "lang")).alias("issue")).groupBy("issue").agg(F.count(F.lit(1)).alias("n"))


@query(f"""SELECT doc_id, {S.share(f"len(list_filter({S.WORDS}, lambda x: list_contains({S.names(L.DOMAIN)}, lower(x))))", f"len({S.WORDS})")} AS share FROM documents""")
def medical_density(spark, sf):
    return docs(spark, sf).select("doc_id", L.domain_share("text").alias("share"))


@query(f"SELECT doc_id, ({S.TECHNICAL})::BIGINT AS technical, ({S.PRESENT})::BIGINT AS present FROM documents")
def technical_terms(spark, sf):
    return docs(spark, sf).select("doc_id", L.term_count("text").alias("technical"), L.present_terms("text").alias("present"))


@query(r"SELECT doc_id, len(list_filter(regexp_split_to_array(text, '[^\p{L}\p{M}\p{N}_]+'), lambda x: regexp_matches(x, '^[A-Z]{2,}$')))::BIGINT AS acronyms FROM documents")
def acronyms(spark, sf):
    return docs(spark, sf).select("doc_id", L.acronyms("text").alias("acronyms"))


@query(f"""WITH {S.SCORED} SELECT doc_id, round(fre, 6) AS fre, round(fkg, 6) AS fkg, round(avg_word_length, 6) AS avg_word_length, round(n_words::DOUBLE / n_sentences, 6) AS words_per_sentence,
    round({S.share("n_long", "n_words")}, 6) AS long_share FROM scored""")
def readability(spark, sf):
    more = {"words_per_sentence": F.col("n_words") / F.col("n_sentences"), "long_share": L._share(F.col("n_long"), F.col("n_words"))}
    return L.classified(docs(spark, sf)).select("doc_id", *[r6(F.col(c)).alias(c) for c in ("fre", "fkg", "avg_word_length")], *[r6(v).alias(k) for k, v in more.items()])


@query(rf"""WITH d AS (SELECT *, len({S.WORDS}) AS n, len(list_filter(regexp_split_to_array(text, '[^\p{{L}}\p{{M}}\p{{N}}_]+'), lambda x: regexp_matches(x, '^[A-Z]{{2,}}$')))::BIGINT AS a FROM documents)
    SELECT doc_id, a AS acronyms, round({S.share('a', 'n')}, 6) AS acronym_share, round({S.share(f"len(list_filter({S.WORDS}, lambda x: list_contains({S.names(L.DOMAIN)}, lower(x))))", 'n')}, 6) AS domain_share FROM d""")
def term_densities(spark, sf):
    d = L.densities("text")
    return docs(spark, sf).select("doc_id", d["acronyms"].alias("acronyms"), *[r6(d[k]).alias(k) for k in ("acronym_share", "domain_share")])


@query(f"""WITH {S.COUNTS} SELECT doc_id, round(0.4::DOUBLE * ({S.share("n_words", "n_sentences")} + 100.0 * {S.share("n_complex", "n_words")}), 6) AS fog,
    round(4.71::DOUBLE * {S.LENGTH} + 0.5 * {S.share("n_words", "n_sentences")} - 21.43::DOUBLE, 6) AS ari,
    round(0.0588::DOUBLE * (100.0 * {S.LENGTH}) - 0.296::DOUBLE * (100.0 * {S.share("n_sentences", "n_words")}) - 15.8::DOUBLE, 6) AS coleman_liau,
    round(1.043::DOUBLE * sqrt(30.0 * {S.share("n_complex", "n_sentences")}) + 3.1291::DOUBLE, 6) AS smog,
    round(CASE WHEN l > 20 THEN l / 2 ELSE l / 2 - 1 END, 6) AS linsear, round(CASE WHEN h > 5 THEN 0.1579::DOUBLE * h + 0.0496::DOUBLE * {S.share("n_words", "n_sentences")} + 3.6365::DOUBLE
        ELSE 0.1579::DOUBLE * h + 0.0496::DOUBLE * {S.share("n_words", "n_sentences")} END, 6) AS dale_chall
    FROM (SELECT *, {S.share("n_words + 2 * n_complex", "n_sentences")} AS l,
        100.0 * {S.share(f"len(list_filter(w, lambda x: NOT list_contains({S.names(R.FAMILIAR)}, regexp_replace(lower(x), '[^a-z]', '', 'g'))))", "n_words")} AS h FROM counts)""")
def readability_battery(spark, sf):
    return R.battery(docs(spark, sf)).select("doc_id", *[r6(F.col(c)).alias(c) for c in ("fog", "ari", "coleman_liau", "smog", "linsear", "dale_chall")])


def _again(n: int) -> str:
    g = S.grams("lw", n)
    return S.share(f"len(list_distinct(list_filter(list_transform(range(2, len(g{n}) + 1), lambda i: CASE WHEN g{n}[i] = g{n}[i - 1] THEN g{n}[i] END), lambda x: x IS NOT NULL)))", f"len(g{n})") if g else ""


_DIVERSE = f"""diverse AS (SELECT *, {S.share("len(list_distinct(lw))", "len(lw)")} AS ttr, {_again(2)} AS b, {_again(3)} AS t, len(list_distinct(lw))::BIGINT AS unique_words,
    len(list_distinct(st)) AS sd, len(st) AS sn FROM (SELECT *, list_sort({S.grams("lw", 2)}) AS g2, list_sort({S.grams("lw", 3)}) AS g3,
    list_filter(list_transform(string_split(text, '.'), lambda x: lower(regexp_replace(x, '^\\s+|\\s+$', '', 'g'))), lambda x: length(x) > 10) AS st FROM (SELECT *, {S.LOWER} AS lw FROM documents)))"""


@query(f"WITH {_DIVERSE} SELECT doc_id, round(ttr, 6) AS ttr, round(b, 6) AS repeated_bigrams, round(t, 6) AS repeated_trigrams, unique_words FROM diverse")
def lexical_diversity(spark, sf):
    d = L.diversity("text")
    return docs(spark, sf).select("doc_id", *[r6(d[c]).alias(c) for c in ("ttr", "repeated_bigrams", "repeated_trigrams")], d["unique_words"].alias("unique_words"))


@query(f"WITH {_DIVERSE} SELECT doc_id, (sn - sd)::BIGINT AS repeated FROM diverse WHERE sn > sd")
def repeated_sentences(spark, sf):
    return docs(spark, sf).select("doc_id", L.repeated_sentences("text").alias("repeated")).filter("repeated > 0")


_JUDGED = f"""rules AS (SELECT *, round(ttr, 3) AS ttr3, round(b, 3) AS b3, round(t, 3) AS t3, list_concat(
    CASE WHEN len(lw) < 140 THEN ['Too short: ' || len(lw) || ' words (least 140)'] WHEN len(lw) > 210 THEN ['Too long: ' || len(lw) || ' words (most 210)'] ELSE CAST([] AS VARCHAR[]) END,
    list_transform(list_filter(range(1, len(ds) + 1), lambda i: length(ds[i]) > 10 AND list_position(ds, ds[i]) < i), lambda i: 'Repeated sentence: ' || substr(ds[i], 1, 50))) AS problems
    FROM (SELECT *, list_filter(list_transform(string_split(text, '.'), lambda x: lower(regexp_replace(x, '^\\s+|\\s+$', '', 'g'))), lambda x: x <> '') AS ds FROM diverse)),
    ruled AS (SELECT *, len(problems) = 0 AS valid, list_filter([CASE WHEN ttr3 < 0.4 THEN 'Low variety' END, CASE WHEN t3 > 0.3 THEN 'Similar phrases' END], lambda x: x IS NOT NULL) AS warnings FROM rules),
    told AS (SELECT *, CASE WHEN NOT valid THEN 'poor' WHEN len(warnings) = 0 THEN 'excellent' WHEN len(warnings) = 1 THEN 'good' ELSE 'acceptable' END AS tier FROM ruled)"""


@query(f"WITH {_DIVERSE}, {_JUDGED} SELECT doc_id, valid, tier, array_to_string(problems, '; ') AS problems, array_to_string(warnings, '; ') AS warnings FROM told")
def quality_tier(spark, sf):
    j = F.col("j")
    d = docs(spark, sf).withColumn("j", L.judged("text"))
    return d.select("doc_id", j["valid"].alias("valid"), j["tier"].alias("tier"), F.array_join(j["problems"], "; ").alias("problems"), F.array_join(j["warnings"], "; ").alias("warnings"))


_PAIRS = f"""{S.TRIPLES}, documents AS (SELECT conv_id, turn, source AS original, pred AS text FROM triples)"""
_MEASURED = f"""{_PAIRS}, {S.SCORED}, {_DIVERSE}, {_JUDGED}, measured AS (SELECT s.conv_id, s.turn, len({S.of(S.WORDS, 's.original')})::BIGINT AS source_words, n_words AS summary_words, fre, fkg, valid, tier, ttr3, b3, t3,
    array_to_string(problems, '; ') AS problems, array_to_string(warnings, '; ') AS warnings FROM scored s JOIN told t ON s.conv_id = t.conv_id AND s.turn = t.turn)"""


@query(f"""WITH {_MEASURED} SELECT conv_id, turn, source_words, summary_words, trunc(source_words * 1.33::DOUBLE)::BIGINT AS tokens_in, trunc(summary_words * 1.33::DOUBLE)::BIGINT AS tokens_out,
    round(trunc(source_words * 1.33::DOUBLE) / 1e6::DOUBLE * 0.15::DOUBLE + trunc(summary_words * 1.33::DOUBLE) / 1e6::DOUBLE * 0.6::DOUBLE, 9) AS cost, round(fre, 6) AS fre, round(fkg, 6) AS fkg,
    round({S.share('summary_words', 'source_words')}, 6) AS compression, valid, tier, ttr3 AS ttr, b3 AS repeated_bigrams, t3 AS repeated_trigrams, problems, warnings FROM measured""")
def generation_metrics(spark, sf):
    out = L.generation_metrics(triples(spark, sf).select(*K, "source", "pred"), "source", "pred").drop("source", "pred")
    return out.withColumns({**{c: r6(F.col(c)) for c in ("fre", "fkg", "compression")}, "cost": F.round("cost", 9)})


@query(f"""WITH {S.SCORED} SELECT doc_id, round(confidence, 6) AS confidence, confidence >= 0.5 AS is_plain, technical, CASE WHEN length({S.STRIPPED}) < 50 THEN 'too short to classify' ELSE concat_ws('; ',
    CASE WHEN fre >= 60 THEN 'easy to read' WHEN fre >= 50 THEN 'moderately readable' WHEN fre >= 30 THEN 'difficult to read' WHEN fre >= 0 THEN 'very difficult to read' ELSE 'extremely difficult to read' END,
    CASE WHEN fkg <= 8 THEN 'easy grade' WHEN fkg <= 12 THEN 'moderate grade' ELSE 'difficult grade' END, CASE WHEN avg_word_length <= 4.5 THEN 'short words' WHEN avg_word_length <= 5.5 THEN 'medium words' ELSE 'long words' END,
    CASE WHEN density < 2 THEN 'few technical terms' WHEN density < 5 THEN 'some technical terms' ELSE 'many technical terms' END || ' (' || technical || ')') END AS reasons FROM judged""")
def heuristic_classify(spark, sf):
    # Figures in brackets are left out: the two engines print ties of the last digit differently.
    plain = F.regexp_replace("reasons", " \\(-?[0-9]+\\.[0-9]\\)", "")
    return L.classified(docs(spark, sf)).select("doc_id", r6(F.col("confidence")).alias("confidence"), "is_plain", "technical", plain.alias("reasons"))


@query(f"""WITH {S.SCORED}, m AS (SELECT j.*, CASE WHEN toxic IS NULL OR length(trim(text)) < 50 THEN NULL ELSE 0.25 + toxic / 2.0 END AS p FROM judged j LEFT JOIN labels USING (doc_id))
    SELECT doc_id, CASE WHEN p IS NULL THEN 'heuristic' ELSE 'model' END AS method, round(coalesce(p, confidence), 6)::DOUBLE AS confidence, CASE WHEN p IS NULL THEN confidence >= 0.5 ELSE p >= 0.5 END AS is_plain FROM m""")
def classify_by_model_or_rules(spark, sf):
    # A stand-in for a model's probability, missing where the labels are.
    d = labelled(spark, sf, "left").withColumn("p", F.lit(0.25) + F.col("toxic") / 2.0).select("doc_id", "text", "p")
    return L.model_or_heuristic(d, "text", "p").select("doc_id", "method", r6(F.col("confidence")).alias("confidence"), "is_plain")


@query("SELECT sha256(concat_ws('||', coalesce(source, ''), coalesce(text, ''))) AS key, min(doc_id) AS doc_id, min_by(n_chars, doc_id) AS n_chars FROM documents GROUP BY source, text")
def dedup_by_content_key(spark, sf):
    d = docs(spark, sf).withColumn("key", X.content_key("source", "text"))
    return dedup.first_of(d, ["key"], ["doc_id"]).select("key", "doc_id", "n_chars")


@query("SELECT min(doc_id) AS doc_id, sha256(text) AS key FROM documents GROUP BY text")
def exact_dedup(spark, sf):
    return dedup.first_of(docs(spark, sf).withColumn("key", F.sha2("text", 256)), ["key"], ["doc_id"]).select("doc_id", "key")


@query("SELECT sha256(text) AS key, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY text HAVING count(*) > 1")
def duplicate_groups(spark, sf):
    return dedup.duplicate_groups(docs(spark, sf), F.sha2("text", 256), "doc_id")


def _chosen(strata: str, fraction: float, table: str = "documents") -> str:
    return f"""SELECT *, row_number() OVER (PARTITION BY {strata} ORDER BY sha256('42|' || doc_id), doc_id) <= round_even({fraction}::DOUBLE * count(*) OVER (PARTITION BY {strata}), 0) AS chosen FROM {table}"""


@query(f"SELECT doc_id, quality, chosen FROM ({_chosen('quality', 0.2, 'labels')})")
def stratified_split(spark, sf):
    return splits.stratified(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id", ["quality"], 0.2).select("doc_id", "quality", "chosen")


@query(f"SELECT doc_id, chosen FROM ({_chosen('lang, source', 0.1)})")
def stratified_two_keys(spark, sf):
    return splits.stratified(docs(spark, sf), "doc_id", ["lang", "source"], 0.1).select("doc_id", "chosen")


@query(f"""WITH s AS (SELECT lang, CASE WHEN chosen THEN 'test' ELSE 'train' END AS split FROM ({_chosen('lang', 0.2)})),
    n AS (SELECT split, lang, count(*) AS n FROM s GROUP BY ALL) SELECT round(max(abs(own - al)), 6) AS drift FROM
    (SELECT n::DOUBLE / sum(n) OVER (PARTITION BY split) AS own, (sum(n) OVER (PARTITION BY lang))::DOUBLE / sum(n) OVER () AS al FROM n)""")
def split_proportion_drift(spark, sf):
    d = splits.stratified(docs(spark, sf), "doc_id", ["lang"], 0.2)
    return splits.drift(d.withColumn("split", F.when(F.col("chosen"), "test").otherwise("train")), "lang")


_BY_KEY = "CASE WHEN ('0x' || substr(sha256('42|' || {k}), 1, 8))::BIGINT::DOUBLE / 4294967296.0 < 0.8 THEN 'train' WHEN ('0x' || substr(sha256('42|' || {k}), 1, 8))::BIGINT::DOUBLE / 4294967296.0 < 0.9 THEN 'dev' ELSE 'test' END"


@query(f"SELECT doc_id, {_BY_KEY.format(k='text')} AS split FROM documents")
def split_by_input(spark, sf):
    return splits.split_by_key(docs(spark, sf), F.col("text")).select("doc_id", "split")


@query(f"SELECT key, n_splits FROM (SELECT sha256(text) AS key, count(DISTINCT split)::BIGINT AS n_splits FROM (SELECT text, {_BY_KEY.format(k='doc_id')} AS split FROM documents) GROUP BY text) WHERE n_splits > 1")
def split_leakage(spark, sf):
    return splits.leakage(splits.split_by_key(docs(spark, sf), F.col("doc_id").cast("string")), F.sha2("text", 256))


@query("""SELECT doc_id, quality, chosen AS chosen_text FROM (SELECT *, CASE quality WHEN 1 THEN trim(substr(text, 1, 200)) WHEN 0 THEN trim(text) END AS chosen FROM documents JOIN labels USING (doc_id)) WHERE length(chosen) >= 50""")
def label_select_text(spark, sf):
    d = labelled(spark, sf).withColumn("summary", F.substring("text", 1, 200))
    return filters.by_label(d, "quality", "summary", "text").select("doc_id", "quality", "chosen_text")


_Q = ", ".join(f"round(quantile_cont(n_chars, {q}), 6) AS {n}" for q, n in ((0.25, "q25"), (0.5, "median"), (0.75, "q75"), (0.9, "q90"), (0.95, "q95"), (0.99, "q99")))


@query(f"SELECT count(*) AS n, round(avg(n_chars), 6) AS mean, round(stddev_samp(n_chars), 6) AS std, min(n_chars) AS least, max(n_chars) AS most, {_Q} FROM documents")
def describe_lengths(spark, sf):
    return stats.describe(docs(spark, sf), "n_chars")


@query(" UNION ALL ".join(f"SELECT '{g}' AS grouping, {g} AS value, count(*) AS n, round(avg(n_chars), 6) AS mean, round(median(n_chars), 6) AS median FROM (SELECT *, CASE WHEN doc_id % 5 = 0 THEN 'test' ELSE 'train' END AS split FROM documents) GROUP BY {g}" for g in ("source", "lang", "split")))
def group_length_stats(spark, sf):
    d = docs(spark, sf).withColumn("split", F.when(F.col("doc_id") % 5 == 0, "test").otherwise("train"))
    return stats.grouped(d, "n_chars", ["source", "lang", "split"])


@query(f"""SELECT *, CASE WHEN truncated_pct > 50 THEN 'chunk' WHEN truncated_pct > 20 THEN 'consider chunking' ELSE 'fine' END AS advice, CASE WHEN mean_lost > 100 THEN 'much lost' WHEN mean_lost > 50 THEN 'some lost' ELSE 'little lost' END AS loss FROM (SELECT count(*) AS "rows", count(*) FILTER (n > 512) AS truncated, round(coalesce(avg(100.0::DOUBLE * (n - 512) / n) FILTER (n > 512), 0.0), 6) AS mean_lost_pct,
    round(100.0::DOUBLE * count(*) FILTER (n > 512) / count(*), 6) AS truncated_pct, round(coalesce(avg(n - 512) FILTER (n > 512), 0.0), 6) AS mean_lost, coalesce(sum(n - 512) FILTER (n > 512), 0)::BIGINT AS total_lost,
    round(avg(greatest(n - 512, 0)), 6) AS mean_lost_all FROM (SELECT len({S.WORDS})::BIGINT AS n FROM documents))""")
def truncation_stats(spark, sf):
    return stats.truncation(docs(spark, sf).withColumn("n", X.word_count("text")), "n", 512)


@query("SELECT source, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (), 6) AS share FROM documents GROUP BY source")
def value_shares(spark, sf):
    return splits.shares(docs(spark, sf), "source")


_FRE_BAND = "CASE WHEN fre < 50 THEN 'very hard' WHEN fre < 60 THEN 'hard' WHEN fre <= 70 THEN 'target' ELSE 'easy' END"
_FKG_BAND = "CASE WHEN fkg < 7 THEN 'simple' WHEN fkg <= 9 THEN 'target' ELSE 'complex' END"
_TTR_BAND = "CASE WHEN ttr > 0.6 THEN 'excellent' WHEN ttr >= 0.5 THEN 'good' ELSE 'low' END"
_RUN = f"{S.SCORED}, {_DIVERSE}, {_JUDGED}, run AS (SELECT s.doc_id, s.source, s.lang, s.n_words, s.fre, s.fkg, t.ttr3 AS ttr, t.t3 AS repeated_trigrams, t.valid, t.tier FROM scored s JOIN told t USING (doc_id))"


def run_of(spark, sf):
    """Documents with what reports over a run of generated texts ask for."""
    d = L.classified(docs(spark, sf).withColumn("j", L.judged("text")))
    return d.select("doc_id", "source", "lang", "n_words", "fre", "fkg", *[F.col(f"j.{c}").alias(c) for c in ("ttr", "repeated_trigrams", "valid", "tier")])


@query(f"""WITH {_RUN}, b AS (SELECT unnest([{{'measure': 'fre', 'band': {_FRE_BAND}}}, {{'measure': 'fkg', 'band': {_FKG_BAND}}}, {{'measure': 'ttr', 'band': {_TTR_BAND}}}, {{'measure': 'tier', 'band': tier}}]) AS x FROM run)
    SELECT x.measure AS measure, x.band AS band, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY x.measure), 6) AS pct FROM b GROUP BY x.measure, x.band""")
def metric_bands(spark, sf):
    return reports.distribution(run_of(spark, sf), reports.bands_of() | {"tier": F.col("tier")})


@query(f"""WITH {S.SCORED} SELECT CASE WHEN fre BETWEEN 60 AND 70 AND fkg BETWEEN 7 AND 9 THEN 'excellent' WHEN fre BETWEEN 55 AND 75 AND fkg <= 10 THEN 'good' ELSE 'needs work' END AS tier, count(*) AS n FROM scored GROUP BY ALL""")
def reading_tiers(spark, sf):
    return L.classified(docs(spark, sf)).groupBy(L.reading_tier(F.col("fre"), F.col("fkg")).alias("tier")).agg(F.count(F.lit(1)).alias("n"))


_METRICS = {"fre": ("fre >= 55", "fre"), "fkg": ("fkg <= 10", "fkg"), "n_words": ("n_words BETWEEN 150 AND 250", "n_words")}


@query(f"WITH {S.SCORED} " + " UNION ALL ".join(f"SELECT '{k}' AS metric, round(avg({k}), 6) AS mean, round(median({k}), 6) AS median, round(stddev_samp({k}), 6) AS std, round(min({k})::DOUBLE, 6) AS least, round(max({k})::DOUBLE, 6) AS most, count(*) FILTER ({t}) AS meets FROM scored" for k, (t, _) in _METRICS.items()))
def metric_summary(spark, sf):
    return reports.summary(L.classified(docs(spark, sf)), {k: F.expr(t) for k, (t, _) in _METRICS.items()})


@query(f"WITH {S.SCORED} SELECT count(*) AS rows, " + ", ".join(f"count(*) FILTER (confidence >= {t}) AS at_{round(t * 100)}" for t in (0.5, 0.6, 0.7, 0.75, 0.8, 0.9)) + " FROM judged")
def threshold_counts(spark, sf):
    return reports.at_thresholds(L.classified(docs(spark, sf)), "confidence")


@query(f"""WITH {_RUN}, s AS (SELECT count(*) AS n, count(*) FILTER (NOT valid) AS invalid, count(*) FILTER (n_words < 140) AS short, count(*) FILTER (n_words > 210) AS long, avg(fre) AS fre, avg(fkg) AS fkg, avg(ttr) AS ttr FROM run)
    SELECT n, invalid, short, long, coalesce(nullif(concat_ws(' | ', CASE WHEN invalid / n > 0.2 AND short > long THEN 'high: too many short texts, ask for more tokens' END, CASE WHEN invalid / n > 0.2 AND short <= long THEN 'medium: too many long texts, ask for fewer tokens' END,
    CASE WHEN fre < 60 THEN 'medium: hard to read, ask for shorter sentences' END, CASE WHEN fkg > 9 THEN 'medium: grade too high, ask for plainer words' END, CASE WHEN ttr < 0.5 THEN 'medium: words repeat, raise the penalty' END), ''), 'none') AS advice FROM s""")
def run_recommendations(spark, sf):
    return reports.recommendations(run_of(spark, sf))


@query(f"""WITH {S.SCORED}, s AS (SELECT round(avg(fre), 6) AS fre, round(avg(fkg), 6) AS fkg, round(avg((n_words BETWEEN 150 AND 250)::INT) * 100, 6) AS in_range_pct FROM scored)
    SELECT *, CASE WHEN fre BETWEEN 55 AND 75 AND fkg <= 10 AND in_range_pct >= 80 THEN CASE WHEN fre >= 60 AND fkg <= 9 THEN 'excellent' ELSE 'acceptable' END ELSE 'not ready' END AS decision FROM s""")
def run_decision(spark, sf):
    return reports.decision(L.classified(docs(spark, sf)))


@query(f"""WITH d AS (SELECT trunc(len({S.WORDS}) * 1.33::DOUBLE) / 1e6::DOUBLE * 0.15::DOUBLE AS c FROM documents) SELECT count(*) AS n, round(sum(c), 6) AS total, round(avg(c), 9) AS mean, round(avg(c) * 10000, 6) AS cost_10000, 24.0::DOUBLE AS minutes_10000,
    round(avg(c) * 20000, 6) AS cost_20000, 48.0::DOUBLE AS minutes_20000 FROM d""")
def cost_projection(spark, sf):
    d = docs(spark, sf).withColumn("cost", X.cost_usd(X.tokens_per_word("text"), F.lit(0)))
    return reports.cost_report(d, "cost")


@query(f"SELECT round(coalesce(avg(len({S.WORDS})), 0.0), 6) AS mean_words FROM documents")
def mean_words(spark, sf):
    return reports.mean_words(docs(spark, sf), "text")


_OVER = f"""over_ AS (SELECT conv_id, turn, ({S.share(S.both('a', 'b'), S.union('a', 'b'))} + {S.share(S.both('a', 'b'), 'len(b)')}) / 2.0 AS overlap
    FROM (SELECT conv_id, turn, {S.of(S.BARE.replace('lower(text)', 'lower(source)'), 'text')} AS a, {S.BARE.replace('lower(text)', 'lower(pred)')} AS b FROM triples))"""


def _overlaps(spark, sf):
    return triples(spark, sf).withColumn("overlap", L.overlap("source", "pred"))


@query(f"WITH {S.TRIPLES}, {_OVER} SELECT conv_id, turn, round(overlap, 6) AS overlap FROM over_")
def overlap_pairs(spark, sf):
    return _overlaps(spark, sf).select(*K, r6(F.col("overlap")).alias("overlap"))


@query(f"""WITH {S.TRIPLES} SELECT conv_id, turn, round({S.share(S.both('a', 'b'), S.union('a', 'b'))}, 6) AS bigrams FROM
    (SELECT conv_id, turn, list_distinct({S.grams('s', 2)}) AS a, list_distinct({S.grams('p', 2)}) AS b FROM triples)""")
def ngram_overlap(spark, sf):
    return triples(spark, sf).select(*K, r6(L.ngram_overlap("source", "pred")).alias("bigrams"))


@query(f"""WITH {S.TRIPLES}, {_OVER} SELECT count(*) AS pairs, count(*) FILTER (overlap BETWEEN 0.60 AND 0.75) AS kept, count(*) FILTER (overlap BETWEEN 0.02 AND 0.75) AS kept_wide, round(avg(overlap), 6) AS mean, round(median(overlap), 6) AS median,
    round(min(overlap), 6) AS least, round(max(overlap), 6) AS most, round(avg(len({S.of(S.WORDS, 't.source')})), 6) AS source_words, round(avg(len({S.of(S.WORDS, 't.pred')})), 6) AS pred_words, count(*) FILTER (overlap < 0.5) AS below_50, count(*) FILTER (overlap < 0.6) AS below_60, count(*) FILTER (overlap < 0.7) AS below_70 FROM over_ JOIN triples t USING (conv_id, turn)""")
def overlap_filter_stats(spark, sf):
    o = F.col("overlap")
    below = [F.count_if(o < t / 100).alias(f"below_{t}") for t in (50, 60, 70)]
    return _overlaps(spark, sf).agg(
        F.count(F.lit(1)).alias("pairs"), F.count_if(o.between(0.60, 0.75)).alias("kept"), F.count_if(o.between(0.02, 0.75)).alias("kept_wide"), r6(F.avg(o)).alias("mean"), r6(F.median(o)).alias("median"),
        r6(F.min(o)).alias("least"), r6(F.max(o)).alias("most"), r6(F.avg(X.word_count("source"))).alias("source_words"), r6(F.avg(X.word_count("pred"))).alias("pred_words"), *below,
    )


@query(f"WITH {S.TRIPLES}, {_OVER} SELECT conv_id, turn, round(overlap, 6) AS overlap FROM over_ ORDER BY over_.overlap, conv_id, turn LIMIT 3")
def topk_low_overlap(spark, sf):
    return _overlaps(spark, sf).orderBy("overlap", *K).limit(3).select(*K, r6(F.col("overlap")).alias("overlap"))


def _sari() -> tuple[str, str, str]:
    k = f"list_intersect(ss, rs)"  # noqa: F541
    n, o = S.missing("rs", "ss"), S.missing("ss", "rs")
    return S.share(S.both(k, "ps"), f"len({k})"), S.share(S.both(n, "ps"), f"len({n})"), S.share(f"len({S.missing(o, 'ps')})", f"len({o})")


@query("WITH {t}, {s} SELECT conv_id, turn, round({k}, 6) AS sari_keep, round({a}, 6) AS sari_add, round({d}, 6) AS sari_delete, round(({k} + {a} + {d}) / 3.0, 6) AS sari FROM sets".format(t=S.TRIPLES, s=S.SETS, **dict(zip("kad", _sari(), strict=True))))
def sari_set(spark, sf):
    made = M.sari_set(F.col("s"), F.col("p"), F.col("r"))
    return triples(spark, sf).select(*K, *[r6(v).alias(k) for k, v in made.items()])


@query(f"""WITH {S.TRIPLES}, {S.SETS} SELECT conv_id, turn, round(({S.share(S.both('list_intersect(ss, ps)', 'rs'), 'len(ps)')} + {S.share(f"len({S.missing('list_intersect(ps, rs)', 'ss')})", 'len(ps)')}
    + {S.share(S.both(S.missing('ss', 'ps'), 'rs'), 'len(ss)')}) / 3.0, 6) AS sari FROM sets""")
def sari_simple(spark, sf):
    return triples(spark, sf).select(*K, r6(M.sari_simple(F.col("s"), F.col("p"), F.col("r"))).alias("sari"))


def _sari_n(n: int) -> str:
    fresh, gone = S.missing(f"p{n}", f"s{n}"), S.missing(f"list_filter(s{n}, lambda x: NOT list_contains(p{n}, x))", f"r{n}")
    return f"({S.share(S.multi(f'p{n}', f's{n}'), f'len(p{n})')} + {S.share(S.multi(fresh, f'r{n}'), f'len(p{n})')} + {S.share(f'len({gone})', f'len(s{n})')}) / 3.0"


_GRAMS = f"""grams AS (SELECT conv_id, turn, s, p, r, {", ".join(f"{S.grams(x, n)} AS {x}{n}" for x in "spr" for n in (1, 2, 3, 4))} FROM triples)"""


@query(f"WITH {S.TRIPLES}, {_GRAMS} SELECT conv_id, turn, round(({' + '.join(map(_sari_n, (1, 2, 3, 4)))}) / 4.0, 6) AS sari FROM grams")
def sari_ngram(spark, sf):
    return triples(spark, sf).select(*K, r6(M.sari_ngram(F.col("s"), F.col("p"), F.col("r"))).alias("sari"))


_F1 = "CASE WHEN a + b = 0 THEN 0.0 ELSE 2.0::DOUBLE * a * b / (a + b) END"


@query(f"WITH {S.TRIPLES}, {S.SETS} SELECT conv_id, turn, round({_F1}, 6) AS meteor FROM (SELECT *, {S.share(S.both('ps', 'rs'), 'len(ps)')} AS a, {S.share(S.both('ps', 'rs'), 'len(rs)')} AS b FROM sets)")
def meteor_f1(spark, sf):
    return triples(spark, sf).select(*K, r6(M.set_f1(F.col("p"), F.col("r"))).alias("meteor"))


@query(f"WITH {S.TRIPLES}, {S.SETS} SELECT conv_id, turn, round(least(1.0, 1.5 * {S.share(S.both('ps', 'ss'), 'len(ps)')}), 6) AS factual, round({S.share(S.both('ps', 'rs'), 'len(rs)')}, 6) AS label_overlap FROM sets")
def factuality_overlap(spark, sf):
    return triples(spark, sf).select(*K, r6(M.factual(F.col("s"), F.col("p"))).alias("factual"), r6(M.label_overlap(F.col("p"), F.col("r"))).alias("label_overlap"))


def _rouge(n: int) -> str:
    return f"SELECT conv_id, turn, {n} AS n, {S.share(S.multi(f'p{n}', f'r{n}'), f'len(p{n})')} AS a, {S.share(S.multi(f'p{n}', f'r{n}'), f'len(r{n})')} AS b FROM grams"


@query(f"WITH {S.TRIPLES}, {_GRAMS} SELECT conv_id, turn, n, round(a, 6) AS p, round(b, 6) AS r, round({_F1}, 6) AS f FROM ({_rouge(1)} UNION ALL {_rouge(2)})")
def rouge_n(spark, sf):
    rows = F.array(*[F.struct(F.lit(n).alias("n"), *[r6(v).alias(k) for k, v in zip("prf", M.rouge_n(F.col("p"), F.col("r"), n), strict=True)]) for n in (1, 2)])
    return triples(spark, sf).select(*K, F.explode(rows).alias("x")).select(*K, "x.*")


def _log_hit(n: int, weight: float) -> str:
    hits = S.multi(f"p{n}", f"r{n}")
    return f"{weight}::DOUBLE * ln((CASE WHEN {hits} = 0 THEN 0.1 ELSE {hits} END)::DOUBLE / greatest(len(p{n}), 1))"


def _bleu(most: int, weight: float) -> str:
    return f"""round(CASE WHEN {S.multi("p1", "r1")} = 0 THEN 0.0 ELSE (CASE WHEN len(p) = 0 THEN 0.0 WHEN len(p) > len(r) THEN 1.0 ELSE exp(1.0 - len(r)::DOUBLE / len(p)) END)
    * exp({" + ".join(_log_hit(n, weight) for n in range(1, most + 1))}) END, 6) AS bleu{most}"""


@query(f"WITH {S.TRIPLES}, {_GRAMS} SELECT conv_id, turn, {_bleu(1, 1.0)}, {_bleu(2, 0.5)}, {_bleu(3, 0.33)}, {_bleu(4, 0.25)} FROM grams")
def bleu_n(spark, sf):
    return triples(spark, sf).select(*K, *[r6(v).alias(k) for k, v in M.bleu_family(F.col("p"), F.col("r")).items()])


_HITS = ", ".join(f"{S.multi(f'p{n}', f'r{n}')} AS h{n}, len(p{n})::BIGINT AS t{n}" for n in (1, 2, 3, 4))
_SHORT = "(CASE WHEN n = 0 THEN 0.0 WHEN n >= m THEN 1.0 ELSE exp(1.0 - m::DOUBLE / n) END)"


def _order(n: int) -> str:
    zeros = " + ".join(f"(h{k} = 0 AND t{k} > 0)::INT" for k in range(1, n + 1))
    return f"(CASE WHEN t{n} = 0 THEN 0.0 WHEN h{n} = 0 THEN -ln(pow(2.0, {zeros}) * t{n}) ELSE ln(h{n}::DOUBLE / t{n}) END)"


_LOGS = " + ".join(_order(n) for n in (1, 2, 3, 4))


@query(f"""WITH {S.TRIPLES}, {_GRAMS}, c AS (SELECT conv_id, turn, {_HITS}, len(p)::BIGINT AS n, len(r)::BIGINT AS m FROM grams)
    SELECT conv_id, turn, round(CASE WHEN h1 + h2 + h3 + h4 = 0 THEN 0.0 ELSE {_SHORT} * exp(({_LOGS}) / greatest(1, (t1 > 0)::INT + (t2 > 0)::INT + (t3 > 0)::INT + (t4 > 0)::INT)) END, 6) AS bleu FROM c""")
def bleu_smoothed(spark, sf):
    return triples(spark, sf).select(*K, r6(M.smoothed_bleu(M.gram_counts(F.col("p"), F.col("r")))).alias("bleu"))


@query(f"""WITH {S.TRIPLES}, {_GRAMS}, c AS (SELECT {_HITS}, len(p)::BIGINT AS n, len(r)::BIGINT AS m FROM grams), k AS (SELECT {", ".join(f"sum(h{n})::BIGINT AS h{n}, sum(t{n})::BIGINT AS t{n}" for n in (1, 2, 3, 4))}, sum(n)::BIGINT AS n, sum(m)::BIGINT AS m FROM c)
    SELECT round(CASE WHEN h1 + h2 + h3 + h4 = 0 THEN 0.0 ELSE {_SHORT} * exp(({_LOGS}) / 4) END, 6) AS bleu, n AS pred_size, m AS ref_size FROM k""")
def bleu_corpus(spark, sf):
    return M.corpus_bleu(triples(spark, sf), "p", "r").withColumn("bleu", r6(F.col("bleu")))


#: The table of longest common subsequences, a row for each word of the prediction: the row so far, and its running maximum.
_LCS = """list_last(list_reduce(list_prepend(list_resize(CAST([] AS INTEGER[]), len({r}) + 1, 0), list_transform({p}, lambda w: list_transform({r}, lambda v: (v = w)::INTEGER))),
    lambda row, eq: list_reduce(list_prepend([0], list_transform(range(1, len(eq) + 1), lambda i: [greatest(row[i + 1], row[i] + eq[i])])), lambda acc, x: list_append(acc, greatest(acc[len(acc)], x[1])))))"""


@query("WITH {t} SELECT conv_id, turn, round(CASE WHEN len(p) = 0 OR len(r) = 0 THEN 0.0 ELSE 2.0 * {lcs} / (len(p) + len(r)) END, 6) AS rouge_l FROM triples".format(t=S.TRIPLES, lcs=_LCS.format(p="p", r="r")))
def rouge_l(spark, sf):
    return triples(spark, sf).select(*K, r6(M.rouge_l(F.col("p"), F.col("r"))).alias("rouge_l"))


@query()
def rouge_lsum(spark, sf):
    parts = lambda c: F.transform(F.split(c, "(?<=[.!?])\\s+|\n"), lambda x: M.stemmed(M.alnum_tokens(x)))
    return triples(spark, sf).select(*K, r6(M.rouge_lsum(parts("pred"), parts("ref"))).alias("rouge_lsum"))


_ALNUM = "list_filter(regexp_split_to_array(lower({c}), '[^a-z0-9]+'), lambda x: x <> '')"


def _stemmed(tokens: str) -> str:
    """Step by step, so that no step's text is repeated."""
    out = tokens
    for pattern, by in M._STEPS:
        if pattern.startswith("([bdfg"):
            one = "CASE WHEN length(x[2]) > 1 AND right(x[2], 1) = left(right(x[2], 2), 1) AND regexp_matches(right(x[2], 1), '[bdfgmnprt]') THEN left(x[2], length(x[2]) - 1) ELSE x[2] END"
        else:
            one = f"regexp_replace(x[2], '{pattern}', '{by.replace('$', chr(92))}')"
        out = f"list_transform({out if out is not tokens else f'list_transform({tokens}, lambda y: [y, y])'}, lambda x: [x[1], {one}])"
    return f"list_transform({out}, lambda x: CASE WHEN length(x[1]) > 3 THEN x[2] ELSE x[1] END)"


@query(f"""WITH {S.TRIPLES}, w AS (SELECT conv_id, turn, {_stemmed(_ALNUM.format(c="source"))} AS a, {_stemmed(_ALNUM.format(c="pred"))} AS b FROM triples),
    g AS (SELECT *, {S.grams("a", 2)} AS a2, {S.grams("b", 2)} AS b2 FROM w), f AS (SELECT conv_id, turn, {S.share(S.multi("b", "a"), "len(b)")} AS p1, {S.share(S.multi("b", "a"), "len(a)")} AS q1,
    {S.share(S.multi("b2", "a2"), "len(b2)")} AS p2, {S.share(S.multi("b2", "a2"), "len(a2)")} AS q2 FROM g)
    SELECT conv_id, turn, round(CASE WHEN p1 + q1 = 0 THEN 0.0 ELSE 2 * p1 * q1 / (p1 + q1) END, 6) AS rouge1, round(CASE WHEN p2 + q2 = 0 THEN 0.0 ELSE 2 * p2 * q2 / (p2 + q2) END, 6) AS rouge2,
    CASE WHEN (CASE WHEN p1 + q1 = 0 THEN 0.0 ELSE 2 * p1 * q1 / (p1 + q1) END) >= 0.5 THEN 'high' WHEN (CASE WHEN p1 + q1 = 0 THEN 0.0 ELSE 2 * p1 * q1 / (p1 + q1) END) >= 0.3 THEN 'medium' ELSE 'low' END AS band FROM f""")
def rouge_retention(spark, sf):
    m = M.retention("source", "pred")
    return triples(spark, sf).select(*K, m["rouge1"].alias("r1"), r6(m["rouge2"]).alias("rouge2")).select(*K, r6(F.col("r1")).alias("rouge1"), "rouge2", M.retention_band(F.col("r1")).alias("band"))


_SENTS = "list_filter(list_transform(regexp_split_to_array(trim(pred), '[.!?]+\\s+'), lambda x: trim(x)), lambda x: length(x) > 10)"


@query(f"""WITH {S.TRIPLES}, h AS (SELECT conv_id, turn, s, unnest(CASE WHEN len({_SENTS}) > 0 THEN {_SENTS} ELSE [trim(pred)] END) AS text FROM triples),
    w AS (SELECT conv_id, turn, list_distinct({S.LOWER}) AS h, list_distinct(s) AS s FROM h WHERE length(text) >= 5), e AS (SELECT *, {S.share(S.both("h", "s"), "len(h)")} AS x FROM w)
    SELECT t.conv_id, t.turn, round(coalesce(avg(x + 0.3::DOUBLE * (1.0 - x)), 0.0), 6) AS factuality FROM triples t LEFT JOIN e USING (conv_id, turn) GROUP BY t.conv_id, t.turn""")
def factuality_sentences(spark, sf):
    return M.factuality(triples(spark, sf), list(K), "source", "pred").withColumn("factuality", r6(F.col("factuality")))


_EVAL = "compression factual rouge1 rouge2 rouge_l bleu meteor sari".split()


def _evaluated() -> str:
    pr = lambda a, b: f"(CASE WHEN {a} + {b} = 0 THEN 0.0 ELSE 2.0::DOUBLE * {a} * {b} / ({a} + {b}) END)"
    part = lambda n: (S.share(S.multi(f"p{n}", f"r{n}"), f"len(p{n})"), S.share(S.multi(f"p{n}", f"r{n}"), f"len(r{n})"))
    k, a, d = _sari()
    return f"""{S.TRIPLES}, {_GRAMS}, {S.SETS}, evaluated AS (SELECT g.conv_id, g.turn, {S.share("len(g.p)", "len(g.s)")} AS compression, least(1.0, 1.5 * {S.share(S.both('ps', 'ss'), 'len(ps)')}) AS factual,
        {pr(*part(1))} AS rouge1, {pr(*part(2))} AS rouge2, CASE WHEN len(g.p) = 0 OR len(g.r) = 0 THEN 0.0 ELSE 2.0 * {_LCS.format(p="g.p", r="g.r")} / (len(g.p) + len(g.r)) END AS rouge_l,
        {_bleu(4, 0.25).replace("round(", "(").replace(", 6) AS bleu4", ") AS bleu").replace("len(p)", "len(g.p)").replace("len(r)", "len(g.r)")}, {pr(S.share(S.both('ps', 'rs'), 'len(ps)'), S.share(S.both('ps', 'rs'), 'len(rs)'))} AS meteor, ({k} + {a} + {d}) / 3.0 AS sari
        FROM grams g JOIN sets USING (conv_id, turn))"""


@query(f"WITH {_evaluated()} SELECT conv_id, turn, " + ", ".join(f"round({m}, 6) AS {m}" for m in _EVAL) + " FROM evaluated")
def evaluate_all(spark, sf):
    out = M.evaluate(triples(spark, sf).select(*K, "source", "pred", "ref"), "source", "pred", "ref")
    return out.select(*K, *[r6(F.col(m)).alias(m) for m in _EVAL])


@query(f"WITH {_evaluated()} SELECT *, rouge_l >= 0.35 AS rouge_l_ok, bleu >= 0.3 AS bleu_ok, sari >= 0.4 AS sari_ok FROM (SELECT count(*) AS n, " + ", ".join(f"round(avg({m}), 6) AS {m}" for m in _EVAL) + " FROM evaluated)")
def corpus_means(spark, sf):
    out = M.evaluate(triples(spark, sf).select(*K, "source", "pred", "ref"), "source", "pred", "ref")
    return M.target_checks(M.corpus_means(out, _EVAL))


@query(f"""WITH {_PAIRS}, {S.SCORED} SELECT conv_id, turn, round(fre, 6) AS flesch, round(fkg, 6) AS kincaid, round({S.share("n_words", f"len({S.of(S.WORDS, 'original')})")}, 6) AS compression, n_words AS summary_words FROM scored""")
def evaluate_without_reference(spark, sf):
    out = M.evaluate(triples(spark, sf).select(*K, "source", "pred"), "source", "pred")
    return out.select(*K, *[r6(F.col(m)).alias(m) for m in ("flesch", "kincaid", "compression")], X.word_count("pred").alias("summary_words"))


@query("WITH {t}, {s}, x AS (SELECT conv_id, turn, round(({k} + {a} + {d}) / 3.0, 6) AS sari FROM sets) SELECT * FROM ((SELECT 'best' AS which, * FROM x ORDER BY sari DESC, conv_id, turn LIMIT 3) UNION ALL (SELECT 'worst', * FROM x ORDER BY sari, conv_id, turn LIMIT 3))".format(t=S.TRIPLES, s=S.SETS, **dict(zip("kad", _sari(), strict=True))))
def sari_extremes(spark, sf):
    x = triples(spark, sf).select(*K, r6(M.sari_set(F.col("s"), F.col("p"), F.col("r"))["sari"]).alias("sari"))
    pick = lambda name, order: x.orderBy(order, *K).limit(3).select(F.lit(name).alias("which"), *K, "sari")
    return pick("best", F.desc("sari")).unionByName(pick("worst", F.asc("sari")))


_CHUNKS = f"""chunks AS (SELECT doc_id, unnest(generate_series(0, greatest(0, ceil((len(w) - 450) / 400.0)::BIGINT))) AS chunk_id, w FROM (SELECT doc_id, {S.WORDS} AS w FROM documents) WHERE len(w) > 0)"""


@query(f"""WITH {_CHUNKS} SELECT doc_id, chunk_id::INTEGER AS chunk_id, (count(*) OVER (PARTITION BY doc_id))::INTEGER AS total_chunks, len(w)::INTEGER AS original_tokens,
    len(w[chunk_id * 400 + 1 : chunk_id * 400 + 450])::INTEGER AS chunk_tokens, md5(array_to_string(w[chunk_id * 400 + 1 : chunk_id * 400 + 450], ' ')) AS key FROM chunks""")
def chunk_tokens(spark, sf):
    out = chunking.expand_tokens(docs(spark, sf).select("doc_id", "text"), "text")
    return out.select("doc_id", "chunk_id", "total_chunks", "original_tokens", "chunk_tokens", F.md5("chunk").alias("key"))


@query(f"""WITH {S.TRIPLES}, c AS (SELECT conv_id, turn, w, v, greatest(0, ceil((len(v) - 40) / 30.0)::BIGINT) AS last, unnest(generate_series(0, greatest(0, ceil((len(w) - 40) / 30.0)::BIGINT))) AS i
    FROM (SELECT conv_id, turn, {S.of(S.WORDS, 'source')} AS w, {S.of(S.WORDS, 'pred')} AS v FROM triples) WHERE len(w) > 0)
    SELECT conv_id, turn, i::INTEGER AS chunk_id, md5(array_to_string(w[i * 30 + 1 : i * 30 + 40], ' ')) AS source_key, md5(array_to_string(v[least(i, last) * 30 + 1 : least(i, last) * 30 + 40], ' ')) AS target_key FROM c""")
def chunk_expand_pairs(spark, sf):
    out = chunking.expand_pairs(triples(spark, sf).select(*K, "source", "pred"), "source", "pred", 40, 10)
    return out.select(*K, "chunk_id", F.md5("source_chunk").alias("source_key"), F.md5("target_chunk").alias("target_key"))


@query()
def chunk_paragraphs(spark, sf):
    return chunking.chunked(docs(spark, sf).select("doc_id", "text"), "text", "paragraphs", keep_text=False)


@query()
def chunk_semantic(spark, sf):
    return chunking.chunked(docs(spark, sf).select("doc_id", "text"), "text", "semantic", keep_text=False)


@query()
def chunk_recursive(spark, sf):
    return chunking.chunked(docs(spark, sf).select("doc_id", "text"), "text", "recursive", keep_text=False)


@query(f"""WITH {_CHUNKS.replace("450", "400").replace("/ 400.0", "/ 350.0")}, n AS (SELECT 'before' AS "when", len({S.WORDS})::BIGINT AS n FROM documents UNION ALL SELECT 'after', len(w[chunk_id * 350 + 1 : chunk_id * 350 + 400])::BIGINT FROM chunks)
    SELECT *, CASE WHEN truncated_pct > 50 THEN 'chunk' WHEN truncated_pct > 20 THEN 'consider chunking' ELSE 'fine' END AS advice, CASE WHEN mean_lost > 100 THEN 'much lost' WHEN mean_lost > 50 THEN 'some lost' ELSE 'little lost' END AS loss FROM (SELECT "when", count(*) AS "rows", count(*) FILTER (n > 400) AS truncated, round(100.0::DOUBLE * count(*) FILTER (n > 400) / count(*), 6) AS truncated_pct,
    round(coalesce(avg(n - 400) FILTER (n > 400), 0.0), 6) AS mean_lost, round(coalesce(avg(100.0::DOUBLE * (n - 400) / n) FILTER (n > 400), 0.0), 6) AS mean_lost_pct, coalesce(sum(n - 400) FILTER (n > 400), 0)::BIGINT AS total_lost, round(avg(greatest(n - 400, 0)), 6) AS mean_lost_all FROM n GROUP BY "when")""")
def chunking_before_after(spark, sf):
    return reports.before_and_after(docs(spark, sf), "text", 400, 50)


@query(f"""WITH {S.TRIPLES}, n AS (SELECT len({S.of(S.WORDS, 'source')})::BIGINT + 1 AS a, len({S.of(S.WORDS, 'pred')})::BIGINT + 1 AS b FROM triples) SELECT round(avg(a), 6) AS source_mean, round(median(a), 6) AS source_median, max(a) AS source_most,
    count(*) FILTER (a > 64) AS truncated, round(100.0::DOUBLE * count(*) FILTER (a > 64) / count(*), 6) AS truncated_pct, round(avg(b), 6) AS target_mean, round(median(b), 6) AS target_median, max(b) AS target_most FROM n""")
def short_length_stats(spark, sf):
    return reports.short_lengths(triples(spark, sf), "source", "pred", 64)


@query(f"SELECT count(*) AS n, round(avg(n), 6) AS mean, round(stddev_pop(n), 6) AS std, min(n) AS least, max(n) AS most, {_Q.replace('n_chars', 'n')} FROM (SELECT len({S.WORDS})::BIGINT AS n FROM documents)")
def token_length_stats(spark, sf):
    return stats.describe(docs(spark, sf).select(X.word_count("text").alias("n_tokens")), "n_tokens", population=True)


_PROMPT = X.PROMPTS["concise"]


@query(f"""WITH w AS (SELECT doc_id, source, text, {S.WORDS} AS w, len({S.WORDS}) + {len(_PROMPT.split())} <= 512 AS fits FROM documents), c AS (SELECT *, unnest(generate_series(0, CASE WHEN fits THEN 0 ELSE greatest(0, ceil((len(w) - 400) / 350.0)::BIGINT) END)) AS i FROM w)
    SELECT doc_id, i::INTEGER AS chunk_id, (count(*) OVER (PARTITION BY doc_id))::INTEGER AS total_chunks, source AS target, md5(CASE WHEN fits THEN text ELSE array_to_string(w[i * 350 + 1 : i * 350 + 400], ' ') END) AS key FROM c""")
def chunk_same_target(spark, sf):
    out = chunking.expand_same_target(docs(spark, sf).select("doc_id", "text", "source"), "text", "source", _PROMPT)
    return out.select("doc_id", "chunk_id", "total_chunks", "target", F.md5("input").alias("key"))


@query(f"""WITH {_CHUNKS} SELECT c.doc_id, c.chunk_id::INTEGER AS chunk_id, coalesce(left(o.text, 40), '') AS original FROM chunks c LEFT JOIN (SELECT * FROM documents WHERE doc_id % 3 > 0) o USING (doc_id)""")
def chunk_originals(spark, sf):
    chunks = chunking.expand_tokens(docs(spark, sf).select("doc_id", "text"), "text").select("doc_id", "chunk_id")
    known = docs(spark, sf).filter("doc_id % 3 > 0").select(F.col("doc_id").alias("id"), F.substring("text", 1, 40).alias("begin"))
    return chunking.with_originals(chunks.withColumnRenamed("doc_id", "doc"), known.withColumnRenamed("id", "doc"), "doc", "begin").withColumnRenamed("doc", "doc_id")


@query(f"""WITH {_CHUNKS.replace("450", "400").replace("/ 400.0", "/ 350.0")} SELECT d.doc_id, coalesce(string_agg('<' || left(array_to_string(w[chunk_id * 350 + 1 : chunk_id * 350 + 400], ' '), 20) || '>', ' ' ORDER BY chunk_id), '') AS processed FROM documents d LEFT JOIN chunks USING (doc_id) GROUP BY d.doc_id""")
def chunk_map(spark, sf):
    return chunking.map_chunks(docs(spark, sf), "text", lambda c: F.concat(F.lit("<"), F.substring(c, 1, 20), F.lit(">"))).select("doc_id", "processed")


@query()
def chunk_mixed_pairs(spark, sf):
    return chunking.expand_mixed(triples(spark, sf).select(*K, "source", "pred"), "source", "pred", 40)


@query()
def chunk_prompted(spark, sf):
    out = chunking.expand_prompted(docs(spark, sf).select("doc_id", "text"), "text", X.PROMPT, 128, 15, 20)
    return out.select("doc_id", "chunk_id", "chunk")


_IDS = "list_transform({w}[1:{n}], lambda x: (('0x' || substr(md5(x), 1, 6))::BIGINT % 31999 + 1)::INTEGER)"
_IN, _OUT_IDS = _IDS.format(w=S.of(S.WORDS, f"'{_PROMPT}' || source"), n=32), _IDS.format(w=S.of(S.WORDS, "pred"), n=16)


@query(f"""WITH {S.TRIPLES}, t AS (SELECT conv_id, turn, {_IN} AS a, {_OUT_IDS} AS b FROM triples) SELECT conv_id, turn, array_to_string(list_resize(a, 32, 0), ' ') AS input_ids,
    list_sum(list_resize(list_transform(a, lambda x: 1), 32, 0))::BIGINT AS attended, array_to_string(list_resize(b, 16, -100), ' ') AS labels FROM t""")
def tokenised_pairs(spark, sf):
    t = chunking.tokenised(triples(spark, sf).select(*K, "source", "pred"), "source", "pred", _PROMPT, 32, 16)
    return t.select(*K, F.array_join("input_ids", " ").alias("input_ids"), F.aggregate("attention_mask", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("attended"), F.array_join("labels", " ").alias("labels"))


@query("""WITH k AS (SELECT text, row_number() OVER (ORDER BY sha256('42|' || text), text) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT text FROM documents)), c AS (SELECT *, floor(0.8::DOUBLE * n + 0.5)::BIGINT AS cut FROM k)
    SELECT doc_id, CASE WHEN r <= cut THEN 'train' WHEN r <= cut + (n - cut + 1) // 2 THEN 'dev' ELSE 'test' END AS split FROM documents JOIN c USING (text)""")
def split_two_steps(spark, sf):
    return splits.split_two_steps(docs(spark, sf), F.col("text")).select("doc_id", "split")


@query(f"""WITH g AS (SELECT doc_id, lang, CASE WHEN doc_id % 7 = 0 THEN 'test' WHEN doc_id % 7 < 4 THEN 'train' END AS split FROM documents), i AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY sha256('42|' || doc_id), doc_id) <= round_even(0.2::DOUBLE * count(*) OVER (PARTITION BY lang), 0) AS chosen FROM g WHERE split IS NULL),
    b AS (SELECT doc_id, lang, split, 'original' AS split_method FROM g WHERE split IS NOT NULL UNION ALL SELECT doc_id, lang, CASE WHEN chosen THEN 'test' ELSE 'train' END, 'internal' FROM i),
    d AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY sha256('42dev|' || doc_id), doc_id) <= round_even(0.1::DOUBLE * count(*) OVER (PARTITION BY lang), 0) AS chosen FROM b WHERE split = 'train')
    SELECT doc_id, split, split_method FROM b WHERE split <> 'train' UNION ALL SELECT doc_id, CASE WHEN chosen THEN 'dev' ELSE split END, CASE WHEN chosen THEN 'internal_dev' ELSE split_method END FROM d""")
def split_respecting_given(spark, sf):
    d = docs(spark, sf).withColumn("split", F.when(F.col("doc_id") % 7 == 0, "test").when(F.col("doc_id") % 7 < 4, "train"))
    return splits.split_existing(d.select("doc_id", "lang", "split"), "doc_id", "lang").select("doc_id", "split", "split_method")


@query("SELECT doc_id, quality, ((row_number() OVER (PARTITION BY quality ORDER BY sha256('42|' || doc_id), doc_id) - 1) % 5)::INTEGER AS fold FROM labels")
def cross_validation_folds(spark, sf):
    return classify.folds(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id", "quality").select("doc_id", "quality", "fold")


@query("SELECT doc_id, quality, count(*) OVER () / (2.0::DOUBLE * count(*) OVER (PARTITION BY quality)) AS weight FROM labels WHERE quality IS NOT NULL")
def class_weights(spark, sf):
    return classify.weighted(spark.read.parquet(f"{sf}/labels.parquet").filter("quality IS NOT NULL"), "quality").select("doc_id", "quality", "weight")


@query(f"""WITH {S.TRIPLES}, n AS (SELECT len({S.of(S.WORDS, 'source')}) AS a, len({S.of(S.WORDS, 'pred')}) AS b, source FROM triples), s AS (SELECT count(*) AS "rows", round(avg(a), 6) AS source_words, round(avg(b), 6) AS target_words,
    count(*) FILTER (a = 0) AS blank_sources, count(*) FILTER (b = 0) AS blank_targets, count(source) - count(DISTINCT source) AS repeated_sources FROM n)
    SELECT *, "rows" >= 100 AS size_ok, target_words / source_words BETWEEN 0.1 AND 1.0 AS ratio_ok, blank_sources = 0 AND blank_targets = 0 AS blanks_ok, repeated_sources = 0 AS distinct_ok FROM s""")
def sanity_checks(spark, sf):
    return splits.sanity(triples(spark, sf), "source", "pred")


@query(f"WITH {S.SCORED} SELECT doc_id FROM judged WHERE fre >= 55 AND fkg <= 10 AND n_words BETWEEN 150 AND 250 AND confidence >= 0.5")
def approved_documents(spark, sf):
    return filters.approved(L.classified(docs(spark, sf)), {k: F.expr(v) for k, v in STEPS.items()}).select("doc_id")


_PRED = f"{S.SCORED}, pred AS (SELECT j.*, quality, (confidence >= 0.75)::INT AS pred FROM judged j JOIN labels USING (doc_id))"


def _predicted(spark, sf):
    return L.classified(labelled(spark, sf)).withColumn("pred", (F.col("confidence") >= 0.75).cast("int"))


@query(f"WITH {_PRED} SELECT quality, pred, count(*) AS n FROM pred GROUP BY ALL")
def confusion_matrix(spark, sf):
    return stats.confusion(_predicted(spark, sf), "quality", "pred")


def _class_sql(by: str, having: str = "") -> str:
    d = lambda a, b: f"(CASE WHEN {b} = 0 THEN 0.0::DOUBLE ELSE ({a})::DOUBLE / ({b}) END)"
    f1, f0 = d("2 * tp", "(2 * tp + fp + fn)"), d("2 * tn", "(2 * tn + fp + fn)")
    g = by and f"{by}, "
    return f"""WITH {_PRED}, c AS (SELECT {g}count(*) AS n, count(*) FILTER (quality = 1 AND pred = 1) AS tp, count(*) FILTER (quality <> 1 AND pred = 1) AS fp, count(*) FILTER (quality = 1 AND pred <> 1) AS fn,
        count(*) FILTER (quality <> 1 AND pred <> 1) AS tn FROM pred {by and 'GROUP BY ' + by} {having}) SELECT {g}n, round({d('tp + tn', 'n')}, 6) AS accuracy, round({d('tp', '(tp + fp)')}, 6) AS "precision",
        round({d('tp', '(tp + fn)')}, 6) AS recall, round({f1}, 6) AS f1, round(({f1} + {f0}) / 2.0, 6) AS macro_f1, round(({f1} * (tp + fn) + {f0} * (tn + fp)) / n, 6) AS weighted_f1 FROM c"""


@query(_class_sql(""))
def class_metrics(spark, sf):
    return stats.class_metrics(_predicted(spark, sf), "quality", "pred")


@query(_class_sql("source", "HAVING count(*) >= 10"))
def source_metrics(spark, sf):
    return stats.class_metrics(_predicted(spark, sf), "quality", "pred", ["source"], 10)


@query(f"""WITH {_PRED}, e AS (SELECT doc_id, text, CASE WHEN quality = 0 AND pred = 1 THEN 'false_positive' WHEN quality = 1 AND pred = 0 THEN 'false_negative' END AS kind FROM pred)
    SELECT kind, count(*) AS n, min(doc_id) AS first_id, arg_min(CASE WHEN length(text) > 200 THEN left(text, 200) || '...' ELSE text END, doc_id) AS first_text FROM e WHERE kind IS NOT NULL GROUP BY kind""")
def error_examples(spark, sf):
    return reports.errors(_predicted(spark, sf), "quality", "pred", "doc_id", "text")


_RANKS = f"""WITH {_PRED}, r AS (SELECT quality, rank() OVER (ORDER BY round(fre, 6)) + (count(*) OVER (PARTITION BY round(fre, 6)) - 1) / 2.0 AS k FROM pred),
    u AS (SELECT count(*) FILTER (quality = 1) AS n1, count(*) FILTER (quality = 0) AS n0, sum(k) FILTER (quality = 1) AS r1 FROM r)"""


def _ranked(spark, sf):
    return _predicted(spark, sf).withColumn("fre", r6(F.col("fre")))


@query(f"{_RANKS} SELECT round((r1 - n1 * (n1 + 1) / 2.0) / (n1 * n0), 6) AS auc FROM u")
def roc_auc(spark, sf):
    return stats.roc_auc(_ranked(spark, sf), "fre", "quality")


@query(f"{_RANKS} SELECT n1, n0, (r1 - n1 * (n1 + 1) / 2.0)::DOUBLE AS u FROM u")
def mann_whitney_u(spark, sf):
    return stats.mann_whitney(_ranked(spark, sf), "fre", "quality")


@query("""WITH t AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: length(x) > 1)) AS term FROM documents),
    tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL), c AS (SELECT term, count(*) AS df, sum(tf) AS occurs FROM tf GROUP BY term), n AS (SELECT count(*) AS docs FROM documents),
    k AS (SELECT * FROM c, n WHERE df >= 2 AND df <= 0.95 * docs ORDER BY occurs DESC, term LIMIT 10000), w AS (SELECT doc_id, term, tf, tf * (ln((1.0::DOUBLE + docs) / (1.0::DOUBLE + df)) + 1) AS raw FROM tf JOIN k USING (term))
    SELECT doc_id, term, tf, round(raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id)), 6) AS weight FROM w""")
def tfidf_terms(spark, sf):
    return stats.tfidf(docs(spark, sf), "doc_id", "text")


@query(f"SELECT doc_id, array_to_string(list_filter(list_transform(range(1, len(w) + 1), lambda i: CASE WHEN i = 1 OR w[i] <> w[i - 1] THEN w[i] END), lambda x: x IS NOT NULL), ' ') AS text FROM (SELECT doc_id, {S.WORDS} AS w FROM documents)")
def dedup_adjacent_words(spark, sf):
    return docs(spark, sf).select("doc_id", X.without_echo("text").alias("text"))


@query(f"""WITH {S.SCORED}, m AS (SELECT source, count(*) AS n, round(avg(fre), 6) AS fre, round(avg(fkg), 6) AS fkg, round(avg(n_words), 6) AS n_words, round(avg((n_words BETWEEN 150 AND 250)::INT) * 100, 6) AS in_range_pct FROM scored GROUP BY source),
    p AS (SELECT *, (CASE WHEN fre BETWEEN 60 AND 70 THEN 3 WHEN fre BETWEEN 55 AND 75 THEN 1 ELSE 0 END + CASE WHEN fkg BETWEEN 7 AND 9 THEN 3 WHEN fkg <= 10 THEN 1 ELSE 0 END
    + CASE WHEN in_range_pct >= 90 THEN 2 WHEN in_range_pct >= 80 THEN 1 ELSE 0 END)::INT AS points FROM m) SELECT *, source = (SELECT source FROM p ORDER BY points DESC, source LIMIT 1) AS winner FROM p""")
def version_compare(spark, sf):
    return reports.compare_runs(L.classified(docs(spark, sf)), "source")


@query(f"""WITH {_RUN}, m AS (SELECT source, avg(valid::INT) * 100 AS v, least(100.0, greatest(0.0, (avg(fre) - 40) / 30 * 100)) AS f, least(100.0, avg(ttr) / 0.7 * 100) AS t, least(100.0, (1.0 - avg(repeated_trigrams) / 0.2) * 100) AS r FROM run GROUP BY source)
    SELECT source, round(v, 6) AS validity, round(f, 6) AS reading, round(t, 6) AS variety, round(r, 6) AS freshness, round((v + f + t + r) / 4, 6) AS score FROM m""")
def composite_score(spark, sf):
    return reports.run_score(run_of(spark, sf), ["source"])


@query(f"""WITH {S.TRIPLES}, c AS (SELECT conv_id, turn, len(r)::BIGINT AS truth_words, len(s)::BIGINT AS baseline_words, len(p)::BIGINT AS improved_words FROM triples)
    SELECT *, abs(baseline_words - truth_words) AS baseline_off, abs(improved_words - truth_words) AS improved_off, abs(baseline_words - truth_words) - abs(improved_words - truth_words) AS improvement FROM c""")
def model_comparison(spark, sf):
    t = reports.compare_models(triples(spark, sf).select(*K, "source", "pred", "ref"), "ref", "source", "pred")
    return t.select(*K, *[f"{k}_words" for k in ("truth", "baseline", "improved")], "baseline_off", "improved_off", "improvement")


@query(f"""WITH {S.TRIPLES}, c AS (SELECT abs(len(s) - len(r)) AS a, abs(len(p) - len(r)) AS b FROM triples) SELECT count(*) AS n, round(avg(a), 6) AS baseline_off, round(avg(b), 6) AS improved_off,
    round(avg(a) - avg(b), 6) AS gain, round(100.0 * count(*) FILTER (a > b) / count(*), 6) AS improved_pct FROM c""")
def model_comparison_summary(spark, sf):
    return reports.comparison_summary(reports.compare_models(triples(spark, sf).select("source", "pred", "ref"), "ref", "source", "pred"))


@query(f"""WITH g AS (SELECT DISTINCT unnest({S.grams('w', 8)}) AS gram FROM (SELECT {S.LOWER} AS w FROM benchmark)),
    d AS (SELECT doc_id, unnest({S.grams('w', 8)}) AS gram FROM (SELECT doc_id, {S.LOWER} AS w FROM documents)) SELECT DISTINCT doc_id FROM d SEMI JOIN g USING (gram)""")
def decontaminate_ngrams(spark, sf):
    return dedup.contaminated(docs(spark, sf), spark.read.parquet(f"{sf}/benchmark.parquet"), "doc_id")


def _rewritten() -> str:
    out = "text"
    for old, new in rewrite.RULES.items():
        out = f"(CASE WHEN ('0x' || substr(md5(doc_id || '|{old}'), 1, 6))::BIGINT::DOUBLE / 16777216.0 < 0.5 THEN regexp_replace({out}, '(^|[ \\n]){old}($|[ \\n])', '\\1{new}\\2', 'gi') ELSE {out} END)"
    return out


@query(f"SELECT doc_id, {_rewritten()} AS text FROM documents")
def rewrite_terms(spark, sf):
    return docs(spark, sf).select("doc_id", rewrite.replace_terms(F.col("text"), "doc_id").alias("text"))


@query()
def rewrite_complex(spark, sf):
    return docs(spark, sf).select("doc_id", rewrite.complexified(F.col("text"), "doc_id").alias("text"))


@query(r"""SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM pages""")
def strip_html(spark, sf):
    p = spark.read.parquet(f"{sf}/pages.parquet")
    return p.select("page_id", F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host"), F.trim(F.regexp_replace(F.regexp_replace("html", "<[^>]*>", " "), "\\s+", " ")).alias("text"))


@query("SELECT least(greatest(floor(n_chars / 500.0)::BIGINT + 1, 0), 11)::BIGINT AS bin, count(*) AS n FROM documents GROUP BY ALL")
def length_histogram(spark, sf):
    return stats.histogram(docs(spark, sf), "n_chars", 0.0, 5000.0, 10)


@query("SELECT doc_id FROM documents ORDER BY sha256('42|' || doc_id), doc_id LIMIT 100")
def random_sample(spark, sf):
    return splits.sample(docs(spark, sf), "doc_id", 100).select("doc_id")


@query()
def detect_language(spark, sf):
    return docs(spark, sf).select("doc_id", providers.detect_language("text").alias("lang"))


@query()
def tfidf_logreg_scores(spark, sf):
    train = labelled(spark, sf).select("doc_id", "text", F.col("quality").alias("label"))
    return classify.score(classify.fit(train), docs(spark, sf).select("doc_id", "text")).select("doc_id", r6(F.col("p_plain")).alias("p_plain"))
