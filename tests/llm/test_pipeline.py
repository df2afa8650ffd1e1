"""The pipeline's stages against brute force on the smallest documents, and on hostile rows."""

from collections import Counter

import pytest

import corpus_pipeline
from quarry.llm import bpe, mixing, pii, token_counts
from quarry.llm.text import shingles, words

SF = "/root/testdata/sf0.001"
KIND = "doc_id long, text string, lang string, source string, n_chars long, key string, copy string, shard string, token_ids string"
EDGES = [(1, None, "a"), (2, "", "a"), (None, "some text here", None), (3, "one", ""), (3, "one", ""), (4, "word " * 40_000, "a")]


def hostile(spark, rows=EDGES):
    return spark.createDataFrame([(i, t, None, s, None, "k", "c", "s", "t") for i, t, s in rows], KIND)


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """The documents and what each stage made of its predecessor's rows."""
    folder = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    out["documents"] = docs.collect()
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(folder / name))
        docs = spark.read.parquet(str(folder / name))
        out[name] = docs.collect()
    return out


def test_rules_follow_the_labels(spark, steps):
    kept = {r.doc_id for r in steps["quality_rules"]}
    assert set(map(tuple, steps["quality_rules"])) <= set(map(tuple, steps["documents"]))
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    held = {r.doc_id for r in steps["documents"] if r.text} & set(labels)
    good = [d for d in held if labels[d] == 1]
    assert sum(d in kept for d in good) >= 0.97 * len(good)
    assert sum((d in kept) == (labels[d] == 1) for d in held) >= 0.95 * len(held)


def test_one_of_each_group_stays(steps):
    rows = steps["quality_rules"]
    h, o, _, _ = words([r.text for r in rows])
    runs, at = shingles(h, o, 3)
    sets = [set(runs[a:b].tolist()) for a, b in zip(at, at[1:], strict=False)]
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and len(sets[i] & sets[j]) >= 0.6 * len(sets[i] | sets[j])]
    left = Counter(tuple(r) for r in steps["near_duplicates"])
    assert not left - Counter(tuple(r) for r in rows)
    stays = [tuple(r) in left for r in rows]
    assert pairs and sum(stays[i] and stays[j] for i, j in pairs) <= 0.1 * len(pairs)
    # What has no partner stays.
    partnered = {k for pair in pairs for k in pair}
    assert all(stays[k] for k in range(len(rows)) if k not in partnered and len(sets[k]))


def test_personal_data_is_replaced_row_by_row(steps):
    want = Counter()
    for r in steps["near_duplicates"]:
        text = pii.redacted(r.text, pii.find_spans(r.text))
        want[(r.doc_id, text, r.lang, r.source, len(text))] += 1
    assert Counter((r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in steps["personal_data"]) == want


def test_sources_have_their_shares(steps):
    before, after = (Counter(r.source for r in steps[name]) for name in ("personal_data", "mixture"))
    weight = {s: mixing.WEIGHTS.get(s, mixing.OTHERS) for s in before}
    for s in before:
        assert abs(after[s] - sum(before.values()) * weight[s] / sum(weight.values())) <= 1
    assert {tuple(r) for r in steps["mixture"]} <= {tuple(r) for r in steps["personal_data"]}


def test_ids_are_those_of_the_library(steps):
    import public_tokenizers as P
    import tiktoken

    ranks = {t: k for k, t in enumerate(token_counts.read_ranks(bpe.tokenizer_file(bpe.VOCABULARY)))}
    exact = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert len(steps["tokens"]) == len(steps["mixture"])
    assert Counter((r.doc_id, tuple(r.token_ids)) for r in steps["tokens"]) == Counter((r.doc_id, tuple(exact.encode_ordinary(r.text))) for r in steps["mixture"])


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES)
def test_stages_on_hostile_rows(spark, name, stage):
    docs = hostile(spark)
    got = stage(spark, docs, SF)
    rows = got.collect()
    if name != "tokens":
        assert got.columns == docs.columns
    if name == "quality_rules":
        assert all(r.text for r in rows)
    if name == "near_duplicates":
        assert Counter(r.doc_id for r in rows) == Counter([1, 2, None, 3, 4])
    if name == "personal_data":
        assert Counter((r.doc_id, r.text) for r in rows) == Counter((i, t) for i, t, _ in EDGES)
    if name == "mixture":
        assert all(abs(sum(r.source == s for r in rows) - 2) <= 1 for s in ("a", "", None))
    if name == "tokens":
        ids = {r.doc_id: r.token_ids for r in rows}
        assert len(rows) == len(EDGES) and not ids[1] and ids[2] == [] and len(ids[4]) >= 40_000
    assert stage(spark, hostile(spark, []), SF).collect() == []
