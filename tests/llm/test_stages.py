"""The pipeline's stages on odd rows and empty tables, and its five-word near-duplicate stage against every pair."""

import itertools
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallyline.llm import quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept int, id int"


def prose(seed, n=120):
    return " ".join(f"w{(i * i + seed * 31 * i + seed) % 997}" for i in range(n))


def odd_rows():
    rows = [(1, None, "en", "a"), (2, "", "en", "a"), (3, " \n\t", None, None), (None, prose(1), "en", "a"), (None, None, None, None), (4, prose(2), "en", "b"), (4, prose(2), "en", "b"), (5, prose(3, 150_000), "en", "a"), (6, prose(4), "", ""), (7, prose(5), "en", "a"), (8, prose(5) + " tail", "en", "a")]
    return [(*r, len(r[1] or ""), 5, 9) for r in rows]


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    """Labels and benchmark with null ids, null texts, ties and repeats; item 2 lies inside document 6."""
    base = f"file://{tmp_path_factory.mktemp('stages')}"
    spark.createDataFrame([(i, i % 2, 0) for i in range(9)] + [(None, 1, 0), (4, 1, None), (4, None, 1)], "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{base}/labels.parquet")
    inside = " ".join(prose(4).split()[20:60])
    spark.createDataFrame([(1, None), (2, inside), (None, inside), (3, ""), (2, inside)], "item_id long, text string").coalesce(1).write.parquet(f"{base}/benchmark.parquet")
    return base


def key(r):
    return (r.doc_id is None, r.doc_id or 0, r.text or "")


def test_stages_on_odd_rows(spark, sf_dir):
    docs = spark.createDataFrame(odd_rows(), SCHEMA)
    stage = dict(corpus_pipeline.STAGES)
    run = lambda name: sorted(stage[name](spark, docs, sf_dir).collect(), key=key)
    good = run("quality_rules")
    assert all(r.text and r.text.strip() for r in good) and {r.text for r in good} <= {r[1] for r in odd_rows()}
    near = run("near_duplicates")  # 8 links with 7; both rows of 4 are one node; texts without words and null ids stay
    assert [r.doc_id for r in near] == [1, 2, 3, 4, 4, 5, 6, 7, None, None]
    clean = run("decontamination")
    assert [r.doc_id for r in clean] == [1, 2, 3, 4, 4, 5, 7, 8, None, None]
    mix = run("source_mix")
    assert {tuple(r) for r in mix} <= set(odd_rows()) and all((r.kept, r.id) == (5, 9) for r in mix)
    assert run("source_mix") == mix
    ids = stage["token_output"](spark, docs, sf_dir)
    assert ids.count() == len(odd_rows()) and ids.agg(F.min("n_tokens")).first()[0] == 1  # a text without words has its end id only


def test_stages_on_an_empty_table(spark, sf_dir):
    docs = spark.createDataFrame([], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        assert out.count() == 0 and (name == "token_output" or out.columns == docs.columns)


def test_near_duplicate_stage_is_brute_force(spark):
    """Chains of edits: links of five-word shingles at 0.8, on both sides of the bound."""
    texts = {}
    for g in range(12):
        words = prose(g + 10, 60 + 5 * g).split()
        for step in range(6):
            texts[g * 10 + step] = " ".join(words)
            for j in range(1 + g % 4):
                words[(17 * step + 23 * j + g) % len(words)] = f"new{g}x{step}x{j}"
    texts |= {200: "One two", 201: "one  TWO", 202: "one two three", 203: "", 204: None}
    rows = [(i, t, "en", "s", 0, 0, 0) for i, t in texts.items()]
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), "").collect()}

    def shingles(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()

    sets, least = {i: shingles(t) for i, t in texts.items()}, {i: i for i in texts}

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    links = 0
    for a, b in itertools.combinations(texts, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * len(sets[a] | sets[b]):
            links += 1
            low, high = sorted((root(a), root(b)))
            least[high] = low
    assert links > 20 and kept == {i for i in texts if root(i) == i} and len(kept) < len(texts)


def test_forest_fit_is_the_same_wherever_rows_lie(spark):
    """Ids repeat beyond the bound of the fit: the same rows are taken in any order and partitioning."""
    rows = [(i % 5, prose(i, 60 + i), "en", "s", 0, 0, 0) for i in range(80)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(5)], "doc_id long, quality int")
    scores = []
    for docs in (spark.createDataFrame(rows, SCHEMA).coalesce(1), spark.createDataFrame(rows[::-1], SCHEMA).repartition(7)):
        forest = quality.fit_forest(docs, labels, fit_rows=5)
        scores.append(sorted((r.doc_id, r.n_words, r.anomaly_score, r.kept) for r in quality.judge_quality(docs, forest).collect()))
    assert scores[0] == scores[1]
