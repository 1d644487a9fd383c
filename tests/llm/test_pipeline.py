import corpus_pipeline
import pytest

from graphloom.llm.jaccard_join import jaccard_join
from graphloom.llm.quality_rules import clean

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, kept = spark.read.parquet(f"{SF}/documents.parquet"), []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(i))
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        kept.append(docs)
    return kept


def texts(df):
    return {x.doc_id: x.text for x in df.collect()}


def test_stages_keep_columns(spark, stages):
    names = spark.read.parquet(f"{SF}/documents.parquet").columns
    for df in stages[:-1]:
        assert df.columns == names
    assert len(corpus_pipeline.STAGES) == 5


def test_quality_stage(spark, stages):
    want = {x.doc_id: clean(x.text)[-1] for x in spark.read.parquet(f"{SF}/documents.parquet").collect() if clean(x.text)[-2]}
    assert texts(stages[0]) == want


def test_near_duplicates_leave_no_links(stages):
    left = jaccard_join(stages[1]).collect()
    assert all(x.doc_id == x.component_id for x in left)
    named = {x.doc_id: x.component_id for x in jaccard_join(stages[0]).collect()}
    assert {x.doc_id for x in left} == set(named.values())


def test_repeats_are_gone(stages):
    from test_suffix_dedup import brute

    want = {d: k.decode("utf-8", "ignore") for d, k, *_ in brute(sorted(texts(stages[1]).items()))}
    assert texts(stages[2]) == want


def test_benchmark_is_gone(spark, stages):
    items = [" ".join(x.text.lower().split()) for x in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    left = texts(stages[3])
    holds = lambda t: any(i in " ".join(t.lower().split()) for i in items)
    assert not any(holds(t) for t in left.values())
    assert {d for d, t in texts(stages[2]).items() if holds(t)} <= set(texts(stages[2])) - set(left)


def test_all_is_packed(stages):
    from collections import Counter

    whole = {x.doc_id: x.doc_tokens for x in stages[4].collect()}
    total = Counter()
    for x in stages[4].collect():
        total[x.doc_id] += x.length
    assert total == whole and set(whole) == set(texts(stages[3]))


def test_near_duplicates_with_null_and_repeated_keys(spark):
    text = lambda x, n=40: " ".join(f"{x}{i}" for i in range(n))
    rows = [(None, text("a")), (None, text("b")), (None, text("b") + " more"), (7, text("c")), (7, text("d")), (8, text("d") + " more"), (9, text("a")), (7, text("c")), (10, ""), (10, ""), (None, None)]
    docs = spark.createDataFrame([(d, t, "en", f"s{i}", len(t or "")) for i, (d, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    left = corpus_pipeline.near_duplicates(spark, docs, SF)
    assert left.columns == docs.columns
    got = sorted(((x.doc_id, x.text, x.source) for x in left.collect()), key=str)
    b = next(x for x in got if x[1] and x[1].startswith("b"))
    assert b in [(None, text("b"), "s1"), (None, text("b") + " more", "s2")]
    assert got == sorted([b, (7, text("c"), "s3"), (7, text("d"), "s4"), (9, text("a"), "s6"), (10, "", "s8"), (10, "", "s9"), (None, None, "s10")], key=str)


def test_benchmark_passages_by_row(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    rows = [(1, "about " + item + " end"), (1, "no such passage"), (None, item), (None, "nor here")]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = corpus_pipeline.benchmark_passages(spark, docs, SF)
    assert sorted(((x.doc_id, x.text) for x in left.collect()), key=str) == sorted([(1, "no such passage"), (None, "nor here")], key=str)
