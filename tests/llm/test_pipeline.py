"""Every stage of the pipeline, on what the stage before kept, against brute force."""

import random
from collections import Counter

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from conftest import SF_SMALL
from evlens.llm import byte_bpe, decontaminate, resampling
from test_operators import RANKS, lines_brute, links_brute, sha


def rows_of(df):
    return [tuple(r) for r in df.select(corpus_pipeline.COLUMNS).collect()]


def as_brute(rows):
    return [(i, text, lang, source, n) for i, text, lang, source, n in rows]


def test_stages(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SF_SMALL}/labels.parquet")
    seen = rows_of(docs)
    assert [name for name, _ in corpus_pipeline.STAGES][0] == "quality classifier" and len(corpus_pipeline.STAGES) == 5
    stages = [f for _, f in corpus_pipeline.STAGES]

    out = stages[0](spark, docs, SF_SMALL)
    assert out.columns == docs.columns
    model = resampling.fit(docs, labels)
    scores = resampling.with_scores(docs, model).collect()
    k = sum(r.log_weight > -model.margin for r in scores)
    least = sorted((r.gumbel_key for r in scores), reverse=True)[k - 1]
    kept = rows_of(out)
    assert {r[0] for r in kept} == {r.doc_id for r in scores if r.gumbel_key >= least} and set(kept) <= set(seen)
    good = {r.doc_id for r in labels.filter("quality = 1").collect()}
    bad = {r.doc_id for r in labels.filter("quality = 0").collect()}
    ids = {r[0] for r in kept}
    assert len(good - ids) <= 1 and len(bad & ids) <= 2

    cleaned = rows_of(out := stages[1](spark, out.cache(), SF_SMALL))
    want = lines_brute(as_brute(kept), 0.1, 3)
    assert {r[0]: r[1] for r in cleaned} == {key[0]: key[1] for key in want}
    assert all(r[4] == len(r[1]) for r in cleaned)

    unique = rows_of(out := stages[2](spark, out.cache(), SF_SMALL))
    classes = links_brute(as_brute(cleaned))
    assert {r[0] for r in unique} == {label for label, _, _ in classes.values()} and set(unique) <= set(cleaned)

    clean = rows_of(out := stages[3](spark, out.cache(), SF_SMALL))
    items = [decontaminate.words(r.text) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    leaks = {r[0] for r in unique if any(decontaminate.align(w, decontaminate.words(r[1]))[0] >= 0.5 for w in items if len(w))}
    assert leaks and {r[0] for r in clean} == {r[0] for r in unique} - leaks

    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})
    coded = {r.doc_id: (list(r.ids), r.decoded_sha256) for r in stages[4](spark, out, SF_SMALL).collect()}
    assert coded == {r[0]: (lib.encode_ordinary(r[1]), sha(r[1])) for r in clean}


def test_run_chains_the_stages(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF_SMALL)
    want = {(r.doc_id, tuple(r.ids)) for r in docs.collect()}
    assert {(r.doc_id, tuple(r.ids)) for r in corpus_pipeline.run(spark, SF_SMALL).collect()} == want


WIDE = "doc_id long, text string, lang string, source string, n_chars long, kept string, log_weight string, n_lines string, " \
       "a string, id string, vertex string, `dotted.name` string, tags map<string,int>"


def wide(spark, rows):
    """Rows of (doc_id, text, lang) with further columns, their names those that the stages use inside."""
    return spark.createDataFrame([(i, t, lang, "s", len(t or ""), *["x"] * 7, {"k": 1}) for i, t, lang in rows], WIDE).repartition(3).cache()


def counted(df):
    assert df.schema.simpleString() == df.sparkSession.createDataFrame([], WIDE).schema.simpleString()
    rows = df.collect()
    assert all(list(r)[5:] == ["x"] * 7 + [{"k": 1}] for r in rows)
    return Counter((r.doc_id, r.text, r.lang) for r in rows)


def prose(rnd, n):
    return " ".join("w%d" % rnd.randrange(5000) for _ in range(n))


def test_near_duplicates_decide_by_row(spark):
    rnd = random.Random(2)
    t, u, v, w, x, y, z = (prose(rnd, 80) for _ in range(7))
    near = lambda text: text + " more"
    stay = [(1, t, "en"), (2, u, "en"), (0, v, "en"), (None, w, "en"), (None, x, "en"), (5, None, "en"), (5, None, "en"),
            (6, "", "en"), (None, None, "en"), (9, z, "en")]
    gone = [(1, t, "en"), (1, t, "en"), (None, near(t), "en"), (2, near(v), "en"), (None, w, "en"), (None, near(z), "en")]
    got = counted(corpus_pipeline.near_duplicates(spark, wide(spark, stay + gone + [(7, y, "en"), (7, y, "fr")]), SF_SMALL))
    one = {k for k in got if k[0] == 7}
    assert len(one) == 1 and got == Counter(stay) + Counter(one)


def test_decontamination_decides_by_row(spark):
    rnd = random.Random(3)
    item = spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").filter("text is not null").first().text
    leak = " ".join([prose(rnd, 30), item, prose(rnd, 30)])
    stay = [(1, prose(rnd, 50), "en"), (None, prose(rnd, 50), "en"), (3, None, "en"), (None, None, "en"), (4, "", "en")]
    stay += stay[:2]
    gone = [(1, leak, "en"), (None, leak, "en"), (None, leak, "fr"), (8, leak, "en"), (8, leak, "en")]
    assert counted(corpus_pipeline.decontamination(spark, wide(spark, stay + gone), SF_SMALL)) == Counter(stay)


def test_first_stages_keep_rows_and_columns(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text", "lang").limit(40).collect()]
    rows += [rows[0], (rows[1][0], rows[2][1], "xx"), (None, rows[3][1], "en"), (None, None, "en"), (7, "", "en")]
    docs = wide(spark, rows)
    kept = counted(corpus_pipeline.quality(spark, docs, SF_SMALL))
    assert kept and kept <= Counter(rows) and all(n == Counter(rows)[k] for k, n in kept.items())
    lines = counted(corpus_pipeline.lines(spark, docs, SF_SMALL))
    assert Counter((i, lang) for i, _, lang in lines.elements()) == Counter((i, lang) for i, _, lang in rows)
    coded = corpus_pipeline.encoding(spark, docs, SF_SMALL).collect()
    assert Counter((r.doc_id, r.decoded_sha256) for r in coded) == Counter((i, sha(t or "")) for i, t, _ in rows)


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_empty_table(spark, name, stage):
    out = stage(spark, wide(spark, []), SF_SMALL)
    assert out.count() == 0 and (name == corpus_pipeline.STAGES[-1][0] or counted(out) == Counter())
