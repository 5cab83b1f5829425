"""The pipeline's stages, each against plain Python on its own input."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from test_decontaminate import brute as brute_leaks
from test_native import brute_lines, measures
from test_ngram_join import brute as brute_links
from test_tokens import check_packing


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    out = [spark.read.parquet(f"{sf_dir}/documents.parquet").persist()]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], sf_dir).persist())
        out[-1].count()  # before the next stage begins
    return out


def rows(frame):
    return [(r.doc_id, r.text) for r in frame.collect()]


def test_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "n-gram join", "decontamination", "best-fit packing"]
    assert all(s.columns == stages[0].columns for s in stages[:5]) and corpus_pipeline.ORACLE_SQL is None


def test_quality(stages):
    assert sorted(d for d, _ in rows(stages[1])) == sorted(d for d, t in rows(stages[0]) if not measures(t)[5])


def test_lines(stages):
    want = brute_lines(rows(stages[1]), 24)
    got = dict(rows(stages[2]))
    assert got == {d: want[d] for d, t in rows(stages[1]) if want[d] == t or want[d].strip()}
    assert stages[2].where(F.length("text") != F.col("n_chars")).isEmpty()


def test_near_copies(stages):
    groups = brute_links(rows(stages[2]))
    assert sorted(d for d, _ in rows(stages[3])) == sorted(d for d, _, c in groups if d == c)


def test_leaks(spark, stages, sf_dir):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert sorted(d for d, _ in rows(stages[4])) == sorted(d for d, _, hit, _ in brute_leaks(rows(stages[3]), items) if not hit)


def test_packing(stages):
    bins, total = check_packing(stages[5], rows(stages[4]), 4096)
    assert bins <= -(-total // 4096) + 2


def test_run(spark, sf_dir, stages):
    assert corpus_pipeline.run(spark, sf_dir).count() == stages[5].count()


def test_odd_rows(spark, odd, empty, sf_dir):
    many = " ".join(f"w{k}" for k in range(80))
    extra = [(20, many), (20, many), (21, many + " x"), (None, many + " y\n" + "a line that is long enough to count here"), (22, None)]
    # extra columns with names that the operators give to their own results
    names = "n_lines n_removed n_hit items row hits n_words n_repeat_words base_failed host kept rid root low sid bucket piece id doc lines spaced full gone _q_rid _q_row _q_text _q_host _q_n_lines _q_n_removed _q_kept".split()
    clash = lambda frame: frame.withColumns({n: F.lit(-5) for n in names})
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows(odd) + extra], "doc_id long, text string, lang string, source string, n_chars long")
    for frame in (clash(docs), clash(empty.selectExpr("doc_id", "text", "score as lang", "kept as source", "cast(bucket as long) as n_chars"))):
        first = frame
        for name, stage in corpus_pipeline.STAGES:
            frame = stage(spark, frame, sf_dir).persist()
            frame.count()
            if name != corpus_pipeline.STAGES[-1][0]:
                assert frame.columns == first.columns and {r[n] for r in frame.collect() for n in names} <= {-5}
