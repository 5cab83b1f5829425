"""The jobs, by two runs over growing input, and their queries against DuckDB."""

import datetime
import json
import re
import shutil

import duckdb
import pytest
from pyspark.sql import functions as F

from jobs import analyse_code, common, queries, text_index
from quarry.operators import incremental, search, text_store

from test_oracle import TABLES, table


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_equal_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    frame = queries.QUERIES[name](spark, sf_dir)
    rel = con.sql(queries.SQL[name])
    assert sorted(frame.columns) == sorted(rel.columns)
    assert table(frame.columns, frame.collect()) == table(rel.columns, rel.fetchall())


def postings(frame):
    return sorted((r.term, r.id, r.len, tuple(r.p0), tuple(r.p1)) for r in frame.collect())


def test_text_index_grows(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text")
    source, place = tmp_path / "in", {"target": f"file://{tmp_path}/index", "checkpoint": f"file://{tmp_path}/mark"}
    source.mkdir()

    def bring(frame, name):
        frame.coalesce(1).write.parquet(f"file://{tmp_path}/{name}")
        shutil.copy(next((tmp_path / name).glob("*.parquet")), source / f"{name}.parquet")

    bring(docs.where("doc_id % 3 = 0"), "first")
    first = text_index.run(spark, f"file://{source}", **place)
    assert (first["batches"], first["texts"], first["replaced"]) == (1, docs.where("doc_id % 3 = 0").count(), 0)
    changed = docs.where("doc_id < 30").withColumn("text", F.concat(F.lit("license the words "), F.reverse("text")))
    odd = spark.createDataFrame([(None, "en", "lost"), (900_001, None, None), (900_002, "en", "two rows"), (900_002, "en", "two rows")], "doc_id long, lang string, text string")
    bring(docs.where("doc_id % 3 = 1 and doc_id >= 30").union(changed).union(odd), "second")
    second = text_index.run(spark, f"file://{source}", **place)
    assert second["batches"] == 1 and second["replaced"] == 10 and second["texts"] == docs.where("doc_id % 3 = 1 and doc_id >= 30").count() + 32
    assert text_index.run(spark, f"file://{source}", **place) == {"batches": 0, "texts": 0, "postings": 0, "replaced": 0}

    now = docs.where("doc_id % 3 < 2 and doc_id >= 30").union(changed).union(odd.where("doc_id is not null").distinct()).withColumnRenamed("doc_id", "id")
    want = search.build_index(now, ["lang", "text"])
    assert postings(text_store.stored(spark, place["target"], 2)) == postings(want)
    hits = [tuple(r) for r in search.bm25(now, ["lang", "text"], "license the", 20).collect()]
    got = text_store.search_stored(spark, place["target"], "license the", 2, 20)
    assert [(i, round(s, 9)) for i, s in (tuple(r) for r in got.collect())] == [(i, round(s, 9)) for i, s in hits]

    # merging leaves what is in force
    text_store.merge(spark, place["target"], f"file://{tmp_path}/merged", 2)
    assert postings(text_store.stored(spark, f"file://{tmp_path}/merged", 2)) == postings(want)
    assert text_store.stored_totals(spark, f"file://{tmp_path}/merged").first() == text_store.stored_totals(spark, place["target"]).first()


def test_a_search_reads_its_own_buckets(spark, tmp_path):
    docs = spark.createDataFrame([(k, "en", f"word{k} common") for k in range(50)], "id long, lang string, text string")
    text_store.add_batch(docs, ["lang", "text"], f"file://{tmp_path}/index", 0, 8)
    rows = text_store.stored(spark, f"file://{tmp_path}/index", 2, ["word7"])
    spark.conf.set("spark.sql.maxMetadataStringLength", 1000)
    try:
        plan = rows._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    bucket = spark.range(1).select(text_store.bucket_of(F.lit("word7"), 8)).first()[0]
    scan = next(line for line in plan.splitlines() if "FileScan" in line and "/postings" in line)
    filters = scan.partition("PartitionFilters: [")[2].partition("PushedFilters")[0]
    assert re.search(rf"\(bucket#\d+ = {bucket}\)|bucket#\d+ IN \({bucket}\)", filters), filters
    assert rows.count() == 1


def test_a_batch_that_broke_off_is_not_read(spark, tmp_path, monkeypatch):
    root, put = f"file://{tmp_path}/index", text_store._put
    docs = spark.createDataFrame([(1, "en", "one"), (2, "en", "two")], "id long, lang string, text string")
    text_store.add_batch(docs.where("id = 1"), ["lang", "text"], root, 0)

    def failing(df, path, *more):
        if path.endswith("totals"):
            raise RuntimeError("lost")
        return put(df, path, *more)

    monkeypatch.setattr(text_store, "_put", failing)
    with pytest.raises(RuntimeError):
        text_store.add_batch(docs, ["lang", "text"], root, 1)
    assert {r.term for r in text_store.stored(spark, root, 2).collect()} == {"en", "one"} and text_store.stored_totals(spark, root).first() == (1, 2)
    monkeypatch.setattr(text_store, "_put", put)
    text_store.add_batch(docs, ["lang", "text"], root, 1)
    assert sorted((r.term, r.id) for r in text_store.stored(spark, root, 2).collect()) == [("en", 1), ("en", 2), ("one", 1), ("two", 2)]


def test_analysis_follows_a_growing_tree(spark, tmp_path):
    tree, target = tmp_path / "tree", f"file://{tmp_path}/out"
    (tree / "pkg").mkdir(parents=True)
    (tree / "pkg" / "a.py").write_text("from pkg.b import late\n\ndef main():\n    late()\n")
    first = analyse_code.run(spark, f"file://{tree}", target)
    assert (first["touched"], first["edges"]) == (1, 0)
    (tree / "pkg" / "b.py").write_text("def late():\n    main()\n")
    second = analyse_code.run(spark, f"file://{tree}", target)
    assert (second["touched"], second["parsed"], second["linked"], second["edges"]) == (1, 1, 2, 3)
    edges = {(r.source_name, r.target_name, r.kind) for r in spark.read.parquet(f"{target}/edges").collect()}
    assert edges == {("main", "late", "CALLS"), ("late", "main", "CALLS"), ("main", "late", "IMPORTS")}
    assert {r.name for r in spark.read.parquet(f"{target}/symbols").collect()} == {"main", "late"}
    stamp = (tmp_path / "out" / "edges" / "_SUCCESS").stat().st_mtime_ns
    assert analyse_code.run(spark, f"file://{tree}", target)["touched"] == 0 and (tmp_path / "out" / "edges" / "_SUCCESS").stat().st_mtime_ns == stamp


def test_analysis_shows_what_a_lost_run_had_not(spark, tmp_path, monkeypatch):
    files = spark.createDataFrame([("a.py", "python", datetime.datetime(2024, 1, 1), "def f():\n    f()\n")], "path string, language string, mtime timestamp, content string")
    files.write.parquet(f"file://{tmp_path}/files")

    def lost(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(incremental, "mark", lost)
        with pytest.raises(RuntimeError):
            analyse_code.run(spark, f"file://{tmp_path}/files", f"file://{tmp_path}/out", "files")
    assert analyse_code.run(spark, f"file://{tmp_path}/files", f"file://{tmp_path}/out", "files")["touched"] == 0
    assert incremental.last_run(spark, f"file://{tmp_path}/out/state", "shown") == 0 and spark.read.parquet(f"file://{tmp_path}/out/edges").count() == 1


def test_settings(tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"buckets": 4, "source": "s"}))
    got = common.settings(text_index.DEFAULTS, "", ["--config", str(tmp_path / "c.json"), "--target", "t", "--checkpoint", "c", "--source", "other"])
    assert (got["buckets"], got["source"], got["target"], got["id"]) == (4, "other", "t", "doc_id")
    with pytest.raises(SystemExit):
        common.settings(text_index.DEFAULTS, "", [])


def test_an_index_is_built_inside_the_rows(spark):
    texts = [(1, "en", "b a b, a1 b"), (2, None, "b"), (3, "a", ""), (4, None, None), (5, "b a", "Ää b " * 500)]
    docs = spark.createDataFrame(texts, "id long, lang string, text string")
    want = []
    for i, *fields in texts:
        fields = [re.findall(r"\w+", (f or "").lower().replace("ä", "a")) for f in fields]
        for term in {t for f in fields for t in f}:
            want.append((term, i, sum(map(len, fields)), *[tuple(k for k, t in enumerate(f) if t == term) for f in fields]))
    index = search.build_index(docs, ["lang", "text"])
    assert postings(index) == sorted(want)
    assert "Exchange" not in index._jdf.queryExecution().executedPlan().toString()  # no token is shuffled


@pytest.mark.parametrize("few", [0, text_store.FEW])
def test_repeated_ids_and_replaced_texts(spark, tmp_path, monkeypatch, few):
    monkeypatch.setattr(text_store, "FEW", few)
    monkeypatch.setattr(text_store, "TOKENS", 3)  # several tasks a bucket
    root = f"file://{tmp_path}/index"
    docs = spark.createDataFrame([(1, "one two"), (1, "one two"), (2, "two"), (3, "three of many words")], "id long, text string")
    assert text_store.add_batch(docs, ["text"], root, 0, 2)["texts"] == 3
    assert text_store.add_batch(docs.where("id = 2").withColumn("text", F.lit("again")), ["text"], root, 1, 2)["replaced"] == 1
    assert sorted((r.term, r.id) for r in text_store.stored(spark, root, 1).collect()) == [("again", 2), ("many", 3), ("of", 3), ("one", 1), ("three", 3), ("two", 1), ("words", 3)]
