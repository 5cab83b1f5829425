"""Small fixtures with known results."""

import math
import random
import sqlite3
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import communities, detectors, documents, graph, layout, lookups, metrics, progress, resolve, search, store, tree
from quarry.sources import code, pages
from quarry.streaming import events as ev

EDGE = "edge_id long, source_id long, target_id long, kind string, confidence double"
SYM = "symbol_id long, file_id long, path string, language string, name string, kind string, start_line long, end_line long"


def edges(spark, pairs, kind="CALLS"):
    return spark.createDataFrame([(k, a, b, kind, 1.0) for k, (a, b) in enumerate(pairs)], EDGE)


def nodes(spark, names, kind="Function", path="src/a.py"):
    return spark.createDataFrame([(k, 1, path, "python", n, kind, 10 * k, 10 * k + 9) for k, n in enumerate(names, 1)], SYM)


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first().y


def test_languages(spark):
    got = [one(spark, f"foo.{e}", T.language_of) for e in ("py", "ts", "js", "rs", "go", "java", "tsx", "txt")]
    assert got == ["python", "typescript", "javascript", "rust", "go", "java", "typescript", None]


def test_sloc_and_complexity(spark):
    py = "# note\nimport os\n\ndef f():\n    # inner\n    x = 1\n    return x\n"
    rs = "// a\n/* b\n b */\nuse x;\nfn f() {\n  1\n}\n"
    assert one(spark, py, lambda x: T.sloc(x, F.lit("python"))) == 4 and one(spark, rs, lambda x: T.sloc(x, F.lit("rust"))) == 4
    assert one(spark, "fn f() {\n if a {\n  1\n }\n if b {\n  2\n }\n 3\n}", T.complexity) == 3.0
    assert one(spark, "x", lambda x: T.from_loc(F.lit(50))) == 6.0
    assert one(spark, "for a in b:\n    while c and d else elif\n", T.complexity) == 6.0  # the mark 'if' is part of elif


def test_names(spark):
    assert one(spark, "parseJSONFile", T.name_tokens) == ["parse", "json", "file"]
    assert one(spark, "cluster_user_apiV2", T.format_label) == "User ApiV2"
    assert one(spark, "a/b/c.py", T.ancestors) == ["a", "a/b"]
    assert one(spark, "1 x-y", T.mermaid_id) == "n1_x_y"
    assert one(spark, 'f(a)"', T.mermaid_label) == "f&#40;a&#41;&quot;"
    assert one(spark, "x" * 30 + "Needle" + "y" * 30, lambda x: T.snippet(x, F.lit("needle"))) == "..." + "x" * 20 + "Needle" + "y" * 20 + "..."
    assert one(spark, "short", lambda x: T.snippet(x, F.lit("none"))) == "short"
    assert one(spark, "a/./b/../c//d.py", resolve.normalize) == "a/c/d.py"


def test_fan_and_entries(spark):
    n = nodes(spark, ["main", "helper", "utility"])
    e = edges(spark, [(1, 2), (3, 2)])
    fan = {r.symbol_id: (r.fan_in, r.fan_out) for r in graph.fan_in_out(n, e).collect()}
    assert fan == {1: (0, 1), 2: (2, 0), 3: (0, 1)}
    top = graph.entry_points(n, e).collect()
    assert top[0].symbol_id == 1 and top[0].score == 1.5 and "main" in top[0].reason
    many = nodes(spark, [f"main_{k}" for k in range(50)] + [f"h{k}" for k in range(50)])
    assert graph.entry_points(many, edges(spark, [(k, k + 50) for k in range(1, 51)])).count() == 30
    busy = nodes(spark, ["utility"] + [f"c{k}" for k in range(6)])
    assert 1 not in {r.symbol_id for r in graph.entry_points(busy, edges(spark, [(k, 1) for k in range(2, 8)])).collect()}


def test_modularity_and_cohesion(spark):
    e = edges(spark, [(1, 2), (2, 3), (3, 1), (4, 5), (5, 6), (6, 4)])
    m = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (2, 4), (2, 5), (2, 6)], "community_id long, symbol_id long")
    assert [r.q for r in graph.modularity(e, m).collect()] == [0.25, 0.25]
    assert {r.cohesion for r in graph.cohesion(e, m).collect()} == {1.0}
    assert graph.modularity(e.limit(0), m).agg(F.sum("q")).first()[0] == 0


def test_tfidf(spark):
    names = ["parseFile", "parseToken", "readStream", "writeLog", "formatOutput"]
    m = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (2, 4), (2, 5)], "community_id long, symbol_id long")
    best = metrics.tfidf(nodes(spark, names), m).where("community_id = 1 and rank = 1").first()
    assert best.term == "parse" and best.score == pytest.approx(2 / 6 * (math.log(2) + 1), abs=1e-6)
    assert {r.label for r in metrics.labels(nodes(spark, names), m).collect()} == {"parse", "format"}


def test_heatmap(spark):
    f = spark.createDataFrame([(1, 10, 1.0, 1, 0), (2, 500, 50.0, 100, 0), (3, 100, 10.0, 20, 0)], "file_id long, sloc long, complexity double, churn long, fan_in long")
    got = {r.file_id: r.heat for r in metrics.heatmap(f).collect()}
    assert got[2] == 0.9 and got[1] == 0.0 and got[2] > got[3] > got[1]


def test_call_resolution(spark):
    s = spark.createDataFrame([(1, 1, "a.py", "python", "caller", "Function", 1, 2), (2, 1, "a.py", "python", "helper", "Function", 3, 4), (3, 2, "b.py", "python", "helper", "Function", 1, 2), (4, 3, "c.py", "python", "only", "Function", 1, 2)], SYM)
    calls = spark.createDataFrame([("a.py", "caller", "helper"), ("c.py", "only", "helper"), ("a.py", "caller", "only"), ("a.py", "<module>", "helper"), ("a.py", "caller", "gone")], "path string, caller string, callee string")
    got = sorted((r.source_id, r.target_id, r.confidence) for r in resolve.call_edges(calls, s).collect())
    assert got == [(1, 2, 1.0), (1, 2, 1.0), (1, 4, 0.7), (4, 2, 0.4)]
    h = spark.createDataFrame([("caller", "helper", "extends")], "child string, parent string, relation string")
    assert [tuple(r) for r in resolve.heritage_edges(h, s).collect()] == [(1, 2, "EXTENDS", 1.0)]


def test_imports(spark):
    paths = ["src/main.py", "src/utils.py", "pkg/sub/__init__.py", "web/app.ts", "web/lib/index.ts", "crates/my-core/src/lib.rs", "crates/app/src/main.rs", "crates/app/src/net/mod.rs", "crates/app/src/net/http.rs", "x/y/Z.java"]
    files = spark.createDataFrame([(k, p) for k, p in enumerate(paths, 1)], "file_id long, path string")
    imports = [("src/main.py", "python", "utils", 2), ("src/main.py", "python", "pkg.sub", 3), ("pkg/sub/__init__.py", "python", "..other", None), ("web/app.ts", "typescript", "./lib", 5), ("web/app.ts", "typescript", "react", None), ("crates/app/src/main.rs", "rust", "crate::net::http::Client", 9), ("crates/app/src/net/http.rs", "rust", "super::super::x", None), ("crates/app/src/main.rs", "rust", "my_core::Thing", 6), ("src/main.py", "go", "y.Z", 10), ("web/app.ts", "typescript", "./app", None)]
    got = {(r.source_file, r.target_file) for r in resolve.import_edges(spark.createDataFrame([i[:3] for i in imports], "path string, language string, module string"), files).collect()}
    index = {p: k for k, p in enumerate(paths, 1)}
    assert got == {(index[p], to) for p, _, _, to in imports if to}


def test_flows_are_breadth_first_and_bounded(spark):
    n = nodes(spark, ["main"] + [f"n{k}" for k in range(25)])
    e = edges(spark, [(k, k + 1) for k in range(1, 26)])
    rows = graph.flows(n, e, n.where("symbol_id = 1")).orderBy("step_order").collect()
    assert len(rows) == 21 and [r.step_order for r in rows] == list(range(21)) and rows[0].process == "main_flow" and rows[1].description == "Step 1: n0"
    fork = graph.flows(n, edges(spark, [(1, 2), (1, 3), (2, 4), (3, 5), (1, 2)]), n.where("symbol_id = 1")).orderBy("step_order").collect()
    assert [r.symbol_id for r in fork] == [1, 2, 3, 4, 5]  # the newest edge of a node comes first


def test_impact_and_chain(spark):
    n, e = nodes(spark, list("abcd")), edges(spark, [(1, 2), (2, 3), (3, 4), (2, 4)])
    root = spark.createDataFrame([(4,)], "root long")
    assert {(r.symbol_id, r.depth, r.risk) for r in graph.impact(e, root, 2).collect()} == {(3, 1, 1.0), (2, 1, 1.0), (1, 2, 0.5)}
    chain = graph.call_chain(n, e, spark.createDataFrame([(1,)], "root long"), 5)
    assert {(r.symbol_id, r.depth) for r in chain.collect()} == {(1, 0), (2, 1), (3, 2), (4, 2)}


def test_roots_are_computed_once_for_all_rounds(spark):
    n, e, made = nodes(spark, list("abcdef")), edges(spark, [(k, k + 1) for k in range(1, 6)]), spark.sparkContext.accumulator(0)

    def one(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    root = spark.createDataFrame([(1,)], "root long").mapInArrow(one, "root long")
    assert {(r.symbol_id, r.depth) for r in graph.call_chain(n, e, root, 5).collect()} == {(k, k - 1) for k in range(1, 7)}
    assert made.value == 1
    made.value = 0
    assert len(graph.flows(n, e, root.withColumnRenamed("root", "symbol_id")).collect()) == 6
    assert made.value == 1


@pytest.mark.parametrize("pairs, want", [([(1, 2), (2, 1)], {(1, 1), (1, 2)}), ([(1, 2), (2, 3), (3, 1), (3, 4), (5, 6), (6, 5), (4, 5)], {(1, 1), (1, 2), (1, 3), (5, 5), (5, 6)}), ([(1, 2), (2, 3)], set()), ([(1, 1)], set())])
def test_cycles(spark, pairs, want):
    assert {tuple(r) for r in graph.cycles(edges(spark, pairs)).collect()} == want


def chained(n):
    """``n`` two-symbol cycles, each leading to the one before it in id, so that one round of colours takes one of them."""
    return [p for k in range(1, n + 1) for p in [(2 * k, 2 * k - 1), (2 * k - 1, 2 * k)] + [(2 * k, 2 * k - 2)] * (k > 1)]


def test_cycles_beyond_200_components(spark):
    got = {tuple(r) for r in graph.cycles(edges(spark, chained(250))).collect()}
    assert got == {(2 * k - 1, x) for k in range(1, 251) for x in (2 * k - 1, 2 * k)}


def test_cycles_by_rounds_alone(spark):
    got = {tuple(r) for r in graph.cycles(edges(spark, chained(3)), few=0).collect()}
    assert got == {(2 * k - 1, x) for k in range(1, 4) for x in (2 * k - 1, 2 * k)}


@pytest.mark.parametrize("few", [0, graph.FEW_EDGES])
def test_cycles_at_random(spark, few):
    rng = random.Random(3)
    pairs = [(rng.randint(1, 40), rng.randint(1, 40)) for _ in range(70)]
    far = {x: {x} for x in range(1, 41)}
    for _ in range(40):
        for a, b in pairs:
            for seen in far.values():
                if a in seen:
                    seen.add(b)
    own = {x: {y for y in far[x] if x in far[y]} for x in far}
    want = {(min(m), x) for x, m in own.items() if len(m) > 1}
    assert want and {tuple(r) for r in graph.cycles(edges(spark, pairs), few).collect()} == want


@pytest.mark.parametrize("few", [0, 20])
def test_cycles_merge_a_large_component_from_few_of_its_edges(spark, few, monkeypatch):
    rng = random.Random(5)
    big = [(rng.randint(11, 50), rng.randint(11, 50)) for _ in range(1600)]
    # 4..6 hang on by one edge each way, 1..3 are a ring of their own that leads in, 60 and 61 are no cycle
    pairs = [*big, (13, 4), (4, 5), (5, 6), (6, 14), (1, 2), (2, 3), (3, 1), (3, 15), (16, 60), (60, 61)]
    e, sizes, real = edges(spark, pairs), [], graph.cut

    def cut(df):
        out = real(df)
        if set(out.columns) >= {"source_id", "target_id"}:
            sizes.append(out.count())
        return out

    monkeypatch.setattr(graph, "cut", cut)
    got = {tuple(r) for r in graph.cycles(e, few).collect()}
    assert got == {(4, k) for k in [4, 5, 6, *range(11, 51)]} | {(1, k) for k in (1, 2, 3)}
    assert max(sizes[1:]) < sizes[0] / 2  # all edges are held once


def test_detectors(spark):
    method = [(k, 1, "src/a.py", "python", f"m{k}", "Method", 2 + k, 2 + k) for k in range(2, 27)]
    s = spark.createDataFrame([(1, 1, "src/a.py", "python", "Big", "Class", 1, 100), *method], SYM)
    assert [(r.severity, r.line, r.message) for r in detectors.god_class(s).collect()] == [("warning", 1, "'Big' has 25 methods")]
    spans = spark.createDataFrame([(k, 1, "a.py", "python", "f", "Function", 1, e) for k, e in enumerate((51, 102, 251))], SYM)
    assert sorted(r.severity for r in detectors.long_method(spans).collect()) == ["error", "warning"]
    text = spark.createDataFrame([(1, "x = eval(y)\npassword = 'abc'\nq = f'SELECT 1'\n"), (2, "clean\n")], "file_id long, content string")
    assert sorted((r.file_id, r.line, r.severity) for r in detectors.security(text).collect()) == [(1, 1, "warning"), (1, 2, "error"), (1, 3, "warning")]
    ten = [(k, 1, "src/parser.py", "python", f"f{k}", "Function", k, k) for k in range(10)]
    assert detectors.test_gap(spark.createDataFrame(ten, SYM)).count() == 1
    assert detectors.test_gap(spark.createDataFrame([*ten, (99, 2, "src/test_parser.py", "python", "t", "Function", 1, 1)], SYM)).count() == 0
    ring = detectors.circular(nodes(spark, ["a", "b"]), edges(spark, [(1, 2), (2, 1)])).first()
    assert ring.message == "Circular: a → b → a"


def test_communities(spark):
    clique = lambda ids: [(a, b) for a in ids for b in ids if a < b]
    n = nodes(spark, [f"f{k}" for k in range(8)])
    got = {r.symbol_id: r.community_id for r in communities.communities(n, edges(spark, clique([1, 2, 3, 4]) + clique([5, 6, 7]) + [(4, 5)])).collect()}
    assert set(got) == set(range(1, 9)) and got[1] == got[2] == got[3]
    assert {r.community for r in communities.detect(n, edges(spark, [])).collect()} == {1}
    assert communities.merge({1: 4, 5: 2, 7: 2, 9: 2}, {(1, 5): 2, (1, 7): 1, (1, 9): 3}) == {1: 0, 5: 0, 7: 0, 9: 0}
    assert communities.topological([(0, 1)], [0, 1]) == [1, 0] and communities.topological([(2, 1), (1, 2)], [0, 1, 2], {0}) == [0, 1, 2]
    rng = random.Random(4)
    for _ in range(30):
        pairs = [(rng.randrange(12), rng.randrange(12)) for _ in range(20)]
        ids = sorted({x for p in pairs for x in p})
        own = communities.local_moving(ids, pairs, len(pairs))
        assert own == communities.local_moving(ids, pairs, len(pairs)) and set(own) == set(ids)


def test_rounds_read_the_edges_once(spark):
    """However many rounds a search takes, what makes the edges runs once."""
    seen = spark.sparkContext.accumulator(0)

    def pass_on(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    way = edges(spark, [(k, k + 1) for k in range(1, 7)]).mapInArrow(pass_on, EDGE)
    n = nodes(spark, [f"f{k}" for k in range(7)])
    start = n.where("symbol_id = 1").select("symbol_id")
    assert [r.symbol_id for r in graph.flows(n, way, start).orderBy("step_order").collect()] == list(range(1, 8)) and seen.value <= 12
    seen.value = 0
    assert graph.reach(way, start.withColumnRenamed("symbol_id", "root"), 6).count() == 7 and seen.value <= 12


@pytest.mark.parametrize("most, lone", [(1, 2), (4, 0), (15, 20)])
def test_communities_are_merged_apart(spark, most, lone):
    """Several components, symbols without an edge: the groups of one merge over the whole graph, without communities or ties on the driver."""
    rng = random.Random(most)
    pairs = [(at + rng.randrange(1, wide), at + rng.randrange(1, wide)) for at, wide, n in ((0, 60, 150), (100, 40, 60), (200, 4, 5)) for _ in range(n)]
    ids = sorted({x for p in pairs for x in p})
    own = communities.local_moving(ids, pairs, float(len(pairs)))
    least = {}
    for x in ids:
        least.setdefault(own[x], x)
    held = {x: least[own[x]] for x in ids}
    sizes, ties = Counter(held.values()), Counter()
    for a, b in pairs:
        if held[a] != held[b]:
            ties[tuple(sorted((held[a], held[b])))] += 1
    if lone:
        sizes[0] = lone
    want = communities.merge(sizes, ties, most)
    every = spark.createDataFrame([(x,) for x in ids + [1000 + k for k in range(lone)]], "symbol_id long")
    got = {r.symbol_id: r.community_id for r in communities.communities(every, edges(spark, pairs), most).collect()}
    assert got == {x: want[held[x]] + 1 for x in ids} | {1000 + k: want.get(0, 0) + 1 for k in range(lone)}


def test_communities_of_symbol_0(spark):
    """A symbol 0 is not one of those without an edge."""
    got = {r.symbol_id: r.community_id for r in communities.communities(spark.createDataFrame([(0,), (1,), (2,), (9,)], "symbol_id long"), edges(spark, [(0, 1), (1, 2), (0, 2)])).collect()}
    assert got[0] == got[1] == got[2] != got[9]


ROWS = [(1, "src/main.rs", "rust"), (2, "src/lib.rs", "rust"), (3, "docs/main notes.md", "text"), (4, "src/hello_world.py", "python hello"), (5, None, "")]


@pytest.mark.parametrize("query", ["main", "rust", "main.rs", "hello_world", "src main", "absent", "*** ", "python hello"])
def test_bm25_equals_fts5(spark, query):
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table t using fts5(path, language)")
    con.executemany("insert into t(rowid, path, language) values (?, ?, ?)", ROWS)
    words = search.sanitize(query)
    want = con.execute("select rowid, -rank from t where t match ? order by rank, rowid", (" ".join(f'"{w}"' for w in words),)).fetchall() if words else []
    got = [(r.id, r.score) for r in search.bm25(spark.createDataFrame(ROWS, "id long, path string, language string"), ["path", "language"], query).collect()]
    assert [i for i, _ in got] == [i for i, _ in want] and [s for _, s in got] == pytest.approx([s for _, s in want], rel=1e-9)


def test_sanitize_and_fuse(spark):
    assert search.sanitize("foo* -bar OR baz") == ["foo", "bar", "OR", "baz"] and search.sanitize("***") == []
    a = spark.createDataFrame([(1, 3.0), (2, 1.0)], "id long, score double")
    got = [(r.kind, r.id) for r in search.fuse([("file", a), ("symbol", a)], 3).collect()]
    assert got == [("file", 1), ("symbol", 1), ("file", 2)]


def test_progress(spark):
    s = spark.createDataFrame([(1, k, "quiz" if k == 6 else "overview", True) for k in range(1, 7)] + [(2, 1, "overview", False)], "chapter_id long, section_id long, content_type string, completed boolean")
    stats = progress.learner(s).first()
    assert stats.xp == 6 * 10 + 50 + 25 and stats.level == 2 and stats.badges == "first_steps,chapter_champion"
    q = spark.createDataFrame([(1, '["a","b"]', 1, "b"), (2, '["a"]', 0, "x"), (3, "[]", 0, "a")], "question_id long, options string, correct_index int, answer string")
    assert [(r.correct, r.xp) for r in progress.grade(q).orderBy("question_id").collect()] == [(True, 25), (False, 0), (False, 0)]
    assert progress.skipped(s, 2).count() == 1 and progress.overall(s).first().chapters_completed == 1


def test_lookups(spark):
    n = nodes(spark, ["alpha", "alphabet", "beta"])
    assert {r.name for r in lookups.prefix_search(n, "ALPHA").collect()} == {"alpha", "alphabet"}
    assert [lookups.page(n, "symbol_id", 2, k).count() for k in (0, 2, 4)] == [2, 1, 0]
    old = spark.createDataFrame([("a", 1), ("b", 2), ("c", None)], "path string, mtime int")
    new = spark.createDataFrame([("a", 2), ("b", 2), ("c", 3), ("d", 1)], "path string, mtime int")
    assert {r.path: r.state for r in lookups.changed(old, new).collect()} == {"a": "changed", "b": "unchanged", "c": "changed", "d": "new"}
    runs = spark.createDataFrame([("r", "parse", "started", None, 1), ("r", "parse", "failed", "x", 2)], "repo_path string, step_name string, status string, error_message string, ts int")
    assert lookups.latest_state(runs).first().status == "failed"


def test_trees(spark):
    f = spark.createDataFrame([("src/a.py",), ("src/z/b.py",), ("top.md",)], "path string")
    assert [r.line for r in tree.file_tree(f).orderBy("place").collect()] == ["src/", "  z/", "    b.py", "  a.py", "top.md"]
    assert {(r.node_type, r.label) for r in tree.expand(f, "src").collect()} == {("file", "a.py"), ("directory", "z")}
    assert tree.common_prefix(spark.createDataFrame([("lib/x/a",), ("lib/xy/b",)], "path string")).first().prefix == "lib/"
    assert {(r.path, r.n_children) for r in tree.schematic(f, None, 1).collect()} == {("src", 2), ("top.md", 0)}


PY = 'import os\nfrom .base import Base as B\n\n\nclass Child(Base):\n    def run(self):\n        return helper(os.path)\n\n\ndef helper(x):\n    return x\n\n\nhelper(1)\n'
TS = 'import { A } from "./a";\n\nexport interface Shape {\n  area(): number;\n}\n\nexport class Circle implements Shape {\n  area(): number {\n    return compute(this.r);\n  }\n}\n\nfunction compute(r: number) {\n  return r;\n}\n'
RS = "use crate::shape::Shape;\n\npub struct Circle {\n    r: f64,\n}\n\nimpl Shape for Circle {\n    fn area(&self) -> f64 {\n        compute(self.r)\n    }\n}\n\nfn compute(r: f64) -> f64 {\n    r\n}\n"


def test_parsing(spark):
    files = spark.createDataFrame([("a.py", "python", PY), ("b.ts", "typescript", TS), ("c.rs", "rust", RS), ("bad.py", "python", "def ("), ("d.rb", "ruby", "x")], "path string, language string, content string")
    parsed = code.parse_sources(files).persist()
    assert {r.path for r in parsed.collect()} == {"a.py", "b.ts", "c.rs"}
    sym = {(r.path, r.name, r.kind, r.start_line, r.end_line) for r in code.flat(parsed, "symbols").collect()}
    assert {("a.py", "Child", "Class", 5, 7), ("a.py", "run", "Function", 6, 7), ("a.py", "helper", "Function", 10, 11), ("b.ts", "Shape", "Interface", 3, 5), ("b.ts", "Circle", "Class", 7, 11), ("b.ts", "area", "Method", 8, 10), ("c.rs", "Circle", "Struct", 3, 5), ("c.rs", "compute", "Function", 13, 15)} <= sym
    assert {(r.path, r.caller, r.callee) for r in code.flat(parsed, "calls").collect()} >= {("a.py", "run", "helper"), ("a.py", "<module>", "helper"), ("b.ts", "area", "compute"), ("c.rs", "area", "compute")}
    assert {(r.path, r.module) for r in code.flat(parsed, "imports").collect()} == {("a.py", "os"), ("a.py", ".base"), ("b.ts", "./a"), ("c.rs", "crate::shape::Shape")}
    assert {(r.child, r.parent, r.relation) for r in code.flat(parsed, "heritage").collect()} == {("Child", "Base", "EXTENDS"), ("Circle", "Shape", "EXTENDS"), ("Circle", "Shape", "IMPLEMENTS")}
    rows = [(r.number, r.line, r.total) for r in code.source_slice(files, "a.py", 1, 2).collect()]
    assert rows == [(1, "import os", 14), (2, "from .base import Base as B", 14)]


def test_walk(spark, tmp_path):
    for name, text in (("a.py", "x = 1\n"), ("sub/b.rs", "fn f() {}\n"), ("note.txt", "no"), (".hidden.js", "1"), ("big.py", "y" * 100)):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    assert {(r.path, r.language) for r in code.walk(spark, str(tmp_path), 50).collect()} == {("a.py", "python"), ("sub/b.rs", "rust")}


def test_trending(spark):
    row = '<article class="Box-row"><h2 class="h3"><a href="/{o}/{n}">x</a></h2>{p}<span itemprop="programmingLanguage">Rust</span><a class="Link--muted" href="#"> 25,400 </a><span>\n 120 stars today\n</span></article>'
    html = row.format(o="acme", n="one", p="<p> A tool </p>") + row.format(o="b", n="two", p="") + '<article class="Box-row"><h2><a href="/broken">x</a></h2></article><article>no</article>'
    got = pages.trending(spark.createDataFrame([(html,), (None,)], "html string")).collect()
    assert [(r.owner, r.name, r.description, r.language, r.stars_today, r.total_stars) for r in got] == [("acme", "one", "A tool", "Rust", 120, 25400), ("b", "two", None, "Rust", 120, 25400)]
    assert pages.trending_url("rust", "weekly").endswith("/rust?since=weekly")
    assert len(one(spark, "x", lambda x: pages.fingerprint(F.lit("owner"), F.lit("repo"), F.lit("abc123")))) == 64


def test_model_stream(spark):
    lines = ['{"type":"assistant","message":{"content":[{"type":"text","text":"Hel"},{"type":"tool"}]}}', '{"type":"content_block_delta","delta":{"type":"text_delta","text":"lo"}}', "not json", '{"type":"system"}']
    s = spark.createDataFrame([("a", k, x) for k, x in enumerate(lines)] + [("b", 0, lines[1]), ("b", 1, '{"type":"result","result":"Final","usage":{"output_tokens":7}}')], "stream_id string, seq int, line string")
    got = {r.stream_id: (r.text, r.tokens, r.garbage) for r in ev.fold(s).collect()}
    assert got == {"a": ("Hello", 1, False), "b": ("Final", 7, False)}
    assert one(spark, "rate limit reached", ev.is_garbage)


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    source = spark.read.parquet(f"{sf_dir}/events.parquet")
    source.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    ev.persist(stream, str(tmp_path / "out"), str(tmp_path / "ck"), available_now=True).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).exceptAll(source).isEmpty() and spark.read.parquet(str(tmp_path / "out")).count() == source.count()


def test_diagrams(spark):
    rows = ["fn f() {", "if a {", "x = 1;", "y = 2;", "z = 3;", "w = 4;", "}", "for k in v {", "return k;", "}"]
    made, links = documents.flowchart("f", rows)
    assert [k for _, k, _ in made] == ["entry", "decision", "process", "process", "loop", "exit", "exit"] and ("n4", "n4", "repeat") in links
    assert documents.flowcharts(spark.createDataFrame([(1, "f", "\n".join(rows))], "symbol_id long, name string, body string")).first().nodes[0]["label"] == "Start: f"
    assert documents.validate_mermaid("graph TD\n  a --> b") == [] and documents.validate_mermaid("") == ["Empty diagram"]
    assert len(documents.validate_mermaid("tree\n a[x -> b\n subgraph q")) == 4
    for text in ("graph TD\n  a --> b", "", "tree\n a[x -> b\n subgraph q", 'pie "(" ( {', '\n\ngantt\n "]\nend\nend', "  "):
        assert one(spark, text, documents.mermaid_errors) == documents.validate_mermaid(text)
    n, e = nodes(spark, ["main", "other"]), edges(spark, [(1, 2)])
    m = spark.createDataFrame([(1, 1), (2, 2)], "community_id long, symbol_id long")
    lab = spark.createDataFrame([(1, "core"), (2, "edge_case")], "community_id long, label string")
    text = documents.architecture(n, e, m, lab).first().mermaid
    assert documents.validate_mermaid(text) == [] and "-.->" in text and "Edge Case" in text
    chapters = documents.curriculum(m, lab, e, n.where("symbol_id = 1"), least=1).orderBy("position").collect()
    assert [c.title for c in chapters] == ["The Big Picture", "Edge Case", "Core", "Putting It All Together"] and chapters[2].prerequisites == [1] and len(chapters[0].sections) == 6
    asked = documents.quiz(n, e, m, lab).collect()
    assert all(3 <= sum(r.community_id == c for r in asked) <= 5 for c in (1, 2))
    parts = one(spark, "## Community 3: x\nA b\n## Community 12\nC", documents.split_batched)
    assert [(p["id"], p["body"]) for p in parts] == [(3, "A b"), (12, "C")]
    assert "<\\/script>" in documents.render('{"a": "</script>"}', "t")


def test_git_history(spark):
    import os

    from quarry.sources.history import git_history

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if not os.path.isdir(f"{root}/.git"):
        pytest.skip("no history here")
    h = git_history(spark, root, 5)
    assert {"path", "author"} <= set(h.columns)
    metrics.churn(h, 3).collect()


def test_numbering_parses_each_file_once(spark):
    made = spark.sparkContext.accumulator(0)

    def one(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    files = spark.createDataFrame([(f"{k}.py", "python", f"def f{k}():\n    g()\n") for k in range(6)], "path string, language string, content string").repartition(3)
    parsed = code.parse_sources(files.mapInArrow(one, files.schema), ["symbols"])
    assert "calls" not in parsed.columns
    rows = store.number_symbols(store.number_files(parsed)).orderBy("symbol_id").collect()
    assert [(r.symbol_id, r.file_id, r.name) for r in rows] == [(k + 1, k + 1, f"f{k}") for k in range(6)]
    assert made.value == 6


def test_store(spark, tmp_path):
    parsed = code.parse_sources(spark.createDataFrame([("b.py", "python", "def g():\n    pass\n"), ("a.py", "python", PY)], "path string, language string, content string"))
    files = store.number_files(parsed)
    ids = {(r.symbol_id, r.file_id, r.name) for r in store.number_symbols(files).collect()}
    assert ids == {(1, 1, "Child"), (2, 1, "run"), (3, 1, "helper"), (4, 2, "g")}
    folder = str(tmp_path / "db")
    for n in (1, 2):
        store.save({"edges": spark.range(n), "users": spark.range(n)}, folder)
    assert spark.read.parquet(f"{folder}/edges").count() == 2
    store.clear(spark, folder)
    assert not (tmp_path / "db" / "edges").exists() and spark.read.parquet(f"{folder}/users").count() == 2
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "B"), (3, "c")], "k int, v string")
    assert {tuple(r) for r in store.merge(old, new, ["k"]).collect()} == {(1, "a"), (2, "B"), (3, "c")}
    assert {tuple(r) for r in store.ignore_known(old, new, ["k"]).collect()} == {(1, "a"), (2, "b"), (3, "c")}
    notes = spark.createDataFrame([(1, "symbol", 5, "x", False), (2, "symbol", 5, "y", True)], "id int, target_type string, target_id int, content string, flagged boolean").withColumn("created_at", F.timestamp_seconds(F.col("id")))
    assert store.by_target(notes).first().contents == ["y", "x"] and store.toggle(notes, 1).where("flagged").count() == 2


def test_layers(spark):
    got = {r.symbol_id: r.layer for r in layout.layers(nodes(spark, list("abcde")), edges(spark, [(1, 2), (2, 3), (4, 5), (5, 4)])).collect()}
    assert got == {1: 0, 2: 1, 3: 2, 4: 3, 5: 3}


@pytest.mark.parametrize("pairs", [[(k, k + 1) for k in range(1, 60)], [(60, k) for k in range(1, 60)], [(k, 61 - k) for k in range(1, 30)] + [(k, k + 2) for k in range(1, 20)], [(1, 1), (2, 99), (3, 99), (4, 5), (5, 4)], []])
def test_weak_components_shrink(spark, monkeypatch, pairs):
    """Paths, a hub above its leaves, crossing pairs, loops, an end that is no node, no edges."""
    sizes, kept = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: (out := kept(df), sizes.append(out.count()) if set(out.columns) == {"low", "high"} else None)[0])
    own = {x: x for x in range(1, 61)}
    for _ in own:
        for a, b in pairs:
            if a in own and b in own:
                own[a] = own[b] = min(own[a], own[b])
    n = spark.range(1, 61).withColumnRenamed("id", "symbol_id")
    e = edges(spark, pairs) if pairs else edges(spark, [(1, 2)]).limit(0)
    assert {tuple(r) for r in graph.weak_components(n, e).collect()} == set(own.items())
    assert sizes[-1] == 0 and len(sizes) <= 4 and sum(sizes[1:]) <= sizes[0]  # edges of later rounds
