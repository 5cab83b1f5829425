"""More registered queries: reads, trees, search, contexts and the graph as built from parsed files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import detectors, documents, graph, lookups, metrics, progress, reads, resolve, search, tree
from ..sources import adapter
from ..sources.adapter import table
from .catalog import _DOCS, _OWN, _SYMS, _WS, BOTH, CALLS, CH, DOMINANT, LABELS, NAMES, _all_parts, _bm25_sql, _edges, _file_metrics, _parts, _sym, query

_FILE = "src/economy/brand_5.py"


# --- lookups --------------------------------------------------------------------------------------------------------


@query(" SELECT * FROM symbols WHERE symbol_id = 7")
def point_lookup(s: SparkSession, d: str) -> DataFrame:
    return reads.get(_sym(s, d), "symbol_id", 7)


@query(" SELECT * FROM symbols WHERE file_id = 3 AND kind = 'Method'")
def equality_filters(s: SparkSession, d: str) -> DataFrame:
    return reads.by(_sym(s, d), file_id=3, kind="Method")


@query(" SELECT symbol_id, name FROM symbols WHERE contains(lower(name), 'd_w')")
def substring_filter(s: SparkSession, d: str) -> DataFrame:
    return reads.holding(_sym(s, d), "name", "D_W", 2).select("symbol_id", "name")


@query(" SELECT symbol_id, name, kind, path, start_line, end_line FROM symbols WHERE symbol_id IN (1, 5, 7, 9, 100000000)")
def listed_symbols(s: SparkSession, d: str) -> DataFrame:
    return reads.listed_symbols(_sym(s, d), [1, 5, 7, 9, 100_000_000])


@query(" SELECT file_id AS id, CAST(1 AS BIGINT) AS at, path, 'written in ' || language AS reason FROM files")
def reading_lines(s: SparkSession, d: str) -> DataFrame:
    texts = adapter.files(_sym(s, d)).select(F.col("file_id").alias("id"), F.concat(F.lit("Read — in this order\n"), "file_id", F.lit(".  "), "path", F.lit(" — written in "), "language", F.lit("\nno more")).alias("content"))
    return reads.reading_lines(texts)


@query(" SELECT kind, count(*) AS n FROM symbols GROUP BY 1")
def symbols_by_kind(s: SparkSession, d: str) -> DataFrame:
    return reads.counts_by(_sym(s, d), "kind")


@query(" SELECT CASE WHEN z > 45 THEN 'error' WHEN z > 35 THEN 'warning' ELSE 'info' END AS severity, count(*) AS n FROM (SELECT end_line - start_line AS z FROM symbols WHERE kind IN ('Function', 'Method')) WHERE z > 25 GROUP BY 1")
def findings_by_severity(s: SparkSession, d: str) -> DataFrame:
    return reads.counts_by(detectors.long_method(_sym(s, d), 25, 35, 45), "severity")


@query(" SELECT file_id, path, sloc FROM files ORDER BY sloc DESC, path LIMIT 20")
def largest_files(s: SparkSession, d: str) -> DataFrame:
    return reads.top_files(adapter.files(_sym(s, d))).select("file_id", "path", "sloc")


_LIT = ", h AS (SELECT 7 AS symbol_id UNION SELECT target_id FROM edges WHERE source_id = 7 UNION SELECT source_id FROM edges WHERE target_id = 7)"


@query(_LIT + " SELECT CAST(symbol_id AS BIGINT) AS symbol_id FROM h")
def highlight(s: SparkSession, d: str) -> DataFrame:
    return reads.highlighted(_edges(s, d), 7)


@query(_LIT + " SELECT edge_id, source_id, target_id, kind, confidence FROM edges WHERE source_id IN (FROM h) AND target_id IN (FROM h)")
def focus_edges(s: SparkSession, d: str) -> DataFrame:
    return reads.focus(_edges(s, d), 7).select("edge_id", "source_id", "target_id", "kind", "confidence")


@query(", roots AS (SELECT target_id AS root FROM edges GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 5), r(root, node, depth) AS (SELECT root, root, 0 FROM roots UNION SELECT root, source_id, depth + 1 FROM r JOIN edges ON target_id = node WHERE depth < 2), m AS (SELECT root, node, min(depth) AS depth FROM r GROUP BY ALL) SELECT root, count(*) AS symbols, count(DISTINCT file_id) AS files FROM m JOIN symbols ON symbol_id = node WHERE depth > 0 GROUP BY 1")
def affected_files(s: SparkSession, d: str) -> DataFrame:
    e = _edges(s, d)
    roots = e.groupBy(F.col("target_id").alias("root")).count().orderBy(F.desc("count"), "root").limit(5).select("root")
    return reads.affected(graph.impact(e, roots, 2), _sym(s, d))


@query(" SELECT p.l_orderkey AS process_id, CAST(p.l_linenumber AS BIGINT) AS step_order, p.l_partkey AS symbol_id, name, path, o_orderpriority AS process FROM lineitem p LEFT JOIN symbols ON symbol_id = l_partkey LEFT JOIN orders ON o_orderkey = l_orderkey")
def flow_steps(s: SparkSession, d: str) -> DataFrame:
    steps = table(s, d, "lineitem").select(F.col("l_orderkey").alias("process_id"), F.col("l_linenumber").cast("long").alias("step_order"), F.col("l_partkey").alias("symbol_id"))
    return reads.flow_steps(steps, _sym(s, d), table(s, d, "orders").select(F.col("o_orderkey").alias("process_id"), F.col("o_orderpriority").alias("process")))


@query(" SELECT s.chapter_id, s.section_id, s.content_type, coalesce(p.done, false) AS done FROM sections s LEFT JOIN (SELECT chapter_id, section_id, bool_or(completed) AS done FROM sections WHERE section_id % 2 = 1 GROUP BY ALL) p USING (chapter_id, section_id)")
def sections_progress(s: SparkSession, d: str) -> DataFrame:
    sec = adapter.sections(s, d)
    return reads.sections_with_progress(sec, sec.where("section_id % 2 = 1").select("chapter_id", "section_id", "completed"))


@query(", c AS (SELECT DISTINCT chapter_id FROM sections) SELECT c.chapter_id, a.chapter_id AS previous, b.chapter_id AS following FROM c LEFT JOIN c a ON a.chapter_id = c.chapter_id - 1 LEFT JOIN c b ON b.chapter_id = c.chapter_id + 1")
def neighbouring_chapters(s: SparkSession, d: str) -> DataFrame:
    c = adapter.sections(s, d).select("chapter_id").distinct()
    return reads.neighbouring(c.withColumn("order_index", F.col("chapter_id")))


@query(_OWN + ", c AS (SELECT DISTINCT community_id * 10 AS chapter_id, CASE WHEN community_id % 5 <> 0 THEN community_id END AS community_id FROM members), t AS (SELECT doc_id % 30 AS community_id, min(text) AS content FROM documents WHERE doc_id % 2 = 0 GROUP BY 1) SELECT c.chapter_id, c.community_id, label, content FROM c LEFT JOIN labels USING (community_id) LEFT JOIN t USING (community_id)")
def chapter_texts(s: SparkSession, d: str) -> DataFrame:
    _, _, mem, lab = _parts(s, d)
    chapters = mem.select((F.col("community_id") * 10).alias("chapter_id"), F.when(F.col("community_id") % 5 != 0, F.col("community_id")).alias("community_id")).distinct()
    told = table(s, d, "documents").select(F.when(F.col("doc_id") % 2 == 0, "module_summary").otherwise("overview").alias("kind"), (F.col("doc_id") % 30).alias("target_id"), F.col("text").alias("content"))
    return reads.chapters_with_texts(chapters, lab, told)


def _notes(s, d) -> DataFrame:
    return table(s, d, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("target_type"), F.col("user_id").alias("target_id"), (F.col("value") > 10).alias("flagged"), F.col("ts").alias("created_at"), F.col("props").alias("content"))


@query("SELECT event_id AS id, event_type AS target_type, user_id AS target_id, row_number() OVER (PARTITION BY event_type, user_id ORDER BY value > 10 DESC, ts DESC, event_id) AS place FROM events", cte=False)
def annotation_order(s: SparkSession, d: str) -> DataFrame:
    return reads.notes(_notes(s, d)).select("id", "target_type", "target_id", "place")


@query("SELECT event_type AS target_type, user_id AS target_id, count(*) AS n, bool_or(value > 10) AS any_flagged, string_agg(props, ';' ORDER BY value > 10 DESC, ts DESC, props) AS contents FROM events GROUP BY ALL", cte=False)
def annotations_by_target(s: SparkSession, d: str) -> DataFrame:
    from ..operators import store

    return store.by_target(_notes(s, d).withColumn("created_at", F.col("created_at").cast("timestamp"))).withColumn("contents", F.array_join("contents", ";"))


# --- metrics --------------------------------------------------------------------------------------------------------


@query(" SELECT community_id, count(*) AS member_count, CAST(sum(end_line - greatest(start_line - 1, 0)) AS BIGINT) AS sloc FROM members JOIN symbols USING (symbol_id) GROUP BY 1")
def community_sloc(s: SparkSession, d: str) -> DataFrame:
    return metrics.community_sloc(_sym(s, d), adapter.members(s, d))


_CPX = ", cpx AS (SELECT file_id, avg(1 + (end_line - start_line + 1) / 10.0) AS complexity, count(*) AS churn FROM symbols GROUP BY 1)"
_Q = ", p AS (SELECT DISTINCT least(source_id, target_id) AS a, greatest(source_id, target_id) AS b FROM edges), mm AS (SELECT count(*) AS m FROM p), ll AS (SELECT p.*, x.community_id AS ca, y.community_id AS cb FROM p JOIN members x ON x.symbol_id = a JOIN members y ON y.symbol_id = b), ee AS (SELECT ca AS community_id, CASE WHEN ca = cb AND a <> b THEN 1 ELSE 0 END AS l FROM ll UNION ALL SELECT cb, 0 FROM ll), gg AS (SELECT community_id, sum(l) AS l, count(*) AS d FROM ee GROUP BY 1), qq AS (SELECT round(2.0 * l / (2 * m) - (d / (2 * m)) ** 2, 6)::DOUBLE AS q FROM gg, mm)"


@query(_CPX + _Q + " SELECT (SELECT count(*) FROM files) AS files, (SELECT CAST(sum(sloc) AS BIGINT) FROM files) AS sloc, (SELECT count(*) FROM symbols) AS symbols, (SELECT count(DISTINCT name) FROM symbols) AS names, (SELECT round(avg(complexity), 6) FROM cpx) AS avg_complexity, (SELECT round(sum(q), 4) FROM qq) AS modularity")
def repo_report(s: SparkSession, d: str) -> DataFrame:
    sym = _sym(s, d)
    return metrics.repo_report(_file_metrics(s, d), sym, graph.modularity(_edges(s, d), adapter.members(s, d)))


@query(", g AS (SELECT language, CAST(sum(sloc) AS BIGINT) AS s FROM files GROUP BY 1), t AS (SELECT CAST(sum(sloc) AS BIGINT) AS z, count(*) AS n FROM files) SELECT n AS files, z AS sloc, (SELECT count(*) FROM g) AS languages, CAST(floor(z / n + 0.5) AS BIGINT) AS avg_sloc, (SELECT string_agg(language || ':' || s || ':' || CAST(floor(100.0 * s / z + 0.5) AS BIGINT), ',' ORDER BY s DESC, language) FROM (SELECT g.*, t.z FROM g, t ORDER BY s DESC, language LIMIT 4)) AS top_languages FROM t")
def dashboard(s: SparkSession, d: str) -> DataFrame:
    return metrics.dashboard(adapter.files(_sym(s, d)))


_COLOR_CASES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in T.COLORS.items())


@query(f" SELECT file_id, CASE language {_COLOR_CASES} ELSE '{T.OTHER_COLOR}' END AS color FROM files")
def language_colors(s: SparkSession, d: str) -> DataFrame:
    return adapter.files(_sym(s, d)).select("file_id", T.language_color(F.col("language")).alias("color"))


# --- composite reads ------------------------------------------------------------------------------------------------


@query(_OWN + " SELECT (SELECT count(*) FROM files) AS file_count, (SELECT count(*) FROM symbols) AS symbol_count, (SELECT string_agg(t, ',' ORDER BY t) FROM (SELECT language || ':' || count(*) AS t FROM files GROUP BY language)) AS languages, (SELECT string_agg(community_id || ':' || label || ':' || printf('%.3f', floor(round(cohesion * 1000, 6) + 0.5) / 1000), ',' ORDER BY community_id) FROM own) AS communities, (SELECT count(*) FROM own) AS community_count, (SELECT count(DISTINCT chapter_id) FROM sections) AS chapter_count, (SELECT min(text) FROM documents WHERE doc_id = 1) AS overview")
def understand_codebase(s: SparkSession, d: str) -> DataFrame:
    sym, e, mem, lab = _parts(s, d)
    overview = table(s, d, "documents").where("doc_id = 1").select(F.col("text").alias("content"))
    return reads.understand(adapter.files(sym), sym, graph.cohesion(e, mem), lab, adapter.sections(s, d).select("chapter_id").distinct(), overview)


@query(_CPX + f" SELECT path, language, sloc, churn AS symbol_count, (SELECT string_agg(name || ':' || kind || ':' || start_line || ':' || end_line, ',' ORDER BY start_line, symbol_id) FROM symbols WHERE path = '{_FILE}') AS symbols, round(complexity, 6) AS complexity, churn, CAST(1 AS BIGINT) AS contributors FROM files JOIN cpx USING (file_id) WHERE path = '{_FILE}'")
def explain_file(s: SparkSession, d: str) -> DataFrame:
    sym = _sym(s, d)
    measures = _file_metrics(s, d).select("file_id", F.round("complexity", 6).alias("complexity"), "churn", F.lit(1).cast("long").alias("contributors"))
    return reads.explain_file(adapter.files(sym), sym, measures, _FILE)


@query(", t AS (SELECT doc_id AS symbol_id, min(text) AS told FROM documents WHERE doc_id % 3 = 0 GROUP BY 1) SELECT symbol_id, coalesce(told, name || ' is a ' || kind || ' defined at lines ' || start_line || '-' || end_line || '. Signature: N/A') AS explanation, CASE WHEN told IS NULL THEN 'generated-from-db' ELSE 'pre-generated' END AS source FROM symbols LEFT JOIN t USING (symbol_id)")
def explain_symbols(s: SparkSession, d: str) -> DataFrame:
    told = table(s, d, "documents").select(F.when(F.col("doc_id") % 3 == 0, "symbol_explanation").otherwise("overview").alias("kind"), F.col("doc_id").alias("target_id"), F.col("text").alias("content"))
    return reads.explain_symbols(_sym(s, d), told)


# --- trees ----------------------------------------------------------------------------------------------------------

_NODES = ", dirs AS (SELECT DISTINCT unnest([array_to_string(string_split(path, '/')[1:k], '/') FOR k IN range(1, len(string_split(path, '/')))]) AS path FROM files), nodes0 AS (SELECT 'directory' AS node_type, path, true AS is_dir FROM dirs UNION ALL SELECT 'file', path, false FROM files), nodes AS (SELECT node_type, path, array_to_string(string_split(path, '/')[1:-2], '/') AS parent, CAST(len(string_split(path, '/')) AS BIGINT) AS depth, string_split(path, '/')[-1] AS label, is_dir, CASE WHEN is_dir THEN '0' ELSE '1' END || string_split(path, '/')[-1] AS own, array_to_string([CASE WHEN i < len(string_split(path, '/')) OR is_dir THEN '0' ELSE '1' END || string_split(path, '/')[i] FOR i IN range(1, len(string_split(path, '/')) + 1)], chr(1)) AS key FROM nodes0)"


@query(_NODES + ", marked AS (SELECT *, own = max(own) OVER (PARTITION BY parent) AS last FROM nodes), bars AS (SELECT n.path, coalesce(string_agg(CASE WHEN a.last THEN '    ' ELSE '│   ' END, '' ORDER BY a.depth) FILTER (a.path IS NOT NULL), '') AS bars FROM marked n LEFT JOIN marked a ON a.depth BETWEEN 2 AND n.depth - 1 AND starts_with(n.path, a.path || '/') GROUP BY 1), ranked AS (SELECT m.*, bars, row_number() OVER (ORDER BY key) AS place, label || CASE WHEN is_dir THEN '/' ELSE '' END AS tail FROM marked m JOIN bars USING (path)) SELECT 'default' AS style, place, bars || CASE WHEN depth = 1 THEN '' WHEN last THEN '└── ' ELSE '├── ' END || tail AS line FROM ranked UNION ALL SELECT 'compact', place, repeat('  ', greatest(depth - 2, 0)) || CASE WHEN depth > 1 THEN '| ' ELSE '' END || tail FROM ranked UNION ALL SELECT 'minimal', place, repeat('  ', greatest(depth - 2, 0)) || tail FROM ranked")
def printed_trees(s: SparkSession, d: str) -> DataFrame:
    files = adapter.files(_sym(s, d))
    out = None
    for style in ("default", "compact", "minimal"):
        own = tree.printed_tree(files, style).select(F.lit(style).alias("style"), "place", "line")
        out = own if out is None else out.unionByName(own)
    return out


@query(_NODES + ", every AS (SELECT node_type, path, parent, depth, label FROM nodes UNION ALL SELECT 'symbol', path || '#' || symbol_id, path, CAST(len(string_split(path, '/')) AS BIGINT), name FROM symbols), kids AS (SELECT parent AS path, count(*) AS n FROM every GROUP BY 1) SELECT every.*, coalesce(n, 0) AS n_children FROM every LEFT JOIN kids USING (path) WHERE depth <= 3")
def schematic_symbols(s: SparkSession, d: str) -> DataFrame:
    sym = _sym(s, d)
    return tree.schematic(adapter.files(sym), sym, 3)


@query(_NODES + " SELECT node_type, path, parent, depth, label, (SELECT count(*) FROM nodes c WHERE c.parent = nodes.path) AS n_children FROM nodes WHERE NOT starts_with(path, 'src/large/')")
def collapsed_tree(s: SparkSession, d: str) -> DataFrame:
    return tree.collapse(tree.schematic(adapter.files(_sym(s, d)), None, 9), "src/large")


@query(_NODES + " SELECT node_type, path FROM nodes WHERE NOT is_dir AND contains(lower(path), 'brand_1') UNION ALL SELECT node_type, path FROM nodes WHERE is_dir AND EXISTS (SELECT 1 FROM files WHERE contains(lower(files.path), 'brand_1') AND starts_with(files.path, nodes.path || '/'))")
def matching_tree(s: SparkSession, d: str) -> DataFrame:
    return tree.matching(adapter.files(_sym(s, d)), "Brand_1")


@query(" SELECT DISTINCT file_id, path FROM symbols JOIN members USING (symbol_id) WHERE community_id = 12")
def community_files(s: SparkSession, d: str) -> DataFrame:
    sym = _sym(s, d)
    return tree.of_community(adapter.files(sym), sym, adapter.members(s, d), 12).select("file_id", "path")


@query(f" SELECT symbol_id, name, kind, start_line, end_line FROM symbols WHERE path = '{_FILE}'")
def expanded_file(s: SparkSession, d: str) -> DataFrame:
    return tree.expand_file(_sym(s, d), _edges(s, d), _FILE)[0]


@query(LABELS + DOMINANT + CH + ", a AS (SELECT community_id, unnest([array_to_string(string_split(path, '/')[1:k], '/') FOR k IN range(1, len(string_split(path, '/')))]) AS dir FROM dom), c AS (SELECT dir, community_id, count(*) AS n FROM a GROUP BY ALL), x AS (SELECT 'directory' AS node_type, dir AS path, community_id FROM c QUALIFY row_number() OVER (PARTITION BY dir ORDER BY n DESC, community_id) = 1 UNION ALL SELECT 'file', path, community_id FROM files LEFT JOIN (SELECT path, community_id FROM dom) USING (path)), k AS (SELECT DISTINCT community_id, community_id * 3 AS chapter_id FROM members) SELECT node_type, path, x.community_id, label, x.community_id % 10 AS color, k.chapter_id, done, total FROM x LEFT JOIN labels USING (community_id) LEFT JOIN k USING (community_id) LEFT JOIN ch ON ch.chapter_id = k.chapter_id")
def enriched_tree(s: SparkSession, d: str) -> DataFrame:
    sym, _, mem, lab = _parts(s, d)
    files = adapter.files(sym)
    dom = metrics.dominant_community(sym, mem).join(files.select("file_id", "path"), "file_id")
    chapters = mem.select("community_id", (F.col("community_id") * 3).alias("chapter_id")).distinct()
    done = progress.chapter_progress(adapter.sections(s, d)).select("chapter_id", "done", "total")
    return tree.enriched(files, dom, lab, done, chapters)


# --- search ---------------------------------------------------------------------------------------------------------

_FILES = f"SELECT file_id AS id, list_concat({_WS.format('path')}, {_WS.format('language')}) AS ws FROM files"


def _names(s, d) -> DataFrame:
    return _sym(s, d).withColumnRenamed("symbol_id", "id")


@query(" SELECT id, score FROM " + _bm25_sql(_SYMS, ["emit cold", "class"], 50))
def phrase_search(s: SparkSession, d: str) -> DataFrame:
    return search.bm25(_names(s, d), ["name", "kind"], "emit_cold class", 50).select("id", F.round("score", 6).alias("score"))


_THREE = ", a0 AS (SELECT *, row_number() OVER (ORDER BY raw DESC, id) - 1 AS p FROM " + _bm25_sql(_FILES, ["economy"], 20) + "), a1 AS (SELECT *, row_number() OVER (ORDER BY raw DESC, id) - 1 AS p FROM " + _bm25_sql(_SYMS, ["economy"], 20) + "), a2 AS (SELECT *, row_number() OVER (ORDER BY raw DESC, id) - 1 AS p FROM " + _bm25_sql(_DOCS, ["economy"], 20) + ")"


@query(_THREE.replace("economy", "the") + " SELECT kind, id, round(1.0 / (60 + p), 9)::DOUBLE AS score FROM (SELECT 0 AS l, 'file' AS kind, id, p FROM a0 UNION ALL SELECT 1, 'symbol', id, p FROM a1 UNION ALL SELECT 2, 'narrative', id, p FROM a2) ORDER BY 1.0 / (60 + p) DESC, l, p LIMIT 20")
def search_everything(s: SparkSession, d: str) -> DataFrame:
    return search.search(_tables(s, d), "The")


@query(" SELECT 'file' AS kind, id, score FROM " + _bm25_sql(_FILES, ["economy"], 20))
def search_files(s: SparkSession, d: str) -> DataFrame:
    return search.search(_tables(s, d), "Economy", "file")


def _tables(s, d) -> dict:
    docs = table(s, d, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("kind"), F.col("text").alias("content"))
    files = adapter.files(_sym(s, d)).withColumnRenamed("file_id", "id")
    return {"file": (files, ["path", "language"]), "symbol": (_names(s, d), ["name", "kind"]), "narrative": (docs, ["kind", "content"])}


@query(" SELECT id, score FROM " + _bm25_sql(_SYMS, ["emit cold", "class"], 50))
def indexed_search(s: SparkSession, d: str) -> DataFrame:
    docs = _names(s, d)
    index = search.build_index(docs, ["name", "kind"])
    return search.search_index(index, search.index_totals(docs, ["name", "kind"]), "emit_cold class", 50).select("id", F.round("score", 6).alias("score"))


@query(f", x AS (SELECT id, unnest(ws) AS term FROM (SELECT CASE WHEN id % 5 = 0 THEN list_concat(ws, ['changed']) ELSE ws END AS ws, id FROM ({_SYMS}) WHERE id % 7 <> 0 OR id % 5 = 0)) SELECT term, count(DISTINCT id) AS docs, count(*) AS places FROM x GROUP BY 1")
def changed_index(s: SparkSession, d: str) -> DataFrame:
    docs = _names(s, d).select("id", "name", "kind")
    new = docs.where("id % 5 = 0").withColumn("kind", F.concat("kind", F.lit(" changed")))
    index = search.changed_index(search.build_index(docs, ["name", "kind"]), docs.where("id % 7 = 0").select("id"), new, ["name", "kind"])
    return index.groupBy("term").agg(F.count(F.lit(1)).alias("docs"), F.sum(F.size("p0") + F.size("p1")).alias("places"))


# --- the graph as built ---------------------------------------------------------------------------------------------

_BUILT = CALLS + NAMES + """, c AS (SELECT coalesce(f1.in_file, n1.first) AS source_id, coalesce(f2.in_file, n2.first) AS target_id, 'CALLS' AS kind, CASE WHEN f2.in_file IS NOT NULL THEN 1.0 WHEN n2.n = 1 THEN 0.7 ELSE 0.4 END::DOUBLE AS confidence, 0 AS rank FROM calls c LEFT JOIN by_file f1 ON f1.name = caller AND f1.path = c.path LEFT JOIN by_name n1 ON n1.name = caller LEFT JOIN by_file f2 ON f2.name = callee AND f2.path = c.path LEFT JOIN by_name n2 ON n2.name = callee),
i AS (SELECT DISTINCT a.file_id AS f1, b.file_id AS f2 FROM edges JOIN symbols a ON a.symbol_id = source_id JOIN symbols b ON b.symbol_id = target_id WHERE edges.kind = 'IMPORTS' AND a.language = 'typescript' AND b.language = 'typescript' AND a.path <> b.path), heads AS (SELECT file_id, min(symbol_id) AS head FROM symbols GROUP BY 1),
m AS (SELECT a.head AS source_id, b.head AS target_id, 'IMPORTS' AS kind, 0.6::DOUBLE AS confidence, 1 AS rank FROM i JOIN heads a ON a.file_id = f1 JOIN heads b ON b.file_id = f2),
h AS (SELECT c.first AS source_id, p.first AS target_id, edges.kind, 1.0::DOUBLE AS confidence, 2 AS rank FROM edges JOIN (SELECT symbol_id, name FROM symbols) a ON a.symbol_id = source_id JOIN (SELECT symbol_id, name FROM symbols) b ON b.symbol_id = target_id JOIN by_name c ON c.name = a.name JOIN by_name p ON p.name = b.name WHERE edges.kind IN ('EXTENDS', 'IMPLEMENTS'))
SELECT row_number() OVER (ORDER BY rank, source_id, target_id, kind, confidence) AS edge_id, source_id, target_id, kind, confidence FROM (SELECT * FROM c UNION ALL SELECT * FROM m UNION ALL SELECT * FROM h)"""


@query(_BUILT)
def graph_build(s: SparkSession, d: str) -> DataFrame:
    """The relations as nested parsed files, and the graph that they make."""
    sym, e = _sym(s, d), _edges(s, d)
    a = sym.select(F.col("symbol_id").alias("source_id"), "path", F.col("language").alias("language"), F.col("name").alias("a"))
    b = sym.select(F.col("symbol_id").alias("target_id"), F.col("path").alias("to"), F.col("language").alias("to_language"), F.col("name").alias("b"))
    both = e.join(a, "source_id").join(b, "target_id")
    module = F.concat(F.lit("./"), F.regexp_replace(F.element_at(F.split("to", "/"), -1), r"\.ts$", ""))
    near = (F.col("kind") == "IMPORTS") & (F.col("language") == "typescript") & (F.col("to_language") == "typescript") & (F.col("path") != F.col("to"))
    parsed = both.groupBy("path", "language").agg(
        F.collect_list(F.when(F.col("kind") == "CALLS", F.struct(F.col("a").alias("caller"), F.col("b").alias("callee")))).alias("calls"),
        F.collect_set(F.when(near, F.struct(module.alias("module")))).alias("imports"),
        F.collect_list(F.when(F.col("kind").isin("EXTENDS", "IMPLEMENTS"), F.struct(F.col("a").alias("child"), F.col("b").alias("parent"), F.col("kind").alias("relation")))).alias("heritage"),
    )
    return resolve.build_graph(parsed, sym, adapter.files(sym).select("file_id", "path"))


# --- texts about symbols and communities ----------------------------------------------------------------------------

_SIDES = """, home AS (SELECT symbol_id, label FROM members JOIN labels USING (community_id)),
dn AS (SELECT source_id AS symbol_id, o.name, row_number() OVER (PARTITION BY source_id ORDER BY edge_id DESC) AS r FROM edges JOIN symbols o ON o.symbol_id = target_id), un AS (SELECT target_id AS symbol_id, o.name, row_number() OVER (PARTITION BY target_id ORDER BY edge_id DESC) AS r FROM edges JOIN symbols o ON o.symbol_id = source_id)"""


def _title_of(x: str) -> str:
    from .catalog import _title

    return _title(x)


@query(LABELS + _SIDES + f""", d5 AS (SELECT symbol_id, string_agg('`' || name || '`', ', ' ORDER BY r) AS t FROM dn WHERE r <= 5 GROUP BY 1), u5 AS (SELECT symbol_id, string_agg('`' || name || '`', ', ' ORDER BY r) AS t FROM un WHERE r <= 5 GROUP BY 1)
SELECT s.symbol_id, '## `' || name || '`\n\n**Kind:** ' || kind || ' | **Module:** ' || coalesce({_title_of('label')}, 'uncategorized') || coalesce('\n\n**Calls:** ' || d5.t, '') || coalesce('\n\n**Called by:** ' || u5.t, '') AS content FROM symbols s LEFT JOIN home USING (symbol_id) LEFT JOIN d5 USING (symbol_id) LEFT JOIN u5 USING (symbol_id)""")
def symbol_explanations(s: SparkSession, d: str) -> DataFrame:
    return documents.explanations(*_parts(s, d))


@query(LABELS + _SIDES + """, d20 AS (SELECT symbol_id, string_agg('- ' || name, '\n' ORDER BY r) FILTER (r <= 20) AS t, count(*) AS n FROM dn GROUP BY 1), u20 AS (SELECT symbol_id, string_agg('- ' || name, '\n' ORDER BY r) FILTER (r <= 20) AS t, count(*) AS n FROM un GROUP BY 1)
SELECT s.symbol_id, '# Symbol: ' || name || '\n\n- **Kind:** ' || kind || '\n- **Symbol ID:** ' || s.symbol_id || '\n- **File ID:** ' || file_id || '\n' || coalesce('- **Community:** ' || label || '\n', '') || '\n'
  || coalesce('## Called By\n\n' || u20.t || '\n' || CASE WHEN u20.n > 20 THEN '... and ' || (u20.n - 20) || ' more callers\n' ELSE '' END || '\n', '') || coalesce('## Calls\n\n' || d20.t || '\n' || CASE WHEN d20.n > 20 THEN '... and ' || (d20.n - 20) || ' more callees\n' ELSE '' END || '\n', '') AS context
FROM symbols s LEFT JOIN home USING (symbol_id) LEFT JOIN d20 USING (symbol_id) LEFT JOIN u20 USING (symbol_id)""")
def symbol_contexts(s: SparkSession, d: str) -> DataFrame:
    return documents.symbol_contexts(*_parts(s, d))


_TWO = "printf('%.2f', floor(round(cohesion * 100, 6) + 0.5) / 100)"


@query(_OWN + f""", held50 AS (SELECT community_id, string_agg('- **' || name || '** (' || kind || ')', '\n' ORDER BY r) AS t FROM (SELECT community_id, name, kind, row_number() OVER (PARTITION BY community_id ORDER BY symbol_id) AS r FROM members JOIN symbols USING (symbol_id)) WHERE r <= 50 GROUP BY 1),
out20 AS (SELECT community_id, string_agg('- ' || a.name || ' → ' || b.name, '\n' ORDER BY r) AS t FROM (SELECT ca AS community_id, source_id, target_id, row_number() OVER (PARTITION BY ca ORDER BY source_id, edge_id DESC) AS r FROM lab WHERE ca <> cb) x JOIN symbols a ON a.symbol_id = source_id JOIN symbols b ON b.symbol_id = target_id WHERE r <= 20 GROUP BY 1)
SELECT community_id, '# Community: ' || label || '\n\n- **ID:** ' || community_id || '\n- **Members:** ' || n_members || '\n- **Cohesion:** ' || {_TWO} || '\n\n## Members\n\n' || coalesce(held50.t || '\n', '') || CASE WHEN n_members > 50 THEN '\n... and ' || (n_members - 50) || ' more members\n' ELSE '' END
  || CASE WHEN outgoing > 0 THEN '\n## External Dependencies\n\n' || out20.t || '\n' || CASE WHEN outgoing > 20 THEN '\n... and ' || (outgoing - 20) || ' more external edges\n' ELSE '' END ELSE '' END AS context FROM own LEFT JOIN held50 USING (community_id) LEFT JOIN out20 USING (community_id) LEFT JOIN leave USING (community_id)""")
def community_contexts(s: SparkSession, d: str) -> DataFrame:
    sym, e, mem, lab = _parts(s, d)
    return documents.community_contexts(sym, e, mem, lab, graph.cohesion(e, mem))


def _entries_sql() -> str:
    from .catalog import ENTRY

    return ENTRY


@query(_entries_sql() + _OWN + f""", ten AS (SELECT community_id, string_agg(name, ', ' ORDER BY symbol_id) AS names FROM (SELECT community_id, symbol_id, name, row_number() OVER (PARTITION BY community_id ORDER BY symbol_id) AS r FROM members JOIN symbols USING (symbol_id)) WHERE r <= 10 GROUP BY 1),
c1 AS (SELECT string_agg(nth || '. **' || label || '** — ' || n_members || ' members (cohesion: ' || {_TWO} || ')' || '\n   Members: ' || names || CASE WHEN n_members > 10 THEN ' ... and ' || (n_members - 10) || ' more' ELSE '' END, '\n' ORDER BY nth) AS t FROM (SELECT *, row_number() OVER (ORDER BY community_id) AS nth FROM own JOIN ten USING (community_id))),
e1 AS (SELECT string_agg('- **' || name || '** (score: ' || printf('%.2f', score) || ') — ' || reason, '\n' ORDER BY score DESC, symbol_id) AS t FROM (SELECT * FROM entries ORDER BY score DESC, symbol_id LIMIT 10)), k1 AS (SELECT string_agg('- ' || kind || ': ' || n, '\n' ORDER BY n DESC, kind) AS t FROM (SELECT kind, count(*) AS n FROM symbols GROUP BY 1))
SELECT '# Repository Overview\n\n- **Symbols:** ' || (SELECT count(*) FROM symbols) || '\n- **Relationships:** ' || (SELECT count(*) FROM edges) || '\n- **Communities:** ' || (SELECT count(*) FROM own) || '\n\n## Communities\n\n' || c1.t || '\n\n' || coalesce('## Entry Points\n\n' || e1.t || '\n' || (SELECT CASE WHEN count(*) > 10 THEN '  ... and ' || (count(*) - 10) || ' more entry points\n' ELSE '' END FROM entries) || '\n', '') || '## Symbol Kinds\n\n' || k1.t || '\n' AS context FROM c1, e1, k1""")
def overview_context(s: SparkSession, d: str) -> DataFrame:
    return documents.overview_context(*_all_parts(s, d))


@query(f", f AS (SELECT *, row_number() OVER (ORDER BY path, symbol_id) AS r FROM symbols WHERE path IN ('{_FILE}', 'src/none.py')) SELECT '# File Context\n\nRequested files: {_FILE}, src/none.py\n\n## Symbols in Graph\n\n' || coalesce(string_agg('- ' || name || ' (' || kind || ')', '\n' ORDER BY r) FILTER (r <= 100), '') || '\n' || CASE WHEN count(*) > 100 THEN '\n... and ' || (count(*) - 100) || ' more symbols\n' ELSE '' END AS context FROM f")
def files_context(s: SparkSession, d: str) -> DataFrame:
    return documents.files_context(_sym(s, d), [_FILE, "src/none.py"])


@query(LABELS + CH + """, dn AS (SELECT DISTINCT target_id AS symbol_id FROM edges WHERE source_id = 7), un AS (SELECT DISTINCT source_id AS symbol_id FROM edges WHERE target_id = 7), k AS (SELECT DISTINCT community_id, community_id * 3 AS chapter_id FROM members)
SELECT s.symbol_id, name, kind, path, label, (SELECT string_agg(symbol_id, ',' ORDER BY symbol_id) FROM (FROM un ORDER BY 1 LIMIT 20)) AS callers, (SELECT string_agg(symbol_id, ',' ORDER BY symbol_id) FROM (FROM dn ORDER BY 1 LIMIT 20)) AS callees, k.chapter_id, done, total
FROM symbols s LEFT JOIN members m ON m.symbol_id = s.symbol_id LEFT JOIN labels USING (community_id) LEFT JOIN k USING (community_id) LEFT JOIN ch ON ch.chapter_id = k.chapter_id WHERE s.symbol_id = 7""")
def node_detail(s: SparkSession, d: str) -> DataFrame:
    sym, e, mem, lab = _parts(s, d)
    chapters = mem.select("community_id", (F.col("community_id") * 3).alias("chapter_id")).distinct()
    return tree.node_detail(sym, e, mem, lab, chapters, progress.chapter_progress(adapter.sections(s, d)), 7)


@query(" SELECT repo_path, step_name, status, error_message FROM (SELECT event_type AS repo_path, user_id AS step_name, props AS status, CAST(value AS VARCHAR) AS error_message, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def pipeline_state(s: SparkSession, d: str) -> DataFrame:
    runs = table(s, d, "events").select(F.col("event_type").alias("repo_path"), F.col("user_id").alias("step_name"), F.col("props").alias("status"), F.col("value").cast("string").alias("error_message"), "ts")
    return lookups.latest_state(runs)


@query(BOTH + " SELECT ca AS community_id, count(*) AS outgoing, count(DISTINCT cb) AS communities FROM lab WHERE ca <> cb GROUP BY 1")
def external_links(s: SparkSession, d: str) -> DataFrame:
    w = graph.community_edges(_edges(s, d), adapter.members(s, d))
    return w.groupBy(F.col("source_community").alias("community_id")).agg(F.sum("weight").alias("outgoing"), F.count(F.lit(1)).alias("communities"))
