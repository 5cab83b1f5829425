"""Registered queries of what reads texts and keeps state: parsers, spans, kept-up analysis, stored index, batched streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import documents, incremental, layout, metrics, resolve, spans, store, text_store
from ..sources import adapter, code, ignore
from ..sources.adapter import PARSED_CTE, table
from ..streaming import batching
from .catalog import _DOCS, _bm25_sql, _edges, _sym, query
from .lineage import cut, numbered
from .shared import new_folder


def _files(s, d) -> DataFrame:
    return adapter.code_files(_sym(s, d), _edges(s, d))


def _parsed(s, d, parts=code.RELATIONS) -> DataFrame:
    return code.parse_sources(_files(s, d), parts)


# --- parsers ----------------------------------------------------------------------------------------------------------


@query(PARSED_CTE + " SELECT path, language, name, kind, start_line, end_line FROM written")
def parse_symbols(s: SparkSession, d: str) -> DataFrame:
    return code.flat(_parsed(s, d, ["symbols"]), "symbols").select("path", "language", "name", "kind", "start_line", "end_line")


@query(PARSED_CTE + " SELECT a.path, a.name AS caller, b.name AS callee, CAST(a.start_line + row_number() OVER (PARTITION BY source_id ORDER BY edge_id) AS BIGINT) AS line FROM edges JOIN written a ON a.symbol_id = source_id JOIN (SELECT symbol_id, name FROM symbols) b ON b.symbol_id = target_id WHERE edges.kind = 'CALLS'")
def parse_calls(s: SparkSession, d: str) -> DataFrame:
    """Calls with the innermost definition around each, as the parsers say it."""
    return code.flat(_parsed(s, d, ["calls"]), "calls").select("path", "caller", "callee", "line")


@query(PARSED_CTE + " SELECT a.path, a.name AS caller, b.name AS callee FROM edges JOIN written a ON a.symbol_id = source_id JOIN (SELECT symbol_id, name FROM symbols) b ON b.symbol_id = target_id WHERE edges.kind = 'CALLS'")
def enclosing_callers(s: SparkSession, d: str) -> DataFrame:
    """The same from lines and spans alone: calls as points, definitions as spans."""
    parsed = cut(_parsed(s, d, ["symbols", "calls"]))  # both sides read it
    defs = code.flat(parsed, "symbols").select("path", F.col("start_line").alias("lo"), F.col("end_line").alias("hi"), "name")
    calls = code.flat(parsed, "calls").select("path", F.col("line").alias("at"), "callee")
    return spans.innermost(calls, defs, ["name"]).select("path", F.coalesce("inner.name", F.lit(code.MODULE)).alias("caller"), "callee")


@query(PARSED_CTE + " SELECT path AS source_path, target AS target_path FROM own_imports")
def import_all_languages(s: SparkSession, d: str) -> DataFrame:
    """Imports of six languages from their texts to files."""
    imports = code.flat(_parsed(s, d, ["imports"]), "imports").select("path", "language", "module")
    paths = _sym(s, d).select(F.col("path").alias("file_id"), "path").distinct()
    return resolve.import_edges(imports, paths).select(F.col("source_file").alias("source_path"), F.col("target_file").alias("target_path"))


@query(PARSED_CTE + " SELECT nth AS symbol_id, dense_rank() OVER (ORDER BY path) AS file_id, name, kind, start_line, end_line FROM placed")
def stored_symbols(s: SparkSession, d: str) -> DataFrame:
    """Ids as a first analysis gives them: files by path, symbols by file and place."""
    return store.number_symbols(store.number_files(_parsed(s, d, ["symbols"]))).select("symbol_id", "file_id", "name", "kind", "start_line", "end_line")


# --- spans ------------------------------------------------------------------------------------------------------------

_LINES = "WITH docs AS (SELECT doc_id, 'doc/' || doc_id AS path, string_split(text, chr(10)) AS ls FROM documents), points AS (SELECT doc_id, path, unnest(range(1, len(ls) + 1)) AS k, unnest(ls) AS line FROM docs), held AS (SELECT path, k AS lo, k + (doc_id * 7 + k * 5) % 11 AS hi, doc_id * 1000 + k AS symbol_id FROM points WHERE k % 3 = 1)"


def _document_spans(s, d) -> tuple[DataFrame, DataFrame]:
    """Lines of texts as points, and nested and crossing spans that begin at every third line."""
    docs = table(s, d, "documents").select("doc_id", F.concat(F.lit("doc/"), F.col("doc_id")).alias("path"), "text")
    points = docs.select("doc_id", "path", F.explode(F.sequence(F.lit(1), F.size(F.split("text", "\n", -1))).cast("array<bigint>")).alias("at"))
    own = points.where("at % 3 = 1").select("path", F.col("at").alias("lo"), (F.col("at") + (F.col("doc_id") * 7 + F.col("at") * 5) % 11).alias("hi"), (F.col("doc_id") * 1000 + F.col("at")).alias("symbol_id"))
    return points.select("path", "at"), own


@query(_LINES + ' SELECT path, k AS "at", symbol_id FROM points JOIN held USING (path) WHERE k BETWEEN lo AND hi QUALIFY row_number() OVER (PARTITION BY path, k ORDER BY hi - lo, lo) = 1', cte=False)
def innermost_span(s: SparkSession, d: str) -> DataFrame:
    points, own = _document_spans(s, d)
    return spans.innermost(points, own, ["symbol_id"]).where("inner is not null").select("path", "at", "inner.symbol_id")


@query(_LINES + r""", costs AS (SELECT path, k, contains(line, 'if')::INT + contains(line, '&&')::INT + contains(line, '||')::INT + contains(line, '?')::INT + len(list_filter(regexp_split_to_array(line, '[^\p{L}\p{N}_]+'), lambda w: w IN ('else','elif','match','case','for','while','try','catch','except'))) AS n FROM points),
each AS (SELECT held.path, symbol_id, 1.0 + coalesce(sum(n), 0) AS c FROM held LEFT JOIN costs ON costs.path = held.path AND k BETWEEN lo AND hi GROUP BY held.path, symbol_id) SELECT path, round(avg(c), 6)::DOUBLE AS complexity FROM each GROUP BY path""", cte=False)
def text_complexity(s: SparkSession, d: str) -> DataFrame:
    """Mean complexity of the symbols of each text, from their own lines."""
    docs = table(s, d, "documents").select(F.concat(F.lit("doc/"), F.col("doc_id")).alias("path"), F.col("text").alias("content"))
    own = _document_spans(s, d)[1].select("path", "symbol_id", F.col("lo").alias("start_line"), F.col("hi").alias("end_line"))
    out = metrics.file_complexity(docs.select("path"), metrics.symbol_complexity(docs, own))
    return out.select("path", F.round("complexity", 6).alias("complexity"))


# --- state ------------------------------------------------------------------------------------------------------------


@query(PARSED_CTE + """, by_file AS (SELECT name, path, max(nth) AS in_file FROM placed GROUP BY ALL), by_name AS (SELECT name, min(nth) AS first, count(*) AS n FROM placed GROUP BY name), heads AS (SELECT path, min(nth) AS head FROM placed GROUP BY path),
e AS (SELECT a.path, coalesce(f1.in_file, n1.first) AS s, coalesce(f2.in_file, n2.first) AS t, 'CALLS' AS kind, CASE WHEN f2.in_file IS NOT NULL THEN 1.0 WHEN n2.n = 1 THEN 0.7 ELSE 0.4 END::DOUBLE AS confidence
  FROM (SELECT source_id, target_id FROM edges WHERE kind = 'CALLS') JOIN symbols a ON a.symbol_id = source_id JOIN symbols b ON b.symbol_id = target_id LEFT JOIN by_file f1 ON f1.name = a.name AND f1.path = a.path LEFT JOIN by_name n1 ON n1.name = a.name LEFT JOIN by_file f2 ON f2.name = b.name AND f2.path = a.path LEFT JOIN by_name n2 ON n2.name = b.name
  UNION ALL SELECT i.path, x.head, y.head, 'IMPORTS', 0.6::DOUBLE FROM own_imports i JOIN heads x ON x.path = i.path JOIN heads y ON y.path = i.target)
SELECT s AS source_nth, t AS target_nth, kind, confidence FROM e""")
def incremental_graph(s: SparkSession, d: str) -> DataFrame:
    """A corpus that grew and changed, brought up to date by a second run: the edges of a whole rebuild."""
    files, root = cut(_files(s, d)), f"{new_folder(s, 'incremental')}/state"
    nth = F.crc32(F.col("path").cast("binary")) % 10
    half = F.expr("substring(content, 1, cast(length(content) / 2 as int))")
    before = files.where(nth < 9).withColumns({"content": F.when(nth == 0, half).otherwise(F.col("content")), "mtime": F.when(nth == 0, F.col("mtime") - F.expr("interval 1 day")).otherwise(F.col("mtime"))})
    incremental.update(before.unionByName(before.limit(1).withColumn("path", F.lit("src/gone.py"))), root)
    incremental.update(files, root)
    placed = incremental.identified(incremental.parsed(s, root)).select("symbol_id")
    ids = numbered(placed.select("symbol_id.*"), ["path", "start_line", "name"], "nth").select(F.struct("path", "start_line", "name").alias("id"), "nth")
    edges = incremental.edges(s, root)
    a, b = ids.select(F.col("id").alias("source"), F.col("nth").alias("source_nth")), ids.select(F.col("id").alias("target"), F.col("nth").alias("target_nth"))
    return edges.join(a, "source").join(b, "target").select("source_nth", "target_nth", "kind", "confidence")


@query("SELECT id, score FROM " + _bm25_sql(_DOCS, ["license", "the"], 50), cte=False)
def stored_search(s: SparkSession, d: str) -> DataFrame:
    """A ranking from the stored index, of which only the buckets of its two terms are read."""
    docs, root = table(s, d, "documents").withColumnRenamed("doc_id", "id"), f"{new_folder(s, 'index')}/index"
    text_store.add_batch(docs.where("id % 2 = 0"), ["lang", "text"], root, 0)
    text_store.add_batch(docs.where("id % 2 = 1 or id < 50"), ["lang", "text"], root, 1)  # some come again
    return text_store.search_stored(s, root, "license the", 2, 50).select("id", F.round("score", 6).alias("score"))


_SHARDS, _SECONDS = 4, 1800


@query(f"""WITH RECURSIVE e AS (SELECT event_id % {_SHARDS} AS shard, event_id, epoch_ms(ts) AS ms, row_number() OVER (PARTITION BY event_id % {_SHARDS} ORDER BY epoch_ms(ts), event_id) AS k FROM events),
g AS (SELECT shard, k, ms, event_id, CAST(0 AS BIGINT) AS batch, 1 AS n, ms AS began FROM e WHERE k = 1
  UNION ALL SELECT e.shard, e.k, e.ms, e.event_id, CASE WHEN g.n = 50 OR e.ms >= g.began + {_SECONDS * 1000} THEN g.batch + 1 ELSE g.batch END, CASE WHEN g.n = 50 OR e.ms >= g.began + {_SECONDS * 1000} THEN 1 ELSE g.n + 1 END, CASE WHEN g.n = 50 OR e.ms >= g.began + {_SECONDS * 1000} THEN e.ms ELSE g.began END FROM g JOIN e ON e.shard = g.shard AND e.k = g.k + 1)
SELECT shard, batch, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM g GROUP BY shard, batch, began HAVING count(*) = 50 OR began + {_SECONDS * 1000} <= (SELECT max(ms) FROM e)""", cte=False)
def event_writer(s: SparkSession, d: str) -> DataFrame:
    """Events through a stream that writes batches of at most 50 or half an hour; those that are closed when the stream ends."""
    folder = new_folder(s, "events")
    stream = s.readStream.schema(table(s, d, "events").schema).parquet(f"{d}/events.parque[t]")
    rows = batching.batched(stream.select("event_id", "ts", "event_type", "value"), F.col("event_id") % _SHARDS, seconds=_SECONDS)
    batching.write(rows, f"{folder}/out", f"{folder}/mark", available_now=True).awaitTermination()
    out = s.read.parquet(f"{folder}/out").withColumn("shard", F.col("shard").cast("long"))
    return out.groupBy("shard", "batch").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


# --- ignore files -----------------------------------------------------------------------------------------------------

#: Ignore files of the corpus, by folder.
_IGNORE = [("", "# all\n\n*.js\n!brand_1*.js\nsrc/**/brand_3?.rs\n"), ("src", "promo/\n/small/brand_[!12]*.go\n"), ("src/promo", "!*.rs\n"), ("src/large", "brand_*\n!brand_11.ts\nnone/**\n")]


@query(r" SELECT path, language FROM files WHERE NOT (path LIKE 'src/promo/%' OR (path LIKE '%.js' AND NOT regexp_matches(path, '/brand_1[^/]*\.js$')) OR regexp_matches(path, '^src/(.*/)?brand_3.\.rs$') OR regexp_matches(path, '^src/small/brand_[^12][^/]*\.go$') OR (path LIKE 'src/large/brand\_%' ESCAPE '\' AND path <> 'src/large/brand_11.ts'))")
def unignored_files(s: SparkSession, d: str) -> DataFrame:
    files = adapter.files(_sym(s, d)).select("path", "language")
    return ignore.unignored(files, s.createDataFrame(_IGNORE, "folder string, content string"))


# --- layout -----------------------------------------------------------------------------------------------------------


@query(""", k AS (SELECT path, array_to_string([CASE WHEN i < len(string_split(path, '/')) THEN '0' ELSE '1' END || string_split(path, '/')[i] FOR i IN range(1, len(string_split(path, '/')) + 1)], chr(1)) AS key FROM files), l AS (SELECT path, row_number() OVER (ORDER BY key) - 1 AS nth FROM k),
n AS (SELECT dir AS path, min(nth) AS a, max(nth) AS b FROM (SELECT unnest([array_to_string(string_split(path, '/')[1:j], '/') FOR j IN range(0, len(string_split(path, '/')))]) AS dir, nth FROM l) GROUP BY 1 UNION ALL SELECT path, nth, nth FROM l)
SELECT path, CASE WHEN path = '' THEN 0 ELSE len(string_split(path, '/')) END::BIGINT AS depth, (CASE WHEN path = '' THEN 0 ELSE len(string_split(path, '/')) END * 180)::BIGINT AS x, (20 + (a + b) * 21)::DOUBLE AS y,
  CASE WHEN path = '' THEN 120.0 ELSE greatest(140.0, length(string_split(path, '/')[-1]) * 7.5 + 32) END::DOUBLE AS width, 36.0::DOUBLE AS height FROM n""")
def tree_positions(s: SparkSession, d: str) -> DataFrame:
    return layout.tree_positions(adapter.files(_sym(s, d)))


# --- diagrams ---------------------------------------------------------------------------------------------------------


def _bracket_sql(a: str, b: str, what: str) -> str:
    return f"CASE WHEN length(replace(o, '{a}', '')) <> length(replace(o, '{b}', '')) THEN 'Unbalanced {what}' END"


_STARTS = " OR ".join(f"starts_with(head, '{k.strip()}' || chr({ord(k[-1])}))" if k[-1].isspace() else f"starts_with(head, '{k}')" for k in documents.STARTS)


@query(rf"""WITH t AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'graph TD' || chr(10) || text WHEN 1 THEN replace(text, ' a ', ' -> ') WHEN 2 THEN chr(10) || 'pie "(' || chr(10) || ' subgraph x' || chr(10) || text ELSE '' END AS text FROM documents),
r AS (SELECT doc_id, text, CASE WHEN text = '' THEN [] ELSE string_split(text, chr(10)) END AS ls, string_split(text, '"') AS ps FROM t),
b AS (SELECT *, list_transform(ls, lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')) AS bs, array_to_string(list_filter(ps, lambda x, i: i % 2 = 1), '') AS o FROM r),
h AS (SELECT *, coalesce(list_filter(bs, lambda x: x <> '')[1], '') AS head, len(list_filter(bs, lambda x: starts_with(x, 'subgraph '))) AS n1, len(list_filter(bs, lambda x: x = 'end')) AS n2 FROM b)
SELECT doc_id, CASE WHEN len(ls) = 0 THEN 'Empty diagram' ELSE array_to_string(list_filter(list_concat(
  [CASE WHEN NOT ({_STARTS}) THEN 'No diagram keyword at the start: ''' || left(head, 40) || '''' END,
   {_bracket_sql("(", ")", "parentheses")}, {_bracket_sql("[", "]", "square brackets")}, {_bracket_sql("{", "}", "curly braces")}, CASE WHEN len(ps) % 2 = 0 THEN 'Unbalanced double quotes' END],
  list_transform(ls, lambda x, i: CASE WHEN contains(x, ' -> ') AND NOT contains(x, '-->') AND NOT contains(x, '-.->') THEN 'Line ' || i || ': invalid edge ''->''' END), [CASE WHEN n1 <> n2 THEN n1 || ' subgraphs but ' || n2 || ' ends' END]), lambda x: x IS NOT NULL), '; ') END AS errors FROM h""", cte=False)
def mermaid_checks(s: SparkSession, d: str) -> DataFrame:
    """Checks of diagram texts, on texts made into diagrams, well and badly."""
    docs = table(s, d, "documents")
    kind = F.col("doc_id") % 4
    text = F.when(kind == 0, F.concat(F.lit("graph TD\n"), "text")).when(kind == 1, F.replace("text", F.lit(" a "), F.lit(" -> "))).when(kind == 2, F.concat(F.lit('\npie "(\n subgraph x\n'), "text")).otherwise("")
    return docs.select("doc_id", text.alias("text")).select("doc_id", F.array_join(documents.mermaid_errors(F.col("text")), "; ").alias("errors"))
