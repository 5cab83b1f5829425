"""Registered queries of the code-corpus operators and the DuckDB SQL that each is checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import communities, detectors, documents, graph, layout, lookups, metrics, progress, resolve, search, tree
from ..sources import adapter, pages
from ..sources.adapter import CTE, table
from ..streaming import events as ev

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, cte: bool = True):
    """Register a function under its name, with the SQL of its rows."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = f"WITH RECURSIVE {CTE}{sql}" if cte else sql
        return f

    return keep


def _sym(s, d) -> DataFrame:
    return adapter.symbols(s, d)


def _edges(s, d) -> DataFrame:
    return adapter.edges(s, d)


def _calls(s, d) -> DataFrame:
    """Edges by name, with the caller's file: what a parser would give."""
    sym = _sym(s, d)
    a = sym.select(F.col("symbol_id").alias("source_id"), "path", F.col("name").alias("caller"))
    b = sym.select(F.col("symbol_id").alias("target_id"), F.col("name").alias("callee"))
    return _edges(s, d).where("kind = 'CALLS'").join(a, "source_id").join(b, "target_id").select("edge_id", "path", "caller", "callee")


CALLS = ", calls AS (SELECT edge_id, a.path, a.name AS caller, b.name AS callee FROM (SELECT edge_id, source_id, target_id FROM edges WHERE kind = 'CALLS') e JOIN symbols a ON a.symbol_id = source_id JOIN symbols b ON b.symbol_id = target_id)"
NAMES = ", by_file AS (SELECT name, path, max(symbol_id) AS in_file FROM symbols GROUP BY ALL), by_name AS (SELECT name, min(symbol_id) AS first, count(*) AS n FROM symbols GROUP BY name)"
ENTRY = """, ins AS (SELECT target_id AS symbol_id, count(*) AS i FROM edges GROUP BY 1), outs AS (SELECT source_id AS symbol_id, count(*) AS o FROM edges GROUP BY 1),
seen AS (SELECT s.symbol_id, name, lower(name) AS n, coalesce(i, 0) AS i, coalesce(o, 0) AS o FROM symbols s LEFT JOIN ins USING (symbol_id) LEFT JOIN outs USING (symbol_id)),
scored AS (SELECT symbol_id, name, round((n = 'main')::INT * 1.0 + (n IN ('index','mod','__init__'))::INT * 0.5 + (n LIKE '%handle%' OR n LIKE '%route%' OR n LIKE '%endpoint%')::INT * 0.7
    + (n LIKE '%cli%' OR n LIKE '%cmd%' OR n LIKE '%command%')::INT * 0.6 - (i > 5)::INT * 0.5 + CASE WHEN i = 0 AND o > 0 THEN 0.5 WHEN i = 0 THEN 0.2 ELSE 0 END, 6)::DOUBLE AS score,
  concat_ws(', ', CASE WHEN n = 'main' THEN 'main function' END, CASE WHEN n IN ('index','mod','__init__') THEN 'module entry' END, CASE WHEN n LIKE '%handle%' OR n LIKE '%route%' OR n LIKE '%endpoint%' THEN 'handler/route pattern' END,
    CASE WHEN n LIKE '%cli%' OR n LIKE '%cmd%' OR n LIKE '%command%' THEN 'CLI pattern' END, CASE WHEN i > 5 THEN 'high fan-in (utility)' END, CASE WHEN i = 0 AND o > 0 THEN 'zero callers, calls others' WHEN i = 0 THEN 'zero callers' END) AS reason FROM seen),
entries AS (SELECT * FROM scored WHERE score >= 0.5 ORDER BY score DESC, symbol_id LIMIT 30)"""
DOMINANT = ", dc AS (SELECT file_id, path, community_id, count(*) AS n FROM symbols JOIN members USING (symbol_id) GROUP BY ALL), dom AS (SELECT * FROM dc QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY n DESC, community_id) = 1)"
TOKENS = r"regexp_split_to_array(lower(regexp_replace(regexp_replace(name, '([a-z])([A-Z])', '\1_\2', 'g'), '([A-Z])([A-Z][a-z])', '\1_\2', 'g')), '[_.-]')"
#: The labelling rule once more, in SQL.
LABELS = rf""", lt AS (SELECT community_id, symbol_id, kind, list_filter(regexp_split_to_array(lower(regexp_replace(regexp_replace(name, '([a-z])([A-Z])', '\\1_\\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1_\\2', 'g')), '[_.:-]'), lambda x: strlen(x) >= 3) AS ts FROM members JOIN symbols USING (symbol_id)),
lm AS (SELECT community_id, count(*) AS n FROM members GROUP BY 1),
lf AS (SELECT community_id, ts[1] AS tok, count(*) AS c FROM lt WHERE len(ts) > 0 GROUP BY ALL),
lp AS (SELECT community_id, tok AS prefix FROM (SELECT *, row_number() OVER (PARTITION BY community_id ORDER BY c DESC, tok) AS r FROM lf) JOIN lm USING (community_id) WHERE r = 1 AND n >= 2 AND c >= floor(n * 0.6)),
lc AS (SELECT community_id, term, count(*) AS c FROM (SELECT community_id, unnest(ts) AS term FROM lt) GROUP BY ALL),
lw AS (SELECT *, sum(c) OVER (PARTITION BY community_id) AS total, count(*) OVER (PARTITION BY term) AS df FROM lc),
ls AS (SELECT community_id, term, row_number() OVER (PARTITION BY community_id ORDER BY round(c / total * (ln((SELECT count(*) FROM lm) / df) + 1) * CASE WHEN term = prefix THEN 1.5 ELSE 1 END, 9) DESC, term) AS r FROM lw LEFT JOIN lp USING (community_id) WHERE term NOT IN ({", ".join(repr(w) for w in metrics.STOP_WORDS)})),
lt2 AS (SELECT community_id, max(term) FILTER (r = 1) AS t1, max(term) FILTER (r = 2) AS t2 FROM ls GROUP BY 1),
lk AS (SELECT community_id, kind FROM lt GROUP BY community_id, kind QUALIFY row_number() OVER (PARTITION BY community_id ORDER BY count(*) DESC, kind) = 1),
lb AS (SELECT community_id, CASE WHEN prefix IS NOT NULL THEN CASE WHEN t1 IS NULL OR t1 = prefix THEN prefix ELSE prefix || '_' || t1 END WHEN t1 IS NULL THEN 'group_' || community_id WHEN t2 IS NULL THEN t1 ELSE t1 || '_' || t2 END AS base,
  CASE kind WHEN 'Class' THEN 'classes' WHEN 'Interface' THEN 'interfaces' WHEN 'Struct' THEN 'types' WHEN 'Enum' THEN 'enums' WHEN 'Trait' THEN 'traits' END AS word, EXISTS (SELECT 1 FROM lc WHERE lc.community_id = lm.community_id) AS any_token
  FROM lm LEFT JOIN lp USING (community_id) LEFT JOIN lt2 USING (community_id) LEFT JOIN lk USING (community_id)),
ln_ AS (SELECT community_id, CASE WHEN NOT any_token THEN 'group_' || community_id WHEN word IS NULL OR contains(base, left(word, length(word) - 1)) THEN base ELSE base || '_' || word END AS full_ FROM lb),
labels AS (SELECT community_id, CASE WHEN r = 1 THEN full_ ELSE full_ || '_' || r END AS label FROM (SELECT *, row_number() OVER (PARTITION BY full_ ORDER BY community_id) AS r FROM ln_))"""
BOTH = ", lab AS (SELECT e.*, a.community_id AS ca, b.community_id AS cb FROM edges e JOIN members a ON a.symbol_id = source_id JOIN members b ON b.symbol_id = target_id)"


# --- the corpus -----------------------------------------------------------------------------------------------------


@query("SELECT * FROM files")
def adapter_files(s: SparkSession, d: str) -> DataFrame:
    return adapter.files(_sym(s, d)).select("file_id", "path", "language", "sloc")


@query("SELECT * FROM symbols")
def adapter_symbols(s: SparkSession, d: str) -> DataFrame:
    return _sym(s, d)


@query("SELECT * FROM edges")
def adapter_edges(s: SparkSession, d: str) -> DataFrame:
    return _edges(s, d)


@query("SELECT path, language FROM files")
def lang_detect(s: SparkSession, d: str) -> DataFrame:
    return adapter.files(_sym(s, d)).select("path", T.language_of(F.col("path")).alias("language"))


# --- resolution -----------------------------------------------------------------------------------------------------


@query(CALLS + NAMES + " SELECT edge_id, coalesce(in_file, first) AS target_id, CASE WHEN in_file IS NOT NULL THEN 1.0 WHEN n = 1 THEN 0.7 ELSE 0.4 END::DOUBLE AS confidence FROM calls LEFT JOIN by_file ON by_file.name = callee AND by_file.path = calls.path LEFT JOIN by_name ON by_name.name = callee")
def call_resolution(s: SparkSession, d: str) -> DataFrame:
    return resolve.resolve(_calls(s, d), _sym(s, d), "callee", "target_id").select("edge_id", "target_id", F.col("target_id_confidence").alias("confidence"))


@query(CALLS + NAMES + " SELECT coalesce(f1.in_file, n1.first) AS source_id, coalesce(f2.in_file, n2.first) AS target_id, 'CALLS' AS kind, CASE WHEN f2.in_file IS NOT NULL THEN 1.0 WHEN n2.n = 1 THEN 0.7 ELSE 0.4 END::DOUBLE AS confidence FROM calls c LEFT JOIN by_file f1 ON f1.name = caller AND f1.path = c.path LEFT JOIN by_name n1 ON n1.name = caller LEFT JOIN by_file f2 ON f2.name = callee AND f2.path = c.path LEFT JOIN by_name n2 ON n2.name = callee")
def call_edges(s: SparkSession, d: str) -> DataFrame:
    return resolve.call_edges(_calls(s, d), _sym(s, d))


@query(NAMES + ", h AS (SELECT a.name AS child, b.name AS parent, kind FROM (SELECT * FROM edges WHERE kind IN ('EXTENDS', 'IMPLEMENTS')) e JOIN (SELECT symbol_id, name FROM symbols) a ON a.symbol_id = source_id JOIN (SELECT symbol_id, name FROM symbols) b ON b.symbol_id = target_id) SELECT c.first AS source_id, p.first AS target_id, kind, 1.0::DOUBLE AS confidence FROM h JOIN by_name c ON c.name = child JOIN by_name p ON p.name = parent")
def heritage_edges(s: SparkSession, d: str) -> DataFrame:
    names = _sym(s, d).select("symbol_id", "name")
    e = _edges(s, d).where("kind in ('EXTENDS', 'IMPLEMENTS')").withColumnRenamed("kind", "relation")
    h = e.join(names.toDF("source_id", "child"), "source_id").join(names.toDF("target_id", "parent"), "target_id").select("child", "parent", "relation")
    return resolve.heritage_edges(h, _sym(s, d))


@query(", deps AS (SELECT DISTINCT a.file_id AS f1, b.file_id AS f2 FROM edges JOIN symbols a ON a.symbol_id = source_id JOIN symbols b ON b.symbol_id = target_id WHERE edges.kind = 'IMPORTS' AND a.file_id <> b.file_id), heads AS (SELECT file_id, min(symbol_id) AS head FROM symbols GROUP BY 1) SELECT a.head AS source_id, b.head AS target_id, 'IMPORTS' AS kind, 0.6::DOUBLE AS confidence FROM deps JOIN heads a ON a.file_id = f1 JOIN heads b ON b.file_id = f2")
def import_promotion(s: SparkSession, d: str) -> DataFrame:
    f = _sym(s, d).select("symbol_id", "file_id")
    deps = _edges(s, d).where("kind = 'IMPORTS'").join(f.toDF("source_id", "source_file"), "source_id").join(f.toDF("target_id", "target_file"), "target_id").where("source_file <> target_file").select("source_file", "target_file").distinct()
    return resolve.promote_imports(deps, _sym(s, d))


@query(", i AS (SELECT DISTINCT a.path, b.file_id AS target_file, a.file_id AS source_file FROM edges JOIN symbols a ON a.symbol_id = source_id JOIN symbols b ON b.symbol_id = target_id WHERE edges.kind = 'IMPORTS' AND a.language = 'typescript' AND b.language = 'typescript' AND a.path <> b.path) SELECT DISTINCT source_file, target_file FROM i")
def import_resolution(s: SparkSession, d: str) -> DataFrame:
    f = _sym(s, d).where("language = 'typescript'").select("symbol_id", "path", "language")
    used = _edges(s, d).where("kind = 'IMPORTS'").join(f.toDF("source_id", "path", "language"), "source_id").join(f.select(F.col("symbol_id").alias("target_id"), F.col("path").alias("to")), "target_id").where("path <> to")
    imports = used.select("path", "language", F.concat(F.lit("./"), F.regexp_replace(F.element_at(F.split("to", "/"), -1), r"\.ts$", "")).alias("module"))
    return resolve.import_edges(imports, adapter.files(_sym(s, d)).select("file_id", "path"))


# --- graph ----------------------------------------------------------------------------------------------------------


@query(", i AS (SELECT target_id AS symbol_id, count(*) AS n FROM edges WHERE kind = 'CALLS' GROUP BY 1), o AS (SELECT source_id AS symbol_id, count(*) AS n FROM edges WHERE kind = 'CALLS' GROUP BY 1) SELECT symbol_id, coalesce(i.n, 0) AS fan_in, coalesce(o.n, 0) AS fan_out FROM symbols LEFT JOIN i USING (symbol_id) LEFT JOIN o USING (symbol_id)")
def fan_in_out(s: SparkSession, d: str) -> DataFrame:
    return graph.fan_in_out(_sym(s, d), _edges(s, d))


@query(", e AS (SELECT source_id AS symbol_id FROM edges UNION ALL SELECT target_id FROM edges WHERE source_id <> target_id), n AS (SELECT symbol_id, count(*) AS n FROM e GROUP BY 1) SELECT symbol_id, coalesce(n, 0) AS degree FROM symbols LEFT JOIN n USING (symbol_id)")
def degree_all(s: SparkSession, d: str) -> DataFrame:
    return graph.degrees(_sym(s, d), _edges(s, d))


@query(", i AS (SELECT target_id AS symbol_id, count(*) AS n FROM edges GROUP BY 1) SELECT file_id, CAST(sum(coalesce(n, 0)) AS BIGINT) AS fan_in FROM symbols LEFT JOIN i USING (symbol_id) GROUP BY 1")
def file_fan_in(s: SparkSession, d: str) -> DataFrame:
    return metrics.file_fan_in(_sym(s, d), _edges(s, d))


@query(ENTRY + " SELECT * FROM entries")
def entry_points(s: SparkSession, d: str) -> DataFrame:
    return graph.entry_points(_sym(s, d), _edges(s, d))


@query(BOTH + " SELECT ca AS source_community, cb AS target_community, count(*) AS weight FROM lab WHERE ca <> cb GROUP BY ALL")
def inter_community_edges(s: SparkSession, d: str) -> DataFrame:
    return graph.community_edges(_edges(s, d), adapter.members(s, d))


@query(BOTH + " SELECT ca AS source_community, cb AS target_community, count(*) AS weight FROM lab WHERE ca <> cb GROUP BY ALL ORDER BY weight DESC, ca, cb LIMIT 20")
def cross_module_top20(s: SparkSession, d: str) -> DataFrame:
    return graph.community_edges(_edges(s, d), adapter.members(s, d)).orderBy(F.desc("weight"), "source_community", "target_community").limit(20)


@query(BOTH + ", i AS (SELECT ca AS community_id, sum(CASE WHEN source_id = target_id THEN 1 ELSE 2 END) AS ends FROM lab WHERE ca = cb GROUP BY 1), n AS (SELECT community_id, count(*) AS n_members FROM members GROUP BY 1) SELECT community_id, n_members, CASE WHEN n_members <= 1 THEN 1.0 ELSE round((coalesce(ends, 0) // 2) / (n_members * (n_members - 1) / 2), 6) END::DOUBLE AS cohesion FROM n LEFT JOIN i USING (community_id)")
def cohesion(s: SparkSession, d: str) -> DataFrame:
    return graph.cohesion(_edges(s, d), adapter.members(s, d))


@query(", p AS (SELECT DISTINCT least(source_id, target_id) AS a, greatest(source_id, target_id) AS b FROM edges), m AS (SELECT count(*) AS m FROM p), l AS (SELECT p.*, x.community_id AS ca, y.community_id AS cb FROM p JOIN members x ON x.symbol_id = a JOIN members y ON y.symbol_id = b), e AS (SELECT ca AS community_id, CASE WHEN ca = cb AND a <> b THEN 1 ELSE 0 END AS l FROM l UNION ALL SELECT cb, 0 FROM l), g AS (SELECT community_id, sum(l) AS l, count(*) AS d FROM e GROUP BY 1) SELECT community_id, round(2.0 * l / (2 * m) - (d / (2 * m)) ** 2, 6)::DOUBLE AS q FROM g, m")
def modularity(s: SparkSession, d: str) -> DataFrame:
    return graph.modularity(_edges(s, d), adapter.members(s, d))


def _roots(s, d, n=5) -> DataFrame:
    return graph.entry_points(_sym(s, d), _edges(s, d), n).select(F.col("symbol_id").alias("root"))


TOP5 = ", calls AS (SELECT source_id, target_id FROM edges WHERE kind = 'CALLS'), roots AS (SELECT symbol_id AS root FROM entries ORDER BY score DESC, symbol_id LIMIT 5)"


@query(ENTRY + ", roots AS (SELECT target_id AS root FROM edges GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 5), r(root, node, depth) AS (SELECT root, root, 0 FROM roots UNION SELECT root, source_id, depth + 1 FROM r JOIN edges ON target_id = node WHERE depth < 3), m AS (SELECT root, node, min(depth) AS depth FROM r GROUP BY ALL) SELECT root, node AS symbol_id, depth, round(1.0 / depth, 6)::DOUBLE AS risk FROM m WHERE depth > 0")
def impact(s: SparkSession, d: str) -> DataFrame:
    e = _edges(s, d)
    roots = e.groupBy(F.col("target_id").alias("root")).count().orderBy(F.desc("count"), "root").limit(5).select("root")
    return graph.impact(e, roots, 3)


@query(", roots AS (SELECT symbol_id AS root FROM symbols WHERE lower(name) LIKE 'handle%' ORDER BY 1 LIMIT 1), r(root, node, depth) AS (SELECT root, root, 0 FROM roots UNION SELECT root, source_id, depth + 1 FROM r JOIN edges ON target_id = node WHERE depth < 2), m AS (SELECT root, node, min(depth) AS depth FROM r GROUP BY ALL) SELECT root, m.node AS symbol_id, depth, name, kind, path FROM m JOIN symbols ON symbol_id = node WHERE depth > 0")
def impact_by_name(s: SparkSession, d: str) -> DataFrame:
    sym = _sym(s, d)
    root = lookups.prefix_search(sym, "handle").orderBy("symbol_id").limit(1).select(F.col("symbol_id").alias("root"))
    return graph.impact(_edges(s, d), root, 2).join(sym.select("symbol_id", "name", "kind", "path"), "symbol_id").select("root", "symbol_id", "depth", "name", "kind", "path")


@query(ENTRY + TOP5 + ", r(root, node, depth) AS (SELECT root, root, 0 FROM roots UNION SELECT root, target_id, depth + 1 FROM r JOIN calls ON source_id = node WHERE depth < 5), m AS (SELECT root, node, min(depth) AS depth FROM r GROUP BY ALL) SELECT root, node AS symbol_id, depth, name, path, start_line FROM m JOIN symbols ON symbol_id = node")
def call_chain(s: SparkSession, d: str) -> DataFrame:
    return graph.call_chain(_sym(s, d), _edges(s, d), _roots(s, d), 5)


def _flow_sql(depth: int = 20) -> str:
    """Queue order, level by level: by the parent's place, then the newest edge."""
    out = ENTRY + ", calls AS (SELECT source_id AS node, target_id AS nxt, max(edge_id) AS edge_id FROM edges WHERE kind = 'CALLS' GROUP BY ALL), k0 AS MATERIALIZED (SELECT symbol_id AS root, symbol_id AS node, 0 AS depth, 1 AS place FROM entries)"
    for k in range(1, depth + 1):
        known = " UNION ALL ".join(f"SELECT root, node FROM k{j}" for j in range(k))
        out += f", k{k} AS MATERIALIZED (SELECT root, node, {k} AS depth, row_number() OVER (PARTITION BY root ORDER BY p, e DESC, node) AS place FROM (SELECT root, nxt AS node, min((place, -edge_id)) AS w, w[1] AS p, -w[2] AS e FROM k{k - 1} JOIN calls USING (node) GROUP BY root, nxt) n ANTI JOIN ({known}) z USING (root, node))"
    every = " UNION ALL ".join(f"SELECT * FROM k{k}" for k in range(depth + 1))
    return out + f", o AS (SELECT root, node, row_number() OVER (PARTITION BY root ORDER BY depth, place) - 1 AS step_order FROM ({every})) SELECT root, h.name || '_flow' AS process, CAST(step_order AS BIGINT) AS step_order, node AS symbol_id, 'Step ' || step_order || ': ' || n.name AS description FROM o JOIN symbols h ON h.symbol_id = root JOIN symbols n ON n.symbol_id = node"


@query(_flow_sql())
def process_flow(s: SparkSession, d: str) -> DataFrame:
    sym, e = _sym(s, d), _edges(s, d)
    return graph.flows(sym, e, graph.entry_points(sym, e)).drop("depth")


#: The component of one busy symbol by its ways out and in, and mutual reach among all others: exact for any graph.
_SCC = """, e AS (SELECT DISTINCT source_id AS a, target_id AS b FROM edges WHERE source_id <> target_id),
hub0 AS (SELECT a AS x FROM e GROUP BY a ORDER BY count(*) DESC, a LIMIT 1),
fw(x) AS (SELECT x FROM hub0 UNION SELECT b FROM fw JOIN e ON a = x), bw(x) AS (SELECT x FROM hub0 UNION SELECT a FROM bw JOIN e ON b = x),
big AS (SELECT x FROM fw SEMI JOIN bw USING (x)), rest AS (SELECT * FROM e WHERE a NOT IN (FROM big) AND b NOT IN (FROM big)),
r(a, b) AS (SELECT a, b FROM rest UNION SELECT r.a, rest.b FROM r JOIN rest ON rest.a = r.b),
small AS (SELECT x.a AS symbol_id, min(x.b) AS component FROM r x JOIN r y ON y.a = x.b AND y.b = x.a GROUP BY 1)"""
_SCC_ROWS = """SELECT (SELECT min(x) FROM big) AS component, x AS symbol_id FROM big WHERE (SELECT count(*) FROM big) > 1 UNION ALL SELECT component, symbol_id FROM small"""


@query(_SCC + " " + _SCC_ROWS)
def cycles(s: SparkSession, d: str) -> DataFrame:
    return graph.cycles(_edges(s, d))


@query(", u AS (SELECT source_id AS a, target_id AS b FROM edges UNION SELECT target_id, source_id FROM edges), f(x) AS (SELECT min(a) FROM u UNION SELECT b FROM f JOIN u ON a = x), rest AS (SELECT * FROM u WHERE a NOT IN (FROM f)), r(a, b) AS (SELECT symbol_id, symbol_id FROM symbols WHERE symbol_id NOT IN (SELECT x FROM f WHERE x IS NOT NULL) UNION SELECT r.a, rest.b FROM r JOIN rest ON rest.a = r.b) SELECT x AS symbol_id, (SELECT min(x) FROM f) AS component FROM f WHERE x IS NOT NULL UNION ALL SELECT a, min(b) FROM r GROUP BY 1")
def weak_components(s: SparkSession, d: str) -> DataFrame:
    return graph.weak_components(_sym(s, d), _edges(s, d))


@query()
def communities_detect(s: SparkSession, d: str) -> DataFrame:
    return communities.communities(_sym(s, d), _edges(s, d))


@query(", x AS (SELECT symbol_id FROM symbols ORDER BY symbol_id LIMIT 500) SELECT edge_id, source_id, target_id, kind, confidence FROM edges WHERE source_id IN (SELECT symbol_id FROM x) AND target_id IN (SELECT symbol_id FROM x)")
def induced_edges(s: SparkSession, d: str) -> DataFrame:
    # the page of the graph that a viewer asks for: 500 symbols, its default
    return lookups.induced(lookups.page(_sym(s, d), "symbol_id", 500, 0, 2000), _edges(s, d)).select("edge_id", "source_id", "target_id", "kind", "confidence")


@query(", x AS (SELECT symbol_id FROM symbols WHERE file_id = 1) SELECT edge_id, source_id, target_id, kind, confidence FROM edges WHERE source_id IN (FROM x) OR target_id IN (FROM x)")
def file_edges(s: SparkSession, d: str) -> DataFrame:
    return lookups.touching(_edges(s, d), _sym(s, d).where("file_id = 1").select("symbol_id"))


@query(" SELECT target_id AS symbol_id, CASE kind WHEN 'CALLS' THEN 'callee' WHEN 'IMPORTS' THEN 'imports' WHEN 'EXTENDS' THEN 'extends' ELSE 'implements' END AS role FROM edges WHERE source_id = 7 UNION ALL SELECT source_id, CASE kind WHEN 'CALLS' THEN 'caller' WHEN 'IMPORTS' THEN 'imported_by' WHEN 'EXTENDS' THEN 'extended_by' ELSE 'implemented_by' END FROM edges WHERE target_id = 7")
def neighbours(s: SparkSession, d: str) -> DataFrame:
    return lookups.neighbours(_edges(s, d), 7)


@query(", h AS (SELECT community_id FROM members WHERE symbol_id = 7) (SELECT 'community' AS relation, symbol_id FROM members WHERE community_id IN (FROM h) AND symbol_id <> 7 ORDER BY 2 LIMIT 20) UNION ALL (SELECT DISTINCT 'calls', target_id FROM edges WHERE source_id = 7 ORDER BY 2 LIMIT 10) UNION ALL (SELECT DISTINCT 'called_by', source_id FROM edges WHERE target_id = 7 ORDER BY 2 LIMIT 10)")
def related_code(s: SparkSession, d: str) -> DataFrame:
    return lookups.related(_sym(s, d), adapter.members(s, d), _edges(s, d), 7)


@query(" SELECT symbol_id, name, path FROM symbols WHERE symbol_id IN (SELECT source_id FROM edges WHERE target_id = 7) AND (lower(name) LIKE '%parse%' OR lower(path) LIKE '%parse%' OR lower(path) LIKE '%economy%')")
def tests_for(s: SparkSession, d: str) -> DataFrame:
    return lookups.tests_for(_sym(s, d), _edges(s, d), 7, ("parse", "economy"))


@query(", o AS (SELECT symbol_id FROM members WHERE community_id = 12) SELECT edge_id, source_id, target_id, target_id IN (FROM o) AS is_internal FROM edges WHERE source_id IN (FROM o)")
def community_context(s: SparkSession, d: str) -> DataFrame:
    return lookups.community_context(_sym(s, d), adapter.members(s, d), _edges(s, d), 12)


@query(BOTH + " SELECT ca AS community_id, list_aggregate(list_sort(list(DISTINCT cb)), 'string_agg', ',') AS leads_to FROM lab WHERE ca <> cb GROUP BY 1")
def community_graph(s: SparkSession, d: str) -> DataFrame:
    e = graph.community_edges(_edges(s, d), adapter.members(s, d))
    return e.groupBy(F.col("source_community").alias("community_id")).agg(F.array_join(F.array_sort(F.collect_set("target_community")), ",").alias("leads_to"))


# --- metrics --------------------------------------------------------------------------------------------------------


@query(", i AS (SELECT file_id, CAST(sum(coalesce(n, 0)) AS BIGINT) AS fan_in FROM symbols LEFT JOIN (SELECT target_id AS symbol_id, count(*) AS n FROM edges GROUP BY 1) USING (symbol_id) GROUP BY 1), c AS (SELECT file_id, avg(1 + (end_line - start_line + 1) / 10.0) AS complexity, count(*) AS churn FROM symbols GROUP BY 1), f AS (SELECT * FROM files JOIN c USING (file_id) JOIN i USING (file_id)), e AS (SELECT min(complexity) AS a1, max(complexity) AS b1, min(churn) AS a2, max(churn) AS b2, min(sloc) AS a3, max(sloc) AS b3, min(fan_in) AS a4, max(fan_in) AS b4 FROM f) SELECT file_id, round(complexity, 6) AS complexity, round(CASE WHEN b1 > a1 THEN (complexity - a1) / (b1 - a1) ELSE 0 END * 0.4 + CASE WHEN b2 > a2 THEN (churn - a2) / (b2 - a2) ELSE 0 END * 0.3 + CASE WHEN b3 > a3 THEN (sloc - a3) / (b3 - a3) ELSE 0 END * 0.2 + CASE WHEN b4 > a4 THEN (fan_in - a4) / (b4 - a4) ELSE 0 END * 0.1, 6) AS heat FROM f, e")
def heatmap(s: SparkSession, d: str) -> DataFrame:
    return metrics.heatmap(_file_metrics(s, d)).select("file_id", F.round("complexity", 6).alias("complexity"), "heat")


def _file_metrics(s, d) -> DataFrame:
    """Complexity by the fallback from lines of code; the number of symbols stands for churn."""
    sym = _sym(s, d)
    own = sym.groupBy("file_id").agg(F.avg(T.from_loc(F.col("end_line") - F.col("start_line") + 1)).alias("complexity"), F.count(F.lit(1)).alias("churn"))
    return adapter.files(sym).join(own, "file_id").join(metrics.file_fan_in(sym, _edges(s, d)), "file_id")


@query(", c AS (SELECT file_id, round(avg(1 + (end_line - start_line + 1) / 10.0), 6) AS complexity FROM symbols GROUP BY 1) SELECT file_id, path, complexity FROM files JOIN c USING (file_id) ORDER BY complexity DESC, file_id LIMIT 10")
def hotspots(s: SparkSession, d: str) -> DataFrame:
    return _file_metrics(s, d).select("file_id", "path", F.round("complexity", 6).alias("complexity")).orderBy(F.desc("complexity"), "file_id").limit(10)


@query(" SELECT language, count(*) AS files, CAST(sum(sloc) AS BIGINT) AS sloc, round(100.0 * count(*) / sum(count(*)) OVER (), 6)::DOUBLE AS percent FROM files GROUP BY 1")
def language_breakdown(s: SparkSession, d: str) -> DataFrame:
    return metrics.language_breakdown(adapter.files(_sym(s, d)))


@query(" SELECT (SELECT count(*) FROM files) AS files, (SELECT CAST(sum(sloc) AS BIGINT) FROM files) AS sloc, (SELECT count(*) FROM symbols) AS symbols, (SELECT count(DISTINCT name) FROM symbols) AS names")
def repo_metrics(s: SparkSession, d: str) -> DataFrame:
    sym = _sym(s, d)
    return metrics.repo_totals(adapter.files(sym), sym)


@query(", n AS (SELECT commit_id FROM commits GROUP BY commit_id, ts ORDER BY ts DESC, commit_id DESC LIMIT 1000) SELECT path, count(*) AS churn, count(DISTINCT author) AS contributors FROM commits WHERE commit_id IN (FROM n) GROUP BY 1")
def churn_contributors(s: SparkSession, d: str) -> DataFrame:
    return metrics.churn(adapter.commits(s, d))


@query(rf", t AS (SELECT community_id, unnest(list_filter({TOKENS}, lambda x: strlen(x) >= 2)) AS term FROM members JOIN symbols USING (symbol_id)), c AS (SELECT community_id, term, count(*) AS n FROM t GROUP BY ALL), s AS (SELECT community_id, term, round(n / sum(n) OVER (PARTITION BY community_id) * (ln((SELECT count(DISTINCT community_id) FROM members) / count(*) OVER (PARTITION BY term)) + 1), 6)::DOUBLE AS score FROM c) SELECT community_id, row_number() OVER (PARTITION BY community_id ORDER BY score DESC, term) AS rank, term, score FROM s QUALIFY rank <= 10")
def community_tfidf(s: SparkSession, d: str) -> DataFrame:
    return metrics.tfidf(_sym(s, d), adapter.members(s, d))


@query(LABELS + " SELECT community_id, label FROM labels")
def community_labels(s: SparkSession, d: str) -> DataFrame:
    return metrics.labels(_sym(s, d), adapter.members(s, d))


@query(rf" SELECT symbol_id, array_to_string(list_filter({TOKENS}, lambda x: strlen(x) >= 2), ' ') AS tokens FROM symbols")
def identifier_tokens(s: SparkSession, d: str) -> DataFrame:
    return _sym(s, d).select("symbol_id", F.array_join(T.name_tokens(F.col("name")), " ").alias("tokens"))


@query(DOMINANT + " SELECT file_id, community_id, n FROM dom")
def dominant_community(s: SparkSession, d: str) -> DataFrame:
    return metrics.dominant_community(_sym(s, d), adapter.members(s, d))


@query(", i AS (SELECT file_id, sum(coalesce(n, 0)) AS fan_in FROM symbols LEFT JOIN (SELECT target_id AS symbol_id, count(*) AS n FROM edges GROUP BY 1) USING (symbol_id) GROUP BY 1), s AS (SELECT path, round(fan_in * CASE WHEN sloc > 500 THEN 0.7 ELSE 1 END, 6)::DOUBLE AS score FROM files JOIN i USING (file_id)) SELECT row_number() OVER (ORDER BY score DESC, path) AS rank, path, score FROM s WHERE score > 0 ORDER BY rank LIMIT 10")
def reading_order(s: SparkSession, d: str) -> DataFrame:
    sym = _sym(s, d)
    return metrics.reading_order(adapter.files(sym), sym, _edges(s, d))


@query("SELECT doc_id, CAST(len(list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13)) <> '' AND trim(x, ' ' || chr(9) || chr(13))[1] <> '#')) AS BIGINT) AS sloc FROM documents", cte=False)
def sloc_fold(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", T.sloc(F.col("text"), F.lit("python")).alias("sloc"))


@query(r"SELECT doc_id, 1.0 + list_sum(list_transform(string_split(text, chr(10)), lambda x: contains(x, 'if')::INT + contains(x, '&&')::INT + contains(x, '||')::INT + contains(x, '?')::INT + len(list_filter(regexp_split_to_array(x, '[^\p{L}\p{N}_]+'), lambda w: w IN ('else','elif','match','case','for','while','try','catch','except')))))::DOUBLE AS complexity FROM documents", cte=False)
def complexity_lines(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", T.complexity(F.col("text")).alias("complexity"))


# --- detectors ------------------------------------------------------------------------------------------------------


#: Bounds that parts can reach: none is over 50 lines long, and few methods lie near a class.
GOD, LONG = (2, 12), (25, 35, 45)
_GODS = " SELECT 'god_class' AS kind, CASE WHEN count(*) > 12 THEN 'error' ELSE 'warning' END AS severity, o.file_id, o.symbol_id, o.a AS line, '''' || o.name || ''' has ' || count(*) || ' methods' AS message, '" + detectors.GOD_HINT + "' AS suggestion FROM (SELECT file_id, symbol_id, name, start_line - 200 AS a, end_line + 200 AS b FROM symbols WHERE kind IN ('Class', 'Struct')) o JOIN symbols m ON m.file_id = o.file_id AND m.kind = 'Method' AND m.start_line >= a AND m.end_line <= b GROUP BY o.file_id, o.symbol_id, o.name, o.a HAVING count(*) > 2"
_LONG = " SELECT 'long_method' AS kind, CASE WHEN z > 45 THEN 'error' WHEN z > 35 THEN 'warning' ELSE 'info' END AS severity, file_id, symbol_id, start_line AS line, '''' || name || ''' is ' || z || ' lines long' AS message, '" + detectors.LONG_HINT + "' AS suggestion FROM (SELECT *, end_line - start_line AS z FROM symbols WHERE kind IN ('Function', 'Method')) WHERE z > 25"


def _wide(symbols: DataFrame) -> DataFrame:
    wide = F.col("kind").isin("Class", "Struct")  # parts do not nest, so classes are taken to span 200 lines more each way
    return symbols.withColumns({"start_line": F.col("start_line") - F.when(wide, 200).otherwise(0), "end_line": F.col("end_line") + F.when(wide, 200).otherwise(0)})


@query(_GODS)
def god_class(s: SparkSession, d: str) -> DataFrame:
    return detectors.god_class(_wide(_sym(s, d)), *GOD)


@query(_LONG)
def long_method(s: SparkSession, d: str) -> DataFrame:
    return detectors.long_method(_sym(s, d), *LONG)


_STEM = r"regexp_extract(path, '([^/]*?)\.[^./]+$', 1)"
_GAPS = rf""", w AS (SELECT file_id, path, count(*) AS n, {_STEM} AS stem, regexp_extract(path, '\.([^./]+)$', 1) AS ext, regexp_replace(path, '[^/]*$', '') AS home FROM symbols GROUP BY ALL),
want AS (SELECT file_id, unnest(CASE WHEN ext = 'py' THEN [home || 'test_' || stem || '.py', home || stem || '_test.py', home || 'tests/' || stem || '.py', home || 'tests/test_' || stem || '.py', 'tests/test_' || stem || '.py', 'tests/' || stem || '.py']
  WHEN ext IN ('ts', 'tsx', 'js', 'jsx') THEN [home || stem || '.test.' || ext, home || stem || '.spec.' || ext] WHEN ext = 'go' THEN [home || stem || '_test.go']
  WHEN ext = 'rs' THEN ['tests/' || stem || '.rs', CASE WHEN contains(path, 'src/') THEN replace(path, 'src/', 'tests/') END] ELSE [] END) AS path FROM w),
gaps AS (SELECT 'test_gap' AS kind, 'info' AS severity, file_id, CAST(NULL AS BIGINT) AS symbol_id, CAST(NULL AS BIGINT) AS line, path || ' has no test file' AS message, '{detectors.TEST_HINT[0]}' || n || '{detectors.TEST_HINT[1]}' AS suggestion FROM w
  WHERE n > 5 AND NOT regexp_matches(lower(path), 'test_|_test\.|\.test\.|\.spec\.|/tests/|/test/') AND file_id NOT IN (SELECT want.file_id FROM want JOIN w x ON x.path = want.path))"""


@query(_GAPS + " SELECT * FROM gaps")
def test_gap(s: SparkSession, d: str) -> DataFrame:
    return detectors.test_gap(_sym(s, d))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_HITS = ", l AS (SELECT file_id, unnest(string_split(content, chr(10))) AS row, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS line FROM sources), hits AS (" + " UNION ALL ".join(
    f"SELECT 'security_hotspot' AS kind, '{sev}' AS severity, file_id, CAST(NULL AS BIGINT) AS symbol_id, CAST(line AS BIGINT) AS line, {_quoted(text)} AS message, {_quoted(hint)} AS suggestion FROM l WHERE regexp_matches(row, {_quoted(pattern)})" for pattern, sev, text, hint in detectors.HOTSPOTS
) + ")"


@query(_HITS + " SELECT * FROM hits")
def security_scan(s: SparkSession, d: str) -> DataFrame:
    return detectors.security(adapter.sources(_sym(s, d)))


_FOUND = f""", rings AS (SELECT 'circular_dependency' AS kind, 'warning' AS severity, arg_min(file_id, symbol_id) AS file_id, component AS symbol_id, CAST(NULL AS BIGINT) AS line,
  'Circular: ' || string_agg(name, ' → ' ORDER BY symbol_id) || ' → ' || arg_min(name, symbol_id) AS message, '{detectors.CYCLE_HINT}' AS suggestion FROM scc JOIN symbols USING (symbol_id) GROUP BY component),
spans AS ({_LONG}),
gods AS ({_GODS})
SELECT * FROM gods UNION ALL SELECT * FROM spans UNION ALL SELECT * FROM rings UNION ALL SELECT * FROM hits UNION ALL SELECT * FROM gaps"""


@query(_SCC + ", scc AS (" + _SCC_ROWS + ")" + _GAPS + _HITS + _FOUND)
def findings_all(s: SparkSession, d: str) -> DataFrame:
    sym = _sym(s, d)
    return detectors.findings(sym, _edges(s, d), adapter.sources(sym), _wide(sym), GOD, LONG)


# --- search ---------------------------------------------------------------------------------------------------------


def _bm25_sql(source: str, words: list[str], limit: int) -> str:
    """BM25 of ``source(id, ws)`` (token lists) for words and phrases of two."""
    n = range(len(words))
    # a word of two tokens is a phrase
    times = lambda w: f"len(list_filter(range(1, len(ws)), lambda k: ws[k] = '{w.split()[0]}' AND ws[k + 1] = '{w.split()[1]}'))" if " " in w else f"len(list_filter(ws, lambda x: x = '{w}'))"
    counts = ", ".join(f"{times(w)} AS t{k}" for k, w in enumerate(words))
    idf = lambda k: f"(CASE WHEN ln((z - n{k} + 0.5) / (n{k} + 0.5)) <= 0 THEN 1e-6 ELSE ln((z - n{k} + 0.5) / (n{k} + 0.5)) END)"
    score = " + ".join(f"{idf(k)} * t{k} * 2.2 / (t{k} + 1.2 * (0.25 + 0.75 * len / avg))" for k in n)
    return f"(SELECT id, round({score}, 6)::DOUBLE AS score, {score} AS raw FROM (SELECT id, len(ws) AS len, {counts} FROM ({source})) d, (SELECT count(*) AS z, avg(len) AS avg, {', '.join(f'count(*) FILTER (t{k} > 0) AS n{k}' for k in n)} FROM (SELECT len(ws) AS len, {counts} FROM ({source}))) g WHERE {' AND '.join(f't{k} > 0' for k in n)} ORDER BY raw DESC, id LIMIT {limit})"


_WS = r"list_filter(regexp_split_to_array(lower({}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
_DOCS = f"SELECT doc_id AS id, list_concat({_WS.format('lang')}, {_WS.format('text')}) AS ws FROM documents"
_SYMS = f"SELECT symbol_id AS id, list_concat({_WS.format('name')}, {_WS.format('kind')}) AS ws FROM symbols"


@query("SELECT id, score FROM " + _bm25_sql(_DOCS, ["license", "the"], 50), cte=False)
def bm25_narratives(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("kind"), F.col("text").alias("content"))
    return search.bm25(docs, ["kind", "content"], "License the", 50).select("id", F.round("score", 6).alias("score"))


@query(" SELECT id, score FROM " + _bm25_sql(_SYMS, ["handle", "class"], 50))
def bm25_symbols(s: SparkSession, d: str) -> DataFrame:
    docs = _sym(s, d).withColumnRenamed("symbol_id", "id")
    return search.bm25(docs, ["name", "kind"], "handle Class", 50).select("id", F.round("score", 6).alias("score"))


@query(", a AS (SELECT *, row_number() OVER (ORDER BY raw DESC, id) - 1 AS p FROM " + _bm25_sql(_SYMS, ["parse"], 20) + "), b AS (SELECT *, row_number() OVER (ORDER BY raw DESC, id) - 1 AS p FROM " + _bm25_sql(_DOCS, ["parse"], 20) + ") SELECT kind, id, round(1.0 / (60 + p), 9)::DOUBLE AS score FROM (SELECT 0 AS l, 'symbol' AS kind, id, p FROM a UNION ALL SELECT 1, 'narrative', id, p FROM b) ORDER BY 1.0 / (60 + p) DESC, l, p LIMIT 20")
def unified_rrf(s: SparkSession, d: str) -> DataFrame:
    a = search.bm25(_sym(s, d).withColumnRenamed("symbol_id", "id"), ["name", "kind"], "parse", 20)
    docs = table(s, d, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("kind"), F.col("text").alias("content"))
    return search.fuse([("symbol", a), ("narrative", search.bm25(docs, ["kind", "content"], "parse", 20))])


@query("SELECT doc_id AS id, CASE WHEN p > 0 THEN CASE WHEN p > 21 THEN '...' ELSE '' END || substring(text, greatest(p - 20, 1), least(p + 6 + 20, length(text)) - greatest(p - 21, 0)) || CASE WHEN p + 26 < length(text) THEN '...' ELSE '' END ELSE left(text, 40) || CASE WHEN length(text) > 40 THEN '...' ELSE '' END END AS snippet FROM (SELECT doc_id, text, position('license' IN lower(text)) AS p FROM documents)", cte=False)
def snippet(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select(F.col("doc_id").alias("id"), T.snippet(F.col("text"), F.lit("license")).alias("snippet"))


# --- lookups --------------------------------------------------------------------------------------------------------


@query(" SELECT symbol_id, name, kind FROM symbols WHERE lower(name) LIKE 'parse_b%'")
def prefix_search(s: SparkSession, d: str) -> DataFrame:
    return lookups.prefix_search(_sym(s, d), "Parse_b").select("symbol_id", "name", "kind")


@query(" SELECT * FROM symbols ORDER BY symbol_id LIMIT 50 OFFSET 50")
def paginate_symbols(s: SparkSession, d: str) -> DataFrame:
    return lookups.page(_sym(s, d), "symbol_id", 50, 50)


@query(" SELECT * FROM files WHERE language = 'rust'")
def files_by_language(s: SparkSession, d: str) -> DataFrame:
    return adapter.files(_sym(s, d)).where("language = 'rust'")


@query(" SELECT symbol_id, name, coalesce(community_id, -1) AS community_id FROM symbols LEFT JOIN members USING (symbol_id) ORDER BY symbol_id LIMIT 500")
def graph_page(s: SparkSession, d: str) -> DataFrame:
    return lookups.page(_sym(s, d).select("symbol_id", "name").join(adapter.members(s, d), "symbol_id", "left").fillna(-1, ["community_id"]), "symbol_id", 500, 0, 2000)


@query(", i AS (SELECT target_id AS symbol_id, count(*) AS n FROM edges GROUP BY 1) SELECT community_id, symbol_id, coalesce(n, 0) AS fan_in, row_number() OVER (PARTITION BY community_id ORDER BY coalesce(n, 0) DESC, symbol_id) AS rank FROM members LEFT JOIN i USING (symbol_id) QUALIFY rank <= 5")
def key_symbols(s: SparkSession, d: str) -> DataFrame:
    fan = graph.fan_in_out(_sym(s, d), _edges(s, d), None).select("symbol_id", "fan_in")
    return lookups.top_per_group(adapter.members(s, d).join(fan, "symbol_id"), "community_id", [F.desc("fan_in"), "symbol_id"], 5).select("community_id", "symbol_id", "fan_in", "rank")


@query(" SELECT kind, count(*) AS n FROM edges GROUP BY 1")
def edges_by_kind(s: SparkSession, d: str) -> DataFrame:
    return _edges(s, d).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query(", o AS (SELECT path, max(ts) AS before FROM commits WHERE commit_id % 2 = 0 GROUP BY 1), n AS (SELECT path, max(ts) AS mtime FROM commits GROUP BY 1) SELECT path, CASE WHEN before IS NULL THEN 'new' WHEN mtime > before THEN 'changed' ELSE 'unchanged' END AS state FROM n LEFT JOIN o USING (path)")
def incremental_diff(s: SparkSession, d: str) -> DataFrame:
    c = adapter.commits(s, d)
    # two states of one history: what the even commits had seen, and all
    old = c.where("commit_id % 2 = 0").groupBy("path").agg(F.max("ts").alias("mtime"))
    return lookups.changed(old, c.groupBy("path").agg(F.max("ts").alias("mtime")))


# --- trees ----------------------------------------------------------------------------------------------------------


@query(DOMINANT + ", a AS (SELECT community_id, unnest([array_to_string(string_split(path, '/')[1:k], '/') FOR k IN range(1, len(string_split(path, '/')))]) AS dir FROM dom), c AS (SELECT dir, community_id, count(*) AS n FROM a GROUP BY ALL) SELECT dir, CAST(sum(n) OVER (PARTITION BY dir) AS BIGINT) AS n_files, community_id FROM c QUALIFY row_number() OVER (PARTITION BY dir ORDER BY n DESC, community_id) = 1")
def dir_rollup(s: SparkSession, d: str) -> DataFrame:
    sym = _sym(s, d)
    dom = metrics.dominant_community(sym, adapter.members(s, d)).join(adapter.files(sym).select("file_id", "path"), "file_id")
    return tree.directory_rollup(dom)


@query(", dirs AS (SELECT DISTINCT unnest([array_to_string(string_split(path, '/')[1:k], '/') FOR k IN range(1, len(string_split(path, '/')))]) AS path FROM files), a AS (SELECT 'directory' AS node_type, path FROM dirs UNION ALL SELECT 'file', path FROM files), b AS (SELECT *, array_to_string(string_split(path, '/')[1:-2], '/') AS parent, CAST(len(string_split(path, '/')) AS BIGINT) AS depth, string_split(path, '/')[-1] AS label FROM a) SELECT b.*, (SELECT count(*) FROM b c WHERE c.parent = b.path) AS n_children FROM b WHERE depth <= 3")
def schematic_tree(s: SparkSession, d: str) -> DataFrame:
    return tree.schematic(adapter.files(_sym(s, d)), None, 3)


@query(" SELECT DISTINCT 'file' AS node_type, path, string_split(path, '/')[-1] AS label FROM files WHERE path LIKE 'src/promo/%'")
def schematic_expand(s: SparkSession, d: str) -> DataFrame:
    return tree.expand(adapter.files(_sym(s, d)), "src/promo")


@query(", c AS (SELECT source_id AS symbol_id, count(DISTINCT target_id) AS callees FROM edges GROUP BY 1), r AS (SELECT target_id AS symbol_id, count(DISTINCT source_id) AS callers FROM edges GROUP BY 1) SELECT symbol_id, name, path, community_id, coalesce(callers, 0) AS callers, coalesce(callees, 0) AS callees FROM symbols LEFT JOIN members USING (symbol_id) LEFT JOIN c USING (symbol_id) LEFT JOIN r USING (symbol_id)")
def schematic_detail(s: SparkSession, d: str) -> DataFrame:
    e = _edges(s, d)
    c = e.groupBy(F.col("source_id").alias("symbol_id")).agg(F.count_distinct("target_id").alias("callees"))
    r = e.groupBy(F.col("target_id").alias("symbol_id")).agg(F.count_distinct("source_id").alias("callers"))
    out = _sym(s, d).join(adapter.members(s, d), "symbol_id", "left").join(c, "symbol_id", "left").join(r, "symbol_id", "left")
    return out.select("symbol_id", "name", "path", "community_id", F.coalesce("callers", F.lit(0)).cast("long").alias("callers"), F.coalesce("callees", F.lit(0)).cast("long").alias("callees"))


@query(", dirs AS (SELECT DISTINCT unnest([array_to_string(string_split(path, '/')[1:k], '/') FOR k IN range(1, len(string_split(path, '/')))]) AS path FROM files), a AS (SELECT true AS is_dir, path FROM dirs UNION ALL SELECT false, path FROM files), k AS (SELECT is_dir, path, array_to_string([CASE WHEN i < len(string_split(path, '/')) OR is_dir THEN '0' ELSE '1' END || string_split(path, '/')[i] FOR i IN range(1, len(string_split(path, '/')) + 1)], chr(1)) AS key FROM a) SELECT row_number() OVER (ORDER BY key) AS place, repeat('  ', len(string_split(path, '/')) - 1) || string_split(path, '/')[-1] || CASE WHEN is_dir THEN '/' ELSE '' END AS line FROM k")
def file_tree(s: SparkSession, d: str) -> DataFrame:
    return tree.file_tree(adapter.files(_sym(s, d)))


@query(", z AS (SELECT min(path) AS a, max(path) AS b FROM files) SELECT regexp_replace(left(a, coalesce(list_max(list_filter(range(1, length(a) + 1), lambda k: left(a, k) = left(b, k))), 0)), '[^/]*$', '') AS prefix FROM z")
def common_prefix(s: SparkSession, d: str) -> DataFrame:
    return tree.common_prefix(adapter.files(_sym(s, d)))


# --- learning -------------------------------------------------------------------------------------------------------

CH = ", ch AS (SELECT chapter_id, count(*) AS total, count(*) FILTER (completed) AS done FROM sections GROUP BY 1)"


@query(CH + " SELECT chapter_id, total, done, round(done / total, 6) AS ratio, CAST(floor(100.0 * done / total + 0.5) AS BIGINT) AS percent, CASE WHEN done = total THEN 'completed' WHEN done > 0 THEN 'in-progress' ELSE 'unvisited' END AS status FROM ch")
def chapter_progress(s: SparkSession, d: str) -> DataFrame:
    return progress.chapter_progress(adapter.sections(s, d))


@query(CH + " SELECT chapter_id FROM ch WHERE done = total")
def completed_chapters(s: SparkSession, d: str) -> DataFrame:
    return progress.chapter_progress(adapter.sections(s, d)).where("status = 'completed'").select("chapter_id")


ALL = CH + ", o AS (SELECT CAST(sum(total) AS BIGINT) AS sections, CAST(sum(done) AS BIGINT) AS done, count(*) AS chapters, count(*) FILTER (done = total) AS chapters_completed, (SELECT count(DISTINCT chapter_id) FROM sections WHERE content_type = 'quiz' AND completed) AS quizzes_passed FROM ch)"


@query(ALL + " SELECT *, round(done / sections, 6) AS ratio FROM o")
def overall_progress(s: SparkSession, d: str) -> DataFrame:
    return progress.overall(adapter.sections(s, d))


@query(ALL + " SELECT done * 10 + chapters_completed * 50 + quizzes_passed * 25 AS xp, (done * 10 + chapters_completed * 50 + quizzes_passed * 25) // 100 + 1 AS level, concat_ws(',', CASE WHEN done > 0 THEN 'first_steps' END, CASE WHEN chapters_completed > 0 THEN 'chapter_champion' END, CASE WHEN quizzes_passed >= 5 THEN 'quiz_master' END, CASE WHEN chapters = chapters_completed THEN 'completionist' END) AS badges FROM o")
def learner_stats(s: SparkSession, d: str) -> DataFrame:
    return progress.learner(adapter.sections(s, d))


@query(" SELECT chapter_id, section_id, content_type FROM sections WHERE chapter_id = (SELECT min(chapter_id) FROM sections WHERE NOT completed) AND NOT completed")
def skip_chapter(s: SparkSession, d: str) -> DataFrame:
    sec = adapter.sections(s, d)
    chapter = sec.where("not completed").agg(F.min("chapter_id")).first()[0]
    return progress.skipped(sec, chapter)


@query("SELECT p_partkey AS question_id, p_size % 4 = p_partkey % 3 AS correct, CASE WHEN p_size % 4 = p_partkey % 3 THEN 25 ELSE 0 END::BIGINT AS xp FROM part", cte=False)
def quiz_grade(s: SparkSession, d: str) -> DataFrame:
    q = table(s, d, "part").select(F.col("p_partkey").alias("question_id"), F.to_json(F.array(*[F.lit(f"o{k}") for k in range(4)])).alias("options"), (F.col("p_partkey") % 3).cast("int").alias("correct_index"), F.concat(F.lit("o"), F.col("p_size") % 4).alias("answer"))
    return progress.grade(q)


# --- texts, pages, streams ------------------------------------------------------------------------------------------


@query("SELECT page_id, regexp_extract(html, '<h1[^>]*>([^<]*)', 1) AS title, CAST(len(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS BIGINT) AS n_links, coalesce(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)[1], '') AS first_href FROM pages", cte=False)
def html_extract(s: SparkSession, d: str) -> DataFrame:
    return pages.page_facts(table(s, d, "pages"))


@query("SELECT conv_id AS stream_id, string_agg(text, '' ORDER BY turn) AS text, CAST(strlen(string_agg(text, '' ORDER BY turn)) // 4 AS BIGINT) AS tokens, regexp_matches(string_agg(text, '' ORDER BY turn), '" + "|".join(ev.GARBAGE) + "') AS garbage FROM conversations GROUP BY 1", cte=False)
def llm_fold(s: SparkSession, d: str) -> DataFrame:
    line = F.to_json(F.struct(F.lit("content_block_delta").alias("type"), F.struct(F.lit("text_delta").alias("type"), F.col("text")).alias("delta")))
    return ev.fold(table(s, d, "conversations").select(F.col("conv_id").alias("stream_id"), F.col("turn").alias("seq"), line.alias("line")))


@query("SELECT batch_id, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM (SELECT CAST((row_number() OVER (ORDER BY ts, event_id) - 1) // 50 AS BIGINT) AS batch_id, event_id FROM events) GROUP BY 1", cte=False)
def event_batches(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events")
    return ev.batches(e)


@query("SELECT CAST(time_bucket(INTERVAL 1 HOUR, ts) AS TIMESTAMP) AS start, event_type, count(*) AS n FROM events GROUP BY ALL", cte=False)
def event_windows(s: SparkSession, d: str) -> DataFrame:
    return ev.windowed(table(s, d, "events")).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query(" SELECT symbol_id, CASE WHEN regexp_matches(regexp_replace(name, '[^A-Za-z0-9_]', '_', 'g'), '^[A-Za-z]') THEN regexp_replace(name, '[^A-Za-z0-9_]', '_', 'g') ELSE 'n' || regexp_replace(name, '[^A-Za-z0-9_]', '_', 'g') END AS node, sha256('acme/' || name || '@' || symbol_id) AS fingerprint FROM symbols")
def names_and_prints(s: SparkSession, d: str) -> DataFrame:
    return _sym(s, d).select("symbol_id", T.mermaid_id(F.col("name")).alias("node"), pages.fingerprint(F.lit("acme"), F.col("name"), F.col("symbol_id").cast("string")).alias("fingerprint"))


@query(" SELECT DISTINCT name, array_to_string([upper(w[1]) || w[2:] FOR w IN string_split(replace(replace(name, 'cluster_', ''), '_', ' '), ' ')], ' ') AS label FROM symbols")
def label_format(s: SparkSession, d: str) -> DataFrame:
    return _sym(s, d).select("name", T.format_label(F.col("name")).alias("label")).distinct()


# --- documents ------------------------------------------------------------------------------------------------------


def _parts(s, d):
    sym, mem = _sym(s, d), adapter.members(s, d)
    return sym, _edges(s, d), mem, metrics.labels(sym, mem)


def _title(x: str) -> str:
    return f"array_to_string([upper(w[1]) || w[2:] FOR w IN string_split(replace(replace({x}, 'cluster_', ''), '_', ' '), ' ')], ' ')"


def _node(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '[^A-Za-z0-9_]', '_', 'g'), '^([^A-Za-z])', 'n\\1')"


def _whole(x: str) -> str:
    return f"CAST(floor(round({x} * 100, 6) + 0.5) AS BIGINT)"


_COHESION = ", ci AS (SELECT ca AS community_id, sum(CASE WHEN source_id = target_id THEN 1 ELSE 2 END) AS ends FROM lab WHERE ca = cb GROUP BY 1), coh AS (SELECT community_id, n_members, CASE WHEN n_members <= 1 THEN 1.0 ELSE round((coalesce(ends, 0) // 2) / (n_members * (n_members - 1) / 2), 6) END::DOUBLE AS cohesion FROM (SELECT community_id, count(*) AS n_members FROM members GROUP BY 1) LEFT JOIN ci USING (community_id))"
_OWN = LABELS + BOTH + _COHESION + f", own AS (SELECT coh.*, label, {_title('label')} AS title FROM coh JOIN labels USING (community_id)), leave AS (SELECT ca AS community_id, count(*) AS outgoing FROM lab WHERE ca <> cb GROUP BY 1)"


def _all_parts(s, d):
    sym, e, mem, lab = _parts(s, d)
    return sym, e, mem, lab, graph.cohesion(e, mem), graph.entry_points(sym, e)


_MERMAID = f""", fan AS (SELECT target_id AS symbol_id, count(*) AS n FROM edges GROUP BY 1),
top50 AS (SELECT s.symbol_id, name, {_node("name || '_' || s.symbol_id")} AS node FROM symbols s LEFT JOIN fan USING (symbol_id) ORDER BY coalesce(n, 0) DESC, s.symbol_id LIMIT 50),
pick AS (SELECT top50.*, community_id, coalesce(label, 'other') AS label FROM top50 LEFT JOIN members USING (symbol_id) LEFT JOIN labels USING (community_id)),
box AS (SELECT label, '  subgraph ' || {_node('label')} || '["' || {_title('label')} || '"]\n' || string_agg('    ' || node || '["' || name || '"]', '\n' ORDER BY symbol_id) || '\n  end' AS t FROM pick GROUP BY label),
way AS (SELECT '  ' || a.node || CASE WHEN a.community_id = b.community_id THEN ' --> ' ELSE ' -.-> ' END || b.node AS t FROM (SELECT DISTINCT source_id, target_id FROM edges) JOIN pick a ON a.symbol_id = source_id JOIN pick b ON b.symbol_id = target_id)
SELECT concat_ws('\n', 'graph TD', (SELECT string_agg(t, '\n' ORDER BY label) FROM box), (SELECT string_agg(t, '\n' ORDER BY t) FROM way)) AS mermaid"""


@query(LABELS + _MERMAID)
def mermaid_architecture(s: SparkSession, d: str) -> DataFrame:
    return documents.architecture(*_parts(s, d))


_SUMMARY = f""", held AS (SELECT community_id, symbol_id, '- `' || name || '`' AS t, lower(kind) AS k FROM members JOIN symbols USING (symbol_id)),
types AS (SELECT community_id, string_agg(t, '\n' ORDER BY symbol_id) AS types FROM held WHERE k IN ('struct', 'class', 'enum', 'trait', 'interface') GROUP BY 1),
funcs AS (SELECT community_id, string_agg(t, '\n' ORDER BY symbol_id) FILTER (r <= 10) AS funcs, count(*) AS nf FROM (SELECT *, row_number() OVER (PARTITION BY community_id ORDER BY symbol_id) AS r FROM held WHERE k IN ('function', 'method', 'fn')) GROUP BY 1),
told AS (SELECT community_id, '## Module: ' || title || '\n\nThis module contains **' || n_members || ' symbols** with a cohesion score of **' || {_whole('cohesion')} || '%** and **' || coalesce(outgoing, 0) || ' external connections**.'
  || coalesce('\n\n### Types\n\n' || types, '') || coalesce('\n\n### Functions\n\n' || funcs, '') || CASE WHEN nf > 10 THEN '\n- ...and ' || (nf - 10) || ' more' ELSE '' END AS content FROM own LEFT JOIN leave USING (community_id) LEFT JOIN types USING (community_id) LEFT JOIN funcs USING (community_id))"""
_NARRATIVES = ENTRY + _OWN + _SUMMARY + f""", cnt AS (SELECT (SELECT count(*) FROM files) AS f, (SELECT CAST(sum(sloc) AS BIGINT) FROM files) AS l, (SELECT string_agg(DISTINCT language, ', ' ORDER BY language) FROM files) AS langs, (SELECT count(*) FROM symbols) AS s, (SELECT count(*) FROM edges) AS e, (SELECT count(*) FROM own) AS m, (SELECT count(*) FROM entries) AS x),
fan AS (SELECT target_id AS symbol_id, count(*) AS n FROM edges GROUP BY 1),
a1 AS (SELECT string_agg('- **' || title || '** — ' || n_members || ' symbols (cohesion: ' || {_whole('cohesion')} || '%)', '\n' ORDER BY community_id) AS t FROM own WHERE n_members > 1),
a2 AS (SELECT string_agg('- `' || name || '` — ' || reason, '\n' ORDER BY score DESC, symbol_id) AS t FROM (SELECT * FROM entries ORDER BY score DESC, symbol_id LIMIT 5)),
a3 AS (SELECT string_agg('- **' || n || '** ' || CASE kind WHEN 'CALLS' THEN 'function calls' WHEN 'IMPORTS' THEN 'import dependencies' WHEN 'EXTENDS' THEN 'inheritance relationships' ELSE 'interface implementations' END, '\n' ORDER BY n DESC, kind) AS t FROM (SELECT kind, count(*) AS n FROM edges GROUP BY 1)),
three AS (SELECT community_id, string_agg(name, '`, `' ORDER BY symbol_id) AS names FROM (SELECT community_id, symbol_id, name, row_number() OVER (PARTITION BY community_id ORDER BY symbol_id) AS r FROM members JOIN symbols USING (symbol_id)) WHERE r <= 3 GROUP BY 1),
a4 AS (SELECT string_agg('- **' || title || '** (' || n_members || ' symbols) — includes: `' || names || '`', '\n' ORDER BY n_members DESC, community_id) AS t FROM (SELECT * FROM own JOIN three USING (community_id) WHERE n_members > 1 ORDER BY n_members DESC, community_id LIMIT 10)),
a5 AS (SELECT string_agg(r || '. **`' || name || '`** (' || kind || ') — ' || reason || ' *(score: ' || printf('%.1f', score) || ')*', '\n' ORDER BY r) AS t FROM (SELECT entries.*, kind, row_number() OVER (ORDER BY score DESC, symbol_id) AS r FROM entries JOIN (SELECT symbol_id, kind FROM symbols) USING (symbol_id)) WHERE r <= 8),
a6 AS (SELECT string_agg('- `' || name || '` (' || kind || ') — used by ' || n || ' other symbols', '\n' ORDER BY n DESC, symbol_id) AS t FROM (SELECT * FROM fan JOIN symbols USING (symbol_id) WHERE n >= 3 ORDER BY n DESC, symbol_id LIMIT 8)),
a7 AS (SELECT string_agg('- **' || title || '** — ' || n_members || ' symbols, cohesion ' || {_whole('cohesion')} || '%', '\n' ORDER BY cohesion, community_id) AS t FROM (SELECT * FROM own WHERE n_members > 2 ORDER BY cohesion, community_id LIMIT 5)),
texts AS (SELECT 'overview' AS kind, '## Project Overview\n\nThis project contains **' || f || ' files** with **' || s || ' symbols** across **' || l || ' lines of code**, written in **' || coalesce(langs, 'unknown languages') || '**.\n\nThe codebase is organized into **' || m || ' functional modules** (automatically detected communities) with **' || x || ' entry points**.' || coalesce('\n\n### Modules at a Glance\n\n' || a1.t, '') || coalesce('\n\n### Key Entry Points\n\n' || a2.t, '') AS content FROM cnt, a1, a2
UNION ALL SELECT 'architecture', CASE WHEN m = 0 THEN 'No community/module structure detected yet.' ELSE '## Architecture\n\nThe codebase consists of **' || s || ' symbols** connected by **' || e || ' relationships** across **' || m || ' modules**.\n\n' || coalesce('### Relationship Types\n\n' || a3.t || '\n\n', '') || '### Module Hierarchy\n\n' || coalesce(a4.t, '') END FROM cnt, a3, a4
UNION ALL SELECT 'reading_order', coalesce('## Recommended Reading Order\n\nStart with the entry points below, then follow the dependency chains to understand how the codebase fits together.\n\n' || t, 'No entry points detected. Run analysis to generate reading order.') FROM a5
UNION ALL SELECT 'extension_guide', '## Extension Guide\n\nTo extend this codebase, look at the modules with the highest cohesion — they represent well-defined functional areas where new features can be added cleanly.\n' || coalesce('\n### Key Extension Points (high fan-in)\n\n' || t, '') FROM a6
UNION ALL SELECT 'contribution_guide', '## Contribution Guide\n\nHere''s how to get started contributing to this codebase:\n\n1. **Start with entry points** — understand the main execution paths\n2. **Pick a module** — each module is relatively self-contained\n3. **Follow the edges** — understand how your module connects to others\n' || coalesce('\n### Good First Areas\n\n' || t, '') FROM a7
UNION ALL SELECT 'why_trending', '## Why This Project\n\nThis project is written in ' || coalesce(langs, 'various languages') || ' with ' || f || ' files. Explore the modules, architecture, and entry points to understand its design.' FROM cnt)
SELECT 'module_summary' AS kind, community_id AS target_id, content, true AS is_placeholder FROM told UNION ALL SELECT kind, NULL, content, true FROM texts"""


@query(_OWN + _SUMMARY + " SELECT community_id, content FROM told")
def module_summaries(s: SparkSession, d: str) -> DataFrame:
    sym, e, mem, lab = _parts(s, d)
    return documents.summaries(sym, e, mem, documents.titled(graph.cohesion(e, mem), lab))


@query(_NARRATIVES)
def narratives(s: SparkSession, d: str) -> DataFrame:
    sym, e, mem, lab, coh, entries = _all_parts(s, d)
    return documents.narratives(sym, e, mem, lab, adapter.files(sym), coh, entries)


@query()
def topo_chapters(s: SparkSession, d: str) -> DataFrame:
    sym, e, mem, lab = _parts(s, d)
    return documents.curriculum(mem, lab, e, graph.entry_points(sym, e))


_QUIZ = """, two AS (SELECT * FROM (SELECT community_id, symbol_id, name, row_number() OVER (PARTITION BY community_id ORDER BY symbol_id) - 1 AS i FROM members JOIN symbols USING (symbol_id)) WHERE i < 2),
ways AS (SELECT t.community_id, i, t.name, o.name AS other, e.kind, edge_id, row_number() OVER (PARTITION BY t.community_id, i ORDER BY edge_id DESC) AS r FROM edges e JOIN two t ON t.symbol_id = source_id JOIN symbols o ON o.symbol_id = target_id),
down AS (SELECT community_id, i, list(other ORDER BY r) AS others FROM ways WHERE r <= 4 GROUP BY ALL), kin AS (SELECT community_id, i, arg_max(other, edge_id) AS parent, arg_max(kind, edge_id) AS kind FROM ways WHERE kind IN ('EXTENDS', 'IMPLEMENTS') GROUP BY ALL),
up AS (SELECT community_id, i, list(other ORDER BY r) AS others FROM (SELECT t.community_id, i, o.name AS other, row_number() OVER (PARTITION BY t.community_id ORDER BY edge_id DESC) AS r FROM edges e JOIN two t ON t.symbol_id = target_id AND i = 0 JOIN symbols o ON o.symbol_id = source_id) WHERE r <= 4 GROUP BY ALL),
four AS (SELECT list(struct_pack(c := community_id, l := label) ORDER BY community_id) AS known FROM (SELECT * FROM labels ORDER BY community_id LIMIT 4)),
base AS (SELECT two.*, down.others, down.others[1] AS first, kin.kind AS kin, coalesce(kin.parent, 'Base' || name) AS parent, CASE WHEN kin.kind = 'IMPLEMENTS' THEN 'implements' ELSE 'extends' END AS verb FROM two LEFT JOIN down USING (community_id, i) LEFT JOIN kin USING (community_id, i)),
asked AS (SELECT community_id, 0 AS rank, i, 'dep' AS w, 'multiple_choice' AS kind, 'Which symbol does ''' || name || ''' depend on?' AS question, list_append(others, name || 'Helper')[1:4] AS options, 0 AS correct_index, '''' || name || ''' has a direct dependency edge to ''' || first || ''' in the knowledge graph.' AS explanation FROM base WHERE others IS NOT NULL
UNION ALL SELECT community_id, 1, i, 'call', 'true_false', 'True or False: ''' || name || ''' calls ''' || coalesce(first, name || 'Processor') || '''.', ['True', 'False'], CASE WHEN first IS NULL THEN 1 ELSE 0 END, CASE WHEN first IS NOT NULL THEN '''' || name || ''' calls ''' || first || ''' as shown by the CALLS edge in the knowledge graph.' ELSE '''' || name || ''' does not call ''' || name || 'Processor'' — there is no such edge in the knowledge graph.' END FROM base
UNION ALL SELECT community_id, 2, i, 'member', 'multiple_choice', 'Which module contains ''' || name || '''?', CASE WHEN len(list_filter(known, lambda x: x.c <> community_id)) = 0 THEN [label, 'Utilities'] ELSE list_concat([label], list_transform(list_filter(known, lambda x: x.c <> community_id), lambda x: x.l)[1:3]) END, 0, '''' || name || ''' is a member of the ''' || label || ''' community.' FROM base JOIN labels USING (community_id), four WHERE i = 0
UNION ALL SELECT community_id, 3, i, 'heritage', 'true_false', 'True or False: ''' || name || ''' ' || verb || ' ''' || parent || '''.', ['True', 'False'], CASE WHEN kin IS NULL THEN 1 ELSE 0 END, CASE WHEN kin IS NOT NULL THEN '''' || name || ''' ' || verb || ' ''' || parent || ''' as shown by the ' || upper(verb) || ' edge in the knowledge graph.' ELSE '''' || name || ''' does not extend ''' || parent || ''' — there is no such edge in the knowledge graph.' END FROM base
UNION ALL SELECT community_id, 4, i, 'impact', 'impact_analysis', 'If you change ''' || name || ''', which functions would be affected?', list_append(up.others, 'No other functions'), 0, 'Changing ''' || name || ''' would affect: ' || array_to_string(up.others, ', ') || '. These functions have direct dependency edges to ''' || name || '''.' FROM two JOIN up USING (community_id, i)),
placed AS (SELECT *, row_number() OVER (PARTITION BY community_id ORDER BY rank, i) AS place FROM asked)
SELECT community_id, place, 'q_' || w || '_' || community_id || '_' || i AS id, kind, question, array_to_string(options, '|') AS options, CAST(correct_index AS INT) AS correct_index, explanation FROM placed WHERE place <= 5"""


@query(LABELS + _QUIZ)
def quiz_questions(s: SparkSession, d: str) -> DataFrame:
    return documents.quiz(*_parts(s, d)).withColumn("options", F.array_join("options", "|"))


_EXPORT = """, z AS (SELECT kind, CASE WHEN n > 45 THEN 'error' WHEN n > 35 THEN 'warning' ELSE 'info' END AS severity FROM (SELECT kind, end_line - start_line AS n FROM symbols WHERE kind IN ('Function', 'Method')) WHERE n > 25),
lang AS (SELECT language, round(100.0 * count(*) / sum(count(*)) OVER (), 6)::DOUBLE AS percent FROM files GROUP BY 1), mods AS (SELECT community_id, label, n FROM labels JOIN (SELECT community_id, count(*) AS n FROM members GROUP BY 1) USING (community_id))
SELECT '{"repo":"driver tables","files":' || (SELECT count(*) FROM files) || ',"sloc":' || (SELECT CAST(sum(sloc) AS BIGINT) FROM files) || ',"symbols":' || (SELECT count(*) FROM symbols)
  || ',"languages":[' || (SELECT string_agg('{"order":' || (-percent) || ',"language":"' || language || '","percent":' || percent || '}', ',' ORDER BY percent DESC, language) FROM lang)
  || '],"modules":[' || (SELECT string_agg('{"order":' || (-n) || ',"community_id":' || community_id || ',"label":"' || label || '","members":' || n || '}', ',' ORDER BY n DESC, community_id) FROM mods)
  || '],"edges":{' || (SELECT string_agg('"' || kind || '":' || n, ',' ORDER BY kind) FROM (SELECT kind, count(*) AS n FROM edges GROUP BY 1))
  || '},"findings":{' || (SELECT string_agg('"' || severity || '":' || n, ',' ORDER BY severity) FROM (SELECT severity, count(*) AS n FROM z GROUP BY 1)) || '}}' AS document"""


@query(LABELS + _EXPORT)
def export_document(s: SparkSession, d: str) -> DataFrame:
    sym, e, mem, lab = _parts(s, d)
    return documents.export("driver tables", adapter.files(sym), sym, e, mem, lab, detectors.long_method(sym, 25, 35, 45))


# --- views ----------------------------------------------------------------------------------------------------------


@query(", e AS (SELECT source_id AS symbol_id FROM edges UNION ALL SELECT target_id FROM edges WHERE source_id <> target_id), n AS (SELECT symbol_id, count(*) AS n FROM e GROUP BY 1) SELECT symbol_id, community_id % 10 AS color, round(least(greatest(3 + 0.7 * coalesce(n, 0), 3), 14), 6)::DOUBLE AS size FROM members LEFT JOIN n USING (symbol_id)")
def node_looks(s: SparkSession, d: str) -> DataFrame:
    deg = graph.degrees(_sym(s, d), _edges(s, d)).join(adapter.members(s, d), "symbol_id")
    return deg.select("symbol_id", layout.color_index(F.col("community_id")).alias("color"), F.round(layout.node_size(F.col("degree")), 6).alias("size"))


_LAYERS = """, held(x) AS (SELECT symbol_id FROM scc UNION SELECT b FROM held JOIN e ON a = x), free AS (SELECT * FROM e WHERE a NOT IN (FROM held) AND b NOT IN (FROM held)),
r2(node, k) AS (SELECT symbol_id, 0 FROM symbols WHERE symbol_id NOT IN (FROM held) UNION SELECT b, k + 1 FROM r2 JOIN free ON a = node), top AS (SELECT node, CAST(max(k) AS BIGINT) AS layer FROM r2 GROUP BY 1)
SELECT node AS symbol_id, layer FROM top UNION ALL SELECT x, (SELECT coalesce(max(layer) + 1, 0) FROM top) FROM held"""


@query(_SCC + ", scc AS (" + _SCC_ROWS + ")" + _LAYERS)
def layers(s: SparkSession, d: str) -> DataFrame:
    return layout.layers(_sym(s, d), _edges(s, d))


@query(", c AS (SELECT DISTINCT chapter_id FROM sections) SELECT chapter_id, coalesce(lead(chapter_id) OVER (ORDER BY chapter_id), -1) AS following FROM c")
def next_chapter(s: SparkSession, d: str) -> DataFrame:
    c = adapter.sections(s, d).select("chapter_id").distinct()
    # the next id by a range join would compare all pairs; the least greater id is found among neighbours in buckets of 64
    own = c.withColumn("b", F.floor(F.col("chapter_id") / 64))
    heads = own.groupBy("b").agg(F.min("chapter_id").alias("head"))
    w = Window.partitionBy("b").orderBy("chapter_id")
    following = heads.select(F.lead("b").over(Window.orderBy("b")).alias("nb"), "b").join(heads.select(F.col("b").alias("nb"), F.col("head").alias("next_head")), "nb").select("b", "next_head")
    return own.withColumn("nxt", F.lead("chapter_id").over(w)).join(following, "b", "left").select("chapter_id", F.coalesce("nxt", "next_head", F.lit(-1)).alias("following"))


@query(" SELECT chapter_id, count(*) AS n_sections, max(section_id) - 1 AS last_index FROM sections GROUP BY 1")
def section_order(s: SparkSession, d: str) -> DataFrame:
    return adapter.sections(s, d).groupBy("chapter_id").agg(F.count(F.lit(1)).alias("n_sections"), (F.max("section_id") - 1).alias("last_index"))


from . import catalog_code, catalog_reads  # noqa: E402,F401  (register the rest, with what is defined above)
