"""The driver's star-schema tables seen as a code corpus.

Parts are symbols, brands and types make files, consecutive lines of an order make edges.  The same
definitions stand in ``CTE`` as DuckDB SQL, so every operator can be checked on them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

VERBS = ("get", "handle", "parse", "route", "cli", "build", "load", "emit")
KINDS = ("Function", "Method", "Class", "Struct")
#: part type -> (extension, language)
TYPES = {
    "ECONOMY": ("py", "python"),
    "LARGE": ("ts", "typescript"),
    "MEDIUM": ("js", "javascript"),
    "PROMO": ("rs", "rust"),
    "SMALL": ("go", "go"),
    "STANDARD": ("java", "java"),
}
EDGE_STRIDE = 4096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values, at) -> F.Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (at + 1).cast("int"))


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol_id, file_id, path, language, name, kind, start_line, end_line."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    key = F.col("p_partkey")
    ext = F.create_map(*[F.lit(x) for t, (e, _) in TYPES.items() for x in (t, e)])
    lang = F.create_map(*[F.lit(x) for t, (_, n) in TYPES.items() for x in (t, n)])
    path = F.concat(F.lit("src/"), F.lower("p_type"), F.lit("/"), F.replace(F.lower("p_brand"), F.lit("#"), F.lit("_")), F.lit("."), ext[F.col("p_type")])
    plain = F.concat(_pick(VERBS, F.col("p_size") % 8), F.lit("_"), F.replace("p_name", F.lit(" "), F.lit("_")), F.when(key % 7 == 0, F.concat(F.lit("_"), key.cast("string"))).otherwise(""))
    name = F.when(key % 97 == 0, "main").when(key % 89 == 0, "index").otherwise(plain)
    end = F.sum("p_size").over(Window.partitionBy("path").orderBy("symbol_id"))
    rows = part.select(key.alias("symbol_id"), path.alias("path"), lang[F.col("p_type")].alias("language"), name.alias("name"), _pick(KINDS, key % 4).alias("kind"), F.col("p_size").cast("long").alias("p_size"))
    rows = rows.withColumn("end_line", end).withColumn("start_line", F.col("end_line") - F.col("p_size") + 1).drop("p_size")
    numbered = rows.select("path").distinct().withColumn("file_id", F.row_number().over(Window.orderBy("path")).cast("long"))  # a row a file
    return rows.join(numbered, "path").select("symbol_id", "file_id", "path", "language", "name", "kind", "start_line", "end_line")


def files(symbols: DataFrame) -> DataFrame:
    """file_id, path, language, sloc."""
    return symbols.groupBy("file_id", "path", "language").agg(F.max("end_line").alias("sloc"))


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """community_id, symbol_id: the brand's number is the community."""
    brand = F.regexp_extract("p_brand", "([0-9]+)", 1).cast("long")
    return table(spark, sf_dir, "part").select(brand.alias("community_id"), F.col("p_partkey").alias("symbol_id"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """edge_id, source_id, target_id, kind, confidence; ids grow with (order, place in the order)."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus", "l_discount")
    own = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    kind = F.when(F.col("l_returnflag") == "R", "CALLS").when(F.col("l_returnflag") == "A", "IMPORTS").when(F.col("l_linestatus") == "O", "EXTENDS").otherwise("IMPLEMENTS")
    rows = line.withColumns({"target_id": F.lead("l_partkey").over(own), "nth": F.row_number().over(own)}).where("target_id is not null")
    return rows.select((F.col("l_orderkey") * EDGE_STRIDE + F.col("nth")).alias("edge_id"), F.col("l_partkey").alias("source_id"), "target_id", kind.alias("kind"), F.round(1 - F.col("l_discount"), 2).alias("confidence"))


#: Lines of code that parts stand for, by size: some that detectors know, some that only look so.
LINES = (
    "value = eval (text)",
    "exec(command)",
    "API_KEY = 'abc'",
    'query = f"SELECT name FROM t"',
    "import subprocess",
    "node.innerHTML = html",
    'evaluate(x); password == "x"',
    "SELECT a + b",
    "return 0",
    "os.system(x); eval(y)",
)


def sources(symbols: DataFrame) -> DataFrame:
    """file_id, path, language, content: a line for each symbol of a file."""
    line = _pick(LINES, (F.col("end_line") - F.col("start_line") + 1) % len(LINES))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("symbol_id", line.alias("t")))), lambda x: x["t"])
    return symbols.groupBy("file_id", "path", "language").agg(F.array_join(rows, "\n").alias("content"))


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """commit_id, ts, author, path: events as a history."""
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("commit_id"), "ts", F.col("user_id").cast("string").alias("author"), F.concat(F.lit("file_"), F.get_json_object("props", "$.k")).alias("path"))


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chapter_id, section_id, content_type, completed: lines of orders as sections of chapters."""
    own = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_linestatus")
    nth = F.row_number().over(own)
    kind = _pick(("overview", "key_concepts", "diagram", "code_walkthrough", "connections", "quiz"), (F.col("section_id") - 1) % 6)
    rows = line.withColumn("section_id", nth.cast("long")).select(F.col("l_orderkey").alias("chapter_id"), "section_id", (F.col("l_linestatus") == "F").alias("completed"))
    return rows.withColumn("content_type", kind)


_SQL_LINES = ", ".join("'" + x.replace("'", "''") + "'" for x in LINES)
#: The same relations in DuckDB SQL.
CTE = f"""
sym0 AS (
  SELECT p_partkey AS symbol_id, CAST(p_size AS BIGINT) AS p_size,
    'src/' || lower(p_type) || '/' || replace(lower(p_brand), '#', '_') || '.' ||
      CASE p_type WHEN 'ECONOMY' THEN 'py' WHEN 'LARGE' THEN 'ts' WHEN 'MEDIUM' THEN 'js' WHEN 'PROMO' THEN 'rs' WHEN 'SMALL' THEN 'go' ELSE 'java' END AS path,
    CASE p_type WHEN 'ECONOMY' THEN 'python' WHEN 'LARGE' THEN 'typescript' WHEN 'MEDIUM' THEN 'javascript' WHEN 'PROMO' THEN 'rust' WHEN 'SMALL' THEN 'go' ELSE 'java' END AS language,
    CASE WHEN p_partkey % 97 = 0 THEN 'main' WHEN p_partkey % 89 = 0 THEN 'index'
      ELSE ['get','handle','parse','route','cli','build','load','emit'][p_size % 8 + 1] || '_' || replace(p_name, ' ', '_') || CASE WHEN p_partkey % 7 = 0 THEN '_' || p_partkey ELSE '' END END AS name,
    ['Function','Method','Class','Struct'][p_partkey % 4 + 1] AS kind
  FROM part),
symbols AS (
  SELECT symbol_id, CAST(dense_rank() OVER (ORDER BY path) AS BIGINT) AS file_id, path, language, name, kind,
    CAST(sum(p_size) OVER (PARTITION BY path ORDER BY symbol_id) - p_size + 1 AS BIGINT) AS start_line,
    CAST(sum(p_size) OVER (PARTITION BY path ORDER BY symbol_id) AS BIGINT) AS end_line FROM sym0),
files AS (SELECT file_id, path, language, max(end_line) AS sloc FROM symbols GROUP BY ALL),
members AS (SELECT CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS BIGINT) AS community_id, p_partkey AS symbol_id FROM part),
line0 AS (
  SELECT *, lead(l_partkey) OVER w AS target_id, row_number() OVER w AS nth FROM lineitem
  WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)),
edges AS (
  SELECT l_orderkey * 4096 + nth AS edge_id, l_partkey AS source_id, target_id,
    CASE WHEN l_returnflag = 'R' THEN 'CALLS' WHEN l_returnflag = 'A' THEN 'IMPORTS' WHEN l_linestatus = 'O' THEN 'EXTENDS' ELSE 'IMPLEMENTS' END AS kind,
    round(1 - l_discount, 2) AS confidence FROM line0 WHERE target_id IS NOT NULL),
sources AS (SELECT file_id, path, language, string_agg([{_SQL_LINES}][(end_line - start_line + 1) % {len(LINES)} + 1], chr(10) ORDER BY symbol_id) AS content FROM symbols GROUP BY ALL),
commits AS (SELECT event_id AS commit_id, ts, CAST(user_id AS VARCHAR) AS author, 'file_' || json_extract_string(props, '$.k') AS path FROM events),
sections AS (
  SELECT l_orderkey AS chapter_id, CAST(nth AS BIGINT) AS section_id, l_linestatus = 'F' AS completed,
    ['overview','key_concepts','diagram','code_walkthrough','connections','quiz'][(nth - 1) % 6 + 1] AS content_type FROM line0)
"""


def code_files(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """path, language, mtime, content: the corpus written out as code that the parsers read.

    A file first imports the files of its own language that its symbols import; then comes a definition for each
    symbol in order of symbol_id, with a line for each call.  ``PARSED_CTE`` says what a parser must find.
    """
    ends = symbols.select("symbol_id", "path", "language", "name")
    a, b = ends.select(*[F.col(c).alias(f"{c}_a") for c in ends.columns]), ends.select(*[F.col(c).alias(f"{c}_b") for c in ends.columns])
    both = edges.join(a, edges["source_id"] == a["symbol_id_a"]).join(b, edges["target_id"] == b["symbol_id_b"])
    stem = F.element_at(F.split("path_b", "[/.]"), -2)
    folder = F.element_at(F.split("path_b", "/"), -2)
    module = F.when(F.col("language_a") == "python", F.concat(F.lit("import src."), folder, F.lit("."), stem)).when(F.col("language_a").isin("typescript", "javascript"), F.concat(F.lit("import { all } from './"), stem, F.lit("'")))
    module = module.when(F.col("language_a") == "rust", F.concat(F.lit("use crate::"), folder, F.lit("::"), stem, F.lit(";"))).when(F.col("language_a") == "go", F.concat(F.lit('import "src/'), folder, F.lit("/"), stem, F.lit('"'))).otherwise(F.concat(F.lit("import src."), folder, F.lit("."), stem, F.lit(";")))
    imports = both.where("kind = 'IMPORTS' and language_a = language_b and path_a <> path_b").select(F.col("path_a").alias("path"), module.alias("line")).distinct()
    imports = imports.groupBy("path").agg(F.array_sort(F.collect_list("line")).alias("imports"))
    called = edges.where("kind = 'CALLS'").join(b, edges["target_id"] == b["symbol_id_b"])  # callers without a symbol fall out below
    calls = called.groupBy(F.col("source_id").alias("symbol_id")).agg(F.array_sort(F.collect_list(F.struct("edge_id", F.col("name_b").alias("name")))).alias("calls"))
    lang, name = F.col("language"), F.col("name")
    head = F.when(lang == "python", F.concat(F.lit("def "), name, F.lit("():"))).when(lang.isin("typescript", "javascript"), F.concat(F.lit("export function "), name, F.lit("() {")))
    head = head.when(lang == "rust", F.concat(F.lit("pub fn "), name, F.lit("() {"))).when(lang == "go", F.concat(F.lit("func "), name, F.lit("() {"))).otherwise(F.concat(F.lit("  public void "), name, F.lit("() {")))
    none = F.array().cast("array<string>")
    said = F.coalesce(F.transform("calls", lambda c: F.concat(F.lit("    "), c["name"], F.when(lang == "python", "()").otherwise("();"))), none)
    body = F.when((lang == "python") & (F.size(said) == 0), F.array(F.lit("    pass"))).otherwise(said)
    rows = F.concat(F.array(head), body, F.when(lang == "python", none).otherwise(F.array(F.lit("}"))))
    own = symbols.join(calls, "symbol_id", "left").select("path", "language", F.struct("symbol_id", rows.alias("rows")).alias("s"))
    texts = own.groupBy("path", "language").agg(F.flatten(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["rows"])).alias("rows"), F.max("s.symbol_id").alias("last"))
    content = F.array_join(F.concat(F.coalesce("imports", none), F.col("rows")), "\n")
    return texts.join(imports, "path", "left").select("path", "language", F.timestamp_seconds("last").alias("mtime"), content.alias("content"))


#: What parsing :func:`code_files` gives: spans in the written text, and imports of the own language.
PARSED_CTE = """
, own_imports AS (SELECT DISTINCT a.path, b.path AS target FROM edges JOIN symbols a ON a.symbol_id = source_id JOIN symbols b ON b.symbol_id = target_id WHERE edges.kind = 'IMPORTS' AND a.language = b.language AND a.path <> b.path),
n_calls AS (SELECT source_id AS symbol_id, count(*) AS n FROM edges WHERE kind = 'CALLS' GROUP BY 1),
high AS (SELECT symbol_id, path, language, name, CASE WHEN language = 'python' THEN 1 + greatest(1, coalesce(n, 0)) ELSE 2 + coalesce(n, 0) END AS h, coalesce(k, 0) AS top FROM symbols LEFT JOIN n_calls USING (symbol_id) LEFT JOIN (SELECT path, count(*) AS k FROM own_imports GROUP BY 1) USING (path)),
written AS (SELECT symbol_id, path, language, name, CASE WHEN language = 'java' THEN 'Method' ELSE 'Function' END AS kind, CAST(top + sum(h) OVER w - h + 1 AS BIGINT) AS start_line, CAST(top + sum(h) OVER w AS BIGINT) AS end_line FROM high WINDOW w AS (PARTITION BY path ORDER BY symbol_id)),
placed AS (SELECT *, row_number() OVER (ORDER BY path, start_line, name) AS nth FROM written)
"""
