"""Names and import paths resolved to symbols and files by equi-joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import numbered

EXACT, UNIQUE, AMBIGUOUS, IMPORTED = 1.0, 0.7, 0.4, 0.6
_TS = ("", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", "/index.ts", "/index.tsx", "/index.js", "/index.jsx")
_ANY = (".py", ".ts", ".tsx", ".js", ".jsx", ".rs", ".go", ".java", ".mjs", ".cjs")


def name_index(symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(name, path, in_file): the last symbol of that name in a file; (name, first, n): the first anywhere and how many."""
    by_file = symbols.groupBy("name", "path").agg(F.max("symbol_id").alias("in_file"))
    by_name = symbols.groupBy("name").agg(F.min("symbol_id").alias("first"), F.count(F.lit(1)).alias("n"))
    return by_file, by_name


def resolve(refs: DataFrame, symbols: DataFrame, name: str, to: str) -> DataFrame:
    """``refs(path, name, ...)`` with ``to`` (symbol id or null) and ``to_confidence``."""
    by_file, by_name = name_index(symbols)
    out = refs.join(by_file.withColumnRenamed("name", name), [name, "path"], "left").join(by_name.withColumnRenamed("name", name), name, "left")
    conf = F.when(F.col("in_file").isNotNull(), EXACT).when(F.col("n") == 1, UNIQUE).when(F.col("n") > 1, AMBIGUOUS)
    return out.withColumns({to: F.coalesce("in_file", "first"), f"{to}_confidence": conf}).drop("in_file", "first", "n")


def call_edges(calls: DataFrame, symbols: DataFrame, keep: list[str] | tuple = ()) -> DataFrame:
    """``calls(path, caller, callee)`` -> source_id, target_id, kind, confidence (that of the callee); duplicates stay; with the columns ``keep`` of ``calls``.

    A caller ``<module>`` is the file's least symbol.
    """
    heads = symbols.groupBy("path").agg(F.min("symbol_id").alias("head"))
    out = resolve(resolve(calls, symbols, "caller", "source_id"), symbols, "callee", "target_id").join(heads, "path", "left")
    source = F.when(F.col("caller") == "<module>", F.col("head")).otherwise(F.col("source_id"))
    return out.select(*keep, source.alias("source_id"), "target_id", F.lit("CALLS").alias("kind"), F.col("target_id_confidence").alias("confidence")).where("source_id is not null and target_id is not null")


def heritage_edges(heritage: DataFrame, symbols: DataFrame, keep: list[str] | tuple = ()) -> DataFrame:
    """``heritage(child, parent, relation)`` -> edges between the first symbols of those names, confidence 1; with the columns ``keep`` of ``heritage``."""
    _, by_name = name_index(symbols)
    child = by_name.select(F.col("name").alias("child"), F.col("first").alias("source_id"))
    parent = by_name.select(F.col("name").alias("parent"), F.col("first").alias("target_id"))
    return heritage.join(child, "child").join(parent, "parent").select(*keep, "source_id", "target_id", F.upper("relation").alias("kind"), F.lit(1.0).alias("confidence"))


def promote_imports(deps: DataFrame, symbols: DataFrame) -> DataFrame:
    """``deps(source_file, target_file)`` -> IMPORTS edges between the files' least symbols."""
    heads = symbols.groupBy("file_id").agg(F.min("symbol_id").alias("head"))
    a = heads.select(F.col("file_id").alias("source_file"), F.col("head").alias("source_id"))
    b = heads.select(F.col("file_id").alias("target_file"), F.col("head").alias("target_id"))
    return deps.join(a, "source_file").join(b, "target_file").select("source_id", "target_id", F.lit("IMPORTS").alias("kind"), F.lit(IMPORTED).alias("confidence"))


def normalize(path):
    """A path without '.', '..' and empty steps."""
    steps = F.split(path, "/")
    fold = lambda acc, x: F.when((x == "") | (x == "."), acc).when((x == "..") & (F.size(acc) > 0), F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).when(x == "..", acc).otherwise(F.array_append(acc, x))
    return F.array_join(F.aggregate(steps, F.array().cast("array<string>"), fold), "/")


def _parent(path):
    return F.regexp_replace(F.regexp_replace(path, "[^/]*$", ""), "/$", "")


def _joined(base, rest):
    return normalize(F.concat(base, F.lit("/"), rest))


def candidates(imports: DataFrame) -> DataFrame:
    """Ranked candidate paths of ``imports(path, language, module)``: import, rank, how (exact or suffix), candidate.

    Each language's search order is a list of paths, so that resolution is an equi-join and not a scan of all files.
    """
    m, here = F.col("module"), _parent(F.col("path"))
    up = _parent(here)
    # TypeScript and JavaScript: relative modules only
    ts = F.when(m.startswith("./") | m.startswith("../"), F.array(*[F.struct(F.lit("exact").alias("how"), F.concat(_joined(here, m), F.lit(x)).alias("candidate")) for x in _TS]))
    # Python: leading dots climb, then module and package; absolute: root, own directory, any suffix
    dots = F.length(F.regexp_extract(m, "^(\\.*)", 1))
    rest = F.replace(F.regexp_replace(m, "^\\.+", ""), F.lit("."), F.lit("/"))
    climb = F.concat(here, F.lit("/"), F.array_join(F.array_repeat(F.lit(".."), F.greatest(dots - 1, F.lit(0))), "/"))
    forms = lambda base, how: [F.struct(F.lit(how).alias("how"), F.concat(base, F.lit(x)).alias("candidate")) for x in (".py", "/__init__.py")]
    py = F.when(dots > 0, F.array(*forms(_joined(climb, rest), "exact"))).otherwise(F.array(*forms(rest, "exact"), *forms(_joined(here, rest), "exact"), *forms(rest, "suffix")))
    # Rust: crate, self and super anchor the path; ever shorter prefixes of the segments
    plain = F.regexp_replace(m, "::\\{.*$|::\\*$", "")
    segs = F.split(F.regexp_replace(plain, "^(crate|self|super)::", ""), "::")
    src = F.regexp_extract(F.col("path"), "^(.*?/?src)/", 1)
    base = F.when(plain.startswith("crate::"), src).when(plain.startswith("self::"), here).when(plain.startswith("super::"), up)
    heads = F.transform(F.sequence(F.size(segs), F.lit(1), F.lit(-1)), lambda k: F.array_join(F.slice(segs, F.lit(1), k), "/"))
    tails = lambda b, how: F.flatten(F.transform(heads, lambda h: F.array(*[F.struct(F.lit(how).alias("how"), normalize(F.concat_ws("/", b, h + x if isinstance(h, str) else F.concat(h, F.lit(x)))).alias("candidate")) for x in (".rs", "/mod.rs", "/lib.rs")])))
    crate = F.replace(segs[0], F.lit("_"), F.lit("-"))
    rs = F.when(base.isNotNull(), tails(base, "exact")).otherwise(F.concat(F.array(F.struct(F.lit("suffix").alias("how"), F.concat(crate, F.lit("/src/lib.rs")).alias("candidate"))), tails(F.lit(None).cast("string"), "suffix")))
    # everything else: the path with any extension, then dotted packages as a suffix
    dotted = F.replace(m, F.lit("."), F.lit("/"))
    other = F.array(*[F.struct(F.lit("exact").alias("how"), F.concat(m, F.lit(x)).alias("candidate")) for x in _ANY], *[F.struct(F.lit("suffix").alias("how"), F.concat(dotted, F.lit(x)).alias("candidate")) for x in (".go", ".java")])
    lang = F.col("language")
    ways = F.when(lang.isin("typescript", "javascript"), ts).when(lang == "python", py).when(lang == "rust", rs).otherwise(other)
    ways = F.concat(F.array(F.struct(F.lit("exact").alias("how"), m.alias("candidate"))), F.coalesce(ways, F.expr("cast(array() as array<struct<how: string, candidate: string>>)")))
    return imports.select("path", "module", F.posexplode(ways).alias("rank", "way")).select("path", "module", "rank", "way.how", "way.candidate")


def import_edges(imports: DataFrame, files: DataFrame) -> DataFrame:
    """``imports(path, language, module)`` and ``files(file_id, path)`` -> distinct source_file, target_file.

    Suffix matches join an index of every path's endings; the first candidate that exists wins, then the least file_id.
    """
    steps = F.split("path", "/")
    ends = files.select("file_id", F.explode(F.transform(F.sequence(F.lit(1), F.size(steps)), lambda k: F.array_join(F.slice(steps, k, F.size(steps)), "/"))).alias("candidate"))
    index = files.select("file_id", F.col("path").alias("candidate"), F.lit("exact").alias("how")).unionByName(ends.withColumn("how", F.lit("suffix")))
    found = candidates(imports.distinct()).join(index, ["how", "candidate"]).groupBy("path", "module").agg(F.min_by("file_id", F.struct("rank", "file_id")).alias("target_file"))
    own = files.select("path", F.col("file_id").alias("source_file"))
    return found.join(own, "path").where("source_file <> target_file").select("source_file", "target_file").distinct()


def build_graph(parsed: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """edge_id, source_id, target_id, kind, confidence of nested ``parsed`` files: calls, then imports, then heritage, each in order of its ends.

    ``symbols(symbol_id, file_id, path, name, ...)`` and ``files(file_id, path)`` carry the ids.
    """
    rows = lambda what: parsed.select("path", "language", F.explode(what).alias("x")).select("path", "language", "x.*")
    calls = call_edges(rows("calls").select("path", "caller", "callee"), symbols)
    imports = promote_imports(import_edges(rows("imports").select("path", "language", "module"), files), symbols)
    kin = heritage_edges(rows("heritage").select("child", "parent", "relation"), symbols)
    out = None
    for rank, part in enumerate((calls, imports, kin)):
        own = part.select("source_id", "target_id", "kind", "confidence", F.lit(rank).alias("rank"))
        out = own if out is None else out.unionByName(own)
    return numbered(out, ["rank", "source_id", "target_id", "kind", "confidence"], "edge_id").select("edge_id", "source_id", "target_id", "kind", "confidence")
