"""Rules that turn code relations into findings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import lines
from .graph import cycles

#: (regex, severity, message, suggestion): fixed values.
HOTSPOTS = (
    (r"\beval\s*\(", "warning", "Dynamic code execution via eval()", "Avoid eval() — use safer alternatives like JSON.parse or AST-based evaluation"),
    (r"\bexec\s*\(", "warning", "Dynamic code execution via exec()", "Avoid exec() — use safer alternatives"),
    (r"""(?i)(password|api_key|secret)\s*=\s*["']""", "error", "Hardcoded secret", "Use environment variables or a secrets manager instead of hardcoded values"),
    (r"""f["']SELECT\b|f["']INSERT\b|f["']UPDATE\b|f["']DELETE\b|\bSELECT\b.*\+\s*\w|\bSELECT\b.*\{.*\}""", "warning", "Potential SQL injection", "Use parameterized queries instead of string concatenation"),
    (r"\b(subprocess|os\.system|child_process)\b", "warning", "Command injection risk", "Sanitize inputs and avoid shell=True; use subprocess with a list of arguments"),
    (r"\b(innerHTML|dangerouslySetInnerHTML)\b", "warning", "XSS risk", "Sanitize HTML content before rendering; prefer textContent or safe rendering APIs"),
)
FINDING = ("kind", "severity", "file_id", "symbol_id", "line", "message", "suggestion")
#: What to do about a finding: fixed values.
GOD_HINT = "Consider splitting into smaller classes with single responsibilities"
LONG_HINT = "Extract helper methods to improve readability"
CYCLE_HINT = "Break the cycle by extracting shared types into a common module"
TEST_HINT = ("Add tests for this file — it has ", " public symbols")


def god_class(symbols: DataFrame, warn: int = 20, error: int = 30) -> DataFrame:
    """Classes and structs that span more than ``warn`` methods of their file; file_id is the equi key of the range join."""
    owner = symbols.where("kind in ('Class', 'Struct')").select("file_id", "symbol_id", "name", F.col("start_line").alias("a"), F.col("end_line").alias("b"))
    method = symbols.where("kind = 'Method'").select("file_id", "start_line", "end_line")
    counts = owner.join(method, "file_id").where("start_line >= a and end_line <= b").groupBy("file_id", "symbol_id", "name", "a").agg(F.count(F.lit(1)).alias("n"))
    text = F.concat(F.lit("'"), F.col("name"), F.lit("' has "), F.col("n"), F.lit(" methods"))
    return counts.where(F.col("n") > warn).select(F.lit("god_class").alias("kind"), F.when(F.col("n") > error, "error").otherwise("warning").alias("severity"), "file_id", "symbol_id", F.col("a").alias("line"), text.alias("message"), F.lit(GOD_HINT).alias("suggestion"))


def long_method(symbols: DataFrame, info: int = 50, warn: int = 100, error: int = 200) -> DataFrame:
    span = F.col("end_line") - F.col("start_line")
    rank = F.when(span > error, "error").when(span > warn, "warning").otherwise("info")
    text = F.concat(F.lit("'"), F.col("name"), F.lit("' is "), span, F.lit(" lines long"))
    return symbols.where(F.col("kind").isin("Function", "Method") & (span > info)).select(F.lit("long_method").alias("kind"), rank.alias("severity"), "file_id", "symbol_id", F.col("start_line").alias("line"), text.alias("message"), F.lit(LONG_HINT).alias("suggestion"))


def circular(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """A finding for each strongly connected component, its members in order of symbol_id."""
    named = cycles(edges).join(symbols.select("symbol_id", "name", "file_id"), "symbol_id")
    own = named.groupBy("component").agg(F.array_sort(F.collect_list(F.struct("symbol_id", "name", "file_id"))).alias("m"))
    names = F.transform("m", lambda x: x["name"])
    text = F.concat(F.lit("Circular: "), F.array_join(names, " → "), F.lit(" → "), names[0])
    return own.select(F.lit("circular_dependency").alias("kind"), F.lit("warning").alias("severity"), F.col("m")[0]["file_id"].alias("file_id"), F.col("component").alias("symbol_id"), F.lit(None).cast("long").alias("line"), text.alias("message"), F.lit(CYCLE_HINT).alias("suggestion"))


def is_test(path) -> F.Column:
    return F.lower(path).rlike(r"test_|_test\.|\.test\.|\.spec\.|/tests/|/test/")


def test_gap(symbols: DataFrame, least: int = 5) -> DataFrame:
    """Files of more than ``least`` symbols, not tests themselves, none of whose usual test files exists."""
    sized = symbols.groupBy("file_id", "path").agg(F.count(F.lit(1)).alias("n"))
    stem, ext = F.regexp_extract("path", r"([^/]*?)\.[^./]+$", 1), F.regexp_extract("path", r"\.([^./]+)$", 1)
    home = F.regexp_replace("path", "[^/]*$", "")
    py = [F.concat(home, F.lit("test_"), stem, F.lit(".py")), F.concat(home, stem, F.lit("_test.py")), F.concat(home, F.lit("tests/"), stem, F.lit(".py")), F.concat(home, F.lit("tests/test_"), stem, F.lit(".py")), F.concat(F.lit("tests/test_"), stem, F.lit(".py")), F.concat(F.lit("tests/"), stem, F.lit(".py"))]
    js = [F.concat(home, stem, F.lit(".test."), ext), F.concat(home, stem, F.lit(".spec."), ext)]
    rs = [F.concat(F.lit("tests/"), stem, F.lit(".rs")), F.when(F.col("path").contains("src/"), F.replace("path", F.lit("src/"), F.lit("tests/")))]
    ways = F.when(ext == "py", F.array(*py)).when(ext.isin("ts", "tsx", "js", "jsx"), F.array(*js)).when(ext == "go", F.array(F.concat(home, stem, F.lit("_test.go")))).when(ext == "rs", F.array(*rs)).otherwise(F.array().cast("array<string>"))
    watched = sized.where((F.col("n") > least) & ~is_test(F.col("path")))
    covered = watched.select("file_id", F.explode(ways).alias("want")).join(symbols.select(F.col("path").alias("want")).distinct(), "want", "left_semi").select("file_id")
    text = F.concat(F.col("path"), F.lit(" has no test file"))
    return watched.join(covered, "file_id", "left_anti").select(F.lit("test_gap").alias("kind"), F.lit("info").alias("severity"), "file_id", F.lit(None).cast("long").alias("symbol_id"), F.lit(None).cast("long").alias("line"), text.alias("message"), F.concat(F.lit(TEST_HINT[0]), "n", F.lit(TEST_HINT[1])).alias("suggestion"))


def security(texts: DataFrame, patterns=HOTSPOTS) -> DataFrame:
    """``texts(file_id, content)`` -> a finding for each line and pattern; literal patterns stay inside generated code."""
    flat = texts.select("file_id", F.posexplode(lines(F.col("content"))).alias("at", "row"))
    hits = F.array_compact(F.array(*[F.when(F.col("row").rlike(p), F.struct(F.lit(s).alias("severity"), F.lit(m).alias("message"), F.lit(h).alias("suggestion"))) for p, s, m, h in patterns]))
    return flat.where(F.greatest(*[F.col("row").rlike(p) for p, *_ in patterns], F.lit(False))).select("file_id", "at", F.explode(hits).alias("h")).select(F.lit("security_hotspot").alias("kind"), "h.severity", "file_id", F.lit(None).cast("long").alias("symbol_id"), (F.col("at") + 1).cast("long").alias("line"), "h.message", "h.suggestion")


def findings(symbols: DataFrame, edges: DataFrame, texts: DataFrame | None = None, owners: DataFrame | None = None, god: tuple[int, int] = (20, 30), long: tuple[int, int, int] = (50, 100, 200)) -> DataFrame:
    """All findings: god classes, long methods, cycles, security hotspots (if ``texts`` are given), test gaps.

    ``owners`` are the symbols with the spans to look for god classes in, if these are others; ``god`` and ``long`` are the bounds of the two rules.
    """
    out = god_class(symbols if owners is None else owners, *god).unionByName(long_method(symbols, *long)).unionByName(circular(symbols, edges))
    if texts is not None:
        out = out.unionByName(security(texts))
    return out.unionByName(test_gap(symbols))
