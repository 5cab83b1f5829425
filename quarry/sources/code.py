"""Source files to symbols, imports, calls and heritage."""

from __future__ import annotations

import ast
import heapq
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.text import language_of
from .scan import scan

PARSED = (
    "path string, language string, sloc long, symbols array<struct<name: string, kind: string, start_line: bigint, end_line: bigint, signature: string>>, "
    "imports array<struct<module: string, name: string, line: bigint>>, calls array<struct<caller: string, callee: string, line: bigint>>, "
    "heritage array<struct<child: string, parent: string, relation: string, confidence: double>>"
)
RELATIONS = ("symbols", "imports", "calls", "heritage")
MODULE = "<module>"
PARSERS = ("python", "typescript", "javascript", "rust", "go", "java")
_HERITAGE = {"python": ("EXTENDS", 1.0), "java": ("EXTENDS", 0.8), "typescript": ("EXTENDS", 0.8), "javascript": ("EXTENDS", 0.8), "rust": ("IMPLEMENTS", 1.0)}
_NAME = r"([A-Za-z_$][\w$]*)"
#: language -> (kind, pattern of a definition's line, group 1 its name)
_DEFINITIONS = {
    "typescript": [("Class", rf"(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+{_NAME}"), ("Interface", rf"(?:export\s+)?interface\s+{_NAME}"), ("Enum", rf"(?:export\s+)?enum\s+{_NAME}"), ("Function", rf"(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*{_NAME}"), ("Function", rf"(?:export\s+)?(?:const|let|var)\s+{_NAME}\s*=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*(?::[^=]+)?=>"), ("Method", rf"\s+(?:public\s+|private\s+|protected\s+|static\s+|async\s+|get\s+|set\s+)*{_NAME}\s*\([^;]*\)\s*(?::[^{{;]+)?\{{")],
    "rust": [("Function", rf"\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?(?:unsafe\s+)?fn\s+{_NAME}"), ("Struct", rf"\s*(?:pub(?:\([^)]*\))?\s+)?struct\s+{_NAME}"), ("Enum", rf"\s*(?:pub(?:\([^)]*\))?\s+)?enum\s+{_NAME}"), ("Trait", rf"\s*(?:pub(?:\([^)]*\))?\s+)?trait\s+{_NAME}")],
    "go": [("Method", rf"func\s+\([^)]*\)\s*{_NAME}"), ("Function", rf"func\s+{_NAME}"), ("Struct", rf"type\s+{_NAME}\s+\w+")],
    "java": [("Class", rf"\s*(?:public\s+|private\s+|protected\s+|abstract\s+|final\s+|static\s+)*class\s+{_NAME}"), ("Interface", rf"\s*(?:public\s+|private\s+)*interface\s+{_NAME}"), ("Enum", rf"\s*(?:public\s+|private\s+)*enum\s+{_NAME}"), ("Method", rf"\s+(?:public\s+|private\s+|protected\s+|static\s+|final\s+|synchronized\s+)*[\w<>\[\], ]+\s+{_NAME}\s*\([^;]*\)\s*(?:throws [\w, ]+)?\{{")],
}
_DEFINITIONS["javascript"] = [d for d in _DEFINITIONS["typescript"] if d[0] not in ("Interface", "Enum")]
_IMPORTS = {
    "typescript": [r"""import\s+(?:type\s+)?(.*?)\s+from\s+['"`]([^'"`]+)""", r"""import\s+()['"`]([^'"`]+)"""],
    "rust": [r"\s*(?:pub\s+)?use\s+()([^;]+);"],
    "go": [r"""import\s+(\w*)\s*["`]([^"`]+)""", r"""\s+(\w*)\s*"([\w./-]+)"$"""],
    "java": [r"import\s+(?:static\s+)?()([\w.*]+);"],
}
_IMPORTS["javascript"] = [*_IMPORTS["typescript"], r"""(?:const|let|var)\s+(\S+)\s*=\s*require\(['"`]([^'"`]+)"""]
_PARENTS = {"typescript": rf"class\s+{_NAME}(?:<[^>]*>)?\s+(?:extends|implements)\s+([\w$., ]+)", "java": rf"class\s+{_NAME}(?:<[^>]*>)?\s+(?:extends|implements)\s+([\w., ]+)", "rust": rf"impl(?:<[^>]*>)?\s+(?:\w+::)*(\w+)(?:<[^>]*>)?\s+for\s+{_NAME}"}
_PARENTS["javascript"] = _PARENTS["typescript"]
#: One pattern a language that matches where one of its definitions may, so that most lines are tried once.
_ANY = {language: re.compile("|".join(f"(?:{pattern})" for _, pattern in own)) for language, own in _DEFINITIONS.items()}
_WORDS = frozenset("if for while switch match return catch function fn func class new await sizeof typeof super in loop else".split())


#: Characters of a text that the standard parser gets at once, where definitions allow a cut.
PIECE = 1 << 18
_TOP = re.compile(r"^(?:def|class|async|@)", re.M)


def _trees(text: str, piece: int):
    """(tree, lines before it) of a text's consecutive pieces, cut where a definition begins in the first column.

    A piece that parses ends outside of strings, brackets and statements, and no such line carries a statement on, so the pieces' statements
    are the text's.  One that does not parse is made twice as long, up to the whole rest.
    """
    at, line = 0, 0
    while True:
        width = piece
        while True:
            cut = _TOP.search(text, at + width) if at + width < len(text) else None
            end = cut.start() if cut else len(text)
            try:
                tree = ast.parse(text[at:end])
                break
            except (SyntaxError, ValueError):
                if end == len(text):
                    raise
                width = 2 * (end - at)
        yield tree, line
        if end == len(text):
            return
        at, line = end, line + text.count("\n", at, end)


def parse_python(text: str, piece: int = PIECE) -> dict:
    """Exact extraction through the standard parser, piece by piece; methods are functions here, as in the model's grammar."""
    text = text.replace("\r\n", "\n").replace("\r", "\n")  # the line ends of the parser, and no others
    rows = text.split("\n")
    symbols, imports, calls, heritage = [], [], [], []

    def dotted(node) -> str | None:
        return node.id if isinstance(node, ast.Name) else node.attr if isinstance(node, ast.Attribute) else None

    def visit(node, owner):
        for child in ast.iter_child_nodes(node):
            inside = owner
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                kind = "Class" if isinstance(child, ast.ClassDef) else "Function"
                symbols.append({"name": child.name, "kind": kind, "start_line": before + child.lineno, "end_line": before + child.end_lineno, "signature": rows[before + child.lineno - 1].strip()})
                inside = child.name
                for base in getattr(child, "bases", ()):
                    if name := dotted(base):
                        heritage.append({"child": child.name, "parent": name, "relation": "EXTENDS", "confidence": 1.0})
            elif isinstance(child, ast.Import):
                imports.extend({"module": a.name, "name": a.asname or "*", "line": before + child.lineno} for a in child.names)
            elif isinstance(child, ast.ImportFrom):
                imports.extend({"module": "." * child.level + (child.module or ""), "name": a.name, "line": before + child.lineno} for a in child.names)
            elif isinstance(child, ast.Call) and (name := dotted(child.func)):
                calls.append({"caller": owner, "callee": name, "line": before + child.lineno})
            visit(child, inside)

    for tree, before in _trees(text, piece):
        visit(tree, MODULE)
    return {"symbols": symbols, "imports": imports, "calls": calls, "heritage": heritage}


def parse_lines(text: str, language: str, parts=RELATIONS) -> dict:
    """Heuristic extraction by line patterns over what is code; a definition ends where its braces close.  Imports, heritage and calls are looked for only if ``parts`` names them."""
    text = text.replace("\r\n", "\n").removesuffix("\n")
    bare, code = (x.split("\n") for x in scan(text, language))  # strings matter to imports alone
    rows, shown = code, text.split("\n")
    symbols, imports, calls, heritage, seen = [], [], [], [], set()
    for k, row in enumerate(rows):
        for kind, pattern in _DEFINITIONS[language] if _ANY[language].match(row) else ():
            m = re.match(pattern, row)
            if m and m[1] not in _WORDS and (m[1], k) not in seen:
                seen.add((m[1], k))
                depth, opened, end = 0, False, k
                for j in range(k, len(rows)):
                    depth += rows[j].count("{") - rows[j].count("}")
                    opened |= "{" in rows[j]
                    end = j
                    if (opened and depth <= 0) or (not opened and rows[j].rstrip().endswith(";")):
                        break
                symbols.append({"name": m[1], "kind": kind, "start_line": k + 1, "end_line": end + 1, "signature": shown[k].strip()})
                break
        for pattern in _IMPORTS[language] if "imports" in parts else ():
            if m := re.match(pattern, bare[k]):
                imports.append({"module": m[2].strip("'\"`; "), "name": (m[1] or "").strip("{} ") or "*", "line": k + 1})
                break
        if "heritage" in parts and language in _PARENTS and (m := re.search(_PARENTS[language], row)):
            child, parents = (m[2], [m[1]]) if language == "rust" else (m[1], re.split(r"[, ]+", m[2]))
            relation, sure = _HERITAGE.get(language, ("EXTENDS", 0.5))
            heritage += [{"child": child, "parent": p, "relation": relation, "confidence": sure} for p in parents if p and p not in ("implements", "extends")]
    if "calls" not in parts:
        return {"symbols": symbols, "imports": imports, "calls": calls, "heritage": heritage}
    defined = {s["start_line"] for s in symbols}
    coming, around = sorted(range(len(symbols)), key=lambda n: -symbols[n]["start_line"]), []  # around: a heap of the spans begun, shortest first
    for k, row in enumerate(rows):
        while coming and symbols[coming[-1]]["start_line"] <= k + 1:
            n = coming.pop()
            heapq.heappush(around, (symbols[n]["end_line"] - symbols[n]["start_line"], n))
        while around and symbols[around[0][1]]["end_line"] < k + 1:
            heapq.heappop(around)
        if k + 1 in defined:
            continue
        for m in re.finditer(rf"{_NAME}!?\s*\(", row):
            if m[1] not in _WORDS:
                owner = symbols[around[0][1]]["name"] if around else MODULE
                calls.append({"caller": owner, "callee": m[1], "line": k + 1})
    return {"symbols": symbols, "imports": imports, "calls": calls, "heritage": heritage}


def parse_file(path: str, language: str, text: str, parts=RELATIONS) -> dict | None:
    """One parsed file, or None where the text does not parse or no parser knows the language; relations not among ``parts`` may be empty."""
    if language not in PARSERS:
        return None
    try:
        own = parse_python(text) if language == "python" else parse_lines(text, language, parts)
    except (SyntaxError, ValueError, RecursionError):
        return None
    return {"path": path, "language": language, "sloc": sum(1 for x in text.splitlines() if x.strip()), **own}


def parse_sources(files: DataFrame, parts=RELATIONS) -> DataFrame:
    """``files(path, language, content)`` -> parsed files, nested, with the relations named by ``parts``; what does not parse is left out."""

    own = StructType([f for f in StructType.fromDDL(PARSED) if f.name not in RELATIONS or f.name in parts])
    schema = to_arrow_schema(own)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for k in range(batch.num_rows):  # one file's relations are held at a time
                path, language, text = (batch.column(c)[k].as_py() for c in range(3))
                if text is not None and (parsed := parse_file(path, language, text, parts)):
                    yield pa.RecordBatch.from_pylist([parsed], schema=schema)

    return files.select("path", "language", "content").where("language is not null").mapInArrow(run, own)


def walk(spark: SparkSession, root: str, most_bytes: int = 20 << 20) -> DataFrame:
    """path (below ``root``), language, content, mtime, size of every known source file of a tree.  Spark's file sources pass over names that begin with '.' or '_'."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    home = root.removeprefix("file:").rstrip("/") + "/"
    path = F.regexp_replace(F.regexp_replace("path", "^file:/+", "/"), f"^\\Q{home}\\E", "")
    out = raw.where(F.col("length") <= most_bytes).select(path.alias("path"), F.col("modificationTime").alias("mtime"), F.col("length").alias("size"), "content")
    out = out.withColumn("language", language_of(F.col("path"))).where("language is not null")
    return out.withColumn("content", F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))).where("content is not null")


def flat(parsed: DataFrame, what: str) -> DataFrame:
    """One of symbols, imports, calls, heritage as rows with their path and language."""
    return parsed.select("path", "language", F.explode(what).alias("x")).select("path", "language", "x.*")


def source_slice(files: DataFrame, path: str, start: int = 1, end: int | None = None) -> DataFrame:
    """number, line, total of the lines start..end (from 1, both in) of one file."""
    from ..functions.text import lines

    rows = files.where(F.col("path") == path).select(F.posexplode(lines(F.col("content"))).alias("at", "line"), F.size(lines(F.col("content"))).alias("total"))
    out = rows.select((F.col("at") + 1).cast("long").alias("number"), "line", F.col("total").cast("long").alias("total"))
    return out.where((F.col("number") >= max(1, start)) & (F.col("number") <= (end if end is not None else F.col("total"))))
