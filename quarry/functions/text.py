"""Column functions on source text, names and labels; no Python runs on rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Whole words that each add one to complexity, and marks that add one for a line that has them.
BRANCH_WORDS = ("else", "elif", "match", "case", "for", "while", "try", "catch", "except")
BRANCH_MARKS = ("if", "&&", "||", "?")


def strip(x) -> Column:
    """Without white space at both ends, Unicode's included."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def lines(text) -> Column:
    """Lines without their ends; a final line end adds no empty line."""
    parts = F.split(text, "\r?\n", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)


def sloc(text, language) -> Column:
    """Lines of code: '#' comments for python and ruby, // and /* */ elsewhere."""
    rows = F.transform(lines(text), strip)
    hashed = F.size(F.filter(rows, lambda x: (x != "") & ~x.startswith("#")))

    def step(acc, x):
        opens = ~acc["inside"] & x.startswith("/*")
        closes = x.contains("*/")
        code = ~acc["inside"] & ~opens & (x != "") & ~x.startswith("//")
        return F.struct((acc["n"] + code.cast("int")).alias("n"), F.when(acc["inside"] | opens, ~closes).otherwise(F.lit(False)).alias("inside"))

    other = F.aggregate(rows, F.struct(F.lit(0).alias("n"), F.lit(False).alias("inside")), step, lambda acc: acc["n"])
    return F.when(language.isin("python", "ruby"), hashed).otherwise(other).cast("long")


def line_complexity(line) -> Column:
    """What a trimmed line adds: every mark that it holds once, and every branch word."""
    marks = sum((F.contains(line, F.lit(m)).cast("int") for m in BRANCH_MARKS), F.lit(0))
    return marks + F.size(F.filter(F.split(line, "[^\\p{L}\\p{N}_]+"), lambda w: w.isin(*BRANCH_WORDS)))


def complexity(text) -> Column:
    """1 + marks once for each line that holds them + every branch word."""
    return F.aggregate(F.transform(lines(text), strip), F.lit(1), lambda acc, x: acc + line_complexity(x)).cast("double")


def from_loc(loc) -> Column:
    return 1.0 + loc / 10.0


def name_tokens(name, extra: str = "", least: int = 2) -> Column:
    """Lower-case parts of an identifier: at _ - . (and ``extra``), at aB and at ABc; of ``least`` bytes at least."""
    split = F.regexp_replace(F.regexp_replace(name, r"(\p{Ll})(\p{Lu})", "$1_$2"), r"(\p{Lu})(\p{Lu}\p{Ll})", "$1_$2")
    return F.filter(F.transform(F.split(split, f"[_.{extra}-]"), F.lower), lambda t: F.octet_length(t) >= least)


def format_label(label) -> Column:
    """'cluster_user_api' -> 'User Api'; letters after the first stay."""
    words = F.split(F.replace(F.replace(label, F.lit("cluster_")), F.lit("_"), F.lit(" ")), " ")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))), " ")


def ancestors(path) -> Column:
    """Every directory above a path, outermost first."""
    steps = F.split(path, "/")
    return F.when(F.size(steps) > 1, F.transform(F.sequence(F.lit(1), F.size(steps) - 1), lambda k: F.array_join(F.slice(steps, F.lit(1), k), "/"))).otherwise(F.array().cast("array<string>"))


def snippet(text, query, around: int = 20) -> Column:
    """The surroundings of the earliest query word, '...' at cut ends; the first 40 characters without a match."""
    low = F.lower(text)
    places = F.filter(F.transform(F.split(strip(F.lower(query)), "\\s+"), lambda w: F.struct(F.call_function("locate", w, low).alias("at"), F.length(w).alias("n"))), lambda p: p["at"] > 0)
    hit = F.array_min(places)
    a, b = F.greatest(hit["at"] - 1 - around, F.lit(0)), F.least(hit["at"] - 1 + hit["n"] + around, F.length(text))
    shown = F.concat(F.when(a > 0, "...").otherwise(""), F.substring(text, a + 1, b - a), F.when(b < F.length(text), "...").otherwise(""))
    return F.when(F.size(places) > 0, shown).otherwise(F.concat(F.substring(text, 1, 40), F.when(F.length(text) > 40, "...").otherwise("")))


def mermaid_id(x) -> Column:
    clean = F.regexp_replace(x, "[^A-Za-z0-9_]", "_")
    return F.when(clean.rlike("^[A-Za-z]"), clean).otherwise(F.concat(F.lit("n"), clean))


def mermaid_label(x) -> Column:
    """At most 60 characters, with entities for what the syntax would read."""
    out = F.when(F.length(x) > 60, F.concat(F.substring(x, 1, 57), F.lit("..."))).otherwise(x)
    for a, b in (("&", "&amp;"), ('"', "&quot;"), ("<", "&lt;"), (">", "&gt;"), ("(", "&#40;"), (")", "&#41;"), ("[", "&#91;"), ("]", "&#93;"), ("{", "&#123;"), ("}", "&#125;"), ("\r", ""), ("\n", " ")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def language_of(path) -> Column:
    """Language by lower-cased extension, or null."""
    known = {"py": "python", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "rs": "rust", "go": "go", "java": "java", "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "cs": "csharp", "rb": "ruby", "php": "php", "swift": "swift", "kt": "kotlin", "kts": "kotlin"}  # fixed values
    table = F.create_map(*[F.lit(v) for kv in known.items() for v in kv])
    return F.try_element_at(table, F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)))


#: Colours by language, difficulty and kind of node, and for all else: fixed values.
COLORS = {"rust": "#dea584", "python": "#3572A5", "typescript": "#3178c6", "javascript": "#f1e05a", "go": "#00ADD8", "java": "#b07219", "c": "#555555", "cpp": "#f34b7d", "csharp": "#178600", "ruby": "#701516", "php": "#4F5D95", "swift": "#F05138", "kotlin": "#A97BFF"}
OTHER_COLOR = "#8b949e"


def language_color(language) -> Column:
    """A language's colour, in any letter case."""
    table = F.create_map(*[F.lit(x) for kv in COLORS.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.lower(language)), F.lit(OTHER_COLOR))
