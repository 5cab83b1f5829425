"""Corpus-wide line deduplication by deletion neighbourhoods, in DataFrame functions only.

Lines are compared in a normal form (A-Z lower-cased, runs of ASCII white space one
space, trimmed).  A line goes if an equal line stands earlier in the corpus; one of at least ``MIN_CHARS``
characters also if another of that length within one edit (a character put in, taken out or replaced) does.
Blank lines stay.  The order is (doc_id, row hash, line number); null ids come first.

Two lines within one edit share all characters before the edit and all after it.  Keys are
hashes of a line without a stretch that may hold the edit, in three steps, each only
for lines that met another one in the step before:

1. half the line: what is left is its first or its last half;
2. a stretch of some 1/16 of the line, at every place;
3. one character or none, at every place of a stretch that met: the deletion variants.

Keys of steps 2 and 3 are put together from hashes of beginnings and ends that are taken once a line or stretch,
so a variant reads some square root of its stretch and not the whole line.
Lines travel as hashes; only those that met in step 1 are read again from their texts.

All lines with one variant at one place are within one edit of each other, so each is
compared with the earliest of them, and no pair of a group is needed besides.  A pair that shares
many variants is compared once, by what lies on the two sides of the edit.
"""

from __future__ import annotations

import functools
import operator
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace

#: Lines of fewer characters are compared as they are: one edit makes another word of a short one.
MIN_CHARS = 24


#: White space within a line that is not just one space.
_GAP = "\\x20*[\\x09\\x0B-\\x0D][\\x20\\x09\\x0B-\\x0D]*|\\x20{2,}"


def _spaced(text: Column) -> Column:
    """A whole text with single spaces in its lines; texts without a gap, found on bytes, meet no pattern."""
    gaps = functools.reduce(operator.or_, [F.contains(text, F.lit(c)) for c in ("  ", "\t", "\x0b", "\x0c", "\r")])
    return F.when(gaps, F.regexp_replace(text, _GAP, " ")).otherwise(text)


def _folded(text: Column) -> Column:
    """A-Z lower-cased and nothing else; ``lower`` does just that to ASCII and is far cheaper than ``translate``."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def _normal(text: Column) -> Column:
    """Array of a text's lines in normal form but for the spaces at their ends; the work is done once a text."""
    return F.split(_folded(_spaced(text)), "\n", -1)


def _class(n: str) -> str:
    """Length of the stretches of step 2: a power of two, n / 16 .. n / 32."""
    return f"cast(shiftleft(1, greatest(0, cast(floor(log2({n})) as int) - 4)) as int)"


#: Step 1: hashes of the first and last half, as the shorter or equal line (n) and as the longer one (n - 1); one of the four is double.
_HALVES = """if(n % 2 = 0,
  array(xxhash64('f', n div 2, left(norm, n div 2)), xxhash64('f', n div 2 - 1, left(norm, n div 2 - 1)), xxhash64('l', n div 2, right(norm, n div 2))),
  array(xxhash64('f', n div 2, left(norm, n div 2)), xxhash64('l', n div 2, right(norm, n div 2)), xxhash64('l', n div 2 + 1, right(norm, n div 2 + 1))))"""

#: Step 2: c, and the hashes of all beginnings and ends of whole stretches, for the line as the shorter and as the longer one.
_ENDS = f"""transform(array_distinct(array({_class("n")}, {_class("n - 1")})), c -> named_struct('c', c,
  'least', (n + if({_class("n - 1")} = c, c - 1, c)) div c - 2, 'most', if({_class("n")} = c, n, n - 1) div c,
  'heads', transform(sequence(0, n div c), i -> xxhash64(left(norm, i * c))),
  'tails', transform(sequence(0, n div c), i -> xxhash64(right(norm, i * c)))))"""
#: What is kept is i stretches before and t - i after; which t are needed follows from where an edit can be.
_PLACES = """flatten(transform(ends, p -> flatten(transform(sequence(greatest(0, p.least), p.most),
  t -> transform(sequence(0, t), i -> named_struct('c', p.c, 'a', i * p.c, 'z', n - (t - i) * p.c,
    'key', xxhash64(p.c, t, i, p.heads[i], p.tails[t - i])))))))"""

#: Step 3, on the middle between a place's beginning and end: its pieces of s characters from either side, and hashes of what lies beyond them ...
_STEPS = """array(
  transform(sequence(0, m div s), k -> named_struct('h', xxhash64(left(middle, k * s)), 'own', substring(middle, k * s + 1, s))),
  transform(sequence(0, m div s), k -> named_struct('h', xxhash64(right(middle, k * s)), 'own', right(left(middle, m - k * s), s))))"""
#: ... the line without character x, and the whole line as one into which a character may be put at x: what is left of x, what is right of it.
_VARIANTS = """concat(
  if(m = 0, array(), transform(sequence(1, m), x -> named_struct('p', x - 1, 'd', 1, 'key', xxhash64(key, x, e[0][(x - 1) div s].h, left(e[0][(x - 1) div s].own, (x - 1) % s), e[1][(m - x) div s].h, right(e[1][(m - x) div s].own, (m - x) % s))))),
  transform(sequence(1, m + 1), x -> named_struct('p', x - 1, 'd', 0, 'key', xxhash64(key, x, e[0][(x - 1) div s].h, left(e[0][(x - 1) div s].own, (x - 1) % s), e[1][(m - x + 1) div s].h, right(e[1][(m - x + 1) div s].own, (m - x + 1) % s)))))"""


def _rows(docs: DataFrame) -> DataFrame:
    """A row is known by its doc_id and a hash of it and the text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("rid"), "text")


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, rid, line and norm of every line that is not blank."""
    flat = _rows(docs).select("doc_id", "rid", F.posexplode(_normal(F.col("text"))).alias("line", "raw"))
    return flat.select("doc_id", "rid", "line", F.trim("raw").alias("norm")).where("norm <> ''")


def _met(keyed: DataFrame) -> DataFrame:
    """Rows of ``keyed`` whose key another line has too."""
    shared = keyed.groupBy("key").agg(F.min("h1").alias("x"), F.max("h1").alias("y")).where("x <> y").select("key")
    return keyed.join(shared, "key", "left_semi")


def _again(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """h1, h2, first, norm, n of distinct lines, read from the texts in which they stand first."""
    places = asked.groupBy(F.col("first.doc_id").alias("_doc"), F.col("first.rid").alias("_rid")).agg(F.collect_list(F.struct("first", "h1", "h2")).alias("asked"))
    texts = _rows(docs)
    texts = texts.join(places, texts["doc_id"].eqNullSafe(places["_doc"]) & (texts["rid"] == places["_rid"])).select(_normal(F.col("text")).alias("ls"), "asked")
    found = texts.select("ls", F.explode("asked").alias("x")).select("x.h1", "x.h2", "x.first", F.trim(F.get("ls", F.col("x.first.line"))).alias("norm"))
    return found.dropDuplicates(["h1", "h2"]).withColumn("n", F.length("norm"))


def first_lines(docs: DataFrame, space: Workspace, least: int = MIN_CHARS, near: bool = True) -> DataFrame:
    """h1, h2 (hashes of a distinct line) and ``first`` (doc_id, rid, line) of those lines that are kept."""
    place = F.struct("doc_id", "rid", "line")
    each = _lines(docs).select("doc_id", "rid", "line", "norm", F.length("norm").alias("n"))
    each = each.select(F.xxhash64("norm").alias("h1"), F.xxhash64(F.lit("second"), "norm").alias("h2"), place.alias("place"), *([F.when(F.col("n") >= least, F.expr(_HALVES)).alias("halves")] if near else []))
    distinct = each.groupBy("h1", "h2").agg(F.min("place").alias("first"), *([F.first("halves").alias("halves")] if near else []))
    distinct = space.table(distinct, "distinct")
    firsts = distinct.select("h1", "h2", "first")
    if not near:
        return firsts
    met = _met(distinct.select("h1", "h2", F.explode("halves").alias("key"))).select("h1", "h2").distinct()
    lines = space.table(_again(docs, firsts.join(met, ["h1", "h2"], "left_semi")), "near")
    placed = lines.select("h1", "h2", "n", F.expr(_ENDS).alias("ends")).select("h1", "h2", F.explode(F.expr(_PLACES)).alias("p")).select("h1", "h2", "p.*")
    where = _met(space.table(placed, "places"))
    middle = F.expr("substring(norm, a + 1, z - a)")
    s = F.expr("cast(shiftleft(1, (cast(log2(c) as int) + 1) div 2) as int)")
    parts = lines.join(where, ["h1", "h2"]).select("h1", "h2", "key", "a", middle.alias("middle"), F.length(middle).alias("m"), s.alias("s")).withColumn("e", F.expr(_STEPS))
    variants = parts.select("h1", "h2", "a", F.explode(F.expr(_VARIANTS)).alias("v")).select("h1", "h2", "v.key", (F.col("a") + F.col("v.p")).alias("p"), "v.d")
    shared = space.table(_met(space.table(variants, "variants")), "shared")
    full = shared.join(lines.select("h1", "h2", "first"), ["h1", "h2"]).select("key", F.struct("first", "h1", "h2", "p", "d").alias("own"))
    earliest = full.groupBy("key").agg(F.min("own").alias("e"))
    pairs = full.join(earliest, "key").where("e.first < own.first")
    pairs = pairs.groupBy("own.h1", "own.h2", F.col("e.h1").alias("e1"), F.col("e.h2").alias("e2")).agg(F.min(F.struct("own.p", "own.d", F.col("e.p").alias("ep"), F.col("e.d").alias("ed"))).alias("at"))
    pairs = space.table(pairs, "pairs").join(lines.select("h1", "h2", "norm", "n"), ["h1", "h2"])
    pairs = pairs.join(lines.select(F.col("h1").alias("e1"), F.col("h2").alias("e2"), F.col("norm").alias("other"), F.col("n").alias("m")), ["e1", "e2"])
    # the two sides of one edit, compared as they are, verify an edit distance of one at most in one pass over the lines
    alike = "left(norm, at.p) = left(other, at.ep) and right(norm, n - at.p - at.d) = right(other, m - at.ep - at.ed)"
    gone = pairs.where(alike).select("h1", "h2").distinct()
    gone = space.table(gone, "gone")
    space.keep_only("distinct", "gone")
    return firsts.join(gone, ["h1", "h2"], "left_anti")


def _cut(docs: DataFrame, least: int, near: bool) -> DataFrame:
    """row (all columns of ``docs``), text (its kept lines), n_lines and n_removed of every row."""
    space = Workspace(docs.sparkSession, "line-dedup")
    kept = first_lines(docs, space, least, near)
    own = space.table(kept.groupBy(F.col("first.doc_id").alias("doc"), F.col("first.rid").alias("kept_rid")).agg(F.collect_set("first.line").alias("kept")), "kept")
    space.keep_only("kept")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.xxhash64("doc_id", "text").alias("rid"), F.col("doc_id").cast("long").alias("id"))
    rows = rows.join(own, (F.col("rid") == F.col("kept_rid")) & F.col("id").eqNullSafe(F.col("doc")), "left")
    rows = rows.withColumn("lines", F.split("row.text", "\n", -1)).withColumn("spaced", F.split(_spaced(F.col("row.text")), "\n", -1))
    none = F.array().cast("array<int>")
    full = F.filter(F.transform("spaced", lambda x, i: F.when(F.trim(x) != "", i).otherwise(-1)), lambda i: i >= 0)
    rows = rows.withColumn("full", F.coalesce(full, none)).withColumn("kept", F.coalesce("kept", none))
    rows = rows.withColumn("gone", F.when(F.size("full") == F.size("kept"), none).otherwise(F.array_except("full", "kept")))
    left = "array_join(transform(array_except(sequence(0, size(lines) - 1), gone), i -> lines[i]), '\n')"
    text = F.when(F.size("gone") == 0, F.col("row.text")).otherwise(F.expr(left))
    return rows.select("row", text.alias("text"), F.greatest(F.coalesce(F.size("lines"), F.lit(0)), F.lit(0)).cast("long").alias("n_lines"), F.size("gone").cast("long").alias("n_removed"))


def dedup_lines(docs: DataFrame, least: int = MIN_CHARS, near: bool = True, counts: tuple[str, str] = ("n_lines", "n_removed")) -> DataFrame:
    """``docs`` with ``text`` cut down to its kept lines, and how many lines it had and lost (columns ``counts``).

    A null text stays null (no lines); an empty text has one, blank line, and blank lines stay.  Lines below ``least``
    characters go only where an equal one stands earlier.  A very long text or line is taken whole; a line's cost grows a little faster than its length.
    Of equal lines the one of the least (doc_id, row hash, line number) stays.  Rows alike in doc_id and text are one document: they
    keep the same lines.  All columns of ``docs`` come back, whatever their names, but those named as ``counts`` say are replaced.
    An empty table gives no rows.
    """
    cut = _cut(docs, least, near)
    keep = [F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns if c not in counts]
    return cut.select(*keep, F.col("n_lines").alias(counts[0]), F.col("n_removed").alias(counts[1]))


def documents_with_lines(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with their kept lines; a row that lost lines and has no word left goes.  The columns are those of ``docs``,
    whatever their names; ``n_chars``, where there is one, follows the text."""
    cut = _cut(docs, MIN_CHARS, True).where((F.col("n_removed") == 0) | F.col("text").rlike("[^\\x20\\x09-\\x0D]"))
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return cut.select([new[c] if c in new else F.col("row")[c].alias(c) for c in docs.columns])


SQL = r"""
WITH d AS (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS raw, unnest(range(0, len(string_split(text, chr(10))))) AS line FROM d),
n AS (SELECT *, translate(trim(regexp_replace(raw, '[\x20\x09-\x0D]+', ' ', 'g'), ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM l),
e AS (SELECT norm, length(norm) AS z, min((doc_id, line)) AS first FROM n WHERE norm <> '' GROUP BY norm),
k AS (
  SELECT DISTINCT norm, z, first, unnest([
    'f' || left(norm, z // 2), 'f' || left(norm, (z - 1) // 2),
    'l' || right(norm, z - z // 2), 'l' || right(norm, z - 1 - (z - 1) // 2)]) AS key FROM e WHERE z >= 24),
c AS (SELECT DISTINCT a.norm AS a, b.norm AS b, a.z AS za, b.z AS zb FROM k a JOIN k b ON a.key = b.key AND a.norm <> b.norm AND abs(a.z - b.z) <= 1 AND b.first < a.first),
g AS (SELECT DISTINCT a AS norm FROM c WHERE
  CASE WHEN za = zb THEN len(list_filter(range(0, za), lambda x: left(a, x) = left(b, x) AND right(a, za - x - 1) = right(b, za - x - 1))) > 0
       WHEN za < zb THEN len(list_filter(range(0, zb), lambda x: left(a, x) = left(b, x) AND right(a, za - x) = right(b, za - x))) > 0
       ELSE len(list_filter(range(0, za), lambda x: left(a, x) = left(b, x) AND right(a, zb - x) = right(b, zb - x))) > 0 END),
s AS (
  SELECT n.doc_id, n.text, n.line, n.raw,
    n.norm = '' OR (e.first = (n.doc_id, n.line) AND g.norm IS NULL) AS stays
  FROM n LEFT JOIN e USING (norm) LEFT JOIN g USING (norm)),
r AS (
  SELECT doc_id, text, count(*) AS n_lines, count(*) FILTER (NOT stays) AS n_removed,
    coalesce(string_agg(raw, chr(10) ORDER BY line) FILTER (stays), '') AS kept FROM s GROUP BY doc_id, text)
SELECT documents.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(kept) AS kept_sha256
FROM documents LEFT JOIN r ON documents.doc_id IS NOT DISTINCT FROM r.doc_id AND documents.text = r.text
"""
