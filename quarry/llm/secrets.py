"""Secret scan through a trigram inverted index, in DataFrame functions only.

From each rule's pattern a Boolean trigram query is derived: alternatives (OR) of trigrams that must
all occur (AND).  Postings of the queried trigrams are kept in blocks of documents;
a rule's postings are intersected block by block, and only documents that
pass are matched against the pattern.  A rule without mandatory trigrams is matched
against every document.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace, row_id

#: Documents of one posting block.
BLOCK = 4096


@dataclass(frozen=True)
class Rule:
    name: str
    pattern: str  # for Java; no look-around, so that a match can be found again by its text
    group: int = 0  # group whose length counts
    least: int = 1  # characters of that group


BASE = (
    Rule("assign", r"""((?i)password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    # the longest run from its first place on is what a plain + would match, and no shorter one is kept
    Rule("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)
MORE = (
    Rule("github", r"gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abps]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private_key", r"-----BEGIN [A-Z\x20]*PRIVATE KEY-----"),
)
RULES = BASE + MORE


def trigram_query(pattern: str, most: int = 64) -> list[frozenset[str]] | None:
    """Alternatives of lower-case trigrams; every match holds all trigrams of one of them.  None: no such query.

    Walks the parsed pattern and keeps, for each way through it, the literal runs that are certain.
    """
    from re import _constants as c
    from re import _parser

    def both(heads, tails):
        # a way is a tuple of runs; "" between runs marks a gap, and the outer runs may grow
        return [(*a[:-1], a[-1] + b[0], *b[1:]) for a in heads for b in tails]

    def walk(items) -> list[tuple[str, ...]]:
        ways = [("",)]
        for op, arg in items:
            if op is c.LITERAL:
                more = [(chr(arg).lower(),)]
            elif op is c.SUBPATTERN:
                more = walk(arg[-1])
            elif op is c.BRANCH:
                more = [w for branch in arg[1] for w in walk(branch)]
            elif op is c.IN and all(kind is c.LITERAL for kind, _ in arg) and len(arg) <= 4:
                more = [(chr(x).lower(),) for _, x in arg]
            elif op in (c.MAX_REPEAT, c.MIN_REPEAT) and arg[0] <= 1 and arg[1] == 1:
                more = walk(arg[2]) + ([("",)] if arg[0] == 0 else [])
            elif op in (c.MAX_REPEAT, c.MIN_REPEAT) and arg[0] >= 1:
                more = both(walk(arg[2]), [("", "")])  # the first turn is certain, then a gap
            else:
                more = [("", "")]
            if len(ways) * len(more) > most:  # too many ways: what this item adds is given up
                more = [("", "")]
            ways = both(ways, more)
        return ways

    ways = walk(_parser.parse(pattern.replace("((?i)", "(?i:").replace("\\x20", " ")))
    queries = {frozenset(run[k : k + 3] for run in way for k in range(len(run) - 2)) for way in ways}
    least = {q for q in queries if not any(other < q for other in queries)}  # the rest is implied
    return None if frozenset() in queries else sorted(least, key=sorted)


_NONE = "cast(array() as array<struct<start: int, kind: string, end: int>>)"
#: Matches are summed up in chunks of so many, so that places cost little more than one step a match.
CHUNK = 128


def spans(rule: Rule, text: Column) -> Column:
    """array<struct<start, kind, end>> of a rule's leftmost matches, in code points, end exclusive.

    A match begins after all matches and all gaps (what the pattern splits the text into) before it.
    """

    def placed(found):
        gaps = F.split(text, rule.pattern, -1)
        size = lambda m: F.length(F.regexp_extract(m, rule.pattern, rule.group)) if rule.group else F.length(m)
        items = F.zip_with(found, F.slice(gaps, F.lit(1), F.size(found)), lambda m, g: F.struct(F.length(g).alias("gap"), F.length(m).alias("n"), size(m).alias("size")))
        chunks = F.transform(F.array(items), lambda x: F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / CHUNK).cast("int")), lambda c: F.slice(x, c * CHUNK + 1, F.lit(CHUNK))))[0]

        def run(chunk, at):
            def step(acc, m):
                start = acc["at"] + m["gap"]
                own = F.struct(start.alias("start"), F.when(m["size"] >= rule.least, F.lit(rule.name)).alias("kind"), (start + m["n"]).alias("end"))
                return F.struct((start + m["n"]).alias("at"), F.array_append(acc["out"], own).alias("out"))

            return F.aggregate(chunk, F.struct(at.alias("at"), F.expr(_NONE).alias("out")), step, lambda acc: acc["out"])

        def all_(parts):
            total = F.transform(parts, lambda ch: F.aggregate(ch, F.lit(0), lambda n, m: n + m["gap"] + m["n"]))
            zero = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("out"))
            begins = F.aggregate(total, zero, lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")), lambda acc: acc["out"])
            return F.flatten(F.zip_with(parts, begins, run))

        return F.filter(F.transform(F.array(chunks), all_)[0], lambda s: s["kind"].isNotNull())

    # a one-element array binds the matches, so they are sought once
    return F.transform(F.array(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))), lambda found: F.when(F.size(found) > 0, placed(found)).otherwise(F.expr(_NONE)))[0]


def secret_scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, block: int = BLOCK) -> DataFrame:
    """doc_id and ``spans`` (sorted by start, then by the rules' order) of every row.

    A null or empty text has no spans; a very long text is scanned whole, in time that grows little faster than its length; spans of
    different rules may overlap or start together (then in the rules' order); repeated rows are scanned once and returned
    each; an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    space = Workspace(spark, "secrets")
    asked = {r.name: trigram_query(r.pattern) for r in rules}
    grams = sorted({g for q in asked.values() if q for way in q for g in way})
    rows = docs.select(row_id("doc_id", "text").alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    low = rows.withColumn("low", F.lower("text"))
    held = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(g)), F.lit(g)) for g in grams])) if grams else F.array().cast("array<string>")
    full = [spans(r, F.col("text")) for r in rules if asked[r.name] is None]
    scanned = space.table(low.select("rid", "doc_id", held.alias("grams"), (F.concat(*full) if full else F.expr(_NONE)).alias("full")), "scanned")

    blocks = max(1, -(-scanned.count() // block))
    posted = scanned.select(F.pmod("rid.x", F.lit(blocks)).alias("block"), "rid", F.explode("grams").alias("gram"))
    index = space.table(posted.groupBy("block", "gram").agg(F.collect_set("rid").alias("rids")), "index")
    asks = [(r.name, k, len(way), g) for r in rules if asked[r.name] for k, way in enumerate(asked[r.name]) for g in sorted(way)]
    if asks:
        wanted = spark.createDataFrame(asks, "kind string, way int, needs int, gram string")  # a few dozen rows: the rules
        ways = index.join(F.broadcast(wanted), "gram").groupBy("block", "kind", "way").agg(F.collect_list("rids").alias("lists"), F.first("needs").alias("needs"))
        ways = ways.where("size(lists) = needs").select("kind", F.expr("aggregate(slice(lists, 2, size(lists)), lists[0], (a, b) -> array_intersect(a, b))").alias("rids"))
        candidates = ways.select("kind", F.explode("rids").alias("rid")).groupBy("rid").agg(F.collect_set("kind").alias("kinds"))
        text = F.col("text")
        each = [F.when(F.array_contains("kinds", r.name), spans(r, text)).otherwise(F.expr(_NONE)) for r in rules if asked[r.name]]
        verified = rows.select("rid", "text").join(candidates, "rid").select("rid", F.concat(*each).alias("more"))
        verified = space.table(verified.where("size(more) > 0").dropDuplicates(["rid"]), "verified")
    else:
        verified = scanned.select("rid", F.col("full").alias("more")).limit(0)
    order = F.create_map(*[x for k, r in enumerate(rules) for x in (F.lit(r.name), F.lit(k))])
    out = scanned.join(verified, "rid", "left").select("doc_id", F.concat("full", F.coalesce("more", F.expr(_NONE))).alias("all"))
    ranked = F.sort_array(F.transform("all", lambda s: F.struct(s["start"].alias("start"), order[s["kind"]].alias("rank"), s["kind"].alias("kind"), s["end"].alias("end"))))
    return out.select("doc_id", ranked.alias("spans"))


def listing(column: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(text: Column, found: Column, mask: str = "[secret]") -> Column:
    """The text with every span (sorted by start) replaced by ``mask``; overlapping spans merge."""
    step = lambda acc, s: F.struct(
        F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mask))).otherwise(acc["out"]).alias("out"),
        F.greatest(acc["at"], s["end"]).alias("at"),
    )
    zero = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    return F.aggregate(found, zero, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


def _sql_kind(rule: Rule) -> str:
    pattern = rule.pattern.replace("'", "''").replace("((?i)", "((?i:").replace("api_?key)", "api_?key))")
    size = f"length(regexp_extract(ms[k], '{pattern}', {rule.group}))" if rule.group else "length(ms[k])"
    return f"""SELECT rid, '{rule.name}' AS kind, s AS start, s + length(ms[k]) AS stop FROM (
  SELECT rid, ms, k, {size} AS z,
    CAST(coalesce(list_sum(list_transform(ps[1:k], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(ms[1:k - 1], lambda x: length(x))), 0) AS BIGINT) AS s
  FROM (SELECT rid, ms, ps, unnest(range(1, len(ms) + 1)) AS k
        FROM (SELECT rid, regexp_extract_all(t, '{pattern}', 0) AS ms, regexp_split_to_array(t, '{pattern}') AS ps FROM d)))
WHERE z >= {rule.least}"""


SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
s AS ({" UNION ALL ".join(_sql_kind(r) for r in RULES)}),
o AS (SELECT *, list_position([{", ".join(repr(r.name) for r in RULES)}], kind) AS rank, kind || ':' || start || ':' || stop AS name FROM s),
a AS (SELECT rid, count(*) FILTER (kind = 'assign') AS na, count(*) FILTER (kind = 'access') AS nc, count(*) FILTER (kind = 'hex') AS nh,
  string_agg(name, ',' ORDER BY start, rank) FILTER (kind IN ('assign', 'access', 'hex')) AS base, string_agg(name, ',' ORDER BY start, rank) AS spans FROM o GROUP BY rid)
SELECT doc_id, coalesce(na, 0) AS n_assign, coalesce(nc, 0) AS n_access, coalesce(nh, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (rid)
"""
