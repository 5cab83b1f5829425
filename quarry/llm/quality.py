"""Quality rules with host-level verdicts, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace

#: A host table of at most so many rows (tens of bytes each) is broadcast; a larger one is joined by shuffle.
HOSTS_TO_BROADCAST = 100_000
MIN_WORDS, REPEAT_PERCENT = 50, 50
COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
_GAP = "[\\x20\\x09-\\x0D]+"


def annotate(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` of ``docs`` and the base measures of each text (null counts as empty).

    A word is a run without ASCII white space.  Repeated 3-word windows are found by
    sorting the windows' hashes within the row, so no row leaves its task.
    Columns of ``docs`` that are named like a measure must not be in ``keep``.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    one = docs.select(
        *keep,
        F.array_remove(F.split(t, _GAP, -1), "").alias("_q_words"),
        F.length(F.regexp_replace(t, _GAP, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(t, "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        lines.alias("_q_lines"),
    )
    two = one.select(
        *keep,
        F.size("_q_words").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        (F.size("_q_lines") - F.size(F.array_distinct("_q_lines"))).cast("long").alias("n_dup_lines"),
        F.transform("_q_words", lambda w: F.xxhash64(w)).alias("_q_hash"),
    )
    windows = F.expr("transform(slice(_q_hash, 1, greatest(size(_q_hash) - 2, 0)), (w, i) -> struct(xxhash64(w, get(_q_hash, i + 1), get(_q_hash, i + 2)) as h, i as i))")
    rest = ["n_words", "word_chars", "n_symbols", "n_dup_lines"]
    three = two.select(*keep, *rest, F.sort_array(windows).alias("_q_grams"))
    again = F.expr("sort_array(transform(filter(_q_grams, (x, j) -> x.h = get(_q_grams, j - 1).h or x.h = get(_q_grams, j + 1).h), x -> x.i))")
    four = three.select(*keep, *rest, again.alias("_q_again"))
    covered = F.expr("aggregate(transform(_q_again, (p, k) -> least(3, coalesce(get(_q_again, k + 1) - p, 3))), 0L, (a, x) -> a + x)")
    five = four.select(*keep, *rest, covered.alias("n_repeat_words"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return five.withColumn("base_failed", failed)


def host_verdicts(measured: DataFrame, host: str = "source", threshold: float = 0.5) -> DataFrame:
    """host, n_docs, n_failed, rate, host_ok of each host; a null host is one host.

    The prior is a beta distribution fitted to the hosts' raw rates by moments: mean m,
    strength m(1 - m)/v - 1 held between 1 and 1e6 (no variance: 1e6).  A host's rate is
    shrunk to (failed + m * strength) / (docs + strength); above ``threshold`` its documents go.
    """
    hosts = measured.groupBy(F.col(host).alias("host")).agg(F.count(F.lit(1)).alias("n_docs"), F.count_if("base_failed").alias("n_failed"))
    raw = F.col("n_failed") / F.col("n_docs")
    prior = hosts.agg(F.avg(raw).alias("m"), F.var_pop(raw).alias("v"))
    prior = prior.select("m", F.coalesce(F.greatest(F.lit(1.0), F.least(F.lit(1e6), F.expr("try_divide(m * (1 - m), v)") - 1)), F.lit(1e6)).alias("strength"))
    rate = (F.col("n_failed") + F.col("m") * F.col("strength")) / (F.col("n_docs") + F.col("strength"))
    return hosts.crossJoin(F.broadcast(prior)).select("host", "n_docs", "n_failed", rate.alias("rate"), (rate <= threshold).alias("host_ok"))  # prior is one row


def judge(measured: DataFrame, space: Workspace, host: str = "source", threshold: float = 0.5) -> DataFrame:
    """``measured`` (a written table) with ``host_rate`` and ``kept``."""
    hosts = space.table(host_verdicts(measured, host, threshold), "hosts").select("host", F.col("rate").alias("host_rate"), "host_ok")
    if hosts.count() <= HOSTS_TO_BROADCAST:
        hosts = F.broadcast(hosts)
    joined = measured.join(hosts, measured[host].eqNullSafe(hosts["host"]), "left") if host in measured.columns else measured
    return joined.drop("host").withColumn("kept", ~F.col("base_failed") & F.col("host_ok")).drop("host_ok")


def quality_rules(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, source, the base measures, host_rate and kept of every row.

    A row is kept if it passes the base rules and its host's shrunken failure rate is not
    above ``threshold``.  A null, empty or blank text has no words and fails; a very long text is judged whole;
    repeated rows are judged each; there is nothing to tie;
    an empty table gives no rows; other columns are ignored.
    """
    space = Workspace(docs.sparkSession, "quality")
    measured = space.table(annotate(docs, ["doc_id", "source"]), "measured")
    return judge(measured, space, "source", threshold)


def keep_documents(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns."""
    space = Workspace(docs.sparkSession, "quality")
    row = docs.select(F.struct(*docs.columns).alias("_q_row"), F.col("text").alias("_q_text"), F.col("source").alias("_q_host"))
    measured = space.table(annotate(row, ["_q_row", "_q_host"], "_q_text"), "measured")
    return judge(measured, space, "_q_host", threshold).where("kept").select("_q_row.*")


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT rid, doc_id, source, t,
    list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM d),
g AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
c AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM g),
r AS (SELECT rid, count(DISTINCT p) AS n_repeat_words FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM c WHERE n > 1) GROUP BY rid),
m AS (
  SELECT doc_id, source, CAST(len(ws) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN r USING (rid)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
h AS (SELECT source, count(*) AS n, count(*) FILTER (base_failed) AS k FROM b GROUP BY source),
p AS (SELECT avg(k / n) AS m, var_pop(k / n) AS v FROM h),
q AS (SELECT m, CASE WHEN v > 0 THEN greatest(1.0, least(1e6, m * (1 - m) / v - 1)) ELSE 1e6 END AS s FROM p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND (h.k + q.m * q.s) / (h.n + q.s) <= 0.5 AS kept
FROM b JOIN h ON b.source IS NOT DISTINCT FROM h.source CROSS JOIN q
"""
