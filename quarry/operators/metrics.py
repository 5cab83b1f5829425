"""Metrics of files, symbols, communities and the whole corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.text import name_tokens
from . import spans


def file_fan_in(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """file_id, fan_in: edges of every kind into the file's symbols."""
    into = edges.groupBy(F.col("target_id").alias("symbol_id")).count()
    return symbols.select("symbol_id", "file_id").join(into, "symbol_id", "left").groupBy("file_id").agg(F.sum(F.coalesce("count", F.lit(0))).alias("fan_in"))


def churn(commits: DataFrame, latest: int = 1000) -> DataFrame:
    """path, churn, contributors over the ``latest`` commits (ts, then commit_id, newest first)."""
    newest = commits.select("commit_id", "ts").distinct().orderBy(F.desc("ts"), F.desc("commit_id")).limit(latest).select("commit_id")
    return commits.join(newest, "commit_id", "left_semi").groupBy("path").agg(F.count(F.lit(1)).alias("churn"), F.count_distinct("author").alias("contributors"))


def symbol_complexity(texts: DataFrame, symbols: DataFrame) -> DataFrame:
    """``symbols(symbol_id, path, start_line, end_line, ...)`` with the complexity of their lines in ``texts(path, content)``.

    Lines that add nothing are left out before they meet the spans that hold them.  A symbol whose file has no text is judged by its length.
    """
    rows = texts.where("content is not null").select("path", F.posexplode(T.lines(F.col("content"))).alias("k", "line"))
    rows = rows.select("path", (F.col("k") + 1).cast("long").alias("at"), T.line_complexity(T.strip(F.col("line"))).alias("n")).where("n > 0")
    held = spans.containing(rows, symbols.select("path", F.col("start_line").alias("lo"), F.col("end_line").alias("hi"), "symbol_id"))
    sums = held.groupBy("symbol_id").agg(F.sum("n").alias("_q_n"))
    read = texts.where("content is not null").select("path", F.lit(True).alias("_q_read")).distinct()
    loc = F.greatest(F.col("end_line") - F.greatest(F.col("start_line") - 1, F.lit(0)), F.lit(0))
    own = F.when(F.col("_q_read"), 1.0 + F.coalesce("_q_n", F.lit(0))).otherwise(T.from_loc(loc))
    return symbols.join(sums, "symbol_id", "left").join(read, "path", "left").withColumn("complexity", own).drop("_q_n", "_q_read")


def file_complexity(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """``files(path, ...)`` with the mean of their symbols' complexities, 1.0 without any."""
    mean = symbols.groupBy("path").agg(F.avg("complexity").alias("complexity"))
    return files.join(mean, "path", "left").withColumn("complexity", F.coalesce("complexity", F.lit(1.0)))


def heatmap(files: DataFrame) -> DataFrame:
    """``files(file_id, sloc, complexity, churn, fan_in)`` with heat: min-max scaled 0.4, 0.3, 0.2, 0.1; a flat measure counts 0."""
    parts = (("complexity", 0.4), ("churn", 0.3), ("sloc", 0.2), ("fan_in", 0.1))
    ends = files.agg(*[f(c).alias(f"{n}_{c}") for c, _ in parts for n, f in (("lo", F.min), ("hi", F.max))])  # one row
    scaled = [F.coalesce(F.try_divide(F.col(c) - F.col(f"lo_{c}"), F.col(f"hi_{c}") - F.col(f"lo_{c}")), F.lit(0.0)) * w for c, w in parts]
    return files.crossJoin(F.broadcast(ends)).select(*files.columns, F.round(sum(scaled[1:], scaled[0]), 6).alias("heat"))


def language_breakdown(files: DataFrame) -> DataFrame:
    """language, files, sloc, percent of files with a language."""
    own = files.where("language is not null").groupBy("language").agg(F.count(F.lit(1)).alias("files"), F.sum("sloc").alias("sloc"))
    return own.withColumn("percent", F.round(100.0 * F.col("files") / F.sum("files").over(Window.partitionBy()), 6))  # a row a language


def community_sloc(symbols: DataFrame, members: DataFrame) -> DataFrame:
    """community_id, member_count, sloc: lines of the members' spans."""
    spans = symbols.select("symbol_id", (F.col("end_line") - F.greatest(F.col("start_line") - 1, F.lit(0))).alias("loc"))
    return members.join(spans, "symbol_id").groupBy("community_id").agg(F.count(F.lit(1)).alias("member_count"), F.sum("loc").alias("sloc"))


def repo_report(files: DataFrame, symbols: DataFrame, modularity: DataFrame) -> DataFrame:
    """One row: files, sloc, symbols, names, avg_complexity (mean over files; 0 without any), modularity; ``files`` has complexity."""
    more = files.agg(F.round(F.coalesce(F.avg("complexity"), F.lit(0.0)), 6).alias("avg_complexity"))
    q = modularity.agg(F.round(F.coalesce(F.sum("q"), F.lit(0.0)), 4).alias("modularity"))
    return repo_totals(files, symbols).crossJoin(more).crossJoin(q)  # one row each


def dashboard(files: DataFrame) -> DataFrame:
    """One row: files, sloc, languages (known ones), avg_sloc (half up), top_languages (four by lines, 'language:sloc:percent')."""
    each = files.groupBy(F.coalesce("language", F.lit("unknown")).alias("l")).agg(F.sum("sloc").alias("s"), F.count("language").alias("known"), F.count(F.lit(1)).alias("n"))
    rows = F.sort_array(F.collect_list(F.struct((-F.col("s")).alias("o"), "l", "s")))  # a row a language
    all_ = each.agg(F.sum("n").alias("files"), F.sum("s").alias("sloc"), F.count_if(F.col("known") > 0).alias("languages"), rows.alias("rows"))
    told = F.transform(F.slice("rows", 1, 4), lambda x: F.concat_ws(":", x["l"], x["s"], F.floor(F.coalesce(F.try_divide(100.0 * x["s"], F.col("sloc")), F.lit(0.0)) + 0.5).cast("long")))
    return all_.select("files", "sloc", "languages", F.floor(F.coalesce(F.try_divide(F.col("sloc"), F.col("files")), F.lit(0)) + 0.5).cast("long").alias("avg_sloc"), F.array_join(told, ",").alias("top_languages"))


def repo_totals(files: DataFrame, symbols: DataFrame) -> DataFrame:
    a = files.agg(F.count(F.lit(1)).alias("files"), F.sum("sloc").alias("sloc"))
    b = symbols.agg(F.count(F.lit(1)).alias("symbols"), F.count_distinct("name").alias("names"))
    return a.crossJoin(b)  # one row each


def tfidf(symbols: DataFrame, members: DataFrame, top: int = 10) -> DataFrame:
    """community_id, term, score of the ``top`` terms: tf over all tokens times ln(communities / df) + 1; ties by term."""
    tokens = members.join(symbols.select("symbol_id", "name"), "symbol_id").select("community_id", F.explode(name_tokens(F.col("name"))).alias("term"))
    counts = tokens.groupBy("community_id", "term").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("community_id").agg(F.sum("n").alias("total"))
    df = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    size = members.agg(F.count_distinct("community_id").alias("communities"))  # one row
    score = F.round(F.col("n") / F.col("total") * (F.log(F.col("communities") / F.col("df")) + 1), 6)
    scored = counts.join(totals, "community_id").join(df, "term").crossJoin(F.broadcast(size)).withColumn("score", score)
    rank = F.row_number().over(Window.partitionBy("community_id").orderBy(F.desc("score"), "term"))
    return scored.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top).select("community_id", "rank", "term", "score")


#: Words too general for a label: fixed values.
STOP_WORDS = (
    "new get set run self impl pub fn let mut str string vec option result default from into test tests mod use type id name data value "
    "init create make build with for the and err error handle handler process main"
).split()
#: What a label ends with where most symbols are of a kind: fixed values.
KIND_WORDS = {"Class": "classes", "Interface": "interfaces", "Struct": "types", "Enum": "enums", "Trait": "traits"}


def common_first(tokens: DataFrame, sizes: DataFrame, share: float = 0.6) -> DataFrame:
    """community_id, prefix: the most frequent first token of names, if ``share`` of the names (rounded down) have it and there are two names."""
    heads = tokens.where(F.size("ts") > 0).groupBy("community_id", F.col("ts")[0].alias("tok")).agg(F.count(F.lit(1)).alias("c"))
    best = heads.groupBy("community_id").agg(F.min_by(F.struct("tok", "c"), F.struct((-F.col("c")).alias("o"), "tok")).alias("b"))
    return best.join(sizes, "community_id").where((F.col("n") >= 2) & (F.col("b.c") >= F.floor(F.col("n") * share))).select("community_id", F.col("b.tok").alias("prefix"))


def labels(symbols: DataFrame, members: DataFrame, misc: int | None = None) -> DataFrame:
    """community_id, label: common first token and best terms of its names, and a word for its most frequent kind; equal labels are numbered.

    ``misc`` is the community of isolated symbols, which keeps that name.  Ties go to the lesser term, kind, community.
    """
    own = members.join(symbols.select("symbol_id", "name", "kind"), "symbol_id").select("community_id", "kind", name_tokens(F.col("name"), ":", 3).alias("ts"))
    sizes = members.groupBy("community_id").agg(F.count(F.lit(1)).alias("n"))
    prefix = common_first(own, sizes)
    counts = own.select("community_id", F.explode("ts").alias("term")).groupBy("community_id", "term").agg(F.count(F.lit(1)).alias("c"))
    totals = counts.groupBy("community_id").agg(F.sum("c").alias("total"))
    df = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    every = sizes.agg(F.count(F.lit(1)).alias("communities"))  # one row
    score = F.col("c") / F.col("total") * (F.log(F.col("communities") / F.col("df")) + 1) * F.when(F.col("term") == F.col("prefix"), 1.5).otherwise(1.0)
    scored = counts.where(~F.col("term").isin(*STOP_WORDS)).join(totals, "community_id").join(df, "term").join(prefix, "community_id", "left").crossJoin(F.broadcast(every)).select("community_id", "term", F.round(score, 9).alias("score"))
    rank = F.row_number().over(Window.partitionBy("community_id").orderBy(F.desc("score"), "term"))
    top = scored.withColumn("r", rank).where("r <= 2").groupBy("community_id").agg(F.max(F.when(F.col("r") == 1, F.col("term"))).alias("t1"), F.max(F.when(F.col("r") == 2, F.col("term"))).alias("t2"))
    kinds = own.groupBy("community_id", "kind").agg(F.count(F.lit(1)).alias("c")).groupBy("community_id").agg(F.min_by("kind", F.struct((-F.col("c")).alias("o"), "kind")).alias("kind"))
    all_ = sizes.join(totals, "community_id", "left").join(prefix, "community_id", "left").join(top, "community_id", "left").join(kinds, "community_id", "left")
    group = F.concat(F.lit("group_"), F.col("community_id"))
    pair = lambda a, b: F.concat(a, F.lit("_"), b)
    p, t1, t2 = F.col("prefix"), F.col("t1"), F.col("t2")
    base = F.when(p.isNotNull(), F.when(t1.isNull() | (t1 == p), p).otherwise(pair(p, t1))).when(t1.isNull(), group).when(t2.isNull(), t1).otherwise(pair(t1, t2))
    word = F.coalesce(*[F.when(F.col("kind") == k, F.lit(w)) for k, w in KIND_WORDS.items()])
    one = F.substring(word, F.lit(1), F.length(word) - 1)
    full = F.when(F.col("total").isNull(), group).when(word.isNull() | F.contains(base, one), base).otherwise(pair(base, word))
    full = F.when(F.col("community_id") == misc, "misc").otherwise(full) if misc is not None else full
    named = all_.select("community_id", full.alias("base"))
    nth = F.row_number().over(Window.partitionBy("base").orderBy("community_id"))
    return named.withColumn("k", nth).select("community_id", F.when(F.col("k") == 1, F.col("base")).otherwise(pair(F.col("base"), F.col("k"))).alias("label"))


def dominant_community(symbols: DataFrame, members: DataFrame) -> DataFrame:
    """file_id, community_id, n of the community with most of a file's symbols; ties to the lesser id."""
    counts = symbols.select("symbol_id", "file_id").join(members, "symbol_id").groupBy("file_id", "community_id").agg(F.count(F.lit(1)).alias("n"))
    first = F.row_number().over(Window.partitionBy("file_id").orderBy(F.desc("n"), "community_id"))
    return counts.withColumn("r", first).where("r = 1").select("file_id", "community_id", "n")


def reading_order(files: DataFrame, symbols: DataFrame, edges: DataFrame, top: int = 10, long: int = 500) -> DataFrame:
    """rank, path, score: fan-in of files, 0.7 of it above ``long`` lines; ties by path."""
    score = F.col("fan_in") * F.when(F.col("sloc") > long, 0.7).otherwise(1.0)
    best = files.join(file_fan_in(symbols, edges), "file_id").select("path", F.round(score, 6).alias("score")).where("score > 0").orderBy(F.desc("score"), "path").limit(top)
    return best.select(F.row_number().over(Window.orderBy(F.desc("score"), "path")).cast("long").alias("rank"), "path", "score")  # of ``top`` rows
