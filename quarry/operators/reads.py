"""Composite reads: what a client asks for in one call, each one plan of lookups, joins and small aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def get(df: DataFrame, key: str, value) -> DataFrame:
    """The row of a key (no row if there is none); the equality reaches the scan."""
    return df.where(F.col(key) == value)


def by(df: DataFrame, **equal) -> DataFrame:
    """Rows equal in every column named; None asks for null."""
    for column, value in equal.items():
        df = df.where(F.col(column).isNull() if value is None else F.col(column) == value)
    return df


def holding(df: DataFrame, column: str, text: str, least: int = 0) -> DataFrame:
    """Rows whose column holds ``text``, letter case apart; a text below ``least`` characters finds nothing."""
    return df.where(F.lower(column).contains(text.lower())) if len(text) >= least else df.limit(0)


def listed_symbols(symbols: DataFrame, ids: list[int]) -> DataFrame:
    """Symbols of a list of ids, with their file's path."""
    return symbols.where(F.col("symbol_id").isin(*ids)).select("symbol_id", "name", "kind", "path", "start_line", "end_line")


def reading_lines(texts: DataFrame) -> DataFrame:
    """id, at, path, reason of the lines 'N. path — reason' of ``texts(id, content)``."""
    from ..functions.text import lines, strip

    flat = texts.select("id", F.posexplode(lines(F.col("content"))).alias("at", "row")).where(F.contains("row", F.lit(".")) & F.contains("row", F.lit("—")))
    rest = flat.withColumn("rest", F.regexp_replace("row", r"(?s)^[^.]*\.", "")).where(F.contains("rest", F.lit("—")))
    return rest.select("id", F.col("at").cast("long").alias("at"), strip(F.regexp_replace("rest", "(?s)—.*$", "")).alias("path"), strip(F.regexp_replace("rest", "(?s)^[^—]*—", "")).alias("reason"))


def sections_with_progress(sections: DataFrame, progress: DataFrame) -> DataFrame:
    """Sections and whether ``progress(chapter_id, section_id, completed)`` has them done; unknown ones are not."""
    done = progress.groupBy("chapter_id", "section_id").agg(F.bool_or("completed").alias("done"))
    return sections.select("chapter_id", "section_id", "content_type").join(done, ["chapter_id", "section_id"], "left").withColumn("done", F.coalesce("done", F.lit(False)))


def chapters_with_texts(chapters: DataFrame, labels: DataFrame, narratives: DataFrame) -> DataFrame:
    """chapter_id, community_id, label, content: a chapter's community and that community's summary, where there are any."""
    told = narratives.where("kind = 'module_summary'").groupBy(F.col("target_id").alias("community_id")).agg(F.min("content").alias("content"))
    return chapters.select("chapter_id", "community_id").join(labels, "community_id", "left").join(told, "community_id", "left").select("chapter_id", "community_id", "label", "content")


def neighbouring(chapters: DataFrame) -> DataFrame:
    """chapter_id, previous, following by order_index minus and plus one; a gap gives null."""
    own = chapters.select("chapter_id", "order_index")
    step = lambda d, name: own.select((F.col("order_index") - d).alias("order_index"), F.col("chapter_id").alias(name))
    return own.join(step(-1, "previous"), "order_index", "left").join(step(1, "following"), "order_index", "left").select("chapter_id", "previous", "following")


def flow_steps(steps: DataFrame, symbols: DataFrame, processes: DataFrame) -> DataFrame:
    """process_id, step_order, name, path, process of the steps of flows; a step of an unknown symbol stays."""
    named = steps.join(symbols.select("symbol_id", "name", "path"), "symbol_id", "left")
    return named.join(processes, "process_id", "left").select("process_id", "step_order", "symbol_id", "name", "path", "process")


def affected(impact: DataFrame, symbols: DataFrame) -> DataFrame:
    """root, symbols, files: how many symbols and different files a change of each root reaches."""
    return impact.join(symbols.select("symbol_id", "file_id"), "symbol_id").groupBy("root").agg(F.count(F.lit(1)).alias("symbols"), F.count_distinct("file_id").alias("files"))


def top_files(files: DataFrame, key: str = "sloc", up: bool = False, n: int = 20) -> DataFrame:
    """The first ``n`` files by lines or path, either way; equal ones by path."""
    return files.orderBy(F.col(key).asc() if up else F.col(key).desc(), "path").limit(n)


def highlighted(edges: DataFrame, symbol: int) -> DataFrame:
    """symbol_id of a symbol and of everything an edge joins to it."""
    a = edges.where(F.col("source_id") == symbol).select(F.col("target_id").alias("symbol_id"))
    b = edges.where(F.col("target_id") == symbol).select(F.col("source_id").alias("symbol_id"))
    return a.union(b).union(edges.sparkSession.range(1).select(F.lit(symbol).cast("long").alias("symbol_id"))).distinct()


def focus(edges: DataFrame, symbol: int) -> DataFrame:
    """Edges among a symbol and its neighbours."""
    from .lookups import induced

    return induced(highlighted(edges, symbol), edges)


def counts_by(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def notes(annotations: DataFrame) -> DataFrame:
    """Annotations with their place: flagged first, then newest, then by id."""
    place = F.row_number().over(Window.partitionBy("target_type", "target_id").orderBy(F.desc("flagged"), F.desc("created_at"), "id"))
    return annotations.withColumn("place", place.cast("long"))


def understand(files: DataFrame, symbols: DataFrame, cohesion: DataFrame, labels: DataFrame, chapters: DataFrame, overview: DataFrame) -> DataFrame:
    """One row: file_count, symbol_count, languages (language:files), communities (id:label:cohesion), community_count, chapter_count, overview."""
    langs = files.where("language is not null").groupBy("language").agg(F.count(F.lit(1)).alias("n")).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "language", "n"))), ",").alias("languages"))
    rows = F.array_sort(F.collect_list(F.struct("community_id", F.coalesce("label", F.lit("")).alias("label"), "cohesion")))
    comms = cohesion.join(labels, "community_id", "left").agg(F.array_join(F.transform(rows, lambda x: F.concat_ws(":", x["community_id"], x["label"], F.format_string("%.3f", x["cohesion"]))), ",").alias("communities"), F.count(F.lit(1)).alias("community_count"))
    parts = [files.agg(F.count(F.lit(1)).alias("file_count")), symbols.agg(F.count(F.lit(1)).alias("symbol_count")), langs, comms, chapters.agg(F.count(F.lit(1)).alias("chapter_count")), overview.agg(F.min("content").alias("overview"))]
    out = parts[0]
    for part in parts[1:]:
        out = out.crossJoin(part)  # each one row
    return out


def explain_file(files: DataFrame, symbols: DataFrame, measures: DataFrame, path: str) -> DataFrame:
    """One row of a file: language, sloc, symbol_count, symbols ('name:kind:start:end' by place), complexity, churn, contributors; none if there is no such file."""
    own = symbols.where(F.col("path") == path)
    listed = F.array_sort(F.collect_list(F.struct("start_line", "symbol_id", F.concat_ws(":", "name", "kind", "start_line", "end_line").alias("t"))))
    held = own.agg(F.count(F.lit(1)).alias("symbol_count"), F.array_join(F.transform(listed, lambda x: x["t"]), ",").alias("symbols"))
    return files.where(F.col("path") == path).crossJoin(held).join(measures.select("file_id", "complexity", "churn", "contributors"), "file_id", "left").select("path", "language", "sloc", "symbol_count", "symbols", "complexity", "churn", "contributors")


def explain_symbols(symbols: DataFrame, narratives: DataFrame) -> DataFrame:
    """symbol_id, explanation, source: what was told of a symbol before, else a sentence from its row."""
    told = narratives.where("kind = 'symbol_explanation'").groupBy(F.col("target_id").alias("symbol_id")).agg(F.min("content").alias("told"))
    sign = F.coalesce("signature", F.lit("N/A")) if "signature" in symbols.columns else F.lit("N/A")
    made = F.concat("name", F.lit(" is a "), "kind", F.lit(" defined at lines "), "start_line", F.lit("-"), "end_line", F.lit(". Signature: "), sign)
    return symbols.join(told, "symbol_id", "left").select("symbol_id", F.coalesce("told", made).alias("explanation"), F.when(F.col("told").isNotNull(), "pre-generated").otherwise("generated-from-db").alias("source"))
