"""Texts and documents made of code relations: diagrams, narratives, chapters, quizzes, exports."""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import format_label, lines, mermaid_id, mermaid_label, strip
from . import communities as com
from .graph import community_edges, fan_in_out, labelled
from .progress import difficulty

SECTIONS = ("overview", "key_concepts", "diagram", "code_walkthrough", "connections", "quiz")
STARTS = ("graph ", "graph\t", "flowchart ", "flowchart\t", "sequenceDiagram", "classDiagram", "stateDiagram", "erDiagram", "gantt", "pie")


def architecture(nodes: DataFrame, edges: DataFrame, members: DataFrame, labels: DataFrame, most: int = 50) -> DataFrame:
    """One row, ``mermaid``: the ``most`` symbols of greatest fan-in, boxed by community, arrows dashed between communities."""
    top = nodes.select("symbol_id", "name").join(fan_in_out(nodes, edges, None).select("symbol_id", "fan_in"), "symbol_id").orderBy(F.desc("fan_in"), "symbol_id").limit(most)
    own = top.join(members, "symbol_id", "left").join(labels, "community_id", "left").withColumn("label", F.coalesce("label", F.lit("other")))
    node = F.concat(F.lit("    "), mermaid_id(F.concat("name", F.lit("_"), "symbol_id")), F.lit('["'), mermaid_label(F.col("name")), F.lit('"]'))
    boxes = own.groupBy("label").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("symbol_id", node.alias("t")))), lambda x: x["t"]), "\n").alias("inner"))
    boxes = boxes.select(F.concat(F.lit("  subgraph "), mermaid_id(F.col("label")), F.lit('["'), mermaid_label(format_label(F.col("label"))), F.lit('"]\n'), "inner", F.lit("\n  end")).alias("t"), F.col("label").alias("k"))
    pick = own.select("symbol_id", "community_id", mermaid_id(F.concat("name", F.lit("_"), "symbol_id")).alias("node"))
    a, b = pick.toDF("source_id", "ca", "na"), pick.toDF("target_id", "cb", "nb")
    pairs = edges.select("source_id", "target_id").distinct().join(a, "source_id").join(b, "target_id")
    arrow = F.when(F.col("ca").eqNullSafe(F.col("cb")), " --> ").otherwise(" -.-> ")
    links = pairs.select(F.concat(F.lit("  "), "na", arrow, "nb").alias("t"))
    a1 = boxes.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "t"))), lambda x: x["t"]), "\n").alias("boxes"))
    b1 = links.agg(F.array_join(F.array_sort(F.collect_list("t")), "\n").alias("links"))  # at most 50 x 50 links
    return a1.crossJoin(b1).select(F.concat_ws("\n", F.lit("graph TD"), F.expr("nullif(boxes, '')"), F.expr("nullif(links, '')")).alias("mermaid"))


def validate_mermaid(text: str) -> list[str]:
    """What is wrong with a diagram's text; nothing if it is well formed."""
    rows = text.splitlines()
    if not rows:
        return ["Empty diagram"]
    errors = []
    head = next((r.strip() for r in rows if r.strip()), "")
    if not head.startswith(STARTS):
        errors.append(f"No diagram keyword at the start: '{head[:40]}'")
    for a, b, what in (("(", ")", "parentheses"), ("[", "]", "square brackets"), ("{", "}", "curly braces")):
        depth, quoted = 0, False
        for c in text:
            quoted ^= c == '"'
            depth += 0 if quoted else (c == a) - (c == b)
        if depth:
            errors.append(f"Unbalanced {what}")
    if text.count('"') % 2:
        errors.append("Unbalanced double quotes")
    errors += [f"Line {k}: invalid edge '->'" for k, r in enumerate(rows, 1) if " -> " in r and "-->" not in r and "-.->" not in r]
    opened, closed = sum(r.strip().startswith("subgraph ") for r in rows), sum(r.strip() == "end" for r in rows)
    if opened != closed:
        errors.append(f"{opened} subgraphs but {closed} ends")
    return errors


def mermaid_errors(text: Column) -> Column:
    """The same as an array column: what is outside quotes are the parts of even place between them, so brackets are counted there."""
    rows = lines(text)
    bare = F.transform(rows, strip)
    head = F.coalesce(F.get(F.filter(bare, lambda x: x != ""), F.lit(0)), F.lit(""))
    known = functools.reduce(Column.__or__, [head.startswith(k) for k in STARTS])
    parts = F.split(text, '"', -1)
    outside = F.array_join(F.filter(parts, lambda x, i: i % 2 == 0), "")
    count = lambda c: F.length(outside) - F.length(F.replace(outside, F.lit(c)))
    told = [F.when(~known, F.concat(F.lit("No diagram keyword at the start: '"), F.substring(head, 1, 40), F.lit("'")))]
    told += [F.when(count(a) != count(b), F.lit(f"Unbalanced {what}")) for a, b, what in (("(", ")", "parentheses"), ("[", "]", "square brackets"), ("{", "}", "curly braces"))]
    told.append(F.when(F.size(parts) % 2 == 0, F.lit("Unbalanced double quotes")))
    arrows = F.transform(rows, lambda r, i: F.when(r.contains(" -> ") & ~r.contains("-->") & ~r.contains("-.->"), F.concat(F.lit("Line "), (i + 1).cast("string"), F.lit(": invalid edge '->'"))))
    opened, closed = F.size(F.filter(bare, lambda x: x.startswith("subgraph "))), F.size(F.filter(bare, lambda x: x == "end"))
    last = F.when(opened != closed, F.concat(opened.cast("string"), F.lit(" subgraphs but "), closed.cast("string"), F.lit(" ends")))
    return F.when(F.size(rows) <= 0, F.array(F.lit("Empty diagram"))).otherwise(F.array_compact(F.concat(F.array(*told), arrows, F.array(last))))


#: Lines that a flowchart passes over, and how the others are told apart.
_SKIP = ("//", "#", "fn ", "def ", "func ", "function ", "pub fn ", "async fn ", "pub async fn ")
_FLOW = (("decision", re.compile(r"(\} )?(else )?if |match |switch[ (]")), ("loop", re.compile(r"for |while |loop( \{)?$")), ("exit", re.compile(r"return( .*|;)?$")))


def flowchart(name: str, body: list[str]) -> tuple[list[tuple], list[tuple]]:
    """Nodes (id, kind, label) and edges (from, to, label) of a function's control flow, line by line; plain lines join by three."""
    nodes, edges, plain = [], [], []

    def add(kind: str, label: str) -> None:
        nodes.append((f"n{len(nodes)}", kind, label))
        if len(nodes) > 1:
            edges.append((nodes[-2][0], nodes[-1][0], None))

    def flush() -> None:
        if plain:
            add("process", "\n".join(plain))
            plain.clear()

    add("entry", f"Start: {name}")
    for row in map(str.strip, body):
        if row in ("", "{", "}") or row.startswith(_SKIP):
            continue
        kind = next((k for k, p in _FLOW if p.match(row)), None)
        if kind is None:
            plain.append(row)
            if len(plain) == 3:
                flush()
            continue
        flush()
        add(kind, row if kind == "exit" else row.rstrip("{").strip())
        if kind == "loop":
            edges.append((nodes[-1][0], nodes[-1][0], "repeat"))
    flush()
    add("exit", "End")
    return nodes, edges


def flowcharts(functions: DataFrame) -> DataFrame:
    """``functions(symbol_id, name, body)`` -> symbol_id, nodes, edges."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            made = [flowchart(n, (b or "").splitlines()) for n, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            node = pa.list_(pa.struct([("id", pa.string()), ("kind", pa.string()), ("label", pa.string())]))
            edge = pa.list_(pa.struct([("from", pa.string()), ("to", pa.string()), ("label", pa.string())]))
            nodes = [[dict(zip(("id", "kind", "label"), x)) for x in m[0]] for m in made]
            edges = [[dict(zip(("from", "to", "label"), x)) for x in m[1]] for m in made]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes, node), pa.array(edges, edge)], ["symbol_id", "nodes", "edges"])

    return functions.select("symbol_id", "name", "body").mapInArrow(run, "symbol_id long, nodes array<struct<id: string, kind: string, label: string>>, edges array<struct<`from`: string, `to`: string, label: string>>")


def titled(cohesion: DataFrame, labels: DataFrame) -> DataFrame:
    """community_id, n_members, cohesion, label and the label as a title."""
    return cohesion.join(labels, "community_id").withColumn("title", format_label(F.col("label")))


def _listing(rows: DataFrame, order: list, line, by: list[str] = ()) -> DataFrame:
    """``lines`` joined by line ends in order, for each ``by`` (or all)."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct(F.struct(*order).alias("o"), line.alias("t")))), lambda x: x["t"])
    return rows.groupBy(*by).agg(F.array_join(listed, "\n").alias("lines"))


def _text(*parts) -> F.Column:
    """Parts joined; a string is a literal, a null part is left out."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def _percent(x) -> F.Column:
    return F.format_string("%.0f", F.round(x * 100, 6))


#: What edges are called in a text: fixed values.
RELATIONS = {"CALLS": "function calls", "IMPORTS": "import dependencies", "EXTENDS": "inheritance relationships", "IMPLEMENTS": "interface implementations", "CONTAINS": "containment relationships"}


def narratives(nodes: DataFrame, edges: DataFrame, members: DataFrame, labels: DataFrame, files: DataFrame, cohesion: DataFrame, entries: DataFrame) -> DataFrame:
    """kind, target_id, content, is_placeholder: overview, architecture, reading order, extension and contribution guides, why it trends, and a summary of each community.

    ``cohesion(community_id, n_members, cohesion)`` and ``entries(symbol_id, name, score, reason)``.  The texts are fixed values.
    Lists over the whole corpus have a stated length; ties go to the least id.
    """
    own = titled(cohesion, labels)
    counts = files.agg(F.count(F.lit(1)).alias("f"), F.coalesce(F.sum("sloc"), F.lit(0)).alias("l"), F.array_join(F.array_sort(F.collect_set("language")), ", ").alias("langs"))
    counts = counts.crossJoin(nodes.agg(F.count(F.lit(1)).alias("s"))).crossJoin(edges.agg(F.count(F.lit(1)).alias("e")))  # one row each
    counts = counts.crossJoin(own.agg(F.count(F.lit(1)).alias("m"))).crossJoin(entries.agg(F.count(F.lit(1)).alias("x")))
    section = lambda head, lines: F.when(F.coalesce(lines, F.lit("")) != "", F.concat(F.lit(head), lines))

    glance = _listing(own.where("n_members > 1"), ["community_id"], _text("- **", F.col("title"), "** — ", F.col("n_members"), " symbols (cohesion: ", _percent(F.col("cohesion")), "%)")).withColumnRenamed("lines", "glance")
    best = _listing(entries.orderBy(F.desc("score"), "symbol_id").limit(5), [(-F.col("score")).alias("k"), "symbol_id"], _text("- `", F.col("name"), "` — ", F.col("reason"))).withColumnRenamed("lines", "best")
    overview = counts.crossJoin(glance).crossJoin(best).select(
        _text(
            "## Project Overview\n\nThis project contains **", F.col("f"), " files** with **", F.col("s"), " symbols** across **", F.col("l"), " lines of code**, written in **", F.when(F.col("langs") == "", "unknown languages").otherwise(F.col("langs")),
            "**.\n\nThe codebase is organized into **", F.col("m"), " functional modules** (automatically detected communities) with **", F.col("x"), " entry points**.",
            section("\n\n### Modules at a Glance\n\n", F.col("glance")), section("\n\n### Key Entry Points\n\n", F.col("best")),
        ).alias("content")
    )
    word = F.coalesce(*[F.when(F.col("kind") == k, F.lit(w)) for k, w in RELATIONS.items()])
    kinds = _listing(edges.groupBy("kind").agg(F.count(F.lit(1)).alias("n")), [(-F.col("n")).alias("k"), "kind"], _text("- **", F.col("n"), "** ", word)).withColumnRenamed("lines", "kinds")
    first = members.join(nodes.select("symbol_id", "name"), "symbol_id").withColumn("r", F.row_number().over(Window.partitionBy("community_id").orderBy("symbol_id")))
    ten = own.where("n_members > 1").orderBy(F.desc("n_members"), "community_id").limit(10)
    three = first.where("r <= 3").groupBy("community_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "name"))), lambda x: x["name"]), "`, `").alias("names"))
    tops = _listing(ten.join(three, "community_id", "left"), [(-F.col("n_members")).alias("k"), "community_id"], _text("- **", F.col("title"), "** (", F.col("n_members"), " symbols) — includes: `", F.col("names"), "`")).withColumnRenamed("lines", "tops")
    architecture = counts.crossJoin(kinds).crossJoin(tops).select(
        F.when(F.col("m") == 0, "No community/module structure detected yet.").otherwise(
            _text(
                "## Architecture\n\nThe codebase consists of **", F.col("s"), " symbols** connected by **", F.col("e"), " relationships** across **", F.col("m"), " modules**.\n\n",
                F.when(F.col("kinds") != "", F.concat(F.lit("### Relationship Types\n\n"), "kinds", F.lit("\n\n"))), "### Module Hierarchy\n\n", F.col("tops"),
            )
        ).alias("content")
    )
    eight = entries.join(nodes.select("symbol_id", "kind"), "symbol_id").orderBy(F.desc("score"), "symbol_id").limit(8)
    eight = eight.withColumn("r", F.row_number().over(Window.orderBy(F.desc("score"), "symbol_id")))  # of eight rows
    reading = _listing(eight, ["r"], _text(F.col("r"), ". **`", F.col("name"), "`** (", F.col("kind"), ") — ", F.col("reason"), " *(score: ", F.format_string("%.1f", F.col("score")), ")*"))
    reading = reading.select(F.when(F.col("lines") == "", "No entry points detected. Run analysis to generate reading order.").otherwise(F.concat(F.lit("## Recommended Reading Order\n\nStart with the entry points below, then follow the dependency chains to understand how the codebase fits together.\n\n"), "lines")).alias("content"))
    fan = fan_in_out(nodes, edges, None).where("fan_in >= 3").orderBy(F.desc("fan_in"), "symbol_id").limit(8).join(nodes.select("symbol_id", "name", "kind"), "symbol_id")
    extend = _listing(fan, [(-F.col("fan_in")).alias("k"), "symbol_id"], _text("- `", F.col("name"), "` (", F.col("kind"), ") — used by ", F.col("fan_in"), " other symbols"))
    extend = extend.select(_text("## Extension Guide\n\nTo extend this codebase, look at the modules with the highest cohesion — they represent well-defined functional areas where new features can be added cleanly.\n", section("\n### Key Extension Points (high fan-in)\n\n", F.col("lines"))).alias("content"))
    loose = own.where("n_members > 2").orderBy("cohesion", "community_id").limit(5)
    help_ = _listing(loose, ["cohesion", "community_id"], _text("- **", F.col("title"), "** — ", F.col("n_members"), " symbols, cohesion ", _percent(F.col("cohesion")), "%"))
    help_ = help_.select(
        _text(
            "## Contribution Guide\n\nHere's how to get started contributing to this codebase:\n\n1. **Start with entry points** — understand the main execution paths\n2. **Pick a module** — each module is relatively self-contained\n"
            "3. **Follow the edges** — understand how your module connects to others\n", section("\n### Good First Areas\n\n", F.col("lines")),
        ).alias("content")
    )
    why = counts.select(_text("## Why This Project\n\nThis project is written in ", F.when(F.col("langs") == "", "various languages").otherwise(F.col("langs")), " with ", F.col("f"), " files. Explore the modules, architecture, and entry points to understand its design.").alias("content"))

    parts = {"overview": overview, "architecture": architecture, "reading_order": reading, "extension_guide": extend, "contribution_guide": help_, "why_trending": why}
    out = summaries(nodes, edges, members, own).select(F.lit("module_summary").alias("kind"), F.col("community_id").alias("target_id"), "content")
    for kind, df in parts.items():
        out = out.unionByName(df.select(F.lit(kind).alias("kind"), F.lit(None).cast("long").alias("target_id"), "content"))
    return out.withColumn("is_placeholder", F.lit(True))


#: Kinds that a summary lists as types and as functions, lower-cased.
TYPES, FUNCTIONS = ("struct", "class", "enum", "trait", "interface"), ("function", "method", "fn")


def summaries(nodes: DataFrame, edges: DataFrame, members: DataFrame, own: DataFrame) -> DataFrame:
    """community_id, content: size, cohesion, links to other communities, all types and ten functions of each community of ``own``."""
    out = community_edges(edges, members).groupBy(F.col("source_community").alias("community_id")).agg(F.sum("weight").alias("outgoing"))
    held = members.join(nodes.select("symbol_id", "name", F.lower("kind").alias("k")), "symbol_id").withColumn("t", F.concat(F.lit("- `"), "name", F.lit("`")))
    types = _listing(held.where(F.col("k").isin(*TYPES)), ["symbol_id"], F.col("t"), ["community_id"]).withColumnRenamed("lines", "types")
    calls = held.where(F.col("k").isin(*FUNCTIONS)).withColumn("r", F.row_number().over(Window.partitionBy("community_id").orderBy("symbol_id")))
    funcs = _listing(calls.where("r <= 10"), ["symbol_id"], F.col("t"), ["community_id"]).withColumnRenamed("lines", "funcs").join(calls.groupBy("community_id").agg(F.count(F.lit(1)).alias("nf")), "community_id")
    text = _text(
        "## Module: ", F.col("title"), "\n\nThis module contains **", F.col("n_members"), " symbols** with a cohesion score of **", _percent(F.col("cohesion")), "%** and **", F.coalesce("outgoing", F.lit(0)), " external connections**.",
        F.when(F.col("types").isNotNull(), F.concat(F.lit("\n\n### Types\n\n"), "types")), F.when(F.col("funcs").isNotNull(), F.concat(F.lit("\n\n### Functions\n\n"), "funcs")),
        F.when(F.col("nf") > 10, F.concat(F.lit("\n- ...and "), F.col("nf") - 10, F.lit(" more"))),
    )
    return own.join(out, "community_id", "left").join(types, "community_id", "left").join(funcs, "community_id", "left").select("community_id", text.alias("content"))


def explanations(nodes: DataFrame, edges: DataFrame, members: DataFrame, labels: DataFrame, most: int = 5) -> DataFrame:
    """symbol_id, content: kind, module, and the ``most`` newest edges either way of each symbol, as a text of fixed form."""

    def side(own: str, other: str):
        named = edges.select("edge_id", F.col(own).alias("symbol_id"), F.col(other).alias("o")).withColumn("r", F.row_number().over(Window.partitionBy("symbol_id").orderBy(F.desc("edge_id"))))
        named = named.where(F.col("r") <= most).join(nodes.select(F.col("symbol_id").alias("o"), "name"), "o")
        return named.groupBy("symbol_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "name"))), lambda x: F.concat(F.lit("`"), x["name"], F.lit("`"))), ", ").alias("t"))

    home = members.join(labels, "community_id").groupBy("symbol_id").agg(F.min_by("label", "community_id").alias("label"))
    rows = nodes.select("symbol_id", "name", "kind").join(home, "symbol_id", "left").join(side("source_id", "target_id").withColumnRenamed("t", "down"), "symbol_id", "left").join(side("target_id", "source_id").withColumnRenamed("t", "up"), "symbol_id", "left")
    text = _text(
        "## `", F.col("name"), "`\n\n**Kind:** ", F.col("kind"), " | **Module:** ", F.coalesce(format_label(F.col("label")), F.lit("uncategorized")),
        F.when(F.col("down").isNotNull(), F.concat(F.lit("\n\n**Calls:** "), "down")), F.when(F.col("up").isNotNull(), F.concat(F.lit("\n\n**Called by:** "), "up")),
    )
    return rows.select("symbol_id", text.alias("content"))


def split_batched(text) -> F.Column:
    """array<struct<id, body>> of a text's parts headed '## Community <id>'."""
    parts = F.regexp_extract_all(text, F.lit(r"(?s)## Community \d+.*?(?=## Community \d+|$)"), F.lit(0))
    return F.transform(parts, lambda p: F.struct(F.try_to_number(F.regexp_extract(p, r"## Community (\d+)", 1), F.lit("999999999")).cast("long").alias("id"), strip(F.regexp_replace(p, r"(?s)^## Community \d+[^\n]*\n?", "")).alias("body")))


MOST_CONTEXT, CUT = 32_000, "\n\n... (context truncated for token budget)"


def bounded(text) -> F.Column:
    """A context of at most ``MOST_CONTEXT`` characters; a longer one loses its end and says so."""
    return F.when(F.length(text) > MOST_CONTEXT, F.concat(F.substring(text, 1, MOST_CONTEXT - 50), F.lit(CUT))).otherwise(text)


def _more(n, most: int, what: str, lead: str = "... and ") -> F.Column:
    return F.when(n > most, F.concat(F.lit(lead), n - most, F.lit(f" more{what}\n")))


def overview_context(nodes: DataFrame, edges: DataFrame, members: DataFrame, labels: DataFrame, cohesion: DataFrame, entries: DataFrame) -> DataFrame:
    """One row, ``context``: counts, communities with ten members each, ten entry points, kinds of symbols, as a text of fixed form."""
    own = cohesion.join(labels, "community_id")
    counts = nodes.agg(F.count(F.lit(1)).alias("s")).crossJoin(edges.agg(F.count(F.lit(1)).alias("e"))).crossJoin(own.agg(F.count(F.lit(1)).alias("m"))).crossJoin(entries.agg(F.count(F.lit(1)).alias("x")))  # one row each
    first = members.join(nodes.select("symbol_id", "name"), "symbol_id").withColumn("r", F.row_number().over(Window.partitionBy("community_id").orderBy("symbol_id"))).where("r <= 10")
    names = first.groupBy("community_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "name"))), lambda x: x["name"]), ", ").alias("names"))
    line = _text("**", F.col("label"), "** — ", F.col("n_members"), " members (cohesion: ", F.format_string("%.2f", F.col("cohesion")), ")", F.when(F.col("names").isNotNull(), F.concat(F.lit("\n   Members: "), "names", F.coalesce(F.when(F.col("n_members") > 10, F.concat(F.lit(" ... and "), F.col("n_members") - 10, F.lit(" more"))), F.lit("")))))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("community_id", line.alias("t")))), lambda x, i: F.concat(i + 1, F.lit(". "), x["t"]))
    comms = own.join(names, "community_id", "left").agg(F.array_join(listed, "\n").alias("comms"))
    ten = entries.orderBy(F.desc("score"), "symbol_id").limit(10)
    best = _listing(ten, [(-F.col("score")).alias("k"), "symbol_id"], _text("- **", F.col("name"), "** (score: ", F.format_string("%.2f", F.col("score")), ") — ", F.col("reason"))).withColumnRenamed("lines", "best")
    kinds = _listing(nodes.groupBy("kind").agg(F.count(F.lit(1)).alias("n")), [(-F.col("n")).alias("k"), "kind"], _text("- ", F.col("kind"), ": ", F.col("n"))).withColumnRenamed("lines", "kinds")
    text = _text(
        "# Repository Overview\n\n- **Symbols:** ", F.col("s"), "\n- **Relationships:** ", F.col("e"), "\n- **Communities:** ", F.col("m"), "\n\n",
        F.when(F.col("m") > 0, F.concat(F.lit("## Communities\n\n"), "comms", F.lit("\n\n"))),
        F.when(F.col("x") > 0, _text("## Entry Points\n\n", F.col("best"), "\n", _more(F.col("x"), 10, " entry points", "  ... and "), "\n")),
        F.when(F.col("s") > 0, F.concat(F.lit("## Symbol Kinds\n\n"), "kinds", F.lit("\n"))),
    )
    return counts.crossJoin(comms).crossJoin(best).crossJoin(kinds).select(bounded(text).alias("context"))


def community_contexts(nodes: DataFrame, edges: DataFrame, members: DataFrame, labels: DataFrame, cohesion: DataFrame) -> DataFrame:
    """community_id, context: fifty members and twenty edges that leave each community, the newest edge of a symbol first."""
    names = nodes.select("symbol_id", "name", "kind")
    held = members.join(names, "symbol_id").withColumn("r", F.row_number().over(Window.partitionBy("community_id").orderBy("symbol_id"))).where("r <= 50")
    listed = _listing(held, ["r"], _text("- **", F.col("name"), "** (", F.col("kind"), ")"), ["community_id"]).withColumnRenamed("lines", "held")
    leaving = labelled(edges, members).where("source_community <> target_community").withColumn("r", F.row_number().over(Window.partitionBy("source_community").orderBy("source_id", F.desc("edge_id"))))
    total = community_edges(edges, members).groupBy(F.col("source_community").alias("community_id")).agg(F.sum("weight").alias("out"))
    some = leaving.where("r <= 20").join(names.select(F.col("symbol_id").alias("source_id"), F.col("name").alias("a")), "source_id").join(names.select(F.col("symbol_id").alias("target_id"), F.col("name").alias("b")), "target_id").withColumnRenamed("source_community", "community_id")
    edges_ = _listing(some, ["r"], _text("- ", F.col("a"), " → ", F.col("b")), ["community_id"]).withColumnRenamed("lines", "ways")
    rows = cohesion.join(labels, "community_id").join(listed, "community_id", "left").join(total, "community_id", "left").join(edges_, "community_id", "left")
    text = _text(
        "# Community: ", F.col("label"), "\n\n- **ID:** ", F.col("community_id"), "\n- **Members:** ", F.col("n_members"), "\n- **Cohesion:** ", F.format_string("%.2f", F.col("cohesion")), "\n\n## Members\n\n",
        F.when(F.col("held").isNotNull(), F.concat("held", F.lit("\n"))), _more(F.col("n_members"), 50, " members", "\n... and "),
        F.when(F.col("out") > 0, _text("\n## External Dependencies\n\n", F.col("ways"), "\n", _more(F.col("out"), 20, " external edges", "\n... and "))),
    )
    return rows.select("community_id", bounded(text).alias("context"))


def symbol_contexts(nodes: DataFrame, edges: DataFrame, members: DataFrame, labels: DataFrame, most: int = 20) -> DataFrame:
    """symbol_id, context: kind, file, community and the ``most`` newest edges into and out of each symbol."""

    def side(own: str, other: str, name: str):
        each = edges.select("edge_id", F.col(own).alias("symbol_id"), F.col(other).alias("o")).withColumn("r", F.row_number().over(Window.partitionBy("symbol_id").orderBy(F.desc("edge_id"))))
        some = each.where(F.col("r") <= most).join(nodes.select(F.col("symbol_id").alias("o"), "name"), "o")
        n = edges.groupBy(F.col(own).alias("symbol_id")).agg(F.count(F.lit(1)).alias(f"{name}_n"))
        return _listing(some, ["r"], _text("- ", F.col("name")), ["symbol_id"]).withColumnRenamed("lines", name).join(n, "symbol_id")

    home = members.join(labels, "community_id").groupBy("symbol_id").agg(F.min_by("label", "community_id").alias("label"))
    rows = nodes.select("symbol_id", "name", "kind", "file_id").join(home, "symbol_id", "left").join(side("target_id", "source_id", "up"), "symbol_id", "left").join(side("source_id", "target_id", "down"), "symbol_id", "left")
    part = lambda head, name, what: F.when(F.col(name).isNotNull(), _text(f"## {head}\n\n", F.col(name), "\n", _more(F.col(f"{name}_n"), most, what), "\n"))
    text = _text(
        "# Symbol: ", F.col("name"), "\n\n- **Kind:** ", F.col("kind"), "\n- **Symbol ID:** ", F.col("symbol_id"), "\n- **File ID:** ", F.col("file_id"), "\n",
        F.when(F.col("label").isNotNull(), F.concat(F.lit("- **Community:** "), "label", F.lit("\n"))), "\n", part("Called By", "up", " callers"), part("Calls", "down", " callees"),
    )
    return rows.select("symbol_id", bounded(text).alias("context"))


def files_context(nodes: DataFrame, paths: list[str], most: int = 100) -> DataFrame:
    """One row, ``context``: the symbols of the files asked for (only those), ``most`` of them by name of file and id."""
    own = nodes.where(F.col("path").isin(*paths))
    some = _listing(own.orderBy("path", "symbol_id").limit(most), ["path", "symbol_id"], _text("- ", F.col("name"), " (", F.col("kind"), ")"))
    n = own.agg(F.count(F.lit(1)).alias("n"))
    return some.crossJoin(n).select(bounded(_text("# File Context\n\nRequested files: " + ", ".join(paths) + "\n\n## Symbols in Graph\n\n", F.col("lines"), "\n", _more(F.col("n"), most, " symbols", "\n... and "))).alias("context"))


def curriculum(members: DataFrame, labels: DataFrame, edges: DataFrame, entries: DataFrame, least: int = 5, most: int = 15) -> DataFrame:
    """chapter_id, position, title, community_id, difficulty, prerequisites (chapter ids), sections.

    The big picture first, then communities of at least ``least`` members (the ``most`` largest), each after
    what it depends on, then smaller ones together and a last chapter.  Only communities reach the driver.
    """
    spark = members.sparkSession
    sizes = {r["community_id"]: r["count"] for r in members.groupBy("community_id").count().collect()}
    names = {r["community_id"]: r["label"] for r in labels.collect()}
    deps = [(r["source_community"], r["target_community"]) for r in community_edges(edges, members).collect()]
    first = {r["community_id"] for r in entries.join(members, "symbol_id").select("community_id").distinct().collect()}
    main = sorted((c for c in sizes if sizes[c] >= least and names.get(c) != "misc"), key=lambda c: (-sizes[c], c))[:most]
    order = [c for c in com.topological(deps, sorted(sizes), first) if c in main]
    place = {c: k + 1 for k, c in enumerate(order)}
    rows = [(0, 0, "The Big Picture", None, 0, [])]
    for c in order:
        before = sorted(place[b] for a, b in set(deps) if a == c and b in place and place[b] < place[c])
        rows.append((place[c], place[c], names.get(c) or f"community_{c}", c, sizes[c], before))
    if any(c not in main for c in sizes):
        rows.append((len(rows), len(rows), "Supporting Modules", None, sum(n for c, n in sizes.items() if c not in main), []))
    rows.append((len(rows), len(rows), "Putting It All Together", None, 0, [r[0] for r in rows[1:]]))
    frame = spark.createDataFrame(rows, "chapter_id long, position long, title string, community_id long, n long, prerequisites array<long>")
    return frame.select("chapter_id", "position", format_label(F.col("title")).alias("title"), "community_id", difficulty(F.col("n")).alias("difficulty"), "prerequisites", F.array(*[F.lit(x) for x in SECTIONS]).alias("sections"))


def quiz(symbols: DataFrame, edges: DataFrame, members: DataFrame, labels: DataFrame, most: int = 5) -> DataFrame:
    """community_id, place, id, kind, question, options, correct_index, explanation: at most ``most`` questions on each community.

    In this order: what the first two members depend on, whom they call, which module holds the first, what the two
    extend, whom a change of the first affects.  A member without such an edge gets a statement that is false.  Any member
    gives three questions, so none is padded.  Members are taken by id, their edges newest first.  The texts are fixed values.
    """
    names = symbols.select("symbol_id", "name")
    nth = F.row_number().over(Window.partitionBy("community_id").orderBy("symbol_id")) - 1
    two = members.join(names, "symbol_id").withColumn("i", nth).where("i < 2").select("community_id", "symbol_id", "name", "i")
    newest = lambda df, key: df.withColumn("r", F.row_number().over(Window.partitionBy("community_id", key).orderBy(F.desc("edge_id")))).where("r <= 4")
    heads = two.select("community_id", F.col("symbol_id").alias("source_id"), "name", "i")
    out_edges = edges.join(heads, "source_id").join(names.select(F.col("symbol_id").alias("target_id"), F.col("name").alias("other")), "target_id")
    near = lambda df, keys: df.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "other"))), lambda x: x["other"]).alias("others"))
    down = near(newest(out_edges, "source_id"), ["community_id", "i"])
    asked = two.join(down, ["community_id", "i"], "left")
    q = lambda *x: _text("'", *x)
    yes = F.array(F.lit("True"), F.lit("False"))
    cols = lambda rank, kind, id_, question, options, right, why: [
        "community_id", F.lit(rank).alias("rank"), "i", F.concat(F.lit(f"q_{id_}_"), "community_id", F.lit("_"), "i").alias("id"), F.lit(kind).alias("kind"), question.alias("question"), options.alias("options"), right.cast("int").alias("correct_index"), why.alias("explanation"),
    ]
    name, first = F.col("name"), F.get("others", F.lit(0))
    dep = asked.where("others is not null").select(
        *cols(0, "multiple_choice", "dep", _text("Which symbol does '", name, "' depend on?"), F.slice(F.array_append("others", F.concat("name", F.lit("Helper"))), 1, 4), F.lit(0), q(name, "' has a direct dependency edge to '", first, "' in the knowledge graph."))
    )
    has, fake = first.isNotNull(), F.concat("name", F.lit("Processor"))
    callee = F.coalesce(first, fake)
    why = F.when(has, q(name, "' calls '", callee, "' as shown by the CALLS edge in the knowledge graph.")).otherwise(q(name, "' does not call '", callee, "' — there is no such edge in the knowledge graph."))
    call = asked.select(*cols(1, "true_false", "call", _text("True or False: '", name, "' calls '", callee, "'."), yes, F.when(has, 0).otherwise(1), why))
    # three labels besides its own are enough, and the four least ids hold them
    four = labels.orderBy("community_id").limit(4).agg(F.array_sort(F.collect_list(F.struct("community_id", "label"))).alias("known"))
    held = two.where("i = 0").join(labels, "community_id").crossJoin(F.broadcast(four))  # one row of four labels
    others = F.slice(F.transform(F.filter("known", lambda x: x["community_id"] != F.col("community_id")), lambda x: x["label"]), 1, 3)
    options = F.concat(F.array("label"), others)
    options = F.when(F.size(options) < 2, F.array_append(options, F.lit("Utilities"))).otherwise(options)
    member = held.select(*cols(2, "multiple_choice", "member", _text("Which module contains '", name, "'?"), options, F.lit(0), q(name, "' is a member of the '", F.col("label"), "' community.")))
    kin = out_edges.where("kind in ('EXTENDS', 'IMPLEMENTS')").groupBy("community_id", "i").agg(F.max_by(F.struct("other", "kind"), "edge_id").alias("kin"))
    base = two.join(kin, ["community_id", "i"], "left")
    verb, parent = F.when(F.col("kin.kind") == "IMPLEMENTS", "implements").otherwise("extends"), F.coalesce("kin.other", F.concat(F.lit("Base"), "name"))
    why = F.when(F.col("kin").isNotNull(), q(name, "' ", verb, " '", parent, "' as shown by the ", F.upper(verb), " edge in the knowledge graph.")).otherwise(q(name, "' does not extend '", parent, "' — there is no such edge in the knowledge graph."))
    heritage = base.select(*cols(3, "true_false", "heritage", _text("True or False: '", name, "' ", verb, " '", parent, "'."), yes, F.when(F.col("kin").isNotNull(), 0).otherwise(1), why))
    into = edges.join(two.where("i = 0").select("community_id", F.col("symbol_id").alias("target_id"), "i"), "target_id").join(names.select(F.col("symbol_id").alias("source_id"), F.col("name").alias("other")), "source_id")
    hit = two.join(near(newest(into, "target_id"), ["community_id", "i"]), ["community_id", "i"])
    why = _text("Changing '", name, "' would affect: ", F.array_join("others", ", "), ". These functions have direct dependency edges to '", name, "'.")
    impact = hit.select(*cols(4, "impact_analysis", "impact", _text("If you change '", name, "', which functions would be affected?"), F.array_append("others", F.lit("No other functions")), F.lit(0), why))
    all_ = dep.unionByName(call).unionByName(member).unionByName(heritage).unionByName(impact)
    place = F.row_number().over(Window.partitionBy("community_id").orderBy("rank", "i"))
    return all_.withColumn("place", place.cast("long")).where(F.col("place") <= most).select("community_id", "place", "id", "kind", "question", "options", "correct_index", "explanation")


def export(name: str, files: DataFrame, symbols: DataFrame, edges: DataFrame, members: DataFrame, labels: DataFrame, findings: DataFrame) -> DataFrame:
    """One row, ``document``: a repository's JSON export."""
    from .metrics import language_breakdown

    badges = language_breakdown(files).agg(F.array_sort(F.collect_list(F.struct((-F.col("percent")).alias("order"), "language", "percent"))).alias("languages"))
    sizes = members.groupBy("community_id").agg(F.count(F.lit(1)).alias("members")).join(labels, "community_id")
    modules = sizes.agg(F.array_sort(F.collect_list(F.struct((-F.col("members")).alias("order"), "community_id", "label", "members"))).alias("modules"))
    kinds = edges.groupBy("kind").count().agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "count")))).alias("edges"))
    counts = symbols.agg(F.count(F.lit(1)).alias("symbols")).crossJoin(files.agg(F.count(F.lit(1)).alias("files"), F.sum("sloc").alias("sloc")))
    issues = findings.groupBy("severity").count().agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("severity", "count")))).alias("findings"))
    doc = counts.crossJoin(badges).crossJoin(modules).crossJoin(kinds).crossJoin(issues).withColumn("repo", F.lit(name))  # each one row
    return doc.select(F.to_json(F.struct("repo", "files", "sloc", "symbols", "languages", "modules", "edges", "findings")).alias("document"))


def render(document: str, title: str) -> str:
    """A static page that carries an export's JSON."""
    safe = document.replace("</", "<\\/")
    name = title.replace("&", "&amp;").replace("<", "&lt;")
    return f"<!doctype html>\n<html><head><meta charset=utf-8><title>{name}</title></head><body><h1>{name}</h1><pre id=out></pre><script type=application/json id=data>{safe}</script><script>out.textContent=JSON.stringify(JSON.parse(data.textContent),null,2)</script></body></html>\n"
