"""Rows out of HTML: trending lists by the standard parser, flat facts by expressions."""

from __future__ import annotations

from html.parser import HTMLParser

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

REPO = "owner string, name string, description string, language string, stars_today long, total_stars long, url string, clone_url string"
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class _Trending(HTMLParser):
    """Collects, of every ``article.Box-row``, the texts of the few elements that matter."""

    def __init__(self):
        super().__init__()
        self.rows, self.row, self.stack = [], None, []

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        classes = (a.get("class") or "").split()
        if tag == "article" and "Box-row" in classes:
            self.row = {"href": None, "p": None, "lang": None, "text": [], "muted": []}
            self.rows.append(self.row)
        if self.row is not None:
            mark = None
            if tag == "a" and "h2" in [t for t, _ in self.stack] and self.row["href"] is None:
                self.row["href"] = a.get("href") or ""
            if tag == "p" and self.row["p"] is None:
                self.row["p"], mark = [], "p"
            if tag == "span" and a.get("itemprop") == "programmingLanguage" and self.row["lang"] is None:
                self.row["lang"], mark = [], "lang"
            if tag == "a" and "Link--muted" in classes:
                self.row["muted"].append([])
                mark = "muted"
            if tag not in _VOID:
                self.stack.append((tag, mark))

    def handle_endtag(self, tag):
        while self.row is not None and self.stack and any(t == tag for t, _ in self.stack):
            if self.stack.pop()[0] == tag:
                break
        if tag == "article":
            self.row, self.stack = None, []

    def handle_data(self, data):
        if self.row is None:
            return
        self.row["text"].append(data)
        for _, mark in self.stack:
            if mark == "muted":
                self.row["muted"][-1].append(data)
            elif mark:
                self.row[mark].append(data)


def _number(text: str) -> int | None:
    digits = "".join(c for c in text if c in "0123456789")
    return int(digits) if digits else None


def parse_trending(html: str | None) -> list[dict]:
    """Repositories of a trending page; a row without an owner/name link is skipped."""
    parser = _Trending()
    parser.feed(html or "")
    out = []
    for row in parser.rows:
        parts = (row["href"] or "").strip("/").split("/")
        if len(parts) < 2:
            continue
        today = next((_number(x) for x in "".join(row["text"]).splitlines() if any(f"stars {w}" in x for w in ("today", "this week", "this month")) and _number(x) is not None), None)
        total = next((n for t in row["muted"] if (n := _number("".join(t)))), None)
        full = f"{parts[0]}/{parts[1]}"
        out.append({"owner": parts[0], "name": parts[1], "description": "".join(row["p"] or ()).strip() or None, "language": "".join(row["lang"] or ()).strip() or None, "stars_today": today, "total_stars": total, "url": f"https://github.com/{full}", "clone_url": f"https://github.com/{full}.git"})
    return out


def trending(pages: DataFrame) -> DataFrame:
    """``pages(html)`` -> repositories."""

    schema = to_arrow_schema(StructType.fromDDL(REPO))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_pylist([r for html in batch.column(0).to_pylist() for r in parse_trending(html)], schema=schema)

    return pages.select("html").mapInArrow(run, REPO)


def page_facts(pages: DataFrame) -> DataFrame:
    """page_id, title (first h1), n_links, first_href by expressions alone."""
    html = F.coalesce("html", F.lit(""))
    hrefs = F.regexp_extract_all(html, F.lit('href="([^"]*)"'), F.lit(1))
    return pages.select("page_id", F.regexp_extract(html, r"(?s)<h1[^>]*>([^<]*)", 1).alias("title"), F.size(hrefs).cast("long").alias("n_links"), F.coalesce(F.get(hrefs, F.lit(0)), F.lit("")).alias("first_href"))


def trending_url(language: str | None = None, since: str = "daily") -> str:
    return f"https://github.com/trending{'/' + language if language else ''}?since={since}"


def fingerprint(owner, name, commit) -> F.Column:
    """SHA-256 of owner/name@commit."""
    return F.sha2(F.concat(owner, F.lit("/"), name, F.lit("@"), commit), 256)


def not_yet_done(found: DataFrame, done: DataFrame) -> DataFrame:
    """Harvested rows whose fingerprint no complete or skipped one has."""
    return found.join(done.where(F.col("status").isin("complete", "skipped")).select("fingerprint"), "fingerprint", "left_anti")
