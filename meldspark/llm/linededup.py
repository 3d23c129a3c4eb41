"""Line dedup by site-relative frequency (DataFrame operations only).

Pages are grouped by host. A line that stands on more than ``ratio`` of the host's pages is
boilerplate of that site and is dropped from all of them.

For each host, the lines that pass the ratio are gathered into one array. It cannot grow with the
host: their shares sum to at most the mean number of distinct lines a page, so there are at most
mean / ratio of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.scratch import materialize
from .urlfilter import url_host

#: Elements whose tags end a line, and elements without text of their own.
BLOCKS = ("address", "article", "aside", "blockquote", "body", "br", "dd", "div", "dl", "dt", "figure", "footer", "form", "h[1-6]", "head", "header", "hr", "html", "li", "main", "nav", "ol", "p", "pre", "section", "table", "td", "th", "title", "tr", "ul")
SILENT = ("script", "style")


def page_lines(html: Column) -> Column:
    """The text lines of a page: cut at line breaks and block tags, other tags removed, white space
    squeezed, empty lines left out. Null: an empty array."""
    text = F.coalesce(html, F.lit(""))
    text = F.regexp_replace(text, rf"(?is)<!--.*?-->|<(?:{'|'.join(SILENT)})\b[^>]*>.*?</(?:{'|'.join(SILENT)})\s*>", " ")
    text = F.regexp_replace(text, rf"(?i)</?(?:{'|'.join(BLOCKS)})(?:[\s/][^>]*)?>", "\n")
    text = F.regexp_replace(text, r"<[a-zA-Z/!][^>]*>", "")
    lines = F.split(F.regexp_replace(text, r"[ \t\r\f]+", " "), "\n")
    return F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: x != "")


def _key(line: Column) -> Column:
    return F.xxhash64(line)


def dedup_lines(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", ratio: float = 0.3, least_pages: int = 3, salts: int = 16) -> DataFrame:
    """A row for each row of ``pages``: page_id, host, n_lines, n_dropped, text (the kept lines).

    A line is dropped if it stands on at least ``least_pages`` of its host's pages and their share
    passes ``ratio``; a line that stands on a page twice counts once. Pages without host (null url,
    or none in it) belong to no site and keep all lines; null or empty pages have none and count as
    pages. Repeated rows count each. An empty table gives an empty result. Other columns are not
    read. Lines are compared by a 64-bit hash within a host.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), url_host(F.col(url_col)).alias("host"), page_lines(F.col(html_col)).alias("lines"))
    rows = rows.withColumn("keys", F.transform("lines", _key))
    sited = rows.where("host <> ''")
    # Both counts combine on the map side.
    totals = sited.groupBy("host").agg(F.count("*").alias("pages"))
    seen = sited.select("host", F.explode(F.array_distinct("keys")).alias("key")).groupBy("host", "key").agg(F.count("*").alias("n"))
    stock = seen.where(F.col("n") >= least_pages).join(totals, "host").where(F.col("n") > ratio * F.col("pages"))
    stock = stock.groupBy("host").agg(F.collect_set("key").alias("stock"))
    # A row per host and salt, so that a hot host's pages are joined in many tasks.
    stock = materialize(stock, "stock").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(salts)).cast("int"))
    joined = rows.join(stock, ["host", "salt"], "left")
    kept = F.when(F.col("stock").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda x: ~F.array_contains(F.col("stock"), _key(x))))
    out = joined.withColumn("kept", kept)
    return out.select("page_id", "host", F.size("lines").alias("n_lines"), (F.size("lines") - F.size("kept")).alias("n_dropped"), F.array_join("kept", "\n").alias("text"))
