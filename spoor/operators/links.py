"""Download links on pages, and the ledger of those that have been fetched."""

from __future__ import annotations

import html as markup
from urllib.parse import urljoin

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spoor.functions.text import strip

_ANCHOR = r"(?is)<a\b([^>]*)>(.*?)</a\s*>"
_HREF = r"(?is)\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"


_BASE = r"(?is)<base\b([^>]*\bhref\b[^>]*)>"


def resolved(url: str | None, base: str | None, href: str | None) -> str | None:
    """The absolute target of a link on a page at ``url`` with the base tag's target ``base``; as it stands if it cannot be resolved."""
    if href is None:
        return None
    try:
        return urljoin(urljoin(url or "", markup.unescape(base or "").strip()), markup.unescape(href).strip())
    except ValueError:
        return href


def links(pages: DataFrame, *, mark: str = "Download", page: str = "page_id", html: str = "html", url: str | None = None) -> DataFrame:
    """(page_id, ord, href, text, link_id) of anchors whose first own text contains ``mark`` and that have a target.

    text is all text within, trimmed; link_id is the md5 of target and text. url: the column of the page's address, by
    which (and by the page's base tag) targets are made absolute, in Python; without it they stay as they stand, so the
    pages must be of one site with absolute paths, and Spark's functions do all.
    """
    column = F.col(f"`{html}`")
    attributes, inner = (F.regexp_extract_all(column, F.lit(_ANCHOR), F.lit(g)) for g in (1, 2))
    tag = F.regexp_extract(column, _BASE, 1)
    base = F.coalesce(*[F.nullif(F.regexp_extract(tag, _HREF, g), F.lit("")) for g in (1, 2, 3)])
    at = [] if url is None else [F.col(f"`{url}`").cast("string").alias("url"), base.alias("base")]
    each = pages.select(F.col(f"`{page}`").alias("page_id"), *at, F.posexplode(F.arrays_zip(attributes.alias("a"), inner.alias("t"))).alias("ord", "x"))
    href = F.coalesce(*[F.nullif(F.regexp_extract(F.col("x.a"), _HREF, g), F.lit("")) for g in (1, 2, 3)])
    first = F.regexp_extract(F.regexp_replace(F.col("x.t"), r"^(?:<[^>]*>[^<]*</[^>]*>)+", ""), r"^([^<]*)", 1)
    text = strip(F.regexp_replace(F.col("x.t"), "<[^>]*>", ""))
    found = each.select("page_id", "ord", href.alias("href"), first.alias("first"), text.alias("text"), *([] if url is None else ["url", "base"]))
    found = found.where(F.contains("first", F.lit(mark)) & F.col("href").isNotNull())
    if url is not None:
        found = found.withColumn("href", F.udf(resolved, "string", useArrow=True)("url", "base", "href"))
    return found.select("page_id", "ord", "href", "text", F.md5(F.concat("href", "text")).alias("link_id"))


def unseen(found: DataFrame, ledger: DataFrame) -> DataFrame:
    """Links that are not in the ledger, each once: where it stands first."""
    fresh = found.join(ledger, "link_id", "left_anti")
    first = fresh.groupBy("link_id").agg(F.min(F.struct("page_id", "ord", "href", "text")).alias("x"))
    return first.select("x.page_id", "x.ord", "x.href", "x.text", "link_id")


def settle(attempts: DataFrame) -> DataFrame:
    """Of attempts (batch_id, link_id, status), those that would be made: a link is left out once it has been ok."""
    before = Window.partitionBy("link_id").orderBy("batch_id").rowsBetween(Window.unboundedPreceding, -1)
    done = F.coalesce(F.max(F.col("status") == "ok").over(before), F.lit(False))
    return attempts.withColumn("done", done).where("NOT done").drop("done")


def sweeps(attempts: DataFrame) -> DataFrame:
    """(batch_id, found, downloaded): of each sweep, the links that it tried and those that were fetched."""
    return settle(attempts).groupBy("batch_id").agg(F.count("*").alias("found"), F.count_if(F.col("status") == "ok").alias("downloaded"))


def fresh_files(before: DataFrame, after: DataFrame) -> DataFrame:
    """Paths that a later listing has in addition and that are no downloads in progress."""
    return after.join(before, "path", "left_anti").where(~F.col("path").endswith(".crdownload"))
