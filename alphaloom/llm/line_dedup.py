"""Site-relative removal of boilerplate lines.

For every host, the share of its pages that contain a line is the number of such pages over
the number of the host's pages; lines whose share exceeds ``ratio`` (on at least ``min_pages``
pages) are boilerplate there. At most ``average distinct lines a page / ratio`` lines of a
host can exceed it, so a host's boilerplate is one short array that joins its pages.

Edge cases: a null text has no lines and stays null; lines without a visible character are
never counted or dropped; a line repeated inside a page counts once; a null host is a host of
its own; pages of one host may hold any share of the rows (no task gathers a host's pages);
an empty table gives an empty result; columns pass through, except those named like a result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RATIO = 0.05
MIN_PAGES = 4


def url_host(url: str) -> F.Column:
    """Host of a url column, lower-case; null where there is none."""
    return F.lower(F.expr(f"parse_url(regexp_extract({url}, '^[A-Za-z]+://[^/?#\\\\s]+', 0), 'HOST')"))


def boilerplate(pages: DataFrame, host: str, text: str, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """``host``, ``pages`` of the host and ``lines``: its boilerplate lines, sorted; only hosts that have some."""
    p = pages.select(F.col(host).alias("host"), F.col(text).alias("_t"))
    lines = p.selectExpr("host", "explode(array_distinct(filter(split(_t, '\\n'), l -> l RLIKE '[^\\\\x20\\\\x09-\\\\x0D]'))) AS line")
    often = lines.groupBy("host", "line").agg(F.count(F.lit(1)).alias("on")).filter(F.col("on") >= min_pages)
    sizes = p.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    over = often.join(sizes, often["host"].eqNullSafe(sizes["host"])).filter(F.col("on") > ratio * F.col("pages"))
    return over.groupBy(often["host"].alias("host")).agg(F.max("pages").alias("pages"), F.array_sort(F.collect_list("line")).alias("lines"))


def drop_boilerplate(pages: DataFrame, host: str, text: str, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """``pages`` with ``text`` rid of its host's boilerplate lines, plus ``n_lines`` and ``n_dropped`` (lines with a visible character)."""
    marks = boilerplate(pages, host, text, ratio, min_pages).select(F.col("host").alias("_host"), F.col("lines").alias("_bad"))
    pages = pages.select(*[F.col(f"`{c}`") for c in pages.columns if c in (host, text) or c.lower() not in ("n_lines", "n_dropped", "_host", "_bad", "_all", "_kept")])
    out = pages.join(marks, F.col(host).eqNullSafe(F.col("_host")), "left").drop("_host")
    own = [f"`{c}`" for c in pages.columns]
    out = out.selectExpr(*own, "_bad", f"split(`{text}`, '\\n') AS _all")
    out = out.selectExpr(*own, "_all", "CASE WHEN _bad IS NULL THEN _all ELSE filter(_all, l -> NOT array_contains(_bad, l)) END AS _kept")
    return out.selectExpr(
        *[f"array_join(_kept, '\\n') AS `{c}`" if c == text else f"`{c}`" for c in pages.columns],
        "CAST(coalesce(size(filter(_all, l -> l RLIKE '[^\\\\x20\\\\x09-\\\\x0D]')), 0) AS BIGINT) AS n_lines",
        "CAST(coalesce(size(_all) - size(_kept), 0) AS BIGINT) AS n_dropped",
    )
