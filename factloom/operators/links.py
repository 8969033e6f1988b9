"""Links of pages and texts that lead to technical documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import url_key
from .tables import top_k

#: Titles that promise a technical document; links to PDF files count whatever their title.
TECHNICAL = r"(?i)ficha|cat[aá]logo|especifica[çc]|dados t[eé]cnicos|spec(?:ification)?s\b|data ?sheet"


def absolute(href: Column, base: Column) -> Column:
    """href seen from the page base, without its fragment: other schemes and hosts stay, . and .. are walked."""
    scheme, origin = F.regexp_extract(base, "^([A-Za-z][A-Za-z0-9+.-]*:)", 1), F.regexp_extract(base, "^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    path = F.regexp_extract(base, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    h = F.regexp_replace(F.trim(href), "#.*$", "")
    query = F.regexp_extract(h, r"(\?.*)$", 1)
    target = F.regexp_replace(h, r"\?.*$", "")
    whole = F.when(F.startswith(target, F.lit("/")), target).otherwise(F.concat(F.regexp_extract(F.when(path == "", "/").otherwise(path), "^(.*/)", 1), target))
    step = lambda done, x: F.when(x == "..", F.slice(done, F.lit(1), F.greatest(F.lit(1), F.size(done) - 1))).when(x == ".", done).otherwise(F.concat(done, F.array(x)))
    parts = F.split(F.regexp_replace(whole, r"/(\.\.?)$", "/$1/"), "/")
    walked = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")
    relative = F.when(h == "", F.regexp_replace(base, "#.*$", "")).when(target == "", F.concat(origin, path, query)).otherwise(F.concat(origin, walked, query))
    return F.when(h.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), h).when(F.startswith(h, F.lit("//")), F.concat(scheme, h)).otherwise(relative)


def document_links(pages: DataFrame, id_col: str, text_col: str, url_col: str, most: int = 8, technical: str = TECHNICAL) -> DataFrame:
    """(id_col, place, url, title): the first `most` technical links of each page, HTML anchors before Markdown links.

    Only http and https with a host and without a user's name; pictures never count. Links that differ by scheme,
    trackers or fragment count once, the first one stays. Null pages and pages without a base have none."""
    anchor, marked = r"(?is)<a\s[^>]*?href\s*=\s*[\"']([^\"'>]*)[\"'][^>]*>(.*?)</a\s*>", r"(?<!!)\[([^\]\n]+)\]\(<?([^\s)>]+)>?(?:\s+[^)]*)?\)"
    group = lambda p, i: F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(p), F.lit(i))
    plain = lambda t: F.trim(F.regexp_replace(F.regexp_replace(t, "<[^>]*>", " "), r"\s+", " "))
    pair = lambda href, title: F.struct(href.alias("href"), title.alias("title"))
    both = F.concat(F.zip_with(group(anchor, 1), group(anchor, 2), lambda h, t: pair(h, plain(t))), F.zip_with(group(marked, 2), group(marked, 1), lambda h, t: pair(h, t)))
    rows = pages.select(id_col, F.col(url_col).alias("_base"), F.posexplode(both).alias("_at", "_l"))
    rows = rows.select(id_col, "_at", absolute(F.col("_l.href"), F.col("_base")).alias("url"), F.col("_l.title").alias("title"))
    path = F.lower(F.regexp_extract("url", "^[A-Za-z]+://[^/?#]*([^?#]*)", 1))
    rows = rows.where(F.col("url").rlike("^(?i)https?://[^/?#@]+(?:[/?#]|$)") & ~path.rlike(r"\.(?:jpg|png|svg|webp)$") & (path.endswith(".pdf") | F.col("title").rlike(technical)))
    first = rows.groupBy(id_col, url_key(F.col("url")).alias("_k")).agg(F.min_by(F.struct("_at", "url", "title"), "_at").alias("l")).select(id_col, "l.*")
    return top_k(first, [id_col], [F.col("_at")], most).select(id_col, "place", "url", "title")
