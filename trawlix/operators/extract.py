"""Article extraction from captured pages, and what follows from it.

The scoring is our own, in the manner of readability tools: paragraphs give points to
the elements above them by their length and commas, less the share of links; the
best element's blocks are the article. Failures are rows with an error.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters a page's article needs, and the size a page may have.
CHAR_THRESHOLD = 100
MAX_BYTES = 5 * 1024 * 1024
SCHEMA = "url string, title string, content string, excerpt string, byline string, siteName string, length long, error string"
_SKIP = {"script", "style", "noscript", "template", "svg", "iframe", "form", "nav", "footer", "aside", "button", "select", "textarea"}
_BLOCK = {"p", "div", "article", "section", "main", "body", "td", "li", "ul", "ol", "table", "tr", "blockquote", "pre", "h1", "h2", "h3", "h4", "h5", "h6", "header", "figure", "dl", "dt", "dd"}
_VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}
_UNLIKELY = re.compile(r"comment|sidebar|advert|\bads?\b|banner|menu|footer|share|social|related|promo|cookie|popup", re.I)
_BLANK = re.compile(r"\n{3,}")
#: The characters of Unicode's category Zs, which DuckDB's trim takes off.
_SPACES = " \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u202f\u205f\u3000"


class _Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.meta, self.title, self.in_title, self.skip, self.link = {}, "", False, [], 0
        self.path = [0]  # open blocks, by number
        self.tags = [""]
        self.up, self.blocks = [-1], []  # parent of each block; [block, text, linked characters]
        self.fresh = True

    def handle_starttag(self, tag, attrs):
        if tag in _VOID:
            if tag == "meta":
                a = dict(attrs)
                self.meta[(a.get("name") or a.get("property") or "").lower()] = a.get("content") or ""
            elif tag == "br":
                self.handle_data("\n")
            return
        if self.skip or tag in _SKIP or _UNLIKELY.search(" ".join(v or "" for k, v in attrs if k in ("class", "id"))) and tag not in ("body", "article", "html"):
            if tag in _SKIP or tag in _BLOCK or self.skip:
                self.skip.append(tag)
                return
        if tag == "title":
            self.in_title = not self.title
        elif tag == "a":
            self.link += 1
        elif tag in _BLOCK:
            if self.tags[-1] == "p" or (tag == "li" and self.tags[-1] == "li"):
                self._close()
            self.up.append(self.path[-1])
            self.path.append(len(self.up) - 1)
            self.tags.append(tag)
            self.fresh = True

    def _close(self):
        self.path.pop()
        self.tags.pop()
        self.fresh = True

    def handle_endtag(self, tag):
        if self.skip:
            if tag in self.skip:
                while self.skip.pop() != tag:
                    pass
            return
        if tag == "title":
            self.in_title = False
        elif tag == "a":
            self.link = max(0, self.link - 1)
        elif tag in self.tags[1:]:
            while self.tags[-1] != tag:
                self._close()
            self._close()

    def handle_data(self, data):
        if self.in_title:
            self.title += data
        elif not self.skip:
            if self.fresh:
                self.blocks.append([self.path[-1], "", 0])
                self.fresh = False
            self.blocks[-1][1] += data
            self.blocks[-1][2] += len(data) if self.link else 0


def article_of(html: str | None, threshold: int = CHAR_THRESHOLD) -> dict:
    """title, content, excerpt, byline, siteName, length and error of a page."""
    none = {"title": "", "content": "", "excerpt": "", "byline": None, "siteName": None, "length": 0}
    if not html:
        return none | {"error": "empty page"}
    if len(html.encode("utf-8", "ignore")) > MAX_BYTES:
        return none | {"error": "page too large"}
    reader = _Reader()
    reader.feed(html)
    reader.close()
    blocks = [(at, " ".join(text.split()), linked / max(1, len(text))) for at, text, linked in reader.blocks if text.strip()]
    scores: dict[int, float] = {}
    for at, text, linked in blocks:
        points = (1 + text.count(",") + min(3, len(text) // 100)) * (1 - linked) if len(text) >= 25 else 0.2
        for step, share in enumerate((1.0, 1.0, 0.5, 0.3)):
            scores[at] = scores.get(at, 0) + points * share
            if reader.up[at] < 0:
                break
            at = reader.up[at]
    title = " ".join((reader.meta.get("og:title") or reader.title).split())
    best = max(scores, key=lambda k: (scores[k], -k), default=None)

    def inside(at: int) -> bool:
        while at >= 0:
            if at == best:
                return True
            at = reader.up[at]
        return False

    content = _BLANK.sub("\n\n", "\n\n".join(t for at, t, linked in blocks if best is not None and inside(at) and linked < 0.5)).strip()
    if not content:
        return none | {"title": title, "error": "no article"}
    excerpt = reader.meta.get("description") or content.split("\n\n")[0]
    return {
        "title": title, "content": content, "excerpt": excerpt, "byline": reader.meta.get("author") or None, "siteName": reader.meta.get("og:site_name") or None,
        "length": len(content), "error": None if len(content) >= threshold else "article too short",
    }


def _run(keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in SCHEMA.split(", ")][1:]
        kinds = {"length": pa.int64()}
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = [article_of(h) for h in part.column(part.schema.get_field_index("html")).to_pylist()]
                kept = [part.column(part.schema.get_field_index(k)) for k in keep]
                yield pa.record_batch([*kept, *[pa.array([r[n] for r in rows], kinds.get(n, pa.string())) for n in names]], [*keep, *names])

    return run


def extract_pages(pages: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` (url among them) of each page with its article."""
    types = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep)
    return pages.select(*keep, "html").mapInArrow(_run(keep), f"{types}, {SCHEMA.split(', ', 1)[1]}")


def article_elements(pages: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of each page with the content of its article element as it is marked up, and error.

    The element goes from the first ``<article`` to the last ``</article>``, as written. Each tag in it is a
    space, and only spaces at its ends go, so lengths are those of the markup and not of ``extract_pages``.
    A page's time is in proportion to its length, whatever it holds: no pattern is tried anew from many places.
    """
    inner = pages.select(*keep, F.regexp_extract("html", r"(?s)\A(?>.*?<article)[^>]*+>(.*)</article>", 1).alias("_inner"))
    tail = inner.withColumn("_tail", F.substring_index("_inner", ">", -1))  # without a tag, as nothing closes one
    marked = F.left("_inner", F.length("_inner") - F.length("_tail"))
    content = F.btrim(F.concat(F.regexp_replace(marked, "<[^>]*+>", " "), "_tail"), F.lit(_SPACES))
    found = tail.select(*keep, F.coalesce(content, F.lit("")).alias("content"))
    return found.withColumn("error", F.when(F.col("content") == "", F.lit("no article")))


def succeeded(extracted: DataFrame) -> DataFrame:
    """Rows without an error and with more than 100 characters."""
    return extracted.where((F.coalesce("error", F.lit("")) == "") & (F.coalesce(F.length("content"), F.lit(0)) > CHAR_THRESHOLD))


def extraction_stats(extracted: DataFrame) -> DataFrame:
    good = (F.coalesce("error", F.lit("")) == "") & (F.coalesce(F.length("content"), F.lit(0)) > CHAR_THRESHOLD)
    return extracted.agg(F.count("*").alias("total"), F.count_if(good).alias("success"), F.count_if(~good).alias("failed"))


def urls_of(urls: list[str] | None = None, session: DataFrame | None = None, from_json: DataFrame | None = None) -> DataFrame:
    """(pos, url) of what to extract: named urls, else a session's results, else a results file's."""
    if urls:
        from pyspark.sql import SparkSession

        return SparkSession.active().createDataFrame(list(enumerate(urls)), "pos long, url string")
    for source in (session, from_json):
        if source is not None:
            found = source.where(F.col("url").isNotNull() & (F.col("url") != "")).select("pos", "url")
            if found.isEmpty():
                raise ValueError("SESSION_EMPTY" if source is session and source.isEmpty() else "NO_URLS")
            return found
    raise ValueError("MISSING_INPUT")


def extract_fetched(fetched: DataFrame) -> DataFrame:
    """pos, url and the article of fetched pages (pos, url, html, fetchError); a page that was not had keeps its error."""
    found = extract_pages(fetched, ["pos", "url", "fetchError"])
    return found.withColumn("error", F.coalesce("fetchError", "error")).drop("fetchError")
