"""Pages fetched by URL. A page that cannot be had is a row with an error, not a failed job."""

from __future__ import annotations

import urllib.request
from collections.abc import Iterator
from urllib.error import HTTPError

import pyarrow as pa
from pyspark.sql import DataFrame

#: The longest wait for a page and its largest size.
TIMEOUT_MS = 10_000
MAX_BYTES = 5 << 20
#: Pages handed on at once; with MAX_BYTES it bounds a task's memory.
BATCH = 16


def page_of(url: str | None, timeout_ms: int = TIMEOUT_MS, max_bytes: int = MAX_BYTES) -> tuple[str | None, str | None]:
    """(html, error) of an http or https URL; one of them is None."""
    if not url or not url.lower().startswith(("http://", "https://")):
        return None, "not an http URL"
    try:
        asked = urllib.request.Request(url, headers={"Accept": "text/html,application/xhtml+xml"})
        with urllib.request.urlopen(asked, timeout=timeout_ms / 1000) as answer:
            said = answer.headers.get("content-length") or ""
            body = b"" if said.isdigit() and int(said) > max_bytes else answer.read(max_bytes + 1)
            if not body and said not in ("", "0") or len(body) > max_bytes:
                return None, f"page over {max_bytes} bytes"
            return body.decode(answer.headers.get_content_charset() or "utf-8", "replace"), None
    except HTTPError as e:
        return None, f"HTTP {e.code}"
    except (OSError, ValueError, LookupError) as e:
        return None, str(e) or type(e).__name__


def fetch_pages(urls: DataFrame, timeout_ms: int = TIMEOUT_MS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """pos, url, html and fetchError of each row of ``urls`` (pos, url).

    Repeated rows are fetched once each; as many pages are under way as there are
    tasks, so repartition ``urls`` to set the width.
    """

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                found = [page_of(u, timeout_ms, max_bytes) for u in part.column(1).to_pylist()]
                html, error = ([x[i] for x in found] for i in (0, 1))
                yield pa.record_batch([part.column(0), part.column(1), pa.array(html, pa.string()), pa.array(error, pa.string())], ["pos", "url", "html", "fetchError"])

    return urls.selectExpr("cast(pos as bigint) pos", "url").mapInArrow(fetch, "pos long, url string, html string, fetchError string")
