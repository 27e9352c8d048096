"""Page assembly with keyed state: a document is emitted when its last page is in, or when it is overdue.

State per document: the numbers of the pages that have come, with their region arrays, and how many pages the document has. A page
that comes again replaces nothing (the first reading stays); a document that is complete leaves no state, and a
page of it that comes later than the watermark allows is dropped by the watermark like any other late row.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LATE = "1 hour"
#: Seconds of event time after its newest page that an incomplete document waits.
WAIT = 600
OUT = "doc_id long, pages array<int>, expected int, complete boolean, regions array<string>"
#: Pages by number, each with its regions as text; pages expected; emitted already (kept until overdue, so that repeats don't emit again); newest page.
STATE = "pages array<int>, regions array<string>, expected int, done boolean, newest long"


def assembled(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState, wait: int = WAIT) -> Iterator[pd.DataFrame]:
    """Adds a batch's pages to a document's state; emits it once, complete, or as far as it came when its time is out."""
    pages, regions, expected, done, newest = state.get if state.exists else ([], [], 0, False, 0)
    held = dict(zip(pages, regions, strict=True))
    if state.hasTimedOut:
        state.remove()
        if not done:
            yield _row(key, held, expected, False)
        return
    for rows in batches:
        for page, count, text, ts in zip(rows["page_no"], rows["page_count"], rows["regions"], rows["ts"], strict=True):
            held.setdefault(int(page), text)
            expected = max(expected, 0 if pd.isna(count) else int(count))
            newest = max(newest, int(ts.timestamp() * 1000))
    whole = expected > 0 and set(range(expected)) <= held.keys()
    if whole and not done:
        yield _row(key, held, expected, True)
    done = done or whole
    numbers = sorted(held)
    state.update((numbers, ["" if done else held[n] for n in numbers], expected, done, newest))
    state.setTimeoutTimestamp(max(newest + wait * 1000, state.getCurrentWatermarkMs() + 1))


def _row(key: tuple, held: dict[int, str], expected: int, complete: bool) -> pd.DataFrame:
    numbers = sorted(held)
    return pd.DataFrame({"doc_id": [key[0]], "pages": [numbers], "expected": [expected], "complete": [complete], "regions": [[held[n] for n in numbers]]})


def assemble_pages(pages: DataFrame, late: str = LATE, wait: int = WAIT) -> DataFrame:
    """doc_id, pages, expected, complete, regions of documents as they become whole; of those that never do, after ``wait`` seconds.

    ``pages``: doc_id, page_no (from 0), page_count (null where not known yet), regions (text of a page's regions), ts.
    """
    rows = pages.select("doc_id", F.col("page_no").cast("int"), F.col("page_count").cast("int"), F.col("regions").cast("string"), F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", late)
    step = lambda key, batches, state: assembled(key, batches, state, wait)
    return rows.groupBy("doc_id").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
