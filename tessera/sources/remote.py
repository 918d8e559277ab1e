"""Sources that answer in pages or after a while, as Spark data sources in batch and stream.

What fetches is a supplied function, which goes to the executors. A batch read has one partition for each query; a
stream's offset holds each query's token, so a stream that starts again goes on after the last page it has committed.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: Tries of one call, seconds before the second, and how much longer each wait is.
TRIES, WAIT, LONGER = 4, 0.5, 2.0
#: Pages of a query that one batch of a stream takes.
PAGES = 8


class Unavailable(Exception):
    """Raised by a supplied function for what may be there at the next try."""


def tried(call: Callable[[], object], tries: int = TRIES, wait: float = WAIT):
    """The result of ``call``, again after growing waits if it is unavailable; other errors at once, and the last one after all tries."""
    for n in range(tries):
        try:
            return call()
        except Unavailable:
            if n + 1 == tries:
                raise
            time.sleep(wait * LONGER**n)


class _Query(InputPartition):
    def __init__(self, query: str, begin: object = None, pages: int | None = None):
        super().__init__(query)
        self.query, self.begin, self.pages = query, begin, pages


def walked(fetch: Callable, query: str, begin: object, pages: int | None, wait: float) -> Iterator[tuple[list[tuple], object]]:
    """(rows, token of the next page) of pages from ``begin``; the last page has no token. A token that comes again is an error, not a loop."""
    token, seen = begin, set()
    while pages is None or len(seen) < pages:
        mark = json.dumps(token)
        if mark in seen:
            raise ValueError(f"the pages of {query!r} come round to {mark}")
        seen.add(mark)
        rows, token = tried(lambda at=token: fetch(query, at), wait=wait)
        yield rows, token
        if token is None:
            return


def paged(name: str, schema: str, fetch: Callable[[str, object], tuple[list[tuple], object]], queries: list[str], wait: float = WAIT, pages: int = PAGES) -> type[DataSource]:
    """A data source to register: all pages of all ``queries``.

    ``fetch(query, token)`` gives the rows of a page and the token of the next, None for none; the first token is None,
    tokens are JSON values. Rows come with the query before the columns of ``schema``. Without queries there are no rows.
    """

    class Reader(DataSourceReader):
        def partitions(self):
            return [_Query(q) for q in queries]

        def read(self, partition):
            if partition is not None:
                for rows, _ in walked(fetch, partition.query, None, None, wait):
                    yield from ((partition.query, *row) for row in rows)

    class Stream(DataSourceStreamReader):
        """An offset is a list of a query's next token each, ``[token, whether pages are left]``; what a query's pages lead to is asked when the batch is planned."""

        def __init__(self):
            self.last = None

        def initialOffset(self):
            return {q: [None, True] for q in queries}

        def latestOffset(self):
            begin = self.last or self.initialOffset()
            end = {}
            for q, (token, left) in begin.items():
                end[q] = [token, left]
                for _, token in walked(fetch, q, token, pages, wait) if left else ():
                    end[q] = [token, token is not None]
            self.last = end
            return end

        def partitions(self, start, end):
            self.last = end
            out = []
            for q, (token, left) in start.items():
                if left and [token, left] != end[q]:
                    out.append(_Query(q, token, end[q]))
            return out

        def read(self, partition):
            until = partition.pages
            for rows, token in walked(fetch, partition.query, partition.begin, None, wait):
                yield from ((partition.query, *row) for row in rows)
                if [token, token is not None] == until:
                    return

    class Paged(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return f"query string, {schema}"

        def reader(self, schema):
            return Reader()

        def streamReader(self, schema):
            return Stream()

    return Paged


def polled(name: str, schema: str, submit: Callable[[str], object], poll: Callable[[object], list[tuple] | None], items: list[str], partitions: int = 8, polls: int = 100, wait: float = WAIT) -> type[DataSource]:
    """A data source to register: what jobs for ``items`` end with.

    ``submit(item)`` gives a job or, at once, its rows as a list; ``poll(job)`` gives None until the rows are there. A
    job that is not done after ``polls`` polls, and any error of an item, gives a row with ``error`` and no values, so
    one item cannot fail the others. Items are dealt to ``partitions`` and submitted before any is waited for.
    """
    width = len(schema.split(","))

    class Part(InputPartition):
        def __init__(self, items: list[str]):
            super().__init__(items)
            self.items = items

    class Reader(DataSourceReader):
        def partitions(self):
            n = max(1, min(partitions, len(items)))
            return [Part(items[i::n]) for i in range(n)]

        def read(self, partition):
            open_ = {}
            for item in partition.items:
                try:
                    job = tried(lambda item=item: submit(item), wait=wait)
                    if isinstance(job, list):
                        yield from ((item, None, *row) for row in job)
                    else:
                        open_[item] = job
                except Exception as e:  # noqa: BLE001 - belongs to this item
                    yield (item, f"{type(e).__name__}: {e}", *[None] * width)
            for _ in range(polls):
                if not open_:
                    return
                for item, job in list(open_.items()):
                    try:
                        rows = tried(lambda job=job: poll(job), wait=wait)
                    except Exception as e:  # noqa: BLE001
                        del open_[item]
                        yield (item, f"{type(e).__name__}: {e}", *[None] * width)
                        continue
                    if rows is not None:
                        del open_[item]
                        yield from ((item, None, *row) for row in rows)
                if open_:
                    time.sleep(wait)
            for item in open_:
                yield (item, f"not done after {polls} polls", *[None] * width)

    class Polled(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return f"item string, error string, {schema}"

        def reader(self, schema):
            return Reader()

    return Polled
