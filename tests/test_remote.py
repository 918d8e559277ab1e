"""Paged and polled sources with a fake provider: retries, restarts, failures of single items."""

import os

import pytest

from tessera.sources import remote


def counter(folder):
    """How often something was asked for before, by files that all processes share."""

    def counted(name):
        import os

        os.makedirs(folder, exist_ok=True)
        n = len([x for x in os.listdir(folder) if x.startswith(f"{name}#")])
        open(f"{folder}/{name}#{n}", "w").close()
        return n

    return counted


def test_all_pages_of_all_queries(spark, tmp_path):
    folder = str(tmp_path / "asked")
    counted = counter(folder)

    def fetch(query, token):
        at = token or 0
        if counted(f"{query}-{at}") == 0 and at == 2:
            raise remote.Unavailable
        return [(at * 10 + i, f"{query}{i}") for i in range(3)], (at + 1 if at < {"a": 4, "b": 0}[query] else None)

    spark.dataSource.register(remote.paged("pages_of_a_test", "position long, title string", fetch, ["a", "b"], wait=0.01))
    rows = spark.read.format("pages_of_a_test").load()
    assert sorted(tuple(r) for r in rows.collect()) == sorted((q, p * 10 + i, f"{q}{i}") for q, n in (("a", 5), ("b", 1)) for p in range(n) for i in range(3))
    assert len([x for x in os.listdir(folder) if x.startswith("a-2#")]) == 2
    spark.dataSource.register(remote.paged("no_pages_of_a_test", "position long, title string", fetch, []))
    assert spark.read.format("no_pages_of_a_test").load().count() == 0


def test_tries_end_and_loops_are_errors():
    calls = []

    def away():
        calls.append(1)
        raise remote.Unavailable

    with pytest.raises(remote.Unavailable):
        remote.tried(away, tries=3, wait=0.001)
    assert len(calls) == 3
    with pytest.raises(KeyError):
        remote.tried(lambda: {}["x"], wait=9)
    with pytest.raises(ValueError):
        list(remote.walked(lambda q, t: ([], "again"), "q", None, None, 0))


def test_a_stream_that_starts_again_reads_no_page_twice(spark, tmp_path):
    end = str(tmp_path / "pages")

    def fetch(query, token):
        at = token or 0
        last = int(open(end).read())
        # the last page so far leads to one that has nothing yet
        return [(at,)] if at <= last else [], (at + 1 if at < last else None)

    spark.dataSource.register(remote.paged("stream_of_a_test", "page long", fetch, ["a", "b"], wait=0.01, pages=2))

    def run():
        stream = spark.readStream.format("stream_of_a_test").load().writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        assert stream.awaitTermination(120)
        return sorted((r["query"], r.page) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    with open(end, "w") as f:
        f.write("6")
    first = run()
    assert len(first) == len(set(first)) and first
    for _ in range(5):
        again = run()
        assert len(again) == len(set(again)) and set(first) <= set(again)
        first = again
        if len(first) == 14:
            break
    assert first == sorted((q, p) for q in "ab" for p in range(7))


def test_jobs_are_waited_for_and_fail_alone(spark, tmp_path):
    counted = counter(str(tmp_path / "polls"))

    def submit(item):
        if item == "broken":
            raise KeyError("no such video")
        return [("at once", 0)] if item == "known" else f"job-{item}"

    def poll(job):
        if job == "job-lost":
            raise RuntimeError("gone")
        n = counted(job)
        return None if job == "job-never" or n < 3 else [(f"text of {job}", n), ("more", n)]

    spark.dataSource.register(remote.polled("jobs_of_a_test", "text string, polls long", submit, poll, ["slow", "known", "broken", "lost", "never"], partitions=2, polls=6, wait=0.01))
    found = {}
    for r in spark.read.format("jobs_of_a_test").load().collect():
        found.setdefault(r["item"], []).append((r.error, r.text, r.polls))
    assert found["slow"] == [(None, "text of job-slow", 3), (None, "more", 3)] and found["known"] == [(None, "at once", 0)]
    assert found["broken"][0][0].startswith("KeyError") and found["lost"][0][0] == "RuntimeError: gone" and found["never"] == [("not done after 6 polls", None, None)]
