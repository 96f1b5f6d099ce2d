"""A block list given as a table, and the edges of the URL filter."""

import pytest

from meterbook.llm import bloom_cascade as B

PAGES = "page_id bigint, url string, host string, rule string"
URLS = ["http://a.net/x", "http://A.net/y", "https://b.net", "no url", None, "http://sub.a.net/", "http://a.org/p",
        "http://free-bets.net/", "http://a.net/x"]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(i, u, "clash", "clash") for i, u in enumerate(URLS)], PAGES)


def verdicts(frame):
    return {r.page_id: (r.host, r.verdict) for r in frame.collect()}


def test_a_table_of_hosts_is_the_block_list(spark, pages):
    blocked = spark.createDataFrame([("A.net",), ("a.net",), (None,), ("unseen.example",)], "name string")
    got = verdicts(B.judge_urls(pages, blocked=blocked))
    assert {i for i, (_, v) in got.items() if v == "block"} == {0, 1, 8}
    assert got[3] == got[4] == ("", "allow") and got[1][0] == "a.net" and len(got) == len(URLS)


def test_labels_are_the_list_without_one(pages):
    assert {i for i, (_, v) in verdicts(B.judge_urls(pages)).items() if v == "block"} == {7}


def test_empty_tables(spark, pages):
    none = spark.createDataFrame([], "name string")
    assert {v for _, v in verdicts(B.judge_urls(pages, blocked=none)).values()} == {"allow"}
    assert B.judge_urls(pages.limit(0)).count() == 0
    assert B.judge_urls(pages.limit(0), blocked=none).count() == 0
