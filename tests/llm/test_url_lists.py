"""A list of hosts with repeated keys."""

from matchbook.llm import urlfilter


def test_repeated_blocked_hosts_do_not_multiply_pages(spark, monkeypatch):
    pages = spark.createDataFrame([(i, f"https://h{i % 5}.test/{i}") for i in range(50)], "page_id long, url string")
    hosts = spark.createDataFrame([("h1.test",), ("h1.test",), ("h2.test",), (None,)], "key string")

    def judged():
        return sorted((r.page_id, r.verdict, r.listed_host) for r in urlfilter.filter_urls(pages, blocked_hosts=hosts).collect())
    by_cascade = judged()
    build = urlfilter.build_cascade
    monkeypatch.setattr(urlfilter, "build_cascade",
                        lambda listed, universe, name: None if name == "hosts" else build(listed, universe, name))
    assert judged() == by_cascade and len(by_cascade) == 50
    assert [i for i, verdict, _ in by_cascade if verdict == "block"] == [i for i in range(50) if i % 5 in (1, 2)]
