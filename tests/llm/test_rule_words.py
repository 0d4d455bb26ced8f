"""The word of each rule, allow or block, is that of the contract."""

from shapeloom.llm import url_filters


def test_words_of_all_rules(spark):
    urls = ["http://a.com/en/1", "http://example.com/en/7", "http://n.net/de/1", "http://x.N.NET/de/2?ref=1", "http://example.net/de/7", "http://example.net/de/8", "http://o.org/es/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    listed = spark.createDataFrame([("n.net/de/1",), ("example.com/en/7",)], "key string")
    got = [(r.rule, r.verdict) for r in url_filters.filter_urls(pages, listed).orderBy("page_id").collect()]
    net = ("net/de/", "allow")
    assert got == [("com/en/", "block"), ("example.com/en/7", "allow"), net, net, net, ("example.net/de/8", "block"), ("org/es/", "block")]
