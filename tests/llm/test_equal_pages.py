"""Copies of a page on one host, without an article element, keep their text."""

from rostrum.llm import html_text

from .test_pages_quality import pages, site


def test_equal_pages_keep_their_text(spark):
    page = lambda i: f"<html><body><div class=top>Motto</div><div class=body><p>Story {i}</div></body></html>"
    data = [(i, "http://two.com/", page(0)) for i in range(2)]
    data += [(10 + i, "http://groups.com/", page(i % 2)) for i in range(100)]
    data += [(200 + i, None, html) for i, _, html in site(20)]
    want = {i: "Motto Story 0" for i in range(2)} | {10 + i: f"Story {i % 2}" for i in range(100)}
    want |= {200 + i: f"Story {i} begins and ends {i}" for i in range(20)}
    for nodes in (1000, 0):
        assert {r.page_id: r.text for r in html_text.extract(pages(spark, data), broadcast_nodes=nodes).collect()} == want
