"""The text that a deal link carries into labelling holds the wording that it was found by."""

from leadlens.operators import ingest as I
from leadlens.sources import html_links


def deals(spark, page):
    pages = spark.createDataFrame(
        [(1, page, "https://deals.example/x", "deals")], "payload_id bigint, body string, page_url string, aggregator string"
    )
    return html_links.parse_deal_page(pages)


def test_wording_after_200_characters_reaches_the_pre_filter(spark):
    out = deals(spark, f"<p><a href='https://a.ai/x'>tool</a> {'word ' * 100} claude api with free credits worth $70</p>")
    assert out.first()["raw_text"].endswith("claude api with free credits worth $70")
    assert I.keep_matched(I.normalize(out)).count() == 1


def listed(links):
    """A long list in one element: models first, then the links, then the offer."""
    items = "".join(f"<a href='https://s{n}.ai/x'>tool{n}</a> {'word ' * 60}" for n in range(links))
    return f"<div>models opus and qwen, {items} 70 EUR of credits: free trial</div>"


def test_one_rule_for_any_number_of_links(spark):
    for links in (1, 8, 9, 40):
        got = I.rule_classifier(I.keep_matched(I.normalize(deals(spark, listed(links)))))
        rows = {r["url"]: r for r in got.select("url", "raw_text", "label.models").collect()}
        assert len(rows) == links
        for n in range(links):
            row = rows[f"https://s{n}.ai"]
            assert row["raw_text"].startswith(f"tool{n} models opus and qwen, tool0 word")
            assert row["raw_text"].endswith("70 EUR of credits: free trial")
            assert {m.lower() for m in row["models"]} >= {"opus", "qwen"}


def test_an_element_is_held_once():
    import re

    from leadlens.functions import html as H

    page = "<ul>" + "<li><a href='https://a.ai'>x</a> free trial</li>" * 3 + "</ul><p>" + "<a href='/y'>y</a>" * 1000 + "plain</p>"
    got = H._contexts_of(page, re.compile("free trial"))
    assert got["texts"] == ["x free trial"] * 3 + [" ".join(["y"] * 1000) + " plain"]
    assert [x["element"] for x in got["links"]] == [0, 1, 2] + [3] * 1000
    assert [x["matched"] for x in got["links"]] == [True] * 3 + [False] * 1000
