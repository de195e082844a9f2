"""Facts come from every landed page, whatever a prober would have opened."""

from tests.test_discovery import facts


def test_listed_pages_count_without_pricing_or_plans(spark):
    got = facts(
        spark,
        ("m.ai", "/", "<p>x</p>"),
        ("m.ai", "/sitemap.xml", "<loc>https://m.ai/about</loc><loc>https://m.ai/free-stuff</loc>"),
        ("m.ai", "/free-stuff", "<p>a free trial worth $30 of claude</p>"),
    )["m.ai"]
    assert (got["has_pricing"], got["pricing_triggers"], got["amount"], got["models"]) == (True, True, 30.0, ["claude"])


def test_no_page_hides_another(spark):
    got = facts(
        spark,
        ("a.ai", "/", "<title>New API</title>"), ("a.ai", "/pricing", "free trial of gpt-4"), ("a.ai", "/plans", "$900 free credits"),
        ("a.ai", "/redeem", "claim your qwen"), ("a.ai", "/v1/models", '{"data": [{"id": "deepseek-r1"}]}'),
        ("a.ai", "/sitemap.xml", "<loc>https://a.ai/promo-1</loc><loc>https://a.ai/promo-2</loc><loc>https://a.ai/promo-3</loc>"),
        ("a.ai", "/promo-1", "free trial kimi"), ("a.ai", "/promo-2", "grok, $950 free credits"), ("a.ai", "/promo-3", "gone $999 free", 404),
        ("a.ai", "/docs", "made for mistral"),
        ("b.ai", "/", "<p>x</p>"), ("b.ai", "/about", "free trial"), ("b.ai", "/robots.txt", "# free trial of claude"),
        ("c.ai", "/robots.txt", "# nothing"),
    )
    a, b = got["a.ai"], got["b.ai"]
    assert set(a["models"]) == {"gpt", "qwen", "deepseek", "kimi", "grok", "mistral"}
    assert (a["amount"], a["is_relay"], a["engine"], a["pricing_triggers"]) == (950.0, True, "new-api", True)
    assert (b["has_pricing"], b["pricing_triggers"], b["models"]) == (False, False, [])
    assert "c.ai" not in got


def test_page_order_chooses_the_description(spark):
    tag = '<meta name="description" content="%s">'
    got = facts(
        spark,
        ("d.ai", "/", ""), ("d.ai", "/plans", tag % "the plans of this site are good"), ("d.ai", "/billing", tag % "the billing of this site"),
        ("e.ai", "/", ""), ("e.ai", "/a-free", tag % "first by path of this site"), ("e.ai", "/z-free", tag % "listed page of this site"),
        ("e.ai", "/sitemap.xml", "<loc>https://e.ai/z-free</loc>"),
    )
    assert got["d.ai"]["description"] == "the plans of this site are good"
    assert got["e.ai"]["description"] == "listed page of this site"
