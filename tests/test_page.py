import pytest
from pyspark.sql import functions as F

from vitrine.functions import colours, html, page, prices
from vitrine.operators import catalogue, mentions

NB = " "


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column.alias("x")).first()["x"]


@pytest.fixture(autouse=True)
def _columns(spark):
    globals().update(T=F.col("t"), H=F.col("h"))


def test_text_signals(spark):
    o = one(spark, page.offers(T), t=f"Up{NB}to 40% off bags. Extra 15% today! Mid season sale. 95% wool")
    assert o["headline_offer"] == "up to 40% off" and o["max_discount_pct"] == 40 and o["offers"][0] == "up to 40% off"
    assert one(spark, page.offers(T), t=None)["offers"] == []
    assert one(spark, page.delivery(T), t="Free UK delivery over £30. Next day delivery. Next day delivery")[:2] == ["next day delivery", "free uk delivery over £30"]
    assert one(spark, page.offer_strength(T), t=f"50{NB}% off") == 50
    assert one(spark, page.discount_codes(T), t="Use code: SAVE20 or code HTML; with code ab") == ["SAVE20"]
    assert one(spark, page.free_delivery_threshold(T), t="free delivery over £50") == 50
    assert one(spark, page.free_delivery_threshold(T), t="free shipping") == 0
    assert one(spark, page.free_delivery_threshold(T), t="delivery £3") is None
    assert one(spark, page.first_order_offer(T), t="Get 15% off your first order") == "15% off"
    assert one(spark, page.first_order_offer(T), t="£5 off when you sign up") == "£5 off"
    assert one(spark, page.first_order_offer(T), t="80% off when you join our list") is None


def test_product_mix_counts_word_starts(spark):
    mix = one(spark, page.product_mix(T, {"rings": ["ring"], "ears": ["earring"]}), t="A ring, two rings, an earring; érings")
    assert [(m["category"], m["count"], m["share"]) for m in mix] == [("rings", 2, 0.6667), ("ears", 1, 0.3333)]


def test_trading_and_policy(spark):
    s = one(spark, page.trading_signals(H, T), t="Only 3 left. Ends midnight! Buy 2 get 1 free. Earn points. Free engraving. Live chat", h="<script src=klarna.js></script>")
    assert s["finance"] == ["Klarna"] and s["has_bnpl"] and s["scarcity"] == ["only 3 left"] and s["live_chat"] == "copy" and s["loyalty"] == "earn points"
    d = one(spark, page.delivery_page(T), t="Next-day delivery - £4.95\nStandard delivery: free. Order by 9 pm. Click & collect")
    assert [tuple(x) for x in d["options"]] == [("Next-Day Delivery", "£4.95"), ("Standard Delivery", "free")] and d["express"] and d["express_cutoff"] == "9pm" and d["click_collect"]
    r = one(spark, page.returns_page(T), t="You have 30 days to return. Returns are free. Exchanges welcome")
    assert (r["window_days"], r["free_returns"], r["exchanges"]) == (30, True, True)
    assert one(spark, page.returns_page(T), t="")["free_returns"] is None
    known = one(spark, page.with_known_express(page.delivery_page(T), F.lit(True)), t="standard delivery")
    assert known["express"] and known["express_source"] == "config"


def test_reputation(spark):
    blob = '{"aggregateRating":{"ratingValue":"9.2","bestRating":"10","reviewCount":"1,200"}} {"aggregateRating":{"ratingValue":4.1,"reviewCount":3}} trustpilot'
    r = one(spark, page.reputation(H, T, F.array(F.lit("Feefo"))), t="", h=blob)
    assert (r["rating"], r["review_count"], r["platforms"], r["source"], r["confidence"]) == (4.6, 1200, ["Trustpilot", "Feefo"], "structured", "high")
    assert one(spark, page.reputation(H, T), t="rated 4.8 out of 5 from 2,310 reviews", h="")["rating"] == 4.8
    assert one(spark, page.reputation(H, T), t="5 stars", h="")["rating"] is None


def test_blocked_and_urls(spark):
    assert one(spark, page.blocked(H), h="<title>Just a moment...</title>").startswith("title")
    assert one(spark, page.blocked(H), h="<title>Shop</title><p>just a moment</p>") is None
    assert one(spark, page.url_offer(T), t="https://x.example/a/summer-sale-50-off.jpg?v=1") == "a summer sale 50% off"
    assert one(spark, page.url_offer(T), t="/20-off-shoulder-top") is None


def test_prices(spark):
    h = '{"title":"Gift wrap","price":"3.00"},{"title":"Tote","price":"40"},{"price":12.5,"name":"Mug"}'
    p = one(spark, prices.scan(H, T), h=h, t="Tote £40.00\nGift card £10 Mug £12.50")
    assert p["structured"] == [40.0, 12.5] and p["visible"] == [40.0, 12.5]
    band = one(spark, page.price_band(F.array(F.lit(1.0), F.lit(2.0), F.lit(10.0), F.lit(13.0), F.lit(0.5))), t="")
    assert (band["count"], band["p25"], band["median"], band["p75"]) == (4, 1.75, 6.0, 10.75)
    assert one(spark, page.price_band(F.array().cast("array<double>")), t="")["median"] is None
    home = one(spark, page.home_band(F.transform(F.sequence(F.lit(1), F.lit(50)), lambda x: x.cast("double"))), t="")
    assert (home["count"], home["currency"], home["median"], len(home["sample"])) == (50, "GBP", 25.5, 30)
    far = '"title":"Gift card"' + " " * 275 + '"price":5,"price":6' + " " * 290 + '"name":"Donation"'
    assert prices.titled_prices(far) == [(5.0, "Gift card"), (6.0, "")]
    shown = one(spark, prices.scan(H, T, F.array(F.lit("Ribbon")), F.array(F.lit(9.0))), h=None, t=f"Gift wrap £2 tote £{NB}30\nribbon\n£4 ribbon £5 £9.00 scarf £12.345")
    assert shown["visible"] == [30.0, 4.0, 12.34] and shown["structured"] == []
    pairs = one(spark, page.sale_pairs(H, T), h='{"price":"20","compare_at_price":"35"}{"price":9,"compare_at_price":9}', t="was £40 now £25")
    assert [tuple(x) for x in pairs] == [(35.0, 20.0), (40.0, 25.0)]


PAGE = """<html lang="en"><head><title>Shop</title><meta name="viewport" content="w"><meta property="og:title" content="Shared"></head><body>
<a href="#main">Skip to content</a><header><nav><ul><li><a href="/new">New</a><ul><li><a>Sub</a></ul><li><a href="/bags">Bags</a><li><a href="/login">Login</a></ul></nav></header>
<main><h1>Hello</h1><a href="/sale"><img src="/x.jpg" alt="Up to 60% off everything"></a><img src="/logo.png" alt="Shop logo"><form><label>Name <input type=text></label><input type=email><button></button></form></main>
<footer><a href="/pages/shipping">Shipping</a> <a href="https://o.example/returns">Returns &amp; refunds</a></footer></body>"""


def test_markup_pass(spark):
    df = spark.createDataFrame([(1, "https://s.example/", PAGE), (2, None, None), (3, "x", "<<<p>><a <b"), (4, "", "<div>" * 3000)], "id int, url string, html string")
    p = html.parsed(df)
    r = {x["id"]: x for x in p.select("id", "page.*", html.hero(F.lit(None).cast("string")).alias("hero"), html.accessibility().alias("a"), html.seo().alias("seo")).collect()}
    assert r[1]["menu"] == ["New", "Bags"] and r[1]["banners"] == ["Up to 60% off everything"] and r[1]["hero"] == "Up to 60% off everything"
    assert r[1]["delivery_url"] == "https://s.example/pages/shipping" and r[1]["returns_url"] == "https://o.example/returns"
    ratios = {c["check"]: c["ratio"] for c in r[1]["a"]["checks"]}
    assert ratios["form_labels"] == 0.5 and ratios["button_name"] == 0.0 and ratios["landmarks"] == 1.0 and ratios["skip_link"] == 1.0
    assert r[1]["seo"]["h1_count"] == 1 and r[2]["title"] is None and len(r) == 4


def test_markup_details(spark):
    pages = [
        '<nav><ul></ul><a href="/a">Rings</a><a href="/b">FAQs</a><a href="/c">Delivery</a><a>No link</a></nav>', '<a href="#skip">Jump</a><h1> </h1><h1>One <b>two</b></h1>', '<a href="#m">Sk<b>ip</b></a><script>var a</script><noscript>off</noscript><title>A b</title><p>c d</p>',
    ]
    p = html.parsed(spark.createDataFrame(list(enumerate(pages)), "id int, html string").withColumn("url", F.lit("")))
    r = [x for x in p.select("id", "page.*").orderBy("id").collect()]
    assert r[0]["menu"] == ["Rings", "Delivery"]
    assert (r[1]["n_h1"], r[1]["h1"], r[1]["ratios"][9]) == (1, ["Onetwo"], 0.0)
    assert r[2]["ratios"][9] == 1.0 and r[2]["n_words"] == 7


def test_sitemaps(spark):
    index = "<sitemapindex><sitemap><loc>https://s.example/products.xml</loc></sitemap><sitemap><loc>https://s.example/pages.xml</loc></sitemap></sitemapindex>"
    body = "<urlset><url><loc> https://s.example/products/A-Tote/ </loc></url><url><loc>https://s.example/products/b&amp;c</loc><image:image/></url><url><loc>https://s.example/about</loc></url></urlset>"
    maps = spark.createDataFrame([("s", "https://s.example/sitemap.xml", index), ("s", "https://s.example/products.xml", body)], "slug string, url string, body string")
    robots = spark.createDataFrame([("s", "https://s.example/", ""), ("t", "https://t.example", "Sitemap: https://t.example/m.xml")], "slug string, base_url string, body string")
    got = {r["slug"]: r for r in catalogue.collect(maps, robots).collect()}
    assert got["s"]["handles"] == ["a-tote", "b&c"] and not got["t"]["ok"] and got["t"]["error"] == "no sitemap found"


def test_mentions(spark):
    brands = spark.createDataFrame([("a", "Ana & Bo", ["Anabo"]), ("b", "Ring", None)], "slug string, brand string, aliases array<string>")
    texts = spark.createDataFrame([(1, "Ring first, then ANA  and Bo."), (2, "earring ana + bo ana & bo"), (3, None), (4, "")], "id int, t string")
    got = {(r["item"], r["slug"]): r["rank"] for r in mentions.mentions(texts, brands, "id", "t").collect()}
    assert got == {(1, "b"): 1, (1, "a"): 2, (2, "a"): 1}
    sov = {r["slug"]: r for r in mentions.share_of_voice(mentions.mentions(texts, brands, "id", "t"), brands, texts.agg(F.count("*").alias("n"))).collect()}
    assert sov["a"]["sov"] + sov["b"]["sov"] == pytest.approx(1, abs=0.01) and sov["a"]["visibility"] == 0.5


def test_colours(spark):
    px = spark.createDataFrame([(1, 255, 255, 255)] * 99 + [(1, 250, 250, 250)] + [(2, 255, 255, 255)] * 9 + [(2, 0, 0, 0)], "img int, r int, g int, b int")
    assert {r["img"]: r["blank"] for r in colours.looks_blank(px, "img").collect()} == {1: True, 2: False}
    top = colours.dominant(px, "img").filter("img = 2").orderBy(F.desc("share")).collect()
    assert [(r["hex"], r["share"]) for r in top] == [("#ffffff", 0.9), ("#000000", 0.1)]


def test_each_text_is_read_once(spark):
    """A value that is used at several places is worked out once: what is read from a text stands once in the plan, not once for each use."""
    df = spark.createDataFrame([("", "")], "h string, t string")
    plan = lambda c: df.select(c.alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    band = plan(page.home_band(prices.home_prices(prices.scan(H, T))))
    assert band.count("_titled(") == 1 and band.count("regexp_extract_all(") == 1
    assert plan(page.reputation(H, T)).count("aggregateRating") == 1
    assert plan(page.blocked(H)).count("<title") == 1
