"""Queries of the retail-signal operators over the test tables, with the SQL that checks them.

storefront, day); brand-level views take each brand's newest record of any storefront.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vitrine.functions import colours, html, page, prices
from vitrine.operators import catalogue, digest, gaps, history, mentions, tables, views
from vitrine.plans.ask import Ask
from vitrine.sources.tables import register_views, table
from vitrine.streaming import streams

PLACE, DAY, ORDER = ["slug", "storefront"], "capture_date", ["capture_date", "captured_at", "capture_id"]
PAY_LATER = ("Instalpay", "PayLater", "SplitThree")
TAXONOMY = {
    "bags": ["tote", "clutch", "holdall", "duffel", "shopper", "crossbody", "backpack", "weekender", "satchel", "bucket-bag", "belt"],
    "small": ["pouch", "wallet", "purse", "keyring", "cardholder", "passport", "phone", "wash-bag"],
    "jewellery": ["necklace", "bracelet", "earring", "anklet", "pendant", "locket", "charm", "brooch", "cufflink", "ring", "jewellery"],
    "wear": ["scarf", "shawl", "wrap", "glove", "mitten", "snood", "beanie", "slipper", "sandal", "umbrella"],
    "home": ["candle", "mug", "cushion", "blanket", "tray", "trinket", "notebook"],
}
PALETTE = {"black": (0, 0, 0), "white": (255, 255, 255), "red": (220, 30, 30), "green": (30, 160, 60), "blue": (40, 70, 200), "gold": (212, 175, 55), "grey": (128, 128, 128)}


def records(spark: SparkSession, d: str) -> DataFrame:
    """The capture history after upserts: one record per place and day."""
    return history.upsert(table(spark, d, "captures"), None, [*PLACE, DAY], ["captured_at", "capture_id"])


def newest(spark: SparkSession, d: str) -> DataFrame:
    return history.latest(history.successful(records(spark, d)), ["slug"], ORDER)


def snapshots(spark: SparkSession, d: str) -> DataFrame:
    return history.upsert(table(spark, d, "catalogue_snapshot").select(*PLACE, "snap_date", "captured_at", "snapshot_id", "ok", "handles"), None, [*PLACE, "snap_date"], ["captured_at", "snapshot_id"])


def catalogue_runs(spark: SparkSession, d: str) -> DataFrame:
    return catalogue.runs(snapshots(spark, d), PLACE, "snap_date")


def brand_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Each brand's size: the sum of its storefronts' newest known product counts."""
    return catalogue.newness(catalogue_runs(spark, d), PLACE, "snap_date").groupBy("slug").agg(F.sum("size").alias("product_count"))


def handle_rows(spark: SparkSession, d: str) -> DataFrame:
    """Handles of each storefront's newest good snapshot."""
    good = history.latest(snapshots(spark, d).filter("ok AND handles IS NOT NULL"), PLACE, ["snap_date", "captured_at", "snapshot_id"])
    return good.select("slug", "snap_date", F.explode(F.array_distinct("handles")).alias("handle"))


def brand_shares(spark: SparkSession, d: str) -> DataFrame:
    return catalogue.category_shares(catalogue.classified(handle_rows(spark, d), "handle", TAXONOMY), ["slug"], "category")


def brands(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "brand_list")


def voices(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    answers = table(spark, d, "aio")
    return answers, mentions.mentions(answers, brands(spark, d), "answer_id", "answer_text")


def voice_scores(spark: SparkSession, d: str) -> DataFrame:
    answers, found = voices(spark, d)
    return mentions.share_of_voice(found, brands(spark, d), answers.agg(F.count(F.lit(1)).alias("n")))


def pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages made up from captures, for the markup pass: what is put in must come out."""
    c = history.successful(records(spark, d)).filter("hero_message IS NOT NULL AND seo.title IS NOT NULL")
    e = lambda x: F.replace(F.replace(F.replace(F.coalesce(x, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    items = F.array_join(F.transform(F.coalesce("menu", F.array().cast("array<string>")), lambda m: F.concat(F.lit("<li><a href='/m'>"), e(m), F.lit("</a>"))), "")
    none = F.array().cast("array<string>")
    pictures = F.array_join(F.transform(F.coalesce("offers", none), lambda o: F.concat(F.lit("<img src='/banner.jpg' alt='"), F.replace(e(o), F.lit("'"), F.lit("&#39;")), F.lit("'>"))), "")
    heads = F.array_join(F.transform(F.coalesce("delivery", none), lambda x: F.concat(F.lit("<h2>"), e(x), F.lit("</h2>"))), "")
    form = F.lit("<form><label>Mail <input type='email'></label><input id='q'><label for='q'>Search</label><textarea></textarea><button>Go</button></form>")
    prices_of = F.concat(F.lit('<script>{"title":"Bag","price":"'), F.coalesce(F.col("prices.price_min").cast("string"), F.lit("0")), F.lit('"}</script>'))
    copy = F.array_join(F.concat(F.coalesce("offers", F.array().cast("array<string>")), F.coalesce("delivery", F.array().cast("array<string>"))), ". ")
    made = F.concat(F.lit("<html lang='en'><head><title>"), e(F.col("seo.title")), F.lit("</title></head><body><header><nav><ul>"), items, F.lit("</ul></nav></header><main><h1>"), e(F.col("hero_message")), F.lit("</h1><p>"), e(copy), F.lit("</p><h2>Offers</h2>"), pictures, heads, form, prices_of, F.lit("</main><footer><a href='/delivery'>Delivery</a><a href='/returns'>Returns</a></footer></body></html>"))
    return c.select("capture_id", "url", made.alias("html"))


Q: dict = {}
SQL: dict[str, str] = {}
CAP = "cap AS (SELECT * FROM captures QUALIFY row_number() OVER (PARTITION BY slug, storefront, capture_date ORDER BY captured_at DESC, capture_id DESC) = 1), ok AS (SELECT * FROM cap WHERE status = 'success')"
LATEST = CAP + ", latest AS (SELECT * FROM ok QUALIFY row_number() OVER (PARTITION BY slug ORDER BY capture_date DESC, captured_at DESC, capture_id DESC) = 1)"
RUNS = """snap AS (SELECT * FROM catalogue_snapshot QUALIFY row_number() OVER (PARTITION BY slug, storefront, snap_date ORDER BY captured_at DESC, snapshot_id DESC) = 1),
h AS (SELECT *, CASE WHEN ok AND handles IS NOT NULL THEN list_distinct(handles) END AS cur FROM snap),
b AS (SELECT *, last_value(cur IGNORE NULLS) OVER (PARTITION BY slug, storefront ORDER BY snap_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS base FROM h),
runs AS (SELECT slug, storefront, snap_date, cur IS NOT NULL AS ok, cur IS NOT NULL AND base IS NULL AS first_seen, len(cur) AS product_count,
  CASE WHEN cur IS NOT NULL AND base IS NOT NULL THEN len(list_filter(cur, lambda x: NOT list_contains(base, x))) ELSE 0 END AS new_count,
  CASE WHEN cur IS NOT NULL AND base IS NOT NULL THEN len(list_filter(base, lambda x: NOT list_contains(cur, x))) ELSE 0 END AS removed_count FROM b)"""
_CATS = " UNION ALL ".join(f"SELECT slug, snap_date, handle, '{c}' AS category FROM hr WHERE regexp_matches(regexp_replace(lower(handle), '[-_]+', ' ', 'g'), '(^|[^a-z0-9_])({'|'.join(w)})')" for c, w in TAXONOMY.items())
SHARES = f"""good AS (SELECT * FROM catalogue_snapshot WHERE ok AND handles IS NOT NULL), one AS (SELECT * FROM good QUALIFY row_number() OVER (PARTITION BY slug, storefront, snap_date ORDER BY captured_at DESC, snapshot_id DESC) = 1),
newest AS (SELECT * FROM one QUALIFY row_number() OVER (PARTITION BY slug, storefront ORDER BY snap_date DESC, captured_at DESC, snapshot_id DESC) = 1),
hr AS (SELECT slug, snap_date, unnest(list_distinct(handles)) AS handle FROM newest), cl AS ({_CATS}),
sh AS (SELECT slug, category, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY slug) AS share FROM cl GROUP BY 1, 2)"""


def as_text(df: DataFrame) -> DataFrame:
    """Dates as ISO text, so that results compare alike everywhere."""
    return df.withColumns({f.name: F.col(f.name).cast("string") for f in df.schema.fields if f.dataType.typeName() == "date"})


_B = r"[^\p{L}\p{N}_]"
MENTIONS = (
    r"""names AS (SELECT slug, row_number() OVER (ORDER BY slug) AS ord, brand AS name, aliases FROM brand_list), spelt AS (
SELECT slug, ord, unnest(list_concat([name], coalesce(aliases, []))) AS name FROM names), v AS (SELECT slug, ord, lower(trim(unnest([name, regexp_replace(name, '\s*&\s*', ' and ', 'g'), regexp_replace(name, '\s*&\s*', ' + ', 'g')]))) AS name FROM spelt WHERE trim(name) <> ''),
p AS (SELECT DISTINCT slug, ord, '(?s)^((?:.*?B)??)' || regexp_replace(regexp_replace(name, '([\\.^$|?*+()\[\]{}])', '\\\1', 'g'), '\s+', '\\s+', 'g') || '(?:$|B)' AS pat, regexp_extract(name, '^[\p{L}\p{N}_]+') AS lead FROM v),
a AS (SELECT answer_id AS item, lower(answer_text) AS t FROM aio WHERE answer_text IS NOT NULL),
m AS (SELECT item, slug, ord, min(length(regexp_extract(t, pat, 1)) + 1) AS pos FROM a JOIN p ON contains(t, lead) WHERE regexp_matches(t, pat) GROUP BY 1, 2, 3),
men AS (SELECT item, slug, pos, row_number() OVER (PARTITION BY item ORDER BY pos, ord) AS rank FROM m)"""
).replace("B)", _B + ")")


def query(name: str, sql: str | None = None, dates: tuple[str, ...] = ()):
    """Registers a query and its SQL; dates: the SQL's date columns."""

    def keep(f):
        Q[name] = lambda s, d: as_text(f(s, d))
        if sql:
            SQL[name] = "SELECT * REPLACE (" + ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in dates) + f") FROM ({sql})" if dates else sql
        return f

    return keep


@query("s03_upsert", f"WITH {CAP} SELECT slug, storefront, capture_date, capture_id, status FROM cap", ("capture_date",))
def _(s, d):
    return records(s, d).select(*PLACE, DAY, "capture_id", "status")


@query("s04_run_log", "SELECT load_id, count(*) AS n_rows, count(*) FILTER (status = 'success') AS n_ok FROM captures GROUP BY 1 ORDER BY load_id DESC LIMIT 120")
def _(s, d):
    runs = table(s, d, "captures").groupBy("load_id").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("status") == "success").alias("n_ok"))
    return history.keep_last(runs, ["load_id"], history.RUN_LOG_CAP)


@query("h03_latest", f"WITH {LATEST} SELECT slug, storefront, capture_date, capture_id FROM latest", ("capture_date",))
def _(s, d):
    return newest(s, d).select(*PLACE, DAY, "capture_id")


@query("h04_as_of", f"WITH {CAP} SELECT slug, capture_date, capture_id FROM ok WHERE capture_date <= (SELECT max(capture_date) - 10 FROM captures) QUALIFY row_number() OVER (PARTITION BY slug ORDER BY capture_date DESC, captured_at DESC, capture_id DESC) = 1", ("capture_date",))
def _(s, d):
    until = F.date_sub(table(s, d, "captures").agg(F.max(DAY).alias("m")).select("m").scalar(), 10)
    return history.latest(history.successful(records(s, d)), ["slug"], ORDER, until).select("slug", DAY, "capture_id")


@query("h05_latest_or_failed", f"WITH {CAP} SELECT slug, storefront, capture_id, status FROM cap QUALIFY row_number() OVER (PARTITION BY slug, storefront ORDER BY (status = 'success') DESC NULLS LAST, capture_date DESC, captured_at DESC, capture_id DESC) = 1")
def _(s, d):
    return history.latest_or_failed(records(s, d), PLACE, ORDER).select(*PLACE, "capture_id", "status")


_STATE = f"""WITH {CAP}, st AS (SELECT slug, storefront, capture_date, nullif(headline_offer, '') AS h, coalesce(max_discount_pct, 0) AS p, coalesce(hero_message, '') AS m, coalesce(discount_codes, []) AS c,
  coalesce(trading.finance, []) AS f, reputation.rating AS r, coalesce(reputation.platforms, []) AS pl, coalesce(listing.prices.price_median, prices.price_median) AS md FROM ok),
x AS (SELECT *, lag(slug) OVER w IS NOT NULL AS has, lag(h) OVER w AS h0, lag(p) OVER w AS p0, lag(m) OVER w AS m0, lag(c) OVER w AS c0, lag(f) OVER w AS f0, lag(r) OVER w AS r0, lag(pl) OVER w AS pl0, lag(md) OVER w AS md0
  FROM st WINDOW w AS (PARTITION BY slug, storefront ORDER BY capture_date)), y AS (SELECT * FROM x WHERE has), e AS (
SELECT slug, storefront, capture_date, 'sale_started' AS event, h AS detail FROM y WHERE h0 IS NULL AND h IS NOT NULL
UNION ALL SELECT slug, storefront, capture_date, 'sale_ended', '' FROM y WHERE h0 IS NOT NULL AND h IS NULL
UNION ALL SELECT slug, storefront, capture_date, CASE WHEN p > p0 THEN 'discount_deepened' ELSE 'discount_eased' END, p0 || ' to ' || p FROM y WHERE (h IS NULL) = (h0 IS NULL) AND p <> 0 AND p <> p0
UNION ALL SELECT slug, storefront, capture_date, 'hero_changed', m FROM y WHERE m <> m0 AND m <> ''
UNION ALL SELECT slug, storefront, capture_date, 'code_added', unnest(list_filter(list_distinct(c), lambda z: NOT list_contains(c0, z))) FROM y
UNION ALL SELECT slug, storefront, capture_date, 'bnpl_added', unnest(list_filter(list_distinct(f), lambda z: NOT list_contains(f0, z) AND z IN {PAY_LATER})) FROM y
UNION ALL SELECT slug, storefront, capture_date, 'bnpl_removed', unnest(list_filter(list_distinct(f0), lambda z: NOT list_contains(f, z) AND z IN {PAY_LATER})) FROM y
UNION ALL SELECT slug, storefront, capture_date, 'rating_changed', CASE WHEN r > r0 THEN 'up' ELSE 'down' END FROM y WHERE r <> 0 AND r0 <> 0 AND abs(r - r0) >= 0.2
UNION ALL SELECT slug, storefront, capture_date, 'reviews_added', unnest(list_filter(list_distinct(pl), lambda z: NOT list_contains(pl0, z))) FROM y
UNION ALL SELECT slug, storefront, capture_date, 'price_shift', CASE WHEN md > md0 THEN 'up' ELSE 'down' END FROM y WHERE md0 <> 0 AND abs((md - md0) / md0) >= 0.15)"""


def _timeline(s, d):
    return history.timeline(records(s, d), PLACE, DAY, PAY_LATER)


@query("e00_timeline", _STATE + " SELECT * FROM e", ("capture_date",))
def _(s, d):
    return _timeline(s, d).select(*PLACE, DAY, "event", "detail")


_RULES = ("sale_started", "sale_ended", "discount", "hero_changed", "code_added", "bnpl_added", "bnpl_removed", "rating_changed", "reviews_added", "price_shift")
_SEQ = "CAST(row_number() OVER (PARTITION BY slug, storefront, capture_date ORDER BY CASE " + " ".join(f"WHEN event LIKE '{r}%' THEN {i}" for i, r in enumerate(_RULES)) + " END, detail) - 1 AS INT) AS seq"


_ALL_EVENTS = _STATE + f""", s AS (SELECT *, {_SEQ} FROM e), {RUNS}, u AS (SELECT * FROM s UNION ALL SELECT slug, storefront, snap_date, 'products_added', CAST(new_count AS VARCHAR), 1000 FROM runs WHERE ok AND NOT first_seen AND new_count >= 2),
top AS (SELECT * FROM u ORDER BY capture_date DESC, slug DESC, storefront DESC, seq LIMIT 400)"""


def _all_events(s, d):
    added = history.products_added(catalogue_runs(s, d)).select(*PLACE, F.col("snap_date").alias(DAY), F.lit(1000).alias("seq"), F.lit("products_added").alias("event"), F.col("new_count").cast("string").alias("detail"))
    return history.capped_timeline(_timeline(s, d).unionByName(added), PLACE, DAY)


@query("e12_capped_timeline", _ALL_EVENTS + " SELECT * FROM top", ("capture_date",))
def _(s, d):
    return _all_events(s, d)


@query("v31_recent_changes", _ALL_EVENTS + ", v AS (SELECT * FROM top ORDER BY capture_date DESC, slug DESC, storefront DESC, seq LIMIT 80) SELECT *, CAST(row_number() OVER (PARTITION BY capture_date ORDER BY slug DESC, storefront DESC, seq) AS INT) AS nth FROM v", ("capture_date",))
def _(s, d):
    return tables.recent_changes(_all_events(s, d), DAY, PLACE)


@query("e13_sale_transitions", f"""WITH {CAP}, t AS (SELECT slug, storefront, capture_date, coalesce(headline_offer, '') AS headline, lag(coalesce(headline_offer, '')) OVER (PARTITION BY slug, storefront ORDER BY capture_date) AS b FROM ok)
SELECT slug, storefront, capture_date, CASE WHEN b = '' THEN 'started' WHEN headline = '' THEN 'ended' ELSE 'changed' END AS transition, headline FROM t WHERE b IS NOT NULL AND b <> headline""", ("capture_date",))
def _(s, d):
    return history.sale_transitions(records(s, d), PLACE, DAY)


@query("c14_catalogue_runs", f"WITH {RUNS}, q AS (SELECT slug, storefront, snap_date, array_to_string(list_slice(list_sort(list_filter(cur, lambda x: NOT list_contains(base, x))), 1, 8), '|') AS new_samples FROM b WHERE cur IS NOT NULL AND base IS NOT NULL) SELECT runs.*, q.new_samples FROM runs LEFT JOIN q USING (slug, storefront, snap_date)", ("snap_date",))
def _(s, d):
    return catalogue_runs(s, d).withColumn("new_samples", F.array_join("new_samples", "|"))


@query("c17_run_summary", f"WITH {RUNS} SELECT snap_date, count(*) FILTER (ok) AS n_ok, CAST(sum(new_count) AS BIGINT) AS n_new FROM runs GROUP BY 1", ("snap_date",))
def _(s, d):
    return catalogue.run_summary(catalogue_runs(s, d), "snap_date")


@query("e11_products_added", f"WITH {RUNS} SELECT slug, storefront, snap_date, new_count FROM runs WHERE ok AND NOT first_seen AND new_count >= 2", ("snap_date",))
def _(s, d):
    return history.products_added(catalogue_runs(s, d)).select(*PLACE, "snap_date", "new_count")


@query("c09_handles_of_urls", "SELECT DISTINCT url, lower(regexp_extract(regexp_replace(regexp_replace(regexp_replace(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*', ''), '[?#].*$', ''), '/+$', ''), '([^/]*)$', 1)) AS handle FROM captures WHERE url IS NOT NULL")
def _(s, d):
    return table(s, d, "captures").select("url").filter("url IS NOT NULL").distinct().withColumn("handle", catalogue.handle_of(F.col("url")))


@query("c13_category_shares", f"WITH {SHARES} SELECT * FROM sh")
def _(s, d):
    return brand_shares(s, d)


@query("v22_newness", f"""WITH {RUNS}, n AS (SELECT *, dense_rank() OVER (PARTITION BY slug, storefront ORDER BY snap_date DESC) AS k FROM runs)
SELECT slug, storefront, CAST(sum(CASE WHEN k <= 7 AND ok AND NOT first_seen THEN new_count ELSE 0 END) AS BIGINT) AS n_new, arg_max(product_count, snap_date) FILTER (ok) AS size FROM n GROUP BY 1, 2""")
def _(s, d):
    return catalogue.newness(catalogue_runs(s, d), PLACE, "snap_date")


@query("v22_range_board", f"""WITH {RUNS}, n AS (SELECT *, dense_rank() OVER (PARTITION BY slug, storefront ORDER BY snap_date DESC) AS k FROM runs),
w AS (SELECT slug, storefront, CAST(sum(CASE WHEN k <= 7 AND ok AND NOT first_seen THEN new_count ELSE 0 END) AS BIGINT) AS n_new, arg_max(product_count, snap_date) FILTER (ok) AS size FROM n GROUP BY 1, 2),
l AS (SELECT list_sort(list(size) FILTER (size IS NOT NULL)) AS l, CAST(sum(size) AS BIGINT) AS total FROM w)
SELECT w.*, CASE WHEN size IS NOT NULL THEN row_number() OVER (ORDER BY size DESC NULLS LAST, slug, storefront) END AS place, l[len(l) // 2 + 1] AS pack_median, total FROM w, l""")
def _(s, d):
    return views.range_board(catalogue.newness(catalogue_runs(s, d), PLACE, "snap_date"), PLACE)


@query("v23_category_matrix", f"WITH {SHARES} SELECT slug, " + ", ".join(f"coalesce(max(share) FILTER (category = '{c}'), 0) AS {c}" for c in TAXONOMY) + " FROM sh GROUP BY 1")
def _(s, d):
    return views.category_matrix(brand_shares(s, d), "slug", list(TAXONOMY))


def _monthly(s, d):
    good = snapshots(s, d).filter("ok AND handles IS NOT NULL").select("slug", "snap_date", F.explode(F.array_distinct("handles")).alias("handle"))
    return views.period_category(catalogue.classified(good, "handle", TAXONOMY), "snap_date", "slug", "category", "month")


_MONTHLY = f"""one AS (SELECT * FROM catalogue_snapshot QUALIFY row_number() OVER (PARTITION BY slug, storefront, snap_date ORDER BY captured_at DESC, snapshot_id DESC) = 1),
hr AS (SELECT slug, snap_date, unnest(list_distinct(handles)) AS handle FROM one WHERE ok AND handles IS NOT NULL), cl AS ({_CATS}),
n AS (SELECT strftime(snap_date, '%Y-%m') AS period, slug, category, count(*) AS n FROM cl GROUP BY 1, 2, 3), s AS (SELECT *, n / sum(n) OVER (PARTITION BY period, slug) AS share FROM n),
k AS (SELECT period, count(DISTINCT slug) AS e FROM n GROUP BY 1), m AS (SELECT period, category, 100 * sum(share) / any_value(e) AS share FROM s JOIN k USING (period) GROUP BY 1, 2)"""


@query("v29_period_category", f"WITH {_MONTHLY} SELECT * FROM m")
def _(s, d):
    return _monthly(s, d)


_TREND = f"""one AS (SELECT * FROM catalogue_snapshot QUALIFY row_number() OVER (PARTITION BY slug, storefront, snap_date ORDER BY captured_at DESC, snapshot_id DESC) = 1),
r AS (SELECT slug, snap_date, list_distinct(flatten(list(handles))) AS hs FROM one WHERE ok AND handles IS NOT NULL AND slug IN (SELECT slug FROM brand_list WHERE is_self) GROUP BY 1, 2),
hr AS (SELECT slug, snap_date, unnest(hs) AS handle FROM r), cl AS ({_CATS}),
c AS (SELECT r.snap_date, k.category, len(r.hs) AS total, count(cl.handle) AS n FROM r CROSS JOIN (VALUES {", ".join(f"('{x}')" for x in TAXONOMY)}) k(category) LEFT JOIN cl ON cl.snap_date = r.snap_date AND cl.category = k.category GROUP BY ALL),
m AS (SELECT strftime(snap_date, '%Y-%m') AS period, category, avg(n / total) AS share FROM c GROUP BY 1, 2), w AS (SELECT * FROM m WHERE period IN (SELECT DISTINCT period FROM m ORDER BY 1 DESC LIMIT 6)),
l AS (SELECT category FROM w WHERE period = (SELECT max(period) FROM w) ORDER BY share DESC, category LIMIT 8)"""


@query("v24_mix_trend", f"WITH {_TREND} SELECT period, category, share, CAST(floor(100 * share + 0.5) - lag(floor(100 * share + 0.5)) OVER (PARTITION BY category ORDER BY period) AS BIGINT) AS delta FROM w WHERE category IN (SELECT category FROM l)")
def _(s, d):
    """The own brand's range by month; a run is a date's handles of all its storefronts."""
    good = snapshots(s, d).filter("ok AND handles IS NOT NULL").join(F.broadcast(brands(s, d).filter("is_self").select("slug")), "slug", "left_semi")
    run = good.groupBy("slug", "snap_date").agg(F.array_distinct(F.flatten(F.collect_list("handles"))).alias("handles"))  # one brand's storefronts on a date
    sizes = run.select("snap_date", F.size("handles").alias("total"), F.explode(F.array(*[F.lit(c) for c in TAXONOMY])).alias("category"))
    counts = catalogue.classified(run.select("snap_date", F.explode("handles").alias("handle")), "handle", TAXONOMY).groupBy("snap_date", "category").agg(F.count(F.lit(1)).alias("n"))
    rows = sizes.join(counts, ["snap_date", "category"], "left").fillna(0, ["n"])
    return views.mix_trend(rows, "snap_date", "category", ("n", "total"))


def _gaps(s, d):
    answers, found = voices(s, d)
    silent = mentions.absent(answers, found, "answer_id", brands(s, d).filter("is_self"))
    return gaps.by_priority(gaps.opportunities(newest(s, d), brand_sizes(s, d), brand_shares(s, d), silent, PAY_LATER))


_FACTS = f"""WITH {LATEST}, {RUNS}, {SHARES}, {MENTIONS}, sz AS (SELECT slug, sum(size) AS n_products FROM (SELECT slug, storefront, arg_max(product_count, snap_date) FILTER (ok) AS size FROM runs GROUP BY 1, 2) GROUP BY 1),
f AS (SELECT l.slug, coalesce(l.is_self, false) AS own, coalesce(l.headline_offer, '') AS h, coalesce(l.max_discount_pct, 0) AS pct, len(list_filter(coalesce(l.trading.finance, []), lambda x: x IN {PAY_LATER})) AS bnpl, l.trading.free_delivery_threshold AS thr, coalesce(l.trading.email_capture_offer, '') AS su,
  l.accessibility_score AS acc, l.reputation.rating AS rating, sz.n_products FROM latest l LEFT JOIN sz USING (slug)),
me AS (SELECT * FROM f WHERE own LIMIT 1), ot AS (SELECT *, CASE WHEN rating > 0 THEN rating END AS paid FROM f WHERE NOT own),
pk AS (SELECT count(*) AS n, count(*) FILTER (h <> '') AS n_sale, avg(nullif(pct, 0)) AS mean_pct, count(*) FILTER (bnpl > 0) AS n_bnpl, count(*) FILTER (thr = 0) AS n_free, count(*) FILTER (su <> '') AS n_signup, round_even(avg(acc), 0) AS mean_access, count(paid) AS n_rated,
  list_sort(list(paid) FILTER (paid IS NOT NULL)) AS rs, list_sort(list(n_products) FILTER (n_products IS NOT NULL)) AS ps FROM ot),
x AS (SELECT me.*, pk.*, greatest(2, pk.n // 3) AS least, rs[len(rs) // 2 + 1] AS mid_rating, ps[len(ps) // 2 + 1] AS mid_products, len(list_filter(rs, lambda r: r - me.rating > 0.1)) AS ahead FROM me, pk WHERE pk.n > 0),
mix AS (SELECT category, avg(share) FILTER (NOT own) AS mean, count(*) FILTER (NOT own) AS n, coalesce(max(share) FILTER (own), 0) AS mine FROM sh JOIN f USING (slug) GROUP BY 1),
top AS (SELECT * FROM mix WHERE n >= 2 AND mean >= 0.12 AND mean - mine >= 0.10 ORDER BY mean - mine DESC, category DESC LIMIT 1),
silent AS (SELECT count(DISTINCT item) AS n FROM men WHERE item NOT IN (SELECT item FROM men WHERE slug IN (SELECT slug FROM brand_list WHERE is_self)))"""
_GAPS = f"""{_FACTS}
SELECT 'high' AS priority, 0 AS seq, 'promo_absent' AS kind, CAST(n_sale AS DOUBLE) AS value FROM x WHERE h = '' AND n_sale >= least
UNION ALL SELECT 'medium', 1, 'promo_shallow', mean_pct FROM x WHERE NOT (h = '' AND n_sale >= least) AND pct <> 0 AND pct < mean_pct - 10
UNION ALL SELECT 'high', 2, 'bnpl_gap', n_bnpl FROM x WHERE bnpl = 0 AND n_bnpl >= least
UNION ALL SELECT 'medium', 3, 'free_delivery_gap', n_free FROM x WHERE thr IS DISTINCT FROM 0 AND n_free >= least
UNION ALL SELECT 'medium', 4, 'signup_gap', n_signup FROM x WHERE su = '' AND n_signup >= least
UNION ALL SELECT 'low', 5, 'accessibility_gap', mean_access FROM x WHERE acc < mean_access - 8
UNION ALL SELECT 'medium', 6, 'rating_behind', mid_rating FROM x WHERE rating > 0 AND n_rated >= 2 AND mid_rating - rating >= 0.2 AND ahead >= 2
UNION ALL SELECT 'medium', 7, 'rating_absent', n_rated FROM x WHERE coalesce(rating, 0) = 0 AND n_rated >= least
UNION ALL SELECT 'low', 8, 'range_short', mid_products FROM x WHERE n_products > 0 AND n_products <= mid_products * 0.5
UNION ALL SELECT 'medium', 9, 'mix_gap:' || category, mean - mine FROM top
UNION ALL SELECT 'high', 10, 'answers_silent', n FROM silent WHERE n > 0"""


@query("o00_gap_rules", _GAPS)
def _(s, d):
    return _gaps(s, d)


@query("o01_promo_gap", f"""WITH {LATEST}, f AS (SELECT slug, coalesce(headline_offer, '') AS h, coalesce(max_discount_pct, 0) AS pct FROM latest),
x AS (SELECT a.slug, any_value(a.h) AS h, any_value(a.pct) AS pct, count(*) AS n, count(*) FILTER (b.h <> '') AS k, avg(nullif(b.pct, 0)) AS m FROM f a JOIN f b ON a.slug <> b.slug GROUP BY 1)
SELECT slug, CASE WHEN h = '' AND k >= greatest(2, n // 3) THEN 'promo_absent' ELSE 'promo_shallow' END AS kind FROM x WHERE (h = '' AND k >= greatest(2, n // 3)) OR (pct <> 0 AND pct < m - 10)""")
def _(s, d):
    """The two promotion rules with each brand in turn as the own one, so that both fire."""
    f = gaps.facts(newest(s, d), PAY_LATER)
    on, pct = (F.col("headline") != "").cast("int"), F.when(F.col("pct") != 0, F.col("pct"))
    # the pack without a brand: totals less its own part
    total = f.agg(F.count(F.lit(1)).alias("n"), F.sum(on).alias("k"), F.sum(pct).alias("s"), F.count(pct).alias("c"))
    x = f.crossJoin(F.broadcast(total))  # one row
    others, least = F.col("k") - on, F.greatest(F.lit(2), F.floor((F.col("n") - 1) / 3))
    mean = F.try_divide(F.col("s") - F.coalesce(pct, F.lit(0)), F.col("c") - F.when(pct.isNotNull(), 1).otherwise(0))
    absent = (F.col("headline") == "") & (others >= least)
    kind = F.when(absent, "promo_absent").when((F.col("pct") != 0) & (F.col("pct") < mean - gaps.DISCOUNT_BEHIND), "promo_shallow")
    return x.select("slug", kind.alias("kind")).filter("kind IS NOT NULL")


@query("d01_anchors", f"WITH {CAP} SELECT max(capture_date) AS today, coalesce((SELECT max(capture_date) FROM cap WHERE capture_date <= (SELECT max(capture_date) FROM cap) - 7), min(capture_date)) AS prior FROM cap", ("today", "prior"))
def _(s, d):
    return digest.anchors(records(s, d), DAY)


_DIGEST = f"""WITH {CAP}, an AS (SELECT max(capture_date) AS today, coalesce((SELECT max(capture_date) FROM cap WHERE capture_date <= (SELECT max(capture_date) FROM cap) - 7), min(capture_date)) AS prior FROM cap),
nw AS (SELECT ok.* FROM ok, an WHERE capture_date <= today QUALIFY row_number() OVER (PARTITION BY slug ORDER BY capture_date DESC, captured_at DESC, capture_id DESC) = 1),
th AS (SELECT ok.* FROM ok, an WHERE capture_date <= prior QUALIFY row_number() OVER (PARTITION BY slug ORDER BY capture_date DESC, captured_at DESC, capture_id DESC) = 1),
y AS (SELECT nw.slug, nullif(nw.headline_offer, '') AS h, nullif(th.headline_offer, '') AS h0, coalesce(nw.max_discount_pct, 0) AS p, coalesce(th.max_discount_pct, 0) AS p0, coalesce(nw.hero_message, '') AS m, coalesce(th.hero_message, '') AS m0,
  coalesce(nw.discount_codes, []) AS c, coalesce(th.discount_codes, []) AS c0 FROM nw JOIN th USING (slug)), e AS (
SELECT slug, 'sale_started' AS event, h AS detail, 0 AS o FROM y WHERE h0 IS NULL AND h IS NOT NULL
UNION ALL SELECT slug, 'sale_ended', '', 1 FROM y WHERE h0 IS NOT NULL AND h IS NULL
UNION ALL SELECT slug, CASE WHEN p > p0 THEN 'discount_deepened' ELSE 'discount_eased' END, p0 || ' to ' || p, 2 FROM y WHERE (h IS NULL) = (h0 IS NULL) AND p <> 0 AND p <> p0
UNION ALL SELECT slug, 'hero_changed', m, 3 FROM y WHERE m <> m0 AND m <> ''
UNION ALL SELECT slug, 'code_added', unnest(list_filter(list_distinct(c), lambda z: NOT list_contains(c0, z))), 4 FROM y)"""


@query("d03_changes", _DIGEST + ", s AS (SELECT *, CAST(row_number() OVER (PARTITION BY slug ORDER BY o, detail) - 1 AS INT) AS seq FROM e) SELECT slug, seq, event, detail FROM s ORDER BY slug, seq LIMIT 25")
def _(s, d):
    return digest.listed(digest.changes(records(s, d), ["slug"], ORDER), ["slug"])


@query("d04_market", f"WITH {LATEST} SELECT count(*) FILTER (coalesce(headline_offer, '') <> '') AS n_on_offer, count(*) AS n_brands, round_even(avg(nullif(max_discount_pct, 0)), 0) AS mean_discount, CAST(median(nullif(max_discount_pct, 0)) AS DOUBLE) AS median_discount FROM latest")
def _(s, d):
    return digest.market(newest(s, d)).withColumn("mean_discount", F.col("mean_discount").cast("double"))


@query("d05_discount_ranking", f"WITH {LATEST} SELECT slug, max_discount_pct AS value FROM latest WHERE max_discount_pct <> 0")
def _(s, d):
    return digest.discount_ranking(newest(s, d), ["slug"])


@query("d06_price_ranking", f"WITH {LATEST} SELECT slug, coalesce(listing.prices.price_median, prices.price_median) AS value FROM latest WHERE coalesce(listing.prices.price_median, prices.price_median) <> 0")
def _(s, d):
    return digest.price_ranking(newest(s, d), ["slug"])


@query("v02_freshness", f"""WITH {CAP}, l AS (SELECT * FROM cap QUALIFY row_number() OVER (PARTITION BY slug ORDER BY capture_date DESC, captured_at DESC, capture_id DESC) = 1)
SELECT slug, CASE WHEN status <> 'success' THEN 'failed' WHEN capture_date = (SELECT max(capture_date) FROM cap) THEN 'fresh' ELSE 'stale' END AS freshness FROM l""")
def _(s, d):
    rows = records(s, d)
    return views.freshness(rows, history.latest(rows, ["slug"], ORDER), DAY, "slug")


_SEO = "CAST(CASE WHEN length(seo.title) BETWEEN 50 AND 62 THEN 30 WHEN length(seo.title) > 0 THEN 15 ELSE 0 END + CASE WHEN length(seo.meta_description) BETWEEN 120 AND 160 THEN 30 WHEN length(seo.meta_description) > 0 THEN 15 ELSE 0 END + CASE WHEN seo.h1_count >= 1 THEN 20 ELSE 0 END AS DOUBLE)"
for _grain in ("week", "month", "quarter"):
    for _metric in views.METRICS:
        Q[f"v28_{_metric}_{_grain}"] = lambda s, d, g=_grain, m=_metric: views.period_metric(history.successful(records(s, d)), ["slug"], DAY, m, g)
    _label = {"week": "strftime(capture_date, '%G-W%V')", "month": "strftime(capture_date, '%Y-%m')", "quarter": "year(capture_date) || '-Q' || quarter(capture_date)"}[_grain]
    for _metric, _v in {"access": "CAST(accessibility_score AS DOUBLE)", "promo": "CASE WHEN coalesce(headline_offer, '') <> '' THEN 100.0 ELSE 0.0 END", "discount": "CAST(coalesce(max_discount_pct, 0) AS DOUBLE)", "seo": _SEO}.items():
        SQL[f"v28_{_metric}_{_grain}"] = f"WITH {CAP}, p AS (SELECT slug, {_label} AS period, avg({_v}) AS value FROM ok GROUP BY 1, 2) SELECT * FROM p WHERE period IN (SELECT DISTINCT period FROM p ORDER BY 1 DESC LIMIT {views.PERIODS_SHOWN[_grain]})"


@query("v06_overview", f"""WITH {CAP}, t AS (SELECT * FROM ok WHERE capture_date = (SELECT max(capture_date) FROM ok)), m AS (SELECT median(max_discount_pct) AS m FROM t)
SELECT count(*) AS n, count(*) FILTER (coalesce(headline_offer, '') <> '') AS n_on_sale, CAST(median(max_discount_pct) AS DOUBLE) AS median_discount, max(max_discount_pct) AS max_discount,
count(*) FILTER (len(list_filter(coalesce(delivery, []), lambda x: regexp_matches(lower(x), 'next[\\s-]?day|express'))) > 0) AS n_fast, min(trading.free_delivery_threshold) FILTER (trading.free_delivery_threshold > 0) AS low_threshold,
max(trading.free_delivery_threshold) AS high_threshold, count(*) FILTER (trading.free_delivery_threshold = 0) AS n_no_minimum, coalesce((SELECT string_agg(DISTINCT slug, ' | ' ORDER BY slug) FROM t, m WHERE max_discount_pct > m.m), '') AS deeper, (SELECT count(DISTINCT slug) FROM cap) - count(DISTINCT slug) AS n_blocked FROM t""")
def _(s, d):
    rows = records(s, d)
    ok = history.successful(rows)
    return views.overview(ok.filter(F.col(DAY) == ok.agg(F.max(DAY)).scalar()), rows.agg(F.countDistinct("slug").alias("n_brands")))


@query("v07_stance", f"WITH {LATEST}, m AS (SELECT median(max_discount_pct) AS m FROM latest) SELECT slug, coalesce(is_self, false) AS own, CASE WHEN max_discount_pct > m THEN 'deeper' WHEN max_discount_pct < m THEN 'shallower' WHEN max_discount_pct IS NOT NULL THEN 'in line' END AS stance FROM latest, m")
def _(s, d):
    return views.stance(newest(s, d), "slug")


@query("v10_promo_pressure", f"WITH {CAP} SELECT capture_date, count(*) FILTER (coalesce(headline_offer, '') <> '') AS n_on_sale, count(*) AS n FROM ok GROUP BY 1", ("capture_date",))
def _(s, d):
    return views.promo_pressure(history.successful(records(s, d)), DAY)


_WORDS = "w AS (SELECT slug, lower(trim(k.word)) AS word, k.n AS n FROM (SELECT slug, unnest(keywords) AS k FROM latest))"


@query("v13_keyword_cloud", f"WITH {LATEST}, {_WORDS} SELECT word, CAST(sum(n) AS BIGINT) AS n FROM w GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 40")
def _(s, d):
    return views.keyword_cloud(newest(s, d))


@query("v13_brand_words", f"WITH {LATEST}, {_WORDS}, c AS (SELECT slug, word, CAST(sum(n) AS BIGINT) AS n FROM w GROUP BY 1, 2) SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY slug ORDER BY n DESC, word) <= 12")
def _(s, d):
    return views.brand_words(newest(s, d), "slug")


@query("v16_gallery", f"""WITH {CAP}, g AS (SELECT slug, storefront, capture_date, date_diff('day', capture_date, (SELECT max(capture_date) FROM cap)) AS age FROM cap)
SELECT 'week' AS bucket, slug, storefront, capture_date FROM g WHERE age < 7 UNION ALL SELECT 'lastweek', slug, storefront, capture_date FROM g WHERE age BETWEEN 7 AND 13 UNION ALL SELECT 'month', slug, storefront, capture_date FROM g WHERE age < 30 UNION ALL SELECT 'all', slug, storefront, capture_date FROM g""", ("capture_date",))
def _(s, d):
    rows = records(s, d).select(*PLACE, DAY)
    each = [views.gallery(rows, DAY, b).select(F.lit(b).alias("bucket"), *PLACE, DAY) for b in ("week", "lastweek", "month", "all")]
    return each[0].unionByName(each[1]).unionByName(each[2]).unionByName(each[3])


@query("v17_price_bands", f"WITH {LATEST} SELECT slug, prices.price_min AS low, prices.price_median AS mid, prices.price_max AS high FROM latest WHERE prices.price_median IS NOT NULL")
def _(s, d):
    return newest(s, d).filter("prices.price_median IS NOT NULL").select("slug", F.col("prices.price_min").alias("low"), F.col("prices.price_median").alias("mid"), F.col("prices.price_max").alias("high")).orderBy("mid", "slug")


@query("v18_listing_depth", f"WITH {LATEST} SELECT slug, listing.prices.p25 AS p25, listing.prices.price_median AS mid, listing.prices.p75 AS p75, listing.discounted_share AS discounted_share, listing.on_sale_count AS on_sale_count FROM latest WHERE listing.prices.price_median IS NOT NULL")
def _(s, d):
    return newest(s, d).filter("listing.prices.price_median IS NOT NULL").select("slug", F.col("listing.prices.p25").alias("p25"), F.col("listing.prices.price_median").alias("mid"), F.col("listing.prices.p75").alias("p75"), F.col("listing.discounted_share").alias("discounted_share"), F.col("listing.on_sale_count").alias("on_sale_count")).orderBy("mid", "slug")


@query("v21_market_map", f"""WITH {LATEST}, {RUNS}, z AS (SELECT slug, sum(size) AS size FROM (SELECT slug, storefront, arg_max(product_count, snap_date) FILTER (ok) AS size FROM runs GROUP BY 1, 2) GROUP BY 1),
r AS (SELECT latest.slug, CASE WHEN greatest(listing.prices.price_median, prices.price_median) / least(listing.prices.price_median, prices.price_median) > 4 AND listing.prices.price_median IS NOT NULL AND prices.price_median IS NOT NULL THEN NULL ELSE coalesce(listing.prices.price_median, prices.price_median) END AS p, CAST(z.size AS BIGINT) AS s FROM latest LEFT JOIN z USING (slug)),
k AS (SELECT list_sort(list(p) FILTER (p IS NOT NULL)) AS lp, list_sort(list(s) FILTER (s IS NOT NULL)) AS ls FROM r), q AS (SELECT lp[len(lp) // 2 + 1] AS mp, ls[len(ls) // 2 + 1] AS ms FROM k WHERE len(lp) >= 3 AND len(ls) >= 3)
SELECT slug, coalesce(p, mp) AS price, coalesce(s, ms) AS size, p IS NULL OR s IS NULL AS estimated, CASE WHEN coalesce(p, mp) >= mp THEN 'premium' ELSE 'value' END || ' ' || CASE WHEN coalesce(s, ms) >= ms THEN 'broad' ELSE 'focused' END AS quadrant FROM r, q""")
def _(s, d):
    return views.market_map(newest(s, d), brand_sizes(s, d))


@query("v26_reputation", f"""WITH {LATEST}, r AS (SELECT slug, coalesce(is_self, false) AS own, reputation.rating AS rating, reputation.review_count AS review_count, reputation.rating IS NOT NULL AND coalesce(reputation.review_count, 0) >= 25 AS verified, len(coalesce(reputation.platforms, [])) AS np FROM latest),
m AS (SELECT avg(rating) FILTER (verified) AS market_mean, list_sort(list(rating) FILTER (verified AND NOT own)) AS l FROM r)
SELECT slug, rating, review_count, verified, row_number() OVER (ORDER BY CASE WHEN verified THEN 1e6 ELSE 0 END + coalesce(rating, 0) * 1000 + coalesce(review_count, 0) / 1e6 + CASE WHEN np > 0 THEN 0.1 ELSE 0 END DESC, slug) AS place, market_mean, l[len(l) // 2 + 1] AS pack_median FROM r, m""")
def _(s, d):
    return views.reputation_board(newest(s, d))


@query("v27_access_board", f"WITH {LATEST}, s AS (SELECT slug, accessibility_score FROM latest WHERE accessibility_score IS NOT NULL) SELECT *, row_number() OVER (ORDER BY accessibility_score DESC, slug) AS place, CAST(floor(avg(accessibility_score) OVER () + 0.5) AS BIGINT) AS market_mean FROM s")
def _(s, d):
    return views.access_board(newest(s, d))


@query("v32_footer", f"WITH {CAP} SELECT count(*) FILTER (status = 'success') AS n_success, count(DISTINCT slug) AS n_brands, count(DISTINCT capture_date) AS n_days FROM cap")
def _(s, d):
    return views.footer(records(s, d), DAY)


@query("a02_mentions", f"WITH {MENTIONS} SELECT item, slug, pos, rank FROM men")
def _(s, d):
    return voices(s, d)[1]


@query("a03_share_of_voice", f"""WITH {MENTIONS}, s AS (SELECT slug, count(*) AS mentions, avg(rank) AS r, sum(1 / rank) AS points FROM men GROUP BY 1), n AS (SELECT count(*) AS n FROM aio),
x AS (SELECT slug, coalesce(mentions, 0) AS mentions, n AS queries, round(coalesce(mentions, 0) / n, 3) AS visibility, round(r, 2) AS avg_rank, round(coalesce(points, 0), 4) AS points, round(coalesce(points, 0) / sum(points) OVER (), 3) AS sov FROM brand_list LEFT JOIN s USING (slug), n) SELECT * FROM x""")
def _(s, d):
    return voice_scores(s, d)


@query("a05_leaders", f"""WITH {MENTIONS}, s AS (SELECT slug, count(*) AS mentions, avg(rank) AS r, sum(1 / rank) AS points FROM men GROUP BY 1), n AS (SELECT count(*) AS n FROM aio),
x AS (SELECT slug, coalesce(mentions, 0) AS mentions, n AS queries, round(coalesce(mentions, 0) / n, 3) AS visibility, round(r, 2) AS avg_rank, round(coalesce(points, 0), 4) AS points, round(coalesce(points, 0) / sum(points) OVER (), 3) AS sov FROM brand_list LEFT JOIN s USING (slug), n) SELECT * FROM x ORDER BY sov DESC, slug LIMIT 5""")
def _(s, d):
    return mentions.leaders(voice_scores(s, d))


@query("o11_silent_answers", f"WITH {MENTIONS} SELECT DISTINCT item FROM men WHERE item NOT IN (SELECT item FROM men WHERE slug IN (SELECT slug FROM brand_list WHERE is_self))")
def _(s, d):
    answers, found = voices(s, d)
    return mentions.absent(answers, found, "answer_id", brands(s, d).filter("is_self"))


def _ask(s, d):
    return Ask(records(s, d), brands(s, d), voice_scores(s, d))


@query("q12_who_on_sale", f"WITH {LATEST} SELECT brand, headline_offer || ' | ' || coalesce(max_discount_pct, 0) AS value, capture_date AS on_date FROM latest WHERE coalesce(headline_offer, '') <> ''", ("on_date",))
def _(s, d):
    return _ask(s, d).who_on_sale().select("brand", "value", "on_date")


@query("q13_deepest", f"WITH {LATEST} SELECT brand, CAST(max_discount_pct AS VARCHAR) AS value, capture_date AS on_date FROM latest WHERE max_discount_pct > 0 ORDER BY max_discount_pct DESC, slug LIMIT 1", ("on_date",))
def _(s, d):
    return _ask(s, d).deepest().select("brand", "value", "on_date")


_ASK = f"""WITH {LATEST}, {MENTIONS}, own AS (SELECT slug FROM brand_list WHERE is_self LIMIT 1), mine AS (SELECT * FROM ok WHERE slug IN (SELECT slug FROM own)),
day AS (SELECT * FROM mine QUALIFY row_number() OVER (PARTITION BY slug, capture_date ORDER BY captured_at DESC, capture_id DESC) = 1),
hero AS (SELECT brand, coalesce(hero_message, '') AS m, lag(coalesce(hero_message, '')) OVER (PARTITION BY brand ORDER BY capture_date) AS b, capture_date FROM day),
wk AS (SELECT * FROM ok WHERE capture_date BETWEEN (SELECT date_trunc('week', max(capture_date)) FROM ok) AND (SELECT max(capture_date) FROM ok) QUALIFY row_number() OVER (PARTITION BY slug ORDER BY capture_date DESC, captured_at DESC, capture_id DESC) = 1),
sc AS (SELECT slug, sum(1 / rank) AS points FROM men GROUP BY 1), vo AS (SELECT slug, round(coalesce(points, 0) / sum(points) OVER (), 3) AS sov FROM brand_list LEFT JOIN sc USING (slug) ORDER BY 2 DESC, 1 LIMIT 5)
SELECT 'offer' AS topic, brand, coalesce(headline_offer, 'no offer') AS value, capture_date AS on_date, 'headline_offer' AS source FROM latest WHERE slug IN (SELECT slug FROM own)
UNION ALL SELECT * FROM (SELECT 'price', brand, CAST(coalesce(listing.prices.price_median, prices.price_median) AS VARCHAR), capture_date, 'prices' FROM mine WHERE coalesce(listing.prices.price_median, prices.price_median) IS NOT NULL ORDER BY capture_date DESC, captured_at DESC, capture_id DESC LIMIT 1)
UNION ALL SELECT * FROM (SELECT 'hero_change', brand, m, capture_date, 'hero_message' FROM hero WHERE b IS NOT NULL AND m <> b AND m <> '' ORDER BY capture_date DESC LIMIT 1)
UNION ALL SELECT 'on_sale', brand, headline_offer || ' | ' || coalesce(max_discount_pct, 0), capture_date, 'headline_offer' FROM wk WHERE coalesce(headline_offer, '') <> ''
UNION ALL SELECT * FROM (SELECT 'deepest', brand, CAST(max_discount_pct AS VARCHAR), capture_date, 'max_discount_pct' FROM latest WHERE max_discount_pct > 0 ORDER BY max_discount_pct DESC, slug LIMIT 1)
UNION ALL SELECT 'share_of_voice', slug, CAST(sov AS VARCHAR), NULL, 'answers' FROM vo
UNION ALL SELECT 'on_sale', brand, headline_offer || ' | ' || coalesce(max_discount_pct, 0), capture_date, 'headline_offer' FROM latest WHERE coalesce(headline_offer, '') <> ''"""


@query("q16_ask", _ASK, ("on_date",))
def _(s, d):
    asked = _ask(s, d)
    own = brands(s, d).filter("is_self").first()["brand"]
    answers = [asked.ask(q) for q in (f"Is {own} on sale?", f"What is the price at {own}?", f"When did {own} change its hero message?", "Who is on sale this week?", "Who has the deepest discount?", "share of voice", "Which offers are on sale?")]
    out = answers[0]
    for a in answers[1:]:
        out = out.unionByName(a)
    return out


def _docs(s, d):
    return table(s, d, "documents").select("doc_id", "text")


@query("x02_normal", r"SELECT doc_id, trim(lower(regexp_replace(coalesce(text, ''), '[\s\x{000B}\x{0085}\p{Z}]+', ' ', 'g'))) AS t FROM documents")
def _(s, d):
    return _docs(s, d).select("doc_id", page.normal(F.col("text")).alias("t"))


@query("x04_offer_strength", r"SELECT doc_id, coalesce(list_max(list_filter(list_transform(regexp_extract_all(lower(coalesce(text, '')), '([0-9]{1,3})[\s\x{000B}\x{0085}\p{Z}]*%', 1), lambda x: CAST(x AS INT)), lambda x: x <= 90)), CASE WHEN regexp_matches(lower(text), '\b(sale|clearance|outlet|black friday|cyber monday)\b') THEN 5 ELSE 0 END) AS strength FROM documents")
def _(s, d):
    return _docs(s, d).select("doc_id", page.offer_strength(F.col("text")).alias("strength"))


_BLANK = r"\s\x{000B}\x{0085}\p{Z}"
_NORMAL = f"trim(lower(regexp_replace(coalesce(text, ''), '[{_BLANK}]+', ' ', 'g')))"
_TEXTS = f"t AS (SELECT doc_id, coalesce(text, '') AS raw, {_NORMAL} AS t FROM documents)"


def sql_pattern(p: str) -> str:
    """A pattern as a literal of the checking SQL, whose blanks are ASCII ones unless told."""
    out, inside = "", False
    for part in re.findall(r"\\.|[\[\]]|[^\\\[\]]+", p):
        inside = part == "[" or (inside and part != "]")
        out += (_BLANK if inside else f"[{_BLANK}]") if part == r"\s" else part
    return "'" + out.replace("'", "''") + "'"


def sql_found(patterns, c: str = "t", group: int = 0) -> str:
    """All matches in the order of patterns, as a list."""
    return "flatten([" + ", ".join(f"regexp_extract_all({c}, {sql_pattern(p)}, {group})" for p in patterns) + "])"


def sql_distinct(items: str, keep: str = "x <> ''") -> str:
    """A list's distinct items in order, blanks around them off."""
    return f"list_filter(list_filter(list_transform({items}, lambda x: trim(x)), lambda x: {keep}), lambda x, i: list_position(list_filter(list_transform({items}, lambda y: trim(y)), lambda x: {keep}), x) = i)"


def sql_phrases(patterns, limit: int = 6) -> str:
    return f"array_to_string(list_slice({sql_distinct(sql_found(patterns))}, 1, {limit}), '|')"


def sql_flags(c: str, named) -> str:
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches({c}, {sql_pattern(p)}) THEN '{n}' END" for n, p in named.items()) + "], lambda x: x IS NOT NULL), '|')"


def sql_group(c: str, p: str, group: int = 1) -> str:
    return f"nullif(regexp_extract({c}, {sql_pattern(p)}, {group}), '')"


def bars(c) -> Column:
    return F.array_join(c, "|")


@query("x06_offers", f"""WITH {_TEXTS}, f AS (SELECT doc_id, {sql_distinct(sql_found(page.OFFERS))} AS found, list_max(list_filter(list_transform(regexp_extract_all(t, '([0-9]{{1,3}})[{_BLANK}]*%', 1), lambda x: CAST(x AS INT)), lambda x: x <= 90)) AS most FROM t)
SELECT doc_id, array_to_string(list_slice(found, 1, 12), '|') AS offers, coalesce(list_filter(found, lambda x: starts_with(x, 'up to'))[1], most || '% off', found[1]) AS headline_offer, most AS max_discount_pct FROM f""")
def _(s, d):
    return _docs(s, d).select("doc_id", page.offers(F.col("text")).alias("o")).select("doc_id", bars("o.offers").alias("offers"), "o.headline_offer", "o.max_discount_pct")


@query("x07_delivery", f"WITH {_TEXTS} SELECT doc_id, {sql_phrases(page.DELIVERY, 8)} AS promises FROM t")
def _(s, d):
    return _docs(s, d).select("doc_id", bars(page.delivery(F.col("text"))).alias("promises"))


@query("x08_codes", f"""WITH {_TEXTS} SELECT doc_id, array_to_string(list_slice({sql_distinct(sql_found(page.CODES, "raw", 1), "upper(x) NOT IN ('HTTPS', 'HTML', 'CODE', 'THE')")}, 1, 8), '|') AS codes FROM t""")
def _(s, d):
    return _docs(s, d).select("doc_id", bars(page.discount_codes(F.col("text"))).alias("codes"))


@query("x09_product_mix", "WITH t AS (SELECT doc_id, trim(lower(regexp_replace(coalesce(text, ''), '[\\s\\x{000B}\\x{0085}\\p{Z}]+', ' ', 'g'))) AS t FROM documents), c AS ("
    + " UNION ALL ".join(f"SELECT doc_id, '{c}' AS category, " + " + ".join(f"len(regexp_extract_all(t, '(?:^|{_B}){w}'))" for w in ws) + " AS n FROM t" for c, ws in TAXONOMY.items())
    + ") SELECT doc_id, category, n AS count, round_even(n / sum(n) OVER (PARTITION BY doc_id), 4) AS share FROM c WHERE n > 0")
def _(s, d):
    return _docs(s, d).select("doc_id", F.explode(page.product_mix(F.col("text"), TAXONOMY)).alias("m")).select("doc_id", "m.*")


@query("x10_keywords", "WITH t AS (SELECT doc_id, trim(lower(regexp_replace(coalesce(text, ''), '[\\s\\x{000B}\\x{0085}\\p{Z}]+', ' ', 'g'))) AS t FROM documents), l AS (SELECT doc_id, regexp_extract_all(t, '[a-z][a-z''’]{2,}') AS l FROM t), w AS (SELECT doc_id, unnest(l) AS word, generate_subscripts(l, 1) AS pos FROM l), f AS (SELECT * FROM w WHERE word NOT IN ("
    + ", ".join(f"'{x}'" for x in page.STOPWORDS) + ")), c AS (SELECT doc_id, word, count(*) AS n, min(pos) AS p FROM f GROUP BY 1, 2) SELECT doc_id, word, n FROM c QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, p) <= 20")
def _(s, d):
    """The 20 commonest words of each document, the earlier first on a tie; counted per document after a partial combine."""
    words = _docs(s, d).select("doc_id", F.posexplode(page.keyword_tokens(F.col("text"))).alias("pos", "word"))
    counted = words.groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("pos"))
    return counted.withColumn("k", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), "pos"))).filter("k <= 20").select("doc_id", "word", "n")


@query("x34_free_delivery", r"""WITH t AS (SELECT doc_id, trim(lower(regexp_replace(coalesce(text, ''), '[\s\x{000B}\x{0085}\p{Z}]+', ' ', 'g'))) AS t FROM documents),
o AS (SELECT *, nullif(regexp_extract(t, 'free (?:uk )?(?:standard |express |next day )?(?:delivery|shipping)\s*(?:on orders?)?\s*over\s*£\s?(\d{1,4})', 1), '') AS v FROM t)
SELECT doc_id, CASE WHEN v IS NOT NULL THEN CAST(v AS INT) WHEN regexp_matches(t, 'free (?:uk )?(?:standard |express |next day )?(?:delivery|shipping)\b') THEN 0 END AS threshold FROM o""")
def _(s, d):
    return _docs(s, d).select("doc_id", page.free_delivery_threshold(F.col("text")).alias("threshold"))


_OFFER = f"CASE WHEN pct BETWEEN 1 AND 60 THEN pct || '% off' WHEN pct IS NULL AND flat IS NOT NULL THEN '£' || flat || ' off' END"
_OVER_SQL = sql_group("t", page.FREE_DELIVERY + r"\s*(?:on orders?)?\s*over\s*£\s?(\d{1,4})")
_FREE = f"CASE WHEN {_OVER_SQL} IS NOT NULL THEN CAST({_OVER_SQL} AS INT) WHEN regexp_matches(t, {sql_pattern(page.FREE_DELIVERY)} || '\\b') THEN 0 END"
_first = lambda ps: f"({sql_distinct(sql_found(ps))})[1]"


@query("x44_trading", f"""WITH {_TEXTS}, l AS (SELECT *, t || ' ' || lower(raw) AS low, CAST(coalesce({sql_group('t', rf"(\d{{1,2}})\s*%\s*off[^.!?]{{0,40}}(?:{page.SIGN_UP})")}, {sql_group('t', rf"(?:{page.SIGN_UP})[^.!?]{{0,40}}?(\d{{1,2}})\s*%\s*off")}) AS INT) AS pct, {sql_group('t', rf"£\s?(\d{{1,3}})\s*off[^.!?]{{0,40}}(?:{page.SIGN_UP})")} AS flat FROM t)
SELECT doc_id, {sql_flags('low', page.FINANCE)} AS finance, {" OR ".join(f"regexp_matches(low, {sql_pattern(page.FINANCE[x])})" for x in page.PAY_LATER)} AS has_bnpl, {_OFFER} AS email_capture_offer, {_FREE} AS free_delivery_threshold, {sql_phrases(page.SCARCITY)} AS scarcity, {sql_phrases(page.URGENCY)} AS urgency, {sql_phrases(page.MULTIBUY)} AS multibuy,
{_first(page.GIFT)} AS gift_with_purchase, {_first(page.LOYALTY)} AS loyalty, {_first(page.PERSONAL)} AS personalisation_upsell, regexp_matches(low, {sql_pattern(page.SMS_MARKUP)}) OR regexp_matches(t, {sql_pattern(page.SMS_COPY)}) AS sms_capture,
coalesce({", ".join(f"CASE WHEN regexp_matches(low, {sql_pattern(p)}) THEN '{n}' END" for n, p in page.CHAT.items())}, CASE WHEN regexp_matches(t, {sql_pattern(page.CHAT_COPY)}) THEN 'copy' END) AS live_chat FROM l""")
def _(s, d):
    """All levers of each document, its text standing for the markup too."""
    read = _docs(s, d).select("doc_id", page.trading_signals(F.col("text"), F.col("text")).alias("x")).select("doc_id", "x.*")
    return read.withColumns({f.name: bars(f.name) for f in read.schema.fields if f.dataType.typeName() == "array"})


_NAMES, _PRICES = (f"regexp_extract_all(raw, {sql_pattern('(?i)' + page.DELIVERY_OPTION)}, {i})" for i in (1, 2))
_TITLED = f"array_to_string(list_transform(regexp_extract_all(lower(trim(regexp_replace(z[1], '[{_BLANK}]+', ' ', 'g'))), '[\\p{{L}}]+|[^\\p{{L}}]+'), lambda w: upper(w[1]) || w[2:]), '')"


@query("x46_policy_pages", f"""WITH {_TEXTS}, o AS (SELECT *, list_transform(list_zip({_NAMES}, {_PRICES}), lambda z: {_TITLED} || ' ' || replace(lower(z[2]), ' ', '')) AS opts,
CAST(coalesce({sql_group('raw', '(?i)' + page.RETURN_WINDOW, 1)}, {sql_group('raw', '(?i)' + page.RETURN_WINDOW, 2)}) AS INT) AS days FROM t)
SELECT doc_id, array_to_string(list_slice(list_filter(opts, lambda x, i: list_position(opts, x) = i), 1, 8), '|') AS options, {_FREE} AS free_threshold, regexp_matches(t, 'next[- ]?day|express|same[- ]?day') AS express, lower(regexp_replace({sql_group('raw', '(?i)' + page.CUTOFF)}, '[{_BLANK}]+', '', 'g')) AS express_cutoff, regexp_matches(t, 'click (?:&|and) collect') AS click_collect,
CASE WHEN days BETWEEN 1 AND 365 THEN days END AS window_days, CASE WHEN regexp_matches(raw, {sql_pattern('(?i)' + page.FREE_RETURNS)}) THEN true WHEN regexp_matches(raw, {sql_pattern('(?i)' + page.PAID_RETURNS)}) THEN false END AS free_returns, regexp_matches(t, '\\bexchanges?\\b') AS exchanges FROM o""")
def _(s, d):
    read = _docs(s, d).select("doc_id", page.delivery_page(F.col("text")).alias("d"), page.returns_page(F.col("text")).alias("r")).select("doc_id", "d.*", "r.*")
    return read.withColumn("options", bars(F.transform("options", lambda o: F.concat_ws(" ", o["name"], o["price"]))))


@query("x48_structured_ratings", f"""WITH {CAP}, p AS (SELECT capture_id, reputation.rating AS r, reputation.review_count AS n FROM ok WHERE reputation.rating IS NOT NULL), s AS (SELECT *, round(CAST(CAST(r * 2 AS VARCHAR) AS DOUBLE) / 10 * 5, 2) AS rating FROM p)
SELECT capture_id, CASE WHEN rating > 0 AND rating <= 5 THEN rating END AS rating, CASE WHEN rating > 0 AND rating <= 5 THEN CAST(n AS BIGINT) END AS review_count, 'Feefo' AS platforms, CASE WHEN rating > 0 AND rating <= 5 THEN 'structured' END AS source, CASE WHEN rating > 0 AND rating <= 5 THEN 'high' END AS confidence FROM s""")
def _(s, d):
    """Ratings of made-up markup: captured ratings on a scale of ten, beside a smaller blob that must lose."""
    ok = history.successful(records(s, d)).filter("reputation.rating IS NOT NULL")
    n = F.coalesce(F.format_number("reputation.review_count", 0), F.lit(""))
    blob = F.concat(F.lit('<script>feefo</script>{"aggregateRating": {"ratingValue": "'), (F.col("reputation.rating") * 2).cast("string"), F.lit('", "bestRating": 10, "reviewCount": "'), n, F.lit('"}}'))
    read = ok.select("capture_id", page.reputation(blob, F.lit("")).alias("x")).select("capture_id", "x.*")
    return read.select("capture_id", "rating", "review_count", bars("platforms").alias("platforms"), "source", "confidence")


_COUNT = f"CAST(replace({sql_group('t', r'(\d[\d,]{1,})\s*\+?\s*(?:reviews|ratings)')}, ',', '') AS BIGINT)"
_VALUE = f"CAST({sql_group('t', r'(\d(?:\.\d{1,2})?)\s*(?:/\s*5|out of\s*5|stars?\b)')} AS DOUBLE)"


@query("x50_reputation", f"""WITH {_TEXTS}, v AS (SELECT doc_id, CASE WHEN {_COUNT} >= 5 AND {_VALUE} BETWEEN 1 AND 5 THEN {_VALUE} END AS rating, CASE WHEN {_COUNT} >= 5 THEN {_COUNT} END AS review_count, {sql_flags('lower(raw)', page.REVIEWS)} AS platforms FROM t)
SELECT *, coalesce(rating, 0) <> 0 OR coalesce(review_count, 0) <> 0 OR platforms <> '' AS has_reviews, CASE WHEN rating IS NOT NULL OR review_count IS NOT NULL THEN 'text' END AS source, CASE WHEN rating IS NULL THEN NULL WHEN review_count IS NOT NULL THEN 'high' ELSE 'low' END AS confidence FROM v""")
def _(s, d):
    read = _docs(s, d).select("doc_id", page.reputation(F.col("text"), F.col("text")).alias("x")).select("doc_id", "x.*")
    return read.withColumn("platforms", bars("platforms"))


_SHOWN_SQL = sql_pattern(r"£\s?([0-9]{1,4}(?:\.[0-9]{2})?)")


@query("x31_price_bands", f"""WITH {_TEXTS}, z AS (SELECT doc_id, list_zip(regexp_extract_all(raw, {_SHOWN_SQL}, 1), regexp_split_to_array(raw, {_SHOWN_SQL})) AS z FROM t),
k AS (SELECT doc_id, list_sort(list_filter(list_transform(list_filter(z, lambda x: x[1] IS NOT NULL AND NOT regexp_matches(lower(regexp_replace(right(x[2], 80), '(?s)^.*[\n\r]', '')), '{"|".join(prices.ADD_ONS)}')), lambda x: CAST(x[1] AS DOUBLE)), lambda p: p BETWEEN 1 AND 2000)) AS p FROM z)
SELECT doc_id, len(p) AS count, p[1] AS min, round_even((p[(len(p) + 1) // 2] + p[len(p) // 2 + 1]) / 2, 2) AS median, p[-1] AS max, array_to_string(p[1:30], '|') AS sample FROM k""")
def _(s, d):
    scanned = _docs(s, d).select("doc_id", prices.scan(F.col("text"), F.col("text")).alias("p"))
    band = scanned.select("doc_id", page.home_band(prices.home_prices(F.col("p"))).alias("b")).select("doc_id", "b.*").drop("currency")
    return band.withColumn("sample", bars(F.transform("sample", lambda x: x.cast("string"))))


_PAGE = f"WITH {CAP}, p AS (SELECT * FROM ok WHERE hero_message IS NOT NULL AND seo.title IS NOT NULL) "


@query("x57_extract_all")
def _(s, d):
    """The markup pass and the whole record of made-up pages in one select."""
    p = html.parsed(pages(s, d))
    text, markup = F.col("page.visible_text"), F.col("html")
    scanned = p.withColumn("scan", prices.scan(markup, text))
    return scanned.select(
        "capture_id", page.blocked(markup).alias("blocked"), html.hero(F.lit(None).cast("string")).alias("hero"), F.to_json("page.menu").alias("menu"), F.to_json(page.offers(text, html.banner_texts())).alias("offers"), F.to_json(page.delivery(text)).alias("delivery"),
        F.to_json(page.discount_codes(text)).alias("codes"), F.to_json(page.keywords(text)).alias("keywords"), F.to_json(page.product_mix(text, TAXONOMY)).alias("mix"), F.to_json(page.home_band(prices.home_prices(F.col("scan")))).alias("prices"),
        F.to_json(html.seo()).alias("seo"), html.accessibility()["score"].alias("access"), F.to_json(page.trading_signals(markup, text)).alias("trading"), F.to_json(page.reputation(markup, text)).alias("reputation"), F.col("page.delivery_url").alias("delivery_url"), F.col("page.returns_url").alias("returns_url"),
        F.to_json(page.delivery_page(text)).alias("delivery_info"), F.to_json(page.returns_page(text)).alias("returns_info"),
    )


@query("x11_seo_counts", _PAGE + "SELECT capture_id, CASE WHEN trim(hero_message) = '' THEN 0 ELSE 1 END AS h1_count, coalesce(len(menu), 0) + 2 AS n_links, coalesce(len(offers), 0) AS n_images, 1 + coalesce(len(delivery), 0) AS n_h2, 3 AS n_fields FROM p")
def _(s, d):
    return html.parsed(pages(s, d)).select("capture_id", F.col("page.n_h1").alias("h1_count"), F.col("page.n_links").alias("n_links"), F.col("page.n_images").alias("n_images"), F.col("page.n_h2").alias("n_h2"), F.round(3 * F.col("page.ratios")[6] + 1).cast("int").alias("n_fields"))


@query("x23_access_issues", _PAGE + "SELECT capture_id, (CASE WHEN trim(seo.title) = '' THEN 'doc_title | ' ELSE '' END) || 'form_labels | viewport | skip_link' AS issues, CAST(round_even(100 - (CASE WHEN trim(seo.title) = '' THEN 8 ELSE 0 END + 8 * 0.333 + 6 + 3) * 100 / 96, 0) AS INT) AS score FROM p")
def _(s, d):
    """Accessibility of the made-up pages: what they lack must be named, by weight."""
    return html.parsed(pages(s, d)).select("capture_id", F.array_join(html.top_issues(), " | ").alias("issues"), html.accessibility()["score"].alias("score"))


@query("x61_nearest_colour", "WITH v AS (SELECT vec_id, CAST(floor(abs(embedding[1]) * 1000) AS BIGINT) % 256 AS r, CAST(floor(abs(embedding[2]) * 1000) AS BIGINT) % 256 AS g, CAST(floor(abs(embedding[3]) * 1000) AS BIGINT) % 256 AS b FROM embeddings), p(i, name, x, y, z) AS (VALUES " + ", ".join(f"({i}, '{n}', {a}, {b}, {c})" for i, (n, (a, b, c)) in enumerate(PALETTE.items())) + ") SELECT vec_id, arg_min(name, ((r-x)*(r-x)+(g-y)*(g-y)+(b-z)*(b-z)) * 100 + i) AS name FROM v, p GROUP BY 1")
def _(s, d):
    ch = lambda i: F.pmod(F.floor(F.abs(F.col("embedding")[i]) * 1000), F.lit(256))
    return table(s, d, "embeddings").select("vec_id", colours.nearest(ch(0), ch(1), ch(2), PALETTE).alias("name"))


@query("x63_trend_reduce", "WITH t AS (SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2) SELECT event_type, arg_max(n, day) AS latest, round(avg(n), 1) AS mean, array_to_string((list(n ORDER BY day))[-13:], ' ') AS points FROM t GROUP BY 1")
def _(s, d):
    daily = table(s, d, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return views.trend_reduce(daily, "event_type", "day", "n").select("event_type", "latest", "mean", F.array_join(F.transform("points", lambda x: x.cast("string")), " ").alias("points"))


@query("st_weekly_events", "SELECT event_type, CAST(date_trunc('week', ts) AS DATE) AS week, count(*) AS n FROM events GROUP BY 1, 2", ("week",))
def _(s, d):
    """Batch form of the streamed calendar buckets; tests hold the stream against it."""
    return table(s, d, "events").groupBy("event_type", F.to_date(F.date_trunc("week", "ts")).alias("week")).agg(F.count(F.lit(1)).alias("n"))


@query("v01_brand_index", f"""WITH {CAP}, p AS (SELECT slug, arg_min(brand, (capture_date, captured_at, capture_id)) AS brand, arg_min(coalesce(is_self, false), (capture_date, captured_at, capture_id)) AS own, count(*) AS n_records, count(DISTINCT capture_date) AS n_dates, max(capture_date) AS last_date FROM cap GROUP BY 1)
SELECT *, CAST(row_number() OVER (ORDER BY own DESC, brand, slug) AS INT) AS place FROM p""", ("last_date",))
def _(s, d):
    return tables.brand_index(records(s, d), DAY, ORDER[1:])


@query("v01_date_index", f"WITH {CAP} SELECT capture_date, count(*) AS n_records, count(DISTINCT slug) AS n_brands FROM cap GROUP BY 1", ("capture_date",))
def _(s, d):
    return tables.date_index(records(s, d), DAY)


_ANY = CAP + ", lf AS (SELECT * FROM cap QUALIFY row_number() OVER (PARTITION BY slug ORDER BY (status = 'success') DESC NULLS LAST, capture_date DESC, captured_at DESC, capture_id DESC) = 1)"


@query("v08_market_snapshot", f"WITH {_ANY} SELECT slug, brand, hero_message AS hero, nullif(headline_offer, '') AS offer, delivery[1] AS delivery, array_to_string(coalesce(discount_codes, []), ' | ') AS codes, status FROM lf")
def _(s, d):
    return tables.market_snapshot(history.latest_or_failed(records(s, d), ["slug"], ORDER))


@query("v09_competitor_card", f"""WITH {LATEST}, {SHARES}, nn AS (SELECT slug, category, share, row_number() OVER (PARTITION BY slug ORDER BY share DESC, category) AS place FROM sh), t AS (SELECT *, max(share) OVER (PARTITION BY slug) AS widest FROM nn WHERE place <= 6),
m AS (SELECT slug, string_agg(category || ' ' || CAST(floor(100 * share / greatest(widest, 0.0001) + 0.5) AS INT), ' | ' ORDER BY place) AS mix FROM t GROUP BY 1)
SELECT l.slug, l.brand, l.capture_date AS on_date, l.hero_message AS hero, array_to_string(coalesce(l.menu, []), ' | ') AS menu, nullif(l.headline_offer, '') AS offer, l.prices.price_min AS price_low, l.prices.price_median AS price_mid, l.prices.price_max AS price_high, m.mix FROM latest l LEFT JOIN m USING (slug)""", ("on_date",))
def _(s, d):
    return tables.competitor_card(newest(s, d), brand_shares(s, d), DAY)


_RATE = lambda c, lo, hi: f"CASE WHEN coalesce(length({c}), 0) BETWEEN {lo} AND {hi} THEN 'good' WHEN length({c}) > 0 THEN 'warn' ELSE 'bad' END"


@query("v14_seo_table", f"WITH {LATEST} SELECT slug, seo.title AS title, {_RATE('seo.title', 50, 62)} AS title_rating, seo.meta_description AS description, {_RATE('seo.meta_description', 120, 160)} AS description_rating, seo.h1_count AS h1_count, seo.word_count AS word_count, accessibility_score FROM latest")
def _(s, d):
    return tables.seo_table(newest(s, d))


@query("v15_latest_shot", f"WITH {CAP} SELECT slug, storefront, capture_date, capture_id, status FROM cap WHERE render_ok QUALIFY row_number() OVER (PARTITION BY slug, storefront ORDER BY capture_date DESC, captured_at DESC, capture_id DESC) = 1", ("capture_date",))
def _(s, d):
    return tables.latest_shot(records(s, d), PLACE, ORDER, F.col("render_ok")).select(*PLACE, DAY, "capture_id", "status")


_OVER = lambda c: f"CASE WHEN {c} = 0 THEN 'free' WHEN {c} IS NOT NULL THEN 'over £' || {c} END"


@query("v19_levers", f"WITH {LATEST} SELECT slug, coalesce(trading.has_bnpl, false) AS has_bnpl, array_to_string(coalesce(trading.finance, []), ' | ') AS finance, nullif(trading.email_capture_offer, '') AS sign_up, {_OVER('trading.free_delivery_threshold')} AS free_delivery, array_to_string(list_slice(coalesce(trading.scarcity, []), 1, 2), ' | ') AS scarcity FROM latest")
def _(s, d):
    return tables.levers_table(newest(s, d))


@query("v19_policies", f"""WITH n AS (SELECT slug, string_agg(text, chr(10) ORDER BY text) AS text, any_value(doc_id) AS doc_id FROM (SELECT * FROM documents WHERE source IN ('delivery_page', 'returns_page') AND slug IS NOT NULL AND text IS NOT NULL QUALIFY row_number() OVER (PARTITION BY slug, source ORDER BY fetched_at DESC NULLS LAST, doc_id DESC) = 1) GROUP BY 1),
t AS (SELECT slug, coalesce(text, '') AS raw, {_NORMAL} AS t FROM n), o AS (SELECT *, list_transform(list_zip({_NAMES}, {_PRICES}), lambda z: {_TITLED} || ' ' || replace(lower(z[2]), ' ', '')) AS opts, {_FREE} AS thr,
CAST(coalesce({sql_group('raw', '(?i)' + page.RETURN_WINDOW, 1)}, {sql_group('raw', '(?i)' + page.RETURN_WINDOW, 2)}) AS INT) AS days, lower(regexp_replace({sql_group('raw', '(?i)' + page.CUTOFF)}, '[{_BLANK}]+', '', 'g')) AS cut FROM t)
SELECT slug, array_to_string(list_slice(list_filter(opts, lambda x, i: list_position(opts, x) = i), 1, 3), ' | ') AS options, {_OVER('thr')} AS free_delivery, CASE WHEN regexp_matches(t, 'next[- ]?day|express|same[- ]?day') THEN 'yes' || coalesce(' by ' || cut, '') END AS express,
CASE WHEN days BETWEEN 1 AND 365 THEN days END AS window_days, CASE WHEN regexp_matches(raw, {sql_pattern('(?i)' + page.FREE_RETURNS)}) THEN 'free' WHEN regexp_matches(raw, {sql_pattern('(?i)' + page.PAID_RETURNS)}) THEN 'paid' END AS return_cost, regexp_matches(t, '\\bexchanges?\\b') AS exchanges FROM o""")
def _(s, d):
    """The policy tables over each brand's newest delivery and returns pages, read together."""
    pages_of = table(s, d, "documents").filter("source IN ('delivery_page', 'returns_page') AND slug IS NOT NULL AND text IS NOT NULL")
    newest_page = history.latest(pages_of, ["slug", "source"], ["fetched_at", "doc_id"])
    both = newest_page.groupBy("slug").agg(F.array_join(F.array_sort(F.collect_list("text")), "\n").alias("text"))  # two pages a brand
    return tables.policy_table(both, page.delivery_page(F.col("text")), page.returns_page(F.col("text")))


@query("a04_run_records", f"WITH {MENTIONS}, k AS (SELECT item, count(*) AS k FROM men GROUP BY 1), e AS (SELECT run_date, substr(coalesce(answer_text, ''), 1, 600) AS x, k FROM aio LEFT JOIN k ON aio.answer_id = k.item) SELECT run_date, count(*) AS queries_total, count(*) FILTER (x <> '') AS n_answered, CAST(coalesce(sum(k), 0) AS BIGINT) AS n_mentions, coalesce(bool_or(k > 0), false) AS ok, CAST(sum(length(x)) AS BIGINT) AS excerpt_chars FROM e GROUP BY 1", ("run_date",))
def _(s, d):
    answers, found = voices(s, d)
    return mentions.run_records(answers, found, "answer_id", "run_date", "answer_text")


@query("s05_answer_log", "SELECT run_date, count(*) AS n FROM aio GROUP BY 1 ORDER BY run_date DESC LIMIT 104", ("run_date",))
def _(s, d):
    return history.keep_last(table(s, d, "aio").groupBy("run_date").agg(F.count(F.lit(1)).alias("n")), ["run_date"], history.ANSWER_RUN_CAP)


@query("s06_catalogue_log", f"WITH {RUNS} SELECT snap_date, count(*) AS n, count(*) FILTER (ok) AS n_ok FROM runs GROUP BY 1 ORDER BY snap_date DESC LIMIT 400", ("snap_date",))
def _(s, d):
    runs = catalogue_runs(s, d).groupBy("snap_date").agg(F.count(F.lit(1)).alias("n"), F.count_if("ok").alias("n_ok"))
    return history.keep_last(runs, ["snap_date"], history.CATALOGUE_RUN_CAP)


def site_files(s, d):
    """Sitemaps and robots made up from snapshots, one site per storefront and date: an index with a products file and a pages file; every second site names its index in robots."""
    good = snapshots(s, d).filter("ok AND handles IS NOT NULL").withColumn("site", F.concat_ws("|", "slug", "storefront", F.col("snap_date").cast("string")))
    base = F.concat(F.lit("https://shop.example/"), F.xxhash64("site").cast("string"))
    named = F.pmod(F.xxhash64("site"), F.lit(2)) == 0
    root = F.concat(base, F.when(named, F.lit("/maps/all.xml")).otherwise(F.lit("/sitemap.xml")))
    entity = lambda x: F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    key = lambda h: F.regexp_replace(F.regexp_replace(h, r"(?s)[?#].*$", ""), r"^.*/(?=[^/]*/*$)|/+$", "")
    urls = F.array_join(F.transform(F.filter("handles", lambda h: F.trim(key(h)) != ""), lambda h: F.concat(F.lit("<url><loc> "), base, F.lit("/products/"), entity(F.trim(key(h))), F.lit("/?v=1 </loc></url>"))), "")
    index = F.concat(F.lit("<SitemapIndex><sitemap><loc>"), base, F.lit("/products_1.xml</loc></sitemap><sitemap><loc>"), base, F.lit("/pages.xml</loc></sitemap></SitemapIndex>"))
    files = F.array(F.struct(root.alias("url"), index.alias("body")), F.struct(F.concat(base, F.lit("/products_1.xml")).alias("url"), F.concat(F.lit("<urlset>"), urls, F.lit("</urlset>")).alias("body")), F.struct(F.concat(base, F.lit("/pages.xml")).alias("url"), F.lit("<urlset><url><loc>https://shop.example/products/not-me</loc></url></urlset>").alias("body")))
    maps = good.select(F.col("site").alias("slug"), F.explode(files).alias("f")).select("slug", "f.url", "f.body")
    robots = good.select(F.col("site").alias("slug"), F.concat(base, F.lit("/")).alias("base_url"), F.when(named, F.concat(F.lit("User-agent: *\n SITEMAP : "), root)).otherwise(F.lit("")).alias("body"))
    return maps, robots


_KEYED = r"""k AS (SELECT slug, storefront, snap_date, list_sort(list_distinct(list_filter(list_transform(handles, lambda h: lower(trim(regexp_replace(regexp_replace(h, '[?#].*$', '', 's'), '^.*/([^/]*)/*$', '\1')))), lambda x: x <> ''))) AS hs FROM (
SELECT * FROM catalogue_snapshot QUALIFY row_number() OVER (PARTITION BY slug, storefront, snap_date ORDER BY captured_at DESC, snapshot_id DESC) = 1) WHERE ok AND handles IS NOT NULL)"""


@query("c10_collect", f"WITH {_KEYED} SELECT slug || '|' || storefront || '|' || snap_date AS site, len(hs) > 0 AS ok, CASE WHEN len(hs) = 0 THEN 'no product urls' END AS error, CASE WHEN len(hs) > 0 THEN array_to_string(list_slice(hs, 1, 8000), '|') END AS handles FROM k")
def _(s, d):
    """Handles that the made-up sites' sitemaps list: what was put in must come out."""
    return catalogue.collect(*site_files(s, d)).select(F.col("slug").alias("site"), "ok", "error", F.array_join("handles", "|").alias("handles"))


@query("c16_build", f"""WITH {_KEYED}, b AS (SELECT *, lag(hs) OVER (PARTITION BY slug, storefront ORDER BY snap_date) AS base FROM k WHERE len(hs) > 0)
SELECT slug || '|' || storefront AS shop, CAST(snap_date AS VARCHAR) AS snap_date, base IS NULL AS first_seen, len(hs) AS product_count, CASE WHEN base IS NULL THEN 0 ELSE len(list_filter(hs, lambda x: NOT list_contains(base, x))) END AS new_count, CASE WHEN base IS NULL THEN 0 ELSE len(list_filter(base, lambda x: NOT list_contains(hs, x))) END AS removed_count FROM b""")
def _(s, d):
    """Collection fed into runs: each site is one storefront on one date."""
    got = catalogue.collect(*site_files(s, d))
    part = F.split("slug", r"\|")
    fed = got.filter("ok").select(F.concat_ws("|", part[0], part[1]).alias("shop"), part[2].alias("snap_date"), "ok", "handles")
    return catalogue.runs(fed, ["shop"], "snap_date").select("shop", "snap_date", "first_seen", "product_count", "new_count", "removed_count")


@query("c08_sitemap_parts", "SELECT 1 AS n, 'https://x.example/a?b=1&c=2|https://x.example/d' AS locs, 'https://x.example/d' AS images, true AS is_index, true AS is_sitemap, 'https://x.example/m.xml|https://x.example/n.xml' AS roots, true AS products, true AS product_url, false AS other_url")
def _(s, d):
    """The parsing steps of a sitemap walk on one literal page."""
    xml = F.lit("<SITEMAPINDEX><urlset><url><loc>\n https://x.example/a?b=1&amp;c=2 </loc></url><URL><LOC>https://x.example/d</LOC><image:image/></URL>")
    robots = F.lit("Allow: /\nSitemap: https://x.example/m.xml\n  sitemap:https://x.example/n.xml\nSitemap: https://x.example/m.xml")
    bar = lambda c: F.array_join(c, "|")
    return s.range(1).select(
        F.lit(1).alias("n"), bar(catalogue.locs(xml)).alias("locs"), bar(catalogue.urls_with_images(xml)).alias("images"), catalogue.is_index(xml).alias("is_index"), catalogue.is_sitemap(xml).alias("is_sitemap"), bar(catalogue.sitemaps_of_robots(robots)).alias("roots"),
        catalogue.is_product_sitemap(F.lit("https://x.example/sitemap_Products_1.xml")).alias("products"), catalogue.is_product_url(F.lit("https://x.example/en/products/tote?x=1")).alias("product_url"), catalogue.is_product_url(F.lit("https://x.example/pages/products.html")).alias("other_url"),
    )


@query("s14_views", "SELECT (SELECT count(*) FROM captures) AS n_captures, (SELECT count(*) FROM aio) AS n_answers, 0 AS n_missing")
def _(s, d):
    """Tables as views; one that isn't there is an empty view."""
    register_views(s, d, {"captures": "capture_id long", "aio": "answer_id long", "no_such_table": "x long"})
    return s.sql("SELECT (SELECT count(*) FROM captures) AS n_captures, (SELECT count(*) FROM aio) AS n_answers, CAST((SELECT count(*) FROM no_such_table) AS INT) AS n_missing")


def _events(s, d):
    """The events as a file stream."""
    return streams.read_events(s, f"{d.rstrip('/')}/events.parquet*", f"{d.rstrip('/')}/events.parquet")


def _times(df: DataFrame) -> DataFrame:
    return df.withColumns({f.name: F.date_format(f.name, "yyyy-MM-dd HH:mm:ss.SSSSSS") for f in df.schema.fields if f.dataType.typeName().startswith("timestamp")})


_AT = lambda c: f"strftime({c}, '%Y-%m-%d %H:%M:%S.%f')"


@query("st_windows", f"SELECT {_AT('time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP ' + chr(39) + '1970-01-01' + chr(39) + ')')} AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def _(s, d):
    """Tumbling windows of seven days over the stream."""
    return _times(streams.drain(streams.windowed(_events(s, d), "ts", "event_type", "value", "7 days"), "complete")).withColumn("total", F.round("total", 4))


@query("st_sliding", f"WITH w AS (SELECT event_type, value, time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') - to_days(CAST(k AS INTEGER)) AS start FROM events, range(3) r(k)) SELECT {_AT('start')} AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM w GROUP BY ALL")
def _(s, d):
    """Windows of three days, one a day."""
    return _times(streams.drain(streams.windowed(_events(s, d), "ts", "event_type", "value", "3 days", "1 day"), "complete")).withColumn("total", F.round("total", 4))


@query("st_sessions", f"""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), k AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT {_AT('min(ts)')} AS start, {_AT('max(ts) + INTERVAL 6 HOUR')} AS "end", user_id, count(*) AS n FROM k GROUP BY user_id, k""")
def _(s, d):
    """Sessions of a user, ended by six quiet hours."""
    return _times(streams.drain(streams.sessions(_events(s, d), "ts", "user_id", "6 hours"), "complete"))


@query("st_distinct", "SELECT event_type, count(*) AS n FROM (SELECT DISTINCT ON (event_id) event_id, event_type FROM events) GROUP BY 1")
def _(s, d):
    """Events of the stream and of its repetition, each kept once within the watermark."""
    twice = _events(s, d).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    return streams.drain(streams.deduplicated(twice, "ts", ["event_id"])).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("st_transitions", """WITH t AS (SELECT user_id, event_type AS after, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) SELECT before, after, count(*) AS n FROM t WHERE before <> after GROUP BY 1, 2""")
def _(s, d):
    """How often a user's kind of event changes into which: custom state per user."""
    return streams.drain(streams.transitions(_events(s, d), "user_id", "ts", "event_type")).groupBy("before", "after").agg(F.count(F.lit(1)).alias("n"))


QUERIES = Q
