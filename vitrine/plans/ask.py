"""Deterministic question answering: a question is parsed on the driver, over the small roster, into a plan with literal predicates; answers are DataFrames with their evidence.

Every answer has the columns topic, brand, value, on_date, source.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.operators import history

#: Words of a question that name no brand. Fixed values.
FILLER = frozenset("the a an is are was were on in at of for to and or who what when which did does do has have had how much any sale offer offers discount price prices now today week month they their with deepest biggest since last this".split())
ANSWER = "topic string, brand string, value string, on_date date, source string"
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
#: The wording of each intent, and where a question names its subject. Fixed values.
INTENTS = {
    "answers": r"\bai (?:visibility|answers?|assistants?)|share of voice\b",
    "deepest": r"\b(?:deepest|biggest|largest|highest|best)\b.*\b(?:discount|reduction|sale)\b|\bdiscounting (?:the )?most\b",
    "who": r"\bwho(?:'s| is| are| was| were| has| had)?\b|\bwhich brands?\b",
    "on_sale": r"\bon sale\b|\brunning (?:a |an )?(?:sale|offer|promotion)\b|\bdiscounting\b|\boffer\b",
    "when": r"\bwhen did\b|\bwhen was\b|\btimeline\b|\bhow long\b|\bsince when\b",
    "hero": r"\bhero\b|\bheadline\b|\bbanner\b|\bhomepage message\b",
    "price": r"\bprices?\b|\bpricing\b|\bcost\b|\bhow much\b|\bmedian\b|\bexpensive\b|\bcheap",
    "change": r"\bchange(?:d)?\b|\brewrote\b|\bupdate(?:d)?\b",
    "sale": r"\bsale\b|\boffer\b|\bdiscount\b",
}
SUBJECT = r"(?:was|is|are|were|did|does|has|about)\s+([a-z][a-z&' .-]{2,30}?)(?:'s)?\s+(?:on sale|running|discount|sale|offer|hero|price|prices|doing)"
#: Edits allowed for a word, by its length: up to four letters, up to seven, longer. Fixed values.
EDITS = ((4, 1), (7, 2), (99, 3))


def norm(text: str) -> str:
    return re.sub(r"\s+", " ", (text or "").lower().replace("’", "'")).strip()


def edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


@dataclass(frozen=True)
class Brand:
    slug: str
    name: str
    spellings: tuple[str, ...]


def roster(brands: DataFrame, most: int = 100_000) -> list[Brand]:
    """The brand dimension on the driver; its size is checked."""
    rows = brands.select("slug", "brand").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"the roster has more than {most} brands")
    out = []
    for slug, name in sorted(map(tuple, rows)):
        n = norm(name)
        forms = {n, n.replace("&", "and"), n.replace(" and ", " & "), re.sub(r"^the ", "", n), re.sub(r"[^a-z0-9]", "", n)}
        out.append(Brand(slug, name, tuple(sorted(f for f in forms if f))))
    return out


def match_brand(question: str, brands: Sequence[Brand]) -> tuple[Brand | None, bool]:
    """(brand, exact): the longest spelling that the question holds, else the nearest by words, each word of it found within the allowed edits."""
    q = norm(question)
    held = [(len(s), b.slug, b) for b in brands for s in b.spellings if re.search(rf"(?<!\w){re.escape(s)}(?!\w)", q)]
    if held:
        return max(held, key=lambda x: (x[0], x[1]))[2], True
    words = [w for w in re.findall(r"[\w']+", q) if w not in FILLER]
    best: tuple[int, str, Brand] | None = None
    for b in brands:
        needed = [w for w in re.findall(r"[\w']+", norm(b.name)) if len(w) >= 3 and w not in FILLER]
        if not needed or not words:
            continue
        cost = [min(edits(n, w) for w in words) for n in needed]
        if all(c <= next(e for most, e in EDITS if len(n) <= most) for c, n in zip(cost, needed)) and (best is None or (sum(cost), b.slug) < best[:2]):
            best = (sum(cost), b.slug, b)
    return (best[2] if best else None), False


def closest_brand(name: str, brands: Sequence[Brand]) -> Brand | None:
    n = norm(name)
    d, _, b = min(((min(edits(n, s) for s in x.spellings), x.slug, x) for x in brands), default=(99, "", None), key=lambda t: t[:2])
    return b if d <= max(3, len(n) / 2) else None


def date_range(question: str, newest: dt.date) -> tuple[dt.date, dt.date] | None:
    """The span a question asks about, anchored on the newest capture; None where it names none."""
    q, day = norm(question), dt.timedelta(1)
    iso = [dt.date.fromisoformat(x) for x in re.findall(r"\b\d{4}-\d\d-\d\d\b", q)]
    if iso:
        return min(iso[:2]), max(iso[:2])
    if "yesterday" in q:
        return newest - day, newest - day
    if "today" in q:
        return newest, newest
    monday = newest - newest.weekday() * day
    if "last week" in q:
        return monday - 7 * day, monday - day
    if "this week" in q:
        return monday, newest
    m = re.search(rf"\b(?:(early|mid|late)[- ])?({'|'.join(MONTHS)})\b", q)
    if not m or (m[2] == "may" and not re.search(r"\b(?:in|early|mid|late|during|since)[- ]may\b", q)):
        return None
    month = MONTHS.index(m[2]) + 1
    year = newest.year - (month > newest.month)
    end = (dt.date(year + month // 12, month % 12 + 1, 1) - day).day
    lo, hi = {"early": (1, 10), "mid": (11, 20), "late": (end - 9, end), None: (1, end)}[m[1]]
    return dt.date(year, month, lo), dt.date(year, month, hi)


def _answer(df: DataFrame, topic: str, value: Column, source: str, date: str, brand: str = "brand") -> DataFrame:
    return df.select(F.lit(topic).alias("topic"), F.col(brand).alias("brand"), value.cast("string").alias("value"), F.col(date).alias("on_date"), F.lit(source).alias("source"))


class Ask:
    """Questions over one capture history. captures: brand, slug, capture_date and the captured fields; voice: slug, sov of the newest answer run."""

    def __init__(self, captures: DataFrame, brands: DataFrame, voice: DataFrame | None = None, date: str = "capture_date", tie: Sequence[str] = ("captured_at", "capture_id")):
        self.ok = history.successful(captures)
        self.date, self.order, self.voice = date, [date, *tie], voice
        self.brands = roster(brands)
        self.spark: SparkSession = captures.sparkSession

    def _between(self, span) -> DataFrame:
        return self.ok if span is None else self.ok.filter(F.col(self.date).between(F.lit(span[0]), F.lit(span[1])))

    def _as_of(self, span) -> DataFrame:
        """Each brand's newest record in the span: up to its end, and not older than its start."""
        return history.latest(self._between(span), ["slug"], self.order)

    def offer_status(self, slug: str, span=None) -> DataFrame:
        """Whether a brand was on offer: the newest record, or over a span how many of its records, with the offers seen."""
        rows = self._between(span).filter(F.col("slug") == slug)
        if span is None:
            return _answer(history.latest(rows, ["slug"], self.order), "offer", F.coalesce("headline_offer", F.lit("no offer")), "headline_offer", self.date)
        on = F.coalesce(F.col("headline_offer"), F.lit("")) != ""
        when = F.when(on, F.col(self.date))
        per = rows.groupBy("slug").agg(F.max("brand").alias("brand"), F.count(F.lit(1)).alias("n"), F.count_if(on).alias("k"), F.array_sort(F.collect_set(F.when(on, F.col("headline_offer")))).alias("offers"), F.min(when).alias("first"), F.max(when).alias("last"), F.max(self.date).alias(self.date))  # a brand's distinct offers in a span
        evidence = F.concat_ws("; ", F.concat_ws(" of ", F.col("k").cast("string"), F.col("n").cast("string")), F.array_join("offers", " | "), F.concat_ws(" to ", F.col("first").cast("string"), F.col("last").cast("string")))
        return _answer(per, "offer", evidence, "headline_offer", self.date)

    def sale_timeline(self, slug: str, last: int = 6) -> DataFrame:
        moves = history.sale_transitions(history.latest(self.ok.filter(F.col("slug") == slug), ["slug", self.date], self.order), ["brand"], self.date)
        return _answer(moves, "sale_timeline", F.concat_ws(": ", "transition", "headline"), "headline_offer", self.date).orderBy(F.desc("on_date")).limit(last)

    def hero_change(self, slug: str) -> DataFrame:
        rows = history.latest(self.ok.filter(F.col("slug") == slug), ["slug", self.date], self.order)
        events = history.timeline(rows, ["brand"], self.date).filter("event = 'hero_changed'")
        return _answer(events, "hero_change", F.col("detail"), "hero_message", self.date).orderBy(F.desc("on_date")).limit(1)

    def hero(self, slug: str, span=None) -> DataFrame:
        return _answer(self._as_of(span).filter(F.col("slug") == slug), "hero", F.col("hero_message"), "hero_message", self.date)

    def price(self, slug: str, span=None) -> DataFrame:
        rows = self._between(span).filter((F.col("slug") == slug) & history.best_median().isNotNull())
        return _answer(history.latest(rows, ["slug"], self.order), "price", history.best_median(), "prices", self.date)

    def who_on_sale(self, span=None) -> DataFrame:
        on = self._as_of(span).filter(F.coalesce(F.col("headline_offer"), F.lit("")) != "")
        return _answer(on, "on_sale", F.concat_ws(" | ", "headline_offer", F.coalesce("max_discount_pct", F.lit(0)).cast("string")), "headline_offer", self.date)

    def deepest(self, span=None) -> DataFrame:
        rows = self._as_of(span).filter(F.col("max_discount_pct") > 0).orderBy(F.desc("max_discount_pct"), "slug").limit(1)
        return _answer(rows, "deepest", F.col("max_discount_pct"), "max_discount_pct", self.date)

    def snapshot(self, slug: str) -> DataFrame:
        text = F.concat_ws("; ", "headline_offer", "hero_message", history.best_median().cast("string"))
        return _answer(self._as_of(None).filter(F.col("slug") == slug), "snapshot", text, "capture", self.date)

    def share_of_voice(self, slug: str | None = None, top: int = 5) -> DataFrame:
        if self.voice is None:
            return self.spark.createDataFrame([], ANSWER)
        ranked = self.voice.orderBy(F.desc("sov"), "slug").limit(top) if slug is None else self.voice.filter(F.col("slug") == slug)
        return ranked.select(F.lit("share_of_voice").alias("topic"), F.col("slug").alias("brand"), F.col("sov").cast("string").alias("value"), F.lit(None).cast("date").alias("on_date"), F.lit("answers").alias("source"))

    def ask(self, question: str) -> DataFrame:
        """The first intent that the question's wording fits."""
        q = norm(question)
        newest = self.ok.agg(F.max(self.date)).first()[0]
        if newest is None or not q:
            return self.spark.createDataFrame([], ANSWER)
        span = date_range(question, newest)
        brand, _ = match_brand(question, self.brands)
        says = {k: bool(re.search(p, q)) for k, p in INTENTS.items()}
        if says["answers"]:
            return self.share_of_voice(brand.slug if brand else None)
        if says["deepest"]:
            return self.deepest(span)
        if brand is None:
            unknown = None if says["who"] and says["on_sale"] else named_unknown(question)
            if unknown is None and says["on_sale"]:
                return self.who_on_sale(span)
            near = closest_brand(unknown, self.brands) if unknown else None
            note = f"unknown brand; nearest: {near.name}" if near else "unknown brand" if unknown else "unknown question"
            return self.spark.createDataFrame([("unknown", near.name if near else None, note, None, "roster")], ANSWER)
        if says["when"] and says["hero"]:
            return self.hero_change(brand.slug)
        if says["when"] and (says["sale"] or says["change"]):
            return self.sale_timeline(brand.slug)
        if says["hero"]:
            return self.hero(brand.slug, span)
        if says["price"]:
            return self.price(brand.slug, span)
        return self.offer_status(brand.slug, span) if says["on_sale"] else self.snapshot(brand.slug)


def named_unknown(question: str) -> str | None:
    """What a question names where a brand would stand, if it does."""
    m = re.search(SUBJECT, norm(question))
    return m[1].strip() if m else None
