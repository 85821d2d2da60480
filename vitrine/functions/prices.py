"""Price scan with exclusions by neighbouring words.

Shown prices split a text into labels, so they are read by built-ins. Prices in markup need
the place of every match: one sweep over titles and prices, in Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitrine.functions.page import once

#: Add-on items whose prices aren't the range's. Fixed values.
ADD_ONS = ("photo card", "photocard", "gift wrap", "gift-wrap", "gift wrapping", "e-gift", "egift", "gift card", "giftcard", "gift note", "gift tag", "greeting card", "donation")
#: How near a price's title must be in markup and its label in text, in characters; prices in markup that make shown ones needless. Fixed values.
TITLE_REACH, LABEL_REACH, ENOUGH_STRUCTURED = 300, 80, 4
#: What a price and a title look like in markup, and a shown price. Fixed values.
MARKUP = re.compile(r'"price"\s*:\s*"?(?P<price>\d{1,5}(?:\.\d{1,2})?)"?|"(?:title|name)"\s*:\s*"(?P<title>[^"]{1,120})"')
SHOWN = r"£(?U:\s)?([0-9]{1,4}(?:\.[0-9]{2})?)"


def titled_prices(markup: str) -> list[tuple[float, str]]:
    """(price, title) in order: the last title at most TITLE_REACH before a price, else the next one within that reach, else ''."""
    prices: list[list] = []
    waiting: list[tuple[int, int]] = []  # (where it stands, its place in prices)
    seen, seen_at = "", -1
    for m in MARKUP.finditer(markup):
        if m["title"] is not None:
            for where, i in waiting:
                if m.end() - where <= TITLE_REACH:
                    prices[i][1] = m["title"]
            waiting, seen, seen_at = [], m["title"], m.start()
            continue
        near = seen_at >= 0 and m.start() - seen_at <= TITLE_REACH
        if not near:
            waiting.append((m.start(), len(prices)))
        prices.append([round(float(m["price"]), 2), seen if near else ""])
    return [(p, t) for p, t in prices]


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("price", T.DoubleType()), T.StructField("label", T.StringType())])))
def _titled(markup: pd.Series) -> pd.Series:
    return pd.Series([[{"price": p, "label": t.lower()} for p, t in titled_prices(h or "")] for h in markup], dtype=object)


def labelled_prices(text: Column) -> Column:
    """array of struct(price, label) of shown prices; a label reaches back to the price before or to the line's start."""
    body = F.coalesce(text, F.lit(""))
    found = F.transform(F.regexp_extract_all(body, F.lit(SHOWN), 1), lambda p: F.round(p.cast("double"), 2))
    label = lambda piece: F.lower(F.regexp_replace(F.right(piece, F.lit(LABEL_REACH)), r"(?s)^.*[\n\r]", ""))
    # the text between two prices is what stands before the second
    labels = lambda z: F.transform(F.slice(z["pieces"], F.lit(1), F.size(z["found"])), label)
    zipped = lambda z: F.transform(F.arrays_zip(z["found"].alias("price"), labels(z).alias("label")), lambda x: F.struct(x["price"].alias("price"), x["label"].alias("label")))
    return once(F.struct(found.alias("found"), F.split(body, SHOWN).alias("pieces")), zipped)


def kept(prices: Column, words: Sequence[str] | Column, values: Column) -> Column:
    """Prices whose label names no add-on and that aren't excluded by value."""
    all_words = F.concat(F.array(*[F.lit(w) for w in ADD_ONS]), F.transform(F.coalesce(words, F.array().cast("array<string>")), F.lower))
    barred = F.transform(F.coalesce(values, F.array().cast("array<double>")), lambda v: F.round(v, 2))
    return F.transform(F.filter(prices, lambda p: ~F.array_contains(barred, p["price"]) & ~F.exists(all_words, lambda w: p["label"].contains(w))), lambda p: p["price"])


def scan(html: Column, text: Column, words: Column | None = None, values: Column | None = None) -> Column:
    """struct(structured, visible) of a page's prices; words and values: a brand's own exclusions."""
    w = F.lit(None).cast("array<string>") if words is None else words
    v = F.lit(None).cast("array<double>") if values is None else values
    return F.struct(kept(_titled(html), w, v).alias("structured"), kept(labelled_prices(text), w, v).alias("visible"))


def home_prices(scanned: Column) -> Column:
    """Prices of a homepage: those in markup, with the shown ones where markup has fewer than four."""
    return once(scanned, lambda z: F.when(F.size(z["structured"]) >= ENOUGH_STRUCTURED, z["structured"]).otherwise(F.concat(z["structured"], z["visible"])))
