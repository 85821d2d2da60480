import random

import numpy as np
import pytest

from vitrine.llm import encoding as e

CLEAN = [
    "Our café serves crème brûlée – naïve, déjà vu.", "Größe und Gewicht stehen auf dem Etikett, schöne Grüße.", "El pañuelo pequeño está aquí; ¿qué más?", "A alça é ajustável e o botão não risca.", "It’s “fine”, we’ve said — £20 or €15, ★★★★½ and ¾ kg at 20 °C.", "Ω‑shaped clasp, 13″ laptop, 30 × 40 cm.", "Plain words only here, nothing else at all.",
]


@pytest.fixture(scope="module")
def found(spark):
    rng = random.Random(7)
    clean = [" ".join(rng.sample(CLEAN, 3)) for _ in range(400)]
    chains = [("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "mac_roman"), ("utf-8", "cp1250"), ("utf-8", "cp437"), ("utf-8", "cp1251"), ("cp1252", "mac_roman")]
    rows, truth = [], {}
    for i, t in enumerate(clean):
        rows.append((i, t))
    for i in range(84):
        t = rng.choice(clean)
        chain = chains[i % len(chains)]
        if chain[0] != "utf-8" and any(ord(c) > 0x2000 and c not in "–—’“”€" for c in t):
            t = CLEAN[0]
        bad = e.misread(t, *chain)
        if i % 9 == 0 and chain[1] != "mac_roman":
            bad = e.misread(bad, "utf-8", "cp1252")
        if bad != t:
            truth[1000 + i] = t
            rows.append((1000 + i, bad))
    rows += [(2000, "caf� au lait"), (2001, None), (2002, ""), (2003, "plain"), (2004, "word " * 60_000 + "cafÃ©"), (2005, "Bjørkå and Zélcanto opened in Łódź")]
    df = spark.createDataFrame(rows, "id long, body string")
    return truth, {r["id"]: r for r in e.restored_texts(df, "id", "body").collect()}


def test_finds_and_restores(found):
    truth, got = found
    assert set(truth) - set(got) == set()
    assert sum(got[i]["body"] == t for i, t in truth.items()) >= 0.95 * len(truth)


def test_leaves_clean_records(found):
    truth, got = found
    assert not [i for i in got if i < 1000] and 2000 in got and 2004 in got and got[2004]["body"].endswith("café")
    assert not {2001, 2002, 2003, 2005} & set(got)


def test_round_trips():
    for t in (x for x in CLEAN if not x.isascii()):
        assert t in e.readings(e.misread(t, "utf-8", "cp1252")) and t in e.readings(e.misread(e.misread(t, "utf-8", "latin-1"), "utf-8", "cp1252"))


def test_empty(spark):
    assert e.garbled_tokens(spark.createDataFrame([], "id long, body string"), "id", "body").count() == 0


@pytest.mark.parametrize("rare", [1, 2, 4, 40])
def test_margin_counts_every_clean_word(spark, rare):
    """Rare words beyond the 2,000 most frequent ones decide here; the margin is the exact quantile of all."""
    gains = [0.5 + i / 4000 for i in range(3000)] + [5.0 + i / 100 for i in range(rare)]
    scored = spark.createDataFrame([(f"é{i}x".translate(str.maketrans("0123456789", "abcdefghij")), None, g) for i, g in enumerate(gains)] + [("�", None, 30.0), ("garblé", None, 30.0)], "token string, reading string, gain double")
    words = scored.filter("gain < 30").selectExpr("token", "1 AS n")
    wanted = float(np.clip(np.quantile(gains, 1 - e.FALSE_SHARE) + 0.5, e.MARGIN, e.MOST_MARGIN))
    assert e.validated_margin(scored, words) == pytest.approx(wanted) and (rare < 4 or wanted > 5)
