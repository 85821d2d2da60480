import math
import random
from collections import Counter

from pyspark.sql import functions as F

from vitrine.llm import canonical as c

BRANDS = [("alder-house", "Alder House", ["Alder"]), ("brivona-and-cole", "Brivona & Cole", None), ("zelcanto", "Zélcanto", []), ("marquelle-goods", "Marquelle Goods", ["Tavorin"]), ("dorvesta-row", "Dorvesta Row", None)]
SCHEMA = "slug string, brand string, aliases array<string>"


def index(spark, entries=BRANDS):
    return c.NgramIndex(c.reference_names(spark.createDataFrame(entries, SCHEMA), "slug", "brand", "aliases"))


def mapped(spark, names, entries=BRANDS):
    df = spark.createDataFrame(list(enumerate(names)), "id int, name string").withColumn("key", F.lit("clash")).withColumn("typed", F.lit(1))
    got = {r["item"]: r["key"] for r in c.map_names(df, "id", "name", index(spark, entries)).collect()}
    return [got.get(i) for i in range(len(names))]


def mentioned(spark, texts, entries=BRANDS):
    df = spark.createDataFrame(list(texts.items()), "id int, t string").withColumn("w", F.lit(1)).withColumn("form", F.lit("clash"))
    return {tuple(r) for r in c.find_mentions(df, "id", "t", index(spark, entries)).collect()}


def test_spellings(spark):
    cases = {
        "ALDER  HOUSE": "alder-house", "The Alder House Ltd": "alder-house", "alderhouse": "alder-house", "www.alderhouse.example": "alder-house", "Zelcanto (online)": "zelcanto", "zélcanto, accessories": "zelcanto",
        "Brivona and Cole": "brivona-and-cole", "Brivona + Cole - bags": "brivona-and-cole", "brivona": "brivona-and-cole", "Brivona-Cole": "brivona-and-cole", "tavorin": "marquelle-goods", "Marquelel Goods": "marquelle-goods",
        "Mraquelle Gods": "marquelle-goods", "Dorvesta Rwo": "dorvesta-row", "zelcamto": "zelcanto", "department store": "unmatched", "House": "unmatched", "Marvane Goods": "unmatched", "?": "unmatched", " ": None, None: None,
    }
    assert mapped(spark, list(cases)) == list(cases.values())


def test_repeats_long_and_empty(spark):
    assert mapped(spark, ["Alder", "Alder", "x" * 100_000]) == ["alder-house", "alder-house", "unmatched"]
    none = spark.createDataFrame([], "id int, name string")
    assert c.map_names(none, "id", "name", index(spark)).count() == 0 and c.find_mentions(none, "id", "name", index(spark)).count() == 0
    one = spark.createDataFrame([(1, "Alder")], "id int, name string")
    nothing = c.NgramIndex(c.reference_names(spark.createDataFrame(BRANDS, SCHEMA).limit(0), "slug", "brand", "aliases"))
    assert [tuple(r) for r in c.map_names(one, "id", "name", nothing).collect()] == [(1, "unmatched")] and c.find_mentions(one, "id", "name", nothing).count() == 0
    assert mentioned(spark, {1: "word " * 50_000 + "then Alder House at the end"}) == {(1, "alder-house")}


def test_shared_names_stay_unmatched(spark):
    assert mapped(spark, ["Vellmont", "Vellmont South"], [("a", "Vellmont North", ["Vellmont"]), ("b", "Vellmont South", ["Vellmont"])]) == ["unmatched", "b"]


def test_mentions(spark):
    texts = {
        1: "Some prefer AlderHouse's tote. Both The Zélcanto and brivona & cole offer more.", 2: "1. **Marquelle-Goods** - fine\n2) Dorvseta Row: good", 3: "Nothing here but a house and goods in a row.", 4: None, 5: "", 6: "Harwell & Cole is another name",
    }
    assert mentioned(spark, texts) == {(1, "alder-house"), (1, "zelcanto"), (1, "brivona-and-cole"), (2, "marquelle-goods"), (2, "dorvesta-row")}


LONG = [("mqv", "Marlow Quentin Vastor", None), ("mto", "Marlow Tessil Orbane", None), ("five", "Perrin Oswald Tamsin Ulric Vane", None), ("hm", "Harbour Mill", None), ("hmt", "Harbour Mill Tannery", None)]


def test_names_of_several_words(spark):
    cases = {
        "Marlow Quentin Vastor": "mqv", "Marlow Quentin Vastor Leather Goods": "mqv", "Vastor, Marlow Quentin": "mqv", "Marlow Quentn Vastr Co": "mqv", "Quentin Vastor": "mqv", "Marlow": "unmatched", "Marlow Goods": "unmatched",
        "Tessil Orbane": "mto", "Perrin Oswald Tamsin Ulric Vane": "five", "Perin Oswald Tamsin Urlic Vane": "five", "Oswald Perrin Ulric Tamsin Vane": "five", "perrinoswaldtamsinulricvane": "five", "Harbour Mill": "hm", "Harbour Mill Tannery": "hmt", "Mill": "unmatched",
    }
    assert mapped(spark, list(cases), LONG) == list(cases.values())
    texts = {
        1: "We like Marlow Quentin Vastor best.", 2: "Or Marlow Tessil Orbane, and Marlow Quentin Vastr.", 3: "Perrin Oswald Tamsin Ulric Vane sells belts", 4: "The Harbour Mill Tannery is new", 5: "Harbour Mill is old", 6: "A marlow by the harbour; a mill, an oswald",
    }
    assert mentioned(spark, texts, LONG) == {(1, "mqv"), (2, "mto"), (2, "mqv"), (3, "five"), (4, "hmt"), (5, "hm")}


def test_parts_of_a_list_give_the_same(spark, monkeypatch):
    names = ["alderhouse", "Zelcamto", "Marquelel Goods", "Dorvesta", "nothing like it"]
    whole = mapped(spark, names)
    monkeypatch.setattr(c, "MAX_NAMES", 3)
    assert mapped(spark, names) == whole


def test_scores_are_the_weighted_cosine(spark):
    """Against every pair, worked out with plain dictionaries."""
    i = index(spark)
    names = [r["name"] for r in i.names.collect()]
    df = Counter(g for n in names for g in c.word_grams(n))
    weight = {g: math.log(1 + len(names) / k) for g, k in df.items()}
    unknown = sum(weight.values()) / len(weight)
    vector = lambda x: {g: k * weight.get(g, unknown) for g, k in c.word_grams(x).items()}
    length = lambda v: math.sqrt(sum(x * x for x in v.values()))
    values = ["alder hous", "zelcanta", "goods of marquelle", "dorvesta", "qqq"]
    want = {}
    for v in values:
        for n in names:
            a, b = vector(v), vector(n)
            s = sum(x * b.get(g, 0) for g, x in a.items()) / (length(a) * length(b))
            if s >= c.THRESHOLD:
                want[v, n] = round(s, 4)
    got = {(r["v"], r["name"]): round(r["score"], 4) for r in i.scored(spark.createDataFrame([(v,) for v in values], "v string"), "v").collect()}
    assert got == want and len(want) > 4


def test_edits_are_counted_with_swaps(spark):
    def osa(x, y):
        d = [[max(i, j) if 0 in (i, j) else 0 for j in range(len(y) + 1)] for i in range(len(x) + 1)]
        for i in range(1, len(x) + 1):
            for j in range(1, len(y) + 1):
                d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (x[i - 1] != y[j - 1]))
                if i > 1 and j > 1 and x[i - 1] == y[j - 2] and x[i - 2] == y[j - 1]:
                    d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
        return d[-1][-1]

    rng = random.Random(8)
    pairs = [(w := "".join(rng.choice("abcde") for _ in range(rng.randrange(5, 10))), typo(rng, typo(rng, typo(rng, w)))) for _ in range(600)]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = [(r["a"], r["b"], r["n"]) for r in df.select("a", "b", c.edits(F.col("a"), F.col("b"), c._letters(F.col("a")), c._letters(F.col("b"))).alias("n")).collect()]
    assert [(a, b, n) for a, b, n in got if n != (k if (k := osa(a, b)) <= 2 else None)] == []


def typo(rng, s):
    i = rng.randrange(1, len(s) - 1)
    return rng.choice([s[:i] + s[i + 1 :], s[:i] + s[i + 1] + s[i] + s[i + 2 :], s[:i] + rng.choice("abcdefgh") + s[i + 1 :], s[:i] + s[i] + s[i:]])


def made_up(rng, n):
    """Entries of one to five made-up words; syllables recur, so names lie close together."""
    part = lambda: "".join(rng.choice(["bra", "kel", "mor", "vin", "tal", "osk", "rue", "dax", "fen", "hol", "sim", "wyn"]) for _ in range(rng.choice([2, 3, 3])))
    seen, out = set(), []
    while len(out) < n:
        words = [part().title() for _ in range(1 + len(out) % 5)]
        if words[0] not in seen:
            seen.update(words)
            out.append((f"e{len(out)}", " ".join(words), None))
    return out


def test_held_out_kinds(spark):
    """Generated spellings of entries of up to five words: recall of 0.95 for each kind, and hardly ever another entry."""
    rng = random.Random(11)
    entries = made_up(rng, 60)
    kinds = {"typo": [], "two words typed wrong": [], "added word": [], "swapped words": [], "dropped word": [], "run together": []}
    for slug, name, _ in entries:
        w = name.split()
        kinds["typo"].append((typo(rng, name), slug))
        kinds["added word"].append((name + " " + rng.choice(["Leather", "Online", "Paris"]), slug))
        kinds["run together"].append((name.replace(" ", "").upper(), slug))
        if len(w) > 1:
            kinds["two words typed wrong"].append((" ".join([typo(rng, w[0]), typo(rng, w[1]), *w[2:]]), slug))
            kinds["swapped words"].append((" ".join(w[1:] + w[:1]), slug))
        if len(w) > 3:
            kinds["dropped word"].append((" ".join(w[:2] + w[3:]), slug))
    cases = [(k, t, s) for k, v in kinds.items() for t, s in v]
    got = mapped(spark, [t for _, t, _ in cases], entries)
    right, wrong = Counter(k for (k, _, s), g in zip(cases, got) if g == s), [(t, s, g) for (_, t, s), g in zip(cases, got) if g not in (s, "unmatched")]
    assert {k: right[k] / len(v) for k, v in kinds.items() if right[k] < 0.95 * len(v)} == {}
    assert wrong == []


def test_held_out_typos(spark):
    rng = random.Random(4)

    cases = [(typo(rng, b), slug) for slug, b, _ in BRANDS for _ in range(60)]
    got = mapped(spark, [t for t, _ in cases])
    assert sum(a == b for a, (_, b) in zip(got, cases)) >= 0.97 * len(cases) and not [1 for a, (_, b) in zip(got, cases) if a not in (b, "unmatched")]
