"""Free-entered names mapped to the entries of a reference list.

Values are deduplicated and normalised to words; candidates come from an inverted index of
character n-grams over the list's names, and the weighted cosine of the n-gram vectors
scores them (a gram that many names share weighs little). Grams lie within words, so order,
missing and added words cost what those words weigh. The best entry is accepted above a
threshold and ahead of the next one by a margin. Names made of the same few syllables lie
close together under any n-gram cosine, so an exact check follows: letters within an edit
bound, or words that answer to each other within one.

Texts are searched in windows up to the longest name of the list. Their distinct words are
first held against the names' telling words, so that windows are built only around words
that can belong to a name, and a text is never copied for each of its words.

An entry's names are its brand, its aliases, and its leading word where no other entry
leads with it and it is long enough to tell.

Defined results: null and blank values are left out; a value that reaches no entry is
'unmatched'; values equal but for case, accents, blanks and marks share their result; ties
between entries count as no margin, so they stay unmatched; an empty list matches
nothing; texts of any length are read whole; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitrine.session import blank_free, checkpointed, fits_broadcast, lookup_join

#: Weighted cosine that a value needs, and its lead over the next entry that passes the check too.
THRESHOLD, LEAD = 0.3, 0.03
#: Letters of an n-gram.
GRAM = 2
#: Shortest form that is matched by likeness; from LONG_NAME letters on two edits are allowed, below one; within texts from LONG_WORD on.
SHORTEST, LONG_NAME, LONG_WORD = 5, 7, 8
#: Cosine from which on words that answer to each other are looked at.
WORDS_THRESHOLD = 0.45
#: Share of a name's weight whose words a value must hold, and share of its own weight that may lie in other words.
NAME_SHARE, ADDED_SHARE = 0.7, 0.45
#: A leading word stands for its entry from this length on.
LEAD_WORD = 5
#: Names of an index that a task holds in memory; a longer list is searched in parts of this size.
MAX_NAMES = 100_000
#: Names of a reference list at most: the index is made on the driver, which holds them all once. A longer list is refused.
MOST_NAMES = 2_000_000
#: Articles and legal forms, which belong to no name. Fixed values.
ADDED = ("the", "ltd", "limited", "plc", "inc", "llc", "gmbh")
#: What web addresses add to a name. Fixed values.
SITE = ("limited", "ltd", "online", "official", "shop", "store", "london", "uk", "hq")
#: Words and signs that join two names, dropped on both sides. Fixed values.
JOINERS = ("and", "et", "n", "y", "und", "e")

_PLAIN = ("àáâãäåāăąçćčďđèéêëēėęěğìíîïīįıľłñńňòóôõöøōőŕřśşšťţùúûüūůűųýÿźżž", "aaaaaaaaacccddeeeeeeeegiiiiiiillnnnoooooooorrsssttuuuuuuuuyyzzz")
_WORD = r"[\p{L}\p{M}\p{Nd}]+(?:['’`´][\p{L}\p{M}]+)*"


def plain(c: Column) -> Column:
    """Lower case without accents; 'ß' and ligatures spelt out, combining marks dropped."""
    low = F.lower(blank_free(c))
    low = F.regexp_replace(F.regexp_replace(F.regexp_replace(low, "ß", "ss"), "æ", "ae"), "œ", "oe")
    return F.regexp_replace(F.translate(low, *_PLAIN), r"\p{M}+", "")


def _unquoted(c: Column) -> Column:
    return F.regexp_replace(c, r"['’]s\b|['’`´]", "")


def words_of(c: Column, drop: Sequence[str]) -> Column:
    """The words of a plain text, possessive endings off, without the dropped ones."""
    return F.filter(F.split(_unquoted(c), r"[^\p{L}\p{Nd}]+"), lambda w: (w != "") & ~w.isin(*drop))


def squashed(c: Column) -> Column:
    return F.translate(c, " ", "")


def _spaced(words: Column) -> Column:
    return F.array_join(words, " ")


def typed_forms(c: Column) -> Column:
    """The normal forms of a typed name, each its words: all of it, and all but its remarks (brackets, what follows a comma, slash or spaced dash). A web address gives its host."""
    p = plain(c)
    web = p.rlike(r"^(?:https?://)?www\.|^https?://")
    host = F.regexp_replace(F.regexp_replace(F.regexp_extract(p, r"^(?:https?://)?(?:www\.)?([^/]+)", 1), r"\.[a-z]{2,8}(?:\.[a-z]{2})?$", ""), rf"^the(?=.{{6}})|(?<=.{{6}})(?:{'|'.join(SITE)})$", "")
    core = F.regexp_replace(F.regexp_replace(p, r"\([^)]*\)|\[[^\]]*\]", " "), r"(?<=\S)\s*(?:,|\s/|\s[–—-]\s|\s\|).*$", "")
    names = lambda x: _spaced(words_of(x, (*ADDED, *JOINERS)))
    # a name of nothing but dropped words keeps them
    both = F.when(web, F.array(_spaced(words_of(host, ())))).otherwise(F.array(names(core), names(p)))
    made = F.array_distinct(F.filter(both, lambda x: x != ""))
    return F.when(F.size(made) > 0, made).otherwise(F.array_compact(F.array(F.nullif(_spaced(words_of(p, JOINERS)), F.lit("")))))


def reference_names(entries: DataFrame, key: str, name: str, aliases: str | None) -> DataFrame:
    """(key, name, joined): every form that stands for an entry, as words; forms of two entries are left out. joined: of several words, or several run together."""
    typed = F.array(F.col(name)) if aliases is None else F.concat(F.array(F.col(name)), F.coalesce(F.col(aliases), F.array().cast("array<string>")))
    drop = (*ADDED, *JOINERS)
    each = entries.select(F.col(key).alias("key"), F.explode(F.array_compact(typed)).alias("typed")).withColumn("p", F.regexp_replace(plain(F.col("typed")), r"\band\b", " "))
    # joined names also with the joiner run in, as web addresses have them
    run_in = F.when(plain(F.col("typed")).rlike(r"[&+]|\band\b"), F.array(*[F.array_join(words_of(F.col("p"), ADDED), j) for j in ("and", "et", "n", "y")]))
    forms = F.concat(F.array(_spaced(words_of(F.col("p"), drop))), F.coalesce(run_in, F.array().cast("array<string>")))
    full = each.select("key", F.explode(forms).alias("name"), (F.size(words_of(F.col("p"), drop)) > 1).alias("joined"))
    lead = entries.select(F.col(key).alias("key"), F.try_element_at(words_of(plain(F.col(name)), drop), F.lit(1)).alias("name"), F.lit(False).alias("joined")).filter(F.length("name") >= LEAD_WORD)
    both = full.unionByName(lead).filter("name <> ''")
    return both.groupBy("name").agg(F.min("key").alias("key"), F.max("key").alias("other"), F.min("joined").alias("joined")).filter("key = other").select("key", "name", "joined")


def word_grams(form: str) -> Counter:
    """The n-grams of a form's words, each word marked at its ends."""
    found: Counter = Counter()
    for w in form.split(" "):
        s = f"^{w}$"
        for i in range(len(s) - GRAM + 1):
            found[s[i : i + GRAM]] += 1
    return found


class NgramIndex:
    """The inverted index of a list of names, held by every task in parts of at most MAX_NAMES names: gram -> names and weights."""

    def __init__(self, names: DataFrame):
        self.names = checkpointed(names)
        self.spark = names.sparkSession
        total = self.names.count()
        if total > MOST_NAMES:
            raise ValueError(f"the reference list has more than {MOST_NAMES} names")
        self.total, self.parts = total, []
        n_parts = max(1, -(-total // MAX_NAMES))
        held = self.names.select("key", "name", "joined", F.pmod(F.xxhash64("name"), F.lit(n_parts)).alias("part"))
        # how many names have a gram: over the whole list
        rows = [held.filter(F.col("part") == i).drop("part").sort("name").collect() for i in range(n_parts)] if total else []
        lists = [[r["name"] for r in part] for part in rows]
        df = Counter(g for part in lists for n in part for g in word_grams(n))
        weight = {g: math.log(1 + total / k) for g, k in df.items()}
        self.unknown = sum(weight.values()) / len(weight) if weight else 1.0
        words = Counter(w for part in lists for n in part for w in set(n.split(" ")))
        self.words = {w: math.log(1 + total / k) / math.log(1 + total) for w, k in words.items()}
        self._rows, self._described = rows, None
        self.longest = max((len(n.split(" ")) for part in lists for n in part), default=0)
        for part in lists:
            postings: dict[str, list] = {}
            norms = np.zeros(len(part), dtype="float32")
            for i, n in enumerate(part):
                for g, k in word_grams(n).items():
                    postings.setdefault(g, []).append((i, k * weight[g]))
                    norms[i] += (k * weight[g]) ** 2
            packed = {g: (np.array([i for i, _ in p], dtype="int32"), np.array([w for _, w in p], dtype="float32") * weight[g]) for g, p in postings.items()}
            self.parts.append(self.spark.sparkContext.broadcast((part, packed, np.sqrt(norms), weight, self.unknown)))

    def scored(self, values: DataFrame, value: str, threshold: float = THRESHOLD) -> DataFrame:
        """(value, name, score): the names whose cosine with a distinct value reaches the threshold."""
        found = [values.select(value).mapInPandas(_scorer(p, value, threshold), f"`{value}` string, name string, score double") for p in self.parts]
        if not found:
            return self.spark.createDataFrame([], f"`{value}` string, name string, score double")
        out = found[0]
        for more in found[1:]:
            out = out.unionByName(more)
        return out

    def described(self) -> DataFrame:
        """(key, name, joined, nwords): the names with their words, each with its letters in order and its weight in the list."""
        if self._described is None:
            typed = {"key": self.names.schema["key"].dataType.simpleString()}
            made = [(r["key"], r["name"], r["joined"], [(w, "".join(sorted(w)), self.words[w]) for w in r["name"].split(" ")]) for part in self._rows for r in part]
            self._described = checkpointed(self.spark.createDataFrame(made, f"key {typed['key']}, name string, joined boolean, nwords array<struct<w:string,s:string,m:double>>"))
        return self._described


def _scorer(shared, value: str, threshold: float):
    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, postings, norms, weight, unknown = shared.value
        for pdf in batches:
            out_v, out_n, out_s = [], [], []
            for form in pdf[value]:
                grams = word_grams(form)
                own = math.sqrt(sum((k * weight.get(g, unknown)) ** 2 for g, k in grams.items()))
                met = [(postings[g], k) for g, k in grams.items() if g in postings]
                if not met:
                    continue
                ids = np.concatenate([p[0] for p, _ in met])
                dots = np.concatenate([p[1] * k for p, k in met])
                if len(names) <= 8192:
                    sums = np.bincount(ids, dots, len(names))
                    hit = np.flatnonzero(sums >= threshold * own * norms)
                    cosine = sums[hit] / (own * norms[hit])
                else:
                    hit, at = np.unique(ids, return_inverse=True)
                    cosine = np.bincount(at, dots) / (own * norms[hit])
                    hit, cosine = hit[cosine >= threshold], cosine[cosine >= threshold]
                for i, s in zip(hit, cosine):
                    out_v.append(form), out_n.append(names[i]), out_s.append(float(s))
            yield pd.DataFrame({value: pd.Series(out_v, dtype=object), "name": pd.Series(out_n, dtype=object), "score": pd.Series(out_s, dtype="float64")})

    return score


def _letters(c: Column) -> Column:
    return F.array_join(F.array_sort(F.split(c, "")), "")


def edits(a: Column, b: Column, a_letters: Column, b_letters: Column) -> Column:
    """Edits between two forms, neighbours swapped counting as one; null beyond two.

    A swap is two of levenshtein's edits: where more are needed than allowed and the letters are
    nearly the same, swaps are tried at each place.
    """
    d = F.levenshtein(a, b, 4)
    swapped = lambda x, i: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.lit(1)), F.substring(x, i, F.lit(1)), F.substring(x, i + 2, F.length(x)))
    places = F.sequence(F.lit(1), F.length(a) - 1)
    one_swap = F.exists(places, lambda i: swapped(a, i) == b)
    two_swaps = F.exists(places, lambda i: F.exists(places, lambda j: (j > i + 1) & (swapped(swapped(a, i), j) == b)))
    swap_and_edit = F.exists(places, lambda i: F.levenshtein(swapped(a, i), b, 1).between(0, 1))
    kept = F.levenshtein(a_letters, b_letters, 2)  # letters that differ, a changed one twice at most
    return (
        F.when(d.between(0, 1), d).when((d == 2) & (kept == 0), F.when(one_swap, 1).otherwise(2)).when(d == 2, 2)
        .when(d.isin(3, 4) & (kept == 0), F.when(two_swaps, 2).when((d == 3) & swap_and_edit, 2)).when((d == 3) & kept.between(1, 2), F.when(swap_and_edit, 2))
    )


def _edits_for(c: Column, long: int) -> Column:
    return F.when(F.length(c) < 4, 0).when(F.length(c) < long, 1).otherwise(2)


def _near(v: Column, n: Column) -> Column:
    """Whether a value's word answers to a name's."""
    return (v["w"] == n["w"]) | ((F.length(n["w"]) >= 4) & (F.abs(F.length(v["w"]) - F.length(n["w"])) <= 2) & F.coalesce(edits(v["w"], n["w"], v["s"], n["s"]) <= F.least(_edits_for(n["w"], LONG_WORD), _edits_for(v["w"], LONG_WORD)), F.lit(False)))


def _sum(items: Column) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda a, x: a + x)


def words_answer(vwords: Column, nwords: Column) -> Column:
    """Whether a value's words hold enough of a name's weight, with little weight in other words. Weights run from 0 to 1 on both sides."""
    held = _sum(F.transform(nwords, lambda n: F.when(F.exists(vwords, lambda v: _near(v, n)), n["m"]).otherwise(0.0)))
    other = _sum(F.transform(vwords, lambda v: F.when(F.exists(nwords, lambda n: _near(v, n)), 0.0).otherwise(v["m"])))
    return (held >= NAME_SHARE * _sum(F.transform(nwords, lambda n: n["m"]))) & (other <= ADDED_SHARE * (held + other))


def match(index: NgramIndex, values: DataFrame, value: str, long_name: int = LONG_NAME, threshold: float = THRESHOLD, lead: float = LEAD) -> DataFrame:
    """(value, key, score) for distinct values that mean an entry.

    values may have vwords (its words as w, s, m): then words that answer pass the check too; and
    several (boolean): such a value is held against names of several words only.
    """
    have = set(values.columns)
    kept = values.select(value, *[c for c in ("vwords", "several") if c in have])
    kept = kept.repartition(values.sparkSession.sparkContext.defaultParallelism * 2)
    names = index.described()
    names = F.broadcast(names) if index.total <= MAX_NAMES and fits_broadcast(names) else names
    pairs = index.scored(kept, value, threshold).join(names, "name")
    if len(have & {"vwords", "several"}):
        pairs = pairs.join(kept, value)
    if "several" in have:
        pairs = pairs.filter("joined OR NOT several")
    a, b = squashed(F.col(value)), squashed(F.col("name"))
    apart = F.when(a == b, 0).when((F.length(a) >= SHORTEST) & (F.abs(F.length(a) - F.length(b)) <= 2), edits(a, b, _letters(a), _letters(b)))
    apart = F.when(apart <= F.when(F.length(a) < long_name, 1).otherwise(2), apart)
    if "vwords" in have:
        apart = F.coalesce(apart, F.when((F.length(a) >= SHORTEST) & (F.col("score") >= WORDS_THRESHOLD) & words_answer(F.col("vwords"), F.col("nwords")), 3))
    passed = pairs.withColumn("apart", apart).filter("apart IS NOT NULL").withColumn("score", F.when(F.col("apart") == 0, 1.0).otherwise(F.least(F.col("score"), F.lit(0.999))))
    # the check leaves the entries that are least apart; among them the cosine decides, by its lead
    per_key = passed.groupBy(value, "key").agg(F.min(F.struct("apart", (-F.col("score")).alias("minus"))).alias("o"))
    best = per_key.groupBy(value).agg(F.slice(F.sort_array(F.collect_list(F.struct("o.apart", "o.minus", "key"))), 1, 2).alias("o"))  # entries within an edit bound, a few
    first, second = F.element_at("o", 1), F.try_element_at("o", F.lit(2))
    clear = second.isNull() | (second["apart"] > first["apart"]) | (second["minus"] - first["minus"] >= lead)
    return best.filter(clear).select(value, first["key"].alias("key"), (-first["minus"]).alias("score"))


def weighed(forms: DataFrame, form: str) -> DataFrame:
    """(form, vwords): distinct forms with their words and how telling each is: its inverse frequency over the forms."""
    flat = forms.select(form, F.posexplode(F.split(form, " ")).alias("at", "w"))
    n = forms.agg(F.count(F.lit(1)).alias("n"))
    weights = flat.groupBy("w").agg(F.countDistinct(form).alias("k")).crossJoin(F.broadcast(n)).select("w", (F.log(1 + F.col("n") / F.col("k")) / F.log(1 + F.col("n"))).alias("m"))  # one row
    return lookup_join(flat, checkpointed(weights), ["w"]).groupBy(form).agg(F.collect_list(F.struct("w", _letters(F.col("w")).alias("s"), "m")).alias("vwords"))


def map_names(df: DataFrame, item: str, typed: str, index: NgramIndex) -> DataFrame:
    """(item, key): one row per non-blank value, key 'unmatched' where no entry is meant."""
    rows = df.select(F.col(item).alias("item"), F.col(typed).alias("typed")).filter(blank_free(F.col("typed")) != "")
    # each spelling is normalised once, each normal form scored once
    spelt = checkpointed(rows.groupBy("typed").agg(F.lit(1).alias("one")).select("typed", typed_forms(F.col("typed")).alias("forms")))
    each = spelt.select("typed", F.explode("forms").alias("form"))
    found = match(index, weighed(each.select("form").distinct(), "form"), "form")
    per = each.join(found, "form").groupBy("typed").agg(F.max(F.struct("score", "key")).alias("b"), F.min("key").alias("low"), F.max("key").alias("high"))
    meant = spelt.join(per, "typed", "left").select("typed", F.coalesce("b.key", F.lit("unmatched")).alias("key"))
    return lookup_join(rows, checkpointed(meant), ["typed"], "left").select("item", F.col("key"))


def telling_words(index: NgramIndex) -> DataFrame:
    """(key, name, joined): the words that a text must hold for a name to be in it: a name's heaviest ones, without which it lacks NAME_SHARE, and the name run together."""
    words = index.described().select("name", F.sort_array(F.transform("nwords", lambda n: F.struct(n["m"].alias("m"), n["w"].alias("w"))), False).alias("o"))
    total = _sum(F.transform("o", lambda x: x["m"]))
    # word i is needed while the words after it couldn't reach the share
    needed = F.filter(F.transform("o", lambda x, i: F.struct(x["w"].alias("w"), _sum(F.transform(F.slice("o", i + 1, F.size("o")), lambda y: y["m"])).alias("rest"))), lambda x: x["rest"] >= NAME_SHARE * total)
    each = words.select(F.explode(F.concat(F.transform(needed, lambda x: x["w"]), F.array(squashed(F.col("name"))))).alias("name"))
    return each.distinct().select(F.col("name").alias("key"), "name", F.lit(False).alias("joined"))


def find_mentions(df: DataFrame, item: str, text: str, index: NgramIndex) -> DataFrame:
    """(item, key): every entry that a text names, once.

    A word that follows a joining sign is the second part of a name and never stands alone; of the
    windows around a word the longest that means an entry decides, the likeliest on a tie.
    """
    skipped = ("the", *JOINERS)
    # texts are cut at blanks only, which is cheap; patterns see distinct pieces, and the surroundings of hits
    pieces = F.split(F.replace(F.translate(F.col(text), "\t\r\f\u00a0\u2007\u202f", "      "), F.lit("\n"), F.lit(" \n ")), " ")
    texts = df.select(F.col(item).alias("item"), pieces.alias("w"))
    spelt = texts.select(F.explode(F.array_distinct("w")).alias("piece")).groupBy("piece").agg(F.lit(1).alias("one"))
    words = checkpointed(spelt.select("piece", F.explode(F.transform(F.regexp_extract_all("piece", F.lit(_WORD), 0), _word)).alias("form")).filter((F.length("form") >= 2) & ~F.col("form").isin(*skipped)))
    near = _words_like(index, words.select("form").distinct())
    hits = checkpointed(words.join(near, "form").select("piece").distinct())
    # windows around words of those pieces only
    span = max(index.longest - 1, 0)
    reach = 2 * span + 1
    at = lookup_join(texts.select("item", "w", F.posexplode("w").alias("pos", "piece")), hits, ["piece"])
    fine = lambda part: F.regexp_extract_all(F.array_join(part, " "), F.lit(rf"{_WORD}|[&+]|[;!?|\n]"), 0)
    at = at.select(
        "item", "pos", fine(F.slice("w", F.greatest(F.col("pos") - reach + 1, F.lit(1)), F.least(F.col("pos"), F.lit(reach)))).alias("l"), fine(F.array("piece")).alias("c"), fine(F.slice("w", F.col("pos") + 2, reach)).alias("r")
    )
    at = at.select("item", "pos", "l", "c", "r", F.explode(F.sequence(F.lit(1), F.size("c"))).alias("n")).withColumn("centre", F.element_at("c", F.col("n"))).filter(~F.col("centre").rlike(r"^[&+;!?|\n]$"))
    left, right = F.concat("l", F.slice("c", F.lit(1), F.col("n") - 1)), F.concat(F.slice("c", F.col("n") + 1, F.size("c")), "r")
    # a name doesn't go on beyond a line or such a mark; joining words and signs aren't counted
    clean = lambda part, other_side: F.filter(F.split(F.regexp_replace(F.array_join(part, " "), other_side, " "), " +"), lambda t: ~F.lower(t).isin("", "&", "+", *skipped))
    at = at.select("item", "pos", "n", "centre", F.try_element_at(left, F.lit(-1)).isin("&", "+").alias("joined_on"), clean(left, r"(?s)^.*[;!?|\n]").alias("l"), clean(right, r"(?s)[;!?|\n].*$").alias("r"))
    windows = [F.when(~F.coalesce("joined_on", F.lit(False)), F.col("centre"))]
    for before in range(span + 1):
        for after in range(span + 1 - before):
            if before + after:
                words_in = F.concat(F.slice("l", -before, before) if before else F.array().cast("array<string>"), F.array("centre"), F.slice("r", 1, after) if after else F.array().cast("array<string>"))
                windows.append(F.when((F.size("l") >= before) & (F.size("r") >= after), _spaced(words_in)))
    # a kept table: it is read for the distinct windows and for the result
    around = checkpointed(at.select("item", "pos", "n", F.explode(F.array_compact(F.array(*windows))).alias("window")))
    seen = checkpointed(around.groupBy("window").agg(F.lit(1).alias("one")).select("window", _spaced(F.filter(F.transform(F.split("window", " "), _word), lambda t: t != "")).alias("form")))
    forms = seen.groupBy("form").agg(F.lit(1).alias("one")).select("form", F.contains("form", F.lit(" ")).alias("several"))
    found = match(index, forms, "form", long_name=LONG_WORD)
    meant = checkpointed(seen.join(found, "form").select("window", "key", "score", F.size(F.split("form", " ")).alias("n_words")))
    chosen = lookup_join(around, meant, ["window"]).groupBy("item", "pos", "n").agg(F.max(F.struct("n_words", "score", "key")).alias("b"))
    return chosen.select("item", "b.key").distinct()


def _word(c: Column) -> Column:
    """A word's comparison form."""
    return F.regexp_replace(_unquoted(plain(c)), r"[^\p{L}\p{Nd}]+", "")


def _words_like(index: NgramIndex, words: DataFrame) -> DataFrame:
    """(form): distinct words that are within two edits of a telling word, or the beginning of one run together."""
    telling = NgramIndex(telling_words(index))
    a, b = F.col("form"), F.col("name")
    # a window's check is on the whole, so the words of it are held against the looser bound
    pairs = telling.scored(words.repartition(words.sparkSession.sparkContext.defaultParallelism * 2), "form", THRESHOLD - 0.1)
    ok = (a == b) | ((F.length(b) >= 4) & edits(a, b, _letters(a), _letters(b)).isNotNull())
    return pairs.filter(ok).select("form").distinct()
