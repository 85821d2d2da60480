"""Garbled text from a wrong character encoding: found and, where possible, restored.

Smoothed character n-gram models are trained on clean records. Every distinct token with a
character beyond ASCII is scored as it stands and under every candidate encode-decode
chain (also repeated ones, and ones that lost characters on the way); the likeliest reading
is accepted when it beats the token by a validated margin. Tokens are counted before they
are scored, so the work follows the vocabulary, not the volume.

Texts are read once: that pass counts the tokens, those beyond ASCII apart for each record.
What follows works on these counts. Training takes two rounds: the first leaves out the
tokens beyond ASCII of records that hold byte patterns of misread UTF-8, the second those of
records that the first model flags; plain ASCII tokens are the same in clean and garbled
records. The model is a set of hashed count tables of fixed size, whatever the corpus.

Defined results: null and empty texts are no cases; a replacement character or a C1 control
always is one, restorable or not; repeated rows are treated alike; texts are read whole; an
empty table gives no rows; other columns are ignored; a record without an id is trained on but not
reported. Two replacement characters side by
side are found but never restored, and one stands for one of ALPHABET characters only.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.session import checkpointed, lookup_join

#: log2 of the buckets of a count table, and how many tables a count has (the least of them holds): 10 MB in all.
BUCKET_BITS, HASHES = 18, 2
#: A reading must be so many nats likelier than the token, at least and at most; what lies between is set on the data (see validated_margin).
MARGIN, MOST_MARGIN = 4.0, 8.0
#: The share of clean tokens that may exceed the margin.
FALSE_SHARE = 0.001
#: The first training round drops records at this margin already.
SCREEN_MARGIN = 2.5
#: Characters that a replacement character may stand for when it is restored, the most frequent first; what is found doesn't depend on it.
ALPHABET = 512

#: Decoders that misread UTF-8 bytes.
UTF8_READERS = ("cp1252", "latin-1", "cp1250", "cp1251", "cp1254", "mac_roman", "cp437", "cp850")
#: (bytes written in, read as) between single-byte encodings.
SINGLE_BYTE = (("cp1252", "mac_roman"), ("mac_roman", "cp1252"), ("cp1252", "cp850"), ("cp850", "cp1252"), ("cp1252", "cp437"), ("cp437", "cp1252"), ("cp1252", "cp1250"), ("cp1250", "cp1252"), ("cp1251", "cp1252"), ("cp1252", "cp1251"))
#: Fixed marks of a wrong decode: the replacement character and the C1 controls.
BROKEN = "[�\u0080-\u009f]"
TOKEN_BREAK = r"[ \n\t\r\f]+"


@lru_cache(maxsize=None)
def _byte_table(codec: str) -> tuple[list[str], dict[str, int]]:
    """Byte -> character of a codec, undefined bytes standing for themselves, and the way back."""
    chars = [bytes([b]).decode(codec, "replace") for b in range(256)]
    chars = [chr(b) if c == "�" else c for b, c in enumerate(chars)]
    return chars, {c: b for b, c in reversed(list(enumerate(chars)))}


def _encode(text: str, codec: str) -> bytes | None:
    back = _byte_table(codec)[1]
    out = bytearray()
    for c in text:
        b = back.get(c, -1)
        if b < 0:
            return None
        out.append(b)
    return bytes(out)


def misread(text: str, written: str, read: str) -> str:
    """text as it looks when its bytes in `written` are decoded as `read`; used to build validation cases."""
    chars = _byte_table(read)[0]
    return "".join(chars[b] for b in (text.encode(written, "ignore")))


def _unread(token: str, reader: str, written: str = "utf-8") -> str | None:
    raw = _encode(token, reader)
    if raw is None:
        return None
    try:
        return raw.decode(written)
    except UnicodeDecodeError:
        return None


def _utf8_suspects() -> str:
    """A pattern for what misread UTF-8 of Latin letters and punctuation looks like: the characters of lead bytes C2, C3 or E2 and of their continuation bytes."""
    parts = []
    for reader in UTF8_READERS:
        chars = _byte_table(reader)[0]
        one = lambda b: f"\\x{{{ord(chars[b]):x}}}"  # noqa: B023, E731
        tail = "[" + "".join(one(b) for b in range(0x80, 0xC0)) + "]"
        parts += [f"[{one(0xC2)}{one(0xC3)}]{tail}", one(0xE2) + tail + tail]
    return "|".join(parts)


def readings(token: str) -> set[str]:
    """Every strict reading of a token: misread UTF-8 undone up to three times over, or one single-byte step."""
    found: set[str] = set()
    layer = {token}
    for _ in range(3):
        nxt = set()
        for t in layer:
            for reader in UTF8_READERS:
                r = _unread(t, reader)
                if r is None and not t.isascii():
                    # garbled in places: each run beyond ASCII on its own
                    r = re.sub(r"[^\x00-\x7f]+", lambda m: _unread(m[0], reader) or m[0], t)  # noqa: B023
                if r and r != t and r not in found and r != token:
                    nxt.add(r)
        found |= nxt
        layer = nxt
    for written, reader in SINGLE_BYTE:
        r = _unread(token, reader, written)
        if r and r != token:
            found.add(r)
    return found


def lossy_forms(alphabet: str) -> dict[str, list[str]]:
    """Garbled form -> characters it may stand for, where a reader dropped what it couldn't show (or put '?')."""
    forms: dict[str, list[str]] = {}
    for c in alphabet:
        raw = c.encode("utf-8", "ignore")
        latin = raw.decode("latin-1")
        seen = {re.sub("[\u0080-\u009f ­]", "", latin), re.sub("[\u0080-\u009f]", "", latin), latin}
        for codec in ("cp1252", "cp1250", "cp1251", "cp1254"):
            whole = raw.decode(codec, "ignore")
            seen |= {whole, re.sub("[ ­]", "", whole), raw.decode(codec, "replace").replace("�", "?")}
        for form in seen:
            if form and not form.isascii() and form != c:
                forms.setdefault(form, []).append(c)
    forms["�"] = list(alphabet[:ALPHABET])
    return forms


class Model:
    """Interpolated character trigrams over hashed count tables."""

    ORDERS = ("tri", "ctx2", "bi", "ctx1", "uni")

    def __init__(self, tables: np.ndarray, alphabet: str):
        self.t = dict(zip(self.ORDERS, tables))
        self.total = max(float(tables[-1][0].sum()), 1.0)
        self.alphabet = alphabet
        self.forms = lossy_forms(alphabet)
        self.longest = max(map(len, self.forms))
        self.memo: dict[str, float] = {}

    @staticmethod
    def buckets(gram: str) -> tuple[int, int]:
        raw = gram.encode("utf-8", "surrogatepass")
        return zlib.crc32(raw) & ((1 << BUCKET_BITS) - 1), zlib.crc32(raw, 0x9E3779B9) * 0x85EBCA6B >> 16 & ((1 << BUCKET_BITS) - 1)

    def count(self, order: str, gram: str) -> float:
        a, b = self.buckets(gram)
        return float(min(self.t[order][0, a], self.t[order][1, b]))

    @staticmethod
    def shape(token: str) -> str:
        return re.sub(r"\d", "0", token)

    @classmethod
    def grams(cls, token: str) -> Iterator[tuple[str, str]]:
        s = "\x02\x02" + cls.shape(token) + "\x03"
        for i in range(2, len(s)):
            yield "tri", s[i - 2 : i + 1]
            yield "ctx2", s[i - 2 : i]
            yield "bi", s[i - 1 : i + 1]
            yield "ctx1", s[i - 1]
            yield "uni", s[i]

    def step(self, gram: str) -> float:
        """log p(last character | the two before)."""
        got = self.memo.get(gram)
        if got is None:
            n = {o: self.count(o, g) for o, g in (("tri", gram), ("ctx2", gram[:2]), ("bi", gram[1:]), ("ctx1", gram[1]), ("uni", gram[2]))}
            p1 = (n["uni"] + 0.05) / (self.total + 0.05 * 4096)
            p2 = (n["bi"] + 2 * p1) / (n["ctx1"] + 2)
            p3 = (n["tri"] + 2 * p2) / (n["ctx2"] + 2)
            if len(self.memo) > 500_000:
                self.memo.clear()
            got = self.memo[gram] = float(np.log(p3))
        return got

    def score(self, token: str) -> float:
        s = "\x02\x02" + self.shape(token) + "\x03"
        return sum(self.step(s[i - 2 : i + 1]) for i in range(2, len(s)))

    def lossy_reading(self, token: str) -> str | None:
        """The likeliest reading that replaces garbled forms by the alphabet's characters.

        Exact: what follows depends on the last two characters only, so the best text for each pair is
        kept at every place (dynamic programming), and no other.
        """
        states: list[dict[str, tuple[float, str]]] = [{} for _ in range(len(token) + 1)]
        states[0]["\x02\x02"] = (0.0, "")
        for i in range(len(token)):
            moves = [(1, token[i])]
            for n in range(1, min(self.longest, len(token) - i) + 1):
                if token[i : i + 2] != "��" and token[max(i - 1, 0) : i + 1] != "��":
                    moves += [(n, c) for c in self.forms.get(token[i : i + n], ())]
            for tail, (logp, text) in states[i].items():
                for n, c in moves:
                    p = logp + self.step(tail + self.shape(c))
                    to, key = states[i + n], (tail + self.shape(c))[-2:]
                    if key not in to or p > to[key][0]:
                        to[key] = (p, text + c)
        ends = [(p + self.step(tail + "\x03"), t) for tail, (p, t) in states[-1].items()]
        return max(ends)[1] if ends else None

    def best(self, token: str) -> tuple[str, float]:
        """The likeliest reading, and by how much it beats the token as it stands."""
        own = self.score(token)
        tried = readings(token)
        if (lossy := self.lossy_reading(token)) and lossy != token:
            tried.add(lossy)
        scored = [(self.score(r), r) for r in tried]
        top = max(scored, default=(own, token))
        return top[1], top[0] - own


def tokens(text: str) -> Column:
    return F.split(F.col(text), TOKEN_BREAK)


BEYOND = "[^\\x00-\\x7f]"


def token_counts(df: DataFrame, item: str, text: str) -> DataFrame:
    """(token, item, n): how often each token occurs, from one pass; those beyond ASCII apart for each record, the others together with a null item."""
    flat = df.select(F.col(item).alias("item"), F.explode(tokens(text)).alias("token")).filter("token <> ''")
    apart = F.col("token").rlike(BEYOND)
    return flat.groupBy(F.when(apart, F.col("token")).otherwise(F.regexp_replace("token", "[0-9]", "0")).alias("token"), F.when(apart, F.col("item")).alias("item")).agg(F.count(F.lit(1)).alias("n"))


def vocabulary(counts: DataFrame, without: DataFrame | None = None) -> DataFrame:
    """(token, n): distinct tokens, digits as '0'; tokens beyond ASCII of the records in `without` are left out."""
    kept = counts if without is None else counts.filter("item IS NULL").unionByName(counts.filter("item IS NOT NULL").join(without, "item", "left_anti"), allowMissingColumns=True)
    return kept.groupBy(F.regexp_replace("token", "[0-9]", "0").alias("token")).agg(F.sum("n").alias("n"))


def _gram_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    tables = np.zeros((len(Model.ORDERS), HASHES, 1 << BUCKET_BITS))
    row = {o: i for i, o in enumerate(Model.ORDERS)}
    for pdf in batches:
        for token, n in zip(pdf["token"], pdf["n"]):
            for order, gram in Model.grams(token):
                for h, b in enumerate(Model.buckets(gram)):
                    tables[row[order], h, b] += n
    at = np.nonzero(tables)
    yield pd.DataFrame({"o": (at[0] * HASHES + at[1]).astype("int32"), "b": at[2].astype("int32"), "n": tables[at]})


def _train(words: DataFrame) -> Model:
    # a task's tables hold at most 5 * HASHES * 2^BUCKET_BITS entries; summed they come to the driver as such a table
    counts = words.mapInPandas(_gram_counts, "o int, b int, n double").groupBy("o", "b").agg(F.sum("n").alias("n")).toPandas()
    tables = np.zeros((len(Model.ORDERS), HASHES, 1 << BUCKET_BITS), dtype="float32")
    tables[counts["o"] // HASHES, counts["o"] % HASHES, counts["b"]] = counts["n"]
    # every character beyond ASCII that the words have: the alphabet of a language, not the volume
    letters = words.filter(F.col("token").rlike(BEYOND)).select(F.explode(F.split("token", "")).alias("c"), "n").filter(F.col("c").rlike(f"^{BEYOND}")).groupBy("c").agg(F.sum("n").alias("n")).toPandas()
    letters = letters.sort_values(["n", "c"], ascending=[False, True])
    return Model(tables, "".join(c for c in letters["c"] if len(c) == 1))


def gains(words: DataFrame, model: Model) -> DataFrame:
    """(token, reading, gain): each token's likeliest reading and by how much it beats the token."""
    shared = words.sparkSession.sparkContext.broadcast((np.stack([model.t[o] for o in Model.ORDERS]), model.alphabet))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Model(*shared.value)
        for pdf in batches:
            best = [own.best(token) for token in pdf["token"]]
            yield pd.DataFrame({"token": pdf["token"].to_numpy(), "reading": pd.Series([r for r, _ in best], dtype=object), "gain": np.array([g for _, g in best], dtype="float64")})

    return words.select("token").mapInPandas(score, "token string, reading string, gain double")


def validated_margin(scored: DataFrame, words: DataFrame) -> float:
    """The margin that all but FALSE_SHARE of the distinct clean words beyond ASCII keep to.

    Every one of them counts: the quantile is exact, but only gains that the margin can reach are put in order, the others are counted.
    """
    clean = words.filter(F.col("token").rlike(BEYOND)).select("token")
    every = scored.filter(~F.col("token").rlike(BROKEN)).groupBy(F.regexp_replace("token", "[0-9]", "0").alias("token")).agg(F.max("gain").alias("gain"))
    every = checkpointed(every.join(clean.hint("merge"), "token", "left_semi").select("gain"))
    low = MARGIN - 0.5
    n, most, below, least = every.agg(F.count(F.lit(1)), F.count_if(F.col("gain") >= low), F.max(F.when(F.col("gain") < low, F.col("gain"))), F.min(F.when(F.col("gain") >= low, F.col("gain")))).first()
    at = (n - 1) * (1 - FALSE_SHARE) - (n - most)  # the quantile's place among the gains from low on
    if not n or at <= -1:
        return MARGIN
    if at < 0:
        value = below + (at + 1) * (least - below)
    else:
        value = every.filter(F.col("gain") >= low).agg(F.percentile("gain", at / max(most - 1, 1))).first()[0]
    return float(np.clip(value + 0.5, MARGIN, MOST_MARGIN))


def verdicts(scored: DataFrame, margin: float) -> DataFrame:
    """(token, restored): garbled tokens; restored is null where no reading beats the token."""
    better = F.col("gain") > margin
    return scored.filter(better | F.col("token").rlike(BROKEN)).select("token", F.when(better & ~F.col("reading").rlike(BROKEN), F.col("reading")).alias("restored"))


def fit(counts: DataFrame, suspects: DataFrame) -> tuple[DataFrame, float]:
    """The suspects scored by the model of the second round, and its margin; suspects: distinct tokens beyond ASCII (kept)."""
    pairs = counts.filter("item IS NOT NULL").select("item", "token")
    records = lambda bad: lookup_join(pairs, bad, ["token"]).select("item").distinct()
    structural = checkpointed(suspects.filter(F.col("token").rlike(BROKEN) | F.col("token").rlike(_utf8_suspects())).select("token"))
    first = _train(checkpointed(vocabulary(counts, records(structural))))
    screened = checkpointed(verdicts(gains(suspects, first), SCREEN_MARGIN).select("token"))
    # clean records: none of their tokens flagged by the first model
    clean = checkpointed(vocabulary(counts, records(screened)))
    scored = checkpointed(gains(suspects, _train(clean)))
    return scored, validated_margin(scored, clean)


def garbled_tokens(df: DataFrame, item: str, text: str) -> DataFrame:
    """(item, token, restored): garbled tokens of each record with their reading."""
    counts = checkpointed(token_counts(df, item, text))
    pairs = counts.filter("item IS NOT NULL").select("item", "token")
    suspects = checkpointed(pairs.select("token").distinct().repartition(df.sparkSession.sparkContext.defaultParallelism * 2))
    scored, margin = fit(counts, suspects)
    bad = checkpointed(verdicts(scored, margin))
    return lookup_join(pairs, bad, ["token"]).select(F.col("item").alias(item), "token", "restored")


def restored_texts(df: DataFrame, item: str, text: str) -> DataFrame:
    """(item, text, n_garbled, n_restored): texts with garbled tokens, restored where a reading was accepted."""
    found = garbled_tokens(df, item, text).groupBy(item).agg(F.collect_list(F.struct("token", "restored")).alias("fixes"))
    kind = df.schema[item].dataType.simpleString()

    def repair(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts, n, done = [], [], []
            for body, fixes in zip(pdf[text], pdf["fixes"]):
                known = {f["token"]: f["restored"] for f in fixes}
                texts.append("".join(known.get(p) or p for p in re.split(f"({TOKEN_BREAK})", body)))
                n.append(len(known))
                done.append(sum(v is not None for v in known.values()))
            yield pd.DataFrame({item: pdf[item], text: texts, "n_garbled": n, "n_restored": done})

    return df.select(item, text).join(found, item).mapInPandas(repair, f"`{item}` {kind}, `{text}` string, n_garbled long, n_restored long")
