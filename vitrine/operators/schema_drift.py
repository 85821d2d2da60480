"""Schemas that drift between files: one consistent table, and a report of each change.

Records (JSON texts) become path-value rows with raw types; path-type statistics are
aggregated per file; a file's fields are held against those of the file before. A field
that goes while another comes is a rename when the same places' values go on under the
new path: candidate pairs come from an index on values (a number also falls into two
coarse logarithmic bins, so slightly grown values still meet; '3,260' is a number and yes
a flag), never from all pairs.

Defined results: unreadable or null texts and texts that aren't objects give no values and
are counted; null values count as absence; repeated records of a place count once, with
the last record's value; a record without feed or file number belongs to no file and one
without a place takes no part in the search for renames; a type tie within a file goes to the type first in the alphabet;
an empty table gives no rows. Members of any depth are joined by '.'; lists are leaves.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitrine.session import checkpointed, lookup_join

#: A rename needs this share of the common places to have matching values.
MATCH_SHARE = 0.6
#: Columns of the wide table; a schema with more fields is refused.
MAX_COLUMNS = 2_000
#: Numbers with grouping marks, and the marks.
_GROUPED, _MARKS = r"^[+-]?\d{1,3}([,'’\u00a0\u202f ]\d{3})+(\.\d+)?$", r"[,'’\u00a0\u202f ]"


def _leaves(value: dict, prefix: str = "") -> Iterator[tuple[str, object]]:
    stack = [(prefix, value)]
    while stack:
        at, node = stack.pop()
        for k, v in node.items():
            path = f"{at}.{k}" if at else k
            if isinstance(v, dict):
                stack.append((path, v))
            elif v is not None:
                yield path, v


def _kind(v: object) -> str:
    if isinstance(v, bool):
        return "true/false"
    return "number" if isinstance(v, (int, float)) else "text" if isinstance(v, str) else "list"


def path_values(df: DataFrame, ids: list[str], blocks: list[str]) -> DataFrame:
    """(ids, block_name, path, kind, value): a row per leaf; unreadable texts give one row with kind '!unreadable', absent ones '!absent'."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*ids).schema.fields)

    def flatten(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            at, block, path, kind, value = [], [], [], [], []

            def put(i, b, p, k, v):
                at.append(i), block.append(b), path.append(p), kind.append(k), value.append(v)

            for b in blocks:
                for i, text in enumerate(pdf[b]):
                    if not isinstance(text, str):
                        put(i, b, None, "!absent", None)
                        continue
                    try:
                        record = json.loads(text)
                    except (ValueError, RecursionError):
                        record = None
                    if not isinstance(record, dict):
                        put(i, b, None, "!unreadable", None)
                        continue
                    empty = True
                    for p, v in _leaves(record):
                        empty = False
                        put(i, b, p, _kind(v), v if isinstance(v, str) else json.dumps(v, ensure_ascii=False, sort_keys=True))
                    if empty:
                        put(i, b, None, "!empty", None)
            out = pdf[ids].iloc[at].reset_index(drop=True)
            yield out.assign(block_name=block, path=path, kind=kind, value=value)

    return df.select(*ids, *blocks).mapInPandas(flatten, f"{schema}, block_name string, path string, kind string, value string")


def fields_by_file(values: DataFrame, feed: str, file_no: str) -> DataFrame:
    """(feed, block_name, file_no, path, kind, n): the fields of each file with their prevailing type."""
    counted = values.filter("path IS NOT NULL").groupBy(feed, "block_name", file_no, "path", "kind").agg(F.count(F.lit(1)).alias("n"))
    top = counted.groupBy(feed, "block_name", file_no, "path").agg(F.min(F.struct(-F.col("n"), F.col("kind"))).alias("_k"), F.sum("n").alias("n"))
    return top.select(feed, "block_name", file_no, "path", F.col("_k.kind").alias("kind"), "n")


def presence_changes(fields: DataFrame, files: DataFrame, feed: str, file_no: str) -> DataFrame:
    """(feed, block_name, file_no, path, old_kind, new_kind) where a path comes, goes or changes type against file_no - 1; both files must have been delivered."""
    pairs = files.select(feed, file_no).distinct()
    pairs = checkpointed(pairs.join(pairs.select(feed, (F.col(file_no) + 1).alias(file_no)), [feed, file_no]))
    cur = fields.select(feed, "block_name", F.col(file_no), "path", F.col("kind").alias("new_kind"), F.lit(None).cast("string").alias("old_kind"))
    prev = fields.select(feed, "block_name", (F.col(file_no) + 1).alias(file_no), "path", F.lit(None).cast("string").alias("new_kind"), F.col("kind").alias("old_kind"))
    net = cur.unionByName(prev).groupBy(feed, "block_name", file_no, "path").agg(F.max("new_kind").alias("new_kind"), F.max("old_kind").alias("old_kind"))
    return lookup_join(net.filter(~F.col("new_kind").eqNullSafe(F.col("old_kind"))), pairs, [feed, file_no])


def _value_keys() -> list:
    """Under which keys a value is indexed: its text without case and blanks (grouping marks off, yes and true as 1, no and false as 0); numbers also in two
    overlapping logarithmic bins of 10 %, and whole ones up to 20 with their neighbours. A zero meets zeros only, as 0 and 1 are a flag's two values too."""
    text = F.trim("value")
    text = F.when(text.rlike(_GROUPED), F.regexp_replace(text, _MARKS, "")).otherwise(text)
    number = text.try_cast("double")
    size = F.when((F.abs(number) > 0) & (F.abs(number) < 1e300), F.log(F.abs(number)))
    plain = F.lower(F.regexp_replace(F.regexp_replace(text, r'[\s"\[\]]+', ""), r"\.0$", ""))
    plain = F.when(plain.isin("true", "yes"), "1").when(plain.isin("false", "no"), "0").otherwise(plain)
    sign = F.when(number < 0, F.lit("-")).otherwise(F.lit(""))
    whole = F.when((F.abs(number) <= 20) & (number == F.floor(number)) & (number != 0), F.abs(number).cast("int"))
    key = lambda kind, n: F.concat(F.lit(kind), sign, n.cast("string"))
    return [F.concat(F.lit("="), plain), key("a", F.floor(size * 10)), key("b", F.floor(size * 10 + 0.5)), key("n", F.when(whole > 1, whole)), key("n", whole + 1)]


def moving_values(values: DataFrame, changes: DataFrame, feed: str, file_no: str, place: list[str], newest: str) -> DataFrame:
    """(feed, block_name, file_no, path, place, value, _goes, _comes): each place's last value of the fields that the next file lacks (_goes) or the file before lacked (_comes); the other fields' values are left before any are moved."""
    at = [feed, "block_name", file_no, "path"]
    gone = changes.filter("new_kind IS NULL").select(feed, "block_name", (F.col(file_no) - 1).alias(file_no), "path", F.lit(True).alias("_goes"), F.lit(False).alias("_comes"))
    come = changes.filter("old_kind IS NULL").select(*at, F.lit(False).alias("_goes"), F.lit(True).alias("_comes"))
    touched = checkpointed(gone.unionByName(come).groupBy(*at).agg(F.max("_goes").alias("_goes"), F.max("_comes").alias("_comes")))
    kept = lookup_join(values.filter("path IS NOT NULL"), touched, at)
    return kept.groupBy(*at, *place).agg(F.max_by("value", newest).alias("value"), F.max("_goes").alias("_goes"), F.max("_comes").alias("_comes"))


def renames(values: DataFrame, changes: DataFrame, feed: str, file_no: str, place: list[str], newest: str) -> DataFrame:
    """(feed, block_name, file_no, old_field, new_field): one-to-one pairs, best first.

    Joins of values are merges by hint: their size is told from compressed files, many times too small, so
    that a side of hundreds of MB would be broadcast through the driver.
    """
    at = [feed, "block_name", file_no]
    keyed = checkpointed(moving_values(values, changes, feed, file_no, place, newest))
    before = keyed.filter("_goes").withColumn(file_no, F.col(file_no) + 1)
    after = keyed.filter("_comes")
    index = lambda df, name: df.select(*at, *place, F.col("path").alias(name), F.explode(F.array_compact(F.array(*_value_keys()))).alias("_key"))
    met = index(before, "old_field").join(index(after, "new_field").hint("merge"), [*at, *place, "_key"])
    matched = met.groupBy(*at, "old_field", "new_field", *place).agg(F.max(F.col("_key").startswith("=").cast("int")).alias("_same"))
    matched = matched.groupBy(*at, "old_field", "new_field").agg(F.count(F.lit(1)).alias("_match"), F.sum("_same").alias("_same"))
    # places that have both fields, for matched pairs only
    both = (
        matched.select(*at, "old_field", "new_field")
        .join(before.select(*at, *place, F.col("path").alias("old_field")).hint("merge"), [*at, "old_field"])
        .join(after.select(*at, *place, F.col("path").alias("new_field")).hint("merge"), [*at, "new_field", *place])
        .groupBy(*at, "old_field", "new_field").agg(F.count(F.lit(1)).alias("_common"))
    )
    bare = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    near = 1 - F.levenshtein(bare("old_field"), bare("new_field")) / F.greatest(F.length("old_field"), F.length("new_field"))
    scored = matched.join(both.hint("merge"), [*at, "old_field", "new_field"]).filter(F.col("_match") >= MATCH_SHARE * F.col("_common"))
    scored = scored.withColumn("_points", (F.col("_match") + F.col("_same")) / (2 * F.col("_common")) + 0.3 * near)
    # one-to-one: the best pair left of a block and file is taken until none is left; a group is as small as the fields that went and came
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in scored.select(*at, "old_field", "new_field").schema.fields)

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        old, new, taken = set(), set(), []
        for i in pdf.sort_values(["_points", "_match", "old_field", "new_field"], ascending=False).index:
            if pdf.at[i, "old_field"] not in old and pdf.at[i, "new_field"] not in new:
                old.add(pdf.at[i, "old_field"]), new.add(pdf.at[i, "new_field"]), taken.append(i)
        return pdf.loc[taken, [*at, "old_field", "new_field"]]

    # most blocks of a file have a single candidate: those need no settling
    kept = checkpointed(scored.select(*at, "old_field", "new_field", "_points", "_match").withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*at))))
    alone = kept.filter("_n = 1").select(*at, "old_field", "new_field")
    return alone.unionByName(kept.filter("_n > 1").groupBy(*at).applyInPandas(settle, shape))


def drift(values: DataFrame, files: DataFrame, feed: str, file_no: str, place: list[str], newest: str) -> DataFrame:
    """(feed, block_name, file_no, change_kind, old_field, new_field) of every file against the one before."""
    at = [feed, "block_name", file_no]
    # both are as small as the schema's history and read several times: kept, so that no branch plans them anew
    changes = checkpointed(presence_changes(fields_by_file(values, feed, file_no), files, feed, file_no))
    moved = checkpointed(renames(values, changes, feed, file_no, place, newest))
    gone = changes.filter("new_kind IS NULL").join(moved.select(*at, F.col("old_field").alias("path")), [*at, "path"], "left_anti")
    come = changes.filter("old_kind IS NULL").join(moved.select(*at, F.col("new_field").alias("path")), [*at, "path"], "left_anti")
    kept = changes.filter("new_kind IS NOT NULL AND old_kind IS NOT NULL")
    row = lambda df, kind, old, new: df.select(*at, F.lit(kind).alias("change_kind"), old.alias("old_field"), new.alias("new_field"))
    return (
        row(moved, "renamed", F.col("old_field"), F.col("new_field"))
        .unionByName(row(gone, "removed", F.col("path"), F.lit("")))
        .unionByName(row(come, "added", F.lit(""), F.col("path")))
        .unionByName(row(kept, "type_changed", F.col("path"), F.col("path")))
    )


def canonical_names(changes: DataFrame, fields: DataFrame, feed: str) -> DataFrame:
    """(feed, block_name, path, canonical): paths that renames link within a feed share the name that most files of all feeds use.

    A rename in one feed says nothing about another, where both names may stand side by side. The
    links of a feed's block are as few as its fields, so each is settled in one piece of a task.
    """
    used = fields.groupBy("block_name", "path").agg(F.count(F.lit(1)).alias("_n"))
    own = lookup_join(fields.select(feed, "block_name", "path").distinct(), checkpointed(used), ["block_name", "path"])
    # both sides come from the same rows: renamed anew, so that neither's columns are taken for the other's
    fresh = lambda df, *cols: df.select(*[F.col(c).alias(c) for c in cols])
    own = fresh(own, feed, "block_name", "path", "_n")
    links = fresh(changes.filter("change_kind = 'renamed'"), feed, "block_name", "old_field", "new_field").distinct()
    kind = fields.schema[feed].dataType.simpleString()

    def settle(here: pd.DataFrame, moved: pd.DataFrame) -> pd.DataFrame:
        group = {p: {p} for p in here["path"]}
        for old, new in zip(moved["old_field"], moved["new_field"]):
            both = group.get(old, {old}) | group.get(new, {new})
            for p in both:
                group[p] = both
        n = dict(zip(here["path"], here["_n"]))
        names = [min((p for p in group[p0] if p in n), key=lambda p: (-n[p], p)) for p0 in here["path"]]
        return here.assign(canonical=pd.Series(names, index=here.index, dtype=object))[[feed, "block_name", "path", "canonical"]]

    return own.groupBy(feed, "block_name").cogroup(links.groupBy(feed, "block_name")).applyInPandas(settle, f"`{feed}` {kind}, block_name string, path string, canonical string")


def typed_values(values: DataFrame, names: DataFrame, feed: str, ids: list[str]) -> DataFrame:
    """(ids, block_name, field, target, kind, number, flag, items, text, cast_failed): each value under its canonical field, cast to that field's prevailing type.

    A value that can't be cast keeps null in the typed column, its raw text, and cast_failed = true.
    """
    named = lookup_join(values.filter("path IS NOT NULL"), names, [feed, "block_name", "path"]).withColumnRenamed("canonical", "field")
    counts = named.groupBy("block_name", "field", "kind").agg(F.count(F.lit(1)).alias("n"))
    target = counts.groupBy("block_name", "field").agg(F.min(F.struct(-F.col("n"), F.col("kind"))).alias("_t")).select("block_name", "field", F.col("_t.kind").alias("target"))
    typed = lookup_join(named, checkpointed(target), ["block_name", "field"])  # a row per field of the schema
    plain = F.lower(F.trim("value"))
    number = F.when(F.col("target") == "number", F.coalesce(F.trim("value").try_cast("double"), F.when(F.trim("value").rlike(_GROUPED), F.regexp_replace(F.trim("value"), _MARKS, "").try_cast("double"))))
    flag = F.when(F.col("target") == "true/false", F.when(plain.isin("true", "yes", "1", "1.0"), True).when(plain.isin("false", "no", "0", "0.0"), False))
    items = F.when(F.col("target") == "list", F.when(F.col("kind") == "list", F.from_json("value", "array<string>")).otherwise(F.split("value", r"\s*,\s*")))
    out = typed.withColumns({"number": number, "flag": flag, "items": items, "text": F.col("value")})
    failed = ((F.col("target") == "number") & F.col("number").isNull()) | ((F.col("target") == "true/false") & F.col("flag").isNull()) | ((F.col("target") == "list") & F.col("items").isNull())
    return out.select(*ids, "block_name", "field", "target", "kind", "number", "flag", "items", "text", F.coalesce(failed, F.lit(False)).alias("cast_failed"))


def wide_table(typed: DataFrame, ids: list[str]) -> DataFrame:
    """One row per record: ids, a typed column `block.field` for every canonical field, and failed_casts, the fields whose value is kept out as it can't be cast.

    Columns are a property of the schema; their number is checked. A record with two values of a field keeps the greater.
    """
    fields = typed.select("block_name", "field", "target").distinct().limit(MAX_COLUMNS + 1).collect()
    if len(fields) > MAX_COLUMNS:
        raise ValueError(f"more than {MAX_COLUMNS} fields: these aren't records of one schema")
    column = {"number": "number", "true/false": "flag", "list": "items"}
    here = lambda f: (F.col("block_name") == f["block_name"]) & (F.col("field") == f["field"])
    each = [F.max(F.when(here(f), F.col(column.get(f["target"], "text")))).alias(f"{f['block_name']}.{f['field']}") for f in sorted(fields)]
    failed = F.array_sort(F.collect_set(F.when(F.col("cast_failed"), F.concat_ws(".", "block_name", "field")))).alias("failed_casts")
    return typed.groupBy(*ids).agg(*each, failed)


def cast_report(typed: DataFrame) -> DataFrame:
    """(block_name, field, target, kind, n_values, n_failed): how the values of each raw type went into their field's type."""
    return typed.groupBy("block_name", "field", "target", "kind").agg(F.count(F.lit(1)).alias("n_values"), F.count_if("cast_failed").alias("n_failed"))
