"""Records that are the same but for their form (problem 4).

Each line becomes a multiset of (field name, value) pairs, reduced to lower-case letters and digits; prose is
one pair without a name. Every pair is hashed, the hashes are added up, which is commutative, so that the order
of the fields does not matter, and lines are grouped by the sums. Only hashes and ids are shuffled for that. The
lines of groups of two or more are then held against their group's first line, pair by pair and without sorting.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bhashaloom.functions.unicode import ALNUM, letters_and_digits
from bhashaloom.plans.skew import checkpointed, hot_keys, salted_join

#: Between name and value in the notations of records: colon, equals sign, or a dash between spaces.
_SEPARATED = r"^\s*(.*?)(?:[:=]| [-–—] )(.*)$"
_JSON = rf'^[^{ALNUM}{{]*\{{\s*".*\}}[^{ALNUM}]*$'
_JSON_PAIR = r'"((?:[^"\\]|\\.)*)"\s*:\s*("(?:[^"\\]|\\.)*"|[^",{}\[\]]*)'
#: What is left of an object without its pairs if they aren't all of it: letters or digits, an array, or an object within.
_JSON_MORE = rf"[{ALNUM}]|\{{.*[\[{{]"
#: Ends the name within a pair, and a name around a name; they are no letters, so no text can hold them.
_END, _WITHIN = "\x1f", "\x1e"
_LEAVES = T.ArrayType(T.StructType([T.StructField("path", T.ArrayType(T.StringType())), T.StructField("value", T.StringType())]))
_WORDS = {True: "true", False: "false", None: "null"}


class _Object:
    """A parsed object with all its pairs, repeated names too."""

    def __init__(self, pairs: list):
        self.pairs = pairs


def _leaves(value, path: tuple[str, ...] = ()) -> list[tuple[list[str], str]]:
    """(names from the outermost one inwards, value) of a parsed object. An array without objects is one value, its
    entries one after the other; the entries of another one are named by their places."""
    out, todo = [], [(value, path)]
    while todo:
        value, path = todo.pop()
        if isinstance(value, _Object):
            todo += [(x, (*path, name)) for name, x in value.pairs] or ([([], path)] if path else [])
        elif isinstance(value, list):
            flat, rest, objects = [], list(reversed(value)), False
            while rest and not objects:
                x = rest.pop()
                objects = isinstance(x, _Object)
                rest += reversed(x) if isinstance(x, list) else []
                flat += [] if isinstance(x, list | _Object) else [x if isinstance(x, str) else _WORDS[x]]
            if objects:
                todo += [(x, (*path, str(i))) for i, x in enumerate(value)]
            else:
                out.append((list(path), " ".join(flat)))
        else:
            out.append((list(path), value if isinstance(value, str) else _WORDS[value]))
    return out


def _parsed(form: str) -> list[tuple[list[str], str]] | None:
    """The leaves of the object in a line, or of the objects in an array; None if it can't be read as a whole."""
    for first, last in ("[{", "]}"), ("{", "}"):
        start, end = min(i for i in map(form.find, first) if i >= 0), max(map(form.rfind, last)) + 1
        try:
            out = _leaves(json.loads(form[start:end], object_pairs_hook=_Object, parse_int=str, parse_float=str, parse_constant=str, strict=False))
            for path, value in out:
                "".join([*path, value]).encode()  # half a surrogate pair is no text
            return out
        except (ValueError, RecursionError):
            pass
    return None


@F.arrow_udf(_LEAVES)
def _nested(forms: pa.Array) -> pa.Array:
    kind = pa.list_(pa.struct([("path", pa.list_(pa.string())), ("value", pa.string())]))
    if forms.null_count == len(forms):
        return pa.nulls(len(forms), kind)
    found = (None if x is None else _parsed(x) for x in forms.to_pylist())
    return pa.array([None if x is None else [{"path": p, "value": v} for p, v in x] for x in found], kind)


def with_fields(frame: DataFrame, line: str, pairs: str = "pairs") -> DataFrame:
    """Frame with the normalized pairs of each line as strings, name first; prose is one pair with an empty name.

    A line is a record if it is a JSON object, or has at least two parts between ``|`` (else ``;``) and each of
    them that holds a letter or digit has a name before a colon, an equals sign or a dash. Null and lines without
    letters and digits have no pairs. The name of a field in an object within has the names around it before it; an
    array is one value, or, if objects are in it, its entries are named by their places. A JSON object that can't be
    read as a whole is prose, so that every letter and digit of a line is in some pair. The steps are columns of their own, so that none is worked out twice.
    """
    has_text = lambda c: c.rlike(f"[{ALNUM}]")
    pair = lambda name, value: F.concat(letters_and_digits(name), F.lit(_END), letters_and_digits(value))
    empty = F.array().cast("array<string>")

    seen = F.col(line)
    staged = frame.withColumn("__form", F.when(seen.rlike(r"[|;]|\{.*:"), F.regexp_replace(F.regexp_replace(seen, r"\p{Cf}+", ""), r"[\p{Z}\p{Cc}]+", " ")))
    staged = staged.withColumn("__json", F.when(F.col("__form").rlike(_JSON), F.col("__form"))).withColumn(
        "__parts",
        F.when(F.col("__json").isNull() & F.col("__form").rlike("[|;]"), F.filter(F.split("__form", F.when(F.col("__form").contains("|"), F.lit(r"\|")).otherwise(F.lit(";"))), has_text)),
    )
    found = F.arrays_zip(*(F.regexp_extract_all("__json", F.lit(_JSON_PAIR), F.lit(i)).alias(f"g{i}") for i in (1, 2)))
    # Nearly all objects are flat and without escapes; only others go to Python.
    more = F.col("__json").contains("\\") | F.regexp_replace("__json", _JSON_PAIR, "").rlike(_JSON_MORE)
    staged = staged.withColumn("__more", F.coalesce(more, F.lit(False)))
    staged = staged.withColumn("__nested", _nested(F.when(F.col("__more"), F.col("__json"))))
    path = lambda names: F.array_join(F.transform(names, letters_and_digits), _WITHIN)
    leaves = F.transform("__nested", lambda x: F.concat(path(x["path"]), F.lit(_END), letters_and_digits(x["value"])))
    flat = F.when(F.col("__json").isNotNull(), F.transform(found, lambda x: pair(x["g1"], x["g2"])))
    staged = staged.withColumn("__objects", F.filter(F.when(F.col("__more"), leaves).otherwise(flat), has_text))
    named = F.forall("__parts", lambda p: p.rlike(_SEPARATED) & has_text(F.regexp_extract(p, _SEPARATED, 1)))
    split = F.transform("__parts", lambda p: pair(F.regexp_extract(p, _SEPARATED, 1), F.regexp_extract(p, _SEPARATED, 2)))
    staged = staged.withColumn("__split", F.when(F.col("__parts").isNotNull() & (F.size("__parts") > 1), F.when(named, split)))
    staged = staged.withColumn("__prose", F.when(F.size(F.coalesce("__objects", "__split", empty)) < 1, letters_and_digits(seen)))
    value = F.when(F.col("__prose").isNull(), F.coalesce("__objects", "__split", empty)).when(F.col("__prose") != "", F.array(F.concat(F.lit(_END), "__prose"))).otherwise(empty)
    return staged.withColumn(pairs, value).drop("__form", "__json", "__parts", "__more", "__nested", "__objects", "__split", "__prose")


def fingerprint(pairs: Column) -> tuple[Column, Column]:
    """Two 64-bit values of a multiset of strings. Each half of each string's hash is added up on its own, so
    that the sums stay far from the end of their range; adding is commutative and keeps repeated pairs apart."""

    def sums(seed: int) -> Column:
        hashed = F.transform(pairs, lambda p: F.xxhash64(F.lit(seed), p))
        low = F.aggregate(hashed, F.lit(0).cast("long"), lambda a, h: a + h.bitwiseAND(F.lit(0xFFFFFFFF)))
        high = F.aggregate(hashed, F.lit(0).cast("long"), lambda a, h: a + F.shiftrightunsigned(h, 32))
        return F.xxhash64(F.lit(seed), F.size(pairs), low, high)

    return sums(1), sums(2)


def same_pairs(a: Column, b: Column) -> Column:
    """True if two arrays hold the same strings equally often, found by hashing and counting and not by sorting.

    Arrays of the same size are the same where none of the strings of one, which are all different, is missing in the other;
    only repeated strings have to be counted.
    """
    count = lambda x, all_: F.size(F.filter(all_, lambda y: y == x))
    different = F.size(F.array_distinct(a)) == F.size(a)
    counted = F.forall(F.array_distinct(a), lambda x: count(x, a) == count(x, b))
    return (F.size(a) == F.size(b)) & ((a == b) | ((F.size(F.array_except(a, b)) == 0) & (different | counted)))


def _hashed(frame: DataFrame, key: str, line: str) -> DataFrame:
    one, two = fingerprint(F.col("pairs"))
    pairs = with_fields(frame.select(F.col(key).alias("id"), F.col(line).alias("line")), "line").where(F.size("pairs") > 0)
    return pairs.select("id", one.alias("h1"), two.alias("h2"))


def _groups(hashed: DataFrame) -> DataFrame:
    return hashed.groupBy("h1", "h2").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("copies"))


def format_duplicates(frame: DataFrame, key: str, line: str) -> DataFrame:
    """Rows of (keep_id, dup_id): each line that repeats a record, with the smallest id of that record.

    Null ids, null lines and lines without letters and digits are in no group; a repeated id counts as one row.
    Other columns do not matter. A group may hold any share of the rows: groups are formed by partial sums, the
    rows of large groups are spread over many tasks when their first line joins them, and no group is gathered.
    """
    return _verified(frame, key, line)[0]


#: Lines of groups, of two numbers each, that are broadcast at most, 32 MB; more of them are joined by a shuffle.
BROADCAST_MEMBERS = 2_000_000


def _verified(frame: DataFrame, key: str, line: str) -> tuple[DataFrame, DataFrame]:
    """(keep_id, dup_id) of the lines that repeat a record, and (id, h1, h2) of all lines with one."""
    rows = frame.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), F.col(line).alias("line"))
    hashed = checkpointed(_hashed(rows, "id", "line"))
    groups = _groups(hashed).where("copies > 1")
    hot = hot_keys(groups, ["h1", "h2"], "copies", hashed.count())
    members = salted_join(hashed, groups.select("h1", "h2", "keep_id"), ["h1", "h2"], hot, ["id"]).select("id", "keep_id")
    members = checkpointed(members.dropDuplicates(["id"]))
    wanted = F.broadcast(members) if members.count() <= BROADCAST_MEMBERS else members
    # Only now are lines read again, and only those of the groups are taken apart and shuffled.
    texts = with_fields(rows.join(wanted, "id").select("id", "keep_id", "line"), "line").drop("line")
    first = texts.where("id = keep_id").dropDuplicates(["keep_id"]).select("keep_id", F.col("pairs").alias("kept"))
    hot_first = groups.join(F.broadcast(hot), ["h1", "h2"], "left_semi").select("keep_id", F.col("copies").alias("__rows"))
    checked = salted_join(texts.where("id != keep_id"), first, ["keep_id"], hot_first, ["id"])
    return checked.where(same_pairs(F.col("pairs"), F.col("kept"))).select("keep_id", F.col("id").alias("dup_id")).distinct(), hashed


def collapsed(frame: DataFrame, key: str, line: str) -> DataFrame:
    """Rows of (keep_id, copies): each record once, by its smallest id, with the number of its lines, itself included.

    Copies are those that format_duplicates has verified; a line that shares a fingerprint with others by chance is a record of its
    own. A repeated id is one line. Lines without letters and digits and null lines are no records and come out nowhere.
    """
    copies, hashed = _verified(frame, key, line)
    copies = checkpointed(copies)
    counted = copies.groupBy("keep_id").agg(F.count(F.lit(1)).alias("more"))
    records = hashed.select(F.col("id").alias("keep_id")).distinct().join(copies.select(F.col("dup_id").alias("keep_id")), "keep_id", "left_anti")
    return records.join(counted, "keep_id", "left").select("keep_id", (F.coalesce("more", F.lit(0)) + 1).alias("copies"))
