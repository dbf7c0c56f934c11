"""Document fingerprints by winnowing, in DataFrame functions only.

A text's units are its words. A word of over 16 characters is cut by its content, after each vowel,
digit or letter of a script that is written without blanks (and after 16 characters at the latest), so that
text without blanks falls into the same units again soon after a change. Every run of K units is hashed; of each W consecutive hashes the smallest is kept, the rightmost of equal ones, with
its position. Two texts that share W + K - 1 units in a row therefore share a kept hash, and no match
shorter than K units is ever reported.

Steps that build an array and then look into it are bound with ``let``, so that Catalyst cannot
inline the array's making into the loop over it.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W_

from .common import dealt_in_order, div

K = 5
W = 12
_SOLID = r"[^\x20\x09-\x0D]"
#: Where a long word is cut: vowels, digits, Thai, kana, Han, Hangul.
_CUT = r"[aeiouAEIOU0-9\u0E00-\u0E7F\u3040-\u30FF\u3400-\u4DBF\u4E00-\u9FFF\uAC00-\uD7AF]"
UNIT = (rf"(?<!{_SOLID}){_SOLID}{{1,16}}(?!{_SOLID})|[^\x20\x09-\x0DaeiouAEIOU0-9\u0E00-\u0E7F\u3040-\u30FF\u3400-\u4DBF\u4E00-\u9FFF\uAC00-\uD7AF]"
        rf"{{0,15}}{_CUT}|{_SOLID}{{1,16}}")
_LOW = (1 << 31) - 1


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once."""
    return F.transform(F.array(value), body)[0]


def _grams(units: Column, k: int) -> Column:
    # Beyond the end ``get`` gives null, which the hash skips: with under k units the first hash is of all.
    each = F.transform(units, lambda u, i: F.xxhash64(u, *[F.get(units, i + j) for j in range(1, k)]))
    return F.slice(each, F.lit(1), F.greatest(F.size(units) - (k - 1), F.lit(1)))


def _least(values: Column, w: int) -> Column:
    """Minimum of every ``w`` consecutive values (of all, if fewer), by doubling the width."""
    def shifted(v: Column, by: int) -> Column:  # zip_with fills up with nulls, which ``least`` skips
        return F.zip_with(v, F.slice(v, F.lit(by + 1), F.size(v)), lambda a, b: F.least(a, b))

    def widen(v: Column, width: int) -> Column:
        if width == w:
            return F.slice(v, F.lit(1), F.greatest(F.size(v) - (w - 1), F.lit(1)))
        more = min(width, w - width)
        return let(shifted(v, more), lambda wider: widen(wider, width + more))

    return let(values, lambda v: widen(v, 1))


def _kept(grams: Column, w: int) -> Column:
    # Upper hash bits above, the distance from the right below: the least is the rightmost minimum.
    ranked = F.transform(grams, lambda h, i: F.shiftleft(F.shiftrightunsigned(h, 33), 31) + (F.lit(_LOW) - i))
    return F.transform(F.array_distinct(_least(ranked, w)), lambda v: let(
        (F.lit(_LOW) - v.bitwiseAND(F.lit(_LOW))).cast("int"),
        lambda at: F.struct(at.alias("position"), F.element_at(grams, at + 1).alias("hash"))))


def fingerprint(text: Column, k: int = K, w: int = W) -> Column:
    """array<struct<position int, hash bigint>>, by position; position counts units from 0.

    A text of fewer than K units has the hash of them all; one without words, or null, has none.
    """
    units = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(UNIT), 0)
    return let(units, lambda u: F.when(F.size(u) > 0, let(_grams(u, k), lambda g: _kept(g, w))).otherwise(
        F.array().cast("array<struct<position:int,hash:bigint>>")))


def hashes(kept: Column) -> Column:
    """The distinct hashes of a fingerprint."""
    return F.array_distinct(F.transform(kept, lambda e: e["hash"]))


def as_string(kept: Column) -> Column:
    """A fingerprint written out, as ``[{position, hash}, ...]``."""
    return kept.cast("string")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of distinct hashes; 1 if both are empty."""
    common = F.size(F.array_intersect(a, b))
    return let(common, lambda n: F.when(F.size(a) + F.size(b) == 0, F.lit(1.0)).otherwise(
        n / (F.size(a) + F.size(b) - n).cast("double")))


def fingerprint_documents(df: DataFrame, text_col: str = "text", k: int = K, w: int = W) -> DataFrame:
    """``df`` with ``fingerprint``; a column of that name is replaced, other columns stay."""
    return df.withColumn("fingerprint", fingerprint(F.col(text_col), k, w))


def with_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, addition, next_hashes) of every row of ``docs``.

    The next document is the one that follows in descending order of ids, after the last the first;
    a single document follows itself. ``addition`` is as many code points of its start as a third of
    this text has (all if it has fewer), ``next_hashes`` its fingerprint. Null texts are empty. Rows
    that share an id are ordered by a hash of the text, rows equal in both are one document with
    the same neighbour; null ids come last. Other columns are not read.

    Ids and lengths are put in order first, by ranges; the texts are then shuffled once, and what a
    document hands to the one before it once more.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text")).select("id", F.xxhash64("text").alias("h"), "text")
    order = [F.col("id").desc_nulls_last(), F.col("h")]
    slim = dealt_in_order(rows.groupBy("id", "h").agg(F.max(F.length("text")).alias("n"), F.count(F.lit(1)).alias("copies")),
                          order, "order")
    repeated = bool(slim.filter("copies > 1").head(1))
    me, in_part = F.struct("id", "h", "n"), W_.partitionBy("__part").orderBy(*order)
    placed = slim.select("__part", me.alias("me"), F.lag(me).over(in_part).alias("before"), F.row_number().over(in_part).alias("at"))
    parts = W_.orderBy("__part")
    whole = parts.rowsBetween(W_.unboundedPreceding, W_.unboundedFollowing)
    ends = placed.groupBy("__part").agg(F.max_by("me", "at").alias("last")).select(
        "__part", F.coalesce(F.lag("last").over(parts), F.last("last").over(whole)).alias("ended"))
    to = F.coalesce("before", "ended")
    placed = placed.join(ends, "__part").select(
        F.col("me.id").alias("own_id"), F.col("me.h").alias("own_h"), to["id"].alias("to_id"), to["h"].alias("to_h"),
        div(to["n"], 3).cast("int").alias("take"))
    # Both joins read the rows dealt by id and h; they need the same columns, so one shuffle of the texts serves both.
    handed = rows.join(placed, F.col("id").eqNullSafe(F.col("own_id")) & (F.col("h") == F.col("own_h"))).select(
        "to_id", "to_h", F.substring("text", F.lit(1), F.col("take")).alias("addition"),
        hashes(fingerprint(F.col("text"))).alias("next_hashes"))
    if repeated:
        handed = handed.dropDuplicates(["to_id", "to_h"])
    return rows.join(handed, F.col("id").eqNullSafe(F.col("to_id")) & (F.col("h") == F.col("to_h"))).select(
        "id", "text", "addition", "next_hashes")
