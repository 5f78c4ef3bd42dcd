"""Item tokens f<feature>_<offset>#<symbol> and the patterns made of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"f\d+(?:_\d+)?#[^\s()]+"
PARTS = r"^f(\d+)(?:_(\d+))?#(.+)$"


def token(feature: Column, offset: Column | None, symbol: Column) -> Column:
    place = feature.cast("string") if offset is None else F.concat_ws("_", feature.cast("string"), offset.cast("string"))
    return F.concat(F.lit("f"), place, F.lit("#"), symbol)


def tokens_in(pattern: Column) -> Column:
    """All tokens in a pattern string, in order."""
    return F.regexp_extract_all(F.coalesce(pattern, F.lit("")), F.lit(TOKEN), 0)


def feature_of(item: Column) -> Column:
    return F.regexp_extract(item, PARTS, 1).try_cast("int")


def offset_of(item: Column) -> Column:
    """Null in the form without an offset."""
    return F.nullif(F.regexp_extract(item, PARTS, 2), F.lit("")).try_cast("int")


def symbol_of(item: Column) -> Column:
    return F.regexp_extract(item, PARTS, 3)


def split_item(item: Column) -> tuple[Column, Column, Column]:
    """Feature, offset and symbol by splitting at # and _; null where the item is malformed."""
    head, symbol = F.split_part(item, F.lit("#"), F.lit(1)), F.split_part(item, F.lit("#"), F.lit(2))
    feature, offset = F.split_part(head, F.lit("_"), F.lit(1)), F.split_part(head, F.lit("_"), F.lit(2))
    return F.substring(feature, 2, 1000).try_cast("int"), offset.try_cast("int"), F.nullif(symbol, F.lit(""))


def pattern_string(itemsets: Column) -> Column:
    """(a b) (c) from an array of arrays of tokens."""
    return F.array_join(F.transform(itemsets, lambda s: F.concat(F.lit("("), F.array_join(s, " "), F.lit(")"))), " ")


def miner_line(itemsets: Column, ids: Column, timed: bool = True) -> Column:
    """An input line of sequence miners: <t> i j -1 ... -2, with ids looked up in a map; sets without known items keep their tag."""
    number = lambda s: F.filter(F.transform(s, lambda x: F.element_at(ids, x).cast("string")), lambda v: v.isNotNull())
    one = lambda s, k: F.concat_ws(" ", F.concat(F.lit("<"), k.cast("string"), F.lit(">")) if timed else F.lit(None).cast("string"), F.array_join(number(s), " "), F.lit("-1"))
    return F.concat_ws(" ", F.array_join(F.transform(itemsets, one), " "), F.lit("-2"))


def parse_miner_line(line: Column) -> tuple[Column, Column, Column]:
    """Itemsets (arrays of ids), support and sorted sequence ids of an output line; what isn't a number is passed over."""
    body = F.split_part(line, F.lit("#SUP:"), F.lit(1))
    support = F.regexp_extract(line, r"#SUP:\s*(\d+)", 1).try_cast("int")
    sids = F.array_sort(F.array_distinct(F.filter(F.transform(F.split(F.regexp_extract(line, r"#SID:\s*(.*)$", 1), r"\s+"), lambda x: x.try_cast("int")), lambda v: v.isNotNull())))
    ended = F.split_part(body, F.lit("-2"), F.lit(1))
    sets = F.transform(F.split(ended, r"-1"), lambda s: F.filter(F.transform(F.split(F.btrim(s), r"\s+"), lambda x: x.try_cast("int")), lambda v: v.isNotNull()))
    return F.filter(sets, lambda s: F.size(s) > 0), support, sids
