"""URL filters in DataFrame functions alone.

Rules come first: (host, path prefix) pairs with a verdict, the longest fitting
one wins.  For the other urls the verdict is that of the list: canonical forms
of the listed urls fill a blocked Bloom filter (one 64-bit block a key, six bits
in it), urls whose bits are all set are possible hits, and an exact join with
the list removes the false positives.  The filter comes in parts of at most
``PART_WORDS`` words, by range of the key's hash, each a scalar subquery, and grows with the list up
to ``MAX_PARTS`` of them; a still longer list fills it more densely, so more urls are
possible hits, with the same result.

Edge cases: a null url, or one without ``://``, has an empty host and path, fits
no rule and is on no list, so it is allowed; repeated rows are judged one by
one; repeated or null entries of the list count once or not at all; an empty
list blocks nothing; an empty table gives an empty result; columns named as those that are
added are replaced, any others stay as they are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 64-bit blocks of a part of the filter (8 MB), and most parts (64 MB in all).
PART_WORDS, MAX_PARTS = 1 << 20, 8
#: Bits of the filter for each listed key.
BITS_PER_KEY = 16
PROBES = 6


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return f"{self.host}{self.path}"


def _rest(url: Column) -> Column:
    """What follows the first ``://``; null if there is none."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def _fold(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host(url: Column) -> Column:
    return F.coalesce(_fold(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1)), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


#: Query parameters that name a campaign, not a page.
TRACKING = r"^(utm_[^=]*|ref|fbclid|gclid)(=.*)?$"


def canonical(url: Column) -> Column:
    """Host without ``www.`` and a default port, path without its last slash, the query without campaign parameters, in order; no scheme or fragment.  Null without a host."""
    name = F.regexp_replace(F.regexp_replace(host(url), r"^www\.", ""), r":(80|443)$", "")
    place = F.regexp_replace(path(url), r"/+$", "")
    query = F.regexp_extract(_rest(url), r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.rlike(TRACKING)))
    return F.when(host(url) != "", F.concat(name, place, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")))


def fitting_rule(name: Column, place: Column, rules: list[Rule]) -> Column:
    """The longest rule that fits, as its name; null if none does."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((name == rule.host) | F.endswith(name, F.lit(f".{rule.host}"))) & F.startswith(place, F.lit(rule.path))
        out = F.when(fits, F.lit(rule.name)).otherwise(out)
    return out


def _block_of(key: Column, words: int) -> Column:
    """The block of a key in a whole filter of that many words, a power of two."""
    return F.pmod(F.xxhash64(key), F.lit(words)).cast("int")


def _bits_of(key: Column) -> Column:
    """The bits of a key in its block, from a hash independent of the block's."""
    h = F.xxhash64(key, F.lit("bits"))
    out = F.lit(0).cast("long")
    for k in range(PROBES):
        place = F.shiftright(h, 6 * k).bitwiseAND(F.lit(63)).cast("int")
        out = out.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), place))
    return out


def bloom(keys: DataFrame, column: str, words: int, part: int = 0, parts: int = 1) -> DataFrame:
    """One row, one array of longs: a part of the filter's blocks in order, made by partial bit_or in the tasks."""
    size = words // parts
    filled = keys.select(_block_of(F.col(column), words).alias("block"), _bits_of(F.col(column)).alias("bits"))
    filled = filled.where(F.col("block").between(part * size, (part + 1) * size - 1)).groupBy("block").agg(F.bit_or("bits").alias("bits"))
    every = keys.sparkSession.range(part * size, (part + 1) * size).select(F.col("id").cast("int").alias("block")).join(filled, "block", "left")
    pairs = F.array_sort(F.collect_list(F.struct("block", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))))
    return every.agg(F.transform(pairs, lambda x: x["bits"]).alias("filter"))


def possible(key: Column, keys: DataFrame, column: str, words: int, parts: int) -> Column:
    """Whether the filter of ``keys`` has all bits of a key."""
    block, bits = _block_of(key, words), _bits_of(key)
    size = words // parts
    word = F.lit(None).cast("long")
    for part in range(parts):
        own = F.element_at(bloom(keys, column, words, part, parts).scalar(), F.pmod(block, F.lit(size)) + 1)
        word = own if parts == 1 else F.when(F.floor(block / size) == part, own).otherwise(word)
    return word.bitwiseAND(bits) == bits


def _free(name: str, taken: list[str]) -> str:
    while name in taken:
        name += "_"
    return name


def filter_urls(pages: DataFrame, listed: DataFrame, rules: list[Rule], url: str = "url", listed_url: str = "url", part_words: int = PART_WORDS, max_parts: int = MAX_PARTS) -> DataFrame:
    """All columns of ``pages`` followed by host, path, rule, listed and verdict (earlier ones of these names are replaced)."""
    names = ["host", "path", "rule", "listed", "verdict"]
    pages = pages.drop(*[x for x in names if x in pages.columns])
    own = pages.columns
    key, maybe, entry = (_free(x, own) for x in ("__key", "__maybe", "__listed"))
    keys = listed.select(canonical(F.col(listed_url)).alias(entry)).where(F.col(entry).isNotNull()).distinct()
    words = min(1 << max(6, (keys.count() * BITS_PER_KEY // 64).bit_length()), part_words * max_parts)
    parts = max(1, words // part_words)

    judged = pages.withColumns({"host": host(F.col(url)), "path": path(F.col(url)), key: canonical(F.col(url))})
    judged = judged.withColumn("rule", fitting_rule(F.col("host"), F.col("path"), rules))
    open_ = F.col("rule").isNull() & F.col(key).isNotNull()
    judged = judged.withColumn(maybe, F.coalesce(open_ & possible(F.col(key), keys, entry, words, parts), F.lit(False)))
    # possible hits alone meet the list; the rest never shuffles
    hits = judged.where(F.col(maybe)).join(keys, F.col(key) == F.col(entry), "left").withColumn("listed", F.col(entry).isNotNull())
    rest = judged.where(~F.col(maybe)).withColumn("listed", F.lit(False))
    verdict = F.lit(None).cast("string")
    for rule in rules:
        verdict = F.when(F.col("rule") == rule.name, F.lit(rule.verdict)).otherwise(verdict)
    verdict = F.coalesce(verdict, F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow")))
    columns = [*own, "host", "path", "rule", "listed"]
    return hits.select(*columns).union(rest.select(*columns)).withColumn("verdict", verdict)
