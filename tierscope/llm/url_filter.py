"""URL rules by exact Bloom filter cascades, in native expressions only.

A rule is a host (with all its subdomains) and a path prefix. Every URL has few
candidate keys: its host's suffixes by the label counts that rules have, times
its path's prefixes by the lengths that rules have. Two cascades, for allowing
and for blocking rules, decide which candidates are listed:
level 1 encodes the listed keys; level 2 the keys of the corpus that level 1
takes for listed though they aren't; level 3 the listed keys that level 2 takes
for those; and so on until a level has no false positives. A key is listed if
the number of consecutive levels that hold it is odd. As the levels saw every
candidate key of the corpus, the answer is exact for all its rows.

Level 1 has a rate of r / (sqrt(2) u) for r listed keys among at most u candidate
keys, so about 0.7 r keys pass it wrongly and all levels are of the list's size,
however large the corpus is. The filters are literals in the expression, so the
corpus is never joined or shuffled. Literals are of bounded size: longer lists are
cut into slices by a hash of the key, each with cascades and a pass of its own.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierscope.llm import common

#: (verdict, host, path prefix)
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
#: Largest filter that goes into an expression; longer lists are cut into slices.
MAX_BITS = 1 << 26
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.substring_index(F.substring_index(F.substring_index(rest, "/", 1), "?", 1), "#", 1)
    path = F.substring_index(F.substring_index(F.substring(rest, F.length(host) + 1, F.length(rest)), "?", 1), "#", 1)
    return F.translate(host, UPPER, LOWER), path


class TooLong(Exception):
    """A level has more bits than a literal may have."""


class Level:
    """One Bloom filter: its words as a literal array and its hash functions."""

    def __init__(self, keys: DataFrame, n: int, number: int, rate: float, max_bits: int):
        self.bits = max(64, math.ceil(n * -math.log(rate) / math.log(2) ** 2 / 64) * 64)
        self.hashes = max(1, round(-math.log2(rate)))
        self.number = number
        if self.bits > max(64, max_bits):
            raise TooLong(self.bits)
        at = keys.select(F.explode(self._places(F.col("key"))).alias("at"))
        words = at.groupBy((F.col("at") / 64).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(at % 64 AS INT))")).alias("v"))
        found = dict(words.collect())  # bounded by max_bits / 64 words
        self.words = [found.get(i, 0) for i in range(self.bits // 64)]

    def _places(self, key: Column) -> Column:
        low = F.lit((1 << 31) - 1).cast("long")
        a = F.xxhash64(F.lit(2 * self.number), key).bitwiseAND(low)
        b = F.xxhash64(F.lit(2 * self.number + 1), key).bitwiseAND(low)
        return F.array(*[(a + b * i) % self.bits for i in range(self.hashes)])

    def holds(self, key: Column) -> Column:
        words = F.split(F.lit(",".join(map(str, self.words))), ",").cast("array<bigint>")
        return F.forall(self._places(key), lambda p: F.getbit(F.element_at(words, (p / 64).cast("int") + 1), (p % 64).cast("int")) == 1)


class Cascade:
    """Exact membership in a list for all keys of a universe; see ``cascades``."""

    def __init__(self):
        self.levels: list[Level] = []

    def member(self, key: Column) -> Column:
        out = F.lit(False)
        for level in reversed(self.levels):
            out = level.holds(key) & ~out
        return out


def cascades(lists: dict[str, DataFrame], universe: DataFrame, most_keys: int, max_bits: int = MAX_BITS, rate: float | None = None) -> dict[str, Cascade]:
    """A cascade for each of ``lists`` (key, distinct and written) over ``universe``
    (key; at most ``most_keys`` rows), which is read once."""
    sizes = {name: listed.count() for name, listed in lists.items()}
    out = {name: Cascade() for name in lists}
    for name, n in sizes.items():
        if n:
            first = rate or min(0.5, n / (math.sqrt(2) * max(n, most_keys)))
            out[name].levels.append(Level(lists[name], n, 0, first, max_bits))
    some = [name for name, n in sizes.items() if n]
    if not some:
        return out
    # only keys that a first level lets through are gathered from the corpus
    marked = universe.select("key", *[out[name].levels[0].holds(F.col("key")).alias(name) for name in some])
    any_ = F.lit(False)
    for name in some:
        any_ = any_ | F.col(name)
    passed = common.written(marked.where(any_).distinct(), "passed")
    for name in some:
        levels, outside = out[name].levels, lists[name]
        inside = common.written(passed.where(F.col(name)).select("key").join(outside, "key", "left_anti"), "inside")
        while n := inside.count():
            levels.append(Level(inside, n, len(levels), 0.5, max_bits))
            inside, outside = common.written(outside.where(levels[-1].holds(F.col("key"))), "inside"), inside
    return out


def _slice(key: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(-7), key), F.lit(n))


def _found(tests: dict[str, Cascade], i: int, n: int):
    """What a key of slice i of n says, as a function for ``transform``."""

    def found(k: Column) -> Column:
        verdict = F.when(tests["allow"].member(k), F.lit("allow")).when(tests["block"].member(k), F.lit("block"))
        return F.struct(F.length(k).alias("n"), k.alias("rule"), (verdict if n == 1 else F.when(_slice(k, n) == i, verdict)).alias("verdict"))

    return found


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] | DataFrame = RULES, max_bits: int = MAX_BITS) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of pages, repeated ones too.

    rules: (verdict, host, path prefix). The longest fitting rule decides; URLs
    that no rule fits are in no list and get ``allow``. Rules with the same host
    and path must not contradict. Null or malformed URLs have empty host and path.
    """
    spark = pages.sparkSession
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame(rules, "verdict string, host string, path string")
    key = F.concat("host", "path").alias("key")
    listed = common.written(rules.select("verdict", key, (F.size(F.split("host", r"\.", -1))).alias("labels"), F.length("path").alias("depth")).distinct(), "listed")
    # label counts of hosts and lengths of path prefixes: few, whatever the list
    forms = sorted((r["labels"], r["depth"]) for r in listed.select("labels", "depth").distinct().collect())
    host, path = host_path(F.col("url").cast("string"))
    best = "struct<n:int,rule:string,verdict:string>"
    rows = pages.select("page_id", host.alias("host"), path.alias("path"), F.lit(None).cast(best).alias("best"))
    keys = F.array_compact(F.array(*[F.when(F.length("path") >= d, F.concat(F.substring_index("host", ".", -n), F.substring("path", 1, d))) for n, d in forms] or [F.lit(None).cast("string")]))
    most_keys, slices, done = pages.count() * max(1, len(forms)), 1, 0

    while done < slices:
        mine = lambda df, k=done, n=slices: df if n == 1 else df.where(_slice(F.col("key"), n) == k)
        lists = {v: common.written(mine(listed.where(F.col("verdict") == v).select("key")).distinct(), "list") for v in ("allow", "block")}
        try:
            tests = cascades(lists, mine(rows.select(F.explode(F.array_distinct(keys)).alias("key"))), most_keys, max_bits)
        except TooLong:  # from the start, with twice as many slices
            slices, done = 2 * slices, 0
            rows = rows.withColumn("best", F.lit(None).cast(best))
            continue

        hits = F.filter(F.transform(F.array_distinct(keys), _found(tests, done, slices)), lambda x: x["verdict"].isNotNull())
        rows = rows.withColumn("best", F.array_max(F.array_compact(F.array("best", F.array_max(hits)))))
        done += 1
        if done < slices:
            rows = common.written(rows, "judged")
    return rows.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit("allow")).alias("verdict"))


_REST = "CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END"
JUDGE_SQL = f"""
WITH rules(verdict, h, p) AS (VALUES {", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)}),
a AS (SELECT row_number() OVER () AS i, page_id, {_REST} AS rest FROM pages),
b AS (SELECT i, page_id, rest, regexp_extract(rest, '^[^/?#]*') AS host FROM a),
c AS (SELECT i, page_id, translate(host, '{UPPER}', '{LOWER}') AS host, regexp_extract(substr(rest, length(host) + 1), '^[^?#]*') AS path FROM b),
d AS (SELECT i, max_by(struct_pack(rule := h || p, verdict := verdict), length(h || p)) AS best FROM c JOIN rules
      ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY i)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict FROM c LEFT JOIN d USING (i)
"""
