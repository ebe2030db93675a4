"""URL filters with DataFrame functions only: rules, and a cascade of Bloom filters for listed hosts.

Level 0 of the cascade encodes the listed keys; level 1 the keys of the corpus that level 0 lets through wrongly; level 2
the listed keys that level 1 lets through; and so on until a level makes no mistakes. Over the complete universe of keys
that the corpus holds, plus the list, membership is then exact, and a page is judged by looking at a few bits: no join.

A filter is cut into shards of 2**13 bits by another hash of the key. Up to LITERAL_SHARDS of them are one array that goes
to every task. A larger filter stays a table with a row a shard: the corpus's distinct keys meet it shard by shard, and
pages the listed hosts. The bits, and so the answers, are the same either way.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.llm.common import cut, prepare

#: (rule, verdict): a host and a path prefix; the longest that fits wins.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: Listed hosts; each stands for its subdomains too.
LISTED = tuple(f"{name}.example.{top}" for name in ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm") for top in ("com", "net", "org"))
BITS_PER_KEY, HASHES = 10, 5
#: Bits of a shard, and the shards of the largest filter that goes to every task as an array (1 MiB).
SHARD_BITS, LITERAL_SHARDS = 1 << 13, 1 << 10
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, with A-Z lower-cased; empty without one."""
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path(url: Column) -> Column:
    """After the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_keys(name: Column) -> Column:
    """A host and its parent domains."""
    labels = F.split(name, "\\.")
    return F.when(name == "", F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")))


class Level:
    """One Bloom filter over ``number`` keys."""

    def __init__(self, keys: DataFrame, number: int, level: int):
        self.level, self.name = level, f"__level_{level}"
        wanted = BITS_PER_KEY * number
        self.shards = max(1, -(-wanted // SHARD_BITS))
        self.bits = SHARD_BITS if self.shards > 1 else max(64, -(-wanted // 64) * 64)
        self.literal = self.shards <= LITERAL_SHARDS
        placed = keys.select(self._shard(F.col("key")).alias("shard"), F.explode(self._places(F.col("key"))).alias("at"))
        words = placed.groupBy("shard", F.floor(F.col("at") / 64).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("ones"))
        shards = words.groupBy("shard").agg(F.map_from_entries(F.collect_list(F.struct("word", "ones"))).alias("ones"))
        none, each = F.lit(0).cast("long"), F.sequence(F.lit(0), F.lit(self.bits // 64 - 1))
        if self.literal:
            every = keys.sparkSession.range(self.shards).select(F.col("id").cast("int").alias("shard")).join(shards, "shard", "left")
            filled = every.select("shard", F.transform(each, lambda w: F.coalesce(F.try_element_at("ones", w), none)).alias("words"))
            self.words = cut(filled.agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("shard", "words"))), lambda r: r["words"])).alias("words")))
        else:
            self.words = cut(shards.select("shard", F.transform(each, lambda w: F.coalesce(F.try_element_at("ones", w), none)).alias("words")))

    def _shard(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key, F.lit(self.level), F.lit(-1)), F.lit(self.shards)).cast("int")

    def _places(self, key: Column) -> Column:
        return F.array(*(F.pmod(F.xxhash64(key, F.lit(self.level), F.lit(i)), F.lit(self.bits)) for i in range(HASHES)))

    def _all_set(self, key: Column, words: Column, first: Column) -> Column:
        return F.forall(self._places(key), lambda at: F.getbit(F.get(words, first + F.floor(at / 64).cast("int")), (at % 64).cast("int")) == 1)

    def passes(self, key: Column) -> Column:
        """Whether all of a key's bits are set; for rows of with_levels()."""
        return self._all_set(key, F.col(self.name), self._shard(key) * (self.bits // 64))

    def probed(self, keys: DataFrame, name: str) -> DataFrame:
        """Distinct keys with a column that tells whether they pass."""
        if self.literal:
            return with_levels(keys, [self]).withColumn(name, self.passes(F.col("key"))).drop(self.name)
        met = keys.join(self.words.select(F.col("shard").alias("__shard"), F.col("words").alias(self.name)), self._shard(F.col("key")) == F.col("__shard"), "left")
        return met.withColumn(name, F.coalesce(self._all_set(F.col("key"), F.col(self.name), F.lit(0)), F.lit(False))).drop("__shard", self.name)


def with_levels(df: DataFrame, levels: list[Level]) -> DataFrame:
    """``df`` with the words of each filter, a constant from a one-row subquery, as a column."""
    return df.withColumns({level.name: level.words.scalar() for level in levels})


class Cascade:
    """Exact membership of the keys in ``universe`` (column key) and ``listed`` (column key)."""

    def __init__(self, listed: DataFrame, universe: DataFrame):
        inside = cut(listed.select("key").where("key IS NOT NULL").distinct())
        outside = cut(universe.select("key").where("key IS NOT NULL").distinct().join(inside, "key", "left_anti"))
        self.levels: list[Level] = []
        number = inside.count()
        encoded, other = inside, outside
        while number:
            level = Level(encoded, number, len(self.levels))
            self.levels.append(level)
            wrong = cut(level.probed(other, "__passes").where("__passes").select("key"))
            encoded, other, number = wrong, encoded, wrong.count()

    @property
    def literal(self) -> bool:
        return all(level.literal for level in self.levels)

    def holds(self, key: Column) -> Column:
        """A key is listed if the first level that stops it is an odd one, or none does and their number is odd; for
        rows of with_levels()."""
        return reduce(lambda rest, level: level.passes(key) & ~rest, reversed(self.levels), F.lit(False))

    def listed(self, keys: DataFrame) -> DataFrame:
        """Those of distinct keys (column key) that are listed."""
        for level in self.levels:
            keys = level.probed(keys, f"__passes_{level.level}")
        holds = reduce(lambda rest, level: F.col(f"__passes_{level.level}") & ~rest, reversed(self.levels), F.lit(False))
        return keys.where(holds).select("key")


def rule_of(name: Column, where: Column, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, or nulls."""
    fitting = []
    for rule, verdict in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        domain, slash, prefix = rule.partition("/")
        fits = ((name == domain) | name.endswith(f".{domain}")) & where.startswith(slash + prefix)
        fitting.append((fits, rule, verdict))
    pick = lambda k: F.coalesce(*(F.when(f[0], F.lit(f[k])) for f in fitting), F.lit(None).cast("string"))
    return pick(1), pick(2)


def judge_urls(pages: DataFrame, listed: DataFrame, page_id: str = "page_id", url: str = "url", rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and listed (whether the host or a parent domain is) for every page.

    The verdict is the rule's, else block if listed, else allow. A null url, or one without ://, has an empty host and
    path, fits no rule and is allowed. Equal urls and repeated ids get a row each; an empty table gives none, an empty
    list blocks nothing. Other columns of ``pages``, whatever their names, are not read.
    """
    prepare(pages.sparkSession)
    parts = pages.select(F.col(page_id).alias("page_id"), host(F.col(url)).alias("host"), path(F.col(url)).alias("path"))
    universe = parts.select("host").distinct().select(F.explode(host_keys(F.col("host"))).alias("key"))
    cascade = Cascade(listed, universe)
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    if cascade.literal:
        found = with_levels(parts, cascade.levels).withColumn("listed", F.exists(host_keys(F.col("host")), cascade.holds))
    else:
        hosts = parts.select(F.col("host").alias("l_host")).distinct().select("l_host", F.explode(host_keys(F.col("l_host"))).alias("key"))
        met = hosts.join(cascade.listed(universe.distinct()), "key").select("l_host").distinct()
        found = parts.join(met, F.col("host") == F.col("l_host"), "left").withColumn("listed", F.col("l_host").isNotNull())
    judged = F.coalesce(verdict, F.when(F.col("listed"), "block").otherwise("allow"))
    return found.select("page_id", "host", "path", rule.alias("rule"), judged.alias("verdict"), "listed")
