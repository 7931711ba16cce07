"""URL filter: rules by host and path, then exact set membership by a cascade of Bloom filters.

The cascade encodes which hosts of the corpus are listed. Level 0 holds the listed hosts, level 1 those
other hosts of the corpus that level 0 lets through, level 2 the listed hosts that level 1 lets through,
and so on until no level errs. Over the corpus's complete set of hosts, for which it is built, the first
level that lacks a host tells exactly on which side it stands, so that urls are judged without a join.

The list is a table of hosts of any size; `hosts_with` draws one from the corpus, of the hosts that have one
of some labels. Levels are built by Spark (a bitwise or of 64-bit words, by word number) and sized to the
keys they hold. They are handed to all tasks only while they stay below MOST_BYTES altogether; larger lists
are looked up by a join instead, with equal results.

Defined results: a null url or one without :// has an empty host and path, no rule, and is allowed unless
the empty host is listed; listed hosts that no url has, nulls and repeated ones change nothing; repeated rows are judged each; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import durable

# The rules (verdict, host, path prefix) and the labels whose hosts the query lists.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
BLOCKED_LABELS = ("adult-x", "casino-win", "free-bets", "spam-farm")

BITS_A_KEY = 12
HASHES = 6
MOST_BYTES = 16 << 20
MOST_LEVELS = 24


def with_parts(pages: DataFrame) -> DataFrame:
    """(page_id, host, path) of each url."""
    after = F.when(F.instr("url", "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    rest = F.regexp_extract("after", r"^([^/?#]*)([^?#]*)", 1), F.regexp_extract("after", r"^([^/?#]*)([^?#]*)", 2)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return pages.select("page_id", F.coalesce(after, F.lit("")).alias("after")).select("page_id", F.translate(rest[0], upper, lower).alias("host"), rest[1].alias("path"))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """(rule, verdict) of the longest rule that fits, else null."""
    fits = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, name, prefix in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fit = ((host == name) | host.endswith("." + name)) & path.startswith(prefix)
        fits = F.when(fit, F.struct(F.lit(name + prefix).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(fits)
    return fits


def hosts_with(pages: DataFrame, labels=BLOCKED_LABELS) -> DataFrame:
    """(host): the distinct hosts of `pages` that have one of `labels` between their dots."""
    return with_parts(pages).select("host").filter(F.arrays_overlap(F.split("host", r"\."), F.array(*map(F.lit, labels)))).distinct()


def _places(key: Column, level: int, n_bits: int) -> list[Column]:
    """The bit numbers of a key at a level, each from a hash of its own."""
    return [F.pmod(F.xxhash64(key, F.lit(level * HASHES + i)), F.lit(n_bits).cast("long")) for i in range(HASHES)]


def _filter_of(keys: DataFrame, level: int, n_bits: int) -> DataFrame:
    """The level's bits as one row of 64-bit words. BITS_A_KEY bits a key leave the cluster, at most MOST_BYTES."""
    bits = keys.select(F.explode(F.array(*_places(F.col("host"), level, n_bits))).alias("bit"))
    words = bits.groupBy((F.col("bit") / 64).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("mask")).toArrow()
    packed = np.zeros(n_bits // 64, np.int64)
    packed[words["word"].to_numpy()] = words["mask"].to_numpy()
    return keys.sparkSession.createDataFrame(pa.table({f"level{level}": pa.ListArray.from_arrays(pa.array([0, len(packed)], pa.int32()), pa.array(packed))}))


def _passes(key: Column, level: int, words: Column, n_bits: int) -> Column:
    hit = F.lit(True)
    for place in _places(key, level, n_bits):
        hit &= F.get(words, (place / 64).cast("int")).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int"))) != 0
    return hit


class Cascade:
    """The levels of a cascade over a key universe `hosts` (host, listed), distinct hosts."""

    def __init__(self, hosts: DataFrame, most_bytes: int = MOST_BYTES) -> None:
        self.levels: list[tuple[int, DataFrame]] = []
        self.whole = True
        counts = {listed: n for listed, n in hosts.groupBy("listed").count().collect()}
        members, others = hosts.filter("listed").select("host"), hosts.filter("not listed").select("host")
        n, spent = counts.get(True, 0), 0
        while n and len(self.levels) < MOST_LEVELS:
            n_bits = -(-max(64, n * BITS_A_KEY) // 64) * 64
            spent += n_bits // 8
            if spent > most_bytes:
                self.whole = False
                return
            level = len(self.levels)
            frame = _filter_of(members, level, n_bits)
            self.levels.append((n_bits, frame))
            wrong = durable(others.crossJoin(F.broadcast(frame)).filter(_passes(F.col("host"), level, F.col(f"level{level}"), n_bits)).select("host"))
            members, others, n = wrong, members, wrong.count()
        self.whole = n == 0

    def listed(self, frame: DataFrame, host: str = "host") -> DataFrame:
        """`frame` with a boolean column listed."""
        answer = F.lit(len(self.levels) % 2 == 1)
        for level in reversed(range(len(self.levels))):
            n_bits, words = self.levels[level]
            frame = frame.crossJoin(F.broadcast(words))
            answer = F.when(~_passes(F.col(host), level, F.col(f"level{level}"), n_bits), F.lit(level % 2 == 1)).otherwise(answer)
        return frame.withColumn("listed", answer).drop(*(f"level{level}" for level in range(len(self.levels))))


def judge(pages: DataFrame, listed: DataFrame, rules=RULES, most_bytes: int = MOST_BYTES) -> DataFrame:
    """Per page: page_id, host, path, the rule that fits (else null) and the verdict; hosts of `listed` (host) are blocked."""
    parts = with_parts(pages)
    known = listed.select("host").filter("host is not null").distinct().withColumn("listed", F.lit(True))
    hosts = durable(parts.select("host").distinct().join(known, "host", "left").select("host", F.coalesce("listed", F.lit(False)).alias("listed")))
    cascade = Cascade(hosts, most_bytes)
    if cascade.whole:
        known = cascade.listed(parts)
    else:
        known = parts.join(hosts.filter("listed"), "host", "left").withColumn("listed", F.coalesce("listed", F.lit(False)))
    ruled = known.withColumn("found", rule_of(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce("found.verdict", F.when(F.col("listed"), "block").otherwise("allow"))
    return ruled.select("page_id", "host", "path", F.col("found.rule").alias("rule"), verdict.alias("verdict"))


ORACLE_SQL = """
with parts as (
  select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as after from pages),
split as (
  select page_id, translate(regexp_extract(after, '^([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(after, '^([^/?#]*)([^?#]*)', 2) as path from parts),
ruled as (
  select *, case
    when ('.' || host) like '%.example.org' and path like '/en/1%' then 'example.org/en/1'
    when ('.' || host) like '%.example.org' and path like '/es/%' then 'example.org/es/'
    when ('.' || host) like '%.com' and path like '/de/%' then 'com/de/'
    when ('.' || host) like '%.com' and path like '/fr/%' then 'com/fr/'
    when ('.' || host) like '%.org' and path like '/%' then 'org/' end as rule from split)
select page_id, host, path, rule, case
  when rule in ('org/', 'com/fr/') then 'allow'
  when rule is not null then 'block'
  when list_has_any(string_split(host, '.'), ['adult-x', 'casino-win', 'free-bets', 'spam-farm']) then 'block'
  else 'allow' end as verdict
from ruled
"""
