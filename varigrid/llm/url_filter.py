"""URL filters: host and path rules, and a list of canonical URLs behind a blocked Bloom filter.

The filter is a table of 256-bit blocks. A URL sets, or asks for, one bit in each of the eight words of one block. Its size
is bounded, so it is broadcast; URLs that it passes go on to an exact hash join with the list, and false positives end there.
Everything is built from DataFrame functions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varigrid.llm.common import lower_ascii, store

#: Most blocks of the filter: 4 MB of bits.
MOST_BLOCKS = 1 << 17
_WORDS = range(8)


@dataclass(frozen=True)
class Rule:
    """Urls of a host and all its subdomains whose path starts so."""

    verdict: str
    host: str
    path: str


def host(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty without ``://``."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(host_: Column, path_: Column) -> Column:
    """One spelling for a page: no ``www.`` or ``m.`` host, no ``.html``, no slash at the end; null without a host."""
    return F.when(host_ != "", F.concat(F.regexp_replace(host_, r"^(www|m)\.", ""), F.regexp_replace(path_, r"(?s)(\.html)?/*$", "")))


def rule_of(rules: list[Rule], host_: Column, path_: Column) -> Column:
    """The longest rule that fits, as struct(rule, verdict); of equal lengths the first in code point order; else null."""
    ordered = sorted(rules, key=lambda r: (-len(r.host + r.path), r.host + r.path))
    fits = [F.when(((host_ == r.host) | host_.endswith("." + r.host)) & path_.startswith(r.path), F.struct(F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict"))) for r in ordered]
    return F.coalesce(*fits) if fits else F.lit(None).cast("struct<rule:string,verdict:string>")


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(F.lit("block"), key), F.lit(blocks))


def _bits(key: Column) -> list[Column]:
    h = F.xxhash64(F.lit("bits"), key)
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 5 * i).bitwiseAND(F.lit(31)).cast("int")) for i in _WORDS]


def bloom(keys: DataFrame, key: str, blocks: int) -> DataFrame:
    """The filter's blocks that hold a bit: block, w0 .. w7."""
    return keys.where(F.col(key).isNotNull()).select(_block(F.col(key), blocks).alias("block"), *(b.alias(f"w{i}") for i, b in enumerate(_bits(F.col(key))))).groupBy("block").agg(*(F.bit_or(f"w{i}").alias(f"w{i}") for i in _WORDS))


def blocks_for(n_keys: int, bits_per_key: int = 16) -> int:
    """Blocks of a filter for so many keys, up to ``MOST_BLOCKS``."""
    return min(MOST_BLOCKS, max(1, -(-n_keys * bits_per_key // 256)))


def ask(rows: DataFrame, key: str, keys: DataFrame, blocks: int) -> DataFrame:
    """``rows`` with ``possible``: whether the filter of the equally named column of ``keys`` passes the row; false for null keys.

    The filter's size is bounded by its blocks, so it is broadcast.
    """
    held = rows.select(F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("row"), _block(F.col(key), blocks).alias("block"))
    joined = held.join(F.broadcast(bloom(keys, key, blocks)), "block", "left")
    asked, passed = F.col(f"row.`{key}`"), F.lit(True)
    for i, bit in enumerate(_bits(asked)):
        passed &= F.coalesce(F.col(f"w{i}").bitwiseAND(bit) != 0, F.lit(False))
    return joined.select(*(F.col(f"row.`{c}`").alias(c) for c in rows.columns), (asked.isNotNull() & passed).alias("possible"))


def divide(rows: DataFrame, key: str, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that may have a ``key`` of ``keys`` (a stored table), and rows that have none; only the first need a join.

    The filter is sized by the number of keys, up to ``MOST_BLOCKS`` blocks; beyond that more rows pass without need.
    """
    asked = ask(rows, key, keys.select(key), blocks_for(keys.count()))
    return asked.where("possible").drop("possible"), asked.where("NOT possible").drop("possible")


def judge(pages: DataFrame, listed: DataFrame, rules: list[Rule], bits_per_key: int = 16) -> DataFrame:
    """Verdict, allow or block, of every row of ``pages`` (page_id, url).

    A rule that fits decides; else a url whose canonical spelling is in ``listed`` (canonical) is blocked and all others are allowed.
    Returns page_id, host, path, canonical, rule, possible (the filter passed it on), listed, verdict. A null url, or one without ``://``, has empty
    host and path, no canonical spelling, and is allowed. Rows that repeat are judged each; very long urls are judged whole; without pages
    there are no rows; other columns are ignored. Null and repeated entries of the list are ignored; an empty list blocks nothing. The filter has 256 bits for every 256 / bits_per_key listed urls up to ``MOST_BLOCKS`` blocks; a
    longer list only raises the share of rows that the exact join must look at.
    """
    listed = store(listed.select("canonical").where("canonical IS NOT NULL").distinct(), "listed")
    blocks = blocks_for(listed.count(), bits_per_key)
    rows = pages.select("page_id", "url").select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    rows = rows.withColumn("canonical", canonical(F.col("host"), F.col("path"))).withColumn("fit", rule_of(rules, F.col("host"), F.col("path")))
    rows = ask(rows, "canonical", listed, blocks)
    exact = listed.select(F.col("canonical").alias("canonical_"), F.lit(True).alias("hit")).hint("shuffle_hash")
    hits = rows.where("possible").join(exact, F.col("canonical") == F.col("canonical_"), "left").withColumn("listed", F.col("hit").isNotNull()).drop("canonical_", "hit")
    out = rows.where("NOT possible").withColumn("listed", F.lit(False)).unionByName(hits)
    verdict = F.coalesce("fit.verdict", F.when(F.col("listed"), "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "canonical", F.col("fit.rule").alias("rule"), "possible", "listed", verdict.alias("verdict"))
