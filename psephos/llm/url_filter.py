"""URL filter: host and path rules, then a list of canonical URLs.

Listed URLs are held in a blocked Bloom filter: a URL's hash picks one block
of 512 bits, and eight further bits of hash pick bits within that block, so a
probe touches one cache line.  The filter is built by a Spark aggregate
(``bit_or`` per block word), has a fixed greatest size whatever the length of
the list, and is broadcast.  URLs that may be listed go to an exact join with
the list, which removes the false positives; a longer list means more of them,
never a wrong verdict.

Null URLs, and those without ``://``, have an empty host and path, meet no
rule and are not listed.  Repeated rows are judged alike.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from psephos.llm.common import ship

#: (verdict, host, path prefix); the longest host and path that fits decides.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
WORDS, HASHES = 8, 8  # 64-bit words in a block, bits set for each URL
BITS_PER_URL = 16
#: The filter's greatest size: 2**20 blocks of 64 bytes, 64 MB.
MOST_BLOCKS = 1 << 20
#: Query parameters that do not change the page.
TRACKING = r"^(utm_[a-z]+|ref|fbclid|gclid)="


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL column."""
    has = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    host = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.when(has, host).otherwise(F.lit("")), F.when(has, path).otherwise(F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest fitting rule (host followed by path) and its verdict; null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, at, prefix in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(prefix)
        rule = F.when(fits, F.lit(at + prefix)).otherwise(rule)
        verdict = F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def canonical(url: Column) -> Column:
    """One form for the addresses of a page: no scheme, ``www.`` or ``m.``, fragment,
    tracking parameters or closing slash; the other parameters in order.  Null without a host."""
    host, path = host_path(url)
    query = F.regexp_extract(url, r"(?s)^[^#?]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    page = F.regexp_replace(path, r"/+$", "")
    whole = F.concat(F.regexp_replace(host, r"^(www|m)\.", ""), page, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))
    return F.when(host != "", whole)


def _places(url: Column, blocks: int) -> tuple[Column, Column]:
    """Block number, and the hash that gives the bits."""
    return F.pmod(F.xxhash64(url), F.lit(blocks)).cast("int"), F.xxhash64(url, F.lit(1))


def build_filter(listed: DataFrame, url: str = "canonical", most_blocks: int = MOST_BLOCKS) -> np.ndarray:
    """The filter of the URLs in ``listed``: an array (blocks, 8) of 64-bit words."""
    n = listed.count()
    blocks = 1
    while blocks * 64 * WORDS < n * BITS_PER_URL and blocks < most_blocks:
        blocks *= 2
    block, bits = _places(F.col(url), blocks)
    bit = F.explode(F.sequence(F.lit(0), F.lit(HASHES - 1)))
    words = (
        listed.where(F.col(url).isNotNull())
        .select(block.alias("block"), bits.alias("h"), bit.alias("k"))
        .select("block", F.expr("cast(shiftright(h, k * 8) & 511 as int)").alias("bit"))
        .select("block", F.expr("cast(bit div 64 as int)").alias("word"), F.expr("shiftleft(1L, bit % 64)").alias("mask"))
        .groupBy("block", "word")
        .agg(F.expr("bit_or(mask)").alias("mask"))
    )
    # At most blocks * WORDS rows, 64 MB of words: the filter's own bound.
    out = np.zeros((blocks, WORDS), np.uint64)
    got = words.toArrow()
    out[got["block"].to_numpy(), got["word"].to_numpy()] = got["mask"].to_numpy().astype(np.uint64)
    return out


def may_be_listed(url: Column, bloom, blocks: int) -> Column:
    """False only for URLs that are not in the filter; ``bloom`` is a broadcast of it."""

    @F.arrow_udf("boolean")
    def probe(block: pa.Array, bits: pa.Array) -> pa.Array:
        words = bloom.value[block.to_numpy(zero_copy_only=False)]
        h = bits.to_numpy(zero_copy_only=False)
        hit = np.ones(len(h), bool)
        rows = np.arange(len(h))
        for k in range(HASHES):
            bit = (h >> (k * 8)) & 511
            hit &= (words[rows, bit >> 6] >> (bit & 63).astype(np.uint64)) & np.uint64(1) > 0
        return pa.array(hit)

    return probe(*_places(url, blocks))


def judge(pages: DataFrame, listed: DataFrame, url: str = "url", rules: Sequence[tuple[str, str, str]] = RULES, most_blocks: int = MOST_BLOCKS) -> DataFrame:
    """``pages`` with host, path, rule, canonical, may_be_listed, listed and verdict (columns of these names are replaced).

    ``listed`` has canonical URLs in its column ``canonical``.  The verdict
    is the rule's where one fits, else block for listed URLs and allow for the others.
    """
    spark = pages.sparkSession
    ship(spark)
    own = ("host", "path", "rule", "canonical", "may_be_listed", "listed", "verdict", "_rule_verdict")
    listed = listed.select("canonical").where(F.col("canonical").isNotNull()).distinct()
    bloom = build_filter(listed, most_blocks=most_blocks)
    blocks, sent = len(bloom), spark.sparkContext.broadcast(bloom)
    host, path = host_path(F.col(f"`{url}`"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    kept = [c for c in pages.columns if c not in own]
    rows = (
        pages.select(*[F.col(f"`{c}`") for c in kept], host.alias("host"), path.alias("path"), canonical(F.col(f"`{url}`")).alias("canonical"))
        .withColumns({"rule": rule, "_rule_verdict": verdict})
        .withColumn("may_be_listed", F.when(F.col("canonical").isNull(), False).otherwise(may_be_listed(F.coalesce("canonical", F.lit("")), sent, blocks)))
    )
    # Only possible hits meet the list.  The others get a key of their own, which no listed URL has (one begins
    # with its host, not with a slash), so the exchange spreads them over all tasks.
    own_key = F.concat(F.lit("/"), F.monotonically_increasing_id().cast("string"))
    rows = rows.withColumn("_key", F.when(F.col("may_be_listed"), F.col("canonical")).otherwise(own_key))
    joined = rows.join(listed.select(F.col("canonical").alias("_key"), F.lit(True).alias("listed")), "_key", "left")
    is_listed = F.coalesce(F.col("listed"), F.lit(False))
    return joined.withColumn("listed", is_listed).withColumn("verdict", F.coalesce("_rule_verdict", F.when(F.col("listed"), "block").otherwise("allow"))).drop("_key", "_rule_verdict")
