"""URL filters: host and path rules, and a list of canonical URLs behind a blocked Bloom filter.

The filter has one row per 512-bit block (eight 64-bit words) with one bit of
each word per listed URL. It has at most ``MAX_BLOCKS`` rows whatever the length
of the list, so it may be broadcast; a longer list only lets more URLs through
to the exact join, which decides.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchlake.llm.common import ascii_lower

MAX_BLOCKS = 1 << 18
BITS_PER_URL = 16
WORDS = 8

# (host, path, verdict); a rule fits its host and all subdomains, and paths that begin with its own.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]

_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or other URLs."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")))


def path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty for null or other URLs."""
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without ``www.`` or ``m.``, and path without ``.html`` and closing slashes; null where there is no host."""
    bare = F.regexp_replace(host(url), r"^(www|m)\.", "")
    return F.when(host(url) != "", F.concat(bare, F.regexp_replace(path(url), r"(\.html)?/*\z", "")))


def longest_rule(host_: Column, path_: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """(``rule``, ``verdict``) of the longest rule that fits, else null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host_ == h) | host_.endswith("." + h)) & path_.startswith(p)
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _block(key: Column, n_blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n_blocks)).cast("int")


def _bits(key: Column) -> list[Column]:
    """One bit in each word, from six bits each of a second hash."""
    second = F.xxhash64(F.lit(11), key)
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(second, 6 * k).bitwiseAND(63).cast("int")) for k in range(WORDS)]


def bloom_filter(listed: DataFrame, n_blocks: int) -> DataFrame:
    """Rows (``block``, ``w0`` .. ``w7``) of the blocks that hold a listed ``url``."""
    bits = listed.select(_block(F.col("url"), n_blocks).alias("block"), *[b.alias(f"w{k}") for k, b in enumerate(_bits(F.col("url")))])
    return bits.groupBy("block").agg(*[F.bit_or(f"w{k}").alias(f"w{k}") for k in range(WORDS)])


def blocks_for(n: int) -> int:
    """Blocks for ``n`` URLs at ``BITS_PER_URL``, a power of two, ``MAX_BLOCKS`` at most."""
    need = -(-n * BITS_PER_URL // (64 * WORDS))
    return min(1 << max(need - 1, 0).bit_length(), MAX_BLOCKS)


def judge(
    pages: DataFrame,
    listed: DataFrame,
    rules: Sequence[tuple[str, str, str]] = RULES,
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """Per row of ``pages``: id, ``host``, ``path``, ``rule``, ``verdict``, ``listed`` and ``maybe`` (passed the filter).

    The verdict is the longest fitting rule's; where none fits, ``block`` for
    a URL whose canonical form is in ``listed`` (column ``url``, canonical,
    nulls and repeats ignored), else ``allow``. A null URL, or one without
    ``://``, has an empty host and path and is in no list. Null ids and
    repeated rows stay; other columns are ignored, whatever their names.
    """
    known = listed.select("url").where(F.col("url").isNotNull()).distinct()
    n_blocks = blocks_for(known.count())
    bloom = bloom_filter(known, n_blocks)
    url = F.col(url_col)
    rows = pages.select(F.col(id_col).alias("_id"), host(url).alias("host"), path(url).alias("path"), canonical(url).alias("url"))
    rows = rows.withColumn("found", longest_rule(F.col("host"), F.col("path"), rules))
    rows = rows.withColumn("block", _block(F.col("url"), n_blocks)).join(F.broadcast(bloom), "block", "left")
    # A block without listed URLs has no row: its words are null, and the URL is not listed.
    passed = F.col("url").isNotNull()
    for k, bit in enumerate(_bits(F.col("url"))):
        passed = passed & F.coalesce(F.col(f"w{k}").bitwiseAND(bit) != 0, F.lit(False))
    rows = rows.select("_id", "host", "path", "url", "found", passed.alias("maybe"))
    out = rows.where(~F.col("maybe")).withColumn("listed", F.lit(False))
    exact = rows.where("maybe").join(known.withColumn("listed", F.lit(True)), "url", "left")
    exact = exact.select("_id", "host", "path", "url", "found", "maybe", F.coalesce("listed", F.lit(False)).alias("listed"))
    verdict = F.coalesce("found.verdict", F.when(F.col("listed"), "block").otherwise("allow"))
    return out.union(exact).select(
        F.col("_id").alias(id_col), "host", "path", F.col("found.rule").alias("rule"), verdict.alias("verdict"), "listed", "maybe"
    )
