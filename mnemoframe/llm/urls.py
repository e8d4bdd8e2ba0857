"""URL filter: host and path rules first, then a list of canonical URLs behind a blocked Bloom filter.

Everything is DataFrame code. The list becomes blocks of a Bloom filter: 256 bits in four longs, two bits set in each long. While all
blocks have at most FILTER_BYTES, they are one row, broadcast as an array in which each URL looks its block up, so that URLs aren't
shuffled for the filter; beyond it URLs are joined with their block, both sides salted. Only URLs whose bits are all set
go on to the exact hash join with the list, which removes false positives.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemoframe.llm.common import materialize

#: (verdict, host, path) of the standard rules.
RULES: tuple[tuple[str, str, str], ...] = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Query parameters that don't name a resource.
TRACKING = r"^(utm_[^=]*|ref|fbclid|gclid)(=|$)"
#: More rules than this belong in a table, not in an expression.
MAX_RULES = 1000
#: Of a filter that is broadcast: some 8 million URLs at 16 bits each.
FILTER_BYTES = 16 << 20
#: Listed URLs up to which the exact join broadcasts them.
BROADCAST_URLS = 50_000
#: Parts that a block's URLs are dealt to where blocks are joined by a shuffle, as one URL may be a third of all rows.
SALT = 16
BITS_PER_URL = 16


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    raw = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without ``www.``, path without closing slashes, sorted query without tracking parameters; no fragment.

    Empty if the URL is null or has no host.
    """
    host = F.regexp_replace(host_of(url), r"^www\.", "")
    path = F.regexp_replace(path_of(url), r"/+$", "")
    params = F.split(F.coalesce(F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1), F.lit("")), "&")
    query = F.array_join(F.array_sort(F.filter(params, lambda x: (x != "") & ~x.rlike(TRACKING))), "&")
    whole = F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))
    return F.when(host == "", F.lit("")).otherwise(whole)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule whose host is the URL's or a parent of it and whose path begins the URL's."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules")
    if not rules:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    found, verdicts = [], []
    for verdict, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        found.append(F.when(fits, F.lit(h + p)))
        verdicts.append(F.when(fits, F.lit(verdict)))
    return F.coalesce(*found), F.coalesce(*verdicts)


def _bits(h: Column) -> list[Column]:
    """Four longs with two bits each, taken from a hash."""
    bit = lambda k: F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftrightunsigned(h, k).bitwiseAND(63).cast("int"))
    return [bit(12 * i).bitwiseOR(bit(12 * i + 6)) for i in range(4)]


def _block(url: Column, n_blocks: int) -> Column:
    return F.pmod(F.xxhash64(F.lit("block"), url), F.lit(n_blocks))


def _hash(url: Column) -> Column:
    return F.xxhash64(url, F.lit("bits"))


def bloom_blocks(listed: DataFrame, n_blocks: int) -> DataFrame:
    """(block, m0..m3) of the values of column u; blocks without any are left out."""
    keyed = listed.select(_block(F.col("u"), n_blocks).alias("block"), *[b.alias(f"b{i}") for i, b in enumerate(_bits(_hash(F.col("u"))))])
    return keyed.groupBy("block").agg(*[F.bit_or(f"b{i}").alias(f"m{i}") for i in range(4)])


def possible(rows: DataFrame, listed: DataFrame, count: int, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """``rows`` with possible: whether the URL in column u may be one of the ``count`` listed ones. A null u isn't."""
    n_blocks = max(1, -(-count * BITS_PER_URL // 256))
    blocks = bloom_blocks(listed, n_blocks)
    bits = _bits(_hash(F.col("u")))
    if n_blocks * 32 <= filter_bytes:
        every = listed.sparkSession.range(n_blocks).withColumnRenamed("id", "block").join(blocks, "block", "left")
        longs = F.struct("block", F.array(*[F.coalesce(f"m{i}", F.lit(0).cast("bigint")) for i in range(4)]).alias("m"))
        whole = every.agg(F.flatten(F.transform(F.array_sort(F.collect_list(longs)), lambda x: x["m"])).alias("_filter"))  # one row of at most filter_bytes
        at = (_block(F.col("u"), n_blocks) * 4).cast("int")
        inside = F.lit(True)
        for i in range(4):
            inside = inside & (F.get("_filter", at + i).bitwiseAND(bits[i]) == bits[i])
        return rows.crossJoin(F.broadcast(whole)).withColumn("possible", F.col("u").isNotNull() & inside).drop("_filter")
    own = rows.where("u is not null").withColumns({"block": _block(F.col("u"), n_blocks), "salt": F.pmod(F.monotonically_increasing_id(), F.lit(SALT)).cast("int")})
    salted = blocks.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    inside = F.lit(True)
    for i in range(4):
        inside = inside & (F.col(f"m{i}").bitwiseAND(bits[i]) == bits[i])
    found = own.join(salted, ["block", "salt"], "left").select(*rows.columns, F.coalesce(inside, F.lit(False)).alias("possible"))
    return found.unionByName(rows.where("u is null").withColumn("possible", F.lit(False)))


def filter_urls(
    urls: DataFrame, listed: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, url: str = "url", filter_bytes: int = FILTER_BYTES, broadcast_urls: int = BROADCAST_URLS
) -> DataFrame:
    """``urls`` with host, path, canonical_url, rule, verdict and listed.

    urls: any columns with a URL column; a column that has the name of a new one is replaced.
    listed: one column of canonical URLs; nulls, empty strings and repeats are ignored, and it may be empty.
    A rule's verdict wins; without a rule, listed URLs are blocked and others allowed. Of rules as long as each other that fit, the first
    by verdict, host and path wins. A null URL has empty host and path and is allowed. Every input row, repeated or not, gives one
    row; very long URLs are taken whole, and an empty table gives no rows.
    """
    new = ("host", "path", "canonical_url", "rule", "verdict", "listed")
    cols = [c for c in urls.columns if c not in new]
    names = materialize(listed.select(F.col(f"`{listed.columns[0]}`").alias("u")).where("u is not null and u <> ''").distinct(), "listed")
    count = names.count()
    rows = urls.select(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(cols)], F.lit(0).alias("none")).alias("r"), F.col(f"`{url}`").alias("url"))
    rows = rows.select("r", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.nullif(canonical(F.col("url")), F.lit("")).alias("u"))
    rows = possible(rows, names, count, filter_bytes)
    exact = names.select(F.col("u").alias("hit"))
    if count <= broadcast_urls:
        rows = rows.join(F.broadcast(exact), F.col("possible") & (F.col("u") == F.col("hit")), "left")
    else:  # what the filter has let through is joined by a shuffle, the others stay where they are
        rows = rows.where(~F.col("possible")).withColumn("hit", F.lit(None).cast("string")).unionByName(rows.where("possible").join(exact, F.col("u") == F.col("hit"), "left"))
    rule, ruled = rule_of(F.col("host"), F.col("path"), rules)
    verdict = F.coalesce(ruled, F.when(F.col("hit").isNotNull(), F.lit("block")).otherwise(F.lit("allow")))
    return rows.select(*[F.col(f"r.c{i}").alias(c) for i, c in enumerate(cols)], "host", "path", F.coalesce("u", F.lit("")).alias("canonical_url"), rule.alias("rule"), verdict.alias("verdict"), F.col("hit").isNotNull().alias("listed"))
