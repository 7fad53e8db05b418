"""URL filter: path rules first, then a listed-URL test by a blocked Bloom filter and an exact join.

The Bloom filter is a DataFrame of at most ``blocks`` rows of eight 64-bit words
(each key sets one bit in every word of its block), so the broadcast has a fixed
bound however long the list is. URLs that miss the filter are not listed; those
that hit go on to an exact hash join with the list, which removes false
positives. All of it is native DataFrame code.

Cases: a null url or one without ``://`` has empty host and path, fits no rule,
and is allowed; empty tables give empty results; repeated pages and repeated
listed URLs give one row for each page row; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER_CASE = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bits a block and blocks in a filter; 16384 blocks of 72 bytes are 1.2 MB when broadcast.
WORDS, BLOCKS = 8, 1 << 14
SALTS = 16


def _rest(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))


def split_url(df: DataFrame) -> DataFrame:
    """Adds host and path by the plain rule: no decoding, only A-Z of the host lower-cased."""
    rest = F.coalesce(_rest(F.col("url")), F.lit(""))
    return df.withColumns(
        {
            "host": F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER_CASE),
            "path": F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1),
        }
    )


def canonical(host: Column, path: Column) -> Column:
    """One form for the variants of a page: no www./m. label, no .html, no final slashes."""
    return F.concat(F.regexp_replace(host, r"^(www|m)\.", ""), F.regexp_replace(path, r"(\.html)?/*$", ""))


def _fits(host: Column, path: Column, rule: str) -> Column:
    name, slash, rest = rule.partition("/")
    return ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)


def first_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest rule that fits, as struct(rule, verdict); null if none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        out = F.when(_fits(host, path, rule), F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def _bits(key: Column) -> list[Column]:
    other = F.xxhash64(F.lit("b"), key)
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(other, 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(WORDS)]


def bloom_blocks(listed: DataFrame, key: str, blocks: int = BLOCKS) -> DataFrame:
    """The filter's blocks that have a bit set: (block, w0..w7)."""
    return (
        listed.where(F.col(key).isNotNull())
        .select(_block(F.col(key), blocks).alias("block"), *(b.alias(f"w{i}") for i, b in enumerate(_bits(F.col(key)))))
        .groupBy("block")
        .agg(*(F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)))
    )


def mark_possible(df: DataFrame, key: str, filter_blocks: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """Adds ``possible``: false means that the key is certainly not listed."""
    hit = F.col("w0").isNotNull()
    for i, bit in enumerate(_bits(F.col(key))):
        hit &= F.col(f"w{i}").bitwiseAND(bit) != 0
    out = df.withColumn("block", _block(F.col(key), blocks)).join(F.broadcast(filter_blocks), "block", "left")
    return out.withColumn("possible", F.coalesce(hit, F.lit(False))).drop("block", *(f"w{i}" for i in range(WORDS)))


def url_verdicts(pages: DataFrame, listed: DataFrame, rules: Sequence[tuple[str, str]], blocks: int = BLOCKS, salts: int = SALTS) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of pages(page_id, url).

    ``listed(url_key)`` has canonical URLs to block where no rule fits.
    """
    split = split_url(pages.select("page_id", "url"))
    ruled = split.withColumn("fit", first_rule(F.col("host"), F.col("path"), rules)).withColumn("url_key", canonical(F.col("host"), F.col("path")))
    marked = mark_possible(ruled, "url_key", bloom_blocks(listed, "url_key", blocks), blocks)
    wanted = F.col("possible") & F.col("fit").isNull()
    columns = ["page_id", "host", "path", F.col("fit.rule").alias("rule")]
    passed = marked.where(~wanted).select(*columns, F.coalesce("fit.verdict", F.lit("allow")).alias("verdict"))
    # A hot URL is spread over salts; the list, which has each URL once, is repeated for each.
    exact = listed.where(F.col("url_key").isNotNull()).distinct().withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).withColumn("is_listed", F.lit(True))
    checked = (
        marked.where(wanted)
        .withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(salts)).cast("int"))
        .join(exact, ["url_key", "salt"], "left")
        .select(*columns, F.when(F.col("is_listed"), "block").otherwise("allow").alias("verdict"))
    )
    return passed.unionByName(checked)


#: The rules of the contract, and host labels whose pages are listed.
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
BAD_LABELS = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")


def listed_urls(pages: DataFrame) -> DataFrame:
    """Canonical URLs of the pages on hosts with a bad label."""
    split = split_url(pages.select("url"))
    bad = F.arrays_overlap(F.split("host", r"\."), F.array(*map(F.lit, BAD_LABELS)))
    return split.where(bad).select(canonical(F.col("host"), F.col("path")).alias("url_key"))


def query(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return url_verdicts(pages, listed_urls(pages), RULES)


_SPLIT = """
split AS (
  SELECT page_id,
    translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substring(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages)
)"""

ORACLE = f"""
WITH {_SPLIT},
keyed AS (
  SELECT *, regexp_replace(host, '^(www|m)\\.', '') || regexp_replace(path, '(\\.html)?/*$', '') AS url_key,
    CASE
      WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
      WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
      WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
      WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
      WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/'
    END AS rule
  FROM split
),
listed AS (
  SELECT DISTINCT url_key FROM keyed
  WHERE list_has_any(string_split(host, '.'), ['ads-track', 'adult-x', 'casino-win', 'cheap-pills', 'free-bets', 'spam-farm'])
)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow'
       WHEN rule IS NOT NULL THEN 'block'
       WHEN url_key IN (SELECT url_key FROM listed) THEN 'block'
       ELSE 'allow' END AS verdict
FROM keyed
"""
