"""URL filters with a cascade of Bloom filters.

A rule is a host with its subdomains and a path prefix. The keys of a url are all pairs of a suffix
of its host and a prefix of its path of a length that some rule has; a rule fits when it is one of
the keys. Whether a key is listed is asked of a cascade: level 1 holds the listed keys, level 2 the
keys of the corpus that level 1 takes for listed by mistake, level 3 the listed keys that level 2
takes for mistakes, and so on until a level makes none. Every level hashes anew, so that keys that
meet in one level part in the next. Over the corpus's keys the answer is exact, and no row is joined
with the list.
"""

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stopwise.llm import bloom
from stopwise.llm.tables import read
from stopwise.workspace import staged

HASHES = 4
# The rules of the query.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    # the first :// only: without a slash behind its host the path is empty
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)\z", 1)
    return F.regexp_extract(rest, r"(?s)^[^/?#]*(/[^?#]*)", 1)


def keys_of(host: Column, path: Column, lengths: list[int]) -> Column:
    """Array of structs (host, path): the suffixes of the host with the prefixes of the path."""
    labels = F.split(host, r"\.", -1)
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )
    ends = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length(path))
    return F.flatten(
        F.transform(
            suffixes,
            lambda h: F.transform(
                ends, lambda n: F.struct(h.alias("host"), F.substr(path, F.lit(1), n).alias("path"))
            ),
        )
    )


def key_text(host: Column, path: Column) -> Column:
    """Hosts hold no slash, so a space keeps both parts apart."""
    return F.concat(host, F.lit(" "), path)


class Cascade:
    """Levels of filters; ``listed`` is exact for every key of the universe it was built over."""

    def __init__(self):
        self.levels: list[tuple[int, int, np.ndarray]] = []  # salt, size and words of the filter

    def listed(self, hashes: np.ndarray) -> np.ndarray:
        """The first level that does not hold a key decides: an odd one says no, an even one yes."""
        answer = np.full(len(hashes), len(self.levels) % 2 == 1)
        open_ = np.arange(len(hashes))
        for level, (salt, size, words) in enumerate(self.levels):
            held = holds(salt, size, words, hashes[open_])
            answer[open_[~held]] = level % 2 == 1
            open_ = open_[held]
        return answer


def cells(salt: int, size: int, hashes: np.ndarray) -> list[np.ndarray]:
    """Cells of 64-bit hashes in a filter: the salted hash is mixed one to one, and its halves are hashed doubly."""
    # The steps of the splitmix64 generator.
    h = hashes.astype(np.uint64) + np.uint64((salt + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    a, b = h & np.uint64((1 << 31) - 1), (h >> np.uint64(33)) | np.uint64(1)
    return [(a + b * np.uint64(i)) & np.uint64(size - 1) for i in range(HASHES)]


def holds(salt: int, size: int, words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    held = np.ones(len(hashes), bool)
    for cell in cells(salt, size, hashes):
        held &= (words[cell >> np.uint64(6)] >> (cell & np.uint64(63))) & np.uint64(1) == 1
    return held


def filter_words(keys: DataFrame, salt: int, size: int) -> np.ndarray:
    """The filter of the keys in column ``h``, put together by Spark."""

    def run(frames):
        for frame in frames:
            yield pd.DataFrame({"cell": np.concatenate(cells(salt, size, frame["h"].to_numpy().view(np.uint64))).view(np.int64)})

    words = np.zeros(size // 64, np.uint64)
    for row in bloom.filter_pages(keys.select("h").mapInPandas(run, "cell long"), size).toLocalIterator():
        at = row["page"] * bloom.WORDS
        words[at : at + bloom.WORDS] = np.array(row["words"], np.int64).view(np.uint64)
    return words


def build_cascade(
    listed: DataFrame, universe: DataFrame, bits_per_key: int = 10, limit_bytes: int = 1 << 26, tries: int = 6
) -> Cascade:
    """Cascade over the 64-bit key hashes in column ``h`` of both tables (written, distinct).

    Every filter is put together by Spark and has at most ``limit_bytes`` bytes, the only data that
    reaches the driver. Keys of a level are found by testing, never by joins, except that the
    corpus's listed keys leave the universe once. A level must let through at most half of the keys
    it is asked for; one that does not is built again with another salt, ``tries`` times, and then
    the build fails, because the list is too long for ``limit_bytes``.
    """
    cascade = Cascade()
    inside, outside = listed, staged(universe.join(listed, "h", "left_anti"), "unlisted-keys")
    held, asked = inside.count(), outside.count()
    salt = failed = 0
    while held or not cascade.levels:
        size = bloom.size_for(held, bits_per_key, limit_bytes)
        words = filter_words(inside, salt, size)

        def wrong(frames, salt=salt, size=size, words=words):
            for frame in frames:
                yield frame[holds(salt, size, words, frame["h"].to_numpy().view(np.uint64))]

        mistaken = staged(outside.mapInPandas(wrong, "h long"), "mistaken-keys")
        count, salt = mistaken.count(), salt + 1
        if count > asked // 2:
            failed += 1
            if failed == tries:
                raise RuntimeError(f"{held} keys do not fit a filter of {limit_bytes} bytes: {count} of {asked} others pass it")
            continue
        failed = 0
        cascade.levels.append((salt - 1, size, words))
        inside, outside, held, asked = mistaken, inside, count, held
    return cascade


def judge_urls(
    pages: DataFrame, rules: DataFrame, default: str = "allow", url_column: str = "url"
) -> DataFrame:
    """Adds host, path, rule and verdict to every page; its other columns stay, columns
    of these names are replaced.

    ``rules`` has verdict (allow or block), host and path; the longest rule that fits wins. Rules
    given twice count once; of two contradicting verdicts for one rule block wins. A page whose url
    fits no rule is in no list and gets ``default``; so do null urls and urls without ``://``, whose
    host and path are empty. Empty tables give empty results.
    """
    rules = staged(
        rules.where("host IS NOT NULL AND path IS NOT NULL")
        .withColumn("host", F.lower("host"))
        .groupBy("host", "path")
        .agg(F.max("verdict").alias("verdict"))
        .select("verdict", F.xxhash64(key_text(F.col("host"), F.col("path"))).alias("h"), F.length("path").alias("n")),
        "rule-keys",
    )
    # as many as there are lengths of paths in the list
    lengths = sorted(r["n"] for r in rules.select("n").distinct().collect())
    url = F.col(url_column)
    named = pages.withColumn("host", host_of(url)).withColumn("path", path_of(url))
    keys = keys_of(F.col("host"), F.col("path"), lengths) if lengths else F.array().cast("array<struct<host:string,path:string>>")
    universe = (
        named.select(F.explode(keys).alias("k"))
        .select(F.xxhash64(key_text(F.col("k.host"), F.col("k.path"))).alias("h"))
        .distinct()
    )
    universe = staged(universe, "url-keys")
    cascades = {v: build_cascade(rules.where(F.col("verdict") == v).select("h"), universe) for v in ("allow", "block")}

    @F.pandas_udf("struct<rule:string,verdict:string>")
    def judge(hosts: pd.Series, paths: pd.Series) -> pd.DataFrame:
        texts, owners, sizes = [], [], []
        for row, (host, path) in enumerate(zip(hosts, paths)):
            labels = host.split(".")
            for i in range(len(labels)):
                suffix = ".".join(labels[i:])
                for n in lengths:
                    if n <= len(path):
                        texts.append((suffix, path[:n]))
                        owners.append(row)
                        sizes.append((len(suffix) + n, len(suffix)))
        hashes = np.array(
            [xxhash.xxh64_intdigest(f"{h} {p}", 42) for h, p in texts], np.uint64
        )
        best = [(-1, -1)] * len(hosts)
        rule: list[str | None] = [None] * len(hosts)
        verdict = [default] * len(hosts)
        for name, cascade in cascades.items():
            for k in np.flatnonzero(cascade.listed(hashes)).tolist():
                row = owners[k]
                if sizes[k] > best[row]:
                    best[row], rule[row], verdict[row] = sizes[k], "".join(texts[k]), name
        return pd.DataFrame({"rule": rule, "verdict": verdict})

    judged = named.withColumn("_judged", judge("host", "path"))
    return judged.withColumn("rule", F.col("_judged.rule")).withColumn("verdict", F.col("_judged.verdict")).drop("_judged")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict")


OP5_SQL = r"""
WITH rules(v, h, p) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'),
  ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
w AS (  -- what follows the first ://
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest,
         row_number() OVER () AS ord
  FROM pages),
u AS (
  SELECT page_id, ord,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*(/[^?#]*)', 1) AS path
  FROM w),
m AS (
  SELECT u.ord, h || p AS rule, v,
         row_number() OVER (PARTITION BY u.ord ORDER BY length(h || p) DESC, length(h) DESC) AS k
  FROM u JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict
FROM u LEFT JOIN (SELECT * FROM m WHERE k = 1) m USING (ord)
"""
