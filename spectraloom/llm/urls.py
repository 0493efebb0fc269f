"""Verdicts on urls by rules for hosts and paths, as a sort-merge range join.

A host's canonical key is its labels in reverse, each closed by a dot (``blog.example.net`` is
``net.example.blog.``), so a rule for a host and its subdomains is the interval of all keys that
begin with its own. Bounds sampled from the keys deal urls into ranges; a rule goes to every range
that its interval meets, which for a range's start are rules of ancestors of one host. Each task
sweeps one range in order of keys and keeps a stack of the nested hosts with rules that are open;
a url asks the hosts on the stack, no more than its labels, for their longest path that begins its own.

Sizes: a key that fills several bounds is a hot host; its urls are dealt over all of its ranges by
hash, and its rules go to each of them. The bounds are ``SAMPLES`` keys for each range, cut to
``KEY`` characters; they are all that the driver sees and broadcasts. Ranges follow the number of
urls, up to ``RANGES``. A task holds the rules of the open hosts, never a url besides the current batch.

Cases: a null url or one without ``://`` has empty host and path, and so meets only rules whose host
is empty; repeated rows and ids are judged each on its own; of rules with one host and path ``block``
wins; a rule's host may be given in any case; with no rules or no urls nothing fits; very long
urls are compared whole; columns are found by place, so others whose names differ in case only do no harm.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spectraloom.llm.common import arrow_schema, map_batches, pick, table

#: (host, path, verdict) of the registered query.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: The method's own verdict where no rule fits.
OTHERWISE = "allow"
#: Urls of a range, ranges at most, sampled keys for each range, characters of a sampled key.
URLS, RANGES, SAMPLES, KEY = 500_000, 8192, 40, 128

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def host_key(host: Column) -> Column:
    """Labels in reverse, each closed by a dot; of the empty host a dot."""
    return F.concat(F.concat_ws(".", F.reverse(F.split(host, r"\."))), F.lit("."))


def bounds_of(urls: DataFrame, ranges: int, rows: int) -> list[str]:
    """Starts of the ranges 1.. by key, from a sample of about SAMPLES keys a range."""
    if ranges < 2:
        return []
    share = min(1.0, SAMPLES * ranges / max(rows, 1))
    found = sorted(r[0] for r in urls.select(F.substring("key", 1, KEY)).sample(share, seed=7).collect())
    return [found[len(found) * k // ranges] for k in range(1, ranges)] if found else []


def dealt(urls: DataFrame, starts: list[str]) -> DataFrame:
    """Adds the range of each url: that of its key, or any of those that a hot key fills."""

    def setup():
        def ranges(columns):
            *rest, keys, draws = columns
            out = []
            for key, draw in zip(keys, draws):
                low, high = bisect_left(starts, key[:KEY]), bisect_right(starts, key[:KEY])
                out.append(low + 1 + int(draw * (high - low)) if high - low > 1 else high)
            return [*rest, keys, out]

        return ranges

    return map_batches(urls.withColumn("draw", F.rand(7)), "page_id long, host string, path string, key string, range int", setup, 4096)


def spread(rules: DataFrame, starts: list[str]) -> DataFrame:
    """A copy of each rule for every range that its interval meets."""

    def setup():
        def ranges(columns):
            low = [bisect_left(starts, key[:KEY]) for key in columns[0]]
            # "/" is the character after "." and so closes the interval of all keys that begin with this one
            high = [bisect_left(starts, key[:-1] + "/") for key in columns[0]]
            return [*columns, low, high]

        return ranges

    found = map_batches(rules, "key string, path string, label string, verdict string, first int, last int", setup, 4096)
    return found.select("key", "path", "label", "verdict", F.explode(F.sequence("first", "last")).alias("range"))


class Sweep:
    """The open hosts, each within the one before: key and, by length, {path: (label, verdict)}."""

    def __init__(self):
        self.stack: list[tuple[str, dict[int, dict]]] = []

    def close(self, key: str) -> None:
        while self.stack and not key.startswith(self.stack[-1][0]):
            self.stack.pop()

    def open(self, key: str, path: str, label: str, verdict: str) -> None:
        self.close(key)
        if not self.stack or self.stack[-1][0] != key:
            self.stack.append((key, {}))
        self.stack[-1][1].setdefault(len(path), {})[path] = label, verdict

    def judge(self, key: str, path: str) -> tuple[str | None, str]:
        """The rule of most characters that fits; of two as long, that of the longer host."""
        self.close(key)
        best, most = (None, OTHERWISE), -1
        for host, paths in reversed(self.stack):
            for n in sorted(paths, reverse=True):
                if len(host) + n <= most:
                    break
                if n <= len(path) and (found := paths[n].get(path[:n])):
                    best, most = found, len(host) + n
                    break
        return best


def judged(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict of urls (page_id, url) by rules (host, path, verdict)."""
    c = F.col
    host, path = host_and_path(c("url"))
    keyed = pick(urls, page_id="page_id", url="url").select(c("page_id").cast("long"), host.alias("host"), path.alias("path"))
    keyed = keyed.withColumn("key", host_key(c("host")))
    named = pick(rules, host="host", path="path", verdict="verdict")
    named = named.select(F.translate(F.coalesce("host", F.lit("")), _UPPER, _LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
    named = named.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    named = named.select(host_key(c("host")).alias("key"), "path", F.concat("host", "path").alias("label"), "verdict")

    rows = keyed.count()
    ranges = min(RANGES, max(int(urls.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows // URLS))
    starts = bounds_of(keyed, ranges, rows)
    both = spread(named, starts).select("range", "key", F.lit(0).alias("kind"), "path", "label", "verdict", F.lit(None).cast("long").alias("page_id"), F.lit(None).cast("string").alias("host"))
    none = F.lit(None).cast("string")
    both = both.union(dealt(keyed, starts).select("range", "key", F.lit(1), "path", none, none, "page_id", "host"))
    both = both.repartitionById(ranges, "range").sortWithinPartitions("range", "key", "kind")

    kind, schema = arrow_schema("page_id long, host string, path string, rule string, verdict string")

    def run(batches):
        sweep, now = Sweep(), None
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                out = []
                for number, key, kind, path, label, verdict, page_id, host in zip(*(x.to_pylist() for x in batch.slice(at, 2048).columns)):
                    if number != now:
                        sweep, now = Sweep(), number
                    if kind:
                        out.append((page_id, host, path, *sweep.judge(key, path)))
                    else:
                        sweep.open(key, path, label, verdict)
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*out), schema)], schema=schema)

    return both.mapInArrow(run, kind)


def op12_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages"), spark.createDataFrame(RULES, "host string, path string, verdict string"))


SQL = r"""
WITH cut AS (
  SELECT row_number() OVER () AS row, page_id,
    coalesce(CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END, '') AS rest FROM pages),
parts AS (
  SELECT row, page_id,
    translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
rules(rule_host, rule_path, verdict) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
best AS (
  SELECT p.row, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
    arg_max(verdict, length(rule_host || rule_path)) AS verdict
  FROM parts p JOIN rules r
    ON (p.host = rule_host OR ends_with(p.host, '.' || rule_host)) AND starts_with(p.path, rule_path)
  GROUP BY p.row)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN best USING (row)
"""
