"""Which filter removes what: the filters of a corpus audited in every order of applying them.

Filters A to D look at a text alone, so all copies of a text share their verdicts. Filter E finds
texts that a smaller id has as well, by an RDD routed by fingerprint: a map task keeps chains, for
each xxhash the different full texts with the least id of each, and settles rows that are beaten
within it; one record for each different text travels to the partition of its fingerprint, where
the chains of all tasks meet and the rows of ids that are not the least are emitted. Texts are
compared whole, so equal fingerprints do no harm. Failure masks are then counted with
``combineByKey``, a vector of 32 masks by (rows, good, toxic) for each part, and 120 orders of
five steps are read off each vector.

Sizes: a chain holds ``HOLD`` bytes of texts at most in a map task; when it is full, texts met once
go and repeated ones stay, so a text held by a third of all rows travels once or a few times for
each of at most ``TASKS`` map tasks. Partitions of the routed side follow the bytes of all texts.
Vectors are small and merged in the map tasks; nothing comes to the driver but a sum of bytes.

Cases: a null text is empty, a null lang the part ''; a row without id neither fails E nor makes
others fail; rows that repeat an id and a text count each and do not beat each other, rows of one
id with different texts are judged apart; labels that repeat an id count if any of them does, and
null labels not at all; very long texts are compared whole; an empty table has no parts. Columns
are found by place, so others whose names differ in case only do no harm.
"""

from __future__ import annotations

import re
from itertools import permutations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectraloom.llm.common import pick, table

FILTERS = "ABCDE"
UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MARKS = re.compile(rb"[#$%&*|]")
#: Words under which A fails; per cent of distinct words under which B, of capitals over which C fails.
WORDS, DISTINCT, CAPITALS = 200, 50, 3
#: Bit of E in a mask; A to D have the lower ones.
COPY = 16
#: Bytes of texts in the chains of a map task, and of those in a partition of the routed side.
HOLD, PART = 64 << 20, 48 << 20
#: Map tasks at most: what a single text can send to one partition.
TASKS = 8192


def text_mask(text: str, raw: bytes) -> int:
    """Bits of the filters A to D that the text fails. ``bytes.split`` parts at \\x20 and \\x09-\\x0D."""
    words = raw.split()
    return (
        (len(words) < WORDS)
        | (100 * len(set(words)) < DISTINCT * len(words)) << 1
        | (100 * (len(raw) - len(raw.translate(None, UPPER))) > CAPITALS * len(text)) << 2
        | (MARKS.search(raw) is not None) << 3
    )


class Chains:
    """Fingerprint -> [[text, mask, least id, {part: rows of that id}, met again], ...]."""

    def __init__(self):
        self.at, self.held = {}, 0

    def meet(self, key: int, raw: bytes, mask: int, doc_id: int, parts: dict):
        """The (id, parts) that are not the least of their text for sure, or None."""
        chain = self.at.setdefault(key, [])
        for entry in chain:
            if entry[0] == raw:
                entry[4] = True
                if doc_id > entry[2]:
                    return doc_id, parts
                if doc_id < entry[2]:
                    beaten = entry[2], entry[3]
                    entry[2], entry[3] = doc_id, parts
                    return beaten
                for part, n in parts.items():
                    entry[3][part] = entry[3].get(part, 0) + n
                return None
        chain.append([raw, mask, doc_id, parts, False])
        self.held += len(raw) + 400
        return None

    def give(self, keep_met: bool):
        """Takes out and yields entries; with keep_met those met once since the last time only."""
        old, self.at, self.held = self.at, {}, 0
        for key, chain in old.items():
            for entry in chain:
                if keep_met and entry[4]:
                    self.at.setdefault(key, []).append([*entry[:4], False])
                    self.held += len(entry[0]) + 400
                else:
                    yield key, entry


def local_chains(rows):
    """From (doc_id, text, part): (key, (id, raw, mask, parts)) to be routed, or with no raw if settled."""
    chains = Chains()

    def settled(doc_id, mask, parts):
        return xxhash.xxh3_64_intdigest(str(doc_id)), (doc_id, None, mask, parts)

    def leave(keep_met=False):
        for key, (raw, mask, doc_id, parts, _) in chains.give(keep_met):
            yield key, (doc_id, raw, mask, parts)

    for doc_id, text, part in rows:
        raw = text.encode()
        mask = text_mask(text, raw)
        if doc_id is None:
            yield settled(doc_id, mask, {part: 1})
            continue
        beaten = chains.meet(xxhash.xxh3_64_intdigest(raw), raw, mask, doc_id, {part: 1})
        if beaten:
            yield settled(beaten[0], mask | COPY, beaten[1])
        elif chains.held > HOLD:
            yield from leave(keep_met=True)
            if chains.held > HOLD // 2:
                yield from leave()
    yield from leave()


def routed_chains(records):
    """Verdicts (doc_id, part, mask, n) of all that was routed to this partition."""
    chains = Chains()

    def told(doc_id, mask, parts):
        return ((doc_id, part, mask, n) for part, n in parts.items())

    for key, (doc_id, raw, mask, parts) in records:
        if raw is None:
            yield from told(doc_id, mask, parts)
        elif beaten := chains.meet(key, raw, mask, doc_id, parts):
            yield from told(beaten[0], mask | COPY, beaten[1])
    for _, (raw, mask, doc_id, parts, _) in chains.give(False):
        yield from told(doc_id, mask, parts)


def verdicts(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", part: str = "lang") -> DataFrame:
    """(doc_id, part, mask, n): n rows of that id and part that fail the filters of mask."""
    c = F.col
    named = pick(docs, doc_id=doc_id, text=text, part=part)
    named = named.select(c("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("part", F.lit("")).alias("part"))
    size = named.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    spark = docs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART))
    rows = named.rdd
    rows = rows.coalesce(TASKS) if rows.getNumPartitions() > TASKS else rows
    routed = rows.mapPartitions(local_chains).partitionBy(parts, lambda key: key).mapPartitions(routed_chains)
    return spark.createDataFrame(routed, "doc_id long, part string, mask int, n long", verifySchema=False)


def copies(docs: DataFrame, **columns) -> DataFrame:
    """Ids of rows whose text a smaller id has as well: one row for each of them."""
    found = verdicts(docs, **columns).where(F.col("mask").bitwiseAND(COPY) > 0)
    return found.select("doc_id", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).select("doc_id")


def labelled(found: DataFrame, labels: DataFrame) -> DataFrame:
    """Adds good and toxic (0 or 1) of the labels to verdicts."""
    marks = pick(labels, doc_id="doc_id", quality="quality", toxic="toxic").groupBy("doc_id")
    marks = marks.agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    return found.join(marks, "doc_id", "left").select("part", "mask", "n", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))


def _add(vector, row):
    _, mask, n, good, toxic = row
    vector[mask] += (n, n * good, n * toxic)
    return vector


def mask_counts(found: DataFrame):
    """(part, counts of 32 masks by rows, good rows, toxic rows), merged in the map tasks first."""
    parts = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    start = lambda row: _add(np.zeros((1 << len(FILTERS), 3), "int64"), row)
    return found.rdd.keyBy(lambda row: row[0]).combineByKey(start, _add, lambda a, b: a + b, parts)


def steps():
    """(order, step, filter, masks removed, masks kept, masks redundant) of every order."""
    masks = np.arange(1 << len(FILTERS))
    for order in permutations(range(len(FILTERS))):
        before = 0
        for k, f in enumerate(order):
            fails, gone = (masks >> f & 1).astype(bool), (masks & before) > 0
            before |= 1 << f
            yield "".join(FILTERS[i] for i in order), k + 1, f, fails & ~gone, (masks & before) == 0, fails & gone


def interactions(vectors):
    """Rows of the audit of each (part, counts)."""
    every = list(steps())
    removed, kept, redundant = (np.array([x[k] for x in every]).astype("int64") for k in (3, 4, 5))
    filters = np.array([x[2] for x in every])
    for part, counts in vectors:
        gone, left, more = removed @ counts, kept @ counts[:, 0], redundant @ counts[:, 0]
        alone = counts[1 << filters, 0]
        shares = np.bincount(filters, weights=gone[:, 0], minlength=len(FILTERS)) if gone[:, 0].sum() < 1 << 52 else np.array([sum(map(int, gone[filters == f, 0])) for f in range(len(FILTERS))], dtype=object)
        for k, (order, step, f, *_) in enumerate(every):
            yield part, order, step, int(left[k]), int(gone[k, 0]), int(more[k]), int(alone[k]), int(gone[k, 1]), int(gone[k, 2]), int(shares[f])


def audit(docs: DataFrame, labels: DataFrame, **columns) -> DataFrame:
    """A row for each part, order of filters and step of it."""
    rows = mask_counts(labelled(verdicts(docs, **columns), labels)).mapPartitions(interactions)
    ddl = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"
    return docs.sparkSession.createDataFrame(rows, ddl, verifySchema=False)


def op11_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


SQL = r"""
WITH RECURSIVE docs AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS part FROM documents),
worded AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS least FROM docs),
marks AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels GROUP BY doc_id),
masked AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    (CASE WHEN len(words) < 200 THEN 1 ELSE 0 END)
    + (CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END)
    + (CASE WHEN 100 * len(regexp_extract_all(text, '[A-Z]')) > 3 * length(text) THEN 4 ELSE 0 END)
    + (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END)
    + (CASE WHEN doc_id > least THEN 16 ELSE 0 END) AS mask
  FROM worded w LEFT JOIN marks m USING (doc_id)),
counts AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM masked GROUP BY part, mask),
orders AS (
  SELECT '' AS filter_order
  UNION ALL
  SELECT filter_order || letter FROM orders, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS letter)
  WHERE strpos(filter_order, letter) = 0),
steps AS (
  SELECT filter_order, step, 1 << (ascii(filter_order[step]) - 65) AS bit,
    list_sum(list_transform(range(1, step), lambda k: 1 << (ascii(filter_order[k]) - 65))) AS earlier
  FROM orders, (SELECT unnest(range(1, 6)) AS step) WHERE length(filter_order) = 5),
told AS (
  SELECT part, filter_order, CAST(step AS INTEGER) AS step, bit,
    sum(CASE WHEN mask & (bit | before) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN mask & bit > 0 AND mask & before = 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN mask & bit > 0 AND mask & before > 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN mask & bit > 0 AND mask & before = 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN mask & bit > 0 AND mask & before = 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM counts, (SELECT *, CAST(coalesce(earlier, 0) AS BIGINT) AS before FROM steps)
  GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
  CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM told
"""
