"""A Merkle manifest of a dataset: a tree for each group of rows, and one over the groups' roots.

Rows are hashed where they are read. Leaves are sorted by group and order over ranges, so every
range holds a run of consecutive leaves for each of its groups. From a summary of each range (first
and last group, their leaves, number of groups) follow the places of all leaves and the sizes of
all trees, so every node's number of children is known beforehand.

A forest maps (tree, level, index) to a digest for nodes whose run of siblings is not complete yet.
Joining two forests is the union of both, with each run that becomes complete replaced by its
parent, again and again: an associative operation whose result does not depend on how fragments
meet. Each range reduces its own leaves; ``treeReduce`` joins the fragments into one forest, which
is the root alone. What a range cannot resolve by itself are nodes at the edges of its groups'
runs, at most two a level and side, so a fragment has O(log n) nodes. Nodes that meet in a join are
remembered, as they are the siblings that proofs of leaves need from outside their range.

Sizes: ranges follow the number of rows up to ``RANGES``. At that many the driver and the broadcast hold
about 30 MB of what is remembered (some 25 digests a range were measured) and 75 MB of sampled keys
while ranges are cut; a task holds the leaves of its range, about 350 bytes each.
Groups that end within a range never leave it but as part of the tree over the groups.

Cases: null fields are ``-``; a null group is one of its own and comes first; rows without order come
first in their group; rows that repeat an order stand by their digest; a group of one row is its leaf,
a single group the root; numbers that do not fit after tampering grow a digit; an empty table gives
no rows; very long texts are hashed whole; columns are found by place, so others whose names differ in
case only do no harm.
"""

from __future__ import annotations

from contextlib import contextmanager
from functools import partial
from hashlib import sha256
from itertools import groupby

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spectraloom.llm.common import Tables, pick, table

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ARITY = 2
#: Leaves of a range, ranges at most, and keys of each (threefold) that Spark samples to cut them.
LEAVES, RANGES, SAMPLES = 250_000, 16_384, 10
#: The tree over the groups; those of the groups are numbered from 0.
TOP = -1


def H(digests) -> str:
    return sha256("".join(digests).encode()).hexdigest()


def encoded(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(fields: dict[str, Column]) -> Column:
    return F.sha2(F.concat(*map(encoded, fields.values())), 256)


def tampered(fields: dict[str, Column]) -> dict[str, Column]:
    """n_chars grows by one."""
    return fields | {"n_chars": (fields["n_chars"].cast("decimal(20,0)") + 1).cast("decimal(20,0)")}


def leaves(docs: DataFrame) -> DataFrame:
    """group, doc_id, leaf, and changed: the leaf after tampering where 7 divides the id's CRC, else null."""
    named = pick(docs, **{f: f for f in FIELDS})
    fields = {f: F.col(f) for f in FIELDS}
    hit = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 7 == 0
    return named.select(F.col("lang").alias("group"), "doc_id", leaf(fields).alias("leaf"), F.when(hit, leaf(tampered(fields))).alias("changed"))


def fold(digest: str, path) -> str:
    """The root from a leaf and the siblings before and after it, level by level."""
    for before, after in path:
        digest = H((*before, digest, *after))
    return digest


class Sizes:
    """How many nodes each level of each tree has, from the leaves of the trees that are asked for."""

    def __init__(self, counts: dict[int, int], arity: int = ARITY):
        self.arity, self.counts, self.levels = arity, counts, {}

    def of(self, tree: int) -> list[int]:
        if tree not in self.levels:
            sizes = [self.counts[tree]]
            while sizes[-1] > 1:
                sizes.append(-(-sizes[-1] // self.arity))
            self.levels[tree] = sizes
        return self.levels[tree]

    def siblings(self, tree: int, level: int, index: int) -> range:
        """The run of consecutive nodes that the node is one of."""
        first = index // self.arity * self.arity
        return range(first, min(first + self.arity, self.of(tree)[level]))


def join(forest: dict, fresh, sizes: Sizes, kept: dict) -> dict:
    """Adds nodes to a forest and replaces complete runs by their parents; the root of a group's tree
    is a leaf of the tree over the groups. ``kept`` takes every node that leaves the forest."""
    todo = list(fresh)
    while todo:
        (tree, level, index), digest = todo.pop()
        forest[tree, level, index] = digest
        if level == len(sizes.of(tree)) - 1:
            if tree != TOP:
                kept[tree, level, index] = forest.pop((tree, level, index))
                todo.append(((TOP, 0, tree), digest))
            continue
        run = [(tree, level, i) for i in sizes.siblings(tree, level, index)]
        if all(x in forest for x in run):
            members = {x: forest.pop(x) for x in run}
            kept |= members
            todo.append(((tree, level + 1, index // sizes.arity), H(members.values())))
    return forest


def merged(sizes: Sizes, one, other):
    """The sum of two fragments (forest, kept)."""
    kept = one[1] | other[1]
    return join(dict(one[0]), other[0].items(), sizes, kept), kept


def climb(tree: int, first: int, digests: list[str], sizes: Sizes) -> list[tuple[int, list[str]]]:
    """By level, the first index and the digests of the nodes whose leaves are all at hand."""
    found = []
    for n in sizes.of(tree):
        found.append((first, digests))
        end, a = first + len(digests), sizes.arity
        low, high = -(-first // a), (-(-end // a) if end == n else end // a)
        digests = [H(digests[k * a - first : (k + 1) * a - first]) for k in range(low, high)] if n > 1 else []
        first = low
        if not digests:
            break
    return found


class Range:
    """What a range holds: the nodes of its groups by level, and its own fragment."""

    def __init__(self, rows, start: tuple[int, int], sizes: Sizes):
        """start: number of the first group, and of its leaves in earlier ranges."""
        self.sizes, self.groups, rank, skip = sizes, [], *start
        forest: dict = {}
        self.kept: dict = {}
        for _, members in groupby(rows, lambda r: r[0]):
            members = [r[1:] for r in members]
            sizes.counts.setdefault(rank, len(members))
            levels = climb(rank, skip, [m[1] for m in members], sizes)
            self.groups.append((rank, skip, members, levels))
            for level, (first, digests) in enumerate(levels):
                if level + 1 < len(levels):
                    up, above = levels[level + 1]
                    ends = up * sizes.arity, (up + len(above)) * sizes.arity
                    open_ = [*range(first, ends[0]), *range(ends[1], first + len(digests))]
                else:
                    open_ = range(first, first + len(digests))
                join(forest, (((rank, level, i), digests[i - first]) for i in open_), sizes, self.kept)
            rank, skip = rank + 1, 0
        self.forest = forest

    def proofs(self, kept: dict):
        """(doc_id, leaf, changed, subroot, path) of every leaf, the path as (before, after) by level."""
        sizes = self.sizes
        for rank, skip, members, levels in self.groups:

            def node(tree, level, i, levels=levels, rank=rank):
                if tree == rank and level < len(levels) and 0 <= i - levels[level][0] < len(levels[level][1]):
                    return levels[level][1][i - levels[level][0]]
                return self.kept.get((tree, level, i)) or kept[tree, level, i]

            def path(tree, i, node=node):
                for level in range(len(sizes.of(tree)) - 1):
                    run = sizes.siblings(tree, level, i)
                    yield [node(tree, level, k) for k in run if k < i], [node(tree, level, k) for k in run if k > i]
                    i //= sizes.arity

            above, subroot = list(path(TOP, rank)), node(rank, len(sizes.of(rank)) - 1, 0)
            for i, (doc_id, digest, changed) in enumerate(members, skip):
                yield doc_id, digest, changed, subroot, [*path(rank, i), *above]


def summary(number: int, rows):
    """(range, (first group, its leaves), (last group, its leaves), groups), none of an empty range."""
    first = last = None
    groups = 0
    for group, members in groupby(rows, lambda r: r[0]):
        last = "-" if group is None else H([group]), sum(1 for _ in members)
        first, groups = first or last, groups + 1
    return [(number, first, last, groups)] if groups else []


def places(summaries) -> tuple[dict, dict]:
    """By range, the number of its first group and that group's leaves in earlier ranges; and the
    leaves of the groups at the ends of ranges, with the number of groups as those of TOP."""
    starts, counts, rank, now, before = {}, {}, -1, None, 0
    for number, (first, n_first), (last, n_last), groups in sorted(summaries):
        if first != now:
            rank, before = rank + 1, 0
        starts[number] = rank, before
        before += n_first
        counts[rank] = before
        if groups > 1:
            rank, before = rank + groups - 1, n_last
            counts[rank] = before
        now = last
    return starts, counts | {TOP: rank + 1}


@contextmanager
def sampling(spark: SparkSession, keys: int):
    """Range exchanges that are made meanwhile sample so many keys for each range."""
    name = "spark.sql.execution.rangeExchange.sampleSizePerPartition"
    old = spark.conf.get(name)
    spark.conf.set(name, keys)
    try:
        yield
    finally:
        spark.conf.set(name, old)


def manifest(docs: DataFrame, arity: int = ARITY) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row."""
    spark, context = docs.sparkSession, docs.sparkSession.sparkContext
    ddl = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    table_of_leaves = Tables(spark, "merkle").save(leaves(docs).withColumn("salt", F.rand(7)), "leaves")
    ranges = min(RANGES, max(int(spark.conf.get("spark.sql.shuffle.partitions")), table_of_leaves.count() // LEAVES))
    # by digest and salt, so that rows that repeat an id, or are repeated whole, can lie in many ranges
    ordered = table_of_leaves.repartitionByRange(ranges, "group", "doc_id", "leaf", "salt").sortWithinPartitions("group", "doc_id", "leaf")
    with sampling(spark, SAMPLES):
        ordered = ordered.select("group", "doc_id", "leaf", "changed").rdd

    starts, counts = places(ordered.mapPartitionsWithIndex(summary).collect())
    if not starts:
        return spark.createDataFrame([], ddl)
    given = context.broadcast((starts, counts))

    def held(number, rows) -> Range:
        starts, counts = given.value
        return Range(rows, starts.get(number, (0, 0)), Sizes(dict(counts), arity))

    fragments = ordered.mapPartitionsWithIndex(lambda number, rows: [(held(number, rows).forest, {})])
    forest, kept = fragments.treeReduce(partial(merged, Sizes(counts, arity)), 2 if ranges < 512 else 3)
    known = context.broadcast((*forest.values(), kept))

    def proved(number, rows):
        root, kept = known.value
        for doc_id, digest, changed, subroot, path in held(number, rows).proofs(kept):
            folded = fold(changed or digest, path)
            yield doc_id, digest, subroot, root, H(x for before, after in path for x in (*before, *after)), folded, folded == root

    return spark.createDataFrame(ordered.mapPartitionsWithIndex(proved), ddl, verifySchema=False)


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE crc_table AS (
  SELECT list(c ORDER BY i) AS entry FROM (
    SELECT i, list_reduce(list_prepend(CAST(i AS BIGINT), CAST(range(8) AS BIGINT[])),
      lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM range(256) AS r(i))),
docs AS (
  SELECT row_number() OVER () AS row, doc_id, lang, source, n_chars, text,
    xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
      lambda c, b: xor(c >> 8, entry[(xor(c, b) & 255) + 1]))) % 7 = 0 AS hit
  FROM documents, crc_table),
heads AS (
  SELECT *, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
    coalesce(strlen(text) || ':' || text, '-') AS tail
  FROM docs),
leaves AS (
  SELECT row, doc_id, lang,
    sha256(head || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || tail) AS leaf,
    CASE WHEN hit THEN sha256(head || coalesce(strlen(CAST(CAST(n_chars AS HUGEINT) + 1 AS VARCHAR)) || ':' || (CAST(n_chars AS HUGEINT) + 1), '-') || tail) END AS changed
  FROM heads),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY lang) AS n FROM leaves),
nodes AS (
  SELECT lang, 0 AS level, place, n, leaf AS digest FROM placed
  UNION ALL
  SELECT lang, level + 1, place // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY place)) FROM nodes WHERE n > 1 GROUP BY lang, level, place // 2, n),
walk AS (
  SELECT row, lang, 0 AS level, place, n, coalesce(changed, leaf) AS folded, '' AS proof FROM placed
  UNION ALL
  SELECT w.row, w.lang, w.level + 1, w.place // 2, (w.n + 1) // 2,
    sha256(CASE WHEN w.place % 2 = 0 THEN w.folded || coalesce(s.digest, '') ELSE s.digest || w.folded END), w.proof || coalesce(s.digest, '')
  FROM walk w LEFT JOIN nodes s ON s.lang IS NOT DISTINCT FROM w.lang AND s.level = w.level AND s.place = xor(w.place, 1)
  WHERE w.n > 1),
subroots AS (
  SELECT lang, digest AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place, count(*) OVER () AS n FROM nodes WHERE n = 1),
top_nodes AS (
  SELECT 0 AS level, place, n, subroot AS digest FROM subroots
  UNION ALL
  SELECT level + 1, place // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY place)) FROM top_nodes WHERE n > 1 GROUP BY level, place // 2, n),
top_walk AS (
  SELECT w.row, 0 AS level, s.place, s.n, w.folded, w.proof, s.subroot FROM walk w JOIN subroots s ON s.lang IS NOT DISTINCT FROM w.lang WHERE w.n = 1
  UNION ALL
  SELECT w.row, w.level + 1, w.place // 2, (w.n + 1) // 2,
    sha256(CASE WHEN w.place % 2 = 0 THEN w.folded || coalesce(s.digest, '') ELSE s.digest || w.folded END), w.proof || coalesce(s.digest, ''), w.subroot
  FROM top_walk w LEFT JOIN top_nodes s ON s.level = w.level AND s.place = xor(w.place, 1)
  WHERE w.n > 1)
SELECT l.doc_id, l.leaf, w.subroot, r.digest AS root, sha256(w.proof) AS proof_sha256, w.folded AS folded_root, w.folded = r.digest AS verified
FROM top_walk w JOIN leaves l USING (row), (SELECT digest FROM top_nodes WHERE n = 1) r
WHERE w.n = 1
"""
