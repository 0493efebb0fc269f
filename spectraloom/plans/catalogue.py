"""Queries over the driver's tables, by name, and SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectraloom.functions import chemistry, elements, isotopes, peptides, scoring, variants
from spectraloom.operators import assembly, envelopes, features, joins, merging, proteins, ranking, reports, rescoring
from spectraloom.sources import readers, sinks
from spectraloom.store import saved

QUERIES = {}
SQL = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


c = F.col
ITEM = ["l_orderkey", "l_linenumber"]


def rounded(x, places: int):
    """x rounded, small negative values to -0.0 as in SQL (``F.round`` gives 0.0)."""
    return F.when(F.round(x, places) == 0, x * 0.0).otherwise(F.round(x, places))


def matches(spark, sf_dir: str) -> DataFrame:
    """lineitem as candidate matches: orders are spectra, price the score, small quantities decoys."""
    return read(spark, sf_dir, "lineitem").withColumn("is_decoy", c("l_quantity") < 10)


@query("""SELECT l_orderkey, l_linenumber, p_partkey FROM part JOIN lineitem ON l_extendedprice BETWEEN p_retailprice - 0.5 AND p_retailprice + 0.5""")
def band_join(spark, sf_dir):
    pairs = joins.band_join(read(spark, sf_dir, "part"), read(spark, sf_dir, "lineitem"), "p_retailprice", "l_extendedprice", [(-0.5, 0.5)])
    return pairs.select(*ITEM, "p_partkey")


@query("""SELECT l_orderkey, l_linenumber, p_partkey FROM part JOIN lineitem ON
  l_extendedprice BETWEEN p_retailprice + (-1.003355 - 0.01) AND p_retailprice + (-1.003355 + 0.01)
  OR l_extendedprice BETWEEN p_retailprice + (0 - 0.01) AND p_retailprice + (0 + 0.01)
  OR l_extendedprice BETWEEN p_retailprice + (1.003355 - 0.01) AND p_retailprice + (1.003355 + 0.01)""")
def mass_window_join(spark, sf_dir):
    windows = joins.mass_windows([-1, 0, 1], 0.01)
    pairs = joins.band_join(read(spark, sf_dir, "part"), read(spark, sf_dir, "lineitem"), "p_retailprice", "l_extendedprice", windows)
    return pairs.select(*ITEM, "p_partkey")


@query("""WITH near AS (SELECT p_partkey, l_orderkey, l_linenumber, round(abs(l_extendedprice - p_retailprice), 6) AS gap,
  row_number() OVER (PARTITION BY p_partkey ORDER BY abs(l_extendedprice - p_retailprice), l_extendedprice, l_orderkey * 10 + l_linenumber) AS n
  FROM part JOIN lineitem ON l_extendedprice BETWEEN p_retailprice - 2.0 AND p_retailprice + 2.0 WHERE abs(l_extendedprice - p_retailprice) < 2.0)
SELECT p_partkey, l_orderkey, l_linenumber, gap FROM near WHERE n = 1""")
def nearest_join(spark, sf_dir):
    got = joins.nearest_join(read(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), read(spark, sf_dir, "lineitem").select(*ITEM, "l_extendedprice", "l_quantity"), "p_partkey", "p_retailprice", "l_extendedprice", 2.0, c("l_orderkey") * 10 + c("l_linenumber"))
    return got.select("p_partkey", *ITEM, F.round(F.abs(c("l_extendedprice") - c("p_retailprice")), 6).alias("gap"))


@query("""WITH near AS (SELECT p_partkey, l_orderkey, l_linenumber, l_quantity,
  row_number() OVER (PARTITION BY p_partkey ORDER BY -(l_quantity * 1e9 + l_orderkey * 10 + l_linenumber), l_extendedprice) AS n
  FROM part JOIN lineitem ON l_extendedprice BETWEEN p_retailprice - 2.0 AND p_retailprice + 2.0 WHERE abs(l_extendedprice - p_retailprice) < 2.0)
SELECT p_partkey, l_orderkey, l_linenumber, l_quantity FROM near WHERE n = 1""")
def best_in_tolerance(spark, sf_dir):
    order = c("l_quantity") * 1e9 + c("l_orderkey") * 10 + c("l_linenumber")
    got = joins.nearest_join(read(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), read(spark, sf_dir, "lineitem").select(*ITEM, "l_extendedprice", "l_quantity"), "p_partkey", "p_retailprice", "l_extendedprice", 2.0, order, "largest")
    return got.select("p_partkey", *ITEM, "l_quantity")


@query("""WITH v AS (SELECT o_orderkey AS k, o_totalprice AS p FROM orders WHERE o_orderstatus = 'F')
SELECT a.o_orderkey, max(v.k) AS found_at, arg_max(v.p, v.k) AS value FROM orders a JOIN v ON v.k BETWEEN a.o_orderkey - 2 AND a.o_orderkey GROUP BY a.o_orderkey""")
def back_off(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    right = o.select(c("o_orderkey").alias("k"), "o_orderstatus", "o_totalprice")
    return joins.back_off(o.select("o_orderkey"), right, "o_orderkey", "k", F.when(c("o_orderstatus") == "F", c("o_totalprice")))


CUT = """WITH m AS (SELECT *, l_quantity < 10 AS is_decoy {more} FROM lineitem),
counted AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {first} ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS f FROM m) WHERE f = 1 OR {all}),
run AS (SELECT *, sum(CASE WHEN is_decoy THEN 0 ELSE 1 END) OVER w AS t, sum(CASE WHEN is_decoy THEN 1 ELSE 0 END) OVER w AS d FROM counted
  WINDOW w AS ({by} ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber ROWS UNBOUNDED PRECEDING)),
cut AS (SELECT {cols} min(l_extendedprice) AS cut FROM run WHERE t > 0 AND d <= 0.1 * t {group})
SELECT {out} l_orderkey, l_linenumber, l_extendedprice FROM m JOIN cut ON {on} l_extendedprice >= cut"""
ORDER = ["l_orderkey", "l_linenumber"]


@query(CUT.format(more="", first="l_orderkey", all="true", by="", cols="", group="", out="", on=""))
def fdr_cutoff(spark, sf_dir):
    return ranking.fdr_cutoff(matches(spark, sf_dir), "l_extendedprice", "is_decoy", 0.1, ORDER).select(*ITEM, "l_extendedprice")


@query(CUT.format(more="", first="l_partkey", all="false", by="", cols="", group="", out="", on=""))
def fdr_cutoff_peptide(spark, sf_dir):
    return ranking.fdr_cutoff(matches(spark, sf_dir), "l_extendedprice", "is_decoy", 0.1, ORDER, first_of=["l_partkey"]).select(*ITEM, "l_extendedprice")


@query(CUT.format(more=", least(l_linenumber, 3) AS class", first="l_orderkey", all="true", by="PARTITION BY class", cols="class,", group="GROUP BY class", out="m.class,", on="m.class = cut.class AND"))
def charge_classes(spark, sf_dir):
    m = matches(spark, sf_dir).withColumn("class", F.least("l_linenumber", F.lit(3)))
    return ranking.fdr_cutoff(m, "l_extendedprice", "is_decoy", 0.1, ORDER, ["class"]).select("class", *ITEM, "l_extendedprice")


@query("""WITH sums AS (SELECT l_extendedprice AS s, sum(CASE WHEN l_quantity < 10 THEN 0 ELSE 1 END) AS t, sum(CASE WHEN l_quantity < 10 THEN 1 ELSE 0 END) AS d FROM lineitem GROUP BY 1),
r AS (SELECT s, sum(d) OVER w / greatest(sum(t) OVER w, 1) AS r FROM sums WINDOW w AS (ORDER BY s DESC ROWS UNBOUNDED PRECEDING)),
q AS (SELECT s, min(r) OVER (ORDER BY s ROWS UNBOUNDED PRECEDING) AS q FROM r)
SELECT l_orderkey, l_linenumber, round(q, 6) AS q_value FROM lineitem JOIN q ON s = l_extendedprice WHERE q <= 0.15""")
def q_values(spark, sf_dir):
    q = ranking.q_values(matches(spark, sf_dir), "l_extendedprice", "is_decoy").where("q_value <= 0.15")
    return q.select(*ITEM, F.round("q_value", 6).alias("q_value"))


@query("""SELECT l_orderkey, l_linenumber, l_extendedprice, n AS rank FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS n FROM lineitem) WHERE n <= 2""")
def top_k(spark, sf_dir):
    return ranking.top_k(read(spark, sf_dir, "lineitem"), ["l_orderkey"], [F.desc("l_extendedprice"), F.asc("l_linenumber")], 2).select(*ITEM, "l_extendedprice", "rank")


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey, l_suppkey) AS rank_l_extendedprice,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber, l_partkey, l_suppkey) AS rank_l_quantity,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_discount DESC, l_linenumber, l_partkey, l_suppkey) AS rank_l_discount FROM lineitem)
SELECT l_orderkey, l_linenumber, rank_l_extendedprice, rank_l_quantity, rank_l_discount FROM r WHERE least(rank_l_extendedprice, rank_l_quantity, rank_l_discount) <= 1""")
def rank_per_score(spark, sf_dir):
    scores = ["l_extendedprice", "l_quantity", "l_discount"]
    return ranking.rank_scores(read(spark, sf_dir, "lineitem"), ["l_orderkey"], scores, ["l_linenumber", "l_partkey", "l_suppkey"], 1).select(*ITEM, *(f"rank_{s}" for s in scores))


@query("""SELECT l_orderkey, l_linenumber, round(max(l_extendedprice) OVER (PARTITION BY l_orderkey) - l_extendedprice, 6) AS to_top,
  round(coalesce(l_extendedprice - lead(l_extendedprice) OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber), 0), 6) AS to_next FROM lineitem""")
def delta_scores(spark, sf_dir):
    d = read(spark, sf_dir, "lineitem")
    return d.select(*ITEM, F.round(ranking.delta_to_top(d, ["l_orderkey"], "l_extendedprice"), 6).alias("to_top"), F.round(ranking.delta_to_next(["l_orderkey"], "l_extendedprice", ["l_linenumber"]), 6).alias("to_next"))


@query("""WITH r AS (SELECT *, row_number() OVER w AS n, first_value(l_returnflag) OVER w AS f, first_value(l_quantity) OVER w AS q FROM lineitem
  WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_returnflag DESC, l_quantity, l_linenumber)),
u AS (SELECT l_orderkey, string_agg(DISTINCT s, ',' ORDER BY s) AS suppliers FROM (SELECT l_orderkey, CAST(l_suppkey AS VARCHAR) AS s FROM r WHERE l_returnflag = f AND l_quantity = q) GROUP BY 1)
SELECT r.l_orderkey, r.l_linenumber, u.suppliers FROM r JOIN u USING (l_orderkey) WHERE n = 1""")
def best_per_spectrum(spark, sf_dir):
    d = read(spark, sf_dir, "lineitem").withColumn("suppliers", F.array(c("l_suppkey").cast("string")))
    best = ranking.best_with_ties(d, ["l_orderkey"], [F.desc("l_returnflag"), F.asc("l_quantity"), F.asc("l_linenumber")], ["l_returnflag", "l_quantity"], "suppliers")
    return best.select(*ITEM, F.array_join("suppliers", ",").alias("suppliers"))


DIGEST = r"""WITH s AS (SELECT doc_id, regexp_replace(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), '[^ACDEFGHIJKLMNPQRSTVWY]', '', 'g') AS s FROM documents),
p AS (SELECT doc_id, string_split(regexp_replace(regexp_replace(s, '^M', ''), '([KR])', '\1|', 'g'), '|') AS raw FROM s),
q AS (SELECT doc_id, list_filter(raw, lambda x: x <> '') AS p FROM p),
i AS (SELECT doc_id, p, unnest(range(len(p))) AS first_piece FROM q),
m AS (SELECT doc_id, p, first_piece, unnest([0, 1, 2]) AS missed FROM i)
SELECT doc_id, CAST(first_piece AS INTEGER) AS first_piece, CAST(missed AS INTEGER) AS missed, array_to_string(p[first_piece + 1 : first_piece + missed + 1], '') AS peptide
FROM m WHERE first_piece + missed < len(p) AND len(array_to_string(p[first_piece + 1 : first_piece + missed + 1], '')) BETWEEN 7 AND 60"""


def sequences(spark, sf_dir: str) -> DataFrame:
    """Texts as sequences: ASCII letters in upper case that are residues."""
    d = read(spark, sf_dir, "documents")
    return d.select("doc_id", peptides.clean(F.upper(F.regexp_replace("text", "[^A-Za-z]", ""))).alias("sequence"))


@query(DIGEST)
def digest_fragments(spark, sf_dir):
    return peptides.digest(sequences(spark, sf_dir), "sequence").select("doc_id", "first_piece", "missed", "peptide")


@query(r"""SELECT 'Decoy_' || CAST(doc_id AS VARCHAR) AS protein, reverse(regexp_replace(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), '[^ACDEFGHIJKLMNPQRSTVWY]', '', 'g')) AS sequence FROM documents
UNION ALL SELECT CAST(doc_id AS VARCHAR), regexp_replace(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), '[^ACDEFGHIJKLMNPQRSTVWY]', '', 'g') FROM documents""")
def target_and_decoy(spark, sf_dir):
    s = sequences(spark, sf_dir).select(c("doc_id").cast("string").alias("protein"), "sequence")
    return s.union(peptides.decoys(s, "protein", "sequence"))


@query("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
p AS (SELECT vec_id, e, unnest(range(2 * len(e) - 1)) AS k FROM e),
q AS (SELECT vec_id, e, k, unnest(range(greatest(0, k - len(e) + 1), least(k, len(e) - 1) + 1)) AS i FROM p),
r AS (SELECT vec_id, k, sum(e[i + 1] * e[k - i + 1]) AS v FROM q GROUP BY 1, 2)
SELECT vec_id, list(round(v, 6) ORDER BY k) AS probs FROM r GROUP BY 1""")
def isotope_convolution(spark, sf_dir):
    e = F.transform("embedding", lambda x: x.cast("double"))
    return read(spark, sf_dir, "embeddings").select("vec_id", F.transform(isotopes.convolve(e, e), lambda x: rounded(x, 6)).alias("probs"))


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, l_extendedprice AS a, l_quantity * 700 AS b, (l_extendedprice - l_quantity * 700) % 1.003355::DOUBLE AS r FROM lineitem)
SELECT l_orderkey, l_linenumber, round(CASE WHEN r > 0.5016775 THEN r - 1.003355::DOUBLE WHEN r < -0.5016775 THEN r + 1.003355::DOUBLE ELSE r END, 5) AS error,
  CAST(round(abs(a - b) / 1.003355::DOUBLE) AS INTEGER) AS shift FROM r""")
def mass_fold(spark, sf_dir):
    b = c("l_quantity") * 700
    return read(spark, sf_dir, "lineitem").select(*ITEM, rounded(peptides.mass_error(c("l_extendedprice"), b), 5).alias("error"), peptides.window_shift(c("l_extendedprice"), b).alias("shift"))


@query("""SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS o_orderkey, string_agg(o_orderpriority, ',' ORDER BY o_orderkey) AS o_orderpriority FROM orders GROUP BY 1""")
def protein_concat(spark, sf_dir):
    return proteins.concat_ordered(read(spark, sf_dir, "orders"), "o_custkey", ["o_orderkey"], ["o_orderkey", "o_orderpriority"])


@query("""WITH s AS (SELECT l_orderkey, list_sort(list(DISTINCT l_suppkey)) AS p FROM lineitem GROUP BY 1)
SELECT array_to_string(p, ',') AS peptides, count(*) AS n, min(l_orderkey) AS first FROM s GROUP BY 1""")
def identical_sets(spark, sf_dir):
    e = read(spark, sf_dir, "lineitem").select("l_orderkey", c("l_suppkey").alias("p"))
    m = proteins.merge_indistinguishable(e, "l_orderkey", "p")
    return m.select(F.array_join(F.transform("peptides", lambda x: x.cast("string")), ",").alias("peptides"), F.size("proteins").cast("long").alias("n"), c("proteins")[0].alias("first"))


@query("""WITH e AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem), n AS (SELECT l_partkey, count(*) AS n FROM e GROUP BY 1)
SELECT l_suppkey, CAST(sum(CASE WHEN n = 1 THEN 1 ELSE 0 END) AS BIGINT) AS unique_count, count(*) AS total_count, round(sum(1.0::DOUBLE / n), 6) AS balanced FROM e JOIN n USING (l_partkey) GROUP BY 1""")
def balanced_counts(spark, sf_dir):
    got = proteins.peptide_counts(read(spark, sf_dir, "lineitem"), "l_suppkey", "l_partkey")
    return got.withColumn("balanced", F.round("balanced", 6))


@query("""WITH k AS (SELECT l_suppkey, year(l_shipdate) AS run, count(*) AS n FROM lineitem GROUP BY 1, 2), s AS (SELECT run, sum(n) AS s FROM k GROUP BY 1)
SELECT l_suppkey, run, n, round(n * (SELECT avg(s) FROM s) / s, 2) AS normalised FROM k JOIN s USING (run)""")
def normalised_counts(spark, sf_dir):
    k = read(spark, sf_dir, "lineitem").groupBy("l_suppkey", F.year("l_shipdate").cast("long").alias("run")).agg(F.count("*").alias("n"))
    return proteins.normalised(k, "run", "n").select("l_suppkey", "run", "n", "normalised")


@query("""SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity < 10)""")
def decoy_anti(spark, sf_dir):
    seen = matches(spark, sf_dir).where("is_decoy").select(c("l_partkey").alias("p_partkey"))
    return read(spark, sf_dir, "part").join(seen, "p_partkey", "left_anti").select("p_partkey")


@query("""SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)""")
def semi_subset(spark, sf_dir):
    ids = read(spark, sf_dir, "lineitem").where("l_quantity > 49").select(c("l_partkey").alias("p_partkey"))
    return read(spark, sf_dir, "part").join(ids, "p_partkey", "left_semi").select("p_partkey", "p_name")


@query("""SELECT o_custkey, o_orderpriority, count(*) AS spectral_count, max(o_totalprice) AS best_score, string_agg(o_orderstatus || '[' || CAST(o_orderkey AS VARCHAR) || ']', ',' ORDER BY o_orderstatus, o_orderkey) AS psms, bool_or(o_orderstatus = 'F') AS any_target FROM orders GROUP BY 1, 2""")
def peptide_rollup(spark, sf_dir):
    got = reports.roll_up(read(spark, sf_dir, "orders"), ["o_custkey", "o_orderpriority"], "o_totalprice", "o_orderstatus", "o_orderkey", c("o_orderstatus") == "F")
    return got.withColumn("psms", F.array_join("psms", ","))


@query("""SELECT o_custkey AS c_custkey, count(*) FILTER (o_orderstatus = 'F') AS f_n, round(coalesce(sum(o_totalprice) FILTER (o_orderstatus = 'F'), 0), 2) AS f_total, count(*) FILTER (o_orderstatus = 'O') AS o_n FROM orders GROUP BY 1""")
def left_pivot(spark, sf_dir):
    o = read(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    wide = joins.left_pivot(o.select("c_custkey").distinct(), o, "c_custkey", "o_orderstatus", ["F", "O"], n=F.count(F.lit(1)), total=F.sum("o_totalprice"))
    zero = lambda x: F.coalesce(x, F.lit(0))
    return wide.select("c_custkey", zero(c("F_n")).alias("f_n"), F.round(F.coalesce("F_total", F.lit(0.0)), 2).alias("f_total"), zero(c("O_n")).alias("o_n"))


@query("""SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(string_split(source || ',' || lang || ',' || source, ',')) AS word FROM documents) GROUP BY 1, 2""")
def explode_list(spark, sf_dir):
    listed = F.concat(F.lit("{"), c("source"), F.lit(","), c("lang"), F.lit(", "), c("source"), F.lit("}"))
    return read(spark, sf_dir, "documents").select("doc_id", F.explode(peptides.names(listed)).alias("word")).groupBy("doc_id", "word").agg(F.count("*").alias("n"))


@query("""WITH s AS (SELECT l_orderkey, list_sort(list(DISTINCT l_linenumber)) AS a, list_sort(list(DISTINCT CAST(l_quantity AS INTEGER) % 7)) AS b FROM lineitem GROUP BY 1)
SELECT l_orderkey, len(list_filter(a, lambda x: NOT list_contains(b, x))) AS missing, len(list_distinct(list_concat(a, b))) AS united, len(list_filter(a, lambda x: NOT list_contains(b, x))) = 0 AS is_subset FROM s""")
def set_operations(spark, sf_dir):
    s = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_linenumber").alias("a"), F.collect_set(c("l_quantity").cast("int") % 7).alias("b"))
    missing, united = F.size(F.array_except("a", "b")).cast("long"), F.size(peptides.union_lists(c("a"), c("b"))).cast("long")
    return s.select("l_orderkey", missing.alias("missing"), united.alias("united"), peptides.is_subset(c("a"), c("b")).alias("is_subset"))


@query("""WITH m AS (SELECT l_suppkey, l_returnflag, string_agg(CAST(l_linenumber AS VARCHAR), ',' ORDER BY l_orderkey, l_linenumber, CAST(l_quantity AS VARCHAR)) AS peptides, string_agg(CAST(l_quantity AS VARCHAR), ',' ORDER BY l_orderkey, l_linenumber, CAST(l_quantity AS VARCHAR)) AS found FROM lineitem WHERE l_quantity >= 10 GROUP BY 1, 2)
SELECT CAST(s_suppkey AS VARCHAR) AS protein, s_name, a.peptides AS a_peptides, a.found AS a_abundances, r.peptides AS r_peptides, r.found AS r_abundances FROM supplier
LEFT JOIN m a ON a.l_suppkey = s_suppkey AND a.l_returnflag = 'A' LEFT JOIN m r ON r.l_suppkey = s_suppkey AND r.l_returnflag = 'R'""")
def proteins_with_matches(spark, sf_dir):
    """Suppliers as proteins, beside each the lines of two samples in the order of their scans."""
    d = matches(spark, sf_dir).select(
        F.when(c("is_decoy"), -1).otherwise(1).alias("Label"), c("l_returnflag").alias("SampleName"), F.concat(F.lit("["), c("l_linenumber").cast("string"), F.lit("]")).alias("Peptide"), F.concat(F.lit("{"), c("l_suppkey").cast("string"), F.lit("}")).alias("Proteins"),
        c("l_orderkey").alias("ScanNr"), c("l_linenumber").alias("PSMId"), c("l_quantity").alias("MS1IsotopicAbundances"), c("l_discount").alias("MS2IsotopicAbundances"), c("l_tax").alias("log10_precursorIntensities"),
    )
    known = read(spark, sf_dir, "supplier").select(c("s_suppkey").cast("string").alias("Protein"), "s_name")
    got = assembly.with_matches(known, d, ["A", "R"])
    return got.select(c("Protein").alias("protein"), "s_name", c("A_PeptideSequences").alias("a_peptides"), c("A_MS1IsotopicAbundances").alias("a_abundances"), c("R_PeptideSequences").alias("r_peptides"), c("R_MS1IsotopicAbundances").alias("r_abundances"))


@query("""WITH r AS (SELECT *, sum(l_extendedprice) OVER (PARTITION BY l_orderkey) AS total, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS n,
  sum(l_extendedprice) OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber ROWS UNBOUNDED PRECEDING) - l_extendedprice AS before FROM lineitem)
SELECT l_orderkey, l_linenumber FROM r WHERE before < 0.8 * total AND n <= 5""")
def intensity_cut(spark, sf_dir):
    return reports.neighbours_cut(read(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_extendedprice", ["l_linenumber"], 0.8, 5).select(*ITEM)


@query("""WITH m AS (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem), g AS (SELECT lo + k / 2.0::DOUBLE AS percentage FROM m, range(0, 200) t(k) WHERE lo + k / 2.0 <= hi)
SELECT percentage, 'N15_' || printf('%07.3f', percentage) || 'Pct' AS search_name,
  greatest(2, CAST(floor(5 * (1 - 2 * (percentage / 100 - 0.5) * (percentage / 100 - 0.5)) + 0.5) AS INTEGER)) AS half_width FROM g""")
def enrichment_grid(spark, sf_dir):
    """The grid between the least and the largest quantity."""
    lo, hi = read(spark, sf_dir, "lineitem").agg(F.min("l_quantity"), F.max("l_quantity")).first()
    return sinks.grid_table(spark, "N15", lo, hi, 0.5).select("percentage", "search_name", "half_width")


def _probabilities_sql(rounds: int) -> str:
    """The rounds of protein probabilities, one after the other."""
    out = ["WITH e AS (SELECT l_suppkey AS a, l_partkey AS b, max(0.5 + l_discount * 4) AS p FROM lineitem GROUP BY 1, 2)", "w0 AS (SELECT e.*, 1.0::DOUBLE / count(*) OVER (PARTITION BY b) AS w FROM e)"]
    for k in range(rounds):
        out.append(f"p{k} AS (SELECT a, 1 - product(1 - w * p) AS prob FROM w{k} GROUP BY a)")
        out.append(f"w{k + 1} AS (SELECT x.a, b, p, p{k}.prob AS prob, p{k}.prob / sum(p{k}.prob) OVER (PARTITION BY b) AS w FROM w{k} x JOIN p{k} ON x.a = p{k}.a)")
    out.append(f"n AS (SELECT *, count(*) OVER (PARTITION BY a) AS k FROM w{rounds})")
    out.append("r AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY round(prob, 6) DESC, k DESC, a) AS place FROM n)")
    return ", ".join(out) + " SELECT a AS l_suppkey, round(max(prob), 6) AS protein_probability, count(*) AS peptides, count(*) FILTER (place = 1) AS razor_peptides FROM r GROUP BY a"


@query(_probabilities_sql(3))
def protein_probabilities(spark, sf_dir):
    """Suppliers as proteins, parts as peptides: three rounds of probabilities, and razor peptides."""
    edges = read(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", (0.5 + c("l_discount") * 4).alias("p"))
    got = proteins.protein_probabilities(proteins.probabilities(edges, "l_suppkey", "l_partkey", "p", 0.0, 3), "l_suppkey")
    return got.withColumn("protein_probability", F.round("protein_probability", 6))


@query()
def parsimony(spark, sf_dir):
    """The orders of lineitem as proteins, its suppliers as peptides."""
    return proteins.parsimony(read(spark, sf_dir, "lineitem"), "l_orderkey", "l_suppkey", 2, 0)


@query("""SELECT year(l_shipdate) AS run, count(*) FILTER (l_quantity >= 10) AS targets, count(*) FILTER (l_quantity < 10) AS decoys,
  round(count(*) FILTER (l_quantity < 10) / count(*) FILTER (l_quantity >= 10) / 0.5::DOUBLE, 6) AS error_rate FROM lineitem GROUP BY 1 HAVING targets > 0 AND decoys > 0""")
def run_pairs(spark, sf_dir):
    """Runs that have targets and decoys, with how many, and the error rate that they tell."""
    d = matches(spark, sf_dir).withColumn("run", F.year("l_shipdate").cast("long"))
    got = merging.paired_runs(d.where("NOT is_decoy"), d.where("is_decoy"), "run")
    return got.withColumn("error_rate", F.round(reports.error_rate(c("decoys"), c("targets"), 0.5), 6))


@query("""WITH m AS (SELECT CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS search, * FROM lineitem),
b AS (SELECT l_orderkey, l_partkey, search, l_extendedprice, row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY l_extendedprice DESC, search, l_linenumber) AS n FROM m),
s AS (SELECT l_orderkey, l_partkey, string_agg(DISTINCT CAST(l_suppkey AS VARCHAR), ',' ORDER BY CAST(l_suppkey AS VARCHAR)) AS proteins FROM m GROUP BY 1, 2)
SELECT l_orderkey, l_partkey, CAST(search AS INTEGER) AS search, l_extendedprice, proteins FROM b JOIN s USING (l_orderkey, l_partkey) WHERE n = 1""")
def merged_searches(spark, sf_dir):
    """Three searches of the same spectra, and the best match of each peptide with the proteins of all."""
    d = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice", "l_returnflag", F.array(c("l_suppkey").cast("string")).alias("proteins"))
    every = merging.merged_runs([d.where(c("l_returnflag") == f) for f in "ANR"])
    best = merging.best_of_peptide(every, ["l_orderkey"], "l_partkey", "l_extendedprice", "proteins", ties=("search", "l_linenumber"))
    return best.select("l_orderkey", "l_partkey", "search", "l_extendedprice", F.array_join("proteins", ",").alias("proteins"))


@query("""WITH k AS (SELECT *, count(*) OVER (PARTITION BY l_orderkey, l_returnflag, l_linestatus) AS consensus FROM lineitem),
a AS (SELECT *, max(CASE WHEN consensus = 2 THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey, l_returnflag) AS agreed FROM k)
SELECT l_orderkey, l_linenumber, consensus, CAST(CASE WHEN greatest(3 - consensus, 0) = 2 AND agreed = 1 THEN 3 ELSE greatest(3 - consensus, 0) END AS INTEGER) AS local_rank FROM a""")
def consensus_count(spark, sf_dir):
    got = reports.consensus(read(spark, sf_dir, "lineitem"), "l_orderkey", "l_returnflag", "l_linestatus")
    return got.select(*ITEM, "consensus", "local_rank")


@query("""SELECT s_nationkey, count(*) AS n, round(avg(s_acctbal), 6) AS mean, round(stddev_pop(s_acctbal), 6) AS deviation, count(DISTINCT s_name) AS spectra FROM supplier GROUP BY 1 HAVING count(*) >= 3""")
def cluster_stats(spark, sf_dir):
    got = reports.cluster_summary(read(spark, sf_dir, "supplier"), ["s_nationkey"], "s_acctbal", ["s_name"], 3)
    return got.withColumns({"mean": F.round("mean", 6), "deviation": F.round("deviation", 6)})


@query("""WITH pairs AS (SELECT l_orderkey, l_linenumber, l_extendedprice, l_quantity, p_partkey FROM part JOIN lineitem ON l_extendedprice BETWEEN p_retailprice - 5 AND p_retailprice + 5),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS n FROM pairs) WHERE n = 1),
run AS (SELECT *, sum(CASE WHEN l_quantity < 2 THEN 0 ELSE 1 END) OVER w AS t, sum(CASE WHEN l_quantity < 2 THEN 1 ELSE 0 END) OVER w AS d FROM best
  WINDOW w AS (ORDER BY l_extendedprice DESC, p_partkey ROWS UNBOUNDED PRECEDING))
SELECT p_partkey, l_orderkey, l_linenumber FROM best WHERE l_extendedprice >= (SELECT min(l_extendedprice) FROM run WHERE t > 0 AND d <= 0.5 * t)""")
def search_slice(spark, sf_dir):
    """The best candidate of each part in a band, and error-rate cutoff."""
    part, items = read(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), read(spark, sf_dir, "lineitem").select(*ITEM, "l_extendedprice", "l_quantity")
    best = joins.best_in_band(part, items, "p_partkey", "p_retailprice", "l_extendedprice", [(-5.0, 5.0)], -c("l_extendedprice"), [F.asc(i) for i in ITEM])
    best = saved(best.withColumn("is_decoy", c("l_quantity") < 2))
    return ranking.fdr_cutoff(best, "l_extendedprice", "is_decoy", 0.5, ["p_partkey"]).select("p_partkey", *ITEM)


@query("""WITH p AS (SELECT p_partkey, regexp_replace(upper(p_name), '[^A-Z]', '', 'g') AS name FROM part),
spots AS (SELECT p_partkey, name, i, unnest(CASE WHEN contains('ST', substr(name, i, 1)) THEN ['~', '!'] WHEN contains('Y', substr(name, i, 1)) THEN ['~'] WHEN substr(name, i, 1) = 'M' THEN ['!'] ELSE [] END) AS s
  FROM (SELECT p_partkey, name, unnest(generate_series(1, length(name))) AS i FROM p))
SELECT p_partkey, name AS form FROM p UNION ALL
SELECT p_partkey, substr(name, 1, i) || s || substr(name, i + 1) FROM spots UNION ALL
SELECT a.p_partkey, substr(a.name, 1, a.i) || a.s || substr(a.name, a.i + 1, b.i - a.i) || b.s || substr(a.name, b.i + 1) FROM spots a JOIN spots b ON a.p_partkey = b.p_partkey AND a.i < b.i""")
def modified_forms(spark, sf_dir):
    name = F.regexp_replace(F.upper("p_name"), "[^A-Z]", "")
    return read(spark, sf_dir, "part").select("p_partkey", F.explode(variants.modified(name, {"~": "STY", "!": "STM"}, 2)).alias("form"))


@query()
def clusters_1d(spark, sf_dir):
    return rescoring.clusters(read(spark, sf_dir, "orders"), "o_orderpriority", "o_totalprice", 5.0)


def as_peptides(spark, sf_dir: str) -> DataFrame:
    """part names as peptides: letters that are residues, in upper case."""
    return read(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice", peptides.clean(F.upper("p_name"), "ACDEFGHIKLMNPQRSTVWY").alias("peptide"))


PEPTIDE = "regexp_replace(upper(p_name), '[^ACDEFGHIKLMNPQRSTVWY]', '', 'g')"


# Residues and ends by C, H, O, N, P, S, as SQL has them.
RESIDUES_SQL = """r(aa, c, h, o, n, p, s) AS (VALUES ('A', 3, 5, 1, 1, 0, 0), ('C', 5, 8, 2, 2, 0, 1), ('D', 4, 5, 3, 1, 0, 0), ('E', 5, 7, 3, 1, 0, 0),
  ('F', 9, 9, 1, 1, 0, 0), ('G', 2, 3, 1, 1, 0, 0), ('H', 6, 7, 1, 3, 0, 0), ('I', 6, 11, 1, 1, 0, 0), ('K', 6, 12, 1, 2, 0, 0), ('L', 6, 11, 1, 1, 0, 0),
  ('M', 5, 9, 1, 1, 0, 1), ('N', 4, 6, 2, 2, 0, 0), ('P', 5, 7, 1, 1, 0, 0), ('Q', 5, 8, 2, 2, 0, 0), ('R', 6, 12, 1, 4, 0, 0), ('S', 3, 5, 2, 1, 0, 0),
  ('T', 4, 7, 2, 1, 0, 0), ('V', 5, 9, 1, 1, 0, 0), ('W', 11, 10, 1, 2, 0, 0), ('Y', 9, 9, 2, 1, 0, 0), ('', 0, 2, 1, 0, 0, 0))"""
ATOMS_SQL = "CAST(sum(c) AS INTEGER) AS c, CAST(sum(h) AS INTEGER) AS h, CAST(sum(o) AS INTEGER) AS o, CAST(sum(n) AS INTEGER) AS n, CAST(sum(p) AS INTEGER) AS p, CAST(sum(s) AS INTEGER) AS s"
LIGHT_SQL = "(c * 12.0::DOUBLE + h * 1.007825::DOUBLE + o * 15.994915::DOUBLE + n * 14.003074::DOUBLE + p * 30.973762::DOUBLE + s * 31.972071::DOUBLE)"


@query(f"""WITH {RESIDUES_SQL}, a AS (SELECT p_partkey, {ATOMS_SQL} FROM (SELECT p_partkey, unnest(list_append(string_split({PEPTIDE}, ''), '')) AS aa FROM part) JOIN r USING (aa) GROUP BY 1),
w AS (SELECT *, {LIGHT_SQL} AS light,
  c * 0.0107::DOUBLE AS wc, h * 0.000115::DOUBLE AS wh, o * (0.00038::DOUBLE + 0.00205::DOUBLE) AS wo, n * 0.5::DOUBLE AS wn, s * (0.0076::DOUBLE + 0.0429::DOUBLE) AS ws FROM a),
m AS (SELECT *, (wc * (13.003355::DOUBLE - 12) + wh * (2.014102::DOUBLE - 1.007825::DOUBLE)
    + wo * (((16.999132::DOUBLE - 15.994915::DOUBLE) * 0.00038::DOUBLE + (17.999160::DOUBLE - 16.999132::DOUBLE) * 0.00205::DOUBLE) / (0.00038::DOUBLE + 0.00205::DOUBLE))
    + wn * (15.000109::DOUBLE - 14.003074::DOUBLE)
    + ws * (((32.971459::DOUBLE - 31.972071::DOUBLE) * 0.0076::DOUBLE + (33.967867::DOUBLE - 32.971459::DOUBLE) * 0.0429::DOUBLE) / (0.0076::DOUBLE + 0.0429::DOUBLE)))
  / (wc + wh + wo + wn + ws) AS neutron FROM w)
SELECT p_partkey, c, h, o, n, p, s, round(light, 4) AS lightest, round(light + floor(n * 0.5::DOUBLE + c * 0.0107::DOUBLE) * neutron, 4) AS enriched FROM m""")
def precursor_masses(spark, sf_dir):
    """Atoms of each peptide, its lightest mass and the one at half of the nitrogen enriched."""
    half = chemistry.REGULAR.labelled("N", 0.5)
    p = as_peptides(spark, sf_dir).withColumn("a", elements.atom_counts(c("peptide"), half))
    masses = F.round(elements.base_mass(c("a"), half), 4).alias("lightest"), F.round(elements.precursor_mass(c("a"), half), 4).alias("enriched")
    return p.select("p_partkey", "a.*", *masses)


# A configuration of a labelled search. Element P is the carbon of the blocking agent,
# which stays at natural abundance; carbon is half heavy.
LABELLED_CONFIG = """
[Peptide_Identification]
PTM{~} = M   # oxidation
PTM{!} = NQ  # deamidation
PTM{@} = STY # phosphorylation, by its own element
Element_List = C, H, O, N, P, S, Z
Residue{Nterm} = 0, 1, 0, 0, 0, 0, 0
Residue{Cterm} = 0, 1, 1, 0, 0, 0, 0
Residue{A} = 3, 5, 1, 1, 0, 0, 0
Residue{C} = 3, 8, 2, 2, 2, 1, 0
Residue{K} = 6, 12, 1, 2, 0, 0, 0
Residue{M} = 5, 9, 1, 1, 0, 1, 0
Residue{N} = 4, 6, 2, 2, 0, 0, 0
Residue{R} = 6, 12, 1, 4, 0, 0, 0
Residue{S} = 3, 5, 2, 1, 0, 0, 0
Residue{~} = 0, 0, 1, 0, 0, 0, 0,
Residue{!} = 0, -1, 1, -1, 0, 0, 0,
Residue{@} = 0, 1, 3, 0, 0, 0, 1,
Element_Masses{C} = 12.000000, 13.003355
Element_Percent{C} = 0.5, 0.5
Element_Masses{H} = 1.007825, 2.014102
Element_Percent{H} = 0.999885, 0.000115
Element_Masses{O} = 15.994915, 16.999132, 17.999160
Element_Percent{O} = 0.99757, 0.00038, 0.00205
Element_Masses{N} = 14.003074, 15.000109
Element_Percent{N} = 0.99632, 0.00368
Element_Masses{P} = 12.000000, 13.003355
Element_Percent{P} = 0.9893, 0.0107
Element_Masses{S} = 31.972071, 32.971459, 33.967867, 34.967867, 35.967081
Element_Percent{S} = 0.9493, 0.0076, 0.0429, 0.0000, 0.0002
Element_Masses{Z} = 30.973762
Element_Percent{Z} = 1.0
[Stable_Isotope_Probing]
SIP_Element = C
"""


@query("""WITH f AS (SELECT p_partkey, regexp_replace(upper(p_name), '[^ACKMNRS]', '', 'g') AS s FROM part),
a AS (SELECT p_partkey, s, replace(replace(s, 'M', 'M~'), 'N', 'N!') AS peptide, length(s) - length(replace(s, 'A', '')) AS a, length(s) - length(replace(s, 'C', '')) AS cy, length(s) - length(replace(s, 'K', '')) AS k,
  length(s) - length(replace(s, 'M', '')) AS m, length(s) - length(replace(s, 'N', '')) AS n, length(s) - length(replace(s, 'R', '')) AS r, length(s) - length(replace(s, 'S', '')) AS e FROM f),
t AS (SELECT *, 3*a + 3*cy + 6*k + 5*m + 4*n + 6*r + 3*e AS xc, 5*a + 8*cy + 12*k + 9*m + 6*n + 12*r + 5*e + 2 AS xh, a + 2*cy + k + m + 2*n + r + 2*e + 1 AS xo, a + 2*cy + 2*k + m + 2*n + 4*r + e AS xn, 2*cy AS xp, cy + m AS xs FROM a),
w AS (SELECT *, xc * 12.0::DOUBLE + xh * 1.007825::DOUBLE + xo * 15.994915::DOUBLE + xn * 14.003074::DOUBLE + xp * 12.0::DOUBLE + xs * 31.972071::DOUBLE AS light,
  xc * 0.5::DOUBLE * 1.003355::DOUBLE + xh * 0.000115::DOUBLE * 1.006277::DOUBLE + xo * (0.00038::DOUBLE * 1.004217::DOUBLE + 0.00205::DOUBLE * 1.000028::DOUBLE) + xn * 0.00368::DOUBLE * 0.997035::DOUBLE + xp * 0.0107::DOUBLE * 1.003355::DOUBLE + xs * (0.0076::DOUBLE * 0.999388::DOUBLE + 0.0429::DOUBLE * 0.996408::DOUBLE) AS heavy,
  xc * 0.5::DOUBLE + xh * 0.000115::DOUBLE + xo * 0.00243::DOUBLE + xn * 0.00368::DOUBLE + xp * 0.0107::DOUBLE + xs * 0.0505::DOUBLE AS weight FROM t)
SELECT p_partkey, peptide, round(light + round(xc * 0.5::DOUBLE) * heavy / weight + m * 15.994915::DOUBLE + n * (15.994915::DOUBLE - 1.007825::DOUBLE - 14.003074::DOUBLE), 3) AS mass FROM w""")
def configured_masses(spark, sf_dir):
    """Masses of modified peptides by a configuration whose cysteine carries unlabelled carbon."""
    found = chemistry.Chemistry.from_config(readers.config(LABELLED_CONFIG))
    plain = peptides.clean(F.upper("p_name"), "ACKMNRS")
    marked = F.replace(F.replace(plain, F.lit("M"), F.lit("M~")), F.lit("N"), F.lit("N!"))
    return read(spark, sf_dir, "part").select("p_partkey", marked.alias("peptide")).select("*", F.round(elements.peptide_mass(c("peptide"), found), 3).alias("mass"))


@query("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE)) + 0.001) AS p, list_transform(range(len(embedding)), lambda i: 100 + i * 1.003355::DOUBLE) AS m FROM embeddings)
SELECT vec_id, round(m[list_position(p, list_max(p))], 6) AS most_abundant, round(list_sum(list_transform(range(1, len(p) + 1), lambda i: p[i] * m[i])) / list_sum(p), 6) AS average, round(list_min(m), 6) AS lowest,
  list_transform(p, lambda x: round(x / list_max(p), 6)) AS scaled FROM e""")
def distribution_masses(spark, sf_dir):
    p = F.transform("embedding", lambda x: F.abs(x.cast("double")) + 0.001)
    m = F.transform("embedding", lambda x, i: 100 + i * F.lit(1.003355))
    e = read(spark, sf_dir, "embeddings").select("vec_id", p.alias("p"), m.alias("m"))
    scaled = F.transform(elements.scaled_to_top(c("p")), lambda x: F.round(x, 6))
    return e.select("vec_id", F.round(elements.most_abundant(c("m"), c("p")), 6).alias("most_abundant"), F.round(elements.average_mass(c("m"), c("p")), 6).alias("average"), F.round(elements.lowest_mass(c("m")), 6).alias("lowest"), scaled.alias("scaled"))


@query("""WITH d AS (SELECT l_orderkey, l_linenumber, l_extendedprice / 10 AS a, l_quantity * 70 AS b FROM lineitem), e AS (SELECT *, a - b AS d FROM d),
u AS (SELECT *, ceil(d) * 1.00867108694132::DOUBLE AS up, floor(d) * 1.00867108694132::DOUBLE AS down FROM e),
v AS (SELECT *, CASE WHEN d >= 0 AND up - 1.00867108694132 > d THEN up - 1.00867108694132 WHEN d < 0 AND up < d THEN up + 1.00867108694132 ELSE up END AS up2,
  CASE WHEN d >= 0 AND down > d THEN down - 1.00867108694132 WHEN d < 0 AND down + 1.00867108694132 < d THEN down + 1.00867108694132 ELSE down END AS down2 FROM u)
SELECT l_orderkey, l_linenumber, round(least(abs(d), abs(up2 - d), abs(d - down2)), 6) AS distance FROM v""")
def legacy_mass_distance(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").select(*ITEM, F.round(peptides.mass_distance(c("l_extendedprice") / 10, c("l_quantity") * 70), 6).alias("distance"))


@query("""WITH d AS (SELECT l_orderkey, l_linenumber, l_discount * 40 - l_tax * 55 AS d FROM lineitem),
f AS (SELECT *, list_min(list_transform(range(-4, 4), lambda i: abs(d - i * 1.00867108694132::DOUBLE))) AS size FROM d)
SELECT l_orderkey, l_linenumber, round(least(abs(d), size), 6) AS size FROM f""")
def nearest_multiple(spark, sf_dir):
    left = peptides.nearest_multiple(c("l_discount") * 40, c("l_tax") * 55)
    return read(spark, sf_dir, "lineitem").select(*ITEM, F.round(F.abs(left), 6).alias("size"))


@query(f"""WITH p AS (SELECT p_partkey, p_size, p_brand, {PEPTIDE} AS peptide FROM part)
SELECT p_partkey, CASE WHEN p_size % 10 = 0 THEN 1.07 ELSE p_size / 8.0::DOUBLE END AS abundance, CASE WHEN p_size % 10 <> 0 THEN p_size / 8.0::DOUBLE END AS percentage, 'run' || CAST(p_size AS VARCHAR) AS sample,
  length(peptide) - length(regexp_replace(peptide, '[KR]([ACDEFGHIJKLMNPQRSTVWY])', '\\1', 'g')) AS pairs FROM p""".replace("\\\\", "\\"))
def name_functions(spark, sf_dir):
    """Percentages and samples from names, and pairs of residues that are cut."""
    p = as_peptides(spark, sf_dir)
    name = F.when(c("p_size") % 10 == 0, "SE").otherwise(F.concat(F.lit("C13_"), F.format_string("%07.3f", c("p_size") / 8), F.lit("Pct")))
    sample = peptides.sample_name(F.concat(F.lit("run"), c("p_size").cast("string"), F.lit(".12.1")))
    plain = F.regexp_replace("peptide", "[KR]([ACDEFGHIJKLMNPQRSTVWY])", "$1")
    return p.select("p_partkey", peptides.abundance(name).alias("abundance"), peptides.percentage(name).alias("percentage"), sample.alias("sample"), (F.length("peptide") - F.length(plain)).cast("long").alias("pairs"))


@query("""WITH n AS (SELECT o_custkey, list_sort(list(DISTINCT o_orderpriority)) AS names FROM orders GROUP BY 1),
l AS (SELECT o_custkey, names, list_filter(names, lambda x: NOT starts_with(x, '1-')) AS a, list_filter(names, lambda x: NOT starts_with(x, '1-') AND NOT starts_with(x, '2-')) AS b FROM n)
SELECT o_custkey, CASE WHEN len(a) = 0 THEN 'reserve' WHEN len(b) = 0 THEN 'train' WHEN len(list_filter(b, lambda x: NOT starts_with(x, '3-'))) = 0 THEN 'test' ELSE 'target' END AS kind, '{' || array_to_string(b, ',') || '}' AS cleaned FROM l""")
def protein_classes(spark, sf_dir):
    n = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_set("o_orderpriority")).alias("names"))
    return n.select("o_custkey", peptides.protein_class(c("names"), "1-", "2-", "3-").alias("kind"), peptides.listed(peptides.clean_names(c("names"), "1-", "2-")).alias("cleaned"))


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey, l_suppkey) AS a, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber, l_partkey, l_suppkey) AS b, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_discount DESC, l_linenumber, l_partkey, l_suppkey) AS c FROM lineitem)
SELECT l_orderkey, l_linenumber, round(1.0::DOUBLE / (a * b * c), 9) AS product, CAST((CASE WHEN a = 1 THEN 1 ELSE 0 END) + (CASE WHEN b = 1 THEN 2 ELSE 0 END) + (CASE WHEN c = 1 THEN 4 ELSE 0 END) AS INTEGER) AS agreement FROM r""")
def rank_products(spark, sf_dir):
    ranked = ranking.rank_scores(read(spark, sf_dir, "lineitem"), ["l_orderkey"], ["l_extendedprice", "l_quantity", "l_discount"], ["l_linenumber", "l_partkey", "l_suppkey"])
    ranks = [c(f"rank_{s}") for s in ("l_extendedprice", "l_quantity", "l_discount")]
    return ranked.select(*ITEM, F.round(peptides.rank_product(*ranks), 9).alias("product"), peptides.agreement(*ranks).cast("int").alias("agreement"))


@query(f"""WITH p AS (SELECT p_partkey, {PEPTIDE} AS s, p_size % 7 + 1 AS a FROM part)
SELECT p_partkey, substr(s, a, 4) AS peptide, CASE WHEN a > 1 THEN substr(s, a - 1, 1) ELSE '-' END AS prefix, CASE WHEN a + length(substr(s, a, 4)) <= length(s) THEN substr(s, a + length(substr(s, a, 4)), 1) ELSE '-' END AS suffix FROM p""")
def flank_residues(spark, sf_dir):
    p = as_peptides(spark, sf_dir).select("p_partkey", c("peptide").alias("s"), (c("p_size") % 7 + 1).alias("a"))
    p = p.withColumn("peptide", F.substring("s", c("a"), F.lit(4)))
    return peptides.flanks(p, "s", "peptide", "a").select("p_partkey", "peptide", "prefix", "suffix")


@query("""WITH once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_suppkey % 20 ORDER BY l_extendedprice DESC, l_linenumber) AS k FROM lineitem) WHERE k = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_suppkey % 20) AS rank FROM once)
SELECT l_orderkey, l_linenumber, rank FROM r WHERE rank <= 3""")
def top_across(spark, sf_dir):
    d = read(spark, sf_dir, "lineitem").withColumn("peptide", c("l_suppkey") % 20)
    return merging.top_across(d, ["l_orderkey"], "peptide", "l_extendedprice", 3, ("l_linenumber",)).select(*ITEM, "rank")


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_returnflag ORDER BY l_quantity DESC, l_tax, l_orderkey, l_linenumber) AS n FROM lineitem),
u AS (SELECT l_suppkey, l_returnflag, string_agg(DISTINCT s, ',' ORDER BY s) AS proteins FROM (SELECT l_suppkey, l_returnflag, CAST(l_partkey AS VARCHAR) AS s FROM lineitem) GROUP BY 1, 2)
SELECT l_suppkey, l_returnflag, l_orderkey, l_linenumber, l_quantity, l_tax, proteins FROM r JOIN u USING (l_suppkey, l_returnflag) WHERE n = 1""")
def best_of_peptide(spark, sf_dir):
    d = read(spark, sf_dir, "lineitem").select("l_suppkey", "l_returnflag", *ITEM, "l_quantity", "l_tax", F.array(c("l_partkey").cast("string")).alias("proteins"))
    got = merging.best_of_peptide(d, ["l_suppkey"], "l_returnflag", "l_quantity", "proteins", "l_tax", ("l_orderkey", "l_linenumber"))
    return got.withColumn("proteins", F.array_join("proteins", ","))


@query("""WITH t AS (SELECT * FROM lineitem WHERE l_quantity >= 10), d AS (SELECT * FROM lineitem x WHERE l_quantity < 10 AND NOT EXISTS (SELECT 1 FROM t WHERE t.l_linestatus = x.l_linestatus AND t.l_partkey = x.l_partkey)),
u AS (SELECT *, false AS is_decoy FROM t UNION ALL SELECT *, true FROM d)
SELECT l_orderkey, l_linenumber, is_decoy, row_number() OVER (PARTITION BY l_linestatus, l_suppkey, l_returnflag ORDER BY l_extendedprice DESC, is_decoy, l_partkey, l_orderkey, l_linenumber) AS rank FROM u""")
def decoy_merge(spark, sf_dir):
    d = read(spark, sf_dir, "lineitem")
    got = merging.with_decoys(d.where("l_quantity >= 10"), d.where("l_quantity < 10"), "l_linestatus", ["l_linestatus", "l_suppkey", "l_returnflag"], "l_partkey", "l_extendedprice", tuple(ITEM))
    return got.select(*ITEM, "is_decoy", "rank")


@query("""WITH r AS (SELECT *, count(*) OVER (PARTITION BY l_suppkey) AS size, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS a, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_quantity DESC, l_orderkey, l_linenumber) AS b FROM lineitem)
SELECT l_orderkey, l_linenumber FROM r WHERE size <= 100 OR least(a, b) <= 20""")
def purged(spark, sf_dir):
    return merging.purged(read(spark, sf_dir, "lineitem"), ["l_suppkey"], ["l_extendedprice", "l_quantity"], ITEM).select(*ITEM)


@query("""WITH r AS (SELECT *, row_number() OVER w AS n, lead(l_extendedprice) OVER w AS after, first_value(l_extendedprice) OVER w AS top FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber))
SELECT l_orderkey, l_linenumber, round(CASE WHEN n = 1 THEN CASE WHEN after IS NULL THEN 0 WHEN after = 0 THEN 1 ELSE l_extendedprice / after - 1 END ELSE l_extendedprice / top - 1 END, 9) AS lead FROM r""")
def relative_leads(spark, sf_dir):
    got = merging.relative_leads(read(spark, sf_dir, "lineitem"), ["l_orderkey"], ["l_extendedprice"], ["l_linenumber"])
    return got.select(*ITEM, F.round("lead_l_extendedprice", 9).alias("lead"))


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_discount DESC, abs(l_tax - 0.04::DOUBLE), l_quantity, upper(l_returnflag), l_orderkey, l_linenumber) AS n FROM lineitem)
SELECT l_suppkey, l_orderkey, l_linenumber FROM r WHERE n = 1""")
def re_rank(spark, sf_dir):
    """The best match of a spectrum: probability, mass error, modifications, peptide."""
    d = read(spark, sf_dir, "lineitem").withColumn("error", c("l_tax") - 0.04).withColumn("names", F.array("l_returnflag"))
    order = [*merging.re_rank_order("l_discount", "error", "l_quantity", "l_returnflag"), *map(F.col, ITEM)]
    return ranking.best_with_ties(d, ["l_suppkey"], order, ["l_discount", "error", "l_quantity", "l_returnflag"], "names").select("l_suppkey", *ITEM)


@query("""SELECT count(*) FILTER (o_orderstatus = 'O') AS n_target, count(*) FILTER (o_orderstatus = 'train') AS n_train, count(*) FILTER (o_orderstatus = 'F') AS n_test, count(*) FILTER (o_orderstatus = 'P') AS n_reserve, round(count(*) FILTER (o_orderstatus = 'F') / count(*) FILTER (o_orderstatus = 'O'), 9) AS test_ratio FROM orders""")
def label_counts(spark, sf_dir):
    kind = F.when(c("o_orderstatus") == "O", "target").when(c("o_orderstatus") == "F", "test").when(c("o_orderstatus") == "P", "reserve")
    got = reports.label_counts(read(spark, sf_dir, "orders").withColumn("kind", kind), "kind")
    return got.withColumn("test_ratio", F.round("test_ratio", 9))


@query("""WITH e AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_quantity > 25), n AS (SELECT l_partkey, count(*) AS n FROM e GROUP BY 1), s AS (SELECT l_partkey, count(*) AS s FROM lineitem GROUP BY 1),
f AS (SELECT l_partkey, l_returnflag, count(*) AS f FROM lineitem GROUP BY 1, 2),
p AS (SELECT l_suppkey, count(*) AS pp, count(*) FILTER (n = 1) AS up, count(*) FILTER (n > 1) AS sp, sum(s) AS spectra FROM e JOIN n USING (l_partkey) JOIN s USING (l_partkey) GROUP BY 1),
b AS (SELECT l_partkey, max(pp) AS pp, max(CASE WHEN n = 1 THEN up ELSE 0 END) AS up, max(CASE WHEN n > 1 THEN sp ELSE 0 END) AS sp, bool_or(n = 1) AS is_unique, max(spectra) AS most FROM e JOIN n USING (l_partkey) JOIN p USING (l_suppkey) GROUP BY 1)
SELECT l_orderkey, l_linenumber, f AS same_form, s AS same_peptide, coalesce(pp, 0) AS protein_peptides, coalesce(up, 0) AS unique_peptides, coalesce(sp, 0) AS shared_peptides, coalesce(is_unique, false) AS is_unique, CAST(greatest(coalesce(most, 1) - 1, 0) AS BIGINT) AS protein_spectra
FROM lineitem JOIN f USING (l_partkey, l_returnflag) JOIN s USING (l_partkey) LEFT JOIN b USING (l_partkey)""")
def match_features(spark, sf_dir):
    d = read(spark, sf_dir, "lineitem")
    got = reports.match_features(d.select(*ITEM, "l_partkey", "l_returnflag"), d.where("l_quantity > 25").select("l_partkey", "l_suppkey"), "l_returnflag", "l_partkey", "l_suppkey")
    return got.select(*ITEM, "same_form", "same_peptide", "protein_peptides", "unique_peptides", "shared_peptides", "is_unique", "protein_spectra")


RUNS = """WITH pep AS (SELECT l_partkey, year(l_shipdate) AS run, count(*) AS spectra FROM lineitem GROUP BY 1, 2), e AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem),
a AS (SELECT l_partkey, count(*) AS n FROM e GROUP BY 1), k AS (SELECT e.* FROM e JOIN supplier ON s_suppkey = l_suppkey WHERE s_acctbal > 0), h AS (SELECT l_partkey, count(*) AS share FROM k GROUP BY 1),
g AS (SELECT l_suppkey, run, count(*) FILTER (n = 1) AS unique_peptides, count(*) AS total_peptides, CAST(coalesce(sum(spectra) FILTER (n = 1), 0) AS BIGINT) AS unique_spectra, CAST(sum(spectra) AS BIGINT) AS total_spectra, sum(spectra / share) AS balanced FROM pep JOIN k USING (l_partkey) JOIN a USING (l_partkey) JOIN h USING (l_partkey) GROUP BY 1, 2),
s AS (SELECT run, sum(balanced) AS s FROM g GROUP BY 1), r AS (SELECT g.*, balanced * (SELECT avg(s) FROM s) / s AS scaled FROM g JOIN s USING (run))
"""


def run_rows(spark, sf_dir):
    d = read(spark, sf_dir, "lineitem").withColumn("run", F.year("l_shipdate").cast("long"))
    good = read(spark, sf_dir, "supplier").where("s_acctbal > 0").select(c("s_suppkey").alias("l_suppkey"))
    return reports.run_counts(d.groupBy("l_partkey", "run").agg(F.count("*").alias("spectra")), d, good, "l_partkey", "l_suppkey", "run", "spectra")


@query(RUNS + "SELECT l_suppkey, run, unique_peptides, total_peptides, unique_spectra, total_spectra, round(balanced, 6) AS balanced, round(scaled, 2) AS normalised FROM r")
def run_counts(spark, sf_dir):
    return run_rows(spark, sf_dir).withColumn("balanced", F.round("balanced", 6))


YEARS = [1995, 1996, 1997, 1998, 1999, 2000, 2001]


@query(RUNS + f""", w AS (SELECT l_suppkey, {", ".join(f"max(CASE WHEN run = {y} THEN total_spectra ELSE 0 END) AS spectra_{y}" for y in YEARS)} FROM r GROUP BY 1)
SELECT w.*, coalesce(CASE WHEN s_nationkey < 12 THEN s_name END, 'N/A') AS description, 'T' AS target_match FROM w JOIN supplier ON s_suppkey = l_suppkey""")
def protein_table(spark, sf_dir):
    known = read(spark, sf_dir, "supplier").where("s_nationkey < 12").select(c("s_suppkey").alias("protein_id"), c("s_name").alias("description"))
    got = reports.protein_table(run_rows(spark, sf_dir), "l_suppkey", "run", YEARS, known)
    return got.select("l_suppkey", *(c(f"{y}_total_spectra").alias(f"spectra_{y}") for y in YEARS), "description", "target_match")


@query("""WITH n AS (SELECT DISTINCT o_custkey, o_orderpriority FROM orders), a AS (SELECT o_custkey, string_agg(o_orderpriority, ',' ORDER BY o_orderpriority) AS proteins FROM n GROUP BY 1)
SELECT o_orderkey, proteins FROM orders JOIN a USING (o_custkey)""")
def back_filled(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.array("o_orderpriority").alias("proteins"))
    return reports.back_filled(o, "o_custkey", "proteins").select("o_orderkey", F.array_join("proteins", ",").alias("proteins"))


@query("""WITH w AS (SELECT DISTINCT lower(p_type) AS word FROM part UNION SELECT DISTINCT unnest(string_split(lower(p_name), ' ')) FROM part UNION SELECT DISTINCT lower(p_name) FROM part)
SELECT word, p_partkey FROM w JOIN part ON contains(lower(p_name), word) WHERE word <> ''""")
def containing(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    name = F.lower("p_name")
    words = p.select(F.lower("p_type").alias("word")).union(p.select(F.explode(F.split(name, " ")))).union(p.select(name)).distinct()
    return reports.containing(words, p.select("p_partkey", name.alias("name")), "word", "name").select("word", "p_partkey")


@query("""SELECT o_orderkey, c_mktsegment FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_nationkey < 10) ON o_custkey = c_custkey""")
def with_features(spark, sf_dir):
    rows = read(spark, sf_dir, "customer").where("c_nationkey < 10").select("c_custkey", "c_mktsegment")
    return reports.with_features(read(spark, sf_dir, "orders"), rows, "o_custkey", "c_custkey").select("o_orderkey", "c_mktsegment")


@query("""WITH p AS (SELECT l_partkey AS base, l_quantity < 10 AS d, max(l_extendedprice) AS score FROM lineitem GROUP BY 1, 2),
m AS (SELECT base, d, score FROM (SELECT *, row_number() OVER (PARTITION BY base ORDER BY score DESC, d) AS n FROM p) WHERE n = 1),
b AS (SELECT score AS s, sum(CASE WHEN d THEN 1 ELSE 0 END) AS d, sum(CASE WHEN d THEN 0 ELSE 1 END) AS t FROM m GROUP BY 1),
r AS (SELECT s, sum(d) OVER w / greatest(sum(t) OVER w, 1) AS r FROM b WINDOW w AS (ORDER BY s DESC ROWS UNBOUNDED PRECEDING)), q AS (SELECT s, min(r) OVER (ORDER BY s ROWS UNBOUNDED PRECEDING) AS q FROM r)
SELECT CASE WHEN d THEN 'Decoy_' ELSE '' END || CAST(base AS VARCHAR) AS protein, score, d AS is_decoy, round(q, 9) AS q_value FROM m JOIN q ON s = score""")
def picked(spark, sf_dir):
    d = matches(spark, sf_dir).withColumn("protein", F.concat(F.when(c("is_decoy"), "Decoy_").otherwise(""), c("l_partkey").cast("string"))).withColumn("score", c("l_extendedprice"))
    return reports.picked(d, "protein", "score").withColumn("q_value", F.round("q_value", 9))


@query("""SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_discount <= 0.05 AND l_tax < 0.06 AND l_linenumber = 1 AND l_quantity >= 20 AND coalesce(l_returnflag, '') NOT IN ('R') AND abs(l_extendedprice - l_quantity * 1500) / (l_quantity * 1500) * 1e6 <= 200000""")
def filtered_matches(spark, sf_dir):
    """The filters of a report, one after the other."""
    d = read(spark, sf_dir, "lineitem").withColumn("guess", c("l_quantity") * 1500)
    d = reports.accepted(d, "l_discount", 0.05, "l_tax", 0.06)
    d = reports.without_kinds(reports.labelled_only(d, "l_linenumber", "l_quantity", 20.0, "l_discount", 0.05), "l_returnflag", "R")
    return reports.within_error(d, "l_extendedprice", "guess", 200000.0, ppm=True).select(*ITEM)


@query("""WITH s AS (SELECT l_suppkey, l_linestatus, list_sort(list(DISTINCT l_linenumber)) AS s FROM lineitem GROUP BY 1, 2)
SELECT string_agg(k, ',' ORDER BY k) AS clusters, CAST(len(s) AS INTEGER) AS spectra FROM (SELECT CAST(l_suppkey AS VARCHAR) || l_linestatus AS k, s FROM s) GROUP BY s""")
def same_spectra(spark, sf_dir):
    d = read(spark, sf_dir, "lineitem").withColumn("cluster", F.concat(c("l_suppkey").cast("string"), "l_linestatus"))
    return reports.same_spectra(d, "cluster", "l_linenumber").select(F.array_join("clusters", ",").alias("clusters"), "spectra")


@query("""SELECT l_suppkey, max(l_extendedprice) AS most_mass, max(l_linenumber) AS most_charge FROM lineitem GROUP BY 1""")
def parent_bounds(spark, sf_dir):
    return reports.parent_bounds(read(spark, sf_dir, "lineitem"), "l_extendedprice", "l_linenumber", ["l_suppkey"])


@query("""SELECT l_orderkey, round(sum(l_extendedprice), 4) AS total_intensity, max(l_extendedprice) AS top_intensity FROM lineitem GROUP BY 1""")
def intensity_sums(spark, sf_dir):
    peak = F.struct(c("l_quantity").alias("mz"), c("l_extendedprice").alias("intensity"))
    scans = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(peak)).alias("peaks"))
    return reports.intensity_sums(scans).select("l_orderkey", F.round("total_intensity", 4).alias("total_intensity"), "top_intensity")


@query("""SELECT r_name, n_name, s AS search FROM region, nation, (VALUES ('target'), ('decoy')) t(s)""")
def task_list(spark, sf_dir):
    kinds = spark.createDataFrame([("target",), ("decoy",)], "search string")
    return reports.task_list(read(spark, sf_dir, "region").select("r_name"), read(spark, sf_dir, "nation").select("n_name"), kinds)


@query(f"""WITH p AS (SELECT p_partkey, {PEPTIDE} AS s FROM part), i AS (SELECT p_partkey, s, unnest(range(1, length(s) + 1)) AS position FROM p), r AS (SELECT *, unnest(string_split('ACDEFGHIKLMNPQRSTVWY', '')) AS residue FROM i)
SELECT p_partkey, CAST(position AS INTEGER) AS position, residue, mutant,
  unnest(CASE WHEN residue IN ('K', 'R') AND position < length(s) THEN list_filter(string_split(regexp_replace(mutant, '([KR])', '\\1|', 'g'), '|'), lambda x: x <> '') ELSE [mutant] END) AS piece
FROM (SELECT *, substr(s, 1, position - 1) || residue || substr(s, position + 1) AS mutant FROM r WHERE substr(s, position, 1) <> residue)""".replace("\\\\", "\\"))
def substitutions(spark, sf_dir):
    got = variants.substituted(as_peptides(spark, sf_dir).select("p_partkey", "peptide"), "peptide")
    return got.select("p_partkey", "position", "residue", "mutant", "piece")


@query(f"""WITH p AS (SELECT p_partkey, list_filter(string_split(regexp_replace(regexp_replace({PEPTIDE}, '^M', ''), '([KR])', '\\1|', 'g'), '|'), lambda x: x <> '') AS p FROM part),
i AS (SELECT p_partkey, p, unnest(range(len(p))) AS cut FROM p), r AS (SELECT *, unnest(string_split('ACDEFGHILMNPQSTVWY', '')) AS residue FROM i WHERE cut < len(p) - 1 AND length(p[cut + 1]) + length(p[cut + 2]) BETWEEN 5 AND 60)
SELECT p_partkey, CAST(cut AS INTEGER) AS cut, residue, substr(p[cut + 1], 1, length(p[cut + 1]) - 1) || residue || p[cut + 2] AS mutant FROM r""".replace("\\\\", "\\"))
def silenced_cuts(spark, sf_dir):
    return variants.silenced(as_peptides(spark, sf_dir).select("p_partkey", "peptide"), "peptide", least=5).select("p_partkey", "cut", "residue", "mutant")


@query(f"""SELECT p_partkey, replace(replace({PEPTIDE}, 'S', 'S~'), 'ES~', 'E') AS peptide FROM part""")
def neutral_losses(spark, sf_dir):
    return as_peptides(spark, sf_dir).select("p_partkey", variants.neutral_loss(c("peptide"), {"S": "S~", "ES~": "E"}).alias("peptide"))


@query("""WITH s AS (SELECT l_orderkey, list_sort(list({'z': l_linenumber, 'mz': l_extendedprice})) AS l FROM lineitem GROUP BY 1), o AS (SELECT l_orderkey, CAST(l_orderkey % 3 AS INTEGER) AS charge, l[1].mz AS parent_mz, l FROM s),
own AS (SELECT l_orderkey, charge AS z, parent_mz AS precursor_mz FROM o WHERE charge <> 0),
listed AS (SELECT l_orderkey, charge, parent_mz, unnest(l) AS x FROM o)
SELECT * FROM own UNION ALL SELECT l_orderkey, x.z, x.mz FROM listed WHERE charge = 0 OR abs(x.mz - parent_mz) > 0.01 OR x.z <> charge""")
def listed_precursors(spark, sf_dir):
    s = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(c("l_linenumber").alias("z"), c("l_extendedprice").alias("mz")))).alias("precursors"))
    s = s.select("l_orderkey", (c("l_orderkey") % 3).cast("int").alias("charge"), c("precursors")[0]["mz"].alias("parent_mz"), "precursors")
    return variants.precursors(s).select("l_orderkey", "z", "precursor_mz")


@query("""WITH r AS (SELECT *, '*' || chr(9) || 'K' || l_partkey || chr(9) || 'K' || l_partkey || chr(9) || printf('%.4f', l_extendedprice) || chr(9) || printf('%.4f', l_quantity) || chr(9) || printf('%.4f', l_tax) || chr(9) || printf('%.4f', l_discount) || chr(9) || '{S' || l_suppkey || '}' || chr(9) || l_linenumber || chr(9) || printf('%.4f', l_extendedprice) AS m FROM lineitem)
SELECT l_orderkey AS scan, '+' || chr(9) || 'run' || chr(9) || l_orderkey || chr(9) || '2' || chr(9) || '500.00000' || chr(9) || 'MS2' || chr(9) || 'SE' || chr(9) || '1.5' || chr(9) || (l_orderkey - 1) || chr(10) || string_agg(m, chr(10) ORDER BY -l_quantity, 'K' || l_partkey, m) AS line FROM r GROUP BY l_orderkey""")
def result_lines(spark, sf_dir):
    """Search results as their text file has them, a row for each spectrum."""
    k = F.concat(F.lit("K"), c("l_partkey").cast("string"))
    lines = read(spark, sf_dir, "lineitem").select(*ITEM, "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    d = lines.repartition("l_orderkey").select(  # numbers are dealt, and become text where they are gathered
        F.lit("run").alias("filename"), c("l_orderkey").alias("scan"), F.lit(2).alias("charge"), F.lit(500.0).alias("window_mz"), F.lit("MS2").alias("scan_type"), F.lit("SE").alias("search_name"), F.lit("1.5").alias("rt"), (c("l_orderkey") - 1).alias("parent_scan"),
        k.alias("identified"), k.alias("original"), c("l_extendedprice").alias("calculated_mass"), c("l_quantity").alias("wdp"), c("l_tax").alias("xcorr"), c("l_discount").alias("mvh"), F.array(F.concat(F.lit("S"), c("l_suppkey").cast("string"))).alias("proteins"), c("l_linenumber").alias("measured_charge"), c("l_extendedprice").alias("measured_mass"),
    )
    return sinks.spe2pep_lines(d).select("scan", "line")


@query("""SELECT 'run.' || l_orderkey || '.' || l_linenumber AS "SpecId", CASE WHEN l_quantity < 10 THEN -1 ELSE 1 END AS "Label", l_extendedprice AS "ExpMass", round(l_quantity * 3, 6) AS "MS1IsotopicAbundances", round(l_quantity * 3 - 1.07, 6) AS "isotopicAbundanceDiffs",
  round(CASE WHEN l_discount > 0 THEN log10(l_discount) ELSE 0 END, 6) AS "log10_precursorIntensities", l_returnflag || chr(9) || l_linestatus AS "Proteins" FROM lineitem""")
def feature_table(spark, sf_dir):
    d, zero = matches(spark, sf_dir), F.lit(0)
    names = dict(filename=F.lit("run"), scan=c("l_orderkey"), rank=c("l_linenumber"), calculated_mass=c("l_extendedprice"), ms1_abundance=c("l_quantity") * 3, ms2_abundance=F.lit(1.07), precursor_intensity=c("l_discount"), proteins=F.array("l_returnflag", "l_linestatus"), isotopic_peaks=F.array(), peptide=c("l_linestatus"))
    rest = "rt charge mass_error_ppm window_shift mz_shift peptide_length missed ptms wdp xcorr mvh delta_score".split()
    got = sinks.pin_table(d.select("is_decoy", *(v.alias(n) for n, v in names.items()), *(zero.alias(n) for n in rest)))
    numbers = ["MS1IsotopicAbundances", "isotopicAbundanceDiffs", "log10_precursorIntensities"]
    return got.select("SpecId", "Label", "ExpMass", *(F.round(n, 6).alias(n) for n in numbers), "Proteins")


@query(f"""WITH m AS (SELECT l_orderkey, l_linenumber, {PEPTIDE} AS s, l_extendedprice / 10 AS calculated, l_extendedprice / 10 + (l_linenumber - 3) * 1.003355::DOUBLE + (l_discount - 0.05) * 0.1 AS measured,
  l_linenumber % 3 + 1 AS z, l_extendedprice / 30 AS centre, l_quantity AS wdp FROM lineitem JOIN part ON p_partkey = l_partkey),
d AS (SELECT *, abs(measured - calculated) AS d, abs(measured - calculated) % 1.003355::DOUBLE AS e, substr(s, 2, greatest(length(s) - 2, 0)) AS inner_s FROM m)
SELECT l_orderkey, l_linenumber, CAST(length(s) AS INTEGER) AS peptide_length, CAST(length(inner_s) - length(replace(replace(inner_s, 'K', ''), 'R', '')) AS INTEGER) AS missed, CAST(length(s) - length(replace(s, 'M', '')) AS INTEGER) AS ptms,
  round((CASE WHEN e > 1.003355::DOUBLE / 2 THEN 1.003355::DOUBLE - e ELSE e END) / calculated * 1e6, 4) AS mass_error_ppm, CAST(round(d / 1.003355::DOUBLE) AS INTEGER) AS window_shift,
  round(abs(centre - measured / z - 1.00727646688::DOUBLE), 6) AS mz_shift, wdp AS ms2_abundance, max(wdp) OVER (PARTITION BY l_orderkey) - wdp AS delta_score FROM d""")
def psm_features(spark, sf_dir):
    """What matches tell by themselves: lines as matches of their order's spectrum to the part's name."""
    bare, at = peptides.clean(F.upper("p_name"), "ACDEFGHIKLMNPQRSTVWY"), c("l_extendedprice") / 10
    d = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "part"), c("p_partkey") == c("l_partkey")).select(
        *ITEM, F.concat(F.lit("K["), F.replace(bare, F.lit("M"), F.lit("M~")), F.lit("]")).alias("identified"), F.concat(F.lit("K["), bare, F.lit("]A")).alias("original"), at.alias("calculated_mass"),
        (at + (c("l_linenumber") - 3) * 1.003355 + (c("l_discount") - 0.05) * 0.1).alias("measured_mass"), (c("l_linenumber") % 3 + 1).alias("measured_charge"), (c("l_extendedprice") / 30).alias("window_mz"),
        c("l_quantity").alias("wdp"), F.format_string("C13_%07.3fPct", "l_quantity").alias("search_name"),
    )
    got = features.column_features(d).withColumn("delta_score", ranking.delta_to_top(d, ["l_orderkey"], "wdp"))
    rounded = F.round("mass_error_ppm", 4).alias("mass_error_ppm"), "window_shift", F.round("mz_shift", 6).alias("mz_shift")
    return got.select(*ITEM, "peptide_length", "missed", "ptms", *rounded, "ms2_abundance", "delta_score")


@query()
def survey_envelopes(spark, sf_dir):
    """Survey scans made of orders: the peaks of lines, and one, two and three neutrons above each."""
    d = read(spark, sf_dir, "lineitem")
    peak = lambda x, k: F.struct((x["p"] / 100 + k * 1.003355 / 2).alias("mz"), (x["q"] * (4 - k)).alias("intensity"), F.lit(0).alias("z"))
    lines = F.collect_list(F.struct(c("l_extendedprice").alias("p"), c("l_quantity").alias("q")))
    surveys = d.groupBy(F.lit("run").alias("file"), c("l_suppkey").alias("scan")).agg(F.flatten(F.transform(lines, lambda x: F.array(*(peak(x, k) for k in range(4))))).alias("peaks"))
    mass = (c("l_extendedprice") / 100 - peptides.PROTON) * 2
    asked = d.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("key"), F.lit("run").alias("file"), c("l_suppkey").alias("parent_scan"), F.lit(2).alias("charge"), mass.alias("observed_mass"), mass.alias("calculated_mass"), F.lit("PEPTIDEK").alias("naked"))
    got = envelopes.precursor_envelopes(asked, surveys, "key")
    return got.select("key", "ms1_scan", F.round("precursor_intensity", 4).alias("precursor_intensity"), F.size("isotopic_peaks").alias("peaks"), F.round("ms1_abundance", 4).alias("ms1_abundance"))


@query()
def peptide_search(spark, sf_dir):
    """Every part name is a peptide and a spectrum of its own ions; each spectrum is searched among all."""
    p = as_peptides(spark, sf_dir).where("length(peptide) > 1").select("p_partkey", "peptide")  # one residue has no bond
    light = scoring.monoisotopic()
    masses = F.create_map(*(F.lit(x) for r, m in light.items() for x in (r, m)))
    each = F.transform(F.split("peptide", ""), lambda r: F.coalesce(F.try_element_at(masses, r), F.lit(0.0)))
    sums = lambda n: F.aggregate(F.slice("m", F.lit(1), n), F.lit(0.0), lambda s, x: s + x)
    whole = F.aggregate("m", F.lit(scoring.WATER), lambda s, x: s + x)
    at = F.sequence(F.lit(1), F.size("m") - 1)
    ion = lambda mz, n: F.struct(mz.alias("mz"), (F.lit(100.0) + n).alias("intensity"), F.lit(1).alias("z"))
    b = F.transform(at, lambda n: ion(sums(n) + peptides.PROTON, n))
    y = F.transform(at, lambda n: ion(c("mass") - sums(n) + peptides.PROTON, n))
    known = p.select("p_partkey", "peptide", each.alias("m")).withColumn("mass", whole)
    scans = known.select(c("p_partkey").alias("scan"), F.lit(2).alias("z"), (c("mass") / 2 + peptides.PROTON).alias("parent_mz"), F.concat(b, y).alias("peaks"))
    got = scoring.search(scans, known.select("peptide", "mass").distinct(), [(-0.05, 0.05)])
    return got.where("rank_wdp = 1").select("scan", "peptide", F.round("mvh", 4).alias("mvh"), F.round("xcorr", 4).alias("xcorr"), F.round("wdp", 4).alias("wdp"))


@query()
def error_probabilities(spark, sf_dir):
    got = reports.error_probabilities(matches(spark, sf_dir), "l_extendedprice", "is_decoy")
    return got.select(*ITEM, F.round("posterior_error_prob", 6).alias("posterior_error_prob"))
