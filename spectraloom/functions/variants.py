"""Generators on peptides and scans: modifications, substitutions, neutral losses, precursors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spectraloom.functions.peptides import pieces


def modified(peptide: Column, symbols: dict[str, str], most: int = 2) -> Column:
    """The peptide and its forms with 1 .. most modified residues: a symbol follows its residue.
    ``symbols`` gives the residues that each symbol modifies. An array, by number of symbols."""
    kinds = F.array(*(F.struct(F.lit(s).alias("s"), F.lit(r).alias("r")) for s, r in symbols.items()))
    start = F.array(F.struct(peptide.alias("text"), F.lit(0).alias("at")))
    empty = F.slice(start, 1, 0)

    def one(state):
        def place(i):
            here = F.substring(state.text, i, F.lit(1))
            fitting = F.filter(kinds, lambda k: F.contains(k.r, here))
            return F.transform(fitting, lambda k: F.struct(F.concat(F.substring(state.text, F.lit(1), i), k.s, F.substring(state.text, i + 1, F.length(state.text))).alias("text"), (i + 1).alias("at")))

        spots = F.sequence(state.at + 1, F.length(state.text))
        return F.when(state.at < F.length(state.text), F.flatten(F.transform(spots, place))).otherwise(empty)

    levels = [start]
    for _ in range(most):
        levels.append(F.flatten(F.transform(levels[-1], one)))
    return F.transform(F.concat(*levels), lambda x: x.text)


def substituted(df: DataFrame, peptide: str, alphabet: str = "ACDEFGHIKLMNPQRSTVWY", after: str = "KR") -> DataFrame:
    """A row for each single substitution: position, residue, mutant; a mutant in which the new
    residue cuts gives its pieces, so ``piece`` is what a digest would yield."""
    p, at = F.col(peptide), F.col("position")
    spots = df.withColumn("position", F.explode(F.sequence(F.lit(1), F.length(p)))).where(F.length(p) > 0)
    # what stands before and after a place is cut out once for all residues
    spots = spots.withColumns({"_a": F.substring(p, F.lit(1), at - 1), "_r": F.substring(p, at, F.lit(1)), "_b": F.substring(p, at + 1, F.length(p))})

    def rows(residues):
        new = F.filter(F.array(*map(F.lit, residues)), lambda r: r != F.col("_r"))
        out = spots.withColumn("residue", F.explode(new)).withColumn("mutant", F.concat("_a", "residue", "_b"))
        return out.drop("_a", "_r", "_b")

    whole = rows([r for r in alphabet if r not in after]).withColumn("piece", F.col("mutant"))
    cut = rows([r for r in alphabet if r in after])
    cuts = at < F.length("mutant")
    return whole.unionByName(cut.withColumn("piece", F.explode(F.when(cuts, pieces(F.col("mutant"), after=after, drop_first_m=False)).otherwise(F.array("mutant")))))


def silenced(df: DataFrame, seq: str, alphabet: str = "ACDEFGHIKLMNPQRSTVWY", after: str = "KR", least: int = 7, most: int = 60) -> DataFrame:
    """A row for each substitution that takes a cut away: the last residue of a piece becomes one that does
    not cut, so the piece is joined to the next: cut (from 0), residue, mutant, with lengths in range."""
    p = df.withColumn("_p", pieces(F.col(seq), after=after))
    kept = [r for r in alphabet if r not in after]
    p = p.select("*", F.explode(F.sequence(F.lit(0), F.size("_p") - 1)).alias("cut")).where(F.col("cut") < F.size("_p") - 1)
    p = p.withColumns({"_a": F.get("_p", F.col("cut")), "_b": F.get("_p", F.col("cut") + 1)}).drop("_p")
    p = p.where(F.length("_a") + F.length("_b") <= most).where(F.length("_a") + F.length("_b") >= least)
    p = p.withColumn("residue", F.explode(F.array(*map(F.lit, kept))))
    return p.withColumn("mutant", F.concat(F.substring("_a", F.lit(1), F.length("_a") - 1), F.col("residue"), F.col("_b"))).drop("_a", "_b")


def mutants(df: DataFrame, seq: str, alphabet: str = "ACDEFGHIKLMNPQRSTVWY", after: str = "KR", before: str = "ACDEFGHIJKLMNPQRSTVWY", missed: int = 2, least: int = 7, most: int = 60, drop_first_m: bool = True) -> DataFrame:
    """A row for each peptide that a single substitution in a sequence adds to its digest: those that hold
    the new residue, across up to ``missed`` cuts as they are after it, and those beside a cut that it makes.
    position (from 1 in what is cut), residue, peptide, original (what stood there), prefix and suffix.

    A substitution reaches no further than the pieces that a peptide can span, so each piece is cut anew
    within a window of its neighbours: the work follows the residues of the sequences, not their square.
    Empty and null sequences have no mutants."""
    reach = missed + 2
    p = df.withColumn("_p", pieces(F.col(seq), after, before, drop_first_m)).where(F.length(seq) > 0)
    starts = F.transform(F.sequence(F.lit(0), F.size("_p") - 1), lambda k: F.length(F.array_join(F.slice("_p", F.lit(1), k), "")))
    p = p.withColumn("_s", starts).select(*df.columns, "_p", "_s", F.posexplode("_p").alias("_k", "_piece"))
    low = F.greatest(F.col("_k") - reach, F.lit(0))
    window = F.array_join(F.slice("_p", low + 1, F.least(F.col("_k") + reach + 1, F.size("_p")) - low), "")
    offset, at = F.element_at("_s", low + 1), F.element_at("_s", F.col("_k") + 1)
    p = p.select(*df.columns, window.alias("_w"), offset.alias("_o"), (at - offset).alias("_b"), F.length("_piece").alias("_n"), (low == 0).alias("_first"), (F.col("_k") + reach + 1 >= F.size("_p")).alias("_last"))
    q, w, r = F.col("_q"), F.col("_w"), F.col("residue")
    one = lambda text, place: F.substring(text, place, F.lit(1))
    p = p.withColumn("_q", F.explode(F.sequence(F.col("_b") + 1, F.col("_b") + F.col("_n"))))
    p = p.withColumn("residue", F.explode(F.array(*map(F.lit, alphabet)))).where(one(w, q) != r)
    p = p.withColumn("_m", F.concat(F.substring(w, F.lit(1), q - 1), r, F.substring(w, q + 1, F.length(w))))
    p = p.withColumn("_c", pieces(F.col("_m"), after, before, False))
    p = p.withColumn("_e", F.transform(F.sequence(F.lit(1), F.size("_c")), lambda k: F.length(F.array_join(F.slice("_c", F.lit(1), k), ""))))
    cuts = lambda a, b: a.isin(*after) & b.isin(*before)
    text = F.col("_m")
    made_after = cuts(one(text, q), one(text, q + 1)) & ~cuts(one(w, q), one(w, q + 1))
    made_before = (q > 1) & cuts(one(text, q - 1), one(text, q)) & ~cuts(one(w, q - 1), one(w, q))

    def run(i, m):
        start, end = F.when(i == 0, 0).otherwise(F.get("_e", i - 1)) + 1, F.get("_e", i + m)
        return F.struct(start.alias("start"), end.alias("end"))

    runs = F.flatten(F.transform(F.sequence(F.lit(0), F.size("_c") - 1), lambda i: F.transform(F.sequence(F.lit(0), F.least(F.lit(missed), F.size("_c") - 1 - i)), lambda m: run(i, m))))
    touches = lambda x: ((x["start"] <= q) & (x["end"] >= q)) | ((x["start"] == q + 1) & made_after) | ((x["end"] == q - 1) & made_before)
    found = F.filter(runs, lambda x: touches(x) & (x["end"] - x["start"] + 1).between(least, most))
    p = p.withColumn("_x", F.explode(found))
    start, end = F.col("_x.start"), F.col("_x.end")
    size = end - start + 1
    ends = lambda here, open_, char: F.when(here & open_, "-").otherwise(char)
    return p.select(
        *df.columns, (F.col("_o") + q).alias("position"), "residue", F.substring(text, start, size).alias("peptide"), F.substring(w, start, size).alias("original"),
        ends(start == 1, F.col("_first"), one(text, start - 1)).alias("prefix"), ends(end == F.length(text), F.col("_last"), one(text, end + 1)).alias("suffix"),
    )


def neutral_loss(peptide: Column, losses: dict[str, str]) -> Column:
    """Symbols replaced by others, or removed, for scoring only."""
    for old, new in losses.items():
        peptide = F.replace(peptide, F.lit(old), F.lit(new))
    return peptide


def precursors(df: DataFrame, tol: float = 0.01) -> DataFrame:
    """A row for each (charge, m/z) of a scan: its own and the listed ones that differ by more than
    ``tol``; a scan of charge 0 uses the list only, or charge 3 with an empty list."""
    own = F.array(F.struct(F.when(F.col("charge") == 0, 3).otherwise(F.col("charge")).cast("int").alias("z"), F.col("parent_mz").alias("mz")))
    listed = F.coalesce(F.col("precursors"), F.slice(own, 1, 0))
    others = F.filter(listed, lambda x: (F.abs(x.mz - F.col("parent_mz")) > tol) | (x.z != F.col("charge")))
    rows = F.when((F.col("charge") == 0) & (F.size(listed) > 0), listed).otherwise(F.concat(own, others))
    return df.withColumn("_x", F.explode(rows)).withColumn("z", F.col("_x.z")).withColumn("precursor_mz", F.col("_x.mz")).drop("_x")


def with_guessed_charges(df: DataFrame, charge: str, peaks: str, parent_mz: str) -> DataFrame:
    """A row for each charge: the known one, and where it is 0 or null those guessed from the peaks."""
    guess = guessed_charges(F.transform(F.col(peaks), lambda p: p["mz"]), F.col(parent_mz))
    known = F.coalesce(F.col(charge), F.lit(0)) != 0
    return df.withColumn(charge, F.explode(F.when(known, F.array(F.col(charge).cast("int"))).otherwise(guess)))


def guessed_charges(peaks_mz: Column, parent_mz: Column) -> Column:
    """1 where the top twentieth of m/z lies below the parent, else 2 and 3."""
    at = F.greatest(F.ceil(F.size(peaks_mz) * 0.95).cast("int"), F.lit(1))
    return F.when(F.element_at(F.array_sort(peaks_mz), at) < parent_mz, F.array(F.lit(1))).otherwise(F.array(F.lit(2), F.lit(3)))
