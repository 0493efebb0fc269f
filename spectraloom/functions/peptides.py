"""Column functions on sequences, peptides and masses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PROTON = 1.00727646688
NEUTRON = 1.003355


def clean(seq: Column, alphabet: str = "ACDEFGHIJKLMNPQRSTVWY") -> Column:
    return F.regexp_replace(seq, f"[^{alphabet}]", "")


def pieces(seq: Column, after: str = "KR", before: str = "ACDEFGHIJKLMNPQRSTVWY", drop_first_m: bool = True) -> Column:
    """The sequence cut where a residue of after stands before one of before."""
    seq = F.regexp_replace(seq, "^M", "") if drop_first_m else seq
    return F.split(seq, f"(?<=[{after}])(?=[{before}])")


def digest(df: DataFrame, seq: str, missed: int = 2, least: int = 7, most: int = 60, flanked: bool = False, **cut) -> DataFrame:
    """A row for each run of up to missed + 1 pieces whose length is in range: first_piece, missed,
    peptide and, if ``flanked``, the residues beside it (prefix and suffix, ``-`` at either end of what
    is cut). Runs are built within the row of their sequence, which is not copied to each of them."""
    p = df.withColumn("_p", pieces(F.col(seq), **cut))
    beside = lambda i, m: [F.coalesce(F.right(F.get("_p", i - 1), F.lit(1)), F.lit("-")).alias("prefix"), F.coalesce(F.left(F.get("_p", i + m + 1), F.lit(1)), F.lit("-")).alias("suffix")] if flanked else []
    run = lambda i, m: F.struct(i.alias("first_piece"), m.alias("missed"), F.array_join(F.slice("_p", i + 1, m + 1), "").alias("peptide"), *beside(i, m))
    at = lambda i: F.transform(F.sequence(F.lit(0), F.least(F.lit(missed), F.size("_p") - i - 1)), lambda m: run(i, m))
    runs = F.flatten(F.transform(F.sequence(F.lit(0), F.size("_p") - 1), at))
    found = F.filter(runs, lambda r: F.length(r["peptide"]).between(least, most))
    return p.where(F.col(seq).isNotNull()).select(*df.columns, F.inline(found))


def flanks(df: DataFrame, seq: str, peptide: str, first: str) -> DataFrame:
    """Adds prefix and suffix: the residues beside a peptide that starts at place ``first`` (from 1) of
    its sequence, ``-`` at either end."""
    whole, at = F.col(seq), F.col(first)
    after = at + F.length(peptide)
    return df.withColumn("prefix", F.when(at > 1, F.substring(whole, at - 1, F.lit(1))).otherwise("-")).withColumn("suffix", F.when(after <= F.length(whole), F.substring(whole, after, F.lit(1))).otherwise("-"))


def decoys(df: DataFrame, name: str, seq: str, prefix: str = "Decoy_") -> DataFrame:
    return df.withColumn(name, F.concat(F.lit(prefix), F.col(name))).withColumn(seq, F.reverse(seq))


def neutral_mass(mz: Column, z: Column) -> Column:
    return mz * z - z * PROTON


def mass_error(observed: Column, calculated: Column, spacing: float = NEUTRON) -> Column:
    """The difference modulo the neutron spacing, folded into plus or minus half of it."""
    r = (observed - calculated) % spacing
    return F.when(r > spacing / 2, r - spacing).when(r < -spacing / 2, r + spacing).otherwise(r)


def window_shift(observed: Column, calculated: Column, spacing: float = NEUTRON) -> Column:
    return F.round(F.abs(observed - calculated) / spacing).cast("int")


def ppm(error: Column, mass: Column) -> Column:
    return error / mass * 1e6


def naked(peptide: Column) -> Column:
    """Between the first [ and the last ]."""
    return F.regexp_extract(peptide, r"\[(.*)\]", 1)


def ptm_count(peptide: Column) -> Column:
    return F.length(F.regexp_replace(peptide, "[A-Za-z]", ""))


def missed_sites(peptide: Column, after: str = "KR") -> Column:
    """Cleavage residues but for those at either end, wherever they may cut."""
    inner = F.substring(peptide, F.lit(2), F.greatest(F.length(peptide) - 2, F.lit(0)))
    return F.length(inner) - F.length(F.regexp_replace(inner, f"[{after}]", ""))


def names(text: Column) -> Column:
    """The names in {a,b,c}."""
    return F.transform(F.split(F.regexp_replace(text, r"[{}]", ""), ","), lambda x: F.trim(x))


def any_target(proteins: Column, prefix: str = "Decoy_") -> Column:
    return F.exists(proteins, lambda p: ~p.startswith(prefix))


def log10_or_zero(x: Column) -> Column:
    return F.when(x > 0, F.log10(x)).otherwise(F.lit(0.0))


def clamp(x: Column, lo: float = 0.0, hi: float = 100.0) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def abundance(search_name: Column) -> Column:
    """The percentage that ends names such as C13_001.020Pct, as it stands; 1.07 for SE, null for other names."""
    found = F.regexp_extract(search_name, r"_([0-9.]+)Pct$", 1)
    return F.when(search_name == "SE", F.lit(1.07)).otherwise(found.try_cast("double"))


def percentage(name: Column) -> Column:
    """What stands between the first _ and the Pct after it."""
    return F.regexp_extract(name, r"^[^_]*_(.*?)Pct", 1).try_cast("double")


def cut_pairs(peptide: Column, after: str = "KR", before: str = "ACDEFGHIJKLMNPQRSTVWY") -> Column:
    """Places where a residue of after stands before one of before."""
    return F.regexp_count(peptide, F.lit(f"[{after}](?=[{before}])"))


#: Fixed value: the neutron mass of the older search reports.
OLD_NEUTRON = 1.00867108694132


def mass_distance(calculated: Column, measured: Column, spacing: float = OLD_NEUTRON) -> Column:
    """How far two masses lie from being a whole number of neutrons apart, as the older reports rank
    it: the least of the difference itself and its distances to the multiples at or beside it that
    come from rounding the difference up and down (which are the neighbours up to some hundred Da)."""
    d = calculated - measured
    up, down = F.ceil(d) * F.lit(spacing), F.floor(d) * F.lit(spacing)
    up = F.when((d >= 0) & (up - spacing > d), up - spacing).when((d < 0) & (up < d), up + spacing).otherwise(up)
    down = F.when((d >= 0) & (down > d), down - spacing).when((d < 0) & (down + spacing < d), down + spacing).otherwise(down)
    return F.least(F.abs(d), F.abs(up - d), F.abs(d - down))


def nearest_multiple(measured: Column, calculated: Column, spacing: float = OLD_NEUTRON, reach: int = 4) -> Column:
    """The difference less the number of neutrons, from -reach to reach - 1, that leaves least of it; the
    difference itself, then the smaller number, among equals."""
    d = measured - calculated
    options = F.array(F.struct(F.abs(d).alias("size"), F.lit(-reach - 1).alias("order"), d.alias("left")), *(F.struct(F.abs(d - i * spacing).alias("size"), F.lit(i).alias("order"), (d - i * spacing).alias("left")) for i in range(-reach, reach)))
    return F.array_min(options)["left"]


def ppm_error(observed: Column, calculated: Column, spacing: float = NEUTRON) -> Column:
    """The folded mass error, without its sign, in millionths of the calculated mass."""
    return F.abs(mass_error(observed, calculated, spacing)) / calculated * 1e6


def protein_class(proteins: Column, reserve: str = "", train: str = "", test: str = "") -> Column:
    """reserve, train, test or target: the first kind whose prefix all proteins have that are of no
    earlier kind. A kind without a prefix does not occur."""
    out, left = None, proteins
    for kind, prefix in (("reserve", reserve), ("train", train), ("test", test)):
        if not prefix:
            continue
        left = _without(left, prefix)
        every = F.size(left) == 0
        out = F.when(every, F.lit(kind)) if out is None else out.when(every, F.lit(kind))
    return out.otherwise(F.lit("target")) if out is not None else F.lit("target")


def _without(proteins: Column, prefix: str) -> Column:
    return F.filter(proteins, lambda p: ~p.startswith(prefix))


def clean_names(proteins: Column, *prefixes: str) -> Column:
    """Distinct names, in order, that begin with none of the prefixes."""
    kept = F.transform(proteins, lambda p: F.trim(p))
    for prefix in filter(None, prefixes):
        kept = _without(kept, prefix)
    return F.array_distinct(kept)


def listed(names_: Column) -> Column:
    """{a,b,c}"""
    return F.concat(F.lit("{"), F.array_join(names_, ","), F.lit("}"))


def decoy_split(df: DataFrame, name: str, seq: str, shares: dict[str, float], seed: int = 9527) -> DataFrame:
    """Reversed sequences, each under one of the prefixes by shares of a hash of its name, so that every
    run and every partitioning deals them alike."""
    at = F.pmod(F.xxhash64(F.lit(seed), F.col(name)), F.lit(1_000_000)) / 1e6 * sum(shares.values())
    label, up = None, 0.0
    for prefix, share in shares.items():
        up += share
        label = F.when(at < up, F.lit(prefix)) if label is None else label.when(at < up, F.lit(prefix))
    return df.withColumn(name, F.concat(label.otherwise(F.lit(list(shares)[-1])), F.col(name))).withColumn(seq, F.reverse(seq))


def sample_name(spec_id: Column) -> Column:
    return F.substring_index(spec_id, ".", 1)


def rank_product(*ranks: Column) -> Column:
    """1 over the product of the ranks."""
    product = F.lit(1.0)
    for r in ranks:
        product = product * r
    return 1 / product


def agreement(*ranks: Column) -> Column:
    """A bit for each score (the first is 1) that puts the match first."""
    out = F.lit(0)
    for i, r in enumerate(ranks):
        out = out + F.when(r == 1, 1 << i).otherwise(0)
    return out


def modifications(peptide: Column, symbols: dict[str, float], residues: dict[str, float]) -> Column:
    """(position, mass) of each modified residue: a symbol stands after its residue, which counts; its
    mass is that of residue and symbol together."""
    table = lambda d: F.create_map(*(F.lit(x) for kv in d.items() for x in kv)) if d else F.create_map().cast("map<string,double>")
    each = F.regexp_extract_all(peptide, F.lit(r"([A-Za-z][^A-Za-z]*)"), F.lit(1))
    at = F.transform(each, lambda r, i: F.struct((i + 1).alias("position"), r.alias("r")))
    some = F.filter(at, lambda x: F.length(x["r"]) > 1)
    extra = lambda r: F.aggregate(F.split(F.substring(r, F.lit(2), F.length(r)), ""), F.lit(0.0), lambda s, c: s + F.coalesce(F.try_element_at(table(symbols), c), F.lit(0.0)))
    return F.transform(some, lambda x: F.struct(x["position"].alias("position"), (F.coalesce(F.try_element_at(table(residues), F.substring(x["r"], 1, 1)), F.lit(0.0)) + extra(x["r"])).alias("mass")))


def union_lists(a: Column, b: Column) -> Column:
    """All of a, then what b adds, each once."""
    return F.array_union(a, b)


def is_subset(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b)) == 0


def common_prefix(names_: list[str], default: str, least: int = 5) -> str:
    """The start that file names share, without its folder, a report ending and a last _ or point;
    ``default`` where it has fewer than ``least`` characters."""
    from os.path import commonprefix

    base = commonprefix(names_).rsplit("/", 1)[-1]
    base = default if len(base) < least else base.replace(".pep.txt", "_").replace(".tab", "_")
    return base[:-1] if base.endswith(("_", ".")) else base
