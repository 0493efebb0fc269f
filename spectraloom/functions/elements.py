"""Atoms of peptides, and masses by atoms and enrichment, as column functions and in numpy.

Compositions and isotopes come from a ``Chemistry``. A whole peptide has both of its ends as well.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spectraloom.functions.chemistry import ELEMENTS, NEUTRONS, REGULAR, Chemistry, named
from spectraloom.functions.isotopes import convolve_peaks, power


def atom_counts(peptide: Column, chemistry: Chemistry = REGULAR) -> Column:
    """A struct of the atoms c, h, o, n, p, s of a peptide with its ends: each residue and symbol is
    counted once, whatever the length of the table; other characters have no atoms."""
    singles = {r: counts for r, counts in chemistry.residues.items() if len(r) == 1}
    n = {r: F.length(peptide) - F.length(F.replace(peptide, F.lit(r), F.lit(""))) for r in singles}
    total = []
    for k, e in enumerate(ELEMENTS):
        s = F.lit(chemistry.residues["Nterm"][k] + chemistry.residues["Cterm"][k])
        for r, counts in singles.items():
            if counts[k]:
                s = s + n[r] * counts[k]
        total.append(s.cast("int").alias(e.lower()))
    return F.struct(*total)


def known(peptide: Column, chemistry: Chemistry = REGULAR) -> Column:
    """Whether the configuration names every character of a peptide."""
    singles = "".join(r for r in chemistry.residues if len(r) == 1)
    return F.translate(peptide, singles, "") == ""


def base_mass(atoms: Column, chemistry: Chemistry = REGULAR) -> Column:
    """The mass with every atom the lightest isotope."""
    total = F.lit(0.0)
    for e in ELEMENTS:
        total = total + atoms[e.lower()] * chemistry.isotopes[e][0][0]
    return total


def _weighted(pairs: list) -> Column:
    over, under = F.lit(0.0), F.lit(0.0)
    for value, weight in pairs:
        over, under = over + value * weight, under + weight
    return over / under


def neutron_mass(atoms: Column, chemistry: Chemistry = REGULAR) -> Column:
    """The mean mass that a heavy isotope adds for each neutron, over the atoms by their abundance: the
    steps to the first two heavier isotopes of each element."""
    parts = []
    for e in ELEMENTS:
        masses, probs = chemistry.isotopes[e]
        steps = [(masses[k] - masses[k - 1], probs[k]) for k in range(1, min(len(masses), 3))]
        weight = sum(w for _, w in steps)
        if weight:
            parts.append((sum(d * w for d, w in steps) / weight, atoms[e.lower()] * weight))
    return _weighted(parts)


def precursor_mass(atoms: Column, chemistry: Chemistry = REGULAR) -> Column:
    """The mass of the most likely number of neutrons: those of the labelled element and of carbon,
    rounded (down where nitrogen is labelled), each as heavy as ``neutron_mass``."""
    e = chemistry.label
    many = atoms[e.lower()] * NEUTRONS[e] * chemistry.isotopes[e][1][NEUTRONS[e]]
    if e != "C":
        many = many + atoms["c"] * chemistry.isotopes["C"][1][1]
    return base_mass(atoms, chemistry) + (F.floor(many) if e == "N" else F.round(many)) * neutron_mass(atoms, chemistry)


def peptide_mass(peptide: Column, chemistry: Chemistry = REGULAR) -> Column:
    """As ``precursor_mass`` of the letters of a peptide, and the shift of each of its symbols; null where
    the configuration does not name a character. What masses, neutrons and their weights sum to is
    looked up by character, in one pass."""
    e = chemistry.label
    steps = {x: [(m[k] - m[k - 1], p[k]) for k in range(1, min(len(m), 3))] for x, (m, p) in chemistry.isotopes.items()}
    share = {x: chemistry.isotopes[x][1][1] if x == "C" else 0.0 for x in ELEMENTS} | {e: NEUTRONS[e] * chemistry.isotopes[e][1][NEUTRONS[e]]}

    def parts(name: str) -> tuple[float, float, float, float]:
        """Mass, neutrons, and the sums of weighted steps and of weights."""
        if len(name) == 1 and not name.isalpha():
            return chemistry.shift(name), 0.0, 0.0, 0.0
        counts = dict(zip(ELEMENTS, chemistry.residues[name]))
        over = sum(n * sum(d * w for d, w in steps[x]) for x, n in counts.items())
        return chemistry.light(name), sum(n * share[x] for x, n in counts.items()), over, sum(n * sum(w for _, w in steps[x]) for x, n in counts.items())

    fields = ("m", "k", "o", "u")
    packed = lambda values: F.struct(*(F.lit(float(v)).alias(f) for v, f in zip(values, fields)))
    table = F.create_map(*(x for r in chemistry.residues if len(r) == 1 for x in (F.lit(r), packed(parts(r)))))
    ends = packed([a + b for a, b in zip(parts("Nterm"), parts("Cterm"))])
    letters = F.filter(F.split(peptide, ""), lambda ch: ch != "")
    found = F.transform(letters, lambda ch: F.try_element_at(table, ch))

    def add(total, one):
        return F.struct(*((total[f] + one[f]).alias(f) for f in fields))

    def mass(total):
        many = F.floor(total["k"]) if e == "N" else F.round(total["k"])
        return total["m"] + many * F.coalesce(F.try_divide(total["o"], total["u"]), F.lit(0.0))

    return F.aggregate(found, ends, add, mass)


def distribution(atoms: dict[str, int], chemistry: Chemistry = REGULAR, least: float = 1e-6):
    """Masses and probabilities of so many atoms; counts may be negative, which takes atoms away from a
    distribution that has them (see ``apart``)."""
    table = chemistry.isotopes
    total = power((0.0,), (1.0,), 0)
    for e, n in atoms.items():
        if n > 0:
            total = convolve_peaks(*total, *power(*table[e], n, least), least)
    for e, n in atoms.items():
        for _ in range(-min(n, 0)):
            total = apart(*total, *table[e], least)
    return total


def apart(masses, probs, atom_masses, atom_probs, least: float = 1e-6):
    """A distribution with one atom less: its probabilities divided, as polynomials in whole neutrons,
    by those of the atom; masses shift by the atom's lightest and keep their spacing."""
    import numpy as np

    steps = np.zeros(round(atom_masses[-1] - atom_masses[0]) + 1)
    for m, p in zip(atom_masses, atom_probs):
        steps[round(m - atom_masses[0])] += p
    whole = np.zeros(round(masses[-1] - masses[0]) + 1)
    np.add.at(whole, np.round(masses - masses[0]).astype(int), probs)
    out = np.zeros(max(len(whole) - len(steps) + 1, 1))
    left = whole.copy()
    for k in range(len(out)):
        out[k] = left[k] / steps[0]
        n = min(len(steps), len(left) - k)
        left[k : k + n] -= out[k] * steps[:n]
    spacing = (masses[-1] - masses[0]) / max(len(whole) - 1, 1)
    keep = out >= least
    return (masses[0] - atom_masses[0] + np.arange(len(out)) * spacing)[keep], out[keep] / out[keep].sum()


def most_abundant(masses: Column, probs: Column) -> Column:
    """The mass of the largest probability, the smaller mass among equals."""
    return F.array_max(F.zip_with(probs, masses, lambda p, m: F.struct(p.alias("p"), (-m).alias("m"))))["m"] * -1


def average_mass(masses: Column, probs: Column) -> Column:
    over = F.aggregate(F.zip_with(masses, probs, lambda m, p: m * p), F.lit(0.0), lambda s, x: s + x)
    return over / F.aggregate(probs, F.lit(0.0), lambda s, x: s + x)


def lowest_mass(masses: Column) -> Column:
    return F.array_min(masses)


def scaled_to_top(probs: Column) -> Column:
    """Probabilities as shares of the largest."""
    return F.transform(probs, lambda p: p / F.array_max(probs))


def averagine(length: int, chemistry: Chemistry = REGULAR, least: float = 1e-6):
    """The distribution of a peptide of mean composition: the mean of the residues' atoms (each letter
    once), rounded, for every residue, and both ends."""
    letters = [chemistry.residues[r] for r in chemistry.letters if r != "J"]
    ends = [sum(x) for x in zip(chemistry.residues["Nterm"], chemistry.residues["Cterm"])]
    each = [round(sum(counts) / len(letters)) for counts in zip(*letters)]
    return distribution({e: n * length + end for e, n, end in zip(ELEMENTS, each, ends)}, chemistry, least)


def symbol_table(config: dict[str, str]) -> dict[str, tuple[str, float]]:
    """From a configuration, symbol -> (residues that it modifies, mass shift): see ``Chemistry.symbols``."""
    chemistry = Chemistry.from_config(config)
    return {symbol: (residues, chemistry.shift(symbol)) for symbol, residues in chemistry.symbols(config).items()}


def losses(config: dict[str, str]) -> dict[str, str]:
    """Symbols that are replaced, or removed, for scoring: from keys such as PTM{>to1} and PTM{<to}."""
    out = {}
    for key in named(config, "PTM"):
        if len(key) > 1:
            if key[1:3] != "to" or len(key) > 4:
                raise ValueError(f"PTM{{{key}}} is neither a symbol nor a loss")
            out[key[0]] = key[3:]
    return out
