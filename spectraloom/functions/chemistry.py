"""The chemistry of a search: what residues and modification symbols consist of, and the isotopes of
the elements, from a configuration. One immutable table serves the masses of a digest, the fragments
of the scores and the envelopes of survey scans; it is small and travels to the tasks by pickling.

Peptides are letters, each with the symbols that follow it; a symbol before the first letter belongs
to it. A residue and its symbols are one composition, so a symbol may take atoms away (a deamidation
is one O more, one H and one N less). Characters that the configuration does not name are errors in
``atoms`` and ``token``; ``knows`` tells beforehand.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from spectraloom.functions.isotopes import convolve_peaks, power

#: Mass that a neutron adds on average, and where nitrogen is the labelled element.
SPACING, SPACING_N = 1.003355, 0.9991403
#: How many neutrons the counted heavy isotope of an element has more than its lightest.
NEUTRONS = {"C": 1, "H": 1, "O": 2, "N": 1, "P": 1, "S": 2}

# Elements of residues, ends and two common modifications (C, H, O, N, P, S; cysteine is
# blocked), and isotopes of the elements at natural abundance.
ELEMENTS = "CHONPS"
RESIDUES = {
    "Nterm": (0, 1, 0, 0, 0, 0), "Cterm": (0, 1, 1, 0, 0, 0),
    "A": (3, 5, 1, 1, 0, 0), "C": (5, 8, 2, 2, 0, 1), "D": (4, 5, 3, 1, 0, 0), "E": (5, 7, 3, 1, 0, 0),
    "F": (9, 9, 1, 1, 0, 0), "G": (2, 3, 1, 1, 0, 0), "H": (6, 7, 1, 3, 0, 0), "I": (6, 11, 1, 1, 0, 0),
    "J": (6, 11, 1, 1, 0, 0), "K": (6, 12, 1, 2, 0, 0), "L": (6, 11, 1, 1, 0, 0), "M": (5, 9, 1, 1, 0, 1),
    "N": (4, 6, 2, 2, 0, 0), "P": (5, 7, 1, 1, 0, 0), "Q": (5, 8, 2, 2, 0, 0), "R": (6, 12, 1, 4, 0, 0),
    "S": (3, 5, 2, 1, 0, 0), "T": (4, 7, 2, 1, 0, 0), "V": (5, 9, 1, 1, 0, 0), "W": (11, 10, 1, 2, 0, 0),
    "Y": (9, 9, 2, 1, 0, 0), "~": (0, 0, 1, 0, 0, 0), "!": (0, -1, 1, -1, 0, 0),
}
ISOTOPES = {
    "C": ((12.0, 13.003355), (0.9893, 0.0107)),
    "H": ((1.007825, 2.014102), (0.999885, 0.000115)),
    "O": ((15.994915, 16.999132, 17.999160), (0.99757, 0.00038, 0.00205)),
    "N": ((14.003074, 15.000109), (0.99632, 0.00368)),
    "P": ((30.973762,), (1.0,)),
    "S": ((31.972071, 32.971459, 33.967867, 34.967867, 35.967081), (0.9493, 0.0076, 0.0429, 0.0, 0.0002)),
}


def numbers(text: str) -> list[float]:
    return [float(x) for x in text.split(",") if x.strip()]


def named(config: dict[str, str], name: str) -> dict[str, str]:
    """The values of keys such as Name{key}, in whatever section, by key."""
    found = ((re.search(rf"{re.escape(name)}\{{(.+)\}}$", key), value) for key, value in config.items())
    return {m[1]: value for m, value in found if m}


@dataclass(frozen=True)
class Chemistry:
    residues: dict[str, tuple[int, ...]] = field(default_factory=lambda: dict(RESIDUES))
    isotopes: dict[str, tuple[tuple[float, ...], tuple[float, ...]]] = field(default_factory=lambda: dict(ISOTOPES))
    #: The labelled element.
    label: str = "C"
    _cache: dict = field(default_factory=dict, compare=False, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"_cache": {}}

    def __setstate__(self, state):
        self.__dict__.update(state)

    @classmethod
    def from_config(cls, config: dict[str, str]) -> Chemistry:
        """From keys Element_List, Residue{}, Element_Masses{} and Element_Percent{}, which must name
        every element listed, and SIP_Element. Elements that are not listed have no atoms."""
        listed = next((v for k, v in config.items() if k.endswith("Element_List")), ",".join(ELEMENTS))
        order = [e.strip() for e in listed.split(",") if e.strip()]
        masses, shares = ({e: tuple(numbers(v)) for e, v in named(config, f"Element_{kind}").items()} for kind in ("Masses", "Percent"))
        isotopes = dict(ISOTOPES)
        for e in order:
            if e not in masses or len(masses[e]) != len(shares.get(e, ())):
                raise ValueError(f"the configuration has no masses with as many percentages for element {e}")
            by = sorted(zip(masses[e], shares[e]))
            isotopes[e] = tuple(m for m, _ in by), tuple(p for _, p in by)
        residues = {}
        for name, value in named(config, "Residue").items():
            counts = dict(zip(order, map(int, numbers(value))))
            if len(numbers(value)) != len(order):
                raise ValueError(f"residue {name} has not as many counts as there are elements")
            residues[name] = tuple(counts.get(e, 0) for e in ELEMENTS)
        if missing := {"Nterm", "Cterm"} - residues.keys():
            raise ValueError(f"the configuration lacks {', '.join(sorted(missing))}")
        label = next((v for k, v in config.items() if k.endswith("SIP_Element")), "C") or "C"
        return cls(residues, isotopes, label)

    def labelled(self, element: str, share: float) -> Chemistry:
        """The share of an element's heaviest isotope set; its lightest takes the remainder."""
        masses, probs = self.isotopes[element]
        first = 1 - share - sum(probs[1:-1])
        if first < 0:
            raise ValueError(f"no share is left for the lightest isotope of {element}")
        return replace(self, isotopes=self.isotopes | {element: (masses, (first, *probs[1:-1], share))}, label=element, _cache={})

    @property
    def spacing(self) -> float:
        return SPACING_N if self.label == "N" else SPACING

    @property
    def letters(self) -> str:
        return "".join(r for r in self.residues if len(r) == 1 and r.isalpha())

    def knows(self, peptide: str) -> bool:
        return all(ch in self.residues for ch in peptide)

    def atoms(self, peptide: str) -> tuple[int, ...]:
        """Atoms of a whole peptide with its ends."""
        parts = [self.residues["Nterm"], self.residues["Cterm"], *(self.residues[ch] for ch in peptide)]
        return tuple(map(sum, zip(*parts)))

    def composed(self, counts, least: float = 1e-6):
        """Masses and probabilities of so many atoms of each element; none may be negative."""
        if min(counts) < 0:
            raise ValueError("a composition takes away atoms that are not there")
        total = power((0.0,), (1.0,), 0)
        for element, n in zip(ELEMENTS, counts):
            if n:
                total = convolve_peaks(*total, *power(*self.isotopes[element], n, least), least)
        return total

    def token(self, text: str):
        """The distribution of a residue with its symbols, or of an end."""
        if text not in self._cache:
            parts = [self.residues[text]] if text in self.residues else [self.residues[ch] for ch in text]
            self._cache[text] = self.composed(tuple(map(sum, zip(*parts))))
        return self._cache[text]

    def light(self, name: str) -> float:
        """The mass with every atom the lightest isotope; what a symbol takes away is negative."""
        return sum(n * self.isotopes[e][0][0] for e, n in zip(ELEMENTS, self.residues[name]))

    def shift(self, name: str) -> float:
        """What a symbol adds to a mass: its atoms as their most abundant isotopes."""
        tops = {e: masses[max(range(len(probs)), key=probs.__getitem__)] for e, (masses, probs) in self.isotopes.items()}
        return sum(n * tops[e] for e, n in zip(ELEMENTS, self.residues[name]))

    def masses(self) -> dict[str, float]:
        """The mass of each residue's most abundant isotopologue, and what each symbol adds."""
        out = {}
        for name, counts in self.residues.items():
            if len(name) == 1 and min(counts) >= 0:
                masses, probs = self.token(name)
                out[name] = float(masses[probs.argmax()])
            elif len(name) == 1:
                out[name] = self.shift(name)
        return out

    @property
    def water(self) -> float:
        """Both ends, as their most abundant isotopes."""
        return self.shift("Nterm") + self.shift("Cterm")

    def symbols(self, config: dict[str, str]) -> dict[str, str]:
        """Symbol -> residues (or ends, [ and ]) that it may modify, from keys such as PTM{~}; keys of several
        characters are losses (``elements.losses``). A symbol without a composition is an error."""
        out = {}
        for key, value in named(config, "PTM").items():
            if len(key) == 1:
                if key not in self.residues:
                    raise ValueError(f"the configuration has no composition for symbol {key}")
                out[key] = "".join(dict.fromkeys(ch for ch in value if ch.isalpha() or ch in "[]"))
        return out


#: Natural abundances, cysteine blocked.
REGULAR = Chemistry()
