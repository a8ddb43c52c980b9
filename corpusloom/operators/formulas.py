"""Chemical formulas in running text: joining of their parts, and names of elements."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.predicates import FALSE_FORMULAS
from corpusloom.session import spread

#: Symbols of the elements and their names, by atomic number.
ELEMENT_NAMES = {
    "H": "hydrogen", "He": "helium", "Li": "lithium", "Be": "beryllium", "B": "boron", "C": "carbon", "N": "nitrogen", "O": "oxygen", "F": "fluorine",
    "Ne": "neon", "Na": "sodium", "Mg": "magnesium", "Al": "aluminium", "Si": "silicon", "P": "phosphorus", "S": "sulfur", "Cl": "chlorine", "Ar": "argon",
    "K": "potassium", "Ca": "calcium", "Sc": "scandium", "Ti": "titanium", "V": "vanadium", "Cr": "chromium", "Mn": "manganese", "Fe": "iron", "Co": "cobalt",
    "Ni": "nickel", "Cu": "copper", "Zn": "zinc", "Ga": "gallium", "Ge": "germanium", "As": "arsenic", "Se": "selenium", "Br": "bromine", "Kr": "krypton",
    "Rb": "rubidium", "Sr": "strontium", "Y": "yttrium", "Zr": "zirconium", "Nb": "niobium", "Mo": "molybdenum", "Tc": "technetium", "Ru": "ruthenium", "Rh": "rhodium",
    "Pd": "palladium", "Ag": "silver", "Cd": "cadmium", "In": "indium", "Sn": "tin", "Sb": "antimony", "Te": "tellurium", "I": "iodine", "Xe": "xenon",
    "Cs": "caesium", "Ba": "barium", "La": "lanthanum", "Ce": "cerium", "Pr": "praseodymium", "Nd": "neodymium", "Pm": "promethium", "Sm": "samarium", "Eu": "europium",
    "Gd": "gadolinium", "Tb": "terbium", "Dy": "dysprosium", "Ho": "holmium", "Er": "erbium", "Tm": "thulium", "Yb": "ytterbium", "Lu": "lutetium", "Hf": "hafnium",
    "Ta": "tantalum", "W": "tungsten", "Re": "rhenium", "Os": "osmium", "Ir": "iridium", "Pt": "platinum", "Au": "gold", "Hg": "mercury", "Tl": "thallium",
    "Pb": "lead", "Bi": "bismuth", "Po": "polonium", "At": "astatine", "Rn": "radon", "Fr": "francium", "Ra": "radium", "Ac": "actinium", "Th": "thorium",
    "Pa": "protactinium", "U": "uranium", "Np": "neptunium", "Pu": "plutonium", "Am": "americium", "Cm": "curium", "Bk": "berkelium", "Cf": "californium", "Es": "einsteinium",
    "Fm": "fermium", "Md": "mendelevium", "No": "nobelium", "Lr": "lawrencium", "Rf": "rutherfordium", "Db": "dubnium", "Sg": "seaborgium", "Bh": "bohrium", "Hs": "hassium",
    "Mt": "meitnerium", "Ds": "darmstadtium", "Rg": "roentgenium", "Cn": "copernicium", "Nh": "nihonium", "Fl": "flerovium", "Mc": "moscovium", "Lv": "livermorium", "Ts": "tennessine",
    "Og": "oganesson",
}
#: Symbols that are words too and are not replaced by names.
WORD_SYMBOLS = ("As", "At", "In")

_SYMBOLS = "|".join(sorted(ELEMENT_NAMES, key=lambda s: (-len(s), s)))
_LEXEME = re.compile(rf"(?P<E>{_SYMBOLS})|(?P<N>\d+(?:\.\d+)?\+?)|(?P<S>[-+/])|(?P<W> )|(?P<D>[.,])|(?P<C>.)", re.S)
#: Symbols that belong together, over the letters of the lexemes: numbers follow with or without blanks, symbols with blanks or a hyphen between.
_TOGETHER = "E(?:[EN]|-E|W++(?:N[NW]*+)?E)*"
#: Parts of a text over the letters of its lexemes. Other letters make a word of what they touch; numbers behind a blank go to the formula, and the blank stays behind it.
_PARTS = re.compile(rf"(?P<C>(?:{_TOGETHER})?C[CE]*)|(?P<E>{_TOGETHER}(?P<behind>W++N[NW]*+)?)|(?P<N>N(?:/N)*)|(?P<W>W+)|(?P<S>[-+/])|(?P<D>D)")
_LEFT_OUT = frozenset(" -")


def formula_parts_of(text: str) -> list[tuple[str, str]]:
    """(kind, text) of the parts of a text with the pieces of formulas joined: ``Fe3 O`` and ``Fe-O`` are one each.

    Kinds: E formula, N number, S sign, W blank, D stop, C word.
    """
    found = [(m.lastgroup, m[0]) for m in _LEXEME.finditer(text)]
    parts = []
    for m in _PARTS.finditer("".join(t if k == "S" else k for k, t in found)):
        pieces = [t for _, t in found[m.start() : m.end()]]
        kind = "E" if m["E"] else m.lastgroup
        if kind in "EC":
            pieces = [t for t in pieces if t not in _LEFT_OUT]
        parts.append((kind, " " if kind == "W" else "".join(pieces)))
        if m["behind"] and not (m.end() < len(found) and found[m.end()][0] == "W"):
            parts.append(("W", " "))
    return parts


def formulas_in(text: str) -> set[str]:
    return {t for k, t in formula_parts_of(text) if k == "E"}


def extract_formulas(df: DataFrame, text: str, out_text: str = "abstract", out: str = "elements") -> DataFrame:
    """``df`` with the text in which formulas are joined and with the sorted formulas without false ones; nulls stay null."""
    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in df.columns if c not in (out, out_text)), f"`{out_text}` string", f"`{out}` array<string>"])
    kept = [c for c in df.columns if c not in (out, out_text)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = [None if t is None else formula_parts_of(t) for t in batch[text]]
            frame = batch[kept].copy()
            frame[out_text] = [None if p is None else "".join(t for _, t in p) for p in parts]
            frame[out] = [None if p is None else sorted({t for k, t in p if k == "E"} - set(FALSE_FORMULAS)) for p in parts]
            yield frame

    return spread(df).mapInPandas(run, schema)


def name_elements(labels: Column, formulas: Column) -> Column:
    """``labels`` with element symbols standing as words replaced by names, sorted and distinct.

    Symbols of one letter are replaced only if they are among ``formulas``; those that are words too never.
    """
    names = {s: n for s, n in ELEMENT_NAMES.items() if s not in WORD_SYMBOLS}
    table = F.create_map(*(F.lit(x) for s, n in sorted(names.items()) for x in (s.lower(), n)))
    single = F.transform(F.filter(formulas, lambda f: F.length(f) == 1), F.lower)
    word = lambda w: F.when((F.length(w) > 1) | F.array_contains(single, w), F.coalesce(F.try_element_at(table, w), w)).otherwise(w)
    return F.array_sort(F.array_distinct(F.transform(labels, lambda c: F.array_join(F.transform(F.split(c, " ", -1), word), " "))))
