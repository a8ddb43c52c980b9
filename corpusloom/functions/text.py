"""Text functions of columns. All are Catalyst expressions; null in, null out, unless said otherwise."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .labels import decode_labels

#: Oxidation numerals in brackets and the charges they stand for.
OXIDATION_STATES = {"(I)": "1+", "(II)": "2+", "(III)": "3+", "(IV)": "4+", "(V)": "5+", "(VI)": "6+", "(VII)": "7+", "(VIII)": "8+", "(IX)": "9+", "(X)": "10+"}
#: Unit words that keyword extraction leaves out.
UNIT_WORDS = ["bar", "cf", "cm", "et", "fg", "g", "ghz", "grit", "h", "k", "kda", "kg", "khz", "mah", "microg", "microl", "min", "mol", "mv", "nm", "pa", "ppm", "slpm", "u", "vol", "wt"]
#: Single words that are labels of their own.
ABBREVIATIONS = ["ercp", "tme", "crispr", "ct", "mri", "icu", "pcr"]
#: Labels too general to be concepts.
GENERIC_LABELS = [
    "patient", "patients", "study", "treatment", "therapy", "surgery", "cancer", "disease", "outcome", "risk factor", "complication", "mortality", "morbidity", "survival",
    "overall survival", "postoperative outcome", "postoperative complication", "adverse effect", "retrospective study", "prospective study", "systematic review", "meta analysis", "meta-analysis",
]
#: Patterns of the abstract cleaning steps, in the order in which they apply.
PATTERNS = {
    "non_ascii": r"[^\x00-\x7F]",
    "space": r"\s+",
    "roman_item": r"\s+(i|ii|iii|iv|v)[\.\)]",
    "letter_item": r"\s+[a-e][\.\)]\s",
    "authors": r"(?i)authors.*abstract",
    "introduction": r"(?i)i(\s*)ntroduction.*",
    "braced_script": r"\{su[bp]\s*([^}]+)\}",
    "tagged_script": r"<sup>([^<]+)</sup>|<sub>([^<]+)</sub>",
    "temperature": r"\s+\d+(\.\d+)?\s*o?\s*[CK]",
    "number_range": r"\s(\d+)-(\d+)\s",
    "brackets": r"[\(\)\[\]\|]",
    "plural_abbreviation": r"[\s\(][A-Z]+s[\s\)\.,;]",
}


def drop(text: Column, pattern: str) -> Column:
    """``text`` without what the named pattern matches."""
    return F.regexp_replace(text, PATTERNS[pattern], "")


def strip(text: Column) -> Column:
    """``text`` without white space of any kind at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def drop_non_ascii(text: Column) -> Column:
    return drop(text, "non_ascii")


def collapse_space(text: Column) -> Column:
    """Runs of white space become one blank."""
    return F.regexp_replace(text, PATTERNS["space"], " ")


def normalized_space(text: Column) -> Column:
    return F.trim(collapse_space(text))


def drop_enumerations(text: Column) -> Column:
    """Without list marks such as `` ii)`` and `` b. ``."""
    return drop(drop(text, "roman_item"), "letter_item")


def drop_word(text: Column, word: str) -> Column:
    """Without ``word``, whatever its case."""
    return F.regexp_replace(text, f"(?i){word}", "")


def cut_introduction(text: Column) -> Column:
    """What stands before the first "introduction" of its line."""
    return drop(text, "introduction")


def oxidation_to_charge(text: Column) -> Column:
    return reduce(lambda c, pair: F.replace(c, F.lit(pair[0]), F.lit(pair[1])), OXIDATION_STATES.items(), text)


def drop_brackets(text: Column) -> Column:
    return F.translate(text, "()[]|", "")


def unwrap_scripts(text: Column) -> Column:
    """Super- and subscripts in braces or tags, as plain text."""
    return F.regexp_replace(F.regexp_replace(text, PATTERNS["braced_script"], "$1"), PATTERNS["tagged_script"], "$1$2")


def basic_cleaning(text: Column) -> Column:
    return strip(drop_enumerations(collapse_space(drop_non_ascii(text))))


def section_cleaning(text: Column) -> Column:
    return cut_introduction(drop_word(drop_word(drop(text, "authors"), "abstract"), "acknowledgements"))


def formula_cleaning(text: Column) -> Column:
    bare = drop(drop(unwrap_scripts(text), "temperature"), "number_range")
    return drop(drop_brackets(oxidation_to_charge(bare)), "plural_abbreviation")


def clean_abstract(text: Column) -> Column:
    """The whole cleaning of an abstract, as one expression."""
    return strip(collapse_space(formula_cleaning(section_cleaning(basic_cleaning(text)))))


def title_and_abstract(title: Column, abstract: Column) -> Column:
    """``title. abstract``; null if either is."""
    return F.concat(title, F.lit(". "), abstract)


def last_path_part(url: Column) -> Column:
    return F.regexp_extract(url, r"/([^/]*)$", 1)


def first_or_empty(items: Column) -> Column:
    """The first item of an array, or empty text if there is none."""
    return F.coalesce(F.get(items, 0), F.lit(""))


def text_from_positions(index: Column) -> Column:
    """Text of an inverted index (map of word to positions); gaps are single blanks, of two words at a place the greater stays."""
    placed = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("at"), e["key"].alias("word")))))
    last = F.array_max(F.transform(placed, lambda x: x["at"]))
    at = F.map_from_entries(F.transform(F.array_distinct(F.transform(placed, lambda x: x["at"])), lambda p: F.struct(p, F.array_max(F.filter(placed, lambda x: x["at"] == p))["word"])))
    words = F.transform(F.sequence(F.lit(0), last), lambda i: F.coalesce(F.try_element_at(at, i), F.lit(" ")))
    return F.when(F.size(placed) > 0, F.regexp_replace(F.array_join(words, " "), r"[\n\r]", " ")).otherwise(F.lit(""))


def author_keywords(text: Column) -> Column:
    """Keywords after the last "Keywords", split at commas if they outnumber semicolons, else at semicolons; empty without any."""
    tail = F.element_at(F.split(text, "Keywords", -1), -1)
    commas = F.length(tail) - F.length(F.replace(tail, F.lit(",")))
    semicolons = F.length(tail) - F.length(F.replace(tail, F.lit(";")))
    parts = F.when(commas > semicolons, F.split(tail, ",", -1)).otherwise(F.split(tail, ";", -1))
    stripped = F.transform(parts, lambda p: F.regexp_replace(p, r"^[.;,: ]+|[.;,: ]+$", ""))
    return F.when(text.contains("Keywords"), stripped).otherwise(F.array().cast("array<string>"))


def keyword_ready(text: Column) -> Column:
    """Lower-case letters and blanks only, without unit words."""
    letters = F.regexp_replace(F.regexp_replace(F.lower(text), r"[\.,;]", " "), r"[^a-z\s]", "")
    words = F.split(strip(collapse_space(letters)), " ", -1)
    return F.array_join(F.filter(words, lambda w: (w != "") & ~w.isin(UNIT_WORDS)), " ")


def scored_concepts(items: Column, score: float = 0.5, level: int = 1) -> Column:
    """Names of (name, level, score) entries above ``score`` and at ``level`` or deeper."""
    return F.transform(F.filter(items, lambda c: (c["score"] > score) & (c["level"] >= level)), lambda c: c["name"])


def parse_scored_concepts(text: Column) -> Column:
    """Entries of a stringified list of (name, level, score) tuples; an empty array where there is none."""
    found = F.regexp_extract_all(text, F.lit(r"\((?:'[^']*'|\"[^\"]*\"), -?\d+, -?[0-9.eE+-]+\)"), F.lit(0))
    return F.transform(
        F.coalesce(found, F.array().cast("array<string>")),
        lambda t: F.struct(
            F.regexp_extract(t, r"^\((?:'|\")(.*)(?:'|\"), -?\d+, ", 1).alias("name"),
            F.regexp_extract(t, r", (-?\d+), [^,]*\)$", 1).cast("int").alias("level"),
            F.regexp_extract(t, r", ([^,]*)\)$", 1).cast("double").alias("score"),
        ),
    )


def parse_label_list(text: Column) -> Column:
    """Array of a serialized list: a JSON array, a JSON object with it under ``concepts``, or a Python list; empty for null and blank, null for what is none of these."""
    plain = strip(F.coalesce(text, F.lit("")))
    python = plain.rlike(r"^\[\s*(?:'|\"|\])") & plain.endswith("]")
    listed = python | F.from_json(plain, "array<string>").isNotNull() & plain.startswith("[") | plain.startswith("{") & plain.endswith("}")
    return F.when(plain == "", F.array().cast("array<string>")).when(listed, decode_labels(plain))


def normalize_labels(labels: Column, most: int = 12) -> Column:
    """Lower case, single blanks; generic labels and those outside two to six words left out, but for known abbreviations; distinct, at most ``most``."""
    lowered = F.transform(F.filter(labels, lambda c: c.isNotNull()), lambda c: normalized_space(F.lower(c)))
    words = lambda c: F.size(F.split(c, " "))
    kept = F.filter(lowered, lambda c: (c != "") & ~c.isin(GENERIC_LABELS) & (c.isin(ABBREVIATIONS) | words(c).between(2, 6)))
    return F.slice(F.array_distinct(kept), 1, most)


def repair_list_reply(text: Column) -> Column:
    """Items of the first bracketed list in a free reply; quotes dropped, cut at the first closing bracket, or at the last comma where that is missing."""
    line = F.get(F.filter(F.transform(F.split(text, "\n", -1), strip), lambda x: x != ""), 0)
    ended = F.when(line.contains("]"), F.regexp_extract(line, r"^([^\]]*\])", 1)).otherwise(F.concat(F.regexp_extract(line, r"^(.*),", 1), F.lit("]")))
    inner = F.regexp_extract(ended, r"\[([^\]]+)\]", 1)
    items = F.transform(F.split(inner, ",", -1), lambda x: F.regexp_replace(strip(x), r"^['\"]|['\"]$", ""))
    return F.filter(items, lambda x: x != "")


def normalize_spelling(labels: Column) -> Column:
    return F.transform(labels, lambda c: F.replace(F.regexp_replace(F.lower(c), "[/-]", " "), F.lit("aluminum"), F.lit("aluminium")))


def valid_file_name(name: Column) -> Column:
    """ASCII letters that any file system takes, blanks as hyphens, at most 255."""
    ascii_only = F.translate(drop_non_ascii(name), '<>:"/\\|?*', "")
    return F.translate(F.substring(F.regexp_replace(ascii_only, r"^[. ]+|[. ]+$", ""), 1, 255), " ", "-")


def author_of_file(path: Column) -> Column:
    return F.initcap(F.replace(F.split_part(path, F.lit("."), F.lit(1)), F.lit("_"), F.lit(" ")))


def estimated_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor((F.octet_length(text) + 3) / 4).cast("int"))


def contains_ignoring_case(text: Column, part: Column) -> Column:
    return F.contains(F.lower(text), F.lower(part))


def positions_of_sequence(tokens: Column, wanted: Column) -> Column:
    """0-based places at which the array ``wanted`` stands in the array ``tokens``; none for an empty ``wanted``."""
    last = F.size(tokens) - F.size(wanted)
    return F.when((F.size(wanted) > 0) & (last >= 0), F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.slice(tokens, i + 1, F.size(wanted)) == wanted)).otherwise(F.array().cast("array<int>"))


def windows_of(tokens: Column, length: int = 510) -> Column:
    """Consecutive parts of at most ``length`` items; none for an empty array."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(tokens), F.lit(1)), F.lit(length))
    return F.when(F.size(tokens) > 0, F.transform(starts, lambda i: F.slice(tokens, i, length))).otherwise(F.array(F.array().cast("array<string>")).cast("array<array<string>>"))


def split_list(text: Column) -> Column:
    """Stripped non-empty parts of a list joined by commas, line breaks, semicolons or bars."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"[,\n;|]+", -1), strip), lambda x: x != "")


def initial_section(lines: Column) -> Column:
    """The section a LaTeX line opens, or null."""
    return F.nullif(F.regexp_extract(lines, r"^\\section\{(.+?)\}", 1), F.lit(""))
