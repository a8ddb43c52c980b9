"""Queries of the text, date and filter functions."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from corpusloom.functions import dates as D
from corpusloom.functions import predicates as P
from corpusloom.functions import text as T
from corpusloom.operators.formulas import extract_formulas, name_elements
from corpusloom.operators.keyphrases import extract_phrases
from corpusloom.sources.readers import latex_sections

from .registry import Registry
from .views import LABELS, label_lists

q = Registry()

#: Fragments that the corpus lacks, so that every cleaning step has something to do.
FRAGMENTS = [" Cd<sub>3</sub> ", " {sup 5}D ", " at 1500 oC ", " of 10-20 mm ", " Fe(IV) ", " Introduction to it", " Authors: A. B. Abstract ", " PLDs, ", " i) one b. two ", " a|b [c] (d) "]
DOCS = "docs AS (SELECT doc_id, CASE " + " ".join(f"WHEN doc_id % {len(FRAGMENTS)} = {i} THEN text || '{f}'" for i, f in enumerate(FRAGMENTS)) + " END AS abstract FROM documents)"


def docs(t):
    pieces = F.element_at(F.array(*map(F.lit, FRAGMENTS)), (F.col("doc_id") % len(FRAGMENTS) + 1).cast("int"))
    return t("documents").select("doc_id", F.concat("text", pieces).alias("abstract"))


def _sql(column: str) -> str:
    return f"WITH {DOCS} SELECT doc_id, {column} AS cleaned FROM docs"


def _rx(text: str, pattern: str, into: str = "", flags: str = "g") -> str:
    return f"regexp_replace({text}, '{pattern}', '{into}', '{flags}')"


_ASCII = _rx("abstract", r"[^\x00-\x7F]")
_SPACE = _rx(_ASCII, r"\s+", " ")
_ENUM = _rx(_rx(_SPACE, r"\s+(i|ii|iii|iv|v)[\.\)]"), r"\s+[a-e][\.\)]\s")
_BASIC = _rx(_ENUM, r"^\s+|\s+$")


def _sections(x: str) -> str:
    return _rx(_rx(_rx(_rx(x, r"(?i)authors.*abstract"), "(?i)abstract"), "(?i)acknowledgements"), r"(?i)i(\s*)ntroduction.*")


def _scripts(x: str) -> str:
    return _rx(_rx(x, r"\{su[bp]\s*([^}]+)\}", r"\1"), "<sup>([^<]+)</sup>|<sub>([^<]+)</sub>", r"\1\2")


def _charges(x: str) -> str:
    for numeral, charge in T.OXIDATION_STATES.items():
        x = f"replace({x}, '{numeral}', '{charge}')"
    return x


def _formulas(x: str) -> str:
    bare = _rx(_rx(_scripts(x), r"\s+\d+(\.\d+)?\s*o?\s*[CK]"), r"\s(\d+)-(\d+)\s")
    return _rx(f"translate({_charges(bare)}, '()[]|', '')", r"[\s\(][A-Z]+s[\s\)\.,;]")


def _step(name: str, function, sql: str) -> None:
    q(name, _sql(sql))(lambda t, s, d: docs(t).select("doc_id", function(F.col("abstract")).alias("cleaned")))


_A = "abstract"
_step("txt1_drop_non_ascii", T.drop_non_ascii, _ASCII)
_step("txt2_collapse_space", lambda c: T.normalized_space(T.drop_non_ascii(c)), f"trim({_SPACE})")
_step("txt3_drop_enumerations", lambda c: T.drop_enumerations(T.collapse_space(T.drop_non_ascii(c))), _ENUM)
_step("txt4_drop_authors", lambda c: T.drop(T.basic_cleaning(c), "authors"), _rx(_BASIC, r"(?i)authors.*abstract"))
_step("txt5_drop_word", lambda c: T.drop_word(c, "abstract"), _rx(_A, "(?i)abstract"))
_step("txt6_cut_introduction", lambda c: T.cut_introduction(T.basic_cleaning(c)), _rx(_BASIC, r"(?i)i(\s*)ntroduction.*"))
_step("txt7_oxidation_states", T.oxidation_to_charge, _charges(_A))
_step("txt8_drop_brackets", T.drop_brackets, "translate(abstract, '()[]|', '')")
_step("txt9_drop_plural_abbreviations", lambda c: T.drop(T.basic_cleaning(c), "plural_abbreviation"), _rx(_BASIC, r"[\s\(][A-Z]+s[\s\)\.,;]"))
_step("txt10_unwrap_scripts", T.unwrap_scripts, _scripts(_A))
_step("txt11_drop_temperatures", lambda c: T.drop(T.basic_cleaning(c), "temperature"), _rx(_BASIC, r"\s+\d+(\.\d+)?\s*o?\s*[CK]"))
_step("txt12_drop_number_ranges", lambda c: T.drop(T.basic_cleaning(c), "number_range"), _rx(_BASIC, r"\s(\d+)-(\d+)\s"))
_step("txt13_clean_abstract", T.clean_abstract, _rx(_rx(_formulas(_sections(_BASIC)), r"\s+", " "), r"^\s+|\s+$"))


@q("txt14_title_and_abstract", "SELECT id, display_name || '. ' || abstract AS text FROM materials_science_works")
def _(t, s, d):
    return t("materials_science_works").select("id", T.title_and_abstract(F.col("display_name"), F.col("abstract")).alias("text"))


@q("txt15_inverted_index", r"""SELECT id, regexp_replace(array_to_string(list_transform(string_split(display_name, ' '), lambda x: x), ' '), '[\n\r]', ' ', 'g') AS text
FROM journal_sources""")
def _(t, s, d):
    """Names are turned into inverted indexes and back."""
    words = F.split("display_name", " ", -1)
    index = F.map_from_entries(F.transform(F.array_distinct(words), lambda w: F.struct(w, F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.get(words, i) == w))))
    return t("journal_sources").select("id", T.text_from_positions(F.when(F.col("display_name").isNotNull(), index)).alias("text"))


@q("txt16_last_path_part", "SELECT id, regexp_extract('https://example.org/' || id, '/([^/]*)$', 1) AS short FROM materials_science_works")
def _(t, s, d):
    return t("materials_science_works").select("id", T.last_path_part(F.concat(F.lit("https://example.org/"), "id")).alias("short"))


@q("txt17_row_converter", "SELECT lower(trim(source_type)) AS source_type, upper(id) AS id, coalesce(works_count, 0) AS works_count FROM journal_sources")
def _(t, s, d):
    convert = {"id": F.upper("id"), "source_type": F.lower(F.trim("source_type")), "works_count": F.coalesce("works_count", F.lit(0))}
    return t("journal_sources").withColumns(convert).select("source_type", "id", "works_count")


@q("txt18_first_alternate_title", """SELECT id, coalesce(from_json(CASE WHEN json_valid(alternate_titles) THEN alternate_titles END, '["VARCHAR"]')[1], '') AS first_title FROM journal_sources""")
def _(t, s, d):
    return t("journal_sources").select("id", T.first_or_empty(F.from_json("alternate_titles", "array<string>")).alias("first_title"))


_KEYWORDS = "keyed AS (SELECT doc_id, abstract || CASE doc_id % 3 WHEN 0 THEN ' Keywords: steel, wear; creep, .' WHEN 1 THEN ' Keywords a; b; c' ELSE '' END AS text FROM docs)"


def _keyed(t):
    tail = F.element_at(F.array(F.lit(" Keywords: steel, wear; creep, ."), F.lit(" Keywords a; b; c"), F.lit("")), (F.col("doc_id") % 3 + 1).cast("int"))
    return docs(t).select("doc_id", F.concat("abstract", tail).alias("text"))


_TAIL = "string_split(text, 'Keywords')[-1]"


@q("txt21_author_keywords", f"""WITH {DOCS}, {_KEYWORDS} SELECT doc_id, CASE WHEN text IS NULL THEN '' WHEN contains(text, 'Keywords') THEN
  array_to_string(list_transform(string_split({_TAIL}, CASE WHEN length({_TAIL}) - length(replace({_TAIL}, ',', '')) > length({_TAIL}) - length(replace({_TAIL}, ';', '')) THEN ',' ELSE ';' END),
  lambda x: regexp_replace(x, '^[.;,: ]+|[.;,: ]+$', '', 'g')), '/') ELSE '' END AS keywords FROM keyed""")
def _(t, s, d):
    return _keyed(t).select("doc_id", F.coalesce(F.array_join(T.author_keywords(F.col("text")), "/"), F.lit("")).alias("keywords"))


_READY = _rx(_rx(r"regexp_replace(lower(abstract), '[\.,;]', ' ', 'g')", r"[^a-z\s]"), r"\s+", " ")


@q("txt22_keyword_ready", f"WITH {DOCS} SELECT doc_id, array_to_string(list_filter(string_split(trim({_READY}), ' '), lambda w: w <> '' AND w NOT IN ({', '.join(repr(w) for w in T.UNIT_WORDS)})), ' ') AS words FROM docs")
def _(t, s, d):
    return docs(t).select("doc_id", T.keyword_ready(F.col("abstract")).alias("words"))


@q("txt23_ranked_phrases")
def _(t, s, d):
    return extract_phrases(docs(t).select("doc_id", T.keyword_ready(F.col("abstract")).alias("text")), "doc_id", "text")


_SCORED_ITEMS = r"""items AS (SELECT id, list_transform(regexp_extract_all(concepts, '\(''[^'']*'', -?\d+, -?[0-9.eE+-]+\)'),
  lambda x: {'name': regexp_extract(x, '^\(''(.*)'', -?\d+, ', 1), 'level': CAST(regexp_extract(x, ', (-?\d+), [^,]*\)$', 1) AS INTEGER), 'score': CAST(regexp_extract(x, ', ([^,]*)\)$', 1) AS DOUBLE)}) AS cs FROM materials_science_works)"""


@q("txt24_scored_concepts", f"WITH {_SCORED_ITEMS} SELECT id, coalesce(array_to_string(list_transform(list_filter(cs, lambda c: c.score > 0.5 AND c.level >= 1), lambda c: c.name), ','), '') AS names FROM items")
def _(t, s, d):
    return t("materials_science_works").select("id", F.array_join(T.scored_concepts(T.parse_scored_concepts(F.col("concepts"))), ",").alias("names"))


@q("txt26_method_dispatch", f"WITH {DOCS} SELECT doc_id, 'lower' AS method, lower(abstract) AS result FROM docs UNION ALL SELECT doc_id, 'length', CAST(length(abstract) AS VARCHAR) FROM docs")
def _(t, s, d):
    methods = {"lower": F.lower, "length": lambda c: F.length(c).cast("string")}
    made = F.array(*(F.struct(F.lit(name).alias("method"), f(F.col("abstract")).alias("result")) for name, f in methods.items()))
    return docs(t).select("doc_id", F.inline(made))


@q("txt27_formula_parts")
def _(t, s, d):
    return extract_formulas(docs(t), "abstract").select("doc_id", F.explode("elements").alias("formula"))


@q("txt28_formulas_and_text")
def _(t, s, d):
    return extract_formulas(docs(t), "abstract").select("doc_id", "abstract", F.array_join("elements", ",").alias("elements"))


@q("txt29_parse_label_list", f"WITH {LABELS} SELECT pmid, array_to_string(labels, '/') AS labels, CAST(len(labels) AS INTEGER) AS n FROM labels")
def _(t, s, d):
    return label_lists(t).select("pmid", F.array_join("labels", "/").alias("labels"), F.size("labels").alias("n"))


@q("txt29_unreadable_lists", r"SELECT pmid FROM surgery_pubmed_works WHERE trim(llm_concepts) <> '' AND NOT regexp_matches(trim(llm_concepts, E' \n\t\r'), '^\[.*\]$|^\{.*\}$', 's')")
def _(t, s, d):
    """Works whose value is no serialized list; bare labels are none."""
    return t("surgery_pubmed_works").where(T.parse_label_list(F.col("llm_concepts")).isNull()).select("pmid")


def _normal_sql(x: str) -> str:
    lowered = f"list_transform({x}, lambda c: trim(regexp_replace(lower(c), '\\s+', ' ', 'g')))"
    generic, short = ", ".join(repr(g) for g in T.GENERIC_LABELS), ", ".join(repr(a) for a in T.ABBREVIATIONS)
    kept = f"list_filter({lowered}, lambda c: c <> '' AND c NOT IN ({generic}) AND (c IN ({short}) OR len(string_split(c, ' ')) BETWEEN 2 AND 6))"
    return f"list_filter({kept}, lambda c, i: list_position({kept}, c) = i)[1:12]"


@q("txt30_normalize_labels", f"WITH {LABELS} SELECT pmid, array_to_string({_normal_sql('labels')}, '/') AS labels FROM labels")
def _(t, s, d):
    return label_lists(t).select("pmid", F.array_join(T.normalize_labels(F.col("labels")), "/").alias("labels"))


_REPLIES = "replies AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN E'\\n  [\\'steel\\', wear rate] and more]' WHEN 1 THEN '[creep, fatigue life, cut of' WHEN 2 THEN 'Sure: [a b]' ELSE 'nothing here, sorry' END AS reply FROM documents)"


@q("txt31_repair_reply", f"""WITH {_REPLIES}, l AS (SELECT doc_id, list_filter(list_transform(string_split(reply, chr(10)), lambda x: trim(x)), lambda x: x <> '')[1] AS line FROM replies),
e AS (SELECT doc_id, regexp_extract(CASE WHEN contains(line, ']') THEN regexp_extract(line, '^([^\\]]*\\])', 1) ELSE regexp_extract(line, '^(.*),', 1) || ']' END, '\\[([^\\]]+)\\]', 1) AS inner_text FROM l)
SELECT doc_id, array_to_string(list_filter(list_transform(string_split(inner_text, ','), lambda x: regexp_replace(trim(x), '^[''"]|[''"]$', '', 'g')), lambda x: x <> ''), '/') AS items FROM e""")
def _(t, s, d):
    replies = ["\n  ['steel', wear rate] and more]", "[creep, fatigue life, cut of", "Sure: [a b]", "nothing here, sorry"]
    reply = F.element_at(F.array(*map(F.lit, replies)), (F.col("doc_id") % 4 + 1).cast("int"))
    return t("documents").select("doc_id", F.array_join(T.repair_list_reply(reply), "/").alias("items"))


@q("txt32_normalize_spelling", f"WITH {LABELS} SELECT pmid, array_to_string(list_transform(labels, lambda c: replace(regexp_replace(lower(c), '[/-]', ' ', 'g'), 'aluminum', 'aluminium')), '|') AS labels FROM labels")
def _(t, s, d):
    return label_lists(t).select("pmid", F.array_join(T.normalize_spelling(F.col("labels")), "|").alias("labels"))


@q("txt33_name_elements")
def _(t, s, d):
    found = extract_formulas(docs(t), "abstract")
    words = F.transform(F.array_distinct(F.filter(F.split(F.lower("abstract"), r"[.;,]\s*"), lambda p: p != "")), lambda p: T.normalized_space(p))
    return found.select("doc_id", F.explode(name_elements(words, F.col("elements"))).alias("label"))


@q("txt34_valid_file_name", r"""SELECT doc_id, replace(left(regexp_replace(translate(regexp_replace(text, '[^\x00-\x7F]', '', 'g'), '<>:"/\|?*', ''), '^[. ]+|[. ]+$', '', 'g'), 255), ' ', '-') AS name FROM documents""")
def _(t, s, d):
    return t("documents").select("doc_id", T.valid_file_name(F.col("text")).alias("name"))


@q("txt35_sections", r"""WITH l AS (SELECT doc_id AS doc, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents WHERE text IS NOT NULL),
m AS (SELECT doc, line_no, CASE WHEN line_no % 5 = 2 THEN '\section{Part ' || CAST(line_no AS VARCHAR) || '}' ELSE line || ': 3.14%' END AS line FROM l),
r AS (SELECT doc, line_no, regexp_replace(line, ': \d\.\d+%', '', 'g') AS plain, nullif(regexp_extract(line, '^\\section\{(.+?)\}', 1), '') AS opened FROM m)
SELECT doc, CAST(line_no AS INTEGER) AS line_no, plain, coalesce(last_value(opened IGNORE NULLS) OVER (PARTITION BY doc ORDER BY line_no ROWS UNBOUNDED PRECEDING), '<none>') AS section FROM r""")
def _(t, s, d):
    lines = t("documents").where("text IS NOT NULL").select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line")).withColumn("line_no", F.col("line_no") + 1)
    marked = lines.withColumn("line", F.when(F.col("line_no") % 5 == 2, F.concat(F.lit("\\section{Part "), F.col("line_no").cast("string"), F.lit("}"))).otherwise(F.concat("line", F.lit(": 3.14%"))))
    return latex_sections(marked, "line_no", "line").select("doc", "line_no", F.regexp_replace("line", r": \d\.\d+%", "").alias("plain"), "section")


@q("txt36_author_of_file", "SELECT s_suppkey, 'Ada Of ' || CAST(s_suppkey AS VARCHAR) AS author FROM supplier")
def _(t, s, d):
    return t("supplier").select("s_suppkey", T.author_of_file(F.concat(F.lit("ada_of_"), F.col("s_suppkey").cast("string"), F.lit(".txt"))).alias("author"))


@q("txt37_estimated_tokens", "SELECT doc_id, CAST(greatest(1, (strlen(text) + 3) // 4) AS INTEGER) AS tokens FROM documents WHERE text IS NOT NULL")
def _(t, s, d):
    return t("documents").where("text IS NOT NULL").select("doc_id", T.estimated_tokens(F.col("text")).alias("tokens"))


@q("txt38_containment", "SELECT doc_id, contains(lower(text), lower('Surgery')) AS held FROM documents")
def _(t, s, d):
    return t("documents").select("doc_id", T.contains_ignoring_case(F.col("text"), F.lit("Surgery")).alias("held"))


@q("txt39_sequence_positions", """WITH w AS (SELECT doc_id, string_split(text, ' ') AS ws FROM documents WHERE text IS NOT NULL)
SELECT doc_id, array_to_string(list_filter(range(0, greatest(len(ws) - 1, 0)), lambda i: ws[i + 1] = 'of' AND ws[i + 2] = 'the'), ',') AS places FROM w""")
def _(t, s, d):
    words = t("documents").where("text IS NOT NULL").select("doc_id", F.split("text", " ", -1).alias("words"))
    places = T.positions_of_sequence(F.col("words"), F.array(F.lit("of"), F.lit("the")))
    return words.select("doc_id", F.array_join(places.cast("array<string>"), ",").alias("places"))


@q("txt40_token_windows", "WITH w AS (SELECT doc_id, len(string_split(text, ' ')) AS n FROM documents WHERE text IS NOT NULL) SELECT doc_id, CAST((n + 509) // 510 AS INTEGER) AS windows, CAST(n - 510 * ((n - 1) // 510) AS INTEGER) AS last_size FROM w")
def _(t, s, d):
    parts = T.windows_of(F.split("text", " ", -1))
    return t("documents").where("text IS NOT NULL").select("doc_id", F.size(parts).alias("windows"), F.size(F.element_at(parts, -1)).alias("last_size"))


# --- dates


@q("dat1_days_since", "SELECT o_orderkey, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) AS d1970, CAST(date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) AS d1990 FROM orders")
def _(t, s, d):
    return t("orders").select("o_orderkey", D.days_since(F.col("o_orderdate")).alias("d1970"), D.days_since(F.col("o_orderdate"), date(1990, 1, 1)).alias("d1990"))


@q("dat2_year_of_day", "SELECT o_orderkey, CAST(year(DATE '1970-01-01' + CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS INTEGER)) AS INTEGER) AS y FROM orders")
def _(t, s, d):
    return t("orders").select("o_orderkey", D.year_of_day(D.days_since(F.col("o_orderdate"))).alias("y"))


@q("dat3_cutoffs", "SELECT count(*) FILTER (o_orderdate < TIMESTAMP '1997-01-01') AS whole_year, count(*) FILTER (o_orderdate < TIMESTAMP '1996-12-31') AS to_year_end, count(*) FILTER (o_orderdate < TIMESTAMP '1997-04-01') AS to_month FROM orders")
def _(t, s, d):
    day = D.days_since(F.col("o_orderdate"))
    return t("orders").agg(F.count_if(day < D.day_before_year(1996)).alias("whole_year"), F.count_if(day < D.day_of_year_end(1996)).alias("to_year_end"), F.count_if(day < D.day_of_month_cutoff(1996, 3)).alias("to_month"))


_MONTHS = "list_position(['jan', 'feb', 'mar', 'apr', 'may', 'jun', 'jul', 'aug', 'sep', 'oct', 'nov', 'dec'], lower(m))"


@q("dat4_partial_dates", rf"""WITH p AS (SELECT id, publication_date AS t, try_cast(split_part(publication_date, '-', 1) AS INTEGER) AS y, split_part(publication_date, '-', 2) AS m, try_cast(split_part(publication_date, '-', 3) AS INTEGER) AS d FROM materials_science_works),
k AS (SELECT id, coalesce(y, try_cast(list_filter(list_transform(string_split_regex(coalesce(t, ''), '\s+'), lambda x: left(x, 4)), lambda x: try_cast(x AS INTEGER) IS NOT NULL)[1] AS INTEGER)) AS y, coalesce(try_cast(m AS INTEGER), {_MONTHS}, 1) AS m, d FROM p)
SELECT id, CASE WHEN y IS NOT NULL THEN printf('%04d-%02d-%02d', y, CASE WHEN m BETWEEN 1 AND 12 THEN m ELSE 1 END, CASE WHEN d BETWEEN 1 AND 31 THEN d ELSE 1 END) END AS iso FROM k""")
def _(t, s, d):
    """Dates of all works, cut at hyphens; what is no such date is free text with a year, or has none."""
    parts = [F.split_part("publication_date", F.lit("-"), F.lit(i)) for i in (1, 2, 3)]
    return t("materials_science_works").select("id", D.partial_date(parts[0], parts[1], parts[2], F.col("publication_date")).alias("iso"))


@q("dat4_any_date", r"""SELECT pmid, CAST(coalesce(try_cast(nullif(regexp_extract(publication_date, '^(\d{4}-\d{2}-\d{2})', 1), '') AS DATE),
  try_cast(nullif(regexp_extract(publication_date, '^(\d{4}-\d{2})$', 1), '') || '-01' AS DATE), try_cast(nullif(regexp_extract(publication_date, '^(\d{4})$', 1), '') || '-01-01' AS DATE),
  try_cast(nullif(regexp_extract(publication_date, '^(\d{1,2})[./-](\d{1,2})[./-](\d{4})$', 3) || '-' || lpad(regexp_extract(publication_date, '^(\d{1,2})[./-](\d{1,2})[./-](\d{4})$', 2), 2, '0') || '-' || lpad(regexp_extract(publication_date, '^(\d{1,2})[./-](\d{1,2})[./-](\d{4})$', 1), 2, '0'), '-00-00') AS DATE)) AS VARCHAR) AS day
FROM surgery_pubmed_works""")
def _(t, s, d):
    return t("surgery_pubmed_works").select("pmid", D.any_date(F.col("publication_date")).cast("string").alias("day"))


@q("dat5_publication_year", "SELECT pmid, try_cast(left(publication_date, 4) AS INTEGER) AS y FROM surgery_pubmed_works")
def _(t, s, d):
    return t("surgery_pubmed_works").select("pmid", F.substring("publication_date", 1, 4).try_cast("int").alias("y"))


@q("dat6_five_year_period", "SELECT pmid, CAST(publication_year // 5 * 5 AS VARCHAR) || '-' || CAST(publication_year // 5 * 5 + 4 AS VARCHAR) AS period FROM surgery_pubmed_works WHERE publication_year > 0")
def _(t, s, d):
    return t("surgery_pubmed_works").where("publication_year > 0").select("pmid", D.five_year_period(F.col("publication_year")).alias("period"))


@q("dat7_date_bounds", "SELECT DATE '1995-01-01' AS first_day, DATE '1998-12-31' AS last_day, count(*) AS orders FROM orders WHERE o_orderdate >= DATE '1995-01-01' AND o_orderdate < DATE '1999-01-01'")
def _(t, s, d):
    first, last = D.date_bounds(1995, 1998, date(2020, 1, 1))
    return t("orders").where(F.to_date("o_orderdate").between(first, last)).agg(F.lit(first).alias("first_day"), F.lit(last).alias("last_day"), F.count(F.lit(1)).alias("orders"))


@q("dat8_middle_day", "SELECT count(*) FILTER (o_orderdate < TIMESTAMP '1997-01-01') AS older, count(*) FILTER (o_orderdate >= TIMESTAMP '1997-01-01') AS newer FROM orders")
def _(t, s, d):
    middle = D.middle_day(date(1995, 1, 1), date(1998, 12, 31))
    return t("orders").agg(F.count_if(F.to_date("o_orderdate") <= middle).alias("older"), F.count_if(F.to_date("o_orderdate") > middle).alias("newer"))
