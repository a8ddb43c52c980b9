"""Queries of sources, sinks, filters and label stacks."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from corpusloom.functions import predicates as P
from corpusloom.functions import text as T
from corpusloom.operators.graph import degrees, distances_from, snapshot
from corpusloom.operators.keyphrases import STOP_WORDS
from corpusloom.operators.ordering import numbered_parts, with_row_number
from corpusloom.operators.sampling import allowed_nodes
from corpusloom.sources import articles as A
from corpusloom.sources import readers as R
from corpusloom.sources.rest import CursorClient, read_pages, unfinished_parts

from .registry import Registry
from .text_queries import _SCORED_ITEMS, DOCS, docs
from .views import EDGES, PAST_DAY, PAST_GRAPH, edges, mentions, scored

q = Registry()

# --- sources and sinks

_LOOKUP = "SELECT id, concept, concept_count, in_graph FROM lookup_m"


@q("src1_csv_scan", _LOOKUP)
def _(t, s, d):
    path = R.scratch(s, "csv")
    R.write_csv(t("lookup_m"), path)
    return R.require_columns(R.read_csv(s, path, "id bigint, concept string, concept_count bigint, in_graph boolean"), "id", "concept")


@q("src2_csv_projection", "SELECT id, concept FROM lookup_m")
def _(t, s, d):
    path = R.scratch(s, "csv")
    R.write_csv(t("lookup_m"), path)
    return R.read_csv(s, path, "id bigint, concept string, concept_count bigint, in_graph boolean").select("id", "concept")


@q("src3_first_rows", "SELECT id, concept FROM lookup_m ORDER BY id LIMIT 20")
def _(t, s, d):
    return t("lookup_m").select("id", "concept").orderBy("id").limit(20)


@q("src4_chunked_scan", "SELECT CAST((rn - 1) // 500 AS BIGINT) AS chunk, count(*) AS rows, min(id) AS first_id FROM (SELECT id, row_number() OVER (ORDER BY id) AS rn FROM lookup_m) GROUP BY chunk")
def _(t, s, d):
    return numbered_parts(t("lookup_m").select("id"), F.col("id"), rows=500, name="chunk").groupBy("chunk").agg(F.count(F.lit(1)).alias("rows"), F.min("id").alias("first_id"))


@q("src5_parquet_round_trip", _LOOKUP)
def _(t, s, d):
    path = R.scratch(s, "parquet")
    t("lookup_m").write.parquet(path)
    return s.read.parquet(path)


class _PartsEndpoint:
    """Stands in for a remote service: pages of numbered rows of a source."""

    def __call__(self, url: str, parameters: dict) -> dict:
        start = 0 if parameters["cursor"] == "*" else int(parameters["cursor"])
        size, total, part = parameters["per-page"], 95, int(parameters["filter"])
        rows = [{"id": part * 1000 + i, "title": f"title {i}", "beside": "x"} for i in range(start, min(total, start + size))]
        return {"results": rows, "meta": {"next_cursor": str(start + size) if start + size < total else None}}


@q("src6_paged_source", "SELECT r.r_regionkey * 1000 + i AS id, 'title ' || CAST(i AS VARCHAR) AS title FROM region r, range(95) g(i)")
def _(t, s, d):
    client = CursorClient(_PartsEndpoint(), "https://example.org/works", ["id", "title"], filters=[str(i) for i in range(5)], per_page=20)
    return read_pages(s, client, "id bigint, title string")


@q("src7_source_discovery", "SELECT id, display_name, works_count, source_type FROM journal_sources WHERE contains(lower(display_name), 'studies')")
def _(t, s, d):
    return t("journal_sources").where(T.contains_ignoring_case(F.col("display_name"), F.lit("studies"))).select("id", "display_name", "works_count", "source_type")


_HEAVY = "SELECT source_id, count(*) AS n FROM surgery_pubmed_works WHERE source_id IS NOT NULL GROUP BY source_id"


@q("src8_works_of_one_source", f"SELECT pmid, source_id FROM surgery_pubmed_works WHERE source_id = (SELECT source_id FROM ({_HEAVY}) ORDER BY n DESC, source_id LIMIT 1)")
def _(t, s, d):
    works = t("surgery_pubmed_works").where("source_id IS NOT NULL")
    heavy = works.groupBy("source_id").count().orderBy(F.desc("count"), "source_id").limit(1)
    return works.join(F.broadcast(heavy), "source_id", "left_semi").select("pmid", "source_id")


@q("src9_unfinished_sources", "WITH done AS (SELECT source_id, count(*) AS rows FROM surgery_pubmed_works GROUP BY source_id) SELECT s.id, s.works_count FROM journal_sources s LEFT JOIN done ON s.id = done.source_id WHERE coalesce(rows, -1) < works_count - 30")
def _(t, s, d):
    done = t("surgery_pubmed_works").groupBy(F.col("source_id").alias("id")).agg(F.count(F.lit(1)).alias("rows"))
    return unfinished_parts(t("journal_sources").select("id", "works_count"), done, "id", "works_count")


def _article_documents(t):
    """One XML document for each work: its title, abstract, types, languages, terms, DOI, and its date as parts or, where it is not whole, as free text."""
    safe = lambda c: F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    tag = lambda name, c: F.concat(F.lit(f"<{name}>"), safe(F.coalesce(c, F.lit(""))), F.lit(f"</{name.split()[0]}>"))
    each = lambda name, c: F.array_join(F.transform(F.split(F.coalesce(F.col(c), F.lit("")), ";", -1), lambda x: tag(name, x)), "")
    day = F.col("publication_date")
    part = lambda name, i: tag(name, F.split_part(day, F.lit("-"), F.lit(i)))
    whole = F.coalesce(day.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.lit(False))
    retracted = F.when(F.col("is_retracted"), tag("PublicationType", F.lit("Retracted Publication"))).otherwise("")
    body = F.concat(
        F.lit("<Set><PubmedArticle><MedlineCitation>"), tag("PMID", F.col("pmid").cast("string")), F.lit("<Article>"), tag("ArticleTitle", F.col("display_name")),
        F.lit("<Abstract>"), tag("AbstractText Label='A'", F.col("abstract")), F.lit("</Abstract>"), each("Language", "languages"),
        F.lit("<PublicationTypeList>"), each("PublicationType", "publication_types"), retracted, F.lit("</PublicationTypeList>"),
        F.when(whole, F.concat(F.lit("<ArticleDate>"), part("Year", 1), part("Month", 2), part("Day", 3), F.lit("</ArticleDate>"))).otherwise(""),
        F.lit("<Journal>"), tag("Title", F.col("source_id")), F.lit("<JournalIssue><PubDate>"), F.when(~whole, tag("MedlineDate", day)).otherwise(""), F.lit("</PubDate></JournalIssue></Journal></Article>"),
        F.lit("<MeshHeadingList><MeshHeading>"), each("DescriptorName", "mesh_terms"), F.lit("</MeshHeading></MeshHeadingList></MedlineCitation>"),
        F.lit("<PubmedData><ArticleIdList>"), tag("ArticleId IdType='doi'", F.col("doi")), F.lit("</ArticleIdList></PubmedData></PubmedArticle></Set>"),
    )
    return t("surgery_pubmed_works").select(body.alias("xml"))


_SQUEEZED = "trim(regexp_replace(coalesce({}, ''), '\\s+', ' ', 'g'))"
_ABSTRACT = f"CASE WHEN {_SQUEEZED.format('abstract')} = '' THEN '' ELSE 'A: ' || {_SQUEEZED.format('abstract')} END"
_LIST = "list_filter(list_transform(string_split(coalesce({}, ''), ';'), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> '')"
_ONCE = "array_to_string(list_filter({0}, lambda x, i: list_position({0}, x) = i), '; ')"
_IN_RANGE = "CASE WHEN CAST(substr(publication_date, {0}, 2) AS INTEGER) BETWEEN 1 AND {1} THEN substr(publication_date, {0}, 2) ELSE '01' END"
_ARTICLES = rf"""a AS (SELECT CAST(pmid AS VARCHAR) AS pmid, coalesce(doi, '') AS doi, {_SQUEEZED.format('display_name')} AS title, {_ABSTRACT} AS body, {_LIST.format('mesh_terms')} AS mesh, {_LIST.format('languages')} AS langs,
 {_LIST.format('publication_types')} || CASE WHEN is_retracted THEN ['Retracted Publication'] ELSE [] END AS types, coalesce(is_retracted, false) AS is_retracted,
 CASE WHEN regexp_matches(publication_date, '^\d{{4}}-\d{{2}}-\d{{2}}$') THEN substr(publication_date, 1, 4) || '-' || {_IN_RANGE.format(6, 12)} || '-' || {_IN_RANGE.format(9, 31)} WHEN regexp_matches(publication_date, '^\d{{4}}') THEN substr(publication_date, 1, 4) || '-01-01' END AS day FROM surgery_pubmed_works),
r AS (SELECT *, CASE WHEN pmid IS NULL THEN 'missing_pmid' WHEN title = '' THEN 'missing_title' WHEN body = '' THEN 'missing_abstract' WHEN day IS NULL THEN 'missing_publication_date' WHEN length(title) < 10 THEN 'title_too_short'
 WHEN length(body) <= 300 THEN 'abstract_too_short' WHEN length(body) >= 4000 THEN 'abstract_too_long' WHEN NOT list_has_any(list_transform(langs, lambda x: lower(x)), ['en', 'eng', 'english']) THEN 'non_english'
 WHEN list_has_any(list_transform(types, lambda x: lower(x)), ['review', 'systematic review', 'meta-analysis', 'editorial', 'letter', 'comment', 'case reports', 'retracted publication']) THEN 'excluded_publication_type' END AS reason FROM a)"""


@q("txt20_article_records", f"WITH {_ARTICLES} SELECT coalesce(pmid, '') AS pmid, doi, title AS display_name, day AS publication_date, CAST(left(day, 4) AS INTEGER) AS publication_year, {_ONCE.format('mesh')} AS mesh_terms, {_ONCE.format('types')} AS publication_types, {_ONCE.format('langs')} AS languages, is_retracted, reason FROM r")
def _(t, s, d):
    return A.parse_articles(_article_documents(t), "xml").select("pmid", "doi", "display_name", "publication_date", "publication_year", "mesh_terms", "publication_types", "languages", "is_retracted", "reason")


@q("src14_articles_by_reason", f"WITH {_ARTICLES} SELECT reason, count(*) AS articles FROM r GROUP BY reason")
def _(t, s, d):
    return A.parse_articles(_article_documents(t), "xml").groupBy("reason").agg(F.count(F.lit(1)).alias("articles"))


@q("txt19_labelled_abstract", f"WITH {_ARTICLES} SELECT coalesce(pmid, '') AS pmid, body AS abstract FROM r")
def _(t, s, d):
    return A.parse_articles(_article_documents(t), "xml").select("pmid", "abstract")


@q("src12_paged_ids", "SELECT pmid FROM (SELECT DISTINCT pmid FROM surgery_pubmed_works WHERE pmid IS NOT NULL ORDER BY pmid LIMIT 10000)")
def _(t, s, d):
    """Distinct ids in pages from a service, here a stand-in that gives 500 a page and ten thousand in all, as the service does."""
    held = [r["pmid"] for r in t("surgery_pubmed_works").where("pmid IS NOT NULL").select("pmid").distinct().orderBy("pmid").limit(10_000).collect()]
    found = A.paged_ids(lambda start, n: [str(x) for x in held[start : start + n]], len(held))
    return s.createDataFrame([(int(x),) for x in found], "pmid bigint")


@q("src13_sliced_ids", "SELECT o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1990-01-01' AND DATE '2005-12-31'")
def _(t, s, d):
    """All ids of a range of days from a search that returns a bounded number, by halving the range."""
    rows = t("orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    daily = rows.groupBy("day").count().agg(F.max("count")).first()[0] or 1
    return A.sliced_rows(rows, date(1990, 1, 1), date(2005, 12, 31), most=max(10_000, daily)).select("o_orderkey")


@q("snk5_flushed_rows", "SELECT count(*) AS rows, true AS bounded FROM surgery_pubmed_works")
def _(t, s, d):
    """Rows written in files of a thousand at most, counted by file."""
    path = R.scratch(s, "flushed")
    R.write_flushed(t("surgery_pubmed_works").select("pmid", "doi"), path)
    files = R.rows_by_file(s.read.schema("pmid bigint, doi string").parquet(path))
    return files.agg(F.sum("rows").alias("rows"), (F.max("rows") <= 1000).alias("bounded"))


@q("hlp1_unlisted_topics", "SELECT DISTINCT source FROM mix_targets WHERE source IS NOT NULL AND source NOT IN (SELECT source FROM documents WHERE source IS NOT NULL)")
def _(t, s, d):
    """Asked names that the list of known ones does not have."""
    return R.unlisted(t("mix_targets"), t("documents").where("source IS NOT NULL"), "source")


@q("snk7_saved_state", "SELECT coalesce(lang, '') AS lang, count(*) AS docs FROM documents GROUP BY 1")
def _(t, s, d):
    """Counts that are written as a state, replaced once, and read back."""
    path = f"{R.scratch(s, 'state')}/state.json"
    counts = {r["lang"]: r["docs"] for r in t("documents").groupBy(F.coalesce("lang", F.lit("")).alias("lang")).agg(F.count(F.lit(1)).alias("docs")).collect()}  # one row a language
    R.write_state(s, {}, path)
    R.write_state(s, {"langs": counts}, path)
    return s.createDataFrame(sorted(R.read_state(s, path)["langs"].items()), "lang string, docs bigint")


@q("snk8_failure_log", "SELECT id, 'unknown place' AS reason FROM lookup_m WHERE in_graph IS NULL")
def _(t, s, d):
    """Entries of which it is not known whether they are in the graph, one line of the log each."""
    path = R.scratch(s, "failures")
    for row in t("lookup_m").where("in_graph IS NULL").select("id").toLocalIterator():  # the failures of one run
        R.append_failure(s, path, {"id": row["id"], "reason": "unknown place"})
    return R.read_json_lines(s, path, "id bigint, reason string")


@q("src10_search_strings", """SELECT r_regionkey, '(' || r_name || ') ' || 'AND hasabstract[text] AND english[lang] AND humans[Mesh] NOT (review[Publication Type] OR systematic review[Publication Type] OR meta-analysis[Publication Type] OR editorial[Publication Type] OR letter[Publication Type] OR comment[Publication Type] OR case reports[Publication Type]) AND ("2000"[Date - Publication] : "2025"[Date - Publication])' AS query FROM region""")
def _(t, s, d):
    name = "@@"
    before, after = A.yearly_query(name, 2000, 2025).split(name)
    return t("region").select("r_regionkey", F.concat(F.lit(before), "r_name", F.lit(after)).alias("query"))


@q("src15_text_blocks", "SELECT 'https://example.org/' || CAST(n_nationkey AS VARCHAR) AS link, n_name AS title, 'Author ' || CAST(n_regionkey AS VARCHAR) AS author, 'About ' || n_name AS abstract FROM nation")
def _(t, s, d):
    path = R.scratch(s, "blocks")
    block = F.concat_ws("\n", F.lit(""), F.concat(F.lit("https://example.org/"), F.col("n_nationkey").cast("string")), "n_name", F.concat(F.lit("Author "), F.col("n_regionkey").cast("string")), F.concat(F.lit("About "), "n_name"))
    t("nation").select(block.alias("value")).write.text(path)
    return R.read_blocks(s, path).select("link", "title", "author", "abstract")


@q("src16_json_lines", "SELECT event_id, user_id, CAST(props->>'$.k' AS BIGINT) AS k FROM events")
def _(t, s, d):
    path = R.scratch(s, "json")
    t("events").select("event_id", "user_id", F.get_json_object("props", "$.k").cast("bigint").alias("k")).write.json(path, ignoreNullFields=False)
    return R.read_json_lines(s, path, "event_id bigint, user_id bigint, k bigint")


@q("src17_rows_by_file", "SELECT 'part-' || CAST(r AS VARCHAR) AS file, count(*) AS rows FROM (SELECT id % 5 AS r FROM lookup_m) GROUP BY r")
def _(t, s, d):
    """Rows of each file of a table that is written in five of them first; files are named by their folder, as Spark chooses the names."""
    path = R.scratch(s, "files")
    R.write_parts(t("lookup_m").select("concept", (F.col("id") % 5).alias("part")), path, "part")
    return R.rows_by_file(s.read.schema("concept string").parquet(path), r"part=(\d+)/[^/]*$").withColumn("file", F.concat(F.lit("part-"), "file"))


@q("src18_missing_ids", "SELECT i AS pmid FROM range((SELECT min(pmid) FROM surgery_pubmed_works WHERE source_id IS NOT NULL), (SELECT max(pmid) + 1 FROM surgery_pubmed_works WHERE source_id IS NOT NULL)) g(i) WHERE i NOT IN (SELECT pmid FROM surgery_pubmed_works WHERE source_id IS NOT NULL)")
def _(t, s, d):
    present = t("surgery_pubmed_works").where("source_id IS NOT NULL").select("pmid")
    low, high = present.agg(F.min("pmid"), F.max("pmid")).first()
    return R.missing_ids(s.range(low, high + 1).select(F.col("id").alias("pmid")), present, "pmid")


_PARTS = r"list_filter(list_transform(regexp_split_to_array(coalesce(modules, ''), '[,\n;|]+'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')"


@q("src19_listed_labels", f"SELECT pmid, array_to_string({_PARTS}, '/') AS labels FROM surgery_pubmed_works")
def _(t, s, d):
    return t("surgery_pubmed_works").select("pmid", F.array_join(T.split_list(F.col("modules")), "/").alias("labels"))


@q("snk1_csv_sink", "SELECT id, display_name, works_count FROM journal_sources")
def _(t, s, d):
    path = R.scratch(s, "csv")
    R.write_csv(t("journal_sources").select("id", "display_name", "works_count"), path)
    return R.read_csv(s, path, "id string, display_name string, works_count bigint", emptyValue="")


@q("snk3_append_and_merge", "SELECT id, concept FROM lookup_m UNION ALL SELECT id + 1000000, concept FROM lookup_m WHERE in_graph")
def _(t, s, d):
    path = R.scratch(s, "append")
    t("lookup_m").select("id", "concept").write.mode("append").parquet(path)
    t("lookup_m").where("in_graph").select((F.col("id") + 1000000).alias("id"), "concept").write.mode("append").parquet(path)
    return s.read.parquet(path)


@q("snk4_contiguous_files", "WITH n AS (SELECT CAST(ceil(count(*) / 7.0) AS BIGINT) AS size FROM lookup_m) SELECT CAST((rn - 1) // size AS BIGINT) AS part, count(*) AS rows, min(id) AS first_id, max(id) AS last_id FROM (SELECT id, row_number() OVER (ORDER BY id) AS rn FROM lookup_m), n GROUP BY part")
def _(t, s, d):
    rows = t("lookup_m").select("id")
    path = R.scratch(s, "parts")
    R.write_parts(numbered_parts(rows, F.col("id"), rows=-(-rows.count() // 7)), path, "part")
    return s.read.parquet(path).groupBy(F.col("part").cast("bigint").alias("part")).agg(F.count(F.lit(1)).alias("rows"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


@q("snk9_left_out_rows", "SELECT CASE WHEN abstract IS NULL THEN 'no_abstract' WHEN is_retracted THEN 'retracted' END AS reason, count(*) AS rows FROM surgery_pubmed_works GROUP BY ALL")
def _(t, s, d):
    rows = P.without_reason(t("surgery_pubmed_works").select("pmid", "abstract", "is_retracted"), {"no_abstract": F.col("abstract").isNull(), "retracted": F.col("is_retracted")})
    return R.write_split(rows, R.scratch(s, "kept"), R.scratch(s, "left-out"))


@q("snk10_markdown_report", """WITH l AS (SELECT coalesce(lang, '') AS lang, 2 AS part, doc_id AS place, '| ' || doc_id || ' | ' || coalesce(CAST(n_chars AS VARCHAR), '') || ' |' AS line FROM documents
UNION ALL SELECT DISTINCT coalesce(lang, ''), 0, -1, '| doc | chars |' FROM documents UNION ALL SELECT DISTINCT coalesce(lang, ''), 1, -1, '|---|---|' FROM documents)
SELECT lang, line, CAST(row_number() OVER (ORDER BY lang, part, place) AS BIGINT) AS line_no FROM l""")
def _(t, s, d):
    """The lines of a report with a table for each language, numbered in order over all of them."""
    rows = t("documents").select(F.coalesce("lang", F.lit("")).alias("lang"), F.lit(2).alias("part"), F.col("doc_id").alias("place"), F.concat(F.lit("| "), F.col("doc_id").cast("string"), F.lit(" | "), F.coalesce(F.col("n_chars").cast("string"), F.lit("")), F.lit(" |")).alias("line"))
    heads = rows.select("lang").distinct().select("lang", F.posexplode(F.array(F.lit("| doc | chars |"), F.lit("|---|---|"))).alias("part", "line")).select("lang", "part", F.lit(-1).cast("bigint").alias("place"), "line")
    return with_row_number(rows.unionByName(heads), F.col("lang"), F.col("part"), F.col("place"), name="line_no").select("lang", "line", "line_no")


@q("snk12_packed_requests")
def _(t, s, d):
    return R.packed_requests(t("documents").where("text IS NOT NULL"), "doc_id", "text", most_rows=100, most_bytes=60_000, most_tokens=12_000, group="source")


# --- filters


def _kept(name: str, table: str, key: str, condition: str, column) -> None:
    q(name, f"SELECT {key} FROM {table} WHERE {condition}")(lambda t, s, d: t(table).where(column()).select(key))


_WORKS = "materials_science_works"
_kept("flt2_has_abstract", _WORKS, "id", "abstract IS NOT NULL", lambda: F.col("abstract").isNotNull())
_kept("flt3_not_retracted", _WORKS, "id", "NOT is_paratext AND NOT is_retracted", lambda: ~F.col("is_paratext") & ~F.col("is_retracted"))
_kept("flt4_length_between", _WORKS, "id", "length(abstract) BETWEEN 250 AND 3000", lambda: P.length_between(F.col("abstract")))
_kept("flt5_no_latex", "documents", "doc_id", r"NOT regexp_matches(text, '\\[a-z]+')", lambda: P.no_latex(F.col("text")))
_kept("flt7_is_english", "documents", "doc_id", "lang = 'en'", lambda: F.col("lang") == "en")
_kept("flt9_length_inside", _WORKS, "id", "length(abstract) > 250 AND length(abstract) < 3000", lambda: P.length_inside(F.col("abstract")))
_kept("flt14_no_lone_number", "lookup_m", "id", r"NOT regexp_matches(concept, '\b\d+\b')", lambda: P.no_lone_number(F.col("concept")))
_kept("flt15_ascii_only", "lookup_m", "id", r"regexp_matches(concept, '^[\x00-\x7F]*$')", lambda: P.ascii_only(F.col("concept")))
_kept("flt16_word_count", "lookup_m", "id", "len(string_split(concept, ' ')) BETWEEN 3 AND 4", lambda: P.words_single_blank(F.col("concept")).between(3, 4))
_kept("flt17_biomedical_label", "lookup_m", "id", r"lower(concept) IN ('crispr', 'ct', 'ercp', 'icu', 'mri', 'pcr', 'tme') OR len(list_filter(regexp_split_to_array(concept, '\s+'), lambda w: w <> '')) BETWEEN 2 AND 6", lambda: P.biomedical_label(F.col("concept")))
_kept("flt19_label_length", "lookup_m", "id", "length(concept) BETWEEN 5 AND 25", lambda: P.length_between(F.col("concept"), 5, 25))
_kept("hlp2_abstract_eligible", "surgery_pubmed_works", "pmid", r"length(trim(regexp_replace(abstract, '\s+', ' ', 'g'))) > 300 AND length(trim(regexp_replace(abstract, '\s+', ' ', 'g'))) < 4000", lambda: P.length_inside(T.normalized_space(F.col("abstract")), 300, 4000))


_FREQUENT = ", ".join(f"'{w}'" for w in sorted(STOP_WORDS))


@q("flt7_detected_language", f"WITH w AS (SELECT doc_id, text, regexp_extract_all(lower(text), '[a-z]+') AS w FROM documents) SELECT doc_id, CASE WHEN text IS NULL THEN NULL WHEN len(w) = 0 THEN 'unknown' WHEN 5 * len(list_filter(w, lambda x: x IN ({_FREQUENT}))) >= len(w) THEN 'en' ELSE 'unknown' END AS found FROM w")
def _(t, s, d):
    """Languages by an injected detector; here one that knows English by its frequent words and fails without any word."""
    return t("documents").select("doc_id", P.detected_language(F.col("text"), P.mostly_frequent_words(STOP_WORDS)).alias("found"))


@q("flt1_reason_counts", "SELECT CASE WHEN abstract IS NULL THEN 'no_abstract' WHEN length(abstract) < 250 THEN 'short' END AS reason, count(*) AS rows FROM materials_science_works GROUP BY ALL")
def _(t, s, d):
    rows = P.without_reason(t(_WORKS), {"no_abstract": F.col("abstract").isNull(), "short": F.length("abstract") < 250})
    return rows.groupBy("reason").agg(F.count(F.lit(1)).alias("rows"))


_TOPIC = "coalesce(round_even(CAST(list_filter(cs, lambda c: c.name = 'Ceramic')[1].score AS DECIMAL(18, 9)), 3), -1.0)"


@q("flt6_topic_score", f"WITH {_SCORED_ITEMS} SELECT id, CAST({_TOPIC} AS DOUBLE) AS score FROM items WHERE {_TOPIC} > 0")
def _(t, s, d):
    score = P.topic_score(T.parse_scored_concepts(F.col("concepts")), "Ceramic")
    return t(_WORKS).select("id", score.alias("score")).where("score > 0")


@q("flt8_filter_chain", f"WITH {_SCORED_ITEMS} SELECT w.id FROM materials_science_works w JOIN items ON items.id = w.id WHERE abstract IS NOT NULL AND display_name IS NOT NULL AND NOT is_paratext AND NOT is_retracted AND length(abstract) BETWEEN 250 AND 3000 AND NOT regexp_matches(abstract, '\\\\[a-z]+') AND lang_label = 'en' AND {_TOPIC} > 0 GROUP BY w.id")
def _(t, s, d):
    chain = P.all_of(
        F.col("abstract").isNotNull(), F.col("display_name").isNotNull(), ~F.col("is_paratext") & ~F.col("is_retracted"), P.length_between(F.col("abstract")), P.no_latex(F.col("abstract")),
        F.col("lang_label") == "en", P.topic_score(T.parse_scored_concepts(F.col("concepts")), "Ceramic") > 0,
    )
    return t(_WORKS).where(chain).select("id").distinct()


@q("flt10_first_reason", """SELECT pmid, CASE WHEN pmid IS NULL THEN 'missing_pmid' WHEN coalesce(display_name, '') = '' THEN 'missing_title' WHEN coalesce(abstract, '') = '' THEN 'missing_abstract'
 WHEN coalesce(publication_date, '') = '' THEN 'missing_publication_date' WHEN length(display_name) < 10 THEN 'title_too_short' WHEN length(abstract) <= 300 THEN 'abstract_too_short' WHEN length(abstract) >= 4000 THEN 'abstract_too_long'
 WHEN NOT coalesce(contains(languages, 'eng'), false) THEN 'non_english' WHEN regexp_matches(publication_types, 'Case Reports|Review|Letter|Editorial|Comment') THEN 'excluded_publication_type' END AS reason FROM surgery_pubmed_works""")
def _(t, s, d):
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    reasons = {
        "missing_pmid": F.col("pmid").isNull(), "missing_title": empty("display_name"), "missing_abstract": empty("abstract"), "missing_publication_date": empty("publication_date"),
        "title_too_short": F.length("display_name") < 10, "abstract_too_short": F.length("abstract") <= 300, "abstract_too_long": F.length("abstract") >= 4000,
        "non_english": ~F.coalesce(F.contains("languages", F.lit("eng")), F.lit(False)), "excluded_publication_type": F.col("publication_types").rlike("Case Reports|Review|Letter|Editorial|Comment"),
    }
    return P.without_reason(t("surgery_pubmed_works"), reasons).select("pmid", "reason")


@q("flt11_list_status", r"""SELECT pmid, CASE WHEN llm_concepts IS NULL OR trim(llm_concepts) = '' THEN 'missing_concepts' WHEN NOT json_valid(llm_concepts) OR NOT regexp_matches(llm_concepts, '^\s*[\[{]') THEN 'parse_error'
 WHEN json_type(llm_concepts) <> 'ARRAY' THEN 'concept_value_is_not_a_list' WHEN json_array_length(llm_concepts) = 0 THEN 'empty_concept_list' END AS reason FROM surgery_pubmed_works""")
def _(t, s, d):
    parsed = F.try_parse_json("llm_concepts")
    kind = F.schema_of_variant(parsed)
    reasons = {
        "missing_concepts": P.blank(F.col("llm_concepts")), "parse_error": parsed.isNull() | ~F.col("llm_concepts").rlike(r"^\s*[\[{]"), "concept_value_is_not_a_list": ~kind.startswith("ARRAY"), "empty_concept_list": F.json_array_length("llm_concepts") == 0,
    }
    return P.without_reason(t("surgery_pubmed_works"), reasons).select("pmid", "reason")


@q("flt12_occurrence_range", "SELECT l_partkey AS cid, count(*) AS n FROM lineitem GROUP BY l_partkey HAVING count(*) BETWEEN 20 AND 35")
def _(t, s, d):
    return t("lineitem").groupBy(F.col("l_partkey").alias("cid")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n").between(20, 35))


_STOP = ", ".join(repr(w) for w in [*P.WEAK_WORDS, *P.EMPTY_WORDS])


_TAGS = {"IN": ["after", "in", "of", "on", "with"], "DT": ["a", "the"], "CC": ["and", "or"]}


def _tag(words: list[str]) -> list[str]:
    """A tagger by endings and a few words, where no trained one is at hand."""
    return [next((t for t, held in _TAGS.items() if w in held), "RB" if w.endswith("ly") else "JJ" if w.endswith("al") else "NN") for w in words]


_TAGGED = ", ".join(f"'{w}'" for held in _TAGS.values() for w in held)


@q("flt13_keyword_phrase", f"WITH w AS (SELECT id, string_split(concept, ' ') AS w FROM lookup_m) SELECT id FROM w WHERE len(w) > 2 OR len(list_filter(w, lambda x: x IN ({_TAGGED}) OR x LIKE '%ly' OR x LIKE '%al')) = 0")
def _(t, s, d):
    """Phrases that the part-of-speech test keeps, with an injected tagger."""
    return t("lookup_m").where(P.tagged_phrase(F.col("concept"), _tag)).select("id")


@q("flt13_keyword_phrase_without_pos", f"WITH p AS (SELECT doc_id, unnest(string_split(text, '. ')) AS phrase FROM documents) SELECT doc_id, phrase FROM p WHERE NOT list_has_any(string_split(phrase, ' '), [{_STOP}]) AND len(string_split(phrase, ' ')) <= 2")
def _(t, s, d):
    return t("documents").select("doc_id", F.explode(F.split("text", r"\. ", -1)).alias("phrase")).where(P.keyword_phrase(F.col("phrase")))


_FORMULAS = ["Fe3O4", "NaCl", "H2O", "HOH", "C", "YBa2Cu3O7", "abC", "SiC"]


@q("flt18_formula_of_elements", f"WITH f AS (SELECT n_nationkey, [{', '.join(repr(f) for f in _FORMULAS)}][n_nationkey % {len(_FORMULAS)} + 1] AS formula FROM nation), e AS (SELECT *, regexp_extract_all(regexp_replace(formula, '[^A-Za-z]', '', 'g'), '[A-Z][a-z]*|^[a-z]+') AS parts FROM f) SELECT n_nationkey, formula FROM e WHERE len(list_distinct(parts)) = len(parts) AND len(parts) >= 2")
def _(t, s, d):
    formula = F.element_at(F.array(*map(F.lit, _FORMULAS)), F.col("n_nationkey") % len(_FORMULAS) + 1)
    return t("nation").select("n_nationkey", formula.alias("formula")).where(P.formula_of_elements(F.col("formula")))


@q("flt20_label_stack", r"SELECT id, concept FROM lookup_m WHERE NOT regexp_matches(concept, '\b\d+\b') AND regexp_matches(concept, '^[\x00-\x7F]*$') AND len(string_split(concept, ' ')) BETWEEN 1 AND 3 AND length(concept) BETWEEN 5 AND 100")
def _(t, s, d):
    return t("lookup_m").where(P.label_filter(F.col("concept"), "llama_concepts", (1, 3), (5, 100))).select("id", "concept")


@q("flt21_false_formulas", "SELECT n_nationkey, array_to_string(list_filter(['In', 'TiO2', 'UV', 'K', n_name], lambda x: x NOT IN ('In', 'At', 'VIP', 'C', 'K', 'As', 'I', 'II', 'III', 'IV', 'V', 'Pa', 'UV', 'U', 'K1')), ',') AS formulas FROM nation")
def _(t, s, d):
    return t("nation").select("n_nationkey", F.array_join(P.without_false_formulas(F.array(F.lit("In"), F.lit("TiO2"), F.lit("UV"), F.lit("K"), F.col("n_name"))), ",").alias("formulas"))


@q("flt22_date_cutoff", f"WITH {EDGES} SELECT y, count(*) AS edges FROM edges WHERE day < {PAST_DAY} GROUP BY y")
def _(t, s, d):
    return edges(t).where(F.col("day") < PAST_DAY).groupBy("y").agg(F.count(F.lit(1)).alias("edges"))


_DEGREES = "deg AS (SELECT id, count(*) AS degree, CAST(sum(links) AS BIGINT) AS weighted FROM ways GROUP BY id)"


@q("flt23_cooccurrence_degree", f"WITH {PAST_GRAPH}, {_DEGREES} SELECT id, weighted FROM deg WHERE weighted BETWEEN 20 AND 40")
def _(t, s, d):
    return degrees(snapshot(edges(t), PAST_DAY)).where(F.col("weighted").between(20, 40)).select("id", "weighted")


@q("flt24_allowed_nodes", f"WITH {PAST_GRAPH}, {_DEGREES} SELECT id FROM deg WHERE degree >= 30 AND id IN (SELECT p_partkey FROM part WHERE p_size > 10)")
def _(t, s, d):
    return allowed_nodes(t("part").where("p_size > 10").select(F.col("p_partkey").alias("id")), snapshot(edges(t), PAST_DAY), 30)


@q("flt25_distance_range", f"WITH {PAST_GRAPH}, s AS (SELECT min(id) AS src FROM ways), d1 AS (SELECT other AS id FROM ways, s WHERE ways.id = src), d2 AS (SELECT DISTINCT w.other AS id FROM d1 JOIN ways w ON w.id = d1.id) SELECT id, 2 AS distance FROM d2, s WHERE id NOT IN (SELECT id FROM d1) AND id <> src")
def _(t, s, d):
    snap = snapshot(edges(t), PAST_DAY)
    walked = distances_from(snap, snap.agg(F.min("u").alias("id")), 2)
    return walked.where(F.col("distance").between(2, 2)).select("id", "distance")


@q("flt26_module_membership", f"SELECT pmid FROM surgery_pubmed_works WHERE list_has_any({_PARTS}, ['core_surgery', 'thoracic_surgery'])")
def _(t, s, d):
    return t("surgery_pubmed_works").where(F.arrays_overlap(T.split_list(F.col("modules")), F.array(F.lit("core_surgery"), F.lit("thoracic_surgery")))).select("pmid")


@q("flt27_year_range", "SELECT pmid FROM surgery_pubmed_works WHERE try_cast(left(publication_date, 4) AS INTEGER) BETWEEN 2015 AND 2020")
def _(t, s, d):
    return t("surgery_pubmed_works").where(F.substring("publication_date", 1, 4).try_cast("int").between(2015, 2020)).select("pmid")


@q("flt28_hubs_removed", f"WITH {PAST_GRAPH}, {_DEGREES}, hubs AS (SELECT id FROM deg ORDER BY degree DESC, id LIMIT 10) SELECT u, v FROM snap WHERE u NOT IN (SELECT id FROM hubs) AND v NOT IN (SELECT id FROM hubs)")
def _(t, s, d):
    snap = snapshot(edges(t), PAST_DAY)
    hubs = F.broadcast(degrees(snap).orderBy(F.desc("degree"), "id").limit(10))
    return snap.join(hubs.select(F.col("id").alias("u")), "u", "left_anti").join(hubs.select(F.col("id").alias("v")), "v", "left_anti").select("u", "v")


@q("flt29_nonempty_lists", "SELECT pmid FROM surgery_pubmed_works WHERE json_valid(llm_concepts) AND json_type(llm_concepts) = 'ARRAY' AND json_array_length(llm_concepts) > 0")
def _(t, s, d):
    return t("surgery_pubmed_works").where("ltrim(llm_concepts) LIKE '[%'").where(F.json_array_length("llm_concepts") > 0).where(F.try_parse_json("llm_concepts").isNotNull()).select("pmid")


@q("flt30_interesting_predictions", "SELECT idx, score FROM (SELECT doc_id AS idx, (coalesce(n_chars, 0) * 7919 % 1000) / 1000.0::DOUBLE AS score FROM documents) WHERE score > 0.95")
def _(t, s, d):
    return scored(t).where("score > 0.95").select("idx", "score")


@q("flt31_until_year", "SELECT publication_year, count(*) AS works FROM surgery_pubmed_works WHERE publication_year <= 2022 GROUP BY publication_year")
def _(t, s, d):
    return t("surgery_pubmed_works").where("publication_year <= 2022").groupBy("publication_year").agg(F.count(F.lit(1)).alias("works"))


@q("flt32_distance_mask", f"WITH {PAST_GRAPH}, p AS (SELECT DISTINCT u, v FROM edges WHERE day >= {PAST_DAY}) SELECT count(*) AS pairs, count(*) FILTER (snap.u IS NULL) AS at_least_two FROM p LEFT JOIN snap USING (u, v)")
def _(t, s, d):
    every = edges(t)
    later = every.where(F.col("day") >= PAST_DAY).select("u", "v").distinct()
    marked = later.join(snapshot(every, PAST_DAY).select("u", "v", F.lit(1).alias("distance")), ["u", "v"], "left")
    return marked.agg(F.count(F.lit(1)).alias("pairs"), F.count_if(F.coalesce("distance", F.lit(2)) >= 2).alias("at_least_two"))


@q("flt33_output_guard", "SELECT count(*) > 20 AS refused FROM lookup_m")
def _(t, s, d):
    return t("lookup_m").limit(21).agg((F.count(F.lit(1)) > 20).alias("refused"))


@q("txt_docs_cleaned_length", f"WITH {DOCS} SELECT count(*) FILTER (length(abstract) > 250) AS long_enough FROM docs")
def _(t, s, d):
    return docs(t).agg(F.count_if(F.length("abstract") > 250).alias("long_enough"))


@q("hlp9_concepts_until_year", "WITH m AS (SELECT DISTINCT l_orderkey AS w, l_partkey AS c FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE year(o_orderdate) <= 1996) SELECT DISTINCT c AS cid FROM m WHERE w IN (SELECT w FROM m GROUP BY w HAVING count(*) > 1)")
def _(t, s, d):
    works = mentions(t).where("y <= 1996").groupBy("work_id").agg(F.collect_set("cid").alias("cids"))
    return works.where(F.size("cids") > 1).select(F.explode("cids").alias("cid")).distinct()
