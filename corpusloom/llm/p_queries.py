"""Queries pN_... of the training-data problems, over whole tables, and the SQL that some of them equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.skewed import skew_join
from corpusloom.plans.views import LABELS
from corpusloom.session import cut, ship, small, table

from .bpe import encode_texts
from .consensus import Consensus, annotator_consensus
from .copies import class_members, collapse_copies, copy_pairs, label_multiset_key
from .labels import decode_labels, letters_digits
from .language import fit_labeller, label_languages, labelled_sample, named_language, sentence_languages
from .linking import link_mentions
from .mixing import mix, mixture_shares
from .stuffing import corpus_shapes, line_shapes, page_shapes
from .together import baskets_of, pairs_together

ANNOTATORS = ["annotator1", "annotator2", "annotator3"]
#: Most reference entries that are sent to every task; beyond, the join shuffles.
LOOKUP_BROADCAST = 200_000


def _works(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "surgery_pubmed_works").select("pmid", "llm_concepts")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    works = _works(spark, sf_dir)
    classes, members = collapse_copies(works, "pmid", label_multiset_key(works["llm_concepts"]))
    pairs = copy_pairs(members, classes)
    return pairs.select(F.col("record_a").alias("pmid_a"), F.col("record_b").alias("pmid_b"))


def p1_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    works = _works(spark, sf_dir)
    classes, _ = collapse_copies(works, "pmid", label_multiset_key(works["llm_concepts"]))
    return classes.select(F.col("representative").alias("pmid"), F.col("copies").alias("n_works"))


def p1_collapsed_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same result with a bound of hot keys low enough that keys of the table are salted."""
    works = _works(spark, sf_dir)
    classes, _ = collapse_copies(works, "pmid", label_multiset_key(works["llm_concepts"]), hot_rows=3)
    return classes.select(F.col("representative").alias("pmid"), F.col("copies").alias("n_works"))


def p1_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    works = _works(spark, sf_dir)
    classes, members = collapse_copies(works, "pmid", label_multiset_key(works["llm_concepts"]), hot_rows=3)
    return class_members(members, classes).select(F.col("record").alias("pmid"), F.col("representative").alias("same_as"), "copies")


def _consensus(spark: SparkSession, sf_dir: str, **options) -> Consensus:
    return annotator_consensus(table(spark, sf_dir, "annotations"), "item_id", ANNOTATORS, **options)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _consensus(spark, sf_dir, loo="any", smoothing=0.0).items
    return items.where("marked > 1").select(F.col("item").alias("item_id"), F.col("label").alias("label_key"))


def p2_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _consensus(spark, sf_dir).items
    return items.select(F.col("item").alias("item_id"), "label", "votes", "marked", F.round("support", 6).alias("support"))


def p2_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _consensus(spark, sf_dir, loo="any", smoothing=0.0).annotators.select("annotator", "marked", "agreed", F.round("reliability", 6).alias("reliability"))


def p2_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _consensus(spark, sf_dir).agreement.select(F.round("alpha", 6).alias("alpha"), "pairable_items", "ratings")


def _concept_baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lookup entries that each work names, spelling apart from letters and digits disregarded."""
    named = _works(spark, sf_dir).select("pmid", F.explode(decode_labels(F.col("llm_concepts"))).alias("label")).select("pmid", letters_digits(F.col("label")).alias("key"))
    lookup = table(spark, sf_dir, "lookup_m").where("concept IS NOT NULL AND id IS NOT NULL").select(letters_digits(F.col("concept")).alias("key"), F.col("id").alias("lookup_id")).where("key != ''")
    return baskets_of(_entries_of(named, lookup, LOOKUP_BROADCAST), "pmid", "lookup_id")


def _entries_of(named: DataFrame, lookup: DataFrame, broadcast_rows: int) -> DataFrame:
    """(pmid, lookup_id) of the named keys; each pmid has a row, without an entry too. A large lookup is joined by shuffle, keys that are named very often by salts."""
    if small(lookup, broadcast_rows):
        return named.join(F.broadcast(lookup), "key", "left").select("pmid", "lookup_id")
    held, side = cut(named), cut(lookup)
    found = skew_join(held, side, "key", broadcast_rows=broadcast_rows).select("pmid", "lookup_id")
    return found.unionByName(held.select("pmid", F.lit(None).cast(side.schema["lookup_id"].dataType).alias("lookup_id")))


def _concept_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs_together(_concept_baskets(spark, sf_dir), min_baskets=8, per_total=5000, min_lift=8)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _concept_pairs(spark, sf_dir).select(F.col("item_a").alias("lookup_id_a"), F.col("item_b").alias("lookup_id_b"))


def p3_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _concept_pairs(spark, sf_dir).select(
        F.col("item_a").alias("lookup_id_a"), F.col("item_b").alias("lookup_id_b"), "n_ab", "n_a", "n_b", "n_total", F.round("lift", 4).alias("lift"), F.round("pmi", 4).alias("pmi")
    )


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = _works(spark, sf_dir).where("pmid IS NOT NULL").select("pmid", F.explode(decode_labels(F.col("llm_concepts"))).alias("label"))
    linked = link_mentions(named, table(spark, sf_dir, "lookup_m"), record="pmid", value="label", entry="concept", entry_id="id")
    return linked.select("pmid", "label", F.col("ref_id").alias("lookup_id"))


def _languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The abstracts of the materials works with the languages that the network finds in them."""
    works = table(spark, sf_dir, "materials_science_works")
    model = fit_labeller(labelled_sample(works, "abstract", named_language(F.col("lang_label"))))
    return label_languages(works.where("id IS NOT NULL"), "id", "abstract", model)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    works = table(spark, sf_dir, "materials_science_works").where("id IS NOT NULL")
    named = works.select("id", named_language(F.col("lang_label")).alias("named")).distinct()
    found = _languages(spark, sf_dir).where("lang IS NOT NULL").withColumn("langs", sentence_languages(F.col("segments"), F.col("lang")))
    cases = found.select("id", "lang", "langs").join(named, "id").where("named IS NULL OR named != lang OR size(langs) > 1")
    return cases.select("id", F.explode("langs").alias("lang")).distinct()


def p5_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _languages(spark, sf_dir).select("id", "lang", F.round("confidence", 4).alias("confidence"))


def p5_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _languages(spark, sf_dir).select("id", F.inline("segments")).withColumn("confidence", F.round("confidence", 4))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(table(spark, sf_dir, "documents"), "doc_id", "text")


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(documents, table(spark, sf_dir, "mix_targets"), key="doc_id", source="source", text="text")


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    shares = mixture_shares(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"), key="doc_id", source="source", text="text")
    return shares.withColumns({c: F.round(c, 6) for c in ("rate", "attainable_share", "actual_share")})


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_shapes(table(spark, sf_dir, "documents"), "doc_id", "text")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).where("flagged").select("doc_id")


def p8_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).withColumn("outside_share", F.round("outside_share", 6))


def p8_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_shapes(cut(line_shapes(table(spark, sf_dir, "documents"), "doc_id", "text"))).withColumn("ended_share", F.round("ended_share", 6))


_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_collapsed, p1_collapsed_hot, p1_members, p2_found, p2_consensus, p2_reliability, p2_agreement, p3_found, p3_pairs, p4_found, p5_found, p5_documents, p5_segments, p6_ids, p7_mix, p7_shares, p8_found, p8_pages, p8_shapes)
}


def _shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _shipped(query) for name, query in _QUERIES.items()}


#: Decoded labels of each work with an identifier, in SQL.
_LABELS = f"{LABELS}, works AS (SELECT pmid, labels FROM labels WHERE pmid IS NOT NULL)"
_KEY = r"regexp_replace(lower({}), '[^\p{{L}}\p{{N}}]+', '', 'g')"
_KEYED = rf"keyed AS (SELECT DISTINCT pmid, list_sort(list_filter(list_transform(labels, lambda x: {_KEY.format('x')}), lambda k: k <> '')) AS k FROM works), held AS (SELECT * FROM keyed WHERE len(k) > 0)"
_BASKETS = rf"named AS (SELECT pmid, unnest(labels) AS label FROM works), ids AS (SELECT DISTINCT pmid, id FROM named JOIN lookup_m ON {_KEY.format('label')} = {_KEY.format('concept')}), n AS (SELECT count(DISTINCT pmid) AS n_total FROM named), s AS (SELECT id, count(*) AS c FROM ids GROUP BY id), ab AS (SELECT a.id AS a, b.id AS b, count(*) AS n_ab FROM ids a JOIN ids b ON a.pmid = b.pmid AND a.id < b.id GROUP BY 1, 2), cases AS (SELECT a, b, n_ab, x.c AS n_a, y.c AS n_b, n_total FROM ab JOIN s x ON x.id = a JOIN s y ON y.id = b, n WHERE n_ab >= 8 AND 5000 * n_ab >= n_total AND n_total * n_ab >= 8 * x.c * y.c)"
_CELLS = ", ".join(
    rf"list_distinct_kept(list_filter(list_transform(list_filter(list_transform(regexp_split_to_array(coalesce({a}, ''), '[,;]'), lambda p: trim(p)), lambda p: lower(p) <> 'n/a'), lambda p: {_KEY.format('p')}), lambda k: k <> '')) AS c{i}".replace("list_distinct_kept", "")
    for i, a in enumerate(ANNOTATORS)
)
_OTHERS = {0: "c1 || c2", 1: "c0 || c2", 2: "c0 || c1"}
_ITEMS = f"""cells AS (SELECT DISTINCT item_id, {_CELLS} FROM annotations WHERE item_id IS NOT NULL), items AS (SELECT *, CAST(len(c0) > 0 AS INTEGER) + CAST(len(c1) > 0 AS INTEGER) + CAST(len(c2) > 0 AS INTEGER) AS marked FROM cells),
people AS ({' UNION ALL '.join(f"SELECT {i} AS person, count(*) FILTER (len(c{i}) > 0) AS marked, count(*) FILTER (list_has_any(c{i}, {_OTHERS[i]})) AS agreed FROM items WHERE marked > 1" for i in range(3))}),
best AS (SELECT *, row_number() OVER (ORDER BY agreed / marked DESC, person) AS place FROM people),
votes AS (SELECT item_id, label, count(*) AS n, min(place) AS place FROM (SELECT item_id, place, i, unnest(list_distinct(CASE person WHEN 0 THEN c0 WHEN 1 THEN c1 ELSE c2 END)) AS label FROM items, best, (SELECT 0 AS i) WHERE items.marked > 1) GROUP BY ALL)"""

#: Ratings of the cells of an item: of the labels of a cell the one in most cells, the first of these in the order named.
_RATINGS = f"""named AS (SELECT item_id, cell, place, label, cell * 1000000 + place AS pos FROM (SELECT item_id, 0 AS cell, unnest(c0) AS label, generate_subscripts(c0, 1) AS place FROM items WHERE marked > 1 UNION ALL SELECT item_id, 1, unnest(c1), generate_subscripts(c1, 1) FROM items WHERE marked > 1 UNION ALL SELECT item_id, 2, unnest(c2), generate_subscripts(c2, 1) FROM items WHERE marked > 1)),
held AS (SELECT item_id, label, count(DISTINCT cell) AS votes, min(pos) AS first_at FROM named GROUP BY ALL),
rated AS (SELECT item_id, cell, arg_max(label, (votes, -first_at)) AS rating FROM (SELECT DISTINCT item_id, cell, label FROM named) JOIN held USING (item_id, label) GROUP BY ALL),
units AS (SELECT item_id, rating, count(*) AS n, sum(count(*)) OVER (PARTITION BY item_id) AS m FROM rated GROUP BY item_id, rating),
seen AS (SELECT sum(n) AS given, count(DISTINCT item_id) AS units, sum(n * (n - 1) / (m - 1)) AS agreed FROM units),
chance AS (SELECT sum(n::DOUBLE * (n - 1)) AS together FROM (SELECT rating, sum(n) AS n FROM units GROUP BY rating))"""

_SQL = {
    "p1_found": f"WITH {_LABELS}, {_KEYED} SELECT a.pmid AS pmid_a, b.pmid AS pmid_b FROM held a JOIN held b ON a.k = b.k AND a.pmid < b.pmid",
    "p1_collapsed": f"WITH {_LABELS}, {_KEYED} SELECT min(pmid) AS pmid, count(*) AS n_works FROM held GROUP BY k",
    "p1_collapsed_hot": f"WITH {_LABELS}, {_KEYED} SELECT min(pmid) AS pmid, count(*) AS n_works FROM held GROUP BY k",
    "p1_members": f"WITH {_LABELS}, {_KEYED} SELECT pmid, min(pmid) OVER (PARTITION BY k) AS same_as, count(*) OVER (PARTITION BY k) AS copies FROM held",
    "p2_found": f"WITH {_ITEMS} SELECT item_id, label AS label_key FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY CAST(n >= 2 AS INTEGER) DESC, place, label) AS r FROM votes) WHERE r = 1",
    "p2_reliability": f"WITH {_ITEMS} SELECT 'annotator' || CAST(person + 1 AS VARCHAR) AS annotator, marked, agreed, round(agreed / marked, 6) AS reliability FROM people",
    "p2_agreement": f"WITH {_ITEMS}, {_RATINGS} SELECT round(1 - (1 - agreed / given) / (1 - together / (given::DOUBLE * (given - 1))), 6) AS alpha, units AS pairable_items, CAST(given AS BIGINT) AS ratings FROM seen, chance",
    "p3_found": f"WITH {_LABELS}, {_BASKETS} SELECT a AS lookup_id_a, b AS lookup_id_b FROM cases",
    "p3_pairs": f"WITH {_LABELS}, {_BASKETS} SELECT a AS lookup_id_a, b AS lookup_id_b, n_ab, n_a, n_b, n_total, round(n_total::DOUBLE * n_ab / (n_a::DOUBLE * n_b), 4) AS lift, round(log2(n_total::DOUBLE * n_ab / (n_a::DOUBLE * n_b)), 4) AS pmi FROM cases",
}


def oracle_sql() -> dict[str, str]:
    """SQL for the problems that SQL states; the others are tested by round trips, brute force and held-out rows."""
    return dict(_SQL)
