"""Bibliographic XML: records of articles, and searches that are sliced by date.

Searches and fetches take plain functions, so tests and other services can stand in.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import date, timedelta
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.dates import MONTHS, middle_day

#: Reasons for which an article is left out, in the order in which they are tried.
REASONS = ("missing_pmid", "missing_title", "missing_abstract", "missing_publication_date", "title_too_short", "abstract_too_short", "abstract_too_long", "non_english", "excluded_publication_type")
#: How English is written in records, and types of publication whose records are left out.
ENGLISH = ("en", "eng", "english")
EXCLUDED_TYPES = ("review", "systematic review", "meta-analysis", "editorial", "letter", "comment", "case reports", "retracted publication")
#: Types that a search leaves out; retracted ones come back from it and are left out by their record.
SEARCH_EXCLUDED_TYPES = ("review", "systematic review", "meta-analysis", "editorial", "letter", "comment", "case reports")
#: Fixed value: conditions that every search carries.
SEARCH_CONDITIONS = "AND hasabstract[text] AND english[lang] AND humans[Mesh] NOT (" + " OR ".join(f"{t}[Publication Type]" for t in SEARCH_EXCLUDED_TYPES) + ")"

RECORD = "id string, pmid string, doi string, display_name string, publication_date string, publication_year int, abstract string, source_id string, mesh_terms string, publication_types string, languages string, is_retracted boolean, reason string"


def one_line(query: str) -> str:
    return " ".join(query.split())


def dated_query(query: str, start: date, end: date) -> str:
    """The query with the common conditions and a range of publication days."""
    if start > end:
        raise ValueError("the first day is after the last")
    return f'({one_line(query)}) {SEARCH_CONDITIONS} AND ("{start:%Y/%m/%d}"[Date - Publication] : "{end:%Y/%m/%d}"[Date - Publication])'


def yearly_query(query: str, first: int, last: int) -> str:
    if first > last:
        raise ValueError("the first year is after the last")
    return f'({one_line(query)}) {SEARCH_CONDITIONS} AND ("{first}"[Date - Publication] : "{last}"[Date - Publication])'


def _text(node: ElementTree.Element | None) -> str:
    return "" if node is None else " ".join("".join(node.itertext()).split())


def _texts(root: ElementTree.Element, path: str) -> list[str]:
    return [t for t in map(_text, root.findall(path)) if t]


def _number(text: str) -> int | None:
    return int(text) if text.lstrip("+-").isdigit() else None


def iso_date(node: ElementTree.Element | None) -> str | None:
    """Date of an element with Year, Month and Day or with a free MedlineDate; missing parts are 1, without a year there is none."""
    if node is None:
        return None
    years = [_number(_text(node.find("Year"))), *(_number(t[:4]) for t in _text(node.find("MedlineDate")).split())]
    year = next((y for y in years if y is not None), None)
    if year is None:
        return None
    name = _text(node.find("Month")).lower().rstrip(".")
    named = [i for i, m in enumerate(MONTHS, 1) if name and (name in (m, m[:3]) or name == "sept" and i == 9)]
    month = _number(name) or (named[0] if named else 1)
    day = _number(_text(node.find("Day"))) or 1
    return f"{year:04d}-{month if 1 <= month <= 12 else 1:02d}-{day if 1 <= day <= 31 else 1:02d}"


def article_record(article: ElementTree.Element, title_chars: int = 10, abstract_chars: tuple[int, int] = (300, 4000)) -> dict:
    """The fields of an article, and in ``reason`` the first reason to leave it out, or None."""
    citation = "./MedlineCitation/Article"
    labelled = [(p.get("Label"), _text(p)) for p in article.findall(f"{citation}/Abstract/AbstractText")]
    abstract = " ".join(f"{label}: {t}" if label else t for label, t in labelled if t)
    types, languages = _texts(article, f"{citation}/PublicationTypeList/PublicationType"), _texts(article, f"{citation}/Language")
    doi = next((_text(i) for i in article.findall("./PubmedData/ArticleIdList/ArticleId") if i.get("IdType", "").lower() == "doi"), "")
    pmid, title = _text(article.find("./MedlineCitation/PMID")), _text(article.find(f"{citation}/ArticleTitle"))
    day = iso_date(article.find(f"{citation}/ArticleDate")) or iso_date(article.find(f"{citation}/Journal/JournalIssue/PubDate"))
    failed = (
        not pmid, not title, not abstract, not day, len(title) < title_chars, len(abstract) <= abstract_chars[0], len(abstract) >= abstract_chars[1],
        not any(x.casefold() in ENGLISH for x in languages), any(t.casefold() in EXCLUDED_TYPES for t in types),
    )
    joined = lambda xs: "; ".join(dict.fromkeys(xs))
    return {
        "id": f"PMID:{pmid}", "pmid": pmid, "doi": doi, "display_name": title, "publication_date": day, "publication_year": int(day[:4]) if day else None, "abstract": abstract,
        "source_id": _text(article.find(f"{citation}/Journal/Title")), "mesh_terms": joined(_texts(article, "./MedlineCitation/MeshHeadingList/MeshHeading/DescriptorName")),
        "publication_types": joined(types), "languages": joined(languages), "is_retracted": "Retracted Publication" in types,
        "reason": next((r for r, f in zip(REASONS, failed) if f), None),
    }


def parse_articles(df: DataFrame, xml: str) -> DataFrame:
    """One row for each article in the XML documents of a column; a document that cannot be read gives one row with the reason ``unparseable_xml``."""
    names = [f.split()[0] for f in RECORD.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch["xml"]:
                try:
                    rows += [article_record(a) for a in ElementTree.fromstring(text).iter("PubmedArticle")] if text else []
                except ElementTree.ParseError:
                    rows.append({"reason": "unparseable_xml"})
            frame = pd.DataFrame(rows, columns=names, dtype=object)
            frame["publication_year"] = frame["publication_year"].astype("Int32")
            yield frame

    return df.select(F.col(xml).alias("xml")).mapInPandas(run, RECORD)


def fetch_articles(fetch: Callable[[list[str]], str], pmids: list[str], batch: int = 200) -> tuple[list[dict], list[str], int]:
    """(records, ids that did not come back, replies that could not be read): replies that cannot be read are asked for again in halves."""
    records, unreadable = [], 0
    queue = [pmids[i : i + batch] for i in range(0, len(pmids), batch)]
    while queue:
        part = queue.pop(0)
        try:
            records += [article_record(a) for a in ElementTree.fromstring(fetch(part)).iter("PubmedArticle")]
        except ElementTree.ParseError:
            if len(part) > 1:
                queue = [part[: len(part) // 2], part[len(part) // 2 :], *queue]
            else:
                unreadable += 1
    returned = {r["pmid"] for r in records}
    return records, [p for p in pmids if p not in returned], unreadable


def paged_ids(page: Callable[[int, int], list[str]], count: int, limit: int = 10_000, size: int = 500) -> list[str]:
    """Distinct ids in order, at most ``limit``, from ``page(start, size)``."""
    wanted = min(count, limit)
    found: dict[str, None] = {}
    for start in range(0, wanted, size):
        found.update(dict.fromkeys(page(start, min(size, wanted - start))))
    return list(found)


def sliced_ids(search: Callable[[date, date], tuple[int, Callable[[int], list[str]]]], start: date, end: date, *, limit: int = 0, most: int = 10_000) -> dict:
    """Ids of a range of days, newest first, from a search that returns at most ``most`` at a time.

    ``search(start, end)`` gives (count, take). A range with more than ``most`` is halved, its newer half
    first. A single day with more is cut to ``most`` if a ``limit`` is set, and fails otherwise.
    Returns ids, slices, missing and oversized.
    """
    out: dict = {"ids": [], "slices": [], "missing": 0, "oversized": 0}
    ranges = [(start, end)]
    while ranges and not (limit and len(out["ids"]) >= limit):
        first, last = ranges.pop()
        count, take = search(first, last)
        out["slices"].append((first, last, count))
        if count > most and first < last:
            middle = middle_day(first, last)
            ranges += [(first, middle), (middle + timedelta(days=1), last)]
            continue
        if count > most:
            if not limit:
                raise RuntimeError(f"more than {most} records on {first}")
            out["oversized"] += 1
        if count:
            wanted = min(count, most)
            ids = take(wanted)
            out["missing"] += wanted - len(ids)
            out["ids"] += ids[: limit - len(out["ids"])] if limit else ids
    return out


def sliced_rows(rows: DataFrame, start: date, end: date, *, day: str = "day", most: int = 10_000) -> DataFrame:
    """``rows`` of a range of days with their slice, (first, last) of :func:`sliced_ids`, for a table that stands in for the service.

    Rows are counted by day once, which answers all searches; one pass then gives the rows of all slices,
    none of which comes to the driver.
    """
    found = rows.where(F.col(day).between(F.lit(start), F.lit(end))).groupBy(day).agg(F.count(F.lit(1)).alias("n")).collect()  # a row a day of the range
    by_day = {r[day]: r["n"] for r in found}
    until, sums = 0, [0]
    for i in range((end - start).days + 1):
        until += by_day.get(start + timedelta(days=i), 0)
        sums.append(until)

    def search(first: date, last: date) -> tuple[int, Callable[[int], list]]:
        return sums[(last - start).days + 1] - sums[(first - start).days], lambda n: [(first, last)]

    slices = sliced_ids(search, start, end, most=most)["ids"]
    days = [(first + timedelta(days=i), first, last) for first, last in slices for i in range((last - first).days + 1)]
    return rows.join(F.broadcast(rows.sparkSession.createDataFrame(days, f"{day} date, first date, last date")), day)


def modules_of_ids(found: DataFrame) -> DataFrame:
    """(pmid, modules) from (module, seq, pmid): the modules that found an id, in the order in which they come, each once."""
    first = found.groupBy("pmid", "module").agg(F.min("seq").alias("seq"))
    return first.groupBy("pmid").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "module"))), lambda x: x["module"]).alias("modules"))
