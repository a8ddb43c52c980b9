"""Sources, sinks, states and clients, with stand-ins for services."""

from collections import Counter
from datetime import date, timedelta
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from corpusloom.functions.dates import date_bounds
from corpusloom.operators import extraction as X
from corpusloom.sources import articles as A
from corpusloom.sources import readers as R
from corpusloom.sources.rest import CursorClient, RetryingClient

ARTICLE = """<PubmedArticle><MedlineCitation><PMID>{pmid}</PMID><Article><Journal><JournalIssue><PubDate>{pub}</PubDate></JournalIssue><Title>Journal of Tests</Title></Journal>
<ArticleTitle>{title}</ArticleTitle><Abstract><AbstractText Label="METHODS">{abstract}</AbstractText></Abstract><Language>{language}</Language>
<PublicationTypeList><PublicationType>{kind}</PublicationType></PublicationTypeList>{day}</Article>
<MeshHeadingList><MeshHeading><DescriptorName>Skull</DescriptorName></MeshHeading><MeshHeading><DescriptorName>Skull</DescriptorName></MeshHeading></MeshHeadingList></MedlineCitation>
<PubmedData><ArticleIdList><ArticleId IdType="doi">10.5555/mesh.7</ArticleId></ArticleIdList></PubmedData></PubmedArticle>"""
GOOD = {"pmid": "77", "pub": "<Year>2016</Year>", "title": "Titanium <b>mesh</b> plates", "abstract": "Forty plates were followed for two years. " * 9, "language": "eng", "kind": "Clinical Trial", "day": "<ArticleDate><Year>2017</Year><Month>Nov</Month><Day>21</Day></ArticleDate>"}


def article(**changes):
    return ARTICLE.format(**(GOOD | changes))


def test_article_record():
    r = A.article_record(ElementTree.fromstring(article()))
    assert (r["id"], r["publication_date"], r["display_name"], r["doi"], r["mesh_terms"], r["reason"]) == ("PMID:77", "2017-11-21", "Titanium mesh plates", "10.5555/mesh.7", "Skull", None)
    assert r["abstract"].startswith("METHODS: Forty plates")


@pytest.mark.parametrize(
    ("changes", "reason"),
    [
        ({"pmid": ""}, "missing_pmid"), ({"title": ""}, "missing_title"), ({"abstract": ""}, "missing_abstract"), ({"day": "", "pub": ""}, "missing_publication_date"), ({"title": "short"}, "title_too_short"),
        ({"abstract": "b" * 291}, "abstract_too_short"), ({"abstract": "b" * 292}, None), ({"abstract": "b" * 3991}, "abstract_too_long"), ({"language": "fre"}, "non_english"), ({"kind": "Letter"}, "excluded_publication_type"), ({"kind": "Retracted Publication"}, "excluded_publication_type"),
    ],
)
def test_reasons(changes, reason):
    assert A.article_record(ElementTree.fromstring(article(**changes)))["reason"] == reason


@pytest.mark.parametrize(("xml", "day"), [("<Year>2001</Year>", "2001-01-01"), ("<MedlineDate>Spring 1999-2000</MedlineDate>", "1999-01-01"), ("<Year>2001</Year><Month>Sept.</Month><Day>40</Day>", "2001-09-01"), ("", None)])
def test_partial_dates(xml, day):
    assert A.iso_date(ElementTree.fromstring(f"<PubDate>{xml}</PubDate>")) == day


def test_parse_articles_with_broken_document(spark):
    df = spark.createDataFrame([(f"<Set>{article()}{article(pmid='78')}</Set>",), ("<Set>",), (None,)], "xml string")
    assert sorted((r["pmid"] or "", r["reason"] or "") for r in A.parse_articles(df, "xml").collect()) == [("", "unparseable_xml"), ("77", ""), ("78", "")]


def test_fetch_halves_broken_replies():
    fetch = lambda ids: "<broken" if "3" in ids else f"<Set>{''.join(article(pmid=i) for i in ids if i != '5')}</Set>"
    records, left, unreadable = A.fetch_articles(fetch, list("123456"), batch=4)
    assert ([r["pmid"] for r in records], left, unreadable) == (["1", "2", "4", "6"], ["3", "5"], 1)


def test_date_slicing():
    def search(start, end):
        days = [end - timedelta(days=i) for i in range((end - start).days + 1)]
        ids = [f"{d:%m%d}-{i}" for d in days for i in range(70)]
        return len(ids), lambda n: ids[:n]

    out = A.sliced_ids(search, date(2014, 5, 30), date(2014, 6, 3), limit=150, most=140)
    assert (len(out["ids"]), out["ids"][0], out["ids"][-1], out["missing"], out["oversized"]) == (150, "0603-0", "0601-9", 0, 0)
    assert [c for _, _, c in out["slices"]] == [350, 140, 210, 70]
    with pytest.raises(RuntimeError):
        A.sliced_ids(lambda a, b: (141, list), date(2014, 6, 1), date(2014, 6, 1), most=140)


def test_queries_and_bounds():
    assert A.one_line(" a\n  b ") == "a b"
    assert '"2014/05/30"[Date - Publication] : "2014/06/03"' in A.dated_query("x", date(2014, 5, 30), date(2014, 6, 3))
    assert "retracted" not in A.dated_query("x", date(2014, 5, 30), date(2014, 6, 3)).lower()
    with pytest.raises(ValueError):
        A.yearly_query("x", 2021, 2020)
    assert date_bounds(2000, 2030, date(2025, 5, 1)) == (date(2000, 1, 1), date(2025, 5, 1))
    assert A.paged_ids(lambda start, n: [str(i // 2) for i in range(start, start + n)], 12, limit=10, size=4) == list("01234")


def test_retrying_client():
    replies, waits, now = [(429, {"Retry-After": "7"}, ""), (500, {}, ""), (200, {}, "{}")], [], [0.0]

    def sleep(s):
        waits.append(s)
        now[0] += s

    client = RetryingClient(lambda u, p: replies.pop(0), delay=1, sleep=sleep, clock=lambda: now[0])
    assert client.get_json("u", {}) == {}
    assert waits == [7.0, 2]
    with pytest.raises(RuntimeError):
        RetryingClient(lambda u, p: (404, {}, ""), sleep=sleep, clock=lambda: now[0]).get("u", {})


def test_cursor_client_limit():
    get = lambda url, p: {"results": [{"id": int(p["cursor"].replace("*", "0")) + i} for i in range(3)], "meta": {"next_cursor": str(int(p["cursor"].replace("*", "0")) + 3)}}
    assert [r["id"] for page in CursorClient(get, "u", ["id"], limit=7).pages("") for r in page] == list(range(7))


def test_csv_round_trip_and_checks(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "quoted", text'), (2, "two\nlines"), (3, None)], "id int, t string")
    R.write_csv(df, str(tmp_path / "c"))
    assert sorted(map(tuple, R.read_csv(spark, str(tmp_path / "c"), "id int, t string", multi_line=True).collect())) == sorted(map(tuple, df.collect()))
    with pytest.raises(ValueError):
        R.require_columns(df, "x")
    with pytest.raises(ValueError):
        R.require_unique(df.union(df), "id")
    assert R.require_unique(df, "id") is df


def test_listed_values(spark):
    listed = spark.createDataFrame([("a",), ("b",), (None,)], "name string")
    asked = spark.createDataFrame([("a",), ("a",), (None,)], "name string")
    assert R.require_listed(asked, listed, "name") is asked
    with pytest.raises(ValueError, match="not listed: c, d"):
        R.require_listed(asked.union(spark.createDataFrame([("d",), ("c",)], "name string")), listed, "name")


def test_command_line(spark, data, tmp_path, capsys):
    from corpusloom.__main__ import main

    assert main(["list"]) == 0 and "grf1_graph_build" in capsys.readouterr().out.split()
    assert main(["run", "no_such_query", data, str(tmp_path / "x")]) == 2
    for kind, rows in (("parquet", lambda p: spark.read.parquet(p)), ("csv", lambda p: R.read_csv(spark, p, "l_suppkey bigint, n bigint"))):
        out = str(tmp_path / kind)
        assert main(["run", "dat3_cutoffs", data, out, "--format", kind], spark) == 0 and rows(out).count() > 0
    with pytest.raises(Exception, match="already exists"):
        main(["run", "dat3_cutoffs", data, str(tmp_path / "parquet")], spark)
    assert main(["run", "dat3_cutoffs", data, str(tmp_path / "parquet"), "--overwrite"], spark) == 0


def test_text_blocks(spark, tmp_path):
    (tmp_path / "ada_l.txt").write_text("\nlink1\ntitle1\nauthor1\nabstract1\n\nlink2\ntitle2\nauthor2\nabstract2\n \n")
    rows = R.read_blocks(spark, str(tmp_path)).orderBy("line_no").collect()
    assert [(r["source"], r["link"], r["abstract"]) for r in rows] == [("ada_l.txt", "link1", "abstract1"), ("ada_l.txt", "link2", "abstract2")]


def test_json_lines_with_errors(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\nbroken\n')
    rows = R.read_json_lines(spark, str(tmp_path / "x.jsonl"), "a int", strict=False).collect()
    assert [(r["a"], r["_corrupt_record"]) for r in rows] == [(1, None), (None, "broken")]


def test_listed_labels_and_state(spark, tmp_path):
    (tmp_path / "l.csv").write_text("abc,1\n\nd e,2\n")
    assert sorted(r[0] for r in R.listed_labels(spark, path=str(tmp_path / "l.csv")).collect()) == ["abc", "d e"]
    path = str(tmp_path / "s" / "state.json")
    assert R.read_state(spark, path) is None
    for n in (1, 2):
        R.write_state(spark, {"b": n}, path)
        R.append_failure(spark, str(tmp_path / "failures"), {"id": n})
    assert R.read_state(spark, path) == {"b": 2}
    assert sorted(r["id"] for r in R.read_json_lines(spark, str(tmp_path / "failures"), "id int").collect()) == [1, 2]


def test_packed_requests(spark):
    df = spark.createDataFrame([(i, "x" * (400 if i == 3 else 40)) for i in range(8)], "id int, body string")
    files = {r["key"]: r["file"] for r in R.packed_requests(df, "id", "body", most_rows=3, most_bytes=130, most_tokens=1000).collect()}
    assert files == {0: 0, 1: 0, 2: 0, 3: 1, 4: 2, 5: 2, 6: 2, 7: 3}


def test_extraction_runs_and_resumes(spark):
    class Client:
        def complete(self, records):
            if records[0]["id"] == 1:
                raise TimeoutError("slow")
            return "ok"

    works = spark.createDataFrame([(i,) for i in range(1, 6)], "id int")
    batches = X.batches_in_order(works, [F.col("id")], 2, "id")
    assert [[i["id"] for i in r["items"]] for r in batches.orderBy("batch").collect()] == [[1, 2], [3, 4], [5]]
    out = {r["batch"]: (r["reply"], r["error"]) for r in X.run_extraction(batches, Client()).collect()}
    assert out == {0: (None, "TimeoutError: slow"), 1: ("ok", None), 2: ("ok", None)}
    saved = spark.createDataFrame([(1, '["old"]'), (2, "[]"), (3, " ")], "id int, c string")
    assert {r["id"]: r["c"] for r in X.resumed(works, saved, "id", "c").collect()} == {1: '["old"]', 2: None, 3: None, 4: None, 5: None}
    assert {r["id"]: r["c"] for r in X.resumed(works, saved, "id", "c", keep_invalid=True).collect()}[2] == "[]"
    assert X.settings_hash({"a": 1, "b": 2}) == X.settings_hash({"b": 2, "a": 1})


def test_batch_jobs():
    class Service:
        def submit(self, path):
            return f"job-{path}"

        def status(self, job):
            return None if job == "job-b" else "completed"

        def result(self, job):
            return [job]

    jobs = X.BatchJobs(Service())
    assert jobs.submit(["a", "b"], most_open=2) == ["a", "b"] and jobs.submit(["a"]) == []
    assert jobs.refresh() == {"completed": 1, "not_found": 1}
    assert jobs.collect() == ["job-a"] and jobs.collect() == []


def test_slices_of_a_table_in_one_pass(spark):
    """However many slices there are, the table is counted once and read once more, and no id comes to the driver."""
    rows = spark.range(3000).select("id", F.date_add(F.lit(date(2014, 5, 30)), (F.col("id") % 40).cast("int") - 1).alias("day"))
    group = "slices of a table"
    spark.sparkContext.setJobGroup(group, group)
    found = A.sliced_rows(rows, date(2014, 5, 30), date(2014, 6, 30), most=160).collect()
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert sorted(r["id"] for r in found) == [i for i in range(3000) if 1 <= i % 40 <= 32] and jobs <= 8
    sizes = Counter((r["first"], r["last"]) for r in found)
    assert len(sizes) == 16 and max(sizes.values()) <= 160 and all(r["first"] <= r["day"] <= r["last"] for r in found)
    with pytest.raises(RuntimeError, match="more than 74 records"):
        A.sliced_rows(rows, date(2014, 5, 30), date(2014, 6, 30), most=74)
