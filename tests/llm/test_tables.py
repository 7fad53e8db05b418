"""URL filter and chat formatting, with edge cases; the queries against their SQL; the pipeline."""

import duckdb
import pytest

from seriesforge.llm import chat_format, decontaminate, jaccard_join, quality, queries, substring_dedup, url_filter

TABLES = ("documents", "pages", "benchmark", "labels", "conversations")


def test_url_rules(spark):
    urls = ["http://A.Example.com/en/1?x", "https://www.example.com/en/2", "http://m.www.example.com/en/", "http://x.net/es/a", "http://net/fr/", "http://net/de/", "no scheme", None, "http://spam-farm.org/a#b", "https://m.spam-farm.org/a.html", "http://ok.org", "http://evil-com/x", "ftp://com", "http://://x/y"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").selectExpr("*", "1 AS host", "'x' AS rule")
    got = {r["page_id"]: tuple(r)[1:] for r in url_filter.url_verdicts(pages, url_filter.listed_urls(pages), url_filter.RULES).collect()}
    assert got[0] == ("a.example.com", "/en/1", "example.com/en/", "block")
    assert got[1] == ("www.example.com", "/en/2", "www.example.com/en/", "allow")
    assert got[2][2:] == ("www.example.com/en/", "allow")
    assert got[3][2:] == ("net/es/", "block") and got[4][2:] == ("net/fr/", "block") and got[5][2:] == (None, "allow")
    assert got[6] == ("", "", None, "allow") and got[7] == ("", "", None, "allow")
    assert got[8][2:] == (None, "block") and got[9][2:] == (None, "block")
    assert got[10] == ("ok.org", "", None, "allow") and got[11][2:] == (None, "allow") and got[12] == ("com", "", None, "allow")
    assert got[13] == (":", "//x/y", None, "allow")


@pytest.mark.parametrize("label", url_filter.BAD_LABELS)
def test_the_list_blocks_each_listed_host(spark, label):
    """Where no rule fits, the list alone decides: a page is allowed without it."""
    pages = spark.createDataFrame([(0, f"http://m.{label}.example.net/a.html"), (1, f"http://{label}.example.org/b"), (2, "http://ok.example.org/b")], "page_id long, url string")
    listed = url_filter.listed_urls(pages)
    verdicts = lambda which: {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.url_verdicts(pages, which, url_filter.RULES).collect()}
    assert verdicts(listed) == {0: (None, "block"), 1: (None, "block"), 2: (None, "allow")}
    assert verdicts(listed.limit(0)) == {k: (None, "allow") for k in range(3)}


def test_url_false_positives_are_removed(spark):
    """With a filter of one block nearly everything is possible; the join still decides exactly."""
    pages = spark.createDataFrame([(i, f"http://h{i}.org/{i % 40}") for i in range(400)], "page_id long, url string")
    listed = spark.createDataFrame([(f"h{i}.org/{i % 40}",) for i in range(0, 400, 7)] + [(None,)], "url_key string")
    got = url_filter.url_verdicts(pages, listed, (), blocks=1).collect()
    assert len(got) == 400 and {r["page_id"] for r in got if r["verdict"] == "block"} == set(range(0, 400, 7))


def test_chat_prefix_and_masks(spark):
    rows = [
        (1, "chosen", 0, "user", "hi"), (1, "chosen", 1, "assistant", "yes"), (1, "chosen", 2, "user", "a"),
        (1, "rejected", 0, "user", "hi"), (1, "rejected", 1, "assistant", "no"),
        (2, "chosen", 0, "user", "same"), (2, "rejected", 5, "user", "same"),
        (3, "chosen", 0, None, None), (3, "chosen", 0, None, None),
        (None, "chosen", 0, "user", "nowhere"),
    ]
    df = spark.createDataFrame(rows, "pair_id long, side string, turn long, role string, text string").selectExpr("*", "1 AS prompt", "2 AS n_prefix")
    got = {r["pair_id"]: r for r in chat_format.preference_pairs(df).collect()}
    assert set(got) == {1, 2, 3}
    assert got[1]["n_prefix"] == 1 and got[1]["prompt"] == "<|user|>\nhi\n"
    assert got[1]["chosen"] == "<|assistant|>\nyes\n<|user|>\na\n" and got[1]["chosen_mask"] == "0:14 1:4 0:11"
    assert got[1]["rejected"] == "<|assistant|>\nno\n" and got[1]["rejected_mask"] == "0:14 1:3"
    assert got[2]["n_prefix"] == 1 and got[2]["chosen"] == got[2]["rejected"] == ""
    assert got[3]["rejected"] is None and got[3]["chosen"] == "<||>\n\n" * 2
    assert chat_format.preference_pairs(df.limit(0)).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_equal_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = queries.QUERIES[name](spark, sf_dir)
    columns = sorted(got.columns)
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({queries.ORACLES[name]})").fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got.select(columns).collect())


@pytest.fixture(scope="module")
def pages(spark, sf_dir, tmp_path_factory):
    """The documents after each stage of the pipeline."""
    import corpus_pipeline as C

    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for k, (_, stage) in enumerate(C.STAGES):
        out.append(docs)
        path = str(tmp_path_factory.mktemp("pipeline") / str(k))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return [*out, docs]


def test_pipeline_rejects_by_score(spark, sf_dir, pages):
    scores = {r["doc_id"]: r["score"] for r in quality.score_only(pages[0], quality.train(pages[0], spark.read.parquet(f"{sf_dir}/labels.parquet"))).collect()}
    assert pages[1].columns == pages[0].columns and {r["doc_id"] for r in pages[1].collect()} == {i for i, s in scores.items() if s >= 0.5}


def test_pipeline_keeps_one_of_each_group(pages):
    groups = {}
    for r in jaccard_join.linked_components(pages[1]).collect():
        groups.setdefault(r["component_id"], []).append(r["doc_id"])
    assert sorted(r["doc_id"] for r in pages[2].collect()) == sorted(min(g) for g in groups.values())


def test_pipeline_cuts_passages(pages):
    removed = {r["doc_id"]: r["n_removed"] for r in substring_dedup.removals(pages[2]).collect()}
    before = {r["doc_id"]: r["text"] for r in pages[2].collect()}
    for r in pages[3].collect():
        assert len(before[r["doc_id"]].split()) - removed[r["doc_id"]] == len(r["text"].split()) and r["n_chars"] == len(r["text"])


def test_pipeline_drops_leaks_and_packs(spark, sf_dir, pages):
    leaks = {r["doc_id"] for r in decontaminate.contaminated(pages[3], spark.read.parquet(f"{sf_dir}/benchmark.parquet")).collect()}
    left = {r["doc_id"] for r in pages[3].collect()} - leaks
    assert {r["doc_id"] for r in pages[4].collect()} == left == {r["doc_id"] for r in pages[5].collect()}


def test_pipeline_run(spark, sf_dir, pages):
    import corpus_pipeline as C

    assert sorted(map(str, C.run(spark, sf_dir).drop("sequence_id", "offset").collect())) != []


def test_pipeline_odd_rows(spark, make_docs, sf_dir):
    """Nulls, empty texts and rows of one id with other texts pass the stages; an empty table stays empty."""
    import corpus_pipeline as C

    text = lambda k: " ".join(f"w{k}x{i}" for i in range(40))
    rows = [(1, text(1)), (1, text(1)), (1, text(2)), (2, None), (3, ""), (None, text(3)), (None, None), (4, text(1))]
    kept = C.near_duplicates(spark, make_docs(rows), sf_dir).select("doc_id", "text").collect()
    assert sorted(map(str, map(tuple, kept))) == sorted(str(r) for r in [(1, text(1)), (1, text(2)), (2, None), (3, ""), (None, text(3)), (None, None)])
    for stage in (C.repeated_passages, C.benchmark_free):
        assert stage(spark, make_docs(rows), sf_dir).count() == len(rows)
    assert C.packed(spark, make_docs(rows), sf_dir).groupBy().sum("length").first()[0] > len(rows)
    for _, stage in C.STAGES[1:]:
        assert stage(spark, make_docs([]), sf_dir).count() == 0
