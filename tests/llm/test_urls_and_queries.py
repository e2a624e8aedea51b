"""The URL filter on odd inputs, every registered query against its SQL, and the pipeline."""

import os

import pytest

import corpus_pipeline
from gridloom.llm import decontaminate, jaccard_join, queries, url_filter
from suite.compare import canonical, connect

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
data = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


def test_hosts_paths_and_rules(spark):
    urls = [
        ("HTTPS://Sub.Example.COM/de/x?q=1", "sub.example.com", "/de/x", "example.com/de/", "block"), ("http://example.net/en/1#a", "example.net", "/en/1", "example.net/en/", "allow"),
        ("http://a.net", "a.net", "", None, "allow"), ("http://a.net/?x", "a.net", "/", "net/", "block"), ("no scheme", "", "", None, "allow"), (None, "", "", None, "allow"),
        ("", "", "", None, "allow"), ("http://notexample.com/de/1", "notexample.com", "/de/1", None, "allow"), ("x://o.org/fr/", "o.org", "/fr/", "org/fr/", "allow"),
        ("http://h/" + "a/" * 3000, "h", "/" + "a/" * 3000, None, "allow"), ("http://a.net/?x", "a.net", "/", "net/", "block"),
    ]
    pages = spark.createDataFrame([(i, u[0], "x", "y") for i, u in enumerate(urls)], "page_id bigint, url string, host string, template string")
    got = {r["rec"]["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.filter_urls(pages).collect()}
    assert got == {i: u[1:] for i, u in enumerate(urls)}
    assert url_filter.filter_urls(pages.where("page_id < 0")).count() == 0


def test_templates_and_purity(spark):
    pages = [(i, f"http://h/item/{i}/view") for i in range(30)] + [(100 + i, f"http://h/spam/{i}") for i in range(60)]
    df = spark.createDataFrame(pages, "page_id bigint, url string")
    rules = tuple(("block", f"h/spam/{i}") for i in range(3, 10)) + (("allow", "h/item/1"),)
    got = url_filter.filter_urls(df, rules=rules)
    assert {r["template"] for r in got.select("template").distinct().collect()} == {"/item/*/view", "/spam/*"}
    verdicts = {(r["template"], r["verdict"]) for r in got.where("rule is null").select("template", "verdict").distinct().collect()}
    assert verdicts == {("/item/*/view", "allow"), ("/spam/*", "block")}


@data
@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_agrees_with_sql(spark, name):
    df = queries.QUERIES[name](spark, SF_DIR)
    mine = [tuple(r) for r in df.collect()]
    assert mine
    if name in queries.ORACLE:
        result = connect(SF_DIR).execute(queries.ORACLE[name])
        columns = [d[0] for d in result.description]
        assert sorted(columns) == sorted(df.columns)
        assert canonical(df.columns, mine) == canonical(columns, result.fetchall())


def test_native_plan(spark):
    if not os.path.isdir(SF_DIR):
        pytest.skip("no test tables")
    plan = queries.QUERIES["op8_url_filter"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas", "CartesianProduct"))


@data
def test_pipeline_stage_by_stage(spark, folder):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF_DIR).write.parquet(folder(f"s{k}"))
        out = spark.read.parquet(folder(f"s{k}"))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns, name
        before, after = {r["doc_id"]: r for r in docs.collect()}, {r["doc_id"]: r for r in out.collect()}
        assert len(after) == out.count() and set(after) <= set(before)
        if name == "language ID":
            assert len(after) >= 0.98 * len(before)
        elif name == "n-gram Jaccard join":
            groups = jaccard_join.join_groups(docs, keep=["doc_id"]).select("component", "n_shingles").where("n_shingles > 0")
            assert len(after) == groups.select("component").distinct().count()
        elif name == "benchmark decontamination":
            judged = decontaminate.decontaminate(docs, spark.read.parquet(f"{SF_DIR}/benchmark.parquet"), keep=["doc_id"])
            assert set(after) == {r[0] for r in judged.where("n_hit = 0").select("rec.doc_id").collect()}
        elif name == "secret scan":
            changed = [i for i in after if after[i]["text"] != before[i]["text"]]
            assert all("[SECRET]" in after[i]["text"] and after[i]["n_chars"] == len(after[i]["text"]) for i in changed)
            assert set(after) == set(before)
        else:
            assert after.keys() == before.keys() and out.where("n_tokens < 1").count() == 0
        docs = out


def test_pipeline_on_odd_documents(spark, odd_docs, folder):
    bench = spark.createDataFrame([(1, "nothing of the kind")], "item_id bigint, text string")
    bench.write.parquet(folder("benchmark.parquet"))
    docs = odd_docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder("")).write.parquet(folder(f"o{k}"))
        docs = spark.read.parquet(folder(f"o{k}"))
    assert docs.count() > 0 and docs.where("decoded_sha256 is null").count() == 0
    empty = odd_docs.where("doc_id < -5")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, empty, folder("")).write.parquet(folder(f"e{k}"))
        empty = spark.read.parquet(folder(f"e{k}"))
    assert empty.count() == 0


def test_run_is_the_last_stage(spark):
    if not os.path.isdir(SF_DIR):
        pytest.skip("no test tables")
    assert {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(corpus_pipeline.run(spark, SF_DIR).columns)


def test_unlabelled_branches_are_judged_by_those_alike(spark):
    """Branches with the same spread of templates share counts; one with another spread keeps its own and is allowed."""
    urls = [f"http://h/{b}/{b}{i}{end}" for b in ("bad", "twin") for i in range(20) for end in ("", "/x")]
    urls += [f"http://h/other/o{i}" for i in range(40)]
    urls += [f"http://calm/{b}/{b}{i}" for b in ("good", "twin") for i in range(20)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    got = url_filter.filter_urls(df, rules=(("block", "h/bad/"), ("allow", "calm/good/")))
    verdicts = {(r["host"], r["template"], r["verdict"]) for r in got.where("rule is null").select("host", "template", "verdict").distinct().collect()}
    assert verdicts == {
        ("h", "/twin/*", "block"), ("h", "/twin/*/x", "block"), ("h", "/other/*", "allow"), ("calm", "/twin/*", "allow"),
    }


def test_levels_below_variable_words_are_counted_together(spark):
    words = "ash beech cedar date elm fir gum hazel".split()
    pages = [(i, f"http://h/user/{w}/{v}{w}") for i, (w, v) in enumerate((w, v) for w in words for v in ("in", "out"))]
    got = url_filter.filter_urls(spark.createDataFrame(pages, "page_id bigint, url string"), rules=())
    assert {r["template"] for r in got.select("template").distinct().collect()} == {"/user/*/*"}


@data
def test_the_tree_rejects_pages_that_no_rule_fits(spark):
    pages = spark.read.parquet(f"{os.path.dirname(SF_DIR)}/sf0.1/pages.parquet")
    free = url_filter.filter_urls(pages).where("rule is null").groupBy("verdict").count().collect()
    assert {r["verdict"] for r in free} == {"allow", "block"}
