"""URL filter, classifier, pipeline, and the registered queries with SQL against DuckDB."""

import duckdb
import pytest


def tables(sf_dir):
    c = duckdb.connect()
    for t in ("documents", "pages", "labels", "embeddings"):
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", ["op4_url_filter", "op5_mixing"])
def test_oracles(spark, sf_dir, name):
    from tracelode.llm import catalogue

    got = catalogue.queries()[name](spark, sf_dir).toPandas()
    want = tables(sf_dir).execute(catalogue.oracle_sql()[name]).df()[list(got.columns)]
    key = list(got.columns)[0]
    got, want = (x.sort_values(key).reset_index(drop=True) for x in (got, want))
    assert len(got) == len(want)
    for c in got.columns:
        a, b = got[c].astype(object).where(got[c].notna(), None), want[c].astype(object).where(want[c].notna(), None)
        assert a.tolist() == b.tolist(), c


def test_url_rules_and_terms(spark):
    from tracelode.llm import url_filter

    urls = [
        None, "", "no scheme", "http://EXAMPLE.com/en/x?y", "http://www.example.com/en/1#t", "http://a.net/es/", "http://net/fr/1", "http://xnet/fr/", "http://a.org",
        "http://a.org/porn", "http://a.org/pornography", "http://a.org/casino/poker", "http://a.org/casino/casino", "http://a.org/xxx-sex", "http://a.com", "x://b.com/porn",
    ]
    df = spark.createDataFrame([(i, u, "k") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    got = {r.page_id: (r.host, r.rule, r.verdict) for r in url_filter.judge_urls(df, "page_id", "url").collect()}
    assert got[0] == got[1] == got[2] == ("", None, "allow")
    assert got[3] == ("example.com", "example.com/en/", "block") and got[4][1:] == ("www.example.com/en/", "allow")
    assert got[5][1:] == ("net/es/", "block") and got[6][1:] == ("net/fr/", "block") and got[7][1:] == (None, "allow") and got[8][1:] == (None, "allow")
    assert [got[i][2] for i in range(9, 16)] == ["block", "allow", "block", "allow", "block", "allow", "allow"]
    assert all(0 < w < url_filter.SOFT_LIMIT for w in url_filter.SOFT.values()) and len(set(url_filter.SOFT.values())) > 4
    # the weights decide: as many terms in each
    pairs = spark.createDataFrame([(1, "http://a.org/sex-free-win"), (2, "http://a.org/sex-bonus"), (3, "http://a.org/free-deal-win-cash-credit-download"), (4, "http://a.org/poker/slots")], "page_id long, `the.url` string")
    got = {r.page_id: (r.verdict, r.soft_hits, r.soft_weight) for r in url_filter.judge_urls(pairs, "page_id", "the.url").collect()}
    assert got == {1: ("block", 3, 2.0), 2: ("block", 2, 2.0), 3: ("allow", 6, 1.75), 4: ("block", 2, 2.0)}
    assert url_filter.judge_urls(df.limit(0), "page_id", "url").count() == 0


def test_vocabulary_of_a_file(spark, tmp_path):
    from tracelode.llm import url_filter

    (tmp_path / "terms.tsv").write_text("# terms\n\nstrict\tbad one\n0.5\tsoft\n1.5\tsofter\n")
    v = url_filter.Vocabulary.read(spark, str(tmp_path / "terms.tsv"))
    assert v.strict == ("bad one",) and v.soft == {"soft": 0.5, "softer": 1.5}
    df = spark.createDataFrame([(1, "http://a.org/soft/softer"), (2, "http://a.org/softer"), (3, "http://a.org/bad one")], "page_id long, url string")
    assert [r.verdict for r in url_filter.judge_urls(df, "page_id", "url", vocabulary=v).orderBy("page_id").collect()] == ["block", "allow", "block"]


def test_quality_on_labels(spark):
    from tracelode.llm import quality

    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    got = quality.op3_quality(spark, d).join(labels, "doc_id").toPandas()
    clean = got[(got.quality == 1) & (got.toxic == 0)]
    assert clean.keep.mean() >= 0.98 and not got[got.quality == 0].keep.mean() > 0.1
    assert got[got.toxic == 1].keep.mean() < 0.5


def test_quality_without_labels_and_odd_rows(spark):
    from tracelode.llm import quality

    docs = spark.createDataFrame([(1, None, None, None, 3), (None, "", "en", "s", 4), (2, "x y", "en", None, 5), (2, "x y", "en", None, 5)], "doc_id long, text string, lang string, source string, keep int")
    labels = spark.createDataFrame([(1, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels)
    assert quality.scored(docs, model).filter("keep").count() == 4
    assert quality.scored(docs.limit(0), model).count() == 0


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES]
    out = corpus_pipeline.run(spark, sf_dir)
    rows = out.collect()
    assert 0 < len(rows) and {r.doc_id for r in rows} <= {r.doc_id for r in docs.select("doc_id").collect()}
    assert all(r.n_tokens == len(r.ids) for r in rows)
