"""The trained operators on labels they haven't seen, and the SQL forms."""

import os

import duckdb
import pytest

from itemloom.llm import lm, queries, rules

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    return docs, labels.where("doc_id % 2 = 0"), {r.doc_id: r.quality for r in labels.where("doc_id % 2 = 1").collect()}


def shares(rows, held_out):
    """Of the held-out documents: good ones kept, and poor ones rejected."""
    good = [r.kept for r in rows if held_out.get(r.doc_id) == 1]
    poor = [not r.kept for r in rows if held_out.get(r.doc_id) == 0]
    return sum(good) / len(good), sum(poor) / len(poor)


def test_quality_rules(tables):
    docs, labels, held_out = tables
    model = rules.train(docs, labels)
    rows = [r for r in rules.judge(docs, model).collect() if not r.base_failed]
    good, poor = shares(rows, held_out)
    assert good > 0.95 and poor > 0.9


def test_quality_classifier(tables):
    docs, labels, held_out = tables
    good, poor = shares(lm.classify(docs, labels).collect(), held_out)
    assert good > 0.93 and poor > 0.85


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    want = c.execute(queries.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(d[0] for d in want.description)
    assert sorted(tuple(r[d[0]] for d in want.description) for r in got.collect()) == sorted(want.fetchall())


def test_url_rules_by_sql(spark):
    """Host, path, rule and the rules' verdicts of all pages; the trees' verdicts have no SQL form."""
    c = duckdb.connect()
    want = c.execute(f"""
        WITH split AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM '{SF}/pages.parquet'),
        parts AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM split),
        rules AS (SELECT * FROM (VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
                                        ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')) r(rule, domain, start, verdict))
        SELECT page_id, host, path, (SELECT arg_max(rule, length(rule)) FROM rules WHERE (host = domain OR ends_with(host, '.' || domain)) AND starts_with(path, start)) AS rule FROM parts
    """).fetchall()
    rows = queries.QUERIES["op7_url_filters"](spark, SF).collect()
    assert sorted((r.page_id, r.host, r.path, r.rule) for r in rows) == sorted(want)
    verdicts = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
    assert all(r.rule is None or r.verdict == verdicts[r.rule] for r in rows) and len({r.rule for r in rows}) == 5


def test_base_rules_by_sql(spark):
    """The counts of the base rules of all documents, by regular expressions."""
    c = duckdb.connect()
    want = c.execute(f"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM '{SF}/documents.parquet'),
        w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d)
        SELECT doc_id, len(words)::BIGINT, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT,
               (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT FROM w
    """).fetchall()
    assert sorted((r.doc_id, r.n_words, r.word_chars, r.n_symbols) for r in queries.QUERIES["op9_quality_rules"](spark, SF).collect()) == sorted(want)
