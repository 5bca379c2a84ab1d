from __future__ import annotations

import math
import os
from collections import Counter

import numpy as np
import pytest

from pairloom.llm import quality_lm, queries, url_filter
from tests.check_oracles import compare, connect
from tests.llm.helpers import SCHEMA, fold, frame, prose, with_clashes

SF = "/root/testdata/sf0.001"


def test_urls_and_rules(spark):
    urls = [
        ("http://A.Example.NET/en/1?x#y", "a.example.net", "/en/1", "example.net/en/", "allow"), ("s3://example.net/de", "example.net", "/de", "net/", "block"),
        ("x://fr.org/fr/", "fr.org", "/fr/", "org/fr/", "allow"), ("http://b.example.com/de/?q", "b.example.com", "/de/", "example.com/de/", "block"),
        ("http://notexample.com/de/", "notexample.com", "/de/", None, None), ("http://net?a/b", "net", "", None, None), ("http://x.net", "x.net", "", None, None),
        ("no scheme/en/", "", "", None, None), ("", "", "", None, None), (None, "", "", None, None), ("a://b://c/d", "b:", "//c/d", None, None), ("http://É.NET/#", "É.net", "/", "net/", "block"),
    ]
    pages = with_clashes(spark.createDataFrame([(i, u[0], None) for i, u in enumerate(urls)], "page_id bigint, url string, html string"), "host", "rule", "verdict")
    got = sorted(map(tuple, url_filter.judged(pages).collect()))
    assert got == [(i, *u[1:]) for i, u in enumerate(urls)]
    found = sorted(url_filter.verdicts(pages, rounds=2).collect())
    assert all(r.verdict == (u[4] or r.verdict) for r, u in zip(found, urls)) and len(found) == len(urls)


def test_distrust_flows_back_to_those_who_link_to_blocked_hosts(spark):
    page = lambda i, host, *to: (i, f"http://{host}/p", " ".join(f'<a href="https://{t}/q">' for t in to))
    rows = [page(0, "good.org", "fine.io"), page(1, "fine.io"), page(2, "spam.io", "bad.net"), page(3, "bad.net", "bad.net"), page(4, "lone.io"), (5, None, None), (5, None, ""), page(6, "SPAM.io", "BAD.net")]
    rows[0] = (0, "http://good.org/fr/", rows[0][2])
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r.host: r.verdict for r in url_filter.verdicts(pages).collect()}
    assert got == {"good.org": "allow", "fine.io": "allow", "spam.io": "block", "bad.net": "block", "lone.io": "allow", "": "allow"}
    scores = {r.host: (r.trust, r.distrust) for r in url_filter.host_scores(pages).collect()}
    assert all(x == int(x) for pair in scores.values() for x in pair) and sum(t for t, _ in scores.values()) <= url_filter.TOTAL_MASS
    assert url_filter.verdicts(pages.limit(0)).count() == 0


def test_links_keep_ports_and_users_and_count_a_host_once_a_page(spark):
    html = '<a href="//a.com:8080/x"> <a href="http://A.com:8080/y"> <a href="//u:p@b.com/"> <img src=https://c.io?z> <a href="//c.io">'
    urls = ["http://x.io/", "http://a.com:8080/", "http://u:p@b.com/q", "http://c.io/"]
    pages = spark.createDataFrame([(i, u, html if i == 0 else None) for i, u in enumerate(urls)], "page_id bigint, url string, html string")
    hosts = url_filter.judged(pages).select("host").distinct()
    got = {(r.src, r.dst): r.w for r in url_filter.host_edges(pages, hosts).collect()}
    assert got == {("x.io", "a.com:8080"): 1.0, ("x.io", "u:p@b.com"): 1.0, ("x.io", "c.io"): 1.0}


def test_rules_of_equal_length_are_ordered_by_their_string(spark):
    rules = (("block", "x.com/"), ("allow", "com/a/"), ("block", "com/a/"), ("block", "a/"))
    pages = spark.createDataFrame([(1, "http://x.com/a/"), (2, "http://x.com/b"), (3, "http://y.com/a/"), (4, "http://a/b")], "page_id bigint, url string")
    got = {r.page_id: (r.rule, r.by_rule) for r in url_filter.judged(pages, rules).collect()}
    assert got == {1: ("com/a/", "allow"), 2: ("x.com/", "block"), 3: ("com/a/", "allow"), 4: ("a/", "block")}


def plain_model(texts, order=5):
    """Direct modified Kneser-Ney over bytes, one dictionary per order."""
    counts = {order: Counter()}
    for t in texts:
        b = b"\n" * (order - 1) + fold(t).encode()
        counts[order].update(b[i : i + order] for i in range(len(b) - order + 1))
    for n in range(order - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    cut = {n: quality_lm.discounts([sum(v == k for v in c.values()) for k in (1, 2, 3, 4)]) for n, c in counts.items()}
    children = {n: {} for n in counts}
    for n, c in counts.items():
        for g, v in c.items():
            children[n].setdefault(g[:-1], []).append(v)

    def p(gram):
        n = len(gram)
        lower = p(gram[1:]) if n > 1 else 1 / 256
        under = children[n].get(gram[:-1])
        if not under:
            return lower
        total = sum(under)
        v = counts[n].get(gram, 0)
        return (v - cut[n][min(v, 3)]) / total + sum(cut[n][min(x, 3)] for x in under) / total * lower

    return p


def test_perplexity_equals_a_plain_model(spark):
    rng = np.random.default_rng(7)
    rows = [(i, prose(rng, 30, 40).upper() if i % 3 else prose(rng, 25, 40)) for i in range(40)] + [(50, "zz é 漢"), (51, None), (52, ""), (53, "w1 w2"), (53, "w1 w2"), (None, "w1 w2")]
    trusted = spark.createDataFrame([(i,) for i in range(0, 40, 2)], "doc_id bigint")
    docs = with_clashes(frame(spark, rows), "trusted", "bits")
    got = quality_lm.scored(docs, trusted).collect()
    p = plain_model([t for i, t in rows if i is not None and i < 40 and i % 2 == 0])
    want = []
    for i, t in rows:
        b = b"\n" * 4 + fold(t).encode()
        grams = [b[k : k + 5] for k in range(len(b) - 4)]
        want.append((str(i), None if not grams else -sum(math.log2(p(g)) for g in grams) / len(grams)))
    found = sorted(((str(r.doc_id), r.bits) for r in got), key=str)
    assert [i for i, _ in found] == [i for i, _ in sorted(want, key=str)]
    assert all(a == b or abs(a - b) < 1e-4 for (_, a), (_, b) in zip(found, sorted(want, key=str)))


def test_questions_split_by_batch_give_the_same_scores(spark, tmp_path):
    """All texts share most contexts, so one shard gets nearly all questions."""
    rng = np.random.default_rng(5)
    docs = frame(spark, [(i, "the then " * 5 + prose(rng, 20, 30) if i % 3 else "the the the the") for i in range(60)])
    docs.repartition(8).write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    trusted = spark.createDataFrame([(i,) for i in range(30)], "doc_id bigint")
    whole = {r.doc_id: r.bits for r in quality_lm.scored(docs, trusted).collect()}
    for settings in ({"part_bytes": 500}, {"part_bytes": 3000, "shard_bytes": 100}):
        assert {r.doc_id: r.bits for r in quality_lm.scored(docs, trusted, **settings).collect()} == pytest.approx(whole, abs=1e-6)


def test_limits_are_quantiles_of_trusted_text(spark):
    rows = [("en", True, b / 100) for b in range(1, 101)] + [("fr", False, 9.0), (None, True, 2.0), ("en", False, 7.0), ("en", True, None)]
    got = {(r.every, r.lang): r.limit for r in quality_lm.thresholds(spark.createDataFrame(rows, "lang string, trusted boolean, bits double"), 0.9).collect()}
    assert got == {(False, "en"): 0.9, (False, None): 2.0, (True, None): 0.91}


def test_judged_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, prose(rng, 50, 30)) for i in range(30)] + [(40, "#$% &&& *** (((" * 9), (41, None), (42, "")]
    trusted = spark.createDataFrame([(i,) for i in range(20)], "doc_id bigint")
    got = {r.doc_id: r.kept for r in quality_lm.judged(frame(spark, rows), trusted).collect()}
    assert got[40] is False and got[41] is False and got[42] is False and sum(got[i] for i in range(20)) >= 19
    none = {r.doc_id: r.kept for r in quality_lm.judged(frame(spark, rows), trusted.limit(0)).collect()}
    assert none[40] and not none[41] and quality_lm.judged(spark.createDataFrame([], SCHEMA), trusted).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", list(queries.all_oracles()))
def test_query_equals_sql(spark, name):
    got = queries.all_queries()[name](spark, SF).toPandas()
    assert compare(got, connect(SF).execute(queries.all_oracles()[name]).df()) is None
