import random

import pytest

from spark_analog.llm import url_filters as uf

RULES = "host string, path string, verdict string"


def brute(url, rules, default):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = rest[:cut].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    path = rest[cut:]
    path = path[:min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fits = [(len(h) + len(p), len(h), v == "block", h + p, v) for h, p, v in rules
            if (h == "" or host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return (host, path, best[3], best[4]) if best else (host, path, None, default)


def urls():
    rng = random.Random(6)
    hosts = ["com", "example.com", "www.example.com", "a.www.example.com", "notexample.com", "example.com.net",
             "x-example.com", "net", "b.net", "é.net", "", "a..com", "com:80", "EXAMPLE.Com", "us@example.com", "0.com"]
    paths = ["", "/", "/en/", "/en/x?y=/es/", "/en", "/es/1#z", "?q", "#f", "/fr/é", "/EN/", "/en//"]
    rows = [f"{rng.choice(['http', 'https', ''])}://{rng.choice(hosts)}{rng.choice(paths)}" for _ in range(300)]
    return rows + [None, "", "no scheme/en/", "://", "a://b://example.com/en/", "http://x/" + "y" * 5000] + ["http://example.com/en/1"] * 200


@pytest.mark.parametrize("rules", [
    list(uf.RULES), [], [("", "/en/", "block"), ("com", "", "allow"), ("com", "/e", "block"), ("com", "/e", "allow"),
                         ("a.www.example.com", "/", "block"), ("com", "/en/x", "allow"), ("net", "/f", "block")]])
def test_equals_every_rule_tried(spark, rules):
    given = list(enumerate(urls()))
    pages = spark.createDataFrame([(i, u, "h") for i, u in given], "page_id long, url string, host string").repartition(5)
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict)
           for r in uf.judge(pages, spark.createDataFrame(rules, RULES), "keep").collect()}
    assert got == {i: brute(u, rules, "keep") for i, u in given}


def test_null_rules_repeated_rows_null_ids_and_empty(spark):
    pages = spark.createDataFrame([(1, "http://a.b/x"), (1, "http://a.b/x"), (None, "http://c/")], "page_id long, url string")
    rules = spark.createDataFrame([(None, None, "block"), ("b", "/", "allow")], RULES)
    got = sorted(((r.page_id, r.rule, r.verdict) for r in uf.judge(pages, rules).collect()), key=str)
    assert got == [(1, "b/", "allow"), (1, "b/", "allow"), (None, "", "block")]
    assert uf.judge(pages.limit(0), rules).count() == 0
