import re

from fleetvitals.llm import url_rules

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block")]
URLS = [
    "http://www.example.com/en/1", "https://a.www.example.com/en/", "http://EXAMPLE.com/en/x?y#z", "http://example.com/EN/", "http://xexample.com/en/",
    "http://example.com", "http://example.com?x=/en/", "ftp://net/es/", "http://b.net/es", "http://spam.org/1", "http://spammer.org/1",
    "http://ok.org/adult", "no scheme", "", None, "://", "http://u@example.com:80/en/", "http://a.com/x://y.net/es/", "http://ok.org/a\nb", "http://spam.com/1",
]


def judge(url, rules=RULES, patterns=url_rules.DEFAULT_PATTERNS):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].lower(), m[2]) if m else ("", "")
    fits = [(len(h + p), -i, h + p, v) for i, (h, p, v) in enumerate(rules) if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        return host, path, max(fits)[2], max(fits)[3]
    return host, path, None, "block" if url and any(re.search(p, url.lower()) for p in patterns) else "allow"


def test_same_as_judging_one_by_one(spark):
    rows = [(i, u, "clash", "clash", 1) for i, u in enumerate(URLS + URLS[:3])]
    urls = spark.createDataFrame(rows, "page_id long, url string, host string, rule string, token int")
    found = url_rules.filter_urls(urls, RULES)
    assert found.count() == len(rows)
    for r in found.collect():
        assert (r.host, r.path, r.rule, r.verdict) == judge(r.url), r.url


def test_rules_without_a_literal_run_everywhere(spark):
    urls = spark.createDataFrame([(u,) for u in URLS], "url string")
    patterns = [r"x?y", r"\bokay\b|\b1\b", r"\bspam\b.*\borg\b"]
    for r in url_rules.filter_urls(urls, [], patterns).collect():
        assert (r.rule, r.verdict) == judge(r.url, [], patterns)[2:], r.url


def test_index_takes_the_rarest_token():
    assert url_rules.pattern_tokens(r"\bspam\b.*\borg\b") == ["spam", "org"]
    assert url_rules.pattern_tokens(r"\ba\b|\bb\b") == url_rules.pattern_tokens(r"spam") == []


def test_empty_table_and_no_python(spark):
    urls = spark.createDataFrame([], "url string")
    found = url_rules.filter_urls(urls, RULES)
    assert found.count() == 0
    text = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Arrow" not in text


def test_columns_that_are_called_as_those_inside(spark):
    rows = [(u, 1, "mine", "x", "y", "z", 3.5) for u in URLS]
    given = spark.createDataFrame(rows, "url string, u int, __rule string, __verdict string, verdict string, token string, c0 double")
    found = url_rules.filter_urls(given, RULES)
    assert sorted(found.columns) == sorted([*given.columns, "host", "path", "rule"])
    for r in found.collect():
        assert (r["u"], r["__rule"], r["__verdict"], r["token"], r["c0"]) == (1, "mine", "x", "z", 3.5)
        assert (r.host, r.path, r.rule, r.verdict) == judge(r.url), r.url
    named = url_rules.filter_urls(given.drop("u").withColumnRenamed("url", "u"), RULES, url="u").collect()
    assert all((r.host, r.path, r.rule, r.verdict) == judge(r.u) for r in named) and len(named) == len(URLS)
