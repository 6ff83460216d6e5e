import pytest

from tallyline.llm.queries import URL_RULES
from tallyline.llm.url_filter import Rule, Vocabulary, count_terms, filter_urls


@pytest.mark.parametrize(
    ("url", "hits"),
    [
        (None, (0, 0)),
        ("", (0, 0)),
        ("http://a.org/porn", (1, 0)),
        ("http://a.org/PORN/xxx", (2, 0)),
        ("http://a.org/pornography", (0, 0)),
        ("http://a.org/poker?x=poker", (0, 1)),
        ("http://a.org/poker-casino", (0, 2)),
        ("http://casino-bonus.org/", (1, 1)),
        ("http://a.org/sussex", (0, 0)),
        ("http://a.org/ésexé", (0, 1)),
    ],
)
def test_terms_stand_alone(url, hits):
    assert count_terms(url, Vocabulary()) == hits


def test_rules_and_verdicts(spark):
    cases = [
        ("http://a.com", "a.com", "", None, "allow"),
        ("http://a.com/x", "a.com", "/x", "com/", "allow"),
        ("http://EXAMPLE.com/en/1", "example.com", "/en/1", "example.com/en/", "block"),
        ("http://www.example.com/en/", "www.example.com", "/en/", "www.example.com/en/", "allow"),
        ("http://badexample.com/en/", "badexample.com", "/en/", "com/", "allow"),
        ("http://a.net/es/?q=/fr/", "a.net", "/es/", "net/es/", "block"),
        ("http://a.net/de/#/es/", "a.net", "/de/", None, "allow"),
        ("http://a.org/xxx", "a.org", "/xxx", None, "block"),
        ("http://a.org/poker/bet", "a.org", "/poker/bet", None, "block"),
        ("http://a.com/xxx", "a.com", "/xxx", "com/", "allow"),
        ("no scheme/xxx", "", "", None, "block"),
        ("", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("x://y://z/p", "y:", "//z/p", None, "allow"),
    ]
    frame = spark.createDataFrame([(c[0], "old") for c in cases], "url string, VERDICT string")
    rows = filter_urls(frame, rules=URL_RULES).collect()
    assert [(r.url, r.host, r.path, r.rule, r.verdict) for r in rows] == cases


def test_settings_are_checked(spark):
    frame = spark.createDataFrame([], "url string")
    assert filter_urls(frame).collect() == []
    with pytest.raises(ValueError, match="characters"):
        filter_urls(frame, rules=[Rule("block", "x" * 20_000_000, "/")])
    with pytest.raises(ValueError, match="empty"):
        filter_urls(frame, vocabulary=Vocabulary(strict=("",)))
