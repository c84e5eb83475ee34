"""Sparse labels decide a template by their smoothed purity alone; the query's rules are those of its contract."""

from probspark.llm import urls


def test_pure_template_with_few_labels_is_blocked(spark):
    rows = [(i, "a.com", "/x/p", "block" if i < 15 else None) for i in range(60)] + [(100 + i, "a.com", "/y/p", "allow" if i < 15 else None) for i in range(60)]
    rows += [(200 + i, "b.com", "/z", "block" if i < 1 else None) for i in range(60)]
    got = urls.templates(spark.createDataFrame(rows, "page_id long, host string, path string, label string")).collect()
    assert len(got) == 180
    assert {(r["template"], r["method"]) for r in got} == {("/x/p", "block"), ("/y/p", "allow"), ("/z", "allow")}


def test_rules_of_the_contract(spark):
    """Each rule's word, written out here."""
    want = [
        ("http://a.com/en/1", "com/en/", "block"),
        ("http://x.example.com/en/7", "example.com/en/7", "allow"),
        ("http://example.com/en/8", "com/en/", "block"),
        ("http://a.net/de/1", "net/de/", "allow"),
        ("http://NET/de/1?q", "net/de/", "allow"),
        ("http://example.net/de/8", "example.net/de/8", "block"),
        ("http://example.net/de/9", "net/de/", "allow"),
        ("http://a.org/es/1#f", "org/es/", "block"),
    ]
    df = spark.createDataFrame([(i, u) for i, (u, _, _) in enumerate(want)], "page_id long, url string")
    got = [(r["rule"], r["verdict"]) for r in urls.judge(df).orderBy("page_id").collect()]
    assert got == [(r, v) for _, r, v in want]
    # a rule's word is a label too: ruleless pages of an allowed template are allowed
    pages = [(i, "http://a.net/de/" + str(i)) for i in range(40)] + [(100 + i, "http://a.net/x/" + str(i)) for i in range(40)]
    assert {r["verdict"] for r in urls.judge(spark.createDataFrame(pages, "page_id long, url string")).collect()} == {"allow"}
