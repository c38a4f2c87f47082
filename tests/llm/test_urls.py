"""What labels of a template's pages say of its others."""

from corvina.llm import urls


def verdicts(spark, rows):
    found = urls.judge_urls(spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")).collect()
    return {r.page_id: r.verdict for r in found if r.rule is None}


def test_few_labels_do_not_speak_for_a_host(spark):
    """Twenty pages under a blocked folder beside 120 in other folders of the same shape."""
    rows = [f"http://h.org/es/{i}" for i in range(20)] + [f"http://h.org/{lang}/{i}" for lang in ("fr", "pt", "it", "nl") for i in range(30)]
    rows += [f"http://other.io/x/{i}" for i in range(100)]
    got = verdicts(spark, rows)
    assert len(got) == 220 and set(got.values()) == {"allow"}


def test_a_template_of_blocked_pages_blocks_the_rest(spark):
    """Nine tenths of a template's pages are blocked by a rule; the others have no label."""
    rows = [f"http://shop.org/es/{i}" for i in range(90)] + [f"http://shop.org/xx/{i}" for i in range(6)] + [f"http://fine.io/a{i % 7}/{i}" for i in range(300)]
    got = verdicts(spark, rows)
    assert [got[i] for i in range(90, 96)] == ["block"] * 6 and set(got[i] for i in range(96, 396)) == {"allow"}


def test_very_long_paths_and_clashing_columns(spark):
    rows = [(1, "http://h.org/es/" + "a/" * 20_000, "x", 1), (2, None, "y", 2), (2, None, "y", 2), (3, "http://h.org/" + "b" * 100_000, "z", 3)]
    docs = spark.createDataFrame(rows, "page_id long, url string, host string, n int")
    got = sorted((r.page_id, r.rule, r.verdict) for r in urls.judge_urls(docs).collect())
    assert got == [(1, "org/es/", "block"), (2, None, "allow"), (2, None, "allow"), (3, None, "allow")]
