"""Scalar functions on small tables of cases."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quire.functions import dates, decisions, identifiers, titles, web


def values(spark, cases, function, kinds="a string"):
    """The function's value for each case, in order."""
    rows = [c if isinstance(c, tuple) else (c,) for c in cases]
    names = [k.split()[0] for k in kinds.split(", ")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {kinds}")
    return [r[0] for r in df.orderBy("i").select(function(*(F.col(n) for n in names))).collect()]


def test_isbn(spark):
    cases = ["0-306-40615-2", "0306406153", "080442957X", "978-0-306-40615-7", "9780306406158", "", None, "12"]
    assert values(spark, cases, identifiers.valid_isbn) == ["0306406152", "", "080442957X", "9780306406157", "", "", "", ""]
    assert values(spark, ["0306406152", "9780306406157", "12"], identifiers.normalized_isbn) == ["9780306406157", "9780306406157", "12"]
    pairs = [("0306406152", "9780306406157"), ("0306406152", "080442957X"), ("", "1")]
    assert values(spark, pairs, identifiers.compare_isbn, "a string, b string") == ["exact", "differs", "missing"]


def test_issn_and_orcid(spark):
    assert values(spark, ["0378-5955", "03785955", "0378-5954", "2434-561X", None], identifiers.valid_issn) == ["0378-5955", "0378-5955", "", "2434-561X", ""]
    good, bad = "0000-0002-1825-0097", "0000-0002-1825-0098"
    assert values(spark, [good, bad, "0000-0002-1694-233X", ""], identifiers.valid_orcid) == [good, "", "0000-0002-1694-233X", ""]


def test_doi(spark):
    assert values(spark, ["see 10.1234/ab.c).", "https://doi.org/10.5555/X", "no", None], identifiers.doi_in) == ["10.1234/ab.c", "10.5555/X", "", ""]
    pairs = [("10.1/a", "https://DOI.org/10.1/A"), ("10.1/a.", "10.1/a"), ("10.1/a(b", "10.1/a"), ("10.1/a", "10.1/b"), (None, "10.1/b")]
    assert values(spark, pairs, identifiers.compare_doi, "a string, b string") == ["exact", "ambiguous", "ambiguous", "differs", "missing"]
    pairs = [("10.1/w_c1", "10.1/w"), ("10.1/wc1", "10.1/w"), ("10.1/w", "10.1/w")]
    assert values(spark, pairs, identifiers.container_doi, "a string, b string") == ["10.1/w", None, None]
    assert values(spark, [("1-2 34", "12;56")], identifiers.merged_identifiers, "a string, b string") == ["1-2 34 56"]


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [("Same Title", "same title!", 1.0), ("", "x", 0.0), ("a", "a", 1.0), ("a", "b", 0.0), ("night", "nacht", 0.25), ("Work (2nd ed.)", "Work", 1.0), (None, "x", 0.0)],
)
def test_title_similarity(spark, a, b, want):
    assert values(spark, [(a, b)], titles.title_similarity, "a string, b string") == [want]


def test_two_dices(spark):
    pairs = [("aaaa", "aa")]
    assert values(spark, pairs, titles.set_dice, "a string, b string") == [1.0]
    assert values(spark, pairs, titles.bag_dice, "a string, b string") == [0.5]
    assert values(spark, [("abc", ""), ("", ""), ("ab", "ab")], titles.bag_dice, "a string, b string") == [0.0, 0.0, 1.0]


def test_title_rules(spark):
    assert values(spark, ["x.pdf", "Full text", "untitled", "Results:", "A work", None], titles.is_placeholder) == [True, True, True, True, False, False]
    pairs = [("A very long title of a work indeed", "A very long title"), ("A title x", "A title")]
    assert values(spark, pairs, titles.is_truncated, "a string, b string") == [True, False]
    pairs = [("alpha beta", "gamma delta"), ("alpha beta", "alpha beta gamma"), ("untitled", "gamma")]
    assert values(spark, pairs, titles.titles_differ, "a string, b string") == [True, False, False]
    assert values(spark, ["가나다", "가 abc", "abc"], titles.title_script) == ["hangul", "mixed", "none"]
    assert values(spark, ["가" * 120, "a" * 120, "a" * 100, "あ" * 20 + "a" * 120], titles.dominant_script) == ["ko", "latin", None, "ja"]


def test_folds(spark):
    assert values(spark, ["Éa-1", "ﬁn", None], titles.folded_letters) == ["ea1", "fin", ""]
    assert values(spark, ["H<sub>2</sub>O ﬁ"], titles.fold_compatible) == ["h2ofi"]


def test_only_whole_names_of_months_count(spark):
    cases = ["Decade 3, 2019", "Maybe 5, 2019", "Mai 2019", "März 2019", "3. Oktober 2019", "5월 2019", "2019年", "2019年5月7日", "3 de mayo de 2019", "Sept. 4, 2019", "２０１９．０５．０７", "2019 May 7", "31 April 2019", "2019 |", "Jan • 2019", "1er mai 2019"]
    want = [None, None, "2019-05", "2019-03", "2019-10-03", "2019-05", "2019", "2019-05-07", "2019-05-03", "2019-09-04", "2019-05-07", None, None, None, "2019-01", "2019-05-01"]
    assert values(spark, cases, dates.canonical_date) == want


def test_notes_on_editions_go(spark):
    cases = ["A title (2nd ed.)", "A title [Hard Cover] (Reprint 2019).", "A title (revised edition) (e-book) (pbk)", "A (new) title", "A title (New Edition)", "A title (1984)", "(2nd edition)", "A title (second thoughts)"]
    assert values(spark, cases, titles.title_core) == ["A title", "A title", "A title (revised edition)", "A (new) title", "A title", "A title (1984)", "", "A title (second thoughts)"]


def test_entities_three_deep(spark):
    cases = ["a &amp;lt; b", "&amp;amp;amp;lt;", "&#233;&#xe9;", "&#1; &#x80; &#xD800; &#9999999;", "&unknown; &Omega;", "x &amp y", "&#128512;"]
    assert values(spark, cases, web.decode_entities) == ["a < b", "&lt;", "éé", "&#1; &#x80; &#xD800; &#9999999;", "&unknown; Ω", "x &amp y", "😀"]


def test_pages_that_ask_for_proof(spark):
    cases = ["<title>Just a moment...</title>", "<p>unusual traffic</p>", "<p>captcha</p><meta name='citation_title'>", "<p>fine</p>", None, '<title>Sign in</title><input type="password">', "자동 등록 방지"]
    assert values(spark, cases, web.is_challenge) == [True, True, False, False, False, False, True]
    assert values(spark, cases, web.is_login_wall) == [False] * 5 + [True, False]


def test_dates(spark):
    cases = ["2019", "2019-3", "2019/03/07", "3/2019", "March 7, 2019", "7 March 2019", "2019년 3월 7일", "2019-13", "2019-02-30", "x", None]
    want = ["2019", "2019-03", "2019-03-07", "2019-03", "2019-03-07", "2019-03-07", "2019-03-07", None, None, None, None]
    assert values(spark, cases, dates.canonical_date) == want
    pairs = [("2019-03", "2019"), ("2019-03", "2019-01-01"), ("2019", "2019-03"), ("2019-03", "2019-04")]
    assert values(spark, pairs, dates.coarser_or_default, "a string, b string") == [True, True, False, False]
    assert values(spark, ["Epub ahead", "Accepted", "Submitted", "indexed", "issued", None], dates.date_role) == ["online", "accepted", "received", "record", "published", "published"]


PUBLIC = {
    "https://example.org/x": True, "http://example.org:8080/": True, "http://8.8.8.8/": True, "http://[2001:4860::8888]/": True,
    "ftp://example.org/": False, "http://user@example.org/": False, "http://localhost/": False, "http://a.localhost/": False, "http://printer.local/": False,
    "http://127.0.0.1/": False, "http://10.0.0.1/": False, "http://172.16.0.1/": False, "http://172.32.0.1/": True, "http://192.168.1.1/": False,
    "http://169.254.1.1/": False, "http://100.64.0.1/": False, "http://[::1]/": False, "http://[fd00::1]/": False, "http://[fe80::1]/": False,
    "http://[::ffff:127.0.0.1]/": False, "http://[::ffff:7f00:1]/": False, "http://example.org/\n": False, "": False,
}


def test_public_urls(spark):
    assert dict(zip(PUBLIC, values(spark, list(PUBLIC), web.is_public_url), strict=True)) == PUBLIC
    assert values(spark, ["http://127.0.0.1/", "mailto:x", None], web.is_external_url) == [True, False, False]


def test_web(spark):
    assert values(spark, ["<p>a&amp;b</p><script>x</script><div> c </div>"], web.visible_text) == ["a&b \nc".replace(" \n", "\n")]
    assert values(spark, ["https://x.org/a/one-two_three.html?x", "https://x.org/one-two", None], web.title_from_slug) == ["One two three", "", ""]
    assert values(spark, ["https://x.org/?token=abc&y=1", "?access_token=SECRET&client_secret=S2&key=K#f"], web.redact_url) == ["https://x.org/?token=***&y=1", "?access_token=***&client_secret=***&key=***#f"]
    cases = [(0, "", False), (200, "<html>", True), (403, "<title>Log in</title><input type='password'>", False), (403, "x", False), (429, "", False), (410, "", False), (500, "", False), (302, "", False), (200, "<html>captcha", False), (200, "plain", False), (200, "<html>", False)]
    want = ["serverError", "timeout", "authRequired", "blocked", "rateLimited", "noMatch", "serverError", "rejected", "blocked", "parseError", "record"]
    assert values(spark, cases, web.fetch_kind, "a int, b string, c boolean") == want


def test_evidence_order(spark):
    assert len(set(decisions.EVIDENCE_ORDER)) == 15
    assert values(spark, ["pending", "applied", "other"], decisions.evidence_rank) == [0, 14, 15]


def test_readings(spark):
    from quire.functions import readings

    found = values(spark, ["978 0306 406157 x 0-306-40615-2", "97803064061570804429575", "080442957X, none", None], readings.isbns_in)
    assert found == [["9780306406157"], ["9780306406157"], ["9780804429573"], []]
    kinds = [[(x["kind"], x["confidence"]) for x in r] for r in values(spark, ["10.1234/a(b and 10.1234/c. 0378-5955 0378-5954", None], readings.identifiers_in)]
    assert kinds == [[("doi", "ambiguous"), ("doi", "repaired"), ("issn", "exact")], []]
    pairs = [("House Ltd.", "House"), ("House & Sons", "House"), ("Ltd", "Inc"), ("House", "Other")]
    assert values(spark, pairs, readings.same_publisher, "a string, b string") == [True, True, False, False]
    assert values(spark, ["12-19", "123–9", "ISSN 1234-5678", "07-09", "9-3"], readings.page_ranges) == [["12-19"], ["123-129"], ["1234-5678"], [], []]
    assert values(spark, ["doi:10.1234/x", "https://x.org", "0306406152", "x", None], readings.reference_kind) == ["doi", "url", "isbn", None, None]


def test_names(spark):
    from quire.functions import names

    assert values(spark, ["한글 A", None], names.romanise) == ["hangeul a", ""]
    assert values(spark, ["김민수", "Adams, Mary", "Mary Jane Adams", "Adams"], names.person_parts) == [("김", "민수"), ("Adams", "Mary"), ("Adams", "Mary Jane"), ("Adams", "")]
    assert values(spark, [("김", "Kim"), ("이", "LEE"), ("한", "han"), ("한", "kim")], names.surname_spelled, "a string, b string") == [True, True, True, False]


def test_field_problems(spark):
    from quire.operators import records

    pairs = [("title", "Untitled"), ("DOI", "10.1234/ok"), ("DOI", "10.1234/xxx"), ("ISBN", "0306406152 1"), ("volume", "iv"), ("issue", "spring"), ("language", "English"), ("pages", "e12-e19"), ("x", None)]
    want = ["placeholder", None, "template", None, None, "noNumber", None, None, "empty"]
    assert values(spark, pairs, records.field_problem, "f string, v string") == want
