"""Literal fixtures of the column functions, worked out by hand from the rules."""

import re
from urllib.parse import parse_qsl, unquote, urlencode, urlsplit, urlunsplit

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from paperlode.functions import dates, responses, scoring, text, urls, vectors
from paperlode.functions.basic import strip

URL = "u string"


def test_norm_url(one):
    u = "HTTPS://Zenodo.org/Record/1/?utm_source=x&b=2#frag"
    assert one(urls.norm_url(F.col("u")), URL, u) == "//zenodo.org/record/1?b=2"
    assert one(urls.host_path(urls.norm_url(F.col("u"))), URL, u) == "zenodo.org/record/1"


def _norm(u: str) -> str:
    p = urlsplit(u.strip())
    query = urlencode([(k, v) for k, v in parse_qsl(p.query, keep_blank_values=True) if not k.lower().startswith("utm_")])
    return urlunsplit(("", p.netloc.lower(), p.path.lower().rstrip("/"), query, ""))


def test_norm_url_cases(spark):
    cases = [
        "https://h.org", "https://h.org//", "https://h/p?q", "https://h/p?a=%20b*~&c=1+2&&UTM_x=1", "https://h/%zz?x=%zz",
        "  https://H/a;b/ \n", "https://h?x=1", "https://h/p?a=ü&b=100%", "/x/y/", "a/b/", "mailto:x@Y", "http://", "//a/", "https://h/?utm_a=1",
    ]
    df = spark.createDataFrame([(c,) for c in cases], URL)
    got = {r.u: r.n for r in df.select("u", urls.norm_url(F.col("u")).alias("n")).collect()}
    assert got == {c: _norm(c) for c in cases}


@settings(max_examples=1, deadline=None)
@given(st.lists(st.text(alphabet="abcXYZ019/._-~%+ =&;,é", max_size=30), min_size=60, max_size=60))
def test_norm_url_random(spark, tails):
    cases = ["https://Host.org/" + t.replace("?", "") + "?k=" + t for t in tails]
    df = spark.createDataFrame([(c,) for c in cases], URL).select(urls.norm_url(F.col("u")).alias("n"), "u")
    twice = df.withColumn("again", urls.norm_url(F.col("n")))
    for r in twice.collect():
        assert r.n == _norm(r.u)
        assert r.again == r.n


def test_percent_decode(spark):
    cases = ["a+b%20c", "100%", "%zz%41", "%E4%BD%A0", "plain"]
    df = spark.createDataFrame([(c,) for c in cases], URL)
    got = [r.x for r in df.select(urls.percent_decode(F.col("u")).alias("x")).collect()]
    assert got == [unquote(c) for c in cases]


@pytest.mark.parametrize("url,anchor,score", [
    ("https://huggingface.co/datasets/org/name", "our dataset", 22),
    ("https://zenodo.org/record/123/files/a.zip", "", 18),
    ("https://github.com/o/r", "", -4),
    ("https://github.com/o/r/releases", "", 8),
    ("https://dx.doi.org/10.1/x", "", -16),
    ("https://x.org/a.tar.gz", "", 5),
    ("https://x.org/a.csv?raw=1", "", 0),
    ("https://x.org/a", "encode the newspaper", -4),
    ("https://x.org/a", "we use a dataset", -1),
])
def test_link_score(one, url, anchor, score):
    norm = urls.norm_url(F.col("u"))
    args = (norm, urls.host_path(norm), F.lower("a"))
    assert one(scoring.link_score(*args), "u string, a string", url, anchor) == score
    reasons = one(scoring.link_reasons(*args), "u string, a string", url, anchor)
    assert sum(int(r.rsplit(":", 1)[1]) for r in reasons) == score


def test_link_score_whole_words(one):
    norm = urls.norm_url(F.lit("https://x.org/a"))
    assert one(scoring.link_score(norm, urls.host_path(norm), F.col("a"), whole_words=True), "a string", "encode the newspaper") == 0


@pytest.mark.parametrize("url,expected", [
    ("https://github.com/o/r", False), ("https://github.com/o/r/releases", True), ("https://arxiv.org/x.zip", False),
    ("https://x.org/x.zip", True), ("https://osf.io/1", True), ("https://github.com/o/r/tree/main/data", True), ("https://x.org/y", False),
])
def test_structural_test(one, url, expected):
    assert one(urls.with_keys(F.col("u"), urls.is_dataset_url), URL, url) is expected


def test_split_sentences(one):
    f = text.split_sentences(F.col("t"))
    assert one(f, "t string", "A b. C d! 好。 E") == ["A b.", "C d!", "好。", "E"]
    assert one(f, "t string", "one\n two \r\n\nthree") == ["one", "two", "three"]
    assert one(f, "t string", " \u3000 ") == []


def test_split_capital(one):
    f = text.split_sentences_capital(F.col("t"))
    assert one(f, "t string", 'It is. so it is. (Yes) it.  "No" [a]! [b]') == ["It is. so it is.", "(Yes) it.", '"No" [a]!', "[b]"]


def test_split_abbrev(one):
    f = text.split_sentences_abbrev(F.col("t"))
    assert one(f, "t string", "See Fig. 2 of Dr. A. We did.Then a@b left") == [
        "See Fig. 2 of Dr. A.", "We did.", "Then a@b left.",
    ]
    assert one(text.split_sentences_abbrev(F.col("t"), keep_tail=False), "t string", "One. two") == ["One."]


def test_latex_to_text(one):
    f = text.latex_to_text(F.col("t"))
    source = r"""We \emph{release} data \cite{a} in \begin{figure*}x\end{figure*} 10\% of $x^2$ cases, see https://x.org/a ``now'' --- yes~sir."""
    assert one(f, "t string", source) == "We release data in 10% of cases, see “now” — yes sir."
    assert one(f, "t string", "short") == ""
    assert one(f, "t string", "a ! @ & ( ) = + ; : , . / ?") == ""


def test_has_latex(one):
    f = text.has_latex(F.col("t"))
    for t in ("cost $x$ y", r"\Alpha rises", r"\[ x \]", "a_b", "x^2"):
        assert one(f, "t string", t), t
    for t in ("costs $5", "plain text", r"\emph{x}"):
        assert not one(f, "t string", t), t


def test_looks_like_code(one):
    f = text.looks_like_code(F.col("t"))
    for t in ('{"a": 1}', "OUTPUT FORMAT here", ">> run", "THIS IS A HEADER LINE", "{}" * 30, "x\n# Title"):
        assert one(f, "t string", t), t
    for t in ("A fine sentence about data.", "", "SHORT CAPS"):
        assert not one(f, "t string", t), t


def test_summaries(one):
    assert one(text.clean_summary(F.col("t")), "t string", "Assistant: data\n at https://x.org/a?b now") == "data at  now"
    assert one(text.clean_summary(F.col("t"), 6), "t string", "abcde fghi") == "abcde ..."
    assert one(text.clean_summary_with_hosts(F.col("t")), "t string", "All data is at https://X.org/a?b=1 now") == "All data is at x.org now"
    assert one(text.clean_summary_with_hosts(F.col("t")), "t string", "too short") == ""


def test_truncate_request(one):
    t = "[URL] u\n[ANCHOR] a\n[CONTEXT] " + "word " * 30
    cut = one(text.truncate_request(F.col("t"), 60), "t string", t)
    assert cut.startswith("[URL] u\n[ANCHOR] a\n[CONTEXT] word") and cut.endswith("...") and len(cut) <= 60
    assert one(text.truncate_request(F.col("t"), 10), "t string", "abcdefghijklmnop") == "abcdefg..."


def test_reflow():
    lines = "[TITLE]T[/TITLE]\nThe items are:\n- one\n- two\n" + "L" * 120 + "\nand so on\n" + "M" * 110 + "\n3\nfour"
    assert text.merge_text_lines(lines) == [
        "[TITLE]T[/TITLE]", "The items are: - one - two", "L" * 120 + " and so on", "M" * 110, "3 four",
    ]
    assert text.merge_text_lines("X" * 120 + "\nShort\n" + "Y" * 120 + ":\n" + "Z" * 130) == ["X" * 120 + " Short", "Y" * 120 + ": " + "Z" * 130]


def test_titled_lines(one):
    t = "before\n[TITLE]A[/TITLE]\n x \n\ny\n[TITLE]B[/TITLE]\nz"
    assert one(text.titled_lines(F.col("t")), "t string", t) == [
        "[TITLE]Unknown[/TITLE]before", "[TITLE]A[/TITLE]x", "[TITLE]A[/TITLE]y", "[TITLE]B[/TITLE]z",
    ]


def test_sections(one):
    t = "[TITLE]P[/TITLE]\n[SECTION] One [/SECTION]\nA b. C.\n[SECTION]Two[/SECTION]\n\nD"
    got = one(text.sections_of(F.col("t")), "t string", t)
    assert [tuple(s) for s in got] == [(0, "One", "A b. C."), (1, "Two", "D")]


def test_years(one):
    f = dates.year_of(F.col("t"))
    assert one(f, "t string", "2025-11-11T00:00:00Z") == 2025
    assert one(f, "t string", "abc") is None
    assert one(f, "t string", "abcd") is None


def test_label_lines(one):
    f = responses.parse_label_lines(F.col("t"), F.lit(0), F.lit(5))
    got = one(f, "t string", "句子2,标记为1。\n句子2,标记为0。\n句子 4 、 标记为 1\n句子9,标记为1\nnoise")
    assert [tuple(x) for x in got] == [(1, 0), (3, 1)]


def test_label_array(one):
    assert one(responses.parse_label_array(F.col("t")), "t string", '{"labels": [1, 0, 2, "x", 1]}') == [1, 0, 0, 0, 1]
    assert one(responses.parse_label_array(F.col("t")), "t string", "no json") is None


@pytest.mark.parametrize("answer,urls_found", [
    ('[{"url":"a","label":"x"},{"url":"b","label":"y"}]', ["a", "b"]),
    ('{"items":[{"url":"a","label":"x"}]}', ["a"]),
    ('```json\n{"data":[{"url":"a","label":"x"}]}\n```', ["a"]),
    ('{"url":"a","label":"x"}\n{"url":"b","label":"y"}', ["a", "b"]),
    ('{"url":"a","label":"x"}{"url":"b","label":"y"}', ["a", "b"]),
    ('Sure, see [1]: [{"url":"a[0]","label":"x"}] done', ["a[0]"]),
    ("nothing here", []),
    ('{"url":"a"', []),
])
def test_items(answer, urls_found):
    assert [i["url"] for i in responses.read_items(answer)] == urls_found


def test_pick(one):
    got = one(responses.parse_pick(F.col("t")), "t string", 'x {"primary":{"url":" u ","reason":"r","confidence":0.5}} y')
    assert tuple(got) == ("u", "r", 0.5)


def test_vectors(one):
    zero = one(vectors.cosine(F.col("a"), F.col("b")), "a array<float>, b array<float>", [0.0, 0.0], [1.0, 2.0])
    assert zero == 0.0
    assert one(vectors.cosine(F.col("a"), F.col("a")), "a array<float>", [3.0, 4.0]) == pytest.approx(1.0)
    assert one(vectors.arg_max(F.col("a")), "a array<float>", [1.0, 3.0, 3.0]) == 1
    assert one(F.array_max(vectors.softmax(F.col("a"))), "a array<double>", [0.0, 0.0]) == pytest.approx(0.5)


def test_strip_is_unicode(one):
    assert one(strip(F.col("t")), "t string", "\u3000\x1c a\u00a0b \u2009") == "a\u00a0b"


def test_link_forms(one):
    t = r"\href{https://a.org/x%20y.}{t} \url{https://b.org/1}, see https://c.org/2). and ftp://d.org/z;"
    got = one(urls.link_forms(F.col("t")), "t string", t)
    bare = {unquote(m.strip(").,;]")) for m in re.findall(r'((?:https?://|ftp://)[^\s<>{}|\^\[\]`\\)"]+)', t)}
    assert got == sorted({"https://a.org/x y", "https://b.org/1"} | bare)


def test_control_characters_are_text(one):
    assert one(text.split_sentences(F.col("t")), "t string", "One\u0001two. Three.") == ["One\u0001two.", "Three."]
    assert one(text.split_sentences_capital(F.col("t")), "t string", "a\u0001b. C d.") == ["a\u0001b.", "C d."]
    assert one(text.short_description(F.col("t")), "t string", "a\u0001b. c. d.") == "a\u0001b. c."
    assert one(text.links_to_hosts(F.col("t")), "t string", "x\u0001 https://Ab.org/c y") == "x\u0001 ab.org y"
    sections = one(text.sections_of(F.col("t")), "t string", "[SECTION]A\u0002[/SECTION]b\u0001c[SECTION]D[/SECTION]e")
    assert [(s["section"], s["full_text"]) for s in sections] == [("A\u0002", "b\u0001c"), ("D", "e")]


def test_reflow_ends_with_its_last_line():
    assert text.merge_text_lines("a line\n", 100) == text.merge_text_lines("a line", 100)
