import pytest
from pyspark.sql import functions as F

from quarryline.functions import geo, html, keys, text
from quarryline.plans import profile


def one(df, c):
    return df.select(c.alias("x")).first().x


def test_white_space_is_unicode(rows):
    df = rows("s string", ("  a  \n b ",))
    assert one(df, text.trim(F.col("s"))) == "a  \n b"
    assert one(df, text.normalize_whitespace(F.col("s"))) == "a b"


@pytest.mark.parametrize(("raw", "want"), [("a%20b+c", "a b+c"), ("%zz", None), ("%FF", None), ("%EF%BF%BD", "�"), ("ü%C3%BC", "üü")])
def test_url_decode(rows, raw, want):
    assert one(rows("s string", (raw,)), text.url_decode(F.col("s"))) == want


def test_slug_keeps_the_rest_of_a_word(rows):
    assert one(rows("s string", ("senior-iOS_dev",)), text.slug_to_title(F.col("s"))) == "Senior IOS Dev"


def test_split_is_literal(rows):
    df = rows("s string", ("a.b. .",))
    assert one(df, text.split(F.col("s"), ".")) == ["a", "b", " ", ""]
    assert one(df, text.split(F.col("s"), ".", True, True)) == ["a", "b"]
    with pytest.raises(ValueError):
        text.split(F.col("s"), "")


def test_patterns_are_linear_and_unicode(rows):
    with pytest.raises(ValueError):
        text.java_pattern("(?=x)")
    with pytest.raises(ValueError):
        text.java_pattern(r"(a)\1")
    df = rows("s string", ("été 12",))
    assert one(df, text.capture(F.col("s"), r"(?<word>\w+) (?<num>\d+)", "word")) == "été"
    assert one(df, text.matches(F.lit(""), ".*")) is False


def test_template_and_literals(rows):
    df = rows("a string", ("x",))
    assert one(df, text.template("{{{{ {{item:a}}!", {"item:a": F.col("a")})) == "{{ x!"
    assert one(df, text.template("{{item:a}}", {"item:a": F.lit(None).cast("string")})) is None


def test_combine_needs_its_required_parts(rows):
    df = rows("a string, b string", ("x", ""), (None, "y"))
    joined, error = text.combine("-", [(F.col("a"), True), (F.col("b"), False)])
    assert [tuple(r) for r in df.select(joined, error).collect()] == [("x", False), (None, True)]


def test_locations_keep_their_first_spelling(rows):
    df = rows("a array<string>", (["Berlin ", "BERLIN", "", "Paris"],))
    assert one(df, text.distinct_locations(F.col("a"))) == ["Berlin", "Paris"]


def test_summary_and_pointer(rows):
    df = rows("a array<string>", (["a", "b", "c"],))
    assert one(df, text.summary(F.col("a"), 2)) == "a, b +1"
    assert one(df, text.json_pointer_escape(F.lit("a/b~c"))) == "a~1b~0c"


def test_tokens_join_single_letters():
    assert keys.word_tokens("Head Of Laser & Post-Processing Development (m/w/d)*") == ["head", "of", "laser", "post", "processing", "development", "mwd"]
    assert keys.word_tokens(None) == []


def test_place_keys_in_order():
    assert keys.place_keys("München") == ["muenchen", "munchen", "münchen"]
    assert keys.place_keys(" ") == []


@pytest.mark.parametrize(("url", "want"), [
    ("HTTPS://Example.org:443/a/../b/./c?x=1", "https://example.org/b/c?x=1"), ("http://h", "http://h/"), ("ftp://h/", None), ("http://u@h/", None), ("x", None), ("http://h:80x/", None), (None, None),
])
def test_url_key(url, want):
    assert keys.normal_url(url) == want


@pytest.mark.parametrize(("code", "want"), [("SW1A 1AA", ["sw1a 1aa", "sw1a 1", "sw1a"]), ("AL3 8", ["al3 8", "al3"]), ("55116", ["55116"]), ("AL3", ["al3"]), ("Mainz", [])])
def test_postal_keys(rows, code, want):
    assert one(rows("s string", (code,)), geo.postal_keys(F.col("s"))) == want


def test_distance(rows):
    df = rows("a double, b double, c double, d double", (52.52, 13.405, 48.8566, 2.3522))
    assert abs(one(df, geo.haversine_km(*map(F.col, "abcd"))) - 877.46) < 0.5


PAGE = """<!doctype html><head><title>T &amp; x</title><script>no</script></head><body><ul class="nav big"><li><a href="/a">A</a><li><a href='/b'>B</a></ul>
<div id=main><p>one<br>two <b>th</b>ree</p><div><p>deep</p></div></div></body>"""


@pytest.mark.parametrize(("selector", "want"), [
    ("title", ["T & x"]), ("ul.nav > li", ["A", "B"]), ("#main > p", ["one two three"]), ("#main p", ["one two three", "deep"]), ("a[href$='b'], title", ["T & x", "B"]), ("ul.small", []),
])
def test_css(rows, selector, want):
    assert one(rows("s string", (PAGE,)), html.css_text(F.col("s"), selector)) == want


def test_attributes_and_text(rows):
    df = rows("s string", (PAGE,))
    assert one(df, html.css_attribute(F.col("s"), "a", "href")) == ["/a", "/b"]
    assert one(df, html.html_to_text(F.lit("<p>a</p><p>b&nbsp;c<script>x</script></p>"))) == "a b c"
    with pytest.raises(ValueError):
        html.compile_selector("a:hover")


def test_xml(rows):
    df = rows("s string", ("<r xmlns='u'><j><t> a <b>b</b></t></j><j><t>c</t></j></r>",), ("<r>",))
    assert [r.x for r in df.select(html.xml_text(F.col("s"), "r/j/t").alias("x")).collect()] == [["a b", "c"], None]
    assert one(df, html.xml_element(F.col("s"), "t")) == ["a b", "c"]
    assert one(df, html.sitemap_urls(F.lit("<u><url><loc> http://a \n</loc></url><url><loc/></url></u>"))) == ["http://a"]


def test_texts_at_a_path_and_parts_read_once(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(['{"a": "x"}', '{"a": ["x", null, "y"]}', '{"a": {"b": 1}}', '{"a": "{x}"}', '{"a": null}', "{}", '{"a": []}', '{"a": 1}'])], "i int, t string")
    got = rows.select("i", profile.variant_texts(F.parse_json("t"), "$.a").alias("v")).orderBy("i").collect()
    assert [r.v for r in got] == [["x"], ["x", "y"], [], ["{x}"], [], [], [], ["1"]]
    parts = spark.createDataFrame([("a", "b"), ("a", ""), ("a", None), ("", "b"), (None, "b"), (None, None)], "p string, q string")
    joined, error = text.combine("-", [(F.col("p"), True), (F.col("q"), False)])
    assert [tuple(r) for r in parts.select(joined, error, text.first_non_empty(F.col("p"), F.col("q"))).collect()] == [
        ("a-b", False, "a"), ("a", False, "a"), ("a", False, "a"), (None, True, "b"), (None, True, "b"), (None, True, ""),
    ]
    free, wrong = text.combine("-", [(F.col("p"), False), (F.col("q"), False)])
    assert [tuple(r) for r in parts.select(free, wrong).collect()][-1] == ("", False)
    assert profile.reads([{"x": {"item_field": "a"}}, {"template": "{{item:b.c}} {{capture:d}}"}, {"json_path": "$.a", "transforms": ["trim"]}]) == ["$.a", "$.b.c"]
