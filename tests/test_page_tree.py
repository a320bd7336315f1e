"""The element tree, its Markdown, and addresses, against recursive walks of made pages."""

import random
import time

import pytest
from pyspark.sql import functions as F

from sitescribe.functions import page_tree as T
from sitescribe.functions import text as X
from sitescribe.operators import extract

TAGS = ["div", "section", "span", "p", "nav", "footer", "ul", "li", "a", "strong", "header"]
ATTRIBUTES = ["", ' class="card"', ' class="Cookie-bar x"', ' class="broad"', ' class="an ads"', ' id="read-more"', ' id="main"', ' role="Dialog"', ' role="main"', ' class="hidden"', ' class="unhidden"', ' title="cookie"', ' data-id="popup"']
NOISY = {' class="Cookie-bar x"', ' class="an ads"', ' id="read-more"', ' role="Dialog"', ' class="hidden"'}


def made(rng, depth, words):
    """A random tree as (html, words that stay), built by recursion; inline elements hold no blocks."""
    html, kept = [], []
    for _ in range(rng.randint(1, 4)):
        if depth == 0 or rng.random() < 0.3:
            words.append(f"w{len(words)}")
            html.append(f" {words[-1]} ")
            kept.append(words[-1])
            continue
        tag, attribute = rng.choice(TAGS), rng.choice(ATTRIBUTES)
        inner, inside = made(rng, 0 if tag in ("p", "a", "span", "strong") else depth - 1, words)
        if tag == "li":
            inner, tag = f"<li>{inner}</li>", "ul"
        html.append(f"<{tag}{attribute}>{inner}</{tag}>")
        if attribute not in NOISY and tag not in T.NOISE_TAGS:
            kept += inside
    return "".join(html), kept


@pytest.mark.parametrize("seed", range(40))
def test_noise_against_recursion(seed):
    html, kept = made(random.Random(seed), 4, [])
    text = T.markdown(T.parsed(f"<html><head><title>t</title></head><body>{html}<script>no</script></body></html>"))
    words = [w.strip("*[]()|\\-> ") for w in text.replace("]", " ").replace("[", " ").split()]
    assert [w for w in words if w.startswith("w")] == kept


def test_markdown():
    page = """<body><h1>Top <em>news</em></h1><p>One <b>bold</b> and <a href="/x">a <img src=i>link</a><a href="https://www.b.org/y"><img src=j></a>.<br>Two <code>x=1</code></p>
      <ul><li>first<ul><li>inner</li></ul></li><li>second<p>more</p></li></ul><ol><li>a<li>b</ol>
      <table><tr><th>k</th><th>v</th></tr><tr><td>a|b</td><td><p>c</p><p>d</p></td></tr></table><blockquote><p>said</p></blockquote><pre>  keep
   this</pre><hr><p class="no-md">out</p><p>x<p>y<!-- z --></body>"""
    assert T.markdown(T.parsed(page), "https://a.org/") == (
        "# Top *news*\n\nOne **bold** and [a link](/x)[b.org](https://www.b.org/y).\nTwo `x=1`\n\n- first\n  - inner\n- second\n  more\n\n1. a\n2. b\n\n"
        "| k | v |\n| --- | --- |\n| a\\|b | c d |\n\n> said\n\n```\n  keep\n   this\n```\n\n---\n\nx\n\ny"
    )


def test_spacing(spark):
    rows = spark.createDataFrame([("[a](b)[c](d)e word[f](g) ![i](j)\n\n\n\nend (x).",)], "t string")
    assert rows.select(X.markdown_spacing(F.col("t"))).first()[0] == "[a](b)\n[c](d) e word [f](g) ![i](j)\n\nend (x) ."


def test_features_of_odd_pages():
    f = extract.page_features("<head><svg><title>icon</title></svg><title>Real</title></head><h2>a<b>b</b></h2><p>x", "https://a.org")
    assert f[0] == "Real" and [h["text"] for h in f[4]] == ["ab"] and f[10] == "ab x"
    assert extract.page_features(None)[9] == "" and extract.page_features("<a>")[5] == [{"href": "", "text": ""}]
    assert extract.page_features('<p title="the nav"><a href="/a">x</a> y')[9] == "[x](/a) y"


def test_deep_and_long_pages_take_linear_time():
    began = time.time()
    for page in ("<div>" * 60_000 + "x", "<p>a<b>b" * 30_000, "</div></p>" * 60_000, "<table>" * 20_000 + "<td>x", "<li>x" * 40_000):
        extract.page_features(page, "https://a.org")
    assert time.time() - began < 30


def test_content_metrics(spark):
    pages = spark.createDataFrame([(1, "https://a.org", "<body>One two<br><br>three<div># no</div><div>four</div><ul><li>x</ul><pre>c</pre></body>"), (2, None, None)], "page_id long, url string, html string")
    rows = extract.with_features(pages).select("page_id", extract.content_metrics(F.col("f")).alias("m")).orderBy("page_id").collect()
    assert (rows[0].m.paragraphs, rows[0].m.lists, rows[0].m.code_blocks, rows[0].m.depth) == (3, 1, 1, 0)
    assert tuple(rows[1].m) == (0, 0, 0, 0, 0, 0, 0, 0, 0, 0)


ADDRESSES = [
    ("write to john [at] acme (dot) org now", ["john@acme.org"]), ("john{AT}acme[ dot ]co[dot]uk", ["john@acme.co.uk"]), ("john at acme dot org", ["john@acme.org"]), ("a.b at mail dot acme dot co dot uk dot example", ["a.b@mail.acme"]),
    ("contact us at hello@acme.com. Thanks", ["hello@acme.com"]), ("john@acme . org . We will", ["john@acme.org"]), ("user @ company", []), ("hello@acme.com . We", ["hello@acme.com"]), ("at dot", []), ("dot com at noon", []), ("x at", []), ("", []),
    ("look at this dot", []), ("mail jane @ acme . org", ["jane@acme.org"]), ("e.g. something at home dot", []),
]


def test_addresses(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(ADDRESSES)], "i int, t string")
    found = rows.select("i", X.emails(extract.deobfuscated(F.col("t"))).alias("e")).orderBy("i").collect()
    assert [r.e for r in found] == [e for _, e in ADDRESSES]


def test_mailto(spark):
    hrefs = ["mailto:A@b.org?subject=x@y.zz", "MAILTO:c%40d.org;e@f.org, g+h@i.org", "mailto:", "https://x.org", "mailto:bad%zz@k.org"]
    assert spark.createDataFrame([(hrefs,)], "h array<string>").select(extract.mailto_addresses(F.col("h"))).first()[0] == ["a@b.org", "c@d.org", "e@f.org", "g+h@i.org", "bad%zz@k.org"]
