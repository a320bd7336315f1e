"""URL filters, HTML extraction, and the pipeline."""

import itertools
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitescribe.llm import html_text as H
from sitescribe.llm import url_filter as U

RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def test_rules_and_parts(spark):
    urls = [
        None, "", "no scheme/a", "http://a.net", "HTTPS://Www.Example.NET/en/x?y#z", "http://example.com/de/1", "http://x.example.com/DE/1", "http://notexample.com/de/",
        "http://b.org/fr/", "http://b.org/fr", "http://a://b/c", "http://é.net?x/y", "http://host#f/g", "http://user@a.net:80/en/", "ftp://example.net/en/",
    ]
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    labels = spark.createDataFrame([], "id long, unwanted boolean")
    out = {r.page_id: r for r in U.judged(pages, labels, RULES).collect()}
    assert len(out) == len(urls)
    for i, u in enumerate(urls):
        host, path = parts(u)
        fits = [(len(h + p), v, h + p) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        _, verdict, rule = max(fits, default=(0, "allow", None))
        assert (out[i].host, out[i].path, out[i].rule, out[i].verdict) == (host, path, rule, verdict), u
    assert U.judged(pages.limit(0), labels, RULES).collect() == []
    assert U.judged(pages, labels, []).where("verdict = 'block'").collect() == []


def test_mined_rules_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(U, "MIN_SUPPORT", 0.05)
    rng = random.Random(6)
    urls = [f"http://{rng.choice(['shop', 'news', 'cheap-pills'])}.{rng.choice(['a', 'b'])}.io/{rng.choice(['en', 'x'])}/{rng.choice('uvw')}" for _ in range(240)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    bad = {i: "pills" in u and rng.random() < 0.8 or "shop.a" in u and "/x/" in u and rng.random() < 0.9 or rng.random() < 0.1 for i, u in enumerate(urls) if i % 2}
    labels = spark.createDataFrame([*bad.items(), (None, True), (5000, True)], "id long, unwanted boolean")
    tokens = {r.page_id: frozenset(r.t) for r in pages.select("page_id", U.url_tokens(F.col("url")).alias("t")).collect()}
    least = max(0.05 * len(bad), U.MIN_PAGES)
    rules = {}
    for size in range(1, 8):
        sets = {frozenset(c) for i in bad for c in itertools.combinations(sorted(tokens[i]), size)}
        for s in sets:
            n, hit = sum(s <= tokens[i] for i in bad), sum(s <= tokens[i] and bad[i] for i in bad)
            if hit >= least - 1e-9 and hit / n >= U.MIN_CONFIDENCE:
                rules[s] = hit / n
    found = {frozenset(r.tokens): r.confidence for r in U.mine_rules(pages, labels).collect()}
    assert rules and all(rules[s] == pytest.approx(c) for s, c in found.items())
    assert {s for s in rules if len(s) == 1} == {s for s in found if len(s) == 1} and any(len(s) > 1 for s in found)
    closed = lambda s: frozenset.intersection(*(tokens[i] for i in bad if s <= tokens[i]))  # noqa: E731  with what never lacks where they are
    assert all(any(f <= closed(s) for f in found) for s in rules)  # no rule is lost: one found says the same or more
    out = U.judged(pages, labels, []).collect()
    assert {r.page_id for r in out if r.verdict == "block"} == {i for i in tokens if any(s <= tokens[i] for s in rules)}


def mined_by_brute_force(tokens, bad):
    """Every rule of several tokens of which none is a rule by itself, by counting all combinations."""
    rules, alone = {}, set()
    for size in range(1, max(len(tokens[i]) for i in bad) + 1):
        for s in {frozenset(c) for i in bad if bad[i] for c in itertools.combinations(sorted(tokens[i] - alone), size)}:
            n, hit = sum(s <= tokens[i] for i in bad), sum(s <= tokens[i] and bad[i] for i in bad)
            if hit >= U.MIN_PAGES and hit / n >= U.MIN_CONFIDENCE:
                rules[s] = hit / n
        alone |= {t for s in rules if size == 1 for t in s}
    return rules


@pytest.mark.parametrize("seed", range(3))
def test_no_combination_is_lost(spark, seed):
    """Tokens that several rarer ones imply, and tokens that only on labelled pages occur always together."""
    kinds = {"b/p/c": (3, 0), "b/p": (3, 9), "b/q/c": (3, 0), "b/q": (3, 9), "c": (0, 12), "d/e/f": (6, 0), "d/e": (0, 9), "f": (0, 12)}
    urls = [(f"http://h.io/{path}", k < bad) for path, (bad, good) in kinds.items() for k in range(bad + good)]
    if seed:
        rng = random.Random(seed)
        up = {"p": "b", "q": "b", "r": "g", "s": "g", "b": "z", "g": "z"}
        for _ in range(150):
            parts = {rng.choice("pqrsc"), rng.choice("pqcbf"), rng.choice("bgkc"), rng.choice("kc")}
            while not {up.get(x, x) for x in parts} <= parts:
                parts |= {up.get(x, x) for x in parts}
            urls.append((f"http://h.io/{'/'.join(sorted(parts))}", {"b", "c"} <= parts and rng.random() < 0.7 or rng.random() < 0.2))
    bad = dict(enumerate(b for _, b in urls))
    new = ["http://h.io/b/c", "http://h.io/d/f", "http://h.io/e/f", "http://h.io/d/e", "http://h.io/b", "http://h.io/z/c"]
    pages = spark.createDataFrame(list(enumerate([*(u for u, _ in urls), *new])), "page_id long, url string")
    tokens = {r.page_id: frozenset(r.t) for r in pages.select("page_id", U.url_tokens(F.col("url")).alias("t")).collect()}
    labels = spark.createDataFrame(list(bad.items()), "id long, unwanted boolean")
    want = mined_by_brute_force(tokens, bad)
    found = [(r.alike, r.confidence) for r in U.mine_rules(pages, labels).collect()]
    for alike, confidence in found:
        assert all(want[frozenset(c)] == pytest.approx(confidence) for c in itertools.product(*alike))
    every = [frozenset(c) for alike, _ in found for c in itertools.product(*alike)]
    assert len(every) == len(set(every)) and (seed or {frozenset({"path=b", "path=c"}), frozenset({"path=d", "path=f"}), frozenset({"path=e", "path=f"})} <= set(every))
    assert all(any(f <= s and want[f] == pytest.approx(want[s]) for f in every) for s in want)  # one with fewer tokens, met by the same pages, or itself
    out = {r.page_id: r for r in U.judged(pages, labels, []).collect()}
    for i, t in tokens.items():
        assert out[i].confidence == pytest.approx(max((c for s, c in want.items() if s <= t), default=None)), out[i]


def test_traps_end(spark):
    """Addresses of forty parts that repeat or nest, unwanted and wanted: a token each, not all of their subsets."""
    path = "/".join(f"p{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(40))
    nested = ["/".join(f"q{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(k % 40 + 1)) for k in range(120)]
    urls = [f"http://a.io/{path}"] * 100 + [f"http://b.io/{p}" for p in nested] + [f"http://c.io/{i}" for i in range(50)]
    frame = spark.createDataFrame([(i, u, 1, 2) for i, u in enumerate(urls)], "page_id long, url string, tokens int, id int")
    began = time.monotonic()
    for share in (2, 1):  # half of the pages unwanted, which is below the least confidence, and all
        labels = spark.createDataFrame([(i, i % share == 0 and i < 220) for i in range(len(urls))], "id long, unwanted boolean")
        out = U.judged(frame, labels, []).collect()
        assert len(out) == len(urls)
        assert all((r.verdict == "block") == (share == 1) for r in out if r.page_id < 100)
        assert share == 1 or all(r.verdict == "allow" for r in out if r.page_id >= 220)
    assert time.monotonic() - began < 100


PAGE = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar"><nav><ul><li><a href=/a>Menu</a></ul></nav><!-- <p>no -->
<header>Top</header><div class="cookie-notice">We use cookies</div><article><h1>T&eacute;st &amp; more</h1><p>One <a href=x>two</a>\n three<br>four<div class="ad">buy</div><p><b>five<br><p>six</b>
<form><p>mail</form><section id="comments"><p>nice</p></section><p>&lt;seven&gt;&nbsp;8</p></article><aside>x</aside><footer>&copy; y</footer></body></html>"""


def texts_of(pages):
    """The main texts of the pages of one host, by comparing every run of ``LONG`` tokens with all pages."""
    found = [H.judged_blocks(p) for p in pages]
    streams = [[w for text, free in blocks if free for w in text.split(" ")] for _, blocks in found]
    runs = {}
    for stream in streams:
        for k in range(len(stream) - H.LONG + 1):
            runs.setdefault(tuple(stream[k : k + H.LONG]), set()).add(tuple(stream))
    out = []
    for (marked, blocks), stream in zip(found, streams, strict=True):
        cover, at, kept = [False] * len(stream), 0, []
        for k in range(len(stream) - H.LONG + 1):
            if len(runs[tuple(stream[k : k + H.LONG])]) >= H.SHARED_PAGES:
                cover[k : k + H.LONG] = [True] * H.LONG
        for text, free in blocks:
            n = len(text.split(" ")) if free else 0
            if not free or sum(cover[at : at + n]) < H.COVERED * n:
                kept.append(text)
            at += n
        out.append("\n\n".join(kept or ([] if marked else [text for text, _ in blocks])))
    return out


def main_texts(spark, pages, url="http://h.org/"):
    frame = spark.createDataFrame([(i, url, p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    return [r.text for r in sorted(H.extracted(frame).collect(), key=lambda r: r.page_id)]


ARTICLE = "Tést & more\n\nOne two three four\n\nfive\n\nsix\n\n<seven> 8"


def test_article_text(spark):
    pages = [PAGE, None, "", "<p>plain <b>text</b>", "no markup", PAGE, PAGE, PAGE]
    assert main_texts(spark, pages) == [ARTICLE, "", "", "plain text", "no markup", *[ARTICLE] * 3]  # copies of an article stay


def test_classes_inside_articles():
    text = lambda page: [t for t, _ in H.judged_blocks(page)[1]]
    assert text("<article class='post has-sidebar'><p>a</article>") == ["a"]
    assert text("<div class='content with-sidebar'><p>a</div><div class=sidebar>b</div>") == ["a"]
    assert text("<article><div class='article-header'><h1>a</h1></div><p class='reply'>b<p class='ad'>c<div class='ad-slot'>d</div><ul class='share-buttons'><li>e</ul></article>") == ["a", "b"]
    assert text("<article><p>a</p><article class='comment'>b</article><div class='comment-list'>c</div></article>") == ["a"]
    assert text("<div class='site-header'>x</div><main class='menu'><p>a</main>") == ["a"]


def test_boilerplate_of_unmarked_pages_goes(spark):
    chrome, own = "welcome to our little shop on the corner of the street", [" ".join(f"own{i}-{k}" for k in range(9)) for i in range(5)]
    pages = [f"<div>{chrome}</div><p>{t}</p><div>{chrome} again</div>" for t in own]
    whole = f"{chrome}\n\n{own[0]}\n\n{chrome} again"
    assert main_texts(spark, pages) == own == texts_of(pages)
    assert main_texts(spark, [pages[0]] * 5) == [whole] * 5  # copies are no other pages
    assert main_texts(spark, ['<div id="main-content"><p>a</p></div><div class="x"><p>b</p></div>']) == ["a"]
    assert main_texts(spark, pages[:3])[0] == whole  # too few pages to tell


def test_texts_equal_brute_force(spark):
    """Hosts of marked and unmarked pages with common blocks, links inside articles, and copies."""
    rng = random.Random(2)
    words = lambda n: " ".join(rng.choice("abcdefgh") + rng.choice("klmn") + str(rng.randrange(4)) for _ in range(n))
    common = [words(n) for n in (3, 8, 12, 30)]
    hosts = {}
    for host in "xyz":
        for _ in range(25):
            body = [rng.choice([f"<p>{words(rng.randint(1, 25))}", f"<div>{rng.choice(common)}</div>", f"<div>{rng.choice(common)} {words(4)}</div>", f"<ul><li><a href=x>{rng.choice(common)}</a></ul>"]) for _ in range(rng.randint(1, 7))]
            page = "<nav>menu</nav>" + "".join(body)
            hosts.setdefault(host, []).append(page if rng.random() < 0.6 else f"<article>{page}</article><div>{common[1]}</div>")
        hosts[host] += hosts[host][:3]
    rows = [(i, f"http://{h}.org/{i}", p) for h in hosts for i, p in enumerate(hosts[h])]
    out = {(r.url.split(".")[0][-1], r.page_id): r.text for r in H.extracted(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    want = {(h, i): t for h in hosts for i, t in enumerate(texts_of(hosts[h]))}
    assert out == want
    by_markup = sum("\n\n".join(t for t, _ in H.judged_blocks(p)[1]) != want[h, i] for h in hosts for i, p in enumerate(hosts[h]))
    assert by_markup > 20  # pages whose text the suffix array changes


@pytest.mark.parametrize("piece", ["<title ", '<a "', "<a '\"", "<![CDATA[", "<b>", "</i>", "<!--", "<b></i>", "<p><span>", "<div class='x", "&amp", "<", "<svg", "</script", "<script>", "<style x='", "<article>", "<a href=x>y ", "\u0130<p"])
def test_any_page_of_a_megabyte_takes_a_moment(piece):
    page = piece * (1_000_000 // len(piece))
    began = time.process_time()
    H.page_blocks(page)
    assert time.process_time() - began < 6  # a machine may be slow; quadratic time would be minutes


def test_extracted_rows(spark):
    pages = [(i, f"http://h{i % 2}.org/{i}", PAGE.replace("Test", str(i))) for i in range(40)] + [(90, None, None), (91, "", ""), (92, "bad", PAGE), (3, "http://h1.org/3", PAGE), (None, "http://h1.org/3", "<p>x" * 60_000)]
    frame = spark.createDataFrame([(*p, "t", "h", 1, True) for p in pages], "page_id long, url string, html string, text string, _host string, page int, marked boolean")
    out = H.extracted(frame).collect()
    assert sorted(((r.page_id is None, r.page_id or 0) for r in out)) == sorted((p[0] is None, p[0] or 0) for p in pages)
    assert all(r.text == ARTICLE for r in out if r.page_id is not None and r.page_id not in (90, 91))
    assert H.extracted(frame.limit(0)).collect() == []


def test_pipeline_stages(spark):
    import corpus_pipeline as P

    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    names = [name for name, _ in P.STAGES]
    assert names == ["quality classifier", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "mixing sources to target weights"]
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    now = docs
    for k, (_, stage) in enumerate(P.STAGES):
        before = {r.doc_id: r.text for r in now.collect()}
        now = P.materialise(stage(spark, now, sf), f"test-{k}")
        after = {r.doc_id: r.text for r in now.collect()}
        assert set(after) <= set(before) and now.columns[:5] == columns
        if k == 0:
            assert np.mean([(d in after) == bool(q) for d, q in quality.items()]) > 0.95
        if k == 2:
            from test_pairs import shingles, smallest

            ids = sorted(before)
            sets = [shingles(before[i], 5) for i in ids]
            links = [(a, b) for a in range(len(ids)) for b in range(a) if sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
            root = smallest(len(ids), links)
            assert set(after) == {i for k, i in enumerate(ids) if root[k] == k}
        if k == 4:
            assert set(after) == set(before) and {"mix_slot", "mix_offset"} <= set(now.columns)


def test_pipeline_stages_on_odd_rows(spark):
    import corpus_pipeline as P

    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(40)
    odd = spark.createDataFrame([(None, None, None, None, None), (-1, "", "en", "src0", 0), (-1, "", "en", "src0", 0), (-2, "word " * 30_000, None, "src1", None)], docs.schema)
    both = docs.union(odd).withColumn("_score", F.lit("clash")).withColumn("component_id", F.lit(1)).withColumn("_key", F.lit("k")).withColumn("_match", F.lit(2))
    for _, stage in P.STAGES:
        out = stage(spark, both, sf)
        assert set(both.columns) <= set(out.columns)
        assert {(r._score, r.component_id, r._key, r._match) for r in out.collect()} == {("clash", 1, "k", 2)}
        assert stage(spark, both.limit(0), sf).count() == 0


@pytest.mark.parametrize(("page", "text"), [
    ('<main><p title="the hidden gem">text</p></main>', "text"), ('<article><p data-id="menu">text</p></article>', "text"), ('<main><div data-role="navigation"><p>text</p></div></main>', "text"),
    ('<main><div class="social-history"><p>text</p></div></main>', "text"), ('<main><section id="comments-on-policy"><p>text</p></section></main>', "text"), ("<article><p>Text <button>Subscribe now</button> end</p></article>", "Text end"),
    ('<article><p>a <span hidden>b</span> c <span class="ad">d</span> e</p></article>', "a c e"), ('<article><p>a</p><div class="related-posts"><p>b</p></div><div class="share-buttons">c</div></article>', "a"), ('<article><p id=x class="one" class="ad">a</p></article>', "a"),
])
def test_attributes_and_inline_chrome(page, text):
    """Names in values, other attributes' names, topics in classes, and chrome inside a block."""
    assert "\n\n".join(t for t, _ in H.judged_blocks(page)[1]) == text
