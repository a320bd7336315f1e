"""Line diffs against difflib, and walks against queues worked off one by one."""

import difflib
import random

import pytest

from sitescribe.operators import frontier, line_diff, sitemaps


def expected(a, b):
    out = list(difflib.unified_diff((a or "").splitlines(keepends=True), (b or "").splitlines(keepends=True), "previous", "current", n=3))
    return "\n".join(x.rstrip("\n\r\x0b\x0c\x1c\x1d\x1e\x85  ") for x in out) if out else None


def diffs(spark, pairs):
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "id int, before string, after string")
    return {r.id: r["diff"] for r in line_diff.unified(line_diff.line_diff(rows)).collect()}


def edited(rng, lines):
    out = list(lines)
    for _ in range(rng.randint(0, 6)):
        at = rng.randint(0, len(out))
        kind = rng.random()
        if kind < 0.4:
            del out[at : at + rng.randint(1, 4)]
        elif kind < 0.8:
            out[at:at] = [rng.choice("vwxyz") * rng.randint(0, 2) for _ in range(rng.randint(1, 4))]
        else:
            part = out[at : at + 5]
            del out[at : at + 5]
            to = rng.randint(0, len(out))
            out[to:to] = part
    return out


def test_random_pairs(spark):
    rng, pairs = random.Random(4), []
    for _ in range(60):
        lines = [rng.choice(["", "a", "b", f"line {rng.randint(0, 30)}"]) for _ in range(rng.choice([0, 1, 5, 20, 60]))]
        pairs.append(("\n".join(lines), "\n".join(edited(rng, lines)) + rng.choice(["", "\n"])))
    want = {i: d for i, (a, b) in enumerate(pairs) if (d := expected(a, b))}
    assert len(want) > 40 and diffs(spark, pairs) == want


def test_frequent_lines_of_long_texts(spark):
    rng, pairs = random.Random(5), []
    for _ in range(8):
        lines = [rng.choice(["", "", "}", f"line {rng.randint(0, 400)}"]) for _ in range(260)]
        pairs.append(("\n".join(lines), "\n".join(edited(rng, lines))))
    assert diffs(spark, pairs) == {i: d for i, (a, b) in enumerate(pairs) if (d := expected(a, b))}


def test_odd_texts(spark):
    pairs = [(None, None), (None, "a"), ("a", None), ("", ""), ("a\r\nb\x0bc d", "a\nb\x0bc e"), ("same", "same"), ("a", "a\n"), ("x\n" * 3, "x\n" * 9)]
    assert diffs(spark, pairs) == {i: d for i, (a, b) in enumerate(pairs) if (d := expected(a, b))}
    assert diffs(spark, []) == {}


def simulated(start, final, links, seeds, budget, depth):
    met, visited, waiting, out, truncated = {start}, 1, [], [(0, start, 0, "visited")], False
    order = lambda urls: sorted(set(urls), key=lambda u: (len(u), u))
    for u in order(links.get(start, [])) + order(seeds):
        if u not in met and visited + len(waiting) < budget:
            met.add(u)
            waiting.append((u, 1))
    n = 0
    while waiting:
        (u, d), n = waiting.pop(0), n + 1
        end = final.get(u)
        if visited >= budget:
            outcome = "left"
        elif end is None:
            outcome = "failed"
        elif end != u and end in met:
            outcome = "alias"
        else:
            met.add(end)
            outcome = "visited" if end.startswith("https://s/") else "foreign"
            if outcome == "visited":
                visited += 1
                if depth == 0 or d < depth:
                    for to in links.get(end, []):
                        if to not in met and visited + len(waiting) < budget:
                            met.add(to)
                            waiting.append((to, d + 1))
                elif links.get(end):
                    truncated = True
        out.append((n, u, d, outcome))
    return out, "max_pages" if out[-1][3] == "left" else "max_depth" if truncated else "queue_empty"


@pytest.mark.parametrize(("seed", "budget", "depth"), [(1, 8, 0), (2, 30, 2), (3, 15, 3), (4, 1, 1)])
def test_crawl(spark, seed, budget, depth):
    rng = random.Random(seed)
    pages = [f"https://s/{i}" for i in range(40)]
    ends = {u: None if rng.random() < 0.2 else rng.choice(pages) if rng.random() < 0.2 else f"https://t/{i}" if rng.random() < 0.1 else u for i, u in enumerate(pages)}
    links = {u: [rng.choice(pages) for _ in range(rng.randint(0, 6))] for u in pages}
    start, seeds = "https://s/", pages[-3:]
    links[start] = pages[:4]
    frames = (
        spark.createDataFrame([("s", start)], "site string, url string"), spark.createDataFrame(list(ends.items()), "url string, final string"),
        spark.createDataFrame([(u, p, t) for u, ts in links.items() for p, t in enumerate(ts)], "url string, position int, target string"), spark.createDataFrame([("s", u) for u in seeds], "site string, url string"),
    )
    got = frontier.crawl(*frames, budget=budget, depth=depth)
    want, reason = simulated(start, ends, links, seeds, budget, depth)
    assert sorted((r.n, r.url, r.depth, r.outcome) for r in got.collect()) == want
    assert [r.stop_reason for r in frontier.crawl_summary(got, budget).collect()] == [reason]


def test_deep_walks_stay_small(spark):
    edges = spark.range(30).selectExpr("id as src", "id + 1 as dst")
    found = frontier.walk(edges, spark.range(1).withColumnRenamed("id", "page_id"), 12)
    assert {r.page_id: r.depth for r in found.collect()} == {n: n for n in range(13)}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 13


def test_sitemaps_without_files(spark):
    files = spark.createDataFrame([("https://a/x.xml", "<urlset><url><loc> p </loc></url><url><loc/></url><url><loc>/q?x=1</loc></url></urlset>"), ("https://a/bad.xml", "<urlset><loc>"), ("https://a/null.xml", None)], "source string, xml string")
    seeds = spark.createDataFrame([("a", i, f"https://a/{n}.xml") for i, n in enumerate(["bad", "null", "none", "x"])], "site string, place int, url string")
    walk = sitemaps.sitemap_walk(files, seeds).orderBy("n").collect()
    assert [(r.n, r.seen, r.found, r.n_pages) for r in walk] == [(1, False, True, 0), (2, False, True, 0), (3, False, False, 0), (4, False, True, 2)]
    assert sorted((r.place, r.url) for r in sitemaps.sitemap_pages(files, seeds, max_urls=5).collect()) == [(0, "https://a/p"), (1, "https://a/q?x=1")]
    assert sitemaps.sitemap_pages(files, seeds.limit(0)).count() == 0
