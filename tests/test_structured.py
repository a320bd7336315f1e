"""JSON-LD summaries and nested objects."""

import json

from pyspark.sql import functions as F

from sitescribe.operators import structured as D

FAQ = {"@type": "FAQPage", "mainEntity": [{"@type": "Question", "name": "What does it do?", "acceptedAnswer": {"text": "It finds things. And more."}}, {"name": "How much?"}, {"name": ""}, 3]}
CONTACTS = {"@type": "Organization", "name": "Acme", "contactPoint": [{"contactType": "sales", "email": "s@x.com", "x": 1}, "no", {"contactType": "support", "email": ""}, {"contactType": "late"}]}
APP = {"@type": ["SoftwareApplication"], "name": "Acme", "featureList": [f"f{i}" for i in range(9)], "offers": {"price": "0", "priceCurrency": "USD"}, "author": {"name": "A"}, "publisher": "none", "logo": {"url": "l"}, "isAccessibleForFree": False}
SAME = {"name": "B", "sameAs": ["a", "b", "c", "d"], "offers": {"price": None}, "contactPoint": {"telephone": "1"}, "mainEntity": [{"name": None}], "softwareVersion": 0, "description": ""}


def items(spark, objects):
    rows = spark.createDataFrame([(1, i, json.dumps(x)) for i, x in enumerate(objects)], "page_id long, place int, raw string")
    return rows.select("page_id", "place", F.parse_json("raw").alias("item"))


def test_summaries(spark):
    got = {r.place: json.loads(r.summary) for r in D.summaries(items(spark, [FAQ, CONTACTS, APP, SAME, {}, {"name": "sixth"}])).collect()}
    assert got == {
        0: {"@type": "FAQPage", "mainEntity_count": 4, "mainEntity_qa": [{"question": "What does it do?", "answer_excerpt": "It finds things"}, {"question": "How much?"}]},
        1: {"@type": "Organization", "name": "Acme", "contactPoint": [{"contactType": "sales", "email": "s@x.com"}, {"contactType": "support"}]},
        2: {"@type": ["SoftwareApplication"], "name": "Acme", "logo": {"url": "l"}, "author": "A", "offers": {"price": "0", "priceCurrency": "USD"}, "featureList": [f"f{i}" for i in range(6)]},
        3: {"name": "B", "contactPoint": {"telephone": "1"}, "sameAs_count": 4, "sameAs_sample": ["a", "b", "c"]},
    }
    assert D.summaries(items(spark, [])).count() == 0


def test_objects_at_any_depth(spark):
    deep = {"@type": "X", "a": [{"b": {"@type": "Organization", "name": "in", "c": [[{"@type": ["Brand", "Organization"], "name": 5}]]}}], "d": None}
    found = D.every_object(items(spark, [deep, {"@type": "Organization", "description": "top"}]))
    assert sorted(r.depth for r in found.collect()) == [0, 0, 2, 3, 6]
    assert {(r.name, r.description) for r in D.organisations(items(spark, [deep, {"@type": "Organization", "description": "top"}])).collect()} == {("in", None), (None, None), (None, "top")}
    assert D.every_object(items(spark, [])).count() == 0
