"""Organisations below six levels of JSON-LD."""

import json

from pyspark.sql import functions as F

from sitescribe.operators import extract, structured


def test_organisations_below_six_levels(spark):
    deep = {"@type": "Organization", "name": "Deep", "description": "d"}
    raw = {"@graph": [{"@type": "WebPage", "mainEntity": [{"@type": "Question", "acceptedAnswer": {"@type": "Answer", "author": deep}}]}]}
    nested = {"@type": ["Thing", "Organization"], "name": "Deeper"}
    for _ in range(100):
        nested = {"part": [nested]}
    rows = [(1, [json.dumps(raw)]), (2, [json.dumps(nested)])]
    items = extract.jsonld_items(spark.createDataFrame(rows, "page_id long, j array<string>").select("page_id", F.struct(F.col("j").alias("jsonld")).alias("f")))
    assert {(r.page_id, r.name, r.description) for r in structured.organisations(items).collect()} == {(1, "Deep", "d"), (2, "Deeper", None)}
