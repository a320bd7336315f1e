"""One file a page, all or none."""

import pytest
from pyspark.sql import functions as F

from sitescribe.sources import markdown_sink as M
from sitescribe.sources import sinks

PAGES = [("https://www.a.org/", "home"), ("https://a.org/x/y/", "# deep"), ("https://a.org/x/y?q=2", "second"), ("https://b.org/../../etc/passwd", "in"), (f"https://b.org/{'long' * 100}", "long"), ("https://b.org/ü", None)]


def files(path):
    return {str(p.relative_to(path)): p.read_text() for p in path.rglob("*") if p.is_file()}


def test_files(spark, tmp_path):
    out = tmp_path / "out"
    sinks.write_markdown(spark.createDataFrame(PAGES, "url string, markdown string"), str(out))
    found = files(out)
    assert {k: v for k, v in found.items() if "long" not in k} == {"a.org/index.md": "home", "a.org/x/y.md": "# deep", "b.org/_/_/etc/passwd.md": "in", "b.org/ü.md": ""}
    assert len(found) == 5 and all(len(part) <= 255 for k in found for part in k.split("/"))
    assert [p.name for p in tmp_path.iterdir()] == ["out"] and not any(p.name.startswith(".") for p in out.rglob("*"))


def test_all_or_none(spark, tmp_path):
    out, pages = tmp_path / "out", spark.createDataFrame(PAGES, "url string, markdown string")
    broken = pages.withColumn("markdown", F.when(F.col("url").contains("b.org"), F.raise_error(F.lit("dies"))).otherwise(F.col("markdown")))
    with pytest.raises(Exception, match="dies"):
        sinks.write_markdown(broken, str(out))
    assert list(tmp_path.iterdir()) == []
    sinks.write_markdown(pages, str(out))
    with pytest.raises(Exception, match="FileExistsError"):
        sinks.write_markdown(pages, str(out))
    assert len(files(out)) == 5 and [p.name for p in tmp_path.iterdir()] == ["out"]
    sinks.write_markdown(pages.limit(0), str(out), overwrite=True)
    assert files(out) == {} and [p.name for p in tmp_path.iterdir()] == ["out"]


def test_a_task_that_runs_again_leaves_no_other_file(spark, tmp_path):
    writer = M.MarkdownWriter(str(tmp_path / "out"), False)
    rows = spark.createDataFrame([("a/b.md", "x"), ("a/c.md", "y")], "file string, markdown string").collect()

    def dying():
        yield rows[0]
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        writer.write(dying())
    messages = [writer.write(iter(rows)), writer.write(iter(rows[:1]))]
    writer.commit(messages)
    assert files(tmp_path / "out") == {"a/b.md": "x", "a/c.md": "y"}
