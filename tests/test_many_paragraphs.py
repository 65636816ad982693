"""Cross checks of a text with many paragraphs: each is looked at a few times, not once for each other one."""

import time

from leafmill.operators import validate


def test_paragraphs_that_are_there_twice(spark):
    texts = [f"p{k}q " + "word " * 20 for k in range(5000)]
    md = "---\ntitle: T\n---\n" + "\n\n".join([*texts, texts[7], "short", "short", texts[3], texts[7]])
    page = "<article>" + "".join(f"<p>{t}</p>" for t in texts) + "</article>"
    made = spark.createDataFrame([("a", md, page), ("b", "\n\n".join(texts[:5]), page), ("c", None, page), ("d", md, None)], "slug string, md string, html string").coalesce(1)
    began = time.time()
    found = validate.cross_check(made.select("slug", "md"), made.select("slug", "html")).collect()
    assert time.time() - began < 25
    twice = [(r["slug"], r["detail"]) for r in found if r["check"] == "duplicate_paragraph"]
    assert twice == [("a", f"A paragraph is there twice: {texts[3][:60]}")]
    assert {r["slug"] for r in found if r["check"] == "last_section_present"} == {"b"}
    assert [r["slug"] for r in found if r["check"] == "cross_check_error"] == ["d"]
