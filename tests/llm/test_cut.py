"""Where the minimum cut decides against a block's own cost; repeated rows, nulls and an empty table."""

from leafmill.llm import extraction

LONG = "A sentence that goes on for a while, as the sentences of an article do, and then ends with a full stop. " * 3


def test_neighbours_outvote_a_weak_cost():
    inside = f"<div>{LONG}</div><div>A short line</div><div>{LONG}</div>"
    costs = [extraction._cost(*b) for b in extraction.blocks(inside)]
    assert costs[1] < 0 < min(costs[0], costs[2])
    assert "A short line" in extraction.main_text(inside).split("\n")
    links = "".join(f"<div><a href=/{k}>Page number {k} of this site here</a></div>" for k in range(6))
    among = links + "<div>More of the same pages of this site, which are many and good to read</div>" + links
    cost = [extraction._cost(*b) for b in extraction.blocks(among)][6]
    assert 0 < cost < 0.6 and extraction.main_text(among) == ""


def test_odd_tables(spark):
    pages = spark.createDataFrame([(1, None, "x"), (1, None, "x"), (2, "<p>Word after word in one sentence here.", None), (2, "<p>Word after word in one sentence here.", None), (None, "", "y")], "page_id long, html string, text string")
    got = extraction.extract(pages)
    assert got.columns == ["page_id", "html", "text"]
    assert sorted(r["text"] for r in got.collect()) == ["", "", "", *["Word after word in one sentence here."] * 2]
    assert extraction.extract(pages.limit(0)).count() == 0
