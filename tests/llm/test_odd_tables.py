"""Nulls, empty texts, repeated rows and ids, empty tables and clashing columns, operator by operator and stage by stage."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from leafmill.llm import lines, mixing, simhash, toxicity

FOLDER = "/root/testdata/sf0.001"
LINE = "one two three four five six seven eight"


def _rows(spark):
    texts = [LINE, LINE, None, "", "  \n ", f"{LINE} nine\nother words here", "x " * 4000, "x " * 4000]
    rows = [(None if k == 1 else 3 if k in (3, 4) else k, t, "en", None if k == 5 else "s") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.char_length("text").cast("long"))


def test_lines_with_null_and_repeated_ids(spark):
    docs = _rows(spark).withColumns({"line": F.lit("c"), "rid": F.lit("c"), "block": F.lit("c"), "kept": F.lit("c")}).coalesce(1)
    got = lines.dedup(docs)
    assert got.columns == [*docs.columns, "n_lines", "n_removed"]
    rows = [(r["doc_id"], r["text"], r["n_lines"], r["n_removed"], r["rid"]) for r in got.collect()]
    # the null id comes first and keeps the line; a null text has no line; lines without words stay
    assert sorted(rows, key=repr) == sorted([(0, "", 1, 1, "c"), (None, LINE, 1, 0, "c"), (2, None, 0, 0, "c"), (3, "", 1, 0, "c"), (3, "  \n ", 2, 0, "c"), (5, "other words here", 2, 1, "c"), (6, "x " * 4000, 1, 0, "c"), (7, "", 1, 1, "c")], key=repr)


def test_toxicity_of_odd_tables(spark):
    model = toxicity.fit(["awful gruntfool words"] * 12, ["fine words of all kinds"] * 12)
    docs = _rows(spark).withColumns({"score": F.lit("c"), "model": F.lit("c")})
    scored = docs.withColumn("s", toxicity.score_column(spark, model, docs["text"]))
    got = [(r["text"], r["s"]) for r in scored.collect()]
    assert len(got) == 8 and all(0 <= s <= 1 for _, s in got) and len({s for t, s in got if not (t or "").strip()}) == 1 and len({s for t, s in got if t == LINE}) == 1
    assert docs.limit(0).select(toxicity.score_column(spark, model, docs["text"])).count() == 0
    labels = spark.createDataFrame([(0, 1), (0, 1), (5, 0), (None, 1)], "doc_id long, toxic int")
    assert toxicity.train(docs.limit(0), labels).weights is None and toxicity.train(docs, labels.limit(0)).weights is None


def test_toxicity_against_a_plain_version():
    """Scores from the lengths that the two dictionaries give window by window."""
    import numpy as np

    model = toxicity.fit([f"awful gruntfool words number {k}" for k in range(30)], [f"fine words of all kinds number {k}" for k in range(30)])
    plain, toxic = toxicity._compressor(model.ordinary), toxicity._compressor(model.toxic + model.ordinary)
    for text in ("awful gruntfool words", "fine words", "", None, "gruntfool " * 50):
        saved = [len(plain.compress(w)) - len(toxic.compress(w)) for w in toxicity.windows(text)]
        won = [x for x in saved if x > 0]
        x = np.array([min(max(won, default=0), 6) / 3, np.log1p(sum(won)), np.log1p(len(won)), np.log1p(len(saved)), 1.0])
        assert abs(1 / (1 + np.exp(-x @ model.weights)) - model.score([text])[0]) < 1e-9


def test_copies_with_clashing_names(spark):
    docs = _rows(spark).withColumns({c: F.lit("c") for c in ("fp", "row", "id", "doc", "class_id", "mix_source", "target", "size")})
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns and sorted(((r["doc_id"], r["fp"]) for r in kept.collect()), key=repr) == [(0, "c"), (2, "c"), (5, "c"), (6, "c")]
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r["copies"] for r in mixing.plan(docs).collect())
    assert simhash.keep_first(docs.limit(0)).count() == mixing.mix(docs.limit(0)).count() == 0


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_tables(spark, name):
    stage, last = dict(corpus_pipeline.STAGES)[name], name == corpus_pipeline.STAGES[-1][0]
    docs = _rows(spark).withColumn("extra", F.lit(1))
    got = stage(spark, docs, FOLDER)
    rows = got.collect()
    assert last or got.columns == docs.columns
    assert stage(spark, docs.limit(0), FOLDER).count() == 0
    if name in ("toxicity", "line dedup"):
        assert len(rows) == 8
    elif name == "simhash near-dedup":
        assert sorted((r["doc_id"] for r in rows), key=repr) == [0, 2, 5, 6]
    elif last:
        assert len(rows) == 8 and sorted(r["text"] for r in rows) == sorted(r["text"] or "" for r in docs.collect())
