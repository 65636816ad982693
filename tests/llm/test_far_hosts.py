"""Trust and distrust reach hosts however far from the seeds."""

from leafmill.llm import urls


def test_distrust_reaches_hosts_over_a_hundred_links_away(spark):
    n = 104
    edges = spark.createDataFrame([(f"h{k + 1}", f"h{k}") for k in range(n)], "src string, dst string").coalesce(1)
    seeds = spark.createDataFrame([("h0", 0, 1)], "host string, good int, bad int")
    got = {r["host"]: (r["trust"], r["distrust"]) for r in urls.propagate(edges, seeds).collect()}
    assert all(abs(got[f"h{k}"][1] / (0.15 * 0.85**k) - 1) < 1e-6 and got[f"h{k}"][0] == 0 for k in range(n + 1))
