"""Substring conditions as equi-joins."""

from pyspark.sql import functions as F

from sessionmine.operators import probes
from sessionmine.plans import cards as pc, search as s


def test_rarest_probe_bounds_the_join(spark):
    """Words with a common start: the probe is what tells them apart."""
    words = [f"common{i:03d}" for i in range(200)] + ["ab", "zz"]
    texts = [f"uses {w} here" for w in words[:100]] + ["ab common", ""]
    w = spark.createDataFrame([(x,) for x in words], "word string").withColumn("grams", probes.word_grams(F.col("word")))
    t = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    p = t.select("id", "text", F.explode(probes.grams(F.col("text"))).alias("probe"))
    picked = probes.rarest(w, ["word"], "grams", p.groupBy("probe").agg(F.count(F.lit(1)).alias("n")))
    joined = p.join(picked, "probe")
    got = {(r.id, r.word) for r in joined.filter(F.contains("text", "word")).collect()}
    assert got == {(i, x) for i, text in enumerate(texts) for x in words if x in text}
    assert joined.count() < 10 * len(got)  # 20,000 by a common prefix


def test_facets_find_words_inside(spark):
    q = spark.createDataFrame([("q", "Pre-configured é€𝄞x db"), ("r", "d")], "query_id string, text string")
    docs = spark.createDataFrame([("1", "figure", ["db", "x", "€𝄞", "configured by"])], "id string, domain string, tags array<string>")
    got = {r.query_id: set(r.facets) for r in s.facets(q, docs).collect()}
    assert {"figure", "db", "€𝄞"} <= got["q"] and "configured by" not in got["q"] and got["r"] & {"figure", "db"} == set()


def test_needles_by_their_rarest_separator(spark):
    cards = [("c%d" % i, 0, f"com.acme.N{i}.run") for i in range(50)] + [("p", 0, "plainName"), ("e", 0, ".edge")]
    calls = spark.createDataFrame([("s", "1", "call com.acme.N7.run(x)"), ("s", "2", "plainName(1)"), ("s", "3", "com.acme.N8 run"), ("s", "4", None)],
                                  "session_id string, call_id string, arguments string")
    n = spark.createDataFrame(cards, "id string, pos int, needle string")
    got = {(r.call_id, r.id) for r in pc.needle_hits(calls, n, ["session_id"]).collect()}
    assert got == {("1", "c7"), ("2", "p")}
