"""Numbering, lookups and enrichment: whole rows, ties and skew."""

from pyspark.sql import functions as F

from quillon.operators import corpus, link


def test_numbers_are_consecutive_with_payload(spark):
    # a third of the rows share one key
    df = spark.range(3_000_000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 100_003).alias("k"), F.sha1(F.col("id").cast("string")).alias("payload"))
    got = link.number(df, ["k"], "n")
    s = got.agg(F.count("*").alias("rows"), F.countDistinct("n").alias("numbers"), F.min("n").alias("lo"), F.max("n").alias("hi"), F.countDistinct("payload").alias("payloads")).first()
    assert tuple(s) == (3_000_000, 3_000_000, 1, 3_000_000, 3_000_000)
    # numbers follow the order: the ranges of the keys do not overlap
    spans = got.groupBy("k").agg(F.min("n").alias("a"), F.max("n").alias("b"), F.count("*").alias("c"))
    assert spans.where("b - a + 1 <> c").isEmpty()
    assert spans.agg(F.min(F.struct("a", "k"))).first()[0]["k"] == 0


def test_remaining_fills_every_batch(spark):
    rows = spark.range(200_000).select((F.col("id") % 5000).alias("key"), F.col("id").alias("o"), F.repeat(F.lit("x"), 20).alias("text"), F.lit(None).cast("string").alias("batch_note"))
    rows = rows.unionByName(spark.createDataFrame([(None, 1, "t", None)], rows.schema))
    done = spark.range(0, 5000, 2).select(F.col("id").alias("key"))
    got = link.remaining(rows, done, "key", "o", 999).groupBy("batch").count().collect()
    sizes = {r["batch"]: r["count"] for r in got}
    assert sum(sizes.values()) == 100_000
    assert all(n == 999 for b, n in sizes.items() if b != max(sizes)) and set(sizes) == set(range(max(sizes) + 1))
    assert link.remaining(rows.limit(0), done, "key", "o", 10).count() == 0


def test_first_row_of_a_key_wins(spark):
    table = spark.createDataFrame([("a", "x", 2, "late"), ("a", "x", 1, "early"), (None, "x", 0, "no key"), ("b", None, 1, "b")], "k string, k2 string, o int, v string").repartition(3)
    rows = spark.createDataFrame([("a", "q"), ("z", "x"), ("z", None), (None, None)], "k string, t string")
    got = [(r["v"], r["matched_by"]) for r in link.fallback_lookup(rows, table, ("k", "k"), ("t", "k2"), "v", "o").orderBy("k", "t").collect()]
    assert sorted(got, key=str) == sorted([(None, "none"), ("early", "k"), (None, "none"), ("no key", "t")], key=str)
    out = corpus.enriched(rows, [("source", table.select("k", "o", "v"))], "k", "o").where("k = 'a'").first()
    assert (out["v"], out["has_source"]) == ("early", True) and "o" not in out.asDict()


def test_probes_of_any_length(spark, monkeypatch):
    texts = spark.createDataFrame([(1, "one two three four five six seven eight nine ten"), (2, "two three"), (3, ""), (4, None), (5, "xtwo three")], "t int, text string").repartition(2)
    probes = spark.createDataFrame([(1, "two three"), (2, "two three four five six seven eight nine"), (3, ""), (4, None), (5, "ten"), (6, "one two three four five six seven eight nine te"), (7, "three two")], "p int, probe string")
    want = {(1, 1), (2, 1), (1, 2), (1, 5), (1, 6)}
    for most in (500_000, 0):  # hashes are sent, or runs are shuffled
        monkeypatch.setattr(link, "SENT_HASHES", most)
        got = link.contains_blocked(texts, probes, "t", "text", "p", "probe")
        assert {(r["t"], r["p"]) for r in got.collect()} == want
    assert link.contains_blocked(texts, probes.limit(0), "t", "text", "p", "probe").count() == 0


def test_sources_of_a_locator_are_all_listed(spark, monkeypatch):
    links = spark.range(10_000).select(F.lit("everywhere").alias("loc"), (F.col("id") % 5000).alias("page_id"), (F.col("id") % 3).cast("int").alias("pos"), F.concat(F.lit("h"), F.col("id").cast("string")).alias("href"))
    links = links.unionByName(spark.createDataFrame([("once", 12, 100_001, "late"), ("once", 13, 0, "next page"), ("once", 12, 7, "early")], "loc string, page_id long, pos int, href string"))
    got = {r["loc"]: r for r in link.gathered(links, "loc", "page_id", "pos", "href").collect()}
    assert got["everywhere"]["sources"] == ",".join(map(str, range(5000)))
    assert (got["everywhere"]["occurrences"], got["everywhere"]["n_sources"], got["everywhere"]["href"]) == (10_000, 5000, "h0")
    assert tuple(got["once"])[1:] == ("early", 3, "12,13", 2)
