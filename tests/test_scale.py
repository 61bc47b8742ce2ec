"""Steps whose work must not grow with the square of the rows."""

import math
import random
import time

from pyspark.sql import functions as F

from driftline.operators import align, cluster, products, sections, textdiff
from driftline.operators.graph import components

WORDS = ("widget", "bolt", "gear")


def sections_of(spark, n, text):
    """``n`` sections of either side in one pair."""
    return spark.range(2 * n).select(F.lit("p").alias("pair_id"), F.when(F.col("id") % 2 == 0, "base").otherwise("compare").alias("role"), F.col("id").alias("seq"), F.lit("12").alias("number"), text.alias("title"), F.lit("").alias("content"), F.lit("1").alias("page"))


def test_repeated_contents_do_not_meet_one_by_one(spark):
    # 400 million pairs of sections, 9 of contents.
    secs = sections_of(spark, 20000, F.concat(F.lit("old "), F.element_at(F.array(*map(F.lit, WORDS)), ((F.col("id") / 2).cast("int") % 3 + 1).cast("int"))))
    got = align.matches(secs, WORDS).groupBy("base_seq").agg(F.count("*").alias("n"), F.min("similarity").alias("low")).collect()
    assert sorted((r.base_seq, r.n, r.low) for r in got) == [(0, 6667, 1.0), (2, 6667, 1.0), (4, 6666, 1.0)]


def test_matches_are_the_best_of_all_pairs_in_any_blocks(spark, monkeypatch):
    rnd = random.Random(3)
    rows = [(p, role, k, str(k % 30), " ".join(rnd.choices(["red", "old", *WORDS, "the", "x"], k=rnd.randrange(0, 5))), rnd.choice(["", "gear", "none"]), "1") for p in "pq" for role in ("base", "compare") for k in range(60)]
    secs = spark.createDataFrame(rows, "pair_id string, role string, seq long, number string, title string, content string, page string").cache()
    for threshold in (0.25, 0.0, 0.7):
        want = {tuple(r) for r in align.best(align.combined(secs, WORDS), threshold).collect()}
        assert want and {tuple(r) for r in align.matches(secs, WORDS, threshold).collect()} == want
        monkeypatch.setattr(products.dealt, "__defaults__", (7, None))
        assert {tuple(r) for r in align.matches(secs, WORDS, threshold).collect()} == want
        monkeypatch.undo()
    # All pairs, by definition.
    kw = {(r.pair_id, r.base_seq, r.compare_seq): r.keyword_score for r in align.keyword_pairs(secs, WORDS).collect()}
    every = {(r.pair_id, r.base_seq, r.compare_seq): r for r in align.combined(secs, WORDS).collect()}
    assert kw.items() == {k: r.keyword_score for k, r in every.items() if r.keyword_score > 0}.items()
    sets = {(r[0], r[1], r[2]): {w for w in WORDS if w in f"{r[4]} {r[5]}"} for r in rows}
    for p in "pq":
        for i in range(60):
            for j in range(60):
                a, b = sets[p, "base", i], sets[p, "compare", j]
                assert kw.get((p, i, j), 0.0) == (products.half_up(len(a & b) / len(a | b) * 0.5) if a & b else 0.0)


def test_edges_and_links_of_repeated_texts(spark):
    """Every pair of items that SQL would find, and the same clusters from far fewer links."""
    texts = ["red bolt large", "red bolt large", "blue gear", "", "the", "red bolt small", "red, bolt LARGE!"]
    rows = [(k, "pq"[k % 2], texts[k % 7]) for k in range(600)]
    items = spark.createDataFrame(rows, "item_id long, pair_id string, text string").cache()
    vec = {}
    w = align.tfidf(items, ["pair_id"], ["item_id"]).collect()
    for r in w:
        vec.setdefault((r.pair_id, r.item_id), {})[r.term] = r.w
    want = {}
    for (p, a), x in vec.items():
        for (q, b), y in vec.items():
            if p == q and a < b and (c := round(sum(v * y.get(t, 0.0) for t, v in x.items()), 6)) >= 0.5:
                want[a, b] = c
    got = cluster.edges(items, 0.5, ("pair_id",)).collect()
    assert len(got) == len(want) and {(r.a, r.b) for r in got} == want.keys() and all(abs(r.similarity - want[r.a, r.b]) < 2e-6 for r in got)
    links = cluster.links(items, 0.5, ("pair_id",))
    assert links.count() < 600 and set(components(links).collect()) == set(components(cluster.edges(items, 0.5, ("pair_id",))).collect())


def test_links_of_one_repeated_text(spark):
    # 5 * 10^9 edges, 99,999 links.
    items = spark.range(100000).select(F.col("id").alias("item_id"), F.lit("p").alias("pair_id"), F.lit("red bolt").alias("text"))
    assert cluster.clusters(items, cluster.links(items, corpus=("pair_id",))).filter("cluster_id = 0").count() == 100000


def test_tables_find_their_section_once_a_page(spark):
    # 400 million pairs of a table and a section of its page or of the nearest.
    at = lambda n: spark.range(n).select(F.lit("d").alias("doc_id"), F.col("id"))
    found = at(20000).select("doc_id", F.col("id").alias("seq"), (F.col("id") % 2 * 4 + 1).cast("int").alias("page_num"), F.when(F.col("id") < 9000, "1").otherwise("").alias("number"))
    tables = at(20000).select("doc_id", F.col("id").alias("table_index"), F.when(F.col("id") % 5 < 4, F.col("id") % 5 * 2).cast("int").alias("page_num"))
    got = sections.associate_tables(tables.withColumn("page_num", F.when(F.col("table_index") == 7, 1).otherwise(F.col("page_num"))), found)
    # Page 0 is nearest to 1, 2 to 1, 4 to 5, 6 to 5: the first there. On page 1 itself: the last with a number.
    assert sorted((r.table_page, r.section_seq, r["count"]) for r in got.filter("table_page IS NOT NULL").groupBy("table_page", "section_seq").count().collect()) == [(0, 0, 4000), (1, 8998, 1), (2, 0, 4000), (4, 1, 3999), (6, 1, 4000)]
    assert got.filter("table_page IS NULL AND section_seq IS NULL").count() == 4000


def test_bits_give_shortest_edits_too(monkeypatch):
    rnd = random.Random(5)
    for n in [14] * 300 + [300] * 20:
        a, b = ("".join(rnd.choices(letters, k=rnd.randrange(n))) for letters in ("abcé", "abc😀"))
        found = []
        for cells in (1 << 29, 60, 0):
            monkeypatch.setattr(textdiff, "CELLS", cells)
            ops = textdiff.shortest_edits(a, b)
            assert "".join(t for k, t in ops if k != "insert") == a and "".join(t for k, t in ops if k != "delete") == b
            found.append(sum(len(t) for k, t in ops if k == "equal"))
        assert len(set(found)) == 1


def test_unlike_blocks_take_little_time():
    rnd = random.Random(8)
    a, b = ("".join(rnd.choices("abcdefghijklmnop", k=6000)) for _ in "ab")
    began = time.process_time()
    ops = textdiff.shortest_edits(a, b)
    assert time.process_time() - began < 1 and sum(len(t) for k, t in ops if k != "insert") == 6000


def test_weights_of_repeated_texts(spark):
    """TF-IDF of 30,000 rows from the vectors of three texts, by hand."""
    texts = ["red bolt", "red gear", "the"]
    docs = spark.range(30000).select(F.lit("p").alias("pair_id"), F.col("id").alias("seq"), F.element_at(F.array(*map(F.lit, texts)), (F.col("id") % 3 + 1).cast("int")).alias("text"))
    assert align.grouped(docs, ["pair_id"], ["seq"])[1].count() == 3
    got = {(r.kind, r.term): (r.n, r.w) for r in align.tfidf(docs, ["pair_id"], ["seq"]).groupBy((F.col("seq") % 3).alias("kind"), "term").agg(F.count("*").alias("n"), F.round(F.avg("w"), 6).alias("w")).collect()}
    idf = lambda df: math.log(30001 / (1 + df)) + 1
    common, own = idf(20000), idf(10000)
    norm = math.sqrt(common**2 + 2 * own**2)
    want = {(k, t): (10000, round(w / norm, 6)) for k, other in enumerate(("bolt", "gear")) for t, w in (("red", common), (other, own), (f"red {other}", own))}
    assert got == want
