"""Operators on small literal tables: ties, missing values, properties."""

import math
import random
from collections import Counter

from pyspark.sql import functions as F

from tallyforge.operators import dialogs as D
from tallyforge.operators import documents as B
from tallyforge.operators import matching as M
from tallyforge.operators import retrieval as R
from tallyforge.operators import sales as S
from tallyforge.operators import texts as P
from tallyforge.operators.evaluation import greedy_prototypes
from tallyforge.operators.windows import mode, running_share


def test_mode_takes_the_first_of_equals(spark):
    df = spark.createDataFrame([(1, "b", 0), (1, "a", 1), (1, "a", 3), (1, "b", 2), (2, "c", 0)], "k int, v string, i int")
    assert {r.k: r.m for r in mode(df, ["k"], "v", F.col("i"), "m").collect()} == {1: "b", 2: "c"}


def test_running_share_equals_a_sorted_sum(spark):
    rows = [(i, float((i * 37) % 101)) for i in range(500)]
    out = running_share(spark.createDataFrame(rows, "k int, v double"), "v", "k").collect()
    expected, total = {}, 0.0
    for n, (k, v) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])), 1):
        total += v
        expected[k] = (n, total)
    assert {r.k: (r["rank"], round(r.running, 6)) for r in out} == {k: (n, round(t, 6)) for k, (n, t) in expected.items()}


def test_normalise_keeps_unknown_and_manual_lines(spark):
    lines = spark.sql("""select * from values ('orders', 1, 't', 0, timestamp'2024-01-02', timestamp'2024-01-01', 'money', 10D, 1, 7, 2D, 3D),
        ('orders', 1, 't', 5, timestamp'2024-01-02', timestamp'2024-01-01', 'money', 10D, 2, 0, 2D, 3D), ('orders', 1, 't', 5, timestamp'2024-01-02', timestamp'2024-01-01', 'money', 10D, 3, 9, 2D, null)
        as t(dataset, deal_id, title, client_id, begin, ship, payment, opportunity, line, product_id, price, quantity)""")
    goods = spark.sql("select * from values (7, 'Sign', 4D, 'd', 's') as t(product_id, name, base_price, direction, section)")
    out = {r.line: r for r in S.normalise(lines, goods).collect()}
    assert [out[i].catalog_match for i in (1, 2, 3)] == ["catalog", "manual_row", "missing_catalog"]
    assert out[1].client_key == S.MISSING_CLIENT and out[2].product_key.startswith("manual:") and out[1].price_ratio == 0.5
    fact = S.deal_facts(S.normalise(lines, goods)).first()
    assert fact.duration_days is None and fact.primary_direction == "d" and fact.line_total == 12.0


def test_last_catalogue_row_wins(spark):
    df = spark.createDataFrame([(1, "old", 0), (1, "new", 1)], "product_id int, name string, i int")
    assert S.last_wins(df, "product_id", F.col("i")).first().name == "new"


def test_contained_matches_are_at_least_the_exact_ones(spark):
    deals = spark.createDataFrame([("offers", 1, ["a", "b"]), ("orders", 2, ["a", "b"]), ("orders", 3, ["a", "b", "c"]), ("orders", 4, ["a"]), ("offers", 5, ["z"])], "dataset string, deal_id long, product_keys array<string>")
    deals = deals.select("*", F.array_join("product_keys", "|").alias("bundle_key"), F.lit("t").alias("title"), F.lit(1.0).alias("line_total"))
    out = {r.bundle_key: (r.exact_matches, r.contained_matches) for r in S.template_matches(deals).collect()}
    assert out == {"a|b": (1, 2), "z": (0, 0)}


def test_diversified_slots(spark):
    rows = [(1, i, "a", i) for i in range(1, 7)] + [(1, 9, "b", 8)]
    out = R.diversified(spark.createDataFrame(rows, "query_id long, doc_id long, doc_type string, rank int"), 4, "a", 3, ["b"])
    assert [r.doc_id for r in out.orderBy("slot").collect()] == [1, 2, 3, 9]


def test_dense_search_skips_null_and_zero_vectors(spark):
    docs = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [1.0, 1.0])], "doc_id long, embedding array<double>")
    q = spark.createDataFrame([(10, [2.0, 0.0]), (11, [0.0, 0.0])], "query_id long, embedding array<double>")
    assert [(r.query_id, r.doc_id, r.score) for r in R.dense_top_k(docs, q, 3).orderBy("rank").collect()] == [(10, 1, 1.0), (10, 4, 0.707107)]


def test_greedy_prototypes_take_distinct_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 0), (2, [1.0, 0.01], 0), (3, [0.0, 1.0], 0)], "id long, embedding array<double>, label int")
    assert sorted(r.id for r in greedy_prototypes(df, "label", 0.9, 5).collect()) == [1, 3]


def test_greedy_prototypes_look_past_the_first_block(spark):
    rows = [(i, [1.0, 0.001 * (i % 7), 0.0], 0) for i in range(400)] + [(400, [0.0, 1.0, 0.0], 0), (401, [0.0, 1.0, 0.01], 0), (900, [0.0, 0.0, 1.0], 0), (5, [1.0, 0.0, 0.0], None), (6, None, 1)]
    df = spark.createDataFrame(rows, "id long, embedding array<double>, label int")
    assert sorted(r.id for r in greedy_prototypes(df, "label", 0.9, 3).collect()) == [0, 5, 400, 900]


def test_paragraph_chunks_overlap(spark):
    out = P.paragraph_chunks(spark.createDataFrame([(1, "a" * 6 + "\n" + "b" * 6 + "\n" + "c" * 6), (2, None)], "doc_id long, text string"), 14, 1)
    assert [(r.doc_id, r.body) for r in out.orderBy("doc_id", "chunk").collect()] == [(1, "aaaaaa\nbbbbbb"), (1, "bbbbbb\ncccccc")]


def test_upsert_prefers_new_rows_on_ties(spark):
    old, new = (spark.createDataFrame([(1, v, 5)], "k int, v string, t int") for v in ("old", "new"))
    assert D.upsert(old, new, ["k"], "t").first().v == "new"


def test_request_quantities(spark):
    df = spark.createDataFrame([("letters 40 cm, 3 pcs, budget 15k",), ("3 x 6 m banner, 2 hours",), ("",), (None,)], "t string")
    rows = df.select(*[c.alias(k) for k, c in D.quantities(F.col("t")).items()]).collect()
    assert (rows[0].height_cm, rows[0].pieces, rows[0].budget) == (40.0, 3.0, 15000.0)
    assert (rows[1].area, rows[1].hours) == (18.0, 2.0)
    assert rows[2].height_cm is None and rows[3].budget is None


def test_hashed_embeddings(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "A  b"), (3, ""), (4, None)], "doc_id long, text string")
    out = {r.doc_id: r.embedding for r in B.hashed_embeddings(df, 16).collect()}
    assert out[1] == out[2] and abs(sum(x * x for x in out[1]) - 1) < 1e-6
    assert out[3] == out[4] == [0.0] * 16


def test_forced_documents_move_up_once(spark):
    res = spark.createDataFrame([(1, 10, 0.5), (1, 11, 0.4)], "query_id long, doc_id long, score double")
    out = B.injected(res, spark.createDataFrame([(1, 11), (2, 9)], "query_id long, doc_id long")).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.doc_id, r.score) for r in out] == [(1, 11, 0.51), (1, 10, 0.5), (2, 9, 0.01)]


def test_marker_chunks(spark):
    text = "intro\n# One\n" + "a" * 30 + "\n# Two\nbb\n# Three\n" + "c" * 70
    out = B.marker_chunks(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string"), "^# ", size=50, least=10).orderBy("chunk").collect()
    assert [r.body for r in out] == ["intro", "# One\n" + "a" * 30 + "\n# Two\nbb", ("# Three\n" + "c" * 70)[:50], ("# Three\n" + "c" * 70)[50:]]


def test_profile_documents(spark):
    df = spark.createDataFrame([(7, "d", "d: 100%", "x x1 = 2")], "deal_id long, primary_direction string, direction_breakdown string, components string")
    r = B.profile_documents(df).first()
    assert (r.doc_id, r.searchable_text) == ("deal_profile:7", "direction: d\nshares: d: 100%\nparts: x x1 = 2")


def test_sections_fall_back_to_the_file(spark):
    rows = [(1, 0, "Price list", "p0"), (1, 1, "Terms", "t1"), (1, 2, "price again", "p2"), (2, 0, "Other", "o")]
    out = M.section_fallback(spark.createDataFrame(rows, "doc_id int, chunk int, title string, body string"), "doc_id", {"price": "price", "terms": "terms"})
    assert sorted(map(tuple, out.collect())) == [(1, 0, "Price list", "p0", "t1"), (1, 1, "Terms", "p0", "t1"), (1, 2, "price again", "p2", "t1"), (2, 0, "Other", None, None)]


def test_sparse_search_equals_a_plain_sum(spark, monkeypatch):
    monkeypatch.setattr(R, "QUERY_BLOCK", 4)
    rng = random.Random(2)
    text = lambda n: " ".join(rng.choice("aa bb cc dd ee ff gg hh".split()) for _ in range(n))
    docs, queries = [(i, text(rng.randint(0, 30))) for i in range(90)] + [(90, None)], [(i, text(rng.randint(0, 5))) for i in range(9)] + [(9, None), (10, "zz")]
    words = {i: Counter((t or "").split()) for i, t in docs}
    idf = lambda w: math.log(1 + (len(docs) - (n := sum(w in c for c in words.values())) + 0.5) / (n + 0.5))
    want = []
    for q, t in queries:
        asked = Counter((t or "").split())
        scores = sorted((-round(sum(f * c[w] * idf(w) for w, f in asked.items()), 6), d) for d, c in words.items() if asked.keys() & c.keys())
        want += [(q, d, -s, k) for k, (s, d) in enumerate(scores[:7], 1)]
    got = R.sparse_top_k(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(queries, "query_id long, text string"), 7).collect()
    assert sorted((r.query_id, r.doc_id, round(r.score, 5), r["rank"]) for r in got) == sorted((q, d, round(s, 5), k) for q, d, s, k in want)


def test_weights_count_before_the_best_are_taken(spark):
    rng = random.Random(4)
    docs = [(i, [rng.gauss(0, 1) for _ in range(6)], "rare" if i % 50 == 0 else "hot") for i in range(400)]
    queries = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(5)]
    cos = lambda x, y: round(sum(a * b for a, b in zip(x, y, strict=True)) / math.sqrt(sum(a * a for a in x) * sum(b * b for b in y)), 6)
    weight = {"rare": (1 + 0.15 * math.log10(8)) * 0.85, "hot": 1 + 0.15 * math.log10(392)}
    want = {q: [d for _, d in sorted((-round(cos(v, x) * weight[k], 6), d) for d, x, k in docs)[:4]] for q, v in queries}
    out = R.volume_biased(spark.createDataFrame(docs, "doc_id long, embedding array<double>, label string"), spark.createDataFrame(queries, "query_id long, embedding array<double>"), "label", 4).orderBy("query_id", "rank").collect()
    assert {q: [r.doc_id for r in out if r.query_id == q] for q in want} == want


def test_chunkers_as_table_functions(spark):
    from tallyforge.functions.table_functions import register

    register(spark)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").unionAll(spark.createDataFrame([(-1, None), (-2, "")], "doc_id long, text string"))
    same = lambda sql, df: sorted(map(tuple, spark.sql(sql, docs=docs).collect())) == sorted(map(tuple, df.collect()))
    assert same("select doc_id, c.* from {docs}, lateral paragraph_chunks(text, 300, 1) c", P.paragraph_chunks(docs, 300, 1))
    assert same("select doc_id, c.* from {docs}, lateral marker_chunks(text, '^[A-Z][a-z]+ ') c", B.marker_chunks(docs, "^[A-Z][a-z]+ "))


def test_pairs_are_told_apart_by_their_first_characters(spark):
    from tallyforge.operators.evaluation import distinct_pairs

    rows = [(1, "q" * 200 + "a", "p"), (2, "q" * 200 + "b", "p"), (3, "q", "p" * 199 + "x"), (4, "q", "p" * 199 + "y"), (5, None, None), (6, "", ""), (5, None, None)]
    pairs = spark.createDataFrame(rows, "id int, query string, passage string")
    assert sorted(r.id for r in distinct_pairs(pairs, "query", "passage", ["id"]).collect()) == [1, 3, 4, 5]
    assert distinct_pairs(pairs, "query", "passage", ["id"]).columns == pairs.columns and distinct_pairs(pairs.limit(0), "query", "passage", ["id"]).count() == 0


def test_equal_requests_are_priced_once(spark, monkeypatch):
    """1,000 requests of two amounts are two ranges looked up; missing amounts are kept."""
    from tallyforge.operators import estimates as E

    pools = spark.createDataFrame([("a", 10.0 * i, 10.0 * i + 9, 2.0 + i, 0.9) for i in range(50)], "component string, low double, high double, price double, confidence double")
    asked = spark.createDataFrame([(i, "a", 5.0 if i % 2 else 1000.0) for i in range(1000)] + [(1000, "a", None)], "query_id long, component string, quantity double")
    rows = {}

    def noted(df, name):
        rows[name] = df.count()
        return df

    monkeypatch.setattr(E, "stored", noted)
    out = {r.query_id: (r.total, r.components) for r in E.parametric(asked, pools).collect()}
    assert rows["ranges"] == 3
    assert out == {i: (10.0 if i % 2 else 51000.0, 1) for i in range(1000)} | {1000: (None, 1)}


def test_sparse_search_equals_plain_scores(spark):
    """Batches of many shapes, ties and scores that hardly differ: the same best as by sorting all."""
    import numpy as np

    rng = np.random.default_rng(7)
    k, queries, docs = 5, 13, 400
    s = np.round(rng.integers(0, 6, (docs, queries)) * rng.choice([0.0, 1.0, 1.0000004], (docs, queries)), 7)
    ids = rng.permutation(docs).astype(np.int64)
    best = np.full((queries, k), -np.inf), np.zeros((queries, k), np.int64)
    for at in range(0, docs, 37):
        best = R._merged(*best, s[at : at + 37], ids[at : at + 37])
    for q in range(queries):
        want = sorted(((-np.round(s[i, q], 6), ids[i]) for i in range(docs) if s[i, q] > 0))[:k]
        assert list(zip(-best[0][q], best[1][q], strict=True)) == want
