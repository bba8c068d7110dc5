"""Functions on literals, Cyrillic ones among them."""

from pyspark.sql import functions as F

from tallyforge.functions import numeric as N
from tallyforge.functions import text as X
from tallyforge.functions.dates import duration_days, freshness


def one(spark, value, *args):
    names = [f"x{i}" for i in range(len(args))]
    df = spark.createDataFrame([args], ", ".join(f"{n} string" for n in names)) if args else spark.range(1)
    return df.select(value(*[F.col(n) for n in names]).alias("v")).first().v


def test_numbers(spark):
    rows = [(" 1 250,5", None), ("12,5", 12.5), ("", None), (None, None), ("abc", None), ("NaN", None), ("Infinity", None), ("-3", -3.0)]
    df = spark.createDataFrame([(a,) for a, _ in rows], "a string")
    assert [r.v for r in df.select(N.number(F.col("a")).alias("v")).collect()] == [b for _, b in rows]


def test_roundings(spark):
    df = spark.createDataFrame([(2.5, -2.5, 0.125)], "a double, b double, c double")
    r = df.select(N.round_half_up(F.col("a")).alias("a"), N.round_half_up(F.col("b")).alias("b"), N.round_bankers(F.col("a")).alias("c"), N.round_money(F.col("c")).alias("d")).first()
    assert (r.a, r.b, r.c, r.d) == (3.0, -2.0, 2.0, 0.13)


def test_quantile_variants(spark):
    df = spark.createDataFrame([([4.0, 1.0, 3.0, 2.0],), ([],)], "v array<double>")
    assert [r.v for r in df.select(N.nth_quantile(F.col("v"), 0.5).alias("v")).collect()] == [3.0, None]
    assert [round(r.v, 4) for r in df.select(N.harmonic_mean(F.col("v")).alias("v")).collect()] == [1.92, 0.0]


def test_cyrillic(spark):
    assert one(spark, X.slug, "Щит «Ёлка» 3м") == "schit_yolka_3m"
    assert one(spark, X.plain_name, "Ёлка-№5") == "елка 5"
    assert one(spark, X.tokens, "Вывеска, вывеска и 5мм") == ["вывеска", "5мм"]
    assert one(spark, lambda a: X.script_share(a, r"\p{IsCyrillic}"), "абв abc") == 0.5


def test_similarity(spark):
    f = lambda a, b: F.round(X.fuzzy(X.tokens(a), X.tokens(b)), 4)
    assert one(spark, f, "big red sign", "red sign") == round(0.7 * 2 / 3 + 0.3, 4)
    assert one(spark, lambda a, b: X.overlap(X.tokens(a), X.tokens(b)), "aa bb", "cc") == 0.0


def test_cleaning(spark):
    assert one(spark, X.strip_markup, "[b]Hi[/b]  there [url=x]y[/url]") == "Hi there y"
    assert one(spark, X.strip_markdown, "# Title\n**bold** [a](http://x) ![i](y)") == "Title\nbold a"
    assert one(spark, lambda a: X.labelled_field(a, "Price"), "Name: x\nprice: 12 EUR\n") == "12 EUR"
    assert one(spark, lambda a: X.sentences_without(a, "never"), "Good. It will never fail! Bye.") == "Good. Bye."
    assert one(spark, lambda a: X.numbers_in(a, r"([0-9][0-9 ]*(?:,[0-9]+)?) EUR"), "1 200,50 EUR or 30 EUR") == [1200.5, 30.0]


def test_rules_take_the_first(spark):
    rule = lambda a: X.first_rule([(X.term_rule(a, all_of=("sign",), none_of=("road",)), "sign"), (X.term_rule(a, any_of=("road", "way")), "road")], "other")
    assert [one(spark, rule, t) for t in ("A Sign", "Road sign", "x")] == ["sign", "road", "other"]


def test_dates(spark):
    df = spark.sql("select timestamp'2024-01-01 00:00' a, timestamp'2024-01-02 12:00' b, cast(null as date) n, date'2023-01-01' d")
    r = df.select(duration_days(F.col("a"), F.col("b")).alias("x"), duration_days(F.col("b"), F.col("a")).alias("y"), freshness(F.col("n"), "2024-01-01").alias("n"), freshness(F.col("d"), "2024-01-01").alias("d")).first()
    assert (r.x, r.y, r.n, r.d) == (2, None, 0.5, 0.5)


def test_order_by_locale_and_numbers(spark):
    rows = spark.createDataFrame([(x,) for x in ["id 10", "id 2", "ID 09", "id", "9", "10", "x1y02", "x1y1", None, "99999999999999999999999"]], "s string")
    assert [r.s for r in rows.orderBy(X.natural_key(F.col("s"))).collect()] == [None, "9", "10", "99999999999999999999999", "id", "id 2", "ID 09", "id 10", "x1y1", "x1y02"]
    names = spark.createDataFrame([(x,) for x in ["zebra", "Äpfel", "apfel", "Zoo", "éclair", "ель", "ёлка", "Ёж"]], "s string")
    assert [r.s for r in names.orderBy(X.in_locale(F.col("s"), "UNICODE", "CI_AI")).collect()][:2] in (["Äpfel", "apfel"], ["apfel", "Äpfel"])
    assert [r.s for r in names.orderBy(X.in_locale(F.col("s"), "ru")).collect()][:3] == ["Ёж", "ёлка", "ель"]
    assert names.groupBy(X.in_locale(F.col("s"), "UNICODE", "CI_AI").alias("k")).count().filter("count = 2").count() == 1


def test_folded_names(spark):
    rows = spark.createDataFrame([(x,) for x in ["Ёлка  «Большая»", "Ａｂｃ ﬁ №5", "STRASSE straße", "Café-Crème", "", None, "---"]], "s string")
    assert [r[0] for r in rows.select(X.folded_name("s")).collect()] == ["елка большая", "abc fi no5", "strasse strasse", "cafe creme", "", "", ""]
