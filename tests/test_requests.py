"""Requests, quotes and wider facts on literal rows."""

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import intents as I
from tallyforge.functions import quotes as Q
from tallyforge.operators import requests as R


def _each(spark, column, *texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").coalesce(1)
    return [r.x for r in rows.select("i", column(F.col("t")).alias("x")).orderBy("i").collect()]


#: For each rule texts that it takes, with what they are after; then texts that exceptions take away from it.
ASKED = [
    ("Вы делаете вывески", "consultation"), ("А у вас есть баннеры?", "consultation"), ("Вы делаете вывески? Сколько стоит", "general"),
    ("Какой у вас режим работы", "out_of_scope"), ("Где вы находитесь", "out_of_scope"),
    ("Оплата по безналу", "financial_modifier"), ("цена с НДС", "financial_modifier"), ("скидка 10 %", "financial_modifier"),
    ("Сделайте визуализацию", "visualization"), ("как это будет выглядеть на фасаде", "visualization"),
    ("дай смету", "empty_context_smeta"), ("Составь смету на эту услугу", "empty_context_smeta"), ("составь смету на эту вывеску", "referential"),
    ("как в прошлый раз заказ", "referential"), ("для этого клиента", "referential"),
    ("почему у вас дороже", "objection_arguments"), ("почему цена на баннер выше", "product_query"), ("почему цена выше", "objection_arguments"),
    ("какие вопросы задать", "discovery_assist"), ("что спросить у клиента", "discovery_assist"),
    ("делаете ли стелы", "category_clarify"), ("делаете ли стелы? сколько за одну", "product_query"), ("делаете ли окна? сколько за одно", "general"), ("делаете ли наборы косметики", "category_clarify"),
    ("покажи примеры", "historical_request"), ("похожие сделки", "historical_request"),
    ("клиент сомневается", "describe"), ("нужен скрипт", "describe"),
    ("вывеска под ключ", "bundle_query"), ("что входит в стоимость", "bundle_query"), ("всё для открытия кафе", "bundle_query"),
    ("нужен логотип", "product_query"), ("разработка фирменного стиля", "product_query"),
    ("вывеска 3 метра", "general"), ("", "underspec"), ("  \n", "underspec"), (None, "underspec"),
]


def test_every_rule_of_intents(spark):
    got = _each(spark, lambda t: R.request_intent(t, F.lit(False))["intent"], *[t for t, _ in ASKED])
    assert got == [i for _, i in ASKED]
    assert {r.intent for r in I.RULES} <= set(got)
    later = _each(spark, lambda t: R.request_intent(t, F.lit(True)), "для этого клиента", "почему цена на баннер выше", "делаете ли стелы", "для этого клиента под ключ", "x")
    assert [(r.intent, r.confidence, r.source) for r in later] == [("general", 0.3, "default"), ("product_query", 0.85, "regex_hybrid"), ("category_clarify", 0.9, "regex"), ("bundle_query", 0.85, "regex"), ("general", 0.3, "default")]
    assert _each(spark, lambda t: R.request_intent(t, F.lit(None).cast("boolean"))["intent"], "для этого клиента") == ["referential"]


def test_every_pattern_is_valid_and_every_stem_found(spark):
    row = spark.range(1)
    for r in I.RULES:
        for p in r.patterns:
            assert row.select(F.lit("x").rlike(f"(?iuU){p}").alias("x")).first().x is False
    assert _each(spark, lambda t: F.size(R.stems_in(t)), " ".join(I.STEMS), "", None) == [len(I.STEMS), 0, 0]
    assert _each(spark, R.stems_in, "Буклет и БАННЕР") == [["буклет", "баннер"]]


def test_collisions_drop_what_the_request_does_not_mean(spark):
    rows = [
        (1, "буклеты А4", "листовки"), (1, "буклеты А4", "листовки и буклеты"), (1, "буклеты А4", "прочее"), (1, "буклеты А4", None),
        (2, "буклеты", "листовка"), (2, "буклеты", "флаер"),
        (3, "вывеска", "листовка"), (4, None, "листовка"), (5, "каталог и буклет", "буклет"), (5, "каталог и буклет", "флаер"), (6, "каталог", "буклет"), (6, "каталог", "x"),
    ]
    df = spark.createDataFrame(rows, "query_id int, request string, doc string")
    got = {(r.query_id, r.doc) for r in R.without_collisions(df, "request", "doc", ["query_id"]).collect()}
    gone = {(1, "листовки"), (5, "флаер"), (6, "буклет")}
    assert got == {(q, d) for q, _, d in rows} - gone
    assert R.without_collisions(df.limit(0), "request", "doc", ["query_id"]).count() == 0


def test_collisions_leave_texts_behind_before_requests_meet(spark):
    """What is shuffled says whether a row fits; texts are read where they lie."""
    df = spark.createDataFrame([(1, 7, "буклеты", "листовки")], "query_id int, doc_id int, request string, doc string")
    plan = R.without_collisions(df, "request", "doc", ["query_id"]).select("query_id", "doc_id")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Window") < plan.index("lower(") and plan.count("lower(") == 2


def test_strategies_choose_kinds_and_numbers(spark):
    assert _each(spark, lambda t: R.strategy(t, 20)["k"], *I.STRATEGIES, "other", None) == [k for _, k in I.STRATEGIES.values()] + [20, 20]
    assert _each(spark, lambda t: R.strategy(t, 10)["k"], "smeta_request", "out_of_scope") == [10, 5]
    schema = "query_id int, intent string, height_cm int, doc_id int, doc_type string, letter_height_cm int, score double"
    rows = [(1, "out_of_scope", None, i, "faq" if i % 2 else "bundle", None, 1.0) for i in range(40)]
    rows += [(2, "smeta_request", 100, i, "bundle", h, 0.5) for i, h in enumerate((70, 69, 130, 131, None))] + [(3, "smeta_request", 0, 1, "bundle", 5, 0.1), (4, None, 100, 1, "any", None, 0.1)]
    got = R.by_strategy(spark.createDataFrame(rows, schema), 20).collect()
    assert sorted(r.doc_id for r in got if r.query_id == 1) == list(range(1, 20, 2))
    assert sorted(r.doc_id for r in got if r.query_id == 2) == [0, 2]
    assert [r.query_id for r in got if r.query_id > 2] == [3, 4]


def test_lessons_are_boosted_and_counted(spark):
    s = "query_id bigint, doc_id bigint, score double"
    best = spark.createDataFrame([(1, 1, 0.6), (1, 2, 0.55), (1, 3, 0.5), (2, 9, 0.44)], s)
    same = spark.createDataFrame([(1, 3, 0.5), (1, 4, 0.46), (1, 5, 0.3)], s)
    got = R.boosted_lessons(best, same)
    assert [(r.query_id, r.doc_id, r.score) for r in got.orderBy("rank").collect()] == [(1, 1, 0.6), (1, 3, 0.6), (1, 4, 0.56)]
    lessons = spark.createDataFrame([(1, 5), (2, None), (3, None)], "doc_id bigint, match_count int")
    counted = R.with_match_counts(lessons, got.select("doc_id").union(got.select("doc_id")))
    assert sorted(map(tuple, counted.collect())) == [(1, 7), (2, 0), (3, 2)]


def test_price_lists_and_ranges(spark):
    assert _each(spark, Q.price_list, "от 5 000 руб до 12 500 ₽, 99 руб, 5000 р.", "1.200 руб, 350р", "нет", None) == [[5000, 12500], [350, 1200], [], []]
    got = _each(spark, Q.price_range, "от 5 000–7 500 руб", "9 000 - 1 000 ₽", "итого 14 030 рублей и 100 руб", "без цен", None)
    assert [(r.low, r.high) for r in got] == [(5000, 7500), (1000, 1000), (14030, 14030), (None, None), (None, None)]


def test_packages(spark):
    got = _each(spark, Q.package_prices, "«Старт» (27 500 – 48 500 руб.), «Макс» 90 000 руб", "от 5 000 – 6 000 рублей или 2 руб, 50 руб, 700 руб", "", None)
    assert [[tuple(r) for r in x] for x in got] == [[("Старт", 27500, 48500), ("Макс", 90000, 90000)], [("", 5000, 6000), ("", 700, 700)], [], []]


def test_returns(spark):
    got = _each(spark, Q.returns, "ROMI от 200%, ROMI ~550 %; ROI 30%; конверсия сайта до 2,5%, CR 4%", "romi составляет 100%", "x", None)
    assert [tuple(r) for r in got] == [(200, 550, 30, 30, 2.5, 4.0), (100, 100, None, None, None, None), (None,) * 6, (None,) * 6]


@pytest.mark.parametrize(
    ("column", "texts", "expected"),
    [
        (Q.unit_of, ("лента мп", "плёнка кв.м", "м2", "компл", "импорт", None), ["мп", "кв.м", "кв.м", "компл", "шт", "шт"]),
        (Q.loose_unit_of, ("импорт", "кв. м", "погонаж", "комплект", "набор шт", None), ["мп", "кв.м", "мп", "мп", "шт", "шт"]),
        (Q.section_of, ("ЦЕХ 1", "Фабрика", "печатка", "иное", "", None), ["Цех", "РИК", "Печатная", "иное", "", ""]),
    ],
)
def test_units_and_sections(spark, column, texts, expected):
    assert _each(spark, column, *texts) == expected


def test_parents_enums_and_benefits(spark):
    row = spark.createDataFrame([("Буквы", "Мерч"), ("Буквы", ""), ("Иное", "Склад"), (None, None)], "p string, d string")
    assert [r.x for r in row.select(Q.parent_section(F.col("p"), F.col("d")).alias("x")).collect()] == ["Мерч", "Цех", "Склад", "Цех"]
    ids = spark.createDataFrame([([108, 110],), ([999, None],), ([],), (None,)], "i array<long>")
    assert [r.x for r in ids.select(Q.decoded(F.col("i"), Q.DIRECTIONS).alias("x")).collect()] == ["Печатка, Цех", "999", "", ""]
    t = spark.createDataFrame([("  Хорошая длинная польза ", "Цех"), ("mostly latin text", "Офсет"), ("кор.", "Мерч"), (None, "x"), ("1234567890", "РИК")], "t string, d string")
    assert [r.x for r in t.select(Q.benefit(F.col("t"), F.col("d")).alias("x")).collect()] == ["Хорошая длинная польза", Q.BENEFITS["Печатная"], Q.BENEFITS["Мерч"], "", "1234567890"]


def test_presentable_texts(spark):
    text = "<think>a\nb</think>Визитки <b>важны</b> 中文\n\n\n\nimport os\nall of this line is latin\nvisitors cards / визитки (cards)\nok\nLED баннер item"
    clean = lambda t: Q.presentable(t, {"LED": "светодиодный", "LE": "x"}, ("item",))
    assert _each(spark, clean, text, "", None) == ["Визитки важны \n\nвизитки \nok\nсветодиодный баннер", "", ""]


def test_roadmaps(spark):
    from tallyforge.operators.texts import roadmap_chunks

    text = "# **Дорожная карта услуги: Вывески**\n* **Категория:** Реклама\\\n* **Услуга:** Вывески\n\nпролог\n## **1\\. Шаг**\n" + "а" * 50 + "\n# ещё заголовок\n### мелкий\n## Короткий\nмало\n## Конец\n" + "б" * 60
    docs = spark.createDataFrame([("a.md", text), ("b.md", "без разделов " + "в" * 50), ("c.md", "мало"), ("d.md", None), ("e.md", "## Пустой\n\n" + " " * 80)], "file string, text string")
    got = sorted((r.file, r.chunk, r.title, r.section, r.category, r.service, r.body) for r in roadmap_chunks(docs, "file", "text").collect())
    assert got == [
        ("a.md", 0, "Вывески", "1. Шаг", "Реклама", "Вывески", "а" * 50 + "\n### мелкий"),
        ("a.md", 1, "Вывески", "Конец", "Реклама", "Вывески", "б" * 60),
        ("b.md", 0, "b", "Полный документ", None, None, "без разделов " + "в" * 50),
    ]


def test_roadmap_texts_are_cut_once(spark):
    """Each expression over the text stands once in the plan; white space of all kinds is cut from the ends."""
    from tallyforge.operators.texts import WHITE, roadmap_chunks

    docs = spark.createDataFrame([("a.md", "## 1\n" + WHITE + "а" * 50 + WHITE), ("b.md", WHITE + "b" * 50 + WHITE)], "file string, text string")
    out = roadmap_chunks(docs, "file", "text")
    assert sorted(r.body for r in out.collect()) == ["b" * 50, "а" * 50]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("\\n(?=##") == 1 and plan.count("transform(") == 1
    every = spark.createDataFrame([(chr(i),) for i in range(1, 0x10000) if not 0xD800 <= i < 0xE000], "c string")
    assert {r.c for r in every.filter(F.col("c").rlike(r"(?U)^\s$")).collect()} == set(WHITE)


def test_wider_deals(spark):
    from tallyforge.operators.fact_details import deal_details

    lines = [("orders", 1, n, h) for n, h in enumerate(["буквы 30 см", "x", "буквы 30 см", "a 40 см", "b 40 см", None, "c", "d", "e"])] + [("orders", 2, 0, "y"), ("offers", 3, 0, None)]
    deals = [("orders", 1, "t 90 см", "7"), ("orders", 2, "вывеска 90 см", "__MISSING_CLIENT__"), ("offers", 3, None, "8")]
    df = spark.createDataFrame(lines, "dataset string, deal_id long, line int, product_name string")
    ds = spark.createDataFrame(deals, "dataset string, deal_id long, title string, client_key string").withColumn("close", F.lit("2024-05-06").cast("timestamp"))
    got = {r.deal_id: (r.client_status, r.close_year, r.letter_height_cm, r.sample_products) for r in deal_details(df, ds).collect()}
    assert got == {1: ("known", 2024, 30, "буквы 30 см | x | a 40 см | b 40 см | c"), 2: ("missing", 2024, 90, "y"), 3: ("known", 2024, None, "")}
    assert deal_details(df.limit(0), ds.limit(0)).count() == 0
