"""Taxonomy operators on literal texts, and the pipeline as one call."""

import random

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import rules as R
from tallyforge.operators import estimates as E
from tallyforge.operators import matching as M
from tallyforge.operators import sales as S
from tallyforge.operators import taxonomy as X
from tallyforge.pipeline import Pipeline
from tallyforge.sources.roles import catalogue, lines

SF = "/root/testdata/sf0.001"


def _each(spark, column, *texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").coalesce(1)
    return [r.x for r in rows.select("i", column(F.col("t")).alias("x")).orderBy("i").collect()]


def test_materials_and_heights(spark):
    assert _each(spark, X.materials, "Вывеска ПВХ, акрил и LED", "фанера / металл", "следы", None) == [["ПВХ", "Акрил", "LED"], ["Металл", "Дерево/МДФ"], [], []]
    assert _each(spark, X.heights, "буквы 30 см, 450 мм и 1,5 м", "5 см 300 см 12 cmx", "0.7m", None) == [[30, 45, 150], [], [70], []]
    rows = spark.createDataFrame([(1, "30 см", 0), (1, "40 см", 1), (1, "40см", 2), (2, "нет", 0)], "k int, t string, o int")
    more = spark.createDataFrame([(1, "90 см"), (2, "90 см")], "k int, t string")
    assert sorted(map(tuple, X.height_modes(rows, ["k"], "t", "o", more).collect())) == [(1, 40), (2, 90)]


def test_category_keys_and_names(spark):
    keys = ["«Ромашка» Объёмные буквы ПВХ5 30 см", "Титульная вывеска, оргстекло", "Вывеска", "Some long title here", "", None]
    assert _each(spark, X.category_key, *keys) == ["объёмные буквы", "титульная вывеска", "вывеска", "some long", "", ""]
    assert _each(spark, X.component_name, "Баннер 10-50 м² более 100  шт", None) == ["Баннер шт", ""]


def test_subcategories(spark):
    assert _each(spark, X.query_subcategory, "нужны визитки", "буклет и листовка", "буклеты или брошюры", "кафе", "меню") == ["visitka", None, "buklet", None, "menu"]
    row = spark.createDataFrame([(["a", "b"], "Кружка", "текст"), ([], "Кружка", "визитка"), ([], "x", "y" * 490 + " визитка"), ([], "x", "y" * 500 + " визитка"), (None, None, None)], "ids array<string>, n string, t string")
    got = row.select(X.subcategory(F.col("ids"), F.col("n"), F.col("t"), {"b": "poster"}).alias("x")).collect()
    assert [r.x for r in got] == ["poster", "merch_mug", "visitka", None, None]


def test_slugs_links_and_words(spark):
    assert _each(spark, X.candidate_slugs, "Визитки матовые 90х50 мм. Полиграфия", "Буклет", "") == [["vizitki_matovye_90h50_mm", "vizitki", "vizitki_matovye", "vizitki_matovye_90h50_mm_poligrafiya"], ["buklet"], []]
    link = lambda t: X.linkified(X.linkified(t, "https://x.y/$d/%s/"), "https://x.y/$d/%s/")
    texts = ["КП № 68312, сделка #123 и #4567", "[КП #1234](https://x.y/1) https://a.b/#5678", "a#12345 #123 #0000", None]
    assert _each(spark, link, *texts) == ["[КП #68312](https://x.y/$d/68312/), [сделка #123](https://x.y/$d/123/) и [#4567](https://x.y/$d/4567/)", texts[1], texts[2], None]
    assert _each(spark, lambda t: X.earliest(t, {"a": "alpha", "b": "beta", "c": "alp"}), "beta alpha", "alpha beta", "none", None) == ["b", "a", None, None]


def test_coerced_answers(spark):
    texts = ['{"estimated_price": 5, "price_band": [1, "2"], "estimated_lead_time": 3.7}', '{"estimated_price": "1 200,5", "price_band": 7, "estimated_lead_time": {"value": "soon"}}', '{"estimated_price": {"value": 3}, "price_band": {"min": 1}, "estimated_lead_time": {"x": 1}}', '{"price_band": [1, 2, 3], "estimated_lead_time": [1]}', "nonsense", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").coalesce(1)
    got = rows.select("i", *[c.alias(k) for k, c in X.coerced(F.col("t"), " d").items()]).orderBy("i").collect()
    plain = [tuple(tuple(x) if x is not None and not isinstance(x, str) else x for x in r[1:]) for r in got]
    assert plain == [((5.0, ""), (1.0, 2.0), "3 d"), ((1200.5, ""), (7.0, 7.0), "soon"), ((3.0, None), (1.0, None), None), (None, None, None), (None, None, None), (None, None, None)]
    assert _each(spark, lambda t: X.lead_time(F.lit(""), t, t != "логотип!"), "Логотип и визитки", "логотип!", "нечто") == ["3-5 рабочих дней", None, None]


def test_modifiers(spark):
    names = ["Скидка 5", "Безналичный расчёт", "Налог", "комиссия банка", "10 %", "процент", "Discount", "Вывеска", None]
    assert _each(spark, S.is_modifier, *names) == [True] * 7 + [False, False]


def test_materials_of_deals(spark):
    rows = [("orders", d, i, name, 1.0, 400.0, "signs") for d, names in ((1, ["Баннер", "ПВХ 3-5 мм", "пвх"]), (2, ["акрил", "лампа"]), (3, ["ПВХ", "лампа"])) for i, name in enumerate(names)]
    lines_ = spark.createDataFrame(rows, "dataset string, deal_id long, line int, product_name string, quantity double, line_total double, direction string")
    deals = spark.createDataFrame([("orders", d, 2, 800.0, "money", "signs") for d in (1, 2, 3)], "dataset string, deal_id long, unique_products long, line_total double, payment string, primary_direction string")
    assert {r.deal_id: r.materials for r in S.deal_profiles(lines_, deals).collect()} == {1: "ПВХ, Баннер", 2: "Акрил", 3: "ПВХ"}
    assert S.service_composition(lines_, deals).first().top_materials == "ПВХ (67%), Акрил (33%), Баннер (33%)"


def test_users_and_messages(spark):
    users = spark.createDataFrame([(1, "ann", "active")], "user_id int, username string, status string")
    new = spark.createDataFrame([(3, "bob"), (2, "bob"), (4, "ann")], "user_id int, username string")
    every = X.registered(users, new)
    assert sorted(map(tuple, every.collect())) == [(1, "ann", "active"), (2, "bob", "pending")]
    said = spark.createDataFrame([(2, "approved", 1), (2, "rejected", 2)], "user_id int, status string, at int")
    assert sorted(map(tuple, X.with_status(every, said).select("user_id", "status").collect())) == [(1, "active"), (2, "rejected")]
    rated = spark.createDataFrame([("u", 1), ("u", -1), ("u", 0), ("u", 1), ("v", None)], "who string, rating int")
    assert list(map(tuple, X.satisfaction(rated, "who").collect())) == [("u", 3, 2, 0.6667)]


def test_bridges_report_what_they_cannot_resolve(spark):
    services = spark.sql("select 'Big Signs' as service, 'signs' as direction, array(named_struct('name', 'base', 'offer_ids', array(3, 1), 'products', array('red sign large', 'unknown')), named_struct('name', null, 'offer_ids', array(1), 'products', cast(array() as array<string>))) as packages")
    goods = spark.createDataFrame([(7, "red sign"), (8, "blue sign small")], "product_id long, name string")
    docs, missing = X.bridges(services, goods)
    d = docs.first()
    assert (d.doc_id, d.offer_ids, d.product_ids, d.wanted, d.resolved) == ("bridge_big_signs", [1, 3], [7], 2, 1)
    assert list(map(tuple, missing.collect())) == [("Big Signs", "base", "unknown")]


def _slugs(n, rng):
    pool = ["ab", "abc", "sign", "banner", "led", "box", "wow", "x", "poster"]
    return ["_".join(rng.choice(pool) for _ in range(rng.randint(1, 4))) + rng.choice(["", "s", "_1", "q"]) for _ in range(n)]


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_slugs_match_as_if_all_pairs_were_compared(spark):
    rng = random.Random(3)
    left, right = list(enumerate(_slugs(120, rng))), list(enumerate(_slugs(60, rng)))
    want = {}
    for i, a in left:
        best = None
        for o, b in right:
            n, m = len(a), len(b)
            score, small, big = 1 - _distance(a, b) / max(n, m), min(n, m), max(n, m)
            kind = 0 if a == b else 1 if (a in b or b in a) and small >= 4 and small >= 0.4 * big else 2 if score >= 0.55 else None
            if kind is not None:
                value = round(1.0 if kind == 0 else min(score + 0.2, 1.0) if kind == 1 else score, 4)
                best = min(best or (9,), (kind, -value, o))
        if best:
            want[i] = best
    got = E.slug_matches(spark.createDataFrame(left, "id int, slug string"), spark.createDataFrame(right, "other int, slug2 string")).collect()
    assert {r.id: (r.kind, -r.score, r.other) for r in got} == want


def test_names_without_a_common_token_are_compared(spark):
    left = spark.createDataFrame([(1, ["signboards"]), (2, ["red", "box"])], "id int, t array<string>")
    right = spark.createDataFrame([(1, ["signboard"]), (2, ["box", "red"]), (3, ["zzz"])], "other int, u array<string>")
    assert sorted((r.id, r.other) for r in M.ratio_links(left, right, 76, 3).collect()) == [(1, 1), (2, 2)]


def test_pipeline_writes_each_table_once(spark, tmp_path):
    p = Pipeline(lines(spark, SF), catalogue(spark, SF), f"file://{tmp_path}")
    made = p.run("all")
    assert set(made) == {n for s in p.SCOPES.values() for n in s} and all(t.count() > 0 for n, t in made.items() if n != "quality_issues")
    assert sorted(map(str, made["kpi_summary"].collect())) == sorted(map(str, S.kpi_summary(made["product_facts"], made["deal_facts"], made["template_matches"]).collect()))
    index = p.index()
    assert {r.doc_type for r in index.select("doc_type").distinct().collect()} == {"product", "bundle", "deal_profile"}
    assert index.count() == p.documents().count()
    with pytest.raises(ValueError):
        p.run("none")


#: A title of each category in order, and others that look like one.
TITLES = """неон на стену|буквы объёмные|титульная вывеска|световой короб|панель - кронштейн|штендер|3 флага и флаги|оклейка авто|щит рекламный|вывеска с подсветкой
табличка с аппликацией|гравировка таблички|табличка из оргстекла|табличка на бумаге|табличка|печать: холст|стенд настенный|стенд мобильный|менюхолдер|стойка|press-wall|световая панель|стенд
визитка|листовки|флайер|брошюра|буклет|открытка|календарь|ежедневник|блокнот|бейдж|бланки|папка а4|планшет|пакет крафтовый|пакет пвд|пакет-майка|пакет|меню кафе|стикер|карточки пластиковые|скотч
баннер|постер|web-design|моделирование|упаковка|дизайн и макет|полиграфия|логотип, бриф|brand book|логотип|стиль фирмы|иллюстрация|презентация|фотосессия|лендинг|smm
кружка|термос|бутылка|ручка|футболка|кепка|шоппер|худи|powerbank|магнит|шоколад""".replace("\n", "|").split("|")


def test_every_category_has_a_title(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(TITLES)], "i int, t string").select("i", X.title_category(F.col("t")).alias("c")).orderBy("i").collect()
    assert [(r.c and (r.c.parent, r.c.name)) for r in rows] == [(p, n) for p, n, *_ in R.CATEGORIES]


def test_titles_that_are_in_no_category(spark):
    want = {"вывеска": None, "ручка с логотипом": "Ручки", "авторучка": None, "титульная вывеска, логотип": None, "субменю": None, "": None, None: None, "НЕОН": "Неоновые вывески", "флагман": None}
    rows = spark.createDataFrame([(t,) for t in want], "t string").select("t", X.title_category(F.col("t"))["name"].alias("c")).collect()
    assert {r.t: r.c for r in rows} == want


#: A text of each row of the tables of subcategories and lead times, in order.
SUBS = "брошюры|листовок|визитки|этикетка|календарь|каталоги|афиша|наше меню|объёмные буквы|световой короб|неоновый|брандмауэр|баннер|стопер|табличка|поло|термокружка|бейсболок|ручек|usb|шопер|айдентика|фирменный стиль".split("|")
LEADS = "брендбук|логотип|светова вывеска|стенды|широкоформатная|визиток|флаеры|меню|плёнка|сувениры|упаковок".split("|")


def test_every_row_of_the_pattern_tables(spark):
    def first(table, texts):
        rule = F.coalesce(*[F.when(F.lower("t").rlike(f"(?iu){p}"), F.lit(i)) for i, (p, _) in enumerate(table)])
        return [r.x for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", rule.alias("x")).orderBy("i").collect()]

    assert first(R.SUBCATEGORIES, SUBS) == list(range(len(R.SUBCATEGORIES)))
    assert first(R.LEAD_TIMES, LEADS) == list(range(len(R.LEAD_TIMES)))
    assert first(R.SUBCATEGORIES, ["полотно", "авторучки", "usbx", "субменю", "футболоком"]) == [None] * 5


def test_slugs_that_begin_alike_meet_few(spark):
    """Of 3,000 x 400 slugs of one beginning, nearly all of which are near enough, few pairs are compared."""
    from tests.test_similarity import _join_rows

    a = spark.range(3000).select("id", F.concat(F.lit("customer_"), (F.col("id") * 7919 % 100003).cast("string")).alias("slug"))
    b = spark.range(400).select(F.col("id").alias("other"), F.concat(F.lit("customer_"), (F.col("id") * 104729 % 100003).cast("string")).alias("slug2"))
    for x, y, s, t in ((a, b, "slug", "slug2"), (b, a, "slug2", "slug")):
        held = E._containing(x, y, s, t, 0.4, 4)
        held.collect()
        assert max(_join_rows(held)) <= 4000
    near = E.within_edits(a, b, "slug", "slug2", 1, 9)
    assert near.count() == a.crossJoin(b).filter(F.levenshtein("slug", "slug2") <= 1).count()
    near.collect()
    assert max(_join_rows(near)) <= 40_000  # all pairs are 1.2 million
