"""Word lists and rule tables of the sign and print trade. All are fixed values: results depend on them
letter by letter. Functions that use them take other tables as parameters. Patterns are read without
regard to case; ``unicode_pattern`` reads their words and boundaries for every script."""

import re

#: Materials by the stems that name them (fixed values).
MATERIALS = {
    "ПВХ": "пвх",
    "Акрил": "акрил",
    "LED": "led|лед(?:[^\\p{L}\\p{N}_]|$)|светодиод",
    "Неон": "неон",
    "Композит": "композит",
    "Пленка": "плёнк|пленк",
    "Баннер": "баннер",
    "Алюминий": "алюмин",
    "Металл": "оцинков|металл",
    "Стекло": "стекл|оргстекл",
    "Винил": "винил",
    "Полистирол": "полистирол",
    "Пенопласт": "пенопласт|пеноплекс",
    "Дерево/МДФ": "дерев|фанер|мдф",
    "Текстиль": "текстил|ткан",
    "Магнит": "магнит",
}

#: Heads of category names (fixed values).
HEADS = (
    "вывеска", "вывески", "буква", "буквы", "табличка", "таблички", "штендер", "штендеры", "стенд", "стенды", "логотип", "логотипы", "табло", "лайтбокс", "панель", "панели",
    "листовка", "листовки", "визитка", "визитки", "каталог", "каталоги", "флаер", "флаеры", "флайер", "флайеры", "буклет", "буклеты", "брошюра", "брошюры", "открытка", "открытки",
    "календарь", "календари", "плакат", "плакаты", "постер", "постеры", "брендбук", "меню", "афиша", "афиши", "наклейка", "наклейки", "стикер", "стикеры", "этикетка", "этикетки",
    "ценник", "ценники", "бирка", "бирки", "конверт", "конверты", "папка", "папки", "блокнот", "блокноты", "ежедневник", "ежедневники",
    "баннер", "баннеры", "плёнка", "пленка", "плёнки", "пленки", "окл", "оклейка", "постамент", "футболка", "футболки", "кружка", "кружки", "ручка", "ручки", "значок", "значки",
    "монтаж", "дизайн", "дизайн-макет", "макет", "макеты", "визуализация", "подготовка", "сборка", "печать", "доставка",
)

def unicode_pattern(pattern: str) -> str:
    r"""A pattern whose word characters and boundaries count letters and digits of every script.

    ``\w`` becomes a class; ``\b`` before a word is "no word character before", after one "none after".
    """
    out = pattern.replace(r"\w", "[" + _WORD + "]")
    out = re.sub(r"\\b(?=[\w(])", lambda _: "(?<![" + _WORD + "])", out)
    return out.replace(r"\b", "(?![" + _WORD + "])")


_WORD = r"\p{L}\p{N}_"


def _table(rows: tuple[tuple[str, str], ...]) -> tuple[tuple[str, str], ...]:
    return tuple((unicode_pattern(p), name) for p, name in rows)


#: Subcategories by pattern, the first that matches (fixed values).
SUBCATEGORIES = _table((
    (r"буклет\w*|брошюр\w*", "buklet"),
    (r"листовк\w*|листовок\b|флаер\w*", "listovka"),
    (r"визитк\w*", "visitka"),
    (r"наклейк\w*|стикер\w*|этикетк\w*", "sticker"),
    (r"календар\w*", "calendar"),
    (r"каталог\w*", "catalog"),
    (r"плакат\w*|постер\w*|афиш\w*", "poster"),
    (r"\bменю\w*", "menu"),
    (r"объ[её]мн\w+\s+букв|объ[её]мн\w+\s+изделия", "signboard_volume"),
    (r"светов\w+\s+короб|лайтбокс\w*", "signboard_box"),
    (r"неон\w*", "signboard_neon"),
    (r"брандмауэр\w*|брендмауэр\w*", "banner"),
    (r"\bбаннер\w*|широкоформат\w*", "banner"),
    (r"штендер\w*|стопер\w*", "shtender"),
    (r"\bтабличк\w*", "tablichka"),
    (r"футболк\w*|футболок\b|поло\b", "merch_textile"),
    (r"кружк\w*|кружек\b|термокружк\w*", "merch_mug"),
    (r"бейсболк\w*|бейсболок\b|кепк\w*", "merch_cap"),
    (r"\bручк\w*|ручек\b|карандаш\w*", "merch_pen"),
    (r"флешк\w*|usb\b", "merch_usb"),
    (r"пакет\w*|шопер\w*", "merch_bag"),
    (r"логотип\w*|айдентик\w*", "design_logo"),
    (r"брендбук\w*|фирстил\w*|фирменн\w+\s+стил", "design_brand"),
))

#: Usual lead times by pattern, the first that matches (fixed values).
LEAD_TIMES = _table((
    (r"брендбук\w*|фирменн\w+\s+стил", "10-21 рабочий день"),
    (r"логотип\w*|айдентик\w*", "3-5 рабочих дней"),
    (r"объ[её]мн\w+\s+букв|световая?\s+вывеск|световой?\s+короб|неонов\w+\s+вывеск", "7-14 рабочих дней + согласование 3-5 дней"),
    (r"вывеск\w*|табличк\w*|штендер\w*|стенд\w*", "5-10 рабочих дней"),
    (r"брендмауэр\w*|брандмауэр\w*|широкоформат\w*|баннер\w*", "2-5 рабочих дней"),
    (r"визитк\w*|визиток\b", "1-3 рабочих дня"),
    (r"листовк\w*|листовок\b|флаер\w*|буклет\w*|брошюр\w*|каталог\w*", "1-3 рабочих дня"),
    (r"\bменю\w*", "2-5 рабочих дней"),
    (r"наклейк\w*|наклеек\b|стикер\w*|пл[её]нк\w*", "1-3 рабочих дня"),
    (r"футболк\w*|футболок\b|кружк\w*|кружек\b|бейсболк\w*|бейсболок\b|сувенир\w*|мерч\w*", "3-7 рабочих дней"),
    (r"упаковк\w*|упаковок\b", "5-10 рабочих дней"),
))

#: Categories of titles in lower case, the first whose patterns hold (fixed values): group, category, patterns
#: that must all match, patterns of which one must, patterns of which none may.
CATEGORIES = (
    ("Наружная реклама", "Неоновые вывески", (), ("неон",), ()),
    ("Наружная реклама", "Объемные буквы", ("буква|буквы|буквенн",), ("объ[её]мн", r"световая\s+буква", "3d", "акрил", "пвх"), ()),
    ("Наружная реклама", "Титульные вывески", ("титульн", "вывеск"), (), ("логотип",)),
    ("Наружная реклама", "Световые короба", (), ("лайтбокс", r"светов(ой|ые)\s+короб", r"короб\s+светов"), ()),
    ("Наружная реклама", "Панель-кронштейн", (), ("кронштейн", r"панель[-\s]*кронштейн"), ()),
    ("Наружная реклама", "Штендеры", (), ("штендер",), ()),
    ("Наружная реклама", "Флаги", (), (r"\bфлаг(и|ов|ом)?\b", "флагшток"), ()),
    ("Наружная реклама", "Брендирование авто", (), ("брендирован.*авто", "оклейк.*авто", "авто.*оклейк", r"car\s*wrap"), ()),
    ("Наружная реклама", "Реклама на щитах", (), ("билборд", r"щит\s+реклам", "реклам.*щит", "3х6"), ()),
    ("Наружная реклама", "Световые вывески", ("вывеск",), ("светов", "подсветк", "объ[её]мн", "композит", "контражур", "led|лед"), ()),
    ("Внутренняя реклама", "Таблички с аппликацией", ("табличк", "аппликац"), (), ()),
    ("Внутренняя реклама", "Таблички с гравировкой", ("табличк", "гравир"), (), ()),
    ("Внутренняя реклама", "Таблички прозрачные", ("табличк",), ("прозрачн", "оргстекл", "акрил.*прозрачн"), ()),
    ("Внутренняя реклама", "Полиграфические таблички", ("табличк",), ("полиграф", "бумаг", "картон"), ()),
    ("Внутренняя реклама", "Таблички", ("табличк",), (), ()),
    ("Внутренняя реклама", "Холст", (), (r"\bхолст",), ()),
    ("Внутренняя реклама", "Стенды настенные", ("стенд", "настенн"), (), ()),
    ("Внутренняя реклама", "Стенды напольные", ("стенд",), ("напольн", "мобильн"), ()),
    ("Внутренняя реклама", "Настольные стойки", (), ("настольн.*стойк", "стойк.*настольн", "менюхолдер"), ()),
    ("Внутренняя реклама", "Стойки", (), ("стойк(а|и|у)",), ()),
    ("Внутренняя реклама", "Пресс-волл", (), ("пресс-?волл", r"press[\s-]?wall"), ()),
    ("Внутренняя реклама", "Световые панели", ("панель|панел", "светов"), (), ()),
    ("Внутренняя реклама", "Стенды", ("стенд",), (), ()),
    ("Типография", "Визитки", (), ("визитк",), ()),
    ("Типография", "Листовки", (), ("листовк",), ()),
    ("Типография", "Флаеры", (), ("флаер|флайер",), ()),
    ("Типография", "Брошюры", (), ("брошюр",), ()),
    ("Типография", "Буклеты", (), ("буклет",), ()),
    ("Типография", "Открытки", (), ("открытк",), ()),
    ("Типография", "Календари", (), ("календар",), ()),
    ("Типография", "Ежедневники", (), ("ежедневник",), ()),
    ("Типография", "Блокноты", (), ("блокнот",), ()),
    ("Типография", "Бейджи", (), ("бейдж",), ()),
    ("Типография", "Бланки", (), ("бланк",), ()),
    ("Типография", "Папки", (), (r"\bпапк(а|и|у|ой)",), ()),
    ("Типография", "Планшеты", (), ("планшет",), ()),
    ("Типография", "Пакеты крафт", ("пакет", "крафт"), (), ()),
    ("Типография", "Пакеты ПВД", ("пакет", "пвд"), (), ()),
    ("Типография", "Пакеты майка", ("пакет", "майк"), (), ()),
    ("Типография", "Пакеты", (), ("пакет",), ()),
    ("Типография", "Меню", (), (r"\bменю\b",), ()),
    ("Типография", "Этикетки и стикеры", (), ("этикетк", "стикер", "наклейк"), ()),
    ("Типография", "Пластиковые карты", ("карт(а|ы|очк)", "пластик"), (), ()),
    ("Типография", "Скотч", (), ("скотч",), ()),
    ("Дизайн", "Баннеры", (), ("баннер",), ()),
    ("Дизайн", "Плакаты", (), ("плакат|постер",), ()),
    ("Дизайн", "Веб-дизайн", (), ("веб-?дизайн|web-?design",), ()),
    ("Дизайн", "3D моделирование", (), ("3d.*модел", "моделир"), ()),
    ("Дизайн", "Упаковка", (), ("упаковк",), ()),
    ("Дизайн", "Дизайн-макет", ("макет",), ("дизайн",), ()),
    ("Дизайн", "Полиграфия", (), ("полиграф",), ()),
    ("Брендинг", "Логотип под ключ", ("логотип",), (r"под\s*ключ", "бриф", "концепц", "фирменн.*стил", "брендбук", "айдентик", r"разработк.*с\s*нул", "креатив", "нейминг"), ()),
    ("Брендинг", "Брендбук", (), (r"брендбук|brand[\s-]?book",), ()),
    (
        "Брендинг", "Логотип", (), ("логотип",),
        ("ручк|кружк|термокружк|футболк|кепк|бейсболк|шоппер|худи|свитшот|толстовк|поло|кофт|майк|магнит|шоколад|сахар|бутылк|повербанк|значок|значк|брелок|пакет|ежедневник|блокнот|зажигалк|флешк|наклейк|стикер|этикет|визитк|баннер|табличк|вывеск|футляр|плед|шапк|зонт|носок|носк|ложк|вилк|нож",),
    ),
    ("Брендинг", "Фирменный стиль", (), ("фирменн.*стил", "стил.*фирм"), ()),
    ("Брендинг", "Иллюстрации", (), ("иллюстрац",), ()),
    ("Брендинг", "Презентации", (), ("презентац",), ()),
    ("Брендинг", "Фотосъемка", (), ("фотосъ[её]мк|фотосессия",), ()),
    ("Брендинг", "Разработка сайтов", (), ("разработк.*сайт|сайт.*разработк|landing|лендинг",), ()),
    ("Брендинг", "SMM", (), (r"\bsmm\b|соц.*сет",), ()),
    ("Мерч", "Кружки", (), ("кружк",), ()),
    ("Мерч", "Термокружки", (), ("термокружк|термос",), ()),
    ("Мерч", "Бутылки для воды", ("бутылк",), (), ()),
    ("Мерч", "Ручки", (), (r"\bручк(а|и|у|ой)\b",), ()),
    ("Мерч", "Футболки", (), ("футболк",), ()),
    ("Мерч", "Бейсболки", (), ("бейсболк|кепк",), ()),
    ("Мерч", "Шопперы", (), ("шоппер",), ()),
    ("Мерч", "Свитшоты", (), ("свитшот|худи",), ()),
    ("Мерч", "Повербанки", (), (r"повербанк|power[\s-]?bank",), ()),
    ("Мерч", "Магниты", (), ("магнит",), ()),
    ("Мерч", "Шоколад с логотипом", (), ("шоколад",), ()),
)

#: What of a title is an option and no name (fixed values).
OPTIONS = "\\s*[0-9]+[xх×][0-9]+\\s*(?:см|мм)?|\\s*[0-9]+\\s*(?:гр/?м2|мкр|шт|мм|см|экз)|\\s*(?:эконом|стандарт|премиум|офсет|двухсторонн\\S*|односторонн\\S*|матов\\S*|глянц\\S*)|\\s*(?:оперативная полиграфия|бумага|пружине)"
#: Words by which a text names a deal that it links to (fixed values).
LINK_WORDS = ("КП", "сделк[аиуе]", "Кейс")
DAYS = " раб. дн."
