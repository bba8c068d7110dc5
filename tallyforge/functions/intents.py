r"""Rule tables of requests in the sign and print trade: what a request is after, which kinds of document
answer it, which products it names. All values are fixed: results depend on them letter by letter.

Patterns are searched without regard to case; ``\w``, ``\b`` and ``\s`` count every script (flag U).
"""

from dataclasses import dataclass

#: Asked for a price (fixed values): somewhere, and as whole words.
PRICE = r"стоимост|стоит|цен[аеуы]|расценк|прайс|смет|бюджет|сколько"
PRICE_WORD = r"\b(стоимост\w*|стоит|стоят|цен[аеуыёо]\b|расценк\w*|прайс\w*|смет\w*|бюджет\w*|сколько)"

#: Stems of products that a request may name (fixed values).
STEMS = (
    "брендмауэр", "брендмаур", "брандмауэр", "брандмаур", "брендбук", "брендинг", "фирменн", "логотип", "айдентик", "визитк", "листовк", "флаер", "буклет",
    "наклейк", "стикер", "плёнк", "пленк", "баннер", "вывеск", "объёмн", "объемн", "светов", "короб", "лайтбокс", "штендер", "табличк", "стенд", "брошюр",
    "каталог", "меню", "плакат", "афиш", "постер", "ролап", "ролл-ап", "упаковк", "флагшток", "флажок", "пиллар", "стел", "стелл", "футболк", "кружк",
    "бейсболк", "ручк", "блокнот", "сувенир", "мерч", "печат", "широкоформат", "офсет", "цифровой",
)

#: Stems that a request for the product on the left does not mean (fixed values).
COLLISIONS = {
    "буклет": ("листовк", "листовок", "флаер"),
    "брошюр": ("листовк", "листовок", "флаер"),
    "каталог": ("листовк", "листовок", "флаер", "буклет"),
    "флагшток": ("флаер", "штендер"),
    "брендмауэр": ("вывеск", "объёмн", "объемн"),
    "брандмауэр": ("вывеск", "объёмн", "объемн"),
}

#: Things an estimate can be for (fixed values): a request that names one is not without context.
NOUNS = (
    "логотип", "лого", "вывеск", "баннер", "листовк", "визитк", "наклейк", "буклет", "флаер", "брендбук", "брендинг", "штендер", "панель", "кронштейн",
    "табличк", "реклам", "печат", "монтаж", "дизайн", "объ[её]мн", "букв", "светов", "фасад", "витрин", "стикер", "этикет", "упаковк", "стенд",
    "постер", "афиш", "плакат", "рол[а-я]п", "шаурм", "кофейн", "ресторан", "магазин", "аптек", "офис", "стиль", "айдентик", "компани",
    "концепци", "3d", "3-d", "навигаци", "меню", "календар",
)

#: Phrases of requests for a text (fixed values).
DESCRIBE = (
    "помоги составить описание", "составить описание", "помоги с описанием", "как ответить", "что сказать", "что ему ответить", "что ответить",
    "как презентовать", "презентуй", "скрипт", "аргумент", "подготовить текст", "подготовь текст", "подготовить ответ", "подготовь ответ",
    "сформулируй", "сформулировать", "первого ответа", "первый ответ", "ответа клиенту", "ответ клиенту",
    "клиент спрашивает", "клиент ответил", "клиент сомневается", "клиент пишет", "клиент написал", "клиент хочет",
)


@dataclass(frozen=True)
class Rule:
    """intent, confidence: what is found where any of patterns is; not where unless is found too.
    price: where this pattern is found and the request names a product of STEMS, it is a product query
    (0.85); strict: where price is found without a product, the rule does not hold.
    first_only: holds only in requests without earlier turns."""

    intent: str
    confidence: float
    patterns: tuple[str, ...]
    unless: str | None = None
    price: str | None = None
    strict: bool = False
    first_only: bool = False


#: Rules in order, the first that holds counts (fixed values).
RULES = (
    Rule(
        "consultation", 0.95,
        (
            r"^\s*(а\s+)?(вы|Вы)\s+(делает|можете|умеете|работает|оказыва|выполня|принима|берёт|изготавлива|производит)\w*\s+",
            r"^\s*(а\s+)?(у вас|У вас)\s+(есть|можно|бывает|имеется)",
            r"^\s*(вы|а вы)\s+(делает|можете)\w*\s+\w+\s*\??\s*$",
        ),
        unless=PRICE,
    ),
    Rule(
        "out_of_scope", 0.95,
        (
            r"режим\s+работы|график\s+работы|часы\s+работы|время\s+работы",
            r"когда\s+(откры|закры|работае)|во\s+сколько\s+(откры|закры)",
            r"расписани[еяю]|выходны[еыхй]\s+(дн|ли)",
            r"как\s+(добрать|проехать|найти)|где\s+(вы\s+)?(находит|расположен)",
            r"адрес\s+офиса|адрес\s+компани|\bваш\s+адрес",
            r"номер\s+телефон|контактн.*телефон|\bтелефон\s+офис",
        ),
    ),
    Rule(
        "financial_modifier", 0.95,
        (
            r"безнал\w*",
            r"\bналичн\w*|\bналичк\w*",
            r"скидк\w*\s*\d+\s*%|скидк\w*.*стоимост|\d+\s*%\s*скидк",
            r"надбавк\w*|наценк\w*",
            r"\bндс\b|без\s*ндс|с\s*ндс",
            r"предоплат\w*\s*\d+\s*%|рассрочк\w*",
        ),
    ),
    Rule(
        "visualization", 0.90,
        (
            r"как\s+(это\s+)?(будет\s+)?(выглядит|выглядеть|смотрит|смотреть)\w*\s+(на\s+фасад|на\s+здани|на\s+стен)",
            r"как\s+(это\s+)?будет\s+на\s+фасад",
            r"визуализаци|покаж\w*\s+как",
            r"увидеть\s+как\s+(это|будет)|фото\s*ш?оп|3d\s*модел",
        ),
    ),
    Rule(
        "empty_context_smeta", 0.95,
        (
            r"(дай|составь|напиши|сделай|подготов|сформируй|нужн[аы]?)\s+смет\w*\s+(на|для)\s+эт",
            r"осмет\w*\s+эт",
            r"смет\w*\s+(для|на)\s+(сделк|услуг|позици|клиент|заявк|этого|этой|этому)",
            r"^\s*(дай|напиши)\s+смет\w*\s*$",
        ),
        unless="|".join(NOUNS),
    ),
    Rule(
        "referential", 0.90,
        (
            r"вместо\s+(эт\w+|этой|этого|этих)",
            r"\bэт[ау]\s+(услуг|позици|вывеск|букв|баннер|табличк|сделк)",
            r"для\s+эт\w+\s+(объект|клиент|сделк|проект)",
            r"как\s+в\s+прошл\w+\s+(раз|сделк|заказ)",
        ),
        first_only=True,
    ),
    Rule(
        "objection_arguments", 0.92,
        (
            r"как\s+(мне\s+|нам\s+)?ответить\s+(на\s+возраж|клиенту|на\s+вопрос)",
            r"как\s+(объяснить|обосновать|аргументировать)\s+(цену|стоимость|разниц)",
            r"почему\s+(?:\S+\s+){0,8}(дороже|выше|больше|дорог|подорож)",
            r"чем\s+(наша\s+|мы\s+)\w*\s*(лучше|отличаемся)",
            r"как\s+(закрыть|снять|обработать|парировать)\s+возраж",
            r"что\s+(мне\s+)?(сказать|написать)\s+клиенту\s+(на|про|о|об)",
        ),
        price=PRICE,
    ),
    Rule(
        "discovery_assist", 0.92,
        (
            r"как\s+(мне\s+|нам\s+)?(выяснить|узнать|уточнить|спросить)",
            r"какие\s+(вопросы|уточнения|параметры|данные)\s+(задать|задавать|нужн\w+|собрать)",
            r"как\s+(правильно\s+)?осметить\s+(без|если)\s+парам",
            r"что\s+(мне\s+)?(спросить|уточнить)\s+у\s+клиент",
        ),
    ),
    Rule(
        "category_clarify", 0.90,
        (
            r"(делаете\s+ли|занимаетесь\s+ли|производите\s+ли|изготавлива\w+\s+ли)\s+\w+",
            r"можете\s+(ли\s+)?(сделать|изготовить|произвести|выполнить|выпуст|собрать)\s+\w+",
            r"\bу\s+вас\s+есть\s+(услуг|товар|категори|направлени)",
            r"(работает|трудитесь)\s+ли\s+с\s+\w+",
        ),
        price=PRICE_WORD,
        strict=True,
    ),
    Rule(
        "historical_request", 0.90,
        (
            r"(дай|пришл|покаж|приведи|сбрось)\w*\s+(ссылк|пример|кейс|сделк|референс)",
            r"(похож\w+|подобн\w+|аналогичн\w+)\s+(сделк|заказ|кейс|пример|проект)",
            r"был\w+\s+ли\s+(такие|подобные|похожие)\s+(сделк|заказ|проект)",
            r"(истори\w+|архив\w*)\s+(сделк|заказ|клиент|проект)",
            r"(ваши\s+)?(закрыт\w+|реализованн\w+|выполненн\w+)\s+(сделк|заказ|проект)",
            r"примеры\s+(работ|сделок|заказов|проектов)",
        ),
    ),
    Rule("describe", 0.90, DESCRIBE),
    Rule(
        "bundle_query", 0.85,
        (
            r"под\s+ключ",
            r"что\s+(входит|включ|идёт|идет)",
            r"из\s+чего\s+состо|какой\s+состав|состав\s+и\s+стоимост",
            r"\bкомплект\w*|\bкомплектац",
            r"\bпакет\s+(услуг|рекламн|для|на)|\bпакет\w*\s+для",
            r"\bвесь\s+пакет|\bполный\s+пакет",
            r"\bнабор\s+(рекламн|материал|услуг|для|монтаж)|\bполный\s+набор",
            r"комплексн\w*\s+(печатн|рекламн|кампани|проект)",
            r"брендирован\w*|брендинг",
            r"всё\s+для\s+открыт|все\s+для\s+открыт|для\s+открыт\w*\s+(кафе|магазин|аптек|ресторан|офис|точк)",
        ),
    ),
    Rule("product_query", 0.95, (r"\b(логотип\w*|\bлого\b|фирменн\w+\s+стил\w*|брендбук\w*|айдентик\w*)\b",)),
)

#: Kinds of document that answer an intent, and how many of them (fixed values).
STRATEGIES = {
    "smeta_request": (("bundle", "pricing_policy", "offer_profile", "product", "service_pricing_bridge", "offer_composition", "historical_deal"), 15),
    "consultation": (("knowledge", "pricing_policy", "service_composition", "faq", "roadmap", "service_pricing_bridge", "service_page"), 10),
    "bundle_query": (("bundle", "deal_profile", "offer_profile", "product", "pricing_policy", "service_pricing_bridge", "offer_composition", "historical_deal"), 12),
    "product_query": (("product", "bundle", "pricing_policy", "offer_profile", "service_pricing_bridge", "service_page", "historical_deal"), 12),
    "underspec": (("service_pricing_bridge", "pricing_policy", "knowledge", "faq", "product", "service_page", "historical_deal"), 8),
    "describe": (("knowledge", "faq", "roadmap", "service_pricing_bridge", "service_page"), 8),
    "out_of_scope": (("knowledge", "faq"), 5),
    "historical_request": (("historical_deal", "deal_profile", "offer_profile"), 12),
    "referential": (("historical_deal", "deal_profile", "bundle", "offer_profile", "knowledge"), 10),
    "objection_arguments": (("knowledge", "faq", "roadmap", "service_page", "historical_deal", "bundle"), 10),
    "discovery_assist": (("knowledge", "faq", "roadmap", "service_page"), 8),
    "category_clarify": (("service_page", "knowledge", "faq"), 6),
}
