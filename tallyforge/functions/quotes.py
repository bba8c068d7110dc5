r"""What texts quote: prices, ranges of them, packages, returns; units and sections of names; texts of a
model made presentable. Column expressions; patterns are read with flag U, so ``\s`` counts hard spaces."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyforge.functions.text import scrub

#: A price with its unit, a number of a range, its unit, dashes (fixed values).
PRICE = r"(\d{1,3}(?:[  .,]\d{3})+|\d{3,7})\s*(?:₽|руб|р\.?\b)"
AMOUNT = r"(\d{1,3}(?:\s\d{3})+|\d{3,7})"
UNIT = r"(?:₽|руб(?:л\w+)?|р\.)"
DASH = r"\s*[-–—−]\s*"

#: A named package with its price or range, and a price without name (fixed values).
PACKAGE = r"[«\"]([^»\"]+)[»\"]\s*\(?\s*([\d\s]+(?:\s*[-–]\s*[\d\s]+)?)\s*руб"
STANDALONE = r"([\d][\d\s]*[\d])\s*(?:[-–]\s*([\d][\d\s]*[\d])\s*)?руб"

#: Returns and conversion in percent (fixed values).
ROMI = r"ROMI?\s*(?:[\(\)]?\s*возврат[^)]*\)?\s*)?(?:от\s+|~|≈|около\s+|составляет\s+|более\s+чем\s+)?(\d+)\s*%"
ROI = r"ROI\s*(?:от\s+|~|≈|около\s+)?(\d+)\s*%"
CONVERSION = r"(?:конверси[яюей]|CR)\s*(?:[\w\s]*?)(?:от\s+|до\s+|~|≈|около\s+)?(\d+(?:[.,]\d+)?)\s*%"

#: Sections by a part of a direction's name, and by the parent section of a product (fixed values).
SECTIONS = {"цех": "Цех", "рик": "РИК", "дизайн": "Дизайн", "печат": "Печатная", "мерч": "Мерч", "сольвент": "Сольвент"}
PARENTS = {
    "Буквы": "Цех", "Короба": "Цех", "Листовые": "Цех", "Электрика": "Цех", "металл": "Цех", "Пленки": "Цех",
    "Самоклейка": "Печатная", "Визитки": "Печатная", "Баннер": "Сольвент", "Дизайн": "Дизайн", "Монтаж": "РИК", "Мерч": "Мерч",
}
OWN_SECTION = ("Печатная", "Сольвент", "Дизайн", "РИК", "Мерч")

#: Labels of enumeration ids (fixed values).
DIRECTIONS = {108: "Печатка", 110: "Цех", 112: "Дизайн", 114: "Аутсорсинг"}
SIGN_TYPES = {140: "Статика", 142: "Динамика", 144: "Экран"}
PAYMENTS = {152: "Наличный", 154: "Безналичный", 156: "Наличный", 158: "Безналичный", 160: "Бартер", 164: "Инвестиция", 268: "Бартер"}

#: Starts of lines that are code (fixed values).
CODE = ("#include", "using namespace", "int main", "cout <<", "import ", "def ", "class ", "return ", "print(", "```", "//", "/*")

#: What stands for a missing benefit, by direction (fixed values).
BENEFITS = {
    "Цех": "Вывеска обеспечивает видимость бизнеса на фасаде, привлекает пешеходный и автомобильный трафик, формирует первое впечатление о компании.",
    "Печатная": "Полиграфическая продукция обеспечивает передачу контактной информации, повышает узнаваемость бренда и поддерживает деловую коммуникацию.",
    "Дизайн": "Дизайн-продукт формирует визуальную идентичность бренда, повышает узнаваемость и создаёт единый фирменный стиль.",
    "Мерч": "Брендированная продукция работает как постоянное напоминание о компании, повышает лояльность клиентов и партнёров.",
    "Сольвент": "Широкоформатная реклама обеспечивает максимальный охват аудитории при минимальной стоимости контакта.",
    "РИК": "Профессиональный монтаж обеспечивает долговечность конструкции, безопасность и соответствие нормам размещения.",
}
BENEFITS |= {"Макет": BENEFITS["Дизайн"], "Офсет": BENEFITS["Печатная"]}

CYRILLIC, LETTERS = "[а-яА-ЯёЁ]", "[a-zA-Zа-яА-ЯёЁ]"


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(_text(text), F.lit(f"(?iuU){pattern}"), F.lit(group))


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "").try_cast("long")


def _map(table: dict, by: Column) -> Column:
    """The value for a key, null without one: a chain of comparisons, since tables are small."""
    return F.coalesce(*[F.when(by == F.lit(k), F.lit(v)) for k, v in table.items()])


def price_list(text: Column, least: int = 100) -> Column:
    """Distinct prices of ``least`` and more that a text states, ascending."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(_all(text, PRICE), _digits), lambda x: x >= least)))


def price_range(text: Column) -> Column:
    """(low, high) of the first range whose low is no higher than its high, else of the first single price,
    both equal; nulls where a text has neither."""
    first = lambda pattern, group: _digits(F.regexp_extract(_text(text), f"(?iuU){pattern}", group))
    span = AMOUNT + DASH + AMOUNT + r"\s*" + UNIT
    low, high, one = first(span, 1), first(span, 2), first(AMOUNT + r"\s*" + UNIT, 1)
    ranged = F.coalesce(low <= high, F.lit(False))
    return F.struct(F.when(ranged, low).otherwise(one).cast("double").alias("low"), F.when(ranged, high).otherwise(one).cast("double").alias("high"))


def package_prices(text: Column, least: int = 100) -> Column:
    """[(package, low, high)] in the order of the text: named packages with their prices; where it names
    none, prices of ``least`` and more with an empty name. A single price is both low and high."""
    bare = lambda c: F.regexp_replace(c, r"(?U)\s", "")
    numbers = lambda c: F.filter(F.transform(F.split(c, r"(?U)\s*[-–]\s*"), lambda p: F.when(bare(p).rlike("^[0-9]+$"), bare(p).try_cast("long"))), lambda n: n.isNotNull())
    row = lambda name, low, high: F.struct(name.alias("package"), low.alias("low"), high.alias("high"))
    paired = lambda pattern: F.arrays_zip(_all(text, pattern, 1).alias("a"), _all(text, pattern, 2).alias("b"))
    trimmed = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    named = F.transform(paired(PACKAGE), lambda x: row(trimmed(x["a"]), F.get(numbers(trimmed(x["b"])), 0), F.try_element_at(numbers(trimmed(x["b"])), F.lit(-1))))
    named = F.filter(named, lambda x: x["low"].isNotNull())
    plain = F.transform(paired(STANDALONE), lambda x: row(F.lit(""), _digits(x["a"]), F.coalesce(_digits(x["b"]), _digits(x["a"]))))
    return F.when(F.size(named) > 0, named).otherwise(F.filter(plain, lambda x: x["low"] >= least))


def returns(text: Column) -> Column:
    """(romi_min, romi_max, roi_min, roi_max, conversion_min, conversion_max) that a text states in percent;
    null where it states none."""
    out = []
    for name, pattern, kind in (("romi", ROMI, "long"), ("roi", ROI, "long"), ("conversion", CONVERSION, "double")):
        found = F.transform(_all(text, pattern), lambda x: F.replace(x, F.lit(","), F.lit("."))).try_cast(f"array<{kind}>")
        out += [F.array_min(found).alias(f"{name}_min"), F.array_max(found).alias(f"{name}_max")]
    return F.struct(*out)


def decoded(ids: Column, table: dict[int, str]) -> Column:
    """Labels of an array of ids, joined; an id without a label stands for itself, nulls are left out."""
    known = F.transform(F.filter(F.coalesce(ids, F.array().cast("array<long>")), lambda x: x.isNotNull()), lambda x: F.coalesce(_map(table, x), x.cast("string")))
    return F.array_join(known, ", ")


def unit_of(name: Column) -> Column:
    """The unit that a product's name states as a word, pieces without one."""
    low = F.lower(_text(name))
    return F.when(low.rlike(r"(?U)\bмп\b"), "мп").when(low.rlike(r"(?U)\bкв\.?м\b|\bм2\b"), "кв.м").when(low.rlike(r"(?U)\bкомпл\b"), "компл").otherwise("шт")


def loose_unit_of(name: Column) -> Column:
    """The unit whose sign a product's name holds in any place: area before running metres, else pieces. The
    word for a set holds the sign of running metres and counts as such."""
    low = F.lower(_text(name))
    return F.when(low.rlike(r"кв\. ?м|m²"), "кв.м").when(low.rlike("мп|пог"), "мп").otherwise("шт")


def section_of(direction: Column, table: dict[str, str] = SECTIONS) -> Column:
    """The section of a direction by the first part of its name in the table, else the direction itself."""
    low = F.lower(_text(direction))
    return F.coalesce(*[F.when(low.contains(k), F.lit(v)) for k, v in table.items()], _text(direction))


def parent_section(parent: Column, direction: Column) -> Column:
    """The direction where it is a section, else the section of the parent, else the direction, else the shop."""
    d = F.nullif(_text(direction), F.lit(""))
    return F.when(d.isin(*OWN_SECTION), d).otherwise(F.coalesce(_map(PARENTS, parent), d, F.lit("Цех")))


def _share(text: Column) -> Column:
    """Share of Cyrillic among Latin and Cyrillic letters; null without letters."""
    return F.try_divide(F.regexp_count(text, F.lit(CYRILLIC)), F.regexp_count(text, F.lit(LETTERS)))


def presentable(text: Column, words: dict[str, str] | None = None, junk: Sequence[str] = (), least: float = 0.3) -> Column:
    """A model's text without thoughts, tags and ideographs; words replaced, longest first; Latin doubles
    before a slash and in brackets and junk words gone; lines of code and lines of over ten characters with
    under ``least`` of Cyrillic letters left out; blank lines at most one. Null is empty."""
    pairs = [(r"(?s)<think>.*?</think>", ""), (r"<[^>]+>", ""), (r"[\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}\x{2e80}-\x{2eff}\x{3000}-\x{303f}\x{ff00}-\x{ffef}]+", "")]
    for k, v in sorted((words or {}).items(), key=lambda kv: -len(kv[0])):
        pairs.append((rf"(?iu)\Q{k}\E", v.replace("\\", r"\\").replace("$", r"\$")))
    pairs += [(r"[a-zA-Z][a-zA-Z\s]+\s*/\s*(?=[а-яА-ЯёЁ])", ""), (r"\(\s*[a-zA-Z][a-zA-Z\s]*\s*\)", "")]
    if junk:
        pairs.append((r"(?iuU)\b(" + "|".join(junk) + r")\b", ""))
    bare = lambda line: F.regexp_replace(line, r"(?U)^\s+|\s+$", "")
    code = lambda line: F.exists(F.array(*[F.lit(c) for c in CODE]), lambda c: F.startswith(bare(line), c))
    foreign = lambda line: (F.length(bare(line)) > 10) & F.coalesce(_share(bare(line)) < least, F.lit(False))
    kept = F.filter(F.split(scrub(_text(text), pairs), "\r\n|\r|\n"), lambda line: ~code(line) & ~foreign(line))
    whole = scrub(F.array_join(kept, "\n"), [(r"(?i)This (code|program|text) is not related[^\n]*", ""), (r"\n{3,}", "\n\n")])
    return F.regexp_replace(whole, r"(?U)^\s+|\s+$", "")


def benefit(text: Column, direction: Column, table: dict[str, str] = BENEFITS, least: float = 0.3) -> Column:
    """The text where it has ten characters and enough Cyrillic letters, else what stands for it by direction
    (empty for an unknown one)."""
    bare = F.regexp_replace(_text(text), r"(?U)^\s+|\s+$", "")
    good = (F.length(bare) >= 10) & F.coalesce(_share(bare) >= least, F.lit(True))
    return F.when(good, bare).otherwise(F.coalesce(_map(table, direction), F.lit("")))
