"""Categories, materials, sizes, slugs, links and coerced answers, and what is built on them: title
clusters, seeded canonical deals, service bridges with a resolved catalogue. JVM-side expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import rules
from tallyforge.functions.text import first_rule, labels, slug, tokens
from tallyforge.operators.similarity import fuzzy_of, top_sharing
from tallyforge.operators.windows import mode, top_n

_END = r"(?:[^\p{L}\p{N}_]|$)"


def _low(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit("")))


def _any_case(pattern: str) -> str:
    return f"(?iu){pattern}"


def materials(text: Column, table: dict[str, str] = rules.MATERIALS) -> Column:
    """Materials that a text names, in the order of the table."""
    return labels(_low(text), table)


def heights(text: Column, least: int = 10, most: int = 200) -> Column:
    """Heights in centimetres that a text states, those in cm first, then mm, then m."""
    low = _low(text)
    found = lambda p: F.regexp_extract_all(low, F.lit(p + _END), 1)
    cm = F.transform(found(r"([0-9]{2,3})\s*(?:см|cm)"), lambda x: x.cast("int"))
    mm = F.transform(found(r"([0-9]{2,4})\s*(?:мм|mm)"), lambda x: F.floor(x.cast("int") / 10 + 0.5).cast("int"))
    m = F.transform(found(r"([0-9](?:[.,][0-9])?)\s*(?:м|m)"), lambda x: F.floor(F.replace(x, F.lit(","), F.lit(".")).cast("double") * 100 + 0.5).cast("int"))
    return F.filter(F.concat(cm, mm, m), lambda x: (x >= least) & (x <= most))


def height_modes(rows: DataFrame, by: list[str], text: str, order: str, fallback: DataFrame | None = None) -> DataFrame:
    """(by, height): the most frequent height in the texts of a group, the first of equally frequent
    ones; where they have none, that of the fallback's text (by, text)."""
    each = lambda df, o: df.select(*by, o.alias("_o"), F.posexplode(heights(F.col(text))).alias("_i", "height"))
    out = mode(each(rows, F.col(order)), by, "height", F.struct("_o", "_i"), "height")
    if fallback is not None:
        out = out.unionByName(mode(each(fallback, F.lit(0)), by, "height", F.struct("_o", "_i"), "height").join(out, by, "left_anti"))
    return out


def component_name(name: Column) -> Column:
    """A product's name without its ranges and 'more than n', 60 characters."""
    s = F.regexp_replace(F.coalesce(name, F.lit("")), _any_case(r"[0-9]+[-–][0-9]+\s*(?:мп|м²|шт|см)"), "")
    s = F.regexp_replace(F.regexp_replace(s, _any_case(r"более\s*[0-9]+"), ""), r"\s+", " ")
    return F.substring(F.trim(s), 1, 60)


def category_key(title: Column, heads: tuple[str, ...] = rules.HEADS, named: str = "ПВХ|Акрил|Композит") -> Column:
    """What a title is about: of its first five words of three letters and more the head of a category
    with the word before it, else the first two; without quotes, materials with numbers and sizes."""
    steps = [("«[^»]*»", " "), ('"[^"]*"', " "), (_any_case(rf"(?:{named})[0-9]+"), " "), (_any_case(r"[0-9]+[xх×][0-9]+(?:\s*см)?"), " "), (_any_case(rf"[0-9]+\s*(?:см|мм|мп)(?=[^\p{{L}}\p{{N}}_]|$)"), " "), (r"[,;:()]", " "), (r"\s+", " ")]
    s = F.lower(F.trim(reduce(lambda t, p: F.regexp_replace(t, *p), steps, F.coalesce(title, F.lit("")))))
    words = F.slice(F.filter(F.split(s, " "), lambda w: F.length(w) >= 3), 1, 5)
    at = F.coalesce(F.array_position(F.transform(words, lambda w: w.isin(*heads)), True), F.lit(0)).cast("int")
    start = F.greatest(at - 1, F.lit(1))
    return F.array_join(F.when(at > 0, F.slice(words, start, at - start + 1)).otherwise(F.slice(words, 1, 2)), " ")


def clustered(deals: DataFrame, title: str = "title", least: int = 3) -> DataFrame:
    """Deals with their category; categories of fewer than ``least`` deals are left out."""
    rows = deals.withColumn("category", category_key(F.col(title))).filter(F.col("category") != "")
    often = rows.groupBy("category").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= least).select("category")
    return rows.join(often, "category", "left_semi")


def seeded(members: DataFrame, canonical: DataFrame, deals: DataFrame, seeds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members and canonical deals with hand-picked ones. seeds (category, dataset, deal_id, canonical):
    where a category's canonical seed is a deal with lines, it stands for the category, and all its
    seeds that exist become members; a category of any other kind stays as it is."""
    known = seeds.join(deals.select("dataset", "deal_id", "line_count"), ["dataset", "deal_id"])
    chosen = known.filter("canonical and line_count > 0").select("category", F.col("dataset").alias("_ds"), F.col("deal_id").alias("_id"))
    chosen = chosen.join(members.select("category").distinct(), "category", "left_semi")
    added = known.join(chosen.select("category"), "category", "left_semi").select("category", "dataset", "deal_id")
    every = members.select("category", "dataset", "deal_id").unionByName(added).distinct()
    out = canonical.join(chosen, "category", "full_outer")
    return every, out.select("category", F.coalesce("_ds", "dataset").alias("dataset"), F.coalesce("_id", "deal_id").alias("deal_id"), F.col("_id").isNotNull().alias("seeded"))


def enrichment_pool(deals: DataFrame, title: str, matches: str, without: str) -> DataFrame:
    """Deals whose title matches one pattern and not another: a wider pool for keywords and titles."""
    return deals.filter(F.col(title).rlike(_any_case(matches)) & ~F.col(title).rlike(_any_case(without)))


def subcategory(ids: Column, name: Column, text: Column, by_id: dict[str, str], table=rules.SUBCATEGORIES) -> Column:
    """By the first known category id, else by the name, else by the first 500 characters of the text."""
    known = F.get(F.filter(F.transform(ids, lambda i: F.try_element_at(F.create_map(*[F.lit(x) for p in by_id.items() for x in p]), i)), lambda x: x.isNotNull()), 0)
    rule = lambda t: first_rule([(_low(t).rlike(p), k) for p, k in table])
    return F.coalesce(known, rule(name), rule(F.substring(text, 1, 500)))


def title_category(title: Column, table=rules.CATEGORIES) -> Column:
    """(parent, name) of the first category whose patterns hold for a title: all of the first kind, one of the
    second, none of the third. Null where none does. One expression; Spark stops at the first that holds."""
    low = _low(title)
    every = lambda ps, some: reduce(lambda a, b: (a | b) if some else (a & b), [low.rlike(rules.unicode_pattern(p)) for p in ps])
    found = []
    for parent, name, all_of, any_of, not_any in table:
        cond = F.lit(True)
        for ps, some in ((all_of, False), (any_of, True)):
            cond = cond & every(ps, some) if ps else cond
        cond = cond & ~every(not_any, True) if not_any else cond
        found.append(F.when(cond, F.struct(F.lit(parent).alias("parent"), F.lit(name).alias("name"))))
    return F.coalesce(*found)


def query_subcategory(text: Column, table=rules.SUBCATEGORIES) -> Column:
    """The one subcategory that a request names; null if it names none or several."""
    hits = F.array_distinct(F.filter(F.array(*[F.when(_low(text).rlike(p), F.lit(k)) for p, k in table]), lambda x: x.isNotNull()))
    return F.when(F.size(hits) == 1, F.get(hits, 0))


def candidate_slugs(title: Column, options: str = rules.OPTIONS) -> Column:
    """Slugs under which a title may be known: its first sentence, that without options, its first two
    words, its first word, the whole title; each once, best first."""
    base = F.trim(F.get(F.split(F.coalesce(title, F.lit("")), r"\."), 0))
    words = F.split(base, r"\s+")
    cleaned = F.trim(F.regexp_replace(base, _any_case(options), ""))
    each = F.array(slug(base), slug(cleaned), F.when(F.size(words) >= 2, slug(F.array_join(F.slice(words, 1, 2), " "))), slug(F.get(words, 0)), slug(title))
    return F.array_distinct(F.filter(each, lambda x: x.isNotNull() & (x != "")))


def linkified(text: Column, url: str, words: tuple[str, ...] = rules.LINK_WORDS) -> Column:
    """Ids of deals ('word #123', 'word № 123', '#1234') as Markdown links to url, a format with one %s.
    Links and addresses that the text has already stay as they are, so a second pass changes nothing."""
    head, tail = url.split("%s")
    kept = r"(\[[^\]]*\]\([^)]*\)|https?://\S+)"
    named, bare = rf"({'|'.join(words)})\s*[#№]\s*(?=0*[1-9])([0-9]{{3,10}})", r"(?<![\p{L}\p{N}_/])#(?=0*[1-9])([0-9]{4,10})"
    quoted = lambda s: s.replace("\\", "\\\\").replace("$", "\\$")
    # three private characters mark where a link opens, turns to its address and ends
    o, m, c = "\ue000", "\ue001", "\ue002"
    out = F.regexp_replace(text, _any_case(f"{kept}|{named}|{bare}"), f"$1{o}$2 #$3$4{m}({quoted(head)}$3$4{quoted(tail)}){c}")
    out = F.replace(out, F.lit(f"{o} #{m}({head}{tail}){c}"), F.lit(""))
    return reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), ((f"{o} #", "[#"), (o, "["), (m, "]"), (c, "")), out)


def coerced(json: Column, days: str = rules.DAYS) -> dict[str, Column]:
    """estimated_price (value, basis), price_band (min, max) and estimated_lead_time of an answer that
    gives them as numbers, texts, lists or objects; what can't be read is null."""
    v = F.try_parse_json(json)
    part = lambda p: F.try_variant_get(v, p, "variant")
    kind = lambda p: F.coalesce(F.schema_of_variant(part(p)), F.lit("VOID"))
    text = lambda p: F.try_variant_get(v, p, "string")
    plain = lambda p: F.replace(F.replace(text(p), F.lit(" "), F.lit("")), F.lit(","), F.lit(".")).try_cast("double")
    number = lambda p: kind(p).rlike("^(?:BIGINT|DOUBLE|FLOAT|DECIMAL.*)$")
    object_, list_ = lambda p: kind(p).startswith("OBJECT"), lambda p: kind(p).startswith("ARRAY")
    pair = lambda a, b, x, y: F.struct(x.alias(a), y.alias(b))
    p, b, t = "$.estimated_price", "$.price_band", "$.estimated_lead_time"
    price = F.when(object_(p), pair("value", "basis", plain(p + ".value"), text(p + ".basis"))).when(plain(p).isNotNull(), pair("value", "basis", plain(p), F.lit("")))
    band = F.when(object_(b), pair("min", "max", plain(b + ".min"), plain(b + ".max"))).when(number(b), pair("min", "max", plain(b), plain(b)))
    band = band.when(list_(b) & part(b + "[2]").isNull() & plain(b + "[0]").isNotNull() & plain(b + "[1]").isNotNull(), pair("min", "max", plain(b + "[0]"), plain(b + "[1]")))
    own = F.when(text(t + ".value").isNotNull(), text(t + ".value")).when(text(t + ".days").isNotNull(), F.concat(text(t + ".days"), F.lit(days))).when(text(t + ".min").isNotNull() & text(t + ".max").isNotNull(), F.concat(text(t + ".min"), F.lit("-"), text(t + ".max"), F.lit(days)))
    lead = F.when(object_(t), own).when(number(t), F.concat(plain(t).cast("long").cast("string"), F.lit(days))).when(kind(t) == "STRING", text(t))
    return {"estimated_price": price, "price_band": band, "estimated_lead_time": lead}


def lead_time(given: Column, text: Column, priced: Column, table=rules.LEAD_TIMES) -> Column:
    """The given lead time, else for a priced answer the usual one of the first category in its text."""
    return F.coalesce(F.nullif(given, F.lit("")), F.when(priced, first_rule([(_low(text).rlike(p), k) for p, k in table])))


def earliest(text: Column, patterns: dict[str, str]) -> Column:
    """The key whose pattern is found first in a text, null if none is; of equals the first key."""
    low = _low(text)
    at = [F.when(F.regexp_instr(low, F.lit(p)) > 0, F.struct(F.regexp_instr(low, F.lit(p)).alias("at"), F.lit(i).alias("i"), F.lit(k).alias("key"))) for i, (k, p) in enumerate(patterns.items())]
    return F.array_min(F.filter(F.array(*at), lambda x: x.isNotNull()))["key"]


def resolved_names(names: DataFrame, goods: DataFrame, least: float = 0.45) -> DataFrame:
    """(name, product_id, product, score) for each distinct name: the most similar product of the
    catalogue (product_id, name) by tokens, null where none is similar enough."""
    left = names.select("name").distinct().withColumn("t", tokens(F.col("name")))
    right = goods.groupBy(F.col("name").alias("product")).agg(F.min("product_id").alias("product_id")).withColumn("u", tokens(F.col("product")))
    pairs = top_sharing(left.withColumnRenamed("name", "id"), right.withColumnRenamed("product", "other"), lambda c, n, m: F.round(fuzzy_of(c, n, m), 4), 1)
    best = pairs.filter(F.col("score") >= least).join(right, F.col("other") == F.col("product")).select(F.col("id").alias("name"), F.struct("product_id", "product", "score").alias("r"))
    return left.select("name").join(best, "name", "left").select("name", "r.*")


def bridges(services: DataFrame, goods: DataFrame, least: float = 0.45) -> tuple[DataFrame, DataFrame]:
    """(documents, unresolved) of services (service, direction, packages: array of struct<name,
    offer_ids: array, products: array<string>>): each product resolved against the catalogue, offers and
    catalogue ids of all packages gathered; names without a product are reported with their package."""
    packages = services.select("service", F.posexplode("packages").alias("no", "p")).select("service", "no", "p.name", "p.offer_ids", "p.products")
    wanted = packages.select("service", "no", F.col("name").alias("package"), F.posexplode("products").alias("at", "name"))
    found = wanted.join(resolved_names(wanted, goods, least), "name", "left")
    unresolved = found.filter("product_id is null").select("service", "package", F.col("name").alias("product_name"))
    ids = found.groupBy("service").agg(F.array_sort(F.collect_set("product_id")).alias("product_ids"), F.count(F.lit(1)).alias("wanted"), F.count("product_id").alias("resolved"))
    offers = packages.select("service", F.explode("offer_ids").alias("o")).groupBy("service").agg(F.array_sort(F.collect_set("o")).alias("offer_ids"))
    parts = F.array_join(F.transform("packages", lambda p: F.concat(F.coalesce(p["name"], F.lit("")), F.lit(": "), F.array_join(p["products"], ", "))), "\n")
    out = services.join(ids, "service", "left").join(offers, "service", "left")
    text = F.concat_ws("\n", F.col("service"), F.concat(F.lit("direction: "), "direction"), parts, F.when(F.size("product_ids") > 0, F.concat(F.lit("products: "), F.array_join(F.transform("product_ids", lambda x: x.cast("string")), ", "))))
    documents = out.select(F.concat(F.lit("bridge_"), slug(F.col("service"))).alias("doc_id"), "service", "direction", text.alias("searchable_text"), "offer_ids", "product_ids", F.coalesce("wanted", F.lit(0)).alias("wanted"), F.coalesce("resolved", F.lit(0)).alias("resolved"))
    return documents, unresolved


def compositions(lines: DataFrame, goods: DataFrame, most: int = 15) -> DataFrame:
    """(dataset, deal_id, composition, known): a deal's ``most`` dearest lines with what the catalogue
    says of them, as 'name x quantity [section]'. Lists are cut before they are collected."""
    top = top_n(lines.select("dataset", "deal_id", "line", "product_id", "product_name", "quantity", "line_total"), ["dataset", "deal_id"], [F.desc("line_total"), F.col("line")], most)
    rows = top.join(goods.select("product_id", F.col("section").alias("_s")), "product_id", "left")
    item = F.concat(F.coalesce("product_name", F.lit("")), F.lit(" x"), F.col("quantity").cast("long"), F.when(F.col("_s") != "", F.concat(F.lit(" ["), "_s", F.lit("]"))).otherwise(""))
    listed = F.array_sort(F.collect_list(F.struct("rank", item.alias("s"))))
    return rows.groupBy("dataset", "deal_id").agg(F.array_join(F.transform(listed, lambda x: x["s"]), "; ").alias("composition"), F.count("_s").alias("known"))


def append_messages(messages: DataFrame, chats: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Messages with the new ones (chat_id, user_id, ...) whose chat belongs to the user, and chats with
    updated_at moved to their newest message."""
    own = new.join(chats.select("chat_id", "user_id"), ["chat_id", "user_id"], "left_semi")
    newest = own.groupBy("chat_id").agg(F.max("created_at").alias("_at"))
    touched = chats.join(newest, "chat_id", "left").withColumn("updated_at", F.greatest("updated_at", "_at")).drop("_at")
    return messages.unionByName(own.select(*messages.columns)), touched


def registered(users: DataFrame, new: DataFrame) -> DataFrame:
    """Users with the new ones whose username none has yet, pending; of equal new ones the first by id."""
    first = new.groupBy("username").agg(F.min_by(F.struct(*[c for c in users.columns if c not in ("username", "status")]), "user_id").alias("r"))
    fresh = first.join(users.select("username"), "username", "left_anti").select("username", "r.*", F.lit("pending").alias("status"))
    return users.unionByName(fresh.select(*users.columns))


def with_status(users: DataFrame, decisions: DataFrame) -> DataFrame:
    """Users after decisions (user_id, status, at): the newest one counts."""
    last = decisions.groupBy("user_id").agg(F.max_by("status", F.struct("at", "status")).alias("_s"))
    return users.join(last, "user_id", "left").withColumn("status", F.coalesce("_s", "status")).drop("_s")


def satisfaction(feedback: DataFrame, by: str) -> DataFrame:
    """Ratings and the share of positive ones (rating > 0) per group."""
    out = feedback.filter("rating is not null and rating <> 0").groupBy(by).agg(F.count(F.lit(1)).alias("ratings"), F.count_if(F.col("rating") > 0).alias("positive"))
    return out.withColumn("csat", F.round(F.col("positive") / F.col("ratings"), 4))
