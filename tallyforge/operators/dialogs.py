"""Conversations and feedback: as-of lookups, chat lists, dialog state, ratings, rules, upserts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tallyforge.operators.windows import latest, previous_where, top_n


def questions_of_answers(messages: DataFrame) -> DataFrame:
    """Every assistant message with the last user message before it in its chat."""
    out = previous_where(messages, "chat_id", [F.col("id")], F.col("content"), F.col("role") == "user", "question")
    return out.filter("role = 'assistant'")


def chat_list(messages: DataFrame) -> DataFrame:
    """Per chat: messages, first and last message time-ordered by id, roles that took part."""
    return messages.groupBy("chat_id").agg(
        F.count(F.lit(1)).alias("messages"),
        F.count_if(F.col("role") == "user").alias("user_messages"),
        F.max_by("content", "id").alias("last_message"),
        F.max("id").alias("last_id"),
        F.array_join(F.array_sort(F.collect_set("role")), "|").alias("roles"),
    )


def history(messages: DataFrame, n: int = 12) -> DataFrame:
    """The last n messages of each chat with their place, oldest first."""
    out = top_n(messages, ["chat_id"], [F.desc("id")], n, "back")
    return out.withColumn("place", F.row_number().over(W.partitionBy("chat_id").orderBy("id"))).drop("back")


def with_any(chats: DataFrame, marks: DataFrame, key: str) -> DataFrame:
    return chats.join(marks.select(key).distinct(), key, "left_semi")


def without_any(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return rows.join(done.select(key).distinct(), key, "left_anti")


def filtered(rows: DataFrame, conditions: dict[str, Column | None]) -> DataFrame:
    """Only the conditions that are given, all of them."""
    given = [c for c in conditions.values() if c is not None]
    return rows.filter(reduce(lambda a, b: a & b, given)) if given else rows


def upsert(stored: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Stored rows and new ones; of rows with the same key the newest stays, a new one on ties."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    return latest(both, keys, [F.desc(version), F.desc("_new")]).drop("_new")


def deleted(parents: DataFrame, children: DataFrame, gone: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Both tables without the parents in gone and what hangs on them."""
    return parents.join(gone.select(key), key, "left_anti"), children.join(gone.select(key), key, "left_anti")


def reseeded(rules: DataFrame, curated: DataFrame) -> DataFrame:
    """All stored rules inactive, the curated ones added as active."""
    return rules.withColumn("is_active", F.lit(0)).unionByName(curated.withColumn("is_active", F.lit(1)))


def active_rules(rules: DataFrame, groups: DataFrame, n: int = 5) -> DataFrame:
    """For each group the active rules that are general or its own, by priority, n at most."""
    general = rules.filter("is_active = 1 and direction is null").drop("direction")
    own = rules.filter("is_active = 1 and direction is not null")
    every = groups.join(own, "direction").select("direction", *general.columns).unionByName(groups.crossJoin(F.broadcast(general.orderBy(F.desc("priority"), "id").limit(n))).select("direction", *general.columns))
    return top_n(every, ["direction"], [F.desc("priority"), F.col("id")], n)


def turn_facts(turns: DataFrame, products: dict[str, str], negation: str) -> DataFrame:
    """turns with what each says: products named (_n), those within 30 characters after a negation (_r), the
    last one named and not refused (_c), a size (_s). products: name to pattern."""
    low = F.lower(F.coalesce("content", F.lit("")))
    named = F.filter(F.array(*[F.when(low.rlike(p), F.lit(k)) for k, p in products.items()]), lambda x: x.isNotNull())
    refused = F.filter(F.array(*[F.when(low.rlike(f"(?:{negation}).{{0,30}}(?:{p})"), F.lit(k)) for k, p in products.items()]), lambda x: x.isNotNull())
    size = F.regexp_extract(low, r"([0-9]+)\s*(?:cm|mm|m)(?![a-z])", 1)
    out = turns.withColumn("_n", named).withColumn("_r", refused).withColumn("_s", F.when(size != "", size))
    return out.withColumn("_c", F.when(F.size(F.array_except("_n", "_r")) > 0, F.element_at(F.array_except("_n", "_r"), -1)))


def dialog_state(turns: DataFrame, products: dict[str, str], negation: str) -> DataFrame:
    """State of each chat after each user turn: products mentioned so far, the product confirmed last,
    rejected ones (named within 30 characters after a negation), and whether a size is known.

    State is a running window over a chat's turns, in JVM expressions; ``streaming.dialogs`` keeps the
    same state of a stream.
    """
    w = W.partitionBy("chat_id").orderBy("id").rowsBetween(W.unboundedPreceding, 0)
    t = turn_facts(turns, products, negation)
    # a running maximum for each product: what is kept of earlier turns doesn't grow with them
    so_far = lambda c: F.filter(F.array(*[F.when(F.max(F.array_contains(c, k)).over(w), F.lit(k)) for k in sorted(products)]), lambda x: x.isNotNull())
    out = t.withColumn("mentioned", so_far("_n")).withColumn("rejected", so_far("_r"))
    return out.withColumn("confirmed", F.last("_c", ignorenulls=True).over(w)).withColumn("size", F.last("_s", ignorenulls=True).over(w)).filter("role = 'user'").drop("_n", "_r", "_s", "_c")


def parsed_query(text: Column, directions: dict[str, tuple]) -> dict[str, Column]:
    """Intent by precedence, direction by vote of term prefixes, and whether to ask back."""
    low = F.lower(F.coalesce(text, F.lit("")))
    has = lambda *terms: reduce(lambda a, b: a | b, [low.contains(t) for t in terms])
    intent = (
        F.when(has("how long", "when ", "deadline", "days"), "timeline")
        .when(has("bundle", "package", "together", " set "), "bundle")
        .when(has("policy", "discount", "barter", "return"), "policy")
        .when(has("advise", "recommend", "which ", "better"), "consulting")
        .when(has("price", "cost", "how much"), "product")
        .otherwise("general")
    )
    words = F.split(low, r"[^\p{L}\p{N}]+")
    starting = lambda p: F.size(F.filter(words, lambda w: w.startswith(p)))
    votes = {k: reduce(lambda a, b: a + b, [starting(p) for p in prefixes]) for k, prefixes in directions.items()}
    best = F.greatest(*votes.values(), F.lit(0))
    direction = F.coalesce(*[F.when((v == best) & (v > 0), F.lit(k)) for k, v in votes.items()])
    confidence = F.least(F.when(best == 0, 0.0).when(best >= 2, best / F.size(words) * 1.3).otherwise(best / F.size(words)), F.lit(1.0))
    return {"intent": intent, "direction": direction, "confidence": F.round(confidence, 4), "ask_back": (F.size(words) < 3) & (best == 0)}


def quantities(text: Column) -> dict[str, Column]:
    """Height in cm, hours, pieces, area and budget as a request states them."""
    low = F.lower(F.coalesce(text, F.lit("")))
    num = lambda p: F.regexp_replace(F.nullif(F.regexp_extract(low, p, 1), F.lit("")), ",", ".").try_cast("double")
    cm, mm, m = num(r"([0-9]+(?:[.,][0-9]+)?)\s*cm(?![a-z])"), num(r"([0-9]+(?:[.,][0-9]+)?)\s*mm(?![a-z])"), num(r"([0-9]+(?:[.,][0-9]+)?)\s*m(?![a-z0-9²])")
    area = F.coalesce(num(r"([0-9]+(?:[.,][0-9]+)?)\s*(?:m2|m²|sqm)"), num(r"([0-9]+)\s*x\s*[0-9]+\s*m(?![a-z])") * num(r"[0-9]+\s*x\s*([0-9]+)\s*m(?![a-z])"))
    budget = F.coalesce(num(r"([0-9]+(?:[.,][0-9]+)?)\s*k(?![a-z])") * 1000, num(r"(?:budget|up to)\s*([0-9]+(?:[.,][0-9]+)?)"))
    return {"height_cm": F.coalesce(cm, mm / 10, m * 100), "hours": num(r"([0-9]+)\s*(?:h|hours?)(?![a-z])"), "pieces": num(r"([0-9]+)\s*(?:pcs|pieces|x)(?![a-z0-9])"), "area": area, "budget": budget}


def complex_request(text: Column, signals: list[str], least: int = 2) -> Column:
    return reduce(lambda a, b: a + b, [text.rlike(p).cast("int") for p in signals]) >= least


def gates(total: Column, low: Column, high: Column, items: Column) -> dict[str, Column]:
    """What may be wrong with an estimate: too many items, a band too wide, a lower bound of zero."""
    explodes = (items > 25) | ((low > 0) & (high / low > 20)) | ((low == 0) & (total > 500_000))
    return {"explodes": F.coalesce(explodes, F.lit(False)), "confidence": F.when(explodes, "manual").when(high - low <= total * 0.3, "auto").otherwise("guided")}


def reconciled(quoted: Column, items_total: Column) -> Column:
    """The items' sum where the quote drifts from it by over 5 %, else the quote."""
    return F.when(F.abs(quoted - items_total) / F.greatest(quoted, F.lit(1.0)) > 0.05, items_total).otherwise(quoted)


def intent(text: Column, rules: list[tuple[str, str, bool]], has_history: Column) -> Column:
    """Name of the first rule whose pattern is found; a rule may ask for an earlier turn."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.coalesce(*[F.when(low.rlike(p) & (has_history if needs else F.lit(True)), F.lit(k)) for k, p, needs in rules], F.lit("general"))


def predicates(text: Column, patterns: dict[str, str]) -> dict[str, Column]:
    low = F.lower(F.coalesce(text, F.lit("")))
    return {k: low.rlike(p) for k, p in patterns.items()}


def components(requests: DataFrame, parts: dict[str, tuple[str, tuple]]) -> DataFrame:
    """(request_id, component, place): components that a text names and those they imply, in the
    order in which parts lists them. parts: name to (pattern, implied names)."""
    low = F.lower(F.coalesce("text", F.lit("")))
    order = F.array(*[F.lit(k) for k in parts])
    named = F.array(*[F.when(low.rlike(p), F.array(F.lit(k), *[F.lit(i) for i in more])) for k, (p, more) in parts.items()])
    every = F.array_distinct(F.flatten(F.filter(named, lambda x: x.isNotNull())))
    return requests.select("request_id", F.explode(every).alias("component")).withColumn("place", F.array_position(order, F.col("component")).cast("int"))


def linear_metres(letters: Column, height_cm: Column) -> Column:
    """Outline length of letters: 0.65 of their height each."""
    return F.round(letters * height_cm / 100 * 0.65 + 1e-9, 2)


def next_question(known: dict[str, Column]) -> Column:
    """The first thing that is not known yet, null if all is."""
    return F.coalesce(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in known.items()])


def final_price(candidates: list[tuple[str, Column, Column]]) -> dict[str, Column]:
    """The first source whose gate is open: its name, price, and the gates that were shut before it."""
    source = F.coalesce(*[F.when(gate & price.isNotNull(), F.lit(k)) for k, gate, price in candidates])
    price = F.coalesce(*[F.when(gate & price.isNotNull(), price) for _, gate, price in candidates])
    shut = F.filter(F.array(*[F.when(~F.coalesce(gate, F.lit(False)), F.lit(f"no_{k}")) for k, gate, _ in candidates]), lambda x: x.isNotNull())
    return {"source": F.coalesce(source, F.lit("manual")), "price": price, "flags": F.array_join(shut, "|")}


def drifts(stated: Column, computed: Column, most: float = 0.3) -> Column:
    return F.coalesce((computed > 0) & (F.abs(stated - computed) / computed > most), F.lit(False))
