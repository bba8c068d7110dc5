"""Requests: what they are after, which products they name, and which documents may answer them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.intents import COLLISIONS, RULES, STEMS, STRATEGIES, Rule
from tallyforge.operators.windows import keep_if_any, top_n


def _found(text: Column, *patterns: str) -> Column:
    return text.rlike("(?iuU)" + "|".join(f"(?:{p})" for p in patterns))


def stems_in(text: Column, stems: Sequence[str] = STEMS) -> Column:
    """Stems that a text holds, in the order of the table; of a null text none."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.filter(F.array(*[F.lit(s) for s in stems]), lambda s: F.contains(low, s))


def request_intent(text: Column, has_history: Column, rules: Sequence[Rule] = RULES, stems: Sequence[str] = STEMS) -> Column:
    """(intent, confidence, source) of a request by the first rule that holds.

    Blank and null requests are ``underspec``; those that no rule knows ``general`` with confidence 0.3
    and source "default", to be looked up among prototypes (``retrieval.nearest_label``). A null
    has_history counts as none.
    """
    out = lambda intent, sure, source="regex": F.struct(F.lit(intent).alias("intent"), F.lit(sure).alias("confidence"), F.lit(source).alias("source"))
    said = F.coalesce(text, F.lit(""))
    names_product = reduce(lambda a, b: a | b, [F.lower(said).contains(s) for s in stems])
    chain = F.when(~said.rlike(r"(?U)\S"), out("underspec", 0.99))
    for r in rules:
        holds = _found(said, *r.patterns)
        if r.unless:
            holds = holds & ~_found(said, r.unless)
        if r.first_only:
            holds = holds & ~F.coalesce(has_history, F.lit(False))
        if r.price:
            priced = _found(said, r.price)
            chain = chain.when(holds & priced & names_product, out("product_query", 0.85, "regex_hybrid"))
            holds = holds & ~priced if r.strict else holds
        chain = chain.when(holds, out(r.intent, r.confidence))
    return chain.otherwise(out("general", 0.3, "default"))


def without_collisions(results: DataFrame, request: str, text: str, by: list[str], table: dict[str, tuple[str, ...]] = COLLISIONS) -> DataFrame:
    """Results (by, request text, document text, ...) without those that name a product which the request
    is often mistaken for, and not the one it asks for; where that would leave a request without any
    result, all its results stay. Null texts name nothing."""
    # each text is lowered once, and only stems that a request names are looked for in its documents
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    rows = results.withColumns({"_asked": low(request), "_said": low(text)})
    some = lambda conds: reduce(lambda a, b: a | b, conds, F.lit(False))
    said = lambda stems: some([F.contains("_said", F.lit(s)) for s in stems])
    named = {k: F.contains("_asked", F.lit(k)) for k in table}
    passes = some([named[k] & said([k]) for k in table]) | ~some([named[k] & said(v) for k, v in table.items()])
    # texts don't travel to the window: what they say of a row is one column
    rows = rows.withColumn("_fits", passes).drop("_asked", "_said")
    return keep_if_any(rows, by, F.col("_fits"), F.lit(0), None).drop("_fits")


def strategy(intent: Column, default_k: int, table: dict[str, tuple[tuple[str, ...], int]] = STRATEGIES) -> Column:
    """(doc_types, k) for an intent: the kinds of document to search and the number wanted, default_k at
    most; doc_types is null (any kind) for an intent without a strategy."""
    chosen = F.coalesce(
        *[F.when(intent == name, F.struct(F.array(*[F.lit(t) for t in types]).alias("doc_types"), F.lit(min(k, default_k)).alias("k"))) for name, (types, k) in table.items()],
        F.struct(F.lit(None).cast("array<string>").alias("doc_types"), F.lit(default_k).alias("k")),
    )
    return chosen


def by_strategy(results: DataFrame, default_k: int, overfetch: int = 2, height_of: str = "smeta_request", near: float = 0.3) -> DataFrame:
    """Of scored results (query_id, intent, height_cm of the request, doc_id, doc_type, letter_height_cm,
    score) the best ``overfetch`` times k of each request among the kinds that its intent asks for, with
    their rank. A request of intent ``height_of`` that states a height takes only documents whose own
    height lies within ``near`` of it; a document without height is then left out. Ties go by doc_id.

    Filters come before ranking; the rank limit is applied map-side first."""
    plan = strategy(F.col("intent"), default_k)
    rows = results.withColumn("_s", plan).filter("_s.doc_types is null or array_contains(_s.doc_types, doc_type)")
    asks = (F.col("intent") == height_of) & (F.coalesce("height_cm", F.lit(0)) > 0)
    fits = F.col("letter_height_cm").between(F.col("height_cm") * (1 - near), F.col("height_cm") * (1 + near))
    rows = rows.filter(~F.coalesce(asks, F.lit(False)) | F.coalesce(fits, F.lit(False)))
    most = overfetch * max(default_k, 1)
    return top_n(rows, ["query_id"], [F.desc("score"), F.col("doc_id")], most).filter(F.col("rank") <= overfetch * F.col("_s.k")).drop("_s")


def boosted_lessons(all_best: DataFrame, same_best: DataFrame, k: int = 3, bonus: float = 0.1, least: float = 0.45) -> DataFrame:
    """(query_id, doc_id, score, rank): the k best lessons of each query by cosine and a bonus for those of
    the query's own direction, ``least`` and more.

    all_best and same_best: the k best (query_id, doc_id, score) of all lessons and of those of the same
    direction; no other lesson can be among the k best with the bonus. Both hold k rows a query."""
    same = same_best.select("query_id", "doc_id", (F.col("score") + bonus).alias("score"))
    rows = all_best.select("query_id", "doc_id", "score").unionByName(same).groupBy("query_id", "doc_id").agg(F.round(F.max("score"), 6).alias("score"))
    return top_n(rows.filter(F.col("score") >= least), ["query_id"], [F.desc("score"), F.col("doc_id")], k)


def with_match_counts(lessons: DataFrame, matches: DataFrame) -> DataFrame:
    """Lessons with match_count raised by the number of matches (doc_id); null counts as 0. Matches are
    counted before they are joined, so a lesson that everything matches is one row of the join."""
    n = matches.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n"))
    out = lessons.join(n, "doc_id", "left")
    return out.withColumn("match_count", F.coalesce("match_count", F.lit(0)) + F.coalesce("_n", F.lit(0))).drop("_n")


def lessons_by_direction(lessons: DataFrame) -> DataFrame:
    """(direction, lessons): how many lessons each direction has; those without one are left out."""
    named = lessons.filter(F.coalesce(F.col("direction"), F.lit("")) != "")
    return named.groupBy("direction").agg(F.count(F.lit(1)).alias("lessons"))
