"""Fuzzy links between names, and shapes of nested values.

Where a score needs a common token, pairs come from an equi-join on tokens, formed at the first common
token only; where the best few partners are asked for, frequent tokens make no pairs
(``similarity.top_sharing``). Edit similarity goes by segment signatures (``similarity.edit_pairs``).
Texts are compared once, however many rows have them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.operators.similarity import edit_pairs, top_sharing
from tallyforge.operators.windows import top_n


def sharing_a_token(left: DataFrame, right: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs of rows whose token lists a and b meet."""
    x, y = left.withColumn("_w", F.explode(a)), right.withColumn("_w", F.explode(b))
    return x.join(y, "_w").filter(F.array_min(F.array_intersect(a, b)) == F.col("_w")).drop("_w")


def edit_ratio(x: Column, y: Column) -> Column:
    n = F.greatest(F.length(x), F.length(y))
    return F.when(n > 0, 1 - F.levenshtein(x, y) / n).otherwise(0.0)


def token_set_ratio(a: Column, b: Column) -> Column:
    """0 to 100: the best edit ratio of the common tokens, and of those with either side's own."""
    text = lambda t: F.array_join(F.array_sort(t), " ")
    common = text(F.array_intersect(a, b))
    left, right = F.trim(F.concat_ws(" ", common, text(F.array_except(a, b)))), F.trim(F.concat_ws(" ", common, text(F.array_except(b, a))))
    some = F.when(common != "", F.greatest(edit_ratio(common, left), edit_ratio(common, right))).otherwise(0.0)
    return F.round(100 * F.greatest(edit_ratio(left, right), some), 2)


def ratio_links(left: DataFrame, right: DataFrame, least: float, n: int) -> DataFrame:
    """(id, other, score, rank) of left (id, t) and right (other, u) from ``least`` on, n at most.
    Pairs without a common token count too, by the edit ratio of their sorted tokens."""
    near = sharing_a_token(left, right, "t", "u").select("id", "other", token_set_ratio(F.col("t"), F.col("u")).alias("score"))
    plain = lambda t: F.array_join(F.array_sort(t), " ")
    a = left.withColumn("_a", plain("t"))
    b = right.select("other", "u", plain("u").alias("_b"))
    # half a unit of the second decimal less, since scores are rounded
    far = edit_pairs(a, b, "_a", "_b", (least - 0.005) / 100).filter(~F.arrays_overlap("t", "u"))
    far = far.filter(F.round(100 * edit_ratio(F.col("_a"), F.col("_b")), 2) >= least)
    pairs = near.unionByName(far.select("id", "other", token_set_ratio(F.col("t"), F.col("u")).alias("score")))
    return top_n(pairs.filter(F.col("score") >= least), ["id"], [F.desc("score"), F.col("other")], n)


def noise_aware_match(left: DataFrame, right: DataFrame, noise: tuple[str, ...]) -> DataFrame:
    """Best (id, other, score): ten for each common token that is no noise word, one for each common
    token of any kind."""
    words = F.array(*[F.lit(w) for w in noise])
    score = lambda both, n, m: (10 * F.size(F.array_except(both, words)) + F.size(both)).cast("long")
    return top_sharing(left, right, score, 1).select("id", "other", "score")


def unwrapped(json: Column) -> Column:
    """The plain value of a JSON cell: an array's first element, an object's ``value`` or only field,
    a scalar as it is; nested wrappers are opened twice."""
    out = json
    for _ in range(2):
        only = F.when(F.size(F.json_object_keys(out)) == 1, F.map_values(F.from_json(out, "map<string,string>"))[0])
        out = F.coalesce(F.get_json_object(out, "$[0]"), F.get_json_object(out, "$.value"), only, out)
    return F.regexp_replace(out, '^"|"$', "")


def section_fallback(chunks: DataFrame, key: str, fields: dict[str, str]) -> DataFrame:
    """Each field of a chunk (its own, where the title names it), else that of the whole file."""
    own = {k: F.when(F.lower("title").contains(t), F.col("body")) for k, t in fields.items()}
    rows = chunks.withColumns({f"_{k}": v for k, v in own.items()})
    whole = rows.groupBy(key).agg(*[F.min_by(F.col(f"_{k}"), F.when(F.col(f"_{k}").isNotNull(), F.col("chunk"))).alias(f"_f{k}") for k in fields])
    out = rows.join(whole, key)
    return out.select(key, "chunk", "title", *[F.coalesce(f"_{k}", f"_f{k}").alias(k) for k in fields])


def two_by_two(rows: DataFrame, a: Column, b: Column) -> DataFrame:
    return rows.agg(F.count_if(a & b).alias("both"), F.count_if(a & ~b).alias("only_old"), F.count_if(~a & b).alias("only_new"), F.count_if(~a & ~b).alias("neither"))


def rebalanced(prototypes: DataFrame, moves: list[tuple[str, str]], text: str, label: str, most: int) -> DataFrame:
    """Prototypes moved to the label of the first rule whose pattern they match, each text once a
    label, ``most`` a label by text."""
    to = F.coalesce(*[F.when(F.lower(text).rlike(p), F.lit(k)) for p, k in moves], F.col(label))
    moved = prototypes.withColumn(label, to).dropDuplicates([label, text])
    return top_n(moved, [label], [F.col(text)], most)
