"""Similarity joins of names that never compare all pairs.

* ``edit_pairs``: edit similarity. Short strings meet at what is left of both when the characters are
  deleted that edits may touch, so beginnings that all of them share make no pairs. Of longer ones the
  right side is cut into one segment more than the edits allowed, so one of them lies unchanged in any
  string near enough, at a place that the edits before and after it bound. Both are equi-joins.
* ``set_pairs``: overlap, Jaccard or containment from a bound on. Tokens are put in one order, rarest
  first; two sets near enough share a token among the first few of each.
* ``top_sharing``: the best n partners that share a token, without a bound. Rare tokens are joined; of
  pairs that share frequent tokens only, the score depends on these and the sizes alone, so classes
  of equal ones are compared, each with its n first names.

All of them return what a comparison of all pairs would.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.operators.windows import top_n

#: A token that more names of the right side have is frequent.
FREQUENT = 200
#: Strings that have more remains after deletions are compared by segments.
REMAINS = 1000


def _edits(least: float, longer: Column) -> Column:
    """How many edits a ratio from ``least`` on allows strings of which the longer has this length."""
    return F.floor(longer * F.lit(1 - least) + F.lit(1e-6)).cast("int")


def _key(m: Column, edits: Column, i: Column, segment: Column) -> Column:
    return F.xxhash64(m, edits, i, segment)


def edit_pairs(left: DataFrame, right: DataFrame, a: str, b: str, least: float, distance: str = "edits") -> DataFrame:
    """Pairs of rows (all columns of both, whose names differ) whose strings a and b have an edit ratio of at least ``least``
    (above 0.5): 1 - edits / length of the longer. ``distance`` is the number of edits.

    Null and empty strings have no pairs. Pairs whose longer string has at most ``REMAINS`` remains after
    the deletions allowed meet at one of these; near strings share one, strings of equal beginnings only
    do not. Longer ones meet at a segment: a right string has a segment row for every number of edits
    that lengths within the ratio allow; a left one has a row for every substring that may be such a
    segment. Both grow with the square of the edits allowed, so this is for names, not for texts.
    Equal strings meet once: rows are brought back to the distinct pairs.
    """
    if not 0.5 < least <= 1:
        raise ValueError("least must lie above 0.5, up to 1: below, a segment can be empty")
    x = left.filter(F.length(a) > 0).select(F.col(a).alias("_x")).distinct()
    y = right.filter(F.length(b) > 0).select(F.col(b).alias("_y")).distinct()
    x, y = spread(x, "_x"), spread(y, "_y")
    allowed = lambda n: math.floor(n * (1 - least) + 1e-6)
    short = next(n for n in range(1, 1 << 20) if math.comb(n + 1, allowed(n + 1)) > REMAINS or n == 1 << 10)
    near = _remains_pairs(x, y, lambda n: F.sequence(n, F.least(F.floor(n / F.lit(least) + F.lit(1e-6)).cast("int"), F.lit(short))), lambda n: _edits(least, n), allowed(short), short, distance)
    near = near.unionByName(_segment_pairs(x, y, least, short, distance))
    near = near.filter(F.col(distance) <= _edits(least, F.greatest(F.length("_x"), F.length("_y")))).distinct()
    return left.join(near, F.col(a) == F.col("_x")).join(right, F.col(b) == F.col("_y")).select(*left.columns, *right.columns, distance)


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Rows of few bytes that are about to be multiplied, dealt to all shuffle partitions."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def _remains(s: Column, k: Column, most: int) -> Column:
    """The distinct strings left of s (of k characters at least) when k of them, at most ``most``, are deleted."""
    some, out = F.array(s), F.when(k == 0, F.array(s))
    for i in range(1, most + 1):
        some = F.array_distinct(F.flatten(F.transform(some, lambda t: F.transform(F.sequence(F.lit(1), F.length(t)), lambda j: F.concat(F.substr(t, F.lit(1), j - 1), F.substr(t, j + 1))))))
        out = out.when(k == i, some)
    return out


def _remains_pairs(x: DataFrame, y: DataFrame, longer: Callable[[Column], Column], edits: Callable[[Column], Column], most: int, short: int, distance: str) -> DataFrame:
    """(_x, _y, distance), maybe repeated, of strings of at most ``short`` characters and ``most`` edits at most.

    ``longer`` gives the lengths that the longer one of a pair with a string of this length may have, ``edits``
    the edits that such a length allows. Two strings so near keep a common string of that length less the edits.
    """
    def rows(s, c):
        s = s.filter(F.length(c) <= short).withColumn("_l", F.explode(longer(F.length(c))))
        left_over = F.greatest(F.col("_l") - edits(F.col("_l")), F.lit(0))
        s = s.withColumn("_d", F.explode(_remains(F.col(c), F.greatest(F.length(c) - left_over, F.lit(0)), most)))
        return s.select(c, F.col("_l").alias(f"_l{c}"), F.xxhash64("_l", "_d").alias("_k"))

    met = rows(x, "_x").join(rows(y, "_y").hint("merge"), "_k")
    met = met.filter((F.col("_l_x") == F.col("_l_y")) & (F.col("_l_x") == F.greatest(F.length("_x"), F.length("_y"))))
    return met.select("_x", "_y", F.levenshtein("_x", "_y", most).cast("int").alias(distance)).filter(F.col(distance) >= 0)


def within_edits(left: DataFrame, right: DataFrame, a: str, b: str, edits: int, common: int = 0) -> DataFrame:
    """Pairs of rows (all columns of both) of distinct strings a and b with at most ``edits`` edits between
    them. The first ``common`` characters must be the same in all strings; they are left out."""
    x = spread(left.select(F.substr(a, F.lit(common + 1)).alias("_x")).distinct(), "_x")
    y = spread(right.select(F.substr(b, F.lit(common + 1)).alias("_y")).distinct(), "_y")
    near = _remains_pairs(x, y, lambda n: F.sequence(n, n + edits), lambda n: F.lit(edits), edits, 1 << 30, "_edits").select("_x", "_y").distinct()
    return left.join(near, F.substr(a, F.lit(common + 1)) == F.col("_x")).join(right, F.substr(b, F.lit(common + 1)) == F.col("_y")).select(*left.columns, *right.columns)


def _segment_pairs(x: DataFrame, y: DataFrame, least: float, short: int, distance: str) -> DataFrame:
    """(_x, _y, distance), maybe repeated, of strings the longer of which has more than ``short`` characters."""
    lengths = lambda n: F.filter(F.sequence(F.ceil(n * F.lit(least) - F.lit(1e-6)).cast("int"), F.floor(n / F.lit(least) + F.lit(1e-6)).cast("int")), lambda q: F.greatest(q, n) > short)
    m, n = F.length("_y"), F.length("_x")
    start = lambda i, m, k: i * F.floor(m / k).cast("int") + F.greatest(i - (k - m % k), F.lit(0)) + 1
    size = lambda i, m, k: F.floor(m / k).cast("int") + (i >= k - m % k).cast("int")
    # right: every number of edits, every segment
    y = y.withColumn("_e", F.explode(F.array_distinct(F.transform(lengths(m), lambda q: _edits(least, F.greatest(q, m))))))
    y = y.withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_e"))))
    k = F.col("_e") + 1
    y = y.select("_y", _key(m, F.col("_e"), F.col("_i"), F.substr("_y", start(F.col("_i"), m, k), size(F.col("_i"), m, k))).alias("_k"))
    # left: every length of the right side, every segment of it, every place where it may lie
    x = x.withColumn("_m", F.explode(lengths(n))).withColumn("_e", _edits(least, F.greatest(F.col("_m"), n)))
    x = x.withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_e"))))
    p, s = start(F.col("_i"), F.col("_m"), k), size(F.col("_i"), F.col("_m"), k)
    x = x.withColumn("_p", p).withColumn("_s", s)
    shift, before, after = n - F.col("_m"), F.col("_i"), F.col("_e") - F.col("_i")
    low = F.greatest(F.lit(1), F.col("_p") - before, F.col("_p") + shift - after)
    high = F.least(n - F.col("_s") + 1, F.col("_p") + before, F.col("_p") + shift + after)
    x = x.withColumn("_at", F.explode(F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))))
    x = x.select("_x", _key(F.col("_m"), F.col("_e"), F.col("_i"), F.substr("_x", F.col("_at"), F.col("_s"))).alias("_k")).distinct()
    d = F.levenshtein(F.col("_x"), F.col("_y"), 1 << 20)
    return x.join(y, "_k").filter(F.greatest(n, m) > short).select("_x", "_y", d.cast("int").alias(distance))


# --- sets -----------------------------------------------------------------------------------------


def by_rarity(sets: DataFrame, tokens: str, often: DataFrame, key: list[str]) -> DataFrame:
    """key, and the tokens of each row from the rarest on (``often``: token, n), those of equal rarity by name."""
    rows = sets.select(*key, F.explode(F.array_distinct(tokens)).alias("token")).join(often, "token")
    return rows.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "token"))), lambda x: x["token"]).alias("_r"))


def _least_common(kind: str, t: float, n: Column, m: Column) -> Column:
    """How many common tokens sets of n and m tokens need."""
    of = {"overlap": F.greatest(n, m) * F.lit(t), "jaccard": (n + m) * F.lit(t / (1 + t)), "containment": F.least(n, m) * F.lit(t)}[kind]
    return F.greatest(F.ceil(of - F.lit(1e-9)).cast("int"), F.lit(1))


def set_pairs(left: DataFrame, right: DataFrame, kind: str, least: float) -> DataFrame:
    """(id, other, common, score) of left (id, t) and right (other, u), sets of tokens, with a score from
    ``least`` on (above 0): common tokens over those of the larger set (overlap), of both together
    (jaccard), or of the smaller set (containment).

    Each set enters the join with its first tokens only, as many as may all be missing and one more; of
    the smaller set for containment, where the larger one enters with all. A pair is formed at its first
    common token, if sizes and the places of that token leave room for enough common ones. Null and
    empty sets have no pairs; repeated ids are rows of their own only if their sets differ.
    """
    if not 0 < least <= 1:
        raise ValueError("least must lie above 0, up to 1")
    a, b = left.select("id", F.array_distinct("t").alias("t")).distinct(), right.select("other", F.array_distinct("u").alias("u")).distinct()
    words = a.select(F.explode("t").alias("token")).unionAll(b.select(F.explode("u").alias("token")))
    often = words.groupBy("token").agg(F.count("*").alias("n"))
    x, y = by_rarity(a, "t", often, ["id", "t"]).select("id", F.col("_r").alias("t")), by_rarity(b, "u", often, ["other", "u"]).select("other", F.col("_r").alias("u"))
    n, m = F.size("t"), F.size("u")
    first = lambda size: size - F.greatest(F.ceil(size * F.lit(least) - F.lit(1e-9)).cast("int"), F.lit(1)) + 1
    out = None
    for short_x, short_y in [(True, False), (False, True)] if kind == "containment" else [(True, True)]:
        p = x.select("*", F.posexplode(F.slice("t", F.lit(1), first(n)) if short_x else F.col("t")).alias("_i", "_w"))
        q = y.select("*", F.posexplode(F.slice("u", F.lit(1), first(m)) if short_y else F.col("u")).alias("_j", "_w"))
        need = _least_common(kind, least, n, m)
        sized = {"overlap": F.least(n, m) >= F.greatest(n, m) * F.lit(least) - F.lit(1e-9), "jaccard": F.least(n, m) >= F.greatest(n, m) * F.lit(least) - F.lit(1e-9), "containment": (n <= m) if short_x else (n > m)}[kind]
        room = F.least(n - F.col("_i"), m - F.col("_j")) >= need
        pairs = p.join(q, "_w").filter(sized & room)
        both = F.array_intersect("t", "u")
        pairs = pairs.withColumn("_c", both).filter((F.col("_c")[0] == F.col("_w")) & (F.size("_c") >= need))
        out = pairs if out is None else out.unionByName(pairs)
    c = F.size("_c")
    score = {"overlap": c / F.greatest(n, m), "jaccard": c / (n + m - c), "containment": c / F.least(n, m)}[kind]
    return out.select("id", "other", c.alias("common"), F.round(score, 6).alias("score"))


def fuzzy_of(common: Column, n: Column, m: Column) -> Column:
    """0.7 of the Jaccard similarity and 0.3 of the containment of the smaller set, from their common tokens."""
    c = F.size(common).cast("double")
    return 0.7 * c / (n + m - c) + 0.3 * c / F.least(n, m)


Score = Callable[[Column, Column, Column], Column]


def _split(rows: DataFrame, tokens: str, frequent: DataFrame, key: list[str]) -> DataFrame:
    """rows with their rare tokens, their frequent ones (both sorted) and the number of all."""
    each = rows.select(*key, F.explode_outer(tokens).alias("token")).join(frequent, "token", "left")
    some = lambda cond: F.array_sort(F.collect_list(F.when(cond, F.col("token"))))
    return each.groupBy(*key).agg(some(F.col("n").isNull()).alias("_rare"), some(F.col("n").isNotNull()).alias("_often"), F.count("token").cast("int").alias("_size"))


def top_sharing(left: DataFrame, right: DataFrame, score: Score, n: int, left_by: tuple[str, ...] = (), right_by: tuple[str, ...] = (), frequent: int = FREQUENT) -> DataFrame:
    """(id, *left_by, other, *right_by, score, rank): for each distinct row of left (id, *left_by, t) the
    n best rows of right (other, *right_by, u) that share a token, by score, then by name.

    score(common tokens, size of t, size of u) may also read left_by and right_by; it must not fall
    when common tokens are added. t and u are sets; rows that share none have no pair.
    """
    mine, theirs = ["id", *left_by], ["other", *right_by]
    left, right = left.select(*mine, F.array_distinct("t").alias("t")).distinct(), right.select(*theirs, F.array_distinct("u").alias("u")).distinct()
    often = right.select(F.explode("u").alias("token")).groupBy("token").agg(F.count("*").alias("n")).filter(F.col("n") > frequent)
    x = _split(left, "t", often, mine).withColumnsRenamed({"_rare": "_rx", "_often": "_ox", "_size": "_nx"})
    y = _split(right, "u", often, theirs).withColumnsRenamed({"_rare": "_ry", "_often": "_oy", "_size": "_ny"})
    # pairs with a rare token, at the first one that they share: a token has ``frequent`` partners at most
    rare = x.withColumn("_w", F.explode("_rx")).join(y.withColumn("_w", F.explode("_ry")), "_w")
    both = F.array_intersect("_rx", "_ry")
    rare = rare.filter(F.array_min(both) == F.col("_w"))
    rare = rare.select(*mine, *theirs, score(F.concat(both, F.array_intersect("_ox", "_oy")), F.col("_nx"), F.col("_ny")).alias("score"))
    # the rest shares frequent tokens only: rows with the same of them, size and other columns are one class
    cx, cy = ["_ox", "_nx", *left_by], ["_oy", "_ny", *right_by]
    kinds = y.filter(F.size("_oy") > 0).withColumn("_s", F.pmod(F.xxhash64("other"), F.lit(64)))
    kinds = top_n(kinds.select(*cy, "other", "_s"), [*cy, "_s"], [F.col("other")], n).drop("rank", "_s")
    kinds = top_n(kinds, cy, [F.col("other")], n).groupBy(*cy).agg(F.collect_list("other").alias("_others"))  # n at most
    same = x.filter(F.size("_ox") > 0).select(*cx).distinct().withColumn("_w", F.explode("_ox")).join(kinds.withColumn("_w", F.explode("_oy")), "_w")
    both = F.array_intersect("_ox", "_oy")
    same = same.filter(F.array_min(both) == F.col("_w")).withColumn("score", score(both, F.col("_nx"), F.col("_ny")))
    same = top_n(same.select(*cx, *right_by, F.explode("_others").alias("other"), "score"), cx, [F.desc("score"), *[F.col(c) for c in theirs]], n)
    cond = F.lit(True)
    for c in cx:
        cond = cond & x[c].eqNullSafe(F.col(f"_k{c}"))
    same = x.join(same.drop("rank").withColumnsRenamed({c: f"_k{c}" for c in cx}), cond)
    pairs = rare.unionByName(same.select(*mine, *theirs, "score")).groupBy(*mine, *theirs).agg(F.max("score").alias("score"))
    return top_n(pairs, mine, [F.desc("score"), *[F.col(c) for c in theirs]], n)
