"""Quality rules with adaptive thresholds from mergeable quantile sketches (DataFrame only).

Every text is measured once (words, symbols, repeated lines, repeated word triples). Documents that
pass the base rules fill KLL sketches of four measures per language and source; sketches of small
groups give way to the merged sketches of the language, then of everything. A document is kept if
each measure lies within its group's fence: the middle half of the group, extended on both sides by
``REACH`` times its width, where the width counts as ``LEAST`` at least (measures that are zero in
most documents have a middle half of no width).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.base import BLANK, WORD, Shared, let, look_up

REACH = 6.0
#: Least width of the middle half: symbols, repeated lines and repeated words per word, word length.
LEAST = {"symbols": 0.005, "lines": 0.005, "repeats": 0.05, "length": 0.25}
FEW = 40  # documents below which a group's sketch gives way to a merged one
SKETCH = 2048
_SPACE = " \t\n\x0b\x0c\r"


def _repeated(words: Column) -> Column:
    """Words that lie in a three-word window which the text has twice or more."""
    n = F.size(words)
    grams = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(words[i], words[i + 1], words[i + 2]))
    neighbours = lambda s: F.transform(
        s, lambda e, i: F.when(((i > 0) & (F.get(s, i - 1)["g"] == e["g"])) | ((i < F.size(s) - 1) & (F.get(s, i + 1)["g"] == e["g"])), e["p"])
    )
    places = lambda g: F.sort_array(F.filter(let(F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("g"), i.alias("p")))), neighbours), lambda p: p.isNotNull()))
    cover = lambda p: F.aggregate(
        p,
        F.struct(F.lit(0).alias("n"), F.lit(-1).alias("end")),
        lambda s, x: F.struct((s["n"] + x + 3 - F.greatest(x, s["end"])).alias("n"), (x + 3).alias("end")),
        lambda s: s["n"],
    )
    found = let(grams, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(let(places(g), cover)))
    return F.when(n < 4, F.lit(0)).otherwise(found)


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of each row of docs; a null text has none of anything."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    words = F.filter(F.split(text, BLANK), lambda w: w != "")
    counts = let(words, lambda w: F.struct(F.size(w).alias("n"), _repeated(w).alias("r")))
    rows = docs.select("doc_id", "lang", "source", text.alias("text")).select(
        "doc_id",
        "lang",
        "source",
        counts.alias("c"),
        F.length(F.translate("text", _SPACE, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    )
    rows = rows.select("doc_id", "lang", "source", F.col("c.n").cast("long").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", F.col("c.r").cast("long").alias("n_repeat_words"))
    return rows.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def _rates() -> dict[str, Column]:
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return {"symbols": F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1)), "lines": F.col("n_dup_lines") / n, "repeats": F.col("n_repeat_words") / n, "length": F.col("word_chars") / n}


def fences(measured: DataFrame, shared: Shared) -> DataFrame:
    """lang, source, and low_x and high_x of each measure, from sketches of rows past the base rules.

    One row per language and source of any row; every level of sketches is merged from the one
    below, so the rows are read once. Groups are reduced map-side, whatever their size.
    """
    names = list(LEAST)
    rates = measured.select("lang", "source", "base_failed", *[v.cast("double").alias(k) for k, v in _rates().items()])
    own = rates.groupBy("lang", "source").agg(F.count(F.when(~F.col("base_failed"), 1)).alias("n"), *[F.kll_sketch_agg_double(F.when(~F.col("base_failed"), F.col(k)), F.lit(SKETCH)).alias(k) for k in names])
    own = shared.save(own, "sketches")
    filled = own.filter("n > 0")
    merged = lambda by: (filled.groupBy(*by) if by else filled.groupBy()).agg(F.sum("n").alias("n"), *[F.kll_merge_agg_double(k, F.lit(SKETCH)).alias(k) for k in names])
    by_lang = shared.save(merged(["lang"]), "by_lang")
    out = look_up(own, by_lang.select("lang", F.col("n").alias("n2"), *[F.col(k).alias(f"{k}2") for k in names]), ["lang"])
    out = out.crossJoin(F.broadcast(merged([]).select(F.col("n").alias("n3"), *[F.col(k).alias(f"{k}3") for k in names])))  # one row
    bounds = []
    for k in names:
        sketch = F.when(F.col("n") >= FEW, F.col(k)).when(F.col("n2") >= FEW, F.col(f"{k}2")).when(F.col("n3") > 0, F.col(f"{k}3"))
        q1, q3 = (F.when(sketch.isNotNull(), F.kll_sketch_get_quantile_double(sketch, F.lit(q))) for q in (0.25, 0.75))
        width = REACH * F.greatest(q3 - q1, F.lit(LEAST[k]))
        bounds += [(q1 - width).alias(f"low_{k}"), (q3 + width).alias(f"high_{k}")]
    return shared.save(out.select("lang", "source", *bounds), "fences")


def quality(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed and kept, a row for each row of docs (doc_id, text, lang,
    source). Null languages and sources are groups of their own; where no document at all passes the
    base rules, no fence exists and none is kept."""
    shared = Shared(docs.sparkSession, "quality")
    rows = shared.save(measures(docs), "measures")
    out = look_up(rows, fences(rows, shared), ["lang", "source"])
    inside = F.lit(True)
    for k, v in _rates().items():
        inside = inside & F.coalesce(v.between(F.col(f"low_{k}"), F.col(f"high_{k}")), F.lit(False))
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return out.select(*names, (~F.col("base_failed") & inside).alias("kept"))


#: Exact quantiles stand in for the sketches, which are exact up to SKETCH values a group.
ORACLE = r"""
with d as (select doc_id, lang, source, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
g as (select doc_id, unnest(list_transform(range(1, len(w) - 1), lambda i: {'i': i, 's': w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]})) as u from d where len(w) > 2),
h as (select doc_id, u.i as i, count(*) over (partition by doc_id, u.s) as c from g),
r as (select doc_id, count(distinct p)::bigint as n_repeat_words from (select doc_id, unnest([i, i + 1, i + 2]) as p from h where c > 1) group by 1),
ln as (select doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from d),
m as (select d.doc_id, lang, source, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
    (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words
    from d join ln using (doc_id) left join r using (doc_id)),
f as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
    n_symbols / greatest(word_chars, 1)::double as s, n_dup_lines / greatest(n_words, 1)::double as u, n_repeat_words / greatest(n_words, 1)::double as v, word_chars / greatest(n_words, 1)::double as z from m),
o as (select * from f where not base_failed),
q1 as (select lang, source, count(*) as n, quantile_disc(s, [0.25, 0.75]) as s, quantile_disc(u, [0.25, 0.75]) as u, quantile_disc(v, [0.25, 0.75]) as v, quantile_disc(z, [0.25, 0.75]) as z from o group by 1, 2),
q2 as (select lang, count(*) as n, quantile_disc(s, [0.25, 0.75]) as s, quantile_disc(u, [0.25, 0.75]) as u, quantile_disc(v, [0.25, 0.75]) as v, quantile_disc(z, [0.25, 0.75]) as z from o group by 1),
q3 as (select quantile_disc(s, [0.25, 0.75]) as s, quantile_disc(u, [0.25, 0.75]) as u, quantile_disc(v, [0.25, 0.75]) as v, quantile_disc(z, [0.25, 0.75]) as z from o),
j as (select f.*, case when q1.n >= 40 then q1.s when q2.n >= 40 then q2.s else q3.s end as qs, case when q1.n >= 40 then q1.u when q2.n >= 40 then q2.u else q3.u end as qu,
    case when q1.n >= 40 then q1.v when q2.n >= 40 then q2.v else q3.v end as qv, case when q1.n >= 40 then q1.z when q2.n >= 40 then q2.z else q3.z end as qz
    from f left join q1 on q1.lang = f.lang and q1.source = f.source left join q2 on q2.lang = f.lang cross join q3)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed
    and s between qs[1] - 6 * greatest(qs[2] - qs[1], 0.005) and qs[2] + 6 * greatest(qs[2] - qs[1], 0.005)
    and u between qu[1] - 6 * greatest(qu[2] - qu[1], 0.005) and qu[2] + 6 * greatest(qu[2] - qu[1], 0.005)
    and v between qv[1] - 6 * greatest(qv[2] - qv[1], 0.05) and qv[2] + 6 * greatest(qv[2] - qv[1], 0.05)
    and z between qz[1] - 6 * greatest(qz[2] - qz[1], 0.25) and qz[2] + 6 * greatest(qz[2] - qz[1], 0.25) as kept
from j
"""
