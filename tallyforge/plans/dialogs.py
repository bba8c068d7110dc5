"""Queries on conversations, labels and events: dialogs, feedback, evaluation, training data."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.operators import dialogs as D
from tallyforge.operators import evaluation as E
from tallyforge.sources.roles import table

Q: dict = {}
O: dict = {}


def query(sql: str | None = None):
    def keep(f):
        Q[f.__name__] = f
        if sql:
            O[f.__name__] = sql
        return f

    return keep


def _messages(spark, d):
    c = table(spark, d, "conversations")
    return c.select(F.col("conv_id").alias("chat_id"), F.col("turn").alias("id"), "role", F.col("text").alias("content"))


MSG = "with m as (select conv_id as chat_id, turn as id, role, text as content from conversations)"


@query(MSG + ", x as (select *, last_value(case when role = 'user' then content end ignore nulls) over (partition by chat_id order by id rows between unbounded preceding and 1 preceding) as question from m) select chat_id, id, content, question from x where role = 'assistant'")
def answers_with_questions(spark, d):
    return D.questions_of_answers(_messages(spark, d)).select("chat_id", "id", "content", "question")


@query(MSG + " select chat_id, count(*) as messages, count(*) filter (role = 'user') as user_messages, arg_max(content, id) as last_message, max(id) as last_id, array_to_string(list_sort(list(distinct role)), '|') as roles from m group by 1")
def chat_list(spark, d):
    return D.chat_list(_messages(spark, d))


@query(MSG + ", b as (select *, row_number() over (partition by chat_id order by id desc) as back from m) select chat_id, id, role, content, row_number() over (partition by chat_id order by id) as place from b where back <= 4")
def last_turns(spark, d):
    return D.history(_messages(spark, d), 4)


@query(MSG + ", s as (select distinct chat_id from m where role = 'system') select m.chat_id, count(*) as n, chat_id in (select chat_id from s) as with_system from m group by 1")
def chats_with_system(spark, d):
    m = _messages(spark, d)
    marks = m.filter("role = 'system'")
    per = m.groupBy("chat_id").agg(F.count(F.lit(1)).alias("n"))
    yes, no = D.with_any(per, marks, "chat_id"), D.without_any(per, marks, "chat_id")
    return yes.withColumn("with_system", F.lit(True)).unionByName(no.withColumn("with_system", F.lit(False)))


@query(
    """with r as (select user_id, event_type, value, ts, event_id from events),
s as (select *, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) as rn from r) select user_id, event_type, event_id, value from s where rn = 1"""
)
def feedback_upsert(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type", "value", F.struct("ts", "event_id").alias("version"), "event_id")
    out = D.upsert(e.filter("event_id % 2 = 0"), e.filter("event_id % 2 = 1"), ["user_id", "event_type"], "version")
    return out.select("user_id", "event_type", "event_id", "value")


@query("select user_id, count(*) as events, count(*) filter (event_type = 'purchase') as likes, count(*) filter (event_type = 'error') as dislikes, round(count(*) filter (event_type = 'purchase') / nullif(count(*) filter (event_type in ('purchase', 'error')), 0), 4) as csat, round(sum(case when event_type = 'purchase' then value else 0 end), 2) as liked_value from events group by 1")
def rating_stats(spark, d):
    e = table(spark, d, "events")
    n = lambda *t: F.count_if(F.col("event_type").isin(*t))
    return e.groupBy("user_id").agg(F.count(F.lit(1)).alias("events"), n("purchase").alias("likes"), n("error").alias("dislikes"), F.round(F.try_divide(n("purchase"), n("purchase", "error")), 4).alias("csat"), F.round(F.sum(F.when(F.col("event_type") == "purchase", F.col("value")).otherwise(0.0)), 2).alias("liked_value"))


@query("select event_id, user_id, json_extract_string(props, '$.k')::int as k, coalesce(json_extract_string(props, '$.missing'), json_extract_string(props, '$.k')) as fallback from events where event_type = 'error' and value >= 5")
def event_properties(spark, d):
    e = D.filtered(table(spark, d, "events"), {"type": F.col("event_type") == "error", "user": None, "least": F.col("value") >= 5})
    k = F.get_json_object("props", "$.k")
    return e.select("event_id", "user_id", k.cast("int").alias("k"), F.coalesce(F.get_json_object("props", "$.missing"), k).alias("fallback"))


@query(
    """with r as (select p_partkey as id, case when p_partkey % 5 = 0 then null else p_type end as direction, p_size as priority, (p_partkey % 3 > 0)::int as is_active from part),
g as (select distinct p_type as direction from part), u as (select g.direction, id, priority, is_active from g join r on r.direction = g.direction where is_active = 1 union all select g.direction, id, priority, is_active from g, r where r.direction is null and is_active = 1),
k as (select *, row_number() over (partition by direction order by priority desc, id) as rank from u) select direction, id, priority, rank from k where rank <= 5"""
)
def active_rules(spark, d):
    p = table(spark, d, "part")
    rules = p.select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 5 != 0, F.col("p_type")).alias("direction"), F.col("p_size").alias("priority"), (F.col("p_partkey") % 3 > 0).cast("int").alias("is_active"))
    return D.active_rules(rules, p.select(F.col("p_type").alias("direction")).distinct()).select("direction", "id", "priority", "rank")


@query("select n_regionkey as direction, count(*) filter (a = 1) as active, count(*) filter (a = 0) as inactive from (select n_regionkey, 0 as a from nation union all select r_regionkey, 1 from region) group by 1")
def rule_reseed(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_regionkey").alias("direction"), F.lit(1).alias("is_active"))
    r = table(spark, d, "region").select(F.col("r_name").alias("id"), F.col("r_regionkey").alias("direction"))
    out = D.reseeded(n, r)
    return out.groupBy("direction").agg(F.count_if(F.col("is_active") == 1).alias("active"), F.count_if(F.col("is_active") == 0).alias("inactive"))


@query("select 'orders' as what, count(*) as n from orders where o_custkey % 10 <> 3 union all select 'customer', count(*) from customer where c_custkey % 10 <> 3")
def cascade_delete(spark, d):
    c = table(spark, d, "customer").withColumnRenamed("c_custkey", "key")
    o = table(spark, d, "orders").withColumnRenamed("o_custkey", "key")
    parents, children = D.deleted(c, o, c.filter("key % 10 = 3"), "key")
    count = lambda df, n: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("what"), "n")
    return count(children, "orders").unionByName(count(parents, "customer"))


_PRODUCTS = {"the": "(?:^| )the ", "and": "(?:^| )and ", "der": "(?:^| )der ", "les": "(?:^| )les "}


@query(
    MSG
    + ", f as (select *, "
    + ", ".join(f"regexp_matches(lower(content), '{p}') as n_{k}, regexp_matches(lower(content), '(?s:(?: of| de))[^\\n]{{0,30}}(?:{p})') as r_{k}" for k, p in _PRODUCTS.items())
    + " from m), w as (select *, "
    + ", ".join(f"max({x}_{k}::int) over (partition by chat_id order by id) as {x}w_{k}" for k in _PRODUCTS for x in "nr")
    + " from f) select chat_id, id, array_to_string(list_filter(["
    + ", ".join(f"case when nw_{k} = 1 then '{k}' end" for k in sorted(_PRODUCTS))
    + "], lambda x: x is not null), '|') as mentioned, array_to_string(list_filter(["
    + ", ".join(f"case when rw_{k} = 1 then '{k}' end" for k in sorted(_PRODUCTS))
    + "], lambda x: x is not null), '|') as rejected from w where role = 'user'"
)
def dialog_state(spark, d):
    out = D.dialog_state(_messages(spark, d), _PRODUCTS, " of| de")
    return out.select("chat_id", "id", F.array_join("mentioned", "|").alias("mentioned"), F.array_join("rejected", "|").alias("rejected"))


@query(
    """with t as (select item_id, lower(text) as l from benchmark), w as (select *, regexp_split_to_array(l, '[^\\p{L}\\p{N}]+') as ws from t),
v as (select *, len(list_filter(ws, lambda x: starts_with(x, 'th') or starts_with(x, 'an'))) as en, len(list_filter(ws, lambda x: starts_with(x, 'en') or starts_with(x, 'qu'))) as fr from w),
b as (select *, greatest(en, fr, 0) as best from v)
select item_id, 'general' as intent, case when en = best and en > 0 then 'en' when fr = best and fr > 0 then 'fr' end as direction, round(least(case when best = 0 then 0.0 when best >= 2 then best / len(ws) * 1.3 else best / len(ws) end, 1.0), 4) as confidence, len(ws) < 3 and best = 0 as ask_back from b"""
)
def parsed_queries(spark, d):
    # the vote counts both prefixes of a direction; no word starts with both
    b = table(spark, d, "benchmark")
    cols = D.parsed_query(F.col("text"), {"en": ("th", "an"), "fr": ("en", "qu")})
    return b.select("item_id", *[c.alias(k) for k, c in cols.items()])


def _scores(spark, d):
    lab = table(spark, d, "labels")
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    return docs.join(lab, "doc_id")


SCO = "with s as (select documents.doc_id, lang, source, n_chars, quality, toxic from documents join labels using (doc_id))"


@query(SCO + ", k as (select *, row_number() over (partition by lang order by n_chars) as rn, count(*) over (partition by lang) as n from s) select lang, count(*) as n, round(avg(quality), 4) as pass_rate, round(avg(n_chars), 4) as mean, max(n_chars) as most, min(n_chars) filter (rn > floor(n * 0.95)) as p95 from k group by 1")
def evaluation_rollup(spark, d):
    return E.rolled_up(_scores(spark, d), ["lang"], F.col("quality"), "n_chars")


@query(SCO + " select doc_id, array_to_string(list_filter([case when quality <> 1 then 'quality' end, case when toxic <> 0 then 'toxic' end, case when n_chars < 500 then 'length' end], lambda x: x is not null), '|') as failed from s")
def case_checks(spark, d):
    f = E.failures({"quality": F.col("quality") == 1, "toxic": F.col("toxic") == 0, "length": F.col("n_chars") >= 500})
    return _scores(spark, d).select("doc_id", F.array_join(f, "|").alias("failed"))


def _winner():
    return F.when(F.col("quality") > F.col("toxic"), "a").when(F.col("quality") < F.col("toxic"), "b").otherwise("tie").alias("winner")


WIN = SCO + ", r as (select *, case when quality > toxic then 'a' when quality < toxic then 'b' else 'tie' end as winner, case when n_chars % 3 = 0 then 'a' when n_chars % 3 = 1 then 'b' else 'tie' end as w2 from s)"


@query(WIN + " select lang, source, count(*) filter (winner = 'a') as n_a, count(*) filter (winner = 'b') as n_b, count(*) filter (winner = 'tie') as n_tie, count(*) as n, round(count(*) filter (winner = 'a') / nullif(count(*) filter (winner in ('a', 'b')), 0), 4) as win_rate from r group by 1, 2")
def win_rates(spark, d):
    return E.win_rates(_scores(spark, d).select("*", _winner()), ["lang", "source"])


@query(WIN + " select winner as before, w2 as after, count(*) as n from r group by 1, 2")
def verdict_flips(spark, d):
    s = _scores(spark, d).select("*", _winner())
    other = s.withColumn("winner", F.when(F.col("n_chars") % 3 == 0, "a").when(F.col("n_chars") % 3 == 1, "b").otherwise("tie"))
    return E.flips(s, other, "doc_id")


@query(SCO + ", b as (select doc_id, n_chars % 2 = 0 as was from s where doc_id % 4 <> 0) select s.doc_id, case when was is null then 'new' when was and quality <> 1 then 'regression' when not was and quality = 1 then 'fix' else 'same' end as kind from s left join b using (doc_id)")
def baseline_diff(spark, d):
    s = _scores(spark, d)
    base = s.filter("doc_id % 4 <> 0").select("doc_id", (F.col("n_chars") % 2 == 0).alias("passed"))
    return E.against_baseline(s.select("doc_id", (F.col("quality") == 1).alias("passed")), base, "doc_id")


@query(SCO + ", k as (select *, row_number() over (partition by source order by quality desc, n_chars desc, doc_id) as rn from s) select doc_id, source, quality, n_chars from k where rn <= 3 order by quality desc, n_chars desc, doc_id limit 20")
def few_shot_selection(spark, d):
    order = [F.desc("quality"), F.desc("n_chars"), F.col("doc_id")]
    return E.per_topic_best(_scores(spark, d), "source", order, 3, 20).select("doc_id", "source", "quality", "n_chars")


@query(
    SCO
    + """, p as (select doc_id, case when toxic = 1 then 0 when quality = 0 then 1 else 2 end as priority from s), a as (select * from p where priority = 0 order by doc_id limit 15), b as (select * from p where priority = 1 order by doc_id limit 6),
c as (select * from p where doc_id not in (select doc_id from a union select doc_id from b) order by doc_id limit 6) select doc_id, priority from (select * from a union all select * from b union all select * from c)"""
)
def prioritised_sample(spark, d):
    pr = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).otherwise(2)
    return E.quota_sample(_scores(spark, d).select("doc_id", "toxic", "quality"), pr, [15, 6], 27, "doc_id").select("doc_id", "priority")


@query("select doc_id, case when ('0x' || substr(md5('13:' || doc_id), 1, 8))::bigint % 100 < 10 then 'validation' else 'train' end as part from documents")
def train_split(spark, d):
    return E.split(table(spark, d, "documents").select("doc_id"), F.col("doc_id"), 10, 13)


@query(
    """with few as (select doc_id, source as pt from (select doc_id, source, row_number() over (partition by source order by md5('5:' || doc_id), doc_id) as r from documents) where r <= 8),
q as (select item_id as query_id, 'src' || (item_id % 20) as topic, item_id as own from benchmark),
p as (select query_id, doc_id, case when topic = pt then 0.3::double else 0.0::double end as label from q join few on own <> doc_id),
k as (select *, row_number() over (partition by query_id, label order by md5('5:' || query_id || ':' || doc_id), doc_id) as r from p) select query_id, doc_id, label from k where r <= 2"""
)
def training_negatives(spark, d):
    pos = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("topic"), F.col("item_id").alias("doc_id"))
    pool = table(spark, d, "documents").select("doc_id", F.col("source").alias("topic"))
    return E.negatives(pos, pool, 2, 5)


@query()
def greedy_prototypes(spark, d):
    return E.greedy_prototypes(table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label"), "label", 0.85, 20)


@query(
    """with p as (select p_partkey as id, p_retailprice as total, p_retailprice * 0.8 as low, p_retailprice * (1 + p_size / 40.0) as high, p_size as items from part)
select id, coalesce(items > 25 or (low > 0 and high / low > 20) or (low = 0 and total > 500000), false) as explodes, case when items > 25 or (low > 0 and high / low > 20) or (low = 0 and total > 500000) then 'manual' when high - low <= total * 0.3 then 'auto' else 'guided' end as confidence,
round(case when abs(total - high) / greatest(total, 1) > 0.05 then high else total end + 1e-9, 2) as price from p"""
)
def estimate_gates(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("total"), (F.col("p_retailprice") * 0.8).alias("low"), (F.col("p_retailprice") * (1 + F.col("p_size") / 40.0)).alias("high"), F.col("p_size").alias("items"))
    g = D.gates(F.col("total"), F.col("low"), F.col("high"), F.col("items"))
    return p.select("id", *[c.alias(k) for k, c in g.items()], F.round(D.reconciled(F.col("total"), F.col("high")) + 1e-9, 2).alias("price"))
