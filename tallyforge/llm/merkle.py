"""A Merkle manifest of documents: one tree per language, one tree over their roots, proofs, checks.

A leaf is the SHA-256 of a document's columns. Leaves are put in order and written with their places;
a task that reads a stretch of places keeps a mountain range: a stack of unfinished runs, one per
height. A place that ends a run of ``FANOUT`` carries: the run becomes a node record of the height
above, and so on up. Runs that begin before the stretch or end after it are left as peaks. Peaks of
all stretches (at most two runs a height and stretch) are merged height by height by a grouping on
the run, and the last run of a height, which may be short, is hashed as it is, never padded.

Node records keep their children, so a proof is a walk down from the root in joins by run: each
node hands its children the steps above them. Nothing but the number of languages, the size of the
largest and the root reaches the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tallyforge.llm.base import Shared, arrow_batches

FANOUT = 8
COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]
#: Stretches (sorted partitions times the languages in each) whose first places are broadcast.
FEW = 100_000
NODES = "g bigint, n bigint, height int, idx bigint, digest binary, children binary, peak boolean"
_SCHEMA = pa.schema([("g", pa.int64()), ("n", pa.int64()), ("height", pa.int32()), ("idx", pa.int64()), ("digest", pa.binary()), ("children", pa.binary()), ("peak", pa.bool_())])


def field(value: Column) -> Column:
    """What a leaf hashes of a column: ``-`` for null, else the UTF-8 length, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(values: list[Column]) -> Column:
    """SHA-256 (32 bytes) of the columns' fields in a row."""
    return F.unhex(F.sha2(F.concat(*[field(v) for v in values]).cast("binary"), 256))


def hex_of(digests: Column) -> Column:
    return F.lower(F.hex(digests))


def node(children: Column) -> Column:
    """The node over children (their digests in a row): digests enter the hash as hex text."""
    return F.unhex(F.sha2(hex_of(children).cast("binary"), 256))


def tampered(text: Column, doc_id: Column) -> Column:
    """The text with A-Z in lower case where 3 divides the CRC-32 of the decimal doc_id, else itself."""
    upper = "".join(map(chr, range(65, 91)))
    hit = F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 0, F.lit(False))
    return F.when(hit, F.translate(text, upper, upper.lower())).otherwise(text)


class Range:
    """The mountain range of one stretch of places: unfinished runs by height."""

    def __init__(self, out: list[tuple], fanout: int):
        self.out, self.fanout = out, fanout
        self.runs: list[list[bytes]] = []
        self.next: list[int] = []  # place after the last of each height

    def push(self, idx: int, digest: bytes, height: int = 0) -> None:
        """Take the node at the next place of a height; full runs are hashed and carried upwards."""
        while True:
            if height == len(self.runs):
                self.runs.append([])
                self.next.append(0)
            run = self.runs[height]
            run.append(digest)
            self.next[height] = idx + 1
            if (idx + 1) % self.fanout:
                return
            if len(run) < self.fanout:  # it began before this stretch
                self._leave(height)
                return
            children = b"".join(run)
            digest = hashlib.sha256(children.hex().encode()).digest()
            run.clear()
            height, idx = height + 1, idx // self.fanout
            self.out.append((height, idx, digest, children, False))

    def _leave(self, height: int) -> None:
        run = self.runs[height]
        first = self.next[height] - len(run)
        self.out.extend((height, first + k, d, None, True) for k, d in enumerate(run))
        run.clear()

    def close(self) -> None:
        for height in range(len(self.runs)):
            self._leave(height)


def _ranges(fanout: int):
    """Node records and peaks of rows (g, n, pos, digest) that ascend by g and pos within a task."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        rows: list[tuple] = []
        g = n = pos = None
        peaks = Range(out, fanout)

        def settle():
            rows.extend((g, n, *x) for x in out)
            out.clear()

        def batch_of():
            b = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)
            rows.clear()
            return b

        for batch in batches:
            for g2, n2, pos2, digest in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if g2 != g or pos2 != pos:
                    peaks.close()
                    settle()
                    g, n, peaks = g2, n2, Range(out, fanout)
                peaks.push(pos2, digest)
                pos = pos2 + 1
            settle()
            if rows:
                yield batch_of()
        peaks.close()
        settle()
        if rows:
            yield batch_of()

    return task


def numbered(rows: DataFrame, group: list[str], order: list[str], shared: Shared, name: str) -> DataFrame:
    """rows with their place ``pos`` (0, 1, ...) within their group by order, and ``n``, the group's rows.

    Rows are sorted by range once and written; the table of stretches (one row per partition and
    group in it) gives each its first place. A group is dealt to many partitions. Rows that are equal
    in all of order may take each other's places.
    """
    keys = [F.col(c).asc_nulls_first() for c in [*group, *order]]
    # equal rows are dealt by their number in the written table they come from
    tied = rows.withColumn("_q_tie", F.monotonically_increasing_id())
    tied = tied.repartitionByRange(*keys, "_q_tie").sortWithinPartitions(*keys, "_q_tie").drop("_q_tie")
    placed = shared.save(tied.withColumn("_q_at", F.monotonically_increasing_id()), name)
    part = F.shiftright("_q_at", 33)
    spans = placed.groupBy(*group, part.alias("_q_part")).agg(F.count("*").alias("_q_n"), F.min("_q_at").alias("_q_first"))
    own = W.partitionBy(*group)
    before = F.sum("_q_n").over(own.orderBy("_q_part").rowsBetween(W.unboundedPreceding, 0)) - F.col("_q_n")
    spans = shared.save(spans.select(*group, "_q_part", (before - F.col("_q_first")).alias("_q_shift"), F.sum("_q_n").over(own).alias("n")), f"{name}_spans")
    few = spans.count() <= FEW
    spans = spans.select(*[F.col(c).alias(f"_q_{c}") for c in group], F.col("_q_part").alias("_q_part2"), "_q_shift", "n")
    same = part == F.col("_q_part2")
    for c in group:
        same = same & placed[c].eqNullSafe(F.col(f"_q_{c}"))
    out = placed.join(F.broadcast(spans) if few else spans, same)
    return out.withColumn("pos", F.col("_q_at") + F.col("_q_shift")).select(*rows.columns, "pos", "n")


def level_size(n: Column, height: int) -> Column:
    """How many nodes a tree of n leaves has at a height."""
    width = FANOUT**height
    return F.floor((n + F.lit(width - 1)) / F.lit(width)).cast("long") if height else n


def n_levels(n: int) -> int:
    height = 0
    while n > 1:
        n, height = -(-n // FANOUT), height + 1
    return height


def trees(rows: DataFrame, deepest: int, shared: Shared, name: str) -> tuple[list[DataFrame], DataFrame]:
    """Trees over rows (g, n, pos, digest): node records (g, n, idx, digest, children) of each height
    from 1 to deepest, and the roots (g, n, digest)."""
    arrow_batches(rows.sparkSession)
    rows = rows.select("g", "n", "pos", "digest").sortWithinPartitions("g", "pos")
    made = shared.save(rows.mapInArrow(_ranges(FANOUT), NODES), f"{name}_ranges")
    peaks, merged = made.filter("peak"), None
    heights, roots = [], None
    for height in range(deepest + 1):
        open_ = peaks.filter(F.col("height") == height).select("g", "n", "idx", "digest")
        open_ = open_ if merged is None else open_.unionByName(merged.select("g", "n", "idx", "digest"))
        size = level_size(F.col("n"), height)
        done = open_.filter(size == 1).select("g", "n", "digest")
        roots = done if roots is None else roots.unionByName(done)
        if height == deepest:
            break
        runs = open_.filter(size > 1).groupBy("g", "n", F.floor(F.col("idx") / FANOUT).cast("long").alias("run"))
        runs = runs.agg(F.array_sort(F.collect_list(F.struct("idx", "digest"))).alias("c"))  # FANOUT at most
        children = F.aggregate("c", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["digest"]))
        runs = runs.select("g", "n", F.col("run").alias("idx"), children.alias("children"))
        merged = shared.save(runs.select("g", "n", "idx", node(F.col("children")).alias("digest"), "children"), f"{name}_{height + 1}")
        whole = made.filter((F.col("height") == height + 1) & ~F.col("peak")).select("g", "n", "idx", "digest", "children")
        heights.append(whole.unionByName(merged))
    return heights, roots


def _step(children: Column, place: Column) -> Column:
    """The siblings of a child: digests before it and after it."""
    at = (place * 32).cast("int")
    return F.struct(F.substring(children, F.lit(1), at).alias("left"), F.substring(children, at + 33, F.lit(FANOUT * 32)).alias("right"))


def paths(heights: list[DataFrame], above: DataFrame) -> DataFrame:
    """For the runs of leaves (g, idx, children): the steps from each run's node up to the top.

    above: (g, n, steps) of each tree's root. Trees of one leaf have no run and no row.
    """
    found = None
    for height in range(len(heights), 0, -1):
        size, below = level_size(F.col("n"), height), level_size(F.col("n"), height - 1)
        tops = above.filter((size == 1) & (below > 1)).select("g", F.lit(0).cast("long").alias("idx"), "steps")
        known = tops if found is None else found.unionByName(tops)
        with_steps = heights[height - 1].select("g", "idx", "children").join(known, ["g", "idx"])
        if height == 1:
            return with_steps
        place = F.explode(F.sequence(F.lit(0), (F.octet_length("children") / 32 - 1).cast("int")))
        each = with_steps.select("g", "idx", "children", "steps", place.alias("k"))
        found = each.select("g", (F.col("idx") * FANOUT + F.col("k")).alias("idx"), F.concat(F.array(_step(F.col("children"), F.col("k"))), F.col("steps")).alias("steps"))
    return above.select("g", F.lit(0).cast("long").alias("idx"), F.lit(b"").cast("binary").alias("children"), "steps").limit(0)


def with_steps(rows: DataFrame, heights: list[DataFrame], above: DataFrame) -> DataFrame:
    """rows (g, n, pos, ...) with the steps from each leaf to the top."""
    runs = paths(heights, above)
    many = rows.filter("n > 1").withColumn("idx", F.floor(F.col("pos") / FANOUT).cast("long")).join(runs, ["g", "idx"])
    many = many.withColumn("steps", F.concat(F.array(_step(F.col("children"), F.col("pos") % FANOUT)), F.col("steps")))
    single = rows.filter("n = 1").join(above.select("g", "steps"), "g")
    return many.select(*rows.columns, "steps").unionByName(single.select(*rows.columns, "steps"))


def folded(start: Column, steps: Column) -> Column:
    """The root (hex) that a leaf (hex) and its siblings lead to."""
    return F.aggregate(steps, start, lambda h, s: F.sha2(F.concat(hex_of(s["left"]), h, hex_of(s["right"])).cast("binary"), 256))


def proof_digest(steps: Column) -> Column:
    """SHA-256 (hex) of the siblings on the way up, from left to right; of nothing where there are none."""
    all_ = F.aggregate(steps, F.lit(b"").cast("binary"), lambda a, s: F.concat(a, s["left"], s["right"]))
    return F.sha2(hex_of(all_).cast("binary"), 256)


def manifest(docs: DataFrame, claimed: Column | None = None) -> tuple[DataFrame, list[DataFrame], DataFrame]:
    """Rows of leaves with proofs, node records by height, and (lang, n, subroot).

    Rows: doc_id, lang, leaf, claim, subroot, root, steps. claim is the leaf of each row as it would
    be with ``claimed`` in place of its text. Leaves ascend by doc_id, null ones first; rows that
    repeat an id ascend by leaf. Extra columns are not read.
    """
    shared = Shared(docs.sparkSession, "merkle")
    values = [docs[c] for c in COLUMNS]
    digests = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["lang"].cast("string").alias("lang"), leaf(values).alias("leaf"), (leaf(values) if claimed is None else leaf([*values[:-1], claimed])).alias("claim"))
    digests = shared.save(digests, "leaves")
    rows = numbered(digests, ["lang"], ["doc_id", "leaf"], shared, "sorted")
    langs = shared.save(rows.groupBy("lang").agg(F.first("n").alias("n")), "langs")
    sizes = langs.agg(F.max("n").alias("n"), F.count("*").alias("langs")).first()
    ranked = shared.save(numbered(langs.withColumnRenamed("n", "leaves"), [], ["lang"], shared, "ranks").select("lang", F.col("pos").alias("g"), F.col("leaves").alias("n")), "ranked")
    rows = _ranked(rows, ranked, sizes.langs or 0)

    depth, top_depth = n_levels(sizes.n or 0), n_levels(sizes.langs or 0)
    heights, subroots = trees(rows.withColumnRenamed("leaf", "digest"), depth, shared, "tree")
    subroots = shared.save(subroots, "subroots")
    top = subroots.select(F.lit(0).cast("long").alias("g"), F.lit(sizes.langs or 0).cast("long").alias("n"), F.col("g").alias("pos"), "digest")
    top = top.repartitionByRange("pos")
    top_heights, top_root = trees(top, top_depth, shared, "top")
    found = top_root.first()
    root = F.lit(bytes(found.digest) if found else None).cast("binary")
    start = top.sparkSession.range(1).select(F.lit(0).cast("long").alias("g"), F.lit(sizes.langs or 0).cast("long").alias("n"), F.array().cast("array<struct<left:binary,right:binary>>").alias("steps"))
    above = with_steps(top, top_heights, start).select(F.col("pos").alias("g"), "steps")
    above = shared.save(above.join(subroots.withColumnRenamed("digest", "subroot"), "g"), "above")
    out = with_steps(rows, heights, above)
    out = _subroots(out, above, sizes.langs or 0).select("doc_id", "lang", "leaf", "claim", "subroot", root.alias("root"), "steps")
    return out, heights, ranked.join(subroots.select("g", F.col("digest").alias("subroot")), "g").select("lang", "n", "subroot")


def _ranked(rows: DataFrame, ranked: DataFrame, langs: int) -> DataFrame:
    """Rows with the rank g of their language. Beyond FEW languages none of them can hold more than
    a part of the rows that one stretch of the join may not, so it is salted by place."""
    names = ranked.select(F.col("lang").alias("_q_lang"), "g")
    if langs <= FEW:
        return rows.join(F.broadcast(names), rows["lang"].eqNullSafe(F.col("_q_lang"))).drop("_q_lang")
    names = names.withColumn("_q_salt", F.explode(F.sequence(F.lit(0), F.lit(63))))
    out = rows.join(names, rows["lang"].eqNullSafe(F.col("_q_lang")) & (F.pmod(F.floor(rows["pos"] / 4096), F.lit(64)) == F.col("_q_salt")))
    return out.drop("_q_lang", "_q_salt")


def _subroots(rows: DataFrame, above: DataFrame, langs: int) -> DataFrame:
    small = above.select(F.col("g").alias("_q_g"), "subroot")
    if langs <= FEW:
        return rows.join(F.broadcast(small), rows["g"] == F.col("_q_g"))
    small = small.withColumn("_q_salt", F.explode(F.sequence(F.lit(0), F.lit(63))))
    return rows.join(small, (rows["g"] == F.col("_q_g")) & (F.pmod(F.floor(rows["pos"] / 4096), F.lit(64)) == F.col("_q_salt")))


def verified(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified, a row for each row of docs.

    Digests are lower-case hex. The leaf of each document as someone hands it back (tampered with
    where 3 divides the CRC-32 of its id) is folded with the original siblings; it is verified where
    that gives the root. A null text stays null, a null id is not tampered with.
    """
    rows, _, _ = manifest(docs, tampered(docs["text"].cast("string"), docs["doc_id"]))
    back = folded(hex_of(F.col("claim")), F.col("steps"))
    out = rows.select("doc_id", hex_of(F.col("leaf")).alias("leaf"), hex_of(F.col("subroot")).alias("subroot"), hex_of(F.col("root")).alias("root"), proof_digest(F.col("steps")).alias("proof_sha256"), back.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


#: Trees by recursion over heights, proofs by recursion over steps; CRC-32 bit by bit.
ORACLE = r"""
with recursive f as (select doc_id, lang, text,
    coalesce(strlen(doc_id::varchar) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::varchar) || ':' || n_chars, '-') as h,
    xor(list_reduce([4294967295::bigint] || flatten(list_transform(string_split(doc_id::varchar, ''), lambda c: [ascii(c)::bigint, 256, 256, 256, 256, 256, 256, 256, 256])),
        lambda c, x: case when x < 256 then xor(c, x) else xor(c >> 1, (c & 1) * 3988292384) end), 4294967295) as crc from documents),
d as (select doc_id, lang, sha256(h || coalesce(strlen(text) || ':' || text, '-')) as leaf,
    sha256(h || coalesce(strlen(text) || ':' || case when crc % 3 = 0 then translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') else text end, '-')) as claim from f),
p as (select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as pos, count(*) over (partition by lang) as n,
    dense_rank() over (order by encode(lang) nulls first) - 1 as g from d),
t(g, height, idx, digest, n) as (
    select g, 0, pos, leaf, n from p
    union all
    select g, height + 1, idx // 8, sha256(string_agg(digest, '' order by idx)), (n + 7) // 8 from t where n > 1 group by g, height, idx // 8, n),
s as (select g, digest, height from t where n = 1),
u(height, idx, digest, n) as (
    select 0, g, digest, (select count(*) from s) from s
    union all
    select height + 1, idx // 8, sha256(string_agg(digest, '' order by idx)), (n + 7) // 8 from u where n > 1 group by height, idx // 8, n),
r as (select digest as root from u where n = 1),
runs as (select g, height, idx // 8 as run, list(digest order by idx) as l from t where n > 1 group by all),
top as (select height, idx // 8 as run, list(digest order by idx) as l from u where n > 1 group by all),
steps as (
    select p.doc_id, p.g, p.pos, runs.height as step, p.pos // (8 ** runs.height)::bigint % 8 as k, runs.l from p join runs on runs.g = p.g and runs.run = p.pos // (8 ** (runs.height + 1))::bigint
    union all
    select p.doc_id, p.g, p.pos, s.height + top.height, p.g // (8 ** top.height)::bigint % 8, top.l from p join s on s.g = p.g join top on top.run = p.g // (8 ** (top.height + 1))::bigint),
proofs as (select g, pos, sha256(string_agg(array_to_string(l[:k] || l[k + 2:], ''), '' order by step)) as proof, max(step) + 1 as n_steps from steps group by g, pos),
w(g, pos, step, h) as (
    select g, pos, 0::bigint, claim from p
    union all
    select w.g, w.pos, w.step + 1, sha256(array_to_string(l[:k], '') || w.h || array_to_string(l[k + 2:], '')) from w join steps on steps.g = w.g and steps.pos = w.pos and steps.step = w.step)
select p.doc_id, p.leaf, s.digest as subroot, root, coalesce(proof, sha256('')) as proof_sha256, w.h as folded_root, w.h = root as verified
from p join s using (g) cross join r left join proofs using (g, pos) join w on w.g = p.g and w.pos = p.pos and w.step = coalesce(n_steps, 0)
"""
