"""Near-duplicate documents: MinHash signatures, banding, verification, connected components.

1. One pass over the texts gives every document the size and a 128-bit fingerprint of its shingle
   set and ``bands * rows`` minima of universal hashes. Documents with the same set form a class;
   from here on a class is one node, so copies never meet in pairs.
2. Classes that agree in all rows of a band share a bucket. In a bucket of up to ``SMALL`` classes
   all pairs are candidates. In a larger one each class is paired with one pivot, the class whose
   buckets are fullest (among copies of one text, that text); pairs that are still in different
   components after that are compared in blocks (``_rest``), so no candidate is given up.
3. Candidates whose signatures agree too little are dropped: the bound lies five standard
   deviations below the threshold. The others are compared on their full shingle sets.
4. Large-star and small-star turn the links into components.

At similarity s a link escapes banding with probability (1 - s**rows) ** bands: 4e-7 at 0.85 with
20 bands of 4, 3e-6 at 0.8 with 24 of 4.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.base import Shared, WordHashes, arrow_batches, mix64, replace_columns, shingle_hashes
from tallyforge.llm.components import components

SMALL = 8
BLOCK, WEIGHT = 512, 1 << 20
BROADCAST_IDS = 1_000_000
SEED = 20_240_229


def _slices(texts: list, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``most`` characters; a longer text is a run of its own."""
    at, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t or "") > most:
            yield at, i
            at, held = i, 0
        held += len(t or "") + 1
    if at < len(texts):
        yield at, len(texts)


def shingle_sets(texts: list, k: int) -> Iterator[np.ndarray]:
    """The distinct k-word shingles of each text as sorted 64-bit hashes; a text of fewer words is
    one shingle, one without words has none."""
    hasher = WordHashes()
    for a, b in _slices(texts):
        words, starts = hasher.of(texts[a:b])
        for s, e in zip(starts[:-1], starts[1:], strict=True):
            n = int(e - s)
            yield np.unique(shingle_hashes(words[s:e], k)) if n >= k else mix64(shingle_hashes(words[s:e], n) + np.uint64(n)) if n else np.zeros(0, np.uint64)


def _signatures(k: int, size: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(SEED)
        a = rng.integers(1, 1 << 63, size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        b = rng.integers(0, 1 << 63, size, dtype=np.uint64)
        for batch in batches:
            n, f1, f2, sig = [], [], [], []
            for s in shingle_sets(batch.column(1).to_pylist(), k):
                n.append(len(s))
                f1.append(int(np.bitwise_xor.reduce(mix64(s)).view(np.int64)) if len(s) else 0)
                f2.append(int(np.add.reduce(mix64(s ^ np.uint64(0x5851F42D4C957F2D))).view(np.int64)) if len(s) else 0)
                if not len(s):
                    sig.append(None)
                    continue
                x, least = s >> np.uint64(32), None
                for at in range(0, len(x), 1024):  # (a x + b) >> 32 is universal on 32-bit x
                    m = ((a[:, None] * x[None, at : at + 1024] + b[:, None]) >> np.uint64(32)).min(axis=1)
                    least = m if least is None else np.minimum(least, m)
                sig.append(least.astype(np.uint32).view(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(sig, pa.list_(pa.int32()))], names=["doc_id", "n_shingles", "f1", "f2", "sig"])

    return task


def _sets(k: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for a, b in _slices(texts, 1 << 22):
                sets = [s.view(np.int64) for s in shingle_sets(texts[a:b], k)]
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(sets, pa.list_(pa.int64()))], names=["rep", "set"])

    return task


def _columns(t: pa.Table, *names: str) -> list[np.ndarray]:
    return [np.array(t.column(c).to_pylist()) for c in names]


def _survivors(least: int, rows: int):
    """Compares the signatures of two blocks of one bucket; returns the rows of either side that have a
    partner near enough. A pair that shares several buckets is looked at in the one of its first common band."""

    def task(left: pa.Table, right: pa.Table) -> pa.Table:
        one, two = np.zeros(left.num_rows, bool), np.zeros(right.num_rows, bool)
        if left.num_rows and right.num_rows:
            (x, cx, sx), (y, cy, sy) = (_columns(t, "rep", "component", "sig") for t in (left, right))
            band, main = left.column("band")[0].as_py(), left.column("main")[0].as_py()
            for i in range(len(x)):
                ok = _near(sx[i], sy, least, rows, band) & (cy != cx[i]) & ((cy == main) | (x[i] < y))
                one[i] = ok.any()
                two |= ok
        out = pa.concat_tables([left.filter(pa.array(one)), right.filter(pa.array(two))])
        return out.append_column("side", pa.array([0] * int(one.sum()) + [1] * int(two.sum()), pa.int32()))

    return task


def _near(s: np.ndarray, others: np.ndarray, least: int, rows: int, band: int) -> np.ndarray:
    same = others == s
    return (same.sum(axis=1) >= least) & (same.reshape(len(others), -1, rows).all(axis=2).argmax(axis=1) == band)


def _sets_of(t: pa.Table) -> list[np.ndarray]:
    """The sorted sets of a table's rows, as views of its own memory."""
    out = []
    for chunk in t.column("set").chunks:
        ends = np.cumsum(chunk.value_lengths().to_numpy())
        out += np.split(chunk.flatten().to_numpy().view(np.uint64), ends[:-1])
    return out


def _common(x: np.ndarray, y: np.ndarray) -> int:
    return int(np.count_nonzero(y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x))


def _links(percent: int, least: int, rows: int):
    """Compares the full sets of what _survivors left of two blocks."""

    def task(t: pa.Table) -> pa.Table:
        u, v = [], []
        sets, side = _sets_of(t), t.column("side").to_numpy()
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if len(left) and len(right):
            rep, component, sig = _columns(t, "rep", "component", "sig")
            band, main = t.column("band")[0].as_py(), t.column("main")[0].as_py()
            for i in left.tolist():
                ok = _near(sig[i], sig[right], least, rows, band) & (component[right] != component[i]) & ((component[right] == main) | (rep[i] < rep[right]))
                for j in right[ok].tolist():
                    common = _common(sets[i], sets[j])
                    if 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                        u.append(int(rep[i]))
                        v.append(int(rep[j]))
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return task


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"{n} {t}" for n, t in df.dtypes)


def _agree(x: Column, y: Column) -> Column:
    return F.size(F.filter(F.zip_with(x, y, lambda p, q: p == q), lambda same: same))


def only_ids(docs: DataFrame, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """docs whose doc_id is (or is not) in ids (one column, doc_id). The ids are broadcast up to
    BROADCAST_IDS rows, counted first; beyond that both sides are shuffled by id."""
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return docs.join(ids, "doc_id", how)


class _Search:
    def __init__(self, docs: DataFrame, percent: int, k: int, bands: int, rows: int):
        self.docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
        self.percent, self.k, self.bands, self.rows, self.size = percent, k, bands, rows, bands * rows
        self.shared = Shared(docs.sparkSession, "near")
        t = percent / 100
        self.least = max(1, math.floor(self.size * (t - 5 * math.sqrt(t * (1 - t) / self.size))))

    def signatures(self) -> DataFrame:
        schema = "doc_id bigint, n_shingles bigint, f1 bigint, f2 bigint, sig array<int>"
        return self.shared.save(self.docs.mapInArrow(_signatures(self.k, self.size), schema), "sig")

    def classes(self, sig: DataFrame) -> DataFrame:
        known = sig.filter("n_shingles > 0 and doc_id is not null")
        return self.shared.save(known.groupBy("n_shingles", "f1", "f2").agg(F.min("doc_id").alias("rep"), F.min_by("sig", "doc_id").alias("sig")), "classes")

    def buckets(self, classes: DataFrame) -> DataFrame:
        """(key, rep, band, n) for buckets of n >= 2 classes."""
        keys = F.array(*[F.xxhash64(F.lit(b), *[F.col("sig")[b * self.rows + r] for r in range(self.rows)]) for b in range(self.bands)])
        rows = classes.select("rep", F.posexplode(keys).alias("band", "key"))
        # what is joined by bucket is a written table each time: Spark can then split a large bucket
        counts = self.shared.save(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "counts")
        return self.shared.save(rows.join(counts, "key"), "buckets")

    def candidates(self, buckets: DataFrame) -> DataFrame:
        small = buckets.filter(F.col("n") <= SMALL).groupBy("key").agg(F.collect_list("rep").alias("reps"))
        pairs = F.flatten(F.transform("reps", lambda x: F.transform(F.filter("reps", lambda y: y > x), lambda y: F.struct(x.alias("a"), y.alias("b")))))
        small = small.select(F.explode(pairs).alias("p")).select("p.a", "p.b")
        full = buckets.groupBy("rep").agg(F.sum("n").alias("full"))
        large = buckets.filter(F.col("n") > SMALL)
        pivots = self.shared.save(large.join(full, "rep").groupBy("key").agg(F.max_by("rep", F.struct("full", -F.col("rep"))).alias("pivot")), "pivots")
        star = large.join(pivots, "key").filter("rep <> pivot").select(F.least("rep", "pivot").alias("a"), F.greatest("rep", "pivot").alias("b"))
        return small.unionByName(star).distinct()

    def sets(self, buckets: DataFrame) -> DataFrame:
        """Full shingle sets of the classes that have candidates, from their texts."""
        ids = self.shared.save(buckets.select(F.col("rep").alias("doc_id")).distinct(), "ids")
        rows = only_ids(self.docs, ids).mapInArrow(_sets(self.k), "rep bigint, set array<bigint>")
        return self.shared.save(rows, "sets")

    def verified(self, pairs: DataFrame, classes: DataFrame, sets: DataFrame) -> DataFrame:
        sig = classes.select("rep", "sig")
        near = (
            pairs.join(sig.select(F.col("rep").alias("b"), F.col("sig").alias("sb")), "b")
            .join(sig.select(F.col("rep").alias("a"), F.col("sig").alias("sa")), "a")
            .filter(_agree(F.col("sa"), F.col("sb")) >= self.least)
            .select("a", "b")
        )
        return self.exact(near, sets)

    def exact(self, near: DataFrame, sets: DataFrame) -> DataFrame:
        sets = sets.dropDuplicates(["rep"])
        both = near.join(sets.select(F.col("rep").alias("b"), F.col("set").alias("tb")), "b").join(sets.select(F.col("rep").alias("a"), F.col("set").alias("ta")), "a")
        both = both.withColumn("i", F.size(F.array_intersect("ta", "tb")))
        return both.filter(F.col("i") * 100 >= self.percent * (F.size("ta") + F.size("tb") - F.col("i"))).select(F.col("a").alias("u"), F.col("b").alias("v"))

    def rest(self, buckets: DataFrame, classes: DataFrame, sets: DataFrame, comp: DataFrame) -> DataFrame:
        """Links that pivots left out. In each large bucket that still holds several components, the
        classes outside its largest one meet all classes of other components, in blocks of about
        BLOCK rows and WEIGHT shingles a side at most: their signatures first, then the full sets of those that have a partner
        near enough. Only links leave the tasks, however many classes are nearly similar."""
        large = buckets.filter(F.col("n") > SMALL).join(comp.withColumnRenamed("node", "rep"), "rep", "left")
        large = large.withColumn("component", F.coalesce("component", "rep"))
        per = large.groupBy("key", "component").agg(F.count(F.lit(1)).alias("c"))
        main = per.groupBy("key").agg(F.max_by("component", F.struct("c", "component")).alias("main"), F.count(F.lit(1)).alias("parts")).filter("parts > 1")
        weight = large.join(classes.select("rep", "n_shingles"), "rep").groupBy("key").agg(F.sum("n_shingles").alias("weight"))
        rows = large.join(self.shared.save(main.join(weight, "key"), "main"), "key").join(classes.select("rep", "sig"), "rep")
        blocks = F.ceil(F.greatest(F.col("n") / BLOCK, F.col("weight") / WEIGHT)).cast("int")
        rows = self.shared.save(rows.withColumn("blocks", blocks).select("key", "rep", "band", "component", "main", "sig", "blocks"), "mixed")
        own, every = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
        minor = rows.filter("component <> main").withColumn("i", own).withColumn("j", every).drop("blocks")
        other = rows.withColumn("j", own).withColumn("i", every).select(minor.columns)
        names = ["key", "i", "j"]
        near = minor.groupBy(*names).cogroup(other.groupBy(*names)).applyInArrow(_survivors(self.least, self.rows), f"{_ddl(minor)}, side int")
        near = self.shared.save(near, "survivors").join(sets.dropDuplicates(["rep"]), "rep")
        return near.groupBy(*names).applyInArrow(_links(self.percent, self.least, self.rows), "u bigint, v bigint").distinct()

    def components(self) -> DataFrame:
        """(doc_id, n_shingles, component_id), a row for each row of docs."""
        arrow_batches(self.docs.sparkSession)
        sig = self.signatures()
        classes = self.classes(sig)
        buckets = self.buckets(classes)
        sets = self.sets(buckets)
        links = self.shared.save(self.verified(self.candidates(buckets), classes, sets), "links")
        comp = self.shared.save(components(links, self.shared, "c"), "comp")
        more = self.shared.save(self.rest(buckets, classes, sets, comp), "more")
        if more.limit(1).count():
            roots = comp.select(F.col("node").alias("u"), F.col("component").alias("v"))
            comp = self.shared.save(components(more.unionByName(roots), self.shared, "d"), "comp2")
        for name in ("sets", "mixed", "survivors", "buckets"):
            self.shared.drop(name)
        labels = classes.drop("sig").join(comp.withColumnRenamed("node", "rep"), "rep", "left")
        labels = labels.select("n_shingles", "f1", "f2", F.coalesce("component", "rep").alias("component_id"))
        out = sig.drop("sig").join(labels, ["n_shingles", "f1", "f2"], "left")
        component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
        return out.select("doc_id", "n_shingles", component.alias("component_id"))


def near_duplicates(docs: DataFrame, percent: int = 80, k: int = 5, bands: int = 24, rows: int = 4) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_shingles, component_id, kept.

    Two texts are linked if 100 * |intersection| >= percent * |union| of their shingle sets.
    component_id is the smallest doc_id that links reach; kept says that it is the row's own.
    A text without words is linked with nothing and kept. Rows that repeat a doc_id are one
    document and agree. A row without doc_id can't name a component: it has none and is kept.
    """
    out = _Search(docs, percent, k, bands, rows).components()
    return replace_columns(out, {"kept": F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))})


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """docs without the rows whose component has a smaller doc_id."""
    gone = near_duplicates(docs, **options).filter("not kept").select("doc_id").distinct()
    gone = Shared(docs.sparkSession, "near").save(gone, "gone")
    return only_ids(docs, gone, "left_anti").select(*docs.columns)


ORACLE = """
with recursive d as (select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents),
l as (select doc_id, case when len(w) >= 5 then list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) when len(w) > 0 then [array_to_string(w, ' ')] else []::varchar[] end as s from d),
n as (select doc_id, coalesce(len(s), 0)::bigint as n_shingles from l),
e as (select doc_id, unnest(s) as s from l),
p as (select x.doc_id as a, y.doc_id as b, count(*) as i from e x join e y on x.s = y.s and x.doc_id < y.doc_id group by 1, 2),
k as (select a, b from p join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * i >= 85 * (na.n_shingles + nb.n_shingles - i)),
g as (select a as u, b as v from k union select b, a from k),
r(node, reach) as (select doc_id, doc_id from n union select r.node, g.v from r join g on g.u = r.reach)
select n.doc_id, n_shingles, min(reach) as component_id, n.doc_id = min(reach) as kept from n join r on r.node = n.doc_id group by n.doc_id, n_shingles
"""
