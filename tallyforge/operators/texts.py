"""Documents from texts and pages: chunking, page fields, search texts, index rows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tallyforge.functions.text import joined


def heading_chunks(docs: DataFrame, key: str, text: str, least: int = 80) -> DataFrame:
    """(key, chunk, title, body): a text cut at Markdown headings and bold lines; chunks under
    ``least`` characters are left out. Cutting is one split at a look-ahead, per row."""
    parts = F.split(F.concat(F.lit("\n"), F.coalesce(F.col(text), F.lit(""))), r"\n(?=#{1,4} |\*\*[^*\n]+\*\*[ ]*(?:\n|$))")
    edge = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    rows = docs.select(key, F.posexplode(parts).alias("chunk", "_p")).withColumn("_p", edge(F.col("_p")))
    head = F.regexp_extract("_p", r"^(?:#{1,4} +([^\n]*)|\*\*([^*\n]+)\*\*)", 0)
    title = F.trim(F.regexp_replace(head, r"[#*]", ""))
    body = edge(F.substr(F.col("_p"), F.length(head) + 1))
    return rows.select(key, "chunk", title.alias("title"), body.alias("body")).filter(F.length("body") >= least)


#: What Unicode calls white space: what is cut from the ends of a section.
WHITE = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def roadmap_chunks(docs: DataFrame, file: str, text: str, least: int = 50, prefix: str = "Дорожная карта услуги:", whole: str = "Полный документ") -> DataFrame:
    """(file, chunk, title, section, category, service, body): sections of a roadmap (lines that start with
    two hashes) of ``least`` characters and more, numbered in order, each with what the document says of
    itself: its title (first heading without ``prefix``, else the file's name) and the category and service
    of its first 15 lines, null where it states none. A text without such sections is one chunk named
    ``whole``, if long enough. Null texts have none. One expression per row, nothing is gathered."""
    t = F.col("_t")
    edge = lambda c: F.btrim(c, F.lit(WHITE))
    line = lambda pattern: F.nullif(F.rtrim(F.regexp_extract(t, pattern, 1)), F.lit(""))
    stated = lambda name: F.nullif(F.regexp_replace(F.regexp_extract(F.substring_index(t, "\n", 15), rf"(?m)^\*[^\S\n]*\*\*{name}:\*\*[^\S\n]*(.+?)[^\S\n]*\\*[^\S\n]*$", 1), r"\\+$", ""), F.lit(""))
    title = F.trim(F.regexp_replace(line(r"(?m)^#[^\S\n]+\**(.+?)\**[^\S\n]*$"), f"^{prefix}", ""))
    cut = F.split(F.concat(F.lit("\n"), t), r"\n(?=##[^\S\n]+\S)")
    parts = F.slice("_cut", F.lit(2), F.size("_cut"))
    section = lambda p: F.replace(F.trim(F.regexp_extract(p, r"^##[^\S\n]+\**([^\n]+?)\**[^\S\n]*(?:\n|$)", 1)), F.lit("\\."), F.lit("."))
    body = lambda p: edge(F.regexp_replace(F.regexp_replace(p, r"^[^\n]*(?:\n|$)", ""), r"(?m)^#[^\S\n]+[^\n]*(?:\n|$)", ""))
    chunks = F.filter(F.transform(parts, lambda p: F.struct(section(p).alias("section"), body(p).alias("body"))), lambda c: F.length(c["body"]) >= least)
    alone = F.filter(F.array(F.struct(F.lit(whole).alias("section"), edge(t).alias("body"))), lambda c: F.length(c["body"]) >= least)
    name = F.coalesce(title, F.regexp_replace(F.col(file).cast("string"), r"\.md", ""))
    # a column of its own for each step: steps that are used twice are worked out once
    rows = docs.withColumn("_t", F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "\r\n?", "\n"))
    rows = rows.select(file, name.alias("title"), stated("Категория").alias("category"), stated("Услуга").alias("service"), "_t", cut.alias("_cut"))
    rows = rows.withColumn("_chunks", chunks).withColumn("_all", F.when(F.size("_chunks") > 0, F.col("_chunks")).otherwise(alone))
    # an outer explode: for another one Spark would cut the texts beforehand as well, to see which have sections
    rows = rows.select(file, "title", "category", "service", F.posexplode_outer("_all").alias("chunk", "_c")).filter("_c is not null")
    return rows.select(file, "chunk", "title", F.col("_c.section").alias("section"), "category", "service", F.col("_c.body").alias("body"))


def paragraph_cut(text: str | None, size: int, overlap: int) -> list[str]:
    """Lines of a text gathered greedily to ``size`` characters, the last ``overlap`` of a chunk opening the next."""
    units = [u.strip() for u in (text or "").split("\n") if u.strip()]
    out, held = [], []
    for u in units:
        if held and sum(map(len, held)) + len(held) + len(u) > size:
            out.append("\n".join(held))
            held = held[-overlap:] if overlap and len(held) > overlap else []
        held.append(u)
    return out + (["\n".join(held)] if held else [])


def _paragraph_chunks(size: int, overlap: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(k, i, body) for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for i, body in enumerate(paragraph_cut(t, size, overlap))]
            for at in range(0, len(rows), 4096):
                ids, places, bodies = zip(*rows[at : at + 4096], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(places, pa.int32()), pa.array(bodies, pa.string())], names=["doc_id", "chunk", "body"])

    return task


def paragraph_chunks(docs: DataFrame, size: int = 1000, overlap: int = 2) -> DataFrame:
    """(doc_id, chunk, body): lines gathered greedily to ``size`` characters; the last ``overlap``
    lines of a chunk open the next one. A fold over a row's lines, so it runs in an Arrow task."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_paragraph_chunks(size, overlap), "doc_id bigint, chunk int, body string")


def page_fields(pages: DataFrame, images: int = 10) -> DataFrame:
    """Title (first h1, else the title tag), links and images of HTML pages, without tags."""
    html = F.coalesce(F.col("html"), F.lit(""))
    strip = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]*>", ""), r"\s+", " "))
    h1, title = strip(F.regexp_extract(html, "(?is)<h1[^>]*>(.*?)</h1>", 1)), strip(F.regexp_extract(html, "(?is)<title[^>]*>(.*?)</title>", 1))
    src = F.slice(F.array_distinct(F.regexp_extract_all(html, F.lit("(?i)<img[^>]+src=\"([^\"]+)\""), 1)), 1, images)
    links = F.array_distinct(F.regexp_extract_all(html, F.lit("(?i)<a[^>]+href=\"([^\"]+)\""), 1))
    return pages.select("page_id", F.when(h1 != "", h1).otherwise(title).alias("title"), src.alias("images"), links.alias("links"), F.size(F.regexp_extract_all(html, F.lit("(?i)<p[ >]"), 0)).cast("long").alias("paragraphs"))


def _meta(html: Column, name: str) -> Column:
    """The content of the first meta tag of a property or name, whichever order its attributes have."""
    q = "[\"']"
    named, content = f"(?:property|name)={q}{name}{q}", f"content={q}([^\"']+)"
    first, other = F.regexp_extract(html, rf"(?i)<meta\s+{named}\s+{content}", 1), F.regexp_extract(html, rf"(?i)<meta\s+{content}{q}[^>]*?{named}", 1)
    return F.trim(F.when(first != "", first).otherwise(other))


#: A picture's path: the number of the resource, the size it is shown in, the file.
PICTURE = r"((?:https?://[^/\"'\s]+)?/assets/images/resources/[0-9]+/[A-Za-z0-9_]+/[a-f0-9]+\.(?:webp|jpg|jpeg|png))"
SMALL, MEDIUM = "/smallwebp/", "/mediumwebp/"


def page_media(pages: DataFrame, base: str, images: int = 10) -> DataFrame:
    """(page_id, title, images) of HTML pages: the first plain h1, else the title of og:title; pictures in order.

    A picture shown in several sizes is taken once, by the number of its resource, in the medium size
    where the small one comes first. Relative paths become absolute under ``base``. A page without
    pictures has that of og:image, if any. Null pages have an empty title and no pictures.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    h1 = F.trim(F.regexp_extract(html, "(?i)<h1[^>]*>([^<]+)</h1>", 1))
    found = F.regexp_extract_all(html, F.lit(f"(?i){PICTURE}"), 1)
    number = lambda x: F.regexp_extract(x, "/resources/([0-9]+)/", 1)
    ids = F.transform(found, number)
    once = F.filter(found, lambda x, i: F.array_position(ids, number(x)) == i + 1)
    whole = F.transform(once, lambda x: F.replace(F.when(x.startswith("/"), F.concat(F.lit(base), x)).otherwise(x), F.lit(SMALL), F.lit(MEDIUM)))
    image = _meta(html, "og:image")
    media = F.when(F.size(whole) > 0, F.slice(whole, 1, images)).when(image != "", F.array(image)).otherwise(F.array().cast("array<string>"))
    return pages.select("page_id", F.when(h1 != "", h1).otherwise(_meta(html, "og:title")).alias("title"), media.alias("images"))


def deep_urls(pages: DataFrame, least: int, without: list[str]) -> DataFrame:
    """Pages whose path has at least ``least`` parts, none of them excluded."""
    path = F.regexp_extract("url", r"^[a-z]+://[^/?#]+([^?#]*)", 1)
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    return pages.withColumn("path", path).withColumn("depth", F.size(parts).cast("long")).filter((F.col("depth") >= least) & ~F.arrays_overlap(parts, F.array(*[F.lit(w) for w in without])))


def search_text(name: Column, direction: Column, price: Column, **more: Column) -> Column:
    """One searchable line from optional labelled parts."""
    return joined(", ", name, F.concat(F.lit("direction: "), direction), F.concat(F.lit("price: "), F.format_number(price, 2)), *[F.concat(F.lit(f"{k}: "), v) for k, v in more.items()])


def longest_version(records: DataFrame, key: str, text: str, order: str) -> DataFrame:
    """Of records with the same key the one with the longest text, the first of equally long ones."""
    rn = F.row_number().over(W.partitionBy(key).orderBy(F.desc(F.length(text)), order))
    return records.withColumn("_rn", rn).filter("_rn = 1").drop("_rn")


def field_fill(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows and the share of filled values of each column, in one pass."""
    filled = lambda c: F.count_if(F.col(c).isNotNull() & (F.trim(F.col(c).cast("string")) != ""))
    one = df.agg(F.count(F.lit(1)).alias("_n"), *[filled(c).alias(c) for c in columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("filled")) for c in columns])
    return one.select("_n", F.inline(pairs)).select("column", F.col("_n").alias("rows"), "filled", F.round(F.col("filled") / F.col("_n"), 4).alias("share"))
