"""Page spans, tables of contents and their chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hybridkb.functions.text import token_count, words

CAP = 200


def median_font(spans: DataFrame) -> DataFrame:
    """doc_id, page, median_size."""
    return spans.groupBy("doc_id", "page").agg(F.percentile("size", F.lit(0.5)).alias("median_size"))


def span_headings(spans: DataFrame) -> DataFrame:
    """The spans with ``heading``: larger than 1.15 medians of the page, or bold and short; never blank."""
    usual = F.percentile("size", F.lit(0.5)).over(Window.partitionBy("doc_id", "page"))
    big = F.col("size") > 1.15 * F.col("_usual")
    bold = F.contains(F.col("font"), F.lit("Bold")) & (F.length("text") < 80)
    return spans.withColumn("_usual", usual).withColumn("heading", (F.trim("text") != "") & (big | bold)).drop("_usual")


def span_sections(spans: DataFrame, least: int = 3) -> DataFrame:
    """doc_id, section, page_start, page_end, content: with fewer than ``least`` headings in a document one
    section a page; else the first heading of a page starts a section and pages without one continue it."""
    marked = span_headings(spans)
    pages = marked.groupBy("doc_id", "page").agg(
        F.min(F.when(F.col("heading"), F.struct("span_no", F.trim("text").alias("t")))).alias("h"),
        F.count_if("heading").alias("n_headings"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("heading") & (F.trim("text") != ""), F.struct("span_no", "text")))), lambda x: x["text"]), " ").alias("body"),
    )
    carry = F.last("h.t", True).over(Window.partitionBy("doc_id").orderBy("page"))
    page_name = F.concat(F.lit("Page "), F.col("page").cast("string"))
    pages = pages.withColumn("n", F.sum("n_headings").over(Window.partitionBy("doc_id")))
    named = pages.withColumn("section", F.when(F.col("n") < least, page_name).otherwise(F.coalesce(carry, page_name)))
    order = Window.partitionBy("doc_id").orderBy("page")
    named = named.withColumn("run", F.sum(F.when(F.col("section").eqNullSafe(F.lag("section").over(order)), 0).otherwise(1)).over(order))
    out = named.groupBy("doc_id", "run", "section").agg(F.min("page").alias("page_start"), F.max("page").alias("page_end"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "body"))), lambda x: x["body"]), "\n").alias("content"))
    return out.where(F.trim("content") != "").drop("run")


def image_pages(pages: DataFrame) -> DataFrame:
    """Pages that are pictures: fewer than ten characters and an image."""
    return pages.where((F.length(F.trim("text")) < 10) & (F.col("n_images") >= 1))


def page_selection(specs: DataFrame) -> DataFrame:
    """The rows with ``pages`` (sorted, each once) of ``spec``, a list of pages from 1 and ranges a-b parted by commas, or
    ``reason`` why it is none."""
    first, last = r"^\s*(\d+)", r"-\s*(\d+)\s*$"
    number = lambda p, form: F.regexp_extract(p, form, 1).try_cast("int")
    bound = lambda p: F.struct(number(p, first).alias("a"), F.coalesce(number(p, last), number(p, first)).alias("b"), p.rlike(r"^\s*\d+\s*(-\s*\d+\s*)?$").alias("ok"))
    rows = specs.withColumn("_bounds", F.transform(F.split("spec", ","), bound))
    bad = F.when(F.col("spec").isNull() | F.exists("_bounds", lambda x: ~x["ok"] | x["a"].isNull() | x["b"].isNull()), "not a page").when(F.exists("_bounds", lambda x: (x["a"] < 1) | (x["b"] < x["a"])), "out of order")
    ranges = F.transform(F.filter("_bounds", lambda x: x["ok"] & (x["a"] <= x["b"])), lambda x: F.sequence(x["a"], x["b"]))
    good = F.array_sort(F.array_distinct(F.flatten(ranges)))
    return rows.select(*specs.columns, F.when(bad.isNull(), good).alias("pages"), bad.alias("reason"))


def selected_pages(specs: DataFrame, pages: DataFrame) -> DataFrame:
    """The pages (doc_id, page and others) that some spec (doc_id, spec) of their document selects; pages that a document
    does not have are left out, and so are specs that are none."""
    wanted = page_selection(specs).select("doc_id", F.explode("pages").alias("page")).distinct()
    return pages.hint("shuffle_merge").join(wanted, ["doc_id", "page"], "left_semi")


def toc_paths(toc: DataFrame) -> DataFrame:
    """doc_id, seq, page, path: every entry of a table of contents under its ancestors, which are the entries of lower
    levels that are still open. One fold over the entries of a document, which carries the open ones."""
    entries = F.array_sort(F.collect_list(F.struct("seq", F.col("level").cast("int").alias("level"), "title", "page")))
    zero = F.expr("named_struct('open', cast(array() AS array<struct<level:int,title:string>>), 'out', cast(array() AS array<struct<seq:bigint,page:bigint,path:string>>))")

    def step(a: Column, x: Column) -> Column:
        open_ = F.concat(F.filter(a["open"], lambda o: o["level"] < x["level"]), F.array(F.struct(x["level"].alias("level"), x["title"].alias("title"))))
        path = F.array_join(F.transform(open_, lambda o: o["title"]), " > ")
        row = F.struct(x["seq"].cast("bigint").alias("seq"), x["page"].cast("bigint").alias("page"), path.alias("path"))
        return F.struct(open_.alias("open"), F.concat(a["out"], F.array(row)).alias("out"))

    folded = toc.groupBy("doc_id").agg(entries.alias("entries")).select("doc_id", F.explode(F.aggregate("entries", zero, step, lambda a: a["out"])).alias("e"))
    return folded.select("doc_id", "e.seq", "e.page", "e.path")


def toc_section(pages: DataFrame, toc: DataFrame) -> DataFrame:
    """The pages with ``section_path``: the last entry, in the order of the contents, that begins at or before
    the page; "Page n" before the first. Entries and pages run through one window, so each is read once."""
    e = toc_paths(toc).select("doc_id", F.col("page").alias("at"), F.struct("seq", "path").alias("entry"), F.lit(None).cast(pages.schema).alias("row"))
    p = pages.select("doc_id", F.col("page").cast("bigint").alias("at"), F.lit(None).cast("struct<seq:bigint,path:string>").alias("entry"), F.struct(*pages.columns).alias("row"))
    run = Window.partitionBy("doc_id").orderBy("at", F.col("row").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    best = e.unionByName(p).withColumn("best", F.max("entry").over(run)).where("row IS NOT NULL")
    return best.select("row.*", F.coalesce("best.path", F.concat(F.lit("Page "), F.col("at").cast("string"))).alias("section_path"))


def toc_chunks(pages: DataFrame, toc: DataFrame) -> DataFrame:
    """doc_id, page_start, page_end, section_path, content: one raw chunk for each page that has text."""
    named = toc_section(pages, toc)
    text = F.regexp_replace("text", r"^\s+|\s+$", "")
    return named.select("doc_id", F.col("page").alias("page_start"), F.col("page").alias("page_end"), "section_path", text.alias("content")).where("content <> ''")


def finalise_chunks(raw: DataFrame, cap: int = CAP) -> DataFrame:
    """The raw chunks packed to the cap, each part with its page range, its ``section_ordinal`` from 0 inside its
    section, and its ``token_count``."""
    parts = raw.select("doc_id", "section_path", "page_start", "page_end", F.posexplode(pack_words(F.col("content"), cap)).alias("part", "content"))
    order = Window.partitionBy("doc_id", "section_path").orderBy("page_start", "part")
    return parts.select("doc_id", "section_path", "page_start", "page_end", "content", token_count(F.col("content")).alias("token_count"), (F.row_number().over(order) - 1).alias("section_ordinal"))


def pack_words(text: Column, cap: int = CAP) -> Column:
    """Parts of at most ``cap`` tokens; sentences end with . ! ? or a blank line, longer ones are cut by words."""
    sentences = F.filter(F.split(text, r"(?<=[.!?])\s+|\n\s*\n"), lambda x: F.trim(x) != "")
    cut = F.flatten(F.transform(sentences, lambda s: F.when(token_count(s) <= cap, F.array(s)).otherwise(_by_words(s, cap))))
    sized = F.transform(cut, lambda s: F.struct(s.alias("s"), token_count(s).alias("n")))
    return _fold(sized, cap)


def _by_words(sentence: Column, cap: int) -> Column:
    return _fold(F.transform(words(sentence), lambda w: F.struct(w.alias("s"), token_count(w).alias("n"))), cap)


def _fold(sized: Column, cap: int) -> Column:
    zero = F.expr("named_struct('done', cast(array() AS array<string>), 'open', '', 'n', 0)")

    def step(a: Column, x: Column) -> Column:
        full = (a["open"] != "") & (a["n"] + x["n"] > cap)
        return F.struct(
            F.when(full, F.concat(a["done"], F.array(a["open"]))).otherwise(a["done"]).alias("done"),
            F.when(full | (a["open"] == ""), x["s"]).otherwise(F.concat(a["open"], F.lit(" "), x["s"])).alias("open"),
            F.when(full, x["n"]).otherwise(a["n"] + x["n"]).alias("n"),
        )

    return F.aggregate(sized, zero, step, lambda a: F.when(a["open"] != "", F.concat(a["done"], F.array(a["open"]))).otherwise(a["done"]))
