"""Lists and lookups over the tables of a reader: chapters, pages, verses, passages, references.

Chapters are a few hundred rows at most, which is checked before they are broadcast; everything
else is joined by key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexspark.functions import text as fx

N_PAGES = 604
MOST_CHAPTERS = 1000
# The first page of each part of the printed text, and the chapters without an opening formula of their own and of the later period.
PART_PAGES = [
    1, 22, 42, 62, 82, 102, 121, 142, 162, 182, 201, 222, 242, 262, 282, 302, 322, 342, 362, 382, 402, 422, 442, 462, 482, 502,
    522, 542, 562, 582
]
NO_OPENING = [1, 9]
MEDINAN = [2, 3, 4, 5, 8, 9, 13, 22, 24, 33, 47, 48, 49, 55, 57, 58, 59, 60, 61, 62, 63, 64, 65, 66, 76, 98, 99, 110]
SHOWN_REFERENCES, SHOWN_RELATED, SHOWN_RESULTS = 12, 6, 30


def small(chapters: DataFrame) -> DataFrame:
    """The table for a broadcast, once it is known to be small."""
    if (n := chapters.count()) > MOST_CHAPTERS:
        raise ValueError(f"{n} chapters are too many for a broadcast")
    return F.broadcast(chapters)


def kind_of_chapter(number: Column) -> Column:
    return F.when(number.isin(MEDINAN), "medinan").otherwise("meccan")


def has_opening(number: Column) -> Column:
    """Whether a chapter shows the opening formula on a line of its own."""
    return ~number.isin(NO_OPENING)


def listed_chapters(searches: DataFrame, chapters: DataFrame) -> DataFrame:
    """id, number of the chapters that a search shows. searches: id, query, kind (0 all, 1 meccan, 2 medinan).

    Digits find a chapter by its number or its first page; else the name must hold the query's
    normal form. An empty or null query shows all.
    """
    c, s = chapters.alias("c"), searches.withColumn("q", fx.normalize(F.trim(F.coalesce("query", F.lit(""))))).alias("s")
    kind = kind_of_chapter(F.col("c.number"))
    right = (F.col("s.kind") == 0) | ((F.col("s.kind") == 1) & (kind == "meccan")) | ((F.col("s.kind") == 2) & (kind == "medinan"))
    digits = F.col("q").rlike("^[0-9]+$")
    by_name = fx.normalize(F.col("c.name")).contains(F.col("q")) | F.lower("c.english").contains(F.col("q"))
    by_number = (F.col("c.number") == F.col("q").try_cast("int")) | (F.col("c.first_page") == F.col("q").try_cast("int"))
    found = (F.col("q") == "") | F.when(digits, by_number).otherwise(by_name)
    return s.join(small(c), right & found).select("s.id", "c.number")


def jump_list(searches: DataFrame, chapters: DataFrame) -> DataFrame:
    """id, number of the chapters whose name, English name or number holds the query; all for an empty one."""
    s = searches.withColumn("q", fx.normalize(F.coalesce("query", F.lit("")))).alias("s")
    c = chapters.alias("c")
    raw = F.lower(F.trim(F.coalesce("s.query", F.lit(""))))
    found = (F.col("q") == "") | fx.normalize(F.col("c.name")).contains(F.col("q")) | F.lower("c.english").contains(raw) | F.col("c.number").cast("string").contains(F.col("q"))
    return s.join(small(c), found).select("s.id", "c.number")


def chapter_by_name(names: DataFrame, chapters: DataFrame) -> DataFrame:
    """id, number: the first chapter whose name is the one given, holds it without the word for a chapter, or is held by it; null if none."""
    n, c = names.withColumn("clean", fx.bare_name(F.col("name"))).alias("n"), chapters.alias("c")
    bare = F.regexp_replace("c.name", "^سورة\\s*", "")
    hit = (F.col("c.name") == F.col("n.name")) | F.col("c.name").contains(F.col("clean")) | F.col("clean").contains(bare)
    return n.join(small(c), hit, "left").groupBy("n.id").agg(F.min("c.number").alias("number"))


def typed_page(text: Column, n_pages: int = N_PAGES) -> Column:
    """The page that was typed, in digits of either kind; null if it is none."""
    n = fx.western_digits(F.trim(text)).try_cast("int")
    return F.when(n.between(1, n_pages), n)


def next_page(page: Column, n_pages: int = N_PAGES) -> Column:
    return F.when(page < n_pages, page + 1)


def previous_page(page: Column) -> Column:
    return F.when(page > 1, page - 1)


def part_of_page(page: Column) -> Column:
    """The part that a page lies in, by the fixed first pages."""
    return F.size(F.filter(F.lit(PART_PAGES), lambda p: p <= page))


def first_pages(pages: DataFrame) -> DataFrame:
    """juz, page: the first page of each part, of pages with a part other than 0."""
    return pages.where("juz <> 0").groupBy("juz").agg(F.min("page").alias("page"))


def passage_of(asked: DataFrame, passages: DataFrame) -> DataFrame:
    """id and the first passage (by idx) that holds the verse; null if none does. asked: id, surah, ayah. Joined by chapter."""
    a, p = asked.alias("a"), passages.alias("p")
    inside = (F.col("a.surah") == F.col("p.surah")) & F.col("a.ayah").between(F.col("p.ayah_start"), F.col("p.ayah_end"))
    return a.join(p, inside, "left").groupBy("a.id").agg(F.min("p.idx").alias("idx"))


def verse_of(asked: DataFrame, verses: DataFrame) -> DataFrame:
    """asked with the verse's text, empty if there is none. asked: surah, ayah."""
    return asked.join(
        verses.select("surah", "ayah", "text"), ["surah", "ayah"], "left"
    ).withColumn("text", F.coalesce("text", F.lit("")))


def note_key(key: Column) -> tuple[Column, Column]:
    """Chapter and verse of a key like 2:255; null where there is no number."""
    parts = F.split(key, ":")
    return F.get(parts, 0).try_cast("int"), F.get(parts, 1).try_cast("int")


def related(asked: DataFrame, verses: DataFrame, passages: DataFrame, at_most: int = SHOWN_RELATED) -> DataFrame:
    """id, ayah of the other verses in the passage of a verse, the first few. asked: id, surah, ayah."""
    held = passage_of(asked, passages).join(asked, "id").join(passages.select("idx", "ayah_start", "ayah_end"), "idx")
    v = verses.select("surah", F.col("ayah").alias("other"))
    near = held.join(v, "surah").where(F.col("other").between(F.col("ayah_start"), F.col("ayah_end")) & (F.col("other") != F.col("ayah")))
    placed = near.withColumn("_n", F.row_number().over(W.partitionBy("id").orderBy("other"))).where(F.col("_n") <= at_most)
    return placed.select("id", F.col("other").alias("ayah"))


def topic_verses(topics: DataFrame, verses: DataFrame, at_most: int = SHOWN_REFERENCES) -> DataFrame:
    """topic, place, surah, ayah, text of the first references of a topic that name a verse. topics: topic, place (from 0), surah, ayah."""
    return topics.where(F.col("place") < at_most).join(
        verses.select("surah", "ayah", "text"), ["surah", "ayah"]
    ).select("topic", "place", "surah", "ayah", "text")


def progress_in_chapter(positions: DataFrame, chapters: DataFrame) -> DataFrame:
    """Positions with progress: the share of the chapter's verses that the last one read makes; 0 for an unknown chapter."""
    n = F.greatest(F.lit(1), F.col("n_verses"))
    return positions.join(
        small(chapters.select(F.col("number").alias("surah"), "n_verses")), "surah", "left"
    ).withColumn("progress", F.coalesce(F.col("ayah") / n, F.lit(0.0))).drop("n_verses")


def continue_label(state: DataFrame, pages: DataFrame, default: str) -> DataFrame:
    """id, label: the first chapter on the page read last (1 if none), else that of the last position, else the default; without the word for a chapter.

    state: id, page, position_name. pages: page, surahs (array of names).
    """
    held = state.withColumn("page", F.coalesce("page", F.lit(1))).join(
        pages.select("page", F.get("surahs", 0).alias("_first")), "page", "left"
    )
    return held.select("id", fx.bare_name(F.coalesce("_first", "position_name", F.lit(default))).alias("label"))


def name_table(chapters: DataFrame) -> DataFrame:
    """variant, number: every form under which a chapter is found; the first chapter that has it keeps it. chapters: number, name, english."""
    each = chapters.select("number", F.explode(fx.name_variants(F.col("name"), F.col("english"))).alias("variant"))
    return each.groupBy("variant").agg(F.min("number").alias("number"))


def quoted(references: Column, kind: str = "quran") -> Column:
    """The references of one kind, without it. references: array of (type, surah, ayah, text)."""
    return F.transform(
        F.filter(references, lambda r: r["type"] == kind),
        lambda r: F.struct(r["surah"].alias("surah"), r["ayah"].alias("ayah"), r["text"].alias("text"))
    )


def shown_references(new: Column, legacy: Column) -> Column:
    """The references of an answer; those of the old form where there are none."""
    return F.when(F.coalesce(F.size(new), F.lit(0)) > 0, new).otherwise(quoted(legacy))


def nearest_step(value: Column, steps: list[int]) -> Column:
    """The place of the nearest step, the first of equally near ones."""
    each = F.array(*[F.struct(F.abs(F.lit(s) - value).alias("far"), F.lit(i).alias("i")) for i, s in enumerate(steps)])
    return F.array_min(each)["i"]
