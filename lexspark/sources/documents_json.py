"""Nested JSON documents: guarded reading, flattening and page layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexspark.functions import text as fx

NESTED = "data struct<surahs: array<struct<number: int, name: string, englishName: string, ayahs: array<struct<numberInSurah: int, text: string, juz: int, page: int, hizbQuarter: int, sajda: boolean>>>>>"


PASSAGE = (
    "surah int, surah_name string, surah_transliteration string, surah_type string, ayah_start int, ayah_end int, "
    "ayahs array<struct<number: int, text: string>>, ayah_text string, explanation string"
)
VERSE = (
    "id string, surahNumber int, surahNameArabic string, surahNameEnglish string, ayahNumber int, textUthmani string, "
    "textSimple string, textNormalized string, "
    "juz int, page int, hizbQuarter int, sajda boolean"
)
PAGE = (
    "pageNumber int, juz int, surahs array<string>, lines array<struct<lineNumber: int, text: string, "
    "words: array<struct<textUthmani: string, surahNumber: int, ayahNumber: int, wordNumber: int, isAyahEnd: boolean>>, "
    "isSurahHeader: boolean, isBismillah: boolean>>"
)
API_PAGE = (
    "verses array<struct<verse_key: string, juz_number: int, "
    "words: array<struct<text_uthmani: string, text: string, line_number: int, position: int, char_type_name: string>>>>"
)
QUESTION = "id string, question string, answer string, keywords array<string>, language string"


def _all_there(row: Column | None, names: list[str]) -> Column:
    out = F.lit(True)
    for name in names:
        out = out & (F.col(name) if row is None else row[name]).isNotNull()
    return out


def is_passage(row: Column | None = None) -> Column:
    """Whether a passage has its fields; verses, English name and kind may be missing."""
    return _all_there(row, ["surah", "surah_name", "ayah_start", "ayah_end", "ayah_text", "explanation"])


def is_verse(row: Column | None = None) -> Column:
    """Whether a verse has its fields; quarter and prostration may be missing."""
    return _all_there(row, [f.split()[0] for f in VERSE.split(", ")][:10])


def is_page(row: Column | None = None) -> Column:
    """Whether a page, every line of it and every word of these have their fields."""
    lines = F.col("lines") if row is None else row["lines"]
    word = lambda w: _all_there(w, ["textUthmani", "surahNumber", "ayahNumber", "wordNumber"])
    line = lambda x: _all_there(x, ["lineNumber", "text", "words"]) & F.coalesce(
        F.forall(x["words"], word), F.lit(False)
    )
    return _all_there(row, ["pageNumber", "juz", "surahs", "lines"]) & F.coalesce(F.forall(lines, line), F.lit(False))


def guarded(spark: SparkSession, path: str, schema: str, required: list[str], also: Column | None = None) -> DataFrame:
    """Rows of JSON files of one array or object each, in which all required fields have the schema's type; others are left out."""
    rows = spark.read.schema(schema).option("mode", "PERMISSIVE").json(path, multiLine=True)
    valid = _all_there(None, required) if also is None else _all_there(None, required) & F.coalesce(also, F.lit(False))
    return rows.where(valid)


def load_passages(spark: SparkSession, path: str) -> DataFrame:
    """The valid passages of JSON files, kept in memory or on disk once read; a read that fails keeps nothing and may be tried again."""
    return guarded(spark, path, PASSAGE, [], is_passage()).persist()


def load_verses(spark: SparkSession, path: str) -> DataFrame:
    return guarded(spark, path, VERSE, [], is_verse()).persist()


def load_pages(spark: SparkSession, path: str) -> DataFrame:
    return guarded(spark, path, PAGE, [], is_page()).persist()


def question_index(rows: DataFrame) -> DataFrame:
    """Questions that have an answer, with the normal forms of both and of the keywords that aren't empty."""
    given = rows.where(F.col("question").isNotNull() & F.col("answer").isNotNull())
    words = F.filter(F.transform(F.coalesce("keywords", F.array().cast("array<string>")), fx.normalize), lambda k: k != "")
    return given.withColumns({
        "norm_question": fx.normalize(F.col("question")), "norm_answer": fx.normalize(F.col("answer")), "norm_keywords": words
    })


def passage_index(passages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(passages with the normal forms of text and explanation, their verses one by one with normal and loose form); for tables that many queries read.

    passages: idx and the fields of PASSAGE. Verses: idx, surah, surah_name, surah_transliteration, ayah, text, norm, loose.
    """
    indexed = passages.withColumns({
        "norm_text": fx.normalize(F.col("ayah_text")), "norm_explanation": fx.normalize(F.col("explanation"))
    })
    each = passages.select("idx", "surah", "surah_name", "surah_transliteration", F.explode("ayahs").alias("v"))
    flat = each.select(
        "idx", "surah", "surah_name", "surah_transliteration", F.col("v.number").alias("ayah"), F.col("v.text").alias("text"),
        fx.normalize(F.col("v.text")).alias("norm")
    )
    return indexed, flat.withColumn("loose", fx.loose_key(F.col("norm")))


def first_names(verses: DataFrame) -> DataFrame:
    """surahNumber, name: the name in the first row of each chapter. verses: ord, surahNumber, surahNameArabic."""
    return verses.where("surahNumber IS NOT NULL").groupBy("surahNumber").agg(F.min_by("surahNameArabic", "ord").alias("name"))


def completeness(raw: DataFrame, valid: Column, expected: int) -> DataFrame:
    """n_rows, n_valid, state of one table: ready if all rows are valid and as many as expected, missing if none is, else partial."""
    counts = raw.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(valid).alias("n_valid"))
    ready = (F.col("n_rows") == expected) & (F.col("n_valid") == expected)
    return counts.withColumn("state", F.when(ready, "ready").when(F.col("n_valid") == 0, "missing").otherwise("partial"))


def flattened(nested: DataFrame) -> DataFrame:
    """One row for each verse of the nested documents (see NESTED), with its parent's names, an id and the normal form of the loading step."""
    verses = nested.select(F.explode("data.surahs").alias("s")).select(
        "s.number", "s.name", "s.englishName", F.explode("s.ayahs").alias("v")
    )
    return verses.select(
        F.concat_ws(":", "number", "v.numberInSurah").alias("id"), F.col("number").alias("group_number"), "name", "englishName",
        F.col("v.numberInSurah").alias("row_number"),
        F.col("v.text").alias("text"), fx.normalize_for_load(F.col("v.text")).alias("norm"), "v.juz", "v.page", "v.hizbQuarter",
        F.coalesce("v.sajda", F.lit(False)).alias("sajda"),
    )


def page_lines(words: DataFrame) -> DataFrame:
    """Lines of pages. words: page, line, position (on the page), verse, text, kind; markers of a verse's end are no words.

    page, line, text (words by position, with spaces), verses (distinct, in order), ends (whether
    a verse's last word is on the line). A word without a line number fails the query.
    """
    checked = words.withColumn(
        "line", F.when(F.col("line").isNull(), F.raise_error(F.lit("a word without a line"))).otherwise(F.col("line"))
    )
    real = checked.where(~F.col("kind").eqNullSafe("end"))
    marked = real.withColumn("_end", F.col("position") == F.max("position").over(W.partitionBy("page", "verse")))
    lines = marked.groupBy("page", "line").agg(
        F.sort_array(F.collect_list(F.struct("position", "verse", "text"))).alias("_w"), F.bool_or("_end").alias("ends")
    )
    return lines.select(
        "page", "line", F.array_join("_w.text", " ").alias("text"), F.array_distinct("_w.verse").alias("verses"), "ends"
    )


def merged(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of both by key; where both have one, the new one stays. Keys are distinct in each."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def api_words(pages: DataFrame) -> DataFrame:
    """One row for each word of the layout service's pages, without the markers of a verse's end.

    pages: page and the fields of API_PAGE. Columns: page, at (order on the page), surah, ayah, word,
    line, text, is_end. A page without verses or a word without a line fails the query.
    """
    checked = F.when(
        F.coalesce(F.size("verses"), F.lit(0)) > 0, F.col("verses")
    ).otherwise(F.raise_error(F.concat(F.lit("no verses on page "), F.col("page").cast("string"))).cast(API_PAGE[7:]))
    verses = pages.select("page", F.posexplode(checked).alias("v", "verse"))
    words = F.filter(
        F.coalesce(
            "verse.words",
            F.array().cast("array<struct<text_uthmani: string, text: string, line_number: int, position: int, char_type_name: "
                "string>>")
        ),
        lambda w: ~w["char_type_name"].eqNullSafe("end")
    )
    each = verses.select(
        "page", "v", F.col("verse.verse_key").alias("key"), F.size(words).alias("n"), F.posexplode(words).alias("i", "w")
    )
    full = lambda c: F.nullif(c, F.lit(""))
    line = F.when(
        F.col("w.line_number").isNull(), F.raise_error(F.concat(F.lit("a word without a line: "), F.col("key"))).cast("int")
    ).otherwise(F.col("w.line_number"))
    number = lambda k: F.get(F.split("key", ":"), k).try_cast("int")
    return each.select(
        "page", F.struct("v", "i").alias("at"), number(0).alias("surah"), number(1).alias("ayah"), F.coalesce(
            F.nullif(F.col("w.position"), F.lit(0)), F.col("i") + 1
        ).alias("word"),
        line.alias("line"), F.coalesce(
            full(F.col("w.text_uthmani")), full(F.col("w.text")), F.lit("")
        ).alias("text"), (F.col("i") == F.col("n") - 1).alias("is_end"),
    )


def layout_pages(pages: DataFrame, names: DataFrame) -> DataFrame:
    """page, juz, surahs, lines of the layout service's pages: see PAGE. names: surahNumber, name; a chapter without a name is shown by its number.

    Words are gathered by line and lines by page, which have a few hundred words at most.
    """
    word = F.struct("at", "text", "surah", "ayah", "word", "is_end")
    lines = api_words(pages).groupBy("page", "line").agg(F.sort_array(F.collect_list(word)).alias("w"))
    line = F.struct(
        F.col("line"), F.array_join("w.text", " ").alias("text"),
        F.transform("w", lambda x: F.struct(*[x[c].alias(c) for c in ("text", "surah", "ayah", "word", "is_end")])).alias("words")
    )
    held = lines.groupBy("page").agg(F.sort_array(F.collect_list(line)).alias("lines"))
    verses = pages.select("page", F.posexplode("verses").alias("v", "verse")).select(
        "page", "v", F.get(F.split("verse.verse_key", ":"), 0).try_cast("int").alias("surahNumber"),
        F.nullif(F.col("verse.juz_number"), F.lit(0)).alias("juz")
    )
    named = verses.join(names, "surahNumber", "left").withColumn("name", F.coalesce("name", F.col("surahNumber").cast("string")))
    heads = named.groupBy("page").agg(
        F.coalesce(F.max_by("juz", F.when(F.col("juz").isNotNull(), F.col("v"))), F.lit(0)).alias("juz"),
        F.array_distinct(F.sort_array(F.collect_list(F.struct("v", "name")))["name"]).alias("surahs"),
    )
    return heads.join(held, "page", "left")


def resumed(existing: DataFrame, fetched: DataFrame) -> DataFrame:
    """Pages so far and the newly fetched ones before the first that failed; a new page replaces an old one. fetched: page, body (null if it failed)."""
    first_bad = F.broadcast(fetched.agg(F.min(F.when(F.col("body").isNull(), F.col("page"))).alias("_bad")))  # one row
    good = fetched.join(first_bad, F.lit(True)).where(F.col("_bad").isNull() | (F.col("page") < F.col("_bad"))).select("page", "body")
    return merged(existing.select("page", "body"), good, "page")


def line_flags(words: DataFrame, chapters: DataFrame) -> DataFrame:
    """page, line, starts (the chapter that begins with the line), is_last (it has a chapter's last verse's end), n_words, justified.

    words: page, line, at, surah, ayah, word, is_end. chapters: number, n_verses. A mark of a verse's end counts as a word only if the line has nothing else.
    """
    held = words.groupBy("page", "line").agg(
        F.min_by(F.struct("surah", "ayah", "word"), "at").alias("first"), F.max_by(
            F.struct("surah", "ayah", "is_end"), "at"
        ).alias("last"),
        F.count(F.lit(1)).alias("n"), F.count_if(~F.col("is_end")).alias("plain"),
    )
    known = held.join(
        chapters.select(F.col("number").alias("_surah"), "n_verses"), F.col("last.surah") == F.col("_surah"), "left"
    )
    is_last = F.coalesce(F.col("last.is_end") & (F.col("last.ayah") == F.col("n_verses")), F.lit(False))
    n = F.when(F.col("n") == 1, F.lit(1)).otherwise(F.col("plain")).cast("long")
    starts = F.when((F.col("first.ayah") == 1) & (F.col("first.word") == 1), F.col("first.surah"))
    return known.select(
        "page", "line", starts.alias("starts"), is_last.alias("is_last"), n.alias("n_words"),
        (~is_last & (n >= 4)).alias("justified")
    )


def page_of_verse(words: DataFrame, asked: DataFrame) -> DataFrame:
    """id, page: the first page with a word of the verse; null if none has one. words: page, surah, ayah; asked: id, surah, ayah."""
    pages = words.groupBy("surah", "ayah").agg(F.min("page").alias("page"))
    return asked.join(pages, ["surah", "ayah"], "left").select("id", "page")
