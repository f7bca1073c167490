"""Answers to a table of questions from a table of passages: what each question asks for, what the text has of it, and the first of the ways that gives an answer.

Questions: id, text, lang. Passages: idx, surah, surah_name, surah_transliteration, surah_type,
ayah_start, ayah_end, ayahs (array of number, text), ayah_text, explanation; see
``sources.documents_json.passage_index`` for the normal forms. Answers are rows with codes, numbers,
references and the text's own words; sentences around them are the caller's.

The passages are read once for all questions of a block: requests go to every task as arrays of at
most BLOCK, and what a row has of each is summed in the task before it is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexspark.functions import assistant as fa
from lexspark.functions import questions as qs
from lexspark.functions import text as fx
from lexspark.operators.lookups import small
from lexspark.operators.names import longest_name
from lexspark.operators.word_index import WordIndex

BLOCK = 1000
LOCATIONS, REFERENCES, TOP_GROUPS, SUMMARY_PASSAGES = 15, 12, 5, 6
SUMMARY_CHARS, PART_CHARS = 350, 160


def read_questions(questions: DataFrame) -> DataFrame:
    """id, text, reply (language of the answer), norm, kind, tokens, readable. A null text is empty."""
    text = F.coalesce("text", F.lit(""))
    q = questions.select(
        "id", text.alias("text"), F.when(fx.contains_arabic(text), "ar").otherwise(F.col("lang")).alias("reply"),
        fx.normalize(text).alias("norm")
    )
    readable = (F.length("norm") >= 2) & F.col("norm").rlike(qs.ANY_LETTER)
    return q.select(
        "*", qs.kind(F.col("norm")).alias("kind"), qs.tokens(F.col("norm")).alias("tokens"), readable.alias("readable")
    )


def asked_of(rows: DataFrame, requests: DataFrame, value: Callable[[Column], Column], keep: list[str]) -> DataFrame:
    """keep, the request's columns and those of value, for each row and request where value isn't null. value: a struct or null of a request."""
    n = max(1, -(-requests.count() // BLOCK))
    blocks = requests.select(
        F.pmod(F.xxhash64("id"), F.lit(n)).alias("_b"), F.struct(*requests.columns).alias("_r")
    ).groupBy("_b").agg(F.collect_list("_r").alias("_rs"))
    each = F.filter(F.transform("_rs", lambda r: F.struct(r.alias("r"), value(r).alias("v"))), lambda x: x["v"].isNotNull())
    met = rows.join(F.broadcast(blocks), F.lit(True)).select(*keep, F.explode(each).alias("_x"))
    return met.select(*keep, "_x.r.*", "_x.v.*")


def chapters_of(passages: DataFrame) -> DataFrame:
    """number, name, english, kind, first_idx, n_passages, n_verses of each chapter: names and kind of its first passage."""
    n = F.coalesce(F.size("ayahs"), F.col("ayah_end") - F.col("ayah_start") + 1)
    first = F.struct("surah_name", "surah_transliteration", "surah_type")
    held = passages.groupBy(F.col("surah").alias("number")).agg(
        F.min_by(first, "idx").alias("f"), F.min("idx").alias("first_idx"), F.count(F.lit(1)).alias("n_passages"),
        F.sum(n).cast("long").alias("n_verses")
    )
    return held.select(
        "number", F.col("f.surah_name").alias("name"), F.col("f.surah_transliteration").alias("english"),
        F.col("f.surah_type").alias("kind"), "first_idx", "n_passages", "n_verses"
    )


def named_chapter(q: DataFrame, names: DataFrame) -> DataFrame:
    """q with chapter: that of the longest name that the question has as whole words, the smallest number of equally long ones; null if none. names: variant, number."""
    best = longest_name(q, names, "id", "norm", "variant", "number").select("id", F.col("number").alias("chapter"))
    return q.join(best, "id", "left")


def named_verse(norm: Column) -> Column:
    """Struct of chapter and verse of the first name of a verse in the question; null if it has none."""
    padded = F.concat(F.lit(" "), norm, F.lit(" "))
    return F.coalesce(*[
        F.when(padded.contains(f" {name} "), F.struct(F.lit(s).alias("surah"), F.lit(a).alias("ayah"))) for name, s, a in fa.NAMED
    ])


# counts and places ---------------------------------------------------------------------------


def _replaced(text: Column, part: Column) -> Column:
    """The text with a blank for the first occurrence of a part."""
    at = F.call_function("locate", part, text)
    return F.when(
        part.isNotNull() & (at > 0),
        F.concat(F.substring(text, F.lit(1), at - 1), F.lit(" "), F.substring(text, at + F.length(part), F.lit(1 << 20)))
    ).otherwise(text)


def analytics_requests(q: DataFrame, names: DataFrame) -> DataFrame:
    """id, op, arg, other, scope, details of the questions about counts and places; op is null where none of the rules gives anything.

    op: no_data, longest_verse, shortest_verse, longest_chapter, shortest_chapter, compare, unparsed,
    first, last, locations, script (the word must be in Arabic letters), total_ayahs, total_surahs,
    total_words, total_letters, chars, count. arg: the word, or the code points, that are counted.
    """
    norm, padded = F.col("norm"), F.concat(F.lit(" "), F.col("norm"), F.lit(" "))
    group = lambda pattern, i: F.nullif(F.regexp_extract(padded, pattern, i), F.lit(""))
    w = q.select(
        "id", "norm", group(fa.SCOPE, 1).alias("kw"), group(fa.SCOPE, 2).alias("w1"),
        F.concat(group(fa.SCOPE, 2), F.lit(" "), group(fa.SCOPE, 3)).alias("two")
    )
    w = w.join(
        names.select(F.col("variant").alias("two"), F.col("number").alias("n2")), "two", "left"
    ).join(names.select(F.col("variant").alias("w1"), F.col("number").alias("n1")), "w1", "left")
    part = F.when(
        F.col("n2").isNotNull(), F.concat(F.lit(" "), "kw", F.lit(" "), "two")
    ).when(F.col("n1").isNotNull(), F.concat(F.lit(" "), "kw", F.lit(" "), "w1"))
    left = F.filter(F.split(_replaced(padded, part), " "), lambda t: t != "")
    t = w.select("id", "norm", F.coalesce("n2", "n1").alias("scope"), fa.without(left, fa.BASIC_FILLERS).alias("tokens"))
    t = t.select(
        "*", fa.one_target(fa.without(F.col("tokens"), fa.COUNT_FILLERS)).alias("counted"), fa.one_target(fa.without(
            F.col("tokens"), fa.COUNT_FILLERS, fa.LOCATION_FILLERS
        )).alias("placed"),
        F.get(F.filter(F.transform("tokens", fa.mark_of), lambda x: x.isNotNull()), 0).alias("mark"),
        fa.letter_of(F.get(
            "tokens", F.array_position(F.transform("tokens", lambda x: x.isin(fa.LETTER_WORDS)), True).cast("int")
        )).alias("letter"),
        F.nullif(
            F.regexp_extract("norm", fa.EITHER, 1), F.lit("")
        ).alias("a1"), F.nullif(F.regexp_extract("norm", fa.EITHER, 2), F.lit("")).alias("b1"),
        F.nullif(
            F.regexp_extract("norm", fa.BETWEEN, 1), F.lit("")
        ).alias("a2"), F.nullif(F.regexp_extract("norm", fa.BETWEEN, 2), F.lit("")).alias("b2"),
    )
    t = t.withColumns({
        "a": F.when(F.col("a1").isNotNull(), F.col("a1")).otherwise(F.col("a2")),
        "b": F.when(F.col("a1").isNotNull(), F.col("b1")).otherwise(F.col("b2"))
    })
    has = lambda p: norm.rlike(p)
    counting = fa.any_of(norm, fa.COUNTING)
    some = lambda kind: F.exists("tokens", lambda x: x.isin(fa.TOTALS[kind]))
    every = lambda kind: F.forall("tokens", lambda x: x.isin(fa.TOTALS[kind]))
    extreme = lambda of: F.when(has("اطول|longest"), f"longest_{of}").otherwise(f"shortest_{of}")
    able = lambda c: fa.latin(c) | (F.length(c) >= 2)
    word = lambda c, op: F.when(fa.latin(c), F.lit("script")).otherwise(op)
    end = F.when(has("اول|first"), "first").otherwise("last")
    op = (
        F.when(
            ~(counting | has(fa.LOCATION) | has(fa.FIRST_LAST) | has(fa.SUPERLATIVE) | has(fa.COMPARISON)),
            F.lit(None).cast("string")
        )
        .when(has(fa.NO_SCOPE), F.lit("no_data")).when(F.size("tokens") == 0, F.lit(None).cast("string"))
        .when(
            has(fa.SUPERLATIVE) & some("surahs"), extreme("chapter")
        ).when(has(fa.SUPERLATIVE) & some("ayahs"), extreme("verse"))
        .when(has(fa.COMPARISON), F.when(F.col("a").isNull(), "unparsed").otherwise("compare"))
        .when(has(fa.FIRST_LAST) & able(F.col("placed")), word(F.col("placed"), end)).when(
            has(fa.LOCATION) & able(F.col("placed")), word(F.col("placed"), F.lit("locations"))
        )
        .when(~counting, F.lit(None).cast("string"))
        .when(every("ayahs"), "total_ayahs").when(every("surahs"), "total_surahs").when(every("words"), "total_words").when(every("letters"), "total_letters")
        .when(
            F.col("mark").isNotNull() | F.col("letter").isNotNull(), "chars"
        ).when(able(F.col("counted")), word(F.col("counted"), F.lit("count")))
    )
    alias = lambda c: F.coalesce(fa.table_of(fa.ALIASES, c), c)
    arg = F.when(
        F.col("op").isin("first", "last", "locations"), F.col("placed")
    ).when(
        F.col("op") == "chars", F.coalesce("mark", "letter")
    ).when(F.col("op") == "count", F.col("counted")).when(F.col("op") == "compare", alias(F.col("a")))
    return t.withColumn("op", op).select(
        "id", "op", arg.alias("arg"), F.when(F.col("op") == "compare", alias(F.col("b"))).alias("other"), "scope",
        ((F.col("op") == "count") & has(fa.DETAILS)).alias("details")
    )


def passage_totals(requests: DataFrame, passages: DataFrame) -> DataFrame:
    """id, total, other, n_groups, top of the requests that sum over passages.

    other: how often a counted word stands alone, or the second word of a comparison. top: chapter
    and value of the chapters with most, for counts without a scope that two chapters or more share;
    for the longest or shortest chapter, that one. The first chapter comes first among equal ones.
    """
    asked = requests.where("op IN ('count', 'compare', 'chars', 'longest_chapter', 'shortest_chapter') OR op LIKE 'total_%'")
    norm, text = F.col("norm_text"), F.col("ayah_text")
    n = F.coalesce(F.size("ayahs"), F.col("ayah_end") - F.col("ayah_start") + 1)

    def value(r: Column) -> Column:
        op, arg = r["op"], F.coalesce(r["arg"], F.lit(""))
        v = (
            F.when(op.isin("count", "compare"), fa.target_occurrences(norm, arg)).when(op == "chars", fa.char_count(text, arg))
            .when(
                op.isin("total_ayahs", "longest_chapter", "shortest_chapter"), n
            ).when(op == "total_words", fx.word_count(norm)).when(op == "total_letters", fx.letter_count(text)).otherwise(1)
        )
        alone = fa.occurrences(F.concat(F.lit(" "), norm, F.lit(" ")), F.concat(F.lit(" "), arg, F.lit(" ")))
        o = F.when(op == "count", alone).when(
            op == "compare", fa.target_occurrences(norm, F.coalesce(r["other"], F.lit("")))
        ).otherwise(0)
        inside = r["scope"].isNull() | (r["scope"] == F.col("surah")) | op.isin(
            "total_surahs", "longest_chapter", "shortest_chapter"
        )
        return F.when(inside & ((v > 0) | (o > 0)), F.struct(v.cast("long").alias("value"), o.cast("long").alias("o")))

    met = asked_of(passages, asked, value, ["surah", "idx"])
    groups = met.groupBy("id", "op", "scope", "surah").agg(
        F.sum("value").alias("value"), F.sum("o").alias("o"), F.min("idx").alias("first")
    )
    low = F.col("op") == "shortest_chapter"
    place = F.row_number().over(W.partitionBy("id").orderBy(F.when(low, F.col("value")).otherwise(-F.col("value")), "first"))
    ranked = groups.where("value > 0 OR o > 0").withColumn("place", place)
    kept = F.when(
        F.col("place") <= F.when(F.col("op").endswith("_chapter"), 1).otherwise(TOP_GROUPS), F.struct("place", "surah", "value")
    )
    out = ranked.groupBy("id", "op", "scope").agg(
        F.sum("value").alias("sum"), F.sum("o").alias("other"), F.count_if(F.col("value") > 0).alias("n_groups"),
        F.sort_array(F.collect_list(kept)).alias("top")
    )
    ranks = F.col("op").endswith("_chapter") | (F.col("op").isin("chars", "count") & F.col("scope").isNull() & (F.col("n_groups") > 1))
    bare = F.transform(
        F.filter("top", lambda t: t["value"] > 0), lambda t: F.struct(t["surah"].alias("surah"), t["value"].alias("value"))
    )
    total = F.when(F.col("op") == "total_surahs", F.col("n_groups")).when(
        F.col("op").endswith("_chapter"), F.get("top", 0)["value"]
    ).otherwise(F.col("sum"))
    found = out.select(
        "id", total.alias("total"), "other", "n_groups",
        F.when(ranks, bare).otherwise(F.lit([]).cast("array<struct<surah:int,value:bigint>>")).alias("top")
    )
    return asked.select("id").join(found, "id", "left").select(
        "id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("total", "other", "n_groups")],
        F.coalesce("top", F.lit([]).cast("array<struct<surah:int,value:bigint>>")).alias("top")
    )


def verse_hits(
    requests: DataFrame, verses: DataFrame, match: Callable[[Column], Column], order: Callable[[], list[Column]], most: Column
) -> DataFrame:
    """id, n (verses that match) and refs (the first of them: surah, ayah, idx), of requests that have any. Only the first few of a request are ever in one place."""
    met = asked_of(
        verses, requests, lambda r: F.when(match(r), F.struct(F.lit(1).alias("one"))),
        ["ord", "idx", "surah", "ayah", "norm", "n_chars"]
    )
    counts = met.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    placed = met.withColumn(
        "place", F.row_number().over(W.partitionBy("id").orderBy(*order(), "ord"))
    ).where(F.col("place") <= LOCATIONS).where(F.col("place") <= most)
    refs = placed.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("place", "surah", "ayah", "idx"))).alias("r"))
    return counts.join(refs, "id").select(
        "id", "n",
        F.transform(
            "r", lambda x: F.struct(x["surah"].alias("surah"), x["ayah"].alias("ayah"), x["idx"].alias("idx"))
        ).alias("refs")
    )


def with_order(verses: DataFrame) -> DataFrame:
    """Verses of an index with ord (their place in the text) and n_chars."""
    return verses.withColumns({"ord": F.col("idx").cast("long") * (1 << 20) + F.col("ayah"), "n_chars": F.length("text")})


def analytics_places(requests: DataFrame, verses: DataFrame) -> DataFrame:
    """id, n, refs of the requests for places: all for a list of places and for a count with details, the first or last one, the longest or shortest."""
    asked = requests.where("op IN ('first', 'last', 'locations', 'longest_verse', 'shortest_verse') OR (op = 'count' AND details)")
    extreme = lambda r: r["op"].endswith("_verse")
    match = lambda r: (r["scope"].isNull() | (r["scope"] == F.col("surah"))) & (extreme(r) | (fa.target_occurrences(
        F.col("norm"), F.coalesce(r["arg"], F.lit(""))
    ) > 0))
    key = F.when(
        F.col("op") == "longest_verse", -F.col("n_chars")
    ).when(F.col("op") == "shortest_verse", F.col("n_chars")).when(F.col("op") == "last", -F.col("ord")).otherwise(0)
    return verse_hits(
        asked, with_order(verses), match, lambda: [key], F.when(F.col("op").isin("locations", "count"), LOCATIONS).otherwise(1)
    )


# references ----------------------------------------------------------------------------------


def reference_answers(q: DataFrame, names: DataFrame, passages: DataFrame) -> DataFrame:
    """id, surah, ayah, idx, note of the questions that name a chapter or verse: a verse's own name, else a chapter's with the first number, else two numbers of which the first is a chapter.

    idx is the passage; without a verse it is the chapter's first, and note is first_passage where
    there are more. A verse that no passage holds gives note out_of_range and no idx.
    """
    info = chapters_of(passages)
    n = fa.numbers(F.col("norm"))
    told = named_chapter(q, names).withColumns({"v": named_verse(F.col("norm")), "ns": n})
    surah = F.when(F.col("v").isNotNull(), F.col("v.surah")).when(
        F.col("chapter").isNotNull(), F.col("chapter")
    ).when(F.size("ns") == 2, F.get("ns", 0))
    ayah = F.when(F.col("v").isNotNull(), F.col("v.ayah")).when(
        F.col("chapter").isNotNull(), F.get("ns", 0)
    ).when(F.size("ns") == 2, F.get("ns", 1))
    parsed = told.select("id", surah.alias("surah"), ayah.alias("ayah")).where("surah IS NOT NULL").join(
        small(info.select(F.col("number").alias("surah"), "first_idx", "n_passages")), "surah"
    )
    p = passages.select("surah", F.col("idx").alias("_idx"), "ayah_start", "ayah_end")
    hit = parsed.where("ayah IS NOT NULL").join(p, "surah").where(F.col("ayah").between(F.col("ayah_start"), F.col("ayah_end"))).groupBy("id").agg(F.min("_idx").alias("hit"))
    idx = F.when(F.col("ayah").isNotNull(), F.col("hit")).otherwise(F.col("first_idx"))
    note = F.when(F.col("ayah").isNotNull() & F.col("hit").isNull(), "out_of_range").when(
        F.col("ayah").isNull() & (F.col("n_passages") > 1), "first_passage"
    )
    return parsed.join(hit, "id", "left").select("id", "surah", "ayah", idx.alias("idx"), note.alias("note"))


# further kinds of questions --------------------------------------------------------------------


def intent_requests(q: DataFrame, names: DataFrame) -> DataFrame:
    """id, op, arg, chapter, number, verse (of a name), flags of the further kinds of questions; op is null where none is recognised.

    op, in the order tried: summary, neighbours, starts, ends, phrase_count, chapter_by_number,
    verse_count, period, order, meaning, explain, locate, topic, and missing or script.
    """
    norm = F.col("norm")
    t = named_chapter(q, names).select(
        "id", "norm", "chapter", fa.phrase(norm).alias("arg"), fa.numbers(norm).alias("ns"), named_verse(norm).alias("verse")
    )
    has = lambda p: norm.rlike(p)
    enough = lambda n: fa.latin(F.col("arg")) | (F.length("arg") >= n)
    word = lambda op: F.when(fa.latin(F.col("arg")), F.lit("script")).otherwise(op)
    known = lambda op: F.when(F.col("chapter").isNull(), "missing").otherwise(op)
    number = F.coalesce(
        F.regexp_extract("norm", fa.BY_NUMBER, 1).try_cast("int"), F.regexp_extract("norm", fa.BY_NUMBER, 3).try_cast("int")
    )
    op = (
        F.when(has(fa.SUMMARY), known("summary"))
        .when(has(fa.NEIGHBOUR), F.when(F.size("ns") == 0, "missing").otherwise(known("neighbours")))
        .when((has(fa.STARTS) | has(fa.ENDS)) & enough(1), word(F.when(has(fa.STARTS), "starts").otherwise("ends")))
        .when(has(fa.PHRASE_COUNT) & enough(2), word(F.lit("phrase_count")))
        .when(number.isNotNull(), F.lit("chapter_by_number"))
        .when(has(fa.VERSE_COUNT), known("verse_count")).when(has(fa.PERIOD), known("period")).when(has(fa.ORDER), known("order"))
        .when(has(fa.MEANING) & enough(2), word(F.lit("meaning")))
        .when(has(fa.EXPLAIN) & F.col("verse").isNotNull(), F.lit("explain"))
        .when(has(fa.EXPLAIN) & ~has(r"\d") & F.col("chapter").isNull() & enough(2), word(F.lit("explain")))
        .when(has(fa.LOCATE) & F.col("verse").isNotNull(), F.lit("locate"))
        .when(has(fa.LOCATE) & enough(2), word(F.lit("locate")))
        .when(has(fa.TOPIC) & enough(2), word(F.lit("topic")))
    )
    before, after = has(fa.BEFORE), has(fa.AFTER)
    both = has(fa.BOTH) | ~(before | after)
    n = F.when(F.col("op") == "chapter_by_number", number).otherwise(F.get("ns", 0))
    return t.withColumn("op", op).select(
        "id", "op", "arg", "chapter", n.alias("number"), F.col("verse.surah").alias("verse_surah"),
        F.col("verse.ayah").alias("verse_ayah"), (before | both).alias("before"), (after | both).alias("after"),
        has(fa.ONLY_COUNT).alias("only_count")
    )


def intent_answers(requests: DataFrame, passages: DataFrame, verses: DataFrame) -> DataFrame:
    """id, op (missing where the text has nothing), n, refs, idx (the passage whose words are the answer), summary (the passages' words) of recognised requests.

    n: verses or occurrences counted, the chapter's number or verses. A phrase is sought in its loose
    form, too; a topic that no verse has is sought in the explanations (op topic_explained).
    """
    v = with_order(verses)
    r = requests.where("op IS NOT NULL")
    info = chapters_of(passages)
    none = F.lit([]).cast("array<struct<surah:int,ayah:int,idx:int>>")
    shape = lambda df: df.select(
        "id", "op", F.col("n").cast("long").alias("n"), F.coalesce("refs", none).alias("refs"),
        F.col("idx").cast("int").alias("idx"), "summary"
    )
    blank = {"n": F.lit(None).cast("long"), "refs": none, "idx": F.lit(None).cast("int"), "summary": F.lit(None).cast("string")}
    plain = shape(r.where("op IN ('missing', 'script')").withColumns(blank))
    # chapters
    c = r.where("op IN ('chapter_by_number', 'verse_count', 'period', 'order')").withColumn(
        "_k", F.when(F.col("op") == "chapter_by_number", F.col("number")).otherwise(F.col("chapter"))
    )
    c = c.join(small(info.select(F.col("number").alias("_k"), "n_verses", F.col("kind").alias("_kind"))), "_k", "left")
    known = F.col("n_verses").isNotNull()
    n = F.when(F.col("op") == "order", F.col("_k")).otherwise(F.col("n_verses"))
    chapters = shape(c.withColumns(blank).withColumns({
        "n": F.when(known, n), "summary": F.when(F.col("op").isin("period", "chapter_by_number"), F.col("_kind")),
        "op": F.when(known, F.col("op")).otherwise("missing")
    }))
    # neighbours
    b = r.where("op = 'neighbours'").alias("b")
    near = b.join(
        v.select(F.col("surah").alias("chapter"), F.col("ayah").alias("_a"), F.col("idx").alias("_i")), "chapter"
    ).where(F.abs(F.col("_a") - F.col("number")) <= 1)
    wanted = F.when(
        (F.col("before") & (F.col("_a") < F.col("number"))) | (F.col("after") & (F.col("_a") > F.col("number"))),
        F.struct(F.col("chapter").alias("surah"), F.col("_a").alias("ayah"), F.col("_i").alias("idx"))
    )
    near = near.groupBy("id").agg(
        F.bool_or(F.col("_a") == F.col("number")).alias("here"), F.sort_array(F.collect_list(wanted)).alias("refs")
    )
    neighbours = shape(r.where("op = 'neighbours'").join(near, "id", "left").withColumns({
        "op": F.when(F.coalesce("here", F.lit(False)), F.col("op")).otherwise("missing"),
        "n": F.when(F.col("here"), F.size("refs")), "refs": F.when(F.col("here"), F.col("refs")), "idx": blank["idx"],
        "summary": blank["summary"]
    }))
    # phrases
    sought = r.where("op IN ('starts', 'ends', 'phrase_count', 'meaning', 'explain', 'locate', 'topic')")
    norm, loose = F.col("norm"), F.col("loose")

    def match(x: Column) -> Column:
        named = x["op"].isin("explain", "locate") & x["verse_surah"].isNotNull()
        has = norm.contains(x["arg"]) | loose.contains(fa.loose_form(x["arg"]))
        return (
            F.when(named, (F.col("surah") == x["verse_surah"]) & (F.col("ayah") == x["verse_ayah"]))
            .when(x["op"] == "starts", norm.startswith(x["arg"])).when(x["op"] == "ends", norm.endswith(x["arg"])).otherwise(has)
        )

    exact = F.when((F.col("op") == "meaning") & (norm != F.col("arg")), 1).otherwise(0)
    hits = verse_hits(sought, v, match, lambda: [exact], F.lit(REFERENCES))
    times = asked_of(
        v, sought.where("op = 'phrase_count'"),
        lambda x: F.when(
            match(x),
            F.struct(F.greatest(fa.occurrences(norm, x["arg"]), fa.occurrences(loose, fa.loose_form(x["arg"]))).alias("t"))
        ),
        ["ord"]
    )
    times = times.groupBy("id").agg(F.sum("t").alias("times"))
    told = asked_of(
        passages, sought.where("op = 'topic'"),
        lambda x: F.when(F.col("norm_explanation").contains(x["arg"]), F.struct(F.lit(1).alias("one"))), ["idx"]
    )
    firsts = v.groupBy("idx").agg(F.min_by(F.struct("surah", "ayah", "idx"), "ord").alias("first"))
    told = told.withColumn(
        "place", F.row_number().over(W.partitionBy("id").orderBy("idx"))
    ).where(F.col("place") <= REFERENCES).join(firsts, "idx")
    told = told.groupBy("id").agg(F.sort_array(F.collect_list("first")).alias("t_refs"))
    s = sought.join(hits, "id", "left").join(times, "id", "left").join(told, "id", "left")
    found, explained = F.col("n").isNotNull(), F.col("n").isNull() & F.col("t_refs").isNotNull()
    counting = F.col("op").isin("starts", "ends", "phrase_count")
    op = F.when(explained, "topic_explained").when(found | counting, F.col("op")).otherwise("missing")
    total = F.when(explained, F.size("t_refs")).when(
        F.col("op") == "phrase_count", F.coalesce("times", F.lit(0))
    ).when(counting, F.coalesce("n", F.lit(0))).otherwise(F.col("n"))
    refs = F.when(explained, F.col("t_refs")).when(
        F.col("op").isin("starts", "ends") & F.col("only_count"), none
    ).when(F.col("op").isin("meaning", "explain"), F.slice("refs", 1, 1)).otherwise(F.col("refs"))
    idx = F.when(F.col("op").isin("meaning", "explain"), F.get("refs", 0)["idx"])
    phrases = shape(s.withColumns({
        "idx": idx, "_refs": refs, "_n": total, "summary": blank["summary"], "_op": op
    }).withColumns({"refs": F.col("_refs"), "n": F.col("_n"), "op": F.col("_op")}))
    # summaries
    m = r.where("op = 'summary'").join(
        passages.select(F.col("surah").alias("chapter"), "ayah_start", "ayah_end", F.col("idx").alias("_i"), "explanation"),
        "chapter", "left"
    )
    one = F.col("number").isNotNull()
    kept = m.where(~one | F.col("number").between(F.col("ayah_start"), F.col("ayah_end"))).withColumn(
        "place", F.row_number().over(W.partitionBy("id").orderBy("_i"))
    )
    kept = kept.where((F.col("place") <= SUMMARY_PASSAGES) & (~one | (F.col("place") == 1)))
    part = F.when(one, fx.extract(F.col("explanation"), SUMMARY_CHARS)).otherwise(fx.extract(F.col("explanation"), PART_CHARS))
    parts = kept.groupBy("id").agg(
        F.sort_array(F.collect_list(F.struct("place", part.alias("p")))).alias("ps"), F.min("_i").alias("first")
    )
    # of all passages of the chapter
    of = passages.groupBy(F.col("surah").alias("chapter")).agg(F.count(F.lit(1)).alias("n"))
    made = r.where("op = 'summary'").join(parts, "id", "left").join(of, "chapter", "left")
    there = F.col("ps").isNotNull()
    summaries = shape(made.withColumns({
        "op": F.when(there, F.col("op")).otherwise("missing"), "n": F.when(there, F.col("n")), "refs": none,
        "idx": F.when(there & one, F.col("first")), "summary": F.array_join("ps.p", " … ")
    }).withColumn(
        "summary", F.when(there, F.col("summary"))
    ))
    return plain.unionByName(chapters).unionByName(neighbours).unionByName(phrases).unionByName(summaries)


# the first way that gives an answer --------------------------------------------------------------

CHAPTER_OPS = ["chapter_by_number", "verse_count", "period", "order"]
#: Ways in the order in which they are tried, from 0.
STEPS = ["unreadable", "ruling", "question", "intent", "analytics", "reference", "scored_question", "keywords", "fallback"]


def confidence(kind: Column, source: Column, step: Column) -> Column:
    """high for given answers, facts of chapters and named verses; medium for what a search or a count gives; low for no answer."""
    return F.when(kind != "answer", "low").when(
        source.isin("qa", "metadata") | (step == "reference"), "high"
    ).when(source.isin("tafseer", "analytics"), "medium").otherwise("low")


def answers(questions: DataFrame, passages: DataFrame, verses: DataFrame, known: DataFrame, index: WordIndex | None = None) -> DataFrame:
    """One row for each question: id, reply, step, kind, source, op, total, refs, text, excerpt, badges, confidence.

    step: the first of STEPS that gives anything. kind: answer, clarify (the question must be put
    otherwise, goes to scholars, or asks for what the data don't have) or fallback. source: qa,
    tafseer, metadata, analytics; null without an answer. refs: verses (surah, ayah) that are cited.
    text: the words of the source; for counts there are none but the numbers. badges: what the answer
    is labelled with: its source, and that verses are cited.
    passages, verses: of ``passage_index``. known: of ``question_index``, with ord. index: of the
    passages by idx, with the fields heading (norm_text) and norm (norm_explanation); without it, as
    for a small table, every question meets every passage.
    """
    from lexspark.operators import retrieval
    from lexspark.operators.lookups import name_table

    q = read_questions(questions).persist()
    names = name_table(chapters_of(passages)).persist()
    refs_of = "array<struct<surah:int,ayah:int>>"
    none = {
        "op": F.lit(None).cast("string"), "total": F.lit(None).cast("long"), "refs": F.lit([]).cast(refs_of),
        "text": F.lit(None).cast("string"), "source": F.lit(None).cast("string")
    }
    cite = lambda refs: F.transform(
        refs, lambda r: F.struct(r["surah"].alias("surah"), r["ayah"].alias("ayah"))
    ).cast(refs_of)

    def way(df: DataFrame, step: str, **columns: Column) -> DataFrame:
        made = {"kind": F.lit("answer")} | none | columns
        return df.select(
            "id", F.lit(STEPS.index(step)).alias("place"),
            F.struct(
                F.lit(step).alias("step"), *[made[c].alias(c) for c in ("kind", "source", "op", "total", "refs", "text")]
            ).alias("a")
        )

    clarify = F.lit("clarify")
    explained = passages.select(
        F.col("idx").alias("_idx"), "explanation", F.col("surah").alias("_surah"), F.col("ayah_start").alias("_ayah")
    )
    readable = q.where(F.col("readable") & (F.col("kind") != qs.SAFETY))
    exact = readable.join(
        known.select(F.col("norm_question").alias("norm"), "ord", "answer"), "norm"
    ).groupBy("id").agg(F.min_by("answer", "ord").alias("answer"))
    intents = intent_answers(
        intent_requests(readable, names), passages, verses
    ).join(explained, F.col("idx") == F.col("_idx"), "left")
    requests = analytics_requests(readable, names).where("op IS NOT NULL").persist()
    counted = requests.join(
        passage_totals(requests, passages), "id", "left"
    ).join(analytics_places(requests, verses), "id", "left")
    refused = F.col("op").isin("script", "no_data", "unparsed")
    referred = reference_answers(readable, names, passages).join(explained, F.col("idx") == F.col("_idx"), "left")
    rows = known.select(
        F.col("ord").alias("row_ord"), F.col("norm_question").alias("question"), F.col("norm_answer").alias("answer"),
        F.col("norm_keywords").alias("keywords")
    )
    scored = retrieval.best_answers(rows, readable).join(
        known.select(F.col("ord").alias("row_ord"), F.col("answer").alias("said")), "row_ord"
    )
    held = passages.select(
        F.col("idx").alias("row_ord"), F.col("norm_text").alias("heading"), F.col("norm_explanation").alias("body")
    )
    searched = (
        retrieval.best_passages(index, readable) if index else retrieval.best_passages_by_rows(held, readable)
    ).join(explained, F.col("row_ord") == F.col("_idx"))
    own = F.array(F.struct(F.col("_surah").alias("surah"), F.col("_ayah").alias("ayah"))).cast(refs_of)
    missing = F.col("op").isin("missing", "script")
    ways = [
        way(q.where(~F.col("readable")), "unreadable", kind=clarify), way(
            q.where(F.col("readable") & (F.col("kind") == qs.SAFETY)), "ruling", kind=clarify
        ),
        way(exact, "question", source=F.lit("qa"), text=F.col("answer")),
        way(
            intents, "intent", kind=F.when(missing, "clarify").otherwise("answer"),
            source=F.when(missing, F.lit(None)).when(F.col("op").isin(CHAPTER_OPS), "metadata").otherwise("tafseer"),
            op=F.col("op"), total=F.col("n"), refs=cite(F.col("refs")), text=F.coalesce("summary", "explanation")
        ),
        way(
            counted, "analytics", kind=F.when(refused, "clarify").otherwise("answer"), source=F.when(~refused, "analytics"),
            op=F.col("op"),
            total=F.when(
                ~refused,
                F.coalesce(
                    F.when(
                        F.col("op").isin("first", "last", "locations") | F.col("op").endswith("_verse"), F.coalesce("n", F.lit(0))
                    ),
                    "total"
                )
            ),
            refs=F.coalesce(cite(F.col("refs")), none["refs"])
        ),
        way(
            referred, "reference", kind=F.when(F.col("idx").isNull(), "clarify").otherwise("answer"),
            source=F.when(F.col("idx").isNotNull(), "tafseer"), op=F.col("note"),
            refs=F.when(F.col("idx").isNotNull(), own).otherwise(none["refs"]), text=F.col("explanation")
        ),
        way(scored, "scored_question", source=F.lit("qa"), text=F.col("said")), way(
            searched, "keywords", source=F.lit("tafseer"), refs=own, text=F.col("explanation")
        ),
        way(q, "fallback", kind=F.lit("fallback")),
    ]
    every = ways[0]
    for w in ways[1:]:
        every = every.unionByName(w)
    first = every.groupBy("id").agg(F.min_by("a", "place").alias("a")).select("id", "a.*")
    told = q.select("id", "reply").join(first, "id")
    excerpt = F.when(F.col("source") == "tafseer", fx.excerpt(F.col("text")))
    kind_of = F.when(F.col("source") == "tafseer", "tafsir").otherwise(F.col("source"))
    badges = F.array_compact(F.array(kind_of, F.when((F.size("refs") > 0) & (F.col("source") != "analytics"), "quran")))
    return told.withColumns({"excerpt": excerpt, "badges": badges, "confidence": confidence(F.col("kind"), F.col("source"), F.col("step"))})


def cited(answered: DataFrame, passages: DataFrame, verses: DataFrame) -> DataFrame:
    """id, place, type, surah, ayah, text of the verses that answers cite: the chapter's name in the language of the reply. answered: id, reply, refs."""
    each = answered.select("id", "reply", F.posexplode("refs").alias("place", "r")).select(
        "id", "reply", "place", F.col("r.surah").alias("_s"), F.col("r.ayah").alias("_a")
    )
    names = small(chapters_of(passages).select(F.col("number").alias("_s"), "name", "english"))
    text = verses.groupBy(F.col("surah").alias("_s"), F.col("ayah").alias("_a")).agg(F.min_by("text", "idx").alias("text"))
    name = F.when(F.col("reply") == "ar", F.col("name")).otherwise(F.col("english"))
    return each.join(text, ["_s", "_a"]).join(names, "_s").select(
        "id", "place", F.lit("quran").alias("type"), name.alias("surah"), F.col("_a").cast("string").alias("ayah"), "text"
    )
