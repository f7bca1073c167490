"""Queries over Arabic rows: normal forms, counts and cuts that prose in Latin letters never reaches."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexspark.functions import text as fx
from lexspark.plans.catalogue import NORM, has_phrase_sql, loose_sql, occ, query
from lexspark.plans.inline import VERSES, Inline, literal, with_tables

ROWS = Inline("texts", "id int, text string", [
    (1, "كم شدة في القرآن؟"), (2, "البقرة آية ١٥٣ ـ ۹"), (3, "أإآٱ ةى أَكْبَر"), (4, "في كتب الله العالمين"),
    (5, "الله ولله بالله لله فلله"), (6, "الرحمن للرحمن الرحمن والرحمن"),
    (7, "النار وبالنار للنار نار النار"), (8, "سُورَةُ البقرة"), (9, "سورة  الفاتحة "), (10, "A  b\t(C) 12,345.6 و ١٢٫٥"),
    (11, ""), (12, None), (13, "كتاب الله كتاب كتب الله"),
    (
        14, "بِسْمِ ٱللَّهِ ٱلرَّحْمَٰنِ ٱلرَّحِيمِ ٱلْحَمْدُ لِلَّهِ"
    ), (15, "بِسْمِ ٱللَّهِ ٱلرَّحْمَٰنِ ٱلرَّحِيمِ"), (
        16, "جملة أولى. جملة ثانية؟ ثالثة!\nسطر رابع " + "طويل " * 30
    ), (17, "‏مخفي​\t"), (18, "ءأؤإئآاٱـي"),
])
WORDS = ["الله", "الرحمن", "النار", "كتاب الله", "العالمين"]
_T = with_tables(ROWS) + f", n AS (SELECT id, text AS t, {NORM.replace('(t,', '(text,')} AS norm FROM texts) "
_LOAD = (
    f"trim(regexp_replace(regexp_replace(translate(regexp_replace(t, {literal(fx.LOAD_MARKS)}, '', 'g'), 'إأآٱىة', 'اااايه'), "
    f"{literal('[^' + chr(92) + 'x{0600}-' + chr(92) + 'x{06FF}' + fx.WHITE[1:-2] + ']')}, '', 'g'), {literal(fx.WHITE)}, ' ', "
    f"'g'))"
)


def _texts(spark):
    return ROWS.df(spark).withColumn("norm", fx.normalize(F.col("text")))


@query(
    _T + f"SELECT id, regexp_replace(t, {literal(fx.MARKS)}, '', 'g') AS bare, translate(t, '{fx.DIGITS}', '{fx.WESTERN}') AS "
        f"western, norm, {_LOAD} AS for_load, {loose_sql('norm')} AS loose, "
    f"CAST(len(regexp_extract_all(t, '{fx.LETTERS}')) AS BIGINT) AS letters, CAST(length(t) - length(translate(t, 'أإآٱا', '')) "
    f"AS BIGINT) AS alifs FROM n"
)
def arabic_forms(spark, d):
    t = F.col("text")
    return _texts(spark).select(
        "id", fx.strip_marks(t).alias("bare"), fx.western_digits(t).alias("western"), "norm",
        fx.normalize_for_load(t).alias("for_load"),
        fx.loose_key(F.col("norm")).alias("loose"), fx.letter_count(t).alias("letters"),
        fx.count_chars(t, "أإآٱا").alias("alifs"),
    )


def _target(x: str, word: str) -> str:
    form = fx.elided(word)
    return occ(x, word) + (f" + ({occ(x, form)} - {occ(x, 'ا' + form)})" if form else "")


def _one(word: str) -> str:
    return (
        f"SELECT id, '{word}' AS word, {occ('norm', word)} AS plain, {_target('norm', word)} AS "
        f"with_elided, {occ(chr(39) + ' ' + chr(39) + ' || norm || ' + chr(39) + ' ' + chr(39), ' ' + word + ' ')} AS "
        f"standalone, "
        f"greatest({occ('norm', word)}, {occ(loose_sql('norm'), fx.loose(word))}) AS as_phrase, {has_phrase_sql('norm', word)} "
        f"AS found FROM n WHERE norm IS NOT NULL"
    )


@query(_T + " UNION ALL ".join(map(_one, WORDS)))
def arabic_counts(spark, d):
    c = F.col("norm")
    rows = [
        F.struct(F.lit(w).alias("word"), fx.count_of(c, w).alias("plain"), fx.count_target(c, w).alias("with_elided"),
        fx.count_standalone(c, w).alias("standalone"),
                 fx.phrase_count(c, w).alias("as_phrase"), fx.has_phrase(c, w).alias("found"))
        for w in WORDS
    ]
    return _texts(spark).where("norm IS NOT NULL").select("id", F.explode(F.array(*rows)).alias("r")).select("id", "r.*")


_SANE = f"trim(regexp_replace(regexp_replace(regexp_replace(t, {literal(fx.CONTROLS)}, '', 'g'), {literal(fx.INVISIBLE)}, '', 'g'), {literal(fx.WHITE)}, ' ', 'g'))"


@query(
    _T + f"SELECT id, coalesce(length(substring({_SANE}, 1, 500)) > 0, false) AS is_message, translate(t, '{fx.WESTERN[:10]}', "
        f"'{fx.DIGITS[:10]}') AS shown, "
    "trim(regexp_replace(regexp_replace(t, '^\\s*سُورَةُ?\\s+', ''), '^\\s*سورة\\s+', '')) AS bare_name, "
    f"CASE WHEN starts_with(norm, '{fx.OPENING}') AND len(string_split_regex(trim(t), '\\s+')) > 4 THEN "
    f"array_to_string(list_slice(string_split_regex(trim(t), '\\s+'), 5, 1000000), ' ') ELSE t END AS without_opening, "
    "coalesce(list_filter(string_split(norm, ' '), lambda w: length(w) > 2)[-1], trim(t)) AS highlight, "
    f"array_to_string(regexp_extract_all(t, '{fx.NUMBER_RUN}'), '|') AS runs FROM n"
)
def text_cuts(spark, d):
    t = F.col("text")
    return ROWS.df(spark).select(
        "id", fx.is_message(t).alias("is_message"), fx.shown_number(t, True).alias("shown"), fx.bare_name(t).alias("bare_name"),
        fx.without_opening(t).alias("without_opening"),
        fx.highlight_term(t).alias("highlight"), F.array_join(fx.number_runs(t), "|").alias("runs"),
    )


#: Sentences one by one: a row of the recursion is what is taken so far.
_EXTRACT = (
    ", RECURSIVE_INPUT AS (SELECT id, t, list_filter(string_split(regexp_replace(regexp_replace(t, '([.؟!])\\s+', '\\1' || "
    "chr(1), 'g'), '\\n+', chr(1), 'g'), chr(1)), lambda x: x <> '') AS s FROM n WHERE t IS NOT NULL), "
    "steps AS (SELECT id, t, s, 1 AS i, CASE WHEN len(s) > 0 THEN s[1] ELSE '' END AS taken, len(s) = 0 OR length(s[1]) >= 40 "
    "AS done FROM RECURSIVE_INPUT "
    "UNION ALL SELECT id, t, s, i + 1, CASE WHEN length(taken) + length(s[i + 1]) > 40 THEN taken ELSE taken || ' ' || s[i + 1] "
    "END, "
    "length(taken) + length(s[i + 1]) > 40 OR length(taken || ' ' || s[i + 1]) >= 40 FROM steps WHERE NOT done AND i < len(s)) "
    "SELECT id, CASE WHEN arg_max(taken, i) = '' THEN substring(any_value(t), 1, 40) ELSE arg_max(taken, i) END AS extract FROM "
    "steps GROUP BY id"
)


@query((_T + _EXTRACT).replace("WITH ", "WITH RECURSIVE ", 1))
def extractive_summary(spark, d):
    return ROWS.df(spark).where("text IS NOT NULL").select("id", fx.extract(F.col("text"), 40).alias("extract"))


_V = with_tables(VERSES) + f", n AS (SELECT *, {NORM.replace('(t,', '(text,')} AS norm FROM verses) "


@query(_V + f"SELECT surah, ayah, starts_with(norm, 'قل') AS starts, ends_with(norm, 'الناس') AS "
    f"ends, {_target('norm', 'الناس')} AS n, ayah = 1 AS opens, surah NOT IN (1, 9) AND ayah = 1 AS own_opening FROM n")
def verse_flags(spark, d):
    n, first = F.col("norm"), F.col("ayah") == 1
    rows = VERSES.df(spark).withColumn("norm", fx.normalize(F.col("text")))
    return rows.select(
        "surah", "ayah", n.startswith("قل").alias("starts"), n.endswith("الناس").alias("ends"),
        fx.count_target(n, "الناس").alias("n"), first.alias("opens"), (first & ~F.col("surah").isin(1, 9)).alias("own_opening")
    )


@query("SELECT o_custkey, format('{:,}', CAST(round(sum(o_totalprice)) AS BIGINT)) AS total FROM orders GROUP BY o_custkey")
def grouped_thousands(spark, d):
    from lexspark.sources.tables import table

    # doubles are added in the order of the table's rows, as the SQL does on one thread: other orders round otherwise
    placed = table(spark, d, "orders").select("o_custkey", "o_totalprice", "_metadata.file_path", "_metadata.row_index")
    line = placed.repartition("o_custkey").sortWithinPartitions("o_custkey", "file_path", "row_index")
    return line.groupBy("o_custkey").agg(F.format_number(F.round(F.sum("o_totalprice")), 0).alias("total"))
