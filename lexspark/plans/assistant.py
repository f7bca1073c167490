"""Queries that answer questions about the passages of ``inline``, one for each step, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexspark.functions import assistant as fa
from lexspark.functions import questions as qs
from lexspark.functions import text as fx
from lexspark.operators import assistant as oa
from lexspark.operators import lookups as lk
from lexspark.plans.catalogue import loose_sql, occ, query
from lexspark.plans.inline import CHAPTERS, PASSAGES, VERSES, Inline, with_tables
from lexspark.plans.shelves import norm_sql
from lexspark.sources import documents_json as dj

TEXTS = [
    "كم مرة ذكرت كلمة الله", "كم مرة ذكرت كلمة الناس في سورة الناس", "كم شدة في القرآن؟", "كم حرف الألف", "كم آية في القرآن",
    "كم كلمة في سورة الفاتحة", "كم سورة", "كم حرف في القرآن", "how many fatha",
    "أيهما أكثر ذكرًا: الناس أم الله", "قارن", "أين وردت كلمة الصمد", "أول موضع ذكرت فيه كلمة الناس",
    "آخر موضع ذكرت فيه كلمة الناس", "ما أطول آية في القرآن", "ما أقصر سورة", "كم مرة ذكرت كلمة الله مع الآيات",
    "كم كلمة في صفحة 5", "how many times is mercy mentioned", "كم مرة وردت عبارة رب العالمين", "كم عدد آيات سورة الإخلاص",
    "هل سورة الناس مكية أم مدنية", "ما ترتيب سورة مريم", "ما معنى الصمد", "اشرح آية الكرسي",
    "اشرح قوله تعالى اهدنا الصراط", "في أي سورة وردت عبارة لم يلد", "آيات عن الصبر", "هات آيات عن الرحمن",
    "الآية بعد سورة الإخلاص 2", "الايه السابقه سورة مريم 1", "ما الآيات التي تبدأ بـ قل", "كم آية تنتهي بـ الناس",
    "لخص تفسير سورة الناس", "لخص تفسير آية 2 من سورة مريم", "السورة رقم 112", "السورة رقم 50", "تفسير سورة الفاتحة",
    "الإخلاص آية ٣", "112:4", "1 99", "البقرة 3", "هل يجوز الصيام", "؟", "", None, "zzz unknown thing",
    "معنى كلمة xyz", "قصة زكريا", "ما الصبر", "كم مرة ذكرت كلمة الجلالة", "كم مرة ذكرت كلمة سبحان", "longest surah",
    "show verses mentioned الله", "آية الدين", "كم حرف ق", "how many letter قاف", "لخص", "أطول آية في سورة مريم",
    "من هو الصمد المقصود", "What is patience?", "الاستعاذة من الوسواس", "compare الله or الناس in surah nas",
    "قارن بين ذكر الله والناس", "ما تفسير سورة الناس آية 9",
]
QUESTIONS = Inline("questions", "id int, text string, lang string", [(i, t, "en") for i, t in enumerate(TEXTS)])
ANSWERED = Inline(
    "answered", "id string, question string, answer string, words string",
    [
        ("p", "What is patience?", "Patience is endurance.", "patience"), ("q", "ما الصبر الجميل", "صبر بلا شكوى", "الصبر|شكوى"),
        ("r", "x", "y", "")
    ]
)


def passages_of(spark):
    verse = F.struct(F.col("ayah").alias("number"), F.col("text"))
    chapters = CHAPTERS.df(spark).select(
        F.col("number").alias("surah"), F.col("name").alias("surah_name"), F.col("english").alias("surah_transliteration"),
        F.col("kind").alias("surah_type")
    )
    p, v = PASSAGES.df(spark), VERSES.df(spark).select(F.col("surah").alias("_s"), "ayah", "text")
    held = p.join(v, (F.col("surah") == F.col("_s")) & F.col("ayah").between(F.col("ayah_start"), F.col("ayah_end")))
    return p.join(held.groupBy("idx").agg(F.sort_array(F.collect_list(verse)).alias("ayahs")), "idx").join(chapters, "surah")


class Asked:
    """Questions, names and the index, for the queries below."""

    def __init__(self, spark):
        self.passages, self.verses = dj.passage_index(passages_of(spark))
        self.q = oa.read_questions(QUESTIONS.df(spark))
        self.names = lk.name_table(oa.chapters_of(self.passages))


# SQL -----------------------------------------------------------------------------------------


def lit_list(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def case_of(entries: dict[str, str], x: str) -> str:
    return "CASE " + " ".join(f"WHEN {x} = '{k}' THEN '{v}'" for k, v in entries.items()) + " END"


def has(pattern: str, x: str = "norm") -> str:
    return f"regexp_matches({x}, '{pattern}')"


_BARE = "regexp_replace(x, '^ال', '')"
_RULING = " OR ".join(f"contains(' ' || norm || ' ', ' {t} ')" for t in qs.RULING)
_TOKENS = f"list_filter(string_split(norm, ' '), lambda x: length(x) >= 2 AND x NOT IN ({lit_list(qs.STOP_WORDS)}) AND NOT regexp_full_match(x, '[0-9]+'))"
_Q = (
    with_tables(QUESTIONS, CHAPTERS, PASSAGES, VERSES, ANSWERED)
    + f", q AS (SELECT *, length(norm) >= 2 AND regexp_matches(norm, '{qs.ANY_LETTER}') AS readable, ({_RULING}) AS "
        f"ruling, {_TOKENS} AS tokens, ' ' || norm || ' ' AS pad "
    f"FROM (SELECT id, coalesce(text, '') AS text, CASE WHEN regexp_matches(coalesce(text, ''), "
    f"'[\\x{{0600}}-\\x{{06FF}}\\x{{0750}}-\\x{{077F}}]') THEN 'ar' ELSE lang END AS "
    f"reply, {norm_sql(chr(99) + 'oalesce(text, chr(32))')} AS norm FROM questions)), "
    f"p AS (SELECT passages.*, {norm_sql('ayah_text')} AS norm_text, {norm_sql('explanation')} AS norm_explanation, ayah_end - "
    f"ayah_start + 1 AS n_ayahs, name, english, kind FROM passages JOIN chapters ON number = surah), "
    f"v AS (SELECT *, {loose_sql('norm')} AS loose FROM (SELECT verses.surah, ayah, text, idx, idx * 1048576 + ayah AS "
    f"ord, {norm_sql('text')} AS norm FROM verses JOIN passages ON passages.surah = verses.surah AND ayah BETWEEN ayah_start "
    f"AND ayah_end)), "
    "info AS (SELECT surah AS number, any_value(kind) AS kind, min(idx) AS first_idx, count(*) AS n_passages, CAST(sum(n_ayahs) "
    "AS BIGINT) AS n_verses FROM p GROUP BY surah), "
    f"c0 AS (SELECT number, {norm_sql('name')} AS a, {norm_sql('english')} AS o FROM chapters WHERE number IN (SELECT surah "
    f"FROM passages)), "
    "c1 AS (SELECT *, replace(o, ' ', '') AS one FROM c0), c2 AS (SELECT *, CASE WHEN regexp_matches(one, '^a[lstdrzn]') THEN "
    "CASE WHEN one[2] = one[3] THEN one[4:] ELSE one[3:] END ELSE one END AS x FROM c1), "
    "c3 AS (SELECT *, regexp_replace(x, '^al', '') AS bare FROM c2), c4 AS (SELECT number, unnest([a, CASE WHEN starts_with(a, "
    "'ال') AND length(a) > 4 THEN a[3:] END, o, one, CASE WHEN length(bare) > 3 THEN bare END, "
    "CASE WHEN length(bare) > 3 AND ends_with(bare, 'h') THEN regexp_replace(bare, 'h$', '') END]) AS variant FROM c3), names "
    "AS (SELECT variant, min(number) AS number FROM c4 WHERE variant <> '' GROUP BY variant), "
    "ch AS (SELECT q.id, arg_max(number, (length(variant), -number)) AS chapter FROM q JOIN names ON contains(pad, ' ' || "
    "variant || ' ') GROUP BY q.id), "
)
_SCOPE = "regexp_extract(pad, '" + fa.SCOPE + "', {})"
_ALIAS = "CASE WHEN {x} = 'الجلاله' THEN 'الله' ELSE {x} END"
_ONE = "CASE WHEN len({x}) BETWEEN 1 AND 4 THEN " + _ALIAS.format(x="array_to_string({x}, ' ')") + " END"
_A = (
    f"a0 AS (SELECT id, norm, pad, {_SCOPE.format(1)} AS kw, {_SCOPE.format(2)} AS w1, {_SCOPE.format(2)} || ' ' || "
    f"nullif({_SCOPE.format(3)}, '') AS two FROM q), "
    "a1 AS (SELECT a0.*, n2.number AS num2, n1.number AS num1, CASE WHEN n2.number IS NOT NULL THEN ' ' || kw || ' ' || two "
    "WHEN n1.number IS NOT NULL THEN ' ' || kw || ' ' || w1 END AS part "
    "FROM a0 LEFT JOIN names n2 ON n2.variant = two LEFT JOIN names n1 ON n1.variant = w1), "
    "a2 AS (SELECT *, coalesce(num2, num1) AS scope, CASE WHEN strpos(pad, part) > 0 THEN substring(pad, 1, strpos(pad, part) - "
    "1) || ' ' || substring(pad, strpos(pad, part) + length(part)) ELSE pad END AS rest FROM a1), "
    f"a3 AS (SELECT id, norm, scope, list_filter(string_split(rest, ' '), lambda x: x <> '' AND x NOT IN "
    f"({lit_list(fa.BASIC_FILLERS)})) AS t FROM a2), "
    f"a4 AS (SELECT *, list_filter(t, lambda x: x NOT IN ({lit_list(fa.COUNT_FILLERS)})) AS lc, list_filter(t, lambda x: x NOT "
    f"IN ({lit_list(fa.COUNT_FILLERS + fa.LOCATION_FILLERS)})) AS lp FROM a3), "
    f"a5 AS (SELECT *, {_ONE.format(x='lc')} AS counted, {_ONE.format(x='lp')} AS placed, "
    f"list_filter(list_transform(t, lambda x: "
    f"coalesce({case_of(fa.MARK_CHARS, 'x')}, {case_of(fa.MARK_CHARS, _BARE)}, {case_of({k: fa.MARK_CHARS[m] for k, m in fa.MARK_NAMES.items()}, 'x')})), lambda m: m IS NOT NULL)[1] AS mark, "
    f"list_transform([t[list_position(list_transform(t, lambda w: w IN ({lit_list(fa.LETTER_WORDS)})), true) + 1]], lambda x: "
    f"coalesce({case_of(fa.LETTER_CHARS, 'x')}, {case_of(fa.LETTER_CHARS, _BARE)}, CASE WHEN regexp_full_match(x, '[ء-يٱ]') "
    f"THEN x END))[1] AS letter, "
    f"CASE WHEN {has(fa.EITHER)} THEN regexp_extract(norm, '{fa.EITHER}', 1) ELSE nullif(regexp_extract(norm, '{fa.BETWEEN}', "
    f"1), '') END AS x1, "
    f"CASE WHEN {has(fa.EITHER)} THEN regexp_extract(norm, '{fa.EITHER}', 2) ELSE nullif(regexp_extract(norm, '{fa.BETWEEN}', "
    f"2), '') END AS x2 FROM a4), "
)
_SOME = "len(list_filter(t, lambda x: x IN ({}))) > 0"
_EVERY = "len(list_filter(t, lambda x: x NOT IN ({}))) = 0"
_COUNTING = " OR ".join(has(p) for p in fa.COUNTING)
_ABLE = "(regexp_matches({x}, '[a-z]') OR length({x}) >= 2)"
_WORD = "CASE WHEN regexp_matches({x}, '[a-z]') THEN 'script' ELSE {op} END"
_A += (
    f"a6 AS (SELECT *, CASE WHEN NOT ({_COUNTING} OR {has(fa.LOCATION)} OR {has(fa.FIRST_LAST)} OR {has(fa.SUPERLATIVE)} "
    f"OR {has(fa.COMPARISON)}) THEN NULL WHEN {has(fa.NO_SCOPE)} THEN 'no_data' WHEN len(t) = 0 THEN NULL "
    f"WHEN {has(fa.SUPERLATIVE)} AND {_SOME.format(lit_list(fa.TOTALS['surahs']))} THEN CASE WHEN {has('اطول|longest')} THEN "
    f"'longest_chapter' ELSE 'shortest_chapter' END "
    f"WHEN {has(fa.SUPERLATIVE)} AND {_SOME.format(lit_list(fa.TOTALS['ayahs']))} THEN CASE WHEN {has('اطول|longest')} THEN "
    f"'longest_verse' ELSE 'shortest_verse' END "
    f"WHEN {has(fa.COMPARISON)} THEN CASE WHEN x1 IS NULL THEN 'unparsed' ELSE 'compare' END "
    f"WHEN {has(fa.FIRST_LAST)} AND {_ABLE.format(x='placed')} "
    f"THEN {_WORD.format(x='placed', op='CASE WHEN ' + has('اول|first') + chr(32) + 'THEN ' + repr('first') + ' ELSE ' + repr('last') + ' END')} "
    f"WHEN {has(fa.LOCATION)} AND {_ABLE.format(x='placed')} THEN {_WORD.format(x='placed', op=repr('locations'))} WHEN NOT "
    f"({_COUNTING}) THEN NULL "
    + " ".join(f"WHEN {_EVERY.format(lit_list(words))} THEN 'total_{kind}'" for kind, words in fa.TOTALS.items())
    + f" WHEN mark IS NOT NULL OR letter IS NOT NULL THEN 'chars' WHEN {_ABLE.format(x='counted')} "
        f"THEN {_WORD.format(x='counted', op=repr('count'))} END AS op FROM a5), "
    f"ar AS (SELECT id, op, CASE WHEN op IN ('first', 'last', 'locations') THEN placed WHEN op = 'chars' THEN coalesce(mark, "
    f"letter) WHEN op = 'count' THEN counted WHEN op = 'compare' THEN {_ALIAS.format(x='x1')} END AS arg, "
    f"CASE WHEN op = 'compare' THEN {_ALIAS.format(x='x2')} END AS other, scope, coalesce(op = 'count', false) "
    f"AND {has(fa.DETAILS)} AS details FROM a6)"
)


@query(_Q + _A + " SELECT id, op, arg, other, scope, details FROM ar")
def analytics_requests(spark, d):
    a = Asked(spark)
    return oa.analytics_requests(a.q, a.names).select(
        "id", "op", "arg", "other", "scope", F.coalesce("details", F.lit(False)).alias("details")
    )


def _dyn(hay: str, needle: str) -> str:
    return f"CAST((length({hay}) - length(replace({hay}, {needle}, ''))) / length({needle}) AS BIGINT)"


def _target(hay: str, word: str) -> str:
    form = f"(CASE WHEN starts_with({word}, 'ال') AND length({word}) > 3 THEN CASE WHEN starts_with({word}, 'الل') THEN {word}[2:] ELSE 'ل' || {word}[2:] END END)"
    return f"({_dyn(hay, word)} + coalesce({_dyn(hay, form)} - {_dyn(hay, chr(39) + 'ا' + chr(39) + ' || ' + form)}, 0))"


_PAD = "(' ' || norm_text || ' ')"
_T = (
    ", t0 AS (SELECT ar.*, p.surah, p.idx, CASE WHEN op IN ('count', 'compare') THEN " + _target("norm_text", "arg") + " WHEN op = 'chars' THEN length(ayah_text) - length(translate(ayah_text, arg, '')) "
    f"WHEN op IN ('total_ayahs', 'longest_chapter', 'shortest_chapter') THEN n_ayahs WHEN op = 'total_words' THEN "
    f"len(string_split(norm_text, ' ')) WHEN op = 'total_letters' THEN len(regexp_extract_all(ayah_text, '{fx.LETTERS}')) ELSE "
    f"1 END AS v, "
    f"CASE WHEN op = 'count' "
    f"THEN {_dyn(_PAD, chr(40) + chr(39) + ' ' + chr(39) + ' || arg || ' + chr(39) + ' ' + chr(39) + ')')} WHEN op = 'compare' "
    f"THEN {_target('norm_text', 'other')} ELSE 0 END AS o "
    "FROM ar JOIN p ON scope IS NULL OR scope = p.surah OR op IN ('total_surahs', 'longest_chapter', 'shortest_chapter') WHERE "
    "op IN ('count', 'compare', 'chars', 'longest_chapter', 'shortest_chapter') OR op LIKE 'total_%'), "
    "t1 AS (SELECT id, op, scope, surah, CAST(sum(v) AS BIGINT) AS v, CAST(sum(o) AS BIGINT) AS o, min(idx) AS f FROM t0 GROUP "
    "BY ALL), "
    "t2 AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY CASE WHEN op = 'shortest_chapter' THEN v ELSE -v END, f) AS "
    "place FROM t1 WHERE v > 0 OR o > 0), "
    "t3 AS (SELECT id, any_value(op) AS op, any_value(scope) AS scope, sum(v) AS s, sum(o) AS o, count(*) FILTER (WHERE v > 0) "
    "AS n, max(v) FILTER (WHERE place = 1) AS best, "
    "string_agg(surah || ':' || v, ',' ORDER BY place) FILTER (WHERE v > 0 AND place <= CASE WHEN op LIKE '%_chapter' THEN 1 "
    "ELSE 5 END) AS top FROM t2 GROUP BY id), "
    "tt AS (SELECT ar.id, CAST(coalesce(CASE WHEN ar.op = 'total_surahs' THEN n WHEN ar.op LIKE '%_chapter' THEN best ELSE s "
    "END, 0) AS BIGINT) AS total, CAST(coalesce(o, 0) AS BIGINT) AS other, coalesce(n, 0) AS n_groups, "
    "coalesce(CASE WHEN ar.op LIKE '%_chapter' OR (ar.op IN ('chars', 'count') AND ar.scope IS NULL AND n > 1) THEN top END, "
    "'') AS top FROM ar LEFT JOIN t3 USING (id) "
    "WHERE ar.op IN ('count', 'compare', 'chars', 'longest_chapter', 'shortest_chapter') OR ar.op LIKE 'total_%')"
)


def _shown(refs: str):
    return F.array_join(F.transform(refs, lambda r: F.concat_ws(":", r["surah"], r["ayah"])), ",")


@query(_Q + _A + _T + " SELECT id, total, other, n_groups, top FROM tt")
def analytics_totals(spark, d):
    a = Asked(spark)
    found = oa.passage_totals(oa.analytics_requests(a.q, a.names), a.passages)
    return found.withColumn("top", F.array_join(F.transform("top", lambda t: F.concat_ws(":", t["surah"], t["value"])), ","))


_P = (
    f", h0 AS (SELECT ar.*, v.surah, v.ayah, v.ord, row_number() OVER (PARTITION BY ar.id ORDER BY CASE op WHEN 'longest_verse' "
    f"THEN -length(text) WHEN 'shortest_verse' THEN length(text) WHEN 'last' THEN -ord ELSE 0 END, ord) AS place, count(*) OVER "
    f"(PARTITION BY ar.id) AS n "
    f"FROM ar JOIN v ON (scope IS NULL OR scope = v.surah) AND (op LIKE '%_verse' OR {_target('norm', 'arg')} > 0) WHERE op IN "
    f"('first', 'last', 'locations', 'longest_verse', 'shortest_verse') OR (op = 'count' AND details)), "
    "ap AS (SELECT id, any_value(n) AS n, string_agg(surah || ':' || ayah, ',' ORDER BY place) AS refs FROM h0 WHERE place <= "
    "CASE WHEN op IN ('locations', 'count') THEN 15 ELSE 1 END GROUP BY id)"
)


@query(_Q + _A + _P + " SELECT id, n, refs FROM ap")
def analytics_places(spark, d):
    a = Asked(spark)
    return oa.analytics_places(oa.analytics_requests(a.q, a.names), a.verses).select("id", "n", _shown("refs").alias("refs"))


_NAMED = "CASE " + " ".join(f"WHEN contains(pad, ' {n} ') THEN {{{i}}}" for i, (n, _, _) in enumerate(fa.NAMED)) + " END"
_NAMED_SURAH, _NAMED_AYAH = _NAMED.format(*[s for _, s, _ in fa.NAMED]), _NAMED.format(*[a for _, _, a in fa.NAMED])
_NS = "list_transform(regexp_extract_all(norm, '\\d+'), lambda x: TRY_CAST(x AS INT))"
_R = (
    f"r0 AS (SELECT q.id, chapter, {_NAMED_SURAH} AS vs, {_NAMED_AYAH} AS va, {_NS} AS ns FROM q LEFT JOIN ch USING (id)), "
    "r1 AS (SELECT id, CASE WHEN vs IS NOT NULL THEN vs WHEN chapter IS NOT NULL THEN chapter WHEN len(ns) = 2 THEN ns[1] END "
    "AS surah, CASE WHEN vs IS NOT NULL THEN va WHEN chapter IS NOT NULL THEN ns[1] WHEN len(ns) = 2 THEN ns[2] END AS ayah "
    "FROM r0), "
    "rr AS (SELECT r1.id, r1.surah, r1.ayah, CASE WHEN r1.ayah IS NOT NULL THEN (SELECT min(idx) FROM p WHERE p.surah = "
    "r1.surah AND r1.ayah BETWEEN ayah_start AND ayah_end) ELSE first_idx END AS idx, n_passages FROM r1 JOIN info ON number = "
    "surah), "
    "rf AS (SELECT id, surah, ayah, idx, CASE WHEN ayah IS NOT NULL AND idx IS NULL THEN 'out_of_range' WHEN ayah IS NULL AND "
    "n_passages > 1 THEN 'first_passage' END AS note FROM rr)"
)


@query(_Q + _R + " SELECT id, surah, ayah, idx, note FROM rf")
def reference_answers(spark, d):
    a = Asked(spark)
    return oa.reference_answers(a.q, a.names, a.passages)


_KNOWN = "CASE WHEN chapter IS NULL THEN 'missing' ELSE '{}' END"
_I = (
    f"i0 AS (SELECT q.id, norm, chapter, array_to_string(list_filter(string_split(norm, ' '), lambda x: x <> '' AND x NOT IN "
    f"({lit_list(fa.PHRASE_FILLERS)})), ' ') AS arg, {_NS} AS ns, {_NAMED_SURAH} AS vs, {_NAMED_AYAH} AS va, "
    f"coalesce(TRY_CAST(nullif(regexp_extract(norm, '{fa.BY_NUMBER}', 1), '') AS INT), TRY_CAST(nullif(regexp_extract(norm, "
    f"'{fa.BY_NUMBER}', 3), '') AS INT)) AS bn FROM q LEFT JOIN ch USING (id)), "
    f"i1 AS (SELECT *, CASE WHEN {has(fa.SUMMARY)} THEN {_KNOWN.format('summary')} WHEN {has(fa.NEIGHBOUR)} THEN CASE WHEN "
    f"len(ns) = 0 OR chapter IS NULL THEN 'missing' ELSE 'neighbours' END "
    f"WHEN ({has(fa.STARTS)} OR {has(fa.ENDS)}) AND length(arg) >= 1 "
    f"THEN {_WORD.format(x='arg', op='CASE WHEN ' + has(fa.STARTS) + ' THEN ' + repr('starts') + ' ELSE ' + repr('ends') + ' END')} "
    f"WHEN {has(fa.PHRASE_COUNT)} AND {_ABLE.format(x='arg')} THEN {_WORD.format(x='arg', op=repr('phrase_count'))} WHEN bn IS "
    f"NOT NULL THEN 'chapter_by_number' "
    f"WHEN {has(fa.VERSE_COUNT)} THEN {_KNOWN.format('verse_count')} WHEN {has(fa.PERIOD)} THEN {_KNOWN.format('period')} "
    f"WHEN {has(fa.ORDER)} THEN {_KNOWN.format('order')} "
    f"WHEN {has(fa.MEANING)} AND {_ABLE.format(x='arg')} THEN {_WORD.format(x='arg', op=repr('meaning'))} "
    f"WHEN {has(fa.EXPLAIN)} AND vs IS NOT NULL THEN 'explain' "
    f"WHEN {has(fa.EXPLAIN)} AND NOT {has(chr(92) + 'd')} AND chapter IS NULL AND {_ABLE.format(x='arg')} "
    f"THEN {_WORD.format(x='arg', op=repr('explain'))} WHEN {has(fa.LOCATE)} AND vs IS NOT NULL THEN 'locate' "
    f"WHEN {has(fa.LOCATE)} AND {_ABLE.format(x='arg')} THEN {_WORD.format(x='arg', op=repr('locate'))} WHEN {has(fa.TOPIC)} "
    f"AND {_ABLE.format(x='arg')} THEN {_WORD.format(x='arg', op=repr('topic'))} END AS op FROM i0), "
    f"ir AS (SELECT id, op, arg, chapter, CASE WHEN op = 'chapter_by_number' THEN bn ELSE ns[1] END AS number, vs AS "
    f"verse_surah, va AS verse_ayah, {has(fa.BEFORE)} OR {has(fa.BOTH)} OR NOT ({has(fa.BEFORE)} OR {has(fa.AFTER)}) AS before, "
    f"{has(fa.AFTER)} OR {has(fa.BOTH)} OR NOT ({has(fa.BEFORE)} OR {has(fa.AFTER)}) AS after, {has(fa.ONLY_COUNT)} AS "
    f"only_count FROM i1)"
)


@query(_Q + _I + " SELECT * FROM ir")
def intent_requests(spark, d):
    a = Asked(spark)
    return oa.intent_requests(a.q, a.names)


_SPLIT = "list_filter(string_split(regexp_replace(regexp_replace(t, '([.؟!])\\s+', '\\1' || chr(1), 'g'), '\\n+', chr(1), 'g'), chr(1)), lambda x: x <> '')"
_IA = (
    f", n0 AS (SELECT ir.id, op, info.* FROM ir LEFT JOIN info ON info.number = CASE WHEN op = 'chapter_by_number' THEN "
    f"ir.number ELSE chapter END WHERE op IN ({lit_list(oa.CHAPTER_OPS)})), "
    "b0 AS (SELECT ir.id, bool_or(v.ayah = ir.number) AS here, string_agg(v.surah || ':' || v.ayah, ',' ORDER BY v.ayah) FILTER "
    "(WHERE (before AND v.ayah < ir.number) OR (after AND v.ayah > ir.number)) AS refs, "
    "count(*) FILTER (WHERE (before AND v.ayah < ir.number) OR (after AND v.ayah > ir.number)) AS n FROM ir JOIN v ON v.surah = "
    "chapter AND abs(v.ayah - ir.number) <= 1 WHERE op = 'neighbours' GROUP BY ir.id), "
    "s0 AS (SELECT * FROM ir WHERE op IN ('starts', 'ends', 'phrase_count', 'meaning', 'explain', 'locate', 'topic')), "
    f"m0 AS (SELECT s0.*, v.surah, v.ayah, v.idx, v.ord, greatest({_dyn('norm', 'arg')}, {_dyn('loose', loose_sql('arg'))}) AS "
    f"times, row_number() OVER (PARTITION BY s0.id ORDER BY CASE WHEN op = 'meaning' AND norm <> arg THEN 1 ELSE 0 END, ord) AS "
    f"place "
    f"FROM s0 JOIN v ON CASE WHEN op IN ('explain', 'locate') AND verse_surah IS NOT NULL THEN v.surah = verse_surah AND v.ayah "
    f"= verse_ayah WHEN op = 'starts' THEN starts_with(norm, arg) WHEN op = 'ends' THEN ends_with(norm, arg) ELSE "
    f"contains(norm, arg) OR contains(loose, {loose_sql('arg')}) END), "
    "m1 AS (SELECT id, count(*) AS n, CAST(sum(times) AS BIGINT) AS times, string_agg(surah || ':' || ayah, ',' ORDER BY place) "
    "FILTER (WHERE place <= CASE WHEN op IN ('meaning', 'explain') THEN 1 ELSE 12 END) AS refs, max(idx) FILTER (WHERE place = "
    "1) AS first FROM m0 GROUP BY id), "
    "e0 AS (SELECT s0.id, p.idx, row_number() OVER (PARTITION BY s0.id ORDER BY p.idx) AS place, p.surah, p.ayah_start FROM s0 "
    "JOIN p ON contains(norm_explanation, arg) WHERE op = 'topic'), "
    "e1 AS (SELECT id, count(*) AS n, string_agg(surah || ':' || ayah_start, ',' ORDER BY place) AS refs FROM e0 WHERE place <= "
    "12 GROUP BY id), "
    "u0 AS (SELECT ir.id, ir.number, p.idx, explanation AS t, row_number() OVER (PARTITION BY ir.id ORDER BY idx) AS place, "
    "CASE WHEN number IS NULL THEN 160 ELSE 350 END AS lim FROM ir JOIN p ON p.surah = chapter WHERE op = 'summary' AND (number "
    "IS NULL OR number BETWEEN ayah_start AND ayah_end)), "
    f"u1 AS (SELECT *, {_SPLIT} AS s FROM u0 WHERE place <= CASE WHEN number IS NULL THEN 6 ELSE 1 END), "
    "u2 AS (SELECT id, place, t, lim, s, 1 AS i, coalesce(s[1], '') AS taken, coalesce(length(s[1]) >= lim, true) AS done FROM "
    "u1 UNION ALL SELECT id, place, t, lim, s, i + 1, CASE WHEN length(taken) + length(s[i + 1]) > lim THEN taken ELSE taken || "
    "' ' || s[i + 1] END, "
    "length(taken) + length(s[i + 1]) > lim OR length(taken || ' ' || s[i + 1]) >= lim FROM u2 WHERE NOT done AND i < len(s)), "
    "u3 AS (SELECT id, place, CASE WHEN arg_max(taken, i) = '' THEN substring(any_value(t), 1, any_value(lim)) ELSE "
    "arg_max(taken, i) END AS x FROM u2 GROUP BY id, place), u4 AS (SELECT id, string_agg(x, ' … ' ORDER BY place) AS summary "
    "FROM u3 GROUP BY id), "
    "u5 AS (SELECT ir.id, summary, n_passages, CASE WHEN ir.number IS NOT NULL THEN (SELECT min(idx) FROM u0 WHERE u0.id = "
    "ir.id) END AS idx FROM ir LEFT JOIN u4 USING (id) LEFT JOIN info ON info.number = chapter WHERE op = 'summary'), "
    "ia AS (SELECT id, op, CAST(NULL AS BIGINT) AS n, '' AS refs, CAST(NULL AS INT) AS idx, CAST(NULL AS VARCHAR) AS summary "
    "FROM ir WHERE op IN ('missing', 'script') "
    "UNION ALL SELECT id, CASE WHEN number IS NULL THEN 'missing' ELSE op END, CASE WHEN op = 'order' THEN number ELSE n_verses "
    "END, '', NULL, CASE WHEN op IN ('period', 'chapter_by_number') THEN kind END FROM n0 "
    "UNION ALL SELECT ir.id, CASE WHEN here THEN op ELSE 'missing' END, CASE WHEN here THEN n END, CASE WHEN here THEN "
    "coalesce(refs, '') ELSE '' END, NULL, NULL FROM ir LEFT JOIN b0 USING (id) WHERE op = 'neighbours' "
    "UNION ALL SELECT s0.id, CASE WHEN m1.n IS NULL AND e1.n IS NOT NULL THEN 'topic_explained' WHEN m1.n IS NOT NULL OR op IN "
    "('starts', 'ends', 'phrase_count') THEN op ELSE 'missing' END, "
    "CASE WHEN m1.n IS NULL AND e1.n IS NOT NULL THEN e1.n WHEN op = 'phrase_count' THEN coalesce(times, 0) WHEN op IN "
    "('starts', 'ends') THEN coalesce(m1.n, 0) ELSE m1.n END, "
    "CASE WHEN m1.n IS NULL THEN coalesce(e1.refs, '') WHEN op IN ('starts', 'ends') AND only_count THEN '' ELSE m1.refs END, "
    "CASE WHEN op IN ('meaning', 'explain') THEN first END, NULL FROM s0 LEFT JOIN m1 USING (id) LEFT JOIN e1 USING (id) "
    "UNION ALL SELECT id, CASE WHEN summary IS NULL THEN 'missing' ELSE 'summary' END, CASE WHEN summary IS NOT NULL THEN "
    "n_passages END, '', idx, summary FROM u5)"
)


def _recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


@query(_recursive(_Q + _I + _IA + " SELECT id, op, n, refs, idx, summary FROM ia"))
def intent_answers(spark, d):
    a = Asked(spark)
    return oa.intent_answers(oa.intent_requests(a.q, a.names), a.passages, a.verses).withColumn("refs", _shown("refs"))


_K = (
    f", k AS (SELECT row_number() OVER (ORDER BY id) AS ord, {norm_sql('question')} AS question, answer AS "
    f"said, {norm_sql('answer')} AS answer, list_filter(list_transform(string_split(words, '|'), lambda t: {norm_sql('t')}), "
    f"lambda x: x <> '') AS keywords FROM answered), "
    "k1 AS (SELECT q.id, said, CASE WHEN question = norm THEN 100 WHEN contains(question, norm) OR contains(norm, question) "
    "THEN 12 ELSE 0 END + 6 * len(list_filter(keywords, lambda x: contains(norm, x))) "
    "+ coalesce(list_sum(list_transform(tokens, lambda w: 3 * CAST(contains(question, w) AS INT) + CAST(contains(answer, w) AS "
    "INT))), 0) AS score, ord FROM q, k), "
    "k2 AS (SELECT id, said FROM k1 WHERE score >= 6 QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, ord) = 1), "
    "w0 AS (SELECT q.id, idx, surah, ayah_start, explanation, list_sum(list_transform(tokens, lambda w: 5 * "
    "CAST(contains(norm_text, w) AS INT) + CASE WHEN " + "(length(norm_explanation) - length(replace(norm_explanation, w, ''))) "
    "// length(w)" + " > 0 THEN 2 + 0.5 * least("
    + "(length(norm_explanation) - length(replace(norm_explanation, w, ''))) // length(w)" + ", 5) ELSE 0 END)) + CASE WHEN "
        "len(tokens) < 2 THEN 0 WHEN contains(norm_text, array_to_string(tokens, ' ')) THEN 12 WHEN contains(norm_explanation, "
        "array_to_string(tokens, ' ')) THEN 8 ELSE 0 END AS score, "
    "list_sum(list_transform(tokens, lambda w: CAST(contains(norm_text, w) OR contains(norm_explanation, w) AS INT))) AS found, "
    "len(tokens) AS n FROM q, p WHERE len(tokens) > 0), "
    "w1 AS (SELECT * FROM w0 WHERE found >= ceil(n / 2) AND score >= 5 QUALIFY row_number() OVER (PARTITION BY id ORDER BY "
    "score DESC, idx) = 1), g AS (SELECT id, reply, readable, ruling FROM q)"
)
_C = (
    ", every AS (SELECT id, 0 AS place, 'clarify' AS kind, NULL AS source, NULL AS op, CAST(NULL AS BIGINT) AS total, '' AS "
    "refs, NULL AS text FROM g WHERE NOT readable UNION ALL SELECT id, 1, 'clarify', NULL, NULL, NULL, '', NULL FROM g WHERE "
    "readable AND ruling "
    "UNION ALL SELECT q.id, 2, 'answer', 'qa', NULL, NULL, '', (SELECT arg_min(said, ord) FROM k WHERE question = norm) FROM q "
    "WHERE norm IN (SELECT question FROM k) "
    f"UNION ALL SELECT id, 3, CASE WHEN op IN ('missing', 'script') THEN 'clarify' ELSE 'answer' END, CASE WHEN op IN "
    f"('missing', 'script') THEN NULL WHEN op IN ({lit_list(oa.CHAPTER_OPS)}) THEN 'metadata' ELSE 'tafseer' END, op, n, refs, "
    f"coalesce(summary, (SELECT explanation FROM p WHERE p.idx = ia.idx)) FROM ia "
    "UNION ALL SELECT ar.id, 4, CASE WHEN op IN ('script', 'no_data', 'unparsed') THEN 'clarify' ELSE 'answer' END, CASE WHEN "
    "op NOT IN ('script', 'no_data', 'unparsed') THEN 'analytics' END, op, "
    "CASE WHEN op IN ('script', 'no_data', 'unparsed') THEN NULL WHEN op IN ('first', 'last', 'locations') OR op LIKE '%_verse' "
    "THEN coalesce(ap.n, 0) ELSE total END, coalesce(ap.refs, ''), NULL FROM ar LEFT JOIN tt USING (id) LEFT JOIN ap USING (id) "
    "WHERE op IS NOT NULL "
    "UNION ALL SELECT id, 5, CASE WHEN idx IS NULL THEN 'clarify' ELSE 'answer' END, CASE WHEN idx IS NOT NULL THEN 'tafseer' "
    "END, note, NULL, coalesce((SELECT p.surah || ':' || p.ayah_start FROM p WHERE p.idx = rf.idx), ''), (SELECT explanation "
    "FROM p WHERE p.idx = rf.idx) FROM rf "
    "UNION ALL SELECT id, 6, 'answer', 'qa', NULL, NULL, '', said FROM k2 UNION ALL SELECT id, 7, 'answer', 'tafseer', NULL, "
    "NULL, surah || ':' || ayah_start, explanation FROM w1 UNION ALL SELECT id, 8, 'fallback', NULL, NULL, NULL, '', NULL FROM "
    "g), "
    f"f AS (SELECT *, [{lit_list(oa.STEPS)}][place + 1] AS step FROM every WHERE place < 2 OR place = 8 OR id IN (SELECT id "
    f"FROM g WHERE readable AND NOT ruling) QUALIFY row_number() OVER (PARTITION BY id ORDER BY place) = 1) "
    "SELECT id, reply, step, kind, source, op, total, refs, text, CASE WHEN source = 'tafseer' THEN CASE WHEN length(text) <= "
    "220 THEN text ELSE rtrim(substring(text, 1, 220)) || '…' END END AS excerpt, "
    "CASE WHEN kind <> 'answer' THEN 'low' WHEN source IN ('qa', 'metadata') OR step = 'reference' THEN 'high' ELSE 'medium' "
    "END AS confidence, concat_ws(',', CASE WHEN source = 'tafseer' THEN 'tafsir' ELSE source END, CASE WHEN refs <> '' AND source <> 'analytics' THEN 'quran' END) AS badges FROM f JOIN g USING (id)"
)


@query(_recursive(_Q + _A + _T + _P + ", " + _R + ", " + _I + _IA + _K + _C))
def answers(spark, d):
    passages, verses = dj.passage_index(passages_of(spark))
    known = dj.question_index(ANSWERED.df(spark).withColumn("keywords", F.split("words", "\\|")))
    known = known.withColumn("ord", F.expr("CASE id WHEN 'p' THEN 1 WHEN 'q' THEN 2 ELSE 3 END"))
    return oa.answers(QUESTIONS.df(spark), passages, verses, known).withColumns({"refs": _shown("refs"), "badges": F.array_join("badges", ",")})


@query(_Q + _A + _P + " SELECT h0.id, CAST(place - 1 AS INT) AS place, 'quran' AS type, CASE WHEN reply = 'ar' THEN name ELSE "
    "english END AS surah, CAST(h0.ayah AS VARCHAR) AS ayah, v.text FROM h0 JOIN q ON q.id = h0.id JOIN chapters ON number = "
    "h0.surah JOIN v ON v.surah = h0.surah AND v.ayah = h0.ayah WHERE place <= CASE WHEN op IN ('locations', 'count') THEN 15 "
    "ELSE 1 END")
def answer_references(spark, d):
    a = Asked(spark)
    places = oa.analytics_places(oa.analytics_requests(a.q, a.names), a.verses).join(a.q.select("id", "reply"), "id")
    return oa.cited(places, a.passages, a.verses)
