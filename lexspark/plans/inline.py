"""Small tables that are a part of a query, for Spark and for its SQL twin alike."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

_DUCK = {"string": "VARCHAR", "int": "INTEGER", "long": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN"}


def literal(value: object) -> str:
    """A value in SQL."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    return repr(value)


@dataclass(frozen=True)
class Inline:
    """name, columns (as a Spark schema of plain types) and rows."""

    name: str
    schema: str
    rows: list[tuple]

    def df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, self.schema)

    @property
    def cte(self) -> str:
        """The table as a WITH item."""
        columns = [c.split() for c in self.schema.split(",")]
        casts = ", ".join(f"CAST({n} AS {_DUCK[t]}) AS {n}" for n, t in columns)
        rows = ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in self.rows)
        return f"{self.name} AS (SELECT {casts} FROM (VALUES {rows}) AS _t({', '.join(n for n, _ in columns)}))"


def with_tables(*tables: Inline) -> str:
    return "WITH " + ", ".join(t.cte for t in tables)


CHAPTERS = Inline("chapters", "number int, name string, english string, first_page int, n_verses int, kind string", [
    (1, "الفاتحة", "Al-Fatihah", 1, 7, "meccan"), (2, "البقرة", "Al-Baqarah", 2, 286, "medinan"), (
        9, "التوبة", "At-Tawbah", 187, 129, "medinan"
    ),
    (19, "مريم", "Maryam", 305, 98, "meccan"), (110, "النصر", "An-Nasr", 603, 3, "medinan"), (
        112, "الإخلاص", "Al-Ikhlas", 604, 4, "meccan"
    ),
    (114, "الناس", "An-Nas", 604, 6, "meccan"),
])

#: Verses of short chapters, as they are printed.
_TEXTS = {
    1: ["بِسْمِ ٱللَّهِ ٱلرَّحْمَٰنِ ٱلرَّحِيمِ", "ٱلْحَمْدُ لِلَّهِ رَبِّ ٱلْعَٰلَمِينَ", "ٱلرَّحْمَٰنِ ٱلرَّحِيمِ",
    "مَٰلِكِ يَوْمِ ٱلدِّينِ",
        "إِيَّاكَ نَعْبُدُ وَإِيَّاكَ نَسْتَعِينُ", "ٱهْدِنَا ٱلصِّرَٰطَ ٱلْمُسْتَقِيمَ",
        "صِرَٰطَ ٱلَّذِينَ أَنْعَمْتَ عَلَيْهِمْ غَيْرِ ٱلْمَغْضُوبِ عَلَيْهِمْ وَلَا ٱلضَّآلِّينَ"],
    19: ["كٓهيعٓصٓ", "ذِكْرُ رَحْمَتِ رَبِّكَ عَبْدَهُۥ زَكَرِيَّآ", "إِذْ نَادَىٰ رَبَّهُۥ نِدَآءً خَفِيًّا"],
    112: ["قُلْ هُوَ ٱللَّهُ أَحَدٌ", "ٱللَّهُ ٱلصَّمَدُ", "لَمْ يَلِدْ وَلَمْ يُولَدْ", "وَلَمْ يَكُن لَّهُۥ كُفُوًا أَحَدٌۢ"],
    114: [
        "قُلْ أَعُوذُ بِرَبِّ ٱلنَّاسِ", "مَلِكِ ٱلنَّاسِ", "إِلَٰهِ ٱلنَّاسِ", "مِن شَرِّ ٱلْوَسْوَاسِ ٱلْخَنَّاسِ",
        "ٱلَّذِى يُوَسْوِسُ فِى صُدُورِ ٱلنَّاسِ", "مِنَ ٱلْجِنَّةِ وَٱلنَّاسِ"
    ],
}
_PAGE, _JUZ = {1: 1, 19: 305, 112: 604, 114: 604}, {1: 1, 19: 16, 112: 30, 114: 30}
VERSES = Inline(
    "verses", "surah int, ayah int, page int, juz int, text string",
    [(s, i + 1, _PAGE[s], _JUZ[s], t) for s, held in _TEXTS.items() for i, t in enumerate(held)]
)

#: Passages: runs of verses with an explanation of our own.
_PASSAGES = [
    (1, 1, 4, "تبدأ السورة بالبسملة والحمد. فيها ذكر الرحمة والملك ليوم الدين! وهي سبع آيات."),
    (1, 5, 7, "عبادة واستعانة وطلب الهداية إلى الصراط المستقيم. ثم بيان صراط الذين أنعم عليهم؟ نعم."),
    (19, 1, 3, "قصة زكريا ودعاؤه الخفي\nوفيها ذكر الرحمة والصبر. " + "كلام طويل في معنى الدعاء وآدابه. " * 12),
    (112, 1, 4, "سورة التوحيد. الصمد هو المقصود في الحوائج."),
    (114, 1, 1, "الاستعاذة برب الناس."), (114, 2, 6, "بيان الملك والإله، والاستعاذة من شر الوسواس. والصبر على ذلك."),
]
PASSAGES = Inline(
    "passages", "idx int, surah int, ayah_start int, ayah_end int, ayah_text string, explanation string",
    [(i, s, a, b, " ".join(_TEXTS[s][a - 1 : b]), e) for i, (s, a, b, e) in enumerate(_PASSAGES)]
)
