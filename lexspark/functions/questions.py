"""Column expressions over questions in normal form: their meaningful words and what they ask for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that say nothing about a question's subject, in normal form.
STOP_WORDS = (
    "في من عن علي الي ما ماذا لماذا كيف هل هو هي ذلك هذا هذه الذي التي ثم او و يا ان قد كل بعض عند مع لي لنا "
    "معني تفسير فسر اشرح شرح سوره ايه الايه رقم قوله تعالي "
    "the a an of in on at to for and or is are was were be what which who why how does do did can could me my i you it "
    "meaning mean means explain explanation tafsir tafseer surah sura surat ayah aya ayat verse chapter about tell"
).split()
# Words that ask for a ruling, in normal form, and the patterns of the other kinds in order of precedence.
RULING = ["حكم", "فتوي", "حلال", "حرام", "يجوز", "لا يجوز", "واجب", "مستحب", "مكروه", "هل يجب", "هل يجوز", "هل يحرم", "افتوني"]
KINDS = [
    ("SURAH_INFO", r"عدد\s*(ال)?ايات|مكيه|مدنيه|ترتيب\s*سوره|السوره\s*رقم"),
    ("WORD_LOCATION", r"(اين|أين)[^.!؟]*كلمه|اعرض\s*الايات[^.!؟]*كلمه|فيها\s*كلمه"),
    ("QURAN_STATS", r"(^|\s)كم(\s|$)|(^|\s)(how many|count|number of)(\s|$)"),
    ("TAFSIR_EXPLANATION", r"(^|\s)(اشرح|فسر)(\s|$)|ما\s*تفسير"),
    ("WORD_MEANING", r"معني|تعني"),
    ("TOPIC_AYAHS", r"ايات\s*عن|هات\s*ايات|قصه|ماذا\s*يقول\s*القران\s*عن"),
    ("AYAH_SEARCH", r"في\s*اي\s*سوره\s*وردت|اين\s*توجد\s*ايه|(^|\s)ابحث\s*عن(\s|$)"),
]
GENERAL, UNKNOWN, SAFETY = "GENERAL_TAFSIR_SEARCH", "UNKNOWN", "FATWA_SAFETY"
ANY_LETTER = r"[a-z\x{0600}-\x{06FF}]"


def tokens(norm: Column) -> Column:
    """Words of two characters or more that aren't stop words or numbers."""
    return F.filter(F.split(norm, " "), lambda w: (F.length(w) >= 2) & ~w.isin(STOP_WORDS) & ~w.rlike(r"^[0-9]+$"))


def asks_ruling(norm: Column) -> Column:
    padded = F.concat(F.lit(" "), norm, F.lit(" "))
    return F.exists(F.array(*map(F.lit, RULING)), lambda t: padded.contains(F.concat(F.lit(" "), t, F.lit(" "))))


def kind(norm: Column) -> Column:
    """What a question asks for: the first rule that holds, questions for rulings before all others; null and unreadable ones are unknown."""
    readable = F.coalesce((F.length(norm) >= 2) & norm.rlike(ANY_LETTER), F.lit(False))
    out = F.when(~readable, UNKNOWN).when(asks_ruling(norm), SAFETY)
    for name, pattern in KINDS:
        out = out.when(norm.rlike(pattern), name)
    return out.otherwise(GENERAL)
