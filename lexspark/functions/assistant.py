"""Fixed vocabularies of questions about a text, in normal form, and column expressions that read them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What makes a question one of counting, places, first and last places, extremes, comparison; scopes that the data don't have; a wish for the rows themselves.
COUNTING = [r"(^|\s)كم(\s|$)", r"(^|\s)(how many|count|number of)(\s|$)"]
LOCATION = r"(^|\s)اين(\s|$)|اعرض\s+الايات|فيها\s+كلمه|which ayahs|where.*mentioned|show.*verses"
FIRST_LAST = r"(اول|اخر)\s*(موضع|مره)|first occurrence|last occurrence|first time|last time"
SUPERLATIVE = r"اطول|اقصر|longest|shortest"
COMPARISON = r"ايهما اكثر|قارن|compare|which is more"
NO_SCOPE = r"(^|\s)(جزء|الجزء|صفحه|الصفحه|juz|page)(\s|$)"
DETAILS = r"مع\s*الايات|اعرض\s*الايات|مع\s*النص|with (the )?verses|show (the )?ayahs"
SCOPE = r"\s(سوره|سورت|surah|surat|sura)\s+(\S+)(?:\s+(\S+))?"
WORD = "[ء-يٱ0-9]+"
EITHER, BETWEEN = rf"({WORD})\s+(?:ام|او|or)\s+({WORD})", rf"(?:ذكر|بين)\s+({WORD})\s+و({WORD})"

# Words that say nothing about what is counted or located; another name of a word.
BASIC_FILLERS = (
    "كم في من القران الكريم المصحف النص كله كاملا كامل هل يوجد توجد هناك "
    "how many much count number total the in is are there of all whole entire quran koran"
).split()
COUNT_FILLERS = (
    "مره مرات المرات عدد ذكرت ذكر ذكرها وردت ورد جاءت جاء تكررت تكرر كلمه الكلمه لفظ اللفظ اسم "
    "times time word words mentioned mention mentions appear appears appeared occurrence occurrences repeated does do did was "
    "were it"
).split()
LOCATION_FILLERS = (
    "اين التي فيها فيه به اعرض الايات ايات موضع مواضع اول اخر الاولي الاخيره مع النص "
    "show where which contains first last place position positions ayahs verses occurrence"
).split()
ALIASES = {"الجلاله": "الله"}
# Words that ask for a total of verses, chapters, words or letters.
TOTALS = {
    "ayahs": "ايه ايات الايات ayah ayahs aya ayat verse verses".split(),
    "surahs": "سوره سور السور surah surahs sura suras chapter chapters".split(),
    "words": "كلمه كلمات الكلمات word words".split(),
    "letters": "حرف حروف الحروف letter letters".split(),
}
# Names of marks and letters, and the code points that are counted for each.
MARK_CHARS = {"شده": "ّ", "فتحه": "َ", "ضمه": "ُ", "كسره": "ِ", "سكون": "ْۡ", "تنوين": "ًٌٍ", "مده": "ٓ", "همزه": "ءأؤإئ"}
MARK_NAMES = {
    "shadda": "شده", "shaddah": "شده", "shaddas": "شده", "fatha": "فتحه", "fathah": "فتحه", "damma": "ضمه", "dammah": "ضمه",
    "kasra": "كسره", "kasrah": "كسره",
    "sukun": "سكون", "sukoon": "سكون", "tanween": "تنوين", "tanwin": "تنوين", "maddah": "مده", "madda": "مده", "hamza": "همزه",
    "hamzah": "همزه",
}
LETTER_CHARS = {
    "الف": "اأإآٱ", "همزه": "ءأؤإئ", "ياء": "يى", "با": "ب", "باء": "ب", "تاء": "ت", "ثاء": "ث", "جيم": "ج", "حاء": "ح",
    "خاء": "خ", "دال": "د", "ذال": "ذ", "راء": "ر", "زاي": "ز", "زاء": "ز",
    "سين": "س", "شين": "ش", "صاد": "ص", "ضاد": "ض", "طاء": "ط", "ظاء": "ظ", "عين": "ع", "غين": "غ", "فاء": "ف", "قاف": "ق",
    "كاف": "ك", "لام": "ل", "ميم": "م", "نون": "ن", "هاء": "ه", "واو": "و",
}
LETTER_WORDS = ["حرف", "letter"]

# What the further kinds of questions begin with or hold, in the order in which they are tried, and words that are no part of a phrase asked for.
SUMMARY = r"(^|\s)(لخص|ملخص)(\s|$)"
NEIGHBOUR = r"الايه\s*قبل|الايه\s*بعد|السابقه|اللاحقه|ayah before|ayah after|previous ayah|next ayah"
BEFORE, AFTER, BOTH = r"قبل|before|previous", r"بعد|after|next", r"سابق.*لاحق|لاحق.*سابق"
STARTS, ENDS, ONLY_COUNT = r"تبدا\s*ب|تبدأ\s*ب|starts? with", r"تنتهي\s*ب|ends? with", r"كم\s*ايه|how many"
PHRASE_COUNT = r"كم\s*مره\s*(وردت|ذكرت)\s*(عباره|جمله)"
BY_NUMBER = r"السوره\s*رقم\s*(\d+)|surah\s*(number|#)?\s*(\d+)"
VERSE_COUNT, PERIOD, ORDER = r"عدد\s*(ال)?ايات", r"مكيه|مدنيه|meccan|medinan", r"ترتيب"
MEANING = r"معنى|معني|تعني|تعنى"
EXPLAIN = r"(^|\s)(اشرح|فسر)(\s|$)|ما\s*تفسير"
LOCATE = r"اي\s*سوره\s*وردت|اين\s*توجد\s*ايه|which surah|where is the ayah"
TOPIC = r"(^|\s)(ايات عن|هات ايات|قصه|قصة|اين ذكرت قصه)|what does the quran say about|verses about|story of"
PHRASE_FILLERS = (
    "اشرح فسر شرح تفسير ما اي معني كلمه الكلمه ماذا تعني قوله تعالي ايه الايه قصه عن هات ايات الايات يقول القران الكريم في من "
    "سوره لخص ملخص "
    "التي تبدا تنتهي بـ ب عباره جمله وردت ورد ذكرت ذكر كم مره توجد اين وجدت موجوده"
).split()
#: Verses that have a name of their own, as name in normal form, chapter, verse.
NAMED = [("ايه الكرسي", 2, 255), ("ايه الدين", 2, 282)]


def any_of(text: Column, patterns: list[str]) -> Column:
    return F.exists(F.lit(patterns), lambda p: F.regexp_like(text, p))


def without(words: Column, *fillers: list[str]) -> Column:
    return F.filter(words, lambda w: ~w.isin(sum(fillers, [])))


def one_target(words: Column) -> Column:
    """The one to four words that are left, together; another name is replaced. Null for more or none."""
    text = F.array_join(words, " ")
    for name, other in ALIASES.items():
        text = F.when(text == name, other).otherwise(text)
    return F.when(F.size(words).between(1, 4), text)


def phrase(norm: Column) -> Column:
    """What is left of a question without the words of its form."""
    return F.array_join(F.filter(F.split(norm, " "), lambda w: (w != "") & ~w.isin(PHRASE_FILLERS)), " ")


def latin(text: Column) -> Column:
    return text.rlike("[a-z]")


def table_of(entries: dict[str, str], key: Column) -> Column:
    """The entry of a key in a fixed table; null if it has none."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in entries.items() for x in kv]), key)


def bare(word: Column) -> Column:
    """A word without the article."""
    return F.regexp_replace(word, "^ال", "")


def mark_of(word: Column) -> Column:
    """The code points of the mark that a word names; null if it names none."""
    return F.coalesce(
        table_of(MARK_CHARS, word), table_of(MARK_CHARS, bare(word)), table_of(MARK_CHARS, table_of(MARK_NAMES, word))
    )


def letter_of(word: Column) -> Column:
    """The code points of the letter that a word names or is; null if it is none."""
    return F.coalesce(
        table_of(LETTER_CHARS, word), table_of(LETTER_CHARS, bare(word)),
        F.when((F.length(word) == 1) & word.rlike("[ء-يٱ]"), word)
    )


def numbers(text: Column) -> Column:
    """The stretches of digits of a text, as numbers."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"(\d+)"), 1), lambda n: n.try_cast("int"))


def occurrences(text: Column, needle: Column) -> Column:
    """Occurrences of a needle that is a column, as ``count_of``."""
    n = F.length(needle)
    return F.when(
        n > 0, ((F.length(text) - F.length(F.replace(text, needle, F.lit("")))) / n).cast("long")
    ).otherwise(F.lit(0).cast("long"))


def target_occurrences(norm: Column, target: Column) -> Column:
    """Occurrences of a word and of its elided form, as ``count_target``."""
    tail = F.substring(target, 2, 1 << 20)
    form = F.when(
        target.startswith("ال") & (F.length(target) > 3),
        F.when(target.startswith("الل"), tail).otherwise(F.concat(F.lit("ل"), tail))
    )
    more = F.when(
        form.isNotNull(),
        F.regexp_count(norm, F.concat(F.lit(r"(?<!ا)(?=\Q"), F.coalesce(form, F.lit("-")), F.lit(r"\E)"))).cast("long")
    ).otherwise(0)
    return occurrences(norm, target) + more


def char_count(text: Column, chars: Column) -> Column:
    return (F.length(text) - F.length(F.call_function("translate", text, chars, F.lit("")))).cast("long")


def loose_form(text: Column) -> Column:
    return F.regexp_replace(text, "([^ ])ا+", "$1")
