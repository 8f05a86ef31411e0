"""Salience of sentences, scores of edit candidates, and spans of phrases.  Column in, Column out."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T
from .lexicon import ASCII_DIGITS, BANGLA_DIGITS, Lexicon
from .scoring import clamp, rounded

# Scores of proposition families and of archived claim types.
PROPOSITION = {"policy_reversal": 0.90, "relative_time": 0.82, "year": 0.75, "month": 0.80, "causal_connector": 0.86, "causal_outcome": 0.88}
ARCHIVED_EDITABILITY = {"numeric": 0.90, "policy": 0.85, "temporal": 0.75, "entity": 0.65, "causal": 0.45}


@dataclass(frozen=True)
class Rewrites:
    """Cues and pairs (from, to) that rule edits depend on; plain data, as a lexicon is."""

    increase: tuple[str, ...] = ()
    decrease: tuple[str, ...] = ()
    attribution: tuple[str, ...] = ()
    effects: tuple[str, ...] = ()
    #: terms that make a policy phrase specific, and words near a number that make it one of amounts
    specific: tuple[str, ...] = ()
    amounts: tuple[str, ...] = ()
    percent_word: str = ""
    #: names of months in the year's order; each is shifted to the next
    months: tuple[str, ...] = ()
    relative_times: tuple[tuple[str, str], ...] = ()
    policies: tuple[tuple[str, str], ...] = ()
    connectors: tuple[tuple[str, str], ...] = ()
    outcomes: tuple[tuple[str, str], ...] = ()
    #: endings that a term may carry
    suffixes: tuple[str, ...] = ()

    @property
    def month_pairs(self) -> tuple[tuple[str, str], ...]:
        return tuple(zip(self.months, (*self.months[1:], *self.months[:1]), strict=True))


# The Bangla pack's cues and pairs.
BANGLA_REWRITES = Rewrites(
    increase=("বাড়িয়েছে", "বাড়বে", "বেড়েছে", "বৃদ্ধি", "বৃদ্ধি পেয়েছে", "বৃদ্ধি পায়", "উন্নতি", "উঠেছে", "উর্ধ্বমুখী"),
    decrease=("কমিয়েছে", "কমাবে", "কমেছে", "হ্রাস", "হ্রাস পেয়েছে", "পতন", "অবনতি", "নিম্নমুখী", "কমে গেছে"),
    attribution=("বলেন", "বলেন,", "জানান", "জানায়", "জানিয়েছে", "মতে", "অনুযায়ী", "অনুসারে", "প্রকাশ", "উল্লেখ", "অভিমত", "দাবি করেন"),
    effects=("হয়েছে", "বৃদ্ধি পেয়েছে", "কমেছে", "পরিবর্তন হয়েছে", "প্রভাবিত হয়েছে", "ক্ষতিগ্রস্ত হয়েছে", "উন্নত হয়েছে"),
    specific=("নীতিগত", "সুদের", "কর", "ভ্যাট", "শুল্ক", "সাবসিডি", "দাম", "মূল্য", "নীতি", "হার"),
    amounts=("কোটি", "লাখ", "দশমিক", "টাকা", "ডলার"),
    percent_word="শতাংশ",
    months=("জানুয়ারি", "ফেব্রুয়ারি", "মার্চ", "এপ্রিল", "মে", "জুন", "জুলাই", "আগস্ট", "সেপ্টেম্বর", "অক্টোবর", "নভেম্বর", "ডিসেম্বর"),
    relative_times=(("গত বছর", "চলতি বছর"), ("চলতি বছর", "গত বছর"), ("আগামী বছর", "চলতি বছর"), ("গত মাসে", "আগামী মাসে"), ("চলতি মাসে", "গত মাসে"), ("গতকাল", "আজ"), ("আজ", "গতকাল"), ("আগামীকাল", "গতকাল")),
    policies=(
        ("সুদের হার বাড়িয়েছে", "সুদের হার কমিয়েছে"), ("সুদের হার কমিয়েছে", "সুদের হার বাড়িয়েছে"), ("কর কমিয়েছে", "কর বাড়িয়েছে"), ("কর বাড়িয়েছে", "কর কমিয়েছে"),
        ("বৃদ্ধি পেয়েছে", "হ্রাস পেয়েছে"), ("হ্রাস পেয়েছে", "বৃদ্ধি পেয়েছে"), ("বেড়েছে", "কমেছে"), ("লাভ", "ক্ষতি"), ("ক্ষতি", "লাভ"),
        ("আরোপ করেছে", "প্রত্যাহার করেছে"), ("প্রত্যাহার করেছে", "আরোপ করেছে"),
    ),
    connectors=(("এর ফলে", "তার বিপরীতে"), ("এ কারণে", "তবুও"), ("কারণে", "সত্ত্বেও"), ("কারণ", "যদিও"), ("ফলে", "যদিও"), ("তাই", "তবুও"), ("সুতরাং", "তবুও"), ("অতএব", "তবুও"), ("যেহেতু", "যদিও")),
    outcomes=(("বৃদ্ধি পেয়েছে", "হ্রাস পেয়েছে"), ("বেড়েছে", "কমেছে"), ("কমেছে", "বেড়েছে"), ("হ্রাস পেয়েছে", "বৃদ্ধি পেয়েছে"), ("ক্ষতিগ্রস্ত হয়েছে", "উন্নত হয়েছে"), ("হয়েছে", "হয়নি")),
    suffixes=("গুলোর", "গুলোকে", "গুলো", "দের", "টির", "টি", "কে", "তে", "য়ে", "এর", "ের", "র", "য়", "ে"),
)

YEAR = "(?:19[0-9]{2}|20[0-9]{2}|[০-৯]{4})"


def is_year_like(c: Column) -> Column:
    """Whether a number has four digits, of either script, between 1900 and 2099."""
    digits = T.normalize_digits(F.regexp_replace(c, "[^0-9০-৯]", ""))
    return digits.rlike("^(?:19|20)[0-9]{2}$")


def has_year(c: Column) -> Column:
    """Whether four digits that can be a year stand in the text with no digit at either side."""
    return F.concat(F.lit(" "), c, F.lit(" ")).rlike(f"[^0-9০-৯]{YEAR}[^0-9০-৯]")


def at_boundary(c: Column, start: Column, end: Column, lexicon: Lexicon) -> Column:
    """Whether neither neighbour of [start, end) is a letter or digit."""
    edge = f"^[{lexicon.letters}0-9০-৯]$"
    before, after = F.when(start > 0, F.substring(c, start, F.lit(1))).otherwise(""), F.substring(c, end + 1, F.lit(1))
    return ~before.rlike(edge) & ~after.rlike(edge)


def phrase_place(c: Column, phrase: str, lexicon: Lexicon, suffixes: tuple[str, ...] = ()) -> tuple[Column, Column]:
    """(whether the phrase stands in the text, its first place): the place is only to be asked for where it stands."""
    edge = f"{lexicon.letters}0-9০-৯"
    ending = f"(?:{'|'.join(map(re.escape, suffixes))})?" if suffixes else ""
    upto = f"(?s)^.*?((?<![{edge}]){re.escape(phrase)}{ending}(?![{edge}]))"
    head = F.regexp_extract(c, upto, 0)
    found = F.regexp_extract(c, upto, 1) if suffixes else F.lit(phrase)
    place = F.struct((F.length(head) - F.length(found)).alias("start"), F.length(head).alias("end"), found.alias("text"))
    return c.contains(phrase) & (head != ""), place  # most texts lack the phrase


def phrase_span(c: Column, phrase: str, lexicon: Lexicon, suffixes: tuple[str, ...] = ()) -> Column:
    """struct<start, end, text> of the phrase's first place with no letter or digit beside it, an ending included; null if there is none."""
    there, place = phrase_place(c, phrase, lexicon, suffixes)
    return F.when(there, place)


def split_suffix(surface: Column, base: Column, suffixes: tuple[str, ...]) -> Column:
    """struct<base, suffix>: the longest ending whose removal leaves something that begins with the base."""
    out = F.struct(surface.alias("base"), F.lit("").alias("suffix"))
    for s in sorted(suffixes, key=len):
        stem = F.substring(surface, F.lit(1), F.length(surface) - len(s))
        out = F.when(surface.endswith(s) & (F.length(surface) > len(s)) & stem.startswith(base), F.struct(stem.alias("base"), F.lit(s).alias("suffix"))).otherwise(out)
    return F.when(surface == base, F.struct(base.alias("base"), F.lit("").alias("suffix"))).otherwise(out)


def numeric_values(c: Column, lexicon: Lexicon) -> Column:
    """Values of numbers with the decimal point as a word, then those of all other numbers, each in the text's order.

    A number with one of the lexicon's endings for hundreds counts a hundred
    times, unless a per cent sign or word follows it.
    """
    digits = "[0-9০-৯]+"
    rest, first = c, F.array().cast("array<double>")
    if lexicon.point_word:
        worded = f"{digits}{T.SPACE}+{lexicon.point_word}{T.SPACE}+{digits}"
        first = F.transform(F.regexp_extract_all(c, F.lit(worded), 0), lambda x: T.numeric(x, lexicon))
        rest = F.regexp_replace(c, worded, "\x01")
    hundreds = "|".join(sorted(lexicon.hundred_suffixes, key=len))
    unit = f"({T.SPACE}*(?:{lexicon.percent}))?({T.SPACE}*(?:{hundreds or chr(1)})(?:[’']|{T.SPACE}|টি|টার|$))?"
    pattern = f"({digits}(?:[.,]{digits})?){unit}"
    parts = F.arrays_zip(*[F.regexp_extract_all(rest, F.lit(pattern), k).alias(n) for k, n in ((1, "raw"), (2, "percent"), (3, "hundred"))])
    factor = lambda p: F.when((p["hundred"] != "") & (p["percent"] == ""), 100.0).otherwise(1.0)
    return F.filter(F.concat(first, F.transform(parts, lambda p: T.numeric(p["raw"], lexicon) * factor(p))), lambda v: v.isNotNull())


def numerically_equal(a: Column, b: Column, lexicon: Lexicon) -> Column:
    """Whether two texts have the same scaled values, and any."""
    x, y = T.scaled_values(a, lexicon), T.scaled_values(b, lexicon)
    return (F.size(x) > 0) & (x == y)


def salience(index: Column, sentence: Column, lexicon: Lexicon, words: Rewrites) -> Column:
    """How claim-like a sentence is: its place and its cues."""
    place = F.when(index == 0, 1.8).when(index == 1, 1.2).when(index == 2, 0.7).otherwise(F.greatest(F.lit(0.0), 0.4 - 0.05 * (index - 2)))
    cues = [
        (T.contains_any(sentence, lexicon.financial), 1.0),
        (T.contains_any(sentence, words.attribution), 0.9),
        (T.contains_any(sentence, (*words.increase, *words.decrease)), 0.7),
        (sentence.rlike("[0-9০-৯]"), 0.8),
        (T.contains_any(sentence, (*lexicon.causal, *words.effects)), 0.6),
        (T.contains_any(sentence, words.months), 0.5),
        (has_year(sentence), 0.5),
        (F.size(T.words(sentence)) < 6, -0.3),
    ]
    for found, weight in cues:
        place = place + F.when(found, weight).otherwise(0.0)
    return rounded(place)


def numeric_score(sentence: Column, start: Column, end: Column, salient: Column, lexicon: Lexicon, words: Rewrites, reach: int = 24) -> Column:
    """Score of the number at [start, end): cues within ``reach`` characters, and the sentence's salience."""
    low = F.greatest(start - reach, F.lit(0))
    window, number = F.substring(sentence, low + 1, end + reach - low), F.substring(sentence, start + 1, end - start)
    percent = number.contains("%") | (window.contains(words.percent_word) if words.percent_word else F.lit(False))
    score = salient
    for found, weight in (
        (T.contains_any(window, lexicon.financial), 2.0),
        (T.contains_any(window, (*words.increase, *words.decrease)), 1.0),
        (percent, 2.0),
        (T.contains_any(window, words.amounts), 1.0),
    ):
        score = score + F.when(found, weight).otherwise(0.0)
    return rounded(score)


def policy_score(sentence: Column, source: str, salient: Column, words: Rewrites) -> Column:
    """Score of a policy phrase: its own terms and length, and whether it stands early."""
    own = (1.2 if any(t in source for t in words.specific) else 0.0) + (0.4 if len(source) >= 8 else 0.0)
    return rounded(salient + own + F.when(F.substring(sentence, 1, 120).contains(source), 0.2).otherwise(0.0))


def archived_importance(index: Column, sentence: Column, lexicon: Lexicon, words: Rewrites) -> Column:
    """Importance on the archived scale of 0 to 5."""
    hits = lambda terms: sum((sentence.contains(t).cast("int") for t in dict.fromkeys(terms)), F.lit(0))
    place = F.when(index == 0, 2.0).when(index == 1, 1.5).when(index == 2, 1.0).otherwise(F.greatest(F.lit(0.0), 0.6 - 0.05 * (index - 2)))
    score = (
        place
        + F.least(F.lit(2.0), 0.25 * hits(lexicon.financial))
        + F.least(F.lit(1.5), 0.4 * hits((*words.increase, *words.decrease)))
        + F.when(T.contains_any(sentence, words.attribution), 0.8).otherwise(0.0)
        + F.when(sentence.rlike("[0-9০-৯]"), 0.6).otherwise(0.0)
        - F.when(F.size(T.words(sentence)) < 6, 0.5).otherwise(0.0)
    )
    return rounded(clamp(score, 0.0, 5.0))


def diversity_bonus(uses: Column, history: Column, budget: Column) -> Column:
    """Bonus of a family used ``uses`` times among ``history`` earlier choices."""
    return F.when(history == 0, 0.5).when(uses == 0, 0.8).when(uses < budget * 0.3, 0.5).when(uses < budget * 0.7, 0.2).otherwise(0.0)


def shifted_number(number: Column, sentence: Column, chance: Column, words: Rewrites) -> Column:
    """The number moved: years by one or two, small ones and per cents by half to three, others by 15 to 65 per cent; in its own script.

    chance: a number in [0, 1), such as a seeded hash, that decides how far.
    """
    bare = F.regexp_replace(number, "%$", "")
    plain = T.normalize_digits(F.replace(bare, F.lit(","), F.lit("")))
    value = plain.try_cast("double")
    percent = number.contains("%") | (sentence.contains(words.percent_word) if words.percent_word else F.lit(False))
    few = F.length(F.regexp_replace(plain, "[^0-9]", "")) <= 3
    year = F.greatest(F.lit(1900.0), F.least(F.lit(2099.0), F.round(value) + F.element_at(F.array(*[F.lit(x) for x in (-2.0, -1.0, 1.0, 2.0)]), F.floor(chance * 4).cast("int") + 1)))
    half = chance * 2 - F.floor(chance * 2)
    step = 0.5 + 2.5 * half
    small = (
        F.when(T.contains_any(sentence, words.increase), F.greatest(F.lit(0.1), value - step))
        .when(T.contains_any(sentence, words.decrease), value + step)
        .otherwise(value + F.when(chance < 0.5, -step).otherwise(step))
    )
    large = F.greatest(F.lit(0.1), value * F.when(chance < 0.5, 0.65 + 0.20 * half).otherwise(1.15 + 0.50 * half))
    new = F.when(is_year_like(bare), year).when(percent | few, small).otherwise(large)
    tenth = F.round(new, 1)
    shown = F.when(F.abs(new - F.round(new)) < 1e-8, F.format_string("%.0f", F.round(new))).otherwise(F.regexp_replace(F.format_string("%.1f", tenth), r"\.?0+$", ""))
    shown = F.when(F.abs(tenth - F.round(tenth)) < 1e-8, F.format_string("%.0f", F.round(tenth))).otherwise(shown)
    script = F.when(number.rlike("[০-৯]"), F.translate(shown, ASCII_DIGITS, BANGLA_DIGITS)).otherwise(shown)
    return F.when(value.isNotNull(), F.concat(script, F.when(number.endswith("%"), "%").otherwise("")))
