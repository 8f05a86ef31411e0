"""Lexicons: the term sets, patterns and units that extraction depends on.

A lexicon is plain data, so packs for other languages can be passed anywhere
one is taken.  Entity roles of a real deployment come from a table
(``Lexicon.with_roles``); the packs here carry small ones.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Lexicon:
    name: str
    #: characters that end a sentence, as the inside of a character class
    terminators: str
    roles: dict[str, tuple[str, ...]] = field(default_factory=dict)
    policy: tuple[str, ...] = ()
    causal: tuple[str, ...] = ()
    temporal: tuple[str, ...] = ()
    financial: tuple[str, ...] = ()
    #: alternation that matches a date's surface form
    dates: str = r"(?:19|20)[0-9]{2}"
    #: last words of organisation names, as an alternation; none: no such candidates
    organisations: str = ""
    generic_prefixes: tuple[str, ...] = ()
    generic_candidates: tuple[str, ...] = ()
    policy_directions: dict[str, tuple[str, ...]] = field(default_factory=dict)
    effect_directions: dict[str, tuple[str, ...]] = field(default_factory=dict)
    #: word for the decimal point, words for scales, and unit patterns
    point_word: str = ""
    scales: dict[str, int] = field(default_factory=dict)
    hundred_suffixes: tuple[str, ...] = ()
    other_units: tuple[str, ...] = ()
    money: str = ""
    percent: str = "%"
    count: str = ""
    suspicious: tuple[str, ...] = ()
    #: inside of a character class: letters that bound a term
    letters: str = "A-Za-zÀ-ÿ"

    @property
    def entities(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys(t for terms in self.roles.values() for t in terms))

    @property
    def sentence(self) -> str:
        return f"[^{self.terminators}]+(?:[{self.terminators}]+|$)"

    def with_roles(self, roles: dict[str, tuple[str, ...]]) -> Lexicon:
        return replace(self, roles=roles)

    @staticmethod
    def read_roles(spark: SparkSession, path: str, role: str = "role", term: str = "term", most: int = 100_000) -> dict[str, tuple[str, ...]]:
        """Roles from a CSV of (role, term); dictionaries are small, more than ``most`` rows are an error."""
        rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path).select(role, term).limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"{path} has more than {most} terms")
        out: dict[str, list[str]] = {}
        for r in rows:
            if r[1] and r[1].strip():
                out.setdefault(r[0], []).append(r[1].strip())
        return {k: tuple(dict.fromkeys(v)) for k, v in out.items()}


# Numbers in ASCII and Bangla digits.
NUMBER = "[0-9০-৯]+(?:[.,][0-9০-৯]+)?%?"
BANGLA_DIGITS, ASCII_DIGITS = "০১২৩৪৫৬৭৮৯", "0123456789"

# The Bangla pack's terms.
BANGLA = Lexicon(
    name="bn",
    terminators="।!?",
    roles={
        "development_finance": ("এডিবি", "বিশ্বব্যাংক", "বিশ্ব ব্যাংক", "আইএমএফ", "আইএফসি", "জাইকা"),
        "regulator": ("বাংলাদেশ ব্যাংক", "কেন্দ্রীয় ব্যাংক", "এনবিআর", "জাতীয় রাজস্ব বোর্ড", "বিএসইসি", "বিটিআরসি", "দুদক"),
        "ministry_government": ("সরকার", "বাংলাদেশ সরকার", "অর্থ মন্ত্রণালয়", "বাণিজ্য মন্ত্রণালয়"),
        "market": ("ডিএসই", "ঢাকা স্টক এক্সচেঞ্জ", "সিএসই", "চট্টগ্রাম স্টক এক্সচেঞ্জ"),
        "state_owned_bank": ("সোনালী ব্যাংক", "জনতা ব্যাংক", "রূপালী ব্যাংক", "অগ্রণী ব্যাংক"),
        "commercial_bank": ("সিটি ব্যাংক", "ব্র্যাক ব্যাংক", "ইসলামী ব্যাংক", "পূবালী ব্যাংক"),
    },
    policy=("সুদের হার", "নীতিগত সুদের হার", "কর", "ভ্যাট", "শুল্ক", "সাবসিডি", "দাম", "মূল্য", "নীতিমালা", "নির্দেশনা", "আরোপ", "প্রত্যাহার", "বাড়িয়েছে", "কমিয়েছে", "বৃদ্ধি", "হ্রাস"),
    causal=("কারণে", "ফলে", "সুতরাং", "অতএব", "যেহেতু", "এর ফলে", "এ কারণে"),
    temporal=(
        "জানুয়ারি", "ফেব্রুয়ারি", "মার্চ", "এপ্রিল", "মে", "জুন", "জুলাই", "আগস্ট", "সেপ্টেম্বর", "অক্টোবর", "নভেম্বর", "ডিসেম্বর",
        "অর্থবছর", "বছর", "মাস", "সপ্তাহ", "দিন", "আজ", "গতকাল", "আগামীকাল", "চলতি", "গত", "আগামী",
    ),
    financial=("টাকা", "কোটি", "লাখ", "ডলার", "ব্যাংক", "ঋণ", "সুদ", "লাভ", "ক্ষতি", "প্রবৃদ্ধি", "বিনিয়োগ", "রপ্তানি", "আমদানি", "শেয়ার", "সূচক", "বাজার", "রাজস্ব", "মুদ্রাস্ফীতি", "রিজার্ভ"),
    dates=(
        "(?:19[0-9]{2}|20[0-9]{2}|[০-৯]{4}|জানুয়ারি|ফেব্রুয়ারি|মার্চ|এপ্রিল|মে|জুন|জুলাই|আগস্ট|সেপ্টেম্বর|অক্টোবর|নভেম্বর|ডিসেম্বর|"
        "আজ|গতকাল|আগামীকাল|গত বছর|চলতি বছর|আগামী বছর|গত মাস|চলতি মাস|আগামী মাস)"
    ),
    organisations=(
        "ব্যাংক|মন্ত্রণালয়|বোর্ড|কমিশন|কর্পোরেশন|করপোরেশন|কোম্পানি|কম্পানি|গ্রুপ|লিমিটেড|এক্সচেঞ্জ|ফাউন্ডেশন|ইন্স্যুরেন্স|ফাইন্যান্স|সিকিউরিটিজ|ক্যাপিটাল|টেলিকম"
    ),
    generic_prefixes=("এ", "এই", "তবে", "ফলে", "আর", "তিনি", "দেশের", "বিভিন্ন", "সরকারি", "বেসরকারি", "বাণিজ্যিক", "ও", "এবং"),
    generic_candidates=("ব্যাংক", "কোম্পানি", "কম্পানি", "গ্রুপ", "বোর্ড", "কমিশন", "লিমিটেড", "মন্ত্রণালয়"),
    policy_directions={
        "increase": ("বৃদ্ধি", "বাড়", "আরোপ", "উন্নীত", "চালু", "অনুমোদন", "প্রয়োজন আছে", "কাটল"),
        "decrease": ("হ্রাস", "কম", "প্রত্যাহার", "বাতিল", "স্থগিত", "বন্ধ", "প্রয়োজন নেই", "বাধা"),
    },
    effect_directions={
        "positive": ("বেড়েছে", "বৃদ্ধি", "লাভ", "উন্নতি", "স্থিতিশীল", "উদ্বৃত্ত", "বাড়বে"),
        "negative": ("চাপ", "কমেছে", "হ্রাস", "ক্ষতি", "সংকট", "ঘাটতি", "ব্যাহত", "পতন", "ঝুঁকি"),
    },
    point_word="দশমিক",
    scales={"কোটি": 10_000_000, "লাখ": 100_000, "হাজার": 1_000},
    hundred_suffixes=("শত", "শ"),
    other_units=("শতাংশ", "ভাগ", "%", "ডলার", "টাকা", "টাকার", "টি", "জন"),
    money="(?:টাকা|টাকার|ডলার|মার্কিন ডলার)",
    percent="(?:শতাংশ|ভাগ|%)",
    count="(?:টি|টির|টা|টার|জন|দেশ|কারখানা|হাসপাতাল|পয়েন্ট|প্যাকেট)",
    suspicious=("প্রব্যঙ্গ", "নির্নয়ন"),
    letters="ঀ-৿",
)

#: A small pack for Latin-script test tables: fragments that their invented prose holds.
LATIN = Lexicon(
    name="latin-test",
    terminators=".!?",
    roles={"north": ("thation", "heon", "eron"), "south": ("onble", "shing", "ingly"), "west": ("quele", "aiter", "eaux"), "east": ("keitung", "schlich", "enver")},
    policy=("with", "avec", "para", "von"),
    causal=("from", "pour", "por ", "für"),
    temporal=("this", "dans", "esta", "sich"),
    financial=("tion", "ment", "keit", "ción"),
    dates="(?:19[0-9]{2}|20[0-9]{2}|this|dans)",
    policy_directions={"increase": ("with", "avec"), "decrease": ("para", "von")},
    effect_directions={"positive": ("tion", "keit"), "negative": ("ment", "ción")},
    scales={"thousand": 1_000, "million": 1_000_000},
    other_units=("%", "dollars", "euros"),
    money="(?:dollars|euros)",
    count="(?:items|people)",
)


def alternation(terms) -> str:
    """A pattern that matches any of the terms, longer ones first."""
    return "|".join(re.escape(t) for t in sorted(terms, key=lambda t: (-len(t), t)))
