"""Text functions: segmentation, spans, extraction.  Column in, Column out."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lexicon import ASCII_DIGITS, BANGLA_DIGITS, NUMBER, Lexicon

#: All characters that count as white space, in a form that Java and RE2 both read.
SPACE = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

#: The same characters one by one, and a run of all others, with few ranges to ask about each character.
BLANKS = "".join(map(chr, (0x20, *range(0x09, 0x0E), *range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
WORD = r"[^\x09-\x0d\x1c-\x1f\x{85}\p{Z}]+"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def squeeze(c: Column) -> Column:
    """White space as single spaces, none at the ends."""
    return strip(F.regexp_replace(c, f"{SPACE}+", " "))


def words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(WORD), 0)  # its pattern is compiled once, that of split() for every row


def contains_any(c: Column, terms: Iterable[str]) -> Column:
    out = F.lit(False)
    for t in terms:
        out = out | c.contains(t)
    return out


#: Sentences whose lengths are added up one by one; longer sums go over blocks of so many.
BLOCK = 16


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, wherever the body uses it (in lambdas too)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def sentence_spans(c: Column, lexicon: Lexicon) -> Column:
    """array<struct<idx, start, end, text>>: offsets of the whole match, text stripped, blank ones left out.

    Lengths are summed over blocks first and then within each sentence's block,
    so the work grows with the text and not with its square.
    """
    lead = F.length(F.regexp_extract(c, f"^[{lexicon.terminators}]+", 0))
    total = lambda xs: F.length(F.array_join(xs, ""))

    def cut(found: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.size(found), F.lit(1)) - 1) / BLOCK).cast("int")), lambda b: F.slice(found, b * BLOCK + 1, F.lit(BLOCK)))

    def spans(own: Column) -> Column:
        blocks = own["blocks"]
        before = F.aggregate(blocks, F.array(own["lead"]), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + total(x))))

        def placed(z: Column, b: Column) -> Column:
            upto = lambda n: z["at"] + total(F.slice(z["x"], F.lit(1), n))
            return F.transform(z["x"], lambda x, i: F.struct((b * BLOCK + i).alias("idx"), upto(i).alias("start"), upto(i + 1).alias("end"), strip(x).alias("text")))

        return F.flatten(F.transform(F.arrays_zip(blocks.alias("x"), F.slice(before, F.lit(1), F.size(before) - 1).alias("at")), placed))

    blocks = let(F.regexp_extract_all(c, F.lit(lexicon.sentence), 0), cut)
    return F.filter(let(F.struct(blocks.alias("blocks"), lead.alias("lead")), spans), lambda s: s["text"] != "")


def target_sentence(spans: Column, index: Column | int) -> Column:
    return F.coalesce(F.get(spans, index if isinstance(index, Column) else F.lit(index))["text"], F.lit(""))


def context_window(c: Column, spans: Column, index: Column, radius: int = 1) -> Column:
    """The sentences around one, joined by spaces; the stripped text if there are none."""
    first = F.greatest(index - radius, F.lit(0))
    count = F.greatest(F.least(index + radius + 1, F.size(spans)) - first, F.lit(0))
    joined = strip(F.array_join(F.transform(F.slice(spans, first + 1, count), lambda s: s["text"]), " "))
    return F.when(F.size(spans) == 0, strip(c)).otherwise(joined)


def changed_indices(a: Column, b: Column) -> Column:
    """Positions at which two span arrays' sentences differ."""
    n = F.greatest(F.size(a), F.size(b))
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.filter(places, lambda i: F.coalesce(F.get(a, i)["text"], F.lit("")) != F.coalesce(F.get(b, i)["text"], F.lit("")))


def replace_first(c: Column, target: Column, replacement: Column) -> Column:
    at = F.locate_column(target, c) if hasattr(F, "locate_column") else F.instr(c, target)
    whole = F.concat(F.substring(c, F.lit(1), at - 1), replacement, F.substring(c, at + F.length(target), F.length(c)))
    return F.when((F.length(target) > 0) & (at > 0), whole).otherwise(c)


def replace_all(c: Column, target: Column, replacement: Column) -> Column:
    return F.when(F.length(target) > 0, F.replace(c, target, replacement)).otherwise(c)


def splice(c: Column, start: Column, end: Column, new: Column) -> Column:
    """The text with [start, end) replaced; offsets count characters from 0."""
    return F.concat(F.substring(c, F.lit(1), start), new, F.substring(c, end + 1, F.length(c)))


def ensure_terminator(original: Column, new: Column, lexicon: Lexicon) -> Column:
    """``new`` with the original's last terminator if it has none itself."""
    last = F.regexp_extract(strip(original), f"[{lexicon.terminators}]$", 0)
    return F.when((last != "") & ~strip(new).rlike(f"[{lexicon.terminators}]$"), F.concat(strip(new), last)).otherwise(strip(new))


def clean_output(c: Column) -> Column:
    """A model's answer without code fences, quotes and white space around it."""
    bare = F.regexp_replace(F.regexp_replace(strip(c), r"^```[A-Za-z]*\n?", ""), r"\n?```$", "")
    return strip(F.regexp_replace(strip(bare), "^[\"'“”‘’`]+|[\"'“”‘’`]+$", ""))


def excerpt(c: Column, limit: int = 500) -> Column:
    flat = squeeze(c)
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.rtrim(F.substring(flat, 1, limit - 3)), F.lit("...")))


def first_difference(a: Column, b: Column, window: int = 40) -> Column:
    """struct<at, a, b>: first place where two texts differ (-1: none) and what stands around it in both.

    Found by halving the common prefix, so the work per row is the texts' length.
    """
    longest = F.least(F.length(a), F.length(b))
    half = lambda acc, _: F.when(
        acc["lo"] < acc["hi"],
        F.when(
            F.substring(a, F.lit(1), ((acc["lo"] + acc["hi"] + 1) / 2).cast("int")) == F.substring(b, F.lit(1), ((acc["lo"] + acc["hi"] + 1) / 2).cast("int")),
            F.struct(((acc["lo"] + acc["hi"] + 1) / 2).cast("int").alias("lo"), acc["hi"].alias("hi")),
        ).otherwise(F.struct(acc["lo"].alias("lo"), (((acc["lo"] + acc["hi"] + 1) / 2).cast("int") - 1).alias("hi"))),
    ).otherwise(acc)
    same = F.aggregate(F.sequence(F.lit(1), F.lit(31)), F.struct(F.lit(0).alias("lo"), longest.alias("hi")), half)["lo"]
    start = F.greatest(same - window, F.lit(0)) + 1
    return F.struct(
        F.when(a == b, -1).otherwise(same).alias("at"),
        F.substring(a, start, same + window + 1 - start).alias("a"),
        F.substring(b, start, same + window + 1 - start).alias("b"),
    )


def numbers(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(NUMBER), 0)


def normalize_digits(c: Column) -> Column:
    return F.translate(c, BANGLA_DIGITS, ASCII_DIGITS)


def bangla_digits(c: Column) -> Column:
    return F.translate(c, ASCII_DIGITS, BANGLA_DIGITS)


def digit_script(c: Column) -> Column:
    return F.when(c.rlike("[০-৯]"), "bn").when(c.rlike("[0-9]"), "en").otherwise("none")


def numeric(raw: Column, lexicon: Lexicon) -> Column:
    """A number's value; a comma is a decimal point, as is the lexicon's word for it; null if it is none."""
    out = F.replace(F.replace(normalize_digits(raw), F.lit(" "), F.lit("")), F.lit(","), F.lit("."))
    if lexicon.point_word:
        out = F.regexp_replace(out, f"{SPACE}*{lexicon.point_word}{SPACE}*", ".")
    return F.try_cast(out, "double") if hasattr(F, "try_cast") else out.try_cast("double")


def scaled_values(c: Column, lexicon: Lexicon) -> Column:
    """Values of the text's numbers, times the scale word that follows each."""
    digits = "[0-9০-৯]+"
    number = f"{digits}(?:[.,]{digits})?"
    if lexicon.point_word:
        number = f"{digits}{SPACE}+{lexicon.point_word}{SPACE}+{digits}|{number}"
    units = [*lexicon.scales, *lexicon.other_units, *lexicon.hundred_suffixes]
    pattern = f"({number}){SPACE}*({'|'.join(units)})?"
    pair = F.arrays_zip(F.regexp_extract_all(c, F.lit(pattern), 1).alias("raw"), F.regexp_extract_all(c, F.lit(pattern), 2).alias("unit"))

    def value(p):
        factor = F.lit(1.0)
        for unit, scale in [*lexicon.scales.items(), *((u, 100) for u in lexicon.hundred_suffixes)]:
            factor = F.when(p["unit"] == unit, float(scale)).otherwise(factor)
        return numeric(p["raw"], lexicon) * factor

    return F.filter(F.transform(pair, value), lambda v: v.isNotNull())


def unit_profile(c: Column, lexicon: Lexicon) -> Column:
    """struct of flags: what kinds of number stand in the text."""
    none = F.lit(False)
    money = c.rlike(lexicon.money) if lexicon.money else none
    scale = c.rlike("|".join(lexicon.scales)) if lexicon.scales else none
    count = (c.rlike(lexicon.count) if lexicon.count else none) & ~money
    return F.struct(
        c.rlike("[0-9০-৯]").alias("has_numeric"), money.alias("money"), c.rlike(lexicon.percent).alias("percent"), count.alias("count"), scale.alias("scale"), (money & ~scale).alias("bare_money")
    )


def _factor(a: Column, b: Column) -> Column:
    return F.abs(b / F.nullif(a, F.lit(0.0)))


def significant_scale_change(a: Column, b: Column, factor: float = 5.0) -> Column:
    """Whether the first value of array b is more than ``factor`` times away from a's."""
    x, y = F.get(a, F.lit(0)), F.get(b, F.lit(0))
    ratio = _factor(x, y)
    far = F.when(x == y, False).when(x == 0, y != 0).otherwise((ratio > factor) | (ratio < 1 / factor))
    return F.coalesce(far, F.lit(False))


def significant_count_change(a_text: Column, b_text: Column, lexicon: Lexicon, factor: float = 2.0) -> Column:
    """The same with inclusive bounds, for counted things only."""
    pa, pb = unit_profile(a_text, lexicon), unit_profile(b_text, lexicon)
    x, y = F.get(scaled_values(a_text, lexicon), F.lit(0)), F.get(scaled_values(b_text, lexicon), F.lit(0))
    ratio = _factor(x, y)
    far = F.when(x == y, False).when(x == 0, y != 0).otherwise((ratio >= factor) | (ratio <= 1 / factor))
    return pa["count"] & ~pb["money"] & ~pb["percent"] & F.coalesce(far, F.lit(False))


def unit_mismatch(target: Column, replacement: Column, lexicon: Lexicon) -> Column:
    """Why two spans' units do not go together, or null."""
    t, r = unit_profile(target, lexicon), unit_profile(replacement, lexicon)
    return F.when(
        t["has_numeric"] & r["has_numeric"],
        F.when(t["count"] & ~t["money"] & r["percent"], "numeric_unit_mismatch_count_percentage")
        .when(r["percent"] & r["scale"], "numeric_unit_mismatch_scaled_percentage")
        .when(t["percent"] != r["percent"], "numeric_unit_mismatch_percent")
        .when(t["money"] != r["money"], "numeric_unit_mismatch_money"),
    )


def dates(c: Column, lexicon: Lexicon) -> Column:
    return F.regexp_extract_all(c, F.lit(lexicon.dates), 0)


def is_temporal(c: Column, lexicon: Lexicon) -> Column:
    return contains_any(c, lexicon.temporal) | c.rlike("(?:[1১][9৯]|[2২][0০])[0-9০-৯]{2}") | c.rlike(lexicon.dates)


def term_hits(c: Column, terms: Iterable[str]) -> Column:
    """The contained terms by first position, then by spelling."""
    terms = tuple(dict.fromkeys(terms))
    hits = F.array(*[F.struct(F.locate(t, c).alias("pos"), F.lit(t).alias("term")) for t in terms])
    placed = F.transform(F.array_sort(F.filter(hits, lambda h: h["pos"] > 0)), lambda h: h["term"])
    return F.when(contains_any(c, terms), placed).otherwise(F.array().cast("array<string>"))  # most sentences have none


def known_inside(c: Column, lexicon: Lexicon) -> Column:
    """The longest known entity inside, ties to the first by spelling; null if none."""
    found = F.array(*[F.struct(F.lit(-len(t)).alias("n"), F.lit(t).alias("term")) for t in lexicon.entities])
    return F.get(F.array_sort(F.filter(found, lambda h: F.contains(c, h["term"]))), F.lit(0))["term"]


def entities(c: Column, lexicon: Lexicon) -> Column:
    """Known entities, and organisation names that end in one of the lexicon's words, by position."""
    known = term_hits(c, lexicon.entities)
    if not lexicon.organisations:
        return known
    name = rf"(?:[{lexicon.letters}A-Za-z&().\-]+{SPACE}+){{0,5}}(?:{lexicon.organisations})"

    def clean(x):
        flat = F.regexp_replace(squeeze(F.regexp_replace(x, r"^[ :;,.।()\[\]{}]+|[ :;,.।()\[\]{}]+$", "")), "^[ :;,.।]+|[ :;,.।]+$", "")
        return F.coalesce(known_inside(flat, lexicon), flat)

    def plausible(x):
        token = words(x)
        return (
            (F.length(x) >= 4)
            & ~x.rlike("^[0-9০-৯]")
            & ~x.rlike("^[া-ৌ্]")
            & ~x.isin(*(lexicon.generic_candidates or ("",)))
            & ~F.get(token, F.lit(0)).isin(*(lexicon.generic_prefixes or ("",)))
            & ((F.size(token) > 1) | x.isin(*lexicon.entities))
            & (~x.rlike(r"[()]") | x.isin(*lexicon.entities))
        )

    found = F.filter(F.transform(F.regexp_extract_all(c, F.lit(name), 0), clean), plausible)
    placed = F.transform(F.array_distinct(F.concat(known, found)), lambda t: F.struct(F.instr(c, t).alias("pos"), t.alias("term")))
    return F.transform(F.array_sort(placed), lambda h: h["term"])


def entity_role(c: Column, lexicon: Lexicon) -> Column:
    """The first role that has the entity, spaces aside; null if none."""
    compact = F.replace(c, F.lit(" "), F.lit(""))
    out = F.lit(None).cast("string")
    for role, terms in reversed(lexicon.roles.items()):
        out = F.when(compact.isin(*{t.replace(" ", "") for t in terms}), role).otherwise(out)
    return out


def same_role(a: Column, b: Column, lexicon: Lexicon) -> Column:
    return F.coalesce(entity_role(a, lexicon) == entity_role(b, lexicon), F.lit(False))


def occurs_as_term(c: Column, span: Column, lexicon: Lexicon) -> Column:
    """Whether the span stands in the text with no letter or digit at either side, or as a word; digits of either script."""

    def once(text, term):
        edge = f"[{lexicon.letters}0-9০-৯]"
        quoted = F.concat(F.lit(r"\Q"), F.replace(term, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
        return F.regexp_like(text, F.concat(F.lit(f"(?<!{edge})"), quoted, F.lit(f"(?!{edge})"))) | F.array_contains(words(text), term)

    term = strip(span)
    return (term != "") & (once(c, term) | once(normalize_digits(c), normalize_digits(term)))


def directions(c: Column, names: dict[str, tuple[str, ...]]) -> Column:
    return F.array_join(F.filter(F.array(*[F.when(contains_any(c, terms), name) for name, terms in names.items()]), lambda x: x.isNotNull()), "|")


def effect_clause(c: Column, lexicon: Lexicon) -> Column:
    """What follows the first causal term; the whole text if there is none."""
    hits = F.array(*[F.struct(F.locate(t, c).alias("pos"), F.lit(t).alias("term")) for t in lexicon.causal])
    first = F.get(F.array_sort(F.filter(hits, lambda h: h["pos"] > 0)), F.lit(0))
    return F.when(first.isNull(), c).otherwise(F.substring(c, first["pos"] + F.length(first["term"]), F.length(c)))


def artifacts(c: Column, lexicon: Lexicon) -> Column:
    """Ordered reasons why a text looks damaged."""
    letters = f"[{lexicon.letters}]"
    rules = [F.when(c.contains("�"), "replacement_character")]
    if lexicon.name == "bn":
        rules.append(F.when(c.rlike(letters + r"{1,2}্(?:\s|$)"), "dangling_halant_fragment"))
        rules.append(F.when(contains_any(c, lexicon.suspicious), "suspicious_bangla_fragment"))
        rules.append(F.when(c.rlike(f"(?<!{letters})কনসা(?!{letters})"), "suspicious_bangla_fragment"))
    rules.append(F.when(c.rlike(rf"({letters}{{3,}}(?:\s+{letters}{{3,}}){{0,2}})\s+\1"), "repeated_bangla_fragment" if lexicon.name == "bn" else "repeated_fragment"))
    return F.filter(F.array(*rules), lambda x: x.isNotNull())


def repeated_character(c: Column, times: int) -> Column:
    """Whether a character other than a line feed stands ``times`` times in a row."""
    return c.rlike(rf"(.)\1{{{times - 1},}}")


def sample_id(article: Column, index: Column, family: Column, seed: Column) -> Column:
    return F.concat(F.lit("rw_"), F.substring(F.sha1(F.concat_ws(":", article.cast("string"), index.cast("string"), family, seed.cast("string")).cast("binary")), 1, 16))


def human_bytes(c: Column) -> Column:
    """A size with its unit, one decimal from KB on."""
    size, out = c.cast("double"), None
    for k, unit in enumerate(("TB", "GB", "MB", "KB")):
        least = 1024.0 ** (4 - k)
        text = F.concat(F.format_string("%.1f", size / least), F.lit(f" {unit}"))
        out = F.when(size >= least, text) if out is None else out.when(size >= least, text)
    return out.otherwise(F.concat(size.cast("long").cast("string"), F.lit(" B")))


def ngrams(c: Column, n: int) -> Column:
    """Distinct character n-grams."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(f"(?s)(?=(.{{{n}}}))."), 1))  # one pass; substring() counts from the text's start each time


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if both are empty."""

    def share(own: Column) -> Column:
        common = F.array_size(F.array_intersect(own["a"], own["b"]))
        return F.coalesce(F.try_divide(common, F.array_size(F.array_union(own["a"], own["b"]))), F.lit(0.0))

    return let(F.struct(a.alias("a"), b.alias("b")), share)


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double; 0 if a vector is zero, null if lengths differ or are 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), F.when(norm > 0, dot(a, b) / norm).otherwise(0.0))


def utc_timestamp() -> Column:
    """Now, as ISO 8601 text in UTC; the same for all rows of a query."""
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
