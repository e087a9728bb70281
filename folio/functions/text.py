"""Column functions on text: cleaning, units, headings, terms, query rules, display."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules

_BLANKS = ((0x9, 0xD), (0x1C, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000))


def _signs(ranges) -> str:
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in ranges) + "]"


#: White space as Unicode and Python have it, for Java's regular expressions; the same without the blank, and its signs.
WS = _signs(_BLANKS)
WS_OTHER = _signs(((0x1C, 0x1F) if r == (0x1C, 0x20) else r for r in _BLANKS))
WS_SIGNS = "".join(chr(x) for a, b in _BLANKS for x in range(a, b + 1))
CJK = r"[一-鿿]"
SENTENCE_SPLIT = rf"(?<=[.!?。！？]){WS}+"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    """The text without white space at both ends."""
    return F.btrim(col(c), F.lit(WS_SIGNS))


def squeezed(c) -> Column:
    """White space collapsed to single blanks, none at the ends."""
    # single blanks, most of what there is, stay without a match
    return F.trim(F.regexp_replace(col(c), f"{WS}{{2,}}|{WS_OTHER}", " "))


def clean_text(c) -> Column:
    """NULs to blanks, hyphenated line ends joined, a blank between ) and a digit, blanks and empty lines collapsed."""
    c = F.replace(col(c), F.lit("\x00"), F.lit(" "))
    # each pattern begins with a rare sign, and single blanks are no match
    c = F.regexp_replace(c, rf"-(?<=[A-Za-z]-){WS}*\n{WS}*(?=[a-z])", "")
    c = F.regexp_replace(c, r"\)(?=\p{Nd})", ") ")
    c = F.regexp_replace(c, r"[ \t]{2,}|\t", " ")
    return strip(F.regexp_replace(c, r"\n{3,}", "\n\n"))


def _cut(unit: Column, size: int) -> Column:
    """A unit in parts of at most size: cut at the last blank in its second half, else at size."""
    empty = F.array().cast("array<string>")

    def step(state, _):
        rest = state["rest"]
        head = F.substring(rest, 1, size)
        blank = F.length(head) - F.length(F.substring_index(head, " ", -1)) - 1
        at = F.when(F.contains(head, F.lit(" ")) & (blank >= size // 2), blank).otherwise(F.lit(size))
        long = F.length(rest) > size
        return F.struct(
            F.when(long, F.array_append(state["done"], strip(F.substr(rest, F.lit(1), at)))).otherwise(state["done"]).alias("done"),
            F.when(long, strip(F.substr(rest, at + 1))).otherwise(rest).alias("rest"),
        )

    steps = F.sequence(F.lit(1), F.ceil(F.length(unit) / F.lit(max(1, size // 2))).cast("int"))
    whole = F.aggregate(steps, F.struct(empty.alias("done"), unit.alias("rest")), step)
    return F.when(F.length(unit) <= size, F.array(unit)).otherwise(
        F.filter(F.array_append(whole["done"], whole["rest"]), lambda u: u != "")
    )


def split_units(c, size: int = 900) -> Column:
    """Units of a cleaned text: lines and sentences, trimmed, the over-long ones cut."""
    units = F.transform(F.split(col(c), rf"\n+|(?<=[。！？.!?]){WS}+"), strip)
    return F.flatten(F.transform(F.filter(units, lambda u: u != ""), lambda u: _cut(u, size)))


def is_heading(c) -> Column:
    """Markdown, numbered and chapter headings, and short all-capital lines, up to 100 signs."""
    c = strip(c)
    marked = c.rlike(rf"^(#{{1,6}}{WS}+|\p{{Nd}}+(\.\p{{Nd}}+)*([.、]|{WS})|第[一二三四五六七八九十]+[章节])")
    capital = c.rlike(r"\p{Lu}") & ~c.rlike(r"[\p{Ll}\p{Lt}]") & (F.size(F.split(c, f"{WS}+")) < 12)
    return (F.length(c) > 0) & (F.length(c) <= 100) & (marked | capital)


def heading_title(c) -> Column:
    return F.substring(F.regexp_replace(col(c), "^[# ]+", ""), 1, 500)


def token_estimate(c) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(col(c)) / 3)).cast("int")


def safe_filename(c) -> Column:
    """The last part of a path, signs other than word signs, dots and hyphens replaced."""
    return F.regexp_replace(F.substring_index(col(c), "/", -1), r"[^\p{L}\p{M}\p{N}_.\-]", "_")


def file_type(c) -> Column:
    """The last suffix, lower-cased, without its dot; empty if there is none."""
    return F.lower(F.regexp_extract(col(c), r"[^.]\.([^.]+)$", 1))


def _cjk_pairs(c: Column, least: int) -> Column:
    """All pairs of neighbours in runs of CJK signs; runs of one sign give themselves if ``least`` is 1."""
    runs = F.regexp_extract_all(c, F.lit(f"({CJK}+)"), 1)

    def pairs(run):
        last = F.greatest(F.lit(least), F.length(run) - 1)
        return F.when(last > 0, F.transform(F.sequence(F.lit(1), last), lambda i: F.substr(run, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))

    return F.flatten(F.transform(runs, pairs))


def terms(c) -> Column:
    """Distinct Latin words of two or more signs, and CJK pairs."""
    c = col(c)
    return F.array_distinct(F.concat(F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9_]{2,})"), 1), _cjk_pairs(c, 0)))


def tokens(c) -> Column:
    """Latin tokens and CJK pairs with repetitions; a single CJK sign counts."""
    c = col(c)
    return F.concat(F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9][a-z0-9_+.-]*)"), 1), _cjk_pairs(c, 1))


_LATIN, _CJK_RUN = re.compile("[a-z0-9][a-z0-9_+.-]*"), re.compile(f"{CJK}+")


def tokens_of(text: str | None) -> list[str]:
    """``tokens`` of one text."""
    out = _LATIN.findall(text.lower()) if text else []
    if text and not text.isascii():
        for run in _CJK_RUN.findall(text):
            out += [run[i : i + 2] for i in range(max(1, len(run) - 1))]
    return out


def lexical_score(query, content) -> Column:
    """Set cosine of the terms of a query and a content."""
    q, c = terms(query), terms(content)
    shared = F.size(F.array_intersect(q, c))
    return F.when(F.size(q) == 0, F.lit(0.0)).otherwise(shared / F.sqrt(F.size(q) * F.greatest(F.lit(1), F.size(c))))


def any_of(c, words) -> Column:
    """Whether one of the words occurs."""
    out = F.lit(False)
    for w in words:
        out = out | F.contains(col(c), F.lit(w))
    return out


def signal_count(lowered, signals) -> Column:
    """How many of the signals occur."""
    out = F.lit(0)
    for s in signals:
        out = out + F.contains(col(lowered), F.lit(s)).cast("int")
    return out


def expand_query(c, expansions=rules.EXPANSIONS) -> Column:
    """The question and the terms of each rule of which a trigger occurs."""
    c = col(c)
    added = F.array_compact(F.array(*(F.when(any_of(c, triggers), F.lit(words)) for triggers, words in expansions)))
    return strip(F.concat(c, F.lit(" "), F.array_join(added, " ")))


def intent_bonuses(content, page, intents=rules.INTENTS) -> Column:
    """The bonus of a content for each intent, as an array."""
    low, out = F.lower(col(content)), []
    for _, parts, first_page in intents:
        bonus = F.when(col(page) == 1, F.lit(float(first_page))).otherwise(F.lit(0.0))
        for groups, weight, cap in parts:
            hits = F.lit(0)
            for g in groups:
                hits = hits + any_of(low, g).cast("int")
            bonus = bonus + F.least(F.lit(float(cap)), hits * F.lit(float(weight)))
        out.append(bonus)
    return F.array(*out)


def intent_bonus(query, bonuses, intents=rules.INTENTS) -> Column:
    """The bonuses (``intent_bonuses`` of a content) of all intents that the question shows, added up."""
    out = F.lit(0.0)
    for i, (triggers, _, _) in enumerate(intents):
        out = out + F.when(any_of(query, triggers), F.get(col(bonuses), F.lit(i))).otherwise(F.lit(0.0))
    return out


def word_boundary(pattern: str) -> str:
    return rf"(?<![\p{{L}}\p{{M}}\p{{N}}_])(?:{pattern})(?![\p{{L}}\p{{M}}\p{{N}}_])"


def reference_penalty(content, page, phrases=rules.BIBLIOGRAPHY) -> Column:
    """0.75 for a bibliography, 0.35 for a later page with many years."""
    low = F.lower(col(content))
    years = F.regexp_count(low, F.lit(word_boundary(r"(?:19|20)\p{Nd}{2}")))
    count = F.lit(0)
    for p in phrases:
        count = count + F.regexp_count(low, F.lit(p.replace(".", r"\.")))
    return (
        F.when(((years >= 5) & (count >= 2)) | F.startswith(F.regexp_replace(low, f"^{WS}+", ""), F.lit("references")), F.lit(0.75))
        .when((col(page) > 1) & (years >= 8), F.lit(0.35)).otherwise(F.lit(0.0))
    )


def reduced(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"[^a-z0-9一-鿿]", "")


def filename_bonus(query, name, bonus: float = 0.35) -> Column:
    """A bonus if the question holds the document's name."""
    stem = reduced(F.regexp_replace(col(name), r"(?s)\.[^.]*$", ""))
    return F.when((F.length(stem) >= 3) & F.contains(reduced(col(query)), stem), F.lit(bonus)).otherwise(F.lit(0.0))


def _once(value: Column, make) -> Column:
    """make(value), the value worked out once for each row however often ``make`` takes it."""
    return F.get(F.transform(F.array(value), make), F.lit(0))


def is_display_noise(c) -> Column:
    """Rows of numbers, formulas and signs that readers need not see."""
    return _once(squeezed(c), _noise)


_FORMULA = "∑∫√≈≠≤≥±×÷∞∂∇∈∉∪∩→←↔σλμθφψΩ"
#: What any noise has: a digit or a formula's sign.
_SUSPECT = rf"[\p{{Nd}}{_FORMULA}]"


def _noise(c: Column) -> Column:
    """is_display_noise of a text whose white space is collapsed."""
    signs = F.regexp_count(c, F.lit(f"[{_FORMULA}]"))
    numbers = F.regexp_count(c, F.lit(word_boundary(r"\p{Nd}+(?:\.\p{Nd}+)?") + "%?"))
    marks = F.regexp_count(c, F.lit(r"[^\p{L}\p{M}\p{N}_\s]"))
    dense = (marks / F.greatest(F.lit(1), F.length(c)) > 0.24) & (numbers >= 2)
    return (F.length(c) >= 8) & c.rlike(_SUSPECT) & ((numbers >= 5) | (signs >= 2) | dense)


def _nonempty(sentences: Column) -> Column:
    return F.filter(F.transform(sentences, strip), lambda s: s != "")


def clean_display_text(c, fallback: str = rules.NOISE_FALLBACK) -> Column:
    """The sentences that are not noise, one blank apart; the fallback if none is left."""

    def shown(flat: Column) -> Column:
        kept = F.array_join(F.filter(_nonempty(F.split(flat, SENTENCE_SPLIT)), lambda s: ~_noise(s)), " ")
        # a text without digits and formulas has no noise: its sentences, one blank apart, are the text
        return F.when(flat.rlike(_SUSPECT), kept).otherwise(flat)

    return _once(_once(squeezed(c), shown), lambda s: F.when(s != "", s).otherwise(F.lit(fallback)))


def workspace_sentences(c) -> Column:
    """Sentences of 30 signs or more that are not noise."""
    return F.filter(F.transform(F.split(squeezed(c), SENTENCE_SPLIT), strip), lambda s: (F.length(s) >= 30) & ~_noise(s))


def summary_sentences(c) -> Column:
    """Sentences of 40 to 650 signs, also cut before capitals."""
    return F.filter(F.transform(F.split(squeezed(c), rf"(?<=[.!?]){WS}+|(?<=[.!?])(?=[A-Z])"), strip), lambda s: F.length(s).between(40, 650))


def excerpt_sentences(c) -> Column:
    """Sentences and paragraphs of 24 to 700 signs."""
    return F.filter(F.transform(F.split(col(c), rf"(?<=[。！？.!?]){WS}+|\n{{2,}}"), strip), lambda s: F.length(s).between(24, 700))


def reader_sentences(c) -> Column:
    """Runs that end in sentence enders, as the reader shows them."""
    # cut where an ender meets another sign; only the first part can have enders alone
    runs = F.filter(F.split(squeezed(c), r"(?<=[.!?。！？])(?![.!?。！？])"), lambda s: ~s.rlike("^[.!?。！？]"))
    return F.filter(F.transform(runs, strip), lambda s: F.length(s) > 1)
