"""Surrogates for personal data.

Detected entities get replacements made from a keyed hash of the entity, so the
same entity has the same surrogate everywhere (coreference) and nobody without the key can
repeat the choice. Surrogates keep type and format: lengths, punctuation, letter case, check
digits, and for names gender and script. The gender of a given name is what the titles
before it say all over the corpus. Collisions are looked for over all
entities of the corpus: of entities with one surrogate, and of surrogates that are themselves an entity, all
but one draw again until none is left. From the GROWS-th draw on a surrogate is longer than its entity, by one sign more
every second time, so that no format runs out of surrogates.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small_batches, written
from .text import slices, text_buffer, tidied, with_columns

#: Entities that drew again are sent to every task up to this many; beyond it they are joined to their texts.
SENT = 100_000
#: Draws after which surrogates grow: forms of few signs at once, those of fixed length once many draws have failed.
GROWS = {"email": 2, "secret": 2, "phone": 6, "card": 6, "ssn": 6, "iban": 6}

_PATTERNS = (
    ("secret", re.compile(r"(?i)(?<![A-Za-z0-9])(?:password|passwd|pwd|passphrase|secret|token|api[_-]?key|access[_-]?key)[\"']?\s{0,3}[=:]\s{0,3}[\"']?([A-Za-z0-9_+/\-]{6,}={0,2})")),
    ("secret", re.compile(r"(?<![A-Za-z0-9])((?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,})(?![A-Za-z0-9])")),
    ("email", re.compile(r"(?<![A-Za-z0-9._%+\-])([A-Za-z0-9][A-Za-z0-9._%+\-]{0,63}@(?:[A-Za-z0-9](?:[A-Za-z0-9\-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,24})(?![A-Za-z0-9\-])")),
    ("iban", re.compile(r"(?<![A-Za-z0-9])([A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])")),
    ("ip6", re.compile(r"(?:(?<![\w.:])|(?<=[A-Za-z]:)(?=[0-9A-Fa-f]))((?:[0-9A-Fa-f]{0,4}:){2,7}(?:(?:\d{1,3}\.){3}\d{1,3}|[0-9A-Fa-f]{0,4}))(?![\w:])")),
    ("ip", re.compile(r"(?<![\w.])((?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d))(?![\w]|\.\d)")),
    ("ssn", re.compile(r"(?<![\w\-])(\d{3}-\d{2}-\d{4})(?![\w\-])")),
    ("card", re.compile(r"(?<![\w.])(\d{13,19}|\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5})(?![\w]|\.\d)")),
    ("phone", re.compile(r"(?<![\w.+])(\+\d{1,3}[ .\-]?\(?\d{1,4}\)?(?:[ .\-]?\d{2,4}){2,4}|\(\d{3}\) ?\d{3}[ .\-]\d{4}|\d{3}[.\- ]\d{3}[.\- ]\d{4})(?!\w)")),
)

#: Titles with their gender.
TITLES = {
    "Mr": "m", "Mister": "m", "Sir": "m", "Herr": "m", "Monsieur": "m", "Señor": "m", "Don": "m",
    "Mrs": "f", "Ms": "f", "Miss": "f", "Madam": "f", "Frau": "f", "Mme": "f", "Madame": "f", "Mlle": "f", "Señora": "f", "Doña": "f",
    "Dr": "n", "Prof": "n", "Господин": "m", "Госпожа": "f", "Κύριος": "m", "Κυρία": "f",
}
#: Titles that stand after a name, with their gender.
AFTER = {"先生": "m", "女士": "f", "小姐": "f", "教授": "n", "博士": "n"}
#: Given names of known gender, for names after a title that has none.
GIVEN = {
    "m": "John Peter Michael Hans Pierre Carlos Paul David Иван James Robert William Thomas George Jan Luis José Antonio Marco Karl Henri Louis Miguel Juan Владимир Сергей Γιώργος Νίκος".split(),
    "f": "Mary Anna Maria Sophie Carmen Julia Sarah Laura Анна Elizabeth Emma Olivia Susan Marie Claire Ingrid Greta Ana Isabel Elena Giulia Ольга Елена Μαρία Ελένη".split(),
}
#: Small words that may stand within a family name; they stay.
PARTICLES = "van von der den de del della di da dos du la le ter ten zu bin ibn al el".split()
#: Family names of one sign that a name before a title begins with.
FAMILY_SIGNS = "王李张刘陈杨赵黄周吴徐孙胡朱高林何郭马罗梁宋郑谢韩唐冯于董萧程曹袁邓许傅沈曾彭吕"
_GENDER = {name: g for g, names in GIVEN.items() for name in names}
_UPPER = r"[A-ZÀ-ÖØ-ÞА-ЯЁΑ-ΩΆΈΉΊΌΎΏ]"
_LOWER = r"[a-zß-öø-ÿа-яёα-ωάέήίόύώϊϋΐΰ]"
#: A part of a name: Green, O'Brien, McDonald, or in capitals.
_PART = rf"(?:[A-Za-zÀ-ÖØ-öø-ÿ]['’])?(?:{_UPPER}{_LOWER}+(?:{_UPPER}{_LOWER}+)?|{_UPPER}{{2,}})"
_WITHIN = rf"(?:(?:{'|'.join(PARTICLES)})[ ]){{0,3}}"
_NAME = re.compile(rf"(?<!\w)({'|'.join(TITLES)})\.?[ ]({_WITHIN}{_PART}(?:[ \-]{_WITHIN}(?!(?:{'|'.join(TITLES)})(?!\w)){_PART}){{0,2}})(?!\w)")
_PARTS = re.compile(rf"(?<!\w){_PART}(?!\w)")
_BEFORE = re.compile(rf"([{FAMILY_SIGNS}][一-鿿]{{0,2}}?)({'|'.join(AFTER)})")
_CAPITALISED = re.compile(rf"(?<!\w)(?:[A-Za-zÀ-ÖØ-öø-ÿ]['’])?{_UPPER}\w+")
_BEGINS = re.compile(r"(?:^|[.!?:\n]\s*)$")

#: Syllables from which surrogate names are built, by script, and endings by script and gender.
SYLLABLES = {"latin": "al an ber bro car dal den el fa ga han jor ka lin mar nel ol per ra sel ta ul ven wil".split(), "cyrillic": "ал бор вла гре дан ель зор кир лев мар нел оль пет рад сав тим".split(), "greek": "αλ βερ γα δαν ελ ζορ καλ λεν μαρ νικ ορ παν ρα σταυ τιμ φιλ".split(), "han": list("安宁康文明华国平志海云山川松竹梅兰石江河星月春秋冬夏东南西北")}
ENDINGS = {("latin", "m"): "o en us ert".split(), ("latin", "f"): "a ia ine elle".split(), ("latin", "n"): "er in is y".split(), ("cyrillic", "m"): "ан ей ор ил".split(), ("cyrillic", "f"): "а ия ина ана".split(), ("cyrillic", "n"): "ко ук их ич".split(), ("greek", "m"): "ος ης ας".split(), ("greek", "f"): "α η ια".split(), ("greek", "n"): "ου ακη ιδη".split()}

_MAY_HOLD = np.zeros(256, bool)
_MAY_HOLD[[ord(c) for c in "@0123456789=:"]] = True
#: Titles, and the beginnings of keys, which may hold letters only.
_SIGN_BYTES = re.compile(b"|".join(t.encode() for t in [*TITLES, *AFTER]) + rb"|AKIA|ASIA|gh[pousr]_|sk-[A-Za-z0-9]{20}")


def _address6(s: str) -> str | None:
    """The canonical form of an IPv6 address; none if it is not one, unspecified, or may as well be two names (a::b)."""
    try:
        address = ipaddress.IPv6Address(s)
    except ValueError:
        return None
    if not int(address) or not (re.search(r"\d", s) or len(re.findall(r"[^:]+", s)) > 2):
        return None
    return address.compressed


def _plain(name: str) -> str:
    return name.lower().replace("’", "'")


def _neighbour(text: str, at: int, side: int) -> str | None:
    """The capitalised word right before or after a place, one blank or hyphen apart, in small letters."""
    if side > 0:
        m = _CAPITALISED.match(text, at + 1) if text[at : at + 1] in (" ", "-") else None
        return _plain(m.group()) if m else None
    if at < 2 or text[at - 1] not in " -":
        return None
    begin = at - 1
    while begin and at - begin < 64 and (text[begin - 1].isalnum() or text[begin - 1] in "'’_"):
        begin -= 1
    m = _CAPITALISED.fullmatch(text, begin, at - 1)
    return _plain(m.group()) if m else None


def detect(text: str) -> list[tuple[int, int, str, str]]:
    """(begin, end, type, canonical form) of a text's entities, in order, none within another; earlier patterns win.

    A name that stands after a title is an entity wherever the text has it.
    """
    found: list[tuple[int, int, str, str]] = []
    taken = bytearray(len(text))

    def take(begin, end, kind, canonical):
        if not any(taken[begin:end]):
            taken[begin:end] = b"\x01" * (end - begin)
            found.append((begin, end, kind, canonical))

    for kind, pattern in _PATTERNS:
        for m in pattern.finditer(text):
            s = m.group(1)
            if kind == "ip6":
                if s.endswith(":") and not s.endswith("::"):
                    s = s[:-1]
                if canonical := _address6(s):
                    take(m.start(1), m.start(1) + len(s), "ip", canonical)
                continue
            if kind == "secret":
                canonical = s
            elif kind in ("email", "ip"):
                canonical = s.lower()
            else:
                canonical = re.sub(r"[^0-9A-Z]", "", s)
                if kind == "phone" and not 7 <= len(canonical) <= 15:
                    continue
                if kind == "phone" and len(canonical) == 11 and canonical[0] == "1":
                    canonical = canonical[1:]  # with or without the country's number, it is one phone
            take(m.start(1), m.end(1), kind, canonical)
    kinds: dict[str, list[str]] = {}
    forms: dict[str, set[str]] = {}
    for m in _NAME.finditer(text):
        parts = list(_PARTS.finditer(m.group(2)))
        gender = TITLES[m.group(1)]
        for i, p in enumerate(parts):
            # the last part is the family name: one for all genders, so that each mention of it agrees
            given = i < len(parts) - 1
            name = _plain(p.group())
            kind = "given_" + (gender if gender != "n" else _GENDER.get(p.group().capitalize(), "n")) if given else "family"
            take(m.start(2) + p.start(), m.start(2) + p.end(), kind, name)
            kinds.setdefault(name, []).append(kind)
            forms.setdefault(name, {name.capitalize(), name.upper()}).add(p.group().replace("’", "'"))
    for m in _BEFORE.finditer(text):
        # without word borders, the longest name that the title allows may begin too early: its family sign decides
        take(m.start(1), m.end(1), "family", m.group(1))
    if kinds:
        small: dict[str, bool] = {}
        for m in _CAPITALISED.finditer(text):
            begin, s = m.start(), m.group()
            if _plain(s) not in kinds and s[1:2] in ("'", "’"):
                begin, s = begin + 2, s[2:]  # l'Anna
            name = _plain(s)
            if name not in kinds or s.replace("’", "'") not in forms[name]:
                continue
            before, after = _neighbour(text, begin, -1), _neighbour(text, m.end(), 1)
            if before not in kinds and after not in kinds and _BEGINS.search(text, max(0, begin - 8), begin):
                # at the beginning of a sentence, a word that the text has in small letters too may be that word
                if name not in small:
                    small[name] = re.search(rf"(?<!\w){re.escape(name)}(?!\w)", text) is not None
                if small[name]:
                    continue
            kind = kinds[name][0]
            if "family" in kinds[name] and set(kinds[name]) != {"family"}:
                # both a given and a family name in this text: given where a family name follows
                given = after is not None and "family" in kinds.get(after, ())
                kind = next(k for k in kinds[name] if (k != "family") == given)
            take(begin, m.end(), kind, name)
    return sorted(found)


class _Draw:
    """Endless keyed choices for one entity and attempt."""

    def __init__(self, key: bytes, kind: str, canonical: str, attempt: int):
        self.seed, self.n, self.left = hmac.new(key, f"{kind}\x00{canonical}\x00{attempt}".encode(), hashlib.sha256).digest(), 0, b""

    def below(self, n: int) -> int:
        if len(self.left) < 4:
            self.left += hashlib.sha256(self.seed + self.n.to_bytes(4, "big")).digest()
            self.n += 1
        x, self.left = int.from_bytes(self.left[:4], "big"), self.left[4:]
        return x % n


_DIGITS, _SMALL = "0123456789", "abcdefghijklmnopqrstuvwxyz"


def _like(s: str, draw: _Draw, hexadecimal: bool = False) -> str:
    out = []
    for c in s:
        if hexadecimal:
            x = "0123456789abcdef"[draw.below(16)]
            out.append(x.upper() if c.isupper() else x)
        elif c.isdigit():
            out.append(_DIGITS[draw.below(10)])
        elif c.isalpha() and c.isascii():
            x = _SMALL[draw.below(26)]
            out.append(x.upper() if c.isupper() else x)
        else:
            out.append(c)
    return "".join(out)


def _luhn(digits: str) -> str:
    """The digits with the last one made right."""
    total = sum(d if i % 2 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(digits[:-1]))))
    return digits[:-1] + str(-total % 10)


def _is_luhn(digits: str) -> bool:
    return _luhn(digits) == digits


def surrogate(kind: str, canonical: str, key: bytes, attempt: int = 0) -> str:
    """The canonical form of an entity's surrogate."""
    draw = _Draw(key, kind, canonical, attempt)
    more = max(0, attempt - GROWS.get(kind, attempt) + 2) // 2 if attempt else 0
    if kind == "email":
        local, _, domain = canonical.partition("@")
        labels = domain.split(".")
        # the last two labels are reserved for documentation, so no mail reaches anybody
        return _like(local + "x" * more, draw) + "@" + ".".join([_like(x, draw) for x in labels[:-2]] + ["example", labels[-1] if labels[-1] in ("com", "net", "org") else "org"])
    if kind == "ip" and ":" in canonical:
        # the block that is reserved for documentation
        return ipaddress.IPv6Address((0x20010DB8 << 96) | sum(draw.below(1 << 16) << (16 * i) for i in range(6))).compressed
    if kind == "ip" and attempt > 8:
        return surrogate("ip", "::1", draw.seed)
    if kind == "ip":
        return f"10.{draw.below(256)}.{draw.below(256)}.{draw.below(256)}" if attempt < 3 else ".".join([str(1 + draw.below(223)), *(str(draw.below(256)) for _ in range(3))])
    if kind == "card":
        out = canonical[0] + _like(canonical[1:] + "0" * more, draw)
        return _luhn(out) if _is_luhn(canonical) else out
    if kind == "phone":
        keep = 1 if canonical[0] == "1" and len(canonical) == 11 else 0
        return canonical[:keep] + str(2 + draw.below(8)) + _like(canonical[keep + 1 :] + "0" * more, draw)
    if kind == "ssn":
        return "9" + _like(canonical[1:] + "0" * more, draw)
    if kind == "iban":
        body = canonical[:2] + "00" + _like(canonical[4:] + "0" * more, draw)
        number = int("".join(str(int(c, 36)) for c in body[4:] + body[:4]))
        return body[:2] + f"{98 - number % 97:02d}" + body[4:]
    if kind == "secret":
        prefix = re.match(r"AKIA|ASIA|gh[pousr]_|sk-|", canonical).group()
        rest = canonical[len(prefix) :]
        return prefix + _like(rest + ("0" if rest.isdigit() else "x") * more, draw, bool(re.fullmatch(r"(?=.*[a-fA-F])(?=.*\d)(?:[0-9a-f]+|[0-9A-F]+)", rest)))
    if re.match("[一-鿿]", canonical):
        signs = SYLLABLES["han"]
        return "".join(signs[draw.below(len(signs))] for _ in range(len(canonical) + attempt // 4))
    script = "cyrillic" if re.search("[а-яё]", canonical) else "greek" if re.search("[α-ω]", canonical) else "latin"
    syllables, endings = SYLLABLES[script], ENDINGS[script, kind[-1] if kind.startswith("given_") else "n"]
    count = 1 + draw.below(2) + attempt // 2  # longer names once the short ones are taken
    return "".join(syllables[draw.below(len(syllables))] for _ in range(count)) + endings[draw.below(len(endings))]


def rendered(kind: str, mention: str, canonical: str) -> str:
    """The canonical surrogate in the format of a mention."""
    if kind in ("card", "phone", "ssn", "iban"):
        digits = re.sub("[^0-9]", "", mention) if kind == "phone" else ""
        signs = iter("1" + canonical if len(digits) == 11 and digits[0] == "1" else canonical)
        return "".join(next(signs, "") if c.isdigit() or (c.isalpha() and c.isascii()) else c for c in mention) + "".join(signs)
    if (kind == "email" or kind == "ip" and ":" in canonical) and mention.isupper():
        return canonical.upper()
    if kind.startswith("given_") or kind == "family":
        return canonical.upper() if mention.isupper() else canonical.capitalize()
    return canonical


@lru_cache(maxsize=100_000)
def _first_draw(kind: str, canonical: str, key: bytes) -> str:
    return surrogate(kind, canonical, key)


def _suspects(column: pa.Array) -> np.ndarray:
    """Rows that may hold an entity: a title, or one of the signs that every pattern needs."""
    raw, at = text_buffer(column)
    sums = np.concatenate([[0], np.cumsum(_MAY_HOLD[raw])])
    out = sums[at[1:]] > sums[at[:-1]]
    for m in _SIGN_BYTES.finditer(raw.tobytes()):
        out[np.searchsorted(at, m.start(), "right") - 1] = True
    return out


_ENTITY = "doc_id long, text_hash long, type string, canonical string"


def _detector(batches):
    for batch in batches:
        for part in slices(batch):
            rows: list[tuple] = []
            for i in np.flatnonzero(_suspects(part.column("text"))).tolist():
                doc, mark = part.column("doc_id")[i].as_py(), part.column("text_hash")[i].as_py()
                rows += sorted({(doc, mark, kind, canonical) for _, _, kind, canonical in detect(part.column("text")[i].as_py())}, key=lambda r: r[2:])
            columns = list(zip(*rows)) or [[]] * 4
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds)], names=["doc_id", "text_hash", "type", "canonical"])


def _drawer(key: bytes):
    def draw(batches):
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("type", "canonical", "attempt")]
            out = [surrogate(k, c, key, a) for k, c, a in zip(*columns)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("type", "canonical", "attempt")), pa.array(out, pa.string())], names=["type", "canonical", "attempt", "surrogate"])

    return draw


_DRAWN = "type string, canonical string, attempt int, surrogate string"


def _pool(kind: str):
    """The entities among which a surrogate must be the only one: all names together, each other type by itself."""
    return F.when(F.col(kind).startswith("given_") | (F.col(kind) == "family"), "name").otherwise(F.col(kind)).alias("pool")


def resolved(entities: DataFrame) -> DataFrame:
    """(type, canonical, as_type): given names get one gender each, that of all titles before them; none if those disagree."""
    given = F.col("type").startswith("given_")
    seen = lambda kind: F.max((F.col("type") == kind).cast("int"))
    gender = entities.where(given).groupBy("canonical").agg((seen("given_m") - seen("given_f")).alias("gender"))
    one = entities.join(gender, "canonical", "left")
    as_type = F.when(~given, F.col("type")).when(F.col("gender") > 0, "given_m").when(F.col("gender") < 0, "given_f").otherwise("given_n")
    return one.select("type", "canonical", as_type.alias("as_type"))


def assign(entities: DataFrame, key: bytes) -> DataFrame:
    """(type, canonical, attempt, surrogate, moved) of distinct entities: no two of a pool share a surrogate, and none is another entity of it.

    A given name has one surrogate, whatever types it was found with; ``moved`` tells those whose surrogate is not the first draw of their type.
    """
    found = written(resolved(entities.select("type", "canonical").distinct()))
    entities = written(found.select(F.col("as_type").alias("type"), "canonical").distinct())
    real = entities.select(_pool("type"), F.col("canonical").alias("surrogate")).distinct()
    drawn = written(entities.withColumn("attempt", F.lit(0)).mapInArrow(_drawer(key), _DRAWN))
    attempt = 0
    while True:
        pooled = drawn.select("*", _pool("type"))
        owner = pooled.groupBy("pool", "surrogate").agg(F.min(F.struct("attempt", "canonical", "type")).alias("first"), F.count(F.lit(1)).alias("n"))
        # who drew earlier keeps it
        other = (F.col("canonical") != F.col("first.canonical")) | (F.col("type") != F.col("first.type"))
        shared = pooled.join(owner.where("n > 1"), ["pool", "surrogate"]).where(other).select("type", "canonical")
        lost = written(shared.union(pooled.join(real, ["pool", "surrogate"], "left_semi").select("type", "canonical")).distinct())
        if not lost.limit(1).count():
            break
        attempt += 1
        again = lost.withColumn("attempt", F.lit(attempt)).mapInArrow(_drawer(key), _DRAWN)
        drawn = written(drawn.join(lost, ["type", "canonical"], "left_anti").union(again))
    moved = ((F.col("attempt") > 0) | (F.col("type") != F.col("as_type"))).alias("moved")
    return found.join(drawn.withColumnRenamed("type", "as_type"), ["as_type", "canonical"]).select("type", "canonical", "attempt", "surrogate", moved)


_ENTITIES = "array<struct<type:string,begin:long,end:long,surrogate:string>>"
_SPANS = pa.list_(pa.struct([("type", pa.string()), ("begin", pa.int64()), ("end", pa.int64()), ("surrogate", pa.string())]))


def _replacer(key: bytes, sent):
    def replace(batches):
        again = sent.value if sent is not None else {}
        for batch in batches:
            for part in slices(batch):
                texts, spans = part.column("text").to_pylist(), [[] for _ in range(part.num_rows)]
                own = part.column("redrawn").to_pylist() if "redrawn" in part.schema.names else None
                for i in np.flatnonzero(_suspects(part.column("text"))).tolist():
                    other = {(r["type"], r["canonical"]): r["surrogate"] for r in own[i] or ()} if own else again
                    pieces, at, size = [], 0, 0
                    for begin, end, kind, canonical in detect(texts[i]):
                        name = other.get((kind, canonical)) or _first_draw(kind, canonical, key)
                        new = rendered(kind, texts[i][begin:end], name)
                        pieces += [texts[i][at:begin], new]
                        size += begin - at
                        spans[i].append({"type": kind, "begin": size, "end": size + len(new), "surrogate": new})
                        size, at = size + len(new), end
                    if pieces:
                        texts[i] = "".join(pieces) + texts[i][at:]
                yield with_columns(part, {"text": pa.array(texts, pa.string()), "entities": pa.array(spans, _SPANS)})

    return replace


def with_surrogates(docs: DataFrame, key: bytes, sent: int = SENT) -> DataFrame:
    """docs with surrogates in ``text`` and a column ``entities`` added; docs has doc_id and text, and no other column of that name.

    Two narrow passes over the texts, one to detect and one to replace; in between, only entities are shuffled.
    """
    spark = docs.sparkSession
    small_batches(spark)
    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("text_hash", F.xxhash64("text"))
    found = written(marked.mapInArrow(tidied(_detector), _ENTITY))
    drawn = assign(found, key)
    redrawn = written(drawn.where("moved")).select("type", "canonical", "surrogate")
    ready = docs.withColumn("entities", F.expr(f"cast(null as {_ENTITIES})"))
    if redrawn.limit(sent + 1).count() <= sent:
        again = {(r.type, r.canonical): r.surrogate for r in redrawn.collect()}
        return ready.mapInArrow(tidied(_replacer(key, spark.sparkContext.broadcast(again))), ready.schema)
    own = found.join(redrawn, ["type", "canonical"]).dropDuplicates(["doc_id", "text_hash", "type", "canonical"])
    own = own.groupBy(F.col("doc_id").alias("of_doc"), F.col("text_hash").alias("of_hash")).agg(F.collect_list(F.struct("type", "canonical", "surrogate")).alias("redrawn"))
    joined = ready.join(own, ready.doc_id.eqNullSafe(F.col("of_doc")) & (F.xxhash64(ready.text) == F.col("of_hash")), "left")
    joined = joined.select(*ready.columns, "redrawn")
    return joined.mapInArrow(tidied(_replacer(key, None)), joined.schema).select(*ready.columns)


def replace_pii(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text", sent: int = SENT) -> DataFrame:
    """(doc_id, text, n_entities, entities), one row for each row of docs: the text with surrogates, and their types and spans in it.

    Types: email, phone, ip, card, ssn, iban, secret, and names after a title (given_m, given_f, given_n: what the titles in
    this text say; family), there and wherever else the text has them. Null texts stay null and empty ones empty; null doc_ids stay null; repeated rows get equal results;
    further columns are ignored; an empty table gives no rows. Texts without entities come back unchanged.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return with_surrogates(docs, key, sent).select("doc_id", "text", F.size("entities").cast("long").alias("n_entities"), "entities")
