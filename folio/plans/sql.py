"""DuckDB SQL of the registered queries, put together from named common table expressions."""

from __future__ import annotations

import re

from ..functions import rules
from .tables import LANGS, QUESTION_WORDS

WS = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


#: Letters whose capital form is more than one sign, as Unicode's special casing has it (ß: SS); DuckDB's upper maps sign by sign.
_CAPITALS = {c: c.upper() for c in map(chr, (*range(0xD800), *range(0xE000, 0x110000))) if len(c.upper()) > 1}


def upper(x: str) -> str:
    """Spark's upper: the full capital forms."""
    known = ", ".join(q(c) for c in _CAPITALS)
    forms = ", ".join(q(c) for c in _CAPITALS.values())
    return f"array_to_string(list_transform(string_split({x}, ''), lambda c: coalesce(list_extract([{forms}], list_position([{known}], c)), upper(c))), '')"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def squeezed(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}+', ' ', 'g'))"


def count(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, '{pattern}'))"


def any_of(x: str, words) -> str:
    return "(" + " OR ".join(f"contains({x}, {q(w)})" for w in words) + ")"


def signal_count(x: str, words) -> str:
    return "(" + (" + ".join(f"CAST(contains({x}, {q(w)}) AS INT)" for w in words) or "0") + ")"


def words_between(x: str, pattern: str) -> str:
    """Count of a pattern that stands between signs other than word signs, without look-around: every other sign is doubled first."""
    doubled = f"regexp_replace(' ' || {x} || ' ', '([^\\p{{L}}\\p{{M}}\\p{{N}}_])', '\\1\\1', 'g')"
    return f"len(regexp_extract_all({doubled}, '[^\\p{{L}}\\p{{M}}\\p{{N}}_](?:{pattern})[^\\p{{L}}\\p{{M}}\\p{{N}}_]'))"


def clean(x: str) -> str:
    x = rf"regexp_replace({x}, '([A-Za-z])-{WS}*\n{WS}*([a-z])', '\1\2', 'g')"
    x = rf"regexp_replace({x}, '\)([0-9])', ') \1', 'g')"
    x = rf"regexp_replace({x}, '[ \t]+', ' ', 'g')"
    return strip(rf"regexp_replace({x}, '\n{{3,}}', chr(10) || chr(10), 'g')")


def cut(u: str, size: int = 900) -> str:
    blank = f"(length(substr(a.rest, 1, {size})) - position(' ' IN reverse(substr(a.rest, 1, {size}))))"
    at = f"(CASE WHEN contains(substr(a.rest, 1, {size}), ' ') AND {blank} >= {size // 2} THEN {blank} ELSE {size} END)"
    step = (
        f"lambda a, x: {{'rest': CASE WHEN length(a.rest) > {size} THEN {strip(f'substr(a.rest, {at} + 1)')} ELSE a.rest END, "
        f"'done': CASE WHEN length(a.rest) > {size} THEN list_append(a.done, {strip(f'substr(a.rest, 1, {at})')}) ELSE a.done END}}"
    )
    none = "{'rest': '', 'done': []::VARCHAR[]}"
    fold = f"list_reduce(list_prepend({{'rest': {u}, 'done': []::VARCHAR[]}}, list_transform(range(CAST(ceil(length({u}) / {size // 2}.0) AS BIGINT)), lambda i: {none})), {step})"
    return f"(CASE WHEN length({u}) <= {size} THEN [{u}] ELSE (SELECT list_filter(list_append(f.done, f.rest), lambda z: z <> '') FROM (SELECT {fold} AS f)) END)"


def units_of(c: str) -> str:
    return rf"list_filter(list_transform(string_split_regex(regexp_replace({c}, '([。！？.!?]){WS}+', '\1' || chr(10), 'g'), '\n+'), lambda u: {strip('u')}), lambda u: u <> '')"


def heading(u: str) -> str:
    return (
        rf"(length({u}) BETWEEN 1 AND 100 AND (regexp_matches({u}, '^(#{{1,6}}{WS}+|\p{{Nd}}+(\.\p{{Nd}}+)*([.、]|{WS})|第[一二三四五六七八九十]+[章节])') "
        rf"OR (regexp_matches({u}, '\p{{Lu}}') AND NOT regexp_matches({u}, '[\p{{Ll}}\p{{Lt}}]') AND len(string_split_regex({u}, '{WS}+')) < 12)))"
    )


def pairs(x: str, least: int) -> str:
    return f"flatten(list_transform(regexp_extract_all({x}, '[一-鿿]+'), lambda r: list_transform(range(1, greatest({least}, length(r) - 1) + 1), lambda i: substr(r, i, 2))))"


def tokens(x: str) -> str:
    return f"list_concat(regexp_extract_all(lower({x}), '[a-z0-9][a-z0-9_+.-]*'), {pairs(x, 1)})"


def terms(x: str) -> str:
    return f"list_distinct(list_concat(regexp_extract_all(lower({x}), '[a-z0-9_]{{2,}}'), {pairs(x, 0)}))"


def expanded(x: str) -> str:
    return strip(f"{x} || ' ' || concat_ws(' ', " + ", ".join(f"CASE WHEN {any_of(x, t)} THEN {q(w)} END" for t, w in rules.EXPANSIONS) + ")")


def intent(question: str, content: str, page: str, intents=rules.INTENTS) -> str:
    out = []
    for triggers, parts, first in intents:
        bonus = [f"CASE WHEN {page} = 1 THEN {first}::DOUBLE ELSE 0 END"]
        for groups, weight, cap in parts:
            hits = " + ".join(f"CAST({any_of(f'lower({content})', g)} AS INT)" for g in groups)
            bonus.append(f"least({cap}::DOUBLE, ({hits}) * {weight}::DOUBLE)")
        out.append(f"CASE WHEN {any_of(question, triggers)} THEN {' + '.join(bonus)} ELSE 0 END")
    return "(" + " + ".join(out) + ")"


def penalty(content: str, page: str) -> str:
    low = f"lower({content})"
    years = words_between(low, r"(?:19|20)\p{Nd}{2}")
    phrases = " + ".join(count(low, p) for p in rules.BIBLIOGRAPHY)
    return f"(CASE WHEN ({years} >= 5 AND ({phrases}) >= 2) OR starts_with(regexp_replace({low}, '^{WS}+', ''), 'references') THEN 0.75::DOUBLE WHEN {page} > 1 AND {years} >= 8 THEN 0.35::DOUBLE ELSE 0::DOUBLE END)"


def reduced(x: str) -> str:
    return f"regexp_replace(lower({x}), '[^a-z0-9一-鿿]', '', 'g')"


def name_bonus(question: str, name: str) -> str:
    stem = reduced(rf"regexp_replace({name}, '\.[^.]*$', '')")
    return f"(CASE WHEN length({stem}) >= 3 AND contains({reduced(question)}, {stem}) THEN 0.35::DOUBLE ELSE 0::DOUBLE END)"


def noise(x: str) -> str:
    c = squeezed(x)
    numbers = words_between(c, r"\p{Nd}+(?:\.\.\p{Nd}+)?")  # the dot is doubled too
    signs = count(c, "[∑∫√≈≠≤≥±×÷∞∂∇∈∉∪∩→←↔σλμθφψΩ]")
    marks = count(c, r"[^\p{L}\p{M}\p{N}_\s]")
    return f"(length({c}) >= 8 AND ({signs} >= 2 OR {numbers} >= 5 OR ({marks} / greatest(1, length({c})) > 0.24 AND {numbers} >= 2)))"


def display_split(x: str) -> str:
    return rf"list_transform(string_split(regexp_replace({squeezed(x)}, '([.!?。！？]){WS}+', '\1' || chr(10), 'g'), chr(10)), lambda s: {strip('s')})"


def display(x: str) -> str:
    kept = f"list_filter({display_split(x)}, lambda s: s <> '' AND NOT {noise('s')})"
    return f"(SELECT CASE WHEN len(k) > 0 THEN array_to_string(k, ' ') ELSE {q(rules.NOISE_FALLBACK)} END FROM (SELECT {kept} AS k))"


def workspace(x: str) -> str:
    return f"list_filter({display_split(x)}, lambda s: length(s) >= 30 AND NOT {noise('s')})"


def bm25_sum() -> str:
    return "ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / greatest(1.0::DOUBLE, avgdl)))"


def _case(words, key: str) -> str:
    return "CASE " + f"{key} % {len(words)} " + " ".join(f"WHEN {i} THEN {q(w)}" for i, w in enumerate(words)) + " END"


_CHUNKER = f"""
list_reduce(list_prepend({{'u': '', 'h': NULL::VARCHAR, 'sec': NULL::VARCHAR, 'buf': []::VARCHAR[], 'done': []::STRUCT(c VARCHAR, s VARCHAR)[]}},
  list_transform(units, lambda u: {{'u': u, 'h': CASE WHEN {heading('u')} THEN substr(regexp_replace(u, '^[# ]+', ''), 1, 500) END, 'sec': NULL::VARCHAR, 'buf': []::VARCHAR[], 'done': []::STRUCT(c VARCHAR, s VARCHAR)[]}})),
  lambda a, x: CASE WHEN len(a.buf) > 0 AND list_sum(list_transform(a.buf, lambda p: length(p) + 1)) + length(x.u) > 900
    THEN {{'u': '', 'h': NULL::VARCHAR, 'sec': coalesce(x.h, a.sec),
      'buf': list_append(list_filter(a.buf, lambda p, i: i = len(a.buf) OR list_sum(list_transform(a.buf[i:], lambda z: length(z) + 1)) - 1 <= 140), x.u),
      'done': list_append(a.done, {{'c': array_to_string(a.buf, chr(10)), 's': coalesce(x.h, a.sec)}})}}
    ELSE {{'u': '', 'h': NULL::VARCHAR, 'sec': coalesce(x.h, a.sec), 'buf': list_append(a.buf, x.u), 'done': a.done}} END)"""


def _chunked(source: str) -> str:
    return f"""SELECT doc_id, page_number, CAST(row_number() OVER w - 1 AS INT) AS chunk_index,
  coalesce(last_value(s IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY page_number, part ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '') AS section_path,
  CAST(greatest(1, length(content) // 3) AS INT) AS token_count, content
FROM (SELECT doc_id, page_number, part, parts[part].c AS content, parts[part].s AS s FROM (
  SELECT doc_id, page_number, parts, unnest(range(1, len(parts) + 1)) AS part FROM (
    SELECT doc_id, page_number, list_append(f.done, {{'c': array_to_string(f.buf, chr(10)), 's': f.sec}}) AS parts FROM (
      SELECT doc_id, page_number, {_CHUNKER} AS f FROM {source} WHERE len(units) > 0))))
WINDOW w AS (PARTITION BY doc_id ORDER BY page_number, part)"""


def _units(source: str, cleaned: bool = False) -> str:
    c = "text" if cleaned else clean("coalesce(text, '')")
    return f"""SELECT doc_id, page_number, flatten(list_transform(cutlist, lambda k: k.parts)) AS units FROM (
  SELECT doc_id, page_number, list(struct_pack(i := i, parts := {cut('u')}) ORDER BY i) AS cutlist FROM (
    SELECT doc_id, page_number, us[i] AS u, i FROM (SELECT doc_id, page_number, us, unnest(range(1, len(us) + 1)) AS i FROM (
      SELECT doc_id, page_number, {units_of(c)} AS us FROM {source}))) GROUP BY doc_id, page_number)"""


#: Words and signs between them, in turn.
_PARTS = r"'[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+'"


def repaired(source: str, columns: str) -> dict[str, str]:
    """Fused words of source(columns, text) split at least cost, with all words of the documents: best costs by position, then the way back."""
    # one step a letter: costs and where the last word begins, for each position; x carries the position
    last = "list_min(list_transform(range(greatest(0, x.b[1] - longest), x.b[1]), lambda j: {'v': s.c[j + 1] + coalesce(known[substr(run, j + 1, x.b[1] - j)], dearest * (x.b[1] - j)), 'j': j}))"
    costs = f"""list_reduce(list_prepend({{'c': [0::DOUBLE], 'b': [0::BIGINT]}}, list_transform(range(1, length(run) + 1), lambda i: {{'c': [0::DOUBLE], 'b': [i]}})),
  lambda s, x: {{'c': list_append(s.c, ({last}).v), 'b': list_append(s.b, ({last}).j)}})"""
    way = """list_reduce(list_prepend({'i': length(run)::BIGINT, 'parts': []::VARCHAR[]}, list_transform(range(length(run)), lambda k: {'i': 0::BIGINT, 'parts': []::VARCHAR[]})),
  lambda t, k: CASE WHEN t.i = 0 THEN t ELSE {'i': f.b[t.i + 1], 'parts': list_prepend(substr(run, f.b[t.i + 1] + 1, t.i - f.b[t.i + 1]), t.parts)} END)"""
    return {
        "dictionary": f"SELECT w AS word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, {_PARTS})) AS w FROM documents) WHERE regexp_full_match(w, '[a-z]{{1,17}}') GROUP BY w",
        "dictsum": "SELECT sum(n)::DOUBLE AS total, min(n) AS least, max(length(word)) AS longest FROM dictionary",
        "fusedword": f"SELECT DISTINCT w AS run FROM (SELECT unnest(regexp_extract_all(text, {_PARTS})) AS w FROM {source}) WHERE regexp_full_match(w, '[a-z]{{18,}}')",
        "fusedpart": "SELECT DISTINCT run, substr(run, i + 1, k) AS word FROM (SELECT run, i, unnest(range(1, longest + 1)) AS k FROM (SELECT run, unnest(range(length(run))) AS i, longest FROM fusedword CROSS JOIN dictsum)) WHERE i + k <= length(run)",
        "fusedknown": "SELECT run, map_from_entries(list((word, ln(total / n)))) AS known FROM fusedpart JOIN dictionary USING (word) CROSS JOIN dictsum GROUP BY run",
        "fusedbest": f"SELECT run, {costs} AS f FROM (SELECT w.run, coalesce(known, MAP {{}}::MAP(VARCHAR, DOUBLE)) AS known, longest, ln(total / least) + 10 AS dearest FROM fusedword w LEFT JOIN fusedknown k ON k.run = w.run CROSS JOIN dictsum)",
        "fusedsplit": f"SELECT run, array_to_string(({way}).parts, ' ') AS split FROM fusedbest",
        "fusedpiece": f"SELECT {columns}, pos, list_extract(ws, pos) AS w FROM (SELECT {columns}, ws, unnest(range(1, len(ws) + 1)) AS pos FROM (SELECT {columns}, regexp_extract_all(text, {_PARTS}) AS ws FROM {source} WHERE text IS NOT NULL))",
        "mended": f"SELECT {columns}, coalesce(m, '') AS text FROM (SELECT {columns} FROM {source} WHERE text IS NOT NULL) LEFT JOIN (SELECT {columns}, string_agg(coalesce(split, w), '' ORDER BY pos) AS m FROM fusedpiece LEFT JOIN fusedsplit ON run = w GROUP BY {columns}) USING ({columns})",
    }


CTES = {
    "docs": "SELECT doc_id, lang AS kb_id, 'doc_' || doc_id || '.txt' AS document_name, CASE WHEN doc_id % 17 = 0 THEN 'failed' ELSE 'ready' END AS status, make_timestamp((1704067200 + doc_id * 60) * 1000000) AS created_at FROM documents",
    "page": "SELECT doc_id, 1 AS page_number, text FROM documents",
    "turn": "SELECT conv_id AS doc_id, CAST(turn + 1 AS INT) AS page_number, text FROM conversations",
    "page_units": _units("page"),
    "turn_units": _units("turn"),
    "chunk0": _chunked("page_units"),
    "chunk": "SELECT k.*, k.doc_id * 100000 + k.chunk_index AS chunk_id, d.kb_id, d.document_name FROM chunk0 k JOIN docs d USING (doc_id)",
    "ask": f"SELECT item_id AS query_id, {_case(LANGS, 'item_id')} AS kb_id, {_case(QUESTION_WORDS, 'item_id')} || text AS question FROM benchmark",
    "asked": f"SELECT query_id, kb_id, unnest(list_distinct({tokens('question')})) AS token FROM ask",
    "listed": f"SELECT chunk_id, kb_id, toks, len(toks) AS dl FROM (SELECT chunk_id, kb_id, {tokens('section_path || chr(10) || content')} AS toks FROM chunk)",
    "totals": "SELECT kb_id, count(*) AS n, avg(dl) AS avgdl FROM listed GROUP BY kb_id",
    "postings": "SELECT chunk_id, kb_id, dl, token, count(*) AS tf FROM (SELECT chunk_id, kb_id, dl, unnest(toks) AS token FROM listed) GROUP BY ALL",
    "dfs": "SELECT kb_id, token, count(*) AS df FROM postings GROUP BY ALL",
    "bm25": f"SELECT query_id, chunk_id, sum({bm25_sum()}) AS bm25 FROM asked JOIN postings USING (kb_id, token) JOIN dfs USING (kb_id, token) JOIN totals USING (kb_id) GROUP BY ALL",
}


def with_ctes(body: str, **extra: str) -> str:
    """The body after those expressions that it needs, in order."""
    known = CTES | extra
    needed: list[str] = []

    def add(text: str, within: str = "") -> None:
        for name in known:
            if name not in needed and name != within and re.search(rf"(?:FROM|JOIN)\s+{name}\b", text):
                add_one(name)

    def add_one(name: str) -> None:
        if name not in needed:
            add(known[name], name)
            needed.append(name)

    add(body)
    head = ",\n".join(f"{n} AS MATERIALIZED ({known[n]})" for n in needed)
    return f"WITH {head}\n{body}" if head else body
