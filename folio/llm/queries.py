"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, packing
from .ann import neighbours
from .collocations import collocations
from .decontaminate import contamination
from .fingerprint import edited_fingerprints
from .licenses import licenses
from .lm import language_model
from .neardup import near_duplicates
from .pii import replace_pii
from .quality import quality
from .resampling import resampled
from .shared import written
from .toxicity import toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model(_table(spark, sf_dir, "documents"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.digests(bpe.round_trip(_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN))


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return neighbours(vectors, vectors.where("vec_id % 20 = 0").select("vec_id"), k=20)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses(_table(spark, sf_dir, "documents"))


#: Anyone who knows it can repeat the choice of surrogates; a deployment passes its own.
DEMO_KEY = b"folio demonstration key"


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_pii(_table(spark, sf_dir, "documents"), DEMO_KEY)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = _table(spark, sf_dir, "documents")
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    segments = bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, then=packing.segmenting())
    return packing.digests(written(packing.pack_segments(segments, tokens=size // 4)))


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(_table(spark, sf_dir, "documents"))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_ann": op1_ann,
    "op3_pii": op3_pii,
    "op5_lm_score": op5_lm_score,
    "op10_packing": op10_packing,
    "op2_license_scan": op2_license_scan,
    "op4_decontamination": op4_decontamination,
    "op7_quality": op7_quality,
    "op8_toxicity": op8_toxicity,
    "op6_near_dedup": op6_near_dedup,
    "op9_bpe": op9_bpe,
    "op11_fingerprints": op11_fingerprints,
    "op12_resampling": op12_resampling,
    "op13_collocations": op13_collocations,
}

_SHINGLES = r"""
words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS s
  FROM words
)"""

ORACLES = {
    "op6_near_dedup": rf"""
WITH RECURSIVE {_SHINGLES},
classes AS MATERIALIZED (SELECT min(doc_id) AS c, s FROM (SELECT doc_id, list_sort(s) AS s FROM sets) GROUP BY s HAVING len(s) > 0),
flat AS MATERIALIZED (SELECT c, len(s) AS n, unnest(s) AS g FROM classes),
pairs AS (SELECT a.c AS x, b.c AS y, any_value(a.n) + any_value(b.n) AS total, count(*) AS common
  FROM flat a JOIN flat b ON a.g = b.g AND a.c < b.c GROUP BY a.c, b.c),
links AS MATERIALIZED (SELECT x, y FROM pairs WHERE 100 * common >= 75 * (total - common)),
edges AS MATERIALIZED (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach AS (SELECT x AS v, x AS r FROM edges UNION SELECT e.y, reach.r FROM reach JOIN edges e ON e.x = reach.v),
comp AS (SELECT v, min(r) AS r FROM reach GROUP BY v),
labelled AS (SELECT s.doc_id, len(s.s) AS n, CASE WHEN len(s.s) = 0 THEN s.doc_id ELSE coalesce(m.r, k.c) END AS component_id
  FROM (SELECT doc_id, list_sort(s) AS s FROM sets) s LEFT JOIN classes k ON k.s = s.s LEFT JOIN comp m ON m.v = k.c)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM labelled
""",
    "op11_fingerprints": r"""
WITH following AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lead(coalesce(text, '')) OVER w, first_value(coalesce(text, '')) OVER w) AS nt FROM documents WINDOW w AS (ORDER BY doc_id)),
edited AS (SELECT doc_id, t, nt, length(t) AS n, substr(t, 1, length(t) - length(t) // 2) || substr(nt, 1, length(t) // 2) AS e FROM following),
pieces AS (
  SELECT doc_id, side, ('0x' || substr(md5(unnest(regexp_extract_all(x, '[^\n]{1,80}'))), 1, 15))::BIGINT AS h
  FROM (SELECT doc_id, unnest(['a', 'e', 'b']) AS side, unnest([t, e, nt]) AS x FROM edited)
),
digests AS MATERIALIZED (
  SELECT doc_id, side, CASE WHEN c = 1 THEN h ELSE ('0x' || substr(md5(h || ':' || c), 1, 15))::BIGINT END AS d
  FROM (SELECT doc_id, side, h, count(*) AS c FROM pieces GROUP BY ALL)
),
cells AS (SELECT doc_id, side, cell, count(*) AS c, bit_xor(d) AS k FROM (SELECT doc_id, side, d, j * 8 + ((d >> (20 * j)) & 7) AS cell FROM digests, (SELECT unnest([0, 1, 2]) AS j)) GROUP BY ALL),
sketches AS (SELECT doc_id, side, string_agg(cell || '.' || c || '.' || to_hex(k), ',' ORDER BY cell) AS s FROM cells GROUP BY ALL),
sizes AS (SELECT doc_id, side, count(*) AS n FROM digests GROUP BY ALL),
common AS (SELECT x.doc_id, y.side, count(*) AS n FROM digests x JOIN digests y ON x.doc_id = y.doc_id AND x.d = y.d AND x.side = 'a' AND y.side <> 'a' GROUP BY ALL),
f AS (SELECT v.doc_id, v.n, sha256(e) AS h, coalesce(za.n, 0) AS na, coalesce(ze.n, 0) AS ne, coalesce(zb.n, 0) AS nb, coalesce(sa.s, '') AS a, coalesce(se.s, '') AS e, coalesce(ce.n, 0) AS ce, coalesce(cb.n, 0) AS cb
  FROM edited v
  LEFT JOIN sizes za ON za.doc_id = v.doc_id AND za.side = 'a' LEFT JOIN sizes ze ON ze.doc_id = v.doc_id AND ze.side = 'e' LEFT JOIN sizes zb ON zb.doc_id = v.doc_id AND zb.side = 'b'
  LEFT JOIN sketches sa ON sa.doc_id = v.doc_id AND sa.side = 'a' LEFT JOIN sketches se ON se.doc_id = v.doc_id AND se.side = 'e'
  LEFT JOIN common ce ON ce.doc_id = v.doc_id AND ce.side = 'e' LEFT JOIN common cb ON cb.doc_id = v.doc_id AND cb.side = 'b')
SELECT doc_id, n AS n_chars, h AS edited_sha256, na || ':' || a AS fingerprint, ne || ':' || e AS edited_fingerprint,
  CASE WHEN na + ne = 0 THEN 1 ELSE ce / (na + ne - ce) END AS near_edited, CASE WHEN na + nb = 0 THEN 1 ELSE cb / (na + nb - cb) END AS near_next
FROM f
""",
    "op12_resampling": r"""
WITH crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
words AS (
  SELECT side, doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w
  FROM (SELECT 0 AS side, doc_id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark)
),
different AS MATERIALIZED (SELECT DISTINCT w FROM words),
hashed AS MATERIALIZED (
  SELECT w, xor(list_reduce(list_prepend(4294967295, list_transform(range(strlen(w)), lambda i: ('0x' || substr(hex(encode(w)), 2 * i + 1, 2))::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM different, crc
),
counted AS (SELECT bucket, count(*) FILTER (side = 0) AS s, count(*) FILTER (side = 1) AS t FROM words JOIN hashed USING (w) GROUP BY bucket),
gain AS MATERIALIZED (SELECT bucket, CAST(floor(1000 * ln(((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE) / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE))) AS BIGINT) AS g FROM counted),
weighed AS (SELECT doc_id, count(*) AS n, CAST(sum(g) AS BIGINT) AS weight FROM words JOIN hashed USING (w) JOIN gain USING (bucket) WHERE side = 0 GROUP BY doc_id),
scored AS (
  SELECT d.doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM documents d LEFT JOIN weighed USING (doc_id)
),
placed AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS r, count(*) FILTER (n_features >= 20) OVER () AS total FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND r <= 10 * total // 100 THEN r END AS rank FROM placed
""",
    "op13_collocations": r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
sums AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM words GROUP BY lang),
runs AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM words, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE len(w) >= k),
known AS MATERIALIZED (SELECT lang, k AS size, phrase, count(*)::HUGEINT AS f FROM runs GROUP BY ALL HAVING count(*) >= 100),
candidates AS MATERIALIZED (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM known WHERE size >= 2),
inner_parts AS (
  SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS phrase, a
  FROM (SELECT *, unnest(range(1, size - k + 2)) AS i FROM (SELECT *, unnest(range(2, size)) AS k FROM candidates WHERE size >= 3))
),
holders AS (SELECT lang, phrase, max(a) AS held FROM inner_parts GROUP BY ALL),
kept AS (SELECT c.* FROM candidates c LEFT JOIN holders h USING (lang, phrase) WHERE held IS NULL OR 100 * held < 100 * a),
cuts AS (SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS p, array_to_string(w[k + 1:], ' ') AS q FROM (SELECT *, unnest(range(1, size)) AS k FROM kept)),
valued AS (SELECT c.lang, c.phrase, a, k, x.f AS l, y.f AS r, n, (1000 * a * n) // (x.f * y.f) AS score FROM cuts c JOIN known x ON x.lang = c.lang AND x.phrase = p JOIN known y ON y.lang = c.lang AND y.phrase = q JOIN sums s ON s.lang = c.lang),
weakest AS (SELECT * FROM valued QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM weakest) WHERE rank <= 2000
""",
}
