"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text is cut at ends of lines, longer paragraphs after every PARAGRAPH code points. A paragraph's digest is a 60-bit
number from the MD5 of its bytes and of the times that the text holds it. Each digest counts in one cell of each of
three subtables; a cell holds a count and the XORs of its digests and of their checks. Cells of two versions are
subtracted and peeled: a cell with one digest left gives it away, which empties cells elsewhere. Where cells stay
full, the pair is tried again with four times the cells.

All is done with built-in functions. One shuffle brings texts together by document, another brings each document
the beginning of the following one; sketches and peeling stay in that stage, as cells are grouped by the same key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

#: Code points of a paragraph at most.
PARAGRAPH = 80
#: Cells of a subtable of the fingerprint that is returned, and of the smallest sketch that is peeled.
BASE = 8
#: Rounds over the three subtables in each try.
SWEEPS = 4
#: Tries, each with four times the cells of the one before.
TRIES = 16

_KEY = ["_i", "_h"]
#: Moduli of the check of a digest, primes below 2^31.
_P, _Q = 2147483629, 2147483587
_SLICE = 20


def _hash(c) -> Column:
    return F.conv(F.substring(F.md5(c), 1, 15), 16, 10).cast("long")


def with_digests(rows: DataFrame, text: str, name: str) -> DataFrame:
    """rows with ``name``: the sorted digests of the different paragraphs of ``text`` (null: empty)."""
    pieces = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"[^\n]{{1,{PARAGRAPH}}}"), F.lit(0))
    rows = rows.withColumn("_all", F.sort_array(F.transform(pieces, _hash)))
    # where runs of equal hashes begin
    begins = F.transform("_all", lambda x, i: F.when((i == 0) | (F.get("_all", i - 1) != x), i))
    rows = rows.withColumn("_begins", F.filter(begins, lambda i: i.isNotNull()))

    def digest(i: Column, k: Column) -> Column:
        times = F.coalesce(F.get("_begins", k + 1), F.size("_all")) - i
        one = F.get("_all", i)
        return F.when(times == 1, one).otherwise(_hash(F.concat(one.cast("string"), F.lit(":"), times.cast("string"))))

    return rows.withColumn(name, F.transform("_begins", digest)).drop("_all", "_begins")


def _check(d: Column) -> Column:
    return (d % _P) * (d % _Q)


def _place(d: Column, j: int, size: Column) -> Column:
    """The digest's cell in subtable j of ``size`` cells, a power of two."""
    part = F.when(size <= 1 << _SLICE, F.shiftright(d, _SLICE * j).bitwiseAND((size - 1).cast("long"))).otherwise(F.pmod(F.xxhash64(d, F.lit(j)), size.cast("long")))
    return (part + size.cast("long") * j).cast("int")


def fingerprint(digests: str) -> Column:
    """The sketch of BASE cells a subtable as text: in order, each filled cell's number, count and XOR of digests."""
    low = F.lit(BASE - 1).cast("long")

    def cell(c: Column) -> Column:
        j, at = (c / BASE).cast("int"), F.pmod(c, F.lit(BASE))
        own = F.filter(digests, lambda d: F.call_function("shiftright", d, j * _SLICE).bitwiseAND(low) == at)
        key = F.aggregate(own, F.lit(0).cast("long"), lambda s, d: s.bitwiseXOR(d))
        return F.when(F.size(own) > 0, F.concat(c.cast("string"), F.lit("."), F.size(own).cast("string"), F.lit("."), F.hex(key)))

    cells = F.transform(F.sequence(F.lit(0), F.lit(3 * BASE - 1)), cell)
    return F.concat(F.size(digests).cast("string"), F.lit(":"), F.array_join(cells, ","))


def _size(x: str, y: str) -> Column:
    most = F.greatest(F.size(x), F.size(y))
    return F.greatest(F.lit(BASE), F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(F.lit(1.0), most * 2 / 3))))).cast("int")


def _cells(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """The subtracted cells of pairs(keys, size, x, y): x counts as 1, y as -1."""
    signed = F.concat(F.transform("x", lambda d: F.struct(d.alias("d"), F.lit(1).alias("n"))), F.transform("y", lambda d: F.struct(d.alias("d"), F.lit(-1).alias("n"))))
    each = pairs.select(*keys, "size", F.inline(signed))
    size = F.col("size")
    rows = each.select(*keys, "size", F.explode(F.array(*(_place(F.col("d"), j, size) for j in range(3)))).alias("cell"), "n", "d", _check(F.col("d")).alias("c"), F.lit(None).cast("long").alias("found"))
    return _summed(rows, keys)


def _summed(rows: DataFrame, keys: list[str]) -> DataFrame:
    sums = rows.groupBy(*keys, "size", "cell", "found").agg(F.sum("n").cast("int").alias("n"), F.bit_xor("d").alias("d"), F.bit_xor("c").alias("c"))
    return sums.where("cell < 0 or n <> 0 or d <> 0")


def _row(*values) -> Column:
    return F.struct(*(v.alias(x) for v, x in zip(values, ("cell", "n", "d", "c", "found"), strict=True)))


def _peeled(cells: DataFrame, keys: list[str], recover: bool) -> DataFrame:
    """cells after SWEEPS rounds. Digests that came free are counted in cell -1, by digest in ``found`` if they are to be recovered (n is then 1 for those of x, -1 for those of y)."""
    for step in range(3 * SWEEPS):
        # a digest has one cell in each subtable, so none comes free twice in a step
        j = step % 3
        size, cell, n, d, c = (F.col(x) for x in ("size", "cell", "n", "d", "c"))
        free = (F.abs(n) == 1) & (cell >= size * j) & (cell < size * (j + 1)) & (_check(d) == c) & (_place(d, j, size) == cell)
        nothing, zero = F.lit(None).cast("long"), F.lit(0).cast("long")
        gone = [_row(_place(d, k, size), -n, d, c, nothing) for k in range(3) if k != j]
        freed = _row(F.lit(-1), n if recover else F.lit(1), zero, zero, d if recover else nothing)
        out = F.when(free, F.array(*gone, freed)).otherwise(F.array(_row(cell, n, d, c, F.col("found"))))
        cells = _summed(cells.select(*keys, "size", F.inline(out)), keys)
    return cells


def likeness(shared_from: Column, differing: Column) -> Column:
    """Jaccard likeness of two sets from the sum of their sizes and the number of digests that only one has; 1 if both are empty."""
    return F.when(shared_from == 0, 1.0).otherwise((shared_from - differing) / (shared_from + differing))


def _retried(failed: DataFrame, keys: list[str], recover: bool) -> DataFrame:
    """The peeled rows (cell -1) of pairs(keys, size, x, y) whose peeling stuck at ``size``, with more cells."""
    done = None
    pairs = failed.withColumn("size", F.col("size") * 4)
    for _ in range(TRIES):
        # digests move, not cells: these are then grouped where they are made
        cells = written(_peeled(_cells(pairs.repartition(*keys), keys), keys, recover))
        stuck = cells.where("cell >= 0").select(*keys).distinct()
        own = cells.where("cell = -1").join(stuck, keys, "left_anti")
        done = own if done is None else done.union(own)
        if cells.where("cell >= 0").limit(1).count() == 0:
            return done
        pairs = written(pairs.join(stuck, keys, "left_semi").withColumn("size", F.col("size") * 4))
    raise RuntimeError(f"sketches could not be peeled in {TRIES} tries")


def differing(versions: DataFrame, key: str, old: str, new: str) -> DataFrame:
    """(key, digest, side) of each paragraph digest that only one of two texts has: side 1 if ``old`` has it, -1 if ``new``.

    versions(key, old, new): rows of one key with the same texts count once; null texts are empty; pairs alike give no row.
    """
    rows = versions.groupBy(F.col(key).alias("key"), F.coalesce(old, F.lit("")).alias("_old"), F.coalesce(new, F.lit("")).alias("_new")).agg(F.lit(1)).withColumn("_pair", F.xxhash64("_old", "_new"))
    pairs = with_digests(with_digests(rows, "_old", "x"), "_new", "y").withColumn("size", _size("x", "y")).select("key", "_pair", "size", "x", "y")
    # null keys take part as any other
    pairs = written(pairs.withColumn("_key", F.struct(F.col("key").isNull().alias("none"), F.coalesce(F.hash("key"), F.lit(0)).alias("h"), F.col("key").cast("string").alias("s")).cast("string")))
    keys = ["_key", "_pair"]
    names = pairs.select("_key", "key").distinct()
    found = _retried(pairs.withColumn("size", (F.col("size") / 4).cast("int")), keys, True)
    return found.join(names, "_key").select(F.col("key").alias(key), F.col("found").alias("digest"), F.col("n").alias("side"))


def _following(docs: DataFrame) -> DataFrame:
    """(doc_id, _i, _h, n, copies, p_i, p_h, p_n): each different document, the times it occurs, and the document before it (before the first: the last), by doc_id, nulls first.

    Only ids move. They are sorted in ranges; a row's number is its range and its place there, and only the ends of ranges,
    one row each, are looked at together.
    """
    ids = docs.groupBy("doc_id", *_KEY, "n").agg(F.count(F.lit(1)).alias("copies"))
    ranked = written(ids.repartitionByRange(*_KEY).sortWithinPartitions(*_KEY).withColumn("_m", F.monotonically_increasing_id()))
    part = F.shiftright("_m", 33).alias("_part")
    ends = ranked.groupBy(part).agg(F.min("_m").alias("low"), F.max("_m").alias("high"))
    w = Window.orderBy("_part")
    ends = ends.select("_part", "high", F.coalesce(F.lead("low").over(w), F.min("low").over(Window.partitionBy())).alias("_next"))
    before = ranked.withColumn("_part", part).join(F.broadcast(ends), "_part")
    before = before.select(F.when(F.col("_m") == F.col("high"), F.col("_next")).otherwise(F.col("_m") + 1).alias("_m"), F.col("_i").alias("p_i"), F.col("_h").alias("p_h"), F.col("n").alias("p_n"))
    return written(ranked.join(before, "_m").drop("_m"))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of each row of docs(doc_id, text).

    A document's edited text has its last floor(n_chars / 2) code points replaced by the first as many (or all) of the next
    document, by ascending doc_id; the first follows the last. Null texts are empty, null doc_ids come first, and other columns are not read.
    Rows of one doc_id with different texts follow each other by a hash of the text; rows alike in both are one document,
    given once for each row. A single document is its own next one. The likeness of texts without a paragraph is 1.
    """
    text = F.coalesce("text", F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    docs = docs.withColumn("_i", F.coalesce("doc_id", F.lit(-(1 << 63)))).withColumn("_h", F.xxhash64("text", F.col("doc_id").isNull()))
    links = _following(docs.select("doc_id", *_KEY, F.length("text").alias("n")))
    # copies are given up before texts are shuffled; both uses share one shuffle
    texts = docs.groupBy(*_KEY).agg(F.first("text").alias("text"))
    own = texts.join(links.select("doc_id", *_KEY, "n", "copies"), _KEY)
    half = F.floor(F.col("n") / 2).cast("int")
    own = with_digests(own, "text", "a").select("doc_id", *_KEY, "n", "copies", F.expr("substring(text, 1, n - cast(floor(n / 2) as int))").alias("head"), half.alias("half"), "a")
    after = with_digests(texts.join(links.select(*_KEY, "p_i", "p_h", "p_n"), _KEY), "text", "b")
    after = after.select(F.col("p_i").alias("_i"), F.col("p_h").alias("_h"), F.expr("substring(text, 1, cast(floor(p_n / 2) as int))").alias("tail"), "b")
    both = own.join(after, _KEY).withColumn("edited", F.concat("head", "tail"))
    both = with_digests(both, "edited", "e")
    about = F.struct("doc_id", F.col("n").cast("long").alias("n_chars"), "copies", F.sha2("edited", 256).alias("edited_sha256"), fingerprint("a").alias("fingerprint"), fingerprint("e").alias("edited_fingerprint"), "a", "e", "b")
    pairs = both.select(
        *_KEY, about.alias("about"),
        F.array(F.struct(F.lit(0).alias("pair"), _size("a", "e").alias("size"), F.col("e").alias("y")), F.struct(F.lit(1).alias("pair"), _size("a", "b").alias("size"), F.col("b").alias("y"))).alias("p"),
    )
    # one row that only carries what is known goes along with the cells of a document
    no = lambda kind: F.lit(None).cast(kind)
    signed = F.flatten(
        F.transform("p", lambda p: F.flatten(F.array(
            F.transform(F.col("about.a"), lambda d: F.struct(p["pair"].alias("pair"), p["size"].alias("size"), d.alias("d"), F.lit(1).alias("n"))),
            F.transform(p["y"], lambda d: F.struct(p["pair"].alias("pair"), p["size"].alias("size"), d.alias("d"), F.lit(-1).alias("n"))),
        )))
    )
    none = F.array(F.struct(F.lit(-1).alias("pair"), F.lit(0).alias("size"), no("long").alias("d"), F.lit(0).alias("n")))
    each = pairs.select(*_KEY, "about", F.inline(F.concat(none, signed)))
    size, d = F.col("size"), F.col("d")
    carried = F.col("pair") < 0
    places = F.when(carried, F.array(F.lit(-2))).otherwise(F.array(*(_place(d, j, size) for j in range(3))))
    keys = [*_KEY, "pair", "about"]
    zero = F.lit(0).cast("long")
    rows = each.select(*_KEY, "pair", F.when(carried, F.col("about")).alias("about"), "size", F.explode(places).alias("cell"), "n", F.coalesce(d, zero).alias("d"), F.coalesce(_check(d), zero).alias("c"), no("long").alias("found"))
    cells = _peeled(_summed(rows, keys), keys, False)
    of = lambda k: [
        F.sum(F.when((F.col("pair") == k) & (F.col("cell") == -1), F.col("n")).otherwise(0)).alias(f"d{k}"),
        F.max(F.when((F.col("pair") == k) & (F.col("cell") >= 0), F.col("size"))).alias(f"stuck{k}"),
    ]
    done = cells.groupBy(*_KEY).agg(F.first("about", ignorenulls=True).alias("about"), *of(0), *of(1))
    stuck = F.col("stuck0").isNotNull() | F.col("stuck1").isNotNull()
    a, e, b = F.size("about.a"), F.size("about.e"), F.size("about.b")
    done = written(done.select(
        *_KEY, "stuck0", "stuck1", "d0", "d1", (a + e).alias("sum0"), (a + b).alias("sum1"), *(F.when(stuck, F.col(f"about.{x}")).alias(x) for x in "aeb"),
        "about.doc_id", "about.n_chars", "about.copies", "about.edited_sha256", "about.fingerprint", "about.edited_fingerprint",
    ))
    failed = done.where(stuck)
    again = failed.where("stuck0 is not null").select(*_KEY, F.lit(0).alias("pair"), F.col("stuck0").alias("size"), F.col("a").alias("x"), F.col("e").alias("y"))
    again = written(again.union(failed.where("stuck1 is not null").select(*_KEY, F.lit(1).alias("pair"), F.col("stuck1").alias("size"), F.col("a").alias("x"), F.col("b").alias("y"))))
    mended = _retried(again, [*_KEY, "pair"], False).groupBy(*_KEY).agg(*(F.max(F.when(F.col("pair") == k, F.col("n"))).alias(f"m{k}") for k in (0, 1)))
    # a document whose two stuck pairs turn out to be alike has no cell, so no row, to mend
    mended = failed.join(mended, _KEY, "left").select(*done.columns, *(F.when(F.col(f"stuck{k}").isNull(), F.col(f"d{k}")).otherwise(F.coalesce(f"m{k}", F.lit(0))).alias(f"r{k}") for k in (0, 1)))
    out = done.where(~stuck).withColumn("r0", F.col("d0")).withColumn("r1", F.col("d1")).unionByName(mended)
    # the rows of a document, in two steps, as an array of all may be too long
    out = out.withColumn("_few", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / 10000)))).withColumn("_one", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(10000), F.col("copies") - F.col("_few") * 10000))))
    return out.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("sum0"), F.col("r0")).alias("near_edited"), likeness(F.col("sum1"), F.col("r1")).alias("near_next"),
    )
