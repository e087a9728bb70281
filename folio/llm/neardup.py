"""Near-duplicate components by HyperMinHash.

Each text's set of five-word shingles is kept as compressed registers: for each
of ``PERMUTATIONS`` hash functions, the count of leading zeros of the smallest
hash and its next mantissa bits. (A bucket belongs to one hash function, as in k-function
MinHash, so that short texts leave none empty.) Bands of registers are joined;
the estimate of Jaccard similarity, corrected for registers that agree by
chance, drops what is far off; full sets confirm every link.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import connected, small_batches, written
from .text import Words, mix, shingles, slices, tidied

SHINGLE = 5
PERMUTATIONS = 128
BAND = 4
MANTISSA_BITS = 10
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 75
#: A pair whose corrected estimate is lower than the limit by this many standard deviations is not verified.
DEVIATIONS = 5.0
#: Classes of a bucket against which all its classes are held first.
CENTRES = 2
#: Rows of one bucket that a residual task compares with each other, shingles of one component that it holds, and classes tried against those.
BLOCK = 2048
SET_BLOCK = 200_000
TRIED = 512
#: Parts into which the classes of a component are dealt where they meet something that belongs to the whole component.
SALTS = 16

_FACTORS = (mix(np.arange(1, PERMUTATIONS + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def registers(sets: np.ndarray) -> np.ndarray:
    """Registers of one set of 64-bit hashes: leading zeros above MANTISSA_BITS bits of the smallest hash, uint16."""
    low = np.full(PERMUTATIONS, 0xFFFFFFFF, np.uint32)
    half = (sets >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(half), 512):
        np.minimum(low, (half[i : i + 512, None] * _FACTORS[None, :]).min(0), out=low)
    value = low.astype(np.float64) + 1  # 1 .. 2**32
    exponent = np.minimum(np.floor(np.log2(value)).astype(np.int64), 31)
    mantissa = ((value / np.exp2(exponent) - 1) * (1 << MANTISSA_BITS)).astype(np.int64)
    mantissa = np.minimum(mantissa, (1 << MANTISSA_BITS) - 1)
    return (((31 - exponent) << MANTISSA_BITS) | mantissa).astype(np.uint16)


def band_keys(regs: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of each row of registers."""
    lanes = regs.reshape(len(regs), -1, BAND).astype(np.uint64)
    packed = np.zeros(lanes.shape[:2], np.uint64)
    for k in range(BAND):
        packed = (packed << np.uint64(16)) | lanes[:, :, k]
    band = mix(np.arange(1000, 1000 + lanes.shape[1], dtype=np.uint64))
    return mix(packed ^ band[None, :])


def _chance_table() -> np.ndarray:
    """Chance that registers of disjoint sets of 2**i and 2**j shingles agree."""
    cells = np.concatenate([np.exp2(e) * (1 + np.arange(1 << MANTISSA_BITS) / (1 << MANTISSA_BITS)) for e in range(32)] + [[2.0**32]]) - 1
    none = [np.exp(np.exp2(i) * np.log1p(-np.minimum(cells / 2.0**32, 1 - 1e-16))) for i in range(26)]
    mass = np.array([x[:-1] - x[1:] for x in none])
    return mass @ mass.T


_chance: list[np.ndarray] = []


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Jaccard similarity from the share of equal registers, less those equal by chance."""
    if not _chance:
        _chance.append(_chance_table())
    size = [np.clip(np.rint(np.log2(np.maximum(n, 1))), 0, 25).astype(int) for n in (na, nb)]
    chance = _chance[0][size[0], size[1]]
    return ((a == b).mean(-1) - chance) / (1 - chance)


def _least() -> float:
    j = PERCENT / 100
    return j - DEVIATIONS * (j * (1 - j) / PERMUTATIONS) ** 0.5


def _may_link(na, nb):
    """Sizes alone rule out the other pairs."""
    return 100 * np.minimum(na, nb) >= PERCENT * np.maximum(na, nb)


def _sets(batch: pa.RecordBatch):
    """(row, sorted distinct shingle hashes) of each text of a batch."""
    words = Words(batch.column("text"))
    for i in range(batch.num_rows):
        yield i, np.unique(shingles(words.hash[words.bounds[i] : words.bounds[i + 1]], SHINGLE))


def _class_of(s: np.ndarray) -> int:
    digest = hashlib.blake2b(s.tobytes(), digest_size=8).digest()
    return int.from_bytes(digest, "little", signed=True)


_SKETCH = "doc_id long, n_shingles long, cls long, regs binary"


def _sketches(batches):
    for batch in batches:
        for part in slices(batch):
            n, cls, regs = [], [], []
            for _, s in _sets(part):
                n.append(len(s))
                cls.append(_class_of(s) if len(s) else None)
                regs.append(registers(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(cls, pa.int64()), pa.array(regs, pa.binary())],
                names=["doc_id", "n_shingles", "cls", "regs"],
            )


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), PERMUTATIONS)


def _banded(batches):
    for batch in batches:
        for i in range(0, batch.num_rows, 4096):
            part = batch.slice(i, 4096)
            keys = band_keys(_matrix(part.column("regs"))).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.ravel()), pa.array(np.repeat(part.column("cls").to_numpy(), keys.shape[1]))], names=["key", "cls"]
            )


def _near_enough(batches):
    """Keeps pairs whose sizes and registers allow a link."""
    least = _least()
    for batch in batches:
        na, nb = (batch.column(c).to_numpy() for c in ("na", "nb"))
        keep = _may_link(na, nb) & (estimate(_matrix(batch.column("ra")), _matrix(batch.column("rb")), na, nb) >= least)
        yield batch.select(["a", "b"]).filter(pa.array(keep))


def _full_sets(batches):
    for batch in batches:
        for part in slices(batch):
            cls, out = [], []
            for _, s in _sets(part):
                if len(s):
                    cls.append(_class_of(s))
                    out.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(cls, pa.int64()), pa.array(out, pa.binary())], names=["cls", "shingles"])


def _link(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sorted sets link."""
    both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return 100 * both >= PERCENT * (len(x) + len(y) - both)


def _linked(batches):
    for batch in batches:
        keep = []
        for x, y in zip(batch.column("sa"), batch.column("sb")):
            keep.append(_link(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _crossing(batches):
    """Streams rows (grp, side, comp, weight, cls, n, regs) sorted by grp; yields (cls, comp) where a class may link into another component.

    Of two components, the lighter one's class is named. Of one group, at most about 2 * BLOCK rows
    are held: side 0 within itself, or side 0 against side 1.
    """
    least, held, at = _least(), [], None

    def flush():
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        comp, weight, cls, n, side = (rows.column(c).to_numpy() for c in ("comp", "weight", "cls", "n", "side"))
        regs, sides = _matrix(rows.column("regs")), np.flatnonzero(side == 1)
        found = []
        for i in np.flatnonzero(side == 0):
            other = sides if len(sides) else np.arange(i + 1, len(comp))
            other = other[(comp[other] != comp[i]) & _may_link(n[other], n[i])]
            if len(other):
                other = other[estimate(regs[other], regs[i], n[other], np.full(len(other), n[i])) >= least]
            if len(other):
                mine = (weight[i] < weight[other]) | ((weight[i] == weight[other]) & (comp[i] > comp[other]))
                found.append(np.stack([np.where(mine, cls[i], cls[other]), np.where(mine, comp[other], comp[i])], axis=1))
        if found:
            pairs = np.unique(np.concatenate(found), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["cls", "comp"])

    for batch in batches:
        grp = batch.column("grp").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(grp)) + 1), len(grp)]
        for i, j in zip(cuts[:-1], cuts[1:]):
            if j > i:
                if held and grp[i] != at:
                    yield from flush()
                    held = []
                at = grp[i]
                held.append(batch.slice(i, j - i))
    if held:
        yield from flush()


def _joins_block(batches):
    """Streams rows (comp, block, part, kind, cls, regs, shingles) sorted by comp, block, part, kind; yields a confirmed link (a, b) of each kind-1 class into the block.

    The kind-0 rows of one block are held; they have about SET_BLOCK shingles.
    """
    least, at, held, regs, sizes = _least(), None, [], None, None
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("comp", "block", "part", "kind", "cls", "regs", "shingles")]
        a, b = [], []
        for comp, block, part, kind, cls, reg, raw in zip(*columns):
            if (comp, block, part) != at:
                at, held, regs = (comp, block, part), [], None
            own = np.frombuffer(raw, np.uint64)
            if kind == 0:
                held.append((cls, reg, own))
                continue
            if not held:
                continue
            if regs is None:
                regs = np.frombuffer(b"".join(r for _, r, _ in held), np.uint16).reshape(-1, PERMUTATIONS)
                sizes = np.array([len(x) for _, _, x in held])
            maybe = np.flatnonzero(_may_link(sizes, len(own)))
            value = estimate(regs[maybe], np.frombuffer(reg, np.uint16), sizes[maybe], np.full(len(maybe), len(own)))
            for k in np.argsort(-value).tolist():
                if value[k] < least:
                    break
                other = held[maybe[k]]
                if other[0] != cls and _link(own, other[2]):
                    a.append(min(cls, other[0]))
                    b.append(max(cls, other[0]))
                    break
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) whose full sets link."""
    first = sets.select(F.col("cls").alias("a"), F.col("shingles").alias("sa"))
    second = sets.select(F.col("cls").alias("b"), F.col("shingles").alias("sb"))
    return pairs.join(second, "b").join(first, "a").mapInArrow(_linked, "a long, b long")


def _with_component(df: DataFrame, of_comp: DataFrame, how: str = "inner") -> DataFrame:
    """df(comp, cls, ...) joined with a row of each component, dealt by cls too, so that a large component is in many tasks."""
    salted = of_comp.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return df.withColumn("salt", F.pmod(F.xxhash64("cls", F.lit(11)), F.lit(SALTS)).cast("int")).join(salted, ["comp", "salt"], how).drop("salt")


#: Rows of a key from which on they meet the key's one row where they are, which is sent to all tasks: at most one such key for each so many rows.
HOT = 1 << 17


def _met(many: DataFrame, one: DataFrame, key: str) -> DataFrame:
    """many(key, size, ...) joined with one(key, size, ...), a row of each key; size is how many rows of many a key has, about. Rows of hot keys are not shuffled."""
    hot = F.col("size") > HOT
    rest = many.where(~hot).join(one.where(~hot).drop("size"), key)
    return rest.unionByName(many.where(hot).join(F.broadcast(one.where(hot).drop("size")), key))


def _placed(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, cls, comp, inside, most, others) of the buckets that hold several components: whether cls is of the component with most classes in the bucket, and how many are and are not."""
    placed = buckets.join(labels.withColumnRenamed("v", "cls"), "cls", "left").select("key", "size", "cls", F.coalesce("label", "cls").alias("comp"))
    counted = placed.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n"))
    top = counted.groupBy("key").agg(F.max(F.struct("n", "comp")).alias("top"), F.sum("n").alias("size"), F.count(F.lit(1)).alias("comps")).where("comps > 1").withColumn("classes", F.col("size"))
    placed = _met(placed, top, "key").withColumn("size", F.col("classes"))
    return placed.select("key", "cls", "comp", (F.col("comp") == F.col("top.comp")).alias("inside"), F.col("top.n").alias("most"), (F.col("size") - F.col("top.n")).alias("others"))


def _meetings(placed: DataFrame) -> DataFrame:
    """(grp, side, comp, cls): classes of a bucket outside its main component, in blocks, against each other and against the main component's blocks; those of the main component do not meet each other."""
    blocks = lambda n: F.ceil(F.col(n) / F.lit(BLOCK)).cast("int")
    rows = placed.withColumn("o", blocks("others")).withColumn("m", blocks("most"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("cls"), F.when(F.col("inside"), F.col("m")).otherwise(F.col("o"))).cast("int"))
    other = rows.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("o") - 1)))
    main = F.col("inside")
    against_others = other.select(
        F.when(main, F.xxhash64("key", F.lit(1), "with", "own")).otherwise(F.xxhash64("key", F.lit(0), F.least("own", "with"), F.greatest("own", "with"))).alias("grp"),
        (main | (F.col("own") > F.col("with"))).cast("int").alias("side"), "comp", "cls",
    )
    against_main = rows.where(~main).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    return against_others.union(against_main.select(F.xxhash64("key", F.lit(1), "own", "with").alias("grp"), F.lit(0).alias("side"), "comp", "cls"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id (smallest doc_id reachable over links), kept.

    Texts are lower-cased (A-Z) and split at ASCII blanks. Equal sets form a class
    first, so copies cost nothing further. Texts that are null, empty or without words are
    linked with nothing: n_shingles 0, component_id their own doc_id. Rows with a null doc_id
    come back unlinked, component_id and kept null. A doc_id that occurs twice gives two
    rows. Further columns, whatever their names, are ignored. An empty table gives no rows.

    In each band bucket every class is held against CENTRES classes of the bucket. What is left apart after that
    is held against the whole of each other component in a shared bucket that it may link into, in blocks; classes of a bucket's
    main component are not compared with each other again. So a bucket of n alike texts costs about n
    verifications, makes no row for each pair, and loses no link between components. A pair at similarity 0.75 exactly shares no
    band with chance 5e-6 and falls below the estimate's cut with chance 3e-7 or so; others of its component may still link it.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    small_batches(docs.sparkSession)
    sketched = written(docs.mapInArrow(tidied(_sketches), _SKETCH))
    usable = sketched.where("cls is not null and doc_id is not null")
    classes = usable.groupBy("cls").agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("copies"))
    rep = usable.join(classes.select(F.col("first_doc").alias("doc_id"), "cls"), ["doc_id", "cls"], "left_semi")
    rep = written(rep.groupBy("cls").agg(F.first("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.first("regs").alias("regs")))

    banded = rep.select("cls", "regs").mapInArrow(_banded, "key long, cls long")
    shared = banded.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    buckets = written(banded.join(shared, "key"))
    involved = buckets.select("cls").distinct().join(rep.select("cls", "doc_id"), "cls").select("doc_id").distinct()
    sets = written(docs.join(involved, "doc_id", "left_semi").mapInArrow(tidied(_full_sets), "cls long, shingles binary").dropDuplicates(["cls"]))
    sketch = rep.select("cls", "n", "regs")

    centres = buckets.groupBy("key", "size").agg(*(F.min_by("cls", F.xxhash64("cls", F.lit(i))).alias(f"c{i}") for i in range(CENTRES)))
    pairs = _met(buckets, centres, "key").select("cls", F.explode(F.array_distinct(F.array(*(f"c{i}" for i in range(CENTRES))))).alias("centre"))
    pairs = pairs.where("cls <> centre").select(F.least("cls", "centre").alias("a"), F.greatest("cls", "centre").alias("b")).distinct()
    pairs = (
        pairs.join(sketch.toDF("b", "nb", "rb"), "b").join(sketch.toDF("a", "na", "ra"), "a")
        .mapInArrow(_near_enough, "a long, b long")
    )
    labels = connected(_verified(pairs, sets))

    weights = labels.groupBy(F.col("label").alias("comp")).agg(F.count(F.lit(1)).alias("weight"))
    met = _with_component(_meetings(_placed(buckets, labels)), weights, "left").withColumn("weight", F.coalesce("weight", F.lit(1))).join(sketch, "cls")
    rest = met.repartition("grp").sortWithinPartitions("grp").mapInArrow(_crossing, "cls long, comp long")
    rest = written(rest.distinct())

    members = rep.select("cls", "n").join(labels.withColumnRenamed("v", "cls"), "cls", "left").select("cls", "n", F.coalesce("label", "cls").alias("comp"))
    load = rest.groupBy("comp").agg(F.ceil(F.count(F.lit(1)) / F.lit(TRIED)).cast("int").alias("parts"))
    members = _with_component(members, load)
    cut = members.groupBy("comp").agg(F.ceil(F.sum("n") / F.lit(SET_BLOCK)).cast("int").alias("blocks")).join(load, "comp")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    of = lambda n, salt: F.pmod(F.xxhash64("cls", F.lit(salt)), F.col(n)).cast("int")
    held = _with_component(members.select("comp", "cls"), cut).select("comp", of("blocks", 1).alias("block"), every("parts").alias("part"), F.lit(0).alias("kind"), "cls")
    tried = _with_component(rest, cut).select("comp", every("blocks").alias("block"), of("parts", 2).alias("part"), F.lit(1).alias("kind"), "cls")
    against = held.union(tried).join(sketch.select("cls", "regs"), "cls").join(sets, "cls").select("comp", "block", "part", "kind", "cls", "regs", "shingles")
    against = against.repartition("comp", "block", "part").sortWithinPartitions("comp", "block", "part", "kind")
    more = against.mapInArrow(_joins_block, "a long, b long")
    # components of components: what is linked now are labels
    for end in ("a", "b"):
        more = more.join(labels.select(F.col("v").alias(end), F.col("label").alias("l" + end)), end, "left").withColumn(end, F.coalesce("l" + end, end)).drop("l" + end)
    joined_labels = connected(more)
    merged = labels.withColumnRenamed("label", "v0").join(joined_labels.select(F.col("v").alias("v0"), "label"), "v0", "left").select("v", F.coalesce("label", "v0").alias("label"))
    labels = written(merged.union(joined_labels.join(labels.select("v"), "v", "left_anti").select("v", "label")))

    joined = classes.join(labels.withColumnRenamed("v", "cls"), "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    least = joined.groupBy("label").agg(F.min("first_doc").alias("component"), F.count(F.lit(1)).alias("size"))
    # components of one class need no join; classes don't know how large theirs is, so large ones are told by their label
    large = F.broadcast(least.where(F.col("size") > HOT).select("label", F.col("component").alias("of_large")))
    joined = joined.join(large, "label", "left")
    rest = joined.where("of_large is null").drop("of_large").join(least.drop("size"), "label")
    of_class = written(rest.select("cls", "component", "copies").unionByName(joined.where("of_large is not null").select("cls", F.col("of_large").alias("component"), "copies")))
    # documents of a text with very many copies meet its class where they are; those without words meet none
    hot = F.broadcast(of_class.where(F.col("copies") > HOT).select("cls", F.col("component").alias("of_hot")))
    rows = sketched.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("cls")).alias("cls")).join(hot, "cls", "left")
    few = F.col("cls").isNotNull() & F.col("of_hot").isNull()
    out = rows.where(few).join(of_class.select("cls", "component"), "cls", "left").unionByName(rows.where(~few).withColumn("component", F.col("of_hot"))).drop("of_hot")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id") == F.col("component_id"))
