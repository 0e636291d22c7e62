"""N-gram Jaccard join by universe partition and pigeonhole.

Sets are the distinct word shingles of whole texts; two sets are linked when
their Jaccard similarity is at least 3/4.  Then they differ in at most
D = (|x| + |y|) / 7 shingles.

*Schemes.*  The size band of the larger set (a power of two) fixes a scheme that
hashes the universe of shingles into m > D segments.  If x and y agree in no
segment they differ in m shingles; and in a *wide* segment (one in ``WIDE``) the
one-deletion neighbourhoods let us find subsets that differ in one shingle, which
counts for two.  So of the units a set has in a scheme (a segment, or a wide
segment's neighbourhood) any D + 1 suffice to find every partner.  Sets below
``SMALLEST`` shingles use single shingles as units: of x at most |x| / 7 are
missing in a larger partner, so any |x| / 7 + 1 of them suffice.

*Index.*  Every set is indexed under all units of its own band; a set that can
be the smaller of a pair in the next band probes there as well.  Keys travel
packed by hash bucket; a bucket keeps only keys under which several sets met.

*Cost-based allocation.*  A set may leave out all units but D + 1.  Units that met
nobody cost nothing; of the others those are left out whose keys met most sets of
other components.  So a passage that very many texts share costs nothing as long
as the rest of the set has units enough.

*Hot groups.*  Before allocation, ``STAR_ROUNDS`` rounds compare every set with one
pivot, the set it met most often among the leading ones under its keys (first
the smallest name, then the set that meets most others), and merge what is
linked.  A group of thousands of near copies so becomes one component
without listing its pairs, and costs nothing afterwards.

*Verification.*  Candidates pass a parity sketch (a shingle in which two sets
differ flips one of ``SKETCH`` bits) and are then verified on the full sets.

*The rest.*  A set whose units are fewer than D + 1 (its shingles fell into too
few segments) is looked for by single shingles in a pass of its own, made only if
there is such a set.

Defined cases: null, empty and word-less texts have the empty set and are linked
with nothing; equal sets are one class however many rows share them; a row
without id is a class member like any other but never a component's name unless
all are; rows that repeat an id share its component; an empty table gives an
empty result; extra columns are ignored.  Shingles and sets are compared by
64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from rankaudit.llm.components import components
from rankaudit.llm.scoring import slices
from rankaudit.llm.shingles import mixed, shingle_sets
from rankaudit.llm.store import written

SMALLEST = 64
WIDE = 16
SKETCH = 1024
STAR_ROUNDS = 2
#: Entries a task gathers before it packs them, and that a bucket should hold on average.
GATHER = 500_000
BUCKET = 400_000
#: Narrow tables up to so many rows are broadcast; above it the join is shuffled.
SMALL = 500_000
SINGLE = 0  # the scheme of single shingles


def band(n: int) -> int:
    """Scheme of a larger set of ``n`` shingles."""
    return n.bit_length() if n >= SMALLEST else SINGLE


def segment_count(scheme: int) -> int:
    most = 2 * ((1 << scheme) - 1) // 7 + 1  # D + 1 for two sets as large as the band allows
    return int(np.ceil(1.08 * most + np.sqrt(most)))


def needed(n: int, scheme: int) -> int:
    """Units that a set of ``n``, as the smaller of a pair, needs in ``scheme``."""
    if scheme == SINGLE:
        return n // 7 + 1
    largest = min(4 * n // 3, (1 << scheme) - 1)
    return (n + largest) // 7 + 1


def unit_keys(h: np.ndarray, scheme: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, segment, whether a one-deletion key) of all units of the set ``h`` in ``scheme``."""
    if scheme == SINGLE:
        return mixed(h), np.arange(len(h)), np.zeros(len(h), bool)
    seg = ((h >> np.uint64(20)) % np.uint64(segment_count(scheme))).astype(np.int64)
    order = np.argsort(seg, kind="stable")
    seg, value = seg[order], mixed(h[order])
    start = np.flatnonzero(np.diff(seg, prepend=-1))
    sums = np.add.reduceat(value, start)
    sizes = np.diff(np.append(start, len(seg)))
    which = np.repeat(np.arange(len(start)), sizes)
    out = np.flatnonzero((seg % WIDE == 0) & (sizes[which] > 1))
    subset = np.concatenate([sums, sums[which[out]] - value[out]])
    segment = np.concatenate([seg[start], seg[out]])
    tag = mixed(segment.astype(np.uint64) + np.uint64(scheme << 40))
    return mixed(subset + tag), segment, np.arange(len(segment)) >= len(start)


def units(segment: np.ndarray, deletion: np.ndarray) -> int:
    return int((~deletion).sum()) + len(np.unique(segment[deletion]))


def probe_next(n: int) -> int | None:
    """The next band's scheme, if a set of ``n`` can be the smaller of a pair there."""
    nxt = band(4 * n // 3)
    return nxt if nxt != band(n) else None


def set_key(h: np.ndarray) -> int:
    """Signed 64-bit name of a set."""
    total = mixed(h).sum(dtype=np.uint64) + np.uint64(len(h))
    return int(mixed(np.array([total], np.uint64)).view(np.int64)[0])


def sketch(h: np.ndarray) -> np.ndarray:
    odd = np.bincount((h & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH) & 1
    return np.packbits(odd).view(np.int64)


def _per_set(text_col: str, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch in batches:
        for part in slices(batch, text_col):
            yield part, shingle_sets(part.column(text_col).to_pylist())


#: What a set's document row carries: see ``indexed``.
ABOUT = "text_hash long, n long, cid long, sketch array<long>, spare_own int, spare_next int, short boolean"
ABOUT_NAMES = [c.split()[0] for c in ABOUT.split(", ")]
#: Documents a task packs at once (numbered by 16 bits).
PACK_DOCS = 60_000


def _units_of(h: np.ndarray, singles: bool) -> tuple[np.ndarray, np.ndarray, int, int]:
    """(keys, units, spare_own, spare_next) of a set.  A unit is scheme (5 bits), next
    band (1), deletion (1) and segment (25); a spare count below 0 means too few."""
    n = len(h)
    if n <= 2:  # such a set is only linked with its equals
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32), 0, 0
    nxt = None if singles else probe_next(n)
    keys, tags, spare = [], [], [0, 0]
    for k, scheme in enumerate([SINGLE if singles else band(n)] + ([] if nxt is None else [nxt])):
        key, segment, deletion = unit_keys(h, scheme)
        keys.append(key)
        tags.append(((scheme << 27) | (k << 26) | (deletion.astype(np.int64) << 25) | segment).astype(np.uint32))
        spare[k] = units(segment, deletion) - needed(n, scheme)
    return np.concatenate(keys), np.concatenate(tags), *spare


class Packer:
    """Index entries of many sets, packed by hash bucket: sorted 32-bit keys, the
    number of each entry's set in the pack, its unit; and the names of the sets."""

    def __init__(self, buckets: int) -> None:
        self.buckets = buckets
        self.start()

    def start(self) -> None:
        self.number: dict[int, int] = {}
        self.keys, self.units, self.sizes, self.held = [], [], [], 0

    def add(self, cid: int, keys: np.ndarray, tags: np.ndarray) -> None:
        if cid not in self.number and len(keys):
            self.number[cid] = len(self.number)
            self.keys.append(keys)
            self.units.append(tags)
            self.sizes.append(len(keys))
            self.held += len(keys)

    def full(self) -> bool:
        return self.held >= GATHER or len(self.number) >= PACK_DOCS

    def packs(self) -> tuple[list[int], list[bytes]]:
        if not self.held:
            return [], []
        key, unit = np.concatenate(self.keys), np.concatenate(self.units)
        owner = np.repeat(np.arange(len(self.sizes)), self.sizes).astype(np.uint16)
        names = np.fromiter(self.number, np.int64, len(self.number))
        bucket = key % np.uint64(self.buckets)
        key = (key >> np.uint64(32)).astype(np.uint32)
        order = np.lexsort((key, bucket)) if self.buckets > 1 else np.argsort(key)
        bucket, key, unit, owner = bucket[order], key[order], unit[order], owner[order]
        lo = np.flatnonzero(np.diff(bucket.astype(np.int64), prepend=-1))
        out = []
        for a, b in zip(lo, np.append(lo[1:], len(key)), strict=True):
            used, at = np.unique(owner[a:b], return_inverse=True)
            out.append(np.int64(b - a).tobytes() + key[a:b].tobytes() + unit[a:b].tobytes() + at.astype(np.uint16).tobytes() + names[used].tobytes())
        found = bucket[lo].astype(np.int64).tolist()
        self.start()
        return found, out


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, units, cids) of a pack."""
    n = int(np.frombuffer(data, np.int64, 1)[0])
    key = np.frombuffer(data, np.uint32, n, 8)
    unit = np.frombuffer(data, np.uint32, n, 8 + 4 * n)
    at = np.frombuffer(data, np.uint16, n, 8 + 8 * n)
    return key, unit, np.frombuffer(data[8 + 10 * n :], np.int64)[at]


def indexed(docs: DataFrame, buckets: int, singles: bool = False) -> DataFrame:
    """Two kinds of rows: (bucket, entries) packs, and with a negative bucket one row
    per document: doc_id, text_hash, n, cid (the set's name), sketch, spare_* (units
    that may be left out) and short (whether they are too few)."""
    kind = docs.schema["doc_id"].dataType
    names = ["bucket", "entries", "doc_id", *ABOUT_NAMES]
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    types = [to_arrow_type(t.dataType) for t in StructType.fromDDL(ABOUT).fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(buckets)

        def packs(id_type: pa.DataType) -> pa.RecordBatch:
            found, data = packer.packs()
            empty = [pa.nulls(len(found), t) for t in (id_type, *types)]
            return pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(data, pa.binary()), *empty], names=names)

        id_type = to_arrow_type(kind)
        for part, sets in _per_set("text", batches):
            about = []
            for h in sets:
                keys, tags, own, nxt = _units_of(h, singles)
                cid = set_key(h)
                packer.add(cid, keys, tags)
                about.append((len(h), cid, sketch(h), max(own, 0), max(nxt, 0), own < 0 or nxt < 0))
            columns = [part.column("text_hash"), *[pa.array(c, t) for c, t in zip(zip(*about, strict=True), types[1:], strict=True)]]
            where = pa.array(-1 - np.arange(len(sets)) % 64)
            yield pa.RecordBatch.from_arrays([where, pa.nulls(len(sets), pa.binary()), part.column("doc_id").cast(id_type), *columns], names=names)
            if packer.full():
                yield packs(id_type)
        yield packs(id_type)

    return rows.mapInArrow(run, f"bucket long, entries binary, doc_id {kind.simpleString()}, {ABOUT}")


def _met(key: np.ndarray, unit: np.ndarray, cid: np.ndarray) -> tuple[np.ndarray, ...]:
    """(met, (key, unit, cid, pivot) of the entries under keys that several sets share,
    pivot the smallest cid there); met marks those entries."""
    order = np.argsort(key)
    same = np.diff(key[order]) == 0
    double = np.concatenate([[False], same]) | np.concatenate([same, [False]])
    met = np.zeros(len(key), bool)
    at = order[double]
    at = at[np.lexsort((unit[at], cid[at], key[at]))]
    k, u, c = key[at], unit[at], cid[at]
    if not len(at):
        return met, (k, u, c, c)
    new = np.concatenate([[True], k[1:] != k[:-1]])
    group, first = np.cumsum(new) - 1, np.flatnonzero(new)
    pivot = c[first][group]
    several = (np.bincount(group, c != pivot) > 0) & (np.bincount(group, (u >> 25) & 1 == 0) > 0)
    keep = several[group]
    met[at[keep]] = True
    keep &= np.concatenate([[True], (k[1:] != k[:-1]) | (c[1:] != c[:-1]) | (u[1:] != u[:-1])])  # a set met again
    return met, (k[keep], u[keep], c[keep], pivot[keep])


def met_units(packed: DataFrame, limit: int) -> DataFrame:
    """The document rows of ``packed`` as they are (key null), and (key, cid, unit, pivot)
    of the entries whose key several sets share; pivot: the smallest cid under the
    key.  A bucket beyond ``limit`` entries writes out the shared keys met so far and
    keeps only one set of each, so that a key common to very many sets takes no memory."""
    id_type = packed.schema["doc_id"].dataType
    names = ["key", "unit", "pivot", "doc_id", *ABOUT_NAMES]
    types = [to_arrow_type(id_type), *[to_arrow_type(t.dataType) for t in StructType.fromDDL(ABOUT).fields]]

    def rows(bucket: int, key: np.ndarray, unit: np.ndarray, cid: np.ndarray, pivot: np.ndarray) -> pa.RecordBatch:
        columns = {"key": (np.int64(bucket) << 32) | key.astype(np.int64), "unit": unit.astype(np.int64), "pivot": pivot, "cid": cid}
        rest = dict(zip(names[3:], types, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(columns[c]) if c in columns else pa.nulls(len(key), rest[c]) for c in names], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, size = None, [], 0

        def closed() -> tuple[np.ndarray, pa.RecordBatch, list[np.ndarray]]:
            whole = [np.concatenate(c) for c in zip(*held, strict=True)]
            met, found = _met(*whole)
            return met, rows(now, *found), whole

        for batch in batches:
            about = batch.filter(pc.less(batch.column("bucket"), 0))
            blank = [pa.nulls(about.num_rows, pa.int64())] * 3
            yield pa.RecordBatch.from_arrays([*blank, *[about.column(c) for c in names[3:]]], names=names)
            packs = batch.filter(pc.greater_equal(batch.column("bucket"), 0))
            for bucket, data in zip(packs.column("bucket").to_pylist(), packs.column("entries").to_pylist(), strict=True):
                if bucket != now and held:
                    yield closed()[1]
                    held, size = [], 0
                now = bucket
                held.append(unpacked(data))
                size += len(held[-1][0])
                if size > limit:
                    met, found, (key, unit, cid) = closed()
                    yield found
                    first = np.zeros(len(key), bool)
                    at = np.flatnonzero(met)
                    at = at[np.lexsort(((unit[at] >> 25) & 1, cid[at], key[at]))]
                    first[at[np.concatenate([[True], key[at][1:] != key[at][:-1]])] if len(at) else at] = True
                    stay = ~met | first
                    held, size = [(key[stay], unit[stay], cid[stay])], int(stay.sum())
        if held:
            yield closed()[1]

    dealt = packed.repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(run, f"key long, unit long, pivot long, doc_id {id_type.simpleString()}, {ABOUT}")


def _small(rows: DataFrame) -> DataFrame:
    """``rows`` (narrow) marked for broadcast if they are few."""
    return F.broadcast(rows) if rows.count() <= SMALL else rows


def linked(pairs: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) of cids whose sets are linked."""
    pairs = written(pairs, "pairs")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct()
    side = written(classes.select("cid", "n", "sketch", "rep").join(_small(ends), "cid"), "pair-classes")
    sides = {s: side.select(*[F.col(c).alias(f"{s}_{c}") for c in side.columns]) for s in "ab"}
    two = pairs.join(sides["a"], F.col("a") == F.col("a_cid")).join(sides["b"], F.col("b") == F.col("b_cid"))
    both = F.col("a_n") + F.col("b_n")
    near = two.where((F.least("a_n", "b_n") * 4 >= F.greatest("a_n", "b_n") * 3)).where(_apart() * 7 <= both)
    near = written(near.select("a", "b", "a_n", "b_n"), "near-pairs")
    reps = side.select("cid", "rep").join(near.select(F.explode(F.array("a", "b")).alias("cid")).distinct(), "cid")
    reps = _small(written(reps, "pair-texts"))
    texts = docs.select("doc_id", "text").join(reps, F.col("doc_id").eqNullSafe(F.col("rep"))).select("cid", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found in _per_set("text", batches):
            cid = part.column("cid").to_pylist()
            keep = [i for i, h in enumerate(found) if set_key(h) == cid[i]]  # rows may repeat an id
            yield pa.RecordBatch.from_arrays(
                [pa.array([cid[i] for i in keep], pa.int64()), pa.array([found[i].view(np.int64) for i in keep], pa.list_(pa.int64()))], names=["cid", "s"]
            )

    full = written(texts.mapInArrow(sets, "cid long, s array<long>"), "full-sets")
    if full.count() > reps.count():
        full = full.dropDuplicates(["cid"])
    checked = near.join(full.select(F.col("cid").alias("b"), F.col("s").alias("sb")), "b").join(full.select(F.col("cid").alias("a"), F.col("s").alias("sa")), "a")
    shared = F.size(F.array_intersect("sa", "sb"))
    return written(checked.where(100 * shared >= 75 * (F.col("a_n") + F.col("b_n") - shared)).select("a", "b"), "set-links")


def _labels(links: DataFrame) -> DataFrame:
    """(cid, comp) of every set in ``links``."""
    return written(components(links).select(F.col("id").alias("cid"), F.col("component").alias("comp")), "labels")


def _labelled(met: DataFrame, labels: DataFrame) -> DataFrame:
    """``met`` with comp, without the keys all of whose sets are in one component."""
    labels = _small(labels)
    rows = met.drop("comp").join(labels, "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    lead = labels.select(F.col("cid").alias("pivot"), F.col("comp").alias("pivot_comp"))
    loose = rows.join(lead, "pivot", "left").where(F.col("comp") != F.coalesce("pivot_comp", "pivot"))
    open_keys = written(loose.select("key").distinct(), "open-keys")
    return written(rows.join(_small(open_keys), "key"), "met-units")


def _stars(candidates: DataFrame) -> DataFrame:
    """One pair (a, b) per set: the pivot it met under most keys."""
    tally = candidates.groupBy("cid", "pivot").count()
    best = tally.groupBy("cid").agg(F.max(F.struct("count", (-F.col("pivot")).alias("lowest"), "pivot")).alias("p"))
    return best.select(F.col("cid").alias("a"), F.col("p.pivot").alias("b"))


def _apart() -> Column:
    """Bits in which the sketches of a and b differ: never more than the sets differ in shingles."""
    words = [F.bit_count(F.get("a_sketch", F.lit(i)).bitwiseXOR(F.get("b_sketch", F.lit(i)))) for i in range(SKETCH // 64)]
    return sum(words[1:], words[0])


def _central(met: DataFrame) -> DataFrame:
    """(cid, pivot): under every key the set that meets most others over all its keys,
    with the sets of other components.  In a group of edited copies that is the one
    nearest to them all."""
    sizes = met.groupBy("key").agg(F.count("*").alias("size"))
    degree = met.join(sizes, "key").groupBy("cid").agg(F.sum("size").alias("degree"))
    top = met.join(_small(written(degree, "degrees")), "cid").groupBy("key").agg(F.max(F.struct("degree", "cid", "comp")).alias("top"))
    return met.drop("pivot").join(top, "key").where(F.col("comp") != F.col("top.comp")).select("cid", F.col("top.cid").alias("pivot"))


def allocated(met: DataFrame, classes: DataFrame, singles: bool) -> DataFrame:
    """Candidate pairs (a, b): a set and those of larger size and other components
    that it meets under the units it does not leave out.

    Keys under which the very same sets stand (as the many keys of a passage that
    many texts share) are looked up once, under the smallest of them."""
    info = classes.join(_small(met.select("cid", "comp").distinct()), "cid")
    info = written(info.select("cid", "comp", "n", "sketch", "spare_own", "spare_next"), "open-sets")
    if singles:
        info = info.withColumn("spare_own", (F.col("n") - F.floor(F.col("n") / 7) - 1).cast("int"))
    unit = F.col("unit")
    met = written(met.select(
        "key", "cid", "comp", F.shiftright(unit, 27).alias("scheme"), (unit.bitwiseAND(1 << 26) != 0).alias("next"),
        (unit.bitwiseAND(1 << 25) != 0).alias("deletion"), unit.bitwiseAND((1 << 25) - 1).alias("segment"),
    ).distinct(), "open-units")  # ``met_units`` repeats rows of spilled buckets, and equal rows cancel out of ``members``
    # what is indexed under a key: sets by their whole subset (exact) and by a neighbourhood (near)
    indexed_rows = met.where(~F.col("next"))
    exact, near = ~F.col("deletion"), F.col("deletion")

    def members(kind: Column, name: str) -> list[Column]:
        hashes = [F.bit_xor(F.when(kind, F.xxhash64(F.lit(salt), "cid"))).alias(f"{name}_{salt}") for salt in (1, 2)]
        return [F.count_if(kind).alias(name), *hashes]

    keys = written(indexed_rows.groupBy("key").agg(*members(exact, "exact"), *members(near, "near")), "open-key-sets")
    for name in ("exact", "near"):
        same = [name, f"{name}_1", f"{name}_2"]
        lead = keys.where(F.col(name) > 0).groupBy(*same).agg(F.min("key").alias(f"{name}_key"))
        keys = keys.join(lead, same, "left")
    keys = written(keys.select("key", "exact", "near", "exact_key", "near_key"), "open-key-sets")
    own = indexed_rows.groupBy("key", "comp").agg(F.count_if(exact).alias("own_exact"), F.count_if(near).alias("own_near"))
    cost = met.join(keys, "key").join(own, ["key", "comp"], "left")
    cost = written(cost.select(
        "cid", "scheme", "next", "segment", "deletion", "exact_key", "near_key",
        (F.col("exact") - F.coalesce("own_exact", F.lit(0))).alias("exact"), (F.col("near") - F.coalesce("own_near", F.lit(0))).alias("near"),
    ), "open-costs")
    # unit 1: the segment's subset against subsets; unit 2: against neighbourhoods, either way
    per_segment = cost.groupBy("cid", "scheme", "next", "segment").agg(
        F.sum(F.when(~F.col("deletion"), F.col("exact")).otherwise(0)).alias("one"),
        F.sum(F.when(F.col("deletion"), F.col("exact")).otherwise(F.col("near"))).alias("two"),
    )
    # Unit 2 is met by equal subsets too, so it is looked up under both and left out before
    # unit 1: costs are those of leaving out one after the other, or both at once, twice over.
    wide = (F.col("scheme") != SINGLE) & (F.col("segment") % WIDE == 0)
    all_met = F.col("one") + F.col("two")
    first, second = F.when(wide, F.least(2 * F.col("one"), all_met)).otherwise(2 * F.col("one")), F.when(wide, F.greatest(2 * F.col("two"), all_met)).otherwise(0)
    either = F.explode(F.array(F.struct(F.lit(1).alias("unit"), first.alias("cost")), F.struct(F.lit(2).alias("unit"), second.alias("cost"))))
    choices = per_segment.select("cid", "scheme", "next", "segment", either.alias("u")).select("cid", "scheme", "next", "segment", "u.*").where("cost > 0 OR unit = 1")
    ranked = choices.groupBy("cid", "scheme", "next").agg(F.sort_array(F.collect_list(F.struct("cost", "unit", "segment")), False).alias("l"))
    ranked = ranked.join(info.select("cid", "spare_own", "spare_next"), "cid")
    kept = F.slice("l", F.when(F.col("next"), F.col("spare_next")).otherwise(F.col("spare_own")) + 1, F.size("l"))
    used = ranked.select("cid", "scheme", "next", F.explode(F.filter(kept, lambda u: u["cost"] > 0)).alias("u"))
    used = used.select("cid", "scheme", "next", "u.segment", "u.unit").groupBy("cid", "scheme", "next", "segment").agg(F.max("unit").alias("most"))
    probes = cost.join(used, ["cid", "scheme", "next", "segment"])
    meets = F.array(
        F.when(~F.col("deletion") | (F.col("most") == 2), F.struct(F.col("exact_key").alias("key"), F.lit(False).alias("deletion"))),
        F.when(~F.col("deletion") & (F.col("most") == 2), F.struct(F.col("near_key").alias("key"), F.lit(True).alias("deletion"))),
    )
    a = probes.select("cid", F.explode(meets).alias("m")).where("m.key IS NOT NULL").select("m.*", "cid").distinct()
    b = indexed_rows.join(_small(written(a.select("key", "deletion").distinct(), "open-lookups")), ["key", "deletion"]).select("key", "deletion", "cid")
    a, b = (
        side.join(info.select("cid", "n", "comp", "sketch"), "cid").select("key", "deletion", *[F.col(c).alias(f"{name}_{c}") for c in ("cid", "n", "comp", "sketch")])
        for side, name in ((a, "a"), (b, "b"))
    )
    fits = (F.col("b_n") >= F.col("a_n")) & (F.col("b_n") * 3 <= F.col("a_n") * 4) & (F.col("a_comp") != F.col("b_comp"))
    near_enough = _apart() * 7 <= F.col("a_n") + F.col("b_n")
    return a.join(b, ["key", "deletion"]).where(fits & near_enough).select(F.col("a_cid").alias("a"), F.col("b_cid").alias("b")).distinct()


def set_links(met: DataFrame, classes: DataFrame, docs: DataFrame, singles: bool = False) -> DataFrame:
    """Links (a, b) between classes, enough of them to connect every two linked sets."""
    links = linked(_stars(met.where("cid <> pivot")), classes, docs)
    for _ in range(STAR_ROUNDS - 1):
        met = _labelled(met, _labels(links))
        links = links.union(linked(_stars(_central(met)), classes, docs))
    met = _labelled(met, _labels(links))
    return written(links.union(linked(allocated(met, classes, singles), classes, docs)), "links")


def _indexed(docs: DataFrame, singles: bool) -> DataFrame:
    """``met_units`` of ``docs``, written; the number of buckets follows the texts' size."""
    size = docs.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    buckets = max(1, -(-(size // 6 if singles else size // 12) // BUCKET))  # a word has some six characters
    return written(met_units(indexed(docs, buckets, singles), 4 * BUCKET), "met-units")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, text_hash, n_shingles, component_id."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    both = _indexed(docs, singles=False)
    sets = both.where("key IS NULL").drop("key", "unit", "pivot")
    first = ("n", "sketch", "spare_own", "spare_next", "short")
    classes = written(sets.where("n > 0").groupBy("cid").agg(F.min("doc_id").alias("rep"), *[F.first(c).alias(c) for c in first]), "set-classes")
    links = set_links(both.where("key IS NOT NULL").select("key", "unit", "pivot", "cid"), classes, docs)
    if not classes.where("short").isEmpty():
        alone = _indexed(docs, singles=True).where("key IS NOT NULL").select("key", "unit", "pivot", "cid")
        links = links.union(set_links(alone, classes, docs, singles=True))
    of_set = written(components(links), "set-components")
    home = classes.select("cid", "rep").join(of_set, F.col("cid") == F.col("id"), "left").select("cid", "rep", F.coalesce("component", "cid").alias("c"))
    least = home.groupBy("c").agg(F.min("rep").alias("component_id"))
    named = home.join(least, "c").select("cid", "component_id")
    out = sets.select("doc_id", "text_hash", "n", "cid").join(named, "cid", "left")
    return out.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_per_component(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id names their component, one row of each, and all
    rows whose set is empty."""
    found = written(jaccard_components(docs), "document-components")
    kept = found.where((F.col("n_shingles") == 0) | F.col("component_id").eqNullSafe(F.col("doc_id")))
    kept = kept.groupBy("doc_id", "text_hash").agg(F.max("n_shingles").alias("n"), F.count("*").alias("rows"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"))
    out = rows.join(_small(kept), F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("text_hash")))
    repeated = (F.col("n") > 0) & (F.col("rows") > 1)
    if not kept.where(repeated).isEmpty():
        out = out.where(~repeated).select("row", "id").union(out.where(repeated).dropDuplicates(["id"]).select("row", "id"))
    return out.select("row.*")
