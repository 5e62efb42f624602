"""SimHash near-duplicates with pigeonring filtering.

Fingerprints. Words are runs of anything but ASCII white space, A-Z lower-cased; shingles of ``size`` words, repeats
included, are joined by one space (a shorter text is one shingle; a text without words has fingerprint zero and is linked
like any other). A bit is 1 if it is set in over half of the shingles' XXH64 values (seed 42).

Links. Distinct fingerprints within ``distance`` = 2 bits are linked. The 64 bits form a ring of five segments. If the
differences of five segments sum to 2 at most, some segment starts a chain whose running sums stay within the
proportional budgets floor(l * 2 / 5) = 0, 0, 1, 1, 2: so two neighbouring segments are equal. Fingerprints are keyed by
such pairs of segments, partners in a key are pruned by the chain's third and fourth sums, and what is left gets the full
Hamming check. In a key with over ``dense`` fingerprints no pairs are made: each fingerprint is listed under itself and
all its one-bit neighbours outside the two equal segments, and those under one entry are linked to its smallest. Two
fingerprints within 2 bits always share an entry, and those that share one are within 2 bits, so this is exact as well,
with at most 40 rows a fingerprint.

Nulls and edges. A null text counts as empty. Rows of equal fingerprint are one node, so copies are never expanded into
pairs. Repeated rows get the same component; a null doc_id gets one but never names it. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberlog.llm.common import WORDS, map_arrow, stored, table, utf8_values
from emberlog.operators.components import connected_components

SEED = 42
#: First bit and width of the ring's segments.
RING = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
#: A key with more distinct fingerprints than this is linked by one-bit neighbours instead of pairs.
DENSE = 40
_ONES = [(1 << width) - 1 << first for first, width in RING]


def shingle_hashes(text: bytes | None, size: int) -> np.ndarray:
    """XXH64 of every shingle of a text, repeats included."""
    words = WORDS((text or b"").lower())
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: len(words) - size + 1].tolist(), (ends[size - 1 :] - 1).tolist(), strict=True)
    return np.array([digest(joined[a:b], SEED) for a, b in spans], np.uint64)


def majority(hashes: np.ndarray) -> np.ndarray:
    """Bits set in over half of the rows of ``hashes`` (n, lanes), as one row of lanes."""
    n, lanes = hashes.shape
    total = np.zeros(lanes * 64, np.int64)
    for at in range(0, n, 8192):
        part = np.ascontiguousarray(hashes[at : at + 8192]).view(np.uint8).reshape(-1, lanes * 8)
        total += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * total > n, bitorder="little").view("<u8")


def fingerprint(text: bytes | None, size: int = 3) -> int:
    hashes = shingle_hashes(text, size)
    return int(majority(hashes.reshape(-1, 1))[0]) if len(hashes) else 0


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """doc_id and 64-bit fingerprint (as a signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(x, size) for x in utf8_values(batch.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs.select("doc_id", "text"), run, f"doc_id {kind}, fp long")


def _mask(*segments: int) -> int:
    bits = reduce(lambda a, b: a | b, (_ONES[s % len(RING)] for s in segments))
    return bits - (1 << 64) if bits >> 63 else bits


def _bits(a: Column, b: Column, mask: int) -> Column:
    return F.bit_count(a.bitwiseXOR(b).bitwiseAND(F.lit(mask)))


def links(prints: DataFrame, dense: int = DENSE) -> DataFrame:
    """Edges ``(a, b)`` that connect the distinct longs ``fp`` of ``prints`` within two bits."""
    keyed = prints.select(
        "fp",
        F.explode(F.array(*[F.struct(F.lit(i).alias("start"), F.col("fp").bitwiseAND(F.lit(_mask(i, i + 1))).alias("key")) for i in range(len(RING))])).alias("k"),
    ).select("fp", "k.*")
    sizes = keyed.groupBy("start", "key").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    shared = stored(keyed.join(sizes, ["start", "key"]), "ring")  # most fingerprints share no key
    few, many = shared.where(F.col("n") <= dense), shared.where(F.col("n") > dense)
    left, right = few.select("start", "key", F.col("fp").alias("a")), few.select("start", "key", F.col("fp").alias("b"))

    def chain(start: int) -> Column:
        third = _bits(F.col("a"), F.col("b"), _mask(start + 2)) <= 1
        fourth = _bits(F.col("a"), F.col("b"), _mask(start + 2, start + 3)) <= 1
        return (F.col("start") == start) & third & fourth

    chained = reduce(lambda x, y: x | y, [chain(i) for i in range(len(RING))])
    pairs = left.join(right, ["start", "key"]).where((F.col("a") < F.col("b")) & chained & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2))
    flips = {i: [0] + [_signed(1 << bit) for bit in range(64) if not (_ONES[i] | _ONES[(i + 1) % len(RING)]) >> bit & 1] for i in range(len(RING))}
    flip = reduce(lambda w, i: w.when(F.col("start") == i, F.array(*map(F.lit, flips[i]))), range(1, len(RING)), F.when(F.col("start") == 0, F.array(*map(F.lit, flips[0]))))
    listed = many.select("start", "fp", F.explode(flip).alias("flip")).select("start", "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("near"))
    stars = listed.groupBy("start", "near").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)  # at most 40 fingerprints are one bit from another
    starred = stars.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where(F.col("a") < F.col("b"))
    return pairs.select("a", "b").unionByName(starred).distinct()


def _signed(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits


def near_duplicates(docs: DataFrame, size: int = 3) -> DataFrame:
    """doc_id, fingerprint and component_id (smallest doc_id reachable over links) of every row."""
    prints = stored(fingerprints(docs, size), "fingerprints")
    classes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    nodes = connected_components(links(classes))
    linked = classes.join(nodes, F.col("fp") == F.col("node")).select("fp", "least", "component")
    least = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    moved = linked.join(least, "component").select("fp", "component_id")
    alone = classes.join(nodes.select(F.col("node").alias("fp")), "fp", "left_anti").select("fp", F.col("least").alias("component_id"))
    of_class = stored(moved.unionByName(alone), "components")
    return prints.join(of_class, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_simhash_pigeonring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


# Removal of near copies: wide fingerprints, for similarities at which 64 bits and two differing ones see nothing.

#: 64-bit segments of the wide ring, and sampled seeds of so many shingles each.
LANES, SEEDS, SEED_SHINGLES = 16, 16, 4
#: Leaders that each seed's other holders meet first, and the closest of them that a class is compared with.
LEADERS, CLOSEST = 8, 3
#: Rings prune pairs only where both sets have so many shingles, and from so many standard deviations over the mean.
RING_SHINGLES, RING_DEVIATIONS = 64, 10
#: One text in so many is sampled to order shingles by frequency, and at most so many frequent ones are told apart.
SAMPLED, MOST_FREQUENT = 16, 1 << 19
_LANE = np.array([(0x9E3779B97F4A7C15 * (2 * i + 1)) & (2**64 - 1) | 1 for i in range(LANES + SEEDS)], np.uint64)


def wide_budget(similarity: float, bits: int = 64 * LANES) -> int:
    """Differing bits that sets of this Jaccard similarity have on average, and RING_DEVIATIONS standard deviations."""
    share = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
    return int(bits * share + RING_DEVIATIONS * (bits * share * (1 - share)) ** 0.5)


def _spread(h: np.ndarray, by: np.ndarray) -> np.ndarray:
    x = h[:, None] * by
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def counted_majority(rows: np.ndarray) -> np.ndarray:
    """As ``majority``, by full adders on whole words: three rows of weight w become a sum of w and a carry of 2 w."""
    n, lanes = rows.shape
    if n < 48:
        return majority(rows)
    total, weight = np.zeros(lanes * 64, np.int64), 1
    while len(rows):
        carried = []
        while len(rows) >= 3:
            k = len(rows) // 3
            a, b, c = rows[:k], rows[k : 2 * k], rows[2 * k : 3 * k]
            ab = a ^ b
            carried.append((a & b) | (ab & c))
            rows = np.concatenate([ab ^ c, rows[3 * k :]])
        total += weight * np.unpackbits(np.ascontiguousarray(rows).view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        weight *= 2
        rows = np.concatenate(carried) if carried else rows[:0]
    return np.packbits(2 * total > n, bitorder="little").view("<u8")


def wide_fingerprint(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The wide ring of a text's distinct shingles, and its seeds: hashes of the shingles least under each permutation."""
    order = np.ascontiguousarray(_spread(h, _LANE[LANES:]).T)
    take = min(SEED_SHINGLES, len(h))
    least = np.sort(np.partition(order, take - 1, axis=1)[:, :take], axis=1)
    seed = np.zeros(SEEDS, np.uint64)
    for k in range(take):
        seed = (seed ^ least[:, k]) * np.uint64(0x9E3779B97F4A7C15)
    return counted_majority(_spread(h, _LANE[:LANES])), seed


def prefix(h: np.ndarray, similarity: float, frequent: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The rarest shingles of a sorted set, so many that two sets of at least this similarity have one of them in common.

    Shingles are ordered by (count, hash), one order for all sets. Any order is exact; the counts only keep common
    passages out of the prefixes.
    """
    take = len(h) - int(np.ceil(similarity * len(h) - 1e-9)) + 1
    if not len(frequent):
        return h[:take]
    at = np.minimum(np.searchsorted(frequent, h), len(frequent) - 1)
    seen = np.where(frequent[at] == h, counts[at], 0)
    rare = h[seen == 0]
    return rare[:take] if len(rare) >= take else h[np.lexsort((h, seen))[:take]]


def frequent_shingles(docs: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several of the sampled distinct texts hold, sorted, and by how many; they decide about order only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in utf8_values(batch.column(1)):
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(shingle_hashes(x, size)).view(np.int64))], ["shingle"])

    own = docs.select(text_class(F.col("text")).alias("class"), "text").where(F.pmod("class", F.lit(SAMPLED)) == 0)
    held = map_arrow(own.groupBy("class").agg(F.first("text").alias("text")), run, "shingle long")
    held = stored(held.groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1"), "frequent")
    least, total = 2, 0
    for n, many in sorted(((r["size"], r["n"]) for r in held.groupBy(F.least("n", F.lit(10_000)).alias("size")).agg(F.count("*").alias("n")).collect()), reverse=True):
        if (total := total + many) > MOST_FREQUENT:
            least = n + 1
            break
    rows = held.where(F.col("n") >= least).toPandas()
    shingles = rows["shingle"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(shingles)
    return shingles[order], rows["n"].to_numpy(np.int64)[order]


def wide_fingerprints(docs: DataFrame, size: int, similarity: float) -> DataFrame:
    """doc_id, class (XXH64 of the text as it is), wide ring, seeds, number of shingles and prefix of every row; null where there is no word."""
    frequent, counts = frequent_shingles(docs, size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(x, size)) for x in utf8_values(batch.column(2))]
            rows = [(*wide_fingerprint(h), prefix(h, similarity, frequent, counts)) if len(h) else None for h in sets]
            lists = [pa.array([None if r is None else r[k].view(np.int64) for r in rows], pa.list_(pa.int64())) for k in (0, 1, 2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists, pa.array([len(h) for h in sets], pa.int64())], ["doc_id", "class", "ring", "seeds", "prefix", "n"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    own = docs.select("doc_id", text_class(F.col("text")).alias("class"), "text")
    return map_arrow(own, run, f"doc_id {kind}, class long, ring array<long>, seeds array<long>, prefix array<long>, n long")


def text_class(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _ring_links(budget: int, chain: int = 4) -> Column:
    """Whether rings ``ring_a`` and ``ring_b`` differ in ``budget`` bits at most: chain filter first, then all bits.

    Some segment starts a chain whose running sums stay within their share of the budget; without one there is no need
    to add up the rest.
    """
    differ = F.transform(F.arrays_zip(F.col("ring_a").alias("a"), F.col("ring_b").alias("b")), lambda p: F.bit_count(p["a"].bitwiseXOR(p["b"])))

    def within(d: Column) -> Column:
        def starts(i: Column) -> Column:
            total, found = F.lit(0), F.lit(True)
            for step in range(chain):
                total = total + F.get(d, (i + step) % LANES)
                found = found & (total * LANES <= (step + 1) * budget)
            return found

        return F.exists(F.sequence(F.lit(0), F.lit(LANES - 1)), starts) & (F.aggregate(d, F.lit(0), lambda x, y: x + y) <= budget)

    return F.transform(F.array(differ), within)[0]


def _with_rings(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    end = lambda x: classes.select(F.col("class").alias(x), F.col("ring").alias(f"ring_{x}"), F.col("n").alias(f"n_{x}"))
    return pairs.join(end("a"), "a").join(end("b"), "b")


def _sizes_allow(similarity: float) -> Column:
    return F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * similarity - 1e-9


def leader_pairs(classes: DataFrame, similarity: float) -> DataFrame:
    """Pairs ``(a, b)`` of a class and the closest leaders of its seeds; not complete, but in proportion to the classes.

    A seed's leaders are those holders, one a salt, whose seeds have most holders: the original of a group of copies
    shares more seeds than the copies do among themselves.
    """
    held = stored(classes.where(F.col("seeds").isNotNull()).select("class", F.posexplode("seeds").alias("place", "seed")), "seeds")
    known = held.groupBy("place", "seed").agg(F.count("*").alias("many")).where("many > 1")
    shared = stored(held.join(known, ["place", "seed"]), "held")
    fame = shared.groupBy("class").agg(F.sum("many").alias("fame"))
    salted = shared.join(fame, "class").groupBy("place", "seed", F.pmod(F.xxhash64("class", "place"), F.lit(LEADERS)).alias("salt")).agg(F.max(F.struct("fame", "class"))["class"].alias("leader"))
    leaders = salted.groupBy("place", "seed").agg(F.collect_list("leader").alias("leaders"))
    met = shared.join(leaders, ["place", "seed"]).select(F.col("class").alias("a"), F.explode("leaders").alias("b")).where("a <> b").distinct()
    differ = F.aggregate(F.zip_with("ring_a", "ring_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
    near = _with_rings(met, classes).where(_sizes_allow(similarity)).select("a", F.struct(differ.alias("bits"), "b").alias("to"))
    best = near.groupBy("a").agg(F.slice(F.array_sort(F.collect_list("to")), 1, CLOSEST).alias("to")).select("a", F.explode("to").alias("to"))
    return best.select(F.least("a", "to.b").alias("a"), F.greatest("a", "to.b").alias("b")).distinct()


def _common(n_a: Column, n_b: Column, similarity: float) -> Column:
    """How many shingles sets of these sizes have in common at the least if they are this similar."""
    return F.ceil((n_a + n_b) * (similarity / (1 + similarity)) - 1e-9)


def prefix_pairs(classes: DataFrame, groups: DataFrame, similarity: float) -> DataFrame:
    """All pairs ``(a, b)`` of classes of different groups that can have the similarity.

    They have a prefix shingle in common, sizes that allow it, and room: of the first common shingle in the order of the
    prefixes, as many shingles from there on in either set as have to be common. ``groups`` (node, component) is what is
    linked already; groups meet first, by the bounds of their members, then the members, so that those of one group never
    do.
    """
    of = groups.select(F.col("node").alias("class"), "component")
    own = classes.where("n > 0").select("class", "n", "prefix").join(of, "class", "left")
    held = own.select(F.posexplode("prefix").alias("pos", "shingle"), F.coalesce("component", "class").alias("g"), "class", "n").withColumn("room", F.col("n") - F.col("pos")).repartition("shingle")
    shared = held.groupBy("shingle").agg(F.min("g").alias("lo"), F.max("g").alias("hi")).where("lo < hi").select("shingle")
    held = stored(held.drop("pos").join(shared, "shingle"), "prefixes")
    places = held.groupBy("shingle", "g").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.max("room").alias("room"))
    at = lambda x: places.select("shingle", *[F.col(c).alias(f"{c}_{x}") for c in ("g", "least", "most", "room")])
    near = lambda least, most, n: (F.col(most) >= F.col(n) * similarity - 1e-9) & (F.col(least) * similarity <= F.col(n) + 1e-9)
    enough = lambda x, n_a, n_b: F.col(x) >= _common(F.col(n_a), F.col(n_b), similarity)
    met = at("a").join(at("b"), "shingle").where(
        (F.col("g_a") < F.col("g_b")) & (F.col("most_a") >= F.col("least_b") * similarity - 1e-9) & (F.col("most_b") >= F.col("least_a") * similarity - 1e-9)
        & enough("room_a", "least_a", "least_b") & enough("room_b", "least_a", "least_b")
    )
    end = lambda x: held.select("shingle", F.col("g").alias(f"g_{x}"), F.col("class").alias(x), F.col("n").alias(f"n_{x}"), F.col("room").alias(f"own_{x}"))
    one = met.join(end("a"), ["shingle", "g_a"]).where(near("least_b", "most_b", "n_a") & enough("own_a", "n_a", "least_b") & enough("room_b", "n_a", "least_b"))
    both = one.join(end("b"), ["shingle", "g_b"]).where(_sizes_allow(similarity) & enough("own_a", "n_a", "n_b") & enough("own_b", "n_a", "n_b"))
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def shingle_sets(docs: DataFrame, classes: DataFrame, size: int) -> DataFrame:
    """class and set of shingles of the given classes (class, least), each from the row that names it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(x, size)).view(np.int64) for x in utf8_values(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["class", "shingles"])

    own = docs.select("doc_id", text_class(F.col("text")).alias("class"), "text")
    wanted = classes.select(F.col("class").alias("wanted"), "least")
    found = own.join(wanted, (F.col("class") == F.col("wanted")) & F.col("doc_id").eqNullSafe(F.col("least")), "left_semi")
    return map_arrow(found.select("class", "text"), run, "class long, shingles array<long>").dropDuplicates(["class"])


def similar(docs: DataFrame, classes: DataFrame, pairs: DataFrame, size: int, similarity: float) -> DataFrame:
    """Those pairs ``(a, b)`` whose sets of shingles have at least the Jaccard similarity; rings only prune pairs of long texts."""
    pruned = _with_rings(pairs, classes).where((F.least("n_a", "n_b") < RING_SHINGLES) | _ring_links(wide_budget(similarity)))
    pruned = stored(pruned.select("a", "b", "n_a", "n_b"), "candidates")
    ends = pruned.select(F.col("a").alias("class")).unionByName(pruned.select(F.col("b").alias("class"))).distinct()
    sets = stored(shingle_sets(docs, classes.select("class", "least").join(ends, "class", "left_semi"), size), "sets")
    end = lambda x: sets.select(F.col("class").alias(x), F.col("shingles").alias(f"of_{x}"))
    common = F.size(F.array_intersect("of_a", "of_b"))
    return pruned.join(end("a"), "a").join(end("b"), "b").where(common >= (F.col("n_a") + F.col("n_b") - common) * similarity - 1e-9).select("a", "b")


def near_copy_links(docs: DataFrame, classes: DataFrame, size: int, similarity: float) -> DataFrame:
    """Edges ``(a, b)`` whose components are those of all pairs of classes with at least the similarity.

    Leaders link most of each group by rows in proportion to it; then every pair across groups that has a prefix shingle
    in common is compared.
    """
    near = stored(similar(docs, classes, leader_pairs(classes, similarity), size, similarity), "near")
    groups = stored(connected_components(near), "groups")
    return near.unionByName(stored(similar(docs, classes, prefix_pairs(classes, groups, similarity), size, similarity), "far"))


def drop_near_copies(docs: DataFrame, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of each group of copies and near copies: the one of smallest doc_id. All columns, under any names, and other rows stay.

    Groups are the connected components over pairs of texts whose sets of ``size``-word shingles have at least the given
    Jaccard similarity, decided on the sets. Texts without words are copies only of equal ones.
    """
    prints = stored(wide_fingerprints(docs, size, similarity), "rings")
    classes = stored(prints.groupBy("class").agg(F.min("doc_id").alias("least"), *[F.first(c).alias(c) for c in ("ring", "seeds", "prefix", "n")]), "classes")
    nodes = connected_components(near_copy_links(docs, classes, size, similarity))
    linked = classes.join(nodes, F.col("class") == F.col("node")).select("class", "least", "component")
    best = linked.groupBy("component").agg(F.min_by("class", F.struct(F.col("least").isNull(), "least", "class")).alias("class"))
    stays = classes.select("class", "least").join(nodes.select(F.col("node").alias("class")), "class", "left_anti").unionByName(linked.join(best, ["component", "class"]).select("class", "least"))
    kept, least = _free_name(docs, "class"), _free_name(docs, "least")
    stays = stored(stays.select(F.col("class").alias(kept), F.col("least").alias(least)), "stays")
    own = docs.join(stays, (text_class(docs["text"]) == stays[kept]) & docs["doc_id"].eqNullSafe(stays[least]), "left_semi")
    repeated = prints.groupBy("doc_id", "class").agg(F.count("*").alias("n")).where(F.col("n") > 1).select("doc_id", "class")
    if not repeated.limit(1).count():
        return own
    # Rows of equal id and text may differ elsewhere: of these the one whose values sort first as JSON stays.
    names, row, place = docs.columns, _free_name(docs, "row"), _free_name(docs, "place")
    told = own.withColumn(row, F.to_json(F.struct(*[F.col(f"`{c}`") for c in names])))
    first = W.partitionBy("doc_id", text_class(F.col("text"))).orderBy(row)
    return told.withColumn(place, F.row_number().over(first)).where(F.col(place) == 1).select(*[F.col(f"`{c}`") for c in names])


def _free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    while name in df.columns:
        name += "_"
    return name
