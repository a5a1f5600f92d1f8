"""MinHash near-duplicates by min-max hashing.

A document is the set of its distinct word shingles. Each of 48 permutations of the 64-bit
shingle hashes gives two values of a set, its least and its greatest hash; both agree for
two sets as often as the sets overlap, so 96 signature values cost 48 hash evaluations a
shingle. The values make 24 bands of four (two permutations each). Sets at the least
similarity of 0.85 share no band with a probability of about 2e-8 (`missed`), more similar
ones more rarely. Sets that share a band are candidates, whatever their number.

Links are confirmed on the full sets. Documents with equal sets are one class before the
bands are made, so copies cost nothing there. In a bucket (the classes that share a band)
pairs are not written out. First every class meets two leaders of each of its buckets;
confirmed pairs become links, links components. Then, in buckets with more than one
component, classes outside the bucket's largest component meet the classes of other
components, in blocks of bounded size: once to take each class's best partner in each other
component, and once, after those links, all that is left. Buckets and classes with very
many partners are dealt over several tasks.

What meets is first held against odd sketches: bit maps, at least two bits a shingle, in
which every shingle flips one bit. Two sketches differ in no more bits than the sets have
shingles that are in one of them alone, so a pair that the sketches rule out is no link: the
filter loses nothing.

Defined results: null and empty texts and texts of white space alone have no shingles and
are linked with nothing: their component is their own doc_id, also where rows repeat it.
Fewer words than a shingle has make one shingle. Repeated rows are one class. A null doc_id
takes part but is never a component_id unless no row of its component has an id. Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.components import components
from tidewire.llm.words import solid_words
from tidewire.plans.storage import stage

PERMUTATIONS, ROWS = 48, 4
BANDS = 2 * PERMUTATIONS // ROWS
LEADERS = 2
#: Members of a bucket, or partners of a class, that one task gets.
PART = 2048
_RNG = np.random.default_rng(20240)
_FACTORS = _RNG.integers(0, 1 << 63, PERMUTATIONS, np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _RNG.integers(0, 1 << 63, PERMUTATIONS, np.uint64)
_MIX = _RNG.integers(0, 1 << 63, (BANDS, ROWS), np.uint64) * np.uint64(2) + np.uint64(1)
_CHUNK = 1 << 14


def missed(similarity: float) -> float:
    """The probability that two large sets of this similarity share no band."""
    return (1 - similarity**ROWS) ** BANDS


def shingles(text: str | None, size: int) -> np.ndarray:
    """The distinct 64-bit hashes of a text's word shingles, ascending."""
    words = solid_words(text)
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = [x - 1 for x in accumulate(len(w) + 1 for w in words)]
    starts = [0] + [x + 1 for x in ends[:-1]]
    hash_of = xxhash.xxh64_intdigest
    found = {hash_of(joined[a:b], 42) for a, b in zip(starts, ends[size - 1 :])} or {hash_of(joined, 42)}
    return np.sort(np.fromiter(found, np.uint64, len(found)))


def extremes(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The least and greatest value of each non-empty set under each permutation."""
    low = np.full((len(sets), PERMUTATIONS), np.iinfo(np.uint64).max, np.uint64)
    high = np.zeros((len(sets), PERMUTATIONS), np.uint64)
    sizes = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    values = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    for at in range(0, len(values), _CHUNK):
        mine = owner[at : at + _CHUNK]
        heads = np.flatnonzero(np.r_[True, mine[1:] != mine[:-1]])
        permuted = values[at : at + _CHUNK, None] * _FACTORS + _SHIFTS
        own = mine[heads]
        low[own] = np.minimum(low[own], np.minimum.reduceat(permuted, heads))
        high[own] = np.maximum(high[own], np.maximum.reduceat(permuted, heads))
    return low, high


def bands_of(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """One 64-bit key per row and band: two permutations with their least and greatest values."""
    values = np.stack([low, high], 2).reshape(len(low), BANDS, ROWS)
    mixed = ((values ^ (values >> np.uint64(29))) * _MIX).sum(2, dtype=np.uint64)
    mixed ^= mixed >> np.uint64(32)
    return (mixed * np.uint64(0x9E3779B97F4A7C15)) ^ np.arange(BANDS, dtype=np.uint64)


def sketch(found: np.ndarray) -> np.ndarray:
    """The odd sketch of a set: bytes, a power of two of them, at least two bits for each member."""
    bits = 64 << max(0, len(found) - 1 >> 5).bit_length()
    odd = np.bincount((found & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little")


def folded(sketches: np.ndarray, size: int) -> np.ndarray:
    """Sketches (a row each) brought down to fewer bytes."""
    while sketches.shape[1] > size:
        sketches = sketches[:, : sketches.shape[1] // 2] ^ sketches[:, sketches.shape[1] // 2 :]
    return sketches


def _by_length(sketches: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places, matrix) of the sketches of each length."""
    lengths = np.array([len(x) for x in sketches])
    places = [np.flatnonzero(lengths == n) for n in np.unique(lengths)]
    return [(at, np.frombuffer(b"".join([sketches[i] for i in at]), np.uint8).reshape(len(at), -1)) for at in places]


def apart(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Differing bits of sketches of any two lengths; rows are paired as numpy pairs them."""
    size = min(one.shape[-1], two.shape[-1])
    flat = [folded(x.reshape(-1, x.shape[-1]), size).view(np.uint64).reshape(*x.shape[:-1], -1) for x in (one, two)]
    return np.bitwise_count(flat[0] ^ flat[1]).sum(-1, dtype=np.int64)


def allowed(differ: np.ndarray, sizes: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of these sizes in sum may be links if at least so many members are in one alone."""
    return (100 + percent) * differ <= (100 - percent) * sizes


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, text_hash, n, digest, bands, sketch) per document; one narrow pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, held, sets = 0, 0, []
            for i, text in enumerate(batch.column("text")):
                sets.append(shingles(text.as_py(), size))
                held += len(sets[-1])
                if held > _CHUNK * 16 or i == batch.num_rows - 1:
                    yield pack(batch.slice(first, len(sets)), sets)
                    first, held, sets = i + 1, 0, []

    def pack(batch: pa.RecordBatch, sets: list[np.ndarray]) -> pa.RecordBatch:
        keys = bands_of(*extremes(sets)).view(np.int64)
        bands = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * BANDS, pa.int32()), pa.array(keys.ravel()))
        return pa.RecordBatch.from_pydict(
            {
                "doc_id": batch.column("doc_id"),
                "text_hash": batch.column("text_hash"),
                "n": pa.array([len(s) for s in sets], pa.int64()),
                "digest": pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                "bands": bands,
                "sketch": pa.array([sketch(s).tobytes() for s in sets], pa.binary()),
            }
        )

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInArrow(run, f"doc_id {kind}, text_hash long, n long, digest binary, bands array<long>, sketch binary")


def _sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(node, members) of the classes wanted (node, digest, rep): the full sets, made once more from their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sets, held = [], [], 0
            for node, digest, text in zip(batch.column("node"), batch.column("digest"), batch.column("text")):
                found = shingles(text.as_py(), size)
                if xxhash.xxh3_128_digest(found.tobytes()) == digest.as_py():
                    nodes.append(node.as_py())
                    sets.append(found)
                    held += len(found)
                if held > _CHUNK * 16:
                    yield pack(nodes, sets)
                    nodes, sets, held = [], [], 0
            if nodes:
                yield pack(nodes, sets)

    def pack(nodes: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
        ends = np.cumsum([0] + [len(s) for s in sets])
        members = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sets).view(np.int64)))
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), members], ["node", "members"])

    named = wanted.select("node", "digest", F.col("rep")["doc_id"].alias("rep_id"), F.col("rep")["text_hash"].alias("rep_hash"))
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    same = (F.col("text_hash") == F.col("rep_hash")) & F.col("doc_id").eqNullSafe(F.col("rep_id"))
    made = texts.join(named, same).select("node", "digest", "text").mapInArrow(run, "node long, members array<long>")
    return made.dropDuplicates(["node"])


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are links on their full sets.

    A class with very many partners is dealt over several tasks, each with its set once."""
    for side, other in (("a", "b"), ("b", "a")):
        parts = stage(pairs.groupBy(side).agg(F.ceil(F.count("*") / PART).alias("parts")), "partners")
        dealt = pairs.join(parts.where("parts > 1"), side, "left")
        dealt = dealt.withColumn("part", F.coalesce(F.pmod(F.xxhash64(other), "parts"), F.lit(0).cast("long"))).drop("parts")
        held = sets.join(parts, sets["node"] == parts[side])
        held = held.select(side, F.col("members").alias(f"set_{side}"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
        pairs = dealt.join(held, [side, "part"]).drop("part")
        if side == "a":
            pairs = stage(pairs, "halves")
    both = F.size(F.array_intersect("set_a", "set_b")).cast("long")
    rows = pairs.select("a", "b", both.alias("both"), (F.size("set_a") + F.size("set_b")).alias("n"))
    return rows.where(F.lit(100) * F.col("both") >= F.lit(percent) * (F.col("n") - F.col("both"))).select("a", "b")


def _open(members: DataFrame, roots: DataFrame) -> DataFrame:
    """The bucket members with their component, of buckets that still hold more than one."""
    rooted = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = rooted.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    return rooted.join(mixed.select("bucket"), "bucket", "left_semi")


def _led(members: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of every class with the leaders of its buckets that sizes and sketches allow."""
    chosen = [F.min_by(F.struct("node", "n"), F.xxhash64("node", F.lit(i))) for i in range(LEADERS)]
    leaders = members.groupBy("bucket").agg(F.array_distinct(F.array(*chosen)).alias("leaders"))
    met = members.join(leaders, "bucket").select("node", "n", F.explode("leaders").alias("leader"))
    fits = 100 * F.least("n", "leader.n") >= percent * F.greatest("n", "leader.n")
    pairs = met.where((F.col("node") != F.col("leader.node")) & fits)
    pairs = pairs.select(F.greatest("node", "leader.node").alias("a"), F.least("node", "leader.node").alias("b")).distinct()
    for side in ("a", "b"):
        pairs = pairs.join(classes.select(F.col("node").alias(side), F.col("n").alias(f"n_{side}"), F.col("sketch").alias(f"sketch_{side}")), side)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            may = np.zeros(batch.num_rows, bool)
            sizes = batch.column("n_a").to_numpy() + batch.column("n_b").to_numpy()
            others = batch.column("sketch_b").to_pylist()
            for at, mine in _by_length(batch.column("sketch_a").to_pylist()):
                for there, theirs in _by_length([others[i] for i in at]):
                    may[at[there]] = allowed(apart(mine[there], theirs), sizes[at[there]], percent)
            yield batch.select(["a", "b"]).filter(pa.array(may))

    return pairs.select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b").mapInArrow(run, "a long, b long")


def _across(members: DataFrame, classes: DataFrame, percent: int, best: bool) -> DataFrame:
    """Pairs (a, b) of different components in one bucket that sizes and sketches allow: all of them, or
    for each class that meets a component in a block the best one."""
    by_root = members.groupBy("bucket", "root").agg(F.count("*").alias("k"))
    facts = by_root.groupBy("bucket").agg(F.max_by("root", F.struct("k", "root")).alias("main"), F.sum("k").alias("all"), F.max("k").alias("most"))
    parts, visits = F.ceil(F.col("all") / PART), F.ceil((F.col("all") - F.col("most")) / PART)
    facts = stage(facts.select("bucket", "main", parts.alias("parts"), F.greatest(visits, F.lit(1)).alias("visits")), "buckets")
    rows = members.join(classes.select("node", "sketch"), "node").join(facts, "bucket")

    def every(upto: str):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(upto) - 1))

    columns = ["bucket", "i", "j", "home", "node", "root", "n", "sketch"]
    home = rows.withColumn("i", F.pmod(F.xxhash64("node"), "parts")).withColumn("j", every("visits")).withColumn("home", F.lit(True))
    guest = rows.where("root <> main").withColumn("j", F.pmod(F.xxhash64("node", F.lit(1)), "visits")).withColumn("i", every("parts"))
    dealt = home.select(columns).union(guest.withColumn("home", F.lit(False)).select(columns))
    block = ["bucket", "i", "j"]
    dealt = dealt.repartition(*block).sortWithinPartitions(*block, "home", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in blocks(batches):
            for a, b in _meet(some, percent, best):
                yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        """The rows of each block: at most PART homes and as many guests, by their expected number."""
        held, now = [], None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in block], 1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
            for first, last in zip(cuts, cuts[1:]):
                if first == last:
                    continue
                if held and tuple(keys[first]) != now:
                    yield pa.Table.from_batches(held)
                    held = []
                now = tuple(keys[first])
                held.append(batch.slice(first, last - first))
        if held:
            yield pa.Table.from_batches(held)

    return dealt.mapInArrow(run, "a long, b long").distinct()


def _meet(block: pa.Table, percent: int, best: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (greater, lesser node) of homes and guests of other components in one block."""
    home = block.column("home").to_numpy()
    node, root, n = (block.column(c).to_numpy() for c in ("node", "root", "n"))
    sketches = block.column("sketch").to_pylist()
    at_home, guests = np.flatnonzero(home), np.flatnonzero(~home)
    found: dict[tuple[int, int], tuple[int, int]] = {}
    for here, mine in _by_length([sketches[i] for i in at_home]):
        for there, theirs in _by_length([sketches[i] for i in guests]):
            if max(mine.shape[1], theirs.shape[1]) > 4 * min(mine.shape[1], theirs.shape[1]):
                continue  # sizes that differ so much are no links
            step = max(1, (1 << 24) // max(1, mine.shape[1] * len(here)))
            for k in range(0, len(there), step):
                g, h = guests[there[k : k + step]], at_home[here]
                differ = apart(mine[None, :, :], theirs[k : k + step][:, None, :])
                sizes = n[g][:, None] + n[h][None, :]
                may = allowed(differ, sizes, percent) & (root[g][:, None] != root[h][None, :])
                may &= 100 * np.minimum(n[g][:, None], n[h][None, :]) >= percent * np.maximum(n[g][:, None], n[h][None, :])
                x, y = np.nonzero(may)
                one, two = node[g[x]], node[h[y]]
                if not best:
                    if len(one):
                        yield np.maximum(one, two), np.minimum(one, two)
                    continue
                for value, a, b, r in zip(differ[x, y].tolist(), one.tolist(), two.tolist(), root[h[y]].tolist()):
                    if (a, r) not in found or (value, b) < found[a, r]:
                        found[a, r] = (value, b)
    if found:
        one, two = np.array([a for a, _ in found]), np.array([b for _, b in found.values()])
        yield np.maximum(one, two), np.minimum(one, two)


def near_duplicates(docs: DataFrame, shingle: int = 3, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row of docs: component_id is the smallest doc_id among
    all rows reachable by links, where 100 * intersection >= percent * union of the shingle sets."""
    docs = docs.select("doc_id", "text")
    prints = stage(signatures(docs, shingle), "signatures")
    full = prints.where("n > 0")
    rep = F.any_value(F.struct("doc_id", "text_hash")).alias("rep")
    same = full.groupBy("digest").agg(F.min("doc_id").alias("first"), rep, *(F.any_value(c).alias(c) for c in ("n", "bands", "sketch")))
    classes = stage(same.withColumn("node", F.monotonically_increasing_id()), "classes")

    banded = classes.select("node", "n", F.explode("bands").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.count("*").alias("k")).where("k > 1").select("bucket")
    members = stage(banded.join(shared, "bucket", "left_semi"), "members")
    wanted = classes.join(members.select("node").distinct(), "node", "left_semi")
    sets = stage(_sets(docs, wanted, shingle), "sets")

    links = [stage(_confirmed(stage(_led(members, classes, percent), "pairs"), sets, percent), "links")]
    for best in (True, False):
        roots = stage(components(reduce(DataFrame.union, links)), "roots")
        pairs = stage(_across(stage(_open(members, roots), "open"), classes, percent, best), "pairs")
        if pairs.isEmpty():
            break
        links.append(stage(_confirmed(pairs, sets, percent), "links"))
        if links[-1].isEmpty() and not best:
            break
    else:
        roots = components(reduce(DataFrame.union, links))

    named = classes.select("node", "digest", "first").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = stage(named, "named")
    smallest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    found = stage(named.join(smallest, "root").select("digest", "component_id"), "components")
    linked = full.select("doc_id", F.col("n").alias("n_shingles"), "digest").join(found, "digest").drop("digest")
    alone = prints.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone)
