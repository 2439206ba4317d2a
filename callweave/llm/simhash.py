"""SimHash fingerprints and the documents they link."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bitslice import close_pairs, join_runs
from .common import BROADCAST_ROWS, passing, slices, spread_join, written
from .components import components

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Fingerprints that share a key and are compared within a task; keys of more take the exact way of `_balls`.
MOST_IN_KEY = 1024


def _ones(words: np.ndarray) -> np.ndarray:
    """How often each bit is set in the rows of words."""
    bits = np.unpackbits(np.ascontiguousarray(words).view(np.uint8).reshape(len(words), -1), axis=1, bitorder="little")
    whole = len(bits) // 255 * 255
    found = bits[whole:].sum(axis=0, dtype=np.uint8).astype(np.int64)
    return found + bits[:whole].reshape(-1, 255, bits.shape[1]).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64) if whole else found


def _shingle_hashes(text: str, size: int) -> Iterator[np.ndarray]:
    """XXH64 of the text's shingles, some at a time."""
    import xxhash

    words = text.encode().translate(_LOWER).split()
    if not words:
        return
    joined = b" ".join(words)
    n = max(1, len(words) - size + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
    last = ends[size - 1 :].tolist() if len(words) >= size else [len(joined)]
    of = xxhash.xxh64_intdigest
    for at in range(0, n, 65536):
        yield np.array([of(joined[a:b], 42) for a, b in zip(starts[at : at + 65536], last[at : at + 65536], strict=True)], "<u8")


def fingerprint(text: str, size: int) -> int:
    """The SimHash of a text's shingles: a bit is set if it is set in over half of their XXH64."""
    n, ones = 0, np.zeros(64, np.int64)
    for hashes in _shingle_hashes(text, size):
        n += len(hashes)
        ones += _ones(hashes)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


#: Rows of whole keys that a task compares at once.
AT_ONCE = 1 << 15
#: Words of a wide fingerprint, and odd constants that make each from a shingle's hash.
WIDE = 8
_TURNS = [(2 * i + 1) * 0x9E3779B97F4A7C15 % 2**64 for i in range(WIDE)]


def shingle_set(text: str, size: int) -> np.ndarray:
    """XXH64 of the distinct shingles of a text, in order."""
    return np.unique(np.concatenate([np.zeros(0, "<u8"), *_shingle_hashes(text, size)]))


def _wide(hashes: np.ndarray) -> np.ndarray:
    """A SimHash of WIDE words over distinct shingle hashes."""
    ones = np.zeros(64 * WIDE, np.int64)
    for at in range(0, len(hashes), 16384):
        words = hashes[at : at + 16384, None] + np.array(_TURNS, np.uint64)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            words = (words ^ (words >> np.uint64(shift))) * np.uint64(factor)
        ones += _ones(words ^ (words >> np.uint64(31)))
    return np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")


def fingerprints(docs: DataFrame, size: int = 3, id_col: str = "doc_id", text_col: str = "text", tag: Column | None = None) -> DataFrame:
    """(id, tag, fp): the 64-bit fingerprint, as a signed long, of every whole text.

    A-Z are lower-cased; words are separated by ASCII white space; shingles are `size` words, repeats
    included. Fewer words are one shingle; no words (also a null text) give fingerprint 0. tag is carried along.
    """
    kind = docs.select(id_col).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            made = np.array([fingerprint(t, size) for t in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("tag"), pa.array(made.view(np.int64))], names=["id", "tag", "fp"])

    tag = F.lit(None) if tag is None else tag
    rows = docs.select(F.col(id_col).alias("id"), tag.cast("string").alias("tag"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, tag string, fp long")


def _segments(radius: int) -> tuple[int, int]:
    """Segments of the fingerprint, and how many of them two fingerprints within the radius must share at least."""
    parts = radius + 2
    return parts, parts - radius


def _keys(nodes: DataFrame, radius: int) -> DataFrame:
    """(key, fp, id): a row for each choice of segments that fingerprints within the radius may share."""
    from itertools import combinations

    parts, shared = _segments(radius)
    bounds = [64 * i // parts for i in range(parts + 1)]
    keys = []
    for table, chosen in enumerate(combinations(range(parts), shared)):
        mask = sum(((1 << (bounds[i + 1] - bounds[i])) - 1) << bounds[i] for i in chosen)
        signed = mask - (1 << 64) if mask >> 63 else mask
        keys.append(F.xxhash64(F.lit(table), F.col("fp").bitwiseAND(F.lit(signed))))
    return nodes.select(F.explode(F.array(*keys)).alias("key"), "fp", "id")


def _balls(nodes: DataFrame, radius: int) -> DataFrame:
    """(a, b): links that connect just what the radius connects, for any number of fingerprints.

    Two fingerprints are within 2r bits if and only if some value is within r bits of both, so each is
    dealt to all values within half the radius; a value gathers no more fingerprints than it has such
    neighbours itself. An odd radius takes one value more on one side.
    """
    from itertools import combinations

    def flips(most: int) -> list[int]:
        masks = [sum(1 << b for b in c) for k in range(most + 1) for c in combinations(range(64), k)]
        return [m - (1 << 64) if m >> 63 else m for m in masks]

    def dealt(most: int) -> DataFrame:
        return nodes.select("id", F.explode(F.transform(F.array(*map(F.lit, flips(most))), lambda m: F.col("fp").bitwiseXOR(m))).alias("value"))

    low, high = radius // 2, radius - radius // 2
    if low == high:
        held = dealt(low).groupBy("value").agg(F.collect_set("id").alias("ids")).where(F.size("ids") > 1)
        return held.select(F.array_min("ids").alias("a"), F.explode("ids").alias("b")).where("a <> b")
    near = dealt(low).groupBy("value").agg(F.collect_set("id").alias("x"))
    far = dealt(high).groupBy("value").agg(F.collect_set("id").alias("y"))
    met = near.join(far, "value").select(F.explode("x").alias("a"), "y")
    return met.select("a", F.explode("y").alias("b")).where("a < b").distinct()


def links(nodes: DataFrame, radius: int = 2, most: int = MOST_IN_KEY) -> DataFrame:
    """(a, b): pairs of ids that connect all nodes (id, fp) whose fingerprints differ in at most radius bits.

    Nodes have distinct fingerprints. Candidates share a key of whole segments. Tasks hold the
    runs of equal keys of a few batches and compare them bit-sliced; of a run they hand on only links to
    the least member that its pairs connect, not all pairs. Keys held by more than `most` fingerprints, or
    by a noticeable share of all, leave for `_balls` with what they hold.
    """
    keyed = _keys(nodes, radius)
    total = nodes.count()
    hot = keyed.groupBy("key").count().where(F.col("count") > max(most, total // 512)).select("key")
    hot = written(hot, "hot-keys")
    # At most 512 keys of each table of segments can be that hot.
    marked = keyed.join(F.broadcast(hot.withColumn("hot", F.lit(True))), "key", "left")
    apart = marked.where("hot").select("id", "fp").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held_fp, held_id = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        passing = None

        def compared(key, fp, ids):
            change = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
            size = np.diff(np.concatenate([np.flatnonzero(change), [len(key)]]))
            own = np.repeat(size, size)
            fp, ids, run_of = fp, ids, np.cumsum(change)
            out_a, out_b = [], []
            low = 2
            while low <= most:
                pick = (own >= low) & (own < 2 * low)
                if pick.any():
                    f, i, r = fp[pick].view(np.uint64), ids[pick], run_of[pick]
                    left, right = close_pairs(f, r, radius)
                    least = join_runs(len(f), left, right)
                    moved = np.flatnonzero(least != np.arange(len(f)))
                    out_a.append(i[least[moved]])
                    out_b.append(i[moved])
                low *= 2
            a = np.concatenate([*out_a, np.zeros(0, np.int64)])
            b = np.concatenate([*out_b, np.zeros(0, np.int64)])
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.nulls(len(a), pa.int64())], names=["a", "b", "fp"])

        def passed(fp, ids):
            return pa.RecordBatch.from_arrays([pa.array(ids), pa.nulls(len(ids), pa.int64()), pa.array(fp)], names=["a", "b", "fp"])

        for batch in batches:
            key, fp, ids = (np.concatenate([h, batch.column(c).to_numpy()]) for h, c in ((held_key, "key"), (held_fp, "fp"), (held_id, "id")))
            if passing is not None:
                go = key == passing
                if go.any():
                    yield passed(fp[go], ids[go])
                key, fp, ids = key[~go], fp[~go], ids[~go]
            if not len(key):
                held_key, held_fp, held_id = key, fp, ids
                continue
            last = int(np.searchsorted(key, key[-1]))
            start = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1])
            size = np.diff(np.concatenate([start, [len(key)]]))
            if len(key) - last > most:
                passing, keep = key[-1], len(key)
            else:
                passing, keep = None, last
            large = np.repeat(size > most, size)[:keep]
            if large.any():
                yield passed(fp[:keep][large], ids[:keep][large])
            whole = ~large
            yield compared(key[:keep][whole], fp[:keep][whole], ids[:keep][whole])
            held_key, held_fp, held_id = key[keep:], fp[keep:], ids[keep:]
        if len(held_key):
            yield compared(held_key, held_fp, held_id)

    rows = marked.where("hot is null").select("key", "fp", "id").repartition("key").sortWithinPartitions("key", "fp")
    made = written(rows.mapInArrow(run, "a long, b long, fp long"), "key-links")
    apart = written(apart.unionByName(made.where("b is null").select(F.col("a").alias("id"), "fp")).distinct(), "hot-nodes")
    return made.where("b is not null").select("a", "b").unionByName(_balls(apart, radius))


def near_groups(docs: DataFrame, size: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text", most: int = MOST_IN_KEY, tag: Column | None = None) -> DataFrame:
    """One row per input row: id, fingerprint (hex), component_id (and tag, if one is given).

    Documents are linked when their fingerprints differ in at most radius bits; component_id is the
    smallest id that links reach, the row's own included. Texts without words have fingerprint zero and
    are linked like others. Rows whose id is null link nothing; they get the component of rows with the same fingerprint, null
    if there is none. Repeated rows are rows like others. No rows give no rows; other columns are dropped.
    Ids are integers.

    Exact copies and equal fingerprints are one node from the start, so large groups of copies cost one row.
    """
    base = written(fingerprints(docs, size, id_col, text_col, tag).withColumn("hex", F.lpad(F.lower(F.hex("fp")), 16, "0")), "fingerprints")
    nodes = written(base.groupBy("fp", "hex").agg(F.min("id").cast("long").alias("least"), F.count("*").alias("size")), "nodes")
    # A node goes by its fingerprint, as an id may belong to several.
    found = components(links(nodes.where("least is not null").select(F.col("fp").alias("id"), "fp"), radius, most))
    own = nodes.join(found.withColumnRenamed("id", "fp"), "fp", "left").withColumn("k", F.coalesce("component", "fp").cast("string"))
    own = written(own.select("hex", "size", "least", "k"), "components")
    least = written(own.groupBy("k").agg(F.min("least").alias("component_id"), F.count("*").alias("n")), "least")
    named = spread_join(own, least, "k", "n", F.col("hex")).select("hex", "size", "component_id")
    out = spread_join(base.select("id", "tag", "hex"), written(named, "named"), "hex", "size", F.col("id"))
    return out.select(F.col("id").alias(id_col), F.col("hex").alias("fingerprint"), "component_id", *(["tag"] if tag is not None else []))


def differing(similarity: float, slack: float = 7.7) -> int:
    """Bits of a wide fingerprint that sets of this Jaccard similarity differ in, and `slack` standard deviations more.

    The slack is for short texts: sets of four and five that share four (0.8) differ in 96 of 512 bits on average, where long
    ones differ in 78, and it leaves these five deviations too. What is within the bits is a candidate and no more.
    """
    share = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    bits = 64 * WIDE
    return int(bits * share + slack * np.sqrt(bits * share * (1 - share)))


#: Nodes that share a band key and are compared within a task; keys of more go to `hot_links`.
MOST_IN_BAND = 64
#: Rounds of pivots for those, and rows of a key that a task then holds.
PIVOTS = 3
SLICE = 8192
#: Shingles of the rows of a slice, so that long texts make smaller ones.
SLICE_HASHES = 1 << 22
#: Members of a slice whose sets a row is compared with at once.
NEAR = 64
#: Least hashes in a band: pairs of similarity s share one with the chance s ** BAND, whatever the number of documents.
BAND = 5


def bands(similarity: float, missed: float = 0.001) -> int:
    """So many bands that a pair of this very similarity shares no key with the chance `missed` at most."""
    return int(np.ceil(np.log(missed) / np.log(1 - similarity**BAND)))


def band_keys(hashes: np.ndarray, tables: int) -> np.ndarray:
    """A key in each band: of so many random orders of the set's hashes, the first of each. No hashes are a set like others."""
    rng = np.random.default_rng(11)
    turn, factor = rng.integers(0, 2**64, (2, tables * BAND), np.uint64)
    least = np.full(tables * BAND, 2**64 - 1, np.uint64)
    for at in range(0, len(hashes), 1024):
        words = (hashes[at : at + 1024] ^ turn[:, None]) * (factor | np.uint64(1))[:, None]
        least = np.minimum(least, (words ^ (words >> np.uint64(32))).min(axis=1))
    keys = np.arange(tables, dtype=np.uint64)
    for own in least.reshape(tables, BAND).T:
        keys = (keys ^ own) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(29)
    return keys.view(np.int64)


def alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b): the pairs of nodes whose sets of shingle hashes have this Jaccard similarity at least.

    sets: (node, shingles), the upper halves of the distinct hashes, any number of rows for a node; two of n shingles share
    one with a chance of n * n / 2 ** 33, which moves the similarity by less than 1 / n. A node in many pairs is broadcast to them.
    """
    pairs = written(pairs.select(F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b")).distinct(), "pairs")
    degrees = written(pairs.select(F.explode(F.array("a", "b")).alias("k")).groupBy("k").agg(F.count("*").alias("degree")), "degrees")
    few = degrees.count() <= BROADCAST_ROWS
    own = sets.withColumn("k", F.col("node").cast("string")).join(F.broadcast(degrees) if few else degrees, "k")
    own = written(own.groupBy("k").agg(F.first("degree").alias("degree"), F.first("shingles").alias("shingles")), "sets")
    found = pairs
    for end, other in (("a", "b"), ("b", "a")):
        found = spread_join(found, own.select(F.col("k").alias(end), F.col("degree").alias(f"n_{end}"), F.col("shingles").alias(f"set_{end}")), end, f"n_{end}", F.col(other))

    sized = found.select("a", "b", F.size(F.array_intersect("set_a", "set_b")).alias("both"), (F.size("set_a") + F.size("set_b")).alias("sizes"))
    near = sized.where(F.col("both") >= similarity * (F.col("sizes") - F.col("both")) - 1e-9)
    return near.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))


def _labelled(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """nodes with the component that the links found so far give each, itself if none."""
    own = components(found).withColumnRenamed("id", "node")
    return nodes.drop("component").join(own, "node", "left").withColumn("component", F.coalesce("component", "node"))


def hot_links(hot: DataFrame, nodes: DataFrame, sets: DataFrame, found: DataFrame, similarity: float, rounds: int = PIVOTS, part: int = SLICE) -> DataFrame:
    """Links, those found already included, that connect what all pairs of the similarity that share a hot key connect.

    hot: (key, node, w0, ...), the rows of keys that many nodes share; nodes: (node, w0, ...). In a round each key's rows are held
    against one pivot, which joins most of a group of near copies at a comparison each. What the rounds leave apart from
    a key's largest component is then compared with every row of the key in another component, in slices of a
    key's rows dealt to as many tasks; a slice hands on only links that join components, so no more than it has rows.
    """
    spark = hot.sparkSession
    cols, radius = [c for c in nodes.columns if c.startswith("w")], differing(similarity)
    total = hot.count()

    def parted(rows: DataFrame) -> DataFrame:
        """Rows of each key that aren't in its largest component; counted by key and component, then by key."""
        each = rows.groupBy("key", "component").agg(F.count("*").alias("n"))
        main = each.groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.sum("n").alias("size"), F.count("*").alias("parts"))
        main = written(main.where("parts > 1").select(F.col("key").cast("string").alias("k"), "main", "size"), "main")
        return spread_join(rows.withColumn("k", F.col("key").cast("string")), main, "k", "size", F.col("node"), total=total).where("main is not null")

    def labelled(found: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The components' stars, which stand for the links so far, and the hot rows with their components."""
        with passing(spark):
            own = components(found)
            stars = written(own.select(F.col("id").alias("a"), F.col("component").alias("b")), "stars", keep=True)
            named = nodes.select("node").join(own.withColumnRenamed("id", "node"), "node", "left").withColumn("component", F.coalesce("component", "node"))
            return stars, written(hot.join(named, "node"), "hot-rows", keep=True)

    def met(rows: DataFrame, turn: int) -> DataFrame | None:
        """Links between a pivot of each key and the key's rows in other components; None once no key has several."""
        apart = written(parted(rows), "apart")
        # The first pivot is the node of the least hash, the same in most keys of a group; later ones come from what is apart.
        order = F.xxhash64("node", F.lit(turn))
        pivots = apart.where("component <> main" if turn else "true").groupBy("k").agg(F.min(F.struct(order.alias("o"), "node", "component", *cols)).alias("p"))
        sizes = apart.groupBy("k").agg(F.count("*").alias("n"))
        pivots = written(pivots.join(sizes, "k"), "pivots")
        if not pivots.head(1):
            return None
        near = spread_join(apart.select("k", "node", "component", *cols), pivots, "k", "n", F.col("node"), total=total)
        bits = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"p.{c}"))) for c in cols), F.lit(0))
        return alike(near.where("component <> p.component").where(bits <= radius).select(F.col("p.node").alias("a"), F.col("node").alias("b")), sets, similarity)

    found, rows = labelled(found)
    for turn in range(rounds):
        with passing(spark):
            more = met(rows, turn)
            found = written(found.unionByName(more), "links", keep=True) if more else found
        if not more:
            break
        found, rows = labelled(found)

    apart = written(parted(rows), "apart")
    if apart.isEmpty():
        return found
    own = sets.join(apart.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.first("shingles").alias("shingles"))
    apart = apart.join(own, "node")
    weight = apart.groupBy("k").agg(F.count("*").alias("rows"), F.sum(F.size("shingles")).alias("held"))
    weight = written(weight.select("k", "rows", F.ceil(F.greatest(F.col("rows") / part, F.col("held") / SLICE_HASHES)).cast("int").alias("slices")), "slices")
    apart = spread_join(apart, weight, "k", "rows", F.col("node"), total=total)
    held = ("component", "node", *cols, "shingles")
    mine = apart.select("k", F.pmod(F.xxhash64("node"), "slices").cast("int").alias("slice"), F.lit(False).alias("probe"), *held)
    probe = apart.where("component <> main").select("k", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), F.lit(True).alias("probe"), *held)
    dealt = mine.unionByName(probe).repartition("k", "slice").sortWithinPartitions("k", "slice", "probe")
    return found.unionByName(dealt.select("k", "slice", "probe", *held).mapInArrow(_crossed(cols, radius, similarity), "a long, b long"))


class Slice:
    """Some rows of a key, against which others are held; what turns out alike is one component from then on."""

    def __init__(self, component: np.ndarray, node: np.ndarray, words: np.ndarray, shingles: list[np.ndarray]):
        self.component, self.node, self.words, self.shingles = component, node, words, shingles
        self.sizes = np.array([len(x) for x in shingles])
        self.up: dict[int, int] = {}

    def top(self, component: int) -> int:
        while component in self.up:
            component = self.up[component]
        return component

    def links(self, component: int, node: int, words: np.ndarray, shingles: np.ndarray, radius: int, similarity: float) -> list[tuple[int, int]]:
        """Pairs of a row with members that join its component with others, the nearest members first."""
        bits = np.bitwise_count(self.words ^ words).sum(axis=1, dtype=np.int64)
        n = len(shingles)
        own = self.top(component)
        fits = (bits <= radius) & (self.component != own) & (np.minimum(self.sizes, n) >= similarity * np.maximum(self.sizes, n) - 1e-9) & (self.sizes > 0)
        near = np.flatnonzero(fits)
        near = near[np.argsort(bits[near], kind="stable")]
        out = []
        while len(near):
            some, near = near[:NEAR], near[NEAR:]
            sets = np.concatenate([self.shingles[j] for j in some])
            at = np.minimum(np.searchsorted(shingles, sets), n - 1)
            starts = np.cumsum(self.sizes[some]) - self.sizes[some]
            both = np.add.reduceat((shingles[at] == sets).astype(np.int64), starts)
            for j in some[both >= similarity * (self.sizes[some] + n - both) - 1e-9]:
                other = int(self.component[j])
                if other != own:
                    out.append((min(node, int(self.node[j])), max(node, int(self.node[j]))))
                    self.up[own] = other
                    self.component[self.component == own] = other
                    own = other
            near = near[self.component[near] != own]
        return out


def _crossed(cols: list[str], radius: int, similarity: float):
    """Links of probing rows with a slice's members, which come before them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, waiting, held = None, [], None
        for batch in batches:
            keys = list(zip(batch.column("k").to_pylist(), batch.column("slice").to_pylist(), strict=True))
            probing = batch.column("probe").to_numpy(zero_copy_only=False)
            component, node = batch.column("component").to_numpy(), batch.column("node").to_numpy()
            words = np.stack([batch.column(c).to_numpy() for c in cols], axis=1).view(np.uint64)
            flat, ends = batch.column("shingles").flatten().to_numpy().view(np.uint32), np.cumsum(batch.column("shingles").value_lengths().to_numpy())
            sets = np.split(flat, ends[:-1])
            out = []
            for r in range(batch.num_rows):
                if keys[r] != group:
                    group, waiting, held = keys[r], [], None
                if not probing[r]:
                    waiting.append((component[r], node[r], words[r], sets[r].copy()))
                    continue
                if held is None and waiting:
                    c, i, w, s = zip(*waiting, strict=True)
                    held, waiting = Slice(np.array(c), np.array(i), np.stack(w), list(s)), []
                if held is not None and len(sets[r]):
                    out += held.links(int(component[r]), int(node[r]), words[r], sets[r], radius, similarity)
            a, b = np.array(out, np.int64).reshape(-1, 2).T
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return run


def similar_groups(docs: DataFrame, size: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", tag: Column | None = None, most: int = MOST_IN_BAND) -> DataFrame:
    """(id, component_id, tag, kept): documents grouped by the Jaccard similarity of their shingles.

    Two texts are linked when their sets of distinct shingles have this Jaccard similarity at least; component_id is
    the smallest id that links reach, kept says whether the row has that id and, where it repeats, its least tag. Candidates share a
    band of least hashes (see `bands`), and their 512-bit SimHashes differ in no more bits than `differing` allows; their sets are
    then compared. Keys of more than `most` nodes, at most 18 / `most` of all nodes in number, go to `hot_links`.

    Null and wordless texts are alike. Rows without an id are linked like others and come after all with one; component_id is
    null if no row of a group has one. Equal sets are one node from the start; rows of equal id and tag are kept or
    not together. No rows give no rows.
    """
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    cols = [f"w{i}" for i in range(WIDE)]
    spec = ", ".join(f"{c} long" for c in cols)
    tables = bands(similarity)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in slices(batches):
            sets = [shingle_set(t, size) for t in batch.column("text").to_pylist()]
            words = np.stack([_wide(x) for x in sets]).view(np.int64)
            node = np.array([xxhash.xxh64_intdigest(x.tobytes()) for x in sets], np.uint64).view(np.int64)
            keys = pa.array([band_keys(x, tables) for x in sets], pa.list_(pa.int64()))
            shingles = pa.array([np.unique((x >> np.uint64(32)).astype(np.uint32)).view(np.int32) for x in sets], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("tag"), pa.array(node), *(pa.array(words[:, i]) for i in range(WIDE)), keys, shingles], names=["id", "tag", "node", *cols, "keys", "shingles"])

    tag = F.lit(None) if tag is None else tag
    rows = docs.select(F.col(id_col).alias("id"), tag.cast("string").alias("tag"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    base = written(rows.mapInArrow(made, f"id {kind}, tag string, node long, {spec}, keys array<long>, shingles array<int>"), "wide")
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "tag"))
    nodes = written(base.groupBy("node").agg(*(F.first(c).alias(c) for c in (*cols, "keys")), least.alias("least"), F.count("*").alias("size")), "nodes")
    radius = differing(similarity)

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * (2 + WIDE)

        def close(own: list[np.ndarray]) -> pa.RecordBatch:
            key, ids, words = own[0], own[1], np.stack(own[2:], axis=1).view(np.uint64)
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
            lengths = np.diff(np.concatenate([starts, [len(key)]]))
            out = [np.zeros((2, 0), np.int64)]
            low = 2
            while low <= lengths.max(initial=0):  # runs of like lengths at once, so that few lanes of an offset are idle
                pick = np.repeat((lengths >= low) & (lengths < 2 * low), lengths)
                if pick.any():
                    where = np.flatnonzero(pick)
                    out.append(ids[where[np.stack(close_pairs(words[where], key[where], radius))]])
                low *= 2
            a, b = np.sort(np.concatenate(out, axis=1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        waiting: list[list[np.ndarray]] = []
        for batch in batches:
            waiting.append([batch.column(i).to_numpy() for i in range(2 + WIDE)])
            if sum(len(w[0]) for w in waiting) < AT_ONCE:
                continue
            held = [np.concatenate(parts) for parts in zip(held, *waiting, strict=True)]
            waiting = []
            last = int(np.searchsorted(held[0], held[0][-1]))
            if last:
                yield close([h[:last] for h in held])
                held = [h[last:] for h in held]
        yield close([np.concatenate(parts) for parts in zip(held, *waiting, strict=True)])

    sets = base.select("node", "shingles")
    some = nodes.select("node", *cols)
    keyed = nodes.select(F.explode("keys").alias("key"), "node", *cols)
    often = written(keyed.groupBy("key").count().where(F.col("count") > most).select("key"), "hot-keys")
    few = F.broadcast(often) if often.count() <= BROADCAST_ROWS else often
    dealt = keyed.join(few, "key", "left_anti").repartition("key").sortWithinPartitions("key", "node")
    spark = docs.sparkSession
    with passing(spark):
        found = written(alike(dealt.select("key", "node", *cols).mapInArrow(compared, "a long, b long"), sets, similarity), "links", keep=True)
    if often.head(1):
        with passing(spark):
            hot = written(keyed.join(few, "key"), "hot")
            found = written(hot_links(hot, some, sets, found, similarity), "links", keep=True)
    grouped = _labelled(nodes.select("node", "least", "size"), found)
    best = grouped.groupBy("component").agg(F.min("least").alias("best"))
    named = grouped.join(best, "component").select(F.col("node").cast("string").alias("k"), "size", "best")
    out = spread_join(base.select("id", "tag", F.col("node").cast("string").alias("k")), written(named, "named"), "k", "size", F.col("tag"))
    kept = F.col("id").eqNullSafe(F.col("best.id")) & F.col("tag").eqNullSafe(F.col("best.tag"))
    return out.select(F.col("id").alias(id_col), F.col("best.id").alias("component_id"), "tag", kept.alias("kept"))
