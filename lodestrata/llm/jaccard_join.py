"""Exact set-similarity join on word shingles: a grouped prefix join.

1. Count in how many texts each shingle stands.  The most frequent ones, at most ``MOST_LISTED``, get a class
   of frequency, others that stand in several texts, by a bitmap, the class below; a shingle's place in the
   global order is (class, hash), rare first.  Any order gives the same result; this one keeps frequent
   shingles out of the prefixes.
2. Texts with equal sets form a class, and classes with the same size and the same prefix (the first
   n - ceil(t n) + 1 shingles in that order) a group.  Each prefix shingle of a group is a posting.
3. A first round joins what is surely alike without making pairs: each class whose group meets others goes
   to one unit, that of the shingle with most groups in its prefix.  Units have blocks of about ``BLOCK``
   classes, which share a few classes, and a block is verified whole.  This costs a constant for each class,
   however large a group of copies is, and leaves few components.
4. Group pairs: two groups that meet in a prefix shingle of at most ``RUN`` groups, and that share as many
   prefix shingles as any pair within the threshold must, are candidates.  They are expanded into pairs of
   classes in different components, and these are verified on whole sets.
5. Where more groups meet in a shingle, no pairs are made: all classes there but those of the largest
   component visit the blocks of the others that hold the shingle, and are verified against what is in them.
6. Components of all verified links are the answer.

The threshold is a percentage, and all comparisons are of integers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .scratch import bound_batches, delete_table, drop, materialise, share, tidy
from .words import mix, shingle_sets

MOST_LISTED = 1 << 20
SEEN_BITS = 27
FLUSH = 2_000_000
BUCKET_KEYS = 1 << 20
RUN = 32
BLOCK = 512
PIVOTS = 4
UNIT_BYTES = 8 << 20
VISITORS = 2048
LARGE_GROUP = 8

_CLASS_BITS = 5


def prefix_length(n: np.ndarray | int, percent: int) -> np.ndarray | int:
    return n - -(-percent * n // 100) + 1


def needed(n1: Column, n2: Column, percent: int) -> Column:
    """Prefix shingles that two sets within the threshold share at least.

    Shared shingles outside both prefixes stand in the rest of one of the sets, behind the prefix that ends
    first, so they are at most as many as the longer of the two rests.
    """
    overlap = F.ceil(percent * (n1 + n2) / F.lit(100 + percent))
    rest = lambda n: F.ceil(percent * n / F.lit(100)) - 1
    return F.greatest(F.lit(1), overlap - F.greatest(rest(n1), rest(n2)))


def _count_blocks(n_words: int, bits: int):
    """Distinct shingles of some texts with counts, in binary by bucket: the low 8 bytes' hashes and counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            bucket = (keys >> np.uint64(64 - bits)).astype(np.int64)
            rest = ((keys >> np.uint64(32 - bits)) & np.uint64(0xFFFFFFFF)).astype("<u4")
            edges = np.searchsorted(bucket, np.arange((1 << bits) + 1))
            one = counts == 1
            rows = [(b, rest[i:j][one[i:j]].tobytes(), np.stack((rest[i:j][~one[i:j]], counts[i:j][~one[i:j]].astype("<u4")), axis=1).tobytes()) for b, (i, j) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if i < j]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "once", "often"])

        for batch in batches:
            for s in shingle_sets(batch.column(0), n_words):
                held.append(s)
                size += len(s)
                if size >= FLUSH:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    return run


def _count_bucket(bits: int):
    def run(group: pa.Table) -> pa.Table:
        """A bucket's shingles that stand in several texts, by class of frequency (the logarithm of the count)."""
        rest = np.concatenate([np.frombuffer(x, "<u4") for x in group.column("once").to_pylist()])
        often = np.concatenate([np.frombuffer(x, "<u4") for x in group.column("often").to_pylist()]).reshape(-1, 2)
        keys, index = np.unique(np.concatenate((rest, often[:, 0])), return_inverse=True)
        counts = np.bincount(index, np.concatenate((np.ones(len(rest)), often[:, 1])))
        keys, counts = keys[counts > 1], counts[counts > 1]
        classes = np.minimum(np.floor(np.log2(counts)), (1 << _CLASS_BITS) - 1).astype(np.int32) if len(keys) else np.zeros(0, np.int32)
        bucket = group.column("bucket")[0].as_py()
        whole = (np.uint64(bucket) << np.uint64(32)) | keys.astype(np.uint64)
        found = [(int(c), int((classes == c).sum()), whole[classes == c].tobytes()) for c in np.unique(classes)]
        level, many, listed = zip(*found, strict=True) if found else ((), (), ())
        return pa.table({"level": pa.array(level, pa.int32()), "many": pa.array(many, pa.int64()), "keys": pa.array(listed, pa.binary())})

    return run


class Order:
    """The global order of shingles.  Of bounded size: at most ``MOST_LISTED`` keys, and a bitmap."""

    def __init__(self, bits: int, keys: np.ndarray, levels: np.ndarray, seen: np.ndarray):
        self.shift = np.uint64(32 - bits)
        at = np.argsort(keys, kind="stable")
        self.listed, self.levels = keys[at], levels[at]
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[self._slot(self.listed, 22, bits)] = True
        self.bits, self.seen = bits, seen

    @staticmethod
    def _slot(keys: np.ndarray, width: int, bits: int) -> np.ndarray:
        return ((keys << np.uint64(32 - bits)) >> np.uint64(64 - width)).astype(np.int64)

    def keys(self, s: np.ndarray) -> np.ndarray:
        """Sorted keys: class in the top bits, then the hash."""
        level = self.seen_again(s).astype(np.uint64)
        at = np.flatnonzero(self.maybe[(s >> np.uint64(42)).astype(np.int64)])
        if len(at) and len(self.listed):
            short = s[at] >> self.shift
            place = np.minimum(np.searchsorted(self.listed, short), len(self.listed) - 1)
            level[at] = np.where(self.listed[place] == short, self.levels[place], level[at])
        return np.sort((level << np.uint64(64 - _CLASS_BITS)) | (s >> np.uint64(_CLASS_BITS)))

    def seen_again(self, s: np.ndarray) -> np.ndarray:
        """Whether these shingles may stand in several texts."""
        at = s >> np.uint64(64 - (len(self.seen) * 8).bit_length() + 1)
        return (self.seen[at >> np.uint64(3)] >> (7 - (at & np.uint64(7))).astype(np.uint8)) & 1 > 0


def shingle_order(rows: DataFrame, n_words: int) -> Order:
    """Count the shingles of all texts (column text); only lists of bounded size go to the driver."""
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(20, max(6, math.ceil(math.log2(size / 6 / BUCKET_KEYS + 1)) + 3))
    counted = rows.select("text").mapInArrow(tidy(_count_blocks(n_words, bits)), "bucket int, once binary, often binary").groupBy("bucket").applyInArrow(_count_bucket(bits), "level int, many long, keys binary")
    counted = materialise(counted, "counts")
    histogram = {r["level"]: r["many"] for r in counted.groupBy("level").agg(F.sum("many").alias("many")).collect()}  # at most 32 rows
    least, listed = 1 << _CLASS_BITS, 0
    while least > 1 and listed + histogram.get(least - 1, 0) <= MOST_LISTED:
        least -= 1
        listed += histogram.get(least, 0)
    found = counted.where(F.col("level") >= least).select("level", "keys").collect()  # at most MOST_LISTED keys
    keys = np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(r["keys"], np.uint64) for r in found)])
    levels = np.repeat(np.array([min(r["level"] + 1, (1 << _CLASS_BITS) - 1) for r in found], np.uint8), [len(r["keys"]) // 8 for r in found])
    width = min(SEEN_BITS, max(16, sum(histogram.values()).bit_length() + 4))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = np.zeros(1 << (width - 3), np.uint8)
        for batch in batches:
            for x in batch.column(0).to_pylist():
                at = Order._slot(np.frombuffer(x, np.uint64), width, bits)
                np.bitwise_or.at(packed, at >> 3, (128 >> (at & 7)).astype(np.uint8))
        parts = [(p, packed[p << 13 : (p + 1) << 13]) for p in range(-(-len(packed) >> 13))]
        full = [(p, b.tobytes()) for p, b in parts if b.any()]
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in full], pa.int32()), pa.array([b for _, b in full], pa.binary())], names=["part", "bitmap"])

    def merge(group: pa.Table) -> pa.Table:
        bitmap = np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in group.column("bitmap").to_pylist()])
        return pa.table({"part": group.column("part").slice(0, 1), "bitmap": pa.array([bitmap.tobytes()], pa.binary())})

    seen = np.zeros(1 << (width - 3), np.uint8)
    for r in counted.select("keys").mapInArrow(tidy(mark), "part int, bitmap binary").groupBy("part").applyInArrow(merge, "part int, bitmap binary").collect():  # at most 2**SEEN_BITS bits
        seen[r["part"] << 13 : (r["part"] << 13) + len(r["bitmap"])] = np.frombuffer(r["bitmap"], np.uint8)
    delete_table(counted)
    return Order(bits, keys, levels, seen)


def _two(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a sorted sequence of hashes."""
    if not len(s):
        return 0, 0
    turn = np.arange(1, len(s) + 1, dtype=np.uint64)
    parts = (mix(s ^ mix(turn)).sum(dtype=np.uint64), mix(s * np.uint64(0xD1342543DE82EF95) + turn).sum(dtype=np.uint64))
    return tuple(np.array(parts, np.uint64).view(np.int64).tolist())


_DESCRIBED = "doc_id long, n long, s1 long, s2 long, p1 long, p2 long, prefix array<long>"


def _describe(order, n_words: int, percent: int):
    """Size, set and prefix of each text; of the prefix itself what may stand in other texts."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("p1", pa.int64()), ("p2", pa.int64()), ("prefix", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        o = order.value
        for batch in batches:
            rows, prefixes = [], []
            for s in shingle_sets(batch.column(1), n_words):
                prefix = o.keys(s)[: prefix_length(len(s), percent)] if len(s) else s
                rows.append((len(s), *_two(s), *_two(prefix)))
                prefixes.append(prefix[prefix >> np.uint64(64 - _CLASS_BITS) > 0] if len(prefix) else prefix)  # what stands in several texts
            columns = list(zip(*rows, strict=True)) or [()] * 5
            flat = np.concatenate([np.zeros(0, np.uint64), *prefixes]).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, prefixes)]), pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns), lists], schema=schema)

    return run


def _chosen(ids: DataFrame, bits: int = 24) -> np.ndarray:
    """A bitmap of fixed size (2 MB) of hashes of the ids, to leave out most other rows before a shuffle."""
    slots = ids.select((F.xxhash64("doc_id").bitwiseAND(F.lit((1 << bits) - 1))).cast("int").alias("slot")).distinct()

    def part(group: pa.Table) -> pa.Table:
        made = np.zeros(1 << 13, bool)
        made[group.column("slot").to_numpy() & 8191] = True
        return pa.table({"part": pa.array([int(group.column("part")[0].as_py())], pa.int32()), "bits": pa.array([np.packbits(made).tobytes()], pa.binary())})

    out = np.zeros(1 << (bits - 3), np.uint8)
    for r in slots.withColumn("part", F.shiftright("slot", 13)).groupBy("part").applyInArrow(part, "part int, bits binary").collect():
        out[r["part"] * 1024 : (r["part"] + 1) * 1024] = np.frombuffer(r["bits"], np.uint8)
    return out


def _sets_of(chosen, n_words: int):
    schema = pa.schema([("rep", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("shingles", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = chosen.value
        for batch in batches:
            slot = batch.column(2).to_numpy()
            batch = batch.filter(pa.array((bits[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1 > 0))
            sets = shingle_sets(batch.column(1), n_words)
            s1, s2 = zip(*map(_two, sets), strict=True) if sets else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())], schema=schema)

    return run


class _Sets:
    """Sets by the shingles that several of them hold."""

    def __init__(self, sets: list[np.ndarray], least: int = 2):
        self.sizes = np.array([len(x) for x in sets], np.int64)
        tokens, index = np.unique(np.concatenate(sets), return_inverse=True)
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        many = np.bincount(index) >= least
        kept = many[index]
        self.tokens, self.index, self.owner = tokens[many], (np.cumsum(many) - 1)[index[kept]], owner[kept]
        self.starts = np.searchsorted(self.owner, np.arange(len(sets) + 1))
        self.mark = np.zeros(len(self.tokens), bool)

    def shared(self, places: np.ndarray) -> np.ndarray:
        """How many of these tokens (by place) each set holds."""
        self.mark[places] = True
        out = np.bincount(self.owner[self.mark[self.index]], minlength=len(self.sizes))
        self.mark[places] = False
        return out


class _Forest:
    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.parent[max(i, j)] = min(i, j)
        return i != j


def links_within(sets: list[np.ndarray], percent: int) -> Iterator[tuple[int, int]]:
    """Links (i, j) among the sets that join what isn't joined yet."""
    held, forest, apart = _Sets(sets), _Forest(len(sets)), len(sets)
    for i in range(len(sets)):
        if apart == 1:
            return
        shared = held.shared(held.index[held.starts[i] : held.starts[i + 1]])
        for j in np.flatnonzero((100 + percent) * shared >= percent * (held.sizes[i] + held.sizes)).tolist():
            if forest.join(i, j):
                apart -= 1
                yield i, j


def links_across(visitors: list[np.ndarray], own: np.ndarray, sets: list[np.ndarray], theirs: np.ndarray, percent: int) -> Iterator[tuple[int, int]]:
    """Links (visitor, set) of different components (own, theirs) that join what isn't joined yet."""
    held = _Sets(sets, 1)
    names = {c: k for k, c in enumerate(dict.fromkeys([*own.tolist(), *theirs.tolist()]))}
    forest = _Forest(len(names))
    at, other = [names[c] for c in own.tolist()], [names[c] for c in theirs.tolist()]
    for i, x in enumerate(visitors):
        place = np.minimum(np.searchsorted(held.tokens, x), len(held.tokens) - 1)
        shared = held.shared(place[held.tokens[place] == x])
        for j in np.flatnonzero((100 + percent) * shared >= percent * (len(x) + held.sizes)).tolist():
            if forest.join(at[i], other[j]):
                yield i, j


def _first_links(percent: int):
    def run(group: pa.Table) -> pa.Table:
        nodes = group.column("node").to_numpy()
        sets = [np.frombuffer(x, "<u8") for x in group.column("shingles").to_pylist()]
        first = np.lexsort((nodes, [-len(x) for x in sets]))
        edges = [(int(nodes[first[i]]), int(nodes[first[j]])) for i, j in links_within([sets[i] for i in first], percent)]
        return pa.table({"a": pa.array([min(e) for e in edges], pa.int64()), "b": pa.array([max(e) for e in edges], pa.int64())})

    return run


def _visit(percent: int):
    def run(group: pa.Table) -> pa.Table:
        nodes, component = group.column("node").to_numpy(), group.column("component").to_numpy()
        sets = [np.frombuffer(x, "<u8") for x in group.column("shingles").to_pylist()]
        comes = group.column("comes").to_numpy(zero_copy_only=False)
        v, h = np.flatnonzero(comes), np.flatnonzero(~comes)
        edges = [(int(nodes[v[i]]), int(nodes[h[j]])) for i, j in links_across([sets[k] for k in v], component[v], [sets[k] for k in h], component[h], percent)] if len(v) and len(h) else []
        return pa.table({"a": pa.array([min(e) for e in edges], pa.int64()), "b": pa.array([max(e) for e in edges], pa.int64())})

    return run


def _verify(percent: int):
    """Of pairs with both sets those within the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                both = np.concatenate((x, y))
                both.sort(kind="stable")
                keep.append((100 + percent) * int((both[1:] == both[:-1]).sum()) >= percent * len(both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def linked_components(docs: DataFrame, n_words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of ``docs`` (doc_id, text).

    Two texts link when 100 |A n B| >= percent |A u B| for their sets of shingles; a component's id is the
    least doc_id reachable.  Null, empty and wordless texts have no shingles and stay alone, as do rows
    without doc_id (their component is null).  Rows that share a doc_id count as one node, which has the
    links of all of them (an empty text among them has none of its own and stays alone).  Repeated rows each
    get a row; an empty table gives an empty one; no pair of different texts is left out.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = share(spark, shingle_order(rows, n_words))
    sets = materialise(rows.mapInArrow(tidy(_describe(order, n_words, percent)), _DESCRIBED), "sets")
    drop(order)

    usable = sets.where("n > 0 and doc_id is not null")
    same = usable.groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("p1").alias("p1"), F.first("p2").alias("p2"), F.first("prefix").alias("prefix"))
    classes = materialise(same.withColumn("node", F.monotonically_increasing_id()), "classes")
    groups = classes.groupBy("n", "p1", "p2").agg(F.min("node").alias("group"), F.count(F.lit(1)).alias("members"), F.first("prefix").alias("prefix"))
    groups = materialise(groups, "groups")
    every = groups.select("group", "n", F.explode("prefix").alias("token"))
    met = every.groupBy("token").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    postings = materialise(every.join(met, "token"), "postings")

    a, b = (postings.where(F.col("m") <= RUN).select("token", F.col("group").alias(f"g{k}"), F.col("n").alias(f"n{k}")) for k in (1, 2))
    alike = (100 * F.least("n1", "n2") >= percent * F.greatest("n1", "n2")) & (F.col("g1") < F.col("g2"))
    pairs = materialise(a.join(b, "token").where(alike).groupBy("g1", "n1", "g2", "n2").agg(F.count(F.lit(1)).alias("shared")), "pairs")  # at most RUN / 2 for each posting
    enough = F.col("shared") >= needed(F.col("n1"), F.col("n2"), percent)

    likely = pairs.where(enough)
    wanted = likely.select(F.col("g1").alias("group")).union(likely.select("g2")).union(postings.where(F.col("m") > RUN).select("group")).union(groups.where("members > 1").select("group")).distinct()
    best = postings.groupBy("group").agg(F.max_by("token", F.struct("m", "token")).alias("unit"))
    placed = wanted.join(best, "group", "left")
    known = classes.join(groups.select("n", "p1", "p2", "group"), ["n", "p1", "p2"]).join(placed, "group")
    known = materialise(known.select("node", "rep", "s1", "s2", "n", "group", F.coalesce("unit", -F.col("group") - 1).alias("unit")), "candidates")
    chosen = share(spark, _chosen(known.select(F.col("rep").alias("doc_id"))))
    slot = F.xxhash64("doc_id").bitwiseAND(F.lit((1 << 24) - 1)).cast("int")
    texts = rows.where("doc_id is not null").select("doc_id", "text", slot.alias("slot")).mapInArrow(tidy(_sets_of(chosen, n_words)), "rep long, s1 long, s2 long, shingles binary")
    whole = texts.join(known.select("node", "rep", "s1", "s2", "n", "unit"), ["rep", "s1", "s2"]).dropDuplicates(["node"]).select("node", "n", "unit", "shingles")
    whole = materialise(whole, "whole-sets")
    drop(chosen)

    sized = whole.groupBy("unit").agg(F.count(F.lit(1)).alias("many"), F.sum(8 * F.col("n")).alias("size"))
    sized = sized.where("many > 1").select("unit", F.greatest(F.ceil(F.col("many") / BLOCK), F.ceil(F.col("size") / UNIT_BYTES)).cast("int").alias("blocks"))
    mark = F.xxhash64("node")
    leaders = whole.select("unit", "node").groupBy("unit", F.pmod(mark, F.lit(PIVOTS)).alias("k")).agg(F.min_by("node", F.struct(mark, "node")).alias("node"))
    leaders = leaders.join(sized.where("blocks > 1"), "unit").select("node", F.lit(True).alias("pivot"))
    own = F.pmod(mark, F.coalesce("blocks", F.lit(1))).cast("int")
    units = whole.join(sized, "unit").join(leaders, "node", "left")
    places = F.when(F.col("pivot"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(own))
    units = units.select("unit", F.explode(places).alias("block"), "node", "shingles")
    first = materialise(units.groupBy("unit", "block").applyInArrow(_first_links(percent), "a long, b long"), "first-links")

    rep_of = usable.select("doc_id", "s1", "s2").join(classes.select("s1", "s2", "node"), ["s1", "s2"]).groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z"), F.collect_set("node").alias("nodes")).where("a < z")
    shared_ids = rep_of.select("a", F.explode("nodes").alias("b")).where("a <> b")
    linked = materialise(first.union(shared_ids), "links")
    joined = materialise(components(linked), "components")

    members = known.select("node", "n", "group", "unit").join(joined, "node", "left").join(sized.select("unit", "blocks"), "unit", "left")
    members = materialise(members.select("node", "n", "group", "unit", own.alias("block"), F.coalesce("component", "node").alias("component")), "members")
    spans = members.groupBy("group").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("size"))
    low, high = (spans.select(F.col("group").alias(f"g{k}"), F.col("low").alias(f"l{k}"), F.col("high").alias(f"h{k}"), F.col("size").alias(f"z{k}")) for k in (1, 2))
    # Shingles of many groups and of few may be shared by one pair, so here the many count as if all were.
    often = postings.where(F.col("m") > RUN).groupBy("group").agg(F.count(F.lit(1)).alias("often"))
    o1, o2 = (often.select(F.col("group").alias(f"g{k}"), F.col("often").alias(f"o{k}")) for k in (1, 2))
    rest = pairs.join(o1, "g1", "left").join(o2, "g2", "left").where(F.col("shared") + F.coalesce(F.least("o1", "o2"), F.lit(0)) >= needed(F.col("n1"), F.col("n2"), percent))
    rest = rest.join(low, "g1").join(high, "g2").where((F.col("l1") != F.col("h1")) | (F.col("l2") != F.col("h2")) | (F.col("l1") != F.col("l2")))
    few = (F.col("z1") <= LARGE_GROUP) & (F.col("z2") <= LARGE_GROUP)
    x, y = (members.select(F.col("group").alias(f"g{k}"), F.col("node").alias(f"x{k}"), F.col("component").alias(f"c{k}")) for k in (1, 2))
    unsure = rest.where(few).select("g1", "g2").join(x, "g1").join(y, "g2").where(F.col("c1") != F.col("c2"))
    unsure = materialise(unsure.select(F.col("x1").alias("a"), F.col("x2").alias("b")), "unsure")
    one, two = (whole.select(F.col("node").alias(c), F.col("shingles").alias(f"s{c}")) for c in ("a", "b"))
    second = unsure.join(one, "a").join(two, "b").select("a", "b", "sa", "sb").mapInArrow(tidy(_verify(percent)), "a long, b long")

    # Who meets whom without pairs: under a shingle of many groups, within a group, in two groups of which one is large.
    both = F.explode(F.array("g1", "g2"))
    meeting = postings.where(F.col("m") > RUN).select(F.xxhash64(F.lit(0), "token").alias("token"), "group")
    meeting = meeting.union(spans.where("low < high").select(F.xxhash64(F.lit(1), "group").alias("token"), "group"))
    meeting = meeting.union(rest.where(~few).select(F.xxhash64(F.lit(2), "g1", "g2").alias("token"), both.alias("group")))
    meeting = meeting.join(spans, "group").select("token", "group", "low", "high")
    open_ = meeting.groupBy("token").agg(F.min("low").alias("x"), F.max("high").alias("y")).where("x < y").select("token")
    meeting = meeting.join(open_, "token").join(members, "group").select("token", "node", "component", "unit", "block")
    meeting = materialise(meeting, "meeting")
    largest = meeting.groupBy("token", "component").agg(F.count(F.lit(1)).alias("many")).groupBy("token").agg(F.max_by("component", F.struct("many", "component")).alias("largest"))
    minor = meeting.join(largest, "token").where("component <> largest").select("token", "node", "component", F.col("unit").alias("u"), F.col("block").alias("b"))
    hosts = meeting.select("token", "unit", "block").distinct()
    visits = minor.join(hosts, "token").where((F.col("u") != F.col("unit")) | (F.col("b") != F.col("block"))).select("node", "component", "unit", "block").distinct()
    visits = materialise(visits, "visits")
    guests = visits.groupBy("unit", "block").agg(F.ceil(F.count(F.lit(1)) / VISITORS).cast("int").alias("shares"))
    share_of = F.pmod(F.xxhash64(F.lit(3), "node"), F.col("shares")).cast("int")
    coming = visits.join(guests, ["unit", "block"]).select("node", "component", "unit", "block", share_of.alias("share"), F.lit(True).alias("comes"))
    there = members.join(guests, ["unit", "block"]).select("node", "component", "unit", "block", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.lit(False).alias("comes"))
    met = coming.unionByName(there).join(whole.select("node", "shingles"), "node")
    third = met.groupBy("unit", "block", "share").applyInArrow(_visit(percent), "a long, b long")
    second = second.union(third)
    # These links are between the components of the first.
    named = joined.select(F.col("node").alias("a"), "component")
    second = second.join(named, "a", "left").select(F.coalesce("component", "a").alias("a"), "b").join(named.withColumnRenamed("a", "b"), "b", "left").select("a", F.coalesce("component", "b").alias("b"))
    second = materialise(second.distinct(), "second-links")
    over = components(second).withColumnRenamed("node", "lower").withColumnRenamed("component", "upper")
    final = classes.select("s1", "s2", "rep", "node").join(joined, "node", "left").withColumn("lower", F.coalesce("component", "node"))
    final = final.join(over, "lower", "left").select("s1", "s2", "rep", F.coalesce("upper", "lower").alias("component"))
    final = materialise(final, "labels")
    least = final.groupBy("component").agg(F.min("rep").alias("component_id"))
    labelled = materialise(final.join(least, "component").select("s1", "s2", "component_id"), "named")
    for used in (classes, groups, postings, pairs, known, whole, first, linked, joined, members, unsure, meeting, visits, second, final):
        delete_table(used)
    out = usable.select("doc_id", "n", "s1", "s2").join(labelled, ["s1", "s2"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = sets.where("n = 0 or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return out.union(alone)
