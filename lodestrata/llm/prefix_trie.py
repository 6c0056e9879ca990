"""A trie of conversations: nodes are distinct beginnings, with what they share and what sharing them saves.

Texts stay where they are read: a turn goes on as two 64-bit hashes of its role and text and its number of
words.  Equal conversations become one sequence.  Sequences are dealt out in order of their first ``KEYS``
turns, so each task holds a stretch of the order: a prefix shard.  A shard's turns get dense ids and its trie
is packed into a double array (BASE and CHECK: the child of state s by turn c is BASE[s] + c, and CHECK there
is s), built level by level; walking the array gives the nodes and what is below them.  Only the nodes that
a shard's first or last sequence passes (beyond ``KEYS`` turns: and those below) can stand in other shards as
well; these are added up globally, and what they own goes to all nodes above them: to the nearest ``NEAR``
at once, further up by doubling steps, so long conversations take a logarithm of rounds.  The hash of the members
that end at a node is fed in order of their ids, joined by tasks beforehand, so no task holds all of them.

Turns are in order of ``turn`` (null first), equal ones in order of a hash; null role or text is empty; repeated rows
are turns of their own.  Rows without conv_id belong to no conversation and don't count.  An empty table
has no nodes.  Other columns of the input don't matter.  A task holds single conversations and up to
``SHARD_TURNS`` turns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .crc_sql import crc32_sql
from .scratch import bound_batches, materialise, tidy
from .words import mix

KEYS = 8
SHARD_TURNS = 250_000
CHUNK_IDS = 50_000
MOST_SENT = 1_000_000
NEAR = 32
TRIES = 256

_TURNS = "array<struct<h1:bigint,h2:bigint,tokens:int>>"
_FREE, _ROOT = -1, -2


def turn_sequences(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): hashes and word counts of each conversation's turns in order."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    words = F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    turns = conversations.where("conv_id is not null").select("conv_id", "turn", F.xxhash64(role, text).alias("h1"), F.xxhash64(F.lit(5), text, role).alias("h2"), words.alias("tokens"))
    grouped = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "h1", "h2", "tokens"))).alias("turns"))
    return grouped.select("conv_id", F.transform("turns", lambda t: F.struct(t["h1"].alias("h1"), t["h2"].alias("h2"), t["tokens"].alias("tokens"))).cast(_TURNS).alias("turns"))


def with_shared_openings(sequences: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """Each conversation c with the first h = crc32(c) % ``most`` turns of conversation c - c % ``every``, then its own after its first h."""
    bases = sequences.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base_id"), F.slice("turns", 1, most - 1).alias("opening"))
    c = F.col("conv_id")
    h = F.pmod(F.crc32(c.cast("string")), F.lit(most)).cast("int")
    joined = sequences.join(bases, c - c % every == F.col("base_id"), "left")
    opening = F.slice(F.coalesce("opening", F.array().cast(_TURNS)), F.lit(1), h)
    own = F.slice("turns", h + 1, F.greatest(F.size("turns") - h, F.lit(0)))
    return joined.select("conv_id", F.concat(opening, own).alias("turns"))


def _joined_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of (s1, s2, conv_id): each sequence's ids joined by commas, in chunks."""
    key, ids, out = None, [], []

    def flush() -> None:
        if ids:
            out.append((*key, ids[0], len(ids), ",".join(map(str, ids))))
            ids.clear()

    for batch in batches:
        for s1, s2, c in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            if (s1, s2) != key or len(ids) >= CHUNK_IDS:
                flush()
                key = (s1, s2)
            ids.append(c)
        if len(out) > 10_000 or sum(len(x[4]) for x in out) > 4 << 20:
            yield _batch(out, ("s1", "s2", "first", "n", "ids"))
            out.clear()
    flush()
    yield _batch(out, ("s1", "s2", "first", "n", "ids"))


def _batch(rows: list[tuple], names: tuple[str, ...]) -> pa.RecordBatch:
    kinds = {"ids": pa.string(), "ends_sha256": pa.string()}
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds.get(k, pa.int64())) for k, c in zip(names, columns, strict=True)], list(names))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks in order of (s1, s2, first): each sequence's count, least id and hash of all ids."""
    names = ("s1", "s2", "n_convs", "least", "ends_sha256")
    key, sha, n, least, out = None, None, 0, None, []
    for batch in batches:
        for s1, s2, first, k, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (s1, s2) == key:
                sha.update(b",")
            else:
                if key:
                    out.append((*key, n, least, sha.hexdigest()))
                key, sha, n, least = (s1, s2), hashlib.sha256(), 0, first
            sha.update(ids.encode())
            n += k
        if out:
            yield _batch(out, names)
            out = []
    if key:
        yield _batch([(*key, n, least, sha.hexdigest())], names)


def ends(sequences: DataFrame) -> DataFrame:
    """(s1, s2, n_convs, least, ends_sha256) of each distinct sequence of ``sequences`` (s1, s2, conv_id)."""
    parts = int(sequences.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["s1", "s2", "conv_id"]
    chunks = sequences.select(*keys).repartitionByRange(parts, *keys).sortWithinPartitions(*keys).mapInArrow(tidy(_joined_ids), "s1 long, s2 long, first long, n long, ids string")
    # Most sequences lie in one task whole; only chunks are dealt out again, so a sequence of many conversations is few rows.
    dealt = chunks.repartition(parts, "s1", "s2").sortWithinPartitions("s1", "s2", "first")
    return dealt.mapInArrow(tidy(_digests), "s1 long, s2 long, n_convs long, least long, ends_sha256 string")


class DoubleArray:
    """BASE and CHECK over dense codes 1, 2, ...; slot 0 is the root."""

    def __init__(self, size: int):
        self.base = np.zeros(size + 2, np.int64)
        self.check = np.full(size + 2, _FREE, np.int64)
        self.check[0] = _ROOT
        self.top = 1  # all slots from here on are free
        self.low = self.seek = 1  # no free slot is below low; wide states look from seek on

    def _reserve(self, size: int) -> None:
        """Make room for ``size`` slots."""
        if size > len(self.check):
            more = max(size, 2 * len(self.check)) - len(self.check)
            self.base = np.concatenate((self.base, np.zeros(more, np.int64)))
            self.check = np.concatenate((self.check, np.full(more, _FREE, np.int64)))

    def _free(self, n: int, start: int) -> np.ndarray:
        """The first ``n`` free slots from ``start`` on; those from ``top`` on are always free."""
        holes, reach = np.zeros(0, np.int64), max(1024, 2 * n)
        while start < self.top and len(holes) < n:
            found = np.flatnonzero(self.check[start : min(start + reach, self.top)] == _FREE) + start
            holes, start, reach = np.concatenate((holes, found)), start + reach, 2 * reach
        return np.concatenate((holes[:n], np.arange(self.top, self.top + max(n - len(holes), 0))))

    def _place(self, codes: np.ndarray) -> int:
        """A base at which all of a state's children are free: the first of some places that fits, or behind all others."""
        firsts = self._free(TRIES, self.seek)
        at = firsts[:, None] + (codes - codes[0])[None, :]
        taken = (at < self.top) & (self.check[np.minimum(at, len(self.check) - 1)] != _FREE)
        fits = np.flatnonzero(~taken.any(1))
        if not len(fits):
            self.seek = int(firsts[-1])  # what lies before is left to states of one child
        return int((firsts[fits[0]] if len(fits) else self.top) - codes[0])

    def add(self, states: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The children of ``states`` by ``codes`` (sorted, distinct pairs; no state has children yet): their slots."""
        first = np.flatnonzero(np.concatenate(([True], states[1:] != states[:-1])))
        sizes = np.diff(np.concatenate((first, [len(states)])))
        for a, k in zip(first[sizes > 1], sizes[sizes > 1], strict=True):
            base = self._place(codes[a : a + k])
            end = base + int(codes[a + k - 1]) + 1
            self._reserve(end)
            self.base[states[a]] = base
            self.check[base + codes[a : a + k]] = states[a]
            self.top = max(self.top, end)
        alone = first[sizes == 1]
        if len(alone):
            slots = self._free(len(alone), self.low)
            self._reserve(int(slots[-1]) + 1)
            self.base[states[alone]] = slots - codes[alone]
            self.check[slots] = states[alone]
            self.low, self.top = int(slots[-1]) + 1, max(self.top, int(slots[-1]) + 1)
        return self.base[states] + codes

    def step(self, states: np.ndarray, codes: np.ndarray) -> np.ndarray:
        to = self.base[states] + codes
        if (self.check[to] != states).any():
            raise AssertionError("a step that the array doesn't have")
        return to


_NODE = "open boolean, p1 long, p2 long, q1 long, q2 long, depth int, tokens long, n_convs long, least long, parent_least long, n_children long, n_leaves long, saved long, ends_sha256 string, above array<struct<p1:bigint,p2:bigint>>, f1 long, f2 long"
_NODE_ARROW = pa.schema(
    [("open", pa.bool_()), *((k, pa.int64()) for k in ("p1", "p2", "q1", "q2")), ("depth", pa.int32()), *((k, pa.int64()) for k in ("tokens", "n_convs", "least", "parent_least", "n_children", "n_leaves", "saved")), ("ends_sha256", pa.string()), ("above", pa.list_(pa.struct([("p1", pa.int64()), ("p2", pa.int64())]))), ("f1", pa.int64()), ("f2", pa.int64())]
)


def shard_nodes(rows: pa.Table, keys: int = KEYS) -> pa.RecordBatch:
    """The nodes of a shard's sequences (turns, n_convs, least, ends_sha256), in the order that they were dealt out in, by ``keys`` turns."""
    turns = rows["turns"].combine_chunks()
    bounds = turns.offsets.to_numpy().astype(np.int64)
    flat = turns.values  # the child array whole; bounds are places in it
    h1, h2 = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
    words = flat.field(2).to_numpy(zero_copy_only=False).astype(np.int64)
    order = np.lexsort((h2, h1))
    new = np.ones(len(order), bool)
    new[1:] = (h1[order[1:]] != h1[order[:-1]]) | (h2[order[1:]] != h2[order[:-1]])
    code = np.zeros(len(order), np.int64)
    code[order] = np.cumsum(new)  # dense ids from 1
    firsts = order[new]
    id1, id2, id_words = (np.concatenate(([0], x[firsts])) for x in (h1, h2, words))
    counts, least = (rows[k].to_numpy().astype(np.int64) for k in ("n_convs", "least"))
    lengths = np.diff(bounds)
    trie = DoubleArray(len(firsts) + 1024)
    state = np.zeros(len(lengths), np.int64)
    levels = [(np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1, np.int64))]  # slots, parents' slots, codes
    depth, active = 0, np.flatnonzero(lengths > 0)
    while len(active):
        s, c = state[active], code[bounds[active] + depth]
        by = np.lexsort((c, s))
        s, c = s[by], c[by]
        pairs = np.flatnonzero(np.concatenate(([True], (s[1:] != s[:-1]) | (c[1:] != c[:-1]))))
        levels.append((trie.add(s[pairs], c[pairs]), s[pairs], c[pairs]))
        state[active[by]] = trie.step(s, c)
        depth += 1
        active = active[lengths[active] > depth]
    size = trie.top
    n, low = np.zeros(size, np.int64), np.full(size, np.iinfo(np.int64).max)
    at = np.zeros(len(lengths), np.int64)
    opened = np.zeros(size, bool)
    opened[0] = True
    p1, p2, tokens = np.zeros(size, np.uint64), np.zeros(size, np.uint64), np.zeros(size, np.int64)
    end_of = np.full(size, -1, np.int64)
    for d, (slots, parents, codes) in enumerate(levels):  # down: walk the array once more, now adding up
        here = np.flatnonzero(lengths >= d)
        if d:
            at[here] = trie.step(at[here], code[bounds[here] + d - 1])
            p1[slots] = mix(p1[parents] * np.uint64(0x9E3779B97F4A7C15) + id1[codes].astype(np.uint64) + np.uint64(d))
            p2[slots] = mix(p2[parents] * np.uint64(0xD6E8FEB86659FD93) + id2[codes].astype(np.uint64) + np.uint64(3 * d))
            tokens[slots] = id_words[codes]
            if d > keys:
                opened[slots] = opened[parents]
            else:
                for edge in (0, len(lengths) - 1):
                    if lengths[edge] >= d:
                        opened[at[edge]] = True
        np.add.at(n, at[here], counts[here])
        np.minimum.at(low, at[here], least[here])
        done = here[lengths[here] == d]
        end_of[at[done]] = done
    children, leaves, saved = (np.zeros(size, np.int64) for _ in range(3))
    for slots, parents, _ in reversed(levels):  # up: what an open node owns is known only after merging
        closed = ~opened[slots]
        leaves[slots] += closed & (children[slots] == 0)
        saved[slots] += np.where(closed, (n[slots] - 1) * tokens[slots], 0)
        if slots[0]:
            np.add.at(children, parents, closed.astype(np.int64))
            np.add.at(leaves, parents, leaves[slots])
            np.add.at(saved, parents, saved[slots])
    node, parent = (np.concatenate([x[k] for x in levels]) for k in (0, 1))
    depths = np.repeat(np.arange(len(levels), dtype=np.int32), [len(x[0]) for x in levels])
    signed = lambda x: x.view(np.int64)
    up = trie.check[:size].copy()
    up[0] = -1
    shared, steps = opened[node], []
    places = np.flatnonzero(shared)
    to = node[places]
    for _ in range(NEAR):
        to = np.where(to >= 0, up[to], -1)
        steps.append(to)
    far, sizes = np.full(len(node), -1, np.int64), np.zeros(len(node), np.int64)
    far[places] = steps.pop()
    near = np.stack(steps, axis=1)
    sizes[places] = (near >= 0).sum(1)
    flat_near = near[near >= 0]
    above = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.StructArray.from_arrays([pa.array(signed(x)[flat_near]) for x in (p1, p2)], ["p1", "p2"]))
    root = node == 0
    sha = rows["ends_sha256"].combine_chunks().take(pa.array(end_of[node], mask=end_of[node] < 0))
    columns = [
        pa.array(shared), *(pa.array(signed(x)[node]) for x in (p1, p2)), *(pa.array(signed(x)[parent], mask=root) for x in (p1, p2)), pa.array(depths),
        pa.array(tokens[node]), pa.array(n[node]), pa.array(low[node]), pa.array(low[parent], mask=opened[parent]), pa.array(children[node]), pa.array(leaves[node]), pa.array(saved[node]), sha.cast(pa.string()), above, *(pa.array(signed(x)[far], mask=far < 0) for x in (p1, p2)),
    ]
    return pa.RecordBatch.from_arrays(columns, schema=_NODE_ARROW)


def _shards(keys: int, shard_turns: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, turns = [], 0
        for batch in batches:
            if not len(batch):
                continue
            held.append(batch)
            turns += len(batch) + len(batch.column("turns").flatten())
            if turns >= shard_turns:
                yield shard_nodes(pa.Table.from_batches(held), keys)
                held, turns = [], 0
        if held:
            yield shard_nodes(pa.Table.from_batches(held), keys)

    return tidy(run)


def _all_the_way_up(owned: DataFrame, deepest: int) -> DataFrame:
    """``owned`` (p1, p2, leaf, own of the nodes up to NEAR - 1 below, and f1, f2: the node NEAR above) with the
    sums of all nodes below: each round adds what the nodes 2 ** round * NEAR below have gathered."""
    span = NEAR
    while span <= deepest:
        owned = materialise(owned, "gathered")
        more = owned.where("f1 is not null").groupBy(F.col("f1").alias("p1"), F.col("f2").alias("p2")).agg(F.sum("leaf").alias("more_leaf"), F.sum("own").alias("more_own"))
        jump = owned.select(F.col("p1").alias("f1"), F.col("p2").alias("f2"), F.col("f1").alias("g1"), F.col("f2").alias("g2"))
        joined = owned.join(more, ["p1", "p2"], "left").join(jump, ["f1", "f2"], "left")
        owned = joined.select("p1", "p2", *((F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in ("leaf", "own")), F.col("g1").alias("f1"), F.col("g2").alias("f2"))
        span *= 2
    return owned.select("p1", "p2", "leaf", "own")


def prefix_nodes(sequences: DataFrame, n_keys: int = KEYS, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """The nodes of the trie of ``sequences`` (conv_id, turns): conv_id (the least member), depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = sequences.sparkSession
    bound_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    named = materialise(sequences.select("conv_id", "turns", F.xxhash64("turns").alias("s1"), F.xxhash64(F.lit(7), "turns").alias("s2")), "sequences")
    distinct = named.groupBy("s1", "s2", "turns").agg(F.count(F.lit(1)).alias("copies")).drop("copies")
    keys = [F.get("turns", F.lit(k))["h1"].alias(f"k{k}") for k in range(n_keys)]
    order = [*(f"k{k}" for k in range(n_keys)), "s1", "s2"]
    rows = distinct.join(ends(named), ["s1", "s2"]).select(*keys, "s1", "s2", "turns", "n_convs", "least", "ends_sha256")
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("turns", "n_convs", "least", "ends_sha256")
    nodes = materialise(dealt.mapInArrow(_shards(n_keys, shard_turns), _NODE), "shard-nodes")

    shared = nodes.where("open")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")]
    merged = shared.groupBy("p1", "p2").agg(*(F.min(c).alias(c) for c in ("q1", "q2", "depth", "tokens", "least", "ends_sha256", "f1", "f2")), F.first("above").alias("above"), *sums)
    merged = materialise(merged, "shared-nodes")
    fewer = merged.where("q1 is not null").groupBy(F.col("q1").alias("p1"), F.col("q2").alias("p2")).agg(F.count(F.lit(1)).alias("more"))
    merged = merged.join(fewer, ["p1", "p2"], "left").withColumn("n_children", F.col("n_children") + F.coalesce("more", F.lit(0))).drop("more")
    leaf = F.when(F.col("n_children") == 0, 1).otherwise(0)
    own = merged.select(F.explode(F.concat("above", F.array(F.struct("p1", "p2")))).alias("to"), leaf.alias("leaf"), ((F.col("n_convs") - 1) * F.col("tokens")).alias("own"))
    owned = own.groupBy(F.col("to.p1").alias("p1"), F.col("to.p2").alias("p2")).agg(F.sum("leaf").alias("leaf"), F.sum("own").alias("own"))
    owned = _all_the_way_up(owned.join(merged.select("p1", "p2", "f1", "f2"), ["p1", "p2"]), merged.agg(F.max("depth")).first()[0] or 0)
    whole = merged.join(owned, ["p1", "p2"]).withColumn("n_leaves", F.col("n_leaves") + F.col("leaf")).withColumn("saved", F.col("saved") + F.col("own"))
    kept = ["q1", "q2", "depth", "least", "n_convs", "n_children", "n_leaves", "saved", "ends_sha256"]
    whole = materialise(whole.select("p1", "p2", *kept), "whole-nodes")
    parents = whole.select(F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("least").alias("whole_least"))
    parents = F.broadcast(parents) if parents.count() <= MOST_SENT else parents  # else Spark joins by shuffles and splits hot parents
    inner = nodes.where("not open")
    below = inner.where("parent_least is null").select(*kept).union(whole.select(*kept)).join(parents, ["q1", "q2"], "left")
    found = below.select(*kept, F.col("whole_least").alias("parent")).union(inner.where("parent_least is not null").select(*kept, F.col("parent_least").alias("parent")))
    return _as_result(found)


def _as_result(nodes: DataFrame) -> DataFrame:
    nothing: Column = F.lit(hashlib.sha256(b"").hexdigest())
    long = lambda c, name: F.col(c).cast("long").alias(name)
    return nodes.select(
        long("least", "conv_id"), long("depth", "depth"), long("parent", "parent_conv_id"), long("n_convs", "n_convs"), long("n_children", "n_children"),
        long("n_leaves", "n_leaves"), long("saved", "saved_tokens"), F.coalesce("ends_sha256", nothing).alias("ends_sha256"),
    )


#: For tables without repeated turns.
ORACLE_SQL = rf"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS i FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, {crc32_sql("CAST(conv_id AS VARCHAR)")} % 4 AS h FROM (SELECT DISTINCT conv_id FROM t)),
r AS (SELECT c.conv_id, i, role, text FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 20 AND i <= h
      UNION ALL SELECT c.conv_id, i, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND i > h),
o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY i) AS d, md5(role || chr(1) || text) AS turn, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS tokens FROM r),
p AS (SELECT conv_id, d, tokens, string_agg(turn, '') OVER (PARTITION BY conv_id ORDER BY d ROWS UNBOUNDED PRECEDING) AS key FROM o
      UNION ALL SELECT conv_id, 0, 0, '' FROM c),
n AS (SELECT d, key, count(*) AS n_convs, min(conv_id) AS conv_id, min(tokens) AS tokens FROM p GROUP BY d, key),
k AS (SELECT left(key, CAST(32 * (d - 1) AS BIGINT)) AS key, count(*) AS n FROM n WHERE d > 0 GROUP BY 1),
under AS (SELECT left(n.key, CAST(32 * a.d AS BIGINT)) AS key, sum((n.n_convs - 1) * n.tokens) AS saved, count(*) FILTER (WHERE k.key IS NULL) AS leaves
          FROM (SELECT key, unnest(range(0, d + 1)) AS d FROM n) a JOIN n ON n.key = a.key LEFT JOIN k ON n.key = k.key GROUP BY 1),
last AS (SELECT conv_id, arg_max(key, d) AS key FROM p GROUP BY conv_id),
e AS (SELECT key, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS sha FROM last GROUP BY key)
SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, up.conv_id AS parent_conv_id, n.n_convs, CAST(coalesce(k.n, 0) AS BIGINT) AS n_children,
       CAST(under.leaves AS BIGINT) AS n_leaves, CAST(under.saved AS BIGINT) AS saved_tokens, coalesce(e.sha, sha256('')) AS ends_sha256
FROM n LEFT JOIN k ON n.key = k.key LEFT JOIN under ON n.key = under.key LEFT JOIN e ON n.key = e.key
LEFT JOIN n up ON n.d > 0 AND up.key = left(n.key, CAST(32 * (n.d - 1) AS BIGINT))
"""
