"""Toxicity by the nearest labelled examples: exact weighted TF-IDF cosine over a block-max inverted index.

The examples are a bounded sample of labelled texts (``MOST_EXAMPLES`` of each label, the first by a hash
of their ids).  Their terms are words and beginnings of words, which catch inflected forms, each at levels:
standing at least 1, 2, 3, 4, 8, 16, ... times, so a repeated word counts more, by its logarithm from four
on, without an end.  Every term of every example is in the index.  A term at a level has the weight of its
inverse document frequency, counted over all documents in Spark, times its evidence: how clearly it depends
on the label among the examples (:func:`evidence`).  Evidence is never zero, so a text is compared by what
it has: where it holds no telling term, its other terms decide.

Examples lie in blocks; for each term the index keeps its postings and its largest weight in each block.
Terms that a sixteenth of the examples hold are multiplied as one matrix for many queries at a time; the
postings of the others are then added up in those blocks that, by their bounds, can hold a nearer example,
so neighbours are exact (cosines equal to seven decimals are ties).

Neighbours vote with their similarities; votes are calibrated by a logistic curve that is fitted to
leave-one-out votes of the examples, weighted to the labels' true shares.  A text that shares no term with
any example gets the share of toxic ones among the labels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import bound_batches, give_back, share, tidy
from .terms import word_terms

MOST_EXAMPLES = 2048
CLEAR_EVIDENCE = 40.0
BLOCK = 256
NEIGHBOURS = 15
PRIOR = 0.5
LEVELS = np.array([1, 2, 3, *(1 << np.arange(2, 31))])
COMMON = 16
TOGETHER = 256
PART = 1 << 16
PIECE = 1 << 19
AXES = 1 << 13


def held_out(doc_id: str = "doc_id") -> Column:
    """The fold whose labels are never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def pick_examples(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = MOST_EXAMPLES) -> tuple[DataFrame, dict[int, float]]:
    """At most ``most`` labelled texts of each label outside the held-out fold, and each label's weight."""
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", F.col(label).cast("int").alias("label")).groupBy("doc_id").agg(F.max("label").alias("label"))
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    order = F.xxhash64("doc_id")
    taken = known.where("label = 1").orderBy(order, "doc_id").limit(most).union(known.where("label = 0").orderBy(order, "doc_id").limit(most))
    weights = {y: n / min(n, most) for y, n in counts.items()}
    return docs.select("doc_id", "text").join(F.broadcast(taken), "doc_id"), weights  # at most 2 * most ids


def count_terms(examples: DataFrame) -> DataFrame:
    """(doc_id, label, terms, levels) of the examples: hashes and how many levels they reach, in binary, one row for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, n, terms, rows in word_terms(batch.column(1)):
                order = np.argsort(rows, kind="stable")
                cuts = np.searchsorted(rows[order], np.arange(n + 1))
                held = [np.unique(terms[order[i:j]], return_counts=True) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
                columns = [pa.array([t.astype("<u8").tobytes() for t, _ in held], pa.binary()), pa.array([np.searchsorted(LEVELS, c, "right").astype("u1").tobytes() for _, c in held], pa.binary())]
                yield pa.RecordBatch.from_arrays([batch.column(0)[a : a + n], batch.column(2)[a : a + n], *columns], names=["doc_id", "label", "terms", "levels"])

    return examples.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "label").mapInArrow(tidy(run), "doc_id long, label int, terms binary, levels binary")


class Terms:
    """Terms at levels, numbered in their order; a term has all levels up to its last one."""

    def __init__(self, terms: np.ndarray, levels: np.ndarray):
        """terms: different, in order; levels: how many each has."""
        self.terms, self.levels = terms, levels.astype(np.int32)
        self.first = np.concatenate(([0], np.cumsum(self.levels)))
        self.size = int(self.first[-1])
        self.starts = np.searchsorted(terms, np.arange(1 << 18, dtype=np.uint64) << np.uint64(46)).astype(np.int32)

    def find(self, terms: np.ndarray) -> np.ndarray:
        """The places of terms, -1 where unknown."""
        if not len(self.terms):
            return np.full(len(terms), -1)
        at = self.starts[(terms >> np.uint64(46)).astype(np.int64)].astype(np.int64)
        last = len(self.terms) - 1
        todo = np.arange(len(terms))
        while len(todo):
            todo = todo[(at[todo] < last) & (self.terms[np.minimum(at[todo], last)] < terms[todo])]
            at[todo] += 1
        at = np.minimum(at, last)
        return np.where(self.terms[at] == terms, at, -1)

    def columns(self, rows: np.ndarray, terms: np.ndarray, tf: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Rows and columns, in order, of the terms that rows hold; tf: their repetitions, once each without."""
        at = self.find(terms)
        inside = at >= 0
        many = max(len(self.terms), 1)
        keys = rows[inside] * many + at[inside]
        if tf is None:
            keys.sort()
            first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
            keys, times = keys[first], np.diff(np.append(first, len(keys)))
        else:
            keys, where = np.unique(keys, return_inverse=True)
            times = np.bincount(where, tf[inside], len(keys))
        owner, base = np.divmod(keys, many)
        held = np.minimum(np.searchsorted(LEVELS, times, "right"), self.levels[base])
        return np.repeat(owner, held), np.repeat(self.first[base], held) + spread(held)


def spread(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... for each of the sizes."""
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def document_frequencies(docs: DataFrame, known: Terms) -> tuple[np.ndarray, int]:
    """How many of all ``docs`` hold each column of ``known``, and how many docs there are."""
    shared = share(docs.sparkSession, known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        found = np.zeros(known.size + 1, np.int64)
        for batch in batches:
            found[-1] += batch.num_rows
            for _, _, terms, rows in word_terms(batch.column(0)):
                found[:-1] += np.bincount(known.columns(rows, terms)[1], minlength=known.size)
        parts = range(0, len(found), PART)
        yield pa.RecordBatch.from_arrays([pa.array([a // PART for a in parts], pa.int32()), pa.array([found[a : a + PART].astype("<i8").tobytes() for a in parts], pa.binary())], names=["part", "counts"])

    def add(group: pa.Table) -> pa.Table:
        counts = sum(np.frombuffer(x, "<i8") for x in group.column("counts").to_pylist())
        return pa.table({"part": group.column("part")[:1], "counts": pa.array([counts.tobytes()], pa.binary())})

    counted = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(tidy(run), "part int, counts binary").groupBy("part").applyInArrow(add, "part int, counts binary")
    found = counted.toArrow()  # one number for each column
    order = np.argsort(found.column("part").to_numpy())
    found = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(found.column("counts")[i].as_buffer(), "<i8") for i in order.tolist())])
    return (found[:-1], int(found[-1])) if len(found) else (np.zeros(known.size, np.int64), 0)


def evidence(k1: np.ndarray, df: np.ndarray, toxic: int, clean: int) -> np.ndarray:
    """Weights of terms that k1 toxic examples of df hold: near 1 where their likelihood ratio against the
    label is far over ``CLEAR_EVIDENCE``, falling with its square below, never 0."""
    total = toxic + clean

    def part(k: np.ndarray, rows: np.ndarray | float, columns: float) -> np.ndarray:
        return np.where(k > 0, k * np.log(np.maximum(k, 1) * total / np.maximum(rows * columns, 1)), 0.0)

    ratio = 2 * (part(k1, df, toxic) + part(df - k1, df, clean) + part(toxic - k1, total - df, toxic) + part(clean - (df - k1), total - df, clean))
    square = (1 + np.maximum(ratio, 0)) ** 2
    return square / (square + CLEAR_EVIDENCE**2)


class Index:
    """Block-max inverted index of the examples; of bounded size."""

    def __init__(self, vocabulary: np.ndarray | list[tuple[int, int, float]], ids: np.ndarray, labels: np.ndarray, rows: np.ndarray, terms: np.ndarray, tf: np.ndarray, weights: dict[int, float], texts: int | None = None):
        """vocabulary: (term, level, texts with it) in order; ids, labels: of all examples; rows, terms, tf: what
        they hold, in order of rows; texts: of how many texts the vocabulary counts (the examples unless given)."""
        vocabulary = np.array(vocabulary, [("term", "<u8"), ("level", "<i4"), ("df", "<f8")])
        known = Terms(*np.unique(vocabulary["term"], return_counts=True))
        self._fill(known, vocabulary["df"], ids, labels, list(held_columns(known, len(ids), rows, terms, tf)), weights, texts)

    @classmethod
    def of(cls, known: Terms, df: np.ndarray, ids: np.ndarray, labels: np.ndarray, held: list[np.ndarray], weights: dict[int, float], texts: int) -> "Index":
        """As the constructor, of numbered terms; held: [rows, columns] of :func:`held_columns`, emptied here to keep the driver small."""
        made = cls.__new__(cls)
        made._fill(known, df, ids, labels, held, weights, texts)
        return made

    def _fill(self, known: Terms, df: np.ndarray, ids: np.ndarray, labels: np.ndarray, holding: list[np.ndarray], weights: dict[int, float], texts: int | None) -> None:
        self.known = known
        columns, rows = holding.pop(), holding.pop()
        toxic = int((labels == 1).sum())
        held = np.bincount(columns, minlength=self.known.size)
        clear = evidence(np.bincount(columns[labels[rows] == 1], minlength=self.known.size), held, toxic, len(ids) - toxic)
        texts = len(ids) if texts is None else texts
        self.square = (clear * (np.log((1 + texts) / (1 + np.minimum(df, texts))) + 1e-9)) ** 2
        holding += [rows, columns]
        del rows, columns
        rows, columns = self._join_alike(holding, held, len(ids))  # in order of columns
        norm, square = np.zeros(len(ids)), self.idf**2
        for a in range(0, len(rows), PIECE):
            norm += np.bincount(rows[a : a + PIECE], square[columns[a : a + PIECE]], len(ids))
        norm = np.sqrt(norm)
        full = np.flatnonzero(norm > 0)
        leading = np.full(len(ids), self.size)
        by_value = np.argsort(-self.idf, kind="stable").astype(np.int32)
        rank = np.empty_like(by_value)
        rank[by_value] = np.arange(self.size, dtype=np.int32)
        np.minimum.at(leading, rows, rank[columns])
        leading[full] = by_value[leading[full]]
        full = full[np.lexsort((full, leading[full], labels[full]))]  # alike examples share a block
        place = np.full(len(ids), -1)
        place[full] = np.arange(len(full))
        self.ids, self.labels = ids[full], labels[full]
        self.weights = np.array([weights.get(int(y), 1.0) for y in self.labels])
        share = [weights.get(y, 1.0) * float((labels == y).sum()) for y in (0, 1)]
        self.empty_score = (share[1] + PRIOR * 0.1) / (share[0] + share[1] + PRIOR) if len(ids) else 0.0
        self.inverse = 1 / norm[full]
        keys = columns.astype(np.int64) * max(len(full), 1)
        keys += place.astype(np.int32)[rows]
        del rows
        self.ends = np.cumsum(np.bincount(columns, minlength=self.size)).astype(np.int32)
        del columns
        keys.sort()
        keys %= max(len(full), 1)
        self.where = keys.astype(np.uint16 if len(full) < 1 << 16 else np.int32)
        del keys
        give_back()
        self._open()
        self.a, self.b = 1.0, 0.0
        self._calibrate()

    def _open(self) -> None:
        """What follows from the postings: their values, each block's largest ones, and the matrix of common terms."""
        held = np.diff(self.ends, prepend=0)
        self.blocks = -(-len(self.ids) // BLOCK)
        wide = self.blocks + 1
        common = np.flatnonzero(held * COMMON >= max(len(self.ids), 1))  # at most COMMON times the terms of an example
        self.dense_at = np.full(self.size, -1, np.int32)
        self.dense_at[common] = np.arange(len(common))
        self.dense = np.zeros((len(common), len(self.ids)), np.float32)
        self.most = np.zeros((self.size, self.blocks), np.float32)
        self.cuts = np.zeros(self.size * wide + 1, np.int32)
        for a in range(0, self.size, AXES):  # some axes at a time, to take little memory
            b = min(a + AXES, self.size)
            axis = np.repeat(np.arange(b - a), held[a:b])
            where = self.where[self.ends[a] - held[a] : self.ends[b - 1]].astype(np.int64)
            value = (self.idf[a + axis] * self.inverse[where]).astype(np.float32)
            self.cuts[a * wide + 1 : b * wide + 1] = self.cuts[a * wide] + np.cumsum(np.bincount(axis * wide + where // BLOCK, minlength=(b - a) * wide))
            np.maximum.at(self.most, (a + axis, where // BLOCK), value)
            at = self.dense_at[a + axis]
            self.dense[at[at >= 0], where[at >= 0]] = value[at >= 0]

    @property
    def value(self) -> np.ndarray:
        """The values of the postings."""
        return (self.idf[np.repeat(np.arange(self.size), np.diff(self.ends, prepend=0))] * self.inverse[self.where]).astype(np.float32)

    def __getstate__(self) -> dict:
        """Without what follows from the rest, to send little."""
        return {k: v for k, v in self.__dict__.items() if k not in ("cuts", "most", "dense_at", "dense")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._open()

    def _join_alike(self, holding: list[np.ndarray], held: np.ndarray, examples: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and axes: terms that the same examples hold are one axis, as long as all of them together."""
        keys = holding.pop().astype(np.int64) * max(examples, 1)
        keys += holding.pop()
        keys.sort()
        columns = (keys // max(examples, 1)).astype(np.int32)
        keys %= max(examples, 1)
        rows = keys.astype(np.int32)
        del keys
        cuts = np.cumsum(held) - held
        marks = np.random.default_rng(20240619).integers(1, 1 << 63, (2, examples), dtype=np.uint64)
        sums = np.zeros(self.known.size, np.complex128).view([("a", "<u8"), ("b", "<u8")])
        some = held > 0
        if some.any():
            for name, m in zip("ab", marks, strict=True):
                sums[name][some] = np.add.reduceat(m[rows], cuts[some])
        _, first, axis = np.unique(sums, return_index=True, return_inverse=True)
        self.axis_of, self.size = axis.astype(np.int32), len(first)
        self.idf = np.sqrt(np.bincount(axis, self.square, self.size))
        kept = first.astype(np.int32)[self.axis_of[columns]] == columns
        return rows[kept], self.axis_of[columns[kept]]

    def asked(self, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Axes and values of a text that holds the columns: its cosines with the examples are their products."""
        square = self.square[columns]
        axes, at = np.unique(self.axis_of[columns], return_inverse=True)
        return axes, np.bincount(at, square) / self.idf[axes] / np.sqrt(square.sum())

    def query(self, columns: np.ndarray) -> np.ndarray:
        value = self.idf[columns]
        return value / np.sqrt((value**2).sum())

    def nearest(self, columns: np.ndarray, value: np.ndarray, k: int, but: int = -1, scores: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of largest cosine (ties: lower place), with cosines over 0; ``but`` is left out.

        scores: the row of :meth:`common_part`, computed here unless given."""
        scores = self.common_part([(columns, value)])[0].astype(float) if scores is None else scores.astype(float)
        rare = self.dense_at[columns] < 0
        columns, value, rarity = columns[rare] * (self.blocks + 1), value[rare].astype(np.float32), self.idf[columns[rare]]
        if but >= 0:
            scores[but] = 0.0
        if len(columns) and len(scores):
            least = np.partition(scores, len(scores) - k)[-k] if len(scores) > k else 0.0
            bounds = np.maximum.reduceat(scores, np.arange(0, len(scores), BLOCK)) + value @ self.most[columns // (self.blocks + 1)]
            live = np.flatnonzero(bounds + 1e-6 >= least)
            value = value * rarity
            if len(live) == 0:
                live = np.zeros(1, np.int64)
            # Alike examples stand together, so the blocks that can hold a nearer one mostly follow each other.
            start = self.cuts[columns + live[0]]
            many = self.cuts[columns + live[-1] + 1] - start
            some = np.flatnonzero(many)
            start, many, value = start[some], many[some], value[some]
            at = np.repeat(start - np.cumsum(many) + many, many)
            at += np.arange(len(at), dtype=np.int32)
            where = self.where.take(at)
            scores += self.inverse * np.bincount(where, np.repeat(value, many), len(scores))
        if but >= 0:
            scores[but] = 0.0
        found = np.flatnonzero(scores > 0)
        rounded = np.round(scores[found], 7)
        if len(found) > k:
            most = rounded >= np.partition(rounded, len(found) - k)[-k]
            found, rounded = found[most], rounded[most]
        found = found[np.lexsort((found, -rounded))[:k]]
        return found, scores[found]

    def common_part(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """What the terms of many examples add to the cosines of rows (columns, values) with all examples."""
        asked = np.zeros((len(rows), len(self.dense)), np.float32)
        for i, (columns, value) in enumerate(rows):
            at = self.dense_at[columns]
            asked[i, at[at >= 0]] = value[at >= 0]
        return asked @ self.dense

    def neighbours(self, rows: list[tuple[np.ndarray, np.ndarray]], leave_out: int = -1) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The nearest examples of each row (columns, values); leave_out: rows are the examples from this place on."""
        for a in range(0, len(rows), TOGETHER):
            piece = rows[a : a + TOGETHER]
            for i, (row, scores) in enumerate(zip(piece, self.common_part(piece), strict=True)):
                yield self.nearest(*row, NEIGHBOURS, leave_out + a + i if leave_out >= 0 else -1, scores)

    def examples(self) -> Iterator[list[tuple[np.ndarray, np.ndarray]]]:
        """Columns and values of the examples by place, ``BLOCK`` of them at a time."""
        starts = self.cuts.reshape(-1)[: self.size * (self.blocks + 1)].reshape(self.size, self.blocks + 1) if self.blocks else np.zeros((self.size, 1), np.int32)
        for b in range(self.blocks):
            first, many = starts[:, b].astype(np.int64), starts[:, b + 1].astype(np.int64) - starts[:, b]
            columns = np.repeat(np.arange(self.size, dtype=np.int32), many)
            at = np.repeat(first, many) + spread(many)
            order = np.argsort(self.where[at], kind="stable")  # columns stay in order
            cuts = np.searchsorted(self.where[at][order], np.arange(b * BLOCK + 1, min((b + 1) * BLOCK, len(self.ids))))
            value = (self.idf[columns] * self.inverse[self.where[at]]).astype(np.float32)
            yield list(zip(np.split(columns[order], cuts), np.split(value[order], cuts), strict=True))

    def vote(self, found: np.ndarray, cosines: np.ndarray) -> float:
        near = cosines**2 / (1.05 - np.minimum(cosines, 1.0))
        return (float((near * (self.labels[found] == 1)).sum()) + PRIOR * 0.1) / (float(near.sum()) + PRIOR)

    def score(self, vote: float) -> float:
        return 1 / (1 + np.exp(-np.clip(self.a * np.log(vote / (1 - vote)) + self.b, -30, 30)))

    def _calibrate(self) -> None:
        """Fit the logistic curve to the examples' leave-one-out votes."""
        votes = np.array([self.vote(*near) for b, rows in enumerate(self.examples()) for near in self.neighbours(rows, leave_out=b * BLOCK)])
        if not len(votes):
            return
        x = np.log(votes / (1 - votes))
        positive = float((self.labels == 1).sum())
        y = np.where(self.labels == 1, (positive + 1) / (positive + 2), 1 / (len(votes) - positive + 2))
        a, b = 1.0, 0.0
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
            g, h = self.weights * (p - y), self.weights * p * (1 - p) + 1e-9
            matrix = np.array([[(h * x * x).sum() + 1.0, (h * x).sum()], [(h * x).sum(), h.sum() + 1e-3]])
            step = np.linalg.solve(matrix, [(g * x).sum() + (a - 1.0), g.sum()])
            step = np.clip(step, -1, 1)
            a, b = a - step[0], b - step[1]
            if np.abs(step).max() < 1e-7:
                break
        self.a, self.b = max(a, 1e-3), b


def held_columns(known: Terms, examples: int, rows: np.ndarray, terms: np.ndarray, tf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of ``known`` that examples hold, a part at a time to keep the driver small."""
    cuts = np.searchsorted(rows, np.arange(0, examples + 128, 128))
    parts = [[x.astype(np.int32) for x in known.columns(rows[i:j], terms[i:j], tf[i:j])] for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
    rows, columns = (np.concatenate([np.zeros(0, np.int32), *(x[k] for x in parts)]) for k in (0, 1))
    return rows, columns


def learn(docs: DataFrame, labels: DataFrame) -> Index:
    """The index of the examples among ``docs`` that ``labels`` (doc_id, toxic) marks.

    Repeated labels of one doc_id count once; of contradictory ones the larger holds.
    """
    bound_batches(docs.sparkSession)
    examples, weights = pick_examples(docs, labels)
    counted = count_terms(examples).toArrow()  # at most 2 * MOST_EXAMPLES texts
    ids, marks = (counted.column(c).to_numpy().astype(np.int64) for c in ("doc_id", "label"))
    parts = {c: [x.as_buffer() for x in counted.column(c)] for c in ("terms", "levels")}
    del counted
    order = sorted(range(len(ids)), key=lambda i: (ids[i], marks[i], parts["terms"][i].size, parts["terms"][i][:256].to_pybytes()))
    ids, marks = ids[order], marks[order]
    rows = np.repeat(np.arange(len(ids), dtype=np.int32), [parts["levels"][i].size for i in order])
    terms, levels = (np.concatenate([np.zeros(0, kind), *(np.frombuffer(parts.get(name)[i], kind) for i in order)]) for name, kind in (("terms", "<u8"), ("levels", "u1")))
    parts.clear()
    give_back()
    different = np.unique(terms)
    most = np.zeros(len(different), np.int32)
    np.maximum.at(most, np.searchsorted(different, terms), levels)
    known = Terms(different, most)
    held = list(held_columns(known, len(ids), rows, terms, LEVELS[levels - 1]))
    del rows, terms, levels, most, different
    give_back()
    frequency, texts = document_frequencies(docs, known)
    index = Index.of(known, frequency, ids, marks, held, weights, texts)
    give_back()
    return index


def score_texts(docs: DataFrame, index: Index, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted, neighbours, similarities) for each row of ``docs``.

    Null and empty texts share no term with any example and get the score for that.  Repeated rows are each scored;
    an empty table gives an empty one.  Only the text is an input of the score.
    """
    bound_batches(docs.sparkSession)
    shared = share(docs.sparkSession, index)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("neighbours", pa.list_(pa.int64())), ("similarities", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = shared.value
        for batch in batches:
            for a, n, terms, rows in word_terms(batch.column(1)):
                scores = np.full(n, ix.empty_score)
                near: list[list[int]] = [[]] * n
                like: list[list[float]] = [[]] * n
                owner, columns = ix.known.columns(rows, terms)
                cuts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1], [True]))) if len(owner) else np.zeros(0, np.int64)
                asked = [ix.asked(columns[i:j]) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
                for row, (found, cosines) in zip(owner[cuts[:-1]], ix.neighbours(asked), strict=True):
                    if len(found):
                        scores[row] = ix.score(ix.vote(found, cosines))
                        near[row], like[row] = ix.ids[found].tolist(), np.minimum(cosines, 1.0).tolist()
                yield pa.RecordBatch.from_arrays([batch.column(0)[a : a + n], pa.array(scores), pa.array(near, schema.field("neighbours").type), pa.array(like, schema.field("similarities").type)], schema=schema)

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidy(run), "doc_id long, score double, neighbours array<long>, similarities array<double>")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "neighbours", "similarities")
