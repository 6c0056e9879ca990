import random

import numpy as np
import pytest

from lodestrata.operators import span_join


def brute(chunks, spans):
    return sorted((s, c) for s, n in spans for c, t in chunks if n and t and n in t)


def made(seed, n, m):
    rng = random.Random(seed)
    letters = ["a", "b", "ab", "é", "日本", " "]
    chunks = [(i, "".join(rng.choices(letters, k=rng.randint(0, 400)))) for i in range(n)] + [(n, None), (n + 1, "")]
    spans = []
    for s in range(m):
        text = rng.choice(chunks[:n])[1]
        a = rng.randrange(len(text) + 1)
        cut = text[a : a + rng.choice([1, 2, 3, 5, 8, 17, 40, 90, 300])]
        spans.append((f"s{s}", cut if rng.random() < 0.8 else cut + "x"))
    return chunks, spans + [("none", None), ("empty", "")]


def tables(spark, chunks, spans):
    return spark.createDataFrame(chunks, "chunk_id long, text string").repartition(3), spark.createDataFrame(spans, "span_id string, needle string").repartition(2)


def test_spans_are_found_as_by_brute_force(spark):
    chunks, spans = made(1, 120, 300)
    got = span_join.span_places(*tables(spark, chunks, spans))
    assert sorted(tuple(r) for r in got.collect()) == brute(chunks, spans)


@pytest.mark.parametrize("m", [1, 40, 3000])
def test_texts_are_read_once_whatever_the_number_of_spans(spark, m):
    chunks, spans = made(2, 60, m)
    scanned = spark.sparkContext.accumulator(0)
    span_join.span_places(*tables(spark, chunks, spans), scanned).collect()
    assert scanned.value == len(chunks)


def test_a_full_bitmap_only_passes_more(spark, monkeypatch):
    monkeypatch.setattr(span_join, "MOST_BITS", 1 << 12)
    chunks, spans = made(3, 60, 2000)
    got = span_join.span_places(*tables(spark, chunks, spans))
    assert sorted(tuple(r) for r in got.collect()) == brute(chunks, spans)


def test_long_texts_slices_and_shared_beginnings(spark):
    start = "the same sixty-four bytes at the beginning of each of the spans, "
    spans = [(f"s{i}", f"{start}then {i} " + "z" * 3000) for i in range(30)] + [("one", start)]
    chunks = [(i, "q" * 900_000 + spans[i][1] + "tail") for i in range(4)] + [(9, start * 3)]
    got = span_join.span_places(*tables(spark, chunks, spans))
    assert sorted(tuple(r) for r in got.collect()) == brute(chunks, spans)


def test_nothing_against_nothing(spark):
    chunks, spans = tables(spark, [(1, "abc")], [("a", "abc")])
    assert span_join.span_places(chunks.limit(0), spans).collect() == [] == span_join.span_places(chunks, spans.limit(0)).collect()


def test_hashes_roll():
    data = np.frombuffer("abcabcabd".encode() * 9, np.uint8)
    got = dict(span_join.rolled(data, [1, 4, 16]))
    assert sorted(got) == [1, 4, 16] and len(got[16]) == len(data) - 15
    for q, h in got.items():
        again = [int(next(iter(dict(span_join.rolled(data[i : i + q], [q])).values()))[0]) for i in range(len(h))]
        assert again == h.tolist()
        assert len(set(h.tolist())) == len({data[i : i + q].tobytes() for i in range(len(h))})
