import random
import time

import pytest
from pyspark.sql import functions as F

from lodestrata.operators import filings


def test_html_cases():
    text, pages = filings.html_to_text("<html><style>x{}</style><script>y</script><p>A&amp;B  c</p><div style='display: none'>no</div><ix:header>no</ix:header><hr/><p>two</p><td>1</td><td>2</td>")
    assert text.split("\n") == ["A&B c", "two", "1", "2"] and pages == [1]
    assert filings.html_to_text("") == ("", []) and filings.html_to_text(None) == ("", [])
    assert filings.html_to_text("<p>a<p>\n\n\n\n<p>b <b>c")[0] == "a\n\nb\nc"
    assert filings.html_to_text("caf\xe9".encode("cp1252"))[0] == "café"


def test_pages(spark):
    df = spark.range(5).select("id", F.array(F.lit(0), F.lit(2), F.lit(4)).alias("s"))
    assert [r[0] for r in df.select(filings.page_of_line(F.col("id"), F.col("s"))).collect()] == [1, 1, 2, 2, 3]


def test_packing_quirks():
    assert filings.pack_blocks([100, 400, 200]) == [(0, 2), (1, 2), (2, 3)]
    assert filings.pack_blocks([900, 10]) == [(0, 1), (1, 2)]
    assert filings.pack_blocks([]) == []
    ranges = filings.pack_blocks([60] * 40)
    assert all(b2 > a2 and a2 < b1 for (_, b1), (a2, b2) in zip(ranges[:-1], ranges[1:], strict=True)) and ranges[-1][1] == 40


def filing() -> str:
    toc = [f"Item {i}. {t}" for i, t in list(filings.ITEMS.items())[:11]]
    body = []
    for item, title in list(filings.ITEMS.items())[:11]:
        body += [f"Item {item}.", "", title + "."] + [f"Paragraph {k} of {item} has words to fill the line with text and more text." for k in range(6)]
    return "\n".join(["Cover page", *toc, *body, "SIGNATURES", "Signed by."])


def test_sections_take_the_body(spark):
    docs = spark.createDataFrame([("A", filing()), ("B", "nothing here")], "accession string, text string")
    got = filings.sections(docs).orderBy("start_line").collect()
    assert {r.accession for r in got} == {"A"}
    named = [r for r in got if r.item]
    assert [r.item for r in named] == list(filings.ITEMS)[:11] and named[0].start_line == 14  # the title line is the one with text behind it
    assert named[1].title == "Risk Factors" and got[0].item == "" and got[-1].item == ""
    assert all(x.end_line == y.start_line for x, y in zip(got[:-1], got[1:], strict=True))


def test_chunks_cover_all_lines(spark):
    docs = spark.createDataFrame([("A", "T", "2024", filing(), [0, 20]), ("B", "T", "2024", "one line\n\nanother", [])], "accession string, ticker string, period string, text string, page_starts array<int>")
    got = filings.chunk_filings(docs).orderBy("accession", "index").collect()
    lines = {line for r in got if r.accession == "A" for line in r.text.split("\n")}
    assert lines == {x for x in filing().split("\n") if x}
    assert [r.text for r in got if r.accession == "B"] == ["one line\nanother"]
    assert [r["index"] for r in got if r.accession == "A"] == list(range(sum(r.accession == "A" for r in got)))
    assert len({r.chunk_id for r in got}) == len(got) and max(r.last_page for r in got) == 2


#: Lines, the items that they name, and the rest.
HEADINGS = [
    ("Item 1A. Risk Factors", ["1A"], ". Risk Factors"),
    ("ITEM 7 Management", ["7"], "Management"),
    ("Items 1 and 2. Business and Properties", ["1", "2"], ". Business and Properties"),
    ("Items 9, 9A & 9B", ["9", "9A", "9B"], ""),
    ("item 1 a. x", ["1A"], ". x"),
    ("Item 16", ["16"], ""),
    ("Item 8, which see", ["8"], ", which see"),
    ("Item 10 and others", ["10"], "and others"),
    ("Item 17. Nothing", None, None),
    ("Item 1Alpha", None, None),
    ("Item 101 of Regulation S-K", None, None),
    ("Item1. Business", None, None),
    ("Itemized 1", None, None),
    ("The Item 1", None, None),
    ("Items 1 and 2nd", ["1"], "and 2nd"),
    ("Item", None, None),
    ("", None, None),
]


@pytest.mark.parametrize(("line", "items", "rest"), HEADINGS)
def test_headings(line, items, rest):
    got = filings.read_heading(line)
    assert got == ({"items": items, "rest": rest} if items else None)


def brute_chain(ranks, lines, backed):
    best = []
    for i in range(len(ranks)):
        own, before = (int(backed[i]), 1, -lines[i]), -1
        for j in range(i):
            if lines[j] < lines[i] and ranks[j] < ranks[i]:
                joined = (best[j][0][0] + int(backed[i]), best[j][0][1] + 1, best[j][0][2] - lines[i])
                if joined > own:
                    own, before = joined, j
        best.append((own, before))
    at = max(range(len(best)), key=lambda i: (best[i][0], -i), default=-1)
    if at < 0 or best[at][0][1] < filings.LEAST_SECTIONS:
        return []
    chain = []
    while at >= 0:
        chain.append(at)
        at = best[at][1]
    return chain[::-1]


def test_chains_are_those_of_all_pairs():
    rng = random.Random(4)
    for _ in range(400):
        n = rng.randint(0, 40)
        lines = sorted(rng.choices(range(rng.choice([10, 60])), k=n))
        ranks, backed = rng.choices(range(23), k=n), rng.choices([True, False], k=n)
        assert filings.best_chain(ranks, lines, backed) == brute_chain(ranks, lines, backed)


def test_a_hundred_thousand_candidates():
    rng = random.Random(5)
    ranks = rng.choices(range(23), k=100_000)
    began = time.process_time()
    assert len(filings.best_chain(ranks, list(range(100_000)), [True] * 100_000)) == 23
    assert time.process_time() - began < 3


def test_sections_read_the_texts_once(spark):
    """Lines that are no headings leave no trace but a count: nothing is shuffled or written for them."""
    from lodestrata.operators.filings import _marked, title_prefixes

    odd = "\n".join(["  ITEM 1. Business", "--", "", "below", "x" * 5000, "an item of prose", "signatures.", "Pursuant to the requirements of Section 13 or 15(d)", "é Risk Factors", ""])
    docs = spark.createDataFrame([("A", odd), ("A", ""), (None, filing()), ("C", None)], "accession string, text string")
    read = docs.where("text is not null").coalesce(1).mapInArrow(_marked(list(title_prefixes())), "doc long, key string, total int, last_at long, marks array<struct<line:int,at:long,raw:string,below:string>>").orderBy("doc").collect()
    lines = odd.split("\n")
    assert [r.total for r in read] == [10, 1, len(filing().split("\n"))] and [r.last_at for r in read[:2]] == [len(odd), 0]
    assert [(m.line, m.at, m.raw) for m in read[0].marks] == [(i, sum(len(x) + 1 for x in lines[:i]), lines[i]) for i in (0, 6, 7, 8)]
    assert [m.below for m in read[0].marks] == ["below", lines[7], lines[8], None]
    assert filings.sections(docs).where("accession is null").count() == 13  # a text without a name is a text


def test_texts_that_share_a_name_are_separate(spark):
    docs = spark.createDataFrame([("A", filing()), ("A", filing()), ("A", "Cover\n" + filing())], "accession string, text string")
    got = filings.sections(docs)
    one = filings.sections(docs.limit(1)).count()
    assert got.count() == 3 * one and got.where("start_line = 0 and end_line = 15").count() == 1
