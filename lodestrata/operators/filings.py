"""Annual reports: HTML to text with page starts, Item sections, and citation-ready chunks.

Lines, heading candidates, section ends, blocks and pages are DataFrame work; two small sequential helpers
run in Arrow batches: the choice of the best chain of headings, and the greedy packing of blocks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import chunk_id, plain_title
from ..intermediate import materialise

#: The items of the annual report form, in their order, with their titles.
ITEMS = {
    "1": "Business",
    "1A": "Risk Factors",
    "1B": "Unresolved Staff Comments",
    "1C": "Cybersecurity",
    "2": "Properties",
    "3": "Legal Proceedings",
    "4": "Mine Safety Disclosures",
    "5": "Market for Registrant's Common Equity, Related Stockholder Matters and Issuer Purchases of Equity Securities",
    "6": "Selected Financial Data",
    "7": "Management's Discussion and Analysis of Financial Condition and Results of Operations",
    "7A": "Quantitative and Qualitative Disclosures About Market Risk",
    "8": "Financial Statements and Supplementary Data",
    "9": "Changes in and Disagreements with Accountants on Accounting and Financial Disclosure",
    "9A": "Controls and Procedures",
    "9B": "Other Information",
    "9C": "Disclosure Regarding Foreign Jurisdictions that Prevent Inspections",
    "10": "Directors, Executive Officers and Corporate Governance",
    "11": "Executive Compensation",
    "12": "Security Ownership of Certain Beneficial Owners and Management and Related Stockholder Matters",
    "13": "Certain Relationships and Related Transactions, and Director Independence",
    "14": "Principal Accountant Fees and Services",
    "15": "Exhibits and Financial Statement Schedules",
    "16": "Form 10-K Summary",
}
RANK = {item: i for i, item in enumerate(ITEMS)}
LEAST_SECTIONS = 5
BACKED_CHARS = 200
TITLE_LINES = 3
LONGEST_HEADING = 400  # characters
TARGET_TOKENS = 512
OVERLAP_TOKENS = 64

_TOKENS = re.compile(r"\s*(?:\d+|[^\W\d_]+|\S)")

_BREAK = re.compile(r"page-break-(?:before|after)\s*:\s*always", re.I)
_HIDDEN = re.compile(r"display\s*:\s*none", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_DROPPED = ("script", "style")


class _Text(HTMLParser):
    """Text nodes of the visible part, with a mark where a page begins."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[str | None] = []  # None: a page rule
        self.hidden: list[str] = []

    def handle_starttag(self, tag, attrs):
        values = dict(attrs)
        style = values.get("style") or ""
        if self.hidden:
            if tag not in _VOID:
                self.hidden.append(tag)
            return
        if tag == "hr" or _BREAK.search(style):
            self.parts.append(None)
        local = tag.rpartition(":")[2]
        if (tag in _DROPPED or local in ("header", "hidden") and ":" in tag or _HIDDEN.search(style)) and tag not in _VOID:
            self.hidden.append(tag)

    def handle_startendtag(self, tag, attrs):
        if not self.hidden and (tag == "hr" or _BREAK.search(dict(attrs).get("style") or "")):
            self.parts.append(None)

    def handle_endtag(self, tag):
        if tag in self.hidden:
            while self.hidden.pop() != tag:
                pass

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)


def decode(raw: bytes | str) -> str:
    """UTF-8, else Windows-1252, else Latin-1."""
    if isinstance(raw, str):
        return raw
    for encoding in ("utf-8", "cp1252", "latin-1"):
        try:
            return raw.decode(encoding)
        except UnicodeDecodeError:
            continue
    return raw.decode("utf-8", "replace")


def html_to_text(raw: bytes | str | None) -> tuple[str, list[int]]:
    """The visible text, one text node a line, and the lines (from 0) at which pages begin."""
    parser = _Text()
    parser.feed(decode(raw or ""))
    parser.close()
    lines: list[str] = []
    pages: list[int] = []
    blank = 0
    waiting = False
    for part in parser.parts:
        if part is None:
            waiting = True
            continue
        for line in part.split("\n"):
            line = re.sub(r"[ \t\xa0 -​ 　\r\f\v]+", " ", line).strip()
            blank = 0 if line else blank + 1
            if not line and (blank > 1 or not lines):
                continue
            if waiting and line:
                pages.append(len(lines))
                waiting = False
            lines.append(line)
    while lines and not lines[-1]:
        lines.pop()
    return "\n".join(lines), pages


def extract_text(files: DataFrame, column: str = "content") -> DataFrame:
    """``files`` with text and page_starts in place of the markup; null markup gives an empty text."""
    kept = [c for c in files.columns if c not in (column, "text", "page_starts")]
    fields = ", ".join(f"`{c}` {files.schema[c].dataType.simpleString()}" for c in kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 100):
                piece = batch.slice(a, 100)
                texts, pages = zip(*map(html_to_text, piece.column(len(kept)).to_pylist()), strict=True)
                yield pa.RecordBatch.from_arrays([*piece.columns[: len(kept)], pa.array(texts, pa.string()), pa.array(pages, pa.list_(pa.int32()))], names=[*kept, "text", "page_starts"])

    return files.select(*kept, column).mapInArrow(run, f"{fields + ', ' if fields else ''}text string, page_starts array<int>")


def page_of_line(line: Column, page_starts: Column) -> Column:
    """The page, from 1, that holds a line; text before the first rule is on page 1."""
    return (F.size(F.filter(page_starts, lambda s: (s <= line) & (s > 0))) + 1).cast("int")


def text_lines(docs: DataFrame, key: str = "accession") -> DataFrame:
    """(key, line, raw, at): lines of each text from 0, and the offset at which each begins."""
    split = docs.select(key, F.posexplode(F.split("text", "\n")).alias("line", "raw"))
    before = Window.partitionBy(key).orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    return split.withColumn("at", F.coalesce(F.sum(F.length("raw") + 1).over(before), F.lit(0)).cast("long"))


def read_heading(line: str | None) -> dict | None:
    """The items that a line with the word "Item" or "Items" in front names, and the rest of the line; null for other lines.

    Items are those of the form, a letter up to one space behind its number.  They are in a list with a comma,
    an ampersand or "and" between them; what can't be read as one more item begins the rest.
    """
    tokens = _TOKENS.findall(line or "")
    if not tokens or tokens[0].lower() not in ("item", "items") or len(tokens) < 2 or not tokens[1][0].isspace():
        return None
    items, at, read = [], 1, 1
    while at < len(tokens):
        name = tokens[at].strip()
        if name not in ITEMS:
            break
        at += 1
        letter = tokens[at].strip().upper() if at < len(tokens) else ""
        if f"{name}{letter}" in ITEMS and letter:
            name, at = f"{name}{letter}", at + 1
        if at < len(tokens) and tokens[at][0].isalnum():  # more letters or digits without a space: no item
            break
        items.append(name)
        read = at
        if at == len(tokens) or tokens[at].strip().lower() not in (",", "&", "and"):
            break
        at += 1
    return {"items": items, "rest": "".join(tokens[read:]).strip()} if items else None


def _headings(lines: pd.Series) -> pd.DataFrame:
    read = [read_heading(x) or {"items": None, "rest": None} for x in lines]
    return pd.DataFrame(read, columns=["items", "rest"])


def heading(line: Column) -> Column:
    """(items, rest) as :func:`read_heading` reads a line; only lines that begin with the word leave the JVM's work."""
    return F.pandas_udf(_headings, "items array<string>, rest string")(F.when(F.lower(line).startswith("item"), line))


def heading_candidates(lines: DataFrame, key: str = "accession", also: tuple[str, ...] = ()) -> DataFrame:
    """(key, line, at, items, rest) and the columns ``also``: lines that could open an Item section.

    "Item 1A. ..." and combined forms, without pointers (a comma behind the number); or a line that is an
    Item's title, or a beginning of it of three words or more.
    """
    spark = lines.sparkSession
    titles = spark.createDataFrame(sorted(title_prefixes().items()), "title string, by_title string")  # a fixed list
    stripped = F.trim(F.regexp_replace("raw", r"(?U)\s+", " "))
    read = lines.where(F.length("raw") < LONGEST_HEADING).select(key, "line", "at", *also, stripped.alias("stripped"))
    read = read.withColumn("title", F.when(F.length("stripped") < 200, plain_title(F.col("stripped")))).join(F.broadcast(titles), "title", "left")
    read = read.where(F.lower("stripped").startswith("item") | F.col("by_title").isNotNull()).withColumn("h", heading(F.col("stripped")))
    numbered = F.col("h.items").isNotNull()
    items = F.when(numbered, F.when(~F.col("h.rest").startswith(","), F.col("h.items"))).when(F.col("by_title").isNotNull(), F.array("by_title"))
    found = read.select(key, "line", "at", *also, items.alias("items"), F.when(numbered, F.col("h.rest")).otherwise(F.col("stripped")).alias("rest"))
    return found.where(F.size("items") > 0)


def signs(line: Column) -> Column:
    """Whether a line opens the signatures: the word alone, or the sentence that the form prescribes."""
    plain = F.trim(F.regexp_replace(F.lower(line), "[^a-z0-9]+", " "))
    sentence = [F.contains(plain, F.lit(f"pursuant to the requirements of {x} 13 or 15 d")) for x in ("section", "sections")]
    return plain.isin("signature", "signatures") | sentence[0] | sentence[1]


def title_prefixes() -> dict[str, str]:
    """The items' titles in plain form, and their beginnings of three words or more, of 8 characters or more."""
    out: dict[str, str] = {}
    for item, name in ITEMS.items():
        words = re.sub("[^a-z0-9 ]", " ", name.lower()).split()
        for n in range(len(words), 0, -1):
            title = " ".join(words[:n])
            if len(title) >= 8 and (n == len(words) or n >= 3):
                out.setdefault(title, item)
    return out


def best_chain(ranks: list[int], lines: list[int], backed: list[bool]) -> list[int]:
    """Positions of the chain of headings in Item order with most backed headings, then longest, then
    earliest; of equals the first predecessor; empty below LEAST_SECTIONS.  Lines ascend; of one line only one is taken.

    A tree of maxima over the ranks has the best chain that ends below each rank, so a heading costs a logarithm.
    """
    size = max(ranks, default=0) + 1
    none = ((0, 0, 0), 1)  # (backed, length, - lines), - place
    tree = [none] * (size + 1)
    best: list[tuple[tuple[int, int, int], int]] = []
    waiting: list[int] = []
    for i, (rank, line) in enumerate(zip(ranks, lines, strict=True)):
        if waiting and lines[waiting[0]] < line:
            for j in waiting:
                node, entry = ranks[j] + 1, (best[j][0], -j)
                while node <= size:
                    tree[node] = max(tree[node], entry)
                    node += node & -node
            waiting = []
        node, top = rank, none
        while node > 0:
            top = max(top, tree[node])
            node -= node & -node
        (kept, length, places), place = top
        best.append(((kept + int(backed[i]), length + 1, places - line), -place))
        waiting.append(i)
    at = max(range(len(best)), key=lambda i: (best[i][0], -i), default=-1)
    if at < 0 or best[at][0][1] < LEAST_SECTIONS:
        return []
    chain = []
    while at >= 0:
        chain.append(at)
        at = best[at][1]
    return chain[::-1]


def _chains(ranks: pd.Series, lines: pd.Series, backed: pd.Series) -> pd.Series:
    return pd.Series([best_chain([int(x) for x in r], [int(x) for x in n], [bool(x) for x in b]) for r, n, b in zip(ranks, lines, backed, strict=True)])


def _marked(titles: list[str]):
    """Of each text its number, its count of lines, where the last one begins, and the few lines that may be headings or
    signatures, each with the first line behind it (of ``TITLE_LINES``) that has more than dots and dashes.

    The patterns let through all that :func:`heading_candidates` and :func:`signs` take, and other lines; those decide.
    """
    opening = rf"^[^a-zA-Z]*(?i:item|{'|'.join(sorted({t.split()[0] for t in titles}))})"
    signing = r"^[^a-zA-Z0-9]*(?i:signatures?)[^a-zA-Z0-9]*$|(?i:pursuant)"
    filled = r"[^.\-:—–\t\n\x0b\f\r ]"

    def marks(texts: pa.Array) -> list[pa.Array]:
        split = pc.split_pattern(texts, "\n")
        ends = split.offsets.to_numpy().astype(np.int64)
        raw = split.flatten()
        sizes = pc.utf8_length(raw).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        at = np.concatenate(([0], np.cumsum(sizes)))
        short = np.flatnonzero(sizes <= LONGEST_HEADING)
        hit = np.zeros(len(raw), bool)
        hit[short] = pc.match_substring_regex(raw.take(pa.array(short)), opening).to_numpy(zero_copy_only=False)
        hit |= pc.match_substring_regex(raw, signing).to_numpy(zero_copy_only=False)
        hits = np.flatnonzero(hit)
        doc = np.searchsorted(ends, hits, "right") - 1
        below = np.full(len(hits), -1)
        for k in range(TITLE_LINES, 0, -1):
            inside = np.flatnonzero(hits + k < ends[doc + 1])
            behind = hits[inside] + k
            held = pc.match_substring_regex(raw.take(pa.array(behind)), filled).to_numpy(zero_copy_only=False)
            below[inside[held]] = behind[held]
        columns = [pa.array((hits - ends[doc]).astype(np.int32)), pa.array(at[hits] - at[ends[doc]]), raw.take(pa.array(hits)), raw.take(pa.array(below, mask=below < 0))]
        listed = pa.ListArray.from_arrays(pa.array(np.searchsorted(hits, ends).astype(np.int32)), pa.StructArray.from_arrays(columns, ["line", "at", "raw", "below"]))
        return [pa.array(np.diff(ends).astype(np.int32)), pa.array(at[ends[1:] - 1] - at[ends[:-1]]), listed]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                piece = batch.slice(a, 256)
                numbers = pa.array(np.arange(number, number + piece.num_rows))
                number += piece.num_rows
                yield pa.RecordBatch.from_arrays([numbers, piece.column(0), *marks(piece.column(1))], ["doc", "key", "total", "last_at", "marks"])

    return run


def sections(docs: DataFrame, key: str = "accession") -> DataFrame:
    """(key, item, covers, title, start_line, end_line): Item sections, and what stands before the first and
    from the signatures on under an empty item; nothing where no chain of headings is found.

    One pass over the texts keeps the few lines that matter; only headings are shuffled.  Rows of one key are separate texts."""
    kind = docs.schema[key].dataType.simpleString()
    read = docs.where("text is not null").select(key, "text").mapInArrow(_marked(list(title_prefixes())), f"doc long, key {kind}, total int, last_at long, marks array<struct<line:int,at:long,raw:string,below:string>>")
    texts = materialise(read, "marked-lines")
    candidates = heading_candidates(texts.select("doc", F.inline("marks")), "doc", ("below",))
    rank = F.element_at(F.create_map(*(F.lit(x) for pair in RANK.items() for x in pair)), F.element_at("items", 1))
    gathered = candidates.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("line", "at", rank.alias("rank"), "items", "rest", "below"))).alias("c"))
    signed = F.transform(F.filter("marks", lambda x: signs(x["raw"])), lambda x: x["line"])
    spaced = gathered.join(texts.select("doc", "key", "total", "last_at", signed.alias("signed")), "doc")
    backed = F.transform("c", lambda x, i: F.coalesce(F.get("c", i + 1)["at"], F.col("last_at")) - x["at"] > BACKED_CHARS)
    chain = F.pandas_udf(_chains, "array<int>")(F.transform("c", lambda x: x["rank"]), F.transform("c", lambda x: x["line"]), backed)
    chosen = spaced.withColumn("chain", chain).where(F.size("chain") > 0).withColumn("heads", F.transform("chain", lambda i: F.get("c", i)))
    signature = F.array_min(F.filter("signed", lambda n: n > F.element_at("heads", -1)["line"]))
    ends = materialise(chosen.select("key", "total", "heads", signature.alias("signature")), "headings")
    each = ends.select("key", "heads", F.coalesce("signature", "total").alias("stop"), F.posexplode("heads").alias("i", "h"))
    each = each.select("key", F.col("h.items").alias("covers"), F.col("h.rest").alias("rest"), F.trim("h.below").alias("below"), F.col("h.line").alias("start_line"), F.coalesce(F.get("heads", F.col("i") + 1)["line"], F.col("stop")).alias("end_line"))
    bare = F.regexp_replace("rest", r"^[.\-:—–\s]+", "")
    opens = heading(F.col("below"))["items"].isNotNull()
    title = F.when(bare != "", bare).when(~F.col("opens"), F.col("below")).otherwise("")
    body = each.withColumn("opens", opens).select(F.col("key").alias(key), F.element_at("covers", 1).alias("item"), "covers", F.regexp_replace(F.coalesce(title, F.lit("")), r"\.+$", "").alias("title"), "start_line", "end_line")
    empty = [F.lit("").alias("item"), F.array().cast("array<string>").alias("covers"), F.lit("").alias("title")]
    first = F.get("heads", F.lit(0))["line"]
    head = ends.where(first > 0).select(F.col("key").alias(key), *empty, F.lit(0).alias("start_line"), first.alias("end_line"))
    tail = ends.where("signature < total").select(F.col("key").alias(key), *empty, F.col("signature").alias("start_line"), F.col("total").alias("end_line"))
    return body.unionByName(head).unionByName(tail)


def token_count(c: Column) -> Column:
    """The default counter: words and punctuation marks.  Any other column of counts may take its place."""
    return F.size(F.regexp_extract_all(c, F.lit(r"(?U)(\w+|[^\w\s])"), 1))


def pack_blocks(tokens: list[int], target: int = TARGET_TOKENS, overlap: int = OVERLAP_TOKENS) -> list[tuple[int, int]]:
    """Ranges of whole blocks: up to ``target`` tokens with one for each join, or one larger block; the next
    range steps back over at least one block of a range of several, and over more while they fit ``overlap``."""
    out, at = [], 0
    while at < len(tokens):
        end, total = at + 1, tokens[at]
        while end < len(tokens) and total + tokens[end] + 1 <= target:
            total += tokens[end] + 1
            end += 1
        out.append((at, end))
        if end == len(tokens):
            break
        back, carried = 0, 0
        while back < end - at - 1 and carried < overlap and (not back or carried + tokens[end - 1 - back] <= overlap):
            carried += tokens[end - 1 - back]
            back += 1
        at = end - back
    return out


def _packs(tokens: pd.Series) -> pd.Series:
    return pd.Series([[{"a": a, "b": b} for a, b in pack_blocks([int(x) for x in t])] for t in tokens])


def chunk_filings(docs: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """Chunks of ``docs`` (accession, ticker, period, text, page_starts) by section, or of the whole text
    under an empty item where there are no sections."""
    written = materialise(text_lines(docs), "lines")
    found = materialise(sections(docs), "sections") if found is None else found
    bare = docs.join(found.select("accession").distinct(), "accession", "left_anti").select("accession", F.lit("").alias("item"), F.lit("").alias("title"), F.lit(0).alias("start_line"), F.lit(2**31 - 1).alias("end_line"))
    spans = found.select("accession", "item", "title", "start_line", "end_line").unionByName(bare)
    lines = written.withColumn("block", F.trim("raw")).where("block <> ''").withColumn("tokens", token_count(F.col("block"))).withColumnRenamed("accession", "doc")
    inside = spans.join(lines, (F.col("accession") == F.col("doc")) & (F.col("line") >= F.col("start_line")) & (F.col("line") < F.col("end_line")))
    rows = F.sort_array(F.collect_list(F.struct("line", "tokens", "block")))
    packed = inside.groupBy("accession", "item", "title", "start_line").agg(rows.alias("blocks")).withColumn("ranges", F.pandas_udf(_packs, "array<struct<a:int,b:int>>")(F.transform("blocks", lambda x: x["tokens"])))
    each = packed.select("accession", "item", "title", "start_line", "blocks", F.posexplode("ranges").alias("nth", "r")).withColumn("own", F.slice("blocks", F.col("r.a") + 1, F.col("r.b") - F.col("r.a")))
    text = F.array_join(F.transform("own", lambda x: x["block"]), "\n")
    order = Window.partitionBy("accession").orderBy("start_line", "nth")
    joined = each.join(docs.select("accession", "ticker", "period", "page_starts"), "accession").withColumn("index", (F.row_number().over(order) - 1).cast("int"))
    first, last = page_of_line(F.element_at("own", 1)["line"], F.col("page_starts")), page_of_line(F.element_at("own", -1)["line"], F.col("page_starts"))
    return joined.select(chunk_id(F.col("accession"), F.col("item"), F.col("index")).alias("chunk_id"), "accession", "ticker", "period", "item", "title", "index", first.alias("first_page"), last.alias("last_page"), token_count(text).alias("tokens"), text.alias("text"))
