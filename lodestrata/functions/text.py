"""Text functions as column expressions; none leaves the JVM except the strict casefold."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Curly quotes and dashes, and what they fold to.
FOLD_FROM = "‘’“”–—"
FOLD_TO = "''\"\"--"
#: Words that carry no topic.
STOPWORDS = tuple(
    "a an the and or but if then than that this these those of in on at to for from by with without as is are was were be been being do does did doing have has had having it its it's we our us they their them he she his her you your i my what which who whom whose when where why how much many any all some no not".split()
)
#: Endings, tried in this order.
ENDINGS = ("ments", "ment", "ings", "ing", "ions", "ion", "ies", "ed", "es", "s")
#: Legal forms that are no part of a company's name.
LEGAL_FORMS = ("inc", "incorporated", "corp", "corporation", "co", "company", "plc", "ltd", "limited", "llc", "lp", "sa", "nv", "ag", "the")
#: Suffixes of persons' names.
NAME_SUFFIXES = ("jr", "sr", "ii", "iii", "iv", "phd", "md")


def normalize(c: Column) -> Column:
    """Fold quotes and dashes, lower-case, make each run of white space one space, trim."""
    return F.trim(F.regexp_replace(F.lower(F.translate(c, FOLD_FROM, FOLD_TO)), r"(?U)\s+", " "))


def normalize_strict(c: Column) -> Column:
    """As :func:`normalize` with full case folding."""
    table = str.maketrans(FOLD_FROM, FOLD_TO)

    def fold(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else " ".join(t.translate(table).casefold().split()))

    return F.pandas_udf(fold, "string")(c)


def contains_span(text: Column, span: Column) -> Column:
    """Whether the text holds the span, both normalised; an empty span is refused inside the plan."""
    needle = normalize(span)
    return F.when(needle == "", F.raise_error(F.lit("a span is empty after normalization"))).otherwise(F.contains(normalize(text), needle))


def lexemes(c: Column) -> Column:
    """The simple analyzer: runs of a-z and 0-9 in lower case, in order, with repetitions."""
    return F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"), 1)


def stem(w: Column) -> Column:
    """Strip the first of the endings that leaves at least four characters."""
    out = w
    for ending in reversed(ENDINGS):
        base = F.substring(w, F.lit(1), F.length(w) - len(ending))
        if ending == "ies":  # a doubled i goes too
            base = F.regexp_replace(base, "i$", "")
        out = F.when(w.endswith(ending) & (F.length(w) - len(ending) >= 4), base).otherwise(out)
    return out


def content_words(c: Column) -> Column:
    """Distinct stems of the words that carry a topic."""
    folded = F.lower(F.regexp_replace(F.translate(c, "‘’", "''"), r"\p{Pd}", "-"))
    words = F.transform(F.regexp_extract_all(folded, F.lit("([a-z0-9']+)"), 1), lambda w: F.btrim(w, F.lit("'")))
    kept = F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(*STOPWORDS))
    return F.array_distinct(F.transform(kept, stem))


def shares_content_word(a: Column, b: Column) -> Column:
    return F.arrays_overlap(content_words(a), content_words(b))


def company(c: Column) -> Column:
    """A company's name without register qualifiers, punctuation and legal forms."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(c), "/[a-z]{2,4}/", " "), "[^a-z0-9 ]", " ")
    return F.array_join(F.filter(F.split(plain, " +"), lambda w: (w != "") & ~w.isin(*LEGAL_FORMS)), " ")


def without_trailing_qualifier(c: Column) -> Column:
    return F.regexp_replace(c, r"/[A-Za-z]{2,4}/?\s*$", "")


def name_tokens(c: Column) -> Column:
    plain = F.regexp_replace(F.lower(c), "[^a-z ]", " ")
    return F.filter(F.split(plain, " +"), lambda w: (w != "") & ~w.isin(*NAME_SUFFIXES))


def plain_title(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9 ]", " "), " +", " "))


def squeeze(c: Column) -> Column:
    """Lower case without any white space."""
    return F.lower(F.regexp_replace(c, r"(?U)\s+", ""))


def anchor_key(c: Column) -> Column:
    """A quotation without figures, currency signs and punctuation."""
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(c, r"[0-9\p{Sc}\p{P}]", " ")), r"(?U)\s+", " "))


def leading_integer(c: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(c, r"(\d[\d,]*)", 1), ",", "").try_cast("long")


def number(c: Column) -> Column:
    """A figure without commas, dollar signs and white space; null where it is none."""
    return F.regexp_replace(c, r"[,$\s]", "").try_cast("double")


def two_places(c: Column) -> Column:
    """A double to two decimals, as text: its hundredfold rounded half up, as SQL casts to DECIMAL(18,2); a cast in
    Spark rounds the shortest decimal text instead, and so is a unit less where a product lies a bit under the half."""
    return (F.round(c.cast("double") * 100).cast("decimal(18,0)") / 100).cast("decimal(18,2)").cast("string")


def sum_of(c: Column) -> Column:
    """The value of ``a + b + c``, null where a part is no number."""
    parts = F.transform(F.split(c, r"\+"), lambda p: F.regexp_replace(F.trim(p), ",", "").try_cast("double"))
    total = F.aggregate(parts, F.lit(0.0), lambda s, p: s + p)
    return F.when(F.forall(parts, lambda p: p.isNotNull()), F.round(total, 10))


def or_query(words: Column) -> Column:
    """Lexemes as an OR query text; null where there are none."""
    quoted = F.transform(words, lambda w: F.concat(F.lit("'"), F.replace(w, F.lit("'"), F.lit("''")), F.lit("'")))
    return F.when(F.size(words) > 0, F.array_join(quoted, " | "))


def query_lexemes(c: Column) -> Column:
    """The distinct lexemes of an OR query text in order of first appearance; empty for null."""
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit("'((?:[^']|'')*)'"), 1)
    return F.array_distinct(F.transform(found, lambda w: F.replace(w, F.lit("''"), F.lit("'"))))


def digits_within(a: Column, b: Column) -> Column:
    """Whether every run of digits of a stands in b, commas left out."""
    runs = lambda c: F.regexp_extract_all(F.regexp_replace(c, r"(?<=\d),(?=\d)", ""), F.lit(r"(\d+)"), 1)
    return F.size(F.array_except(runs(a), runs(b))) == 0


def chunk_id(accession: Column, item: Column, index: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", accession, item, index.cast("string")), 256), 1, 16)


def call_id(query_id: Column, ids: Column) -> Column:
    return F.concat(query_id, F.lit("-"), F.substring(F.sha2(F.array_join(ids, "|"), 256), 1, 12))


def answer_key(query_id: Column, answer: Column) -> Column:
    return F.concat(query_id, F.lit(":"), F.substring(F.sha2(F.concat(query_id, F.lit("|"), normalize(answer)), 256), 1, 12))


def vector_literal(v: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(v, lambda x: x.cast("string")), ","), F.lit("]"))


def millions(c: Column) -> Column:
    """A figure in millions for display."""
    return F.when(F.abs(c) >= 1000, F.concat(F.lit("$"), F.format_number(c / 1000, 1), F.lit("B"))).when(c.isNotNull(), F.concat(F.lit("$"), F.format_number(c, 0), F.lit("M")))
