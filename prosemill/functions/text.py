"""Scalar functions as Column expressions; all run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from prosemill.functions import patterns as P


def normalize(c) -> Column:
    """Runs of Unicode white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def trimmed(c) -> Column:
    """Without Unicode white space at the ends."""
    return F.regexp_replace(F.regexp_replace(c, r"(?U)\s+\z", ""), r"(?U)\A\s+", "")


def last_word(c) -> Column:
    """The last word without the quotes around it."""
    word = F.regexp_extract(trimmed(c), r"(?U)(\S+)\z", 1)
    return F.regexp_replace(word, f"^[{P.QUOTES}]+|[{P.QUOTES}]+$", "")


def ends_with_title(c) -> Column:
    return last_word(c).isin(*P.TITLES)


def is_title(c) -> Column:
    return F.col(c).isin(*P.TITLES) if isinstance(c, str) else c.isin(*P.TITLES)


def is_abbreviation(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.isin(*P.FEW_TITLES, *P.OTHER_ABBREVIATIONS)


def ends_with_abbreviation(c) -> Column:
    return is_abbreviation(last_word(c))


def tsv_escape(c) -> Column:
    """Line breaks and tabs as two characters each; carriage returns stay."""
    return F.replace(F.replace(c, F.lit("\n"), F.lit("\\n")), F.lit("\t"), F.lit("\\t"))


def format_span(span) -> Column:
    s = F.col(span) if isinstance(span, str) else span
    return F.format_string("(%d,%d,%d,%d)", s["start_line"], s["start_col"], s["end_line"], s["end_col"])


def parse_span(c) -> Column:
    """The span that a string names, null where it names none."""
    parts = [F.regexp_extract(c, r"\((\d+),(\d+),(\d+),(\d+)\)", k) for k in range(1, 5)]
    names = ("start_line", "start_col", "end_line", "end_col")
    return F.when(parts[0] != "", F.struct(*[p.cast("int").alias(n) for p, n in zip(parts, names)]))


def pattern_name(state, pid) -> Column:
    """A seam's label by state and pattern number."""
    table = F.create_map(*[x for k, joints in enumerate(P.JOINTS) for i, s in enumerate(joints) for x in (F.lit(f"{P.STATES[k]}/{i}"), F.lit(s[3]))])
    return F.coalesce(F.try_element_at(table, F.concat_ws("/", state, pid.cast("string"))), F.concat(F.lit("Unknown["), pid.cast("string"), F.lit("]")))


def lines_joined(c, first, last) -> Column:
    """Lines first to last (from 1) with a space between them."""
    parts = F.transform(F.split(c, "\n", -1), lambda x: F.regexp_replace(x, "\r+$", ""))
    return F.array_join(F.slice(parts, first, last - first + 1), " ")


def region_verbatim(lines, span) -> Column:
    """What a span covers of a text's lines, breaks and all: lines and columns from 1, the end column excluded. Null where its first line is not there."""
    lines, s = (F.col(x) if isinstance(x, str) else x for x in (lines, span))
    one = F.get(lines, s["start_line"] - 1).substr(s["start_col"], s["end_col"] - s["start_col"])
    # Lines in between stay whole, and of the last one so many columns are taken.
    between = F.slice(lines, s["start_line"] + 1, F.greatest(s["end_line"] - s["start_line"] - 1, F.lit(0)))
    first = F.get(lines, s["start_line"] - 1).substr(s["start_col"], F.lit(2**31 - 1))
    last = F.get(lines, s["end_line"] - 1).substr(F.lit(1), s["end_col"] - 1)
    return F.when(s["start_line"] == s["end_line"], one).otherwise(F.array_join(F.concat(F.array(first), between, F.array(last)), "\n"))


def complexity_a(c) -> Column:
    """dialog, abbreviation, complex or normal: the first that a sentence shows, by the wide patterns."""
    return (
        F.when(F.col(c).rlike(r"(?iU)\"[^\"]*\"|'[^']*'|\b(?:answered|asked|exclaimed|replied|said|shouted|whispered)\b|^\s*\"|--"), "dialog")
        .when(F.col(c).rlike(r"(?U)\b(?:Ave|Dr|Mr|Mrs|Prof|Rd|St|e\.g|etc|i\.e|vs)\.|\b[A-Z]\.|\b\w+\.\w+\."), "abbreviation")
        .when(F.col(c).rlike(r"(?U)[;:]|\([^)]*\)|--|\b(?:furthermore|however|moreover|nevertheless|therefore)\b"), "complex")
        .otherwise("normal")
    )


def complexity_b(c) -> Column:
    """The same by the narrow patterns, in which any quote makes dialog."""
    return (
        F.when(F.col(c).rlike(r"(?iU)[\"']|\b(?:asked|replied|said)\b"), "dialog")
        .when(F.col(c).rlike(r"(?U)\b(?:Dr|Mr|Mrs|e\.g|etc|i\.e|vs)\.|[A-Z]\."), "abbreviation")
        .when(F.col(c).rlike(r"(?i)[;:()-]|however|therefore"), "complex")
        .otherwise("normal")
    )


INDICATORS = (
    ("double_quotes", '"'),
    ("single_quotes", r"'\w"),
    ("parenthetical", r"(?s)\(.*\)|\).*\("),
    ("dialog_attribution", r"(?i)\"\s*[,;]\s*\w+\s+(asked|replied|said|shouted)"),
    ("hard_separator", r"\n\n"),
    ("abbreviations", r"\b[A-Z]\.\s*[A-Z]\."),
    ("complex_punctuation", r"\.\.\.|—|–"),
    ("quote_parenthetical", r"\"\s*\([^)]*\)"),
)


def indicators(c) -> Column:
    """Which of the eight signs of difficulty a text shows, in their order."""
    return F.filter(F.array(*[F.when(F.col(c).rlike("(?U)" + p), F.lit(n)) for n, p in INDICATORS]), lambda x: x.isNotNull())


def words(text) -> Column:
    return F.split(F.lower(text), r"\s+")


def long_words(text) -> Column:
    """A text's distinct words of more than four letters."""
    return F.array_distinct(F.filter(words(text), lambda w: F.length(w) > 4))


def words_shared(long, there) -> Column:
    """Share of words in an array that another has."""
    return F.when(F.size(long) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(long, there)) / F.size(long))


def word_overlap(words_of, text) -> Column:
    """Share of a sentence's distinct words of more than four letters that occur in a text."""
    return words_shared(long_words(words_of), words(text))

