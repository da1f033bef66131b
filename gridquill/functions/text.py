"""Text as Column expressions: names, months, citations, numbers, sections and chunks of documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Forms of citations, numbers, months and names of monthly layers.
CITATION = r"\[([\d\s,–\-]+)\]"
NUMBER = r"\d+(?:\.\d+)?"
#: White space, as patterns have it.
WHITE = " \t\n\x0b\f\r"
#: Numbers that a citation range adds to its first one, at most; citation numbers lie below the limit.
RANGE_SPAN, CITATION_LIMIT = 50, 1000
MONTHLY = r"^Global_Synthesis_(\d{4})(\d{2})$"
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def blank_to_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def slug(text: Column, joint: str = "-", fallback: str = "_") -> Column:
    """Lower case, every other run of characters a joint, none at the ends."""
    plain = F.regexp_replace(F.lower(text), "[^a-z0-9]+", joint)
    return F.coalesce(F.nullif(F.regexp_replace(plain, f"^[{joint}]+|[{joint}]+$", ""), F.lit("")), F.lit(fallback))


def content_id(text: Column, size: int = 16) -> Column:
    """The first hex digits of SHA-1."""
    return F.substring(F.sha1(F.encode(text, "UTF-8")), 1, size)


def canonical_name(name: Column) -> Column:
    """What stands before the first comma."""
    return F.substring_index(name, ",", 1)


def share_file_id(url: Column) -> Column:
    """The file id of a share link: after /d/ or in an id parameter; null without one."""
    after = lambda p: F.nullif(F.regexp_extract(url, p, 1), F.lit(""))
    return F.coalesce(after(r"/d/([^/]+)"), after(r"[?&]id=([^&]+)"))


def full_match(text: Column, pattern: str) -> Column:
    return text.rlike(f"^(?:{pattern})$")


def month_key(text: Column) -> Column:
    """yyyy-MM of 2024-5, 2024-05 or 202405; null for anything else."""
    year = F.regexp_extract(text, r"^(\d{4})(?:-\d{1,2}|\d{2})$", 1)
    month = F.regexp_extract(text, r"^\d{4}-?(\d{1,2})$", 1)
    number = F.nullif(month, F.lit("")).cast("int")
    return F.when((year != "") & number.between(1, 12), F.concat(year, F.lit("-"), F.lpad(number.cast("string"), 2, "0")))


def month_number(key: Column) -> Column:
    """Months since year 0 of a yyyy-MM key."""
    return F.substring(key, 1, 4).cast("int") * 12 + F.substring(key, 6, 2).cast("int")


def layer_month(name: Column) -> Column:
    """yyyy-MM of a monthly layer's name; null if it isn't one."""
    part = lambda i: F.regexp_extract(name, MONTHLY, i)
    return F.when(part(1) != "", F.concat_ws("-", part(1), part(2)))


def month_of_title(title: Column) -> Column:
    """Two digits of an English month's name, by its first three letters."""
    at = F.instr(F.lit("".join(MONTHS)), F.lower(F.substring(title, 1, 3)))
    return F.when((F.length(title) >= 3) & (at % 3 == 1), F.lpad((F.floor((at - 1) / 3) + 1).cast("string"), 2, "0"))


def cited_numbers(text: Column) -> Column:
    """Distinct citation numbers in order of their size: [3], [1, 2], [4-6]; a range that falls is nothing."""
    groups = F.regexp_extract_all(text, F.lit(CITATION), F.lit(1))
    parts = F.flatten(F.transform(groups, lambda g: F.split(F.trim(F.regexp_replace(g, "–", "-")), r"[,\s]+")))

    def expand(p: Column) -> Column:
        low, high = (F.regexp_extract(p, r"^(\d{1,9})-(\d{1,9})$", i) for i in (1, 2))
        first, last = (F.nullif(x, F.lit("")).cast("int") for x in (low, high))
        several = F.sequence(first, F.least(last, first + RANGE_SPAN))
        one = F.nullif(F.regexp_extract(p, r"^(\d{1,9})$", 1), F.lit("")).cast("int")
        none = F.array().cast("array<int>")
        return F.when((low != "") & (first <= last), several).when(one.isNotNull(), F.array(one)).otherwise(none)

    found = F.flatten(F.transform(parts, expand))
    return F.array_sort(F.array_distinct(F.filter(found, lambda n: n < CITATION_LIMIT)))


def without_citations(text: Column) -> Column:
    return F.regexp_replace(text, CITATION, "")


def number_tokens(text: Column) -> Column:
    """Distinct numbers as they are written, thousands commas taken out, sorted as strings."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.regexp_replace(text, ",", ""), F.lit(NUMBER), F.lit(0))))


def blocks(text: Column) -> Column:
    """Paragraphs between blank lines without their heading lines, empty ones dropped."""
    cut = F.split(text, "\n\n")
    bodies = F.transform(cut, lambda b: F.trim(F.array_join(F.filter(F.split(b, "\n"), lambda line: ~F.ltrim(line).startswith("#")), "\n")))
    return F.filter(bodies, lambda b: b != "")


def strip(text: Column) -> Column:
    """Without white space at either end, line ends included."""
    return F.trim(text, F.lit(WHITE))


def paragraphs(text: Column, separator: str = r"\n\s*\n") -> Column:
    return F.filter(F.transform(F.split(text, separator), strip), lambda p: p != "")


def pieces(paragraph: Column, target: int) -> Column:
    """A paragraph in pieces of at most target characters: cut behind the last ". " before target if that
    lies in its second half, else at target.  Every cut takes more than half of target, which bounds the steps."""
    steps = F.sequence(F.lit(1), F.greatest(F.ceil(F.length(paragraph) / F.lit(target / 2)).cast("int"), F.lit(1)))
    start = F.struct(paragraph.alias("rest"), F.array().cast("array<string>").alias("done"))
    done = lambda state: F.filter(F.concat(state["done"], F.array(state["rest"])), lambda p: p != "")

    def step(state: Column, _: Column) -> Column:
        rest = state["rest"]
        # How far from the head's end its last ". " begins, counted from 1; 0 without one.
        behind = F.instr(F.reverse(F.substring(rest, 1, target)), " .")
        at = named(behind, lambda n: F.when((n > 0) & (target - 1 - n > target // 2), target - n).otherwise(F.lit(target)))
        # The end of a paragraph has no white space left, so the rest needs a look at its beginning alone.
        cut = named(at, lambda n: F.struct(F.ltrim(F.substring(rest, n + 1, F.lit(2**31 - 1)), F.lit(WHITE)).alias("rest"), F.concat(state["done"], F.array(strip(F.substring(rest, F.lit(1), n)))).alias("done")))
        return F.when(F.length(rest) > target, cut).otherwise(state)

    short = F.filter(F.array(paragraph), lambda p: p != "")
    return F.when(F.length(paragraph) <= target, short).otherwise(F.aggregate(steps, start, step, done))


def named(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def chunks(text: Column, target: int = 1800, separator: str = r"\n\s*\n") -> Column:
    """Pieces of all paragraphs joined by a blank line, greedily, while a chunk stays within target.

    The fold adds up lengths and sees no text: it finds where chunks end, and each chunk's pieces are then joined once."""

    def packed(flat: Column) -> Column:
        start = F.struct(F.lit(0).alias("size"), F.lit(0).alias("n"), F.array().cast("array<int>").alias("ends"))

        def step(state: Column, size: Column) -> Column:
            fits = (state["n"] == 0) | (state["size"] + size + 2 <= target)
            more = F.struct((F.when(state["n"] == 0, F.lit(0)).otherwise(state["size"] + 2) + size).alias("size"), (state["n"] + 1).alias("n"), state["ends"].alias("ends"))
            fresh = F.struct(size.alias("size"), (state["n"] + 1).alias("n"), F.concat(state["ends"], F.array(state["n"])).alias("ends"))
            return F.when(fits, more).otherwise(fresh)

        ends = F.aggregate(F.transform(flat, F.length), start, step, lambda state: F.concat(F.array(F.lit(0)), state["ends"], F.array(state["n"])))
        joined = lambda e: F.transform(F.slice(e, 2, F.size(e)), lambda end, i: F.array_join(F.slice(flat, F.element_at(e, i + 1) + 1, end - F.element_at(e, i + 1)), "\n\n"))
        return F.when(F.size(flat) > 0, named(ends, joined)).otherwise(F.array().cast("array<string>"))

    return named(F.flatten(F.transform(paragraphs(text, separator), lambda p: pieces(p, target))), packed)
