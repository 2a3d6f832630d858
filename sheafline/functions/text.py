"""Text functions: numbers, tokens, guarded containment, HTML, ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"[ \t\n\x0B\f\r]+"
#: Minus and dash signs that count as '-' (fixed values): U+2212, U+2013.
DASHES = "−–"
#: How the foot of a table begins, and short names of item kinds (fixed values).
FOOTER = (
    r"^(Sources?\b|Notes?\b|NOTES?\b|Footnotes?\b|\*\s*(?:=|[A-Za-z])|†|‡|[a-z]\)|\([a-z0-9]{1,2}\)"
    r"|\d{1,2}/|\d{1,2}\s+[A-Z]|[A-Z]{1,2}\s?=|\(s\)\s?=|-\s?=|–\s?=|Components may not)"
)
#: Words after which a label goes on in the next line (fixed values).
CONNECTORS = "and or of for the to in on by with excluding including from at a an".split()
ITEM_KINDS = {"tables": "tbl", "texts": "txt", "pictures": "pic", "groups": "grp"}


def collapse(c: Column) -> Column:
    """Runs of white space become one space."""
    return F.regexp_replace(c, WS, " ")


def normalize_numeric(c: Column) -> Column:
    """Dashes directly before a digit become '-'."""
    return F.regexp_replace(c, f"[{DASHES}](?=[0-9])", "-")


def canon(c: Column) -> Column:
    """The canonical form of a printed number, null for anything else.

    Commas go, dashes become '-', trailing stars go, a replacement character
    between digits or in front is a decimal point, parentheses mean minus.
    """
    s = F.regexp_replace(F.replace(F.trim(c), F.lit(",")), f"[{DASHES}]", "-")
    s = F.regexp_replace(s, r"\*+$", "")
    s = F.regexp_replace(s, "(?<=[0-9])�(?=[0-9])", ".")
    s = F.regexp_replace(s, "^�", ".")
    s = F.regexp_replace(s, r"^\((.*)\)$", "-$1")
    s = F.when(s.rlike(r"^-?([0-9]+(\.[0-9]+)?|\.[0-9]+)$"), s)
    sign = F.when(F.startswith(s, F.lit("-")), "-").otherwise("")
    s = F.concat(sign, F.regexp_replace(F.regexp_replace(s, "^-", ""), r"^\.", "0."))
    return F.when(s == "-0", "0").otherwise(s)


def strip_flags(c: Column) -> Column:
    """A revision mark (R, E, RE) at either end of a number goes."""
    return F.regexp_replace(F.regexp_replace(c, r"^(RE|R|E) ?(?=[-(.0-9])", ""), r"(?<=[0-9).]) ?(RE|R|E)$", "")


def numbers_wide(c: Column) -> Column:
    """Digits with inner commas and one decimal part."""
    return F.regexp_extract_all(c, F.lit(r"[0-9][0-9,]*(?:\.[0-9]+)?"), F.lit(0))


def numbers_strict(c: Column) -> Column:
    """Digit groups joined by single commas or points."""
    return F.regexp_extract_all(c, F.lit(r"[0-9]+(?:[.,][0-9]+)*"), F.lit(0))


def occurs(text: Column, value: Column) -> Column:
    """Does value stand in text without being part of a longer number? An empty value never does."""
    quoted = F.regexp_replace(value, r"([\\.\[\]{}()*+?^$|])", r"\\$1")
    return F.regexp_like(text, F.concat(F.lit(r"(?<![0-9-])(?<![0-9][.,])"), quoted, F.lit(r"(?![0-9])(?![.,][0-9])"))) & (value != "")


def numeric_match(gold: Column, answer: Column) -> Column:
    """struct(hit, needed_minus): whether the gold number occurs, and whether only because dashes were read as minus signs.

    A sign is part of the number: '-5' is not in 'fell by 5'.
    """
    g, a = collapse(gold), collapse(answer)
    hit = occurs(normalize_numeric(a), normalize_numeric(g))
    return F.struct(hit.alias("hit"), (hit & ~occurs(a, g)).alias("needed_minus"))


def contained(phrase: Column, text: Column) -> Column:
    """Case-blind containment with white space collapsed and the number guard."""
    return occurs(F.lower(collapse(text)), F.lower(collapse(phrase)))


def strip_html(html: Column) -> Column:
    """Script and style bodies go, tags become line breaks, blank runs collapse."""
    s = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    s = F.regexp_replace(s, "<[^>]+>", "\n")
    return F.regexp_replace(F.regexp_replace(s, r"\s*\n\s*", "\n"), r"^[\n ]+|[\n ]+$", "")


def custom_id(*parts: str) -> Column:
    """The first 40 hex digits of the sha256 of the parts joined by '|'."""
    return F.substring(F.sha2(F.concat_ws("|", *[F.col(p).cast("string") for p in parts]), 256), 1, 40)


def title_words(c: Column) -> Column:
    """Distinct lower-case words of three letters or more, without parentheses' contents."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.regexp_replace(c, r"\([^)]*\)", " ")), F.lit("[a-z]{3,}"), F.lit(0)))


def overlap_share(a: Column, b: Column) -> Column:
    """Shared words over the smaller set; null if either is empty."""
    return F.try_divide(F.size(F.array_intersect(a, b)), F.least(F.size(a), F.size(b)))


def last_score(c: Column) -> Column:
    """The last <score>..</score> of a text, null without one."""
    return F.try_element_at(F.regexp_extract_all(c, F.lit("<score>([^<]*)</score>"), F.lit(1)), F.lit(-1))


def strip_fence(c: Column) -> Column:
    """A JSON text without its code fence."""
    return F.trim(F.regexp_replace(c, r"^\s*```(?:json)?\s*|\s*```\s*$", ""))


def unit_line(c: Column) -> Column:
    """Is a line one bracketed unit?"""
    return c.rlike(r"^\[[^\[\]]+\]$")


def item_key(c: Column) -> Column:
    """'#/tables/2' becomes 'tbl-2': the kind's short name and the number, its last two parts; a reference with one part is that part ('item' without any)."""
    parts = F.filter(F.split(c, "/"), lambda p: ~p.isin("", "#"))
    kind = F.try_element_at(parts, F.lit(-2))
    short = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in ITEM_KINDS.items() for x in pair]), kind), F.substring(kind, 1, 3))
    return F.when(F.size(parts) >= 2, F.concat_ws("-", short, F.element_at(parts, -1))).when(F.size(parts) == 1, F.regexp_replace(F.element_at(parts, 1), "^#+|#+$", "")).otherwise("item")


def fixed_decimals(c: Column) -> Column:
    """Replacement characters that stand for a decimal point, between digits or before the first one of a word, become points."""
    s = F.regexp_replace(c, "(?<=[0-9])�(?=[0-9])", ".")
    return F.regexp_replace(s, r"(^|\s)(-?)�(?=[0-9])", "$1$2.")


def flag_space(c: Column) -> Column:
    """A revision mark in front of its number gets a space: 'R1,358' becomes 'R 1,358'."""
    return F.regexp_replace(c, r"(?<![^ ])(RE|R|E)(?=[(-]?[.0-9][0-9,.]*\)?(?![^ ]))", "$1 ")


#: English months and their short forms, and Roman quarters (fixed values).
MONTHS = "january february march april may june july august september october november december".split()
MONTH_NUMBERS = {m: i for i, m in enumerate(MONTHS, 1)} | {m[:3]: i for i, m in enumerate(MONTHS, 1)} | {"sept": 9}
ROMAN = {"I": 1, "II": 2, "III": 3, "IV": 4}


def time_token(c: Column) -> Column:
    """struct(month, quarter, year) of a word: a month's name, a Roman quarter, a year 1900 to 2099; nulls for anything else."""
    pick = lambda table, key: F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)
    word = F.regexp_replace(c, "[.,:]+$", "")
    year = F.regexp_extract(word, r"(?<![0-9])((?:19|20)[0-9]{2})(?![0-9])", 1)
    return F.struct(pick(MONTH_NUMBERS, F.lower(word)).alias("month"), pick(ROMAN, word).alias("quarter"), F.when(year != "", year.cast("int")).alias("year"))


def without_marker(c: Column, marker: str) -> Column:
    """A text without its delete marker, trimmed; null if nothing is left."""
    s = F.trim(F.replace(c, F.lit(marker)))
    return F.when(s != "", s)


def fenced_json(c: Column, ddl: str) -> Column:
    """struct(value, error): a JSON object, in a code fence or not, under a schema; error is null, 'empty', 'not an object' or 'bad fields'."""
    body = strip_fence(c)
    bare = F.regexp_like(body, F.lit(r"(?s)^\{.*\}$")) & F.get_json_object(body, "$").isNotNull()
    value = F.from_json(body, ddl)
    fields = [f.split()[0] for f in ddl.split(",")]
    full = F.lit(True)
    for f in fields:
        full = full & value[f].isNotNull()
    error = F.when(F.coalesce(body, F.lit("")) == "", "empty").when(~bare, "not an object").when(~full, "bad fields")
    return F.struct(F.when(error.isNull(), value).alias("value"), error.alias("error"))


def at_least_share(n: Column, least: int, share: int) -> Column:
    """max(least, ceil(n / share)) in whole numbers."""
    return F.greatest(F.lit(least).cast("long"), F.floor((n + share - 1) / share).cast("long"))


def without_backspace(c: Column) -> Column:
    return F.replace(c, F.lit("\b"))


def broken_number(c: Column) -> Column:
    """Does a replacement character stand inside a number?"""
    return c.rlike(f"[{DASHES}0-9-]�[0-9]")


def rejoined(c: Column) -> Column:
    """'3 .349' becomes '3.349'."""
    return F.regexp_replace(c, r"(?<=[0-9]) (?=\.[0-9])", "")


def footer_line(c: Column) -> Column:
    """Does a line begin a table's foot: a source, a note, or a footnote mark?"""
    return c.rlike(FOOTER)


def continues(label: Column, following: Column) -> Column:
    """Is a line of text alone the first part of a wrapped label? It ends with an opening sign or a connector, or the next begins in lower case; never after ':'."""
    last = F.element_at(F.split(F.trim(label), " +"), -1)
    on = last.rlike("[,\\-(/–]$") | F.lower(last).isin(CONNECTORS) | F.coalesce(following.rlike(r"^\p{Ll}"), F.lit(False))
    return (F.trim(label) != "") & ~F.endswith(last, F.lit(":")) & on


def period(c: Column) -> Column:
    """struct(grain, year, sub) of a key A:YYYY, M:YYYY-MM or Q:YYYY-q; nulls for anything else."""
    ok = c.rlike(r"^(A:[0-9]{4}|M:[0-9]{4}-(0[1-9]|1[0-2])|Q:[0-9]{4}-[1-4])$")
    return F.struct(F.when(ok, F.substring(c, 1, 1)).alias("grain"), F.when(ok, F.substring(c, 3, 4).try_cast("int")).alias("year"), F.when(ok, F.substring(c, 8, 2).try_cast("int")).alias("sub"))
