"""Text functions over cells set from the order lines, each against its DuckDB counterpart (which has no look-around)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as fx
from ..operators import layout
from .registry import query, table

#: The printed quantity and a number from 0 to 4 that picks a form.
CELLS = "(SELECT l_orderkey, l_linenumber, CAST(l_quantity::BIGINT AS VARCHAR) AS q, (l_orderkey + l_linenumber) % 5 AS k FROM lineitem)"
KEYS = ["l_orderkey", "l_linenumber"]
GUARD = ("(^|[^0-9.,-]|(^|[^0-9])[.,])", "($|[^0-9.,]|[.,]($|[^0-9]))")


def _cells(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(*KEYS, F.col("l_quantity").cast("long").cast("string").alias("q"), ((F.col("l_orderkey") + F.col("l_linenumber")) % 5).alias("k"))


def _form(*forms: str) -> Column:
    """The form of a row's k, with {} for its quantity; the last one for all higher k."""
    out = None
    for k, f in enumerate(forms):
        made = F.replace(F.lit(f), F.lit("{}"), F.col("q"))
        out = F.when(F.col("k") == k, made) if out is None else (out.when(F.col("k") == k, made) if k < len(forms) - 1 else out.otherwise(made))
    return out


def _sql_form(*forms: str) -> str:
    made = [f"replace('{f}', '{{}}', q)" for f in (x.replace("'", "''") for x in forms)]
    made = [m.replace("\n", "' || chr(10) || '").replace("\b", "' || chr(8) || '") for m in made]
    return "CASE k " + " ".join(f"WHEN {i} THEN {m}" for i, m in enumerate(made[:-1])) + f" ELSE {made[-1]} END"


def _text_query(name: str, forms: tuple[str, ...], made: Callable[[Column], dict[str, Column]], sql: dict[str, str]) -> None:
    """Registers a query of functions of a text column t."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        return _cells(spark, sf).withColumn("t", _form(*forms)).select(*KEYS, *[c.alias(k) for k, c in made(F.col("t")).items()])

    run.__doc__ = f"Forms of a cell: {' / '.join(map(repr, forms))}."
    query(name, f"SELECT l_orderkey, l_linenumber, {', '.join(f'{c} AS {k}' for k, c in sql.items())} FROM (SELECT *, {_sql_form(*forms)} AS t FROM {CELLS})")(run)


_text_query(
    "revision_flags", ("R {}", "{} RE", "E({})", "RENT {}", "R{},358"),
    lambda t: {"bare": fx.strip_flags(t), "spaced": fx.flag_space(t)},
    {
        "bare": r"regexp_replace(regexp_replace(t, '^(RE|R|E) ?([-(.0-9])', '\2'), '([0-9).]) ?(RE|R|E)$', '\1')",
        "spaced": r"CASE k WHEN 2 THEN 'E (' || q || ')' WHEN 4 THEN 'R ' || q || ',358' ELSE t END",
    },
)
_text_query(
    "numeric_normal", ("−{}  to –{}", "a – {}", "\t-{}\n", "({})", "{}–{}"),
    lambda t: {"collapsed": fx.collapse(t), "normal": fx.normalize_numeric(fx.collapse(t))},
    {"collapsed": "regexp_replace(t, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')", "normal": "regexp_replace(regexp_replace(t, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), '[−–]([0-9])', '-\\1', 'g')"},
)
_text_query(
    "item_keys", ("#/tables/{}", "#/texts/{}", "#/pictures/{}", "#/keys/{}", "#/body"),
    lambda t: {"item": fx.item_key(t)},
    {"item": "CASE k WHEN 0 THEN 'tbl-' || q WHEN 1 THEN 'txt-' || q WHEN 2 THEN 'pic-' || q WHEN 3 THEN 'key-' || q ELSE 'body' END"},
)
_text_query(
    "backspace_sizes", ("a\b{}", "\b\b{}", "{}", "\b", "x {}"),
    lambda t: {"size": F.length(fx.without_backspace(t)).cast("long"), "gone": (F.length(t) - F.length(fx.without_backspace(t))).cast("long")},
    {"size": "length(replace(t, chr(8), ''))", "gone": "length(t) - length(replace(t, chr(8), ''))"},
)
_text_query(
    "broken_numbers", ("{}�5", "-�{}", "� {}", "about �{}", "{}�"),
    lambda t: {"broken": fx.broken_number(t), "fixed": fx.fixed_decimals(t)},
    {"broken": "regexp_matches(t, '[−–0-9-]�[0-9]')", "fixed": "CASE k WHEN 0 THEN q || '.5' WHEN 1 THEN '-.' || q WHEN 3 THEN 'about .' || q ELSE t END"},
)
_text_query(
    "line_kinds", ("[{} million dollars]", "|---|:-: |", "Source: table {}.", "{}/ Revised", "[a] [b]"),
    lambda t: {"unit": fx.unit_line(t), "separator": layout.is_separator(t), "foot": fx.footer_line(t)},
    {
        "unit": r"regexp_matches(t, '^\[[^\[\]]+\]$')", "separator": r"regexp_matches(t, '^\|(\s*:?-+:?\s*\|)+\s*$')",
        "foot": r"regexp_matches(t, '^(Sources?\b|Notes?\b|NOTES?\b|Footnotes?\b|\*\s*(?:=|[A-Za-z])|†|‡|[a-z]\)|\([a-z0-9]{1,2}\)|\d{1,2}/|\d{1,2}\s+[A-Z]|[A-Z]{1,2}\s?=|\(s\)\s?=|-\s?=|–\s?=|Components may not)')",
    },
)
_text_query(
    "rejoined_numbers", ("{} .349", "{} ,459", "{} .x", "a .5", "{} {}"),
    lambda t: {"joined": fx.rejoined(t)},
    {"joined": r"regexp_replace(t, '([0-9]) (\.[0-9])', '\1\2')"},
)
_text_query(
    "json_fences", ('```json\n{"a": {}}\n```', '{"a": {}}', '{"b": {}}', "[{}]", ""),
    lambda t: {"a": fx.fenced_json(t, "a long")["value"]["a"], "error": fx.fenced_json(t, "a long")["error"]},
    {"a": "CASE WHEN k IN (0, 1) THEN q::BIGINT END", "error": "CASE k WHEN 2 THEN 'bad fields' WHEN 3 THEN 'not an object' WHEN 4 THEN 'empty' END"},
)
_text_query(
    "last_scores", ("<score>no</score> then <score>{}</score>", "<score>{}</score> end", "score {}", "<score></score>", "<score>{}"),
    lambda t: {"score": fx.last_score(t)},
    {"score": "list_last(regexp_extract_all(t, '<score>([^<]*)</score>', 1))"},
)
_text_query(
    "period_keys", ("A:2020", "M:2020-12", "Q:2021-4", "M:2020-13", "Q:{}"),
    lambda t: {"grain": fx.period(t)["grain"], "year": fx.period(t)["year"], "sub": fx.period(t)["sub"]},
    {"grain": "CASE WHEN k < 3 THEN t[1] END", "year": "CASE WHEN k < 3 THEN CAST(substr(t, 3, 4) AS INTEGER) END", "sub": "CASE WHEN k IN (1, 2) THEN CAST(substr(t, 8) AS INTEGER) END"},
)
_text_query(
    "time_tokens", ("Sept.", "march", "IV", "FY2019", "{}"),
    lambda t: {"month": fx.time_token(t)["month"], "quarter": fx.time_token(t)["quarter"], "year": fx.time_token(t)["year"]},
    {"month": "CASE k WHEN 0 THEN 9 WHEN 1 THEN 3 END", "quarter": "CASE k WHEN 2 THEN 4 END", "year": "CASE k WHEN 3 THEN 2019 END"},
)
_text_query(
    "delete_markers", ("[deleted] {}", "{}", "[deleted]", " [deleted] [deleted] ", "{} and [deleted]"),
    lambda t: {"content": fx.without_marker(t, "[deleted]"), "n_words": F.coalesce(F.size(F.split(fx.without_marker(t, "[deleted]"), " +")), F.lit(0)).cast("long")},
    {"content": "nullif(trim(replace(t, '[deleted]', ''), ' '), '')", "n_words": "CASE WHEN trim(replace(t, '[deleted]', ''), ' ') = '' THEN 0 ELSE len(regexp_split_to_array(trim(replace(t, '[deleted]', ''), ' '), ' +')) END"},
)
_text_query(
    "label_continuations", ("Total of", "Exports,", "Imports:", "Gross domestic", "of which {}"),
    lambda t: {"lower": fx.continues(t, F.lit("petroleum")), "upper": fx.continues(t, F.lit("Petroleum"))},
    {"lower": "k <> 2", "upper": "k IN (0, 1)"},
)


@query(
    "numeric_match",
    rf"""WITH r AS (SELECT l_orderkey, l_linenumber, {_sql_form("−{}", "-{}", "{}", "{}", "{},1")} AS gold, {_sql_form("was  -{}", "fell by {} percent", "was {}.5", "was  {}.", "it is {},1.")} AS answer FROM {CELLS}),
n AS (SELECT *, regexp_replace(gold, '[ \t]+', ' ', 'g') AS g, regexp_replace(answer, '[ \t]+', ' ', 'g') AS a FROM r), m AS (SELECT *, regexp_replace(g, '[−–]([0-9])', '-\1', 'g') AS gn, regexp_replace(a, '[−–]([0-9])', '-\1', 'g') AS an FROM n),
h AS (SELECT *, regexp_matches(an, '{GUARD[0]}' || regexp_escape(gn) || '{GUARD[1]}') AS hit, regexp_matches(a, '{GUARD[0]}' || regexp_escape(g) || '{GUARD[1]}') AS plain FROM m) SELECT l_orderkey, l_linenumber, hit, hit AND NOT plain AS needed_minus FROM h""",
)
def numeric_match(spark: SparkSession, sf: str) -> DataFrame:
    m = fx.numeric_match(_form("−{}", "-{}", "{}", "{}", "{},1"), _form("was  -{}", "fell by {} percent", "was {}.5", "was  {}.", "it is {},1."))
    return _cells(spark, sf).select(*KEYS, m["hit"].alias("hit"), m["needed_minus"].alias("needed_minus"))


@query("phrase_contained", rf"SELECT doc_id, regexp_matches(lower(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g')), '{GUARD[0]}creative commons{GUARD[1]}') AS licensed, regexp_matches(lower(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g')), '{GUARD[0]}version 3{GUARD[1]}') AS version_3 FROM documents")
def phrase_contained(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", fx.contained(F.lit("Creative  Commons"), F.col("text")).alias("licensed"), fx.contained(F.lit("version 3"), F.col("text")).alias("version_3"))


@query("share_thresholds", "SELECT l_orderkey, count(*) AS n, greatest(2, CAST(ceil(count(*) / 3.0) AS BIGINT)) AS least FROM lineitem GROUP BY 1")
def share_thresholds(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n")).withColumn("least", fx.at_least_share(F.col("n"), 2, 3))
