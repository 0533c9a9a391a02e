"""Line-first quality rules.

Each line of a text (split at newlines) is judged alone, by the first rule that it fails:

1 blank        only white space; dropped, but not counted as lost text
2 navigation   two or more ``|``, ``»`` or ``>`` separators between spaces
3 symbols      runs of two or more of ``# $ % & * !`` on more than ``max_symbols`` of the words
4 stutter      more than ``max_stutter`` of the words repeat the word before them
5 boilerplate  cookie, script, copyright-bar and login phrases
6 punctuation  no sentence punctuation anywhere in the line

Failing lines go first; then a document is rejected if less than ``min_kept`` of the characters in
its non-blank lines is left, or nothing.

Defined cases: a null, empty or blank text has nothing left and is rejected; a repeated row gets
the same decision each time; other columns, nulls in them included, pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_KEPT, MAX_SYMBOLS, MAX_STUTTER = 0.5, 0.3, 0.3
RULES = ("navigation", "symbols", "stutter", "boilerplate", "punctuation")
NAV = r" [|»>]( |$)"
SYMBOL = r"[#$%&*!]{2,}"
BOILER = ("cookies", "enable javascript", "javascript is ", "terms of use", "terms of service", "privacy policy", "all rights reserved", "log in to", "sign in to", "subscribe to our", "click here", "lorem ipsum")
END = "[.!?…:;。！？]"
COLUMNS = "doc_id bigint, text string, n_lines int, n_kept int, kept_chars bigint, all_chars bigint"


def _code(line: str, words: str, low: str) -> str:
    return f"""CASE WHEN trim({line}) = '' THEN 1
        WHEN regexp_count({line}, r'{NAV}') >= 2 THEN 2
        WHEN regexp_count({line}, r'{SYMBOL}') > {MAX_SYMBOLS} * size({words}) THEN 3
        WHEN size({words}) >= 4 AND size(filter({words}, (w, i) -> w = get({words}, i - 1))) > {MAX_STUTTER} * size({words}) THEN 4
        WHEN {" OR ".join(f"contains({low}, '{p}')" for p in BOILER)} THEN 5
        WHEN NOT {line} rlike '{END}' THEN 6
        ELSE 0 END"""


def judged(docs: DataFrame) -> DataFrame:
    """``docs`` with ``__lines``: array of (line, code of the first rule failed or 0)."""
    # the inner transform splits each line into words once
    per_line = f"""transform(transform(split(text, '\\n'), l -> named_struct('line', l, 'words', split(l, ' '), 'low', lower(l))),
        x -> named_struct('line', x.line, 'code', {_code('x.line', 'x.words', 'x.low')}))"""
    return _once(docs, "__lines", per_line)


def _once(df: DataFrame, name: str, expr: str) -> DataFrame:
    """``df`` with a column that later filters and projections read and never compute again: no expression moves
    across a generator."""
    return df.selectExpr("*", f"inline(array(named_struct('{name}', {expr})))")


def clean_lines(docs: DataFrame, min_kept: float = MIN_KEPT) -> DataFrame:
    """Accepted documents, with the columns of ``docs``: ``text`` is what is left, ``n_chars`` its
    length where the table has that column."""
    kept = _measured(docs).where(f"kept_chars > 0 AND kept_chars >= {min_kept} * all_chars")
    return kept.select(*[F.expr("__text").alias(c) if c == "text" else F.expr("length(__text)").cast("bigint").alias(c) if c == "n_chars" else F.col(f"__row.`{c}`").alias(c) for c in docs.columns])


def _measured(docs: DataFrame) -> DataFrame:
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col("text").cast("string").alias("text"))
    kept = _once(judged(row), "__kept", "transform(filter(__lines, x -> x.code = 0), x -> x.line)")
    return kept.selectExpr(
        "__row", "__lines", "__kept", "array_join(__kept, '\\n') AS __text",
        "aggregate(__kept, 0L, (a, x) -> a + length(x)) AS kept_chars",
        "aggregate(__lines, 0L, (a, x) -> a + if(x.code = 1, 0, length(x.line))) AS all_chars",
    )


def report(docs: DataFrame, min_kept: float = MIN_KEPT) -> DataFrame:
    """A row per document: what each rule removed, what is left, and ``keep``."""
    counts = [f"CAST(size(filter(__lines, x -> x.code = {i})) AS int) AS n_{rule}" for i, rule in enumerate(RULES, 2)]
    return _measured(docs).selectExpr(
        "CAST(__row.doc_id AS bigint) AS doc_id", *counts, "CAST(size(__kept) AS int) AS n_kept",
        "kept_chars", "all_chars", f"coalesce(kept_chars > 0 AND kept_chars >= {min_kept} * all_chars, false) AS keep",
        "if(kept_chars > 0, __text, '') AS text",
    )


def _duck_code() -> str:
    words = "x.words"
    return f"""CASE WHEN trim(x.line, ' ') = '' THEN 1
        WHEN len(regexp_extract_all(x.line, '{NAV}')) >= 2 THEN 2
        WHEN len(regexp_extract_all(x.line, '{SYMBOL}')) > {MAX_SYMBOLS} * len({words}) THEN 3
        WHEN len({words}) >= 4 AND len(list_filter({words}, lambda w, i: i > 1 AND w = {words}[i - 1])) > {MAX_STUTTER} * len({words}) THEN 4
        WHEN {" OR ".join(f"contains(lower(x.line), '{p}')" for p in BOILER)} THEN 5
        WHEN NOT regexp_matches(x.line, '{END}') THEN 6
        ELSE 0 END"""


ORACLE = f"""WITH judged AS (SELECT doc_id, list_transform(list_transform(string_split(text, chr(10)), lambda l: {{'line': l, 'words': string_split(l, ' ')}}), lambda x: {{'line': x.line, 'code': {_duck_code()}}}) AS lines FROM documents),
measured AS (SELECT doc_id, lines, list_filter(lines, lambda x: x.code = 0) AS kept,
  coalesce(list_sum(list_transform(list_filter(lines, lambda x: x.code = 0), lambda x: length(x.line))), 0)::BIGINT AS kept_chars,
  coalesce(list_sum(list_transform(list_filter(lines, lambda x: x.code <> 1), lambda x: length(x.line))), 0)::BIGINT AS all_chars FROM judged)
SELECT doc_id::BIGINT AS doc_id, {", ".join(f"len(list_filter(lines, lambda x: x.code = {i}))::INT AS n_{r}" for i, r in enumerate(RULES, 2))},
  len(kept)::INT AS n_kept, kept_chars, all_chars, kept_chars > 0 AND kept_chars >= {MIN_KEPT} * all_chars AS keep,
  coalesce(array_to_string(list_transform(kept, lambda x: x.line), chr(10)), '') AS text FROM measured"""
