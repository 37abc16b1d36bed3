"""Text-cleaning queries over ``documents``, ``benchmark``, ``labels`` and ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from phrasegraph.functions import text as T
from phrasegraph.operators.cleaning import clean_documents

from .base import query, table

PATTERNS = [r"Released under the MIT License\.", r"This work is licensed under [^\n]*\."]

_WS = r"[\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def sql_squish(x: str) -> str:
    return f"trim(regexp_replace({x}, '{_WS}+', ' ', 'g'))"


def sql_strip(x: str) -> str:
    for p in PATTERNS:
        x = f"regexp_replace({x}, '{p}', ' ')"
    return x


def sql_newlines(x: str) -> str:
    return rf"regexp_replace({x}, '[\r\n]+', ' ', 'g')"


def sql_line_hyphens(x: str) -> str:
    return rf"regexp_replace({x}, '(\p{{L}})-{_WS}*\r?\n{_WS}*(\p{{L}})', '\1\2', 'g')"


def sql_gap_hyphens(x: str) -> str:
    return rf"regexp_replace({x}, '(\p{{L}})-{_WS}{{2,}}(\p{{L}})', '\1\2', 'g')"


def sql_parens(x: str) -> str:
    return f"replace(replace({x}, '(', ' ( '), ')', ' ) ')"


def sql_ascii(x: str) -> str:
    x = f"strip_accents({x})"
    for mark, form in {**T.ASCII_FORMS, **T.ASCII_CHARS}.items():
        x = f"replace({x}, '{mark}', '{form.replace(chr(39), chr(39) * 2)}')"
    return rf"regexp_replace({x}, '[^\x00-\x7F]', '', 'g')"


def sql_clean(x: str) -> str:
    x = f"replace({sql_strip(x)}, chr(173), '')"
    x = sql_squish(sql_newlines(sql_gap_hyphens(sql_line_hyphens(x))))
    return sql_squish(sql_ascii(sql_newlines(sql_parens(x))))


def _text_query(name, expr, sql):
    """Register one expression over the whole text of every document."""
    query(name, f"select doc_id, {sql} as text_out from documents")(
        lambda spark, sf: table(spark, sf, "documents").select("doc_id", expr(F.col("text")).alias("text_out"))
    )


_text_query("b01_strip_boilerplate", lambda c: T.strip_boilerplate(c, PATTERNS), sql_strip("text"))
_text_query(
    "b02_drop_soft_hyphens",
    lambda c: T.drop_soft_hyphens(F.replace(c, F.lit("ti"), F.lit("t­i"))),
    "replace(replace(text, 'ti', 't' || chr(173) || 'i'), chr(173), '')",
)
_text_query(
    "b03_join_line_hyphens",
    lambda c: T.join_line_hyphens(F.regexp_replace(c, "tion", "ti-\n on")),
    sql_line_hyphens("replace(text, 'tion', 'ti-' || chr(10) || ' on')"),
)
_text_query(
    "b04_join_gap_hyphens",
    lambda c: T.join_gap_hyphens(F.regexp_replace(c, "ment", "me-   nt")),
    sql_gap_hyphens("replace(text, 'ment', 'me-   nt')"),
)
_text_query("b05_flatten_newlines", T.flatten_newlines, sql_newlines("text"))
_text_query(
    "b06_squish",
    lambda c: T.squish(F.translate(c, ",", " ")),
    sql_squish("replace(text, ',', chr(160))"),
)
_text_query("b07_pad_parentheses", T.pad_parentheses, sql_parens("text"))
_text_query("b08_fold_to_ascii", T.fold_to_ascii, sql_ascii("text"))
@query("b09_clean_text", f"select doc_id, {sql_clean('text')} as text_out from documents where text is not null")
def clean(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return clean_documents(docs, patterns=PATTERNS).select("doc_id", F.col("text_clean").alias("text_out"))


@query(
    "b10_truncate",
    """select lang, count(*) as n_docs, sum(case when length(text) > 2000 then 1 else 0 end)::bigint as n_cut,
              round(100.0 * sum(case when length(text) > 2000 then 1 else 0 end) / count(*), 6) as pct_cut,
              sum(length(substring(text, 1, 2000)))::bigint as chars_left
       from documents group by lang""",
)
def truncate(spark, sf):
    docs = table(spark, sf, "documents")
    n_cut = F.count_if(F.length("text") > 2000)
    return docs.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n_docs"),
        n_cut.alias("n_cut"),
        F.round(100.0 * n_cut / F.count(F.lit(1)), 6).alias("pct_cut"),
        F.sum(F.length(T.truncate(F.col("text"), 2000))).alias("chars_left"),
    )


@query(
    "b11_text_lengths",
    r"""select doc_id, length(text)::bigint as n_chars_out,
               len(regexp_extract_all(text, '\S+'))::bigint as n_words from documents""",
)
def text_lengths(spark, sf):
    col = F.col("text")
    return table(spark, sf, "documents").select(
        "doc_id",
        T.char_count(col).cast("long").alias("n_chars_out"),
        T.word_count(col).cast("long").alias("n_words"),
    )


@query(
    "b12_norm_rater",
    """select event_id, upper(trim(coalesce(case when event_id % 7 = 0 then null
              else chr(9) || ' ' || event_type || ' ' || chr(10) end, ''), ' ' || chr(9) || chr(10) || chr(13))) as rater from events""",
)
def norm_rater(spark, sf):
    raw = F.when(F.col("event_id") % 7 != 0, F.concat(F.lit("\t "), F.col("event_type"), F.lit(" \n")))
    return table(spark, sf, "events").select("event_id", T.norm_rater(raw).alias("rater"))


@query(
    "b13_blank_if_null",
    """select d.doc_id, coalesce(l.quality::varchar, '') as quality_text
       from documents d left join labels l using (doc_id)""",
)
def blank_if_null(spark, sf):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    return docs.join(labels, "doc_id", "left").select(
        "doc_id", T.blank_if_null(F.col("quality")).alias("quality_text")
    )


@query(
    "b14_highlight",
    r"""with w as (select doc_id, text, split_part(trim(text), ' ', 1) as phrase from documents),
             q as (select *, regexp_replace(phrase, '([^A-Za-z0-9_ \x{80}-\x{10FFFF}])', '\\\1', 'g') as pat from w)
        select doc_id, phrase, case when phrase is null or phrase = '' then text
               else regexp_replace(text, '(?i)(' || pat || ')', '<mark>\1</mark>', 'g') end as marked from q""",
)
def highlight(spark, sf):
    phrase = F.split_part(F.trim("text"), F.lit(" "), F.lit(1))
    docs = table(spark, sf, "documents").select("doc_id", "text", phrase.alias("phrase"))
    return docs.select("doc_id", "phrase", T.highlight(F.col("text"), F.col("phrase")).alias("marked"))


@query(
    "b15_spaces_for_hyphens",
    "select page_id, replace(html, '-', ' ') as html_out from pages",
)
def spaces_for_hyphens(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.spaces_for_hyphens(F.col("html")).alias("html_out"))
