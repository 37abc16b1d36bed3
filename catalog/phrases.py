"""Phrase-mining queries over ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from phrasegraph.functions import phrases as PF
from phrasegraph.functions.stopwords import DETERMINERS, stopword_list
from phrasegraph.operators import phrases as P
from phrasegraph.operators.tokens import term_counts, tokenize, vocabulary
from phrasegraph.plans.durable import durable, settled

from .base import query, table

STOP_SQL = "(" + ", ".join(f"'{w}'" for w in stopword_list()) + ")"
LEAD = "|".join(DETERMINERS)

SQL_TOKENS = r"""
tok as materialized (select doc_id, generate_subscripts(w, 1) as pos, unnest(w) as term
        from (select doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from documents))
"""

SQL_SPANS = rf"""
raw as (select doc_id, generate_subscripts(w, 1) as pos, unnest(w) as t
        from (select doc_id, regexp_extract_all(lower(text),
              '[\p{{L}}\p{{N}}]+(?:-[\p{{L}}\p{{N}}]+)*|[^\s\p{{L}}\p{{N}}]') as w from documents)),
flag as (select *, case when t in {STOP_SQL} or not regexp_matches(t, '^[\p{{L}}\p{{N}}]')
                        then 1 else 0 end as brk from raw),
isl as (select *, sum(brk) over (partition by doc_id order by pos) as g from flag),
spans as materialized (select doc_id, min(pos) as start, count(*) as length, string_agg(t, ' ' order by pos) as phrase
          from isl where brk = 0 group by doc_id, g having count(*) >= 2)
"""

SQL_NORMAL = rf"""
normal as (select doc_id, trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(phrase)),
             '^({LEAD})\s+', ''), '[^a-z0-9\- ]', '', 'g'), '\s+', ' ', 'g')) as phrase from spans),
pdc as materialized (select phrase, doc_id, count(*) as n from normal
        where len(regexp_extract_all(phrase, '[^\s-]+')) >= 2 group by 1, 2),
post as materialized (select *, count(*) over (partition by phrase) as doc_count from pdc
         qualify count(*) over (partition by phrase) >= 5)
"""


def sql_pass(tokens: str, tag: str) -> str:
    """One learning and merging pass over the token relation ``tokens``."""
    return f"""
bg{tag} as (select doc_id, pos, term as a, lead(term) over (partition by doc_id order by pos) as b from {tokens}),
un{tag} as materialized (select term, count(*) as n from {tokens} group by 1),
tt{tag} as (select sum(n)::double as total from un{tag}),
co{tag} as materialized (select a, b, n_ab, log2(n_ab * total / (x.n * y.n::double)) as pmi
            from (select a, b, count(*) as n_ab from bg{tag} where b is not null group by 1, 2 having count(*) >= 5)
            join un{tag} x on x.term = a join un{tag} y on y.term = b, tt{tag}
            where log2(n_ab * total / (x.n * y.n::double)) >= 2),
hit{tag} as materialized (select g.*, c.a is not null as hit, row_number() over (partition by doc_id order by pos) as k
             from bg{tag} g left join co{tag} c on g.a = c.a and g.b = c.b),
isl{tag} as (select *, k - row_number() over (partition by doc_id, hit order by pos) as isle from hit{tag}),
st{tag} as (select *, hit and row_number() over (partition by doc_id, hit, isle order by pos) % 2 = 1 as st from isl{tag}),
mt{tag} as materialized (select doc_id, pos, case when st then a || '_' || b else a end as term
            from (select *, lag(st, 1, false) over (partition by doc_id order by pos) as gone from st{tag})
            where not gone)
"""


SQL_TERMS = rf"""
ct as (select term, count(*) as n from mt2 where term like '%\_%' escape '\'
         and not regexp_matches(term, '^({LEAD})_') group by 1),
tw as (select term, n, string_split(replace(term, '_', ' '), ' ') as w from ct),
ti as (select term, n, w, list_filter(generate_series(1, len(w)), lambda i: w[i] not in {STOP_SQL}) as keep from tw),
tm as materialized (select array_to_string(w[list_min(keep):list_max(keep)], ' ') as phrase, sum(n) as n
       from ti where len(keep) > 0 group by 1 having contains(array_to_string(w[list_min(keep):list_max(keep)], ' '), ' '))
"""

SQL_MATCH = r"""
wd as (select doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from documents),
gram as (select doc_id, array_to_string(w[i:i + n - 1], ' ') as phrase
         from (select doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) as i
               from wd, (select distinct len(string_split(phrase, ' ')) from tm) t(n) where len(w) >= n)),
pm as (select phrase, doc_id, count(*) as n from gram where phrase in (select phrase from tm) group by 1, 2),
colloc as materialized (select *, count(*) over (partition by phrase) as doc_count from pm
           qualify count(*) over (partition by phrase) >= 5)
"""

SQL_NOUN = """
np as (select trim(regexp_replace(replace(phrase, '-', ' '), '\\s+', ' ', 'g')) as phrase, doc_id, sum(n)::bigint as n
       from post group by 1, 2),
noun as materialized (select *, count(*) over (partition by phrase) as doc_count from np
         qualify count(*) over (partition by phrase) >= 5)
""".replace("\\\\", "\\")

SQL_MERGE = f"""
mc as materialized (select coalesce(c.phrase, d.phrase) as phrase, coalesce(c.doc_count, d.doc_count) as doc_count,
              case when c.phrase is null then 'nounphrase' when d.phrase is null then 'collocation'
                   else 'collocation+nounphrase' end as source
       from (select distinct phrase, doc_count from colloc) c
       full join (select distinct phrase, doc_count from noun) d on c.phrase = d.phrase),
good as (select * from mc where phrase <> ''
         and not (contains(phrase, ' ') and split_part(phrase, ' ', 1) in {STOP_SQL})),
kw as materialized (select row_number() over (order by phrase)::varchar as kid, * from good),
kp as (select kid, doc_id, n from kw join colloc using (phrase) where source <> 'nounphrase'
       union all select kid, doc_id, n from kw join noun using (phrase) where source = 'nounphrase')
"""

SQL_MINED = ",".join(
    [SQL_TOKENS, SQL_SPANS, SQL_NORMAL, sql_pass("tok", "1"), sql_pass("mt1", "2"), SQL_TERMS, SQL_MATCH, SQL_NOUN, SQL_MERGE]
)


def docs_of(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "text")


def mined(spark, sf):
    """Phrase table and postings of ``documents``."""
    return P.mine_phrases(docs_of(spark, sf))


def merged_rows(spark, sf):
    return P.collocation_rows(P.word_rows(docs_of(spark, sf)))


def merged_terms(spark, sf):
    """Trimmed terms; the merged rows they are counted from are deleted."""
    return settled(spark, lambda: P.trimmed_terms(P.collocation_terms(merged_rows(spark, sf))))


@query("c01_tokenize", f"with {SQL_TOKENS} select doc_id, pos::bigint as pos, term from tok")
def tokens(spark, sf):
    return tokenize(docs_of(spark, sf)).withColumn("pos", F.col("pos").cast("long"))


@query(
    "c02_candidate_phrases",
    f"with {SQL_SPANS} select doc_id, start::bigint as start, length, phrase from spans",
)
def candidates(spark, sf):
    return P.candidate_phrases(docs_of(spark, sf)).select(
        "doc_id", F.col("start").cast("long").alias("start"), F.col("length").cast("long").alias("length"), "phrase"
    )


@query(
    "c03_repair_hyphen_spans",
    r"""with tok as (select doc_id, generate_subscripts(w, 1) as pos, unnest(w) as token from
               (select doc_id, regexp_extract_all(text, '[\p{L}\p{N}]+|[^\s\p{L}\p{N}]') as w
                from (select doc_id, replace(text, ' the ', ' the-') as text from documents))),
             nb as (select *, lag(token) over w as b, lead(token) over w as a, lag(token, 2) over w as bb
                    from tok window w as (partition by doc_id order by pos)),
             dash as (select * from nb where token = '-')
        select doc_id, pos::bigint as start, 2::bigint as length, coalesce(b, '') || '-' || a as phrase
        from dash where a is not null and a <> '-'
        union all
        select doc_id, pos::bigint - 1, 2::bigint, b || '-' || coalesce(a, '') from dash
        where b is not null and b <> '-'""",
)
def repaired_spans(spark, sf):
    docs = docs_of(spark, sf).withColumn("text", F.replace("text", F.lit(" the "), F.lit(" the-")))
    toks = P.marked_tokens(docs, by_document=True)
    out = P.repair_hyphen_spans(P.hyphen_spans(toks), toks)
    return out.withColumn("start", F.col("start").cast("long")).withColumn("length", F.col("length").cast("long"))


@query(
    "c04_normalize_phrase",
    rf"""with t as (select item_id, unnest(string_split(text, '.')) as p from benchmark),
              n as (select item_id, trim(regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace(p, '^\s+|\s+$', '', 'g')),
                    '^({LEAD})\s+', ''), '[^a-z0-9\- ]', '', 'g'), '\s+', ' ', 'g')) as phrase from t)
         select item_id, phrase, len(regexp_extract_all(phrase, '[^\s-]+'))::bigint as n_words from n
         where len(regexp_extract_all(phrase, '[^\s-]+')) >= 2""",
)
def normalized(spark, sf):
    parts = table(spark, sf, "benchmark").select("item_id", F.explode(F.split("text", r"\.")).alias("p"))
    normal = parts.select("item_id", PF.normalize_phrase(F.col("p")).alias("phrase"))
    return normal.withColumn("n_words", PF.phrase_words(F.col("phrase")).cast("long")).filter("n_words >= 2")


@query("c05_phrase_doc_counts", f"with {SQL_SPANS},{SQL_NORMAL} select phrase, doc_id, n from pdc")
def phrase_doc_counts(spark, sf):
    return P.phrase_doc_counts(P.candidate_phrases(docs_of(spark, sf)))


@query("c06_phrase_postings", f"with {SQL_SPANS},{SQL_NORMAL} select phrase, doc_id, n, doc_count from post")
def phrase_postings(spark, sf):
    return P.frequent_postings(durable(P.phrase_doc_counts(P.candidate_phrases(docs_of(spark, sf)))))


@query(
    "c07_vocabulary",
    f"with {SQL_TOKENS} select term, count(*) as term_count, count(distinct doc_id) as doc_count from tok group by 1",
)
def vocab(spark, sf):
    return vocabulary(term_counts(docs_of(spark, sf)))


@query(
    "c08_collocations",
    f"with {SQL_TOKENS},{sql_pass('tok', '1')} select a, b, n_ab, round(pmi, 6) as pmi from co1",
)
def colloc(spark, sf):
    return P.collocations(durable(P.word_rows(docs_of(spark, sf)))).withColumn("pmi", F.round("pmi", 6))


@query(
    "c09_merge_collocations",
    f"""with {SQL_TOKENS},{sql_pass('tok', '1')},{sql_pass('mt1', '2')}
        select doc_id, row_number() over (partition by doc_id order by pos) as pos, term from mt2""",
)
def merged_tokens(spark, sf):
    merged = merged_rows(spark, sf).select("doc_id", F.posexplode("words").alias("pos", "term"))
    return merged.withColumn("pos", F.col("pos").cast("long") + 1)


@query(
    "c10_collocation_terms",
    f"with {SQL_TOKENS},{sql_pass('tok', '1')},{sql_pass('mt1', '2')},{SQL_TERMS} select term, n from ct",
)
def colloc_terms(spark, sf):
    return settled(spark, lambda: P.collocation_terms(merged_rows(spark, sf)))


@query(
    "c11_trim_stopwords",
    rf"""with p as (select doc_id, unnest(string_split(lower(text), '.')) as t from documents),
              w as (select doc_id, string_split(trim(regexp_replace(t, '\s+', ' ', 'g')), ' ') as w from p),
              k as (select doc_id, w, list_filter(generate_series(1, len(w)), lambda i: w[i] not in {STOP_SQL}) as keep from w),
              o as (select doc_id, array_to_string(w[list_min(keep):list_max(keep)], ' ') as phrase from k where len(keep) > 0)
         select doc_id, phrase, count(*) as n from o where contains(phrase, ' ') group by 1, 2""",
)
def trimmed(spark, sf):
    parts = docs_of(spark, sf).select("doc_id", F.explode(F.split(F.lower("text"), r"\.")).alias("t"))
    phrase = PF.trim_stopwords(F.col("t"), stopword_list())
    return (
        parts.select("doc_id", phrase.alias("phrase"))
        .filter(F.contains("phrase", F.lit(" ")))
        .groupBy("doc_id", "phrase")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "c12_phrase_matches",
    f"""with {SQL_TOKENS},{sql_pass('tok', '1')},{sql_pass('mt1', '2')},{SQL_TERMS},{SQL_MATCH}
        select phrase, doc_id, n, doc_count from colloc""",
)
def matches(spark, sf):
    docs = docs_of(spark, sf)
    terms = merged_terms(spark, sf)
    return P.phrase_matches(terms, docs)


@query(
    "c12_substring_matches",
    f"""with {SQL_TOKENS},{sql_pass('tok', '1')},{sql_pass('mt1', '2')},{SQL_TERMS},
        tx as (select doc_id, array_to_string(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+'), ' ') as t from documents),
        ps as (select phrase, doc_id, ((length(t) - length(replace(t, phrase, ''))) / length(phrase))::bigint as n
               from tm join tx on contains(t, phrase))
        select phrase, doc_id, n, count(*) over (partition by phrase) as doc_count from ps
        qualify count(*) over (partition by phrase) >= 5""",
)
def substring_matches(spark, sf):
    terms = merged_terms(spark, sf)
    return P.substring_matches(terms, docs_of(spark, sf))


@query("c13_merge_candidates", f"with {SQL_MINED} select kid, phrase, doc_count, source from kw")
def merged_candidates(spark, sf):
    return mined(spark, sf)[0].select("kid", "phrase", "doc_count", "source")


@query(
    "c14_drop_bad_phrases",
    f"""with {SQL_SPANS} select phrase, count(*) as n from
        (select regexp_replace(phrase, '^[^ ]+ ', 'the ') as phrase from spans where start % 2 = 0
         union all select phrase from spans)
        where phrase <> '' and not (contains(phrase, ' ') and split_part(phrase, ' ', 1) in {STOP_SQL}) group by 1""",
)
def drop_bad(spark, sf):
    spans = durable(P.candidate_phrases(docs_of(spark, sf)))
    led = spans.filter("start % 2 = 0").select(F.regexp_replace("phrase", "^[^ ]+ ", "the ").alias("phrase"))
    return (
        P.drop_bad_phrases(led.unionByName(spans.select("phrase")))
        .groupBy("phrase")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "c15_assign_kid",
    f"with {SQL_TOKENS} select row_number() over (order by term)::varchar as kid, term as phrase from (select distinct term from tok)",
)
def assign_kid(spark, sf):
    words = vocabulary(term_counts(docs_of(spark, sf))).select(F.col("term").alias("phrase"))
    return P.assign_kid(words).select("kid", "phrase")


@query(
    "c16_candidate_table",
    f"""with {SQL_MINED} select kid, phrase, doc_count, source, false as omit, false as method, false as thematic,
               p.n_total, p.n_docs
        from kw join (select kid, sum(n)::bigint as n_total, count(*) as n_docs from kp group by 1) p using (kid)
        order by doc_count desc, phrase""",
)
def candidate_table(spark, sf):
    phrases, postings = mined(spark, sf)
    totals = postings.groupBy("kid").agg(F.sum("n").alias("n_total"), F.count(F.lit(1)).alias("n_docs"))
    return phrases.join(totals, "kid").orderBy(F.desc("doc_count"), "phrase")


@query(
    "c17_stopwords",
    f"with {SQL_TOKENS} select term, count(*) as n from tok where term in {STOP_SQL} group by 1",
)
def stopwords_used(spark, sf):
    words = spark.createDataFrame([(w,) for w in stopword_list()], "term string")
    counts = vocabulary(term_counts(docs_of(spark, sf))).select("term", F.col("term_count").alias("n"))
    return counts.join(F.broadcast(words), "term", "left_semi")
