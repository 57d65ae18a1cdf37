"""Registered queries: BM25 multi-field search, fuzzy expansion, regex fallback."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import tokens
from ..operators import regex_index as RX
from ..operators import search as S
from ..sources import tables as T
from .catalog import register

TOK = r"regexp_extract_all(lower({c}), '[\p{{L}}\p{{N}}]+')"
AUTO = "case when length({q}) <= 2 then 0 when length({q}) <= 5 then 1 else 2 end"


# one byte for each letter outside ASCII that the tables hold: DuckDB's levenshtein counts bytes
ONE_BYTE = "translate({c}, 'äóçßéñèíüêö', '!\"#$%&()*+,')"
DIST = f"levenshtein({ONE_BYTE.format(c='q.qterm')}, {ONE_BYTE.format(c='v.term')})"


def _search_sql(fuzzy: bool, fields) -> str:
    exp = (f"""exp as (select q.qterm, v.term, {DIST} as dist
                      from (select distinct qterm from qt) q, (select distinct term from tdf) v
                      where abs(length(q.qterm) - length(v.term)) <= 2 and {DIST} <= {AUTO.format(q='q.qterm')})"""
           if fuzzy else
           "exp as (select distinct q.qterm, q.qterm as term, 0 as dist from qt q join tdf v on v.term = q.qterm)")
    text = [(f, b) for f, b, kind in fields if kind == "text"]
    tok = " union all ".join(f"select '{f}' as field, {b} as boost, item_id, {TOK.format(c=f)} as t from v_described" for f, b in text)
    kw_union = "".join(f""" union all
                       select q.query, d.item_id, ln(1.0 + (s.n - c.df + 0.5) / (c.df + 0.5)) * {boost} as score
                       from v_text_queries q join v_described d on d.{f} = q.query
                       join (select {f}, count(*) as df from v_described where {f} is not null group by {f}) c on c.{f} = q.query,
                       (select count(*) as n from v_described where {f} is not null) s""" for f, boost, kind in fields if kind == "keyword")
    return f"""
    with td as (select * from ({tok}) where len(t) > 0),
    tstats as (select field, count(*) as n, avg(len(t)) as avgdl from td group by field),
    ttf as (select field, boost, item_id, dl, term, count(*) as tf from (select field, boost, item_id, len(t) as dl, unnest(t) as term from td)
            group by all),
    tdf as (select field, term, count(*) as df from ttf group by field, term),
    qt as (select query, unnest(tk) as qterm, unnest(generate_series(1, len(tk))) as pos
           from (select query, {TOK.format(c='query')} as tk from v_text_queries)),
    {exp},
    pt as (select e.qterm, f.field, f.boost, f.item_id,
                  max((1.0 - e.dist / least(length(e.qterm), length(e.term)))
                      * ln(1.0 + (s.n - d.df + 0.5) / (d.df + 0.5))
                      * (f.tf * 2.2 / (f.tf + 1.2 * (1 - 0.75 + 0.75 * f.dl / s.avgdl)))) as s
           from exp e join ttf f on f.term = e.term join tdf d on d.term = f.term and d.field = f.field
           join tstats s on s.field = f.field
           group by all),
    allp as (select qt.query, pt.item_id, sum(pt.s) * pt.boost as score
             from qt join pt on pt.qterm = qt.qterm group by qt.query, pt.item_id, pt.field, pt.boost{kw_union}),
    best as (select query, item_id, max(score) as score from allp group by query, item_id
             having max(score) > 0)
    select query, rank, item_id, score from
      (select *, row_number() over (partition by query order by round(score, 9) desc, item_id) as rank
       from best)
    where rank <= 10"""


@register("search_and_recommend", "T1,T3,T5,L8", _search_sql(True, S.SEARCH_AND_RECOMMEND_FIELDS))
def q_search_and_recommend(spark, d):
    return S.search(T.described_products(spark, d), T.text_search_queries(spark, d), 10, S.SEARCH_AND_RECOMMEND_FIELDS, fuzzy=True)


@register("search_products", "T2,T5,L8", _search_sql(False, S.SEARCH_PRODUCTS_FIELDS))
def q_search_products(spark, d):
    return S.search(T.described_products(spark, d), T.text_search_queries(spark, d), 10, S.SEARCH_PRODUCTS_FIELDS, fuzzy=False)


@register("fuzzy_term_expansions", "T3,T5", f"""
    with td as (select distinct unnest({TOK.format(c='p_name')}) as term from part where p_name is not null),
         qt as (select distinct unnest({TOK.format(c='query')}) as qterm from v_search_queries)
    select q.qterm, v.term, levenshtein(q.qterm, v.term) as dist from qt q, td v
    where levenshtein(q.qterm, v.term) <= {AUTO.format(q='q.qterm')}""")
def q_fuzzy_terms(spark, d):
    vocab = (T.read(spark, d, "part").select(F.explode(tokens("p_name")).alias("term")).distinct())
    qt = T.search_queries(spark, d).select(F.explode(tokens("query")).alias("qterm"))
    return S.fuzzy_expansions(qt, vocab, True).select("qterm", "term", F.col("dist").cast("bigint").alias("dist"))


PATTERNS = """
    with q as (select query from v_text_queries union
               select split_part(p_type, ' ', 1) || '.*' || split_part(p_type, ' ', -1) from part where p_type is not null union select '^red|BLUE$' union select '(')"""


def _patterns(spark, d):
    """The search queries, a pattern with a gap for every category, one that requires no literal, and one that is none."""
    kind = F.split("p_type", " ")
    gaps = T.read(spark, d, "part").filter("p_type is not null").select(F.concat(kind[0], F.lit(".*"), F.element_at(kind, -1)).alias("query"))
    return T.text_search_queries(spark, d).union(gaps.distinct()).union(spark.createDataFrame([("^red|BLUE$",), ("(",)], "query string"))


@register("regex_search", "T4,P10", f"""{PATTERNS}
    select query, rank, item_id, cast(1.0 as double) as score from
      (select q.query, d.item_id, row_number() over (partition by q.query order by d.item_id) as rank
       from q join v_described_lists d on regexp_matches(coalesce(d.title, ''), q.query, 'i') or regexp_matches(coalesce(d.description, ''), q.query, 'i')
         or len(list_filter(coalesce(d.features, []), lambda f: regexp_matches(f, q.query, 'i'))) > 0
       where q.query <> '(')
    where rank <= 10""")
def q_regex_search(spark, d):
    return S.regex_search(T.described_products(spark, d), _patterns(spark, d), 10, literal=False)


@register("rejected_patterns", "T4,P10", "select '(' as query from (select count(*) as n from part) where n >= 0")
def q_rejected_patterns(spark, d):
    """Queries that are no patterns are reported, they do not fail the job."""
    return RX.bad_patterns(_patterns(spark, d)).select("query")
