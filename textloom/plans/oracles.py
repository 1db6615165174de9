"""The queries' results as DuckDB SQL over the same tables.

Written independently of the DataFrame plans, but for stems and stop words: the stemmer's steps are generated for both engines from the same rules
(tests hold them against plain published rules), and both read the same list of stop words.
"""

from __future__ import annotations

from textloom.functions.stem import stem_sql
from textloom.sources.readers import STOPWORDS

# The steps up to digits; DuckDB's engine has no look-ahead, so single characters are dropped from the token list.
ASCII = r"regexp_replace(text, '[^\x00-\x7F]', ' ', 'g')"
CHARSET = rf"regexp_replace({ASCII}, '[^a-zA-Z0-9/?:().,''+-]', ' ', 'g')"
URL = rf"regexp_replace({CHARSET}, '(https?|ftp|gopher|telnet|file|Unsure):(//|\\)+[\w:#@%/;$()~?+-=\\.&]*', ' ', 'g')"
DIGITS = rf"regexp_replace(regexp_replace({URL}, '[[:punct:]]', ' ', 'g'), '[0-9]', ' ', 'g')"
_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)

_SPLIT = rf"""raw as (select doc_id, {DIGITS} as t from documents),
parts as (select doc_id, t, regexp_split_to_array(t, '\s+') as l from raw),
lists as (select doc_id, t, list_filter(l, lambda x, i: length(x) > 1 or (length(x) = 1 and (i = 1 or i = len(l)))) as kept from parts)"""
_NORMAL = r"""case when len(kept) = 0 then case when t = '' then '' else ' ' end else concat(case when regexp_matches(t, '^\s') then ' ' else '' end,
array_to_string(kept, ' '), case when regexp_matches(t, '\s$') then ' ' else '' end) end"""


def tokens(filtered: bool) -> str:
    """CTEs up to toks(docid, term)."""
    base = f"with {_SPLIT}, plain as (select doc_id + 1 as docid, unnest(list_transform(kept, lambda x: lower(x))) as term from lists)"
    if not filtered:
        return f"{base}, toks as (select * from plain)"
    return (
        f"{base}, unstopped as (select * from plain where term not in ({_STOP})), vocabulary as (select distinct term from unstopped), "
        f"stems as (select term, stem from {stem_sql('vocabulary')}), toks as (select docid, stem as term from unstopped join stems using (term))"
    )


def index(filtered: bool) -> str:
    """CTEs up to postings p, document lengths dl, statistics st and lexicon lex."""
    return f"""{tokens(filtered)},
p0 as (select term, docid, cast(count(*) as integer) as tf from toks group by all),
dl as (select d.doc_id + 1 as docid, cast(d.doc_id as varchar) as docno, cast(coalesce(x.n, 0) as integer) as doclen
       from documents d left join (select docid, sum(tf) as n from p0 group by 1) x on x.docid = d.doc_id + 1),
st as (select sum(doclen)::double / count(*) as avg_len, sum(doclen)::double as total_len, count(*)::double as num_docs from dl),
p as (select term, docid, tf, doclen from p0 join dl using (docid)),
l0 as (select term, count(*) as df, cast(sum(tf) as bigint) as cf from p group by 1),
lx as (select *, ln((select num_docs from st) / df) as idf from l0),
w as (select term, docid, tf, doclen, df, idf, 1.0::double + ln(tf) * idf as w_tfidf,
      tf / (1.2::double * (0.25::double + 0.75::double * doclen / (select avg_len from st)) + tf) * idf as w_bm25 from p join lx using (term)),
lex as (select lx.*, m.max_bm25, m.max_tfidf, cast(ceil(df / floor(sqrt(df))) as integer) as n_blocks
        from lx join (select term, greatest(max(w_bm25), 0) as max_bm25, greatest(max(w_tfidf), 0) as max_tfidf from w group by 1) m using (term))"""


def _in(terms: list[str]) -> str:
    return "(" + ", ".join(f"'{t}'" for t in terms) + ")"


def ranked(terms: list[str], mode: str, scorer: str, k: int, filtered: bool = False, collapse: bool = True) -> str:
    """Best k of a query whose analysed terms are given."""
    need = f"having count(*) = (select count(*) from lex where term in {_in(terms)})" if mode == "and" else ""
    scored = f"{index(filtered)}, s as (select docid, list_sum(list(w_{scorer} order by term)) as score from w where term in {_in(terms)} group by 1 {need})"
    body = "select min(docid) as docid, round(score, 9) as score from s group by 2" if collapse else "select docid, score from s"
    return f"{scored} select docid, round(score, 6) as score from (select * from ({body}) order by score desc, docid limit {k})"


def oracles(c) -> dict[str, str]:
    """All oracles; ``c`` holds the constants of the queries."""
    plain, filtered = index(False), index(True)
    lower_words = "list_transform(kept, lambda x: lower(x))"
    out = {
        "norm_step_ascii": f"select doc_id, {ASCII} as text from documents",
        "norm_step_charset": f"select doc_id, {CHARSET} as text from documents",
        "norm_step_url": f"select doc_id, {URL} as text from documents",
        "norm_step_singles": f"with {_SPLIT} select doc_id, {_NORMAL} as text from lists",
        "normalize": f"with {_SPLIT} select doc_id, lower({_NORMAL}) as text from lists",
        "tokenize": f"with {_SPLIT}, x as (select doc_id, unnest({lower_words}) as term, generate_subscripts(kept, 1) - 1 as pos from lists) select doc_id, cast(pos as integer) as pos, term from x",
        "stopword_list": "select unnest([" + _STOP + "]) as word",
        "stopword_filter": f"{tokens(False)} select docid, term, count(*) as n from toks where term not in ({_STOP}) group by all",
        "analyze_unfiltered": f"{tokens(False)} select docid, term, count(*) as n from toks group by all",
        "analyze_filtered": f"{tokens(True)} select docid, term, count(*) as n from toks group by all",
        "stem": f"{tokens(False)}, v as (select distinct term from toks) select term, stem from {stem_sql('v')}",
        "word_ngrams": f"with {_SPLIT}, x as (select doc_id, {lower_words} as l from lists) select doc_id, unnest(list_transform(range(1, len(l)), lambda i: l[i] || ' ' || l[i + 1])) as gram from x",
        "char_ngrams": "with v as (select distinct p_name from part) select p_name, unnest(list_transform(range(1, length(p_name) - 1), lambda i: substring(p_name, i, 3))) as gram from v",
        "postings": f"{plain} select term, docid, tf, doclen from p",
        "postings_filtered": f"{filtered} select term, docid, tf, doclen from p",
        "postings_scan": f"{plain} select term, docid, tf from p where term in {_in(c.TERMS)}",
        "lexicon": f"{plain} select term, df, cf, n_blocks from lex",
        "lexicon_filtered": f"{filtered} select term, df, cf, round(idf, 6) as idf, n_blocks from lex",
        "lexicon_idf": f"{plain} select term, round(idf, 6) as idf from lex",
        "lexicon_lookup": f"{plain} select term, df, cf, round(idf, 6) as idf from lex where term in {_in(c.TERMS)}",
        "term_upper_bounds": f"{plain} select term, round(max_bm25, 6) as max_bm25, round(max_tfidf, 6) as max_tfidf from lex",
        "doc_index": f"{plain} select * from dl",
        "doc_lengths": f"{plain} select docid, doclen from dl",
        "collection_stats": f"{plain} select round(avg_len, 6) as avg_len, total_len, num_docs from st",
        "skip_blocks": f"""{plain}, r as (select *, row_number() over (partition by term order by docid) as n, cast(floor(sqrt(count(*) over (partition by term))) as integer) as size from p)
            select term, cast((n - 1) // size as integer) as block_no, max(docid) as end_docid, cast(count(*) as integer) as n_postings,
            cast(sum(case when docid < 128 then 1 when docid < 16384 then 2 when docid < 2097152 then 3 when docid < 268435456 then 4 else 5 end) as integer) as doc_bytes,
            cast(sum((tf - 1) // 8 + 1) as integer) as tf_bytes from r group by 1, 2""",
        "tf_histogram": f"{plain} select tf, count(*) as n from p group by 1 order by n desc, tf limit 30",
        "compression_report": f"""{plain} select count(*) as n_postings, 4 * count(*) as raw_docid_bytes, 4 * count(*) as raw_tf_bytes,
            cast(sum(case when docid < 128 then 1 when docid < 16384 then 2 when docid < 2097152 then 3 when docid < 268435456 then 4 else 5 end) as bigint) as docid_bytes,
            cast(sum((tf - 1) // 8 + 1) as bigint) as tf_bytes from p""",
        "index_merge": f"{plain} select term, df, cf, round(idf, 6) as idf, round(max_bm25, 6) as max_bm25 from lex",
        "w_tfidf": f"{plain} select term, docid, round(w_tfidf, 6) as w from w where term in {_in(c.TERMS)}",
        "w_bm25": f"{plain} select term, docid, round(w_bm25, 6) as w from w where term in {_in(c.TERMS)}",
        "next_geq": f"{plain} select min(docid) as docid from p where term = '{c.TERMS[0]}' and docid >= {c.SEEK}",
        "min_docid": f"{plain} select min(docid) as docid from p where term in {_in(c.TERMS)}",
        "query_terms_known": f"{plain} select cast(0 as integer) as qid, term, df from lex where term in {_in(c.TERMS + [c.UNKNOWN])}",
        "maxscore_bounds": f"{plain} select cast(0 as integer) as qid, term, round(max_bm25, 6) as ub, round(sum(max_bm25) over (order by max_bm25, term rows unbounded preceding), 6) as cumulative from lex where term in {_in(c.TERMS)}",
        "docs_all_terms": f"{plain} select docid from p where term in {_in(c.AND_TERMS)} group by 1 having count(*) = {len(c.AND_TERMS)}",
        "docs_any_term": f"{plain} select distinct docid from p where term in {_in(c.TERMS)}",
        "conj_tfidf": ranked(c.AND_TERMS, "and", "tfidf", c.K),
        "conj_bm25": ranked(c.AND_TERMS, "and", "bm25", c.K),
        "disj_tfidf": ranked(c.TERMS, "or", "tfidf", c.K),
        "disj_bm25": ranked(c.TERMS, "or", "bm25", c.K),
        "disj_bm25_keep_ties": ranked(c.TERMS, "or", "bm25", c.K, collapse=False),
        "disj_bm25_maxscore": ranked(c.TERMS, "or", "bm25", c.K),
        "bm25_or_top10": ranked(c.TERMS, "or", "bm25", 10),
        "disj_tfidf_filtered": ranked(c.STEMS, "or", "tfidf", c.K, filtered=True),
        "conj_bm25_filtered": ranked(c.STEMS[:2], "and", "bm25", c.K, filtered=True),
        "topk_distinct_scores": ranked(c.TERMS, "or", "tfidf", 50),
    }
    bench = _SPLIT.replace("raw as", "braw as").replace("from raw", "from braw").replace("parts as", "bparts as").replace("from parts", "from bparts").replace("lists as", "blists as")
    bench = bench.replace("doc_id", "item_id").replace("from documents", "from benchmark")
    out["batch_eval_run"] = f"""{plain}, {bench}, qt as (select distinct item_id as qid, unnest({lower_words}) as term from blists),
        s as (select qid, docid, list_sum(list(w_bm25 order by term)) as score from w join qt using (term) group by 1, 2),
        c as (select qid, round(score, 9) as score, min(docid) as docid from s group by 1, 2),
        b as (select * from (select *, row_number() over (partition by qid order by score desc, docid) as r from c) where r = 1)
        select i.item_id as qid, cast(coalesce(docid, (select num_docs from st) + 1) as bigint) as docid,
        cast(cast(coalesce(docid, (select num_docs from st) + 1) as bigint) - 1 as varchar) as docno, round(coalesce(score, 0), 6) as score from benchmark i left join b on b.qid = i.item_id"""
    out["codec_varbyte"] = f"""{plain}, n as (select distinct docid as n from p) select n, case when n < 128 then printf('%02X', n + 128) when n < 16384 then printf('%02X%02X', n // 128, n % 128 + 128)
        else printf('%02X%02X%02X', n // 16384, n // 128 % 128, n % 128 + 128) end as code, cast(n as bigint) as decoded from n"""
    out["codec_unary"] = f"""{plain}, n as (select distinct tf as n from p) select n, case when n = 1 then '00' when n <= 8 then printf('%02X', (1 << n) - 2)
        else 'FE' || repeat('FF', (n - 1) // 8 - 1) || printf('%02X', (1 << ((n - 1) % 8 + 1)) - 1) end as code, n as decoded from n"""
    out["src_zip_tsv"] = "select cast(doc_id as varchar) as docno, regexp_replace(text, '[\\t\\r\\n]', ' ', 'g') as body from documents"
    return out
