"""SQL for DuckDB that gives each query's result another way; pieces are joined as common table expressions."""

from __future__ import annotations

from citeloom.functions.parsing import CONFERENCE_WORDS, KEYWORD_STOPS, TEXT_STOPS

WS = "'" + " \t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000'"
Q = r"""("([^"\\]|\\.)*"|'([^'\\]|\\.)*')"""
LIST = rf"(?s)\[\s*({Q}(\s*,\s*{Q})*\s*,?\s*)?\]"


def lit(text: str) -> str:
    """An SQL string."""
    return "'" + text.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"trim({x}, {WS})"


def is_list(x: str) -> str:
    return f"regexp_full_match({x}, {lit(LIST)})"


def unescape(x: str) -> str:
    return rf"regexp_replace(replace({x}, '\t', chr(9)), '(?s)\\(.)', '\1', 'g')"


def items(x: str) -> str:
    return f"[{unescape('substr(q, 2, length(q) - 2)')} for q in regexp_extract_all({x}, {lit('(?s)' + Q)})]"


def parts(x: str, pattern: str, lower: bool = True) -> str:
    one = f"lower({strip('q')})" if lower else strip("q")
    return f"[{one} for q in regexp_split_to_array({x}, {lit(pattern)}) if {strip('q')} <> '']"


NONE = "[]::varchar[]"
K = "typed_keywords"
KEYWORDS_H = f"""case when {K} is null then {NONE} when {is_list(K)} then {items(K)} when contains({K}, ';') then {parts(K, ';')} when contains({K}, ',') then {parts(K, ',')}
 when contains({K}, '|') then {parts(K, '[|]')} when contains({K}, '、') then {parts(K, '、')} else [lower({strip(K)})] end"""
S = strip(K)
STOPS = "(" + ", ".join(map(lit, KEYWORD_STOPS)) + ")"
KEYWORDS_I = f"""list_sort(list_distinct([x for x in (case when {K} is null then {NONE} when {is_list(S)} then [lower({strip('y')}) for y in {items(S)} if {strip('y')} <> '']
 when starts_with({S}, '[') and ends_with({S}, ']') then [lower({S})] else {parts(S, '[;,]')} end) if length(x) > 1 and x not in {STOPS}]))"""
KEYWORDS_TOPIC = f"case when {K} is null then {NONE} when {is_list(K)} then {items(K)} else {parts(K, '[,;]')} end"


def keywords_theme(bad: str) -> str:
    return f"""case when {K} is null then {NONE} when {is_list(K)} then [lower({strip('y')}) for y in {items(K)} if {strip('y')} <> ''] when starts_with({K}, '[') then {bad}
 when contains({K}, ';') then {parts(K, ';')} else {parts(K, ',')} end"""


C = strip("typed_categories")
CATEGORIES = f"""case when typed_categories is null then {NONE} when {is_list(C)} then {items(C)} when starts_with({C}, '[') and ends_with({C}, ']') then {NONE}
 when contains({C}, ';') then {parts(C, ';', False)} when contains({C}, '|') then {parts(C, '[|]', False)} when contains({C}, '/') then {parts(C, '/', False)} else [{C}] end"""
REFS_IN = f"case when {is_list('citing')} then {items('citing')} else {NONE} end"
REFS = f"case when {is_list('citing')} then list_distinct({items('citing')}) else {NONE} end"
REFS_LENIENT = f"""case when citing is null or citing in ('', '[]') then {NONE} when {is_list('citing')} then {items('citing')}
 else {parts("replace(replace(trim(citing, '[]'), '''', ''), '\"', '')", ',', False)} end"""
DOIS = rf"""coalesce(list_sort(list_distinct([d for d in [rtrim(ltrim(h, '['), ',;]') for h in list_concat(list_concat(regexp_extract_all(citations, '(?i)DOI\s+([^\s;,\]]+)', 1), regexp_extract_all(citations, '(?i)doi:\s*([^\s;,\]]+)', 1)),
 regexp_extract_all(citations, '(?i)10\.\d{{4,9}}/[-._;()/:A-Z0-9]+'))] if starts_with(d, '10.') and length(d) > 10])), {NONE})"""
BARE = lambda x: rf"regexp_replace({strip(x)}, '^(https?://doi\.org/|doi:)', '')"

_COLUMNS = '"DOI" doi, "Source Title" title, "Publication Year" typed_year, "Keywords" typed_keywords, "WoS Categories" typed_categories, citing, citations, "Article Title" "name", "Abstract" abstract'
ROWS = rf"""raw as (select {_COLUMNS}, row_no nth, true is_target from target_data union all by name select {_COLUMNS}, record_id nth, false is_target from data_with_citing),
 bg as (select *, 2 * nth + (not is_target)::integer "row", row_number() over (order by not is_target, nth) row_no, case when doi not in ('', 'nan') then doi end id, case when title not in ('', 'nan') then title end periodical,
 case when regexp_full_match({strip('typed_year')}, '[0-9]{{1,9}}(\.[0-9]*)?') then try_cast(regexp_extract({strip('typed_year')}, '^[0-9]+') as integer) end "year" from raw)"""


def q(*ctes: str, select: str) -> str:
    return "with recursive " + ",\n ".join((ROWS, *ctes)) + "\n" + select


def parsed(expression: str) -> str:
    return q(select=f'select "row", to_json({expression})::varchar items from bg')


DISTINCT_REFS = f"g as (select id, periodical, row_no, is_target, {REFS} refs from bg)"
GRAPH = DISTINCT_REFS + """,
 edges as (select distinct id src, unnest(refs) dst from g where id is not null),
 newest as (select id, refs from g where id is not null qualify row_number() over (partition by id order by row_no desc) = 1),
 own as (select distinct id src, unnest(refs) dst from newest),
 focal as (select distinct id from g where is_target and id is not null)"""
SCORES = GRAPH + """,
 citers as (select distinct f.id f, e.src c from focal f join edges e on e.dst = f.id),
 near as (select distinct f.id f, e.src c from focal f join own r on r.src = f.id join edges e on e.dst = r.dst),
 linked as (select distinct f.id f, e.src c from focal f join own r on r.src = f.id join own e on e.dst = r.dst),
 nj as (select f, count(*) n from citers semi join linked using (f, c) group by f),
 nc as (select f, count(*) n from citers group by f),
 nk as (select f, count(*) n from near anti join citers using (f, c) group by f),
 parts as (select id, coalesce(nc.n, 0) - coalesce(nj.n, 0) ni, coalesce(nj.n, 0) nj, coalesce(nk.n, 0) nk from focal left join nj on nj.f = id left join nc on nc.f = id left join nk on nk.f = id),
 scores as (select *, case when ni + nj + nk > 0 then (ni - nj)::double / (ni + nj + nk) else 0.0::double end d from parts)"""
PERIODICAL_ROWS = SCORES + ", jr as (select g.id, periodical, d from g join scores using (id) where is_target)"
ENHANCED = PERIODICAL_ROWS + """,
 best as (select periodical, avg(d) m from (select *, row_number() over (partition by periodical order by d desc) r from jr where periodical is not null) where r <= 10 group by periodical),
 en as (select periodical, count(*) n_papers, any_value(m) m, any_value(m) * 0.6::double + 0.4::double * any_value(m) / ln(1 + count(*)) e from jr join best using (periodical) group by periodical)"""


def pairs(source: str, keep: str) -> str:
    return f"select {keep}, least(k[i], k[j]) k1, greatest(k[i], k[j]) k2 from {source}, unnest(range(1, len(k) + 1)) a(i), unnest(range(i + 1, len(k) + 1)) b(j)"


TIMELINE_H = f"kw as (select \"row\", periodical, \"year\", is_target, {KEYWORDS_H} k from bg), tl as (select k1, k2, min(y) first_year from ({pairs('kw', '\"year\" y')}) where y is not null group by 1, 2)"
REF_H = TIMELINE_H + ', ref as (select max("year") y from kw where is_target)'
NOVELTY_H = REF_H + f""",
 met as (select p.*, tl.first_year is null or ref.y - tl.first_year <= 1 novel from ({pairs('(from kw where is_target)', '"row", periodical')}) p left join tl using (k1, k2), ref),
 nov as (select "row", any_value(periodical) periodical, count(*) n_pairs, count(*) filter (where novel) n_novel, count(*) filter (where novel)::double / count(*) nv from met group by "row")"""


def by_doi(name: str, where: str) -> str:
    return f"""{name} as (select id, arg_max(k, row_no) k, (array_agg("year" order by row_no))[1] y, (array_agg(periodical order by row_no))[1] periodical
 from (select *, {KEYWORDS_I} k from bg where id is not null{where}) group by id union all select 'paper_' || "row", {KEYWORDS_I}, null, null from bg where id is null{where})"""


NOVELTY_I = by_doi("every", "") + ", " + by_doi("mine", " and is_target") + f""",
 tl as (select k1, k2, min(y) first_year from ({pairs('every', 'y')}) where y is not null group by 1, 2),
 ref as (select max("year") y from bg where is_target),
 met as (select p.*, tl.first_year is null or abs(ref.y - tl.first_year) <= 1 novel from ({pairs('mine', 'id, periodical')}) p left join tl using (k1, k2), ref),
 nov as (select id, any_value(periodical) periodical, count(*) n_pairs, count(*) filter (where novel) n_novel, count(*) filter (where novel)::double / count(*) nv from met group by id)"""

CATS = f"""cr as (select "row", periodical, id, row_no, is_target, {CATEGORIES} cs, {REFS_IN} refs from bg),
 pc as (select id, arg_max(cs, row_no) cs from cr where id is not null and len(cs) > 0 group by id)"""


def counts(source: str, least: int) -> str:
    return f"""cc as (select i, j, count(*) n from (select s.cs[a] i, s.cs[b] j from (select cs from {source} where len(cs) >= {least}) s, unnest(range(1, len(s.cs) + 1)) x(a), unnest(range(1, len(s.cs) + 1)) y(b)) group by 1, 2)"""


SALTON = """norm as (select i, sqrt(sum(n * n)::double) v from cc group by i),
 sim as (select i, j, case when i = j then 1.0::double else dot / (a.v * b.v) end s from (select x.i, y.i j, sum(x.n * y.n)::double dot from cc x join cc y on x.j = y.j group by 1, 2) join norm a using (i) join norm b on b.i = j)"""
Z = """tot as (select "row", sum(n)::double t, count(*) m from found group by "row"),
 z as (select a."row", any_value(tot.m) m, sum(coalesce(s, case when a.c = b.c then 1.0 else 0.0 end::double) * a.n / t * b.n / t) z from found a join found b using ("row") join tot using ("row") left join sim on sim.i = a.c and sim.j = b.c group by a."row")"""
TD_IN = CATS + ", " + counts("pc", 2) + ", " + SALTON + """,
 found as (select "row", c, count(*) n from (select "row", unnest(pc.cs) c from (select "row", unnest(refs) id from cr where is_target) join pc using (id)) group by 1, 2), """ + Z + """,
 td as (select "row", periodical, case when m > 1 then 1 - z else 0.0::double end rs from cr left join z using ("row") where is_target)"""
KU = f"""kc as (select bare id, arg_max(trim(typed_categories), row_no) c from (select *, {BARE('id')} bare from bg where is_target and id is not null and typed_categories is not null) group by 1),
 kr as (select "row", periodical, {REFS_LENIENT} refs from bg where exists (select 1 from bg t where t.is_target and t.periodical is not distinct from bg.periodical)),
 found as (select "row", c, count(*) n from (select "row", {BARE('r')} id from (select "row", unnest(refs) r from kr)) join kc using (id) group by 1, 2),
 sets as (select "row", list(c) cs from found group by 1), """ + counts("sets", 1)
TD_KU = KU + ", " + SALTON + ", " + Z + """, td as (select kr."row", periodical, case when z > 0 then 1 / z else 1.0::double end td from kr left join z using ("row"))"""

# The ratio of matching blocks: the longest common block (the first in the keyword, then in the term), then
# the same to its left and right. A block is coded as its length times a million less its place.
_BLOCK = "list_max(flatten([[k * 1000000 - i for k in range(1, length(a) - i + 2) if contains(b, substr(a, i, k))] for i in range(1, length(a) + 1)]))"
EXACT = f"""fr as (select "row", unnest(list_distinct({KEYWORDS_TOPIC})) keyword from bg), dict as (select distinct field, lower(term) term from field_terms),
 ex as (select distinct keyword, field from fr join dict on lower(trim(keyword)) = term)"""
WORDS = f"""{EXACT}, rest as (select distinct keyword, lower(trim(keyword)) a from fr where keyword is not null and keyword not in (select keyword from ex)),
 la as (select a, c, count(*) n from (select distinct a, a s from rest) x, unnest(string_split(s, '')) y(c) group by 1, 2), lb as (select b, c, count(*) n from (select distinct term b, term s from dict) x, unnest(string_split(s, '')) y(c) group by 1, 2),
 near as (select a, b from la join lb using (c) group by a, b having 2 * sum(least(la.n, lb.n)) >= 0.75 * (length(a) + length(b))),
 blocks as (select a a0, b b0, a, b, 0 n from near union all
  select a0, b0, u.a, u.b, u.n from (select a0, b0, unnest([struct_pack(a := substr(a, 1, i - 1), b := substr(b, 1, j - 1), n := k), struct_pack(a := substr(a, i + k), b := substr(b, j + k), n := 0)]) u
   from (select *, instr(b, substr(a, i, k)) j from (select *, k * 1000000 - x i from (select *, ((x + 999999) // 1000000) k from (select *, {_BLOCK} x from blocks where a <> '' and b <> '') where x is not null))))),
 alike as (select a0, b0 from blocks group by a0, b0 having 2.0 * sum(n) / (length(a0) + length(b0)) >= 0.75),
 fm as (select keyword, field from ex union select keyword, field from rest join alike on a = a0 join dict on term = b0)"""
SHARES = WORDS + """, fc as (select "row", field, count(*) n from fr join fm using (keyword) group by 1, 2), fs as (select *, n::double / sum(n) over (partition by "row") share from fc),
 ent as (select "row", count(*) n_fields, abs(-sum(share * log2(share))) e from fs group by "row")"""
THEMES = f"""th as (select periodical, row_no, {keywords_theme(NONE)} k from bg where periodical is not null),
 tw as (select periodical, row_no, i pos, k[i] keyword from th, unnest(range(1, len(k) + 1)) a(i)),
 tc as (select periodical, keyword, count(*) n, min(struct_pack(r := row_no, p := pos)) f from tw where periodical in (select periodical from bg group by periodical having count(*) >= 5) group by 1, 2),
 tt as (select *, row_number() over (partition by periodical order by n desc, f) place from tc qualify place <= 5)"""
CLEAN = r"""case when text is null then '' else trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(text), 'http[^\s\p{Z}]+|www[^\s\p{Z}]+', '', 'g'), '\p{Nd}+', '', 'g'), '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+', ' ', 'g')) end"""
TEXT_STOPS_SQL = "(" + ", ".join(map(lit, TEXT_STOPS)) + ")"
CONFERENCE = "coalesce(" + " or ".join(f"contains(upper(title), {lit(w)})" for w in CONFERENCE_WORDS) + " or regexp_matches(title, '20[0-9]{2}'), false)"

REFERENCE = {
    "keywords_parse_h": parsed(KEYWORDS_H),
    "keywords_parse_i": parsed(KEYWORDS_I),
    "keywords_parse_topic": parsed(KEYWORDS_TOPIC),
    "keywords_parse_theme": parsed(keywords_theme(NONE)),
    "keywords_parse_notebook": parsed(keywords_theme(f"[lower({strip(K)})]")),
    "categories_parse": parsed(CATEGORIES),
    "refs_parse": parsed(f"list_sort({REFS})"),
    "refs_parse_repeats": parsed(REFS_IN),
    "refs_parse_lenient": parsed(REFS_LENIENT),
    "doi_extract": parsed(DOIS),
    "doi_normalise": q(select=f'select "row", {BARE("id")} doi from bg where id is not null'),
    "conference_filter": q(select=f'select "row", title from bg where not {CONFERENCE}'),
    "year_filter": q(select='select "row", "year" from bg where "year" >= 2010'),
    "text_clean": f"select doc_id, {CLEAN} cleaned from documents",
    "doc_top_terms": f"""with c as (select doc_id, string_split({CLEAN}, ' ') w from documents), x as (select doc_id, unnest(w) word, generate_subscripts(w, 1) pos from c),
 n as (select doc_id, word, count(*) n, min(pos) f from x where length(word) >= 3 and regexp_full_match(word, '\\p{{L}}+') and word not in {TEXT_STOPS_SQL} group by 1, 2)
 select doc_id, row_number() over (partition by doc_id order by n desc, f)::integer place, word, n from n qualify place <= 15""",
    "term_source_both": q(
        f"""tt as (select "row", string_split({CLEAN.replace("text", "abstract")}, ' ') w from bg where abstract is not null), tx as (select "row", unnest(w) word, generate_subscripts(w, 1) pos from tt),
 tn as (select "row", word, count(*) n, min(pos) f from tx where length(word) >= 3 and regexp_full_match(word, '\\p{{L}}+') and word not in {TEXT_STOPS_SQL} group by 1, 2),
 tp as (select "row", word from tn qualify row_number() over (partition by "row" order by n desc, f) <= 15)""",
        select=f'select "row", unnest({KEYWORDS_TOPIC}) term from bg union select "row", word from tp',
    ),
    "label_truncation": q(select="select distinct periodical, case when length(periodical) > 28 then substr(periodical, 1, 28) || '...' else periodical end \"label\" from bg where periodical is not null"),
    "union_by_name": q(select="select is_target, count(*) n_rows, count(id) n_ids from bg group by 1"),
    "top_n_periodicals": q(select="select periodical, count(*) n_papers from bg where periodical is not null group by 1 order by 2 desc, 1 limit 10"),
    "semi_join_target": q(select='select "row", periodical from bg where exists (select 1 from bg t where t.is_target and t.periodical is not distinct from bg.periodical)'),
    "clean_pipeline": q(f'kept as (select * from bg where not {CONFERENCE} and "year" >= 2000)', select="select periodical, count(*) n_papers, min(\"year\") first_year from kept where periodical is not null group by 1 order by 2 desc, 1 limit 5"),
    "clean_listed": q(select='select "row", periodical from bg where periodical in (select periodical from bg where is_target)'),
    "csv_round_trip": "select record_id, " + ", ".join(f"""nullif("{c}", '') {n}""" for c, n in (("DOI", "doi"), ("Source Title", "title"), ("Publication Year", '"year"'), ("Keywords", "keywords"), ("citing", "citing"))) + " from data_with_citing",
    "dup_doi_last_wins": q(select="select id, typed_categories category from bg where id is not null qualify row_number() over (partition by id order by row_no desc) = 1"),
    "first_row_per_doi": q(select="select id, periodical from bg where id is not null qualify row_number() over (partition by id order by row_no) = 1"),
    "edges_explode": q(DISTINCT_REFS, select="select distinct id src, unnest(refs) dst from g where id is not null"),
    "citers_two_hop": q(GRAPH, select="select f.id, count(distinct e.src) n_around from focal f join edges r on r.src = f.id join edges e on e.dst = r.dst group by 1"),
    "dindex_components": q(SCORES, select="select id, ni, nj, nk from scores"),
    "dindex_paper": q(SCORES, select="select id, round(d, 6) d from scores"),
    "dindex_nulldoi_merge": q(SCORES, "s as (select g.id, coalesce(d, 0.0::double) d from g left join scores using (id) where is_target)", select="select periodical, count(*) n_rows, count(g.id) n_ids, round(avg(s.d), 6) mean_d from s join g on g.id is not distinct from s.id where is_target group by periodical"),
    "periodical_disruption_mean": q(PERIODICAL_ROWS, select="select periodical, round(avg(d), 6) disruption_mean, count(id) paper_count from jr where periodical is not null group by 1"),
    "periodical_enhanced_topk": q(ENHANCED, select="select periodical, n_papers, round(m, 6) top_k_mean, round(e, 6) enhanced_disruption from en"),
    "periodical_percent_rank": q(ENHANCED, select="select row_number() over (order by round(e * 100, 4) desc, periodical)::integer rank, periodical, round(e * 100, 4) percent_score from en"),
    "ranking_summary": q(PERIODICAL_ROWS, select="select count(m) n, round(avg(m), 6) mean, round(stddev_samp(m), 6) std, round(max(m), 6) most, round(min(m), 6) least from (select avg(d) m from jr where periodical is not null group by periodical)"),
    "graph_nodes": q(SCORES, select="select id, 'paper' \"type\", len(refs)::integer n_references, round(d, 6) disruption_index from newest left join scores using (id)"),
    "graph_edges": q(GRAPH, select='select dst "source", src target from edges'),
    "pair_timeline": q(TIMELINE_H, select="select * from tl"),
    "pair_timeline_recent": q(TIMELINE_H, select="select * from tl where first_year >= 2022 order by first_year, k1, k2 limit 5"),
    "pair_timeline_earliest": q(TIMELINE_H, select="select * from tl order by first_year, k1, k2 limit 5"),
    "paper_novelty_h": q(NOVELTY_H, select='select "row", n_pairs, n_novel, round(nv, 6) novelty from nov'),
    "periodical_novelty_h": q(NOVELTY_H, select="select coalesce(periodical, 'Unknown') periodical, round(avg(nv), 6) novelty_mean, round(stddev_pop(nv), 6) novelty_std, count(*) n_papers, round(avg(nv) * 600, 4) percent_score from nov group by 1"),
    "paper_novelty_i": q(NOVELTY_I, select="select id, n_pairs, n_novel, round(nv, 6) novelty from nov"),
    "periodical_novelty_i": q(NOVELTY_I, select="select periodical, round(avg(nv), 6) novelty_mean from nov where periodical is not null group by 1"),
    "novel_pair_drilldown": q(REF_H, select=f"select p.\"row\", k1, k2, first_year, coalesce(abs(ref.y - first_year) <= 1, false) novel from ({pairs('(from kw where is_target)', chr(34) + 'row' + chr(34))}) p left join tl using (k1, k2), ref"),
    "keyword_corpus_stats": q(TIMELINE_H, select="select count(*) n_papers, count(*) filter (where len(k) > 0) n_with_keywords, sum(len(k))::bigint n_keywords, count(*) filter (where \"year\" is null) n_without_year, count(*) filter (where \"year\" is null and len(k) > 1) n_skipped, (select count(distinct x) from (select unnest(k) x from kw)) n_distinct, (select count(*) from tl) n_pairs, (select sum(len(" + DOIS + "))::bigint from bg) n_dois from kw"),
    "cooc_in": q(CATS, counts("pc", 2), select="select * from cc"),
    "salton_similarity": q(CATS, counts("pc", 2), SALTON, select="select i, j, round(s, 6) s from sim"),
    "rao_stirling": q(TD_IN, select='select "row", round(rs, 6) diversity from td'),
    "td_in": q(TD_IN, select='select "row", round(case when rs > 0 then 1 / rs else 1.0 end, 4) td from td'),
    "periodical_td_in": q(TD_IN, select="select periodical, round(avg(t), 4) td_mean, round(stddev_samp(t), 4) td_std, round(avg(round(t * 5, 1)), 4) percent_mean, round(stddev_samp(round(t * 5, 1)), 4) percent_std, count(*) n_papers from (select periodical, case when rs > 0 then 1 / rs else 1.0::double end t from td) where periodical is not null group by 1"),
    "cooc_ku": q(KU, select="select * from cc"),
    "td_ku": q(TD_KU, select='select "row", round(td, 6) td from td'),
    "periodical_td_ku": q(TD_KU, select="select periodical, round(avg(td), 4) td_mean from td where periodical is not null group by 1"),
    "similarity_matrix_wide": q(
        CATS, counts("pc", 2), SALTON, "names as (select i category, row_number() over (order by i) - 1 place from norm)",
        "cells as (select a.category, a.place::integer place, 's' || b.place k, round(coalesce(s, 0.0), 6) s from names a cross join names b left join sim on sim.i = a.category and sim.j = b.category)",
        select="select * from (pivot cells on k using first(s) group by category, place)",
    ),
    "field_match_exact": q(EXACT, select="select * from ex"),
    "field_match_fuzzy": q(WORDS, select="select * from fm"),
    "field_shares": q(SHARES, select='select "row", field, n, round(share, 6) share from fs'),
    "paper_entropy": q(SHARES, select='select "row", n_fields, round(e, 6) entropy from ent'),
    "periodical_entropy": q(SHARES, select="select coalesce(periodical, 'Unknown') periodical, round(avg(coalesce(e, 0)), 6) entropy_mean, round(avg(coalesce(n_fields, 0)), 6) fields_mean, count(*) n_papers, round(avg(coalesce(e, 0)) * 500, 3) percent_score from bg left join ent using (\"row\") group by 1"),
    "periodical_keyword_counts": q(THEMES, select="select periodical, keyword, n from tc"),
    "periodical_topk_keywords": q(THEMES, select="select periodical, place::integer place, keyword, n from tt"),
    "theme_prompt": q(THEMES, select="select periodical, string_agg(keyword, ', ' order by place) keywords, periodical || ': ' || string_agg(keyword, ', ' order by place) prompt from tt group by 1"),
}


# The general problems. Here a field is read token by token, where the engine works with placeholders.

def values_of(x: str, hard: str, soft: str = "") -> str:
    """List of the values packed in a field."""
    every = (hard + soft).replace("|", "\\|")
    text = strip(f"coalesce({x}, '')")
    inner = f"substr({text}, 2)"
    body = f"case when not starts_with({text}, '[') then {text} when ends_with({text}, ']') and length({inner}) - length(replace({inner}, ']', '')) > length({inner}) - length(replace({inner}, '[', '')) then substr({text}, 2, length({text}) - 2) else {inner} end"
    token = lit(rf"""(?s)[\s{every}]*("(?:[^"\\]|\\.|"")*"|'(?:[^'\\]|\\.|'')*'|[^{hard.replace("|", "\\|")}]+)""")
    bare = unescape("replace(substr(q, 2, length(q) - 2), repeat(q[1], 2), q[1])")
    one = f"case when length(q) > 1 and q[1] in ('\"', '''') and q[-1] = q[1] then {strip(bare)} else q end"
    nothing = f"('', '{soft}')"  # a soft separator that ends a list
    return f"[v for v in [{one} for q in [{strip('t')} for t in regexp_extract_all({body}, {token}, 1)]] if v not in {nothing}]"


def plain(x: str) -> str:
    return f"lower(trim(regexp_replace({x}, '[\\s\\p{{Z}}\\x1c-\\x1f\\x85]+', ' ', 'g')))"


GAP = r"[^A-Za-z0-9/.\-]{0,3}"


def key_of(x: str) -> str:
    return rf"nullif(lower(regexp_replace(regexp_extract({x}, '(?s)(?:^|[^0-9])(1{GAP}0{GAP}[.·．]{GAP}[0-9].*)', 1), '[^A-Za-z0-9]', '', 'g')), '')"


SPLIT = f"""f as (select record_id, loaded_at, "DOI" doi, "Source Title" title, {values_of('"Keywords"', ';,|、' + chr(10))} kw, {values_of('"WoS Categories"', ';|/' + chr(10), ',')} ca, {values_of('citing', ';,|' + chr(10))} ci from data_with_citing)"""
CITED = SPLIT + f""", w as (select *, {key_of('doi')} k, list_distinct([x for x in [{key_of('v')} for v in ci] if x is not null]) cited from f)"""
ORPHANS = CITED + f""", e as (select record_id, loaded_at, unnest(cited) cited_doi from w),
 here as (select k, min(coalesce(loaded_at, timestamp '0001-01-01')) first_at from w where k is not null group by k),
 old as (select distinct {key_of('"DOI"')} k from target_data), gone as (select distinct {key_of('"DOI"')} k from withdrawn_papers),
 o as (select record_id, loaded_at, cited_doi, case when cited_doi in (select k from gone where k is not null) then 'withdrawn' when old.k is null and here.k is null then 'missing' when old.k is null and first_at > loaded_at then 'late' end state
 from e left join here on here.k = cited_doi left join old on old.k = cited_doi)"""

PROBLEMS = {
    "p2_found": f"with {ORPHANS} select record_id, cited_doi, state from o where state is not null",
    "p2_orphans_by_month": f"with {ORPHANS} select 'data_with_citing' table_name, strftime(loaded_at, '%Y-%m') period, state, count(*) n_refs from o where state is not null group by 1, 2, 3",
    "p5_found": f"""with {CITED} select 'Source Title' field_name, t key_value from (select {plain('title')} t from w) where t <> '' group by 2 having count(*) > 0.03 * (select count(*) from w)
 union all select 'citing', k from (select unnest(cited) k from w) group by 2 having count(*) > 0.01 * (select sum(len(cited)) from w)""",
    "p5_title_stats": f"""with {CITED}, t as (select {plain('title')} title, len(cited) n from w), m as (select title, n, count(*) c from t group by 1, 2 qualify row_number() over (partition by title order by count(*) desc, n) = 1)
 select t.title, count(*) n_rows, sum(t.n)::bigint sum_refs, round(avg(t.n), 6) mean_refs, quantile_disc(t.n, 0.5)::bigint median_refs, min(t.n)::bigint min_refs, max(t.n)::bigint max_refs, count(distinct t.n) distinct_counts, any_value(m.n)::bigint usual_refs
 from t join m on m.title is not distinct from t.title group by t.title""",
    "p5_cited_stats": f"""with {CITED}, t as (select unnest(cited) cited_doi, {plain('title')} title from w), g as (select cited_doi, title, count(*) c from t group by 1, 2)
 select cited_doi, sum(c)::bigint n_rows, count(title) n_titles, (array_agg(title order by c desc, title) filter (where title is not null))[1] top_value, (max(c) filter (where title is not null))::bigint top_weight from g group by 1""",
    "p7_found": f"""with {SPLIT} select record_id, 'Keywords' field_name, generate_subscripts(kw, 1)::integer pos, unnest(kw) "value" from f union all select record_id, 'WoS Categories', generate_subscripts(ca, 1)::integer, unnest(ca) from f
 union all select record_id, 'citing', generate_subscripts(ci, 1)::integer, unnest(ci) from f""",
}
