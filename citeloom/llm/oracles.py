"""SQL for the training-data queries that SQL can express."""

from citeloom.plans.oracle_sql import CITED, SPLIT, plain

_CLASSES = f"with {CITED}, c as (select record_id, k, list_sort(cited) s from w)"
_ITEMS = f"""with {SPLIT}, i as (select 'Keywords' field_name, record_id, list_distinct([{plain('v')} for v in kw]) s from f where len(kw) > 0
 union all select 'WoS Categories', record_id, list_distinct([{plain('v')} for v in ca]) s from f where len(ca) > 0), x as (select field_name, record_id, unnest(s) item from i),
 t as (select field_name, count(*) n from i group by 1), one as (select field_name, item, count(*) n from x group by 1, 2),
 two as (select a.field_name, a.item item_a, b.item item_b, count(*) n_ab from x a join x b on a.field_name = b.field_name and a.record_id = b.record_id and a.item < b.item group by 1, 2, 3),
 p as (select two.*, a.n n_a, b.n n_b, t.n from two join one a on a.field_name = two.field_name and a.item = item_a join one b on b.field_name = two.field_name and b.item = item_b join t on t.field_name = two.field_name)"""
_XLNX = lambda x: f"(case when {x} > 0 then ({x})::double * ln(({x})::double) else 0.0::double end)"
_LLR = f"2 * ({' + '.join(map(_XLNX, ('n_ab', 'n_a - n_ab', 'n_b - n_ab', 'n - n_a - n_b + n_ab')))} - ({' + '.join(map(_XLNX, ('n_a', 'n - n_a', 'n_b', 'n - n_b')))}) + {_XLNX('n')})"
_TERMS = f"with {SPLIT}, x as (select record_id, {plain('v')} keyword from (select record_id, unnest(kw) v from f)), g as (select keyword, count(*) occurrences, count(distinct record_id) n_rows from x group by 1), n as (select count(*) n from f where len(kw) > 0), m as (select keyword, occurrences, n_rows, case when n_rows = 1 then 'rare' when n_rows > 0.03 * n then 'common' end mark from g, n)"

ORACLES = {
    "p1_found": f"{_CLASSES} select a.record_id record_id_a, b.record_id record_id_b from c a join c b on a.k = b.k and a.s = b.s and a.record_id < b.record_id",
    "p1_collapsed": f"{_CLASSES} select min(record_id) record_id, count(*) n_copies from c where k is not null group by k, s union all select record_id, 1 from c where k is null",
    "p4_found": f"{_ITEMS} select field_name, item_a, item_b from p where n_ab >= 3 and n_ab >= 0.0025 * n and n_ab * n >= 6 * n_a * n_b",
    "p4_pairs": f"{_ITEMS} select field_name, item_a, item_b, n_ab, n_a, n_b, n, round(n_ab::double * n / (n_a::double * n_b), 6) ratio, round(greatest({_LLR}, 0.0), 4) llr from p",
    "p6_found": f"{_TERMS} select keyword, mark from m where mark is not null",
    "p6_frequencies": f"{_TERMS} select keyword, occurrences, n_rows, mark from m",
}
