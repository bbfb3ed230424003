"""DuckDB equivalents of those queries that SQL can express."""

_LABELS = """first as (select id, arg_min(active_labels, struct_pack(a := loaded_at, b := active_labels)) as l from generated_prompts group by id),
sets as (select id, list_sort(list_distinct([y for y in [lower(regexp_replace(x, '^\\s+|\\s+$', '', 'g')) for x in l] if y is not null and y <> ''])) as items from first),
n as (select count(*) as n from sets where len(items) > 0),
one as (select item, count(*) as n_item from (select unnest(items) as item from sets) group by item),
long as (select id, unnest(items) as item from sets),
pairs as (select a.item as label_a, b.item as label_b, count(*) as n_ab from long a join long b on a.id = b.id and a.item < b.item group by 1, 2),
full_pairs as (select label_a, label_b, n_ab, a.n_item as n_a, b.n_item as n_b, n.n from pairs join one a on a.item = label_a join one b on b.item = label_b cross join n)"""

_TERMS = """raw as (
select 'option.slot' as field_name, option_seq as k, lower(regexp_replace(slot, '^\\s+|\\s+$', '', 'g')) as term from task_options
union all select 'template.task_type', template_seq, lower(regexp_replace(task_type, '^\\s+|\\s+$', '', 'g')) from task_templates
union all select 'prompt.active_labels', id, lower(regexp_replace(unnest(l), '^\\s+|\\s+$', '', 'g')) from (select id, arg_min(active_labels, struct_pack(a := loaded_at, b := active_labels)) as l from generated_prompts group by id)),
totals as (select 'option.slot' as field_name, count(*) as total from task_options union all select 'template.task_type', count(*) from task_templates
union all select 'prompt.active_labels', count(distinct id) from generated_prompts),
counted as (select field_name, term, count(*) as occurrences, count(distinct k) as records from raw where term is not null and term <> '' group by 1, 2),
marked as (select c.*, case when records < 5 then 'rare' when records > 0.08 * total then 'common' else '' end as mark from counted c join totals using (field_name))"""


def oracle_sql() -> dict[str, str]:
    return {
        "p4_found": f"with {_LABELS} select label_a, label_b from full_pairs where n_ab >= 5 and n_ab * n >= 2 * n_a * n_b",
        "p4_pairs": f"""with {_LABELS} select label_a, label_b, n_ab, n_a, n_b, n, round(n_ab * n / (n_a * n_b), 6) as lift,
round((n_ab + 0.5) * (n - n_a - n_b + n_ab + 0.5) / ((n_a - n_ab + 0.5) * (n_b - n_ab + 0.5)), 6) as odds_ratio from full_pairs""",
        "p5_found": f"with {_TERMS} select field_name, term, mark from marked where mark <> ''",
        "p5_terms": f"with {_TERMS} select field_name, term, occurrences, records, mark from marked",
    }
