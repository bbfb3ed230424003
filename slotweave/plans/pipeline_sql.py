"""DuckDB equivalents of the queries in pipeline."""

from slotweave.functions import values as V
from slotweave.operators.detect import VERB_OF, VERB_PHRASE
from slotweave.plans.sql import _BLANK, _CANON, _DRAWN, _FLAG, _G, _LABELS, _LIST, _LIT, _MAP, _NUMBER, _O1, _PH, _POOL, _POOLS, _STRIP, _T1, _UNIQ, _WORDS, oracle_parts

_LEVELS = _LIST(V.LEVELS)
_OBJECTS = {w: t for t, ws in V.TASK_OBJECTS.items() for w in ws.split()}
_DOC_VERBS = f"""phrases as (select lower(v[i]) as verb, lower({_STRIP('p[i]')}) as phrase from (select *, unnest(range(1, len(v) + 1)) as i from
(select regexp_extract_all(text, {_LIT('(?i)' + VERB_PHRASE)}, 1) as v, regexp_extract_all(text, {_LIT('(?i)' + VERB_PHRASE)}, 2) as p from documents where text is not null))),
named as (select verb, {_MAP(VERB_OF, 'verb', 'null')} as canon, list_filter([regexp_replace(w, '[^a-z]', '', 'g') for w in string_split_regex(phrase, '\\s+')], lambda w: len(w) >= 3 and not list_contains({_LIST(sorted(V.ARTICLES | V.SKIPPED_ADJECTIVES | V.STOP_WORDS))}, w))[1] as object from phrases),
snip as (select *, verb || coalesce(' ' || object, '') as snippet from named),
tasks as (select *, coalesce({_MAP(_OBJECTS, 'object', 'null')}, {_MAP(V.VERB_TASKS, 'canon', 'null')}, {", ".join(f"case when {_FLAG('snippet', ps)} then {_LIT(n)} end" for n, _, ps in V.LABELS)}) as task from snip)"""

_GROUPS = f"""opt as (select {_STRIP('slot')} as slot, {_STRIP('value')} as value, token_length, option_seq from task_options where not {_BLANK('slot')} and not {_BLANK('value')}),
one as (select slot, min(option_seq) as s, arg_min(value, option_seq) as value, arg_min(coalesce(token_length, 0), option_seq) as tl from opt group by slot, lower(value)),
shown as (select slot, s, case when tl <= 50 then left(value, 120) else regexp_replace(left(value, 80), '\\s+$', '') || '…' end as v, row_number() over (partition by slot order by s) as r, count(*) over (partition by slot) as n from one),
grp as (select slot, max(n) as n_values, list(v order by s) as examples from shown where n >= 2 and r <= 12 group by 1)"""
_TYPES = f"""{_GROUPS}, ent as (select slot, lower(replace(trim(slot, '_ '), ' ', '_')) as name, 'cat_' || lower(left(trim(slot, '_'), 1)) as category, 'Values of ' || slot as description, {_UNIQ("case when list_contains([slot], lower(replace(trim(slot, '_ '), ' ', '_'))) then [slot] else [lower(replace(trim(slot, '_ '), ' ', '_')), slot] end")} as s, list_slice(examples, 1, 8) as v from grp),
typ as (select name, arg_min(category, slot) as category, arg_min(description, slot) as description, {_UNIQ('flatten(list(s order by slot))')} as compatible_slots, list_slice({_UNIQ('flatten(list(v order by slot))')}, 1, 8) as example_values from ent where name <> '' group by 1)"""


def _vectors(prefix: str, source: str) -> str:
    """Unit vectors of word hashes as rows (k, dim, x), of a select of k and t."""
    return f"""{prefix}w as (select k, {_NUMBER('lower(w)')} as h from (select k, unnest(regexp_extract_all(t, '[A-Za-z0-9]+')) as w from ({source}))),
{prefix}d as (select k, h % 256 as dim, sum(case when (h // 256) % 2 = 0 then 1 else -1 end)::double as x from {prefix}w group by 1, 2),
{prefix}v as (select k, dim, x / n as x from {prefix}d join (select k, sqrt(sum(x * x)) as n from {prefix}d group by 1) using (k) where n > 0)"""


_CONTEXTS = f"ctx as (select id, slot, replace(text, '{{' || slot || '}}', '[SOMETHING]') as context from (select id, text, unnest(list_distinct(slots)) as slot from t1) where not {_BLANK('slot')})"


def _index(least: float) -> str:
    return f"""{_T1}, {_O1}, {_CONTEXTS}, {_vectors('c', 'select distinct context as k, context as t from ctx')}, {_vectors('o', 'select distinct value as k, value as t from o1')},
near as (select cv.k as context, ov.k as value, round(sum(cv.x * ov.x), 6) as score from cv join ov using (dim) group by 1, 2 having round(sum(cv.x * ov.x), 6) >= {least}),
idx as (select ctx.id, ctx.slot, o1.id as option_id, score, row_number() over (partition by ctx.id, ctx.slot order by score desc, o1.id) as rank from near join ctx on ctx.context = near.context join o1 on o1.value = near.value qualify rank <= 50)"""


def _replaced(text: str = "text") -> str:
    return f"""one as (select id, template_seq, {text} as text, coalesce(level, '') as level, coalesce(compatible_with, []) as links from task_templates where not {_BLANK(text)} and id is not null qualify row_number() over (partition by id order by template_seq) = 1),
kept as (select text, level, arg_min(id, template_seq) as kept_id from one group by 1, 2 having count(*) > 1), same as (select id as old_id, kept_id from one join kept using (text, level) where id <> kept_id),
marked as (select * from one where contains(text, 'First repeat the request')),
both_levels as (select text, arg_min(id, template_seq) filter (where level = 'process_directive') as kept_id from marked group by 1 having list_sort(list(distinct level)) = ['format_constraint', 'process_directive']),
gone as (select * from same union all select id, kept_id from marked join both_levels using (text) where id <> kept_id and id not in (select old_id from same))"""


_SELF = {w: s for s, ws in V.SELF_NAMED.items() for w in ws}
_IS_SELF = lambda slot, value: f"(lower({slot}) = lower({_STRIP(value)}) or ({_WORDS(value)} < 3 and contains(lower({_STRIP(value)}), lower({slot}))))"


def _goes(slot: str, value: str, types: str) -> str:
    low = f"lower({_STRIP(value)})"
    of_type = f"list_filter([{_MAP(V.DEFAULT_SLOTS, 'y', 'null')} for y in {types}], lambda z: z is not null and lower(z) <> {low})[1]"
    return f"case when list_contains({_LIST(V.PREFERRED_SLOTS)}, lower({slot})) then null else coalesce({_MAP(_SELF, low, 'null')}, {_MAP(_SELF, f'lower({slot})', 'null')}, {of_type}, 'description') end"


_AXIS = lambda c: "case " + " ".join(f"when regexp_matches(lower({c}), {_LIT('|'.join(ks))}) then {_LIT(lv)}" for lv, ks in V.LEVEL_KEYWORDS.items()) + " else 'task_type' end"
_NAME = lambda c: f"case when list_contains({_LIST(V.PREFERRED_SLOTS)}, {c}) then {c} else coalesce({_CANON.replace('slot', c) if c != 'slot' else _CANON}, {c}) end"


def _extracted() -> str:
    """One template and its options a unit, step by step."""
    return f"""leaf as (select label, min(level) as level from taxonomy_leaves group by 1), axis as (select level, list(label order by label) as labels from taxonomy_leaves group by 1),
src as (select template_seq as unit, text, list_filter(coalesce(slots, []), lambda x: x is not null) as raw, task_type, level from task_templates where not {_BLANK('text')}),
named as (select *, [{_NAME('slot')} for slot in raw] as canon from src),
t0 as (select unit, list_reduce(list_prepend(text, list_transform(raw, lambda r, i: r || chr(1) || canon[i])), lambda acc, q: replace(acc, '{{' || split_part(q, chr(1), 1) || '}}', '{{' || split_part(q, chr(1), 2) || '}}')) as text, {_UNIQ('canon')} as slots, coalesce(task_type, 'unknown') as task_type, task_type as raw_type, level from named),
p0 as (select unit, i, raw[i] as r, canon[i] as slot, case when (i - 1) % 3 = 0 then raw[i] || ' one, two' when (i - 1) % 3 = 1 then split_part(raw[i], '_', 1) else 'see {{' || raw[i] || '}}' end as value from (select *, unnest(range(1, len(raw) + 1)) as i from named)),
p1 as (select p0.*, t0.raw_type, t0.task_type, not {_BLANK('slot')} and not {_BLANK('value')} and {_IS_SELF('slot', 'value')} as self from p0 join t0 using (unit)),
p2 as (select unit, i, slot as old, case when self then {_goes('slot', 'value', '[raw_type, task_type]')} else slot end as slot, value, raw_type from p1), p3 as (select * from p2 where slot is not null),
moves as (select unit, list(old || chr(1) || slot order by i) as m from p3 where old <> slot group by 1),
t1x as (select unit, list_reduce(list_prepend(text, coalesce(m, [])), lambda acc, q: replace(acc, '{{' || split_part(q, chr(1), 1) || '}}', '{{' || split_part(q, chr(1), 2) || '}}')) as text,
[list_reduce(list_prepend(y, coalesce(m, [])), lambda acc, q: case when acc = split_part(q, chr(1), 1) then split_part(q, chr(1), 2) else acc end) for y in slots] as slots, task_type, {_MAP(V.OLD_LEVELS, 'level', 'level')} as lv from t0 left join moves using (unit)),
tmpl as (select unit, left(md5(task_type || '|' || text), 10) as id, text, slots, task_type, case when list_contains({_LEVELS}, coalesce(lv, 'task_type')) then coalesce(lv, 'task_type') else leaf.level end as level,
list_reduce(list_prepend(text, slots), lambda acc, y: replace(acc, '{{' || y || '}}', '')) as bare from t1x join leaf on leaf.label = task_type),
p4 as (select unit, i, slot, raw_type, unnest(case when slot in ('keyword', 'option', 'completion') and len([x for x in string_split(value, ',') if trim(x) <> '']) >= 2 then [trim(x) for x in string_split(value, ',') if trim(x) <> ''] else [value] end) as value,
generate_subscripts(case when slot in ('keyword', 'option', 'completion') and len([x for x in string_split(value, ',') if trim(x) <> '']) >= 2 then [trim(x) for x in string_split(value, ',') if trim(x) <> ''] else [value] end, 1) as j from p3),
p5 as (select *, row_number() over (partition by unit order by i, j) - 1 as idx from p4 where not regexp_matches(value, '\\{{\\w+\\}}'))"""


def oracle_sql() -> dict[str, str]:
    content = "(select * from (select * from task_options where {w} not {bs} and not {bv} and token_length between 2 and 500 and source_option_id is null and coalesce(source, '') <> 'augmented' qualify row_number() over (partition by id order by option_seq) = 1) where slot in (select slot_name from slot_catalog {l}))"
    seeds = content.format(w="not contains(value, chr(10)) and", bs=_BLANK("slot"), bv=_BLANK("value"), l="where not list_like")
    all_seeds = content.format(w="", bs=_BLANK("slot"), bv=_BLANK("value"), l="")
    head = 'Taxonomy labels: ["law", "sport"]'
    q = {
        "resolve_tasks": f"with {_DOC_VERBS} select task, count(*) as n, list_contains({_LIST([n for n, _, _ in V.LABELS])}, task) as known from tasks where task is not null group by 1 having count(*) >= 15",
        "object_clusters": f"""with {_DOC_VERBS}, often as (select object, count(*) as n, string_agg(distinct canon, ',' order by canon) as verbs from tasks where task is null and object is not null group by 1 order by n desc, object limit 20)
select * from often where n >= 50 and not list_contains({_LIST(sorted(V.GENERIC_OBJECTS))}, object) and not {_FLAG('object', ["|".join(f"(?:{p})" for _, _, ps in V.LABELS for p in ps)])}""",
        "top_categories": """with n as (select source, lower(trim(task_type)) as c, count(*) as n from task_templates where trim(task_type) <> '' group by 1, 2), r as (select *, row_number() over (partition by source order by n desc, c) as r from n)
select source, string_agg(c || '(' || n || ')', ', ' order by r) as categories from r where r <= 20 group by 1""",
        "instruction_datasets": "select label, string_agg(distinct d, ', ' order by d) as datasets from (select label, unnest(discovered_from) as d from taxonomy_leaves) group by 1",
        "label_patterns": "select label, '\\b' || replace(label, '_', '[\\s_]') || '\\b' as pattern from taxonomy_leaves",
        "flat_taxonomy": "select label, min(level) as top from taxonomy_leaves group by 1",
        "taxonomy_description": f"select level, md5('## ' || level || chr(10) || string_agg('  - ' || label || case when {_BLANK('description')} then '' else ': ' || description end, chr(10) order by label)) as text_md5 from taxonomy_leaves where list_contains({_LEVELS}, level) group by 1",
        "inferred_types": f"""with a as (select level, list(distinct label order by label) as ls from taxonomy_leaves group by 1), s as (select slot, {_AXIS(_STRIP('slot'))} as lv from (select distinct slot from task_options where not {_BLANK('slot')})),
r as (select slot, coalesce(ls, case when lv = 'task_type' then (select list(distinct label order by label) from taxonomy_leaves) else [lv] end) as ls from s left join a on a.level = lv) select slot, md5(array_to_string(ls, '|')) as types_md5, len(ls) as n from r""",
        "type_groups": f"with {_GROUPS} select slot, n_values, md5(array_to_string(examples, '|')) as examples_md5, len(examples) as shown from grp",
        "slot_batches": f"""with recursive {_GROUPS}, tok as (select slot, ((len(slot) + list_sum([len(v) + 4 for v in examples]) + 6) // 4)::bigint as tokens, left(md5(slot), 2) as shard from grp),
num as (select *, row_number() over (partition by shard order by slot) as i from tok), walk as (select shard, i, slot, tokens, 0::bigint as batch, tokens as used from num where i = 1
union all select n.shard, n.i, n.slot, n.tokens, case when w.used + n.tokens > 100 then w.batch + 1 else w.batch end, case when w.used + n.tokens > 100 then n.tokens else w.used + n.tokens end from walk w join num n on n.shard = w.shard and n.i = w.i + 1)
select slot, tokens, shard, batch from walk""",
        "option_types": f"with {_TYPES} select name, category, md5(description) as description_md5, array_to_string(compatible_slots, '|') as compatible_slots, md5(array_to_string(example_values, '|')) as examples_md5 from typ",
        "types_by_category": f"with {_TYPES} select category, count(*) as n, string_agg(name, ',' order by name) as names from typ group by 1",
        "type_cross_links": f"""with {_TYPES}, {_vectors('s', "select slot as k, slot || ': ' || array_to_string(list_slice(examples, 1, 8), ', ') as t from grp")},
mem as (select name, unnest(compatible_slots) as slot from typ), cnt as (select name, count(*) as c from mem join grp using (slot) group by 1), mean as (select name, dim, sum(x) / max(c) as x from mem join sv on sv.k = slot join cnt using (name) group by 1, 2),
nrm as (select name, sqrt(sum(x * x)) + 1e-8 as n from mean group by 1), u as (select name, dim, x / n as x from mean join nrm using (name)),
pr as (select a.name as a, b.name as b from u a join u b on a.dim = b.dim and a.name < b.name group by 1, 2 having round(sum(a.x * b.x), 6) >= 0.6),
lk as (select a, list(b order by b) as l from (select a, b from pr union all select b, a from pr) group by 1)
select name, array_to_string({_UNIQ("list_concat(compatible_slots, coalesce(l, []))")}, '|') as compatible_slots from typ left join lk on a = name""",
        "retrieved_types": f"""with {_TYPES}, {_vectors('q', f"select template_seq as k, text as t from task_templates where template_seq % 100 = 0 and not {_BLANK('text')}")},
{_vectors('y', "select name as k, name || ': ' || description || ' Examples: ' || array_to_string(list_slice(example_values, 1, 5), ', ') as t from typ")},
s as (select qv.k as query_id, yv.k as name, round(sum(qv.x * yv.x), 6) as score from qv join yv using (dim) group by 1, 2 having round(sum(qv.x * yv.x), 6) >= 0.000001)
select query_id, name, score, row_number() over (partition by query_id order by score desc, name) as rank from s qualify rank <= 5""",
        "type_context": f"""with {_TYPES}, l as (select category, name, '    ' || name || ' — ' || description || case when len(o) > 0 then ' [also fits: ' || array_to_string(list_slice(o, 1, 5), ', ') || ']' else '' end || ': ' || array_to_string(list_slice(example_values, 1, 6), ', ') as line
from (select *, list_filter(compatible_slots, lambda x: x <> name) as o from typ)) select category, md5('  [' || category || ']' || chr(10) || string_agg(line, chr(10) order by name)) as text_md5 from l group by 1""",
        "slot_contexts": f"with {_T1}, {_CONTEXTS} select id, slot, md5(context) as context_md5 from ctx",
        "compat_index": f"with {_index(0.7)} select id, slot, option_id, score, rank from idx",
        "compat_index_near": f"with {_index(0.35)} select id, slot, option_id, score, rank from idx",
        "tiered_options": f"""with {_index(0.35)}, ts2 as (select t1.id, coalesce(task_type, '') as label, slot from (select id, task_type, unnest(list_distinct(slots)) as slot from t1) t1 where not {_BLANK('slot')}),
ty as (select id, arg_min(option_type, option_seq) as option_type from task_options where option_type is not null group by 1),
map as (select option_type, slot from task_options where option_type = 'card_value' and not {_BLANK('slot')} group by 1, 2 having count(*) <= 2),
fits as (select ts2.id, ts2.slot, o1.id as oid from ts2 join o1 on o1.slot = ts2.slot where list_contains(types, '_universal') or coalesce(list_contains(types, label), false) or list_contains(templates, ts2.id)),
first as (select * from fits union all select ts2.id, ts2.slot, o1.id from ts2 join o1 on o1.slot = ts2.slot where not exists (select 1 from fits f where f.id = ts2.id and f.slot = ts2.slot)),
c1 as (select ts2.id, ts2.slot, count(oid) as n1 from ts2 left join first using (id, slot) group by 1, 2),
second as (select c1.id, c1.slot, o1.id as oid from c1 join map using (slot) join ty using (option_type) join o1 on o1.id = ty.id where n1 < 3 and not exists (select 1 from first f where f.id = c1.id and f.slot = c1.slot and f.oid = o1.id)),
c2 as (select c1.*, case when n1 < 3 then (select count(*) from second s where s.id = c1.id and s.slot = c1.slot) end as n2 from c1),
third as (select c2.id, c2.slot, option_id as oid from c2 join idx using (id, slot) where n1 + n2 < 3 and not exists (select 1 from (select * from first union all select * from second) f where f.id = c2.id and f.slot = c2.slot and f.oid = option_id)),
c3 as (select c2.*, case when n1 + n2 < 3 then (select count(*) from third s where s.id = c2.id and s.slot = c2.slot) end as n3 from c2)
select id, slot, case when n2 is null then 1 when n3 is null then 2 else 3 end as tier, n1, n2, n3 from c3""",
        "id_fixes": f"""with h as (select *, coalesce(list_contains({_LIST(V.CONSTRAINT_RENAMES)}, id), false) as hit from task_templates) select template_seq, coalesce({_MAP(V.LEVEL_FIXES, 'id', 'null')}, level) as level,
coalesce(array_to_string([case when hit and x = 'constraint' then 'format_constraint' else x end for x in slots], '|'), '') as slots, md5(case when hit then replace(text, '{{constraint}}', '{{format_constraint}}') else text end) as text_md5 from h""",
        "template_replacements": f"with {_replaced()} select old_id, kept_id from gone",
        "templates_deduplicated": f"""with {_replaced()}, more as (select kept_id as id, list_distinct(flatten(list(links))) as more from one join gone on old_id = one.id group by 1)
select template_seq, one.id, case when more is null then len(links) else len(list_distinct(list_concat(links, more))) end as n_links from one left join more on more.id = one.id where one.id not in (select old_id from gone)""",
        "option_references": f"""with {_replaced("regexp_replace(lower(text), '[^a-z]+', ' ', 'g')")}, e as (select option_seq, p, coalesce(kept_id, x) as x from (select option_seq, unnest(compatible_templates) as x, generate_subscripts(compatible_templates, 1) as p from task_options) left join gone on old_id = x),
r as (select option_seq, list(x order by p) as xs from e group by 1) select o.option_seq, case when value = 'markdown' and slot = 'text_type' then 'format' else slot end as slot, coalesce(array_to_string({_UNIQ('xs')}, '|'), '') as compatible_templates from task_options o left join r using (option_seq)""",
        "self_replicating": f"""with v as (select option_seq, trim(slot) as slot, case when option_seq % 10 = 0 then upper(trim(slot)) when option_seq % 10 = 5 then 'the ' || upper(trim(slot)) else value end as value, list_filter(coalesce(compatible_task_types, []), lambda x: x is not null) as types from task_options)
select option_seq, {_goes('slot', 'value', 'types')} as new_slot from v where not {_BLANK('slot')} and not {_BLANK('value')} and {_IS_SELF('slot', 'value')}""",
        "valid_templates": f"""with k as (select label, min(level) as lv from taxonomy_leaves group by 1), v as (select template_seq, task_type, {_MAP(V.OLD_LEVELS, 'level', 'level')} as level, lv from task_templates join k on label = task_type)
select template_seq, task_type, case when level is not null and list_contains({_LEVELS}, level) then level else lv end as level from v""",
        "extracted_templates": f"with {_extracted()} select unit, id, md5(text) as text_md5, array_to_string(slots, '|') as slots, task_type, level, {_WORDS('bare')} as token_length from tmpl",
        "extracted_options": f"""with {_extracted()} select p5.unit, idx, left(md5(p5.slot || '|' || value), 10) as id, value, p5.slot, md5(array_to_string(case when leaf.label is not null then [raw_type] else coalesce(axis.labels, [{_AXIS('p5.slot')}]) end, '|')) as types_md5,
case when list_contains(tmpl.slots, p5.slot) then tmpl.id else '' end as compatible_templates, {_WORDS('value')} as token_length from p5 left join leaf on leaf.label = raw_type left join axis on axis.level = {_AXIS('p5.slot')} left join tmpl on tmpl.unit = p5.unit""",
        "bool_replies": "select template_seq, case when template_seq % 6 in (0, 2) then 1 else 0 end as ok from task_templates",
        "augmented_options": f"""with s as {seeds}, f as (select *, regexp_extract({_STRIP('value')}, '^\\S+') as w from s),
v as (select option_seq, s.slot, value as seed, id as sid, compatible_task_types as ty, unnest([upper(value), value || ' again', w, w, '', 'some ' || w]) as value, unnest(['alternative', 'alternative', 'shortened', 'shortened', 'generalized', 'generalized']) as kind, unnest(range(6)) as pos from f s),
u as (select * replace ({_STRIP('value')} as value) from v), ok as (select * from u where value <> '' and lower(value) <> lower({_STRIP('seed')}) qualify row_number() over (partition by option_seq, lower(value) order by pos) = 1)
select option_seq, left(md5(slot || '|' || value), 10) as id, value, slot, kind as tags, sid as source_option_id, {_WORDS('value')} as token_length, len(ty) as n_types from ok""",
        "seed_contexts": f"""with {_T1}, s as {all_seeds}, e as (select option_seq, p, text from (select option_seq, unnest(compatible_templates) as tid, generate_subscripts(compatible_templates, 1) as p from s) join t1 on t1.id = tid),
c as (select option_seq, arg_min(text, p) as c from e group by 1) select option_seq, md5(coalesce(c, '')) as context_md5, md5('Slot: ' || slot || chr(10) || 'Value: ' || value || case when coalesce(c, '') <> '' then chr(10) || 'Template: ' || c else '' end) as message_md5 from s left join c using (option_seq)""",
        "extraction_prompts": f"""with {_G} select id, md5(array_to_string(['system' || chr(10) || {_LIT(_EXTRACT)}, 'user' || chr(10) || {_LIT(head)} || chr(10) || chr(10) || 'Prompt:' || chr(10) || '"Name a city."', 'assistant' || chr(10) || '{{"templates": []}}',
'user' || chr(10) || {_LIT(head)} || chr(10) || chr(10) || 'Known slots: city' || chr(10) || chr(10) || coalesce('[Classified as: ' || task || '; context only, no slot or option.]' || chr(10) || chr(10), '') || 'Prompt:' || chr(10) || '"' || prompt || '"'], chr(10) || chr(10))) as messages_md5 from g where not {_BLANK('prompt')}""",
        "skipped_prompts": f"""with v as (select doc_id as prompt_id, text, {_LIT('## Available taxonomy labels')} || chr(10) || '  - law' || chr(10) || '  - sport' || chr(10) || chr(10) || '## Prompt to segment' || chr(10) || '"' || text || '"' as u from documents where not {_BLANK('text')})
select prompt_id, md5(text) as span_md5, 'description' as label, 'task_type' as level, 'skipped_long' as method from v where {_WORDS('u')} + {len(_SEGMENT.split())} > 1500""",
        "parse_segments": f"""with t as (select *, template_seq % 4 as k from task_templates where not {_BLANK('text')} and level is not null), l as (select label, min(level) as lv from taxonomy_leaves group by 1)
select template_seq as prompt_id, md5(case when k = 3 then 'no answer' else text end) as span_md5, case when k = 3 then 'description' else coalesce(l.label, 'description') end as label, case when k = 3 then 'task_type' else coalesce(lv, 'task_type') end as level,
case when k = 3 then 'llm_failed' when l.label is null then 'llm_invalid' else 'llm' end as method from t left join l on l.label = task_type""",
        "segment_sources": f"""with d as (select * from documents where not {_BLANK('text')}), l as (select text, arg_max(source, doc_id) as source from d group by 1) select doc_id, l.source from d join l using (text) where doc_id % 3 = 0""",
        "store_with_augmented": f"""with p as (select slot, value, left(md5(slot || '|' || value), 10) as id from {_POOL}), b as (select id, slot, value, coalesce(compatible_task_types, []) as a, 0 as x, option_seq as z from task_options where id is not null union all select id, slot, value, ['_universal'], 1, 0 from p),
g as (select id, arg_min(slot, (x, z)) as slot, arg_min(value, (x, z)) as value, flatten(list(a order by x, z)) as l from b group by 1) select id, slot, md5(value) as value_md5, array_to_string({_UNIQ('l')}, '|') as compatible_task_types from g""",
        "slot_lookup": """select template_seq, 'task' as by from task_templates where task_type = 'answer_question' union all select template_seq, 'level' from task_templates where level = 'process_directive'
union all select template_seq, 'slot' from task_templates where list_contains(slots, 'number')""",
        "token_lengths": f"select doc_id, {_WORDS('text')} as n_words, len(coalesce(text, '')) // 4 as n_estimated from documents",
        "sparsity_summary": f"""with {_LABELS}, total as (select count(*) as n from g), c as (select counts.* from counts join leaf on leaf.label = counts.label), m0 as (select (select count(*) from lab join leaf on leaf.label = lab.label) / n as m, n, (select count(*) from leaf) as l from total), m as (select m, m / l as f, n from m0)
select round(m, 4) as mean_active, round(f, 4) as fraction_active, case when f < 0.1 then 'good' when f < 0.2 then 'fair' else 'dense' end as verdict, (select count(*) from c where c.n < 5) as dead, (select count(*) from c where c.n >= 5 and c.n / m.n < 0.01) as rare from m""",
        "source_prompts": f"""with a as (select 'documents' as source, text as prompt from documents where not {_BLANK('text')} order by md5('42|' || text), text limit 200),
b as (select 'prompts' as source, array_to_string(list_filter([task, array_to_string(constraints, chr(10))], lambda x: not {_BLANK('x')}), chr(10)) as prompt from generated_prompts)
select source, md5(prompt) as prompt_md5, count(*) as n from (select * from a union all select * from b) where not {_BLANK('prompt')} group by 1, 2""",
        "saved_store": f"""select 'templates' as what, coalesce({_MAP(V.OLD_LEVELS, 'level', 'level')}, '') as name, count(*) as n from task_templates group by 2 union all select 'options', coalesce(slot, ''), count(*) from task_options group by 2""",
        "saved_augmented": "select id, source_option_id, count(*) as n from task_options where source_option_id is not null or source = 'augmented' group by 1, 2",
        "saved_prompts": f"with {_G} select label, count(*) as n from (select unnest(active_labels) as label from g) where label is not null group by 1 union all select 'all prompts', count(*) from g",
        "saved_segments": f"select source as prompt, count(*) as n, md5(string_agg(text, '|' order by text)) as spans_md5 from task_templates where not {_BLANK('text')} group by 1",
        "saved_few_shots": "select subject as dataset, md5(text) as prompt_md5, case when example_id % 3 > 0 then subject else '' end as task_type from subject_examples",
        "saved_taxonomy": "select level, label_group, label from taxonomy_leaves",
        "saved_types": f"with {_TYPES} select category as of, name, len(example_values) as n from typ",
    }
    parts = oracle_parts()
    count = lambda name, where="true": f"(select count(*) from ({parts[name]}) where {where})"
    rows = {
        "substitution_failures": count("substitution_rates"), "same_type_merges": count("same_type_collisions"), "cross_type_merges": count("cross_type_collisions", "kind = 'merge'"),
        "semantic_collisions": count("cross_type_collisions", "kind <> 'merge'"), "undercovered_slots": count("slot_coverage"), "degenerate_templates": "(select count(*) from task_templates where source = 'ablation_degenerate')",
        "templates_tested": f"(select count(distinct id) + count(distinct case when id is null then 1 end) from task_templates where not {_BLANK('text')})",
        "options_tested": f"(select count(distinct id) + count(distinct case when id is null then 1 end) from task_options where not {_BLANK('slot')} and not {_BLANK('value')})",
    }
    q["validation_report"] = " union all ".join(f"select '{k}' as section, {v} as n" for k, v in rows.items())
    return q


_EXTRACT = "Turn the prompt into reusable templates with {slot} placeholders and the options that filled them. Answer with JSON: templates, options."
_SEGMENT = "Cut the prompt into clauses and give each the label that fits. Answer with JSON: segments (span_text, taxonomy_label, level)."
