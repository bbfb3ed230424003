"""DuckDB equivalents of the registered queries outside the llm part."""

from slotweave.functions import values as V
from slotweave.operators.detect import VERB_OF, VERB_PHRASE

_LIT = lambda s: "'" + s.replace("'", "''") + "'"
_BLANK = lambda c: f"({c} is null or regexp_replace({c}, '\\s+', '', 'g') = '')"
_WORDS = lambda c: f"(case when {c} is null or trim({c}, e' \\t\\n\\r\\f\\x0b') = '' then 0 else len(string_split_regex(trim({c}, e' \\t\\n\\r\\f\\x0b'), '\\s+')) end)"
_MAP = lambda m, c, other: "case " + " ".join(f"when {c} = {_LIT(k)} then {_LIT(v)}" for k, v in m.items()) + f" else {other} end"
_LIST = lambda ws: "[" + ", ".join(map(_LIT, ws)) + "]"
_G = "g as (select * from generated_prompts qualify row_number() over (partition by id order by loaded_at) = 1)"
_FLAG = lambda c, ps: "coalesce(" + " or ".join(f"regexp_matches({c}, {_LIT(p)}, 'i')" for p in ps) + ", false)"
_DETECT = lambda c, labels=V.LABELS: "[" + ", ".join(f"case when {_FLAG(c, ps)} then {_LIT(n)} end" for n, _, ps in labels) + "]"

_CANON = (
    "coalesce("
    + _MAP(V.SLOT_ALIASES, "slot", "null")
    + ", "
    + _MAP({k: v for a, v in V.SINGLE_LETTERS.items() for k, v in ((a, v), (a.upper(), v))} | {}, "slot", "null")
    + r", nullif(regexp_replace(regexp_extract(slot, '^([a-zA-Z][a-zA-Z0-9_]*?)([0-9]+)$', 1), '_+$', ''), '')"
    + ", case when regexp_matches(lower(slot), '^.+(" + "|".join(V.COLLECTION_SUFFIXES) + ")$') then regexp_replace(lower(slot), '(" + "|".join(V.COLLECTION_SUFFIXES) + ")$', '') end)"
)
_PH = lambda c: f"regexp_extract_all({c}, '\\{{(\\w+)\\}}', 1)"
#: The items of a list in order without repeats.
_UNIQ = lambda l: f"list_filter({l}, lambda x, i: list_position({l}, x) = i)"
_T1 = f"t1 as (select * from task_templates where not {_BLANK('text')} qualify row_number() over (partition by id order by template_seq) = 1)"
_O1 = f"o1 as (select id, slot, value, coalesce(compatible_task_types, []) as types, coalesce(compatible_templates, []) as templates from task_options where not {_BLANK('slot')} and not {_BLANK('value')} qualify row_number() over (partition by id order by option_seq) = 1)"
_TS = f"ts as (select id, task_type, slot from (select id, task_type, unnest(list_distinct(slots)) as slot from t1) where not {_BLANK('slot')})"
_COMPAT = f"""{_T1}, {_O1}, {_TS},
total as (select slot, count(*) as in_slot from o1 group by 1),
fit as (select ts.id, ts.slot, count(*) as matched from ts join o1 on o1.slot = ts.slot where list_contains(types, '_universal') or coalesce(list_contains(types, ts.task_type), false) or list_contains(templates, ts.id) group by 1, 2),
compat as (select ts.id, ts.slot, coalesce(matched, 0) as matched, coalesce(in_slot, 0) as in_slot, case when coalesce(matched, 0) > 0 then matched else coalesce(in_slot, 0) end as usable
from ts left join total using (slot) left join fit on fit.id = ts.id and fit.slot = ts.slot)"""
_LABELS = f"""{_G}, sets as (select id, list_distinct([y for y in [lower(regexp_replace(x, '^\\s+|\\s+$', '', 'g')) for x in active_labels] if y is not null and y <> '']) as ls from g),
lab as (select id, unnest(ls) as label from sets),
leaf as (select lower(trim(label)) as label, min(level) as level from taxonomy_leaves group by 1),
counts as (select coalesce(u.label, leaf.label) as label, coalesce(level, 'unknown') as level, coalesce(n, 0) as n from (select label, count(*) as n from lab group by 1) u full join leaf on leaf.label = u.label)"""
_PAIRS = f"""{_LABELS}, total as (select count(*) as n from g), one as (select label, count(*) as k from lab group by 1),
pairs as (select a.label as label_a, b.label as label_b, count(*) as c from lab a join lab b on a.id = b.id and a.label < b.label group by 1, 2),
pmi as (select label_a, label_b, c, round(log2((c / n) / ((x.k / n) * (y.k / n) + 1e-12) + 1e-12), 6) as pmi from pairs join one x on x.label = label_a join one y on y.label = label_b cross join total)"""


def _stats(column: str, name: str) -> str:
    return f"""select '{name}' as measure, count(*) as n, round(avg({column}), 6) as mean, round(stddev_pop({column}), 6) as std, min({column})::bigint as min, max({column})::bigint as max, median({column})::double as median from v where {column} is not null"""


_FILL = f"""{_T1}, first as (select slot, arg_min(value, option_seq) as value from task_options where not {_BLANK('slot')} and not {_BLANK('value')} group by 1),
held as (select id, template_seq, task_type, text, {_UNIQ(_PH('text'))} as held from t1),
vals as (select id, template_seq, task_type, text, held, [coalesce(f.v, '__' || f.s || '__') for f in list(struct_pack(p := p, s := s, v := first.value) order by p)] as vs
from (select id, template_seq, task_type, text, held, unnest(case when len(held) = 0 then [null] else held end) as s, generate_subscripts(case when len(held) = 0 then [null] else held end, 1) as p from held) left join first on first.slot = s group by all),
filled as (select id, template_seq, task_type, held, {{fold}} as filled from vals)"""


def _fill() -> str:
    # The fold is built step by step in nested selects, so that its text does not double with each step.
    steps = _FILL.split("filled as (")[0]
    last = "vals"
    for i in range(1, 7):
        f = f"('{{' || held[{i}] || '}}')"
        steps += f"f{i} as (select * exclude (text), case when len(held) >= {i} and position({f} in text) > 0 then left(text, position({f} in text) - 1) || vs[{i}] || substr(text, position({f} in text) + len({f})) else text end as text from {last}),\n"
        last = f"f{i}"
    return steps + f"filled as (select id, template_seq, task_type, held, text as filled from {last})"


_VERBS = f"""phrases as (select template_seq, i - 1 as pos, lower(v[i]) as verb, lower(regexp_replace(p[i], '^\\s+|\\s+$', '', 'g')) as phrase from (select *, unnest(range(1, len(v) + 1)) as i from
(select template_seq, regexp_extract_all(text, {_LIT('(?i)' + VERB_PHRASE)}, 1) as v, regexp_extract_all(text, {_LIT('(?i)' + VERB_PHRASE)}, 2) as p from task_templates where text is not null))),
named as (select *, {_MAP(VERB_OF, 'verb', 'null')} as canon, list_filter([regexp_replace(w, '[^a-z]', '', 'g') for w in string_split_regex(phrase, '\\s+')], lambda w: len(w) >= 3 and not list_contains({_LIST(sorted(V.ARTICLES | V.SKIPPED_ADJECTIVES | V.STOP_WORDS))}, w))[1] as object from phrases)"""
_FOUND = f"found as (select template_seq, text, list_filter({_DETECT('text')}, lambda x: x is not null) as labels from task_templates)"
_SAFE = lambda c: f"coalesce({c}, '')"


def _constraints() -> str:
    rows = []
    for i, (p, level, label) in enumerate(V.CONSTRAINTS):
        name = _LIT(label) if label else f"regexp_replace(regexp_replace(lower(regexp_extract(text, {_LIT('(?i)' + p)}, 1)), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') || '_format'"
        rows.append(f"select {i} as idx, {_LIT(level)} as level, {name} as label, left(regexp_extract(text, {_LIT('(?i)' + p)}, 0), 200) as snippet from task_templates where regexp_matches(text, {_LIT(p)}, 'i')")
    return " union all ".join(rows)


def _categories() -> str:
    hits = " union all ".join(f"select category, n, {_LIT(v)} as label from c where contains(category, {_LIT(k)})" for k, v in V.CATEGORIES.items())
    return f"""with c as (select lower(trim(task_type)) as category, count(*) as n from task_templates where trim(task_type) <> '' group by 1), h as (select distinct * from ({hits}))
select category, label, n from h union all select category, regexp_replace(regexp_replace(category, '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), n from c where n >= 5 and category not in (select category from h)"""


def _values(rows: list[tuple], names: str) -> str:
    return "(values " + ", ".join("(" + ", ".join(_LIT(x) if isinstance(x, str) else str(x) for x in r) + ")" for r in rows) + f") as v({names})"


_POOL = _values([(s, v) for s, vs in (("keyword", V.KEYWORDS), ("language", V.LANGUAGES), ("end_phrase", V.END_PHRASES), ("letter", V.LETTERS), ("forbidden_word", V.FORBIDDEN_WORDS)) for v in vs], "slot, value")
_NEW = f"new as (select slot, value, left(md5(slot || '|' || value), 10) as id from {_POOL}), fresh as (select * from new where id not in (select id from task_options where id is not null))"
_COMBO = " union all ".join(
    f"""select '{slot}' as slot, i::int as combo, array_to_string(list_slice([w.w for w in list_sort([struct_pack(h := md5('{slot}|' || i || '|' || x), w := x) for x in {_LIST(pool)}])], 1, (('0x' || left(md5('{slot}|size|' || i), 8))::bigint % 3 + 2)::int), ', ') as value from range(20) r(i)"""
    for slot, pool in (("keywords", V.KEYWORDS), ("forbidden_words", V.FORBIDDEN_WORDS))
)
_NUMERIC = _values([(label, task, *r) for label, tasks in V.NUMERIC_RANGES.items() for task, r in tasks.items()], "label, task_type, lo, hi, step")
_DOT = lambda a, b: f"list_sum(list_transform(list_zip({a}, {b}), lambda p: p[1]::double * p[2]::double))"
_MEANS = """m as (select label, i, avg(x::double) as x from (select label, unnest(embedding) as x, generate_subscripts(embedding, 1) as i from embeddings) group by 1, 2),
means as (select label, list(x order by i) as e from m group by 1), unit as (select label, [x / (sqrt(list_sum([y * y for y in e])) + 1e-8) for x in e] as e from means)"""
_SEG = f"""{_G}, seg as (select id as prompt_id, i - 1 as seg_idx, lower(trim(active_labels[i])) as label, active_labels[i] as raw from (select id, active_labels, unnest(range(1, len(active_labels) + 1)) as i from g)),
segs as (select prompt_id, seg_idx, s.label, coalesce(level, 'unknown') as level, s.label || '#' || seg_idx as span_text from seg s left join (select lower(label) as label, min(level) as level from taxonomy_leaves group by 1) l on l.label = s.label where not {_BLANK('raw')})"""
_ABSORB = f"""{_SEG}, x as (select prompt_id, seg_idx, level, span_text, case label when 'explain_concept' then 'explanation' when 'pull_out_facts' then 'information_extraction' else label end as label from segs),
y as (select *, level = 'task_type' as task, level = 'task_type' and label in ('information_extraction', 'description', 'explanation') as context from x),
z as (select *, count(*) filter (where task and not context) over w as n, count(*) filter (where not task) over w = 0 as only_tasks, min(seg_idx) filter (where task and not context) over w as first_real from y window w as (partition by prompt_id)),
a as (select *, case when context and first_real is not null and (not only_tasks or n = 1) then first_real else seg_idx end as into_idx from z)
select prompt_id, into_idx as seg_idx, arg_min(label, abs(seg_idx - into_idx)) as label, arg_min(level, abs(seg_idx - into_idx)) as level,
string_agg(span_text, ' ' order by case when only_tasks then seg_idx when seg_idx = into_idx then -1 else seg_idx end) as span_text from a group by prompt_id, into_idx"""


_NUMBER = lambda k: f"('0x' || left(md5({k}), 8))::bigint"
_STRIP = lambda c: f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"
_CROSS = """x as (select filled, coalesce(task_type, '') as task_type, min(template_seq) as s, arg_min(id, template_seq) as id, arg_min(array_to_string(list_sort(held), '|'), template_seq) as held from filled group by 1, 2),
g as (select filled, arg_min(id, s) as first_id, count(*) as types, count(distinct held) as slot_sets from x group by 1 having count(*) > 1)"""
#: The numbered lists of options that a template's slot draws from.
_POOLS = f"""{_T1}, {_O1}, own as (select * from o1 where not coalesce(list_contains(types, '_universal'), false)),
lists as (select slot, 'a' as l, id, value from o1 union all select slot, 'u', id, value from o1 where list_contains(types, '_universal') union all select slot, 't|' || y, id, value from (select slot, id, value, unnest(list_distinct(types)) as y from own)
union all select e.slot, 'i|' || e.tid, e.id, e.value from (select slot, id, value, types, unnest(list_distinct(templates)) as tid from own) e join t1 on t1.id = e.tid where not coalesce(list_contains(e.types, coalesce(t1.task_type, '')), false)),
pool as (select slot, l, id, value, row_number() over (partition by slot, l order by md5(id)) - 1 as rank, count(*) over (partition by slot, l) as size from lists), sizes as (select slot, l, size from pool where rank = 0)"""
_DRAWN = """need as (select *, coalesce((select size from sizes z where z.slot = asked.slot and l = 'u'), 0) as nu, coalesce((select size from sizes z where z.slot = asked.slot and l = 't|' || label), 0) as nt,
coalesce((select size from sizes z where z.slot = asked.slot and l = 'i|' || template), 0) as ni, coalesce((select size from sizes z where z.slot = asked.slot and l = 'a'), 0) as na from asked),
pick as (select *, case when nu + nt + ni > 0 then h % (nu + nt + ni) when na > 0 then h % na end as r from need),
place as (select *, case when nu + nt + ni = 0 then 'a' when r < nu then 'u' when r < nu + nt then 't|' || label else 'i|' || template end as l, case when nu + nt + ni = 0 or r < nu then r when r < nu + nt then r - nu else r - nu - nt end as rk from pick),
drawn as (select place.*, pool.id as option_id, pool.value from place left join pool on pool.slot = place.slot and pool.l = place.l and pool.rank = place.rk)"""


def _generate(n: int, density: int, least: int, most: int, tries: int) -> str:
    k = lambda *p: _NUMBER(" || '|' || ".join(["'42'", "prompt_no", "try", *p]))
    first = "case when position('{' || q.s || '}' in acc) > 0 then left(acc, position('{' || q.s || '}' in acc) - 1) || q.v || substr(acc, position('{' || q.s || '}' in acc) + len('{' || q.s || '}')) else acc end"
    first = first.replace("q.s", "split_part(q, chr(1), 1)").replace("q.v", "split_part(q, chr(1), 2)")
    words = _WORDS("prompt")
    return f"""with {_POOLS},
rk as (select id, text, coalesce(task_type, '') as label, level, level = 'task_type' as task, list_filter({_UNIQ(_PH('text'))}, lambda x: x <> 'constraints') as held from t1 where level is not null),
num as (select *, row_number() over (partition by task, label order by md5(id)) - 1 as rank, count(*) over (partition by task, label) as size from rk),
shares as (select task, label, max(size) as size, ceil(sqrt(max(size)))::bigint as w from num group by 1, 2), cum as (select *, coalesce(sum(w) over (partition by task order by label rows between unbounded preceding and 1 preceding), 0)::bigint as b from shares),
units as (select task, label, size, unnest(range(b, b + w)) as unit from cum), tot as (select sum(w) filter (where task)::bigint as wt, sum(w) filter (where not task)::bigint as wr from shares),
tries as (select prompt_no, try, wt, wr from (select unnest(range({n})) as prompt_no), (select unnest(range({tries})) as try), tot),
tasks as (select a.prompt_no, a.try, -1 as place, num.id as template, num.label, num.text, num.held from (select prompt_no, try, label, {k("'task'")} % size as rank from tries join units on units.task and unit = prompt_no * wt // {n}) a join num on num.task and num.label = a.label and num.rank = a.rank),
draws as (select prompt_no, try, place, label, {k("'rule'", "place")} % size as rank from (select *, {k("'label'", "place")} % wr as u from tries, (select unnest(range({4 * (density - 1)})) as place)) x join units on not units.task and unit = u),
r1 as (select d.prompt_no, d.try, d.place, num.id as template, num.label, num.text, num.held, num.level from (select * from draws qualify row_number() over (partition by prompt_no, try, label order by place) = 1) d join num on not num.task and num.label = d.label and num.rank = d.rank),
r2 as (select * from r1 qualify row_number() over (partition by prompt_no, try, level order by place) <= 2), r3 as (select * from r2 qualify row_number() over (partition by prompt_no, try order by place) <= {density - 1}),
parts as (select * from tasks union all select * exclude (level) from r3),
asked as (select *, {k("place", "slot")} as h from (select prompt_no, try, place, template, label, unnest(held) as slot, generate_subscripts(held, 1) as p from parts)), {_DRAWN},
fills as (select prompt_no, try, place, list(slot || chr(1) || coalesce(value, case when slot = 'n' then (h % 8 + 3)::varchar else '...' end) order by p) as f, list(option_id order by p) filter (where option_id is not null) as os, list(value order by p) filter (where option_id is not null) as vs from drawn group by 1, 2, 3),
said0 as (select parts.*, coalesce(os, []) as os, coalesce(vs, []) as vs, list_reduce(list_prepend(text, coalesce(f, [])), lambda acc, q: {first}) as x from parts left join fills using (prompt_no, try, place)),
said as (select * exclude (x), case when place >= 0 then {_STRIP("replace(x, '{constraints}', '')")} else x end as said from said0),
g as (select prompt_no, try, max(said) filter (where place = -1) as t, max(template) filter (where place = -1) as task_template_id, max(label) filter (where place = -1) as task,
coalesce(string_agg(said, e'\\n' order by place) filter (where place >= 0 and said <> ''), '') as block, coalesce(list(template order by place) filter (where place >= 0 and said <> ''), []) as cs, coalesce(list(label order by place) filter (where place >= 0), []) as ls,
flatten(list(os order by place) filter (where place = -1 or said <> '')) as os, flatten(list(vs order by place) filter (where place = -1 or said <> '')) as vs, count(*) as density from said group by 1, 2 having max(said) filter (where place = -1) is not null),
done as (select *, {_STRIP("case when contains(t, '{constraints}') then replace(t, '{constraints}', block) when block <> '' then t || e'\\n\\n' || block else t end")} as prompt from g),
kept as (select *, {words} as token_length from done where {words} >= {least} and ({most} = 0 or {words} <= {most}) qualify row_number() over (partition by prompt_no order by try) = 1)
select prompt_no, try, md5(prompt) as prompt_md5, task_template_id, array_to_string(cs, '|') as constraint_template_ids, array_to_string(os, '|') as option_ids, array_to_string(list_prepend(task, ls), '|') as active_labels, array_to_string(ls, '|') as constraints,
task, density, token_length, left(md5(task || '|' || array_to_string(list_sort(ls), '|') || '|' || array_to_string(list_sort(vs), '|')), 12) as combo_id from kept"""


def oracle_parts() -> dict[str, str]:
    q = {
        "load_user_prompts": f"with {_G} select id, len(prompt) as n_chars, {_WORDS('prompt')} as n_words from g where not {_BLANK('prompt')}",
        "cap_per_source": f"select source, doc_id from documents where not {_BLANK('text')} qualify row_number() over (partition by source order by doc_id) <= 20",
        "instruction_text": f"""with {_G}, v as (select id, array_to_string(list_filter([task, coalesce(array_to_string(constraints, e'\\n'), '')], lambda x: not {_BLANK('x')}), e'\\n') as t from g) select id, md5(t) as text_md5 from v""",
        "hashed_sample": "select doc_id from documents order by md5('42|' || doc_id), doc_id limit 100",
        "level_remap": f"select coalesce({_MAP(V.OLD_LEVELS, 'level', 'level')}, '') as level, count(*) as n from task_templates group by 1",
        "detect_labels": f"with {_FOUND} select template_seq, unnest(labels) as label from found",
        "label_prevalence": f"""with found as (select source, list_filter({_DETECT('text')}, lambda x: x is not null) as labels from documents), n as (select source, count(*) as n from documents group by 1),
h as (select source, label, count(*) as hits from (select source, unnest(labels) as label from found) group by 1, 2) select h.source, label, hits, round(hits / n, 4) as prevalence from h join n on n.source = h.source where round(hits / n, 4) >= 0.03""",
        "presence_matrix": "select coalesce(level, '') as level, " + ", ".join(f"max({_FLAG('text', ps)}::int) as {n}" for n, _, ps in V.LABELS) + " from task_templates group by 1",
        "verb_phrases": f"with {_VERBS} select template_seq, pos, verb, canon, md5(phrase) as phrase_md5 from named",
        "constraint_hits": f"with h as ({_constraints()}) select idx, level, label, count(*) as n, min(snippet) as example from h group by 1, 2, 3 having count(*) >= 3",
        "category_map": _categories(),
        "suggest_labels": f"with {_FOUND}, {_VERBS} select template_seq, label, sum(s)::bigint as score from (select template_seq, unnest(labels) as label, 2 as s from found union all select template_seq, canon, 1 from named) group by 1, 2",
        "canonical_slots": f"select slot, {_CANON} as canonical, count(*) as n from task_options where not {_BLANK('slot')} group by 1, 2 having canonical is not null and canonical <> slot",
        "rename_in_templates": f"""with v as (select template_seq, text, list_filter(coalesce(slots, []), lambda x: x is not null) as slots from task_templates)
select template_seq, md5(list_reduce(list_prepend(text, slots), lambda acc, slot: replace(acc, '{{' || slot || '}}', '{{' || coalesce({_CANON}, slot) || '}}'))) as text_md5,
array_to_string({_UNIQ(f"[coalesce({_CANON}, slot) for slot in slots]")}, '|') as slots from v""",
        "placeholder_sync": f"""with v as (select template_seq, {_UNIQ(_PH('text'))} as held, coalesce(slots, []) as slots from task_templates where not {_BLANK('text')})
select template_seq, array_to_string(list_concat(list_filter({_UNIQ('slots')}, lambda x: list_contains(held, x)), list_sort(list_filter(held, lambda x: not list_contains(slots, x)))), '|') as slots from v""",
        "expand_lists": """with v as (select option_seq, value, [trim(p) for p in string_split(value, ',') if trim(p) <> ''] as parts from task_options where lower(slot) in ('keyword_pool', 'keyword'))
select option_seq, unnest(case when len(parts) >= 2 then parts else [value] end) as value from v""",
        "drop_broken": f"select count(*) as kept, count(*) filter (where {_BLANK('value')}) as blank from task_options where not coalesce(regexp_matches(value, '\\{{\\w+\\}}'), false)",
        "repeated_placeholders": f"select template_seq from task_templates where len({_PH('text')}) <> len(list_distinct({_PH('text')}))",
        "dedup_templates": f"""with v as (select text, level, min(template_seq) as template_seq, arg_min(id, template_seq) as id, count(*) as n, list_sort(list_distinct(flatten(list(coalesce(compatible_with, []))))) as l from task_templates where not {_BLANK('text')} group by 1, 2)
select template_seq, id, n, len(l) as n_links, md5(array_to_string(l, '|')) as links_md5 from v""",
        "dedup_options": f"""with v as (select slot, value, min(option_seq) as option_seq, count(*) as n, flatten(list(coalesce(compatible_task_types, []) order by option_seq)) as a, flatten(list(coalesce(compatible_templates, []) order by option_seq)) as b
from task_options where not {_BLANK('slot')} and not {_BLANK('value')} group by 1, 2) select option_seq, n, array_to_string({_UNIQ('a')}, '|') as types, array_to_string({_UNIQ('b')}, '|') as templates from v""",
        "orphan_options": f"""with u as (select distinct unnest(slots) as slot from task_templates) select option_seq, case when {_BLANK('value')} then 'blank value' else 'unused slot' end as why from task_options o
where {_BLANK('value')} or slot is null or not exists (select 1 from u where u.slot = o.slot)""",
        "relink": f"""with p as (select slot, count(distinct id) as k from task_options where not {_BLANK('slot')} and not {_BLANK('value')} group by 1), s as (select template_seq, unnest(list_distinct(slots)) as slot from task_templates),
c as (select template_seq, count(*) as n_slots, coalesce(sum(k), 0)::bigint as n_options, count(*) filter (where k is null) as unfilled from s left join p using (slot) where slot is not null group by 1)
select template_seq, coalesce(n_slots, 0) as n_slots, coalesce(n_options, 0) as n_options, coalesce(unfilled, 0) as unfilled from (select template_seq from task_templates) left join c using (template_seq)""",
        "numbered_slots": """with s as (select distinct template_seq, slot from (select template_seq, unnest(slots) as slot from task_templates) where regexp_matches(slot, '^.+?[0-9]+$')),
b as (select template_seq, slot, regexp_replace(regexp_extract(slot, '^(.+?)([0-9]+)$', 1), '_+$', '') as base from s)
select template_seq, case when base in ('n', '') then 'number_list' when base like '%s' then base else base || '_list' end as merged_slot, string_agg(slot, ',' order by slot) as members from b group by template_seq, base having count(*) >= 2""",
        "normalize_all": f"""with t as (select template_seq, id, level, list_reduce(list_prepend(text, list_filter(coalesce(slots, []), lambda x: x is not null)), lambda acc, slot: replace(acc, '{{' || slot || '}}', '{{' || coalesce({_CANON}, slot) || '}}')) as text from task_templates where not {_BLANK('text')}),
ok as (select * from t where len({_PH('text')}) = len(list_distinct({_PH('text')}))), used as (select distinct unnest({_PH('text')}) as slot from ok),
o as (select coalesce({_CANON}, slot) as slot, value from task_options), e as (select slot, unnest(case when slot in ('keyword', 'option', 'completion') and len([p for p in string_split(value, ',') if trim(p) <> '']) >= 2 then [trim(p) for p in string_split(value, ',') if trim(p) <> ''] else [value] end) as value from o),
k as (select slot, value, count(*) as n from e where not {_BLANK('slot')} and not {_BLANK('value')} and not regexp_matches(value, '\\{{\\w+\\}}') and slot in (select slot from used) group by 1, 2),
m as (select text, level, count(*) as n from ok group by 1, 2)
select 'templates' as kind, count(*) as n, sum(n)::bigint as copies from m union all select 'options', count(*), sum(n)::bigint from k""",
        "substitution_rates": f"""with {_POOLS}, c as (select id as template, task_type as label, text, {_UNIQ(_PH('text'))} as held from t1 where level = 'task_type' and trim(task_type) <> ''),
asked as (select *, {_NUMBER("template || '|' || k || '|' || slot")} as h from (select template, label, unnest(held) as slot, generate_subscripts(held, 1) as p from c), (select unnest(range(1, 6)) as k)), {_DRAWN},
f as (select template, k, list(struct_pack(p := p, s := slot, v := coalesce(value, slot)) order by p) as ps from drawn group by 1, 2),
d as (select template, {_FLAG("list_reduce(list_prepend(text, list_transform(ps, lambda q: q.s || chr(1) || q.v)), lambda acc, q: replace(acc, '{' || split_part(q, chr(1), 1) || '}', split_part(q, chr(1), 2)))", ["|".join(f"(?:{p})" for _, level, ps in V.LABELS if level == 'task_type' for p in ps)])}::int as ok from f join c using (template))
select template as id, sum(ok)::bigint as ok, round(1 - sum(ok) / 5, 2) as fail_rate from d group by 1 having 1 - sum(ok) / 5 > 0.4""",
        "generate_parallel": _generate(2000, 3, 0, 0, 1),
        "generate_window": _generate(1000, 4, 20, 60, 3),
        "content_ids": "select 'template' as kind, template_seq as seq, left(md5(task_type || '|' || text), 10) as new_id from task_templates union all select 'option', option_seq, left(md5(slot || '|' || value), 10) from task_options",
        "few_shot_fixes": """select template_seq, case when contains(replace(text, '{n}', '{number}'), 'and in all capital letters') or contains(replace(text, '{n}', '{number}'), 'should appear {number} or more times in your response') or contains(text, 'Include {metric} in {unit}.') then 'format_constraint' else level end as level,
array_to_string([case when x = 'n' then 'number' else x end for x in slots], '|') as slots, md5(replace(text, '{n}', '{number}')) as text_md5 from task_templates""",
        "inferred_levels": f"select case {' '.join(f'when regexp_matches(lower(slot), {_LIT("|".join(ks))}) then {_LIT(l)}' for l, ks in V.LEVEL_KEYWORDS.items())} else 'task_type' end as level, count(*) as n, count(distinct slot) as slots from task_options where not {_BLANK('slot')} group by 1",
        "store_summary": """select 'templates' as what, '' as name, count(*) as n from task_templates union all select 'options', '', count(*) from task_options union all select 'multi_type_options', '', count(*) from task_options where len(compatible_task_types) > 1
union all select 'level', coalesce(level, ''), count(*) from task_templates group by 2 union all select 'slot', coalesce(slot, ''), count(*) from task_options group by 2""",
        "compatible_options": f"with {_COMPAT} select id, slot, matched, in_slot, usable from compat",
        "undercovered_templates": f"with {_T1}, {_O1}, {_TS}, v as (select slot, count(distinct value) as v from o1 group by 1) select id, count(*) as n_slots from ts left join v using (slot) group by 1 having max(coalesce(v, 0)) <= 1",
        "reusable_filter": f"""with {_T1}, v as (select id, regexp_replace(text, '\\{{\\w+\\}}', '', 'g') as f, len(list_distinct({_PH('text')})) as n_slots from t1), w as (select id, {_WORDS('f')} as framing, n_slots from v)
select id, framing::int as framing, n_slots::int as n_slots, (not ((framing = 0 and n_slots = 1) or framing > 20))::int as kept from w""",
        "slot_coverage": f"""with {_T1}, {_O1}, {_TS}, a as (select slot, task_type, count(*) as a from (select slot, unnest(list_distinct(types)) as task_type from o1) group by 1, 2), b as (select slot, count(*) as b from o1 group by 1)
select id, slot, coalesce(a, b, 0) as usable from ts left join a using (slot, task_type) left join b using (slot) where coalesce(a, b, 0) < 3""",
        "first_fill": f"with {_fill()} select id, md5(filled) as filled_md5 from filled",
        "same_type_collisions": f"""with {_fill()}, f as (select filled, task_type, arg_min(id, template_seq) as first_id from filled group by 1, 2 having count(*) > 1)
select first_id, id as other_id from filled m join f on f.filled = m.filled and f.task_type is not distinct from m.task_type where id <> first_id""",
        "cross_type_collisions": f"""with {_fill()}, {_CROSS} select first_id, types, slot_sets, case when slot_sets = 1 then 'merge' else 'semantic collision' end as kind from g""",
        "semantic_collisions": f"""with {_fill()}, {_CROSS} select first_id, id, task_type, held as slots from x join g using (filled) where slot_sets > 1""",
        "cosine_topk": f"""select query_id, vec_id, score, rank from (select a.vec_id as query_id, b.vec_id, round({_DOT('a.embedding', 'b.embedding')}, 6) as score, row_number() over (partition by a.vec_id order by round({_DOT('a.embedding', 'b.embedding')}, 6) desc, b.vec_id)::int as rank
from embeddings a join embeddings b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0 and {_DOT('a.embedding', 'b.embedding')} >= 0.3) where rank <= 10""",
        "type_means": f"with {_MEANS} select label, generate_subscripts(e, 1) - 1 as i, round(unnest(e), 5) as x from unit",
        "augment_numeric": f"select label, task_type, unnest(range(lo, hi + 1, step))::varchar as value, 'number' as slot from {_NUMERIC}",
        "augment_pools": f"with {_NEW} select slot, value, id from fresh",
        "augment_combos": _COMBO,
        "seed_selection": f"""with o as (select * from (select * from task_options where not {_BLANK('slot')} and not {_BLANK('value')} and token_length between 2 and 500 and source_option_id is null and coalesce(source, '') <> 'augmented' qualify row_number() over (partition by id order by option_seq) = 1)
where slot in (select slot_name from slot_catalog where not list_like)), n as (select count(*) as a, count(distinct slot) as s from o), r as (select *, row_number() over (partition by slot order by md5(id)) as r from o)
select option_seq, id, slot, value from r, n where a <= 500 or r <= greatest(1, floor(500 / s))""",
        "merge_augmented": f"with {_NEW} select slot, count(*) as n from (select slot from task_options union all select slot from fresh) where not {_BLANK('slot')} group by 1",
        "token_window": f"with {_G} select id from g where {_WORDS('prompt')} between 20 and 200",
        "feasible_density": f"""with {_COMPAT} select id, round(case when min(usable) > 0 then sum(log10(greatest(usable, 1))) end, 6) as feasible_log10, round(case when min(in_slot) > 0 then sum(log10(greatest(in_slot, 1))) end, 6) as full_log10 from compat group by 1""",
        "density_stats": f"with {_G}, v as (select coalesce(density, len(coalesce(active_labels, []))) as d from g) {_stats('d', 'density')}",
        "density_histogram": f"with {_G} select coalesce(density, len(coalesce(active_labels, [])))::int as density, count(*) as n from g group by 1",
        "length_stats": f"with {_G}, v as (select coalesce(token_length, {_WORDS('prompt')}) as l from g) {_stats('l', 'length')}",
        "label_frequency": f"with {_LABELS} select label, level, n from counts",
        "label_balance": f"""with {_LABELS}, c as (select * from counts where n > 0), t as (select level, sum(n)::bigint as total, count(*) as labels, avg(n) as m, stddev_pop(n) as s from c group by 1),
h as (select c.level, sum(-(n / total) * log2(n / total + 1e-12)) as h from c join t on t.level = c.level group by 1)
select t.level, labels, total, round(case when labels = 1 then 0 else s / m end, 6) as cv, round(case when labels = 1 then 1 else h / log2(labels) end, 6) as entropy from t join h on h.level = t.level""",
        "never_sampled": f"with {_LABELS} select label, level from counts where n = 0",
        "cooccurrence": f"with {_PAIRS} select label_a, label_b, c, pmi from pmi",
        "pmi": f"with {_PAIRS} select label_a, label_b, c, pmi from pmi where c >= 3 order by pmi desc, label_a, label_b limit 30",
        "level_cooccurrence": f"""with {_LABELS}, x as (select id, lab.label, coalesce(level, 'unknown') as level from lab left join leaf on leaf.label = lab.label)
select a.level as level_a, b.level as level_b, count(*) as n from x a join x b on a.id = b.id and a.label <> b.label group by 1, 2""",
        "combo_coverage": f"""with {_LABELS}, d as (select coalesce(density, len(coalesce(active_labels, [])))::int as density, count(*) as n from g group by 1), m as (select density as md from d order by n desc, density limit 1),
ax as (select count(*) filter (where level = 'task_type') as t, count(*) filter (where level <> 'task_type') as c from taxonomy_leaves),
b as (select t * round(coalesce(list_reduce(list_prepend(1.0::double, [(c - (md - 1) + i)::double / i for i in range(1, md)]), lambda x, y: x * y), 1.0)) as bound, md from ax, m),
k as (select (select count(distinct combo_id) from g) as combos, (select count(distinct array_to_string(list_sort(ls), '|')) from sets where len(ls) > 0) as label_sets)
select combos, label_sets, md as modal_density, bound, round(case when bound = 0 then 1 else label_sets / bound end, 8) as ratio from b, k""",
        "dead_rare": f"with {_LABELS} select label, round(n / (select count(*) from g), 6) as share, case when n < 5 then 'dead' when n / (select count(*) from g) < 0.01 then 'rare' else 'fine' end as verdict from counts",
        "merge_adjacent": f"""with {_SEG}, r as (select prompt_id, seg_idx, level as label, span_text, case when level is not distinct from lag(level) over w and lag(seg_idx) over w is not null then 0 else 1 end as new from segs window w as (partition by prompt_id order by seg_idx)),
k as (select *, sum(new) over (partition by prompt_id order by seg_idx) as run from r) select prompt_id, min(seg_idx) as seg_idx, arg_min(label, seg_idx) as label, string_agg(span_text, ' ' order by seg_idx) as span_text from k group by prompt_id, run""",
        "absorb_context": f"with {_ABSORB}",
    }
    return q


def oracle_sql() -> dict[str, str]:
    from slotweave.plans import pipeline_sql

    return oracle_parts() | pipeline_sql.oracle_sql()
