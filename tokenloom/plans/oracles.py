"""DuckDB SQL for the registered queries, over the same tables and written apart from the operators."""

from __future__ import annotations

from tokenloom import model as m
from tokenloom.plans import synth as s

WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
CSS, TS = m.CSS_VARIABLE, m.TS_COLOR.replace("'", "''")
TRUTH = "figma"
NAMES = "case source_ord when 0 then 'codebase' when 1 then 'figma' else 'storybook' end"


def _matches(files: str, pattern: str) -> str:
    """file, number, name, value, line of every match: marked, split there, newlines summed up."""
    return f"""marked as (select file, string_split(regexp_replace(content, '({pattern})', chr(1) || '\\1', 'g'), chr(1)) as chunks from ({files})),
pieces as (select file, unnest(chunks) as piece, generate_subscripts(chunks, 1) - 1 as number from marked),
lined as (select *, 1 + coalesce(sum(length(piece) - length(replace(piece, chr(10), ''))) over (partition by file order by number rows between unbounded preceding and 1 preceding), 0) as line from pieces),
found as (select file, number, regexp_extract(piece, '^{pattern}', 1) as name, trim(regexp_extract(piece, '^{pattern}', 2), {WS}) as value, cast(line as int) as line from lined where number > 0)"""


CSS_FOUND = _matches(s.css_files("duckdb"), CSS)
TS_FOUND = _matches(s.ts_files("duckdb"), TS)
_any = lambda c, words: "(" + " or ".join(f"contains({c}, '{w}')" for w in words) + ")"
CATEGORY = f"""case when {" or ".join(f"starts_with(value, '{p}')" for p in m.COLOR_VALUE_PREFIXES)} or {_any("name", m.COLOR_WORDS)} then 'colors'
 when {_any("name", m.SPACING_WORDS)} then 'spacing' when {_any("name", m.TYPOGRAPHY_WORDS)} then 'typography'
 when {_any("name", m.RADIUS_WORDS)} then 'borderRadius' when {_any("name", m.SHADOW_WORDS)} then 'shadows' else 'other' end"""
ALIAS = f"regexp_matches(value, '{m.ALIAS}')"

ORACLES: dict[str, str] = {}
ORACLES["css_tokens"] = f"with {CSS_FOUND} select file, name, value from found where not {ALIAS}"
ORACLES["css_token_lines"] = f"with {CSS_FOUND} select file, name, line from found where not {ALIAS}"
ORACLES["css_alias_skip"] = f"with {CSS_FOUND} select file, cast(count(*) filter (where {ALIAS}) as bigint) as n_alias, count(*) as n_all from found group by file"
ORACLES["ts_color_tokens"] = f"with {TS_FOUND} select file, name, value, line from found"
ORACLES["categorize_css"] = f"with {CSS_FOUND} select {CATEGORY} as category, count(*) as n, count(distinct name) as n_names from found where not {ALIAS} group by 1"
ORACLES["px_values"] = f"""with {CSS_FOUND} select name, value, cast(regexp_extract(value, '^(\\d+(\\.\\d+)?)px$', 1) as double) as px from found where regexp_matches(value, '^(\\d+(\\.\\d+)?)px$')"""
ORACLES["css_last_wins"] = f"""with {CSS_FOUND}, named as (select *, {CATEGORY} as category from found where not {ALIAS})
select category, name, last(value order by file, number) as value, last(file order by file, number) as file, last(line order by file, number) as line, first(file order by file, number) as first_file from named group by 1, 2"""
ORACLES["ts_first_wins"] = f"with {TS_FOUND} select 'colors' as category, name, first(value order by file, number) as value, first(file order by file, number) as file, first(line order by file, number) as line from found group by 2"
ORACLES["distinct_radius"] = f"with {CSS_FOUND} select file, count(distinct value) as n_values, string_agg(distinct value, '|' order by value) as radius_values from found where {CATEGORY} = 'borderRadius' group by file"
_MIXED = f"""writes as (select 'css' as kind, 0 as pattern, 'm/' || replace(p_brand, '#', '-') || '-' || {s.BLOCK} || '.css' as file, p_partkey, {s.MIXED_NAME} as name, '#' || {s.HEX6} as value,
 1 + row_number() over (partition by p_brand, {s.BLOCK} order by p_partkey) as line from part where p_partkey % 3 = 0
 union all select 'ts', 1, 'm/' || lower(p_type) || '-' || {s.BLOCK} || '.ts', p_partkey, {s.MIXED_NAME}, '#' || {s.HEX6}, 1 + row_number() over (partition by p_type, {s.BLOCK} order by p_partkey) from part where p_partkey % 3 <> 0),
ranked as (select *, row_number() over (order by pattern, file, line) as nth from writes)"""
ORACLES["mixed_fold"] = f"""with {_MIXED}, won as (select name, coalesce(max(case when kind = 'css' then nth end), min(nth)) as best, min(nth) as first from ranked group by name)
select 'colors' as category, w.name, r.value, r.file, cast(r.line as int) as line, f.file as first_file from won w join ranked r on r.nth = w.best join ranked f on f.nth = w.first"""
ORACLES["glob_files"] = f"""with paths as ({s.PATHS}), kept as (select file from paths where not starts_with(file, 'node_modules/') and not starts_with(file, 'dist/') and not contains(file, '.test.') and not starts_with(file, '.') and not contains(file, '/.'))
select 0 as pattern, file from kept where suffix(file, '.css') union all select 1, file from kept where starts_with(file, 'src/') and not contains(substr(file, 5), '/') and (suffix(file, '.ts') or suffix(file, '.tsx'))
union all select 2, file from kept where starts_with(file, 'src/') and suffix(file, '.ts') union all select 3, file from kept where regexp_matches(file, '^lib/[a-m][^/]*[.]ts$')"""
_TSX = s.tsx_files("duckdb")
_EXPORT = m.COMPONENT_EXPORT
_BASE = "regexp_replace(regexp_extract(file, '([^/]*)$', 1), '\\.[^.]*$', '')"
ORACLES["component_names"] = f"""select file, case when regexp_matches(content, '{_EXPORT}') then regexp_extract(content, '{_EXPORT}', 1) else {_BASE} end as name,
 case when regexp_matches(content, '{_EXPORT}') then cast(1 + length(split_part(content, 'export', 1)) - length(replace(split_part(content, 'export', 1), chr(10), '')) as int) else 1 end as line
 from ({_TSX}) where regexp_matches(content, '{_EXPORT}') or left({_BASE}, 1) = upper(left({_BASE}, 1))"""
ORACLES["component_last_wins"] = f"select name, max(file) as file, max_by(line, file) as line, min(file) as first_file from ({ORACLES['component_names']}) as named group by name"
ORACLES["component_props"] = f"""with bodies as (select file, regexp_extract(content, '{m.PROPS_BODY}', 1) as body from ({_TSX})),
lists as (select file, regexp_extract_all(body, '{m.PROP}', 1) as n, regexp_extract_all(body, '{m.PROP}', 2) as o, regexp_extract_all(body, '{m.PROP}', 3) as t from bodies),
rows as (select file, unnest(n) as prop, unnest(o) as mark, unnest(t) as kind from lists)
select file, prop, trim(kind, {WS}) as kind, coalesce(mark, '') = '' as required from rows"""

_V = f"""vars as (select p_partkey, p_size, p_name, {s.BLOCK} as blk, lower(replace(regexp_replace({s.VARIABLE_NAME}, '\\s+', '-', 'g'), '/', '-')) as name, {s.VARIABLE_TYPE} as kind from part
 where p_partkey % 11 <> 0 and p_size % 3 < 2 and p_size % 13 <> 0 and p_size % 17 <> 0),
valued as (select *, case kind when 'COLOR' then '#' || lower(lpad(hex(cast(floor(cast('0.' || (p_size % 10) as double) * 255 + 0.5) as bigint)), 2, '0')) || lower(lpad(hex(cast(floor(cast('0.' || (p_partkey % 10) as double) * 255 + 0.5) as bigint)), 2, '0')) || 'ff' || case when p_size % 2 = 0 then '80' else '' end
 when 'FLOAT' then {s.FLOAT_TEXT} || 'px' when 'STRING' then case when p_size % 7 = 0 then '' else p_name end end as value,
 case kind when 'COLOR' then 'colors' when 'STRING' then 'typography' else case when contains(name, 'radius') then 'borderRadius' when contains(name, 'font') then 'typography' else 'spacing' end end as category from vars),
usable as (select *, 'V' || p_partkey as id, case when p_size % 3 = 0 then 'Base' else 'Dark' end as collection from valued where value <> '')"""
ORACLES["figma_hex"] = f"with {_V} select id, value from usable where kind = 'COLOR'"
ORACLES["figma_names"] = f"with {_V} select id, name, category from usable"
ORACLES["figma_tokens"] = f"with {_V} select category, name, max_by(value, p_partkey) as value, max_by(id, p_partkey) as variable_id, max_by(collection, p_partkey) as collection from usable group by 1, 2"
ORACLES["figma_components"] = f"select {s.PASCAL} || {s.BLOCK} as name, 'n' || max(p_partkey) as node_id, 'k' || max(p_partkey) as component_key from part where p_partkey % 9 <> 0 group by 1"
_S = f"""entries as (select p_partkey, {s.STORY_TITLE} as title, case when p_partkey % 5 = 0 then '' else p_brand end as name, case when p_partkey % 3 = 0 then '' else './' || p_partkey || '.tsx' end as path from part where p_partkey % 7 <> 0 and p_partkey % 19 <> 0),
titles as (select title, coalesce(string_agg(name, '|' order by p_partkey) filter (where name <> ''), '') as variants, string_agg('s' || p_partkey, '|' order by p_partkey) as story_ids, coalesce(min_by(path, p_partkey) filter (where path <> ''), '') as file, min(p_partkey) as first, split_part(title, '/', -1) as name from entries group by title)"""
ORACLES["story_groups"] = f"with {_S} select title, name, variants, story_ids, file from titles"
ORACLES["story_components"] = f"with {_S} select name, max_by(title, first) as title, max_by(file, first) as file, max_by(variants, first) as variants from titles group by name"

ORACLES["manifest_keys"] = f"""select p_brand || '-' || {s.BLOCK} as doc, count(*) as n, count(distinct {s.STORY_TITLE}) as n_titles from part
 where cast(replace(p_brand, 'Brand#', '') as int) % 3 <> 1 and p_partkey % 7 <> 0 and p_partkey % 19 <> 0 group by 1"""

_R = f"""tok as ({s.SOURCE_TOKENS}),
base as (select category, name, min_by(value, source_ord) as base, min(source_ord) as base_ord, count(*) as n_sources, min(case when source_ord = 1 then value end) as ours from tok group by 1, 2),
differ as (select t.*, b.base, b.base_ord from tok t join base b using (category, name) where t.value <> b.base)"""
ORACLES["reconcile_tokens"] = f"""with {_R} select b.category, b.name, case when ours <> base then ours else base end as value,
 case when ours <> base then 'figma' else case base_ord when 0 then 'codebase' when 1 then 'figma' else 'storybook' end end as source, cast(n_sources as int) as n_sources,
 exists (select 1 from differ d where d.category = b.category and d.name = b.name) as conflict from base b"""
_CONFLICT = f"""{_R}, entries as (select category, name, base_ord as source_ord, base as value from differ group by all union all select category, name, source_ord, value from differ),
conflicts as (select category || '.' || name as name, string_agg({NAMES} || '=' || value, '|' order by source_ord) as entries, bool_or(source_ord = 1) as actionable,
 max(case when source_ord = 1 then value end) as winner, string_agg('''' || {NAMES} || '''', ', ' order by source_ord) filter (where source_ord <> 1) as losers,
 string_agg({NAMES} || ': ''' || value || '''', ', ' order by source_ord) as listed from entries group by category, entries.name)"""
ORACLES["token_conflicts"] = f"with {_CONFLICT} select name, entries, actionable from conflicts"
ORACLES["fix_messages"] = f"""with {_CONFLICT} select name, case when actionable then 'Sources disagree on token ''' || name || '''. The source of truth is ''figma'' with value ''' || winner || '''. Change ' || losers || ' to it, or name another source of truth in the configuration.'
 else 'Sources disagree on token ''' || name || ''' (' || listed || '). None of them is the source of truth: name one in the configuration.' end as fix from conflicts"""
_C = f"comp as ({s.SOURCE_COMPONENTS})"
ORACLES["reconcile_components"] = f"""with {_C} select name, case when count(*) filter (where source_ord = 1) > 0 then 'figma' else case min(source_ord) when 0 then 'codebase' else 'storybook' end end as adapter,
 case when count(*) filter (where source_ord = 1) > 0 then null else min_by(file, source_ord) end as file, count(*) as n_sources from comp group by name"""
ORACLES["component_conflicts"] = f"""with {_C}, shown as (select *, coalesce(file, {NAMES}) as shown, {NAMES} as adapter from comp),
pairs as (select b.name, b.source_ord as new_ord, case when b.source_ord = 2 and o.source_ord is not null then 1 else f.source_ord end as held_ord from shown b
 join (select name, min(source_ord) as source_ord from comp group by name) f on f.name = b.name and f.source_ord < b.source_ord
 left join shown o on o.name = b.name and o.source_ord = 1)
select p.name, h.adapter || '=' || h.shown as held, n.adapter || '=' || n.shown as new, (h.source_ord = 1 or n.source_ord = 1) as actionable
from pairs p join shown h on h.name = p.name and h.source_ord = p.held_ord join shown n on n.name = p.name and n.source_ord = p.new_ord"""

_P = f"tok as ({s.PROJECT_TOKENS}), ranked as (select *, case category when 'colors' then 0 when 'spacing' then 1 when 'typography' then 2 when 'borderRadius' then 3 when 'shadows' then 4 else 5 end as rank from tok)"
_PX = "cast(nullif(regexp_extract(value, '^(\\d+(\\.\\d+)?)px$', 1), '') as double)"
_first_n = lambda shown, n, where: f"array_to_string(list_slice(list({shown} order by rank, first) filter (where {where}), 1, {n}), '|')"
ORACLES["rule_spacing"] = f"""with {_P}, px as (select *, {_PX} as v from ranked where category = 'spacing'),
facts as (select project, count(v) as n, bool_and(v % 4 = 0) as by4, string_agg(name || ': ' || value, '|' order by first) filter (where v is not null) as shown from px group by project),
steps as (select project, v - lag(v) over (partition by project order by v) as step, v from px where v is not null),
even as (select project, count(*) as n, count(distinct step) as k, min(step) as step, string_agg(cast(cast(v as bigint) as varchar) || 'px', '|' order by v) as shown from steps group by project)
select project, 'spacing-4px-base' as id, 'high' as confidence, 'All spacing values are multiples of 4px.' as rule, shown as evidence from facts where n >= 2 and by4
union all select project, 'spacing-linear-scale', 'medium', 'Spacing grows evenly, by ' || cast(step as bigint) || 'px a step.', shown from even where n >= 3 and k = 1"""
ORACLES["rule_linear"] = f"""with {_P}, px as (select project, {_PX} as v from ranked where category = 'spacing' and {_PX} is not null), steps as (select project, v - lag(v) over (partition by project order by v) as step from px)
select project, count(*) as n, count(distinct step) as n_steps, count(*) >= 3 and count(distinct step) = 1 as reported from steps group by project"""
_sem, _des = _any("lower(name)", m.SEMANTIC_WORDS), _any("lower(name)", m.DESCRIPTIVE_WORDS)
ORACLES["rule_color"] = f"""with {_P}, c as (select * from ranked where category = 'colors'),
facts as (select project, count(*) filter (where {_sem}) as sem, count(*) filter (where {_des}) as des, count(*) filter (where contains(name, 'hover')) as hover, count(*) filter (where not {_any("name", m.STATE_WORDS)}) as base, count(*) filter (where contains(name, 'dark')) as dark,
 {_first_n("name", 5, _sem)} as sem5, {_first_n("name", 3, "contains(name, 'hover')")} as hover3, {_first_n("name", 3, "contains(name, 'dark')")} as dark3 from c group by project)
select project, 'color-semantic-naming' as id, 'high' as confidence, sem5 as evidence from facts where sem > des
union all select project, 'color-interactive-variants', 'high', hover3 from facts where hover > 0 and case when base = 0 then true else hover / base > 0.3 end
union all select project, 'color-dark-mode-tokens', 'medium', dark3 from facts where dark > 2"""
ORACLES["rule_radius"] = f"""with {_P}, facts as (select project, count(distinct value) as k, count({_PX}) as px, count(*) as n, min(value) as value, string_agg(name || ': ' || value, '|' order by first) as shown from ranked where category = 'borderRadius' group by project)
select project, 'border-radius-uniform' as id, 'There is one border radius: ' || value || '.' as rule, shown as evidence from facts where k = 1
union all select project, 'border-radius-scale', 'Border radius has a scale of ' || n || ' steps.', shown from facts where k > 1 and px >= 3"""
ORACLES["rule_typography"] = f"""with {_P}, f as (select *, contains(name, 'mono') or contains(lower(value), 'mono') as mono from ranked where category = 'typography' and contains(name, 'font') and not contains(name, 'size') and not contains(name, 'weight')),
facts as (select project, count(*) as n, count(*) filter (where mono) as monos, min(value) as value, string_agg(name || ': ' || value, '|' order by first) as shown, string_agg(name || ': ' || value, '|' order by first) filter (where mono) as mono_shown from f group by project)
select project, 'typography-mono-for-code' as id, mono_shown as evidence from facts where monos > 0 union all select project, 'typography-single-typeface', shown from facts where n = 1"""
_NAMING = f"""{_P}, facts as (select project, count(*) as n, count(*) filter (where contains(name, '-')) as kebab, count(*) filter (where regexp_matches(name, '[a-z][A-Z]')) as camel, count(*) filter (where contains(name, '_')) as snake,
 {_first_n("name", 4, "true")} as first4, count(*) filter (where split_part(name, '-', 1) in ({", ".join(f"'{w}'" for w in m.PREFIX_WORDS)})) as prefixed,
 {_first_n("name", 4, "split_part(name, '-', 1) in (" + ", ".join(f"'{w}'" for w in m.PREFIX_EVIDENCE_WORDS) + ")")} as prefix4 from ranked group by project)"""
ORACLES["rule_naming"] = f"""with {_NAMING} select project, 'naming-kebab-case' as id, first4 as evidence from facts where kebab = greatest(kebab, camel, snake) and kebab / n > 0.7
union all select project, 'naming-camel-case', first4 from facts where not (kebab = greatest(kebab, camel, snake) and kebab / n > 0.7) and camel = greatest(kebab, camel, snake) and camel / n > 0.7"""
ORACLES["rule_prefix"] = f"with {_NAMING} select project, 'naming-category-prefix' as id, prefix4 as evidence from facts where prefixed / n > 0.6"
_COMP = f"""comp as ({s.PROJECT_COMPONENTS}), facts as (select project, count(*) as n, {", ".join(f"count(*) filter (where has_{p}) as {p}, array_to_string(list_slice(list(name order by first) filter (where has_{p}), 1, 4), '|') as {p}4" for p in ("variant", "size", "disabled"))} from comp group by project)"""
ORACLES["rule_components"] = f"with {_COMP} " + " union all ".join(f"select project, 'components-{p}-prop' as id, {p}4 as evidence from facts where n >= 3 and {p} / n > {t}" for p, t in (("variant", 0.4), ("size", 0.3), ("disabled", 0.5)))
_IDS = {"rule_spacing": "spacing", "rule_color": "color", "rule_radius": "border-radius", "rule_typography": "typography", "rule_naming": "naming", "rule_prefix": "naming", "rule_components": "components"}
ORACLES["inferred_rules"] = " union all ".join(f"select project, id, '{c}' as category from ({ORACLES[q]}) as {q}_rows" for q, c in _IDS.items())
ORACLES["rules_filter"] = f"select project, id from ({ORACLES['rule_color']}) as color_rows"

ORACLES["category_counts"] = f"with {_R}, known as (select unnest(['colors', 'spacing', 'typography', 'borderRadius', 'shadows']) as category union select category from base) select category, count(name) as n_tokens from known left join base using (category) group by category"
ORACLES["summary_counts"] = f"""with {_R}, {_C} select (select count(*) from base) as n_tokens, (select count(distinct name) from comp) as n_components,
 (select count(*) from (select distinct category, name from differ)) as n_token_conflicts, (select count(*) from comp) - (select count(distinct name) from comp) as n_component_conflicts"""
ORACLES["token_lookup"] = f"""with {_R}, won as (select category, name, case when ours <> base then ours else base end as value from base where name = 'blue-0')
select category, name, value from won order by case category when 'colors' then 0 when 'spacing' then 1 when 'typography' then 2 when 'borderRadius' then 3 when 'shadows' then 4 else 5 end limit 1"""
ORACLES["component_lookup"] = f"select * from ({ORACLES['reconcile_components']}) as won where name = 'BlueBolt0'"
_ALL = f"select 'token' as type, name, actionable from ({ORACLES['token_conflicts']}) as a union all select 'component', name, actionable from ({ORACLES['component_conflicts']}) as b"
_SHOWN = f"select 'token' as type, name, actionable, entries from ({ORACLES['token_conflicts']}) as a union all select 'component', name, actionable, held || '|' || new from ({ORACLES['component_conflicts']}) as b"
ORACLES["conflict_projection"] = f"select type, name, 'pending' as resolution, actionable, entries, true as has_fix from ({_SHOWN}) as shown"
ORACLES["context_tokens"] = f"select category, name, value from ({ORACLES['reconcile_tokens']}) as won where category = 'colors'"
ORACLES["context_summary"] = f"""select 'tokens.' || category as what, n_tokens as n from ({ORACLES['category_counts']}) as counted
union all select 'components', count(*) from ({ORACLES['reconcile_components']}) as won union all select 'conflicts', count(*) from ({_ALL}) as c union all select 'pending', count(*) from ({_ALL}) as p"""
ORACLES["contract_parts"] = f"""select 'tokens' as part, count(*) as n from ({ORACLES['reconcile_tokens']}) as t union all select 'components', count(*) from ({ORACLES['reconcile_components']}) as w union all select 'conflicts', count(*) from ({_ALL}) as c"""
ORACLES["component_summary"] = f"""with counted as (select file, count(distinct prop) as n from ({ORACLES['component_props']}) as props group by file)
select name, won.file, coalesce(n, 0) as prop_count from ({ORACLES['component_last_wins']}) as won left join counted on counted.file = won.file"""
ORACLES["mismatch_warning"] = "select o_orderkey, o_orderkey % 7 > 1 and (o_custkey % 4 <> o_orderkey % 4 or o_orderkey % 5 = 0) as mismatch from orders"
ORACLES["detect_projects"] = f"""with seen as (select project, cast(regexp_extract(project, '#(\\d+)-', 1) as int) as b, bool_or(path = 'package.json') as p, bool_or(path = 'tsconfig.json') as ts, bool_or(path = 'tailwind.config.ts') as tw, bool_or(path = 'src/tokens.json') as token_file,
 bool_or(path = '.storybook/main.js') as sb, bool_or(starts_with(path, 'src/')) as src from ({s.LISTING}) as listed group by project)
select project, case when p and b % 7 in (0, 5) then 'next' when p and b % 7 = 1 then 'vite' when p and b % 7 in (2, 3) then 'react' else 'unknown' end as framework, ts or p and b % 7 = 1 as typescript,
 tw or p and b % 7 = 0 as tailwind, token_file, sb or p and b % 7 = 2 as storybook, case when src then './src' else '.' end as src_root,
 case when ts or p and b % 7 = 1 then '**/*.css|**/*.ts|**/*.tsx' else '**/*.css|**/*.js|**/*.jsx' end as patterns, 'node_modules|dist|.next|out|build|coverage|**/*.test.*|**/*.spec.*|**/*.stories.*' as ignored from seen"""
ORACLES["conflict_filter"] = f"select type, name, actionable from ({_ALL}) as c where type = 'component'"
ORACLES["conflict_counts"] = f"select count(*) as n, count(*) as pending, count(*) filter (where actionable) as actionable, count(*) filter (where not actionable) as undecided from ({_ALL}) as c"
_AGE = "cast(floor((epoch_us(timestamp '1998-08-02 00:00:00') - epoch_us(o_orderdate)) / 3600000000) as bigint)"
_DAYS = f"cast(floor({_AGE} / 24) as bigint)"
ORACLES["staleness"] = f"select o_orderkey, {_AGE} as age_hours, case when {_AGE} >= 24 then {_DAYS} || case when {_DAYS} = 1 then ' day' else ' days' end end as warning from orders"
ORACLES["latest_snapshot"] = "select user_id, max(event_id) as event_id, max_by(props, event_id) as props from (select user_id, event_id, case when event_id % 7 = 0 then substr(props, 1, 4) else props end as props from events) as cut where json_valid(props) group by user_id"
ORACLES["last_good_stream"] = ORACLES["latest_snapshot"]
ORACLES["reload_bursts"] = """
with marked as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) <= interval 4 hours then 0 else 1 end as fresh from events where ts is not null),
numbered as (select user_id, ts, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as burst from marked)
select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') as first_change, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') as last_change, count(*) as n_changes, strftime(max(ts) + interval 4 hours, '%Y-%m-%d %H:%M:%S.%f') as reload_at
from numbered group by user_id, burst"""
ORACLES["published_token"] = ORACLES["token_lookup"]
ORACLES["published_component"] = ORACLES["component_lookup"]
ORACLES["settings_insert"] = f"""with settings as ({s.SETTINGS}), wanted as (select project, name, min(value) as value from ({s.WANTED}) as w group by project, name)
select project, name, value, false as added from settings
union all select project, name, value, true from wanted as w where not exists (select 1 from settings as x where x.project = w.project and x.name = w.name)"""
_DETAIL = {
    "tokens": f"select 'tokens' as part, category, name, value as shown from ({ORACLES['reconcile_tokens']}) as t",
    "components": f"select 'components' as part, '' as category, name, '0' as shown from ({ORACLES['reconcile_components']}) as c",
    "conflicts": f"select 'conflicts' as part, type as category, name, 'pending' as shown from ({_ALL}) as a",
}
ORACLES["context_detail"] = " union all ".join(_DETAIL.values())
ORACLES["context_parts"] = f"{_DETAIL['components']} union all {_DETAIL['conflicts']} union all {_DETAIL['tokens']} where category = 'spacing'"
ORACLES["contract_content"] = f"""select 'token' as part, category || '.' || name as name, source || ':' || value as says from ({ORACLES['reconcile_tokens']}) as t
union all select 'component', name, adapter || ':' || coalesce(file, 'none') from ({ORACLES['reconcile_components']}) as c
union all select type || ' conflict', name, entries || ' ' || cast(actionable as varchar) from ({ORACLES['conflict_projection']}) as a"""
