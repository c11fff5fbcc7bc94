"""Design sources derived from the driver's `part` table, as SQL that Spark and DuckDB read alike.

The tables hold no design data, so files, exports and manifests are made from their rows; the work grows with the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tokenloom.session import table

BLOCK = "cast(floor(p_partkey / 200) as bigint)"
WORD1, WORD2 = "split_part(p_name, ' ', 1)", "split_part(p_name, ' ', 2)"
CAMEL = f"{WORD1} || upper(substr({WORD2}, 1, 1)) || substr({WORD2}, 2)"
PASCAL = f"upper(substr(p_name, 1, 1)) || substr({CAMEL}, 2)"
HEX6 = "lpad(lower(hex(p_partkey)), 6, '0')"
DASHED = "replace(p_name, ' ', '-')"


def _joined(value: str, dialect: str, separator: str = "chr(10)") -> str:
    if dialect == "spark":
        return f"array_join(transform(array_sort(collect_list(struct(p_partkey as o, {value} as x))), r -> r.x), {separator})"
    return f"string_agg({value}, {separator} order by p_partkey)"


CSS_LINE = f"""case p_partkey % 8
 when 0 then '--spacing-' || p_size || ': ' || (p_size * 4) || 'px;'
 when 1 then '--' || {DASHED} || ': #' || {HEX6} || ';'
 when 2 then '--radius-' || (p_size % 5) || ':' || chr(10) || ' ' || (p_size % 7) || 'px ;'
 when 3 then '--font-' || (p_size % 9) || ': Face ' || p_size || ';'
 when 4 then '--shadow-' || p_size || ': 0 1px ' || p_size || 'px black;'
 when 5 then '--alias-' || p_size || ': var(--' || {DASHED} || ');'
 when 6 then '--' || {DASHED} || '-hover: rgb(' || p_size || ', 0, ' || (p_partkey % 256) || ');'
 else '--misc-' || p_size || ': 1.5em;' end"""

TS_LINE = f"""'  ' || {CAMEL} || p_size || case p_partkey % 3
 when 0 then ': ''#' || {HEX6} || ''','
 when 1 then ': "rgba(' || p_size || ', 0, 0, 0.5)",'
 else ': hsl(' || p_size || ' 10% 20%),' end"""

TSX = f"""case p_partkey % 4
 when 0 then 'interface ' || {PASCAL} || 'Props {{' || chr(10) || '  variant: string;' || chr(10) || '  size?: number' || chr(10) || '}}' || chr(10) || 'export function ' || {PASCAL} || 'X() {{}}'
 when 1 then chr(10) || 'export default function ' || {PASCAL} || '2(p) {{}}' || chr(10) || 'type Props = {{ disabled?: boolean; size: ' || p_size || ' }}'
 when 2 then 'const inner = 1' || chr(10)
 else 'export const ' || {PASCAL} || ' = () => null' end"""


def css_files(dialect: str) -> str:
    return f"select 0 as pattern, 'styles/' || replace(p_brand, '#', '-') || '-' || {BLOCK} || '.css' as file, ':root {{' || chr(10) || {_joined(CSS_LINE, dialect)} || chr(10) || '}}' as content from part group by p_brand, {BLOCK}"


def ts_files(dialect: str) -> str:
    return f"select 1 as pattern, 'theme/' || lower(p_type) || '-' || {BLOCK} || '.ts' as file, 'export const c = {{' || chr(10) || {_joined(TS_LINE, dialect)} || chr(10) || '}}' as content from part group by p_type, {BLOCK}"


def tsx_files(dialect: str) -> str:
    return f"select 2 as pattern, 'components/' || p_partkey || '/' || case when p_partkey % 5 = 0 then 'card' || p_size else {PASCAL} end || '.tsx' as file, {TSX} as content from part"


VARIABLE_NAME = f"case p_partkey % 3 when 0 then 'radius/' when 1 then 'font/' else 'space/' end || p_type || '/' || p_name || ' ' || {BLOCK}"
VARIABLE_TYPE = "case p_partkey % 4 when 0 then 'COLOR' when 1 then 'FLOAT' when 2 then 'STRING' else 'BOOLEAN' end"
FLOAT_TEXT = "case when p_size % 5 = 0 then p_size || '.5' else p_size || '' end"
VARIABLE_VALUE = f"""case when p_size % 13 = 0 then '{{"type":"VARIABLE_ALIAS","id":"x"}}' when p_size % 17 = 0 then 'null'
 when p_partkey % 4 = 0 then '{{"r":0.' || (p_size % 10) || ',"g":0.' || (p_partkey % 10) || ',"b":1' || case when p_size % 2 = 0 then ',"a":0.5}}' when p_size % 3 = 0 then ',"a":1}}' else '}}' end
 when p_partkey % 4 = 1 then {FLOAT_TEXT}
 when p_partkey % 4 = 2 then case when p_size % 7 = 0 then '""' else '"' || p_name || '"' end
 else 'true' end"""
VARIABLE = f"""'"V' || p_partkey || '":{{"id":"V' || p_partkey || '","name":"' || ({VARIABLE_NAME}) || '","resolvedType":"' || ({VARIABLE_TYPE}) || '","remote":' || case when p_partkey % 11 = 0 then 'true' else 'false' end || ',"variableCollectionId":"C' || (p_size % 3) || '","valuesByMode":{{"m' || (1 + p_size % 3) || '":' || ({VARIABLE_VALUE}) || '}}}}'"""


def variable_documents(dialect: str) -> str:
    head, tail = '{"meta":{"variables":{', '},"variableCollections":{"C0":{"name":"Base","defaultModeId":"m1"},"C1":{"name":"Dark","defaultModeId":"m2"}}}}'
    return f"select 'vars-' || {BLOCK} as doc, '{head}' || {_joined(VARIABLE, dialect, chr(39) + ',' + chr(39))} || '{tail}' as body from part group by {BLOCK}"


TOOL_COMPONENT = f"""'{{"name":"' || case when p_partkey % 9 = 0 then '' else {PASCAL} || {BLOCK} end || '","node_id":"n' || p_partkey || '","key":"k' || p_partkey || '"}}'"""


def component_documents(dialect: str) -> str:
    return f"select 'comps-' || {BLOCK} as doc, '{{\"meta\":{{\"components\":[' || {_joined(TOOL_COMPONENT, dialect, chr(39) + ',' + chr(39))} || ']}}}}' as body from part group by {BLOCK}"


STORY_TITLE = f"case when p_partkey % 19 = 0 then '' else p_type || '/' || p_name || ' ' || {BLOCK} end"
STORY = f"""'"s' || p_partkey || '":{{"id":"s' || p_partkey || '","title":"' || ({STORY_TITLE}) || '","name":"' || case when p_partkey % 5 = 0 then '' else p_brand end || '","importPath":"' || case when p_partkey % 3 = 0 then '' else './' || p_partkey || '.tsx' end || '","type":"' || case when p_partkey % 7 = 0 then 'docs' else 'story' end || '"}}'"""


def manifest_documents(dialect: str) -> str:
    return f"select 'manifest-' || lpad({BLOCK} || '', 12, '0') as doc, '{{\"entries\":{{' || {_joined(STORY, dialect, chr(39) + ',' + chr(39))} || '}}}}' as body from part group by {BLOCK}"


#: Tokens of three sources with overlapping names; the last of a name counts within a source.
SOURCE_TOKENS = f"""select cast(p_partkey % 3 as int) as source_ord, case p_partkey % 5 when 0 then 'colors' when 1 then 'spacing' when 2 then 'typography' when 3 then 'borderRadius' else 'misc' end as category,
 {WORD1} || '-' || {BLOCK} as name, max_by(case when p_size % 4 = 0 then 'v' || (p_partkey % 7) else 'same' end, p_partkey) as value, min(p_partkey) as first
 from part group by 1, 2, 3"""

SOURCE_COMPONENTS = f"""select cast(p_partkey % 3 as int) as source_ord, {PASCAL} || {BLOCK} as name, max_by(case p_partkey % 3 when 0 then 'c/' || p_partkey || '.tsx' when 1 then null else './' || p_partkey || '.tsx' end, p_partkey) as file, max(p_partkey) as last_key, min(p_partkey) as first
 from part group by 1, 2"""

_BN = "cast(replace(p_brand, 'Brand#', '') as int)"
PROJECT = "p_brand || '-' || cast(floor(p_partkey / 2000) as bigint)"
#: Tokens of one project for each brand and range of parts, made so that every rule holds somewhere.
PROJECT_TOKENS = f"""select project, category, name, max_by(value, p_partkey) as value, min(p_partkey) as first from (
 select {PROJECT} as project, p_partkey,
 case p_partkey % 5 when 0 then 'spacing' when 1 then 'colors' when 2 then 'borderRadius' when 3 then 'typography' else 'other' end as category,
 case p_partkey % 5 when 0 then 'spacing-' || p_size
  when 1 then case when {_BN} % 2 = 0 then 'primary-' else '' end || {DASHED} || case when p_size % 3 = 0 then '-hover' when p_size % 7 = 0 then '-dark' else '' end
  when 2 then 'radius-' || p_size
  when 3 then case when {_BN} % 5 = 0 then 'font-one' else 'font-' || p_size end
  else case when {_BN} % 3 = 0 then {CAMEL} else {DASHED} end end as name,
 case p_partkey % 5 when 0 then case {_BN} % 3 when 0 then (p_size * 4) || 'px' when 1 then p_size || 'px' else p_size || 'rem' end
  when 1 then '#' || {HEX6}
  when 2 then case when {_BN} % 4 = 0 then '4px' else (p_size % 9) || 'px' end
  when 3 then case when p_size % 10 = 0 then 'Fira Mono' else 'Inter' end
  else '1' end as value from part) as t group by project, category, name"""

PROJECT_COMPONENTS = f"""select {PROJECT} as project, {PASCAL} || p_partkey as name, p_partkey as first,
 (p_partkey % (1 + {_BN} % 4) = 0) as has_variant, (p_size % 3 = 0) as has_size, (p_partkey % (1 + {_BN} % 3) = 0) as has_disabled from part"""


#: Names that style sheets and literals share, so that the fold over both kinds of writes is met.
MIXED_NAME = f"{CAMEL} || {BLOCK}"
MIXED_CSS = f"'--' || {MIXED_NAME} || ': #' || {HEX6} || ';'"
MIXED_TS = f"'  ' || {MIXED_NAME} || ': ''#' || {HEX6} || ''','"


def mixed_css(dialect: str) -> str:
    return f"select 0 as pattern, 'm/' || replace(p_brand, '#', '-') || '-' || {BLOCK} || '.css' as file, ':root {{' || chr(10) || {_joined(MIXED_CSS, dialect)} || chr(10) || '}}' as content from part where p_partkey % 3 = 0 group by p_brand, {BLOCK}"


def mixed_ts(dialect: str) -> str:
    return f"select 1 as pattern, 'm/' || lower(p_type) || '-' || {BLOCK} || '.ts' as file, 'export const c = {{' || chr(10) || {_joined(MIXED_TS, dialect)} || chr(10) || '}}' as content from part where p_partkey % 3 <> 0 group by p_type, {BLOCK}"


def keyed_manifests(dialect: str) -> str:
    """Manifests of which a third have only the old key, a third an empty new one beside the old, a third the new one."""
    entries = "'{' || " + _joined(STORY, dialect, chr(39) + "," + chr(39)) + " || '}'"
    old, empty, new = '{"stories":', '{"entries":{},"stories":', '{"stories":{},"entries":'
    shapes = f"case {_BN} % 3 when 0 then '{old}' when 1 then '{empty}' else '{new}' end"
    return f"select p_brand || '-' || {BLOCK} as doc, {shapes} || {entries} || '}}' as body from part group by p_brand, {BLOCK}"


#: A project's listing with the files that detection looks for; packages of all kinds, a broken one too.
PACKAGE = f"""case {_BN} % 7
 when 0 then '{{"dependencies":{{"next":"1","react":"18"}},"devDependencies":{{"tailwindcss":"3"}}}}'
 when 1 then '{{"devDependencies":{{"vite":"5","typescript":"5"}}}}'
 when 2 then '{{"dependencies":{{"react":"18","storybook":"8"}}}}'
 when 3 then '{{"dependencies":{{"vite":"","react":"18"}}}}'
 when 4 then '{{"dependencies"'
 when 5 then '{{"dependencies":{{"vite":"5","react":"18"}},"devDependencies":{{"vite":"","next":"14"}}}}'
 else '{{}}' end"""
LISTING = f"""select {PROJECT} as project,
 case p_partkey % 8 when 0 then 'package.json' when 1 then case when {_BN} % 2 = 0 then 'tsconfig.json' else 'readme' end
  when 2 then case when {_BN} % 3 = 0 then 'tailwind.config.ts' else 'a.css' end when 3 then case when {_BN} % 4 = 0 then 'src/tokens.json' else 'x.json' end
  when 4 then case when {_BN} % 5 = 0 then '.storybook/main.js' else 'b.css' end else case when {_BN} % 3 = 1 then 'lib/' else 'src/' end || {DASHED} || '.ts' end as path,
 case p_partkey % 8 when 0 then {PACKAGE} else '' end as content from part"""

#: Settings that projects have, some twice and some without a value, and those that all should have.
SETTINGS = f"""select {PROJECT} as project, case p_partkey % 4 when 0 then 'server' when 1 then 'guide' when 2 then 'own-' || p_size % 3 else '' end as name,
 case when p_partkey % 5 = 0 then null else 'kept-' || p_partkey end as value from part where p_partkey % 3 <> 0"""
WANTED = f"""select {PROJECT} as project, case p_partkey % 3 when 0 then 'server' when 1 then 'guide' else 'skill' end as name, 'new-' || p_partkey as value from part"""

PATTERNS = ["**/*.css", "src/*.{ts,tsx}", "src/**/*.ts", "lib/[a-m]*.ts"]
IGNORED = ["node_modules", "**/*.test.*", "dist"]
#: Paths of all kinds, to be matched by PATTERNS and IGNORED.
PATHS = f"""select case p_partkey % 9 when 0 then 'src/' || {CAMEL} when 1 then 'src/' || p_brand || '/' || {CAMEL} when 2 then 'node_modules/x/' || {CAMEL} when 3 then 'src/dist/' || {CAMEL}
 when 4 then 'dist/' || {CAMEL} when 5 then 'lib/' || {CAMEL} when 6 then '.cache/' || {CAMEL} when 7 then {CAMEL} else 'src/a b/' || p_type || '/.' || {CAMEL} end
 || '-' || p_partkey || case p_size % 5 when 0 then '.css' when 1 then '.ts' when 2 then '.tsx' when 3 then '.test.ts' else '.js' end as file from part"""


def made(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The SQL over the directory's `part` table."""
    doubled = sql.replace("{", "{{").replace("}", "}}")
    return spark.sql(doubled.replace("from part", "from {part}"), part=table(spark, sf_dir, "part"))
