"""DuckDB SQL for those corpus queries that SQL can express on whole tables."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: All pairs of documents that share a shingle, counted; then what is reachable from each document.
SHINGLE_JOIN = rf"""
with recursive words as (
 select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') as w from documents),
sets as materialized (
 select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
  else list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' ')) end) as s from words),
shingles as materialized (select doc_id, unnest(s) as shingle from sets),
shared as materialized (select doc_id, shingle from shingles semi join (select shingle from shingles group by 1 having count(*) > 1) using (shingle)),
common as materialized (
 select a.doc_id as x, b.doc_id as y, count(*) as o from shared a join shared b on a.shingle = b.shingle and a.doc_id < b.doc_id group by 1, 2),
found as materialized (
 select x, y from common join sets a on a.doc_id = x join sets b on b.doc_id = y where 100 * o >= 75 * (len(a.s) + len(b.s) - o)),
links as materialized (select x, y from found union all select y, x from found),
reach as (
 select doc_id as x, doc_id as y from documents union select r.x, l.y from reach r join links l on l.x = r.y)
select s.doc_id, cast(len(s.s) as bigint) as n_shingles, r.y as component_id
from sets s join (select x, min(y) as y from reach group by x) r on r.x = s.doc_id"""

#: All pairs of vectors of finite components; then what is reachable from each vector.
VECTOR_RANGE_JOIN = """
with recursive vectors as materialized (
 select vec_id, cast(embedding as double[]) as v from embeddings
 where embedding is not null and len(embedding) = len(list_filter(embedding, lambda x: isfinite(x))) and len(list_filter(embedding, lambda x: x <> 0)) > 0),
found as materialized (
 select a.vec_id as x, b.vec_id as y from vectors a join vectors b on a.vec_id < b.vec_id and len(a.v) = len(b.v) and list_cosine_similarity(a.v, b.v) >= 0.95),
links as materialized (select x, y from found union all select y, x from found),
reach as (select vec_id as x, vec_id as y from embeddings union select r.x, l.y from reach r join links l on l.x = r.y),
component as (select x, min(y) as component_id from reach group by x),
counted as (select x, count(*) as n from links group by x)
select e.vec_id, coalesce(n, 0) as n_links, component_id, e.vec_id = component_id as kept
from embeddings e join component c on c.x = e.vec_id left join counted k on k.x = e.vec_id"""

_TERMS = rf"regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

#: Every document that shares a term with an item, by the formula.
RANKED_SEARCH = rf"""
with words as materialized (select doc_id, w, cast(len(w) as bigint) as n from (select doc_id, {_TERMS} as w from documents where text is not null) where len(w) > 0),
corpus as (select count(*) as docs, cast(sum(n) as bigint) as terms from words),
asked as materialized (select distinct item_id, unnest({_TERMS}) as term from benchmark where text is not null and item_id is not null),
held as materialized (
 select doc_id, term, cast(count(*) as bigint) as tf from (select doc_id, unnest(w) as term from words) semi join asked using (term) group by doc_id, term),
weights as (select term, cast(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) as bigint) as w from (select term, count(*) as df from held group by term), corpus),
measures as (select doc_id, 100 - 50 + (50 * n * docs) // terms as m from words, corpus),
scores as (
 select item_id, doc_id, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) as bigint) as score
 from asked join held using (term) join weights using (term) join measures using (doc_id) where doc_id is not null group by item_id, doc_id),
ranked as (select *, row_number() over (partition by item_id order by score desc, doc_id) as nth from scores where score > 0)
select item_id, cast(nth as int) as rank, doc_id, score from ranked where nth <= 50"""

_RUNS = rf"regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[A-Za-z\x{{C0}}-\x{{FF}}]+')"

#: Checksums by the table of the polynomial; then all words that share what is left when one letter goes, or are that.
SPELLING_VARIANTS = rf"""
with recursive polynomial as materialized (
 select list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t),
runs as (select doc_id, run, count(*) as n from (select doc_id, unnest({_RUNS}) as run from documents where text is not null) where length(run) >= 7 group by doc_id, run),
spelled as (
 select run, n, list_prepend(4294967295, flatten(list_transform(string_split(coalesce(cast(doc_id as varchar), '') || ':' || run, ''), lambda c:
  case when unicode(c) < 128 then [cast(unicode(c) as bigint)] else [192 + (unicode(c) // 64), 128 + unicode(c) % 64] end))) as b from runs),
summed as (select run, n, xor(list_reduce(b, lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295) as h from spelled, polynomial),
said as (select case when h % 31 = 0 then substr(run, 1, cast(h % length(run) as bigint)) || substr(run, cast(h % length(run) as bigint) + 2) else run end as word, n from summed),
words as materialized (select word, cast(sum(n) as bigint) as n from said where length(word) >= 7 group by word having sum(n) >= 2),
shorter as materialized (select word, n, k, substr(word, 1, k - 1) || substr(word, k + 1) as rest from (select word, n, unnest(range(1, length(word) + 1)) as k from words)),
pairs as (
 select a.word, b.word as near, b.n as near_n from shorter a join shorter b on a.rest = b.rest and a.k = b.k and a.word <> b.word
 union select a.word, b.word, b.n from shorter a join words b on a.rest = b.word
 union select b.word, a.word, a.n from shorter a join words b on a.rest = b.word),
ranked as (select word, near, near_n, count(*) over (partition by word) as n_near, row_number() over (partition by word order by near_n desc, near) as nth from pairs),
known as materialized (
 select w.word, w.n, case when near_n >= 10 * w.n then near end as form, coalesce(n_near, 0) as n_near, case when near_n >= 10 * w.n then near_n end as form_n
 from words w left join ranked r on r.word = w.word and r.nth = 1),
steps as (select word, word as root, form from known union all select s.word, s.form, k.form from steps s join known k on k.word = s.form)
select k.word, k.n, k.form, s.root, k.n_near, k.form_n from known k join steps s on s.word = k.word and s.form is null"""

#: The pages of the tables hold their article in one element, its blocks in p and h1, and few kinds of references.
MAIN_TEXT = r"""
with articles as (
 select page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(?:</article>|$)', 1) as article from pages),
parts as (
 select page_id, url, list_transform(string_split_regex(article, '</?(?:p|h1)>'), lambda x:
  trim(regexp_replace(replace(replace(replace(replace(regexp_replace(replace(x, '<br>', ' '), '<[^>]*>', '', 'g'), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '\s+', ' ', 'g'))) as blocks from articles),
texts as (
 select page_id, url, array_to_string(list_filter(blocks, lambda x: x <> ''), chr(10) || chr(10)) as text from parts)
select page_id, url, text, cast(length(text) as bigint) as n_chars from texts"""

#: Every 50-byte string of every document, the least document that has it, and what it covers elsewhere.
SUFFIX_DEDUP = """
with bytes as (select doc_id, encode(coalesce(text, '')) as h, octet_length(encode(coalesce(text, ''))) as n from documents),
starts as (select doc_id, h, unnest(range(0, n - 49)) as i from bytes where n >= 50),
strings as materialized (select doc_id, i, h[i + 1:i + 50] as s from starts),
repeated as (select s, min(doc_id) as least from strings group by s having min(doc_id) < max(doc_id)),
hits as (select x.doc_id, x.i from strings x join repeated r on r.s = x.s where x.doc_id > r.least),
marked as (select doc_id, i, case when i - lag(i) over (partition by doc_id order by i) <= 50 then 0 else 1 end as fresh from hits),
numbered as (select doc_id, i, sum(fresh) over (partition by doc_id order by i) as g from marked),
spans as (select doc_id, g, min(i) as a, max(i) + 50 as b from numbered group by doc_id, g),
pieces as (
 select doc_id, g, coalesce(lag(b) over (partition by doc_id order by g), 0) as p, a as q from spans
 union all select s.doc_id, max(s.g) + 1, max(s.b), max(t.n) from spans s join bytes t on t.doc_id = s.doc_id group by s.doc_id),
kept as (select p.doc_id, string_agg(case when q > p then hex(t.h[p + 1:q]) else '' end, '' order by g) as h from pieces p join bytes t on t.doc_id = p.doc_id group by p.doc_id),
removed as (select doc_id, sum(b - a) as n_removed, count(*) as n_spans from spans group by doc_id)
select t.doc_id, cast(t.n as bigint) as n_bytes, cast(coalesce(r.n_removed, 0) as bigint) as n_removed, cast(coalesce(r.n_spans, 0) as bigint) as n_spans, sha256(coalesce(unhex(k.h), t.h)) as kept_sha256
from bytes t left join kept k on k.doc_id = t.doc_id left join removed r on r.doc_id = t.doc_id"""

_WORDS = r"regexp_extract_all(lower({}), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+')"

#: Every passage against every item that shares a word with it, by the formula; items of up to 4,096 words.
BENCHMARK_LEAKS = rf"""
with items as (
 select item_id, w, len(w) as n, case when len(w) <= 64 then 64 when len(w) <= 256 then 256 when len(w) <= 1024 then 1024 else 4096 end as stride,
  list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: {_WORDS.format("x")}), lambda x: len(x) > 0) as parts
 from (select item_id, text, {_WORDS.format("text")} as w from benchmark where text is not null) where len(w) > 0),
split as (
 select item_id, n, stride, w[1:cut] as question, case when cut = n then w[n:n] else w[cut + 1:n] end as answer
 from (select *, case when len(parts) > 1 then n - len(parts[-1]) else (2 * n + 2) // 3 end as cut from items)),
terms as (select item_id, n, stride, word, count(*) as tf from (select item_id, n, stride, unnest(w) as word from items) group by all),
common as (select word, count(*) as df from terms group by word),
whole as (select count(*) as items, avg(n) as average from items),
scores as (
 select item_id, stride, word, ln(1 + (items - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / average)) as score
 from terms join common using (word), whole),
shares as materialized (select *, score / sum(score) over (partition by item_id) as share, sum(score) over (partition by item_id) as own from scores),
docs as (select doc_id, {_WORDS.format("coalesce(text, '')")} as w from documents),
passages as materialized (
 select doc_id, stride, p * stride as first, w[p * stride + 1:(p + 2) * stride] as w
 from (select doc_id, w, stride, unnest(range(0, greatest(1, (len(w) + stride - 1) // stride - 1))) as p from docs, (select distinct stride from items) as strides)),
held as (select distinct doc_id, stride, first, unnest(w) as word from passages),
reached as (
 select doc_id, stride, first, item_id, round(sum(share), 9) as share, any_value(own) as own
 from held join shares using (stride, word) group by doc_id, stride, first, item_id having sum(share) >= 0.5 - 1e-9),
checked as (
 select r.doc_id, r.item_id, r.first, r.share, r.own,
  list_distinct(list_transform(range(0, greatest(1, len(question) - 2)), lambda k: array_to_string(question[k + 1:k + 3], ' '))) as asked,
  list_transform(range(0, greatest(1, len(p.w) - least(3, len(question)) + 1)), lambda k: array_to_string(p.w[k + 1:k + least(3, len(question))], ' ')) as said, list_distinct(answer) as answer, p.w as w
 from reached r join split s on s.item_id = r.item_id join passages p on p.doc_id = r.doc_id and p.stride = r.stride and p.first = r.first),
rated as (select *, len(list_intersect(asked, said)) / len(asked) as q, len(list_intersect(answer, w)) / len(answer) as a from checked),
best as (select *, row_number() over (partition by doc_id, item_id order by share desc, first) as nth from rated where q >= 0.6 and a >= 0.6)
select doc_id, item_id, round(share, 6) as score, round(share * own, 6) as bm25, round(q, 6) as question_overlap, round(a, 6) as answer_overlap, first as passage_word from best where nth = 1"""

_OPEN, _SHUT = "chr(57344)", "chr(57345)"


def _placed(rows: str, pattern: str, label: str) -> str:
    """(doc_id, label, s, e, m) of every match: marked, split there, the pieces' lengths summed up."""
    return f"""select doc_id, label, s, s + length(m) as e, m from (
 select doc_id, label, k, split_part(c, {_SHUT}, 1) as m, coalesce(sum(length(replace(c, {_SHUT}, ''))) over (partition by doc_id order by k rows between unbounded preceding and 1 preceding), 0) as s
 from (select doc_id, '{label}' as label, unnest(x) as c, generate_subscripts(x, 1) as k from (select doc_id, string_split(regexp_replace(t, '{pattern}', {_OPEN} || '\\0' || {_SHUT}, 'g'), {_OPEN}) as x from {rows}))) where k > 1"""


_DETECTORS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}

#: All matches of the detectors; then every pair of an entity and a term of one text, counted over the corpus.
PII_SPANS = rf"""
with docs as (select doc_id, coalesce(text, '') as t from documents),
matched as ({" union all ".join(_placed("docs", pattern, kind) for kind, pattern in _DETECTORS.items())}),
digits as (select *, regexp_replace(m, '[^0-9]', '', 'g') as d, case label when 'email' then 1 when 'ip' then 2 when 'card' then 3 else 4 end as o from matched),
base as materialized (
 select doc_id, label as kind, o, s, e, m, d from digits where case label when 'email' then true
  when 'ip' then len(list_filter(string_split(m, '.'), lambda x: length(ltrim(x, '0')) > 3 or coalesce(try_cast(nullif(ltrim(x, '0'), '') as int), 0) > 255)) = 0
  when 'card' then length(d) between 16 and 19 and list_sum(list_transform(range(1, length(d) + 1), lambda i: case when i % 2 = 1 then cast(substr(d, length(d) - i + 1, 1) as int)
   else 2 * cast(substr(d, length(d) - i + 1, 1) as int) - case when substr(d, length(d) - i + 1, 1) > '4' then 9 else 0 end end)) % 10 = 0
  else length(d) between 8 and 15 end),
named as (
 select doc_id, unnest(case kind when 'email' then ['email:' || lower(m), 'domain:' || split_part(lower(m), '@', -1)]
  when 'ip' then ['ip:' || m, 'net:' || array_to_string(string_split(m, '.')[1:3], '.'), 'net:' || array_to_string(string_split(m, '.')[1:2], '.')]
  when 'card' then ['card:' || d, 'issuer:' || left(d, 6)] else ['phone:' || d, 'block:' || left(d, length(d) - 4), 'block:' || left(d, length(d) - 7)] end) as entity from base),
held as materialized (select doc_id, t from docs where doc_id in (select doc_id from base)),
words as materialized (
 select w.doc_id, w.s, w.e, lower(w.m) as term from ({_placed("held", r"[\p{L}\p{N}_]+", "word")}) w
 where not exists (select 1 from base b where b.doc_id = w.doc_id and b.s < w.e and b.e > w.s)),
texts as (select t, min(doc_id) as doc_id, count(*) as n_rows from held group by t),
entities as (select distinct t, n_rows, entity from texts join named using (doc_id)),
terms as (select distinct t, term from texts join words using (doc_id)),
frequent as (select word as term, count(*) as n from (select distinct doc_id, unnest(regexp_extract_all(lower(t), '[\p{{L}}\p{{N}}_]+')) as word from docs) group by word),
known as (select entity, sum(n_rows) as n_entity from entities group by entity),
joint as (select entity, term, sum(n_rows) as n_joint, count(*) as n_texts from entities join terms using (t) group by entity, term),
rated as (
 select entity, term, case when ln(total / n_entity) > 0 then ln(n_joint * total / (n_entity * greatest(n, n_joint))) / ln(total / n_entity) * (1 - power(0.5, n_texts)) else 0 end as disclosure
 from joint join known using (entity) join frequent using (term), (select count(*) as total from docs)),
risky as (select t, term, max(disclosure) as disclosure from rated join entities using (entity) join terms using (t, term) where disclosure >= 0.6 group by t, term),
added as (
 select h.doc_id, string_agg(case when disclosure >= 0.9 then 'remove' else 'generalise' end || ':' || cast(s as bigint) || ':' || cast(e as bigint), ',' order by s) as spans, count(*) as n
 from held h join risky using (t) join words w on w.doc_id = h.doc_id and w.term = risky.term group by h.doc_id),
counted as (
 select doc_id, count(*) filter (where kind = 'email') as n_email, count(*) filter (where kind = 'ip') as n_ip, count(*) filter (where kind = 'card') as n_card, count(*) filter (where kind = 'phone') as n_phone,
  string_agg(kind || ':' || cast(s as bigint) || ':' || cast(e as bigint), ',' order by o, s) as spans from base group by doc_id)
select d.doc_id, coalesce(n_email, 0) as n_email, coalesce(n_ip, 0) as n_ip, coalesce(n_card, 0) as n_card, coalesce(n_phone, 0) as n_phone, sha256(coalesce(c.spans, '')) as base_sha256,
 concat_ws(',', c.spans, a.spans) as spans, coalesce(a.n, 0) as n_terms
from docs d left join counted c on c.doc_id = d.doc_id left join added a on a.doc_id = d.doc_id"""
