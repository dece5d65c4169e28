"""The queries' results in plain SQL, where SQL can say them."""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word; the class is x20 and x09-x0D.
_WORD = r"[^\x20\x09-\x0D]+"

JACCARD_JOIN = rf"""
with recursive words as (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}') as w from documents
),
shingles as (
    select distinct doc_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) as s
    from words where len(w) >= 5
    union all
    select doc_id, array_to_string(w, ' ') from words where len(w) between 1 and 4
),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
shared as (
    select a.doc_id as a, b.doc_id as b, count(*) as common
    from shingles a join shingles b on a.s = b.s and a.doc_id <> b.doc_id group by a.doc_id, b.doc_id
),
links as (
    select a, b from shared join sizes x on x.doc_id = a join sizes y on y.doc_id = b
    where 100 * common >= 80 * (x.n + y.n - common)
),
reach as (
    select a, b from links
    union
    select reach.a, links.b from reach join links on reach.b = links.a
),
lows as (select a, min(b) as low from reach group by a),
degrees as (select a, count(distinct b) as n_links from links group by a)
select d.doc_id, coalesce(sizes.n, 0) as n_shingles, least(d.doc_id, coalesce(low, d.doc_id)) as component_id, coalesce(n_links, 0) as n_links
from documents d left join sizes on sizes.doc_id = d.doc_id left join lows on lows.a = d.doc_id left join degrees on degrees.a = d.doc_id
"""

TOPK_SEARCH = """
with whole as (
    select distinct vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v
    from embeddings
    where vec_id is not null and embedding is not null
      and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
),
scores as (
    select q.vec_id as query_id, c.vec_id,
           max(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))) as score
    from whole q join whole c on len(c.v) = len(q.v) and c.vec_id <> q.vec_id
    where q.vec_id % 50 = 0
    group by q.vec_id, c.vec_id
),
ranked as (
    select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank, vec_id,
           cast(coalesce(score, 0) as bigint) as score
    from scores
)
select query_id, rank, vec_id, score from ranked where rank <= 5
"""

QUALITY_RULES = rf"""
with base as (
    select row_number() over () as r, doc_id, coalesce('=' || source, '') as host, coalesce(text, '') as text,
           regexp_extract_all(coalesce(text, ''), '{_WORD}') as w
    from documents
),
windows as (select r, i, array_to_string(w[i:i + 4], ' ') as s from base, unnest(range(1, len(w) - 3)) t(i)),
twins as (select r, i from (select r, i, count(*) over (partition by r, s) as c from windows) where c >= 2),
repeated as (select r, count(distinct p) as n from (select r, unnest([i, i + 1, i + 2, i + 3, i + 4]) as p from twins) group by r),
split as (select r, host, text, unnest(string_split(text, chr(10))) as raw from base),
lines as (
    select r, host, text, raw, regexp_extract_all(translate(raw, '{_UPPER}', '{_LOWER}'), '{_WORD}') as parts from split
    where regexp_matches(raw, '{_WORD}')
),
normal as (select *, regexp_replace(array_to_string(parts, ' '), '[0-9]+', '0', 'g') as line from lines),
common as (select host, line from normal group by host, line having count(distinct text) > 50),
per_text as (
    select n.r, count(*) - count(distinct n.raw) as n_dup_lines,
           sum(case when c.line is not null then len(n.parts) else 0 end) as removed
    from normal n left join common c on c.host = n.host and c.line = n.line group by n.r
),
counts as (
    select b.doc_id, cast(len(w) as bigint) as n_words, cast(length(array_to_string(w, '')) as bigint) as word_chars,
           cast(len(regexp_extract_all(b.text, '[#*$%&|<>]')) as bigint) as n_symbols,
           coalesce(p.n_dup_lines, 0) as n_dup_lines, coalesce(d.n, 0) as n_repeat_words,
           cast(coalesce(p.removed, 0) as bigint) as removed_words
    from base b left join per_text p on p.r = b.r left join repeated d on d.r = b.r
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
       not (n_words < 10 or 100 * n_repeat_words > 20 * n_words) and 100 * removed_words <= 50 * n_words as kept,
       removed_words
from counts
"""

_DIGEST = "cast('0x' || substr(md5({}), 1, 8) as bigint)"

MIXING = rf"""
with docs as (
    select doc_id, source, coalesce('=' || source, '') as k, {_DIGEST.format("'0:' || coalesce(cast(doc_id as varchar), '')")} % 64 as block,
           len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) as tokens
    from documents
),
blocks as (select k, block, sum(tokens) as tokens from docs group by k, block),
sources as (select k, sum(tokens) as t from blocks group by k),
shares as (select k, t, t / (select sum(t) from sources) as p from sources where t > 0),
exponent as (select case when max(p) <= 2 * min(p) then 0 else 1 - ln(2) / ln(max(p) / min(p)) end as a from shares),
powered as (select k, t, exp(a * ln(p)) as q from shares, exponent),
totals as (select sum(q) as z, max(t / q) as least from powered),
planned as (
    select s.k, s.t, coalesce(q / z, 0) as weight, case when s.t > 0 then q / z * least * z / s.t else 1 end as repetition
    from sources s left join powered p on p.k = s.k, totals
),
taken as (
    select b.k, b.block, b.tokens, epoch, weight, repetition, t
    from blocks b join planned p on p.k = b.k, unnest(range(1, cast(greatest(ceil(repetition - 1e-6), 1) as bigint) + 1)) e(epoch)
),
summed as (
    select *, sum(tokens) over (
        partition by k, epoch order by {_DIGEST.format("'0:' || epoch || ':' || block")}, block rows unbounded preceding
    ) as until
    from taken
),
plan as (
    select k, block, epoch, weight, repetition from summed
    where epoch <= floor(repetition + 1e-6) or until - tokens / 2 <= (repetition - epoch + 1) * t
)
select d.doc_id, d.source, cast(p.epoch as int) as epoch, cast(d.block as int) as block,
       {_DIGEST.format("'0:' || p.epoch || ':' || coalesce(cast(d.doc_id as varchar), '')")} as place,
       round(weight, 6) as weight, round(repetition, 6) as repetition, round((select a from exponent), 6) as alpha
from docs d join plan p on p.k = d.k and p.block = d.block
"""
