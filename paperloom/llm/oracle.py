"""DuckDB SQL of the queries that SQL can express, each by plain definition over whole tables."""

from __future__ import annotations

from .decontaminate import WINDOW
from .spelling import LEAST_CHARS, LEAST_COUNT
from .url_filter import GLOBS, NAMED
from .warc import BASE32

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: Words between white space, and the decontamination's words.
_SPLIT = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"
_ALNUM = r"regexp_extract_all({0}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP1 = f"""
with d as (select doc_id, coalesce({_SPLIT.format("text")}, []) as w from documents),
s as (select doc_id, unnest(range(1, len(w) - 11)) as k from d where len(w) >= 13),
x as (select s.doc_id, s.k, array_to_string(w[s.k:s.k + 12], ' ') as win from s join d using (doc_id)),
m as (select win, min(doc_id) as first from x group by win),
g as (select distinct doc_id, unnest(range(k, k + 13)) as pos from x join m using (win) where first < doc_id),
r as (select doc_id, list(pos) as gone from g group by doc_id),
p as (select doc_id, unnest(range(1, len(w) + 1)) as pos, unnest(w) as word from d),
kept as (select p.doc_id, string_agg(word, ' ' order by p.pos) as t from p left join g on p.doc_id = g.doc_id and p.pos = g.pos where g.pos is null group by p.doc_id)
select d.doc_id, len(w)::bigint as n_words, coalesce(len(gone), 0)::bigint as n_removed, sha256(coalesce(t, '')) as kept_sha256
from d left join r using (doc_id) left join kept using (doc_id)
"""

OP2 = f"""
with d as (select doc_id, coalesce({_ALNUM.format(_LOWER.format("text"))}, []) as w from documents),
b as (select item_id::varchar as item, {_ALNUM.format(_LOWER.format("text"))} as w from benchmark),
i as (select item, w, unnest(range(1, greatest(1, len(w) - {WINDOW - 1}) + 1)) as k from b where len(w) > 0),
win as (select distinct item, array_to_string(w[k:k + {WINDOW - 1}], ' ') as win, least(len(w), {WINDOW}) as n from i),
ns as (select distinct n from win),
s as (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as k from d, ns where len(w) >= n),
h as (select s.doc_id, s.k, s.n, win.item from s join win on win.n = s.n and array_to_string(s.w[s.k:s.k + s.n - 1], ' ') = win.win),
c as (select doc_id, count(distinct pos) as n_hit from (select doc_id, unnest(range(k, k + n)) as pos from h) group by doc_id),
t as (select doc_id, list_sort(list(distinct item)) as items from h group by doc_id)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(len(items), 0)::bigint as n_items,
sha256(coalesce(array_to_string(items, ','), '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join c using (doc_id) left join t using (doc_id)
"""

OP5 = f"""
with recursive d as (select doc_id, coalesce({_SPLIT.format(_LOWER.format("text"))}, []) as w from documents),
s as (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) = 1 then [w[1]] else list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1]) end) as sh from d),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select x.doc_id as a, y.doc_id as b, count(*) as inter from s x join s y on x.sh = y.sh and x.doc_id < y.doc_id group by 1, 2),
e as (select a, b from p join n na on a = na.doc_id join n nb on b = nb.doc_id where 100 * inter >= 80 * (na.n + nb.n - inter)),
sym as (select a, b from e union all select b, a from e),
reach as (select doc_id, doc_id as other from documents union select r.doc_id, sym.b from reach r join sym on r.other = sym.a),
c as (select doc_id, min(other) as component_id from reach group by doc_id)
select d.doc_id, coalesce(n, 0)::bigint as n_shingles, component_id, d.doc_id = component_id as kept from d left join n using (doc_id) join c using (doc_id)
"""

_CHUNK = "('0x' || substr(h, {at}, 5))::bigint"
_BASE32 = " || ".join(f"substr('{BASE32}', ((({_CHUNK.format(at=at)}) >> {shift}) & 31)::integer + 1, 1)" for at in range(1, 41, 5) for shift in (15, 10, 5, 0))

OP6 = f"""
with p as (select page_id, encode(coalesce(html, '')) as body from pages),
q as (select page_id, octet_length(body)::bigint as payload_bytes, upper(sha1(body)) as h from p),
m as (select h, max(page_id) as last from q group by h)
select page_id, payload_bytes, {_BASE32} as payload_digest, case when page_id = last then 'response' else 'revisit' end as record_type,
case when page_id <> last then last end as refers_to from q join m using (h)
"""

OP8 = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as v from embeddings
where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda k: q.v[k] * c.v[k]))::bigint as score
from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 20 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::integer as rank from s)
select query_id, rank, vec_id, score from r where rank <= 20
"""


def _fits(rule) -> str:
    host, path = (x.replace("'", "''") for x in (rule.host, rule.path))
    return f"(host = '{host}' or ends_with(host, '.{host}')) and starts_with(path, '{path}')"


def _glob(rule) -> str:
    like = lambda s: s.replace("'", "''").replace("%", r"\%").replace("_", r"\_").replace("*", "%").replace("?", "_")
    return f"(('.' || host) like '{like(rule.host)}' escape '\\' and path like '{like(rule.path)}' escape '\\')"


_LONGEST = sorted(NAMED, key=lambda r: (-len(r.name), r.verdict != "block", r.name))
OP9 = f"""
with u as (select page_id, {_LOWER.format(r"coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '')")} as host,
coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path from pages),
r as (select *, case {" ".join(f"when {_fits(r)} then '{r.name}'" for r in _LONGEST)} end as rule from u)
select page_id, host, path, rule, case {" ".join(f"when rule = '{r.name}' then '{r.verdict}'" for r in NAMED)}
when {" or ".join(map(_glob, GLOBS))} then 'block' else 'allow' end as verdict from r
"""


def _crc32(bytes_list: str) -> str:
    """The checksum of a list of bytes; ``crc`` is the column of ``crc_table``, which has one row."""
    return f"xor(list_reduce({bytes_list}, lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1]), 4294967295), 4294967295)"


#: One bit of the checksum's polynomial division.
_STEP = "xor({0} >> 1, 3988292384 * ({0} & 1))"


def _crc_table() -> str:
    inner = "select n, n::bigint as x from (select unnest(range(256)) as n)"
    for _ in range(8):
        inner = f"select n, {_STEP.format('x')} as x from ({inner})"
    return f"crc_table as (select list(x order by n) as crc from ({inner}))"


def _bytes(text: str) -> str:
    return f"list_transform(range(0, octet_length(encode({text}))), lambda k: ('0x' || substr(hex(encode({text})), 2 * k + 1, 2))::bigint)"


OP11 = f"""
with {_crc_table()},
t as (select conv_id, turn, length(coalesce(role, ''))::varchar || ':' || coalesce(role, '') || coalesce(text, '') as said, length(coalesce(text, '')) as chars from conversations where conv_id is not null),
p as (select conv_id, sha256(said) as dig, chars, row_number() over (partition by conv_id order by turn nulls first, sha256(said)) as pos from t),
c as (select conv_id, conv_id - conv_id % 100 as family, {_crc32(_bytes("conv_id::varchar"))} % 6 as h from (select distinct conv_id from p), crc_table),
r as (select c.conv_id, 1 as late, pos, dig, chars from c join p using (conv_id) where pos > h
union all select c.conv_id, 0, pos, dig, chars from c join p on p.conv_id = family where pos <= h),
d as (select conv_id, dig, chars, row_number() over (partition by conv_id order by late, pos) as depth from r),
k as (select conv_id, depth, chars, string_agg(dig, '' order by depth) over (partition by conv_id order by depth) as key from d union all select conv_id, 0, 0, '' from c),
ends as (select conv_id, arg_max(key, depth) as key from k group by conv_id),
said as (select key, string_agg(conv_id::varchar, ',' order by conv_id) as ids from ends group by key),
n as (select key, any_value(depth) as depth, any_value(chars) as chars, min(conv_id) as conv_id, count(*) as n_convs from k group by key),
a as (select n.key, up.key as above from n join k up on up.conv_id = n.conv_id and up.depth <= n.depth),
kids as (select above as key, count(*) as n_children from a join n using (key) join n m on m.key = a.above where n.depth = m.depth + 1 group by above),
sums as (select above as key, count(*) filter (where kids.key is null) as n_leaves, sum((n_convs - 1) * chars) as saved from a join n using (key) left join kids using (key) group by above),
parent as (select n.key, m.conv_id as parent_conv_id from n join a using (key) join n m on m.key = a.above where m.depth = n.depth - 1)
select n.conv_id::bigint as conv_id, depth::bigint as depth, parent_conv_id::bigint as parent_conv_id, n_convs::bigint as n_convs, coalesce(n_children, 0)::bigint as n_children,
n_leaves::bigint as n_leaves, saved::bigint as saved_tokens, sha256(coalesce(ids, '')) as ends_sha256
from n join sums using (key) left join kids using (key) left join parent using (key) left join said using (key)
"""

_RUNS = f"regexp_extract_all({_LOWER.format('text')}, '[A-Za-z{chr(0xC0)}-{chr(0xFF)}]+')"

OP13 = f"""
with recursive {_crc_table()},
o as (select doc_id, unnest({_RUNS}) as run from documents),
g as (select doc_id, run, count(*) as n from o group by all),
h as (select run, n, {_crc32(_bytes("coalesce(doc_id::varchar, '') || ':' || run"))} as h from g, crc_table),
s as (select case when h % 97 = 0 then substr(run, 1, (h % length(run))::bigint) || substr(run, (h % length(run))::bigint + 2) else run end as word, n from h),
w as (select word, sum(n)::bigint as n from s where length(word) >= {LEAST_CHARS} group by word having sum(n) >= {LEAST_COUNT}),
cut as (select word, n, k, substr(word, 1, k - 1) as head, substr(word, k + 1) as tail from (select word, n, unnest(range(1, length(word) + 1)) as k from w)),
near as (select x.word, y.word as other, y.n from cut x join cut y on x.k = y.k and x.head = y.head and x.tail = y.tail and x.word <> y.word
union select cut.word, w.word, w.n from cut join w on w.word = head || tail union select w.word, cut.word, cut.n from cut join w on w.word = head || tail),
b as (select word, count(*) as n_near, arg_min(other, (-n, other)) as best, max(n) as best_n from near group by word),
f as (select w.word, w.n, coalesce(n_near, 0)::bigint as n_near, case when best_n >= 2 * w.n then best end as form, case when best_n >= 2 * w.n then best_n end as form_n from w left join b using (word)),
walk as (select word, word as top from f union all select walk.word, f.form from walk join f on f.word = top where f.form is not null)
select f.word, f.form, top as root, f.n, f.n_near, f.form_n::bigint as form_n from f join walk using (word) join f last on last.word = top and last.form is null
"""
