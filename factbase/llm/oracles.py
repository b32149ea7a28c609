"""DuckDB texts of the queries that SQL can express."""

from factbase.llm.urls import LOWER, UPPER

WORDS = r"regexp_extract_all(coalesce({text}, ''), '[^\x20\x09-\x0D]+')"

SUBSTRINGS = f"""
with w as (select doc_id, {WORDS.format(text='text')} as ws from documents),
win as (select doc_id, i, array_to_string(ws[i : i + 19], ' ') as k
    from (select doc_id, ws, unnest(range(1, len(ws) - 18)) as i from w where len(ws) >= 20)),
marks as (select doc_id, i from (select *, row_number() over (partition by k order by doc_id, i) as n from win) where n > 1),
gone as (select distinct doc_id, i + unnest(range(0, 20)) as p from marks),
each as (select doc_id, unnest(ws) as word, unnest(range(1, len(ws) + 1)) as p from w),
kept as (select doc_id, string_agg(word, ' ' order by p) as text from each anti join gone using (doc_id, p) group by doc_id),
lost as (select doc_id, count(*) as n from gone group by doc_id)
select w.doc_id, len(ws) as n_words, coalesce(lost.n, 0) as n_removed, sha256(coalesce(kept.text, '')) as kept_sha256
from w left join kept using (doc_id) left join lost using (doc_id)
"""

NGRAM_JOIN = f"""
with recursive w as (select doc_id, {WORDS.format(text=f"translate(text, '{UPPER}', '{LOWER}')")} as ws from documents),
s as (select distinct doc_id, array_to_string(ws[i : i + 4], ' ') as shingle
    from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) as i from w where len(ws) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
c as (select a.doc_id as a, b.doc_id as b, count(*) as common from s a join s b on a.shingle = b.shingle and a.doc_id <> b.doc_id group by all),
e as (select a, b from c join n x on x.doc_id = a join n y on y.doc_id = b where 100 * common >= 80 * (x.n + y.n - common)),
r(doc_id, other) as (select doc_id, doc_id from w union select r.doc_id, e.b from r join e on r.other = e.a)
select w.doc_id, coalesce(any_value(n.n), 0) as n_shingles, min(r.other) as component_id
from w join r using (doc_id) left join n using (doc_id) group by w.doc_id
"""

TOP_K = """
with v as (
    select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as q from embeddings
    where vec_id is not null and embedding is not null
      and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
    select a.vec_id as query_id, b.vec_id,
           cast(list_sum(list_transform(generate_series(1, len(a.q)), lambda i: a.q[i] * b.q[i])) as bigint) as score
    from v a join v b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= 5
"""

CHAT = """
with t as (select conv_id, coalesce(floor(turn / 512), -1) as part, turn, role, replace(coalesce(text, ''), '<|', '< |') as body from conversations),
m as (select distinct conv_id, role as me from t where trim(role) <> '' and role <> 'system'),
l as (select t.*, me, '<|im_start|>' || case when role = 'system' then role when role = me then 'assistant'
    else 'user name=' || case when trim(coalesce(role, '')) = '' then 'unknown' else role end end || chr(10) as head
    from t join m on t.conv_id is not distinct from m.conv_id),
p as (select *, coalesce(sum(length(head) + length(body) + 11) over (partition by conv_id, me, part
    order by turn nulls first, role nulls first, body rows between unbounded preceding and 1 preceding), 0) + length(head) as start,
    row_number() over (partition by conv_id, me, part order by turn nulls first, role nulls first, body) as n from l)
select conv_id, me as speaker, cast(part as bigint) as part, count(*) as n_turns, string_agg(head || body || '<|im_end|>' || chr(10), '' order by n) as rendered,
    coalesce(string_agg(start || '-' || (start + length(body)), ',' order by n) filter (role = me), '') as spans
from p group by conv_id, me, part
"""


def urls(rules: list[tuple[str, str, str]], steps: int = 20, damping: float = 0.85) -> str:
    values = ", ".join(str(r) for r in rules)
    rounds = []
    for i in range(steps):
        rounds.append(f"""f{i} as materialized (select e.kind, e.target as host, sum(score * share) as got from s{i} s join e on e.kind = s.kind and e.source = s.host group by all),
s{i + 1} as materialized (select coalesce(d.kind, f.kind) as kind, coalesce(d.host, f.host) as host,
    coalesce(seed, 0) * (1 - {damping} * coalesce((select sum(got) from f{i} x where x.kind = coalesce(d.kind, f.kind)), 0)) + {damping} * coalesce(got, 0) as score
    from d full join f{i} f on d.kind = f.kind and d.host = f.host)""")
    return rf"""
with rules(host, path, said) as (values {values}),
p as (select page_id, html, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), '{UPPER}', '{LOWER}') as host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') as path from pages),
fit as (select h.host, h.path, arg_max(r.host || r.path, row(length(r.host || r.path), r.said = 'allow', r.host || r.path)) as rule,
    arg_max(said, row(length(r.host || r.path), r.said = 'allow', r.host || r.path)) as said
    from (select distinct host, path from p) h join rules r on (h.host = r.host or ends_with(h.host, '.' || r.host)) and starts_with(h.path, r.path) group by all),
j as (select p.page_id, p.host, p.path, rule, said from p left join fit using (host, path)),
d as materialized (select kind, host, n / sum(n) over (partition by kind) as seed
    from (select if(said = 'allow', 'trust', 'distrust') as kind, host, cast(count(*) as double) as n from j where said is not null group by all)),
k as (select source, target, count(*) as n from (select host as source, translate(unnest(regexp_extract_all(coalesce(html, ''),
    '(?i)(?:href|src)\s*=\s*["'']?\s*(?:https?:)?//([^/?#"''\s<>]+)', 1)), '{UPPER}', '{LOWER}') as target from p) where source <> '' and source <> target group by all),
e as materialized (select kind, source, target, n / sum(n) over (partition by kind, source) as share from (
    select 'trust' as kind, source, target, n from k union all select 'distrust', target, source, n from k)),
s0 as materialized (select kind, host, seed as score from d),
{", ".join(rounds)},
h as (select host, coalesce(sum(score) filter (kind = 'trust'), 0) as trust, coalesce(sum(score) filter (kind = 'distrust'), 0) as distrust from s{steps} group by host)
select page_id, host, path, rule, coalesce(said, case when coalesce(distrust, 0) > coalesce(trust, 0) then 'block' else 'allow' end) as verdict from j left join h using (host)
"""


def _crc_table() -> list[int]:
    """Remainders of all byte values for the reflected polynomial of CRC-32."""
    out = []
    for c in range(256):
        for _ in range(8):
            c = (c >> 1) ^ (0xEDB88320 if c & 1 else 0)
        out.append(c)
    return out


def sharding(shards: int, vnodes: int, bits: int) -> str:
    """The ring walked step by step: two laps over all virtual nodes in a recursive query."""
    n = shards * vnodes
    return f"""
with recursive tab as (select {_crc_table()}::bigint[] as t),
b as (select doc_id, text, octet_length(encode(text)) as size, list_transform(regexp_extract_all(hex(text), '..'), lambda x: cast('0x' || x as bigint)) as bytes from documents),
c as (select doc_id, coalesce(size, 0) + 16 as size, case when text is not null then
    xor(list_reduce(list_prepend(4294967295::bigint, bytes), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295::bigint) end as text_crc32 from b, tab),
k as (select *, md5(coalesce(cast(doc_id as varchar), 'text-' || text_crc32, 'null')) as digest from c),
nodes as (select i // {vnodes} as shard, md5('node-' || i) as digest from range({n}) t(i)),
arcs as (select cast(row_number() over (order by digest) - 1 as int) as arc, cast(shard as int) as shard, cast('0x' || digest[1:4] as int) >> {16 - bits} as cell from nodes),
cells as (select cell, (select count(*) from arcs where arcs.cell < t.cell) % {n} as arc from range({1 << bits}) t(cell)),
r as (select k.*, arc, row_number() over (order by arc, digest, doc_id nulls first, text_crc32 nulls first, size) - 1 as rank
    from k join cells on cells.cell = cast('0x' || digest[1:4] as int) >> {16 - bits}),
total as (select count(*) as n from r),
steps as (select arc as step, shard, (select count(*) from r where r.arc = arcs.arc) as n from arcs union all select arc + {n}, shard, 0 from arcs),
room as (select list(n // {shards} + case when s < n % {shards} then 1 else 0 end order by s) as room from total, range({shards}) t(s)),
fold(step, waiting, start, free, take, shard, slot) as (
    select -1, 0::bigint, 0::bigint, room, 0::bigint, 0, 0::bigint from room
    union all
    select step, waiting - take, start + take, list_transform(free, lambda f, i: case when i = shard + 1 then f - take else f end), take, shard, room[shard + 1] - free[shard + 1]
    from (select s.step, s.shard, f.free, f.start, f.waiting + s.n as waiting, least(f.waiting + s.n, f.free[s.shard + 1]) as take
        from fold f join steps s on s.step = f.step + 1), room),
takes as (select start - take as start, take, shard, slot from fold where take > 0)
select doc_id, size, text_crc32, 'rows' as law, shard, slot + rank - start as slot, cast(null as int) as grown_shard from r asof join takes on r.rank >= takes.start
"""


def _crc(number: str) -> str:
    """CRC-32 of the decimal digits of a number, with t from the table `tab`."""
    digits = f"list_transform(string_split(cast({number} as varchar), ''), lambda x: cast(ascii(x) as bigint))"
    return (f"xor(list_reduce(list_prepend(4294967295::bigint, {digits}), "
            "lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295::bigint)")


def runs() -> str:
    """Stretches of equal words at each distance, by numbering; the smallest period of each stretch."""
    return f"""
with tab as (select {_crc_table()}::bigint[] as t),
d as (select doc_id, {WORDS.format(text='text')} as ws, {_crc('doc_id')} as h from documents, tab),
n as (select *, len(ws) as n, h // 10 as g from d),
a as (select *, case when h % 10 = 0 and n > 0 then g % n else n end as a from n),
p as (select *, 1 + (n - a) // (3 + g % 8) as p from a),
e as materialized (select doc_id, n, i, ws[case when i >= a then a + (i - a) % p else i end + 1] as word from (select *, unnest(range(n)) as i from p)),
l as (select x.doc_id, x.i, y.i - x.i as q from e x join e y on x.doc_id = y.doc_id and x.word = y.word and y.i > x.i and 3 * (y.i - x.i) <= x.n),
s as (select doc_id, q as period, min(i) as start, count(*) + q as length
    from (select *, i - row_number() over (partition by doc_id, q order by i) as island from l) group by doc_id, q, island),
r as materialized (select doc_id, start, length, min(period) as period from s where length >= greatest(24, 3 * period) group by all),
gone as (select distinct doc_id, i from (select doc_id, unnest(range(start + period, start + length)) as i from r)),
kept as (select doc_id, string_agg(word, ' ' order by i) as text from e anti join gone using (doc_id, i) group by doc_id),
best as (select * from r qualify row_number() over (partition by doc_id order by length / period desc, start, period) = 1),
said as (select doc_id, count(*) as n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' order by start, period) as lines from r group by doc_id)
select d.doc_id, coalesce(n_runs, 0) as n_runs, start, length, period, (1000 * length) // period as exponent_milli,
    sha256(coalesce(lines, '')) as runs_sha256, sha256(coalesce(kept.text, '')) as collapsed_sha256
from d left join best using (doc_id) left join said using (doc_id) left join kept using (doc_id)
"""


def trie() -> str:
    """Prefixes of each rebuilt conversation as strings; subtrees through each node's own ancestors."""
    return f"""
with tab as (select {_crc_table()}::bigint[] as t),
o as (select conv_id, row_number() over (partition by conv_id order by turn nulls first, step) - 1 as pos, step, chars from (
    select conv_id, turn, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) as step, length(coalesce(text, '')) as chars
    from conversations where conv_id is not null)),
c as (select conv_id, {_crc('conv_id')} % 6 as h, conv_id - conv_id % 100 as base from (select distinct conv_id from o), tab),
b as (select c.conv_id, 0 as own, pos, step, chars from c join o on o.conv_id = c.base and pos < h
    union all select conv_id, 1, pos, step, chars from c join o using (conv_id) where pos >= h),
n as (select *, row_number() over (partition by conv_id order by own, pos) as depth from b),
p as materialized (select conv_id, depth, chars, string_agg(step, '') over (partition by conv_id order by depth) as node from n
    union all select conv_id, 0, 0, '' from c),
v as materialized (select node, depth, min(conv_id) as conv_id, count(*) as n_convs, any_value(chars) as chars from p group by node, depth),
u as (select v.*, p.node as up from v left join p on p.conv_id = v.conv_id and p.depth = v.depth - 1),
k as (select up as node, count(*) as n_children from u where up is not null group by up),
w as materialized (select u.*, coalesce(n_children, 0) as n_children, a.conv_id as parent_conv_id from u left join k on k.node = u.node left join v a on a.node = u.up),
s as (select p.node, sum((n_convs - 1) * w.chars) as saved, sum(cast(n_children = 0 as int)) as n_leaves
    from w join p on p.conv_id = w.conv_id and p.depth <= w.depth group by p.node),
e as (select node, sha256(string_agg(conv_id, ',' order by conv_id)) as digest from (select conv_id, max_by(node, depth) as node from p group by conv_id) group by node)
select w.conv_id, w.depth, w.parent_conv_id, w.n_convs, w.n_children, cast(s.n_leaves as bigint) as n_leaves, cast(s.saved as bigint) as saved_tokens,
    coalesce(e.digest, sha256('')) as ends_sha256
from w join s using (node) left join e using (node)
"""
