"""DuckDB SQL for the queries that SQL can express.

Not here: op1 (alignment), op5 (XXH64), op7 and op10 (fitted models); tests hold those against
brute force. op3's rows of one rank in 30 bits would stand in another order than here.
"""

from __future__ import annotations

from ._common import LOWER, UPPER
from .linededup import BLOCKS, SILENT
from .urlfilter import CONTRACT, SECOND_LEVEL


def _lower(text: str) -> str:
    return f"translate(coalesce({text}, ''), '{UPPER}', '{LOWER}')"


_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_HOST = _lower(r"regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1)")
_PATH = r"coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '')"

_DECONTAMINATE = rf"""with d as (select row_number() over () as rid, doc_id, regexp_extract_all({_lower("text")}, '{_WORD}') as w from documents),
b as (select item_id, w, least(10, len(w)) as m from (select item_id, regexp_extract_all({_lower("text")}, '{_WORD}') as w from benchmark) where len(w) > 0),
win as (select distinct item_id, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) as k from b),
grams as (select rid, m, list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' ')) as ks from d, (select distinct m from win) where len(w) >= m),
runs as (select rid, m, unnest(ks) as k, generate_subscripts(ks, 1) as i from grams),
hits as (select rid, i, m, item_id from runs join win using (m, k)),
cover as (select rid, count(distinct p) as n from (select rid, i + unnest(range(m)) as p from (select distinct rid, i, m from hits)) group by 1),
found as (select rid, count(*) as n, string_agg(item_id::varchar, ',' order by item_id::varchar) as ids from (select distinct rid, item_id from hits where item_id is not null) group by 1)
select doc_id, len(w)::bigint as n_words, coalesce(c.n, 0)::bigint as n_hit, coalesce(f.n, 0)::bigint as n_items, sha256(coalesce(ids, '')) as items_sha256, c.n is not null as contaminated
from d left join cover c using (rid) left join found f using (rid)"""

_MIX = r"""with d as (select doc_id::bigint as doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size, row_number() over () as rid from documents),
t as (select source, sum(size)::bigint as total, avg(sqrt(greatest(size, 1)::double)) as mean from d group by source),
w as (select *, ([5.0, 2.0, 1.0][1 + (row_number() over (order by source nulls last) - 1) % 3])::double as weight, 2.0::double * total as cap from t),
o as (select *, coalesce(sum(cap) over (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding), 0.0) as capped, sum(weight) over (order by cap / weight, source nulls last rows between current row and unbounded following) as free, sum(total) over () as every from w),
l as (select *, (1.5::double * every - capped) / free as level from o),
p as (select source, total, mean, least(cap, coalesce((select level from l where level * weight <= cap order by cap / weight, level limit 1) * weight, cap)) as target from l),
r as (select *, case when total > 0 then target / total else 0.0 end as ratio from p),
f as (select *, floor(ratio) as whole, ratio - floor(ratio) as p, target - floor(ratio) * total as gap from r),
u as (select d.*, f.total, f.target, whole, p, gap, mean, (('0x' || substr(md5('42:' || coalesce(doc_id::varchar, '')), 1, 12))::bigint::double + 0.5::double) / 281474976710656.0::double as u from d join f on d.source is not distinct from f.source),
q as (select *, case when p > 0 then u / (1 - u) / (p / (1 - p) * sqrt(greatest(size, 1)::double) / mean) end as q from u),
k as (select *, least(floor(q / (1 + q) * 1073741824.0::double), 1073741823) as rank from q),
c as (select *, sum(size) over (partition by source order by rank, doc_id rows unbounded preceding) as upto from k where p > 0 and size > 0),
g as (select source, any_value(gap) - coalesce(max(upto) filter (upto <= gap), 0) as rest from c group by source),
e as (select c.rid, row_number() over (partition by c.source order by abs(rest - size), rank, doc_id) as n from c join g on c.source is not distinct from g.source where upto > gap and abs(rest - size) < rest),
taken as (select rid from c where upto <= gap union select rid from e where n = 1)
select doc_id, size, total as source_size, target, ((whole + (rid in (select rid from taken))::int) * size)::bigint as taken from k"""

# CRC-32 by its table, a byte at a time.
_SHARD = """with s as (select doc_id, encode(coalesce(text, '')) as t, list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: case when c % 2 = 1 then xor(3988292384, c // 2) else c // 2 end)) as tbl from documents),
h as (select doc_id, octet_length(t) + 1 as size, xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(regexp_extract_all(hex(t), '..'), lambda x: ('0x' || x)::bigint)), lambda c, x: xor(c // 256, tbl[1 + xor(c, x) % 256]))) as crc from s),
r as (select *, sum(size) over (order by doc_id nulls first, size, crc rows unbounded preceding) as upto, sum(size) over () as total, row_number() over (order by doc_id nulls first, size, crc) as n from h),
g as (select *, least(15, floor(((2 * upto - size) * 16)::double / (2 * total)::double))::int as shard from r)
select doc_id, size::bigint as size, crc::bigint as text_crc32, 'bytes' as law, shard, (n - min(n) over (partition by shard))::bigint as slot, null::int as grown_shard from g"""


def _rules(pick) -> str:
    whens = " ".join(f"when (host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}') then '{pick(v, h, p)}'" for v, h, p in sorted(CONTRACT, key=lambda r: -len(r[1] + r[2])))
    return f"case {whens} end"


def _strength(members: str) -> str:
    """Prior strength of a level, over its members that have outcomes."""
    return f"""(select case when rho is null then 2.0::double else least(1000.0::double, greatest(0.5::double, 1 / greatest(rho, 1e-9::double) - 1)) end as k from
(select sum(power(b / n - m, 2) - m * (1 - m) / n) / nullif(sum(m * (1 - m) * (1 - 1 / n)), 0) as rho from {members} where n > 0))"""


_URLS = rf"""with p as (select page_id, {_HOST} as host, {_PATH} as path from pages),
r as (select *, {_rules(lambda v, h, p: h + p)} as rule, {_rules(lambda v, h, p: v)} as ruling from p),
h0 as (select host, count(ruling)::double as n, count(*) filter (ruling = 'block')::double as b, regexp_replace(host, '^.*@|:[0-9]*$', '', 'g') as bare from r group by host),
h1 as (select *, regexp_extract(bare, '(?:^|\.)((?:{"|".join(SECOND_LEVEL)})\.[a-z]{{2}})$', 1) as two, str_split(bare, '.') as parts from h0),
h2 as (select host, n, b, case when two <> '' then two else parts[-1] end as suffix, array_to_string(parts[greatest(1, len(parts) - case when two <> '' then 2 else 1 end):], '.') as domain from h1),
d0 as (select domain, suffix, sum(n) as n, sum(b) as b from h2 group by all),
s0 as (select suffix, sum(n) as n, sum(b) as b from d0 group by all),
s1 as (select *, coalesce((select sum(b) / nullif(sum(n), 0) from s0), 0.5::double) as m from s0),
s2 as (select suffix, (k * m + b) / (k + n) as m from s1, {_strength("s1")}),
d1 as (select d0.*, m from d0 join s2 using (suffix)),
d2 as (select domain, suffix, (k * m + b) / (k + n) as m from d1, {_strength("d1")}),
h3 as (select h2.*, m from h2 join d2 using (domain, suffix)),
h4 as (select host, k + n + 1 as strength, (k * m + b) / (k + n) as mean from h3, {_strength("h3")})
select page_id, host, path, rule, coalesce(ruling, case when mean - 1.645::double * sqrt(mean * (1 - mean) / strength) > 0.5 then 'block' else 'allow' end) as verdict from r join h4 using (host)"""

_NEAREST = """with v as (select vec_id::bigint as vec_id, embedding::double[] as v from embeddings where vec_id is not null and embedding is not null and len(embedding) > 0
  and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs as (select q.vec_id as query_id, c.vec_id, sqrt(list_reduce(list_transform(list_zip(q.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])), lambda a, x: a + x)) as score from v q join v c on q.vec_id <> c.vec_id and len(q.v) = len(c.v) where q.vec_id % 100 = 0)
select query_id, rank, vec_id, score from (select *, (row_number() over (partition by query_id order by score, vec_id))::int as rank from pairs) where rank <= 10"""

_SPACE = r"[ \t\n\x0B\f\r]"
_LINES = "coalesce(html, '')"
for _pattern, _by in (
    (rf"(?is)<!--.*?-->|<(?:{'|'.join(SILENT)})\b[^>]*>.*?</(?:{'|'.join(SILENT)}){_SPACE}*>", "' '"),
    (rf"(?i)</?(?:{'|'.join(BLOCKS)})(?:(?:{_SPACE}|/)[^>]*)?>", "chr(10)"),
    (r"<[a-zA-Z/!][^>]*>", "''"),
    (r"[ \t\r\f]+", "' '"),
):
    _LINES = f"regexp_replace({_LINES}, '{_pattern}', {_by}, 'g')"

_LINE_DEDUP = f"""with p as (select row_number() over () as rid, page_id, {_HOST} as host, list_filter(list_transform(str_split({_LINES}, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') as lines from pages),
n as (select host, count(*) as pages from p where host <> '' group by 1),
seen as (select host, line, count(*) as c from (select host, unnest(list_distinct(lines)) as line from p where host <> '') group by all),
stock as (select host, line from seen join n using (host) where c >= 3 and c > 0.3::double * pages),
l as (select rid, host, unnest(lines) as line, generate_subscripts(lines, 1) as i from p),
kept as (select rid, count(*) as c, string_agg(line, chr(10) order by i) as text from l anti join stock using (host, line) group by 1)
select page_id, host, len(lines)::int as n_lines, (len(lines) - coalesce(c, 0))::int as n_dropped, coalesce(text, '') as text from p left join kept using (rid)"""

_SECONDS = "floor(epoch_us({}) / 1000000::double)::bigint"
_CONCURRENCY = f"""with e as (select sale_id, min(shipped_at) as shipped from sale_lines where sale_id is not null group by 1),
c as (select client_id, min(nation_id) as nation_id from clients where client_id is not null group by 1),
s as (select coalesce(c.nation_id, -1) as nation_id, {_SECONDS.format("sold_at")} as start, {_SECONDS.format("shipped")} + 86400 as stop, coalesce(floor(100 * total + 0.5)::bigint, 0) as cents
  from sales left join e using (sale_id) left join c using (client_id) where sold_at is not null),
o as (select nation_id, start, stop, cents from s where stop is null or stop > start union all select -2, start, stop, cents from s where stop is null or stop > start),
x as (select nation_id, start as t, 1 as n, cents as v from o union all select nation_id, stop, -1, -cents from o where stop is not null),
d as (select nation_id, t, sum(n) as n, sum(v) as v from x group by all having sum(n) <> 0 or sum(v) <> 0),
r as (select nation_id, t, lead(t) over w as nxt, sum(n) over w as n, sum(v) over w as v from d window w as (partition by nation_id order by t)),
h as (select *, max(n) over (partition by nation_id order by t) as high, max(v) over (partition by nation_id) as peak from r)
select nation_id::int as nation_id, t as from_s, nxt as to_s, n::bigint as n_open, v::bigint as open_cents, high::bigint as high_open, v = peak as is_peak from h"""

ORACLES: dict[str, str] = {
    "op2_decontaminate": _DECONTAMINATE,
    "op3_mix": _MIX,
    "op4_shard": _SHARD,
    "op6_url_filter": _URLS,
    "op8_nearest": _NEAREST,
    "op9_line_dedup": _LINE_DEDUP,
    "op12_peak_concurrency": _CONCURRENCY,
}
