"""DuckDB statements that must give the rows of the queries."""

from __future__ import annotations

from .mixing import RETENTION, SEED, SWEEPS, TEMPERATURES
from .sharding import PRIME, round_keys

#: The agreed white space for strip, as a DuckDB string.
_STRIP = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

LINES = f"""
with docs as (select doc_id, string_split(coalesce(text, ''), chr(10)) as parts from documents),
lines as (
  select doc_id, pos, parts[pos] as line, translate(trim(parts[pos], {_STRIP}), '{_UPPER}', '{_LOWER}') as key
  from (select doc_id, parts, unnest(range(1, len(parts) + 1)) as pos from docs)
),
common as (
  select key, max(doc_id) as keep from lines where length(key) >= 20
  group by key having count(distinct doc_id) >= 3
),
judged as (select l.*, c.keep is not null and l.doc_id < c.keep as gone from lines l left join common c using (key))
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from judged group by doc_id
"""

EXACT = r"""
with t as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as norm from documents),
g as (select norm, min(doc_id) as keep_id, count(*) as group_size from t group by norm)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(norm) as text_sha256 from t join g using (norm)
"""

#: Sets as word lists; every pair that shares a shingle is counted, then links are followed.
NEAR = rf"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') as w from documents
),
shingles as (
  select distinct doc_id, array_to_string(w[i:i + 2], ' ') as s
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) as i from words where len(w) > 0)
),
sizes as (select doc_id, count(*) as n from shingles group by 1),
shared as (
  select a.doc_id as u, b.doc_id as v, count(*) as c
  from shingles a join shingles b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2
),
near as (
  select u, v from shared join sizes x on x.doc_id = u join sizes y on y.doc_id = v
  where 100 * c >= 85 * (x.n + y.n - c)
),
sym as (select u, v from near union select v, u from near),
reach(id, other) as (select u, u from sym union select r.id, s.v from reach r join sym s on s.u = r.other),
comp as (select id as doc_id, min(other) as component_id from reach group by 1)
select doc_id, coalesce(n, 0) as n_shingles, coalesce(component_id, doc_id) as component_id,
       coalesce(component_id, doc_id) = doc_id as kept
from documents left join sizes using (doc_id) left join comp using (doc_id)
"""


def sharding(shards: int, seed: int) -> str:
    """Row numbers, the same rounds one after the other over the whole domain, then the walk."""
    ctes = [
        "numbered as (select doc_id, octet_length(encode(coalesce(text, ''))) + 1 as size, encode(coalesce(text, '')) as body,"
        " row_number() over (order by doc_id) - 1 as number from documents)",
        "n as (select count(*)::bigint as n, greatest(ceil(sqrt(count(*)))::bigint, 1) as a from documents)",
        "dom as (select n, a, greatest((n + a - 1) // a, 1)::bigint as b from n)",
        "r0 as (select x, x // b as l, x % b as r from dom, lateral (select unnest(range(a * b)) as x))",
    ]
    keys = round_keys(seed)
    for i, (mul, add) in enumerate(keys):
        side = "a" if i % 2 == 0 else "b"
        mixed = f"((r * {mul} + {add}) % {PRIME})"
        ctes.append(
            f"r{i + 1} as (select x, r as l, (l + {mixed} * {mixed} % {PRIME}) % {side} as r from r{i}, dom)"
        )
    ctes.append(f"perm as (select x, l * b + r as y from r{len(keys)}, dom)")
    ctes.append(
        "walk(number, y) as (select x, y from perm, dom where x < n union all"
        " select walk.number, perm.y from walk join perm on perm.x = walk.y, dom where walk.y >= n)"
    )
    ctes.append("placed as (select number, y from walk, dom where y < n)")
    # CRC-32 byte by byte over the usual table, which is computed from its polynomial.
    bits = "list_reduce([x] || range(8), lambda c, k: xor(c >> 1, 3988292384 * (c & 1)))"
    ctes.append(f"crc as (select list_transform(range(256), lambda x: {bits}) as t)")
    ctes.append(
        "bytes as (select doc_id, list_transform(regexp_extract_all(hex(body), '..'), lambda h: ('0x' || h)::bigint) as bs"
        " from numbered)"
    )
    ctes.append(
        "sums as (select doc_id, xor(list_reduce([4294967295::bigint] || bs,"
        " lambda c, v: xor(c >> 8, t[(xor(c, v) & 255) + 1])), 4294967295) as text_crc32 from bytes, crc)"
    )
    return (
        "with recursive " + ",\n".join(ctes) + "\nselect doc_id, size, text_crc32, 'rows' as law,"
        f" (y % {shards})::int as shard, y // {shards} as slot, null::int as grown_shard"
        " from numbered join placed using (number) join sums using (doc_id)"
    )


def urls(rules: list[tuple[str, str, str]], default: str = "allow") -> str:
    values = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in rules)
    return rf"""
with rules(host, path, verdict) as (values {values}),
u as (
  select page_id,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') as host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path
  from pages
),
best as (
  select u.host, u.path, arg_max(r.host || r.path, length(r.host) + length(r.path)) as rule,
         arg_max(r.verdict, length(r.host) + length(r.path)) as verdict
  from (select distinct host, path from u) u join rules r
    on (u.host = r.host or ends_with(u.host, '.' || r.host)) and starts_with(u.path, r.path)
  group by 1, 2
)
select page_id, host, path, rule, coalesce(verdict, '{default}') as verdict
from u left join best using (host, path)
"""


def _mixing() -> str:
    """Every sweep is three statements, one per margin."""
    ctes = [
        r"""keyed as (
  select doc_id, coalesce(source, 'unknown') as source, coalesce(lang, 'unknown') as lang,
         case when contains(text, ' | ') then 'table' when contains(text, 'License') then 'legal'
              when contains(text, '@') then 'contact' else 'prose' end as topic,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as tokens
  from documents)""",
        "cells as (select source, lang, topic, sum(tokens)::double as mass from keyed group by all)",
        "total as (select sum(mass) as total from cells)",
    ]
    for name, power in TEMPERATURES.items():
        ctes.append(
            f"t_{name} as materialized (select {name}, pow(sum(mass), {power}) as p from cells group by 1 having sum(mass) > 0)"
        )
        ctes.append(f"w_{name} as materialized (select {name}, p / (select sum(p) from t_{name}) as target from t_{name})")
    ctes.append("m0 as materialized (select *, mass as m from cells)")
    step = 0
    for _ in range(SWEEPS):
        for name in TEMPERATURES:
            ctes.append(
                f"m{step + 1} as materialized (select m{step}.* exclude (m), coalesce(m * case when sum(m) over (partition by m{step}.{name}) > 0"
                f" then target * total / sum(m) over (partition by m{step}.{name}) end, m) as m"
                f" from m{step} left join w_{name} using ({name}), total)"
            )
            step += 1
    ctes.append(f"f as (select *, case when mass > 0 then m / mass else 0 end as factor from m{step})")
    ctes.append(
        f"need as (select sum(mass) * {RETENTION} as budget, sum(mass) filter (where factor > 0) as whole from f)"
    )
    ctes.append(
        "levels as (select factor, sum(sum(mass)) over (order by factor) as upto,"
        " sum(sum(mass) * factor) over (order by factor) as tail from f where factor > 0 group by factor)"
    )
    ctes.append(
        "scale as (select arg_max((budget - (whole - upto)) / tail, factor) as c from levels, need"
        " where whole - upto + tail / factor >= budget)"
    )
    ctes.append("p as (select f.*, case when factor > 0 then coalesce(least(1, c * factor), 1) end as share from f, scale)")
    return (
        "with " + ",\n".join(ctes) + "\nselect doc_id, source, lang, topic, tokens, round(factor, 6) as weight,"
        " round(coalesce(share, 0), 6) as probability,"
        f" ('0x' || md5('{SEED}|' || doc_id)[1:13])::bigint / 4503599627370496.0 < coalesce(share, 0) as sampled"
        " from keyed join p using (source, lang, topic)"
    )


MIXING = _mixing()


def codes(positions: int = 16, entries: int = 64, rounds: int = 2) -> str:
    """Every part against every entry, round by round."""
    steps = f"""
with kept as (
  select vec_id, label, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as q
  from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
),
parts as (
  select vec_id, p, q[p * (len(q) // {positions}) + 1:(p + 1) * (len(q) // {positions})] as v
  from (select vec_id, q, unnest(range({positions})) as p from kept)
),
books0 as (
  select p, e, v as c from parts
  join (select vec_id, row_number() over (order by vec_id) - 1 as e from kept order by vec_id limit {entries}) using (vec_id)
)"""
    for r in range(rounds + 1):
        steps += f""",
nearest{r} as (
  select vec_id, p, any_value(v) as v,
         min(cast(list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as bigint) * {entries} + e) as best
  from parts join books{r} using (p) group by vec_id, p
)"""
        if r < rounds:
            steps += f""",
means{r} as (
  select p, e, list(mean order by d) as c
  from (
    select p, e, d, cast(floor(sum(x) / count(*)) as bigint) as mean
    from (select p, best % {entries} as e, unnest(range(len(v))) as d, unnest(v) as x from nearest{r})
    group by p, e, d
  ) group by p, e
),
books{r + 1} as (select b.p, b.e, coalesce(m.c, b.c) as c from books{r} b left join means{r} m using (p, e))"""
    return steps + f""",
coded as (
  select vec_id, string_agg(printf('%02x', best % {entries}), '' order by p) as code, cast(sum(best // {entries}) as bigint) as error
  from nearest{rounds} group by vec_id
),
hashed as (
  select sha256(string_agg(x, ',' order by p, e, d)) as codebooks_sha256
  from (select p, e, unnest(range(len(c))) as d, cast(unnest(c) as varchar) as x from books{rounds})
)
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, codebooks_sha256
from coded join kept using (vec_id) cross join hashed
"""


#: Every anchor against every row.
NEGATIVES = """
with kept as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as double)) as q
  from embeddings
  where label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
),
scored as (
  select a.vec_id as anchor_id, r.vec_id as id, a.label = r.label as alike, cast(list_inner_product(a.q, r.q) as bigint) as score
  from kept a join kept r on a.vec_id % 100 = 0
),
positives as (
  select anchor_id, id as positive_id, score as positive_score from scored where alike and id <> anchor_id
  qualify row_number() over (partition by anchor_id order by score desc, id) <= 5
)
select anchor_id, positive_id, cast(row_number() over place as int) as rank, id as negative_id, positive_score, score as negative_score
from positives join scored using (anchor_id)
where not alike and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score
window place as (partition by anchor_id, positive_id order by score desc, id)
qualify row_number() over place <= 10
"""
