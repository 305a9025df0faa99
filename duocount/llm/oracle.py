"""DuckDB SQL for the operators that SQL can express; each states the contract on its own."""

from __future__ import annotations

from duocount.llm import quality_rules as rules
from duocount.llm import url_filter, vector_codes

_WS = "(' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
SETTLED = 160   # steps after which link ranks move by less than 2 * 0.85 ** 160 = 1e-11 in all
_UPPER, _LOWER = url_filter.UPPER, url_filter.LOWER


def _words(t: str) -> str:
    return f"case when trim({t}, {_WS}) = '' then [] else regexp_split_to_array(trim({t}, {_WS}), '[ \\t-\\r]+') end"


def _bucket(v: str) -> str:
    return f"case when {v} < 64 then {v} else (length(bin({v})) - 6) * 32 + ({v} >> (length(bin({v})) - 6)::bigint) end"


def _bucket_value(b: str) -> str:
    return f"case when {b} < 64 then {b} else ({b} - (({b} - 32) // 32) * 32) << (({b} - 32) // 32)::bigint end"


def _quality_rules() -> str:
    levels = []
    shares = (("bottom", rules.BOTTOM), ("middle", rules.MIDDLE), ("top", rules.TOP))
    least = "min(case when seen * 1000 >= total * {} then bucket end)"
    quantiles = ", ".join(f"({_bucket_value(least.format(s))})::DOUBLE as {name}" for name, s in shares)
    for depth, own in ((2, ["lang", "source"]), (1, ["lang"]), (0, [])):
        by = ", ".join([*own, "measure"])
        levels.append(f"""
h{depth} as (select {by}, bucket, sum(n) as n from sk group by all),
r{depth} as (select *, sum(n) over (partition by {by} order by bucket) as seen, sum(n) over (partition by {by}) as total from h{depth}),
q{depth} as (select {by}, max(total)::DOUBLE / (max(total) + {rules.PRIOR}) as weight, {quantiles} from r{depth} group by {by})""")
    joins = " ".join(
        f"left join q{d} on " + " and ".join([f"g.measure = q{d}.measure", *[f"g.{k} is not distinct from q{d}.{k}" for k in own]])
        for d, own in ((2, ["lang", "source"]), (1, ["lang"]), (0, [])))
    drawn = ", ".join(f"q2.weight * q2.{x} + (1 - q2.weight) * (q1.weight * q1.{x} + (1 - q1.weight) * q0.{x}) as {x}" for x, _ in shares)
    low = ", ".join(f"'{m}'" for m, both in rules.MEASURES.items() if both)
    return f"""
with d as (select row_number() over () as rid, doc_id, lang, source, coalesce(text, '') as t from documents),
w as (select rid, doc_id, lang, source, t, {_words('t')} as w,
  list_filter(string_split(t, chr(10)), lambda x: trim(x, {_WS}) <> '') as ln from d),
win as (select rid, i, w[i] as a, w[i + 1] as b, w[i + 2] as c from (select rid, w, unnest(range(1, len(w) - 1)) as i from w)),
rep as (select rid, i from (select *, count(*) over (partition by rid, a, b, c) as n from win) where n > 1),
cov as (select rid, count(distinct i + o) as n from rep, (values (0), (1), (2)) as x(o) group by rid),
c as (select w.rid, doc_id, lang, source, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, (len(ln) - len(list_distinct(ln)))::bigint as n_dup_lines,
  coalesce(cov.n, 0)::bigint as n_repeat_words, len(ln)::bigint as n_lines,
  length(regexp_replace(t, '[^A-Z]', '', 'g'))::bigint as n_capitals, length(regexp_replace(t, '[^!]', '', 'g'))::bigint as n_bangs
  from w left join cov on cov.rid = w.rid),
m as (select *, (n_words < {rules.MIN_WORDS} or 100 * n_repeat_words > 50 * n_words) as base_failed,
  word_chars * 100 // greatest(n_words, 1) as word_length, n_symbols * 1000 // greatest(n_words, 1) as symbols,
  n_dup_lines * 1000 // greatest(n_lines, 1) as dup_lines, n_repeat_words * 1000 // greatest(n_words, 1) as repeat_words,
  n_capitals * 1000 // greatest(word_chars, 1) as capitals, n_bangs * 1000 // greatest(n_words, 1) as bangs from c),
u as (select rid, base_failed, lang, source, measure, v from m unpivot (v for measure in (word_length, symbols, dup_lines, repeat_words, capitals, bangs))),
sk as (select lang, source, measure, {_bucket('v')} as bucket, count(*) as n from u where not base_failed group by all),
{",".join(levels)},
g as (select distinct lang, source, measure from sk),
f as (select g.lang, g.source, g.measure, {drawn} from g {joins}),
fence as (select lang, source, measure, top + {rules.REACH} * (top - middle) as high,
  case when measure in ({low}) then bottom - {rules.REACH} * (middle - bottom) else -1 end as low from f),
bad as (select distinct u.rid from u join fence f on u.measure = f.measure and u.lang is not distinct from f.lang
  and u.source is not distinct from f.source where u.v > f.high or u.v < f.low)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  (not base_failed and rid not in (select rid from bad)) as kept from m"""


def _shingles(rows: str, row_id: str, lower: str, k: int = 5) -> str:
    """CTEs w_<rows> and s_<rows> (row_id, distinct shingles) of a table."""
    return f"""
w_{rows} as (select {row_id}, {_words('t')} as w from (select {row_id}, {lower} as t from {rows} where {row_id} is not null)),
s_{rows} as (select distinct {row_id}, unnest(case when len(w) = 0 then [] when len(w) < {k} then [w]
  else list_transform(range(1, len(w) - {k} + 2), lambda i: w[i:i + {k} - 1]) end) as s from w_{rows})"""


def _jaccard_join() -> str:
    return f"""
with recursive {_shingles('documents', 'doc_id', f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')")},
n as (select doc_id, count(*) as n from s_documents group by 1),
p as (select a.doc_id as u, b.doc_id as v, count(*) as i from s_documents a join s_documents b on a.s = b.s and a.doc_id <> b.doc_id group by 1, 2),
e as (select u, v from p join n a on a.doc_id = u join n b on b.doc_id = v where 100 * i >= 75 * (a.n + b.n - i)),
r(doc_id, c) as (select doc_id, doc_id from documents union select r.doc_id, e.v from r join e on r.c = e.u)
select d.doc_id, coalesce(max(n.n), 0)::bigint as n_shingles, min(r.c)::bigint as component_id
from documents d join r on r.doc_id = d.doc_id left join n on n.doc_id = d.doc_id group by d.doc_id"""


def _url_filter(rule_list) -> str:
    ordered = sorted(rule_list, key=lambda r: (-len(r.text), r.text))
    fits = [(f"(host = '{r.host}' or ends_with(host, '.{r.host}')) and starts_with(path, '{r.path}')", r) for r in ordered]
    case = lambda what: "case " + " ".join(f"when {f} then '{getattr(r, what)}'" for f, r in fits) + " end"
    return f"""
with recursive a as (select page_id, html, case when contains(url, '://') then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
b as (select page_id, html, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') as host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from a),
c as (select page_id, host, path, {case('text')} as rule, {case('verdict')} as ruled from b),
l as (select host as src, translate(unnest(regexp_extract_all(coalesce(html, ''), '(?i)href\\s*=\\s*["'']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"''<>\\s]+)', 1)),
  '{_UPPER}', '{_LOWER}') as dst from b where host <> ''),
h as (select distinct host from (select host from b where host <> '' union all select dst from l)),
f as (select distinct array_to_string(l[i:], '.') as host, array_to_string(l[i + 1:], '.') as parent
  from (select l, unnest(range(1, len(l) - 1)) as i from (select string_split(host, '.') as l from h))),
e as (select src, dst, count(*) as weight from (select src, dst from l union all select host, parent from f
  union all select parent, host from f) where src <> dst group by all),
x as (select 'trust' as kind, src, dst, weight from e union all select 'distrust', dst, src, weight from e),
share as (select kind, src, dst, weight / sum(weight) over (partition by kind, src) as share from x),
m as (select case when ruled = 'allow' then 'trust' else 'distrust' end as kind, host, count(*) as mass from c
  where ruled is not null and host <> '' group by all),
seed as (select kind, host, mass / sum(mass) over (partition by kind) as rank from m),
r(step, kind, host, rank) as (select 0, kind, host, rank from seed union all
  select step + 1, kind, host, sum(rank) from (
    select step, s.kind, s.dst as host, r.rank * s.share * {url_filter.DAMPING} as rank from r join share s on s.kind = r.kind and s.src = r.host
    union all select step, kind, host, rank * (1 - {url_filter.DAMPING}) from seed, (select distinct step from r))
  where step < {SETTLED} group by step, kind, host),
v as (select host, sum(case when kind = 'trust' then rank else 0 end) as trust, sum(case when kind = 'distrust' then rank else 0 end) as distrust
  from r where step = {SETTLED} group by host)
select page_id, c.host, path, rule, coalesce(ruled, case when distrust > trust * {url_filter.RATIO} + {url_filter.MARGIN} then 'block' else 'allow' end) as verdict
from c left join v on v.host = c.host"""


def _decontaminate() -> str:
    return f"""
with {_shingles('documents', 'doc_id', "lower(coalesce(text, ''))")},
{_shingles('benchmark', 'item_id', "lower(coalesce(text, ''))")},
n as (select item_id, count(*) as n from s_benchmark group by 1),
p as (select doc_id, item_id, count(*) as i from s_documents join s_benchmark using (s) group by 1, 2)
select doc_id, item_id, n::bigint as n_shingles, i::bigint as n_shared, i / n as containment from p join n using (item_id) where i * 100 >= n * 75"""


def _merkle() -> str:
    def path(tree: str, node: str, match: str) -> str:
        at = f"(({node} >> (4 * s.level)) % 16)"
        return (f"select l.rid, '{tree}' as tree, s.level, substr(s.s, 1, {at} * 64) || ',' || substr(s.s, {at} * 64 + 65) as x "
                f"from {match} and s.run = {node} >> (4 * s.level + 4)")

    field = lambda c: f"case when {c} is null then '-' else strlen({c}::varchar) || ':' || {c}::varchar end"
    row = " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars"))
    changed = f"translate(text, '{_UPPER}', '{_LOWER}')"
    return f"""
with recursive
crc as (select list(list_reduce(range(8), lambda a, i: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end, b) order by b) as t
  from range(256) as r(b)),
d as (select row_number() over () as rid, doc_id, source, sha256({row} || {field('text')}) as leaf,
  sha256({row} || {field(changed)}) as changed, xor(list_reduce(list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint),
  lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1]), 4294967295), 4294967295) as crc from documents, crc),
l as (select *, row_number() over (partition by source order by doc_id nulls first, leaf, rid) - 1 as pos, count(*) over (partition by source) as n from d),
lv(source, level, pos, h, n) as (select source, 0, pos, leaf, n from l union all
  select source, level + 1, pos >> 4, sha256(string_agg(h, '' order by pos)), (max(n) + 15) >> 4 from lv where n > 1 group by source, level, pos >> 4),
sub as (select source, h, row_number() over (order by source nulls first) - 1 as pos, count(*) over () as n from lv where n = 1),
tv(level, pos, h, n) as (select 0, pos, h, n from sub union all
  select level + 1, pos >> 4, sha256(string_agg(h, '' order by pos)), (max(n) + 15) >> 4 from tv where n > 1 group by level, pos >> 4),
runs as (select source, level, pos >> 4 as run, string_agg(h, '' order by pos) as s from lv where n > 1 group by all),
tops as (select level, pos >> 4 as run, string_agg(h, '' order by pos) as s from tv where n > 1 group by all),
steps as ({path('a', 'l.pos', 'l join runs s on s.source is not distinct from l.source')} union all
  {path('b', 'sub.pos', 'l join sub on sub.source is not distinct from l.source join tops s on true')}),
p as (select rid, list(x order by tree, level) as p from steps group by rid),
f as (select l.*, sub.h as subroot, coalesce(p.p, []) as p, (select h from tv where n = 1) as root
  from l join sub on sub.source is not distinct from l.source left join p using (rid)),
g as (select *, list_reduce(p, lambda a, x: sha256(split_part(x, ',', 1) || a || split_part(x, ',', 2)),
  case when crc % 5 = 0 then changed else leaf end) as folded_root from f)
select doc_id, leaf, subroot, root, sha256(replace(array_to_string(p, ''), ',', '')) as proof_sha256, folded_root, folded_root = root as verified from g"""


def _substring_dedup() -> str:
    return f"""
with d as (select row_number() over () as rid, doc_id, {_words("coalesce(text, '')")} as w from documents),
win as (select rid, i, md5(array_to_string(w[i:i + 34], ' ')) as h from (select rid, w, unnest(range(1, len(w) - 33)) as i from d where len(w) >= 35)),
rep as (select rid, i from (select *, count(*) over (partition by h) as n from win) where n > 1),
cov as (select distinct rid, i + o as i from rep, range(35) as r(o)),
word as (select rid, unnest(w) as word, unnest(range(1, len(w) + 1)) as i from d),
kept as (select rid, string_agg(word, ' ' order by i) as t, count(*) as n from word anti join cov using (rid, i) group by rid)
select doc_id, len(w)::bigint as n_words, (len(w) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(t, '')) as kept_sha256 from d left join kept using (rid)"""


def _vector_codes() -> str:
    steps = []
    for r in range(vector_codes.ROUNDS + 1):
        steps.append(f"""
a{r} as materialized (select rid, p.k, min(list_sum(list_transform(range(1, len(p.x) + 1), lambda i: (p.x[i] - b.x[i]) * (p.x[i] - b.x[i])))::bigint * 256 + e) as m
  from p join b{r} b on p.k = b.k group by rid, p.k)""")
        if r < vector_codes.ROUNDS:
            steps.append(f"""
s{r} as (select k, m % 256 as e, i, sum(x) as s, count(*) as c from (select p.k, m, unnest(p.x) as x, unnest(range(1, len(p.x) + 1)) as i
  from p join a{r} a on p.rid = a.rid and p.k = a.k) group by all),
b{r + 1} as materialized (select b.k, b.e, coalesce(n.x, b.x) as x from b{r} b left join
  (select k, e, list(((s - ((s % c) + c) % c) // c)::bigint order by i) as x from s{r} group by k, e) n on b.k = n.k and b.e = n.e)""")
    last = vector_codes.ROUNDS
    return f"""
with s as (select vec_id, label, embedding from embeddings where len(embedding) > 0
  and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
one as (select len(embedding) as w from s order by vec_id nulls last, embedding limit 1),
v as (select *, row_number() over (order by vec_id nulls last, embedding) as rid from s, one where len(embedding) = w and w % 4 = 0),
p as materialized (select rid, k, list_transform(embedding[k * w // 4 + 1:(k + 1) * w // 4], lambda x: floor(1024 * x::double)::bigint) as x from v, range(4) as r(k)),
b0 as (select k, rid - 1 as e, x from p where rid <= 256),
{",".join(steps)},
c as (select rid, string_agg(format('{{:02x}}', m % 256), '' order by k) as code, sum(m // 256)::bigint as error from a{last} group by rid),
h as (select sha256(string_agg(array_to_string(x, ','), ',' order by k, e)) as codebooks_sha256 from b{last})
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, codebooks_sha256 from v join c using (rid), h"""


def _oracles() -> dict[str, str]:
    found = {"op11_merkle_manifest": _merkle(), "op12_substring_dedup": _substring_dedup(),
             "op13_vector_codes": _vector_codes(),
             "op1_quality_rules": _quality_rules(), "op3_jaccard_join": _jaccard_join(), "op5_decontaminate": _decontaminate()}
    rule_list = [url_filter.rule(*r) for r in (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"),
                                               ("allow", "com/fr/"), ("block", "com/de/"))]
    return {**found, "op4_url_filter": _url_filter(rule_list)}


ORACLES = _oracles()
