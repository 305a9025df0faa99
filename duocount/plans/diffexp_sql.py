"""DuckDB SQL of the differential-abundance chain (D04-D16), step by step as views over the pool views.

It shares nothing with the library's code but the constants of the method: dispersions are found by halving
a bracket on the slope of the adjusted likelihood, group means by a recursive fit, the trend by a recursive
IRLS with local lines where that fails, the smoother and both principal axes by plain SQL.
"""

from __future__ import annotations

from duocount.operators.diffexp import dispersion as D
from duocount.operators.diffexp import fit as FT
from duocount.operators.diffexp import nbmath as M
from duocount.operators.diffexp import pca as P
from duocount.operators.diffexp import select as SEL
from duocount.operators.diffexp import trend as TR

HALVINGS = 70


def _log1p(x: str) -> str:
    return f"(case when abs({x}) < 0.01 then ({x}) * (1 - ({x}) * (1.0/2 - ({x}) * (1.0/3 - ({x}) * (1.0/4 - ({x}) * (1.0/5 - ({x}) * (1.0/6 - ({x}) / 7)))))) else ln(1 + ({x})) end)"


def _st(z: str) -> str:
    return f"((1.0/12 - (1.0/360 - (1.0/1260 - (1.0/1680 - 1.0/1188 / ({z}*{z})) / ({z}*{z})) / ({z}*{z})) / ({z}*{z})) / {z})"


def _st1(z: str) -> str:
    return f"(-0.5/{z} - (1.0/12 - (1.0/120 - (1.0/252 - (1.0/240 - 1.0/132 / ({z}*{z})) / ({z}*{z})) / ({z}*{z})) / ({z}*{z})) / ({z}*{z}))"


_PRODUCT = " * ".join(f"((r + {i}) / (r + y + {i}))" for i in range(10))
_SHIFT = " + ".join(f"y / ((r + {i}) * (r + y + {i}))" for i in range(10))
_LL = (f"((r + 9.5) * {_log1p('y / (r + 10)')} + {_st('(r + 10 + y)')} - {_st('(r + 10)')} + ln({_PRODUCT}) - y "
       f"+ y * {_log1p('(10 + y - mu) / (mu + r)')} - r * {_log1p('mu / r')})")
_SLOPE = (f"({_log1p('y / (r + 10)')} + {_st1('(r + 10 + y)')} - {_st1('(r + 10)')} + {_SHIFT} + (mu - y) / (mu + r) - {_log1p('mu / r')})")


def _search(name: str, prior: str) -> list[tuple[str, str]]:
    """Views that find the log dispersion of every gene of ``cell`` (``prior``: '' or a table of entity_id, m, v)."""
    lo, hi = f"ln({D.MIN_DISP} / 10)", "ln(greatest(10.0, (select count(*) from smps)))"
    join = f"join {prior} p using (entity_id)" if prior else ""
    minus = "- (la - m) * (la - m) / (2 * v)" if prior else ""
    slope = "- (la - m) / v" if prior else ""
    by = "entity_id, la, m, v" if prior else "entity_id, la"
    grid = f"""select entity_id, k, la {', any_value(m) as m, any_value(v) as v' if prior else ''}, sum(ll) as ll, sum(cr) as cr from (
  select entity_id, k, la, condition {', m, v' if prior else ''}, sum({_LL}) as ll, -0.5 * ln(sum(mu / (1 + mu / r))) as cr
  from (select *, exp(-la) as r from cell {join}, (select k, {lo} + k * ({hi} - {lo}) / {M.COARSE - 1} as la from range({M.COARSE}) as g(k)))
  group by all) group by entity_id, k, la"""
    return [
        (f"{name}_grid", grid),
        (f"{name}_top", f"select entity_id, arg_max(k, ll + cr {minus}) as k from {name}_grid group by 1"),
        (name, f"""
  with recursive s(entity_id, low, high, it) as (
    select entity_id, {lo} + greatest(k - 1, 0) * ({hi} - {lo}) / {M.COARSE - 1}, {lo} + least(k + 1, {M.COARSE - 1}) * ({hi} - {lo}) / {M.COARSE - 1}, 0 from {name}_top
    union all
    select entity_id, case when d > 0 then la else low end, case when d > 0 then high else la end, it + 1 from (
      select entity_id, la, any_value(low) as low, any_value(high) as high, any_value(it) as it,
             sum(one) + sum(two) {slope} as d {', m, v' if prior else ''} from (
        select entity_id, la, low, high, it, condition {', m, v' if prior else ''}, sum(-r * {_SLOPE}) as one, 0.5 / r * sum(w * w) / sum(w) as two
        from (select *, mu / (1 + mu / r) as w from (select *, exp(-la) as r from (select *, (low + high) / 2 as la from s where it < {HALVINGS}) join cell using (entity_id) {join}))
        group by entity_id, la, low, high, it, r, condition {', m, v' if prior else ''}) group by {by}))
  select entity_id, (low + high) / 2 as la from s where it = {HALVINGS}""")]


_TREND = f"""
  with recursive s(it, a0, a1, b0, b1, inn, outr, status) as (
    select 0, 0.1::DOUBLE, 1.0::DOUBLE, 0.1::DOUBLE, 1.0::DOUBLE, 0, 0, 0
    union all
    select it + 1, case when done and status = 0 then n0 else a0 end, case when done and status = 0 then n1 else a1 end, n0, n1,
           case when done then 0 else inn + 1 end, case when done then outr + 1 else outr end,
           case when done and (n0 <= 0 or n1 <= 0) then 2
                when done and pow(ln(n0 / a0), 2) + pow(ln(n1 / a1), 2) < {D.TREND_TOL} then 1
                when done and outr + 1 >= {D.TREND_MAX_OUTER} then 2
                when not done and ((n0 <= 0 and n1 <= 0) or inn + 1 >= {D.TREND_MAX_INNER}) then 2 else 0 end
    from (select *, abs(n0 - b0) <= {D.TREND_INNER_TOL} * (abs(b0) + 1e-12) and abs(n1 - b1) <= {D.TREND_INNER_TOL} * (abs(b1) + 1e-12) as done from (
      select it, a0, a1, b0, b1, inn, outr, status, (wy * wxx - wx * wxy) / (w * wxx - wx * wx) as n0, (w * wxy - wx * wy) / (w * wxx - wx * wx) as n1 from (
        select it, a0, a1, b0, b1, inn, outr, status, sum(w) as w, sum(w * x) as wx, sum(w * x * x) as wxx, sum(w * y) as wy, sum(w * x * y) as wxy from (
          select s.*, x, y, 1 / ((b0 + b1 * x) * (b0 + b1 * x)) as w from s join (select 1 / basemean as x, disp as y from usable) on true
          where status = 0 and it < 300 and y / (a0 + a1 * x) > {D.TREND_RESID_RANGE[0]} and y / (a0 + a1 * x) < {D.TREND_RESID_RANGE[1]})
        group by it, a0, a1, b0, b1, inn, outr, status)))
    where n0 is not null)
  select b0 as a0, b1 as a1 from s where status = 1"""

_BINS = f"""select bin, (bin + 0.5) * {TR.BIN_WIDTH} as c, count(*) as n, sum(basemean) as w, sum(basemean * ln(basemean)) as wx, sum(basemean * ln(disp)) as wy,
  sum(basemean * ln(basemean) * ln(basemean)) as wxx, sum(basemean * ln(basemean) * ln(disp)) as wxy
  from (select *, floor(ln(basemean) / {TR.BIN_WIDTH}) as bin from usable) group by bin"""

_REACH = f"""select c, min(far) as reach from (
    select a.c as c, abs(b.c - a.c) as far, sum(b.n) over (partition by a.c order by abs(b.c - a.c), b.c rows unbounded preceding) as seen, sum(b.n) over (partition by a.c) as total
    from bins a join bins b on true) where seen >= {TR.NEAREST} * total group by c"""

_KNOTS = f"""select c, my + (case when xx > 1e-9 then xy / xx else 0 end) * (c - mx) as v from (
    select c, sx / sw as mx, sy / sw as my, sxx / sw - (sx / sw) * (sx / sw) as xx, sxy / sw - (sx / sw) * (sy / sw) as xy from (
      select c, sum(t * w) as sw, sum(t * wx) as sx, sum(t * wy) as sy, sum(t * wxx) as sxx, sum(t * wxy) as sxy from (
        select a.c as c, b.w, b.wx, b.wy, b.wxx, b.wxy, pow(1 - pow(least(abs(b.c - a.c) / (reach + {TR.BIN_WIDTH}), 1), 3), 3) as t
        from bins a join reach r on r.c = a.c join bins b on true) group by c))"""

#: knots with their neighbours, so that a value is interpolated by one range join
_LINES = "select c, v, lead(c) over (order by c) as c2, lead(v) over (order by c) as v2, row_number() over (order by c) as nth from knots"


def _local(x: str, table: str, keys: str) -> str:
    """Local log dispersion at log mean ``x`` for the rows of ``table``."""
    return f"""select {keys}, case when c2 is null or {x} <= c then v else v + ({x} - c) * (v2 - v) / (c2 - c) end as lv from {table} join lines
  on ({x} > c and ({x} <= c2 or c2 is null)) or (nth = 1 and {x} <= c)"""


_ERFC = """case when x > 6 then 0 when x = 0 then 1 else 1 - 2 / sqrt(pi()) * exp(-x * x) * list_sum(list_transform(range(220),
  lambda n: exp(2 * n * ln(2) + lgamma(n + 1) - lgamma(2 * n + 2) + (2 * n + 1) * ln(x)))) end"""


def _trim(values: str, n: str, share: str) -> str:
    k = f"floor({n} * ({share}))::bigint"
    return f"list_avg(list_sort({values})[{k} + 1:{n} - {k}])"


_SHARE = "case when {n} <= 3 then 1.0::DOUBLE / 3 when {n} <= 23 then 1.0::DOUBLE / 4 else 1.0::DOUBLE / 8 end"
_SCALE = f"case when n <= 3 then {FT.ROBUST_SCALE[0]} when n <= 23 then {FT.ROBUST_SCALE[1]} else {FT.ROBUST_SCALE[2]} end"

USABLE = ("usable", f"select * from disp where disp >= {100 * D.MIN_DISP}")

DISPERSION_VIEWS = [
    ("q", "select entity_id, sample, condition, cnt::DOUBLE as y, size_factor as sf, cnt / size_factor as q from pm join sfac using (sample)"),
    ("cell", f"""select *, greatest(avg(q) over (partition by entity_id, condition) * sf, {D.MIN_MU}) as mu, avg(q) over (partition by entity_id) as basemean from q"""),
    *_search("gene", ""),
    ("disp", f"""select entity_id, basemean, least(greatest(exp(la), {D.MIN_DISP}), greatest(10.0, (select count(*) from smps))) as disp
  from gene join (select distinct entity_id, basemean from cell) using (entity_id)"""),
    USABLE, ("coef", _TREND), ("bins", _BINS), ("reach", _REACH), ("knots", _KNOTS), ("lines", _LINES),
    ("locals", _local("ln(basemean)", "disp", "entity_id")),
    ("fitted", """select d.*, coalesce((select a0 + a1 / basemean from coef), exp(lv)) as fit from disp d join locals using (entity_id)"""),
    ("resid", f"select ln(disp) - ln(fit) as r from fitted where disp >= {100 * D.MIN_DISP}"),
    ("spread", f"""select {D.MAD_SCALE} * median(abs(r - (select median(r) from resid))) as sd from resid"""),
    # the sampling variance of log dispersion is trigamma(n) with n = (samples - 2) / 2, a whole number here
    ("prior", f"""select entity_id, ln(fit) as m, (select greatest(sd * sd - (pi() * pi() / 6 - coalesce(list_sum(list_transform(
    range(1, ((select count(*) from smps) - 2) // 2), lambda k: 1.0 / (k * k))), 0)), {D.PRIOR_VAR_FLOOR}) from spread) as v from fitted"""),
    *_search("mapped", "prior"),
    ("alpha", f"""select entity_id, f.basemean, disp, fit, case when ln(disp) > ln(fit) + {D.OUTLIER_SD} * (select sd from spread) then disp
    else least(greatest(exp(la), {D.MIN_DISP}), greatest(10.0, (select count(*) from smps))) end as a from fitted f join mapped using (entity_id)"""),
]

TEST_VIEWS = [
    *DISPERSION_VIEWS,
    ("means", f"""
  with recursive s(entity_id, condition, b, it) as (
    select entity_id, condition, ln(greatest(avg(y) / avg(sf), {D.MIN_MU} / avg(sf))), 0 from cell group by 1, 2
    union all
    select entity_id, condition, sum(w * (ln(m / sf) + (y - m) / m)) / sum(w), it + 1 from (
      select entity_id, condition, it, y, sf, m, m / (1 + a * m) as w from (
        select s.entity_id, s.condition, it, y, sf, a, greatest(sf * exp(b), {D.MIN_MU}) as m
        from s join cell c on c.entity_id = s.entity_id and c.condition = s.condition join alpha a on a.entity_id = s.entity_id where it < 40))
    group by entity_id, condition, it)
  select entity_id, condition, b from s where it = 40"""),
    ("fits", f"""select *, sum(w) over (partition by entity_id, condition) as sw from (select *, m / (1 + a * m) as w from (
    select c.entity_id, c.condition, c.y, c.q, b, a, greatest(sf * exp(b), {D.MIN_MU}) as m from cell c join means using (entity_id, condition) join alpha using (entity_id)))"""),
    ("wald", """select entity_id, (max(b) filter (where condition = 'test') - max(b) filter (where condition = 'control')) / ln(2) as lfc,
    sqrt(sum(v)) / ln(2) as se from (select entity_id, condition, any_value(b) as b, 1 / any_value(sw) as v from fits group by 1, 2) group by 1"""),
    ("sizes", "select condition, count(*) as n from smps group by 1"),
    ("robust", f"""select entity_id, greatest((max({_SCALE} * v) - any_value(m)) / (any_value(m) * any_value(m)), {FT.ROBUST_MIN_DISP}) as rob from (
    select entity_id, n, m, {_trim('list_transform(l, lambda x: (x - cm) * (x - cm))', 'n', _SHARE.replace('{n}', 'n'))} as v from (
      select entity_id, n, l, {_trim('l', 'n', _SHARE.replace('{n}', 'n'))} as cm, m from (
        select entity_id, any_value(n) as n, list(q) as l, any_value(basemean) as m from cell join sizes using (condition) where n >= 3 group by entity_id, condition))) group by 1"""),
    ("cooks", """select entity_id, max(d) filter (n >= 3) as cooks, list(y) as ys, arg_max(y, d) filter (isfinite(d)) as worst from (
    select entity_id, n, y, (y - m) * (y - m) / (m + rob * m * m) / 2 * (w / sw) / pow(1 - w / sw, 2) as d
    from fits join robust using (entity_id) join sizes using (condition)) group by 1"""),
    ("tests", f"""select entity_id, basemean, lfc, se, lfc / se as stat, {_ERFC} as p, cooks, len(list_filter(ys, lambda y: y > worst)) as n_above, disp, fit, a
    from (select *, abs(lfc / se) / sqrt(2) as x from wald join alpha using (entity_id) left join cooks using (entity_id))"""),
]


def adjusted(p: str, source: str) -> list[tuple[str, str]]:
    """View ``padj`` (entity_id, padj) of the column ``p`` of ``source``."""
    return [("ranked", f"select entity_id, {p} as p, {p} * count({p}) over () / count({p}) over (order by {p} range between unbounded preceding and current row) as q from {source}"),
            ("padj", "select entity_id, case when p is not null then least(1.0, min(q) over (order by p desc range between unbounded preceding and current row)) end as padj from ranked where p is not null")]


COOKS_CUT = f"""(((select count(*) from smps) - 2) / 2.0 * (pow({1 - SEL.COOKS_QUANTILE:.17g}, -2.0 / ((select count(*) from smps) - 2)) - 1))"""
CUT_OFF = f"(cooks > {COOKS_CUT} and n_above < {SEL.EXEMPT_ABOVE})"


def _smooth() -> list[tuple[str, str]]:
    out = [("w0", "select i, 1.0 as rw from rejected")]
    near = f"ceil({SEL.LOWESS_FRAC} * {SEL.N_THETA})::int"
    for k in range(4):
        out += [(f"f{k}", f"""select i, x, y, case when sw <= 0 then y else ym + (case when sxx <= 1e-12 * greatest(1.0, pow((select max(x) - min(x) from rejected), 2)) then 0 else sxy / sxx end) * (x - xm) end as f from (
  select i, any_value(x) as x, any_value(y) as y, any_value(sw) as sw, any_value(xm) as xm, any_value(ym) as ym, sum(w * (xb - xm) * (xb - xm)) as sxx, sum(w * (xb - xm) * (yb - ym)) as sxy from (
    select *, sum(w) over (partition by i) as sw, sum(w * xb) over (partition by i) / sum(w) over (partition by i) as xm, sum(w * yb) over (partition by i) / sum(w) over (partition by i) as ym from (
      select g.i as i, x, y, xb, yb, pow(greatest(1 - pow(d / h, 3), 0), 3) * rw as w from (
        select a.i as i, a.x as x, a.y as y, b.i as ib, b.x as xb, b.y as yb, abs(b.x - a.x) as d, list_sort(list(abs(b.x - a.x)) over (partition by a.i))[{near}] as h
        from rejected a join rejected b on true) g join w{k} w on w.i = g.ib)) group by i)"""),
                (f"w{k + 1}", f"""select i, case when s = 0 then rw when abs(y - f) / (6 * s) < 1 then pow(1 - pow((y - f) / (6 * s), 2), 2) else 0 end as rw
  from f{k} join w{k} using (i), (select median(abs(y - f)) as s from f{k})""")]
    return out


REJECTION_VIEWS = [
    ("theta", f"""select i, low + i * (case when low < {SEL.UPPER_THETA} then {SEL.UPPER_THETA} else 1.0 end - low) / {SEL.N_THETA - 1} as theta
    from (select avg((basemean = 0)::int) as low from filterable), range({SEL.N_THETA}) as r(i)"""),
    ("sorted", "select list_sort(list(basemean)) as l from filterable"),
    ("cuts", """select i, theta, l[floor(spot)::bigint + 1] + (spot - floor(spot)) * (l[ceil(spot)::bigint + 1] - l[floor(spot)::bigint + 1]) as cut
    from (select i, theta, l, theta * (len(l) - 1) as spot from theta, sorted)"""),
    ("rejected", f"""select c.i, theta as x, cut, coalesce(y, 0)::DOUBLE as y from cuts c left join (
    select i, max(r) as y from (select i, p, count(*) over (partition by i order by p range between unbounded preceding and current row) as r, count(*) over (partition by i) as n
      from cuts join filterable on basemean >= cut where p is not null) where p <= r * {SEL.ALPHA} / n group by i) using (i)"""),
]

FILTER_VIEWS = [
    *TEST_VIEWS,
    ("filterable", f"select entity_id, basemean, case when {CUT_OFF} then null else p end as p from tests"),
    *REJECTION_VIEWS,
    *_smooth(),
    ("chosen", f"""select case when (select max(y) from rejected) <= {SEL.MIN_REJECTIONS} then 0 else coalesce((select min(i) from f3 where y > (
    select max(f) from f3) - (select coalesce(sqrt(avg((y - f) * (y - f))), 0) from f3 where y > 0)), 0) end as i"""),
    ("kept", "select entity_id, case when basemean >= (select cut from rejected where i = (select i from chosen)) then p end as p from filterable"),
    *adjusted("p", "kept"),
]

_MIDS = f"""select i, x, lag(x) over (order by i) as x0, greatest((x + lag(x) over (order by i)) / 2, 1e-9) as mid from (
  select i, (exp(s) - exp(-s)) / 2 as x from (select i, asinh(greatest((select max(q) from q), 2.0)) * i / {TR.TABLE - 1} as s from range({TR.TABLE}) as r(i)))"""

#: the trend of the transform: on genes spread over the means, where every sample and the means allow it
FAST_VIEWS = [
    ("ruled", f"""select (select min(n) from (select count(*) filter (cnt <> 0) as n from pm group by sample)) >= {P.FAST_GENES}
    and count(*) >= {P.FAST_GENES} as fast, count(*) >= {P.FAST_GENES} as enough, (count(*) - 1)::DOUBLE / {P.FAST_GENES - 1}.0::DOUBLE as step from disp where basemean > {P.FAST_MEAN}"""),
    ("steps", f"""select round_even(k * (select step from ruled) + 1, 0) as nth from range({P.FAST_GENES}) as r(k)"""),
    ("spaced", f"""select entity_id from (select entity_id, row_number() over (order by basemean, entity_id) as nth from disp where basemean > {P.FAST_MEAN})
    where nth in (select nth from steps)"""),
    ("usable", f"select * from disp where disp >= {100 * D.MIN_DISP} and (not (select fast from ruled) or entity_id in (select entity_id from spaced))"),
]

FULL_PCA_VIEWS = [
    *DISPERSION_VIEWS[:DISPERSION_VIEWS.index(next(v for v in DISPERSION_VIEWS if v[0] == "resid"))],
    ("mids", _MIDS),
    ("midlog", _local("ln(mid)", "(select i, mid from mids where i > 0)", "i")),
    ("area", "select m.i, x, sum(case when m.i = 0 then 0 else (x - x0) / sqrt(mid + exp(lv) * mid * mid) end) over (order by m.i) as t from mids m left join midlog using (i)"),
    ("tops", f"select max(x) as x, max(t) as t from area"),
    ("halves", """select a.t + ((select x from tops) / 2 - a.x) * (b.t - a.t) / (b.x - a.x) as h from area a join area b on b.i = a.i + 1
    where a.x < (select x from tops) / 2 and b.x >= (select x from tops) / 2"""),
    ("table_", """select i, asinh(x) as s, log2((select x from tops)) + (t - (select t from tops)) / ((select t from tops) - (select h from halves)) as z from area"""),
    ("closed", """select q.*, (select log2((1 + a1 + 2 * greatest(a0, 1e-12) * q + 2 * sqrt(greatest(a0, 1e-12) * q * (1 + a1 + greatest(a0, 1e-12) * q))) / (4 * greatest(a0, 1e-12))) from coef) as closed from q"""),
    ("vst", """select entity_id, sample, condition, coalesce(closed, case when asinh(q) <= a.s then a.z when b.s is null then a.z else a.z + (asinh(q) - a.s) * (b.z - a.z) / (b.s - a.s) end) as z
    from closed join table_ a on (asinh(q) > a.s or (a.i = 0 and asinh(q) <= a.s)) left join table_ b on b.i = a.i + 1
    where b.s is null or asinh(q) <= b.s"""),
    ("top", f"select entity_id from vst group by 1 order by var_samp(z) desc, entity_id limit {P.NTOP}"),
    ("centred", "select entity_id, sample, z - avg(z) over (partition by entity_id) as c from vst where entity_id in (select entity_id from top)"),
    ("gram", "select a.sample as i, b.sample as j, sum(a.c * b.c) as v from centred a join centred b using (entity_id) group by 1, 2"),
]

PCA_VIEWS = [w for v in FULL_PCA_VIEWS for w in (FAST_VIEWS if v is USABLE else [v])]


def _axis(gram: str, name: str) -> list[tuple[str, str]]:
    """View ``name`` (sample, score): the first principal axis of a Gram matrix, by repeated squaring."""
    return [(f"{name}_power", f"""
  with recursive s(i, j, v, it) as (
    select i, j, v / (select sum(v) from {gram} where i = j), 0 from {gram}
    union all
    select i, j, v / sum(case when i = j then v else 0 end) over (), it from (
      select a.i, b.j, sum(a.v * b.v) as v, a.it + 1 as it from s a join s b on a.j = b.i where a.it < 40 group by a.i, b.j, a.it))
  select i, j, v from s where it = 40"""),
            (f"{name}_value", f"select sum(g.v * p.v) as value from {gram} g join {name}_power p on g.i = p.j and g.j = p.i"),
            (name, f"""select i as sample, v / sqrt((select max(v) from {name}_power where i = j)) * sqrt((select value from {name}_value)) as score
  from {name}_power where j = (select arg_max(i, v) from {name}_power where i = j)""")]


_AXES = [*_axis("gram", "axis1"), ("rest", "select g.i, g.j, g.v - (select value from axis1_value) * p.v as v from gram g join axis1_power p using (i, j)"),
         *_axis("rest", "axis2")]
AXIS_VIEWS, FULL_AXIS_VIEWS = [*PCA_VIEWS, *_AXES], [*FULL_PCA_VIEWS, *_AXES]
