"""SQL of least squares for the oracles: columns taken out of one another in order, and elimination on lists.

Sources must not have columns named c, s, r, y0, rank, ss or a letter and a number such as o0: the CTEs add these.
"""

from __future__ import annotations

WEEKDAYS = [f"((day + 3) % 7 = {d})::INT::DOUBLE" for d in range(1, 7)]


def behind(source: str, keys: str, basis: list[str], y: str = "value", marks: tuple[int, ...] = (), name: str = "gs", more: tuple[str, ...] = (), share: float | None = None) -> str:
    """CTEs that make the basis columns of each key orthonormal in order, as o0, o1, ..; `name` is the last one.

    A column of which less than 1e-9 is left, or with `share` no more than that share of its length, depends on those before: it becomes 0 and its
    flag k0, k1, .. false. y0 is y, r what the basis leaves of it, r_<c> that of each column c of `more`, rank the number of
    columns kept; rss_k, for k in marks, is the sum of squares behind the first k columns.
    """
    p, w, left = len(basis), f"WINDOW w AS (PARTITION BY {keys})", ["r", *(f"r_{c}" for c in more)]
    out = [f"{name}_0 AS (SELECT *, {y} AS y0, {y} AS r, {''.join(f'{c} AS r_{c}, ' for c in more)}0 AS rank, {', '.join(f'{b} AS o{i}, true AS k{i}, sum(({b}) ** 2) OVER w AS l{i}' for i, b in enumerate(basis))} FROM {source} {w})"]
    for k in range(p):
        ok = "(ss > 1e-9)" if share is None else f"(l{k} >= 1e-20 AND sqrt(ss) > {share} * sqrt(l{k}))"
        scaled = f"SELECT * EXCLUDE (ss, l{k}) REPLACE (CASE WHEN {ok} THEN o{k} / sqrt(ss) ELSE 0 END AS o{k}, rank + {ok}::INT AS rank, {ok} AS k{k}) FROM (SELECT *, sum(o{k} ** 2) OVER w AS ss FROM {name}_{k} {w})"
        rest = ", ".join(f"{c} - o{k} * sum(o{k} * {c}) OVER w AS {c}" for c in [*(f"o{j}" for j in range(k + 1, p)), *left])
        mark = f"SELECT *, sum(r ** 2) OVER w AS rss_{k + 1} FROM (SELECT * REPLACE ({rest}) FROM ({scaled}) {w}) {w}" if k + 1 in marks else f"SELECT * REPLACE ({rest}) FROM ({scaled}) {w}"
        out.append(f"{name}_{k + 1} AS ({mark})")
    return ", ".join([*out, f"{name} AS (FROM {name}_{p})\n"])


def spectrum(source: str, keys: str, periods: list[float], degree: int = 1, weekdays: bool = True) -> tuple[str, str]:
    """CTEs and a SELECT of what each period explains of `value` by `day` behind intercept, trend and weekdays."""
    basis = [f"((day - avg(day) OVER w) / greatest(max(day) OVER w - min(day) OVER w, 1)) ** {d}::DOUBLE" if d else "1.0::DOUBLE" for d in range(degree + 1)] + (WEEKDAYS if weekdays else [])
    named = f"ns AS (SELECT *, {', '.join(f'{b} AS n{i}' for i, b in enumerate(basis))} FROM {source} WINDOW w AS (PARTITION BY {keys})), "
    p = len(basis)
    less = lambda a, b: f"sum({a} * {b}) - (" + " + ".join(f"sum({a} * o{k}) * sum({b} * o{k})" for k in range(p)) + ")"
    sums = f"""sm AS (SELECT {keys}, period, count(*) AS n, max(rank) AS rank, sum(y0 ** 2) AS yy, sum(r ** 2) AS total, {less('c', 'c')} AS cc, {less('s', 's')} AS ss, {less('c', 's')} AS cs, sum(c * r) AS cr, sum(s * r) AS sr
FROM (SELECT *, cos(2 * pi() * day / period) AS c, sin(2 * pi() * day / period) AS s FROM gs, (SELECT unnest({[float(x) for x in periods]}::DOUBLE[]) AS period)) GROUP BY ALL),
ei AS (SELECT *, n <= rank + 2 OR total <= 1e-12 * greatest(yy, 1e-300) AS none, (cc + ss) / 2 + sqrt(((cc - ss) / 2) ** 2 + cs ** 2) AS big, (cc + ss) / 2 - sqrt(((cc - ss) / 2) ** 2 + cs ** 2) AS small FROM sm),
so AS (SELECT *, CASE WHEN small > 1e-9 * n THEN (cr * ss - sr * cs) / (cc * ss - cs ** 2) WHEN big > 1e-9 * n THEN ((cc - small) * cr + cs * sr) / (big - small) / big ELSE 0 END AS b1,
CASE WHEN small > 1e-9 * n THEN (sr * cc - cr * cs) / (cc * ss - cs ** 2) WHEN big > 1e-9 * n THEN (cs * cr + (ss - small) * sr) / (big - small) / big ELSE 0 END AS b2 FROM ei)
"""
    fit = f"SELECT {keys}, period, n, CASE WHEN NOT none THEN (b1 * cr + b2 * sr) / total + 0.0 END AS explained, CASE WHEN NOT none THEN sqrt(b1 ** 2 + b2 ** 2) END AS amplitude, CASE WHEN NOT none THEN atan2(b2, b1) END AS angle FROM so"
    return named + behind("ns", keys, [f"n{i}" for i in range(p)]) + ", " + sums, fit


def window_fits(source: str, keys: str, periods: list[float], responses=("value",), coverage=(), phases=(), name: str = "wf") -> tuple[str, str]:
    """CTEs and a SELECT with the columns of `spectra.window_fits`: several responses behind intercept, trend, weekdays and coverage columns, which are dropped in order."""
    first, *more = responses
    used = [*responses, *coverage, *phases]
    names = ["intercept", "trend", "tue", "wed", "thu", "fri", "sat", "sun", *coverage]
    basis = ["1.0::DOUBLE", "((day - lo) / span)::DOUBLE", *WEEKDAYS, *(f"{c}::DOUBLE" for c in coverage)]
    rows = f"{name}_s AS (SELECT *, min(day) OVER w AS lo, greatest(max(day) OVER w - min(day) OVER w, 1) AS span FROM {source} WHERE {' AND '.join(f'{c} IS NOT NULL' for c in ['day', *used])} WINDOW w AS (PARTITION BY {keys})), "
    clean = lambda x: f"{x} - (" + " + ".join(f"o{k} * sum({x} * o{k}) OVER v" for k in range(len(basis))) + f") AS {x}"
    of = lambda c: "r" if c == first else f"r_{c}"
    turn = f"CASE phase {' '.join(f'WHEN {p!r} THEN radians({p})' for p in phases)} ELSE 2 * pi() * day / period END" if phases else "2 * pi() * day / period"
    terms = f"SELECT unnest({[float(x) for x in periods]}::DOUBLE[]) AS period, NULL::VARCHAR AS phase" + "".join(f" UNION ALL SELECT NULL, {p!r}" for p in phases)
    gone = ", ".join(f"CASE WHEN NOT bool_and(k{i}) THEN {c!r} END" for i, c in enumerate(names))
    each = ", ".join(f"sum(c * {of(c)}) AS cr_{i}, sum(s * {of(c)}) AS sr_{i}, var_pop({c}) * count(*) AS total_{i}, sum({of(c)} ** 2) AS rest_{i}" for i, c in enumerate(responses))
    sums = f"""{name}_t AS (SELECT {keys}, period, phase, count(*) AS n, max(rank) AS kept, concat_ws(', ', {gone}) AS dropped, sum(c * c) AS cc, sum(s * s) AS ss, sum(c * s) AS cs, {each}
FROM (SELECT * REPLACE ({clean('c')}, {clean('s')}) FROM (SELECT *, cos({turn}) AS c, sin({turn}) AS s FROM {name}_g, ({terms})) WINDOW v AS (PARTITION BY {keys}, period, phase)) GROUP BY ALL),
{name}_e AS (SELECT *, (cc + ss) / 2 + sqrt(((cc - ss) / 2) ** 2 + cs ** 2) AS big, (cc + ss) / 2 - sqrt(((cc - ss) / 2) ** 2 + cs ** 2) AS small FROM {name}_t),
{name}_r AS ({" UNION ALL ".join(f"SELECT {keys}, {c!r} AS response, period, phase, n, kept, dropped, cc, ss, cs, big, small, cr_{i} AS cr, sr_{i} AS sr, rest_{i} AS rest, sqrt(total_{i} / n) < 1e-6 OR rest_{i} <= 1e-12 * greatest(1, total_{i}) AS flat FROM {name}_e" for i, c in enumerate(responses))}),
{name}_b AS (SELECT *, NOT flat AND n > kept + 2 AS fine, CASE WHEN small > 1e-9 * n THEN (cr * ss - sr * cs) / (cc * ss - cs ** 2) WHEN big > 1e-9 * n THEN ((cc - small) * cr + cs * sr) / (big - small) / big ELSE 0 END AS b1,
CASE WHEN small > 1e-9 * n THEN (sr * cc - cr * cs) / (cc * ss - cs ** 2) WHEN big > 1e-9 * n THEN (cs * cr + (ss - small) * sr) / (big - small) / big ELSE 0 END AS b2 FROM {name}_r)
"""
    fit = f"SELECT {keys}, response, period, phase, n, kept, dropped, fine::INT AS available, flat::INT AS zero_variance, CASE WHEN fine THEN least(1, greatest(0, (b1 * cr + b2 * sr) / rest)) + 0.0 END AS explained, CASE WHEN fine THEN sqrt(b1 ** 2 + b2 ** 2) END AS amplitude, CASE WHEN fine THEN atan2(b2, b1) END AS angle FROM {name}_b"
    return rows + behind(f"{name}_s", keys, basis, first, name=f"{name}_g", more=tuple(more), share=1e-4) + ", " + sums, fit


def peaks(fit: str, keys: str) -> str:
    """A SELECT with the columns of `spectra.peaks` of fits over one band."""
    best = lambda c: f"arg_max({c}, (round(explained, 12), -period)) FILTER (explained IS NOT NULL)"
    return f"""SELECT {keys}, max(available) AS available, max(zero_variance) AS zero_variance, {best("period")} AS peak_period, {best("explained")} AS peak_share, {best("amplitude")} AS peak_amplitude, sum(area) / nullif(max(f) - min(f), 0) AS band_mean
FROM (SELECT *, 1 / period AS f, (1 / period - lag(1 / period) OVER w) * (explained + lag(explained) OVER w) / 2 AS area FROM ({fit}) WINDOW w AS (PARTITION BY {keys} ORDER BY period DESC)) GROUP BY ALL"""


def hc3(source: str, terms: dict[str, str], y: str) -> tuple[str, str]:
    """CTEs and a SELECT of least squares with HC3 errors, of terms that don't depend on one another.

    With the inverse of the sums of products swept out on a list of lists, a row's weights in each estimate are inverse times row.
    """
    p, names = len(terms), list(terms)
    rows = f"lx AS (SELECT [{', '.join(f'({e})::DOUBLE' for e in terms.values())}] AS x, ({y})::DOUBLE AS y FROM {source})"
    gram = f"sw_0 AS (SELECT [{', '.join('[' + ', '.join(f'sum(x[{i}] * x[{j}])' for j in range(1, p + 1)) + ']' for i in range(1, p + 1))}] AS m FROM lx)"
    step = lambda k: f"sw_{k} AS (SELECT [[CASE WHEN i = {k} AND j = {k} THEN 1 / m[{k}][{k}] WHEN i = {k} THEN m[{k}][j] / m[{k}][{k}] WHEN j = {k} THEN -m[i][{k}] / m[{k}][{k}] ELSE m[i][j] - m[i][{k}] * m[{k}][j] / m[{k}][{k}] END for j in range(1, {p + 1})] for i in range(1, {p + 1})] AS m FROM sw_{k - 1})"
    weights = f"wx AS (SELECT x, y, [list_dot_product(m[i], x) for i in range(1, {p + 1})] AS v FROM lx, sw_{p})"
    beta = f"be AS (SELECT count(*) AS n, [{', '.join(f'sum(v[{i}] * y)' for i in range(1, p + 1))}] AS b FROM wx)"
    err = "er AS (SELECT v, b, n, ((y - list_dot_product(b, x)) / greatest(1 - list_dot_product(v, x), 1e-12)) ** 2 AS w FROM wx, be)\n"
    fit = f"SELECT unnest({names}) AS term, unnest(any_value(b)) AS estimate, unnest([{', '.join(f'sqrt(sum(v[{i}] ** 2 * w))' for i in range(1, p + 1))}]) AS se, unnest([any_value(n) for _ in range({p})]) AS n FROM er"
    return ", ".join([rows, gram, *[step(k) for k in range(1, p + 1)], weights, beta, err]), fit


def solved(source: str, keys: str, terms: list[str], y: str, weight: str = "1", name: str = "lq") -> str:
    """CTEs of weighted least squares for each key; `name` has the keys and b, the list of estimates. The terms don't depend on one another."""
    p, own = len(terms), f"{keys}, " if keys else ""
    line = lambda e: f"[{', '.join(f'sum(({weight}) * ({e}) * ({f}))' for f in [*terms, y])}]"
    out = [f"{name}_0 AS (SELECT {own}[{', '.join(line(e) for e in terms)}]::DOUBLE[][] AS m FROM {source}{f' GROUP BY {keys}' if keys else ''})"]
    out += [f"{name}_{k} AS (SELECT {own}[[CASE WHEN i = {k} THEN m[{k}][j] / m[{k}][{k}] ELSE m[i][j] - m[i][{k}] * m[{k}][j] / m[{k}][{k}] END for j in range(1, {p + 2})] for i in range(1, {p + 1})] AS m FROM {name}_{k - 1})" for k in range(1, p + 1)]
    return ", ".join([*out, f"{name} AS (SELECT {own}[m[i][{p + 1}] for i in range(1, {p + 1})] AS b FROM {name}_{p})\n"])


def auroc(source: str, keys: str) -> str:
    """AUROC of y by score for each key."""
    return f"SELECT {keys}, sum(pos * (below + neg / 2)) / nullif(sum(pos) * sum(neg), 0) AS auroc FROM (SELECT *, coalesce(sum(neg) OVER (PARTITION BY {keys} ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM (SELECT {keys}, score, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg FROM {source} GROUP BY ALL)) GROUP BY ALL"
