"""SQL for DuckDB that answers the registered queries in another way.

Folds are range joins instead of frames, carried fits an as-of join, regressions
``regr_*`` or a Gram-Schmidt chain over the training rows.
"""

from __future__ import annotations

from foldcast.catalog import queries as q
from foldcast.operators.folds import FoldSpec

PX = {
    "flag": """SELECT l_returnflag AS sid, CAST(l_shipdate AS DATE) AS dt,
        CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / 100.0::DOUBLE / sum(l_quantity) AS price
        FROM lineitem GROUP BY 1, 2""",
    "supp": """SELECT CAST(l_suppkey AS VARCHAR) AS sid, CAST(l_shipdate AS DATE) AS dt,
        CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / 100.0::DOUBLE / sum(l_quantity) AS price
        FROM lineitem GROUP BY 1, 2""",
    "order": """SELECT o_orderstatus AS sid, CAST(o_orderdate AS DATE) AS dt,
        CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / 100.0::DOUBLE AS price
        FROM orders GROUP BY 1, 2""",
    "event": """SELECT s.sid, g.dt, e.price FROM (SELECT DISTINCT event_type AS sid FROM events) s
        JOIN (SELECT unnest(generate_series(date_trunc('hour', min(ts)), max(ts), INTERVAL 1 HOUR)) AS dt FROM events) g ON true
        LEFT JOIN (SELECT event_type AS sid, date_trunc('hour', ts) AS dt,
              CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / 100.0::DOUBLE / count(value) AS price
              FROM events GROUP BY 1, 2) e ON e.sid = s.sid AND e.dt = g.dt""",
}


PX["log"] = f"SELECT sid, dt, ln(price) AS price FROM ({PX['supp']})"


def px(kind: str) -> str:
    return f"px AS ({PX[kind]})"


# forward fill by looking up the last known row
FILLED = """known AS (SELECT sid, dt, price FROM px WHERE price IS NOT NULL),
filled AS (SELECT px.sid, px.dt, k.price FROM px ASOF JOIN known k ON px.sid = k.sid AND px.dt >= k.dt)"""


def r6(expr: str, name: str) -> str:
    return f"round({expr}, 6) + 0.0 AS {name}"


def capped(spec: FoldSpec) -> str:
    if spec.start_date is None:
        return "true"
    return f"dt BETWEEN DATE '{spec.start_date}' AND DATE '{spec.end_date}'"


def capped_returns(kind: str, spec: FoldSpec) -> str:
    """Lag frame of prices, then the date cap, then returns: columns x1.., y, i, n, t."""
    k, o, p = spec.input_pct_change, spec.output_pct_change, spec.prediction_length
    lags = ", ".join(f"lag(price, {m}) OVER w AS p{m}" for m in range(1, spec.lags + 1))
    xs = ", ".join(f"p{m} / lag(p{m}, {k}) OVER w - 1 AS x{m}" for m in range(1, spec.lags + 1))
    return f"""{px(kind)},
lagged AS (SELECT sid, dt, price, {lags} FROM px WINDOW w AS (PARTITION BY sid ORDER BY dt)),
capped AS (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY dt) - 1 AS i,
    count(*) OVER (PARTITION BY sid) AS n
    FROM lagged WHERE {capped(spec)}),
ret AS (SELECT sid, dt, i, n, i - {p - 1} AS t, {xs}, price / lag(price, {o}) OVER w - 1 AS y
    FROM capped WINDOW w AS (PARTITION BY sid ORDER BY i)),
pair AS (SELECT a.sid, a.i, b.i AS j, {", ".join(f"coalesce(a.x{m}, 0.0) AS x{m}" for m in range(1, spec.lags + 1))},
    coalesce(b.y, 0.0) AS y FROM ret a JOIN ret b ON b.sid = a.sid AND b.i = a.i + {p}),
fold AS (SELECT sid, i AS e, dt AS fit_dt, t FROM ret WHERE t >= {spec.window_size} AND t % {spec.frequency} = 0)"""


def train_join(spec: FoldSpec, held: int | None = None) -> str:
    low = f"f.t - {spec.window_size}" if spec.sliding_window else "0"
    held = spec.validation_size if held is None else held
    return f"fold f JOIN pair a ON a.sid = f.sid AND a.i BETWEEN {low} AND f.t - {held} - 1"


def landed(spec: FoldSpec, forecast: str) -> str:
    """Latest fit at or before each row, moved P rows ahead."""
    p = spec.prediction_length
    first = spec.window_size + 2 * p - 1
    return f"""made AS (SELECT r.sid, r.i, {forecast} FROM ret r ASOF LEFT JOIN fit ON r.sid = fit.sid AND r.t >= fit.t),
moved AS (SELECT r.sid, r.dt, r.i, r.n, m.* EXCLUDE (sid, i), r.y AS "true"
    FROM ret r LEFT JOIN made m ON m.sid = r.sid AND m.i = r.i - {p} WHERE r.i >= {first})"""


FORECAST_OUT = f"""SELECT sid AS series_id, dt, {r6('pred', 'pred')}, {r6('"true"', '"true"')} FROM moved"""


def linear_wf(kind: str, spec: FoldSpec, stored: str = "true") -> str:
    if spec.lags == 1:
        fit = f"""fit AS (SELECT f.sid, f.t, regr_intercept(a.y, a.x1) AS c0, regr_slope(a.y, a.x1) AS c1
            FROM {train_join(spec)} WHERE {stored} GROUP BY 1, 2)"""
        forecast = "c0 + c1 * r.x1 AS pred"
    else:
        fit = f"""mom AS (SELECT f.sid, f.t, avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my, var_pop(x1) AS s11,
            var_pop(x2) AS s22, covar_pop(x1, x2) AS s12, covar_pop(x1, y) AS s1y, covar_pop(x2, y) AS s2y
            FROM {train_join(spec)} GROUP BY 1, 2),
        cf AS (SELECT *, (s1y * s22 - s2y * s12) / (s11 * s22 - s12 * s12) AS b1,
            (s2y * s11 - s1y * s12) / (s11 * s22 - s12 * s12) AS b2 FROM mom),
        fit AS (SELECT sid, t, my - b1 * m1 - b2 * m2 AS c0, b1 AS c1, b2 AS c2 FROM cf)"""
        forecast = "c0 + c1 * r.x1 + c2 * r.x2 AS pred"
    return f"{capped_returns(kind, spec)}, {fit}, {landed(spec, forecast)}"


def tube_wf(kind: str, spec: FoldSpec, epsilon: float) -> str:
    fit = f"""fit AS (SELECT f.sid, f.t, min(a.y) AS lo, max(a.y) AS hi FROM {train_join(spec)} GROUP BY 1, 2)"""
    forecast = f"""CAST(hi - lo <= {2 * epsilon} AS BIGINT) AS in_tube,
        CASE WHEN hi - lo <= {2 * epsilon} THEN (lo + hi) / 2.0 END AS pred"""
    return f"{capped_returns(kind, spec)}, {fit}, {landed(spec, forecast)}"


TUBE_OUT = f"""SELECT sid AS series_id, dt, in_tube, {r6('pred', 'pred')}, {r6('"true"', '"true"')} FROM moved"""


def split_rows(kind: str, lags: int, test: float = 0.1, validation: float = 0.15) -> str:
    """Returns first, then lags; the newest rows are test, those before them validation."""
    xs = ", ".join(f"coalesce(lag(r, {m}) OVER w, 0.0) AS x{m}" for m in range(1, lags + 1))
    return f"""{px(kind)},
rr AS (SELECT sid, dt, price / lag(price) OVER w - 1 AS r, row_number() OVER w - 1 AS i,
    count(*) OVER (PARTITION BY sid) AS n FROM px WINDOW w AS (PARTITION BY sid ORDER BY dt)),
sup AS (SELECT sid, dt, i, n, coalesce(r, 0.0) AS y, {xs} FROM rr WINDOW w AS (PARTITION BY sid ORDER BY dt)),
siz AS (SELECT *, n - CAST(ceil(n * {test}::DOUBLE) AS BIGINT) AS n1 FROM sup),
spl AS (SELECT *, CASE WHEN i >= n1 THEN 'test'
    WHEN i >= n1 - CAST(ceil(n1 * {validation}::DOUBLE) AS BIGINT) THEN 'validation' ELSE 'train' END AS role FROM siz)"""


def gram_schmidt(source: str, key: str, features: list[str], target: str, train: str, out: str) -> str:
    """CTE chain that orthogonalises features on the training rows.

    ``out`` has, per row of ``source``, ``pred`` of each nested model
    (``pred_0`` .. ``pred_k``), its training residual sums ``rss_0`` .. and the
    numbers needed to write the coefficients of the raw features.
    """
    def total(expr: str) -> str:
        return f"sum({expr}) FILTER (WHERE {train}) OVER (PARTITION BY {key})"

    def mean(expr: str) -> str:
        return f"avg({expr}) FILTER (WHERE {train}) OVER (PARTITION BY {key})"

    k = len(features)
    cols = ", ".join(f"{f} - {mean(f)} AS z{j}, {mean(f)} AS m{j}, regr_sxx({f}, {f}) FILTER (WHERE {train}) OVER (PARTITION BY {key}) AS d{j}" for j, f in enumerate(features, 1))

    def over_own(num: str, s: int) -> str:  # 0 for a feature that depends on the earlier ones
        own = total(f"z{s} * z{s}")
        return f"CASE WHEN {own} > 1e-12 * d{s} THEN {total(num)} / {own} ELSE 0 END"

    steps = [
        f"""{out}_0 AS (SELECT *, {mean(target)} AS yb, {target} - {mean(target)} AS e_0{', ' if cols else ''}{cols}
            FROM {source})"""
    ]
    for s in range(1, k + 1):
        slopes = ", ".join(
            [f"{over_own(f'e_{s - 1} * z{s}', s)} AS c{s}"]
            + [f"{over_own(f'z{j} * z{s}', s)} AS s{j}_{s}" for j in range(s + 1, k + 1)]
        )
        steps.append(f"{out}_s{s} AS (SELECT * FROM (SELECT *, {slopes} FROM {out}_{s - 1}))")
        replaced = ", ".join(f"z{j} - s{j}_{s} * z{s} AS z{j}" for j in range(s + 1, k + 1))
        star = f"* REPLACE ({replaced})" if replaced else "*"
        steps.append(f"{out}_{s} AS (SELECT {star}, e_{s - 1} - c{s} * z{s} AS e_{s} FROM {out}_s{s})")
    rss = ", ".join(f"{total(f'e_{s} * e_{s}')} AS rss_{s}" for s in range(k + 1))
    preds = ", ".join(
        "yb" + "".join(f" + c{j} * z{j}" for j in range(1, s + 1)) + f" AS pred_{s}" for s in range(k + 1)
    )
    steps.append(f"{out} AS (SELECT *, {rss}, {preds}, count(*) FILTER (WHERE {train}) OVER (PARTITION BY {key}) AS n_tr FROM {out}_{k})")
    return ",\n".join(steps)


def raw_coefficients(k: int) -> tuple[str, list[str]]:
    """Intercept and slopes on the raw features from the chain's numbers."""
    on_z = [f"c{j}" for j in range(1, k + 1)]
    beta: list[str] = [""] * k
    for j in range(k, 0, -1):
        beta[j - 1] = f"({on_z[j - 1]})"
        for i in range(1, j):
            on_z[i - 1] = f"{on_z[i - 1]} - {beta[j - 1]} * s{j}_{i}"
    intercept = "yb" + "".join(f" - {beta[j - 1]} * m{j}" for j in range(1, k + 1))
    return intercept, beta


def split_linear(kind: str, lags: int, how: str = "plain") -> str:
    base = split_rows(kind, lags)
    if how == "plain" and lags == 1:
        fit = """fit AS (SELECT sid, regr_intercept(y, x1) AS c0, regr_slope(y, x1) AS c1 FROM spl
            WHERE role = 'train' GROUP BY 1)"""
    elif how == "no_intercept":
        fit = "fit AS (SELECT sid, 0.0::DOUBLE AS c0, sum(x1 * y) / sum(x1 * x1) AS c1 FROM spl WHERE role = 'train' GROUP BY 1)"
    elif how == "nonneg":
        fit = """fit AS (SELECT sid, avg(y) - greatest(regr_slope(y, x1), 0) * avg(x1) AS c0,
            greatest(regr_slope(y, x1), 0) AS c1 FROM spl WHERE role = 'train' GROUP BY 1)"""
    else:
        chain = gram_schmidt("spl", "sid", [f"x{m}" for m in range(1, lags + 1)], "y", "role = 'train'", "g")
        return f"""{base}, {chain},
        moved AS (SELECT sid, dt, i, n, pred_{lags} AS pred, y AS "true" FROM g WHERE role = 'test')"""
    return f"""{base}, {fit},
    moved AS (SELECT s.sid, s.dt, s.i, s.n, c0 + c1 * s.x1 AS pred, s.y AS "true" FROM spl s JOIN fit USING (sid) WHERE s.role = 'test')"""


def nonneg_wide(kind: str, lags: int, rounds: int = 150) -> str:
    """Non-negative coefficients one after the other, over and over, until they stand still."""
    k = range(1, lags + 1)
    names = [(f"x{a}", f"x{b}", f"g{a}_{b}") for a in k for b in k if b >= a]
    products = ", ".join(f"covar_pop({a}, {b}) AS {n}" for a, b, n in names)
    g = lambda a, b: f"g{min(a, b)}_{max(a, b)}"
    moved = []
    for a in k:
        rest = "".join(f" - {g(a, b)} * {f'n{b}' if b < a else f'b{b}'}" for b in k if b != a)
        moved.append(f"greatest(0, (r{a}{rest}) / {g(a, a)}) AS n{a}")
    return f"""{split_rows(kind, lags)},
    mom AS (SELECT sid, avg(y) AS my, {", ".join(f"avg(x{a}) AS m{a}, covar_pop(x{a}, y) AS r{a}" for a in k)}, {products} FROM spl WHERE role = 'train' GROUP BY 1),
    it AS (SELECT sid, 0 AS h, {", ".join(f"0.0::DOUBLE AS b{a}" for a in k)} FROM mom
        UNION ALL SELECT sid, h, {", ".join(f"n{a}" for a in k)} FROM (SELECT it.sid, it.h + 1 AS h, {", ".join(moved)} FROM it JOIN mom USING (sid) WHERE it.h < {rounds})),
    moved AS (SELECT s.sid, s.dt, my{"".join(f" + b{a} * (s.x{a} - m{a})" for a in k)} AS pred, s.y AS "true"
        FROM spl s JOIN mom USING (sid) JOIN it ON it.sid = s.sid AND it.h = {rounds} WHERE s.role = 'test')"""


def split_tube(kind: str, lags: int, epsilon: float) -> str:
    return f"""{split_rows(kind, lags)},
fit AS (SELECT sid, min(y) AS lo, max(y) AS hi FROM spl WHERE role = 'train' GROUP BY 1),
moved AS (SELECT s.sid, s.dt, s.i, s.n, CAST(hi - lo <= {2 * epsilon} AS BIGINT) AS in_tube,
    CASE WHEN hi - lo <= {2 * epsilon} THEN (lo + hi) / 2.0 END AS pred, s.y AS "true"
    FROM spl s JOIN fit USING (sid) WHERE s.role = 'test')"""


def scores(table: str) -> str:
    return f"""SELECT sid AS series_id, model, count(*) AS n_obs, avg((pred - "true") ^ 2) AS mse,
    sqrt(avg((pred - "true") ^ 2)) AS rmse, avg(abs(pred - "true")) AS mae,
    1 - sum((pred - "true") ^ 2) / (count(*) * var_pop("true")) AS r2,
    avg(CASE WHEN sign(pred) = sign("true") THEN 1.0 ELSE 0.0 END) AS hit_rate
    FROM {table} WHERE pred IS NOT NULL AND "true" IS NOT NULL GROUP BY 1, 2"""


def ar_split(kind: str, max_p: int) -> str:
    """Nested regressions on x1 and 1..max_p own lags over the training rows."""
    base = split_rows(kind, max_p)
    features = ["u1"] + [f"x{a}" for a in range(1, max_p + 1)]
    chain = gram_schmidt("sel", "sid", features, "y", "role = 'train'", "g")
    return f"""{base}, sel AS (SELECT *, x1 AS u1 FROM spl WHERE role = 'train' AND i >= {max_p}), {chain}"""


def ar_orders(kind: str, max_p: int) -> str:
    rows = " UNION ALL ".join(
        f"""SELECT sid, CAST({p} AS BIGINT) AS p, any_value(n_tr) AS n_train, any_value(rss_{p + 1}) AS rss,
        any_value(n_tr) * ln(any_value(rss_{p + 1}) / any_value(n_tr)) + 2 * ({p} + 2) AS aic FROM g GROUP BY 1"""
        for p in range(max_p + 1)
    )
    return f"""WITH {ar_split(kind, max_p)}, cand AS ({rows})
    SELECT sid AS series_id, p, n_train, {r6('rss', 'rss')}, {r6('aic', 'aic')},
    CAST(row_number() OVER (PARTITION BY sid ORDER BY round(aic, 9), p) = 1 AS BIGINT) AS chosen FROM cand"""


def ar_coefficients(kind: str, max_p: int) -> str:
    intercept, beta = raw_coefficients(max_p + 1)
    return f"""WITH {ar_split(kind, max_p)} SELECT sid AS series_id, any_value(n_tr) AS n_train,
    {r6(f"any_value({intercept})", "intercept")}, {r6(f"any_value({beta[0]})", "beta")},
    {", ".join(r6(f"any_value({beta[a]})", f"phi{a}") for a in range(1, max_p + 1))} FROM g GROUP BY 1"""


def ar_split_forecasts(kind: str, max_p: int) -> str:
    """Least AIC of the nested fits, then one recursive step per row after training."""
    nested = []
    for p in range(max_p + 1):
        on_z = [f"c{j}" for j in range(1, p + 2)]
        beta = [""] * (p + 1)
        for j in range(p + 1, 0, -1):
            beta[j - 1] = f"({on_z[j - 1]})"
            for i in range(1, j):
                on_z[i - 1] = f"{on_z[i - 1]} - {beta[j - 1]} * s{j}_{i}"
        c0 = "yb" + "".join(f" - {beta[j]} * m{j + 1}" for j in range(p + 1))
        phis = "".join(f", any_value({beta[a]}) AS phi{a}" if a <= p else f", 0.0::DOUBLE AS phi{a}" for a in range(1, max_p + 1))
        nested.append(f"""SELECT sid, {p} AS p, any_value(n_tr) * ln(any_value(rss_{p + 1}) / any_value(n_tr)) + 2 * ({p} + 2) AS aic,
            any_value({c0}) AS c0, any_value({beta[0]}) AS b{phis} FROM g GROUP BY 1""")
    ar = " + ".join(f"phi{a} * st{a}" for a in range(1, max_p + 1))
    first = ", ".join(f"s.x{a} AS st{a}" for a in range(1, max_p + 1))
    moved = ", ".join(["pred AS st1"] + [f"r.st{a - 1} AS st{a}" for a in range(2, max_p + 1)])
    keep = ", ".join(f"st{a}" for a in range(1, max_p + 1))
    return f"""WITH RECURSIVE {ar_split(kind, max_p)}, cand AS ({" UNION ALL ".join(nested)}),
    fit AS (SELECT * FROM cand QUALIFY row_number() OVER (PARTITION BY sid ORDER BY round(aic, 9), p) = 1),
    ahead AS (SELECT s.*, row_number() OVER (PARTITION BY s.sid ORDER BY s.i) AS h, fit.* EXCLUDE (sid)
        FROM spl s JOIN fit ON fit.sid = s.sid WHERE s.role <> 'train'),
    rec AS (SELECT sid, h, c0 + b * x1 + {ar} AS pred, {keep} FROM (SELECT s.*, {first} FROM ahead s WHERE h = 1)
        UNION ALL SELECT sid, h, c0 + b * x1 + {ar} AS pred, {keep}
        FROM (SELECT a.*, {moved} FROM rec r JOIN ahead a ON a.sid = r.sid AND a.h = r.h + 1)),
    moved AS (SELECT a.sid, a.dt, r.pred, a.y AS "true" FROM ahead a JOIN rec r ON r.sid = a.sid AND r.h = a.h WHERE a.role = 'test')
    {FORECAST_OUT}"""


def ar_wf(kind: str, spec: FoldSpec, max_p: int, compat: bool = False) -> str:
    """Per fold nested regressions; least AIC; recursion written out step by step."""
    p_ahead, v, w = spec.prediction_length, spec.validation_size, spec.window_size
    low = f"f.t - {w} + {p_ahead + max_p}" if spec.sliding_window else f"{p_ahead + max_p}"
    lags = ", ".join(f"lag(coalesce(y, 0), {a}) OVER w AS v{a}" for a in range(1, max_p + 1))
    features = ["u"] + [f"v{a}" for a in range(1, max_p + 1)]
    chain = gram_schmidt("ex", "sid, t", features, "y", "true", "g")
    nested = []
    for p in range(max_p + 1):
        # coefficients of the model that stops after p lags
        on_z = [f"c{j}" for j in range(1, p + 2)]
        beta = [""] * (p + 1)
        for j in range(p + 1, 0, -1):
            beta[j - 1] = f"({on_z[j - 1]})"
            for i in range(1, j):
                on_z[i - 1] = f"{on_z[i - 1]} - {beta[j - 1]} * s{j}_{i}"
        c0 = "yb" + "".join(f" - {beta[j]} * m{j + 1}" for j in range(p + 1))
        phis = "".join(f", any_value({beta[a]}) AS phi{a}" if a <= p else f", 0.0::DOUBLE AS phi{a}" for a in range(1, max_p + 1))
        nested.append(f"""SELECT sid, t, {p} AS p, any_value(n_tr) * ln(any_value(rss_{p + 1}) / any_value(n_tr)) + 2 * ({p} + 2) AS aic,
            any_value({c0}) AS c0, any_value({beta[0]}) AS b{phis} FROM g GROUP BY 1, 2""")
    steps = p_ahead if compat else p_ahead + v
    out = [f"""{capped_returns(kind, spec)},
    tgt AS (SELECT b.sid, b.i, coalesce(b.y, 0) AS y, coalesce(a.x1, 0) AS u FROM ret b JOIN ret a ON a.sid = b.sid AND a.i = b.i - {p_ahead}),
    tl AS (SELECT *, {lags} FROM tgt WINDOW w AS (PARTITION BY sid ORDER BY i)),
    ex AS (SELECT f.sid, f.t, tl.* EXCLUDE (sid) FROM fold f JOIN tl ON tl.sid = f.sid AND tl.i BETWEEN {low} AND f.e - {v}),
    {chain}, cand AS ({" UNION ALL ".join(nested)}),
    fit AS (SELECT * FROM cand QUALIFY row_number() OVER (PARTITION BY sid, t ORDER BY round(aic, 9), p) = 1)"""]
    origin = "fit.t" if compat else "r.t"
    state = ", ".join(f"s{a}.y AS st{a}" for a in range(max_p))
    joins = " ".join(
        f"LEFT JOIN tgt s{a} ON s{a}.sid = r.sid AND s{a}.i = {origin} + {p_ahead - 1 - v - a}" for a in range(max_p)
    )
    xs = ", ".join(f"lag(x1, {k}) OVER w AS q{k}" for k in range(steps))
    out.append(f"rx AS (SELECT sid, i, t, {xs} FROM ret WINDOW w AS (PARTITION BY sid ORDER BY i))")
    out.append(f"""h0 AS (SELECT r.*, fit.c0, fit.b, {", ".join(f"fit.phi{a}" for a in range(1, max_p + 1))}, {state}
        FROM rx r ASOF JOIN fit ON r.sid = fit.sid AND r.t >= fit.t {joins})""")
    for h in range(1, steps + 1):
        ar = " + ".join(f"phi{a} * st{a - 1}" for a in range(1, max_p + 1))
        moved = ", ".join([f"c0 + b * q{steps - h} + {ar} AS st0"] + [f"st{a - 1} AS st{a}" for a in range(1, max_p)])
        out.append(f"h{h} AS (SELECT * REPLACE ({moved}) FROM h{h - 1})")
    out.append(f"made AS (SELECT sid, i, st0 AS pred FROM h{steps})")
    first = w + 2 * p_ahead - 1
    out.append(f"""moved AS (SELECT r.sid, r.dt, m.pred, r.y AS "true" FROM ret r LEFT JOIN made m
        ON m.sid = r.sid AND m.i = r.i - {p_ahead} WHERE r.i >= {first})""")
    return ",\n".join(out)


def nested_fits(chain: str, key: str, max_p: int, extra: str = "") -> str:
    """One row per order of a chain over [input, lags]: AIC, intercept c0, slope b, phi1.. with zeros."""
    out = []
    for p in range(max_p + 1):
        on_z = [f"c{j}" for j in range(1, p + 2)]
        beta = [""] * (p + 1)
        for j in range(p + 1, 0, -1):
            beta[j - 1] = f"({on_z[j - 1]})"
            for i in range(1, j):
                on_z[i - 1] = f"{on_z[i - 1]} - {beta[j - 1]} * s{j}_{i}"
        c0 = "yb" + "".join(f" - {beta[j]} * m{j + 1}" for j in range(p + 1))
        phis = "".join(f", any_value({beta[a]}) AS phi{a}" if a <= p else f", 0.0::DOUBLE AS phi{a}" for a in range(1, max_p + 1))
        out.append(f"""SELECT {key}, {p} AS p{extra}, any_value(n_tr) * ln(any_value(rss_{p + 1}) / any_value(n_tr)) + 2 * ({p} + 2) AS aic,
            any_value({c0}) AS c0, any_value({beta[0]}) AS b{phis} FROM {chain} GROUP BY {key}""")
    return " UNION ALL ".join(out)


def ar_wf_tested(kind: str, spec: FoldSpec, max_p: int, most: int = 2, critical: float = 0.463, longest: int = 12) -> str:
    """Level test, difference, order and recursion of every fold, from the training rows themselves."""
    p_ahead, v, w = spec.prediction_length, spec.validation_size, spec.window_size
    oldest = f"f.t - {w} + {p_ahead}" if spec.sliding_window else f"{p_ahead}"
    diff = ["{c}", "{c} - lag({c}) OVER w", "{c} - 2 * lag({c}) OVER w + lag({c}, 2) OVER w"]
    columns = ", ".join(f"{diff[d].format(c=c)} AS {c}{d}" for d in range(most + 1) for c in ("y", "u"))
    lags = ", ".join(f"lag(y{d}, {a}) OVER w AS y{d}_{a}" for d in range(most + 1) for a in range(1, max_p + 1))
    out = [f"""{capped_returns(kind, spec)},
    tgt AS MATERIALIZED (SELECT b.sid, b.i, coalesce(b.y, 0) AS y, coalesce(a.x1, 0) AS u FROM ret b JOIN ret a ON a.sid = b.sid AND a.i = b.i - {p_ahead}),
    df AS (SELECT *, {columns} FROM tgt WINDOW w AS (PARTITION BY sid ORDER BY i)),
    dl AS MATERIALIZED (SELECT *, {lags} FROM df WINDOW w AS (PARTITION BY sid ORDER BY i))"""]
    for d in range(most):
        shifted = ", ".join(f"e * lag(e, {s}) OVER w AS g{s}" for s in range(1, longest + 1))
        gammas = " + ".join(f"2 * greatest(0, 1 - {s} / (any_value(l) + 1)) * coalesce(sum(g{s}), 0)" for s in range(1, longest + 1))
        out.append(f"""lt{d} AS (SELECT f.sid, f.t, dl.i, y{d} - avg(y{d}) OVER q AS e, floor(sqrt(count(*) OVER q) * 3 / 13) AS l
            FROM fold f JOIN dl ON dl.sid = f.sid AND dl.i BETWEEN {oldest} + {d} AND f.e - {v} WINDOW q AS (PARTITION BY f.sid, f.t)),
        ls{d} AS (SELECT *, sum(e) OVER w AS ps, {shifted} FROM lt{d} WINDOW w AS (PARTITION BY sid, t ORDER BY i)),
        st{d} AS MATERIALIZED (SELECT sid, t, sum(ps * ps) / (count(*) * (sum(e * e) + {gammas})) AS st FROM ls{d} GROUP BY 1, 2)""")
    tests = " ".join(f"WHEN st{d}.st < {critical} THEN {d}" for d in range(most))
    joins = " ".join(f"JOIN st{d} ON st{d}.sid = f.sid AND st{d}.t = f.t" for d in range(most))
    out.append(f"pick AS MATERIALIZED (SELECT f.sid, f.t, f.e, CASE {tests} ELSE {most} END AS d FROM fold f {joins})")
    for d in range(most + 1):
        features = [f"u{d}"] + [f"y{d}_{a}" for a in range(1, max_p + 1)]
        chain = gram_schmidt(f"ex{d}", "sid, t", features, f"y{d}", "true", f"g{d}")
        out.append(f"""ex{d} AS (SELECT f.sid, f.t, f.d, {", ".join(f"dl.{c}" for c in [f"y{d}", *features])} FROM pick f JOIN dl ON dl.sid = f.sid
            AND dl.i BETWEEN {oldest} + {max_p + most} AND f.e - {v} WHERE f.d = {d}), {chain}""")
    every = " UNION ALL ".join(nested_fits(f"g{d}", "sid, t", max_p, f", {d} AS d") for d in range(most + 1))
    out.append(f"fit AS MATERIALIZED (SELECT * FROM ({every}) QUALIFY row_number() OVER (PARTITION BY sid, t ORDER BY round(aic, 9), p) = 1)")
    steps = p_ahead + v
    xs = ", ".join(f"lag(x1, {k}) OVER w AS q{k}" for k in range(steps + most))
    out.append(f"rx AS (SELECT sid, i, t, {xs} FROM ret WINDOW w AS (PARTITION BY sid ORDER BY i))")
    by_d = lambda make: "CASE fit.d " + " ".join(f"WHEN {d} THEN {make(d)}" for d in range(most + 1)) + " END"
    state = ", ".join(f"{by_d(lambda d: f's{a}.y{d}')} AS st{a}" for a in range(max_p))  # noqa: B023
    at = " ".join(f"LEFT JOIN dl s{a} ON s{a}.sid = r.sid AND s{a}.i = r.t + {p_ahead - 1 - v - a}" for a in range(max_p))
    out.append(f"""h0 AS (SELECT r.*, fit.d, fit.c0, fit.b, {", ".join(f"fit.phi{a}" for a in range(1, max_p + 1))}, {state}, s0.y AS lev, s0.y - s1.y AS slo
        FROM rx r ASOF JOIN fit ON r.sid = fit.sid AND r.t >= fit.t {at})""")
    for h in range(1, steps + 1):
        k = steps - h
        u = f"CASE d WHEN 0 THEN q{k} WHEN 1 THEN q{k} - q{k + 1} ELSE q{k} - 2 * q{k + 1} + q{k + 2} END"
        moved = ", ".join(["nv AS st0"] + [f"st{a - 1} AS st{a}" for a in range(1, max_p)])
        out.append(f"""n{h} AS (SELECT *, c0 + b * ({u}) + {" + ".join(f"phi{a} * st{a - 1}" for a in range(1, max_p + 1))} AS nv FROM h{h - 1}),
        h{h} AS (SELECT * EXCLUDE (nv) REPLACE ({moved}, CASE d WHEN 2 THEN slo + nv ELSE nv END AS slo,
            CASE d WHEN 0 THEN nv WHEN 1 THEN lev + nv ELSE lev + slo + nv END AS lev) FROM n{h})""")
    out.append(f"""made AS (SELECT sid, i, lev AS pred FROM h{steps}),
    moved AS (SELECT r.sid, r.dt, m.pred, r.y AS "true" FROM ret r LEFT JOIN made m ON m.sid = r.sid AND m.i = r.i - {p_ahead} WHERE r.i >= {w + 2 * p_ahead - 1})""")
    return ",\n".join(out)


def truncated(k: int, width: int) -> tuple[str, list[str]]:
    """Intercept and slopes of the model that stops after the first ``k`` features of a chain, padded with zeros."""
    on_z = [f"c{j}" for j in range(1, k + 1)]
    beta = [""] * k
    for j in range(k, 0, -1):
        beta[j - 1] = f"({on_z[j - 1]})"
        for i in range(1, j):
            on_z[i - 1] = f"{on_z[i - 1]} - {beta[j - 1]} * s{j}_{i}"
    return "yb" + "".join(f" - {beta[j]} * m{j + 1}" for j in range(k)), beta + ["0.0::DOUBLE"] * (width - k)


def arma_fit(source: str, key: str, train: str, max_p: int = 5, max_q: int = 5, order: int = 5, long: int = 6) -> str:
    """CTE chain to ``fit``: residuals of a long regression, then every (p, q) on own lags and lagged residuals.

    ``source`` has ``i``, the target v0 and its lags v1.., the input w0 and its lags. Orders whose step-down
    coefficients reach 1 do not settle and are passed over.
    """
    chains = [gram_schmidt(source, key, ["w0"] + [f"v{a}" for a in range(1, long + 1)], "v0", train, "lg")]
    c0, beta = truncated(long + 1, long + 1)
    chains.append(f"""lf AS MATERIALIZED (SELECT {key}, any_value({c0}) AS lc, any_value({beta[0]}) AS lb,
        {", ".join(f"any_value({beta[a]}) AS lp{a}" for a in range(1, long + 1))} FROM lg GROUP BY {key})""")
    lags = ", ".join(f"lag(e_{long + 1}, {j}) OVER (PARTITION BY {key} ORDER BY i) AS r{j}" for j in range(1, max_q + 1))
    own = ", ".join(f"v{a}" for a in range(max_p + 1))
    chains.append(f"sd AS MATERIALIZED (SELECT * FROM (SELECT {key}, i, w0, {own}, {lags}, {train} AS fitted FROM lg) WHERE fitted)")
    cand = []
    for p in range(max_p + 1):
        most = min(max_q, order - p)
        features = ["w0"] + [f"v{a}" for a in range(1, p + 1)] + [f"r{j}" for j in range(1, most + 1)]
        chains.append(gram_schmidt("sd", key, features, "v0", "true", f"h{p}"))
        for q_ in range(most + 1):
            k = 1 + p + q_
            c0, beta = truncated(k, k)
            cells = [f"any_value({c0}) AS c0", f"any_value({beta[0]}) AS b"]
            cells += [f"any_value({beta[a]}) AS phi{a}" if a <= p else f"0.0::DOUBLE AS phi{a}" for a in range(1, max_p + 1)]
            cells += [f"any_value({beta[p + j]}) AS th{j}" if j <= q_ else f"0.0::DOUBLE AS th{j}" for j in range(1, max_q + 1)]
            cand.append(f"""SELECT {key}, {p} AS p, {q_} AS q, any_value(n_tr) * ln(any_value(rss_{k}) / any_value(n_tr)) + 2 * ({p + q_} + 2) AS aic,
                {", ".join(cells)} FROM h{p} GROUP BY {key}""")
    chains.append(f"""down0 AS (SELECT *, true AS ok, {", ".join(f"-phi{a} AS a{a}" for a in range(1, max_p + 1))},
        {", ".join(f"th{j} AS t{j}" for j in range(1, max_q + 1))} FROM ({" UNION ALL ".join(cand)}))""")
    for n, m in enumerate(range(max(max_p, max_q), 0, -1), 1):
        moved, fine = [], []
        for x, most in (("a", max_p), ("t", max_q)):
            if m <= most:
                fine.append(f"abs({x}{m}) < 1")
                moved += [f"({x}{i} - {x}{m} * {x}{m - i}) / nullif(1 - {x}{m} * {x}{m}, 0) AS {x}{i}" for i in range(1, m)]
        chains.append(f"down{n} AS (SELECT * REPLACE ({', '.join([*moved, f'ok AND {chr(32).join([fine[0], *(f"AND {x}" for x in fine[1:])])} AS ok'])}) FROM down{n - 1})")
    chains.append(f"""fit AS MATERIALIZED (SELECT * FROM down{max(max_p, max_q)} JOIN lf USING ({key}) WHERE ok
        QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY round(aic, 9), p + q, p) = 1)""")
    return ",\n".join(chains)


def arma_split(kind: str, max_p: int = 5, max_q: int = 5, long: int = 6) -> str:
    depth = long + max_q
    lags = ", ".join(["y AS v0"] + [f"x{a} AS v{a}" for a in range(1, depth + 1)] + [f"x{1 + j} AS w{j}" for j in range(max_q + 1)])
    error = lambda j: f"x{j} - lc - lb * x{1 + j}" + "".join(f" - lp{a} * x{j + a}" for a in range(1, long + 1))
    keep = [f"st{a}" for a in range(1, max_p + 1)] + [f"er{j}" for j in range(1, max_q + 1)]
    pred = "c0 + b * x1" + "".join(f" + phi{a} * st{a}" for a in range(1, max_p + 1)) + "".join(f" + th{j} * er{j}" for j in range(1, max_q + 1))
    first = [f"x{a} AS st{a}" for a in range(1, max_p + 1)] + [f"{error(j)} AS er{j}" for j in range(1, max_q + 1)]
    moved = ["r.pred AS st1"] + [f"r.st{a - 1} AS st{a}" for a in range(2, max_p + 1)] + ["0.0::DOUBLE AS er1"] + [f"r.er{j - 1} AS er{j}" for j in range(2, max_q + 1)]
    return f"""WITH RECURSIVE {split_rows(kind, depth + 1)}, av AS (SELECT sid, i, role, {lags} FROM spl),
    {arma_fit("av", "sid", f"(role = 'train' AND i >= {depth})")},
    ahead AS (SELECT s.*, row_number() OVER (PARTITION BY s.sid ORDER BY s.i) AS h, fit.* EXCLUDE (sid) FROM spl s JOIN fit ON fit.sid = s.sid WHERE s.role <> 'train'),
    rec AS (SELECT sid, h, {pred} AS pred, {", ".join(keep)} FROM (SELECT *, {", ".join(first)} FROM ahead WHERE h = 1)
        UNION ALL SELECT sid, h, {pred} AS pred, {", ".join(keep)} FROM (SELECT a.*, {", ".join(moved)} FROM rec r JOIN ahead a ON a.sid = r.sid AND a.h = r.h + 1)),
    moved AS (SELECT a.sid, a.dt, r.pred, a.y AS "true" FROM ahead a JOIN rec r ON r.sid = a.sid AND r.h = a.h WHERE a.role = 'test') {FORECAST_OUT}"""


def arma_wf(kind: str, spec: FoldSpec, max_p: int = 5, max_q: int = 5, long: int = 6) -> str:
    p_ahead, v, w, depth = spec.prediction_length, spec.validation_size, spec.window_size, long + max_q
    oldest = f"f.t - {w} + {p_ahead}" if spec.sliding_window else f"{p_ahead}"
    lags = [f"lag(y, {a}) OVER w AS v{a}" for a in range(1, depth + 1)] + [f"lag(u, {j}) OVER w AS w{j}" for j in range(1, max_q + 1)]
    columns = ", ".join([f"v{a}" for a in range(depth + 1)] + [f"w{j}" for j in range(max_q + 1)])
    steps = p_ahead + v
    error = lambda j: f"o.v{j} - lc - lb * o.w{j}" + "".join(f" - lp{a} * o.v{j + a}" for a in range(1, long + 1))
    state = [f"o.v{a} AS st{a}" for a in range(max_p)] + [f"{error(j)} AS er{j}" for j in range(max_q)]
    out = [f"""{capped_returns(kind, spec)},
    tgt AS (SELECT b.sid, b.i, coalesce(b.y, 0) AS y, coalesce(a.x1, 0) AS u FROM ret b JOIN ret a ON a.sid = b.sid AND a.i = b.i - {p_ahead}),
    dl AS MATERIALIZED (SELECT sid, i, y AS v0, u AS w0, {", ".join(lags)} FROM tgt WINDOW w AS (PARTITION BY sid ORDER BY i)),
    av AS (SELECT f.sid, f.t, dl.i, dl.i >= {oldest} + {depth} AS inside, {columns} FROM fold f JOIN dl ON dl.sid = f.sid
        AND dl.i BETWEEN {oldest} + {long} AND f.e - {v}),
    {arma_fit("av", "sid, t", "inside", max_p, max_q, 5, long)}"""]
    out.append(f"rx AS (SELECT sid, i, t, {', '.join(f'lag(x1, {k}) OVER w AS q{k}' for k in range(steps))} FROM ret WINDOW w AS (PARTITION BY sid ORDER BY i))")
    out.append(f"""h_0 AS (SELECT r.*, fit.* EXCLUDE (sid, t, i), {", ".join(state)} FROM rx r ASOF JOIN fit ON r.sid = fit.sid AND r.t >= fit.t
        LEFT JOIN dl o ON o.sid = r.sid AND o.i = r.t + {p_ahead - 1 - v})""".replace("EXCLUDE (sid, t, i)", "EXCLUDE (sid, t)"))
    for h in range(1, steps + 1):
        step = f"c0 + b * q{steps - h}" + "".join(f" + phi{a} * st{a - 1}" for a in range(1, max_p + 1)) + "".join(f" + th{j} * er{j - 1}" for j in range(1, max_q + 1))
        moved = [f"{step} AS st0"] + [f"st{a - 1} AS st{a}" for a in range(1, max_p)] + ["0.0::DOUBLE AS er0"] + [f"er{j - 1} AS er{j}" for j in range(1, max_q)]
        out.append(f"h_{h} AS (SELECT * REPLACE ({', '.join(moved)}) FROM h_{h - 1})")
    out.append(f"""made AS (SELECT sid, i, st0 AS pred FROM h_{steps}),
    moved AS (SELECT r.sid, r.dt, m.pred, r.y AS "true" FROM ret r LEFT JOIN made m ON m.sid = r.sid AND m.i = r.i - {p_ahead} WHERE r.i >= {w + 2 * p_ahead - 1})""")
    return ",\n".join(out)


def kpss(kind: str, lags: int) -> str:
    gammas = " + ".join(f"2 * {1 - s / (lags + 1)!r} * sum(g{s})" for s in range(1, lags + 1))
    shifted = ", ".join(f"e * lag(e, {s}) OVER w AS g{s}" for s in range(1, lags + 1))
    return f"""WITH {px(kind)},
    r AS (SELECT sid, dt, coalesce(price / lag(price) OVER (PARTITION BY sid ORDER BY dt) - 1, 0) AS r FROM px),
    c AS (SELECT sid, dt, r - avg(r) OVER (PARTITION BY sid) AS e FROM r),
    s AS (SELECT *, sum(e) OVER w AS ps, {shifted} FROM c WINDOW w AS (PARTITION BY sid ORDER BY dt)),
    k AS (SELECT sid, count(*) AS n_obs, sum(ps * ps) / (count(*) * (sum(e * e) + {gammas})) AS st FROM s GROUP BY 1)
    SELECT sid AS series_id, n_obs, {r6('st', 'statistic')}, CAST(st < 0.463 AS BIGINT) AS stationary FROM k"""


def random_wf(kind: str, spec: FoldSpec) -> str:
    """Floyd's sampling as a recursion, then folds without the drawn rows."""
    v, count = spec.validation_size, spec.window_size if spec.sliding_window else "t"
    low = f"t - {spec.window_size}" if spec.sliding_window else "0"
    at = f"({count} - {v} + k)"
    r = f"(('0x' || substr(md5(concat_ws(':', sid, t, {spec.seed}, {at})), 1, 8))::BIGINT % ({at} + 1))"
    return f"""WITH RECURSIVE {capped_returns(kind, spec)},
draw AS (SELECT sid, t, 0 AS k, CAST([] AS BIGINT[]) AS s FROM fold
    UNION ALL SELECT sid, t, k + 1, list_append(s, CASE WHEN list_contains(s, {r}) THEN {at} ELSE {r} END)
    FROM draw WHERE k < {v}),
held AS (SELECT sid, t, unnest(s) + {low} AS i FROM draw WHERE k = {v}),
fit AS (SELECT f.sid, f.t, regr_intercept(a.y, a.x1) AS c0, regr_slope(a.y, a.x1) AS c1
    FROM {train_join(spec, held=0)} ANTI JOIN held h ON h.sid = f.sid AND h.t = f.t AND h.i = a.i GROUP BY 1, 2),
{landed(spec, "c0 + c1 * r.x1 AS pred")} {FORECAST_OUT}"""


def median_wf(kind: str, spec: FoldSpec) -> str:
    return f"""WITH {capped_returns(kind, spec)}, fit AS (SELECT f.sid, f.t, coalesce(median(a.y) FILTER (WHERE a.x1 > 0), median(a.y)) AS up,
    coalesce(median(a.y) FILTER (WHERE a.x1 <= 0), median(a.y)) AS down FROM {train_join(spec)} GROUP BY 1, 2),
    {landed(spec, "CASE WHEN r.x1 IS NULL THEN NULL WHEN r.x1 > 0 THEN up ELSE down END AS pred")} {FORECAST_OUT}"""


def settings_scores() -> str:
    """Every setting as a job of its own; the last one is that of every tenth supplier."""
    slope = {"lr": "regr_slope(a.y, a.x1)", "ridge": "regr_sxy(a.y, a.x1) / (regr_sxx(a.y, a.x1) + 5)", "nonneg": "greatest(regr_slope(a.y, a.x1), 0)", "mean": "0.0"}
    runs = []
    for name, _, model, _, w, p, v, f in [*q.GRID_SETTINGS, ("own", None, "mean", 0.0, 100, 5, 3, 5)]:
        spec = q.GRID.but(window_size=w, prediction_length=p, validation_size=v, frequency=f)
        some = "WHERE CAST(sid AS BIGINT) % 10 = 0" if name == "own" else ""
        runs.append(f"""SELECT sid, '{name}' AS model, pred, "true" FROM (WITH {capped_returns("supp", spec)},
            fit AS (SELECT f.sid, f.t, {slope[model]} AS c1, avg(a.y) - c1 * avg(a.x1) AS c0 FROM {train_join(spec)} GROUP BY 1, 2),
            {landed(spec, "c0 + c1 * r.x1 AS pred")} SELECT * FROM moved) {some}""")
    return f"""WITH ev AS ({" UNION ALL ".join(runs)}), sc AS ({scores("ev")})
    SELECT series_id, model, n_obs, {r6('rmse', 'rmse')}, {r6('mae', 'mae')},
    row_number() OVER (PARTITION BY series_id ORDER BY rmse, model) AS place FROM sc"""


def supervised(kind: str, n_in: int, n_out: int) -> str:
    cols = [f"lag(price, {m}) OVER w AS var1_lag{m}" for m in range(n_in, 0, -1)] + ["price AS var1"]
    cols += [f"lead(price, {m}) OVER w AS var1_lead{m}" for m in range(1, n_out)]
    return f"""WITH {px(kind)} SELECT sid AS series_id, dt, row_number() OVER w - 1 AS i, {", ".join(cols)}
    FROM px WINDOW w AS (PARTITION BY sid ORDER BY dt)"""


def members() -> str:
    """Rows of a fold by plain bounds: t-W .. t-V-1 train, t-V .. t-1 validate, t .. t+P-1 are scored."""
    spec = q.MEMBERS
    w, p, v = spec.window_size, spec.prediction_length, spec.validation_size

    def rows(low: int, high: int) -> str:
        return f"""SELECT f.sid, f.t, r.i, r.x1, r.ahead AS y FROM (SELECT sid, t, unnest(range(t + {low}, t + {high})) AS i FROM fold) f
            JOIN (SELECT *, lead(y, {p}) OVER (PARTITION BY sid ORDER BY i) AS ahead FROM ret) r ON r.sid = f.sid AND r.i = f.i"""

    return f"""WITH {capped_returns("flag", spec)}, score AS ({rows(0, p)}), val AS ({rows(-v, 0)}), train AS ({rows(-w, -v)})"""


def cumulative(ctes: str) -> str:
    def log_of(c: str) -> str:
        f = f"(1 + coalesce({c}, 0))"
        zero = f"sum(CASE WHEN {f} = 0 THEN 1 ELSE 0 END) OVER w > 0"
        odd = f"sum(CASE WHEN {f} < 0 THEN 1 ELSE 0 END) OVER w % 2 = 1"
        size = f"sum(CASE WHEN {f} <> 0 THEN ln(abs({f})) ELSE 0 END) OVER w"
        return f"CASE WHEN {zero} THEN '-inf'::DOUBLE WHEN {odd} THEN 'nan'::DOUBLE ELSE round({size}, 6) + 0.0 END"

    return f"""WITH {ctes} SELECT sid AS series_id, dt, {log_of('pred')} AS cum_pred, {log_of('"true"')} AS cum_true
    FROM moved WINDOW w AS (PARTITION BY sid ORDER BY dt ROWS UNBOUNDED PRECEDING)"""


def schedule(kind: str, spec: FoldSpec) -> str:
    low = f"t - {spec.window_size}" if spec.sliding_window else "CAST(0 AS BIGINT)"
    return f"""WITH {capped_returns(kind, spec)} SELECT sid AS series_id, t, dt AS as_of, {low} AS train_from,
    t - {spec.validation_size} - 1 AS train_to, CAST(t % {spec.frequency} = 0 AS BIGINT) AS refit
    FROM ret WHERE t BETWEEN {spec.window_size} AND n - {spec.prediction_length}"""


def returns_of(kind: str, k: int) -> str:
    return f"""WITH {px(kind)} SELECT sid AS series_id, dt, {r6(f"price / lag(price, {k}) OVER w - 1", "ret")}
    FROM px WINDOW w AS (PARTITION BY sid ORDER BY dt)"""


def oracle_sql() -> dict[str, str]:
    lr, svr, free = q.LR, q.SVR, q.GRID
    mean = lr.but(frequency=7, sliding_window=False)
    plain = "SELECT sid AS series_id, dt, price FROM"
    flag_wf = linear_wf("flag", lr)
    out = {
        "price_bars": f"WITH {px('flag')} {plain} px",
        "order_bars": f"WITH {px('order')} {plain} px",
        "event_grid": f"WITH {px('event')} {plain} px",
        "wide_to_long": f"WITH {px('flag')} {plain} px",
        "instrument_pick": f"WITH {px('flag')} {plain} px WHERE sid = 'N'",
        "ffill_grid": f"WITH {px('event')}, {FILLED} {plain} filled",
        "leading_null_drop": f"""WITH {px('event')}, first AS (SELECT sid, min(dt) AS first_dt FROM px WHERE price IS NOT NULL GROUP BY 1)
            SELECT px.sid AS series_id, first_dt, count(*) FILTER (WHERE px.dt >= first_dt) AS n_kept,
            count(*) FILTER (WHERE px.dt < first_dt) AS n_dropped FROM px JOIN first USING (sid) GROUP BY 1, 2""",
        "fill_zero": f"WITH {px('event')} SELECT sid AS series_id, dt, coalesce(price, 0.0) AS price FROM px",
        "inf_guard": """SELECT l_orderkey, l_linenumber, CASE WHEN l_tax = 0 THEN 0.0 ELSE l_discount / l_tax END AS ratio
            FROM lineitem""",
        "date_cap": f"""WITH {px('flag')} {plain} px WHERE NOT (dt < DATE '{lr.start_date}' OR dt > DATE '{lr.end_date}')""",
        "returns_1": returns_of("flag", 1),
        "returns_k": returns_of("order", 5),
        "returns_filled": f"""WITH {px('event')}, {FILLED}, pr AS (SELECT sid, dt, price, lag(price) OVER w AS p0 FROM filled
            WINDOW w AS (PARTITION BY sid ORDER BY dt)) SELECT sid AS series_id, dt,
            CASE WHEN p0 = 0 AND price <> 0 THEN 0.0 WHEN p0 = 0 THEN NULL ELSE {r6('price / p0 - 1', 'x').rsplit(' AS ', 1)[0]} END AS ret FROM pr""",
        "supervised_3_1": supervised("flag", 3, 1),
        "supervised_2_3": supervised("supp", 2, 3),
        "supervised_multivar": f"""WITH {px('flag')}, un AS (SELECT l_returnflag AS sid, CAST(l_shipdate AS DATE) AS dt,
            sum(l_quantity) AS units FROM lineitem GROUP BY 1, 2)
            SELECT px.sid AS series_id, px.dt, row_number() OVER w - 1 AS i,
            lag(price, 2) OVER w AS var1_lag2, lag(units, 2) OVER w AS var2_lag2,
            lag(price, 1) OVER w AS var1_lag1, lag(units, 1) OVER w AS var2_lag1, price AS var1, units AS var2,
            lead(price, 1) OVER w AS var1_lead1, lead(units, 1) OVER w AS var2_lead1
            FROM px JOIN un ON un.sid = px.sid AND un.dt = px.dt WINDOW w AS (PARTITION BY px.sid ORDER BY px.dt)""",
        "horizon_pairs": f"""WITH {px('flag')}, num AS (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY dt) - 1 AS i FROM px)
            SELECT a.sid AS series_id, a.dt, a.i, a.price AS x, b.price AS target
            FROM num a LEFT JOIN num b ON b.sid = a.sid AND b.i = a.i + 10""",
        "key_check": """SELECT l_returnflag AS series_id, CAST(l_shipdate AS DATE) AS dt, count(*) AS copies
            FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""",
        "index_check": f"""WITH {px('flag')} SELECT dt, CAST(count(*) FILTER (WHERE sid = 'A') AS INTEGER) AS in_left,
            CAST(count(*) FILTER (WHERE sid = 'N') AS INTEGER) AS in_right
            FROM px WHERE sid IN ('A', 'N') GROUP BY 1 HAVING count(*) = 1""",
        "index_check_all": f"""WITH {px('supp')}, total AS (SELECT count(DISTINCT sid) AS k FROM px)
            SELECT dt, count(DISTINCT sid) AS present, (SELECT k FROM total) - present AS missing FROM px GROUP BY 1 HAVING missing > 0""",
        "length_check": f"""WITH {px('supp')} SELECT sid AS series_id, count(*) AS n_rows, count(price) AS n_prices,
            CAST(count(*) > {lr.window_size} AS BIGINT) AS fits FROM px GROUP BY 1""",
        "split_train_val_test": f"WITH {split_rows('supp', 1)} SELECT sid AS series_id, dt, i, role FROM spl",
        "fold_schedule": schedule("flag", lr.but(frequency=7)),
        "fold_schedule_growing": schedule("supp", lr.but(sliding_window=False)),
        "wf_val_rows": f"{members()} SELECT sid AS series_id, t, i, {r6('coalesce(x1, 0)', 'x')}, {r6('coalesce(y, 0)', 'target')} FROM val",
        "fold_train_anti": f"{members()} SELECT sid AS series_id, t, i, {r6('coalesce(x1, 0)', 'x')} FROM train",
        "fold_targets_semi": f"{members()} SELECT sid AS series_id, t, i, {r6('coalesce(y, 0)', 'target')} FROM train",
        "fold_score_rows": f"{members()} SELECT sid AS series_id, t, i, {r6('x1', 'x')} FROM score",
        "lr_single_split": f"WITH {split_linear('supp', 1)} {FORECAST_OUT}",
        "lr_multi_feature": f"WITH {split_linear('flag', 3)} {FORECAST_OUT}",
        "lr_no_intercept": f"WITH {split_linear('flag', 1, 'no_intercept')} {FORECAST_OUT}",
        "lr_nonneg": f"WITH {split_linear('supp', 1, 'nonneg')} {FORECAST_OUT}",
        "lr_nonneg_wide": f"WITH RECURSIVE {nonneg_wide('supp', 5)} {FORECAST_OUT}",
        "wf_lr_sliding": f"WITH {flag_wf} {FORECAST_OUT}",
        "wf_lr_suppliers": f"WITH {linear_wf('supp', lr)} {FORECAST_OUT}",
        "wf_lr_growing": f"WITH {linear_wf('supp', lr.but(sliding_window=False))} {FORECAST_OUT}",
        "wf_lr_refit7": f"WITH {linear_wf('flag', lr.but(frequency=7))} {FORECAST_OUT}",
        "wf_lr_two_features": f"WITH {linear_wf('flag', lr.but(lags=2, frequency=7, validation_size=21))} {FORECAST_OUT}",
        "wf_lr_long_returns": f"WITH {linear_wf('order', lr.but(input_pct_change=5, output_pct_change=2))} {FORECAST_OUT}",
        "wf_lr_blocked": f"WITH {flag_wf} {FORECAST_OUT}",
        "wf_random_validation": random_wf("flag", q.RANDOM),
        "wf_random_growing": random_wf("flag", q.RANDOM_GROWING),
        "wf_custom_blackbox": median_wf("flag", q.BLACKBOX),
        "wf_custom_blackbox_growing": median_wf("flag", q.BLACKBOX_GROWING),
        "grid_settings": settings_scores(),
        "svr_tube_single": f"WITH {split_tube('supp', 3, q.TUBE)} {TUBE_OUT}",
        "wf_svr_tube": f"WITH {tube_wf('flag', svr, q.TUBE)} {TUBE_OUT}",
        "wf_svr_tube_growing": f"WITH {tube_wf('flag', svr.but(sliding_window=False, frequency=7), q.TUBE)} {TUBE_OUT}",
        "wf_svr_log": f"WITH {tube_wf('log', svr, 0.1)} {TUBE_OUT}",
        "wf_error": f"""WITH {flag_wf} SELECT sid AS series_id, dt, {r6('pred - "true"', 'error')} FROM moved""",
        "wf_sq_error": f"""WITH {flag_wf} SELECT sid AS series_id, dt, {r6('(pred - "true") ^ 2', 'sq_error')} FROM moved""",
        "wf_metrics": f"""WITH {linear_wf('supp', lr)}, named AS (SELECT *, 'lr' AS model FROM moved), sc AS ({scores('named')})
            SELECT series_id, model, n_obs, {", ".join(r6(c, c) for c in ("mse", "rmse", "mae", "r2", "hit_rate"))} FROM sc""",
        "cum_log_return": cumulative(flag_wf),
        "cum_log_return_single": cumulative(split_linear("flag", 3)),
        "cum_log_return_models": " UNION ALL ".join(
            f"SELECT series_id, '{m}' AS model, dt, cum_pred FROM ({cumulative(c)})"
            for m, c in (("lr", flag_wf), ("svr", tube_wf("flag", svr, q.TUBE)))
        ),
        "reattach_dates": f"""WITH {flag_wf} SELECT sid AS series_id, dt, {r6('"true" - pred', 'error')} FROM moved
            WHERE pred IS NOT NULL AND "true" IS NOT NULL""",
        "kpss_level": kpss("supp", q.KPSS_LAGS),
        "arx_order_aic": ar_orders("flag", 5),
        "arx_fit": ar_coefficients("supp", 5),
        "arx_split": ar_split_forecasts("flag", 5),
        "wf_arx_forecast": f"WITH {ar_wf('flag', q.AR, 5)} {FORECAST_OUT}",
        "wf_arx_sliding": f"WITH {ar_wf('flag', q.AR.but(sliding_window=True), 5)} {FORECAST_OUT}",
        "wf_arx_same_steps": f"WITH {ar_wf('flag', q.AR, 5, compat=True)} {FORECAST_OUT}",
        "wf_arx_difference_sliding": f"WITH {ar_wf_tested('flag', q.AR_SLIDING, 5)} {FORECAST_OUT}",
        "wf_arx_difference": f"WITH {ar_wf_tested('flag', q.AR, 5)} {FORECAST_OUT}",
        "arma_split": arma_split("flag"),
        "arma_hr": f"WITH {arma_wf('flag', q.AR)} {FORECAST_OUT}",
        "arma_hr_sliding": f"WITH {arma_wf('flag', q.AR.but(sliding_window=True))} {FORECAST_OUT}",
        "wf_svr_flat": f"WITH {tube_wf('flag', svr.but(frequency=7), 1e6)} {FORECAST_OUT}",
        "wf_model_reload": f"WITH {linear_wf('flag', lr.but(frequency=7))} {FORECAST_OUT}",
        "wf_model_asof": f"WITH {linear_wf('flag', lr.but(frequency=7), 't // 7 % 3 <> 1')} {FORECAST_OUT}",
        "stream_bars": """SELECT event_type AS series_id, date_trunc('hour', ts) AS dt,
            CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / 100.0::DOUBLE / count(value) AS price
            FROM events WHERE event_type IS NOT NULL AND ts IS NOT NULL GROUP BY 1, 2""",
        "stream_score": f"WITH {split_linear('flag', 2)} {FORECAST_OUT}",
        "csv_roundtrip": f"WITH {px('flag')} {plain} px",
        "wf_custom_mean": f"""WITH {capped_returns('flag', mean)}, fit AS (SELECT f.sid, f.t, avg(a.y) AS c0 FROM {train_join(mean)} GROUP BY 1, 2),
            {landed(mean, 'c0 AS pred')} {FORECAST_OUT}""",
        "wf_custom_ridge": f"""WITH {capped_returns('supp', lr)}, fit AS (SELECT f.sid, f.t, regr_sxy(a.y, a.x1) / (regr_sxx(a.y, a.x1) + 5) AS c1,
            avg(a.y) - c1 * avg(a.x1) AS c0 FROM {train_join(lr)} GROUP BY 1, 2), {landed(lr, 'c0 + c1 * r.x1 AS pred')} {FORECAST_OUT}""",
        "custom_split": f"""WITH {split_rows('supp', 1)}, fit AS (SELECT sid, regr_sxy(y, x1) / (regr_sxx(y, x1) + 5) AS c1,
            avg(y) - c1 * avg(x1) AS c0 FROM spl WHERE role = 'train' GROUP BY 1),
            moved AS (SELECT s.sid, s.dt, c0 + c1 * s.x1 AS pred, s.y AS "true" FROM spl s JOIN fit USING (sid) WHERE s.role = 'test') {FORECAST_OUT}""",
        "model_roundtrip": f"WITH {split_linear('flag', 2)} {FORECAST_OUT}",
    }
    slopes = """regr_slope({y}, {x}) AS s0, greatest(regr_slope({y}, {x}), 0) AS s1, regr_sxy({y}, {x}) / (regr_sxx({y}, {x}) + 5) AS s2,
        0.0 AS s3, avg({y}) AS my, avg({x}) AS mx"""
    preds = ", ".join(f"my + s{k} * ({{x}} - mx) AS p{k}" for k in range(4))
    names = ("lr", "nonneg", "ridge", "mean")
    runs = {
        "wf": f"""{capped_returns("supp", free)}, fit AS (SELECT f.sid, f.t, {slopes.format(y="a.y", x="a.x1")} FROM {train_join(free)} GROUP BY 1, 2),
            {landed(free, preds.format(x="r.x1"))}""",
        "split": f"""{split_rows("supp", 1)}, fit AS (SELECT sid, {slopes.format(y="y", x="x1")} FROM spl WHERE role = 'train' GROUP BY 1),
            moved AS (SELECT s.sid, s.dt, {preds.format(x="s.x1")}, s.y AS "true" FROM spl s JOIN fit USING (sid) WHERE s.role = 'test')""",
    }
    union = " UNION ALL ".join(
        f"""SELECT sid, model, dt, pred, "true" FROM (WITH {ctes} SELECT sid, dt, "true", unnest([{", ".join(f"'{n}_{mode}'" for n in names)}]) AS model,
            unnest([p0, p1, p2, p3]) AS pred FROM moved)"""
        for mode, ctes in runs.items()
    )
    out["grid_leaderboard"] = f"""WITH ev AS ({union}), al AS (SELECT * FROM ev
        QUALIFY count(*) FILTER (WHERE pred IS NOT NULL AND "true" IS NOT NULL) OVER (PARTITION BY sid, dt) = 8), sc AS ({scores('al')})
        SELECT series_id, model, n_obs, {r6('rmse', 'rmse')}, {r6('mae', 'mae')},
        row_number() OVER (PARTITION BY series_id ORDER BY rmse, model) AS place FROM sc"""
    return out
