"""DuckDB SQL texts that recompute each registered query independently.

Trainers are unrolled: iteration ``i`` is a chain of CTEs over a long ``(rid, j, v)``
table of the fixture -- margins, per-row loss and multiplier, the sampled batch, the
mean gradient by ``j``, and the updated weight table ``(j, w, s1, s2, p)`` (two state
columns and the previous weights). Update rules are written out here in SQL by hand, so
the check does not reuse the Python rule code.
"""

from __future__ import annotations

import math

# ---------------------------------------------------------------------------------------
# literals and fixtures

_TWO_32 = "4294967296.0"


def lit(x: float) -> str:
    """A DOUBLE literal that parses to exactly ``x``."""
    if isinstance(x, float) and math.isnan(x):
        return "'nan'::DOUBLE"
    return f"'{float(x)!r}'::DOUBLE"


def md5_uniform(key_sql: str, seed: int) -> str:
    return (f"((('0x' || substr(md5(CAST({key_sql} AS VARCHAR) || ':' || '{int(seed)}'), 1, 8))::BIGINT)::DOUBLE"
            f" / {_TWO_32})")


def md5_sample(key_sql: str, seed: int, fraction: float) -> str:
    if fraction >= 1.0:
        return "TRUE"
    return f"{md5_uniform(key_sql, seed)} < {lit(fraction)}"


FX1 = ("SELECT vec_id AS key, CASE WHEN label < 5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS y, "
       "CAST(embedding AS DOUBLE[]) AS x FROM embeddings")
FX2 = ("SELECT l_orderkey AS key, CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS y, "
       "[1.0::DOUBLE, l_quantity / 50.0, l_extendedprice / 105000.0, l_discount * 10.0, l_tax * 12.5] AS x FROM lineitem")
FX3 = "SELECT vec_id AS key, CAST(label AS DOUBLE) AS y, CAST(embedding AS DOUBLE[]) AS x FROM embeddings"
FX4 = ("SELECT l_orderkey AS key, l_extendedprice / 105000.0 AS y, "
       "[1.0::DOUBLE, l_quantity / 50.0, p_retailprice / 1000.0] AS x FROM lineitem JOIN part ON l_partkey = p_partkey")
FX5 = ("SELECT l.doc_id AS key, CAST(l.quality AS DOUBLE) AS y, "
       "[1.0::DOUBLE, d.n_chars / 10000.0, len(string_split(d.text, ' ')) / 2000.0] AS x "
       "FROM labels l JOIN documents d ON l.doc_id = d.doc_id")

FIXTURE_SQL = {"fx1": (FX1, 64, True), "fx2": (FX2, 5, False), "fx3": (FX3, 64, True), "fx4": (FX4, 3, False),
               "fx5": (FX5, 3, True)}


def fixture_ctes(fx: str, where: str | None = None, intercept: bool = False) -> list[str]:
    """``base(rid, key, y, x)`` and long ``lx(rid, j, v)`` CTEs of a dense fixture; with
    ``intercept`` every row gets a constant 1.0 feature at ``j = d``."""
    sql, d, unique = FIXTURE_SQL[fx]
    src = f"SELECT * FROM ({sql}) f" + (f" WHERE {where}" if where else "")
    rid = "key" if unique else "row_number() OVER ()"
    long = "SELECT rid, CAST(unnest(range(len(x))) AS INTEGER) AS j, unnest(x) AS v FROM base"
    if intercept:
        long += f" UNION ALL SELECT rid, {d} AS j, 1.0::DOUBLE AS v FROM base"
    return [
        f"base AS MATERIALIZED (SELECT {rid} AS rid, key, y, x FROM ({src}) s)",
        f"lx AS MATERIALIZED ({long})",
    ]


def wide_fixture_ctes() -> list[str]:
    """FX6: FX1 in long form without entries that are exactly zero."""
    return [
        f"base AS MATERIALIZED (SELECT key AS rid, key, y FROM ({FX1}) s)",
        "lx AS MATERIALIZED (SELECT rid, j, v FROM (SELECT key AS rid, CAST(unnest(range(len(x))) AS INTEGER) AS j, "
        f"unnest(x) AS v FROM ({FX1}) s) t WHERE v <> 0)",
    ]


def rule_weight(j: str = "j") -> str:
    """Fixed-rule weight vector used by the loss and gradient checks: ((j % 7) - 3) / 10."""
    return f"((({j}) % 7) - 3) / 10.0"


# ---------------------------------------------------------------------------------------
# losses: (loss, mult) of a margin z and label y

def log1pexp(x: str) -> str:
    return f"(CASE WHEN ({x}) > 0 THEN ({x}) + ln(1 + exp(-({x}))) ELSE ln(1 + exp({x})) END)"


def loss_sql(loss: str, z: str = "z", y: str = "y") -> tuple[str, str]:
    if loss == "logistic":
        m = f"(-({z}))"
        lpe = log1pexp(m)
        return f"CASE WHEN {y} > 0 THEN {lpe} ELSE {lpe} - {m} END", f"1.0 / (1.0 + exp({m})) - {y}"
    if loss == "least_squares":
        return f"(({z}) - {y}) * (({z}) - {y}) / 2.0", f"(({z}) - {y})"
    if loss == "hinge":
        zy = f"((2.0 * {y} - 1.0) * ({z}))"
        return (f"CASE WHEN 1.0 > {zy} THEN 1.0 - {zy} ELSE 0.0 END",
                f"CASE WHEN 1.0 > {zy} THEN -(2.0 * {y} - 1.0) ELSE 0.0 END")
    if loss == "squared_hinge":
        zy = f"((2.0 * {y} - 1.0) * ({z}))"
        return (f"CASE WHEN 1.0 > {zy} THEN (1.0 - {zy}) * (1.0 - {zy}) ELSE 0.0 END",
                f"CASE WHEN 1.0 > {zy} THEN -2.0 * (2.0 * {y} - 1.0) * (1.0 - {zy}) ELSE 0.0 END")
    raise ValueError(loss)


# ---------------------------------------------------------------------------------------
# update rules, hand-written: inputs w (weights), g (mean gradient), s1/s2 (state), p (previous
# weights); return SQL for the new (w, s1, s2, p)

def update_sql(method: str, variant: str, penalty: str, step: float, reg: float, i: int, t: int) -> tuple[str, str, str, str]:
    eta = step / math.sqrt(i)
    lam = 0.0 if penalty == "none" else reg

    def plain(gexpr: str) -> str:
        if penalty == "none":
            return f"(w - {lit(eta)} * ({gexpr}))"
        if penalty == "l1":
            u = f"(w - {lit(eta)} * ({gexpr}))"
            return f"(sign({u}) * greatest(0.0, abs({u}) - {lit(lam * eta)}))"
        return f"({lit(1.0 - eta * lam)} * w - {lit(eta)} * ({gexpr}))"

    if method == "sgd":
        return plain("g"), "s1", "s2", "p"
    if method == "momentum":
        if t == 0:
            new = plain("g")
        elif variant == "observed":
            new = plain("g - w") if t == 1 else plain(f"g - {lit(0.9 * eta)} * (w - p)")
        else:
            new = f"({plain('g')} + 0.9 * (w - p))"
        return new, "s1", "s2", "w"
    if method == "adagrad":
        gsq = "(s1 + g * g)"
        rate = f"(1.0 / sqrt({gsq} + 1e-6))"
        return f"((1.0 - {lit(step * lam)} * {rate}) * w - {lit(step)} * {rate} * g)", gsq, "s2", "p"
    if method == "adadelta":
        tt = f"(g + {lit(lam)} * w)"
        esq = f"(0.95 * s1 + 0.05 * {tt} * {tt})"
        move = f"(sqrt(s2 + 1e-6) / sqrt({esq} + 1e-6) * {tt})"
        dsq = f"(0.95 * s2 + 0.05 * {move} * {move})"
        new = f"(w + {dsq})" if variant == "observed" else f"(w - {move})"
        return new, esq, dsq, "p"
    if method == "adam":
        tt = f"(g + {lit(lam)} * w)"
        v = f"(0.99 * s2 + 0.01 * {tt} * {tt})"
        m = f"(0.9 * s1 + 0.1 * {tt})"
        if variant == "observed":
            mh, vh = f"({m} / 0.1)", f"({v} / 0.01)"
        else:
            mh, vh = f"({m} / {lit(1.0 - 0.9 ** (t + 1))})", f"({v} / {lit(1.0 - 0.99 ** (t + 1))})"
        return f"(w - {lit(step)} * {mh} / (sqrt({vh}) + 1e-8))", m, v, "p"
    if method == "sign_sgd":
        return f"(w - {lit(eta)} * sign(g))", "s1", "s2", "p"
    if method == "rms":
        sq = "(0.9 * s1 + 0.1 * (g * g))"
        return f"(w - {lit(step)} * g / (sqrt({sq}) + 1e-6))", sq, "s2", "p"
    raise ValueError(method)


def penalty_sql(penalty: str, reg: float, table: str, free_j: int | None = None) -> str:
    """Penalty value of the weights in ``table`` as a scalar subquery (slot ``free_j``,
    an unpenalised bias, left out)."""
    if penalty == "none" or reg == 0.0:
        return "0.0"
    cond = f" WHERE j <> {free_j}" if free_j is not None else ""
    if penalty == "l1":
        return f"(SELECT {lit(reg)} * sum(abs(w)) FROM {table}{cond})"
    return f"(SELECT {lit(0.5 * reg)} * sum(w * w) FROM {table}{cond})"


# ---------------------------------------------------------------------------------------
# unrolled binary / regression trainer

def unrolled_ctes(*, loss: str = "logistic", method: str = "sgd", variant: str = "published", penalty: str = "l2",
                  step: float = 1.0, reg: float = 0.0, iters: int = 3, fraction: float = 1.0, d: int = 64,
                  init: str = "0.0", seed: int = 42, free_j: int | None = None) -> list[str]:
    """CTEs ``w0 .. w{iters}`` (weight table after each iteration) and ``h1 .. h{iters}``
    (history rows) over ``base``/``lx``. Every batch in the checks is non-empty, so the
    number of updates before iteration ``i`` is ``i - 1``; an empty batch keeps the weights."""
    reported = "l2" if method in ("adagrad", "adadelta", "adam") else penalty
    lam = 0.0 if penalty == "none" else reg
    init_sql = init.replace("j", "range")
    ctes = [f"w0 AS MATERIALIZED (SELECT CAST(range AS INTEGER) AS j, CAST({init_sql} AS DOUBLE) AS w, "
            f"0.0::DOUBLE AS s1, 0.0::DOUBLE AS s2, 0.0::DOUBLE AS p FROM range({d}))"]
    lcol, mcol = loss_sql(loss)
    for i in range(1, iters + 1):
        prev = f"w{i - 1}"
        ctes.append(
            f"m{i} AS (SELECT b.rid, b.key, b.y, coalesce(s.z, 0.0) AS z FROM base b LEFT JOIN "
            f"(SELECT lx.rid, sum(lx.v * ww.w) AS z FROM lx JOIN {prev} ww ON lx.j = ww.j GROUP BY lx.rid) s "
            f"ON b.rid = s.rid)")
        ctes.append(f"r{i} AS MATERIALIZED (SELECT rid, y, z, {lcol} AS loss, {mcol} AS mult FROM m{i} "
                    f"WHERE {md5_sample('key', seed + i, fraction)})")
        ctes.append(f"n{i} AS MATERIALIZED (SELECT count(*) AS n, sum(loss) AS ls FROM r{i})")
        ctes.append(f"g{i} AS (SELECT lx.j, sum(r.mult * lx.v) AS gs FROM lx JOIN r{i} r ON lx.rid = r.rid "
                    f"GROUP BY lx.j)")
        ctes.append(f"h{i} AS (SELECT {i} AS iter, n.ls / n.n AS loss, {penalty_sql(reported, lam, prev, free_j)} AS reg, "
                    f"n.n AS batch_rows FROM n{i} n WHERE n.n > 0)")
        new_w, s1, s2, pp = update_sql(method, variant, penalty, step, reg, i, i - 1)
        if free_j is not None:
            fw, f1, f2, fp = update_sql(method, variant, penalty, step, 0.0, i, i - 1)
            new_w, s1, s2, pp = (f"(CASE WHEN j = {free_j} THEN {a} ELSE {b} END)"
                                 for a, b in ((fw, new_w), (f1, s1), (f2, s2), (fp, pp)))
        ctes.append(
            f"w{i} AS MATERIALIZED (SELECT j, CASE WHEN n > 0 THEN {new_w} ELSE w END AS w, "
            f"CASE WHEN n > 0 THEN {s1} ELSE s1 END AS s1, CASE WHEN n > 0 THEN {s2} ELSE s2 END AS s2, "
            f"CASE WHEN n > 0 THEN {pp} ELSE p END AS p FROM "
            f"(SELECT ww.j, ww.w, ww.s1, ww.s2, ww.p, nn.n, coalesce(gg.gs, 0.0) / greatest(nn.n, 1) AS g "
            f"FROM {prev} ww LEFT JOIN g{i} gg ON ww.j = gg.j CROSS JOIN n{i} nn) q)")
    return ctes


def trainer_sql(fx: str, *, select: str | None = None, loss: str = "logistic", method: str = "sgd",
                variant: str = "published", penalty: str = "l2", step: float = 1.0, reg: float = 0.0,
                iters: int = 3, fraction: float = 1.0, init: str = "0.0", where: str | None = None,
                wide: bool = False, extra: list[str] | None = None, intercept: bool = False,
                penalise_bias: bool = True) -> str:
    """Full query: fixture CTEs, the unrolled trainer and a final SELECT (default: the
    weights after the last iteration as ``(idx, weight)`` rounded to 6 decimals)."""
    d = 64 if wide else FIXTURE_SQL[fx][1]
    ctes = wide_fixture_ctes() if wide else fixture_ctes(fx, where, intercept)
    free_j = d if intercept and not penalise_bias else None
    ctes += unrolled_ctes(loss=loss, method=method, variant=variant, penalty=penalty, step=step, reg=reg,
                          iters=iters, fraction=fraction, d=d + 1 if intercept else d, init=init, free_j=free_j)
    ctes += extra or []
    final = select or (f"SELECT j AS idx, round(w, 6) + 0.0 AS weight FROM w{iters}")
    return "WITH " + ",\n".join(ctes) + "\n" + final


# ---------------------------------------------------------------------------------------
# multinomial

def multinomial_ctes(k: int, d: int, iters: int, step: float, reg: float, init: str = "0.0") -> list[str]:
    """Unrolled multinomial SGD + L2 over ``base``/``lx``; weights ``wc{i}(c, j, w)`` for
    classes c = 1..k."""
    ctes = [f"wc0 AS MATERIALIZED (SELECT CAST(c.range AS INTEGER) AS c, CAST(jj.range AS INTEGER) AS j, "
            f"CAST({init} AS DOUBLE) AS w FROM range(1, {k + 1}) c CROSS JOIN range({d}) jj)"]
    for i in range(1, iters + 1):
        prev = f"wc{i - 1}"
        eta = step / math.sqrt(i)
        ctes += multinomial_row_ctes(prev, f"_{i}")
        ctes.append(f"gc{i} AS (SELECT mr.c, lx.j, sum(mr.mult * lx.v) / (SELECT count(*) FROM base) AS g "
                    f"FROM lx JOIN mult_{i} mr ON lx.rid = mr.rid GROUP BY mr.c, lx.j)")
        ctes.append(f"wc{i} AS MATERIALIZED (SELECT ww.c, ww.j, {lit(1.0 - eta * reg)} * ww.w - {lit(eta)} * "
                    f"coalesce(gg.g, 0.0) AS w FROM {prev} ww LEFT JOIN gc{i} gg ON ww.c = gg.c AND ww.j = gg.j)")
    return ctes


def multinomial_row_ctes(weights: str, tag: str) -> list[str]:
    """Per-row margins, loss and multipliers of the multinomial loss at ``weights``."""
    return [
        f"z{tag} AS (SELECT b.rid, b.y, ww.c, sum(lx.v * ww.w) AS z FROM base b JOIN lx ON b.rid = lx.rid "
        f"JOIN {weights} ww ON lx.j = ww.j GROUP BY b.rid, b.y, ww.c)",
        f"sh{tag} AS (SELECT rid, y, greatest(0.0, max(z)) AS shift FROM z{tag} GROUP BY rid, y)",
        f"den{tag} AS (SELECT s.rid, s.y, s.shift, exp(-s.shift) + sum(exp(z.z - s.shift)) AS denom, "
        f"coalesce(sum(CASE WHEN z.c = s.y THEN z.z END), 0.0) AS zy FROM sh{tag} s JOIN z{tag} z ON s.rid = z.rid "
        f"GROUP BY s.rid, s.y, s.shift)",
        f"mult{tag} AS (SELECT z.rid, z.c, exp(z.z - d.shift) / d.denom - CASE WHEN d.y = z.c THEN 1.0 ELSE 0.0 END "
        f"AS mult FROM z{tag} z JOIN den{tag} d ON z.rid = d.rid)",
        f"rl{tag} AS (SELECT rid, y, shift + ln(denom) - zy AS loss FROM den{tag})",
    ]


# ---------------------------------------------------------------------------------------
# SVRG walks as recursive CTEs (logistic loss, shards = key % S)

def svrg_sql(*, avg: bool, shards: int, step: float, reg: float, iters: int, where: str | None = None,
             extra: list[str] | None = None, select: str | None = None, fraction: float = 1.0,
             mean_fraction: float = 1.0, order: str = "key", variant: str = "published", seed: int = 42) -> str:
    """Weights after ``iters`` outer iterations of SVRG (``avg=False``: gradient
    aggregating, then an L2 step) or of the weight-averaging variant on the FX1 rows matching
    ``where``; the final weight list is ``wl{iters}.w``, history rows are ``h1 .. h{iters}``.

    ``order="random"`` replays the draws: step ``k`` of a shard of ``n`` rows takes row
    ``floor(u * n)`` (``avg``: the rows sorted by ``u``) with ``u`` from md5 of
    iteration, shard, step and seed. Samples are never empty in the checks."""
    ctes = fixture_ctes("fx1", where)
    ctes.append("wl0 AS MATERIALIZED (SELECT list_transform(range(64), lambda k: 0.0::DOUBLE) AS w)")

    def u(i: int, shard: str, k: str) -> str:
        return md5_uniform(f"'{i}:' || CAST({shard} AS VARCHAR) || ':' || CAST({k} AS VARCHAR)", seed)

    for i in range(1, iters + 1):
        eta = step / math.sqrt(i)
        shrink, etal = lit(1.0 - eta * reg), lit(eta)
        W = f"(SELECT w FROM wl{i - 1})"
        ctes.append(f"q{i} AS MATERIALIZED (SELECT b.rid, b.key, b.y, b.x, CAST(b.key % {shards} AS INTEGER) AS shard, "
                    f"list_dot_product(b.x, {W}) AS z FROM base b)")
        ctes.append(f"p{i} AS MATERIALIZED (SELECT *, CAST(row_number() OVER (PARTITION BY shard ORDER BY key) AS INTEGER) - 1 "
                    f"AS place, 1.0 / (1.0 + exp(-z)) - y AS m0, {loss_sql('logistic')[0]} AS loss0 FROM q{i} "
                    f"WHERE {md5_sample('key', seed + i, fraction)})")
        if avg and order == "random":
            ctes.append(f"r{i} AS MATERIALIZED (SELECT *, CAST(row_number() OVER (PARTITION BY shard ORDER BY {u(i, 'shard', 'place')}, place) "
                        f"AS INTEGER) - 1 AS pos FROM p{i})")
        else:
            ctes.append(f"r{i} AS MATERIALIZED (SELECT *, place AS pos FROM p{i})")
        ctes.append(f"c{i} AS MATERIALIZED (SELECT shard, CAST(count(*) AS INTEGER) AS n FROM r{i} GROUP BY shard)")
        jj = "(SELECT unnest(range(64)) AS j) jj"
        if avg:
            ctes.append(f"e{i} AS MATERIALIZED (SELECT x, 1.0 / (1.0 + exp(-z)) - y AS m0 FROM q{i} WHERE {md5_sample('key', seed + i, mean_fraction)})")
            ctes.append(f"mu{i} AS MATERIALIZED (SELECT c{i}.shard, q.mu FROM c{i}, (SELECT list(g ORDER BY j) AS mu FROM "
                        f"(SELECT j, sum(m0 * x[j + 1]) / count(*) AS g FROM e{i}, {jj} GROUP BY j) q0) q)")
        else:
            ctes.append(f"mu{i} AS MATERIALIZED (SELECT shard, list(g ORDER BY j) AS mu FROM "
                        f"(SELECT shard, j, sum(m0 * x[j + 1]) / count(*) AS g FROM r{i}, {jj} GROUP BY shard, j) q GROUP BY shard)")
        pick = f"CAST(floor({u(i, 'wk.shard', 'wk.step')} * c.n) AS INTEGER)" if order == "random" and not avg else "wk.step"
        f_k = "(q.dm * q.x[k] + q.mu[k])"
        new_w = f"list_transform(range(1, 65), lambda k: {shrink} * q.w[k] - {etal} * {f_k})"
        new_s = f"list_transform(range(1, 65), lambda k: q.s[k] + {f_k})"
        ctes.append(
            f"walk{i}(shard, step, w, s, l) AS (SELECT shard, 0, {W}, "
            f"list_transform(range(64), lambda k: 0.0::DOUBLE), 0.0::DOUBLE FROM c{i} "
            f"UNION ALL SELECT q.shard, q.step + 1, {new_w}, {new_s}, q.l + {loss_sql('logistic', 'q.zn', 'q.y')[0]} FROM "
            f"(SELECT t.*, (1.0 / (1.0 + exp(-t.zn)) - t.y) - t.m0 AS dm FROM "
            f"(SELECT wk.shard, wk.step, wk.w, wk.s, wk.l, rr.x, rr.y, rr.m0, m.mu, list_dot_product(rr.x, wk.w) AS zn FROM walk{i} wk "
            f"JOIN c{i} c ON c.shard = wk.shard AND wk.step < c.n JOIN r{i} rr ON rr.shard = wk.shard AND rr.pos = {pick} "
            f"JOIN mu{i} m ON m.shard = wk.shard) t) q)")
        ctes.append(f"fin{i} AS MATERIALIZED (SELECT wk.shard, wk.w, wk.s, wk.l FROM walk{i} wk JOIN c{i} c "
                    f"ON wk.shard = c.shard AND wk.step = c.n)")
        if avg and variant == "observed":
            ctes.append(f"wl{i} AS MATERIALIZED (SELECT list(v ORDER BY j) AS w FROM (SELECT jj.j, (sum(w[jj.j + 1]) + ({shards} - count(*)) * "
                        f"any_value(({W})[jj.j + 1])) / {shards} AS v FROM fin{i}, {jj} GROUP BY jj.j) q)")
        elif avg:
            ctes.append(f"wl{i} AS MATERIALIZED (SELECT list(v ORDER BY j) AS w FROM (SELECT j, avg(w[j + 1]) AS v "
                        f"FROM fin{i}, {jj} GROUP BY j) q)")
        else:
            ctes.append(f"wl{i} AS MATERIALIZED (SELECT list(v ORDER BY j) AS w FROM (SELECT jj.j, "
                        f"{shrink} * any_value(({W})[jj.j + 1]) - {etal} * sum(s[jj.j + 1]) / (SELECT count(*) FROM r{i}) AS v "
                        f"FROM fin{i}, {jj} GROUP BY jj.j) q)")
        total = f"(SELECT sum(loss0) FROM r{i})" if avg else f"(SELECT sum(l) FROM fin{i})"
        rows = f"(SELECT count(*) FROM e{i})" if avg and variant == "observed" else f"(SELECT count(*) FROM r{i})"
        ctes.append(f"h{i} AS (SELECT {i} AS iter, {total} / {rows} AS loss, {lit(0.5 * reg)} * list_dot_product(w, w) AS reg, "
                    f"(SELECT count(*) FROM r{i}) AS batch_rows FROM wl{i - 1})")
    final = select or (f"SELECT CAST(j AS INTEGER) AS idx, round(w[j + 1], 6) + 0.0 AS weight "
                       f"FROM wl{iters}, (SELECT unnest(range(64)) AS j) jj")
    return "WITH RECURSIVE " + ",\n".join(ctes + (extra or [])) + "\n" + final
