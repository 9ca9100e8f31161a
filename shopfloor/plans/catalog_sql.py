"""SQL twins of the registered queries, for checking results in another engine."""

from __future__ import annotations

from shopfloor.functions import fixed, normal, text
from shopfloor.sources.scales import DEFAULT_SCALES, FACTORS


def _values(rows: list[tuple]) -> str:
    def literal(v: object) -> str:
        if isinstance(v, str):
            return "'" + v.replace("'", "''") + "'"
        return f"cast({v!r} as double)" if isinstance(v, float) else str(v)

    return ", ".join("(" + ", ".join(literal(v) for v in row) + ")" for row in rows)


# Inputs

SPC_VAR = """
select event_type as stream, cast(row_number() over (partition by event_type order by ts, event_id) - 1 as bigint) as seq,
       event_id as row_id, value from events"""


def _subgroups(size: int) -> str:
    return f"""
select stream, cast(floor(seq / {size}.0) as bigint) + 1 as subgroup, seq, value
from (select *, count(*) over (partition by stream) as n from spc_var) where seq < n - n % {size}"""


SPC_P = """
select stream, cast(dense_rank() over (partition by stream order by d) as bigint) as subgroup,
       cast(value as double) as value, cast(sample_size as double) as sample_size
from (select event_type as stream, cast(ts as date) as d, count(*) as value,
             sum(count(*)) over (partition by cast(ts as date)) as sample_size
      from events group by event_type, cast(ts as date))"""
SPC_U = """
select l_linestatus as stream, cast(year(l_shipdate) * 12 + month(l_shipdate) as bigint) as subgroup,
       cast(sum(case when l_returnflag = 'R' then 1 else 0 end) as double) as value,
       cast(count(*) as double) / cast(100 as double) as sample_size
from lineitem group by l_linestatus, year(l_shipdate) * 12 + month(l_shipdate)"""
SPC_LIMITS = """
select stream, cast(lsl as double) as lsl, cast(usl as double) as usl
from (values ('click', 0.0, 250.0), ('error', null, 200.0), ('purchase', 0.0, null), ('signup', null, null),
             ('view', 5.0, 95.0)) as t(stream, lsl, usl)"""
FLAT = """
select p_partkey + 1 as ID, p_type as Process_Step, concat('Unit ', cast(p_partkey % 5 as varchar)) as Component,
       concat('Provide ', p_type) as "Function", split_part(p_name, ' ', 1) as Failure_Mode,
       concat('Effect ', cast(p_size % 7 as varchar)) as Effect, cast(1 + p_size % 10 as int) as Severity,
       concat('Cause ', cast(p_size % 4 as varchar)) as Cause,
       cast(1 + (floor(p_partkey / 5.0) + p_size) % 10 as int) as Occurrence,
       concat('Control ', p_brand) as Current_Control,
       cast(1 + (floor(p_partkey / 50.0) + 3 * p_size) % 10 as int) as Detection
from part"""
ACTIONS = """
select ID as row_id, concat('Owner ', cast(ID % 3 as varchar)) as owner,
       case ID % 3 when 0 then 'Open' when 1 then 'In-Progress' else 'Closed' end as status,
       cast(null as int) as s_after, cast(case when ID % 8 = 0 then greatest(1, Occurrence - 2) end as int) as o_after,
       cast(greatest(1, Detection - 3) as int) as d_after
from flat"""
GAGE = """
select concat(l_returnflag, l_linestatus, '-', cast(cast(floor(l_orderkey / 2000.0) as bigint) as varchar)) as study_id,
       cast(l_partkey % 10 as varchar) as part, cast(l_suppkey % 3 as varchar) as appraiser,
       cast(l_linenumber % 3 + 1 as bigint) as trial,
       round(avg((l_partkey % 10) * 10.0 + (l_suppkey % 3) * 0.1
           + l_quantity * (case l_returnflag when 'A' then 0.02 when 'N' then 0.2 else 1.0 end)), 9) as measurement
from lineitem group by 1, 2, 3, 4"""
SIGNALS = """
select g.row_id, g.label, concat('sensor_', lpad(cast(s.n as varchar), 3, '0')) as signal,
       cast(case when s.n <= 7 then w.v when s.n = 8 then 5.0
                 when s.n = 9 then (case when g.row_id % 50 = 0 then 1.0 else 0.0 end)
                 when g.row_id < 60 then g.row_id * 1.0 end as double) as value
from (select o_orderkey as row_id, case when o_orderstatus = 'F' then 1 else -1 end as label from orders) g
cross join (values (1),(2),(3),(4),(5),(6),(7),(8),(9),(10)) as s(n)
left join (select l_orderkey as k, cast(l_linenumber as int) as n, max(l_extendedprice) as v
           from lineitem group by l_orderkey, l_linenumber) w on w.k = g.row_id and w.n = s.n"""
SENSOR_FILES = {
    "units": """
select o_orderkey, cast(row_number() over (order by o_orderkey) - 1 as bigint) as row_id,
       case when o_orderstatus = 'F' then 1 else -1 end as label, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') as timestamp
from orders""",
    "cells": """
select u.row_id, concat('sensor_00', cast(s.n - 1 as varchar)) as signal, w.v as value
from units u cross join (values (1),(2),(3),(4),(5),(6),(7)) as s(n)
left join (select l_orderkey as k, l_linenumber as n, max(l_extendedprice) as v from lineitem group by 1, 2) w
    on w.k = u.o_orderkey and w.n = s.n""",
}
AP_BANDS = "select * from (values " + _values(
    [
        (*row[:4], low, high, priority)
        for row in fixed.ACTION_PRIORITY
        for (low, high), priority in zip(fixed.DETECTION_BANDS, row[4:])
    ]
) + ") as t(s_lo, s_hi, o_lo, o_hi, d_lo, d_hi, ap)"


def with_(body: str, **ctes: str) -> str:
    return "with " + ", ".join(f"{name} as ({sql})" for name, sql in ctes.items()) + " " + body


def ap(s: str, o: str, d: str) -> str:
    return (
        f"(select b.ap from ap_bands b where {s} between b.s_lo and b.s_hi and {o} between b.o_lo and b.o_hi "
        f"and {d} between b.d_lo and b.d_hi)"
    )


AP_RANK = "case {0} when 'High' then 3 when 'Medium' then 2 when 'Low' then 1 end"

# Run rules


def flags(source: str, keys: str = "stream") -> str:
    """Rows of ``source`` (idx, point, center, sigma) with r1..r8."""
    side = {}
    for name, condition in {
        "a2": "c > 2 * sigma",
        "b2": "c < -2 * sigma",
        "a1": "c > sigma",
        "b1": "c < -sigma",
        "pos": "c > 0",
        "neg": "c < 0",
        "inn": "abs(c) < sigma",
        "outer": "abs(c) > sigma",
        "inc": "d > 0",
        "dec": "d < 0",
        "alt": "turn < 0",
    }.items():
        side[name] = f"case when {condition} then 1 else 0 end"

    def n(name: str, k: int) -> str:
        return f"sum({side[name]}) over (partition by {keys} order by idx rows between {k - 1} preceding and current row)"

    def one_sided(a: str, b: str, k: int, need: int) -> str:
        return (
            f"(idx >= {k - 1} and (({n(a, k)} >= {need} and {n(b, k)} = 0) or ({n(b, k)} >= {need} and {n(a, k)} = 0)))"
        )

    rules = [
        "abs(c) > 3 * sigma",
        one_sided("a2", "b2", 3, 2),
        one_sided("a1", "b1", 5, 4),
        f"({n('pos', 8)} = 8 or {n('neg', 8)} = 8)",
        f"({n('inc', 5)} = 5 or {n('dec', 5)} = 5)",
        f"{n('alt', 12)} = 12",
        f"{n('inn', 15)} = 15",
        f"({n('outer', 8)} = 8 and {n('pos', 8)} > 0 and {n('neg', 8)} > 0)",
    ]
    columns = ", ".join(f"coalesce(sigma > 0 and {r}, false) as r{i}" for i, r in enumerate(rules, 1))
    return f"""
select *, {columns} from (
  select *, sign(d) * sign(lag(d) over (partition by {keys} order by idx)) as turn from (
    select *, point - center as c, point - lag(point) over (partition by {keys} order by idx) as d from {source}))"""


def fired(columns: str, count: int = 8, source: str = "flagged") -> str:
    return " union all ".join(
        f"select {columns}, {i} as rule_no, '{fixed.RULE_NAMES[i - 1]}' as rule from {source} where r{i}"
        for i in range(1, count + 1)
    )


def numbers(count: int = 8) -> str:
    return "concat_ws('; ', " + ", ".join(f"case when r{i} then '{i}' end" for i in range(1, count + 1)) + ")"


def names(count: int = 8) -> str:
    return (
        "concat_ws('; ', "
        + ", ".join(f"case when r{i} then '{fixed.RULE_NAMES[i - 1]}' end" for i in range(1, count + 1))
        + ")"
    )


def events_count(count: int = 8) -> str:
    return " + ".join(f"cast(r{i} as int)" for i in range(1, count + 1))


def any_rule(count: int = 8) -> str:
    return "(" + " or ".join(f"r{i}" for i in range(1, count + 1)) + ")"


def rules_seen(keys: str = "stream", count: int = 8, source: str = "flagged") -> str:
    """Per group: sorted rule names as text, violating points and events."""
    seen = sorted((name, i) for i, name in enumerate(fixed.RULE_NAMES[:count], 1))
    listed = ", ".join(f"case when bool_or(r{i}) then '{name}' end" for name, i in seen)
    return f"""
select {keys}, concat_ws('; ', {listed}) as rules, concat_ws(', ', {listed}) as rules_comma,
       cast(count(case when {any_rule(count)} then 1 end) as bigint) as violating_points,
       cast(sum({events_count(count)}) as bigint) as violation_events
from {source} group by {keys}"""


# Charts

IMR = {
    "spc_var": SPC_VAR,
    "mr": "select *, abs(value - lag(value) over (partition by stream order by seq)) as mr from spc_var",
    "lim": """
select stream, count(value) as n_points, avg(value) as center, avg(mr) as mrbar, avg(value) + 2.660 * avg(mr) as ucl,
       avg(value) - 2.660 * avg(mr) as lcl, avg(mr) / 1.128 as sigma from mr group by stream""",
    "pts": """
select m.stream, m.seq as idx, m.row_id, m.value as point, m.mr, l.center, l.sigma, l.ucl, l.lcl
from mr m join lim l on m.stream = l.stream""",
    "flagged": flags("pts"),
}
IMR_STATUS = "case when n_points < 2 then 'too_few_points' when mrbar <= 0 then 'zero_sigma' else 'ok' end"
IMR_LIMITS = f"""
select stream, n_points, round(center, 6) as center, round(mrbar, 6) as mrbar, round(ucl, 6) as ucl, round(lcl, 6) as lcl,
       round(3.267 * mrbar, 6) as ucl_mr, cast(0 as double) as lcl_mr, round(sigma, 6) as sigma_hat,
       round(sigma, 6) as sigma_zone, {IMR_STATUS} as status from lim"""


def xbar(kind: str, size: int) -> dict[str, str]:
    spread, rows = ("rng", fixed.XBAR_R) if kind == "r" else ("sd", fixed.XBAR_S)
    return {
        "spc_var": SPC_VAR,
        "raw": _subgroups(size),
        "sub": """
select stream, subgroup, avg(value) as point, max(value) - min(value) as rng, stddev_samp(value) as sd, count(value) as n
from raw group by stream, subgroup""",
        "k": f"select * from (values {_values(rows)}) as t(k_n, k_mean, k_low, k_high, k_sigma)",
        "lim": f"""
select a.stream, n_points, n, center, spread, center + k_mean * spread as ucl, center - k_mean * spread as lcl,
       k_high * spread as ucl_spread, greatest(0.0, k_low * spread) as lcl_spread, spread / k_sigma as sigma_hat,
       spread / k_sigma / sqrt(cast(n as double)) as sigma
from (select stream, count(*) as n_points, min(n) as n, avg(point) as center, avg({spread}) as spread
      from sub group by stream) a join k on a.n = k.k_n""",
        "pts": """
select s.stream, s.subgroup - 1 as idx, s.subgroup, s.point, s.rng, s.sd, s.n, l.center, l.sigma, l.ucl, l.lcl
from sub s join lim l on s.stream = l.stream""",
        "flagged": flags("pts"),
    }


def xbar_limits(name: str) -> str:
    return f"""
select stream, n_points, n, round(center, 6) as center, round(spread, 6) as {name}, round(ucl, 6) as ucl,
       round(lcl, 6) as lcl, round(ucl_spread, 6) as ucl_spread, round(lcl_spread, 6) as lcl_spread,
       round(sigma_hat, 6) as sigma_hat, round(sigma, 6) as sigma_zone, 'ok' as status from lim"""


XBAR_POINTS = f"""
select stream, idx, subgroup, round(point, 6) as point, round(rng, 6) as rng, round(sd, 6) as sd, n,
       round(center, 6) as center, round(ucl, 6) as ucl, round(lcl, 6) as lcl, {numbers()} as rules from flagged"""


def attribute(kind: str) -> dict[str, str]:
    view = SPC_U if kind == "u" else SPC_P
    if kind == "c":
        lim = "select stream, count(*) as n_points, avg(value) as center, sqrt(avg(value)) as sigma from raw group by stream"
        point, reach = "value", "3 * l.sigma"
    else:
        variance = "center * (1 - center)" if kind == "p" else "center"
        lim = f"""
select stream, n_points, avg_n, center, sqrt({variance} / avg_n) as sigma from (
  select stream, count(*) as n_points, avg(sample_size) as avg_n, sum(value) / sum(sample_size) as center
  from raw group by stream)"""
        point = "value / sample_size"
        reach = "3 * sqrt(l.center * (1 - l.center) / sample_size)" if kind == "p" else "3 * sqrt(l.center / sample_size)"
    upper = f"least(1.0, l.center + {reach})" if kind == "p" else f"l.center + {reach}"
    return {
        "raw": view,
        "lim": lim,
        "pts": f"""
select r.stream, cast(row_number() over (partition by r.stream order by subgroup) - 1 as bigint) as idx, {point} as point,
       sample_size as size, l.center, l.sigma, {upper} as ucl, greatest(0.0, l.center - {reach}) as lcl
from raw r join lim l on r.stream = l.stream""",
        "flagged": flags("pts"),
    }


def attribute_points(kind: str) -> str:
    size = "" if kind == "c" else "round(size, 6) as size, "
    return f"""
select stream, idx, round(point, 6) as point, {size}round(center, 6) as center, round(ucl, 6) as ucl,
       round(lcl, 6) as lcl, {numbers()} as rules from flagged"""


ZERO = "case when sigma <= 0 then 'zero_sigma' else 'ok' end"


def attribute_limits(kind: str) -> str:
    if kind == "c":
        return f"""
select stream, n_points, round(center, 6) as center, round(sigma, 6) as sigma_zone, {ZERO} as status,
       round(center + 3 * sigma, 6) as ucl, round(greatest(0.0, center - 3 * sigma), 6) as lcl from lim"""
    return f"""
select stream, n_points, round(avg_n, 6) as avg_n, round(center, 6) as center, round(sigma, 6) as sigma_zone,
       {ZERO} as status from lim"""


def summary(keys: str, count: int = 8) -> str:
    return f"""
select l.{keys}, n_points, violating_points, violation_events, rules, {IMR_STATUS} as status
from lim l join seen s on l.{keys} = s.{keys}"""


def metric_rows(chart: str, source: str, triples: list[tuple[str, str]]) -> str:
    return " union all ".join(
        f"select stream, {i} as ord, '{label}' as label, {value} as value, '{chart}' as chart from {source}"
        for i, (label, value) in enumerate(triples, 1)
    )


def f4(column: str, digits: int = 4) -> str:
    return f"printf('%.{digits}f', {column})"


def spc() -> dict[str, str]:
    point_report = f"""
select stream, idx + 1 as "Point", round(point, 6) as "Value", round(ucl, 6) as "UCL", round(lcl, 6) as "LCL",
       case when {any_rule(4)} then {names(4)} else 'OK' end as "Status" from flagged"""
    xr, p, u = xbar("r", 5), attribute("p"), attribute("u")
    metrics = with_(
        metric_rows("I-MR", "lim", [("Xbar", f4("center")), ("MRbar", f4("mrbar")), ("Sigma Hat", f4("sigma"))])
        + " union all "
        + metric_rows("Xbar-R", "xlim", [("Xbarbar", f4("center")), ("Rbar", f4("spread")), ("Sigma Hat", f4("sigma_hat"))])
        + " union all "
        + metric_rows("p", "plim", [("pbar", f4("center")), ("Avg N", f4("avg_n", 1)), ("Points", "cast(n_points as varchar)")]),
        spc_var=SPC_VAR,
        mr=IMR["mr"],
        lim=IMR["lim"],
        raw=xr["raw"],
        sub=xr["sub"],
        k=xr["k"],
        xlim=xr["lim"],
        praw=p["raw"],
        plim=p["lim"].replace("from raw", "from praw"),
    )
    pairs = [
        ("Chart Type", "'u Chart'"),
        ("Process Stream", "l.stream"),
        ("Rule Set", "'Nelson'"),
        ("Center Line (CL)", f4("center")),
        ("UCL", "'varies (per subgroup)'"),
        ("LCL", "'varies (per subgroup)'"),
        ("Data Points", "cast(n_points as varchar)"),
        ("Rule Violations", "cast(violation_events as varchar)"),
        ("ubar", f4("center")),
        ("Avg N", f4("avg_n", 2)),
        ("Points", "cast(n_points as varchar)"),
    ]
    report = " union all ".join(
        f"select l.stream, {i} as ord, '{label}' as label, {value} as value, cast(null as bigint) as point "
        "from lim l join seen s on l.stream = s.stream"
        for i, (label, value) in enumerate(pairs, 1)
    )
    report += (
        " union all select stream, 100 + rule_no, concat('Violation @ Point ', cast(idx + 1 as varchar)), rule, idx + 1 from ("
        + fired("stream, idx")
        + ")"
    )
    capability = {
        **IMR,
        "spec": SPC_LIMITS,
        "o": """
select stream, count(value) as n, avg(value) as mean, stddev_samp(value) as sigma_overall, min(value) as min_value,
       max(value) as max_value from spc_var group by stream""",
        "cap": """
select o.*, l.sigma as sigma_hat, s.lsl, s.usl, (usl - lsl) / (6 * l.sigma) as cp,
       least((usl - mean) / (3 * l.sigma), (mean - lsl) / (3 * l.sigma)) as cpk, (usl - lsl) / (6 * sigma_overall) as pp,
       least((usl - mean) / (3 * sigma_overall), (mean - lsl) / (3 * sigma_overall)) as ppk
from o join lim l on o.stream = l.stream left join spec s on o.stream = s.stream""",
        "seen": rules_seen(count=4),
        "gated": """
select c.*, violation_events as signals,
       case when violation_events = 0 then 'In statistical control'
            else concat(cast(violation_events as varchar), ' WE signal(s) — Cpk indicative only') end as stability,
       case when cpk is null then 'N/A' when cpk >= 1.33 then 'Capable' when cpk >= 1.0 then 'Marginal'
            else 'Not capable' end as cpk_rating
from cap c join seen s on c.stream = s.stream""",
    }
    rounded = ", ".join(
        f"round({c}, 6) as {c}"
        for c in ("mean", "sigma_hat", "sigma_overall", "min_value", "max_value", "lsl", "usl", "cp", "cpk", "pp", "ppk")
    )

    def opt(column: str) -> str:
        return f"coalesce({f4(column)}, 'N/A')"

    detail = [
        ("Process Stream", "g.stream"),
        ("Data Points", "cast(g.n as varchar)"),
        ("LSL", opt("lsl")),
        ("USL", opt("usl")),
        ("Cp", opt("cp")),
        ("Cpk", opt("cpk")),
        ("Pp", opt("pp")),
        ("Ppk", opt("ppk")),
        ("Cpk Rating", "cpk_rating"),
        ("Mean", f4("mean")),
        ("Sigma Hat (within)", f4("sigma_hat")),
        ("Sigma Overall", f4("sigma_overall")),
        ("Normality (Shapiro-Wilk p)", f4("p_value")),
        ("Approximately Normal?", "case when p_value > 0.05 then 'Yes' else 'No' end"),
        ("Stability", "stability"),
    ]
    capability_report = " union all ".join(
        f"select g.stream, {i} as ord, '{label}' as label, {value} as value from gated g join sw on g.stream = sw.stream"
        for i, (label, value) in enumerate(detail, 1)
    )
    histogram = """
select g.stream, g.bin, round(lo + g.bin * width, 6) as bin_from, round(lo + (g.bin + 1) * width, 6) as bin_to,
       coalesce(n_values, 0) as n_values, round(coalesce(n_values, 0) / (n * width), 6) as density
from (select *, unnest(range(cast(bins as int))) as bin from st) g left join cnt c on g.stream = c.stream and g.bin = c.bin"""
    xs = xbar("s", 12)
    return {
        "spc_imr_limits": with_(IMR_LIMITS, **IMR),
        "spc_rules_we": with_(fired("stream, idx, row_id", 4), **IMR),
        "spc_rules_nelson": with_(fired("stream, idx, row_id"), **IMR),
        "spc_violation_summary": with_(summary("stream"), **IMR, seen=rules_seen()),
        "spc_xbar_r": with_(xbar_limits("rbar"), **xr),
        "spc_xbar_r_points": with_(XBAR_POINTS, **xr),
        "spc_xbar_s": with_(xbar_limits("sbar"), **xs),
        "spc_xbar_s_points": with_(XBAR_POINTS, **xs),
        "spc_p": with_(attribute_points("p"), **p),
        "spc_p_limits": with_(attribute_limits("p"), **p),
        "spc_c": with_(attribute_points("c"), **attribute("c")),
        "spc_c_limits": with_(attribute_limits("c"), **attribute("c")),
        "spc_u": with_(attribute_points("u"), **u),
        "spc_u_limits": with_(attribute_limits("u"), **u),
        "spc_chart_points": with_(
            f"""select stream, idx, row_id, round(point, 6) as point, round(mr, 6) as mr, round(center, 6) as center,
                round(ucl, 6) as ucl, round(lcl, 6) as lcl, {numbers()} as rules from flagged""",
            **IMR,
        ),
        "spc_report_points": with_(point_report, **IMR),
        "spc_metrics": metrics,
        "spc_report_summary": with_(report, **u, seen=rules_seen()),
        "spc_default_limits": with_(
            """select stream, round(first(value - 100.0 order by seq) filter (seq % 7 = 3), 6) as lsl,
               round(first(value + 200.0 order by seq) filter (seq % 11 = 5 and stream <> 'view'), 6) as usl
               from spc_var group by stream""",
            spc_var=SPC_VAR,
        ),
        "spc_capability": with_(f"select stream, n, {rounded}, 'ok' as status from cap", **capability),
        "spc_capability_gated": with_(
            "select stream, round(cpk, 6) as cpk, signals, signals = 0 as stable, stability, cpk_rating from gated",
            **capability,
        ),
        "spc_normality": with_(
            """select stream, n, round(w_stat, 6) as w_stat, round(p_value, 6) as p_value, p_value > 0.05 as is_normal,
               case when n > 5000 then 'beyond_validated_n' else 'ok' end as status from sw""",
            spc_var=SPC_VAR,
            **shapiro("spc_var"),
        ),
        "spc_capability_report": with_(capability_report, **capability, **shapiro("spc_var")),
        "spc_histogram": with_(
            histogram,
            st="""select *, (hi - lo) / bins as width from (
                  select event_type as stream, count(value) as n, min(value) as lo, max(value) as hi,
                         least(20, greatest(8, floor(count(value) / 2.0))) as bins from events group by event_type)""",
            cnt="""select stream, cast(least(floor((value - lo) / width), bins - 1) as int) as bin, count(*) as n_values
                   from events e join st on e.event_type = st.stream group by 1, 2""",
        ),
        "spc_normal_curve": with_(
            """select stream, i, round(x, 6) as x,
                      round(1.0 / (s * sqrt(2.0 * pi())) * exp(-0.5 * ((x - m) / s) * ((x - m) / s)), 6) as density
               from (select *, lo - 3 * s + i * (((hi + 3 * s) - (lo - 3 * s)) / 399.0) as x
                     from (select *, unnest(range(400)) as i from st))""",
            st="""select event_type as stream, min(value) as lo, max(value) as hi, avg(value) as m, stddev_samp(value) as s
                  from events group by event_type""",
        ),
    }


# Shapiro-Wilk


def qnorm(p: str) -> str:
    q = f"({p} - 0.5)"
    r = f"(cast(0.180625 as double) - {q} * {q})"
    t = f"(sqrt(-ln(least({p}, 1.0 - {p}))) - cast(1.6 as double))"
    centre = f"{q} * {dpoly(normal.QUANTILE_CENTRE_TOP, r)} / {dpoly(normal.QUANTILE_CENTRE_BOTTOM, r)}"
    tail = f"{dpoly(normal.QUANTILE_TAIL_TOP, t)} / {dpoly(normal.QUANTILE_TAIL_BOTTOM, t)}"
    return f"(case when abs({q}) <= 0.425 then {centre} when {q} < 0 then -({tail}) else {tail} end)"


def dpoly(coefficients: list[float], x: str) -> str:
    out = f"cast({coefficients[-1]!r} as double)"
    for c in reversed(coefficients[:-1]):
        out = f"({out} * {x} + cast({c!r} as double))"
    return out


def shapiro(source: str) -> dict[str, str]:
    return {
        "sw_r": f"""
select stream, value as x, cast(row_number() over (partition by stream order by value, row_id) as double) as i,
       cast(count(*) over (partition by stream) as double) as n from {source}""",
        "sw_p": "select *, (i - 0.375) / (n + 0.25) as pr from sw_r",
        "sw_m": f"select *, {qnorm('pr')} as m from sw_p",
        "sw_s": """
select stream, max(n) as n, sum(m * m) as mm, sum(m * x) as mx, var_samp(x) * (max(n) - 1) as ss,
       max(case when i = 1 then x end) as x1, max(case when i = 2 then x end) as x2,
       max(case when i = n - 1 then x end) as y2, max(case when i = n then x end) as y1,
       max(case when i = 1 then m end) as m1, max(case when i = 2 then m end) as m2 from sw_m group by stream""",
        "sw_a": f"""
select *, {dpoly(normal.WEIGHT_LAST, '(1.0 / sqrt(n))')} - m1 / sqrt(mm) as a1,
       {dpoly(normal.WEIGHT_NEXT, '(1.0 / sqrt(n))')} - m2 / sqrt(mm) as a2 from sw_s""",
        "sw_w": """
select *, pow(a1 * (y1 - x1) + a2 * (y2 - x2) + (mx + m1 * (y1 - x1) + m2 * (y2 - x2))
       / sqrt((mm - 2 * m1 * m1 - 2 * m2 * m2) / (1 - 2 * a1 * a1 - 2 * a2 * a2)), 2) / ss as w_stat from sw_a""",
        "sw_z": f"""
select *, (ln(1 - w_stat) - {dpoly(normal.LARGE_MEAN, 'ln(n)')}) / exp({dpoly(normal.LARGE_LOG_SD, 'ln(n)')}) as z from sw_w""",
        "sw": f"""
select stream, cast(n as bigint) as n, w_stat, {tail('z')} as p_value from sw_z""",
    }


def tail(z: str) -> str:
    """Upper normal tail by a trapezoid sum over 4000 steps: an independent check of the fitted form."""
    area = f"list_sum(list_transform(range(4000), lambda k: exp(-0.5 * pow(abs({z}) + (k + 0.5) * 0.0025, 2)))) * 0.0025 / sqrt(2 * pi())"
    return f"(case when {z} < 0 then 1 - {area} else {area} end)"


# Risk

SCORED = {
    "ap_bands": AP_BANDS,
    "flat": FLAT,
    "base": "select *, cast(Severity * Occurrence * Detection as bigint) as RPN from flat",
    "scored": f"""
select b.*, RPN > 100 as Flag_High_RPN, Severity >= 9 as Flag_High_Severity,
       RPN >= 200 or Severity >= 9 as Flag_Action_Priority_H,
       case when RPN > 100 or Severity >= 9 then 'Red' when RPN >= 50 then 'Yellow' else 'Green' end as Risk_Tier,
       {ap('Severity', 'Occurrence', 'Detection')} as AP from base b""",
}
RPN_ORDER = "RPN desc, Severity desc, Occurrence desc, ID"
COUNTERS = {
    "total": "count(*)",
    "red": "count_if(Risk_Tier = 'Red')",
    "yellow": "count_if(Risk_Tier = 'Yellow')",
    "green": "count_if(Risk_Tier = 'Green')",
    "high_rpn": "count_if(Flag_High_RPN)",
    "high_severity": "count_if(Flag_High_Severity)",
    "action_priority_h": "count_if(Flag_Action_Priority_H)",
    "ap_high": "count_if(AP = 'High')",
    "ap_medium": "count_if(AP = 'Medium')",
    "ap_low": "count_if(AP = 'Low')",
}
CRITICAL = """
select Failure_Mode, Process_Step, Component, Cause, Severity, Occurrence, Detection, RPN, AP, Risk_Tier, Current_Control
from scored where """


def risk() -> dict[str, str]:
    counters = ", ".join(f"cast({value} as bigint) as {name}" for name, value in COUNTERS.items())
    ap_order = f"{AP_RANK.format('AP')} desc, RPN desc, Severity desc, ID"
    shares = ", ".join(
        [f"round(100.0 * count_if(Risk_Tier = '{t}') / count(*), 6) as pct_{t.lower()}" for t in ("Red", "Yellow", "Green")]
        + [f"round(100.0 * count_if(AP = '{a}') / count(*), 6) as pct_ap_{a.lower()}" for a in ("High", "Medium", "Low")]
    )
    scores = [(c, s, w) for c in ("Severity", "Occurrence", "Detection") for s, w in ((10, "maximum"), (1, "minimum"))]
    health = [
        f"select {i} as ord, count_if({c} = {s}) as n, ' row(s) have {c} = {s} ({w} score)' as t from flat"
        for i, (c, s, w) in enumerate(scores)
    ]
    health += [
        f"select {i}, count_if(length({c}) > 120), ' row(s) have long ''{c}'' text (>120 chars — may truncate in PDF)' from flat"
        for i, c in enumerate(("Failure_Mode", "Effect", "Cause"), 6)
    ]
    flag_text = """
concat_ws(', ', case when Flag_High_RPN then 'High RPN' end, case when Flag_High_Severity then 'Sev>=9' end,
          case when Flag_Action_Priority_H then 'AP-H' end)"""
    ranked = f"select cast(row_number() over (order by {RPN_ORDER}) as bigint) as rank, * from scored"
    return {
        "risk_score": with_(
            """select ID, RPN, Flag_High_RPN, Flag_High_Severity, Flag_Action_Priority_H, Risk_Tier, 'ok' as score_status
               from scored""",
            **SCORED,
        ),
        "risk_ap": with_(
            """select ID, Severity, Occurrence, Detection, AP,
                      case AP when 'High' then 'Red' when 'Medium' then 'Yellow' else 'Green' end as AP_Tier from scored""",
            **SCORED,
        ),
        "risk_rank_rpn": with_("select rank, ID, RPN, Risk_Tier, AP from ranked", **SCORED, ranked=ranked),
        "risk_rank_ap": with_(
            f"select cast(row_number() over (order by {ap_order}) as bigint) as rank, ID, RPN, Risk_Tier, AP from scored",
            **SCORED,
        ),
        "risk_rank_per_step": with_(
            f"""select Process_Step, cast(row_number() over (partition by Process_Step order by {RPN_ORDER}) as bigint) as rank,
                ID, RPN from scored""",
            **SCORED,
        ),
        "risk_counters": with_(f"select {counters} from scored", **SCORED),
        "risk_counters_per_step": with_(f"select Process_Step, {counters} from scored group by Process_Step", **SCORED),
        "risk_distribution": with_(
            f"""select count(*) as total, {shares}, round(avg(RPN), 6) as avg_rpn, max(RPN) as max_rpn,
                cast(sum(RPN) as bigint) as total_rpn from scored""",
            **SCORED,
        ),
        "risk_insight": with_(
            """select count(*) as total, cast(least(3, count(*)) as bigint) as top_n,
                      round(100.0 * sum(RPN) filter (rank <= 3) / sum(RPN), 6) as top_pct,
                      max(Failure_Mode) filter (rank = 1) as top_failure_mode,
                      max(Process_Step) filter (rank = 1) as top_process_step, max(RPN) as highest_rpn,
                      cast(count_if(Risk_Tier = 'Red') as bigint) as red,
                      cast(count_if(Flag_High_Severity) as bigint) as high_severity
               from ranked""",
            **SCORED,
            ranked=ranked,
        ),
        "risk_health": with_(
            "select ord, cast(n as bigint) as n_rows, concat(cast(n as varchar), t) as warning from h where n > 0",
            flat=FLAT,
            h=" union all ".join(health),
        ),
        "risk_heatmap": with_(
            """select cast(s as int) as Severity, cast(o as int) as Occurrence, coalesce(n, 0) as n_rows,
                      case w when 3 then 'Red' when 2 then 'Yellow' when 1 then 'Green' end as worst_tier
               from range(1, 11) a(s) cross join range(1, 11) b(o) left join (
                 select Severity, Occurrence, count(*) as n,
                        max(case Risk_Tier when 'Red' then 3 when 'Yellow' then 2 else 1 end) as w
                 from scored group by Severity, Occurrence) c on c.Severity = s and c.Occurrence = o""",
            **SCORED,
        ),
        "risk_pareto": with_(
            """select rank, ID, substr(Failure_Mode, 1, 40) as label, RPN, Risk_Tier,
                      round(100.0 * sum(RPN) over (order by rank) / sum(RPN) over (), 6) as cumulative_pct from ranked""",
            **SCORED,
            ranked=ranked,
        ),
        "risk_topn_others": with_(
            """select cast(rank as int) as rank, substr(Failure_Mode, 1, 40) as Failure_Mode, RPN, Risk_Tier
               from ranked where rank <= 30
               union all select 31, concat('Others (N=', cast(count(*) as varchar), ')'), cast(sum(RPN) as bigint), 'Green'
               from ranked where rank > 30 having count(*) > 0""",
            **SCORED,
            ranked=ranked,
        ),
        "risk_filter": with_(
            """select ID, Process_Step, RPN, Severity from scored where RPN >= 100 and Severity >= 9
               and Process_Step in ('ECONOMY', 'SMALL', 'PROMO')""",
            **SCORED,
        ),
        "risk_process_steps": with_("select distinct Process_Step from flat", flat=FLAT),
        "risk_critical": with_(CRITICAL + "AP = 'High'", **SCORED),
        "risk_critical_h": with_(CRITICAL + "Flag_Action_Priority_H", **SCORED),
        "risk_flags_text": with_(f"select ID, coalesce(nullif({flag_text}, ''), '-') as Flags from scored", **SCORED),
    }


# Ingest

NUMBER = r"regexp_matches(trim({0}), '(?i)^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?$|^[+-]?(inf|infinity|nan)$')"


def num(raw: str) -> str:
    return f"case when {NUMBER.format(raw)} then try_cast(trim({raw}) as double) end"


def field(i: int, name: str, cases: list[tuple[str, str]], text_like: bool = False) -> str:
    """Error rows of one column; cases see ``v`` (null when missing) and ``x`` (its number)."""
    column = f'"{name}"'
    missing = f"nullif({column}, '')" if text_like else f"case when trim({column}) <> '' then {column} end"
    whens = " ".join("when {} then '{}'".format(cond, msg.replace("'", "''")) for cond, msg in cases)
    return f"""
select row_no, {i} as ord, '{name}' as "column", v as value, case {whens} end as msg
from (select row_no, v, {num('v')} as x from (select row_no, {missing} as v from raw))"""


def messages() -> str:
    shown = """case when value is null then 'None' when try_cast(value as double) is not null then value
                    else concat(chr(39), value, chr(39)) end"""
    cut = f"case when length({shown}) > 50 then concat(substr({shown}, 1, 47), '...') else {shown} end"
    return f"""
select row_no, ord, "column", value, msg,
       case when "column" is null then concat('Row ', cast(row_no as varchar), ': ', msg, '.')
            else concat('Row ', cast(row_no as varchar), ', column ', chr(39), "column", chr(39), ': ', msg, ' (got ', {cut}, ').')
       end as message
from cells where msg is not null"""


def repeats(name: str, msg: str, value: str, keys: str, where: str = "true") -> str:
    return f"""
select row_no, 1000 as ord, cast(null as varchar) as "column", {value} as value, '{msg}' as msg,
       concat('{name} dataset is invalid: {msg}: [', {value}, '].') as message
from (select *, row_number() over (partition by {keys} order by row_no) as nth from keyed where {where}) where nth > 1"""


def text_cases(blank: str, longest: int) -> list[tuple[str, str]]:
    return [
        ("v is null", "Input should be a valid string"),
        ("trim(v) = ''", blank),
        (f"length(trim(v)) > {longest}", f"String should have at most {longest} characters"),
    ]


STRICT = [("v is null or not regexp_matches(trim(v), '^[+-]?[0-9]+$')", "Input should be a valid integer")]
SCALE = "out of range. Valid range is 1–10 (AIAG FMEA-4 scale)"
LAX_INT = [
    ("v is null", "Input should be a valid integer"),
    ("x is null", "Input should be a valid integer, unable to parse string as an integer"),
    ("isinf(x) or isnan(x)", "Input should be a finite number"),
    ("x <> floor(x)", "Input should be a valid integer, got a number with a fractional part"),
    ("x < 1", "Input should be greater than or equal to 1"),
]
LAX_FLOAT = [
    ("v is null", "Input should be a valid number"),
    ("x is null", "Input should be a valid number, unable to parse string as a number"),
    ("isinf(x) or isnan(x)", "Input should be a finite number"),
]
OPTIONAL_FLOAT = [
    ("v is not null and x is null", "Input should be a valid number, unable to parse string as a number"),
    ("isinf(x) or isnan(x)", "Input should be a finite number"),
]
SANITIZED = r"""
select ID, case when regexp_matches(note, '^[=+\-@\t\r]') or regexp_matches(note, '^\s+[=+\-@]') then concat(chr(39), note)
                else note end as note, Severity
from (select ID, Severity, concat(case ID % 11 when 0 then '=' when 1 then '+' when 2 then '-' when 3 then '@'
        when 4 then chr(9) when 5 then chr(13) when 6 then ' =' when 7 then '  -' when 8 then concat(chr(39), '=')
        when 9 then ' x' else '' end, Cause) as note from flat)"""


def ingest() -> dict[str, str]:
    strict_text = text_cases("Value error, field must not be blank or whitespace-only", 2000)
    rating = [*STRICT, ("x < 1 or x > 10", SCALE)]
    columns = [
        ("ID", [*STRICT, ("x <= 0", "Input should be greater than 0")]),
        ("Process_Step", strict_text),
        ("Component", strict_text),
        ("Function", strict_text),
        ("Failure_Mode", strict_text),
        ("Effect", strict_text),
        ("Severity", rating),
        ("Cause", strict_text),
        ("Occurrence", rating),
        ("Current_Control", strict_text),
        ("Detection", rating),
    ]
    fmea_raw = """
select ID + 1 as row_no,
       case ID % 97 when 8 then cast(ID - 1 as varchar) when 9 then '0' else cast(ID as varchar) end as ID,
       Process_Step, Component, "Function", case ID % 97 when 6 then '   ' else Failure_Mode end as Failure_Mode,
       case ID % 97 when 10 then repeat('x', 2001) else Effect end as Effect,
       case ID % 97 when 1 then '' when 2 then 'abc' when 5 then 'inf' else cast(Severity as varchar) end as Severity,
       case ID % 97 when 7 then '' else Cause end as Cause,
       case ID % 97 when 3 then '5.0' else cast(Occurrence as varchar) end as Occurrence, Current_Control,
       case ID % 97 when 4 then '11' else cast(Detection as varchar) end as Detection from flat"""
    fmea_cells = " union all ".join(
        field(i, c, cases, text_like=cases is strict_text) for i, (c, cases) in enumerate(columns)
    )
    spc_raw = """
select row_id + 2 as row_no, case row_id % 97 when 1 then '   ' when 2 then '' else stream end as stream,
       case row_id % 97 when 3 then 'abc' when 4 then '5.0' when 5 then '0' when 6 then '2.5'
            else cast(seq + 1 as varchar) end as subgroup,
       case row_id % 97 when 7 then 'abc' when 8 then 'inf' when 9 then '' else '1.5' end as value from spc_var"""
    spc_cells = " union all ".join(
        [
            field(0, "stream", text_cases("Value error, stream must not be blank or whitespace-only", 200), text_like=True),
            field(1, "subgroup", LAX_INT),
            field(2, "value", LAX_FLOAT),
        ]
    )
    gage_raw = """
select n + 2 as row_no, case n % 97 when 1 then '' else concat_ws('-', study_id, part) end as part,
       case n % 97 when 2 then '  ' else appraiser end as appraiser,
       case when n % 97 = 3 then '0' when n % 97 = 4 then 'abc' when n % 97 >= 90 then '1' else cast(trial as varchar) end as trial,
       case n % 97 when 5 then 'inf' when 6 then 'abc' else '2.5' end as measurement
from (select *, cast(row_number() over (order by study_id, part, appraiser, trial) - 1 as bigint) as n from gage)"""
    blank = "Value error, must not be blank or whitespace-only"
    gage_cells = " union all ".join(
        [
            field(0, "part", text_cases(blank, 200), text_like=True),
            field(1, "appraiser", text_cases(blank, 200), text_like=True),
            field(2, "trial", LAX_INT),
            field(3, "measurement", LAX_FLOAT),
        ]
    )
    gage_keyed = f"""
select row_no, trim(nullif(part, '')) as part, trim(nullif(appraiser, '')) as appraiser,
       try_cast({num('trial')} as int) as trial from raw"""
    plan_raw = """
select p_partkey + 2 as row_no,
       case p_partkey % 97 when 1 then ' ' when 2 then concat('Char ', cast(p_partkey - 1 as varchar))
            else concat('Char ', cast(p_partkey as varchar)) end as characteristic,
       case p_partkey % 97 when 3 then 'abc' when 4 then '9' when 14 then '' else '1' end as lsl,
       case p_partkey % 97 when 5 then 'inf' when 15 then '' else '8' end as usl,
       case p_partkey % 97 when 6 then '12' when 7 then '4' else '' end as target,
       case p_partkey % 97 when 8 then repeat('m', 201) else 'Gauge' end as measurement_method,
       case p_partkey % 97 when 9 then '0' when 10 then '3.5' else '5' end as sample_size,
       case p_partkey % 97 when 11 then '' else 'per shift' end as frequency,
       case p_partkey % 97 when 12 then 'EWMA' when 13 then 'Xbar-R' else '' end as recommended_chart,
       'Contain' as reaction_plan, case p_partkey % 97 when 16 then '  ' else 'F1::F1-M1::F1-M1-C1' end as source_cause_id
from part"""
    charts = "Input should be 'Xbar-R', 'Xbar-S', 'I-MR', 'p', 'c' or 'u'"
    plan_cells = " union all ".join(
        [
            field(0, "characteristic", text_cases(blank, 200), text_like=True),
            field(1, "lsl", OPTIONAL_FLOAT),
            field(2, "usl", OPTIONAL_FLOAT),
            field(3, "target", OPTIONAL_FLOAT),
            field(4, "measurement_method", text_cases(blank, 200), text_like=True),
            field(5, "sample_size", LAX_INT),
            field(6, "frequency", text_cases(blank, 200), text_like=True),
            field(7, "recommended_chart", [("v not in ('Xbar-R', 'Xbar-S', 'I-MR', 'p', 'c', 'u')", charts)]),
            field(8, "reaction_plan", text_cases(blank, 2000), text_like=True),
        ]
    )
    plan_rules = """
select row_no, case when usl <= lsl then 10 else 11 end as ord, cast(null as varchar) as "column", cast(null as varchar) as value,
       case when usl <= lsl then 'usl must be greater than lsl'
            when target < lsl or target > usl then 'target must be within [lsl, usl]' end as msg
from (select row_no, try_cast(nullif(lsl, '') as double) as lsl, try_cast(nullif(usl, '') as double) as usl,
             try_cast(nullif(target, '') as double) as target from raw)
where row_no not in (select row_no from fields where msg is not null) and lsl is not null and usl is not null"""
    return {
        "ingest_errors_risk": with_(
            messages()
            + " union all "
            + repeats("FMEA", "duplicate IDs found", "cast(ID as varchar)", "ID"),
            flat=FLAT,
            raw=fmea_raw,
            cells=fmea_cells,
            keyed="select row_no, cast(ID as bigint) as ID from raw",
        ),
        "ingest_errors_spc": with_(
            messages(), spc_var=SPC_VAR, raw=spc_raw, cells=spc_cells
        ),
        "ingest_errors_gage": with_(
            messages()
            + " union all "
            + repeats(
                "Gage R&R",
                "duplicate (part, appraiser, trial) rows found",
                "concat('(', concat_ws(', ', part, appraiser, cast(trial as varchar)), ')')",
                "part, appraiser, trial",
                "part is not null and appraiser is not null and trial is not null",
            ),
            gage=GAGE,
            raw=gage_raw,
            cells=gage_cells,
            keyed=gage_keyed,
        ),
        "ingest_errors_plan": with_(
            messages()
            + " union all "
            + repeats("Control Plan", "duplicate characteristic rows found", "characteristic", "characteristic"),
            raw=plan_raw,
            fields=plan_cells,
            cells=f"select * from fields union all {plan_rules}",
            keyed="select row_no, trim(characteristic) as characteristic from raw where characteristic <> ''",
        ),
        "ingest_duplicates": """
select row_no, cast(ID as varchar) as value, 'duplicate IDs found' as msg from (
  select *, row_number() over (partition by ID order by row_no) as nth from (
    select l_orderkey as ID, cast(row_number() over (order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
           l_quantity, l_shipdate, l_tax, l_discount, l_returnflag, l_linestatus) - 1 as bigint) as row_no from lineitem))
where nth > 1""",
        "export_sanitized": with_(SANITIZED, flat=FLAT),
        "export_risk_report": with_(
            """select ID, Process_Step, Component, Failure_Mode, Effect, Severity, Occurrence, Detection, RPN, AP, Risk_Tier,
                      Flag_High_RPN, Flag_High_Severity, Flag_Action_Priority_H, Action_Owner, Action_Status,
                      cast(null as date) as Action_Due, S_After, O_After, D_After, RPN_Revised, AP_Revised, RPN_Delta
               from tracked""",
            **TRACKED,
        ),
    }


# Actions

TRACKED = {
    **SCORED,
    "actions": ACTIONS,
    "revised": """
select s.*, a.owner as Action_Owner, a.status as Action_Status, a.s_after as S_After, a.o_after as O_After,
       a.d_after as D_After, coalesce(a.s_after, Severity) as s2, coalesce(a.o_after, Occurrence) as o2,
       coalesce(a.d_after, Detection) as d2 from scored s left join actions a on s.ID = a.row_id""",
    "tracked": f"""
select r.*, case when Action_Owner is not null then cast(s2 * o2 * d2 as bigint) end as RPN_Revised,
       case when Action_Owner is not null then {ap('s2', 'o2', 'd2')} end as AP_Revised,
       case when Action_Owner is not null then cast(s2 * o2 * d2 as bigint) - RPN end as RPN_Delta from revised r""",
}


def actions() -> dict[str, str]:
    labels = f"select * from (values {_values(DEFAULT_SCALES)}) as t(factor, score, meaning)"
    joins = " ".join(
        f"left join scales s{i} on s{i}.factor = '{f}' and s{i}.score = f.{f.capitalize()}" for i, f in enumerate(FACTORS)
    )
    meanings = ", ".join(f"s{i}.meaning as {f.capitalize()}_Meaning" for i, f in enumerate(FACTORS))
    checks = [
        (
            "status",
            "status",
            "status not in ('Open', 'In-Progress', 'Closed')",
            "concat(chr(39), status, chr(39), ' is not a valid status')",
        ),
        ("due", "due", "due = 'soon'", "'Input should be a valid date'"),
        ("s_after", "cast(s_after as varchar)", "s_after > 10", "'Input should be less than or equal to 10'"),
        ("d_after", "cast(d_after as varchar)", "d_after < 1", "'Input should be greater than or equal to 1'"),
    ]
    errors = " union all ".join(
        f"""select row_id, '{c}' as "column", {value} as value,
            concat('Row ID ', cast(row_id as varchar), ', ', chr(39), '{c}', chr(39), ': ', {msg}) as message
            from edited where owner <> ' ' and {cond}"""
        for c, value, cond, msg in checks
    )
    return {
        "action_effectiveness": with_(
            f"""select ID, Action_Owner, Action_Status, S_After, O_After, D_After, RPN, AP, RPN_Revised, AP_Revised, RPN_Delta,
                {AP_RANK.format('AP_Revised')} < {AP_RANK.format('AP')} as AP_Reduced
                from tracked where Action_Owner is not null""",
            **TRACKED,
        ),
        "action_tracked_rows": with_(
            f"""select cast(row_number() over (order by {RPN_ORDER}) as bigint) as rank, ID, RPN, AP, Action_Owner, Action_Status,
                O_After, D_After, RPN_Revised, AP_Revised, RPN_Delta from tracked""",
            **TRACKED,
        ),
        "action_rollup": with_(
            """select count(*) as n_actions, cast(sum(RPN_Delta) as bigint) as total_rpn_delta
               from tracked where Action_Owner is not null""",
            **TRACKED,
        ),
        "action_attach": with_(
            """select row_id, case when row_id % 12 = 0 and row_id % 24 <> 0 then 'Reassigned' else owner end as owner,
                      case when row_id % 12 = 0 and row_id % 24 <> 0 then 'Closed' else status end as status, o_after, d_after
               from actions""",
            flat=FLAT,
            actions=ACTIONS,
        ),
        "action_errors": with_(
            errors,
            flat=FLAT,
            actions=ACTIONS,
            edited="""select row_id, case when row_id % 40 = 0 then ' ' else owner end as owner,
                             case when row_id % 28 = 0 then 'Done' else status end as status,
                             case when row_id % 36 = 0 then 'soon' else '2026-03-01' end as due,
                             case when row_id % 44 = 0 then 11 end as s_after,
                             case when row_id % 52 = 0 then 0 else d_after end as d_after from actions""",
        ),
        "rating_scale_labels": with_(
            f"select f.ID, f.Severity, f.Occurrence, f.Detection, {meanings} from flat f {joins}", flat=FLAT, scales=labels
        ),
    }


# Relational model and control plan

MODEL = {
    "flat": FLAT,
    "fn": """
select *, concat('F', cast(row_number() over (order by ord) as varchar)) as function_id
from (select Process_Step, Component, "Function", min(ID) as ord from flat group by 1, 2, 3)""",
    "fm": """
select *, concat(function_id, '-M', cast(row_number() over (partition by function_id order by ord) as varchar)) as failure_mode_id
from (select fn.function_id, fn.Component, fn.ord as f_ord, Failure_Mode, min(ID) as ord, fn.Process_Step, fn."Function"
      from flat join fn on flat.Process_Step = fn.Process_Step and flat.Component = fn.Component
       and flat."Function" = fn."Function" group by all)""",
    "lr": """
select flat.*, fm.function_id, fm.failure_mode_id from flat join fm on flat.Process_Step = fm.Process_Step
and flat.Component = fm.Component and flat."Function" = fm."Function" and flat.Failure_Mode = fm.Failure_Mode""",
}
for _name, _text, _rating, _letter in (
    ("ef", "Effect", "Severity", "E"),
    ("ca", "Cause", "Occurrence", "C"),
    ("co", "Current_Control", "Detection", "CT"),
):
    MODEL[_name] = f"""
select *, concat(failure_mode_id, '-{_letter}', cast(row_number() over (partition by function_id, failure_mode_id order by ord)
       as varchar)) as id
from (select function_id, failure_mode_id, {_text} as description, {_rating} as rating, min(ID) as ord from lr group by 1, 2, 3, 4)"""
MODEL["ln"] = """
select lr.*, ef.id as effect_id, ca.id as cause_id, co.id as control_id from lr
join ef on lr.failure_mode_id = ef.failure_mode_id and lr.Effect = ef.description and lr.Severity = ef.rating
join ca on lr.failure_mode_id = ca.failure_mode_id and lr.Cause = ca.description and lr.Occurrence = ca.rating
join co on lr.failure_mode_id = co.failure_mode_id and lr.Current_Control = co.description and lr.Detection = co.rating"""
PLAN = {
    **MODEL,
    "ap_bands": AP_BANDS,
    "risked": f"""
select *, Severity * Occurrence * Detection as RPN, {ap('Severity', 'Occurrence', 'Detection')} as AP from ln""",
    "worst": f"""
select * from (select *, row_number() over (partition by function_id, failure_mode_id
  order by {AP_RANK.format('AP')} desc, RPN desc, ID desc) as nth from risked) where nth = 1""",
    "n1": """
select *, concat(Component, ' — ', Failure_Mode) as base,
       row_number() over (partition by concat(Component, ' — ', Failure_Mode) order by f_ord, ord) as use_no from fm""",
    "n2": """
select *, case when use_no = 1 then base else concat(base, ' (', failure_mode_id, ')') end as characteristic from n1""",
    "named": """
select n.characteristic, n.Component as comp, w.*, concat_ws('::', w.function_id, w.failure_mode_id, w.cause_id) as source_id
from n2 n join worst w on n.failure_mode_id = w.failure_mode_id""",
    "plan": f"""
select cast(row_number() over (order by {AP_RANK.format('AP')} desc, RPN desc, characteristic desc) as bigint) as plan_order,
       characteristic, cast(null as double) as lsl, cast(null as double) as usl, cast(null as double) as target,
       Current_Control as measurement_method, 1 as sample_size, 'per shift' as frequency,
       cast(null as varchar) as recommended_chart,
       concat('Contain and investigate; failure effect: ', Effect, '.') as reaction_plan, source_id as source_cause_id,
       AP, cast(RPN as bigint) as RPN, 'ok' as plan_status from named""",
    "idx": """
select characteristic, failure_mode_id, source_id as cause_id, Cause as cause_description, Occurrence as occurrence,
       comp as component from named""",
}
CAPA = """
concat('Characteristic ', chr(39), characteristic, chr(39), ' went out of statistical control (',
       cast(violating_points as varchar), ' point(s), ', rules_comma, '). Source cause ', chr(39),
       coalesce(cause_description, 'an unlinked cause (no Control Plan source found)'), chr(39),
       ' is currently rated Occurrence ', coalesce(cast(occurrence as varchar), 'unknown'),
       '; the observed out-of-control rate maps to a candidate Occurrence ', cast(suggested as varchar),
       ' (AIAG-4 / SAE J1739 occurrence rate table). Review the occurrence rating / open a CAPA — this is a candidate, ',
       'not an applied change.')"""


def banded(rate: str) -> str:
    whens = " ".join(f"when {rate} <= cast(1 as double) / {one_in} then {rank}" for rank, one_in in fixed.OCCURRENCE_ONE_IN)
    return f"case {whens} else 10 end"


def feedback_sql(rule_set: str) -> str:
    return f"""
select characteristic, stream, '{rule_set}' as rule_set, true as ooc, violating_points, rules, round(rate, 6) as ooc_rate,
       failure_mode_id as source_failure_mode_id, cause_id as source_cause_id, cause_description as source_cause_description,
       occurrence as current_occurrence, cast(suggested as int) as suggested_occurrence, component, {CAPA} as capa_prompt
from (select b.characteristic, b.stream, violating_points, rules, rules_comma,
             cast(violating_points as double) / n_points as rate,
             {banded('cast(violating_points as double) / n_points')} as suggested,
             failure_mode_id, cause_id, cause_description, occurrence, component
      from binding b join seen s on b.stream = s.stream join lim l on b.stream = l.stream
      left join idx i on b.characteristic = i.characteristic where violating_points > 0)"""


def model() -> dict[str, str]:
    entities = " union all ".join(
        f"select function_id, failure_mode_id, '{kind}' as kind, id, description, rating from {cte}"
        for kind, cte in (("effects", "ef"), ("causes", "ca"), ("controls", "co"))
    )
    broken = {
        **MODEL,
        "l1": """
select function_id, failure_mode_id, ID as row_id, effect_id, control_id,
       case when ID % 29 = 5 then concat(cause_id, 'x') else cause_id end as cause_id from ln where ID % 13 <> 0""",
        "l2": "select * from l1 union all select * from l1 where row_id % 31 = 7",
        "ent": entities,
        "uses": " union all ".join(
            f"select function_id, failure_mode_id, '{kind}s' as kind, {kind}_id as id, row_id from l2"
            for kind in ("effect", "cause", "control")
        ),
    }
    scope = "concat_ws('::', {0}.function_id, {0}.failure_mode_id) as scope"
    errors = f"""
select 'model' as scope, cast(row_id as varchar) as item, 'duplicate row ID' as message from l2 group by row_id having count(*) > 1
union all select function_id, failure_mode_id, 'failure mode without links' from fm
where failure_mode_id not in (select failure_mode_id from l2)
union all select {scope.format('u')}, u.id, concat('link row ', cast(min(u.row_id) as varchar), ': unknown ', u.kind[:-2], ' ID')
from uses u where not exists (select 1 from ent e where e.kind = u.kind and e.id = u.id)
group by u.function_id, u.failure_mode_id, u.id, u.kind
union all select {scope.format('e')}, e.id, concat('unreferenced ', e.kind[:-2], ' ID') from ent e
where not exists (select 1 from uses u where e.kind = u.kind and e.id = u.id)"""
    charts = with_(
        """select part_id, data_type, subgroup_size, defect_based, constant_sample,
                  case when subgroup_size < 1 then null
                       when data_type = 'variable' then case when subgroup_size = 1 then 'I-MR'
                            when subgroup_size <= 9 then 'Xbar-R' else 'Xbar-S' end
                       when not defect_based then 'p' when constant_sample then 'c' else 'u' end as chart from t""",
        t="""select p_partkey as part_id, case when p_partkey % 3 = 0 then 'attribute' else 'variable' end as data_type,
                    p_size % 14 as subgroup_size, p_partkey % 2 = 0 as defect_based, p_size % 2 = 0 as constant_sample from part""",
    )
    config = """
select concat('Char ', cast(cast(floor(p_partkey / 2.0) as bigint) as varchar)) as characteristic,
       case p_partkey % 10 when 0 then null when 2 then 'Xbar-R' when 4 then null else 'I-MR' end as chart_key,
       case when p_partkey % 10 <> 6 then cast(p_size as double) end as lsl,
       case when p_partkey % 10 <> 8 then p_size + cast(10 as double) end as usl, cast(null as double) as target,
       p_size as sample_size, case p_partkey % 10 when 2 then null else 'per shift' end as frequency
from part where p_partkey % 2 = 0"""
    plan_columns = """characteristic, lsl, usl, target, measurement_method, sample_size, frequency, recommended_chart,
                      reaction_plan, source_cause_id"""
    loop = {
        **PLAN,
        **IMR,
        "seen": rules_seen(count=4),
        "binding": """
select characteristic, stream from plan join (
  select stream, row_number() over (order by stream) as n from (select distinct stream from spc_var)) on plan_order = n""",
    }
    return {
        "rel_functions": with_(
            """select function_id, ord, Process_Step as process_step, Component as component, "Function" as description from fn""",
            **MODEL,
        ),
        "rel_failure_modes": with_("select function_id, failure_mode_id, ord, Failure_Mode as description from fm", **MODEL),
        "rel_entities": with_(entities, **MODEL),
        "rel_links": with_("select function_id, failure_mode_id, ID as row_id, effect_id, cause_id, control_id from ln", **MODEL),
        "rel_roundtrip": with_("select * from flat", flat=FLAT),
        "rel_errors": with_(errors, **broken),
        "plan_build": with_("select * from plan", **PLAN),
        "plan_export": with_(f"select {plan_columns} from plan", **PLAN),
        "plan_source_index": with_("select * from idx", **PLAN),
        "plan_recommend": charts,
        "plan_config": config,
        "feedback": with_(
            feedback_sql("Nelson"),
            **PLAN,
            **IMR,
            seen=rules_seen(),
            binding="select distinct concat('Char ', event_type) as characteristic, event_type as stream from events",
        ),
        "loop_end_to_end": with_(feedback_sql("Western Electric"), **loop),
        "spc_occurrence_rank": f"""
select customer, incidents, opportunities, cast({banded('rate')} as int) as occurrence_rank
from (select o_custkey as customer, cast(count_if(o_orderpriority = '1-URGENT') as bigint) as incidents,
             count(*) as opportunities,
             cast(count_if(o_orderpriority = '1-URGENT') as double) / count(*) as rate from orders group by o_custkey)""",
    }


# Gage studies


def gage_ctes(tolerance: float | None = None) -> dict[str, str]:
    tol = f"cast({tolerance!r} as double)" if tolerance else "cast(null as double)"
    return {
        "g": GAGE,
        "cell": "select study_id, part, appraiser, max(measurement) - min(measurement) as rng, count(*) as n from g group by 1, 2, 3",
        "app": "select study_id, max(m) - min(m) as xd, count(*) as k from (select study_id, appraiser, avg(measurement) as m from g group by 1, 2) group by 1",
        "par": "select study_id, max(m) - min(m) as rp, count(*) as p from (select study_id, part, avg(measurement) as m from g group by 1, 2) group by 1",
        "st": """
select c.study_id, avg(rng) as rbar, min(n) as r, count(*) as cells, max(n) as r2 from cell c group by 1""",
        "mean": "select study_id, avg(measurement) as mean, count(*) as nm from g group by 1",
        "v1": f"""
select st.*, app.xd, app.k, par.rp, par.p, mean.mean, mean.nm, {tol} as tol,
       rbar * (case r when 2 then 0.8862 when 3 then 0.5908 end) as ev,
       xd * (case k when 2 then 0.7071 when 3 then 0.5231 end) as reach,
       rp * (select k3 from (values {_values(fixed.GAGE_K3)}) as t(n, k3) where t.n = p) as pv
from st join app on st.study_id = app.study_id join par on st.study_id = par.study_id join mean on st.study_id = mean.study_id""",
        "v2": "select *, sqrt(greatest(reach * reach - ev * ev / (p * r), 0)) as av from v1",
        "v3": "select *, sqrt(ev * ev + av * av) as grr, sqrt(ev * ev + av * av + pv * pv) as tv from v2",
        "v4": """
select *, 100 * grr / tv as ps, 100 * grr / tol as pt, cast(least(100, floor(1.41 * pv / grr)) as bigint) as ndc from v3""",
        "v": """
select *, case when ndc < 2 then 'Reject' when ndc >= 5 and greatest(ps, coalesce(pt, ps)) < 10 then 'Accept'
               when greatest(ps, coalesce(pt, ps)) > 30 then 'Reject' else 'Marginal' end as verdict from v4""",
    }


GAGE_ROW = """
select study_id, p as n_parts, k as n_appraisers, r as n_trials, cast(nm as bigint) as n_measurements,
       cast(p * k - cells as bigint) as missing_cells, round(mean, 6) as mean, round(ev, 6) as ev, round(av, 6) as av,
       round(grr, 6) as grr, round(pv, 6) as pv, round(tv, 6) as tv, round(ps, 6) as pgrr_study,
       round(pt, 6) as pgrr_tolerance, ndc, verdict, r = r2 as is_balanced, 'ok' as status from v"""
SENTENCE = "case verdict " + " ".join(f"when '{v}' then '{s}'" for v, s in text.VERDICT_SENTENCES) + " end"


def gage() -> dict[str, str]:
    checks = {
        "g": """
select concat_ws('-', l_returnflag, l_linestatus, cast(l_suppkey % 7 as varchar)) as study_id,
       cast(l_partkey % (l_suppkey % 7 + 1) as varchar) as part, cast(l_orderkey % (l_suppkey % 4 + 1) as varchar) as appraiser
from lineitem""",
        "cell": "select study_id, part, appraiser, count(*) as n from g group by 1, 2, 3",
        "s": """
select study_id, count(distinct part) as n_parts, count(distinct appraiser) as n_appraisers, min(n) as n_trials,
       max(n) as most, count(*) as cells, cast(sum(n) as bigint) as n_measurements from cell group by 1""",
    }
    pairs = [
        ("EV (Repeatability)", f4("ev", 6)),
        ("AV (Reproducibility)", f4("av", 6)),
        ("GR&R", f4("grr", 6)),
        ("PV (Part Variation)", f4("pv", 6)),
        ("TV (Total Variation)", f4("tv", 6)),
        ("%GRR (Study)", f"concat({f4('ps', 2)}, '%')"),
        ("%GRR (Tolerance)", f"concat({f4('pt', 2)}, '%')"),
        ("ndc", "cast(ndc as varchar)"),
        ("Verdict", "verdict"),
        ("Verdict Interpretation", SENTENCE),
        ("Parts", "cast(p as varchar)"),
        ("Appraisers", "cast(k as varchar)"),
        ("Trials", "cast(r as varchar)"),
        ("USL", "'60.000000'"),
        ("LSL", "'0.000000'"),
        ("Mean", f4("mean", 6)),
    ]
    report = " union all ".join(
        f"select study_id, {i} as ord, '{label}' as label, {value} as value from v" for i, (label, value) in enumerate(pairs, 1)
    )
    return {
        "gage_rr": with_(GAGE_ROW, **gage_ctes()),
        "gage_rr_tolerance": with_(GAGE_ROW, **gage_ctes(60.0)),
        "gage_checks": with_(
            """select study_id, n_parts, n_appraisers, n_trials, n_measurements,
                      cast(n_parts * n_appraisers - cells as bigint) as missing_cells, n_trials = most as is_balanced,
                      case when n_parts < 2 then 'too_few_parts' when n_appraisers < 2 then 'too_few_appraisers'
                           when n_trials < 2 then 'too_few_trials' when n_trials <> most then 'unbalanced'
                           when n_trials > 3 or n_appraisers > 3 or n_parts > 10 then 'off_table' else 'ok' end as status from s""",
            **checks,
        ),
        "gage_report": with_(report, **gage_ctes(60.0)),
        "gage_results_export": with_(
            f"""select study_id, {f4('ev', 6)} as "EV", {f4('av', 6)} as "AV", {f4('grr', 6)} as "GRR", {f4('pv', 6)} as "PV",
                {f4('tv', 6)} as "TV", concat({f4('ps', 2)}, '%') as "%GRR Study", 'N/A' as "%GRR Tolerance", ndc,
                verdict as "Verdict", {SENTENCE} as "Verdict Interpretation" from v""",
            **gage_ctes(),
        ),
        "gage_study_export": with_("select study_id, part, appraiser, trial, round(measurement, 6) as measurement from g", g=GAGE),
        "gage_applicable": """
select source, missing = '' as applicable, missing as missing_dimensions, n_rows,
       concat('A gage study needs every appraiser to measure every part at least twice. ',
              case when missing = '' then 'The columns for that are there.'
                   else concat('Columns not found: ', replace(missing, '; ', ', '), '.') end) as reason
from (select 'readings' as source, '' as missing, (select count(*) from (select 1 from lineitem group by
          l_returnflag, l_linestatus, floor(l_orderkey / 2000.0), l_partkey % 10, l_suppkey % 3, l_linenumber % 3)) as n_rows
      union all select 'order lines', 'part; appraiser; trial', (select count(*) from lineitem)
      union all select 'events', 'part; appraiser; trial', (select count(*) from events))""",
        "gage_tolerance_problem": """
select part_id, lsl, usl, case when usl <= lsl then 'USL must be greater than LSL — tolerance ignored until corrected.' end as problem
from (select p_partkey as part_id, case when p_partkey % 5 <> 0 then cast(p_size as double) end as lsl,
             case when p_partkey % 7 <> 0 then cast(25 as double) end as usl from part)""",
    }


# Sensors

SENSORS = {
    "sig": SIGNALS,
    "vc": "select signal, value, count(*) as c from sig where value is not null group by 1, 2",
    "vr": "select *, row_number() over (partition by signal order by c desc, value) as nth from vc",
    "fr": """
select signal, count(*) as nd, cast(max(case when nth = 1 then c end) as double) / max(case when nth = 2 then c end) as ratio
from vr group by signal""",
    "au": """
select s.signal, count(s.value) as n_present, (count(*) - count(s.value)) / cast(count(*) as double) as missing_frac,
       coalesce(max(nd), 0) as n_distinct, coalesce(var_samp(s.value), 0) as variance,
       coalesce(max(ratio), cast('inf' as double)) as freq_ratio,
       case when count(s.value) = 0 then 0 else max(nd) / cast(count(s.value) as double) end as percent_unique
from sig s left join fr on s.signal = fr.signal group by s.signal""",
    "audit": """
select *, case when n_present < 100 then 'too_missing' when variance = 0 then 'constant'
               when freq_ratio >= 19 and percent_unique <= 0.1 then 'near_zero_variance' else 'ok' end as reason from au""",
}


def charted(wanted: str) -> dict[str, str]:
    return {
        **SENSORS,
        "smr": f"""
select *, abs(value - lag(value) over (partition by signal order by row_id)) as mr from sig where signal in ({wanted})""",
        "lim": """
select signal, count(value) as n_points, avg(value) as center, coalesce(avg(mr), 0) as mrbar,
       avg(value) + 2.660 * coalesce(avg(mr), 0) as ucl, avg(value) - 2.660 * coalesce(avg(mr), 0) as lcl,
       coalesce(avg(mr), 0) / 1.128 as sigma from smr group by signal""",
        "pts": """
select m.signal, cast(row_number() over (partition by m.signal order by m.row_id) - 1 as bigint) as idx, m.row_id, m.label,
       m.value as point, l.center, l.sigma from smr m join lim l on m.signal = l.signal where m.value is not null""",
        "flagged": flags("pts", "signal"),
    }


def sensors() -> dict[str, str]:
    kept = charted("select signal from audit where reason = 'ok'")
    limited = charted("select distinct signal from sig")
    warning = """
case when ev > 0 then concat('Process is not in statistical control — ', cast(ev as varchar),
     ' nelson signal(s) detected on the control chart. Capability indices (Cp/Cpk/Pp/Ppk) are not a valid capability claim ',
     'until the process is stabilized; treat these values as indicative only.') end"""
    labels = "select o_orderpriority as priority, case when o_orderstatus = 'F' then 1 else -1 end as label from orders"
    yields = """
count(*) as n_total, cast(count_if(label = -1) as bigint) as n_pass, cast(count_if(label = 1) as bigint) as n_fail,
round(count_if(label = -1) / cast(count(*) as double), 6) as yield_fraction,
round(100 * (count_if(label = -1) / cast(count(*) as double)), 6) as yield_pct,
round(count_if(label = 1) / cast(count(*) as double) * 1000000, 6) as dppm, 'ok' as status"""
    return {
        "signals_missingness": with_(
            """select signal, count(value) as n_present, count(*) - count(value) as n_missing,
                      round((count(*) - count(value)) / cast(count(*) as double), 6) as missing_frac from sig group by signal""",
            sig=SIGNALS,
        ),
        "signals_audit": with_(
            """select signal, n_present, round(missing_frac, 6) as missing_frac, cast(n_distinct as bigint) as n_distinct,
                      round(variance, 2) as variance, round(freq_ratio, 6) as freq_ratio,
                      round(percent_unique, 6) as percent_unique,
                      case when reason = 'ok' then 'keep' else 'drop' end as status, reason from audit""",
            **SENSORS,
        ),
        "signals_imr": with_(IMR_LIMITS.replace("select stream", "select signal"), **kept),
        "signals_autocorr": with_(
            """select signal, count(*) as n_used, round(sum(c * b) / sum(c * c), 6) as lag1_autocorr,
                      abs(sum(c * b) / sum(c * c)) > 1.96 / sqrt(count(*)) as autocorr_flag
               from (select signal, point - center as c, lag(point) over (partition by signal order by idx) - center as b from pts)
               group by signal""",
            **kept,
        ),
        "signals_violations": with_(fired("signal, idx, row_id"), **kept),
        "signals_runs": with_(
            """select signal, cast(run - 1 as bigint) as run, count(*) as n_values, min(row_id) as first_row from (
                 select *, sum(start) over (partition by signal order by row_id) as run from (
                   select *, case when value is not null and lag(value) over (partition by signal order by row_id) is null
                                  then 1 else 0 end as start from sig))
               where value is not null group by 1, 2""",
            sig=SIGNALS,
        ),
        "signals_capability": with_(
            f"""select signal, n, round(mean, 6) as mean, round(sigma, 6) as sigma_hat, round(so, 6) as sigma_overall,
                case when status = 'ok' then round((usl - lsl) / (6 * sigma), 6) end as cp,
                case when status = 'ok' then round(least((usl - mean) / (3 * sigma), (mean - lsl) / (3 * sigma)), 6) end as cpk,
                case when status = 'ok' then round((usl - lsl) / (6 * so), 6) end as pp,
                case when status = 'ok' then round(least((usl - mean) / (3 * so), (mean - lsl) / (3 * so)), 6) end as ppk,
                ev as signals, ev = 0 as stable, {warning} as stability_warning, status
                from (select s.signal, o.n, o.mean, l.sigma, o.so, s.lsl, s.usl, violation_events as ev,
                             case when lsl is null and usl is null then 'no_limits' when lsl >= usl then 'bad_limits' else 'ok' end as status
                      from spec s join lim l on s.signal = l.signal join seen e on s.signal = e.signal
                      join (select signal, count(value) as n, avg(value) as mean, stddev_samp(value) as so from sig group by 1) o
                        on o.signal = s.signal)""",
            **limited,
            seen=rules_seen("signal"),
            spec="""select signal, cast(lsl as double) as lsl, cast(usl as double) as usl from (values
                    ('sensor_001', 1000.0, 90000.0), ('sensor_002', null, 95000.0), ('sensor_003', 2000.0, null),
                    ('sensor_004', null, null), ('sensor_005', 9.0, 1.0)) as t(signal, lsl, usl)""",
        ),
        "sensor_matrix_file": with_("select row_id, signal, value from cells", **SENSOR_FILES),
        "sensor_labels_file": with_("select row_id, label, timestamp from units", **SENSOR_FILES),
        "sensor_labelled_files": with_(
            "select c.row_id, signal, value, label, timestamp from cells c join units u on c.row_id = u.row_id", **SENSOR_FILES
        ),
        "yield_summary": with_(f"select {yields} from labelled", labelled=labels),
        "yield_by_priority": with_(f"select priority, {yields} from labelled group by priority", labelled=labels),
        "signals_pareto": with_(
            """select signal, n as n_fail_violations, round(100.0 * n / sum(n) over (), 6) as pct,
                      round(100.0 * sum(n) over (order by n desc, signal rows unbounded preceding) / sum(n) over (), 6) as cumulative_pct
               from (select signal, count(*) as n from hits group by signal)""",
            **kept,
            hits=f"select * from ({fired('signal, label')}) where label = 1",
        ),
    }


# Live monitor


def live(size: int) -> dict[str, str]:
    window = f"""
select *, seq - first as place from (
  select *, greatest(0, (n - n % {size}) - {50 * size}) as first, n - n % {size} as whole
  from (select *, count(*) over (partition by stream) as n from spc_var)) where seq >= first and seq < whole"""
    if size == 1:
        return {
            "spc_var": SPC_VAR,
            "win": window,
            "mr": "select *, abs(value - lag(value) over (partition by stream order by place)) as mr from win",
            "lim": IMR["lim"],
            "pts": "select m.stream, place as idx, value as point, center, sigma from mr m join lim l on m.stream = l.stream",
            "flagged": flags("pts"),
            "seen": rules_seen(),
        }
    made = xbar("r", size)
    return {
        "spc_var": SPC_VAR,
        "win": window,
        "raw": f"select stream, cast(floor(place / {size}.0) as bigint) + 1 as subgroup, value from win",
        **{k: v for k, v in made.items() if k not in ("spc_var", "raw")},
        "seen": rules_seen(count=4),
    }


def live_row(sigma: str) -> str:
    return f"""
select l.stream, n_points, round(center, 6) as center, round({sigma}, 6) as sigma_hat, round(ucl, 6) as ucl, round(lcl, 6) as lcl,
       violation_events from lim l join seen s on l.stream = s.stream"""


def _by_domain() -> dict[str, str]:
    return {
        **spc(),
        **risk(),
        **ingest(),
        **actions(),
        **model(),
        **gage(),
        **sensors(),
        "live_snapshot_xbar_r": with_(live_row("sigma_hat"), **live(5)),
        "live_snapshot_imr": with_(live_row("sigma"), **live(1)),
    }


CHARTED = "ts < (select max(ts) from events where value is not null) - interval '2 days'"


def all_sql() -> dict[str, str]:
    made = _by_domain()
    flat_columns = "ID, Process_Step, Component, Function, Failure_Mode, Effect, Severity, Cause, Occurrence, Current_Control, Detection"
    return {
        **made,
        # What goes through a file or a stream comes out as it went in.
        "file_roundtrip": with_(f"select {flat_columns} from flat", flat=FLAT),
        "risk_meanings_from_file": made["rating_scale_labels"],
        "plan_export_checked": made["plan_export"],
        "live_monitor_xbar_r": made["live_snapshot_xbar_r"],
        # What lies two days or more before the last event is charted by then.
        "live_monitor_event_time": "select *, cast(0 as bigint) as late_rows from ("
        + made["live_snapshot_xbar_r"].replace("value from events", f"value from events where {CHARTED}")
        + ")",
    }
