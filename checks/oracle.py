"""The same results in DuckDB SQL over the same files, one text per job."""

from __future__ import annotations

import math

_COUNTRY = "case when nation < 9 then 'CA' when nation < 15 then 'MX' else 'US' end"
_PLAYER = """concat(case when o_totalprice >= 495000 then 'Guest####' else 'Customer#' end,
       lpad(cast(o_custkey as varchar), 9, '0'))"""
_DAY = "cast(cast(o_orderdate as date) + interval 216 month as date)"
_POINTS = "cast(floor(o_totalprice / 100) as int) - 2500"

_VIEWS = {
    "accounts": """
        select c_name as userid, c_acctbal as balance, c_nationkey as nation from customer
        union all select s_name, s_acctbal, s_nationkey from supplier""",
    "users": f"""
        select userid, cast(balance >= 8000 as int) as subscriber, {_COUNTRY} as country
        from accounts""",
    "event_performance": f"""
        select {_PLAYER} as userid, {_DAY} as event_date,
               cast(16 + o_orderkey % 5 as int) as hour, {_POINTS} as points
        from orders""",
    "users_staging": f"""
        select userid,
               case when balance between 0 and 50 then '2'
                    else cast(cast(balance >= 8000 as int) as varchar) end as subscriber,
               case when balance < -950 then null when balance between 50 and 100 then 'USA'
                    else {_COUNTRY} end as country
        from (select *, unnest(range(case when balance >= 9900 then 2 else 1 end)) as copy
              from accounts)""",
    "event_performance_staging": f"""
        select case fault when 1 then concat(player, ' ') when 2 then concat(player, '"')
                    when 9 then null else player end as userid,
               case fault when 3 then '19/24/2019' when 6 then '3/22/99' when 7 then '8/2/39'
                    when 8 then concat(month(day), '/', day(day), '/', year(day))
                    when 10 then null
                    else concat(month(day), '/', day(day), '/',
                                right(cast(year(day) as varchar), 2)) end as event_date,
               case fault when 11 then null when 14 then '27'
                    else cast(16 + o_orderkey % 5 as varchar) end as hour,
               case fault when 4 then concat('"', score, '"') when 5 then concat(score, '??')
                    when 12 then null when 13 then 'n/a'
                    else cast(score as varchar) end as points
        from (select *, o_orderkey % 200 as fault, {_PLAYER} as player, {_DAY} as day,
                     {_POINTS} as score,
                     unnest(range(case when o_totalprice >= 499000 then 2 else 1 end)) as copy
              from orders)""",
    "parsed": """
        select *, cast(case when regexp_matches(event_date, '/\\d{2}$')
                            then try_strptime(event_date, '%m/%d/%y')
                            else try_strptime(event_date, '%m/%d/%Y') end as date) as parsed_date
        from event_performance_staging""",
    "dated": """
        select userid, parsed_date as event_date, hour, points from parsed
        where event_date is null or parsed_date is not null""",
    "typed_users": """
        select userid, try_cast(subscriber as int) as subscriber, country from users_staging""",
    "flagged_users": """
        select userid, subscriber, country, concat_ws(',',
               case when userid is null then 'userid_not_null' end,
               case when subscriber is null then 'subscriber_not_null' end,
               case when country is null then 'country_not_null' end,
               case when length(userid) > 36 then 'userid_max_length' end,
               case when subscriber not in (0, 1) then 'valid_subscriber' end,
               case when country not in ('CA', 'MX', 'US') then 'valid_country' end,
               case when count(userid) over (partition by userid) > 1 then 'userid_unique' end
               ) as failed_rules
        from typed_users""",
    "typed_facts": """
        select regexp_replace(userid, '[" ]', '', 'g') as userid, parsed_date as event_date,
               event_date as date_text, try_cast(hour as int) as hour,
               try_cast(regexp_replace(points, '["?]', '', 'g') as int) as points
        from parsed""",
    "flagged_facts": """
        select userid, event_date, hour, points, concat_ws(',',
               case when userid is null then 'userid_not_null' end,
               case when date_text is null then 'event_date_not_null' end,
               case when hour is null then 'hour_not_null' end,
               case when points is null then 'points_not_null' end,
               case when length(userid) > 36 then 'userid_max_length' end,
               case when date_text is not null and event_date is null
                    then 'parseable_event_date' end,
               case when hour not between 0 and 23 then 'valid_hour' end,
               case when event_date < date '2013-01-01' or event_date > date '2023-07-13'
                    then 'valid_event_date' end) as failed_rules
        from typed_facts""",
    "clean_users": """
        select userid, subscriber, country from flagged_users where failed_rules = ''""",
    "clean_facts": """
        select userid, event_date, hour, points from flagged_facts where failed_rules = ''""",
    "joined": """
        select e.userid, u.subscriber, u.country, e.event_date, e.hour, e.points
        from event_performance e left join users u on u.userid = e.userid""",
    "monthly": """
        select cast(date_trunc('month', event_date) as date) as month,
               cast(sum(points) as bigint) as total_points,
               count(distinct userid) as total_users
        from event_performance group by 1""",
    "daily": """
        select event_date as day, cast(sum(points) as bigint) as total_points
        from event_performance group by 1""",
    "player_totals": """
        select userid, cast(sum(points) as bigint) as total_points, count(*) as num_rows
        from event_performance group by userid""",
    "player_classes": """
        select *, case when total_points > 0 then 'total_points_positive'
                       when total_points < 0 then 'total_points_negative'
                       else 'total_points_zero' end as user_type
        from player_totals""",
    "class_monthly": """
        select c.user_type, cast(date_trunc('month', e.event_date) as date) as month,
               cast(sum(e.points) as bigint) as points
        from event_performance e join player_classes c on c.userid = e.userid
        where c.user_type <> 'total_points_zero' group by 1, 2""",
    "user_totals": """
        select u.userid, u.subscriber, u.country,
               coalesce(t.total_points, 0) as total_points
        from users u left join player_totals t on t.userid = u.userid""",
    "dummies": """
        select userid, subscriber, total_points,
               cast(country = 'CA' as double) as "country_CA",
               cast(country = 'MX' as double) as "country_MX",
               cast(country = 'US' as double) as "country_US"
        from user_totals""",
    "levels": """
        select 'subscriber' as attribute, cast(subscriber as varchar) as level, userid,
               total_points from user_totals
        union all select 'country', country, userid, total_points from user_totals""",
    "boxes": """
        select attribute, level, count(*) as n,
               quantile_cont(cast(total_points as double), 0.25) as q1,
               quantile_cont(cast(total_points as double), 0.5) as median,
               quantile_cont(cast(total_points as double), 0.75) as q3
        from levels group by 1, 2""",
    "class_rows": """
        select 'total_points_positive' as user_type, u.*, p.event_date, p.hour, p.points
        from users u left join (
            select e.* from event_performance e where e.userid in (
                select userid from player_totals where total_points > 0)) p on p.userid = u.userid
        union all
        select 'total_points_negative', u.*, p.event_date, p.hour, p.points
        from users u left join (
            select e.* from event_performance e where e.userid in (
                select userid from player_totals where total_points < 0)) p on p.userid = u.userid""",
}

_DEPENDS = {
    "users": ["accounts"],
    "users_staging": ["accounts"],
    "parsed": ["event_performance_staging"],
    "dated": ["parsed"],
    "typed_users": ["users_staging"],
    "flagged_users": ["typed_users"],
    "typed_facts": ["parsed"],
    "flagged_facts": ["typed_facts"],
    "clean_users": ["flagged_users"],
    "clean_facts": ["flagged_facts"],
    "joined": ["users", "event_performance"],
    "monthly": ["event_performance"],
    "daily": ["event_performance"],
    "player_totals": ["event_performance"],
    "player_classes": ["player_totals"],
    "class_monthly": ["event_performance", "player_classes"],
    "user_totals": ["users", "player_totals"],
    "dummies": ["user_totals"],
    "levels": ["user_totals"],
    "boxes": ["levels"],
    "class_rows": ["users", "event_performance", "player_totals"],
}


def _with(views: str, body: str) -> str:
    """Prefix a query with the views it needs, each after the views it reads."""
    needed: list[str] = []

    def add(name: str) -> None:
        for other in _DEPENDS.get(name, []):
            add(other)
        if name not in needed:
            needed.append(name)

    for name in views.split():
        add(name)
    ctes = ",\n".join(f"{name} as ({_VIEWS[name]})" for name in needed)
    glue = "," if body.lstrip().startswith(",") else ""
    return f"with {ctes}{glue}\n{body.lstrip().lstrip(',')}" if ctes else body


def _ratio(part: str, whole: str, places: int) -> str:
    """Quotient of whole numbers rounded half up in integer arithmetic, as double."""
    p, w, scale = f"cast({part} as hugeint)", f"cast({whole} as hugeint)", 10**places
    return (
        f"(cast(sign({p}) * sign({w}) * ((2 * abs({p}) * {scale} + abs({w})) // (2 * abs({w})))"
        f" as double) / {scale})"
    )


def _percent(part: str, whole: str, places: int) -> str:
    return _ratio(f"100 * ({part})", whole, places)


def _share(keys: str, name: str, within: str = "", places: int = 3, percent: bool = False) -> str:
    total = f"sum(count(userid)) over ({'partition by ' + within if within else ''})"
    formula = (_percent if percent else _ratio)("count(userid)", total, places)
    return f"select {keys}, {formula} as {name} from users group by {keys}"


_SEASON = """case when month(event_date) in (3, 4, 5) then '{0}'
                  when month(event_date) in (6, 7, 8) then '{1}'
                  when month(event_date) in (9, 10, 11) then '{2}' else '{3}' end"""

# Two-sided t tail by Simpson's rule over the density, and the 97.5 % point by its expansion
# in 1/df around the normal one.
_Z = 1.959963984540054


def _t_constant(df: str) -> str:
    return f"exp(lgamma(({df} + 1) / 2.0) - lgamma({df} / 2.0)) / sqrt({df} * {math.pi!r})"


def _t_tail(t: str, df: str, steps: int = 4000) -> str:
    u = f"(abs({t}) * i / {steps}.0)"
    weight = f"case when i in (0, {steps}) then 1 when i % 2 = 1 then 4 else 2 end"
    return (
        f"(1 - 2 * {_t_constant(df)} * abs({t}) / {3 * steps}.0 *"
        f" (select sum({weight} * pow(1 + {u} * {u} / {df}, -({df} + 1) / 2.0))"
        f" from range({steps + 1}) as steps(i)))"
    )


def _t_point(df: str) -> str:
    z = _Z
    g1 = (z**3 + z) / 4
    g2 = (5 * z**5 + 16 * z**3 + 3 * z) / 96
    g3 = (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384
    g4 = (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160
    return f"({z!r} + {g1!r} / {df} + {g2!r} / {df} ** 2 + {g3!r} / {df} ** 3 + {g4!r} / {df} ** 4)"


def _fit_table(source: str) -> str:
    """Rows (term, coef, se, dof) turned into a coefficient table."""
    return f"""
        select term, round(coef, 4) as coef, round(se, 4) as std_err, round(coef / se, 4) as t,
               round({_t_tail('(coef / se)', 'dof')}, 4) as p_value,
               round(coef - {_t_point('dof')} * se, 4) as ci_lower,
               round(coef + {_t_point('dof')} * se, 4) as ci_upper
        from {source}"""


_SIMPLE_FIT = """
    , sums as (
        select count(*) as n, avg(subscriber) as mx, avg(total_points) as my,
               count(*) * var_pop(subscriber) as sxx,
               count(*) * var_pop(total_points) as syy,
               count(*) * covar_pop(total_points, subscriber) as sxy
        from user_totals),
    line as (
        select n, mx, sxx, sxy / sxx as slope, my - sxy / sxx * mx as intercept,
               (syy - sxy * sxy / sxx) / (n - 2) as variance
        from sums)"""

_RESIDUALS = (
    _SIMPLE_FIT
    + """,
    residuals as (
        select userid, subscriber, total_points, intercept + slope * subscriber as predicted,
               total_points - (intercept + slope * subscriber) as residual
        from user_totals, line)"""
)

# Within-level sums give the subscriber slope; level means give the level effects.
_LEVEL_FIT = """
    , per_level as (
        select country, count(*) as n, avg(subscriber) as mx, avg(total_points) as my,
               count(*) * var_pop(subscriber) as sxx,
               count(*) * var_pop(total_points) as syy,
               count(*) * covar_pop(total_points, subscriber) as sxy
        from user_totals group by country),
    pooled as (
        select sum(sxy) / sum(sxx) as slope, sum(sxx) as sxx, sum(n) - count(*) - 1 as dof,
               (sum(syy) - sum(sxy) * sum(sxy) / sum(sxx)) / (sum(n) - count(*) - 1) as variance
        from per_level),
    base as (select * from per_level where country = 'CA'),
    terms as (
        select 'const' as term, b.my - slope * b.mx as coef,
               sqrt(variance * (1.0 / b.n + b.mx * b.mx / p.sxx)) as se, dof
        from base b, pooled p
        union all
        select 'subscriber', slope, sqrt(variance / sxx), dof from pooled
        union all
        select 'country_' || l.country, l.my - b.my - slope * (l.mx - b.mx),
               sqrt(variance * (1.0 / l.n + 1.0 / b.n + (l.mx - b.mx) ** 2 / p.sxx)), dof
        from per_level l, base b, pooled p where l.country <> 'CA')"""

# Rational approximation of the normal quantile (Wichura 1988, AS 241).
_AS241 = {
    "centre": (
        "3.3871328727963666080e0 1.3314166789178437745e2 1.9715909503065514427e3"
        " 1.3731693765509461125e4 4.5921953931549871457e4 6.7265770927008700853e4"
        " 3.3430575583588128105e4 2.5090809287301226727e3",
        "1e0 4.2313330701600911252e1 6.8718700749205790830e2 5.3941960214247511077e3"
        " 2.1213794301586595867e4 3.9307895800092710610e4 2.8729085735721942674e4"
        " 5.2264952788528545610e3",
    ),
    "near": (
        "1.42343711074968357734e0 4.63033784615654529590e0 5.76949722146069140550e0"
        " 3.64784832476320460504e0 1.27045825245236838258e0 2.41780725177450611770e-1"
        " 2.27238449892691845833e-2 7.74545014278341407640e-4",
        "1e0 2.05319162663775882187e0 1.67638483018380384940e0 6.89767334985100004550e-1"
        " 1.48103976427480074590e-1 1.51986665636164571966e-2 5.47593808499534494600e-4"
        " 1.05075007164441684324e-9",
    ),
    "far": (
        "6.65790464350110377720e0 5.46378491116411436990e0 1.78482653991729133580e0"
        " 2.96560571828504891230e-1 2.65321895265761230930e-2 1.24266094738807843860e-3"
        " 2.71155556874348757815e-5 2.01033439929228813265e-7",
        "1e0 5.99832206555887937690e-1 1.36929880922735805310e-1 1.48753612908506148525e-2"
        " 7.86869131145613259100e-4 1.84631831751005468180e-5 1.42151175831644588870e-7"
        " 2.04426310338993978564e-15",
    ),
}


def _rational(part: str, x: str) -> str:
    def polynomial(text: str) -> str:
        coefficients = text.split()
        nested = coefficients[-1]
        for c in reversed(coefficients[:-1]):
            nested = f"({nested} * {x} + {c})"
        return nested

    above, below = _AS241[part]
    return f"{polynomial(above)} / {polynomial(below)}"


_PROBABILITY_PLOT = f""",
    ordered as (
        select residual, row_number() over (order by residual, userid) as rank,
               cast(count(*) over () as double) as n
        from residuals),
    medians as (
        select *, case when rank = n then pow(0.5, 1 / n) when rank = 1 then 1 - pow(0.5, 1 / n)
                       else (rank - 0.3175) / (n + 0.365) end as p
        from ordered),
    halves as (
        select *, p - 0.5 as q, 0.180625 - (p - 0.5) * (p - 0.5) as c,
               sqrt(-ln(least(p, 1 - p))) as r from medians),
    plot as (
        select rank, residual as ordered, case
               when abs(q) <= 0.425 then q * {_rational('centre', 'c')}
               when r <= 5 then sign(q) * {_rational('near', '(r - 1.6)')}
               else sign(q) * {_rational('far', '(r - 5)')} end as theoretical
        from halves)"""

_CONTINGENCY_BY_ROW = """
    , cells as (
        select country as level,
               count(*) filter (user_type = 'total_points_positive') as positive_users,
               count(*) filter (user_type = 'total_points_negative') as negative_users
        from class_rows group by country)"""
_CONTINGENCY_BY_USER = """
    , cells as (
        select u.country as level, count(*) filter (t.total_points > 0) as positive_users,
               count(*) filter (t.total_points < 0) as negative_users
        from users u left join player_totals t on t.userid = u.userid group by u.country)"""
_EXPECTED = """,
    expected as (
        select *, sum(positive_users) over () as p, sum(negative_users) over () as m,
               positive_users + negative_users as both_users from cells),
    expected_cells as (
        select level, positive_users, negative_users, both_users * p / (p + m) as ep,
               both_users * m / (p + m) as em from expected)"""
_EXPECTED_TABLE = """
    select level, positive_users, negative_users, round(ep, 4) as expected_positive,
           round(em, 4) as expected_negative from expected_cells"""
# Three levels, hence two degrees of freedom, for which the tail is exp(-x / 2).
_CHI_SQUARE = """
    select round(x, 4) as chi2, round(exp(-x / 2), 4) as p_value, cast(k - 1 as int) as dof
    from (select sum((positive_users - ep) ** 2 / ep + (negative_users - em) ** 2 / em) as x,
                 count(*) as k from expected_cells)"""


def _statistics(*entries: tuple[str, str]) -> str:
    return "\nunion all\n".join(
        f"select '{name}' as statistic, cast({value} as double) as value" for name, value in entries
    )


_EVENTS = "(select count(distinct event_date) from event_performance)"
_YEAR_DAYS = """(select cast(sum(date_diff('day', make_date(y, 1, 1), make_date(y + 1, 1, 1))) as bigint)
    from (select distinct year(event_date) as y from event_performance))"""
_PLAYERS = "(select count(distinct userid) from event_performance)"
_USERS = "(select count(userid) from users)"


def _daily(aggregate: str) -> str:
    return f"(select {aggregate} from daily)"


def _correlations(columns: list[str]) -> str:
    return "\nunion all\n".join(
        f"select '{c}' as variable, round(corr(\"{c}\", total_points), 4) as correlation from dummies"
        for c in columns
    )


_VARIABLES = ["subscriber", "country_CA", "country_MX", "country_US"]


def _correlation_matrix() -> str:
    names = [*_VARIABLES, "total_points"]

    def entry(a: str, b: str) -> str:
        return f'1.0::double as "{b}"' if a == b else f'round(corr("{a}", "{b}"), 4) as "{b}"'

    return "\nunion all\n".join(
        f"select '{a}' as variable, {', '.join(entry(a, b) for b in names)} from dummies"
        for a in names
    )


def _after_cleaning(text: str) -> str:
    """A query on the clean tables made from the raw ones, instead of the derived ones."""
    chains = {
        "users": "users_staging typed_users flagged_users clean_users",
        "event_performance": "event_performance_staging parsed typed_facts flagged_facts clean_facts",
    }
    for name, chain in chains.items():
        views = chain.split()
        ctes = [f"{view} as ({_VIEWS[view]})" for view in views]
        ctes.append(f"{name} as (select * from {views[-1]})")
        text = text.replace(f"{name} as ({_VIEWS[name]})", ",\n".join(ctes))
    return text


def oracle_sql() -> dict[str, str]:
    texts = _texts()
    names = ("q30_points_summary", "q52_top_players_per_month", "q66_multiple_regression")
    cleaned = {f"{name}_after_cleaning": _after_cleaning(texts[name]) for name in names}
    same = {
        "q22_row_account_while_writing": "q22_row_account",
        "q22_rejection_counts_while_writing": "q22_rejection_counts",
        "q36_enriched_facts_by_user": "q36_enriched_facts",
        "q56_user_totals_by_user": "q56_user_totals",
        "q59_subscriber_correlation_from_moments": "q59_subscriber_correlation",
        "q63_anova_from_moments": "q63_anova",
        "q66_multiple_regression_from_moments": "q66_multiple_regression",
    }
    return texts | cleaned | {name: texts[other] for name, other in same.items()}


def _texts() -> dict[str, str]:
    return {
        "s01_load_users_csv": _with("users_staging", "select * from users_staging"),
        "s01_line_breaks_in_quotes": _with(
            "users_staging",
            """select case when subscriber = '1'
                           then userid || chr(10) || '"x",' || chr(10) || coalesce(country, '')
                           else userid end as userid, subscriber, country
               from users_staging""",
        ),
        "s02_load_facts_csv": _with(
            "event_performance_staging", "select * from event_performance_staging"
        ),
        "s03_replace_staging_table": _with("users_staging", "select * from users_staging"),
        "s06_sql_with_dates": _with(
            "dated",
            "select event_date, count(*) as num_rows from dated"
            " where event_date is not null group by event_date",
        ),
        "s07_persisted_step": _with("dated", "select * from dated"),
        "s02_malformed_lines": _with(
            "event_performance",
            """
            , lines as (
                select *, userid || ',' || strftime(event_date, '%Y-%m-%d') || ',' || hour as line
                from event_performance)
            select line || ',' || points || ',x' as malformed_line from lines where points % 50 = 0
            union all select line from lines where points % 50 = 1""",
        ),
        "s08_insert_select": _with("clean_facts", "select * from clean_facts"),
        "q01_registered_players": _with(
            "users", "select count(distinct userid) as num_players from users"
        ),
        "q02_participating_players": _with(
            "event_performance",
            "select count(distinct userid) as num_participating_players from event_performance",
        ),
        "q03_events": _with(
            "event_performance",
            "select count(distinct event_date) as num_gaming_events from event_performance",
        ),
        "q04_users_with_nulls": _with(
            "users_staging",
            "select * from users_staging"
            " where userid is null or subscriber is null or country is null",
        ),
        "q05_facts_with_nulls": _with(
            "event_performance_staging",
            "select * from event_performance_staging where userid is null or event_date is null"
            " or hour is null or points is null",
        ),
        "q06_duplicate_users": _with(
            "users_staging",
            "select userid as duplicate_ids, count(userid) as num_records from users_staging"
            " group by userid having count(userid) > 1",
        ),
        "q07_duplicate_facts": _with(
            "event_performance_staging",
            "select userid, event_date, hour, points, count(*) as num_records"
            " from event_performance_staging group by all having count(*) > 1",
        ),
        "q08_user_id_lengths": _with(
            "users_staging",
            "select cast(length(userid) as int) as userid_length, count(*) as frequency"
            " from users_staging group by 1",
        ),
        "q09_subscriber_values": _with(
            "users_staging", "select distinct cast(subscriber as int) as subscriber from users_staging"
        ),
        "q10_attribute_levels": _with(
            "users_staging", "select distinct left(country, 2) as country from users_staging"
        ),
        "q11_fact_id_lengths": _with(
            "event_performance_staging",
            "select cast(length(userid) as int) as userid_length, count(*) as frequency"
            " from event_performance_staging group by 1",
        ),
        "q12_longest_ids": _with(
            "event_performance_staging",
            "select replace(userid, ' ', '\\s') as userid,"
            " cast(length(userid) as int) as userid_length from event_performance_staging"
            " where length(userid) = (select max(length(userid)) from event_performance_staging)",
        ),
        "q13_unparseable_dates": _with(
            "parsed",
            "select userid, event_date, hour, points from parsed"
            " where event_date is not null and parsed_date is null",
        ),
        "q14_without_invalid_dates": _with(
            "parsed",
            "select userid, event_date, hour, points from parsed"
            " where event_date is null or parsed_date is not null",
        ),
        "q15_normalised_dates": _with("dated", "select * from dated"),
        "q16_first_next_to_last_dates": _with(
            "dated",
            """select f.event_date as earliest_dates, l.event_date as latest_dates
               from (select event_date, row_number() over (order by event_date) as rn
                     from dated where event_date is not null) f
               join (select event_date, row_number() over (order by event_date desc) as rn
                     from dated where event_date is not null) l on l.rn = f.rn
               where f.rn <= 3""",
        ),
        "q17_earliest_dates": _with(
            "dated",
            "select event_date as earliest_dates from dated order by 1 nulls last limit 5",
        ),
        "q17_latest_dates": _with(
            "dated",
            "select event_date as latest_dates from dated order by 1 desc nulls last limit 5",
        ),
        "q18_hours": _with(
            "event_performance_staging",
            "select distinct cast(hour as int) as hour from event_performance_staging",
        ),
        "q19_illegal_points": _with(
            "event_performance_staging",
            "select points from event_performance_staging"
            " where regexp_matches(points, '^.*[^A-Za-z0-9 .-].*$')",
        ),
        "q20_points_failing_cast": _with(
            "event_performance_staging",
            "select * from event_performance_staging"
            " where points is not null and try_cast(points as int) is null",
        ),
        "q21_clean_users": _with(
            "flagged_users",
            "select userid, subscriber, country from flagged_users where failed_rules = ''",
        ),
        "q21_rejected_users": _with(
            "flagged_users", "select * from flagged_users where failed_rules <> ''"
        ),
        "q22_clean_facts": _with("clean_facts", "select * from clean_facts"),
        "q22_row_account": _with(
            "event_performance_staging flagged_facts",
            """
            , counts as (
                select count(*) filter (where failed_rules = '') as valid,
                       count(*) filter (where failed_rules <> '') as rejected
                from flagged_facts),
            staging as (select count(*) as n from event_performance_staging)
            select 'valid' as outcome, valid as num_rows from counts
            union all select 'rejected', rejected from counts
            union all select 'unaccounted', n - valid - rejected from counts, staging""",
        ),
        "q22_rejected_facts": _with(
            "flagged_facts", "select * from flagged_facts where failed_rules <> ''"
        ),
        "q22_rejection_counts": _with(
            "flagged_facts",
            "select unnest(string_split(failed_rules, ',')) as rule, count(*) as num_rows"
            " from flagged_facts where failed_rules <> '' group by 1",
        ),
        "q23_exported_facts": _with("clean_facts", "select * from clean_facts"),
        "q24_matched_ids": _with(
            "users event_performance",
            "select count(distinct u.userid) as num_unique_users_tbl,"
            " count(distinct e.userid) as num_unique_event_perf_tbl"
            " from event_performance e left join users u on u.userid = e.userid",
        ),
        "q25_ghost_ids": _with(
            "users event_performance",
            "select distinct e.userid as ghost_userids from event_performance e"
            " left join users u on u.userid = e.userid where u.userid is null",
        ),
        "q26_ghost_rows": _with(
            "users event_performance",
            "select count(*) as ghost_userid_num_entries from event_performance e"
            " left join users u on u.userid = e.userid where u.userid is null",
        ),
        "q27_fact_rows": _with(
            "event_performance", "select count(*) as num_rows from event_performance"
        ),
        "q28_event_stats": _with(
            "event_performance",
            _statistics(
                ("num_gaming_events", _EVENTS),
                ("gaming_event_yrly_pct", _percent(_EVENTS, _YEAR_DAYS, 2)),
            ),
        ),
        "q29_participation_stats": _with(
            "users event_performance",
            _statistics(
                ("num_gaming_events", _EVENTS),
                ("gaming_event_yrly_pct", _percent(_EVENTS, _YEAR_DAYS, 2)),
                ("num_unique_users", _USERS),
                ("participating_users_pct", _percent(_PLAYERS, _USERS, 2)),
            ),
        ),
        "q30_points_summary": _with(
            "users daily",
            _statistics(
                ("num_gaming_events", _EVENTS),
                ("num_unique_users", _USERS),
                ("participating_users_pct", _percent(_PLAYERS, _USERS, 2)),
                ("avg_tot_pts_per_event", _daily(_ratio("sum(total_points)", "count(*)", 0))),
                ("std_dev_tot_pts_per_event", _daily("round(stddev_samp(total_points))")),
                ("min_event_pts", _daily("min(total_points)")),
                ("q1_event_pts", _daily("quantile_cont(total_points::double, 0.25)")),
                ("median_event_pts", _daily("quantile_cont(total_points::double, 0.5)")),
                ("q3_event_pts", _daily("quantile_cont(total_points::double, 0.75)")),
                ("max_event_pts", _daily("max(total_points)")),
                ("range", _daily("max(total_points) - min(total_points)")),
            ),
        ),
        "q31_subscriber_proportions": _with("users", _share("subscriber", "proportion")),
        "q32_attribute_proportions": _with("users", _share("country", "proportion")),
        "q33_stacked_frequencies": _with(
            "users",
            f"""select cast(subscriber as varchar) as attribute, count(userid) as num_users,
                       {_ratio('count(userid)', 'sum(count(userid)) over ()', 4)} as rel_freq
                from users group by subscriber
                union
                select country, count(userid),
                       {_ratio('count(userid)', 'sum(count(userid)) over ()', 4)}
                from users group by country""",
        ),
        "q34_profile_frequencies": _with(
            "users",
            f"""select subscriber, country, count(userid) as num_users,
                       {_ratio('count(userid)', 'sum(count(userid)) over ()', 4)} as rel_freq
                from users group by subscriber, country""",
        ),
        "q34_profile_proportions": _with("users", _share("subscriber, country", "proportion")),
        "q35_proportions_within_subscriber": _with(
            "users", _share("subscriber, country", "proportion", "subscriber")
        ),
        "q36_enriched_facts": _with("joined", "select * from joined"),
        "q36_subscriber_facts": _with("joined", "select * from joined where subscriber = 1"),
        "q36_non_subscriber_facts": _with("joined", "select * from joined where subscriber = 0"),
        "q37_participants_by_status": _with(
            "joined",
            " union ".join(
                f"select '{name}' as subscriber_status, count(distinct userid) as count,"
                f" {_percent('count(distinct userid)', _PLAYERS, 2)} as perc"
                f" from joined where subscriber = {flag}"
                for name, flag in (("non_subscribers", 0), ("subscribers", 1))
            ),
        ),
        "q38_subscription_rate": _with(
            "users",
            f"select {_percent('sum(subscriber)', 'count(*)', 2)} as avg_subscription_rate from users",
        ),
        **{
            name: _with(
                "joined",
                f"""select {key}, {_ratio('sum(points)',
                        '(select sum(points) from event_performance)', 4)} as prop_pts_scored
                    from joined where {key} is not null group by {key}""",
            )
            for name, key in (
                ("q39_points_share_by_attribute", "country"),
                ("q40_points_share_by_subscriber", "subscriber"),
            )
        },
        "q41_fact_preview": _with(
            "event_performance",
            "select * from event_performance order by event_date, hour, userid, points limit 5",
        ),
        "q42_sign_class_frequencies": _with(
            "player_classes",
            f"""select user_type, count(*) as num_users,
                       {_ratio('count(*)', 'sum(count(*)) over ()', 4)} as rel_freq
                from player_classes group by user_type""",
        ),
        "q43_monthly_activity": _with("monthly", "select * from monthly"),
        "q43_monthly_activity_of_a_year": _with("monthly", "select * from monthly where year(month) = 2012"),
        "q43_players_by_month_quarter_year": _with(
            "event_performance",
            "\nunion all\n".join(
                f"select '{unit}' as unit, cast(date_trunc('{unit}', event_date) as date) as period,"
                " count(distinct userid) as num_players from event_performance group by all"
                for unit in ("month", "quarter", "year")
            ),
        ),
        "q44_monthly_changes_on_calendar": _with(
            "event_performance",
            """
            , busy as (
                select cast(date_trunc('month', event_date) as date) as month,
                       cast(sum(points) as bigint) as total_points, count(distinct userid) as total_users
                from event_performance where points >= 2150 group by 1),
            months as (
                select cast(unnest(generate_series(
                    (select min(month) from busy), (select max(month) from busy), interval 1 month)) as date) as month)
            select months.month, total_points, total_users, total_users is not null as has_events,
                   total_points - lag(total_points) over w as total_points_change,
                   total_users - lag(total_users) over w as total_users_change,
                   row_number() over w > 1 and lag(total_users) over w is null as after_gap
            from months left join busy on busy.month = months.month
            window w as (order by months.month)""",
        ),
        "q44_monthly_extent": _with(
            "monthly",
            f"""select {_ratio('sum(total_points)', 'count(*)', 4)} as avg_total_points,
                       min(total_points) as min_total_points,
                       max(total_points) as max_total_points,
                       {_ratio('sum(total_users)', 'count(*)', 4)} as avg_total_users,
                       min(total_users) as min_total_users, max(total_users) as max_total_users
                from monthly""",
        ),
        "q44_monthly_changes": _with(
            "monthly",
            f"""select *, {_ratio('total_points_change', '100000', 2)}
                       as total_points_change_scaled
                from (select *,
                        total_points - lag(total_points) over (order by month)
                          as total_points_change,
                        total_users - lag(total_users) over (order by month)
                          as total_users_change
                      from monthly)""",
        ),
        **{
            name: _with(
                "class_monthly",
                f"select month, points as {column} from class_monthly where user_type = '{kind}'",
            )
            for name, column, kind in (
                ("q45_monthly_points_of_positive_users", "total_positive_points",
                 "total_points_positive"),
                ("q46_monthly_points_of_negative_users", "total_negative_points",
                 "total_points_negative"),
            )
        },
        "q47_class_extent": _with(
            "class_monthly",
            f"""select user_type, {_ratio('sum(points)', 'count(*)', 4)} as avg_points,
                       min(points) as min_points, max(points) as max_points
                from class_monthly group by user_type""",
        ),
        "q47_class_changes": _with(
            "class_monthly",
            f"""select *, {_ratio('points_change', '100000', 2)} as points_change_scaled
                from (select *, points - lag(points) over (partition by user_type order by month)
                             as points_change
                      from class_monthly)""",
        ),
        "q48_facts_with_season": _with(
            "event_performance",
            f"select *, {_SEASON.format('spring', 'summer', 'fall', 'winter')} as season"
            " from event_performance",
        ),
        "q49_season_hour_totals": _with(
            "event_performance",
            f"select {_SEASON.format('0_spring', '1_summer', '2_fall', '3_winter')} as season,"
            " hour, cast(sum(points) as bigint) as tot_points from event_performance group by all",
        ),
        "q50_daily_totals": _with("daily", "select * from daily"),
        "q50_daily_extent": _with(
            "daily",
            f"""select {_ratio('sum(total_points)', 'count(*)', 4)} as avg_total_points,
                       min(total_points) as min_total_points, max(total_points) as max_total_points
                from daily""",
        ),
        "q51_extreme_days": _with(
            "daily",
            "select *, strftime(day, '%m-%d') as day_label from daily"
            " where total_points = (select min(total_points) from daily)"
            " or total_points = (select max(total_points) from daily)",
        ),
        "q52_top_players_per_month": _with(
            "event_performance",
            """select userid, month, points_earned, ranking from (
                 select userid, cast(month(event_date) as int) as month,
                        cast(sum(points) as bigint) as points_earned,
                        cast(dense_rank() over (partition by month(event_date)
                                                order by sum(points) desc) as int) as ranking
                 from event_performance group by userid, month(event_date))
               where ranking <= 2""",
        ),
        "q53_rows_per_level": _with(
            "users event_performance",
            "select country, count(hour) as cnt from users"
            " left join event_performance using (userid) group by country",
        ),
        "q54_profile_percentages": _with(
            "users", _share("country, subscriber", "pct", places=2, percent=True)
        ),
        "q55_percentages_within_attribute": _with(
            "users", _share("country, subscriber", "pct", "country", places=2, percent=True)
        ),
        "q56_user_totals": _with("user_totals", "select * from user_totals"),
        "q57_box_stats": _with(
            "boxes",
            """select b.attribute, b.level, b.n, b.q1, b.median, b.q3,
                      cast(min(total_points) filter (inside) as double) as whisker_low,
                      cast(max(total_points) filter (inside) as double) as whisker_high,
                      count(*) filter (not inside) as num_outliers
               from (select l.*, total_points between q1 - 1.5 * (q3 - q1)
                                                  and q3 + 1.5 * (q3 - q1) as inside
                     from levels l join boxes using (attribute, level)) v
               join boxes b using (attribute, level) group by all""",
        ),
        "q58_top_outliers": _with(
            "boxes",
            """, top as (
                 select userid, total_points from levels join boxes using (attribute, level)
                 where attribute = 'country' and level = 'US'
                   and total_points not between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1)
                 order by total_points desc, userid limit 9)
               select *, (select min(total_points) from top) as threshold from top""",
        ),
        "q59_subscriber_correlation": _with(
            "user_totals",
            "select round(corr(total_points, subscriber), 4) as correlation from user_totals",
        ),
        "q59_subscriber_correlation_by_month": _with(
            "users event_performance",
            """, months as (
                 select distinct cast(date_trunc('month', event_date) as date) as month
                 from event_performance join users using (userid)),
               so_far as (
                 select month, u.userid, any_value(subscriber) as subscriber,
                        coalesce(sum(points), 0) as total_points
                 from months cross join users u left join event_performance e
                   on e.userid = u.userid and e.event_date < month + interval 1 month
                 group by month, u.userid)
               select month, round(corr(total_points, subscriber), 4) as correlation
               from so_far group by month""",
        ),
        "q60_subscriber_regression": _with(
            "user_totals",
            _SIMPLE_FIT
            + """,
            terms as (
                select 'const' as term, intercept as coef,
                       sqrt(variance * (1.0 / n + mx * mx / sxx)) as se, n - 2 as dof from line
                union all
                select 'subscriber', slope, sqrt(variance / sxx), n - 2 from line)"""
            + _fit_table("terms"),
        ),
        "q61_residuals": _with(
            "user_totals",
            _RESIDUALS
            + """select userid, subscriber, total_points, round(predicted, 4) as predicted,
                        round(residual, 4) as residual from residuals""",
        ),
        "q62_probability_plot": _with(
            "user_totals",
            _RESIDUALS
            + _PROBABILITY_PLOT
            + "select rank, round(theoretical, 4) as theoretical, round(ordered, 4) as ordered"
            " from plot",
        ),
        "q62_probability_plot_line": _with(
            "user_totals",
            _RESIDUALS
            + _PROBABILITY_PLOT
            + "select round(regr_slope(ordered, theoretical), 4) as slope,"
            " round(regr_intercept(ordered, theoretical), 4) as intercept,"
            " round(corr(theoretical, ordered), 4) as r from plot",
        ),
        # Three levels, hence two degrees of freedom between groups, with a closed tail.
        "q63_anova": _with(
            "user_totals",
            """, g as (
                 select country, count(*) as n, avg(total_points) as m,
                        var_pop(total_points) as v from user_totals group by country),
               f as (
                 select count(*) - 1 as df_between, sum(n) - count(*) as df_within,
                        (sum(n * (m - grand) ** 2) / (count(*) - 1))
                          / (sum(n * v) / (sum(n) - count(*))) as f
                 from g, (select avg(total_points) as grand from user_totals))
               select round(f, 4) as f_statistic,
                      round(pow(df_within / (df_within + 2 * f), df_within / 2.0), 4) as p_value,
                      cast(df_between as int) as df_between,
                      cast(df_within as bigint) as df_within from f""",
        ),
        "q64_dummy_frame": _with("dummies", "select * from dummies"),
        "q65_correlations": _with("dummies", _correlations(_VARIABLES)),
        "q65_correlation_matrix": _with("dummies", _correlation_matrix()),
        "q66_multiple_regression": _with("user_totals", _LEVEL_FIT + _fit_table("terms")),
        "q67_classified_totals": _with("player_classes", "select * from player_classes"),
        "q67_classified_facts": _with(
            "event_performance player_classes",
            "select e.*, c.user_type from event_performance e join player_classes c using (userid)"
            " where c.total_points <> 0",
        ),
        "q67_positive_facts": _with(
            "event_performance player_classes",
            "select * from event_performance where userid in"
            " (select userid from player_classes where total_points > 0)",
        ),
        **{
            f"q68_users_with_{kind}_facts": _with(
                "class_rows",
                "select userid, subscriber, country, event_date, hour, points from class_rows"
                f" where user_type = 'total_points_{kind}'",
            )
            for kind in ("negative", "positive")
        },
        "q68_class_row_shares": _with(
            "class_rows",
            "\nunion all\n".join(
                f"""select user_type, '{name}' as attribute, cast({name} as varchar) as level,
                           {_ratio('count(*)', 'sum(count(*)) over (partition by user_type)', 4)}
                             as user_share,
                           {_ratio('count(points)',
                                   'sum(count(*)) over (partition by user_type)', 4)}
                             as fact_share
                    from class_rows group by user_type, {name}"""
                for name in ("subscriber", "country")
            ),
        ),
        "q69_contingency_table": _with(
            "class_rows", _CONTINGENCY_BY_ROW + _EXPECTED + _EXPECTED_TABLE
        ),
        "q69_contingency_table_by_user": _with(
            "users player_totals", _CONTINGENCY_BY_USER + _EXPECTED + _EXPECTED_TABLE
        ),
        "q69_chi_square": _with("class_rows", _CONTINGENCY_BY_ROW + _EXPECTED + _CHI_SQUARE),
        "q69_chi_square_by_user": _with(
            "users player_totals", _CONTINGENCY_BY_USER + _EXPECTED + _CHI_SQUARE
        ),
    }
