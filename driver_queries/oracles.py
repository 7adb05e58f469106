"""The registered queries in SQL, for comparison in another engine.

Each text below is written on its own, from the rules; it starts from the given tables through
the view definitions in ``VIEWS``. Quotients are formed on integer cents, so that rounding is
exact on both sides.
"""

from __future__ import annotations

import re

# ------------------------------------------------------------------------------------ views

CUR = "case n.n_regionkey when 0 then 'PHP' when 2 then 'AUD' when 3 then 'EUR' else 'USD' end"
REG = "case n.n_regionkey when 0 then 'PH' when 1 then 'US' when 2 then 'AU' when 3 then 'EU' end"
HOMES = "join customer c on c.c_custkey = o.o_custkey join nation n on n.n_nationkey = c.c_nationkey"

MATRIX = {
    ("USD", "USD"): "1",
    ("USD", "PHP"): "58",
    ("USD", "AUD"): "1.52",
    ("USD", "EUR"): "0.92",
    ("PHP", "USD"): "0.0172413793103449",
    ("PHP", "PHP"): "1",
    ("PHP", "AUD"): "0.0262068965517242",
    ("PHP", "EUR"): "0.0158620689655173",
    ("AUD", "USD"): "0.6578947368421053",
    ("AUD", "PHP"): "38.1578947368421053",
    ("AUD", "AUD"): "1",
    ("AUD", "EUR"): "0.6052631578947369",
    ("EUR", "USD"): "1.0869565217391305",
    ("EUR", "PHP"): "63.0434782608695653",
    ("EUR", "AUD"): "1.6521739130434783",
    ("EUR", "EUR"): "1",
}


def union_all(parts: list[str]) -> str:
    return "\nunion all\n".join(parts)


def money(expr: str) -> str:
    return f"cast(round({expr}, 2) as decimal(18,2))"


def money_sum(expr: str) -> str:
    return f"cast(coalesce(sum({expr}), 0) as decimal(18,2))"


def cents(expr: str) -> str:
    return f"cast({expr} * 100 as hugeint)"


def half_even(num: str, den: str, digits: int) -> str:
    """num / den (den > 0) on integers, half to even, as decimal(20, digits)."""
    unit = "0." + "0" * (digits - 1) + "1"
    n, d = f"(abs({num}) * {10**digits})", f"({den})"
    up = f"(2 * ({n} % {d}) > {d} or (2 * ({n} % {d}) = {d} and ({n} // {d}) % 2 = 1))"
    whole = f"(({n} // {d}) + case when {up} then 1 else 0 end) * sign({num})"
    return f"cast(cast({whole} as decimal(16,0)) * cast({unit} as decimal(4,{digits})) as decimal(20,{digits}))"


def ratio(num: str, den: str, digits: int = 4) -> str:
    """0 unless the denominator is above 0."""
    value = half_even(cents(num), f"nullif({cents(den)}, 0)", digits)
    return f"case when {den} > 0 then {value} else cast(0 as decimal(20,{digits})) end"


def per12(expr: str) -> str:
    """A twelfth, half up, on integer cents."""
    c = cents(expr)
    whole = f"sign({c}) * ((abs({c}) * 2 + 12) // 24)"
    return f"cast(cast({whole} as decimal(16,0)) * 0.01 as decimal(18,2))"


def brackets(x: str, rows: list[tuple[str, str]]) -> str:
    parts = []
    for i, (low, rate) in enumerate(rows):
        top = f"least({x}, {rows[i + 1][0]})" if i + 1 < len(rows) else x
        parts.append(f"greatest({top} - {low}, 0) * {rate}")
    return " + ".join(parts)


INCOME = money_sum("case when direction = 'inbound' then amt else 0 end")
EXPENSE = money_sum("case when direction = 'outbound' then amt else 0 end")
NET = money_sum("case when direction = 'inbound' then amt else -amt end")

PH_TAX = brackets(
    "taxable",
    [("250000", "0.15"), ("400000", "0.20"), ("800000", "0.25"), ("2000000", "0.30"), ("8000000", "0.35")],
)
US_TAX = brackets(
    "taxable",
    [
        ("0", "0.10"),
        ("11925", "0.12"),
        ("48475", "0.22"),
        ("103350", "0.24"),
        ("197300", "0.32"),
        ("250525", "0.35"),
        ("626350", "0.37"),
    ],
)
AU_TAX = brackets(
    "g", [("18200", "0.16"), ("45000", "0.30"), ("135000", "0.37"), ("190000", "0.45")]
)
DE_Y = "cast((least(greatest(g, 11604), 17005) - 11604) * 0.0001 as decimal(9,6))"
DE_Z = "cast((least(greatest(g, 17005), 66760) - 17005) * 0.0001 as decimal(9,6))"
DE_TAX = f"""case when g <= 11604 then 0
  when g <= 17005 then (922.98 * {DE_Y} + 1400) * {DE_Y}
  when g <= 66760 then (181.19 * {DE_Z} + 2397) * {DE_Z} + 1025.38
  when g <= 277825 then 0.42 * g - 10602.13 else 0.45 * g - 18936.88 end"""


def _line(region: str, position: int, key: str, label: str, kind: str, amount: str) -> str:
    return (
        f"select id, user_id, region, {position} pos, '{key}' key, '{label}' as label, '{kind}' kind, "
        f"cast({amount} as decimal(30,14)) exact from gross where region = '{region}'"
    )


PH_SSS = "least(greatest(g, 48000), 360000) * 0.045"
PH_HEALTH = "least(greatest(g, 120000), 1200000) * 0.025"
PH_PAGIBIG = "least(g, 60000) * 0.02"

VIEWS = {
    "led_users": f"""select c.c_custkey id, c.c_name as name, {CUR} base_currency,
  coalesce({REG}, 'US') default_region
from customer c join nation n on n.n_nationkey = c.c_nationkey""",
    "led_transactions": f"""select o.o_orderkey id, o.o_custkey user_id,
  case when substr(o.o_orderpriority,1,1) in ('1','2') then 'inbound' else 'outbound' end direction,
  cast((cast(substr(o.o_orderpriority,1,1) as int)-1)*3
    + case o.o_orderstatus when 'F' then 0 when 'O' then 1 else 2 end as int) category_id,
  cast(o.o_totalprice as decimal(14,2)) amount, {CUR} currency, {REG} region,
  cast(o.o_orderdate as date) occurred_on, cast(null as varchar) occurred_time
from orders o {HOMES}""",
    "led_timed": """select event_id id, user_id,
  case when event_type in ('signup','view') then 'inbound' else 'outbound' end direction,
  case event_type when 'click' then 100 when 'error' then 101 when 'purchase' then 102
    when 'signup' then 103 else 104 end category_id,
  cast(value as decimal(14,2)) amount,
  case user_id % 4 when 0 then 'USD' when 1 then 'PHP' when 2 then 'AUD' else 'EUR' end currency,
  case user_id % 5 when 0 then 'US' when 1 then 'PH' when 2 then 'AU' when 3 then 'EU' end region,
  cast(ts as date) occurred_on,
  case when event_id % 7 <> 0 then substr(cast(ts as varchar),12,8) end occurred_time
from events""",
    "led_categories": """select distinct category_id id, concat('CAT_', cast(category_id as varchar)) as name,
  direction, category_id in (9,12) statutory
from (select category_id, direction from led_transactions
      union all select category_id, direction from led_timed) x
where category_id not in (14,102)""",
    "led_budgets": """select user_id, category_id, cast(year(occurred_on) as int) as year,
  cast(month(occurred_on) as int) as month,
  cast(round(max(amount) * case month(occurred_on)%3 when 0 then 0.8 when 1 then 1.2 else 2.0 end, 2)
    as decimal(14,2)) limit_amount,
  case when month(occurred_on)%2 = 0 then 'USD' else min(currency) end currency
from led_transactions where direction = 'outbound' and (user_id+category_id)%3 <> 0
group by user_id, category_id, year(occurred_on), month(occurred_on)""",
    "led_fund_overrides": f"""select c.c_custkey user_id,
  case c.c_custkey%40 when 0 then 'month' when 10 then '3m' when 20 then 'ytd' else 'all' end as scope,
  cast(case c.c_custkey%40 when 0 then '1998-06-01' when 10 then '1998-04-01' when 20 then '1998-01-01'
    else '1970-01-01' end as date) period_start,
  cast(c.c_acctbal as decimal(14,2)) amount, {CUR} currency
from customer c join nation n on n.n_nationkey = c.c_nationkey where c.c_custkey%10 = 0""",
    "led_profiles": f"""select o.o_orderkey id, o.o_custkey user_id, {REG} region, {CUR} currency,
  cast(round(cast(o.o_totalprice as decimal(14,2))
    * case n.n_regionkey when 0 then 20.0 when 1 then 2.0 else 1.0 end
    * case when o.o_orderkey%2 = 0 then 0.1 else 1.0 end, 2) as decimal(14,2)) gross_amount,
  case when o.o_orderkey%2 = 0 then 'monthly' else 'annual' end pay_period,
  cast(year(o.o_orderdate) as int) tax_year, o.o_orderstatus = 'O' is_active, o.o_orderdate updated_at
from orders o {HOMES} where n.n_regionkey <> 4""",
    "led_fx_history": """select 'USD' base_currency,
  case event_type when 'click' then 'PHP' when 'view' then 'AUD' else 'EUR' end quote_currency,
  cast(max_by(value, ts) as decimal(18,8)) rate, cast(ts as date) as_of
from events where event_type in ('click','view','purchase') group by event_type, cast(ts as date)""",
    "matrix": union_all(
        [f"select '{b}' b, '{q}' q, cast('{r}' as decimal(22,16)) r" for (b, q), r in MATRIX.items()]
    ),
    # Converted to USD, and to each user's base currency.
    "conv": f"""select t.*, {money('t.amount * m.r')} amt
from led_transactions t join matrix m on m.b = t.currency and m.q = 'USD'""",
    "convt": f"""select t.*, {money('t.amount * m.r')} amt
from led_timed t join matrix m on m.b = t.currency and m.q = 'USD'""",
    "convb": f"""select t.*, {money('t.amount * m.r')} amt
from led_transactions t join led_users u on u.id = t.user_id
join matrix m on m.b = t.currency and m.q = u.base_currency""",
    "category_totals": f"""select t.user_id, t.category_id, coalesce(c.name, 'Uncategorized') category_name,
  t.direction, t.total
from (select user_id, category_id, min_by(direction, id) direction, {money_sum('amt')} total
      from conv group by user_id, category_id) t
left join led_categories c on c.id = t.category_id""",
    "days": "select distinct occurred_on anchor from led_transactions",
    "ranges": "select unnest(['this_month','last_3m','ytd','all']) range_name",
    "scopes": "select unnest(['month','3m','ytd','all']) as scope",
    "gross": """select *, cast(gross_amount * case pay_period when 'monthly' then 12 else 1 end
  as decimal(16,2)) g from led_profiles""",
    "ph_base": f"""select id, cast({PH_SSS} + {PH_HEALTH} + {PH_PAGIBIG} as decimal(20,5)) social,
  cast(greatest(g - cast({PH_SSS} + {PH_HEALTH} + {PH_PAGIBIG} as decimal(20,5)), 0) as decimal(20,5)) taxable
from gross where region = 'PH'""",
    "us_base": "select id, greatest(g - 15000, 0) taxable from gross where region = 'US'",
    "lines": union_all(
        [
            _line("PH", 1, "sss", "SSS", "social", PH_SSS),
            _line("PH", 2, "philhealth", "PhilHealth", "social", PH_HEALTH),
            _line("PH", 3, "pagibig", "Pag-IBIG", "social", PH_PAGIBIG),
            f"""select id, user_id, region, 4 pos, 'income_tax' key, 'Income tax' as label, 'tax' kind,
  cast({PH_TAX} as decimal(30,14)) exact from gross join ph_base using (id)""",
            f"""select id, user_id, region, 1 pos, 'federal_income_tax' key, 'Federal income tax' as label,
  'tax' kind, cast({US_TAX} as decimal(30,14)) exact from gross join us_base using (id)""",
            _line("US", 2, "social_security", "Social Security", "social", "least(g, 176100) * 0.062"),
            _line(
                "US", 3, "medicare", "Medicare", "social",
                "g * 0.0145 + greatest(g - 200000, 0) * 0.009",
            ),
            _line("AU", 1, "income_tax", "Income tax (PAYG)", "tax", AU_TAX),
            _line(
                "AU", 2, "medicare_levy", "Medicare levy", "social",
                "case when g > 27222 then g * 0.02 else 0 end",
            ),
            _line("AU", 3, "super", "Superannuation (employer)", "info", "g * 0.115"),
            _line("EU", 1, "income_tax", "Income tax (Lohnsteuer)", "tax", DE_TAX),
            _line("EU", 2, "pension", "Pension insurance", "social", "least(g, 90600) * 0.093"),
            _line("EU", 3, "health", "Health insurance", "social", "least(g, 62100) * 0.0815"),
            _line("EU", 4, "unemployment", "Unemployment insurance", "social", "least(g, 90600) * 0.013"),
            _line("EU", 5, "care", "Long-term care insurance", "social", "least(g, 62100) * 0.017"),
        ]
    ),
    "paysums": """select id,
  cast(sum(case when kind = 'tax' then exact else 0 end) as decimal(30,14)) tax,
  cast(sum(case when kind = 'social' then exact else 0 end) as decimal(30,14)) social
from lines group by id""",
    "pay": f"""select p.*, cast(g as decimal(18,2)) gross_annual, {money('tax')} total_tax,
  {money('social')} total_social, {money('tax + social')} total_deductions,
  {money('g - (tax + social)')} net_annual
from gross p join paysums using (id)""",
    "items": f"""select id, user_id, region, key, label, kind, {money('exact')} amount from lines
union all select id, user_id, region, 'gross',
  case region when 'US' then 'Gross wages' else 'Gross salary' end, 'gross', gross_annual from pay
union all select id, user_id, region, 'net', 'Net take-home', 'net', net_annual from pay""",
    "payp": f"""select *,
  case pay_period when 'monthly' then {per12('gross_annual')} else gross_annual end gross_period,
  case pay_period when 'monthly' then {per12('net_annual')} else net_annual end net_period,
  {half_even(cents('total_deductions'), cents('gross_annual'), 4)} effective_rate
from pay""",
    "active": """select * from payp where is_active
qualify row_number() over (partition by user_id order by updated_at desc, id desc) = 1""",
}


def with_views(sql: str) -> str:
    """The query after the views it names, directly or through other views."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name, body in VIEWS.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                visit(body)

    visit(sql)
    chosen = [f"{name} as (\n{body}\n)" for name, body in VIEWS.items() if name in needed]
    if not chosen:
        return sql
    lead = "with " + ",\n".join(chosen)
    return f"{lead},\n{sql[5:]}" if sql.startswith("with ") else f"{lead}\n{sql}"


# ---------------------------------------------------------------------------------- queries

Q: dict[str, str] = {}

# Every column of a table in order; those that the views do not have are NULL.
_TABLES = {
    "ledger": ("led_transactions", "id, user_id, direction, category_id, amount, currency, region, occurred_on, "
               "occurred_time, description:varchar, created_at:timestamp"),
    "users": ("led_users", "id, name, email:varchar, base_currency, default_region, created_at:timestamp"),
    "categories": ("led_categories", "id, name, direction, statutory, region:varchar, is_system:boolean, user_id:bigint"),
    "budgets": ("led_budgets", "id:bigint, user_id, category_id, year, month, limit_amount, currency"),
    "fund_overrides": ("led_fund_overrides", "id:bigint, user_id, scope, period_start, amount, currency, "
                       "created_at:timestamp, updated_at:timestamp"),
    "salary_profiles": ("led_profiles", "id, user_id, label:varchar, region, currency, gross_amount, pay_period, tax_year, "
                        "net_amount:decimal(14,2), total_deductions:decimal(14,2), breakdown:varchar, is_active, "
                        "created_at:timestamp, updated_at"),
    "exchange_rates": ("(select * from led_fx_history where day(as_of) = 10) x",
                       "id:bigint, base_currency, quote_currency, rate, as_of"),
    "exchange_rate_history": ("led_fx_history", "id:bigint, base_currency, quote_currency, rate, as_of"),
}
for _name, (_view, _columns) in _TABLES.items():
    _listed = [c.strip().split(":") for c in re.split(r",\s*(?![^(]*\))", _columns)]
    _texts = [f'cast(null as {c[1]}) as "{c[0]}"' if len(c) > 1 else f'"{c[0]}"' for c in _listed]
    Q[f"s1_read_{_name}"] = f"select {', '.join(_texts)} from {_view}"

_SEEDS = """
  (1, 'Base salary', 'inbound', false, null), (2, 'Overtime', 'inbound', false, null),
  (3, 'Bonus', 'inbound', false, null), (4, 'Commission', 'inbound', false, null),
  (5, 'Allowances', 'inbound', false, null), (6, 'Reimbursements', 'inbound', false, null),
  (7, 'Dividends', 'inbound', false, null), (8, 'Interest', 'inbound', false, null),
  (9, 'Freelance income', 'inbound', false, null), (10, 'Other income', 'inbound', false, null),
  (11, 'Housing', 'outbound', false, null), (12, 'Utilities', 'outbound', false, null),
  (13, 'Groceries', 'outbound', false, null), (14, 'Dining', 'outbound', false, null),
  (15, 'Transport', 'outbound', false, null), (16, 'Healthcare', 'outbound', false, null),
  (17, 'Insurance', 'outbound', false, null), (18, 'Education', 'outbound', false, null),
  (19, 'Debt repayment', 'outbound', false, null),
  (20, 'Savings & investment', 'outbound', false, null),
  (21, 'Entertainment', 'outbound', false, null), (22, 'Shopping', 'outbound', false, null),
  (23, 'Subscriptions', 'outbound', false, null), (24, 'Travel', 'outbound', false, null),
  (25, 'Family & dependents', 'outbound', false, null), (26, 'Charity', 'outbound', false, null),
  (27, 'Miscellaneous', 'outbound', false, null),
  (28, 'Income tax (PH)', 'outbound', true, 'PH'), (29, 'SSS (PH)', 'outbound', true, 'PH'),
  (30, 'PhilHealth (PH)', 'outbound', true, 'PH'), (31, 'Pag-IBIG (PH)', 'outbound', true, 'PH'),
  (32, 'Federal income tax (US)', 'outbound', true, 'US'),
  (33, 'Social Security (US)', 'outbound', true, 'US'), (34, 'Medicare (US)', 'outbound', true, 'US'),
  (35, 'Income tax (AU)', 'outbound', true, 'AU'), (36, 'Medicare levy (AU)', 'outbound', true, 'AU'),
  (37, 'Income tax (EU)', 'outbound', true, 'EU'), (38, 'Pension insurance (EU)', 'outbound', true, 'EU'),
  (39, 'Health insurance (EU)', 'outbound', true, 'EU'),
  (40, 'Unemployment insurance (EU)', 'outbound', true, 'EU'),
  (41, 'Long-term care insurance (EU)', 'outbound', true, 'EU')"""
Q["s2_seed_reference"] = f"""with existing as (
  select id, case id when 0 then 'Base salary' when 6 then 'Groceries' else name end as name,
    direction, statutory, cast(null as varchar) region, false is_system, cast(null as bigint) user_id
  from led_categories),
seeds as (select * from (values {_SEEDS}) t(pos, name, direction, statutory, region))
select * from existing
union all
select cast((select max(id) from existing) + row_number() over (order by pos) as int), name, direction, statutory, region, true, null
from seeds s where not exists (
  select 1 from existing e where e.name = s.name and e.direction = s.direction)"""

Q["s2_seed_jurisdictions"] = Q["s1_read_jurisdictions"] = """with held as (
  select min(id) id, default_region region, 'Own' as name, max(base_currency) currency, 'own' modelled_as,
    false supported from led_users where default_region not in ('AU', 'EU') group by default_region)
select * from held
union all select (select max(id) from held) + n, region, name, currency, modelled_as, true
from (values (1, 'AU', 'Australia', 'AUD', 'Australia (national)'),
  (2, 'EU', 'European Union', 'EUR', 'Germany (EU representative)')) t(n, region, name, currency, modelled_as)"""
Q["s2_seed_rates"] = """with held as (
  select base_currency, quote_currency, max_by(rate, as_of) rate, max(as_of) as_of,
    cast(ascii(quote_currency) as bigint) id
  from led_fx_history where quote_currency <> 'AUD' group by 1, 2),
seeds as (select * from (values ('USD', 'AUD', 1.52), ('USD', 'EUR', 0.92), ('USD', 'PHP', 58.00)) t(b, q, r))
select * from held
union all
select b, q, cast(r as decimal(18,8)), date '1998-06-15',
  (select max(id) from held) + row_number() over (order by q)
from seeds where not exists (select 1 from held h where h.base_currency = b and h.quote_currency = q)"""

Q["s3_ingest_fx_payload"] = """select base_currency, quote_currency, as_of, rate from led_fx_history
union all select 'AUD', 'PHP', date '2024-02-03', cast(3 as decimal(18,8))
from (select distinct base_currency, date_trunc('month', as_of) from led_fx_history) x"""

Q["s4_export_expenses"] = f"""select cast(t.user_id as varchar) user_id, cast(t.occurred_on as varchar) "date",
  coalesce(c.name, 'Uncategorized') category, t.direction, cast(t.amount as varchar) amount,
  t.currency, coalesce(t.region, '') region,
  case t.id % 7 when 2 then '  padded  ' when 3 then 'say "hi", now' when 4 then 'two' || chr(10) || 'lines'
    when 5 then 'a' || chr(92) when 6 then chr(92) || '"x"' else '' end description, cast(t.amt as varchar) "amount_USD"
from conv t left join led_categories c on c.id = t.category_id where t.direction = 'outbound'"""

Q["s5_export_fx_history"] = """select cast(as_of as varchar) "date", base_currency, quote_currency,
  cast(cast(rate as decimal(18,6)) as varchar) rate from led_fx_history where base_currency = 'USD'"""

Q["s6_table_counts"] = union_all(
    [
        f"select '{name}' as table_name, count(*) as \"rows\" from {view}"
        for name, view in {
            "users": "led_users",
            "transactions": "led_transactions",
            "categories": "led_categories",
            "budgets": "led_budgets",
            "fund_overrides": "led_fund_overrides",
            "salary_profiles": "led_profiles",
            "exchange_rates": "(values ('PHP'), ('AUD'), ('EUR')) x",
            "exchange_rate_history": "led_fx_history",
            "jurisdictions": "(values ('PH'), ('US'), ('AU'), ('EU')) x",
        }.items()
    ]
)

Q["f1_filter_tx"] = """select id, user_id, amount, region, occurred_on from led_transactions
where occurred_on between date '1998-01-01' and date '1998-06-30' and region = 'US'"""

Q["f2_filter_direction"] = (
    "select id, user_id, direction, amount from led_timed where direction = 'outbound'"
)

Q["f3_list_transactions"] = """select * from (
  select user_id, id, occurred_on, occurred_time, cast(row_number() over (partition by user_id
    order by occurred_on desc, occurred_time desc nulls last, id desc) as int) as position from led_timed)
where position <= 10"""

Q["f4_list_categories"] = """select id, name, direction, statutory from led_categories
where direction = 'outbound' and not statutory order by direction, name"""

Q["f5_resolve_currency"] = """with asked as (
  select t.id, t.region, coalesce(u.base_currency, 'USD') base,
    case t.id % 3 when 0 then lower(t.currency) when 1 then '' end given
  from led_timed t left join led_users u on u.id = t.user_id)
select id, coalesce(upper(nullif(given, '')),
    case region when 'PH' then 'PHP' when 'US' then 'USD' when 'AU' then 'AUD' when 'EU' then 'EUR' end,
    base) write_currency,
  upper(coalesce(nullif(given, ''), base)) read_currency
from asked"""

_MONTH = "cast(date_trunc('month', anchor) as date)"
_YEAR = "cast(date_trunc('year', anchor) as date)"


def _back(months: int) -> str:
    return f"cast({_MONTH} - interval {months} month as date)"


_RANGE_START = f"case range_name when 'this_month' then {_MONTH} when 'last_3m' then {_back(2)} when 'ytd' then {_YEAR} end"
_RANGE_END = "case range_name when 'this_month' then last_day(anchor) when 'last_3m' then last_day(anchor) when 'ytd' then anchor end"
_SCOPE_START = f"case scope when 'month' then {_MONTH} when '3m' then {_back(2)} when 'ytd' then {_YEAR} end"

Q["f6_time_range_bounds"] = (
    f"select anchor, range_name, {_RANGE_START} start_on, {_RANGE_END} end_on from days, ranges"
)
Q["f7_previous_range_bounds"] = f"""with b as (
  select anchor, range_name, {_RANGE_START} s, {_RANGE_END} e from days, ranges)
select anchor, range_name, cast(s - 1 - cast(e - s as int) as date) start_on,
  cast(s - 1 as date) end_on from b"""

Q["f8_period_bounds"] = """with span as (
  select user_id, min(make_date(year, month, 1)) lo, max(make_date(year, month, 1)) hi,
    count(distinct year * 12 + month) n from led_budgets group by user_id)
select id user_id, 'month' as scope, date '1998-06-01' period_start, date '1998-07-01' period_end, 1 month_count from led_users
union all select id, '3m', date '1998-04-01', date '1998-07-01', 3 from led_users
union all select id, 'ytd', date '1998-01-01', date '1998-07-01', 6 from led_users
union all select u.id, 'all', coalesce(lo, date '1998-06-01'),
  coalesce(cast(hi + interval 1 month as date), date '1998-07-01'), cast(coalesce(n, 0) as int)
from led_users u left join span s on s.user_id = u.id"""

Q["f9_previous_period_end"] = (
    f"select anchor, scope, cast({_SCOPE_START} - 1 as date) previous_end from days, scopes"
)
Q["f10_months_for_range"] = """select anchor, range_name, cast(case range_name when 'this_month' then 6
  when 'last_3m' then 3 when 'ytd' then month(anchor) else 36 end as int) as months from days, ranges"""
Q["f11_fx_range_bounds"] = """with asked as (
  select anchor, case day(anchor) % 3 when 1 then anchor - 1000 when 2 then anchor - 30 end s from days)
select anchor, cast(case when s is null then anchor - 6 when anchor - s > 365 then anchor - 365
  else s end as date) start_on, anchor end_on from asked"""
Q["f11_fx_preset_bounds"] = f"""select anchor, range_name,
  case when range_name = 'all' then cast(anchor - 365 as date) else {_RANGE_START} end start_on,
  case when range_name = 'all' then anchor else {_RANGE_END} end end_on from days, ranges"""
Q["f13_fund_period_start"] = f"""select anchor, scope,
  case when scope = 'all' then date '1970-01-01' else {_SCOPE_START} end fund_start from days, scopes"""

Q["j1_with_category_name"] = """select x.ledger, x.id, coalesce(c.name, 'Uncategorized') category_name
from (select 'main' ledger, id, category_id from led_transactions
      union all select 'timed', id, category_id from led_timed) x
left join led_categories c on c.id = x.category_id"""

_UP16 = "cast(cast({} as decimal(22,0)) * cast('0.0000000000000001' as decimal(16,16)) as decimal(22,16))"
_INVERSE = _UP16.format("(cast(1000000000000000000000000 as hugeint) + r8 - 1) // r8")
_CROSS = _UP16.format("(y.r8 * cast(10000000000000000 as hugeint) + x.r8 - 1) // x.r8")
Q["j2_rate_matrix"] = f"""with newest as (
  select quote_currency c, max_by(rate, as_of) rate,
    cast(max_by(rate, as_of) * 100000000 as hugeint) r8 from led_fx_history group by quote_currency)
select 'USD' base_currency, 'USD' quote_currency, cast(1 as decimal(22,16)) rate
union all select c, c, cast(1 as decimal(22,16)) from newest
union all select 'USD', c, cast(rate as decimal(22,16)) from newest
union all select c, 'USD', {_INVERSE} from newest
union all select x.c, y.c, {_CROSS} from newest x, newest y where x.c <> y.c"""

Q["j3_convert"] = f"""with asked as (
  select *, case id % 4 when 0 then 'USD' when 1 then 'PHP' when 2 then 'AUD' else 'EUR' end target
  from led_transactions)
select t.id, t.amount, t.currency, t.target, {money('t.amount * m.r')} converted
from asked t join matrix m on m.b = t.currency and m.q = t.target"""

# (start, exclusive end) of each dated scope at 1998-06-15.
_PERIODS = {
    "month": ("1998-06-01", "1998-07-01"),
    "3m": ("1998-04-01", "1998-07-01"),
    "ytd": ("1998-01-01", "1998-07-01"),
}


def _status_ctes(scope: str) -> str:
    if scope == "all":
        rows = """select b.*, s.lo, s.hi from led_budgets b join (
    select user_id, min(make_date(year, month, 1)) lo,
      cast(max(make_date(year, month, 1)) + interval 1 month as date) hi
    from led_budgets group by user_id) s using (user_id)"""
    else:
        lo, hi = _PERIODS[scope]
        rows = f"""select *, date '{lo}' lo, date '{hi}' hi from led_budgets
    where make_date(year, month, 1) >= date '{lo}' and make_date(year, month, 1) < date '{hi}'"""
    return f"""brow as ({rows}),
target as (select user_id, category_id, max_by(currency, year * 12 + month) cur,
    min(lo) lo, min(hi) hi from brow group by user_id, category_id),
lim as (select b.user_id, b.category_id, {money_sum(money('b.limit_amount * m.r'))} lim
  from brow b join target t on t.user_id = b.user_id and t.category_id = b.category_id
  join matrix m on m.b = b.currency and m.q = t.cur group by b.user_id, b.category_id),
spend as (select x.user_id, x.category_id, {money_sum(money('x.amount * m.r'))} spent
  from led_transactions x join target t on t.user_id = x.user_id and t.category_id = x.category_id
  join matrix m on m.b = x.currency and m.q = t.cur
  where x.direction = 'outbound' and x.occurred_on >= t.lo and x.occurred_on < t.hi
  group by x.user_id, x.category_id),
status as (select t.user_id, t.category_id, coalesce(c.name, 'Unknown') category_name, t.cur currency,
    t.lo period_start, cast(t.hi - 1 as date) period_end, l.lim limit_amount,
    cast(coalesce(s.spent, 0) as decimal(18,2)) spent
  from target t join lim l on l.user_id = t.user_id and l.category_id = t.category_id
  left join spend s on s.user_id = t.user_id and s.category_id = t.category_id
  left join led_categories c on c.id = t.category_id),
rated as (select *, {ratio('spent', 'limit_amount')} utilization from status)"""


def _status(scope: str) -> str:
    year, month = ("1998", "6") if scope == "month" else ("cast(null as int)", "cast(null as int)")
    return f"""with {_status_ctes(scope)}
select user_id, category_id, category_name, {year} as year, {month} as month, '{scope}' as scope, period_start,
  period_end, limit_amount, spent, cast(limit_amount - spent as decimal(18,2)) remaining, utilization,
  currency, spent > limit_amount over_budget from rated"""


Q["j3_split_convertible"] = """select id, case when id % 9 = 0 then 'JPY' else currency end currency,
  id % 9 <> 0 or id % 27 = 0 usable from led_transactions"""
Q["j4_budget_spend"] = f"with {_status_ctes('ytd')}\nselect user_id, category_id, spent from spend"


def _before(end: str) -> str:
    return money_sum(
        f"case when occurred_on > date '{end}' then 0 when direction = 'inbound' then amt else -amt end"
    )


_NEXT = f"cast({_MONTH} + interval 1 month as date)"
# Requests of every user: two scopes, each at an anchor of its own.
_REQUESTS = f"""asked as (
  select id user_id, ['month','3m','ytd','all'][(id + k) % 4 + 1] as scope,
    cast(date '1998-06-15' + to_months(cast(id * (k + 1) % 36 - 24 as int)) as date) anchor
  from led_users, unnest([0, 1]) t(k)),
span as (select user_id, min(make_date(year, month, 1)) lo,
    cast(max(make_date(year, month, 1)) + interval 1 month as date) hi,
    count(distinct year * 12 + month) n from led_budgets group by user_id),
period as (select a.*, {_MONTH} anchor_month,
    case when scope = 'all' then coalesce(s.lo, {_MONTH}) else {_SCOPE_START} end lo,
    case when scope = 'all' then coalesce(s.hi, {_NEXT}) else {_NEXT} end hi,
    cast(case scope when 'month' then 1 when '3m' then 3 when 'ytd' then month(anchor)
      else coalesce(n, 0) end as int) month_count
  from asked a left join span s using (user_id))"""
_STATUS_OF = f"""brow as (select b.*, p.scope, p.anchor, p.anchor_month, p.lo, p.hi
  from led_budgets b join period p on p.user_id = b.user_id
    and make_date(b.year, b.month, 1) >= p.lo and make_date(b.year, b.month, 1) < p.hi),
target as (select user_id, scope, anchor, anchor_month, category_id,
    max_by(currency, year * 12 + month) cur, min(lo) lo, min(hi) hi from brow group by all),
lim as (select b.user_id, b.scope, b.anchor, b.category_id, {money_sum(money('b.limit_amount * m.r'))} lim
  from brow b join target t using (user_id, scope, anchor, category_id)
  join matrix m on m.b = b.currency and m.q = t.cur group by all),
spend as (select t.user_id, t.scope, t.anchor, t.anchor_month, t.category_id,
    {money_sum(money('x.amount * m.r'))} spent
  from led_transactions x join target t on t.user_id = x.user_id and t.category_id = x.category_id
  join matrix m on m.b = x.currency and m.q = t.cur
  where x.direction = 'outbound' and x.occurred_on >= t.lo and x.occurred_on < t.hi
  group by all),
status as (select t.user_id, t.scope, t.anchor, t.category_id, coalesce(c.name, 'Unknown') category_name,
    t.cur currency, t.lo period_start, cast(t.hi - 1 as date) period_end, l.lim limit_amount,
    cast(coalesce(s.spent, 0) as decimal(18,2)) spent
  from target t join lim l using (user_id, scope, anchor, category_id)
  left join spend s using (user_id, scope, anchor, category_id)
  left join led_categories c on c.id = t.category_id),
rated as (select *, {ratio('spent', 'limit_amount')} utilization from status)"""
_STATUS_COLUMNS = """user_id, category_id, category_name, anchor,
  cast(case when scope = 'month' then year(anchor) end as int) as year,
  cast(case when scope = 'month' then month(anchor) end as int) as month, scope, period_start,
  period_end, limit_amount, spent, cast(limit_amount - spent as decimal(18,2)) remaining, utilization,
  currency, spent > limit_amount over_budget"""
Q["a8_budget_status_requests"] = f"""with {_REQUESTS},
{_STATUS_OF}
select {_STATUS_COLUMNS} from rated"""
Q["f8_period_requests"] = f"""with {_REQUESTS}
select distinct user_id, scope, anchor_month, lo period_start, hi period_end, month_count from period"""
Q["j4_budget_spend_requests"] = f"""with {_REQUESTS},
{_STATUS_OF}
select distinct user_id, category_id, scope, anchor_month, spent from spend"""
Q["a8_budget_status_scopes"] = union_all([f"({_status(s)})" for s in ("month", "3m", "ytd", "all")])
Q["a10_budget_kpis_scopes"] = f"""with every as ({Q["a8_budget_status_scopes"]})
select scope, user_id, currency, count(*) filter (not over_budget and utilization < 0.8) on_track,
  count(*) filter (not over_budget and utilization >= 0.8) at_risk,
  count(*) filter (over_budget) over_count,
  {money_sum('case when over_budget then spent - limit_amount end')} over_amount from every group by all"""
_HELD = f"""held as (select p.user_id, p.scope, p.anchor,
    {money_sum("case when c.direction = 'inbound' then c.amt else -c.amt end")} amount
  from period p join convb c on c.user_id = p.user_id
  where p.scope <> 'all' and c.occurred_on < p.lo group by all)"""
Q["w6_carry_over_requests"] = f"""with {_REQUESTS},
{_HELD}
select distinct p.user_id, p.scope, p.anchor, cast(coalesce(h.amount, 0) as decimal(18,2)) amount
from period p left join held h using (user_id, scope, anchor)"""
_FUNDS = f"""{_HELD},
fund as (select distinct p.user_id, p.scope, p.anchor,
    case when p.scope = 'all' then date '1970-01-01' else p.lo end period_start,
    cast((case when p.scope = 'all' then p.hi else {_NEXT} end) - 1 as date) period_end,
    cast(coalesce(o.amount, h.amount, 0) as decimal(18,2)) amount,
    coalesce(o.currency, u.base_currency) currency, o.amount is not null is_override
  from period p join led_users u on u.id = p.user_id
  left join held h using (user_id, scope, anchor)
  left join led_fund_overrides o on o.user_id = p.user_id and o.scope = p.scope
    and o.period_start = case when p.scope = 'all' then date '1970-01-01' else p.lo end)"""
Q["j6_fund_status_requests"] = f"with {_REQUESTS},\n{_FUNDS}\nselect * from fund"
Q["w7_balance_with_fund_requests"] = f"""with {_REQUESTS},
{_FUNDS},
daily as (select user_id, occurred_on, {NET} net from convb group by all),
run as (select p.user_id, p.scope, p.anchor, d.occurred_on, d.net,
    cast(sum(d.net) over (partition by p.user_id, p.scope, p.anchor order by d.occurred_on)
      as decimal(18,2)) balance
  from (select distinct user_id, scope, anchor, lo, hi from period) p
  join daily d on d.user_id = p.user_id
  where p.scope = 'all' or (d.occurred_on >= p.lo and d.occurred_on < p.hi))
select r.*, f.amount fund, cast(r.balance + f.amount as decimal(18,2)) balance_with_fund
from run r join fund f using (user_id, scope, anchor)"""

Q["j6_fund_status"] = f"""with held as (
  select user_id, {_before('1998-05-31')} m, {_before('1998-03-31')} q, {_before('1997-12-31')} y
  from convb group by user_id),
span as (select user_id, cast(max(make_date(year, month, 1)) + interval 1 month - interval 1 day as date) hi
  from led_budgets group by user_id),
base as (select u.id user_id, u.base_currency, s.scope,
    case s.scope when 'month' then date '1998-06-01' when '3m' then date '1998-04-01'
      when 'ytd' then date '1998-01-01' else date '1970-01-01' end period_start,
    case when s.scope = 'all' then coalesce(p.hi, date '1998-06-30') else date '1998-06-30' end period_end,
    coalesce(case s.scope when 'month' then h.m when '3m' then h.q when 'ytd' then h.y end, 0) held
  from led_users u cross join scopes s left join held h on h.user_id = u.id
  left join span p on p.user_id = u.id)
select b.user_id, b.scope, b.period_start, b.period_end,
  cast(coalesce(o.amount, b.held) as decimal(18,2)) amount,
  coalesce(o.currency, b.base_currency) currency, o.amount is not null is_override
from base b left join led_fund_overrides o
  on o.user_id = b.user_id and o.scope = b.scope and o.period_start = b.period_start"""


def _spent_between(start: str, end: str) -> str:
    return f"""select t.user_id, t.category_id, coalesce(c.name, 'Uncategorized') category_name, t.total
  from (select user_id, category_id, min_by(direction, id) direction, {money_sum('amt')} total from conv
    where occurred_on between date '{start}' and date '{end}' group by user_id, category_id) t
  left join led_categories c on c.id = t.category_id where t.direction = 'outbound'"""


Q["j7_prior_period_delta"] = f"""with now as ({_spent_between('1998-04-01', '1998-06-30')}),
before as ({_spent_between('1997-12-31', '1998-03-31')})
select n.user_id, n.category_id, n.category_name, n.total, b.total previous_total,
  case when b.total > 0 then (cast(n.total as double) - cast(b.total as double)) / cast(b.total as double) end change
from now n left join before b on b.user_id = n.user_id and b.category_name = n.category_name"""

Q["j8_direction_mismatch"] = """with rows_in as (
  select id, category_id,
    case when id % 89 = 0 then case direction when 'inbound' then 'outbound' else 'inbound' end
      else direction end direction,
    case when id % 83 = 0 then -amount else amount end amount from led_transactions)
select * from (
  select t.id, case when t.amount <= 0 then 'amount must be positive'
    when c.id is null then 'category not found'
    when c.direction <> t.direction then 'direction mismatch' end reason
  from rows_in t left join led_categories c on c.id = t.category_id)
where reason is not null"""

Q["j9_budget_target_check"] = """with rows_in as (
  select user_id, case when user_id % 7 = 0 then 0 else category_id end category_id, year,
    case when user_id % 7 = 1 then 13 else month end as month,
    case when user_id % 7 = 2 then cast(0 as decimal(14,2)) else limit_amount end limit_amount from led_budgets)
select * from (
  select b.*, case when b.limit_amount <= 0 then 'limit must be positive'
    when b.month not between 1 and 12 then 'month out of range'
    when c.id is null or c.direction <> 'outbound' then 'not an expense category' end reason
  from rows_in b left join led_categories c on c.id = b.category_id)
where reason is not null"""

Q["a1_totals"] = f"""select user_id, {INCOME} total_income, {EXPENSE} total_expense, {NET} net_cashflow
from conv group by user_id"""

Q["a2_per_category_totals"] = "select * from category_totals"

_RANKED = """select *, cast(row_number() over (partition by user_id order by total desc, category_id) as int) as rank
from category_totals where direction = 'outbound'"""
Q["a3_top_expense_categories"] = f"select * from ({_RANKED}) where rank <= 3"

Q["a4_monthly_totals"] = f"""select user_id, month, income, expense, net from (
  select *, row_number() over (partition by user_id order by month desc) rn from (
    select user_id, strftime(occurred_on, '%Y-%m') as month, {INCOME} income, {EXPENSE} expense, {NET} net
    from conv group by 1, 2))
where rn <= 6"""


def _grid(months: int) -> str:
    return f"""spent as (
  select user_id, category_id, strftime(occurred_on, '%Y-%m') as month, {money_sum('amt')} as value
  from conv where direction = 'outbound' group by 1, 2, 3),
aged as (select *, dense_rank() over (partition by user_id order by month desc) age from spent),
kept as (select * from aged where age <= {months}),
grid as (
  select m.user_id, k.category_id, coalesce(c.name, 'Uncategorized') category_name, m.month,
    cast(coalesce(s.value, 0) as decimal(18,2)) as value
  from (select distinct user_id, month from kept) m
  join (select distinct user_id, category_id from kept) k on k.user_id = m.user_id
  left join kept s on s.user_id = m.user_id and s.category_id = k.category_id and s.month = m.month
  left join led_categories c on c.id = k.category_id)"""


Q["a5_monthly_expense_by_category"] = f"with {_grid(6)}\nselect * from grid"

Q["a5_monthly_series"] = f"""with {_grid(6)}
select user_id, category_id, category_name, string_agg(month, ',' order by month) "months",
  string_agg(cast(value as varchar), ',' order by month) "values" from grid group by 1, 2, 3"""

Q["a6_top5_plus_other"] = f"""with {_grid(36)},
ranked as (select user_id, category_id, row_number() over (
    partition by user_id order by sum(value) desc, category_id) rk from grid group by user_id, category_id)
select g.user_id, case when r.rk <= 5 then g.category_id end category_id,
  case when r.rk <= 5 then g.category_name else 'Other' end as label, g.month, {money_sum('g.value')} as value
from grid g join ranked r on r.user_id = g.user_id and r.category_id = g.category_id
group by 1, 2, 3, 4"""

Q["a7_daily_totals"] = f"""select user_id, occurred_on, {INCOME} income, {EXPENSE} expense, {NET} net
from convt group by user_id, occurred_on"""

for _scope in ("month", "3m", "ytd", "all"):
    Q[f"a8_budget_status_{_scope}"] = _status(_scope)

Q["a10_budget_kpis"] = f"""with {_status_ctes('ytd')}
select user_id, currency, count(*) filter (spent <= limit_amount and utilization < 0.8) on_track,
  count(*) filter (spent <= limit_amount and utilization >= 0.8) at_risk,
  count(*) filter (spent > limit_amount) over_count,
  {money_sum('case when spent > limit_amount then spent - limit_amount end')} over_amount
from rated group by user_id, currency"""

# Days passed and days of each period on 15 June 1998.
for _name, _scope, _passed, _days in (
    ("a11_budget_projection", "3m", 76, 91),
    ("a11_budget_projection_month", "month", 15, 30),
    ("a11_budget_projection_ytd", "ytd", 166, 181),
):
    _pace = f"cast(spent as double) / {_passed}.0::double * {_days}.0::double"
    Q[_name] = f"""with {_status_ctes(_scope)},
sums as (select user_id, currency, {money_sum('spent')} spent, {money_sum('limit_amount')} limit_amount
  from rated group by user_id, currency)
select *, cast({_passed} as int) elapsed_days, cast({_days} as int) total_days, {_pace} projected,
  {_pace} > cast(limit_amount as double) flagged
from sums"""

Q["a11_budget_projection_scopes"] = union_all(
    [
        f"select '{scope}' as scope, * from ({Q[name]}) x"
        for name, scope in (
            ("a11_budget_projection", "3m"),
            ("a11_budget_projection_month", "month"),
            ("a11_budget_projection_ytd", "ytd"),
        )
    ]
)

_TOTALS = f"select user_id, {INCOME} ti, {EXPENSE} te from conv group by user_id"
Q["a12_savings_rate"] = f"""with t as ({_TOTALS})
select user_id, {ratio('(ti - te)', 'ti')} savings_rate from t"""


def _summary(source: str, where: str, currency: str) -> str:
    """Users with totals and salary figures in the display currency."""
    return f"""tot as (select user_id, {INCOME} ti, {EXPENSE} te from {source} {where} group by user_id),
cats as (select t.user_id, t.category_id, coalesce(c.name, 'Uncategorized') category_name, t.direction, t.total
  from (select user_id, category_id, min_by(direction, id) direction, {money_sum('amt')} total
        from {source} {where} group by user_id, category_id) t
  left join led_categories c on c.id = t.category_id),
people as (
  select u.id user_id, {currency} currency, cast(coalesce(t.ti, 0) as decimal(18,2)) total_income,
    cast(coalesce(t.te, 0) as decimal(18,2)) total_expense,
    {money('cast(a.net_period as decimal(14,2)) * m.r')} salary_net, a.effective_rate deduction_rate
  from led_users u left join tot t on t.user_id = u.id left join active a on a.user_id = u.id
  left join matrix m on m.b = a.currency and m.q = {currency}),
refs as (select *, case when salary_net <> 0 then salary_net else total_income end ref,
    cast(total_income - total_expense as decimal(18,2)) net_cashflow from people),
summary as (select *, {ratio('(ref - total_expense)', 'ref')} savings_rate from refs)"""


_YEAR98 = "where occurred_on between date '1998-01-01' and date '1998-12-31'"
_Q2 = "where occurred_on between date '1998-04-01' and date '1998-06-30'"
_SUMMARY_COLUMNS = """user_id, currency, total_income, total_expense, net_cashflow, salary_net"""

Q["a13_overview"] = f"""with {_summary('convb', _YEAR98, 'u.base_currency')}
select {_SUMMARY_COLUMNS}, deduction_rate, savings_rate from summary"""

Q["a13_overview_categories"] = f"""with {_summary('convb', _YEAR98, 'u.base_currency')}
select user_id, category_id, category_name, direction, total from cats"""

_INSIGHTS = f"""top as (select user_id, category_name top_name, total top_total from cats
  where direction = 'outbound' qualify row_number() over (partition by user_id order by total desc, category_id) = 1),
streams as (select user_id, count(*) n from cats where direction = 'inbound' and total > 0 group by user_id),
facts as (
  select s.*, t.top_name, t.top_total, coalesce(n.n, 0) streams,
    case when s.salary_net > 0 then s.salary_net else s.total_income end reference
  from summary s left join top t on t.user_id = s.user_id left join streams n on n.user_id = s.user_id),
measured as (select *, {ratio('(reference - total_expense)', 'reference', 2)} rate,
    {ratio('top_total', 'total_expense', 2)} share from facts),
pct as (select *, case when rate = 0 and reference < total_expense then '-0%'
    else concat(cast(cast(rate * 100 as bigint) as varchar), '%') end saved,
    concat(cast(cast(share * 100 as bigint) as varchar), '%') share_text from measured),
found as (
  select user_id, 1 rule, 'overspend' key, 'warning' severity, 'Spending exceeds income' title,
    concat('Expenses (', total_expense, ' ', currency, ') are above your reference income (', reference,
      ' ', currency, ') for this period.') detail from pct where reference > 0 and rate < 0
  union all select user_id, 2, 'low_savings', 'warning', 'Savings rate below 20%',
    concat('Saving ', saved, ' of income. A common target is 20%+.')
    from pct where reference > 0 and rate >= 0 and rate < 0.20
  union all select user_id, 3, 'healthy_savings', 'good', 'Healthy savings rate',
    concat('Saving ', saved, ' of your reference income this period.')
    from pct where reference > 0 and rate >= 0.20
  union all select user_id, 4, 'concentrated_spend', 'info', concat(top_name, ' dominates spending'),
    concat(share_text, ' of expenses went to ', top_name, ' (', top_total, ' ', currency, ').')
    from pct where top_total is not null and total_expense > 0 and share >= 0.40
  union all select user_id, 5, 'diversified_spend', 'good', 'Spending is well spread out',
    'No single category ate more than a quarter of your outgoings — a balanced loaf, not a lopsided one.'
    from pct where top_total is not null and total_expense > 0 and share < 0.25
  union all select user_id, 6, 'multiple_income_streams', 'info', 'Multiple slices of income',
    concat('You''re not living off one loaf — ', streams, ' income streams contributed this period.')
    from pct where streams > 1
  union all select user_id, 7, 'no_expenses_yet', 'info', 'Nothing spent yet',
    'No debits recorded this period — the crust is still intact.'
    from pct where total_expense = 0 and total_income > 0),
listed as (
  select * from found
  union all select user_id, 8, 'no_signal', 'info', 'Not enough data yet',
    'Add salary and a few transactions to unlock personalized insights.'
  from pct where user_id not in (select user_id from found))"""

Q["a14_dashboard_summary"] = f"""with {_summary('convb', _Q2, 'u.base_currency')},
{_INSIGHTS},
keys as (select user_id, string_agg(key, ',' order by rule) insights from listed group by user_id),
tops as (select user_id, string_agg(concat(category_id, ':', total), ',' order by total desc, category_id) top_categories,
    count(*) top_count
  from (select * from cats where direction = 'outbound'
    qualify row_number() over (partition by user_id order by total desc, category_id) <= 5)
  group by user_id)
select {_SUMMARY_COLUMNS}, savings_rate, insights, coalesce(top_categories, '') top_categories,
  cast(coalesce(top_count, 0) as int) top_count
from summary left join keys using (user_id) left join tops using (user_id)"""

_PER_DAY = "cast(te as double) / 166.0::double"
Q["a15_burn_rate"] = f"""with t as (
  select user_id, {EXPENSE} te from conv where occurred_on between date '1998-01-01' and date '1998-06-15'
  group by user_id)
select user_id, te total_expense, {_PER_DAY} / 24.0::double per_hour, {_PER_DAY} per_day,
  {_PER_DAY} * 7.0::double per_week, {_PER_DAY} * 30.44::double per_month from t"""

Q["a16_statutory_split"] = f"""select t.user_id, coalesce(c.statutory, false) statutory, {money_sum('t.total')} total
from category_totals t left join led_categories c on c.id = t.category_id
where t.direction = 'outbound' group by 1, 2"""

Q["a17_distinct_budget_months"] = "select distinct user_id, year, month from led_budgets"

_DAILY = f"""daily as (select user_id, occurred_on, {INCOME} income, {EXPENSE} expense, {NET} net
  from conv {{}} group by user_id, occurred_on)"""
_RUNNING = "cast(sum(net) over (partition by user_id order by occurred_on) as decimal(18,2))"
Q["w1_running_balance"] = f"with {_DAILY.format('')}\nselect *, {_RUNNING} balance from daily"

_SIGNED = "case when direction = 'inbound' then amt else -amt end"
_LEDGER_ORDER = "occurred_on, coalesce(occurred_time, '00:00:00'), id"
_BALANCE = f"""cast(sum({_SIGNED}) over (partition by user_id order by {_LEDGER_ORDER}
  rows unbounded preceding) as decimal(18,2))"""
Q["w2_running_balance_by_transaction"] = f"select id, user_id, {_BALANCE} balance from convt"

Q["w3_expense_deltas"] = """with recent as (
  select *, row_number() over (partition by user_id
    order by occurred_on desc, coalesce(occurred_time, '00:00') desc, id desc) rn
  from led_timed where direction = 'outbound' qualify rn <= 20)
select user_id, id, amount,
  cast(amount - lag(amount) over (partition by user_id order by rn desc) as decimal(18,2)) delta from recent"""

_MOVES = """select base_currency, quote_currency, as_of, rate,
  lag(rate) over (partition by base_currency, quote_currency order by as_of) previous_rate
from led_fx_history"""
_MOVED = f"""select *, cast(rate - previous_rate as decimal(19,8)) move,
  case when previous_rate <> 0 then cast(rate - previous_rate as double) / cast(previous_rate as double) * 100.0::double
    when previous_rate = 0 then 0.0::double end move_percent from ({_MOVES})"""
Q["w4_fx_day_move"] = _MOVED
Q["w4_fx_latest_move"] = f"""select * from ({_MOVED})
qualify row_number() over (partition by base_currency, quote_currency order by as_of desc) = 1"""

Q["w5_active_salary"] = """select * from led_profiles where is_active
qualify row_number() over (partition by user_id order by updated_at desc, id desc) = 1"""

Q["w6_carry_over_fund"] = f"""with held as (
  select user_id, {_before('1998-03-31')} q, {_before('1997-12-31')} y from convb group by user_id)
select u.id user_id, '3m' as scope, cast(coalesce(h.q, 0) as decimal(18,2)) amount
from led_users u left join held h on h.user_id = u.id
union all
select u.id, 'ytd', cast(coalesce(h.y, 0) as decimal(18,2))
from led_users u left join held h on h.user_id = u.id"""

Q["w7_balance_with_fund"] = f"""with {_DAILY.format("where occurred_on between date '1998-01-01' and date '1998-06-30'")},
run as (select user_id, occurred_on, net, {_RUNNING} balance from daily),
held as (select user_id, {_before('1997-12-31')} y from conv group by user_id),
fund as (select u.id user_id, coalesce(o.amount, h.y, 0) fund from led_users u
  left join held h on h.user_id = u.id
  left join led_fund_overrides o on o.user_id = u.id and o.scope = 'ytd' and o.period_start = date '1998-01-01')
select r.*, cast(r.balance + coalesce(f.fund, 0) as decimal(18,2)) balance_with_fund
from run r left join fund f on f.user_id = r.user_id"""

_PERIOD_FLOW = f"case when occurred_on between date '1998-04-01' and date '1998-06-30' then {_SIGNED} end"
Q["w8_last_balance"] = f"""with b as (
  select user_id, {money_sum(_SIGNED)} g, {money_sum(_PERIOD_FLOW)} p from conv group by user_id)
select u.id user_id, cast(coalesce(g, 0) as decimal(18,2)) global_balance,
  cast(coalesce(p, 0) as decimal(18,2)) period_balance
from led_users u left join b on b.user_id = u.id"""

Q["w9_ledger_view"] = f"""with balances as (select *, {_BALANCE} balance from convt),
listed as (select *, cast(row_number() over (partition by user_id
    order by occurred_on desc, occurred_time desc nulls last, id desc) as int) as position
  from balances where occurred_on >= date '2024-01-08')
select l.user_id, l.position, l.id, coalesce(c.name, 'Uncategorized') category_name, l.amt, l.balance
from listed l left join led_categories c on c.id = l.category_id where l.position <= 25"""

Q["x1_money"] = f"""select id, {money('amount * 0.335')} as value, {money('-amount * 0.335')} negated
from led_transactions"""
Q["x2_month_key"] = "select strftime(occurred_on, '%Y-%m') as month, count(*) n from led_transactions group by 1"
_SHIFT = "(year(anchor) * 12 + month(anchor) - 1 + {})"
Q["x3_add_months"] = "select anchor, " + ", ".join(
    f"cast({_SHIFT.format(step)} // 12 as int) {name}_year, "
    f"cast({_SHIFT.format(step)} % 12 + 1 as int) {name}_month"
    for name, step in (("back", "-14"), ("ahead", "day(anchor)"))
) + " from days"

_SHARES = f"""with t as ({_TOTALS}),
s as (select c.user_id, c.category_id, c.total, t.te from category_totals c join t on t.user_id = c.user_id
  where c.direction = 'outbound')"""
Q["x4_ratio"] = f"""{_SHARES}
select user_id, category_id, {ratio('total', 'te', 4)} share4, {ratio('total', 'te', 2)} share2 from s"""
Q["x5_percent_text"] = f"""{_SHARES}
select user_id, category_id, concat(cast(cast({ratio('total', 'te', 2)} * 100 as bigint) as varchar), '%') share
from s"""
# Half a cent's worth per cent: odd cents are ties, which go to the even neighbour.
_CENTS = "cast(amount * 100 as bigint)"
Q["x9_amount_text"] = f"""select id, cast(amount as varchar) amount,
  cast(cast(({_CENTS} // 2 + case when {_CENTS} % 4 = 3 then 1 else 0 end) * cast(0.000001 as decimal(7,6))
    as decimal(24,6)) as varchar) rate from led_transactions"""
Q["x10_currency_code"] = "select id, upper(lower(currency)) currency from led_timed"

Q["p1_progressive_tax"] = f"""with p as (select id, gross_amount x from led_profiles)
select id, {money(brackets('x', [('1000', '0.10'), ('200000', '0.20')]))} tax from p"""
Q["p2_capped_contribution"] = f"""select id,
  {money('least(greatest(gross_amount, 48000), 360000) * 0.045')} contribution from led_profiles"""
Q["p3_annualize"] = "select id, cast(g as decimal(18,2)) gross_annual from gross"
for _key, _region in (("p4_ph", "PH"), ("p5_us", "US"), ("p6_au", "AU"), ("p7_eu", "EU")):
    Q[f"{_key}_rule"] = f"""select id, gross_annual, total_tax, total_social, total_deductions, net_annual
from pay where region = '{_region}'"""
Q["p8_breakdown"] = """select id, region, currency, tax_year, pay_period, gross_annual, total_tax,
  total_social, total_deductions, net_annual, gross_period, net_period, effective_rate from payp"""
Q["p9_payroll_run"] = """select id, case when id % 41 <> 0 then net_annual end net_annual,
  case when id % 41 = 0 then 'no rule for the region' end reason from pay"""
Q["p10_payroll_items"] = f"""select id profile_id, key, label, kind,
  cast(case when kind in ('tax', 'social') then -{per12('amount')} else {per12('amount')} end as decimal(18,2)) amount
from items where kind <> 'net'"""
Q["p11_payroll_register"] = """select region, kind, key, cast(sum(amount) as decimal(24,2)) total, count(*) n
from items group by region, kind, key"""
Q["p12_rule_registry"] = f"""with known as (
  select * from (values ('AU', 'AUD', 'Australia (national)'), ('EU', 'EUR', 'Germany (EU representative)'),
    ('PH', 'PHP', 'Philippines (national)'), ('US', 'USD', 'United States (federal)'),
    ('ZZ', 'USD', 'Flat tenth')) t(region, currency, modelled_as)),
paid as (select case when id % 41 = 0 then 'ZZ' else region end region,
  case when id % 41 = 0 then {money('gross_annual * 0.10')} else total_tax end tax from pay)
select k.region, k.currency, k.modelled_as, true supported, count(*) profiles,
  cast(sum(p.tax) as decimal(24,2)) total_tax
from known k join paid p on p.region = k.region group by 1, 2, 3"""
Q["p13_profile_snapshot"] = """select id, currency, tax_year, net_annual net_amount, total_deductions,
  cast(net_period as varchar) net_period_text from payp"""

Q["i1_insights"] = f"""with {_summary('conv', '', "'USD'")},
{_INSIGHTS}
select user_id, cast(row_number() over (partition by user_id order by rule) as int) as position,
  key, severity, title, detail from listed"""

# ------------------------------------------------------------------------- change batches

_TX = "id, user_id, direction, category_id, amount, currency, region"
_INSERTS = """ins as (
  select id * 10 seq, id + 1000000000 id, user_id,
    case when id % 303 = 0 then case direction when 'inbound' then 'outbound' else 'inbound' end
      else direction end direction, category_id,
    cast(case when id % 707 = 0 then -amount else amount end as decimal(14,2)) amount,
    case id % 3 when 0 then lower(currency) when 1 then '' end given,
    case when id % 3 = 2 then region end region
  from led_transactions where id % 101 = 0),
judged as (
  select i.*, case when i.amount <= 0 then 'amount must be positive'
    when c.id is null then 'category not found'
    when c.direction <> i.direction then 'direction mismatch' end reason, u.base_currency
  from ins i left join led_categories c on c.id = i.category_id left join led_users u on u.id = i.user_id),
accepted as (
  select id, user_id, direction, category_id, amount,
    coalesce(upper(nullif(given, '')), case region when 'PH' then 'PHP' when 'US' then 'USD'
      when 'AU' then 'AUD' when 'EU' then 'EUR' end, base_currency) currency, region
  from judged where reason is null)"""
# A patch of the amount (refused every 150th row: other user), then one of three more fields.
_PATCHED = """patched as (
  select id, user_id, direction, case when id % 100 = 0 then 9 else category_id end category_id,
    cast(case when id % 50 = 0 and id % 150 <> 0 then amount + 1 else amount end as decimal(14,2)) amount,
    case when id % 100 = 0 then 'EUR' else currency end currency, region,
    case when id % 100 = 0 then null when id % 50 = 0 and id % 150 <> 0 then '08:00:00'
      else occurred_time end occurred_time
  from led_transactions)"""

Q["u1_insert_transactions"] = f"""with {_INSERTS}
select {_TX}, cast(null as varchar) description from led_transactions
union all select {_TX}, 'new' from accepted"""
Q["u1_insert_rejects"] = f"with {_INSERTS}\nselect seq, id, reason from judged where reason is not null"
Q["u2_patch_transactions"] = f"with {_PATCHED}\nselect {_TX}, occurred_time from patched"
Q["u3_delete_transactions"] = f"""with {_INSERTS},
{_PATCHED}
select {_TX}, occurred_time from patched where id % 97 <> 0
union all select {_TX}, null from accepted"""
Q["u3_delete_rejects"] = """select id * 10 + 1 seq, 'patch' op, id, 'transaction not found' reason
from led_transactions where id % 150 = 0
union all select id * 10 + 4, 'delete', id, 'transaction not found' from led_transactions where id % 194 = 0"""

# The same batch, of rows in two months only.
_TWO = "date_trunc('month', occurred_on) in (date '1997-03-01', date '1997-05-01')"
Q["u1_versioned_ledger"] = f"""with two as (select * from led_transactions where {_TWO}),
{_INSERTS.replace("from led_transactions", "from two").replace("select id * 10 seq", "select id * 10 seq, occurred_on")},
{_PATCHED.replace("from led_transactions", "from two")}
select {_TX}, occurred_time, false rewritten from led_transactions where not {_TWO}
union all select {_TX}, occurred_time, true from patched where id % 97 <> 0
union all select {_TX}, null, true from accepted"""
Q["u1_version_before"] = f"select {_TX}, occurred_time from led_transactions"
Q["u1_version_rejects"] = f"""with two as (select * from led_transactions where {_TWO}),
{_INSERTS.replace("from led_transactions", "from two")}
select seq, 'insert' op, id, reason from judged where reason is not null
union all select id * 10 + 1, 'patch', id, 'transaction not found' from two where id % 150 = 0
union all select id * 10 + 4, 'delete', id, 'transaction not found' from two where id % 194 = 0"""

# The same table in USD.
_AFTER = f"""two as (select * from led_transactions where {_TWO}),
{_INSERTS.replace("from led_transactions", "from two").replace("select id * 10 seq", "select id * 10 seq, occurred_on").replace("select id, user_id, direction, category_id, amount,", "select id, user_id, direction, category_id, occurred_on, amount,")},
{_PATCHED.replace("from led_transactions", "from two").replace("select id, user_id, direction,", "select id, user_id, direction, occurred_on, occurred_time t0,")},
kept as (select id, user_id, direction, amount, currency, occurred_on, occurred_time
    from led_transactions where not {_TWO}
  union all select id, user_id, direction, amount, currency, occurred_on, occurred_time
    from patched where id % 97 <> 0
  union all select id, user_id, direction, amount, currency, occurred_on, null from accepted),
usd as (select k.*, case when direction = 'inbound' then {money('k.amount * m.r')}
    else -{money('k.amount * m.r')} end flow
  from kept k join matrix m on m.b = k.currency and m.q = 'USD')"""
_TOTAL = "cast(sum({}) over (partition by user_id order by {} rows unbounded preceding) as decimal(18,2))"
Q["w8_month_balances"] = f"""with {_AFTER},
nets as (select user_id, cast(date_trunc('month', occurred_on) as date) as month,
    {money_sum('flow')} net, count(*) entries from usd group by all),
closed as (select *, {_TOTAL.format('net', 'month')} closing from nets)
select *, cast(closing - net as decimal(18,2)) opening from closed"""
_RANGE = "occurred_on between date '1997-03-10' and date '1997-06-20'"
Q["w1_running_balance_kept"] = f"""with {_AFTER},
daily as (select user_id, occurred_on, {money_sum('flow')} net from usd group by all),
run as (select *, {_TOTAL.format('net', 'occurred_on')} balance from daily)
select * from run where {_RANGE}"""
Q["w2_transaction_balance_kept"] = f"""with {_AFTER},
run as (select *, {_TOTAL.format('flow', _LEDGER_ORDER)} balance from usd)
select user_id, id, balance from run where {_RANGE}"""
Q["w8_balance_at_kept"] = f"""with {_AFTER}
select user_id, {money_sum('flow')} balance from usd where occurred_on <= date '1997-05-17' group by user_id"""
Q["f3_newest_by_month"] = """select user_id, cast(row_number() over (partition by user_id
    order by occurred_on desc, occurred_time desc nulls last, id desc) as int) as position, id, occurred_on
from led_transactions where user_id % 3 = 0 qualify position <= 5"""

def _as_report(name: str, query: str, label: str, value: str) -> str:
    return f"""select '{name}' report, user_id, {label} as label, cast({value} as decimal(18,2)) as value
from ({Q[query]}) x"""


_NUMBER = "cast(category_id as varchar)"
Q["a14_report_page"] = union_all(
    [
        *[_as_report("a1", "a1_totals", f"'{c}'", c) for c in ("total_income", "total_expense", "net_cashflow")],
        _as_report("a2", "a2_per_category_totals", f"{_NUMBER} || '/' || direction", "total"),
        _as_report("a3", "a3_top_expense_categories", f"cast(rank as varchar) || '/' || {_NUMBER}", "total"),
        _as_report("a4", "a4_monthly_totals", "month", "net"),
        _as_report("a5", "a5_monthly_expense_by_category", f"{_NUMBER} || '/' || month", "value"),
        _as_report("a6", "a6_top5_plus_other", "label || '/' || month", "value"),
        """select 'a7', user_id, cast(occurred_on as varchar), cast(sum(
    case when direction = 'inbound' then amt else -amt end) as decimal(18,2)) from conv group by user_id, occurred_on""",
        _as_report("a15", "a15_burn_rate", "'per_month'", "round(per_month, 2)"),
        _as_report("a16", "a16_statutory_split", "cast(statutory as varchar)", "total"),
        _as_report("i1", "i1_insights", "concat_ws('/', cast(position as varchar), key, detail)", "0"),
    ]
)
Q["j3_base_amounts_by_user"] = "select c.id, c.user_id, u.base_currency display_currency, c.amt from convb c join led_users u on u.id = c.user_id"
Q["a13_overview_by_user"] = Q["a13_overview"]
Q["j6_fund_status_by_user"] = Q["j6_fund_status"]

_SEQ = "((user_id * 100 + category_id) * 10000 + year) * 1000 + month * 10"
_BUDGET_OPS = f"""asked as (
  select {_SEQ} seq, 'upsert' op, user_id, category_id, year, month, limit_amount + 10 limit_amount,
    case when month % 2 = 1 then lower(currency) end given from led_budgets where (user_id + month) % 5 = 0
  union all select {_SEQ} + 1, 'delete', user_id, category_id, year, month, limit_amount, currency
  from led_budgets where (user_id + month) % 7 = 0
  union all select {_SEQ} + 2, 'delete', user_id, category_id, year, month, limit_amount, currency
  from led_budgets where (user_id + month) % 11 = 0),
ops as (select a.* from asked a where a.op = 'delete' or exists (
  select 1 from led_categories c where c.id = a.category_id and c.direction = 'outbound'))"""
_BUDGET_ID = "user_id * 10000000 + category_id * 100000 + year * 20 + month"
Q["u4_upsert_budgets"] = f"""with {_BUDGET_OPS},
last as (select * from ops qualify row_number() over (
  partition by user_id, category_id, year, month order by seq desc) = 1)
select b.*, {_BUDGET_ID} id from led_budgets b where (user_id + category_id) % 4 <> 0
  and not exists (select 1 from last l where l.user_id = b.user_id
  and l.category_id = b.category_id and l.year = b.year and l.month = b.month)
union all
select l.user_id, l.category_id, l.year, l.month, cast(l.limit_amount as decimal(14,2)),
  upper(coalesce(l.given, u.base_currency)), {_BUDGET_ID} + case when (l.user_id + l.category_id) % 4 <> 0
    then 0 else 1000000000000 + l.seq % 10 end
from last l join led_users u on u.id = l.user_id where l.op = 'upsert'"""
# Every deleted key is held by the table, so only a second delete in a row fails.
Q["u4_budget_rejects"] = f"""with {_BUDGET_OPS},
placed as (select *, lag(op) over (partition by user_id, category_id, year, month order by seq) before from ops)
select seq, op, 'budget not found' reason from placed where op = 'delete' and before = 'delete'
union all select seq, op, 'not an expense category' from asked where seq not in (select seq from ops)
union all select {_SEQ} + 3, 'upsert', 'not an expense category' from led_budgets
where (user_id + month) % 13 = 0"""

Q["u4_delete_budgets_by_id"] = f"""with b as (select {_BUDGET_ID} id from led_budgets)
select id, '' reason from b where id % 5 <> 0
union all select id * 4 + 1, 'budget not found' from b where id % 15 = 0
union all select id * 4 + 2, 'budget not found' from b where id % 7 = 0
union all select id * 4 + 3, 'budget not found' from b where id % 11 = 0"""

_FUNDS = """asked as (
  select id seq, case when id % 33 = 0 then 'reset' else 'upsert' end op,
    case when id % 21 = 0 then -id - 1 else id end user_id,
    case id % 5 when 0 then 'month' when 1 then '3m' when 2 then 'ytd' when 3 then 'all' else 'week' end as scope,
    make_date(1998, id % 12 + 1, 15) anchor, cast(id as decimal(14,2)) amount
  from led_users where id % 3 = 0),
judged as (
  select a.*, u.base_currency, case when a.scope = 'week' then 'unknown scope'
    when u.id is null then 'user not found' end reason,
    cast(case a.scope when 'month' then date_trunc('month', anchor)
      when '3m' then date_trunc('month', anchor) - interval 2 month
      when 'ytd' then date_trunc('year', anchor) else date '1970-01-01' end as date) period_start
  from asked a left join led_users u on u.id = a.user_id)"""
Q["u5_fund_by_anchor"] = f"""with {_FUNDS}
select user_id, scope, period_start, amount, currency from led_fund_overrides o where not exists (
  select 1 from judged j where j.reason is null and j.user_id = o.user_id and j.scope = o.scope
    and j.period_start = o.period_start)
union all select user_id, scope, period_start, amount, base_currency from judged
where reason is null and op = 'upsert'"""
Q["u5_fund_by_anchor_rejects"] = f"with {_FUNDS}\nselect seq, reason from judged where reason is not null"

Q["u5_upsert_fund_overrides"] = """select o.user_id, o.scope, o.period_start,
  cast(case when o.user_id % 20 = 0 then o.amount + 5 else o.amount end as decimal(14,2)) amount,
  case when o.user_id % 20 = 0 then u.base_currency else o.currency end currency, o.user_id * 7 id,
  cast(date '2020-01-01' + cast(o.user_id % 300 as int) as date) created_at,
  case when o.user_id % 20 = 0 then date '2026-06-15'
    else cast(date '2020-01-01' + cast(o.user_id % 300 as int) as date) end updated_at
from led_fund_overrides o join led_users u on u.id = o.user_id where o.user_id % 60 <> 0
union all select id, 'all', date '1970-01-01', cast(100 as decimal(14,2)), 'AUD', id * 7 + 3,
  date '2026-06-15', date '2026-06-15'
from led_users where id % 10 = 3"""

_AT = "timestamp '2002-01-01 00:00:00' + ({}) % 100000 * interval 1 second"
Q["u6_activate_profile"] = f"""with made as (
  select id + 1000000000 id, user_id, id % 2 = 0 is_active, {_AT.format('id * 10')} updated_at, id * 10 seq
  from led_profiles where id % 53 = 0),
everything as (select id, user_id, is_active, updated_at from led_profiles
  union all select id, user_id, is_active, updated_at from made),
turns as (
  select id * 10 + 1 seq, id, user_id, {_AT.format('id * 10 + 1')} turned_at from led_profiles where id % 59 = 0
  union all select seq, id, user_id, updated_at from made where is_active),
chain as (select *, lag(id) over w before, lead(id) over w after, lead(turned_at) over w next_at,
    row_number() over w nth, row_number() over (partition by user_id order by seq desc) nth_last
  from turns window w as (partition by user_id order by seq)),
opening as (select user_id, id first_id, turned_at first_at from chain where nth = 1),
closing as (select user_id, id last_id from chain where nth_last = 1),
own as (select id, max_by(nth, seq) filter (before is null or before <> id) on_nth,
    max_by(turned_at, seq) filter (before is null or before <> id) on_at,
    max_by(next_at, seq) off_at from chain group by id)
select e.id, e.user_id, case when c.last_id is null then e.is_active else c.last_id = e.id end is_active,
  case when c.last_id is null then e.updated_at
    when c.last_id = e.id then case when e.is_active and o.on_nth = 1 then e.updated_at else o.on_at end
    when o.id is not null then o.off_at
    when e.is_active then f.first_at else e.updated_at end updated_at
from everything e left join opening f on f.user_id = e.user_id left join closing c on c.user_id = e.user_id
left join own o on o.id = e.id
where not (e.id < 1000000000 and e.id % 61 = 0)"""

_MADE = """asked as (
  select *, id * 2 seq, id % 2 = 0 active, case when id % 7 = 1 then 'no rule for the region'
    when id % 7 = 2 then 'gross must be positive' end reason
  from payp where id % 67 = 0),
made as (select * from asked where reason is null),
switched as (select user_id, max(seq) filter (active) last_on from made group by user_id)"""
Q["u6_create_profiles"] = f"""with {_MADE}
select p.id, p.user_id, p.region, p.currency, cast(null as decimal(14,2)) net_amount,
  cast(null as decimal(14,2)) total_deductions,
  case when s.last_on is null then p.is_active else false end is_active
from led_profiles p left join switched s on s.user_id = p.user_id
union all
select m.id + 2000000000, m.user_id, m.region, m.currency, cast(m.net_annual as decimal(14,2)),
  cast(m.total_deductions as decimal(14,2)), coalesce(m.seq = s.last_on, false)
from made m left join switched s on s.user_id = m.user_id"""
Q["u6_create_rejects"] = f"with {_MADE}\nselect seq, reason from asked where reason is not null"

Q["u6_profile_rejects"] = """select id * 4 seq, 'activate' op, 'profile not found' reason from led_profiles where id % 59 = 0
union all select id * 4 + 2, 'delete', 'profile not found' from led_profiles where id % 61 = 0
union all select id * 4 + 3, 'activate', 'profile not found' from led_profiles where id % 67 = 0 and id % 61 = 0"""

_NEW_CATEGORIES = """asked as (
  select id seq, cast(id + 1000 as int) id, case when id % 70 = 0 then 'CAT_6'
      else concat('USR_', cast(id % 300 as varchar)) end as name,
    case when id % 40 = 0 then 'inbound' else 'outbound' end direction, id user_id
  from led_users where id % 10 = 0),
judged as (select a.*, row_number() over (partition by a.name, a.direction order by a.seq) = 1
    and c.id is null ok
  from asked a left join led_categories c on c.name = a.name and c.direction = a.direction)"""
Q["u7_add_categories"] = f"""with {_NEW_CATEGORIES}
select id, name, direction, statutory, cast(null as varchar) region, true is_system, cast(null as bigint) user_id
from led_categories
union all select id, name, direction, false, null, false, user_id from judged where ok"""
Q["u7_category_rejects"] = f"""with {_NEW_CATEGORIES}
select seq, name, direction, 'category exists' reason from judged where not ok"""

Q["u8_update_users"] = """select id, case when id % 18 = 0 then 'renamed' else name end as name,
  case when id % 27 = 0 then 'AUD' when id % 9 = 0 then 'EUR' else base_currency end base_currency,
  case when id % 27 = 0 then 'AU' else default_region end default_region,
  case when id % 18 = 0 then null else concat('u', cast(id as varchar)) end email
from led_users"""

Q["u8_user_rejects"] = """select id + 1 seq, -id - 1 id, 'user not found' reason from led_users where id % 60 = 0"""
Q["u8_default_user"] = """select id, name, base_currency, default_region from led_users where default_region = 'PH'
union all select 1, 'Breadwinner', 'USD', 'US'"""

Q["u9_upsert_fx_history"] = """select base_currency, quote_currency, as_of,
  cast(case when day(as_of) > 15 then rate + 2 when day(as_of) % 2 = 1 then rate + 1 else rate end
    as decimal(18,8)) rate,
  datediff('day', date '2000-01-01', as_of) * 10 + length(quote_currency) + ascii(quote_currency) % 7
    + case when day(as_of) < 20 then 0 when day(as_of) % 2 = 1 then 1000000 else 2000000 end id
from led_fx_history"""
Q["u10_upsert_fx_current"] = """select base_currency, quote_currency, rate, as_of,
  cast(ascii(quote_currency) + case when quote_currency = 'EUR' then 1000 else 0 end as bigint) id
from led_fx_history where (quote_currency <> 'PHP' and day(as_of) = (select max(day(as_of)) from led_fx_history
    where day(as_of) <= 20 and quote_currency <> 'PHP'))
  or (quote_currency = 'PHP' and day(as_of) = 10)"""
Q["u11_fx_coverage"] = """with asked as (
  select distinct case when day(occurred_on) % 9 = 0 then 'EUR' else 'USD' end base_currency,
    cast(occurred_on - 6 as date) start_on, cast(occurred_on + 5 as date) end_on from led_timed),
held as (select base_currency, min(as_of) lo, max(as_of) hi from led_fx_history group by base_currency)
select a.*, coalesce(a.end_on - h.hi <= 1 and h.lo <= a.start_on, false) covered
from asked a left join held h on h.base_currency = a.base_currency"""
_RATES = """asked as (
  select distinct datediff('day', date '2000-01-01', occurred_on) request_id,
    case when day(occurred_on) % 9 = 0 then 'EUR' else 'USD' end base_currency,
    cast(occurred_on - case when day(occurred_on) % 3 <> 0 then 9 else 6 end as date) start_on,
    occurred_on end_on from led_timed),
held as (select * from led_fx_history where day(as_of) < 20),
cover as (select base_currency, min(as_of) lo, max(as_of) hi from held group by base_currency),
judged as (select a.*, coalesce(a.end_on - c.hi <= 1 and c.lo <= a.start_on, false) covered
  from asked a left join cover c on c.base_currency = a.base_currency),
loads as (
  select j.request_id, h.base_currency, h.quote_currency, h.as_of, cast(h.rate + 1 as decimal(18,8)) rate
  from judged j join led_fx_history h on h.as_of = j.end_on
  where not j.covered and day(j.end_on) % 4 = 0 and j.base_currency = 'USD'),
merged as (
  select base_currency, quote_currency, as_of, rate from loads
  union all select base_currency, quote_currency, as_of, rate from held h where not exists (
    select 1 from loads l where l.as_of = h.as_of and l.quote_currency = h.quote_currency)),
points as (select a.request_id, m.as_of, m.quote_currency, m.rate from asked a
  join merged m on m.base_currency = a.base_currency and m.as_of between a.start_on and a.end_on)"""
Q["fx_rates_for_requests"] = f"""with {_RATES}
select request_id, base_currency, start_on, end_on,
  covered or request_id in (select request_id from loads) live,
  (select max(as_of) from points p where p.request_id = j.request_id) as_of,
  case base_currency when 'EUR' then 'AUD,PHP,USD' else 'AUD,EUR,PHP' end quotes from judged j"""
Q["fx_rate_points_for_requests"] = f"with {_RATES}\nselect * from points"
Q["u12_fx_series"] = """select as_of, quote_currency, rate from led_fx_history
where base_currency = 'USD' and as_of between date '2024-01-05' and date '2024-01-20'"""


def oracle_sql() -> dict[str, str]:
    return {name: with_views(sql) for name, sql in Q.items()}
