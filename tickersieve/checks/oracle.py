"""SQL for DuckDB, written from the operator definitions, to check every query's result."""

from __future__ import annotations

AS_OF = "date '2001-11-04'"
AT = "2001-11-04T21:00:00+00:00"


# Building blocks: name -> (names it needs, SQL) --------------------------------------------

BLOCKS: dict[str, tuple[tuple[str, ...], str]] = {}


def block(name: str, sql: str, *needs: str) -> None:
    BLOCKS[name] = (needs, sql)


def with_blocks(sql: str, *needs: str) -> str:
    order: list[str] = []

    def visit(name: str) -> None:
        for n in BLOCKS[name][0]:
            visit(n)
        if name not in order:
            order.append(name)

    for n in needs:
        visit(n)
    ctes = ",\n".join(f"{n} as ({BLOCKS[n][1]})" for n in order)
    return f"with {ctes}\n{sql}" if order else sql


def bars_sql(key: str, prefix: str) -> str:
    return f"""
select '{prefix}' || {key} as symbol, cast(l_shipdate as date) as date,
       case when day(l_shipdate) = 1 + {key} % 28 then null else max(l_extendedprice) end as close,
       case when day(l_shipdate) in (1 + {key} % 28, 3) then null
            else max(l_extendedprice) * 0.97 end as adj_close,
       case when day(l_shipdate) in (2, 4) then null else sum(l_quantity) end as volume
from lineitem group by {key}, l_shipdate"""


def metrics_sql(src: str) -> str:
    return f"""
select c.symbol, c.n, c.date, c.close, a.adj_close, v.volume, v.avg_volume,
  case when c.n >= 20 then c.a20 end as ma20, case when c.n >= 50 then c.a50 end as ma50,
  case when c.n >= 200 then c.a200 end as ma200,
  case when c.n85 >= 25 then c.dev * sqrt(252) end as volatility,
  case when c.n84 >= 10 then d.dd end as drawdown,
  c.hi, c.lo,
  case when c.hi > c.lo then (c.close - c.lo) / (c.hi - c.lo) end as pos,
  case when c.hi > 0 then c.close / c.hi - 1 end as from_hi,
  case when c.lo > 0 then c.close / c.lo - 1 end as from_lo,
  case when c.p21 > 0 then c.close / c.p21 - 1 end as r1,
  case when c.p63 > 0 then c.close / c.p63 - 1 end as r3,
  case when c.p84 > 0 then c.close / c.p84 - 1 end as r4,
  case when c.p126 > 0 then c.close / c.p126 - 1 end as r6
from (
  select symbol, count(*) n, max(date) date, max(close) filter (rn = 1) as close,
    count(*) filter (rn <= 85) n85, count(*) filter (rn <= 84) n84,
    avg(close) filter (rn <= 20) a20, avg(close) filter (rn <= 50) a50,
    avg(close) filter (rn <= 200) a200,
    stddev_samp(close / prev - 1) filter (rn <= 84 and prev is not null) dev,
    max(close) filter (rn <= 252) hi, min(close) filter (rn <= 252) lo,
    max(close) filter (rn = 22) p21, max(close) filter (rn = 64) p63,
    max(close) filter (rn = 85) p84, max(close) filter (rn = 127) p126
  from (
    select symbol, date, close,
      row_number() over (partition by symbol order by date desc) rn,
      lead(close) over (partition by symbol order by date desc) prev
    from {src} where close is not null)
  group by symbol) c
left join (
  select symbol, min(close / peak - 1) dd from (
    select symbol, close, max(close) over (partition by symbol order by date) peak from (
      select symbol, date, close from {src} where close is not null
      qualify row_number() over (partition by symbol order by date desc) <= 84))
  group by symbol) d on d.symbol = c.symbol
left join (
  select symbol, arg_max(adj_close, date) adj_close from {src} where adj_close is not null
  group by symbol) a on a.symbol = c.symbol
left join (
  select symbol, cast(max(volume) filter (rn = 1) as bigint) volume,
    cast(trunc(avg(volume) filter (rn <= 63)) as bigint) avg_volume
  from (select symbol, volume, row_number() over (partition by symbol order by date desc) rn
        from {src} where volume is not null)
  group by symbol) v on v.symbol = c.symbol"""


block("bars_l", bars_sql("l_suppkey", "s-"))
block("bars_p", bars_sql("l_partkey", "p-"))
block("bars_recent", f"select * from bars_l where date <= {AS_OF} and date > date '2000-10-04'", "bars_l")
block("m_l", metrics_sql("bars_l"), "bars_l")
block("m_p", metrics_sql("bars_p"), "bars_p")
block("m_recent", metrics_sql("bars_recent"), "bars_recent")

EOD = f"""
select upper(replace(symbol, '-', '.')) as symbol, upper(symbol) as "yahooSymbol",
  cast(date as varchar) as date, round(close, 6) as close, round(adj_close, 6) as "adjClose",
  volume, avg_volume as "avgVolume3m", round(ma20, 6) ma20, round(ma50, 6) ma50,
  round(ma200, 6) ma200, round(volatility, 6) as "volatility4m",
  round(drawdown, 6) as "maxDrawdown4m", round(hi, 6) high52, round(lo, 6) low52,
  round(pos, 6) range52, round(from_hi, 6) as "distance52High", round(from_lo, 6) as "distance52Low",
  round(r1, 6) return1m, round(r3, 6) return3m, round(r4, 6) return4m, round(r6, 6) return6m,
  'Yahoo EOD via GitHub Actions/yfinance' as source, '{AT}' as "updatedAt"
from """

block(
    "fund",
    f"""
select 'p-' || p_partkey as symbol, p_name as name,
  case p_type when 'ECONOMY' then 'Energy' when 'LARGE' then 'Financials' when 'MEDIUM' then 'Health Care'
    when 'PROMO' then 'Information Technology' when 'SMALL' then 'Utilities' else 'Unmapped' end as sector,
  p_brand as sub_industry, p_partkey as ordinal, p_size as size, p_retailprice as retail,
  case when p_partkey % 17 = 0 then null else p_retailprice end as price,
  case when p_partkey % 13 = 0 then '' when p_partkey % 19 = 0 then '-2.5'
    else cast(p_size as varchar) end as forward_eps,
  case when p_partkey % 3 = 0 then '4.5' else '' end as trailing_eps,
  case p_partkey % 7 when 0 then '0.12' when 1 then '12%' when 2 then '1.5' when 3 then '1.6'
    when 4 then '' when 5 then '-0.05' else '0.02' end as revenue_growth,
  case when p_partkey % 11 = 0 then '' else '0.0' || (p_partkey % 10) end as earnings_growth,
  '0.' || (p_partkey % 9 + 1) as gross_margins, '0.' || (p_partkey % 4) || '5' as operating_margins,
  cast((p_partkey * 7) % 350 as varchar) as debt_to_equity, '1.' || (p_partkey % 10) as beta,
  cast((p_partkey * 3) % 140 as varchar) as forward_pe,
  case when p_partkey % 5 = 0 then ''
    else cast({AS_OF} + cast(p_partkey % 40 - 5 as int) as varchar) end as next_earnings_date,
  'P.' || p_partkey as key
from part""",
)

DEFAULTS = """(values
('Communication Services', 9, 7, 55, 25, 21, 9.5, 2.6, 3.1, 3.0, 2.2, 3.4, 3.5),
('Consumer Discretionary', 8, 6, 42, 12, 21, 10.0, 3.2, 3.8, 3.4, 2.8, 3.1, 2.3),
('Consumer Staples', 5, 4, 38, 18, 19, 8.5, 2.2, 1.9, 2.8, 2.3, 2.5, 2.2),
('Energy', 3, 3, 35, 18, 10, 11.0, 2.8, 4.4, 4.1, 3.1, 2.3, 4.0),
('Financials', 6, 5, 0, 28, 13, 10.0, 4.0, 3.6, 3.0, 3.8, 2.5, 3.5),
('Health Care', 8, 6, 65, 24, 18, 9.0, 2.0, 2.1, 2.9, 2.4, 2.5, 4.0),
('Industrials', 7, 5, 34, 16, 19, 9.5, 2.8, 3.7, 3.2, 2.7, 2.7, 2.6),
('Information Technology', 12, 9, 58, 30, 27, 10.0, 3.4, 3.2, 3.0, 2.1, 4.2, 3.2),
('Materials', 4, 4, 31, 14, 15, 10.0, 2.9, 4.0, 3.8, 2.9, 2.1, 2.8),
('Real Estate', 3, 3, 0, 35, 17, 10.5, 4.5, 3.4, 2.8, 4.1, 2.0, 2.4),
('Utilities', 4, 4, 0, 24, 17, 8.5, 4.0, 1.8, 2.4, 3.7, 2.2, 3.2),
('Watchlist', 8, 7, 45, 15, 18, 11.0, 3.6, 4.0, 3.6, 3.5, 3.3, 2.8))
as t(name, eg, rg, gm, om, pe, dr, rate, cyc, margin, balance, crowding, reg)"""
block("defaults", f"select * from {DEFAULTS}")


def with_defaults(src: str) -> str:
    numbers = {"eps_growth": "eg", "rev_growth": "rg", "gross_margin": "gm", "op_margin": "om",
               "exit_pe": "pe", "discount_rate": "dr"}
    cols = [f"cast(d.{v} as double) as {k}" for k, v in numbers.items()]
    cols += [f"cast(d.{r} as double) as {r}" for r in RISKS]
    return f"""select u.*, {', '.join(cols)} from {src} u
join defaults d on d.name = case when u.sector in (select name from defaults) then u.sector
                                 else 'Industrials' end"""


RISKS = ("rate", "cyc", "margin", "balance", "crowding", "reg")

block("listed", "select * from fund where sub_industry not in ('Brand#9', 'Brand#19')", "fund")
block("local_l", "select * from fund where sub_industry in ('Brand#7', 'Brand#9')", "fund")
block(
    "shared_l",
    """select * replace ('' as name, '' as sector) from fund
       where sub_industry in ('Brand#7', 'Brand#19', 'Brand#20')""",
    "fund",
)
block(
    "custom_l",
    """select key, name, sector, sub_industry, ordinal from local_l
       union all
       select key, key, 'Watchlist', sub_industry,
         ordinal - (select min(ordinal) from shared_l) + (select max(ordinal) from local_l) + 1 from shared_l
       where key not in (select key from local_l)""",
    "local_l",
    "shared_l",
)
block(
    "uni0",
    """select key, name, sector, sub_industry, ordinal, cast(null as boolean) is_custom,
         '섹터 기본값' fundamental_source from listed
       union all
       select key, name, sector, sub_industry,
         ordinal - (select min(ordinal) from local_l) + (select max(ordinal) from listed) + 1, true, '공유 관심종목'
       from custom_l where key not in (select key from listed)""",
    "listed",
    "custom_l",
)
block("uni", with_defaults("uni0"), "uni0", "defaults")

block(
    "snap_all",
    """select f.key, f.ordinal, coalesce(cast(m.date as varchar), '') as date,
         case when f.ordinal % 23 = 0 then 0 when f.price is not null then f.price
              when f.ordinal % 2 = 0 then f.retail end as price,
         round(m.r1, 6) r1, round(m.r3, 6) r3, round(m.r4, 6) r4, round(m.r6, 6) r6,
         round(m.hi, 6) hi, round(m.lo, 6) lo, round(m.pos, 6) pos
       from fund f left join m_p m on m.symbol = f.symbol
       union all
       select f.key, f.ordinal + (select max(ordinal) from fund) + 1, coalesce(cast(m.date as varchar), ''), f.price * 1.1,
         round(m.r1, 6), round(m.r3, 6), round(m.r4, 6), round(m.r6, 6),
         round(m.hi, 6), round(m.lo, 6), round(m.pos, 6)
       from fund f left join m_p m on m.symbol = f.symbol where f.size = 29 and f.price is not null""",
    "fund",
    "m_p",
)
block("snap", "select * from snap_all where price > 0", "snap_all")
block(
    "snap_last",
    "select * from snap qualify row_number() over (partition by key order by ordinal desc) = 1",
    "snap",
)
block(
    "snap_bars",
    """select upper(replace(symbol, '-', '.')) as key, cast(date as varchar) as date,
         round(close, 6) as price, round(r1, 6) r1, round(r3, 6) r3, round(r4, 6) r4, round(r6, 6) r6,
         round(hi, 6) hi, round(lo, 6) lo, round(pos, 6) pos, 'Yahoo EOD via GitHub Actions/yfinance' as source
       from m_p where round(close, 6) > 0""",
    "m_p",
)


def num(text: str) -> str:
    return f"try_cast(nullif(trim(translate({text}, '%,$', '')), '') as double)"


def fund_numbers(blank: str) -> str:
    def n(col: str) -> str:
        value = num(col)
        return value if blank == "null" else f"case when trim({col}) = '' then 0 else {value} end"

    def p(col: str) -> str:
        return f"case when abs({n(col)}) <= 1.5 then {n(col)} * 100 else {n(col)} end"

    return f"""
select key, case when fw > 0 then fw when tr > 0 then tr end n_eps,
  rg n_rg, eg n_eg, gm n_gm, om n_om, case when pe > 0 and pe < 120 then pe end n_pe,
  case when de is null then null when de >= 300 then 4.7 when de >= 200 then 4.2 when de >= 120 then 3.5
       when de >= 70 then 2.8 when de >= 30 then 2.2 else 1.7 end n_balance,
  case when pe is null or pe <= 0 then null when pe >= 60 then 4.8 when pe >= 40 then 4.2
       when pe >= 28 then 3.5 when pe >= 18 then 2.7 else 2.0 end n_crowding,
  case when be > 0 then greatest(1, least(5, 1.5 + be * 1.2)) end n_cyc,
  case when om is null then null when om < 5 then 4.7 when om < 12 then 4.0 when om < 20 then 3.2
       when om < 30 then 2.5 else 1.9 end n_margin,
  case when next_earnings_date <> '' then cast(next_earnings_date as date)
       when ordinal % 10 = 0 then date '2001-11-04' + cast(ordinal % 30 as int) end n_date
from (select key, ordinal, next_earnings_date, {n('forward_eps')} fw, {n('trailing_eps')} tr,
        {n('forward_pe')} pe, {p('revenue_growth')} rg, {p('earnings_growth')} eg,
        {p('gross_margins')} gm, {p('operating_margins')} om, {n('debt_to_equity')} de, {n('beta')} be
      from fund)"""


block("offers", fund_numbers("null"), "fund")
block("offers_zero", fund_numbers("zero"), "fund")


def funded(src: str, offers: str, fill: bool = False) -> str:
    def pick(new: str, old: str) -> str:
        return f"coalesce(s.{old}, o.{new})" if fill else f"coalesce(o.{new}, s.{old})"

    pairs = {"rev_growth": "n_rg", "eps_growth": "n_eg", "gross_margin": "n_gm",
             "op_margin": "n_om", "exit_pe": "n_pe"}
    cols = [f"{pick(n, c)} as {c}" for c, n in pairs.items()]
    cols += [f"coalesce(o.n_{r}, s.{r}) as {r}" for r in ("cyc", "margin", "balance", "crowding")]
    touched = "o.n_eps is not null" if fill else " or ".join(
        f"o.{n} is not null" for n in ("n_eps", "n_rg", "n_eg", "n_gm", "n_om", "n_pe"))
    return f"""
select s.* exclude (rev_growth, eps_growth, gross_margin, op_margin, exit_pe, cyc, margin, balance,
                    crowding, fundamental_source),
  {', '.join(cols)}, o.n_eps as forward_eps, o.n_date as next_earnings_date,
  coalesce({touched}, false) as fundamental_auto, false as fundamental_manual,
  case when o.key is null then s.fundamental_source else 'records {AT}' end as fundamental_source
from {src} s left join {offers} o on o.key = s.key"""


def priced(src: str, snap: str, source: str) -> str:
    return f"""
select s.*, p.price, case when p.key is null then 'manual'
    else {source} || case when p.date <> '' then ' ' || p.date else '' end end as price_source,
  p.r1, p.r3, p.r4, p.r6, p.hi, p.lo, p.pos
from {src} s left join {snap} p on p.key = s.key"""


block("uni_p", priced("uni", "snap_last", "'bars'"), "uni", "snap_last")
block("st", funded("uni_p", "offers"), "uni_p", "offers")
block("uni_b", priced("uni", "snap_bars", "p.source"), "uni", "snap_bars")
block("st_bars", funded("uni_b", "offers"), "uni_b", "offers")
block(
    "edits",
    """select key, ordinal % 50 + 1 as number, size from fund""",
    "fund",
)
block(
    "st_edit",
    """
select s.* replace (
    case when e.size = 31 then cast(e.number as double) else s.price end as price,
    case when e.size = 31 then 'manual' else s.price_source end as price_source,
    case when e.size = 37 then cast(e.number as double) else s.eps_growth end as eps_growth,
    case when e.size = 38 then null else s.forward_eps end as forward_eps,
    case when e.size = 41 then 4.9 else s.cyc end as cyc,
    case when e.size in (37, 42) then 12.5 else s.discount_rate end as discount_rate,
    case when e.size in (37, 38, 42) then false else s.fundamental_auto end as fundamental_auto,
    e.size in (37, 38, 42) as fundamental_manual,
    case when e.size in (37, 38, 42) then '수동 입력' else s.fundamental_source end as fundamental_source)
from st s join edits e on e.key = s.key""",
    "st",
    "edits",
)


# The model ---------------------------------------------------------------------------------

HORIZON = {
    "swing": (1 / 3, 0.14, 0.18, 0.14, 0.16, 0.13, 0.25),
    "year1": (1.0, 0.20, 0.18, 0.16, 0.18, 0.13, 0.15),
    "years3": (3.0, 0.25, 0.16, 0.17, 0.22, 0.12, 0.08),
    "years5": (5.0, 0.30, 0.14, 0.17, 0.24, 0.10, 0.05),
}


def clip(x: str, lo: float = 0, hi: float = 100) -> str:
    return f"greatest({lo}, least({hi}, {x}))"


def model(name: str, src: str, key: str = "'all'", peers: str | None = None,
          horizon: str = "swing") -> None:
    """Define blocks <name>_1.._3 and <name>: src scored among peers that share `key`."""
    y, wu, wp, wg, wq, wr, wm = HORIZON[horizon]
    y = f"cast({y!r} as double)"
    pe = "case when price <> 0 and forward_eps > 0 then price / forward_eps end"
    block(f"{name}_0", f"select *, {key} as peer, {pe} as pe_now from {src}", src)
    pool = f"{name}_0"
    if peers is not None:
        pool = f"{name}_pool"
        block(pool, f"select *, {key} as peer, {pe} as pe_now from {peers}", peers)
    block(
        f"{name}_g",
        f"""select peer, median(pe_now) med,
              count(*) filter (pe_now > 0 and pe_now < 500) total from {pool} group by peer""",
        pool,
    )
    if peers is None:
        # Peers and stocks are the same rows: a running count does.
        rank = f"""sum(case when pe_now > 0 and pe_now < 500 then 1 else 0 end)
          over (partition by s.peer order by pe_now range unbounded preceding)"""
    else:
        rank = f"""(select count(*) from {pool} p where p.peer = s.peer and p.pe_now > 0
          and p.pe_now < 500 and p.pe_now <= s.pe_now)"""
    mom = "coalesce(r4, r3, r1)" if horizon == "swing" else "coalesce(r6, r3, r1)"
    weights = {"rate": 1.0, "cyc": 1.1, "margin": 1.0, "balance": 1.0, "crowding": 1.2, "reg": 0.8}
    risk_top = " + ".join(f"case when {r} is null then 0 else {clip(r, 1, 5)} * {w} end"
                          for r, w in weights.items())
    risk_den = " + ".join(f"case when {r} is null then 0 else {w} end" for r, w in weights.items())
    block(
        f"{name}_1",
        f"""select s.*, g.med, case when pe_now is not null and g.total >= 3
              then {rank} / g.total end as percentile,
            coalesce(eps_growth, 0) / 100 as gr, coalesce(discount_rate, 10) / 100 as dr,
            {mom} as mom, ({risk_top}) / nullif({risk_den}, 0) as risk_score,
            (case when price > 0 then 15 else 0 end + case when forward_eps > 0 then 20 else 0 end
             + case when eps_growth is not null then 15 else 0 end
             + case when rev_growth is not null then 12 else 0 end
             + case when gross_margin is not null then 8 else 0 end
             + case when op_margin is not null then 10 else 0 end
             + case when exit_pe > 0 then 8 else 0 end
             + case when fundamental_auto then 12 else 0 end) as confidence,
            coalesce(pos, case when price <> 0 and hi <> 0 and lo <> 0 and hi > lo
              then {clip('(price - lo) / (hi - lo)', 0, 1)} end) as place,
            case when price <> 0 and hi <> 0 then price / hi - 1 end as from_hi,
            case when price <> 0 and lo <> 0 then price / lo - 1 end as from_lo,
            datediff('day', {AS_OF}, next_earnings_date) as days
            from {name}_0 s left join {name}_g g on g.peer = s.peer""",
        f"{name}_0",
        f"{name}_g",
    )

    def fv(shift: int, mult: float, disc: int) -> str:
        return f"""case when forward_eps > 0 and exit_pe > 0 then
          forward_eps * pow(1 + greatest(-0.95, gr + {shift} / 100.0), {y}) * (exit_pe * {mult})
          / pow(1 + greatest(0, dr + {disc} / 100.0), {y}) end"""

    block(
        f"{name}_2",
        f"""select *, {fv(-5, 0.8, 2)} as bear, {fv(0, 1.0, 0)} as base, {fv(5, 1.2, -1)} as bull,
            case when price > 0 and forward_eps > 0 and exit_pe > 0 then
              pow(price * pow(1 + dr, {y}) / (forward_eps * exit_pe), 1 / {y}) - 1 end as needed,
            case when pe_now <> 0 and med <> 0 then pe_now / med - 1 end as premium,
            case when pe_now <> 0 and eps_growth > 3 then pe_now / eps_growth end as peg
            from {name}_1""",
        f"{name}_1",
    )
    block(
        f"{name}_3",
        f"""select *, case when base <> 0 and price <> 0 then base / price - 1 end as up,
            needed - eps_growth / 100 as gap,
            case when bear <> 0 and base <> 0 and bull <> 0 then (bull - bear) / base end as sens
            from {name}_2""",
        f"{name}_2",
    )
    block(
        f"{name}_4",
        f"""select *,
            case when up is null then 40 else {clip('50 + up * 140')} end as s_up,
            case when percentile is null then 50 else {clip('100 - percentile * 100')} end as s_pct,
            case when peg is null then 45 when peg < 1.2 then 95 when peg < 2.0 then 78
                 when peg < 2.8 then 55 when peg < 4.0 then 32 else 12 end as s_peg,
            case when gap is null then 45 when gap <= 0 then 95 when gap <= 0.03 then 78
                 when gap <= 0.06 then 58 when gap <= 0.10 then 35 else 12 end as s_gap,
            case when risk_score is null then 55
                 else {clip('100 - (risk_score - 1) / 4 * 100')} end as s_risk,
            case when mom is null then 50 else {clip('50 + mom * 120')} end as s_mom,
            case when not coalesce(price <> 0 and forward_eps > 0 and base <> 0, false) then 'Need EPS'
                 when up >= 0.25 then 'Very undervalued' when up >= 0.10 then 'Undervalued'
                 when up >= -0.10 then
                   case when premium > 0.30 and needed > gr + 0.04 then 'Overvalued' else 'Okay' end
                 when up >= -0.25 then 'Overvalued' else 'Very overvalued' end as status,
            case when coalesce(cast(pe_now < 15 as int), 0) + coalesce(cast(eps_growth < 4 as int), 0)
                    + coalesce(cast(rev_growth < 3 as int), 0) + coalesce(cast(risk_score >= 3.6 as int), 0)
                    + coalesce(cast(mom < -0.12 as int), 0) >= 3 then 'Value Trap?'
                 when gap > 0.08 then '기대 높음' else '' end as trap,
            case when eps_growth is null then 50 else {clip('50 + eps_growth * 3')} end * 0.6
              + case when rev_growth is null then 50 else {clip('50 + rev_growth * 3.5')} end * 0.4 as f_growth,
            case when gross_margin is null then 50 else {clip('gross_margin * 1.3')} end * 0.45
              + case when op_margin is null then 50 else {clip('40 + op_margin * 1.6')} end * 0.55 as f_quality
            from {name}_3""",
        f"{name}_3",
    )
    blend = f"(s_up * {wu} + s_pct * {wp} + s_peg * {wg} + s_gap * {wq} + s_risk * {wr} + s_mom * {wm})"
    total = clip(f"{blend} * (0.72 + confidence / 360.0)")
    reasons = [
        ("percentile < 0.35", "섹터 대비 저렴"), ("gap <= 0.02", "성장률 부담 낮음"),
        ("peg < 1.8", "PEG 양호"), ("mom > 0.03", "모멘텀 양호"), ("risk_score < 2.8", "리스크 낮음"),
        ("up > 0.1", "적정가 대비 여력"), ("place < 0.35", "52주 저점권"),
        ("days between 0 and 14", "실적 임박"),
    ]
    chips = ", ".join(f"case when {t} then '{x}' end" for t, x in reasons)
    block(
        name,
        f"""select *, case when days between 0 and 7 then {clip(total + ' - 4')} else {total} end as score,
            s_up * 0.35 + s_pct * 0.35 + s_peg * 0.30 as f_value,
            case when concat_ws('|', {chips}) = '' then ['추가 확인 필요']
              else string_split(concat_ws('|', {chips}), '|')[1:4] end as chips
            from {name}_4""",
        f"{name}_4",
    )


model("sc", "st")
model("sec", "st", key="coalesce(sector, '')")
model("sec_bars", "st_bars", key="coalesce(sector, '')")
for _h in ("year1", "years3", "years5"):
    model(f"sc_{_h}", "st", horizon=_h)

block("watched", "select * from st where coalesce(is_custom, false) or sector = 'Watchlist'", "st")
model("watch", "watched")
block("in_util", "select * from st where sector = 'Utilities'", "st")
model("util", "in_util")
block("found_ring", "select * from st where concat_ws('|', lower(key), lower(name), lower(sector), lower(sub_industry)) like '%ring%'", "st")
model("ring", "found_ring")
block("in_health", "select * from st where sector = 'Health Care'", "st")
block("health_ring", "select * from found_ring where sector = 'Health Care'", "found_ring")
model("hring", "health_ring", peers="in_health")
block(
    "found_b",
    """select * from st where lower(key) like '%b%' or lower(name) like '%b%' or lower(sector) like '%b%'
       or lower(sub_industry) like '%b%'""",
    "st",
)
model("visb", "found_b", peers="st")
block("cleared", "select * replace (case when ordinal % 2 = 0 then pos end as pos) from st", "st")
model("clear", "cleared")

GRADE = "case when {0} >= 85 then 'A' when {0} >= 70 then 'B' when {0} >= 55 then 'C' when {0} >= 40 then 'D' else 'F' end"
GRADES = ", ".join(
    f"{GRADE.format(c)} as grade_{n}"
    for n, c in (("value", "f_value"), ("growth", "f_growth"), ("momentum", "s_mom"),
                 ("quality", "f_quality"), ("risk", "s_risk"))
)
SECTOR_LABEL = """case sector when 'All' then '전체' when 'Watchlist' then '관심종목'
 when 'Communication Services' then '커뮤니케이션 서비스' when 'Consumer Discretionary' then '임의소비재'
 when 'Consumer Staples' then '필수소비재' when 'Energy' then '에너지' when 'Financials' then '금융'
 when 'Health Care' then '헬스케어' when 'Industrials' then '산업재' when 'Information Technology' then '정보기술'
 when 'Materials' then '소재' when 'Real Estate' then '부동산' when 'Utilities' then '유틸리티'
 when 'Other' then '기타' else sector end"""
STATUS_LABEL = """case status when 'Very undervalued' then '매우 저평가' when 'Undervalued' then '저평가'
 when 'Okay' then '적정' when 'Overvalued' then '고평가' when 'Very overvalued' then '매우 고평가'
 when 'Need EPS' then 'EPS 필요' end"""
RISK_LABEL = "case when risk_score >= 3.75 then '높음' when risk_score >= 2.75 then '중간' else '낮음' end"
EARN_LABEL = "case when days is null then '–' when days < 0 then '지남' when days = 0 then '오늘' else days || '일 후' end"
CARD = """key as symbol, name, sector, round(score, 6) short_score, round(up, 6) upside, round(peg, 6) peg,
 round(place, 6) range_position, days as earnings_days, round(mom, 6) return_h"""
SCORED = """key as symbol, round(pe_now, 6) current_pe, round(up, 6) upside, round(needed, 6) required_growth,
 round(premium, 6) sector_premium, round(risk_score, 6) risk_score, status, round(percentile, 6) pe_percentile,
 round(peg, 6) peg, round(gap, 6) growth_gap, cast(confidence as double) confidence,
 round(score, 6) short_score, trap as value_trap, round(mom, 6) return_h, round(place, 6) range_position"""
BEST = "order by score desc, key, ordinal"
RISK_COLS = ", ".join(f"round({r}, 6) as risk_{r}" for r in RISKS)
FUNDED = """key as symbol, round(forward_eps, 6) forward_eps, round(rev_growth, 6) rev_growth,
 round(eps_growth, 6) eps_growth, round(gross_margin, 6) gross_margin, round(op_margin, 6) op_margin,
 round(exit_pe, 6) exit_pe, cast(next_earnings_date as varchar) next_earnings_date, fundamental_auto,
 fundamental_manual, fundamental_source"""
CARRIED = f"""key as symbol, name, sector, round(price, 6) price, price_source, round(forward_eps, 6) forward_eps,
 round(eps_growth, 6) eps_growth, round(exit_pe, 6) exit_pe, round(discount_rate, 6) discount_rate,
 {RISK_COLS}, fundamental_source, fundamental_auto, fundamental_manual, round(r1, 6) return1m,
 round(hi, 6) high52, cast(next_earnings_date as varchar) next_earnings_date, is_custom"""

block("fresh", "select * from uni", "uni")
for _o, _s in (("merged_null", "offers"), ("merged_zero", "offers_zero")):
    block(_o, funded("uni", _s), "uni", _s)
block("merged_fill", funded("uni", "offers", fill=True), "uni", "offers")


def carried(new: str, old: str) -> str:
    """New rows (key, name, sector, ..., defaults) with the old rows' values."""
    both = {"eps_growth", "exit_pe", "discount_rate", *RISKS}
    cols = ", ".join(f"coalesce(o.{c}, n.{c}) as {c}" for c in sorted(both))
    return f"""
select n.key, n.name, n.sector, n.sub_industry, n.ordinal, o.price,
  case when o.key is null then 'manual' else o.price_source end as price_source, o.forward_eps,
  {cols}, coalesce(o.fundamental_source, n.fundamental_source) as fundamental_source,
  coalesce(o.fundamental_auto, false) as fundamental_auto,
  coalesce(o.fundamental_manual, false) as fundamental_manual, o.r1, cast(null as double) as hi,
  cast(null as date) as next_earnings_date,
  case when o.key is null then n.is_custom else coalesce(o.is_custom, n.is_custom, false) end as is_custom
from {new} n left join {old} o on o.key = n.key"""


PLAIN = "key, name, sector, sub_industry, ordinal, is_custom, fundamental_source"
block("old", "select * from st where sector <> 'Energy'", "st")
for _name, _sector in (("as_util", "Utilities"), ("as_mat", "Materials")):
    block(
        f"{_name}0",
        f"""select key, name, '{_sector}' as sector, sub_industry, ordinal,
              cast(null as boolean) is_custom, '섹터 기본값' as fundamental_source from fund""",
        "fund",
    )
    block(_name, with_defaults(f"{_name}0"), f"{_name}0", "defaults")
    block(f"{_name}_c", carried(_name, "old"), _name, "old")
block("mat_blank", "select * replace ('' as sub_industry) from as_mat_c", "as_mat_c")

block(
    "re_listed0",
    """select key, name, sector, sub_industry, ordinal, cast(null as boolean) is_custom,
         '섹터 기본값' as fundamental_source from listed where sector <> 'Utilities'""",
    "listed",
)
block("re_listed", with_defaults("re_listed0"), "re_listed0", "defaults")
block("re_listed_c", carried("re_listed", "old"), "re_listed", "old")
block("re_own0", "select key, name, sector, sub_industry, ordinal, true as is_custom, '공유 관심종목' as fundamental_source from custom_l", "custom_l")
block("re_own", with_defaults("re_own0"), "re_own0", "defaults")
block("re_own_c", carried("re_own", "old"), "re_own", "old")
KEPT = "key, name, sector, price, price_source, forward_eps, eps_growth, exit_pe, discount_rate, " + ", ".join(RISKS) + ", fundamental_source, fundamental_auto, fundamental_manual, r1, hi, next_earnings_date, is_custom"
block(
    "refreshed",
    f"""select {KEPT} from re_listed_c
        union all
        select {KEPT.replace('is_custom', 'true')} from (
          select {KEPT} from old where coalesce(is_custom, false) or sector = 'Watchlist'
          union all
          select {KEPT} from re_own_c where key not in (
            select key from old where coalesce(is_custom, false) or sector = 'Watchlist'))
        where key not in (select key from re_listed_c)""",
    "re_listed_c",
    "re_own_c",
    "old",
)
block("before_sync", "select * from st where sub_industry <> 'Brand#19'", "st")
block(
    "sync_new0",
    """select key, key as name, 'Watchlist' as sector, sub_industry, ordinal, true as is_custom,
         '공유 관심종목' as fundamental_source from shared_l where key not in (select key from before_sync)""",
    "shared_l",
    "before_sync",
)
block("sync_new", with_defaults("sync_new0"), "sync_new0", "defaults")
block(
    "synced",
    f"""select {KEPT}, ordinal from before_sync
        union all
        select key, name, sector, null, 'manual', null, eps_growth, exit_pe, discount_rate,
          {', '.join(RISKS)}, fundamental_source, false, false, null, null, null, true,
          ordinal + (select max(ordinal) from before_sync) + 1 from sync_new""",
    "before_sync",
    "sync_new",
)

# Queries -----------------------------------------------------------------------------------

ORACLE: dict[str, str] = {}


def check(name: str, sql: str, *needs: str) -> None:
    ORACLE[name] = with_blocks(sql, *needs)


check("eod_last", "select symbol, cast(date as varchar) date, round(close, 6) as close, round(adj_close, 6) adj_close, volume from m_l", "m_l")
check("range52", "select symbol, round(hi, 6) high52, round(lo, 6) low52, round(pos, 6) range52, round(from_hi, 6) distance52_high, round(from_lo, 6) distance52_low from m_l", "m_l")
check("avg_volume", "select symbol, avg_volume as avg_volume3m from m_l", "m_l")
check("trailing_returns", "select symbol, round(r1, 6) return1m, round(r3, 6) return3m, round(r4, 6) return4m, round(r6, 6) return6m from m_l", "m_l")
check("moving_avg", "select symbol, round(ma20, 6) ma20, round(ma50, 6) ma50, round(ma200, 6) ma200 from m_l", "m_l")
check("volatility", "select symbol, round(volatility, 6) volatility4m from m_l", "m_l")
check("max_drawdown", "select symbol, round(drawdown, 6) max_drawdown4m from m_l", "m_l")
check("eod_metrics", EOD + "m_l", "m_l")
check("eod_metrics_short", EOD + "m_p", "m_p")
check("eod_metrics_13mo", EOD + "m_recent", "m_recent")
for _name in ("eod_metrics_long_history", "eod_metrics_bucketed", "eod_metrics_incremental"):
    check(_name, EOD + "m_l", "m_l")
check(
    "dedupe_bars",
    """select 's-' || l_suppkey as symbol, cast(cast(l_shipdate as date) as varchar) as date,
         l_extendedprice as close, round(l_extendedprice * 0.97, 6) as adj_close, l_quantity as volume
       from lineitem qualify row_number() over (partition by l_suppkey, cast(l_shipdate as date)
         order by l_orderkey * 10 + l_linenumber desc, l_partkey desc) = 1""",
)
block(
    "bars_once",
    f"""select 's-' || l_suppkey as symbol, cast(l_shipdate as date) as date, l_extendedprice as close,
         l_extendedprice * 0.97 as adj_close, l_quantity as volume
       from lineitem where cast(l_shipdate as date) <= {AS_OF} and cast(l_shipdate as date) > date '2000-10-04'
       qualify row_number() over (partition by l_suppkey, cast(l_shipdate as date)
         order by (l_partkey % 2 = 0) desc, case when l_partkey % 2 = 0 then l_orderkey end desc nulls last,
           case when l_partkey % 2 = 0 then l_linenumber end desc nulls last,
           case when l_partkey % 2 = 0 then l_partkey end desc nulls last,
           l_extendedprice desc, l_quantity desc) = 1""",
)
block("m_once", metrics_sql("bars_once"), "bars_once")
check(
    "panel_to_long",
    """select 'N' || n as symbol, cast(date as varchar) as date, round(close, 6) as close,
         round(case when n < 10 then close * 0.5 else close end, 6) as adj_close, volume
       from (select s_nationkey n, cast(l_shipdate as date) date,
               case when day(l_shipdate) <> s_nationkey + 1 then max(l_extendedprice) end as close,
               case when day(l_shipdate) <> s_nationkey + 1 and s_nationkey % 2 = 0 then sum(l_quantity) end as volume
             from lineitem join supplier on l_suppkey = s_suppkey group by s_nationkey, l_shipdate)
       where close is not null or volume is not null""",
)
block("sup", "select symbol, cast(substr(symbol, 3) as bigint) k, date, close, adj_close from bars_l", "bars_l")
check(
    "chart_last_close",
    """select upper(replace(symbol, '-', '.')) as symbol, case when error is null then close end as price,
         case when error is null then date end as date, error
       from (select symbol,
               case when k % 11 = 5 then 'no data' when k % 13 = 6 then 'empty result' end as error,
               max(close) filter (rn = 1) as close,
               cast(max(date) filter (rn = 1 and (k % 7 <> 3 or pos <= 5)) as varchar) as date
             from (select *, row_number() over (partition by symbol order by date) pos,
                     row_number() over (partition by symbol, close is null order by date desc)
                       * case when close is null then -1 else 1 end as rn from sup)
             group by symbol, k)""",
    "sup",
)
check(
    "hist_json_latest",
    """select upper(replace(symbol, '-', '.')) as symbol, round(case when (k // 3) % 3 = 2 then coalesce(adj_close, 7.5)
         else coalesce(close, adj_close, 7.5) end, 6) as price, cast(date as varchar) date
       from sup qualify row_number() over (partition by symbol order by date desc) = 1""",
    "sup",
)
check(
    "chart_text_numbers",
    """select upper(replace(symbol, '-', '.')) as symbol, close as price, cast(date as varchar) as date, cast(null as varchar) as error
       from sup where close is not null and not (day(date) % 5 = 1)
       qualify row_number() over (partition by symbol order by date desc) = 1""",
    "sup",
)
check(
    "hist_text_numbers",
    """select upper(replace(symbol, '-', '.')) as symbol, cast(date as varchar) as date,
         case when day(date) % 3 = 0 then 7.25 else round(coalesce(close, adj_close, 7.25), 6) end as price
       from sup qualify row_number() over (partition by symbol order by date desc) = 1""",
    "sup",
)
_LIGHT = """select upper(replace(symbol, '-', '.')) as symbol, round(coalesce(close, adj_close), 6) as price, cast(date as varchar) as date
       from sup qualify row_number() over (partition by symbol order by sup.date desc) = 1"""
check("light_json", f"select * from ({_LIGHT}) where price is not null and price <> 0", "sup")
check(
    "light_latest",
    """select * from (select upper(replace(symbol, '-', '.')) as symbol,
         round(coalesce(close, adj_close), 6) as price, cast(date as varchar) as date
       from bars_l qualify row_number() over (partition by symbol order by bars_l.date desc) = 1)
       where price is not null and price <> 0""",
    "bars_l",
)
block(
    "bulk_usable",
    """select symbol, date, coalesce(close, adj_close) as price from sup
       where date between date '2001-10-27' and date '2001-11-04' and dayofweek(date) not in (0, 6)
         and coalesce(close, adj_close) <> 0
         and k in (select s_suppkey from supplier where s_acctbal > 5000)""",
    "sup",
)
check(
    "bulk_json",
    """select upper(replace(symbol, '-', '.')) as symbol, round(price, 6) price, cast(date as varchar) date
       from bulk_usable where date = (select max(date) from bulk_usable)""",
    "bulk_usable",
)
check(
    "bulk_latest_date",
    """select upper(replace(symbol, '-', '.')) as symbol, round(price, 6) price, cast(date as varchar) date
       from bulk_usable where date = (select max(date) from bulk_usable)""",
    "bulk_usable",
)
_ts = "case when ordinal % 3 = 0 then 1004832000 + ordinal % 40 * 86400 when ordinal % 3 = 1 then -(ordinal % 2) else 1004918400 + ordinal % 3 * 3600 end"
_bad = "ordinal % 29 = 4"


def _ok(expression: str, alias: str) -> str:
    return f'case when {_bad} then null else {expression} end as "{alias}"'


_EMPTY_FIELDS = (
    "trailingPE",
    "revenueGrowth",
    "earningsGrowth",
    "operatingMargins",
    "profitMargins",
    "debtToEquity",
    "currentRatio",
    "quickRatio",
    "totalDebt",
    "totalCash",
    "fiftyTwoWeekHigh",
    "fiftyTwoWeekLow",
)
_null = {c: f'cast(null as double) as "{c}"' for c in _EMPTY_FIELDS}
check(
    "fund_from_json",
    f"""select key as symbol, replace(key, '.', '-') as "yahooSymbol",
      {_ok("case when ordinal % 4 = 0 then 'Long ' || name else name end", "shortName")},
      {_ok("sector", "sector")}, {_ok("sub_industry", "industry")},
      {_ok(num("forward_eps"), "forwardEps")}, {_ok(num("trailing_eps"), "trailingEps")},
      {_ok(num("forward_pe"), "forwardPE")},
      {_ok("case when ordinal % 6 > 1 then 1.25 end", "pegRatio")},
      {_ok(num("gross_margins"), "grossMargins")}, {_ok(num("beta"), "beta")},
      {_ok("cast(ordinal * 1000000007 as double)", "marketCap")},
      {_ok(f"cast({_ts} as double)", "earningsTimestamp")},
      {_ok(f"case when {_ts} > 0 then cast(cast(to_timestamp({_ts}) at time zone 'UTC' as date) as varchar) end", "nextEarningsDate")},
      'Yahoo Finance fundamentals via yfinance/GitHub Actions' as source, '{AT}' as "updatedAt",
      case when {_bad} then left(repeat('timeout while fetching ', 12), 220) end as error,
      {', '.join(_null.values())}
    from fund""",
    "fund",
)
check(
    "price_waterfall",
    """select * from (select upper(replace(symbol, '-', '.')) as symbol, round(coalesce(close, adj_close), 6) as price,
         cast(date as varchar) as date, 1 as feed from bars_p
       qualify row_number() over (partition by symbol order by bars_p.date desc) = 1)
       where price is not null and price <> 0""",
    "bars_p",
)
check(
    "price_candidates",
    """select upper(replace(symbol, '-', '.')) as symbol,
         round(case when k % 5 in (1, 2) then adj_close else close end, 6) as price,
         cast(date as varchar) as date, case when k % 5 in (1, 2) then 1 else 0 end as rank
       from (select *, cast(substr(symbol, 3) as bigint) k from m_l)""",
    "m_l",
)
check("symbol_norm", "select p_partkey, 'BRK.' || p_partkey || '.B' as symbol, 'BRK-' || p_partkey || '-B' as api_symbol from part")
_edge = [("", None, 0.0, None), (" 3 ", 3.0, 3.0, 3.0), ("12%", 12.0, 12.0, 12.0), ("$3,000", 3000.0, 3000.0, None),
         ("1.5", 1.5, 1.5, 1.5), ("1.6", 1.6, 1.6, 1.6), ("-0.05", -0.05, -0.05, -0.05), ("NaN", None, None, None),
         ("1d", None, None, 1.0), ("12abc", None, None, 12.0), (".5", 0.5, 0.5, 0.5), ("2e3", 2000.0, 2000.0, 2000.0),
         ("-", None, None, None), ("+7.", 7.0, 7.0, 7.0), ("1e5x", None, None, 100000.0), ("1e100", 1e100, 1e100, 1e100),
         ("1e300", 1e300, 1e300, 1e300), ("1e300x", None, None, 1e300), ("1e400", None, None, None), ("-1e400x", None, None, None),
         ("9" * 320, None, None, None), ("1" + "0" * 200, 1e200, 1e200, 1e200), ("1e-320x", None, None, 0.0), ("2E+03", 2000.0, 2000.0, 2000.0)]
_rows = ", ".join(
    "({}, {})".format(i, ", ".join("cast(null as double)" if v is None else f"cast({v} as double)" for v in e[1:]))
    for i, e in enumerate(_edge))
check(
    "num_parse",
    f"""select p_partkey, loose, loose_zero, prefix,
          round(case when abs(loose) <= 1.5 then loose * 100 else loose end, 6) as percent
        from part join (values {_rows}) as t(i, loose, loose_zero, prefix) on p_partkey % {len(_edge)} = i""",
)
check(
    "earnings_days",
    f"""select symbol, days, case when e > 0 then cast(cast(to_timestamp(e) at time zone 'UTC' as date) as varchar) end as epoch_day,
          {EARN_LABEL} as label
        from (select symbol, datediff('day', {AS_OF}, try_cast(next_earnings_date as date)) as days,
                (ordinal % 5 - 1) * 250000000 + ordinal * 3600 as e from fund)""",
    "fund",
)
# Shares of 32 and 64 are exact in binary, so a decimal cast rounds their ties away from zero.
check(
    "fmt_numbers",
    """select p_partkey,
         cast(cast(cast(p_size as decimal(18, 4)) * 3.125 as decimal(18, 6)) as decimal(18, 1)) || '%' as pct1,
         cast(cast(-cast(p_size as decimal(18, 4)) * 1.5625 as decimal(18, 6)) as decimal(18, 0)) || '%' as pct0,
         format('{:,.1f}', round(p_retailprice * 1000.0 + p_size / 4.0, 1)) as fmt1,
         case when p_size > 3 then format('{:,.2f}', round(p_size / 7.0, 2)) else '–' end as fmt2,
         '$' || format('{:,.2f}', round(p_retailprice * 12.5, 2)) as money
       from part""",
)
check(
    "labels",
    f"""select key as symbol, {SECTOR_LABEL} as sector_label, '기타' as empty_label, {STATUS_LABEL} as status_label,
          sub_industry as unknown_label,
          case when status in ('Very undervalued', 'Undervalued') then 'good' when status = 'Okay' then 'warn'
               when status = 'Need EPS' then 'gray' else 'bad' end as status_class from sc""",
    "sc",
)
check(
    "recent_weekdays",
    """select cast(d as varchar) as as_of, cast(d - cast(i as int) as varchar) as day
       from (select distinct cast(o_orderdate as date) d from orders), range(9) t(i)
       where dayofweek(d - cast(i as int)) not in (0, 6)""",
)
check(
    "universe_symbols",
    """select key as symbol, name, sector, sub_industry, ordinal from listed
       union all select key, name, sector, sub_industry,
         ordinal - (select min(ordinal) from local_l) + (select max(ordinal) from listed) + 1
         from local_l where key not in (select key from listed)
       union all select key, name, sector, sub_industry,
         ordinal - (select min(ordinal) from shared_l) + (select max(ordinal) from listed) + 1
         + (select max(ordinal) - min(ordinal) + 1 from local_l) from shared_l
         where key not in (select key from listed) and key not in (select key from local_l)""",
    "listed",
    "local_l",
    "shared_l",
)
block(
    "odd_sectors",
    """select key, name, case when size = 7 then 'Other' when size = 8 then 'Watchlist'
         when sector = 'Unmapped' then name else sector end as sector from fund""",
    "fund",
)
block("odd", with_defaults("odd_sectors"), "odd_sectors", "defaults")
check(
    "sector_defaults",
    f"select key as symbol, name, sector, eps_growth, rev_growth, gross_margin, op_margin, exit_pe, discount_rate, {RISK_COLS} from odd",
    "odd",
)
check("carry_forward", f"select {CARRIED} from as_util_c", "as_util_c")
check("universe_refresh", f"select {CARRIED} from refreshed", "refreshed")
check("watchlist_sync", f"select {CARRIED}, ordinal from synced", "synced")
check(
    "snapshot_many_files",
    """select key as symbol, round(price * 100 + w, 6) as price from (
         select key, price, unnest([0, 1, 2]) as w, size from fund where price > 0)
       where w = 0 or w = 1 and size > 45 or w = 2 and size <= 4
       qualify row_number() over (partition by key order by w desc) = 1""",
    "fund",
)
check(
    "universe_many_files",
    """select key as symbol, w as name from (
         select key, unnest(['a', 'b', 'c']) as w, size from fund)
       where w = 'c' or w = 'a' and size > 45 or w = 'b' and size <= 4
       qualify row_number() over (partition by key order by w) = 1""",
    "fund",
)
check(
    "watchlist_append",
    f"""select key as symbol, key as name, 'Watchlist' as sector, sub_industry, '{AT}' as added_at, 'dashboard' as source
        from shared_l where key not in (select key from local_l)""",
    "shared_l",
    "local_l",
)
check("wanted_semi", "select key as symbol, round(price, 6) price, ordinal from snap where key in (select key from shared_l)", "snap", "shared_l")
check(
    "coverage_gaps",
    """select 'C.' || c_custkey as symbol, 'no usable price' as reason from customer
       union all
       select 'S.' || s_suppkey, case when s_suppkey in (select l_suppkey from lineitem) then 'no valid close' else 'no usable price' end
       from supplier where s_nationkey <= 4 or s_suppkey not in (select l_suppkey from lineitem)""",
)
check(
    "price_snapshot",
    f"""select key as symbol, round(price, 6) price, date, 'bars' as source, '{AT}' as updated_at,
          r1 return1m, r3 return3m, r4 return4m, r6 return6m, hi high52, lo low52, pos range52, ordinal from snap""",
    "snap",
)
_EXTRAS = "r1 return1m, r3 return3m, r4 return4m, r6 return6m, hi high52, lo low52, pos range52"
check("merge_prices", f"select key as symbol, round(price, 6) price, price_source, {_EXTRAS} from uni_p", "uni_p")
check("merge_fundamentals", f"select {FUNDED}, {RISK_COLS} from merged_null", "merged_null")
check("merge_fundamentals_zero", f"select {FUNDED}, {RISK_COLS} from merged_zero", "merged_zero")
check("merge_fundamentals_fill", f"select {FUNDED}, {RISK_COLS} from merged_fill", "merged_fill")
_any = " or ".join(f"{c} is not null" for c in ("n_eps", "n_rg", "n_eg", "n_gm", "n_om", "n_pe"))
check(
    "merge_counts",
    f"""select count(*) as matched_rows, count(*) filter ({_any}) as usable_rows,
          count(*) filter ({_any} or n_date is not null or n_balance is not null or n_crowding is not null
            or n_cyc is not null or n_margin is not null) as updated_rows
        from offers where key in (select key from uni)""",
    "offers",
    "uni",
)
check("risk_inputs", "select replace(lower(key), '.', '-') as symbol, n_balance as balance, n_crowding as crowding, round(n_cyc, 6) as cyc, n_margin as margin from offers", "offers")
check(
    "overrides",
    f"""select key as symbol, round(price, 6) price, price_source, round(forward_eps, 6) forward_eps,
          round(eps_growth, 6) eps_growth, round(discount_rate, 6) discount_rate, fundamental_auto,
          fundamental_manual, fundamental_source, {RISK_COLS} from st_edit""",
    "st_edit",
)
check("build_stocks", f"select {FUNDED}, round(price, 6) price, pos as range52, is_custom, {RISK_COLS} from st_edit", "st_edit")
check("valuation", "select key as symbol, round(pe_now, 6) current_pe, round(needed, 6) required_growth, round(peg, 6) peg, round(gap, 6) growth_gap from sc", "sc")
check("fair_value", "select key as symbol, round(bear, 6) bear_fv, round(base, 6) base_fv, round(bull, 6) bull_fv, round(up, 6) upside, round(sens, 6) sensitivity from sc", "sc")
check("sector_premium", "select key as symbol, round(pe_now, 6) current_pe, round(case when pe_now is not null then med end, 6) median_pe, round(premium, 6) sector_premium from sec", "sec")
check("pe_percentile", "select key as symbol, sector, round(pe_now, 6) current_pe, round(percentile, 6) pe_percentile from sec", "sec")
check("pe_percentile_all", "select key as symbol, round(percentile, 6) pe_percentile, round(case when pe_now is not null then med end, 6) median_pe from sc", "sc")
check("position52", "select key as symbol, round(place, 6) range_position, round(from_hi, 6) drawdown52_high, round(from_lo, 6) from52_low from clear", "clear")
check(
    "momentum",
    """select symbol, round(coalesce(r4, r3, r1), 6) swing,
         round(coalesce(case when length(symbol) % 2 = 0 then null else r6 end, r3, r1), 6) years3 from m_l""",
    "m_l",
)
check("risk_score", "select key as symbol, round(risk_score, 6) risk_score from sc", "sc")
check("status", "select key as symbol, status from sc", "sc")
check("confidence", "select key as symbol, cast(confidence as double) confidence from sc", "sc")
check(
    "component_scores",
    """select key as symbol, round(s_up, 6) score_upside, round(s_pct, 6) score_percentile, cast(s_peg as double) score_peg,
         cast(s_gap as double) score_gap, round(s_risk, 6) score_risk, round(s_mom, 6) score_momentum from sc""",
    "sc",
)
check("short_score", "select key as symbol, round(score, 6) short_score from sc", "sc")
check(
    "horizon_scores",
    """select a.key as symbol, round(a.score, 6) swing, round(b.score, 6) year1, round(c.score, 6) years3, round(d.score, 6) years5
       from sc a join sc_year1 b on a.key = b.key join sc_years3 c on a.key = c.key join sc_years5 d on a.key = d.key""",
    "sc", "sc_year1", "sc_years3", "sc_years5",
)
check("value_trap", "select key as symbol, trap as value_trap from sc", "sc")
check(
    "factor_scores",
    f"""select key as symbol, round(f_value, 6) factor_value, round(f_growth, 6) factor_growth, round(s_mom, 6) factor_momentum,
          round(f_quality, 6) factor_quality, round(s_risk, 6) factor_risk, {GRADES} from sc""",
    "sc",
)
check("reasons", "select key as symbol, array_to_string(chips, '|') as reasons from sc", "sc")
check(
    "buckets",
    f"""select key as symbol, case when score >= 70 then 'good' when score >= 50 then 'warn' else 'bad' end as score_class,
          case when risk_score >= 3.75 then 'bad' when risk_score >= 2.75 then 'warn' else 'good' end as risk_class,
          {RISK_LABEL} as risk_label,
          case when place is null then '–' when place < 0.20 then '저점권' when place < 0.45 then '낮은 구간'
               when place < 0.75 then '중간' when place < 0.92 then '고점권' else '52주 고점 근처' end as range_label,
          {EARN_LABEL} as earnings_label,
          case when days between 0 and 7 then 'bad' when days <= 14 then 'warn' else 'gray' end as earnings_class,
          case when fundamental_manual then '수동' when fundamental_auto then '자동' else '섹터기본' end as origin
        from sc""",
    "sc",
)
check("scored_all", f"select {SCORED}, days as earnings_days from sc", "sc")
check("scored_own_sector", f"select {SCORED}, days as earnings_days from sec", "sec")
check(
    "visible",
    "select key as symbol, name, sector from st where sector = 'Energy' and (lower(name) like '%red%' or lower(sub_industry) like '%red%')",
    "st",
)
check("status_filter", "select key as symbol, name, round(price, 6) price from ring where status = 'Overvalued'", "ring")
check("status_filter_sector", "select key as symbol, name, round(price, 6) price from hring where status = 'Very undervalued'", "hring")
check("sorted_screen", "select key as symbol, round(pe_now, 6) current_pe from sc", "sc")
_CLASS = "case when status like '%ndervalued' then 'good' when status = 'Okay' then 'warn' when status = 'Need EPS' then 'gray' else 'bad' end"
check(
    "sorted_by_date",
    """select key as symbol, cast(next_earnings_date as varchar) as next_earnings_date,
         row_number() over (order by coalesce(cast(next_earnings_date as varchar), ''), ordinal) - 1 as position from sc""",
    "sc",
)
check("sorted_by_text", f"select key as symbol, status, row_number() over (order by {_CLASS} desc, ordinal) - 1 as position from sc", "sc")
check("sorted_by_flag", "select key as symbol, row_number() over (order by ordinal) - 1 as position from st", "st")
block("found_e", "select * from st where lower(key) like '%e%' or lower(name) like '%e%' or lower(sector) like '%e%' or lower(sub_industry) like '%e%'", "st")
model("jude", "found_e")
check(
    "sorted_by_number",
    """select key as symbol, round(down, 6) as drawdown52_high, row_number() over (order by coalesce(down, -999999), ordinal) - 1 as position
       from (select key, ordinal, case when price <> 0 and hi <> 0 then price / hi - 1 end as down from jude where status = 'Very overvalued')""",
    "jude",
)
model("sring", "found_ring", peers="st")
check(
    "screen_status",
    """select key as symbol, status, round(percentile, 6) pe_percentile, round(score, 6) short_score
       from sring where key in (select key from ring where status = 'Overvalued')""",
    "sring", "ring",
)
check(
    "top30_status",
    f"""select (select count(*) from sc where status = 'Very undervalued') as visible, key as symbol, name, sector, round(price, 6) price,
          round(score, 6) short_score, round(up, 6) upside, round(peg, 6) peg, days as earnings_days, round(place, 6) range_position,
          round(mom, 6) return_h from sc where status = 'Very undervalued' {BEST} limit 30""",
    "sc",
)
check(
    "table_status_sector",
    f"""select key as symbol, name, round(percentile, 6) pe_percentile, round(up, 6) upside, {STATUS_LABEL} as status_label
        from hring where status = 'Very undervalued'""",
    "hring",
)
_order = ", ".join(
    f"('{s}', {i})" for i, s in enumerate(
        ["All", "Watchlist", "Communication Services", "Consumer Discretionary", "Consumer Staples", "Energy", "Financials",
         "Health Care", "Industrials", "Information Technology", "Materials", "Real Estate", "Utilities"]))
check(
    "sector_counts",
    f"""select sector, {SECTOR_LABEL} as label, coalesce(n, 0) as n, cast(coalesce(position, 13) as int) as position from (
          select coalesce(o.sector, c.sector) as sector, c.n, o.position from (values {_order}) as o(sector, position)
          full join (select sector, count(*) n from st group by sector union all select 'All', count(*) from st) c on c.sector = o.sector)""",
    "st",
)
check("todays_picks", f"select {CARD}, array_to_string(chips, '|') as reasons, {GRADES} from sc {BEST} limit 3", "sc")


def heat(src: str) -> str:
    return f"""select sector, {SECTOR_LABEL} as label, n, round(score, 6) as score, round(over_share, 6) as overvalued_share
      from (select sector, count(*) n, median(score) score, min(ordinal) first_seen,
              avg(case when status in ('Overvalued', 'Very overvalued') then 1.0 else 0.0 end) over_share
            from {src} group by sector) order by score desc, first_seen limit 8"""


check("sector_heatmap", heat("sec_bars"), "sec_bars")
check("sector_heatmap_stored", heat("sec"), "sec")
check("signals", f"select {CARD}, array_to_string(chips[1:3], '|') as reasons from util {BEST} limit 3", "util")
check(
    "earnings_alerts",
    f"""select key as symbol, name, cast(next_earnings_date as varchar) next_earnings_date, days as earnings_days,
          {EARN_LABEL} as label, round(mom, 6) return_h, round(score, 6) short_score
        from sc where days between 0 and 14 order by days, key limit 6""",
    "sc",
)
check(
    "risk_alerts",
    f"""select key as symbol, name, trap as value_trap, round(risk_score, 6) risk_score, {RISK_LABEL} as risk_label,
          round(score, 6) short_score from sc where trap <> '' or risk_score >= 3.75 order by score, key limit 4""",
    "sc",
)
check(
    "top30",
    f"""select (select count(*) from visb) as visible, key as symbol, name, sector, round(price, 6) price, round(score, 6) short_score,
          round(up, 6) upside, round(peg, 6) peg, days as earnings_days, round(place, 6) range_position, round(mom, 6) return_h
        from visb {BEST} limit 30""",
    "visb",
)
check(
    "screen_table",
    f"""select key as symbol, name, {SECTOR_LABEL} as sector_label,
          case when fundamental_manual then '수동' when fundamental_auto then '자동' else '섹터기본' end as origin,
          round(price, 6) price, round(place, 6) range_position, round(forward_eps, 6) forward_eps,
          round(eps_growth, 6) eps_growth, round(rev_growth, 6) rev_growth, round(gross_margin, 6) gross_margin,
          round(op_margin, 6) op_margin, round(exit_pe, 6) exit_pe, round(discount_rate, 6) discount_rate,
          round(pe_now, 6) current_pe, round(premium, 6) sector_premium, round(needed, 6) required_growth,
          round(gap, 6) growth_gap, round(peg, 6) peg, round(percentile, 6) pe_percentile, round(mom, 6) return_h,
          round(bear, 6) bear_fv, round(base, 6) base_fv, round(bull, 6) bull_fv, round(up, 6) upside,
          {STATUS_LABEL} as status_label, round(risk_score, 6) risk_score, {RISK_LABEL} as risk_label from sc""",
    "sc",
)
check(
    "summary_cards",
    f"""select (select count(*) from sc) as n, round(median(pe_now), 6) median_pe, round(median(up), 6) median_upside,
          round(avg(case when status in ('Overvalued', 'Very overvalued') then 1.0 else 0.0 end), 6) overvalued_share,
          round(avg(case when risk_score >= 3.75 then 1.0 else 0.0 end), 6) high_risk_share,
          count(*) filter (days between 0 and 14) as earnings_soon,
          (select key from sc {BEST} limit 1) as top_symbol, round(max(score), 6) as top_score,
          (select key from watch order by score desc, ordinal limit 1) as watch_symbol,
          (select round(max(score), 6) from watch) as watch_score from sc""",
    "sc",
    "watch",
)
check("stock_detail", f"select {SCORED} from sec where key = 'P.11'", "sec")
check("top8", f"select {CARD} from sc {BEST} limit 8", "sc")
check("trap4", f"select {CARD}, trap as value_trap from sc where trap <> '' order by score, key limit 4", "sc")
check(
    "watchlist_top",
    """select key as symbol, name, sector, round(score, 6) short_score, round(place, 6) range_position, round(mom, 6) return_h,
         round(up, 6) upside, days as earnings_days from watch order by score desc, ordinal limit 10""",
    "watch",
)
check(
    "constituents_csv",
    """select key as symbol, case size % 3 when 0 then 'The "' || name || '", Inc.' when 1 then name || chr(10) || 'plc' else name end as name,
         sector, sub_industry, ordinal from fund""",
    "fund",
)
check(
    "tickers_csv",
    """select key as symbol, case when size % 2 = 0 then name else key end as name,
         case when size % 5 = 0 then sector else 'Watchlist' end as sector, sub_industry, ordinal from fund""",
    "fund",
)
check(
    "fund_snapshot_csv",
    f"""select key as symbol, forward_eps, trailing_eps, forward_pe, revenue_growth, earnings_growth, gross_margins,
          operating_margins, debt_to_equity, beta, next_earnings_date,
          case when ordinal % 10 = 0 then cast(1004832000 + ordinal % 30 * 86400 as varchar) else '' end as earnings_timestamp,
          'records' as source, '{AT}' as updated_at, ordinal from fund""",
    "fund",
)
check("import_csv", f"select {CARRIED}, sub_industry from mat_blank", "mat_blank")
check("stock_json_roundtrip", f"select {CARRIED}, ordinal from st", "st")
check(
    "state_json_roundtrip",
    f"""select {CARRIED}, cast(-12.5 as double) as threshold from st""",
    "st",
)
check(
    "prices_csv_roundtrip",
    f"""select key as symbol, price, date, source, '{AT}' as updated_at, {_EXTRAS} from snap_bars""",
    "snap_bars",
)
check(
    "price_job_repeated",
    f"""select upper(replace(symbol, '-', '.')) as symbol, round(close, 6) as price, cast(date as varchar) as date,
         'Yahoo EOD via GitHub Actions/yfinance' as source, '{AT}' as updated_at, round(r1, 6) return1m,
         round(r3, 6) return3m, round(r4, 6) return4m, round(r6, 6) return6m, round(hi, 6) high52,
         round(lo, 6) low52, round(pos, 6) range52 from m_once where round(close, 6) > 0""",
    "m_once",
)
check("fundamentals_csv_roundtrip", """select symbol, sector, forward_eps as "forwardEps", '' as beta, '' as error from fund""", "fund")
check(
    "bulk_partitioned",
    """select upper(replace(symbol, '-', '.')) as symbol, round(price, 6) price, cast(date as varchar) date
       from bulk_usable where date = (select max(date) from bulk_usable)""",
    "bulk_usable",
)
check(
    "mixed_folder",
    """select case when k % 6 = 0 then 'chart' when k % 6 in (1, 2) then 'history' when k % 6 = 3 then 'light' else 'list' end as shape,
         upper(replace(symbol, '-', '.')) as symbol, round(price, 6) as price, cast(date as varchar) as date
       from (
         select symbol, k, max(date) filter (k % 6 > 0 or close is not null) as date,
           case when k % 6 = 0 then arg_max(close, date) filter (close is not null)
             when k % 6 in (1, 2, 3) then coalesce(arg_max(close, date) filter (date = last), arg_max(adj_close, date) filter (date = last))
             else arg_max(adj_close, date) filter (date = last) end as price
         from (select *, max(date) over (partition by symbol) as last from sup)
         group by symbol, k)
       where price <> 0 and not (k % 6 = 5 and k % 4 = 1)""",
    "sup",
)
_SETS = (("all", "sc"), ("selected", "util"), ("own_sector", "sec"), ("watchlist", "watch"), ("search", "ring"))
check(
    "peer_sets",
    " union all ".join(f"select key as symbol, '{p}' as peer_set, round(case when pe_now is not null then med end, 6) median_pe, round(percentile, 6) pe_percentile from {b}" for p, b in _SETS),
    *[b for _, b in _SETS],
)
check(
    "scored_for_views",
    " union all ".join(f"select key as symbol, '{p}' as peer_set, status, round(score, 6) short_score, round(premium, 6) sector_premium, trap as value_trap from {b}" for p, b in _SETS),
    *[b for _, b in _SETS],
)
block(
    "st_edit",
    """select * replace (case when sector = 'Energy' and ordinal % 2 = 0 then price * 1.25 else price end as price,
         case when sector = 'Financials' and ordinal % 5 = 0 then 21.0 else eps_growth end as eps_growth)
       from st where not (sector = 'Utilities' and ordinal % 7 = 0)""",
    "st",
)
model("sec_edit", "st_edit", key="coalesce(sector, '')")
check(
    "rescored_changes",
    """select key as symbol, status, round(percentile, 6) pe_percentile, round(score, 6) short_score, round(premium, 6) sector_premium from sec_edit""",
    "sec_edit",
)
check(
    "stock_changes",
    """select coalesce(a.key, b.key) as symbol,
         case when a.key is null then 'inserted' when b.key is null then 'deleted'
           when a.price is distinct from b.price or a.eps_growth is distinct from b.eps_growth then 'changed' else 'unchanged' end as change
       from (select * from st where ordinal % 11 <> 4) a full join (select * from st_edit where ordinal % 11 <> 3) b on a.key = b.key""",
    "st",
    "st_edit",
)
check(
    "sketch_medians",
    """select sector, count(*) as n, true as within_bound from st where price <> 0 and forward_eps > 0 group by sector""",
    "st",
)
check(
    "search_postings",
    " union all ".join(
        f"""select '{q}' as needle, key as symbol from st
        where concat_ws(chr(10), lower(key), lower(name), lower(sector), lower(sub_industry)) like '%{q.strip().lower()}%'"""
        for q in ("7", "ed", " RING ", "e b")
    ),
    "st",
)
check(
    "csv_rejects",
    """select case when fits then symbol end as symbol, case when fits then name || ', Inc.' end as name, case when fits then sector end as sector,
         case ordinal % 11 when 0 then 'too few cells' when 1 then 'too many cells' when 2 then 'blank' else '' end as reason,
         case ordinal % 11 when 0 then symbol || ',' || name when 1 then symbol || ',"' || name || ', Inc.",' || sector || ',more' else '' end as line
       from (select *, ordinal % 11 > 2 as fits from fund)""",
    "fund",
)
check("required_rows", "select cast(count(*) as integer) as n, 'no prices were produced' as said from fund", "fund")
