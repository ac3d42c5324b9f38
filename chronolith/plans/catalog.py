"""Registered queries of the library, each with DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.functions import rows as rowf
from chronolith.operators import binning, cleaning, encoders, graph, history, metrics, rules, tables
from chronolith.plans.views import EVENTS_SQL, ORDERS, ORDERS_SQL, SCORED_SQL, SPARSE_SQL, events, orders, scored_orders, sparse_orders, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a query under its function's name."""

    def add(function: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[function.__name__] = function
        if sql:
            ORACLE_SQL[function.__name__] = sql
        return function

    return add


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if c in columns else F.col(c) for c in df.columns])


MONTH, QUARTER, HOUR_US = 30 * 86400, 90 * 86400, 3_600_000_000
_ORD = "partition by key order by t, id"
_PRIOR = f"({_ORD} rows between unbounded preceding and 1 preceding)"


def _recent(width: int, x: str = "1", f: str = "count", key: str = "key") -> str:
    """SQL for what the rows of the last ``width`` ticks before this one hold."""
    before = f"(partition by {key} order by t, id rows between unbounded preceding and 1 preceding)"
    old = f"(partition by {key} order by t range between unbounded preceding and {width + 1} preceding)"
    return f"(coalesce({f}({x}) over {before}, 0) - coalesce({f}({x}) over {old}, 0))"


@query(f"""select id, key, t, amt, coalesce(t - lag(t) over ({_ORD}), 0) as time_since_last, round(coalesce(sum(amt) over {_PRIOR}, 0), 2) as cumulative_spend,
{_recent(MONTH)} as tx_count_last_{MONTH}s, round({_recent(MONTH, "amt", "sum")}, 2) as amt_sum_last_{MONTH}s,
round(case when {_recent(MONTH)} > 0 then {_recent(MONTH, "amt", "sum")} / {_recent(MONTH)} else 0 end, 6) as amt_mean_last_{MONTH}s from {ORDERS_SQL}""")
def history_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = history.history_features(orders(spark, sf_dir).drop("y", "prio"), ORDERS, [MONTH])
    return rounded(rounded(found, 2, "cumulative_spend", f"amt_sum_last_{MONTH}s"), 6, f"amt_mean_last_{MONTH}s")


@query(f"""with o as (select * from {ORDERS_SQL}), p as (select a.id, count(b.id) as n, stddev_pop(b.amt) as s, min(b.amt) as lo, max(b.amt) as hi from o a left join o b on a.key = b.key and b.t >= a.t - {QUARTER} and (b.t < a.t or (b.t = a.t and b.id < a.id)) group by a.id)
select id, n as tx_count_last_{QUARTER}s, round(coalesce(s, 0), 3) as amt_std_last_{QUARTER}s, coalesce(lo, 0) as amt_min_last_{QUARTER}s, coalesce(hi, 0) as amt_max_last_{QUARTER}s from p""")
def history_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = history.history_features(orders(spark, sf_dir), ORDERS, [QUARTER], ["count", "std", "min", "max"])
    return rounded(found.select("id", *[c for c in found.columns if f"last_{QUARTER}s" in c]), 3, f"amt_std_last_{QUARTER}s")


@query(f"select id, {_recent(24 * HOUR_US)} as n_day, round({_recent(24 * HOUR_US, 'amt', 'sum')}, 4) as sum_day from {EVENTS_SQL}")
def history_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = history.history_features(events(spark, sf_dir), ORDERS, [24 * HOUR_US], ["count", "sum"])
    return rounded(found.select("id", F.col(f"tx_count_last_{24 * HOUR_US}s").alias("n_day"), F.col(f"amt_sum_last_{24 * HOUR_US}s").alias("sum_day")), 4, "sum_day")


def _expanding(keys: str, name: str) -> str:
    w = f"(partition by {keys} order by t, id rows between unbounded preceding and 1 preceding)"
    return f"count(*) over {w} as \"{name}_amt_count\", round(coalesce(sum(amt) over {w}, 0), 2) as \"{name}_amt_sum\", round(coalesce(avg(amt) over {w}, 0), 6) as \"{name}_amt_mean\", round(coalesce(stddev_samp(amt) over {w}, 0), 3) as \"{name}_amt_std\""


def _rounded_aggregates(found: DataFrame, name: str) -> DataFrame:
    chosen = found.select("id", *[F.col(f"`{name}_amt_{s}`") for s in ("count", "sum", "mean", "std")])
    return rounded(rounded(rounded(chosen, 2, f"{name}_amt_sum"), 6, f"{name}_amt_mean"), 3, f"{name}_amt_std")


@query(f"select id, {_expanding('key', 'key')} from {ORDERS_SQL}")
def agg_prior_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded_aggregates(history.prior_aggregates(orders(spark, sf_dir), ORDERS, [["key"]]), "key")


@query(f"select id, {_expanding('key, prio', 'key+prio')} from {ORDERS_SQL}")
def agg_prior_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = history.prior_aggregates(orders(spark, sf_dir), ORDERS, [["key", "prio"]])
    return _rounded_aggregates(found, "key+prio")


@query(f"select id, count(*) over {_PRIOR.replace('key', 'prio')} as prior_count, round(coalesce(sum(amt) over {_PRIOR.replace('key', 'prio')}, 0), 2) as prior_sum from {ORDERS_SQL}")
def agg_prior_hot_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chronolith.spec import Roles

    found = history.prior_sums_in_chunks(orders(spark, sf_dir), Roles("prio", "t", "id", "amt"), 30 * 86400)
    return rounded(found.select("id", "prior_count", "prior_sum"), 2, "prior_sum")


@query(f"""select id, round(ln(1 + coalesce(amt, 0)), 9) as log_amount, (coalesce(amt, 0) = floor(coalesce(amt, 0)))::int as is_integer_amount, (lag(amt) over ({_ORD}) is null)::int as is_first_trx,
round(coalesce(amt - lag(amt) over ({_ORD}), 0), 4) as amount_delta, round(coalesce(amt / nullif(avg(amt) over {_PRIOR}, 0), 1), 6) as amount_ratio from {SPARSE_SQL}""")
def amount_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = history.amount_features(sparse_orders(spark, sf_dir), ORDERS)
    return found.select("id", F.round("log_amount", 9).alias("log_amount"), "is_integer_amount", "is_first_trx", F.round("amount_delta", 4).alias("amount_delta"), F.round("amount_ratio", 6).alias("amount_ratio"))


@query(f"""with a as (select id, key, t, coalesce(amt - lag(amt) over ({_ORD}), 0) as d, coalesce(t - lag(t) over ({_ORD}), 0) as dt from {ORDERS_SQL}), v as (select *, coalesce(d / nullif(dt, 0), 0) as v from a)
select id, round(v, 7) as velocity, round(coalesce((v - coalesce(lag(v) over ({_ORD}), 0)) / nullif(dt, 0), 0) * 1e6, 4) as acceleration from v""")
def velocity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = history.velocity_features(orders(spark, sf_dir), ORDERS)
    return found.select("id", F.round("velocity", 7).alias("velocity"), F.round(F.col("acceleration") * 1e6, 4).alias("acceleration"))


@query("""with e as (select event_id as id, ts, hour(ts)::int as h from events) select id, h as t_hour, (isodow(ts) - 1)::int as t_dow, (h < 6)::int as is_midnight_flag,
case when h < 6 then 0 when h < 12 then 1 when h < 18 then 2 when h < 22 then 3 else 4 end as time_of_day from e""")
def time_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    seconds = events(spark, sf_dir).select("id", F.floor(F.col("t") / 1_000_000).alias("t"))
    return rowf.time_features(seconds).drop("t")


@query(f"""select id, (card2 is null)::int as card2_missing_flag, 1 as card3_missing_flag, 1 as card5_missing_flag, (addr1 is null)::int as addr1_missing_flag, (addr2 is null)::int as addr2_missing_flag,
coalesce(addr1::varchar, 'NA') || '@' || coalesce(addr2::varchar, 'NA') as addr1_addr2, coalesce(card2::bigint::varchar, 'NA') || '@' || coalesce(addr1::bigint::varchar, 'NA') as "card2@addr1",
coalesce(P_emaildomain, 'NA') || '@' || coalesce(addr1::bigint::varchar, 'NA') as "P_emaildomain@addr1" from {SPARSE_SQL}""")
def card_addr_cross_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = sparse_orders(spark, sf_dir)
    found = rowf.cross_features(rowf.address_features(rowf.card_features(base)), [("card2", "addr1"), ("P_emaildomain", "addr1"), ("absent", "addr1")])
    return found.select("id", *[F.col(f"`{c}`") for c in found.columns if c not in base.columns])


def _in(values: tuple[str, ...]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


@query(f"""with d as (select id, P_emaildomain as e, lower(trim(P_emaildomain)) as m from {SPARSE_SQL}) select id, (e is null)::int as P_emaildomain_missing_flag, coalesce(m in {_in(rowf.DISPOSABLE)}, false)::int as P_emaildomain_is_disposable,
coalesce(m in {_in(rowf.TRUSTED)}, false)::int as P_emaildomain_is_trusted, coalesce(m <> '' and m not in {_in(rowf.DISPOSABLE + rowf.TRUSTED)}, false)::int as P_emaildomain_is_unknown, case when coalesce(m, '') = '' then 'unknown' else m end as P_emaildomain_domain from d""")
def email_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rowf.email_features(sparse_orders(spark, sf_dir).select("id", "P_emaildomain"), "P_emaildomain").drop("P_emaildomain")


_BAD = "('—', '-', '--', 'unknown')"
_OS = {"android": "regexp_matches({}, 'android|build/')", "ios": "contains({}, 'ios')", "windows": "contains({}, 'windows')", "mac": r"regexp_matches({}, '\bmac(\s|os|_)')"}
_HAS = {k: f"coalesce({v.format('e')}, false)" for k, v in _OS.items()}
_CODE = "case when {a} then 0 when contains({x}, 'ios') then 1 when contains({x}, 'windows') then 2 when " + _OS["mac"].format("{x}").replace("{", "{{").replace("}", "}}").replace("{{x}}", "{x}") + " then 3 end"


@query(f"""with c as (select id, case when id_30 not in {_BAD} then id_30 end as o, case when id_31 not in {_BAD} then lower(id_31) end as b, case when DeviceInfo not in {_BAD} then DeviceInfo end as i, lower(DeviceType) as k from {SPARSE_SQL}),
d as (select *, lower(coalesce(o, i)) as e, lower(o) as lo, lower(i) as li from c),
f as (select *, {", ".join(f"{v} as {k}" for k, v in _HAS.items())}, coalesce(contains(b, 'chrome'), false) as chrome, coalesce(contains(b, 'safari'), false) as safari, coalesce(contains(b, 'samsung browser'), false) as samsung, coalesce(contains(b, 'firefox'), false) as firefox, coalesce(contains(b, 'edge'), false) as edge,
 try_cast(nullif(regexp_extract(coalesce(o, i), '(\\d+)', 1), '') as double) as v, try_cast(nullif(regexp_extract(b, '(\\d+)', 1), '') as double) as bv, {_CODE.format(a="contains(lo, 'android')", x="lo")} as co, {_CODE.format(a="regexp_matches(li, 'android|build/')", x="li")} as ci from d)
select id, android::int as device_os_android, ios::int as device_os_ios, windows::int as device_os_windows, mac::int as device_os_macos, (not (android or ios or windows or mac))::int as device_os_unknown, coalesce(k = 'mobile', false)::int as device_type_mobile, coalesce(k = 'desktop', false)::int as device_type_desktop,
 (android::int + ios::int + windows::int + mac::int > 1)::int as dev_multi_os_hit, (o is null and i is not null)::int as id30_missing_but_devinfo_ok, coalesce(co <> ci, false)::int as dev_os_devinfo_mismatch,
 (((android or ios) and coalesce(k = 'desktop', false)) or ((windows or mac) and coalesce(k = 'mobile', false)))::int as dev_os_devicetype_conflict, chrome::int as browser_chrome, safari::int as browser_safari, samsung::int as browser_samsung, firefox::int as browser_firefox, edge::int as browser_edge,
 (not (chrome or safari or samsung or firefox or edge))::int as browser_unknown, ((android or ios or windows or mac) and ((samsung and not android) or (coalesce(contains(b, 'mobile safari'), false) and not ios)))::int as dev_browser_os_mismatch,
 case when v is null then 'none' when v < 8 then 'low' when v < 13 then 'mid' else 'high' end as os_android_ver_tier, case when not ios or v is null then 'none' when v < 12 then 'low' when v < 16 then 'mid' else 'high' end as os_ios_ver_tier, case when not chrome or bv is null then 'none' when bv < 80 then 'low' when bv < 100 then 'mid' else 'high' end as browser_chrome_ver_tier, v as os_android_ver_major, case when ios then v end as os_ios_ver_major, case when chrome then bv end as browser_chrome_ver_major,
 coalesce((android and v <= 7) or (ios and v <= 11), false)::int as os_is_very_old, coalesce(length(i), 0)::int as devinfo_str_len, coalesce(contains(li, 'build/'), false)::int as devinfo_has_build_tag, coalesce(contains(li, 'samsung'), false)::int as devinfo_has_samsung, coalesce(contains(li, 'iphone'), false)::int as devinfo_has_iphone,
 case when i is null then -1 else cast(('0x' || substr(md5(i), 31, 2)) as int) % 64 end as devinfo_hash_bucket, (o is null and b is null and i is null)::int as device_info_missing from f""")
def device_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = sparse_orders(spark, sf_dir).select("id", "id_30", "id_31", "DeviceInfo", "DeviceType")
    return rowf.device_features(base.withColumnRenamed("id", "row")).drop("id_30", "id_31", "DeviceInfo", "DeviceType").withColumnRenamed("row", "id")


@query(f"""select id, (amt is null)::int as amt_missing_flag, (card2 is null)::int as card2_missing_flag, (id_30 is null)::int as id_30_missing_flag, (amt is null)::int + (card2 is null)::int + (id_30 is null)::int as total_missing_count, (id_30 is null)::int as id_cols_missing_count from {SPARSE_SQL}""")
def missing_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = sparse_orders(spark, sf_dir).select("id", "key", "amt", "card2", "id_30")
    state = encoders.fit_missing_pattern(base, ["key", "amt", "card2", "id_30"])
    return encoders.missing_pattern(base, state).drop("key", "amt", "card2", "id_30")


_SPLIT = f"(select *, row_number() over (order by t, id) - 1 >= count(*) over () - floor(count(*) over () * 0.2) as is_val from {ORDERS_SQL})"


@query(f"select id, is_val from {_SPLIT}")
def time_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.time_split(orders(spark, sf_dir), ["t", "id"], 0.2).select("id", "is_val")


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    from chronolith.storage import written

    split = written(tables.time_split(orders(spark, sf_dir), ["t", "id"], 0.2), "split")
    return split.where("not is_val").drop("is_val"), split.where("is_val").drop("is_val")


@query(f"""with s as {_SPLIT}, g as (select avg(y::double) as o from s where not is_val), m as (select prio as c, count(*) as n, avg(y::double) as p from s where not is_val group by prio), u as (select key as c, count(*) as n, avg(y::double) as p from s where not is_val group by key)
select id, round(coalesce((m.n * m.p + 100 * o) / (m.n + 100), o), 9) as prio_te, round(coalesce(case when u.n < 12 then o else (u.n * u.p + 100 * o) / (u.n + 100) end, o), 9) as key_te from s cross join g left join m on s.prio = m.c left join u on s.key = u.c where is_val""")
def target_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, val = _halves(spark, sf_dir)
    out = encoders.target_encode(val, encoders.fit_target_encoding(train, "prio", "y"), "prio")
    out = encoders.target_encode(out, encoders.fit_target_encoding(train, "key", "y", min_samples=12), "key")
    return out.select("id", F.round("prio_te", 9).alias("prio_te"), F.round("key_te", 9).alias("key_te"))


@query(f"""with s as {_SPLIT}, c as (select k, row_number() over (order by k) - 1 as code from (select distinct key::varchar as k from s where not is_val)) select id, coalesce(code, -1)::int as key_label from s left join c on s.key::varchar = c.k where is_val""")
def label_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, val = _halves(spark, sf_dir)
    return encoders.label_encode(val, encoders.fit_label_encoding(train, "key"), "key").select("id", "key_label")


@query(f"""with s as {_SPLIT}, u as (select key::varchar || '_-1' as uid, count(amt) as n, avg(amt) as m, stddev_samp(amt) as d, min(amt) as lo, max(amt) as hi, max(t) as last, count(*) / (select count(*) from s where not is_val)::double as f from s where not is_val group by key),
v as (select *, key::varchar || '_-1' as uid from s where is_val), c as (select *, {_recent(MONTH)} as r, (select min(t) from v) as first_t from v)
select id, c.uid, coalesce(n, 0) as uid_txn_count, round(m, 6) as uid_amt_mean, round(d, 3) as uid_amt_std, lo as uid_amt_min, hi as uid_amt_max, round(coalesce(f, 0), 9) as uid_freq, (u.uid is null)::int as uid_is_new, greatest(t - coalesce(last, first_t), 0) as uid_time_since_last, round(coalesce(case when d > 0 then (amt - m) / d end, 0), 6) as uid_amt_zscore, r as uid_txn_count_{MONTH}s from c left join u on c.uid = u.uid""")
def uid_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, val = _halves(spark, sf_dir)
    columns = ["key", "absent"]
    found = encoders.uid_features(val, encoders.fit_uid(train, ORDERS, columns), ORDERS, columns, [MONTH]).drop("key", "t", "amt", "y", "prio")
    return rounded(rounded(rounded(rounded(found, 6, "uid_amt_mean"), 3, "uid_amt_std"), 9, "uid_freq"), 6, "uid_amt_zscore")


@query("select o_orderkey, o_custkey, o_totalprice, c_nationkey, c_mktsegment from orders left join customer on o_custkey = c_custkey")
def identity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    return tables.join_side_table(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), side, "o_custkey", "c_custkey").drop("c_custkey")


@query(f"""with b as (select id, amt, addr1 from {SPARSE_SQL}), q as (select quantile_cont(amt, 0.01) as a1, quantile_cont(amt, 0.5) as a5, quantile_cont(amt, 0.99) as a9, quantile_cont(addr1, 0.01) as d1, quantile_cont(addr1, 0.5) as d5, quantile_cont(addr1, 0.99) as d9 from b)
select id, least(greatest(coalesce(amt, a5), a1), a9) as amt, (amt is null)::int as amt_isna, coalesce(amt < a1, false)::int as amt_clip_low, coalesce(amt > a9, false)::int as amt_clip_high, least(greatest(coalesce(addr1, d5), d1), d9) as addr1, (addr1 is null)::int as addr1_isna, coalesce(addr1 < d1, false)::int as addr1_clip_low, coalesce(addr1 > d9, false)::int as addr1_clip_high from b, q""")
def winsorize(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = sparse_orders(spark, sf_dir).select("id", "amt", "addr1", F.lit(1).alias("same"))
    return cleaning.clean(base, cleaning.fit_cleaner(base, exclude=["id"]))


def _profile(c: str, kind: str, numeric: bool) -> str:
    x = f"{c}::double" if numeric else "null::double"
    return f"select '{c}' as \"column\", '{kind}' as dtype, round(avg(({c} is null)::int), 4) as missing_rate, count(distinct {c}) + max(({c} is null)::int) as unique_count, round(avg({x}), 4) as mean, round(stddev_samp({x}), 3) as std, min({x}) as min, max({x}) as max, quantile_cont({x}, 0.25) as q25, quantile_cont({x}, 0.5) as q50, quantile_cont({x}, 0.75) as q75 from {SPARSE_SQL}"


@query(" union all ".join(_profile(c, k, n) for c, k, n in (("amt", "double", True), ("card2", "bigint", True), ("id_30", "string", False), ("y", "int", True))))
def profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rounded(cleaning.profile(sparse_orders(spark, sf_dir).select("amt", "card2", "id_30", "y")), 4, "mean"), 3, "std")


@query(" union all ".join(f"select '{c}' as feature, avg(({c} is null)::int) as missing_rate, count(distinct {c}) as n_unique, round(avg({c}), 4) as mean, round(stddev_pop({c}), 3) as std, min({c})::double as min_value, max({c})::double as max_value, quantile_cont({c}::double, 0.5) as p50, quantile_cont({c}::double, 0.95) as p95 from {SPARSE_SQL}" for c in ("amt", "addr1")))
def feature_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rounded(cleaning.feature_stats(sparse_orders(spark, sf_dir), ["amt", "addr1"]), 4, "mean"), 3, "std")


def _woe(c: str) -> str:
    return f"""select *, ln(bp / gp) as w from (select '{c}' as feature, bin, n, bad, n - bad as good, case when bad = 0 then 1e-10 else bad / ab end as bp, case when n - bad = 0 then 1e-10 else (n - bad) / ag end as gp from (
select bin, n, bad, sum(bad) over ()::double as ab, sum(n - bad) over ()::double as ag from (select greatest(len(list_filter(e, lambda x: x < v)) - 1, 0) as bin, count(*) as n, sum(y) as bad from (select {c}::double as v, y from {SPARSE_SQL} where {c} is not null) r, (select list_sort(list_distinct(quantile_cont({c}::double, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) as e from {SPARSE_SQL}) q group by 1)))"""


@query(f"select feature, bin::int as bin, n as count, bad::bigint as bad, good::bigint as good, round(bad / n, 9) as bad_rate, round(gp, 9) as good_pct, round(bp, 9) as bad_pct, round(w, 7) as woe, round((bp - gp) * w, 9) as iv_component from ({_woe('amt')} union all {_woe('addr1')})")
def woe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = binning.woe_table(sparse_orders(spark, sf_dir), ["amt", "addr1"], "y")
    return rounded(rounded(found, 9, "bad_rate", "good_pct", "bad_pct", "iv_component"), 7, "woe")


@query(f"select feature, round(sum((bp - gp) * w), 6) as iv, round(sum((bp - gp) * w), 6) >= 0.02 as useful from ({_woe('amt')} union all {_woe('addr1')} union all {_woe('card2')}) group by feature")
def iv_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binning.information_values(sparse_orders(spark, sf_dir), ["amt", "addr1", "card2"], "y")


def _psi(c: str) -> str:
    return f"""select '{c}' as feature, sum((pe - pa) * ln(pe / pa)) as psi from (select case when coalesce(e, 0) = 0 then 1e-4 else e / sum(e) over () end as pe, case when coalesce(a, 0) = 0 then 1e-4 else a / sum(a) over () end as pa from (
select least(len(list_filter(q, lambda x: x <= v)) - 1, len(q) - 2) as bin, sum((not is_val)::int)::double as e, sum(is_val::int)::double as a from (select {c}::double as v, is_val from {_SPLIT}) r, (select list_sort(list_distinct(quantile_cont({c}::double, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) as q from {_SPLIT} where not is_val) where v between q[1] and q[-1] group by 1))"""


@query(f"select feature, round(psi, 7) as psi, psi > 0.25 as drifted from ({_psi('amt')} union all {_psi('key')})")
def psi_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, val = _halves(spark, sf_dir)
    return rounded(binning.stability(train, val, ["amt", "key"]), 7, "psi")


_CUM = f"(select p, sum(y) as pos, sum(1 - y) as neg, sum(sum(y)) over (order by p desc) as cp, sum(sum(1 - y)) over (order by p desc) as cn, sum(sum(y)) over () as ap, sum(sum(1 - y)) over () as an from {SCORED_SQL} group by p)"


@query(f"select round(sum(pos * (an - cn + neg / 2.0)) / max(ap * an)::double, 9) as auc from {_CUM}")
def roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.roc_auc(scored_orders(spark, sf_dir), "p", "y"), 9, "auc")


@query(f"select round(sum(pos * cp / (cp + cn)::double) / max(ap), 9) as ap from {_CUM}")
def avg_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.average_precision(scored_orders(spark, sf_dir), "p", "y"), 9, "ap")


@query(f"select round(max(abs(cp / ap::double - cn / an::double)), 9) as ks from {_CUM}")
def ks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.kolmogorov_smirnov(scored_orders(spark, sf_dir), "p", "y"), 9, "ks")


@query(f"select round(avg((p - y) * (p - y)), 9) as brier, round(-avg(y * ln(q) + (1 - y) * ln(1 - q)), 9) as logloss from (select *, least(greatest(p, 1e-15), 1 - 1e-15) as q from {SCORED_SQL})")
def brier_logloss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.probability_metrics(scored_orders(spark, sf_dir), "p", "y"), 9, "brier", "logloss")


@query(f"select round(sum(n * abs(m - s)) / sum(n), 9) as ece from (select least(floor(p * 10), 9) as b, count(*) as n, avg(p) as m, avg(y) as s from {SCORED_SQL} group by 1)")
def ece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.calibration_error(scored_orders(spark, sf_dir), "p", "y"), 9, "ece")


@query(f"select tp::bigint as tp, fp::bigint as fp, fn::bigint as fn, tn::bigint as tn, tp / (tp + fp)::double as precision, tp / (tp + fn)::double as recall, round(2 * tp / (2 * tp + fp + fn)::double, 9) as f1 from (select sum((p >= 0.5 and y = 1)::int) as tp, sum((p >= 0.5 and y = 0)::int) as fp, sum((p < 0.5 and y = 1)::int) as fn, sum((p < 0.5 and y = 0)::int) as tn from {SCORED_SQL})")
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.confusion(scored_orders(spark, sf_dir), F.col("p") >= 0.5, "y"), 9, "f1")


@query(f"select sum(y)::bigint as pos, sum(1 - y)::bigint as neg, sum(1 - y) / greatest(sum(y), 1)::double as pos_weight from {SCORED_SQL}")
def class_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.class_balance(scored_orders(spark, sf_dir), "y")


@query(f"select n as n_top, round(avg(y), 9) as precision from (select y, row_number() over (order by p desc, id) as k, greatest(1, floor(count(*) over () * 0.05))::bigint as n from {SCORED_SQL}) where k <= n group by n")
def precision_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.precision_at(scored_orders(spark, sf_dir), "p", "y", "id"), 9, "precision")


_CURVE = f"(select t as threshold, sum((p >= t and y = 1)::int) as tp, sum((p >= t and y = 0)::int) as fp, sum((p < t and y = 1)::int) as fn from {SCORED_SQL}, (select round(i / 100.0, 10)::double as t from range(1, 100) r(i)) group by t)"


@query(f"select threshold, tp::bigint as tp, fp::bigint as fp, fn::bigint as fn, fp * 10.0 + fn * 500.0 as cost, coalesce(tp / nullif(tp + fp, 0)::double, 0) as precision, tp / (tp + fn)::double as recall from {_CURVE}")
def threshold_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.threshold_costs(scored_orders(spark, sf_dir), "p", "y")


@query(f"with g as (select round(0.01 + i * 0.02, 10)::double as t from range(0, 50) r(i)), h as (select t, sum((p > t and y = 0)::int) as fp, sum((p <= t and y = 1)::int) as fn from {SCORED_SQL}, g group by t) select g.t as low, h.t as high, fp * 10.0 + fn * 500.0 as cost from h, g where g.t < h.t order by cost, low, high limit 1")
def tier_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.best_tiers(scored_orders(spark, sf_dir), "p", "y")


@query(f"select id, case when p < 0.3 then 'low' when p > 0.7 then 'high' else 'medium' end as risk_level, case when p < 0.3 then 'auto_pass' when p > 0.7 then 'auto_block' else 'manual_review' end as action, round(case when p < 0.3 then 1 - p when p > 0.7 then p else 1 - 2 * abs(p - 0.5) end, 9) as confidence from {SCORED_SQL}")
def tier_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.assign_tiers(scored_orders(spark, sf_dir), "p", 0.3, 0.7).drop("y", "p"), 9, "confidence")


@query(f"select n_low::bigint as n_low, n_medium::bigint as n_medium, n_high::bigint as n_high, tp::bigint as tp, fp::bigint as fp, fn::bigint as fn, fp * 10.0 + fn * 500.0 as cost, tp / greatest(tp + fp, 1)::double as precision, tp / greatest(tp + fn, 1)::double as recall from (select sum((p < 0.3)::int) as n_low, sum((p between 0.3 and 0.7)::int) as n_medium, sum((p > 0.7)::int) as n_high, sum((p > 0.7 and y = 1)::int) as tp, sum((p > 0.7 and y = 0)::int) as fp, sum((p <= 0.7 and y = 1)::int) as fn from {SCORED_SQL})")
def tier_evaluate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.evaluate_tiers(scored_orders(spark, sf_dir), "p", "y", 0.3, 0.7)


@query(f"""with n as (select id, row_number() over (order by t, id) - 1 as k, count(*) over () as c, count(*) over () // 6 as s from {ORDERS_SQL}), f as (select n.*, i as fold, s * i as a, s * i + 10 as v, case when i = 5 then c else s * (i + 1) end as b from n, range(1, 6) r(i))
select id, fold::int as fold, k >= v and k < b as is_val from f where k < a or (k >= v and k < b)""")
def purged_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.purged_folds(orders(spark, sf_dir), ["t", "id"], 5, 10).select("id", "fold", "is_val")


_RULED = f"""(with l as (select c_custkey::varchar as v from customer where c_custkey % 97 = 0), o as (select *, key::varchar in (select v from l) as blocked from {ORDERS_SQL}), w as (select *, {_recent(MONTH * 12)} + 1 as n from o where not blocked),
x as (select id, key, t, amt, 'blacklist' as rule, 'block' as rule_action from o where blocked union all select id, key, t, amt, case when n > 3 then 'velocity' when amt > 300000 then 'amount' end, case when n > 3 or amt > 300000 then 'challenge' end from w) select * from x)"""


def _ruled(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = table(spark, sf_dir, "customer").where("c_custkey % 97 = 0").select(F.col("c_custkey").alias("value"))
    engine = rules.RuleEngine([rules.Blacklist("key", listed), rules.Velocity(MONTH * 12, 3), rules.Amount(300000.0)])
    return engine.evaluate(orders(spark, sf_dir).select("id", "key", "t", "amt"), ORDERS)


@query(f"select id, rule, rule_action from {_RULED}")
def rules_engine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ruled(spark, sf_dir).select("id", "rule", "rule_action")


@query(f"""with s as (select *, round(((id * 7919) % 10007) / 10007.0, 4) as m from {_RULED}), q as (select *, case rule_action when 'block' then 1.0 when 'challenge' then 0.5 else m end::double as p from s)
select id, p as probability, case when p >= 0.8 then 'high' when p >= 0.4 then 'medium' else 'low' end as risk_level, case when p >= 0.8 then 'auto_block' when p >= 0.4 then 'manual_review' else 'auto_pass' end as action, case when rule is null then 'model' else 'rule' end as decision_source from q""")
def rules_then_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _ruled(spark, sf_dir).withColumn("score", F.round(((F.col("id") * 7919) % 10007) / 10007.0, 4))
    return rules.decide(scored, "score").select("id", "probability", "risk_level", "action", "decision_source")


@query(f"select id, {_recent(24 * HOUR_US)} + 1 as n_recent, {_recent(24 * HOUR_US)} + 1 > 5 as fires from {EVENTS_SQL}")
def rules_velocity(spark: SparkSession, sf_dir: str) -> DataFrame:
    applied, action = rules.Velocity(24 * HOUR_US, 5).apply(events(spark, sf_dir), ORDERS)
    return applied.select("id", F.col("_recent").alias("n_recent"), action.isNotNull().alias("fires"))


def _entity(e: str) -> str:
    return f"case when {e} is null then 0 else coalesce(sum(y) over (partition by {e} order by t, id rows between unbounded preceding and 1 preceding), 0)::bigint end as {e}_fraud_count, case when {e} is not null then min(t) over (partition by {e}) end as {e}_first_seen_dt, case when {e} is not null then t - min(t) over (partition by {e}) end as {e}_time_since_first"


@query(f"select id, {_entity('key')}, {_entity('addr1')} from {SPARSE_SQL}")
def graph_entity_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = graph.entity_history(sparse_orders(spark, sf_dir).select("id", "key", "t", "y", "addr1"), ORDERS, ["key", "addr1"])
    return found.drop("key", "t", "y", "addr1")


@query(f"""with f as (select id, key, t, (addr2 is not null and row_number() over (partition by key, addr2 order by t, id) = 1)::int as a, (P_emaildomain is not null and row_number() over (partition by key, P_emaildomain order by t, id) = 1)::int as m, (id_30 is not null and row_number() over (partition by key, id_30 order by t, id) = 1)::int + (DeviceType is not null and row_number() over (partition by key, DeviceType order by t, id) = 1)::int as d from {SPARSE_SQL})
select id, coalesce(sum(a) over {_PRIOR}, 0)::bigint as key_unique_addr2, coalesce(sum(m) over {_PRIOR}, 0)::bigint as key_unique_email, coalesce(sum(d) over {_PRIOR}, 0)::bigint as key_unique_device, coalesce(sum(a + m + d) over {_PRIOR}, 0)::bigint as key_entity_diversity from f""")
def graph_distinct_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = sparse_orders(spark, sf_dir).select("id", "key", "t", "addr2", "P_emaildomain", "id_30", "DeviceType")
    found = graph.distinct_before(base, ORDERS, {"addr2": ["addr2"], "email": ["P_emaildomain"], "device": ["id_30", "DeviceType"]})
    return found.select("id", *[c for c in found.columns if c.startswith("key_")])


@query()
def component_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = events(spark, sf_dir).select("id", "key", "t", F.when(F.col("id") % 4 == 0, F.concat_ws("-", "kind", (F.col("key") % 40).cast("string"))).alias("kind"))
    return graph.component_size(base, ORDERS, ["kind"]).select("id", "component_size")


@query()
def component_size_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = sparse_orders(spark, sf_dir).select("id", "key", "t", "addr1", "P_emaildomain")
    return graph.component_size(base, ORDERS, ["addr1", "P_emaildomain"]).select("id", "component_size")
