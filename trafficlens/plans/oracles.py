"""DuckDB SQL for the query catalog, written from the definitions and not from the Spark plans."""

from __future__ import annotations

# fixed values: fingerprints of known automation
JA3 = ("'e7d705a3286e19ea42f587b344ee6865', '5765db2da7f2bfc028a93aca42df2e45', "
       "'b32309a26951912be7dba376398abc3b', '3b5074b1b5d032e5620f69f9f700ff0e'")


def _md5_number(text: str) -> str:
    return f"cast('0x' || substr(md5({text}), 1, 8) as bigint)"


BASE = """
e as (
  select event_id, user_id, event_type, value, ts, epoch_us(ts) as ts_us,
         cast(regexp_extract(props, '[0-9]+', 0) as int) as k,
         row_number() over (partition by user_id order by ts, event_id) as rn
  from events),
c as (
  select *, case user_id % 10 when 0 then 'simple_bot' when 1 then 'scraper'
                              when 2 then 'cred_stuffer' when 3 then 'llm_agent'
                              else 'human' end as traffic_class from e),
r0 as (
  select cast(user_id as varchar) as session_id, event_id as request_id, cast(rn as bigint) as seq, traffic_class,
    case when traffic_class = 'human' then 0 else 1 end as label,
    cast(1700000000000 + case traffic_class
      when 'simple_bot'   then rn * 200  + (k % 10)
      when 'scraper'      then rn * 1500 + k * 10
      when 'cred_stuffer' then rn * 300  + k
      when 'llm_agent'    then rn * 800  + k * 4
      else (ts_us - 1704067200000000) // 10000000 end as double) as timestamp_ms,
    case when traffic_class = 'cred_stuffer' or event_type in ('signup', 'purchase')
         then 'POST' else 'GET' end as method,
    case when traffic_class = 'cred_stuffer' then '/account/login'
         when event_type = 'view'     then concat('/product/', cast(1000 + k % 6 as varchar))
         when event_type = 'click'    then concat('/products/c', cast(k % 4 as varchar), '/')
         when event_type = 'purchase' then '/checkout'
         when event_type = 'signup'   then '/account/register'
         when k % 2 = 0               then concat('/api/search?q=', cast(k as varchar))
         else concat('/static/', cast(k as varchar), '.js') end as url,
    case when traffic_class = 'cred_stuffer' then 401
         when event_type = 'error' and k < 50 then 404
         when event_type = 'error' and k < 70 then 500 else 200 end as status_code,
    case traffic_class when 'simple_bot' then 2 when 'scraper' then 4 else 10 end as n_headers,
    case when traffic_class = 'simple_bot' then 'python-requests/2.31.0'
         when traffic_class = 'scraper' and rn % 7 = 0 then 'Mozilla/5.0 (X11; Linux x86_64)'
         else 'Mozilla/5.0 (Windows NT 10.0; Win64; x64)' end as user_agent,
    concat('10.0.', cast(user_id // 40 as varchar), '.', cast(user_id % 20 as varchar)) as ip,
    cast(200 + k * 18 as bigint) as request_size_bytes,
    cast(5000 + floor(value * 100) as bigint) as response_size_bytes,
    (event_type = 'error' and k % 2 = 0 and traffic_class <> 'cred_stuffer') as is_api,
    case user_id % 9 when 0 then 'AS15169' when 1 then 'AS8075' else 'AS64500' end as asn,
    case traffic_class when 'simple_bot' then '5765db2da7f2bfc028a93aca42df2e45'
         when 'scraper' then 'e7d705a3286e19ea42f587b344ee6865' else 'browser' end as ja3
  from c),
r as (
  select *, case when traffic_class in ('human', 'llm_agent')
                 then lag(url) over (partition by session_id order by seq) end as referrer
  from r0)"""

# requests a hundred times further apart, as sessions of addresses by gap: session_id becomes address@start
SPREAD = """
far as (select *, 1.7e12::double + (timestamp_ms - 1.7e12::double) * 100 as far_ms from near),
gone as (select *, far_ms - lag(far_ms) over (partition by ip order by far_ms, request_id) as pause from far),
parts as (select *, sum(case when pause is null or pause >= 300000 then 1 else 0 end)
            over (partition by ip order by far_ms, request_id rows unbounded preceding) as s_no from gone),
r as (select * replace (ip || '@' || floor(min(far_ms) over (partition by ip, s_no))::bigint as session_id, far_ms as timestamp_ms) from parts)"""

SEQUENCE = """
o as (
  select *, row_number() over w as rn, count(*) over (partition by session_id) as n,
    timestamp_ms - lag(timestamp_ms) over w as gap,
    lag(timestamp_ms) over w - lag(timestamp_ms, 2) over w as gap_before,
    lag(url, 1) over w as p1, lag(url, 2) over w as p2, lag(url, 3) over w as p3,
    lag(url, 4) over w as p4, lag(url, 5) over w as p5
  from r window w as (partition by session_id order by timestamp_ms, request_id))"""

# one row per session, by direct formulas
FEATURES = SEQUENCE + """,
a as (
  select session_id, max(traffic_class) as traffic_class, max(label) as label, max(asn) as asn, max(ip) as ip,
    max(case when rn = 1 then user_agent end) as user_agent,
    max(case when rn = n then url end) as last_url,
    max(timestamp_ms) as end_ms, count(*) as n,
    greatest((max(timestamp_ms) - min(timestamp_ms)) / 1000, 0.001) as dur,
    coalesce(avg(gap), 0) as gm, coalesce(stddev_samp(gap), 0) as gs,
    coalesce(min(gap), 0) as gmin, coalesce(max(gap), 0) as gmax,
    coalesce(avg(case when gap < 100 then 1 when gap is not null then 0 end), 1) as burst,
    coalesce(avg(case when gap < 500 then 1 when gap is not null then 0 end), 0) as short_dwell,
    avg(case when status_code >= 400 then 1 else 0 end) as err,
    avg(case when status_code between 400 and 499 then 1 else 0 end) as e4,
    avg(case when status_code = 404 then 1 else 0 end) as e404,
    avg(case when status_code >= 500 then 1 else 0 end) as e5,
    avg(case when is_api then 1 else 0 end) as api,
    max(len(string_split(rtrim(url, '/'), '/')) - 1) as dmax,
    avg(len(string_split(rtrim(url, '/'), '/')) - 1) as dmean,
    avg(n_headers) as hm, max(case when n_headers = 10 then 1 else 0 end) as sec,
    max(case when n_headers >= 4 then 1 else 0 end) as lang,
    avg(case when method = 'POST' then 1 else 0 end) as post,
    avg(case when method = 'GET' then 1 else 0 end) as get,
    avg(request_size_bytes) as rq, avg(response_size_bytes) as rs,
    coalesce(stddev_samp(response_size_bytes), 0) as rsd,
    avg(case when coalesce(referrer, '') <> '' then 1 else 0 end) as ref,
    sum(case when rn > 3 and (url = p2 or url = p3) then 1 else 0 end) as back,
    sum(case when rn > 1 and url is distinct from p1 and url is distinct from p2 and url is distinct from p3
              and url is distinct from p4 and url is distinct from p5 then 1 else 0 end) as fwd,
    avg(case when rn > 1 and rn - 1 <= n // 2 then gap end) as g1,
    avg(case when rn - 1 > n // 2 then gap end) as g2,
    max(case when status_code >= 400 then rn end) as last_err,
    sum(case when contains(url, 'product') then 1 else 0 end) as k1,
    sum(case when contains(url, 'products') or contains(url, 'category') then 1 else 0 end) as k2,
    sum(case when contains(url, '/api/') then 1 else 0 end) as k3,
    sum(case when contains(url, 'account') or contains(url, 'login') then 1 else 0 end) as k4,
    sum(case when contains(url, 'static') or contains(url, '.js') or contains(url, '.css') then 1 else 0 end) as k5,
    count(distinct url) as nu, count(distinct case when contains(url, '/api/') then url end) as nua,
    count(distinct user_agent) as nagents,
    max(case when rn = 1 then n_headers end) as h1,
    count(distinct string_split(url, '/')[2]) as nsec,
    sum(case when is_api or contains(url, '/api/') then 1 else 0 end) as np,
    count(distinct case when is_api or contains(url, '/api/') then string_split(url, '?')[1] end) as nep
  from o group by session_id),
hu as (
  select session_id, -sum(cnt / tot * log2(cnt / tot + 1e-12)) as uh from (
    select session_id, url, count(*) as cnt, sum(count(*)) over (partition by session_id) as tot
    from r group by session_id, url) group by session_id),
hs as (
  select session_id, -sum(cnt / tot * log2(cnt / tot + 1e-12)) as sh from (
    select session_id, string_split(url, '/')[2] as sec, count(*) as cnt,
           sum(count(*)) over (partition by session_id) as tot
    from r group by session_id, sec) group by session_id),
b as (select a.*, uh, sh, gs / greatest(gm, 1) as dcv from a join hu using (session_id) join hs using (session_id)),
g as (
  select *,
    case when n < 5 then 0 when dcv < 0.05 then 0.3
         when dcv < 0.35 then greatest(0, 1 - abs(dcv - 0.15) / 0.35)
         else greatest(0, 1 - (dcv - 0.35) / 2) end as s_tim,
    case when n < 5 then 0 else least(1, nu / n * (0.7 + 0.3 * (nsec / greatest(nu, 1)))) end as s_cov,
    case when h1 <= 3 then 0.9 when h1 <= 6 then 0.7 when h1 <= 9 then 0.3 else 0.1 end as s_hdr,
    case when nagents > 1 then 0.9
         when regexp_matches(lower(user_agent), 'python|scrapy|curl|wget|java|go-http|okhttp') then 0.95 else 0 end as s_ua,
    case when n < 3 or np = 0 then 0 else least(1, np / n * 3 * (0.5 + 0.5 * nep / np)) end as s_api,
    case when n < 5 then 0 else fwd / (n - 1) end as s_lin
  from b),
f as (
  select *, least(1, (0.2::double * s_tim + 0.2::double * s_cov + 0.15::double * s_hdr + 0.1::double * s_ua
                      + 0.15::double * s_api + 0.1::double * s_lin)
                     + case when n > 20 then least(0.15, (n - 20) / 300) else 0 end) as llm
  from g)"""

# feature -> expression over f
FEATURE_SQL = {
    "http_iat_mean_ms": "gm", "http_iat_std_ms": "gs", "http_iat_cv": "gs / greatest(gm, 1e-6)",
    "http_iat_min_ms": "gmin", "http_iat_max_ms": "gmax",
    "http_rpm_mean": "n / dur * 60", "http_burst_ratio": "burst",
    "http_session_depth": "n", "http_session_duration_s": "dur",
    "http_error_rate": "err", "http_rate_4xx": "e4", "http_rate_404": "e404", "http_rate_5xx": "e5",
    "http_unique_url_ratio": "nu / n", "http_api_ratio": "api", "http_depth_max": "dmax", "http_depth_mean": "dmean",
    "http_url_entropy": "uh",
    "http_header_completeness": "least(hm / 10, 1)", "http_has_sec_fetch": "sec", "http_has_sec_ch_ua": "sec",
    "http_has_accept_language": "lang", "http_header_mean_count": "hm",
    "http_post_ratio": "post", "http_get_ratio": "get",
    "http_req_size_mean": "rq", "http_resp_size_mean": "rs", "http_resp_size_cv": "rsd / greatest(rs, 1)",
    "http_referrer_ratio": "ref",
    "beh_revisit_ratio": "case when n < 2 then 0 else 1 - nu / n end",
    "beh_backtrack_rate": "case when n < 2 then 0 else back / greatest(n - 3, 1) end",
    "beh_n_unique_pages": "case when n < 2 then 0 else nu end",
    "beh_path_entropy": "case when n < 2 then 0 else sh end",
    "beh_dwell_mean_ms": "gm", "beh_dwell_std_ms": "gs", "beh_dwell_cv": "dcv",
    "beh_short_dwell_ratio": "short_dwell",
    "beh_momentum": "case when n // 2 > 1 then (coalesce(g2, 0) - g1) / greatest(g1, 1) else 0 end",
    "beh_content_diversity": """case when n < 2 then 0 else
        ((k1 > 0)::int + (k2 > 0)::int + (k3 > 0)::int + (k4 > 0)::int + (k5 > 0)::int
         + (n - k1 - k2 - k3 - k4 - k5 > 0)::int) / 6 end""",
    "beh_referrer_chain_rate": "case when n < 2 then 0 else ref end",
    "beh_api_rate": "case when n < 2 then 0 else k3 / n end",
    "beh_api_variety": "case when n < 2 then 0 else nua / greatest(k3, 1) end",
    "beh_continued_after_error": "case when n < 2 then 0 else coalesce((n - last_err) / n, 0) end",
    "llm_timing_regularity": "s_tim", "llm_systematic_coverage": "s_cov", "llm_header_anomaly": "s_hdr",
    "llm_ua_mismatch": "s_ua", "llm_api_probing": "s_api", "llm_form_naturalness": "0",
    "llm_session_linearity": "s_lin", "llm_llm_score": "llm",
}

# printf rounds the exact binary value, ties to even
R4 = "cast(printf('%.4f', cast({} as double)) as double)"
DETECT = FEATURES + f""",
d0 as (
  select *, n / dur * 60 as rpm, gs / greatest(gm, 1e-6) as cv,
    regexp_matches(lower(user_agent), 'python|scrapy|curl|wget|java|go-http|okhttp') as bot from f),
d1 as (
  select *,
    case when rpm >= 300 then 0.95 when rpm >= 60 then least(0.70, 0.40::double + 0.30::double * (rpm - 60) / 60) end as r1,
    case when cv < 0.4 then 0.75 * (1 - cv / 0.4::double) end as r2,
    case when e404 > 0.15 then least(0.80, 0.5 + e404) end as r3,
    case when sec = 0 and lang = 0 then 0.70 end as r4,
    case when bot then 0.97 end as r5,
    case when n > 50 then least(0.80, 0.5 + (n - 50) / 200) end as r6,
    case when burst > 0.5 then 0.75 end as r7
  from d0),
d2 as (
  select *, {R4.format("coalesce(greatest(r1, r2, r3, r4, r5, r6, r7), 0)")} as stat,
    coalesce(nullif(concat_ws(' | ',
      case when rpm >= 300 then concat('rpm=', printf('%.0f', rpm), ' (hard block threshold 300.0)')
           when rpm >= 60 then concat('rpm=', printf('%.0f', rpm), ' (warn threshold 60.0)') end,
      case when r2 is not null then concat('iat_cv=', printf('%.3f', cv), ' (too regular, threshold=0.4)') end,
      case when r3 is not null then concat('404_rate=', printf('%.2f', e404)) end,
      case when r4 is not null then 'missing critical browser headers (sec-fetch, accept-language)' end,
      case when r5 is not null then concat('bot user-agent detected: ', user_agent[1:50]) end,
      case when r6 is not null then concat('session_depth=', printf('%.0f', n::double), ' (>50)') end,
      case when r7 is not null then concat('burst_ratio=', printf('%.2f', burst), ' (>0.5)') end), ''), 'CLEAN') as reason,
    case when n >= 3 then {R4.format("llm")} else 0 end as agent,
    case when n < 3 then 'INSUFFICIENT_DATA' when n < 10 then 'LOW' when n < 30 then 'MEDIUM' else 'HIGH' end as conf
  from d1),
d3 as (
  select *, 0.25 * stat + 0.20::double * agent as mean, greatest(stat, agent) as best,
    (stat > 0.5)::int + (agent > 0.5)::int as firing from d2),
d4 as (
  select *, case when best >= 0.95 then greatest(mean, best * 0.95::double) else mean end as lifted from d3),
d as (
  select *, least(greatest(case when firing >= 2 then least(1, lifted * 1.1::double) else lifted end, 0), 1) as risk,
    case when contains(last_url, '/checkout') then 'checkout' when contains(last_url, 'login') then 'login'
         when contains(last_url, 'search') then 'search' else 'general' end as page
  from d4),
x as (
  select *, concat('Statistical=', printf('%.3f', stat), '[', reason[1:40], '] | IF=0.000 | GB=0.000 | LLM=',
                   printf('%.3f', agent), '[', conf, '] | Ensemble=', printf('%.3f', risk), ' | Firing=', firing, '/4')
              as explanation from d),
y as (select session_id, traffic_class, label as y_true, stat as y_score from x)"""

DECIDE = """
  select *, case when free then 'allow'
                 when risk + shift >= 0.85 then 'block' when risk + shift >= 0.70 then 'challenge'
                 when risk + shift >= 0.55 then 'throttle' when risk + shift >= 0.30 then 'monitor'
                 else 'allow' end as action
  from (select *, {context} as page_context, {free} as free,
               case {context} when 'checkout' then -0.10::double when 'login' then -0.10::double
                              when 'search' then 0.05::double else 0 end as shift from x)"""

CURVE = """
p as (select y_score, sum(y_true) as pos, sum(1 - y_true) as neg from y group by y_score),
q as (select *, sum(pos) over s as tp, sum(neg) over s as fp, sum(pos) over () as allp, sum(neg) over () as alln
      from p window s as (order by y_score desc rows unbounded preceding)),
z as (select *, tp / greatest(allp, 1) as tpr, fp / greatest(alln, 1) as fpr, tp / greatest(tp + fp, 1) as prec from q)"""

RATES = {
    "precision": "tp / greatest(tp + fp, 1)", "recall": "tp / greatest(tp + fn, 1)",
    "fpr": "fp / greatest(fp + tn, 1)", "fnr": "fn / greatest(fn + tp, 1)",
    "accuracy": "(tp + tn) / greatest(tp + fp + tn + fn, 1)",
    "f1": "2 * (tp / greatest(tp + fp, 1)) * (tp / greatest(tp + fn, 1))"
          " / greatest(tp / greatest(tp + fp, 1) + tp / greatest(tp + fn, 1), 1e-9)",
}


def _counts(threshold: str) -> str:
    return f"""sum((y_true = 1 and y_score >= {threshold})::int)::bigint as tp,
    sum((y_true = 0 and y_score >= {threshold})::int)::bigint as fp,
    sum((y_true = 0 and y_score < {threshold})::int)::bigint as tn,
    sum((y_true = 1 and y_score < {threshold})::int)::bigint as fn"""


def _t(expression: str, name: str) -> str:
    return f"round(cast({expression} as double), 6) + 0.0 as {name}"


def _with(*parts: str) -> str:
    return "with " + ",".join(parts)


def _family(names: tuple[str, ...]) -> str:
    columns = ", ".join(_t(FEATURE_SQL[n], n) for n in names)
    return f"{_with(BASE, FEATURES)} select session_id, {columns} from f"


ATTACK = """case when regexp_matches({0}, '(?i)(union|select|drop|insert|delete|--|/\\*|''\\s*or)') then 'sql_injection'
  when regexp_matches({0}, '(?i)(<script|javascript:|onerror=|onload=|alert\\()') then 'xss'
  when regexp_matches({0}, '(?i)(\\.\\./|/etc/|/proc/|/windows/)') then 'path_traversal'
  when regexp_matches({0}, '(?i)(;ls|;cat|&&|`|%0a|%0d)') then 'command_injection'
  when regexp_matches({0}, '[^&=]{{500,}}') then 'buffer_overflow' else 'other_anomaly' end"""


def _unit(seed: int, stream: str) -> str:
    return (f"(cast(concat('0x', substr(md5(concat('{seed}:{stream}:', row_no)), 1, 13)) as bigint)::double + 0.5)"
            f" / {16**13}::double")


def _pseudo(seed: int, mean: int, std: int, prefix: str, label: int) -> str:
    return f"""
  select substr(md5(concat('{prefix}.', (sno + 1) // 256 % 256, '.', (sno + 1) % 256, sno * 20)), 1, 12) as session_id,
    concat('{prefix}.', (sno + 1) // 256 % 256, '.', (sno + 1) % 256) as ip,
    row_no, (row_no - 1) % 20 as position, {label} as label,
    case {label} when 0 then 'human' else 'scraper' end as traffic_class,
    first_value(user_agent) over (partition by sno order by row_no) as session_agent,
    1700000000000 + sno * 100000 as start_time_ms,
    sum(case when (row_no - 1) % 20 = 0 then 0 else greatest(100, {mean} + {std}
        * sqrt(-2 * ln({_unit(seed, 'r')})) * cos(2 * pi() * ({_unit(seed, 'a')}))) end)
      over (partition by sno order by row_no) as offset_ms
  from (select *, (row_no - 1) // 20 as sno from (
    select *, row_number() over (order by request_id) as row_no from r where label = {label}))"""


def oracle_sql(families: dict) -> dict[str, str]:
    """SQL per query name; `families` maps family queries to their feature names."""
    base, seq = _with(BASE), _with(BASE, SEQUENCE)
    det = _with(BASE, DETECT)
    cur = _with(BASE, DETECT, CURVE)
    general = DECIDE.format(context="'general'", free="false")
    in_page = DECIDE.format(context="page", free="false")
    listed = DECIDE.format(context="'general'", free="asn in ('AS15169', 'AS8075', 'AS16509')")
    all_features = ", ".join(_t(v, k) for k, v in FEATURE_SQL.items())
    raw_features = ", ".join(f"({v})::double as {k}" for k, v in FEATURE_SQL.items())
    r4 = ", ".join(f"{R4.format(v)} as {k}" for k, v in RATES.items())
    parameters = """case when action = 'throttle' then 2000 else 0 end as delay_ms,
        case when action = 'block' then 3600 else 0 end as block_ttl_s,
        case when action = 'challenge' then 'js_proof_of_work' end as challenge_type"""
    decision = f"""select session_id, {_t('risk', 'risk_score')}, page_context, action,
        case when free then 'allowlisted IP/ASN' when action = 'allow' then 'clean traffic' else explanation end as reason,
        {parameters}"""
    gaps_of_user = """
u as (select cast(user_id as varchar) as user_key, event_id, epoch_us(ts) / 1000 as ms,
             epoch_us(ts) / 1000 - lag(epoch_us(ts) / 1000) over (partition by user_id order by ts, event_id) as gap from events),
v as (select *, sum(case when gap is null or gap >= 300000 then 1 else 0 end)
               over (partition by user_key order by ms, event_id rows unbounded preceding) as session_no from u),
w as (select user_key, session_no::bigint as session_no, count(*) as n_requests, min(ms) as start_ms, max(ms) as end_ms
      from v group by user_key, session_no)"""
    held = f"""{base}, s as (select session_id, max(label) as label from r group by session_id),
held as (select *, row_number() over (order by md5(session_id || ':42'), session_id) as place,
                floor(count(*) over () * 0.2) as n_test from s)"""
    scaled = ", ".join(f"""round(coalesce(({c} - avg({c}) over ()) / nullif(stddev_samp({c}) over (), 0), 0), 4) + 0.0 as {c}""" for c in FEATURE_SQL)
    sql = {name: _family(names) for name, names in families.items()}
    sql |= {
        # sources
        "request_log": f"""{base} select session_id, traffic_class, label, ip, cast(timestamp_ms as bigint) as timestamp_ms,
            method, url, status_code, 80.0::double as response_time_ms, user_agent, is_api::int as is_api,
            request_size_bytes, response_size_bytes, n_headers, (referrer is not null)::int as has_referrer from r""",
        "session_summary": f"""{base} select session_id, count(*) as n_requests,
            cast(max(timestamp_ms) - min(timestamp_ms) as bigint) as duration_ms,
            cast(min(timestamp_ms) as bigint) as start_time_ms, max(traffic_class) as traffic_class, max(label) as label
            from r group by session_id""",
        "nested_sessions": f"""{seq} select session_id, ((rn - 1) // 7)::bigint as part_no, count(*) as n_requests,
            string_agg(url, ' ' order by rn) as urls from o group by session_id, part_no""",
        "http_parse": f"""{base} select request_id, method, url, 'HTTP/1.1' as version, user_agent, '127.0.0.1:8080' as host,
            '' as body from r""",
        "http_blocks": f"""{base} select method, url, user_agent, count(*) as n_blocks from r
            group by method, url, user_agent""",
        "http_normalize": f"""{base} select method, url, user_agent, label,
            case when label = 1 then ([200, 400, 403, 500, 200, 200])[{_md5_number("method || '|' || url || '|' || user_agent || '||42'")} % 6 + 1]
                 else 200 end as status_code, {_md5_number('url')} % 50000 + 5000 as response_size_bytes,
            (contains(url, '/api/') or contains(url, '/rest/') or contains(url, '/json/') or contains(url, '/xml/'))::int as is_api,
            200::bigint as request_size_bytes, 80.0::double as response_time_ms, count(*) as n_requests
            from r group by method, url, user_agent, label""",
        "http_load_labelled": f"""{base} select label, method, user_agent, count(*) as n_requests from r
            group by label, method, user_agent""",
        "attach_body": f"""{base} select method, url, case when method = 'POST' then concat('id=', request_id) else '' end as body,
            request_id from r""",
        "pseudo_sessions": f"""{base} select session_id, ip, row_no, position, label, traffic_class, session_agent,
            start_time_ms, round(offset_ms, 3) + 0.0 as offset_ms from ({_pseudo(42, 2000, 800, '10.1', 0)}
            union all {_pseudo(43, 500, 100, '10.2', 1)})""",
        "cap_requests": f"""{base} select label, request_id, row_no from (
            select label, request_id, row_number() over (partition by label order by request_id) as row_no from r)
            where row_no <= 1000""",
        # projections
        "attack_type": f"""select 'document' as source, doc_id as id, {ATTACK.format('text')} as attack_type from documents
            union all select 'page', page_id, {ATTACK.format("(url || ' ' || html)")} from pages""",
        "attack_breakdown": f"""select attack_type, count(*) as n_requests from (
            select {ATTACK.format('text')} as attack_type from documents
            union all select {ATTACK.format("(url || ' ' || html)")} from pages) group by attack_type""",
        "bot_ua": f"""{base} select request_id, regexp_matches(lower(user_agent),
            'python|scrapy|curl|wget|java|go-http|okhttp')::int as is_bot_agent from r""",
        "label_map": f"""{base} select distinct session_id, traffic_class,
            case traffic_class when 'human' then 0 when 'simple_bot' then 1 when 'scraper' then 2
                 when 'cred_stuffer' then 3 else 4 end as y_multi,
            case traffic_class when 'human' then 0 else 1 end as y_binary from r""",
        "feature_clean": f"""{base} select request_id, case status_code when 404 then 0 when 500 then 1e6 when 401 then -1e6
            else response_size_bytes end::double as value from r""",
        # joins and sets
        "known_ja3": f"{base} select request_id, ja3 from r where ja3 in ({JA3})",
        "unknown_ja3": f"{base} select request_id, ja3 from r where ja3 not in ({JA3})",
        "union_sources": f"""{base} select case label when 0 then 'normal' else 'attack' end as source, label,
            count(*) as n_requests from r group by label""",
        "distinct_pages": f"{base} select distinct session_id, url from r",
        "class_distribution": f"""{base} select traffic_class, count(distinct session_id) as n_sessions from r
            group by traffic_class""",
        "first_n_per_class": f"""{_with(BASE, FEATURES)} select traffic_class, session_id, rank from (
            select traffic_class, session_id, row_number() over (partition by traffic_class
              order by (select min(timestamp_ms) from r where r.session_id = f.session_id), session_id) as rank from f)
            where rank <= 2""",
        # sequence
        "iat": f"""{seq} select session_id, (rn - 1)::bigint as seq, {_t('gap', 'gap_ms')} from o where gap is not null""",
        "backtracks": f"""{seq} select session_id, request_id, rn as seq,
            (rn > 3 and (url = p2 or url = p3))::int as is_backtrack from o""",
        "forward_steps": f"""{seq} select session_id, request_id, rn as seq,
            (rn > 1 and url is distinct from p1 and url is distinct from p2 and url is distinct from p3
             and url is distinct from p4 and url is distinct from p5)::int as is_forward from o""",
        "session_features": f"""{_with(BASE, FEATURES)} select session_id, traffic_class, label, user_agent,
            {all_features} from f""",
        "feature_matrix": f"""{_with(BASE, FEATURES)} select session_id, label as y_binary,
            case traffic_class when 'human' then 0 when 'simple_bot' then 1 when 'scraper' then 2
                 when 'cred_stuffer' then 3 else 4 end as y_multi, 51 as n_features, {all_features} from f""",
        # detectors
        "stat_rules": f"""{det} select session_id, {_t('r1', 'rule_rate')}, {_t('r2', 'rule_regularity')},
            {_t('r3', 'rule_not_found')}, {_t('r4', 'rule_headers')}, {_t('r5', 'rule_agent')},
            {_t('r6', 'rule_depth')}, {_t('r7', 'rule_burst')} from x""",
        "stat_score": f"{det} select session_id, stat as statistical_score from x",
        "stat_reason": f"{det} select session_id, reason as statistical_reason from x",
        "stat_predict": f"{det} select session_id, (stat >= 0.5)::int as prediction from x",
        "llm_detector": f"{det} select session_id, agent as llm_score, conf as llm_confidence from x",
        "llm_predict": f"{det} select session_id, (agent >= 0.5)::int as prediction from x",
        "llm_explain": f"""{det} select session_id, signal, {_t('value', 'value')}, (value > 0.5)::int as is_high,
            case when agent >= 0.5 then 'AGENT' else 'NOT AGENT' end as verdict from (
              unpivot (select session_id, agent, s_tim::double as timing_regularity, s_cov::double as systematic_coverage,
                s_hdr::double as header_anomaly, s_ua::double as ua_mismatch, s_api::double as api_probing,
                0::double as form_naturalness, s_lin::double as session_linearity from x where n >= 3)
              on timing_regularity, systematic_coverage, header_anomaly, ua_mismatch, api_probing, form_naturalness,
                 session_linearity into name signal value value)""",
        "ensemble_no_ml": f"""{det} select session_id, stat as statistical_score, agent as llm_score,
            firing as n_detectors_firing, {_t('risk', 'risk_score')} from x""",
        "ensemble_explain": f"{det} select session_id, explanation from x",
        # mitigation
        "decide": f"{det} {decision} from ({general})",
        "decide_context": f"{det} {decision} from ({in_page})",
        "allowlist": f"{det} {decision} from ({listed})",
        "allowlist_join": f"""{det} select session_id, asn, (asn in ('AS15169', 'AS8075', 'AS16509'))::int as is_allowed from x""",
        "allowlist_cidr": f"""{base}, listed as (
              select n_nationkey * 256 + n_regionkey * 4 as host, 28 + n_regionkey % 3 as bits from nation
              union all select n_nationkey * 256 + n_regionkey * 4 + 1, 32 from nation
              union all select n_nationkey * 256 + n_regionkey * 4, 30 from nation),
            ranges as (select host - host % (1 << (32 - bits)) as low, host - host % (1 << (32 - bits)) + (1 << (32 - bits)) - 1 as high from listed),
            seats as (select session_id, max(ip) as ip from r group by session_id)
            select session_id, ip, exists (select 1 from ranges where cast(string_split(ip, '.')[3] as int) * 256 + cast(string_split(ip, '.')[4] as int)
              between low and high)::int as is_allowed from seats""",
        "distinct_pages_by_days": f"""{base}, dated as (select session_id, url,
              floor((1.7e12::double + (timestamp_ms - 1.7e12::double) * 100000) / 86400000) - floor(1.7e12::double / 86400000) as day_no from r)
            select session_id, count(distinct url) as n_distinct, count(distinct case when day_no < 30 then url end) as n_early
            from dated group by session_id""",
        "features_of_store": f"""{_with(BASE, FEATURES)} select session_id, {', '.join(_t(v, k) for k, v in FEATURE_SQL.items())} from f""",
        "action_summary": f"{det} select action, count(*) as n_decisions from ({in_page}) group by action",
        "repeat_offenders": f"""{det} select ip, session_id, row_number() over (partition by ip order by end_ms, session_id) - 1
            as earlier_blocks from ({general}) where action = 'block'""",
        "block_intervals": f"""{det},
            k as (select ip, end_ms::bigint as t_ms, lag(end_ms::bigint) over (partition by ip order by end_ms) as before
                  from ({general}) where action = 'block'),
            l as (select *, sum(case when before is null or t_ms - before >= 3600000 then 1 else 0 end)
                  over (partition by ip order by t_ms rows unbounded preceding) as island from k)
            select ip, min(t_ms) as blocked_from_ms, max(t_ms) + 3600000 as blocked_until_ms, count(*) as n_blocks
            from l group by ip, island""",
        "live_blocks": f"""{det},
            k as (select ip, end_ms::bigint as t_ms, lag(end_ms::bigint) over (partition by ip order by end_ms) as before
                  from ({general}) where action = 'block'),
            l as (select *, sum(case when before is null or t_ms - before >= 3600000 then 1 else 0 end)
                  over (partition by ip order by t_ms rows unbounded preceding) as island from k),
            i as (select ip, island, min(t_ms) as blocked_from_ms, max(t_ms) + 3600000 as blocked_until_ms,
                         count(*) as n_blocks from l group by ip, island)
            select ip, blocked_from_ms, blocked_until_ms, n_blocks from i
            qualify row_number() over (partition by ip order by island desc) = 1""",
        # evaluation
        "scores_by_class": f"""{det} select traffic_class, {_t('avg(stat)', 'statistical_score')}, 0.0::double as isolation_score,
            0.0::double as gb_score, {_t('avg(agent)', 'llm_score')}, {_t('avg(risk)', 'risk_score')} from x group by traffic_class""",
        "confusion_metrics": f"""{det}, m as (select {_counts('0.5')} from y)
            select tp, fp, tn, fn, {r4}, 0.5::double as threshold from m""",
        "metric_flags": f"""{det}, m as (select {_counts('0.5')} from y), n as (select {r4} from m)
            select fpr, recall, case when fpr > 0.02 then 'HIGH' else 'OK' end as fpr_flag,
            case when recall < 0.90 then 'LOW' else 'OK' end as recall_flag from n""",
        "per_class_metrics": f"""{det}, h as (select traffic_class, count(*) as n, sum((y_score >= 0.5)::int)::bigint as hit
              from y group by traffic_class)
            select traffic_class, n,
              case when traffic_class = 'human' then {R4.format('hit / n')} end as fpr,
              case when traffic_class = 'human' then hit end as false_positives,
              case when traffic_class = 'human' then n - hit end as correctly_allowed,
              case when traffic_class <> 'human' then {R4.format('hit / n')} end as recall,
              case when traffic_class <> 'human' then hit end as detected,
              case when traffic_class <> 'human' then n - hit end as missed from h""",
        "roc_curve": f"""{cur} select y_score as threshold, tp::bigint as tp, fp::bigint as fp, {_t('tpr', 'tpr')},
            {_t('fpr', 'fpr')} from z""",
        "pr_curve": f"""{cur} select y_score as threshold, tp::bigint as tp, fp::bigint as fp, {_t('prec', 'precision')},
            {_t('tpr', 'recall')} from z""",
        "auroc": f"""{cur}, pts as (select tpr, fpr from z union all select 0, 0 union all select 1, 1),
            seg as (select tpr, fpr, lag(tpr) over s as t0, lag(fpr) over s as f0 from pts window s as (order by fpr, tpr))
            select {_t('sum((fpr - f0) * (tpr + t0) / 2)', 'auroc')} from seg""",
        "auprc": f"""{cur}, pts as (select tpr, prec, y_score from z union all select 0, 1, 1e9),
            seg as (select tpr, prec, lag(tpr) over s as t0, lag(prec) over s as p0 from pts
                    window s as (order by y_score desc))
            select {_t('sum((tpr - t0) * (prec + p0) / 2)', 'auprc')} from seg""",
        "threshold_grid": f"""{det}, t as (select 0.1::double + i * ((0.99::double - 0.1::double) / 89) as threshold
              from range(90) g(i)),
            m as (select threshold, {_counts('threshold')} from t, y group by threshold)
            select {_t('threshold', 'threshold')}, tp, fp, tn, fn, {r4} from m""",
        "optimal_threshold": f"""{det}, t as (select 0.1::double + i * ((0.99::double - 0.1::double) / 89) as threshold
              from range(90) g(i)),
            m as (select threshold, {_counts('threshold')} from t, y group by threshold),
            rated as (select threshold, {r4} from m),
            won as (select threshold, recall, fpr from rated where fpr <= 0.01 and recall > 0 order by recall desc, threshold limit 1)
            select {_t('coalesce((select threshold from won), 0.5)', 'threshold')}, (select recall from won) as recall,
              (select fpr from won) as fpr""",
        # extras and windows
        "sessionize_gap": f"""{_with(gaps_of_user)} select user_key, session_no, n_requests,
            {_t('(end_ms - start_ms) / 1000', 'duration_s')} from w""",
        "stream_sessions": f"""{_with(gaps_of_user)}
            select user_key, n_requests, floor(start_ms)::bigint as start_ms, floor(end_ms)::bigint as end_ms from w""",
        "rpm_tumbling": f"""{base}, t as (select session_id, floor(timestamp_ms / 60000) * 60000 as ws from r)
            select session_id, ws::bigint as window_start_ms, count(*) as n_requests, (count(*) > 10)::int as over_limit
            from t group by session_id, ws""",
        "rpm_sliding": f"""{base}, t as (select session_id, (floor(timestamp_ms / 60000) - i) * 60000 as ws from r, range(5) g(i))
            select session_id, ws::bigint as window_start_ms, count(*) as n_requests, (count(*) > 10)::int as over_limit
            from t group by session_id, ws""",
        "stream_rates": """with t as (select user_id, epoch_us(ts) // 60000000 * 60000 as ws from events)
            select user_id, ws as window_start_ms, count(*) as n_requests, (count(*) > 10)::int as over_limit from t
            group by user_id, ws""",
        "iat_histogram": f"""{seq}, h as (select session_id, gap, min(gap) over p as lo, max(gap) over p as hi from o
              where gap is not null window p as (partition by session_id))
            select session_id, case when hi <= lo then 1 else least(20, floor((gap - lo) / ((hi - lo) / 20)) + 1) end::int as bin,
              count(*) as n_gaps from h group by session_id, bin""",
        "url_entropy_last50": f"""{seq}, l as (select session_id, url, count(*) as cnt from o where n - rn < 50 group by session_id, url),
            m as (select *, sum(cnt) over (partition by session_id) as tot from l)
            select session_id, {_t('-sum(cnt / tot * log2(cnt / tot + 1e-12))', 'url_entropy')} from m group by session_id""",
        "missing_headers": f"""{base}, h as (select session_id, request_id, list_filter(
              ['accept', 'accept-encoding', 'accept-language', 'sec-ch-ua', 'sec-fetch-dest'],
              lambda x: not list_contains(case traffic_class when 'simple_bot' then ['accept', 'user-agent']
                when 'scraper' then ['accept', 'accept-language', 'accept-encoding', 'user-agent']
                else ['accept', 'accept-language', 'accept-encoding', 'sec-fetch-dest', 'sec-fetch-mode', 'sec-fetch-site', 'sec-ch-ua',
                      'sec-ch-ua-mobile', 'sec-ch-ua-platform', 'upgrade-insecure-requests'] end, x)) as absent from r)
            select session_id, request_id, len(absent)::int as n_missing, array_to_string(absent, ',') as missing from h""",
        "rpm_zscore": f"""{_with(BASE, FEATURES)}, z as (select session_id, n / dur * 60 as rpm from f)
            select session_id, {_t('rpm', 'rpm')},
              {_t('(rpm - (select avg(rpm) from z)) / (select stddev_samp(rpm) from z)', 'zscore')},
              ((rpm - (select avg(rpm) from z)) / (select stddev_samp(rpm) from z) > 3)::int as is_outlier from z""",
        "consecutive_404s": f"""{seq}, i as (select session_id, rn - row_number() over (partition by session_id order by rn) as island
              from o where status_code = 404),
            l as (select session_id, island, count(*) as len from i group by session_id, island),
            m as (select session_id, max(len) as longest from l group by session_id)
            select session_id, coalesce(longest, 0)::bigint as longest, (coalesce(longest, 0) >= 5)::int as too_many
            from (select distinct session_id from r) left join m using (session_id)""",
        "http_sessions": f"""{base} select label, count(*) as n_requests, ceil(count(*) / 20)::bigint as n_sessions, count(*) as last_row
            from r group by label""",
        "stream_scores": f"""{_with(BASE.replace(chr(10) + "r as (", chr(10) + "near as ("), SPREAD, DETECT)}, k as ({in_page})
            select session_id, n as n_requests, {_t('stat', 'statistical_score')}, {_t('agent', 'llm_score')}, {_t('risk', 'risk_score')},
              page_context, action from k""",
        "load_or_fit": f"""{held} select 'fitted' as call, count(*) - floor(count(*) * 0.6)::bigint as n_sessions, 1 as same_scores from s
            union all select 'loaded', count(*), 1 from s""",
        "train_report": f"""{held} select sum(label)::bigint as n_attack, sum(1 - label)::bigint as n_human, 1 as is_good,
            1 as auprc_in_range from held where place <= n_test""",
        "best_features_fit": "select 30 as n_features, 1 as are_features, 1 as shares_add_up, 1 as refuses_few",
        # models
        "train_test_split": f"""{held} select session_id, label, case when place <= n_test then 'test' else 'train' end as part from held""",
        "seeded_order": f"""{held} select session_id, label, place as row_no from held""",
        "scale_features": f"""{_with(BASE, FEATURES)}, fin as (select session_id, {raw_features} from f)
            select session_id, {scaled} from fin""",
        "iforest": f"""{held} select session_id, label, 1 as isolation_score_in_range, 1 as prediction_fits from held where place <= n_test""",
        "gbt": f"""{held} select session_id, label, label::int as gb_prediction, 1 as gb_score_in_range, 1 as prediction_fits from held where place <= n_test""",
        "model_roundtrip": f"""{held} select session_id, 1 as is_equal from held where place <= n_test""",
        "ensemble": f"""{held}, {DETECT.lstrip()} select session_id, held.label, {_t('stat', 'statistical_score')}, {_t('agent', 'llm_score')},
            1 as risk_score_in_range, 1 as at_least_mean, 1 as override_fits, 1 as firing_fits, 1 as is_explained
            from held join x using (session_id) where place <= n_test""",
        "top_features": """select (i + 1)::int as rank, 1 as is_feature, 1 as is_single, 1 as importance_in_range from range(15) g(i)""",
        "timing_flag": f"""{_with(BASE, FEATURES)} select session_id, (gs < 150)::int as is_regular from f""",
        "regular_runs": f"""{seq}, g as (select session_id, rn, coalesce(abs(gap - gap_before) <= 0.1::double * gap_before, false) as near from o),
            i as (select session_id, rn, rn - row_number() over (partition by session_id order by rn) as island from g where near),
            l as (select session_id, island, count(*) as len from i group by session_id, island),
            m as (select session_id, max(len) as longest from l group by session_id)
            select session_id, coalesce(longest, 0)::bigint as longest, (coalesce(longest, 0) >= 5)::int as is_regular
            from (select distinct session_id from r) left join m using (session_id)""",
        "peak_rpm": f"""{base}, p as (select session_id, count(*) over (partition by session_id order by timestamp_ms
              range between 59999 preceding and current row) as c from r)
            select session_id, max(c) as peak_rpm from p group by session_id""",
    }
    return sql
