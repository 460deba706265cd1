"""Aggregates, sequences and joins over logs: events (session = user_id) and conversations (session = conv_id)."""

from __future__ import annotations

from .dialect import both

# --- sources and parsing -------------------------------------------------------------------------------------------

both("S1_entry_counts", "select event_type as entry_type, count(*) as n, count(distinct user_id) as sessions from {events} group by event_type")
both(
    "S4_parse_stats",
    """select count(*) as lines_processed, count(*) filter (where trim(props) = '') as empty_lines,
    count(*) filter (where @is_json(props)) as entries_parsed,
    count(*) filter (where trim(props) <> '' and not (@is_json(props))) as lines_skipped,
    round(100e0 * count(*) filter (where @is_json(props)) / count(*), 4) as success_rate from {events}""",
)
both(
    "S9_session_state",
    """select user_id, case when age < 5 then 'possibly_active' when age < 60 then 'recently_active' else 'inactive' end as state from (
    select user_id, cast(@us(timestamp '2024-01-31 00:00:00') - max(@us(ts)) as double) / 1e6 as age from {events} group by user_id) x""",
)
both(
    "S15_session_metadata",
    """select user_id, count(*) as entries, count(*) filter (where event_type = 'click') as clicks, count(*) filter (where event_type = 'error') as errors,
    min(@us(ts)) as start_us, max(@us(ts)) as end_us, cast(sum(@bytes(props)) as bigint) as payload_bytes from {events} group by user_id""",
)
both("S16_first_value", "select user_id, @first_by(event_type, ts) as first_type, @last_by(event_type, ts) as last_type from {events} group by user_id")
both(
    "S29_format_sniff",
    """select page_id, case when @like_re(html, '^\\s*<!(DOCTYPE|doctype)') then 'document' when @like_re(html, '^\\s*<') then 'fragment' else 'unknown' end as format from {pages}""",
)
both("S32_vocabulary_census", "select role, count(*) as n, min(conv_id) as first_conv, max(conv_id) as last_conv, count(distinct conv_id) as sessions from {conversations} group by role")

# --- filters ---------------------------------------------------------------------------------------------------------

both("F1_session_filter", "select user_id, count(*) as entries from {events} group by user_id having count(*) >= 60 and max(ts) >= timestamp '2024-01-30 00:00:00'")
both("F2_project_filter", "select doc_id, source from {documents} where lower(source) like '%rc1%' and n_chars >= 500")
both("F4_period", "select count(*) as n, count(distinct user_id) as sessions from {events} where ts >= timestamp '2024-01-31 00:00:00' - interval '7' day")
both(
    "F6_overlap",
    """select user_id from (select user_id, min(ts) as a, max(ts) as b from {events} group by user_id) x
    where a <= timestamp '2024-01-03 00:00:00' and b >= timestamp '2024-01-29 12:00:00'""",
)
both("F7_entry_filter", "select event_id, user_id, value from {events} where event_type = 'error' and value between 5 and 20 and cast(@json(props, k) as int) < 50")
both(
    "F9_human_prompts",
    """select conv_id, turn, length(text) as chars from {conversations} where role = 'user' and trim(text) <> '' and not @like_re(text, '^\\s*<')""",
)
both("F13_exclude_pattern", "select doc_id from {documents} where lang = 'en' and not @like_re(lower(text), 'license|copyright')")
both("F14_errors_only", "select event_id, user_id from {events} where event_type = 'error'")
both("F17_prompt_filters", "select distinct text from {conversations} where role = 'user' and length(text) >= 100 and not @like_re(text, '[0-9]')")

# --- aggregates ------------------------------------------------------------------------------------------------------

both("A1_usage_merge", "select user_id, sum(value) as total, cast(sum(cast(@json(props, k) as bigint)) as bigint) as k_total, count(*) as n from {events} group by user_id")
both(
    "A2_turn_dedup",
    """select user_id, count(*) as turns, sum(most) as tokens from (
    select user_id, date_trunc('hour', ts) as h, max(value) as most from {events} group by user_id, date_trunc('hour', ts)) x group by user_id""",
)
both(
    "A3_token_totals",
    """select user_id, round(sum(case when event_type = 'view' then value else 0 end), 4) as input_tokens, round(sum(case when event_type = 'click' then value else 0 end), 4) as output_tokens,
    round(sum(value), 4) as total_tokens, round(sum(case when event_type <> 'signup' then value else 0 end), 4) as work_tokens from {events} group by user_id""",
)
both(
    "A4_cache_hit_rate",
    """select user_id, case when a + b = 0 then 0 else round(100e0 * b / (a + b), 4) end as hit_rate, case when a = 0 then null else round(cast(b as double) / a, 4) end as efficiency from (
    select user_id, count(*) filter (where event_type = 'signup') as a, count(*) filter (where event_type = 'view') as b from {events} group by user_id) x""",
)
both(
    "A5_cost_buckets",
    """with rates(event_type, rate) as (select * from (values ('click', 3.0e0), ('view', 1.0e0), ('purchase', 15.0e0)) v(a, b))
    select e.event_type, count(*) as n, round(sum(e.value), 4) as tokens, round(sum(e.value) * max(r.rate) / 1e6, 8) as cost
    from {events} e left join rates r on e.event_type = r.event_type group by e.event_type""",
)
both(
    "A6_cost_nulls",
    """with rates(event_type, rate) as (select * from (values ('click', 3.0e0), ('view', 1.0e0)) v(a, b))
    select e.user_id, round(sum(e.value * r.rate), 4) as priced, @join(@set(case when r.rate is null then e.event_type end), ',') as unpriced
    from {events} e left join rates r on e.event_type = r.event_type group by e.user_id""",
)
both(
    "A7_message_counts",
    """select conv_id, count(*) filter (where role = 'user') as users, count(*) filter (where role = 'assistant') as assistants,
    count(*) filter (where role = 'system') as systems, count(*) filter (where role in ('user', 'assistant')) as conversation from {conversations} group by conv_id""",
)
both("A8_tool_frequency", "select event_type, n, rank_no from (select event_type, n, row_number() over (order by n desc, event_type) as rank_no from (select event_type, count(*) as n from {events} group by event_type) x) y where rank_no <= 5")
both("A9_primary_model", "select user_id, @first_by(event_type, -n * 1000 + length(event_type)) as primary_type from (select user_id, event_type, sum(case when event_type = 'error' then 0 else 1 end) * 100 + min(event_id % 97) as n from {events} group by user_id, event_type) x group by user_id")
both("A10_error_breakdown", "select user_id, count(*) as errors, round(avg(value), 6) as mean_value from {events} where event_type = 'error' group by user_id")
both("A11_durations", "select user_id, max(@us(ts)) - min(@us(ts)) as duration_us from {events} group by user_id")
both("A12_line_changes", "select source, cast(sum(@len(@split(text, '\n'))) as bigint) as lines, count(*) filter (where n_chars > 2000) as large from {documents} group by source")
both("A13_text_stats", "select lang, count(*) as blocks, cast(sum(@bytes(text)) as bigint) as total_bytes, round(avg(@bytes(text)), 4) as mean_bytes from {documents} group by lang")
both(
    "A15_session_summary",
    """select user_id, count(*) as entries, count(distinct event_type) as kinds, round(sum(value), 4) as tokens, round(max(value), 4) as peak, count(distinct @day(ts)) as active_days,
    count(*) filter (where event_type = 'error') as errors, min(event_id) as first_event, max(event_id) as last_event from {events} group by user_id""",
)
both(
    "A16_rollup",
    """select n.n_name, c.c_mktsegment, grouping(n.n_name) + grouping(c.c_mktsegment) as level, count(*) as customers, round(sum(c.c_acctbal), 2) as balance
    from {customer} c join {nation} n on c.c_nationkey = n.n_nationkey group by grouping sets ((n.n_name, c.c_mktsegment), (n.n_name), ())""",
)
both(
    "A17_trends_daily",
    """with d as (select @day(ts) as day, count(*) as turns, sum(value) as tokens, count(*) filter (where event_type = 'click') as tools, count(distinct user_id) as sessions
      from {events} group by @day(ts)),
    i as (select *, row_number() over (order by day) - 1 as nr from d),
    s as (select regr_slope(tokens, nr) as slope, avg(tokens) as mean from i)
    select i.day, i.turns, round(i.tokens, 4) as tokens, i.tools, i.sessions, round(s.slope, 6) as slope, round(s.mean, 4) as mean_tokens,
      case when s.slope > 100 then 'rising_fast' when s.slope > 10 then 'rising' when s.slope < -100 then 'falling_fast' when s.slope < -10 then 'falling' else 'stable' end as trend from i cross join s""",
)
both("A17_trends_weekly", "select @week(ts) as week, count(*) as turns, round(sum(value), 4) as tokens from {events} group by @week(ts)")
both("A17_trends_hourly", "select @hour(ts) as hour, count(*) as turns, round(sum(value), 4) as tokens from {events} group by @hour(ts)")
both("A18_token_breakdown", "select @day(ts) as day, event_type, round(sum(value), 4) as tokens from {events} group by @day(ts), event_type")
both(
    "A19_billing_blocks",
    """select day, block, count(distinct user_id) as sessions, count(*) as turns, round(sum(most), 4) as tokens from (
    select user_id, @day(ts) as day, @div(@hour(ts), 5) * 5 as block, event_type, max(value) as most from {events} group by user_id, @day(ts), @div(@hour(ts), 5) * 5, event_type, cast(@json(props, k) as int)) x group by day, block""",
)
both(
    "A21_efficiency",
    """select user_id, round(cast(sum(cast(value as decimal(18,6))) as double) / count(*), 4) as tokens_per_message, round(count(*) filter (where event_type = 'click') * 1e0 / count(distinct @day(ts)), 4) as tools_per_day,
    case when count(*) = 0 then 100e0 else round(100e0 * (count(*) - count(*) filter (where event_type = 'error')) / count(*), 4) end as success_rate from {events} group by user_id""",
)
both(
    "A22_prediction",
    """select user_id, round(tokens / hours, 6) as per_hour, round(tokens / hours * 8, 6) as per_day, round(tokens / hours * 176, 6) as per_month, round(100000 / (tokens / hours), 6) as hours_to_limit from (
    select user_id, sum(value) as tokens, case when (max(@us(ts)) - min(@us(ts))) / 3.6e9 >= 0.1 then (max(@us(ts)) - min(@us(ts))) / 3.6e9 else 1e0 end as hours from {events} group by user_id) x where tokens > 0""",
)
both(
    "A23_session_diff",
    """select a.event_type, coalesce(b.n, 0) - a.n as delta, b.n is null as only_first from (select event_type, count(*) as n from {events} where user_id = 1 group by event_type) a
    left join (select event_type, count(*) as n from {events} where user_id = 2 group by event_type) b on a.event_type = b.event_type""",
)
both(
    "A24_fidelity",
    """select user_id, found, case when found * 20 >= 90 then 'A' when found * 20 >= 80 then 'B' when found * 20 >= 70 then 'C' when found * 20 >= 60 then 'D' else 'F' end as grade from (
    select user_id, count(distinct event_type) as found from {events} group by user_id) x""",
)
both(
    "A25_gap_filled_daily",
    """with d as (select @day(ts) as day, sum(value) as total from {events} where event_type = 'purchase' group by @day(ts)),
    c as (select explode(sequence(date '2024-01-01', date '2024-01-31', interval 1 day)) as day)
    select @text(c.day) as day, round(coalesce(d.total, 0), 4) as total, d.total is not null as active from c left join d on @text(c.day) = d.day""",
    """with d as (select @day(ts) as day, sum(value) as total from events where event_type = 'purchase' group by @day(ts)),
    c as (select cast(x as date) as day from generate_series(timestamp '2024-01-01', timestamp '2024-01-31', interval 1 day) t(x))
    select @text(c.day) as day, round(coalesce(d.total, 0), 4) as total, d.total is not null as active from c left join d on @text(c.day) = d.day""",
)
both("A26_monthly", "select @ym(o_orderdate) as month, count(*) as orders, round(sum(o_totalprice), 2) as total from {orders} group by @ym(o_orderdate)")
both(
    "A27_prompt_frequency",
    """select text, n, round(100e0 * n / total, 6) as percent from (select text, count(*) as n, sum(count(*)) over () as total from {conversations} where role = 'user' group by text) x where n >= 2""",
)
both("A30_rework", "select l_partkey as part, count(distinct l_orderkey) as sessions from {lineitem} group by l_partkey having count(distinct l_orderkey) > 1")
both("A32_churn", "select o_orderstatus as status, count(*) as n from {orders} group by o_orderstatus")
both(
    "A33_recurring_failures",
    """select k, count(*) as n, count(distinct user_id) as sessions, @last_by(event_id, ts) as latest from (
    select @div(cast(@json(props, k) as int), 10) as k, user_id, event_id, ts from {events} where event_type = 'error') x group by k having count(*) >= 2 and count(distinct user_id) >= 2""",
)
both("A35_failure_counts", "select count(*) filter (where event_type = 'error' and value >= 10) as confirmed, count(*) filter (where event_type = 'error' and value < 10) as inferred from {events}")
both(
    "A36_priorities",
    """with s as (
      select concat('failure:', @text(k)) as item, ln(n) * (1 + 0.5 * sessions) as score from (select @div(cast(@json(props, k) as int), 10) as k, count(*) as n, count(distinct user_id) as sessions from {events} where event_type = 'error' group by @div(cast(@json(props, k) as int), 10)) x
      union all select concat('rework:', source), 1.5 * count(distinct lang) + ln(count(*)) from {documents} group by source having count(distinct lang) >= 3)
    select item, round(score, 6) as score, row_number() over (order by round(score, 6) desc, item) as rank_no from s""",
)
both("A37_digest", "select conv_id, @first_by(text, turn) as first_text, @last_by(text, turn) as last_text, count(*) as turns from {conversations} group by conv_id")
both("A38_standup", "select @day(ts) as day, user_id, count(*) filter (where event_type = 'signup') as created, count(*) filter (where event_type = 'click') as modified, count(*) filter (where event_type = 'view') > 5 as researched from {events} group by @day(ts), user_id")
both("A39_overview", "select count(distinct user_id) as sessions, count(*) as entries, round(sum(value), 4) as tokens from {events} where ts >= timestamp '2024-01-08 00:00:00' and ts < timestamp '2024-01-15 00:00:00'")
both("A41_suggestions", "select source, n from (select source, count(*) as n from {documents} where source like 'src1%' group by source) x where n > 0")
both("A42_outcomes", "select count(*) as labelled, cast(sum(quality) as bigint) as good, round(100e0 * sum(quality) / count(*), 6) as success_rate, cast(sum(toxic) as bigint) as toxic from {labels}")
both("A43_drift", "select event_type, min(@us(ts)) as first_us, max(@us(ts)) as last_us, count(*) as n, count(distinct user_id) as sessions from {events} where event_type not in ('click', 'view') group by event_type")
both("first_events", "select user_id, event_type, min(@us(ts)) as first_us from {events} group by user_id, event_type")
both(
    "A46_pattern_counts",
    """with p(label, pattern) as (select * from (values ('mail', '[a-z]+@[a-z]+'), ('digits', '[0-9][0-9][0-9][0-9]'), ('bang', '!!')) v(a, b))
    select p.label, count(*) as docs, cast(sum(@count_re(d.text, p.pattern)) as bigint) as hits from {documents} d cross join p where @like_re(d.text, p.pattern) group by p.label""",
)
both("A47_distinct_turns", "select count(*) as turns from (select distinct role, text from {conversations}) x")

# --- sequences -------------------------------------------------------------------------------------------------------

both(
    "turns_by_user",
    """with o as (select user_id, event_id, ts, event_type, case when event_type in ('click', 'view') then 1 else 0 end as tool, row_number() over (partition by user_id order by ts, event_id) as a from {events}),
    g as (select *, a - row_number() over (partition by user_id, tool order by ts, event_id) as run from o)
    select user_id, tool, min(a) as first_pos, count(*) as n, @join(@set(event_type), ',') as kinds from g group by user_id, tool, run having tool = 0 or count(*) >= 2""",
)
both("W2_boundaries", "select conv_id, turn, row_number() over (partition by conv_id order by turn) as nr from {conversations} where role = 'system'")
both(
    "W3_event_context",
    """with o as (select event_id, event_type, row_number() over (order by ts, event_id) as pos, abs(@us(ts) - @us(timestamp '2024-01-15 12:00:00')) as off from {events} where user_id = 7),
    t as (select @first_by(pos, off) as p from o)
    select o.event_id, o.event_type, o.pos - t.p as place from o cross join t where o.pos between t.p - 5 and t.p + 5""",
)
both(
    "stretches_of_events",
    """select conv_id, turn, case when r < 0.33 then 'early' when r < 0.67 then 'middle' else 'late' end as phase from (
    select conv_id, turn, turn * 1e0 / (max(turn) over (partition by conv_id) + 1) as r from {conversations}) x""",
)
both(
    "falls_of_counters",
    """with o as (select user_id, event_id, value, lag(value) over (partition by user_id order by ts, event_id) as before from {events}),
    f as (select *, case when before is null or value < before then 1 else 0 end as reset, case when before is null or value < before then value else value - before end as delta from o)
    select user_id, cast(sum(reset) as bigint) as epochs, round(sum(delta), 4) as total from f group by user_id""",
)
both(
    "W6_collapse",
    """with o as (select user_id, event_type, row_number() over (partition by user_id order by ts, event_id) as a, row_number() over (partition by user_id, event_type order by ts, event_id) as b from {events})
    select user_id, event_type, min(a) as first_pos, count(*) as times from o group by user_id, event_type, a - b having count(*) > 1""",
)
both("W7_paging", "select conv_id, turn, role from {conversations} where role = 'user' order by conv_id desc, turn desc limit 50 offset 20")
both("W8_changes", "select user_id, event_id, event_type from (select *, lag(event_type) over (partition by user_id order by ts, event_id) as before from {events}) x where before <> event_type")
both("parts_over_orders", "select l_partkey, l_orderkey, l_linenumber, row_number() over (partition by l_partkey order by l_shipdate, l_orderkey, l_linenumber, l_extendedprice) as version from {lineitem}")
both(
    "W10_sparkline",
    """select day, substr('12345678', cast(case when hi = lo then 4 else round((v - lo) / (hi - lo) * 7) + 1 end as int), 1) as glyph from (
    select day, v, min(v) over () as lo, max(v) over () as hi from (select @day(ts) as day, count(*) as v from {events} group by @day(ts)) x) y""",
)
both("W11_recent", "select user_id, last_us from (select user_id, max(@us(ts)) as last_us from {events} group by user_id) x order by last_us desc limit 10")
both(
    "W12_state_fill",
    """select user_id, event_id, last_value(case when event_type = 'signup' then event_id end) ignore nulls over (partition by user_id order by ts, event_id rows between unbounded preceding and current row) as state from {events}""",
    """select user_id, event_id, last_value(case when event_type = 'signup' then event_id end ignore nulls) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row) as state from events""",
)

# --- joins -----------------------------------------------------------------------------------------------------------

both("J1_call_result", "select a.conv_id, a.turn as call_turn, b.turn as result_turn from {conversations} a join {conversations} b on a.conv_id = b.conv_id and b.turn = a.turn + 1 where a.role = 'user' and b.role = 'assistant'")
both(
    "J2_next_non_error",
    """select user_id, event_id, fix from (select user_id, event_id, event_type, first_value(case when event_type <> 'error' then event_id end) ignore nulls over (partition by user_id order by ts, event_id rows between 1 following and unbounded following) as fix from {events}) x where event_type = 'error'""",
    """select user_id, event_id, fix from (select user_id, event_id, event_type, first_value(case when event_type <> 'error' then event_id end ignore nulls) over (partition by user_id order by ts, event_id rows between 1 following and unbounded following) as fix from events) x where event_type = 'error'""",
)
both("J3_previous_assistant", "select conv_id, turn, max(case when role = 'assistant' then turn end) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding) as previous from {conversations}")
both(
    "J4_exchange",
    """select conv_id, turn, max(case when role = 'user' then turn end) over (partition by conv_id order by turn rows between unbounded preceding and current row) as question,
    min(case when role = 'assistant' then turn end) over (partition by conv_id order by turn rows between 1 following and unbounded following) as answer from {conversations}""",
)
both("J5_context", "select o.o_orderkey, count(*) as n, round(sum(l.l_quantity), 2) as quantity from {orders} o join {lineitem} l on o.o_orderkey = l.l_orderkey where o.o_totalprice > 400000 group by o.o_orderkey")
both("J6_annotations", "select d.doc_id, d.source, l.quality, l.toxic from {documents} d left join {labels} l on d.doc_id = l.doc_id")
both(
    "J7_interval",
    """with s as (select o_custkey, min(o_orderdate) as a, max(o_orderdate) as b from {orders} group by o_custkey)
    select s.o_custkey, count(*) as within_span from s join {orders} o on o.o_orderdate between s.a and s.b and o.o_custkey = s.o_custkey + 1 group by s.o_custkey""",
)
both("J9_parent_child", "select p.conv_id, p.turn as parent, c.turn as child, c.role from {conversations} p join {conversations} c on c.conv_id = p.conv_id and c.turn = p.turn + 1")
both("J10_inherited", "select c.conv_id, c.turn from {conversations} c left anti join (select text, min(conv_id) as owner from {conversations} group by text) o on c.text = o.text and c.conv_id > o.owner", "select c.conv_id, c.turn from conversations c where not exists (select 1 from (select text, min(conv_id) as owner from conversations group by text) o where c.text = o.text and c.conv_id > o.owner)")
both(
    "J11_rate_card",
    """with r(priority, since, upto, rate) as (select * from (values ('1-URGENT', date '1990-01-01', date '1997-01-01', 5.0e0), ('1-URGENT', date '1997-01-01', date '2100-01-01', 4.0e0), ('5-LOW', date '1990-01-01', date '2100-01-01', 1.0e0)) v(a, b, c, d))
    select o.o_orderpriority, r.rate, count(*) as n, round(sum(o.o_totalprice) * max(r.rate) / 1e6, 6) as cost from {orders} o join r on o.o_orderpriority = r.priority and o.o_orderdate >= r.since and o.o_orderdate < r.upto group by o.o_orderpriority, r.rate""",
)
both(
    "J12_twins",
    """with o as (select doc_id, text, row_number() over (partition by text order by doc_id) as nr from {documents})
    select a.doc_id as first_doc, b.doc_id as twin from o a join o b on a.text = b.text and b.nr = a.nr + 1 and a.nr % 2 = 1""",
)
both("J14_links", "select least(a, b) as a, greatest(a, b) as b from (select s_nationkey as a, s_suppkey % 25 as b from {supplier}) x where a <> b group by least(a, b), greatest(a, b)")

# --- sorts, sets -----------------------------------------------------------------------------------------------------

both("K1_list_sort", "select user_id, n from (select user_id, count(*) as n from {events} group by user_id) x order by n desc, user_id limit 25")
both("K2_topk_page", "select l_orderkey, l_linenumber, l_partkey, l_extendedprice from {lineitem} order by l_extendedprice desc, l_orderkey, l_linenumber, l_partkey limit 20 offset 40")
both("K4_narrow", "select user_id, event_id from (select user_id, event_id, row_number() over (partition by user_id order by case event_type when 'error' then 0 when 'purchase' then 1 else 2 end, ts, event_id) as nr from {events}) x where nr <= 3")
both("K6_union", "select 'doc' as kind, lang as name, count(*) as n from {documents} group by lang union all select 'event', event_type, count(*) from {events} group by event_type")
both("K7_distinct", "select count(distinct text) as texts, count(*) as n from {documents}")
both("K8_set_difference", "select event_type from {events} where user_id = 1 except select event_type from {events} where user_id = 3")
both("K8_intersection", "select event_type from {events} where user_id = 1 intersect select event_type from {events} where user_id = 2")
both("texts_of_two_sources", "select line, max(a) as in_first, max(b) as in_second from (select text as line, 1 as a, 0 as b from {documents} where source = 'src0' union all select text, 0, 1 from {documents} where source = 'src1') x group by line")
both(
    "shared_event_types",
    """with t as (select user_id, @set(concat(event_type, @text(@div(cast(@json(props, k) as int), 20)))) as s from {events} group by user_id), a as (select s from t where user_id = 1)
    select t.user_id, round(100e0 * @len(@common(t.s, a.s)) / @len(@either(t.s, a.s)), 6) as jaccard from t cross join a where t.user_id <> 1""",
)
both("K12_cleanup", "select user_id, n = 0 as empty, last_day < '2024-01-30' as old from (select user_id, count(*) as n, max(@day(ts)) as last_day from {events} group by user_id) x where last_day < '2024-01-30'")
