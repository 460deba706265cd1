"""Requests, lineage, rollups and further predicates over the driver's tables, from one SQL text each."""

from __future__ import annotations

from .dialect import both

# --- sources ---------------------------------------------------------------------------------------------------------

both("S5_offsets", "select user_id, event_id, row_number() over (partition by user_id order by event_id) as line_num, cast(sum(@bytes(props)) over (partition by user_id order by event_id rows between unbounded preceding and current row) as bigint) as bytes_read from {events}")
both("S8_size_guard", "select doc_id, @bytes(text) as n_bytes from {documents} where @bytes(text) <= 2048")
both("S10_incomplete_tail", "select doc_id from {documents} where not @like_re(text, '[.!?]$')")
both("S12_path_encode", "select page_id, replace(@sub_re(url, '^https?://', ''), '/', '-') as encoded from {pages}")
both("S13_name_parse", "select p_partkey, @first_re(p_brand, '#([0-9]+)', 1) as suffix, @like_re(p_brand, '^Brand#') as is_main from {part}")
both("S20_prefix_resolve", "select prefix, count(*) as hits, case when count(*) > 1 then 'ambiguous' else 'unique' end as outcome from (select substr(@text(o_orderkey), 1, 3) as prefix from {orders}) x group by prefix")
both("S24_externalised", "select source, count(*) filter (where n_chars > 5000) as externalised, count(*) as total from {documents} group by source")
both("S25_validation", "select event_type, count(*) filter (where not (@is_json(props))) as not_json, count(*) filter (where @json(props, k) is null) as missing_k, count(*) filter (where value < 0) as negative from {events} group by event_type")
both("equal_turns", "select b.conv_id, max(a.conv_id) as parent, count(*) as shared from {conversations} a join {conversations} b on a.text = b.text and a.turn = b.turn and a.conv_id < b.conv_id group by b.conv_id")
both("S31_preferred_artifact", "select text_md5, doc_id from (select @md5(text) as text_md5, doc_id, row_number() over (partition by @md5(text) order by doc_id desc) as nr from {documents}) x where nr = 1")
# --- predicates ------------------------------------------------------------------------------------------------------

both("F3_date_filter", "select count(*) as n from {orders} where o_orderdate >= timestamp '1998-01-01 00:00:00' and o_orderdate < timestamp '1998-01-01 00:00:00' + interval '30' day")
both("F5_size_filter", "select source, count(*) as n from {documents} where @bytes(text) >= 10 * 1024 group by source")
both("F8_conjunction", "select user_id, count(*) as n from {events} where event_type in ('click', 'purchase') and value > 10 and cast(@json(props, k) as int) between 10 and 90 group by user_id")
both("F10_kinds", "select role, count(*) as n from {conversations} where @like_re(text, '^[A-Z]') group by role")
both("F11_only", "select conv_id, turn, role from {conversations} where role in ('user') union all select conv_id, turn, role from {conversations} where role in ('system')")
both("F12_visible", "select l.doc_id from {labels} l join {documents} d on d.doc_id = l.doc_id where l.quality = 1 and l.toxic = 0 and d.n_chars > 0")
both("F15_columns", "select event_id, user_id, event_type from {events} where event_type = 'purchase'")
both("F16_scope", "select page_id from {pages} where @like_re(url, '/en/') and not @like_re(url, '[?]utm_')")

# --- trees and lineage -----------------------------------------------------------------------------------------------

both("G7_linkage", "select a.user_id, a.event_id as call, min(b.event_id) as result from {events} a join {events} b on a.user_id = b.user_id and b.event_type = 'view' and b.event_id > a.event_id where a.event_type = 'signup' group by a.user_id, a.event_id")
both("G11_leaves", "select c.conv_id, c.turn from {conversations} c left join {conversations} d on d.conv_id = c.conv_id and d.turn = c.turn + 1 where d.turn is null")
both("G14_semantic_turns", "select conv_id, nr, count(*) as entries, count(*) filter (where role = 'assistant') as answers from (select conv_id, role, sum(case when role = 'user' then 1 else 0 end) over (partition by conv_id order by turn) as nr from {conversations}) x group by conv_id, nr having count(*) filter (where role <> 'system') > 0")
both("G16_chunk_range", "select conv_id, turn from (select conv_id, turn, sum(case when role = 'user' then 1 else 0 end) over (partition by conv_id order by turn) - 1 as chunk from {conversations}) x where chunk between 1 and 2")
both("equal_texts_paired", "select a.doc_id as call, b.doc_id as subagent from (select doc_id, text, row_number() over (partition by text order by doc_id) as nr from {documents} where source < 'src5') a join (select doc_id, text, row_number() over (partition by text order by doc_id) as nr from {documents} where source >= 'src5') b on a.text = b.text and a.nr = b.nr")
both("nations_by_region", "select n_regionkey as unit, min(n_nationkey) as root, count(*) as members from {nation} group by n_regionkey")
both("G24_export_order", "select conv_id, turn, row_number() over (partition by conv_id order by case when role = 'system' then 0 else 1 end, turn) as pos from {conversations}")

# --- joins and sorts -------------------------------------------------------------------------------------------------

both("supplier_nations", "select s.s_suppkey, n.n_name from {supplier} s left join {nation} n on s.s_nationkey = n.n_nationkey")
both("J13_all_others", "select b.user_id, abs(a.n - b.n) as apart from (select count(*) as n from {events} where user_id = 5) a cross join (select user_id, count(*) as n from {events} where user_id <> 5 group by user_id) b")
# --- aggregates ------------------------------------------------------------------------------------------------------

both("A14_subagents", "select user_id, count(*) as results, round(sum(value), 4) as tokens, count(distinct cast(@json(props, k) as int)) as agents from {events} where event_type = 'purchase' group by user_id")
both("A31_health", "select o_orderpriority, count(*) as changes, count(distinct o_custkey) as sessions, count(*) filter (where o_orderstatus = 'F') as failures from {orders} group by o_orderpriority")
both("region_totals", "select r.r_name, count(distinct n.n_nationkey) as children, count(s.s_suppkey) as members, round(sum(s.s_acctbal), 2) as total from {region} r left join {nation} n on n.n_regionkey = r.r_regionkey left join {supplier} s on s.s_nationkey = n.n_nationkey group by r.r_name")
both("A44_usage_summary", "select event_type, case when value > 50 then 'large' else 'small' end as basis, count(*) as observations, count(distinct user_id) as sessions from {events} group by event_type, case when value > 50 then 'large' else 'small' end")
both("A16_session_merge", "select n_regionkey, count(distinct n_nationkey) as nations, min(n_name) as first_name, max(n_name) as last_name from {nation} group by n_regionkey")

# --- scalars ---------------------------------------------------------------------------------------------------------

both("C8_envelope", "select count(*) as records, min(doc_id) as first_id, max(doc_id) as last_id, @md5(@join(@list(source), ',')) as digest from (select source, min(doc_id) as doc_id from {documents} group by source) x")
both("C12_input_summary", "select event_id, concat(event_type, ': k=', @json(props, k)) as summary from {events}")
both("events_that_read", "select event_id, event_type in ('view', 'click') as read_only from {events}")
both("C22_hunk_lines", "select doc_id, @count_re(text, '\\n') + 1 as lines, @count_re(text, '\\n\\n') as breaks from {documents}")
both("C24_canonical", "select event_id, concat('k=', @json(props, k), ';t=', event_type) as canonical from {events}")
both("C28_glob", "select page_id from {pages} where url like 'https://%.example.com/en/%'")
both("sizes_by_era", "select p_partkey, case when p_size < 10 then 'v1' when p_size < 30 then 'v2' else 'v3' end as era from {part}")

# --- requests --------------------------------------------------------------------------------------------------------

both("M1_list_sessions", "select conv_id, entries, users from (select conv_id, count(*) as entries, count(*) filter (where role = 'user') as users from {conversations} group by conv_id) x order by entries desc, conv_id limit 50")
both("M2_session_info", "select conv_id, count(*) as entries, min(turn) as first_turn, max(turn) as last_turn, @join(@set(role), ',') as roles from {conversations} group by conv_id")
both("M3_stats", "select case when grouping(user_id) = 1 then -1 else user_id end as user_id, count(*) as entries, round(sum(value), 4) as tokens from {events} group by grouping sets ((user_id), ())")
both("M4_messages", "select conv_id, turn, role, length(text) as chars from (select *, row_number() over (partition by conv_id order by turn) as nr from {conversations} where role <> 'system') x where nr between 2 and 4")
both("M5_timeline", "select conv_id, nr, min(turn) as first_turn, count(*) filter (where role = 'assistant') as answers from (select conv_id, turn, role, sum(case when role = 'user' then 1 else 0 end) over (partition by conv_id order by turn) as nr from {conversations}) x group by conv_id, nr")
both("M6_project_history", "select @day(ts) as day, count(distinct user_id) as sessions, count(*) filter (where event_type = 'error') as errors, round(sum(value), 4) as tokens from {events} group by @day(ts)")
both("M7_search", "select conv_id, turn, @count_re(text, 'the') as hits from {conversations} where @like_re(text, 'the')")
both("M8_tool_calls", "select user_id, event_id, event_type, case when event_type = 'error' then 'confirmed' end as failure_kind from {events} where event_type in ('click', 'error')")
both("M9_lessons", "select a.user_id, count(*) as errors, count(distinct a.k) as kinds from (select user_id, cast(@json(props, k) as int) as k from {events} where event_type = 'error') a group by a.user_id")
both("M11_digest", "select conv_id, @first_by(text, turn) as opening, @last_by(role, turn) as closing_role, count(distinct role) as roles from {conversations} group by conv_id")
both("M14_file_history", "select l_partkey, count(distinct l_orderkey) as sessions, count(*) as attempts, count(*) filter (where l_linestatus = 'F') as applied from {lineitem} group by l_partkey")
both("M16_project_health", "select l_suppkey, count(distinct l_partkey) as files, count(*) as changes, round(avg(l_quantity), 6) as mean_quantity from {lineitem} group by l_suppkey")
both("first_shipments", "select l_partkey, version, l_orderkey from (select l_partkey, l_orderkey, row_number() over (partition by l_partkey order by l_shipdate, l_orderkey, l_linenumber) as version from {lineitem}) x where version = 1")
both("M20_time_parse", "select event_id, @us(ts) - @us(timestamp '2024-01-01 00:00:00') as since_us from {events} where ts >= timestamp '2024-01-30 00:00:00' - interval '2' hour")
both("O19_export_warning", "select lang, count(*) filter (where @like_re(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]+')) as with_mail, count(*) as total from {documents} group by lang")
both("O3_csv_rows", "select event_id, concat(@text(event_id), ',', event_type, ',', replace(props, '\"', '\"\"')) as csv_line from {events}")
both("O2_jsonl_rows", "select conv_id, turn, concat('{{\"conv\":', @text(conv_id), ',\"turn\":', @text(turn), '}}') as json_line from {conversations}", "select conv_id, turn, concat('{\"conv\":', conv_id, ',\"turn\":', turn, '}') as json_line from conversations")
both("labelled_counts_differ", "select coalesce(a.source, b.source) as source, coalesce(a.n, 0) as before_n, coalesce(b.n, 0) as after_n from (select d.source, count(*) as n from {documents} d join {labels} l on d.doc_id = l.doc_id group by d.source) a full join (select source, count(*) as n from {documents} group by source) b on a.source = b.source where coalesce(a.n, 0) <> coalesce(b.n, 0)")
both("T5_usage_state", "select user_id, event_id, round(sum(value) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row), 4) as total from {events}")
