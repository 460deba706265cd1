"""Search, scalar functions and text operators over documents, conversations and pages."""

from __future__ import annotations

from .dialect import both

# --- search ----------------------------------------------------------------------------------------------------------

both(
    "X1_projection",
    "select conv_id, turn, case role when 'user' then 'user_text' when 'assistant' then 'assistant_text' else 'system_text' end as segment, length(text) as chars from {conversations} where length(text) > 0",
)
both("X2_scope", "select count(*) filter (where role = 'user') as user_segments, count(*) filter (where role = 'assistant') as assistant_segments, count(*) as all_segments from {conversations}")
both(
    "X3_line_match",
    """select doc_id, line_no, line from (select doc_id, pos + 1 as line_no, line from {documents} lateral view posexplode(split(text, '\n')) t as pos, line) x where line rlike '[Ll]icense'""",
    """select doc_id, line_no, line from (select doc_id, generate_subscripts(l, 1) as line_no, unnest(l) as line from (select doc_id, string_split(text, '\n') as l from documents) y) x where regexp_matches(line, '[Ll]icense')""",
)
_SCORE = """select doc_id, greatest(0, least(100, cast(floor(50 + case when place = 1 then 15 when place <= 10 then 11 - place else 0 end + 20e0 * @bytes(hit) / @bytes(text) + case when whole then 10 else 5 end) as int))) as score from (
    select doc_id, text, hit, {at} as place, @like_re(text, '\\b(license|License)\\b') as whole from (select doc_id, text, @first_re(text, '[Ll]icense', 0) as hit from {{documents}} where @like_re(text, '[Ll]icense')) x) y"""
both("X4_score", _SCORE.replace("{at}", "instr(text, hit)").replace("{{", "{").replace("}}", "}"))
both("X6_occurrences", "select doc_id, @count_re(text, 'the') as n from {documents} where @like_re(text, 'the')")
both("X7_files_only", "select distinct source from {documents} where @like_re(text, 'MIT')")
both("X7_count_by_session", "select source, count(*) as docs, cast(sum(@count_re(text, '[Ll]icense')) as bigint) as hits from {documents} where @like_re(text, '[Ll]icense') group by source")
both("X8_driver", "select doc_id, source, hits from (select doc_id, source, @count_re(text, 'tion') as hits from {documents} where lang = 'en') x where hits > 0 order by hits desc, doc_id limit 50")
both("X11_coverage", "select count(*) as documents, count(*) filter (where @like_re(text, 'tion')) as matched, count(distinct source) as sessions, count(*) filter (where text is null) as incomplete from {documents}")
both("X12_literal", "select doc_id from {documents} where contains(text, 'license') or contains(text, 'License')")
both("texts_and_replies", "select a.conv_id, a.turn, a.role, b.turn as reply from {conversations} a left join {conversations} b on a.conv_id = b.conv_id and b.turn = a.turn + 1 where a.role = 'user' and @like_re(a.text, 'tion')")
both("texts_by_opening", "select conv_id, turn, case when role <> 'user' then 'primary' when @like_re(text, '^\\s*<') then 'injected' when @like_re(text, '(^|\\n)>') then 'quoted' else 'primary' end as provenance from {conversations}")

# --- scalar functions ------------------------------------------------------------------------------------------------

both("C1_truncate", "select doc_id, case when length(text) <= 80 then text else concat(substr(text, 1, 80), '...') end as preview from {documents}")
both("C2_path_ends", "select page_id, case when length(url) <= 24 then url else concat(substr(url, 1, 10), '...', substr(url, length(url) - 10, 11)) end as short from {pages}")
both("C3_sizes", "select doc_id, case when @bytes(text) < 1024 then concat(@text(@bytes(text)), ' B') else concat(@text(@div(@bytes(text), 1024)), ' KB') end as size_text from {documents}")
_REDACT = (
    ("ghp_[A-Za-z0-9]{36}", "[REDACTED]"),
    ("AKIA[0-9A-Z]{16}", "[REDACTED]"),
    ("[0-9]{3}-[0-9]{2}-[0-9]{4}", "[REDACTED]"),
    ("[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}", "[REDACTED]"),
    ("[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}", "[REDACTED]"),
)


def _quoted(pattern: str, side: int) -> str:
    """A pattern as a literal; Spark's formatter takes braces for tables."""
    return pattern.replace("{", "{{").replace("}", "}}") if side == 0 else pattern


def _redacted(side: int) -> str:
    out = "text"
    for pattern, by in _REDACT:
        out = f"regexp_replace({out}, '{_quoted(pattern, side)}', '{by}'" + (", 'g')" if side else ")")
    return out


def _kinds(side: int) -> str:
    like = "regexp_matches(text, '{}')" if side else "text rlike '{}'"
    names = ("github", "aws", "ssn", "email", "ipv4")
    return " union all ".join(f"select '{k}' as kind, count(*) as docs from {'documents' if side else '{documents}'} where {like.format(_quoted(p, side))}" for k, (p, _) in zip(names, _REDACT, strict=True))


both("C5_detect", _kinds(0), _kinds(1))
both(
    "C9_relative_time",
    """select user_id, case when m < 60 then concat(@text(m), ' minutes ago') when m < 1440 then concat(@text(@div(m, 60)), ' hours ago') else concat(@text(@div(m, 1440)), ' days ago') end as last_seen from (
    select user_id, @div(@us(timestamp '2024-01-31 00:00:00') - max(@us(ts)), 60000000) as m from {events} group by user_id) x""",
)
both("C10_tag_content", "select page_id, @first_re(html, '<title>([^<]*)</title>', 1) as title from {pages}")
both("C11_tag_counts", "select page_id, @count_re(html, '<p>|<p ') as paragraphs, @count_re(html, '<a ') as anchors from {pages}")
both("C13_basenames", "select page_id, @first_re(@sub_re(url, '[?#].*$', ''), '([^/]*)/?$', 1) as base from {pages}")
both("C14_preview", "select conv_id, turn, substr(@sub_re(text, '\\s+', ' '), 1, 100) as preview from {conversations}")
both("events_by_failure", "select event_id, case when event_type = 'error' then 'confirmed' when value > 95 then 'inferred' else 'none' end as failure from {events} where event_type = 'error' or value > 95")
both("refusing_turns", "select conv_id, turn, 250 + length(text) % 7 as strength from {conversations} where role = 'user' and @like_re(lower(text), '^(no|not|non|nein)[ ,.]')")
both("C17_decisions", "select doc_id from {documents} where @like_re(lower(text), '(we|they) (decided|agreed) to') or @count_re(text, '(^|\\n)[0-9]+\\.') >= 3")
both("C18_normalise", "select doc_id, substr(@sub_re(@sub_re(text, '[0-9]+', '<N>'), '\\s+', ' '), 1, 120) as normal from {documents}")
both("C20_taxonomy", "select event_type, case event_type when 'click' then 'shell' when 'view' then 'file_read' when 'purchase' then 'file_write' else concat('other:', event_type) end as kind, count(*) as n from {events} group by event_type")
both("C21_name_parts", "select p_partkey, @at(@split(p_type, ' '), 1) as head, @len(@split(p_type, ' ')) as parts from {part}")
both("C23_url_normalise", "select page_id, lower(@sub_re(@sub_re(@sub_re(url, '^https?://', ''), '[?#].*$', ''), '/$', '')) as normal from {pages}")
both("C25_entry_id", "select conv_id, turn, @md5(concat(@text(conv_id), '/', @text(turn))) as entry_id from {conversations}")
both("C26_csv_escape", """select doc_id, case when @like_re(text, '[",\\r\\n]') then concat('"', replace(text, '"', '""'), '"') else text end as field from {documents}""")
both("C27_tag_normalise", "select distinct @sub_re(replace(lower(trim(p_name)), ' ', '-'), '[^a-z0-9_-]', '') as tag from {part}")
both("C29_short_id", "select doc_id, substr(@md5(@text(doc_id)), 1, 8) as short_id from {documents}")
both("C31_bar", "select event_type, repeat('#', cast(round(20e0 * n / most) as int)) as bar from (select event_type, n, max(n) over () as most from (select event_type, count(*) as n from {events} group by event_type) x) y")

# --- trees -----------------------------------------------------------------------------------------------------------

both("G1_roots", "select c.conv_id, c.turn from {conversations} c left join {conversations} p on p.conv_id = c.conv_id and p.turn = c.turn - 1 where p.turn is null")
both("G2_duplicates", "select text, count(*) as copies, min(doc_id) as kept from {documents} group by text having count(*) > 1")
both("regions_of_several_nations", "select n_regionkey, count(*) as children from {nation} group by n_regionkey having count(*) > 1")
both("G8_chunks", "select user_id, h, @last_by(event_type, ts) as last_type, count(*) as chunks from (select *, @us(date_trunc('hour', ts)) as h from {events}) x group by user_id, h having count(*) > 1")
both("G12_statistics", "select conv_id, count(*) as nodes, count(*) filter (where role = 'user') as users, max(turn) + 1 as main_length, @any(role = 'system') as has_system from {conversations} group by conv_id")
both(
    "G13_turns",
    """select conv_id, turn as user_turn, next_turn from (select conv_id, turn, role, lead(role) over (partition by conv_id order by turn) as next_role, lead(turn) over (partition by conv_id order by turn) as next_turn from {conversations}) x
    where role = 'user' and next_role = 'assistant'""",
)
both("turns_by_prompt", "select conv_id, chunk, count(*) as entries, min(turn) as first_turn from (select conv_id, turn, sum(case when role = 'user' then 1 else 0 end) over (partition by conv_id order by turn) as chunk from {conversations}) x group by conv_id, chunk")
both(
    "G17_chains",
    """with o as (select user_id, event_id, @us(ts) as t, lag(@us(ts)) over (partition by user_id order by ts, event_id) as before from {events}),
    f as (select *, sum(case when before is null or t - before > 1800000000 then 1 else 0 end) over (partition by user_id order by t, event_id) as chain from o)
    select user_id, chain, count(*) as members, min(event_id) as root from f group by user_id, chain having count(*) >= 2""",
)
both(
    "G18_logical_sessions",
    """with o as (select user_id, event_id, @us(ts) as t, lag(@us(ts)) over (partition by user_id order by ts, event_id) as before from {events}),
    f as (select *, sum(case when before is null or t - before > 1800000000 then 1 else 0 end) over (partition by user_id order by t, event_id) as chain from o)
    select user_id, count(distinct chain) as sessions, count(*) as entries, max(t) as latest_us from f group by user_id""",
)
both("region_nation_customers", "select r.r_name, n.n_name, count(c.c_custkey) as customers from {region} r join {nation} n on n.n_regionkey = r.r_regionkey left join {customer} c on c.c_nationkey = n.n_nationkey group by r.r_name, n.n_name")
both("G22_identity", "select coalesce(case when c.c_acctbal < 0 then null else c.c_mktsegment end, n.n_name) as identity, count(*) as members from {customer} c left join {nation} n on c.c_nationkey = n.n_nationkey group by coalesce(case when c.c_acctbal < 0 then null else c.c_mktsegment end, n.n_name)")
both("G23_order", "select event_id, row_number() over (partition by user_id order by ts nulls last, event_id) as pos from {events}")
