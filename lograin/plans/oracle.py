"""ANSI SQL answers to the catalog's queries, for checking them elsewhere.

The SQL states each operator in its plainest form, with whole-table windows and
recursion; the Spark plans compute the same on partitioned data.
"""

from __future__ import annotations

ID, LIMIT_US, COOLDOWN_US = "app", 86_400_000_000, 5_000_000
WORDS = ["took", "ms", "lick", "c", "props"]
_L = "etaoinsrlh"
MANY_WORDS = [a + b + c for a in _L for b in _L for c in _L] + [a + b for a in _L for b in _L] + ["e", "a", "o"]
URLS = [
    ("https://discord.com/api/webhooks/1", "discord"),
    ("https://hooks.slack.com/services/2", "slack"),
]

# RE2 spellings, written out here: ASCII word boundaries are native, \s lacks the vertical tab.
_IP = r"\b\d{1,3}[.]\d{1,3}[.]\d{1,3}[.]\d{1,3}\b"
_LEVEL = r"(?i)\b(?:debug|info|notice|warning|warn|error|critical|alert|emergency)\b"
_DATE = "|".join([
    r"\d\d[/]\d\d[/]\d{4}", r"\d\d-\d\d-\d{4}", r"\d{4}[/]\d\d[/]\d\d", r"\d{4}-\d\d-\d\d", r"\d\d[/]\d{4}[/]\d\d", r"\d\d-\d{4}-\d\d",
    r"\d{4}[/]\d\d", r"\d{4}-\d\d", r"\d\d[/]\d{4}", r"\d\d-\d{4}", r"\d\d:\d\d:\d\d", r"[a-z]+\s\d{1,2},\s\d{4}",
])
_SPACE = r"[\t\n\v\f\r \x{85}\p{Z}]+"
_BYTE = "(?:[0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"
_QUAD = rf"{_BYTE}[.]{_BYTE}[.]{_BYTE}[.]{_BYTE}"


def _cut(text: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({text}, '{pattern}', '{by}', 'g')"


def _trim(text: str) -> str:
    return _cut(text, f"^{_SPACE}|{_SPACE}$")


def _no_id(text: str) -> str:
    return _cut(text, rf"{ID}_\d{{1,9}}")


def _level(text: str) -> str:
    return f"upper(regexp_extract({text}, '{_LEVEL}', 0))"


def _no_levels(text: str) -> str:
    return _trim(_cut(text, _LEVEL))


def _low(text: str) -> str:
    return f"lower({_no_id(_cut(_trim(text), _IP))})"


def _sanitized(text: str, words: list[str] = ()) -> str:
    low = _low(text)
    clean = _no_levels(_cut(low, _DATE))
    return f"{_level(low)} || {_cut(clean, '|'.join(words)) if words else clean}"


def _masked(text: str) -> str:
    return _trim(_cut(text, r"\d+", "*"))


def _key(text: str) -> str:
    return _masked(_sanitized(text))


def _first_ip(text: str) -> str:
    # the feeds hold addresses of four numbers only; other spellings are tested on their own
    tokens = f"[t for t in string_split_regex({text}, '{_SPACE}') if regexp_full_match(t, '{_QUAD}(?:/0*(?:[0-9]|[12][0-9]|3[0-2]))?')]"
    return f"split_part(({tokens})[1], '/', 1)"


def _clock(ts: str) -> str:
    return f"strftime({ts}, '%H:%M:%S')"


def _alert_time(ts: str) -> str:
    return f"strftime({ts}, '%d-%m-%Y, %H:%M')"


def _rfc3339(ts: str) -> str:
    return f"regexp_replace(strftime({ts}, '%Y-%m-%dT%H:%M:%S.%f'), '\\.?0*$', '') || 'Z'"


LOG = """log as (
  select event_id, ts, concat('10.0.0.', cast(user_id % 16 as varchar)) as source, 'app' as id_log,
    concat('app_', cast(user_id as varchar), ' ', strftime(ts, '%Y-%m-%d %H:%M:%S'), ' ',
      case event_type
        when 'error' then case when event_id % 3 = 0 then 'CRITICAL: ' else 'error: ' end
        when 'signup' then 'Notice: ' when 'purchase' then 'INFO: ' when 'view' then 'debug: '
        else case when event_id % 2 = 0 then 'warn: ' else '' end end,
      event_type, ' took ', cast(cast(floor(value) as bigint) as varchar),
      ' ms from 192.168.', cast(user_id % 256 as varchar), '.', cast(event_id % 256 as varchar),
      ' props ', props) as content
  from events)"""

TURNS = """turns as (
  select conv_id * 1000 + turn as event_id,
    timestamp '2024-01-01 00:00:00' + to_minutes(cast(conv_id * 60 + turn as bigint)) as ts,
    role as source, text as content
  from conversations)"""

DOC_LINES = """doc_lines as (
  select doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 as line_no,
    unnest(string_split(text, chr(10))) as content
  from documents)"""

LINES = f"""{LOG}, {DOC_LINES}, lines as (
  select 'event' as origin, event_id as id, 0 as line_no, content from log
  union all select 'document', doc_id, line_no, content from doc_lines)"""

BODIES = """bodies as (
  select event_id as doc_id,
    case when event_id % 50 = 0 then '{}'
         when event_id % 50 = 1 then concat('[{"a":', cast(event_id as varchar), '},null,"two words"]')
         else concat('{"id":"', md5(cast(event_id as varchar)), '","type":"', event_type, '","code":"',
           case when event_id % 2 = 0 then 'ab' else 'beef' end, '","user":{"n":', cast(user_id as varchar),
           ',"ok":', case when event_id % 3 = 0 then 'true' else 'false' end, '},"tags":["a b",',
           cast(user_id % 7 as varchar), case when event_id % 5 = 0 then ',null' else '' end, '],"props":', props, '}')
    end as body
  from events), docs as (
  select doc_id, 0 as pos, json(body) as doc from bodies where json_type(body) = 'OBJECT'
  union all
  select doc_id, generate_subscripts(json_extract(body, '$[*]'), 1) - 1, unnest(json_extract(body, '$[*]'))
  from bodies where json_type(body) = 'ARRAY')"""


def _keyed(log: str) -> str:
    return f"select event_id, ts, source, {_level('content')} as level, {_key('content')} as message from {log}"


_MEASURES = (
    "count(*) as count, min(ts) as first_seen, max(ts) as last_seen, arg_min(level, (ts, event_id)) as level"
)
KEYED = f"{LOG}, keyed as ({_keyed('log')})"
STATS = f"{KEYED}, stats as (select source, message, {_MEASURES} from keyed group by all)"


def _intervals(keyed: str) -> str:
    start = "time_bucket(interval '1 hour', ts, timestamp '1970-01-01')"
    return f"""select {start} as window_start, {start} + interval '1 hour' as window_end, source, message,
      {_MEASURES} from {keyed} group by {start}, source, message"""


_DAY = "time_bucket(interval '1 day', window_start, timestamp '1970-01-01 06:00:00')"
INTERVALS = f"{KEYED}, intervals as ({_intervals('keyed')})"
DAILY = f"{INTERVALS}, daily as (select *, {_DAY} as report_day from intervals)"

RULE = "----------------------------------"
_ORIGIN = "concat('ORIGIN: [', source, ']')"
_MESSAGE = (
    f"concat('- [', cast(count as varchar), '] ', message, ' -- (First seen ', {_clock('first_seen')}, "
    f"' - Last seen ', {_clock('last_seen')}, ')')"
)


def _lines_of(rows: str, title: str, entry: str, keys: str = "") -> str:
    title = title.replace("\t", "' || chr(9) || '")
    return f"""select {keys} section, source, line from (
      select distinct {keys} 0 as section, '' as source, '{title}' as line from {rows}
      union all select distinct {keys} 0, '', '{RULE}' from {rows}
      union all select distinct {keys} 1, source, {_ORIGIN} from {rows}
      union all select {keys} 1, source, {entry} from {rows}
      union all select distinct {keys} 2, '', '{RULE}' from {rows})"""


def _payloads(rows: str, keys: str = "") -> str:
    item = (
        "{'count': count, 'firstSeen': " + _rfc3339("first_seen") + ", 'lastSeen': " + _rfc3339("last_seen")
        + ", 'message': message}"
    )
    return f"""select {keys} source, count(*) as messages,
      cast(to_json({{'origin': source, 'data': list({item} order by message)}}) as varchar) as payload
      from {rows} group by {keys} source"""


def _bodies(rows: str, keys: str = "") -> str:
    by = f"group by {keys.rstrip(', ')}" if keys else ""
    return f"select {keys} '[' || string_agg(payload, ',' order by source) || ']' as body from ({_payloads(rows, keys)}) {by}"


_HEX = "regexp_full_match({}, '([0-9A-Fa-f]{{2}})*')"


def _is_id(text: str) -> str:
    return f"(not contains({text}, ' ') and (strlen({text}) > 20 or not {_HEX.format(text)}))"


_KIND = """case {} when 'OBJECT' then 'object' when 'ARRAY' then 'array' when 'VARCHAR' then 'string'
  when 'BOOLEAN' then 'boolean' when 'NULL' then 'null' else 'number' end"""
_TREE = f"""nodes as (
  select d.doc_id, d.pos, t.id, t.parent, t.key, t.fullkey, {_KIND.format('t.type')} as kind,
    t.atom ->> '$' as value, length(t.fullkey) - length(translate(t.fullkey, '.[', '')) as depth
  from docs d, json_tree(d.doc) t)"""
NODES = f"{BODIES}, {_TREE}"

_ITEM = """json('{"type":"' || event_type || '","note":"a }],[{ b \\" c\\\\","props":' || props || '}')"""
PRETTY = f"""docs as (
  select event_id as doc_id, 0 as pos, {_ITEM} as doc from events
  union all select event_id, 1, json(cast(event_id as varchar)) from events where event_id % 3 = 0), {_TREE}"""


def _shapes(depth: int = 4) -> str:
    """Fingerprints from the leaves up, one step per level."""
    leaf = f"""case kind when 'null' then '' when 'boolean' then '<BOOL>' when 'number' then '<NUM>'
      when 'string' then case when {_is_id('value')} then '<ID>' else value end else '' end"""
    steps = [f"s{depth} as (select doc_id, pos, id, parent, key, {leaf} as shape from nodes where depth = {depth})"]
    for level in reversed(range(depth)):
        steps.append(f"""s{level} as (
          select p.doc_id, p.pos, p.id, p.parent, p.key, case
            when p.kind = 'object' then coalesce(string_agg(c.key || ':' || c.shape || '||', '' order by c.key), '')
            when p.kind = 'array' then coalesce(string_agg(c.key || ':' || c.shape, '' order by c.id), '')
            else any_value(p.leaf) end as shape
          from (select *, {leaf} as leaf from nodes where depth = {level}) p
          left join s{level + 1} c on c.doc_id = p.doc_id and c.pos = p.pos and c.parent = p.id
          group by p.doc_id, p.pos, p.id, p.parent, p.key, p.kind)""")
    return ", ".join(steps)


SHAPES = f"{NODES}, {_shapes()}"
_COUNTS = """counts as (
  select 'file-reader' as source, shape as message, count(*) as count from s0 where shape <> '' group by shape)"""
SHAPE_COUNTS = f"{SHAPES}, {_COUNTS}"

# --- bursts ------------------------------------------------------------------

_ORDERED = """row_number() over ({by} order by ts, event_id) as rn,
    count(*) over ({by} order by us range between unbounded preceding and {limit} following) + 1 as nxt"""


def _windows(name: str, rows: str) -> str:
    """Anchored windows of ``rows (category, event_id, ts, us)``: ``name`` adds start_rn, window_start, place."""
    ordered = _ORDERED.format(by="partition by category", limit=LIMIT_US)
    return f"""{name}_rows as (select *, {ordered} from ({rows})), {name}_chain as (
      select category, rn, nxt, ts from {name}_rows where rn = 1
      union all
      select r.category, r.rn, r.nxt, r.ts from {name}_chain c
      join {name}_rows r on r.category = c.category and r.rn = c.nxt), {name} as (
      select r.category, r.event_id, r.ts, r.us, c.rn as start_rn, c.ts as window_start, r.rn - c.rn + 1 as place
      from {name}_rows r asof join {name}_chain c on r.category = c.category and r.rn >= c.rn)"""


def _alerts(name: str, windows: str, threshold: int, spent: str, uncounted: str) -> str:
    later = f"""count(*) over (partition by category, start_rn order by us
      range between unbounded preceding and {COOLDOWN_US - 1} following) + 1"""
    return f"""{name}_places as (select *, {later} as nxt_place, {uncounted} as uncounted from {windows}),
      {name} as (
      select *, {spent} + 1 as sent from {name}_places where place - uncounted = {threshold}
      union all
      select p.*, a.sent + 1 from {name} a join {name}_places p
        on p.category = a.category and p.start_rn = a.start_rn and p.place = a.nxt_place
      where a.sent < 10)"""


LEVELED = f"{LOG}, leveled as (select *, epoch_us(ts) as us, {_level('content')} as level from log)"
SEVERE = f"""{LEVELED}, {_windows('severe', "select level as category, event_id, ts, us from leveled where level in ('ERROR', 'CRITICAL')")}"""
FEED = f"""{SEVERE}, feed as (
  select event_id, ts, us, level from leveled where level not in ('ERROR', 'CRITICAL')
  union all select event_id, ts, us, category from severe where place <= 10)"""
OVERALL = f"""{FEED}, {_windows('overall', "select 'AGGREGATE_TRAFFIC' as category, event_id, ts, us from feed")}"""
_LATER = "case when start_rn = 1 then 0 else 1 end"
SEVERE_ALERTS = f"{SEVERE}, {_alerts('severe_alerts', 'severe', 11, '0', '0')}"
OVERALL_ALERTS = f"{OVERALL}, {_alerts('overall_alerts', 'overall', 100, _LATER, _LATER)}"
_ALERT_COLUMNS = "category, window_start, ts, place - uncounted as count"
ALERTS = f"""{OVERALL_ALERTS}, {_alerts('severe_alerts', 'severe', 11, '0', '0')}, heads as (
  select category, {_first_ip('content')} as ip from (
    select level as category, arg_min(content, (ts, event_id)) as content from leveled
    where level in ('ERROR', 'CRITICAL') group by level
    union all select 'AGGREGATE_TRAFFIC', arg_min(content, (ts, event_id)) from leveled)), points as (
  select {_ALERT_COLUMNS} from severe_alerts union all select {_ALERT_COLUMNS} from overall_alerts), alerts as (
  select p.*, h.ip from points p left join heads h on h.category = p.category), routed as (
  select a.*, u.url, u.kind from alerts a, (values {', '.join(map(str, URLS))}) u(url, kind))"""
_IP_TEXT = "coalesce(ip, '<nil>')"
_HEADLINE = "Traffic is above its limit."
_DISCORD = f"""cast(to_json({{'content': '', 'embeds': [{{
  'title': category, 'description': '{_HEADLINE}', 'color': 16777215, 'fields': [
    {{'name': 'Errors', 'value': '{_HEADLINE}', 'inline': false}},
    {{'name': 'Category', 'value': category, 'inline': true}},
    {{'name': 'Start Time', 'value': {_alert_time('window_start')}, 'inline': true}},
    {{'name': 'Counts', 'value': cast(count as varchar), 'inline': true}},
    {{'name': 'IP', 'value': {_IP_TEXT}, 'inline': true}}],
  'author': {{'name': 'lograin'}}, 'footer': {{'text': 'log distillation'}},
  'timestamp': {_rfc3339('ts')}}}]}}) as varchar)"""
_SLACK = f"""concat('{{"text":"","blocks":[{{"type":"header","text":{{"type":"plain_text","text":"', category,
  '","emoji":true}}}},{{"type":"section","text":{{"type":"mrkdwn","text":"```{_HEADLINE}\\nCount: ', cast(count as varchar),
  ' - Start Time: ', {_alert_time('window_start')}, ' - Category: ', category, ' - IP: ', {_IP_TEXT},
  '```"}}}},{{"type":"divider"}},{{"type":"context","elements":[{{"type":"plain_text","text":"Author: lograin","emoji":true}}]}}]}}')"""


def _lines(result: str) -> str:
    return f"with {LINES} select origin, id, line_no, {result} as result from lines"


def oracle_sql() -> dict[str, str]:
    low = "lower(content)"
    text_lines = f"{DOC_LINES} select regexp_replace(content, '\\r$', '') as content from doc_lines"
    interval_columns = "window_start, window_end, source, message, count, first_seen, last_seen, level"
    daily_frames = f"""select distinct strftime(report_day, '%Y-%m-%d') as report_date, line from daily,
      (values ('DIARY REPORT - Set time: [06:00:00]')) t(line)
      union all select distinct strftime(report_day, '%Y-%m-%d'), '{RULE}' from daily
      union all select distinct strftime(report_day, '%Y-%m-%d'), '{RULE}' from daily"""
    return {
        "text_lines": f"with {text_lines}",
        "source_by_extension": f"""with {DOC_LINES}
          select '.txt' as extension, 'text' as kind, regexp_replace(content, '\\r$', '') as content from doc_lines
          union all select '.json', 'json', cast(to_json({{'event_id': event_id, 'event_type': event_type, 'props': props}}) as varchar)
          from events""",
        "stream_entries": f"with {LOG} select * from log",
        "log_entries": f"with {LOG} select * from log",
        "format_times": f"""select event_id, {_clock('ts')} as clock, strftime(ts, '%Y-%m-%d') as day,
          {_alert_time('ts')} as alert_time from events""",
        "trim_space": _lines(_trim("content")),
        "strip_ipv4": _lines(_cut("content", _IP)),
        "strip_log_id": _lines(_no_id("content")),
        "lower_text": _lines(low),
        "strip_dates": _lines(_cut(low, _DATE)),
        "strip_levels": _lines(_no_levels("content")),
        "extract_level": _lines(_level("content")),
        "remove_words": _lines(_cut(low, "|".join(WORDS))),
        "remove_many_words": _lines(_cut(low, "|".join(MANY_WORDS))),
        "sanitize_line": _lines(_sanitized("content", WORDS)),
        "mask_digits": _lines(_masked("content")),
        "cluster_key": _lines(_key("content")),
        "entry_level": _lines(_level("content")),
        "first_ip": _lines(_first_ip("content")),
        "severity_filter": f"""with {KEYED}
          select event_id, ts, level, message from keyed where level in ('ERROR', 'CRITICAL')""",
        "log_stats": f"with {STATS} select * from stats",
        "file_stats": f"""with {DOC_LINES} select 'file-reader' as source, {_key('content')} as message, count(*) as count
          from doc_lines group by 2""",
        "file_distiller": f"""with {DOC_LINES} select 'file-reader' as source, {_key('content')} as message, count(*) as count
          from doc_lines group by 2""",
        "folder_distiller": f"""with {DOC_LINES}, {PRETTY}, {_shapes()}, {_COUNTS}
          select 'json' as kind, * from counts
          union all select 'text', 'file-reader', {_key('content')}, count(*) from doc_lines group by 3""",
        "interval_report": f"with {INTERVALS} select {interval_columns} from intervals",
        "stream_log_stats": f"with {INTERVALS} select {interval_columns} from intervals",
        "daily_report": f"with {DAILY} select {interval_columns}, report_day from daily",
        "daily_report_merged": f"""with {DAILY} select report_day, source, message, sum(count)::bigint as count,
          min(first_seen) as first_seen, max(last_seen) as last_seen, arg_min(level, window_start) as level
          from daily group by report_day, source, message""",
        "interval_union": f"""with {INTERVALS}, {TURNS}, keyed_turns as ({_keyed('turns')})
          select {interval_columns} from intervals union all {_intervals('keyed_turns')}""",
        "final_report": f"""with {INTERVALS} select {interval_columns} from intervals
          where window_end > (select max(ts) from log)""",
        "nonempty_report": f"""with {INTERVALS} select window_start, window_end, count(*) as messages
          from intervals group by window_start, window_end""",
        "console_report": f"with {STATS} " + _lines_of("stats", "\tFINAL REPORT", _MESSAGE),
        "interval_console_reports": f"with {INTERVALS} "
        + _lines_of("intervals", "\tPARTIAL REPORT", _MESSAGE, "window_start,"),
        "stream_interval_reports": f"with {INTERVALS} select window_start, line from ("
        + _lines_of("intervals", "\tPARTIAL REPORT", _MESSAGE, "window_start,") + ")",
        "daily_file": f"""with {DAILY} {daily_frames}
          union all (select strftime(report_day, '%Y-%m-%d'), line from (
            select distinct report_day, window_start, {_ORIGIN} as line, source from daily))
          union all select strftime(report_day, '%Y-%m-%d'), {_MESSAGE} from daily""",
        "file_report": f"with {STATS} select line from ({_lines_of('stats', chr(9) + 'RESULT', _MESSAGE)})",
        "json_documents": f"with {BODIES} select doc_id, pos, {_KIND.format('json_type(doc)')} as kind from docs",
        "json_values": """select event_id as doc_id, kind, n from events, (values ('object', 1), ('object', 2), ('array', 1)) k(kind, n)
          where case when event_id % 20 = 0 then kind = 'array' or n = 2
            when event_id % 20 = 4 then kind = 'array' when event_id % 20 = 1 or event_id % 100 = 3 then false
            else kind = 'object' and n = 1 end""",
        "json_rejects": """select event_id as doc_id,
            case when event_id % 20 = 1 then '{"a":' || event_id when event_id % 20 = 2 then 'and more'
              else repeat('[', 1200) || '1' || repeat(']', 1200) end as rejected,
            case when event_id % 100 = 3 then 'nested too deep' else 'malformed' end as fault
          from events where event_id % 20 in (1, 2) or event_id % 100 = 3""",
        "json_stream": f"with {PRETTY} select fullkey as path, kind, value, count(*) as n from nodes group by all",
        "json_is_id": f"""with {DOC_LINES}, texts as (
          select unnest([md5(cast(event_id as varchar)), to_hex(event_id), event_type]) as value from events
          union all select url from pages union all select content from doc_lines)
          select value, {_is_id('value')} as is_id from texts""",
        "json_nodes": f"with {NODES} select doc_id, pos, fullkey as path, kind, value from nodes",
        "sort_keys": f"""with {BODIES} select doc_id, pos,
          array_to_string(list_sort(json_keys(doc)), ',') as sorted_keys from docs where json_type(doc) = 'OBJECT'""",
        "json_shape": f"with {SHAPES} select doc_id, pos, shape from s0",
        "nonempty_shape": f"with {SHAPES} select doc_id, pos, shape from s0 where shape <> ''",
        "json_shape_counts": f"with {SHAPE_COUNTS} select * from counts",
        "json_report": f"with {SHAPE_COUNTS} "
        + _lines_of("counts", "\tRESULT", "concat('- Data: [', message, '] - Count: [', cast(count as varchar), ']')"),
        "origin_payload": f"with {STATS} " + _payloads("stats"),
        "origin_payload_parts": f"with {STATS} " + _payloads("stats"),
        "report_payload": f"with {STATS} " + _bodies("stats"),
        "report_payload_parts": f"with {STATS} " + _bodies("stats"),
        "payload_formatter": f"with {STATS} " + _bodies("stats"),
        "day_payloads": f"with {DAILY} " + _bodies("daily", "report_day, window_start,"),
        "enabled_integrations": """select url, page_id % 2 = 0 as on_aggregation from pages where page_id % 2 = 0""",
        "integration_fanout": f"""with {INTERVALS} select window_start, window_end, count(*) as messages,
          'https://example.org/ingest' as url from intervals group by window_start, window_end""",
        "integration_outbox": f"""with {INTERVALS} select window_start, 'https://example.org/ingest' as url,
          '{{"X-Token":"t1","User-Agent":"lograin/1"}}' as headers, body from ({_bodies('intervals', 'window_start,')})""",
        "severity_windows": f"""with recursive {SEVERE}
          select event_id, ts, category as level, window_start, place as count from severe""",
        "severity_alerts": f"with recursive {SEVERE_ALERTS} select {_ALERT_COLUMNS} from severe_alerts",
        "overall_input": f"with recursive {FEED} select event_id, ts, level from feed",
        "overall_windows": f"""with recursive {OVERALL}
          select event_id, ts, window_start, place - {_LATER} as count from overall""",
        "overall_alerts": f"with recursive {OVERALL_ALERTS} select {_ALERT_COLUMNS} from overall_alerts",
        "burst_ip": f"with recursive {ALERTS} select category, ip from heads",
        "alerts": f"with recursive {ALERTS} select category, window_start, ts, count, ip from alerts",
        "stream_alerts": f"with recursive {ALERTS} select category, window_start, ts, count, ip from alerts",
        "alert_routing": f"with recursive {ALERTS} select category, window_start, ts, count, url, kind from routed",
        "discord_payload": f"""with recursive {ALERTS}
          select category, ts, url, {_DISCORD} as body from routed where kind = 'discord'""",
        "slack_payload": f"""with recursive {ALERTS}
          select category, ts, url, {_SLACK} as body from routed where kind = 'slack'""",
    }
