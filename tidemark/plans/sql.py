"""DuckDB's form of the views and functions, for the queries' SQL."""

from __future__ import annotations

from tidemark.functions.urls import AMP_SWITCHES, REGISTRIES, TRACKING
from tidemark.functions.words import LEAST, STOP, SUFFIXES


def quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def title_key(x: str) -> str:
    return rf"""trim(regexp_replace(regexp_replace(regexp_replace(replace(lower({x}),'ß','ss'),'[‘’‚‛''`´.]','','g'),'[^\p{{L}}\p{{N}}_\s]',' ','g'),'\s+',' ','g'))"""


def part(url: str, which: str) -> str:
    pattern = {"scheme": "^([A-Za-z]+):", "host": "^[A-Za-z]+://(?:[^/?#@]*@)?([^/?#:]*)", "path": "^[A-Za-z]+://[^/?#]*([^?#]*)", "query": r"^[^?#]*\?([^#]*)"}[which]
    out = f"regexp_extract({url}, '{pattern}', 1)"
    return f"lower({out})" if which in ("scheme", "host") else out


def normalised(url: str) -> str:
    path = part(url, "path")
    kept = f"list_sort([x for x in string_split({part(url, 'query')}, '&') if x <> '' and split_part(lower(x), '=', 1) not in ({quoted(TRACKING)}) and not starts_with(lower(x), 'at_') and not starts_with(lower(x), 'utm_')])"
    trimmed = f"case when length({path}) > 1 then regexp_replace({path}, '/+$', '') else {path} end"
    return f"({part(url, 'scheme')} || '://' || {part(url, 'host')} || {trimmed} || case when len({kept}) > 0 then '?' || array_to_string({kept}, '&') else '' end)"


def match_key(whole: str) -> str:
    """Of a normalised link."""
    host, path = part(whole, "host"), part(whole, "path")
    kept = f"[x for x in string_split({part(whole, 'query')}, '&') if x <> '' and split_part(lower(x), '=', 1) not in ({quoted(AMP_SWITCHES)})]"
    bare = rf"case when length({host}) - length(replace({host}, '.', '')) > 1 then regexp_replace({host}, '^(www|amp|m|mobile)\.', '') else {host} end"
    segments = f"array_to_string([s for s in string_split(regexp_replace({path}, '/{{2,}}', '/', 'g'), '/') if s <> 'amp'], '/')"
    trimmed = rf"regexp_replace(regexp_replace(regexp_replace({segments}, '\.amp$', ''), '/+$', ''), '^/+', '')"
    return f"({bare} || '/' || {trimmed} || case when len({kept}) > 0 then '?' || array_to_string({kept}, '&') else '' end)"


def site(host: str) -> str:
    labels = rf"string_split(regexp_replace(lower({host}), '^www\.', ''), '.')"
    return f"(case when len({labels}) >= 3 and length({labels}[-1]) = 2 and {labels}[-2] in ({quoted(REGISTRIES)}) then array_to_string({labels}[-3:], '.') else array_to_string({labels}[-2:], '.') end)"


def stem(w: str) -> str:
    cases = " ".join(f"when ends_with({w}, '{s}') and length({w}) >= {LEAST + len(s)} then left({w}, length({w}) - {len(s)})" for s in SUFFIXES)
    return f"case when regexp_matches({w}, '^[0-9]+$|(ss|us|is)$') then {w} {cases} else {w} end"


def tokens(text: str) -> str:
    raw = rf"regexp_extract_all(replace(lower({text}), 'ß', 'ss'), '[\p{{L}}\p{{N}}]+(?:[''’][\p{{L}}\p{{N}}]+)*')"
    plain = f"[regexp_replace(regexp_replace(r, '[''’]s$', ''), '[''’]', '', 'g') for r in {raw}]"
    stems = f"[{stem('w')} for w in {plain}]"
    return f"[t for t in {stems} if t not in ({quoted(STOP)}) and (length(t) >= 3 or regexp_matches(t, '[0-9]'))]"


LIVE = r"(regexp_matches({path}, '(?i)/(live|liveblog)(/|$)') or regexp_matches({title}, '(?i)(^|\s)live(\s+(updates|blog))?\s*[:|–—]'))"
MEDIA = r"({live} or regexp_matches({title}, '(?i)^\s*(watch|video|listen|live|podcast|in pictures|pictures|photos|gallery)\s*[:|–—-]') or regexp_matches({url}, '(?i)/(videos?|av|live|podcasts?|audio|gallery)/'))"

HEADLINES = rf"""h0 as (select doc_id as id, source, upper(lang) as tag, trim(string_split(trim(text), chr(10))[1]) as title,
  nullif(trim(regexp_replace(array_to_string(string_split(ltrim(text), chr(10))[1:3], chr(10)), '^[^\n]*\n?', '')), '') as summary,
  case when doc_id % 3 = 0 then 'http://www.' else 'https://' end || source || '.example.co.uk/' || lang || '/' || case when doc_id % 11 = 0 then 'live/' else '' end || 'story-' || (doc_id % 400)
  || case doc_id % 5 when 0 then '?utm_source=feed' when 1 then '?page=2&at_medium=RSS#top' else '' end as url,
  timestamp '2024-01-01 00:00:00' + doc_id * 31 * interval 1 minute as fetched_at from documents),
headlines as (select *, case when id % 7 <> 0 then fetched_at - (id % 50) * interval 1 minute end as published_at, {LIVE.format(path=part("url", "path"), title="title")} as is_live from h0)"""

VERSIONS = f"""{HEADLINES}, versions as (select id, source, title, tag, fetched_at as seen_at, is_live, {title_key("title")} as content_key, {normalised("url")} as article_key from headlines)"""
REVISIONS = f"""{VERSIONS}, seen as (select article_key, title, min(id) as id from versions group by all),
revisions as (select v.article_key, v.title, v.id, v.source, v.tag, v.seen_at, v.content_key, lag(v.title) over w as prev_title,
  lag(v.content_key) over w as prev_key, row_number() over w as revision from seen join versions v using (id)
  window w as (partition by v.article_key order by v.id))"""
