"""What each query must return, as SQL over the driver tables.

The SQL restates the rules on its own terms: windows for the preferred row, ``exists``
for shadowing, full joins for diffs and a recursive choice for the matching.
"""

CAPTURED = r"""
captured as (
  select 'host-' || lpad((o_custkey % 20)::varchar, 2, '0') as host,
    strftime(date_trunc('quarter', o_orderdate), '%Y-%m-%d') as snapshot_id,
    date_trunc('quarter', o_orderdate) as scan_ts,
    l_orderkey * 8 + l_linenumber as ord,
    concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity::bigint,
      round(l_extendedprice * 100)::bigint) as mark,
    case when l_partkey % 41 = 0 then '   '
      when l_partkey % 37 = 0 then 'KB' || l_partkey
      when l_partkey % 31 = 0 then 'Security Update for ' || p_name
      when l_suppkey % 13 = 0 then p_name || ' suite ' || l_linenumber || '.0'
      when l_suppkey % 19 = 0 then string_split(p_name, ' ')[1]
      when l_linenumber % 2 = 1 then upper(p_name)
      when l_linenumber % 3 = 0 then '  ' || p_name || ' '
      else p_name end as raw_name,
    (l_linenumber % 3) || '.0' as raw_version,
    case when l_suppkey % 7 = 0 then null when l_linenumber % 2 = 1 then upper(p_type)
      else p_type end as raw_publisher,
    case l_orderkey % 7 when 0 then strftime(l_shipdate, '%Y%m%d')
      when 1 then strftime(l_shipdate, '%Y-%m-%d')
      when 2 then month(l_shipdate) || '/' || day(l_shipdate) || '/' || year(l_shipdate)
      when 3 then strftime(l_shipdate, '%m/%d/%Y')
      when 4 then year(l_shipdate) || '/' || month(l_shipdate) || '/' || day(l_shipdate)
      when 5 then day(l_shipdate) || '-' || month(l_shipdate) || '-' || year(l_shipdate)
      else year(l_shipdate) || '0230' end as raw_date,
    'C:\Apps\' || p_type || case when l_linenumber % 2 = 0 then '\' else '' end as raw_location,
    case l_partkey % 11 when 0 then null when 1 then '-5' when 2 then 'n/a' when 3 then '12.7'
      when 4 then ' 1_' || lpad((l_suppkey % 1000)::varchar, 3, '0') || ' '
      else trunc(l_extendedprice * 10)::bigint::varchar end as raw_size,
    case l_suppkey % 17 when 0 then '1' when 1 then 'Yes' when 2 then '0x1' when 3 then '0'
      when 4 then ' TRUE ' else null end as raw_system,
    case when l_partkey % 23 = 0 then 'Update' when l_partkey % 29 = 0 then ' HotFix '
      else null end as raw_release,
    case when l_linenumber % 4 = 0 then null else 'remove ' || l_partkey end as raw_uninstall,
    l_suppkey % 5 = 0 as packaged,
    (l_suppkey % 4)::int as view,
    p_name, p_type, l_linenumber, l_suppkey, l_partkey, l_orderkey, l_extendedprice
  from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey
)"""


def clean(text: str) -> str:
    return f"nullif(trim({text}), '')"


def date_of(text: str) -> str:
    digits = rf"regexp_replace({text}, '\D', '', 'g')"
    day = (
        f"case when length({digits}) = 8 then try_strptime({digits}, '%Y%m%d')"
        f" else coalesce(try_strptime({text}, '%m/%d/%Y'), try_strptime({text}, '%Y/%m/%d'),"
        f" try_strptime({text}, '%d-%m-%Y')) end"
    )
    return f"case when year({day}) >= 1980 then strftime({day}, '%Y-%m-%d') end"


def whole(text: str) -> str:
    return (
        f"case when regexp_full_match(trim({text}), '[+-]?[0-9]+(_[0-9]+)*')"
        f" then try_cast(replace(trim({text}), '_', '') as bigint) end"
    )


def size_of(text: str) -> str:
    return f"case when {whole(text)} >= 0 then {whole(text)} end"


def flag_of(text: str) -> str:
    return (
        f"coalesce({whole(text)} <> 0, lower(trim({text})) in ('1', 'true', 'yes'), false)"
    )


UPDATE = r"""(lower(trim(coalesce(release_type, ''))) in
  ('security update', 'update', 'hotfix', 'service pack')
  or regexp_matches(name, '(?i)^KB\d+|^Security Update\b|^Update for\b|^Hotfix for\b|\bHotfix\b'))"""

SCORE = """((version is not null)::int + (publisher is not null)::int + (install_date is not null)::int
  + (install_location is not null)::int + (estimated_size_kb is not null)::int
  + (uninstall_string is not null)::int + (quiet_uninstall_string is not null)::int
  + (release_type is not null)::int)"""

FIELDS = (
    "name, version, publisher, install_date, install_location, estimated_size_kb, scope,"
    " architecture, uninstall_string, quiet_uninstall_string, registry_path, release_type,"
    " system_component, source"
)
ROW = f"host, snapshot_id, {FIELDS}, ord"

FLEET = f"""
fleet as (
  select host, snapshot_id, scan_ts, trim(raw_name) as name, {clean('raw_version')} as version,
    {clean('raw_publisher')} as publisher, {date_of('raw_date')} as install_date,
    {clean('raw_location')} as install_location, {size_of('raw_size')} as estimated_size_kb,
    case when packaged then 'current_user' else 'machine' end as scope,
    case when view = 0 then '64-bit' else '32-bit' end as architecture,
    {clean('raw_uninstall')} as uninstall_string, null::varchar as quiet_uninstall_string,
    case when packaged then 'appx:' else 'HKEY_LOCAL_MACHINE\\Apps\\' end || mark as registry_path,
    {clean('raw_release')} as release_type, {flag_of('raw_system')} as system_component,
    case when packaged then 'appx' else 'registry' end as source, ord
  from captured
)""".replace("\\\\", "\\")


def deduped(source: str) -> str:
    return f"""
deduped as (
  select * replace (first_ord as ord) from (
    select *, min(ord) over same as first_ord,
      row_number() over (same order by {SCORE} desc, registry_path, ord) as nth
    from {source}
    window same as (partition by host, snapshot_id, lower(trim(name)), lower(coalesce(version, '')),
      lower(coalesce(publisher, '')), rtrim(lower(coalesce(install_location, '')), '\\/')))
  where nth = 1
)""".replace("\\\\", "\\")


MERGED = """
listed as (
  select distinct host, snapshot_id, lower(name) as n, coalesce(lower(publisher), '') as p
  from deduped where source = 'registry' and name <> ''
),
listed_names as (
  select host, snapshot_id, n, bool_or(p = '') as unknown from listed group by all
),
merged as (
  select d.* from deduped d
  left join listed_names s on d.host = s.host and d.snapshot_id = s.snapshot_id and lower(d.name) = s.n
  left join listed l on d.host = l.host and d.snapshot_id = l.snapshot_id and lower(d.name) = l.n
    and lower(d.publisher) = l.p
  where d.source <> 'appx'
    or coalesce(not (l.n is not null or s.unknown or (d.publisher is null and s.n is not null)), true)
)"""


def reason_of(system: bool = False, updates: bool = False, search: str | None = None) -> str:
    parts = ["when trim(name) = '' then 'blank'"]
    if not system:
        parts.append("when system_component then 'system'")
    if not updates:
        parts.append(f"when {UPDATE} then 'update'")
    if search:
        parts.append(
            f"when not (contains(lower(name), '{search}') or"
            f" contains(lower(coalesce(publisher, '')), '{search}') or"
            f" contains(lower(coalesce(version, '')), '{search}')) then 'search'"
        )
    return f"case {' '.join(parts)} end"


def base(source: str = "fleet", extra: str = "") -> str:
    return f"with recursive {CAPTURED},{FLEET}{extra},{deduped(source)},{MERGED}"


def prepared(source: str = "fleet", extra: str = "", **options) -> str:
    return f"""{base(source, extra)},
judged as (select *, {reason_of(**options)} as reason from merged),
prepared as (select * from judged where reason is null)"""


HISTORY = r"""
history as (
  select host, snapshot_id, scan_ts, p_name as name, raw_version as version, p_type as publisher,
    null::varchar as install_date, 'C:\Apps\' || p_type as install_location,
    null::bigint as estimated_size_kb, 'machine' as scope,
    case when l_suppkey % 5 = 0 then '32-bit' else '64-bit' end as architecture,
    null::varchar as uninstall_string, null::varchar as quiet_uninstall_string,
    case when length(p_name) % 2 = 0 then 'appx:' || p_name || '_' || p_type
      else 'HKEY_LOCAL_MACHINE\Apps\' || mark end as registry_path,
    null::varchar as release_type, false as system_component,
    case when length(p_name) % 2 = 0 then 'appx' else 'registry' end as source, ord
  from captured
)"""


def indexed(source: str, group: str) -> str:
    return f"""
indexed as (
  select * exclude (nth) from (
    select *, row_number() over (partition by {group}, identity_1, identity_2, identity_3
      order by {SCORE} desc, registry_path, ord) as nth
    from (
      select *,
        case when pkg then lower(registry_path) else lower(trim(name)) end as identity_1,
        case when pkg then '' else lower(coalesce(publisher, '')) end as identity_2,
        case when pkg then lower(architecture)
          else rtrim(lower(coalesce(install_location, '')), '\\/') end as identity_3
      from (select *, source = 'appx' and starts_with(lower(registry_path), 'appx:') as pkg
        from {source})))
  where nth = 1
)""".replace("\\\\", "\\")


COMPARED = (
    "name",
    "version",
    "publisher",
    "install_date",
    "install_location",
    "estimated_size_kb",
    "scope",
    "architecture",
    "uninstall_string",
    "quiet_uninstall_string",
    "release_type",
    "system_component",
)
DIFFERS = " or ".join(f"o.{field} is distinct from n.{field}" for field in COMPARED)
IDENTITY = "identity_1, identity_2, identity_3"
PAIR = "host, old_snapshot_id, snapshot_id"
JOINED_IDENTITY = ", ".join(
    f"coalesce(n.identity_{i}, o.identity_{i}) as identity_{i}" for i in (1, 2, 3)
)
SAME_IDENTITY = " and ".join(f"n.identity_{i} = o.identity_{i}" for i in (1, 2, 3))
STATUS = f"""case when o.name is null then 'added' when n.name is null then 'removed'
  when {DIFFERS} then 'changed' else 'unchanged' end as status"""

PAIRED = f"""with recursive {CAPTURED},{HISTORY},{indexed('history', 'host, snapshot_id')},
pairs as (
  select * from (
    select host, snapshot_id, lag(snapshot_id) over (partition by host order by scan_ts, snapshot_id)
      as old_snapshot_id
    from (select distinct host, snapshot_id, scan_ts from history))
  where old_snapshot_id is not null
),
olds as (select p.old_snapshot_id as old_of, p.snapshot_id as new_of, i.* from pairs p join indexed i
  on p.host = i.host and p.old_snapshot_id = i.snapshot_id),
news as (select p.old_snapshot_id as old_of, p.snapshot_id as new_of, i.* from pairs p join indexed i
  on p.host = i.host and p.snapshot_id = i.snapshot_id),
diff as (
  select coalesce(n.host, o.host) as host, coalesce(n.old_of, o.old_of) as old_snapshot_id,
    coalesce(n.new_of, o.new_of) as snapshot_id, {JOINED_IDENTITY}, {STATUS},
    coalesce(n.name, o.name) as name, o.version as old_version, n.version as new_version,
    o as o, n as n
  from news n full join olds o
    on n.host = o.host and n.new_of = o.new_of and {SAME_IDENTITY}
)"""

CATALOG = r"""
catalog as (
  select case when p_partkey % 3 = 0 then p_name else p_name || ' ' || p_size || '.0' end as name,
    case when p_partkey % 10 = 0 then 'ARP\' else '' end || p_brand || '.' || p_partkey as package_id,
    p_size || '.0' as version,
    case p_partkey % 4 when 0 then '' when 1 then 'msstore' else 'winget' end as source,
    p_partkey as ord
  from part
),
importable as (
  select * from catalog where not (starts_with(package_id, 'ARP\') or starts_with(package_id, 'MSIX\'))
    and (source in ('winget', 'msstore') or contains(package_id, '.') and not contains(package_id, '\'))
)"""


def key_of(name: str) -> str:
    text = rf"regexp_replace(lower(trim({name})), '\s+', ' ', 'g')"
    version = r"[\s\-_]*(?:v(?:er(?:sion)?)?[\s\-_]*)?\d+(?:\.\d+){0,3}(?:\+\d+)?$"
    short = f"trim(regexp_replace({text}, '{version}', ''), ' -_')"
    return f"coalesce(nullif({short}, ''), {text})"


def matched(catalog: str, by: str = "") -> str:
    """The choice application by application; ``by``: the column that catalogs are told apart by."""
    of = f"{by}, " if by else ""
    same = f"w.{by} = names.{by} and " if by else ""
    wished = f"q.{by} = w.{by} and " if by else ""
    listed = f"q.{by} = o.{by} and " if by else ""
    using = f"({of}offer_key)"
    return f"""{prepared()},{catalog},
queue as (
  select *, {key_of('name')} as wish_key, row_number() over (partition by host, snapshot_id
    order by lower(name), registry_path, ord) as position
  from prepared
),
offers as (select *, {key_of('name')} as offer_key from importable),
names as (select {of}offer_key, min(ord) as first_ord from offers group by all),
wishes as (
  select {f"w.{by}, " if by else ""}w.wish_key, names.offer_key, case when w.wish_key = names.offer_key then 'exact'
      else 'containment' end as kind,
    row_number() over (partition by {f"w.{by}, " if by else ""}w.wish_key order by w.wish_key <> names.offer_key,
      -least(length(w.wish_key), length(names.offer_key)), first_ord) as nth
  from (select distinct {of}wish_key from queue) w join names on {same}(w.wish_key = names.offer_key
    or (length(w.wish_key) >= 4 and length(names.offer_key) >= 4
      and (contains(w.wish_key, names.offer_key) or contains(names.offer_key, w.wish_key))))
),
options as (
  select {of}wish_key, package_id, kind, offers.name as package_name, version as package_version,
    row_number() over (partition by {of}wish_key order by nth, ord) as preference
  from wishes join offers using {using}
  qualify row_number() over (partition by {of}wish_key, package_id order by nth, ord) = 1
),
wished as (select {of}wish_key, list(package_id order by preference) as ids from options group by all),
choice as (
  select host, snapshot_id, 0::bigint as position, []::varchar[] as used, null::varchar as package_id
  from (select distinct host, snapshot_id from queue)
  union all
  select c.host, c.snapshot_id, q.position,
    case when pick is null then used else list_append(used, pick) end, pick
  from (
    select c.host, c.snapshot_id, q.position, c.used,
      list_filter(coalesce(w.ids, []), lambda id: not list_contains(c.used, id))[1] as pick
    from choice c join queue q
      on c.host = q.host and c.snapshot_id = q.snapshot_id and q.position = c.position + 1
    left join wished w on {wished}q.wish_key = w.wish_key
  ) q, (select 1) one, lateral (select q.host, q.snapshot_id) c
),
matches as (
  select q.*, o.kind as match_kind, c.package_id, o.package_name, o.package_version
  from queue q join choice c
    on q.host = c.host and q.snapshot_id = c.snapshot_id and q.position = c.position
  left join options o on {listed}q.wish_key = o.wish_key and c.package_id = o.package_id
)"""


MATCHED = matched(CATALOG)
HOST_CATALOGS = """
importable as (
  select distinct host, case when l_partkey % 3 = 0 then p_name else p_name || ' 1.0' end as name,
    'Maker.' || (l_partkey - (l_partkey % 10 = 1)::int) as package_id, '1.0' as version, 'winget' as source, l_partkey as ord
  from captured
)"""


def json_row(alias: str = "") -> str:
    prefix = f"{alias}." if alias else ""
    pairs = ", ".join(f"'{f.strip()}': {prefix}{f.strip()}" for f in FIELDS.split(","))
    return f"to_json({{{pairs}}})::varchar"


STATS = """
stats as (
  select host, snapshot_id, coalesce(raw, 0)::bigint as raw_entry_count,
    greatest(0, raw - coalesce(kept, 0))::bigint as deduplicated_count,
    coalesce(hidden_system, 0)::bigint as filtered_system_component_count,
    coalesce(hidden_update, 0)::bigint as filtered_update_count,
    coalesce(shown, 0)::bigint as result_count, scan_ts
  from (select host, snapshot_id, count(*) as raw, min(scan_ts) as scan_ts from fleet group by all)
  left join (select host, snapshot_id, count(*) as kept,
      count(*) filter (reason = 'system') as hidden_system,
      count(*) filter (reason = 'update') as hidden_update,
      count(*) filter (reason is null) as shown
    from judged group by all) using (host, snapshot_id)
)"""
COUNTERS = (
    "raw_entry_count, deduplicated_count, filtered_system_component_count, filtered_update_count,"
    " result_count"
)

SCAN = """
scans as (
  select host, snapshot_id, strftime(scan_ts, '%Y-%m-%dT%H:%M:%SZ') as started_at,
    strftime(scan_ts + interval 3 second, '%Y-%m-%dT%H:%M:%SZ') as completed_at,
    3000::bigint as duration_ms, host as hostname, 'Windows' as platform,
    """ + COUNTERS + """
  from stats
)"""
SCAN_JSON = (
    "to_json({'started_at': started_at, 'completed_at': completed_at, 'duration_ms': duration_ms,"
    " 'hostname': hostname, 'platform': platform, 'collector_sources': []::varchar[], "
    + ", ".join(f"'{c.strip()}': {c.strip()}" for c in COUNTERS.split(","))
    + "})::varchar"
)


def report_sql(head: str, tail: str) -> str:
    return f"""{prepared()},{STATS},{SCAN},
bodies as (
  select host, snapshot_id, case when row_number() over (partition by host, snapshot_id
    order by lower(name), registry_path, ord) = 1 then '' else ',' end || {json_row()} as piece
  from prepared
)
select host, snapshot_id, 0 as section, {head} as piece from scans
union all select host, snapshot_id, 1, piece from bodies
union all select host, snapshot_id, 2, '{tail}' from scans"""


def change_json(field: str) -> str:
    return (
        f"case when o.{field} is distinct from n.{field} then "
        f"to_json({{'field': '{field}', 'old': o.{field}, 'new': n.{field}}})::varchar end"
    )


def shown(side: str, field: str) -> str:
    value = f"{side}.{field}"
    if field == "estimated_size_kb":
        text = f"{value}::varchar"
    elif field == "system_component":
        text = f"case when {value} then 'True' else 'False' end"
    else:
        text = f"'''' || replace({value}, '\\', '\\\\') || ''''"
    return f"coalesce({text}, 'None')"


CHANGE_LINES = ", ".join(
    f"case when o.{f} is distinct from n.{f} then"
    f" '      {f}: ' || {shown('o', f)} || ' → ' || {shown('n', f)} end"
    for f in COMPARED
)

SUMMARY = """
summary as (
  select host, old_snapshot_id, snapshot_id, count(*) filter (status = 'added')::bigint as added,
    count(*) filter (status = 'removed')::bigint as removed,
    count(*) filter (status = 'changed')::bigint as changed,
    count(*) filter (status = 'unchanged')::bigint as unchanged
  from diff group by all
)"""

PATH = "case status when 'added' then n.registry_path when 'removed' then o.registry_path else '' end"

HUMAN = """case when kb is null then '' when kb < 1024 then kb || ' KB'
  when kb / 1024.0::double < 1024 then
    case when kb / 1024.0::double >= 100 or kb % 1024 = 0
      then round_even(kb / 1024.0::double, 0)::bigint || ' MB'
      else printf('%.1f MB', round_even(kb / 1024.0::double, 1)) end
  else case when kb / 1048576.0::double >= 100 or kb % 1048576 = 0
      then round_even(kb / 1048576.0::double, 0)::bigint || ' GB'
      else printf('%.1f GB', round_even(kb / 1048576.0::double, 1)) end end"""


def cell_sql(value: str, width: int) -> str:
    return (
        f"case when length({value}) > {width} then substr({value}, 1, {width - 1}) || '…'"
        f" else rpad({value}, {width}, ' ') end"
    )


CELLS = (
    ("name", 36), ("version", 14), ("publisher", 24), ("scope", 12), ("architecture", 12),
    ("install_date", 12), ("size", 10), ("source", 8),
)

# Captures as text: the expected rows follow from the rules that made the texts.

SNAPSHOT_BAD = """case o_orderkey % 11 when 1 then 'schema_version is not supported'
  when 2 then 'a row has no name' when 3 then 'a row has a bad estimated_size_kb'
  when 5 then 'invalid JSON' when 6 then 'schema_version is missing' end"""

PACKAGE_ROWS = """
rows_of as (
  select 'host-' || lpad((o_custkey % 20)::varchar, 2, '0') as host, 'scan-' || o_orderkey as snapshot_id,
    o.*, k from orders o, (values (0), (2)) v(k)
  where o_orderkey % 13 not in (0, 2, 3) and (k = 0 or o_orderkey % 13 <> 1)
),
packages as (
  select host, snapshot_id,
    case k when 0 then 'Vendor.App' || o_custkey else 'Extra' end as name,
    case k when 0 then 'Vendor.App' || o_custkey || '_fam' end as family,
    null::varchar as full_name,
    case when k = 0 then case o_orderkey % 3 when 0 then 'ms-resource:Title' when 1 then null
      else 'App ' || o_custkey end end as display_name,
    case k when 2 then o_orderpriority end as publisher_display_name,
    case k when 0 then 'CN=Maker ' || o_custkey
      || case when o_orderkey % 2 = 0 then ', O=Firm, C=US' else '' end end as publisher,
    case k when 0 then '1.' || (o_orderkey % 5) || '.0.0' end as version,
    case when k = 0 then case o_orderkey % 4 when 0 then 'X64' when 1 then 'X86' when 2 then 'Arm64'
      else 'Other' end end as architecture,
    null::varchar as install_location,
    case k when 0 then strftime(o_orderdate, '%Y-%m-%d') || 'T10:00:00+08:00' end as installed_date,
    case k when 0 then case when o_orderkey % 5 = 0 then 'True' else 'False' end end as is_framework,
    case k when 2 then case when o_orderkey % 3 = 0 then 'Yes' else 'no' end end as is_resource,
    null::varchar as is_bundle,
    case k when 2 then case when o_orderkey % 7 = 0 then 'System' else 'Store' end end as signature_kind,
    case when k = 2 then 1 else 0 end::bigint as ord, o_custkey, o_orderkey
  from rows_of
),
package_entries as (
  select host, snapshot_id,
    case when display_name like 'App %' then display_name else name end as name, version,
    coalesce(publisher_display_name, case when o_orderkey % 2 = 0 then 'Firm'
      else 'Maker ' || o_custkey end) as publisher,
    substr(installed_date, 1, 10) as install_date, null::varchar as install_location,
    null::bigint as estimated_size_kb, 'current_user' as scope,
    case architecture when 'X64' then '64-bit' when 'X86' then '32-bit' when 'Arm64' then 'arm64'
      else 'unknown' end as architecture,
    null::varchar as uninstall_string, null::varchar as quiet_uninstall_string,
    'appx:' || coalesce(family, name) as registry_path, null::varchar as release_type,
    coalesce(is_framework = 'True', false) or coalesce(signature_kind = 'System', false)
      as system_component,
    'appx' as source, ord
  from packages where coalesce(is_resource, 'no') <> 'Yes'
)"""

UNINSTALL = r"SOFTWARE\Microsoft\Windows\CurrentVersion\Uninstall"
UNINSTALL_32 = r"SOFTWARE\WOW6432Node\Microsoft\Windows\CurrentVersion\Uninstall"

REGISTRY_ROWS = f"""
registry_entries as (
  select host, snapshot_id, trim(raw_name) as name, {clean('raw_version')} as version,
    {clean('raw_publisher')} as publisher, {date_of('raw_date')} as install_date,
    {clean('raw_location')} as install_location, {size_of('raw_size')} as estimated_size_kb,
    case when view = 3 then 'current_user' else 'machine' end as scope,
    case view when 0 then '64-bit' when 3 then 'unknown' else '32-bit' end as architecture,
    {clean('raw_uninstall')} as uninstall_string, null::varchar as quiet_uninstall_string,
    case view when 2 then 'HKEY_LOCAL_MACHINE\\{UNINSTALL_32}\\'
      when 3 then 'HKEY_CURRENT_USER\\{UNINSTALL}\\'
      else 'HKEY_LOCAL_MACHINE\\{UNINSTALL}\\' end || mark as registry_path,
    {clean('raw_release')} as release_type, {flag_of('raw_system')} as system_component,
    'registry' as source, view::bigint * 281474976710656 + ord as ord
  from captured where trim(raw_name) <> ''
)"""

TYPED_NAME = "case when l_partkey % 5 = 0 then trim(raw_name || '\ufffd') else trim(raw_name) end"
TYPED_ROWS = (
    REGISTRY_ROWS.replace("registry_entries as", "typed_entries as")
    .replace("trim(raw_name) as name", f"{TYPED_NAME} as name")
    .replace("where trim(raw_name) <> ''", f"where {TYPED_NAME} <> ''")
    .replace(
        f"{clean('raw_version')} as version",
        "case when l_orderkey % 2 = 0 then l_linenumber::varchar else raw_version end as version",
    )
    .replace(
        f"{size_of('raw_size')} as estimated_size_kb",
        f"case when l_partkey % 11 = 3 and l_orderkey % 2 = 0 then 12"
        f" when l_partkey % 11 > 4 then trunc(l_extendedprice * 10)::bigint"
        f" else {size_of('raw_size')} end as estimated_size_kb",
    )
    .replace(f"{flag_of('raw_system')} as system", "l_suppkey % 17 in (0, 1, 4) as system")
    .replace(f"{clean('raw_location')} as", "null::varchar as")
    .replace(f"{clean('raw_uninstall')} as", "null::varchar as")
    .replace(f"{clean('raw_release')} as", "null::varchar as")
)

CATALOG_ROWS = """
files as (
  select p.*, 'catalog-' || p_partkey as path from part p
),
catalog_rows as (
  select path, p_name as name, p_brand || '.' || p_partkey as package_id, p_size::varchar as version,
    case when p_partkey % 3 = 0 then '' else 'winget' end as source, k::bigint as ord
  from files, (values (0), (1)) v(k)
  where p_partkey % 7 in (0, 4, 5, 6) and (k = 0 or p_partkey % 7 = 0)
)"""

MARKED = "select host, snapshot_id, mark"
CHECK_INTRO = (
    "# Unmatched software (manual reinstall checklist)",
    "",
    None,
    "",
    "These applications appeared in the Uninstall inventory but could not",
    "be mapped to a catalog `PackageIdentifier`. Install them manually",
    "(vendor installer, Store, portable copy, etc.).",
    "",
)
CHECK_SUMMARY = "'Matched to winget: **' || matched || '** - Unmatched: **' || unmatched || '**'"
CHECK_HEAD = ", ".join(CHECK_SUMMARY if t is None else f"'{t}'" for t in CHECK_INTRO)
COUNTS = """
counts as (
  select host, snapshot_id, count(package_id)::bigint as matched,
    count(*) filter (package_id is null)::bigint as unmatched
  from matches group by all
)"""
SOURCE_DETAILS = (
    '{"SourceDetails":{"Name":"winget","Identifier":"Microsoft.Winget.Source_8wekyb3d8bbwe",'
    '"Argument":"https://cdn.winget.microsoft.com/cache","Type":"Microsoft.PreIndexed.Package"},'
    '"Packages":['
)
IMPORT_HEAD = (
    '{"$schema":"https://aka.ms/winget-packages.schema.2.0.json",'
    '"CreationDate":"2026-09-24T05:00:00.000-00:00","Sources":['
)

ORACLE: dict[str, str] = {
    "norm_string": f"with {CAPTURED} {MARKED}, {clean('raw_name')} as name,"
    f" {clean('raw_release')} as release from captured",
    "norm_install_date": f"with {CAPTURED} {MARKED}, {date_of('raw_date')} as install_date from captured",
    "norm_size": f"with {CAPTURED} {MARKED}, {size_of('raw_size')} as size_kb from captured",
    "norm_system_flag": f"with {CAPTURED} {MARKED}, {flag_of('raw_system')} as flag from captured",
    "subject_publisher": """select o_orderkey, case o_custkey % 3 when 0 then 'Firm ' || o_custkey
      when 1 then 'Dev ' || o_custkey else 'Lab ' || o_custkey end as publisher from orders""",
    "arch_label": """select o_orderkey, (['64-bit', '32-bit', '32-bit', 'arm64', 'arm', 'neutral',
      'unknown'])[(o_orderkey % 7 + 1)::int] as architecture from orders""",
    "update_flag": f"with {CAPTURED},{FLEET} select host, snapshot_id, registry_path,"
    f" {UPDATE} as is_update from fleet",
    "completeness": f"with {CAPTURED},{FLEET} select host, snapshot_id, registry_path,"
    f" ({SCORE})::bigint as score from fleet",
    "size_human": f"""select l_orderkey, l_linenumber, l_partkey, {HUMAN} as size from (
      select *, case when l_linenumber % 3 = 0 then l_orderkey when l_linenumber % 3 = 1
        then l_partkey * 640 else l_partkey * l_orderkey * 16 end as kb from lineitem)""",
    "match_key": f"with {CAPTURED},{FLEET} select host, snapshot_id, registry_path,"
    f" {key_of('name')} as match_key from fleet",
    "scan_times": """select o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') as started_at,
      strftime(ends, '%Y-%m-%dT%H:%M:%S.%g') || '-00:00' as stamp,
      greatest(0, (o_orderkey % 90) * 1000 - 10500)::bigint as duration_ms
      from (select *, o_orderdate + to_milliseconds((o_orderkey % 90) * 1000 - 10500) as ends
        from orders)""",
    "snapshot_read": f"""select 'snapshot-' || o_orderkey as path,
      case when {SNAPSHOT_BAD} is null then 'ok' else 'bad' end as status, {SNAPSHOT_BAD} as reason,
      case when o_orderkey % 11 not in (0, 1, 5, 6) then 'host-' || (o_custkey % 20) end as hostname,
      case when {SNAPSHOT_BAD} is null then o_orderkey % 4 + 1 else -1 end::bigint as items
      from orders""",
    "entry_rehydrate": f"""select case when o_orderkey % 11 = 0 then 'snapshot-' || o_orderkey
        else 'host-' || (o_custkey % 20) end as host,
      'snapshot-' || o_orderkey as snapshot_id, 'App ' || n || ' ' || o_custkey as name,
      n::varchar as version, o_orderpriority as publisher, null::varchar as install_date,
      null::varchar as install_location, (n * 1000)::bigint as estimated_size_kb,
      'unknown' as scope, 'unknown' as architecture, null::varchar as uninstall_string,
      null::varchar as quiet_uninstall_string, '' as registry_path, null::varchar as release_type,
      n <> 2 as system_component, case n when 2 then 'appx' else 'registry' end as source,
      (n - 1)::bigint as ord
      from orders, (values (1), (2), (3)) v(n)
      where {SNAPSHOT_BAD} is null and n <= o_orderkey % 4""",
    "source_select": prepared("chosen", ", chosen as (select * from fleet where source = 'appx')")
    + f" select {ROW} from prepared",
    "registry_map": f"with {CAPTURED},{REGISTRY_ROWS} select {ROW} from registry_entries",
    "registry_map_typed": f"with {CAPTURED},{TYPED_ROWS} select {ROW} from typed_entries",
    "collect_status": f"""with {CAPTURED}
      select distinct host, snapshot_id, 'registry' as source, 'ok' as status, null::varchar as reason
      from captured
      union all
      select 'host-' || lpad((o_custkey % 20)::varchar, 2, '0'), 'scan-' || o_orderkey, 'appx',
        case when o_orderkey % 13 in (2, 3) then 'bad' else 'ok' end,
        case o_orderkey % 13 when 2 then 'invalid JSON' when 3 then 'not a list of packages' end
      from orders""",
    "appx_parse": f"with {PACKAGE_ROWS} select * exclude (o_custkey, o_orderkey) from packages",
    "appx_map": f"with {PACKAGE_ROWS} select {ROW} from package_entries",
    "collect_union": f"""with {CAPTURED},{REGISTRY_ROWS},{PACKAGE_ROWS}
      select {ROW} from registry_entries union all select {ROW}
      from (select * replace (ord + 1152921504606846976 as ord) from package_entries)""",
    "source_labels": rf"""with {CAPTURED},
      seen as (select distinct host, snapshot_id, view from captured)
      select host, snapshot_id, (row_number() over (partition by host, snapshot_id order by view) - 1)::int
        as n, (['HKEY_LOCAL_MACHINE\{UNINSTALL} [64-bit view]',
          'HKEY_LOCAL_MACHINE\{UNINSTALL} [32-bit view]', 'HKEY_LOCAL_MACHINE\{UNINSTALL_32}',
          'HKEY_CURRENT_USER\{UNINSTALL}'])[view + 1] as label from seen
      union all
      select 'host-' || lpad((o_custkey % 20)::varchar, 2, '0'), 'scan-' || o_orderkey, 0,
        'Appx/MSIX packages [Windows.Management.Deployment.PackageManager, current user]'
      from orders where o_orderkey % 13 not in (2, 3)""",
    "catalog_read": f"with {CATALOG_ROWS} select * from catalog_rows",
    "catalog_status": """select 'catalog-' || p_partkey as path,
      case when p_partkey % 7 in (1, 2, 3) then 'bad' else 'ok' end as status,
      case p_partkey % 7 when 1 then 'a row is not an object' when 2 then 'a row has no name or id'
        when 3 then 'not a list of packages' end as reason from part""",
    "listing_parse": r"""with c as (
        select *, (c_custkey % 5 = 0)::int as shift from customer where c_custkey % 9 <> 0)
      select 'listing-' || c_custkey as path, c_name as name, 'Firm.' || c_custkey as package_id,
        '1.0' as version, 'winget' as source, 0::bigint as ord from c
      union all select 'listing-' || c_custkey, 'Store ' || c_custkey, 'Store.App', null, 'msstore',
        2 from c
      union all select 'listing-' || c_custkey, 'Local', 'ARP\' || c_custkey, '2.5', '', 3 from c""",
    "catalog_files": r"""with file as (select distinct p_partkey // 500 as file from part),
      package as (
        select file, -1 as p_partkey, 'first' as name, 'Fix.ed' as package_id, null as version from file
        union all
        select p_partkey // 500, p_partkey, p_name, 'Part.' || p_partkey, p_size::varchar from part)
      select file, name, package_id, version, '' as source,
        row_number() over (partition by file order by p_partkey) - 1 as ord
      from package where file % 7 <> 6 and file % 11 <> 10""",
    "catalog_files_status": r"""select distinct p_partkey // 500 as file,
        case when p_partkey // 500 % 7 = 6 or p_partkey // 500 % 11 = 10 then 'bad' else 'ok' end as status
      from part""",
    "listing_files": r"""with c as (select c_custkey, c_name, c_custkey // 1000 as listing from customer),
      line as (
        select listing, c_custkey, 0 as pos, c_name as name, 'Firm.' || c_custkey as package_id,
          '1.0' as version, 'winget' as source from c
        union all select listing, c_custkey, 1, null, null, null, null from c where c_custkey % 4 = 0
        union all select listing, c_custkey, 2, 'Store ' || c_custkey, 'Store.App', null, 'msstore' from c),
      placed as (
        select *, row_number() over (partition by listing order by c_custkey, pos) - 1 as ord from line)
      select listing, name, package_id, version, source, ord from placed
      where name is not null and listing % 6 <> 5""",
    "listing_files_status": r"""select listing, case when listing % 6 = 5 then 'bad' else 'ok' end as status,
        case when listing % 6 = 5 then 'no header with Name, Id and Version' end as reason
      from (select distinct c_custkey // 1000 as listing from customer)""",
    "catalog_importable": f"with {CATALOG} select name, package_id, version, source, ord from importable",
    "dedup_entries": f"{base()} select {ROW} from deduped",
    "cross_source_merge": f"{base()} select {ROW} from merged",
    "filter_reasons": f"with {CAPTURED},{FLEET} select host, snapshot_id, registry_path,"
    f" {reason_of(search='ring')} as reason from fleet",
    "filter_entries": f"with {CAPTURED},{FLEET} select {ROW} from fleet"
    f" where {reason_of(updates=True)} is null",
    "search": f"{prepared(search='ring')} select {ROW} from prepared",
    "search_texts": """select doc_id from documents where contains(lower(text), 'tion')
      or contains(lower(source), 'tion') or contains(lower(lang), 'tion')""",
    "prepare": f"{prepared()} select {ROW} from prepared",
    "prepare_all": f"{prepared(system=True, updates=True)} select {ROW} from prepared",
    "history_merge": f"{prepared()} select {ROW} from prepared",
    "prepare_stats": f"{prepared()},{STATS} select host, snapshot_id, {COUNTERS} from stats",
    "identity_index": f"with {CAPTURED},{HISTORY},{indexed('history', 'host, snapshot_id')}"
    f" select host, snapshot_id, {IDENTITY}, {FIELDS} from indexed",
    "consecutive_diff": f"{PAIRED} select {PAIR}, {IDENTITY}, status, name, old_version, new_version"
    " from diff",
    "snapshot_diff": f"""with {CAPTURED},{FLEET},
      sides as (select *, scan_ts >= timestamp '1998-07-01' as is_new from fleet),
      {indexed('sides', 'host, is_new')}
      select coalesce(n.host, o.host) as host, {JOINED_IDENTITY}, {STATUS},
        coalesce(n.name, o.name) as name, o.version as old_version, n.version as new_version
      from (select * from indexed where is_new) n full join (select * from indexed where not is_new) o
        on n.host = o.host and {SAME_IDENTITY}""",
    "diff_added": f"{PAIRED} select {PAIR}, {IDENTITY}, name, new_version as version from diff"
    " where status = 'added'",
    "diff_removed": f"{PAIRED} select {PAIR}, {IDENTITY}, name, old_version as version from diff"
    " where status = 'removed'",
    "field_changes": f"{PAIRED} "
    + " union all ".join(
        f"select {PAIR}, {IDENTITY}, name, '{f}' as field, o.{f}::varchar as old, n.{f}::varchar as new"
        f" from diff where status = 'changed' and o.{f} is distinct from n.{f}"
        for f in COMPARED
    ),
    "diff_summary": f"{PAIRED},{SUMMARY} select * from summary",
    "latest_inventory": f"""with {CAPTURED},{FLEET} select {ROW} from fleet join
      (select host as h, max(scan_ts) as newest from fleet group by all) on host = h and scan_ts = newest""",
    "catalog_match": f"{MATCHED} select host, snapshot_id, position, name, match_kind, package_id,"
    " package_name, package_version from matches",
    "catalog_match_shared": f"{matched(HOST_CATALOGS, 'host')} select host, snapshot_id, position, name,"
    " match_kind, package_id, package_name, package_version from matches",
    "match_summary": f"{MATCHED},{COUNTS} select host, snapshot_id, matched, unmatched from counts",
    "scan_metadata": f"{prepared()},{STATS},{SCAN} select *, 0::bigint as collector_sources from scans",
    "report_document": report_sql(
        f"""'{{"schema_version":"1.2","scan":' || {SCAN_JSON} || ',"software":['""", "]}"
    ),
    "report_array": report_sql("'['", "]"),
    "diff_document": f"""{PAIRED},{SUMMARY},
      bodies as (
        select {PAIR}, case status when 'added' then 1 when 'removed' then 3 else 5 end as section,
          case when row_number() over (partition by {PAIR}, status order by lower(name), {PATH},
            {IDENTITY}) = 1 then '' else ',' end ||
          case status when 'added' then {json_row('n')} when 'removed' then {json_row('o')}
            else '{{"name":' || to_json(name)::varchar || ',"old_version":'
              || coalesce(to_json(old_version)::varchar, 'null') || ',"new_version":'
              || coalesce(to_json(new_version)::varchar, 'null') || ',"changes":['
              || concat_ws(',', {', '.join(change_json(f) for f in COMPARED)}) || '],"old":'
              || {json_row('o')} || ',"new":' || {json_row('n')} || '}}' end as piece
        from diff where status <> 'unchanged'
      )
      select {PAIR}, 0 as section, '{{"summary":' || to_json({{'added': added, 'removed': removed,
        'changed': changed, 'unchanged': unchanged}})::varchar || ',"added":[' as piece from summary
      union all select * from bodies
      union all select {PAIR}, 2, '],"removed":[' from summary
      union all select {PAIR}, 4, '],"changed":[' from summary
      union all select {PAIR}, 6, ']}}' from summary""",
    "diff_lines": f"""{PAIRED},{SUMMARY}
      select {PAIR}, -1 as section, unnest(['Inventory Diff Summary', '======================',
        'Added:      ' || added, 'Removed:    ' || removed, 'Changed:    ' || changed,
        'Unchanged:  ' || unchanged]) as piece from summary
      union all select {PAIR}, 0, unnest(['', 'Added', '-----']) from summary where added > 0
      union all select {PAIR}, 2, unnest(['', 'Removed', '-------']) from summary where removed > 0
      union all select {PAIR}, 4, unnest(['', 'Changed', '-------']) from summary where changed > 0
      union all select {PAIR}, 6, unnest(['', '(no differences)']) from summary
        where added + removed + changed = 0
      union all select {PAIR}, 1, '  + ' || name || ' (' || coalesce(n.version, '?') || ') — '
        || coalesce(n.publisher, '?') from diff where status = 'added'
      union all select {PAIR}, 3, '  - ' || name || ' (' || coalesce(o.version, '?') || ') — '
        || coalesce(o.publisher, '?') from diff where status = 'removed'
      union all select {PAIR}, 5, piece from (select {PAIR}, unnest(['  ~ ' || name || ': '
        || coalesce(old_version, '?') || ' → ' || coalesce(new_version, '?'), {CHANGE_LINES}]) as piece
        from diff where status = 'changed') where piece is not null""",
    "import_document": f"""{MATCHED},{COUNTS},
      bodies as (
        select host, snapshot_id, case when row_number() over (partition by host, snapshot_id
          order by position) = 1 then '' else ',' end || '{{"PackageIdentifier":'
          || to_json(package_id)::varchar || ',"Version":'
          || to_json(coalesce(package_version, version))::varchar || '}}' as piece
        from matches where package_id is not null
      )
      select host, snapshot_id, 0 as section, '{IMPORT_HEAD}'
        || case when matched > 0 then '{SOURCE_DETAILS}' else '' end as piece from counts
      union all select host, snapshot_id, 1, piece from bodies
      union all select host, snapshot_id, 2, case when matched > 0 then ']}}' else '' end || ']}}'
        from counts""",
    "unmatched_checklist": f"""{MATCHED},{COUNTS}
      select host, snapshot_id, 0 as section, unnest([{CHECK_HEAD}]) as piece from counts
      union all select host, snapshot_id, 0,
        unnest(['| Reinstalled? | Name | Version | Publisher | Install location |',
          '| --- | --- | --- | --- | --- |']) from counts where unmatched > 0
      union all select host, snapshot_id, 0,
        '_All inventory rows matched an importable winget package._' from counts where unmatched = 0
      union all select host, snapshot_id, 1, '| [ ] | ' || name || ' | ' || coalesce(version, '')
        || ' | ' || coalesce(publisher, '') || ' | ' || coalesce(install_location, '') || ' |'
        from matches where package_id is null""",
    "display_rows": f"""{prepared()},
      shown as (
        select host, snapshot_id, name, coalesce(version, '') as version,
          coalesce(publisher, '') as publisher, scope, architecture,
          coalesce(install_date, '') as install_date, {HUMAN} as size, source, registry_path
        from (select *, estimated_size_kb as kb from prepared)
      )
      select *, rtrim({" || '  ' || ".join(cell_sql(c, w) for c, w in CELLS)}) as line from shown""",
    "csv_rows": f"""{prepared()} select name, version, publisher, install_date, install_location,
      estimated_size_kb::varchar as estimated_size_kb, scope, architecture, uninstall_string,
      quiet_uninstall_string, registry_path, release_type,
      case when system_component then 'True' else 'False' end as system_component, source
      from prepared""",
}

ORACLE["csv_rows_by_snapshot"] = ORACLE["csv_rows"].replace(
    " select name, version,", " select host, snapshot_id, name, version,"
)
ORACLE["report_positions"] = f"""{prepared()} select host, snapshot_id,
  row_number() over (partition by host, snapshot_id order by lower(name), registry_path, ord) as position,
  name, registry_path, ord from prepared"""
ORACLE["snapshot_status"] = f"""
with files as (
  select o_orderkey, 'snapshot-' || o_orderkey as path, {SNAPSHOT_BAD} as reason,
    case when o_orderkey % 11 in (0, 6) then 'snapshot-' || o_orderkey
      else o_custkey % 20 || ' ' || strftime(o_orderdate, '%Y-%m-%d') end as snapshot
  from orders
), firsts as (select snapshot, min(path) as first from files where reason is null group by snapshot)
select path,
  case when reason is not null then 'bad' when path = first then 'ok' else 'repeated' end as status,
  case when reason is not null then reason
    when path <> first then 'the same snapshot is in ' || first end as reason
from files left join firsts on firsts.snapshot = files.snapshot and reason is null"""


def _numbered(sql: str, key: str, order: str) -> str:
    return f"""select {key}, piece, row_number() over (partition by {key} order by {order}) as position
      from ({sql})"""


def _with_positions(sql: str) -> str:
    """The pieces of diff documents in their order: section, then place in its list."""
    nth = f"row_number() over (partition by {PAIR}, status order by lower(name), {PATH}, {IDENTITY})"
    head, _, body = sql.partition(f"      select {PAIR}, 0 as section")
    head = head.replace(" as piece\n        from diff", f" as piece, {nth} as nth\n        from diff")
    body = f"select {PAIR}, 0 as section{body}".replace(" from summary", ", 0 as nth from summary")
    return f"""{head} select {PAIR}, piece,
      row_number() over (partition by {PAIR} order by section, nth) as position from ({body})"""


ORACLE["diff_document_positions"] = _with_positions(ORACLE["diff_document"])


def _split(sql: str, mark: str) -> tuple[str, str]:
    """The tables of a query and its last select."""
    at = sql.rindex(mark)
    return sql[:at], sql[at:]


_REPORT_ORDER = "row_number() over (partition by host, snapshot_id order by lower(name), registry_path, ord)"
ORACLE["report_array_positions"] = f"""{prepared()},{STATS},{SCAN},
bodies as (
  select host, snapshot_id, {_REPORT_ORDER} as nth, {json_row()} as piece from prepared
)
select host, snapshot_id, '[' as piece, 1 as position from scans
union all select host, snapshot_id, case nth when 1 then '' else ',' end || piece, nth + 1 from bodies
union all select host, snapshot_id, ']', result_count + 2 from scans"""

_NTH = f"row_number() over (partition by {PAIR}, status order by lower(name), {PATH}, {IDENTITY})"
ORACLE["diff_lines_positions"] = f"""{PAIRED},{SUMMARY},
texts as (
  select {PAIR}, case status when 'added' then 1 when 'removed' then 3 else 5 end as section, {_NTH} as nth,
    case status
      when 'added' then ['  + ' || name || ' (' || coalesce(n.version, '?') || ') — ' || coalesce(n.publisher, '?')]
      when 'removed' then ['  - ' || name || ' (' || coalesce(o.version, '?') || ') — ' || coalesce(o.publisher, '?')]
      else list_filter(['  ~ ' || name || ': ' || coalesce(old_version, '?') || ' → '
        || coalesce(new_version, '?'), {CHANGE_LINES}], lambda t: t is not null) end as lines
  from diff where status <> 'unchanged'
  union all select {PAIR}, -1, 0, ['Inventory Diff Summary', '======================', 'Added:      ' || added,
    'Removed:    ' || removed, 'Changed:    ' || changed, 'Unchanged:  ' || unchanged] from summary
  union all select {PAIR}, 0, 0, ['', 'Added', '-----'] from summary where added > 0
  union all select {PAIR}, 2, 0, ['', 'Removed', '-------'] from summary where removed > 0
  union all select {PAIR}, 4, 0, ['', 'Changed', '-------'] from summary where changed > 0
  union all select {PAIR}, 6, 0, ['', '(no differences)'] from summary where added + removed + changed = 0
), single as (select {PAIR}, section, nth, unnest(lines) as piece, generate_subscripts(lines, 1) as line from texts)
{_numbered('select * from single', PAIR, 'section, nth, line')}"""

_HEAD, _LAST = _split(ORACLE["import_document"], "select host, snapshot_id, 0 as section")
_HEAD = _HEAD.replace(" as piece\n        from matches", " as piece, position as nth\n        from matches")
_LAST = _LAST.replace(" from counts", ", 0 as nth from counts").replace("1, piece from", "1, piece, nth from")
ORACLE["import_document_positions"] = f"{_HEAD} {_numbered(_LAST, 'host, snapshot_id', 'section, nth')}"

ORACLE["unmatched_checklist_positions"] = f"""{MATCHED},{COUNTS},
texts as (
  select host, snapshot_id, 0 as section, '' as lower_name, 0 as nth, list_concat([{CHECK_HEAD}],
    case when unmatched > 0 then ['| Reinstalled? | Name | Version | Publisher | Install location |',
      '| --- | --- | --- | --- | --- |']
    else ['_All inventory rows matched an importable winget package._'] end) as lines from counts
  union all select host, snapshot_id, 1, lower(name), position, ['| [ ] | ' || name || ' | ' || coalesce(version, '')
    || ' | ' || coalesce(publisher, '') || ' | ' || coalesce(install_location, '') || ' |']
  from matches where package_id is null
), single as (
  select host, snapshot_id, section, lower_name, nth, unnest(lines) as piece, generate_subscripts(lines, 1) as line
  from texts
)
{_numbered('select * from single', 'host, snapshot_id', 'section, lower_name, nth, line')}"""


# Indented documents: a line per field, as the standard library indents them.


def indented_row(pad: int, alias: str = "") -> str:
    blank = " " * (pad + 2)
    prefix = f"{alias}." if alias else ""
    fields = [
        f"'{blank}\"{f.strip()}\": ' || coalesce(to_json({prefix}{f.strip()})::varchar, 'null')"
        for f in FIELDS.split(",")
    ]
    lines = " || ',\n' || ".join(fields)
    return f"'{{\n' || {lines} || '\n{' ' * pad}}}'"


def _scan_lines() -> str:
    names = ["started_at", "completed_at", "duration_ms", "hostname", "platform"]
    lines = [f"'    \"{c}\": ' || to_json({c})::varchar" for c in names]
    lines += ["'    \"collector_sources\": []'"]
    lines += [f"'    \"{c.strip()}\": ' || {c.strip()}" for c in COUNTERS.split(",")]
    joined = " || ',\n' || ".join(lines)
    return f"'{{\n' || {joined} || '\n  }}'"


ORACLE["report_document_pretty"] = f"""{prepared()},{STATS},{SCAN},
bodies as (
  select host, snapshot_id, case when {_REPORT_ORDER} = 1 then '\n' else ',\n' end
    || '    ' || {indented_row(4)} as piece from prepared
)
select host, snapshot_id, 0 as section, '{{\n  "schema_version": "1.2",\n  "scan": ' || {_scan_lines()}
  || ',\n  "software": [' as piece from scans
union all select host, snapshot_id, 1, piece from bodies
union all select host, snapshot_id, 2, case when result_count > 0 then '\n  ]\n}}' else ']\n}}' end from scans"""


def _indented_change(field: str) -> str:
    return (
        f"case when o.{field} is distinct from n.{field} then '        {{\n          \"field\": \"{field}\",\n"
        f"          \"old\": ' || coalesce(to_json(o.{field})::varchar, 'null') || ',\n          \"new\": '"
        f" || coalesce(to_json(n.{field})::varchar, 'null') || '\n        }}' end"
    )


ORACLE["diff_document_pretty"] = f"""{PAIRED},{SUMMARY},
bodies as (
  select {PAIR}, case status when 'added' then 1 when 'removed' then 3 else 5 end as section,
    case when {_NTH} = 1 then '\n' else ',\n' end || '    ' ||
    case status when 'added' then {indented_row(4, 'n')} when 'removed' then {indented_row(4, 'o')}
      else '{{\n      "name": ' || to_json(name)::varchar
        || ',\n      "old_version": ' || coalesce(to_json(old_version)::varchar, 'null')
        || ',\n      "new_version": ' || coalesce(to_json(new_version)::varchar, 'null')
        || ',\n      "changes": [\n' || concat_ws(',\n', {', '.join(_indented_change(f) for f in COMPARED)})
        || '\n      ],\n      "old": ' || {indented_row(6, 'o')} || ',\n      "new": '
        || {indented_row(6, 'n')} || '\n    }}' end as piece
  from diff where status <> 'unchanged'
)
select {PAIR}, 0 as section, '{{\n  "summary": {{\n    "added": ' || added || ',\n    "removed": ' || removed
  || ',\n    "changed": ' || changed || ',\n    "unchanged": ' || unchanged || '\n  }},\n  "added": [' as piece
from summary
union all select * from bodies
union all select {PAIR}, 2, case when added > 0 then '\n  ' else '' end || '],\n  "removed": [' from summary
union all select {PAIR}, 4, case when removed > 0 then '\n  ' else '' end || '],\n  "changed": [' from summary
union all select {PAIR}, 6, case when changed > 0 then '\n  ' else '' end || ']\n}}' from summary"""

ORACLE["import_document_pretty"] = f"""{MATCHED},{COUNTS},
bodies as (
  select host, snapshot_id, case when row_number() over (partition by host, snapshot_id order by position) = 1
      then '\n' else ',\n' end || '        {{\n          "PackageIdentifier": ' || to_json(package_id)::varchar
    || ',\n          "Version": ' || to_json(coalesce(package_version, version))::varchar || '\n        }}' as piece
  from matches where package_id is not null
)
select host, snapshot_id, 0 as section, '{{\n  "$schema": "https://aka.ms/winget-packages.schema.2.0.json",\n'
  || '  "CreationDate": "2026-09-24T05:00:00.000-00:00",\n  "Sources": [' || case when matched > 0 then
  '\n    {{\n      "SourceDetails": {{\n        "Name": "winget",\n'
  || '        "Identifier": "Microsoft.Winget.Source_8wekyb3d8bbwe",\n'
  || '        "Argument": "https://cdn.winget.microsoft.com/cache",\n'
  || '        "Type": "Microsoft.PreIndexed.Package"\n      }},\n      "Packages": [' else '' end as piece from counts
union all select host, snapshot_id, 1, piece from bodies
union all select host, snapshot_id, 2,
  case when matched > 0 then '\n      ]\n    }}\n  ]' else ']' end || '\n}}' from counts"""
