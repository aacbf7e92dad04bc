"""Documents of many snapshots as tables of text pieces.

A document is never built as one value.  Its pieces are rows with a section and an
order, and joined in that order they are the document.  So the report of a snapshot
of any size is sorted and written by many tasks, and nothing is gathered in one.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from appcensus.functions import values as V
from appcensus.functions.text import cell, json_object, json_value, markdown_cell, quoted
from appcensus.operators.diff import ADDED, CHANGED, COMPARED_FIELDS, REMOVED, UNCHANGED, diff_summary
from appcensus.operators.durable import durable
from appcensus.operators.matching import match_summary
from appcensus.operators.running import numbered
from appcensus.plans.prepare import counters, judged, shown_rows, written_judged
from appcensus.schema import ENTRY_COLUMNS, GROUP, ORD, REPORT_VERSION, SCAN_SCHEMA

ORDER = ("section", "order_1", "order_2", "order_3", "order_4")

# The headings of the import document.
IMPORT_SCHEMA = "https://aka.ms/winget-packages.schema.2.0.json"
IMPORT_SOURCE = (
    ("Name", "winget"),
    ("Identifier", "Microsoft.Winget.Source_8wekyb3d8bbwe"),
    ("Argument", "https://cdn.winget.microsoft.com/cache"),
    ("Type", "Microsoft.PreIndexed.Package"),
)

# The columns of the text report and their widths.
TABLE_COLUMNS = (
    ("Name", "name", 36),
    ("Version", "version", 14),
    ("Publisher", "publisher", 24),
    ("Scope", "scope", 12),
    ("Architecture", "architecture", 12),
    ("Install Date", "install_date", 12),
    ("Size", "size", 10),
    ("Source", "source", 8),
)


def _pieces(
    rows: DataFrame, group: list[str], section: Column | int, body: Column, order: list = ()
) -> DataFrame:
    """Text pieces of one section.  ``order`` is two texts and two numbers at most."""
    kinds = ("string", "string", "bigint", "bigint")
    values = [*order, *[F.lit(None)] * (4 - len(order))]
    return rows.select(
        *group,
        (F.lit(section) if isinstance(section, int) else section).cast("int").alias("section"),
        *[v.cast(kind).alias(name) for v, kind, name in zip(values, kinds, ORDER[1:])],
        body.alias("piece"),
    )


def _list_pieces(items: DataFrame, group: list[str], before: str, between: str) -> DataFrame:
    """Put a separator before every item of a list; ``before`` leads the first one."""
    place = F.struct(*ORDER[1:])
    first = items.groupBy(*group, "section").agg(F.min(place).alias("_first"))
    # The place is part of the key, so that the rows of a large document are spread.
    first = first.select(*[F.col(c).alias(f"_{c}") for c in (*group, "section")], "_first")
    same = place == F.col("_first")
    for name in (*group, "section"):
        same = same & F.col(name).eqNullSafe(F.col(f"_{name}"))
    lead = F.when(F.col("_first").isNotNull(), before).otherwise(between)
    return items.join(first, same, "left").select(
        *group, *ORDER, F.concat(lead, F.col("piece")).alias("piece")
    )


def _union(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def in_order(pieces: DataFrame, group: list[str]) -> DataFrame:
    """Pieces sorted into documents, by range and thus by many tasks."""
    return pieces.orderBy(*group, *ORDER)


def with_position(pieces: DataFrame, group: list[str]) -> DataFrame:
    """Number the pieces of every document from 1, in their order."""
    return numbered(pieces, group, ORDER, "position")


def _object(struct: Column, fields, pretty_indent: int | None = None) -> Column:
    if pretty_indent is None:
        return F.to_json(
            F.struct(*[struct[f].alias(f) for f in fields]), {"ignoreNullFields": "false"}
        )
    pad = " " * pretty_indent
    lines = [F.concat(F.lit(f'{pad}  "{f}": '), json_value(struct[f])) for f in fields]
    return F.concat(F.lit("{\n"), F.concat_ws(",\n", *lines), F.lit(f"\n{pad}}}"))


# Reports


def scan_metadata(
    entries: DataFrame, snapshots: DataFrame, labels: DataFrame | None = None, **options
) -> DataFrame:
    """The scan block of every snapshot, empty ones included.

    ``snapshots`` has ``host, snapshot_id, started_at, completed_at`` (timestamps) and
    ``platform``; ``labels`` has ``collector_sources`` per snapshot.
    """
    return scan_blocks(judged(entries, **options), snapshots, labels)


def scan_blocks(
    rows: DataFrame, snapshots: DataFrame, labels: DataFrame | None = None
) -> DataFrame:
    """``scan_metadata`` of judged rows."""
    rows = snapshots.join(counters(rows, snapshots), list(GROUP))
    if labels is not None:
        rows = rows.join(labels, list(GROUP), "left")
    else:
        rows = rows.withColumn("collector_sources", F.lit(None).cast("array<string>"))
    computed = {
        "started_at": V.utc_text(F.col("started_at")),
        "completed_at": V.utc_text(F.col("completed_at")),
        "duration_ms": V.elapsed_ms(F.col("started_at"), F.col("completed_at")),
        "hostname": F.col("host"),
        "collector_sources": F.coalesce("collector_sources", F.array().cast("array<string>")),
    }
    return rows.select(
        *GROUP,
        *[computed.get(name, F.col(name)).alias(name) for name in SCAN_SCHEMA.fieldNames()],
    )


def _scan_json(pretty: bool) -> Column:
    fields = SCAN_SCHEMA.fieldNames()
    if not pretty:
        return json_object(
            [
                (f, F.to_json(f) if f == "collector_sources" else json_value(F.col(f)))
                for f in fields
            ]
        )
    labels = F.transform("collector_sources", json_value)
    listed = F.when(F.size("collector_sources") == 0, F.lit("[]")).otherwise(
        F.concat(F.lit("[\n      "), F.array_join(labels, ",\n      "), F.lit("\n    ]"))
    )
    lines = [
        F.concat(
            F.lit(f'    "{f}": '), listed if f == "collector_sources" else json_value(F.col(f))
        )
        for f in fields
    ]
    return F.concat(F.lit("{\n"), F.concat_ws(",\n", *lines), F.lit("\n  }"))


def report_documents(
    entries: DataFrame,
    snapshots: DataFrame | None = None,
    labels: DataFrame | None = None,
    pretty: bool = False,
    array_only: bool = False,
    **options,
) -> DataFrame:
    """``report_pieces`` of raw rows, which are read once.

    The judged rows are written down, those that are not shown without their fields; counters,
    items and, without ``snapshots``, the snapshots themselves come from this one table.
    ``snapshots`` may also be a function of it: the judged rows have ``scan_ts`` if ``entries`` do.
    """
    rows = written_judged(entries, **options)
    known = snapshots(rows) if callable(snapshots) else snapshots
    scans = scan_blocks(rows, known, labels)
    return report_pieces(shown_rows(rows), scans, pretty, array_only)


def report_pieces(
    prepared: DataFrame, scans: DataFrame, pretty: bool = False, array_only: bool = False
) -> DataFrame:
    """Report documents: a scan block and the software list, or the bare list."""
    group = list(GROUP)
    indent = (2 if array_only else 4) if pretty else None
    row = F.struct(*ENTRY_COLUMNS)
    body = F.concat(F.lit(" " * (indent or 0)), _object(row, ENTRY_COLUMNS, indent))
    order = [F.lower("name"), F.col("registry_path"), F.col(ORD)]
    between, before = (",\n", "\n") if pretty else (",", "")
    items = _list_pieces(_pieces(prepared, group, 1, body, order), group, before, between)

    if array_only:
        head, tail, pad = F.lit("["), "]", ""
    elif pretty:
        head = F.concat(
            F.lit(f'{{\n  "schema_version": "{REPORT_VERSION}",\n  "scan": '),
            _scan_json(True),
            F.lit(',\n  "software": ['),
        )
        tail, pad = "]\n}", "  "
    else:
        head = F.concat(
            F.lit(f'{{"schema_version":"{REPORT_VERSION}","scan":'),
            _scan_json(False),
            F.lit(',"software":['),
        )
        tail, pad = "]}", ""
    end = F.lit(tail)
    if pretty:
        end = F.when(F.col("result_count") > 0, f"\n{pad}{tail}").otherwise(tail)
    return _union([_pieces(scans, group, 0, head), items, _pieces(scans, group, 2, end)])


# Diffs


def _fields_json(fields: list[tuple[str, Column]], indent: int | None) -> Column:
    """A JSON object, on one line or with a line per field at ``indent``."""
    if indent is None:
        return json_object(fields)
    pad = " " * indent
    lines = [F.concat(F.lit(f'{pad}  "{name}": '), value) for name, value in fields]
    return F.concat(F.lit("{\n"), F.concat_ws(",\n", *lines), F.lit(f"\n{pad}}}"))


def _changes_json(old: Column, new: Column, indent: int | None = None) -> Column:
    inner = None if indent is None else indent + 2
    pad = "" if indent is None else " " * inner
    changed = [
        F.when(
            ~old[f].eqNullSafe(new[f]),
            F.concat(
                F.lit(pad),
                _fields_json(
                    [
                        ("field", F.lit(f'"{f}"')),
                        ("old", json_value(old[f])),
                        ("new", json_value(new[f])),
                    ],
                    inner,
                ),
            ),
        )
        for f in COMPARED_FIELDS
    ]
    if indent is None:
        return F.concat(F.lit("["), F.concat_ws(",", *changed), F.lit("]"))
    return F.concat(F.lit("[\n"), F.concat_ws(",\n", *changed), F.lit("\n" + " " * indent + "]"))


def _diff_section(status: Column) -> Column:
    return F.when(status == ADDED, 1).when(status == REMOVED, 3).otherwise(5)


def _diff_order(name: Column) -> list[Column]:
    old, new = F.col("old"), F.col("new")
    path = F.when(
        F.col("status") != CHANGED, F.coalesce(new["registry_path"], old["registry_path"])
    )
    identity = [F.col(f"identity_{n}") for n in (1, 2, 3)]
    # Code points order the texts; U+0000 keeps the parts of a joined key apart.
    tie = F.concat_ws("\x00", F.coalesce(path, F.lit("")), *identity)
    return [F.lower(name), tie]


def written_diff(diff: DataFrame) -> DataFrame:
    """``diff`` as a table, without the fields of rows that are unchanged.

    Documents read it several times: for counts, headings, items and the first of each list.
    """
    told = F.col("status") != UNCHANGED
    wide = {name: F.when(told, F.col(name)) for name in ("changes", "old", "new")}
    return durable(diff.withColumns(wide))


def diff_pieces(
    diff: DataFrame, pair: list[str], pairs: DataFrame | None = None, pretty: bool = False
) -> DataFrame:
    """Diff documents: the counts, then the added, removed and changed rows."""
    diff = written_diff(diff)
    old, new = F.col("old"), F.col("new")
    row, part = (4, 6) if pretty else (None, None)
    changed = _fields_json(
        [
            ("name", json_value(F.col("name"))),
            ("old_version", json_value(F.col("old_version"))),
            ("new_version", json_value(F.col("new_version"))),
            ("changes", _changes_json(old, new, part)),
            ("old", _object(old, ENTRY_COLUMNS, part)),
            ("new", _object(new, ENTRY_COLUMNS, part)),
        ],
        row,
    )
    body = (
        F.when(F.col("status") == ADDED, _object(new, ENTRY_COLUMNS, row))
        .when(F.col("status") == REMOVED, _object(old, ENTRY_COLUMNS, row))
        .otherwise(changed)
    )
    if pretty:
        body = F.concat(F.lit(" " * row), body)
    listed = diff.filter(F.col("status").isin(ADDED, REMOVED, CHANGED))
    items = _list_pieces(
        _pieces(listed, pair, _diff_section(F.col("status")), body, _diff_order(F.col("name"))),
        pair,
        "\n" if pretty else "",
        ",\n" if pretty else ",",
    )
    summary = diff_summary(diff, pair, pairs)
    counts = json_object(
        [(s, F.col(s).cast("string")) for s in ("added", "removed", "changed", "unchanged")]
    )
    if pretty:
        counts = _fields_json(
            [(s, F.col(s).cast("string")) for s in ("added", "removed", "changed", "unchanged")], 2
        )

        def after(kind: str) -> Column:
            return F.when(F.col(kind) > 0, "\n  ]").otherwise("]")

        head = F.concat(F.lit('{\n  "summary": '), counts, F.lit(',\n  "added": ['))
        pretty_frame = F.array(
            F.struct(F.lit(0), head),
            F.struct(F.lit(2), F.concat(after("added"), F.lit(',\n  "removed": ['))),
            F.struct(F.lit(4), F.concat(after("removed"), F.lit(',\n  "changed": ['))),
            F.struct(F.lit(6), F.concat(after("changed"), F.lit("\n}"))),
        )
        framed = summary.select(*pair, F.inline(pretty_frame).alias("at", "text"))
        return _union([_pieces(framed, pair, F.col("at"), F.col("text")), items])
    frame = F.array(
        F.struct(F.lit(0), F.concat(F.lit('{"summary":'), counts, F.lit(',"added":['))),
        F.struct(F.lit(2), F.lit('],"removed":[')),
        F.struct(F.lit(4), F.lit('],"changed":[')),
        F.struct(F.lit(6), F.lit("]}")),
    )
    framed = summary.select(*pair, F.inline(frame).alias("at", "text"))
    return _union([_pieces(framed, pair, F.col("at"), F.col("text")), items])


def diff_lines(diff: DataFrame, pair: list[str], pairs: DataFrame | None = None) -> DataFrame:
    """Diffs as text for people, one row per line."""
    diff = written_diff(diff)
    # One small row per pair; all headings come from it.
    summary = durable(diff_summary(diff, pair, pairs))
    counts = {s: F.col(s) for s in ("added", "removed", "changed", "unchanged")}

    def line(at: int, text: Column) -> Column:
        return F.struct(F.lit(at).cast("bigint").alias("at"), text.alias("text"))

    # The headings of the text.
    head = F.array(
        line(0, F.lit("Inventory Diff Summary")),
        line(1, F.lit("======================")),
        line(2, F.concat(F.lit("Added:      "), counts["added"].cast("string"))),
        line(3, F.concat(F.lit("Removed:    "), counts["removed"].cast("string"))),
        line(4, F.concat(F.lit("Changed:    "), counts["changed"].cast("string"))),
        line(5, F.concat(F.lit("Unchanged:  "), counts["unchanged"].cast("string"))),
    )
    parts = [
        _pieces(
            summary.select(*pair, F.inline(head)),
            pair,
            -1,
            F.col("text"),
            [F.lit(None), F.lit(None), F.col("at")],
        )
    ]
    titles = (("added", 0, "Added", "-----"), ("removed", 2, "Removed", "-------"),
              ("changed", 4, "Changed", "-------"))
    for status, section, title, rule in titles:
        heading = F.array(line(0, F.lit("")), line(1, F.lit(title)), line(2, F.lit(rule)))
        rows = summary.filter(counts[status] > 0).select(*pair, F.inline(heading))
        order = [F.lit(None), F.lit(None), F.col("at")]
        parts.append(_pieces(rows, pair, section, F.col("text"), order))
    quiet = (counts["added"] + counts["removed"] + counts["changed"]) == 0
    nothing = F.array(line(0, F.lit("")), line(1, F.lit("(no differences)")))
    rows = summary.filter(quiet).select(*pair, F.inline(nothing))
    parts.append(
        _pieces(rows, pair, 6, F.col("text"), [F.lit(None), F.lit(None), F.col("at")])
    )

    unknown = F.lit("?")
    side = F.coalesce("new", "old")
    mark = F.when(F.col("status") == ADDED, "  + ").otherwise("  - ")
    plain = F.concat(
        mark,
        F.col("name"),
        F.lit(" ("),
        F.coalesce(side["version"], unknown),
        F.lit(") — "),
        F.coalesce(side["publisher"], unknown),
    )
    versions = F.concat(
        F.lit("  ~ "),
        F.col("name"),
        F.lit(": "),
        F.coalesce("old_version", unknown),
        F.lit(" → "),
        F.coalesce("new_version", unknown),
    )

    def shown(change: Column, which: str) -> Column:
        value = change[which]
        bare = F.coalesce(value, F.lit("None"))
        return (
            F.when(change["field"] == "estimated_size_kb", bare)
            .when(change["field"] == "system_component", F.initcap(bare))
            .otherwise(quoted(value))
        )

    details = F.transform(
        "changes",
        lambda c: F.concat(
            F.lit("      "), c["field"], F.lit(": "), shown(c, "old"), F.lit(" → "), shown(c, "new")
        ),
    )
    texts = F.when(F.col("status") == CHANGED, F.concat(F.array(versions), details)).otherwise(
        F.array(plain)
    )
    listed = diff.filter(F.col("status").isin(ADDED, REMOVED, CHANGED)).select(
        "*", F.posexplode(texts).alias("_n", "_text")
    )
    order = [*_diff_order(F.col("name")), F.col("_n")]
    parts.append(
        _pieces(listed, pair, _diff_section(F.col("status")), F.col("_text"), order)
    )
    return _union(parts)


# Reinstalling


def import_pieces(
    matches: DataFrame,
    creation_date: Column,
    include_versions: bool = False,
    tool_version: str | None = None,
    snapshots: DataFrame | None = None,
    pretty: bool = False,
) -> DataFrame:
    """Import documents: the matched packages of each snapshot in report order."""
    group = list(GROUP)
    colon = ": " if pretty else ":"
    pad = " " * 10 if pretty else ""
    fields = [F.concat(F.lit(f'{pad}"PackageIdentifier"{colon}'), json_value(F.col("package_id")))]
    if include_versions:
        # An empty version of the package is none; the application's own stands in.
        version = F.coalesce(F.nullif("package_version", F.lit("")), F.nullif("version", F.lit("")))
        fields.append(
            F.when(
                version.isNotNull(), F.concat(F.lit(f'{pad}"Version"{colon}'), json_value(version))
            )
        )
    body = F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}"))
    if pretty:
        body = F.concat(F.lit("        {\n"), F.concat_ws(",\n", *fields), F.lit("\n        }"))
    order = [F.lit(None), F.lit(None), F.col("position")]
    found = matches.filter(F.col("package_id").isNotNull())
    before, between = ("\n", ",\n") if pretty else ("", ",")
    items = _list_pieces(_pieces(found, group, 1, body, order), group, before, between)

    counts = match_summary(matches, snapshots)
    any_found = F.col("matched") > 0
    if pretty:
        details = ",\n".join(f'        "{name}": "{value}"' for name, value in IMPORT_SOURCE)
        opened = (
            f'\n    {{\n      "SourceDetails": {{\n{details}\n      }},\n      "Packages": ['
        )
        head = F.concat(
            F.lit(f'{{\n  "$schema": "{IMPORT_SCHEMA}",\n  "CreationDate": "'),
            V.utc_text_ms(creation_date),
            F.lit('",\n  "Sources": ['),
            F.when(any_found, opened).otherwise(""),
        )
        version = F.lit("")
        if tool_version:
            version = F.concat(F.lit(',\n  "WinGetVersion": '), json_value(F.lit(tool_version)))
        closed = F.when(any_found, "\n      ]\n    }\n  ]").otherwise("]")
        tail = F.concat(closed, version, F.lit("\n}"))
        return _union([_pieces(counts, group, 0, head), items, _pieces(counts, group, 2, tail)])
    details = ",".join(f'"{name}":"{value}"' for name, value in IMPORT_SOURCE)
    head = F.concat(
        F.lit(f'{{"$schema":"{IMPORT_SCHEMA}","CreationDate":"'),
        V.utc_text_ms(creation_date),
        F.lit('","Sources":['),
        F.when(any_found, f'{{"SourceDetails":{{{details}}},"Packages":[').otherwise(""),
    )
    version = F.lit("")
    if tool_version:
        version = F.concat(F.lit(',"WinGetVersion":'), json_value(F.lit(tool_version)))
    tail = F.concat(F.when(any_found, "]}").otherwise(""), F.lit("]"), version, F.lit("}"))
    return _union([_pieces(counts, group, 0, head), items, _pieces(counts, group, 2, tail)])


def checklist_lines(matches: DataFrame, snapshots: DataFrame | None = None) -> DataFrame:
    """Markdown checklists of what no package was found for, one row per line."""
    group = list(GROUP)
    counts = match_summary(matches, snapshots)
    summary = F.concat(
        F.lit("Matched to winget: **"),
        F.col("matched").cast("string"),
        F.lit("** - Unmatched: **"),
        F.col("unmatched").cast("string"),
        F.lit("**"),
    )
    # The sentences and columns of the checklist.
    intro = F.array(
        F.lit("# Unmatched software (manual reinstall checklist)"),
        F.lit(""),
        summary,
        F.lit(""),
        F.lit("These applications appeared in the Uninstall inventory but could not"),
        F.lit("be mapped to a catalog `PackageIdentifier`. Install them manually"),
        F.lit("(vendor installer, Store, portable copy, etc.)."),
        F.lit(""),
    )
    table = F.array(
        F.lit("| Reinstalled? | Name | Version | Publisher | Install location |"),
        F.lit("| --- | --- | --- | --- | --- |"),
    )
    complete = F.array(F.lit("_All inventory rows matched an importable winget package._"))
    head = F.concat(intro, F.when(F.col("unmatched") > 0, table).otherwise(complete))
    framed = counts.select(*group, F.posexplode(head).alias("at", "text"))
    cells = [markdown_cell(F.col(c)) for c in ("name", "version", "publisher", "install_location")]
    row = F.concat(F.lit("| [ ] | "), F.concat_ws(" | ", *cells), F.lit(" |"))
    missing = matches.filter(F.col("package_id").isNull())
    return _union(
        [
            _pieces(framed, group, 0, F.col("text"), [F.lit(None), F.lit(None), F.col("at")]),
            _pieces(missing, group, 1, row, [F.lower("name"), F.lit(None), F.col("position")]),
        ]
    )


# Text report and CSV


def display_columns() -> list[Column]:
    size = V.human_size(F.col("estimated_size_kb"))
    return [
        (size if key == "size" else F.coalesce(key, F.lit(""))).alias(key)
        for _, key, _ in TABLE_COLUMNS
    ]


def display_rows(prepared: DataFrame) -> DataFrame:
    """The columns people see, and the fixed-width line made of them."""
    shown = prepared.select(
        *GROUP, *display_columns(), F.col("registry_path"), F.col(ORD)
    )
    cells = [cell(F.col(key), width) for _, key, width in TABLE_COLUMNS]
    return shown.withColumn("line", F.rtrim(F.concat_ws("  ", *cells)))


def table_lines(prepared: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Text reports, one row per line; empty snapshots say so."""
    group = list(GROUP)
    titles = "  ".join(title.ljust(width) for title, _, width in TABLE_COLUMNS).rstrip()
    rule = "  ".join("-" * width for _, _, width in TABLE_COLUMNS)
    known = snapshots.select(*group).distinct()
    head = known.select(*group, F.posexplode(F.array(F.lit(titles), F.lit(rule))).alias("at", "text"))
    empty = known.join(prepared, group, "left_anti")
    rows = display_rows(prepared)
    order = [F.lower("name"), F.col("registry_path"), F.col(ORD)]
    return _union(
        [
            _pieces(head, group, 0, F.col("text"), [F.lit(None), F.lit(None), F.col("at")]),
            _pieces(rows, group, 1, F.col("line"), order),
            _pieces(empty, group, 1, F.lit("(no matching software entries)")),
        ]
    )


def csv_rows(prepared: DataFrame, group: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """``group`` and the public columns as text: truth values ``True`` and ``False``."""
    flag = F.initcap(F.col("system_component").cast("string"))
    return prepared.select(
        *group,
        *[
            (flag if name == "system_component" else F.col(name).cast("string")).alias(name)
            for name in ENTRY_COLUMNS
        ]
    )
