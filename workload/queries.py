"""The registered queries, each over whole driver tables."""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from appcensus.functions import keys as K
from appcensus.functions import text as X
from appcensus.functions import values as V
from appcensus.operators import diff as D
from appcensus.operators import matching as M
from appcensus.operators.durable import durable, shared_folder, temporary_tables
from appcensus.operators.dedupe import deduplicate, index_by_identity
from appcensus.operators.filters import filter_entries, hidden_reason, select_source
from appcensus.operators.shadow import drop_shadowed
from appcensus.operators.running import numbered
from appcensus.plans import documents as P
from appcensus.plans import history as H
from appcensus.plans.archive import History
from appcensus.plans.prepare import in_report_order, prepare, prepare_stats, written_judged
from appcensus.schema import ENTRY_COLUMNS, GROUP, ORD
from appcensus.session import tune
from appcensus.sources import catalog as C
from appcensus.sources import catalog_files as J
from appcensus.sources import listing_files as L
from appcensus.sources import packaged, registry, snapshots
from appcensus.sources.collect import collect, collect_status, collector_sources
from workload import views

ROW = [*GROUP, *ENTRY_COLUMNS, ORD]
PAIR = H.PAIR
IDENTITY = list(K.IDENTITY_KEYS)
KEY = [*GROUP, "mark"]


def _scalars(df: DataFrame, **columns) -> DataFrame:
    return df.select(*KEY, *[value.alias(name) for name, value in columns.items()])


# Scalars


def norm_string(spark, sf):
    raw = views.captured(spark, sf)
    return _scalars(raw, name=X.clean(F.col("raw_name")), release=X.clean(F.col("raw_release")))


def norm_install_date(spark, sf):
    return _scalars(views.captured(spark, sf), install_date=V.install_date(F.col("raw_date")))


def norm_size(spark, sf):
    return _scalars(views.captured(spark, sf), size_kb=V.size_kb(F.col("raw_size")))


def norm_system_flag(spark, sf):
    return _scalars(views.captured(spark, sf), flag=V.system_flag(F.col("raw_system")))


def subject_publisher(spark, sf):
    subject = F.expr(
        "case o_custkey % 3 when 0 then concat('CN=', host, ', O=\"Firm ', o_custkey, '\", C=US')"
        " when 1 then concat('CN=Dev ', o_custkey) else concat('O= , CN=Lab ', o_custkey) end"
    )
    orders = views.table(spark, sf, "orders").withColumn("host", F.lit("h"))
    return orders.select("o_orderkey", V.subject_publisher(subject).alias("publisher"))


def arch_label(spark, sf):
    raw = F.expr(
        "element_at(array('X64', ' x86 ', 'X86OnArm64', 'Arm64', 'ARM', 'Neutral', 'ia64'),"
        " cast(o_orderkey % 7 + 1 as int))"
    )
    return views.table(spark, sf, "orders").select(
        "o_orderkey", V.architecture(raw).alias("architecture")
    )


def update_flag(spark, sf):
    flag = V.update_flag(F.col("name"), F.col("release_type"))
    return views.fleet(spark, sf).select(*GROUP, "registry_path", flag.alias("is_update"))


def completeness(spark, sf):
    return views.fleet(spark, sf).select(
        *GROUP, "registry_path", K.completeness().cast("bigint").alias("score")
    )


def size_human(spark, sf):
    line = views.table(spark, sf, "lineitem")
    kb = F.expr(
        "case when l_linenumber % 3 = 0 then l_orderkey"
        " when l_linenumber % 3 = 1 then l_partkey * 640 else l_partkey * l_orderkey * 16 end"
    )
    return line.select("l_orderkey", "l_linenumber", "l_partkey", V.human_size(kb).alias("size"))


def match_key(spark, sf):
    return views.fleet(spark, sf).select(
        *GROUP, "registry_path", K.match_key(F.col("name")).alias("match_key")
    )


def scan_times(spark, sf):
    order = views.table(spark, sf, "orders")
    end = F.col("o_orderdate") + F.expr("make_interval(0, 0, 0, 0, 0, 0, o_orderkey % 90 - 10.5)")
    return order.select(
        "o_orderkey",
        V.utc_text(F.col("o_orderdate")).alias("started_at"),
        V.utc_text_ms(end).alias("stamp"),
        V.elapsed_ms(F.col("o_orderdate"), end).alias("duration_ms"),
    )


# Sources


def snapshot_read(spark, sf):
    parsed = snapshots.parse_snapshots(views.snapshot_texts(spark, sf))
    return parsed.select(
        "path",
        "status",
        "reason",
        F.col("scan.hostname").alias("hostname"),
        F.coalesce(F.size("items"), F.lit(-1)).cast("bigint").alias("items"),
    )


def entry_rehydrate(spark, sf):
    parsed = snapshots.parse_snapshots(views.snapshot_texts(spark, sf))
    table = snapshots.snapshot_table(parsed)
    # Orders of one day on one host share a scan time, so the path tells them apart.
    rows = snapshots.snapshot_entries(table.withColumn("snapshot_id", F.col("path")))
    return rows.select(*ROW)


def source_select(spark, sf):
    return prepare(select_source(views.fleet(spark, sf), "appx")).select(*ROW)


def registry_map(spark, sf):
    keys = registry.gather_values(views.registry_values(spark, sf))
    return registry.registry_entries(keys).select(*ROW)


def registry_map_typed(spark, sf):
    """Registry values as bytes, numbers and truth values."""
    keys = registry.gather_values(views.typed_registry_values(spark, sf))
    return registry.registry_entries(keys).select(*ROW)


def captures_status(spark, sf):
    return collect_status(views.registry_values(spark, sf), views.package_captures(spark, sf))


def appx_parse(spark, sf):
    return packaged.packages_of(packaged.parse_listings(views.package_captures(spark, sf)))


def appx_map(spark, sf):
    return packaged.package_entries(appx_parse(spark, sf)).select(*ROW)


def collect_union(spark, sf):
    captures = views.package_captures(spark, sf)
    return collect(views.registry_values(spark, sf), captures).select(*ROW)


def source_labels(spark, sf):
    labels = collector_sources(
        views.registry_values(spark, sf), views.package_captures(spark, sf)
    )
    return labels.select(*GROUP, F.posexplode("collector_sources").alias("n", "label"))


def catalog_read(spark, sf):
    return C.catalog_packages(C.parse_catalogs(views.catalog_texts(spark, sf)))


def catalog_status(spark, sf):
    return C.parse_catalogs(views.catalog_texts(spark, sf)).select("path", "status", "reason")


def listing_parse(spark, sf):
    return C.listing_packages(C.parse_listing_texts(views.listing_texts(spark, sf)))


def _listing_files(spark, sf):
    folder = f"{shared_folder(spark)}/listings-{uuid.uuid4().hex}"
    views.listing_files(spark, sf, folder)
    return folder, L.read_listing_lines(spark, folder)


def _listing_number(df):
    number = F.regexp_extract("path", "listing=([0-9]+)/", 1).cast("bigint")
    return df.withColumn("listing", number).drop("path")


def listing_files(spark, sf):
    """Packages of listing files that are read by byte range."""
    return _listing_number(L.listing_file_packages(_listing_files(spark, sf)[1]))


def listing_files_status(spark, sf):
    return _listing_number(L.listing_file_status(spark, *_listing_files(spark, sf)))


def _catalog_items(spark, sf):
    folder = f"{shared_folder(spark)}/catalogs-{uuid.uuid4().hex}"
    views.catalog_files(spark, sf, folder)
    return J.read_catalog_items(spark, folder)


def _file_number(df):
    number = F.regexp_extract("path", "file=([0-9]+)/", 1).cast("bigint")
    return df.withColumn("file", number).drop("path")


def catalog_files(spark, sf):
    """Packages of JSON catalog files that are read by byte range."""
    return _file_number(J.catalog_file_packages(_catalog_items(spark, sf)))


def catalog_files_status(spark, sf):
    return _file_number(J.catalog_file_status(_catalog_items(spark, sf))).select("file", "status")


def catalog_importable(spark, sf):
    return M.importable_packages(views.catalog(spark, sf))


# Preparing


def dedup_entries(spark, sf):
    return deduplicate(views.fleet(spark, sf)).select(*ROW)


def cross_source_merge(spark, sf):
    return drop_shadowed(deduplicate(views.fleet(spark, sf))).select(*ROW)


def filter_reasons(spark, sf):
    reason = hidden_reason(search="ring").alias("reason")
    return views.fleet(spark, sf).select(*GROUP, "registry_path", reason)


def filtered(spark, sf):
    return filter_entries(views.fleet(spark, sf), include_updates=True).select(*ROW)


def search(spark, sf):
    return prepare(views.fleet(spark, sf), search=" RING ").select(*ROW)


def search_texts(spark, sf):
    """The search rule over whole documents instead of short names."""
    from appcensus.operators.filters import matches_search

    document = views.table(spark, sf, "documents")
    rows = document.select(
        "doc_id", F.col("text").alias("name"), F.col("source").alias("publisher"),
        F.col("lang").alias("version"),
    )
    return rows.filter(matches_search("Tion")).select("doc_id")


def prepared(spark, sf):
    return in_report_order(prepare(views.fleet(spark, sf)))


def prepared_all(spark, sf):
    rows = prepare(views.fleet(spark, sf), include_system_components=True, include_updates=True)
    return rows.select(*ROW)


def stats(spark, sf):
    return prepare_stats(views.fleet(spark, sf))


def history_merge(spark, sf):
    """The history after three merges; the quarters of one year come twice."""
    store = History(spark, f"{shared_folder(spark)}/history-{uuid.uuid4().hex}")
    time = F.col("scan_ts")
    with temporary_tables(spark):
        rows = durable(prepare(views.fleet(spark, sf)))
        for part in (time < "1995-01-01", (time >= "1994-01-01") & (time < "1997-01-01"), time >= "1997-01-01"):
            store.merge(rows.filter(part))
    return store.rows().select(*ROW)


# Comparing


def identity_index(spark, sf):
    return index_by_identity(views.fleet_history(spark, sf)).select(*GROUP, *IDENTITY, *ENTRY_COLUMNS)


def _history_diff(spark, sf):
    return H.consecutive_diff(views.fleet_history(spark, sf))


def consecutive_diff(spark, sf):
    return H.consecutive_statuses(views.fleet_history(spark, sf))


def snapshot_diff(spark, sf):
    """The rows of each host before a day against those from it on."""
    rows = views.fleet(spark, sf)
    old = rows.filter(F.col("scan_ts") < "1998-07-01")
    new = rows.filter(F.col("scan_ts") >= "1998-07-01")
    return D.compare_statuses(old, new, ["host"])


def diff_added(spark, sf):
    return D.added(_history_diff(spark, sf), PAIR).select(*PAIR, *IDENTITY, "name", "version")


def diff_removed(spark, sf):
    return D.removed(_history_diff(spark, sf), PAIR).select(*PAIR, *IDENTITY, "name", "version")


def field_changes(spark, sf):
    return D.exploded_changes(_history_diff(spark, sf), PAIR)


def diff_summary(spark, sf):
    return D.diff_summary(H.consecutive_statuses(views.fleet_history(spark, sf)), PAIR)


def latest_inventory(spark, sf):
    return H.latest_inventory(views.fleet(spark, sf)).select(*ROW)


# Catalog matching


def _matches(spark, sf):
    return M.match_catalog(prepare(views.fleet(spark, sf)), views.catalog(spark, sf))


def catalog_match(spark, sf):
    return _matches(spark, sf).select(
        *GROUP, "position", "name", "match_kind", "package_id", "package_name", "package_version"
    )


def catalog_match_shared(spark, sf):
    """A catalog for each host, with ids that stand under several names."""
    matches = M.match_catalog(
        prepare(views.fleet(spark, sf)), views.host_catalogs(spark, sf), by=("host",)
    )
    return matches.select(
        *GROUP, "position", "name", "match_kind", "package_id", "package_name", "package_version"
    )


def match_summary(spark, sf):
    return M.match_summary(_matches(spark, sf))


# Documents


def _snapshots(rows):
    start = F.col("scan_ts")
    return H.snapshots_of(rows).select(
        *GROUP,
        start.alias("started_at"),
        (start + F.expr("interval 3 seconds")).alias("completed_at"),
        F.lit("Windows").alias("platform"),
    )


def scan_metadata(spark, sf):
    judged = written_judged(views.fleet(spark, sf))
    rows = P.scan_blocks(judged, _snapshots(judged))
    return rows.withColumn("collector_sources", F.size("collector_sources").cast("bigint"))


def report_document(spark, sf):
    pieces = P.report_documents(views.fleet(spark, sf), _snapshots)
    return pieces.select(*GROUP, "section", "piece")


def report_array(spark, sf):
    pieces = P.report_documents(views.fleet(spark, sf), _snapshots, array_only=True)
    return pieces.select(*GROUP, "section", "piece")


def diff_document(spark, sf):
    return P.diff_pieces(_history_diff(spark, sf), PAIR).select(*PAIR, "section", "piece")


def diff_lines(spark, sf):
    return P.diff_lines(_history_diff(spark, sf), PAIR).select(*PAIR, "section", "piece")


def _stamp():
    return F.lit("2026-09-24 05:00:00").cast("timestamp")


def import_document(spark, sf):
    pieces = P.import_pieces(_matches(spark, sf), _stamp(), include_versions=True)
    return pieces.select(*GROUP, "section", "piece")


def unmatched_checklist(spark, sf):
    return P.checklist_lines(_matches(spark, sf)).select(*GROUP, "section", "piece")


def display_rows(spark, sf):
    return P.display_rows(prepare(views.fleet(spark, sf))).drop(ORD)


def csv_rows(spark, sf):
    return P.csv_rows(prepare(views.fleet(spark, sf)))


def csv_rows_by_snapshot(spark, sf):
    return P.csv_rows(prepare(views.fleet(spark, sf)), GROUP)


# Order and files


def report_positions(spark, sf):
    """The place of every row in the report of its snapshot."""
    rows = prepare(views.fleet(spark, sf)).withColumn("_lower", F.lower("name"))
    placed = numbered(rows, list(GROUP), ["_lower", "registry_path", ORD], "position")
    return placed.select(*GROUP, "position", "name", "registry_path", ORD)


def _positions(pieces, group):
    return P.with_position(pieces, list(group)).select(*group, "position", "piece")


def report_array_positions(spark, sf):
    pieces = P.report_documents(views.fleet(spark, sf), _snapshots, array_only=True)
    return _positions(pieces, GROUP)


def diff_lines_positions(spark, sf):
    return _positions(P.diff_lines(_history_diff(spark, sf), PAIR), PAIR)


def import_document_positions(spark, sf):
    return _positions(P.import_pieces(_matches(spark, sf), _stamp(), include_versions=True), GROUP)


def unmatched_checklist_positions(spark, sf):
    return _positions(P.checklist_lines(_matches(spark, sf)), GROUP)


def report_document_pretty(spark, sf):
    pieces = P.report_documents(views.fleet(spark, sf), _snapshots, pretty=True)
    return pieces.select(*GROUP, "section", "piece")


def diff_document_pretty(spark, sf):
    return P.diff_pieces(_history_diff(spark, sf), PAIR, pretty=True).select(*PAIR, "section", "piece")


def import_document_pretty(spark, sf):
    pieces = P.import_pieces(_matches(spark, sf), _stamp(), include_versions=True, pretty=True)
    return pieces.select(*GROUP, "section", "piece")


def diff_document_positions(spark, sf):
    """The place of every piece in its diff document."""
    pieces = P.diff_pieces(_history_diff(spark, sf), PAIR)
    return P.with_position(pieces, PAIR).select(*PAIR, "position", "piece")


def snapshot_status(spark, sf):
    """Every snapshot file: usable, bad, or a repetition of another file's snapshot."""
    return snapshots.snapshot_status(snapshots.parse_snapshots(views.snapshot_texts(spark, sf)))


QUERIES = {
    "norm_string": norm_string,
    "norm_install_date": norm_install_date,
    "norm_size": norm_size,
    "norm_system_flag": norm_system_flag,
    "subject_publisher": subject_publisher,
    "arch_label": arch_label,
    "update_flag": update_flag,
    "completeness": completeness,
    "size_human": size_human,
    "match_key": match_key,
    "scan_times": scan_times,
    "snapshot_read": snapshot_read,
    "entry_rehydrate": entry_rehydrate,
    "source_select": source_select,
    "registry_map": registry_map,
    "registry_map_typed": registry_map_typed,
    "collect_status": captures_status,
    "appx_parse": appx_parse,
    "appx_map": appx_map,
    "collect_union": collect_union,
    "source_labels": source_labels,
    "catalog_read": catalog_read,
    "catalog_status": catalog_status,
    "listing_parse": listing_parse,
    "catalog_files": catalog_files,
    "catalog_files_status": catalog_files_status,
    "listing_files": listing_files,
    "listing_files_status": listing_files_status,
    "catalog_importable": catalog_importable,
    "dedup_entries": dedup_entries,
    "cross_source_merge": cross_source_merge,
    "filter_reasons": filter_reasons,
    "filter_entries": filtered,
    "search": search,
    "search_texts": search_texts,
    "prepare": prepared,
    "prepare_all": prepared_all,
    "prepare_stats": stats,
    "history_merge": history_merge,
    "identity_index": identity_index,
    "consecutive_diff": consecutive_diff,
    "snapshot_diff": snapshot_diff,
    "diff_added": diff_added,
    "diff_removed": diff_removed,
    "field_changes": field_changes,
    "diff_summary": diff_summary,
    "latest_inventory": latest_inventory,
    "catalog_match": catalog_match,
    "catalog_match_shared": catalog_match_shared,
    "match_summary": match_summary,
    "scan_metadata": scan_metadata,
    "report_document": report_document,
    "report_array": report_array,
    "diff_document": diff_document,
    "diff_lines": diff_lines,
    "import_document": import_document,
    "unmatched_checklist": unmatched_checklist,
    "display_rows": display_rows,
    "csv_rows": csv_rows,
    "csv_rows_by_snapshot": csv_rows_by_snapshot,
    "report_positions": report_positions,
    "report_array_positions": report_array_positions,
    "diff_document_positions": diff_document_positions,
    "diff_lines_positions": diff_lines_positions,
    "import_document_positions": import_document_positions,
    "unmatched_checklist_positions": unmatched_checklist_positions,
    "report_document_pretty": report_document_pretty,
    "diff_document_pretty": diff_document_pretty,
    "import_document_pretty": import_document_pretty,
    "snapshot_status": snapshot_status,
}


def tuned(query):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return query(tune(spark), sf_dir)

    run.__name__ = query.__name__
    run.__doc__ = query.__doc__
    return run
