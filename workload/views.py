"""Application rows made from the driver tables.

The tables hold no application records, so each line item stands for one captured
row.  The host is the customer, the snapshot is the quarter of the order, and the
part gives name and publisher.  Everything is a projection of two equi-joins; no
rows are left out.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from appcensus.functions import values as V
from appcensus.functions.text import clean
from appcensus.schema import ENTRY_COLUMNS, GROUP, ORD


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Deal rows out by ``key``, in as many partitions as the session has for a shuffle.

    The files of a table may be few and large, and what is parsed is much more work than its
    bytes tell: with a number, adaptive execution leaves the partitions apart.  A join on ``key``
    that follows needs the same partitioning.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


QUARTER = "date_trunc('quarter', o_orderdate)"
SHIP_DAY = "cast(cast(l_shipdate as date) as string)"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with what the captures need of their order and part."""
    item = table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        "l_quantity",
        "l_extendedprice",
        "l_shipdate",
    )
    # The quarter is told once for an order, not for each of its lines.
    order = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate").withColumns(
        {"o_quarter": F.expr(QUARTER), "o_quarter_day": F.expr(f"date_format({QUARTER}, 'yyyy-MM-dd')")}
    )
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    item = spread(item, "l_orderkey")
    return item.join(order, F.col("l_orderkey") == F.col("o_orderkey")).join(
        part, F.col("l_partkey") == F.col("p_partkey")
    )


CAPTURE = {
    "host": "concat('host-', lpad(cast(o_custkey % 20 as string), 2, '0'))",
    "snapshot_id": "o_quarter_day",
    "scan_ts": "o_quarter",
    "ord": "l_orderkey * 8 + l_linenumber",
    "mark": (
        "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey,"
        " cast(l_quantity as bigint), cast(round(l_extendedprice * 100) as bigint))"
    ),
    "raw_name": (
        "case when l_partkey % 41 = 0 then '   '"
        " when l_partkey % 37 = 0 then concat('KB', l_partkey)"
        " when l_partkey % 31 = 0 then concat('Security Update for ', p_name)"
        " when l_suppkey % 13 = 0 then concat(p_name, ' suite ', l_linenumber, '.0')"
        " when l_suppkey % 19 = 0 then split(p_name, ' ')[0]"
        " when l_linenumber % 2 = 1 then upper(p_name)"
        " when l_linenumber % 3 = 0 then concat('  ', p_name, ' ')"
        " else p_name end"
    ),
    "raw_version": "concat(cast(l_linenumber % 3 as string), '.0')",
    "raw_publisher": (
        "case when l_suppkey % 7 = 0 then null"
        " when l_linenumber % 2 = 1 then upper(p_type) else p_type end"
    ),
    "raw_date": (
        "case l_orderkey % 7"
        f" when 0 then replace({SHIP_DAY}, '-', '')"
        f" when 1 then {SHIP_DAY}"
        " when 2 then concat(month(l_shipdate), '/', day(l_shipdate), '/', year(l_shipdate))"
        f" when 3 then concat(substr({SHIP_DAY}, 6, 2), '/', substr({SHIP_DAY}, 9, 2), '/', substr({SHIP_DAY}, 1, 4))"
        " when 4 then concat(year(l_shipdate), '/', month(l_shipdate), '/', day(l_shipdate))"
        " when 5 then concat(day(l_shipdate), '-', month(l_shipdate), '-', year(l_shipdate))"
        " else concat(year(l_shipdate), '0230') end"
    ),
    "raw_location": (
        "concat('C:\\\\Apps\\\\', p_type, case when l_linenumber % 2 = 0 then '\\\\' else '' end)"
    ),
    "raw_size": (
        "case l_partkey % 11"
        " when 0 then null when 1 then '-5' when 2 then 'n/a' when 3 then '12.7'"
        " when 4 then concat(' 1_', lpad(cast(l_suppkey % 1000 as string), 3, '0'), ' ')"
        " else cast(cast(l_extendedprice * 10 as bigint) as string) end"
    ),
    "raw_system": (
        "case l_suppkey % 17 when 0 then '1' when 1 then 'Yes' when 2 then '0x1'"
        " when 3 then '0' when 4 then ' TRUE ' else null end"
    ),
    "raw_release": (
        "case when l_partkey % 23 = 0 then 'Update' when l_partkey % 29 = 0 then ' HotFix '"
        " else null end"
    ),
    "raw_uninstall": (
        "case when l_linenumber % 4 = 0 then null else concat('remove ', l_partkey) end"
    ),
    "packaged": "l_suppkey % 5 = 0",
    "view": "cast(l_suppkey % 4 as int)",
}


def captured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captured values as text, one row per line item."""
    return lines(spark, sf_dir).select(
        *[F.expr(text).alias(name) for name, text in CAPTURE.items()]
    )


def _fleet_row() -> dict[str, Column]:
    packaged = F.col("packaged")
    return {
        "name": F.coalesce(clean(F.col("raw_name")), F.lit("")),
        "version": clean(F.col("raw_version")),
        "publisher": clean(F.col("raw_publisher")),
        "install_date": V.install_date(F.col("raw_date")),
        "install_location": clean(F.col("raw_location")),
        "estimated_size_kb": V.size_kb(F.col("raw_size")),
        "scope": F.when(packaged, "current_user").otherwise("machine"),
        "architecture": F.when(F.col("view") == 0, "64-bit").otherwise("32-bit"),
        "uninstall_string": clean(F.col("raw_uninstall")),
        "quiet_uninstall_string": F.lit(None).cast("string"),
        "registry_path": F.concat(
            F.when(packaged, F.lit("appx:")).otherwise(F.lit("HKEY_LOCAL_MACHINE\\Apps\\")),
            F.col("mark"),
        ),
        "release_type": clean(F.col("raw_release")),
        "system_component": V.system_flag(F.col("raw_system")),
        "source": F.when(packaged, "appx").otherwise("registry"),
    }


def fleet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw rows of the fleet.  Blank names are kept, for the filters to drop."""
    return captured(spark, sf_dir).select(
        *GROUP, "scan_ts", *[value.alias(name) for name, value in _fleet_row().items()], ORD
    )


def fleet_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with few fields that vary, so that snapshots also have unchanged rows."""
    packaged = F.expr("length(p_name) % 2 = 0")
    values = {
        "name": F.col("p_name"),
        "version": F.expr("concat(cast(l_linenumber % 3 as string), '.0')"),
        "publisher": F.col("p_type"),
        "install_date": F.lit(None).cast("string"),
        "install_location": F.concat(F.lit("C:\\Apps\\"), F.col("p_type")),
        "estimated_size_kb": F.lit(None).cast("bigint"),
        "scope": F.lit("machine"),
        "architecture": F.when(F.expr("l_suppkey % 5 = 0"), "32-bit").otherwise("64-bit"),
        "uninstall_string": F.lit(None).cast("string"),
        "quiet_uninstall_string": F.lit(None).cast("string"),
        "registry_path": F.when(
            packaged, F.concat_ws("_", F.concat(F.lit("appx:"), F.col("p_name")), F.col("p_type"))
        ).otherwise(F.concat(F.lit("HKEY_LOCAL_MACHINE\\Apps\\"), F.expr(CAPTURE["mark"]))),
        "release_type": F.lit(None).cast("string"),
        "system_component": F.lit(False),
        "source": F.when(packaged, "appx").otherwise("registry"),
    }
    return lines(spark, sf_dir).select(
        *[F.expr(CAPTURE[name]).alias(name) for name in (*GROUP, "scan_ts")],
        *[values[name].alias(name) for name in ENTRY_COLUMNS],
        F.expr(CAPTURE["ord"]).alias(ORD),
    )


# Captures as text.  Each row of a driver table makes one capture, so that no rows are
# gathered to build it.


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as a package catalog; some ids are local and some names carry no version."""
    return table(spark, sf_dir, "part").select(
        F.expr(
            "case when p_partkey % 3 = 0 then p_name"
            " else concat(p_name, ' ', cast(p_size as string), '.0') end"
        ).alias("name"),
        F.expr(
            "concat(case when p_partkey % 10 = 0 then 'ARP\\\\' else '' end,"
            " p_brand, '.', cast(p_partkey as string))"
        ).alias("package_id"),
        F.expr("concat(cast(p_size as string), '.0')").alias("version"),
        F.expr("case p_partkey % 4 when 0 then '' when 1 then 'msstore' else 'winget' end").alias(
            "source"
        ),
        F.col("p_partkey").alias(ORD),
    )


def host_catalogs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalog per host of the parts it has ordered; some ids stand under several names."""
    return lines(spark, sf_dir).select(
        F.expr(CAPTURE["host"]).alias("host"),
        F.expr("case when l_partkey % 3 = 0 then p_name else concat(p_name, ' 1.0') end").alias("name"),
        F.expr("concat('Maker.', cast(l_partkey - int(l_partkey % 10 = 1) as string))").alias("package_id"),
        F.lit("1.0").alias("version"),
        F.lit("winget").alias("source"),
        F.col("l_partkey").alias(ORD),
    ).distinct()


def snapshot_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as snapshot files, some of them malformed in one way each."""
    item = (
        "concat('{{\"name\":\" App {n} ', o_custkey, '\",\"version\":{n},\"publisher\":\"',"
        " o_orderpriority, '\",\"estimated_size_kb\":\"{n}_000\",\"system_component\":{flag},"
        "\"source\":\"{source}\"}}')"
    )
    items = ", ".join(
        item.format(n=n, flag=flag, source=source)
        for n, flag, source in ((1, "true", "REGISTRY"), (2, '"no"', "Appx"), (3, "2", " "))
    )
    software = (
        f"concat('[', array_join(slice(array({items}), 1, cast(o_orderkey % 4 as int)), ','),"
        " case when o_orderkey % 4 = 0 then '' else ',' end,"
        " case o_orderkey % 11 when 2 then '{\"version\":\"1\"}'"
        " when 3 then '{\"name\":\"x\",\"estimated_size_kb\":\"big\"}' else '17' end, ']')"
    )
    scan = (
        "concat('{\"hostname\":\"host-', o_custkey % 20, '\",\"started_at\":\"',"
        " date_format(o_orderdate, 'yyyy-MM-dd'), 'T06:00:00Z\"}')"
    )
    text = (
        "case o_orderkey % 11 when 0 then software"
        " when 1 then concat('{\"schema_version\":\"9.9\",\"software\":', software, '}')"
        " when 4 then concat('\ufeff{\"schema_version\":\"1.1\",\"scan\":', scan,"
        " ',\"software\":', software, '}')"
        " when 5 then concat('{\"schema_version\":', software)"
        " when 6 then concat('{\"software\":', software, '}')"
        " else concat('{\"schema_version\":\"1.2\",\"scan\":', scan, ',\"software\":', software, '}')"
        " end"
    )
    orders = spread(table(spark, sf_dir, "orders"), "o_orderkey")
    parts = orders.select(
        "o_orderkey", F.expr(software).alias("software"), F.expr(scan).alias("scan")
    )
    return parts.select(
        F.expr("concat('snapshot-', cast(o_orderkey as string))").alias("path"),
        F.expr(text).alias("text"),
    )


def package_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as captured package listings of two packages each; some are unreadable."""
    first = (
        "concat('{\"name\":\"Vendor.App', o_custkey, '\",\"family\":\"Vendor.App', o_custkey,"
        " '_fam\",\"display_name\":\"', case o_orderkey % 3 when 0 then 'ms-resource:Title'"
        " when 1 then ' ' else concat('App ', o_custkey) end, '\",\"publisher\":\"CN=Maker ',"
        " o_custkey, case when o_orderkey % 2 = 0 then ', O=Firm, C=US' else '' end,"
        " '\",\"version\":\"1.', o_orderkey % 5, '.0.0\",\"architecture\":\"',"
        " case o_orderkey % 4 when 0 then 'X64' when 1 then 'X86' when 2 then 'Arm64'"
        " else 'Other' end, '\",\"installed_date\":\"', date_format(o_orderdate, 'yyyy-MM-dd'),"
        " 'T10:00:00+08:00\",\"is_framework\":', o_orderkey % 5 = 0, '}')"
    )
    second = (
        "concat('{\"name\":\"Extra\",\"publisher_display_name\":\"', o_orderpriority,"
        " '\",\"is_resource\":\"', case when o_orderkey % 3 = 0 then 'Yes' else 'no' end,"
        " '\",\"signature_kind\":\"', case when o_orderkey % 7 = 0 then 'System' else 'Store' end,"
        " '\"}')"
    )
    text = (
        f"case o_orderkey % 13 when 0 then '' when 1 then {first} when 2 then '{{\"name\":'"
        f" when 3 then '42' else concat('[', {first}, ',8,', {second}, ']') end"
    )
    return spread(table(spark, sf_dir, "orders"), "o_orderkey").select(
        F.expr("concat('host-', lpad(cast(o_custkey % 20 as string), 2, '0'))").alias("host"),
        F.expr("concat('scan-', cast(o_orderkey as string))").alias("snapshot_id"),
        F.expr(text).alias("text"),
    )


def catalog_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as catalog files; some are malformed."""
    row = (
        "concat('{\"name\":\"', p_name, '\",\"', case when p_partkey % 2 = 0 then 'id'"
        " else 'package_id' end, '\":\"', p_brand, '.', p_partkey, '\",\"version\":', p_size,"
        " ',\"source\":\"', case when p_partkey % 3 = 0 then '' else ' winget ' end, '\"}')"
    )
    text = (
        f"case p_partkey % 7 when 0 then concat('{{\"packages\":[', {row}, ',', {row}, ']}}')"
        f" when 1 then concat('[', {row}, ',3]') when 2 then concat('[', {row}, ',{{\"name\":\"z\"}}]')"
        f" when 3 then '{{\"none\":1}}' else concat('[', {row}, ']') end"
    )
    return spread(table(spark, sf_dir, "part"), "p_partkey").select(
        F.expr("concat('catalog-', cast(p_partkey as string))").alias("path"),
        F.expr(text).alias("text"),
    )


def listing_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as captured text listings of three packages; some have no header."""
    head = (
        "concat(rpad('Name', 24, ' '), rpad('Id', 20, ' '), rpad('Version', 10, ' '),"
        " rpad('Available', 10, ' '), 'Source')"
    )

    def line(name: str, ident: str, version: str, source: str) -> str:
        return (
            f"concat(rpad({name}, 24, ' '), rpad({ident}, 20, ' '), rpad({version}, 10, ' '),"
            f" rpad('', 10, ' '), {source})"
        )

    lines = (
        "case when c_custkey % 5 = 0 then 'Loading' else '' end",
        f"case when c_custkey % 9 = 0 then 'nothing found' else {head} end",
        "repeat('-', 70)",
        line("c_name", "concat('Firm.', c_custkey)", "'1.0'", "'winget'"),
        "'  noise'",
        line("concat('Store ', c_custkey)", "'Store.App'", "''", "' msstore'"),
        line("'Local'", "concat('ARP\\\\', c_custkey)", "'2.5'", "''"),
        line("''", "'No.Name'", "'1'", "'winget'"),
    )
    joined = f"array_join(array({', '.join(lines)}), '\\r\\n')"
    return spread(table(spark, sf_dir, "customer"), "c_custkey").select(
        F.expr("concat('listing-', cast(c_custkey as string))").alias("path"),
        F.expr(joined).alias("text"),
    )


def listing_files(spark: SparkSession, sf_dir: str, folder: str) -> None:
    """Customers as listing files below ``folder``, a thousand to a file; some have no header.

    The spans differ from file to file, every fourth customer has a line of noise, and every
    second file has a rule below its header.
    """
    listing = "cast(c_custkey div 1000 as int)"
    wide = f"24 + {listing} % 5"
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    lines = (
        f"concat(rpad(c_name, {wide}, ' '), rpad(concat('Firm.', c_custkey), 20, ' '),"
        " rpad('1.0', 10, ' '), rpad('', 10, ' '), 'winget')",
        "case when c_custkey % 4 = 0 then '  noise' else '' end",
        f"concat(rpad(concat('Store ', c_custkey), {wide}, ' '), rpad('Store.App', 20, ' '),"
        " rpad('', 10, ' '), rpad('9', 10, ' '), ' msstore')",
    )
    body = customers.select(
        F.expr(listing).alias("listing"), "c_custkey", F.posexplode(F.array(*map(F.expr, lines)))
    )
    tops = (
        f"case when {listing} % 3 = 0 then 'Loading' else '' end",
        f"case when {listing} % 6 = 5 then 'nothing found' else concat(rpad('Name', {wide}, ' '),"
        " rpad('Id', 20, ' '), rpad('Version', 10, ' '), rpad('Available', 10, ' '), 'Source') end",
        f"case when {listing} % 2 = 0 then repeat('-', 70) else '' end",
    )
    firsts = customers.select((F.expr(listing) * 1000).alias("c_custkey")).distinct()
    head = firsts.select(
        F.expr(listing).alias("listing"), F.lit(-1).alias("c_custkey"),
        F.posexplode(F.array(*map(F.expr, tops))),
    )
    rows = spread(head.unionByName(body), "listing").sortWithinPartitions("listing", "c_custkey", "pos")
    rows.select("listing", F.col("col").alias("value")).write.partitionBy("listing").text(folder)


def catalog_files(spark: SparkSession, sf_dir: str, folder: str) -> None:
    """Parts as JSON catalog files below ``folder``, five hundred to a file, a package to a line.

    Every third file is an object with a list, every seventh has a package without id, and
    every eleventh ends early.
    """
    file = "cast(p_partkey div 500 as int)"
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    package = (
        "concat(',{\"name\":\"', p_name, '\",\"id\":\"Part.', p_partkey, '\",\"version\":', p_size,"
        " ',\"note\":\"} \\\\\" {', case when p_partkey % 2 = 0 then '\",\"tags\":[{\"k\":[{}]}]}' else '\"}' end)"
    )
    body = parts.select(F.expr(file).alias("file"), "p_partkey", F.expr(package).alias("value"))
    top = (
        f"concat(case when {file} % 3 = 2 then '{{\"made\":{{\"by\":{{}}}},\"packages\":' else '' end,"
        f" '[{{\"name\":\"first\"', case when {file} % 7 = 6 then '' else ',\"id\":\"Fix.ed\"' end, '}}')"
    )
    bottom = f"concat(case when {file} % 11 = 10 then '' else ']' end, case when {file} % 3 = 2 then '}}' else '' end)"
    firsts = parts.select((F.expr(file) * 500).alias("p_partkey")).distinct()
    frame = firsts.select(
        F.expr(file).alias("file"),
        F.posexplode(F.array(F.expr(top), F.expr(bottom))).alias("pos", "value"),
    ).select("file", F.when(F.col("pos") == 0, -1).otherwise(2**62).alias("p_partkey"), "value")
    rows = spread(frame.unionByName(body), "file").sortWithinPartitions("file", "p_partkey")
    rows.select("file", "value").write.partitionBy("file").text(folder)


def registry_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captured rows of the fleet as single registry values."""
    values = {
        "DisplayName": "raw_name",
        "DisplayVersion": "raw_version",
        "Publisher": "raw_publisher",
        "InstallDate": "raw_date",
        "InstallLocation": "raw_location",
        "EstimatedSize": "raw_size",
        "UninstallString": "raw_uninstall",
        "ReleaseType": "raw_release",
        "SystemComponent": "raw_system",
    }
    pairs = [
        F.struct(F.lit(name).alias("value_name"), F.col(raw).alias("value")) for name, raw in values.items()
    ]
    return captured(spark, sf_dir).select(
        *GROUP,
        "view",
        F.col("mark").alias("sub_name"),
        F.col("ord").alias("key_ord"),
        F.inline(F.array(*pairs)),
    )


def typed_registry_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registry values as they were stored: text, bytes that may be no UTF-8, numbers, truth values."""
    values = {
        "DisplayName": "case when l_partkey % 5 = 0"
        " then cast(concat(cast(raw_name as binary), X'FF') as variant)"
        " when l_partkey % 5 = 1 then cast(cast(raw_name as binary) as variant)"
        " else cast(raw_name as variant) end",
        "DisplayVersion": "case when l_orderkey % 2 = 0 then cast(l_linenumber as variant)"
        " else cast(raw_version as variant) end",
        "Publisher": "cast(raw_publisher as variant)",
        "InstallDate": "case when l_orderkey % 7 = 0 then cast(cast(raw_date as bigint) as variant)"
        " else cast(raw_date as variant) end",
        "EstimatedSize": "case when raw_size = '12.7' and l_orderkey % 2 = 0 then cast(12.7 as variant)"
        " when raw_size = '-5' then cast(cast(-5 as bigint) as variant)"
        " when l_partkey % 11 > 4 then cast(l_extendedprice * 10 as variant)"
        " else cast(raw_size as variant) end",
        "SystemComponent": "case l_suppkey % 17 when 0 then cast(1 as variant) when 1 then cast(true as variant)"
        " when 2 then cast(false as variant) when 3 then cast(0.5D as variant)"
        " when 4 then cast(cast('yes' as binary) as variant) else cast(raw_system as variant) end",
    }
    columns = {name: F.expr(CAPTURE[name]) for name in CAPTURE}
    rows = lines(spark, sf_dir).select("*", *[value.alias(name) for name, value in columns.items()])
    pairs = [
        F.struct(F.lit(name).alias("value_name"), F.expr(raw).alias("value")) for name, raw in values.items()
    ]
    return rows.select(
        *GROUP, "view", F.col("mark").alias("sub_name"), F.col("ord").alias("key_ord"),
        F.inline(F.array(*pairs)),
    )
