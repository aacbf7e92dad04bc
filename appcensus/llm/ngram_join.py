"""N-gram Jaccard join: a size-aware heavy-light join of shingle sets.

Two documents link when the Jaccard similarity of their sets of distinct word shingles is at
least a threshold t; the result is the component of each document and its number of links.

1. One pass over the texts gives each document a digest of its set, the set's size n and
   candidate tokens.  Documents with equal sets are one class from here on.
2. Tokens have one global order: those with a hash in a low band come first, by document
   frequency, then all others by hash.  Sets that link share one token among their first
   n - ceil(t n) + 1, and two among one more.  A token that only one class has links nothing,
   yet fills its place in the order, so a text without a near copy keeps no token at all.
   Small sets get a wider band, in a regime of their own: regimes overlap by as much as the
   sizes of linked sets can differ, so linked sets meet in one, and each has its own order.
3. Light sets (n up to a boundary) enumerate all 2-subsets of their first tokens; sets that
   share a subset are candidates.  Heavy sets, and those light ones large enough to link to
   one, are in the inverted list of each first token.  The boundary is that of least cost,
   from a histogram of sizes: subsets written against list rows written and scanned.
4. Lists are kept apart by size: sizes fall into bands as wide as linked sizes can differ, and
   slot k of a list has the sets of the bands k and k - 1.  Lists are not expanded into pairs.
   Each hangs its sets on its smallest one, the hub, and the sets on one hub are a group: sets
   that share a list share its hub.  Groups do not run into each other through sets that only
   chance connects, so they stay small as the corpus grows.
5. A group's sets are read again from their texts and compared exactly, in blocks of bounded
   size: a large group is cut into blocks and every pair of blocks is a task's group of its
   own.  A pair that meets more than once counts in the slot of its larger band, at the
   smallest hub it shares.  A comparison returns a spanning forest of links and link counts.
6. The components of these forests are the result.

There is no cap on lists, candidates or clusters.  Shingles and words are compared by 64-bit
hashes, sets are equal by 128 bits.

Defined results: null and empty texts, and texts without words, have no shingles, link with
nothing and form their own component; a text with fewer words than a shingle has its whole
sequence as one; rows with equal sets link, repeated rows and rows with a null id included;
the component id is the smallest id and null only if all ids are.  Other columns of the input
are not looked at.
"""

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from appcensus.llm.components import components
from appcensus.llm.tables import bounded, documents, in_python, one_of_each, written
from appcensus.llm.words import mixed, shingle_sets

REGIMES = ((64, 10.0), (256, 4.0), (None, 2.0))
"""Largest size of a regime, and how many times the part 1 - t of all hashes its band holds."""
SCAN_COST = 1 / 256
"""Cost of a list entry scanned, against that of a row written.  Measured on one core: a row of a
2-subset takes 10 microseconds through its explosion and two shuffles.  Two near copies of 300
shingles are compared in a block in 1.1 microseconds, and being in the lists of about 30 tokens
each they are 60 of the entries counted here: 0.02 microseconds an entry, 1/500 of a row; sets that
only share a list cost up to 9 microseconds a pair, but are few."""
BLOCK_SETS = 256
BLOCK_TOKENS = 1 << 21
"""A block of a large cluster has about so many sets, or so many shingles."""
FEW = 24


def first_tokens(n: int, percent: int) -> int:
    """How many first tokens of a set of size n must hold two of those it shares."""
    return n - -(-percent * n // 100) + 2


_SALTS = (np.uint64(0xA5A5A5A5A5A5A5A5), np.uint64(0x3C6EF372FE94F82B))


def _set_digest(tokens: np.ndarray) -> bytes:
    """128 bits of a set."""
    sums = np.array([mixed(tokens ^ salt).sum(dtype=np.uint64) for salt in _SALTS], np.uint64)
    return mixed(sums + np.uint64(len(tokens))).tobytes()


def _edges(percent: int) -> list[np.uint64]:
    """The end of each regime's band of hashes."""
    parts = [min(1.0, times * (100 - percent) / 100) for _, times in REGIMES]
    return [np.uint64(min(2**64 - 1, int(part * 2**64))) for part in parts]


def _in_regimes(tokens: np.ndarray, percent: int, edges) -> tuple[np.ndarray, list[int]]:
    """The tokens a set puts forward in each of its regimes, and how many are in the band.

    The last two bits of a token are its regime's number.
    """
    n, least, out, bands = len(tokens), 0, [], []
    for number, ((most, _), edge) in enumerate(zip(REGIMES, edges)):
        band = 0
        if 100 * n >= percent * (least + 1) and (most is None or n <= most):
            band = int(np.searchsorted(tokens, edge))
            found = tokens[: max(band, first_tokens(n, percent))]
            out.append(found & np.uint64(2**64 - 4) | np.uint64(number))
        bands.append(band)
        least = most
    return np.concatenate(out), bands


def _shingled(df: DataFrame, width: int, percent: int, id_column: str, text: str) -> DataFrame:
    """Per row ``_id, th, digest, n, bands, tokens, num``; ``bands`` by regime.

    Within a batch only the first row of a class carries tokens.  ``num`` numbers the rows:
    the numbers of neighbours differ in few bytes, so they take less room in a shuffle than
    digests.
    """
    schema = pa.schema(
        [("_id", pa.int64()), ("th", pa.int64()), ("digest", pa.binary()), ("n", pa.int64()),
         ("bands", pa.list_(pa.int64())), ("tokens", pa.list_(pa.int64()))]
    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = _edges(percent)
        for batch in batches:
            digests, sizes, bands, tokens, seen = [], [], [], [], set()
            for found in shingle_sets(batch.column(2), width):
                n = len(found)
                digest = _set_digest(found) if n else None
                mine, in_band = np.zeros(0, np.uint64), [0] * len(REGIMES)
                if n:
                    mine, in_band = _in_regimes(found, percent, edges)
                    if digest in seen:
                        mine = mine[:0]
                    seen.add(digest)
                digests.append(digest)
                sizes.append(n)
                bands.append(in_band)
                tokens.append(mine.view(np.int64))
            ends = np.cumsum([0, *map(len, tokens)]).astype(np.int32)
            flat = np.concatenate(tokens) if tokens else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(digests, pa.binary()),
                 pa.array(sizes, pa.int64()), pa.array(bands, pa.list_(pa.int64())),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))],
                schema=schema,
            )

    rows = df.select(
        df[id_column].cast("bigint").alias("_id"), F.xxhash64(df[text]).alias("th"),
        df[text].cast("string").alias("_text"),
    )
    scanned = in_python(
        rows, scan,
        "_id bigint, th bigint, digest binary, n bigint, bands array<bigint>, tokens array<bigint>",
    )
    return scanned.withColumn("num", F.monotonically_increasing_id())


def _first_shared(shingled: DataFrame, percent: int) -> DataFrame:
    """The first tokens of each row and regime that another row has too:
    ``num, digest, n, token, df, in_list`` (``in_list``: also among the first by one less)."""
    rows = shingled.select(F.explode("tokens").alias("token"), "num")
    # Copies in other batches count as well: their tokens are taken for shared and then meet
    # only their own class.
    shared = rows.groupBy("token").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    sizes = shingled.filter(F.size("tokens") > 0).select(
        F.col("num").alias("_num"), "digest", "n", "bands"
    )
    active = rows.join(shared, "token").join(sizes, F.col("num") == F.col("_num")).drop("_num")
    active = active.withColumn("regime", F.col("token").bitwiseAND(3))
    # Tokens are unsigned; with the sign bit turned over they compare as such.
    turned = F.col("token").bitwiseXOR(F.lit(-(2**63)))
    edges = F.array(*[F.lit(int(np.int64(np.uint64(e) ^ np.uint64(2**63)))) for e in _edges(percent)])
    at_regime = (F.col("regime") + 1).cast("int")
    active = active.withColumns(
        {"_banded": turned < F.element_at(edges, at_regime), "_band": F.element_at("bands", at_regime)}
    )
    in_class = Window.partitionBy("num", "regime")
    alone = F.col("_band") - F.count(F.when(F.col("_banded"), 1)).over(in_class)
    rank = F.row_number().over(in_class.orderBy(F.desc("_banded"), "df", "token"))
    # A set puts forward tokens beyond its band only as many as its first ones need.
    place = F.when(F.col("_banded"), alone + rank).otherwise(0)
    most = F.col("n") - F.ceil(F.col("n") * percent / F.lit(100)) + 2
    return (
        active.withColumns({"_place": place, "_most": most}).filter("_place <= _most")
        .select("num", "digest", "n", "token", "df", (F.col("_place") < F.col("_most")).alias("in_list"))
    )


def light_limit(histogram: list, percent: int) -> int:
    """The largest size of a light set, of least cost.

    ``histogram`` has rows (largest size, subsets, list rows, list entries scanned) by size.
    """
    limits = [0] + sorted(row[0] for row in histogram)

    def cost(limit: int) -> float:
        total = 0.0
        for size, subsets, rows, scanned in histogram:
            if size <= limit:
                total += subsets
            if 100 * size >= percent * (limit + 1):
                total += rows + SCAN_COST * scanned
        return total

    return min(limits, key=cost)


def _band_of(n: Column, percent: int) -> Column:
    """Size bands a little wider than linked sizes can differ."""
    return F.floor(F.log(n.cast("double")) / math.log(1.001 * 100 / percent))


def _lists(first: DataFrame, percent: int) -> DataFrame:
    """Rows ``key, digest, slot``: the 2-subsets of light sets and the tokens heavy sets can meet."""
    per_class = first.groupBy("num", "n").agg(
        F.count(F.lit(1)).alias("k"), F.count(F.when(F.col("in_list"), 1)).alias("rows"),
        F.coalesce(F.sum(F.when(F.col("in_list"), F.col("df"))), F.lit(0)).alias("scanned"),
    )
    # Sizes by powers of the square root of two: a few dozen rows, however many sets.
    histogram = per_class.groupBy(F.floor(2 * F.log2("n")).alias("step")).agg(
        F.max("n"), F.sum(F.expr("k * (k - 1) / 2")), F.sum("rows"), F.sum("scanned")
    ).collect()
    limit = light_limit([tuple(row)[1:] for row in histogram], percent)
    # A light set has at most ``first_tokens(limit)`` tokens here, in each of its regimes.
    light = first.filter(F.col("n") <= limit).groupBy("num", "digest", "n", F.expr("token & 3")).agg(
        F.sort_array(F.collect_list("token")).alias("t")
    )
    subsets = light.filter("size(t) > 1").select(
        F.explode(
            F.expr(
                "flatten(transform(sequence(0, size(t) - 2), i ->"
                " transform(slice(t, i + 2, size(t)), y -> xxhash64(t[i], y))))"
            )
        ).alias("key"),
        "digest", "n",
    )
    heavy = first.filter(F.col("in_list") & (100 * F.col("n") >= percent * (limit + 1)))
    rows = subsets.union(heavy.select(F.col("token").alias("key"), "digest", "n"))
    band = _band_of(F.col("n"), percent)
    return rows.withColumn("slot", F.explode(F.array(band, band + 1))).drop("n")


def _groups(lists: DataFrame, first: DataFrame, percent: int) -> DataFrame:
    """``digest, slot, hub``: a set hangs on the smallest set of each of its lists.

    Only numbers of lists and of sets within a slot go through the shuffles.
    """
    rows = lists.select(
        F.xxhash64("key", "slot").alias("list"), F.xxhash64("digest", "slot").alias("node")
    )
    hubs = rows.groupBy("list").agg(F.min("node").alias("hub"), F.max("node").alias("_hi"))
    hubs = hubs.filter("hub <> _hi").select(F.col("list").alias("_list"), "hub")
    hung = rows.join(hubs, F.col("list") == F.col("_list")).select("node", "hub").distinct()
    band = _band_of(F.col("n"), percent)
    named = first.select("digest", "n").distinct().select(
        "digest", F.explode(F.array(band, band + 1)).alias("slot")
    ).withColumn("_node", F.xxhash64("digest", "slot"))
    return hung.join(named, F.col("node") == F.col("_node")).select("digest", "slot", "hub")


def _intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections between two lists of sorted sets."""
    if len(left) * len(right) <= FEW * FEW:
        return np.array(
            [[len(np.intersect1d(x, y, assume_unique=True)) for y in right] for x in left]
        ).reshape(len(left), len(right))
    sides = (left, right)
    tokens = np.concatenate([*left, *right])
    owner = np.concatenate([np.repeat(np.arange(len(s)), [len(x) for x in s]) for s in sides])
    of_left = np.zeros(len(tokens), bool)
    of_left[: sum(map(len, left))] = True
    order = np.argsort(tokens, kind="stable")
    tokens, owner, of_left = tokens[order], owner[order], of_left[order]
    group = np.cumsum(np.append(True, tokens[1:] != tokens[:-1])) - 1
    on_left = np.bincount(group, of_left)
    on_right = np.bincount(group, ~of_left)
    both = (on_left > 0) & (on_right > 0)
    number = np.cumsum(both) - 1
    keep = both[group]
    column, owner, of_left = number[group[keep]], owner[keep], of_left[keep]
    out = np.zeros((len(left), len(right)), np.float64)
    width = 4096
    for start in range(0, int(both.sum()), width):
        lo, hi = np.searchsorted(column, [start, start + width])
        parts = []
        for side, size in ((True, len(left)), (False, len(right))):
            matrix = np.zeros((size, width), np.float32)
            mine = of_left[lo:hi] == side
            matrix[owner[lo:hi][mine], column[lo:hi][mine] - start] = 1
            parts.append(matrix)
        out += parts[0] @ parts[1].T
    return out


def _linked(
    left: list[np.ndarray], right: list[np.ndarray], percent: int
) -> np.ndarray:
    common = _intersections(left, right).astype(np.int64)
    sizes = [np.array([len(x) for x in s], np.int64) for s in (left, right)]
    return 100 * common >= percent * (sizes[0][:, None] + sizes[1][None, :] - common)


def _forest(members: dict, hub: int, same: bool, block: int, percent: int) -> tuple[list, list, list]:
    """Spanning forest and link counts of one group: digests, roots, links.

    ``members``: digest to (copies, block, guest, tokens, hubs); two guests meet in another
    slot, and a pair with a smaller hub in common meets there too.
    """
    digests = list(members)
    root = {d: d for d in digests}

    def top(d):
        while root[d] != d:
            root[d] = root[root[d]]
            d = root[d]
        return d

    sides = [digests, digests]
    if not same:
        sides = [[d for d in digests if (members[d][1] == block) == first] for first in (True, False)]
    links = dict.fromkeys(digests, 0)
    if sides[0] and sides[1]:
        hit = _linked(*[[members[d][3] for d in s] for s in sides], percent)
        guests = [np.array([members[d][2] for d in s]) for s in sides]
        hit &= ~(guests[0][:, None] & guests[1][None, :])
        for i, j in zip(*np.nonzero(hit)):
            x, y = sides[0][i], sides[1][j]
            if same and j <= i or min(members[x][4] & members[y][4]) != hub:
                continue
            links[x] += members[y][0]
            links[y] += members[x][0]
            x, y = sorted((top(x), top(y)))
            root[y] = x
    return digests, [top(d) for d in digests], [links[d] for d in digests]


_SPREAD = "hub bigint, bi bigint, bj bigint, digest binary, copies bigint, block bigint," \
    " guest boolean, hubs array<bigint>, tokens binary"
_SPREAD_ARROW = pa.schema(
    [("hub", pa.int64()), ("bi", pa.int64()), ("bj", pa.int64()), ("digest", pa.binary()),
     ("copies", pa.int64()), ("block", pa.int64()), ("guest", pa.bool_()),
     ("hubs", pa.list_(pa.int64())), ("tokens", pa.binary())]
)
_FOREST_ARROW = pa.schema([("digest", pa.binary()), ("root", pa.binary()), ("links", pa.int64())])


def _compared(
    df: DataFrame, members: DataFrame, width: int, percent: int, id_column: str, text: str
) -> DataFrame:
    """``digest, root, links`` of each comparison a class takes part in."""
    texts = df.select(
        df[id_column].cast("bigint").alias("_id"), F.xxhash64(df[text]).alias("_th"),
        df[text].cast("string").alias("_text"),
    )
    # Most texts are in no group.  While the groups' texts are few, every executor gets their
    # keys and the others stay where they are; beyond that all texts are dealt out by key.
    keys = members.select(F.col("rep_id").alias("_key_id"), F.col("rep_th").alias("_key_th"))
    keys = bounded(keys)
    wanted = texts["_id"].eqNullSafe(keys["_key_id"]) & (texts["_th"] == keys["_key_th"])
    texts = texts.join(keys, wanted, "left_semi")
    same_row = texts["_id"].eqNullSafe(members["rep_id"]) & (texts["_th"] == members["rep_th"])
    found = texts.join(members, same_row).select("digest", "copies", "places", "_text")

    def spread(batches):
        for batch in batches:
            digests, copies, places = (batch.column(i).to_pylist() for i in range(3))
            for k, tokens in enumerate(shingle_sets(batch.column(3), width)):
                if _set_digest(tokens) != digests[k]:
                    continue
                hubs: dict[int, list[int]] = {}
                for place in places[k]:
                    hubs.setdefault(place["slot"], []).append(place["hub"])
                rows = []
                for place in places[k]:
                    block = int.from_bytes(digests[k][:8]) % place["blocks"]
                    rows.extend(
                        (place["hub"], min(block, other), max(block, other), digests[k], copies[k],
                         block, place["guest"], hubs[place["slot"]], tokens.tobytes())
                        for other in range(place["blocks"])
                        if place["kept"]
                    )
                for at in range(0, len(rows), 256):
                    columns = zip(*rows[at : at + 256])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, f.type) for c, f in zip(columns, _SPREAD_ARROW)],
                        schema=_SPREAD_ARROW,
                    )

    groups = in_python(found, spread, _SPREAD).repartition("hub", "bi", "bj")
    groups = groups.sortWithinPartitions("hub", "bi", "bj")

    def compare(batches):
        key, members = None, {}

        def done():
            if len(members) > 1:
                found = _forest(members, key[0], key[1] == key[2], key[1], percent)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(found, _FOREST_ARROW)], schema=_FOREST_ARROW
                )

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(8)]
            for k, (hub, bi, bj, digest, copies, block, guest, hubs) in enumerate(zip(*columns)):
                if (hub, bi, bj) != key:
                    yield from done()
                    key, members = (hub, bi, bj), {}
                tokens = np.frombuffer(batch.column(8)[k].as_buffer(), np.uint64).copy()
                members[digest] = (copies, block, guest, tokens, set(hubs))
        yield from done()

    return in_python(groups, compare, "digest binary, root binary, links bigint")


def ngram_join(
    df: DataFrame,
    width: int = 5,
    percent: int = 80,
    id_column: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Per row: id, ``n_shingles``, ``component_id``, ``n_links``; ``percent`` is 100 t."""
    shingled = written(_shingled(df, width, percent, id_column, text), "shingled")
    shingled_keys = shingled.select("_id", "th", "digest", "n")
    first = written(_first_shared(shingled, percent), "first-tokens")
    groups = written(_groups(_lists(first, percent), first, percent), "groups")

    classes = written(
        shingled_keys.filter("n > 0").groupBy("digest").agg(
            F.min(F.struct("_id", "th")).alias("rep"), F.min("_id").alias("least"),
            F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"),
        ),
        "classes",
    )
    nodes = groups.withColumnRenamed("digest", "_d").join(classes, F.col("_d") == classes["digest"])
    nodes = nodes.withColumn("guest", _band_of(F.col("n"), percent) < F.col("slot"))
    # Written down, so that the join with it can split a hub that very many sets hang on.
    sizes = written(
        nodes.groupBy(F.col("hub").alias("_of")).agg(
            F.greatest(
                F.ceil(F.count(F.lit(1)) / BLOCK_SETS), F.ceil(F.sum("n") / BLOCK_TOKENS)
            ).alias("blocks"),
            (~F.min("guest")).alias("kept"),  # guests alone have met elsewhere
        ),
        "hub-sizes",
    )
    place = F.struct("slot", "hub", "blocks", "guest", "kept")
    # A class is in at most two groups for each of its first tokens.
    members = written(
        nodes.join(sizes, nodes["hub"] == sizes["_of"]).groupBy("digest").agg(
            F.first("copies").alias("copies"), F.collect_list(place).alias("places"),
            F.first("rep._id").alias("rep_id"), F.first("rep.th").alias("rep_th"),
            F.max("kept").alias("_kept"),
        ).filter("_kept").drop("_kept"),
        "members",
    )
    forest = written(_compared(df, members, width, percent, id_column, text), "forest")
    linked = components(
        forest.filter("digest <> root").select(F.col("digest").alias("a"), F.col("root").alias("b"))
    )
    links = forest.groupBy(F.col("digest").alias("_of")).agg(F.sum("links").alias("links"))
    named = classes.join(linked, classes["digest"] == linked["node"], "left").join(
        links, classes["digest"] == links["_of"], "left"
    ).select("digest", "least", "copies", F.coalesce("label", "digest").alias("label"),
             F.coalesce("links", F.lit(0)).alias("links"))
    named = written(named, "named")
    least = named.groupBy("label").agg(F.min("least").alias("component_id"))
    named = named.join(least, "label").select(
        F.col("digest").alias("_of"), "label", "component_id",
        (F.col("copies") - 1 + F.col("links")).alias("n_links"),
    )
    joined = shingled_keys.join(named, F.col("digest") == F.col("_of"), "left")
    return joined.select(
        F.col("_id").alias(id_column),
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("_id")).alias("component_id"),
        F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"),
        F.col("th").alias("_th"),
        F.col("label").alias("_label"),
    )


def keep_one(df: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``df`` that stay: one of each component, with its smallest id.

    Rows without shingles are components of their own and all stay.
    """
    rows = written(
        ngram_join(df, width, percent).filter("_label is not null").select(
            F.col("doc_id").alias("_id"), F.col("_th").alias("_raw"), F.col("_label").alias("_group"),
            F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"),
        ),
        "near-copies",
    )
    return one_of_each(df, rows, "doc_id", "text")


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(documents(spark, sf_dir), width=3, percent=90).drop("_th", "_label")


QUERIES = {"op9_ngram_join": op9_ngram_join}
ORACLE: dict[str, str] = {}
