"""Merkle manifest of a dataset: a content-addressed tree and proofs by descent from its root.

Every row is a leaf.  The leaves of a language, in the order of their ids, are the lowest level
of a tree in which ``WIDTH`` consecutive nodes have one parent; the tops of these trees, in the
order of the languages, are the lowest level of the tree that ends in the root.

Building: leaves are put in order by a range shuffle and ranked with counts carried from
partition to partition.  One aggregate per level makes the parents and stores a record, digest to
children, for each of them; a level is an eighth of the one below.  Proving: requests (tree and
rank) go down from the root.  At each level the digest of a node finds its record, the digit of
the rank chooses the child, and the other children join the path.  Requests that have their way
in common go it once, so the paths of a level are as many as the nodes of the level, and the one
join with all requests is the last.  The path was gathered from the root and is reversed.

No level is one task's: rows are keyed by node, and equal digests (repeated rows) share a record,
which adaptive execution may pair with a split side.

Defined results: a null field counts as ``-``; a null language comes first, a null id before all
others of its language; rows with one id are ordered by their digest, and equal rows are leaves of
their own next to each other; a null id is never tampered with; an empty table has no root and
gives no rows.  Other columns of the input are not looked at, whatever their names.
"""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from appcensus.llm.tables import bounded, documents, new_path, written

WIDTH = 8
"""Children of a node."""

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_RECORD = "digest string, children array<string>, height int"
_TREE = "tree string, height int, digest string"
_PATH = "array<struct<before:string,after:string>>"


def hashed(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def leaf_digest(fields: list[Column]) -> Column:
    """Each field as its length in bytes, a colon and its value, or ``-`` for null."""
    texts = [field.cast("string") for field in fields]
    parts = [F.concat(F.octet_length(t).cast("string"), F.lit(":"), t) for t in texts]
    return hashed(F.concat(*[F.coalesce(part, F.lit("-")) for part in parts]))


def tree_of(lang: Column) -> Column:
    """The tree's name: never null, and in the order of the languages with null first."""
    return F.coalesce(F.concat(F.lit("="), lang.cast("string")), F.lit("-"))


def ranked(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` (a table that gives its rows in one order) with ``rank`` and ``n``.

    ``rank`` is the place of a row in its ``tree`` by ``order``, nulls first; ``n`` is the number
    of rows of the tree.  A tree may have any part of the rows: it lies in many partitions, and
    each needs only the number of its rows in the ones before.
    """
    tied = df.withColumn("_tie", F.monotonically_increasing_id())  # parts repeated rows
    keys = [F.col(c).asc_nulls_first() for c in ("tree", *order, "_tie")]
    in_order = tied.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_tie")
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    rows = written(in_order.withColumns({"_part": F.spark_partition_id(), "_at": at}), name)
    pieces = rows.groupBy("_part", "tree").agg(
        F.count(F.lit(1)).alias("_rows"), F.min("_at").alias("_first")
    )
    # One row per partition that a tree reaches into.
    pieces = written(pieces, f"{name}-pieces")
    reach = Window.partitionBy("tree").orderBy("_part")
    whole = Window.partitionBy("tree")
    pieces = written(
        pieces.select(
            "_part", "tree", F.sum("_rows").over(whole).alias("n"),
            (F.sum("_rows").over(reach) - F.col("_rows") - F.col("_first")).alias("_shift"),
        ),
        f"{name}-pieces",
    )
    placed = rows.join(bounded(pieces), ["_part", "tree"])
    return placed.withColumn("rank", F.col("_at") + F.col("_shift")).drop("_part", "_at", "_shift")


class Manifest:
    """The stored trees below a path.

    ``leaves`` (``tree, rank`` and the columns of the rows), ``trees`` (top and height of each
    language), and records ``digest -> children`` by height, of the languages' trees and of the
    tree above them.
    """

    def __init__(self, spark: SparkSession, path: str, width: int = WIDTH):
        self.spark, self.path, self.width = spark, path, width

    def _read(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def trees(self) -> DataFrame:
        return self._read("trees", f"{_TREE}, rank bigint")

    def root(self) -> tuple[int, str] | None:
        """Height of the uppermost tree and its digest; none for an empty table."""
        found = self._read("root", _TREE).first()
        return found and (found["height"], found["digest"])

    def records(self, kind: str, height: int) -> DataFrame:
        every = self._read(f"{kind}-records", _RECORD)
        return every.filter(F.col("height") == height).drop("height")

    def _grow(self, level: DataFrame, kind: str) -> DataFrame:
        """Store the records above ``level`` (``tree, rank, n, digest``); give the trees' tops."""
        tops, height = [], 0
        while True:
            tops.append(
                level.filter("n = 1").select("tree", F.lit(height).alias("height"), "digest")
            )
            wide = level.filter("n > 1")
            if height and wide.isEmpty():
                break
            height += 1
            child = F.struct((F.col("rank") % self.width).alias("digit"), "digest")
            parents = wide.groupBy(
                "tree", F.floor(F.col("rank") / self.width).alias("rank"),
                F.ceil(F.col("n") / self.width).alias("n"),
            ).agg(F.sort_array(F.collect_list(child)).alias("_children"))
            parents = parents.withColumn("children", F.col("_children.digest")).drop("_children")
            level = written(
                parents.withColumn("digest", hashed(F.array_join("children", ""))), f"{kind}-level"
            )
            once = level.groupBy("digest").agg(F.first("children").alias("children"))
            once.write.parquet(f"{self.path}/{kind}-records/height={height}")
        found = tops[0]
        for top in tops[1:]:
            found = found.union(top)
        return found

    def build(self, rows: DataFrame) -> DataFrame:
        """Store the trees of ``rows`` (``tree, doc_id, leaf`` and others); ``rows`` with ranks."""
        leaves = written(ranked(rows, ["doc_id", "leaf"], "leaves-in-order"), "leaves")
        level = leaves.select("tree", "rank", "n", F.col("leaf").alias("digest"))
        tops = self._grow(level, "lang").select(F.lit("").alias("tree"), F.col("tree").alias("of"), "height", "digest")
        tops = written(ranked(written(tops, "tops"), ["of"], "tops-in-order"), "tops")
        tops.select(F.col("of").alias("tree"), "height", "digest", "rank").write.parquet(
            f"{self.path}/trees"
        )
        self._grow(tops.select("tree", "rank", "n", "digest"), "root").write.parquet(f"{self.path}/root")
        return leaves

    def _wanted(self, asked: DataFrame, height: int) -> list[DataFrame]:
        """For each height the nodes (``tree, rank``) above requested ones."""
        out = [asked.select("tree", "rank")]
        for _ in range(height):
            above = out[-1].select("tree", F.floor(F.col("rank") / self.width).alias("rank"))
            out.append(written(above.distinct(), "wanted"))
        return out

    def _children(self, nodes: DataFrame, kind: str, height: int) -> DataFrame:
        """The children of ``nodes`` (``tree, rank, digest, path``), the others of a run in the path."""
        opened = nodes.join(self.records(kind, height), "digest").select(
            "tree", "rank", "path", "children", F.posexplode("children").alias("digit", "child")
        )
        return opened.select(
            "tree", (F.col("rank") * self.width + F.col("digit")).alias("rank"),
            F.col("child").alias("digest"),
            F.concat("path", F.array(_others(F.col("digit")))).alias("path"),
        )

    def prove(self, asked: DataFrame) -> DataFrame:
        """``asked`` (``tree, rank`` and others) with ``path``, the siblings from leaf to root.

        Ranks that a tree does not have give no row.
        """
        root = self.root()
        if root is None:
            return asked.limit(0).withColumn("path", F.lit(None).cast(_PATH))
        trees = self.trees()
        height = trees.agg(F.max("height")).first()[0]
        wanted = self._wanted(asked, height)
        langs = trees.join(wanted[height].select("tree").distinct(), "tree", "left_semi")
        above = self._wanted(langs.select(F.lit("").alias("tree"), "rank"), root[0])

        nodes = self._read("root", _TREE).select(
            "tree", F.lit(0).cast("bigint").alias("rank"), "digest", F.array().cast(_PATH).alias("path")
        )
        for at in range(root[0], 0, -1):
            nodes = self._children(nodes, "root", at).join(above[at - 1], ["tree", "rank"], "left_semi")
            nodes = written(nodes, "descent")
        starts = written(
            nodes.select("rank", "digest", "path").join(trees.drop("digest"), "rank").select(
                "tree", F.lit(0).cast("bigint").alias("rank"), "digest", "path", "height"
            ),
            "descent",
        )
        nodes = starts.filter(F.col("height") == height).drop("height")
        for at in range(height, 1, -1):
            nodes = self._children(nodes, "lang", at).join(wanted[at - 1], ["tree", "rank"], "left_semi")
            nodes = written(
                nodes.union(starts.filter(F.col("height") == at - 1).drop("height")), "descent"
            )
        # Requests meet the runs they are in; a lone leaf is the top of its tree and has no run.
        runs = starts.filter("height = 0").select(
            "tree", F.col("rank").alias("_run"), F.lit(None).cast("array<string>").alias("children"), "path"
        )
        if height:
            runs = runs.union(
                nodes.join(self.records("lang", 1), "digest").select("tree", "rank", "children", "path")
            )
        met = asked.withColumn("_run", F.floor(F.col("rank") / self.width)).join(runs, ["tree", "_run"])
        digit = (F.col("rank") % self.width).cast("int")
        lowest = F.when(
            F.col("children").isNotNull() & (digit < F.size("children")), F.array(_others(digit))
        ).when(F.col("children").isNull() & (digit == 0), F.array().cast(_PATH))
        path = F.concat(lowest, F.reverse("path"))
        return met.withColumn("path", path).filter("path is not null").select(*asked.columns, "path")


def _others(digit: Column) -> Column:
    """The children before and after the chosen one, as text."""
    return F.struct(
        F.array_join(F.slice("children", F.lit(1), digit), "").alias("before"),
        F.array_join(F.slice("children", digit + 2, F.size("children")), "").alias("after"),
    )


def proof_digest(path: Column) -> Column:
    siblings = F.transform(path, lambda run: F.concat(run["before"], run["after"]))
    return hashed(F.array_join(siblings, ""))


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(
        path, leaf, lambda below, run: hashed(F.concat(run["before"], below, run["after"]))
    )


def verify(df: DataFrame, shown: Column, changed: Column, path: str) -> DataFrame:
    """Build the manifest of ``df`` below ``path`` and check every row against its root.

    ``shown`` is the text that is checked where ``changed`` holds.
    """
    fields = {name: df[name] for name in FIELDS}
    original = leaf_digest(list(fields.values()))
    other = leaf_digest(list((fields | {"text": shown}).values()))
    rows = written(
        df.select(
            df["doc_id"].alias("doc_id"), tree_of(df["lang"]).alias("tree"), original.alias("leaf"),
            F.when(F.coalesce(changed, F.lit(False)), other).alias("other"),
        ),
        "leaf-digests",
    )
    manifest = Manifest(df.sparkSession, path)
    leaves = manifest.build(rows)
    root = manifest.root()
    proved = manifest.prove(leaves.select("doc_id", "tree", "rank", "leaf", "other"))
    tops = manifest.trees().select("tree", F.col("digest").alias("subroot"))
    out = proved.join(bounded(tops), "tree").withColumn("root", F.lit(root and root[1]).cast("string"))
    out = out.withColumn("folded_root", folded(F.coalesce("other", "leaf"), F.col("path")))
    return out.select(
        "doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"),
        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = documents(spark, sf_dir)
    changed = F.crc32(df["doc_id"].cast("string").cast("binary")) % 3 == 0
    return verify(df, F.translate(df["text"], UPPER, LOWER), changed, new_path(spark, "merkle"))


def _leaf_sql(text: str) -> str:
    def part(field: str) -> str:
        return f"coalesce(strlen({field}::varchar) || ':' || {field}::varchar, '-')"

    return f"sha256({' || '.join(part(f) for f in ('doc_id', 'source', 'lang', 'n_chars', text))})"


# The bits of the decimal id, lowest first, through the polynomial of crc32.
_CRC = (
    "list_reduce([4294967295::bigint] || list_transform(range(8 * strlen(doc_id::varchar)),"
    " lambda i: ((ascii(substr(doc_id::varchar, cast(i // 8 + 1 as bigint), 1))"
    " >> cast(i % 8 as int)) & 1)::bigint),"
    " lambda c, b: xor(c >> 1, case when (c & 1) <> b then 3988292384 else 0 end))"
)

OP11_SQL = f"""
with recursive leaf as (
  select doc_id, lang, {_leaf_sql('text')} as leaf,
         case when xor({_CRC}, 4294967295::bigint) % 3 = 0
              then {_leaf_sql(f"translate(text, '{UPPER}', '{LOWER}')")} end as other
  from documents
), placed as (
  select *, coalesce('=' || lang, '-') as tree,
         row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as rank
  from leaf
), low as (
  select tree, 0 as height, rank, leaf as digest, count(*) over (partition by tree) as n from placed
  union all
  select tree, height + 1, rank // {WIDTH}, sha256(string_agg(digest, '' order by rank)), (any_value(n) + {WIDTH - 1}) // {WIDTH}
  from low where n > 1 group by tree, height, rank // {WIDTH}
), tops as (
  select tree, digest, row_number() over (order by tree) - 1 as place, count(*) over () as n from low where n = 1
), high as (
  select '' as tree, 0 as height, place as rank, digest, n from tops
  union all
  select tree, height + 1, rank // {WIDTH}, sha256(string_agg(digest, '' order by rank)), (any_value(n) + {WIDTH - 1}) // {WIDTH}
  from high where n > 1 group by tree, height, rank // {WIDTH}
), runs as (
  select tree, height, rank // {WIDTH} as run, list(digest order by rank) as nodes
  from (select * from low union all select * from high) where n > 1
  group by tree, height, rank // {WIDTH}
), up as (
  select row_number() over () as request, doc_id, leaf, tree as lang_tree, tree, 0 as height, rank,
         coalesce(other, leaf) as folded, '' as proof
  from placed
  union all
  select u.request, u.doc_id, u.leaf, u.lang_tree,
         case when r.run is null then '' else u.tree end,
         case when r.run is null then 0 else u.height + 1 end,
         case when r.run is null then t.place else u.rank // {WIDTH} end,
         case when r.run is null then u.folded else sha256(array_to_string(
           r.nodes[1:u.rank % {WIDTH}] || [u.folded] || r.nodes[u.rank % {WIDTH} + 2:], '')) end,
         case when r.run is null then u.proof else u.proof || array_to_string(
           r.nodes[1:u.rank % {WIDTH}] || r.nodes[u.rank % {WIDTH} + 2:], '') end
  from up u
  left join runs r on u.tree = r.tree and u.height = r.height and u.rank // {WIDTH} = r.run
  left join tops t on u.tree = t.tree
  where r.run is not null or u.tree <> ''
), ends as (
  select * from up where tree = '' and height = (select max(height) from high)
)
select e.doc_id, e.leaf, t.digest as subroot, h.digest as root, sha256(e.proof) as proof_sha256,
       e.folded as folded_root, e.folded = h.digest as verified
from ends e join tops t on e.lang_tree = t.tree, high h where h.n = 1
"""

QUERIES = {"op11_merkle_manifest": op11_merkle_manifest}
ORACLE = {"op11_merkle_manifest": OP11_SQL}
