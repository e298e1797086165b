"""A Merkle manifest of a dataset: one digest for all documents, and a proof for each.

Every document row is a leaf: the digest of its fields. The leaves of a group (a language) ascend by
id; every ``FAN`` consecutive nodes become their digest until one is left, the group's subroot, and
the subroots, ordered by group, become the root in the same way. A proof holds the siblings of a
leaf and of its ancestors, so one row and its proof are enough to recompute the root.

Levels are built by lag and lead windows. A node of level j stands at the row of its first leaf, so
its siblings are ``i * FAN ** j`` rows away: fixed offsets, masked by the slot in the run and by the
length of the last run. First-child rows hash parents. ``LEVELS`` levels are computed in one
partitioning by (group, block of ``BLOCK`` places), so a group of any size is spread over blocks, and each
further pass has a ``BLOCK``-th of the rows. Places come from a range sort of all rows and the
counts of its partitions; no window spans a group.

Null fields are part of the digest (``-``); null groups form one group, ordered first. Rows of a null id
come first in their group. Ties of ids are ordered by leaf; rows that are equal throughout take
places next to each other, each with its own proof. An empty table has no rows and no root. Other columns of the
documents are left alone and never read. Null ids are never tampered with in ``op11``.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ascii_lower, shared_dir, small, table, written

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FAN, LEVELS = 8, 3
BLOCK = FAN**LEVELS
_PATH = "array<struct<left:string,right:string>>"


def digest(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of strings set one behind the other."""
    return F.sha2(F.concat(*parts), 256)


def framed(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon, and the value."""
    s = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf_digest(fields: dict[str, Column]) -> Column:
    """The digest of a row's fields in their order."""
    return digest(*[framed(c) for c in fields.values()])


def group_key(value: Column) -> Column:
    """A key that is never null and sorts null first, then by bytes."""
    return F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit("-"))


def placed(rows: DataFrame, *by: str) -> DataFrame:
    """Rows with ``pos``, their place from 0 in their group ``g`` by the order given, and ``n``, the group's size.

    The rows are range-sorted and written once, each with its partition and place there; only the counts by
    partition and group are cumulated.
    """
    order = [F.col("g"), *[F.col(c).asc_nulls_first() for c in by], F.col("row_no")]
    rows = rows.withColumn("row_no", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    _, rows = written(rows.withColumn("at", F.monotonically_increasing_id()).drop("row_no"), "manifest")
    part = F.shiftright("at", 33)
    counts = rows.groupBy("g", part.alias("part")).agg(F.count("*").alias("c"), F.min("at").alias("first"))
    group = W.partitionBy("g")
    counts = counts.withColumns({"before": F.sum("c").over(group.orderBy("part")) - F.col("c"), "n": F.sum("c").over(group)})
    starts = shared_dir(counts.select("g", "part", "n", (F.col("before") - F.col("first")).alias("shift")))
    return rows.withColumn("part", part).join(small(starts), ["g", "part"]).withColumn("pos", F.col("at") + F.col("shift")).drop("part", "at", "shift")


def climbed(nodes: DataFrame) -> DataFrame:
    """Nodes (g, pos, n, h) with ``block``, ``inner``: the siblings of ``LEVELS`` levels, and ``h1`` to ``h3`` at first-child rows.

    Where a level has one node, that node stays as it is and has no siblings.
    """
    place = W.partitionBy("g", "block").orderBy("pos")
    out = nodes.withColumn("block", F.floor(F.col("pos") / BLOCK)).withColumnRenamed("h", "h0")
    for j in range(LEVELS):
        step = FAN**j
        h, at = F.col(f"h{j}"), F.floor(F.col("pos") / step)
        size, slot, here = F.ceil(F.col("n") / step), at % FAN, F.col("pos") % step == 0
        before = [F.when(slot >= i, F.lag(h, i * step).over(place)) for i in range(FAN - 1, 0, -1)]
        behind = [F.when((slot + i < FAN) & (at + i < size), F.lead(h, i * step).over(place)) for i in range(1, FAN)]
        join = lambda cs: F.concat(*[F.coalesce(c, F.lit("")) for c in cs])
        out = out.withColumns({f"left{j}": F.when(here, join(before)), f"right{j}": F.when(here, join(behind))})
        side = F.when(here & (size > 1), F.struct(F.col(f"left{j}").alias("left"), F.col(f"right{j}").alias("right")))
        parent = F.when(size > 1, digest(h, F.col(f"right{j}"))).otherwise(h)
        out = out.withColumns({f"side{j}": side, f"h{j + 1}": F.when(F.col("pos") % (step * FAN) == 0, parent)})
    ours = [F.last(f"side{j}", ignorenulls=True).over(place.rowsBetween(W.unboundedPreceding, 0)) for j in range(LEVELS)]
    out = out.withColumns({f"side{j}": c for j, c in enumerate(ours)})
    inner = F.filter(F.array(*[F.col(f"side{j}") for j in range(LEVELS)]), lambda s: s.isNotNull())
    return out.withColumn("inner", inner.cast(_PATH)).drop(*[f"{c}{j}" for c in ("left", "right", "side") for j in range(LEVELS)])


def passes(nodes: DataFrame) -> list[DataFrame]:
    """The nodes of every ``LEVELS``-th level, each group's only node last."""
    most = nodes.agg(F.max("n")).first()[0] or 0
    out = [nodes]
    while most > 1:
        up = climbed(out[-1]).where(F.col("pos") % BLOCK == 0)
        up = up.select("g", F.col("block").alias("pos"), F.ceil(F.col("n") / BLOCK).alias("n"), F.col(f"h{LEVELS}").alias("h"))
        out.append(written(up, "manifest")[1])
        most = -(-most // BLOCK)
    return out


def descended(steps: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The rows of the lowest step with ``path``: their own siblings, then those above, as ``tops`` (g, path) has them for each group."""
    paths = tops.withColumn("pos", F.lit(0).cast("long"))
    for nodes in reversed(steps[:-1]):
        up = paths.select("g", F.col("pos").alias("block"), F.col("path").alias("above"))
        paths = climbed(nodes).join(up, ["g", "block"]).withColumn("path", F.concat("inner", "above")).drop("inner", "above", "block", *[f"h{j + 1}" for j in range(LEVELS)])
        paths = paths.withColumnRenamed("h0", "h")
    return paths if len(steps) > 1 else steps[0].join(tops, "g")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and a proof give."""
    return F.aggregate(path, leaf, lambda h, s: digest(s["left"], h, s["right"]))


def proof_digest(path: Column) -> Column:
    """The digest of a proof's siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


@dataclass(frozen=True)
class Manifest:
    """A dataset's manifest: its root (None without rows), and its rows with ``leaf``, ``subroot`` and ``path``."""

    root: str | None
    rows: DataFrame
    leaves: list[DataFrame]
    subroots: list[DataFrame]

    def nodes(self) -> DataFrame:
        """(part, g, level, pos, digest): all nodes of the groups' trees (part ``leaves``) and of the tree of their subroots."""
        out = []
        for part, steps in (("leaves", self.leaves), ("subroots", self.subroots)):
            out.append(steps[0].select(F.lit(part).alias("part"), "g", F.lit(0).alias("level"), "pos", F.col("h").alias("digest")))
            for k, step in enumerate(steps[:-1]):
                above = [
                    F.struct(F.lit(LEVELS * k + j).alias("level"), F.floor(F.col("pos") / FAN**j).alias("pos"), F.when(F.ceil(F.col("n") / FAN ** (j - 1)) > 1, F.col(f"h{j}")).alias("digest"))
                    for j in range(1, LEVELS + 1)
                ]
                out.append(climbed(step).select(F.lit(part).alias("part"), "g", F.inline(F.array(*above))).where("digest is not null"))
        return reduce(DataFrame.unionByName, out)


def manifest(rows: DataFrame, *by: str) -> Manifest:
    """The manifest of rows (g, leaf and others): per group g in the order given, ties by leaf."""
    leaves = placed(rows.withColumnRenamed("leaf", "h"), *by, "h")
    steps = passes(leaves)
    subroots = steps[-1].select("g", "h")
    named = placed(subroots.select(F.lit("").alias("g"), F.col("g").alias("name"), "h"), "name")
    tops = passes(named)
    root = tops[-1].select("h").first()
    empty = F.array().cast(_PATH)
    above = descended(tops, tops[-1].select("g", empty.alias("path"))).select(F.col("name").alias("g"), "path", F.col("h").alias("subroot"))
    out = descended(steps, above.select("g", "path")).join(small(above.select("g", "subroot")), "g").drop("n").withColumnRenamed("h", "leaf")
    return Manifest(root[0] if root else None, out, steps, tops)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, subroot, root and proof of every document, and the root that each row gives after the tampering."""
    docs = table(spark, sf_dir, "documents").select(*FIELDS)
    own = {c: F.col(c) for c in FIELDS}
    touched = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    rows = docs.select(
        group_key(F.col("lang")).alias("g"), "doc_id", leaf_digest(own).alias("leaf"),
        F.when(touched, leaf_digest(own | {"text": ascii_lower(F.col("text"))})).alias("tampered"),
    )
    made = manifest(rows, "doc_id")
    root = F.lit(made.root).cast("string")
    out = made.rows.withColumn("folded_root", folded(F.coalesce("tampered", "leaf"), F.col("path")))
    return out.select("doc_id", "leaf", "subroot", root.alias("root"), proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == root).alias("verified"))


_LEAF = "sha256(concat({}))".format(", ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE concat(strlen(CAST({c} AS VARCHAR)), ':', {c}) END" for c in ("doc_id", "source", "lang", "n_chars", "{text}")))
SQL = f"""
WITH RECURSIVE bytes AS (
  SELECT DISTINCT doc_id, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)) AS b FROM documents WHERE doc_id IS NOT NULL),
crc AS (
  SELECT doc_id, CAST(4294967295 AS BIGINT) AS v, b, 0 AS bit FROM bytes
  UNION ALL
  SELECT doc_id, CASE WHEN u % 2 = 1 THEN xor(u // 2, CAST(3988292384 AS BIGINT)) ELSE u // 2 END, b, bit + 1
  FROM (SELECT *, CASE WHEN bit % 8 = 0 THEN xor(v, b[bit // 8 + 1]) ELSE v END AS u FROM crc WHERE bit < 8 * len(b))),
touched AS (SELECT doc_id FROM crc WHERE bit = 8 * len(b) AND xor(v, CAST(4294967295 AS BIGINT)) % 3 = 0),
leaves AS (
  SELECT row_number() OVER (ORDER BY doc_id NULLS FIRST) AS rid, doc_id, lang, {_LEAF.replace("{text}", "text")} AS leaf,
         CASE WHEN doc_id IN (SELECT doc_id FROM touched) THEN {_LEAF.replace("{text}", "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS other FROM documents),
spot AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, rid) - 1 AS pos FROM leaves),
tree(level, lang, pos, n, h) AS (
  SELECT 0, lang, pos, count(*) OVER (PARTITION BY lang), leaf FROM spot
  UNION ALL
  SELECT level + 1, lang, pos // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM tree WHERE n > 1 GROUP BY level, lang, pos // 8, n),
subs AS (SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos FROM tree WHERE n = 1),
crown(level, pos, n, h) AS (
  SELECT 0, pos, count(*) OVER (), h FROM subs
  UNION ALL
  SELECT level + 1, pos // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM crown WHERE n > 1 GROUP BY level, pos // 8, n),
near AS (
  SELECT s.rid, t.level, string_agg(t.h, '' ORDER BY t.pos) FILTER (t.pos < s.pos // CAST(pow(8, t.level) AS BIGINT)) AS l, string_agg(t.h, '' ORDER BY t.pos) FILTER (t.pos > s.pos // CAST(pow(8, t.level) AS BIGINT)) AS r
  FROM spot s JOIN tree t ON s.lang IS NOT DISTINCT FROM t.lang AND t.n > 1 AND t.pos // 8 = s.pos // CAST(pow(8, t.level + 1) AS BIGINT) GROUP BY s.rid, t.level),
far AS (
  SELECT s.lang, 100 + t.level AS level, string_agg(t.h, '' ORDER BY t.pos) FILTER (t.pos < s.pos // CAST(pow(8, t.level) AS BIGINT)) AS l, string_agg(t.h, '' ORDER BY t.pos) FILTER (t.pos > s.pos // CAST(pow(8, t.level) AS BIGINT)) AS r
  FROM subs s JOIN crown t ON t.n > 1 AND t.pos // 8 = s.pos // CAST(pow(8, t.level + 1) AS BIGINT) GROUP BY s.lang, t.level),
sides AS (SELECT rid, level, coalesce(l, '') AS l, coalesce(r, '') AS r FROM near UNION ALL SELECT s.rid, level, coalesce(l, ''), coalesce(r, '') FROM spot s JOIN far f ON s.lang IS NOT DISTINCT FROM f.lang),
steps AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY level) AS k, count(*) OVER (PARTITION BY rid) AS m FROM sides),
fold(rid, k, h) AS (
  SELECT rid, 0, coalesce(other, leaf) FROM spot
  UNION ALL
  SELECT f.rid, f.k + 1, sha256(concat(s.l, f.h, s.r)) FROM fold f JOIN steps s ON s.rid = f.rid AND s.k = f.k + 1),
ends AS (SELECT rid, arg_max(h, k) AS folded FROM fold GROUP BY rid),
proofs AS (SELECT rid, sha256(string_agg(concat(l, r), '' ORDER BY k)) AS proof FROM steps GROUP BY rid),
top AS (SELECT h AS root FROM crown WHERE n = 1)
SELECT s.doc_id, s.leaf, b.h AS subroot, root, coalesce(proof, sha256('')) AS proof_sha256, folded AS folded_root, folded = root AS verified
FROM spot s JOIN subs b ON s.lang IS NOT DISTINCT FROM b.lang JOIN ends e ON e.rid = s.rid LEFT JOIN proofs p ON p.rid = s.rid CROSS JOIN top
"""

QUERIES = {"op11_merkle_manifest": op11_merkle_manifest}
ORACLES = {"op11_merkle_manifest": SQL}
