"""Self-join of documents by the Jaccard similarity of their word shingles, with adaptive multi-match
prefixes.

Exact method (as far as 64-bit hashes of shingles and 128-bit hashes of whole sets don't collide), in four
steps.

1. Equal sets are one node.
2. A filter by the same prefix bound, over tokens in the order of their hashes: of the first third of a
   node's tokens, a linked node must share a share (``least_shared``). Nodes with fewer tokens that occur in
   any other node have no link. Most nodes end here, and no table of frequencies is needed for it.
3. The tokens of the nodes that are left are counted in full, and each node's tokens get one global order,
   rarest first. A node of n tokens with prefix length n - ceil(t n) + l shares at least l prefix tokens with
   any partner of similarity t whose prefix is lengthened by at least as much, so l is chosen for each node
   by the estimated cost of its candidates, and pairs need at least the smaller l of both before they are
   verified. Pairs meet only at a token that may be their first common one: in both nodes as many tokens
   as the least overlap of their two sizes must follow from it on. Any order and any l give the same links;
   they only change the work.
4. Big groups don't grow pairs. Each token links its nodes to one hub of like size first, and the links found
   join them to classes; afterwards only pairs from different classes are tried, which are few where many near
   copies share a token. So not all links are listed, but no two linked documents end in different classes.

Links are counted, where that is asked for, once the classes are known: a link never leaves its class, so
every pair of sets of a class is compared, block by block, and only sums are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import checkpointed, documents, drop_stored, in_parts, small_enough, stored, whole_text
from tidewater.llm.components import components
from tidewater.llm.shingles import shingle_sets

NUM, DEN = 75, 100  # the similarity threshold
COSTLY = 48  # candidates that a document's prefix tokens bring before its prefix is lengthened
MAX_EXTRA = 15  # prefix tokens beyond the least
MAX_BROADCAST_IDS = 1_000_000  # 8 MB of numbers; ids of other types are joined by a shuffle
BLOCK_SETS, BLOCK_TOKENS = 1024, 1_000_000  # about what a block of a class holds; two blocks meet in a task
BLOCK_COLUMNS = 4096  # tokens multiplied at once

#: A part of n tokens that any partner shares: its sizes are n * t at least.
LEAST = f"CAST(ceil(CAST({NUM} AS DOUBLE) * n / {DEN}) AS BIGINT)"
LIKE_SIZES = f"least(na, nb) * {DEN} >= greatest(na, nb) * {NUM}"
#: The least overlap of a link between sizes na and nb.
OVERLAP = f"ceil(CAST({NUM} AS DOUBLE) * (na + nb) / {NUM + DEN})"
#: Whether a common token (ra, rb: the tokens from it on) may be the first common one of a link.
MAY_BE_FIRST = f"least(ra, rb) >= {OVERLAP}"


def fingerprints(tokens: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for each set that depend on the set alone; 0 for empty ones."""
    out, some = np.zeros((2, len(offsets) - 1), np.uint64), np.diff(offsets) > 0
    if len(tokens):
        with np.errstate(over="ignore"):
            out[0, some] = np.add.reduceat(tokens * np.uint64(0xD6E8FEB86659FD93), offsets[:-1][some])
            out[1, some] = np.add.reduceat((tokens ^ (tokens >> np.uint64(29))) * (tokens | np.uint64(1)), offsets[:-1][some])
    return out[0].view(np.int64), out[1].view(np.int64)


def survey(docs: DataFrame) -> DataFrame:
    """(doc_id, n, f1, f2) of each row of (doc_id, text): its set's size and fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_parts(batches):
            for lo, tokens, at in shingle_sets(b.column(1)):
                f1, f2 = fingerprints(tokens, at)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, len(f1)), pa.array(np.diff(at)), pa.array(f1), pa.array(f2)], names=["doc_id", "n", "f1", "f2"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n bigint, f1 bigint, f2 bigint")


def token_rows(docs: DataFrame, first_third: bool = False) -> DataFrame:
    """(token, doc, n): a row for each distinct token of each text, or for the first of them in the order of
    their hashes: n - ceil(t n) + n / 12 (1 at least) of n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_parts(batches):
            for lo, tokens, at in shingle_sets(b.column(1)):
                n = np.diff(at)
                owner = np.repeat(np.arange(len(n)), n)
                if first_third:
                    kept = np.arange(len(tokens)) - at[owner] < (n - -(-NUM * n // DEN) + np.maximum(1, n // 12))[owner]
                    tokens, owner = tokens[kept], owner[kept]
                yield pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64)), b.column(0).take(pa.array(owner + lo)), pa.array(n[owner])], names=["token", "doc", "n"])

    return docs.mapInArrow(run, f"token bigint, doc {docs.schema['doc_id'].dataType.simpleString()}, n bigint")


def least_shared(n: Column) -> Column:
    """How many of a node's first third a partner of like size shares at least: the l of the smaller partner."""
    return F.greatest(F.lit(1), F.floor(F.ceil(F.lit(float(NUM)) * n / DEN) / 12))


def candidates(nodes: DataFrame) -> DataFrame:
    """(doc): the nodes of (doc_id, text) that may have a link, by the tokens of their first third."""
    first = token_rows(nodes, first_third=True)
    shared = first.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1").select("token")
    met = first.join(shared, "token", "left_semi").groupBy("doc", "n").agg(F.count("*").alias("k"))
    return checkpointed(met.filter(F.col("k") >= least_shared(F.col("n"))).select("doc"))


def ordered_sets(nodes: DataFrame) -> DataFrame:
    """(doc, n, tokens, least, l) of the nodes that share enough tokens for a link: the tokens that other nodes
    have too, rarest first (those that no other has come before them and only count), how many of these are in
    the least prefix, and l."""
    rows = token_rows(nodes)
    df = rows.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1")
    sets = rows.join(df, "token").groupBy("doc", "n").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("x"))
    sets = sets.filter(f"size(x) >= {LEAST}").withColumn("least", F.expr(f"CAST(size(x) - {LEAST} + 1 AS INT)"))
    cost = F.aggregate(F.slice("x", F.lit(1), F.col("least")), F.lit(0.0), lambda a, x: a + x["df"])
    extra = F.least(F.lit(MAX_EXTRA), F.size("x") - F.col("least"), F.floor(F.log2(1 + cost / COSTLY)))
    return sets.select("doc", "n", F.col("x.token").alias("tokens"), "least", (extra + 1).alias("l"))


def only(docs: DataFrame, ids: DataFrame, how: str, key: str = "doc_id") -> DataFrame:
    """``docs`` with (left_semi) or without (left_anti) the ids of a one-column table: broadcast if it is
    proven small, else joined by a shuffle."""
    number = ids.dtypes[0][1] in ("bigint", "int", "smallint", "tinyint")
    right = F.broadcast(ids) if number and small_enough(ids, MAX_BROADCAST_IDS) else ids
    return docs.join(right, docs[key] == right[right.columns[0]], how)


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that share l prefix tokens and whose sets reach the threshold. All that two sets have
    in common is in ``tokens``."""
    prefix = "slice({0}.tokens, 1, CAST({0}.least + {0}.l - 1 AS INT))"
    enough = f"size(array_intersect({prefix.format('sa')}, {prefix.format('sb')})) >= least(sa.l, sb.l)"
    common = "size(array_intersect(sa.tokens, sb.tokens))"
    met = pairs.join(sets.alias("sa"), F.expr("a = sa.doc")).join(sets.alias("sb"), F.expr("b = sb.doc"))
    return checkpointed(met.filter(f"{enough} AND {common} * {DEN} >= (sa.n + sb.n - {common}) * {NUM}").select("a", "b"))


def fingerprinted_sets(docs: DataFrame) -> DataFrame:
    """(n, f1, f2, tokens) of each text with shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in in_parts(batches):
            for _, tokens, at in shingle_sets(part.column(0)):
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(tokens.view(np.int64)))
                rows = pa.RecordBatch.from_arrays([pa.array(np.diff(at)), *map(pa.array, fingerprints(tokens, at)), lists], names=["n", "f1", "f2", "tokens"])
                yield rows.filter(pa.array(np.diff(at) > 0))

    return docs.select("text").mapInArrow(run, "n bigint, f1 bigint, f2 bigint, tokens array<bigint>")


def linked(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Which sets of ``left`` (rows) and ``right`` (columns) reach the threshold."""
    both = left + right
    sizes = np.array([len(s) for s in both])
    _, column, count = np.unique(np.concatenate(both), return_inverse=True, return_counts=True)
    row, shared = np.repeat(np.arange(len(both)), sizes), count[column] > 1  # a token of one set is common to none
    row, column = row[shared], np.unique(column[shared], return_inverse=True)[1]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common = np.zeros((len(left), len(right)), np.float32)
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, BLOCK_COLUMNS):
        at = slice(*np.searchsorted(column, [lo, lo + BLOCK_COLUMNS]))
        has = np.zeros((len(both), BLOCK_COLUMNS), np.float32)
        has[row[at], column[at] - lo] = 1
        common += has[: len(left)] @ has[len(left) :].T
    common = common.astype(np.int64)
    union = sizes[: len(left), None] + sizes[None, len(left) :] - common
    return common * DEN >= union * NUM


def link_counts(groups: DataFrame, labels: DataFrame, docs: DataFrame) -> DataFrame:
    """(n, f1, f2, others): for each set with a link to a different set, the rows of ``docs`` that hold such a set.

    The sets of a class are dealt to blocks by hash, and each pair of blocks is compared in a row group of
    its own, so a big class is many small tasks. A class of m sets takes m^2 / 2 comparisons, as many as it
    may have links, but no pair is listed."""
    members = groups.join(labels, groups.rep == labels.node, "left").select("n", "f1", "f2", "rep", "copies", F.coalesce("label", "rep").alias("class"))
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum("n") / BLOCK_TOKENS))
    classes = members.groupBy("class").agg(F.count("*").alias("k"), blocks.alias("blocks")).filter("k > 1").drop("k")
    members = checkpointed(members.join(classes, "class").withColumn("block", F.pmod(F.xxhash64("f1", "f2"), "blocks")))
    sets = stored(fingerprinted_sets(only(docs, checkpointed(members.select("rep").distinct()), "left_semi")).dropDuplicates(["n", "f1", "f2"]), "link-sets")
    met = members.join(sets, ["n", "f1", "f2"]).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    key = F.concat_ws("/", F.least("block", "other"), F.greatest("block", "other"), "class")
    met = met.select(key.alias("key"), (F.col("block") > F.col("other")).alias("second"), (F.col("block") == F.col("other")).alias("own"), "n", "f1", "f2", "copies", "tokens")

    def compare(t: pa.Table) -> pa.RecordBatch:
        sets = [x.values.to_numpy().view(np.uint64) for x in t.column("tokens").combine_chunks()]
        copies, second = t.column("copies").to_numpy(), t.column("second").to_numpy()
        if t.column("own")[0].as_py():
            found = linked(sets, sets)
            np.fill_diagonal(found, False)
            others = found @ copies
        else:
            a, b = np.flatnonzero(~second), np.flatnonzero(second)
            others = np.zeros(len(sets), np.int64)
            if len(a) and len(b):
                found = linked([sets[i] for i in a], [sets[i] for i in b])
                others[a], others[b] = found @ copies[b], found.T @ copies[a]
        return pa.RecordBatch.from_arrays([*(t.column(c).combine_chunks() for c in ("n", "f1", "f2")), pa.array(others, pa.int64())], names=["n", "f1", "f2", "others"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in in_parts(batches):
            keys = np.array(b.column(0).to_pylist(), object)
            if held and len(keys) and held[-1].column(0)[0].as_py() != keys[0]:
                yield compare(pa.Table.from_batches(held))
                held.clear()
            edges = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1), len(keys)]
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                if hi > lo:
                    held.append(b.slice(lo, hi - lo))
                if hi < len(keys):
                    yield compare(pa.Table.from_batches(held))
                    held.clear()
        if held:
            yield compare(pa.Table.from_batches(held))

    sums = met.repartition("key").sortWithinPartitions("key").mapInArrow(run, "n bigint, f1 bigint, f2 bigint, others bigint")
    counts = checkpointed(sums.groupBy("n", "f1", "f2").agg(F.sum("others").alias("others")).filter("others > 0"))
    drop_stored(sets)
    return counts


def near_duplicates(docs: DataFrame, text: str = "text", id_col: str = "doc_id", count_links: bool = True) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id and, with ``count_links``, n_links: how
    many other rows with an id have shingles that reach the threshold with this row's, exact copies among
    them; 0 for rows without an id.

    Null and empty texts, and texts without words, have no shingles and are their own class. Rows with
    shingles that share an id share a class. Rows with a null id are in no class (null). Other columns are ignored."""
    slim = docs.select(F.col(id_col).alias("doc_id"), whole_text(text).alias("text"))
    known_ids = slim.filter("doc_id IS NOT NULL")
    sized = stored(survey(slim), "join-survey")
    groups = stored(sized.filter("n > 0 AND doc_id IS NOT NULL").groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "join-groups")
    copies = sized.join(groups.filter("copies > 1"), ["n", "f1", "f2"]).filter("doc_id <> rep").select("doc_id").distinct()
    repeated = checkpointed(sized.filter("n > 0 AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("k")).filter("k > 1").select("doc_id"))
    same_id = None
    if not repeated.isEmpty():  # rows that share an id are one node, whatever their texts
        copies = copies.join(repeated, "doc_id", "left_anti")
        reps = sized.join(repeated, "doc_id").join(groups, ["n", "f1", "f2"]).select("doc_id", "rep")
        same_id = checkpointed(reps.select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).filter("a <> b").distinct())
    nodes = only(known_ids, checkpointed(copies), "left_anti")

    sets = stored(ordered_sets(only(nodes, candidates(nodes), "left_semi")), "join-sets")
    # sizes of linked documents differ by less than a third, so hubs are taken by size class
    size_class = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(DEN / NUM))).alias("class")
    index = sets.select("doc", "n", "least", size_class, F.posexplode(F.slice("tokens", F.lit(1), F.col("least"))).alias("at", "token"))
    # rest: the tokens of the document from this one on; all before the listed ones are no other document's
    index = stored(index.select("token", "class", "doc", "n", F.expr(f"{LEAST} + least - 1 - at").alias("rest")), "join-index")
    # hubs are combined before their shuffle and joined back, so a hot token is no hot task
    hubs = index.groupBy("token", "class").agg(F.min(F.struct("doc", "n", "rest")).alias("hub"), F.count("*").alias("k")).filter("k > 1").drop("k")
    stars = index.join(hubs, ["token", "class"]).filter("doc <> hub.doc")
    stars = stars.select(F.col("hub.doc").alias("a"), F.col("doc").alias("b"), F.col("hub.n").alias("na"), F.col("n").alias("nb"), F.col("hub.rest").alias("ra"), F.col("rest").alias("rb"))
    first = verified(checkpointed(stars.filter(f"{LIKE_SIZES} AND {MAY_BE_FIRST}").select("a", "b").distinct()), sets)
    second = verified(across(index, components(first)), sets)
    links = first.unionByName(second)
    labels = components(links if same_id is None else links.unionByName(same_id))
    drop_stored(index)
    drop_stored(sets)

    classes = groups.join(labels, groups.rep == labels.node, "left").select("n", "f1", "f2", F.coalesce("label", "rep").alias("class"), (F.col("copies") - 1).alias("n_links"))
    if count_links:
        classes = classes.join(link_counts(groups, labels, known_ids), ["n", "f1", "f2"], "left")
        classes = classes.withColumn("n_links", F.col("n_links") + F.coalesce("others", F.lit(0))).drop("others")
    classes = stored(classes, "join-classes")
    own = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.coalesce("class", "doc_id"))
    found = sized.join(classes, ["n", "f1", "f2"], "left")
    found = found.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), own).alias("component_id"), F.when(F.col("doc_id").isNull(), 0).otherwise(F.coalesce("n_links", F.lit(0))).cast("long").alias("n_links"))
    return found if count_links else found.drop("n_links")


def across(index: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs (a, b) from different classes that may share a first common token, to be verified. Classes meet
    first, token by token, by the best bound any of their documents gives; the documents of the class with
    fewer of them follow, by their own bounds against the other class, and only then those of the other. So
    the documents of one class never meet."""
    known = index.drop("class").join(labels, index.doc == labels.node, "left").select("token", "doc", "n", "rest", F.coalesce("label", "doc").alias("class"))
    per = known.groupBy("token", "class").agg(F.count("*").alias("k"), F.min("n").alias("low"), F.max("n").alias("high"), F.max("rest").alias("reach"))
    mixed = per.groupBy("token").agg(F.count("*").alias("k")).filter("k > 1").select("token")
    known = checkpointed(known.join(mixed, "token", "left_semi"))
    per = checkpointed(per.join(mixed, "token", "left_semi"))
    like = f"{{0}} * {DEN} >= {{1}} * {NUM}"
    bound = f"least({{0}}, {{1}}) >= ceil(CAST({NUM} AS DOUBLE) * ({{2}} + {{3}}) / {NUM + DEN})"
    meet = per.alias("x").join(per.alias("y"), F.expr(" AND ".join((
        "x.token = y.token AND (x.k < y.k OR x.k = y.k AND x.class < y.class) AND x.class <> y.class",
        like.format("x.high", "y.low"), like.format("y.high", "x.low"), bound.format("x.reach", "y.reach", "x.low", "y.low"),
    ))))
    meet = meet.select(F.col("x.token").alias("token"), F.col("x.class").alias("ca"), F.col("y.class").alias("cb"), *[F.col(f"y.{c}").alias(c) for c in ("low", "high", "reach")])
    side = lambda k: known.select("token", F.col("class").alias(f"c{k}"), F.col("doc").alias(k), F.col("n").alias(f"n{k}"), F.col("rest").alias(f"r{k}"))
    few = meet.join(side("a"), ["token", "ca"]).filter(" AND ".join((like.format("na", "low"), like.format("high", "na"), bound.format("ra", "reach", "na", "low"))))
    met = few.drop("low", "high", "reach").join(side("b"), ["token", "cb"]).filter(f"{LIKE_SIZES} AND {MAY_BE_FIRST}")
    return checkpointed(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), count_links=False).select("doc_id", "n_shingles", "component_id")


QUERIES = {"op8_ngram_join": op8_ngram_join}

#: All links from an inverted list of whole shingles, then reachability.
ORACLE_SQL = {
    "op8_ngram_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a) m USING (doc_id)
""",
}
