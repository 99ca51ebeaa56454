"""Near-duplicate documents by MinHash and a multi-index Hamming join.

A document's signature is K = CHUNKS * CHUNK symbols of 16 bits (b-bit minwise hashing). The
signature distance of two documents is the number of differing symbols. The signature is cut
into CHUNKS chunks; when two signatures differ in at most THRESHOLD = 2 * CHUNKS - 1 symbols, by
the pigeonhole principle some chunk differs in at most one. Every chunk is listed once per
allowed error place, with that symbol left out, and equal keys meet: all pairs within the
threshold are found. Pairs are then confirmed on the full shingle sets.

At similarity 0.8 a symbol differs with probability 0.2, and a pair exceeds the threshold (28 of
56 symbols) with probability below 1e-6.

Large groups of copies cost little more than their size: documents with equal sets are one
node; of each list first only the pairs with its medoid and with the nearest signatures are
confirmed; after that only pairs whose ends are still in different components. For that, lists
that share nodes and are large are put together, so a group that fills many lists is worked on
once, block against block of sets of like size, and its nodes get a signature of LONG symbols that leaves few pairs
to confirm (at similarity 0.8, LONG_THRESHOLD is passed with a probability of about 1e-7).

Texts are large beside all else, so before they are shuffled a bitmap leaves out most that no
pair needs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldloom.llm.common import Steps, portions, table
from fieldloom.llm.components import connected_components, joined_components
from fieldloom.llm.shingles import minhash, set_digest, shingle_set
from fieldloom.llm.vectors import runs

CHUNKS, CHUNK = 14, 4
K = CHUNKS * CHUNK
THRESHOLD = 2 * CHUNKS - 1
#: Nodes of one list that are worked on together; larger lists are cut into blocks.
BLOCK = 512
#: Lists with more nodes are put together after the first pass.
LARGE = 48
#: Symbols (of 8 bits) of the long signature, and the most that may differ.
LONG, LONG_THRESHOLD = 2048, 504
#: Nodes of one block where nodes have long signatures; where that makes more than FEW blocks, blocks are up to WIDER times as large,
#: as each node is sent to every block that it is compared with.
WIDE, FEW, WIDER = 2048, 8, 4
#: Bits of the bitmap that tells which texts are needed: half a million longs at most, whatever the input's size.
BITS = 1 << 25
#: Nearest signatures of each node that are tried first.
NEAREST = 2
#: Keys that at least HOT of about HOT_SAMPLE nodes share are dealt over SALTS partitions.
HOT_SAMPLE, HOT, SALTS = 20_000, 16, 64


def sketch(docs: DataFrame, width: int) -> DataFrame:
    """``doc_id, n, d1, d2, sig``: set size, set digests and signature of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in portions(batches, "text"):
            rows = []
            for text in b.column("text").to_pylist():
                s = shingle_set(text, width)
                rows.append((len(s), *set_digest(s), minhash(s, K).tobytes() if len(s) else None))
            n, d1, d2, sig = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(sig, pa.binary())],
                                             ["doc_id", "n", "d1", "d2", "sig"])

    return docs.mapInArrow(run, "doc_id long, n long, d1 long, d2 long, sig binary")


def among(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """The rows whose key is among ``ids`` (one column), without a shuffle. Some others stay: those whose key hashes to an id's bit."""
    def bit(c: str) -> "F.Column":
        return F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(BITS)).cast("int")

    at = ids.select(bit(ids.columns[0]).alias("_at"))
    words = at.groupBy(F.shiftright("_at", 6).alias("_word")).agg(F.bit_or(F.expr("shiftleft(1L, _at & 63)")).alias("_bits"))
    marked = df.withColumn("_at", bit(key)).withColumn("_word", F.shiftright("_at", 6)).join(F.broadcast(words), "_word")
    return marked.where("(_bits & shiftleft(1L, _at & 63)) <> 0").select(*df.columns)


def listed(nodes: DataFrame) -> DataFrame:
    """``key, node``: one key for every chunk and place of an allowed error. The last six bits of a
    key are its place, the rest is a hash of the other symbols."""
    keys = []
    for c in range(CHUNKS):
        for gap in range(CHUNK):
            symbols = [F.expr(f"substring(sig, {2 * (c * CHUNK + i) + 1}, 2)") for i in range(CHUNK) if i != gap]
            keys.append(F.shiftleft(F.xxhash64(*symbols), 6).bitwiseOR(F.lit(c * CHUNK + gap).cast("long")))
    return nodes.select(F.explode(F.array(*keys)).alias("key"), F.col("doc_id").alias("node"))


def lists(nodes: DataFrame) -> DataFrame:
    """``key, node, salt, size, first``: the members of lists of two or more nodes, with the number of
    nodes and the least node of the list (of the list's share of the salt, where that is not -1).

    The keys are shuffled once and counted in a window. A key that so many nodes share that it would
    fill a task is dealt over SALTS partitions: such keys are told from a sample of about HOT_SAMPLE
    nodes, of which they hold at least HOT; there are at most K * HOT_SAMPLE / HOT of them, whatever
    the input's size. The sample decides only how rows are dealt.
    """
    n = nodes.count()
    sample = nodes.where(F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(max(1, n // HOT_SAMPLE))) == 0)
    hot = listed(sample).groupBy("key").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= HOT).select("key", F.lit(SALTS).alias("salts"))
    dealt = listed(nodes).join(F.broadcast(hot), "key", "left")
    dealt = dealt.select("key", "node", F.coalesce(F.pmod(F.xxhash64("node"), "salts"), F.lit(-1)).cast("int").alias("salt"))
    part = Window.partitionBy("key", "salt")
    return (dealt.withColumn("size", F.count(F.lit(1)).over(part)).withColumn("first", F.min("node").over(part))
            .where("size > 1 or salt >= 0"))


def unsalted(members: DataFrame) -> DataFrame:
    """``key, place, node, size, nb, first`` of whole lists, with the number of blocks of BLOCK nodes."""
    whole = members.where("salt >= 0").groupBy("key").agg(F.count(F.lit(1)).alias("_size"), F.min("node").alias("_first"))
    size = F.coalesce("_size", "size")
    # As many rows as there are hot keys, see lists().
    return members.join(F.broadcast(whole), "key", "left").select(
        "key", F.col("key").bitwiseAND(F.lit(63)).cast("int").alias("place"), "node", size.alias("size"),
        F.ceil(size / BLOCK).cast("int").alias("nb"), F.coalesce("_first", "first").alias("first"))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Signature distances of all rows of ``a`` and ``b``."""
    out = np.empty((len(a), len(b)), np.uint8)
    step = max(1, 65536 // max(1, len(b)))
    for i in range(0, len(a), step):
        out[i : i + step] = (a[i : i + step, None, :] != b).sum(axis=2)
    return out


def own_place(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The first place at which each row's pair of signatures has equal keys: where it counts."""
    same = (a == b).reshape(-1, CHUNKS, CHUNK)
    chunk = (same.sum(axis=2) >= CHUNK - 1).argmax(axis=1)
    at = same[np.arange(len(a)), chunk]
    return chunk * CHUNK + np.where(at.all(axis=1), 0, at.argmin(axis=1))


def apart(s: np.ndarray, part: np.ndarray, cut: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of signatures within the threshold whose parts differ: of the first ``cut`` with the others or, where that is 0,
    of all with all. A stripe of WIDE * WIDE pairs is held at once."""
    step = max(1, WIDE * WIDE // (len(s) - cut))
    for r in range(0, cut or len(s), step):
        rows = slice(r, min(r + step, cut or len(s)))
        other = part[rows, None] != part[cut:]
        if not cut:
            other = np.triu(other, r + 1)
        if other.any():
            i, j = np.nonzero(other & (distances(s[rows], s[cut:]) <= THRESHOLD))
            yield i + r, j + cut


def block_pairs(work: DataFrame, first: bool, percent: int = 0) -> DataFrame:
    """Pairs (a, b) within the threshold, from block against block of a list or group.

    ``work`` has ``key, place, node, bi, bj, own, part, sig`` and perhaps ``n, long``. A pair is given from its
    own place only (groups have place -1 and give all of theirs). ``first``: pairs with the
    block's medoid and of nearest signatures; else all pairs whose parts differ and, where there
    are long signatures, that are near by those and whose set sizes allow ``percent`` similarity.
    """
    work = work.select([c for c in ("key", "place", "node", "bi", "bj", "own", "part", "n", "sig", "long") if c in work.columns])
    work = work.repartition("key", "bi", "bj").sortWithinPartitions("key", "bi", "bj", "own", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, ["key", "bi", "bj"]):
            ids, place, bi, bj = t["node"].to_numpy(), t["place"][0].as_py(), t["bi"][0].as_py(), t["bj"][0].as_py()
            s = np.frombuffer(b"".join(t["sig"].to_pylist()), np.uint16).reshape(-1, K)
            long = np.frombuffer(b"".join(t["long"].to_pylist()), np.uint8).reshape(-1, LONG) if "long" in t.column_names else None
            n = t["n"].to_numpy() if long is not None else None
            cut = int((t["own"].to_numpy() == bi).sum()) if bi != bj else 0
            if bi != bj and cut in (0, len(ids)):
                continue  # the other block is empty
            if first:
                d = distances(s[:cut], s[cut:]) if cut else distances(s, s)
                medoid = int(d.sum(axis=1, dtype=np.int64).argmin())
                np.fill_diagonal(d, 255)
                near = np.argpartition(d, NEAREST - 1, axis=1)[:, :NEAREST] if len(ids) > NEAREST else d.argmin(axis=1)[:, None]
                i = np.concatenate([np.full(len(ids), medoid), np.repeat(np.arange(len(ids)), near.shape[1])])
                j = np.concatenate([np.arange(len(ids)), near.ravel()])
                ok = d[i, j] <= THRESHOLD
                found = [(i[ok], j[ok])]
            else:
                found = apart(s, t["part"].to_numpy(), cut)
            for i, j in found:
                for x in range(0, len(i), 8192):
                    u, v = i[x : x + 8192], j[x : x + 8192]
                    if place >= 0:
                        mine = own_place(s[u], s[v]) == place
                        u, v = u[mine], v[mine]
                    if long is not None:
                        like = np.minimum(n[u], n[v]) * 100 >= percent * np.maximum(n[u], n[v])
                        u, v = u[like], v[like]
                        like = (long[u] != long[v]).sum(axis=1) <= LONG_THRESHOLD
                        u, v = u[like], v[like]
                    u, v = ids[u], ids[v]
                    if len(u):
                        both = np.unique(np.stack([np.minimum(u, v), np.maximum(u, v)], axis=1), axis=0)
                        yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])

    return work.mapInArrow(run, "a long, b long")


def in_blocks(members: DataFrame, grid: bool) -> DataFrame:
    """Adds ``own, bi, bj`` for ``nb`` blocks: each block by itself, or (``grid``) with every other too."""
    own = members.withColumn("own", F.pmod(F.xxhash64("node"), F.col("nb")).cast("int"))
    if not grid:
        return own.withColumn("bi", F.col("own")).withColumn("bj", F.col("own"))
    at = own.withColumn("_at", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    return at.withColumn("bi", F.least("own", "_at")).withColumn("bj", F.greatest("own", "_at")).drop("_at")


def in_size_blocks(members: DataFrame, percent: int) -> DataFrame:
    """Adds ``own, bi, bj`` for blocks of sets (``n``) of like size: each block by itself and with those whose sets can be ``percent`` similar.

    Sizes are cut into classes, each 100 / percent times as large as the last. Of two sets that are ``percent`` similar the larger is
    at most so many times as large, so their classes are one or neighbours (the margin is for rounding). Other pairs of blocks are not made.
    """
    share = min(max(percent, 1), 99) / 100
    members = members.withColumn("_class", F.floor(F.log("n") * F.lit((1 - 1e-9) / -math.log(share))).cast("int"))
    count = F.count(F.lit(1))
    blocks = F.when(count <= FEW * WIDE, F.ceil(count / WIDE)).otherwise(F.greatest(F.lit(FEW), F.ceil(count / (WIDER * WIDE))))
    classes = members.groupBy("key", "_class").agg(blocks.cast("int").alias("_blocks"))
    classes = classes.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("_class", "_blocks"))).alias("_of"))  # a row for each class, a hundred at most

    def ids(step: int) -> "F.Column":
        there = F.try_element_at("_of", F.col("_class") + step)
        return F.when(there.isNotNull(), F.transform(F.sequence(F.lit(0), there - 1), lambda x: (F.col("_class") + step) * 65536 + x)).otherwise(F.array().cast("array<int>"))

    own = members.join(classes, "key").withColumn("own", F.col("_class") * 65536 + F.pmod(F.xxhash64("node"), F.try_element_at("_of", "_class")).cast("int"))
    at = own.withColumn("_at", F.explode(F.concat(ids(-1), ids(0), ids(1))))
    return at.withColumn("bi", F.least("own", "_at")).withColumn("bj", F.greatest("own", "_at")).drop("_at", "_class", "_of")


def long_sketch(docs: DataFrame, width: int) -> DataFrame:
    """``node, n, long``: set size and long signature of every document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in portions(batches, "text"):
            sets = [shingle_set(t, width) for t in b.column("text").to_pylist()]
            for i in range(0, len(sets), 512):
                long = [minhash(s, LONG).astype(np.uint8).tobytes() for s in sets[i : i + 512]]
                n = [len(s) for s in sets[i : i + 512]]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, len(n)), pa.array(n, pa.int64()), pa.array(long, pa.binary())], ["node", "n", "long"])

    return docs.mapInArrow(run, "node long, n long, long binary")


def within_threshold(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Those (a, b) whose signatures differ in at most THRESHOLD symbols."""
    sig = nodes.select(F.col("doc_id").alias("_id"), "sig")
    joined = (pairs.join(sig.withColumnsRenamed({"_id": "a", "sig": "_sa"}), "a")
              .join(sig.withColumnsRenamed({"_id": "b", "sig": "_sb"}), "b"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            if len(x):
                left = np.frombuffer(b"".join(x["_sa"]), np.uint16).reshape(-1, K)
                right = np.frombuffer(b"".join(x["_sb"]), np.uint16).reshape(-1, K)
                yield x.loc[(left != right).sum(axis=1) <= THRESHOLD, ["a", "b"]]

    return joined.mapInPandas(run, "a long, b long")


def confirm(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Those (a, b) with 100 * |A and B| >= percent * |A or B| on the full shingle sets.

    The pairs are sorted by ``a`` inside each partition so that a document with many partners is
    hashed once per partition.
    """
    of_a, of_b = (among(texts, "doc_id", pairs.select(x)) for x in ("a", "b"))
    joined = (pairs.join(of_b.withColumnsRenamed({"doc_id": "b", "text": "_tb"}), "b")
              .join(of_a.withColumnsRenamed({"doc_id": "a", "text": "_ta"}), "a").sortWithinPartitions("a"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, left = None, None
        for x in portions(portions(batches, "_ta"), "_tb"):
            found = []
            for a, b, ta, tb in zip(*(x.column(c).to_pylist() for c in ("a", "b", "_ta", "_tb")), strict=True):
                if last != (a, ta):
                    last, left = (a, ta), shingle_set(ta, width)
                right = shingle_set(tb, width)
                if min(len(left), len(right)) * 100 >= percent * max(len(left), len(right)):
                    both = len(np.intersect1d(left, right, assume_unique=True))
                    if both * 100 >= percent * (len(left) + len(right) - both):
                        found.append((a, b))
            if found:
                a, b = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return joined.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs``.

    ``component_id`` is the smallest document reachable over links of at least ``percent`` per
    cent Jaccard similarity; ``kept`` says whether that is the document itself. Null and empty
    texts have no shingles and link with nothing. Rows that share a key are one node, linked by
    what any of them links to; rows with a null key have a null component and are kept. Other
    columns do not matter. An empty table gives an empty result.
    """
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    steps = Steps(docs.sparkSession)
    sketches = steps.keep(sketch(docs, width))
    alive = sketches.where("n > 0 and doc_id is not null")
    same = ["n", "d1", "d2"]
    classes = alive.groupBy(*same).agg(F.min("doc_id").alias("rep"))
    # A key with several rows links their classes, so each class is an edge from row to rep.
    copies = alive.select("doc_id", *same).join(classes, same).where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    copies = steps.keep(copies.distinct())
    nodes = steps.keep(alive.join(classes.select(*same, F.col("rep").alias("doc_id")), ["doc_id", *same], "left_semi")
                       .select("doc_id", "sig").dropDuplicates(["doc_id", "sig"]))
    listing = steps.keep(lists(nodes))
    # From here on only the texts of documents that share a list with another (and few others).
    texts = steps.keep(among(docs, "doc_id", listing.select("node")))
    members = unsalted(listing)
    sig = nodes.select(F.col("doc_id").alias("node"), "sig")
    start = block_pairs(in_blocks(members.where("size > 2"), False).join(sig, "node"), True)
    twos = within_threshold(members.where("size = 2 and node <> first").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct(), nodes)
    tried = steps.keep(start.union(twos).distinct())
    links = steps.keep(confirm(tried, texts, width, percent))
    parts = steps.keep(connected_components(links.union(copies)))

    # Pairs whose ends are still in different components.
    own = members.where("size > 2").join(parts, "node", "left").withColumn("part", F.coalesce("component", "node")).drop("component")
    split = own.groupBy("key").agg(F.min("part").alias("_lo"), F.max("part").alias("_hi")).where("_lo <> _hi").select("key")
    rest = steps.keep(own.join(split, "key", "left_semi"))
    few = block_pairs(in_blocks(rest.where(F.col("size") <= LARGE), True).join(sig, "node"), False)
    # A node hangs on the least of its lists' first nodes, and so do the others of these (K at most).
    firsts = rest.where(F.col("size") > LARGE).groupBy("node").agg(F.collect_set("first").alias("_firsts"))
    hubs = firsts.select(F.array_min("_firsts").alias("a"), F.explode(F.array_union(F.array("node"), F.col("_firsts"))).alias("b"))
    groups = steps.keep(connected_components(hubs))
    grouped = rest.where(F.col("size") > LARGE).select("node", "part").distinct().join(groups, "node").withColumnRenamed("component", "key")
    long = steps.keep(long_sketch(among(texts, "doc_id", groups.select("node")).join(groups.select(F.col("node").alias("doc_id")), "doc_id", "left_semi"), width))
    sized = grouped.join(long.select("node", "n").distinct(), "node").withColumn("place", F.lit(-1))
    many = block_pairs(in_size_blocks(sized, percent).join(sig, "node").join(long, ["node", "n"]), False, percent)
    cross = steps.keep(few.union(many).distinct().join(tried, ["a", "b"], "left_anti"))
    steps.drop(listing, nodes, tried, rest, groups, long)
    if not cross.isEmpty():
        found = steps.keep(confirm(cross, texts, width, percent))
        before, parts = parts, steps.keep(joined_components(parts, found))
        steps.drop(found, before)
    steps.drop(cross, links, copies, texts)

    of = parts.select(F.col("node").alias("doc_id"), "component")
    out = sketches.select("doc_id", F.col("n").alias("n_shingles")).join(of, "doc_id", "left")
    out = out.withColumn("component_id", F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=2, percent=80)


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
OP3_SQL = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
                                 ELSE [w[i] || ' ' || w[i + 1] for i in range(1, len(w))] END) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
inter AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM inter JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
reach AS (
  SELECT a AS node, b AS seen FROM links UNION SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.seen),
comp AS (SELECT node, min(seen) AS m FROM reach GROUP BY node)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id,
       d.doc_id = least(d.doc_id, coalesce(m, d.doc_id)) AS kept
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN comp ON node = d.doc_id
"""
