"""Near-duplicate embeddings by a pivot-permutation index.

A bounded sample of vectors, less its mean and thinned so that no two are alike, serves as pivots: vectors that share a
direction, as texts' often do, differ in what is left. Every vector, less the mean too, is described by its nearest pivots,
nearest first. Inverted lists are kept per pair of pivots, so two vectors meet exactly when they share at
least two of their first pivots; a pair is counted only in the list of its two smallest shared pivots. What meets is verified
by cosine in double precision. Lists that grow large are cut into blocks and worked on block against block.

How many of the first pivots are used is measured in each run: the links of a bounded set of vectors to all others
are found by comparing them all, and the least number is taken with which the index meets RECALL of them. Where
none does so for less work than comparing all vectors, all are compared, block against block.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm.common import Steps, table
from fieldloom.llm.components import connected_components
from fieldloom.llm.vectors import matrix, runs, same_width, usable

#: Pivots: the number, the size of the hashed sample they come from, and the cosines from which
#: a sampled vector is too like an earlier pivot: the next one where the vectors are so alike that the one
#: before leaves too few.
PIVOTS, SAMPLE, ALIKE = 256, 4096, (0.7, 0.9, 0.97, 0.99, 0.999)
#: Numbers of nearest pivots that may describe a vector, and the share of measured links that must be met.
TOPS, RECALL = (6, 8, 10, 12, 16), 0.97
#: Vectors whose links to all others are measured, the least number of links that tell, and how far above the wanted cosine the
#: links go that are measured apart, as they are the hardest to meet.
PROBES, TELLING, HARD = 256, 30, 0.02
#: Vectors in a block of an inverted list.
BLOCK = 512
#: Parts that the copies of one vector are dealt to.
SALTS = 16


def unit_rows(m: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, safely for very large and very small numbers."""
    m = m / np.maximum(np.abs(m).max(axis=1, keepdims=True), np.finfo(float).tiny)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def centred(m: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """Unit rows less ``mean``, as unit rows."""
    m, mean = same_width(m, mean)
    rest = m - mean
    return rest / np.maximum(np.linalg.norm(rest, axis=1, keepdims=True), 1e-300)


def nearest(m: np.ndarray, pivots: np.ndarray, top: int) -> np.ndarray:
    """The ``top`` pivots nearest to each row, nearest first."""
    m, pivots = same_width(m, pivots)
    return np.argsort(-(m @ pivots.T), axis=1, kind="stable")[:, :top]


def shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many pivots the rows of ``a`` and ``b`` share, row by row."""
    out = np.empty(len(a), np.int64)
    for i in range(0, len(a), 16384):
        out[i : i + 16384] = (a[i : i + 16384, :, None] == b[i : i + 16384, None, :]).any(axis=2).sum(axis=1)
    return out


def _met(a: np.ndarray, b: np.ndarray, tops: list[int]) -> list[int]:
    """How many of the pairs (row of ``a``, row of ``b``) meet, by the number of pivots."""
    return [int((shared(a[:, :t], b[:, :t]) >= 2).sum()) for t in tops]


def measured_top(classes: DataFrame, sample: np.ndarray, mean: np.ndarray, pivots: np.ndarray, cosine: float, recall: float, tops: tuple[int, ...] = TOPS) -> int:
    """The least number of pivots with which the index meets ``recall`` of the links of PROBES vectors to all others, and of
    those of them that are hardest; 0 where comparing all vectors is less work. Too few links: pairs made at ``cosine`` tell."""
    tops = [t for t in tops if t <= len(pivots)]
    if not tops:
        return 0
    probes = sample[:PROBES]
    own = nearest(centred(probes, mean), pivots, tops[-1])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in range(0, b.num_rows, 2048):
                m = unit_rows(matrix(b.column("vec").slice(x, 2048).to_pylist()))
                a, q = same_width(m, probes)
                cos = a @ q.T
                i, j = np.nonzero((cos >= cosine) & (cos < 1 - 1e-12))  # not the probe itself
                t = nearest(centred(m, mean), pivots, tops[-1])
                hard = cos[i, j] < cosine + HARD
                work = [np.zeros(len(tops))]
                for k in range(0, min(len(m), 256), 64):  # a part of all pairs, for the work
                    some = np.repeat(t[k : k + 64], len(own), axis=0), np.tile(own, (len(t[k : k + 64]), 1))
                    n = [shared(some[0][:, :top], some[1][:, :top]) for top in tops]
                    work.append(np.array([float((y * (y - 1) / 2).sum()) for y in n]))
                row = [len(i), int(hard.sum()), min(len(m), 256) * len(own), *_met(t[i], own[j], tops), *_met(t[i[hard]], own[j[hard]], tops), *np.sum(work, axis=0)]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(row))), pa.array(np.array(row, np.float64))], ["at", "n"])

    got = {r["at"]: r["n"] for r in classes.select("vec").mapInArrow(count, "at long, n double").groupBy("at").agg(F.sum("n").alias("n")).collect()}
    links, hard, pairs = (got.get(i, 0.0) for i in range(3))
    k = len(tops)
    easy, tough, work = ([got.get(3 + part * k + i, 0.0) for i in range(k)] for part in range(3))
    if links < TELLING:
        aside = np.random.default_rng(7).standard_normal(probes.shape)
        aside = unit_rows(aside - (aside * probes).sum(axis=1, keepdims=True) * probes) if probes.shape[1] > 1 else aside
        made = cosine * probes + np.sqrt(max(0.0, 1 - cosine * cosine)) * aside
        links, hard, easy = float(len(probes)), 0.0, _met(own, nearest(centred(made, mean), pivots, tops[-1]), tops)
    for i, t in enumerate(tops):
        if work[i] < 0.5 * pairs and easy[i] >= recall * links and (hard < TELLING or tough[i] >= recall * hard):
            return t
    return 0


def choose_pivots(vectors: np.ndarray, wanted: int, enough: int = 24) -> np.ndarray:
    """The first vectors, in the given order, that are unlike all pivots before them."""
    chosen: list[np.ndarray] = []
    for alike in ALIKE:
        chosen = []
        for v in vectors:
            if len(chosen) == wanted:
                break
            if not chosen or float((np.array(chosen) @ v).max()) < alike:
                chosen.append(v)
        if len(chosen) >= enough:
            break
    return np.array(chosen)


def link_block(a: np.ndarray, b: np.ndarray | None, tops: tuple, weights: tuple, pivot: int, cosine: float):
    """Link counts of the rows of ``a`` (and ``b``), and pairs that span what is linked.

    With ``b`` None, pairs inside ``a``; else pairs across. Only pairs whose second smallest
    shared pivot is ``pivot`` count, so that each pair counts in one list.
    """
    other = a if b is None else b
    hit = a @ other.T >= cosine
    if b is None:
        hit = np.triu(hit, 1)
    i, j = np.nonzero(hit)
    ta, tb = tops[0], tops[0] if b is None else tops[1]
    keep = np.zeros(len(i), bool)
    for s in range(0, len(i), 65536):
        x, y = ta[i[s : s + 65536]], tb[j[s : s + 65536]]
        common = (x[:, :, None] == y[:, None, :]).any(axis=2)
        keep[s : s + 65536] = (common & (x <= pivot)).sum(axis=1) == 2
    i, j = i[keep], j[keep]
    wa, wb = weights[0], weights[0] if b is None else weights[1]
    na, nb = np.bincount(i, wb[j], len(a)), np.bincount(j, wa[i], len(other))
    return i, j, na, nb


def spanning(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """For each of ``n`` nodes the least node it reaches over the edges (i, j)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def _same(vec: str) -> list:
    """Two hashes that stand for a vector's 128 bits of identity."""
    return [F.xxhash64(vec).alias("h1"), F.xxhash64(F.lit(11), F.col(vec)).alias("h2")]


def near_duplicates(vectors: DataFrame, cosine: float = 0.9, key: str = "vec_id", vector: str = "embedding",
                    pivots: int = PIVOTS, top: int | None = None, recall: float = RECALL, exact: bool = False) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors``.

    Pairs found have cosine >= ``cosine`` in double precision. The index takes as many pivots as meet ``recall`` of the links
    measured in the run (see ``measured_top``), or ``top`` if given; with ``exact``, or where no number will do, all
    vectors are compared with all, in blocks. Vectors that are null, zero, or hold null or non-finite components link with
    nothing. Equal vectors are one node that counts its copies. Rows that repeat a key stand for one vector (the least); a null
    key has no component, no links, and is kept. Vectors of unlike lengths are filled up with zeros. An empty table gives an
    empty result.
    """
    x = usable(vectors, key, vector).where(F.exists("vec", lambda v: v != 0))
    steps = Steps(vectors.sparkSession)
    x = steps.keep(x)
    # Equal vectors: one class each, counted with partial sums.
    classes = steps.keep(x.groupBy("vec").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")))
    rows = classes.orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).select("vec").collect()  # at most SAMPLE rows
    sample = unit_rows(matrix([r[0] for r in rows])) if rows else np.zeros((0, 1))
    mean = sample.mean(axis=0, keepdims=True) if rows else np.zeros((1, 1))
    chosen = choose_pivots(centred(sample, mean), pivots)
    if exact or len(chosen) < 2:
        top = 0
    elif top is None:
        top = measured_top(classes, sample, mean, chosen, cosine, recall)
    pairs_of = list(combinations(range(min(top, len(chosen))), 2))  # none: every vector goes to one list

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            m = unit_rows(matrix(b.column("vec").to_pylist()))
            if not pairs_of:
                tops = np.tile(np.array([0, 1]), (len(m), 1))
                keys = np.ones((len(m), 1), np.int64)
            else:
                tops = np.sort(nearest(centred(m, mean), chosen, top), axis=1)
                keys = np.stack([tops[:, s] * 65536 + tops[:, t] for s, t in pairs_of], axis=1)
            tops, unit = tops.astype(np.int16), np.ascontiguousarray(m)
            yield pa.RecordBatch.from_arrays(
                [b.column("rep"), b.column("copies"), pa.array([r.tobytes() for r in unit]), pa.array([r.tobytes() for r in tops]),
                 pa.array(list(keys.astype(np.int64)), pa.list_(pa.int64()))], ["node", "copies", "unit", "tops", "keys"])

    nodes = steps.keep(classes.mapInArrow(describe, "node long, copies long, unit binary, tops binary, keys array<long>"))
    listed = nodes.select(F.explode("keys").alias("key"), "node")
    sizes = listed.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    nb = F.ceil(F.col("size") / BLOCK).cast("int")
    dealt = listed.join(sizes, "key").withColumn("nb", nb).withColumn("own", F.pmod(F.xxhash64("node"), F.col("nb")).cast("int"))
    # Each block meets itself and every other block of its list once.
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).select(
        "key", "node", "own", F.least("own", "other").alias("bi"), F.greatest("own", "other").alias("bj"))
    work = (dealt.join(nodes.select("node", "copies", "unit", "tops"), "node")
            .repartition("key", "bi", "bj").sortWithinPartitions("key", "bi", "bj", "own"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, ["key", "bi", "bj"]):
            own, bi, bj = t["own"].to_numpy(), t["bi"][0].as_py(), t["bj"][0].as_py()
            ids, copies = t["node"].to_numpy(), t["copies"].to_numpy().astype(float)
            units, tops = t["unit"].to_pylist(), t["tops"].to_pylist()
            if len(set(map(len, units))) > 1:
                m = matrix([np.frombuffer(u) for u in units])
            else:
                m = np.frombuffer(b"".join(units)).reshape(len(units), -1)
            tops = np.frombuffer(b"".join(tops), np.int16).reshape(len(units), -1)
            pivot, cut = t["key"][0].as_py() % 65536, int((own == bi).sum())
            if bi == bj:
                i, j, na, nb = link_block(m, None, (tops,), (copies,), pivot, cosine)
                n = (na + nb)
            else:
                i, j, na, nb = link_block(m[:cut], m[cut:], (tops[:cut], tops[cut:]), (copies[:cut], copies[cut:]), pivot, cosine)
                j, n = j + cut, np.concatenate([na, nb])
            if len(i):
                root = spanning(i, j, len(ids))
                some = n > 0
                yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(n[some].astype(np.int64)), pa.array(ids[root[some]])], ["node", "links", "to"])

    found = steps.keep(work.mapInArrow(verify, "node long, links long, to long"))
    steps.drop(nodes)
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    parts = connected_components(found.where("node <> to").select(F.col("node").alias("a"), F.col("to").alias("b")))
    # Components are named by their least id; a class's own least id is its node.
    known = classes.join(links, F.col("rep") == F.col("node"), "left").drop("node").join(parts, F.col("rep") == F.col("node"), "left")
    known = known.select(*_same("vec"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    # Many copies of one vector share its key, so the rows are dealt by their ids too.
    salts = F.sequence(F.lit(0), F.lit(SALTS - 1))
    keyed = x.select("id", *_same("vec"), F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int").alias("salt"))
    member = keyed.join(known.withColumn("salt", F.explode(salts)), ["h1", "h2", "salt"]).select("id", "n_links", "component_id")
    out = vectors.select(F.col(key).alias("vec_id")).join(member, F.col("vec_id").cast("long") == F.col("id"), "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                     F.coalesce("component_id", F.col("vec_id").cast("long")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


OP6_SQL = """
WITH RECURSIVE x AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len([v for v in embedding if v IS NULL OR NOT isfinite(v)]) = 0 AND len([v for v in embedding if v <> 0]) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM x a JOIN x b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT a AS node, b AS seen FROM links UNION SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.seen),
comp AS (SELECT node, min(seen) AS m FROM reach GROUP BY node),
deg AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT v.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, least(v.vec_id, coalesce(m, v.vec_id)) AS component_id,
       v.vec_id = least(v.vec_id, coalesce(m, v.vec_id)) AS kept
FROM embeddings v LEFT JOIN deg ON deg.a = v.vec_id LEFT JOIN comp ON comp.node = v.vec_id
"""
