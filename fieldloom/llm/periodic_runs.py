"""Periodic runs of words: passages that repeat with a period, found whole and collapsed to one period.

A run is a maximal stretch of words with smallest period q (words q apart are equal) and a length of at
least ``max(LEAST, 3 * q)``. Runs are found exactly:

* Periods below 2 * LEAST are scanned lag by lag over all words of a portion of texts.
* Longer ones are found by minimizers, scale by scale. At the scale of the periods P to 2 P - 1, k-grams of
  P / 2 words are hashed; those that lie inside a run of a period up to a third of their length (all of them
  known from the scales before) are left out. The minima of all windows of P / 2 k-grams are the scale's
  minimizers. What a window holds decides its minimum, so inside a run of period q a minimizer comes back q words
  later; if every k-gram of a run were left out, the run would have a smaller period. So each run of the
  scale has a pair of equal minimizers q apart, and such pairs are the seeds that are extended both ways.
  A k-gram that is not itself periodic can't come back within a third of its length, so a minimizer has at
  most a dozen partners, and a scale's work grows with the words whatever they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldloom.llm.common import portions, table

#: Words that a run has at least, besides three periods.
LEAST = 24
#: Bytes of text whose words are worked on at once.
BYTES = 2_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_NONE = np.uint64(2**64 - 1)


def stretches(equal: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """[start, end) of the maximal stretches of True that have ``least`` elements or more."""
    have = 1
    while have < least and len(equal):
        step = min(have, least - have)
        equal = equal[:-step] & equal[step:]
        have += step
    hits = np.flatnonzero(equal)
    if not len(hits):
        return hits, hits
    gaps = np.flatnonzero(np.diff(hits) > 1)
    return hits[np.concatenate([[0], gaps + 1])], hits[np.concatenate([gaps, [len(hits) - 1]])] + least


def _slide(x: np.ndarray, width: int, best) -> np.ndarray:
    """``best`` of each window of ``width`` elements."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = best(x[:-step], x[step:])
        have += step
    return x


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of each ``k`` neighbouring words; equal words in equal order give equal hashes."""
    power = np.full(len(words) + 1, _BASE)
    back = np.full(len(words) + 1, _BACK)
    power[0] = back[0] = 1
    power, back = np.multiply.accumulate(power), np.multiply.accumulate(back)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mix(words.astype(np.int64).astype(np.uint64) * _BASE) * power[:-1])])
    return _mix((sums[k:] - sums[:-k]) * back[: len(sums) - k])


def minimizers(hashes: np.ndarray, left_out: np.ndarray, width: int) -> np.ndarray:
    """Places of all minima of windows of ``width`` hashes, those ``left_out`` aside."""
    if len(hashes) < width:
        return np.zeros(0, np.int64)
    h = np.where(left_out, _NONE, hashes)
    low = _slide(h, width, np.minimum)
    pad = np.zeros(width - 1, np.uint64)
    return np.flatnonzero((_slide(np.concatenate([pad, low, pad]), width, np.maximum) == h) & ~left_out)


def _extent(words: np.ndarray, at: int, lag: int) -> tuple[int, int]:
    """The stretch around ``at`` in which every word equals the one ``lag`` later."""
    end, step = at, 256
    while end + lag < len(words):
        stop = min(end + step, len(words) - lag)
        differ = np.flatnonzero(words[end:stop] != words[end + lag : stop + lag])
        if len(differ):
            end += int(differ[0])
            break
        end, step = stop, step * 2
    start, step = at, 256
    while start > 0:
        stop = max(start - step, 0)
        differ = np.flatnonzero(words[stop:start] != words[stop + lag : start + lag])
        if len(differ):
            start = stop + int(differ[-1]) + 1
            break
        start, step = stop, step * 2
    return start, end


def _seeds(at: np.ndarray, hashes: np.ndarray, low: int, high: int) -> np.ndarray:
    """(lag, place) of the pairs of equal minimizers with a lag from ``low`` to ``high`` - 1, sorted."""
    order = np.lexsort((at, hashes[at]))
    at, h = at[order], hashes[at[order]]
    out, ahead = [np.zeros((0, 2), np.int64)], 1
    while ahead < len(at):
        lag = at[ahead:] - at[:-ahead]
        near = (h[ahead:] == h[:-ahead]) & (lag < high)
        if not near.any():
            break
        found = near & (lag >= low)
        out.append(np.stack([lag[found], at[:-ahead][found]], axis=1))
        ahead += 1
    pairs = np.concatenate(out)
    return pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]


def find_runs(words: np.ndarray, sizes: np.ndarray, least: int = LEAST) -> np.ndarray:
    """(place, length, period) of every run, by place and period.

    ``words`` holds the numbers of the words of all texts, each text followed by a number that is nowhere else;
    ``sizes`` the words of each text. Nothing equal holds such a number, so no run leaves its text.
    """
    longest = int(sizes.max(initial=0))
    found = [np.zeros((0, 3), np.int64)]
    first = 2 * least  # the first period that minimizers find: the least k-gram is as long as the shortest run
    for lag in range(1, min(first - 1, longest // 3) + 1):
        start, end = stretches(words[:-lag] == words[lag:], max(least, 3 * lag) - lag)
        if len(start):
            found.append(np.stack([start, end - start + lag, np.full(len(start), lag)], axis=1))
    period, text = first, np.repeat(np.arange(len(sizes)), sizes + 1)
    while 3 * period <= longest:
        place = np.flatnonzero((sizes >= 3 * period)[text])  # of the words of texts that can hold such a run
        w, k = words[place], period // 2
        known = np.concatenate(found)
        known = known[(3 * known[:, 2] <= k) & (known[:, 1] >= k)]
        at = np.searchsorted(place, known[:, 0])
        inside = (at < len(place)) & (place[np.minimum(at, len(place) - 1)] == known[:, 0])
        edge = np.zeros(len(w) + 1, np.int64)
        np.add.at(edge, at[inside], 1)
        np.add.at(edge, at[inside] + known[inside, 1] - k + 1, -1)
        hashes = gram_hashes(w, k)
        mins = minimizers(hashes, np.cumsum(edge)[: len(hashes)] > 0, k)
        new, lag_before, covered = [], 0, 0
        for lag, m in _seeds(mins, hashes, period, 2 * period).tolist():
            if lag == lag_before and m < covered:
                continue
            start, end = _extent(w, m, lag)
            lag_before, covered = lag, end
            if end - start >= 2 * lag:
                new.append((place[start], end - start + lag, lag))
        if new:
            found.append(np.array(new, np.int64))
        period *= 2
    runs = np.concatenate(found)
    # a stretch found at a multiple of its period has the same place and length
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    once = np.ones(len(runs), bool)
    once[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
    runs = runs[once]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def split_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The number of words of each text, and all words. Null texts have none."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    parent, flat = pc.list_parent_indices(lists).to_numpy(), lists.flatten()
    full = pc.not_equal(pc.binary_length(flat), 0)
    flat, parent = flat.filter(full), parent[full.to_numpy(zero_copy_only=False)]
    return np.bincount(parent, minlength=len(texts)).astype(np.int64), flat


def _of_texts(texts: pa.Array, least: int) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(runs of each text, (start, length, period) of all runs, collapsed texts)."""
    sizes, flat = split_words(texts)
    starts = np.cumsum(sizes) - sizes
    parent = np.repeat(np.arange(len(sizes)), sizes)
    words = np.empty(len(flat) + len(sizes), np.int64)
    words[np.arange(len(flat)) + parent] = flat.dictionary_encode().indices.to_numpy()
    words[starts + sizes + np.arange(len(sizes))] = -1 - np.arange(len(sizes))
    runs = find_runs(words, sizes, least)
    first = starts + np.arange(len(sizes))  # place of each text's first word
    text = np.searchsorted(first, runs[:, 0], side="right") - 1
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    kept = (np.cumsum(edge)[:-1] == 0)[np.arange(len(flat)) + parent]
    runs[:, 0] -= first[text]
    offsets = np.concatenate([[0], np.cumsum(np.bincount(parent[kept], minlength=len(sizes)))]).astype(np.int32)
    flat = flat if kept.all() else flat.filter(pa.array(kept))
    collapsed = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), flat), " ")
    return np.bincount(text, minlength=len(sizes)), runs, collapsed


_RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])


def collapse_runs(docs: DataFrame, text: str = "text", least: int = LEAST, runs: str = "runs", collapsed: str = "collapsed") -> DataFrame:
    """Columns of ``docs``, ``runs`` (array of start, length, period, by start and period; starts are word numbers from 0)
    and ``collapsed`` (the words that no run holds after its first period, with single blanks).

    Words are runs of characters other than blank, tab and line ends. Null and empty texts have no runs and
    collapse to the empty text. Texts are treated whole whatever their length, repeated rows alike; columns of ``docs`` named like
    the new ones are replaced. An empty table gives an empty result. Nothing is shuffled.
    """
    docs = docs.drop(runs, collapsed)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in portions(batches, text, BYTES):
            counts, found, texts = _of_texts(b.column(text), least)
            structs = pa.StructArray.from_arrays([pa.array(found[:, i]) for i in range(3)], ["start", "length", "period"])
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), structs)
            yield pa.RecordBatch.from_arrays([*b.columns, lists, texts], [*b.schema.names, runs, collapsed])

    added = [T.StructField(runs, T.ArrayType(_RUN)), T.StructField(collapsed, T.StringType())]
    return docs.mapInArrow(work, T.StructType([*docs.schema.fields, *added]))


def strongest(runs: str) -> "F.Column":
    """The run with the greatest exact length / period; ties: the smallest start, then period. Null without runs."""
    return F.aggregate(runs, F.get(runs, F.lit(0)), lambda a, r: F.when(r["length"] * a["period"] > a["length"] * r["period"], r).otherwise(a))


def planted(docs: DataFrame) -> DataFrame:
    """``doc_id, text``: the texts as the query takes them. Of every tenth document by a hash of its id, words from one
    place on repeat with a period; the words then stand with single blanks."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    chosen = docs.select("doc_id", "text", h.alias("h")).withColumn("words", F.when(F.col("h") % 10 == 0, words))
    g, n = F.floor(F.col("h") / 10), F.size("words")
    a = F.pmod(g, n).cast("int")
    spaced = chosen.withColumn("a", F.when(n > 0, a)).withColumn("p", F.when(n > 0, (1 + F.floor((n - F.col("a")) / (3 + g % 8))).cast("int")))
    moved = F.array_join(F.transform("words", lambda w, i: F.when(i < F.col("a"), w).otherwise(F.get("words", F.col("a") + F.pmod(i - F.col("a"), F.col("p"))))), " ")
    return spaced.select("doc_id", F.when(F.col("a").isNotNull(), moved).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = collapse_runs(planted(table(spark, sf_dir, "documents")).select("doc_id", "text"))
    line = F.concat_ws("", F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))))
    out = out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), strongest("runs").alias("best"),
                     F.sha2(line, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return out.select("doc_id", "n_runs", "best.start", "best.length", "best.period",
                      F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
