"""Substring dedup by hashing lines, paragraphs or the sentences of lines.

Every text is cut into units, each unit is normalised and hashed, and of equal units in the whole
corpus the first by (rank of document, position) stays. The others are repeats; a run of
neighbouring repeats that is long enough is removed. What stays is returned with its offsets in
the original text.

The default unit is a line cut again at its sentence ends: a passage that many documents share
seldom fills lines of its own, so whole lines miss most of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm.common import portions, table

#: A unit ends after one of these.
ENDS = {"line": ("\n",), "paragraph": ("\n\n",), "sentence": ("\n", ". ", "! ", "? ", "。", "！", "？")}
#: Put after each end to split there; in a text it counts as a blank.
CUT = "\x01"
#: White space and punctuation that do not count in normalising.
SPACE = " \t\n\x0b\f\r"
MARKS = ".,;:!?\"'()[]{}"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of a run of repeats from which it is removed: half of a passage of 50 words, as the first and
#: the last sentence of a passage often run into their neighbours.
MIN_WORDS = 25
#: Characters that count as a word where there are fewer blanks.
WORD_CHARS = 12
_WORDS = str.maketrans(dict.fromkeys(MARKS) | {c: " " for c in SPACE})


def split_units(text, unit: str) -> "F.Column":
    """The units of a text, each with its end, as an array."""
    text = F.translate(text, CUT, " ")
    for end in ENDS[unit]:
        text = F.replace(text, F.lit(end), F.lit(end + CUT))
    return F.split(text, CUT, -1)


def normalise(unit) -> "F.Column":
    """Lower-case A-Z, without white space and common punctuation."""
    return F.translate(unit, UPPER + MARKS + SPACE, LOWER)


def _units(text: str, unit: str) -> list[str]:
    text = text.replace(CUT, " ")
    for end in ENDS[unit]:
        text = text.replace(end, end + CUT)
    return text.split(CUT)


def _size(unit: str) -> int:
    """Words of a unit, or one for WORD_CHARS characters if that is more; 0 for a blank unit."""
    words = [w for w in unit.translate(_WORDS).split(" ") if w]
    return max(len(words), (sum(map(len, words)) + len(words) - 1) // WORD_CHARS) if words else 0


def kept_spans(text: str, firsts: set[int], unit: str, min_words: int) -> tuple[list[list[int]], int, int]:
    """([start, end) of the kept runs, number of units, number removed) of one text."""
    units = _units(text, unit)
    gone: set[int] = set()
    run: list[int] = []
    words = 0
    for i, u in enumerate([*units, None]):
        if u is None or i in firsts:
            if words >= min_words:
                gone.update(run)
            run, words = [], 0
        elif n := _size(u):
            run.append(i)
            words += n
    spans, at = [], 0
    for i, u in enumerate(units):
        end = at + len(u)
        if i not in gone and u:
            if spans and spans[-1][1] == at:
                spans[-1][1] = end
            else:
                spans.append([at, end])
        at = end
    return spans, len(units), len(gone)


def dedup_units(docs: DataFrame, unit: str = "sentence", min_words: int = MIN_WORDS, key: str = "doc_id", text: str = "text",
                rank: str | None = None) -> DataFrame:
    """One row per row of ``docs``: ``key``, ``text`` (what stays), ``spans``, ``n_units``, ``n_removed``.

    ``spans`` is an array of [start, end) code-point offsets of the kept runs in the original
    text, in order, neighbours merged; the kept text is those runs put together. A unit
    takes its end (line break, full stop) along. A repeat is removed when the run of neighbouring
    repeats in which it stands has at least ``min_words`` words (1: every repeat); blank units do not
    break a run and stay. Documents rank by ``rank`` (default: ``key``; nulls first), ties by key, then by a hash of
    the text, then by position.

    Null text: null result without units. Empty text: one unit, kept. Null keys rank first.
    Rows equal in rank, key and text count as one document and get the same result. Other
    columns do not matter. An empty table gives an empty result.

    The digests are grouped with partial aggregation (only the least place is carried, so a
    unit that fills a third of the corpus costs one row per task), and what goes back to the
    documents is keyed by document. No join is made on a digest.
    """
    names = ["_key", "_row"] if rank is None else ["_rank", "_key", "_row"]
    base = docs.select(*([F.col(rank).alias("_rank")] if rank else []), F.col(key).alias("_key"),
                       F.xxhash64(text).alias("_row"), F.col(text).alias("_text"))
    norm = (base.select(*names, F.posexplode(F.transform(split_units(F.col("_text"), unit), normalise)).alias("_pos", "_norm"))
            .where("_norm <> ''"))
    first = (norm.groupBy(F.xxhash64("_norm").alias("_h1"), F.xxhash64(F.lit(41), F.col("_norm")).alias("_h2"))
             .agg(F.min(F.struct(*names, "_pos")).alias("_first")))
    kept = first.select("_first.*").groupBy(*names).agg(F.collect_list("_pos").alias("_kept"))
    kept = kept.toDF(*[f"k{c}" for c in kept.columns])
    same = F.lit(True)
    for c in names:
        same = same & F.col(c).eqNullSafe(F.col(f"k{c}"))
    joined = base.join(kept, same, "left").select(F.col("_key").alias(key), F.col("_text").alias("text"), F.col("k_kept").alias("_kept"))

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for b in portions(batches, "text"):
            rows = []
            for whole, firsts in zip(b.column("text").to_pylist(), b.column("_kept").to_pylist(), strict=True):
                if whole is None:
                    rows.append((None, None, 0, 0))
                    continue
                spans, n, removed = kept_spans(whole, set(firsts or ()), unit, min_words)
                rows.append(("".join(whole[x:y] for x, y in spans), [{"start": x, "end": y} for x, y in spans], n, removed))
            texts, spans, n, removed = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(texts, pa.string()), pa.array(spans, spans_type), pa.array(n, pa.int64()), pa.array(removed, pa.int64())],
                                             [key, "text", "spans", "n_units", "n_removed"])

    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, text string, spans array<struct<start:int,end:int>>, n_units long, n_removed long"
    return joined.mapInArrow(rebuild, schema)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_units(table(spark, sf_dir, "documents"))
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ";")
    return out.select("doc_id", "text", spans.alias("spans"), "n_units", "n_removed")


_CUT_SQL = "replace(text, chr(1), ' ')"
for _end in ("chr(10)", "'. '", "'! '", "'? '", "'。'", "'！'", "'？'"):
    _CUT_SQL = f"replace({_CUT_SQL}, {_end}, {_end} || chr(1))"
OP10_SQL = f"""
WITH cut AS (SELECT doc_id, text, string_split({_CUT_SQL}, chr(1)) AS us FROM documents WHERE text IS NOT NULL),
units AS (SELECT doc_id, unnest(us) AS u, generate_subscripts(us, 1) AS i FROM cut),
norm AS (
  SELECT *, translate(u, '{UPPER}.,;:!?"''()[]{{}} ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '{LOWER}') AS bare,
         trim(regexp_replace(translate(u, '.,;:!?"''()[]{{}}', ''), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) AS worded FROM units),
flagged AS (
  SELECT *, bare <> '' AS counts, bare <> '' AND row_number() OVER (PARTITION BY bare ORDER BY doc_id, i) > 1 AS again,
         greatest(length(worded) - length(replace(worded, ' ', '')) + 1, length(worded) // {WORD_CHARS}) AS size FROM norm),
isles0 AS (
  SELECT *, sum(CASE WHEN counts AND NOT again THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM flagged),
kept AS (
  SELECT *, NOT (again AND sum(CASE WHEN again THEN size ELSE 0 END) OVER (PARTITION BY doc_id, run) >= {MIN_WORDS}) AS keep FROM isles0),
placed AS (
  SELECT *, coalesce(sum(length(u)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM kept),
isles AS (
  SELECT *, a + length(u) AS b, sum(CASE WHEN keep THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS isle FROM placed),
runs AS (
  SELECT doc_id, isle, min(a) AS a, max(b) AS b FROM isles WHERE keep GROUP BY doc_id, isle HAVING max(b) > min(a)),
joined AS (
  SELECT r.doc_id, string_agg(CAST(a AS BIGINT) || '-' || CAST(b AS BIGINT), ';' ORDER BY a) AS spans,
         string_agg(substr(text, CAST(a AS BIGINT) + 1, CAST(b - a AS BIGINT)), '' ORDER BY a) AS text
  FROM runs r JOIN documents d ON r.doc_id = d.doc_id GROUP BY r.doc_id),
counts AS (SELECT doc_id, count(*) AS n_units, count(*) FILTER (NOT keep) AS n_removed FROM kept GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(j.text, '') END AS text,
       CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(j.spans, '') END AS spans,
       coalesce(n_units, 0) AS n_units, coalesce(n_removed, 0) AS n_removed
FROM documents d LEFT JOIN joined j ON d.doc_id = j.doc_id LEFT JOIN counts c ON d.doc_id = c.doc_id
"""
