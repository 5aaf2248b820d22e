r"""Substring dedup: normalise units, group their digests globally, keep the earliest occurrence.

The first pass takes lines, and paragraphs of several lines, of at least
`LEAST_WORDS` words as units.  Passages that start or end inside a line, or whose
lines differ by a few words elsewhere, aren't whole units, so a second pass takes
every run of `WINDOW` words as a unit.  In both, a unit that occurs earlier, by (id,
text hash, position), in any document, the same one included, is removed; a run
that overlaps its own first occurrence is part of it and is no repeat: of a passage
of fewer words than a run, said over and over, the first run's worth stays.  What
goes is the union of both passes' words; as each points to an earlier occurrence of
itself, every removed word is still somewhere.

Units are compared with ASCII letters lower-cased and white space taken as single
spaces; removed spans are offsets of the original text in code points, from the
first to the last of removed words that stand side by side.

Of runs only those that can repeat are digested: texts are winnowed (a fingerprint
of 25 words at least every 26 words, so each run of fifty has one), fingerprints
found at one place only rule their runs out, and the rest are grouped exactly by
128-bit digests.  Documents of equal words are found first: all but the first lose
every word.

Defined results: a null text stays null and has no unit; rows with equal ids are
ranked by a hash of their texts, and only rows of equal ids and texts are one
document; a null id ranks last; columns other than id and text are not read,
whatever their names; an empty table gives an empty one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LAST, drop_folder, keyed, scratch, settled
from .hashing import WordHashes, mix, parts, payloads, rolled

WINDOW, PRINT, LEAST_WORDS = 50, 25, 15
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_UNIT = pa.struct([("at", pa.int32()), ("n", pa.int32()), ("left", pa.int64()), ("right", pa.int64())])


def winnow(prints: np.ndarray, window: int) -> np.ndarray:
    """For each run of `window` prints the place of its minimum, the last one if there are several."""
    if len(prints) < window:
        return np.empty(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(prints, window)[:, ::-1]
    return np.arange(len(view)) + window - 1 - view.argmin(axis=1)


def _prints(words: np.ndarray) -> np.ndarray:
    """The fingerprint of each run of `WINDOW` words: equal runs have equal ones."""
    prints = rolled(words, PRINT)
    return prints[winnow(prints, WINDOW - PRINT + 1)]


def _twice(words: np.ndarray) -> np.ndarray:
    """The fingerprints of one text; one that stands at several places is there twice."""
    prints = rolled(words, PRINT)
    values = np.sort(prints[np.unique(winnow(prints, WINDOW - PRINT + 1))])
    new = np.ones(len(values), bool)
    new[2:] = values[2:] != values[:-2]
    return values[new]


def units(text: bytes, least: int = LEAST_WORDS) -> list[tuple[int, int, int, int]]:
    """(first word, words, digest in two halves) of the lines and of the paragraphs of several lines of `least` words or more."""
    found, at, held = [], 0, []

    def add(place: int, n: int, seed: int, value: bytes) -> None:
        if n >= least:
            digest = np.frombuffer(xxhash.xxh3_128_digest(value, seed), np.int64)
            found.append((place, n, int(digest[0]), int(digest[1])))

    def end() -> None:
        if len(held) > 1:
            n = sum(len(x) for x in held)
            add(at - n, n, 1, b"\n".join(b" ".join(x) for x in held))
        held.clear()

    for line in text.split(b"\n"):
        words = line.split()
        if words:
            add(at, len(words), 0, b" ".join(words))
            at += len(words)
            held.append(words)
        else:
            end()
    end()
    return found


def _signer(least: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in parts(batches, "text"):
            found, digests, pieces = [], [], []
            for text in payloads(batch, "text"):
                plain = text.lower()
                words = plain.split()
                long = len(words) >= WINDOW
                found.append(_twice(known.of(words)) if long else np.empty(0, np.uint64))
                digests.append(xxhash.xxh3_128_digest(b" ".join(words)) if long else None)
                pieces.append(units(plain, least))
            ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
            prints = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found).view(np.int64)))
            ends = np.cumsum([0, *map(len, pieces)]).astype(np.int32)
            columns = [pa.array([x[i] for piece in pieces for x in piece], kind.type) for i, kind in enumerate(_UNIT)]
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(columns, fields=list(_UNIT)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("row"), pa.array(digests, pa.binary()), prints, lists], ["id", "row", "digest", "prints", "units"])

    return sign


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = WordHashes()
    for batch in parts(batches, "text"):
        places, left, right = [], [], []
        repeated = batch.column("prints")
        for i, text in enumerate(payloads(batch, "text")):
            words = known.of(text.lower().split())
            may = np.flatnonzero(np.isin(_prints(words), np.asarray(repeated[i].values, np.int64).view(np.uint64)))
            places.append(may)
            left.append(rolled(words, WINDOW)[may])
            with np.errstate(over="ignore"):
                right.append(rolled(mix(words + np.uint64(0x632BE59BD9B4E019)), WINDOW)[may])
        rows = np.repeat(np.arange(len(places)), [len(x) for x in places])
        empty = [np.empty(0, np.uint64)]
        columns = [*(batch.column(c).take(pa.array(rows)) for c in ("id", "row")), pa.array(np.concatenate(places).astype(np.int32)), pa.array(np.concatenate(left or empty).view(np.int64)), pa.array(np.concatenate(right or empty).view(np.int64))]
        yield pa.RecordBatch.from_arrays(columns, ["id", "row", "at", "left", "right"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in parts(batches, "text"):
        kept, starts, ends, words = [], [], [], []
        for text, found, whole in zip(batch.column("text").to_pylist(), batch.column("found").to_pylist(), batch.column("whole").to_pylist()):
            spans = []
            removed = 0
            if whole or found:
                place = [m.span() for m in _WORD.finditer(text or "")]
                runs = []
                for s, n in [(0, len(place))] if whole else sorted((x["at"], x["n"]) for x in found if x["at"] + x["n"] <= len(place)):
                    if runs and s <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], s + n)
                    else:
                        runs.append([s, s + n])
                spans = [(place[a][0], place[b - 1][1]) for a, b in runs if b > a]
                removed = sum(b - a for a, b in runs)
            kept.append(_without(text, spans))
            starts.append([a for a, _ in spans])
            ends.append([b for _, b in spans])
            words.append(removed)
        arrays = [batch.column("id"), pa.array(kept, pa.string()), pa.array(starts, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64())), pa.array(words, pa.int64())]
        yield pa.RecordBatch.from_arrays(arrays, ["id", "text", "removed_starts", "removed_ends", "n_removed_words"])


def _without(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    if not spans:
        return text
    cuts = [0, *[x for span in spans for x in span], len(text)]
    return "".join(text[a:b] for a, b in zip(cuts[::2], cuts[1::2]))


def repeats(docs: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """(id, row, found, whole) of the documents that lose words; `docs` is (id, row, text), `row` telling equal ids apart.

    `found` has the units, by the number of their first word and their words, that
    occur earlier; a document whose words are all those of an earlier one is `whole`.
    """
    spark, folder = docs.sparkSession, scratch(docs.sparkSession)
    place, document = F.struct("id", "row", "at"), F.struct("id", "row")
    signed = settled(docs.where("text is not null").mapInArrow(_signer(least), "id long, row long, digest binary, prints array<long>, units array<struct<at: int, n: int, left: long, right: long>>"), f"{folder}/signed")
    firsts = settled(signed.where("digest is not null").groupBy("digest").agg(F.min(document).alias("first"), F.max(document).alias("last")).where("first < last"), f"{folder}/firsts")
    copies = settled(signed.select("id", "row", "digest").join(firsts, "digest").where(document > F.col("first")).select("id", "row").distinct(), f"{folder}/copies")
    # Rows equal in id and text are one document, of which one goes on.
    rest = signed.drop("digest").dropDuplicates(["id", "row"]).join(copies, ["id", "row"], "left_anti")
    rest = settled(rest, f"{folder}/rest")
    drop_folder(spark, f"{folder}/signed", f"{folder}/firsts")
    # First pass: lines and paragraphs.
    whole = rest.select("id", "row", F.inline("units"))
    first = whole.groupBy("left", "right").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first < last").drop("last")
    lines = settled(whole.join(first, ["left", "right"]).where(place > F.col("first")).select("id", "row", "at", "n"), f"{folder}/lines")
    # Second pass: runs of words.
    prints = rest.select("id", "row", F.explode("prints").alias("print"))
    several = prints.groupBy("print").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("print")
    candidates = settled(prints.join(several, "print").groupBy("id", "row").agg(F.collect_set("print").alias("prints")), f"{folder}/candidates")
    drop_folder(spark, f"{folder}/rest")
    texts = docs.join(candidates, ["id", "row"]).select("id", "row", "text", "prints").dropDuplicates(["id", "row"])
    windows = settled(texts.mapInArrow(_windows, "id long, row long, at int, left long, right long"), f"{folder}/windows")
    drop_folder(spark, f"{folder}/candidates")
    first = windows.groupBy("left", "right").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first < last").drop("last")
    later = (document > F.struct("first.id", "first.row")) | (F.col("at") >= F.col("first.at") + WINDOW)
    runs = windows.join(first, ["left", "right"]).where(later).select("id", "row", "at", F.lit(WINDOW).alias("n"))
    found = settled(runs.union(lines).groupBy("id", "row").agg(F.collect_set(F.struct("at", "n")).alias("found")), f"{folder}/found")
    drop_folder(spark, f"{folder}/windows", f"{folder}/lines")
    return found.select("id", "row", "found", F.lit(False).alias("whole")).union(copies.select("id", "row", F.array().cast("array<struct<at: int, n: int>>"), F.lit(True)))


def dedup(docs: DataFrame, doc: str = "doc_id", text: str = "text", least: int = LEAST_WORDS) -> DataFrame:
    """One row per row of `docs`: (doc, text, removed_starts, removed_ends, n_removed_words), the text without its repeats."""
    rows = keyed(docs, doc, text)
    out = rows.join(repeats(rows, least), ["id", "row"], "left").mapInArrow(_cut, "id long, text string, removed_starts array<long>, removed_ends array<long>, n_removed_words long")
    return out.select(F.when(F.col("id") != LAST, F.col("id")).alias(doc), "text", "removed_starts", "removed_ends", "n_removed_words")


def query(docs: DataFrame) -> DataFrame:
    return dedup(docs)


ORACLE = rf"""
WITH RECURSIVE t AS (
  SELECT doc_id, unnest(parts) AS tok, unnest(range(1, len(parts) + 1)) AS i
  FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS parts FROM documents)),
o AS (
  SELECT *, regexp_matches(tok, '^[^\x20\x09-\x0D]') AS is_word,
         coalesce(sum(length(tok)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start,
         coalesce(sum(CASE WHEN regexp_matches(tok, '^[\x20\x09-\x0D]') THEN length(regexp_replace(tok, '[^\n]+', '', 'g')) ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i), 0) AS line,
         sum(CASE WHEN length(regexp_replace(tok, '[^\n]+', '', 'g')) > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS para
  FROM t),
w AS (SELECT doc_id, i, start, length(tok) AS n, line, para, translate(tok, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS word, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS k FROM o WHERE is_word),
u AS (
  SELECT doc_id, min(k) AS k, count(*) AS n, 'line ' || string_agg(word, ' ' ORDER BY k) AS unit FROM w GROUP BY doc_id, line HAVING count(*) >= {LEAST_WORDS}
  UNION ALL
  SELECT doc_id, min(k), sum(n)::BIGINT, 'para ' || string_agg(unit, chr(10) ORDER BY k) FROM (
    SELECT doc_id, para, min(k) AS k, count(*) AS n, string_agg(word, ' ' ORDER BY k) AS unit FROM w GROUP BY doc_id, para, line) GROUP BY doc_id, para HAVING count(*) > 1 AND sum(n) >= {LEAST_WORDS}),
uf AS (SELECT *, min((doc_id, k)) OVER (PARTITION BY unit) AS first FROM u),
a AS (SELECT doc_id, list(word ORDER BY k) AS ws FROM w GROUP BY doc_id HAVING count(*) >= {WINDOW}),
g AS (SELECT doc_id, p AS k, md5(array_to_string(ws[p + 1 : p + {WINDOW}], ' ')) AS gram FROM (SELECT doc_id, ws, unnest(range(0, len(ws) - {WINDOW} + 1)) AS p FROM a)),
gf AS (SELECT *, min((doc_id, k)) OVER (PARTITION BY gram) AS first FROM g),
r AS (
  SELECT doc_id, k, n FROM uf WHERE (doc_id, k) <> first
  UNION ALL SELECT doc_id, k, {WINDOW} FROM gf WHERE doc_id <> first[1] OR k >= first[2] + {WINDOW}),
gone AS (SELECT DISTINCT doc_id, unnest(range(k, k + n)) AS k FROM r),
v AS (SELECT w.*, gone.k IS NOT NULL AS gone FROM w LEFT JOIN gone USING (doc_id, k)),
b AS (SELECT *, k - row_number() OVER (PARTITION BY doc_id ORDER BY k) AS run FROM v WHERE gone),
s AS (SELECT doc_id, min(start) AS a, max(start + n) AS z, count(*) AS words FROM b GROUP BY doc_id, run),
c AS (SELECT doc_id, list(a ORDER BY a)::BIGINT[] AS removed_starts, list(z ORDER BY a)::BIGINT[] AS removed_ends, sum(words)::BIGINT AS words FROM s GROUP BY doc_id)
SELECT d.doc_id,
       CASE WHEN c.doc_id IS NULL THEN d.text ELSE array_to_string(list_transform(range(0, len(removed_starts) + 1),
         lambda x: substr(d.text, (CASE WHEN x = 0 THEN 0 ELSE removed_ends[x] END) + 1, (CASE WHEN x = len(removed_starts) THEN length(d.text) ELSE removed_starts[x + 1] END) - (CASE WHEN x = 0 THEN 0 ELSE removed_ends[x] END))), '') END AS text,
       coalesce(removed_starts, []::BIGINT[]) AS removed_starts, coalesce(removed_ends, []::BIGINT[]) AS removed_ends, coalesce(words, 0) AS n_removed_words
FROM documents d LEFT JOIN c ON c.doc_id = d.doc_id
"""
