"""Removal of runs of lines that stand earlier in the corpus, by winnowing over line hashes.

1. Lines of a document are hashed. Of every `run` consecutive lines the last smallest hash is the fingerprint. Runs that
   agree choose the same line, so each repeated run of `run` lines or more shares a fingerprint.
2. Fingerprints that stand in one place only are left. The positions of the others are joined by fingerprint.
3. The match is extended both ways: a position carries the windows of `run` lines around it that chose it. A window that
   stands earlier, in order of (doc_id, line), is repeated; overlapping windows make up the whole match.
4. Lines of repeated windows go; all lines are judged on the input.

With `words`, fewer than `run` lines that hold more than that many words together are windows too, each its own fingerprint: a
long passage that stands earlier on one or two lines goes, whatever its neighbours are. Without it only runs of `run` lines count.

A line that stands in a third of all documents costs a row each: counts and first positions are partial aggregates, and the
joins with them are split where skewed. No pairs of positions are made.

Cases: null is kept as null and counts as one empty line; rows without doc_id are kept and repeat nothing; whole rows that
repeat (same id, same text) are treated alike; further columns stay.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as S

from tidegauge.llm import text as T
from tidegauge.session import written

RUN = 3
NEWLINE = 0x0A


def lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and end of every line; a row of k newlines has k + 1 lines, empty ones too."""
    breaks = np.flatnonzero(data == NEWLINE)
    row_of = np.searchsorted(offsets, breaks, "right") - 1
    rows = np.arange(len(offsets) - 1)
    start = np.concatenate([offsets[:-1], breaks + 1])
    end = np.concatenate([breaks, offsets[1:]])
    row = np.concatenate([rows, row_of])
    order = np.lexsort((start, row))
    back = np.lexsort((end, np.concatenate([row_of, rows])))
    return row[order], start[order], end[back]


def fingerprints(row: np.ndarray, hashes: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray]:
    """First line (index) of every window of `run` lines of one row, and the index of the line it chooses."""
    if len(hashes) < run:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(hashes, run)
    whole = np.flatnonzero(row[:len(row) - run + 1] == row[run - 1:])
    chosen = run - 1 - np.argmin(views[whole][:, ::-1], axis=1)  # the last of equal minima
    return whole, whole + chosen


def long_windows(row: np.ndarray, words_of: np.ndarray, size: int, words: int) -> np.ndarray:
    """First line (index) of every window of `size` lines of one row that hold more than `words` words together."""
    n = len(row) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    return np.flatnonzero((row[:n] == row[size - 1:]) & (sum(words_of[j:j + n] for j in range(size)) > words))


SCHEMA = "fingerprint bigint, doc_id bigint, text_key int, line bigint, size int, windows array<bigint>"
FIELDS = pa.schema([("fingerprint", pa.int64()), ("doc_id", pa.int64()), ("text_key", pa.int32()), ("line", pa.int64()), ("size", pa.int32()),
                    ("windows", pa.list_(pa.int64()))])


def _positions(run: int, words: int | None):
    """A row a chosen line: its hash, the first line and the lines of the windows that chose it, and the hashes of these windows."""
    def work(batches):
        for batch in batches:
            batch = batch.filter(batch.column("doc_id").is_valid())
            ids, texts = batch.column("doc_id").to_numpy(), batch.column("text_key").to_numpy()
            for a, b, data, offsets in T.text_pieces(batch.column("text")):
                row, start, end = lines(data, offsets)
                hashes = T.span_hashes(T.rolling(data), start, end)
                base = np.searchsorted(row, row)  # index of the first line of the row

                def rows(keys, at, size, ends, window):
                    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(window.view(np.int64)))
                    return pa.RecordBatch.from_arrays([
                        pa.array(keys.view(np.int64)), pa.array(ids[a + row[at]], pa.int64()), pa.array(texts[a + row[at]], pa.int32()),
                        pa.array(at - base[at]), pa.array(np.full(len(at), size, np.int32)), lists], schema=FIELDS)

                first, chosen = fingerprints(row, hashes, run)
                if len(first):
                    heads = np.flatnonzero(np.append(True, (chosen[1:] != chosen[:-1]) | (first[1:] != first[:-1] + 1)))
                    yield rows(hashes[chosen[heads]], first[heads], run, np.append(heads, len(first)), T.windows(hashes, run)[first])
                if words is None:
                    continue
                begins, _ = T.spans(data, offsets, T.IS_SPACE[data])
                words_of = np.searchsorted(begins, end) - np.searchsorted(begins, start)
                for size in range(1, run):
                    at = long_windows(row, words_of, size, words)
                    if len(at):
                        window = T.windows(hashes, size)[at]
                        yield rows(window, at, size, np.arange(len(at) + 1), window)
    return work


def repeated_windows(documents: DataFrame, run: int = RUN, words: int | None = None) -> DataFrame:
    """(doc_id, text_key, line, size): first lines and numbers of lines of the windows that stand earlier too."""
    keyed = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.hash("text").alias("text_key"), "text")
    positions = written(documents.sparkSession, keyed.mapInArrow(_positions(run, words), SCHEMA), "fingerprints")
    many = positions.groupBy("fingerprint").agg(F.sum(F.size("windows")).alias("n")).where("n > 1")
    met = positions.join(many.select("fingerprint"), "fingerprint", "left_semi")
    each = met.select("doc_id", "text_key", "line", "size", F.posexplode("windows").alias("step", "window")).select(
        "window", F.struct("doc_id", (F.col("line") + F.col("step")).alias("line"), "text_key", "size").alias("place"))
    first = each.groupBy("window").agg(F.min("place").alias("first"), F.max("place").alias("last")).where("first < last").select("window", "first")
    return each.join(first, "window").where("place > first").select("place.doc_id", "place.text_key", "place.line", "place.size").distinct()


OUT = [("n_lines", S.LongType()), ("n_removed", S.LongType()), ("n_runs", S.LongType())]


def _delete(names: list[str]):
    def work(batches):
        for batch in batches:
            kept, counts = [], []
            for text, found in zip(batch.column("text"), batch.column("found").to_pylist()):
                text = text.as_py()
                parts = (text or "").split("\n")
                gone = np.zeros(len(parts) + 1, np.int64)
                for window in found or ():
                    gone[window["line"]:window["line"] + window["size"]] = 1
                gone = gone[:-1]
                counts.append((len(parts), int(gone.sum()), int((np.diff(gone, prepend=0) == 1).sum())))
                kept.append("\n".join(p for p, g in zip(parts, gone) if not g) if text is not None else None)
            columns = [pa.array(kept, pa.string()) if n == "text" else batch.column(n) for n in names]
            numbers = [pa.array(c, pa.int64()) for c in (zip(*counts) if counts else ((), (), ()))]
            yield pa.RecordBatch.from_arrays([*columns, *numbers], names=[*names, *(n for n, _ in OUT)])
    return work


def remove_repeated_runs(documents: DataFrame, run: int = RUN, words: int | None = None) -> DataFrame:
    """All columns of documents with `text` less its repeated lines, and n_lines, n_removed, n_runs (replacing such columns).

    A repeat is a run of `run` lines and, with `words`, also fewer lines with more than `words` words together."""
    rest = documents.drop(*(n for n, _ in OUT))
    found = repeated_windows(documents.select("doc_id", "text"), run, words).groupBy("doc_id", "text_key").agg(
        F.collect_list(F.struct("line", "size")).alias("found"))
    left, right = "__line_doc", "__line_key"
    found = found.select(F.col("doc_id").alias(left), F.col("text_key").alias(right), F.col("found").alias("__found"))
    joined = rest.join(found, (F.col("doc_id").cast("bigint") == F.col(left)) & (F.hash("text") == F.col(right)), "left")
    joined = joined.select(*rest.columns, F.col("__found").alias("found")) if "found" not in rest.columns else joined.select(
        *(c for c in rest.columns if c != "found"), F.col("found").alias("__kept_found"), F.col("__found").alias("found"))
    names = [c for c in joined.columns if c != "found"]
    schema = S.StructType([joined.schema[n] for n in names] + [S.StructField(n, t) for n, t in OUT])
    out = joined.mapInArrow(_delete(names), schema)
    return out.withColumnRenamed("__kept_found", "found").select(*rest.columns, *(n for n, _ in OUT))


# The same rows in DuckDB.
ORACLE_SQL = """WITH cut AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) l FROM documents),
 line AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS n, len(l) AS m FROM cut),
 windows AS (SELECT doc_id, n, m, line || chr(10) || lead(line, 1) OVER w || chr(10) || lead(line, 2) OVER w AS key FROM line WINDOW w AS (PARTITION BY doc_id ORDER BY n)),
 later AS (SELECT doc_id, n FROM (SELECT doc_id, n, row_number() OVER (PARTITION BY key ORDER BY doc_id, n) r FROM windows WHERE n + 2 <= m) WHERE r > 1),
 gone AS (SELECT DISTINCT doc_id, n + unnest([0, 1, 2]) AS n FROM later),
 marked AS (SELECT a.doc_id, a.n, a.line, g.n IS NOT NULL AS gone FROM line a LEFT JOIN gone g ON a.doc_id = g.doc_id AND a.n = g.n),
 runs AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY n), false) AS begins FROM marked)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_removed, CAST(count(*) FILTER (begins) AS BIGINT) AS n_runs,
 sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT gone), '')) AS kept_sha256 FROM runs GROUP BY doc_id"""

# The rows with windows of one or two lines of more than 50 words too.
LONG_SQL = """WITH cut AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) l FROM documents),
 line AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS n, len(l) AS m FROM cut),
 counted AS (SELECT *, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS words FROM line),
 spans AS (SELECT doc_id, n, m, 1 AS size, line AS key, words FROM counted
  UNION ALL SELECT doc_id, n, m, 2, line || chr(10) || lead(line, 1) OVER w, words + lead(words, 1) OVER w FROM counted WINDOW w AS (PARTITION BY doc_id ORDER BY n)
  UNION ALL SELECT doc_id, n, m, 3, line || chr(10) || lead(line, 1) OVER w || chr(10) || lead(line, 2) OVER w, NULL FROM counted WINDOW w AS (PARTITION BY doc_id ORDER BY n)),
 later AS (SELECT doc_id, n, size FROM (SELECT doc_id, n, size, row_number() OVER (PARTITION BY size, key ORDER BY doc_id, n) r FROM spans
  WHERE n + size - 1 <= m AND (size = 3 OR words > 50)) WHERE r > 1),
 gone AS (SELECT DISTINCT doc_id, n + unnest(range(size)) AS n FROM later),
 marked AS (SELECT a.doc_id, a.n, a.line, g.n IS NOT NULL AS gone FROM line a LEFT JOIN gone g ON a.doc_id = g.doc_id AND a.n = g.n),
 runs AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY n), false) AS begins FROM marked)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_removed, CAST(count(*) FILTER (begins) AS BIGINT) AS n_runs,
 sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT gone), '')) AS kept_sha256 FROM runs GROUP BY doc_id"""
