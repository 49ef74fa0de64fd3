"""Line dedup: drop the lines that too many documents share, in DataFrame functions only.

Lines are exploded, normalised (white space stripped at both ends, A-Z lower-cased) and hashed to
128 bits; documents are counted per hash in two steps, first one row for each hash and document,
then one for each hash, so that no task holds the documents of a frequent line. A frequent line
stays in the document of greatest id that holds it. The others lose it: what travels back to a
document is the list of its dropped places, and it is put together from the stretches of lines
between those places.

Lines that make up more than one in ``HOT`` of all lines meet their rows in a broadcast join:
there are fewer than ``HOT`` of them by counting. The rest meet theirs in a shuffled one, where no
key has more than that share of the rows.

Null and empty texts are one empty line. Rows of one id are one document for the counts; rows
without an id are one document too, of the smallest id. Every row, repeated ones too, gives a row
of its own, and equal rows lose the same lines. Ties do not occur: the greatest id is unique.
Lines of any length are compared whole, by their hash. An empty table gives no rows. Columns
other than ``doc_id`` and ``text`` are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.llm.common import row_key, stored, table

LEAST_CHARS, LEAST_DOCS = 20, 3
#: Lines beyond one in so many of all lines are joined by broadcast; bounds the rows broadcast.
HOT = 50_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANKS = " \t\n\x0b\f\r"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z in lower case."""
    bare = F.btrim(line, F.lit(BLANKS))
    # Of pure ASCII, lower() changes just A-Z, and does so byte by byte.
    ascii_only = F.octet_length(bare) == F.char_length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def _hashed_lines(docs: DataFrame, least_chars: int) -> DataFrame:
    """``kid, kh, place, h1, h2`` of every line that is long enough to be dropped."""
    lines = docs.select(*row_key(), F.posexplode(lines_of(F.col("text"))).alias("place", "line"))
    keys = lines.select("kid", "kh", "place", line_key(F.col("line")).alias("key"))
    keys = keys.filter(F.char_length("key") >= least_chars)
    return keys.select(
        "kid", "kh", "place", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2")
    )


def _dropped_places(lines: DataFrame, least_docs: int) -> DataFrame:
    """``kid, kh, places`` (in order) of every row that loses lines."""
    by_doc = lines.groupBy("h1", "h2", "kid").agg(F.count(F.lit(1)).alias("n"))
    frequent = by_doc.groupBy("h1", "h2").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("docs"), F.max("kid").alias("keep")
    ).filter(F.col("docs") >= least_docs)
    frequent = stored(frequent.select("h1", "h2", "n", "keep"), "lines")
    total = lines.count()
    is_hot = F.col("n") * HOT > total
    hot = F.broadcast(frequent.filter(is_hot).select("h1", "h2", "keep"))
    others = frequent.filter(~is_hot).select("h1", "h2", "keep")
    hits = lines.join(hot, ["h1", "h2"]).unionByName(
        lines.join(hot, ["h1", "h2"], "left_anti").join(others, ["h1", "h2"])
    ).filter("kid <> keep")
    return hits.groupBy("kid", "kh").agg(F.sort_array(F.collect_set("place")).alias("places"))


def line_dedup(
    docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS
) -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept`` (the text of the lines that stay) for every row."""
    lines = stored(_hashed_lines(docs, least_chars), "lines")
    places = _dropped_places(lines, least_docs)
    whole = docs.select("doc_id", "text", *row_key()).join(places, ["kid", "kh"], "left")
    cut = whole.select("doc_id", "places", lines_of(F.col("text")).alias("lines"))
    # Bounds of the stretches between dropped places, the ends of the text included.
    cut = cut.withColumn("bounds", F.concat(
        F.array(F.lit(-1)), F.coalesce("places", F.array().cast("array<int>")), F.array(F.size("lines"))
    ))
    stretches = F.transform(
        F.sequence(F.lit(0), F.size("bounds") - 2),
        lambda j: F.slice(
            "lines", F.get("bounds", j) + 2, F.get("bounds", j + 1) - F.get("bounds", j) - 1
        ),
    )
    return cut.select(
        "doc_id", F.size("lines").cast("long").alias("n_lines"),
        (F.size("bounds") - 2).cast("long").alias("n_dropped"),
        F.array_join(F.flatten(stretches), "\n").alias("kept"),
    )


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup(table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT r, doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS place FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, max(doc_id) AS keep FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
j AS (SELECT k.r, k.doc_id, k.place, k.line, f.key IS NOT NULL AND k.doc_id <> f.keep AS dropped
      FROM k LEFT JOIN f ON k.key = f.key)
SELECT max(doc_id) AS doc_id, count(*) AS n_lines, CAST(count(*) FILTER (dropped) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT dropped), '')) AS kept_sha256
FROM j GROUP BY r
"""
