"""Line dedup by content-defined chunks of lines. DataFrame functions only.

A text's lines are hashed; a rolling hash over the last WINDOW line hashes ends a
chunk where it is 0 modulo DIVISOR, but not just before the last line. Boundaries
depend on the lines near them alone, so a passage that stands in many documents is
cut alike in all of them, wherever it starts. Each chunk begins a unit: the chunk
itself, or with the next one if it is a single line, so that every unit has two
lines or more. A unit, of which one line is not blank, that occurs more than once
keeps its first place (smallest id, then position) whole; its lines go elsewhere,
after its bytes have been compared with the first's.

Units are counted by their md5, with partial sums. The texts of the first places
alone then go to the places that repeat them, and are compared there when the
document is cut. Both joins need the documents by their id: they are
stored once in buckets of it, so that texts are shuffled once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let
from .common import bucketed, materialise

WINDOW, DIVISOR, MODULUS, BASE = 2, 2, 1_000_003, 31
REPEAT, FIRST = 1, 2  # what a unit is: a repeat of an earlier place, the first of several


def _line_hashes(lines: Column) -> Column:
    """The first 24 bits of each line's md5."""
    return F.transform(lines, lambda x: F.conv(F.substring(F.md5(x), 1, 6), 16, 10).cast("long"))


def _ends(hashes: Column) -> Column:
    """Positions (from 0) of the lines that end a chunk; the last line always does, the one before it never."""
    n = F.size(hashes)
    at = lambda i: F.when(i >= 0, F.get(hashes, i)).otherwise(F.lit(0))
    rolled = lambda i: sum(((at(i - j) * BASE**j) for j in range(1, WINDOW)), at(i)) % MODULUS % DIVISOR
    places = F.sequence(F.lit(0), n - 1)
    return F.filter(places, lambda i: (i == n - 1) | ((i != n - 2) & (rolled(i) == 0)))


def _cut(docs: DataFrame) -> DataFrame:
    """docs with the arrays _lines, _hashes and _ends. Each is a column of its own: functions of arrays see computed values, not expressions to evaluate for every element."""
    lined = docs.withColumn("_lines", F.split("text", "\n", -1))
    return lined.withColumn("_hashes", _line_hashes(F.col("_lines"))).withColumn("_ends", _ends(F.col("_hashes")))


def _places(ends: Column) -> Column:
    """start, stop (lines, from 0) of each chunk, and until: where the unit that begins with it stops."""
    start = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(ends, i - 1) + 1)
    until = lambda e, i: F.when(e == start(i), F.coalesce(F.get(ends, i + 1), e)).otherwise(e) + 1
    return F.transform(ends, lambda e, i: F.struct(start(i).alias("start"), (e + 1).alias("stop"), until(e, i).alias("until")))


def _text(lines: Column, start: Column, stop: Column) -> Column:
    return F.array_join(F.slice(lines, start + 1, stop - start), "\n")


def _unit(c: Column) -> Column:
    return _text(F.col("_lines"), c["start"], c["until"])


def _blank(text: Column) -> Column:
    return F.trim(F.translate(text, "\n\r\t", "   ")) == ""


def unit_hashes(docs: DataFrame) -> DataFrame:
    """doc_id, pos, h of every unit of at least two lines, not all blank, of docs (doc_id, text). Null texts have none."""
    placed = _cut(docs.filter(F.col("text").isNotNull())).withColumn("_c", _places(F.col("_ends")))
    # Hashed in the array: exploding copies no text.
    hashed = F.transform("_c", lambda c, i: F.struct(i.alias("pos"), F.when((c["until"] - c["start"] >= 2) & ~_blank(_unit(c)), F.md5(_unit(c))).alias("h")))
    return placed.select("doc_id", F.explode(hashed).alias("c")).select("doc_id", "c.pos", "c.h").filter("h IS NOT NULL")


def line_dedup(docs: DataFrame) -> DataFrame:
    """All columns of docs, with text cut, and n_lines, n_removed (lines).

    docs needs doc_id and text. A null text stays null, with 0 lines; an empty text
    has one line. Rows that share a doc_id count as one document: units of one
    position and one text are one place, so repeated rows are cut alike, and rows of
    different texts each lose what an earlier place has. Rows with a null doc_id stay
    as they are.
    """
    docs = bucketed(docs, "doc_id", "lines")
    keyed = materialise(unit_hashes(docs.select("doc_id", "text")).filter("doc_id IS NOT NULL"), "units")
    many = materialise(keyed.groupBy("h").agg(F.min(F.struct("doc_id", "pos")).alias("first"), F.max(F.struct("doc_id", "pos")).alias("last")).filter("first <> last").drop("last"), "repeated")
    # The first places' texts.
    places = many.groupBy(F.col("first.doc_id").alias("doc_id")).agg(F.collect_list(F.struct(F.col("first.pos").alias("pos"), "h")).alias("_at"))
    held = _cut(docs.select("doc_id", "text").filter(F.col("text").isNotNull()).join(places, "doc_id")).withColumn("_c", _places(F.col("_ends")))
    # Exploded as an expression, not a column: of a column, filters would be inferred and pushed down with all that it is made of.
    found = F.filter(F.transform("_at", lambda a: F.struct(a["h"].alias("h"), _unit(F.get("_c", a["pos"])).alias("head"))), lambda x: F.md5(x["head"]) == x["h"])
    heads = held.select(F.explode(found).alias("x")).select("x.*").dropDuplicates(["h"])
    # Every place gets the text that it is said to have, and what it is.
    same = (F.col("doc_id") == F.col("first.doc_id")) & (F.col("pos") == F.col("first.pos"))
    units = keyed.join(many, "h").select("h", "doc_id", "pos", F.when(same, FIRST).otherwise(REPEAT).alias("code")).join(heads, "h")
    said = units.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("pos", "code", "head"))).alias("_said"))
    joined = docs.join(said, "doc_id", "left")
    left = joined.withColumn("_left", let(F.split("text", "\n", -1), lambda lines: F.when(F.col("_said").isNotNull() & F.col("text").isNotNull(), _without(lines, F.col("_said"))).otherwise(F.struct(F.col("text").alias("text"), F.size(lines).alias("n"), F.size(lines).alias("of")))))
    n = lambda c: F.when(F.col("text").isNull(), 0).otherwise(c).cast("long")
    out = left.withColumn("n_lines", n(F.col("_left.of"))).withColumn("n_removed", n(F.col("_left.of") - F.col("_left.n")))
    return out.withColumn("text", F.col("_left.text")).select(*docs.columns, "n_lines", "n_removed")


def _without(lines: Column, said: Column) -> Column:
    """text, n (lines left), of (lines) without the lines of repeated units, but with those of units that are the first of several.

    said has units by position; those whose bytes differ from the row's own are another
    row's. Every array is bound before it is used for each element: filters on the result
    may be pushed down to here, and would otherwise evaluate arrays for each element of
    others. All steps are linear in lines.
    """

    def verified(places: Column) -> Column:
        own = lambda a: let(F.get(places, a["pos"]), lambda c: _text(lines, c["start"], c["until"]))
        return F.filter(said, lambda a: (a["pos"] < F.size(places)) & (own(a) == a["head"]))

    def codes(places: Column, true: Column) -> Column:
        """What each unit is, by position: gaps between the verified ones are filled with 0."""
        at = lambda j: F.when(j < 0, F.lit(-1)).otherwise(F.coalesce(F.get(true, j)["pos"], F.size(places)))
        pieces = F.transform(F.sequence(F.lit(0), F.size(true)), lambda j: F.concat(F.array_repeat(F.lit(0), at(j) - at(j - 1) - 1), F.when(j < F.size(true), F.array(F.get(true, j)["code"])).otherwise(F.array().cast("array<int>"))))
        return F.flatten(pieces)

    def kept(places: Column, code: Column) -> Column:
        def stays(c: Column, i: Column) -> Column:
            before = F.get(places, F.greatest(i - 1, F.lit(0)))
            single = (i > 0) & (before["stop"] - before["start"] == 1)
            other = F.when(single, F.get(code, F.greatest(i - 1, F.lit(0)))).otherwise(F.lit(0))
            return ~((F.get(code, i) == REPEAT) | (other == REPEAT)) | (F.get(code, i) == FIRST) | (other == FIRST)

        return F.filter(places, stays)

    rest = lambda chunks: F.struct(
        F.array_join(F.transform(chunks, lambda c: _text(lines, c["start"], c["stop"])), "\n").alias("text"),
        F.aggregate(chunks, F.lit(0), lambda s, c: s + c["stop"] - c["start"]).alias("n"),
        F.size(lines).alias("of"),
    )
    cut = lambda places: let(verified(places), lambda true: let(codes(places, true), lambda code: let(kept(places, code), rest)))
    return let(_line_hashes(lines), lambda h: let(_ends(h), lambda e: let(_places(e), cut)))


ORACLE = f"""
WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL),
h AS (SELECT doc_id, lines, [CAST('0x' || substr(md5(x), 1, 6) AS BIGINT) FOR x IN lines] AS hs FROM l),
e AS (SELECT doc_id, lines, [i FOR i IN range(0, len(hs)) IF i = len(hs) - 1 OR
  (i <> len(hs) - 2 AND (hs[i + 1] + CASE WHEN i >= 1 THEN hs[i] ELSE 0 END * {BASE}) % {MODULUS} % {DIVISOR} = 0)] AS ends FROM h),
u AS (SELECT doc_id, lines, unnest(range(0, len(ends))) AS pos, ends FROM e),
c AS (SELECT doc_id, pos, CASE WHEN pos = 0 THEN 0 ELSE ends[pos] + 1 END AS a, ends[pos + 1] + 1 AS b, ends[pos + 2] + 1 AS z, lines FROM u),
t AS (SELECT doc_id, pos, b - a AS n, array_to_string(lines[a + 1:b], chr(10)) AS chunk, array_to_string(lines[a + 1:CASE WHEN b - a = 1 THEN z ELSE b END], chr(10)) AS unit, CASE WHEN b - a = 1 THEN z ELSE b END - a AS m FROM c),
r AS (SELECT doc_id, pos, CASE WHEN row_number() OVER (PARTITION BY unit ORDER BY doc_id, pos) > 1 THEN 1 WHEN count(*) OVER (PARTITION BY unit) > 1 THEN 2 ELSE 0 END AS code
  FROM t WHERE m >= 2 AND trim(translate(unit, chr(10) || chr(13) || chr(9), '   ')) <> ''),
s AS (SELECT t.doc_id, t.pos, t.n, t.chunk, coalesce(r.code, 0) AS code FROM t LEFT JOIN r ON t.doc_id = r.doc_id AND t.pos = r.pos),
f AS (SELECT *, CASE WHEN lag(n) OVER d = 1 THEN lag(code) OVER d ELSE 0 END AS other FROM s WINDOW d AS (PARTITION BY doc_id ORDER BY pos)),
k AS (SELECT doc_id, pos, n, chunk, NOT (code = 1 OR other = 1) OR code = 2 OR other = 2 AS stays FROM f),
g AS (SELECT doc_id, string_agg(chunk, chr(10) ORDER BY pos) FILTER (stays) AS kept, sum(n) AS n_lines, sum(CASE WHEN stays THEN 0 ELSE n END) AS n_removed FROM k GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(g.n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(g.n_removed, 0) AS BIGINT) AS n_removed,
  CASE WHEN d.text IS NULL THEN NULL ELSE sha256(coalesce(g.kept, '')) END AS text_sha256 FROM documents d LEFT JOIN g ON d.doc_id = g.doc_id
"""
