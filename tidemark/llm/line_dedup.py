"""Line dedup with a log-template tree, in built-in functions only.

Lines, and the sentences that they hold, become tokens: lower-cased words, and any word with
a digit is the field `<*>`. The tree has a fixed depth: token count, then the `LEAD` leading
tokens; their hash is the leaf. Within a leaf, lines of `LONG` tokens or more that agree on
all quarters of their tokens but one have a template in common, the differing quarter being
a variable field: each line has four keys, one for each quarter left out, so a leaf may hold
any number of templates and no two lines are ever compared. A line or sentence of `LONG`
tokens or more recurs if it, or for a line one of its templates, is found in two documents;
a line of `SHORT` tokens or more also if it is found in `MANY`. What recurs is dropped but
for the document with the least id, so that no content is lost. Sentences catch passages
that stand amid other lines; they don't generalise, and those under `LONG` tokens stay. A
line with several templates is kept by the least document of any of them, so of a chain of
lines, each like the next, the first stays.

Units are counted as fixed-size hashes (64 bits, and the token count) with partial sums, and
neither texts nor a line's documents are ever gathered; a very common line is one row after
the partial sums. The recurring ones are broadcast if counted to be few enough, else joined
by a shuffle which Spark can split where it is skewed.

Defined cases: a null text stays null with 0 lines; an empty text is one empty line, which
is kept; a unit twice in a document counts as found in one; repeated document rows count as
one document; a null doc_id comes after all others and is never first unless alone; where a
sentence goes, its line's others are joined by one blank; an empty table gives an empty
result. `drop_recurring` keeps the columns of its input, and updates n_chars where there is
one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import stored, table

LEAD = 3
QUARTERS = 4
LONG, SHORT, MANY = 8, 3, 10
#: Recurring units that are broadcast at most.
BROADCAST_UNITS = 1_000_000
SENTENCE_END = r"(?<=[.!?])\x20+"
#: A piece ends with a word that ends in one of these letters, or after 12 words; pieces in a row with PASSAGE characters together are the least that recurs. FEW_PIECES mostly do.
PASSAGE, FEW_PIECES = 60, 4
PIECE = r"(?s)\s*+(?:\S++\s++){0,11}?\S*[nrsNRS][.,;:!?\"')]*+\s++|\s*+(?:\S++\s++){12}|.+"
FIELD = r"[^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*"
QUARTER = [f"q{k}" for k in range(QUARTERS)]


def tokens(line: Column) -> Column:
    low = F.regexp_replace(F.lower(line), r"[\x09-\x0D]", " ")
    masked = F.when(low.rlike("[0-9]"), F.regexp_replace(low, FIELD, "<*>")).otherwise(low)
    return F.array_remove(F.split(masked, " "), "")


def at_least(text: Column, n: int) -> Column:
    """Whether text has n tokens or more; looks no farther."""
    return text.rlike(rf"^(?:[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++){{{n}}}")


def row_key() -> list[Column]:
    """What tells a document row from others: its id and a hash of its text."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("__doc"), F.xxhash64("text").alias("__text")]


def _cut(line: Column) -> Column:
    return F.split(line, SENTENCE_END)


def parsed_units(docs: DataFrame) -> DataFrame:
    """A row per line, and per sentence of a line with several, of enough tokens: __doc, __text, pos, at, n, unit; leaf and quarters of long lines."""
    # the key in a projection of its own: beside an explode it would hash the text for every line
    lines = docs.select(*row_key(), F.split("text", "\n").alias("lines")).select("__doc", "__text", F.posexplode("lines").alias("pos", "raw")).withColumn("cut", _cut(F.col("raw")))
    # the line itself stands first, its sentences follow
    rows = lines.select("__doc", "__text", "pos", F.posexplode(F.when(F.size("cut") > 1, F.concat(F.array("raw"), "cut")).otherwise(F.array("raw"))).alias("at", "raw"))
    # on the text, since a filter on tokens would have them made twice
    rows = rows.where(at_least(F.col("raw"), LONG) | ((F.col("at") == 0) & at_least(F.col("raw"), SHORT)))
    cut = rows.withColumn("words", tokens(F.col("raw"))).drop("raw").withColumn("n", F.size("words"))
    tree = (F.col("at") == 0) & (F.col("n") >= LONG)
    ends = [F.floor(F.col("n") * k / QUARTERS).cast("int") for k in range(QUARTERS + 1)]
    return cut.select(
        "__doc",
        "__text",
        "pos",
        "at",
        "n",
        F.xxhash64("words").alias("unit"),
        F.when(tree, F.xxhash64("n", F.slice("words", 1, LEAD))).alias("leaf"),
        *[F.when(tree, F.xxhash64(F.slice("words", ends[k] + 1, ends[k + 1] - ends[k]))).alias(q) for k, q in enumerate(QUARTER)],
    )


def family_members(lines: DataFrame) -> DataFrame:
    """(unit, n, keeper) of the lines with a template that is found in several documents.

    lines(unit, n, leaf, q0 to q3, first, last): those alone in their leaf have no such template.
    """
    shared = lines.groupBy("leaf").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select("leaf")
    without = [F.xxhash64("leaf", F.lit(k), *[q for j, q in enumerate(QUARTER) if j != k]) for k in range(QUARTERS)]
    keyed = lines.join(shared, "leaf", "left_semi").select("unit", "n", "first", "last", F.explode(F.array(*without)).alias("family"))
    keyed = stored(keyed, "line-families")
    often = keyed.groupBy("family").agg(F.min("first").alias("keeper"), F.max("last").alias("last")).where("keeper < last").select("family", "keeper")
    return keyed.select("unit", "n", "family").join(often, "family").groupBy("unit", "n").agg(F.min("keeper").alias("keeper"))


def recurring(units: DataFrame) -> DataFrame:
    """(unit, n, keeper) of the units that recur, or whose template does; keeper is the document that keeps them."""
    long = units.where(F.col("n") >= LONG)
    # a line's leaf and quarters are the same wherever it stands, and null for a sentence
    per_unit = [F.min("__doc").alias("first"), F.max("__doc").alias("last"), *[F.max(c).alias(c) for c in ("leaf", *QUARTER)]]
    counted = stored(long.groupBy("unit", "n").agg(*per_unit).where("first < last or leaf is not null"), "line-counts")
    same = counted.where("first < last").select("unit", "n", F.col("first").alias("keeper"))
    alike = family_members(counted.where("leaf is not null"))
    # short lines count documents, each once
    short = units.where(F.col("n") < LONG).groupBy("unit", "n", "__doc").agg(F.lit(1).alias("one"))
    short = short.groupBy("unit", "n").agg(F.sum("one").alias("docs"), F.min("__doc").alias("keeper")).where(F.col("docs") >= MANY)
    return same.unionByName(alike).groupBy("unit", "n").agg(F.min("keeper").alias("keeper")).unionByName(short.select("unit", "n", "keeper"))


def let(value: Column, f) -> Column:
    """f(value), with value computed once for a row however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def without(items: Column, touched: Column, instead: Callable[[Column, Column], Column]) -> Column:
    """An array of arrays: the items between those that are touched, and what is `instead` (items, t) of each that is.

    touched is an array in order of `pos`, the place of an item from 0. Each item is copied once.
    """
    ahead = lambda i: F.when(i > 0, F.get(touched, i - 1)["pos"] + 1).otherwise(0)
    parts = F.transform(touched, lambda t, i: F.concat(F.slice(items, ahead(i) + 1, t["pos"] - ahead(i)), instead(items, t)))
    end = F.element_at(touched, -1)["pos"] + 1
    return F.concat(parts, F.array(F.slice(items, end + 1, F.size(items) - end)))


def left_of(lines: Column, t: Column) -> Column:
    """The touched line without its dropped sentences, as an array of one; of none where it goes as a whole, or nothing is left."""

    def rest(cut: Column) -> Column:
        places = F.transform(t["at"], lambda a: F.struct((a - 1).alias("pos")))
        kept = F.flatten(without(cut, places, lambda *_: F.slice(cut, 1, 0)))
        return F.when(F.size(kept) > 0, F.array(F.array_join(kept, " "))).otherwise(F.slice(lines, 1, 0))

    # the line itself is at 0, its sentences from 1 on
    return F.when(t["at"][0] == 0, F.slice(lines, 1, 0)).otherwise(let(_cut(F.get(lines, t["pos"])), rest))


def drop_recurring(docs: DataFrame) -> DataFrame:
    """docs with the recurring lines and sentences dropped, and n_lines and n_dropped (of both) beside their columns."""
    units = stored(parsed_units(docs), "lines")
    out = stored(recurring(units), "line-recurring")
    few = F.broadcast(out) if out.limit(BROADCAST_UNITS + 1).count() <= BROADCAST_UNITS else out
    places = units.select("__doc", "__text", F.struct("pos", "at").alias("place"), "unit", "n").join(few, ["unit", "n"]).where(F.col("__doc") != F.col("keeper"))
    # a row's dropped places, by line: each list in order
    at = places.groupBy("__doc", "__text", "place.pos").agg(F.array_sort(F.collect_set("place.at")).alias("at"))
    drops = at.groupBy("__doc", "__text").agg(F.array_sort(F.collect_list(F.struct("pos", "at"))).alias("__drop"))
    keyed = docs.select("*", *row_key()).join(drops, ["__doc", "__text"], "left")
    some = F.col("__drop").isNotNull()
    text = F.when(some, let(F.split("text", "\n"), lambda lines: F.array_join(F.flatten(without(lines, F.col("__drop"), left_of)), "\n"))).otherwise(F.col("text"))
    gone = F.aggregate(F.transform("__drop", lambda d: F.size(d["at"])), F.lit(0), lambda s, n: s + n)
    names = {c.lower(): c for c in docs.columns}
    made = keyed.withColumn("__new", text).withColumn("__lines", F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))).cast("long")).withColumn("__gone", F.coalesce(gone, F.lit(0)).cast("long"))
    columns = []
    for c in docs.columns:
        if c == names.get("text"):
            columns.append(F.col("__new").alias(c))
        elif c == names.get("n_chars"):
            columns.append(F.when(F.col("__gone") > 0, F.length("__new").cast("long")).otherwise(F.col(c)).alias(c))
        elif c.lower() not in ("n_lines", "n_dropped"):
            columns.append(F.col(c))
    return made.select(*columns, F.col("__lines").alias("n_lines"), F.col("__gone").alias("n_dropped"))


def pieces(text: Column) -> Column:
    """text and a blank, cut after the words that end in one of a few letters; end to end the pieces are both."""
    return F.regexp_extract_all(F.concat(text, F.lit(" ")), F.lit(PIECE), F.lit(0))


def windows(docs: DataFrame) -> DataFrame:
    """(__doc, __text, at, n, key): from each piece the fewest pieces with `PASSAGE` characters."""

    def keys(q: Column) -> Column:
        def long_window(i: Column) -> Column:
            """Of many short pieces, which are taken in one by one; each has a character at least."""
            nothing = F.struct(F.lit(0).alias("n"), F.lit(0).alias("k"), F.lit(0).cast("bigint").alias("h"))
            more = lambda s, y: F.when(s["n"] >= PASSAGE, s).otherwise(F.struct((s["n"] + y["n"]).alias("n"), (s["k"] + 1).alias("k"), F.xxhash64(s["h"], y["h"]).alias("h")))
            s = F.aggregate(F.slice(q, i + 1, PASSAGE), nothing, more)
            return let(s, lambda s: F.when(s["n"] >= PASSAGE, F.struct(i.alias("at"), s["k"].alias("n"), s["h"].alias("key"))))

        def window(x: Column, i: Column) -> Column:
            some = [x] + [F.get(q, i + k) for k in range(1, FEW_PIECES)]
            found = F.when(i + FEW_PIECES < F.size(q), long_window(i))
            for k in range(FEW_PIECES, 0, -1):
                key = F.xxhash64(*[y["h"] for y in some[:k]])
                enough = sum((y["n"] for y in some[1:k]), x["n"]) >= PASSAGE
                found = F.when(enough, F.struct(i.alias("at"), F.lit(k).alias("n"), key.alias("key"))).otherwise(found)
            return found

        return F.filter(F.transform(q, window), lambda x: x.isNotNull())

    # neither change moves a cut
    plain = F.lower(F.replace(F.col("text"), F.lit("\n"), F.lit(" ")))
    hashed = F.transform(pieces(plain), lambda x: F.struct(F.length(x).alias("n"), F.xxhash64(F.ltrim(x)).alias("h")))
    rows = docs.where("text is not null").select(*row_key(), let(hashed, keys).alias("all")).select("__doc", "__text", F.explode("all").alias("w"))
    return rows.select("__doc", "__text", "w.at", "w.n", "w.key")


def drop_passages(docs: DataFrame) -> DataFrame:
    """docs without the passages that an earlier document holds, wherever in a line they begin and end.

    The text is cut after words that end in certain letters, so that copies are cut alike
    whatever surrounds them. Pieces in a row with `PASSAGE` characters or more that are found in
    two documents are dropped but for the document with the least id. Of a passage only parts of
    a piece at its two ends may stay. Case and line breaks don't tell pieces apart; texts of
    which a passage goes lose the blanks at their end.
    """
    found = stored(windows(docs), "passages")
    often = found.groupBy("key").agg(F.min("__doc").alias("keeper"), F.max("__doc").alias("last")).where("keeper < last").select("key", "keeper")
    often = stored(often, "passage-recurring")
    few = F.broadcast(often) if often.limit(BROADCAST_UNITS + 1).count() <= BROADCAST_UNITS else often
    gone = found.join(few, "key").where(F.col("__doc") != F.col("keeper")).select("__doc", "__text", "at", (F.col("at") + F.col("n")).alias("end")).distinct()
    # what stays: from where all before has ended to the next passage, and after the last
    before = W.partitionBy("__doc", "__text").orderBy("at", "end").rowsBetween(W.unboundedPreceding, -1)
    stays = gone.withColumn("from", F.coalesce(F.max("end").over(before), F.lit(0)))
    piece = F.when(F.col("at") > F.col("from"), F.struct("from", F.col("at").alias("to")))
    kept = stays.groupBy("__doc", "__text").agg(F.array_sort(F.collect_list(piece)).alias("__stay"), F.max("end").alias("__end"))
    kept = stored(kept, "passage-places")
    keyed = docs.select("*", *row_key()).join(kept, ["__doc", "__text"], "left")

    def rest(p: Column) -> Column:
        parts = F.transform("__stay", lambda k: F.array_join(F.slice(p, k["from"] + 1, k["to"] - k["from"]), ""))
        return F.rtrim(F.concat(F.array_join(parts, ""), F.array_join(F.slice(p, F.col("__end") + 1, F.size(p)), "")))

    some = F.col("__end").isNotNull()
    made = keyed.withColumn("__new", F.when(some, let(pieces(F.col("text")), rest)).otherwise(F.col("text")))
    names = {c.lower(): c for c in docs.columns}
    swapped = {names.get("text"): F.col("__new"), names.get("n_chars"): F.when(some, F.length("__new").cast("long")).otherwise(F.col(names.get("n_chars", "text")))}
    return made.select(*[swapped.get(c, F.col(c)).alias(c) for c in docs.columns])


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = drop_recurring(table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"))


def _sql() -> str:
    quarter = [f"array_to_string(w[(n * {k} // 4) + 1:(n * {k + 1} // 4)], ' ')" for k in range(4)]
    keys = ", ".join("[n::VARCHAR, array_to_string(w[1:3], ' '), '{}', {}]".format(k, ", ".join(q for j, q in enumerate(quarter) if j != k)) for k in range(4))
    return rf"""
WITH raw AS (
  SELECT doc_id, unnest(range(0, len(l))) AS pos, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)
), cut AS (
  SELECT doc_id, pos, line, string_split(regexp_replace(line, '([.!?])\x20+', '\1' || chr(31), 'g'), chr(31)) AS s FROM raw
), piece AS (
  SELECT doc_id, pos, unnest(range(0, len(s))) AS nth, unnest(s) AS line, len(s) AS pieces FROM cut
), both_kinds AS (
  SELECT doc_id, pos, -1 AS nth, line FROM cut UNION ALL SELECT doc_id, pos, nth, line FROM piece WHERE pieces > 1
), tok AS (
  SELECT doc_id, pos, nth, regexp_extract_all(regexp_replace(lower(line), '[^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*', '<*>', 'g'), '[^\x20\x09-\x0D]+') AS w FROM both_kinds
), l AS (
  SELECT doc_id, pos, nth, len(w) AS n, w, array_to_string(w, ' ') AS unit FROM tok WHERE len(w) >= 8 OR (nth = -1 AND len(w) >= 3)
), c AS (
  SELECT unit, min(doc_id) AS first, max(doc_id) AS last FROM l WHERE n >= 8 GROUP BY unit
), f AS (
  SELECT DISTINCT unit, doc_id, unnest([{keys}]) AS family FROM l WHERE n >= 8 AND nth = -1
), g AS (
  SELECT family, min(c.first) AS keeper FROM f JOIN c USING (unit) GROUP BY family HAVING min(c.first) < max(c.last)
), r AS (
  SELECT unit, min(keeper) AS keeper FROM (
    SELECT unit, first AS keeper FROM c WHERE first < last UNION ALL SELECT unit, keeper FROM f JOIN g USING (family)
  ) GROUP BY unit
  UNION ALL SELECT unit, min(doc_id) FROM l WHERE n < 8 GROUP BY unit HAVING count(DISTINCT doc_id) >= 10
), x AS (
  SELECT DISTINCT l.doc_id, l.pos, l.nth FROM l JOIN r USING (unit) WHERE l.doc_id <> r.keeper
), gone AS (SELECT doc_id, count(*) AS n FROM x GROUP BY doc_id),
stay AS (
  SELECT doc_id, pos, string_agg(line, ' ' ORDER BY nth) AS line, count(*) AS n FROM piece p
  WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.doc_id = p.doc_id AND x.pos = p.pos AND (x.nth = -1 OR x.nth = p.nth)) GROUP BY doc_id, pos
), left_over AS (
  SELECT stay.doc_id, string_agg(CASE WHEN stay.n = len(cut.s) THEN cut.line ELSE stay.line END, chr(10) ORDER BY stay.pos) AS text FROM stay JOIN cut USING (doc_id, pos) GROUP BY stay.doc_id
)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN 0 ELSE len(string_split(d.text, chr(10))) END::BIGINT AS n_lines,
  coalesce(g.n, 0)::BIGINT AS n_dropped, sha256(coalesce(o.text, '')) AS text_sha256
FROM documents d LEFT JOIN left_over o USING (doc_id) LEFT JOIN gone g USING (doc_id)
"""


ORACLE_SQL = _sql()
