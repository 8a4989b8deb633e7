"""Token counts as delta-maintained rollups by source, language and tokenizer version.

A batch of changes holds signed rows: an insert adds a document and its tokens, a delete
takes both away, a revision adds the new count and takes away the old. A commit sums the
batch per group, before and after the shuffle, writes the sums to a folder of their own, and
then names that folder in the manifest, a small file that is replaced as a whole. Until then
nothing has changed, so a writer lost half-way leaves the totals as they were; committing a
batch id again replaces its sums. Totals are the sums over the folders named; groups left
without documents or tokens go. `compact` folds the open batches into one folder; their ids
are closed then: committing one again changes nothing, and says so. There is one writer at a
time.

Defined cases: a null source or language is a group of its own; a null text has no tokens;
a document inserted twice counts twice, so callers give each change once per batch id; an
empty batch commits nothing; extra columns of a batch are ignored; any text is a batch id; a
text of any length counts, also runs of blanks, letters or marks as long as it.
In the query a text's copies are withdrawn but for that of the least doc_id, those without an
id only if another has one.
"""

from __future__ import annotations

import base64
import json
import uuid
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .mixing import n_words
from .shared import fold, shared_dir, shipped, stored, table

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The tokenizer's file is broadcast; larger ones are refused.
MAX_TOKENIZER_BYTES = 64 << 20
# fixed value: how this tokenizer cuts a text before merging
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters of white space in a row beyond which a run is counted by itself.
LONG_BLANKS = 20_000
_BLANK_RUN = regex.compile(rf"\p{{White_Space}}{{{LONG_BLANKS},}}+")
GROUP = ("source", "lang", "tokenizer_version")
BATCHES = 4
#: What a revision takes out of texts: marks repeated.
RUNS = r"[!#$%&*|]{2,}"

_encoders: dict[str, object] = {}


def _encoder(name: str, file: bytes):
    if name not in _encoders:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file.splitlines() if line)}
        _encoders[name] = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[name]


def n_tokens(encoder, text: str) -> int:
    """The number of tokens of a text.

    The pattern's look-ahead ends the process on a run of white space that is much longer than
    `LONG_BLANKS`. Such a run is one piece, but for its last character where a word follows, so
    it is merged by itself, which gives the same tokens.
    """
    count = at = 0
    if len(text) > LONG_BLANKS:
        for run in _BLANK_RUN.finditer(text):
            end = run.end() - (run.end() < len(text))
            count += len(encoder.encode_ordinary(text[at : run.start()])) + len(encoder._encode_single_piece(text[run.start() : end]))
            at = end
    return count + len(encoder.encode_ordinary(text[at:]))


def with_token_counts(docs: DataFrame, column: str = "text", *, tokenizer: str = TOKENIZER) -> DataFrame:
    """docs with n_tokens in place of the text column."""
    shipped(docs.sparkSession)
    path = Path(tokenizer)
    if path.stat().st_size > MAX_TOKENIZER_BYTES:
        raise ValueError(f"{tokenizer} is larger than {MAX_TOKENIZER_BYTES} bytes")
    held = docs.sparkSession.sparkContext.broadcast((path.stem, path.read_bytes()))
    rest = [f for f in docs.schema.fields if f.name not in (column, "n_tokens")]
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in rest], "n_tokens bigint"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(*held.value)
        for batch in batches:
            names = batch.schema.names
            counts = [n_tokens(encoder, t) if (t := x.as_py()) else 0 for x in batch.column(names.index(column))]
            yield pa.RecordBatch.from_arrays([*[batch.column(names.index(f.name)) for f in rest], pa.array(counts, pa.int64())], [*[f.name for f in rest], "n_tokens"])

    return docs.mapInArrow(run, schema)


def inserted(counted: DataFrame, sign: int = 1) -> DataFrame:
    """Signed rows of whole documents: sign 1 inserts, -1 deletes."""
    return counted.select(*GROUP, F.lit(sign).cast("long").alias("docs"), (F.col("n_tokens") * sign).alias("tokens"))


def revised(old: Column, new: Column) -> list[Column]:
    return [F.lit(0).cast("long").alias("docs"), (new - old).alias("tokens")]


class Rollup:
    """Totals kept as folders of sums and a manifest of those that count, in the shared folder or at `path`."""

    SCHEMA = "source string, lang string, tokenizer_version string, docs long, tokens long"

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or f"{shared_dir(spark)}/token-rollup-{uuid.uuid4().hex}"
        self._fs, self._conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()

    def _at(self, name: str):
        return self._fs.Path(f"{self.path}/{name}")

    def manifest(self) -> dict:
        """base: a folder or null; closed: ids in the base; open: folders by id."""
        where = self._at("manifest")
        if not where.getFileSystem(self._conf).exists(where):
            return {"base": None, "closed": [], "open": {}}
        return json.loads(self.spark.read.text(where.toString(), wholetext=True).first()[0])

    def _swap(self, manifest: dict) -> None:
        new, where = self._at(f"manifest-{uuid.uuid4().hex}"), self._at("manifest")
        out = new.getFileSystem(self._conf).create(new, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        rename = getattr(self._fs, "Options$Rename")
        options = self.spark._sc._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        self._fs.FileContext.getFileContext(where.getFileSystem(self._conf).getUri(), self._conf).rename(new, where, options)

    def _written(self, sums: DataFrame) -> str:
        name = f"sums-{uuid.uuid4().hex}"
        sums.write.parquet(f"{self.path}/{name}")
        return name

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Write the batch's sums by group; the same batch_id again replaces them. False, and nothing changed, where compaction has closed that id."""
        if batch_id in self.manifest()["closed"]:
            return False
        name = self._written(changes.groupBy(*GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")))
        now = self.manifest()
        self._swap(now | {"open": now["open"] | {batch_id: name}})
        return True

    def _sums(self) -> DataFrame:
        now = self.manifest()
        names = [*([now["base"]] if now["base"] else []), *now["open"].values()]
        if not names:
            return self.spark.createDataFrame([], self.SCHEMA)
        return self.spark.read.schema(self.SCHEMA).parquet(*[f"{self.path}/{n}" for n in names])

    def compact(self) -> None:
        now = self.manifest()
        sums = self._sums().groupBy(*GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        self._swap({"base": self._written(sums), "closed": [*now["closed"], *now["open"]], "open": {}})

    def totals(self) -> DataFrame:
        sums = self._sums().groupBy(*GROUP).agg(F.sum("docs").alias("n_docs"), F.sum("tokens").alias("n_tokens"))
        return sums.where("n_docs <> 0 or n_tokens <> 0")


def copies(rows: DataFrame, firsts: DataFrame) -> DataFrame:
    """The rows whose text (by `print`) has a first document that they aren't."""
    return rows.join(firsts, "print").where(F.col("first").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("first")))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loads all documents in batches, revises those with runs of marks, withdraws exact copies; repeats a commit.

    Counts stand by two tokenizer versions: the byte-level one and plain words.
    """
    return kept_up(table(spark, sf_dir, "documents")).totals()


def kept_up(docs: DataFrame) -> Rollup:
    """The rollup of docs after the query's batches."""
    docs = docs.select("doc_id", "source", "lang", "text")
    plain = F.regexp_replace("text", RUNS, "")
    whole = docs.select("doc_id", "source", "lang", F.md5(F.col("text").cast("binary")).alias("print"), fold(BATCHES).alias("part"), n_words(F.col("text")).alias("words"), "text")
    counts = stored(with_token_counts(whole), "token-counts")
    # by text: copies have one revision
    again = docs.where(F.col("text").rlike(RUNS)).select(F.md5(F.col("text").cast("binary")).alias("print"), plain.alias("text")).distinct()
    renewed = stored(with_token_counts(again.withColumn("words", n_words(F.col("text")))), "token-counts-renewed")
    renewed = renewed.select("print", F.col("n_tokens").alias("new_tokens"), F.col("words").alias("new_words"))
    both = F.explode(
        F.array(
            F.struct(F.lit(Path(TOKENIZER).stem).alias("tokenizer_version"), F.col("n_tokens").alias("n"), F.col("new_tokens").alias("new")),
            F.struct(F.lit("words").alias("tokenizer_version"), F.col("words").alias("n"), F.col("new_words").alias("new")),
        )
    )
    rows = counts.join(renewed, "print", "left").select("doc_id", "source", "lang", "print", "part", both.alias("v")).select("*", "v.*").drop("v").withColumnRenamed("n", "n_tokens")
    firsts = counts.where(F.col("print").isNotNull()).groupBy("print").agg(F.min("doc_id").alias("first"))

    rollup = Rollup(docs.sparkSession)
    for k in range(BATCHES):
        rollup.commit(f"load/{k}", inserted(rows.where(F.col("part") == k)))
    rollup.commit("revise", rows.where(F.col("new").isNotNull()).select(*GROUP, *revised(F.col("n_tokens"), F.col("new"))))
    firsts = stored(firsts, "token-firsts")
    gone = inserted(copies(rows.withColumn("n_tokens", F.coalesce("new", "n_tokens")), firsts), -1)
    for _ in range(2):  # the second changes nothing
        rollup.commit("withdraw", gone)
    rollup.compact()
    return rollup
