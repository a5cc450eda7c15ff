"""Token totals kept up to date by signed deltas.

Totals by source, language and tokenizer version are sums over committed batches. A batch
is a small table of signed sums: documents added count +1 and their tokens, documents
removed the same with a minus, a revised count both. A batch is written beside the others
under a name of its own and becomes part of the totals by renaming a marker into place,
which fails if the batch was committed before. So a batch that is sent again, or whose
writer was lost half-way, changes nothing.
"""

from __future__ import annotations

import base64
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowtrail.session import stage

KEYS = ("source", "lang", "tokenizer")
TOTALS = "source string, lang string, tokenizer string, docs long, tokens long"
TOKENIZERS = "/opt/tokenizers"
#: How the public byte-level vocabularies cut a text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


def ranks_file(name: str, folder: str = TOKENIZERS) -> bytes:
    with open(f"{folder}/{name}.tiktoken", "rb") as f:
        return f.read()


def counter(files: dict[str, bytes]):
    """For rows of (row columns, text, tokenizer): the number of tokens under the named tokenizer."""

    def count(batches):
        import tiktoken

        known = {}

        def encoding(name):
            if name not in known:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, files[name].splitlines())}
                known[name] = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
            return known[name]

        for batch in batches:
            tokens = [
                len(encoding(name).encode_ordinary(text)) if isinstance(text, str) and text else 0
                for text, name in zip(batch["text"].tolist(), batch["tokenizer"].tolist())
            ]
            yield batch.drop(columns="text").assign(tokens=tokens)

    return count


def counted(rows: DataFrame, files: dict[str, bytes]) -> DataFrame:
    """``rows`` (any columns, text, tokenizer) with ``tokens`` for ``text``; null and empty texts have 0."""
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "text")
    return rows.mapInPandas(counter(files), f"{kept}, tokens long")


def signed(rows: DataFrame, sign: int, tokens: str = "tokens") -> DataFrame:
    """Deltas of rows (source, lang, tokenizer, ``tokens``) that come (+1) or go (-1)."""
    return rows.groupBy(*KEYS).agg((F.count("*") * sign).alias("docs"), (F.sum(tokens) * sign).alias("tokens"))


def added(*deltas: DataFrame) -> DataFrame:
    """The sum of deltas; keys that come to nothing are left out."""
    every = reduce(DataFrame.unionByName, deltas)
    return every.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs != 0 or tokens != 0")


class Rollup:
    """Totals in a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        jvm = spark._jvm
        self.path = jvm.org.apache.hadoop.fs.Path
        conf = spark._jsc.hadoopConfiguration()
        self.files = self.path(folder).getFileSystem(conf)
        self.context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.files.getUri(), conf)
        self.no_options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        self.files.mkdirs(self.path(f"{folder}/commits"))

    def commit(self, batch: str, deltas: DataFrame) -> bool:
        """Adds a batch of deltas; False, and no change, if it was committed before."""
        if self.files.exists(self.path(f"{self.folder}/commits/{batch}")):
            return False
        data = f"{self.folder}/data/{batch}-{uuid.uuid4().hex[:12]}"
        deltas.select(*KEYS, F.col("docs").cast("long"), F.col("tokens").cast("long")).write.parquet(data)
        mark = self.path(f"{data}.commit")
        out = self.files.create(mark)
        out.write(bytearray(data.rsplit("/", 1)[1].encode()))
        out.close()
        try:
            self.context.rename(mark, self.path(f"{self.folder}/commits/{batch}"), self.no_options)
        except Exception as error:
            if "AlreadyExists" not in str(error):
                raise
            return False
        return True

    def totals(self) -> DataFrame:
        """Totals over all committed batches."""
        marks = self.files.listStatus(self.path(f"{self.folder}/commits"))
        names = [
            bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
            for stream in (self.files.open(x.getPath()) for x in marks)
        ]
        reader = self.spark.read.schema(TOTALS)
        rows = reader.parquet(*[f"{self.folder}/data/{n}" for n in names]) if names else self.spark.createDataFrame([], TOTALS)
        return added(rows)


def history(docs: DataFrame, files: dict[str, bytes], base: str, other: str, plain: str = "en") -> dict[str, DataFrame]:
    """Four batches over all of ``docs`` (doc_id, text, lang, source), by name, in order.

    All documents arrive, counted with ``base``; exact copies of a text leave, the smallest
    id stays; documents with runs of blanks are counted anew without them; documents in
    other languages than ``plain`` move to the tokenizer ``other``.

    Null texts have 0 tokens and are copies of each other; null sources and languages are
    groups of their own (a null language moves); repeated rows are copies. An empty table
    gives batches without rows.
    """
    tidy = F.trim(F.regexp_replace("text", "[\\x20\\x09]+", " "))
    text = docs.select("doc_id", "source", "lang", "text", F.xxhash64("text").alias("key1"), F.hash("text").alias("key2"), F.length("text").alias("n"))
    moves = ~F.col("lang").eqNullSafe(plain)
    versions = text.select(
        "doc_id", "source", "lang", "key1", "key2", "n",
        F.explode(F.array_compact(F.array(
            F.struct(F.lit("old").alias("kind"), F.lit(base).alias("tokenizer"), F.col("text").alias("text")),
            F.when(~tidy.eqNullSafe(F.col("text")), F.struct(F.lit("tidy").alias("kind"), F.lit(base).alias("tokenizer"), tidy.alias("text"))),
            F.when(moves, F.struct(F.lit("moved").alias("kind"), F.lit(other).alias("tokenizer"), tidy.alias("text"))),
        ))).alias("v"),
    ).select("doc_id", "source", "lang", "key1", "key2", "n", "v.kind", "v.tokenizer", "v.text")
    counts = stage(counted(versions, files), "token_versions")
    same = ["key1", "key2", "n"]
    old = counts.where("kind = 'old'")
    # A copy is any row but one of the smallest id; rows that are alike in all leave one.
    first = old.groupBy(*same).agg(
        F.min(F.struct("doc_id", "source", "lang", "tokens")).alias("f")
    ).select(F.col("f.source").alias("source"), F.col("f.lang").alias("lang"), F.lit(base).alias("tokenizer"), "f.tokens", "f.doc_id", *same)
    first = stage(first, "first_copies")
    alike = [F.col(f"o.{c}").eqNullSafe(F.col(f"f.{c}")) for c in ("doc_id", "source", "lang", *same)]
    newer = counts.where("kind != 'old'").select("doc_id", "source", "lang", *same, "kind", "tokens").distinct()
    kept = (
        first.alias("f").join(newer.where("kind = 'tidy'").alias("o"), reduce(lambda a, b: a & b, alike), "left")
        .select("f.*", F.col("o.tokens").alias("tidy"))
    )
    kept = stage(kept, "revised")
    moved = (
        kept.alias("f").join(newer.where("kind = 'moved'").alias("o"), reduce(lambda a, b: a & b, alike))
        .select("f.source", "f.lang", "f.tokenizer", F.coalesce("f.tidy", "f.tokens").alias("gone"), F.col("o.tokens").alias("tokens"))
    )
    moved = stage(moved, "moved")
    revised = kept.where("tidy is not null")
    return {
        "1-arrive": signed(old, 1),
        "2-copies-leave": added(signed(old, -1), signed(first, 1)),
        "3-revised": added(signed(revised, -1), signed(revised, 1, "tidy")),
        "4-moved": added(signed(moved, -1, "gone"), signed(moved.withColumn("tokenizer", F.lit(other)), 1)),
    }
