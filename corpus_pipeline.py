"""From raw documents to token ids: quality, near and exact duplicates, mixing, encoding. Each stage reads what the one
before it kept, written as Parquet between them."""

from __future__ import annotations

import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, mixing, quality, rlz, similar
from tessera.llm.common import discard, settle, shared_folder
from tessera.llm.queries import MIX_WEIGHTS, RANKS, mix_levels, n_words

#: Documents scored under this by the quality classifier go.
QUALITY = 0.7


def _free(docs: DataFrame, *names: str) -> list[str]:
    """Column names that docs doesn't have (whatever their case), made from these."""
    there = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name in there:
            name += "_"
        out.append(name)
    return out


def _named(docs: DataFrame, name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


#: Rows that stay side by side: what a stage decides comes to them, so that texts aren't shuffled again.
PART = 4096


class Rows:
    """The rows of a table, written once, with a key each (ids may be null or repeated, with different texts), a hash of all
    columns, which decides ties alike in every run, and the part that a row lies in. The names of these columns."""

    def __init__(self, docs: DataFrame):
        self.columns, self.schema = docs.columns, docs.schema
        self.key, self.content, self.part = _free(docs, "tessera_key", "tessera_content", "tessera_part")
        hashed = F.xxhash64(*(x for c in docs.columns for x in (_named(docs, c), _named(docs, c).isNull())))
        keyed = docs.select("*", hashed.alias(self.content), F.monotonically_increasing_id().alias(self.key))
        self.table = settle(keyed.withColumn(self.part, F.floor(F.col(self.key) / PART)), by=self.part)

    def changed(self, decided: DataFrame, then) -> DataFrame:
        """then(rows, decisions) on each part, as Arrow tables. decided: a column `k` (keys) and others."""
        key, columns = self.key, self.columns

        def run(rows: pa.Table, decisions: pa.Table) -> pa.Table:
            return then(rows, rows.column(key), decisions).select(columns)

        decided = decided.withColumn("part", F.floor(F.col("k") / PART))
        rows = self.table.select(*(_named(self.table, c) for c in (*columns, key, self.part)))
        return rows.groupBy(self.part).cogroup(decided.groupBy("part")).applyInArrow(run, self.schema)

    def without(self, keys: DataFrame) -> DataFrame:
        return self.changed(keys, lambda rows, key, gone: rows.filter(pc.invert(pc.is_in(key, gone.column("k")))))

    def only(self, keys: DataFrame) -> DataFrame:
        return self.changed(keys, lambda rows, key, kept: rows.filter(pc.is_in(key, kept.column("k"))))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine, fitted on the labels, scores at least QUALITY."""
    machine = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    (score,) = _free(docs, "tessera_score")
    return docs.withColumn(score, quality.quality_column(spark, machine, F.col("text"))).where(F.col(score) >= QUALITY).drop(score)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (linked by the fingerprints of SimHash or, where these miss them, by their shingles; in
    either case of 5-word shingles with a similarity of 0.8 or more, compared exactly) the row with the least id (null: after
    all others; equal ids: by the hash of the row). Rows are told apart by a key of their own, so that those of null or
    repeated ids stay if their texts differ. Rows without a word aren't near-duplicates of each other."""
    rows = Rows(docs)
    found = similar.similar_groups(rows.table.select(F.col(rows.key).alias("doc_id"), "text"), k=5, least=0.8).select(F.col("doc_id").alias("k"), "component_id")
    given = rows.table.select(F.col(rows.key).alias("k"), F.col("doc_id").isNull().alias("none"), "doc_id", F.col(rows.content).alias("h"))
    found = settle(found.join(given, "k"))
    first = found.groupBy("component_id").agg(F.min(F.struct("none", "doc_id", "h", "k")).alias("first"))
    return rows.without(found.select("k").join(first.select("first.k"), "k", "left_anti"))


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that documents with smaller ids hold go (null: after all others; rows of equal or null id don't
    count for each other); a document all of whose words go, goes. Results come back to rows by id and text."""
    rows, spent = Rows(docs), []
    cut = rlz.dedupe(rows.table.select("doc_id", "text", F.col(rows.key).cast("string").alias("row")), layout=True, row="row", spent=spent)
    cut = settle(cut.where("n_removed > 0").select(F.col("row").cast("long").alias("k"), F.when(F.col("n_removed") < F.col("n_words"), F.col("text")).alias("t")))
    discard(*spent)  # what stays are the texts that lost words (null: all of them)

    def put(table: pa.Table, key: pa.ChunkedArray, changed: pa.Table) -> pa.Table:
        at = pc.index_in(key, changed.column("k"))
        there, new = pc.is_valid(at), changed.column("t").combine_chunks().take(pc.fill_null(at, 0)) if len(changed) else pa.nulls(len(key), pa.string())
        text = pc.if_else(there, new, table.column("text"))
        keep = pc.invert(pc.and_(there, pc.is_null(new)))
        for name, values in (("text", text), ("n_chars", pc.utf8_length(text))):
            if name in table.column_names:
                i = table.column_names.index(name)
                table = table.set_column(i, table.schema.field(i), values.cast(table.schema.field(i).type))
        return table.filter(keep)

    return rows.changed(cut, put)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Four fifths of all tokens, by the weights of domains, languages and sources, each row once at most (by a key of its
    own, whatever its id)."""
    rows = Rows(docs)
    taken = mixing.mix(rows.table, mix_levels(), n_words(F.col("text")), MIX_WEIGHTS, share=0.8, epochs=1, seed=42, carried=(rows.content, rows.key))
    return rows.only(taken.select(F.col(rows.key).alias("k")))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and token ids."""
    return bpe.encode(docs, bpe.load_ranks(RANKS), public_tokenizers.PATTERN).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("quality", keep_quality), ("near_duplicates", drop_near_duplicates), ("repeated_passages", drop_repeated_passages), ("mixing", mix_sources), ("encoding", encode)]
#: Classifiers, fingerprints and the merges of a vocabulary aren't SQL: tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. A stage's table goes when the next has been written, the last one's when the application
    ends."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base, before = shared_folder(spark), None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{base}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:
            discard(before)
        before = docs
    return docs
