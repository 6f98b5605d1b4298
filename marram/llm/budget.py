"""Token budget per source and language.

Method: a count table keyed by content hash and tokenizer hash; only contents that are
not in it are encoded. Cubes of totals are kept up to date by signed deltas, from a
whole new state of the collection or from a change set, so removed documents are
subtracted and a change of label moves tokens without encoding anything. The state can
be saved and loaded by another process.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marram.llm.tokenizers import Tokenizer
from marram.storage import write_through

UNKNOWN = "unknown"
LABELS = ("source", "language", "domain")
#: Hashes that a task remembers, so that it encodes no text twice.
SEEN_A_TASK = 1_000_000


def plain_label(c: Column) -> Column:
    """Lower case without white space around; unknown for null, empty and ``und``."""
    x = F.lower(F.trim(F.regexp_replace(c, r"^[\s ]+|[\s ]+$", "")))
    return F.when(x.isNull() | x.isin("", "und", "none", "null"), UNKNOWN).otherwise(x)


def plain_language(c: Column) -> Column:
    """A plain label without region or script: ``en-US`` and ``EN`` become ``en``."""
    return F.element_at(F.split(plain_label(c), "[-_]"), 1)


def label_chunks(chunks: DataFrame, domains: DataFrame) -> DataFrame:
    """``doc, content, source, language, domain`` of chunks.

    The domain belongs to the first segment of the file path, or of the id where the
    path is null; directories without a domain are ``other``. ``domains`` has one row
    a directory and is small by nature; the planner may broadcast it by its size.
    """
    path = F.coalesce("metadata.file_path", "metadata.file", F.element_at(F.split("id", "::"), 1))
    d = domains.groupBy(F.col("top_dir").alias("dir")).agg(F.min("domain").alias("known"))
    return (
        chunks.select(
            F.col("chunk_no").cast("string").alias("doc"),
            "content",
            plain_label(F.col("source")).alias("source"),
            plain_language(F.col("metadata.language")).alias("language"),
            F.element_at(F.split(path, "/"), 1).alias("dir"),
        )
        .join(d, "dir", "left")
        .select("doc", "content", "source", "language", F.when(F.col("dir").isNull(), UNKNOWN).otherwise(F.coalesce("known", F.lit("other"))).alias("domain"))
    )


def _folders(spark: SparkSession, path: str) -> list[str]:
    """Names of saved states below ``path`` that are complete, oldest first."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    done = lambda n: fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/cube/_SUCCESS"))
    return sorted(n for n in names if n.startswith("state-") and done(n))


class TokenBudget:
    """The count table, the last state and the cube; each step returns a new one.

    Contents are known by a 128-bit hash; null contents hold no tokens but count as
    documents. Frames are written to the shared folder, so a chain of steps has no
    growing lineage; :meth:`save` keeps them beyond the session. Texts never move:
    hashes do, and a task encodes a text once however often it meets it.
    """

    def __init__(self, tokenizer: Tokenizer, counts: DataFrame | None = None, members: DataFrame | None = None, cube: DataFrame | None = None) -> None:
        self.tokenizer, self.counts, self.members, self.cube = tokenizer, counts, members, cube
        #: Counts that the last step added.
        self.fresh: DataFrame | None = None

    @classmethod
    def load(cls, spark: SparkSession, path: str, tokenizer: Tokenizer) -> "TokenBudget":
        """The last complete state saved below ``path``; an empty budget where there is none.

        Counts of other tokenizers stay in the table. The cube and the members belong to
        the tokenizer they were saved with; under another one the budget starts anew,
        with the counts.
        """
        states = _folders(spark, path)
        if not states:
            return cls(tokenizer)
        counts, members, cube = (spark.read.parquet(f"{path}/{states[-1]}/{n}") for n in ("counts", "members", "cube"))
        own = cube.where(F.col("tokenizer") == tokenizer.key).limit(1).count() or not cube.limit(1).count()
        return cls(tokenizer, counts, members, cube.drop("tokenizer")) if own else cls(tokenizer, counts)

    def save(self, path: str) -> str:
        """Writes the state into a new folder below ``path``; earlier states are left as they are."""
        spark = self.members.sparkSession
        states = _folders(spark, path)
        folder = f"{path}/state-{int(states[-1][6:]) + 1 if states else 1:06d}"
        self.counts.write.mode("overwrite").parquet(f"{folder}/counts")
        self.members.write.mode("overwrite").parquet(f"{folder}/members")
        self.cube.withColumn("tokenizer", F.lit(self.tokenizer.key)).write.mode("overwrite").parquet(f"{folder}/cube")
        return folder

    def _encode(self, contents: DataFrame) -> DataFrame:
        """``hash, n_tokens, tokenizer`` of contents, each once."""
        tokenizer = self.tokenizer
        vocabulary = contents.sparkSession.sparkContext.broadcast(tokenizer.data)
        ddl = "hash binary, n_tokens long"

        def run(batches):
            import pyarrow as pa

            count, seen = tokenizer.counter(vocabulary.value), set()
            for b in batches:
                hashes, n = [], []
                for h, t in zip(b.column(0).to_pylist(), b.column(1)):
                    if h not in seen:
                        if len(seen) > SEEN_A_TASK:
                            seen.clear()
                        seen.add(h)
                        hashes.append(h)
                        n.append(count(t.as_py()))
                yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.binary()), pa.array(n, pa.int64())], names=["hash", "n_tokens"])

        return contents.mapInArrow(run, ddl).groupBy("hash").agg(F.first("n_tokens").alias("n_tokens")).withColumn("tokenizer", F.lit(tokenizer.key))

    def _step(self, present: DataFrame, replaced: DataFrame | None, kept: DataFrame | None) -> "TokenBudget":
        """Adds the rows of ``present`` and subtracts the members ``replaced``; ``kept`` are members that stay as they are."""
        hashed = F.when(F.col("content").isNotNull(), F.unhex(F.md5("content")))
        now = present.select("doc", *LABELS, hashed.alias("hash"), "content")
        added = write_through(now.drop("content"), "token-members")
        texts = now.where("hash is not null").select("hash", "content")
        if self.counts is not None:
            known = self.counts.where(F.col("tokenizer") == self.tokenizer.key).select("hash")
            unseen = write_through(added.where("hash is not null").select("hash").distinct().join(known, "hash", "left_anti"), "token-unseen")
            # the planner broadcasts the hashes if they are few
            texts = texts.join(unseen, "hash", "left_semi")
        fresh = write_through(self._encode(texts), "token-counts")
        counts = fresh if self.counts is None else self.counts.unionByName(fresh)
        signed = added.select("doc", *LABELS, "hash", F.lit(1).alias("sign"))
        if replaced is not None:
            before = replaced.select("doc", *LABELS, "hash", F.lit(-1).alias("sign"))
            # what did not change cancels out before it meets the counts
            signed = signed.unionByName(before).groupBy("doc", *LABELS, "hash").agg(F.sum("sign").alias("sign")).where("sign <> 0")
        # per content and labels first: a content copied a million times meets its count once
        grouped = signed.groupBy(*LABELS, "hash").agg(F.sum("sign").alias("docs"), F.sum(F.when(F.col("sign") > 0, F.col("sign")).otherwise(0)).alias("plus"))
        lengths = counts.where(F.col("tokenizer") == self.tokenizer.key).select("hash", "n_tokens")
        n, minus = F.coalesce("n_tokens", F.lit(0)), F.col("plus") - F.col("docs")
        delta = (
            grouped.join(lengths, "hash", "left")
            .groupBy(*LABELS)
            .agg(
                F.sum("docs").alias("n_docs"),
                F.sum(F.col("docs") * n).alias("n_tokens"),
                F.sum("plus").alias("added_docs"),
                F.sum(minus).alias("removed_docs"),
                F.sum(minus * n).alias("removed_tokens"),
            )
        )
        sums = [c for c in delta.columns if c not in LABELS]
        both = delta if self.cube is None else self.cube.unionByName(delta)
        cube = both.groupBy(*LABELS).agg(*(F.sum(c).alias(c) for c in sums))
        members = added if kept is None else write_through(kept.select(*added.columns).unionByName(added), "token-members")
        out = TokenBudget(self.tokenizer, counts, members, write_through(cube, "token-cube"))
        out.fresh = fresh
        return out

    def update(self, present: DataFrame) -> "TokenBudget":
        """The budget after the collection became ``present``: ``doc, content`` and the labels.

        ``doc`` identifies a document; a document stored twice counts twice. Whatever
        is no longer in ``present`` is subtracted.
        """
        return self._step(present, self.members, None)

    def change(self, changed: DataFrame, removed: DataFrame | None = None) -> "TokenBudget":
        """The budget after a change set: ``changed`` replaces all rows of its documents, ``removed`` has a ``doc`` column.

        The collection itself is not read. Documents that were never there are new; a
        removal of an unknown document changes nothing.
        """
        if self.members is None:
            return self._step(changed, None, None)
        touched = changed.select("doc") if removed is None else changed.select("doc").unionByName(removed.select("doc"))
        touched = touched.distinct()
        return self._step(changed, self.members.join(touched, "doc", "left_semi"), self.members.join(touched, "doc", "left_anti"))


def totals(cube: DataFrame) -> DataFrame:
    """Every combination of source, language and domain; ``all`` stands for any."""
    grouped = cube.cube(*LABELS).agg(
        *(F.sum(c).cast("long").alias(c) for c in ("n_docs", "n_tokens", "added_docs", "removed_docs", "removed_tokens")),
        *(F.grouping(c).alias(f"g_{c}") for c in LABELS),
    )
    return grouped.select(
        *(F.when(F.col(f"g_{c}") == 1, "all").otherwise(F.col(c)).alias(c) for c in LABELS),
        "n_docs", "n_tokens", "added_docs", "removed_docs", "removed_tokens",
    )
