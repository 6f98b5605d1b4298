"""Text cut off by field limits.

Method: per source and column, histograms of lengths in characters and in bytes are
tested for spikes; a text whose length is a spike and that has no terminal mark is
cut. Away from spikes (transfers that broke off) a text is judged by its ending alone,
asking for a terminal mark only in sources whose prose lines hardly ever lack one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marram.llm import endings as E
from marram.llm.arrow import stage
from marram.storage import write_through

#: Distinct texts of one length that make a spike at least, and how far they must rise over lengths nearby.
SPIKE_TEXTS, SPIKE_RISE, NEIGHBOURS = 5, 8.0, 40
#: Share of prose lines without a terminal mark up to which a source counts as strict.
STRICT_SHARE = 0.1


def spikes(lengths: DataFrame) -> DataFrame:
    """Lengths that too many distinct texts of a source share: ``source, unit, length, n_texts``.

    ``lengths``: ``source, n_chars, n_bytes, text_hash``. A spike has at least
    ``SPIKE_TEXTS`` distinct texts, ``SPIKE_RISE`` times the mean of the lengths
    within ``NEIGHBOURS`` of it. Copies of a text count once. The histogram is
    aggregated before it moves; a source holds one row per length.
    """
    units = F.explode(F.array(F.struct(F.lit("chars").alias("unit"), F.col("n_chars").alias("length")), F.struct(F.lit("bytes").alias("unit"), F.col("n_bytes").alias("length"))))
    h = (
        lengths.select("source", "text_hash", units.alias("u"))
        .select("source", "text_hash", "u.unit", "u.length")
        .distinct()
        .groupBy("source", "unit", "length")
        .agg(F.count(F.lit(1)).alias("n_texts"))
    )
    near = Window.partitionBy("source", "unit").orderBy("length").rangeBetween(-NEIGHBOURS, NEIGHBOURS)
    return (
        h.withColumn("others", (F.sum("n_texts").over(near) - F.col("n_texts")) / (2.0 * NEIGHBOURS))
        .where((F.col("n_texts") >= SPIKE_TEXTS) & (F.col("n_texts") >= SPIKE_RISE * (F.col("others") + 0.25)))
        .select("source", "unit", "length", "n_texts")
    )


def endings_of(texts: DataFrame, key: str, column: str) -> DataFrame:
    """Verdicts on the ending of each non-empty text, with its lengths and line counts.

    The verdicts are written to the shared folder, since several aggregates read them.
    """
    texts = texts.select(F.col(key).cast("long").alias("key"), F.col("source").cast("string").alias("source"), F.col(column).cast("string").alias("text")).where(F.trim("text") != "")

    def make():
        tokens = E.Tokens()
        own = ("key", "source", "n_chars", "n_bytes", "text_hash", "n_lines", "n_unmarked")

        def run(cols):
            out = {k: [] for k in own}
            shapes = []
            for k, s, t, b, h in zip(cols["key"], cols["source"], cols["text"], cols["n_bytes"], cols["text_hash"]):
                shapes.append(E.shape(t, tokens))
                lines = unmarked = 0
                for x in E._BREAK.split(t)[:-1]:
                    if x and E.prose_line(x):
                        lines += 1
                        y = x.rstrip()
                        unmarked += not (E.TERMINAL.search(y) or y[-1] in ":,;")
                for name, v in zip(own, (k, s, len(t), b, h, lines, unmarked)):
                    out[name].append(v)
            return out | dict(zip(E.SHAPE, zip(*shapes) if shapes else ((),) * len(E.SHAPE)))

        return run

    given = texts.select("key", "source", "text", F.octet_length("text").cast("long").alias("n_bytes"), F.xxhash64("text").alias("text_hash"))
    ddl = f"key long, source string, n_chars long, n_bytes long, text_hash long, n_lines long, n_unmarked long, {E.SHAPE_DDL}"
    shaped = write_through(stage(given, ddl, make), "endings-shapes")
    n = shaped.agg(F.count_distinct("text_hash")).first()[0]
    return write_through(E.resolve(shaped, texts, "text", n), "endings")


def truncated(texts: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """Texts that stop before their author's text did: ``key, source, kind, at_spike``.

    ``texts`` needs the key (integer), ``source`` and the text column; other columns are
    ignored. ``kind`` is ``word``, ``sentence``, ``table`` or ``code``. Null, empty and
    white texts are no cases; a null source is a source of its own; repeated rows give
    repeated cases. The per-source figures are aggregated on the map side, so a source
    that owns most rows is no hot group.
    """
    e = endings_of(texts, key, column)
    cuts = spikes(e)
    # null-safe: a source without a name has its own spikes
    name = F.coalesce(F.col("source"), F.lit("\0"))
    chars = cuts.where("unit = 'chars'").select(name.alias("s_c"), F.col("length").alias("l_c"))
    octets = cuts.where("unit = 'bytes'").select(name.alias("s_b"), F.col("length").alias("l_b"))
    habits = e.groupBy(name.alias("s_h")).agg(
        (F.sum("n_unmarked") <= STRICT_SHARE * F.sum("n_lines")).alias("is_strict")
    )
    # only texts that some verdict calls broken take part in the joins
    doubtful = e.where("lenient is not null or strict is not null or at_limit is not null").withColumn("s", name)
    j = (
        doubtful.join(chars, (F.col("s") == F.col("s_c")) & (F.col("n_chars") == F.col("l_c")), "left")
        .join(octets, (F.col("s") == F.col("s_b")) & (F.col("n_bytes") == F.col("l_b")), "left")
        .join(habits, F.col("s") == F.col("s_h"), "left")
    )
    at_spike = F.col("l_c").isNotNull() | F.col("l_b").isNotNull()
    kind = F.when(at_spike, F.coalesce("at_limit", "strict", "lenient")).when(F.col("is_strict"), F.coalesce("strict", "lenient")).otherwise(F.col("lenient"))
    return j.select(F.col("key").alias(key), "source", kind.alias("kind"), at_spike.alias("at_spike")).where("kind is not null")


def truncation_by_source(texts: DataFrame, cases: DataFrame, key: str = "doc_id") -> DataFrame:
    """Share of truncated texts per source; sources without a case have a share of zero."""
    all_ = texts.groupBy("source").agg(F.count(F.lit(1)).alias("n_texts"))
    cut = cases.groupBy(F.col("source").alias("s")).agg(F.count(F.lit(1)).alias("n_truncated"), F.count(F.when(F.col("at_spike"), 1)).alias("n_at_limit"))
    return all_.join(cut, F.col("source").eqNullSafe(F.col("s")), "left").select(
        "source",
        "n_texts",
        F.coalesce("n_truncated", F.lit(0)).cast("long").alias("n_truncated"),
        F.coalesce("n_at_limit", F.lit(0)).cast("long").alias("n_at_limit"),
        F.round(F.coalesce("n_truncated", F.lit(0)) / F.col("n_texts"), 6).alias("share"),
    )
