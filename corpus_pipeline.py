"""A cleaning pipeline for training documents; each stage applies one operator of quillspark.llm.

A stage takes (spark, docs, sf_dir) and returns a DataFrame.  All but the last return the
columns of ``documents``; ``n_chars`` follows the text where a stage changes it.
"""

from functools import wraps

from pyspark.sql import functions as F

from quillspark.llm import line_dedup, mixing, ngram_join, pieces, shared, toxicity


_SCRATCH: list = []


def stage(f):
    """A stage that drops the scratch tables of the stage before, whose result is written by now."""

    @wraps(f)
    def run_stage(spark, docs, sf_dir):
        while _SCRATCH:
            _SCRATCH.pop().drop()
        with shared.recording(_SCRATCH):
            return f(spark, docs, sf_dir)

    return run_stage


@stage
def drop_toxic(spark, docs, sf_dir):
    """Documents whose toxicity reaches the threshold go; the network learns from the labels table."""
    net = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.with_scores(docs, net, name="quill_toxicity")
    return scored.where(F.col("quill_toxicity") < toxicity.THRESHOLD).drop("quill_toxicity")


@stage
def drop_repeated_lines(spark, docs, sf_dir):
    """Lines that are similar to an earlier one go, short ones too, and with them documents of which nothing is left."""
    left = line_dedup.line_dedup(docs, short=True, drop_emptied=True)
    return left.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


@stage
def drop_near_copies(spark, docs, sf_dir):
    """Of each group of near copies (five words, 0.8 or more) the document with the smallest id stays."""
    found = ngram_join.ngram_jaccard_join(docs, k=5, num=80, den=100)
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


@stage
def mix_sources(spark, docs, sf_dir):
    """A document stands in the result as often as the mix takes it: not at all, once or twice."""
    return mixing.repeated(docs)


@stage
def encode(spark, docs, sf_dir):
    """Piece ids of every text, with the scores of its best segmentations."""
    return pieces.encode(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard_join", drop_near_copies),
    ("source_mixing", mix_sources),
    ("sentencepiece", encode),
]

#: SQL can't express the trained network and the segmentation lattice.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The stages in turn over the documents; each one's rows are written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, f in STAGES[:-1]:
        docs = shared.materialize(f(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
