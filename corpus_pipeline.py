"""Training-data pipeline over ``documents``: each stage calls one operator of ``viewpoint.llm``.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next one's documents. All but the last return
the columns of ``documents``; ``n_chars`` follows the text. The first adds one more,
``__mix``, null until :func:`mix_sources` fills it with a document's place in the mix,
which the last one returns with the tokens. Rows with a null doc_id pass the filters, as
no verdict names them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from viewpoint.llm import bpe, lines, minhash, mixing, quality
from viewpoint.llm.common import materialize

#: Vocabulary file of the last stage.
VOCABULARY = "byte_bpe_50k.json"
#: What :func:`mixing.mix` adds, and the column that takes it from stage to stage.
PLACE = ("block", "slot", "release", "deadline", "slot_order")
MIX, MIX_TYPE = "__mix", "struct<block: bigint, slot: bigint, release: bigint, deadline: bigint, slot_order: string>"


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    return docs.join(gone.select("doc_id").distinct().hint("merge"), "doc_id", "left_anti").select(*docs.columns)


def _keeping(docs: DataFrame, operator, added: tuple[str, ...]) -> DataFrame:
    """``operator``'s rows with the columns of ``docs``; columns that bear a name that it
    adds are put aside under another one meanwhile."""
    aside = {c: f"__aside_{i}" for i, c in enumerate(docs.columns) if c.lower() in added}
    out = operator(docs.withColumnsRenamed(aside))
    return out.select(*[F.col(aside.get(c, c)).alias(c) for c in docs.columns])


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the importance resampling rejects go; the others get an empty place in the mix."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return _without(docs, quality.classify(docs, labels).where(~F.col("kept"))).withColumn(MIX, F.lit(None).cast(MIX_TYPE))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated three-line windows leave the texts; every document stays."""
    out = _keeping(docs, lines.dedup_lines, ("n_lines", "n_removed"))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the
    smallest doc_id; of rows that repeat a doc_id all stay or go."""
    return _without(docs, minhash.near_duplicates(docs).where(~F.col("kept")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, sorted in the order in which training reads them. Files do not keep
    it over a reread, so ``__mix``, where ``docs`` has it, takes each one's block, slot,
    release, deadline and slot_order."""

    def mixed(d: DataFrame) -> DataFrame:
        out = mixing.mix(d).orderBy("slot", "slot_order", "doc_id")
        return out.withColumn(MIX, F.struct(*PLACE)) if MIX in docs.columns else out

    return _keeping(docs, mixed, PLACE)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and digests, a row a document, with its place in the mix as
    :func:`mix_sources` has given it: sort by (slot, slot_order, doc_id). Documents
    that come without ``__mix`` are mixed here."""
    import public_tokenizers

    mixed = docs.select("doc_id", "text", f"{MIX}.*") if MIX in docs.columns else mixing.mix(docs)
    return bpe.tokenize(mixed, public_tokenizers.path(VOCABULARY), with_ids=True, with_text=False, keep=PLACE)


STAGES = [
    ("quality", quality_filter),
    ("line_dedup", line_dedup),
    ("minhash_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("bpe", encode),
]

#: The classifier is a trained model and the encoder a tokenizer, which SQL does not express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
