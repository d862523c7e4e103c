"""From raw documents to token ids, in five stages that each call one corpus operator."""

from __future__ import annotations

import re
from collections.abc import Callable

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aerialframe.llm import bpe, langid, mixing, pii, simhash
from aerialframe.llm.common import column, free_name, quoted, remove, table, texts, with_columns, write_table
from aerialframe.llm.queries import TOKENIZER

#: How far a score must lie above that of an even guess, as a part of what is left to certainty, for a language to be believed.
LEAST_LEAD = 0.05
#: Words of a block of the mix: longer than op9's, so that fewer texts are cut, and a source still ends within half of it of its target.
MIX_BLOCK = 256


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that can be told. Those go that are null or have no letters, and those whose best label leads an even guess
    among all labels by less than LEAST_LEAD. Where nothing can be learned (no row has a lang) all documents with letters stay.

    Rows that repeat are told alike and all stay or go; an empty table gives an empty one; other columns are kept as they are.
    """
    model = langid.fit(docs.where(~langid.held_out(F.col("doc_id"))).select("doc_id", "text", "lang"))
    if model is None:
        return docs.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    guess = 1 / len(model.labels)
    # told from the text alone and joined to nothing: the columns pass through the operator under names of its own
    told = langid.predict(docs.toDF(*[f"c{i}" for i in range(len(docs.columns))]), model, f"c{docs.columns.index('text')}")
    sure = (F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= guess + LEAST_LEAD * (1 - guess))
    return told.where(sure).drop("lang_pred", "score").toDF(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group with a similarity of 0.8 or more in shingles of five words.

    Null, empty and wordless texts are one group; of rows that repeat one stays; a null doc_id comes last; an empty table gives an empty one.
    """
    return simhash.first_of_groups(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and disclosing terms taken out of the text; n_chars follows it.

    Documents without personal data stay as they are, null texts too (their n_chars is null); no row is added or dropped; an empty table gives
    an empty one; other columns are kept.
    """
    return pii.sanitise(docs).withColumn("n_chars", F.length("text").cast("long")).select(*map(quoted, docs.columns))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All words the mix draws: for each document a row for each pass that takes words of it, 0 to 3.

    Slots of the mix are mapped to the blocks of a source by permutations, one for each pass. A full pass takes every block, so its rows are whole; a pass that is
    not full takes blocks from all over the source, and its rows hold the words of the blocks drawn, each run of words as it stands in the text, runs on
    lines of their own; n_chars follows it. Documents of a source lie in the order of a hash of what they hold, so reruns agree. A mix of words
    holds none of a document without words (null, empty or blank text), so such a document has no row. Rows that repeat are each a
    document; a null source is one; an empty table gives an empty one; other columns are kept.
    """
    row, size, parts, passes = (free_name(docs, n) for n in ("row", "size", "words", "passes"))

    def drawn_words(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        """The runs of words that were drawn of each text; the text as it is where that is all of them."""
        out = []
        for text, held, of in zip(texts(batch, "text"), column(batch, parts).to_pylist(), column(batch, size).to_pylist(), strict=True):
            if sum(p["words"] for p in held) == of:
                out.append(text)
                continue
            places = [m.span() for m in re.finditer(mixing.WORD, text)]
            runs: list[list[int]] = []
            for p in held:  # by their first words
                if runs and runs[-1][1] == p["first"]:
                    runs[-1][1] += p["words"]
                else:
                    runs.append([p["first"], p["first"] + p["words"]])
            out.append("\n".join(text[places[a][0] : places[b - 1][1]] for a, b in runs))
        return {"text": pa.array(out, pa.string())}

    # the number tells rows apart, the hash of what they hold orders them: however they are dealt, the mix is the same
    place = F.struct(F.xxhash64("doc_id", "source", "lang", "text").alias("hash"), F.monotonically_increasing_id().alias("number"))
    rows, _ = write_table(docs.withColumn(row, place).withColumn(size, mixing.word_count("text")), "mix")
    given = rows.select(quoted(row).alias("row"), "source", quoted(size).alias("size"))
    placed, pieces, _ = mixing.mix(given, "row", block=MIX_BLOCK)
    each = pieces.groupBy("uid", "pass").agg(F.array_sort(F.collect_list(F.struct("first", "words"))).alias("parts"))
    each = each.groupBy("uid").agg(F.collect_list("parts").alias("passes"))
    drawn = placed.join(each, "uid").select(F.col("key.number").alias(row), F.col("passes").alias(passes))
    taken = rows.withColumn(row, quoted(row)["number"]).join(drawn, row).withColumn(parts, F.explode(passes)).drop(passes)
    made = with_columns(taken, "text string", drawn_words).withColumn("n_chars", F.length("text").cast("long"))
    return made.select(*map(quoted, docs.columns))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the bytes they decode to, for every document of the mix.

    A null text is empty and has no tokens; rows that repeat each have a row; an empty table gives an empty one; other columns are left out.
    """
    path = public_tokenizers.path(TOKENIZER)
    found = bpe.encode(docs.select("doc_id", "source", "lang", "text"), path, decoded=True)
    return found.select(
        "doc_id", "source", "lang", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", language),
    ("SimHash near-dedup", near_duplicates),
    ("PII", personal_data),
    ("mixing sources to target weights", mixture),
    ("byte-level BPE encoding and decoding", tokens),
]
#: A trained network and pseudorandom draws have no SQL form; tests compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet in the shared folder and read again.

    A stage's table is removed when the next one is written; what the last stage reads stays, as its result is still to be computed.
    """
    docs, read = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs, written = write_table(docs, f"stage-{k}")
            if read:
                remove(spark, read)
            read = written
    return docs
