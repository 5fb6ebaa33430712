"""Word language models of documents and the context probability under them."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .links import small

#: Size of the vocabulary and the smoothing of word counts that the published models use.
VOCABULARY, SMOOTHING = 17_964_411, 0.1

#: Cells of a table of entities and words that a task may hold.
CELLS = 4 << 20


def language_model(words: DataFrame) -> DataFrame:
    """(entity, word, cnt, words_in_model) from one row per token (entity, word)."""
    own = words.groupBy("entity", "word").agg(F.count("*").alias("cnt"))
    return own.withColumn("words_in_model", F.sum("cnt").over(Window.partitionBy("entity")))


def document_word_counts(model: DataFrame) -> DataFrame:
    """Documents in which a word occurs."""
    return model.groupBy("word").agg(F.count("*").alias("n_docs"))


def context_scores(candidates: DataFrame, model: DataFrame, smoothing: float = SMOOTHING, vocabulary: int = VOCABULARY) -> DataFrame:
    """Adds ``context_prob``, the logarithm of the context's probability under the candidate's model.

    ``candidates`` has id, candidate and context array<string>. Words that the model lacks count
    as zero, repeated ones repeatedly; candidates without a model go. Words that the model lacks
    all add the same, so they need no rows: each pair starts from that for all its words, and
    words the model has add the difference, summed up before the shuffle. The model is measured
    and sent to all executors if it is small (``links.SMALL``).
    """
    sizes = small(model.select(F.col("entity").alias("candidate"), "words_in_model").distinct())
    own = small(model.select(F.col("entity").alias("candidate"), "word", "cnt"), "word")
    absent = F.log(F.lit(smoothing) / (F.col("words_in_model") + F.lit(smoothing * vocabulary)))
    base = candidates.join(sizes, "candidate").where(F.size("context") > 0).select("id", "candidate", (F.size("context") * absent).alias("p"))
    words = candidates.select("id", "candidate", F.explode("context").alias("word"))
    more = words.join(own, ["candidate", "word"]).select("id", "candidate", F.log((F.col("cnt") + F.lit(smoothing)) / F.lit(smoothing)).alias("p"))
    return base.unionByName(more).groupBy("id", "candidate").agg(F.sum("p").alias("context_prob"))


def scorer(model: DataFrame, smoothing: float = SMOOTHING, vocabulary: int = VOCABULARY) -> Callable[[DataFrame], DataFrame] | None:
    """As ``context_scores`` for rows that keep a mention's candidates together; None if the model is too large for a table.

    The function takes mentions with ``context`` (array<string>, as many words in each) and
    ``candidates`` (array of structs with candidate first) and adds ``context_prob`` to each
    candidate; contexts and candidates without a model go. ``model`` is measured, so it should be a written table.
    """
    n_entities, n_words = model.agg(F.countDistinct("entity"), F.countDistinct("word")).first()
    if n_entities * (n_words + 1) > CELLS:
        return None
    own = model.select("entity", "word", "cnt", "words_in_model").toArrow().combine_chunks()
    entities, words = pc.unique(own["entity"]), pc.unique(own["word"])
    row, column = (pc.index_in(own[c], value_set=v).to_numpy() for c, v in (("entity", entities), ("word", words)))
    cnt, total = own["cnt"].to_numpy(), own["words_in_model"].to_numpy()
    below = np.zeros(len(entities))
    below[row] = total + smoothing * vocabulary
    # The last column is that of words that no model has.
    logs = np.repeat(np.log(smoothing / below)[:, None], len(words) + 1, axis=1)
    logs[row, column] = np.log((cnt + smoothing) / below[row])
    return lambda mentions: _scored(mentions, entities, words, logs)


def _scored(mentions: DataFrame, entities: pa.Array, words: pa.Array, logs: np.ndarray) -> DataFrame:
    names, flat, width = mentions.columns, logs.ravel(), logs.shape[1]

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                part = batch.slice(i, 4096)
                context, some = (part.column(names.index(c)) for c in ("context", "candidates"))
                word = pc.fill_null(pc.index_in(context.flatten(), value_set=words), width - 1).to_numpy().reshape(part.num_rows, -1)
                n = pc.list_value_length(some).to_numpy()
                one = some.flatten()
                fields = [one.field(k) for k in range(one.type.num_fields)]
                who = pc.fill_null(pc.index_in(fields[0], value_set=entities), -1).to_numpy().astype(np.int64)
                of = np.repeat(np.arange(part.num_rows), n)
                keep = np.flatnonzero((who >= 0) & (word.shape[1] > 0))
                p = np.empty(len(keep))
                for a in range(0, len(keep), 16384):
                    k = keep[a : a + 16384]
                    p[a : a + 16384] = flat[who[k][:, None] * width + word[of[k]]].sum(axis=1)
                fields = [f.take(pa.array(keep)) for f in fields] + [pa.array(p)]
                offsets = np.append(0, np.cumsum(np.bincount(of[keep], minlength=part.num_rows))).astype(np.int32)
                scored = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(fields, names=[*(f.name for f in one.type), "context_prob"]))
                yield pa.RecordBatch.from_arrays([scored if c == "candidates" else part.column(k) for k, c in enumerate(names) if c != "context"], [c for c in names if c != "context"])

    kinds = {f.name: f.dataType.simpleString() for f in mentions.schema}
    kinds["candidates"] = kinds["candidates"][:-2] + ",context_prob:double>>"
    return mentions.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in names if c != "context"))
