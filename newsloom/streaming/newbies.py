"""Placing new articles, or housekeeping when there are too few of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from ..operators.aggregate import pivot_drift
from ..operators.frontier import requeue_invalid
from ..operators.mutate import delete_everywhere
from ..plans.upkeep import Corpus, assign_newbies, revalidate_sample, split_partitions
from ..sources.model import WordModel

# Documents of one round, and the size partitions are split to.
BATCH_SIZE = 5000
PARTITION_SIZE = 250


# Partitions checked again when there is little to do.
CHECKED = 3


def newbies_round(corpus: Corpus, waiting: DataFrame, model: WordModel, projection: list[tuple[float, float]],
                  seq: str = "doc_id", batch_size: int = BATCH_SIZE, partition_size: int = PARTITION_SIZE,
                  valid: Column | None = None, collection: str = "newsNewbies", checked: int = CHECKED,
                  seed: int = 0) -> tuple[Corpus, str, DataFrame | None]:
    """One round over the articles ``waiting``: the tables, what was done, and messages for the collection's queue.

    With enough of them, those that ``valid`` accepts are placed and partitions
    that have grown too large are split.  Otherwise pivots' counts are mended
    and the documents of ``checked`` drawn partitions are checked.  Invalid
    documents leave all tables; without ``valid`` none is.  The main table keeps
    ``vec``, so that splitting needs no second scoring.
    """
    if waiting.count() <= batch_size:
        pivots, _ = pivot_drift(corpus.pivots, corpus.main)
        mended = Corpus(corpus.main, corpus.newbies, corpus.errors, pivots)
        if valid is None:
            return mended, "housekeeping", None
        kept, messages = revalidate_sample(mended, checked, seed, valid, collection)
        return kept, "housekeeping", messages
    messages = None
    if valid is not None:
        messages = requeue_invalid(waiting, valid, collection).checkpoint()
        corpus = Corpus(*delete_everywhere(messages, corpus.main, corpus.newbies, corpus.errors), corpus.pivots)
        waiting = waiting.filter(valid)
    after, _ = assign_newbies(corpus, waiting, model, projection, seq)
    main = after.main.checkpoint()
    moved, pivots = split_partitions(main, after.pivots, partition_size, model.shape[1], key=seq)
    return Corpus(moved, after.newbies, after.errors, pivots), "assigned", messages
