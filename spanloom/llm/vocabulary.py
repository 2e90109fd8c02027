"""Word lists that are looked up while texts are read, of any size."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from itertools import repeat

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.runtime import ship


class Asked(set):
    """Has no word, and keeps those that were looked up in it."""

    def __contains__(self, word: object) -> bool:
        self.add(word)
        return False


def with_vocabulary(x: DataFrame, words: DataFrame, limit: int, ask: Callable[[str, Asked], object]) -> tuple[DataFrame, Callable[[pd.DataFrame], Iterable[frozenset]]]:
    """``x`` (with a column t), and a function that gives for each row of a batch of it the words that are in the list.

    A list of at most ``limit`` words is broadcast. Of a longer one each text gets the words that it will look up, by a
    shuffle of distinct texts' words: ``ask`` looks them all up in the set that it is given.
    """
    ship(x.sparkSession)
    words = words.toDF("word").where("word is not null").distinct()
    rows = words.limit(limit + 1).collect()
    if len(rows) <= limit:
        shared = x.sparkSession.sparkContext.broadcast(frozenset(r.word for r in rows))
        return x, lambda p: repeat(shared.value, len(p))
    # Texts are named by two hashes of their content, which are the same whenever they are computed.
    names = [F.xxhash64("t").alias("h1"), F.xxhash64(F.lit(1), "t").alias("h2")]

    def asked(batches):
        for p in batches:
            out: list[tuple] = []
            for h1, h2, t in zip(p["h1"], p["h2"], p["t"]):
                seen = Asked()
                ask(t, seen)
                out += [(h1, h2, w) for w in set.__iter__(seen)]
            yield pd.DataFrame(out, columns=["h1", "h2", "word"])

    pairs = x.where("t is not null").select(*names, "t").mapInPandas(asked, "h1 bigint, h2 bigint, word string").distinct()
    known = pairs.join(words, "word").groupBy("h1", "h2").agg(F.collect_list("word").alias("known"))
    joined = x.withColumns({"h1": names[0], "h2": names[1]}).join(known, ["h1", "h2"], "left").select(*x.columns, "known")
    return joined, lambda p: (frozenset(k if k is not None else ()) for k in p["known"])
