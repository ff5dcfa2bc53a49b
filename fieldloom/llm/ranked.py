"""Ranked lexical search by Fagin's threshold algorithm over impact-sorted lists and a forward index.

1. One map over the documents counts the terms of whole texts and writes the forward index: for each
   document its length and, of the terms that any item asks for, the number and the occurrences.
2. Counts over that table give N, L and the document frequencies.
3. Each task takes its documents in shards of bounded size. In a shard every term has a list of
   documents by falling impact. For an item the lists are read round-robin; a document met for the
   first time gets its whole score by a lookup in the forward index. Reading stops when the sum of the
   impacts last read, which no unseen document can exceed, is strictly below the k-th score so far.
4. The tasks' best k of each item are ranked against each other, in two steps.

Items are taken in blocks of a bounded number of characters, so what tasks and driver hold of them does
not grow with their number; each block is a search of its own over all documents.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.window import Window as W

from ._common import arrow_map, give_back, ready, written

#: Characters of items searched for together: bounds the terms that tasks and driver hold.
ITEM_CHARACTERS = 4_000_000
#: A shard ends at so many documents or occurrences in lists, whichever comes first.
SHARD_DOCS, SHARD_POSTINGS = 65_536, 2_000_000
#: Depth read before the first comparison with the threshold; it doubles up to LAST_STEP.
FIRST_STEP, LAST_STEP = 16, 4096
#: A list's order packs a term's number above an impact; an impact is w * (at most 10 ** 6).
_IMPACT_BITS = 40
#: The tasks' best rows of an item are first ranked in so many parts of the tasks.
PARTS = 256
#: Stands for a null id in a task: the least, as nulls come first.
NULL_ID = -(1 << 63)

#: A term is a run of ASCII letters, digits and characters beyond ASCII; in UTF-8, of these bytes.
_TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def terms_of(text: bytes) -> list[bytes]:
    """The terms of UTF-8 bytes in order, A-Z made lower (`bytes.lower` leaves all others alone)."""
    return _TERM.findall(text.lower())


def item_blocks(items: DataFrame, item_col: str, text_col: str, characters: int) -> Iterator[list[tuple[object, list[bytes]]]]:
    """Lists of (item id, its distinct terms), of about so many characters each; rows of one id are one item."""
    merged = items.groupBy(F.col(item_col).alias("item")).agg(F.array_sort(F.collect_set(text_col)).alias("texts")).orderBy("item")
    block, size = [], 0
    for row in merged.toLocalIterator():
        raw = [t.encode("utf-8") for t in row["texts"]]
        n = sum(map(len, raw)) + 64
        if block and size + n > characters:
            yield block
            block, size = [], 0
        block.append((row["item"], sorted({w for t in raw for w in terms_of(t)})))
        size += n
    if block:
        yield block


def forward_index(docs: DataFrame, wanted: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n, terms, tfs): a document's terms in all, and the numbers in `wanted` of those it holds, ascending."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def make():
        get = wanted.get

        def one(batch: pa.RecordBatch):
            lengths, ends, terms, tfs = [], [0], [], []
            for raw in batch.column(1).cast(pa.binary()).to_pylist():
                words = terms_of(raw) if raw else []
                lengths.append(len(words))
                found = sorted((at, n) for w, n in Counter(words).items() if (at := get(w)) is not None)
                terms += [at for at, _ in found]
                tfs += [n for _, n in found]
                ends.append(len(terms))
            where = pa.array(ends, pa.int32())
            return pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lengths, pa.int64()), pa.ListArray.from_arrays(where, pa.array(terms, pa.int32())), pa.ListArray.from_arrays(where, pa.array(tfs, pa.int32()))],
                names=["doc_id", "n", "terms", "tfs"],
            )

        return one

    return arrow_map(docs.select(id_col, text_col), make, f"doc_id {id_type}, n bigint, terms array<int>, tfs array<int>")


def weights(n_docs: int, frequency: list[int]) -> list[int]:
    return [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) for df in frequency]


def lengths_m(n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """100 - 50 + ((50 * n * N) div L), in Python's integers where 64 bits would not do."""
    if int(n.max(initial=0)) * 50 * n_docs < 1 << 63:
        return 50 + (50 * n * n_docs) // max(n_terms, 1)
    return np.array([50 + 50 * int(x) * n_docs // n_terms for x in n], np.int64)


class Shard:
    """Documents with their forward index, and an impact-sorted list for each term."""

    def __init__(self, term: np.ndarray, impact: np.ndarray, ends: np.ndarray, n_terms: int):
        """ends: where each document's (term, impact) pairs start, and the end of the last."""
        self.ends, self.term, self.impact = ends, term, impact
        owner = np.repeat(np.arange(len(ends) - 1, dtype=np.int32), np.diff(ends))
        order = np.argsort((term.astype(np.int64) << _IMPACT_BITS) - impact)  # by term, then falling impact
        self.list_doc, self.list_impact = owner[order], impact[order]
        self.starts = np.searchsorted(term[order], np.arange(n_terms + 1))

    def scores(self, docs: np.ndarray, member: np.ndarray) -> np.ndarray:
        """Whole scores of documents, out of the forward index; member: which terms the item holds."""
        a = self.ends[docs]
        n = self.ends[docs + 1] - a
        ends = np.cumsum(n)
        at = np.arange(ends[-1]) + np.repeat(a - (ends - n), n)
        return np.add.reduceat(self.impact[at] * member[self.term[at]], ends - n)


class Searcher:
    """The best k documents of each item among all shards given so far."""

    def __init__(self, items: list[np.ndarray], n_terms: int, k: int):
        self.items, self.k, self.n_terms = items, k, n_terms
        none = np.empty(0, np.int64)
        self.best = [(none, none)] * len(items)  # by item: scores and document ids, best first
        self.read = self.held = 0  # entries read from lists, and entries in them: what stopping saves

    def add(self, shard: Shard, ids: np.ndarray) -> None:
        seen = np.full(len(ids), -1, np.int32)
        member = np.zeros(self.n_terms, bool)
        for at, terms in enumerate(self.items):
            member[terms] = True
            self.search(shard, at, terms, member, seen, ids)
            member[terms] = False

    def search(self, shard: Shard, item: int, terms: np.ndarray, member: np.ndarray, seen: np.ndarray, ids: np.ndarray) -> None:
        begin, end = shard.starts[terms], shard.starts[terms + 1]
        held = end > begin
        begin, end = begin[held], end[held]
        longest = int((end - begin).max(initial=0))
        self.held += int((end - begin).sum())
        depth, step = 0, FIRST_STEP
        while depth < longest:
            to = depth + step
            docs = np.concatenate([shard.list_doc[a:b] for a, b in zip(np.minimum(begin + depth, end), np.minimum(begin + to, end))])
            self.read += len(docs)
            docs = docs[seen[docs] != item]
            if len(docs):
                docs = np.unique(docs)
                seen[docs] = item
                self.merge(item, shard.scores(docs, member), ids[docs])
            # no document unseen so far exceeds the sum of the impacts last read; an exhausted list adds nothing
            going = begin + to < end
            threshold = int(shard.list_impact[begin[going] + to - 1].sum())
            kth = self.best[item][0]
            if len(kth) >= self.k and threshold < kth[-1]:
                break
            depth, step = to, min(2 * step, LAST_STEP)

    def merge(self, item: int, scores: np.ndarray, ids: np.ndarray) -> None:
        best, names = self.best[item]
        keep = scores >= (best[-1] if len(best) >= self.k else 1)
        if keep.any():
            scores, names = np.concatenate([best, scores[keep]]), np.concatenate([names, ids[keep]])
            order = np.lexsort((names, -scores))[: self.k]
            self.best[item] = scores[order], names[order]


def _local_best(index: DataFrame, items: list[np.ndarray], w: list[int], n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(item, doc_id, score): each task's best k of each item, items by their place."""
    weight, shard_docs, shard_postings = np.array(w, np.int64), SHARD_DOCS, SHARD_POSTINGS

    def run(batches):
        searcher = Searcher(items, len(weight), k)
        held: list[pa.RecordBatch] = []
        docs = postings = 0

        def flush():
            ids = np.concatenate([b.column(0).cast(pa.int64()).fill_null(NULL_ID).to_numpy() for b in held])
            n = np.concatenate([b.column(1).to_numpy() for b in held])
            size = np.concatenate([np.diff(b.column(2).offsets.to_numpy()) for b in held])
            term = np.concatenate([b.column(2).flatten().to_numpy() for b in held])
            tf = np.concatenate([b.column(3).flatten().to_numpy() for b in held]).astype(np.int64)
            held.clear()
            impact = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * np.repeat(lengths_m(n, n_docs, n_terms), size)))
            searcher.add(Shard(term, impact, np.concatenate([[0], np.cumsum(size, dtype=np.int64)]), len(weight)), ids)

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                docs += batch.num_rows
                postings += len(batch.column(2).flatten())
                if docs >= shard_docs or postings >= shard_postings:
                    flush()
                    docs = postings = 0
        if held:
            flush()
        for at, (scores, ids) in enumerate(searcher.best):
            if len(ids):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), at, np.int32)), pa.array(ids, pa.int64(), mask=ids == NULL_ID), pa.array(scores, pa.int64())], names=["item", "doc_id", "score"])
        searcher = None
        give_back()

    return index.mapInArrow(run, "item int, doc_id bigint, score bigint")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 50, item_col: str = "item_id", item_text: str = "text", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): of each item the k documents of highest score above 0, ties by ascending id.

    Documents are rows; ids must be integers. Null and empty texts hold no term: such documents are
    never found, such items have no rows. Rows of one item id are one item, a null id is an item's id
    too; documents of equal id are ranked each, a null id comes before others (the least 64-bit integer
    can't be told from it). An empty table on either side gives no rows. Other columns aren't read.

    The forward index is a written table (about a quarter of the texts' Parquet), in which what a lost
    executor held is read again. Each task hands on at most k rows an item. The items' terms travel
    with the tasks, ITEM_CHARACTERS at a time; more items are further blocks, searched one by one.
    """
    spark = ready(docs.sparkSession)
    if not isinstance(docs.schema[id_col].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        raise TypeError(f"{id_col} must be an integer")
    item_type = items.schema[item_col].dataType.simpleString()
    found = []
    for block in item_blocks(items, item_col, item_text, ITEM_CHARACTERS):
        wanted = {w: at for at, w in enumerate(sorted({w for _, terms in block for w in terms}))}
        index = written(forward_index(docs, wanted, id_col, text_col), "forward")
        n_docs, n_terms = index.agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        counts = dict(index.select(F.explode("terms").alias("t")).groupBy("t").count().collect())  # at most a row for each term of the block
        w = weights(n_docs, [counts.get(at, 0) for at in range(len(wanted))])
        best = _local_best(index, [np.array(sorted(wanted[t] for t in terms), np.int64) for _, terms in block], w, n_docs, n_terms, k)
        names = spark.createDataFrame([(at, name) for at, (name, _) in enumerate(block)], f"item int, item_id {item_type}")  # at most one for each 64 of ITEM_CHARACTERS
        found.append(_ranked(best, k).join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
    if not found:
        return spark.createDataFrame([], f"item_id {item_type}, rank int, doc_id bigint, score bigint")
    return reduce(DataFrame.unionByName, found)


def _ranked(best: DataFrame, k: int) -> DataFrame:
    """The tasks' rows of an item against each other: first in PARTS parts of the tasks, then those parts' best."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_first()]
    part = best.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(PARTS)))
    part = part.withColumn("rank", F.row_number().over(W.partitionBy("item", "part").orderBy(*order))).where(F.col("rank") <= k)
    return part.withColumn("rank", F.row_number().over(W.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)


#: The same in DuckDB SQL, over all pairs that share a term.
ORACLE = r"""
WITH words AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
totals AS (SELECT count(*) FILTER (len(w) > 0) AS all_docs, cast(coalesce(sum(len(w)), 0) AS BIGINT) AS all_terms FROM words),
flat AS (SELECT doc_id, cast(len(w) AS BIGINT) AS n, unnest(w) AS t FROM words),
postings AS MATERIALIZED (SELECT doc_id, n, t, cast(count(*) AS BIGINT) AS tf FROM flat GROUP BY ALL),
frequency AS (SELECT t, count(*) AS df FROM postings GROUP BY t),
asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
scores AS (SELECT item_id, doc_id, cast(sum(cast(floor(1000 * ln((2 * all_docs + 2) / (2 * df + 1))) AS BIGINT) * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * all_docs) // all_terms)))) AS BIGINT) AS score
  FROM asked JOIN frequency USING (t) JOIN postings USING (t), totals GROUP BY item_id, doc_id),
places AS (SELECT item_id, cast(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM places WHERE rank <= 50"""
