"""Sharding by balanced label propagation: linked documents move towards their neighbours' shards, under capacity quotas.

`assign_shards(docs)` has a row for each distinct doc_id: doc_id, shard (0 to SHARDS - 1). No shard has more than (1 + SLACK) / SHARDS of them,
rounded up, plus one for every RANKED documents. Sizes are numbers of documents.

1. Links: a document's anchors are the least hash of its word n-grams in every run of PASSAGE words, so all documents that share such a passage
   share an anchor, and the longer the text, the more it has. Shorter documents, and near copies with many edits, are held by the SKETCH least hashes
   of the whole text besides. All documents that have a hash are linked with each other, once for
   each hash. Links aren't written out: a hash with m documents has m rows, however many share it. Hashes with the same
   documents, as the anchors of one passage mostly are, are one with their number as weight (told apart by 128 bits of their documents).
2. Documents are dealt to shards evenly, in a seeded order.
3. In each round, documents are counted by hash and shard, at most SHARDS rows for each hash, and a document's links to a shard are the sum over
   its hashes, without itself. In each of ROUNDS rounds a half of the documents, another one each time, wishes to be where most of its links' weight is, if that is more than
   in its own shard. From shard i to j, as many go as wish to go from j to i, and besides an equal share of j's free room; those that gain
   most go first, gains of 16 and more in steps of a fifth. They are ranked in two steps, so no wish, however common, is one task. So sizes keep their bounds while fewer links are cut.

Each round is written to the shared folder. Ties go to the lesser shard, and among documents to a seeded order. Documents without
text or words have no links and stay where they were dealt. Rows that agree in doc_id are one document with all their hashes. Rows without
doc_id get no row here; `sharded_documents` deals them by the hash of their text. An empty table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SEED, materialise, ngrams, seeded, sliding_min, words_of

SHARDS, SLACK, ROUNDS, SKETCH, NGRAM, PASSAGE = 16, 0.05, 8, 8, 5, 50
#: Documents that are ranked together when they are dealt.
RANKED = 100_000


def _sketch(n: int, size: int, passage: int):
    def sketch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            doc, value = [], []
            for first, end, words in words_of(batch.column(1)):
                for i in range(end - first):
                    own = words.hashes[words.bounds[i] : words.bounds[i + 1]]
                    grams = ngrams(own, min(n, len(own))) if len(own) else own
                    least = grams
                    # A few times the size nearly always has enough distinct ones, which spares sorting all.
                    if len(grams) > 8 * size:
                        some = np.unique(np.partition(grams, 4 * size)[: 4 * size])
                        least = some if len(some) >= size else grams
                    anchors = sliding_min(grams, passage - n + 1) if len(grams) > passage - n else grams[:0]
                    value.append(np.unique(np.concatenate((np.unique(least)[:size], anchors))))
                    doc.append(np.full(len(value[-1]), ids[first + i], np.int64))
            if doc:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(doc)), pa.array(np.concatenate(value).view(np.int64))], ["doc", "hash"])

    return sketch


def holders(docs: DataFrame, n: int = NGRAM, size: int = SKETCH, passage: int = PASSAGE) -> DataFrame:
    """doc, hash for each hash that several documents have. Holders are counted by task before they are shuffled; the join that follows is left to Spark to split where a hash is hot."""
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null and text is not null")
    sketches = materialise(named.mapInArrow(_sketch(n, size, passage), "doc long, hash long").distinct(), "anchors")
    several = sketches.groupBy(F.col("hash").alias("h")).agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("h")
    return sketches.join(several, F.col("hash") == F.col("h")).select("doc", "hash")


def weighted_holders(docs: DataFrame) -> DataFrame:
    """doc, hash, weight: of the hashes that the same documents have only the least, with their number."""
    held = materialise(holders(docs), "holders")
    same = held.groupBy("hash").agg(F.bit_xor(F.xxhash64("doc")).alias("x"), F.bit_xor(F.xxhash64("doc", F.lit(SEED))).alias("y"), F.count(F.lit(1)).alias("m"))
    one = same.groupBy("x", "y", "m").agg(F.min("hash").alias("h"), F.count(F.lit(1)).alias("weight")).select("h", "weight")
    return held.join(one, F.col("hash") == F.col("h")).select("doc", "hash", "weight")


def links(docs: DataFrame, n: int = NGRAM, size: int = SKETCH) -> DataFrame:
    """a, b, weight of links between neighbours by doc_id alone, in both directions: a sample to count cut links by, which has m - 1 for a hash with m documents."""
    follows = F.lead("doc").over(Window.partitionBy("hash").orderBy("doc"))
    chained = holders(docs, n, size).select(F.col("doc").alias("a"), follows.alias("b")).filter("b is not null").groupBy("a", "b").agg(F.count(F.lit(1)).alias("weight"))
    return chained.unionByName(chained.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight"))


def deal(docs: DataFrame, shards: int, ids: int) -> DataFrame:
    """doc, shard: even within each set of about RANKED documents."""
    chance = seeded(F.col("doc"))
    named = docs.select(F.col("doc_id").cast("long").alias("doc")).filter("doc is not null").distinct()
    part = F.pmod(chance, F.lit(max(1, ids // RANKED)))
    rank = F.row_number().over(Window.partitionBy(part).orderBy(F.xxhash64("doc", F.lit(1)), "doc"))
    return named.select("doc", F.pmod(rank - 1 + F.xxhash64(part) % shards, F.lit(shards)).cast("int").alias("shard"))


def _awake(round_: int) -> Column:
    return F.pmod(F.xxhash64("doc", F.lit(round_ // 2)) + round_, F.lit(2)) == 0


def _first(wishes: DataFrame) -> DataFrame:
    """Of the wishes to go from i to j the first `quota`, by falling gain and then a seeded order. Counted by step of gain and 256th of that order first; ranks are only made within these."""
    chance = seeded(F.col("doc"))
    step = F.when(F.col("gain") < 16, F.col("gain")).otherwise(16 + F.floor(4 * F.log2(F.col("gain"))))
    placed = wishes.withColumn("bin", (F.shiftright(chance, 55) - 256 * step).cast("long"))
    before = F.sum("n").over(Window.partitionBy("b_i", "b_j").orderBy("b_bin").rowsBetween(Window.unboundedPreceding, -1))
    bins = placed.groupBy(F.col("i").alias("b_i"), F.col("j").alias("b_j"), F.col("bin").alias("b_bin")).agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.coalesce(before, F.lit(0)))
    within = placed.join(bins, (F.col("i") == F.col("b_i")) & (F.col("j") == F.col("b_j")) & (F.col("bin") == F.col("b_bin"))).filter("before < quota")
    rank = F.row_number().over(Window.partitionBy("i", "j", "bin").orderBy(chance, "doc"))
    return within.withColumn("rank", F.col("before") + rank).filter("rank <= quota").select("doc", "j")


def assign_shards(docs: DataFrame, shards: int = SHARDS, slack: float = SLACK, rounds: int = ROUNDS) -> DataFrame:
    held = materialise(weighted_holders(docs), "weighted")
    ids = docs.select(F.col("doc_id").cast("long").alias("d")).filter("d is not null").distinct().count()
    labels = materialise(deal(docs, shards, ids), "shards")
    most = int(np.ceil(ids * (1 + slack) / shards))
    spark = docs.sparkSession
    for k in range(rounds):
        sizes = {r["shard"]: r["count"] for r in labels.groupBy("shard").count().collect()}
        placed = held.join(labels, "doc").select(F.col("doc").alias("a"), "hash", "weight", "shard")
        votes = placed.groupBy("hash", F.col("shard").alias("there")).agg(F.count(F.lit(1)).alias("n"))
        others = placed.join(votes, "hash").select("a", "there", (F.col("weight") * (F.col("n") - (F.col("there") == F.col("shard")).cast("long"))).alias("n")).filter("n > 0")
        pull = others.groupBy("a", "there").agg(F.sum("n").alias("w"))
        best = pull.groupBy("a").agg(F.max_by(F.struct("there", "w"), F.struct("w", -F.col("there"))).alias("best"), F.collect_list(F.struct("there", "w")).alias("all"))
        own = F.aggregate(F.filter("all", lambda x: x["there"] == F.col("shard")), F.lit(0).cast("long"), lambda s, x: s + x["w"])
        wishes = best.join(labels, best["a"] == labels["doc"]).filter(_awake(k)).select("doc", F.col("shard").alias("i"), F.col("best.there").alias("j"), (F.col("best.w") - own).alias("gain")).filter("gain > 0")
        wishes = materialise(wishes, "wishes")
        wished = {(r["i"], r["j"]): r["count"] for r in wishes.groupBy("i", "j").count().collect()}
        if not wished:
            break
        quotas = [(i, j, min(n, wished.get((j, i), 0)) + max(0, most - sizes.get(j, 0)) // shards) for (i, j), n in wished.items()]
        quota = spark.createDataFrame(quotas, "qi int, qj int, quota long")  # shards * shards rows at most
        moves = _first(wishes.join(F.broadcast(quota), (F.col("i") == F.col("qi")) & (F.col("j") == F.col("qj")))).select(F.col("doc").alias("m_doc"), "j")
        labels = materialise(labels.join(moves, F.col("doc") == F.col("m_doc"), "left").select("doc", F.coalesce("j", "shard").alias("shard")), "shards")
    return labels.select(F.col("doc").alias("doc_id"), "shard")


def sharded_documents(docs: DataFrame, shards: int = SHARDS, **options: object) -> DataFrame:
    """The documents with all their columns and `shard`; a column of that name, in any case, is replaced, any other is kept."""
    taken = {c.lower() for c in docs.columns}
    key, label = (next(f"{name}{'_' * k}" for k in range(len(taken) + 1) if f"{name}{'_' * k}" not in taken) for name in ("shard_key", "shard_label"))
    labels = assign_shards(docs, shards, **options).select(F.col("doc_id").alias(key), F.col("shard").alias(label))
    dealt = F.pmod(F.xxhash64("text"), F.lit(shards)).cast("int")
    joined = docs.join(labels, docs["doc_id"].cast("long") == labels[key], "left")
    return joined.withColumn("shard", F.coalesce(label, dealt)).drop(key, label)
