"""Language-model scores by deleted interpolation of bigram, unigram and uniform estimates.

Each estimate is a maximum-likelihood one; how they mix depends on the bucket of
how frequent the context is, and expectation-maximisation learns the weights on
the counts of a fold of the training texts that is deleted from the estimates.

Texts become blocks of hashed tokens.  A block asks for the counts of its
different n-grams: its keys, sorted, go to the shard of their range, a shard
adds up what all blocks counted and answers each block in its own order.  So a
word that is a tenth of all tokens costs one entry per block, no vocabulary is
broadcast, and tables grow with the corpus in the number of shards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanmill.llm.common import stage

#: Tokens of a block, and keys a shard holds on average for the blocks together.
BLOCK_TOKENS, SHARD_TOKENS = 1 << 20, 1 << 22
#: What a block's texts are for: counting, learning the weights, or scoring only.
COUNT, FOLD, OUT = 0, 1, 2
BEGIN = np.uint64(0x9E3779B97F4A7C15)
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Grid of the fold's histogram in units of log10.
GRID = 50


def mixed(keys: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    keys = (keys ^ (keys >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    keys = (keys ^ (keys >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return keys ^ (keys >> np.uint64(31))


def planes(numbers: np.ndarray) -> bytes:
    """Numbers as planes of their bytes, which Spark's compression shrinks where they are small."""
    return numbers.view(np.uint8).reshape(len(numbers), -1).T.tobytes()


def from_planes(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).ravel()


def hashed_words(text: str | None) -> list[int]:
    """64-bit hashes of the lower-cased (A-Z) words, then that of the end."""
    from xxhash import xxh3_64_intdigest

    return [*map(xxh3_64_intdigest, (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()), xxh3_64_intdigest(b"")]


def blocks_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Texts of a task as blocks of one kind each."""
    waiting: dict[int, tuple[list, list, list]] = {k: ([], [], []) for k in (COUNT, FOLD, OUT)}
    size = dict.fromkeys(waiting, 0)
    number = TaskContext.get().partitionId() << 32

    def block(kind: int) -> pd.DataFrame:
        nonlocal number
        ids, lengths, tokens = waiting[kind]
        words, places = np.unique(np.concatenate(tokens), return_inverse=True)
        waiting[kind] = ([], [], [])
        number += 1
        return pd.DataFrame([{
            "block": number, "kind": kind, "doc_ids": ids, "lengths": lengths,
            "vocabulary": words.tobytes(), "tokens": planes(places.astype(np.uint32)),
        }])

    for batch in batches:
        for doc_id, kind, text in zip(batch["doc_id"].tolist(), batch["kind"].tolist(), batch["text"].tolist()):
            tokens = np.array(hashed_words(text), np.uint64)
            ids, lengths, parts = waiting[kind]
            ids.append(None if doc_id is None or doc_id != doc_id else doc_id)
            lengths.append(len(tokens))
            parts.append(tokens)
            size[kind] += len(tokens)
            if size[kind] >= BLOCK_TOKENS:
                yield block(kind)
                size[kind] = 0
    for kind in list(waiting):
        if waiting[kind][0]:
            yield block(kind)


def bigrams_of(vocabulary: np.ndarray, tokens: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Context hash per token (the begin mark for a text's first) and the bigram's key."""
    words = vocabulary[tokens]
    contexts = np.empty_like(words)
    contexts[1:] = words[:-1]
    contexts[np.concatenate(([0], np.cumsum(lengths)[:-1]))] = BEGIN
    return contexts, mixed(contexts * np.uint64(3) + mixed(words))


def asked(shards: int):
    """Per block and shard the sorted keys and how often the block counted each."""
    width = (1 << 64) // shards + 1

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        edges = np.array([min(i * width, (1 << 64) - 1) for i in range(1, shards)], np.uint64)
        for batch in batches:
            for b in batch.itertuples(index=False):
                vocabulary, tokens = np.frombuffer(b.vocabulary, np.uint64), from_planes(b.tokens, np.uint32)
                lengths = np.asarray(b.lengths)
                _, pairs = bigrams_of(vocabulary, tokens, lengths)
                once = np.bincount(tokens, minlength=len(vocabulary))
                # the begin mark is counted as a context, once per text
                singles = np.append(vocabulary, BEGIN)
                order = np.argsort(singles)
                for what, keys, counts in (
                    (1, singles[order], np.append(once, len(lengths))[order]),
                    (2, *np.unique(pairs, return_counts=True)),
                ):
                    cuts = [0, *np.searchsorted(keys, edges).tolist(), len(keys)]
                    yield pd.DataFrame([
                        {
                            "shard": shard, "what": what, "block": b.block, "kind": b.kind,
                            "keys": planes(np.diff(keys[i:j], prepend=np.uint64(0))), "counts": planes(counts[i:j].astype(np.uint32)),
                        }
                        for shard, (i, j) in enumerate(zip(cuts, cuts[1:])) if j > i
                    ])

    return ask


def answered(rows: pd.DataFrame) -> pd.DataFrame:
    """One shard: to each block, for its keys in order, the counts of the fit and of all training texts."""
    keys = [np.cumsum(from_planes(k, np.uint64), dtype=np.uint64) for k in rows["keys"]]
    counts = [from_planes(c, np.uint32) for c in rows["counts"]]
    own, places = np.unique(np.concatenate(keys), return_inverse=True)
    kinds = np.repeat(rows["kind"].to_numpy(), [len(k) for k in keys])
    amounts = np.concatenate(counts).astype(float)
    fit = np.bincount(places, amounts * (kinds == COUNT), len(own))
    whole = np.bincount(places, amounts * (kinds != OUT), len(own))
    ends = np.cumsum([len(k) for k in keys])
    starts = ends - [len(k) for k in keys]
    begin = own == BEGIN
    single = rows["what"].iloc[0] == 1
    return pd.DataFrame({
        "block": rows["block"], "what": rows["what"], "shard": rows["shard"],
        "fit": [planes(fit[places[i:j]].astype(np.uint64)) for i, j in zip(starts, ends)],
        "whole": [planes(whole[places[i:j]].astype(np.uint64)) for i, j in zip(starts, ends)],
        # what the shard knows of the whole model, told once
        "n_fit": [float(fit[~begin].sum()) if single and i == 0 else 0.0 for i in starts],
        "n_whole": [float(whole[~begin].sum()) if single and i == 0 else 0.0 for i in starts],
        "v_fit": [float((fit[~begin] > 0).sum()) if single and i == 0 else 0.0 for i in starts],
        "v_whole": [float((whole[~begin] > 0).sum()) if single and i == 0 else 0.0 for i in starts],
    })


ANSWER = "block long, what int, shard int, fit binary, whole binary, n_fit double, n_whole double, v_fit double, v_whole double"


def estimates(b, column: str, n: float, v: float) -> tuple[np.ndarray, ...]:
    """Per token of a block: its count, the context's bucket, and the bigram, unigram and uniform estimates."""
    vocabulary, tokens = np.frombuffer(b.vocabulary, np.uint64), from_planes(b.tokens, np.uint32)
    lengths = np.asarray(b.lengths)
    answers = {1: [], 2: []}
    for a in sorted(b.answers, key=lambda a: (a["what"], a["shard"])):
        answers[a["what"]].append(from_planes(a[column], np.uint64))
    singles = np.sort(np.append(vocabulary, BEGIN))
    single_counts, pair_counts = (np.concatenate(answers[k]).astype(float) for k in (1, 2))
    contexts, pairs = bigrams_of(vocabulary, tokens, lengths)
    count = single_counts[np.searchsorted(singles, vocabulary)][tokens]
    context = single_counts[np.searchsorted(singles, contexts)]
    _, places = np.unique(pairs, return_inverse=True)
    bucket = np.where(context > 0, np.floor(np.log2(np.maximum(context, 1))) + 1, 0).astype(int)
    return count, bucket, pair_counts[places] / np.maximum(context, 1), count / max(n, 1), 1 / (v + 1)


def learn_weights(cells: np.ndarray, uniform: float, rounds: int = 60) -> np.ndarray:
    """Weights (bigram, unigram, uniform) per bucket by expectation-maximisation.

    ``cells`` has bucket, bigram and unigram estimate and number of tokens.  A
    bucket without fold tokens takes the weights of the next one below.
    """
    weights = np.tile([0.3, 0.6, 0.1], (66, 1))
    for bucket in range(66):
        own = cells[cells[:, 0] == bucket]
        if not len(own):
            weights[bucket] = weights[max(bucket - 1, 0)]
            continue
        parts = np.column_stack((own[:, 1], own[:, 2], np.full(len(own), uniform)))
        w = weights[bucket]
        for _ in range(rounds):
            share = parts * w
            share *= (own[:, 3] / share.sum(axis=1))[:, None]
            w = share.sum(axis=0) / own[:, 3].sum()
        w = np.maximum(w, 1e-6)
        weights[bucket] = w / w.sum()
    return weights


def lm_scores(docs: DataFrame, training, fold) -> DataFrame:
    """Scores of all rows of ``docs`` (doc_id, text; other columns are not read).

    ``training`` and ``fold`` are conditions on doc_id: which texts the model
    learns from, and which of these the weights are learned on.  Returns doc_id,
    n_tokens, n_known, train_tokens, base_score (add-one unigrams) and score
    (log10 probability).  Null, empty and blank texts are their end alone; null
    ids and repeated rows are scored by themselves; an empty table gives no rows;
    without training texts all is unknown.  Every token is counted and scored;
    only numbers and a histogram of bounded size come to the driver.
    """
    spark = docs.sparkSession
    kind = F.when(~training, OUT).when(fold, FOLD).otherwise(COUNT)
    id_kind = docs.schema["doc_id"].dataType.simpleString()
    # ids travel as their text, which keeps null ids and any type as they are
    table = stage(docs.select(
        F.col("doc_id").cast("string").alias("doc_id"), F.coalesce(kind, F.lit(OUT)).alias("kind"), "text"
    ).mapInPandas(
        blocks_of, "block long, kind int, doc_ids array<string>, lengths array<long>, vocabulary binary, tokens binary"
    ))
    tokens = table.select(F.coalesce(F.sum(F.octet_length("tokens") / 4), F.lit(0.0))).first()[0]
    shards = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), int(tokens // SHARD_TOKENS) + 1)
    questions = table.select("block", "kind", "lengths", "vocabulary", "tokens").mapInPandas(
        asked(shards), "shard int, what int, block long, kind int, keys binary, counts binary"
    )
    answers = stage(questions.groupBy("shard", "what").applyInPandas(answered, ANSWER))
    n_fit, n, v_fit, v = (x or 0.0 for x in answers.agg(*(F.sum(c) for c in ("n_fit", "n_whole", "v_fit", "v_whole"))).first())

    def with_answers(blocks: DataFrame, column: str) -> DataFrame:
        told = answers.join(blocks.select("block"), "block", "left_semi") if column == "fit" else answers
        gathered = told.groupBy("block").agg(F.collect_list(F.struct("what", "shard", column)).alias("answers"))
        return blocks.join(gathered, "block")

    def folded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for b in batch.itertuples(index=False):
                _, bucket, p2, p1, _ = estimates(b, "fit", n_fit, v_fit)
                with np.errstate(divide="ignore"):
                    g2, g1 = (np.where(p > 0, np.round(np.log10(p) * GRID), 1).astype(int) for p in (p2, p1))
                yield pd.DataFrame({"bucket": bucket, "g2": g2, "g1": g1}).value_counts().reset_index(name="n")

    cells = (
        with_answers(table.where(F.col("kind") == FOLD), "fit")
        .mapInPandas(folded, "bucket long, g2 long, g1 long, n long")
        .groupBy("bucket", "g2", "g1").agg(F.sum("n").alias("n"))
    )
    # at most 65 buckets times the cells of the grid, whatever the corpus
    grid = cells.toPandas().to_numpy(float).reshape(-1, 4)
    for k in (1, 2):
        grid[:, k] = np.where(grid[:, k] > 0, 0.0, 10.0 ** (np.minimum(grid[:, k], 0) / GRID))
    weights = learn_weights(grid, 1 / (v_fit + 1))

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for b in batch.itertuples(index=False):
                count, bucket, p2, p1, p0 = estimates(b, "whole", n, v)
                w = weights[bucket]
                logs = np.log10(w[:, 0] * p2 + w[:, 1] * p1 + w[:, 2] * p0)
                base = np.log10((count + 1) / (n + v + 1))
                starts = np.concatenate(([0], np.cumsum(b.lengths)[:-1])).astype(int)
                yield pd.DataFrame({
                    "doc_id": b.doc_ids, "n_tokens": b.lengths,
                    "n_known": np.add.reduceat((count > 0).astype(np.int64), starts),
                    "base_score": np.add.reduceat(base, starts), "score": np.add.reduceat(logs, starts),
                })

    scores = with_answers(table, "whole").mapInPandas(
        scored, "doc_id string, n_tokens long, n_known long, base_score double, score double"
    )
    return scores.select(
        F.col("doc_id").cast(id_kind).alias("doc_id"), "n_tokens", "n_known", F.lit(int(n)).cast("long").alias("train_tokens"),
        "base_score", "score",
    )
