"""Language-model scores by deleted interpolation of bigram, unigram and uniform estimates.

P(w | h) = l2(b) c(h w) / c(h) + l1(b) c(w) / N + l0(b) / (V + 1), with maximum-likelihood counts c of the training
documents, N their tokens, V their distinct ones, and weights l for each bucket b of context frequency: the bits of c(h),
0 where h was never seen. The weights are learned by expectation-maximisation on counts held out of the training
documents (those whose remainder is DELETED), against the counts of the others; scores use the counts of all of them.

A block of documents asks once about each of its distinct words and bigrams, with its own counts; shards add up and
answer every block (see blocks). A block's own counts are below 2 ** 32, sums have 64 bits. The held-out tokens are
summed up by bucket and by eighths of octaves of their two estimates, for the expectation-maximisation on the driver: at
most 40 x 385 x 385 rows, or 280 MB, however large the input; on the given tables some tens of thousands.

Cases: null and empty texts have the end token alone; repeated rows count and are scored each; a null doc_id is not
trained on and not held out; with no training documents N and V are 0 and only the uniform part is left; ties do not arise; a
very long text is a block of its own; an empty table gives an empty one; other columns are not read, whatever they are called.
Words are told apart by their bytes in a block and by 64 bits of BLAKE2 across blocks, pairs of words by 64 bits of a hash.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import BLOCK, ask, blocks, load, lowered, mapped, merge, mix, pack, unpack, unpack_sorted, word_keys, word_spans
from .common import release, shards_for, texts_of, written

FOLDS, HELD, DELETED = 7, 2, 3
#: Context buckets: unseen, then one for each bit of the count. Bins of estimates: eighths of octaves down to 2 ** -48.
BUCKETS, PER_OCTAVE, BINS = 40, 8, 8 * 48
END, START = np.uint64(0x0E0D0C0B0A090807), np.uint64(0x0102030405060708)
ASK = "shard int, block long, keys binary, counts binary, parts binary, uni binary"
ANSWER = "block long, shard int, totals binary, parts binary, n_tokens long, n_parts long, n_types long"
HISTOGRAM = "bucket int, bin2 int, bin1 int, n long, e2 double, e1 double"
RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def remainder(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(FOLDS))


class _Tokens:
    """A block's tokens, each document's words and its end, as places in the list of the block's distinct keys: those of
    words, of the start of a text, and of bigrams."""

    def __init__(self, row):
        b = self.b = load(row)
        raw = lowered(b.raw)
        starts, ends, word_at = word_spans(raw, b.at)
        n = np.diff(word_at)
        self.at = word_at + np.arange(len(word_at))  # each document has one token more
        words = np.full(int(self.at[-1]), END, np.uint64)
        keep = np.ones(len(words), bool)
        keep[self.at[1:] - 1] = False
        words[keep] = word_keys(raw, starts, ends)[:, 0]
        self.doc = np.repeat(np.arange(len(n)), n + 1)
        before = np.append(START, words[:-1])
        before[self.at[:-1]] = START
        pairs = mix(mix(before) * np.uint64(0x9E3779B97F4A7C15) + words)
        self.keys, places = np.unique(np.concatenate([[START], words, pairs]), return_inverse=True)
        self.start, self.word, self.pair = int(places[0]), places[1 : len(words) + 1], places[len(words) + 1 :]
        self.context = np.append(self.start, self.word[:-1])
        self.context[self.at[:-1]] = self.start
        fold = np.array([-1 if x is None else x for x in row.folds], np.int64)
        self.training, self.deleted, self.held = (fold >= 0) & (fold != HELD), fold == DELETED, fold == HELD

    def counts(self, documents: np.ndarray) -> np.ndarray:
        """How often each key is in some of the documents."""
        tokens = documents[self.doc]
        out = np.bincount(np.append(self.word[tokens], self.pair[tokens]), minlength=len(self.keys))
        out[self.start] += int(documents.sum())
        return out

    def estimates(self, found: list, which: str, total: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each token: the bucket of its context, the bigram's and the unigram's estimate, and the word's count."""
        counts = np.concatenate([unpack(x[which]) for x in found]).astype(np.float64)
        word, context, pair = counts[self.word], counts[self.context], counts[self.pair]
        bucket = np.where(context > 0, np.floor(np.log2(np.maximum(context, 1))) + 1, 0).astype(np.int64)
        return np.minimum(bucket, BUCKETS - 1), pair / np.maximum(context, 1), word / max(total, 1), word


def _asks(row, shards: int) -> list[dict]:
    t = _Tokens(row)
    uni = np.zeros(len(t.keys), bool)
    uni[t.word] = True
    parts = t.counts(t.training & ~t.deleted)
    out, done = ask(shards, t.b.block, t.keys, t.counts(t.training)), 0
    for x in out:
        here = slice(done, done := done + int(np.frombuffer(x["keys"][:8], np.uint64)[0]))
        x |= {"parts": pack(parts[here].astype(np.uint32)), "uni": np.packbits(uni[here]).tobytes()}
    return out


def _answer(asked: pd.DataFrame) -> pd.DataFrame:
    """Sums for every block that asked, in the order it asked; and for block -1 the shard's tokens and types."""
    release()
    lists = [unpack_sorted(x) for x in asked["keys"]]
    merged, totals, places = merge(lists, [unpack(x, np.uint32) for x in asked["counts"]])
    parts, uni = np.zeros(len(merged), np.int64), np.zeros(len(merged), bool)
    for at, b, c in zip(places, asked["parts"], asked["uni"], strict=True):
        parts[at] += unpack(b, np.uint32)
        uni[at] |= np.unpackbits(np.frombuffer(c, np.uint8), count=len(at)).astype(bool)
    rows = [(block, shard, pack(totals[at].astype(np.uint64)), pack(parts[at].astype(np.uint64)), 0, 0, 0) for block, shard, at in zip(asked["block"], asked["shard"], places, strict=True)]
    rows.append((-1, int(asked["shard"].iloc[0]), None, None, int(totals[uni].sum()), int(parts[uni].sum()), int((totals[uni] > 0).sum())))
    return pd.DataFrame(rows, columns=[x.split()[0] for x in ANSWER.split(", ")])


def _histogram(row, n_parts: int) -> list[dict]:
    t = _Tokens(row)
    bucket, e2, e1, _ = t.estimates(row.found, "parts", n_parts)
    bins = [np.where(x > 0, np.minimum(np.floor(-np.log2(np.maximum(x, 1e-300)) * PER_OCTAVE), BINS - 1), BINS).astype(np.int64) for x in (e2, e1)]
    distinct, at = np.unique((bucket * (BINS + 1) + bins[0]) * (BINS + 1) + bins[1], return_inverse=True)
    sums = zip(distinct.tolist(), np.bincount(at).tolist(), np.bincount(at, e2).tolist(), np.bincount(at, e1).tolist(), strict=True)
    return [{"bucket": k // (BINS + 1) ** 2, "bin2": k // (BINS + 1) % (BINS + 1), "bin1": k % (BINS + 1), "n": c, "e2": s2, "e1": s1} for k, c, s2, s1 in sums]


def language_model(docs: DataFrame, block_bytes: int = 4 << 20) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10)."""
    spark = docs.sparkSession
    docs = texts_of(docs)
    # The deleted part in blocks of its own, so that learning the weights reads no others.
    deleted = F.coalesce(remainder(F.col("doc_id")) == DELETED, F.lit(False))
    names = [x.split()[0] for x in BLOCK.split(", ")]
    part = blocks(docs.where(deleted), block_bytes).withColumn("block", F.col("block").bitwiseOR(F.lit(1 << 60)))
    whole = blocks(docs.where(~deleted), block_bytes).select(*names).unionByName(part.select(*names)).withColumn("folds", F.transform("ids", remainder))
    n_bytes = whole.agg(F.sum("block_bytes")).first()[0] or 0
    shards = shards_for(spark, n_bytes / 6, 1_000_000)
    answers = written(mapped(whole, lambda row: _asks(row, shards), ASK).groupBy("shard").applyInPandas(_answer, ANSWER), "counts")
    n, n_parts, v = (x or 0 for x in answers.where("block < 0").agg(F.sum("n_tokens"), F.sum("n_parts"), F.sum("n_types")).first())
    of_block = answers.where("block >= 0").groupBy("block").agg(F.array_sort(F.collect_list(F.struct("shard", "totals", "parts"))).alias("found"))
    only = part.withColumn("folds", F.transform("ids", remainder)).join(of_block.where(F.col("block") >= 1 << 60), "block")
    binned = mapped(only, lambda row: _histogram(row, n_parts), HISTOGRAM).groupBy("bucket", "bin2", "bin1").agg(F.sum("n").alias("n"), F.sum("e2").alias("e2"), F.sum("e1").alias("e1"))
    weights = learn(binned.toPandas(), v)

    def scores(row) -> list[dict]:
        t = _Tokens(row)
        bucket, e2, e1, word = t.estimates(row.found, "totals", n)
        log = np.log10(weights[bucket, 0] * e2 + weights[bucket, 1] * e1 + weights[bucket, 2] / (v + 1))
        base = np.log10((word + 1) / (n + v + 1))
        return [
            {"doc_id": i, "held_out": bool(h), "n_tokens": int(e - s), "n_known": int((word[s:e] > 0).sum()), "train_tokens": n, "base_score": float(base[s:e].sum()), "score": float(log[s:e].sum())}
            for i, h, s, e in zip(t.b.ids, t.held, t.at[:-1], t.at[1:], strict=True)
        ]

    return mapped(whole.join(of_block.withColumn("found", F.transform("found", lambda x: F.struct(x["shard"].alias("shard"), x["totals"].alias("totals")))), "block"), scores, RESULT)


def learn(table: pd.DataFrame, v: int, rounds: int = 100) -> np.ndarray:
    """Weights of the three estimates for each bucket, by expectation-maximisation on binned held-out counts. A bucket
    borrows a thousand tokens' worth from the whole, so that one without counts has the weights of all."""
    bucket, n = table["bucket"].to_numpy(np.int64), table["n"].to_numpy(np.float64)
    e = np.column_stack([table["e2"] / np.maximum(n, 1), table["e1"] / np.maximum(n, 1), np.full(len(n), 1 / (v + 1))]).reshape(-1, 3)
    overall = np.full(3, 1 / 3)
    for _ in range(rounds):
        if not len(n):
            break
        part = overall * e
        overall = (n[:, None] * part / part.sum(axis=1, keepdims=True)).sum(axis=0) / n.sum()
    overall = np.maximum(overall, 1e-6) / np.maximum(overall, 1e-6).sum()
    weights = np.tile(overall, (BUCKETS, 1))
    for _ in range(rounds):
        if not len(n):
            break
        part = weights[bucket] * e
        part *= (n / part.sum(axis=1))[:, None]
        sums = np.column_stack([np.bincount(bucket, part[:, k], minlength=BUCKETS) for k in range(3)]) + 1000 * overall
        weights = sums / sums.sum(axis=1, keepdims=True)
    # A context that was never seen has no bigram estimate: its share goes to the others.
    weights[0] = np.array([0, *weights[0, 1:]]) / weights[0, 1:].sum()
    return weights
