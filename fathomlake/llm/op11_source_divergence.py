"""How far the term frequencies of sources diverge, with integer dictionaries.

1. A task cuts documents into blocks and each block into its languages: the distinct terms of a language in order, how many
   of the block's documents have each, and for each source the numbers of its terms with their counts. They are dealt
   into shards by a hash of the term, each shard's terms staying in order.
2. A shard of a language merges the lists of all blocks: terms in enough documents are kept, in one sorted array. A block's
   terms get ids by binary search in it, and counts are summed by bincount, to one dense vector for each source. A term
   that all documents hold is one entry for each block.
3. Totals go by language (a row for each source), and meet each shard's vectors again: shares are whole numbers, taken
   digit by digit so that no product overflows. A shard gives one row for each source: the sums of differences from the
   sources after it, packed, and its first terms; ids keep the order of UTF-8, so a stable sort breaks ties. The rows of a
   source merge to one; pairs become rows only then, so that no step has a row for each shard and pair.

Cases: a null text, lang or source is the empty text; a text without terms still makes its group; repeated rows and null ids
count each; a language without kept terms has the value 0 for all its pairs; ties go by item in UTF-8 order; a very long
text is a block of its own; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import arrow_schema, distinct_spans, lowered, mapped, pack, squeeze, unpack, unsqueeze
from .common import LOWER, UPPER, release, text_arrays, written
from .components import with_copies

DOCUMENTS, TERMS = 30, 50
#: Bytes of a block; terms of a shard, about; numbers in a dense matrix; groups that are broadcast after a count.
BLOCK_BYTES, KEYS_EACH, DENSE, BROADCAST_GROUPS = 8 << 20, 1_000_000, 1 << 21, 100_000
SCALE_DIGITS = 9
LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
PART = "lang string, shard int, lens binary, terms binary, in_docs binary, sources array<string>, held binary, numbers binary, counts binary"
KEPT = "lang string, shard int, n_kept long, lens binary, terms binary, sources array<string>, sums array<long>, held binary, ids binary, counts binary"
COMPARED = "lang string, source string, sums binary, lens binary, terms binary, overs binary"
MERGED = "lang string, source string, sums array<long>, terms array<string>, overs array<long>"
#: Bytes of a term that the arrays of binary search hold; longer ones are told apart by their rest.
HEAD = 32


def _listed(terms: list[bytes]) -> dict:
    return {"lens": pack(np.fromiter(map(len, terms), np.uint32, len(terms))), "terms": squeeze(b"".join(terms))}


def _terms(lens: bytes, data: bytes) -> list[bytes]:
    at, raw = np.append(0, np.cumsum(unpack(lens, np.uint32), dtype=np.int64)).tolist(), unsqueeze(data)
    return [raw[i:j] for i, j in zip(at[:-1], at[1:], strict=True)]


def _steps(numbers: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Rising numbers of several lists, end to end, as steps from one to the next, a list's first one as it is."""
    out, begins = np.diff(numbers, prepend=0), (np.cumsum(held) - held)[held > 0]
    out[begins] = numbers[begins]
    return out


def _unstepped(step: np.ndarray, held: np.ndarray) -> np.ndarray:
    run = np.cumsum(step)
    return run - np.repeat(np.append(0, run)[np.cumsum(held) - held], held)


def _block(raw: np.ndarray, at: np.ndarray, langs: np.ndarray, sources: np.ndarray, shards: int) -> Iterator[dict]:
    """A row of PART for each language and shard: its terms, how many documents have each, and of each source numbers into
    that list with counts."""
    raw = lowered(raw)
    letter, edge = LETTER[raw], np.zeros(len(raw) + 1, bool)
    edge[at] = True
    starts = np.flatnonzero(letter & (edge[:-1] | ~np.append(False, letter[:-1])))
    ends = np.flatnonzero(letter & (edge[1:] | ~np.append(letter[1:], False))) + 1
    if not len(starts):
        return
    doc, text = np.searchsorted(at, starts, "right") - 1, raw.tobytes()
    first, number, hashes = distinct_spans(raw, starts, ends)
    shard = ((hashes >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)
    names, of_lang = np.unique(langs, return_inverse=True)
    source_names, of_source = np.unique(sources, return_inverse=True)
    # A language's terms, by shard.
    pairs, lt = np.unique(of_lang[doc] * len(first) + number, return_inverse=True)
    lang, term = np.divmod(pairs, len(first))
    order = np.lexsort((shard[term], lang))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    lt, lang, term = place[lt], lang[order], term[order]
    in_docs = np.bincount(np.unique(doc * len(order) + lt) % len(order), minlength=len(order))
    new = (np.diff(lang, prepend=-1) != 0) | (np.diff(shard[term], prepend=-1) != 0)
    row, begins = np.cumsum(new) - 1, np.append(np.flatnonzero(new), len(order))
    # Counts, by language and shard, then source, then place.
    groups, times = np.unique((row[lt] * len(source_names) + of_source[doc]) * len(order) + lt, return_counts=True)
    group, held_at = groups // len(order), groups % len(order)
    cuts = np.searchsorted(group, np.arange(len(begins)) * len(source_names))
    starts, ends = starts[first[term]].tolist(), ends[first[term]].tolist()
    for r, (i, j, k, m) in enumerate(zip(begins[:-1].tolist(), begins[1:].tolist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
        some, held = np.unique(group[k:m] - r * len(source_names), return_counts=True)
        fields = {"lang": names[lang[i]], "shard": int(shard[term[i]]), "sources": source_names[some].tolist(), "in_docs": pack(in_docs[i:j].astype(np.uint32))}
        fields |= {"held": pack(held.astype(np.uint32)), "numbers": pack(_steps(held_at[k:m] - i, held).astype(np.uint32)), "counts": pack(times[k:m].astype(np.uint32))}
        yield fields | _listed([text[a:b] for a, b in zip(starts[i:j], ends[i:j], strict=True)])


def _parts(size: int, shards: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = text_arrays(batch.column("text"))
            langs, sources = (np.array(batch.column(c).to_pylist(), object) for c in ("lang", "source"))
            cuts = np.unique(np.concatenate([[0], np.searchsorted(at[:-1], np.arange(size, max(int(at[-1]), 1), size)), [len(langs)]]))
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                if rows := list(_block(raw[at[i] : at[j]], at[i : j + 1] - at[i], langs[i:j], sources[i:j], shards)):
                    yield pa.RecordBatch.from_pylist(rows, arrow_schema(PART))
                del rows
                release()

    return run


def _ids(kept: list[bytes], terms: list[bytes]) -> np.ndarray:
    """Each term's place in the sorted list of kept ones, by binary search; -1 for those not kept."""
    heads, lens = np.array(kept, f"S{HEAD}"), np.fromiter(map(len, kept), np.int64, len(kept))
    asked, size = np.array(terms, f"S{HEAD}"), np.fromiter(map(len, terms), np.int64, len(terms))
    at = np.minimum(np.searchsorted(heads, asked), len(kept) - 1)
    # Of kept terms with one head the one that is no longer than it comes first.
    out = np.where((heads[at] == asked) & (lens[at] == size), at, -1)
    for i in np.flatnonzero(size > HEAD).tolist():
        j = bisect_left(kept, terms[i])
        out[i] = j if j < len(kept) and kept[j] == terms[i] else -1
    return out


def _merged(least: int) -> Callable:
    def merge(asked: pd.DataFrame) -> pd.DataFrame:
        release()
        lists, in_docs = [_terms(*x) for x in zip(asked["lens"], asked["terms"], strict=True)], {}
        for terms, n in zip(lists, asked["in_docs"], strict=True):
            for t, k in zip(terms, unpack(n, np.uint32).tolist(), strict=True):
                in_docs[t] = in_docs.get(t, 0) + k
        kept = sorted(t for t, k in in_docs.items() if k >= least)
        if not kept:
            return pd.DataFrame(columns=[x.split()[0] for x in KEPT.split(", ")])
        sources = sorted({s for some in asked["sources"] for s in some}, key=str.encode)
        place, vectors = {s: i for i, s in enumerate(sources)}, [[] for _ in sources]
        for terms, some, held, numbers, counts in zip(lists, asked["sources"], asked["held"], asked["numbers"], asked["counts"], strict=True):
            held, ids = unpack(held, np.uint32).astype(np.int64), _ids(kept, terms)
            at, times, end = ids[_unstepped(unpack(numbers, np.uint32).astype(np.int64), held)], unpack(counts, np.uint32).astype(np.int64), 0
            for s, n in zip(some, held.tolist(), strict=True):
                here, times_here = at[end : end + n], times[end : end + n]
                vectors[place[s]].append((here[here >= 0], times_here[here >= 0]))
                end += n
        sums, held, ids, counts = [], [], [], []
        for some in vectors:  # one source's dense vector at a time
            vector = np.bincount(np.concatenate([i for i, _ in some]), np.concatenate([n for _, n in some]), len(kept)).astype(np.int64)
            at = np.flatnonzero(vector)
            sums.append(int(vector.sum()))
            held.append(len(at))
            ids.append(at)
            counts.append(vector[at])
        held = np.array(held)
        row = {"lang": asked["lang"].iloc[0], "shard": asked["shard"].iloc[0], "n_kept": len(kept), "sources": sources, "sums": sums, "held": pack(held.astype(np.uint32))}
        row |= {"ids": pack(_steps(np.concatenate(ids), held).astype(np.uint32)), "counts": pack(np.concatenate(counts).astype(np.uint64))} | _listed(kept)
        return pd.DataFrame([row])[[x.split()[0] for x in KEPT.split(", ")]]

    return merge


def shares(counts: np.ndarray, totals: np.ndarray, n_kept: int) -> np.ndarray:
    """1 + floor(10 ** 9 * (count + 5) / (total + 5 * n_kept)) for each row's counts, in whole numbers."""
    top, below = counts + 5, (totals + 5 * n_kept)[:, None]
    if top.max(initial=0) < 2**63 // 10**SCALE_DIGITS:
        return top * 10**SCALE_DIGITS // below + 1
    out, left = np.divmod(top, below)
    for _ in range(SCALE_DIGITS):
        digit, left = np.divmod(left * 10, below)
        out = out * 10 + digit
    return out + 1


def _compared(row, terms_kept: int) -> list[dict]:
    """For a shard of a language and each source: sums of differences from the sources after it, and its first terms."""
    terms, all_sources = _terms(row.lens, row.terms), row.all_sources
    place = {s: i for i, s in enumerate(all_sources)}
    held = unpack(row.held, np.uint32).astype(np.int64)
    ids, counts = _unstepped(unpack(row.ids, np.uint32).astype(np.int64), held), unpack(row.counts).astype(np.int64)
    of = np.repeat([place[s] for s in row.sources], held)
    n, totals = len(all_sources), np.array(row.totals, np.int64)
    sums, most = np.zeros((n, n), np.int64), [[] for _ in range(n)]
    each = max(1, DENSE // (n + 1))
    for begin in range(0, len(terms), each):
        here = (ids >= begin) & (ids < begin + each)
        width = min(each, len(terms) - begin)
        dense = np.zeros((n, width), np.int64)
        dense[of[here], ids[here] - begin] = counts[here]
        p, q = shares(dense, totals, row.kept), shares(dense.sum(axis=0)[None], totals.sum()[None], row.kept)[0]
        for i in range(n - 1):
            sums[i, i + 1 :] += np.abs(p[i + 1 :] - p[i]).sum(axis=1)
        for i in range(n):
            some = np.flatnonzero((dense[i] > 0) & (p[i] > q))
            over = p[i, some] - q[some]
            most[i] += [(-int(over[j]), terms[begin + some[j]]) for j in np.argsort(-over, kind="stable")[:terms_kept].tolist()]
    first = [sorted(x)[:terms_kept] for x in most]
    return [{"lang": row.lang, "source": all_sources[i], "sums": pack(sums[i, i + 1 :].astype(np.uint64)), "overs": pack(np.array([-v for v, _ in first[i]], np.uint64))} | _listed([t for _, t in first[i]]) for i in range(n)]


def _one_row(terms_kept: int) -> Callable:
    def one_row(key: tuple, shards: pd.DataFrame) -> pd.DataFrame:
        """Of the rows of a source's shards the sums together, and the first of all their terms."""
        release()
        sums, most = 0, []
        for packed, lens, terms, overs in zip(shards["sums"], shards["lens"], shards["terms"], shards["overs"], strict=True):
            sums = sums + unpack(packed).astype(np.int64)
            most = sorted(most + list(zip((-unpack(overs).astype(np.int64)).tolist(), _terms(lens, terms), strict=True)))[:terms_kept]
        return pd.DataFrame([{"lang": key[0], "source": key[1], "sums": sums, "terms": [t.decode() for _, t in most], "overs": [-v for v, _ in most]}])

    return one_row


def source_divergence(docs: DataFrame, least: int = DOCUMENTS, terms_kept: int = TERMS, block_bytes: int = BLOCK_BYTES, keys_each: int = KEYS_EACH, broadcast_groups: int = BROADCAST_GROUPS) -> DataFrame:
    """lang, source, part, item, value, rank: for each group of a language and a source the other sources of the language by
    how far their term shares differ ('pair', all of them), and its terms with shares over the language's ('term', the first)."""
    texts = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    n_bytes = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # By the bytes alone: each block has a row, and each source one, for every shard.
    shards = n_bytes // 12 // keys_each + 1
    parts = texts.mapInArrow(_parts(block_bytes, shards), PART)
    kept = written(parts.groupBy("lang", "shard").applyInPandas(_merged(least), KEPT), "kept")
    # A row for each source of a language, and each language's list of them, no longer than the result has rows for one source.
    sums = kept.select("lang", F.explode(F.arrays_zip("sources", "sums")).alias("s")).groupBy("lang", F.col("s.sources").alias("source")).agg(F.sum("s.sums").alias("n"))
    groups = texts.select("lang", "source").distinct().join(sums, ["lang", "source"], "left")
    langs = groups.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("source", F.coalesce("n", F.lit(0)).alias("n")))).alias("s"))
    langs = langs.join(kept.groupBy("lang").agg(F.sum("n_kept").alias("kept")), "lang", "left")
    langs = written(langs.select("lang", F.col("s.source").alias("all_sources"), F.col("s.n").alias("totals"), F.coalesce("kept", F.lit(0)).alias("kept")), "langs")
    n_groups = langs.agg(F.sum(F.size("all_sources"))).first()[0] or 0
    met = kept.join(F.broadcast(langs), "lang") if n_groups <= broadcast_groups else with_copies(kept, "shard", langs, "lang")
    compared = mapped(met, lambda row: _compared(row, terms_kept), COMPARED)
    found = written(compared.groupBy("lang", "source").applyInPandas(_one_row(terms_kept), MERGED), "compared")

    # A source's sums are with the last ones of its language's list.
    sums = found.select("lang", "source", "sums")
    sums = sums.join(F.broadcast(langs), "lang") if n_groups <= broadcast_groups else with_copies(sums, "source", langs, "lang")
    pairs = sums.select("lang", "source", F.explode(F.arrays_zip(F.slice("all_sources", F.size("all_sources") - F.size("sums") + 1, F.size("sums")).alias("item"), F.col("sums").alias("value"))).alias("p")).select("lang", "source", "p.item", "p.value")
    empty = langs.where("kept = 0").select("lang", F.explode("all_sources").alias("source"), "all_sources").select("lang", "source", F.explode("all_sources").alias("item"), F.lit(0).cast("long").alias("value")).where("source != item")
    both = pairs.union(pairs.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")).union(empty).withColumn("part", F.lit("pair"))
    w = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = found.select("lang", "source", F.explode(F.arrays_zip(F.col("terms").alias("item"), F.col("overs").alias("value"))).alias("t")).select("lang", "source", F.lit("term").alias("part"), "t.item", "t.value").withColumn("rank", F.row_number().over(w))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return both.withColumn("rank", F.row_number().over(w)).select(*columns).union(terms.select(*columns))


ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[a-z\x{{80}}-\x{{10FFFF}}]+')) AS term FROM d),
k AS (SELECT lang, term FROM w GROUP BY 1, 2 HAVING count(DISTINCT r) >= {DOCUMENTS}),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY 1),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN k USING (lang, term) GROUP BY 1, 2, 3),
g AS (SELECT DISTINCT lang, source FROM d),
n AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS total FROM g LEFT JOIN c ON c.lang = g.lang AND c.source = g.source GROUP BY 1, 2),
p AS (SELECT n.lang, n.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * CAST(coalesce(c.n, 0) + 5 AS HUGEINT)) // CAST(total + 5 * v AS HUGEINT) AS p FROM n JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = n.lang AND c.source = n.source AND c.term = k.term),
q AS (SELECT k.lang, k.term, 1 + (1000000000 * CAST(sum(c.n) + 5 AS HUGEINT)) // CAST(any_value(t.total) + 5 * any_value(v) AS HUGEINT) AS q FROM k JOIN v USING (lang) JOIN c USING (lang, term) JOIN (SELECT lang, sum(total) AS total FROM n GROUP BY 1) t ON t.lang = k.lang GROUP BY 1, 2),
a AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source
  LEFT JOIN (SELECT x.lang, x.source AS a, y.source AS b, sum(abs(x.p - y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY 1, 2, 3) s ON s.lang = x.lang AND s.a = x.source AND s.b = y.source),
b AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, CAST(p - q AS BIGINT) AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
u AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (SELECT * FROM a UNION ALL SELECT * FROM b))
SELECT * FROM u WHERE part = 'pair' OR rank <= {TERMS}
"""
