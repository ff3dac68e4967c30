"""From candidate contexts of repeated strings to what every document loses.

A context is a run of neighbouring strings (windows) that share a key. Equal
contexts are one row with their first and last document; contexts with one key
are solved together, exactly; the answers return to the contexts' occurrences. A key that
occurs more than HEAVY times is not solved in one piece: its contexts are split
into their single strings, and each string is grouped by itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, partitions

CONTEXTS = 20_000  # that are solved at once, at least; a key's contexts stay together, HEAVY at most
HEAVY = 4096  # occurrences of a key, contexts of a string: with more, they aren't brought to one task
NEVER = (1 << 63) - 1  # no document is less
BROADCAST = 50_000  # rows that go to every task at most; more are joined
SALTS = 32  # parts of a key where they are joined
CODE = ["key", "code", "more"]  # a context: its key and 128 bits of its payload
MOST = 48  # strings in a context


def _answers(solve: Callable[[np.ndarray, list, np.ndarray], list[list[int]]]):
    def done(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        keys, first, last = (t.column(x).to_numpy() for x in ("key", "first", "last"))
        change = np.diff(keys) != 0
        lone = np.append(True, change) & np.append(change, True)
        firsts: list[list[int]] = [[int(f)] for f in first]
        many = np.flatnonzero(~lone)
        if many.size:
            found = solve(keys[many], t.column("payload").take(pa.array(many)).to_pylist(), first[many])
            for i, x in zip(many.tolist(), found):
                firsts[i] = x if len({*x}) > 1 else x[:1]
        some = np.array([min(x) < y for x, y in zip(firsts, last.tolist())], bool)  # else no document loses by it
        out = pa.RecordBatch.from_arrays([*(t.column(x).combine_chunks() for x in CODE), pa.array(firsts, pa.list_(pa.int64()))], names=[*CODE, "firsts"])
        return out.filter(pa.array(some))

    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if rows >= CONTEXTS:  # cut where a key ends
                edges = np.flatnonzero(np.diff(np.append(held[-1].column("key")[-1].as_py(), batch.column("key").to_numpy())))
                if edges.size:
                    held.append(batch.slice(0, int(edges[0])))
                    yield done(held)
                    batch, held, rows = batch.slice(int(edges[0])), [], 0
            held.append(batch)
            rows += batch.num_rows
        if held:
            yield done(held)

    return answered


def _met(rows: DataFrame, few: DataFrame, keys: list[str], how: str, n: int) -> DataFrame:
    """rows joined with the n rows of `few`, unique by keys, each of which many rows may have: broadcast while n is
    small, and beyond that joined in SALTS parts a key, each row in one of them."""
    if n <= BROADCAST:
        return rows.join(F.broadcast(few), keys, how)
    salted = few.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    spread = rows.withColumn("salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int"))
    return spread.join(salted.hint("merge"), [*keys, "salt"], how).drop("salt")


def _by_string(contexts: DataFrame, strings: Callable[[Column], Column]) -> tuple[DataFrame, DataFrame]:
    """key, codes and firsts of the contexts (key, code, more, payload, first, last) of heavy keys; the written table that this reads.

    Strings are counted on the map side before they meet. Those in more than HEAVY contexts
    go to their contexts by _met(); the others are joined."""
    single = contexts.select(*CODE, "last", F.posexplode(strings(F.col("payload"))).alias("i", "string"), "first")
    seen = single.groupBy("key", "string").agg(F.min("first").alias("least"), F.max("last").alias("most"), F.count(F.lit(1)).alias("n"))
    known = materialize(seen.where("least < most").select("key", "string", "least", "n"), "strings")
    hot = known.where(F.col("n") > HEAVY).drop("n")
    n = hot.count()
    single = single.drop("first")
    met = _met(single, hot, ["key", "string"], "inner", n).unionByName(_met(single, hot.drop("least"), ["key", "string"], "left_anti", n).join(known.where(F.col("n") <= HEAVY).drop("n").hint("merge"), ["key", "string"], "left"))
    every = met.groupBy(*CODE).agg(F.max("last").alias("last"), F.array_sort(F.collect_list(F.struct("i", F.coalesce("least", F.lit(NEVER)).alias("least")))).alias("found"))
    return every.select(*CODE, F.col("found.least").alias("firsts"), "last").where(F.exists("firsts", lambda x: x < F.col("last"))).drop("last"), known


def losses(found: DataFrame, payload: str, size, strings: Callable[[Column], Column], solve: Callable[[np.ndarray, list, np.ndarray], list[list[int]]]) -> DataFrame:
    """row and found, an array: where contexts start, how many strings they hold, and a
    mask of those that a smaller doc_id holds too (-1: all).

    found: key, payload, doc_id, row (a text's number), at, of a table that materialize() wrote; it is deleted. size: how many strings a payload
    holds, MOST at most. strings: a payload's strings as an array. solve: from keys, payloads and first documents, each string's first."""
    coded = found.withColumns({"code": F.xxhash64(payload), "more": F.xxhash64(F.lit(7), payload)})
    heavy = materialize(found.groupBy("key").count().where(F.col("count") > HEAVY).select("key"), "heavy")
    written = [found, heavy]
    n_heavy = heavy.count()

    def distinct(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*CODE, "payload").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))

    coded_payload = coded.select(*CODE, F.col(payload).alias("payload"), "doc_id")
    light = _met(coded_payload, heavy, ["key"], "left_anti", n_heavy) if n_heavy else coded_payload
    # dealt once, by key: a key has HEAVY contexts at most here, so that those equal needn't meet before
    ordered = distinct(light.repartition(partitions(found), "key")).sortWithinPartitions("key", "code")
    firsts = ordered.mapInArrow(_answers(solve), "key long, code long, more long, firsts array<long>")
    if n_heavy:
        contexts = materialize(distinct(_met(coded_payload, heavy, ["key"], "left_semi", n_heavy)), "heavy-contexts")
        split, known = _by_string(contexts, strings)
        written += [contexts, known]
        firsts = firsts.unionByName(split)
    firsts = materialize(firsts, "firsts")
    joined = coded.select(*CODE, "doc_id", "row", "at", size.cast("int").alias("n")).join(firsts.hint("merge"), CODE)
    one = F.lit(1).cast("long")
    none = F.lit(0).cast("long")
    bits = F.transform("firsts", lambda x, i: F.when(x < F.col("doc_id"), F.call_function("shiftleft", one, i)).otherwise(none))
    every = F.when(F.get("firsts", F.lit(0)) < F.col("doc_id"), F.lit(-1).cast("long")).otherwise(none)
    mask = F.when(F.size("firsts") == 1, every).otherwise(F.aggregate(bits, none, lambda a, b: a.bitwiseOR(b)))
    marked = joined.select("row", "at", "n", mask.alias("mask")).where("mask <> 0")
    out = materialize(marked.groupBy("row").agg(F.collect_list(F.struct("at", "n", "mask")).alias("found")), "losses")
    discard(*written, firsts)
    return out


def without_text(texts: DataFrame) -> DataFrame:
    """doc_id, h1, h2 and row of distinct_texts(), whose table is deleted: once contexts are written, nothing reads a text again."""
    ids = materialize(texts.select("doc_id", "h1", "h2", "row"), "text-ids")
    discard(texts)
    return ids


Found = tuple[np.ndarray, np.ndarray, np.ndarray]  # at, n, mask


def found_in(column: pa.ListArray) -> list[Found | None]:
    """What losses() tells of each row of a batch's column `found`, None where it is null."""
    values = column.values
    parts = [values.field(i).to_numpy(zero_copy_only=False) for i in range(3)]
    edges = column.offsets.to_numpy()
    return [tuple(x[a:b] for x in parts) if some else None for a, b, some in zip(edges[:-1].tolist(), edges[1:].tolist(), column.is_valid().to_pylist())]


def covered(size: int, found: Found, length: int) -> np.ndarray:
    """Which of a text's `size` places lie in a string of `length` that goes."""
    at, n, mask = found
    whole = mask == -1  # neighbouring strings: one stretch
    i, j = np.nonzero((mask[~whole, None] >> np.arange(MOST) & 1) & (np.arange(MOST) < n[~whole, None]))
    single = at[~whole][i] + j
    starts = np.concatenate([at[whole], single])
    ends = np.concatenate([at[whole] + n[whole] - 1, single]) + length
    change = np.bincount(starts, minlength=size + 1) - np.bincount(ends, minlength=size + 1)
    return np.cumsum(change)[:size] > 0
