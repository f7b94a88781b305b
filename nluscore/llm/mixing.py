"""Mixing sources to target weights by fixed-length blocks and index permutations.

A source's documents, in a hashed order, form one stream of words that is cut into blocks of
``block`` words. Target weights become numbers of slots per source. Output shards draw how many of
their slots each source fills (multinomial draws conditional on the sources' totals, so the sums are
exact). A source numbers its slots over the shards; slot i takes the block
permutation_epoch(i mod blocks) with epoch = i div blocks, a keyed Feistel permutation of the block
indexes, so a source runs through all its blocks before any is repeated. Documents and slots meet
in a join by (source, block): a block has at most three slots and at most ``block`` non-empty
documents, so a source that holds a third of all rows is spread over its blocks.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import need, stored

#: Words in a block; output shards; slots one task row spreads out; fixed cycle of weights.
BLOCK, SHARDS, SPREAD = 64, 256, 1 << 16
WEIGHTS, MOST = (5, 2, 1), 3


def size_of(text: Column) -> Column:
    """Words: stretches without ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: list[float], most: float = MOST) -> list[float]:
    """Shares of the sum of all sizes by weight, none above ``most`` times its own size."""
    total, fixed = float(sum(sizes)), [False] * len(sizes)
    out = [0.0] * len(sizes)
    while not all(fixed):
        rest = total - sum(o for o, f in zip(out, fixed) if f)
        weight = sum(w for w, f in zip(weights, fixed) if not f)
        over = False
        for k, f in enumerate(fixed):
            if not f:
                out[k] = rest * weights[k] / weight
        for k, f in enumerate(fixed):
            if not f and out[k] > most * sizes[k]:
                out[k], fixed[k], over = float(most * sizes[k]), True, True
        if not over:
            break
    return out


def permuted(slots: DataFrame, index: str, key: str, n: str, out: str) -> DataFrame:
    """Adds ``out``: the place of ``index`` in the ``key``-ed pseudorandom permutation of 0 .. n - 1.

    A Feistel network on the next power of four, applied until the value falls below n
    (cycle-walking keeps it a permutation); four steps at most are expected, loops run until all have.
    """
    half = F.greatest(F.lit(1), F.ceil(F.log2(F.col(n).cast("double")) / 2)).cast("int")
    d = slots.withColumn("__half", half).withColumn("__at", F.col(index).cast("long"))
    return d.withColumn(out, _walk(F.col("__at"), F.col(key), F.col("__half"), F.col(n))).drop("__half", "__at")


def _walk(at: Column, key: Column, half: Column, n: Column) -> Column:
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("long")
    def walk(a, k, h, m):
        import pandas as pd

        def mix(x: np.ndarray) -> np.ndarray:
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            return x ^ (x >> np.uint64(31))

        x = a.to_numpy().astype(np.uint64)
        keys, halves, limit = k.to_numpy().astype(np.int64).view(np.uint64), h.to_numpy().astype(np.uint64), m.to_numpy().astype(np.uint64)
        low = (np.uint64(1) << halves) - np.uint64(1)
        todo = np.arange(len(x))
        with np.errstate(over="ignore"):
            while len(todo):
                hh, ll, kk = halves[todo], low[todo], keys[todo]
                left, right = x[todo] >> hh, x[todo] & ll
                for r in range(4):
                    left, right = right, left ^ (mix(right + kk + np.uint64((r + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) & ll)
                x[todo] = (left << hh) | right
                todo = todo[x[todo] >= limit[todo]]
        return pd.Series(x.astype(np.int64))

    return walk(at, key, half, n)


def placed(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(id, key, source, size, source_size, first): every row's place in its source's stream, written once.

    Running sums in two levels, so that no window holds a source: a source's rows are dealt by a hash of
    (id, text) to as many buckets as the square root of all rows; sums run over a source's buckets and
    over a bucket's rows. A source's order is (bucket, hash, id); repeated rows follow each other.
    """
    d = stored(need(docs, id_col, text, source).select(
        F.col(id_col).alias("id"), F.col(source).alias("source"), F.xxhash64(F.col(id_col), F.col(text)).alias("key"),
        size_of(F.col(text)).alias("size")), "sizes")
    buckets = max(1, int(d.count() ** 0.5))
    d = d.withColumn("bucket", F.pmod(F.xxhash64(F.lit("bucket"), "key"), F.lit(buckets)).cast("int"))
    by_bucket = d.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = stored(by_bucket.withColumn("start", F.coalesce(F.sum("bucket_size").over(before), F.lit(0))), "starts")
    inside = Window.partitionBy("source", "bucket").orderBy("key", "id").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    same = d["source"].eqNullSafe(starts["source"]) & (d["bucket"] == starts["bucket"])
    return stored(d.join(starts, same).select(d["id"], "key", d["source"], "size", (F.col("start") + F.col("within")).alias("first")), "placed")


def plan(sizes: list[tuple[str | None, int]], block: int = BLOCK, shards: int = SHARDS, seed: int = 42
         ) -> tuple[list[dict], np.ndarray]:
    """Per source target, blocks and slots; (shard, source) counts of slots drawn for each output shard."""
    order = sorted(sizes, key=lambda s: (s[0] is None, s[0] or ""))
    weights = [float(WEIGHTS[k % len(WEIGHTS)]) for k in range(len(order))]
    goal = targets([n for _, n in order], weights)
    rows = []
    for (name, n), t in zip(order, goal):
        blocks = -(-n // block)
        slots = min(round(t * blocks / n), MOST * blocks) if n else 0
        rows.append({"source": name, "source_size": n, "target": t, "blocks": blocks, "slots": slots})
    rest = np.array([r["slots"] for r in rows], np.int64)
    draws = np.zeros((shards, len(rows)), np.int64)
    rng = np.random.default_rng(seed)
    for s in range(shards):
        want = int(rest.sum()) // (shards - s)
        if want:
            share = rest / rest.sum()
            got = np.minimum(rng.multinomial(want, share), rest)
            while (short := want - int(got.sum())) > 0:  # what a source can't fill any more goes to the others
                left = rest - got
                got = np.minimum(got + rng.multinomial(short, left / left.sum()), rest)
            draws[s] = got
            rest = rest - got
    return rows, draws


def slot_table(docs: DataFrame, rows: list[dict], draws: np.ndarray, seed: int = 42) -> DataFrame:
    """Every slot of the mix: (shard, source_no, slot, epoch, block)."""
    spark = docs.sparkSession
    ends = np.cumsum(draws, axis=0)
    runs = [(s, k, int(ends[s, k] - draws[s, k]), int(draws[s, k]), rows[k]["blocks"])
            for s in range(draws.shape[0]) for k in range(draws.shape[1]) if draws[s, k]]
    schema = "shard int, source_no int, start bigint, n bigint, blocks bigint"
    run = spark.createDataFrame(runs, schema)
    run = run.select("shard", "source_no", "blocks", (F.col("start") + F.col("n") - 1).alias("last"),
                     F.explode(F.expr(f"sequence(start, start + n - 1, {SPREAD}L)")).alias("from"))
    run = run.repartition(spark.sparkContext.defaultParallelism * 4, "shard", "source_no", "from")
    slots = run.select("shard", "source_no", "blocks", F.explode(F.expr(f"sequence(from, least(last, from + {SPREAD - 1}))")).alias("slot"))
    slots = slots.withColumn("epoch", F.expr("slot div blocks")).withColumn("at", F.expr("slot % blocks"))
    slots = slots.withColumn("key", F.xxhash64(F.lit(seed), "source_no", "epoch"))
    return permuted(slots, "at", "key", "blocks", "block").select("shard", "source_no", "slot", "epoch", "block")


def mix(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source",
        block: int = BLOCK, shards: int = SHARDS, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(documents with their place and source figures, taken stretches).

    Documents: id, key, source, size, source_size, target, first. Stretches: id, key, lo, hi, times:
    words lo .. hi - 1 of a document are in the mix ``times`` times, of documents with any.
    Null sources are a source of their own and come last; null texts have no words. The driver holds
    one row per source and one number per source and shard.
    """
    d = placed(docs, id_col, text, source)
    sizes = [(r[0], int(r[1])) for r in d.groupBy("source").agg(F.sum("size")).collect()]
    rows, draws = plan(sizes, block, shards, seed)
    spark = docs.sparkSession
    table = spark.createDataFrame(
        [(k, r["source"], r["source_size"], r["target"]) for k, r in enumerate(rows)],
        "source_no int, source string, source_size bigint, target double")
    d = d.withColumn("source", F.col("source").cast("string"))
    d = d.join(table, d["source"].eqNullSafe(table["source"])).select(
        "id", "key", d["source"], "source_no", "size", "source_size", "target", "first")
    # Slots grow with the input, but a plan sees only the few rows they are spread from: no broadcast here.
    times = slot_table(docs, rows, draws, seed).groupBy("source_no", "block").agg(F.count("*").alias("times")).hint("merge")
    spans = d.where("size > 0").select(
        "id", "key", "source_no", "first", "size",
        F.explode(F.expr(f"sequence(first div {block}, (first + size - 1) div {block})")).alias("block"))
    got = spans.join(times, ["source_no", "block"]).select(
        "id", "key", "times", "first",
        F.greatest(F.expr(f"block * {block} - first"), F.lit(0)).alias("lo"),
        F.least(F.expr(f"(block + 1) * {block} - first"), F.col("size")).alias("hi"))
    return d, got


def mixed_counts(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, size, source_size, target, taken), one row per input row.

    taken counts the words of the row that the mix takes, repeats included; empty and null texts have
    none. Repeated rows stand next to each other in their source's stream and are counted each for itself.
    """
    d, got = mix(docs, id_col, text, source)
    taken = got.groupBy("id", "key", "first").agg(F.sum((F.col("hi") - F.col("lo")) * F.col("times")).alias("got"))
    t = taken.select(F.col("id").alias("id2"), F.col("key").alias("key2"), F.col("first").alias("first2"), "got")
    same = d["id"].eqNullSafe(t["id2"]) & (d["key"] == t["key2"]) & (d["first"] == t["first2"]) & (d["size"] > 0)
    return d.join(t, same, "left").select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", F.coalesce("got", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mix as rows with the columns of ``docs``: copy k of a row holds its words taken at least k times.

    A wholly taken text stays as it is, of others the taken stretches remain, each as it stands in the
    text, joined by a space. n_chars, if there, follows the text. Rows without a taken word go.
    """
    columns = docs.columns
    _, got = mix(docs, id_col, text, source)
    # Ids as text, null as empty: one plain shuffle key for the join and for telling repeated rows apart.
    name = F.coalesce(F.col("id").cast("string"), F.lit(""))
    spans = (got.groupBy(name.alias("__id"), F.col("key").alias("__key"), "first")
             .agg(F.array_sort(F.collect_list(F.struct("lo", "hi", "times"))).alias("spans"))
             .groupBy("__id", "__key").agg(F.array_sort(F.collect_list(F.struct("first", "spans"))).alias("__all")))
    # all source columns travel in one struct: their names can't meet those made here
    keyed = docs.select(F.struct(*(docs[c] for c in columns)).alias("row"), F.coalesce(docs[id_col].cast("string"), F.lit("")).alias("__id"),
                        F.xxhash64(docs[id_col], docs[text]).alias("__key"))
    nth = F.row_number().over(Window.partitionBy("__id", "__key").orderBy(F.lit(0)))
    j = keyed.join(spans, ["__id", "__key"]).withColumn("__nth", nth).where(F.col("__nth") <= F.size("__all"))
    j = j.withColumn("spans", F.element_at("__all", F.col("__nth"))["spans"])
    copies = j.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.array_max(F.col("spans.times")))))

    @F.pandas_udf("string")
    def cut(texts, spans, copy):
        import re

        import pandas as pd

        word = re.compile(r"[^\x20\x09-\x0D]+")
        out = []
        for t, all_spans, k in zip(texts, spans, copy):
            runs = []
            for s in all_spans:
                if s["times"] >= k:
                    if runs and runs[-1][1] == s["lo"]:
                        runs[-1][1] = s["hi"]
                    else:
                        runs.append([s["lo"], s["hi"]])
            at = [(m.start(), m.end()) for m in word.finditer(t)]
            whole = runs == [[0, len(at)]]
            out.append(t if whole else " ".join(t[at[lo][0]:at[hi - 1][1]] for lo, hi in runs))
        return pd.Series(out)

    row = F.col("row")
    out = copies.withColumn("__text", cut(row[text], F.col("spans"), F.col("__copy")))
    made = {text: F.col("__text")} | ({"n_chars": F.char_length("__text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in columns else {})
    return out.select(*((made[c] if c in made else row[c]).alias(c) for c in columns))
