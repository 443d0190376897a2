"""How the sources of a language differ in their words, priced exactly.

1. Terms are counted per (language, source) inside each task; tasks send counts.
2. A language keeps the terms of at least ``least_docs`` of its documents.  Each
   kept term is one row with its count in every source that has it.
3. One-hot level products: of a block of terms, each source has one indicator
   column for each count that occurs, zero included.  The product of that matrix
   with its transpose holds, for every two sources, how many terms have which
   two counts: their joint table.  A task prices its tables and sends one number
   for each ordered pair of sources; Spark adds them up.  Products are of 0 and 1
   over at most ``TERMS`` terms, so 32-bit floats hold them exactly.
4. Sources are dealt to blocks of ``SOURCES`` columns and terms to chunks by their
   hash, so neither a frequent term nor a large source fills a task.  Terms that
   neither block has are counted, not multiplied.

Shares are p = 1 + floor(1e9 (count + 1) / (N + V)) and prices floor((p-q)^2 / q),
in whole numbers throughout.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, stored

ONE = 1_000_000_000
LEAST_DOCS, MOST_TERMS_SHOWN = 3, 200
TERMS, SOURCES, COLUMNS = 2_048, 64, 1_536
_HELD_TERMS = 150_000  # counts a task holds before it sends them on
#: Letters of ASCII, lower-cased, and all bytes of other characters; the rest separates terms.
_LETTERS = bytes(b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """Runs of ASCII letters and characters beyond ASCII, A-Z lower-cased."""
    return text.translate(_LETTERS).split()


def term_counts(docs: DataFrame) -> DataFrame:
    """``lang, source, term, n, docs``, in parts to be added up; a null field is ''.

    Each (lang, source) also has rows of the term '' with zeros, so that a group
    without terms is known.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, str], Counter] = defaultdict(Counter)
        found: dict[tuple[str, str], Counter] = defaultdict(Counter)

        def rows() -> pa.RecordBatch:
            langs, sources, terms, n, docs_with = [], [], [], [], []
            for key, own in counts.items():
                langs += [key[0]] * len(own)
                sources += [key[1]] * len(own)
                terms += own.keys()
                n += own.values()
                docs_with += map(found[key].__getitem__, own)
            arrays = [pa.array(langs, pa.string()), pa.array(sources, pa.string()), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(docs_with, pa.int64())]
            counts.clear()
            found.clear()
            return pa.RecordBatch.from_arrays(arrays, names=["lang", "source", "term", "n", "docs"])

        held = 0
        for batch in batches:
            langs, sources = (batch.column(k).to_pylist() for k in (0, 1))
            for key, text in zip(zip(langs, sources, strict=True), batch.column(2).to_pylist(), strict=True):
                own = counts[key]
                before = len(own)
                own[b""] += 0
                if text:
                    words = terms_of(text)
                    own.update(words)
                    found[key].update(set(words))
                held += len(own) - before
                if held > _HELD_TERMS:
                    yield rows()
                    held = 0
        if counts:
            yield rows()

    field = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    read = docs.select(field("lang"), field("source"), F.col("text").cast("string").cast("binary").alias("text"))
    return read.mapInArrow(run, "lang string, source string, term string, n bigint, docs bigint")


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(1e9 (count + 1) / (total + kept)), exact beyond 64 bits; null without kept terms."""
    wide = lambda c: c.cast("decimal(19,0)")
    whole = F.call_function("div", wide(count + 1) * F.lit(ONE).cast("decimal(10,0)"), F.nullif(wide(total + kept), F.lit(0)))
    return (whole + 1).cast("bigint")


def price(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q)."""
    return F.call_function("div", (p - q) * (p - q), q)


def _shares(levels: np.ndarray, total: int, kept: int) -> np.ndarray:
    return np.array([1 + ONE * (c + 1) // (total + kept) for c in levels.tolist()], np.int64)


def joint_prices(counts: np.ndarray, totals: list[int], kept: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sum over terms of the price of each ordered pair of sources.

    ``counts`` is terms by sources.  Blocks of terms are multiplied as indicator
    columns; only pairs of one source in ``left`` and one in ``right`` count.
    """
    out = np.zeros((len(totals), len(totals)), np.int64)
    wanted = np.outer(left, right) | np.outer(right, left)
    np.fill_diagonal(wanted, False)
    # alike terms side by side, so that a block has few levels
    todo = [counts[np.argsort(counts.sum(axis=1), kind="stable")]]
    while todo:
        block = todo.pop()
        levels = [np.unique(block[:, g], return_inverse=True) for g in range(block.shape[1])]
        columns = sum(len(v) for v, _ in levels)
        if columns > COLUMNS and len(block) > 1:
            todo += [block[: len(block) // 2], block[len(block) // 2 :]]
            continue
        starts = np.cumsum([0, *(len(v) for v, _ in levels)])
        hot = np.zeros((len(block), columns), np.float32)
        for g, (_, place) in enumerate(levels):
            hot[np.arange(len(block)), starts[g] + place.ravel()] = 1
        joint = hot.T @ hot
        owner = np.repeat(np.arange(len(totals)), np.diff(starts))
        p = np.concatenate([_shares(v, t, kept) for (v, _), t in zip(levels, totals, strict=True)])
        i, j = np.nonzero(joint)
        chosen = wanted[owner[i], owner[j]]
        i, j = i[chosen], j[chosen]
        values = np.square(p[i] - p[j]) // p[j] * joint[i, j].astype(np.int64)
        np.add.at(out, (owner[i], owner[j]), values)
    return out


def _pair_values(rows: DataFrame, sides: DataFrame) -> DataFrame:
    """``lang, i, j, value, terms``: prices summed over chunks of rows ``lang, a, b, chunk, entries``.

    ``sides`` has the sources of each chunk: ``lang, a, b, chunk, i, block, total, kept``.
    """

    def run(terms: pa.Table, info: pa.Table) -> pa.Table:
        empty = pa.table({"lang": pa.array([], pa.string()), **{c: pa.array([], pa.int64()) for c in ("i", "j", "value", "terms")}})
        if not terms.num_rows or not info.num_rows:
            return empty
        order = info.sort_by("i")
        index, block = (order[c].to_numpy() for c in ("i", "block"))
        counts = np.zeros((terms.num_rows, len(index)), np.int64)
        lists = terms["entries"].combine_chunks()
        entries = lists.flatten()
        sizes = np.array([len(e) for e in lists], np.int64)
        at = np.searchsorted(index, entries.field("i").to_numpy())
        counts[np.repeat(np.arange(len(sizes)), sizes), at] = entries.field("n").to_numpy()
        a, b = terms["a"][0].as_py(), terms["b"][0].as_py()
        prices = joint_prices(counts, order["total"].to_pylist(), order["kept"][0].as_py(), block == a, block == b)
        i, j = np.nonzero((np.outer(block == a, block == b) | np.outer(block == b, block == a)) & ~np.eye(len(index), dtype=bool))
        n = len(i)
        return pa.table({"lang": pa.array([terms["lang"][0].as_py()] * n, pa.string()), "i": index[i].astype(np.int64), "j": index[j].astype(np.int64), "value": prices[i, j], "terms": np.full(n, terms.num_rows, np.int64)})

    keys = ["lang", "a", "b", "chunk"]
    named = sides.select(*[F.col(k).alias(f"of_{k}") for k in keys], "i", "block", "total", "kept")
    parts = rows.groupBy(*keys).cogroup(named.groupBy(*[f"of_{k}" for k in keys])).applyInArrow(run, "lang string, i bigint, j bigint, value bigint, terms bigint")
    return parts.groupBy("lang", "i", "j").agg(F.sum("value").alias("value"), F.sum("terms").alias("terms"))


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, most_terms: int = MOST_TERMS_SHOWN, terms: int = TERMS, sources: int = SOURCES) -> DataFrame:
    """``lang, source, part, item, value, rank`` for every (lang, source) that occurs.

    Part ``pair`` has each other source of the language, by how far the group's
    shares are from that source's over all kept terms; part ``term`` has the
    ``most_terms`` terms that the group has more of than the language.  Equal
    values rank by item.  Null text, lang and source count as ''; repeated rows
    are documents of their own; long texts are counted as they are read; a
    language without kept terms has pairs of value 0 and no terms; an empty
    table gives no rows.  Other columns are not read.  A row holds a term's
    counts in all sources of its language, and the result all pairs of sources.
    """
    parts = term_counts(docs).repartition("lang", "term")
    per_source = parts.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    per_term = per_source.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "n")).alias("entries"), F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    found = stored(per_term.where((F.col("docs") >= least_docs) | (F.col("term") == "")))
    kept = found.where("term <> ''")
    cells = kept.select("lang", "term", F.col("n").alias("lang_n"), F.inline("entries"))
    groups = found.where("term = ''").select("lang", F.explode("entries.source").alias("source"))
    by_lang = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("n").alias("lang_total"))
    by_group = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    numbered = Window.partitionBy("lang").orderBy("source")
    # one row for each group; a language's groups are as many as the pairs of a row of the result
    groups = groups.join(by_group, ["lang", "source"], "left").join(by_lang, "lang", "left").na.fill(0, ["total", "kept", "lang_total"])
    groups = stored(groups.withColumn("i", F.row_number().over(numbered).cast("bigint") - 1).withColumn("block", F.floor(F.col("i") / sources)))

    # products: a term goes to each pair of blocks one of which has it
    chunks = by_lang.select("lang", F.ceil(F.col("kept") / terms).alias("chunks"))
    blocks = groups.groupBy("lang").agg(F.max("block").alias("last"))
    held = cells.join(bounded(groups.select("lang", "source", "i", "block")), ["lang", "source"]).groupBy("lang", "term").agg(F.collect_list(F.struct("i", "block", "n")).alias("entries"))
    held = held.join(F.broadcast(chunks.join(blocks, "lang")), "lang").withColumn("chunk", F.pmod(F.xxhash64("term"), F.col("chunks")))
    touched = F.explode(F.array_distinct(F.col("entries.block"))).alias("own")
    pairs = held.select("lang", "term", "chunk", "entries", "last", touched).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("last"))))
    has_other = F.array_contains(F.col("entries.block"), F.col("other"))
    # a term that both blocks have goes there once
    pairs = pairs.where((F.col("own") <= F.col("other")) | ~has_other).select("lang", "chunk", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "entries")
    pairs = pairs.select("lang", "a", "b", "chunk", F.expr("transform(filter(entries, e -> e.block = a or e.block = b), e -> struct(e.i as i, e.n as n))").alias("entries"))
    ranges = chunks.join(blocks, "lang").select("lang", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1)).alias("chunk"), "last")
    ranges = ranges.select("lang", "chunk", "last", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("last"))).alias("a"))
    ranges = ranges.select("lang", "chunk", "a", F.explode(F.sequence(F.col("a"), F.col("last"))).alias("b"))
    sides = ranges.select("lang", "a", "b", "chunk", F.explode(F.array_distinct(F.array("a", "b"))).alias("block")).join(groups, ["lang", "block"]).select("lang", "a", "b", "chunk", "i", "block", "total", "kept")
    priced = _pair_values(pairs, sides).withColumnsRenamed({"value": "priced"})

    own = groups.select("lang", "source", "i", "total", "kept")
    others = groups.select("lang", F.col("source").alias("item"), F.col("i").alias("j"), F.col("total").alias("other_total"))
    # all ordered pairs of sources of a language are the result itself
    every = own.join(others, "lang").where("i <> j").join(priced, ["lang", "i", "j"], "left")
    unseen = (F.col("kept") - F.coalesce("terms", F.lit(0))) * price(share(F.lit(0), F.col("total"), F.col("kept")), share(F.lit(0), F.col("other_total"), F.col("kept")))
    value = F.when(F.col("kept") > 0, F.coalesce("priced", F.lit(0)) + unseen).otherwise(F.lit(0)).cast("bigint")
    by_pair = every.select("lang", "source", F.lit("pair").alias("part"), "item", value.alias("value"))

    p, q = share(F.col("n"), F.col("total"), F.col("kept")), share(F.col("lang_n"), F.col("lang_total"), F.col("kept"))
    sized = groups.select("lang", "source", "total", "kept", "lang_total")
    more = cells.where("n > 0").join(bounded(sized), ["lang", "source"]).select("lang", "source", "term", p.alias("p"), q.alias("q")).where("p > q")
    by_term = more.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), price(F.col("p"), F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    # Spark keeps the first rows of a group in each task before it brings the group together
    top = by_term.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most_terms)
    return by_pair.withColumn("rank", F.row_number().over(order)).unionByName(top)
