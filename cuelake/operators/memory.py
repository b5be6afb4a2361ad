"""Approved-translation memory: similarity and exact top-k lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelake.functions.text import strip
from cuelake.ordered import top_k

BLOCK = 20_000


def _bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once: a column named inside a function of array elements runs once an element."""
    return F.transform(F.array(value), body)[0]


def bigrams(c: Column) -> Column:
    """Distinct character bigrams; texts of up to two characters are one gram."""
    def grams(t: Column) -> Column:
        n = F.length(t)
        two = lambda x: F.zip_with(F.slice(x, F.lit(1), n - 1), F.slice(x, F.lit(2), n - 1), lambda a, b: F.concat(a, b))
        return F.when(n == 0, F.array().cast("array<string>")).when(n <= 2, F.array(t)).otherwise(
            F.array_distinct(_bound(F.split(t, ""), two)))

    return _bound(c, grams)


def tm_similarity(query: Column, memory: Column) -> Column:
    """1 for equal texts, length ratio for containment, else Jaccard of bigrams (H6)."""
    def score(x: Column) -> Column:
        q, m = x["q"], x["m"]
        ratio = F.least(F.length(q), F.length(m)) / F.greatest(F.length(q), F.length(m))
        jaccard = _bound(F.struct(bigrams(q).alias("a"), bigrams(m).alias("b")),
                         lambda g: F.size(F.array_intersect(g["a"], g["b"])) / F.size(F.array_union(g["a"], g["b"])))
        return F.when((q == "") | (m == ""), 0.0).when(q == m, 1.0).when(q.contains(m) | m.contains(q), ratio).otherwise(jaccard)

    return _bound(F.struct(strip(query).alias("q"), strip(memory).alias("m")), score)


# Scores, characters and posting entries that are in hand at once.
SCORES, LETTERS, POSTINGS = 2_000_000, 1_000_000, 4_000_000


def _gram_codes(texts: list):
    """(row, gram) of each text's distinct grams in order, a gram as one integer; see :func:`bigrams`."""
    import numpy as np

    c = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    row = np.repeat(np.arange(len(texts)), sizes)
    # A letter's gram is it and the next one; a text of one letter is its gram, with a number that is no letter.
    inside = np.append(row[1:] == row[:-1], False) if len(row) else np.zeros(0, dtype=bool)
    follows = np.where(inside, np.append(c[1:], 0), (1 << 21) - 1) if len(row) else c
    keep = inside | (sizes[row] == 1)
    key = np.sort(row[keep] << 42 | c[keep] << 21 | follows[keep])
    key = key[np.append(True, key[1:] != key[:-1])] if len(key) else key
    return key >> 42, key & ((1 << 42) - 1)


def _query_batches(texts: list, width: int):
    """(start, end) of runs of queries with a bounded number of scores and letters."""
    start = letters = 0
    for i, t in enumerate(texts):
        if i > start and ((i - start + 1) * width > SCORES or letters + len(t) > LETTERS):
            yield start, i
            start, letters = i, 0
        letters += len(t)
    if start < len(texts):
        yield start, len(texts)


def _lookup_block(k: int):
    """Top-k of each query within one block of the memory, through a gram index; many queries are scored together."""

    def run(key, queries, memory):
        import numpy as np
        import pandas as pd

        texts = memory["source_text"].tolist()
        ids = memory["ord"].to_numpy()
        # entries in insertion order, so equal scores keep it
        order = np.argsort(ids, kind="stable")
        texts, ids = [texts[i] for i in order], ids[order]
        n = len(texts)
        names = ["qid", "ord", "score", "exact"]
        asked, qids = queries["query_text"].tolist(), queries["qid"].to_numpy()
        if not n or not asked:
            return pd.DataFrame([], columns=names)
        entry, code = _gram_codes(texts)
        sizes = np.bincount(entry, minlength=n)
        by_gram = np.argsort(code, kind="stable")
        index, first, held = np.unique(code[by_gram], return_index=True, return_counts=True)
        entry = entry[by_gram]
        # A block of few grams and entries is a matrix of zeros and ones, the sums are exact; else shared grams are counted by posting lists.
        table = None
        if len(index) * n <= POSTINGS:
            table = np.zeros((len(index), n), dtype=np.float32)
            table[np.repeat(np.arange(len(index)), held), entry] = 1
        lengths = np.array([len(t) for t in texts])
        short = np.flatnonzero(lengths == 1)
        known = set(texts)

        def by_table(table, row, at, rows):
            has = np.zeros((rows, len(index)), dtype=np.float32)
            has[row, at] = 1
            return has @ table

        def by_lists(row, at, rows):
            shared = np.zeros(rows * n, dtype=np.int64)
            # Posting lists of a bounded number of entries are laid out at a time.
            total = np.cumsum(held[at])
            cuts = np.unique(np.searchsorted(total, np.arange(0, total[-1], POSTINGS), side="right")) if len(total) else []
            for lo, hi in zip(cuts, [*cuts[1:], len(at)]):
                size = held[at[lo:hi]]
                place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first[at[lo:hi]], size)
                shared += np.bincount(np.repeat(row[lo:hi] * n, size) + entry[place], minlength=len(shared))
            return shared.reshape(rows, n)

        out = []
        for start, end in _query_batches(asked, n if table is None else max(table.shape)):
            qs = asked[start:end]
            row, code = _gram_codes(qs)
            count = np.bincount(row, minlength=len(qs))
            at = np.minimum(np.searchsorted(index, code), len(index) - 1)
            hit = index[at] == code
            row, at = row[hit], at[hit]
            shared = by_table(table, row, at, len(qs)) if table is not None else by_lists(row, at, len(qs))
            score = shared.astype(np.float64) / (count[:, None] + sizes - shared)
            # containment implies shared bigrams, but for texts of one character
            maybe = shared >= np.minimum(sizes, count[:, None])
            maybe[:, short] = True
            maybe[[i for i, q in enumerate(qs) if len(q) == 1]] = True
            for i, j in zip(*(x.tolist() for x in np.nonzero(maybe))):
                q, t = qs[i], texts[j]
                if t == q:
                    score[i, j] = 1.0
                elif t in q or q in t:
                    score[i, j] = min(len(t), len(q)) / max(len(t), len(q))
            # Only entries that score no less than the k-th can be among the k best; most share some gram with the query.
            good = score > 0
            if n > k:
                good &= score >= np.partition(score, n - k, axis=1)[:, n - k, None]
            row, pos = np.nonzero(good)
            other = np.array([qs[i] not in known or texts[j] != qs[i] for i, j in zip(row.tolist(), pos.tolist())], dtype=bool)
            value = score[row, pos]
            best = np.lexsort((pos, other, -value, row))
            sorted_rows = row[best]
            best = best[np.arange(len(best)) - np.searchsorted(sorted_rows, sorted_rows) < k]
            out.append(pd.DataFrame({"qid": qids[start + row[best]], "ord": ids[pos[best]], "score": value[best], "exact": ~other[best]}))
        return pd.concat(out, ignore_index=True)[names]

    return run


def memory_lookup(queries: DataFrame, memory: DataFrame, k: int = 5, domain: str | None = None,
                  language_pack: str | None = None, block: int = BLOCK, slices: int = 64) -> DataFrame:
    """The ``k`` best memory entries per query text of the same language pair.

    ``queries``: qid, query_text, source_lang, target_lang. ``memory``: ord, source_text and
    the same languages. The result has every query with a positive score.

    Exact without emitting pairs: the memory is cut into blocks by hash, each (slice of
    queries, block) is one task that indexes the block and returns at most ``k`` entries per
    query, and the k best of all blocks are taken. Equal queries are looked up once. Slices and
    blocks grow in number with the tables, not in size.
    """
    m = memory.select("ord", strip(F.col("source_text")).alias("source_text"), "source_lang", "target_lang",
                      *[c for c in ("domain", "language_pack") if c in memory.columns])
    if domain is not None:
        m = m.filter(F.col("domain") == domain)
    if language_pack is not None:
        m = m.filter(F.col("language_pack") == language_pack)
    m = m.filter(F.col("source_text") != "")
    lang = ["source_lang", "target_lang"]
    q = queries.withColumn("query_text", strip(F.col("query_text"))).filter(F.col("query_text") != "")
    q = q.withColumn("_h", F.xxhash64(*lang, "query_text"))
    once = q.groupBy(*lang, "query_text", "_h").agg(F.lit(1).alias("_one")).drop("_one")
    blocks = max(1, -(-m.count() // block))
    n_q = max(slices, -(-once.count() // block))
    mb = m.withColumn("_b", F.pmod(F.xxhash64("ord"), F.lit(blocks)))
    mb = mb.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1)))).withColumn("_s", F.col("_s").cast("bigint"))
    qb = (once.withColumn("_s", F.pmod("_h", F.lit(n_q)))
          .withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("_b", F.col("_b").cast("bigint"))
          .withColumn("qid", F.col("query_text")))
    on = [*lang, "_s", "_b"]
    found = (qb.select(*on, "qid", "query_text").groupBy(*on)
             .cogroup(mb.select(*on, "ord", "source_text").groupBy(*on))
             .applyInPandas(_with_langs(_lookup_block(k), lang),
                            "source_lang string, target_lang string, qid string, ord bigint, score double, exact boolean"))
    best = top_k(found, [*lang, "qid"], [F.desc("score"), F.desc("exact"), F.asc("ord")], k)
    return (q.drop("_h").join(best.withColumnRenamed("qid", "query_text"), [*lang, "query_text"]))


def _with_langs(fn, lang):
    def run(key, queries, memory):
        out = fn(key, queries, memory)
        out.insert(0, lang[0], key[0])
        out.insert(1, lang[1], key[1])
        return out
    return run


def memory_block(matches: DataFrame, keys, max_entries: int = 3) -> DataFrame:
    """Prompt text of the best entries per query; at most ``max_entries`` rows are gathered."""
    src, good, bad = strip(F.col("source_text")), strip(F.col("approved_translation")), strip(F.coalesce("bad_translation", F.lit("")))
    line = F.concat(F.lit("- Source: "), src, F.lit("\n  Approved: "), good,
                    F.when(bad != "", F.concat(F.lit("\n  Avoid: "), bad)).otherwise(""))
    top = matches.filter(F.col("rank") <= max_entries).filter((src != "") & (good != ""))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("l")))), lambda x: x["l"]), "\n")
    return top.groupBy(*keys).agg(F.concat(
        F.lit("Approved translation memory (reuse when applicable):\n"), body).alias("memory_block"))
