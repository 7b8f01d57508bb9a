"""Language identification by rank-order n-gram profiles and out-of-place distance."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import materialize

#: n-grams kept for a profile and for a document.
PROFILE = 400
#: Labelled rows of each language that the profiles are learned from (a bounded sample by hash order).
TRAIN_ROWS = 400
#: Leading bits of a hash that rows of a language are counted by.
LEAD_BITS = 12
#: Largest number of languages whose hash bounds are broadcast.
BROADCAST_LANGUAGES = 10_000
LENGTHS = (1, 2, 3)
UNKNOWN = "und"
#: Stands for a run of other characters; above all code points, so n-grams of different lengths are different integers.
GAP = 0x1FFFFF

_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    global _letters
    if _letters is None:
        table = np.zeros(0x110000, dtype=bool)
        table[[c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and chr(c).isalpha()]] = True
        _letters = table
    return _letters


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of the lower-cased text as integers, and their counts; runs of other characters are one space."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    is_letter = letters()[points]
    if not is_letter.any():
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    points[~is_letter] = GAP
    x = points[is_letter | np.concatenate([[True], is_letter[:-1]])]
    gap = [np.uint64(GAP)]
    x = np.concatenate([[] if x[0] == GAP else gap, x, [] if x[-1] == GAP else gap]).astype(np.uint64)
    shift, found = np.uint64(21), [x[x != GAP]]
    for n in LENGTHS[1:]:
        code = x[: len(x) - n + 1]
        for i in range(1, n):
            code = (code << shift) | x[i : len(x) - n + 1 + i]
        found.append(code)
    return np.unique(np.concatenate(found), return_counts=True)


def ranked(codes: np.ndarray, counts: np.ndarray, size: int = PROFILE) -> np.ndarray:
    """The ``size`` most frequent codes, ties by code."""
    if len(codes) > size:
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        more = counts >= least
        codes, counts = codes[more], counts[more]
    return codes[np.lexsort((codes, -counts))][:size]


class Profiles:
    def __init__(self, tables: dict[str, list[int]]) -> None:
        self.names = sorted(tables)
        self.sorted, self.rank = [], []
        for name in self.names:
            codes = np.array(tables[name], dtype=np.uint64)
            order = np.argsort(codes)
            self.sorted.append(codes[order])
            self.rank.append(order)

    def predict(self, text: str | None) -> tuple[str, float]:
        codes = ranked(*grams(text))
        if not len(codes) or not self.names:
            return UNKNOWN, 0.0
        places, best = np.arange(len(codes)), (None, UNKNOWN)
        for name, have, rank in zip(self.names, self.sorted, self.rank):
            at = np.minimum(np.searchsorted(have, codes), len(have) - 1)
            hit = have[at] == codes
            out_of_place = np.where(hit, np.minimum(np.abs(rank[at] - places), PROFILE), PROFILE).sum()
            if best[0] is None or out_of_place < best[0]:
                best = (out_of_place, name)
        return best[1], float(1.0 - best[0] / (PROFILE * len(codes)))


def learn_profiles(labelled: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang", rows: int = TRAIN_ROWS) -> dict[str, list[int]]:
    """Profiles from ``rows`` rows of each non-null language, the first in the order of a hash of key and text.

    Counts by the leading bits of the hash tell how far the first ``rows`` of a language reach, so that only about these
    are sorted, however many rows a language has. Counts of n-grams are summed on the executors; each profile reaches the
    driver as ``PROFILE`` numbers.
    """
    base = labelled.select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(F.col(key), F.col(text)).alias("h")).filter("lang is not null and text is not null")
    hashes = materialize(base.select("lang", "h").withColumn("lead", F.shiftright("h", 64 - LEAD_BITS)), "langid-hashes")
    leads = hashes.groupBy("lang", "lead").agg(F.count(F.lit(1)).alias("n"))
    upto = leads.withColumn("upto", F.sum("n").over(Window.partitionBy("lang").orderBy("lead")))
    reach = upto.groupBy(F.col("lang").alias("of")).agg(F.coalesce(F.min(F.when(F.col("upto") >= rows, F.col("lead"))), F.max("lead")).alias("reach"))
    reach = materialize(reach, "langid-reach")
    if reach.count() <= BROADCAST_LANGUAGES:
        reach = F.broadcast(reach)
    first = hashes.join(reach, (F.col("lang") == F.col("of")) & (F.col("lead") <= F.col("reach"))).withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).filter(F.col("n") <= rows)
    bounds = materialize(first.groupBy(F.col("lang").alias("of")).agg(F.max("h").alias("most")), "langid-bounds")
    if bounds.count() <= BROADCAST_LANGUAGES:
        bounds = F.broadcast(bounds)
    picked = base.join(bounds, (F.col("lang") == F.col("of")) & (F.col("h") <= F.col("most"))).select("lang", "text")

    def count(batches):
        import pandas as pd

        for batch in batches:
            for name, group in batch.groupby("lang"):
                total: dict[int, int] = {}
                for value in group["text"]:
                    for code, n in zip(*(a.tolist() for a in grams(value))):
                        total[code] = total.get(code, 0) + n
                yield pd.DataFrame({"lang": name, "code": np.array(list(total), dtype=np.uint64).view(np.int64), "n": list(total.values())})

    counts = picked.mapInPandas(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    top = counts.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))).filter(F.col("r") <= PROFILE)
    tables: dict[str, list[int]] = {}
    for row in top.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("r", "code"))).alias("x")).collect():
        tables[row["lang"]] = [c for _, c in row["x"]]
    return tables


def held_out(key: str = "doc_id"):
    """Rows that profiles never learn from: crc32 of the id as text leaves remainder 1 by 3 (a null id: as empty text)."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def identify(df: DataFrame, tables: dict[str, list[int]], *, text: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """Adds the language whose profile is nearest, and 1 - distance / largest distance. One Arrow map, no shuffle."""
    from pyspark.sql.functions import pandas_udf

    profiles = Profiles(tables)

    @pandas_udf("lang string, score double")
    def predict(texts):
        import pandas as pd

        return pd.DataFrame([profiles.predict(t) for t in texts], columns=["lang", "score"])

    out = df.withColumn("_lang_found", predict(F.col(text)))
    return out.withColumns({lang_out: F.col("_lang_found.lang"), score_out: F.col("_lang_found.score")}).drop("_lang_found")


def language_id(df: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``key, held_out, lang_pred, score`` for every row; profiles learn from the rows not held out.

    A text that is null or has no letter is ``und`` with score 0. Equal texts get equal answers; ties go to the first
    language by code point; without a labelled row every text is ``und``.
    """
    tables = learn_profiles(df.filter(~held_out(key)), key=key, text=text, lang=lang)
    slim = df.select(F.col(key).alias("_key"), held_out(key).alias("_held"), F.col(text).alias("_text"))
    found = identify(slim, tables, text="_text")
    return found.select(F.col("_key").alias(key), F.col("_held").alias("held_out"), "lang_pred", "score")
