"""Language identification, words first: a known word scores by its log frequency in each language; an unknown one by
the longest of its character runs that are known, from LONGEST characters down to one.

The model is fitted on a bounded sample: of every language at most TEXTS whole texts (fewer, if there are more than SAMPLE /
TEXTS languages, so that all have SAMPLE at most), those with the smallest hashes of their ids, one text of each id (the
smallest). It keeps the WORDS most frequent words of a language and its RUNS most frequent runs of each length. A model has
a number for each entry and language; with so many languages that these would be more than CELLS, each keeps a
smaller share of its words and runs, and none is left out. Prediction covers all rows and whole texts. Languages that have
a row to learn from are those that can be predicted; rows without language or id teach nothing. Null, empty and letterless
texts, and any text if nothing was learned, are `und` with score 0.

The score is the share of the predicted language in the likelihoods, the mean of the words' log likelihoods being
counted as that of at most EVIDENCE independent words. Ties go to the language that is first by name. Very long texts count word by word; rows that repeat
an id are predicted each by its own text; an empty table gives an empty result. A column of the table that has the name of
a new one is replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirefold.llm.common import append_by_arrow, cut

UNDETERMINED = "und"
WORD = re.compile(r"[^\W\d_]+")
LONGEST = 5
TEXTS, WORDS, RUNS, EVIDENCE = 2000, 20_000, 10_000, 20
SAMPLE, CELLS = 64_000, 16_000_000
#: Languages whose sizes are broadcast at most; beyond, Spark joins as it sees fit.
BROADCAST = 10_000
#: Words of a text, and numbers of words and languages, that are added up at once.
SEGMENT, AT_ONCE = 10_000, 2_000_000


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def runs_of(word: str, n: int) -> list[str]:
    """Runs of n characters, the ends of the word marked; single ones without marks."""
    marked = f"^{word}$" if n > 1 else word
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


@dataclass
class Model:
    languages: list[str]
    #: By length of runs, whole words under 0: the log frequency of each in each language.
    tables: dict[int, dict[str, int]]
    logs: dict[int, np.ndarray]

    def of_words(self, found: list[str]) -> np.ndarray:
        """The log frequencies of each word, a row each: its own, or the mean of those of its longest known runs."""
        out = np.zeros((len(found), len(self.languages)))
        at = np.fromiter((self.tables[0].get(w, -1) for w in found), np.int64, len(found))
        out[at >= 0] = self.logs[0][at[at >= 0]]
        left = np.flatnonzero(at < 0).tolist()
        for n in range(LONGEST, 0, -1):
            number = self.tables[n].get
            done, sizes, flat, rest = [], [], [], []
            for i in left:
                if known := [k for r in runs_of(found[i], n) if (k := number(r)) is not None]:
                    done.append(i)
                    sizes.append(len(known))
                    flat += known
                else:
                    rest.append(i)
            if done:
                starts = np.cumsum(sizes) - sizes
                out[done] = np.add.reduceat(self.logs[n][flat], starts, axis=0) / np.array(sizes)[:, None]
            left = rest
        return out

    def predict_all(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """The language and the score of each text. Of many texts at once, each different word is looked up once."""
        counts = np.zeros(len(texts), np.int64)
        totals = np.zeros((len(texts), len(self.languages)))
        held: list[tuple[int, list[str]]] = []
        n = 0

        def flush() -> None:
            ids: dict[str, int] = {}
            flat = [ids.setdefault(w, len(ids)) for _, part in held for w in part]
            sizes = np.array([len(part) for _, part in held])
            sums = np.add.reduceat(self.of_words(list(ids))[flat], np.cumsum(sizes) - sizes, axis=0)
            np.add.at(totals, [i for i, _ in held], sums)

        for i, text in enumerate(texts if self.languages else []):
            found = words(text)
            counts[i] = len(found)
            for k in range(0, len(found), SEGMENT):
                held.append((i, found[k : k + SEGMENT]))
                n += len(held[-1][1])
                if n * len(self.languages) > AT_ONCE:
                    flush()
                    held, n = [], 0
        if held:
            flush()
        out = []
        for total, count in zip(totals, counts.tolist(), strict=True):
            if not count:
                out.append((UNDETERMINED, 0.0))
                continue
            total = total * (min(count, EVIDENCE) / count)
            best = int(total.argmax())
            out.append((self.languages[best], float(1 / np.exp(total - total[best]).sum())))
        return out

    def predict(self, text: str | None) -> tuple[str, float]:
        return self.predict_all([text])[0]


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train: F.Column | None = None) -> Model:
    """train: which rows may be learned from; all, if None."""
    taught = docs.where(F.lit(True) if train is None else train).where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull())
    taught = taught.where(F.col(lang_col) != UNDETERMINED)
    # only rows of low hashes are ranked, as many as texts and six standard deviations on average: a language of any size
    # sends no more to the task that ranks it
    sizes = cut(taught.groupBy(lang_col).agg(F.count("*").alias("of")))
    n_languages = max(1, sizes.count())
    texts = max(1, min(TEXTS, SAMPLE // n_languages))
    share = min(1.0, CELLS / ((WORDS + LONGEST * RUNS) * n_languages**2))
    n_words, n_runs = (max(1, int(n * share)) for n in (WORDS, RUNS))
    low = (F.col("of") * (F.shiftrightunsigned(F.xxhash64(id_col), 32) / 2.0**32)) <= texts + 6 * texts**0.5
    sizes = F.broadcast(sizes) if n_languages <= BROADCAST else sizes
    order = Window.partitionBy(lang_col).orderBy(F.shiftrightunsigned(F.xxhash64(id_col), 32), id_col)
    chosen = taught.select(id_col, lang_col).join(sizes, lang_col).where(low).select(id_col, lang_col).distinct()
    chosen = cut(chosen.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= texts).select(id_col, F.col(lang_col).alias("lang")))
    told = taught.select(id_col, F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    # SAMPLE ids, or one a language
    sample = told.join(F.broadcast(chosen), [id_col, "lang"]).groupBy(id_col, "lang").agg(F.min("text").alias("text")).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                seen.setdefault(lang, Counter()).update(words(text.as_py()))
        rows: list[tuple[str, int, str, int]] = []
        for lang, counts in seen.items():
            rows += [(lang, 0, w, c) for w, c in counts.items()]
            for n in range(1, LONGEST + 1):
                of = Counter()
                for w, c in counts.items():
                    for r in runs_of(w, n):
                        of[r] += c
                rows += [(lang, n, r, c) for r, c in of.items()]
        for i in range(0, len(rows), 50_000):
            part = list(zip(*rows[i : i + 50_000], strict=True))
            yield pa.record_batch([pa.array(part[0], pa.string()), pa.array(part[1], pa.int32()), pa.array(part[2], pa.string()), pa.array(part[3], pa.int64())], names=["lang", "n", "run", "seen"])

    counted = cut(sample.repartition(8).mapInArrow(count, "lang string, n int, run string, seen long").groupBy("lang", "n", "run").agg(F.sum("seen").alias("seen")))
    top = Window.partitionBy("lang", "n").orderBy(F.desc("seen"), "run")
    kept = counted.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= F.when(F.col("n") == 0, n_words).otherwise(n_runs))
    totals = {(r.lang, r.n): r.all for r in counted.groupBy("lang", "n").agg(F.sum("seen").alias("all")).collect()}
    languages = sorted({lang for lang, _ in totals})
    column = {lang: i for i, lang in enumerate(languages)}
    tables: dict[int, dict[str, int]] = {}
    logs = {}
    rows = kept.select("lang", "n", "run", "seen").toArrow()  # CELLS / languages at most
    for n in range(LONGEST + 1):
        own = rows.filter(pc.equal(rows.column("n"), n))
        runs = pc.unique(own.column("run"))
        tables[n] = {r: i for i, r in enumerate(runs.to_pylist())}
        seen = np.zeros((len(runs), len(languages)))
        at = pc.index_in(own.column("run"), runs).to_numpy()
        seen[at, np.array([column[x] for x in own.column("lang").to_pylist()], int)] = own.column("seen").to_numpy()
        all_ = np.array([totals.get((lang, n), 0) for lang in languages], float)
        logs[n] = np.log((seen + 0.5) / (all_ + 0.5 * (len(runs) + 1)))
    return Model(languages, tables, logs)


def predict(df: DataFrame, model: Model, text_col: str = "text", lang_col: str = "lang_pred", score_col: str = "score", keep: list[str] | None = None) -> DataFrame:
    """df's columns `keep` (all, if None), the predicted language and its score."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # CELLS numbers at most

    def build():
        own = shared.value

        def compute(columns: list[pa.Array]) -> list[pa.Array]:
            made = own.predict_all(columns[0].to_pylist())
            return [pa.array([lang for lang, _ in made], pa.string()), pa.array([s for _, s in made], pa.float64())]

        return compute

    return append_by_arrow(df, [T.StructField(lang_col, T.StringType()), T.StructField(score_col, T.DoubleType())], build, [text_col], keep)
