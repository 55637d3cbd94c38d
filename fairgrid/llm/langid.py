"""Language ID by compression: the language whose dictionary makes a text smallest.

For each language a raw-content zstandard dictionary is put together from a bounded sample of labelled texts. A text
is lower-cased, reduced to its letters and compressed block by block with each dictionary; the language with the
smallest total wins, and the text is rejected when the runner-up comes too close. How close is calibrated on labelled
texts that are held back and on random letters in their place.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fairgrid.llm.common import documents, id_crc, release_table

UNDETERMINED = "und"
NOT_LETTERS = re.compile(r"[\W\d_]+")
#: Bytes of text that are compressed at once: few enough that a text's own repeats don't hide the dictionary's help.
BLOCK = 512
#: Texts whose margin is under CLOSE are measured again at CLOSE_LEVEL with each of PARTS parts of the dictionaries, a finer scale.
CLOSE, CLOSE_LEVEL, PARTS = 0.05, 12, 4
#: Every HELD_BACK-th sampled text calibrates the margin, with dictionaries of the others; under LEAST texts nothing is calibrated.
HELD_BACK, LEAST = 5, 20
#: Random texts that one clean text outweighs in the calibration.
CLEAN = 20


@dataclass(frozen=True)
class LanguageModel:
    """Raw dictionary content by language, the language with most rows first: it wins where sizes are equal."""

    content: dict[str, bytes]
    level: int = 9
    #: Least margin, as a share of the runner-up's size, that is not rejected; ``fit`` calibrates it.
    margin: float = 0.001


def _letters(text: str) -> bytes:
    return NOT_LETTERS.sub(" ", text.lower()).strip().encode("utf-8", "surrogatepass")


def _gibberish(text: str, letters: list[str], rng: np.random.RandomState) -> str:
    """Words as long as those of ``text``, of random ``letters``."""
    return " ".join("".join(letters[k] for k in rng.randint(len(letters), size=len(w))) for w in NOT_LETTERS.sub(" ", text.lower()).split())


def calibrate(samples: dict[str, list[str]], each: int, most: int, level: int, default: float) -> float:
    """The margin between those of random letters and those of clean texts, from ``samples`` of each language.

    It lies in the gap that rejects most random texts and fewest clean ones, which count CLEAN times as much. The
    dictionaries are cut to ``most`` bytes, as those of the model are.
    """
    held = [x for own in samples.values() for x in own[::HELD_BACK] if _letters(x)]
    content = {lang: b" ".join(_letters(x)[: 4 * each] for k, x in enumerate(own) if k % HELD_BACK)[:most] for lang, own in samples.items()}
    content = {lang: data for lang, data in content.items() if data}
    if len(content) < 2 or len(held) < LEAST:
        return default
    sizes = _Sizes(LanguageModel(content, level))
    letters = sorted({c for x in held for c in NOT_LETTERS.sub("", x.lower())})
    rng = np.random.RandomState(7)

    def margins(texts: list[str]) -> list[float]:
        return [float(1 - got[0] / got[1]) for got in (np.sort(sizes.of(x)) for x in texts)]

    random, clean = np.sort(margins([_gibberish(x, letters, rng) for x in held])), np.sort(margins(held))
    at = np.unique(np.maximum(np.concatenate([[default], random, clean]), default))
    worth = np.searchsorted(random, at, "right") - CLEAN * np.searchsorted(clean, at, "right")  # of a margin just above
    best = int(np.argmax(worth))
    return float(np.sqrt(at[best] * at[min(best + 1, len(at) - 1)]))


def fit(examples: DataFrame, sample_docs: int = 400, dictionary_bytes: int = 112 << 10, level: int = 9, excerpt_chars: int = 1200, languages: int = 200) -> LanguageModel:
    """Dictionaries from ``examples`` (text, lang).

    Counts of each language cover all rows, and so does the number of its different texts, which the share to sample
    follows from, however often one text is repeated; of more than ``languages`` values of lang the commonest are learned.
    Content is taken from ``sample_docs`` distinct texts a language, those with the least hash, ``excerpt_chars``
    characters of each at a place that the hash chooses, of these four shares of ``dictionary_bytes`` by the number of
    texts, and at most ``dictionary_bytes`` in all: these are bounds of the model, not of what it is applied to. Rows with a null text or lang teach nothing. The margin is
    calibrated on the same texts.
    """
    usable = examples.where("text is not null and lang is not null").select("lang", F.xxhash64("text").alias("h"), "text")
    told = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("h").alias("texts"))
    told = told.orderBy(F.desc("n"), "lang").limit(languages).collect()
    counts = {r["lang"]: r["n"] for r in told}
    share = F.lit(0.0)
    for r in told:
        share = F.when(F.col("lang") == r["lang"], F.lit(min(1.0, 4 * sample_docs / r["texts"]))).otherwise(share)
    start = F.pmod(F.xxhash64("h", F.lit(9)), F.greatest(F.length("text") - excerpt_chars + 1, F.lit(1))).cast("int") + 1
    near = usable.where((F.pmod("h", F.lit(1 << 20)) / (1 << 20)) < share).select("lang", "h", F.substring("text", start, F.lit(excerpt_chars)).alias("text"))
    order = Window.partitionBy("lang").orderBy("h")
    chosen = near.groupBy("lang", "h").agg(F.min("text").alias("text")).withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= sample_docs)
    rows = chosen.select("lang", "h", "text").toPandas() if counts else pd.DataFrame({"lang": [], "h": [], "text": []})  # sample_docs a language
    each = max(64, dictionary_bytes // sample_docs)
    content, samples = {}, {}
    for lang, own in rows.sort_values(["lang", "h"]).groupby("lang"):
        samples[str(lang)] = list(own["text"])
        content[str(lang)] = b" ".join(_letters(x)[: 4 * each] for x in samples[str(lang)])[:dictionary_bytes]
    ordered = sorted(content, key=lambda x: (-counts[x], x))
    margin = calibrate(samples, each, dictionary_bytes, level, LanguageModel.margin)
    return LanguageModel({k: content[k] for k in ordered if content[k]}, level, margin)


class _Sizes:
    """Compressed sizes of texts with each language's dictionary."""

    def __init__(self, model: LanguageModel):
        self.languages = list(model.content)
        self.whole = [[self._compressor(model.content[x], model.level)] for x in self.languages]
        self.parts = []
        for lang in self.languages:
            content = model.content[lang]
            step = -(-len(content) // PARTS)
            self.parts.append([self._compressor(content[at : at + step], CLOSE_LEVEL) for at in range(0, len(content), step)])

    @staticmethod
    def _compressor(content: bytes, level: int) -> zstandard.ZstdCompressor:
        held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        held.precompute_compress(level=level)
        return zstandard.ZstdCompressor(dict_data=held, level=level, write_content_size=False, write_checksum=False, write_dict_id=False)

    @staticmethod
    def _measure(blocks: list[bytes], compressors: list[list[zstandard.ZstdCompressor]]) -> np.ndarray:
        return np.array([sum(len(c.compress(b)) for c in own for b in blocks) / len(own) for own in compressors])

    def of(self, text: str) -> np.ndarray | None:
        """Mean sizes by language; None without letters."""
        data = _letters(text)
        if not data:
            return None
        blocks = [data[at : at + BLOCK] for at in range(0, len(data), BLOCK)]
        sizes = self._measure(blocks, self.whole)
        if len(sizes) > 1 and np.partition(sizes, 1)[1] * (1 - CLOSE) < sizes.min():
            sizes = sizes + self._measure(blocks, self.parts)
        return sizes


def predictor(model: LanguageModel, text: Column) -> Column:
    """A struct ``lang_pred, score, margin, rejected`` of a whole text."""

    @F.pandas_udf("lang_pred string, score double, margin double, rejected boolean")
    def predict(series: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        release_table()
        sizes = _Sizes(model)
        names = sizes.languages
        for texts in series:
            rows = []
            for value in texts:
                got = sizes.of(value) if isinstance(value, str) and names else None
                if got is None:
                    rows.append((UNDETERMINED, 0.0, 0.0, True))
                    continue
                best = int(np.argmin(got))  # ties: the commonest language
                others = np.delete(got, best)
                margin = float((others.min() - got[best]) / others.min()) if len(others) else 1.0
                weights = np.exp((got[best] - got) / got[best] * 40)
                rows.append((names[best], float(1 / weights.sum()), margin, margin < model.margin))
            yield pd.DataFrame(rows, columns=["lang_pred", "score", "margin", "rejected"])

    return predict(text)


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``doc_id, lang_pred, score, margin, rejected`` for each row of ``docs``.

    Null texts and texts without letters are ``und`` with score 0 and rejected, as is every text under a model
    without languages. Very long texts are measured whole, block by block. Of equal sizes the commonest language
    wins, with margin 0. Repeated rows give repeated rows, an empty table an empty result; nothing but ``doc_id``
    and ``text`` is read.
    """
    return docs.select("doc_id", predictor(model, F.col("text")).alias("_p")).select("doc_id", "_p.*")


def training_rows(docs: DataFrame) -> DataFrame:
    """Rows outside the held-out fold: crc32 of the id modulo 3 is not 1."""
    return docs.where(F.coalesce(id_crc() % 3 != 1, F.lit(False)))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's query: every whole text of ``documents``."""
    docs = documents(spark, sf_dir)
    model = fit(training_rows(docs))
    told = docs.select("doc_id", F.coalesce(id_crc() % 3 == 1, F.lit(False)).alias("held_out"), predictor(model, F.col("text")).alias("_p"))
    return told.select("doc_id", "held_out", "_p.lang_pred", "_p.score", "_p.margin", "_p.rejected")
