"""Language identification by compression: the language whose dictionary shortens a text most.

``fit`` gathers a bounded sample of labelled texts per language and lays it end to end as a zstandard raw-content
dictionary. ``predict`` normalises a whole text (lower case, letters only), cuts it into chunks, compresses every chunk
against every dictionary and sums the sizes. The smallest sum wins; a narrow margin marks the answer as rejected.

Defined results: null, empty or letterless texts give ``und`` with score 0. Equal sums go to the language that is more
frequent in the sample's population, then to the smaller name. With no labelled row every text is ``und``. Numerals such
as \u00bd or \u2167 are no letters. Repeated rows each get a row. Other columns of the input are not read.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

UNDETERMINED = "und"
_NOT_LETTERS = re.compile(r"[\W\d_]+")


def normalise(text: str) -> bytes:
    """The whole text in lower case, every run of marks, digits and white space as one space."""
    return (" " + _NOT_LETTERS.sub(" ", text.lower()).strip() + " ").encode("utf-8", "replace")


@dataclass
class LanguageModel:
    """One raw-content dictionary per language. Bounded by docs_per_language * chars_per_doc for each language."""

    dictionaries: dict[str, bytes]
    prior: dict[str, int]
    level: int = 3
    chunk: int = 4096
    #: A margin under this share of the best size rejects the answer.
    min_margin: float = 0.01
    _compressors: dict = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"_compressors": {}}

    def compressors(self) -> dict:
        if not self._compressors:
            longest = max(map(len, self.dictionaries.values()))  # one set of coder settings for all, else sizes don't compare
            for lang, raw in self.dictionaries.items():
                params = zstandard.ZstdCompressionParameters.from_level(self.level, source_size=self.chunk, dict_size=longest, write_content_size=False, write_checksum=False, write_dict_id=False)
                d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(compression_params=params)
                self._compressors[lang] = zstandard.ZstdCompressor(dict_data=d, compression_params=params)
        return self._compressors

    def classify(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score from 0 to 1, rejected)."""
        if not text or not self.dictionaries or not any(map(str.isalpha, text)):
            return UNDETERMINED, 0.0, True
        data = normalise(text)
        cuts = range(0, len(data), self.chunk)
        sizes = {lang: sum(len(c.compress(data[i : i + self.chunk])) for i in cuts) for lang, c in self.compressors().items()}
        order = sorted(sizes, key=lambda k: (sizes[k], -self.prior.get(k, 0), k))
        best = sizes[order[0]]
        # Sizes are bytes of code: a difference of d bytes is odds of 256**d, tempered because the coder is not ideal.
        score = 1.0 / sum(math.exp(-min(700.0, (s - best) * 0.5)) for s in sizes.values())
        margin = (sizes[order[1]] - best) / best if len(order) > 1 else 1.0
        return order[0], score, margin < self.min_margin


def fit(train: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", docs_per_language: int = 512, chars_per_doc: int = 512, **settings) -> LanguageModel:
    """Learn from labelled rows: ``docs_per_language`` texts of each language (all, if fewer), ``chars_per_doc`` bytes of each.

    The part of a longer text starts at a place that a hash of its key chooses, so no part of texts is left out.
    """
    room = F.greatest(F.length(text) - 2 * chars_per_doc, F.lit(0)) + 1
    part = F.substring(F.col(text), (F.pmod(F.xxhash64(F.col(key), F.lit("part")), room) + 1).cast("int"), F.lit(2 * chars_per_doc))
    rows = common.bounded_sample(train.where(F.col(text).isNotNull()), key, lang, docs_per_language, {"_part": part})
    prior = {r[0]: r[1] for r in train.where(F.col(lang).isNotNull()).groupBy(lang).count().collect()}
    raw: dict[str, list[bytes]] = {}
    for r in rows:
        raw.setdefault(r[lang], []).append(normalise(r["_part"])[:chars_per_doc])
    return LanguageModel({k: b"".join(v) for k, v in sorted(raw.items())}, prior, **settings)


def predict(docs: DataFrame, model: LanguageModel, key: str = "doc_id", text: str = "text", extra: dict[str, Column] | None = None) -> DataFrame:
    """(key, *extra, lang_pred, score, rejected) for every row, from its whole text alone."""
    common.python_ready(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    narrow = docs.select(F.col(key), F.col(text).alias("_text"), *[c.alias(k) for k, c in (extra or {}).items()])

    def work():
        m = shared.value

        def compute(texts: list) -> list[pa.Array]:
            lang, score, rejected = zip(*map(m.classify, texts), strict=True) if texts else ((), (), ())
            return [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())]

        return compute

    return common.map_column(narrow, "_text", "lang_pred string, score double, rejected boolean", work)


def query(spark, sf_dir: str) -> DataFrame:
    """op1: every document's language, learnt from the rows whose crc32(doc_id) mod 4 is not 2."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs.where(F.coalesce(common.crc_mod("doc_id", 4) != 2, F.lit(True))))
    held = {"held_out": F.coalesce(common.crc_mod("doc_id", 4) == 2, F.lit(False))}
    return predict(docs.drop("lang"), model, extra=held)
