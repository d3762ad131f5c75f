"""Language identification by compression with one dictionary for each language."""

from __future__ import annotations

import math
import re
from functools import lru_cache

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strideframe.llm.mixing import unit

#: Bounds of the fit: texts of each language, characters of each text, and bytes of a dictionary.  Dictionaries of
#: equal size compare fairly.
SAMPLE_TEXTS, SAMPLE_CHARS, DICTIONARY = 256, 1024, 65536
PARTS = 64
#: Bytes that are compressed at once, so that a long text leans on the dictionary and not on itself.
CHUNK = 2048
LEVEL = 6
#: A text of fewer bytes is repeated before it is compressed.
SHORT = 128
#: A text is rejected when the second-best language needs less than this share more bytes than the best.
LEAST_MARGIN = 0.005
#: How fast the score falls with each byte that another language comes nearer.
PER_BYTE = 0.25
NO_LANGUAGE = "und"
LETTERS = re.compile(r"[^\W\d_]+")


def fit(docs: DataFrame, texts: int = SAMPLE_TEXTS, chars: int = SAMPLE_CHARS, size: int = DICTIONARY, text: str = "text", lang: str = "lang",
        key: str = "doc_id") -> dict[str, bytes]:
    """Raw dictionary of each language: pieces of at most `chars` characters of `texts` labelled texts.

    The sample is bounded by its parameters, is the same for the same rows, and takes pieces from anywhere in the
    texts.  Rows without text or language are not learned from.
    """
    rows = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull())
    at = 1 + F.floor(unit(F.lit("at"), F.col(key)) * F.greatest(F.lit(1), F.length(text) - chars)).cast("int")
    pieces = rows.select(F.col(lang).alias("lang"), F.lower(F.col(text).substr(at, F.lit(chars))).alias("piece"), unit(F.lit("fit"), F.col(key)).alias("order"))
    pieces = pieces.where(F.col("piece").rlike(r"\p{L}"))
    # the first ones of a language are among the first ones of each of its parts, so no task ranks more than PARTS x texts
    parts = pieces.withColumn("part", F.pmod(F.xxhash64("order", "piece"), F.lit(PARTS)))
    first = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("order", "piece"))
    chosen = parts.withColumn("n", first("lang", "part")).where(F.col("n") <= texts)
    chosen = chosen.withColumn("n", first("lang")).where(F.col("n") <= texts)
    found: dict[str, list[str]] = {}
    for r in chosen.orderBy("lang", "n").collect():  # languages x texts x chars at most
        found.setdefault(r["lang"], []).append(r["piece"])
    return {k: " ".join(" ".join(words(p)) for p in dict.fromkeys(v)).encode()[-size:] for k, v in found.items()}


def words(text: str) -> list[str]:
    """Lower-cased runs of letters."""
    return LETTERS.findall(text.lower())


@lru_cache(maxsize=2)
def _compressors(model: tuple[tuple[str, bytes], ...]):
    out = []
    for name, raw in model:
        d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=LEVEL)
        out.append((name, zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)))
    return out


def classify(text: str | None, model: tuple[tuple[str, bytes], ...]) -> tuple[str, float, float]:
    """Language, score from 0 to 1, and margin of a text.

    All words of the text are compressed in chunks with each dictionary; the language with the fewest bytes wins, the first by
    name among equals.  The margin is the share by which the second needs more.  Null texts, texts without a letter
    and empty models give `und` with score and margin 0.
    """
    if not model or not text or not LETTERS.search(text):
        return NO_LANGUAGE, 0.0, 0.0
    raw = " ".join(words(text)).encode()
    if len(raw) < SHORT:  # too short to be compressed at all; its repeats cost the same in every language
        raw = b" ".join([raw] * 16)
    chunks = [raw[i : i + CHUNK] for i in range(0, len(raw), CHUNK)]
    sizes = sorted((sum(len(c.compress(x)) for x in chunks), name) for name, c in _compressors(model))
    best = sizes[0][0]
    score = 1 / sum(math.exp(-min(700.0, PER_BYTE * (n - best))) for n, _ in sizes)
    return sizes[0][1], score, (sizes[1][0] - best) / best if len(sizes) > 1 else 1.0


def identify(docs: DataFrame, dictionaries: dict[str, bytes], text: str = "text", least_margin: float = LEAST_MARGIN) -> DataFrame:
    """`docs` with lang_pred, score, margin and accepted (a language was found and its margin is wide enough).

    Columns of these names in `docs` are replaced.  Only the text is used.  Rows are handled one by one, so an empty
    table, repeated rows and very long texts need nothing special.
    """
    model = tuple(sorted(dictionaries.items()))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("struct<lang_pred string, score double, margin double>")
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([classify(t, shared.value) for t in texts], columns=["lang_pred", "score", "margin"])

    run = run.asNondeterministic()  # evaluated once for each row, however many of its fields are used
    out = docs.drop("lang_pred", "score", "margin", "accepted").withColumn("_l", run(F.col(text)))
    accepted: Column = (F.col("_l.lang_pred") != NO_LANGUAGE) & (F.col("_l.margin") >= least_margin)
    return out.select(*[c for c in out.columns if c != "_l"], F.col("_l.lang_pred"), F.col("_l.score"), F.col("_l.margin"), accepted.alias("accepted"))
