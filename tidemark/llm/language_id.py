"""Language identification by error-correcting output codes.

Each language gets a codeword. One binary classifier a bit, over all byte n-grams of 2 to 4 bytes of the lower-cased text, tells
languages with a 1 there from those with a 0: naive Bayes, whose weight for an n-gram is the log ratio of its mean frequencies on
the two sides. A text's bits are decoded to the codeword with the least loss, where a bit counts by how well its classifier
separates (1 minus the overlap of the two sides); where the runner-up is close, the text is flagged as ambiguous.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import by_place, kept_columns, quoted, ship

ORDERS = (2, 3, 4)
SLOTS = 1 << 16
#: Documents of each language that training reads: an expected number, drawn by a hash of each row and its place. This bounds the sample.
SAMPLE = 2000
#: A text is ambiguous if the two best languages' shares of confidence differ by less.
CLOSE = 0.2
#: Marks and digits become spaces; letters and all bytes of other scripts stay.
LETTERS = bytes(b if b >= 0x80 or chr(b).isalpha() else 0x20 for b in range(256))
PIECE = 1 << 20


def held_out(doc_id: Column, folds: int = 5) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")), F.lit(0)) % folds == 0


def codewords(k: int) -> np.ndarray:
    """k rows of 0 and 1, far apart: every split of the languages up to five of them, else drawn splits (the same each time)."""
    if k <= 1:
        return np.zeros((k, 0), np.int8)
    if k <= 5:
        return np.array([[(c >> i) & 1 for c in range(1, 2 ** (k - 1))] for i in range(k - 1)] + [[0] * (2 ** (k - 1) - 1)], np.int8)
    rng, bits = np.random.default_rng(17), 8 + math.ceil(10 * math.log2(k))
    best, apart = None, -1
    for _ in range(50):
        code = rng.integers(0, 2, (k, bits)).astype(np.int8)
        if (code.any(0) & ~code.all(0)).all():
            d = min(int((code[i] != code[i + 1 :]).sum(1).min()) for i in range(k - 1))
            if d > apart:
                best, apart = code, d
    return best


def prepared(text: str) -> bytes:
    return b" " + text.lower().encode("utf-8", "replace").translate(LETTERS) + b" \0\0\0"


def slots(raw: np.ndarray) -> Iterator[np.ndarray]:
    """For each order the slot of the n-gram at each place but the last three."""
    n = max(0, len(raw) - 3)
    b = [raw[i : i + n].astype(np.uint32) for i in range(4)]
    two = b[0] << np.uint32(8) | b[1]
    yield two
    three = (two << np.uint32(8) | b[2]) * np.uint32(0x9E3779B1)
    yield three >> np.uint32(16)
    yield (three * np.uint32(31) ^ b[3] * np.uint32(0x85EBCA6B)) * np.uint32(0xC2B2AE35) >> np.uint32(16)


def counted(raw: np.ndarray) -> np.ndarray:
    """Places whose n-grams count: not between documents, nor in a gap of several spaces."""
    n = max(0, len(raw) - 3)
    return (raw[:n] != 0) & ~((raw[:n] == 32) & ((raw[1 : n + 1] == 32) | (raw[1 : n + 1] == 0)))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            raw = np.frombuffer(prepared(text), np.uint8)
            ok = counted(raw)
            t = totals.setdefault(lang, np.zeros((len(ORDERS), SLOTS), np.int64))
            for i, s in enumerate(slots(raw)):
                t[i] += np.bincount(s[ok], minlength=SLOTS)
    for lang, t in totals.items():
        flat = t.ravel()
        at = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int64)), pa.array(flat[at])], names=["lang", "slot", "n"])


@dataclass
class LanguageModel:
    langs: list[str]
    code: np.ndarray
    weights: np.ndarray
    trust: np.ndarray

    def decode(self, totals: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best language and share of confidence of each language, from summed weights and n-gram counts."""
        if len(self.langs) == 1:
            return np.zeros(len(n), int), np.ones((len(n), 1))
        margin = totals[:, : self.code.shape[1]] / np.sqrt(n + 1)[:, None]
        signs = 2.0 * self.code - 1
        loss = np.stack([(np.logaddexp(0, -margin * s) * self.trust).sum(1) for s in signs], 1)
        share = np.exp(-(loss - loss.min(1, keepdims=True)))
        share /= share.sum(1, keepdims=True)
        return loss.argmin(1), share


def drawn(rows: DataFrame, sample: int) -> DataFrame:
    """About `sample` rows of each language (text, lang), each drawn by itself, by a hash of its text and its place."""
    rows = rows.withColumn("place", F.monotonically_increasing_id()).filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    there = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not there:
        return rows.drop("place")
    share = F.create_map(*[x for lang, n in sorted(there.items()) for x in (F.lit(lang), F.lit(min(1.0, sample / n)))])
    return rows.filter(F.pmod(F.xxhash64("text", "place", F.lit(29)), F.lit(1 << 30)) < F.element_at(share, F.col("lang")) * (1 << 30)).drop("place")


def fit_language_model(docs: DataFrame, sample: int = SAMPLE) -> LanguageModel:
    """Learn from documents (text, lang; other columns are not read) with text and lang, about `sample` of each language, whole texts.

    Each row is drawn by itself, so equal rows, however many, and missing ids leave the sample's bound as it is. No such document: a
    model without languages, which predicts `und`. Counts are summed by Spark; the driver gets the model alone (languages x n-gram slots).
    """
    counts = drawn(docs.select("text", F.col("lang").cast("string").alias("lang")), sample).mapInArrow(_count, "lang string, slot bigint, n bigint")
    sums = counts.groupBy("lang", "slot").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(sums["lang"].to_pylist()))
    if not langs:
        return LanguageModel([], codewords(0), np.zeros((0, 0)), np.zeros(0))
    table = np.zeros((len(langs), len(ORDERS) * SLOTS))
    place = np.searchsorted(langs, sums["lang"].to_pylist())
    table[place, sums["slot"].to_numpy()] = sums["n"].to_numpy()
    code = codewords(len(langs))
    freq = table.reshape(len(langs), len(ORDERS), SLOTS) + 0.5
    freq /= freq.sum(2, keepdims=True)
    weights = np.zeros((len(ORDERS), SLOTS, -(-max(1, code.shape[1]) // 8) * 8), np.float32)
    trust = np.zeros(code.shape[1])
    for b in range(code.shape[1]):
        one, zero = freq[code[:, b] == 1].mean(0), freq[code[:, b] == 0].mean(0)
        weights[:, :, b] = np.log(one / zero)
        trust[b] = 1 - np.minimum(one, zero).sum(1).mean()
    return LanguageModel(langs, code, weights, trust / max(trust.sum(), 1e-9) * len(trust))


def _predict(model, text_at: int, keep: list[int], schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = LanguageModel(*model.value)
        for whole in batches:
            for at in range(0, len(whole), 256):
                batch = whole.slice(at, 256)
                texts = batch.column(text_at).to_pylist()
                lang, score, unsure = ["und"] * len(texts), [0.0] * len(texts), [True] * len(texts)
                some = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))] if m.langs else []
                if some:
                    raws = [prepared(texts[i]) for i in some]
                    raw = np.frombuffer(b"".join(raws) + b"\0\0\0", np.uint8)
                    ends = np.cumsum([len(r) for r in raws])
                    totals, n = np.zeros((len(some), m.weights.shape[2])), np.zeros(len(some))
                    for a in range(0, int(ends[-1]), PIECE):
                        part = raw[a : a + PIECE + 3]
                        ok = np.flatnonzero(counted(part))
                        if not len(ok):
                            continue
                        got = np.zeros((len(ok), m.weights.shape[2]), np.float32)
                        for i, s in enumerate(slots(part)):
                            got += m.weights[i].take(s[ok], axis=0)
                        docs = np.searchsorted(ends, ok + a, "right")
                        cut = np.flatnonzero(np.diff(docs, prepend=-1))
                        totals[docs[cut]] += np.add.reduceat(got, cut, axis=0, dtype=np.float64)
                        n[docs[cut]] += np.diff(cut, append=len(docs))
                    best, share = m.decode(totals, n)
                    top = np.sort(share, 1)[:, -2:]
                    for i, b, s, t in zip(some, best.tolist(), share.tolist(), top.tolist(), strict=True):
                        lang[i], score[i], unsure[i] = m.langs[b], s[b], len(t) > 1 and t[1] - t[0] < CLOSE
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(unsure, pa.bool_())], schema=schema)

    return run


def predict_language(docs: DataFrame, model: LanguageModel, columns: list[str] | None = None) -> DataFrame:
    """docs with lang_pred, score (0 to 1) and ambiguous, from the whole text alone.

    Null text or one without any letter (`str.isalpha`: no digits, fractions, circled or Roman numeral signs), and all texts if the model knows no language: `und`, score 0, ambiguous. columns: those of
    docs to keep, all by default; a column named like a result, in any case, is replaced. Rows stand alone: repeated ones get the same
    answer, none give none. Of languages that are equally near the first in code-point order is given, and the text is ambiguous. A very long
    text is read whole, PIECE bytes at a time, so memory beyond the text itself does not grow with it. The model is broadcast as lists and arrays; its size is 3 x 65,536 slots times a number of bits that grows
    with the logarithm of the number of languages (13 MB for up to five of them, 63 MB for a hundred).
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    results = ["lang_pred", "score", "ambiguous"]
    keep = [c for c in kept_columns(docs, results) if columns is None or c in columns]
    rows = docs.select(*[quoted(c) for c in dict.fromkeys([*keep, "text"])])
    schema = T.StructType([rows.schema[c] for c in keep] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())])
    run = _predict(docs.sparkSession.sparkContext.broadcast((model.langs, model.code, model.weights, model.trust)), rows.columns.index("text"), [rows.columns.index(c) for c in keep], to_arrow_schema(schema))
    return by_place(rows).mapInArrow(run, schema)


ship(__name__)
