"""Text normalisation, splitting, matching and markup as column expressions. All stay in the JVM.

Offsets count code points from 0, as the data's own do within the basic plane; Spark's substring counts from 1, so 1 is added.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def span(lo: int, hi: int) -> str:
    return "".join(map(chr, range(lo, hi + 1)))


FULL, HALF = span(0xFF01, 0xFF5E), span(0x21, 0x7E)
KATAKANA, HIRAGANA = span(0x30A1, 0x30F6), span(0x3041, 0x3096)
#: White space as Unicode-aware dialects see it, the ideographic space included.
SPACES = r"[\t-\r\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
IDEOGRAPH = r"[々〆〇〻一-鿿]"
IDEOGRAPH_EXTENDED = r"[㐀-䶿一-鿿]"
KANA = r"[ぁ-ゖァ-ヺ]"
FNV_START, FNV_PRIME = 2166136261, 16777619


def to_half_width(s: Column) -> Column:
    return F.translate(s, FULL, HALF)


def to_hiragana(s: Column) -> Column:
    return F.translate(s, KATAKANA, HIRAGANA)


def to_katakana(s: Column) -> Column:
    return F.translate(s, HIRAGANA, KATAKANA)


def is_kana(s: Column) -> Column:
    return s.rlike(KANA)


def strip_spaces(s: Column) -> Column:
    return F.regexp_replace(s, SPACES, "")


def trimmed(s: Column) -> Column:
    return F.regexp_replace(s, f"^{SPACES}+|{SPACES}+\\z", "")


def normalize_answer(s: Column) -> Column:
    """Half width, hiragana, no spaces, no full stops at the end; null is empty. Applying it again changes nothing."""
    return F.regexp_replace(strip_spaces(to_hiragana(to_half_width(F.coalesce(s, F.lit(""))))), r"[。.．]+\z", "")


def is_correct(given: Column, answer: Column, alternatives: Column) -> Column:
    """Equal to the answer or an alternative once normalised; empty input is never right."""
    got = normalize_answer(given)
    return (got != "") & F.array_contains(F.transform(F.concat(F.array(answer), alternatives), normalize_answer), got)


def _split(s: Column, marks: str) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(s, F.lit("")), marks), trimmed), lambda x: x != "")


def split_forms(s: Column) -> Column:
    return _split(s, "[、，,／/]")


def split_kana_forms(s: Column) -> Column:
    return _split(s, "[／/]")


def short_gloss(s: Column) -> Column:
    """Text before the first full-width bracket, the whole if nothing is before it."""
    return F.coalesce(F.nullif(trimmed(F.substring_index(s, "（", 1)), F.lit("")), trimmed(s))


def adj_forms(s: Column) -> Column:
    return split_forms(F.substring_index(F.replace(F.coalesce(s, F.lit("")), F.lit("［な］"), F.lit("")), "（", 1))


def chunks(s: Column) -> Column:
    """Runs of spaces and runs of other characters, in turn: nothing is lost."""
    return F.regexp_extract_all(s, F.lit("([　 ]+|[^　 ]+)"), 1)


def strip_trailing_punct(s: Column) -> Column:
    return F.regexp_replace(s, r"[。？！.?!]+\z", "")


def collapse_ws(s: Column) -> Column:
    return trimmed(F.regexp_replace(s, f"{SPACES}+", " "))


def strip_brackets(s: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(s, r"^[［〔\[(（]", ""), r"[］〕\])）]\z", "")


def extract_group(s: Column, marks: tuple[str, ...] = ("Ⅰ", "Ⅱ", "Ⅲ")) -> tuple[Column, Column]:
    """(group, text without its mark): the first of the marks that occurs."""
    group = F.coalesce(*[F.when(s.contains(m), m) for m in marks])
    return group, F.when(group.isNull(), s).otherwise(F.replace(s, group, F.lit("")))


def first_ideograph(s: Column) -> Column:
    """Place of the first ideograph from 0, -1 without any."""
    return F.regexp_instr(s, F.lit(f"({IDEOGRAPH_EXTENDED})")) - 1


def has_real_content(s: Column) -> Column:
    return s.rlike(r"[^\p{P}\p{Z}]")


def is_pure_punctuation(s: Column) -> Column:
    """Only marks and spaces, but not blank."""
    return ~has_real_content(s) & (trimmed(s) != "")


def escape_html(s: Column) -> Column:
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        s = F.replace(s, F.lit(old), F.lit(new))
    return s


def ruby_html(tokens: Column, hide: Column) -> Column:
    """Tokens (text, reading; a null reading is plain text) as HTML."""
    return F.array_join(F.transform(tokens, lambda t: F.when(t["reading"].isNull(), escape_html(t["text"])).when(hide, F.concat(F.lit("<ruby>"), escape_html(t["text"]), F.lit("</ruby>"))).otherwise(F.concat(F.lit("<ruby>"), escape_html(t["text"]), F.lit("<rt>"), escape_html(t["reading"]), F.lit("</rt></ruby>")))), "")


def iso_time(seconds: Column) -> Column:
    """Epoch seconds as ISO text in UTC, whatever the session's zone."""
    at = F.timestamp_add("SECOND", seconds, F.expr("timestamp_ntz'1970-01-01 00:00:00'"))
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def seeded_hash(s: Column) -> Column:
    """32-bit FNV-1a over code units (code points here); the empty text gives the start value."""
    step = lambda h, c: ((h.bitwiseXOR(F.ascii(c).cast("bigint"))) * FNV_PRIME) % (1 << 32)
    return F.when(F.length(s) == 0, F.lit(FNV_START).cast("bigint")).otherwise(F.aggregate(F.split(s, ""), F.lit(FNV_START).cast("bigint"), step))


def annotate_marks(text: Column, marks: Column) -> Column:
    """Tokens of text with its valid marks (at, base, kana): those whose base stands there, in order, without overlaps."""
    valid = F.array_sort(F.filter(marks, lambda m: (m["at"] >= 0) & (F.substring(text, m["at"] + 1, F.length(m["base"])) == m["base"])))
    token = lambda a, b: F.struct(a.alias("text"), b.cast("string").alias("reading"))
    none = F.array().cast("array<struct<text:string,reading:string>>")

    def step(acc: Column, m: Column) -> Column:
        gap = F.when(m["at"] > acc["cursor"], F.array(token(F.substring(text, acc["cursor"] + 1, m["at"] - acc["cursor"]), F.lit(None)))).otherwise(none)
        new = F.struct((m["at"] + F.length(m["base"])).alias("cursor"), F.concat(acc["out"], gap, F.array(token(m["base"], m["kana"]))).alias("out"))
        return F.when(m["at"] < acc["cursor"], acc).otherwise(new)

    def finish(acc: Column) -> Column:
        return F.when(acc["cursor"] < F.length(text), F.array_append(acc["out"], token(F.substring(text, acc["cursor"] + 1, F.length(text)), F.lit(None)))).otherwise(acc["out"])

    return F.aggregate(valid, F.struct(F.lit(0).alias("cursor"), none.alias("out")), step, finish)


def marks_apply_cleanly(text: Column, marks: Column) -> Column:
    return F.forall(marks, lambda m: F.substring(text, m["at"] + 1, F.length(m["base"])) == m["base"])


def split_by_literals(text: Column, labels: tuple[str, ...]) -> Column:
    """Pieces of text, each with whether it is one of the labels."""
    import re

    either = "|".join(re.escape(x) for x in sorted(labels, key=len, reverse=True))
    pieces = F.regexp_extract_all(text, F.lit(f"(?s)({either}|(?:(?!{either}).)+)"), 1)
    return F.transform(pieces, lambda p: F.struct(p.alias("text"), p.isin(*labels).alias("label")))


def template_fill(template: Column, slots: Column, row: Column, names: Column) -> Column:
    """Template with {S} replaced by the row's choice of each slot; null if an index is out of range. names: the slots' sorted names."""
    values = F.zip_with(names, row, lambda k, i: F.struct(k.alias("k"), F.get(F.element_at(slots, k), i).alias("v")))
    filled = F.aggregate(values, template, lambda acc, x: F.replace(acc, F.concat(F.lit("{"), x["k"], F.lit("}")), x["v"]))
    return F.when(F.exists(values, lambda x: x["v"].isNull()), F.lit(None)).otherwise(filled)


def row_complete(template: Column, last_value: Column) -> Column:
    """Ends like a sentence, or has text after its last slot, or its last slot is filled."""
    return template.rlike(r"[。？！]\z") | ~template.rlike(r"\{[A-Z]\}\z") | (F.coalesce(last_value, F.lit("")) != "")


def char_width(ch: Column, size: Column) -> Column:
    return F.when(F.ascii(ch) < 256, 0.5 * size).otherwise(1.0 * size)


def text_width(s: Column, size: Column) -> Column:
    return F.aggregate(F.filter(F.split(s, ""), lambda c: c != ""), F.lit(0.0), lambda a, c: a + char_width(c, size))


def is_base_char(ch: Column) -> Column:
    return ch.rlike(r"^[々一-鿿\p{Nd}]")


def range_parse(s: Column) -> Column:
    """ "7" or "1-15" as an array of integers."""
    parts = F.split(s, "-")
    return F.sequence(F.element_at(parts, 1).cast("int"), F.element_at(parts, -1).cast("int"))


def cue_and_answer(fragments: Column, arrow: str = "→") -> tuple[Column, Column]:
    """First fragment and the rest as cue and answer if an arrow occurs (arrows themselves are noise), else no cue."""
    own = F.filter(fragments, lambda x: trimmed(x) != arrow)
    there = F.exists(fragments, lambda x: trimmed(x) == arrow)
    cue = F.when(there, F.get(own, F.lit(0))).otherwise(F.lit(""))
    return cue, F.array_join(F.when(there, F.slice(own, 2, 1000000)).otherwise(own), " ")
