"""Queries of the scalar functions. The tables hold Latin text, so letters are first translated to kana, full-width marks and ideographs; what a function sees still grows with the tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import concepts as C
from tidemark.functions import rules as R
from tidemark.functions import text as T
from tidemark.sources.tables import table

QUERIES = {}
ORACLE_SQL = {}
LATIN = "abcdefghijklmnopqrstuvwxyz"
MIXED = "アイウエオかきく　けＡＢＣさしすせそー。、（）／日本"
SPACES = T.SPACES
BASE = f"b AS (SELECT conv_id, turn, text AS raw, translate(text, '{LATIN}', '{MIXED}') AS s FROM conversations)"


def base(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("raw"), F.translate("text", LATIN, MIXED).alias("s"))


def scalar(name: str, column: Callable[[], Column], sql: str | None) -> None:
    """A query of one expression over all turns, and the same in SQL."""
    QUERIES[name] = lambda spark, sf_dir: base(spark, sf_dir).select("conv_id", "turn", column().alias("out"))
    if sql:
        ORACLE_SQL[name] = f"WITH {BASE} SELECT conv_id, turn, {sql} AS out FROM b"


def sub(x: str, pattern: str, to: str = "") -> str:
    return f"regexp_replace({x}, '{pattern}', '{to}', 'g')"


def joined(parts: str) -> str:
    return f"array_to_string({parts}, '|')"




def s() -> Column:
    return F.col("s")


def words_that(rule: Callable[[Column], Column]) -> Column:
    """How many words of the whole text satisfy a rule of one word."""
    return F.size(F.filter(F.split("s", " "), rule))


HALF = f"translate(s, '{T.FULL}', '{T.HALF.replace(chr(39), chr(39) * 2)}')"
HIRA = f"translate(s, '{T.KATAKANA}', '{T.HIRAGANA}')"


def normal(x: str) -> str:
    half = f"translate({x}, '{T.FULL}', '{T.HALF.replace(chr(39), chr(39) * 2)}')"
    return sub(sub(f"translate({half}, '{T.KATAKANA}', '{T.HIRAGANA}')", SPACES), r"[。.．]+\z")


def trim(x: str) -> str:
    return sub(x, rf"^{SPACES}+|{SPACES}+\z")


def split(x: str, marks: str) -> str:
    return f"list_filter(list_transform(regexp_split_to_array({x}, '{marks}'), lambda p: {trim('p')}), lambda p: p <> '')"


def escaped(x: str) -> str:
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#39;")):
        x = f"replace({x}, '{old}', '{new}')"
    return x


scalar("to_half_width", lambda: T.to_half_width(s()), HALF)
scalar("to_hiragana", lambda: T.to_hiragana(s()), HIRA)
scalar("to_katakana", lambda: T.to_katakana(s()), f"translate(s, '{T.HIRAGANA}', '{T.KATAKANA}')")
scalar("is_kana", lambda: words_that(T.is_kana), f"len(list_filter(string_split(s, ' '), lambda w: regexp_matches(w, '{T.KANA}')))::INTEGER")
scalar("kana_required", lambda: T.is_kana(s()), f"regexp_matches(s, '{T.KANA}')")
scalar("strip_spaces", lambda: T.strip_spaces(s()), sub("s", SPACES))
scalar("normalize_answer", lambda: T.normalize_answer(s()), normal("s"))
scalar("is_correct", lambda: T.is_correct(F.concat(s(), F.lit("。")), F.col("raw"), F.array(T.to_katakana(s()))), f"{normal('s')} <> '' AND list_contains([{normal('raw')}, {normal(f'translate(s, {chr(39)}{T.HIRAGANA}{chr(39)}, {chr(39)}{T.KATAKANA}{chr(39)})')}], {normal('s')})")
scalar("split_forms", lambda: F.array_join(T.split_forms(s()), "|"), joined(split("s", "[、，,／/]")))
scalar("split_kana_forms", lambda: F.array_join(T.split_kana_forms(s()), "|"), joined(split("s", "[／/]")))
scalar("short_gloss", lambda: T.short_gloss(s()), f"coalesce(nullif({trim('string_split(s, chr(65288))[1]')}, ''), {trim('s')})")
scalar("adj_forms", lambda: F.array_join(T.adj_forms(s()), "|"), joined(split("string_split(replace(s, '［な］', ''), '（')[1]", "[、，,／/]")))
scalar("chunking", lambda: F.array_join(T.chunks(s()), "|"), joined("regexp_extract_all(s, '[　 ]+|[^　 ]+')"))
scalar("strip_trailing_punct", lambda: T.strip_trailing_punct(s()), sub("s", r"[。？！.?!]+\z"))
scalar("collapse_ws", lambda: T.collapse_ws(s()), trim(sub("s", f"{SPACES}+", " ")))
scalar("strip_brackets", lambda: T.strip_brackets(s()), sub(sub("s", r"^[［〔\[(（]"), r"[］〕\])）]\z"))
scalar("extract_group", lambda: F.concat_ws("|", *T.extract_group(s(), ("本", "日", "そ"))), "CASE WHEN contains(s, '本') THEN '本|' || replace(s, '本', '') WHEN contains(s, '日') THEN '日|' || replace(s, '日', '') WHEN contains(s, 'そ') THEN 'そ|' || replace(s, 'そ', '') ELSE s END")
scalar("first_ideograph", lambda: T.first_ideograph(s()).cast("int"), "CAST(CASE WHEN regexp_matches(s, '[日本]') THEN length(regexp_extract(s, '^([^日本]*)[日本]', 1)) ELSE -1 END AS INTEGER)")
scalar("has_real_content", lambda: words_that(T.has_real_content), r"len(list_filter(string_split(s, ' '), lambda w: regexp_matches(w, '[^\p{P}\p{Z}]')))::INTEGER")
scalar("is_pure_punctuation", lambda: words_that(T.is_pure_punctuation), rf"len(list_filter(string_split(s, ' '), lambda w: NOT regexp_matches(w, '[^\p{{P}}\p{{Z}}]') AND {trim('w')} <> ''))::INTEGER")
scalar("escape_html", lambda: T.escape_html(F.concat(F.lit("<&'\""), s())), escaped("'<&''\"' || s"))
scalar("seeded_hash", lambda: T.seeded_hash(s()), f"CASE WHEN s = '' THEN {T.FNV_START} ELSE list_reduce(list_prepend({T.FNV_START}::BIGINT, list_transform(string_split(s, ''), lambda c: unicode(c)::BIGINT)), lambda h, c: (xor(h, c) * {T.FNV_PRIME}) % 4294967296) END")
scalar("split_by_literals", lambda: F.array_join(F.transform(T.split_by_literals(s(), ("か", "さし")), lambda p: F.concat(p["text"], F.when(p["label"], "!").otherwise(""))), "|"), "array_to_string(list_transform(list_filter(string_split(replace(replace(s, 'か', chr(1) || 'か' || chr(1)), 'さし', chr(1) || 'さし' || chr(1)), chr(1)), lambda p: p <> ''), lambda p: p || CASE WHEN p IN ('か', 'さし') THEN '!' ELSE '' END), '|')")
scalar("char_width", lambda: F.round(T.text_width(s(), F.lit(10.0)), 3), "list_sum(list_transform(string_split(s, ''), lambda c: CASE WHEN unicode(c) < 256 THEN 5.0::DOUBLE ELSE 10.0::DOUBLE END))")
scalar("is_base_char", lambda: T.is_base_char(s()), r"regexp_matches(s, '^[々一-鿿\p{Nd}]')")
scalar("usable_vocab", lambda: (F.coalesce(s(), F.lit("")) != "") & (F.coalesce(F.regexp_replace("raw", "[a-z .,]+|\\n", ""), F.lit("")) != ""), "coalesce(s, '') <> '' AND coalesce(regexp_replace(raw, '[a-z .,]+|\\n', '', 'g'), '') <> ''")
scalar("word_items", lambda: F.concat(F.col("raw"), F.when(F.col("turn") % 2 == 0, ":zh2jp").otherwise("")).endswith(":zh2jp"), "turn % 2 = 0 OR ends_with(raw, ':zh2jp')")
scalar("row_complete", lambda: T.row_complete(F.concat(s(), F.when(F.col("turn") % 3 == 0, "{S}").otherwise("")), F.when(F.col("turn") % 2 == 0, s())), r"turn % 3 <> 0 OR (turn % 2 = 0 AND s <> '')")
scalar("section_title", lambda: F.regexp_replace("s", f"{SPACES}+", ""), sub("s", f"{SPACES}+"))
scalar("match_entry", lambda: F.concat_ws("|", F.regexp_extract(F.concat(F.col("turn").cast("string"), F.lit("."), s()), r"^(\d+)\.?(.*)", 1), F.regexp_extract(F.concat(F.col("turn").cast("string"), F.lit("."), s()), r"(?s)^(\d+)\.?(.*)", 2)), r"regexp_extract(turn || '.' || s, '^(\d+)\.?(.*)', 1) || '|' || regexp_extract(turn || '.' || s, '(?s)^(\d+)\.?(.*)', 2)")
scalar("is_ideograph", lambda: F.concat_ws("|", F.regexp_count("s", F.lit(T.IDEOGRAPH)).cast("string"), F.regexp_count("s", F.lit(T.IDEOGRAPH_EXTENDED)).cast("string")), f"len(regexp_extract_all(s, '{T.IDEOGRAPH}'))::VARCHAR || '|' || len(regexp_extract_all(s, '{T.IDEOGRAPH_EXTENDED}'))::VARCHAR")
scalar("range_parse", lambda: F.size(T.range_parse(F.concat_ws("-", F.col("turn").cast("string"), F.when(F.col("turn") % 2 == 0, (F.col("turn") + 5).cast("string"))))), "CAST(CASE WHEN turn % 2 = 0 THEN 6 ELSE 1 END AS INTEGER)")
scalar("concepts_for", lambda: F.array_join(F.concat(C.word_concepts(F.col("raw"), F.when(F.col("turn") % 2 == 0, s())), C.change_concepts(F.col("raw"), F.lit("te"), F.lit("groupI"))), "|"), "CASE WHEN turn % 2 = 0 AND s <> '' THEN 'w:' || s || '|w:' || s || ':reading' ELSE 'w:' || raw END || '|r:te:groupI|w:' || raw || ':group'")
scalar("present_opts", lambda: F.exists(F.array(F.col("raw"), F.concat("raw", F.when(F.col("turn") % 3 == 0, ":reading").otherwise(""))), lambda c: c.endswith(":reading")), "turn % 3 = 0 OR ends_with(raw, ':reading')")


def own_marks() -> Column:
    """Two marks of a text: what stands at one place, marked there or one or two places on, and a full stop where the first one is."""
    at, moved = (F.col("conv_id") % 7).cast("int"), (F.col("turn") % 3).cast("int")
    first = F.struct((at + moved).alias("at"), F.substring("s", at + 1, F.lit(1)).alias("base"), F.lit("x").alias("kana"))
    stop = F.struct((F.instr("s", "。") - 1).alias("at"), F.lit("。").alias("base"), F.lit("x").alias("kana"))
    return F.array(first, stop)


def tail() -> Column:
    return F.array(*[F.struct(F.lit(at).alias("at"), F.lit(base).alias("base"), F.lit(kana).alias("kana")) for at, base, kana in ((4, "x", "ス"), (1, "え", "エ"), (0, "T", "テ"))])


scalar("annotate_marks", lambda: F.array_join(F.transform(T.annotate_marks(F.concat(F.lit("Tえ "), s()), tail()), lambda t: F.concat(t["text"], F.coalesce(F.concat(F.lit("["), t["reading"], F.lit("]")), F.lit("")))), "|"), "'T[テ]|え[エ]| ' || CASE WHEN s[2:2] = 'x' THEN s[1:1] || '|x[ス]' || CASE WHEN length(s) > 2 THEN '|' || s[3:] ELSE '' END ELSE s END")
MISPLACED = "s[conv_id % 7 + turn % 3 + 1]"
scalar("marks_apply_cleanly", lambda: T.marks_apply_cleanly(s(), own_marks()), f"coalesce({MISPLACED}, '') = coalesce(s[conv_id % 7 + 1], '') AND contains(s, '。')")
scalar("ruby_html", lambda: T.ruby_html(F.array(F.struct(F.col("raw").alias("text"), F.when(F.col("turn") % 2 == 0, s()).alias("reading"))), F.col("turn") % 3 == 0), f"CASE WHEN turn % 2 <> 0 THEN {escaped('raw')} WHEN turn % 3 = 0 THEN '<ruby>' || {escaped('raw')} || '</ruby>' ELSE '<ruby>' || {escaped('raw')} || '<rt>' || {escaped('s')} || '</rt></ruby>' END")


def fragments() -> Column:
    return F.when(F.col("turn") % 2 == 0, F.array(F.lit("Q"), F.lit(" →"), s())).otherwise(F.array(F.lit("Q"), s()))


scalar("split_cue_answer", lambda: F.concat_ws("|", *T.cue_and_answer(fragments())), "CASE WHEN turn % 2 = 0 THEN 'Q|' || s ELSE '|Q ' || s END")
scalar("template_fill", lambda: F.coalesce(T.template_fill(F.concat(F.lit("{S}は{T}、"), F.col("raw")), F.create_map(F.lit("S"), F.array(F.lit("私"), s()), F.lit("T"), F.array(F.lit("本"))), F.array(F.lit(1), (F.col("turn") % 2).cast("int")), F.array(F.lit("S"), F.lit("T"))), F.lit("none")), "CASE WHEN turn % 2 = 1 THEN 'none' ELSE s || 'は本、' || raw END")


def numbers(name: str, column, sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", column(F.col("l_orderkey"), F.col("l_partkey")).alias("out"))
    ORACLE_SQL[name] = f"SELECT l_orderkey, l_linenumber, {sql} AS out FROM lineitem"


def sql_list(x: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in x) + "]"


def sql_map(x: dict) -> str:
    return "MAP {" + ", ".join(f"{k if isinstance(k, int) else repr(k)}: '{v}'" for k, v in x.items()) + "}"


def sql_number(n: str) -> str:
    ten = f"({n}) // 10 % 10"
    return f"{sql_list(R.THOUSANDS)}[({n}) // 1000 + 1] || {sql_list(R.HUNDREDS)}[({n}) // 100 % 10 + 1] || CASE {ten} WHEN 0 THEN '' WHEN 1 THEN 'じゅう' ELSE {sql_list(R.ONES)}[{ten} + 1] || 'じゅう' END || {sql_list(R.ONES)}[({n}) % 10 + 1]"


def odd_or(table_: dict, n: str, suffix: str) -> str:
    return f"coalesce({sql_map(table_)}[({n})::INTEGER], {sql_number(n)} || '{suffix}')"


numbers("read_number", lambda o, p: R.read_number(o % 9999 + 1), sql_number("l_orderkey % 9999 + 1"))
numbers("read_hour", lambda o, p: R.read_hour(o % 12 + 1), odd_or(R.HOURS, "l_orderkey % 12 + 1", "じ"))
numbers("read_day", lambda o, p: R.read_day(o % 31 + 1), odd_or(R.DAYS, "l_orderkey % 31 + 1", "にち"))
numbers("read_month", lambda o, p: R.read_month(o % 12 + 1), odd_or(R.MONTHS, "l_orderkey % 12 + 1", "がつ"))
M = "(l_orderkey % 59 + 1)"
numbers("read_minute", lambda o, p: R.read_minute(o % 59 + 1), f"CASE WHEN {M} // 10 = 0 THEN '' WHEN {M} // 10 = 1 THEN CASE WHEN {M} % 10 = 0 THEN '' ELSE 'じゅう' END ELSE {sql_list(R.ONES)}[{M} // 10 + 1] || CASE WHEN {M} % 10 = 0 THEN '' ELSE 'じゅう' END END || {sql_list(R.MINUTES)}[{M} % 10 + 1]")
KEYS = list(R.COUNTERS)
numbers("read_counter", lambda o, p: R.read_counter(o % 10 + 1, F.get(F.array(*map(F.lit, KEYS)), (p % 12).cast("int"))), f"{sql_map(R.counter_table())}[{sql_list(KEYS)}[l_partkey % 12 + 1] || ':' || CAST(l_orderkey % 10 + 1 AS VARCHAR)]")
numbers("range_errors", lambda o, p: R.read_hour(o % 24).isNull(), "l_orderkey % 24 NOT BETWEEN 1 AND 12")
STEMS = ["いち", "かき", "およぎ", "はなし", "たべ", "し", "よみ", "あそび", "しに", "かり", "かい", "い"]
FORMS = list(R.VERB_FORMS)


def _verb(o, p):
    masu = F.concat((o % 100).cast("string"), F.get(F.array(*map(F.lit, STEMS)), (p % 12).cast("int")), F.lit("ます"))
    return R.conjugate(masu, F.get(F.array(F.lit("I"), F.lit("II"), F.lit("III")), (o % 3).cast("int")), F.get(F.array(*map(F.lit, FORMS)), (p % 5).cast("int")))


VERB = f"(CAST(l_orderkey % 100 AS VARCHAR) || {sql_list(STEMS)}[l_partkey % 12 + 1])"
numbers("conjugate", lambda o, p: F.coalesce(_verb(o, p), F.lit("none")), f"coalesce(CASE WHEN l_partkey % 5 < 4 THEN {VERB} || ['ます', 'ません', 'ました', 'ませんでした'][l_partkey % 5 + 1] WHEN l_orderkey % 3 > 0 THEN {VERB} || 'て' ELSE left({VERB}, -1) || {sql_map(R.JOINING)}[right({VERB}, 1)] END, 'none')")
CITES = ["おおきい", "いい", "かっこいい", "さむい", "しずか"]
A_FORMS = list(R.ADJECTIVE_FORMS)


def _adjective(o, p, also=False):
    cite, kind = F.get(F.array(*map(F.lit, CITES)), (o % 5).cast("int")), F.when(o % 5 == 4, "na").otherwise("i")
    form = F.get(F.array(*map(F.lit, A_FORMS)), (p % 6).cast("int"))
    return R.adjective_also(cite, kind, form) if also else R.conjugate_adjective(cite, kind, form)


CITE = f"{sql_list(CITES)}[l_orderkey % 5 + 1]"
STEM = f"CASE WHEN ends_with({CITE}, 'いい') THEN left({CITE}, -2) || 'よ' ELSE left({CITE}, -1) END"
numbers("conjugate_adj", lambda o, p: _adjective(o, p), f"CASE WHEN l_orderkey % 5 = 4 THEN {CITE} || {sql_list([v[2] for v in R.ADJECTIVE_FORMS.values()])}[l_partkey % 6 + 1] WHEN l_partkey % 6 = 0 THEN {CITE} || 'です' ELSE {STEM} || {sql_list([v[1] for v in R.ADJECTIVE_FORMS.values()])}[l_partkey % 6 + 1] END")
numbers("adjective_alts", lambda o, p: F.coalesce(_adjective(o, p, True), F.lit("none")), f"coalesce(CASE WHEN l_orderkey % 5 = 4 THEN {CITE} || CASE l_partkey % 6 WHEN 1 THEN 'ではありません' WHEN 3 THEN 'ではありませんでした' END ELSE {STEM} || CASE l_partkey % 6 WHEN 1 THEN 'くありません' WHEN 3 THEN 'くありませんでした' END END, 'none')")
numbers("form_lesson", lambda o, p: F.concat_ws("|", R.form_lesson(F.get(F.array(*map(F.lit, FORMS)), (p % 5).cast("int")), R.VERB_FORMS).cast("string"), R.form_lesson(F.get(F.array(*map(F.lit, A_FORMS)), (o % 6).cast("int")), R.ADJECTIVE_FORMS).cast("string")), "CAST([4, 4, 4, 4, 14][l_partkey % 5 + 1] AS VARCHAR) || '|' || CAST([8, 8, 12, 12, 16, 16][l_orderkey % 6 + 1] AS VARCHAR)")
