"""Readings of numbers, hours, dates and counters, and verb and adjective forms, as column expressions over small tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Readings by digit.
ONES = ["", "いち", "に", "さん", "よん", "ご", "ろく", "なな", "はち", "きゅう"]
HUNDREDS = ["", "ひゃく", "にひゃく", "さんびゃく", "よんひゃく", "ごひゃく", "ろっぴゃく", "ななひゃく", "はっぴゃく", "きゅうひゃく"]
THOUSANDS = ["", "せん", "にせん", "さんぜん", "よんせん", "ごせん", "ろくせん", "ななせん", "はっせん", "きゅうせん"]
# Irregular readings of hours, minutes by last digit, days and months.
HOURS = {4: "よじ", 7: "しちじ", 9: "くじ"}
MINUTES = ["じゅっぷん", "いっぷん", "にふん", "さんぷん", "よんぷん", "ごふん", "ろっぷん", "ななふん", "はっぷん", "きゅうふん"]
DAYS = {1: "ついたち", 2: "ふつか", 3: "みっか", 4: "よっか", 5: "いつか", 6: "むいか", 7: "なのか", 8: "ようか", 9: "ここのか", 10: "とおか", 14: "じゅうよっか", 20: "はつか", 24: "にじゅうよっか"}
MONTHS = {4: "しがつ", 7: "しちがつ", 9: "くがつ"}
# How 1 to 10 begin before a counter of each series, and counters as (series, base, third, first and sixth).
SERIES = {
    "h": ["いっ{p}", "に{s}", "さん{b}", "よん{s}", "ご{s}", "ろっ{p}", "なな{s}", "はっ{p}", "きゅう{s}", "じゅっ{p}"],
    "k": ["いっ{s}", "に{s}", "さん{b}", "よん{s}", "ご{s}", "ろっ{s}", "なな{s}", "はっ{s}", "きゅう{s}", "じゅっ{s}"],
    "s": ["いっ{s}", "に{s}", "さん{s}", "よん{s}", "ご{s}", "ろく{s}", "なな{s}", "はっ{s}", "きゅう{s}", "じゅっ{s}"],
    "plain": ["いち{s}", "に{s}", "さん{s}", "よん{s}", "ご{s}", "ろく{s}", "なな{s}", "はち{s}", "きゅう{s}", "じゅう{s}"],
    "yo": ["いち{s}", "に{s}", "さん{s}", "よ{s}", "ご{s}", "ろく{s}", "なな{s}", "はち{s}", "きゅう{s}", "じゅう{s}"],
    "time": ["いち{s}", "に{s}", "さん{s}", "よ{s}", "ご{s}", "ろく{s}", "しち{s}", "はち{s}", "く{s}", "じゅう{s}"],
    "people": ["ひとり", "ふたり", "さん{s}", "よ{s}", "ご{s}", "ろく{s}", "なな{s}", "はち{s}", "きゅう{s}", "じゅう{s}"],
}
# Counters as (label, lesson, series, base, after p, after b).
COUNTERS = {
    "hon": ("本", 11, "h", "ほん", "ぽん", "ぼん"),
    "hiki": ("匹", 11, "h", "ひき", "ぴき", "びき"),
    "satsu": ("冊", 11, "s", "さつ", "", ""),
    "sai": ("歳", 1, "s", "さい", "", ""),
    "kai_floor": ("階", 3, "k", "かい", "", "がい"),
    "kai_times": ("回", 11, "k", "かい", "", "かい"),
    "nin": ("人", 11, "people", "にん", "", ""),
    "mai": ("枚", 11, "plain", "まい", "", ""),
    "dai": ("台", 11, "plain", "だい", "", ""),
    "en": ("円", 3, "yo", "えん", "", ""),
    "jikan": ("時間", 11, "time", "じかん", "", ""),
    "nen": ("年", 11, "yo", "ねん", "", ""),
}
# Verb forms with the lesson that unlocks each, their endings, and the joining ending by last kana of the stem.
VERB_FORMS = {"masu": (4, "ます"), "masen": (4, "ません"), "mashita": (4, "ました"), "masendeshita": (4, "ませんでした"), "te": (14, "て")}
JOINING = {"い": "って", "ち": "って", "り": "って", "に": "んで", "び": "んで", "み": "んで", "き": "いて", "ぎ": "いで", "し": "して"}
JOINING_ODD = ("いきます", "行きます")
# Adjective forms as (lesson, ending after an i stem, ending after a na word), and other endings that are right too.
ADJECTIVE_FORMS = {
    "plain": (8, "いです", "です"),
    "neg": (8, "くないです", "じゃありません"),
    "past": (12, "かったです", "でした"),
    "pastneg": (12, "くなかったです", "じゃありませんでした"),
    "te": (16, "くて", "で"),
    "adverb": (16, "く", "に"),
}
ADJECTIVE_ALSO = {"neg": ("くありません", "ではありません"), "pastneg": ("くありませんでした", "ではありませんでした")}


def lookup(table: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def digits(table: list[str], digit: Column) -> Column:
    return F.get(F.array(*map(F.lit, table)), digit.cast("int"))


def read_number(n: Column) -> Column:
    """Reading of 1 to 9999, null outside."""
    tens = F.floor(n % 100 / 10)
    ten = F.when(tens == 0, "").when(tens == 1, "じゅう").otherwise(F.concat(digits(ONES, tens), F.lit("じゅう")))
    return F.when(n.between(1, 9999), F.concat(digits(THOUSANDS, F.floor(n / 1000)), digits(HUNDREDS, F.floor(n % 1000 / 100)), ten, digits(ONES, n % 10)))


def read_hour(n: Column) -> Column:
    return F.when(n.between(1, 12), F.coalesce(lookup(HOURS, n.cast("int")), F.concat(read_number(n), F.lit("じ"))))


def read_minute(n: Column) -> Column:
    tens, one = F.floor(n / 10), n % 10
    ten = F.when(tens == 0, "").when(tens == 1, F.when(one == 0, "").otherwise("じゅう")).otherwise(F.concat(digits(ONES, tens), F.when(one == 0, "").otherwise("じゅう")))
    return F.when(n.between(1, 59), F.concat(ten, digits(MINUTES, one)))


def read_day(n: Column) -> Column:
    return F.when(n.between(1, 31), F.coalesce(lookup(DAYS, n.cast("int")), F.concat(read_number(n), F.lit("にち"))))


def read_month(n: Column) -> Column:
    return F.when(n.between(1, 12), F.coalesce(lookup(MONTHS, n.cast("int")), F.concat(read_number(n), F.lit("がつ"))))


def counter_table() -> dict[str, str]:
    """counter:number -> reading, for every counter and 1 to 10."""
    return {f"{key}:{i + 1}": way.format(s=base, p=p, b=b) for key, (_, _, series, base, p, b) in COUNTERS.items() for i, way in enumerate(SERIES[series])}


def read_counter(n: Column, key: Column) -> Column:
    """Null for an unknown counter or a number outside 1 to 10."""
    return lookup(counter_table(), F.concat(key, F.lit(":"), n.cast("string")))


def required(value: Column, what: str) -> Column:
    """The value; a null is an error with `what` and fails the query."""
    return F.when(value.isNull(), F.raise_error(F.lit(what))).otherwise(value)


def form_lesson(form: Column, forms: dict) -> Column:
    return lookup({k: v[0] for k, v in forms.items()}, form)


def conjugate(masu: Column, group: Column, form: Column) -> Column:
    """Form of a verb given by its polite form; null for bad input."""
    stem = F.substring(masu, F.lit(1), F.length(masu) - 2)
    shorter, last = F.substring(masu, F.lit(1), F.length(masu) - 3), F.substring(stem, -1, 1)
    joined = F.when(masu.isin(*JOINING_ODD), F.concat(shorter, F.lit("って"))).when(group.isin("II", "III"), F.concat(stem, F.lit("て"))).otherwise(F.concat(shorter, lookup(JOINING, last)))
    plain = F.concat(stem, lookup({k: v[1] for k, v in VERB_FORMS.items() if k != "te"}, form))
    return F.when(masu.endswith("ます") & group.isin("I", "II", "III"), F.when(form == "te", joined).otherwise(plain))


def _stem(cite: Column) -> Column:
    return F.when(cite.endswith("いい"), F.concat(F.substring(cite, F.lit(1), F.length(cite) - 2), F.lit("よ"))).otherwise(F.substring(cite, F.lit(1), F.length(cite) - 1))


def conjugate_adjective(cite: Column, kind: Column, form: Column) -> Column:
    """Form of an adjective (kind i or na); null for bad input."""
    i = F.when(form == "plain", F.concat(cite, F.lit("です"))).otherwise(F.concat(_stem(cite), lookup({k: v[1] for k, v in ADJECTIVE_FORMS.items()}, form)))
    na = F.concat(cite, lookup({k: v[2] for k, v in ADJECTIVE_FORMS.items()}, form))
    return F.when((kind == "i") & cite.endswith("い"), i).when((kind == "na") & (cite != ""), na)


def adjective_also(cite: Column, kind: Column, form: Column) -> Column:
    """Another form that is right too, or null."""
    i = F.concat(_stem(cite), lookup({k: v[0] for k, v in ADJECTIVE_ALSO.items()}, form))
    na = F.concat(cite, lookup({k: v[1] for k, v in ADJECTIVE_ALSO.items()}, form))
    return F.when((kind == "i") & cite.endswith("い"), i).when((kind == "na") & (cite != ""), na)
