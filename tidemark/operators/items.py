"""Practice items from materials and rules: each generator is a join with a small table and a projection; ids depend on content alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import concepts as C
from tidemark.functions import rules as R
from tidemark.functions import text as T
from tidemark.operators import layout
from tidemark.operators.mastery import collision_suffix, first_per_key

BLANK = "＿"
CHOICES = 4
#: Multiplier and increment of the shuffle's generator, and what separates the seeds of a pick and of its order.
STEP, ADD, SECOND = 1103515245, 12345, 0x5BF03635
#: Other particles that are right for a concept.
EQUIVALENT = {"p:e:direction": "に", "p:ni:destination": "へ", "p:ni:source": "から"}
#: Particles in the order in which a draft looks for them at a chunk's end.
PARTICLES = ["から", "まで", "より", "は", "が", "を", "に", "で", "と", "へ", "も"]


def seeded_shuffle(values: Column, seed: Column) -> Column:
    """values in the order that the generator started at `seed` gives: swaps from the end, as a fold over positions."""
    def swap(a: Column, i: Column) -> Column:
        s = (a["s"] * STEP + ADD) % (1 << 32)
        j = (s % (i + 1)).cast("int")
        moved = F.transform(a["v"], lambda x, k: F.when(k == i, F.get(a["v"], j)).when(k == j, F.get(a["v"], i)).otherwise(x))
        return F.struct(s.alias("s"), moved.alias("v"))

    start = F.struct(seed.cast("bigint").alias("s"), values.alias("v"))
    places = F.when(F.size(values) > 1, F.sequence(F.size(values) - 1, F.lit(1), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(places, start, swap, lambda a: a["v"])


def choices(correct: Column, pool: Column, item_id: Column) -> Column:
    """Four choices with the correct one, or null if its lesson has fewer than three others."""
    others = F.array_sort(F.array_remove(pool, correct))
    seed = T.seeded_hash(item_id)
    picked = F.slice(seeded_shuffle(others, seed), 1, CHOICES - 1)
    return F.when(F.size(others) >= CHOICES - 1, seeded_shuffle(F.concat(F.array(correct), picked), seed.bitwiseXOR(F.lit(SECOND).cast("bigint"))))


def recall(vocab: DataFrame) -> DataFrame:
    """Items of words (lesson, no, kana, kanji, zh): meaning to word, spelling to reading where there is one, word to meaning where choices suffice.

    Words without kana or gloss give none. Equal kana get the lesson and number as a suffix. Result: id, lesson, prompt, answer,
    alternatives, covers, skills, choices.
    """
    v = vocab.filter((F.coalesce("kana", F.lit("")) != "") & (F.coalesce("zh", F.lit("")) != "")).withColumn("kanji", F.nullif("kanji", F.lit("")))
    place = F.concat(F.lit("L"), F.col("lesson").cast("string"), F.coalesce(F.concat(F.lit("-"), F.col("no").cast("string")), F.lit("")))
    v = v.withColumns({"key": collision_suffix(v, "kana", place), "gloss": T.short_gloss(F.col("zh")), "words": C.word_concepts(F.col("kana"), F.col("kanji"))})
    v = v.join(v.groupBy("lesson").agg(F.collect_set("gloss").alias("pool")), "lesson")
    spellings = F.when(F.col("kanji").isNotNull(), F.concat(F.array("kanji"), T.split_forms(F.col("kanji")))).otherwise(F.array().cast("array<string>"))
    none = F.array().cast("array<string>")

    def made(kind: str, prompt: Column, answer: Column, alternatives: Column, concept: Column, picks: Column) -> Column:
        return F.struct(F.concat(F.lit("recall:"), F.col("key"), F.lit(f":{kind}")).alias("id"), prompt.alias("prompt"), answer.alias("answer"), alternatives.alias("alternatives"), F.array(concept).alias("covers"), picks.cast("array<string>").alias("choices"))

    jp2zh = F.concat(F.lit("recall:"), F.col("key"), F.lit(":jp2zh"))
    v = v.withColumn("picks", choices(F.col("gloss"), F.col("pool"), jp2zh))
    meaning, reading = F.get("words", F.lit(0)), F.get("words", F.lit(1))
    kinds = F.array_compact(
        F.array(
            made("zh2jp", F.col("zh"), F.col("kana"), F.array_distinct(F.concat(spellings, T.split_kana_forms(F.col("kana")))), meaning, F.lit(None)),
            F.when(F.col("kanji").isNotNull(), made("kanji2kana", F.col("kanji"), F.col("kana"), none, reading, F.lit(None))),
            F.when(F.col("picks").isNotNull(), made("jp2zh", F.coalesce("kanji", "kana"), F.col("gloss"), none, meaning, F.col("picks"))),
        )
    )
    return v.select("lesson", F.inline(kinds)).withColumn("skills", C.skills_of(F.col("covers")))


def transform(vocab: DataFrame, verbs: DataFrame) -> DataFrame:
    """Verb forms: words (lesson, pos, kana, kanji) whose first spelling is in verbs (cite, group, reading), the earliest of each; unlisted ones give none."""
    cite = F.coalesce(F.get(T.split_forms(F.col("kanji")), F.lit(0)), F.col("kana"))
    rows = first_per_key(vocab.withColumn("cite", cite), ["cite"], [F.col("lesson"), F.col("pos")]).join(verbs, "cite")
    rows = rows.withColumn("form", F.explode(F.array(*[F.lit(f) for f in R.VERB_FORMS if f != "masu"])))
    answer, kana = R.conjugate(F.col("cite"), F.col("group"), F.col("form")), R.conjugate(F.col("reading"), F.col("group"), F.col("form"))
    others = F.transform(F.filter(T.split_forms(F.col("kanji")), lambda x, k: k > 0), lambda x: R.conjugate(x, F.col("group"), F.col("form")))
    alternatives = F.array_distinct(F.filter(F.concat(F.array(kana), F.coalesce(others, F.array().cast("array<string>"))), lambda x: x.isNotNull() & (x != answer)))
    covers = C.change_concepts(F.col("cite"), F.col("form"), F.concat(F.lit("group"), F.col("group")))
    out = rows.select(F.concat(F.lit("conj:"), "cite", F.lit(":masu2"), "form").alias("id"), "lesson", F.greatest(F.col("lesson"), R.form_lesson(F.col("form"), R.VERB_FORMS)).alias("requires_lesson"), F.col("cite").alias("prompt"), answer.alias("answer"), alternatives.alias("alternatives"), covers.alias("covers"))
    return out.filter("answer IS NOT NULL").withColumn("skills", C.skills_of(F.col("covers")))


def adjectives(vocab: DataFrame, table: DataFrame) -> DataFrame:
    """Adjective forms, likewise; table: cite, kind (i or na), reading."""
    forms = T.adj_forms(F.coalesce(F.nullif("kanji", F.lit("")), "kana"))
    rows = vocab.withColumn("forms", forms).withColumn("cite", F.get("forms", F.lit(0))).filter("cite IS NOT NULL")
    rows = first_per_key(rows, ["cite"], [F.col("lesson"), F.col("pos")]).join(table, "cite")
    rows = rows.withColumn("form", F.explode(F.array(*[F.lit(f) for f in R.ADJECTIVE_FORMS if f != "plain"])))
    own = [F.col("cite"), F.col("reading")]
    answer = R.conjugate_adjective(F.col("cite"), F.col("kind"), F.col("form"))
    more = F.array(*[f(x, F.col("kind"), F.col("form")) for x in own for f in (R.adjective_also, R.conjugate_adjective)])
    alternatives = F.array_distinct(F.filter(more, lambda x: x.isNotNull() & (x != answer)))
    covers = C.change_concepts(F.col("cite"), F.col("form"), F.concat("kind", F.lit("adj")))
    out = rows.select(F.concat(F.lit("adj:"), "cite", F.lit(":"), "form").alias("id"), "lesson", F.greatest(F.col("lesson"), R.form_lesson(F.col("form"), R.ADJECTIVE_FORMS)).alias("requires_lesson"), F.col("cite").alias("prompt"), answer.alias("answer"), alternatives.alias("alternatives"), covers.alias("covers"))
    return out.filter("answer IS NOT NULL").withColumn("skills", C.skills_of(F.col("covers")))


def substitute(patterns: DataFrame) -> DataFrame:
    """Rows of substitution tables (id, lesson, template, slots, rows), each with another valid row as its example. Tables of one row give none; a row whose index is out of range is left out."""
    rows = patterns.filter(F.size("rows") >= 2).select("*", F.posexplode("rows").alias("no", "row")).withColumn("names", F.array_sort(F.map_keys("slots")))
    cues = F.array_join(F.filter(F.zip_with("names", "row", lambda k, i: F.get(F.element_at("slots", k), i)), lambda x: F.coalesce(x, F.lit("")) != ""), " ／ ")
    rows = rows.withColumns({"answer": T.template_fill(F.col("template"), F.col("slots"), F.col("row"), F.col("names")), "cues": cues}).filter("answer IS NOT NULL")
    told = layout.adjacent_match(rows.select("id", "lesson", "no", "answer", "cues"), ["id"], "no", F.lit(True)).filter("other IS NOT NULL")
    examples = rows.select("id", F.col("no").alias("other"), F.col("answer").alias("example"))
    return told.join(examples, ["id", "other"]).select(F.concat(F.lit("subst:"), "id", F.lit(":"), F.col("no").cast("string")).alias("id"), "lesson", "example", "cues", "answer")


def drills(table: DataFrame) -> DataFrame:
    """Rows of curated drills (id, lesson, model_answer, ask, rows of cue and answer) but those equal to the model; numbers count the ones left out."""
    rows = table.select("id", "lesson", "model_answer", "ask", F.posexplode("rows").alias("no", "row")).filter(~F.col("row.answer").eqNullSafe(F.col("model_answer")))
    hint = F.when(F.col("ask"), "answer as in the example").otherwise("make a sentence as in the example")
    return rows.select(F.concat(F.lit("drill:"), "id", F.lit(":"), F.col("no").cast("string")).alias("id"), "lesson", F.col("row.cue").alias("prompt"), hint.alias("hint"), F.col("row.answer").alias("answer"))


def cloze_particles(marks: DataFrame, sentences: DataFrame) -> DataFrame:
    """One item for each mark (sentence, at, p, c) that stands in its sentence (sentence, lesson, jp, alt)."""
    rows = marks.join(sentences, "sentence").filter(F.substring("jp", F.col("at") + 1, F.length("p")) == F.col("p"))
    blanked = F.concat(F.substring("jp", F.lit(1), F.col("at")), F.lit(BLANK), F.substring("jp", F.col("at") + 1 + F.length("p"), F.length("jp")))
    other = F.array_compact(F.array(R.lookup(EQUIVALENT, F.col("c"))))
    alternatives = F.array_except(F.array_distinct(F.concat(F.coalesce("alt", F.array().cast("array<string>")), other)), F.array("p"))
    return rows.select(F.concat(F.lit("cloze:"), "sentence", F.lit(":"), F.col("at").cast("string")).alias("id"), "lesson", blanked.alias("prompt"), F.col("p").alias("answer"), alternatives.alias("alternatives"), F.array("c").alias("covers"))


def cloze_phrases(sentences: DataFrame, forms: DataFrame, tails: list[str]) -> DataFrame:
    """One item for each chunk (sentence, lesson, jp) that begins with a known form (form, cite, form_lesson, zh; each form once) and ends with an allowed tail: the longest such form."""
    pieces = sentences.select("sentence", "lesson", "jp", F.posexplode(T.chunks(F.col("jp"))).alias("k", "chunk"))
    offset = F.coalesce(F.sum(F.length("chunk")).over(W.partitionBy("sentence").orderBy("k").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    pieces = pieces.withColumns({"pos": offset.cast("int"), "body": T.strip_trailing_punct(F.col("chunk"))}).filter(T.trimmed(F.col("chunk")) != "")
    best = layout.longest_prefix(pieces.select("body").distinct(), "body", forms, "form", tails)
    rows = pieces.join(best, "body").join(forms, F.col("head") == F.col("form"))
    blanked = F.concat(F.substring("jp", F.lit(1), F.col("pos")), F.lit(BLANK), F.substring("jp", F.col("pos") + 1 + F.length("head"), F.length("jp")))
    return rows.select(F.concat(F.lit("cloze:"), "sentence", F.lit(":"), F.col("pos").cast("string"), F.lit(":phrase")).alias("id"), "lesson", F.greatest("lesson", "form_lesson").alias("requires_lesson"), blanked.alias("prompt"), F.col("zh").alias("hint"), F.col("head").alias("answer"), F.array(F.concat(F.lit("w:"), "cite")).alias("covers"))


def quantities(wanted: DataFrame) -> DataFrame:
    """Items of numbers with counters (counter, n), each once; unknown ones give none."""
    answer = R.read_counter(F.col("n"), F.col("counter"))
    label = R.lookup({k: v[0] for k, v in R.COUNTERS.items()}, F.col("counter"))
    lesson = R.lookup({k: v[1] for k, v in R.COUNTERS.items()}, F.col("counter"))
    rows = wanted.select("counter", "n").distinct().withColumn("answer", answer).filter("answer IS NOT NULL")
    return rows.select(F.concat(F.lit("qty:c:"), "counter", F.lit(":"), F.col("n").cast("string")).alias("id"), lesson.alias("lesson"), F.concat(F.col("n").cast("string"), label).alias("prompt"), "answer", F.array(F.concat(F.lit("c:"), "counter")).alias("covers"))


def draft_particles(chunk: Column) -> Column:
    """First particle, in their order, that ends the chunk and is shorter than it."""
    return F.coalesce(*[F.when(chunk.endswith(p) & (F.length(chunk) > len(p)), p) for p in PARTICLES])


def draft_drills(table: DataFrame) -> DataFrame:
    """Extracted drills (id, cues, answers, items): cues and answers joined by ｜ become one row each if their counts agree, else the whole is one."""
    cues, answers = F.split("cues", "｜"), F.split("answers", "｜")
    pairs = F.when(F.size(cues) == F.size(answers), F.arrays_zip(cues.alias("cue"), answers.alias("answer"))).otherwise(F.array(F.struct(F.col("cues").alias("cue"), F.col("answers").alias("answer"))))
    rows = table.filter(F.size("items") > 0).withColumn("pairs", pairs).select("id", F.size("pairs").alias("many"), F.posexplode("pairs").alias("k", "p"))
    return rows.select(F.when(F.col("many") > 1, F.concat("id", F.lit("#"), (F.col("k") + 1).cast("string"))).otherwise(F.col("id")).alias("id"), F.col("p.cue").alias("cue"), F.col("p.answer").alias("answer"))
